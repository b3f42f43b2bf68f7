"""Rules and rule sets (R-01 to R-03, J-01, J-02, J-04, F-01 to F-05, U-01, U-02).

A `TermRule` is data: rows of terms, a condition and a message. All term rules of a set are
evaluated together by one broadcast join of their terms to the items of the corpus, so any number
of them costs one pass. A `FunctionRule` is any function from the context to a findings DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode import catalog
from codelode.functions.expressions import unsafe_function_message
from codelode.operators import extract
from codelode.sources.shared import written

FINDINGS = (
    "vulnerability_rule_id string, vulnerability_rule_name string, description string, "
    "recommendation string, severity string, source_file_path string, "
    "programming_language string, line_number int, column_number int"
)
FINDING_COLUMNS = [part.strip().split(" ")[0] for part in FINDINGS.split(",")]

# Columns that carry the report order besides path, line and column.
ORDER_COLUMNS = ["rule_ordinal", "item_pos"]


@dataclass(frozen=True, eq=False)
class TermRule:
    """A rule that looks names up in a list of terms.

    `terms` are `(qualifier, name)` pairs, where no qualifier means any. `item` says whether the
    names are of calls or of assigned variables. `condition` and `message` are built on the columns
    of an item: name, qualifier, value, n_args, n_strings.
    """

    id: str
    name: str
    description: str
    recommendation: str
    severity: str
    item: str
    terms: tuple[tuple[str | None, str], ...]
    condition: Callable[[], Column]
    message: Callable[[], Column]
    fold_case: bool = False


@dataclass(frozen=True)
class Context:
    """What a rule sees: the units and the tables extracted from them.

    The first rule that asks for calls or assignments has the units scanned for both, and the rows written to the shared
    folder; whatever asks later reads them, the term rules of the set included.
    """

    units: DataFrame

    @cached_property
    def items(self) -> DataFrame:
        return extract.placed(extract.items(extract.with_inner_code(self.units)))

    @cached_property
    def facts(self) -> DataFrame:
        return written(extract.facts(self.units), "facts")

    @cached_property
    def assignments(self) -> DataFrame:
        return extract.assignments_of(self.facts)

    @cached_property
    def calls(self) -> DataFrame:
        return extract.calls_of(self.facts)


@dataclass(frozen=True, eq=False)
class FunctionRule:
    """A rule given as a function from the context to a DataFrame with the findings columns."""

    id: str
    name: str
    description: str
    analyse: Callable[[Context], DataFrame]
    recommendation: str = ""
    severity: str = "LOW"


Rule = TermRule | FunctionRule


def _string_value() -> Column:
    value = F.col("value")
    return (value["kind"] == "STRING") & (F.length(value["text"]) >= catalog.MINIMUM_SECRET_LENGTH)


# The wording of this rule's description and recommendation is our own.
HARDCODED_CREDENTIALS = TermRule(
    id=catalog.GEN001,
    name="Hardcoded Credentials",
    description="Credential stored in source code.",
    recommendation="Keep credentials in a secret store or in the environment.",
    severity="HIGH",
    item=extract.ASSIGNMENT,
    terms=tuple((None, name) for name in catalog.CREDENTIAL_NAMES),
    condition=_string_value,
    message=lambda: F.concat(
        F.lit("Hardcoded credential in variable '"), F.col("name"), F.lit("' detected.")
    ),
    fold_case=True,
)

# Names, messages and recommendations of the two call rules.
UNSAFE_CODE_EXECUTION = TermRule(
    id=catalog.GEN002,
    name="Unsafe Code Execution",
    description="Dynamic execution of source code detected.",
    recommendation="Avoid eval/exec-style APIs whenever possible.",
    severity="HIGH",
    item=extract.CALL,
    terms=tuple(catalog.UNSAFE_CODE_EXECUTION_FUNCTIONS),
    condition=lambda: F.lit(True),
    message=lambda: unsafe_function_message(F.col("qualifier"), F.col("name")),
)
COMMAND_INJECTION = TermRule(
    id=catalog.GEN003,
    name="Potential Command Injection",
    description="User-controlled command execution detected.",
    recommendation="Avoid passing user input directly to command execution APIs.",
    severity="CRITICAL",
    item=extract.CALL,
    terms=tuple(catalog.COMMAND_EXECUTION_FUNCTIONS),
    # At least one argument, and not all of them strings (X-03, X-04, A-04 on the counts).
    condition=lambda: F.col("n_strings") < F.col("n_args"),
    message=lambda: F.lit("Potential command injection detected."),
)

DEFAULT_RULES: tuple[Rule, ...] = (
    HARDCODED_CREDENTIALS,
    UNSAFE_CODE_EXECUTION,
    COMMAND_INJECTION,
)


@dataclass(frozen=True)
class RuleSet:
    """An ordered, immutable set of rules. The order decides between findings at one place."""

    rules: tuple[Rule, ...] = field(default=DEFAULT_RULES)

    def register(self, rule: Rule) -> RuleSet:
        if any(rule is known for known in self.rules):
            raise ValueError("The rule is registered already.")
        return RuleSet((*self.rules, rule))

    def unregister(self, rule: Rule) -> RuleSet:
        if not any(rule is known for known in self.rules):
            raise ValueError("The rule is not registered.")
        return RuleSet(tuple(known for known in self.rules if known is not rule))

    def table(self, spark: SparkSession) -> DataFrame:
        """The rules as a dimension table."""
        rows = [
            (n, rule.id, rule.name, rule.description, rule.recommendation, rule.severity)
            for n, rule in enumerate(self.rules, start=1)
        ]
        return spark.createDataFrame(
            rows,
            "rule_ordinal int, rule_id string, name string, description string, "
            "recommendation string, severity string",
        )

    def analyse(self, units: DataFrame) -> DataFrame:
        """Findings of all rules, duplicates kept, with the columns that carry their order."""
        spark = units.sparkSession
        ordinals = {id(rule): n for n, rule in enumerate(self.rules, start=1)}
        term_rules = [rule for rule in self.rules if isinstance(rule, TermRule)]
        context = Context(units)
        parts = []
        for rule in self.rules:
            if isinstance(rule, FunctionRule):
                found = rule.analyse(context).select(*FINDING_COLUMNS)
                parts.append(
                    found.withColumns(
                        {
                            "rule_ordinal": F.lit(ordinals[id(rule)]),
                            "item_pos": F.lit(0).cast("bigint"),
                        }
                    )
                )
        if term_rules:
            # Rows that a function rule had written hold the items of the term rules too.
            facts = vars(context).get("facts")
            parts.insert(0, _term_findings(spark, units, term_rules, ordinals, facts))
        empty = spark.createDataFrame([], FINDINGS + ", rule_ordinal int, item_pos bigint")
        return reduce(DataFrame.unionByName, parts) if parts else empty


def candidate_units(units: DataFrame, rules: list[TermRule]) -> DataFrame:
    """Units in whose text the names of at least one rule appear as they must for a finding.

    A called name is a whole identifier with a bracket behind it, an assigned one a whole identifier
    with a sign of assignment, a type or an index behind it; only blanks, comments and line
    continuations can stand between. Leaving out the other units changes no finding and saves their
    shuffle and their tokens.
    """
    content = F.col("content")
    gap = r"(?:\s|\\|#[^\n]*+|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?)*+"

    def pattern(rule: TermRule) -> str:
        names = "|".join(sorted({f"\\Q{name}\\E" for _, name in rule.terms}))
        follows = r"(?:\?\.\s*+)?\(" if rule.item == extract.CALL else r"[^\s\p{L}\p{N}.,;)(]"
        fold = "(?iu)" if rule.fold_case else ""
        return rf"{fold}(?<![\p{{L}}\p{{N}}_$])(?:{names})(?![\p{{L}}\p{{N}}_$]){gap}{follows}"

    wanted = F.lit(False)
    for rule in rules:
        found = content.rlike(pattern(rule))
        wanted = wanted | (found if rule.item == extract.CALL else content.contains("=") & found)
    return units.filter(wanted)


def _terms(spark: SparkSession, rules: list[TermRule], ordinals: dict[int, int]) -> DataFrame:
    """One row per rule and name, with all its qualifiers, so that an item meets it once."""
    rows = []
    for rule in rules:
        by_name: dict[str, set[str | None]] = {}
        for qualifier, name in rule.terms:
            by_name.setdefault(name, set()).add(qualifier)
        rows += [
            (
                ordinals[id(rule)], rule.item, name.lower(), name, rule.fold_case, None in qualifiers,
                sorted(q for q in qualifiers if q is not None),
                rule.id, rule.name, rule.recommendation, rule.severity,
            )
            for name, qualifiers in by_name.items()
        ]
    return spark.createDataFrame(
        rows,
        "rule_ordinal int, term_item string, term_key string, term_name string, "
        "fold_case boolean, any_qualifier boolean, "
        "qualifiers array<string>, vulnerability_rule_id string, vulnerability_rule_name string, "
        "recommendation string, severity string",
    )


def _term_findings(
    spark: SparkSession, units: DataFrame, rules: list[TermRule], ordinals: dict[int, int], facts: DataFrame | None
) -> DataFrame:
    """Findings of term rules. `facts` are the rows of `extract.facts` for all units, if there are such."""

    def matched(items: DataFrame) -> DataFrame:
        return items.withColumn("key", F.lower("name")).join(
            # A row for each name of the rules: without adaptive execution, as in streams, items would be dealt by name.
            F.broadcast(_terms(spark, rules, ordinals)),
            (F.col("item") == F.col("term_item"))
            & (F.col("key") == F.col("term_key"))
            & (F.col("fold_case") | (F.col("name") == F.col("term_name"))),
        )

    if facts is not None:
        found = matched(facts)
    else:
        candidates = candidate_units(units, rules)
        # By name first: nearly all items drop out before any text is fetched for a qualifier.
        items = matched(extract.items(extract.with_inner_code(candidates)))
        found = extract.placed(extract.with_qualifier(items, candidates, F.lit(True)))
    # One flat choice each: expressions don't get deeper with the number of rules.
    condition = message = F
    for rule in rules:
        here = F.col("rule_ordinal") == ordinals[id(rule)]
        condition, message = condition.when(here, rule.condition()), message.when(here, rule.message())
    return (
        found.filter(F.col("any_qualifier") | F.array_contains("qualifiers", F.col("qualifier")))
        .filter(condition)
        .select(
            "vulnerability_rule_id",
            "vulnerability_rule_name",
            message.alias("description"),
            "recommendation",
            "severity",
            F.col("path").alias("source_file_path"),
            F.col("language").alias("programming_language"),
            F.col("line").alias("line_number"),
            F.col("col").alias("column_number"),
            "rule_ordinal",
            F.col("off").cast("bigint").alias("item_pos"),
        )
    )
