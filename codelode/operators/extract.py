"""Assignments, calls and arguments (E-03 to E-16) from the structured token rows.

One pass over the tokens gives one table of items, each an assignment or a call. `assignments` and
`calls` are selections of it; the rules read it directly, so that a scan tokenises a unit once.

Known limits, all from working on tokens and not on a syntax tree:

* code inside f-strings and `${...}` is read as a piece of its own, so that an assignment in it is found
  as in a statement of its own;
* Java's type arguments are told from comparisons by the capitals of their names: `f(A < B, C > d)` has one argument;
* enum constants with arguments are read like calls;
* damaged code gives what its tokens show; there is no imitation of a parser's error recovery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.catalog import JAVA, PYTHON
from codelode.functions import lexical as lx
from codelode.functions.expressions import strip_quotes
from codelode.functions.literals import let
from codelode.operators.structure import (
    HEAD,
    LINK,
    STRING,
    assigned,
    assigns,
    expression_kind,
    segment_size,
    structure,
    with_maybe_call,
    with_roles,
    with_value_end,
)
from codelode.operators.tokens import (
    after_last_newline,
    by_path,
    in_unit,
    piece_bounds,
    with_inner_code,
    kind_of,
    with_neighbours,
    with_statement,
)

CALL = "CALL"
ASSIGNMENT = "ASSIGNMENT"


def _call() -> list[Column]:
    """What is known of a call."""
    callee, chain = F.col("callee"), F.col("chain")
    # Type arguments in front of a name are no part of it.
    token = F.when(
        callee["name_end"].isNull(),
        F.when(callee["tok"].contains("<"), F.regexp_replace(callee["tok"], r"<[\s\S]*>\s*", "")).otherwise(callee["tok"]),
    )
    name = F.ltrim(F.substring_index(token, ".", -1), F.lit(" \t\n\r\f\x0b\\"))
    dotted = F.when(token.contains("."), F.regexp_replace(token, r"\??\.\s*[^.]*$", ""))
    # Java takes the place of the name, which may stand on a later line than its dot; the others
    # take the place of the whole callee.
    own = F.col("language") == JAVA
    own_line = callee["line"] + callee["newlines"]
    own_col = F.when(callee["newlines"] > 0, after_last_newline(callee["tok"]) + 1).otherwise(
        callee["col"] + F.octet_length(callee["tok"])
    ) - F.octet_length(name)
    return [
        name.alias("name"),
        F.when(own, own_line).otherwise(chain["line"]).cast("int").alias("line"),
        F.when(own, own_col).otherwise(chain["col"]).cast("int").alias("col"),
        chain["byte_off"].alias("chain_off"),
        callee["member_off"].alias("member_off"),
        callee["name_end"].alias("name_end"),
        F.when(dotted != "", F.replace(dotted, F.lit("?."), F.lit("."))).alias("dotted"),
    ]


def _own_names() -> list[Column]:
    """Where the chain of a call begins, and the stretch of the text with its own names."""
    chain, is_call = F.col("chain"), F.col("is_call")
    begin = F.coalesce(F.when(F.col("ended.pos") >= chain["pos"], F.col("ended.end")), chain["byte_off"])
    return [
        F.when(is_call, chain["pos"]).alias("chain_pos"),
        F.when(is_call, begin).alias("own_begin"),
        F.when(is_call, F.col("gap_off")).alias("own_end"),
    ]


def _segment() -> Column:
    """The arguments themselves (E-10). `begin` and `end` are bytes, for those that need text."""
    size = segment_size()
    kind = expression_kind(size == 1, "n1")
    token = F.col("n1.tok")

    def located(comment: Column) -> Column:
        none = F.lit(None).cast("bigint")
        return F.struct(
            *(comment[f].alias(f) for f in ("kind", "text", "line", "col")),
            none.alias("begin"),
            none.alias("end"),
        )

    expression = F.struct(
        kind.alias("kind"),
        F.when(kind == STRING, strip_quotes(token)).when(size == 1, token).alias("text"),
        F.col("n1.line").alias("line"),
        F.col("n1.col").alias("col"),
        F.when(size > 1, F.col("n1.byte_off")).alias("begin"),
        F.when(size > 1, F.col("delim.gap_off")).alias("end"),
    )
    none = F.array().cast("array<struct<kind:string,text:string,line:int,col:int>>")
    leading = F.transform(F.coalesce("n1.comments", none), located)
    trailing = F.transform(F.coalesce("delim.comments", none), located)
    return F.when(size == 0, leading).otherwise(
        F.concat(leading, F.array(expression), trailing)
    )


def _parts(units: DataFrame) -> DataFrame:
    """Assignments, calls, and the commas between the arguments of calls."""
    rows = with_statement(with_roles(with_neighbours(units)), LINK, HEAD)
    return structure(with_maybe_call(with_value_end(rows)))


def _item_columns() -> list[Column]:
    assignment, call = F.col("assignment"), F.col("call")
    return [
        F.when(F.col("is_call"), F.lit(CALL)).otherwise(F.lit(ASSIGNMENT)).alias("item"),
        F.coalesce(call["name"], assignment["target"]["tok"]).alias("name"),
        F.coalesce(call["line"], assignment["target"]["line"]).alias("line"),
        F.coalesce(call["col"], assignment["target"]["col"]).alias("col"),
        call["chain_off"].alias("chain_off"),
        call["member_off"].alias("member_off"),
        call["name_end"].alias("name_end"),
        *(F.col(name) for name in ("chain_pos", "kept", "own_begin", "own_end")),
        call["dotted"].alias("dotted"),
        _value().alias("value"),
    ]


def _value() -> Column:
    """The value of an assignment."""
    assignment = F.col("assignment")
    value = F.struct(
        *(assignment[name].alias(name) for name in ("kind", "text")),
        *(assignment[f"value_{name}"].alias(name) for name in ("line", "col")),
        assignment["begin"].alias("begin"),
        F.col("stop_end").alias("end"),
    )
    return F.when(assignment.isNotNull(), value)


def placed(found: DataFrame) -> DataFrame:
    """Rows of pieces as rows of the units that hold them; `off` is the byte that orders them."""
    line, col, off = in_unit(F.col("line"), F.col("col"), F.coalesce("chain_off", F.col("pos").cast("bigint")))
    return found.withColumns({"line": line, "col": col, "off": off})


def _placed_expression(x: Column) -> Column:
    line, col, _ = in_unit(x["line"], x["col"], x["line"])
    return F.struct(x["kind"].alias("kind"), x["text"].alias("text"), line.alias("line"), col.alias("col"))


def _judged(units: DataFrame) -> DataFrame:
    """What is an assignment (`is_assignment`) or a call (`is_call`), one row each, with the groups it stands in.

    `n_args` and `n_strings` count the arguments of a call. They are differences of running sums
    between the brackets of the call, so no grouping and no further sort is needed.
    """
    is_closer = F.col("kind") == lx.CLOSE
    rows = _parts(units).withColumn("sums_here", F.when(is_closer, F.struct("args_before", "strings_before")))
    sums = F.expr(
        "lead(sums_here, 1) IGNORE NULLS OVER (PARTITION BY path, piece, lvl ORDER BY pos)"
    )
    # Calls are judged before the last windows, which then have few rows.
    rows = (
        rows.filter(is_closer | F.col("is_call") | F.col("sign").isNotNull())
        .withColumn("sums", sums)
        .withColumn("is_assignment", F.col("sign").isNotNull() & assigns())
        .filter(F.col("is_call") | F.col("is_assignment"))
    )

    def of_call(value: Column) -> Column:
        return F.when(F.col("is_call"), value)

    return rows.select(
        "path",
        "piece",
        "language",
        "lvl",
        "pos",
        "is_call",
        "is_assignment",
        *(of_call(F.col(name)).alias(name) for name in ("callee", "chain", "kept")),
        *_own_names(),
        F.when(F.col("is_assignment"), assigned()).alias("assignment"),
        "stop_end",
        of_call(F.col("sums.args_before") - F.col("args_before")).alias("n_args"),
        of_call(F.col("sums.strings_before") - F.col("strings_before")).alias("n_strings"),
    )


def items(units: DataFrame) -> DataFrame:
    """Assignments and calls of all units and of the pieces of code in their literals, one row each.

    Places are those in the piece; `placed` turns them into places in the unit. The facts of an item are made
    behind the last window, as its generated code would be too long with them in front.
    """
    call = F.when(F.col("is_call"), F.struct(*_call()))
    return (
        with_earlier_names(_judged(units))
        .withColumn("call", call)
        .select("path", "piece", "language", "lvl", "pos", *_item_columns(), "n_args", "n_strings", "earlier")
    )


def _with_arguments(rows: DataFrame) -> DataFrame:
    """Calls with their argument array, and assignments, of the rows of `_parts` that are of either.

    Grouping is by `path` and bracket or sign, so it needs no shuffle.
    """
    part = F.struct("pos", _segment().alias("segment"))
    facts = F.struct("is_call", "callee", "chain", "kept", "ended", "gap_off")
    signs = ["assignment", "stop_end"] if "assignment" in rows.columns else []
    place = F.when(F.col("in_call"), F.col("opener.pos")).otherwise(F.col("pos"))
    found = F.col("facts").isNotNull()
    return (
        rows.groupBy("path", "piece", "language", place.alias("item_pos"))
        .agg(
            F.first(F.when(F.col("is_call"), facts), ignorenulls=True).alias("facts"),
            F.first("lvl").alias("lvl"),
            F.flatten(
                F.transform(F.array_sort(F.collect_list(F.when(F.col("in_call"), part))), lambda s: s["segment"])
            ).alias("arguments"),
            *(F.first(name, ignorenulls=True).alias(name) for name in signs),
        )
        .filter(found | F.col("assignment").isNotNull() if signs else found)
        .select("path", "piece", "language", "lvl", F.col("item_pos").alias("pos"), "facts.*", "arguments", *signs)
    )


def _slice(content: Column, begin: Column, end: Column) -> Column:
    """E-02: bytes of the unit from `begin` to `end`, counted in the piece, as text."""
    start, _ = piece_bounds()
    return F.substring(content, (start + begin + 1).cast("int"), (end - begin).cast("int")).cast("string")


def _with_bytes(found: DataFrame, units: DataFrame, needed: Column) -> DataFrame:
    """Join the bytes of the unit to the rows where `needed` holds, as `unit_bytes`.

    The rows are partitioned by `path` already and the units come from the same exchange, so the
    join adds no shuffle. It looks at language too, which makes both readers of the exchange
    ask for the same columns; otherwise the text would be shuffled once for each. For the same reason
    it does so by an expression that lets no filter pass below the exchange.
    """
    known = (F.spark_partition_id() >= 0) & F.col("language").isNotNull()
    texts = by_path(units).select(
        F.col("path").alias("unit_path"), F.when(known, F.col("content").cast("binary")).alias("unit_bytes")
    )
    same = (F.col("path") == F.col("unit_path")) & F.col("needs_bytes")
    return (
        found.withColumn("needs_bytes", needed)
        .join(texts, same, "left")
        .drop("needs_bytes", "unit_path")
    )


def with_earlier_names(found: DataFrame) -> DataFrame:
    """Add `earlier` to calls in Java: where the names of the calls before it in its chain stand. Only Java leaves
    brackets out of a qualifier, so only there it has names of several stretches.

    To be called when all sorts are done, as the stretches of a long chain are many.
    """
    here = F.when(
        (F.col("language") == JAVA) & F.col("own_begin").isNotNull(),
        F.struct("pos", F.col("own_begin").alias("begin"), F.col("own_end").alias("end")),
    )
    in_chain = Window.partitionBy("path", "piece", "lvl", "chain_pos").orderBy("pos")
    before = F.collect_list(here).over(in_chain.rowsBetween(Window.unboundedPreceding, -1))
    kept = F.coalesce("kept.pos", F.lit(-1))
    return (
        found.withColumn("before", before)
        .withColumn("earlier", F.filter("before", lambda n: n["pos"] > kept))
        .drop("before")
    )


def _names(language: Column, stretch: Column) -> Column:
    """Names with their dots, without comments, type arguments and blanks. No string can stand between them."""

    def cleaned(text: Column) -> Column:
        python = F.regexp_replace(text, r"#[^\n]*+", "")
        slash = F.regexp_replace(text, r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/", "")
        java = F.when(slash.contains("<"), F.regexp_replace(slash, r"<[\s\S]*?>(?=\s*[\p{L}_$])", "")).otherwise(slash)
        plain = F.when(language == PYTHON, python).when(language == JAVA, java).otherwise(slash)
        joined = F.replace(F.regexp_replace(plain, r"[\s\\]+", ""), F.lit("?."), F.lit("."))
        # Most stretches are bare names; a long chain has many.
        return F.when(text.rlike(r"[^\p{L}\p{N}_$.]"), joined).otherwise(text)

    return let(stretch, cleaned)


def _qualifier() -> Column:
    """E-13 to E-15: the text of the chain up to the last bracket that counts, and the names behind it."""
    language, begin, member = F.col("language"), F.col("chain_off"), F.col("member_off")
    kept_end = F.when(F.col("kept.pos") >= F.col("chain_pos"), F.col("kept.end")).otherwise(begin)

    # The bytes are bound once: each look at the column would copy them.
    def joined(raw: Column) -> Column:
        parts = F.concat(
            F.array(_slice(raw, begin, kept_end)),
            F.transform("earlier", lambda n: _names(language, _slice(raw, n["begin"], n["end"]))),
            F.array(_names(language, _slice(raw, F.col("own_begin"), member)), _names(language, F.coalesce("dotted", F.lit("")))),
        )
        return let(F.regexp_replace(F.array_join(parts, ""), r"\A\.", ""), lambda found: F.when(found != "", found))

    return F.when(member.isNotNull(), let(F.col("unit_bytes"), joined)).otherwise(F.col("dotted"))


def with_qualifier(found: DataFrame, units: DataFrame, only: Column) -> DataFrame:
    """Add `qualifier` to items. Chains with brackets need their text; `only` says for which."""
    needed = F.col("member_off").isNotNull() & only
    return (
        _with_bytes(found, units, needed)
        .withColumn("qualifier", _qualifier())
        .drop("unit_bytes")
    )


def assignments(units: DataFrame) -> DataFrame:
    """Assignments to plain variables (E-03 to E-06), one row each, in the order of the source."""
    rows = placed(
        _judged(with_inner_code(units)).filter("is_assignment").select(
            "path", "piece", "language", "pos",
            F.col("assignment.target.tok").alias("name"), "assignment.target.line", "assignment.target.col",
            F.lit(None).cast("bigint").alias("chain_off"),
            _value().alias("value"),
        )
    )
    # Numbered before the text joins, so that no sort carries the text of a unit.
    order = Window.partitionBy("path").orderBy("line", "col", "pos")
    rows = rows.withColumn("ordinal", F.row_number().over(order))
    rows = _with_bytes(rows, units, F.col("value.text").isNull())
    value = F.col("value")
    start, end = piece_bounds()
    to_end = F.coalesce(value["end"], (F.coalesce(end, F.octet_length("unit_bytes")) - start).cast("bigint"))
    text = F.coalesce(value["text"], F.rtrim(_slice(F.col("unit_bytes"), value["begin"], to_end)))
    found = F.struct(value["kind"].alias("kind"), text.alias("text"), value["line"].alias("line"), value["col"].alias("col"))
    return rows.select(
        "path", "language", "ordinal", "line", "col", F.col("name").alias("variable"),
        _placed_expression(found).alias("value"),
    )


def _needs_text() -> Column:
    """Whether a call has a name or an argument that only the text of the unit can give."""
    return F.coalesce("member_off", "name_end").isNotNull() | F.exists("arguments", lambda a: a["text"].isNull())


def _argument_texts() -> Column:
    """The arguments with the texts that are longer than a token, in their places in the unit."""

    def with_text(raw: Column) -> Column:
        return F.transform(
            "arguments",
            lambda a: F.struct(
                a["kind"].alias("kind"),
                F.coalesce(a["text"], _slice(raw, a["begin"], a["end"])).alias("text"),
                a["line"].alias("line"),
                a["col"].alias("col"),
            ),
        )

    return F.transform(let(F.col("unit_bytes"), with_text), _placed_expression)


def _function_name() -> Column:
    return F.coalesce(F.col("name"), _slice(F.col("unit_bytes"), F.col("chain_off"), F.col("name_end")))


def calls(units: DataFrame) -> DataFrame:
    """Function calls with their arguments (E-07 to E-15), one row each, in source order.

    A call comes before the calls in its arguments. The argument array of a call can be no longer
    than the text of the unit that holds it.
    """
    order = Window.partitionBy("path").orderBy("off", "piece", "pos")
    rows = _with_arguments(_parts(with_inner_code(units)).filter("in_call"))
    _, _, off = in_unit(F.lit(1), F.lit(1), F.coalesce("chain.byte_off", F.col("pos").cast("bigint")))
    rows = rows.withColumn("off", off).withColumn("ordinal", F.row_number().over(order)).withColumns(
        {name: column for name, column in zip(("chain_pos", "own_begin", "own_end"), _own_names(), strict=True)}
    )
    rows = placed(
        with_earlier_names(rows).select(
            "path", "piece", "language", "lvl", "pos", "ordinal", "chain_pos", "kept", "own_begin", "own_end", "earlier",
            *_call(), "arguments",
        )
    )
    rows = _with_bytes(rows, units, _needs_text())
    return rows.withColumn("qualifier", _qualifier()).select(
        "path", "language", "ordinal", "line", "col", "qualifier",
        _function_name().alias("function_name"),
        _argument_texts().alias("arguments"),
    )


def facts(units: DataFrame) -> DataFrame:
    """All that is known of assignments and calls, one row each, from one pass over the tokens.

    Written out once it serves all rules of a set: `calls_of` and `assignments_of` give what `calls` and `assignments` do, and
    the rows themselves are items with their qualifiers.
    """
    rows = _parts(with_inner_code(units)).withColumn("assigns", F.col("sign").isNotNull() & assigns())
    rows = _with_arguments(
        rows.filter(F.col("in_call") | F.col("assigns")).withColumns(
            {name: F.when(F.col("assigns"), column) for name, column in (("assignment", assigned()), ("stop_end", F.col("stop_end")))}
        )
    )
    is_call, target, value = F.col("callee").isNotNull(), F.col("assignment.target"), F.col("value")
    rows = rows.withColumns(dict(zip(("chain_pos", "own_begin", "own_end"), _own_names(), strict=True)))
    rows = with_earlier_names(rows).select(
        "path", "piece", "language", "pos", "chain_pos", "kept", "own_begin", "own_end", "earlier", "arguments", *_call(),
        F.when(is_call, F.lit(CALL)).otherwise(F.lit(ASSIGNMENT)).alias("item"),
        target.alias("target"),
        _value().alias("value"),
    ).withColumns({name: F.coalesce(name, f"target.{field}") for name, field in (("name", "tok"), ("line", "line"), ("col", "col"))})
    rows = _with_bytes(placed(rows), units, _needs_text() | (value.isNotNull() & value["text"].isNull()))
    start, end = piece_bounds()
    to_end = F.coalesce(value["end"], (F.coalesce(end, F.octet_length("unit_bytes")) - start).cast("bigint"))
    text = F.coalesce(value["text"], F.rtrim(_slice(F.col("unit_bytes"), value["begin"], to_end)))
    called = F.col("item") == CALL
    return rows.withColumn("qualifier", _qualifier()).select(
        "path", "piece", "language", "pos", "item", "name", "line", "col", "off", "qualifier", "value",
        F.when(called, F.size("arguments").cast("bigint")).alias("n_args"),
        F.when(called, F.size(F.filter("arguments", lambda a: a["kind"] == STRING)).cast("bigint")).alias("n_strings"),
        F.when(called, _function_name()).alias("function_name"),
        F.when(called, _argument_texts()).alias("arguments"),
        F.when(~called, text).alias("value_text"),
    )


def calls_of(found: DataFrame) -> DataFrame:
    """What `calls` gives, from the rows of `facts`."""
    order = Window.partitionBy("path").orderBy("off", "piece", "pos")
    return found.filter(F.col("item") == CALL).withColumn("ordinal", F.row_number().over(order)).select(
        "path", "language", "ordinal", "line", "col", "qualifier", "function_name", "arguments"
    )


def assignments_of(found: DataFrame) -> DataFrame:
    """What `assignments` gives, from the rows of `facts`."""
    order = Window.partitionBy("path").orderBy("line", "col", "pos")
    value = F.col("value")
    full = F.struct(value["kind"].alias("kind"), F.col("value_text").alias("text"), value["line"].alias("line"), value["col"].alias("col"))
    return found.filter(F.col("item") == ASSIGNMENT).withColumn("ordinal", F.row_number().over(order)).select(
        "path", "language", "ordinal", "line", "col", F.col("name").alias("variable"), _placed_expression(full).alias("value")
    )


def call_arguments(units: DataFrame) -> DataFrame:
    """Arguments as rows (E-10, E-11): one row per argument of every call."""
    return calls(units).select(
        "path",
        "language",
        "ordinal",
        "qualifier",
        "function_name",
        F.posexplode("arguments").alias("argument_no", "argument"),
    ).select(
        "path", "language", "ordinal", "qualifier", "function_name", "argument_no",
        "argument.kind", "argument.text", "argument.line", "argument.col",
    )
