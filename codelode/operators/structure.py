"""What a token row can be by its neighbours, and the bracket groups and chains it stands in.

Tokens are arranged in levels. A bracket and the commas directly inside it share a level, so in
`(path, lvl)` order a bracket group is a run of rows and the end of an argument is simply the next
row. The names that a bracket or a dot follows are on the level of that bracket too, so a chain
such as `a.b(x).c(y)` is a run of rows on one level with everything inside its brackets left out.

All windows are by `path` and more, so the partitioning by `path` serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.catalog import JAVA, JAVASCRIPT, PYTHON
from codelode.functions import lexical as lx
from codelode.functions.expressions import strip_quotes
from codelode.operators.tokens import breaks_of, kind_of, word_of

STRING = "STRING"
VARIABLE = "VARIABLE"
UNKNOWN = "UNKNOWN"

# Roles of a row. A token can have two: it can begin a chain and end the value before it.
LINK = 1  # part of a call chain
GROUP = 2  # bracket, comma, assignment sign, Python `for`
STOP = 4  # ends the value of an assignment
HEAD = 8  # may begin a statement in Python, or has the colon before one, and is neither GROUP nor STOP


def no(condition: Column) -> Column:
    """True unless the condition holds; an unknown condition does not hold."""
    return ~F.coalesce(condition, F.lit(False))


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _is(near: str, *words: str) -> Column:
    """Whether a token nearby is one of the words."""
    return word_of(near).isin(lx.words(*words))


def expression_kind(single: Column, token: str) -> Column:
    """E-11: one token alone can be a string or a variable, all else is unknown."""
    return (
        F.when(single & (kind_of(token) == lx.STRING), F.lit(STRING))
        .when(single & (kind_of(token) == lx.NAME), F.lit(VARIABLE))
        .otherwise(F.lit(UNKNOWN))
    )


def with_maybe_call(rows: DataFrame) -> DataFrame:
    """Add whether a bracket can open the arguments of a call (E-07 to E-09)."""
    language = F.col("language")
    named = lx.is_name(kind_of("p1"))
    # A declaration has a bare name; `a.f(` and `).f(` can only be calls.
    bare = kind_of("p1") == lx.NAME
    single = lx.is_single_name(kind_of("p1"))
    python = named & ~((F.col("depth") == 0) & F.col("breaks")) & no(_is("p2", "def", "class"))
    typed = (
        (
            (lx.is_single_name(kind_of("p2")) | (kind_of("p2") == lx.KEYWORD))
            & ~_is("p2", *lx.JAVA_BEFORE_CALL)
        )
        | _is("p2", "]", ">")
    )
    java = named & no(single & _is("p2", "new", "@")) & no(bare & typed)
    javascript = (named | _is("p1", "super", "import")) & no(
        single & (_is("p2", "new", "function") | (_is("p2", "*") & _is("p3", "function")))
    )
    # Any expression can be called but in Java: `f()(x)`, `a[0](x)`, tag`x`(y).
    ended = _is("p1", ")", "]")
    python = python | (ended & ~((F.col("depth") == 0) & F.col("breaks")))
    javascript = javascript | ended | (kind_of("p1") == lx.OTHER_QUOTED)
    opens = (F.col("kind") == lx.OPEN) & (F.right("here.tok", F.lit(1)) == "(")
    found = yes(opens & lx.by_language(language, python, java, javascript))
    return rows.withColumn("maybe_call", found)


def _callee() -> Column:
    """What is known of the callee before a bracket that may open the arguments of a call.

    The token after the closing bracket has a say too: `by_brace` tells that the call is a declaration
    after all if that token is a brace.
    """
    language = F.col("language")
    bare = kind_of("p1") == lx.NAME
    extended = (language == JAVASCRIPT) & _is("p2", "extends")
    unnamed = (kind_of("p1") == lx.CLOSE) | (kind_of("p1") == lx.OTHER_QUOTED)
    return F.when(
        F.col("maybe_call"),
        F.struct(
            F.col("p1.tok").alias("tok"),
            F.col("p1.line").alias("line"),
            F.col("p1.col").alias("col"),
            F.col("p1.tok_newlines").alias("newlines"),
            # A name that begins with a dot has a chain before it, which only the text can give.
            F.when(kind_of("p1") == lx.MEMBER, F.col("p1.byte_off")).alias("member_off"),
            # No name but an expression, which ends there.
            F.when(unnamed, F.col("gap_off")).alias("name_end"),
            ((bare | unnamed) & (language != PYTHON) & no(extended)).alias("by_brace"),
        ),
    )


def with_value_end(rows: DataFrame) -> DataFrame:
    """Add whether a value follows a sign, and whether it is a single token."""
    language = F.col("language")
    is_sign = F.col("kind").isin(lx.EQUALS, lx.COMPOUND)
    at_end = kind_of("n1").isNull() | (kind_of("n1") == lx.END)
    closing = _is("n1", ";", ")", "]", "}") | (kind_of("n1") == lx.COMMA)
    no_value = at_end | F.when(language == PYTHON, breaks_of("n1") | _is("n1", ";")).otherwise(closing)
    fresh = breaks_of("n2") & (
        lx.begins_operand(kind_of("n2"))
        | ((kind_of("n2") == lx.KEYWORD) & ~_is("n2", "in", "instanceof"))
        | _is("n2", "{", "@", "++", "--", "!", "~", "...")
    )
    single = (
        kind_of("n2").isNull()
        | (kind_of("n2") == lx.END)
        | _is("n2", ";")
        | F.when(language == PYTHON, breaks_of("n2")).otherwise(
            kind_of("n2").isin(lx.COMMA, lx.CLOSE) | ((language == JAVASCRIPT) & fresh)
        )
    )
    return rows.withColumns(
        {
            "has_value": F.when(is_sign, no(no_value)),
            "is_single": F.when(is_sign, yes(single)),
        }
    )


def _sign() -> Column:
    """What a sign assigns if the statement allows it (E-03 to E-06); only Python's has a say."""
    language = F.col("language")
    bare = kind_of("p1") == lx.NAME
    is_equals = F.col("kind") == lx.EQUALS
    # int a[] = ...
    array_name = yes(_is("p1", "]") & _is("p2", "[") & (kind_of("p3") == lx.NAME))
    attribute = kind_of("p2").isin(lx.NAME, lx.STRING, lx.NUMBER) & ~breaks_of("p1")
    in_python = (language == PYTHON) & is_equals & (F.col("depth") == 0)
    p1, p3 = (F.struct(*(F.col(f"{near}.{f}").alias(f) for f in ("tok", "line", "col"))) for near in ("p1", "p3"))
    target = (
        F.when(language == PYTHON, F.when(in_python & bare, p1))
        .when(language == JAVA, F.when(bare, p1).when(array_name, p3))
        .when(is_equals & bare & no(attribute), p1)
    )
    value_kind, token = expression_kind(F.col("is_single"), "n1"), F.col("n1.tok")
    sign = F.struct(
        target.alias("target"),
        in_python.alias("in_python"),
        F.col("last_equals"),
        F.col("last_colon"),
        value_kind.alias("kind"),
        F.when(value_kind == STRING, strip_quotes(token)).when(value_kind == VARIABLE, token).alias("text"),
        F.col("n1.line").alias("value_line"),
        F.col("n1.col").alias("value_col"),
        F.col("n1.byte_off").alias("begin"),
    )
    return F.when(F.col("has_value"), sign)


def _annotated() -> Column:
    """name: type = value"""
    sign, line_first = F.col("sign"), F.col("line_first")
    return _first_equals() & (sign["last_colon"] == line_first["pos"] + 1) & (line_first["kind"] == lx.NAME)


def _first_equals() -> Column:
    sign = F.col("sign")
    return sign["last_equals"].isNull() | (sign["last_equals"] < F.col("line_first.pos"))


def assigns() -> Column:
    """Whether a sign assigns to a plain variable."""
    sign, pos = F.col("sign"), F.col("pos")
    in_statement = F.when(_first_equals(), pos == F.col("line_first.pos") + 1).otherwise(sign["last_equals"] == pos - 2)
    return F.when(sign["in_python"], yes(_annotated()) | (sign["target"].isNotNull() & yes(in_statement))).otherwise(
        sign["target"].isNotNull()
    )


def assigned() -> Column:
    """The variable and the value, of a sign that assigns."""
    sign = F.col("sign")
    first = F.struct(*(F.col(f"line_first.{f}").alias(f) for f in ("tok", "line", "col")))
    target = F.when(sign["in_python"] & yes(_annotated()), first).otherwise(sign["target"])
    return F.struct(
        target.alias("target"), *(sign[f].alias(f) for f in ("kind", "text", "value_line", "value_col", "begin"))
    )


def with_roles(rows: DataFrame) -> DataFrame:
    """Add which parts a row plays in calls and values."""
    language, kind, depth = F.col("language"), F.col("kind"), F.col("depth")
    is_python, is_javascript = language == PYTHON, language == JAVASCRIPT
    leads_on = (
        (kind_of("n1") == lx.MEMBER)
        | ((kind_of("n1") == lx.OPEN) & ~_is("n1", "{"))
        # Strings that stand side by side are one operand in Python.
        | (is_python & (kind == lx.STRING) & (kind_of("n1") == lx.STRING))
    )
    is_link = (
        kind.isin(lx.OPEN, lx.MEMBER)
        | ((kind <= lx.OTHER_QUOTED) & yes(leads_on))
        | ((F.col("word") == lx.word("new")) & ~is_python)
    )
    is_for = is_python & (F.col("word") == lx.word("for")) & (depth > 0)
    is_group = kind.isin(lx.CLOSE, lx.EQUALS, lx.COMPOUND, lx.COMMA) | is_for
    # A line break ends a JavaScript statement unless one of the tokens at it carries it on.
    fresh = (
        lx.begins_operand(kind)
        | ((kind == lx.KEYWORD) & ~F.col("word").isin(lx.words("in", "instanceof")))
        | F.col("word").isin(lx.words("{", "@", "++", "--", "!", "~", "..."))
    )
    ends_operand = lx.ends_operand(kind_of("p1")) | _is("p1", "++", "--")
    is_stop = (
        (F.col("word") == lx.word(";"))
        | (kind == lx.END)
        | (is_python & (depth == 0) & F.col("breaks"))
        | (is_javascript & F.col("breaks") & fresh & yes(ends_operand))
    )
    # A sum and no array that is filtered: Spark generates no code for functions of higher order.
    roles = (
        yes(is_link).cast("int") * LINK + yes(is_group).cast("int") * GROUP + yes(is_stop & ~is_group).cast("int") * STOP
    )
    return rows.withColumn("roles", roles)


def _placed(rows: DataFrame) -> DataFrame:
    """Each row once for every level it stands on, with what callees and signs tell by themselves."""
    sets = [[role for role in (LINK, GROUP, STOP, HEAD) if roles & role] for roles in range(1, LINK + HEAD + 1)]
    each = F.element_at(F.array(*(F.array(*map(F.lit, roles)) for roles in sets)), F.col("roles"))
    lvl = F.col("depth") + (F.col("role") == LINK).cast("int")
    # A sign and an opening bracket stand on one level each.
    rows = rows.withColumns({"callee": _callee(), "sign": _sign()}).drop("last_equals", "p1", "p3", "p3_mark", "has_value", "is_single")
    return rows.withColumn("role", F.explode(each)).withColumn("lvl", lvl).drop("roles")


def _of_tokens(rows: DataFrame) -> DataFrame:
    """What an opening bracket and the start of a statement tell by themselves, sorted for the level windows.

    The sort stands here so that the code of this and of `_marks` is not one method.
    """
    language = F.col("language")
    is_java, is_javascript = language == JAVA, language == JAVASCRIPT
    bracket = F.right("here.tok", F.lit(1))
    round_bracket = bracket == "("
    is_opener = (F.col("role") == LINK) & (F.col("kind") == lx.OPEN)
    # The first colon of a line that begins with a compound word, unless that word is a name: `match: int`.
    line_first = F.col("line_first")
    compound = (
        F.col("colon_pos").isNotNull()
        & line_first["word"].isin(lx.words(*lx.PYTHON_COMPOUND))
        & (F.col("last_colon").isNull() | (F.col("last_colon") < line_first["pos"]))
        & ~((line_first["kind"] == lx.NAME) & (F.col("pos") == line_first["pos"] + 1))
    )
    on_level = (F.col("role") != LINK) & (language == PYTHON) & (F.col("depth") == 0)
    head = F.struct(
        "pos", "kind", F.col("line_head").isNotNull().alias("begins"),
        *(F.col(f"here.{f}").alias(f) for f in ("tok", "line", "col")),
    )
    # Brackets in which no `=` assigns: annotations, resources, constants of an interface, class
    # fields in JavaScript.
    no_assignment = F.when(
        round_bracket, is_java & (_is("p1", "try") | (_is("p2", "@") & ~_is("p1", "@")))
    ).when(
        bracket == "{",
        F.col("opened_by") == F.when(is_java, lx.word("interface")).otherwise(lx.word("class")),
    )
    no_assignment = no_assignment | (
        is_javascript
        & ~round_bracket
        & (_is("p1", "const", "let", "var", "(", "[") | (kind_of("p1") == lx.COMMA))
    )
    opener = F.struct(
        "pos",
        "maybe_call",
        yes(no_assignment).alias("no_assignment"),
        round_bracket.alias("round"),
        yes(_is("p1", *lx.CONTROL_WORDS)).alias("control"),
    )
    return rows.withColumns(
        {
            "opener_here": F.when(is_opener, opener),
            "compound_here": F.when(on_level & compound, F.col("pos")),
            "head_here": F.when(on_level & (F.col("line_head").isNotNull() | _is("p1", ":")), head),
        }
    ).drop("line_head", "colon_pos", "line_first", "last_colon", "opened_by", "maybe_call").sortWithinPartitions(
        "path", "piece", "lvl", "pos"
    )


def _marks(rows: DataFrame) -> DataFrame:
    """Columns that the level windows look for, and nothing else."""
    language, kind, word = F.col("language"), F.col("kind"), F.col("word")
    is_java, is_javascript = language == JAVA, language == JAVASCRIPT
    bracket = F.right("here.tok", F.lit(1))
    continues = (
        F.when(kind == lx.MEMBER, lx.ends_operand(kind_of("p1")))
        .when(
            kind == lx.OPEN,
            (bracket != "{")
            & (
                (kind_of("p1") <= lx.VALUE)
                | _is("p1", ")", "]")
                | (is_java & _is("p1", ">"))
            ),
        )
        .when(lx.is_single_name(kind), _is("p1", "new"))
        .when(kind == lx.STRING, (kind_of("p1") == lx.STRING) & (language == PYTHON))
    )
    # A line break outside brackets ends a statement in Python.
    continues = continues & ~((language == PYTHON) & (F.col("depth") == 0) & F.col("breaks"))
    next_word = F.coalesce(word_of("n1"), F.lit(0))
    is_closer = kind == lx.CLOSE
    begins_chain = (F.col("role") == LINK) & no(continues)
    is_named = kind.isin(lx.NAME, lx.DOTTED, lx.VALUE)
    in_link = (F.col("role") == LINK) & ~kind.isin(lx.OPEN, lx.MEMBER) & ~(begins_chain & is_named)
    tok_end = F.col("here.byte_off") + F.octet_length("here.tok")
    is_stop = (F.col("role") == STOP) | (
        (language != PYTHON) & (F.col("role") == GROUP) & kind.isin(lx.COMMA, lx.CLOSE)
    )
    return rows.select(
        "path",
        "piece",
        "language",
        "lvl",
        "pos",
        "role",
        "kind",
        "gap_off",
        "callee",
        "sign",
        "compound_here",
        "head_here",
        "n1",
        "n1_mark",
        "opener_here",
        F.when(is_closer, F.struct("pos", next_word.alias("next_word"))).alias("closer_here"),
        F.when(
            is_closer | (kind == lx.COMMA), F.struct("pos", "gap_off", F.col("here.comments").alias("comments"))
        ).alias("delim_here"),
        F.when(
            begins_chain,
            F.struct(
                "pos", *(F.col(f"here.{f}").alias(f) for f in ("byte_off", "line", "col")), is_named.alias("named"),
                # `if (a) (b)` calls nothing.
                (yes(_is("p1", *lx.CONTROL_WORDS)) & is_javascript & (kind == lx.OPEN)).alias("control"),
            ),
        ).alias("chain_here"),
        F.when(is_closer, F.when(is_java & (bracket == ")"), "maybe").otherwise("yes")).when(in_link, "yes").alias("kept"),
        F.when(is_closer | in_link, tok_end).alias("kept_end"),
        F.when(is_stop, F.col("gap_off")).alias("stop_here"),
        F.when((word == lx.word("for")) & (language == PYTHON), F.col("pos")).alias("for_here"),
    )


def _may_assign() -> Column:
    """Whether the bracket around a sign lets it assign."""
    opener, after = F.col("opener"), F.col("closer.next_word")
    parameters = opener["round"] & (
        (after == lx.word("=>")) | ((after == lx.word("{")) & ~opener["control"])
    )
    pattern = ~opener["round"] & (after == lx.word("="))
    javascript = (F.col("language") == JAVASCRIPT) & (parameters | pattern)
    return no(opener["no_assignment"] | javascript)


def _is_call() -> Column:
    """Whether the row calls: the token after its closing bracket allows that."""
    callee, closer, chain = F.col("callee"), F.col("closer"), F.col("chain")
    after = closer["next_word"]
    # f(x for x in y) has no argument list.
    generator = F.col("next_for") < F.col("delim.pos")
    declaration = (callee["by_brace"] & after.isin(lx.words("{", "=>", "throws"))) | (
        callee["name_end"].isNotNull() & chain["control"]
    )
    return callee.isNotNull() & closer["pos"].isNotNull() & no(generator) & no(declaration)


def segment_size() -> Column:
    return F.col("delim.pos") - F.col("pos") - 1


def _segment_counts() -> tuple[Column, Column]:
    """Number of arguments, and of string arguments, up to the next comma or closing bracket.

    A comment next to a comma or bracket counts as an argument of its own.
    """
    size = segment_size()
    leading = F.when(F.col("n1.comments").isNotNull(), F.size("n1.comments")).otherwise(0)
    trailing = F.when(F.col("delim.comments").isNotNull(), F.size("delim.comments")).otherwise(0)
    n_args = F.when(size == 0, leading).otherwise(leading + 1 + trailing)
    n_strings = F.when((size == 1) & (kind_of("n1") == lx.STRING), 1).otherwise(0)
    return n_args, n_strings


def structure(rows: DataFrame) -> DataFrame:
    """Add the groups: `opener` (innermost bracket that holds the row, or the bracket itself),
    `closer` (its closing bracket), `delim` (next comma or closing bracket), `chain` (where the
    chain of the row begins), `kept` (the last token in front of it up to which qualifiers have the text of the chain as it
    stands, in place of its names), `ended` (the last bracket in front of it), `stop_end` (byte at which a value that begins here ends).

    `is_call` tells the brackets of calls; `sign` stays where the bracket around it allows it to assign, and
    `line_first` is the first token of its statement in Python. `in_call` tells the brackets that open arguments and the
    commas between these; `args_before` and `strings_before` are the numbers of arguments, and of strings among them, on
    the level before the row."""

    def following(column: str) -> Column:
        return F.expr(
            f"lead({column}, 1) IGNORE NULLS OVER (PARTITION BY path, piece, lvl ORDER BY pos)"
        )

    upto = (
        Window.partitionBy("path", "piece", "lvl")
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    # Java leaves the arguments of a method call out of the qualifiers behind it, but for a bracket that begins the chain.
    first_closer = F.coalesce(F.col("closed") < F.col("chain.pos"), F.lit(True))
    keeps = (F.col("kept") == "yes") | (~F.col("chain.named") & first_closer)
    is_opener = (F.col("role") == LINK) & F.col("opener.maybe_call") & (F.col("opener.pos") == F.col("pos"))
    is_comma = (F.col("kind") == lx.COMMA) & F.col("opener.maybe_call")
    in_call, zero = F.col("in_call"), F.lit(0)
    n_args, n_strings = _segment_counts()
    return (
        _marks(_of_tokens(_placed(rows)))
        .withColumns(
            {
                "closed": F.last("closer_here.pos", ignorenulls=True).over(before),
                "opener": F.last("opener_here", ignorenulls=True).over(upto),
                "chain": F.last("chain_here", ignorenulls=True).over(upto),
                "closer": following("closer_here"),
                "delim": following("delim_here"),
                "stop_end": following("stop_here"),
                "next_for": following("for_here"),
                # The colon of the last compound statement in Python.
                "last_compound": F.last("compound_here", ignorenulls=True).over(before),
            }
        )
        .withColumns(
            {
                "kept_here": F.when(F.col("kept").isNotNull() & keeps, F.struct("pos", F.col("kept_end").alias("end"))),
                "in_call": yes(is_opener | is_comma),
                "is_call": _is_call(),
                "sign": F.when(_may_assign(), F.col("sign")),
                "head_here": F.when(F.col("head_here.begins") | (F.col("pos") == F.col("last_compound") + 1), F.col("head_here")),
            }
        )
        .withColumns({"args": F.when(in_call, n_args), "strings": F.when(in_call, n_strings)})
        .withColumns(
            {
                "args_before": F.coalesce(F.sum("args").over(before), zero),
                "strings_before": F.coalesce(F.sum("strings").over(before), zero),
                "kept": F.last("kept_here", ignorenulls=True).over(before),
                # The first token of the statement, which may stand behind the colon of a compound one.
                "line_first": F.last("head_here", ignorenulls=True).over(upto),
                "ended": F.last(F.when(F.col("kept").isNotNull(), F.struct("pos", F.col("kept_end").alias("end"))), ignorenulls=True).over(before),
            }
        )
        .drop(
            "opener_here", "closer_here", "delim_here", "chain_here", "stop_here", "for_here", "kept_here", "kept_end",
            "head_here", "compound_here", "last_compound", "closed", "args", "strings",
        )
    )
