"""Token table (E-01, E-02, W-02, W-03).

Layout of the work: the units are hash-partitioned by `path` while they are still one row each, so
the network carries the raw text once. Tokens are made after that exchange; `explode` keeps the
partitioning, and every window and grouping below is by `path` or by `path` plus more columns, so
none of them shuffles again.

A unit is one cell of a table, which Spark limits to 2 GiB. That is the bound of a window
partition here; `path` must be unique, so no key can hold more rows than one cell has tokens.
Tokens carry no copy of the text. Where source text is needed, `operators.extract` goes back to
the unit by `path`, on the same exchange.

The stages are kept small on purpose: the JVM does not compile a generated method beyond 8,000
bytes of code, and an uncompiled one is some twenty times slower.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from codelode.catalog import JAVA, PYTHON
from codelode.functions import lexical as lx
from codelode.functions import literals


def by_path(units: DataFrame) -> DataFrame:
    """The one exchange of the extraction. All readers of it must select the same columns.

    The number of partitions is `spark.sql.shuffle.partitions`, given explicitly: adaptive
    execution would merge partitions by the size of the raw text, and a byte of text becomes some
    forty bytes of token rows behind the exchange. Set it to about one per 16 MB of source text.

    Literals are found and tokens made behind it, so that the work on a unit is spread over these partitions, however
    few files or partitions the units come from.
    """
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.select("path", "language", "content").repartition(n, "path")


def with_inner_code(units: DataFrame) -> DataFrame:
    """The units by path, and the code inside their formatted strings, templates and elements as pieces of their own.

    The literal itself stays one token of the unit around it. `piece` holds the line, column and byte
    at which the code begins, and its size in bytes; it is empty for the unit itself. The fold that finds the
    literals runs once for a unit, as one generator makes all its rows.
    """
    return by_path(units).select("path", "language", F.explode(literals.pieces()).alias("found")).select(
        "path", "language", "found.piece", "found.content", "found.literals"
    ).filter((F.col("piece") == "") | (F.trim("content") != ""))


def _pieces(units: DataFrame) -> DataFrame:
    """Rows of `with_inner_code`, or units as pieces without the code inside their literals."""
    if "piece" in units.columns:
        return units
    # An empty string, but no literal: the windows must keep the column they are partitioned by.
    return by_path(units).select(
        "path", F.substring("path", 1, 0).alias("piece"), "language", "content", literals.outermost().alias("literals")
    )


def _of_piece(number: int) -> Column:
    return F.element_at(F.split("piece", ":"), number).cast("int")


def piece_bounds() -> tuple[Column, Column]:
    """The byte of the unit at which a piece begins, and where it ends; null for the end of a unit itself."""
    inside = F.col("piece") != ""
    start = F.when(inside, _of_piece(3)).otherwise(0)
    return start, F.when(inside, _of_piece(3) + _of_piece(4))


def in_unit(line: Column, col: Column, off: Column) -> tuple[Column, Column, Column]:
    """Line, column and byte in the unit of a place in a piece."""
    inside = F.col("piece") != ""
    first_line, first_col, first_off = (_of_piece(k) for k in (1, 2, 3))
    return (
        F.when(inside, first_line + line - 1).otherwise(line).cast("int"),
        F.when(inside & (line == 1), first_col + col - 1).otherwise(col).cast("int"),
        F.when(inside, first_off + off).otherwise(off),
    )


def newlines(text: Column) -> Column:
    """Number of line breaks. Most tokens and gaps have none, which `contains` finds fast."""
    without = F.replace(text, F.lit("\n"), F.lit(""))
    return F.when(
        text.contains("\n"), F.octet_length(text) - F.octet_length(without)
    ).otherwise(0)


def after_last_newline(text: Column) -> Column:
    """Bytes that follow the last line break."""
    return F.octet_length(F.substring_index(text, "\n", -1))


def _order() -> WindowSpec:
    return Window.partitionBy("path", "piece").orderBy("pos")


def _upto() -> WindowSpec:
    return _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before() -> WindowSpec:
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def _spread(units: DataFrame) -> DataFrame:
    """One row per token, with its sizes.

    A gap is what stands between the previous token and this one; a last row with an empty token
    holds a trailing gap.
    """
    language = F.col("language")
    tok, gap = F.col("tok"), F.col("gap")
    has_note = gap.contains("#") | gap.contains("/") | gap.contains("\\")
    # The units are put in path order before they are exploded: the window sort then meets
    # input that is in order already and only has to check it.
    return (
        _pieces(units)
        .sortWithinPartitions("path", "piece")
        .select(
            "path",
            "piece",
            "language",
            F.posexplode(literals.elements(language, F.col("content"), F.col("literals"))).alias("pos", "element"),
        )
        .withColumn("tok", lx.without_gap(language, F.col("element")))
        .transform(lx.with_kind)
        .withColumn(
            "gap",
            F.substring(F.col("element"), F.lit(1), F.length("element") - F.length(tok)),
        )
        .withColumns(
            {
                "bytes": F.octet_length("element"),
                "chars": F.length("element"),
                "gap_bytes": F.octet_length(gap),
                "gap_newlines": newlines(gap),
                "tok_newlines": newlines(tok),
                # Kept only if it has a comment or a backslash.
                "note": F.when((F.octet_length(gap) > 1) & has_note, gap),
            }
        )
        .withColumns(
            {
                "gap_tail": F.when(F.col("gap_newlines") > 0, after_last_newline(gap)),
                "tok_tail": F.when(F.col("tok_newlines") > 0, after_last_newline(tok)),
                "line_breaks": F.col("gap_newlines") + F.col("tok_newlines"),
                "step": F.when(F.col("kind") == lx.OPEN, 1)
                .when(F.col("kind") == lx.CLOSE, -1)
                .otherwise(0),
            }
        )
        .drop("element", "gap")
    )


def _with_offsets(rows: DataFrame, others: dict[str, Column]) -> DataFrame:
    """Add bytes, characters, lines and depth, which are running sums, and `others` by the same window."""
    tok = F.col("tok")
    return (
        rows.withColumns(
            {
                "byte_end": F.sum("bytes").over(_upto()),
                "char_end": F.sum("chars").over(_upto()),
                "line_end": F.sum("line_breaks").over(_upto()),
                "depth_end": F.sum("step").over(_upto()),
                **others,
            }
        )
        .withColumns(
            {
                "byte_off": F.col("byte_end") - F.octet_length(tok),
                "char_off": F.col("char_end") - F.length(tok),
                "line": (F.col("line_end") - F.col("tok_newlines") + 1).cast("int"),
                "depth": (F.col("depth_end") - F.col("step")).cast("int"),
            }
        )
        .withColumns(
            {
                "gap_off": F.col("byte_off") - F.col("gap_bytes"),
                # Byte at which a line begins: after the last line break so far.
                "last_break": F.coalesce(
                    F.col("byte_end") - F.col("tok_tail"), F.col("byte_off") - F.col("gap_tail")
                ),
            }
        )
    )


def _col(gap_tail: Column, byte_off: Column, gap_start: Column) -> Column:
    """Column of a token; `gap_start` is where the line begins that holds the end of the token before it."""
    return F.coalesce(gap_tail + 1, byte_off - gap_start + 1).cast("int")


def positioned(units: DataFrame) -> DataFrame:
    """One row per token with its place in the unit.

    Offsets count from 0, `line` and `col` from 1, columns in bytes.
    """
    return (
        _with_offsets(_spread(units), {})
        .withColumn("gap_start", F.coalesce(F.max("last_break").over(_before()), F.lit(0)))
        .withColumn("col", _col(F.col("gap_tail"), F.col("byte_off"), F.col("gap_start")))
        .select(
            "path", "piece", "language", "pos", "tok", "kind", "word", "line", "col", "char_off", "byte_off", "depth",
        )
    )


def tokens(units: DataFrame) -> DataFrame:
    """Public token table: significant tokens with place and bracket depth."""
    return (
        positioned(units)
        .filter(F.col("tok") != "")
        .select("path", "language", "pos", "tok", "line", "col", "char_off", "byte_off", "depth")
    )


def _comments(note: Column, line: Column, gap_newlines: Column, gap_col: Column) -> Column:
    """Comments of the gap before a token as expressions, or null where there are none."""
    language = F.col("language")

    def place(comment: Column, i: Column) -> Column:
        before = lx.before_comment(language, note, i)
        breaks = newlines(before)
        return F.struct(
            F.lit("UNKNOWN").alias("kind"),
            comment.alias("text"),
            (line - gap_newlines + breaks).cast("int").alias("line"),
            F.when(breaks > 0, after_last_newline(before) + 1)
            .otherwise(gap_col + F.octet_length(before))
            .cast("int")
            .alias("col"),
        )

    return F.when(note.isNotNull(), F.transform(lx.comments(language, note), place))


# Bits of a mark: the kind, the number of the word, and whether the gap breaks.
_WORD_BIT, _BREAK_BIT = 5, 12


def kind_of(near: str) -> Column:
    """Kind of a token nearby: p1, p2, p3, n1 or n2."""
    return F.col(f"{near}_mark").bitwiseAND((1 << _WORD_BIT) - 1)


def word_of(near: str) -> Column:
    return F.shiftright(F.col(f"{near}_mark"), _WORD_BIT).bitwiseAND((1 << _BREAK_BIT - _WORD_BIT) - 1)


def breaks_of(near: str) -> Column:
    return F.col(f"{near}_mark") >= 1 << _BREAK_BIT


def with_neighbours(units: DataFrame) -> DataFrame:
    """Tokens with their offsets, and the marks of the tokens p1, p2 and p3 before each and n1 and n2 after it.

    A window writes each column of each row anew and takes as long as a good part of the scan, so there are few of
    them and rows are kept to few columns: the small numbers of a token are one mark.
    """
    # A backslash at the end of a Python line takes the line break away.
    escaped = (F.col("language") == PYTHON) & F.col("note").contains("\\")
    breaks = (F.col("gap_newlines") > 0) & F.when(
        escaped, F.regexp_replace("note", r"#[^\n]*+|\\\r?\n", "").contains("\n")
    ).otherwise(True)
    mark = (
        F.col("kind") + F.shiftleft(F.col("word"), _WORD_BIT) + F.shiftleft(F.col("breaks").cast("int"), _BREAK_BIT)
    )
    rows = _spread(units).withColumn("breaks", breaks).withColumn("mark", mark)
    return _with_offsets(
        rows,
        {
            **{f"p{k}_mark": F.lag("mark", k).over(_order()) for k in (1, 2, 3)},
            **{f"n{k}_mark": F.lead("mark", k).over(_order()) for k in (1, 2)},
        },
    ).drop("mark")


def with_statement(rows: DataFrame, link: int, head: int) -> DataFrame:
    """Add what the tokens before tell, and the neighbours themselves where their rows are asked for.

    `line_first` is the first token of the statement in Python, which can begin behind the colon of
    a compound one; `last_colon` and `last_equals` are the positions of those signs outside brackets.
    `opened_by` is the number of the last word that can say what a `{` belongs to: brackets between
    that word and the `{`, as in `class A extends mixin(B) {`, say nothing.

    Rows on no level but that of links (role `link`) that may begin a statement get the role `head`.
    `here` is the token with its place; `p1` stands beside signs and opening brackets, `p3` beside signs behind `a[]`
    in Java, `n1` beside signs, opening brackets and commas.
    """
    kind, word, language = F.col("kind"), F.col("word"), F.col("language")
    top = (F.col("depth") == 0) & (language == PYTHON)
    starts_line = top & (F.col("breaks") | (F.col("pos") == 0) | (word_of("p1") == lx.word(";")))
    # Not the name of a property or method: `class: 1`, `class() {`.
    introduces = word.isin(lx.words("class", "interface", "enum", ";", "{", "}", "=>")) & ~(
        (word == lx.word("class")) & F.coalesce(word_of("n1").isin(lx.words(":", "(")), F.lit(False))
    )
    colon = (word == lx.word(":")) & top
    line_head = F.when(starts_line, F.struct("pos", "kind", "word"))
    signs = (lx.EQUALS, lx.COMPOUND)
    # What neighbours see of a token; most are asked for nothing.
    placed = F.struct("tok", "line", "byte_off", "gap_tail", "tok_newlines")
    as_p1 = F.when(kind_of("n1").isin(*signs, lx.OPEN), placed)
    as_p3 = F.when((language == JAVA) & (kind == lx.NAME) & (word_of("n1") == lx.word("[")), placed)
    as_n1 = F.when(
        kind_of("p1").isin(*signs, lx.OPEN, lx.COMMA),
        F.struct("tok", "line", "byte_off", "gap_tail", "gap_off", "gap_newlines", "note"),
    )
    rows = (
        rows.withColumns(
            {
                "line_head": line_head,
                "colon_pos": F.when(colon, F.col("pos")),
                "equals_pos": F.when((word == lx.word("=")) & top, F.col("pos")),
                "introducer": F.when(introduces, word),
                "as_p1": as_p1,
                "as_p3": as_p3,
                "as_n1": as_n1,
            }
        )
        .withColumns(
            {
                "line_first": F.last("line_head", ignorenulls=True).over(_upto()),
                "last_colon": F.last("colon_pos", ignorenulls=True).over(_before()),
                "last_equals": F.last("equals_pos", ignorenulls=True).over(_before()),
                "opened_by": F.last("introducer", ignorenulls=True).over(_before()),
                "gap_start": F.max("last_break").over(_before()),
                "p3_gap_start": F.max("last_break").over(_order().rowsBetween(Window.unboundedPreceding, -4)),
                "p1": F.lag("as_p1", 1).over(_order()),
                "p3": F.lag("as_p3", 3).over(_order()),
                "n1": F.lead("as_n1", 1).over(_order()),
            }
        )
    )
    # Those that may begin a statement behind a colon or have one stand on the level of signs, like the stops there.
    heads = F.coalesce(
        F.col("line_head").isNotNull() | F.col("colon_pos").isNotNull() | (top & (word_of("p1") == lx.word(":"))), F.lit(False)
    )
    # From here on only rows that play a part.
    rows = rows.withColumn(
        "roles", F.when(heads & (F.col("roles") <= link), F.col("roles") + head).otherwise(F.col("roles"))
    ).filter(F.col("roles") > 0)
    gap_start, p3_gap_start = F.coalesce("gap_start", F.lit(0)), F.coalesce("p3_gap_start", F.lit(0))
    gap_col = F.col("gap_off") - gap_start + 1
    # The line that the next token goes on with.
    next_start = F.coalesce("last_break", gap_start)
    n1 = F.col("n1")

    def before(near: str, start: Column) -> Column:
        """A token before this one; its column is right unless it has line breaks of its own."""
        at = F.col(near)
        fields = (at[name].alias(name) for name in ("tok", "line", "byte_off", "tok_newlines"))
        return F.when(at.isNotNull(), F.struct(*fields, _col(at["gap_tail"], at["byte_off"], start).alias("col")))

    own = F.when(kind.isin(lx.CLOSE, lx.COMMA), _comments(F.col("note"), F.col("line"), F.col("gap_newlines"), gap_col))
    of_next = _comments(n1["note"], n1["line"], n1["gap_newlines"], n1["gap_off"] - next_start + 1)
    return rows.select(
        "path", "piece", "language", "pos", "kind", "word", "breaks", "depth", "gap_off", "roles",
        *(f"{near}_mark" for near in ("p1", "p2", "p3", "n1", "n2")),
        "line_head", "colon_pos", "line_first", "last_colon", "last_equals", "opened_by",
        F.struct(
            "tok", "line", "byte_off", _col(F.col("gap_tail"), F.col("byte_off"), gap_start).alias("col"), own.alias("comments")
        ).alias("here"),
        before("p1", gap_start).alias("p1"),
        before("p3", p3_gap_start).alias("p3"),
        F.when(
            n1.isNotNull(),
            F.struct(
                *(n1[name].alias(name) for name in ("tok", "line", "byte_off")),
                _col(n1["gap_tail"], n1["byte_off"], next_start).alias("col"),
                of_next.alias("comments"),
            ),
        ).alias("n1"),
    )
