"""Lexical patterns of the three languages.

One call of `regexp_extract_all` splits a whole unit into elements, or each part between the literals that
`functions.literals` finds. An element is a gap (blanks,
line breaks, comments) followed by one token; a gap may stand alone only at the end of the unit.
Joining all elements gives the unit back, so offsets are sums of element lengths.

A dotted name such as `os.path.join` is one token when nothing but dots joins its parts. This
keeps the token table about a third smaller than one row per identifier.

All repetitions are possessive: the regex engine then walks them in a loop, not by recursion, so a
long string or comment cannot overflow the stack, and no input makes it backtrack.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.catalog import JAVA, JAVASCRIPT, PYTHON

_IDENT = r"[\p{L}\p{Nl}_$][\p{L}\p{Nl}\p{N}\p{M}_$]*+"

_HASH_COMMENT = r"#[^\n]*+"
_SLASH_COMMENT = r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?"

_TRIPLE = r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+(?:""")?'
_TRIPLE_SINGLE = r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+(?:''')?"
_DOUBLE = r'"(?:[^"\\\n]++|\\[\s\S])*+"?'
_SINGLE = r"'(?:[^'\\\n]++|\\[\s\S])*+'?"
_NUMBER = r"\.?[0-9][\p{L}\p{N}_.]*+"

# Java's type arguments are one token, so that their commas part nothing. A simple name in them begins with a capital,
# by custom; that tells them from comparisons. `_NESTED` of them can stand in each other.
_NESTED = 8


def _type_arguments() -> str:
    name = (
        r"(?:" + _IDENT + r"\s*+\.\s*+)*+(?:\p{Lu}[\p{L}\p{N}_$]*+"
        r"|(?:int|long|byte|char|short|boolean|float|double)(?=\s*+\[))"
    )
    words = r"\s++|[,&?]|\[\s*+\]|(?:extends|super)(?![\p{L}\p{N}_$])|" + name
    pattern = f"<(?:{words})*+>"
    for _ in range(_NESTED - 1):
        pattern = f"<(?:{words}|{pattern})*+>"
    return pattern


_TYPE_ARGUMENTS = _type_arguments()

_OPERATOR = (
    r"===|!==|==|!=|=>|->|:=|<=|\.\.\.|::|\+\+|--"
    r"|(?:>>>|>>|<<|\*\*|//|&&|\|\||\?\?|[-+*/%&|^@>])=|[\s\S]"
)
_SLASH_OPERATOR = _OPERATOR.replace(r"|//", "")

PYTHON_GAP = r"\s++|" + _HASH_COMMENT + r"|\\\r?\n"
SLASH_GAP = r"\s++|" + _SLASH_COMMENT


def _dotted(dot: str, member: str, blank: str = r"\s") -> str:
    return rf"{_IDENT}(?:{dot}{member})*+|{dot}(?:{blank})*+{member}(?:{dot}{member})*+"


PYTHON_CORE = "|".join(
    [
        r"[rRbBuUfFtT]{0,2}(?:" + "|".join([_TRIPLE, _TRIPLE_SINGLE, _DOUBLE, _SINGLE]) + ")",
        _NUMBER,
        _dotted(r"\.", _IDENT, r"\s|\\\r?\n"),
        _OPERATOR,
    ]
)
_JAVA_MEMBER = rf"\.\s*+{_TYPE_ARGUMENTS}\s*+{_IDENT}(?:\.{_IDENT})*+"
JAVA_CORE = "|".join(
    [_TRIPLE, _DOUBLE, _SINGLE, _NUMBER, _dotted(r"\.", _IDENT), _JAVA_MEMBER, _TYPE_ARGUMENTS, _SLASH_OPERATOR]
)
JAVASCRIPT_CORE = "|".join(
    [
        _DOUBLE,
        _SINGLE,
        _NUMBER,
        _dotted(r"\??\.", "#?" + _IDENT),
        r"\?\.\s*+[(\[]",
        _SLASH_OPERATOR,
    ]
)


def _element(gap: str, core: str) -> str:
    return f"(?:{gap})*+(?:{core})|(?:{gap})++"


PYTHON_ELEMENT = _element(PYTHON_GAP, PYTHON_CORE)
JAVA_ELEMENT = _element(SLASH_GAP, JAVA_CORE)
JAVASCRIPT_ELEMENT = _element(SLASH_GAP, JAVASCRIPT_CORE)

# Text mode: name = "value" in running text, where quotes and apostrophes are not balanced.
TEXT_ASSIGNMENT = r'([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"([^"\n]*)"'

# Script bodies of an HTML page.
SCRIPT_BODY = r"<script[^>]*>([\s\S]*?)</script>"

# Reserved words that are neither names nor values.
KEYWORDS = {
    PYTHON: [
        "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del",
        "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is",
        "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with",
        "yield",
    ],
    JAVA: [
        "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class",
        "const", "continue", "default", "do", "double", "else", "enum", "extends", "final",
        "finally", "float", "for", "goto", "if", "implements", "import", "instanceof", "int",
        "interface", "long", "native", "new", "package", "private", "protected", "public",
        "return", "short", "static", "strictfp", "switch", "synchronized", "throw", "throws",
        "transient", "try", "void", "volatile", "while",
    ],
    JAVASCRIPT: [
        "await", "break", "case", "catch", "class", "const", "continue", "debugger", "default",
        "delete", "do", "else", "export", "extends", "finally", "for", "function", "if", "in",
        "instanceof", "let", "new", "return", "switch", "throw", "try", "typeof", "var", "void",
        "while", "with", "yield",
    ],
}

# Reserved words that stand for a value, so they end an operand.
VALUE_WORDS = {
    PYTHON: ["None", "True", "False"],
    JAVA: ["null", "true", "false", "this", "super"],
    JAVASCRIPT: ["null", "undefined", "true", "false", "this", "super", "import"],
}

# Words that open a one-line compound statement in Python (`if a: b = 1`).
PYTHON_COMPOUND = [
    "if", "elif", "else", "for", "while", "try", "except", "finally", "with", "class", "def",
    "async", "match", "case",
]

# Java words after which an identifier and `(` still form a call.
JAVA_BEFORE_CALL = [
    "return", "throw", "else", "do", "case", "assert", "yield", "instanceof", "default",
]

# Words whose brackets hold a condition and not parameters.
CONTROL_WORDS = ["if", "for", "while", "switch", "with", "await"]

# Words and marks that the context rules ask for. A token row holds the number of its word in this
# list (0 for any other token): comparing numbers keeps rows narrow and generated code small.
_WORDS = sorted(
    {
        *PYTHON_COMPOUND, *JAVA_BEFORE_CALL, *CONTROL_WORDS,
        *"( ) [ ] { } ; : = > * @ => ++ -- ! ~ ...".split(),
        "interface", "enum", "new", "function", "import", "super", "extends", "throws", "in",
        "const", "let", "var",
    }
)
_WORD_NUMBER = {word: number for number, word in enumerate(_WORDS, start=1)}
_LONGEST_WORD = max(map(len, (*_WORDS, *chain(*KEYWORDS.values()), *chain(*VALUE_WORDS.values()))))


def word(text: str) -> int:
    return _WORD_NUMBER[text]


def words(*texts: str) -> list[int]:
    return [_WORD_NUMBER[text] for text in texts]


def by_language(language: Column, python: Column, java: Column, javascript: Column) -> Column:
    """Pick one of three expressions by the language column (E-16)."""
    return (
        F.when(language == PYTHON, python).when(language == JAVA, java).otherwise(javascript)
    )


def elements(language: Column, content: Column) -> Column:
    """All elements of a text without nested literals, in order; empty for a language the scanner does not know."""
    def split(pattern: str) -> Column:
        return F.regexp_extract_all(content, F.lit(pattern), F.lit(0))

    return (
        F.when(language == PYTHON, split(PYTHON_ELEMENT))
        .when(language == JAVA, split(JAVA_ELEMENT))
        .when(language == JAVASCRIPT, split(JAVASCRIPT_ELEMENT))
    )


def is_gap(language: Column, element: Column) -> Column:
    """Whether an element has no token."""
    python, slash = element.rlike(rf"\A(?:{PYTHON_GAP})++\z"), element.rlike(rf"\A(?:{SLASH_GAP})++\z")
    return F.when(language == PYTHON, python).otherwise(slash)


def without_gap(language: Column, element: Column) -> Column:
    """The token of an element. Most gaps are empty or one blank; only comments need the regex."""
    # Codes: 32 blank, 35 #, 47 /, 92 backslash. Comments begin with one of the last three.
    def is_plain(code: Column) -> Column:
        return (code > 32) & ~code.isin(35, 47, 92)

    trimmed = F.ltrim(element, F.lit(" \t\n\r\f\x0b"))
    python = F.regexp_replace(element, rf"^(?:{PYTHON_GAP})++", "")
    slash = F.regexp_replace(element, rf"^(?:{SLASH_GAP})++", "")
    return (
        F.when(is_plain(F.ascii(element)), element)
        .when(
            element.startswith(" ") & is_plain(F.ascii(F.substring(element, 2, 1))),
            F.substring(element, F.lit(2), F.length(element)),
        )
        .when(is_plain(F.ascii(trimmed)), trimmed)
        .when(language == PYTHON, python)
        .otherwise(slash)
    )


def comments(language: Column, gap: Column) -> Column:
    """The comments of a gap, in order."""
    python = F.regexp_extract_all(gap, F.lit(_HASH_COMMENT), F.lit(0))
    slash = F.regexp_extract_all(gap, F.lit(_SLASH_COMMENT), F.lit(0))
    return F.when(
        language == PYTHON, F.when(gap.contains("#"), python)
    ).otherwise(F.when(gap.contains("/"), slash))


def before_comment(language: Column, gap: Column, i: Column) -> Column:
    """The part of a gap before its comment number `i`, counted from 0."""
    def skip(comment: str) -> Column:
        blank = r"(?:\s++|\\\r?\n)*+"
        return F.concat(
            F.lit(f"^(?:{blank}(?:{comment})){{"), i.cast("string"), F.lit(f"}}{blank}")
        )

    pattern = F.when(language == PYTHON, skip(_HASH_COMMENT)).otherwise(skip(_SLASH_COMMENT))
    return F.coalesce(F.regexp_substr(gap, pattern), F.lit(""))


def is_complete_string(language: Column, token: Column) -> Column:
    """Whether a string token has its closing quote."""
    whole = r"^[rRbBuUfFtT]{0,2}(?:" + "|".join(
        [
            r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""',
            r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''",
            r'"(?:[^"\\\n]++|\\[\s\S])*+"',
            r"'(?:[^'\\\n]++|\\[\s\S])*+'",
            r"`[\s\S]*`",
        ]
    ) + ")$"
    # Code in a formatted string may hold its quotes again.
    formatted = r"""^(?:[rR]?[fFtT][rR]?)("{3}|'{3}|"|')[\s\S]*\1$"""
    return token.rlike(whole) | ((language == PYTHON) & (F.length(token) > 2) & token.rlike(formatted))


# Token kinds. The order lets groups of kinds be told by one comparison.
NAME = 1  # identifier
DOTTED = 2  # identifiers joined by dots
MEMBER = 3  # name that begins with a dot
VALUE = 4  # null, this, True, ...
STRING = 5
NUMBER = 6
OTHER_QUOTED = 7  # template literal, JSX element, regular expression, Java character
CLOSE = 8
OPEN = 9
COMMA = 10
EQUALS = 11
COMPOUND = 12  # += and the like
KEYWORD = 13
OPERATOR = 14
END = 15  # trailing gap

# First characters whose kind the rest of the token decides.
_APOSTROPHE, _DOT, _QUESTION, _SLASH = 16, 17, 18, 19


def is_single_name(kind: Column) -> Column:
    return kind <= DOTTED


def is_name(kind: Column) -> Column:
    return kind <= MEMBER


def ends_operand(kind: Column) -> Column:
    """Kinds that can be the end of an operand."""
    return kind <= CLOSE


def begins_operand(kind: Column) -> Column:
    """Kinds that begin a new operand after a line break; a member carries the old one on."""
    return (kind <= NUMBER) & (kind != MEMBER)


_COMPOUND_OPERATORS = [
    "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "//=", "&&=",
    "||=", "??=", "@=",
]


def _first_kinds() -> str:
    """Kind by the code of the first character; code 128 stands for all beyond ASCII.

    One character per code, `@` plus the kind: looking it up costs one substring.
    """
    table = [OPERATOR] * 129
    for code in (*range(65, 91), *range(97, 123), 36, 95, 128):
        table[code] = NAME
    for code in range(48, 58):
        table[code] = NUMBER
    for character, first in {
        '"': STRING, "'": _APOSTROPHE, "`": OTHER_QUOTED, "(": OPEN, "[": OPEN, "{": OPEN,
        ")": CLOSE, "]": CLOSE, "}": CLOSE, ",": COMMA, "=": EQUALS, ".": _DOT, "?": _QUESTION,
        "/": _SLASH,
    }.items():
        table[ord(character)] = first
    return "".join(chr(64 + first) for first in table)


def _listed(language: Column, lists: dict[str, list[str]]) -> Column:
    return by_language(language, *(F.lit(",".join(lists[name])) for name in (PYTHON, JAVA, JAVASCRIPT)))


def with_kind(rows: DataFrame) -> DataFrame:
    """Add `kind`, the kind letter of `tok`, and `word`, its number among the known words."""
    language, token = F.col("language"), F.col("tok")
    code, size, first = F.col("code"), F.col("size"), F.col("first")
    rows = rows.withColumns({"code": F.ascii(token), "size": F.octet_length(token)}).withColumn(
        "first",
        F.ascii(F.substring(F.lit(_first_kinds()), F.least(code, F.lit(128)) + 1, F.lit(1))) - 64,
    )
    name = (
        F.when(
            (language == PYTHON) & token.rlike("^[rRbBuUfFtT]{1,2}[\"']"), F.lit(STRING)
        )
        .when(token.contains("."), F.lit(DOTTED))
        .when(size > _LONGEST_WORD, F.lit(NAME))
        .when(F.find_in_set(token, _listed(language, KEYWORDS)) > 0, F.lit(KEYWORD))
        .when(F.find_in_set(token, _listed(language, VALUE_WORDS)) > 0, F.lit(VALUE))
        .otherwise(F.lit(NAME))
    )
    second = F.ascii(F.substring(token, 2, 1))
    # Tokens of two and more characters that begin with a mark.
    marks = (
        F.when(
            first == _DOT,
            F.when(second.between(48, 57), F.lit(NUMBER))
            .when(second == 46, F.lit(OPERATOR))
            .otherwise(F.lit(MEMBER)),
        )
        .when(
            (first == _QUESTION) & (second == 46),
            F.when(F.right(token, F.lit(1)).isin("(", "["), F.lit(OPEN)).otherwise(F.lit(MEMBER)),
        )
        # A regular expression literal: no operator of three characters begins with a slash here.
        .when((first == _SLASH) & (size > 2) & (language == JAVASCRIPT), F.lit(OTHER_QUOTED))
        # A JSX element: no operator of four characters begins like that.
        .when((code == 60) & (size > 3) & (language == JAVASCRIPT), F.lit(OTHER_QUOTED))
        .when(token.isin(_COMPOUND_OPERATORS), F.lit(COMPOUND))
        .otherwise(F.lit(OPERATOR))
    )
    kind = (
        F.when(size == 0, F.lit(END))
        .when(first == NAME, name)
        .when(
            first == _APOSTROPHE, F.when(language == JAVA, F.lit(OTHER_QUOTED)).otherwise(F.lit(STRING))
        )
        .when(first.isin(STRING, OTHER_QUOTED, NUMBER), first)
        .when(size > 1, marks)
        .when(first > END, F.lit(OPERATOR))
        .otherwise(first)
    )
    # Type arguments count as the sign that ends them; a comparison is no word.
    is_java = language == JAVA
    number = F.when(is_java & (code == 60) & (size > 1) & token.endswith(">"), F.lit(word(">"))).when(
        is_java & (token == ">"), F.lit(0)
    ).when(
        size <= _LONGEST_WORD, F.find_in_set(token, F.lit(",".join(_WORDS)))
    ).when(token.endswith(".new"), F.lit(word("new"))).otherwise(0)
    return rows.withColumns({"kind": kind, "word": number}).drop("code", "size", "first")
