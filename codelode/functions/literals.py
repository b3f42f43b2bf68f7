"""Literals whose ends only brackets tell (E-01): a pushdown fold over the marks of a unit.

In JavaScript a slash begins a regular expression or divides, by what stands before it; templates and JSX
elements hold code that holds templates and elements again. Python's formatted strings hold code with quotes
of its own. No pattern can follow such nesting, so `lexed` folds over the marks of a unit (quotes,
brackets, slashes, line breaks; some tenth of its characters) with a stack of modes. It gives

* templates, JSX elements, regular expressions and formatted strings, as bytes;
* the code inside them, at any depth, with line and column.

Between the literals a pattern suffices (`functions.lexical`). All of it is JVM expressions over the columns
`language` and `content`; they are written as SQL text, as some thousand calls would take seconds to make each.

What a mark does in a mode is written down as rules (`_javascript`, `_python`) and made into a table, so that a
step of the fold looks up one number. The fold is cut in two levels, as an array that grows by one element at a time
is copied each time: inner folds go over `STRIDE` marks, the outer one joins what they found.

A literal that isn't closed must not hide what follows: `lexed` then folds once more, and takes the mark that
began it as a plain one. A unit with more than `RETRIES` of them is damaged beyond use: from there on all are plain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelode.catalog import JAVASCRIPT, PYTHON
from codelode.functions import lexical as lx

STRIDE = 256
RETRIES = 20

_REST_OF_REGEX = r"(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++"
# A run of other tokens and a mark. Group 1 is the last token of the run, group 2 the mark, group 3 a slash that could
# end the regular expression that a slash would begin.
_JAVASCRIPT_PATTERN = (
    r"(?:[ \t\r\f\x0b\u00a0\ufeff]++"
    r"|((?:[A-Za-z0-9_.]++|[^\x00-\x7f]++|\$(?!\{))++|\+\+|--|\*(?!/)|[^'\"`\\/(){}\[\]\n<>$*]))*+"
    r"(\\\*/[a-z]*+|\\[\s\S]|\*/[a-z]*+|//|/\*|/(?:(?=" + _REST_OF_REGEX + r"(/))|)(?:>|[a-z]*+)"
    r"|\$\{|</|<>|<[A-Za-z_$]?|['\"`\\(){}\[\]\n>]|\z)"
)
# Group 1 is the prefix of a formatted string, and there is no group 3.
_PYTHON_PATTERN = (
    r"(?:((?<![\p{L}\p{N}_$])(?:[fFtT][rR]?|[rR][fFtT])(?=['\"]))|[^'\"#\n\\(){}\[\]:!])*+"
    r"(\"\"\"|'{3}|\{\{|!=|\\(?![{}])[\s\S]|['\"#\n\\(){}\[\]:!]|\z)()"
)

# What stands before a mark: an operand, behind which a slash divides; something behind which a brace opens a
# block; anything else, behind which it opens an object.
_OPERAND, _BLOCK_NEXT, _OPERATOR, _AS_IT_WAS = 0, 1, 2, 3
_CONDITIONS = ["if", "while", "for", "with"]
_BLOCK_WORDS = [";", "class", "else", "do", "try", "finally"]

_CODE_MODES = ["unit", "(", "condition", "[", "block", "object", "in template", "in jsx", "field"]
_MODES = [
    *_CODE_MODES, "'", '"', "'" * 3, '"' * 3, "template", "regex", "class", "line", "comment", "tag", "tag '", 'tag "',
    "children", "end tag", "f'", 'f"', "f" + "'" * 3, "f" + '"' * 3, "format", "broken",
]
_JAVASCRIPT_MARKS = [
    "", "'", '"', "`", "(", "condition (", ")", "[", "]", "{", "}", "${", "\n", "escape", "escaped break", "//", "/*", "*/",
    "*/ word", "/", "/ open", "/ word", "/ word open", "/>", "/> open", "<", "tag", "<>", "</", ">", "=>",
]
_QUOTES = ["'", '"', "'" * 3, '"' * 3]
_PYTHON_MARKS = ["", *_QUOTES, *("f" + q for q in _QUOTES), "#", "\n", "escape", "(", ")", "[", "]", "{", "}", "{{", ":", "!"]


@dataclass(frozen=True)
class _Act:
    """What a mark does: modes to leave and to enter, what stands before the next mark, and what ends there.

    `begin`: where the mode entered begins (at the mark, behind it, where the mode left began, or at the prefix of
    a string). `back`: how many bytes before the end of the mark a literal or code ends. `literal`: the mode entered is
    a literal, which must not begin at some places.
    """

    drop: int = 0
    push: str = ""
    times: int = 1
    before: int = _AS_IT_WAS
    emit: str = ""
    begin: str = "mark"
    back: int = 0
    literal: bool = False

    def number(self) -> int:
        pushed = self.times if self.push else 0
        mode = _MODES.index(self.push) if self.push else 0
        emit = ["", "literal", "code", "element"].index(self.emit)
        begin = ["mark", "end", "same", "prefix"].index(self.begin)
        fields = [(self.drop, 1), (pushed, 2), (mode, 5), (self.before, 2), (emit, 2), (begin, 2), (self.back, 2), (self.literal, 1)]
        value = at = 0
        for field, bits in fields:
            value |= int(field) << at
            at += bits
        return value


_NOTHING = _Act()


def _javascript(mode: str, mark: str, before: int, plain: bool) -> _Act:
    """`plain`: the mark mustn't begin a literal."""
    if mode in _CODE_MODES:
        return _javascript_code(mode, mark, before, plain)
    slash = mark.startswith("/")
    element_end = _Act(drop=1, before=_OPERAND, emit="element")
    tag = _Act(push="children" if mark == "<>" else "tag")
    code = _Act(push="in jsx", begin="end", before=_OPERATOR)
    match mode:
        case "'" | '"':
            return _Act(drop=1) if mark in (mode, "\n") else _NOTHING
        case "line":
            return _Act(drop=1) if mark in ("\n", "escaped break") else _NOTHING
        case "comment" if mark.startswith("*/"):
            return _Act(drop=1, before=_OPERAND if mark == "*/ word" else _AS_IT_WAS)
        case "template" if mark == "`":
            return _Act(drop=1, before=_OPERAND, emit="literal")
        case "template" if mark == "${":
            return _Act(push="in template", begin="end", before=_OPERATOR)
        case "regex" if slash or mark.startswith("*/"):
            # Flags belong to the literal; a slash, star or > behind it doesn't.
            return _Act(drop=1, before=_OPERAND, emit="literal", back=1 if mark[:2] in ("//", "/*", "/>") else 0)
        case "regex" if mark == "[":
            return _Act(push="class")
        case "regex" if mark == "\n":
            return _Act(drop=1)
        case "class" if mark in ("]", "\n"):
            return _Act(drop=1)
        case "tag" if mark in (">", "=>"):
            return _Act(drop=1, push="children", begin="same")
        case "tag" if mark.startswith("/>"):
            return element_end
        case "tag" if mark == "{":
            return code
        case "tag" if mark in ("'", '"'):
            return _Act(push=f"tag {mark}")
        case "tag '" | 'tag "':
            return _Act(drop=1) if mark == mode[-1] else _NOTHING
        case "children" if mark == "</":
            return _Act(drop=1, push="end tag", begin="same")
        case "children" if mark in ("tag", "<>"):
            return tag
        case "children" if mark in ("{", "${"):
            return code
        case "end tag" if mark in (">", "=>"):
            return element_end
    return _NOTHING


def _javascript_code(mode: str, mark: str, before: int, plain: bool) -> _Act:
    match mark:
        case "" | "\n":
            return _Act(before=before)
        case "'" | '"':
            return _Act(push=mark, before=_OPERAND)
        case "`":
            return _Act(before=_OPERAND) if plain else _Act(push="template", before=_OPERAND, literal=True)
        case "(":
            return _Act(push="(", before=_OPERATOR)
        case "condition (":
            return _Act(push="condition", before=_OPERATOR)
        case ")":
            return _Act(drop=int(mode in ("(", "condition")), before=_BLOCK_NEXT if mode == "condition" else _OPERAND)
        case "[":
            return _Act(push="[", before=_OPERATOR)
        case "]":
            return _Act(drop=int(mode == "["), before=_OPERAND)
        case "{" if before == _OPERATOR:
            return _Act(push="object", before=_OPERATOR)
        case "{" | "${":
            return _Act(push="block", before=_BLOCK_NEXT)
        case "}" if mode in ("in template", "in jsx"):
            return _Act(drop=1, emit="code", back=1)
        case "}":
            return _Act(drop=int(mode in ("block", "object")), before=_OPERAND if mode == "object" else _BLOCK_NEXT)
        case "//":
            return _Act(push="line", before=before)
        case "/*":
            return _Act(push="comment", before=before)
        case "/ open" | "/ word open" | "/> open" if before != _OPERAND:
            return _Act(push="regex")
        case "/ word" | "/ word open" | "*/ word":
            return _Act(before=_OPERAND)
        case "tag" | "<>" if before != _OPERAND and not plain:
            return _Act(push="children" if mark == "<>" else "tag", literal=True)
        case "tag":
            return _Act(before=_OPERAND)
        case "=>":
            return _Act(before=_BLOCK_NEXT)
    return _Act(before=_OPERATOR)


def _python(mode: str, mark: str, before: int, plain: bool) -> _Act:
    quote = mark.removeprefix("f")
    if mode in _CODE_MODES:
        if quote in _QUOTES:
            formatted = mark != quote and not plain
            return _Act(push=mark, begin="prefix", literal=True) if formatted else _Act(push=quote)
        if mark == "#":
            return _Act(push="line")
        if mode == "unit":
            return _NOTHING
        if mark in ("(", "["):
            return _Act(push=mark)
        if mark in ("{", "{{"):
            return _Act(push="block", times=len(mark))
        if mode == "field":
            ends = {"}": "", ":": "format", "!": "format"}
            return _Act(drop=1, push=ends[mark], emit="code", back=1) if mark in ends else _NOTHING
        return _Act(drop=1) if mark in (")", "]", "}") else _NOTHING
    if mode == "line":
        return _Act(drop=1) if mark == "\n" else _NOTHING
    if mode == "format":
        if quote in _QUOTES or mark == "\n":
            return _Act(push="broken")
        return _Act(drop=1) if mark == "}" else _Act(push="field", begin="end") if mark == "{" else _NOTHING
    if mode == "broken":
        return _NOTHING
    own = mode.removeprefix("f")
    if quote == own or quote == 3 * own:
        # Three quotes close a string of one, and are an empty string besides.
        return _Act(drop=1, emit="literal" if mode != own else "", back=0 if quote == own else 2)
    if mark == "{" and mode != own:
        return _Act(push="field", begin="end")
    if mark == "\n" and len(own) == 1:
        # Ends the string; inside a field that leaves the literal around it without an end (see `step`).
        return _Act(drop=1, push="broken")
    return _NOTHING


def _text(value: str) -> str:
    """A string literal of SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _listed(values: list[str]) -> str:
    return ", ".join(map(_text, values))


def _let(value: str, name: str, use: str) -> str:
    """`use` with a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def _table(rules: Callable, marks: list[str], plain: bool) -> str:
    """The number of the act for each mode, what stands before, and mark, in that order."""
    numbers = (rules(mode, mark, before, plain).number() for mode in _MODES for before in range(3) for mark in marks)
    return f"cast(split('{','.join(map(str, numbers))}', ',') AS array<int>)"


def is_nested(language: Column, content: Column) -> Column:
    """Whether a unit may hold such literals; a pattern splits all others."""
    javascript = content.contains("`") | content.rlike(r"(?<![*/])/(?![*/])|<[A-Za-z_$>]")
    python = content.contains("{") & content.rlike(r"(?<![\p{L}\p{N}_$])(?:[fFtT][rR]?|[rR][fFtT])[\"']")
    return F.when(language == JAVASCRIPT, javascript).when(language == PYTHON, python).otherwise(False)


# Fields of an event: the groups of the pattern.
_RUN, _LAST, _MARK, _CLOSED = (f"e.`{k}`" for k in range(4))


def _javascript_event() -> tuple[str, str]:
    """Numbers of the mark, and of what the last token before it leaves there (0 without one)."""
    number = _JAVASCRIPT_MARKS.index
    single = "".join(m for m in _JAVASCRIPT_MARKS if len(m) == 1 and m not in "(/>")
    numbers = ", ".join(str(number(m)) for m in single)

    def either(condition: str, yes: str, no: str) -> str:
        return f"if({condition}, {number(yes)}, {number(no)})"

    exact = "\n".join(f"WHEN {_MARK} = {_text(m)} THEN {number(m)}" for m in ("//", "/*", "${", "<>", "</"))
    mark = f"""CASE
        WHEN {_MARK} = '' THEN {number("")}
        WHEN {_MARK} = '(' THEN {either(f"{_LAST} IN ({_listed(_CONDITIONS)})", "condition (", "(")}
        WHEN {_MARK} = '>' THEN {either(f"{_LAST} = '='", "=>", ">")}
        WHEN {_MARK} = '/' THEN {either(f"{_CLOSED} != ''", "/ open", "/")}
        WHEN length({_MARK}) = 1 AND {_MARK} != {_text(chr(92))} THEN element_at(array({numbers}), instr({_text(single)}, {_MARK}))
        {exact}
        WHEN {_MARK} = '/>' THEN {either(f"{_CLOSED} != ''", "/> open", "/>")}
        WHEN startswith({_MARK}, '/') THEN {either(f"{_CLOSED} != ''", "/ word open", "/ word")}
        WHEN startswith({_MARK}, '<') THEN {number("tag")}
        WHEN {_MARK} IN ('*/', {_text(chr(92) + "*/")}) THEN {number("*/")}
        WHEN startswith({_MARK}, '*/') OR startswith({_MARK}, {_text(chr(92) + "*/")}) THEN {number("*/ word")}
        ELSE {either(f"endswith({_MARK}, {_text(chr(10))})", "escaped break", "escape")} END"""
    keywords = [word for word in lx.KEYWORDS[JAVASCRIPT] if word not in _BLOCK_WORDS]
    # One operator at a time, but for ++ and --: a slash behind those divides.
    left = f"""CASE WHEN {_LAST} = '' THEN 0
        WHEN {_LAST} IN ({_listed(_BLOCK_WORDS)}) THEN {1 + _BLOCK_NEXT}
        WHEN {_LAST} IN ({_listed([*"+-*%&|^!~=?:,@#", *keywords])}) THEN {1 + _OPERATOR} ELSE {1 + _OPERAND} END"""
    return mark, left


def _python_event() -> tuple[str, str]:
    number = _PYTHON_MARKS.index
    exact = "\n".join(
        f"WHEN {_MARK} = {_text(m)} THEN {number(m)}" for m in _PYTHON_MARKS if not m.startswith(("f", "escape"))
    )
    prefixed = "\n".join(f"WHEN {_LAST} != '' AND {_MARK} = {_text(q)} THEN {number('f' + q)}" for q in _QUOTES)
    return f"CASE {prefixed} {exact} ELSE {number('escape')} END", "0"


# `owner` is where the code begins that directly holds a literal, or -1 for the unit.
_FOUND = "array<struct<is_code:boolean,begin:int,end:int,line:int,col:int,owner:int>>"
_STATE = ("pos", "line", "line_begin", "modes", "starts", "before", "owner")


def _events(pattern: str, event: tuple[str, str]) -> str:
    text, last, mark, closed = (f"regexp_extract_all(content, {_text(pattern)}, {k})" for k in range(4))
    zipped = f"arrays_zip({text}, {last}, {mark}, {closed})"
    return f"""transform({zipped}, e -> named_struct('size', octet_length({_RUN}), 'mark_size', octet_length({_MARK}),
        'last_size', octet_length({_LAST}), 'mark', {event[0]}, 'left', {event[1]}, 'breaks', endswith({_MARK}, '\\n')))"""


#: Code of the character of the first mode on the stack; none of those that follow has a meaning in patterns.
_FIRST = 48


def _letter(mode: str) -> str:
    return chr(_FIRST + _MODES.index(mode))


def _field(at: int, bits: int) -> str:
    return f"(shiftright(act, {at}) & {(1 << bits) - 1})"


def _step(marks: list[str]) -> str:
    """The state after a mark: of the state `s`, the event `e`, and the tables `acts` and `plain_acts`."""
    inner = ", ".join(str(_MODES.index(mode)) for mode in ("in template", "in jsx", "field"))
    end, before = "(s.pos + e.size)", "if(e.left = 0, s.before, e.left - 1)"
    index = f"((ascii(right(s.modes, 1)) - {_FIRST}) * 3 + {before}) * {len(marks)} + e.mark"
    line, line_begin = "(s.line + int(e.breaks))", f"if(e.breaks, {end}, s.line_begin)"
    drop, pushed, mode, emit = _field(0, 1), _field(1, 2), _field(3, 5), _field(10, 2)
    begin = f"""CASE {_field(12, 2)} WHEN 0 THEN {end} - e.mark_size WHEN 1 THEN {end}
        WHEN 2 THEN element_at(s.starts, -1).begin ELSE {end} - e.mark_size - e.last_size END"""
    may_begin = f"""NOT array_contains(t.plain, {begin}) AND (attempt <= {RETRIES} OR {begin} < element_at(t.plain, -1))"""
    allowed = f"if({_field(16, 1)} = 1 AND NOT ({may_begin}), get(plain_acts, {index}), act)"
    below, top = f"left(s.modes, length(s.modes) - {drop})", "element_at(s.starts, -1)"
    # A string that a line break ends is done; inside a field it breaks the literal around it.
    times = f"if({mode} = {_MODES.index('broken')} AND {drop} = 1 AND s.owner < 0, 0, {pushed})"
    starts = f"if({drop} = 0, s.starts, slice(s.starts, 1, size(s.starts) - 1))"
    # A code is its own owner while it lasts; what it is in stands in its start.
    owner = f"if({emit} = 2, {top}.owner, s.owner)"
    start = f"named_struct('begin', int({begin}), 'line', int({line}), 'col', int({end} - {line_begin} + 1), 'owner', s.owner)"
    one = f"""named_struct('is_code', {emit} = 2, 'begin', {top}.begin, 'end', int({end} - {_field(14, 2)}), 'line', {top}.line,
        'col', {top}.col, 'owner', {owner})"""
    child = f"{emit} = 3 AND endswith({below}, '{_letter('children')}')"
    changed = f"""named_struct('pos', int({end}), 'line', int({line}), 'line_begin', int({line_begin}),
        'modes', if({times} > 0, concat({below}, repeat(char({mode} + {_FIRST}), {times})), {below}),
        'starts', if({times} > 0, concat({starts}, array_repeat({start}, {times})), {starts}),
        'before', if({_field(8, 2)} = {_AS_IT_WAS}, s.before, {_field(8, 2)}),
        'owner', if({times} > 0 AND {mode} IN ({inner}), int({begin}), {owner}),
        'found', if({emit} > 0 AND NOT ({child}), concat(s.found, array({one})), s.found))"""
    # Most marks change nothing but the place.
    unchanged = f"""named_struct('pos', int({end}), 'line', int({line}), 'line_begin', int({line_begin}), 'modes', s.modes,
        'starts', s.starts, 'before', s.before, 'owner', s.owner, 'found', s.found)"""
    # `aggregate` hands a value on as it is, where `transform` would copy the whole state.
    acted = f"aggregate(array({allowed}), s, (unused, act) -> {changed})"
    return f"aggregate(array(get(acts, {index})), s, (unused, act) -> if(act = {_NOTHING.number()}, {unchanged}, {acted}))"


def _folded(marks: list[str], result: str) -> str:
    """`result` of the state `y` at the end of a unit, of `events`; `y.parts` is what was found."""
    none = f"cast(array() AS {_FOUND})"
    start = f"""named_struct('pos', 0, 'line', 1, 'line_begin', 0, 'modes', '{_letter("unit")}',
        'starts', array(named_struct('begin', 0, 'line', 1, 'col', 1, 'owner', -1)), 'before', {_BLOCK_NEXT}, 'owner', -1,
        'parts', cast(array() AS array<{_FOUND}>))"""
    kept = ", ".join(f"'{name}', w.{name}" for name in _STATE)
    begun = f"named_struct({kept}, 'found', {none})"
    parts = "if(size(x.found) > 0, concat(w.parts, array(x.found)), w.parts)"
    done = f"named_struct({kept.replace('w.', 'x.')}, 'parts', {parts})"
    stride = f"aggregate(slice(events, first, {STRIDE}), {begun}, (s, e) -> {_step(marks)}, x -> {done})"
    return f"aggregate(sequence(1, greatest(size(events), 1), {STRIDE}), {start}, (w, first) -> {stride}, y -> {result})"


def _attempts(marks: list[str], open_modes: list[str]) -> str:
    """What is found, with marks of literals that have no end taken as plain, one after the other."""
    pattern = "[" + "".join(map(_letter, open_modes)) + "]"
    unclosed = f"regexp_instr(y.modes, '{pattern}')"
    judged = f"""named_struct('done', {unclosed} = 0,
        'plain', concat(t.plain, array(element_at(y.starts, greatest({unclosed}, 1)).begin)), 'found', flatten(y.parts))"""
    start = f"named_struct('done', false, 'plain', array(-1), 'found', cast(array() AS {_FOUND}))"
    attempt = f"if(t.done, t, {_folded(marks, judged)})"
    return f"aggregate(sequence(1, {RETRIES + 1}), {start}, (t, attempt) -> {attempt}).found"


@cache
def _lexed() -> tuple[str, str]:
    """What a unit of JavaScript and of Python holds."""

    def of(pattern: str, event: tuple[str, str], rules: Callable, marks: list[str], open_modes: list[str]) -> str:
        found = _let(_table(rules, marks, True), "plain_acts", _attempts(marks, open_modes))
        return _let(_events(pattern, event), "events", _let(_table(rules, marks, False), "acts", found))

    return (
        of(_JAVASCRIPT_PATTERN, _javascript_event(), _javascript, _JAVASCRIPT_MARKS, ["template", "tag", "children", "end tag"]),
        of(_PYTHON_PATTERN, _python_event(), _python, _PYTHON_MARKS, ["f" + quote for quote in _QUOTES]),
    )


def lexed() -> Column:
    """The literals and codes of a unit (columns `language` and `content`); null where there can be none."""
    javascript, python = (F.expr(text) for text in _lexed())
    language, content = F.col("language"), F.col("content")
    nested = is_nested(language, content)
    return F.when(nested & (language == JAVASCRIPT), javascript).when(nested, python)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def part(raw: Column, begin: Column, end: Column) -> Column:
    """Bytes of a binary column as text."""
    return F.substring(raw, begin + 1, end - begin).cast("string")


def elements(language: Column, content: Column, literals: Column) -> Column:
    """All elements of a text: a literal is one token, and a pattern splits what stands between the literals."""

    def cut(raw: Column) -> Column:
        n = F.size(literals)

        def segment(k: Column) -> Column:
            # Segment k ends with literal k; the last one with the text.
            begin = F.when(k == 0, F.lit(0)).otherwise(F.get(literals, k - 1)["end"])
            literal = F.get(literals, k)
            found = lx.elements(language, part(raw, begin, F.coalesce(literal["begin"], F.octet_length(raw))))

            def joined(code: Column) -> Column:
                text = part(raw, literal["begin"], literal["end"])
                last = F.element_at(F.concat(F.array(F.lit("")), code), -1)
                with_gap = F.concat(F.slice(code, F.lit(1), F.size(code) - 1), F.array(F.concat(last, text)))
                return (
                    F.when(k == n, code)
                    .when((last != "") & lx.is_gap(language, last), with_gap)
                    .otherwise(F.concat(code, F.array(text)))
                )

            return let(found, joined)

        return F.flatten(F.transform(F.sequence(F.lit(0), n), segment))

    some = F.coalesce(F.size(literals) > 0, F.lit(False))
    return F.when(some, let(content.cast("binary"), cut)).otherwise(lx.elements(language, content))


def _directly_in(found: Column, owner: Column) -> Column:
    """The literals directly in the unit or in a code, as places there."""
    begin = F.greatest(owner, F.lit(0))
    mine = F.filter(found, lambda f: ~f["is_code"] & (f["owner"] == owner))
    return F.transform(mine, lambda f: F.struct((f["begin"] - begin).alias("begin"), (f["end"] - begin).alias("end")))


def pieces() -> Column:
    """The unit itself and the code inside its literals, at any depth, each as `content` with its `literals`.

    `piece` is empty for the unit; else the line, column and byte at which the code begins, and its bytes.
    """
    content = F.col("content")
    none = F.lit(None).cast("array<struct<begin:int,end:int>>")

    def piece(name: Column, text: Column, literals: Column) -> Column:
        return F.struct(name.alias("piece"), text.alias("content"), literals.alias("literals"))

    def split(found: Column) -> Column:
        whole = piece(F.lit(""), content, F.when(found.isNotNull(), _directly_in(found, F.lit(-1))).otherwise(none))

        def inner(raw: Column) -> Column:
            def named(nested: Column) -> Column:
                def one(c: Column) -> Column:
                    name = F.concat_ws(":", c["line"], c["col"], c["begin"], c["end"] - c["begin"])
                    mine = F.when(F.size(nested) > 0, _directly_in(nested, c["begin"]))
                    return piece(name, part(raw, c["begin"], c["end"]), mine)

                return F.transform(F.filter(found, lambda f: f["is_code"] & (f["end"] > f["begin"])), one)

            # Literals in the code of literals, which are few.
            return let(F.filter(found, lambda f: ~f["is_code"] & (f["owner"] >= 0)), named)

        some = F.exists(found, lambda f: f["is_code"])
        return F.when(some, F.concat(F.array(whole), let(content.cast("binary"), inner))).otherwise(F.array(whole))

    return let(lexed(), split)


def outermost() -> Column:
    """The literals directly in a unit; null if there can be none."""
    return let(lexed(), lambda found: F.when(found.isNotNull(), _directly_in(found, F.lit(-1))))
