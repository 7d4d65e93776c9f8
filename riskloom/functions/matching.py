"""Find every match of a pattern together with its position, inside Spark expressions.

``regexp_extract_all`` gives the matches and ``split`` the gaps between them; the position of a
match is the running length of everything before it. Running sums are folded over blocks of
``BLOCK`` matches so the work stays close to linear for texts with very many matches.

Expressions with lambdas are written as SQL text: it parses in one step, where a tree of Column
calls costs one round trip to the JVM per node.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
PIECE = 128

SPAN = "struct<rule:int,start:int,stop:int,line_from:int,line_to:int,before:string,value:string>"


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unicode_regex(pattern: str) -> str:
    """Case-blind matching with Unicode word, digit and space classes.

    The dotted capital I and the Kelvin sign fold to letters of the range ``A-Z`` and count as such.
    """
    return "(?iU)" + pattern.replace("A-Z", "A-Z\u0130\u212a")


def squeezed(text: str) -> str:
    """Digits with the eight characters on either side; longer stretches without digits are cut out.

    Whatever a short pattern around digits finds in the text it also finds here, in far fewer characters.
    """
    stretch = r"(?s)(\P{Nd}{8})\P{Nd}+(\P{Nd}{8})"
    return f"regexp_replace({text}, {quoted(stretch)}, '$1~$2')"


def count_of(text: str, literal: str) -> str:
    """How often a one-character literal occurs."""
    return f"(char_length({text}) - char_length(replace({text}, {quoted(literal)}, '')))"


def hits(text: str, values: dict[int, str], patterns: dict[int, str]) -> str:
    """One entry per pattern that matched: its number, matches and the gaps before them."""
    entries = ", ".join(
        f"named_struct('rule', {i}, 'vals', {values[i]}, 'gaps', "
        f"if(size({values[i]}) > 0, split({text}, {quoted(patterns[i])}, -1), cast(array() as array<string>)))"
        for i in values
    )
    return f"filter(array({entries}), h -> size(h.vals) > 0)"


def steps(found: str) -> str:
    """Lengths and line counts of each gap and match, so that later folds only add integers."""
    return f"""transform({found}, h -> named_struct('rule', h.rule, 'steps', transform(h.vals, (v, i) -> named_struct(
        'gap', char_length(h.gaps[i]), 'gap_lines', {count_of('h.gaps[i]', chr(10))},
        'len', char_length(v), 'lines', {count_of('v', chr(10))},
        'before', if(h.gaps[i] <> '', right(h.gaps[i], 1), if(i > 0, right(h.vals[i - 1], 1), '')),
        'value', v))))"""


def spans(stepped: str) -> str:
    """``array<SPAN>`` of all matches; offsets count code points from 0, ``stop`` is exclusive."""
    block = f"""aggregate(slice(r.steps, at, {BLOCK}),
        named_struct('pos', 0, 'line', 0, 'spans', cast(array() as array<{SPAN}>)),
        (a, s) -> named_struct(
            'pos', a.pos + s.gap + s.len, 'line', a.line + s.gap_lines + s.lines,
            'spans', concat(a.spans, array(named_struct(
                'rule', r.rule, 'start', a.pos + s.gap, 'stop', a.pos + s.gap + s.len,
                'line_from', a.line + s.gap_lines, 'line_to', a.line + s.gap_lines + s.lines,
                'before', s.before, 'value', s.value)))))"""
    joined = f"""aggregate(transform(sequence(1, size(r.steps), {BLOCK}), at -> {block}),
        named_struct('pos', 0, 'line', 0, 'parts', cast(array() as array<array<{SPAN}>>)),
        (a, b) -> named_struct(
            'pos', a.pos + b.pos, 'line', a.line + b.line,
            'parts', concat(a.parts, array(transform(b.spans, s -> named_struct(
                'rule', s.rule, 'start', s.start + a.pos, 'stop', s.stop + a.pos,
                'line_from', s.line_from + a.line, 'line_to', s.line_to + a.line,
                'before', s.before, 'value', s.value))))),
        a -> flatten(a.parts))"""
    return f"flatten(transform({stepped}, r -> {joined}))"


def pieces(text: str, width: int = PIECE) -> str:
    """Cut a text into consecutive pieces of ``width`` code points in one pass; a short text is its only piece."""
    whole = f"{text} <> '' AND char_length({text}) <= {width}"
    return f"if({whole}, array({text}), regexp_extract_all({text}, '(?s).{{1,{width}}}', 0))"


def cut(parts: str, start: str, stop: str, width: int = PIECE) -> str:
    """``text[start:stop]`` read from the pieces of a text, without scanning it from the front."""
    first = f"(({start}) div {width})"
    last = f"((({stop}) - 1) div {width})"
    window = f"array_join(slice({parts}, int({first} + 1), int(greatest({last} - {first} + 1, 0))), '')"
    return f"substring({window}, int(({start}) - {first} * {width} + 1), ({stop}) - ({start}))"


def any_of(column: Column, markers: tuple[str, ...]) -> Column:
    """True when the text contains one of the literal markers."""
    tests = [F.contains(column, F.lit(marker)) for marker in markers]
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result
