"""Personal-data detection: matches, noise rules, excerpts, ordering and per-document summaries.

A text stays in its own row from start to finish: every rule runs as built-in expressions on the
row, so detection needs no shuffle and no Python worker. ``explode_detections`` turns the result
into one row per detection for relational work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.catalog import (
    EXCERPT_RADIUS,
    MAX_DOTS,
    MAX_PUNCTUATION,
    MIN_CSV_COMMAS,
    REGEX_CONFIDENCE,
    ROUTING_SHAPE,
    RULES,
    VIEW_PATTERNS,
    VIEW_SECRET_WORDS,
    Rule,
)
from riskloom.functions.matching import count_of, cut, hits, pieces, quoted, spans, squeezed, steps, unicode_regex

# Sorting by this struct sorts by position, then type.
DETECTION = (
    "struct<start:int,pii_type:string,stop:int,value:string,category:string,"
    "method:string,confidence:double,excerpt:string>"
)
DETECTIONS = f"array<{DETECTION}>"
FIELDS = ("pii_type", "category", "method", "confidence", "value", "start", "stop", "excerpt")


def noise_line(line: str) -> str:
    """Lines that look like filter rules, addresses, markup or number dumps."""
    size = f"char_length({line})"
    digits = f"char_length(regexp_replace({line}, {quoted(chr(92) + 'P{Nd}+')}, ''))"
    prose = quoted(r"(?U)[\p{L}\p{N}\s\x1c-\x1f]+")
    return f"""(contains({line}, '##') OR contains({line}, '#$')
        OR {count_of(line, '.')} >= {MAX_DOTS}
        OR {line} RLIKE {quoted(r'(?U)^[\s\x1c-\x1f]*!')}
        OR {line} RLIKE '(?i)http|www\\\\.'
        OR char_length(regexp_replace({line}, {prose}, '')) >= {MAX_PUNCTUATION}
        OR ({digits} * 2 > {size} AND NOT {line} RLIKE {quoted(r'\p{L}')}))"""


def csv_line(line: str) -> str:
    """Lines shaped like a financial CSV record: several commas and a routing code."""
    return f"({count_of(line, ',')} >= {MIN_CSV_COMMAS} AND {line} RLIKE {quoted(unicode_regex(ROUTING_SHAPE))})"


def _line_flags(line: str) -> str:
    return f"named_struct('noise', {noise_line(line)}, 'csv', {csv_line(line)})"


def _gate(rule: Rule) -> str:
    """A cheap condition that every text with a match satisfies; it never changes the result."""
    tests = []
    if rule.needs:
        tests.append(" OR ".join(["_dotted"] + [f"contains(_folded, {quoted(word)})" for word in rule.needs]))
    if rule.gate:
        tests.append(f"_squeezed RLIKE {quoted(rule.gate)}")
    return " AND ".join(f"({t})" for t in tests) or "true"


def _values(rule: Rule) -> str:
    found = f"regexp_extract_all(_text, {quoted(unicode_regex(rule.pattern))}, 0)"
    return f"if({_gate(rule)}, {found}, cast(array() as array<string>))"


def _choice(rules: Sequence[Rule], field: str) -> str:
    return "array(" + ", ".join(quoted(getattr(r, field)) for r in rules) + ")[s.rule]"


def _skip(rules: Sequence[Rule]) -> str:
    """Which line rule applies to a span: two types have their own, the rest share the noise rule."""
    own = {r.pii_type: i for i, r in enumerate(rules)}
    cases = []
    if "Aadhaar" in own:
        cases.append(f"WHEN x.s.rule = {own['Aadhaar']} THEN x.f.csv")
    if "Phone" in own:
        cases.append(f"WHEN x.s.rule = {own['Phone']} THEN x.f.csv AND x.s.before <> '+'")
    return f"CASE {' '.join(cases)} ELSE x.f.noise END" if cases else "x.f.noise"


def detect(
    df: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    heuristics: bool = True,
    output: str = "detections",
) -> DataFrame:
    """Add ``output``: the ordered detections of each text as an array of ``DETECTION``.

    ``heuristics=False`` keeps the matches that noise rules would drop.
    """
    passed = [f"`{c}`" for c in df.columns]
    names = {i: f"_v{i}" for i in range(len(rules))}
    gated = df.selectExpr(*passed, f"coalesce(`{text}`, '') AS _text").selectExpr(
        *passed,
        "_text",
        # Two letters that case-blind matching takes for s and i but that have no such lower case.
        "replace(replace(lower(_text), '\u017f', 's'), '\u0131', 'i') AS _folded",
        "contains(_text, 'İ') AS _dotted",
        f"{squeezed('_text')} AS _squeezed",
    )
    matched = gated.selectExpr(
        *passed, "_text", *[f"{_values(r)} AS {names[i]}" for i, r in enumerate(rules)]
    )
    patterns = {i: unicode_regex(r.pattern) for i, r in enumerate(rules)}
    stepped = matched.selectExpr(*passed, "_text", f"{steps(hits('_text', names, patterns))} AS _steps")
    spanned = stepped.selectExpr(
        *passed,
        f"{spans('_steps')} AS _spans",
        "char_length(_text) AS _len",
        f"if(size(_steps) > 0, {pieces('_text')}, NULL) AS _pieces",
        "if(size(_steps) > 0, split(_text, '\n', -1), NULL) AS _lines",
    )
    if heuristics:
        flagged = spanned.selectExpr(
            *passed, "_spans", "_len", "_pieces", "_lines", f"transform(_lines, l -> {_line_flags('l')}) AS _flags"
        )
        joined = "array_join(slice(z.l, s.line_from + 1, s.line_to - s.line_from + 1), '\n')"
        several = f"transform(array({joined}), l -> {_line_flags('l')})[0]"
        # Arrays used inside a lambda are bound to ``z`` first: named directly, the optimizer may move
        # the expression behind them into the lambda and evaluate it once per match.
        judged = (
            "transform(array(named_struct('f', _flags, 'l', _lines)), z -> "
            "transform(_spans, s -> named_struct('s', s, 'f', "
            f"if(s.line_from = s.line_to, z.f[s.line_from], {several}))))[0]"
        )
        spanned = flagged.selectExpr(
            *passed,
            "_len",
            "_pieces",
            f"transform(filter({judged}, x -> NOT ({_skip(rules)})), x -> x.s) AS _spans",
        )
    start, stop = f"greatest(s.start - {EXCERPT_RADIUS}, 0)", f"least(s.stop + {EXCERPT_RADIUS}, z.n)"
    built = f"""transform(array(named_struct('p', _pieces, 'n', _len)), z -> transform(_spans, s -> named_struct(
        'start', s.start, 'pii_type', {_choice(rules, 'pii_type')}, 'stop', s.stop, 'value', s.value,
        'category', {_choice(rules, 'category')}, 'method', 'regex',
        'confidence', double({REGEX_CONFIDENCE}), 'excerpt', {cut('z.p', start, stop)})))[0]"""
    return spanned.selectExpr(*passed, f"cast(sort_array({built}) AS {DETECTIONS}) AS `{output}`")


def dedupe(df: DataFrame, column: str = "detections") -> DataFrame:
    """Keep one detection per (type, value without case, span): the most confident, then the first.

    Works inside each row: sort once, then keep the first of each run of equal keys. One expression, so that no step between
    copies the row's detections.
    """
    ranked = f"""sort_array(transform(`{column}`, (d, i) -> named_struct(
        'start', d.start, 'pii_type', d.pii_type, 'stop', d.stop, 'folded', lower(d.value),
        'rank', -d.confidence, 'seen', i, 'd', d)))"""
    other = " OR ".join(f"NOT (r.{key} <=> z[i - 1].{key})" for key in ("start", "pii_type", "stop", "folded"))
    kept = f"transform(array({ranked}), z -> transform(filter(z, (r, i) -> i = 0 OR {other}), r -> r.d))[0]"
    return df.withColumn(column, F.expr(kept))


def dedupe_rows(df: DataFrame, doc: str = "doc_id", order: str = "method_ord") -> DataFrame:
    """The same rule on long rows: a partial aggregate per key, so repeats are combined before the shuffle.

    Keys are compared by position first, in which rows arrive, and what is kept holds each column once.
    """
    rest = [c for c in df.columns if c not in (doc, "pii_type", "start", "stop")]
    rank = [F.col("confidence").alias("_c"), (-F.col(order)).alias("_o")]
    best = F.max(F.struct(*rank, *[c for c in rest if c not in ("confidence", order)]))
    own = {"confidence": F.col("_best._c"), order: (-F.col("_best._o")).cast(df.schema[order].dataType)}
    return (
        df.groupBy(doc, "start", "stop", "pii_type", F.lower("value").alias("_folded"))
        .agg(best.alias("_best"))
        .select(doc, "pii_type", "start", "stop", *[own.get(c, F.col(f"_best.{c}")).alias(c) for c in rest])
    )


def explode_detections(df: DataFrame, *keys: str, column: str = "detections") -> DataFrame:
    """One row per detection with the given key columns; the text is not carried along."""
    return rows_of(df.select(*keys, column), *keys, column=column).select(
        *keys, *[F.col(f"_d.{name}").alias(name) for name in FIELDS]
    )


def rows_of(df: DataFrame, *keys: str, column: str) -> DataFrame:
    """One row ``_d`` per array element.

    The outer form keeps the optimizer from testing the array in a filter below, which would run the
    whole detection a second time.
    """
    return df.select(*keys, F.explode_outer(column).alias("_d")).filter("_d IS NOT NULL")


def summarize(df: DataFrame, *keys: str, column: str = "detections", backend: str = "regex") -> DataFrame:
    """Per-document parallel arrays, distinct categories and the backend; empty arrays without hits."""
    return df.selectExpr(
        *keys,
        f"{column}.pii_type AS pii_types",
        f"{column}.confidence AS confidence",
        f"{column}.excerpt AS excerpts",
        f"array_sort(array_distinct({column}.category)) AS categories",
        f"{quoted(backend)} AS backend",
    )


def _ascii_view(name: str, pattern: str, bordered: bool = True) -> str:
    """The audit view's patterns use ASCII word borders; spell them out for the JVM engine.

    For a presence test one-sided borders are enough where the neighbouring character class is made
    of word characters; only the address pattern can start with another character.
    """
    word = "[A-Za-z0-9_]"
    opening = f"(?<!{word})"
    if name == "email":
        opening = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    space = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
    closing = f"(?!{word})"
    shown = pattern.replace(r"\b", opening if bordered else "", 1).replace(r"\b", closing if bordered else "")
    return shown.replace(r"[\s-]", f"[{space}-]").replace(r"\s?", f"[{space}]?")


def presence(text: str) -> Column:
    """Audit-view types present in a text, in the catalogue's order.

    Each pattern is preceded by a cheaper necessary test: the same pattern without word borders, or a
    literal search.
    """

    def gate(name: str, pattern: str) -> str:
        if name == "email":
            return f"contains({text}, '@')"
        if name == "password":
            return " OR ".join(f"contains(g.low, {quoted(w)})" for w in VIEW_SECRET_WORDS)
        return f"g.digits RLIKE {quoted(_ascii_view(name, pattern, bordered=False).replace('{11,30}', ''))}"

    flags = ", ".join(
        f"if(({gate(name, p)}) AND {text} RLIKE {quoted(_ascii_view(name, p))}, {quoted(name)}, NULL)"
        for name, p in VIEW_PATTERNS
    )
    cheap = f"named_struct('low', lower({text}), 'digits', {squeezed(text)})"
    found = f"transform(array({cheap}), g -> array({flags}))[0]"
    return F.expr(f"filter({found}, t -> t IS NOT NULL)")


def raw_counts(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Matches per type over the whole table, before any noise rule: one narrow aggregate."""
    found = detect(df.select(text), text, rules, heuristics=False)
    types = rows_of(found.select(F.col("detections.pii_type").alias("t")), column="t")
    return types.groupBy(F.col("_d").alias("pii_type")).agg(F.count("*").alias("hits"))
