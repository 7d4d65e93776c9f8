"""Quality rules as weak supervision: rules vote or abstain, EM learns their accuracies, a posterior decides.

Every rule looks at a few counts of a text and votes 1 (good), 0 (bad) or null (abstains). A text is good or poor in one of
several kinds, and votes are independent given that: poor texts mostly fail one rule, so a single poor class would hide
the kinds that are rare. Expectation-maximisation runs over the table of distinct vote patterns (at most 3 to the number
of rules, whatever the corpus), which one aggregation counts. All per-text work stays in one row: no shuffle, no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import SPACES, UPPER, shielded, text_of, unshielded, words_of, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct")


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``COUNTS`` (long) in place of ``text``; null and empty texts count zero throughout.

    ``n_repeat_words`` are words in 5-word windows that occur twice or more in the text, the first one included. Windows
    are compared by 64-bit hashes. Very long texts take n log n steps. Columns of ``docs`` that have such a name are replaced.
    """
    keep = [c for c in docs.columns if c not in (text, *COUNTS)]
    t, w, h, d, s = (f"_q{x}" for x in "twhds")
    out = docs.select(*keep, text_of(text).alias(t))
    out = out.withColumn(w, words_of(F.col(t)))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    out = out.withColumn("_qlines", lines)

    def found(chars: str) -> Column:
        return F.length(t) - F.length(F.translate(F.col(t), chars, ""))

    n = F.size(w)
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    out = out.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        found(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_qlines") - F.size(F.array_distinct("_qlines"))).cast("long").alias("n_dup_lines"),
        F.size("_qlines").cast("long").alias("n_lines"),
        found(UPPER).cast("long").alias("n_upper"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias(h),
    )
    out = out.withColumn(d, F.size(h) - F.size(F.array_distinct(h)))
    # Only texts with an equal pair of windows sort theirs.
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn(s, F.when(F.col(d) > 0, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter(
        s,
        lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)),
    )
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("bigint").alias("n")),
        lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    return out.withColumn("n_repeat_words", covered).select(*keep, *COUNTS)


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are conditions over the counts; where neither holds, the rule abstains.

    ``kind``: what the rule finds is a kind of poor text of its own, that other rules need not notice.
    """

    name: str
    bad: str
    good: str
    kind: bool = True


RULES = (
    Rule("length", "n_words < 10", "n_words >= 25"),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 8 * n_words AND n_words >= 10"),
    Rule("symbols", "100 * n_symbols > 40 * n_words", "100 * n_symbols <= 5 * n_words AND n_words > 0"),
    Rule("capitals", "10 * n_upper > 4 * word_chars", "10 * n_upper <= 2 * word_chars AND n_words > 0"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "n_lines >= 4 AND 20 * n_dup_lines <= n_lines", False),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words", "2 * word_chars BETWEEN 7 * n_words AND 18 * n_words AND n_words > 0", False),
    Rule("variety", "n_words BETWEEN 20 AND 2000 AND 10 * n_distinct < 3 * n_words", "n_words BETWEEN 20 AND 2000 AND 2 * n_distinct > n_words", False),
)
#: Share of good texts on which a rule is believed to err before any vote, and how firmly: as if so large a share of all rows had
#: been seen to bear it out. Without such a belief a rare kind of poor text is taken for errors on good ones.
ERRORS, TRUST = 0.01, 0.5
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
GOOD = "good"


@dataclass
class Model:
    """``shares``: of good texts and of each kind of poor ones. ``bad_votes``: for each of these, the chance that a rule which
    does not abstain votes bad; on good texts that is one less the rule's accuracy, on poor ones the accuracy."""

    shares: dict[str, float]
    bad_votes: dict[str, dict[str, float]]
    iterations: int = 0


def start(rules: tuple[Rule, ...] = RULES) -> Model:
    """The belief before any vote: a rule errs on one good text of 100 and finds 90 of 100 of its own kind."""
    kinds = [r.name for r in rules if r.kind]
    chance = {GOOD: {r.name: ERRORS for r in rules}} | {k: {r.name: 0.9 if r.name == k else 0.15 for r in rules} for k in kinds}
    return Model({GOOD: 0.8} | {k: 0.2 / len(kinds) for k in kinds}, chance)


def vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), 0).when(F.expr(rule.good), 1)


def quality_of(model: Model, rules: tuple[Rule, ...], votes: dict[str, Column]) -> Column:
    """The chance that a text is good, given the votes: 1 / (1 + the odds of each kind of poor text against good).

    Each vote is named once a kind, so that the expression stays short enough to be compiled where a filter takes it over whole.
    """
    odds, good = F.lit(0.0), model.bad_votes[GOOD]
    for kind, chance in model.bad_votes.items():
        if kind == GOOD:
            continue
        log = F.lit(math.log(model.shares[kind] / model.shares[GOOD]))
        for rule in (r.name for r in rules):
            says_good, says_bad = math.log((1 - chance[rule]) / (1 - good[rule])), math.log(chance[rule] / good[rule])
            log = log + F.when(votes[rule] == 1, says_good).when(votes[rule] == 0, says_bad).otherwise(0.0)
        odds = odds + F.exp(log)
    return 1 / (1 + odds)


def fit(counted: DataFrame, rules: tuple[Rule, ...] = RULES, iterations: int = 200, weight: float = 20.0, trust: float = TRUST) -> Model:
    """Learn from every row of ``counted`` (see ``counts``) without labels; an empty table gives ``start``.

    One aggregation counts the vote patterns, of which there are 3 to the number of rules at most, whatever the corpus; the
    iterations then run over these few rows. Chances are drawn to ``start`` with the force of ``weight`` votes, those of good texts with
    the force of a share ``trust`` of all rows besides. Stops when none moves by 1e-5.
    """
    model = prior = start(rules)
    patterns = counted.groupBy(*[vote(r).alias(f"v{i}") for i, r in enumerate(rules)]).agg(F.count("*").alias("n")).collect()
    if not patterns:
        return model
    n = np.array([p.n for p in patterns], float)
    bad, voted = (np.array([[f(v) for v in p[:-1]] for p in patterns], float) for f in (lambda v: v == 0, lambda v: v is not None))
    classes, names = list(prior.shares), [r.name for r in rules]
    share = first_share = np.array([prior.shares[c] for c in classes])
    chance = first = np.array([[prior.bad_votes[c][r] for r in names] for c in classes])
    force = np.array([weight + (trust * n.sum() if c == GOOD else 0.0) for c in classes])[:, None]
    for step in range(1, iterations + 1):
        logs = np.log(share) + bad @ np.log(chance).T + (voted - bad) @ np.log(1 - chance).T
        mass = np.exp(logs - logs.max(axis=1, keepdims=True))
        mass *= (n / mass.sum(axis=1))[:, None]
        before, chance = chance, (mass.T @ bad + force * first) / (mass.T @ voted + force)
        share = (mass.sum(axis=0) + weight * first_share) / (n.sum() + weight)
        model = Model(dict(zip(classes, share.tolist(), strict=True)), {c: dict(zip(names, row, strict=True)) for c, row in zip(classes, chance.tolist(), strict=True)}, step)
        if np.abs(chance - before).max() < 1e-5:
            break
    return model


def judge(counted: DataFrame, model: Model, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """``counted`` with ``quality`` (posterior that the text is good), ``base_failed`` and ``kept``.

    A row is kept if it passes the base rules and its posterior is at least ``least``. Equal texts get equal verdicts.
    """
    voted = counted.withColumns({f"_v{i}": vote(r) for i, r in enumerate(rules)})
    quality = quality_of(model, rules, {r.name: F.col(f"_v{i}") for i, r in enumerate(rules)})
    judged = voted.select(*counted.columns, quality.alias("quality"), F.expr(BASE_FAILED).alias("base_failed"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns only. Null and empty texts go.

    The counts are taken once and written beside the rows, so that learning and judging read numbers, not texts.
    """
    rows, names = shielded(docs)
    counted = written(counts(rows.withColumn("_body", F.col(names[text])), "_body"), "counted")
    return unshielded(judge(counted, fit(counted)).filter("kept"), docs)
