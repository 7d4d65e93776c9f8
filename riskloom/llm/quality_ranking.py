"""A quality classifier learned by ranking: Bradley-Terry scores from preference pairs.

A pair is a good and a bad labelled text; the chance that the good one wins is the logistic function of the difference of
their scores, and scores are linear in features of the text. Weights minimise the logistic loss on feature differences. A
text is then bad if its score is below a quantile of all texts' scores: the share of bad labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import small, text_of, written

#: Labelled rows that the fit uses at most, those with the least hash of their id; every pair of it is made ``PAIRS`` times a bad row.
SAMPLE, PAIRS = 20_000, 12
#: Score at the threshold.
CUT = 0.3
SYMBOLS = "#*$%&|<>!"
FEATURES = ("length", "word_length", "symbols", "capitals", "digits", "variety", "pairs", "echo", "lines", "long_words", "stops", "commas")


def features(text: str) -> list[float]:
    """Numbers of bounded range; an empty text has no words and all zeros but the first."""
    words = text.split()
    n = len(words)
    if not n:
        return [-1.0] + [0.0] * (len(FEATURES) - 1)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    return [
        np.log10(n) - 2.0,
        min(chars / n, 20.0) / 10.0,
        min(sum(map(text.count, SYMBOLS)) / n, 3.0),
        sum(map(str.isupper, words)) / n,
        min(sum(map(text.count, "0123456789")) / chars, 1.0),
        # Chance that two words drawn from the whole text differ: unlike the share of distinct words it does not fall with length.
        1.0 - sum(c * (c - 1) for c in counts.values()) / max(n * (n - 1), 1),
        len(set(zip(words, words[1:], strict=False))) / n,
        sum(map(eq, words, words[1:])) / n,
        1.0 - len(set(lines)) / len(lines),
        float(len(counts) < 3),
        min(text.count(". ") / n, 0.3),
        min(text.count(",") / n, 0.3),
    ]


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights


def fit_pairs(x: np.ndarray, good: np.ndarray, l2: float = 1e-3, steps: int = 40, seed: int = 7) -> Ranker:
    """Newton steps on the mean logistic loss of feature differences; without rows of both kinds, all scores are 0."""
    k = x.shape[1]
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(k), np.ones(k))
    plus, minus = x[good == 1], x[good == 0]
    w = np.zeros(k)
    if len(plus) and len(minus):
        pick = np.random.default_rng(seed)
        d = (plus[pick.integers(0, len(plus), PAIRS * len(minus))] - np.repeat(minus, PAIRS, axis=0)) / scale
        for _ in range(steps):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad = l2 * w - d.T @ p / len(d)
            hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + l2 * np.eye(k)
            step = np.linalg.solve(hess, grad)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
    return Ranker(mean, scale, w)


def _measured(rows: DataFrame, ranker: Ranker | None) -> DataFrame:
    """``doc`` and the features of ``text`` or, with a ranker, its raw score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
            value = pa.array(list(x), pa.list_(pa.float64())) if ranker is None else pa.array(ranker(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), value], ["doc", "value"])

    return rows.mapInArrow(run, f"doc long, value {'array<double>' if ranker is None else 'double'}")


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> tuple[Ranker, float]:
    """The ranker and the share of bad labels, from labelled rows: all of them for the share, at most ``sample`` for the weights.

    Labels that are null or stand at ids that ``docs`` lacks teach nothing. Repeated labels of an id count once, the worst.
    """
    marks = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(F.col(doc).cast("long").alias("doc")).agg(F.min(label).alias("good"))
    marks = written(marks, "labels")
    share = marks.agg(F.avg((F.col("good") == 0).cast("double"))).first()[0]
    chosen = F.broadcast(written(marks.orderBy(F.xxhash64("doc"), "doc").limit(sample), "label_sample"))
    rows = docs.select(F.col(doc).cast("long").alias("doc"), text_of(text).alias("text")).join(chosen.select("doc"), "doc", "left_semi")
    # At most ``sample`` narrow rows reach the driver.
    taught = _measured(rows, None).groupBy("doc").agg(F.min("value").alias("value")).join(chosen, "doc").orderBy("doc").toPandas()
    x = np.array(taught["value"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit_pairs(x, taught["good"].to_numpy()), 0.0 if share is None else float(share)


def score(docs: DataFrame, ranker: Ranker, bad_share: float, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``score`` (0 to 1), ``predicted`` (1 from ``CUT`` up) for every row of ``docs``; null texts score as empty ones.

    The score is the logistic function of the distance to the ``bad_share`` quantile of all raw scores, moved so that the quantile
    itself scores ``CUT``. Equal texts score equally.
    """
    raw = written(_measured(docs.select(F.col(doc).cast("long").alias("doc"), text_of(text).alias("text")), ranker), "raw_scores")
    at = raw.agg(F.percentile_approx("value", F.lit(bad_share), F.lit(20_000))).first()[0] or 0.0
    lifted = F.col("value") - at + float(np.log(CUT / (1 - CUT)))
    out = raw.withColumn("score", F.when(F.col("value") >= at, F.greatest(1 / (1 + F.exp(-lifted)), F.lit(CUT))).otherwise(1 / (1 + F.exp(-lifted))))
    return out.select(F.col("doc").alias(doc), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
