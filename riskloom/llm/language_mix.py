"""Language identification as inference of a mixture: which languages, in what proportions, made a text's n-grams.

Each language is a distribution over hashed character trigrams, counted over all labelled training texts. A document's language
proportions maximise the likelihood of its trigrams and are found by expectation-maximisation. The set of languages is chosen by
penalised likelihood: starting from all, languages are dropped while the penalty saved outweighs the likelihood lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import text_of

#: Trigrams are hashed to this many bins: the model's size does not depend on the corpus.
BINS = 1 << 16
UNKNOWN = "und"
#: Log-likelihood that a language must add, for each log of the number of trigrams. Overlapping trigrams count threefold.
PENALTY = 3.0
STEPS, MOVE = 40, 1e-3
#: Characters handled at once.
CHUNK = 1 << 21

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter."""
    if not _letters:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
        _letters.append(table)
    return _letters[0]


def bins(text: str) -> np.ndarray:
    """Sorted bins of the trigrams of the lower-cased text, where runs of anything but letters are one gap; empty without a letter."""
    out = []
    text = text.lower()
    for start in range(0, len(text), CHUNK):
        # A chunk begins two characters early, so that no trigram is lost.
        codes = np.frombuffer(text[max(start - 2, 0) : start + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(letter_table()[codes], codes, 0)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = np.concatenate([[0], codes[keep], [0]]).astype(np.uint32)
        grams = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA6B) + codes[2:] * np.uint32(0xC2B2AE35)
        grams = ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        out.append(grams[codes[1:-1] != 0].astype(np.uint16))
    if not out:
        return np.zeros(0, np.uint16)
    return np.sort(np.concatenate(out), kind="stable")


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    grams = bins(text)
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.diff(np.append(first, len(grams)))


@dataclass(frozen=True)
class Model:
    """``chances``: for every bin, the probability under each of ``languages``."""

    languages: list[str]
    chances: np.ndarray

    def proportions(self, grams: np.ndarray, n: np.ndarray) -> tuple[str, float, dict[str, float]]:
        """Chief language, its share and all chosen languages' shares."""
        table = self.chances[grams]
        chosen = np.arange(len(self.languages))
        share, fit = self._em(table, n)
        penalty = PENALTY * np.log(n.sum() + 1.0)
        while len(chosen) > 1:
            if share.min() > 0.999:
                break
            rest = np.argsort(share)[1:]
            # A language with next to no share goes with no fit of its own; else the smaller set is fitted.
            if share[np.argsort(share)[0]] * n.sum() < 0.5:
                share, table, chosen = share[rest] / share[rest].sum(), table[:, rest], chosen[rest]
                fit = float(n @ np.log(table @ share))
                continue
            fewer, lower = self._em(table[:, rest], n)
            if fit - lower > penalty:
                break
            share, table, chosen, fit = fewer, table[:, rest], chosen[rest], lower
        order = np.lexsort((chosen, -share))
        shares = {self.languages[chosen[k]]: float(share[k]) for k in order}
        best = self.languages[chosen[order[0]]]
        return best, shares[best], shares

    @staticmethod
    def _em(table: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        share = np.full(table.shape[1], 1.0 / table.shape[1])
        if len(share) > 1:
            total = n.sum()
            for _ in range(STEPS):
                new = share * ((n / (table @ share)) @ table) / total
                moved = np.abs(new - share).max()
                share = new
                if moved < MOVE:
                    break
        return share, float(n @ np.log(table @ share + 1e-300))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> Model:
    """Count the trigrams of all ``rows`` with a language. Tasks sum their own counts before they are shuffled.

    What reaches the driver is at most ``BINS`` numbers a language. Without any row, the model has no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                grams, n = counted(t)
                if name not in sums:
                    sums[name] = np.zeros(BINS, np.int64)
                sums[name][grams] += n
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bin", "n"])

    rows = rows.filter(F.col(lang).isNotNull()).select(text_of(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    table = rows.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique().tolist())
    chances = np.full((BINS, len(languages)), smoothing)
    for k, name in enumerate(languages):
        own = table[table["lang"] == name]
        chances[own["bin"].to_numpy(), k] += own["n"].to_numpy()
    return Model(languages, chances / chances.sum(axis=0))


def predict(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``lang_pred``, ``score`` (the chief language's share) and ``shares`` (all chosen languages) for every row.

    Null texts and texts without a letter are ``und`` with score 0; so is everything under a model without languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column("text").to_pylist():
                grams, n = counted(t or "")
                found.append(model.proportions(grams, n) if len(grams) and model.languages else (UNKNOWN, 0.0, {}))
            names, scores, shares = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([list(s.items()) for s in shares], pa.map_(pa.string(), pa.float64()))],
                ["doc", "lang_pred", "score", "shares"],
            )

    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc long, lang_pred string, score double, shares map<string,double>").withColumnRenamed("doc", doc)
