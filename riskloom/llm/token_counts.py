"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node knows where the longest-match scan goes on when the next character has no edge (its failure
link) and how many pieces that step finishes (its popped-token count), so a word's number of pieces is a sum of counters:
no piece is ever built and no character is read twice. Pieces that begin a word carry a mark (U+2581). A character that
no piece covers counts as its UTF-8 bytes, and the scan goes on behind it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import text_of

MARK = "▁"
#: Words whose counts a worker remembers; beyond, it forgets all.
MEMO = 400_000


class Automaton:
    """Nodes are numbers; node 0 stands before a word's first character, node 1 between two pieces."""

    def __init__(self, pieces: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        self.depth, self.root = [0, 0], [0, 1]
        final = [False, False]
        for piece in pieces:
            node, rest = (0, piece[1:]) if piece[:1] == MARK else (1, piece)
            if not rest:
                final[node] = True  # the mark alone
                continue
            for c in rest:
                if c not in self.edges[node]:
                    self.edges[node][c] = len(self.edges)
                    self.edges.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.root.append(self.root[node])
                    final.append(False)
                node = self.edges[node][c]
            final[node] = True
        # Where no edge goes on from a node: pieces that are then finished, and the node that holds the rest; -1: no piece fits.
        self.pops, self.link = [0] * len(self.edges), [-1] * len(self.edges)
        if final[0]:
            self.pops[0], self.link[0] = 1, 1
        layer = [0, 1]
        while layer:
            below = []
            for node in layer:
                for c, child in self.edges[node].items():
                    below.append(child)
                    if final[child]:
                        self.pops[child], self.link[child] = 1, 1
                    else:
                        at, popped = self.link[node], self.pops[node]
                        while at >= 0 and c not in self.edges[at]:
                            popped, at = popped + self.pops[at], self.link[at]
                        if at >= 0:
                            self.pops[child], self.link[child] = popped, self.edges[at][c]
            layer = below

    def count(self, word: str) -> int:
        """Pieces of ``word`` under greedy longest match."""
        edges, pops, link, depth = self.edges, self.pops, self.link, self.depth
        total, node, i, n = 0, 0, 0, len(word)
        while i < n or node > 1:
            if i < n and (to := edges[node].get(word[i])) is not None:
                node = to
                i += 1
            elif link[node] >= 0:
                total += pops[node]
                node = link[node]
            else:
                # Somewhere in the held text no piece fits: the one step that looks at characters again.
                begun = i - depth[node]
                length = self._longest(word, begun, self.root[node])
                if self.root[node] == 0 and not length and link[0] == 1:
                    total += 1  # the mark alone
                    length = self._longest(word, 0, 1)
                total += 1 if length else len(word[begun].encode("utf-8", "surrogatepass"))
                i, node = begun + max(length, 1), 1
        return total

    def _longest(self, word: str, begun: int, node: int) -> int:
        best = 0
        for k in range(begun, len(word)):
            if (node := self.edges[node].get(word[k], -1)) < 0:
                break
            if self.link[node] == 1:
                best = k - begun + 1
        return best


def load_pieces(path: str) -> list[str]:
    """Ordinary pieces of a public vocabulary: no control, unknown or byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not any(f(i) for f in special)]


_state: dict = {}


def _loaded(vocabulary: str) -> tuple[Automaton, dict[str, int]]:
    """A worker's automaton and the counts of words that it remembers: reached by name, so tasks of one worker share them."""
    if vocabulary not in _state:
        _state[vocabulary] = (Automaton(load_pieces(vocabulary)), {})
    return _state[vocabulary]


def token_counts(docs: DataFrame, vocabulary: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``n_words``, ``n_tokens`` (long) for every row: words are runs without white space, each counted by the automaton.

    Null and empty texts have no words; repeated rows are counted each time; words of any length take time in proportion.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _loaded(vocabulary)
        for batch in batches:
            words, tokens = [], []
            for t in batch.column("text").to_pylist():
                found = Counter(t.split())
                if len(known) > MEMO:
                    known.clear()
                for w in [w for w in found if w not in known]:
                    known[w] = automaton.count(w)
                words.append(found.total())
                tokens.append(sum(n * known[w] for w, n in found.items()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc", "n_words", "n_tokens"])

    rows = docs.select(F.col(doc).cast("long").alias("doc"), text_of(text).alias("text"))
    return rows.mapInArrow(count, "doc long, n_words long, n_tokens long").withColumnRenamed("doc", doc)
