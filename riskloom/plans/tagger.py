"""A deterministic stand-in for a token model: the label follows from the length of each word."""

from __future__ import annotations

from collections.abc import Callable


def word_length_model() -> Callable:
    """Tokens are runs of visible characters; a word of length n votes for label n modulo 9."""
    import re

    import numpy as np

    word = re.compile(r"[^ \t\r\n\f\v]+")

    def label(texts: list[str]) -> list[tuple]:
        rows = []
        for text in texts:
            spans = np.array([m.span() for m in word.finditer(text)], dtype=np.int32).reshape(-1, 2)
            size = spans[:, 1] - spans[:, 0]
            logits = np.zeros((len(size), 9), dtype=np.float32)
            logits[np.arange(len(size)), size % 9] = 1 + size % 5
            rows.append((spans[:, 0], spans[:, 1], logits))
        return rows

    return label


word_length_model.__module__ = "__main__"
