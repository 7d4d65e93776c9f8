"""Each operator's contract once more, one text at a time in plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def quality_counts(text: str | None) -> dict[str, int]:
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(5)}
    seen: set[str] = set()
    twice = 0
    for line in (text or "").split("\n"):
        if words(line):
            twice += line in seen
            seen.add(line)
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": twice,
        "n_repeat_words": len(covered),
    }


def source_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Targets by literal resharing of what is above three times a source's size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        rest = total - sum(stopped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: 3.0 * sizes[s] for s in over}


def line_dedup(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    def key(line: str) -> str:
        return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)

    holders: dict[str, set[int]] = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]]) -> dict[int, tuple]:
    def split(text: str | None) -> list[str]:
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER)) if w]

    windows: dict[tuple, set[str]] = defaultdict(set)
    for name, text in items:
        w = split(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(name))
    lengths = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        w, hit, named = split(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    named |= found
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(named), digest, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def shingles(text: str | None) -> frozenset:
    w = words((text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def similar_groups(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    root = {d: d for d in sets}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        both = Counter(o for x in s for o in holders[x] if o < d)
        for o, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def token_ids(docs: list[tuple[int, str | None]], path: str) -> dict[int, tuple[int, int, int]]:
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(path), {}, 0
    for d, t in sorted(docs):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out[d] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    return out


def greedy_pieces(word: str, first: set[str], later: set[str], mark: bool) -> int:
    """Longest piece first; a character that no piece covers counts its bytes; the mark alone is a piece."""
    n, i = 0, 0
    while i < len(word):
        known = first if i == 0 else later
        size = next((k for k in range(len(word) - i, 0, -1) if word[i : i + k] in known), 0)
        if size:
            n, i = n + 1, i + size
        elif i == 0 and mark:
            n += 1
            mark, first = False, later
        else:
            n, i = n + len(word[i].encode()), i + 1
    return n
