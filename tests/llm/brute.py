"""Plain versions of the operators, one text at a time, for tests only."""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter

ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = SPACE_WORDS.findall(text)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(tri)
    covered = {i + j for i, t in enumerate(tri) if many[t] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def benchmark_hits(text: str | None, items: list[tuple[str, str]], window: int = 10) -> tuple[int, int, list[str]]:
    """n_words, n_hit, item ids."""
    words = ALNUM_WORDS.findall((text or "").translate(ASCII_LOWER))
    hit, ids = set(), set()
    for item, t in items:
        w = ALNUM_WORDS.findall((t or "").translate(ASCII_LOWER))
        if not w:
            continue
        k = min(window, len(w))
        wanted = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in wanted:
                hit.update(range(i, i + k))
                if item is not None:
                    ids.add(str(item))
    return len(words), len(hit), sorted(ids)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text: str | None, k: int) -> frozenset:
    words = SPACE_WORDS.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return frozenset()
    return frozenset(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else frozenset([tuple(words)])


def jaccard_components(rows: list[tuple[int, str | None]], k: int, num: int, den: int) -> dict[int, int]:
    """doc_id: least doc_id reachable, from all pairs."""
    up = {i: i for i, _ in rows}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingle_set(t, k)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in up}
