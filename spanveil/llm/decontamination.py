"""Benchmark decontamination with a generalised suffix automaton.

All test items, as word sequences, form one automaton. A document's words stream
through it; the length of the longest suffix that occurs in an item is known at
each word. A matched length of at least the window marks words as hit; the
automaton's states also know which items hold that window. Items shorter than
the window count as one window each.

The automaton is broadcast, so its size is bounded: beyond ``max_words`` item
words the benchmark is split into several automata. They are built one after the
other, and each has a pass of its own over the documents, whose result is
written; so neither the driver nor a worker ever holds two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import NON_ALNUM, Words, column_bytes, pieces, shingles
from .rows import with_text
from .scratch import Scratch, bounded_batches

FIELDS = "n_words: bigint, n_hit: bigint, items: array<string>"
CLEAN = ", clean: string"


@dataclass
class Automaton:
    """States of a generalised suffix automaton over word hashes, with what a scan needs to know."""

    window: int
    shortest: int
    grams: np.ndarray  # sorted hashes of the items' q-grams
    q: int
    step: list[dict[int, int]]
    link: list[int]
    length: list[int]
    window_state: dict[int, int]  # state with strings of >= window words: the state of its suffix of just that many
    window_items: dict[int, list[str]]
    short: dict[int, list[tuple[int, str | None]]]  # state: (length, id) of short items that end there

    def scan(self, words: list[int], base: int, hit: np.ndarray, items: set[str]) -> None:
        """Mark hit words of a stretch and collect the items that are met."""
        step, link, length, at, l = self.step, self.link, self.length, 0, 0
        seen: set[int] = set()
        for i, w in enumerate(words):
            while at and w not in step[at]:
                at = link[at]
                l = length[at]
            if w in step[at]:
                at = step[at][w]
                l += 1
            else:
                l = 0
                continue
            if l >= self.window:
                hit[base + i - self.window + 1 : base + i + 1] = True
                seen.add(self.window_state[at])
            if at in self.short:
                for n, item in self.short[at]:
                    if n <= l:
                        hit[base + i - n + 1 : base + i + 1] = True
                        if item is not None:
                            items.add(item)
        for s in seen:
            items.update(self.window_items[s])


def build(items: list[tuple[str | None, np.ndarray]], window: int) -> Automaton:
    """The automaton of (id, word hashes) items without empty ones."""
    step: list[dict[int, int]] = [{}]
    link, length, own = [-1], [0], [set()]

    def grow(last: int, w: int) -> int:
        def split(p: int, q: int) -> int:
            clone = len(step)
            step.append(dict(step[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            own.append(set())
            link[q] = clone
            while p >= 0 and step[p].get(w) == q:
                step[p][w] = clone
                p = link[p]
            return clone

        if w in step[last]:
            q = step[last][w]
            return q if length[q] == length[last] + 1 else split(last, q)
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        own.append(set())
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = cur
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[cur] = q if length[q] == length[p] + 1 else split(p, q)
        return cur

    ends: list[tuple[int, int, str | None]] = []
    for item, hashes in items:
        last = 0
        for w in hashes.tolist():
            last = grow(last, w)
        if len(hashes) < window:
            ends.append((last, len(hashes), item))
    for item, hashes in items:  # states are final now
        at = 0
        for w in hashes.tolist():
            at = step[at][w]
            if item is not None:
                own[at].add(item)
    order = sorted(range(1, len(step)), key=length.__getitem__)
    for s in reversed(order):
        if link[s] > 0:
            own[link[s]] |= own[s]
    states = {s: s if length[link[s]] < window else -1 for s in order if length[s] >= window}
    for s in order:
        if states.get(s) == -1:
            states[s] = states[link[s]]
    short: dict[int, list] = {}
    for s, n, item in ends:
        short.setdefault(s, []).append((n, item))
    for s in order:
        if link[s] in short:
            short[s] = short.get(s, []) + short[link[s]]
    shortest = min([window, *(len(h) for _, h in items)])
    q = min(3, shortest)
    grams = [shingles(_as_words(h), q)[1] for _, h in items]
    return Automaton(window, shortest, np.unique(np.concatenate(grams)), q, step, link, length, states, {s: sorted(own[s]) for s in set(states.values())}, short)


class _as_words:
    """Word hashes of one item in the shape that ``shingles`` takes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.counts, self.bounds = hashes, np.array([len(hashes)]), np.array([0, len(hashes)])


def automata(benchmark: DataFrame, window: int = 10, max_words: int = 100_000) -> Iterator[Automaton]:
    """Automata of all items, each of about ``max_words`` words at most; items without words are left out.

    Items stream to the driver partition by partition, as they must all be in
    some automaton; only the word hashes of the one being built are kept.
    """
    held, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        data, offsets = column_bytes(pa.array([r["t"]], pa.string()))
        h = Words(data, offsets, NON_ALNUM, lower=True).hashes
        if len(h):
            held.append((r["i"], h))
            n += len(h)
        if n >= max_words:
            yield build(held, window)
            held, n = [], 0
    if held:
        yield build(held, window)


def _candidates(auto: Automaton, words: Words) -> list[tuple[int, int]]:
    """Stretches of words, each within a text, outside which nothing can match."""
    windows = np.maximum(words.counts - auto.q + 1, 0)
    docs, h = shingles(words, auto.q, whole_if_short=False)
    if not len(h):
        return []
    at = np.arange(len(docs)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(words.bounds[:-1], windows)
    k = np.minimum(np.searchsorted(auto.grams, h), len(auto.grams) - 1)
    known = auto.grams[k] == h
    pos, of = at[known], docs[known]
    if not len(pos):
        return []
    cut = np.flatnonzero((np.diff(pos) != 1) | (np.diff(of) != 0)) + 1
    lo, hi = pos[np.concatenate([[0], cut])], pos[np.concatenate([cut - 1, [len(pos) - 1]])] + auto.q
    long = hi - lo >= auto.shortest
    return list(zip(lo[long].tolist(), hi[long].tolist(), strict=True))


def _scan(auto: Automaton, column: pa.Array) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    """(row, its hit words, items met) for each text in which something matches."""
    data, offsets = column_bytes(column)
    for lo, _, part, offs in pieces(data, offsets):
        words = Words(part, offs, NON_ALNUM, lower=True)
        hit = np.zeros(len(words.starts), bool)
        met: dict[int, set[str]] = {}
        for s, e in _candidates(auto, words):
            d = int(np.searchsorted(words.bounds, s, "right")) - 1
            auto.scan(words.hashes[s:e].tolist(), s, hit, met.setdefault(d, set()))
        for d, items in met.items():
            own = np.flatnonzero(hit[words.bounds[d] : words.bounds[d + 1]])
            if len(own):
                yield lo + d, own, items


def _finish(column: pa.Array, found: dict[int, tuple[np.ndarray, set[str]]], with_clean: bool) -> list[pa.Array]:
    """The result columns, from all hits of a batch."""
    data, offsets = column_bytes(column)
    n_words, n_hit, items, clean = [], [], [], []
    for lo, hi, part, offs in pieces(data, offsets):
        words = Words(part, offs, NON_ALNUM, lower=True)
        n_words += words.counts.tolist()
        for d in range(hi - lo):
            own, met = found.get(lo + d, ((), ()))
            n_hit.append(len(own))
            items.append(sorted(met))
            if with_clean and len(own):
                marks = np.zeros(words.counts[d], bool)
                marks[own] = True
                clean.append(_without(part[offs[d] : offs[d + 1]].tobytes(), words, d, marks, int(offs[d])).decode("utf-8"))
            else:
                clean.append(None)
    out = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
    return [*out, pa.array(clean, pa.string())] if with_clean else out


def find_benchmark_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 100_000, keep: list[str] | None = None, with_clean: bool = True) -> DataFrame:
    """(row, got): the kept columns, and n_words, n_hit, items (ids, sorted as strings) and, for a text with hits, the text without hit spans.

    Words are runs of ASCII letters and digits, A-Z lower-cased, and of
    characters beyond ASCII. Null and empty texts have no words. Items with the
    same id count once, items with a null id hit but are not listed. Without
    items nothing is hit; an empty table gives an empty one. Repeated rows are
    scanned alike, texts of any length whole, and other columns of any name pass
    through. Of several automata, each pass is written to the shared folder and
    takes the place of the one before.
    """
    sc, fields = docs.sparkSession.sparkContext, FIELDS + CLEAN * with_clean
    autos = automata(benchmark, window, max_words)
    one, more = next(autos, None), next(autos, None)
    if more is None:
        only = [] if one is None else [sc.broadcast(one)]
        return with_text(docs, lambda c: _finish(c, {i: (own, met) for b in only for i, own, met in _scan(b.value, c)}, with_clean), fields, keep=keep)
    bounded_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    row = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(0).alias("_"))
    seen = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    scratch, done = Scratch(docs.sparkSession, "decontamination"), None
    for auto in chain((one, more), autos):
        held = sc.broadcast(auto)
        seen = scratch.save(_pass(seen, held))
        held.destroy()
        scratch.drop(done)
        done = seen
        del auto

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)
            cols = _finish(batch.column("text"), {i: (sorted(set(h)), set(m)) for i, (h, m) in enumerate(pairs) if h}, with_clean)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.StructArray.from_arrays(cols, names)], ["row", "got"])

    got = T._parse_datatype_string(f"struct<{fields}>")
    names = got.fieldNames()
    return seen.mapInArrow(finish, T.StructType([seen.schema["row"], T.StructField("got", got)]))


def _pass(seen: DataFrame, auto) -> DataFrame:
    """``seen`` with the hits and items of one more automaton."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for i, own, met in _scan(auto.value, batch.column("text")):
                hits[i] += own.tolist()
                items[i] += list(met)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["row", "text", "hits", "items"])

    return seen.mapInArrow(scan, seen.schema)


def _without(text: bytes, words: Words, d: int, own: np.ndarray, base: int) -> bytes:
    edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
    first = words.starts[words.bounds[d] :][np.flatnonzero(edge == 1)] - base
    last = words.ends[words.bounds[d] :][np.flatnonzero(edge == -1) - 1] - base
    out, at = [], 0
    for s, e in zip(first.tolist(), last.tolist(), strict=True):
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """Documents with hit spans cut from their text (n_chars follows, if there), without those of which more than ``max_coverage`` is hit."""
    found = find_benchmark_spans(docs, benchmark, window).where(F.col("got.n_hit") <= F.col("got.n_words") * max_coverage)
    dirty = F.col("got.n_hit") > 0
    new = {"text": F.when(dirty, F.col("got.clean")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(dirty, F.char_length("got.clean")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def items_sha256(items: F.Column) -> F.Column:
    return F.sha2(F.array_join(items, ","), 256)


def sha256_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
