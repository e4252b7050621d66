"""Weak supervision for quality: rules vote or abstain, a label model weighs them.

Each rule looks at counts of one text and votes 1 (good), 0 (bad) or abstains.
Documents with the same votes are alike to the model, so the corpus enters it as
a histogram over vote patterns (at most 3**rules rows, over all documents).
Expectation-maximisation on the histogram estimates, for each class, how often
each rule votes which way; a document's posterior is that of its pattern.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import CONTINUATION, NEWLINE, SPACES, U64, Words, byte_set, column_bytes, mix64, per_text, pieces, range_hashes, shingles
from .rows import with_text
from .scratch import Scratch

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_upper", "n_letters", "n_digits", "n_bangs", "n_short_words")
FIELDS = ", ".join(f"{c}: bigint" for c in COUNTS)

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER, _DIGITS = byte_set((65, 90)), byte_set((48, 57))
#: ASCII letters, and first bytes of characters beyond Latin-1's signs but for the blocks of punctuation and forms.
_LETTERS = byte_set((65, 90), (97, 122), (0xC3, 0xE1), (0xE3, 0xEE), (0xF0, 0xF4))


def letters(data: np.ndarray) -> np.ndarray:
    """Whether a letter begins at each byte. Signs of CJK scripts and pictographs aren't letters."""
    out = _LETTERS[data]
    out[:-1] &= ~(((data[:-1] == 0xE3) & (data[1:] == 0x80)) | ((data[:-1] == 0xF0) & (data[1:] == 0x9F)))
    return out


_ENDS = np.isin(np.arange(256), list(b".!?:;\"')"))


def _repeats(docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each (text, key) stands more than once."""
    with np.errstate(over="ignore"):
        both = mix64(keys + docs.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(both)
    same = both[order[1:]] == both[order[:-1]]
    out = np.zeros(len(both), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def text_counts(column: pa.Array) -> list[pa.Array]:
    """The counts of ``COUNTS`` for a batch of texts; a null text counts as empty."""
    data, offsets = column_bytes(column)
    out = np.zeros((len(COUNTS), len(offsets) - 1), np.int64)
    for lo, hi, part, offs in pieces(data, offsets):
        words = Words(part, offs, SPACES)
        bounds = words.bounds
        n = len(words.starts)
        docs, tri = shingles(words, 3, whole_if_short=False)
        windows = np.maximum(words.counts - 2, 0)
        at = np.arange(len(docs)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(bounds[:-1], windows)
        again = at[_repeats(docs, tri)] if len(tri) else at
        covered = np.zeros(n + 3, bool)
        for j in range(3):
            covered[again + j] = True
        lines = Words(part, offs, NEWLINE)
        word_at = np.zeros(len(part) + 1, np.int64)
        np.cumsum(words.inside, out=word_at[1:])
        full = word_at[lines.ends] > word_at[lines.starts]
        starts, ends, of = lines.starts[full], lines.ends[full], lines.docs[full]
        dup = np.zeros(len(starts), bool)
        if len(starts):
            with np.errstate(over="ignore"):
                h = mix64(range_hashes(part, starts, ends) + of.astype(U64) * U64(0x9E3779B97F4A7C15))
            dup[:] = True
            dup[np.unique(h, return_index=True)[1]] = False
        tail = ends.copy()  # the last byte that is not white space
        if len(tail):
            tail = words.ends[np.searchsorted(words.ends, ends, "right") - 1] if n else tail
        ended = _ENDS[part[tail - 1]] if len(tail) else dup
        size = words.ends - words.starts
        short = (size == 2) | (size == 3)
        line_sums = lambda flags: np.bincount(of[flags], minlength=len(offs) - 1)  # noqa: B023, E731
        out[:, lo:hi] = (
            words.counts,
            per_text(words.inside & ~CONTINUATION[part], offs),
            per_text(_SYMBOLS[part], offs),
            line_sums(dup),
            per_text(covered[:n], bounds),
            line_sums(slice(None)),
            line_sums(ended),
            per_text(_UPPER[part], offs),
            per_text(letters(part), offs),
            per_text(_DIGITS[part], offs),
            per_text(part == 33, offs),
            per_text(short, bounds),
        )
    return [pa.array(x) for x in out]


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(2)


def votes(c) -> dict[str, Column]:
    """The rules. ``c(name)`` is a count's column; 0 bad, 1 good, 2 abstains."""
    words, lines, letters = c("n_words"), c("n_lines"), c("n_letters")
    return {
        "symbols": _vote(c("n_symbols") * 10 > words, c("n_symbols") * 50 < words),
        "upper": _vote(c("n_upper") * 5 > letters * 2, c("n_upper") * 20 < letters * 3),
        "bangs": _vote(c("n_bangs") * 5 > words, c("n_bangs") * 50 < words),
        "repeats": _vote(c("n_repeat_words") * 20 > words * 7, c("n_repeat_words") * 10 < words),
        "dup_lines": _vote((c("n_dup_lines") * 10 > lines * 3) & (lines > 2), (c("n_dup_lines") == 0) & (lines > 3)),
        "word_length": _vote((c("word_chars") < words * 2) | (c("word_chars") > words * 15), (c("word_chars") >= words * 3) & (c("word_chars") <= words * 10)),
        "letters": _vote(letters * 5 < c("word_chars") * 3, letters * 20 > c("word_chars") * 17),
        "short_words": _vote(c("n_short_words") * 10 < words, c("n_short_words") * 5 > words),
        "ended": _vote((c("n_ended") * 5 < lines) & (lines > 3), c("n_ended") * 2 > lines),
    }


N_RULES = 9


def pattern(c) -> Column:
    """Votes as one number, a base-3 digit for each rule."""
    out = F.lit(0)
    for v in votes(c).values():
        out = out * 3 + v
    return out.cast("int")


@dataclass(frozen=True)
class LabelModel:
    """rates[y, r, v]: how often rule r votes v on class y; prior of class 1; posterior by pattern."""

    prior: float
    rates: np.ndarray
    posterior: dict[int, float]


def fit_label_model(histogram: dict[int, int], rounds: int = 200) -> LabelModel:
    """EM for a two-class model with independent rules.

    It starts from patterns without a bad vote as good; a pseudo-count for each
    outcome keeps rates off 0. An empty histogram gives the start.
    """
    patterns = np.array(sorted(histogram), np.int64)
    weight = np.array([histogram[int(p)] for p in patterns], float)
    digits = np.stack([patterns // 3 ** (N_RULES - 1 - r) % 3 for r in range(N_RULES)], 1) if len(patterns) else np.zeros((0, N_RULES), int)
    one_hot = np.eye(3)[digits]
    good = np.where((digits == 0).any(1), 0.05, 0.95)
    prior, rates = 0.5, np.full((2, N_RULES, 3), 1 / 3)
    for _ in range(rounds):
        both = np.stack([1 - good, good]) * weight
        rates = np.einsum("yp,prv->yrv", both, one_hot) + 1
        rates /= rates.sum(2, keepdims=True)
        prior = float((both[1].sum() + 1) / (weight.sum() + 2))
        score = np.log([[1 - prior], [prior]]) + np.einsum("prv,yrv->yp", one_hot, np.log(rates))
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if len(new) == 0 or np.abs(new - good).max() < 1e-9:
            good = new
            break
        good = new
    return LabelModel(prior, rates, {int(p): float(g) for p, g in zip(patterns, good, strict=True)})


def counts_of(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(row, got): the kept columns and the counts of each text."""
    return with_text(docs, text_counts, FIELDS, keep=keep)


def label_model(counted: DataFrame) -> LabelModel:
    """The model of a table from ``counts_of``; at most 3**rules rows reach the driver."""
    rows = counted.groupBy(pattern(lambda n: F.col(f"got.{n}")).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    return fit_label_model({r["p"]: r["n"] for r in rows})


def judge(counted: DataFrame, model: LabelModel, least: float = 0.5) -> DataFrame:
    """Adds base_failed, quality_prob and kept. kept is false where the base rule fails, else whether the posterior reaches ``least``.

    Base rule: fewer than 50 words, or more than half of them in repeated
    3-word windows. Null and empty texts have no words and fail it. Rows with the
    same votes, so repeated ones too, have the same posterior; one of exactly
    ``least`` is kept. An empty table gives an empty one. Kept columns of any name
    are fields of ``row``.
    """
    spark = counted.sparkSession
    known = spark.createDataFrame(sorted(model.posterior.items()) or [(-1, 0.0)], "p int, quality_prob double")
    out = counted.withColumn("p", pattern(lambda n: F.col(f"got.{n}"))).join(F.broadcast(known), "p", "left")  # 3**rules rows at most
    failed = (F.col("got.n_words") < 50) | (F.col("got.n_repeat_words") * 100 > F.col("got.n_words") * 50)
    return out.select("row", "got", failed.alias("base_failed"), "quality_prob", (~failed & (F.coalesce("quality_prob", F.lit(0.0)) >= least)).alias("kept"))


def filter_quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that are kept, with their own columns. Texts are counted once: rows with their counts are written."""
    counted = Scratch(docs.sparkSession, "quality").save(counts_of(docs))
    return judge(counted, label_model(counted), least).where("kept").select("row.*")
