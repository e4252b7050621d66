"""Verdicts against the posterior of plain votes, ties, repeated rows and clashing names."""

import numpy as np
import pyarrow as pa

from spanveil.llm import quality_rules


def _plain_votes(count):
    """0 bad, 1 good, 2 abstains, from one text's counts."""
    w, lines, letters, chars = count["n_words"], count["n_lines"], count["n_letters"], count["word_chars"]
    pairs = (
        (count["n_symbols"] * 10 > w, count["n_symbols"] * 50 < w),
        (count["n_upper"] * 5 > letters * 2, count["n_upper"] * 20 < letters * 3),
        (count["n_bangs"] * 5 > w, count["n_bangs"] * 50 < w),
        (count["n_repeat_words"] * 20 > w * 7, count["n_repeat_words"] * 10 < w),
        (count["n_dup_lines"] * 10 > lines * 3 and lines > 2, count["n_dup_lines"] == 0 and lines > 3),
        (chars < w * 2 or chars > w * 15, w * 3 <= chars <= w * 10),
        (letters * 5 < chars * 3, letters * 20 > chars * 17),
        (count["n_short_words"] * 10 < w, count["n_short_words"] * 5 > w),
        (count["n_ended"] * 5 < lines and lines > 3, count["n_ended"] * 2 > lines),
    )
    return [0 if bad else 1 if good else 2 for bad, good in pairs]


def test_verdicts_equal_plain_ones(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counted = quality_rules.counts_of(docs, keep=["doc_id"])
    rows = {r.row.doc_id: r.got.asDict() for r in counted.collect()}
    votes = {i: _plain_votes(c) for i, c in rows.items()}
    model = quality_rules.label_model(counted)
    for r in quality_rules.judge(counted, model).collect():
        c, v = rows[r.row.doc_id], votes[r.row.doc_id]
        score = [np.log(p) + sum(np.log(model.rates[y, k, x]) for k, x in enumerate(v)) for y, p in ((0, 1 - model.prior), (1, model.prior))]
        good = 1 / (1 + np.exp(score[0] - score[1]))
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        assert r.base_failed == failed and abs(r.quality_prob - good) < 1e-6 and r.kept == (not failed and r.quality_prob >= 0.5)


def test_ties_repeats_and_names(spark):
    text = " ".join(f"word{i}" for i in range(60)) + "."
    docs = spark.createDataFrame([(1, text, "r", "g"), (1, text, "r", "g"), (2, None, None, None)], "doc_id int, text string, row string, got string")
    counted = quality_rules.counts_of(docs)
    p = next(r.p for r in counted.where("row.doc_id = 1").select(quality_rules.pattern(lambda n: counted[f"got.{n}"]).alias("p")).collect())
    for posterior, kept in ((0.5, True), (0.4999, False)):
        model = quality_rules.LabelModel(0.5, np.full((2, 9, 3), 1 / 3), {p: posterior})
        got = quality_rules.judge(counted, model).collect()
        assert sorted((r.row.doc_id, r.kept) for r in got) == [(1, kept), (1, kept), (2, False)]
    assert quality_rules.filter_quality(docs).columns == docs.columns


def test_letters_of_other_scripts():
    counts = quality_rules.text_counts(pa.array(["漢字、仮名。 \U0001F600 é ñ – „x“ ×"]))
    assert counts[quality_rules.COUNTS.index("n_letters")].to_pylist() == [8]  # four signs of Han and Kana, é, ñ, x, and × as its first byte is that of é
