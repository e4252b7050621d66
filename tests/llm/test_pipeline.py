import random

import corpus_pipeline

from spanveil.llm import pii
from spanveil.llm.queries import PSEUDONYM_KEY

from . import brute


def test_stages_against_plain_versions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "private_data", "pack"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        out[name] = docs
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = docs.cache()
    kept = {r.doc_id: r.text for r in out["quality"].collect()}
    assert all(rows[i] == t and brute.text_counts(t)[0] >= 50 for i, t in kept.items())
    least = brute.jaccard_components(sorted(kept.items()), 5, 4, 5)
    unique = {i: t for i, t in kept.items() if least[i] == i}
    assert {r.doc_id: r.text for r in out["near_duplicates"].collect()} == unique
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    hits = {i: brute.benchmark_hits(t, items) for i, t in unique.items()}
    clean = {r.doc_id: r.text for r in out["decontaminate"].collect()}
    assert set(clean) == {i for i, (n, h, _) in hits.items() if h <= n * 0.5}
    assert all(clean[i] == unique[i] for i in clean if not hits[i][1])
    key = pii.derive_key(PSEUDONYM_KEY)
    private = {r.doc_id: r.text for r in out["private_data"].collect()}
    assert private == {i: pii.pseudonymise(t, key)[0] for i, t in clean.items()}
    packed = {r.doc_id: r.n_tokens for r in out["pack"].collect()}
    assert packed == {i: brute.text_counts(t)[0] for i, t in private.items()}
    whole = {r.doc_id for r in corpus_pipeline.run(spark, small).collect()}
    assert whole == set(packed)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, got string, id int, told string, v int, kept boolean"


def _stages(spark, docs, folder):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{folder}/out-{name}"
        docs.write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def _benchmark(spark, folder, items):
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")


def _prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randrange(3, 9))) for _ in range(n)).capitalize() + "."


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, and columns that clash with the operators' own."""
    passage = _prose(1, 12)
    item = passage.rstrip(".").lower().split()
    texts = {
        1: _prose(2, 120),
        2: _prose(3, 60) + " Write to orla@mail.example.com today. " + _prose(4, 60),
        3: _prose(5, 80) + " " + passage + " " + _prose(6, 80),
        4: "Short words here.",
        5: None,
        6: "",
        7: _prose(7, 40_000),
        8: None,
    }
    texts[8] = texts[1] + " tail"
    rows = [(i, t, None if i % 2 else "en", None, None if i == 2 else len(t or ""), "r", "g", i, "t", None, False) for i, t in texts.items()]
    rows += [rows[0], (None, _prose(8, 100), "en", "s", 5, None, None, None, None, None, None)]
    _benchmark(spark, tmp_path, [("q1", passage), ("q2", None), (None, "")])
    docs = spark.createDataFrame(rows, DOCS)
    out = _stages(spark, docs, str(tmp_path))
    assert all(out[n].columns == docs.columns for n, _ in corpus_pipeline.STAGES[:-1])
    ids = {n: sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect()) for n, df in out.items()}
    kept = [(False, 1), (False, 1), (False, 2), (False, 3), (False, 7), (False, 8), (True, 0)]
    assert ids["quality"] == kept
    alone = [x for x in kept[1:] if x != (False, 8)]  # equal rows are one, and so are near copies
    assert ids["near_duplicates"] == ids["decontaminate"] == ids["private_data"] == ids["pack"] == alone
    got = {r.doc_id: r for r in out["private_data"].collect()}
    assert got[1].text == texts[1] and got[7].text == texts[7] and got[1].row == "r" and got[1].lang is None
    words = brute.ALNUM_WORDS.findall(texts[3].lower())
    at = next(i for i in range(len(words)) if words[i : i + len(item)] == item)
    assert brute.ALNUM_WORDS.findall(got[3].text.lower()) == words[:at] + words[at + len(item) :] and got[3].n_chars == len(got[3].text)
    assert "orla@" not in got[2].text and got[2].text.startswith(_prose(3, 60)) and got[2].text.endswith(_prose(4, 60))
    sizes = {r.doc_id: r.n_tokens for r in out["pack"].collect()}
    assert sizes == {i: brute.text_counts(r.text)[0] for i, r in got.items()}


def test_stages_on_an_empty_table(spark, tmp_path):
    _benchmark(spark, tmp_path, [])
    out = _stages(spark, spark.createDataFrame([], DOCS), str(tmp_path))
    assert [df.count() for df in out.values()] == [0] * 5
