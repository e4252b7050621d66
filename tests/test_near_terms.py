"""Nearly equal terms by the index join against all pairs."""

import random

from pyspark.sql import functions as F

from spanveil.operators import names, near_terms
from spanveil.plans import queries


def _mangled(r, text):
    chars = list(text)
    for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
        at = r.randrange(len(chars) + 1)
        how = r.choice(["in", "out", "swap", "sub"])
        if how == "in":
            chars.insert(at, r.choice("abc x"))
        elif chars and at < len(chars):
            if how == "out":
                del chars[at]
            elif how == "sub":
                chars[at] = r.choice("abc")
            elif at + 1 < len(chars):
                chars[at], chars[at + 1] = chars[at + 1], chars[at]
    return names.phrase("".join(chars))


def _plain(phrases, terms):
    return {(k, p, t) for k, p in phrases if k is not None and p for j, t in terms if j == k and t and names.like_a_term(p, (t,))}


def test_index_join_equals_all_pairs(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(1, 14)))
    terms = [(r.choice(["x", "y"]), " ".join(word() for _ in range(r.randrange(1, 6)))) for _ in range(250)] + [("x", "a" * 12), ("x", "abcabcabcabc abc"), (None, "abcde"), ("x", ""), ("x", None)]
    phrases = [(k, _mangled(r, t)) for k, t in terms if t for _ in range(6)] + [("y", "a" * 13), ("x", "a" * 11), ("x", "abcabcabcab cabc"), ("x", None), ("z", "abcde")]
    p, t = spark.createDataFrame(phrases * 2, "list string, phrase string"), spark.createDataFrame(terms * 2, "list string, term string")
    rows = near_terms.near_pairs(p, t).collect()
    want = _plain({(k, x) for k, x in phrases}, set(terms))
    assert len(rows) == len({tuple(x) for x in rows}) and {tuple(x) for x in rows} == want
    assert len({x for x in want if x[1] != x[2]}) > 100


def test_nothing_is_near_nothing(spark):
    p, t = spark.createDataFrame([], "list string, phrase string"), spark.createDataFrame([("x", "abcde")], "list string, term string")
    assert near_terms.near_pairs(p, t).count() == 0 and near_terms.near_pairs(t.select("list", F.col("term").alias("phrase")), t.where("false")).count() == 0


def test_near_terms_of_conversations(spark, tmp_path):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(8, 22)))
    words = [word() for _ in range(400)]
    rows = [(c, t, ("user", "assistant")[t % 2], " ".join(_mangled(r, w) if t % 2 else w for w in r.sample(words, 30))) for c in range(20) for t in range(4)]
    spark.createDataFrame([*rows, (99, 0, "user", None)], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [(x.phrase, x.term) for x in queries.queries()["near_terms"](spark, str(tmp_path)).collect()]
    said = {role: {w for _, _, x, text in rows if x == role for w in text.split() if len(w) > 4} for role in ("user", "assistant")}
    want = {(p, t) for p in said["user"] for t in said["assistant"] if p != t and names.like_a_term(p, (t,))}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_many_terms_meet_few_candidates(spark):
    t = spark.range(20_000).select(F.lit("x").alias("list"), F.concat(F.lit("t"), F.md5(F.col("id").cast("string")).substr(1, 12)).alias("term"))
    p = t.select("list", F.concat(F.col("term"), F.lit("x")).alias("phrase"))
    assert near_terms._candidates(p, t, False).count() < 40_000
    assert near_terms.near_pairs(p, t).count() == 20_000
