"""Filter audit against plain counting, document by document and order by order."""

from collections import Counter
from itertools import permutations

from spanveil.llm import filter_audit

from . import brute

DOCS = "doc_id bigint, text string, lang string, part string, n_words bigint, failed string"
LABELS = "doc_id bigint, quality int, toxic int, good string"


def _plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        t = text or ""
        words = brute.SPACE_WORDS.findall(t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        rows.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                here = {k for k, (failed, _, _) in enumerate(own) if f in failed}
                new = here - gone
                total[f] += len(new)
                out[part, "".join(order), step] = [len(own) - len(gone | new), len(new), len(here & gone), sum(failed == {f} for failed, _, _ in own), sum(own[k][1] for k in new), sum(own[k][2] for k in new), f]
                gone |= new
        for key, row in out.items():
            if key[0] == part:
                row[-1] = total[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def _got(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", 7, "y") for r in docs], DOCS)
    rows = filter_audit.audit_filters(d, spark.createDataFrame([(*r, "z") for r in labels], LABELS)).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_equals_plain_counts_on_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = [
        (1, None, "en"),
        (2, "", "en"),
        (3, "  \n\t ", None),
        (4, long, "en"),
        (5, long, "de"),
        (5, long, "de"),  # a repeated row
        (5, long + " # AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", "de"),  # the same id, another text
        (None, long, "en"),
        (None, long, ""),
        (6, "é " * 400, "fr"),
        (7, "A a " * 300, "fr"),
        (8, "x$ y z", None),
        (0, "x$ y z", "en"),
        (9, long + " Z" * 20000, "en"),
        (10, " ".join(["one"] * 250), "en"),  # no ASCII white space: one word
    ]
    labels = [(4, 1, 0), (5, 0, 1), (5, 1, None), (7, None, 1), (None, 1, 1), (1, 1, 1), (99, 1, 1)]
    want = _plain(docs, labels)
    assert _got(spark, docs, labels) == want and len(want) == 600 * 4


def test_equal_rows_do_not_add_up(spark):
    docs = [(1, "a b a b c", "en")] * 200 + [(2, "a b a b c", "en")] * 3
    assert _got(spark, docs, []) == _plain(docs, [])


def test_audit_of_nothing(spark):
    assert _got(spark, [], [(1, 1, 1)]) == {}
