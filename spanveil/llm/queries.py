"""Queries opN_<name> over whole tables, each a thin digest of its operator's output."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, filter_audit, html_extract, licenses, packing, pii, quality_classifier, quality_rules, secret_scan, toxicity, whitening
from .jaccard import ngram_jaccard_components
from .scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]

#: The key of the pseudonyms where the session names none in spark.spanveil.pseudonym.key. Production keys come from a secret store.
PSEUDONYM_KEY = "spanveil example key"


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.spanveil.pseudonym.key", PSEUDONYM_KEY)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secret_scan.find_secrets(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return got.select("row.doc_id", "got.n_assign", "got.n_access", "got.n_hex", F.sha2("got.base_spans", 256).alias("base_sha256"), "got.spans", "got.n_decoded")


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return got.select("row.doc_id", "got.*")


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = Scratch(spark, "quality").save(quality_rules.counts_of(_table(spark, sf_dir, "documents"), keep=["doc_id"]))
    judged = quality_rules.judge(counted, quality_rules.label_model(counted))
    return judged.select("row.doc_id", *(f"got.{c}" for c in quality_rules.COUNTS[:5]), "base_failed", "kept", "quality_prob")


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_benchmark_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"], with_clean=False)
    return found.select(
        "row.doc_id",
        "got.n_words",
        "got.n_hit",
        F.size("got.items").cast("bigint").alias("n_items"),
        decontamination.items_sha256(F.col("got.items")).alias("items_sha256"),
        (F.col("got.n_hit") > 0).alias("contaminated"),
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("row.page_id", "row.url", "got.text", "got.n_chars")


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(_table(spark, sf_dir, "documents"), pseudonym_key(spark), keep=["doc_id"]).select("row.doc_id", "got.text", "got.n_values", "got.kinds", "got.spans")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = whitening.whiten(_table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return got.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


#: A conversation of control strings, which op12 formats beside those of the table.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], turns.schema)
    read = chat_format.read_back(chat_format.format_chats(turns.unionByName(own)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


# ---- parts of operators that SQL can express ----
def base_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of op11."""
    return op11_embedding_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op1."""
    got = secret_scan.find_secrets(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return got.select("row.doc_id", "got.n_assign", "got.n_access", "got.n_hex", F.sha2("got.base_spans", 256).alias("base_sha256"))


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base rule of op4."""
    counted = quality_rules.counts_of(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    judged = quality_rules.judge(counted, quality_rules.fit_label_model({}))
    return judged.select("row.doc_id", *(f"got.{c}" for c in quality_rules.COUNTS[:5]), "base_failed")


def queries() -> dict[str, Query]:
    found = (
        op1_secret_scan,
        op2_toxicity_chain,
        op3_length_buckets,
        op4_quality_rules,
        op5_pu_quality,
        op6_decontamination,
        op7_html_extraction,
        op8_pseudonyms,
        op9_ngram_jaccard,
        op10_license_scan,
        op11_embedding_whitening,
        op12_chat_format,
        op13_filter_audit,
    )
    return {f.__name__: f for f in found}


def parts() -> dict[str, Query]:
    """Queries over what of an operator SQL can express."""
    return {f.__name__: f for f in (base_secrets, base_quality, base_whitening)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TEMPLATES = ", ".join(f"({i}, '{label}', '{words}')" for i, (label, words) in enumerate(licenses.TEMPLATES))


def _starts(phrase: str) -> str:
    parts = phrase.split()
    return f"list_filter(range(0, len(w)), lambda i: {' AND '.join(f"w[i + {j + 1}] = '{p}'" for j, p in enumerate(parts))})"


_PLACES = ", ".join(f"{_starts(phrase)} AS p_{label}" for label, phrase in licenses.PHRASES)
_EVERY = f"list_concat(list_concat(p_{licenses.PHRASES[0][0]}, p_{licenses.PHRASES[1][0]}), p_{licenses.PHRASES[2][0]})"
_BASE = " || ".join(f"CASE WHEN len(p_{label}) > 0 THEN ['{label}'] ELSE CAST([] AS VARCHAR[]) END" for label, _ in licenses.PHRASES)

def _spans(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Rows (doc_id, k, kind, s, e): matches stand between the parts of a split by the same pattern."""
    return f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, s, s + length(v[i]) AS e FROM (
  SELECT doc_id, i, v, g, list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(v, 1, i - 1), lambda x: length(x))), 0) AS s FROM (
    SELECT doc_id, v, g, gaps, unnest(range(1, len(v) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS v, regexp_extract_all(text, '{pattern}', {group}) AS g, string_split_regex(text, '{pattern}') AS gaps FROM t))) WHERE length(g[i]) >= {least}"""


_ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"\x27]?\x20*[:=]\x20*[\"\x27]?([A-Za-z0-9+/_.=-]+)"

_SPACED = "regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')"

def _escaped(text: str) -> str:
    """SQL for a text with its control strings escaped."""
    for head in sorted({c[0] for c in chat_format.CONTROLS}):
        rest = "|".join(re.escape(c[1:]) for c in chat_format.CONTROLS if c[0] == head)
        text = f"regexp_replace({text}, '({re.escape(head)})(\\\\*)({rest})', '\\1\\\\\\2\\3', 'g')"
    return text


_FLAGS = ["n < 200", "100 * k < 50 * n", "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t)", "regexp_matches(t, '[#$%&*|]')", "coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)"]

_SQL = {
    "base_secrets": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_spans(0, 'assign', _ASSIGN, 2, 6)} UNION ALL {_spans(1, 'access', 'AKIA[A-Z0-9]+', 0, 20)} UNION ALL {_spans(2, 'hex', '[0-9a-f]{24,}', 0, 24)}),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS l FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(l, '')) AS base_sha256 FROM documents LEFT JOIN g USING (doc_id)""",
    "base_quality": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_SPACED} AS w FROM documents),
tri AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM t)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^ \\t-\\r]')),
dup AS (SELECT doc_id, count(*) AS n FROM lines WHERE k > 1 GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM t LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c""",
    "op10_license_scan": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
t AS (SELECT template, label, string_split(words, ' ') AS w FROM (VALUES {_TEMPLATES}) v(template, label, words)),
tg AS (SELECT template, label, len(w) - 2 AS grams, p AS spot, array_to_string(list_slice(w, p, p + 2), ' ') AS g FROM (SELECT template, label, w, unnest(range(1, len(w) - 1)) AS p FROM t)),
dg AS (SELECT doc_id, p AS pos, array_to_string(list_slice(w, p, p + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
hit AS (SELECT DISTINCT doc_id, template, label, grams, pos, spot, pos - spot AS diagonal FROM dg JOIN tg USING (g)),
dia AS (SELECT doc_id, template, diagonal, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= 2 THEN 0 ELSE 1 END AS apart FROM (SELECT DISTINCT doc_id, template, diagonal FROM hit)),
span AS (SELECT doc_id, template, diagonal, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM dia),
merged AS (SELECT doc_id, label, grams, count(DISTINCT spot) / grams AS score, max(pos) - min(pos) < grams * 2 AS near FROM hit JOIN span USING (doc_id, template, diagonal) GROUP BY doc_id, template, label, grams, span),
best AS (SELECT doc_id, max(score) AS score, list(DISTINCT label) FILTER (score >= 0.75 AND near) AS more FROM merged GROUP BY doc_id),
base AS (SELECT doc_id, w, {_PLACES} FROM d),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, {_EVERY} AS l, {_BASE} AS base_set FROM base)
SELECT doc_id, n_words, CAST(len(l) AS BIGINT) AS n_base, list_min(l) AS first_word, list_max(l) AS last_word, array_to_string(list_sort(base_set), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base_set || coalesce(more, CAST([] AS VARCHAR[])))), ',') AS labels, coalesce(score, 0.0) AS score FROM b LEFT JOIN best USING (doc_id)""",
    "op6_decontamination": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS k FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM i)),
dw AS (SELECT doc_id, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win))),
m AS (SELECT doc_id, p, k, item FROM dw JOIN win USING (k, g)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM m WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "base_whitening": f"""WITH v AS (SELECT vec_id, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT row_number() OVER () AS r, vec_id, list_transform(e, lambda c: CAST(floor(CAST(c AS DOUBLE) * {whitening.SCALE}) AS BIGINT) + {whitening.SHIFT}) AS x FROM v),
l AS (SELECT r, vec_id, unnest(x) AS x, unnest(range(len(x))) AS k FROM x WHERE len(x) = (SELECT len(x) FROM x GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
s AS (SELECT k, sum(x) AS s, count(*) AS n FROM l GROUP BY k)
SELECT vec_id, n, CAST(sum((n * x - s) * (n * x - s)) AS BIGINT) AS deviation FROM l JOIN s USING (k) GROUP BY r, vec_id, n""",
    "op12_chat_format": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '{CONTROL_TEXT}' FROM range(2) r(n)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({len(chat_format.MARKED.start) + len(chat_format.MARKED.end) + 2} + length(role) + length({_escaped("text")})) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g""",
    "op13_filter_audit": f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_SPACED} AS w FROM documents),
c AS (SELECT doc_id, part, t, len(w) AS n, len(list_distinct(w)) AS k FROM d),
f AS (SELECT doc_id, part, {", ".join(f"{flag} AS {name}" for flag, name in zip(_FLAGS, filter_audit.FILTERS, strict=True))} FROM c),
m AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
s AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {" || ".join(f"CASE WHEN {x} THEN '{x}' ELSE '' END" for x in filter_audit.FILTERS)} AS failed, count(*) AS n FROM f LEFT JOIN m USING (doc_id) GROUP BY ALL),
a AS (SELECT unnest(string_split('{" ".join(filter_audit.FILTERS)}', ' ')) AS x),
o AS (SELECT p.x || q.x || r.x || u.x || v.x AS filter_order FROM a p JOIN a q ON q.x <> p.x JOIN a r ON r.x NOT IN (p.x, q.x) JOIN a u ON u.x NOT IN (p.x, q.x, r.x) JOIN a v ON v.x NOT IN (p.x, q.x, r.x, u.x)),
b AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, '[' || filter_order[1:step - 1] || '!]' AS before FROM o, range(1, 6) g(step)),
e AS (SELECT part, filter_order, step, n, good, toxic, failed, own, contains(failed, own) AS fails, regexp_matches(failed, before) AS gone FROM b, s)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (failed = own), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(length(failed), 1)) FILTER (fails), 0) AS BIGINT) AS shapley FROM e GROUP BY part, filter_order, step""",
    "op9_ngram_jaccard": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \\t-\\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
}


def oracle_sql() -> dict[str, str]:
    """The label model, trained scores, page layouts, keyed permutations, decoded layers and bucket search have no SQL here; tests hold them against plain versions."""
    return dict(_SQL)
