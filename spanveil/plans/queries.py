"""One query for each operator, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil import lexicon as lx
from spanveil.functions import crypto, placeholders, spans, text
from spanveil.operators import allowlist, context, conversation, requests, selectors, tokens, transcript
from spanveil.operators import near_terms as near_terms_
from spanveil.plans import golden
from spanveil.shipping import ship
from spanveil.sources.stores import unexpired, upsert

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- literals that are the same on both sides ----
def _quoted(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _pick(key: Column, values) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (key % len(values)).cast("int") + 1)


def _sql_pick(key: str, values) -> str:
    return f"([{', '.join(map(_quoted, values))}])[CAST({key} % {len(values)} AS BIGINT) + 1]"


def _column(rows, i: int) -> list:
    return [r[i] for r in rows]


# ---- contacts in documents ----
_W = r"[^\p{L}\p{N}_]"
_EMAIL_SQL = rf"(?i)(?:^|{_W})([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}})(?:$|{_W})"
_PHONE_SQL = rf"(?:^|{_W})((?:\+?[0-9]{{1,3}}[\s.\-+]*)?(?:\(?[0-9]{{3}}\)?[\s.\-+]*)[0-9]{{3}}[\s.\-+]*[0-9]{{4}})(?:$|{_W})"


def _span_sql(pattern: str) -> str:
    return f"""WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '{pattern}', 1) AS v FROM documents)
SELECT doc_id, CAST(len(v) AS INTEGER) AS n, array_to_string(v, '|') AS found, CASE WHEN len(v) > 0 THEN CAST(strpos(text, v[1]) - 1 AS INTEGER) END AS first_start FROM m"""


def _span_rows(docs: DataFrame, pattern: str) -> DataFrame:
    """A null text has no counts, as in SQL."""
    m = docs.select("doc_id", F.when(F.col("text").isNotNull(), spans.matches(F.col("text"), pattern)).alias("m"))
    return m.select("doc_id", F.when(F.col("m").isNotNull(), F.size("m")).alias("n"), F.array_join("m.value", "|").alias("found"), F.get("m.start", 0).alias("first_start"))


@query(_span_sql(_EMAIL_SQL))
def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(_read(spark, sf_dir, "documents"), text.EMAIL)


@query(_span_sql(_PHONE_SQL))
def phone_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(_read(spark, sf_dir, "documents"), text.PHONE)


_MENTIONS = f"""WITH d AS (SELECT doc_id, source, text, regexp_extract_all(text, '{_EMAIL_SQL}', 1) AS em, regexp_extract_all(text, '{_PHONE_SQL}', 1) AS ph FROM documents),
mention AS (
  SELECT doc_id, source, 'em' AS entity, unnest(em) AS value, unnest(range(1, len(em) + 1)) AS i FROM d
  UNION ALL SELECT doc_id, source, 'ph', unnest(ph), unnest(range(1, len(ph) + 1)) FROM d),
normed AS (SELECT *, CASE WHEN entity = 'em' THEN lower(value) ELSE regexp_replace(value, '[^0-9]', '', 'g') END AS norm FROM mention),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, entity, norm ORDER BY doc_id, i) AS k FROM normed) WHERE k = 1),
vault AS (
  SELECT source, entity, norm, value, doc_id AS first_doc, CAST(n AS INTEGER) AS n, '<' || entity || '_' || n || '>' AS token
  FROM (SELECT *, row_number() OVER (PARTITION BY source, entity ORDER BY doc_id, i) AS n FROM firsts))
"""


def _vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.vault_table(tokens.contact_mentions(_read(spark, sf_dir, "documents"), "source", "doc_id", "text"))


@query(
    _MENTIONS
    + """, pairs AS (SELECT DISTINCT v.doc_id, v.value, t.token FROM normed v JOIN vault t USING (source, entity, norm)),
folds AS (SELECT doc_id, list({'v': value, 't': token} ORDER BY length(value) DESC, value) AS l FROM pairs GROUP BY doc_id)
SELECT d.doc_id, d.source, CAST(len(em) + len(ph) AS INTEGER) AS n,
  CASE WHEN l IS NULL THEN text ELSE list_reduce(list_prepend({'v': text, 't': ''}, l), lambda a, x: {'v': replace(a.v, x.v, x.t), 't': ''}).v END AS redacted
FROM d LEFT JOIN folds f USING (doc_id)"""
)
def redact_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tokens.redact_contacts(_read(spark, sf_dir, "documents"), "source", "doc_id", "text")
    return got.select(F.col("seq").alias("doc_id"), F.col("scope").alias("source"), F.when(F.col("redacted").isNotNull(), F.col("n")).alias("n"), "redacted")


@query(_MENTIONS + "SELECT source, entity, n, token, value, first_doc FROM vault")
def vault_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vault(spark, sf_dir).select(F.col("scope").alias("source"), "entity", "n", "token", "value", F.col("first_seq").alias("first_doc"))


@query(_MENTIONS.replace("SELECT doc_id, source, text", "SELECT doc_id, 1 AS source, text", 1) + "SELECT entity, n, token, value, first_doc FROM vault")
def vault_of_one_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one scope, numbered by ranges whatever their number."""
    mentions = tokens.contact_mentions(_read(spark, sf_dir, "documents").withColumn("one", F.lit(1)), "one", "doc_id", "text")
    return tokens.vault_table(mentions, large=0).select("entity", "n", "token", "value", F.col("first_seq").alias("first_doc"))


@query(_MENTIONS + "SELECT source, entity, max(n) AS n, max_by(token, n) AS latest_token, max_by(value, n) AS latest_value FROM vault GROUP BY ALL")
def token_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counters(_vault(spark, sf_dir)).withColumnRenamed("scope", "source")


@query(_MENTIONS + "SELECT source, n, string_agg(entity || '=' || token, ',' ORDER BY entity) AS tokens FROM vault GROUP BY ALL")
def tokens_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.array_join(F.transform(F.map_entries("tokens"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return tokens.profiles(_vault(spark, sf_dir)).select(F.col("scope").alias("source"), "n", flat.alias("tokens"))


@query(_MENTIONS + "SELECT source, entity, n, token, value FROM vault")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.restore(tokens.snapshots(_vault(spark, sf_dir))).withColumnRenamed("scope", "source")


@query("SELECT doc_id, text AS clean FROM documents")
def rehydrate_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    redacted = tokens.redact_contacts(_read(spark, sf_dir, "documents"), "source", "doc_id", "text")
    return tokens.rehydrate(redacted, _vault(spark, sf_dir), "scope", "seq", "redacted").select(F.col("seq").alias("doc_id"), "clean")


# Rows whose keys repeat, or are null, with few distinct addresses.
_SHARED = """src AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS scope, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id // 3 END AS seq, 'mail ' || chr(CAST(97 + doc_id % 4 AS INTEGER)) || doc_id % 3 || '@mail.example.com and q' AS text FROM documents
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id // 3 END, 'plain ' || doc_id % 2 FROM documents),
one AS (SELECT scope, regexp_extract(text, '[a-z][0-9]@mail.example.com') AS value, seq FROM src WHERE contains(text, '@')),
firsts AS (SELECT scope, value, min(seq) FILTER (seq IS NOT NULL) AS s, count(*) FILTER (seq IS NULL) > 0 AS unsaid FROM one GROUP BY ALL),
vault AS (SELECT scope, value, '<em_' || row_number() OVER (PARTITION BY scope ORDER BY CASE WHEN unsaid THEN 0 ELSE 1 END, CASE WHEN unsaid THEN 0 ELSE s END, value) || '>' AS token FROM firsts)
"""


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    key = F.col("doc_id")
    scope, seq = F.when(key % 5 != 0, F.col("source")).alias("scope"), F.when(key % 7 != 0, F.floor(key / 3)).alias("seq")
    mail = F.concat(F.lit("mail "), F.char(97 + key % 4), (key % 3).cast("string"), F.lit("@mail.example.com and q"))
    return d.select(scope, seq, mail.alias("text")).unionByName(d.select(scope, seq, F.concat(F.lit("plain "), (key % 2).cast("string")).alias("text")))


@query(f"WITH {_SHARED} SELECT src.scope, src.seq, CASE WHEN token IS NULL THEN text ELSE replace(text, value, token) END AS redacted, CAST(CASE WHEN token IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n FROM src LEFT JOIN vault ON src.scope IS NOT DISTINCT FROM vault.scope AND contains(text, value)")
def redact_shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.redact_contacts(_shared(spark, sf_dir), "scope", "seq", "text")


@query(f"WITH {_SHARED} SELECT scope, seq, text AS clean FROM src")
def rehydrate_shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shared(spark, sf_dir)
    vaults = tokens.vault_table(tokens.contact_mentions(rows, "scope", "seq", "text"))
    return tokens.rehydrate(tokens.redact_contacts(rows, "scope", "seq", "text"), vaults, "scope", "seq", "redacted")


@query(_MENTIONS + """, asks AS (SELECT doc_id, source FROM documents)
SELECT a.doc_id, a.source, max_by(v.token, v.n) AS token, max_by(v.value, v.n) AS value FROM asks a LEFT JOIN vault v ON v.source = a.source AND v.entity = 'em' AND v.first_doc < a.doc_id GROUP BY ALL""")
def value_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    asks = d.select("doc_id", "source", F.lit("em").alias("entity"))
    return tokens.value_at(tokens.contact_mentions(d, "source", "doc_id", "text"), asks, "source", "doc_id", "entity").drop("entity")


# ---- spans ----
@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 60 AS INTEGER) AS s, CAST(l_partkey % 60 + 1 + l_suppkey % 9 AS INTEGER) AS e, l_linenumber % 3 = 0 AS loose FROM lineitem),
o AS (SELECT l_orderkey, list({'m': 0, 's': s, 'e': e, 'out': ''} ORDER BY s, loose, s - e, l_linenumber) AS l FROM s GROUP BY l_orderkey)
SELECT l_orderkey, list_reduce(list_prepend({'m': 0, 's': 0, 'e': 0, 'out': ''}, l),
  lambda a, x: CASE WHEN x.s >= a.m THEN {'m': x.e, 's': 0, 'e': 0, 'out': a.out || x.s || '-' || x.e || ';'} ELSE a END).out AS kept FROM o"""
)
def resolve_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_partkey") % 60).cast("int")
    span = F.struct(start.alias("start"), (start + 1 + F.col("l_suppkey") % 9).cast("int").alias("end"), F.when(F.col("l_linenumber") % 3 == 0, "name").otherwise("em").alias("entity"), F.lit("").alias("value"))
    listed = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", span.alias("s")))).alias("l"))
    kept = spans.resolve(F.col("l.s"))
    return listed.select("l_orderkey", F.array_join(F.transform(kept, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(";"))), "").alias("kept"))


# ---- what the assistant asked; context ----
@query("""SELECT conv_id, turn, role, md5(coalesce(last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS previous FROM conversations""")
def prev_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.previous_assistant(_read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.md5(F.coalesce("previous", F.lit(""))).alias("previous"))


def _cues(t: str, cues) -> str:
    return "(" + " OR ".join(f"contains({t}, {_quoted(c)})" for c in cues) + ")"


_FLAT_PROMPT = f"regexp_replace(lower(trim({_sql_pick('c_custkey', _column(golden.PROMPTS, 0))})), '\\s+', ' ', 'g')"


@query(
    f"""WITH p AS (SELECT c_custkey, {_FLAT_PROMPT} AS t FROM customer),
f AS (SELECT *, {_cues('t', lx.ASKS_FIRST)} AS fi, {_cues('t', lx.ASKS_LAST)} AS la, {_cues('t', lx.ASKS_FULL)} AS fu FROM p)
SELECT c_custkey, CASE WHEN la AND {_cues('t', lx.HAS_FIRST)} THEN 'last' WHEN fu OR (fi AND la) THEN 'full' WHEN la THEN 'last' WHEN fi THEN 'first'
  WHEN {_cues('t', lx.ASKS_CONTACT)} THEN CASE WHEN contains(t, 'name') THEN 'full' END WHEN {_cues('t', lx.ASKS_NAME)} THEN 'first' END AS request,
  fi OR la OR fu OR {_cues('t', lx.ASKS_NAME)} AS asks_name FROM f"""
)
def request_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = _pick(F.col("c_custkey"), _column(golden.PROMPTS, 0))
    return _read(spark, sf_dir, "customer").select("c_custkey", text.request_type(prompt).alias("request"), text.asks_name(prompt).alias("asks_name"))


@query(f"SELECT c_custkey, {_cues('t', lx.PLAN_CONTEXT)} AS plan, {_cues('t', lx.LOCATION_CONTEXT)} AS place FROM (SELECT c_custkey, {_FLAT_PROMPT} AS t FROM customer)")
def context_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = _pick(F.col("c_custkey"), _column(golden.PROMPTS, 0))
    return _read(spark, sf_dir, "customer").select("c_custkey", text.plan_context(prompt).alias("plan"), text.location_context(prompt).alias("place"))


_SUPPRESS_TEXT = ("Hello Mia", "windsor", "Email for Orla", "My name is Orla", "name: Orla", "Plan ii", "Grand Meadow", "Texas", "Orla", "a b c d e f", "Blossom AI", "oq@mail.example.com")
_SUPPRESS_PROMPT = ("Which floor plan do you like?", "Which community?", "How are you?", "What is your first name?")
_ONE_REGION = ", ".join(_quoted(x) for x in [*lx.REGION_CODES, *lx.REGIONS])


@query(
    f"""WITH m AS (SELECT o_orderkey, {_sql_pick('o_orderkey', _SUPPRESS_TEXT)} AS raw, lower({_sql_pick('o_custkey', _SUPPRESS_PROMPT)}) AS p FROM orders),
n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9''\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t, regexp_extract_all(lower(raw), '[\\p{{L}}]+(?:[''\\-][\\p{{L}}]+)*') AS w FROM m)
SELECT o_orderkey, CASE
  WHEN len(w) = 2 AND w[1] IN ('hello', 'hi', 'hey') AND w[2] IN ('mia', 'ava', 'aurora', 'blossom', 'windsor') THEN true
  WHEN contains(p, 'first name') THEN false
  WHEN t IN ('blossom ai', 'move in ready') THEN true
  WHEN t LIKE 'email for %' THEN true
  WHEN {_cues('t', lx.NAME_CUES)} OR regexp_matches(raw, '(?i)\\bname\\s*[:\\-]\\s*[A-Za-z]') THEN false
  WHEN contains(raw, '@') THEN false
  WHEN NOT ({_cues('p', lx.PLAN_CONTEXT)} OR {_cues('p', lx.LOCATION_CONTEXT)}) OR len(w) NOT BETWEEN 1 AND 5 THEN false
  WHEN t IN ('windsor', 'shadow hills') THEN true
  WHEN {_cues('p', lx.PLAN_CONTEXT)} AND list_has_any(w, [{', '.join(map(_quoted, lx.PLAN_CODES))}]) THEN true
  WHEN {_cues('p', lx.LOCATION_CONTEXT)} AND (len(w) BETWEEN 2 AND 4 OR (len(w) = 1 AND w[1] IN ({_ONE_REGION}))) THEN true
  ELSE false END AS suppressed FROM n"""
)
def suppress_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = text.suppressed(_pick(F.col("o_orderkey"), _SUPPRESS_TEXT), _pick(F.col("o_custkey"), _SUPPRESS_PROMPT), text.lits(["windsor", "shadow hills"]))
    return _read(spark, sf_dir, "orders").select("o_orderkey", got.alias("suppressed"))


# ---- terms ----
_PHRASE_SQL = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9''\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT p_partkey, {_PHRASE_SQL.format("p_name || ' (' || p_brand || ')!  ' || p_type")} AS term FROM part")
def term_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", text.phrase(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")!  "), "p_type")).alias("term"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An allowlist for each region: its nations' names, with repeats and blanks."""
    per = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    noisy = F.concat("names", F.transform("names", F.lower), F.array(F.lit(" "), F.lit("!"), F.concat(F.lit("Region_"), F.col("n_regionkey").cast("string"))))
    return per.select(
        F.concat(F.lit("client "), F.col("n_regionkey").cast("string")).alias("client_id"),
        F.lit("desk").alias("assistant_id"),
        F.lit("v2").alias("source_version"),
        F.lit(2.0).alias("updated_at_epoch"),
        noisy.alias("terms"),
        "n_regionkey",
    )


_LISTS_SQL = f"""WITH t AS (SELECT DISTINCT n_regionkey, {_PHRASE_SQL.format('n_name')} AS term FROM nation UNION SELECT DISTINCT n_regionkey, 'region ' || n_regionkey FROM nation),
lists AS (SELECT n_regionkey, list(term ORDER BY term) AS terms, sha256(string_agg(term, chr(10) ORDER BY term)) AS content_hash FROM t GROUP BY n_regionkey)
"""


@query(_LISTS_SQL + "SELECT n_regionkey, CAST(len(terms) AS INTEGER) AS term_count, content_hash FROM lists")
def allowlist_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _lists(spark, sf_dir).select("n_regionkey", allowlist.normalised_terms(F.col("terms")).alias("t"))
    return t.select("n_regionkey", F.size("t").alias("term_count"), text.content_hash(F.col("t")).alias("content_hash"))


@query(
    _LISTS_SQL
    + """SELECT 'client ' || n_regionkey AS client_id, CAST(len(terms) AS INTEGER) AS term_count, n_regionkey % 2 = 1 AS changed, CASE WHEN n_regionkey % 2 = 1 THEN 'v2' ELSE 'v1' END AS source_version,
'client_' || n_regionkey || '__desk__' || substr(sha256('client ' || n_regionkey || ':desk'), 1, 16) || '.json' AS cache_file FROM lists"""
)
def allowlist_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _lists(spark, sf_dir)
    terms = F.when(F.col("n_regionkey") % 2 == 0, allowlist.normalised_terms(F.col("terms"))).otherwise(F.array(F.lit("old")))
    old = new.select("client_id", "assistant_id", F.lit("v1").alias("source_version"), F.lit(1.0).alias("updated_at_epoch"), terms.alias("terms")).withColumn("content_hash", text.content_hash(F.col("terms")))
    return allowlist.refresh(old, new).select("client_id", "term_count", "changed", "source_version", "cache_file")


@query(
    _LISTS_SQL
    + """SELECT c_custkey, CASE WHEN terms IS NULL THEN lower(c_mktsegment) ELSE array_to_string(list_sort(list_distinct(list_append(terms, lower(c_mktsegment)))), ',') END AS terms
FROM customer LEFT JOIN lists ON c_nationkey % 7 = n_regionkey"""
)
def allowlist_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _lists(spark, sf_dir).withColumn("terms", allowlist.normalised_terms(F.col("terms")))
    msgs = _read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("client "), (F.col("c_nationkey") % 7).cast("string")).alias("client_id"), F.lit("desk").alias("assistant_id"), F.array(F.lower("c_mktsegment")).alias("non_name_allowlist"))
    return allowlist.merge(msgs, lists).select("c_custkey", F.array_join("terms", ",").alias("terms"))


@query("SELECT p_partkey, p_name || '|' || p_brand || '|' || p_type || '|name|other|plan|tags' AS terms FROM part")
def json_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    payload = F.to_json(F.struct(F.struct(F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("tags")).alias("plan"), F.struct(F.lit(1).alias("name")).alias("other")))
    found = allowlist.json_terms(payload, [("$.plan.name", "values"), ("plan['tags'][*]", "values"), ("$", "keys")])
    part = _read(spark, sf_dir, "part").select("p_partkey", found.alias("t"))
    return part.select("p_partkey", F.concat_ws("|", F.slice("t", 1, 3), F.array_sort(F.array_distinct(F.slice("t", 4, 100)))).alias("terms"))


# ---- rules with literal results ----
@query(f"SELECT c_custkey, {', '.join(f'{_sql_pick('c_custkey', _column(golden.PHRASES, i))} AS {n}' for i, n in ((1, 'region'), (2, 'place'), (3, 'company')))} FROM customer")
def phrase_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split(_pick(F.col("c_custkey"), _column(golden.PHRASES, 0)), " ")
    terms = text.lits(golden.TERMS)
    return _read(spark, sf_dir, "customer").select("c_custkey", text.region_phrase(w, terms).alias("region"), text.location_phrase(w, terms).alias("place"), text.company(w).alias("company"))


@query(f"SELECT c_custkey, {_sql_pick('c_custkey', _column(golden.WORDS, 1))} AS blocked FROM customer")
def blocked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select("c_custkey", text.blocked(_pick(F.col("c_custkey"), _column(golden.WORDS, 0))).alias("blocked"))


@query(f"SELECT c_custkey, {', '.join(f'{_sql_pick('c_custkey', _column(golden.NAMES, i))} AS {n}' for i, n in ((1, 'fn'), (2, 'mn1'), (3, 'mn2'), (4, 'ln')))} FROM customer")
def name_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = text.split_name(_pick(F.col("c_custkey"), _column(golden.NAMES, 0)))
    return _read(spark, sf_dir, "customer").select("c_custkey", parts.alias("p")).select("c_custkey", *(F.coalesce(f"p.{n}", F.lit("")).alias(n) for n in ("fn", "mn1", "mn2", "ln")))


@query(f"SELECT c_custkey, {', '.join(f'{_sql_pick('c_custkey', _column(golden.ACKNOWLEDGEMENTS, i))} AS {n}' for i, n in ((1, 'rest'), (2, 'skipped'), (3, 'found')))} FROM customer")
def acknowledgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = text.acknowledgement(_pick(F.col("c_custkey"), _column(golden.ACKNOWLEDGEMENTS, 0)))
    return _read(spark, sf_dir, "customer").select("c_custkey", got.alias("g")).select("c_custkey", "g.*")


@query(f"SELECT c_custkey, 'Key ' || c_custkey || ': ' || {_sql_pick('c_custkey', _column(golden.PLACEHOLDERS, 1))} || ' end' AS repaired FROM customer")
def repair_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("Key "), F.col("c_custkey").cast("string"), F.lit(": "), _pick(F.col("c_custkey"), _column(golden.PLACEHOLDERS, 0)), F.lit(" end"))
    vault = F.create_map(*(F.lit(x) for kv in golden.VAULT.items() for x in kv))
    return _read(spark, sf_dir, "customer").select("c_custkey", placeholders.repair(message, vault).alias("repaired"))


@query(f"SELECT o_orderkey, {_sql_pick('o_orderkey', _column(golden.MESSAGES, 3))} AS redacted FROM orders")
def name_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    key = F.col("o_orderkey")
    terms = F.array_remove(F.array(_pick(key, _column(golden.MESSAGES, 2))), "")
    got = conversation.redact_udf(_pick(key, _column(golden.MESSAGES, 0)), _pick(key, _column(golden.MESSAGES, 1)), terms)
    keys = _read(spark, sf_dir, "orders").select("o_orderkey").repartition(spark.sparkContext.defaultParallelism)  # light rows, heavy rules
    return keys.select("o_orderkey", got["text"].alias("redacted"))


@query(f"SELECT c_custkey, {_sql_pick('c_custkey', _column(golden.TOKENS, 2))} AS similar FROM customer")
def similar_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    a, b = (_pick(F.col("c_custkey"), _column(golden.TOKENS, i)) for i in (0, 1))
    return _read(spark, sf_dir, "customer").select("c_custkey", conversation.similar_udf(a, b).alias("similar"))


@query(f"SELECT c_custkey, {_sql_pick('c_custkey', _column(golden.NEARLY, 1))} AS near FROM customer")
def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    near = conversation.near_term_udf(_pick(F.col("c_custkey"), _column(golden.NEARLY, 0)), text.lits(["cypress ii", "redbud", "shadow hills"]))
    return _read(spark, sf_dir, "customer").select("c_custkey", near.alias("near"))


@query(None)
def near_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of user turns that are nearly, not quite, a word of an assistant turn, over all conversations."""
    turns = _read(spark, sf_dir, "conversations").select("role", F.explode(near_terms_.word_runs(F.col("text"), 1)).alias("run")).where("length(run) > 4").distinct()
    said = lambda role, name: turns.where(F.col("role") == role).select(F.lit(1).alias("list"), F.col("run").alias(name))
    return near_terms_.near_pairs(said("user", "phrase"), said("assistant", "term")).where("phrase <> term").select("phrase", "term")


@query("SELECT event_id, key AS term FROM events, json_tree(props) WHERE key IS NOT NULL UNION SELECT event_id, atom ->> '$' FROM events, json_tree(props) WHERE type = 'VARCHAR'")
def selected_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key and string at any depth of each event's properties."""
    return selectors.term_rows(_read(spark, sf_dir, "events"), ["event_id"], "props", [("**", "both")])


# ---- conversations ----
def _conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five operations in each scope: two redactions, a reply, an end, a reply after it."""
    key = F.col("c_custkey")
    first, last = _pick(key, golden.FIRST), _pick(key, golden.LAST)
    ops = F.array(
        *(
            F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(op).alias("op"), F.lit(float(ts)).alias("ts"), message.alias("message"), previous.alias("previous"), F.lit(closed).alias("closed"))
            for seq, op, ts, message, previous, closed in (
                (0, "in", 0, F.concat(F.lit("My name is "), first, F.lit(" "), last), F.lit(None).cast("string"), True),
                (1, "in", 10, F.concat(F.lit("Thank you, "), first, F.lit(" here, 5550102003")), F.lit("Is that you?"), True),
                (2, "out", 20, F.lit("Hi <name>, we call <phone>. <em_9>"), F.lit(None).cast("string"), True),
                (3, "end", 30, F.lit(None).cast("string"), F.lit(None).cast("string"), True),
                (4, "out", 40, F.lit("Hi <fn_1>"), F.lit(None).cast("string"), False),
            )
        )
    )
    rows = _read(spark, sf_dir, "customer").select(*(F.lit(s).alias(s) for s in conversation.SCOPE[:-1]), key.cast("string").alias("thread_id"), F.explode(ops).alias("o"))
    return rows.select(*conversation.SCOPE, "o.*", F.array().cast("array<string>").alias("terms"), F.lit(False).alias("new_user"))


_TALK = f"{_sql_pick('c_custkey', golden.FIRST)}", f"{_sql_pick('c_custkey', golden.LAST)}"


@query(
    f"""SELECT CAST(c_custkey AS VARCHAR) AS thread_id, CAST(seq AS BIGINT) AS seq, CASE seq WHEN 3 THEN 'ended' WHEN 4 THEN 'raw' ELSE 'ok' END AS status,
CASE seq WHEN 0 THEN 'My name is <fn_1> <ln_1>' WHEN 1 THEN 'Thank you, <fn_1> here, <ph_1>' WHEN 2 THEN 'Hi ' || {_TALK[0]} || ' ' || {_TALK[1]} || ', we call 5550102003. <em_9>' WHEN 4 THEN 'Hi <fn_1>' END AS text
FROM customer, range(5) r(seq)"""
)
def conversation_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.process(_conversation(spark, sf_dir)).select("thread_id", "seq", "status", "text")


@query(
    f"""SELECT CAST(c_custkey AS VARCHAR) AS thread_id, CAST(seq AS BIGINT) AS seq, CASE seq WHEN 2 THEN 'Dear ' || {_TALK[0]} || ' ' || {_TALK[1]} || right({_TALK[1]}, 1) ELSE '<fn_1> <ln_1>' END AS text
FROM customer, range(3) r(seq)"""
)
def corrected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A last name comes again with its last letter twice: its token takes the new spelling."""
    key = F.col("c_custkey")
    first, last = _pick(key, golden.FIRST), _pick(key, golden.LAST)
    turns = (
        (0, "in", F.concat_ws(" ", first, last), "What is your full name?"),
        (1, "in", F.concat_ws(" ", first, F.concat(last, F.right(last, F.lit(1)))), "Thanks. E-mail or phone?"),
        (2, "out", F.lit("Dear <fn_1> <ln_1>"), None),
    )
    ops = F.array(*(F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(op).alias("op"), F.lit(float(seq)).alias("ts"), m.alias("message"), F.lit(p).cast("string").alias("previous")) for seq, op, m, p in turns))
    rows = _read(spark, sf_dir, "customer").select(*(F.lit(s).alias(s) for s in conversation.SCOPE[:-1]), key.cast("string").alias("thread_id"), F.explode(ops).alias("o"))
    rows = rows.select(*conversation.SCOPE, "o.*", F.array().cast("array<string>").alias("terms"), F.lit(False).alias("new_user"), F.lit(True).alias("closed"))
    return conversation.process(rows).select("thread_id", "seq", "text")


# Every turn of every conversation, whole: user turns are redacted, all others restored, which leaves texts without tokens as they are.
@query(
    """WITH t AS (SELECT conv_id, turn, role, text, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS seen FROM conversations)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN role = 'user' OR seen > 0 THEN 'ok' ELSE 'raw' END AS status, CASE WHEN role <> 'user' THEN md5(text) END AS restored FROM t"""
)
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", "status", F.when(F.col("op") == "out", F.md5("text")).alias("restored"))


@query(None)
def conversation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as its session gives it: user turns redacted, the others restored."""
    return _turns(spark, sf_dir).select("conv_id", "turn", "op", "status", "text", "profile", "generation")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = context.previous_assistant(_read(spark, sf_dir, "conversations"))
    empty = F.lit("")
    op = F.when(F.col("role") == "user", "in").otherwise("out").alias("op")
    rows = turns.select(*(empty.alias(s) for s in conversation.SCOPE[:-1]), F.col("conv_id").cast("string").alias("thread_id"), F.col("turn").cast("bigint").alias("seq"), op, F.col("turn").cast("double").alias("ts"), F.col("text").alias("message"), "previous", F.array().cast("array<string>").alias("terms"), F.lit(False).alias("new_user"), F.lit(False).alias("closed"))
    return conversation.process(rows).withColumn("conv_id", F.col("thread_id").cast(turns.schema["conv_id"].dataType)).withColumnRenamed("seq", "turn")


@query("SELECT user_id, event_id, CAST(1 + sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS generation FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS n FROM events)")
def scope_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.generations(_read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "generation")


@query(
    """WITH e AS (SELECT event_id, user_id, ts, lag(ts) OVER w AS was, lag(event_id) OVER w AS was_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT a.event_id, count(DISTINCT b.user_id) AS n FROM e a JOIN events b ON b.user_id <> a.user_id AND (b.ts > a.was OR (b.ts = a.was AND b.event_id > a.was_id)) AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id))
  WHERE a.ts <= a.was + INTERVAL 3600 SECOND GROUP BY 1)
SELECT event_id, user_id, coalesce(n, 0) >= 5 AS evicted FROM e LEFT JOIN n USING (event_id)"""
)
def lru_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.lru_evictions(_read(spark, sf_dir, "events"), "user_id", "ts", "event_id", capacity=5).select("event_id", "user_id", "evicted")


@query("SELECT user_id, event_id, CAST(1 + sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS profile FROM events")
def profile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").withColumn("new_user", F.col("event_type") == "signup")
    return context.profile_index(e, ["user_id"], ["ts", "event_id"], "new_user").select("user_id", "event_id", "profile")


@query("SELECT user_id, max(ts) AS last_access FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def most_recent_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.most_recent(_read(spark, sf_dir, "events"), "user_id", "ts")


@query("SELECT count(*) AS scopes, count(*) FILTER (last_access >= m - INTERVAL 3600 SECOND) AS active FROM (SELECT user_id, max(ts) AS last_access FROM events GROUP BY 1), (SELECT max(ts) AS m FROM events)")
def active_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_access"))
    end = last.agg(F.max("last_access").alias("m"))
    return last.crossJoin(F.broadcast(end)).agg(F.count(F.lit(1)).alias("scopes"), F.count_if(F.col("last_access") >= F.col("m") - F.expr("INTERVAL 3600 SECOND")).alias("active"))  # one row


# ---- requests ----
_ASSISTANT = ("", "  ", "desk", None)
_MODE = ("open", "closed", None, "maybe")
_THREAD = ("thread_1", "thread_", "thrd_123", "thread_abc")


@query(
    f"""WITH r AS (SELECT c_custkey, {_sql_pick('c_custkey', _THREAD)} AS thread_id, {_sql_pick('c_nationkey', _ASSISTANT)} AS a, {_sql_pick('c_custkey // 4', _MODE)} AS m, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS message FROM customer)
SELECT c_custkey, coalesce(nullif(trim(a), ''), 'acme_chat_001') AS assistant_id, CASE m WHEN 'open' THEN false WHEN 'closed' THEN true ELSE true END AS fails_closed,
concat_ws(';', CASE WHEN length(thread_id) < 8 THEN 'thread_id: length' END, CASE WHEN thread_id NOT LIKE 'thread__%' ESCAPE '!' OR thread_id = 'thread_' OR left(thread_id, 7) <> 'thread_' THEN 'thread_id: pattern' END,
CASE WHEN message = '' THEN 'message: length' END, CASE WHEN m = 'maybe' THEN 'failure_mode: value' END) AS errors FROM r"""
)
def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    rows = c.select(
        "c_custkey",
        _pick(key, _THREAD).alias("thread_id"),
        *(F.lit("x").alias(x) for x in ("session_id", "visitor_id")),
        F.lit("acme").alias("client_id"),
        _pick(F.col("c_nationkey"), _ASSISTANT).alias("assistant_id"),
        _pick(F.floor(key / 4), _MODE).alias("failure_mode"),
        F.when(key % 5 == 0, "").otherwise(F.col("c_name")).alias("message"),
    )
    return requests.validate(rows).select("c_custkey", "assistant_id", requests.fails_closed(F.col("failure_mode"), F.lit(True)).alias("fails_closed"), F.array_join("errors", ";").alias("errors"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'redacted' WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END AS result, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS replacements,
CASE c_custkey % 5 WHEN 0 THEN 200 WHEN 1 THEN 503 WHEN 2 THEN 200 WHEN 3 THEN 200 ELSE 401 END AS key_status FROM customer"""
)
def fail_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, turn = F.col("c_custkey"), F.col("c_custkey") % 5
    status = crypto.key_status(
        F.when(turn == 2, "right").when(turn == 3, "hashed").otherwise("wrong"), turn != 0, F.when(turn == 1, "").otherwise("right"), F.when(turn == 1, F.lit("")).otherwise(F.sha2(F.lit("hashed"), 256))
    )
    return _read(spark, sf_dir, "customer").select(
        "c_custkey",
        requests.outcome(F.lit("redacted"), F.col("c_name"), key % 3 == 0, key % 2 == 0).alias("result"),
        requests.exposed(F.col("c_name"), key % 2 == 0, key % 4 == 0).alias("replacements"),
        status.alias("key_status"),
    )


# ---- stores ----
@query("SELECT c_custkey AS scope_key, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS payload FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope_key"))
    return upsert(c.where("scope_key % 2 = 0").withColumn("payload", F.lit("old")), c.where("scope_key % 3 = 0").withColumn("payload", F.lit("new")))


_TIMES = ("2024-01-14T00:00:00+00:00", "2024-01-15T00:00:00+00:00", "2024-01-16T00:00:00Z", "soon", None)


@query(f"SELECT c_custkey, {_sql_pick('c_custkey', _TIMES)} AS expires_at FROM customer WHERE c_custkey % 5 NOT IN (0, 1)")
def expired_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select("c_custkey", _pick(F.col("c_custkey"), _TIMES).alias("expires_at"))
    return unexpired(rows, F.lit("2024-01-15T00:00:00+00:00").cast("timestamp"))


@query("SELECT c_custkey, c_name AS plain, 'AESGCM' AS alg, 24 AS nonce_digits, CAST(2 * (length(c_name) + 16) AS INTEGER) AS text_digits FROM customer")
def encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = crypto.scope_key(F.lit("acme"), F.lit("desk"), F.lit("v"), F.lit("s"), F.col("c_custkey").cast("string"))
    key = crypto.cipher_key(F.lit("v1"), scope, F.lit("master"))
    sealed = _read(spark, sf_dir, "customer").select("c_custkey", key.alias("key"), crypto.encrypt(F.col("c_name"), key).alias("s"))
    return sealed.select("c_custkey", crypto.decrypt(F.col("s"), F.col("key")).alias("plain"), "s.alg", F.length("s.nonce_hex").alias("nonce_digits"), F.length("s.ciphertext_hex").alias("text_digits"))


@query("""SELECT o_orderkey, strftime(to_timestamp(o_orderkey * 86400 + 3) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS iso,
substr(regexp_replace(trim(o_orderpriority || ' / ' || o_orderstatus), '[^A-Za-z0-9._-]+', '_', 'g'), 1, 64) AS slug FROM orders""")
def slugs_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.epoch_iso((F.col("o_orderkey") * 86400 + 3).cast("double")).alias("iso"), text.slug(F.concat("o_orderpriority", F.lit(" / "), "o_orderstatus")).alias("slug"))


# ---- transcripts ----
def _transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each customer: a thread, a prompt, a reply of two lines, and a rule."""
    key = F.col("c_custkey")
    lines = F.array(
        F.concat(F.lit("Thread thread_"), key.cast("string"), F.lit(":\n")),
        F.lit("Agent (bot): What is your first name?\n"),
        F.lit("User (web):\n"),
        F.concat(_pick(key, golden.FIRST), F.lit("\n")),
        F.lit("[Intent: hello]\n"),
        F.lit("=" * 24 + "\n"),
        F.concat(F.lit("User (web): mail "), F.lower(_pick(key, golden.FIRST)), F.lit("@mail.example.com")),
    )
    return _read(spark, sf_dir, "customer").select(key.cast("string").alias("file"), F.posexplode(lines).alias("line_no", "line"))


@query(
    f"""SELECT CAST(c_custkey AS VARCHAR) AS file, CAST(n AS INTEGER) AS line_no, CASE n WHEN 0 THEN 'Thread thread_' || c_custkey || ':' WHEN 1 THEN 'Agent (bot): What is your first name?' WHEN 2 THEN 'User (web):' WHEN 3 THEN '<fn_1>'
WHEN 4 THEN '[Intent: hello]' WHEN 5 THEN '{'=' * 24}' ELSE 'User (web): <fn_2> <em_1>' END AS redacted, n IN (3, 4, 6) AS processed FROM customer, range(7) r(n)"""
)
def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.redact(_transcript(spark, sf_dir)).select("file", "line_no", F.rtrim(F.regexp_replace("redacted", "\n$", "")).alias("redacted"), "processed")


@query("SELECT count(*) AS threads, 2 * count(*) AS user_blocks, count(*) AS agent_blocks, 3 * count(*) AS processed_lines, 3 * count(*) AS replaced_tokens FROM customer")
def transcript_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _transcript(spark, sf_dir)
    return transcript.stats(lines, transcript.redact(lines))


@query("SELECT role, count(*) AS turns, count(*) FILTER (role = 'user') AS redacted_turns FROM conversations GROUP BY role")
def role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_if(transcript.should_redact(F.initcap("role"), "user-only")).alias("redacted_turns"))


