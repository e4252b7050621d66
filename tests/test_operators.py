import json
import time

import pytest
from pyspark.sql import functions as F

from spanveil import config
from spanveil.functions import spans, text
from spanveil.operators import allowlist, conversation, tokens, transcript
from spanveil.operators.vault import Vault
from spanveil.sources import messages
from spanveil.sources.stores import MemoryStore, StoreError, TableStore, build_store

PAYLOAD = {"plans": [{"name": "Redbud II", "tags": ["a", {"name": "b"}]}, {"name": "Cypress"}], "city": {"name": "Lorne", "n": 1}}


def test_selectors():
    assert allowlist.selector_steps("$.plans[*].name") == ["plans", "*", "name"]
    assert allowlist.selector_steps("..plans[0]['name']") == ["plans", 0, "name"]
    assert allowlist.select_nodes(PAYLOAD, "plans[1].name") == ["Cypress"]
    assert sorted(allowlist.collect_terms(PAYLOAD, [("**.name", "values")])) == ["Cypress", "Lorne", "Redbud II", "b"]
    assert set(allowlist.collect_terms(PAYLOAD, [("city", "both")])) == {"Lorne", "name", "n"}
    assert allowlist.name_terms(PAYLOAD) == ["Cypress", "Lorne", "Redbud II", "b"]
    assert "plans" in allowlist.all_terms(PAYLOAD)
    for bad in ("", "a[0"):
        with pytest.raises(ValueError):
            allowlist.selector_steps(bad)
    with pytest.raises(ValueError):
        allowlist.collect_terms(PAYLOAD, [("$", "all")])


def test_term_table_function(spark):
    allowlist.register_json_terms(spark)
    got = spark.sql("SELECT t.term FROM explode_json_terms('{\"a\": [\"x\", \"y\"]}', 'a', 'values') t").collect()
    assert sorted(r.term for r in got) == ["x", "y"]


def test_too_many_terms_is_an_error(spark):
    new = spark.createDataFrame([("c", "a", "v", 1.0, ["x", "y"])], "client_id string, assistant_id string, source_version string, updated_at_epoch double, terms array<string>")
    old = new.limit(0).withColumn("content_hash", F.lit(""))
    assert allowlist.refresh(old, new).first().changed
    with pytest.raises(Exception, match="max_terms"):
        allowlist.refresh(old, new, max_terms=1).collect()


def test_matches_have_code_point_offsets(spark):
    df = spark.createDataFrame([("é 😀 a@b.co, x.y@c.org",), ("",), (None,)], "text string")
    got = [r.m for r in df.select(spans.contact_spans(F.col("text")).alias("m")).collect()]
    assert [(s.start, s.end, s.value) for s in got[0]] == [(4, 10, "a@b.co"), (12, 21, "x.y@c.org")]
    assert got[1] == got[2] == []


def test_contacts_round_trip(spark):
    docs = spark.createDataFrame([("s", 1, "a@b.co and +1 555 010 2003"), ("s", 2, "A@B.co"), ("t", 1, "none"), (None, 3, None)], "scope string, seq int, text string")
    red = tokens.redact_contacts(docs, "scope", "seq", "text")
    assert {(r.scope, r.seq): r.redacted for r in red.collect()}[("s", 2)] == "<em_1>"
    vaults = tokens.vault_table(tokens.contact_mentions(docs, "scope", "seq", "text"))
    back = {(r.scope, r.seq): r.clean for r in tokens.rehydrate(red, vaults, "scope", "seq", "redacted").collect()}
    assert back[("s", 1)] == "a@b.co and +1 555 010 2003" and back[("s", 2)] == "a@b.co"


def _messages(spark, rows):
    cols = ", ".join(f"{c} string" for c in conversation.SCOPE)
    return spark.createDataFrame([("c", "a", "v", "s", t, *r) for t, *r in rows], f"{cols}, {conversation.MESSAGES}")


ROWS = [
    ("t1", 1, "in", 0.0, "My name is Orla Quist", None, None, False, True),
    ("t1", 2, "out", 10.0, "Hi <name>", None, None, False, True),
    ("t1", 3, "in", 4000.0, "My name is Tam Vey", None, ["x"], True, True),
    ("t1", 4, "end", 4001.0, None, None, None, False, True),
    ("t1", 5, "out", 4002.0, "Hi <fn_1>", None, None, False, True),
    ("t2", 1, "in", 0.0, "My name is Jem Lorne", None, None, False, None),
]


def _as_dict(rows):
    return {(r.thread_id, r.seq): (r.status, r.text, r.profile, r.generation) for r in rows}


EXPECTED = {
    ("t1", 1): ("ok", "My name is <fn_1> <ln_1>", 1, 1),
    ("t1", 2): ("ok", "Hi Orla Quist", 1, 1),
    ("t1", 3): ("ok", "My name is <fn_1> <ln_1>", 2, 2),
    ("t1", 4): ("ended", None, None, 2),
    ("t1", 5): ("error", None, None, 2),
    ("t2", 1): ("ok", "My name is <fn_1> <ln_1>", 1, 1),
}


@pytest.mark.parametrize("partitions", [1, 8])
def test_sessions_in_batch(spark, partitions):
    got = conversation.process(_messages(spark, ROWS).repartition(partitions))
    assert _as_dict(got.collect()) == EXPECTED


def test_stored_vaults_go_on(spark):
    v = Vault()
    v.assign("fn", "Orla")
    stored = spark.createDataFrame([("c", "a", "v", "s", "t9", json.dumps(v.snapshot()), 0.0)], ", ".join(f"{c} string" for c in conversation.SCOPE) + ", snapshot string, last_access double")
    rows = [("t9", 1, "out", 5.0, "Hi <fn_1>", None, None, False, True)]
    assert conversation.process(_messages(spark, rows), stored=stored).first().text == "Hi Orla"


def test_sessions_in_stream(spark, tmp_path):
    from spanveil.streaming.session import health, process_stream

    source = tmp_path / "in"
    _messages(spark, ROWS).coalesce(1).write.json(str(source))
    messages_ = spark.readStream.schema(_messages(spark, ROWS).schema).json(str(source))
    q = process_stream(messages_).writeStream.outputMode("append").format("memory").queryName("results").option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
    assert q.awaitTermination(120)
    assert _as_dict(spark.table("results").collect()) == EXPECTED
    assert isinstance(health(spark), list)


def _in_parts(spark, tmp_path, parts, name, start, **more):
    """Messages that arrive part by part, each taken by one run of a query over the same checkpoint."""
    from spanveil.streaming.session import process_stream

    source, out = tmp_path / name, []
    for i, rows in enumerate(parts):
        _messages(spark, rows).coalesce(1).write.json(str(source / str(i)))
        read = spark.readStream.schema(_messages(spark, ROWS).schema).json(str(source / "*"))
        q = start(process_stream(read, **more), out)
        assert q.awaitTermination(120)
    return out


def test_micro_batches_equal_the_batch(spark, tmp_path):
    rows = [*ROWS, ("t1", 6, "in", 4010.0, "My name is Bea Penrose", None, None, False, True)]

    def start(results, out):
        return results.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).foreachBatch(lambda df, i: out.extend(df.collect())).start()

    got = _in_parts(spark, tmp_path, [rows[:2] + rows[5:6], rows[2:4], [rows[4], rows[6]]], "in", start)
    want = _as_dict(conversation.process(_messages(spark, rows)).collect())
    assert want[("t1", 6)] == ("ok", "My name is <fn_1> <ln_1>", 1, 3)
    assert _as_dict(got) == want


def test_stored_vaults_in_a_stream_and_writes(spark, tmp_path):
    from spanveil.streaming.session import Health, write_behind

    v = Vault()
    v.assign("fn", "Orla")
    stored = spark.createDataFrame([("c", "a", "v", "s", "t9", json.dumps(v.snapshot()), 0.0)], ", ".join(f"{c} string" for c in conversation.SCOPE) + ", snapshot string, last_access double")
    parts = [[("t9", 1, "out", 5.0, "Hi <fn_1>", None, None, False, True), ("t8", 1, "in", 5.0, "My name is Tam Vey", None, None, False, True)], [("t8", 2, "end", 6.0, None, None, None, False, True)]]
    store, health = MemoryStore(spark), Health()

    def start(results, out):
        return write_behind(results, store, config.Settings(), str(tmp_path / "ck"), health, lambda df, i: out.extend(df.collect()), once=True)

    seen = _in_parts(spark, tmp_path, parts, "good", start, stored=stored, with_snapshots=True)
    assert {r.text for r in seen} == {"Hi Orla", "My name is <fn_1> <ln_1>", None} and not health.failed
    assert [r.scope_key for r in store.rows.collect()] == ["c:a:v:s:t9"]


def test_a_failed_store_blocks(spark, tmp_path):
    from spanveil.streaming.session import Health, write_behind

    store, health, seen = MemoryStore(spark), Health(), []
    store.apply = lambda *a: (_ for _ in ()).throw(StoreError("down"))
    schema = conversation.process(_messages(spark, ROWS), with_snapshots=True)
    schema.coalesce(1).write.parquet(str(tmp_path / "results"))
    for blocks in (True, False):
        results = spark.readStream.schema(schema.schema).parquet(str(tmp_path / "results"))
        settings = config.Settings(persistence_block_on_error=blocks)
        q = write_behind(results, store, settings, str(tmp_path / f"ck {blocks}"), health, lambda df, i: seen.extend(df.collect()), once=True)
        try:
            q.awaitTermination(60)
        except Exception:
            assert blocks
        assert health.failed and health.failures[-1][1] == "down" and len(seen) == (0 if blocks else len(ROWS))
    with pytest.raises(StoreError):
        health.require(config.Settings())
    health.require(config.Settings(persistence_block_on_error=False))


def test_snapshots_of_a_batch(spark):
    got = conversation.process(_messages(spark, ROWS), with_snapshots=True).where("op = 'vault'").collect()
    assert {r.thread_id: r.status for r in got} == {"t1": "gone", "t2": "kept"}
    assert Vault.restore(json.loads(next(r.snapshot for r in got if r.snapshot))).values == {"<fn_1>": "Jem", "<ln_1>": "Lorne"}


def test_models_by_settings(spark):
    from spanveil.operators.models import ModelError, ModelPlan, failures

    found = lambda model, labels: lambda text: [{"label": "name", "score": 0.9, "text": "Zed Vey"}, {"label": "name", "score": 0.5, "text": "Low"}, {"label": "city", "score": 1.0, "text": "Lorne"}]
    plan = ModelPlan(config.Settings(), None, found)
    assert [p["text"] for p in plan().names("x")] == ["Zed Vey"] and plan().failures == ("contacts: no contacts model is given",)
    assert [r.failure for r in failures(spark, plan).collect()] == ["contacts: no contacts model is given"]
    assert ModelPlan(config.Settings(use_contact_model=False, use_name_model=False))() .failures == ()
    with pytest.raises(ModelError):
        ModelPlan(config.Settings(require_contact_model=True))()
    rows = [("t1", 1, "in", 0.0, "we met Zed Vey there", None, None, False, True)]
    assert conversation.process(_messages(spark, rows), models=plan).first().text == "we met <fn_1> <ln_1> there"


def test_odd_lines(spark, tmp_path):
    rows = [("f", 0, "Thread t1:\n"), ("f", 1, None), ("f", 2, "User (w): I am Orla Quist\n"), ("f", 3, None), (None, 0, "User (w): x\n"), ("g", None, "y")]
    got = transcript.redact(spark.createDataFrame(rows, "file string, line_no int, line string")).collect()
    assert len(got) == 6 and {r.redacted for r in got} == {"Thread t1:\n", None, "User (w): I am <fn_1> <ln_1>\n", "User (w): x\n", "y"}
    (tmp_path / "odd.txt").write_bytes("Thread t1:\r\nUser (w): I am Orla Quist\rnext\x0bline\u2028end".encode())
    lines = [r.line for r in transcript.read_lines(spark, str(tmp_path / "odd.txt")).orderBy("line_no").collect()]
    assert lines == ["Thread t1:\n", "User (w): I am Orla Quist\n", "next\x0b", "line\u2028", "end"]


def test_named_outputs(spark, tmp_path):
    (tmp_path / "talk.a.txt").write_text("Thread t1:\nUser (w): I am Orla Quist\nbye\n")
    want = "Thread t1:\nUser (w): I am <fn_1> <ln_1>\nbye\n"
    where, counted = transcript.redact_file(spark, str(tmp_path / "talk.a.txt"))
    assert where == str(tmp_path / "talk.a.redacted.txt") and (tmp_path / "talk.a.redacted.txt").read_text() == want and counted.user_blocks == 1
    transcript.write(transcript.redact(transcript.read_lines(spark, str(tmp_path / "talk.a.txt"))), str(tmp_path / "out"), tag="x")
    (part,) = (tmp_path / "out" / "name=talk.a.redacted.x.txt").glob("part-*.txt")
    assert part.read_text() == want
    (tmp_path / "terms.json").write_text('{"plan": ["Orla Quist"]}')
    transcript.main([str(tmp_path / "talk.a.txt"), "--output", str(tmp_path / "o.txt"), "--terms", str(tmp_path / "terms.json"), "--mode", "both"])
    assert (tmp_path / "o.txt").exists()


def test_transcript_files(spark, tmp_path):
    text = "Started: now | Thread: t1\nAgent (bot):\nWhat is your first name?\n\nUser (web): Orla\n[Area: x]\nmail oq@mail.example.com\n" + "=" * 20 + "\nUser (web): Orla\n"
    (tmp_path / "talk.txt").write_text(text)
    lines = transcript.read_lines(spark, str(tmp_path / "talk.txt"))
    got = "".join(r.redacted for r in transcript.redact(lines).orderBy("line_no").collect())
    assert got == text.replace("Orla", "<fn_1>").replace("mail oq@mail.example.com", "<fn_2> <em_1>")
    stats = transcript.stats(lines, transcript.redact(lines)).first()
    assert (stats.threads, stats.user_blocks, stats.agent_blocks, stats.replaced_tokens) == (1, 2, 1, 4)
    assert transcript.output_path("/a/talk.txt", tag="x") == "/a/talk.redacted.x.txt"
    transcript.write(transcript.redact(lines), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        transcript.redact(lines, mode="all")


def test_settings():
    s = config.load({"SPANVEIL_VAULT_TTL_SECONDS": "5", "SPANVEIL_MAX_ACTIVE_SCOPES": "x", "SPANVEIL_REQUIRE_API_KEY": "off", "SPANVEIL_NON_NAME_TERMS": "a, b,,"})
    assert (s.vault_ttl_seconds, s.max_active_scopes, s.require_api_key, s.non_name_terms) == (60, 15, False, ("a", "b"))


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "{}", "2999-01-01T00:00:00Z", "v1"), ("k2", "{}", "2000-01-01T00:00:00Z", "v1")], "scope_key string, snapshot string, expires_at string, key_version string")
    keys = rows.select("scope_key")
    table = TableStore(spark, str(tmp_path / "store"), "master")
    assert table.load(keys).count() == 0
    table.save(rows)
    table.save(rows.where("scope_key = 'k1'").withColumn("snapshot", F.lit("[1]")))
    assert [(r.scope_key, r.snapshot) for r in table.load(keys).collect()] == [("k1", "[1]")]
    table.delete(keys.where("scope_key = 'k1'"))
    assert table.load(keys).count() == 0
    memory = MemoryStore(spark)
    memory.save(rows)
    assert memory.load(keys).count() == 2


def make_store(settings):
    return MemoryStore.__new__(MemoryStore)


@pytest.mark.parametrize(
    "given, mode",
    [
        ({}, "none"),
        ({"require_persistence": True}, None),
        ({"persistence_mode": "internal", "internal_store": "memory"}, "internal:memory"),
        ({"persistence_mode": "internal"}, None),
        ({"persistence_mode": "internal", "internal_store": "zz"}, None),
        ({"persistence_mode": "external"}, None),
        ({"persistence_mode": "external", "external_store_factory": "tests.test_operators:make_store"}, "external"),
        ({"persistence_mode": "external", "external_store_factory": "tests.test_operators:gone"}, None),
        ({"persistence_mode": "zz"}, None),
    ],
)
def test_store_factory(spark, given, mode):
    settings = config.Settings(**given)
    if mode is None:
        with pytest.raises(StoreError):
            build_store(spark, settings)
    else:
        assert build_store(spark, settings)[1] == mode
    with pytest.raises(StoreError):
        build_store(spark, config.Settings(persistence_mode="external"), external=object())


def test_read_requests(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"thread_id": "thread_1", "message": "hi", "new_user": true}\n')
    assert messages.read_requests(spark, str(tmp_path / "r.json")).first().new_user


def test_read_refreshes(spark, tmp_path):
    from spanveil.operators import requests

    (tmp_path / "r.json").write_text('{"client_id": "c", "terms": ["x"]}\n{"client_id": "c"}\n{"client_id": "c", "payload": "{}", "selectors": [{"selector": "a", "include": "values"}]}\n')
    got = requests.validate_refresh(messages.read_refreshes(spark, str(tmp_path / "r.json"))).collect()
    assert sorted(len(r.errors) for r in got) == [0, 0, 1]


def test_snapshots_of_tables_are_those_of_vaults(spark):
    docs = spark.createDataFrame([("s", 1, "a@b.co and 555 010 2003"), ("s", 2, "c@d.co a@b.co"), (None, 1, "x@y.org")], "scope string, seq int, text string")
    vaults = tokens.vault_table(tokens.contact_mentions(docs, "scope", "seq", "text"))
    plain = Vault()
    for entity, value in (("em", "a@b.co"), ("ph", "555 010 2003"), ("em", "c@d.co")):
        plain.assign(entity, value)
    got = {r.scope: json.loads(r.snapshot) for r in tokens.snapshots(vaults).collect()}
    assert got["s"] == plain.snapshot() and got[None]["token_to_value"] == {"<em_1>": "x@y.org"}


def test_epoch_iso_years_beyond_9999_have_no_plus(spark):
    keys = [0, 2932896, 2932897, 8999999, -719163]
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", text.epoch_iso((F.col("k") * 86400).cast("double")).alias("iso"))
    got = {r.k: r.iso for r in rows.collect()}
    want = ["1970-01-01", "9999-12-31", "10000-01-01", "26611-03-01", "0000-12-31"]
    assert [got[k] for k in keys] == [f"{d}T00:00:00+00:00" for d in want]


def test_equal_rows_of_a_batch_are_worked_out_once():
    asked = []

    def of(x, y, z):
        asked.append((x, y, z))
        return x, y, None if z is None else list(z)

    rows = [("a", None, ["t"]), ("a", None, ["t"]), ("a", "", ["t"]), ("a", None, None), ("a", None, []), (None, None, ["t"]), ("a", None, ["t", "u"]), ("a", None, ["t"])]
    assert conversation._each(of, *zip(*rows, strict=True)) == rows
    assert len(asked) == 6
