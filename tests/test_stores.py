"""The keyed store and the sink: several writers, crashes at each step, batches that come again."""

import json
import threading

import pytest

from spanveil import config
from spanveil.operators import conversation
from spanveil.operators.vault import Vault
from spanveil.sources.commits import CommitLog, rename
from spanveil.sources.stores import MemoryStore, TableStore
from spanveil.streaming.session import Health, ResultSink, process_stream, write_behind

FIELDS = "scope_key string, snapshot string, expires_at string, key_version string"


def _rows(spark, keys, snapshot="{}"):
    return spark.createDataFrame([(k, snapshot, "2999-01-01T00:00:00Z", "v1") for k in keys], FIELDS)


def _held(store, spark, keys):
    return {r.scope_key: r.snapshot for r in store.load(_rows(spark, keys).select("scope_key")).collect()}


def test_a_commit_is_made_once(spark, tmp_path):
    logs = [CommitLog(spark, str(tmp_path / "log")) for _ in range(8)]
    won = []
    threads = [threading.Thread(target=lambda k=k, log=log: won.append(k) if log.commit("1", {"k": k}) else None) for k, log in enumerate(logs)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and logs[0].names() == ["1"] and logs[0].read("1") == {"k": won[0]}


def test_renames(spark, tmp_path):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for n in "ab":
        (tmp_path / n).write_text(n)
    a, b = (path(f"file://{tmp_path}/{n}") for n in "ab")
    with pytest.raises(Exception, match="exists"):
        rename(spark, a, b, overwrite=False)
    rename(spark, a, b, overwrite=True)
    assert (tmp_path / "b").read_text() == "a" and not (tmp_path / "a").exists()


def test_two_writers_lose_nothing(spark, tmp_path):
    stores = [TableStore(spark, str(tmp_path / "store"), "m", parts=3) for _ in range(3)]
    failed = []

    def write(n, store):
        try:
            for i in range(4):
                store.save(_rows(spark, [f"w{n}-{i}", f"w{n}-again"], f"{n}.{i}"))
            store.delete(_rows(spark, [f"w{n}-0"]).select("scope_key"))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=x) for x in enumerate(stores)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    want = {f"w{n}-{i}": f"{n}.{i}" for n in range(3) for i in range(1, 4)} | {f"w{n}-again": f"{n}.3" for n in range(3)}
    assert _held(stores[0], spark, [*want, "w0-0", "w1-0", "w2-0"]) == want
    assert stores[0].version()[0] == 15


@pytest.mark.parametrize("step", ["_write", "commit", "after the change", "delete"])
def test_a_crash_leaves_the_last_version(spark, tmp_path, monkeypatch, step):
    store = TableStore(spark, str(tmp_path / "store"), "m", parts=4)
    keys = [f"k{i}" for i in range(10)]
    store.save(_rows(spark, keys, "old"))
    calls = []

    def crash(*a, **k):
        raise RuntimeError("gone")

    broken = TableStore(spark, str(tmp_path / "store"), "m", parts=4)
    if step == "_write":
        broken._write = crash
    elif step == "after the change":
        own = broken._write
        broken._write = lambda rows: calls.append(1) or (own(rows) if len(calls) == 1 else crash())
    elif step == "commit":
        broken.log.commit = crash
    else:  # the commit's file is written, but not put in its place
        broken.log._put = crash
    with pytest.raises(RuntimeError, match="gone"):
        broken.apply(_rows(spark, keys[:5], "new"), _rows(spark, keys[5:7]).select("scope_key"), "w", 0)
    fresh = TableStore(spark, str(tmp_path / "store"), "m", parts=4)
    assert _held(fresh, spark, keys) == dict.fromkeys(keys, "old")
    assert fresh.apply(_rows(spark, keys[:5], "new"), _rows(spark, keys[5:7]).select("scope_key"), "w", 0)
    assert _held(fresh, spark, keys) == dict.fromkeys(keys[:5], "new") | dict.fromkeys(keys[7:], "old")
    assert fresh.vacuum(kept=1, hours=0) > 0 and fresh.log.names() == [f"{2:020d}"]
    assert _held(fresh, spark, keys) == dict.fromkeys(keys[:5], "new") | dict.fromkeys(keys[7:], "old")


@pytest.mark.parametrize("kind", ["memory", "table"])
def test_a_batch_is_applied_once(spark, tmp_path, kind):
    store = MemoryStore(spark) if kind == "memory" else TableStore(spark, str(tmp_path / "store"), "m", parts=2)
    none = _rows(spark, []).select("scope_key")
    assert store.apply(_rows(spark, ["a", "b"], "1"), none, "q", 0)
    assert not store.apply(_rows(spark, ["a"], "again"), none, "q", 0)
    assert store.apply(_rows(spark, ["a"], "2"), _rows(spark, ["b"]).select("scope_key"), "q", 1)
    assert store.apply(_rows(spark, ["c"], "other"), none, "another", 0)
    assert _held(store, spark, "abc") == {"a": "2", "c": "other"}
    evaluated = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            evaluated.add(b.num_rows)
            yield b

    store.apply(_rows(spark, ["d"]).mapInArrow(count, FIELDS), none, "q", 2)
    assert evaluated.value == 1 and _held(store, spark, "d") == {"d": "{}"}


def test_a_key_is_looked_up_in_its_part(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"), "m", parts=8)
    store.save(_rows(spark, [f"k{i}" for i in range(200)]))
    assert len(store.version()[1]["parts"]) == 8 and store.rows().count() == 200
    read = store.load(_rows(spark, ["k7"]).select("scope_key"))
    files = {f.rpartition("/")[0].rpartition("/")[2] for f in read.select("scope_key").inputFiles()}
    assert len(files) == 1 and [r.snapshot for r in read.collect()] == ["{}"]


MESSAGES = [("t9", 1, "out", 5.0, "Hi <fn_1>", None, None, False, True), ("t8", 1, "in", 5.0, "My name is Tam Vey", None, None, False, True)]


@pytest.mark.parametrize("where", ["between", "after"])
def test_a_batch_that_was_cut_short_is_neither_lost_nor_doubled(spark, tmp_path, where):
    v = Vault()
    v.assign("fn", "Orla")
    scope = ", ".join(f"{c} string" for c in conversation.SCOPE)
    stored = spark.createDataFrame([("c", "a", "v", "s", "t9", json.dumps(v.snapshot()), 0.0)], f"{scope}, snapshot string, last_access double")
    rows = spark.createDataFrame([("c", "a", "v", "s", t, *r) for t, *r in MESSAGES], f"{scope}, {conversation.MESSAGES}")
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    store, out, seen = TableStore(spark, str(tmp_path / "store"), "m", parts=2), ResultSink(spark, str(tmp_path / "out")), []

    class Cut(ResultSink):
        def add(self, *a, **k):
            if where == "after":
                super().add(*a, **k)
            raise RuntimeError("killed")

    for sink in (Cut(spark, out.path), out, out):
        read = spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))
        results = process_stream(read, stored=stored, with_snapshots=True)
        q = write_behind(results, store, config.Settings(), str(tmp_path / "ck"), Health(), lambda df, i: seen.append(i), sink, once=True)
        try:
            q.awaitTermination(120)
        except Exception as e:
            assert "killed" in str(e)
    assert sorted(r.text for r in out.read().collect()) == ["Hi Orla", "My name is <fn_1> <ln_1>"]
    assert store.version()[0] == 1 and seen == [0]
    assert sorted(r.scope_key for r in store.rows().collect()) == ["c:a:v:s:t8", "c:a:v:s:t9"]  # expired long ago, so not loaded
