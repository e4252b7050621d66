"""Every setting acts: on a batch service, its store, lists, models and replies."""

import json

import pytest
from pyspark.sql import functions as F

from spanveil.config import Settings
from spanveil.operators.models import ModelError
from spanveil.service import Service, configured_terms
from spanveil.sources.allowlists import AllowlistFiles
from spanveil.sources.messages import REQUEST
from spanveil.sources.stores import StoreError, TableStore

NAMES = [f.split()[0] for f in REQUEST.split(", ")]


def _requests(spark, *rows):
    base = {"thread_id": "thread_1", "session_id": "s", "visitor_id": "v", "client_id": "c", "assistant_id": "a", "op": "in", "ts": 0.0}
    full = [base | {"seq": i} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in full], REQUEST)


def _by_seq(df):
    return {r.seq: r for r in df.collect()}


def test_terms_and_exposure(spark, tmp_path):
    (tmp_path / "terms.json").write_text('{"x": ["Orla Quist"]}')
    row = {"message": "Name: Orla Quist", "include_replacements": True}
    plain = _by_seq(Service(spark).process(_requests(spark, row, {"message": ""})))
    assert plain[0].text == "Name: <fn_1> <ln_1>" and plain[0].replacements is None
    assert plain[1].status == "invalid" and plain[1].errors == ["message: length"]
    open_ = Service(spark, Settings(allow_raw_replacements=True)).process(_requests(spark, row, row | {"include_replacements": False}))
    assert {s: r.replacements for s, r in _by_seq(open_).items()} == {0: {"<fn_1>": "Orla", "<ln_1>": "Quist"}, 1: None}
    assert configured_terms(Settings(non_name_terms=("Shadow  Hills!",), non_name_terms_json_path=str(tmp_path / "terms.json"))) == ["orla quist", "shadow hills", "x"]
    with pytest.warns(UserWarning):
        assert configured_terms(Settings(non_name_terms_json_path=str(tmp_path / "gone.json"))) == []
    listed = Service(spark, Settings(non_name_terms=("quist", "orla"))).process(_requests(spark, row))
    assert _by_seq(listed)[0].text == "Name: Orla Quist"


def test_allowlist_files(spark, tmp_path):
    files = AllowlistFiles(spark, str(tmp_path / "lists"), max_terms=3)
    assert files.read().count() == 0
    new = spark.createDataFrame([("c", "a", "v1", 1.0, ["Orla", "orla ", "Quist"])], "client_id string, assistant_id string, source_version string, updated_at_epoch double, terms array<string>")
    assert files.refresh(new).first().changed and not files.refresh(new.withColumn("source_version", F.lit("v2"))).first().changed
    (name,) = [p.name for p in (tmp_path / "lists").glob("*.json")]
    assert json.loads((tmp_path / "lists" / name).read_text())["terms"] == ["orla", "quist"] and name.startswith("c__a__")
    (tmp_path / "lists" / "broken.json").write_text("{")
    assert [r.source_version for r in files.read().collect()] == ["v1"]
    with pytest.raises(Exception, match="max_terms"):
        files.refresh(new.withColumn("terms", F.array(*(F.lit(x) for x in "abcd"))))
    for enabled, text in ((True, "Name: Orla Quist"), (False, "Name: <fn_1> <ln_1>")):
        s = Settings(allowlist_enabled=enabled, allowlist_path=str(tmp_path / "lists"), allowlist_max_terms=100)
        assert _by_seq(Service(spark, s).process(_requests(spark, {"message": "Name: Orla Quist"})))[0].text == text


def test_vaults_are_kept_between_batches(spark, tmp_path):
    s = Settings(persistence_mode="internal", store_path=str(tmp_path / "store"), persistence_master_key="m", persistence_key_version="v7")
    service = Service(spark, s)
    assert service.mode == "internal:table"
    assert _by_seq(service.process(_requests(spark, {"message": "Name: Orla Quist", "ts": 4e9})))[0].status == "ok"
    assert TableStore(spark, s.store_path, "m").rows().first().key_version == "v7"
    again = _by_seq(Service(spark, s).process(_requests(spark, {"op": "out", "message": "Hi <fn_1>", "ts": 4e9}, {"op": "end", "message": "-", "ts": 4e9 + 1})))
    assert (again[0].text, again[1].status) == ("Hi Orla", "ended")
    assert _by_seq(Service(spark, s).process(_requests(spark, {"op": "out", "message": "Hi <fn_1>", "ts": 4e9})))[0].status == "error"


def test_failures_of_the_store_and_of_messages(spark, tmp_path):
    lost = {"op": "out", "message": "Hi <fn_1>"}
    for default, status in ((True, "error"), (False, "raw")):
        got = _by_seq(Service(spark, Settings(fail_closed_default=default)).process(_requests(spark, lost, lost | {"failure_mode": "open"}, lost | {"failure_mode": "closed"})))
        assert [got[i].status for i in range(3)] == [status, "raw", "error"]
    for blocks in (True, False):
        service = Service(spark, Settings(persistence_mode="internal", internal_store="memory", persistence_block_on_error=blocks))
        service.store.apply = lambda *a: (_ for _ in ()).throw(StoreError("down"))
        service.process(_requests(spark, {"message": "x"}))
        if blocks:
            with pytest.raises(StoreError):
                service.process(_requests(spark, {"message": "x"}))
        else:
            assert service.process(_requests(spark, {"message": "x"})).count() == 1
    with pytest.raises(StoreError):
        Service(spark, Settings(require_persistence=True))


def test_models_ttl_keys_and_capacity(spark):
    met = {"message": "we met Zed Vey there"}
    found = lambda model, labels: lambda text: [{"label": "name", "score": 0.8, "text": "Zed Vey"}]
    for settings, text in ((Settings(), "we met <fn_1> <ln_1> there"), (Settings(name_model_threshold=0.9), met["message"]), (Settings(use_name_model=False), met["message"]), (Settings(name_model_labels=("person",)), met["message"])):
        assert _by_seq(Service(spark, settings, name_model=found).process(_requests(spark, met)))[0].text == text
    with pytest.raises(ModelError):
        Service(spark, Settings(require_name_model=True)).models()
    two = [{"message": "Name: Orla Quist"}, {"op": "out", "message": "Hi <fn_1>", "ts": 90.0}]
    for ttl, status in ((60, "error"), (120, "ok")):
        assert _by_seq(Service(spark, Settings(vault_ttl_seconds=ttl)).process(_requests(spark, *two)))[1].status == status
    keyed = spark.createDataFrame([("k",), ("x",)], "k string")
    status = lambda s: [r[0] for r in keyed.select(Service(spark, s).key_status(F.col("k"))).collect()]
    assert status(Settings(api_key="k")) == [200, 401] and status(Settings()) == [503, 503] and status(Settings(require_api_key=False)) == [200, 200]
    seen = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 4)], "scope_key string, ts int")
    service = Service(spark, Settings(max_active_scopes=2, persistence_mode="internal", internal_store="memory"))
    service.store.rows = spark.createDataFrame([(k, "{}", None, "v1") for k in "abc"], service.store.rows.schema)
    assert [r.scope_key for r in service.evict(seen, "scope_key", "ts").collect()] == ["b"]
    assert sorted(r.scope_key for r in service.store.rows.collect()) == ["a", "c"]
