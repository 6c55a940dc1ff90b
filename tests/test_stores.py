from __future__ import annotations

import json

import pytest

from quillspark.sources.store import ReadOnlyError, StoreTable

ROWS = [("1", "Tides of the bay", "Mara", 1991, "Sea", None), ("2", "Lamps on the pier", "Mara", 1994, "Sea", "D'Arcy & Son"), ("3", "Snow in the pass", "Teo", 1987, "Hills", None), ("4", "Wind over the ridge", "Teo", 1983, "Hills", "Quarry")]
SCHEMA = {"writer": "VARCHAR", "printed": "INTEGER", "shelf": "VARCHAR"}
DDL = "id string, page_content string, writer string, printed int, shelf string, house string"


@pytest.fixture(params=["typed", "untyped"])
def store(request, spark):
    made = StoreTable.in_memory(spark, metadata_schema=SCHEMA if request.param == "typed" else None, n_buckets=4)
    made.add(spark.createDataFrame(ROWS, DDL))
    yield made
    made.close()


def ids(df):
    return sorted(r.id for r in df.collect())


def test_contract(store, spark):
    assert store.count() == 4 and ids(store.all()) == ["1", "2", "3", "4"]
    row = store.get("2")
    assert row.page_content == "Lamps on the pier" and store.metadata_of(row) == {"writer": "Mara", "printed": 1994, "shelf": "Sea", "house": "D'Arcy & Son"}
    assert store.get("9") is None and store.get("1' -- '") is None
    got = store.get_many(["3", "9", "1", "3"]).collect()
    assert [(r.id, r.found, r.page_content) for r in got] == [("3", True, "Snow in the pass"), ("9", False, None), ("1", True, "Tides of the bay"), ("3", True, "Snow in the pass")]
    assert store.get_many([]).count() == 0
    found, missing = store.check_ids(["9", "1", "1", "8"])
    assert [r.id for r in found.collect()] == ["1", "1"] and [r.id for r in missing.collect()] == ["9", "8"]


def test_filters(store):
    assert ids(store.filter()) == ["1", "2", "3", "4"]
    assert ids(store.filter(writer="Mara")) == ["1", "2"]
    assert ids(store.filter(writer="Teo", printed=1983)) == ["4"]
    assert ids(store.filter(house="D'Arcy & Son")) == ["2"]
    assert ids(store.filter(writer="Teo", house="Quarry")) == ["4"]
    assert ids(store.filter(writer="nobody")) == []
    assert ids(store.filter(house=None)) == ["1", "3"]
    with pytest.raises(ValueError, match="mode"):
        store.filter(mode="other", writer="Teo")


def test_upsert_replaces_and_last_row_wins(store, spark):
    new = [("1", "first", "A", 1, "c", None), ("1", "second", "A", 1, "c", None), ("5", "five", "A", 1, "c", None)]
    store.add(spark.createDataFrame([(*r, i) for i, r in enumerate(new)], DDL + ", _ord long"))
    assert store.count() == 5 and store.get("1").page_content == "second"
    assert [r.id for r in store.all(ordered=True).collect()] == ["1", "2", "3", "4", "5"]
    assert [len(b) for b in store.iter_batches(2)] == [2, 2, 1]
    assert len(list(store.lazy_all())) == 5
    with pytest.raises(ValueError, match="batch_size"):
        next(store.iter_batches(0))


def test_delete(store):
    store.delete("1")
    store.delete("nowhere")
    store.delete_many([])
    store.delete_many(["2", "nowhere"])
    assert ids(store.all()) == ["3", "4"]
    store.delete_many(["3", "4"])
    assert store.count() == 0 and store.get("3") is None


def test_ids_are_required(store, spark):
    for bad in (None, ""):
        with pytest.raises(ValueError, match="without an id"):
            store.add(spark.createDataFrame([("ok", "x"), (bad, "y")], "id string, page_content string"))
    assert store.count() == 4


def test_reopen_and_read_only(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        StoreTable.open(spark, path, read_only=True)
    with StoreTable.open(spark, path, metadata_schema=SCHEMA) as store:
        store.add(spark.createDataFrame(ROWS, DDL))
    with pytest.raises(RuntimeError, match="closed"):
        store.count()
    store.close()
    with store:
        assert store.count() == 4
    again = StoreTable.open(spark, path, metadata_schema=SCHEMA, read_only=True)
    assert again.count() == 4
    with pytest.raises(ReadOnlyError):
        again.delete("1")
    assert again.get_columns_info() == {"id": "string", "page_content": "string", "writer": "string", "printed": "int", "shelf": "string", "extra": "string"}
    again.show_columns_info()


def test_concurrent_writers_do_not_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    a, b = StoreTable.open(spark, path), StoreTable.open(spark, path)
    a.add(spark.createDataFrame([("1", "x")], "id string, page_content string"))
    stale = b._manifest() | {"version": 1}
    with pytest.raises(Exception, match="exists"):
        b._commit(stale)


def test_only_touched_buckets_are_rewritten(spark):
    store = StoreTable.in_memory(spark, n_buckets=8)
    store.add(spark.createDataFrame([(str(i), "x") for i in range(100)], "id string, page_content string"))
    before = store._manifest()["buckets"]
    store.add(spark.createDataFrame([("7", "y")], "id string, page_content string"))
    after = store._manifest()["buckets"]
    assert sum(before[k] != after[k] for k in before) == 1 and store.count() == 100


def test_records(spark):
    store = StoreTable.in_memory(spark, kind="record")
    rows = [("1", json.dumps({"y": 2022, "b": True})), ("2", json.dumps({"y": "2022", "a": {"b": "nest"}}))]
    store.add_records(spark.createDataFrame(rows, "id string, metadata string"))
    assert ids(store.filter(y=2022)) == ["1"] and ids(store.filter(y="2022")) == ["2"]
    assert ids(store.filter(mode="text", y=2022)) == ["1", "2"]
    assert ids(store.filter(mode="text", **{"a.b": "nest"})) == ["2"] and ids(store.filter(**{"a.b": "nest"})) == []
    assert ids(store.filter(mode="text", b=True)) == ["1"]
    typed = StoreTable.in_memory(spark, kind="record", metadata_schema={"y": "VARCHAR"})
    typed.add(store.all())
    merged = {r.id: json.loads(r.metadata) for r in typed.with_metadata(typed.all()).collect()}
    assert merged == {"1": {"y": "2022", "b": True}, "2": {"y": "2022", "a": {"b": "nest"}}}
    with pytest.raises(ValueError, match="reserved"):
        StoreTable.in_memory(spark, metadata_schema={"extra": "VARCHAR"})
