"""The connector source: two partitions, ranges, fetched documents and access lists, replay after a failure, acknowledged checkpoints."""

import json

import pytest

from corvex.sources.connectors import ConnectorSource, FolderConnector


def change(root, partition, source, operation="updated", **metadata):
    with open(root / "changes" / f"{partition}.jsonl", "a", encoding="utf-8") as file:
        file.write(json.dumps({"source_id": source, "operation": operation, "metadata": metadata}) + "\n")


@pytest.fixture
def store(tmp_path):
    root = tmp_path / "store"
    for folder in ("changes", "documents", "acl"):
        (root / folder).mkdir(parents=True)
    (root / "documents" / "a").write_bytes(b"text of a")
    (root / "acl" / "a.json").write_text('{"users": ["u1"], "groups": []}')
    for i in range(25):
        change(root, "p0", "a", n=i)
    change(root, "p1", "b", "deleted")
    change(root, "p1", "c", "created")
    return root


def test_connector_stream(spark, store, tmp_path):
    spark.dataSource.register(ConnectorSource)
    out, failing = str(tmp_path / "out"), {1}

    def sink(df, batch):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        if batch in failing:
            failing.remove(batch)
            raise RuntimeError("killed")

    def run():
        stream = spark.readStream.format("corvex_connector").option("root", str(store)).option("range", 10).option("fetch", "true").load()
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.partition, r.offset) for r in rows) == [("p0", i) for i in range(25)] + [("p1", 0), ("p1", 1)]
    by = {(r.partition, r.offset): r for r in rows}
    assert bytes(by["p0", 3].content) == b"text of a" and json.loads(by["p0", 3].acl) == {"users": ["u1"], "groups": []} and by["p0", 3].metadata == '{"n": 3}'
    assert (by["p1", 0].operation, by["p1", 0].content, by["p1", 0].acl) == ("deleted", None, None) and (by["p1", 1].content, by["p1", 1].acl) == (None, None)

    change(store, "p1", "a", "created")
    change(store, "p2", "a", "created")
    with open(store / "changes" / "p0.jsonl", "a") as file:
        file.write('{"source_id": "half')  # not yet a whole line
    with pytest.raises(Exception, match="killed"):
        run()
    assert FolderConnector(str(store)).acknowledged().get("p2") is None  # the failed batch is not acknowledged
    run()
    again = sorted((r.partition, r.offset) for r in spark.read.parquet(out).collect())
    assert again == sorted([("p0", i) for i in range(25)] + [("p1", 0), ("p1", 1), ("p1", 2), ("p2", 0)])  # nothing twice, nothing lost
    change(store, "p2", "b", "deleted")
    run()
    assert FolderConnector(str(store)).acknowledged()["p1"] == 3 and len(spark.read.parquet(out).collect()) == 30


def test_connector_ranges_and_paths(store):
    from corvex.sources.connectors import _Changes

    reader = _Changes({"root": str(store), "range": "10"})
    assert [(p.partition, p.start, p.end) for p in reader.partitions({"p0": 5}, reader.latestOffset())] == [("p0", 5, 15), ("p0", 15, 25), ("p1", 0, 2)]
    with pytest.raises(ValueError):
        FolderConnector(str(store)).fetch_document("../../etc/passwd")
