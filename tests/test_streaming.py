import pytest

from ledgerloom.operators import ledger
from ledgerloom.sources import derived
from ledgerloom.streaming import ledger as streams
from ledgerloom.sources.files import Files
from tests.helpers import rows, values

SF = "/root/testdata/sf0.001"


def in_pieces(spark, out):
    """The events in four files, out of order, read one file at a time."""
    events = derived.table(spark, SF, "events")
    folder = f"{out}/events"
    for piece in (2, 0, 3, 1):
        events.filter(f"event_id % 4 = {piece}").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return events, stream


def test_latest_status_follows_the_batch_operator(spark, out):
    events, stream = in_pieces(spark, out)
    updates = streams.latest_status_stream(derived.from_events(stream))
    query = streams.drain(streams.changes_to_table(updates, f"{out}/rows"), f"{out}/check")
    assert len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) == 4
    now = streams.current_rows(spark.read.parquet(f"{out}/rows"), ledger.KEYS)
    batch = ledger.latest_record(derived.from_events(events))
    expected = {
        (r["node_id"], r["environment_id"], r["id"], r["direction"] == "UP" and r["status"] == "SUCCESS")
        for r in batch.collect()
    }
    assert rows(now, "node_id", "environment_id", "id", "executed") == expected


def test_ties_in_the_stream(spark, out):
    tied = spark.sql(
        """SELECT id, 'n' AS node_id, 'dev' AS environment_id, 'UP' AS direction,
        'SUCCESS' AS status, timestamp '2024-01-01' AS executed_at
        FROM VALUES ('b'), ('ab'), ('a'), ('aa') AS t(id)"""
    )
    tied.repartition(4).write.parquet(f"{out}/in")
    stream = spark.readStream.schema(tied.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    updates = streams.latest_status_stream(stream)
    streams.drain(streams.changes_to_table(updates, f"{out}/rows"), f"{out}/check")
    now = streams.current_rows(spark.read.parquet(f"{out}/rows"), ledger.KEYS)
    assert rows(now, "id") == {("a",)}


def test_counts_close_behind_the_watermark(spark, out):
    events, _ = in_pieces(spark, out)
    late = events.selectExpr(
        "event_id + 100000 AS event_id", "ts + interval 400 days AS ts", "user_id", "event_type",
        "value", "props",
    ).limit(1)
    events.coalesce(1).write.parquet(f"{out}/in")
    late.coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{out}/in")
    counts = streams.outcome_counts_stream(derived.run_events(stream), lateness="1 day")
    sink = counts.writeStream.format("parquet").option("path", f"{out}/counts").outputMode("append")
    streams.drain(sink, f"{out}/check")
    found = spark.read.parquet(f"{out}/counts")
    total = found.selectExpr("sum(succeeded + skipped + failed) AS n").first()["n"]
    assert total == events.count()


def test_counts_lose_no_late_event(spark, out):
    events, stream = in_pieces(spark, out)
    counts = streams.outcome_counts_stream(derived.run_events(stream))
    query = streams.drain(streams.changes_to_table(counts, f"{out}/counts"), f"{out}/check")
    assert len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) == 4
    now = streams.current_rows(spark.read.parquet(f"{out}/counts"), ["window_start", "direction"])
    total = now.selectExpr("sum(succeeded + skipped + failed) AS n").first()["n"]
    assert total == events.count()


def test_append_each_id_once(spark, out):
    events, stream = in_pieces(spark, out)
    path = f"{out}/ledger"
    records = derived.from_events(stream)
    streams.drain(streams.history_append_stream(records.unionByName(records), path), f"{out}/c1")
    stored = spark.read.parquet(path)
    assert stored.count() == events.count() == stored.select("id").distinct().count()
    # A new run over the same input, as after a lost checkpoint, adds nothing.
    streams.drain(streams.history_append_stream(records, path), f"{out}/c2")
    assert spark.read.parquet(path).count() == events.count()


def versions(spark, n, batch):
    """One row for each of ten keys, and which batch wrote it."""
    return spark.range(10).selectExpr("id AS key", f"id * 1000 + {batch} AS value").filter(f"key % {n} = 0")


def test_fifty_batches_stay_few_folders(spark, out, monkeypatch):
    table = spark.range(0).selectExpr("id AS key", "id AS value")
    monkeypatch.setattr(type(table), "writeStream", property(lambda self: Catch()))
    caught = []

    class Catch:
        def outputMode(self, mode):
            return self

        def foreachBatch(self, write):
            caught.append(write)

    path, expected, most = f"{out}/table", {}, 0
    streams.keep_current(table, path, ["key"], fold_every=8)
    monkeypatch.undo()
    files = Files(spark, path)
    for batch in range(50):
        n = 1 + batch % 4
        caught[0](versions(spark, n, batch).coalesce(1), batch)
        expected.update({key: key * 1000 + batch for key in range(0, 10, n)})
        folders = files.names(f"{path}/log") + files.names(f"{path}/snapshot")
        most = max(most, len(folders))
    assert most <= 9
    assert rows(streams.read_current(spark, path, ["key"]), "key", "value") == set(expected.items())
    # A batch that is replayed after a restart changes nothing.
    caught[0](versions(spark, 2, 49).coalesce(1), 49)
    assert rows(streams.read_current(spark, path, ["key"]), "key", "value") == set(expected.items())


def test_a_crash_between_fold_and_clean_up_is_harmless(spark, out, monkeypatch):
    path, keys = f"{out}/table", ["key"]
    for batch in range(3):
        versions(spark, 1 + batch, batch).write.parquet(f"{path}/log/batch_id={batch}")
    before = rows(streams.read_current(spark, path, keys), "key", "value")

    def crash(self, path):
        raise OSError("lost")

    monkeypatch.setattr(Files, "remove", crash)
    with pytest.raises(OSError):
        streams.fold_current(spark, path, keys, 3)
    monkeypatch.undo()
    files = Files(spark, path)
    assert len(files.names(f"{path}/log")) == 3 and files.names(f"{path}/snapshot") == ["upto=2"]
    assert rows(streams.read_current(spark, path, keys), "key", "value") == before
    # A snapshot that was not finished is not taken.
    versions(spark, 1, 99).write.parquet(f"{path}/snapshot/upto=7")
    files.remove(f"{path}/snapshot/upto=7/_SUCCESS")
    assert rows(streams.read_current(spark, path, keys), "key", "value") == before
    streams.fold_current(spark, path, keys, 3)
    assert files.names(f"{path}/log") == []
    assert rows(streams.read_current(spark, path, keys), "key", "value") == before


def test_what_a_batch_reads_does_not_grow_with_the_ledger(spark, out, monkeypatch):
    """Ten days, one file each, then a late record, a record sent again, and an id of another day."""
    def day(n, ids):
        return spark.createDataFrame([(f"r{i}",) for i in ids], "id string").selectExpr(
            "id", "'n' AS node_id", "'dev' AS environment_id", "'UP' AS direction", "'SUCCESS' AS status",
            f"timestamp '2024-01-01' + interval {n} days AS executed_at", "'d' AS description",
            "CAST(NULL AS string) AS serialized_down_task", "1L AS duration_ms", "CAST(NULL AS string) AS error_message",
        ).coalesce(1)

    for n in range(10):
        day(n, range(10 * n, 10 * n + 10)).write.mode("append").parquet(f"{out}/in")
    day(2, [999, 25]).write.mode("append").parquet(f"{out}/in")
    read, look_up = [], streams.days_of_ledger

    def spied(spark, path, days, schema):
        found = look_up(spark, path, days, schema)
        read.append(len(found.inputFiles()) if found is not None else 0)
        return found

    monkeypatch.setattr(streams, "days_of_ledger", spied)
    stream = spark.readStream.schema(day(0, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    streams.drain(streams.history_append_stream(stream, f"{out}/ledger"), f"{out}/c1")
    assert len(read) == 11 and max(read) == 1
    ids = values(spark.read.parquet(f"{out}/ledger"), "id")
    assert ids == sorted([f"r{i}" for i in range(100)] + ["r999"])
    streams.drain(streams.history_append_stream(stream, f"{out}/ledger"), f"{out}/c2")
    assert values(spark.read.parquet(f"{out}/ledger"), "id") == ids and max(read[11:]) <= 2
