"""The event catalogue as table and stream, and the stored symbol index."""

import datetime as dt
import json
import random
import uuid

from pyspark.sql import functions as F

from quern.operators.index import locations, places, write_index
from quern.streaming.catalogue import KINDS, metrics, progress, progress_stream, typed

UTC = dt.timezone.utc


def log(n=300):
    """(kind, ts, payload) of ten kinds and an unknown one; times rise."""
    rng, rows, at = random.Random(4), [], dt.datetime(2024, 1, 1, tzinfo=UTC)
    for i in range(n):
        at += dt.timedelta(minutes=rng.randrange(1, 90))
        kind = rng.choice([*KINDS, "Other"])
        subject, amount = KINDS.get(kind, ("x", "y"))
        payload = {subject: f"s{rng.randrange(3) + i // 60 * 3}"} | ({amount: rng.randrange(9)} if amount and i % 17 else {})
        rows.append((kind, at, json.dumps({} if i % 41 == 7 else payload)))
    return rows


def events(frame):
    return frame.select("kind", "ts", F.parse_json("payload").alias("payload"))


def test_faults_are_rows(spark):
    rows = [("LibraryImported", {"library_id": "a", "artifact_count": 3}), ("LibraryImported", {"library_id": "a"}), ("LibraryImported", {"library_id": "a", "artifact_count": "many"}), ("FlowBuilt", {"block_count": 1}), ("RoundTripValidated", {"original_id": "a", "result": {"Success": {"differences": []}}}), ("?", {}), (None, None)]
    table = spark.createDataFrame([(i, k, dt.datetime(2024, 1, 1), None if p is None else json.dumps(p)) for i, (k, p) in enumerate(rows)], "i int, kind string, ts timestamp, payload string")
    got = [tuple(r) for r in typed(events(table)).select("subject", "amount", "fault").collect()]
    assert sorted(got, key=str) == sorted([("a", 3, None), ("a", None, "no amount"), ("a", None, "no amount"), (None, 1, "no subject"), ("a", None, None), (None, None, "unknown kind"), (None, None, "unknown kind")], key=str)
    assert tuple(metrics(typed(events(table))).first()) == (1, 0, 0, 5)
    assert tuple(metrics(typed(events(table.limit(0)))).first()) == (0, 0, 0, 0) and progress(typed(events(table.limit(0)))).collect() == []


def test_stream_and_table_give_the_same_catalogue(spark, tmp_path):
    rows = log()
    schema = "kind string, ts timestamp, payload string"
    for i in range(0, len(rows), 60):
        spark.createDataFrame(rows[i : i + 60], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = progress_stream(typed(events(source)), 86_400).writeStream.format("memory").queryName("progress").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(provider)
    last = {}
    for r in spark.table("progress").collect():
        if r.subject not in last or (r.events, r.closed) >= (last[r.subject].events, last[r.subject].closed):
            last[r.subject] = r
    want = {r.subject: r for r in progress(typed(events(spark.createDataFrame(rows, schema)))).collect()}
    assert len(want) == 15 and {k: tuple(v) for k, v in last.items()} == {k: tuple(v) for k, v in want.items()}
    assert 0 < sum(r.closed for r in want.values()) < 15


def test_index_is_not_shuffled(spark):
    rng = random.Random(1)
    rows = [(None if i % 50 == 0 else f"n{rng.randrange(40)}" if i % 3 else "hot", f"f{rng.randrange(5)}", i % 7, i) for i in range(900)]
    table = f"symbols_{uuid.uuid4().hex}"
    write_index(spark.createDataFrame(rows, "name string, file string, line int, column int").repartition(5), table, 8)
    asked = spark.createDataFrame([("hot", 1), ("n1", 2), ("n1", 3), ("none", 4), (None, 5)], "name string, k int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = places(spark, table, asked)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        got = sorted(((r.k, r.file, r.line, r.column) for r in joined.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # The names are shuffled to the index's buckets, the index is only read.
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") < plan.index("Bucketed: true")
    want = [(k, f, x, c) for name, k in asked.collect() for n, f, x, c in rows if n == name and n is not None] + [(4, None, None, None), (5, None, None, None)]
    assert got == sorted(want, key=str)
    found = {r.name: [tuple(x) for x in r.locations] for r in locations(spark, table, asked).collect()}
    assert found == {n: sorted((f, x, c) for m, f, x, c in rows if m == n and n is not None) for n in ("hot", "n1", "none", None)}
    spark.sql(f"DROP TABLE {table}")
