"""Structured Streaming twins give what the batch forms give."""

from pyspark.sql import functions as F

from docloom.streaming import events as EV

SF = "/root/testdata/sf0.001"


def stream(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.orderBy("ts", "event_id").coalesce(1).write.parquet(f"{tmp_path}/in")
    return batch, spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")


def test_numbers_run_on_in_every_key(spark, tmp_path):
    batch, source = stream(spark, tmp_path)
    EV.stream_sequence(source, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.exceptAll(EV.sequence(batch).select("user_id", "event_id", "seq")).isEmpty()
    assert got.count() == batch.count()


def test_finished_windows_match_batch(spark, tmp_path):
    batch, source = stream(spark, tmp_path)
    EV.stream_tumbling_counts(source, f"{tmp_path}/out", f"{tmp_path}/ck", 86_400).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.exceptAll(EV.tumbling_counts(batch, 86_400)).isEmpty() and got.count() > 0


def test_circuits_run_on_in_every_service(spark, tmp_path):
    calls = lambda events: events.select("user_id", "event_id", EV.micros("ts").alias("at"), (F.col("event_type") != "error").alias("ok"))
    batch, source = stream(spark, tmp_path)
    rule = EV.Breaker(failures=1, successes=1, open_for=86_400, window=86_400)
    EV.stream_circuit_states(calls(source), f"{tmp_path}/out", f"{tmp_path}/ck", "user_id", rule).awaitTermination()
    got, want = spark.read.parquet(f"{tmp_path}/out"), EV.circuit_states(calls(batch), "user_id", rule)
    assert got.exceptAll(want).isEmpty() and got.count() == batch.count()
    assert {r["state"] for r in got.select("state").distinct().collect()} >= {"open", "closed"}


def test_circuit_by_hand():
    second = 1_000_000
    calls = [(0, False), (61, False), (62, False), (63, False), (92, True), (93, False), (122, True), (123, True), (124, True), (125, True)]
    circuit, seen = EV.Circuit(), []
    for at, ok in calls:
        circuit, let = EV.call(circuit, at * second, ok, EV.Breaker(failures=3, successes=2))
        seen.append((circuit.state, let))
    assert seen == [
        ("closed", True), ("closed", True), ("closed", True), ("open", True), ("open", False), ("open", True), ("open", False), ("half_open", True), ("closed", True), ("closed", True),
    ]
