import json

from pyspark.sql import functions as F

from revtrace.sources import scans
from revtrace.streaming import dispatch, events, ingest


def page(*rows):
    return json.dumps({"collection": [dict(zip(("doi", "version", "published", "title", "authors"), r)) for r in rows]}, indent=1)


def test_feed_scan(spark, tmp_path):
    (tmp_path / "a.json").write_text(page(("https://doi.org/10.1101/A", "1", "NA", "first", "x"), ("", "1", "", "", ""), ("10.1101/a", "1", "10.1/Q", "second", "x")))
    (tmp_path / "b.json").write_text(page(("10.1101/A", "1", "", "third", "x"), ("10.1101/b", "2", "10.1/B", "t", "x")))
    rows, counts = scans.read_version_feed(spark, str(tmp_path), "medrxiv")
    assert sorted((r.doi, r.version, r.published_doi, r.title) for r in rows.collect()) == [("10.1101/a", "1", None, "first"), ("10.1101/b", "2", "10.1/b", "t")]
    assert tuple(counts.first()) == (2, 3)


def test_ingest_in_two_runs(spark, tmp_path):
    src, log, ck = tmp_path / "src", str(tmp_path / "log"), str(tmp_path / "ck")
    src.mkdir()
    (src / "a.json").write_text(page(("10.1101/A", "1", "", "old", "Li Q; Wu")))
    ingest.ingest_stream(spark, str(src), "biorxiv", log, ck).awaitTermination()
    (src / "b.json").write_text(page(("10.1101/A", "1", "10.1/P", "<b>new</b>", "Li Q"), ("10.1101/B", "1", "", "t", "x")))
    ingest.ingest_stream(spark, str(src), "biorxiv", log, ck).awaitTermination()
    r = {x.doi: (x.title, x.is_final_preprint, x.version) for x in ingest.latest(spark, log).collect()}
    assert r == {"10.1101/a": ("new", True, "v1"), "10.1101/b": ("t", False, "v1")}


def test_upsert_by_bucket(spark, tmp_path):
    """Later places win within a batch, untouched buckets stay where they are, a repeated batch changes nothing."""
    sink = str(tmp_path / "table")
    row = lambda doi, title, file, place: (doi, "v1", title, file, place)
    frame = lambda rows: spark.createDataFrame(rows, "doi string, version string, title string, file_path string, record_no int").withColumn("file_time", F.lit(0).cast("timestamp"))
    first = frame([row(f"d{i}", "old", "a", i) for i in range(50)])
    second = frame([row("d7", "late", "b", 2), row("d7", "early", "b", 1), row("d7", "other file", "a", 9), row("new", "x", "b", 3)])
    read = lambda: sorted((r.doi, r.title) for r in ingest.latest(spark, sink).collect())
    ingest.upsert_batch(first, sink, 0, 8)
    assert len(read()) == 50
    for _ in range(2):
        ingest.upsert_batch(second, sink, 1, 8)
        assert read() == sorted([(f"d{i}", "late" if i == 7 else "old") for i in range(50)] + [("new", "x")])
    ingest.upsert_batch(first.limit(0), sink, 2, 8)
    assert len(read()) == 51 and len({n for n in ingest._manifest(spark, sink, 2).values()}) == 2


def test_ingest_writes_rows_a_few_times(spark, tmp_path, monkeypatch):
    """Batches that touch every bucket write their own rows, not the whole table again; parts become one, and the last rows stay."""
    monkeypatch.setattr(ingest, "PARTS", 2)
    sink, want = str(tmp_path / "table"), {}
    schema = "doi string, version string, title string, file_path string, record_no int"
    for n in range(7):
        rows = [(f"d{i}", None if i % 3 else "v1", f"t{n}", "a", i) for i in range(n * 10, n * 10 + 40)]
        want |= {r[0]: (r[0], r[1], r[2]) for r in rows}
        batch = spark.createDataFrame(rows, schema).withColumn("file_time", F.lit(0).cast("timestamp"))
        for _ in range(1 + (n == 5)):
            ingest.upsert_batch(batch, sink, n, 2)
        got = [(r.doi, r.version, r.title) for r in ingest.latest(spark, sink).collect()]
        assert sorted(got, key=str) == sorted(want.values(), key=str)
        assert spark.read.parquet(f"{sink}/data/batch={n}").count() == 40
    assert {len(parts) for parts in ingest._manifest(spark, sink, 6).values()} == {3}
    assert spark.read.parquet(f"{sink}/merged/batch=3").count() == 70  # levels meet: batches 0 to 3


def test_tail_goes_on_after_a_restart(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    rows = [(k, n, "agent.completed" if n == 9 else "agent.tool_call", "memory_synthesizer") for k in ("a", "b") for n in range(10)]
    schema = "drift_event_id string, event_seq long, event_type string, agent_id string"
    resume = spark.createDataFrame([("b", 4)], "drift_event_id string, after_seq long")

    def run():
        s = events.tail_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "drift_event_id", resume)
        s.writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.drift_event_id, r.event_seq) for r in spark.read.schema(schema).parquet(out).collect())

    land = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    land([r for r in rows if r[1] < 4])
    assert run() == [("a", n) for n in range(4)]
    land([r for r in rows if 2 <= r[1] < 8])  # two of them a second time
    assert run() == [("a", n) for n in range(8)] + [("b", n) for n in range(5, 8)]
    land(rows)
    batch = sorted((k, r.event_seq) for k, after in (("a", -1), ("b", 4)) for r in events.tail(spark.createDataFrame(rows, schema), F.col("drift_event_id") == k, after).collect())
    assert run() == batch


def test_dispatch_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"10.1101/{i % 7}", f"10.1/{i % 7}", i == 9) for i in range(20)]
    req = spark.createDataFrame(rows, "request_no bigint, preprint_doi string, published_doi string, force boolean")
    ev = spark.createDataFrame([("10.1101/2", "10.1/2")], "preprint_doi string, published_doi string")
    st = spark.createDataFrame([("10.1101/3", "v1_unavailable")], "preprint_doi string, status string")
    none = spark.createDataFrame([], "pair_key string")
    want = {r.request_no: r.outcome for r in dispatch.dispatch_batch(req, ev, st, none, 4).collect()}
    assert want[2] == "already_processed" and want[3] == "not_analysable" and want[0] == "enqueued" and want[19] == "paused_budget_exhausted"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for i in range(4):  # files in order of time, one per micro-batch
        req.filter((F.col("request_no") >= 5 * i) & (F.col("request_no") < 5 * i + 5)).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 1).parquet(src)
    dispatch.dispatch_stream(s, ev, st, out, str(tmp_path / "ck"), 4).awaitTermination()
    got = {r.request_no: r.outcome for r in spark.read.option("basePath", out).parquet(out).collect()}
    assert got == want


def agent_rows(spark):
    part = lambda **k: {x: k.get(x) for x in ("call_name", "call_args", "response_name", "response_text", "text")}
    rows = [(1, "claim_extractor", "i1", 1.5e9, None, [part(call_name="f", call_args="{}")]), (2, "claim_extractor", "i2", 1.5e9, None, [part(text="hm")]),
            (3, "claim_extractor", "i1", 1.5e9, None, [part(text='```json\n{"claims": [1]}\n```'), part(text="[1]")]), (4, "supervisor", "i1", 1.5e9, None, []), (5, "notifier", "i1", 1.5e9, "E", [part(text="{}")])]
    return spark.createDataFrame(rows, f"event_no bigint, author string, invocation_id string, timestamp double, error_code string, parts {events.PART_TYPE}").withColumn("error_message", F.lit(None).cast("string"))


def test_event_translation_stream_equals_batch(spark, tmp_path):
    d = agent_rows(spark)
    batch = sorted((r.event_no, r.event_type, r.payload) for r in events.translate_events(d).collect())
    assert [b[:2] for b in batch] == [(1, "agent.started"), (1, "agent.tool_call"), (2, "agent.started"), (3, "agent.completed"), (5, "agent.failed"), (5, "agent.started")]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for n in range(1, 6):
        d.filter(F.col("event_no") == n).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(src)
    t = events.translate_events(s)
    t.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted((r.event_no, r.event_type, r.payload) for r in spark.read.parquet(out).collect()) == batch


def test_tail_of_many_streams_in_one_group(spark, tmp_path, monkeypatch):
    """Streams that share a group keep cursors of their own, null keys included; large numbers stay whole beside streams without a resume point."""
    monkeypatch.setattr(events, "STREAMS", 1)
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema, top = "user long, event_seq long", (1 << 60) + 1
    resume = spark.createDataFrame([(k, top + k) for k in range(0, 20, 2)], "user long, after_seq long")
    rows = [(k, top + n) for k in [*range(20), None] for n in range(30)]
    for part in ([r for r in rows if r[1] < top + 12], [r for r in rows if 8 <= r[1] - top < 20], rows):
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(src)
        s = events.tail_stream(spark.readStream.schema(schema).parquet(src), "user", resume)
        assert "_group" not in s.columns
        s.writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out).awaitTermination()
    got = sorted(((r.user if r.user is not None else -1), r.event_seq) for r in spark.read.schema(schema).parquet(out).collect())
    assert got == sorted(((-1 if k is None else k), n) for k, n in rows if k is None or k % 2 or n > top + k)
