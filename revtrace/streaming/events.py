"""Agent events as a stream of envelopes, resumable reads, and runs that have stopped."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import let, strip

# ---- Fixed values: agents, and the summaries shown for them ---------------------------------------------------------
AGENTS = ["claim_extractor", "drift_analyzer", "citation_finder", "notifier", "memory_synthesizer"]
INPUT_SUMMARIES = {
    "claim_extractor": "Extracting claims from preprint and published versions.",
    "drift_analyzer": "Comparing claim sets and retrieving memory patterns.",
    "citation_finder": "Finding citing papers via OpenAlex.",
    "notifier": "Drafting notification email for affected citation.",
    "memory_synthesizer": "Distilling drift event into reusable pattern.",
}
SEARCH_TOOL = "search_drift_patterns"
STREAMS = 1 << 12  # groups that the keys of tail_stream share
# -------------------------------------------------------------------------------------------------------------------
PART_TYPE = ("array<struct<call_name:string,call_args:string,response_name:string,response_text:string,text:string>>")


def _known(events: DataFrame) -> DataFrame:
    return events.filter(F.col("author").isin(*AGENTS))


def _iso(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(ts)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _envelope(kind: Column, order: Column, payload: Column) -> list[Column]:
    return [F.col("event_no"), order.alias("part_no"), kind.alias("event_type"), F.col("author").alias("agent_id"),
            F.col("invocation_id"), _iso(F.col("timestamp")).alias("timestamp"), payload.alias("payload")]


def started(events: DataFrame, late: str = "1 day") -> DataFrame:
    """One started envelope per agent and invocation: the first event seen. On a stream this is keyed state that Spark keeps until
    the watermark is `late` past an invocation's first event; in a batch the lowest event number counts."""
    e = _known(events)
    if e.isStreaming:
        timed = e.withColumn("seen_at", F.timestamp_seconds("timestamp")).withWatermark("seen_at", late)
        first = timed.dropDuplicatesWithinWatermark(["author", "invocation_id"]).drop("seen_at")
    else:
        rest = [c for c in e.columns if c not in ("author", "invocation_id")]
        first = e.groupBy("author", "invocation_id").agg(F.min_by(F.struct(*rest), F.col("event_no")).alias("f")).select("author", "invocation_id", "f.*")
    table = F.create_map(*[F.lit(x) for pair in INPUT_SUMMARIES.items() for x in pair])
    payload = F.to_json(F.struct(F.element_at(table, F.col("author")).alias("input_summary")))
    return first.select(*_envelope(F.lit("agent.started"), F.lit(-1), payload))


def _json_text(c: Column) -> Column:
    """JSON object text of a reply, without a code fence; null when it is not an object."""
    t = strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[^\n]*\n?", ""), r"```\s*$", ""))
    return let(t, lambda x: F.when(x.startswith("{") & F.try_parse_json(x).isNotNull(), x))


def _output(agent: Column, doc: Column) -> Column:
    """Summary and output id of an agent's final JSON."""
    size = lambda p: F.coalesce(F.json_array_length(F.get_json_object(doc, p)), F.lit(0)).cast("string")
    get = lambda p: F.get_json_object(doc, p)
    summary = (
        F.when(agent == "claim_extractor", F.concat(size("$.claims"), F.lit(" claims extracted.")))
        .when(agent == "drift_analyzer", F.concat(F.lit("Drift analyzed: "), size("$.claim_diffs"), F.lit(" claim diffs.")))
        .when(agent == "citation_finder", F.concat(F.coalesce(get("$.total_found"), size("$.affected_citations")), F.lit(" affected citations scored.")))
        .when(agent == "notifier", F.lit("Notification drafted."))
        .otherwise(F.concat(F.lit("Memory pattern "), F.coalesce(get("$.action"), F.lit("synthesized")), F.lit("."))))
    out_id = (
        F.when(agent == "claim_extractor", get("$.preprint_doi")).when(agent == "drift_analyzer", get("$.event_id"))
        .when(agent == "citation_finder", get("$.drift_event_id")).when(agent == "notifier", get("$.affected_citation_id"))
        .otherwise(get("$.pattern.pattern_id")))
    return F.struct(summary.alias("output_summary"), out_id.alias("output_id"))


def _pattern_hits(text: Column) -> Column:
    """Ids and scores of a pattern search reply: the first block of query results, columns found by name."""
    block = ("results array<struct<type:string,data:struct<columns:array<struct<name:string>>,values:array<array<string>>>>>")
    parsed = F.from_json(_json_text(text), block)
    first = F.get(F.filter(parsed["results"], lambda b: b["type"] == "esql_results"), F.lit(0))["data"]

    def at(d: Column, name: str) -> Column:
        return F.array_position(F.transform(d["columns"], lambda c: c["name"]), F.lit(name)).cast("int")

    def read(d: Column) -> Column:
        rows = F.filter(d["values"], lambda v: F.get(v, at(d, "pattern_id") - 1).isNotNull())
        return F.struct(F.transform(rows, lambda v: F.get(v, at(d, "pattern_id") - 1)).alias("pattern_ids"),
                        F.array_compact(F.transform(rows, lambda v: F.get(v, at(d, "_score") - 1).try_cast("double"))).alias("scores"))

    return let(first, lambda d: F.when(at(d, "pattern_id") > 0, read(d)))


def details(events: DataFrame) -> DataFrame:
    """Everything but the started envelopes: an error gives failed and ends the event; calls, pattern search results and
    final JSON texts give one envelope each; other parts give none. Stateless, so it is the same on a stream."""
    e = _known(events)
    failed = F.coalesce("error_code", "error_message").isNotNull()
    bad = e.filter(failed).select(*_envelope(F.lit("agent.failed"), F.lit(0), F.to_json(F.struct(
        F.coalesce("error_message", "error_code").alias("error_message"), F.lit(0).alias("retry_count")))))
    p = e.filter(~failed).select("event_no", "author", "invocation_id", "timestamp", F.posexplode("parts").alias("part_no", "p"))
    hits, doc = _pattern_hits(F.col("p.response_text")), _json_text(F.col("p.text"))
    p = p.withColumn("hits", F.when(F.col("p.response_name") == SEARCH_TOOL, hits)).withColumn("doc", doc)
    is_call, is_reply = F.col("p.call_name").isNotNull(), F.col("p.response_name").isNotNull()
    kind = (F.when(is_call, "agent.tool_call").when(is_reply, F.when(F.size("hits.pattern_ids") > 0, "agent.pattern_retrieved"))
            .when(F.col("doc").isNotNull(), "agent.completed"))
    call = F.to_json(F.struct(F.col("p.call_name").alias("tool_name"), F.coalesce("p.call_args", F.lit("{}")).alias("args")))
    payload = F.when(is_call, call).when(is_reply, F.to_json("hits")).otherwise(F.to_json(_output(F.col("author"), F.col("doc"))))
    good = p.withColumn("kind", kind).filter("kind IS NOT NULL").select(*_envelope(F.col("kind"), F.col("part_no"), payload))
    return bad.unionByName(good)


def translate_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """events(event_no, author, invocation_id, timestamp in seconds, error_code, error_message, parts) -> envelopes."""
    return started(events, late).unionByName(details(events))


def tail(events: DataFrame, key: Column, after_seq: int, n: int = 200) -> DataFrame:
    """The next envelopes of one stream after a resume point, in order."""
    return events.filter(key & (F.col("event_seq") > after_seq)).orderBy("event_seq").limit(n)


def tail_stream(events: DataFrame, key: str, resume: DataFrame | None = None) -> DataFrame:
    """The tail of every stream of envelopes as a streaming query: of each key the envelopes past its resume point, in order, each once.

    resume(key, after_seq): where a subscriber goes on; without a row it starts at the beginning. The cursor of a key is state that Spark
    keeps in the query's checkpoint, one number, so a restart goes on where it stopped, and an envelope that lands twice is passed once.
    An envelope that lands behind the cursor is left out, as in the batch read. event_seq must not be null.

    Keys share STREAMS groups by hash, because a call for each key and batch costs more than its rows; a group's state holds the cursors of
    its keys (null keys have a group of their own)."""
    start = F.lit(-(1 << 62)).cast("long")
    if resume is not None:
        events = events.join(resume.select(key, "after_seq"), key, "left").withColumn("after_seq", F.coalesce("after_seq", start))
    else:
        events = events.withColumn("after_seq", start)
    out = events.drop("after_seq").schema
    events = events.withColumn("_name", F.coalesce(F.col(key).cast("string"), F.lit(""))).withColumn(
        "_group", F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(STREAMS))).cast("int"))

    def advance(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["_name", "event_seq"], kind="stable").drop_duplicates(["_name", "event_seq"])
        cursors = dict(zip(*state.get)) if state.exists else {}
        after = rows.drop_duplicates("_name")
        cursors = {**dict(zip(after["_name"].tolist(), after["after_seq"].tolist())), **cursors}
        fresh = rows[rows["event_seq"] > rows["_name"].map(cursors)]
        last = fresh.drop_duplicates("_name", keep="last")
        cursors.update(zip(last["_name"].tolist(), last["event_seq"].tolist()))
        state.update((list(cursors), [int(c) for c in cursors.values()]))
        yield fresh[out.names]

    return events.groupBy("_group").applyInPandasWithState(advance, out, "names array<string>, cursors array<long>", "append", GroupStateTimeout.NoTimeout)


def stale_runs_stream(steps: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """steps(run_id, step_at, phase): a run with no step for the given time can be claimed again. A session window per run
    closes exactly then, so Spark keeps the timers; finished runs are left out."""
    closed = (steps.withWatermark("step_at", late).groupBy("run_id", F.session_window("step_at", f"{minutes} minutes"))
              .agg(F.max("step_at").alias("last_step"), F.max_by("phase", "step_at").alias("phase")))
    return closed.filter("phase <> 'done'").select("run_id", "last_step", F.col("session_window.end").alias("stale_at"), "phase")
