"""Progress events and chunked messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages in order and their shares of the whole, in percent.
STAGES = [("decode", 6), ("kmeans", 24), ("colorMap", 2), ("facetBuild", 16), ("narrowCleanup", 6), ("facetReduce", 14), ("borderTrace", 12), ("borderSegment", 10), ("labelPlacement", 5), ("svgRender", 5)]


def overall(stage: Column, local: Column) -> Column:
    """Percentage of the whole, a half up, from a stage and the share of it that is done. Percents are whole numbers, so that a half is one."""
    out, before = None, 0
    for name, weight in STAGES:
        done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), local)) * weight + before
        out = F.when(stage == name, done) if out is None else out.when(stage == name, done)
        before += weight
    return F.floor(out + 0.5).cast("int")


STEP, GAP_MS = 0.03, 150


def _passes(local: float, ts: int, last: float, at: int) -> bool:
    """Whether an event goes on: the first, a finished one, and one far enough in progress or time from the last that went on."""
    return last < 0 or local >= 1 or local - last >= STEP or ts - at >= GAP_MS


def throttle(events: DataFrame, key: str = "request_id") -> DataFrame:
    """key, seq of the events (key, seq, ts_ms, local) that are passed on. Progress counts from 0 to 1, beyond that as the nearer end.

    Each depends on the last one passed on before, so a key's events are read in order; what is held is that one event.
    """
    rows = events.select(key, "seq", "ts_ms", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("local").cast("double"))).alias("local"))

    def run(parts):
        now, last, at = object(), -1.0, 0
        for pdf in parts:
            keep = []
            for k, ts, local in zip(pdf[key].tolist(), pdf.ts_ms.tolist(), pdf.local.tolist()):
                if k != now:
                    now, last, at = k, -1.0, 0
                go = _passes(local, ts, last, at)
                if go:
                    last, at = local, ts
                keep.append(go)
            yield pdf.loc[keep, [key, "seq"]]

    return rows.repartition(key).sortWithinPartitions(key, "seq").mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, seq {dict(rows.dtypes)['seq']}")


def stream_throttle(events: DataFrame, key: str = "request_id") -> DataFrame:
    """The same over a streaming frame: of each key the state is the last event passed on. Events of one batch come in the order of seq."""
    kinds = dict(events.dtypes)

    def run(_, parts, state):
        import pandas as pd

        last, at = state.get if state.exists else (-1.0, 0)
        rows = pd.concat(list(parts)).sort_values("seq")
        keep = []
        for ts, local in zip(rows.ts_ms.tolist(), rows.local.clip(0, 1).tolist()):
            go = _passes(local, ts, last, at)
            if go:
                last, at = local, ts
            keep.append(go)
        state.update((last, at))
        yield rows.loc[keep, [key, "seq"]]

    rows = events.select(key, "seq", F.col("ts_ms").cast("long").alias("ts_ms"), F.col("local").cast("double").alias("local"))
    return rows.groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, seq {kinds['seq']}", "last double, at long", "append", "NoTimeout")


def assemble(parts: DataFrame, key: str = "request_id", starts: DataFrame | None = None) -> DataFrame:
    """key, complete, text from (key, seq, chunk_index, total_chunks, chunk), and error if starts (key) are given.

    Whole only if every chunk has come, in whatever order; of repeated ones the last by seq counts. Chunks of a request that never started are
    an unknown request.
    """
    one = parts.groupBy(key, "chunk_index").agg(F.max_by("chunk", "seq").alias("chunk"), F.max("total_chunks").alias("total_chunks"))
    rows = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk"))).alias("cs"), F.max("total_chunks").alias("total"), F.count(F.lit(1)).alias("n"))
    whole = F.col("n") == F.col("total")
    out = rows.select(key, whole.alias("complete"), F.when(whole, F.array_join(F.transform("cs", lambda c: c.chunk), "")).alias("text"))
    if starts is None:
        return out
    known = starts.select(key).distinct().withColumn("_started", F.lit(True))
    both = out.join(known, key, "full")
    error = F.when(F.col("_started").isNull(), "unknown request").when(~F.coalesce("complete", F.lit(False)), "missing chunk")
    return both.select(key, (F.coalesce("complete", F.lit(False)) & error.isNull()).alias("complete"), F.when(error.isNull(), F.col("text")).alias("text"), error.alias("error"))


_RECEIVED = "status string, seq long, text string, error string"


def _received(pending: dict, active: str | None, m: dict) -> tuple[str | None, str | None, str | None]:
    """(active request, text, error) after a message; pending (request: slots) changes with it."""
    request, kind = m["request_id"], m["kind"]
    if kind == "done":
        return (None if active == request else active), None, None
    if kind == "start":
        if m["total_chunks"] is None or m["total_chunks"] < 1:
            return active, None, "a start without a number of chunks"
        pending[request] = [None] * int(m["total_chunks"])
    elif request not in pending:
        return active, None, f"{kind} chunk of an unknown request"
    slots, at = pending[request], m["chunk_index"]
    if at is None or not 0 <= at < len(slots):
        return active, None, "a chunk out of its request's range"
    slots[int(at)] = m["chunk"]
    if kind != "finish":
        return active, None, None
    if active is not None and active != request:
        return active, None, f"request {active} is still at work"
    if any(c is None for c in slots):
        return active, None, "one or more chunks are missing"
    return request, "".join(pending.pop(request)), None


def stream_assemble(messages: DataFrame, timeout_ms: int = 60_000, lateness: str = "0 seconds") -> DataFrame:
    """runner, request_id, status, seq, text, error over a streaming frame of messages (runner, request_id, seq, ts, kind, chunk_index, total_chunks, chunk).

    kind is start, chunk, finish or done; start and finish carry a chunk, too. Of each runner the state holds the chunks of the requests that have started, by their
    place, and the request at work. A finish with all chunks there gives the text (complete) and sets its runner to work until done. Anything else wrong is a row with
    status error: chunks of an unknown request, or out of range, missing ones at the finish, a finish while another request is at work; the request may
    go on and finish again. What has no further message of its runner for timeout_ms of event time is dropped, a row with status timeout each. Messages of one batch come in the order of seq.
    """
    import json

    def run(key, parts, state):
        import pandas as pd

        pending, active = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, None)
        out = []
        if state.hasTimedOut:
            out = [(key[0], r, "timeout", None, None, None) for r in sorted(pending)]
            state.remove()
        else:
            rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
            rows = rows.astype(object).where(rows.notna(), None)
            for m in rows.to_dict("records"):
                active, text, error = _received(pending, active, m)
                if text is not None or error is not None:
                    out.append((key[0], m["request_id"], "error" if error else "complete", m["seq"], text, error))
            state.update((json.dumps(pending), active))
            last = int(rows["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + timeout_ms)
        yield pd.DataFrame(out, columns=["runner", "request_id", "status", "seq", "text", "error"]).astype({"seq": "Int64"})

    rows = messages.select("runner", "request_id", F.col("seq").cast("long").alias("seq"), "ts", "kind", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"), "chunk").withWatermark("ts", lateness)
    kind = dict(rows.dtypes)
    return rows.groupBy("runner").applyInPandasWithState(run, f"runner {kind['runner']}, request_id {kind['request_id']}, {_RECEIVED}", "pending string, active string", "append", "EventTimeTimeout")


def ready_ideas(ideas: DataFrame, least: int = 8) -> DataFrame:
    """Ideas whose text has at least so many characters without the white space around it."""
    return ideas.where(F.char_length(F.trim("text")) >= least)


def route(messages: DataFrame, kinds: list[str], request_id: str | None = None) -> DataFrame:
    """type and requestId of JSON messages of these kinds, of one request if given."""
    m = messages.select("message", F.from_json("message", "type string, requestId string").alias("m")).select("message", "m.type", "m.requestId").where(F.col("type").isin(kinds))
    return m if request_id is None else m.where(F.col("requestId") == request_id)


def recent(items: DataFrame, keep: int = 6) -> DataFrame:
    """The newest items (created_at, id), newest first."""
    return items.orderBy(F.desc("created_at"), F.desc("id")).limit(keep)


def timings(events: DataFrame) -> DataFrame:
    return events.groupBy("stage").agg(F.sum("ms").alias("ms"))


def timings_map(events: DataFrame, *keys: str) -> DataFrame:
    """keys and ms, a map of the stages' times, of each run."""
    one = events.groupBy(*keys, "stage").agg(F.sum("ms").alias("ms"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "ms")))).alias("ms"))


def stream_overall(events: DataFrame) -> DataFrame:
    """A streaming frame of events (request_id, stage, local) with overall progress; no state is kept."""
    return events.withColumn("progress", overall(F.col("stage"), F.col("local")))
