"""Streaming forms of the batch operators.

State is kept per key and bounded: a few numbers per series, an open request,
or an alert's clock.  Every key has an event-time timer: once the watermark has passed
the time after which its state can no longer change a result (or, for a counter, ``idle``), the state goes, so
what a stream keeps follows the keys that are alive.  Rows older than the watermark (``late``) are
dropped, a micro-batch is sorted inside the key before it is folded in, and rows older than
the state are skipped.  The caller chooses sources, sinks, triggers and checkpoint folders.
"""

import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import requests as R
from ..operators import traces as E
from ..operators.alerts import GROUP_INTERVAL, GROUP_WAIT, REPEAT_INTERVAL
from ..operators.logs import TokenBucket, classify_lines, clean_lines

#: Lines of a source that :func:`rate_limited` takes through its bucket at once, and bytes of them that wait in memory.
AT_ONCE, HELD_BYTES = 1 << 16, 1 << 22
#: States that the series of :func:`counter_increments` are dealt over; a checkpoint depends on it.
SHARDS = 1024


def windowed_counts(df: DataFrame, ts: str, by: list[str], size: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Tumbling counts by labels; rows later than ``late`` are dropped."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, size), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), *by, "n")


def line_counts(lines: DataFrame, size: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Classified lines per window, severity and category."""
    return windowed_counts(classify_lines(clean_lines(lines)), "ts", ["severity", "category"], size, late)


def sliding_sums(inc: DataFrame, by: list[str], window: str = "5 minutes", step: str = "15 seconds", late: str = "2 minutes") -> DataFrame:
    """Increase over a sliding window evaluated every step."""
    return inc.withWatermark("ts", late).groupBy(F.window("ts", window, step), *by).agg(F.sum("inc").alias("value")).select(
        F.col("window.end").alias("t"), *by, "value")


def _ordered(pdfs: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = [p for p in pdfs if len(p)]
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame()


def _seconds(col: pd.Series) -> pd.Series:
    return col.astype("datetime64[us]").astype("int64") / 1e6


def _until(state: GroupState, seconds: float) -> None:
    """Let the key's state end once the watermark passes a time."""
    state.setTimeoutTimestamp(max(math.ceil(seconds * 1000), state.getCurrentWatermarkMs() + 1))


def rate_limited(lines: DataFrame, rate: float, late: str = "10 minutes") -> DataFrame:
    """Token bucket per source with the bucket as state: ``(source, seq, ts, line, accepted)``.

    A source that rests until its bucket is full again is forgotten: a new bucket is as full.  Of a micro-batch, only times and
    numbers are held and sorted, 16 bytes a line; the lines themselves wait in a temporary file, from which they are told in the order they came.
    """
    waiting = pa.schema([("seq", pa.int64()), ("ts", pa.timestamp("ns")), ("line", pa.string())])

    def fold(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        with tempfile.SpooledTemporaryFile(HELD_BYTES) as file:
            times, seqs = [], []
            with pa.ipc.new_stream(file, waiting, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for d in pdfs:
                    if len(d):
                        times.append(d["ts"].to_numpy("datetime64[us]"))
                        seqs.append(d["seq"].to_numpy())
                        out.write_batch(pa.RecordBatch.from_pandas(d[waiting.names], waiting, preserve_index=False))
            if not times:
                return
            times = np.concatenate(times)
            seqs = np.concatenate(seqs)
            order = np.lexsort((seqs, times))
            del seqs
            full_at, last = state.get if state.exists else (None, None)
            bucket, ok = TokenBucket(rate, full_at), np.empty(len(order), dtype=bool)
            for at in range(0, len(order), AT_ONCE):
                some = order[at:at + AT_ONCE]
                nanos = times[some].astype("int64") * 1000
                if last is not None:
                    # a late line cannot move the clock back
                    nanos = nanos.clip(min=last)
                ok[some] = bucket.take(nanos)
            del times, order
            full_at = bucket.full_at if bucket.full_at is not None else int(nanos[-1])
            state.update((int(full_at), int(nanos[-1])))
            _until(state, full_at / 1e9)
            file.seek(0)
            at = 0
            for batch in pa.ipc.open_stream(file):
                d = batch.to_pandas()
                yield d.assign(source=key[0], accepted=ok[at:at + len(d)])[["source", "seq", "ts", "line", "accepted"]]
                at += len(d)

    return lines.select("source", "seq", "ts", "line").withWatermark("ts", late).groupBy("source").applyInPandasWithState(
        fold, "source string, seq bigint, ts timestamp, line string, accepted boolean", "full_at bigint, last bigint",
        "append", GroupStateTimeout.EventTimeTimeout)


def counter_increments(samples: DataFrame, keys: list[str], late: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """Reset-aware increments with the last value per series as state: ``(keys.., ts, inc)``.

    A series that is silent for ``idle`` is forgotten and starts anew, with an increment of 0.  Series are dealt by hash over ``SHARDS``
    states, so that Python is called once per shard and not once per series; each series keeps its own time to be forgotten.
    """
    schema = samples.select(*keys).schema
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), "ts timestamp", "inc double"])
    rest = pd.Timedelta(idle).total_seconds()

    def fold(key, pdfs, state: GroupState):
        mark = state.getCurrentWatermarkMs()
        names, *numbers = state.get if state.exists else ([], [], [], [])
        last, seen, until = (np.array(x, dtype=t) for x, t in zip(numbers, ("float64", "float64", "int64")))
        came = np.zeros(len(names), dtype=bool)
        d = pd.DataFrame() if state.hasTimedOut else pd.concat([p for p in pdfs if len(p)])
        if len(d):
            old = len(names)
            of, names = pd.factorize(np.concatenate([np.array(names, dtype=object), d["_series"].to_numpy(dtype=object)]))
            of, new = of[old:], len(names) - old
            last, until = np.append(last, np.full(new, np.nan)), np.append(until, np.full(new, mark))
            seen, came = np.append(seen, np.full(new, -np.inf)), np.append(came, np.zeros(new, dtype=bool))
            came[of] = True
            at, value = _seconds(d["ts"]).to_numpy(), d["value"].to_numpy(dtype="float64")
            order = np.lexsort((at, of))
            order = order[~np.isnan(value[order]) & (at[order] > seen[of[order]])]
            of, at, value = of[order], at[order], value[order]
            if len(of):
                first = np.append(True, of[1:] != of[:-1])
                prev = np.append(np.nan, value[:-1])
                prev[first] = np.where(np.isinf(seen[of[first]]), value[first], last[of[first]])
                with np.errstate(invalid="ignore"):
                    inc = np.where(value >= prev, value - prev, value)
                yield d[[*keys, "ts"]].iloc[order].assign(inc=inc)
                ends = np.append(first[1:], True)
                last[of[ends]], seen[of[ends]] = value[ends], at[ends]
            live = came & ~np.isinf(seen)
            until[live] = np.maximum(np.ceil((seen[live] + rest) * 1000).astype("int64"), mark + 1)
        # As with a state of its own, a series' time is up once the watermark has passed it and no sample came along.
        kept = ~np.isinf(seen) & (came | (until >= mark))
        if kept.any():
            state.update((np.array(names, dtype=object)[kept].tolist(), last[kept].tolist(), seen[kept].tolist(), until[kept].tolist()))
            state.setTimeoutTimestamp(max(int(until[kept].min()), mark + 1))
        elif state.exists:
            state.remove()

    series = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]).cast("array<string>"))
    dealt = samples.select(*keys, "ts", "value", series.alias("_series")).withColumn("_shard", F.pmod(F.xxhash64("_series"), F.lit(SHARDS)))
    return dealt.withWatermark("ts", late).groupBy("_shard").applyInPandasWithState(
        fold, out, "names array<string>, last array<double>, seen array<double>, until array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def alert_states(cond: DataFrame, keys: list[str], hold: int, interval: int, late: str = "5 minutes") -> DataFrame:
    """Hold-time state machine over condition rows ``(keys.., t, value)``.

    A row exists where the condition is true; a gap ends the run, and with it
    the alert's state.  Rows of a key must not arrive out of order across
    micro-batches (the grid evaluation emits them in time order).
    """
    out = ", ".join([*(f"`{k}` string" for k in keys), "t bigint", "value double", "active_since bigint", "state string"])

    def fold(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        d = _ordered(pdfs, ["t"])
        since, last = state.get if state.exists else (None, None)
        if last is not None:
            d = d[d["t"] > last]
        if d.empty:
            if state.exists:
                _until(state, last + interval)
            return
        starts, states = [], []
        for t in d["t"].tolist():
            since = t if last is None or t - last != interval else since
            last = t
            starts.append(since)
            states.append("firing" if t - since >= hold else "pending")
        state.update((int(since), int(last)))
        _until(state, last + interval)
        yield d[[*keys, "t", "value"]].assign(active_since=starts, state=states)

    timed = cond.select(*keys, "t", "value").withColumn("_ts", F.timestamp_seconds("t")).withWatermark("_ts", late)
    return timed.groupBy(*keys).applyInPandasWithState(
        fold, out, "since bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def assemble_streams(chunks: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Complete requests from streamed chunks: ``(request_id, chunks ARRAY)``, one row per request.

    A request is emitted on its ``[DONE]`` line, or when the watermark passes
    its last chunk by ``late``.  After that a tombstone stays until the watermark passes the last chunk by
    ``late``, so that a chunk that comes after the end is dropped instead of opening the request again.
    Feed :func:`exploded_chunks` of the result to ``requests.assemble_stream`` in ``foreachBatch``,
    or see :func:`follow_request_facts`.
    """
    item = "array<struct<seq: bigint, recv_ts: timestamp, payload: string>>"
    wait = pd.Timedelta(late).total_seconds()

    def fold(key, pdfs, state: GroupState):
        seqs, times, texts, closed = state.get if state.exists else ([], [], [], False)
        seqs, times, texts = list(seqs), list(times), list(texts)
        if state.hasTimedOut:
            state.remove()
            done = not closed
        else:
            d = _ordered(pdfs, ["seq"])
            fresh = (_seconds(d["recv_ts"]) * 1e6).astype("int64").tolist()
            if closed:
                times, done = [max(times + fresh)], False
            else:
                seqs += d["seq"].tolist()
                times += fresh
                texts += d["payload"].tolist()
                done = any(t is not None and t.strip().endswith("[DONE]") for t in texts)
            if closed or done:
                state.update(([], [max(times)], [], True))
            else:
                state.update((seqs, times, texts, False))
            _until(state, max(times) / 1e6 + wait)
        if done and seqs:
            order = sorted(range(len(seqs)), key=seqs.__getitem__)
            rows = [{"seq": seqs[i], "recv_ts": pd.Timestamp(times[i], unit="us"), "payload": texts[i]} for i in order]
            yield pd.DataFrame({"request_id": [key[0]], "chunks": [rows]})

    return chunks.withWatermark("recv_ts", late).select("request_id", "seq", "recv_ts", "payload").groupBy("request_id").applyInPandasWithState(
        fold, f"request_id string, chunks {item}", "seqs array<bigint>, times array<bigint>, texts array<string>, closed boolean", "append",
        GroupStateTimeout.EventTimeTimeout)


CHUNK_LINES = "request_id STRING, seq BIGINT, recv_ts TIMESTAMP, payload STRING"


def follow_chunks(spark, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of recorded completion chunks (JSON lines) from a folder."""
    reader = spark.readStream.schema(CHUNK_LINES).format("json")
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def follow_request_facts(chunks: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, late: str = "5 minutes", once: bool = False):
    """Chunks -> assembled requests -> content, tokens and finish reason of each, handed to ``write`` per micro-batch."""
    def facts(batch: DataFrame, epoch: int) -> None:
        write(R.stream_completion_tokens(streamed_requests(batch)), epoch)

    w = assemble_streams(chunks, late).writeStream.foreachBatch(facts).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def exploded_chunks(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", F.explode("chunks").alias("c")).select("request_id", "c.*")


def group_notifications(changes: DataFrame, keys: list[str], late: str = "1 minute", wait: int = GROUP_WAIT,
                        interval: int = GROUP_INTERVAL, repeat: int = REPEAT_INTERVAL) -> DataFrame:
    """Grouped notifications from alert changes ``(keys.., ts, delta)``.

    ``delta`` is +1 when an alert starts firing and -1 when it resolves.  The
    group clock is event time: the first flush comes ``wait`` seconds after the
    first change, then every ``interval``; unchanged groups repeat after
    ``repeat``.  Emits ``(keys.., t, n_firing, reason)``.
    """
    out = ", ".join([*(f"`{k}` string" for k in keys), "t bigint", "n_firing bigint", "reason string"])

    def flushes(firing, pending, nxt, sent, now):
        """Flush every due slot up to ``now``; ``pending`` is in time order and each change is passed once."""
        rows, at = [], 0
        while nxt is not None and nxt <= now:
            first = at
            while at < len(pending) and pending[at][0] <= nxt:
                firing += pending[at][1]
                at += 1
            if at > first:
                rows.append((nxt, firing, "resolved" if firing == 0 else "changed"))
                sent = nxt
            elif firing > 0 and nxt - sent >= repeat:
                rows.append((nxt, firing, "repeat"))
                sent = nxt
            nxt = nxt + interval if firing > 0 or at < len(pending) else None
        pending = pending[at:]
        return firing, pending, nxt, sent, rows

    def fold(key, pdfs, state: GroupState):
        firing, nxt, sent, times, deltas = state.get if state.exists else (0, None, 0, [], [])
        pending = list(zip(times, deltas))
        mark = state.getCurrentWatermarkMs() // 1000
        if not state.hasTimedOut:
            d = _ordered(pdfs, ["ts"])
            pending += list(zip(_seconds(d["ts"]).astype("int64").tolist(), d["delta"].astype(int).tolist()))
            if nxt is None and pending:
                nxt = min(p[0] for p in pending) + wait
        firing, pending, nxt, sent, rows = flushes(firing, sorted(pending), nxt, sent, mark)
        if nxt is None:
            if state.exists:
                state.remove()
        else:
            state.update((int(firing), int(nxt), int(sent), [int(p[0]) for p in pending], [int(p[1]) for p in pending]))
            state.setTimeoutTimestamp(max(nxt * 1000, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=[*keys, "t", "n_firing", "reason"])

    return changes.withWatermark("ts", late).select(*keys, "ts", "delta").groupBy(*keys).applyInPandasWithState(
        fold, out, "firing bigint, nxt bigint, sent bigint, times array<bigint>, deltas array<bigint>", "append",
        GroupStateTimeout.EventTimeTimeout)


def judge_batches(traces: DataFrame, scorer: Callable[[list[str]], list[str]], project: str, reason: str, path: str,
                  checkpoint: str, once: bool = False):
    """Periodic judge pass: pending traces of each micro-batch -> scores appended to ``path``.

    Scores lie by the day of their trace.  A micro-batch reads back those of its own days and no
    others, so a replayed batch does not score a trace twice and history costs nothing; traces without a start lie apart.
    """
    day = F.coalesce(F.to_date("start_time").cast("string"), F.lit("none"))

    def one(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        days = [r.day for r in batch.select(day.alias("day")).distinct().collect()]
        prior = None
        if days and _exists(spark, path):
            prior = spark.read.schema("id string, name string, day string").json(path).where(F.col("day").isin(days)).select("id", "name")
        scores = E.judge_once(batch, prior, scorer, project, reason)
        of = batch.select("id", day.alias("day")).dropDuplicates(["id"])
        scores.join(of, "id").write.mode("append").partitionBy("day").json(path)

    w = traces.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def _exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def backfill_then_follow(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, follow: bool = True):
    """Drain the history with ``availableNow``, then go on from the same checkpoint."""
    def start(w):
        return w.foreachBatch(write).option("checkpointLocation", checkpoint)

    start(stream.writeStream).trigger(availableNow=True).start().awaitTermination()
    return start(stream.writeStream).start() if follow else None


def streamed_requests(batch: DataFrame) -> DataFrame:
    """Assembled requests of one micro-batch."""
    return R.assemble_stream(exploded_chunks(batch))
