"""The same operators on streams: requests, status, live speech rate and utterances, label files."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from rostrum.functions.text import FILLERS, is_filler, syllables
from rostrum.operators.chunking import MOST_MS, MOST_WORDS, PAUSE_MS
from rostrum.operators.prepare import error_text, latest
from rostrum.plans import scratch
from rostrum.sources.files import Upsert

REQUEST = "analysis_id string, seq long, audio struct<bucket:string,object_key:string>, document struct<bucket:string,object_key:string>"


def parse_requests(messages: DataFrame) -> DataFrame:
    """Messages (column value) as requests, with why a bad one is rejected."""
    r = messages.withColumn("r", F.from_json("value", REQUEST, {"mode": "PERMISSIVE"}))
    bad = F.when(F.col("r").isNull() | F.col("r.analysis_id").isNull(), "malformed").when(F.col("r.audio.object_key").isNull(), "no_audio")
    return r.select("value", "r.*", bad.alias("reason"))


ERROR = "struct<code:string,message:string>"


def fault(*checks: tuple[Column, str, Column | str]) -> Column:
    """The first check (condition, code, message) that holds, as an error; null if none does. Conditions should not raise: try_cast, try_divide and the like."""
    out = F.lit(None).cast(ERROR)
    for condition, code, message in reversed(checks):
        text = error_text(F.lit(message) if isinstance(message, str) else message)
        out = F.when(condition, F.struct(F.lit(code).alias("code"), text.alias("message")).cast(ERROR)).otherwise(out)
    return out


def each_request(work: Callable[[dict], dict], result: str) -> Callable[[DataFrame], DataFrame]:
    """An analysis by a Python function of one request, on the executors: its result (a DDL of fields), or what it raised as error.

    One request's exception is that request's result; it fails no task and no batch.
    """

    def analyse(requests: DataFrame) -> DataFrame:
        kinds = StructType.fromDDL(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in requests.schema if f.name in ('analysis_id', 'seq'))}, {result}, error {ERROR}")
        schema, names = to_arrow_schema(kinds), StructType.fromDDL(result).names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for r in b.to_pylist():
                    row = {"analysis_id": r["analysis_id"], "seq": r["seq"]}
                    try:
                        done = work(r)
                        row |= {k: done.get(k) for k in names}
                    except Exception as e:
                        row["error"] = {"code": type(e).__name__, "message": str(e)[:500]}
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, schema)

        return requests.mapInArrow(run, kinds)

    return analyse


def serve(messages: DataFrame, analyse: Callable[[DataFrame], DataFrame], store: Upsert, rejects: str, checkpoint: str) -> StreamingQuery:
    """Each batch: reject bad messages, analyse the others, upsert results, failed requests among them, by one merge.

    Failures are data: an analysis returns a column error (code, message), made by
    fault() or each_request(); a request with an error, or that the analysis gives no row
    for, is written as state "failed" with error_code and error_message as far as the store has
    these columns. An analysis that raises as a whole is tried on halves of its batch, by a hash of the request,
    until what fails stands alone; results wait in the shared folder meanwhile. Nothing else is caught: a
    store or a reject folder that fails stops the stream, and the batch runs again
    when it is started again. The store remembers the batch with the version that holds it, so a batch that
    ran to its end and runs again changes nothing.
    """
    spark = messages.sparkSession
    types = store.read().schema
    known = {"state": lambda e: F.lit("failed"), "error_code": lambda e: e["code"], "error_message": lambda e: e["message"]}

    def failed(rows: DataFrame, error: Column) -> DataFrame:
        return rows.select([F.col(c.name) if c.name in (store.key, store.seq) else (known[c.name](error) if c.name in known else F.lit(None)).cast(c.dataType).alias(c.name) for c in types])

    def results(rows: DataFrame) -> DataFrame:
        done = analyse(rows)
        if "error" not in done.columns:
            return done.select(*types.names)
        own = [c for c in types.names if c not in done.columns]  # an analysis may leave state and error_ columns to us
        fine = done.where("error IS NULL").withColumns({c: F.lit("done" if c == "state" else None).cast(types[c].dataType) for c in own})
        return fine.select(*types.names).unionByName(failed(done.where("error IS NOT NULL"), F.col("error")))

    def attempt(rows: DataFrame, bit: int) -> list[DataFrame]:
        try:
            return [scratch.keep(results(rows), "results")]
        except Exception as e:  # an analysis that raises as a whole
            error = F.struct(F.lit(type(e).__name__).alias("code"), error_text(F.lit(str(e))).alias("message"))
        if rows.limit(2).count() < 2 or bit == 64:
            return [scratch.keep(failed(rows, error), "results")]
        side = F.shiftright(F.xxhash64("analysis_id", "seq"), bit).bitwiseAND(F.lit(1))
        return [x for half in (0, 1) for x in attempt(rows.where(side == half), bit + 1)]

    def batch(df: DataFrame, n: int) -> None:
        if store.holds(n):
            return
        df = scratch.keep(parse_requests(df), "requests")
        df.where("reason IS NOT NULL").select("value", "reason").write.mode("overwrite").json(f"{rejects}/batch={n}")
        rows = df.where("reason IS NULL").drop("value", "reason")
        kept = attempt(rows, 0)
        found = reduce(DataFrame.unionByName, kept)
        lost = rows.join(found.select(store.key, store.seq), [store.key, store.seq], "left_anti")
        store.merge(found.unionByName(failed(lost, fault((F.lit(True), "NoResult", "the analysis gave no row for this request")))), n)
        for x in [df, *kept]:
            scratch.drop(x)

    scratch.folder(spark)
    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_status(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Latest state per request from (analysis_id, seq, state, ts), repeats within the watermark dropped."""
    e = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["analysis_id", "seq"])
    return e.groupBy("analysis_id").agg(F.max(F.struct("seq", "state")).alias("x")).select("analysis_id", "x.seq", "x.state")


def live_rate(words: DataFrame, width: str = "1 second", slide: str = "500 milliseconds", late: str = "5 seconds", pattern: str = "[가-힣]", fillers=FILLERS) -> DataFrame:
    """Syllables and fillers per window from (session_id, ts, word); windows close when the watermark passes."""
    w = words.withWatermark("ts", late).groupBy("session_id", F.window("ts", width, slide))
    return w.agg(F.sum(syllables(F.col("word"), pattern)).alias("syllables"), F.count_if(is_filler(F.col("word"), fillers)).alias("fillers"), F.count("*").alias("n_words")).select("session_id", F.col("window.start").alias("start"), "syllables", "fillers", "n_words")


def _longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


class _Utterances(StatefulProcessor):
    """Words of a talk (us, microseconds) to utterances. State: the open utterance, and the words above the watermark, which others may still precede."""

    def __init__(self, pause_ms: int, most_ms: int, most_words: int):
        self.pause, self.most, self.most_words = pause_ms * 1000, most_ms * 1000, most_words

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _longs("start", "end", "n"))
        self.waiting = handle.getListState("waiting", _longs("us"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.waiting.appendList([(r.us,) for r in rows])
        yield from self._fold(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._fold(key, timerValues.getCurrentWatermarkInMs())

    def _fold(self, key, watermark_ms: int) -> Iterator[Row]:
        """Words up to the watermark are complete and go into utterances in order; an utterance leaves as soon as it is over."""
        sure = watermark_ms * 1000
        words = sorted(x[0] for x in self.waiting.get())
        ready = bisect_right(words, sure)
        now = list(self.open.get()) if self.open.exists() else None
        for us in words[:ready]:
            if now and us - now[1] >= self.pause:
                yield self._row(key, now)
                now = None
            now = [now[0], us, now[2] + 1] if now else [us, us, 1]
            if now[1] - now[0] >= self.most or now[2] >= self.most_words:
                yield self._row(key, now)
                now = None
        if now and sure >= now[1] + self.pause:
            yield self._row(key, now)
            now = None
        if ready:
            self.waiting.put([(us,) for us in words[ready:]]) if words[ready:] else self.waiting.clear()
        self.open.update(tuple(now)) if now else self.open.clear()
        for t in [x[0] if isinstance(x, tuple) else x for x in self.handle.listTimers()]:
            self.handle.deleteTimer(t)
        left = words[ready:]
        if now or left:
            self.handle.registerTimer(max(watermark_ms + 1, -(-(left[0] if left else now[1] + self.pause) // 1000)))

    def _row(self, key, x: list[int]) -> Row:
        return Row(session_id=key[0], start=x[0], end=x[1], n_words=x[2])

    def close(self) -> None:
        pass


def live_utterances(words: DataFrame, pause_ms: int = PAUSE_MS, late: str = "5 seconds", most_ms: int = MOST_MS, most_words: int = MOST_WORDS) -> DataFrame:
    """(session_id, start, end, n_words): utterances between pauses, of at most so many words, begun anew once one has lasted so long.

    start and end are the first and the last word's time. Words of one time count
    apart; words behind the watermark are left out. On a stream an utterance leaves when the watermark shows that it is
    over, not when the talk pauses: a talk holds three numbers and the
    words of the last `late`. This needs the RocksDB state store, which is set for the session. On a table it
    is a fold over a talk's words.
    """
    times = words.select("session_id", "ts", F.unix_micros("ts").alias("us"))
    if words.isStreaming:
        words.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        kind = times.schema["session_id"].dataType.simpleString()
        made = times.withWatermark("ts", late).groupBy("session_id").transformWithState(_Utterances(pause_ms, most_ms, most_words), f"session_id {kind}, start long, end long, n_words long", "Append", "EventTime")
        return made.select("session_id", *[F.timestamp_micros(c).alias(c) for c in ("start", "end")], "n_words")
    talk = times.groupBy("session_id").agg(F.array_sort(F.collect_list("us")).alias("w"))
    piece = lambda a, b, n: F.struct(a.alias("start"), b.alias("end"), n.cast("long").alias("n_words"))

    def add(state, us):
        c = state["open"]
        over = (us - c["end"] >= pause_ms * 1000) | (c["end"] - c["start"] >= most_ms * 1000) | (c["n_words"] >= most_words)
        more = piece(c["start"], us, c["n_words"] + 1)
        return F.when(c["n_words"] == 0, F.struct(state["done"].alias("done"), piece(us, us, F.lit(1)).alias("open"))).when(over, F.struct(F.concat(state["done"], F.array(c)).alias("done"), piece(us, us, F.lit(1)).alias("open"))).otherwise(F.struct(state["done"].alias("done"), more.alias("open")))

    none = F.array().cast("array<struct<start:bigint,end:bigint,n_words:bigint>>")
    zero = F.lit(0).cast("long")
    x = talk.select("session_id", F.aggregate("w", F.struct(none.alias("done"), piece(zero, zero, zero).alias("open")), add).alias("x"))
    x = x.select("session_id", F.explode(F.concat("x.done", F.array("x.open"))).alias("u")).select("session_id", "u.*")
    return x.select("session_id", *[F.timestamp_micros(c).alias(c) for c in ("start", "end")], "n_words")


def incremental_labels(spark: SparkSession, path: str, prepare: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """New label files since the last run, prepared and appended; the checkpoint remembers what is done."""
    raw = spark.readStream.schema("value string").option("wholetext", True).text(path)
    return prepare(raw).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(events: DataFrame) -> DataFrame:
    """The batch counterpart of live_status()."""
    return latest(events.select("analysis_id", "seq", "state"), "analysis_id")
