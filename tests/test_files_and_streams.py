"""Sources, sinks and streams on small files; a stream gives what the batch gives."""

from __future__ import annotations

import json
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.operators import prepare as p
from rostrum.sources import files
from rostrum.streaming import live


def test_words_labels_and_rejects(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.json").write_text(json.dumps({"text": "x", "words": [{"word": "hi", "start": 0.0, "end": 0.2}, {"word": "you", "start": 0.3, "end": 0.5}]}))
    (tmp_path / "w/b.json").write_text(json.dumps({"text": "x"}))
    good, bad = files.read_words(spark, str(tmp_path / "w"))
    assert [r.word for r in good.orderBy("word_idx").collect()] == ["hi", "you"] and bad.count() == 1
    (tmp_path / "l").mkdir()
    (tmp_path / "l/a.json").write_text(json.dumps({"dataSet": {"answer": {"raw": {"wordCount": 22}}}, "rawDataInfo": {"answer": {"duration": 10000, "audioPath": "x/y.wav"}}}))
    (tmp_path / "l/b.json").write_text("{broken")
    good, bad = files.read_labels(spark, str(tmp_path / "l"))
    assert [(r.word_count, r.duration_ms, r.audio_path) for r in good.collect()] == [(22, 10000.0, "x/y.wav")] and bad.count() == 1


def test_wav_frames_and_targets(spark, tmp_path):
    rate = 8000
    x = np.r_[0.1 * np.sin(2 * np.pi * 440 * np.arange(rate) / rate), np.zeros(rate // 2)]
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    (tmp_path / "b.wav").write_bytes(b"no wave")
    f = files.read_wav_frames(spark, str(tmp_path))
    assert f.where("error IS NOT NULL").count() == 1
    t = p.audio_targets(f.where("error IS NULL").withColumn("pitch", F.lit(0.0)), ["path"]).first()
    assert t.silence_ratio == pytest.approx(1 / 3, abs=0.05) and t.pitch_shift == 0
    assert [r.audio_name for r in files.audio_inventory(spark, str(tmp_path)).orderBy("audio_name").collect()] == ["a.wav", "b.wav"]


def test_manifest_forms_and_parts(spark, tmp_path):
    rows = [{"audio_path": f"{i}.wav", "speech_rate": 2.0, "silence_ratio": 0.1, "energy_drop": "yes", "pitch_shift": "0", "overall_delivery": 0.5} for i in range(4)]
    (tmp_path / "m.json").write_text(json.dumps(rows))
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "m.csv").write_text(",".join(rows[0]) + "\n" + "\n".join(",".join(map(str, r.values())) for r in rows))
    a, b, c = (sorted(map(tuple, files.read_manifest(spark, str(tmp_path / f"m.{x}")).collect())) for x in ("json", "jsonl", "csv"))
    assert a == b == c and len(a) == 4
    assert files.merge_parts(spark, [str(tmp_path / "m.jsonl")] * 2).count() == 8
    with pytest.raises(ValueError):
        files.merge_parts(spark, [str(tmp_path / "m.jsonl")], 9)
    assert [r.x for r in files.read_manifest(spark, str(tmp_path / "m.csv")).select(p.binary(F.col("energy_drop")).alias("x")).collect()] == [1] * 4
    files.write_jsonl(files.read_manifest(spark, str(tmp_path / "m.csv")), str(tmp_path / "out"))
    assert spark.read.schema(files.MANIFEST).json(str(tmp_path / "out")).count() == 4


def test_requests_upsert_and_status(spark, tmp_path):
    (tmp_path / "q").mkdir()
    ok = lambda i, s: json.dumps({"analysis_id": i, "seq": s, "audio": {"bucket": "b", "object_key": "k"}})
    (tmp_path / "q/1.txt").write_text("\n".join([ok("a", 1), ok("b", 2), "{broken", json.dumps({"analysis_id": "c", "seq": 1})]))
    (tmp_path / "q/2.txt").write_text(ok("a", 3))
    store = files.Upsert(spark, str(tmp_path / "t"), "analysis_id string, seq long, state string", "analysis_id", "seq")
    analyse = lambda df: df.select("analysis_id", "seq", F.lit("done").alias("state"))
    live.serve(spark.readStream.schema("value string").text(str(tmp_path / "q")), analyse, store, str(tmp_path / "r"), str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, store.read().collect())) == [("a", 3, "done"), ("b", 2, "done")]
    assert sorted(r.reason for r in spark.read.json(str(tmp_path / "r")).collect()) == ["malformed", "no_audio"]
    store.merge(store.read())
    assert store.read().count() == 2


def test_a_failing_analysis_is_recorded(spark, tmp_path):
    (tmp_path / "q").mkdir()
    rows = [json.dumps({"analysis_id": f"k{i}", "seq": i, "audio": {"bucket": "b", "object_key": "k"}}) for i in range(7)]
    (tmp_path / "q/1.txt").write_text("\n".join(rows))
    store = files.Upsert(spark, str(tmp_path / "t"), "analysis_id string, seq long, state string, error_code string, error_message string, score double", "analysis_id", "seq")

    def analyse(df):
        if df.where("seq % 3 = 1").count():
            raise RuntimeError("no speech " * 100)
        return df.select("analysis_id", "seq", F.lit("done").alias("state"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"), F.lit(1.0).alias("score"))

    live.serve(spark.readStream.schema("value string").text(str(tmp_path / "q")), analyse, store, str(tmp_path / "r"), str(tmp_path / "c")).awaitTermination()
    got = {r.analysis_id: r for r in store.read().collect()}
    assert {k for k, r in got.items() if r.state == "failed"} == {"k1", "k4"} and len(got) == 7
    assert got["k1"].error_code == "RuntimeError" and got["k1"].error_message == ("no speech " * 100)[:500] and got["k0"].score == 1.0


def test_upsert_after_a_crash(spark, tmp_path):
    store = files.Upsert(spark, str(tmp_path / "t"), "k string, n long", "k", "n")
    rows = lambda *x: spark.createDataFrame(x, "k string, n long")
    store.merge(rows())
    assert store.read().count() == 0
    store.merge(rows(("a", 1), ("b", 1)))
    rows(("z", 9)).write.parquet(str(tmp_path / "t/v3"))
    (tmp_path / "t/v3/_SUCCESS").unlink()  # a write that never ended
    assert sorted(map(tuple, store.read().collect())) == [("a", 1), ("b", 1)]
    for n in (2, 3):
        store.merge(rows(("a", n), ("a", 0)))
    assert sorted(map(tuple, store.read().collect())) == [("a", 3), ("b", 1)]
    assert store._versions() == [3, 4]


def test_utterances_end_by_words_and_time(spark):
    at = [0.1 * i for i in range(40)] + [10 + 0.5 * i for i in range(20)]  # 40 quick words, a pause, 20 slow ones
    df = spark.createDataFrame([("s", t) for t in at] + [("u", 0.0), ("u", 0.0)], "session_id string, t double").withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("long")))
    got = [(r.session_id, r.n_words, round(r.end.timestamp() - r.start.timestamp(), 1)) for r in sorted(live.live_utterances(df).collect(), key=lambda r: (r.session_id, r.start))]
    assert got == [("s", 36, 3.5), ("s", 4, 0.3), ("s", 17, 8.0), ("s", 3, 1.0), ("u", 2, 0.0)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", f"2024-01-01 00:00:{i // 10:02d}.{i % 10}00", w) for i, w in enumerate(["음", "안녕", "어", "발표", "시작"] * 6)] + [("s", "2024-01-01 00:01:00", "끝")]
    df = spark.createDataFrame(rows, "session_id string, ts string, word string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "w"))
    for name, op in (("rate", live.live_rate), ("utterances", live.live_utterances)):
        op(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        got = {tuple(r) for r in spark.table(name).collect()}
        want = {tuple(r) for r in op(df).collect()}
        # only windows that the last word keeps open are still to come
        assert got and got <= want and all(r[1].minute == 1 or r[1].second == 59 for r in want - got)


def test_split_sizes_and_latest(spark):
    assert p.split_sizes(10, 0.9, 0.1) == (9, 1, 0) and p.split_sizes(3, 0.9, 0.1) == (2, 1, 0)
    assert p.split_sizes(10, 0.9, 0.1, True) == (8, 1, 1)
    with pytest.raises(ValueError):
        p.split_sizes(2, 0.5, 0.5)
    df = spark.createDataFrame([(f"k{i}",) for i in range(300)], "key string")
    n = {r.split: r["count"] for r in p.split(df, "key", 0.8, 0.1).groupBy("split").count().collect()}
    assert n == {"train": 240, "valid": 30, "test": 30}


def _messages(tmp_path, ids):
    (tmp_path / "q").mkdir(exist_ok=True)
    rows = [json.dumps({"analysis_id": f"k{i}", "seq": i, "audio": {"bucket": "b", "object_key": "k"}}) for i in ids]
    (tmp_path / f"q/{ids[0]}.txt").write_text("\n".join(rows))


STORE = "analysis_id string, seq long, state string, error_code string, error_message string, score double"


def _serve(spark, tmp_path, analyse, store, checkpoint="c"):
    live.serve(spark.readStream.schema("value string").text(str(tmp_path / "q")), analyse, store, str(tmp_path / "r"), str(tmp_path / checkpoint)).awaitTermination()


def test_failures_are_data_and_one_merge(spark, tmp_path):
    _messages(tmp_path, range(8))
    store = files.Upsert(spark, str(tmp_path / "t"), STORE, "analysis_id", "seq")

    def analyse(df):
        n = F.col("seq")
        return df.where("seq <> 5").select("analysis_id", "seq", F.try_divide(F.lit(12.0), n).alias("score"), live.fault((n == 0, "ZeroDivisionError", F.concat(F.lit("seq "), n)), (n == 6, "Silent", "no speech")).alias("error"))

    _serve(spark, tmp_path, analyse, store)
    got = {r.analysis_id: (r.state, r.error_code, r.error_message, r.score) for r in store.read().collect()}
    assert got["k0"] == ("failed", "ZeroDivisionError", "seq 0", None) and got["k6"] == ("failed", "Silent", "no speech", None)
    assert got["k5"][:2] == ("failed", "NoResult") and got["k4"] == ("done", None, None, 3.0) and len(got) == 8
    assert store._folders() == [(1, 0)]


def test_each_request_by_a_function(spark, tmp_path):
    _messages(tmp_path, range(6))
    store = files.Upsert(spark, str(tmp_path / "t"), STORE, "analysis_id", "seq")

    def work(request):
        if request["seq"] == 3:
            raise KeyError("no slides")
        return {"score": request["seq"] / 2}

    _serve(spark, tmp_path, live.each_request(work, "score double"), store)
    got = {r.analysis_id: (r.state, r.error_code, r.error_message, r.score) for r in store.read().collect()}
    assert got["k3"] == ("failed", "KeyError", "'no slides'", None) and got["k5"] == ("done", None, None, 2.5)


def test_a_failing_store_stops_the_stream(spark, tmp_path):
    _messages(tmp_path, range(4))

    class Broken(files.Upsert):
        def merge(self, rows, batch=-1):
            raise OSError("disk full")

    broken = Broken(spark, str(tmp_path / "t"), STORE, "analysis_id", "seq")
    analyse = lambda df: df.select("analysis_id", "seq", F.lit(1.0).alias("score"), live.fault().alias("error"))
    with pytest.raises(Exception, match="disk full"):
        _serve(spark, tmp_path, analyse, broken)
    store = files.Upsert(spark, str(tmp_path / "t"), STORE, "analysis_id", "seq")
    assert store.read().count() == 0
    _serve(spark, tmp_path, analyse, store)  # the batch runs again
    assert {r.state for r in store.read().collect()} == {"done"} and store.read().count() == 4


def test_a_batch_again_changes_nothing(spark, tmp_path):
    _messages(tmp_path, range(4))
    store = files.Upsert(spark, str(tmp_path / "t"), STORE, "analysis_id", "seq")
    runs = []

    def analyse(df):
        runs.append(1)
        return df.select("analysis_id", "seq", F.lit(float(len(runs))).alias("score"), live.fault().alias("error"))

    _serve(spark, tmp_path, analyse, store)
    _serve(spark, tmp_path, analyse, store, "lost checkpoint")  # batch 0 once more
    assert len(runs) == 1 and {r.score for r in store.read().collect()} == {1.0}
    store.merge(spark.createDataFrame([("x", 1, "done", None, None, 2.0)], STORE))
    assert store.holds(0) and not store.holds(1) and store._folders()[-1] == (2, 0)


def test_utterances_leave_without_a_pause(spark, tmp_path):
    """A talk that never pauses, in shuffled order within the watermark, file by file: utterances come as it goes and equal the fold."""
    import random

    r = random.Random(3)
    times = [10**12 + k * 200 for k in range(900)] + [10**12 + 200_000 + k * 1000 for k in range(20)]  # no pause of 900 ms for three minutes, then words apart
    (tmp_path / "w").mkdir()
    for n in range(0, len(times), 60):
        part = [("s", t) for t in times[n : n + 60]] + [("u", t) for t in times[n : n + 60] if t % 400 == 0]
        r.shuffle(part)
        (tmp_path / f"w/{n:04d}.csv").write_text("\n".join(f"{s},{t}" for s, t in part))
        os.utime(tmp_path / f"w/{n:04d}.csv", (n, n))
    as_words = lambda df: df.select("session_id", F.timestamp_millis("ms").alias("ts"))
    stream = spark.readStream.schema("session_id string, ms long").option("maxFilesPerTrigger", 1).csv(str(tmp_path / "w"))
    seen = []
    q = live.live_utterances(as_words(stream)).writeStream.foreachBatch(lambda df, n: seen.append((n, sorted(map(tuple, df.collect()))))).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [x for _, xs in seen for x in xs]
    want = sorted(map(tuple, live.live_utterances(as_words(spark.read.schema("session_id string, ms long").csv(str(tmp_path / "w")))).collect()))
    end = max(x[2] for x in want)
    assert len(got) == len(set(got)) and set(got) <= set(want)
    assert all((end - x[2]).total_seconds() <= 6 for x in set(want) - set(got))
    assert max(x[3] for x in got) == 36 and sum(bool(xs) for _, xs in seen) > 8
    rows = sum(p["numRowsTotal"] for p in q.lastProgress["stateOperators"])
    assert rows < 200  # the last seconds of two talks, not three minutes


def test_late_words_are_left_out(spark, tmp_path):
    (tmp_path / "w").mkdir()
    for n, rows in enumerate([[0, 500, 60_000], [120_000], [700, 180_000], [240_000]]):
        (tmp_path / f"w/{n}.csv").write_text("\n".join(f"s,{10**12 + t}" for t in rows))
        os.utime(tmp_path / f"w/{n}.csv", (n + 1, n + 1))
    stream = spark.readStream.schema("session_id string, ms long").option("maxFilesPerTrigger", 1).csv(str(tmp_path / "w")).select("session_id", F.timestamp_millis("ms").alias("ts"))
    live.live_utterances(stream).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((round(x.start.timestamp() * 1000) - 10**12, round(x.end.timestamp() * 1000) - 10**12, x.n_words) for x in spark.table("late").collect())
    assert got[0] == (0, 500, 2) and (60_000, 60_000, 1) in got  # 700 came after the watermark had passed it
