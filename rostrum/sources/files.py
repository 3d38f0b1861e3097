"""File sources and sinks with explicit schemas; malformed input goes to a reject output, never silently away."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TALK = "text string, words array<struct<word:string,start:double,end:double>>"
MANIFEST = "audio_path string, speech_rate double, silence_ratio double, energy_drop string, pitch_shift string, overall_delivery double"
REPORT = "version string, overall_scores map<string,double>, per_slide_detail array<struct<slide_id:int,coverage:double>>"
PAIRS = "slide_id int, gold_coverage double, gold_missed array<string>, pred_coverage double, pred_missed array<string>"


def read_words(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Word files (one JSON object each): words in order, and the files without words."""
    raw = spark.read.schema(TALK).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), "words")
    good = raw.where(F.size("words") > 0).select("file", F.posexplode("words").alias("word_idx", "w")).select("file", "word_idx", "w.*")
    return good, raw.where(F.coalesce(F.size("words"), F.lit(0)) <= 0).select("file", F.lit("no_words").alias("reason"))


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Label files: word count, duration and audio path out of nested JSON, and the files that don't parse."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("j"))
    get = lambda p, t: F.try_variant_get("j", p, t)
    good = raw.where(F.col("j").isNotNull()).select("file", F.coalesce(get("$.dataSet.answer.raw.wordCount", "int"), F.lit(0)).alias("word_count"), F.coalesce(get("$.rawDataInfo.answer.duration", "double"), F.lit(0.0)).alias("duration_ms"), get("$.rawDataInfo.answer.audioPath", "string").alias("audio_path"))
    return good, raw.where(F.col("j").isNull()).select("file", F.lit("malformed_json").alias("reason"))


def audio_inventory(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """Audio files by name, the first path of each; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")
    return f.groupBy(F.element_at(F.split("path", "/"), -1).alias("audio_name")).agg(F.min(F.struct("path", "length")).alias("x")).select("audio_name", "x.*")


def _little(x: Column, at: Column, n: int) -> Column:
    """The unsigned number in n little-endian bytes."""
    return sum((F.conv(F.hex(F.substring(x, at + i, F.lit(1))), 16, 10).cast("long") * 256**i for i in range(n)), F.lit(0).cast("long"))


def read_wav_lengths(spark: SparkSession, path: str, glob: str = "*.wav", chunks: int = 16) -> tuple[DataFrame, DataFrame]:
    """(audio_path, rate, channels, width, duration_sec) of the WAV files of a folder, and (audio_path, reason) of those that are none.

    Column expressions go through the first chunks of the file's header; no sample is
    decoded. What the header says of the samples is cut to what the file has.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    head = F.substring("content", 1, 1 << 16)
    x = f.select(F.col("path").alias("audio_path"), "length", head.alias("h"))
    name = lambda at: F.substring("h", at, F.lit(4)).cast("string")

    def step(s, _):
        size = _little(F.col("h"), s["at"] + 4, 4)
        fmt, data = name(s["at"]) == "fmt ", name(s["at"]) == "data"
        keep = lambda k, c, n: F.when(fmt, _little(F.col("h"), s["at"] + c, n)).otherwise(s[k]).alias(k)
        after = F.struct((s["at"] + 8 + size + size % 2).cast("int").alias("at"), keep("channels", 10, 2), keep("rate", 12, 4), keep("width", 22, 2), F.when(data, F.least(size, F.col("length") - s["at"] - 7)).otherwise(s["bytes"]).alias("bytes"))
        return F.when((s["at"] + 7 > F.octet_length("h")) | s["bytes"].isNotNull(), s).otherwise(after)

    none = F.lit(None).cast("long")
    start = F.struct(F.lit(13).alias("at"), none.alias("channels"), none.alias("rate"), none.alias("width"), none.alias("bytes"))
    x = x.withColumn("w", F.aggregate(F.sequence(F.lit(1), F.lit(chunks)), start, step))
    wav = (name(F.lit(1)) == "RIFF") & (name(F.lit(9)) == "WAVE")
    each = F.col("w.channels") * F.col("w.rate") * F.col("w.width") / 8
    reason = F.when(~F.coalesce(wav, F.lit(False)), "not_wav").when(F.col("w.rate").isNull() | F.col("w.bytes").isNull(), "no_samples").when(F.coalesce(each, F.lit(0.0)) <= 0, "bad_format")
    x = x.withColumn("reason", reason)
    good = x.where("reason IS NULL").select("audio_path", "w.rate", "w.channels", "w.width", (F.col("w.bytes") / each).alias("duration_sec"))
    return good, x.where("reason IS NOT NULL").select("audio_path", "reason")


def read_wav_frames(spark: SparkSession, path: str, window_ms: int = 32, hop_ms: int = 10, seconds: float | None = 15.0) -> DataFrame:
    """Frames of PCM WAV files (16 or 32 bit, channels averaged): energy in dB relative to the loudest, and silence.

    A file that can't be read is one row with its error. Only frames leave the
    task, never samples; `seconds` bounds what is decoded of a clip.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
                        if width not in (2, 4):
                            raise ValueError(f"sample width {width}")
                        raw = w.readframes(int(min(w.getnframes(), rate * seconds)) if seconds else w.getnframes())
                    x = np.frombuffer(raw, f"<i{width}").reshape(-1, channels).mean(1) / 2.0 ** (8 * width - 1)
                    size, hop = max(1, rate * window_ms // 1000), max(1, rate * hop_ms // 1000)
                    x = np.pad(x, (0, max(0, size - len(x))))
                    rms = np.sqrt(np.lib.stride_tricks.sliding_window_view(x, size)[::hop] ** 2 @ np.full(size, 1 / size))
                    db = 20 * np.log10(np.maximum(rms, 1e-10) / max(rms.max(), 1e-10))
                    yield pd.DataFrame({"path": name, "frame_idx": np.arange(len(db)), "t": np.arange(len(db)) * hop / rate, "energy": db, "silence": db < -40, "error": None})
                except (wave.Error, ValueError, EOFError) as e:
                    yield pd.DataFrame({"path": [name], "frame_idx": [None], "t": [None], "energy": [None], "silence": [None], "error": [str(e)]})

    return files.mapInPandas(run, "path string, frame_idx long, t double, energy double, silence boolean, error string")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest by suffix: CSV with header, a JSON list, or JSON lines."""
    if path.endswith(".csv"):
        return spark.read.schema(MANIFEST).csv(path, header=True)
    return spark.read.schema(MANIFEST).json(path, multiLine=path.endswith(".json"))


def merge_parts(spark: SparkSession, paths: list[str], least: int = 3) -> DataFrame:
    """Part files as one table; a missing part or too few rows is an error."""
    df = spark.read.schema(MANIFEST).json(paths)
    if df.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows")
    return df


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Gold and predicted coverage of slides."""
    return spark.read.schema(PAIRS).json(path, multiLine=True)


def write_jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def write_reports(df: DataFrame, path: str) -> None:
    """One JSON object a report."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path)


class Upsert:
    """A keyed table of latest rows in versioned folders. One writer.

    The current version is the greatest whose write ended, which the success mark in
    its folder says; a crash at any point leaves the version before as it was. The
    current and the previous version stay, for readers that have just begun.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, seq: str):
        self.spark, self.path, self.schema, self.key, self.seq = spark, path.rstrip("/"), schema, key, seq

    def _folders(self) -> list[tuple[int, int]]:
        """(version, last batch that it holds or -1) of folders that are whole, ascending."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*/_SUCCESS")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getParent().getName()[1:].split("-", 1) for x in fs.globStatus(root) or []]
        return sorted((int(x[0]), int(x[1]) if len(x) > 1 else -1) for x in names)

    def _versions(self) -> list[int]:
        return [v for v, _ in self._folders()]

    def _at(self, version: int, batch: int) -> str:
        return f"{self.path}/v{version}" + (f"-{batch}" if batch >= 0 else "")

    def _drop(self, version: int, batch: int) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(version, batch))
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def read(self) -> DataFrame:
        v = self._folders()
        return self.spark.read.schema(self.schema).parquet(self._at(*v[-1])) if v else self.spark.createDataFrame([], self.schema)

    def holds(self, batch: int) -> bool:
        """Whether a merge with this batch's number, or a later one's, is part of the table."""
        v = self._folders()
        return bool(v) and v[-1][1] >= batch

    def merge(self, rows: DataFrame, batch: int = -1) -> None:
        """Keep each key's row of the greatest seq; merging the same rows again changes nothing. The batch's number stays with the version."""
        from rostrum.operators.prepare import latest

        before, old = self._folders(), self.read()
        new = latest(old.unionByName(rows.select(*old.columns)), self.key, self.seq).select(*old.columns)
        version, last = before[-1] if before else (0, -1)
        new.write.mode("overwrite").parquet(self._at(version + 1, max(last, batch)))
        for v in before[:-1]:
            self._drop(*v)
