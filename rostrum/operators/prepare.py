"""Training rows: targets, normalisation, rejects, splits, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.score import clamp, overall_delivery
from rostrum.plans import scratch


#: Fixed value: characters of an error that a status keeps.
ERROR_LENGTH = 500


def error_text(x: Column) -> Column:
    return F.left(x, F.lit(ERROR_LENGTH))


def speech_rate(words: Column, millis: Column) -> Column:
    return words / F.greatest(F.lit(1e-6), millis / 1000.0)


def fallback_silence(rate: Column) -> Column:
    """Silence guessed from pace where there is no audio."""
    return clamp(0.45 - 0.08 * rate, 0.05, 0.6)


def audio_name(path: Column, label_file: Column) -> Column:
    """The audio file of a label: its path's last part, else named after the label file."""
    base = F.element_at(F.split(path, "/"), -1)
    other = F.replace(F.replace(F.element_at(F.split(label_file, "/"), -1), F.lit("_d_"), F.lit("_a_")), F.lit(".json"), F.lit(".wav"))
    return F.coalesce(F.when(base != "", base), other)


def audio_targets(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Per clip: share of frames 40 dB below the loudest, whether energy falls, whether pitch wanders."""
    top = F.max("energy").over(Window.partitionBy(*keys))
    f = frames.withColumn("quiet", (F.col("energy") < top - 40).cast("double"))
    voiced = F.when(F.col("pitch") > 0, F.col("pitch"))
    g = f.groupBy(*keys).agg(F.avg("quiet").alias("silence_ratio"), F.when(F.stddev_pop("t") > 0, F.regr_slope("energy", "t")).alias("slope"), F.stddev_pop(voiced).alias("sd"), F.count(voiced).alias("n"))
    return g.select(*keys, "silence_ratio", (F.coalesce(F.col("slope"), F.lit(0.0)) < -0.02).cast("int").alias("energy_drop"), ((F.coalesce("sd", F.lit(0.0)) > 80) & (F.col("n") > 10)).cast("int").alias("pitch_shift"))


def targets(rows: DataFrame) -> DataFrame:
    """Rows with the overall delivery target."""
    return rows.withColumn("overall_delivery", overall_delivery(F.col("speech_rate"), F.col("silence_ratio"), F.col("energy_drop"), F.col("pitch_shift")))


def binary(x: Column) -> Column:
    """0/1 from numbers (half or more) and words; null for anything else."""
    t = F.lower(F.trim(x.cast("string")))
    n = F.try_to_number(t, F.lit("999999.999999")).cast("double")
    return F.when(t.isin("true", "yes", "y", "on"), 1).when(t.isin("false", "no", "n", "off", ""), 0).when(n.isNotNull(), (n >= 0.5).cast("int"))


def match_audio(labels: DataFrame, audio: DataFrame) -> DataFrame:
    """Labels with why they are rejected: bad duration, or no such audio. One left join gives both outputs."""
    have = audio.groupBy("audio_name").agg(F.min("path").alias("path"))
    j = labels.join(have, "audio_name", "left")
    return j.withColumn("reason", F.when(F.col("duration_ms") <= 0, "bad_duration").when(F.col("path").isNull(), "filtered_missing_audio"))


def rejects(rows: DataFrame, samples: int = 5) -> DataFrame:
    """Counts per reason with the first few examples."""
    r = rows.where(F.col("reason").isNotNull())
    n = r.groupBy("reason").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("reason").orderBy("audio_name"))
    # ranking within each part first, so no reason's rows meet in one task
    part = F.pmod(F.xxhash64("audio_name"), F.lit(64))
    few = r.withColumn("p", part).withColumn("k", F.row_number().over(Window.partitionBy("reason", "p").orderBy("audio_name"))).where(F.col("k") <= samples)
    few = few.withColumn("k", k).where(F.col("k") <= samples).groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("audio_name")), ",").alias("samples"))
    return n.join(few, "reason")


def split_sizes(n: int, train: float, valid: float, force_test: bool = False) -> tuple[int, int, int]:
    """Rows of train, valid and test; train and valid have at least one."""
    if n < 3:
        raise ValueError("a split needs three rows")
    a, b = max(1, int(n * train)), max(1, int(n * valid))
    if a + b >= n:
        b = max(1, n - a - 1)
    if force_test and a + b >= n:
        a, b = (a - 1, b) if a > 1 else (a, b - 1)
    return a, b, max(0, n - a - b)


def _hash(key: str, seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key), F.lit(str(seed))).cast("binary")), 1, 15), 16, 10).cast("long")


def _cut(hashes: DataFrame, want: int) -> int:
    """The want-th least of 60-bit hashes (column h), by counts of buckets, refined in the boundary bucket only."""
    prefix, before = 0, 0
    for low in range(0, 60, 12):
        cells = hashes.where(F.shiftright("h", 60 - low) == prefix).groupBy(F.shiftright("h", 48 - low).alias("c")).agg(F.count("*").alias("n"), F.min("h").alias("a"), F.max("h").alias("b"))
        for r in cells.sort("c").collect():  # at most 4096 rows
            if before + r.n >= want:
                break
            before += r.n
        prefix = r.c
        if r.a == r.b:
            break
    return r.b


def _parted(rows: DataFrame, key: str, seed: int, sizes, names) -> DataFrame:
    """rows with a column `split`: the first name for the sizes(n)[0] least hashes, and so on; the last for the rest."""
    hashes = scratch.keep(rows.select(_hash(key, seed).alias("h")), "hashes")
    wanted, total = sizes(hashes.count()), 0
    part = F.lit(names[-1])
    cuts = []
    for n, name in zip(wanted, names, strict=False):
        total += n
        cuts.append((_cut(hashes, total), name))
    scratch.drop(hashes)
    for cut, name in reversed(cuts):
        part = F.when(_hash(key, seed) <= cut, name).otherwise(part)
    return rows.withColumn("split", part)


def split(rows: DataFrame, key: str, train: float = 0.9, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """Seeded split in three with exact sizes: keys in the order of a hash, cut where the sizes end. No row is sorted."""
    return _parted(rows, key, seed, lambda n: split_sizes(n, train, valid)[:2], ("train", "valid", "test"))


def split_two(rows: DataFrame, key: str, train: float = 0.9, seed: int = 42) -> DataFrame:
    """Seeded split in train and valid, at least a row each; fewer than two rows are an error."""

    def sizes(n: int) -> tuple[int]:
        if n < 2:
            raise ValueError("a split needs two rows")
        return (min(max(1, int(n * train)), n - 1),)

    return _parted(rows, key, seed, sizes, ("train", "valid"))


def subset(rows: DataFrame, key: str, most: int, train: float = 0.9, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """At most so many rows, the least by the hash, split in three with a row of test at least."""

    def sizes(n: int) -> tuple[int, int, int]:
        return split_sizes(min(n, most), train, valid, force_test=True)

    return _parted(rows, key, seed, sizes, ("train", "valid", "test", "")).where("split <> ''")


def resume(rows: DataFrame, done: DataFrame, key: str = "audio_path") -> DataFrame:
    """Rows not yet in the committed output."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def latest(events: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The last event of each key: what an upsert by key leaves."""
    return events.groupBy(key).agg(F.max(F.struct(seq, *[c for c in events.columns if c not in (key, seq)])).alias("x")).select(key, "x.*")


def chunks(segments: DataFrame, longest: float = 25.0, least: float = 1.0) -> DataFrame:
    """Segments (lo, hi in seconds) in stretches of at most `longest`; a rest shorter than `least` joins the one before."""
    d = F.col("hi") - F.col("lo")
    full = F.floor(d / longest).cast("int")
    rest = d - full * longest
    n = F.greatest(F.lit(1), full + F.when(rest >= least, 1).otherwise(0))
    k = segments.where(d > 0).withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return k.withColumn("c_lo", F.col("lo") + F.col("i") * longest).withColumn("c_hi", F.when(F.col("i") == F.col("n") - 1, F.col("hi")).otherwise(F.col("c_lo") + longest)).drop("n")


def pairs(boundaries: DataFrame) -> DataFrame:
    """Segments between neighbouring boundaries; fewer than two give none."""
    n = F.size("b")
    z = F.arrays_zip(F.slice("b", 1, F.greatest(n - 1, F.lit(0))).alias("lo"), F.slice("b", 2, F.greatest(n - 1, F.lit(0))).alias("hi"))
    p = boundaries.where(n >= 2).select("session_id", F.posexplode(z).alias("i", "z"))
    return p.select("session_id", (F.col("i") + 1).alias("slide_id"), F.col("z.lo").alias("lo"), F.col("z.hi").alias("hi"))


def manual_boundaries(rows: DataFrame) -> DataFrame:
    """Given times (array b), slide count, first and last word: n+1 boundaries, and what was done.

    n+1 given times are kept, more are cut, n get the talk's start before or its end
    behind; anything else is an error row.
    """
    s = F.array_sort(F.array_distinct("b"))
    n, k = F.col("n_slides"), F.size(s)
    prepend = F.element_at(s, 1) > F.col("first")
    out = F.when(k == n + 1, s).when(k > n + 1, F.slice(s, F.lit(1), n + 1)).when((k == n) & prepend, F.concat(F.array("first"), s)).when(k == n, F.concat(s, F.array("last")))
    note = F.when(k == n + 1, "").when(k > n + 1, "truncated_extra_boundaries").when((k == n) & prepend, "prepended_transcript_start").when(k == n, "appended_transcript_end").otherwise("error_boundary_count")
    return rows.select("session_id", out.alias("b"), note.alias("note"))


def label_rows(labels: DataFrame, audio: DataFrame) -> DataFrame:
    """Labels (audio_name, n_words, duration_ms) with the targets of their audio, guessed from pace where there is none."""
    rate = speech_rate(F.col("n_words"), F.col("duration_ms"))
    j = labels.where(F.col("duration_ms") > 0).join(audio.withColumn("from_audio", F.lit(True)), "audio_name", "left")
    own = F.coalesce("from_audio", F.lit(False))
    rows = j.select("audio_name", rate.alias("speech_rate"), F.when(own, F.col("silence_ratio")).otherwise(fallback_silence(rate)).alias("silence_ratio"), *[F.when(own, F.col(c)).otherwise(0).alias(c) for c in ("energy_drop", "pitch_shift")], own.alias("from_audio"))
    return targets(rows)


def clip_segments(clips: DataFrame, boundaries: list[float] | None = None, chunk_sec: float = 0.0) -> DataFrame:
    """Every clip (audio_path, duration_sec) of a listing with one row for each given segment, cut to the clip; without boundaries its first chunk_sec seconds, or all of it.

    Fewer than two boundaries are an error; segments behind a clip's end go.
    """
    if boundaries is not None:
        if len(boundaries) < 2:
            raise ValueError("at least two boundaries are needed")
        spans = F.array(*[F.struct(F.lit(i + 1).alias("slide_id"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for i, (a, b) in enumerate(zip(boundaries, boundaries[1:], strict=False))])
    else:
        end = F.col("duration_sec").cast("double") if chunk_sec <= 0 else F.least(F.col("duration_sec").cast("double"), F.lit(float(chunk_sec)))
        spans = F.array(F.struct(F.lit(1).alias("slide_id"), F.lit(0.0).alias("lo"), end.alias("hi")))
    s = clips.select("audio_path", F.col("duration_sec").alias("d"), F.explode(spans).alias("s"))
    s = s.select("audio_path", "s.slide_id", F.greatest(F.lit(0.0), F.col("s.lo")).alias("start_sec"), F.least(F.col("d"), F.col("s.hi")).alias("end_sec"))
    return s.where("end_sec > start_sec")


def normalise(rows: DataFrame, numbers: list[str], flags: list[str], path: str = "audio_path", prefix: str = "") -> DataFrame:
    """Typed rows with a `reason` where a field is missing or no number; paths get the prefix unless they are absolute or have a scheme."""
    missing = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"missing_{c}") for c in (path, *numbers, *flags)]
    bad = [F.when(F.expr(f"try_cast(`{c}` AS double)").isNull(), f"invalid_{c}") for c in numbers] + [F.when(binary(F.col(c)).isNull(), f"invalid_{c}") for c in flags]
    full = F.when(F.col(path).rlike(r"^(/|[a-z0-9]+://)"), F.col(path)).otherwise(F.concat(F.lit(prefix), F.col(path)))
    return rows.select(full.alias(path), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in numbers], *[binary(F.col(c)).alias(c) for c in flags], F.coalesce(*missing, *bad).alias("reason"))
