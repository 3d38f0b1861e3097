"""Words to chunks, sentences to pieces, and where titles are said."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# When words part, and when chunks are too short.
PAUSE_MS, MOST_MS, MOST_WORDS = 900, 8000, 36
SHORT_MS, SHORT_WORDS, EDGE_MS = 2000, 3, 2000


def by_pause(words: DataFrame, pause_ms: int = PAUSE_MS) -> DataFrame:
    """Chunks between pauses: gaps and islands."""
    w = Window.partitionBy("session_id").orderBy("word_idx")
    gap = (F.col("start_ms") - F.lag("end_ms").over(w) >= pause_ms).cast("int")
    x = words.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("chunk", F.sum("gap").over(w))
    return x.groupBy("session_id", "chunk").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"))


def sentence_buckets(words: DataFrame) -> DataFrame:
    """Words with the number of their sentence (bucket, from 0): a word that ends with .!?… or 。, quotes behind it or not, is its last."""
    ends = F.col("word").rlike(r"[.!?…。][\"'”’)\]]*$").cast("int")
    w = Window.partitionBy("session_id").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)
    return words.withColumn("bucket", F.coalesce(F.sum(ends).over(w), F.lit(0)))


def chunks(words: DataFrame, by_sentence: bool = False) -> DataFrame:
    """Chunks by pause, duration and number of words; then short ones join the one before, and short ends their neighbours.

    The last two limits start afresh at each cut, so a talk's words are folded in
    order; a talk is one row meanwhile, of some thousand words. With by_sentence,
    chunks also end with their sentence before short ones are joined.
    """
    words = sentence_buckets(words) if by_sentence else words.withColumn("bucket", F.lit(0))
    talk = words.groupBy("session_id", "bucket").agg(F.array_sort(F.collect_list(F.struct("word_idx", F.col("start_ms").cast("long").alias("a"), F.col("end_ms").cast("long").alias("b")))).alias("w"))
    none = F.array().cast("array<struct<a:bigint,b:bigint,n:bigint>>")
    chunk = lambda a, b, n: F.struct(a.alias("a"), b.alias("b"), n.cast("long").alias("n"))
    but_last = lambda x: F.slice(x, F.lit(1), F.size(x) - 1)

    def add(done, w):
        c = F.element_at(done, -1)
        new = (w["a"] - c["b"] >= PAUSE_MS) | (c["b"] - c["a"] >= MOST_MS) | (c["n"] >= MOST_WORDS)
        one = F.array(chunk(w["a"], w["b"], F.lit(1)))
        return F.when(F.size(done) == 0, one).when(new, F.concat(done, one)).otherwise(F.concat(but_last(done), F.array(chunk(c["a"], w["b"], c["n"] + 1))))

    def join(done, x):
        c = F.element_at(done, -1)
        short = ((x["b"] - x["a"] < SHORT_MS) | (x["n"] < SHORT_WORDS)) & (c["b"] - c["a"] < 1.5 * MOST_MS)
        return F.when((F.size(done) == 0) | ~short, F.concat(done, F.array(x))).otherwise(F.concat(but_last(done), F.array(chunk(c["a"], x["b"], c["n"] + x["n"]))))

    c = talk.withColumn("c", F.aggregate("w", none, add)).groupBy("session_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "c"))), lambda x: x["c"])).alias("c"))
    c = c.withColumn("c", F.aggregate("c", none, join))
    one, two = F.element_at("c", 1), F.element_at("c", 2)
    brief = lambda x: x["b"] - x["a"] < EDGE_MS
    c = c.withColumn("c", F.when((F.size("c") > 1) & brief(one), F.concat(F.array(chunk(one["a"], two["b"], one["n"] + two["n"])), F.slice("c", F.lit(3), F.greatest(F.size("c") - 2, F.lit(0))))).otherwise(F.col("c")))
    last, prev = F.element_at("c", -1), F.element_at("c", -2)
    c = c.withColumn("c", F.when((F.size("c") > 1) & brief(last), F.concat(F.slice("c", F.lit(1), F.greatest(F.size("c") - 2, F.lit(0))), F.array(chunk(prev["a"], last["b"], prev["n"] + last["n"])))).otherwise(F.col("c")))
    return c.select("session_id", F.posexplode("c").alias("unit_id", "x")).select("session_id", "unit_id", F.col("x.a").alias("start_ms"), F.col("x.b").alias("end_ms"), F.col("x.n").alias("n_words"))


def pack_sentences(rows: DataFrame, longest: int = 120) -> DataFrame:
    """Sentences (after .!?… or a newline) in pieces of at most so many characters, spaces between them not counted."""
    s = F.filter(F.transform(F.split("text", r"(?<=[.!?…。])\s+|\n+"), F.trim), lambda x: x != "")

    def add(done, x):
        c = F.element_at(done, -1)
        # the length counts the sentences only
        fits = c["n"] + F.char_length(x) <= longest
        one = F.array(F.struct(x.alias("t"), F.char_length(x).alias("n")))
        more = F.array(F.struct(F.concat(c["t"], F.lit(" "), x).alias("t"), (c["n"] + F.char_length(x)).alias("n")))
        return F.when((F.size(done) == 0) | ~fits, F.concat(done, one)).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), more))

    p = rows.withColumn("p", F.aggregate(s, F.array().cast("array<struct<t:string,n:int>>"), add))
    return p.select("session_id", "slide_id", F.posexplode("p").alias("chunk_idx", "x")).select("session_id", "slide_id", "chunk_idx", F.col("x.t").alias("text"))


def cues(words: DataFrame, titles: DataFrame, within: int = 6, least: int = 2) -> DataFrame:
    """From titles (session, slide, tokens): start of the first stretch of words that has enough of a title's tokens."""
    # tokens are looked up by (session, token); a stretch has enough of them if that many different ones end within it
    want = titles.select("session_id", "slide_id", F.explode(F.array_distinct("tokens")).alias("token"))
    hits = words.select("session_id", F.lower("word").alias("token"), "word_idx").join(want, ["session_id", "token"])
    near = F.collect_set("token").over(Window.partitionBy("session_id", "slide_id").orderBy("word_idx").rangeBetween(1 - within, 0))
    last = hits.withColumn("n", F.size(near)).where(F.col("n") >= least).groupBy("session_id", "slide_id").agg(F.min("word_idx").alias("last"))
    # the first stretch that holds them begins within - 1 words before the last of them, or with the talk
    first = words.groupBy("session_id").agg(F.min("word_idx").alias("first"))
    at = last.join(first, "session_id").select("session_id", "slide_id", F.greatest("first", F.col("last") - (within - 1)).alias("word_idx"))
    return at.join(words.select("session_id", "word_idx", "start_ms"), ["session_id", "word_idx"]).select("session_id", "slide_id", "start_ms")


def refine(bounds: DataFrame, assigned: DataFrame, unit_words: DataFrame, titles: DataFrame, least_sec: float = 1.0, units: int = 4, within: int = 6, intro: str = "소개") -> DataFrame:
    """Boundaries moved to where the next slide's title is said.

    bounds: (session, b), starts of all slides and the end; assigned: (session, unit_id,
    slide_id, start_sec); unit_words: (session, unit_id, word_idx, token, start_sec), tokens lower-case;
    titles: (session, slide_id, title, tokens in order). A slide's boundary unit is the first on it
    or a later one. Within its run, the first `units` units are searched for the title's first token
    with the second among `within` words of the unit; a title with `intro` is also met by its first token alone. The start found
    replaces the boundary if it is least_sec behind the unit's start, between the slide's
    neighbours; a talk of more than two slides keeps its last boundary.
    """
    w = Window.partitionBy("session_id").orderBy("unit_id")
    a = assigned.withColumn("new", F.coalesce((F.col("slide_id") != F.lag("slide_id").over(w)).cast("int"), F.lit(0)))
    a = a.withColumn("run", F.sum("new").over(w)).select("session_id", "unit_id", F.col("slide_id").alias("on"), "start_sec", "run", F.row_number().over(w).alias("nth"))
    want = titles.withColumn("tokens", F.slice(F.array_distinct("tokens"), 1, 2)).where((F.size("tokens") > 0) & (F.col("slide_id") > 1))
    # the first unit on this slide or a later one, then the units of its run that are searched
    first = want.select("session_id", "slide_id").join(a, "session_id").where("on >= slide_id").groupBy("session_id", "slide_id").agg(F.min(F.struct("nth", "run", "start_sec")).alias("f"))
    near = first.join(a.select("session_id", "unit_id", "run", "nth"), "session_id").where((F.col("run") == F.col("f.run")) & F.col("nth").between(F.col("f.nth"), F.col("f.nth") + units - 1))
    ahead = F.collect_list("token").over(Window.partitionBy("session_id", "unit_id").orderBy("word_idx").rowsBetween(0, within - 1))
    said = unit_words.select("session_id", "unit_id", "word_idx", "token", F.col("start_sec").alias("at"), ahead.alias("ahead"))
    hit = near.join(said, ["session_id", "unit_id"]).join(want, ["session_id", "slide_id"]).where(F.col("token") == F.col("tokens")[0])
    whole = F.size(F.array_except("tokens", "ahead")) == 0
    place = F.struct("nth", "word_idx", "at")
    cue = hit.groupBy("session_id", "slide_id").agg(F.min(F.when(whole, place)).alias("c"), F.min(F.when(F.col("title").contains(intro), place)).alias("d"), F.first("f.start_sec").alias("unit_start"))
    cue = cue.select("session_id", "slide_id", F.coalesce("c.at", "d.at").alias("cue"), "unit_start").where(F.col("cue") - F.col("unit_start") >= least_sec)
    moved = cue.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("slide_id", "cue"))).alias("m"))
    j = bounds.join(moved, "session_id", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,double>")))
    n = F.size("b") - 1
    last = F.when(n <= 2, n).otherwise(n - 1)

    def step(done, k):
        old = F.element_at("b", k)
        cue = F.try_element_at("m", k)
        to = F.when((k <= last) & (k > 1) & cue.isNotNull(), F.least(F.greatest(cue, F.element_at(done, -1)), F.element_at("b", F.least(k + 1, F.size("b"))))).otherwise(old)
        return F.concat(done, F.array(F.when(k == 1, old).otherwise(F.greatest(to, F.element_at(done, -1)))))

    first_one = F.slice("b", 1, 1)
    out = F.aggregate(F.filter(F.sequence(F.lit(1), F.size("b")), lambda k: k > 1), first_one, step)
    return j.select("session_id", out.alias("b"))
