"""Captions of slides, made once for each content, resolution, model and prompt version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in the filter of known keys: 1 MB with their numbers; more keys than a few hundred thousand only make it less of a help.
WORDS = 1 << 16


def cache_key(content: Column, dpi: int, model: str, version: str) -> Column:
    """What a caption depends on, as one digest."""
    return F.sha2(F.concat_ws("\n", F.sha2(content.cast("binary"), 256), F.lit(str(dpi)), F.lit(model), F.lit(version)).cast("binary"), 256)


def _place(key: Column, words: int) -> tuple[Column, Column]:
    """The filter's word for a key, and the four bits in it that the key sets."""
    h = F.xxhash64(key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return F.pmod(h, F.lit(words).cast("long")).cast("int"), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def bloom(keys: DataFrame, column: str = "key", words: int = WORDS) -> DataFrame:
    """(word, bits): a blocked Bloom filter, summed up by bit_or before the shuffle; at most `words` rows whatever the number of keys."""
    word, bits = _place(F.col(column), words)
    return keys.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def unknown(rows: DataFrame, keys: DataFrame, column: str = "key", words: int = WORDS) -> DataFrame:
    """Rows whose key is not among the keys.

    The filter, bounded by its number of words and so broadcast, lets go what is surely new;
    only the rest is shuffled to meet the keys in an exact anti join.
    """
    word, bits = _place(F.col(column), words)
    known = F.broadcast(bloom(keys, column, words).withColumnsRenamed({"word": "_word", "bits": "_bits"}))
    x = rows.withColumns({"_w": word, "_b": bits}).join(known, F.col("_w") == F.col("_word"), "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(F.col("_b")) == F.col("_b"), F.lit(False))
    new = x.where(~maybe).select(*rows.columns)
    return new.unionByName(x.where(maybe).select(*rows.columns).join(keys.select(column).distinct(), column, "left_anti").select(*rows.columns))


def caption(pages: DataFrame, cache: DataFrame, work: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all pages with their caption, what was made now) from pages (key, content, ...) and the cache (key, caption).

    One page of each new content goes to work, which adds the column caption; keep stores what it made and
    gives it back as read, for the cache's table. A content whose caption came out null is tried again next time.
    """
    new = unknown(pages.where("key IS NOT NULL"), cache.where("caption IS NOT NULL"))
    made = keep(work(new.dropDuplicates(["key"])).select("key", "caption").where("caption IS NOT NULL"))
    every = cache.select("key", "caption").where("caption IS NOT NULL").unionByName(made)
    return pages.join(every, "key", "left"), made
