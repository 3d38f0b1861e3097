"""Token ids in compressed files: canonical length-limited Huffman blocks with checkpoints.

Texts are dealt by ranges of the document id (parts) and tokenised in order, once;
the plain ids wait in the shared folder. Their counts, summed over the whole table,
give the code; then documents that follow each other are encoded into
independent blocks. The file format is a folder with

* ``code``: one row, the code length of each id (a byte each);
* ``blocks``: a folder for each part, in ascending order of document ids, with
  Parquet rows (start, docs, lengths, bits, offsets, n): bits is the Huffman bit
  stream of n ids, offsets the bit offset of every 64th id, docs/lengths the
  documents of the block, and start counts the ids before the block in its part;
* ``parts``: for each part the number of ids before it.

A reader needs one block row to decode any document in it.
"""

from __future__ import annotations

import os
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import huffman
from rostrum.llm.bpe import byte_of_char
from rostrum.llm import batches as arrow
from rostrum.llm.memo import Memo
from rostrum.plans import scratch

# Fixed value: the pattern by which the tokenizer cuts a lower-cased text into the parts that it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

END = 2
#: A block closes with the document that reaches this many ids.
BLOCK = 1 << 16
#: Bytes of words, and of white-space-free chunks that are more than a word of ASCII letters, that a worker remembers.
KEPT_WORDS, KEPT_CHUNKS = 160 << 20, 64 << 20

_BLOCKS = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("docs", pa.binary()), ("lengths", pa.binary()), ("bits", pa.binary()), ("offsets", pa.binary()), ("n", pa.int32())])
_BLOCKS_SQL = "part int, start long, docs binary, lengths binary, bits binary, offsets binary, n int"
#: A null document id, in the blocks.
NO_ID = -(1 << 63)


class _Chunks:
    """Ids (as bytes) of chunks between ASCII white space; this tokenizer drops white space and never looks across it.

    The plain case, printable Latin text that needs no normalisation but lower case
    and holds no special token, is cut by the tokenizer's pattern; its parts go to the
    tokenizer's BPE model at once and are remembered. Any other chunk goes through the
    whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.bpe = self.tokenizer.model
        self.chars = {b: c for c, b in byte_of_char().items()}
        self.cut = regex.compile(PATTERN).findall
        #: first characters of special tokens, which may stand anywhere in a chunk
        self.starts = {t.content[:1].lower() for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.words = Memo(self._word, KEPT_WORDS)
        self.others = Memo(self._other, KEPT_CHUNKS)

    def all(self, chunks: Iterable[bytes]) -> list[bytes]:
        words, others, out = self.words, self.others, []
        for chunk in chunks:
            core = chunk.rstrip(b".,")
            if not core.isalpha():  # ASCII letters
                out.append(others[chunk])
            elif len(core) == len(chunk):
                out.append(words[core.lower()])
            else:
                out.append(words[core.lower()] + words[chunk[len(core) :]])
        return out

    def _other(self, chunk: bytes) -> bytes:
        core = chunk.rstrip(b".,")
        text = core.decode()
        low = text.lower()
        # Latin letters are lower-cased one by one, as in the library
        latin = core.isascii() or (text and max(text) < "\u0180" and len(low) == len(text) and unicodedata.is_normalized("NFC", text))
        if latin and text.isalpha():
            got = self.words[low.encode()]
            return got if len(core) == len(chunk) else got + self.words[chunk[len(core) :]]
        if latin and text.isprintable() and self.starts.isdisjoint(low):
            return b"".join([self.words[x.encode()] for x in self.cut(low + chunk[len(core) :].decode())])
        return self.whole(chunk.decode())

    def _word(self, word: bytes) -> bytes:
        mapped = word.decode() if word.isascii() else "".join(map(self.chars.__getitem__, word))
        t = self.bpe.tokenize(mapped)
        return struct.pack(f"<{len(t)}I", *[x.id for x in t])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(1)
def _chunks(path: str) -> _Chunks:
    return _Chunks(path)


def _ids(texts: pa.Array, vocabulary: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of binary texts as `kind`, each text's with the end id, and where each text's begin (and the last one's end).

    Each distinct chunk of these texts is looked up once.
    """
    chunks = pc.ascii_split_whitespace(texts.view(pa.string()))
    at = chunks.offsets.to_numpy()
    named = chunks.flatten().dictionary_encode()
    parts = _chunks(vocabulary).all(named.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False))
    parts.append(END.to_bytes(4, "little"))
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    ids = np.frombuffer(b"".join(parts), "<u4").astype(kind)
    first = np.cumsum(size) - size
    which = np.insert(named.indices.to_numpy(), at[1:] - at[0], len(parts) - 1)
    n = size[which]
    ends = np.r_[0, np.cumsum(n)]
    # a text's chunks, and the end id after them
    starts = ends[at - at[0] + np.arange(len(at))]
    return ids[np.repeat(first[which] - ends[:-1], n) + np.arange(ends[-1])], starts


_RAW = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
_RAW_SQL = "part int, id long, start long, ids binary"


def _tokenise(vocabulary: str, kind: str):
    """(part, id, text) of a part in order in; ids of `kind` out, with the number of ids before them in the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for b in batches:
            ids, at = _ids(b.column(2), vocabulary, kind)
            held = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((at * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at[:-1] + start, pa.int64()), held], schema=_RAW)
            start += len(ids)

    return run


def _count(kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=size)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(total[i], pa.int64())], names=["id", "n"])

    return run


def _encode(kind: str, lengths: np.ndarray):
    """Blocks of documents that follow each other in a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = huffman.Code(lengths)
        part, start, docs, sizes, held, n = 0, 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            bits, offsets = code.encode(np.frombuffer(b"".join(held), kind))
            row = [part, start, np.array(docs, "<i8").tobytes(), np.array(sizes, "<u4").tobytes(), bits, offsets.astype("<u4").tobytes(), n]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

        for b in batches:
            for p, d, at, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if n and (n >= BLOCK or p != part or at != start + n):
                    yield block()
                    docs, sizes, held, n = [], [], [], 0
                if not n:
                    part, start = p, at
                docs.append(NO_ID if d is None else d)
                held.append(ids)
                sizes.append(len(ids) // np.dtype(kind).itemsize)
                n += sizes[-1]
        if n:
            yield block()

    return run


def write(docs: DataFrame, to: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all texts to the folder `to`, null as empty, in ascending id order, null ids first.

    Ids must be long integers; rows that repeat one are written next to each other.
    An empty table writes an empty file set.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    arrow.bound(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = max(Tokenizer.from_file(vocabulary).get_vocab_size(), END + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    ranged = texts.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    raw = scratch.keep(ranged.select(F.spark_partition_id().alias("part"), "id", "text").mapInArrow(_tokenise(vocabulary, kind), _RAW_SQL), "ids")
    counts = np.zeros(size, np.int64)
    for r in raw.select("ids").mapInArrow(_count(kind, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n  # at most one row an id of the vocabulary
    lengths = huffman.code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{to}/code")
    blocks = raw.mapInArrow(_encode(kind, lengths), _BLOCKS_SQL)
    blocks.write.partitionBy("part").option("compression", "uncompressed").parquet(f"{to}/blocks")
    parts = _blocks(spark, to).groupBy("part").agg(F.sum("n").alias("n")).sort("part").collect()
    before, rows = 0, []
    for r in parts:  # one row a part
        rows.append((r.part, before))
        before += r.n
    spark.createDataFrame(rows, "part int, before long").coalesce(1).write.parquet(f"{to}/parts")
    scratch.drop(raw)


def _blocks(spark: SparkSession, source: str) -> DataFrame:
    return spark.read.schema(_BLOCKS_SQL).parquet(f"{source}/blocks")


def _decode(lengths: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = huffman.Code(np.frombuffer(lengths, np.uint8))
        for b in batches:
            for r in b.to_pylist():
                ids = code.decode(r["bits"], np.frombuffer(r["offsets"], "<u4"), r["n"]).astype("<u4")
                docs, sizes = np.frombuffer(r["docs"], "<i8"), np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                end = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64(), mask=docs == NO_ID),
                        pa.array(end - sizes + (r["start"] + r["before"]), pa.int64()),
                        pa.array([bytes(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), end.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["id", "start", "ids"],
                )

    return run


def read(spark: SparkSession, source: str) -> DataFrame:
    """One row per document of a folder that write() wrote: id, start, ids (little-endian 32-bit)."""
    lengths = spark.read.schema("lengths binary").parquet(f"{source}/code").first()
    parts = F.broadcast(spark.read.schema("part int, before long").parquet(f"{source}/parts"))
    blocks = _blocks(spark, source).join(parts, "part")
    return blocks.mapInArrow(_decode(bytes(lengths.lengths)), "id long, start long, ids binary")


def summary(spark: SparkSession, source: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of a folder that write() wrote: id, start, n_tokens, ids_crc32."""
    return read(spark, source).select(F.col("id").alias(id_col), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
