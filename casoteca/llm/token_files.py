"""Token files: concatenated ids with Elias-Fano coded document boundaries."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casoteca.llm.text import SPACED, parts, text_bytes
from casoteca.llm.units import Known, cut, distinct, spread, unit_texts

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint16)


class EliasFano:
    """A non-decreasing sequence of n numbers below u in about 2 + log2(u/n) bits each.

    The low bits are packed; the high bits are a unary bit vector. ``select``
    finds the i-th number from one 32-bit count for every 64 bytes of that
    vector, so there is no table of offsets.
    """

    STRIDE = 64

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, counts: bytes):
        self.n, self.low_bits, self.low, self.high, self.counts = n, low_bits, low, high, counts

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if n and (values[0] < 0 or (np.diff(values) < 0).any()):
            raise ValueError("the sequence must not decrease")
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(bits)
        low = np.packbits((values[:, None] >> shifts & 1).astype(np.uint8).ravel())
        unary = np.zeros((top >> bits) + n, np.uint8)
        unary[(values >> bits) + np.arange(n)] = 1
        high = np.packbits(unary)
        per_byte = _ONES[high].astype(np.uint32)
        counts = np.concatenate(([0], np.cumsum(per_byte)))[:-1:cls.STRIDE].astype("<u4") \
            if len(high) else np.zeros(0, "<u4")
        return cls(n, bits, low.tobytes(), high.tobytes(), counts.tobytes())

    def select(self, which: np.ndarray) -> np.ndarray:
        """The numbers at the given ranks."""
        which = np.asarray(which, np.int64)
        if not len(which):
            return np.zeros(0, np.int64)
        counts = np.frombuffer(self.counts, "<u4")
        high = np.frombuffer(self.high, np.uint8)
        block = np.searchsorted(counts, which, side="right") - 1
        out = np.empty(len(which), np.int64)
        for b in np.unique(block):
            mine = block == b
            piece = high[b * self.STRIDE:(b + 1) * self.STRIDE]
            ones = np.flatnonzero(np.unpackbits(piece))
            out[mine] = b * self.STRIDE * 8 + ones[which[mine] - int(counts[b])]
        out -= which
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8))
            at = which[:, None] * self.low_bits + np.arange(self.low_bits)
            out = out << self.low_bits | (bits[at].astype(np.int64) << np.arange(self.low_bits)).sum(1)
        return out


def _joined() -> np.ndarray:
    """Cuts before white space that follows a byte which surely ends no white space.

    The splitting pattern of byte-level tokenizers never joins a character with
    white space after it. Wide characters may be white space themselves, so
    after them only two-byte characters beyond U+00BF count (see ``encode``).
    """
    joined = np.ones((256, 256), bool)
    before = SPACED & (np.arange(256) < 0x80)
    joined[np.ix_(before, ~SPACED)] = False
    return joined


_JOINED = _joined()


class Encoder:
    """Ids of texts by a tokenizer file; each distinct unit is encoded once."""

    def __init__(self, path: str, limit: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(limit, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        start = cut(data, offsets, _JOINED)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        wide = np.flatnonzero(~SPACED[data[2:]] & (data[1:-1] >= 0x80) & (data[:-2] >= 0xC3)
                              & (data[:-2] <= 0xDF)) + 2
        wide = wide[np.searchsorted(offsets, wide, "right")
                    == np.searchsorted(offsets, wide - 2, "right")]
        begins = np.zeros(len(data), bool)
        begins[start] = begins[wide] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        keys, where, which = distinct(data, start, end)

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            texts = unit_texts(data, start[where[new]], end[where[new]])
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum())), sizes

        begin, size = self.known.look_up(keys, make)
        n = np.concatenate(([0], np.cumsum(size[which])))
        first = np.searchsorted(start, offsets)
        return spread(self.known.values, begin, size, which), n[first[1:]] - n[first[:-1]]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """The encoder of this worker process; tasks that follow know the units of earlier ones."""
    return Encoder(path)


BLOCK_SCHEMA = ("shard int, block int, n_docs int, n_ids long, width int, ids binary, docs binary, "
                "low_bits int, low binary, high binary, counts binary")


def write_token_files(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 2,
                      id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, write blocks in ascending document order.

    A shard is one range of document ids; its blocks hold the little-endian ids
    of about 3 MB of text (2 bytes an id while the vocabulary allows), the document
    ids, and the Elias-Fano coded ends of the documents. NULL and empty texts
    hold ``end_id`` alone. Rows without an id come first; rows that share an id (or have none) are kept, ordered
    by text, NULL first. Returns the blocks as read back.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = _encoder(tokenizer), TaskContext.get().partitionId()
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for block, part in enumerate(parts(batches)):
            data, offsets = text_bytes(part["text"])
            ids, sizes = encoder.encode(data, offsets)
            ends = np.cumsum(sizes + 1)
            out = np.full(int(ends[-1]), end_id, f"<u{width}")
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep] = ids
            coded = EliasFano.encode(ends)
            docs = part["id"].cast(pa.int64()).fill_null(-1 << 63).to_numpy()
            row = [shard, block, len(docs), len(out), width, out.tobytes(),
                   docs.astype("<i8").tobytes(), coded.low_bits, coded.low, coded.high, coded.counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES)], _BLOCK_NAMES)

    rows = documents.select(F.col(id_column).cast("long").alias("id"),
                            F.col(text_column).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(encode, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(folder)
    return documents.sparkSession.read.schema(BLOCK_SCHEMA).parquet(folder)


_BLOCK_NAMES = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
_BLOCK_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]
                for x in BLOCK_SCHEMA.split(", ")]


def read_token_files(blocks: DataFrame) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                docs = np.frombuffer(row["docs"], "<i8")
                coded = EliasFano(len(docs), row["low_bits"], row["low"], row["high"], row["counts"])
                ends = coded.select(np.arange(len(docs)))
                begins = np.concatenate(([0], ends[:-1]))
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, mask=docs == -1 << 63), pa.array(begins), pa.array(ends - begins),
                     pa.array(crc, pa.int64()), pa.array(np.full(len(docs), row["shard"], np.int32)),
                     pa.array(np.full(len(docs), row["block"], np.int32))],
                    ["doc_id", "inside", "n_tokens", "ids_crc32", "shard", "block"])

    docs = blocks.mapInArrow(decode, "doc_id long, inside long, n_tokens long, ids_crc32 long, "
                                     "shard int, block int")
    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("shard_ids").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("ahead", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))) \
        .join(shards, "shard").select("shard", "block", (F.col("base") + F.col("ahead")).alias("base"))
    return docs.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
