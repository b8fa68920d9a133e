"""Token-id shards as wavelet matrices: access, counting and occurrence lookup on one compressed file.

Texts are dealt by ranges of doc_id; a shard is one range, in ascending doc_id
order, cut into segments of a bounded number of tokens.  A segment holds its
ids as a wavelet matrix: one bit-plane per id bit, most significant first; at
each level the ids with a 0 bit go, in order, before those with a 1 bit.  A
plane is stored as blocks, zstd-compressed one by one, behind a directory of
each block's place and of the ones before it.  ``rank`` and ``select`` tell from
it which id stands at a place (``access``), how often an id occurs up to a place
(``count``), and where its k-th occurrence is (``locate``): a plane costs one or
two blocks, which alone are decompressed.  A shard is one file, written by
Spark's Parquet writer with one row per segment, so it commits atomically and
can live in any store that Spark reads.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir
from .tokens import default_tokenizer, encoder

END_ID, SEGMENT_TOKENS, BLOCK_BYTES, BLOCKS_KEPT = 2, 2_000_000, 8192, 64
_MAGIC = b"WVM2"
_FILE = "shard long, segment long, doc_ids binary, n_tokens binary, total long, planes binary"


class WaveletMatrix:
    """A sequence of unsigned ids in its compressed form: bit-planes in blocks, with a directory of ranks."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix")
        self.data = data
        self.n, self.width = struct.unpack_from("<QB", data, 4)
        self.zeros = np.frombuffer(data, "<u8", self.width, 13).tolist()
        per = -(-self.n // (8 * BLOCK_BYTES)) + 1
        # of every plane: where its blocks begin (the last entry: where it ends), and the ones before them
        at = 13 + 8 * self.width
        self.places = np.frombuffer(data, "<u8", self.width * per, at).reshape(self.width, per).astype(np.int64)
        self.ones = np.frombuffer(data, "<u8", self.width * per, at + 8 * self.width * per).reshape(self.width, per).astype(np.int64)
        self._blocks: dict[tuple[int, int], np.ndarray] = {}
        self._plain = zstandard.ZstdDecompressor().decompress

    @staticmethod
    def build(ids: np.ndarray) -> bytes:
        """The compressed form of ids in order."""
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if width <= 16 else np.uint32)
        press = zstandard.ZstdCompressor(level=1).compress
        zeros, bodies, sizes, ones_before = [], [], [], []
        for bit in range(width - 1, -1, -1):
            ones = (now >> now.dtype.type(bit)).astype(np.uint8) & 1
            mask = ones.view(bool)
            plane = np.packbits(ones)
            blocks = [plane[i : i + BLOCK_BYTES] for i in range(0, len(plane), BLOCK_BYTES)]
            some = [press(b.tobytes()) for b in blocks]
            bodies += some
            sizes.append([len(x) for x in some])
            ones_before.append(np.cumsum([0, *(int(np.bitwise_count(b).sum(dtype=np.int64)) for b in blocks)]))
            rest = now[~mask]
            zeros.append(len(rest))
            now = np.concatenate([rest, now[mask]])
        per = len(ones_before[0])
        first = 13 + 8 * width + 16 * width * per
        ends = first + np.cumsum([x for plane in sizes for x in plane])
        begins = np.concatenate([[first], ends]).astype("<u8")
        places = np.stack([begins[k * (per - 1) : k * (per - 1) + per] for k in range(width)]).astype("<u8")
        head = _MAGIC + struct.pack("<QB", len(ids), width) + np.array(zeros, "<u8").tobytes()
        return b"".join([head, places.tobytes(), np.stack(ones_before).astype("<u8").tobytes(), *bodies])

    def _block(self, level: int, k: int) -> np.ndarray:
        """One block of a plane; the last ones used are kept."""
        if (level, k) not in self._blocks:
            if len(self._blocks) >= BLOCKS_KEPT:
                self._blocks.pop(next(iter(self._blocks)))
            lo, hi = self.places[level, k : k + 2].tolist()
            self._blocks[level, k] = np.frombuffer(self._plain(self.data[lo:hi]), np.uint8)
        return self._blocks[level, k]

    def decode(self) -> np.ndarray:
        """All ids in order, by undoing the levels from the last."""
        now = np.zeros(self.n, dtype=np.uint16 if self.width <= 16 else np.uint32)
        for bit, level in enumerate(range(self.width - 1, -1, -1)):
            blocks = [self._plain(self.data[lo:hi]) for lo, hi in zip(self.places[level, :-1].tolist(), self.places[level, 1:].tolist())]
            mask = np.unpackbits(np.frombuffer(b"".join(blocks), np.uint8), count=self.n).view(bool)
            out = np.empty_like(now)
            out[~mask] = now[: self.zeros[level]]
            out[mask] = now[self.zeros[level] :] | now.dtype.type(1 << bit)
            now = out
        return now

    def _rank(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a level."""
        k, rest = divmod(i, 8 * BLOCK_BYTES)
        ones = int(self.ones[level, k])
        if rest:
            block = self._block(level, k)
            ones += int(np.bitwise_count(block[: rest // 8]).sum(dtype=np.int64))
            ones += (int(block[rest // 8]) >> (8 - rest % 8)).bit_count() if rest % 8 else 0
        return ones

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that kind in a level."""
        ones = self.ones[level]
        before = ones if bit else np.minimum(np.arange(len(ones)) * 8 * BLOCK_BYTES, self.n) - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        start = 8 * BLOCK_BYTES * block
        bits = np.unpackbits(self._block(level, block), count=min(8 * BLOCK_BYTES, self.n - start))
        return start + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        out = 0
        for level, z in enumerate(self.zeros):
            k, rest = divmod(i, 8 * BLOCK_BYTES)
            bit = int(self._block(level, k)[rest // 8]) >> (7 - rest % 8) & 1
            ones = self._rank(level, i)
            i = z + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, value: int, upto: int) -> tuple[int, int]:
        """The range that an id's occurrences among the first ``upto`` places take after the last level."""
        lo, hi = 0, upto
        if value >> self.width:
            return 0, 0
        for level, z in enumerate(self.zeros):
            a, b = self._rank(level, lo), self._rank(level, hi)
            lo, hi = (z + a, z + b) if value >> (len(self.zeros) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, upto: int | None = None) -> int:
        """Occurrences of an id among the first ``upto`` places (all by default)."""
        lo, hi = self._range(value, self.n if upto is None else upto)
        return hi - lo

    def locate(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id; -1 if there are fewer."""
        lo, hi = self._range(value, self.n)
        if k >= hi - lo:
            return -1
        i = lo + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = value >> (len(self.zeros) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i


def _segments(batches: Iterator[pd.DataFrame], path: str, end_id: int, limit: int) -> Iterator[pd.DataFrame]:
    """File rows of one range of documents; a segment closes at ``limit`` tokens or where one document goes beyond."""
    shard, segment, encode = TaskContext.get().partitionId(), 0, encoder(path).encode
    ids: list[np.ndarray] = []
    docs: list = []
    lens: list[int] = []
    held = 0

    def row() -> pd.DataFrame:
        flat = np.concatenate(ids)
        known = np.array([d is not None for d in docs])
        packed = np.packbits(known).tobytes() + np.array([d or 0 for d in docs], dtype="<i8").tobytes()
        press = zstandard.ZstdCompressor(level=1).compress
        return pd.DataFrame({"shard": [shard], "segment": [segment], "doc_ids": [press(packed)], "n_tokens": [press(np.array(lens, dtype="<i8").tobytes())], "total": [len(flat)], "planes": [WaveletMatrix.build(flat)]})

    for batch in batches:
        texts = [t if isinstance(t, str) else None for t in batch["text"]]
        names = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
        for k in range(0, len(texts), 256):
            flat, sizes = encode(texts[k : k + 256])
            cuts = np.cumsum(sizes)
            flat = np.insert(flat, cuts, np.uint32(end_id))
            at = 0
            for name, n in zip(names[k : k + 256], (sizes + 1).tolist()):
                if held and held + n > limit:
                    yield row()
                    segment, held = segment + 1, 0
                    ids.clear(), docs.clear(), lens.clear()
                ids.append(flat[at : at + n])
                docs.append(name)
                lens.append(n)
                held, at = held + n, at + n
    if docs:
        yield row()


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Writes the texts of ``docs`` (doc_id, text; other columns are ignored) as token shards under ``path``.

    Null and empty texts are the end id alone.  Repeated rows are stored once
    each, next to each other; a null doc_id comes first.  An empty table writes no segment.
    """
    name = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ranged.mapInPandas(lambda it: _segments(it, name, end_id, segment_tokens), _FILE).write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    plain = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for shard, segment, names, sizes, data in zip(batch["shard"], batch["segment"], batch["doc_ids"], batch["n_tokens"], batch["planes"]):
            n = np.frombuffer(plain(sizes), dtype="<i8")
            packed = plain(names)
            known = np.unpackbits(np.frombuffer(packed[: -(-len(n) // 8)], np.uint8), count=len(n)).astype(bool)
            ids = WaveletMatrix(data).decode().astype("<u4")
            ends = np.cumsum(n)
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
            docs = pd.array(np.frombuffer(packed[-(-len(n) // 8) :], dtype="<i8"), dtype="Int64")
            docs[~known] = pd.NA
            yield pd.DataFrame({"doc_id": docs, "shard": shard, "segment": segment, "start": ends - n, "n_tokens": n, "ids_crc32": crc})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, shard and segment."""
    files = spark.read.schema(_FILE).parquet(path)
    # places: segments within their shard, then shards; the second window has one row for each shard
    from pyspark.sql.window import Window

    sizes = files.select("shard", "segment", "total")
    shards = sizes.groupBy("shard").agg(F.sum("total").alias("total"))
    shards = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("shard_base"))
    base = sizes.withColumn("base", F.sum("total").over(Window.partitionBy("shard").orderBy("segment")) - F.col("total"))
    base = base.join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("shard_base")).alias("base"))
    docs = files.mapInPandas(_documents, "doc_id long, shard long, segment long, start long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["shard", "segment"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment")


def lookup(spark: SparkSession, path: str, value: int) -> DataFrame:
    """How often an id occurs in every segment, and where first (-1: nowhere), answered on the bit-planes."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [WaveletMatrix(d) for d in b["planes"]]
            yield pd.DataFrame({"shard": b["shard"], "segment": b["segment"], "n": [m.count(value) for m in found], "first": [m.locate(value, 0) for m in found]})

    return spark.read.schema(_FILE).parquet(path).mapInPandas(ask, "shard long, segment long, n long, first long")


def token_at(spark: SparkSession, path: str, shard: int, segment: int, place: int) -> int | None:
    """The id at a place of a segment, read from its row alone; null where there is none."""
    row = spark.read.schema(_FILE).parquet(path).where((F.col("shard") == shard) & (F.col("segment") == segment)).select("planes").first()
    matrix = WaveletMatrix(bytes(row["planes"])) if row else None
    return matrix.access(place) if matrix and 0 <= place < matrix.n else None


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as wavelet-matrix shards and read back."""
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_documents(spark, path)
