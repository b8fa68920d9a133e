"""Packing documents into sequences of a fixed length by bounded-space best fit.

Every partition keeps a fixed number of open windows.  A piece goes to the open
window it fills best; when none has room and all windows are in use, the
fullest is emitted.  Windows still open at the end of a partition are merged
with those of other partitions, group by group, level by level, so no task sees
more than a fixed number of them and none is padded for being at a partition's end.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .tokens import default_tokenizer, encoder

LENGTH, END_ID, OPEN_WINDOWS, MERGE_FAN_IN = 2048, 1, 64, 16
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean"


def _window(level: int, part: int, number: int) -> int:
    """A window's id: unique over merge levels, partitions and windows."""
    return level << 58 | part << 32 | number


class BestFit:
    """Open windows by the room left in them: at most ``limit`` at a time; ``put`` returns the window a piece went to, and closed ones."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit, self.rooms, self.next = length, limit, [], 0

    def put(self, size: int) -> tuple[int, int, list[int]]:
        """(window, offset of the piece in it, windows that this closed)."""
        if size == self.length:
            self.next += 1
            return self.next - 1, 0, [self.next - 1]
        k, closed = bisect_left(self.rooms, (size, -1)), []
        if k == len(self.rooms):
            if len(self.rooms) == self.limit:  # none fits: the fullest goes
                closed.append(self.rooms.pop(0)[1])
            room, window = self.length, self.next
            self.next += 1
        else:
            room, window = self.rooms.pop(k)
        if room == size:
            closed.append(window)
        else:
            insort(self.rooms, (room - size, window))
        return window, self.length - room, closed


def _packed(batches: Iterator[pd.DataFrame], path: str, length: int, end_id: int, limit: int) -> Iterator[pd.DataFrame]:
    """Pieces of one partition's documents; a window's pieces come out when it closes, those left open at the end."""
    part, fit, held = TaskContext.get().partitionId(), BestFit(length, limit), {}
    encode = encoder(path).encode

    def rows(out: list[tuple], is_open: bool) -> pd.DataFrame:
        d = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "w", "offset"])
        d["doc_id"] = d["doc_id"].astype("Int64")
        d["window"] = [_window(0, part, w) for w in d.pop("w")]
        d["open"] = is_open
        return d[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "open"]]

    for batch in batches:
        done: list[tuple] = []
        texts = [t if isinstance(t, str) else None for t in batch["text"]]
        doc_ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
        for k in range(0, len(texts), 256):
            ids, lens = encode(texts[k : k + 256])
            at = 0
            for doc, n in zip(doc_ids[k : k + 256], lens.tolist()):
                own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                for start in range(0, n + 1, length):
                    piece = own[start : start + length]
                    window, offset, closed = fit.put(len(piece))
                    held.setdefault(window, []).append((doc, start, len(piece), zlib.crc32(piece.tobytes()), n + 1, window, offset))
                    for w in closed:
                        done += held.pop(w)
        if done:
            yield rows(done, False)
    if held:
        yield rows([x for w in sorted(held) for x in held[w]], True)


def _merged(windows: pd.DataFrame, length: int, limit: int) -> Iterable[tuple[int, int, int]]:
    """For leftover windows (size each, in order): (target, offset in it, whether the target stays open)."""
    fit, placed, closed = BestFit(length, limit), [], set()
    for size in windows["size"].tolist():
        w, offset, over = fit.put(size)
        placed.append((w, offset))
        closed.update(over)
    return [(w, o, w not in closed) for w, o in placed]


def _merger(level: int, length: int, limit: int, fan_in: int):
    """The function that merges the leftover windows of one group of partitions."""

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("top", kind="stable").reset_index(drop=True)
        part, placed = int(g["part"].iloc[0]) // fan_in, _merged(g, length, limit)
        return pd.DataFrame({"top": g["top"], "target": [_window(level, part, w) for w, _, _ in placed], "moved": [o for _, o, _ in placed], "again": [a for _, _, a in placed]})

    return merge


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, open_windows: int = OPEN_WINDOWS, fan_in: int = MERGE_FAN_IN) -> DataFrame:
    """Packs the texts of ``docs`` (doc_id, text; other columns are ignored) into sequences of at most ``length`` tokens.

    A document's tokens are its ids by ``tokenizer`` and then ``end_id``; a null
    or empty text is that one id.  Documents longer than ``length`` are cut into
    full sequences and a rest.  Repeated rows are packed once each; an empty
    table gives an empty result.  Returns doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id and offset.
    """
    path = tokenizer or default_tokenizer()
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(pieces.mapInPandas(lambda it: _packed(it, path, length, end_id, open_windows), _PIECES))
    # leftover windows: one row each, merged level by level; what moves is their sizes, not their pieces
    left = pieces.where("open").groupBy("window").agg(F.sum("length").alias("size"))
    left = left.select("window", F.col("window").alias("top"), F.lit(0).cast("long").alias("shift"), "size", F.shiftright("window", 32).alias("part"))
    last, level, final = left.agg(F.max("part")).first()[0], 0, None
    while last is not None:
        level += 1
        last //= fan_in

        tops = left.select("top", "part", "size").distinct().withColumn("group", F.floor(F.col("part") / fan_in))
        plan = tops.groupBy("group").applyInPandas(_merger(level, length, open_windows, fan_in), "top long, target long, moved long, again boolean")
        left = stored(left.join(plan, "top").select("window", F.col("target").alias("top"), (F.col("shift") + F.col("moved")).alias("shift"), "size", "moved", F.floor(F.col("part") / fan_in).alias("part"), "again"))
        closed = (left if last == 0 else left.where("not again")).select("window", "top", "shift")
        final = closed if final is None else final.union(closed)
        if last == 0:
            break
        total = left.where("again").groupBy("top").agg(F.max(F.col("moved") + F.col("size")).alias("size"))
        left = left.where("again").drop("size").join(total, "top").select("window", "top", "shift", "size", "part")
    if final is not None:
        moved = pieces.where("open").join(final, "window").withColumn("offset", F.col("offset") + F.col("shift")).withColumn("window", F.col("top"))
        pieces = pieces.where("not open").union(moved.select(pieces.columns))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("window").alias("sequence_id"), "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
