"""Benchmark passages in documents, by Wu-Manber search for many patterns at once, over words.

The patterns are the word windows of all benchmark items.  A document's words
become numbers: that of an equal word of the patterns (bytes are compared), or 0.
For every length of pattern a table says how far the search may move when it
meets a block of two words: as far as the block's last place in any pattern lies
before the pattern's end, and past the block where no pattern has it.  Where it
may not move, the window's last and first words choose a bucket of patterns,
and these are compared word by word.  Texts are cut into many lanes that move at
the same time.

Patterns reach the workers in blocks of a bounded size, one block after the
other, so neither the driver nor a worker ever holds more than one block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

WINDOW = 10
#: (window, item) pairs and bytes of windows in a block of patterns, on average: it is what a worker holds.
BLOCK_PAIRS, BLOCK_BYTES = 200_000, 16 << 20
#: Bytes of text worked on at a time, words of a lane, windows compared at a time.
_PART, _LANE, _COMPARED = 1 << 20, 512, 100_000
#: A word's first bytes are held as numbers of eight bytes each; of longer words all bytes are compared one word at a time.
_HELD = 4
_FILLED = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOUND = "doc_id long, n_words long, n_hit long, hit_start array<long>, hit_end array<long>, items array<long>"


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The distinct (window, item_id) pairs of the items: ``width`` consecutive words, or all words of an item that has fewer."""
    words = F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit(_PATTERN), F.lit(0))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words.alias("w")).where("size(w) > 0")
    k = F.least(F.size("w"), F.lit(width))
    starts = rows.select("item_id", "w", k.alias("k"), F.explode(F.sequence(F.lit(1), F.size("w") - k + 1)).alias("at"))
    return starts.select(F.array_join(F.slice("w", F.col("at"), F.col("k")), " ").alias("window"), "item_id").distinct()


class _Words:
    """Words of a byte string: places, leading bytes as numbers, and a hash of all bytes."""

    def __init__(self, data: bytes, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.size = data, start, end - start
        some = np.ndarray(len(data) + 1, dtype="<u8", buffer=data + bytes(8), strides=(1,))
        eight = lambda at, k: some[np.minimum(start[at] + 8 * k, len(data))] & _FILLED[np.clip(self.size[at] - 8 * k, 0, 8)]
        self.more = np.flatnonzero(self.size > 8)
        self.head = eight(slice(None), 0)
        self.rest = np.stack([eight(self.more, k) for k in range(1, _HELD)], axis=1)
        self.within = np.zeros(len(start), dtype=np.int64)
        self.within[self.more] = np.arange(len(self.more))
        h = (self.head + self.size.astype(np.uint64)) * _MIX[0]
        for k in range(_HELD - 1):
            h[self.more] = (h[self.more] ^ (self.rest[:, k] * _MIX[k + 1])) * _MIX[0]
        h ^= h >> np.uint64(29)
        h *= _MIX[1]
        self.hash = h ^ (h >> np.uint64(32))
        for i in np.flatnonzero(self.size > 8 * _HELD).tolist():
            self.hash[i] = xxhash.xxh3_64_intdigest(self.word(i))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.size[i]]

    def same(self, i: np.ndarray, other: _Words, j: np.ndarray) -> np.ndarray:
        """Whether words ``i`` equal the words ``j`` of ``other``, byte by byte."""
        ok = (self.head[i] == other.head[j]) & (self.size[i] == other.size[j])
        more = np.flatnonzero(ok & (self.size[i] > 8))
        ok[more] = (self.rest[self.within[i[more]]] == other.rest[other.within[j[more]]]).all(axis=1)
        for k in np.flatnonzero(ok & (self.size[i] > 8 * _HELD)).tolist():
            ok[k] = self.word(i[k]) == other.word(j[k])
        return ok


def _edges(buf: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer in which texts begin at ``begins`` without a separator."""
    word = np.concatenate([[False], _WORD[buf], [False]])
    start, end = word[1:] & ~word[:-1], word[:-1] & ~word[1:]
    cut = begins[(begins > 0) & (begins < len(buf))]
    cut = cut[word[cut] & word[cut + 1]]  # one text's last word runs into the next one's first
    start[cut] = end[cut] = True
    return np.flatnonzero(start), np.flatnonzero(end)


class _Length:
    """Shift table and buckets of the patterns of one length."""

    def __init__(self, patterns: np.ndarray, number: np.ndarray):
        self.m = m = patterns.shape[1]
        self.block = min(2, m)
        self.bits = int(min(22, max(10, np.ceil(np.log2(patterns.size * 4)))))
        self.shift = np.full(1 << self.bits, m - self.block + 1, dtype=np.uint8)
        for last in range(self.block - 1, m):
            place = self.place(patterns[:, last], patterns[:, last - 1])
            np.minimum.at(self.shift, place, np.uint8(m - 1 - last))
        key = self.bucket(patterns)
        order = np.argsort(key, kind="stable")
        self.keys, self.patterns, self.number = key[order], patterns[order], number[order]
        _, count = np.unique(self.keys, return_counts=True)
        self.deepest = int(count.max())

    def place(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Where a block of words stands in the shift table."""
        both = last.astype(np.uint64) + (before.astype(np.uint64) << np.uint64(32) if self.block == 2 else np.uint64(0))
        both = (both ^ (both >> np.uint64(29))) * _MIX[0]
        return ((both ^ (both >> np.uint64(32))) * _MIX[1] >> np.uint64(64 - self.bits)).astype(np.int64)

    def bucket(self, rows: np.ndarray) -> np.ndarray:
        """The bucket of a window: its suffix block first, then the words before it."""
        last = self.place(rows[:, -1], rows[:, -2] if self.m > 1 else rows[:, -1]).astype(np.uint64)
        h = np.zeros(len(rows), dtype=np.uint64)
        for k in range(self.m):
            h = (h ^ rows[:, k].astype(np.uint64)) * _MIX[2]
            h ^= h >> np.uint64(31)
        return (last << np.uint64(40)) | (h >> np.uint64(24))

    def ends(self, words: np.ndarray) -> np.ndarray:
        """Ends of the windows where the search may not move on."""
        at = np.arange(self.m - 1, len(words), _LANE)
        stop, out = np.minimum(at + _LANE, len(words)), []
        while len(at):
            last, before = words[at], words[at - 1] if self.block == 2 else words[at]
            step = self.shift[self.place(last, before)].astype(np.int64)
            step[before == 0] = self.m - 1 if self.block == 2 else 1
            step[last == 0] = self.m
            out.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def find(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ends, pattern numbers) of all occurrences that don't begin before the ``first`` word of their text."""
        ends = self.ends(words)
        ends = ends[first[ends] <= ends - self.m + 1]
        for k in range(0, len(ends), _COMPARED):
            e = ends[k : k + _COMPARED]
            rows = words[e[:, None] + np.arange(1 - self.m, 1)]
            key = self.bucket(rows)
            at = np.searchsorted(self.keys, key)
            for _ in range(self.deepest):
                inside = np.minimum(at, len(self.keys) - 1)
                hit = np.flatnonzero((at < len(self.keys)) & (self.keys[inside] == key))
                hit = hit[(self.patterns[at[hit]] == rows[hit]).all(axis=1)]
                yield e[hit], self.number[at[hit]]
                at = at + 1


class Matcher:
    """Searches texts for the windows of one block of patterns."""

    def __init__(self, pairs: pa.Table):
        held: dict[str, list[int]] = {}
        for window, item in zip(pairs["window"].to_pylist(), pairs["item_id"].to_pylist()):
            held.setdefault(window, [])
            if item is not None:
                held[window].append(item)
        split = [w.split(" ") for w in held]
        names = sorted({w for ws in split for w in ws})
        raw = [w.encode("utf-8", "surrogatepass") for w in names]
        size = np.array([len(w) for w in raw], dtype=np.int64)
        end = np.cumsum(size)
        known = _Words(b"".join(raw), end - size, end)
        self.order = np.argsort(known.hash, kind="stable")
        self.known, self.hashes = known, known.hash[self.order]
        self.twins = int(np.unique(self.hashes, return_counts=True)[1].max()) if len(names) else 0
        code = {w: i + 1 for i, w in enumerate(names)}
        lengths: dict[int, list[int]] = {}
        for i, ws in enumerate(split):
            lengths.setdefault(len(ws), []).append(i)
        self.lengths = [_Length(np.array([[code[w] for w in split[i]] for i in some], dtype=np.int64), np.array(some)) for some in lengths.values()]
        self.n_items = np.array([len(x) for x in held.values()], dtype=np.int64)
        self.items = np.array([i for x in held.values() for i in x], dtype=np.int64)
        self.item_at = np.cumsum(self.n_items) - self.n_items

    def numbers(self, words: _Words) -> np.ndarray:
        """Each word's number among the patterns' words, 0 for none."""
        out = np.zeros(len(words.hash), dtype=np.int64)
        at = np.searchsorted(self.hashes, words.hash)
        for _ in range(self.twins):  # more than one only where two words share a hash
            inside = np.minimum(at, len(self.hashes) - 1)
            i = np.flatnonzero((at < len(self.hashes)) & (self.hashes[inside] == words.hash))
            j = self.order[at[i]]
            ok = words.same(i, self.known, j)
            out[i[ok]] = j[ok] + 1
            at = at + 1
        return out

    def words_of(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and numbers of all words of texts that lie one behind the other, part by part."""
        starts, numbers, lo = [], [], 0
        while lo < len(data):
            hi = min(lo + _PART, len(data))
            while hi < len(data) and _WORD[data[hi]] and _WORD[data[hi - 1]]:  # parts end between words
                beyond = np.flatnonzero(~_WORD[data[hi : hi + _PART]])
                hi = hi + int(beyond[0]) if len(beyond) else min(hi + _PART, len(data))
            start, end = _edges(data[lo:hi], begins - lo)
            starts.append(start + lo)
            numbers.append(self.numbers(_Words(data[lo:hi].tobytes(), start, end)))
            lo = hi
        none = np.zeros(0, np.int64)
        return np.concatenate(starts or [none]), np.concatenate(numbers or [none])

    def search(self, text: pa.Array, known: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """n_words, and hit spans and items of texts, with what is ``known`` of them: (text, start, end) of spans, (text, item)."""
        text = pc.fill_null(text.cast(pa.large_string()), "")
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        low = np.where((raw >= 0x41) & (raw <= 0x5A), raw + np.uint8(32), raw)
        begins = (offsets - offsets[0]).astype(np.int64)
        start, number = self.words_of(low, begins[:-1])
        upto = np.searchsorted(start, begins)  # words before each text
        of = np.repeat(np.arange(len(text)), np.diff(upto))
        first = upto[of]
        change = np.zeros(len(start) + 1, dtype=np.int64)
        span_text, span_start, span_end, item_text, item = known
        np.add.at(change, upto[span_text] + span_start, 1)
        np.add.at(change, upto[span_text] + span_end, -1)
        texts, items = [item_text], [item]
        for length in self.lengths:
            for end, window in length.find(number, first):
                np.add.at(change, end - length.m + 1, 1)
                np.add.at(change, end + 1, -1)
                pair = np.unique(np.stack([of[end], window], axis=1), axis=0)
                n = self.n_items[pair[:, 1]]
                texts.append(np.repeat(pair[:, 0], n))
                items.append(self.items[np.repeat(self.item_at[pair[:, 1]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        hit = np.cumsum(change[:-1]) > 0
        n_hit = np.bincount(of[hit], minlength=len(text))
        fresh = np.zeros(len(hit), dtype=bool)
        fresh[upto[:-1][upto[:-1] < len(hit)]] = True
        before = np.concatenate([[False], hit[:-1]]) & ~fresh
        opens = np.flatnonzero(hit & ~before)
        behind = np.concatenate([hit[1:] & ~fresh[1:], [False]]) if len(hit) else hit
        closes = np.flatnonzero(hit & ~behind) + 1
        found = np.unique(np.stack([np.concatenate(texts), np.concatenate(items)], axis=1), axis=0)
        return [np.diff(upto), n_hit, of[opens], opens - first[opens], closes - first[opens], found[:, 0], found[:, 1]]


def _lists(of: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """A list for each of ``n`` rows; ``of`` is ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int64()))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and the value of every entry of lists."""
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)


_MATCHERS: dict[str, Matcher] = {}


def _searched(batches: Iterator[pa.RecordBatch], block: Broadcast, name: str, keep_text: bool) -> Iterator[pa.RecordBatch]:
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = Matcher(pa.ipc.open_stream(block.value).read_all())
    matcher = _MATCHERS[name]
    for batch in batches:
        lo = 0
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(sizes)
        while lo < len(batch):  # some rows at a time: what numpy holds depends on bytes, not on rows
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 4 * _PART)))
            some = batch.slice(lo, hi - lo)
            n, lo = len(some), hi
            of, start = _flat(some["hit_start"])
            known = of, start, _flat(some["hit_end"])[1], *_flat(some["items"])
            n_words, n_hit, of, start, end, item_of, item = matcher.search(some["text"], known)
            columns = [some["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), _lists(of, start, n), _lists(of, end, n), _lists(item_of, item, n)]
            names = ["doc_id", "n_words", "n_hit", "hit_start", "hit_end", "items"]
            yield pa.RecordBatch.from_arrays(columns + ([some["text"]] if keep_text else []), names + (["text"] if keep_text else []))


def find(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Where word windows of ``benchmark`` (item_id, text) occur in ``docs`` (doc_id, text); other columns of either are ignored.

    Words are runs of ASCII digits and letters and of anything beyond ASCII,
    A-Z in lower case.  Returns a row for each row of ``docs``, repeated ones
    too: doc_id, n_words, n_hit (words inside any occurrence), hit_start and
    hit_end (spans of hit words, the end is left out), items (distinct ids, by number).
    Null and empty texts have no words; items without words are in no document;
    items without an id hit words but are not listed.  Without items nothing is hit.
    """
    spark = docs.sparkSession
    pairs = stored(windows(benchmark, width))
    n, size = pairs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    blocks = max(1, -(-n // block_pairs), -(-size // BLOCK_BYTES))
    none = F.array().cast("array<long>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), none.alias("hit_start"), none.alias("hit_end"), none.alias("items"))
    for b in range(blocks):
        last = b == blocks - 1
        some = pairs.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)) == b).toArrow()  # bounded by the size of a block
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, some.schema) as writer:
            writer.write_table(some)
        block = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
        rows = rows.select("doc_id", "text", "hit_start", "hit_end", "items").mapInArrow(lambda it, block=block, name=uuid.uuid4().hex, last=last: _searched(it, block, name, not last), _FOUND if last else _FOUND + ", text string")
        rows = rows if last else stored(rows)
    return rows


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bk AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
pats AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS win FROM bk, unnest(range(0, len(w) - k + 1)) AS t(i)),
ks AS (SELECT DISTINCT k FROM pats),
dw AS (SELECT r, k, i, array_to_string(w[i + 1 : i + k], ' ') AS win FROM d JOIN ks ON len(w) >= k, unnest(range(0, len(w) - k + 1)) AS t(i)),
occ AS (SELECT r, i, dw.k, item_id FROM dw JOIN pats ON dw.k = pats.k AND dw.win = pats.win),
hit AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT DISTINCT r, i, k FROM occ), unnest(range(i, i + k)) AS t(j) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
