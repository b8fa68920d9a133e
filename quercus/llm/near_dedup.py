"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Every distinct shingle set gets a MinHash signature, cut into trees of a fixed
depth.  A tree is one sorted order of all signatures: Spark sorts by tree and
label, and each task reads its stretch once.  A signature's candidates are its
neighbours in the order that share a prefix of at least ``MIN_DEPTH`` values,
nearest first: where few are alike the common prefix is short, in a crowd it is
long, so the depth adapts to every region.  One-bit sketches of the whole
signature leave out neighbours that are certainly too different.

Candidates are confirmed on whole texts, a few links at a time: first one link
for each document, then only candidates that still lie in different
components.  Regions with more members than a window sees are settled exactly
afterwards: members outside a region's main component meet all of the region,
in blocks, and a pair of blocks gives links that join what is similar, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, linked_parts, stored

WORDS, SIMILARITY = 4, 80
#: Shape of the forest, the shortest common prefix of candidates, and how many neighbours a window sees on each side.
TREES, DEPTH, MIN_DEPTH, NEIGHBOURS = 16, 8, 3, 6
#: Of the signature's one-bit sketch (128 bits) a pair of similarity 0.8 shares 115 on average, and 96 or fewer once in ten million.
SKETCH_BITS = 96
#: Documents and shingles of a block of a crowded region, shingles counted at a time, and rows of the sorted orders for each task.
BLOCK, BLOCK_SHINGLES, COLUMNS, ROWS_PER_TASK, SEED = 512, 1_000_000, 8192, 100_000, 20240611
_MEMO_WORDS = 150_000
_PRIME_A, _PRIME_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """64-bit hashes of words, remembered; it starts afresh when it is large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _PRIME_A
    h = (h ^ (h >> np.uint64(29))) * _PRIME_B
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``words``-word shingles of a text.

    Words are runs of anything but ASCII white space, A-Z in lower case; fewer
    words than ``words`` make one shingle; no words make none.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=len(found))
    k = min(words, len(h))
    s = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        s = _mixed(s * _PRIME_B + h[i : len(h) - k + 1 + i])
    return np.unique(s)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minhash(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The signature of one shingle set: the least value of each hash function over it."""
    h = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), 4096):
        np.minimum(out, (h[None, k : k + 4096] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return out


def _signatures(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    a, b = _seeds(TREES * DEPTH)
    shift = (np.uint64(16) * np.arange(3, -1, -1, dtype=np.uint64))[None, :]
    for batch in batches:
        n, d0, d1, labels, sketch = [], [], [], [], []
        for text in batch["text"]:
            s = shingles(text if isinstance(text, str) else None, words)
            n.append(len(s))
            raw = s.tobytes()
            digest = xxhash.xxh3_128_intdigest(raw)
            d0.append((digest >> 64) - (1 << 63))
            d1.append((digest & (1 << 64) - 1) - (1 << 63))
            sig = minhash(s, a, b)
            mixed = _mixed(sig.astype(np.uint64) + _PRIME_A)
            four = (mixed & np.uint64(0xFFFF)).reshape(-1, 4)
            labels.append((four << shift).sum(axis=1, dtype=np.uint64).view(np.int64))
            sketch.append(np.packbits((mixed >> np.uint64(40)).astype(np.uint8) & 1).view(np.int64))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "k0": batch["k0"], "k1": batch["k1"], "n_shingles": n, "d0": d0, "d1": d1, "labels": labels, "sketch": sketch})


def _close(s0: np.ndarray, s1: np.ndarray, t0: np.ndarray, t1: np.ndarray, bits: int) -> np.ndarray:
    """Which sketches agree in more than ``bits`` of their 128 bits."""
    # of signed numbers bitwise_count takes the absolute value
    differ = np.bitwise_count((s0 ^ t0).view(np.uint64)).astype(np.int16) + np.bitwise_count((s1 ^ t1).view(np.uint64))
    return differ < 128 - bits


def _neighbours(rows: dict[str, np.ndarray], new: int, width: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Candidate pairs of sorted rows, the later one among those from ``new`` on; and which rows are in a region too large for the window."""
    tree, prefix, ids, s0, s1 = (rows[c] for c in ("tree", "prefix", "id", "s0", "s1"))
    a, b = [], []
    for o in range(1, width + 1):
        lo = max(0, new - o)
        if len(ids) - o <= lo:
            break
        i = np.arange(lo, len(ids) - o)
        j = i + o
        same = (tree[i] == tree[j]) & (prefix[i] == prefix[j])
        i, j = i[same], j[same]
        ok = _close(s0[i], s1[i], s0[j], s1[j], SKETCH_BITS)
        a.append(ids[i[ok]])
        b.append(ids[j[ok]])
    crowd = np.zeros(len(ids), bool)
    o = width + 1
    if len(ids) > o:
        far = np.flatnonzero((tree[:-o] == tree[o:]) & (prefix[:-o] == prefix[o:]))
        for k in range(o + 1):
            crowd[far + k] = True
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}), crowd


_SCAN = "kind int, tree int, prefix long, a long, b long, s0 long, s1 long, l0 long, l1 long, part long, n long"
_SCAN_COLUMNS = [c.split()[0] for c in _SCAN.split(", ")]


def _scan(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """One stretch of the sorted orders.

    Yields candidate pairs (kind 0: a, b), members of crowded regions (kind 1:
    tree, prefix, a, s0, s1), and the first and last rows of the stretch (kind 2), which its neighbour must see.
    """
    from pyspark import TaskContext

    part, reach = TaskContext.get().partitionId(), width + 1
    held: dict[str, np.ndarray] | None = None
    marked = np.zeros(0, bool)
    names = ("tree", "id", "l0", "l1", "s0", "s1", "prefix")

    def frame(kind: int, rows: dict[str, np.ndarray], at: np.ndarray) -> pd.DataFrame:
        d = {c: rows[c][at] for c in ("tree", "prefix", "s0", "s1", "l0", "l1")}
        return pd.DataFrame(d | {"kind": np.int32(kind), "a": rows["id"][at], "b": np.int64(0), "part": np.int64(part), "n": np.int64(seen)})[_SCAN_COLUMNS]

    first, seen = True, 0
    for batch in batches:
        now = {c: batch[c].to_numpy() for c in names[:-1]}
        seen += len(now["id"])
        now["prefix"] = now["l0"] >> np.int64(16 * (4 - MIN_DEPTH))
        old = 0 if held is None else len(held["id"])
        rows = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in names}
        pairs, crowd = _neighbours(rows, old, width)
        crowd[:old] &= ~marked  # those were told already
        out = [frame(1, rows, np.flatnonzero(crowd))]
        if len(pairs):
            blank = {c: np.int64(0) for c in ("prefix", "s0", "s1", "l0", "l1", "part", "n")}
            out.append(pairs.assign(kind=np.int32(0), tree=np.int32(0), **blank)[_SCAN_COLUMNS])
        if first:
            out.append(frame(2, rows, np.arange(min(reach, len(rows["id"])))))
            first = False
        told = crowd.copy()
        told[:old] |= marked
        held = {c: rows[c][-reach:] for c in names}
        marked = told[-reach:]
        yield pd.concat(out)
    if held is not None:
        yield frame(2, held, np.arange(len(held["id"]))).assign(b=np.int64(1))


def _border(g: pd.DataFrame, width: int) -> pd.DataFrame:
    """Pairs and crowds over the border of two stretches: the end of one and the beginning of the next."""
    g = g.sort_values(["tree", "l0", "l1", "a"]).drop_duplicates(["tree", "l0", "l1", "a"])
    rows = {"tree": g["tree"].to_numpy(), "prefix": g["prefix"].to_numpy(), "id": g["a"].to_numpy(), "s0": g["s0"].to_numpy(), "s1": g["s1"].to_numpy()}
    pairs, crowd = _neighbours(rows, 0, width)
    crowded = g[crowd].assign(kind=1)[["kind", "tree", "prefix", "a", "b", "s0", "s1"]]
    pairs = pairs.assign(kind=0, tree=0, prefix=0, s0=0, s1=0)[crowded.columns]
    return pd.concat([crowded, pairs])


def _blocks(left: pd.DataFrame, right: pd.DataFrame, similarity: int) -> pd.DataFrame:
    """One block of a region's outsiders and one block of its members: links that join what is similar enough and in different components.

    Both sides have id, comp, n_set (the size of the full set) and hs (its
    shingles that occur in other components too).  All intersections come from
    products of 0/1 matrices over the shingles that both sides hold, so they are
    counts on full sets; at most one link a row comes out, whatever number of pairs is similar.
    """
    n, m = len(left), len(right)
    if not n or not m:
        return pd.DataFrame({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64)})
    sets = [np.asarray(x, np.int64) for x in (*left["hs"], *right["hs"])]
    row = np.repeat(np.arange(n + m), [len(x) for x in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    both = (np.bincount(at[row < n], minlength=len(values)) > 0) & (np.bincount(at[row >= n], minlength=len(values)) > 0)
    row, column = row[both[at]], (np.cumsum(both) - 1)[at[both[at]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, m))
    for lo in range(0, int(both.sum()), COLUMNS):
        i, j = np.searchsorted(column, [lo, lo + COLUMNS])
        has = np.zeros((n + m, COLUMNS), np.float32)
        has[row[i:j], column[i:j] - lo] = 1
        shared += has[:n] @ has[n:].T
    union = left["n_set"].to_numpy()[:, None] + right["n_set"].to_numpy()[None, :] - shared
    near = (100 * shared >= similarity * union) & (left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :])
    parts = np.concatenate(linked_parts(near, False))
    ids = np.concatenate([left["id"].to_numpy(), right["id"].to_numpy()])
    joins = parts != np.arange(n + m)
    return pd.DataFrame({"src": ids[joins], "dst": ids[parts[joins]]})


def _exploded(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    """A row for every shingle of every text."""
    for batch in batches:
        for k in range(0, len(batch), 64):
            some = batch.iloc[k : k + 64]
            sets = [shingles(t, words) for t in some["text"]]
            n = [len(x) for x in sets]
            yield pd.DataFrame({"h": np.concatenate(sets).view(np.int64), "id": np.repeat(some["id"].to_numpy(np.int64), n), "comp": np.repeat(some["comp"].to_numpy(np.int64), n), "n": np.repeat(np.array(n, np.int64), n)})


def _linkable(crowd: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """The ids of ``crowd`` (id, comp) of whose shingles enough occur in documents of other components; those shingles (hs) and the size of the set (n_set).

    Exact: an intersection is no larger than their number, a union no smaller than the set.
    """
    of = texts.join(crowd, "id").select("id", "comp", "text")
    rows = stored(of.mapInPandas(lambda it: _exploded(it, words), "h long, id long, comp long, n long"))
    shared = rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("h")
    counts = rows.join(shared, "h").groupBy("id").agg(F.collect_list("h").alias("hs"), F.min("n").alias("n_set"))
    return counts.where(100 * F.size("hs") >= similarity * F.col("n_set"))


def _confirmed(batches: Iterator[pd.DataFrame], words: int, similarity: int) -> Iterator[pd.DataFrame]:
    """The pairs of which the full shingle sets are similar enough."""
    last: tuple[int, np.ndarray] | None = None
    for batch in batches:
        keep = []
        for a, ta, tb in zip(batch["a"], batch["text_a"], batch["text_b"]):
            if last is None or last[0] != a or last[1] != ta:
                last = (a, ta, shingles(ta, words))
            x, y = last[2], shingles(tb, words)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= similarity * (len(x) + len(y) - both) > 0)
        yield batch.loc[keep, ["a", "b"]]


def _links(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Confirmed pairs (src, dst).  Texts meet their pairs in two equi-joins, which Spark may split where one text has many partners."""
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").select("a", "b", "text_a", "text_b")
    found = both.mapInPandas(lambda it: _confirmed(it, words, similarity), "a long, b long")
    return found.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _bordered(scan: DataFrame, neighbours: int) -> DataFrame:
    """The end rows of stretches with the border they belong to.

    A border reaches from one stretch that is longer than the window sees to the
    next such one; shorter stretches between them belong to it whole.
    """
    ends = scan.where("kind = 2")
    # one row a task
    sizes = ends.groupBy("part").agg(F.max(F.when(F.col("b") == 1, F.col("n"))).alias("rows"))
    long = F.when(F.col("rows") > neighbours, F.col("part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.max(long).over(before), F.lit(-1)).alias("behind"), long.isNotNull().alias("long"))
    placed = ends.join(F.broadcast(sizes), "part")
    return placed.withColumn("border", F.when(F.col("long") & (F.col("b") == 1), F.col("part")).otherwise(F.col("behind")))


def _classes(plain: DataFrame, words: int, similarity: int, neighbours: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``plain`` (doc_id, text, k0, k1: a key of 128 bits of what tells rows apart) with n_shingles and the digest of their set (d0, d1), and the sets with their component.

    A set's component is (d0, d1, comp, component_id): a number, and the smallest doc_id of its documents.
    """
    schema = "doc_id long, k0 long, k1 long, n_shingles long, d0 long, d1 long, labels array<long>, sketch array<long>"
    signed = stored(plain.mapInPandas(lambda it: _signatures(it, words), schema))
    # one row for each different set, whatever number of documents has it; its number is fixed by writing the table
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k0", "k1")).alias("rep")
    sets = signed.where("n_shingles > 0").groupBy("d0", "d1").agg(rep, F.first("labels").alias("labels"), F.first("sketch").alias("sketch"))
    sets = stored(sets.withColumn("node", F.monotonically_increasing_id()))
    rows = sets.select(F.col("node").alias("id"), F.col("sketch")[0].alias("s0"), F.col("sketch")[1].alias("s1"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.slice("labels", t * 2 + 1, 2))).alias("tree", "label"))
    rows = rows.select("tree", "id", F.col("label")[0].alias("l0"), F.col("label")[1].alias("l1"), "s0", "s1")
    tasks = max(1, -(-sets.count() * TREES // ROWS_PER_TASK))
    ordered = rows.repartitionByRange(tasks, "tree", "l0", "l1", "id").sortWithinPartitions("tree", "l0", "l1", "id")
    scan = stored(ordered.mapInPandas(lambda it: _scan(it, neighbours), _SCAN))
    over = _bordered(scan, neighbours).groupBy("border").applyInPandas(lambda g: _border(g, neighbours), "kind int, tree int, prefix long, a long, b long, s0 long, s1 long")
    over = stored(over)
    pairs = stored(scan.where("kind = 0").select("a", "b").union(over.where("kind = 0").select("a", "b")).where("a != b").distinct())
    crowd = scan.where("kind = 1").select("tree", "prefix", F.col("a").alias("id"))
    crowd = crowd.union(over.where("kind = 1").select("tree", "prefix", "a")).distinct()

    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(crowd.select("id")).distinct()
    keys = sets.select("node", "rep.k0", "rep.k1").join(ids, "node")
    # repeated rows give their text once; the join has brought them together
    texts = plain.select("k0", "k1", "text").join(keys.hint("merge"), ["k0", "k1"]).groupBy("k0", "k1").agg(F.first("node").alias("id"), F.first("text").alias("text"))
    texts = stored(texts.select("id", "text"))
    # one link for each document, the one to its smallest candidate
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = stored(_links(first, texts, words, similarity))
    found = components(links)
    rest = _apart(pairs, found).join(first, ["a", "b"], "left_anti")
    links = stored(links.union(_links(rest, texts, words, similarity)).distinct())
    found = stored(components(links))
    # crowded regions: who isn't in the region's main component meets all its members
    members = stored(crowd.join(found, F.col("id") == F.col("node"), "left").select("tree", "prefix", "id", F.coalesce("component", "id").alias("comp")))
    sizes = members.groupBy("tree", "prefix", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("tree", "prefix").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    main = stored(main.select("tree", "prefix", "main"))
    if main.head(1):
        involved = stored(members.join(main, ["tree", "prefix"]))
        able = stored(_linkable(involved.select("id", "comp").distinct(), texts, words, similarity))
        placed = stored(involved.join(able.select("id", F.size("hs").alias("m")), "id"))
        # blocks of a bounded number of documents and of shingles
        cuts = placed.groupBy("tree", "prefix").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("m") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count_if(F.col("comp") != F.col("main")).alias("outside"), F.count_distinct("comp").alias("comps"))
        placed = placed.join(cuts.where("outside > 0 and comps > 1"), ["tree", "prefix"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        placed = stored(placed.select("tree", "prefix", "id", "comp", "main", "blocks", "block"))
        apart = placed.where("comp != main").select("tree", "prefix", "id", "comp", F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("t"))
        queries = placed.where("comp != main").select("tree", "prefix", F.col("block").alias("q")).distinct()
        targets = placed.select("tree", "prefix", "id", "comp", F.col("block").alias("t")).join(queries, ["tree", "prefix"])
        keys = ["tree", "prefix", "q", "t"]
        apart, targets = (x.join(able, "id").select(*keys, "id", "comp", "n_set", "hs") for x in (apart, targets))
        targets = targets.toDF(*targets.columns)  # columns of its own
        more = apart.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInPandas(lambda a, b: _blocks(a, b, similarity), "src long, dst long")
        found = stored(components(links.union(more.distinct())))
    named = sets.select("node", "d0", "d1", "rep.doc_id").join(found, "node", "left").select("d0", "d1", "doc_id", F.coalesce("component", "node").alias("comp"))
    named = stored(named)
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return signed.drop("labels", "sketch"), named.join(least, "comp").select("d0", "d1", "comp", "component_id")


def _keys(columns: list[str]) -> list:
    """A key of 128 bits of the values of columns, nulls included."""
    known = [F.col(c).isNull() for c in columns]
    return [F.xxhash64(F.lit(1), *columns, *known).alias("k0"), F.xxhash64(F.lit(2), *known, *reversed(columns)).alias("k1")]


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of their shingle sets of at least ``similarity`` per cent.

    ``docs`` has doc_id and text; other columns are ignored.  Every row is a
    document of its own, repeated ones and those that share an id too.  Texts
    that are null or without words have no shingles and are linked with nothing.
    A component is named by the smallest id in it; one of rows without an id
    has none.  An empty table gives an empty result.  A chain of links that
    ``components`` cannot settle in its rounds is an error.  Returns doc_id,
    n_shingles, component_id and kept (whether that is the row's own id).
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed, named = _classes(plain.select("doc_id", "text", *_keys(["doc_id", "text"])), words, similarity, neighbours)
    out = signed.select("doc_id", "n_shingles", "d0", "d1").join(named, ["d0", "d1"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, neighbours: int = NEIGHBOURS) -> DataFrame:
    """One row of ``docs`` (doc_id, text, any others that can be hashed) for each component of near-duplicates: that of the smallest id.

    Rows without an id stand behind all others; of rows that share the smallest
    id one stays.  Rows without words are no duplicates, and all stay.
    """
    k0, k1 = _keys(docs.columns)
    every = docs.select("*", k0.alias("_k0"), k1.alias("_k1"))
    plain = every.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("_k0").alias("k0"), F.col("_k1").alias("k1"))
    signed, named = _classes(plain, words, similarity, neighbours)
    worded = signed.where("n_shingles > 0")
    best = worded.join(named, ["d0", "d1"]).groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k0", "k1")).alias("best"))
    chosen = stored(best.select(F.col("best.k0").alias("_k0"), F.col("best.k1").alias("_k1")))
    kept = every.join(chosen, ["_k0", "_k1"], "left_semi")
    # equal rows have one key: where there are any among the chosen, one of them stays
    rows = worded.select(F.col("k0").alias("_k0"), F.col("k1").alias("_k1"))
    if rows.groupBy("_k0", "_k1").count().where("count > 1").join(chosen, ["_k0", "_k1"]).head(1):
        kept = kept.dropDuplicates(["_k0", "_k1"])
    wordless = signed.where("n_shingles = 0").select(F.col("k0").alias("_k0"), F.col("k1").alias("_k1")).distinct()
    return kept.union(every.join(wordless, ["_k0", "_k1"], "left_semi")).select(docs.columns)


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs that lie in different components."""
    a = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
