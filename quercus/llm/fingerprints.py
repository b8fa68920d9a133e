"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame operations alone.

A text's paragraphs (lines, long ones cut) are hashed to 64-bit digests, and
every digest is added to one cell of each of three tables: a cell keeps how many
digests it has, their exclusive or, and that of their check values.  Sketches
of two versions subtract cell by cell; what both hold vanishes.  A cell with
one digest left gives it up, it is taken out of its other cells, and so on
until nothing is left: the digests that differ.  When something stays, the
sketches were too small, and the pair is tried again with larger ones.

Cells and peeling are aggregates over (bucket of documents, document, cell), so
after one exchange by bucket all passes run where the data are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Code points after which a long line is cut; cells of each table of the fingerprint column.
PIECE, CELLS, TABLES = 64, 8, 3
#: Cells for each digest expected to differ, over all tables; smallest digests an estimate is made of; passes over the tables.
SPARE, SMALLEST, PASSES, TRIES = 2.2, 16, 12, 12
#: Documents are dealt to buckets of neighbouring ids, of about so many rows: at most this many, a power of two, less one.
BUCKETS, BUCKET_ROWS = 65_535, 32


def pieces(text: Column) -> Column:
    """Digests of the paragraphs of a text, in order: lines without their ends, cut every ``PIECE`` code points."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{PIECE}}}"), F.lit(0)), lambda p: F.xxhash64(p))


def _check(digest: Column) -> Column:
    return F.hash(digest, F.lit(7)).cast("long")


def _place(digest: str, table: int) -> str:
    """A digest's cell in a table, as SQL over the columns cells (of each table) and salt."""
    return f"({table} * cells + pmod(xxhash64({digest}, {table}, salt), cells))"


def fingerprint(digests: Column) -> Column:
    """The sketch of distinct digests as text: 24 cells of count, digests and checks, in base 64.

    The cell in table ``t`` is given by three bits of the digest.
    """
    spots = [F.struct(F.lit(CELLS - 1 << at).cast("long").alias("mask"), F.lit(slot << at).cast("long").alias("want")) for at in (40 + 3 * t for t in range(TABLES)) for slot in range(CELLS)]
    inside = F.transform(F.array(*spots), lambda c: F.filter(digests, lambda d: d.bitwiseAND(c["mask"]) == c["want"]))
    xor = lambda own, of: F.lpad(F.hex(F.aggregate(own, F.lit(0).cast("long"), lambda acc, d: acc.bitwiseXOR(of(d)))), 16, "0")
    # fixed width: 8, 16 and 8 hexadecimal digits
    cells = F.transform(inside, lambda own: F.concat(F.lpad(F.hex(F.size(own).cast("long")), 8, "0"), xor(own, lambda d: d), F.right(xor(own, _check), F.lit(8))))
    return F.base64(F.unhex(F.array_join(cells, "")))


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """Adds ``bucket``: the number of quantiles of the ids below the id (null: 0), found by binary search in a short constant array."""
    wanted = [(i + 1) / (buckets + 1) for i in range(buckets)]
    bounds = docs.agg(F.percentile_approx("doc_id", wanted, max(20_000, 4 * buckets))).first()[0] or []
    bounds = sorted(set(bounds))
    steps = max(1, len(bounds)).bit_length()
    if not bounds:
        return docs.withColumn("bucket", F.lit(0))
    array = F.lit(bounds + [2**63 - 1] * ((1 << steps) - len(bounds)))
    jumps = F.lit([1 << (steps - 1 - i) for i in range(steps)])
    step = lambda at, jump: F.when(F.get(array, at + jump - 1) < F.col("doc_id"), at + jump).otherwise(at)
    return docs.withColumn("bucket", F.aggregate(jumps, F.lit(0), step))


_ORDER = ["no_id", "from_last", "tie"]


def with_next(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Documents with their bucket, place in it (``rn``) and ``next_text``: the next document's text by descending id, after the last the first's.

    The first document of each bucket is also sent to the bucket before it (at
    most ``buckets`` rows), as ``ghost``, so that one exchange by bucket is enough.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    size = (1 << max(0, min((buckets + 1).bit_length() - 1, (n // BUCKET_ROWS).bit_length() - 1))) - 1
    keyed = _bucketed(rows, size).select("bucket", F.col("doc_id").isNull().alias("no_id"), F.bitwise_not("doc_id").alias("from_last"), F.xxhash64("text").alias("tie"), "doc_id", "text")
    first = keyed.groupBy("bucket").agg(F.min(F.struct(*_ORDER)).alias("first")).collect()  # at most a row for each bucket
    first = sorted(first, key=lambda r: -r["bucket"])  # in descending order of ids, null ids being in bucket 0
    links = [(first[i]["bucket"], *first[(i + 1) % len(first)]["first"]) for i in range(len(first))]
    to = keyed.sparkSession.createDataFrame(links, "to int, no_id boolean, from_last long, tie long")
    same = reduce(lambda a, b: a & b, [keyed[c].eqNullSafe(to[c]) for c in _ORDER])
    ghosts = keyed.join(F.broadcast(to), same).select(F.col("to").alias("bucket"), *[keyed[c] for c in [*_ORDER, "doc_id", "text"]]).dropDuplicates(["bucket"])
    every = keyed.withColumn("ghost", F.lit(False)).union(ghosts.withColumn("ghost", F.lit(True)))
    # nulls of from_last are rows of no_id, which come last
    by = Window.partitionBy("bucket").orderBy("ghost", *_ORDER)
    return every.select("bucket", "ghost", "doc_id", "text", F.row_number().over(by).alias("rn"), F.lead("text").over(by).alias("next_text"))


_KEYS = ["bucket", "rn", "pair", "cells", "salt"]


def peeled(differ: DataFrame, passes: int = PASSES) -> DataFrame:
    """Recovers the digests of subtracted sketches.

    ``differ`` has bucket, rn, pair, cells, salt and the cells themselves: cell,
    n, digests, checks.  Returns for each pair ``plus`` and ``minus``, the digests
    recovered from either side, and ``left``, the cells that stayed.
    """
    keys = ", ".join(_KEYS)
    names = ("cell", "n", "digests", "checks", "plus", "minus")
    row = lambda *values: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in zip(names, values)) + ")"
    state = f"SELECT {keys}, cell, n, digests, checks, 0L AS plus, 0L AS minus FROM {{differ}}"
    for p in range(passes):
        table = p % TABLES
        # a digest that is alone in its cell is told, and taken out of its other cells; its own cell goes with it
        others = [row(_place("digests", t), "-n", "digests", "checks", "0L", "0L") for t in range(TABLES) if t != table]
        told = row("-1L", "0L", "0L", "0L", "greatest(n, 0L)", "greatest(-n, 0L)")
        pure = f"abs(n) = 1 AND checks = cast(hash(digests, 7) AS bigint) AND cell = {_place('digests', table)}"
        moved = f"SELECT {keys}, inline(CASE WHEN {pure} THEN array({', '.join(others)}, {told}) ELSE array({row(*names)}) END) FROM ({state})"
        sums = f"SELECT {keys}, cell, sum(n) AS n, bit_xor(digests) AS digests, bit_xor(checks) AS checks, sum(plus) AS plus, sum(minus) AS minus FROM ({moved}) GROUP BY {keys}, cell"
        state = f"SELECT * FROM ({sums}) WHERE cell < 0 OR n != 0 OR digests != 0 OR checks != 0"
    # one query, analysed once: built step by step, the driver would analyse the growing plan at every step
    return differ.sparkSession.sql(f"SELECT {keys}, sum(plus) AS plus, sum(minus) AS minus, count_if(cell >= 0) AS `left` FROM ({state}) GROUP BY {keys}", differ=differ)


def subtracted(pairs: DataFrame) -> DataFrame:
    """Sketches of ``pairs`` (bucket, rn, pair, cells, salt, own, other: distinct digests), subtracted cell by cell; empty cells are left out.

    The row of cell -1 keeps a pair that has no other cell.
    """
    signed = F.concat(F.transform("own", lambda d: F.struct(d.alias("d"), F.lit(1).cast("long").alias("n"))), F.transform("other", lambda d: F.struct(d.alias("d"), F.lit(-1).cast("long").alias("n"))))
    each = pairs.select(*_KEYS, F.explode_outer(signed).alias("e")).select(*_KEYS, F.col("e.d").alias("d"), F.col("e.n").alias("n"))
    cells = F.when(F.col("d").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.array(*[F.expr(_place("d", t)) for t in range(TABLES)]))
    each = each.select(*_KEYS, "d", "n", F.explode(cells).alias("cell"))
    sums = each.groupBy(*_KEYS, "cell").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.bit_xor("d"), F.lit(0)).alias("digests"), F.coalesce(F.bit_xor(_check(F.col("d"))), F.lit(0)).alias("checks"))
    # one empty cell stays, so that a pair without differences is not lost
    return sums.where((F.col("cell") <= 0) | (F.col("n") != 0) | (F.col("digests") != 0) | (F.col("checks") != 0)).withColumn("cell", F.when((F.col("n") == 0) & (F.col("digests") == 0) & (F.col("checks") == 0), F.lit(-1).cast("long")).otherwise(F.col("cell")))


def _expected(pairs: DataFrame) -> DataFrame:
    """Adds ``expected``: how many digests differ, as the smallest digests of either side (own, other) tell.

    What is used more than once has a column of its own, so that it is found once.
    """
    small = lambda a: F.slice(F.sort_array(a), 1, SMALLEST)
    out = pairs.withColumns({"_a": small("own"), "_b": small("other")})
    out = out.withColumns({"_least": small(F.array_union("_a", "_b")), "_both": F.array_intersect("_a", "_b")})
    out = out.withColumn("_alike", F.size(F.array_intersect("_least", "_both")) / F.greatest(F.size("_least"), F.lit(1)))
    return out.withColumn("expected", (F.size("own") + F.size("other")) * (1 - F.col("_alike")) / (1 + F.col("_alike"))).drop("_a", "_b", "_least", "_both", "_alike")


def likeness(units: DataFrame) -> DataFrame:
    """The likeness of each document's sketch to its edited text's and to the next document's: shared digests among all of both.

    ``units`` has bucket, rn, ghost, own (digests in order), kept (how many of them begin the edited text too) and tail (its others).
    """
    def pairs(of: DataFrame, factor: int) -> DataFrame:
        by = Window.partitionBy("bucket").orderBy("rn")
        both = of.withColumn("following", F.lead("own").over(by)).where("not ghost")
        own = F.array_distinct("own")
        both = both.select("bucket", "rn", own.alias("own"), F.array_distinct(F.concat(F.slice("own", 1, F.col("kept")), "tail")).alias("edited"), F.array_distinct("following").alias("following"))
        each = both.select("bucket", "rn", F.explode(F.array(F.struct(F.lit(0).alias("pair"), "own", F.col("edited").alias("other")), F.struct(F.lit(1).alias("pair"), "own", F.col("following").alias("other")))).alias("p")).select("bucket", "rn", "p.*")
        cells = (F.ceil(F.col("expected") * SPARE * factor / TABLES) + 4 * factor).cast("long")
        return _expected(each).withColumn("cells", cells).withColumn("salt", F.lit(factor)).drop("expected")

    # the sketches are larger than the units: tasks as many as the session asks for, not fewer for a small exchange
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo, done, failed = units.repartition(tasks, "bucket"), None, None
    for t in range(TRIES):
        every = pairs(todo, 1 << t)
        if failed is not None:
            every = every.join(failed, ["bucket", "rn", "pair"], "left_semi")
        got = stored(peeled(subtracted(every)).select("bucket", "rn", "pair", "plus", "minus", "left"))
        good = got.where("left = 0")
        done = good if done is None else done.union(good)
        failed = got.where("left > 0").select("bucket", "rn", "pair")
        if not failed.head(1):
            break
        # what failed, and the rows behind it, which hold the next document
        again = failed.select("bucket", F.explode(F.array("rn", F.col("rn") + 1)).alias("rn")).distinct()
        todo = units.join(again, ["bucket", "rn"], "left_semi")
    else:
        raise RuntimeError(f"fingerprints: pairs left after {TRIES} sizes of sketches")
    return done


def fingerprints(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Fingerprints of the texts of ``docs`` (doc_id, text; other columns are ignored) and of their edited texts.

    A null text is an empty one.  The last third of a text is replaced by the
    beginning of the next document's.  Repeated rows are documents of their own,
    ordered by a hash of the text; null ids come last.  Two empty texts are
    alike (1).  An empty table gives an empty result.  A pair whose sketches can't
    be peeled after ``TRIES`` doublings is an error.  Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = with_next(docs, buckets)
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    rows = rows.select("*", n.cast("long").alias("n_chars"), F.substring("text", F.lit(1), n - third).alias("head"))
    rows = rows.withColumn("edited", F.concat("head", F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third)))
    own, edited = pieces(F.col("text")), pieces(F.col("edited"))
    same = F.greatest(F.size(pieces(F.col("head"))) - 1, F.lit(0))
    rows = rows.select("bucket", "rn", "ghost", "doc_id", "n_chars", F.when(~F.col("ghost"), F.sha2("edited", 256)).alias("edited_sha256"), own.alias("own"), same.alias("kept"), edited.alias("edited"))
    rows = rows.withColumns({"tail": F.slice("edited", F.col("kept") + 1, F.size("edited")), "_own": F.array_distinct("own"), "_edited": F.array_distinct("edited")})
    rows = rows.withColumn("fingerprint", F.when(~F.col("ghost"), fingerprint(F.col("_own")))).withColumn("edited_fingerprint", F.when(~F.col("ghost"), fingerprint(F.col("_edited"))))
    units = stored(rows.withColumn("n_own", F.size("_own").cast("long")).drop("edited", "_own", "_edited"))
    found = likeness(units.select("bucket", "rn", "ghost", "own", "kept", "tail"))
    near = units.where("not ghost").select("bucket", "rn", "doc_id", "n_chars", "n_own", "edited_sha256", "fingerprint", "edited_fingerprint").join(found, ["bucket", "rn"])
    union = F.col("n_own") + F.col("minus")
    value = F.when(union == 0, F.lit(1.0)).otherwise((F.col("n_own") - F.col("plus")) / union)
    keys = ["bucket", "rn", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    out = near.groupBy("bucket", "rn").agg(*[F.first(c).alias(c) for c in keys[2:]], F.max(F.when(F.col("pair") == 0, value)).alias("near_edited"), F.max(F.when(F.col("pair") == 1, value)).alias("near_next"))
    return out.drop("bucket", "rn")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
