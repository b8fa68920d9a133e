"""License scans by diagonal voting.

Every position of every text gives the hash of the words that begin there.
Spark joins these hashes with the positions of the license templates, a table
of fixed size.  A hit at word ``p`` of the text and ``t`` of the template votes
for the diagonal ``p - t``; votes are aggregated by diagonal, diagonals that
lie within a few words of each other are merged (words were put in or left
out), and a merged span counts when its votes cover enough of the template and
no word that tells licenses apart differs in it (in one-line notices the version); where spans overlap, the best
covered one wins.
Each hash is confirmed by a second, independent one, 128 bits in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: The phrases whose places are counted, and their labels.
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
#: Openings of license texts and notices, and the labels they give; further ones may be passed.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "agpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-nc-sa": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-nc-nd": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "all-rights-reserved": "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
}
#: Older wordings of some of them.
VARIANTS = [
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivs 3 0 unported license"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivs 3 0 unported license"),
]
#: Lines that name a license and its version; such a line counts only where the words from the ones in front of the version on are all there.
NOTICES = [
    *[(f"gpl-{v}.0", f"licensed under the gnu general public license version {v}") for v in (1, 2, 3)],
    *[(f"lgpl-{v.replace(' ', '.')}", f"licensed under the gnu lesser general public license version {v}") for v in ("2 1", "3 0")],
    *[(f"apache-{v.replace(' ', '.')}", f"licensed under the apache license version {v}") for v in ("1 1", "2 0")],
    *[(f"cc-by{t.replace(' ', '-')}", f"licensed under cc by{t} {v} 0") for t in ("", " sa", " nc", " nd", " nc sa", " nc nd") for v in (1, 2, 3, 4)],
    *[(label, f"spdx license identifier {words}") for label, words in (("mit", "mit"), ("apache-2.0", "apache 2 0"), ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("mpl-2.0", "mpl 2 0"))],
]
#: Runs of words that tell licenses apart, and words that, next after "creative commons attribution" and a template's own, make another license.
JOINTS = ("gnu general", "gnu lesser general", "gnu library general", "gnu affero general")
CC_TERMS = ("sharealike", "share", "noncommercial", "non", "noderivatives", "noderivs", "no")
_JOINT, _LEFT, _RIGHT, _BAR, _VERSION = 1, 2, 4, 8, 16
PHRASE_GRAM, TEMPLATE_GRAM, SLACK, COVER = 2, 4, 3, 0.6

_BREAKS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_MEMO_WORDS = 150_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_BREAKS).split() if text else []


def _grams(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every run of ``k`` words."""
    n = max(0, len(hashes) - k + 1)
    first, second = np.full(n, _A, np.uint64), np.full(n, _B, np.uint64)
    for i in range(k):
        h = hashes[i : i + n]
        first = (first ^ h) * _B
        first ^= first >> np.uint64(31)
        second = (second + (h ^ (h >> np.uint64(33))) * _C) * _A
        second ^= second >> np.uint64(29)
    return first.view(np.int64), second.view(np.int64)


def _hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=len(found))


def _positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for every position of every text with the hashes of the words that begin there; one with position -1 holds the number of words."""
    def rows(parts: list[tuple]) -> pd.DataFrame:
        sizes = [len(p[2]) for p in parts]
        k0, k1 = (np.repeat(np.array([p[i] for p in parts], dtype=np.int64), sizes) for i in (0, 1))
        return pd.DataFrame({"k0": k0, "k1": k1} | {c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(("pos", "p0", "p1", "t0", "t1"), 2)})

    for batch in batches:
        parts, held = [], 0
        for k0, k1, text in zip(batch["k0"], batch["k1"], batch["text"]):
            h = _hashes(words(text if isinstance(text, str) else None))
            p0, p1 = _grams(h, PHRASE_GRAM)
            t0, t1 = _grams(h, TEMPLATE_GRAM)
            pad = np.zeros(len(p0) - len(t0), np.int64)
            pos = np.append(np.arange(len(p0), dtype=np.int32), np.int32(-1))
            own = [np.append(p0, len(h)), np.append(p1, 0), np.concatenate([t0, pad, [0]]), np.concatenate([t1, pad, [0]])]
            parts.append((k0, k1, pos, *own))
            held += len(pos)
            if held > 200_000:
                yield rows(parts)
                parts, held = [], 0
        if parts:
            yield rows(parts)


def _terms(text: list[bytes]) -> tuple[int, int] | None:
    """Where "attribution" stands in a Creative Commons template, and where its terms end."""
    terms = [t.encode() for t in CC_TERMS]
    for i in range(2, len(text)):
        if text[i - 2 : i + 1] == [b"creative", b"commons", b"attribution"]:
            return i, next((k for k in range(i + 1, len(text)) if text[k] not in terms), len(text))
    return None


def _marks(text: list[bytes]) -> dict[int, int]:
    """What the grams of a template tell of its joint: those that span it, the one that ends with its first word, the one that starts with its last or behind it."""
    if found := _terms(text):
        i, j = found
        return {t: _JOINT for t in range(max(j, i + 2) - TEMPLATE_GRAM, i + 1)} | {i + 1 - TEMPLATE_GRAM: _LEFT, j: _RIGHT}
    for run in (j.encode().split() for j in JOINTS):
        for i in range(len(text) - len(run) + 1):
            if text[i : i + len(run)] == run:
                end = i + len(run)
                return {t: _JOINT for t in range(end - TEMPLATE_GRAM, i + 1)} | {i + 1 - TEMPLATE_GRAM: _LEFT, end - 1: _RIGHT}
    return {}


def _bars(text: list[bytes]) -> list[tuple[int, list[bytes]]]:
    """Grams, by their place in a template, that show another license of the same family."""
    if not (found := _terms(text)):
        return []
    at = found[1] + 1 - TEMPLATE_GRAM
    return [(at, [*text[at : found[1]], t.encode()]) for t in CC_TERMS]


def _seeds(texts: list[tuple[str, str]], k: int, kind: str) -> list[tuple]:
    out = []
    for number, (label, text) in enumerate(texts):
        own = words(text)
        first, second = _grams(_hashes(own), k)
        marks = _marks(own) if kind == "template" else {}
        if (label, text) in NOTICES:  # the gram that ends the line
            marks[len(first) - 1] = marks.get(len(first) - 1, 0) | _VERSION
        out += [(kind, int(a), int(b), kind, number, label, t, len(first), marks.get(t, 0)) for t, (a, b) in enumerate(zip(first, second))]
        for at, gram in _bars(own) if kind == "template" else ():
            (a,), (b,) = _grams(_hashes(gram), k)
            out.append((kind, int(a), int(b), "bar", number, label, at, len(first), _BAR))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """The licenses that the texts of ``docs`` (doc_id, text; other columns are ignored) name or quote.

    Null and empty texts have no words and no labels.  Rows are told apart by id
    and text, so repeated rows get equal results, one row each.  Returns doc_id,
    n_words, n_base, first_word, last_word, base_labels, labels, score (of the
    best covered license, 1 for a phrase) and spans (label, first word, last word, cover).
    """
    spark, texts = docs.sparkSession, [*TEMPLATES.items(), *VARIANTS, *NOTICES] if templates is None else list(templates.items())
    notices = [i for i, x in enumerate(texts) if x in NOTICES]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = plain.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(1)).alias("k0"), F.xxhash64(F.lit(2), "text", "doc_id").alias("k1"))
    places = keyed.select("k0", "k1", "text").mapInPandas(_positions, "k0 long, k1 long, pos int, p0 long, p1 long, t0 long, t1 long")
    # a few hundred template positions, one row for each hash
    seeds = spark.createDataFrame(_seeds(list(PHRASES.items()), PHRASE_GRAM, "phrase") + _seeds(texts, TEMPLATE_GRAM, "template"), "side string, h0 long, h1 long, kind string, number int, label string, at int, grams int, mark int")
    seeds = seeds.groupBy("side", "h0", "h1").agg(F.collect_list(F.struct("kind", "number", "label", "at", "grams", "mark")).alias("hits"))
    phrase = F.broadcast(seeds.where("side = 'phrase'").select(F.col("h0").alias("p0"), F.col("h1").alias("p1"), F.col("hits").alias("ph")))
    template = F.broadcast(seeds.where("side = 'template'").select(F.col("h0").alias("t0"), F.col("h1").alias("t1"), F.col("hits").alias("th")))
    hits = places.join(phrase, ["p0", "p1"], "left").join(template, ["t0", "t1"], "left").where("pos = -1 or ph is not null or th is not null")
    count = F.array(F.struct(F.lit("words").alias("kind"), F.lit(0).alias("number"), F.lit("").alias("label"), F.lit(-1).alias("at"), F.lit(0).alias("grams"), F.lit(0).alias("mark")))
    none = F.slice(count, 1, 0)
    every = F.when(F.col("pos") == -1, count).otherwise(F.concat(F.coalesce("ph", none), F.coalesce("th", none)))
    votes = hits.select("k0", "k1", "pos", F.col("p0").alias("value"), F.explode(every).alias("h")).select("k0", "k1", "pos", "value", "h.*")
    # votes by diagonal; repeated rows vote for the same places, so places are counted once
    diagonal = (F.col("pos") - F.col("at")).alias("diagonal")
    lines = votes.groupBy("k0", "k1", "kind", "number", "label", "grams", diagonal).agg(F.collect_set("at").alias("ats"), F.max(F.when(F.col("kind") == "words", F.col("value"))).alias("n_words"), F.bit_or("mark").alias("marks"))
    lines = stored(lines)
    bases = lines.where("kind = 'phrase' and size(ats) = grams").select("k0", "k1", F.lit(True).alias("base"), "label", F.col("diagonal").cast("long").alias("start"), (F.col("diagonal") + F.col("grams")).cast("long").alias("end"), F.lit(1.0).alias("cover"))
    # merge neighbouring diagonals of one template, then verify how much of it the span covers, and that no telling word differs
    by = Window.partitionBy("k0", "k1", "number").orderBy("diagonal")
    near = lines.where("kind in ('template', 'bar')").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > slack).cast("int"), F.lit(1))).withColumn("span", F.sum("new").over(by))
    own = F.when(F.col("kind") == "template", F.col("ats"))
    spans = near.groupBy("k0", "k1", "number", "label", "grams", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list(own)))).alias("n"), F.min(F.col("diagonal") + F.array_min(own)).cast("long").alias("start"), F.max(F.col("diagonal") + F.array_max(own) + TEMPLATE_GRAM - 1).cast("long").alias("end"), F.bit_or("marks").alias("marks"))
    # both sides of a joint without the joint: other words stand between them
    sides = F.col("marks").bitwiseAND(_JOINT | _LEFT | _RIGHT) == _LEFT | _RIGHT
    told = ~F.col("number").isin(notices) | (F.col("marks").bitwiseAND(_VERSION) != 0)
    spans = spans.where((F.col("n") > 0) & told & (F.col("marks").bitwiseAND(_BAR) == 0) & ~sides).withColumn("cover", F.col("n") / F.col("grams")).select("k0", "k1", F.lit(False).alias("base"), "label", "start", "end", "cover")
    # of spans that overlap the best covered wins: runs of overlapping spans first, then the spans of a run from the best on
    good, behind = spans.where(F.col("cover") >= cover), Window.partitionBy("k0", "k1").orderBy("start", "end", "label", "cover")
    reach = F.max("end").over(behind.rowsBetween(Window.unboundedPreceding, -1))
    runs = good.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(behind.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("k0", "k1", "run").agg(F.array_sort(F.collect_list(F.struct((-F.col("cover")).alias("less"), (F.col("start") - F.col("end")).alias("shorter"), "start", "end", "label", "cover"))).alias("all"))
    win = F.aggregate("all", F.slice("all", 1, 0), lambda won, x: F.when(F.exists(won, lambda w: (w["start"] <= x["end"]) & (x["start"] <= w["end"])), won).otherwise(F.concat(won, F.array(x))))
    winners = runs.select("k0", "k1", F.explode(win).alias("w")).select("k0", "k1", F.lit(False).alias("base"), "w.label", "w.start", "w.end", "w.cover")
    spans = winners.union(spans.where(F.col("cover") < cover))
    found = bases.union(spans).groupBy("k0", "k1").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(F.col("cover") >= cover, F.col("label"))).alias("labels"),
        F.max("cover").alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("cover") >= cover, F.struct("start", "end", "label", "cover")))).alias("spans"),
    )
    counts = lines.where("kind = 'words'").select("k0", "k1", "n_words")
    named = counts.join(found, ["k0", "k1"], "left")
    out = keyed.select("doc_id", "k0", "k1").join(named, ["k0", "k1"], "left")
    joined = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",").alias(c)
    return out.select("doc_id", F.col("n_words").cast("long"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", joined("base_labels"), joined("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
