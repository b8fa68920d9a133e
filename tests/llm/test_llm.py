"""The training-data operators against brute force, on small tables with nulls, ties, repeats and extra columns."""

import importlib.util
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quercus.llm import embedding_dedup, fingerprints, html_text, licenses, mixing, near_dedup, packing, sharding, token_store, tokens, toxicity
from quercus.llm.common import components

ODD = [(1, "One two three four five six."), (2, None), (3, ""), (4, "One two three four five six."), (5, "é ñ ü 中文 don't <|endoftext|> 12 it's"), (6, "word " * 3000), (7, "MIT License. Apache License, CC BY"), (8, "x"), (8, "x"), (None, "no id here")]
SCHEMA = "doc_id long, text string, extra int, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, None if (i or 0) % 3 == 0 else f"s{(i or 0) % 3}") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(n=120, seed=2):
    rng = random.Random(seed)
    out = []
    for fam in range(n // 8):
        base = [f"w{rng.randrange(9999)}" for _ in range(rng.randrange(5, 90))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


def groups(edges, ids):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    want = groups(edges, {x for e in edges for x in e})
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got.get(n, n) == c for n, c in want.items())


def test_sharding(spark, docs, none):
    rows = sharding.shard(docs, 3).collect()
    assert len(rows) == len(ODD) and all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ODD)
    for k in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))
    many = spark.createDataFrame([(i, t) for i, t in enumerate(texts(400))], "doc_id long, text string")
    rows = sharding.shard(many, 4).collect()
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) < 0.1 * sum(loads.values()) / 4
    assert sharding.shard(none, 3).count() == 0


def test_licenses(docs, none):
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(ODD)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    want = Counter()
    for i, t in ODD:
        w = word.findall(lower(t))
        at = [(k, label) for label, p in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows) == want
    assert licenses.scan(none).count() == 0


def test_license_template_with_gap(spark):
    text = "intro words " + licenses.TEMPLATES["bsd"].replace("binary forms", "binary and other forms") + " end"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["labels"] == "bsd" and r["n_base"] == 0 and 0.6 < r["score"] < 1


def test_license_families(spark):
    gnu = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
    cc = "This work is licensed under a Creative Commons Attribution{} International License."
    of = {
        "gpl": gnu.format("program", ""), "lgpl": gnu.format("library", "Lesser "), "agpl": gnu.format("program", "Affero "),
        "cc-by": cc.format(" 4.0"), "cc-by-sa": cc.format("-ShareAlike 4.0"), "cc-by-nc": cc.format("-NonCommercial 4.0"), "cc-by-nd": cc.format("-NoDerivatives 4.0"),
        "cc-by-nc-sa": cc.format("-NonCommercial-ShareAlike 4.0"), "cc-by-nc-nd": cc.format("-NonCommercial-NoDerivatives 4.0"),
    }
    old = [("cc-by", cc.replace("International", "Unported").format(" 3.0")), ("cc-by-sa", cc.replace("International", "Unported").format("-ShareAlike 3.0")), ("cc-by-nd", cc.replace("International", "Unported").format("-NoDerivs 3.0")), ("lgpl", gnu.format("library", "Library ")), ("gpl", gnu.format("program", "").replace("General Public License", "GPL")), ("", cc.format("-Non-Commercial 4.0")), ("", gnu.format("program", "Odd "))]
    cases = [(t, label) for label, t in [*of.items(), *old]]
    # two notices of a family in one text are two licenses
    cases += [(f"{of[a]} and some other words between {of[b]}", ",".join(sorted((a, b)))) for a, b in (("gpl", "lgpl"), ("agpl", "gpl"), ("cc-by", "cc-by-sa"), ("cc-by-nc", "cc-by-nc-nd"))]
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in licenses.scan(spark.createDataFrame([(i, f"Some words. {t} More words.") for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(cases)] == [(t, set(filter(None, label.split(",")))) for t, label in cases]


def mixing_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets of sources by repeated resharing: null last, none above ``most`` times its size."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def mixing_rows(spark):
    some = [(i, t, None if i % 7 == 0 else f"s{i % 5}") for i, t in enumerate(texts(400))]
    return some + [some[3]] * 9 + [(None, "an id is missing here", "s1")] * 2 + [(900, " ".join(f"w{k}" for k in range(5000)), "s9"), (901, " \t", "s9"), (902, None, "s2")]


def test_mixing(spark, docs, none):
    made = mixing_rows(spark)
    many = spark.createDataFrame(made, "doc_id long, text string, source string")
    for df in (docs, many):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(df).collect()), key=str)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
        assert all(sum(int(x.split(":")[1]) for x in r["shards"].split(",") if x) == r["taken"] for r in rows)
    size = lambda t: len((t or "").split())
    sizes, took = Counter(), Counter()
    for _, t, s in made:
        sizes[s] += size(t)
    for r in rows:
        took[r["source"]] += r["taken"]
    want = mixing_targets(sizes)
    assert Counter((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6)) for r in rows) == Counter((i, s, size(t), sizes[s], round(want[s], 6)) for i, t, s in made)
    assert all(abs(took[s] - t) <= 64 + 0.01 * t for s, t in want.items())
    # output shards: no shard takes much more of the words than its draw allows
    shards = Counter()
    for r in rows:
        for x in filter(None, r["shards"].split(",")):
            shards[int(x.split(":")[0])] += int(x.split(":")[1])
    assert len(shards) > 50 and max(shards.values()) < 4 * sum(shards.values()) / 64
    assert mixing.mix(none).count() == 0


def test_mixed_documents(spark):
    """Pieces are stretches of their text, and add up to what op3 takes of it."""
    made = mixing_rows(spark)
    df = spark.createDataFrame(made, "doc_id long, text string, source string").selectExpr("*", "'x' as lang", "0L as n_chars")
    out = mixing.mixed_documents(df).collect()
    assert all(any(r["text"] in t for i, t, s in made if i == r["doc_id"] and s == r["source"] and t) for r in out)
    assert all(r["n_chars"] == len(r["text"]) and r["lang"] == "x" and 0 <= r["shard"] < 64 for r in out)
    sizes, took = Counter(), Counter()
    for _, t, s in made:
        sizes[s] += len((t or "").split())
    for r in out:
        took[r["source"]] += len(r["text"].split())
    assert all(abs(took[s] - t) <= 64 + 0.01 * t for s, t in mixing_targets(sizes).items())
    large = mixing.mixed_documents(df, block_words=1024).collect()
    assert sum(any(r["text"] == t for i, t, _ in made if i == r["doc_id"]) for r in large) > 0.8 * len(large)
    assert mixing.cut("  a b\tc\n d ", [(1, 2), (3, 1)]) == ["b\tc", "d"] and mixing.cut("a", [(0, 1)]) == ["a"]
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_mixing_permutes():
    for n in (1, 2, 7, 64, 100):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 5, np.uint64))) == list(range(n))


def test_html():
    chain = html_text.default_chain()
    fresh = html_text.labelled_pages(60, 77)
    right = sum(int((chain.decode(f) == np.array(s)).sum()) for f, s in fresh)
    assert right / sum(len(s) for _, s in fresh) > 0.97
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy.</div><article><h1>Head &amp; line</h1><p><b>First  text\nhere.<br><p>Second &eacute; one.</article><section class="comments"><p>Nice post. I like it.</p></section><footer>&copy; x</footer>'
    assert html_text.main_text(page, chain) == "Head & line\n\nFirst text here.\n\nSecond é one."


@pytest.mark.parametrize("inner", [
    "<video-player src=x><p>article</p></video-player>", "<audio-player></audio-player><p>article</p>", "<svg-icon></svg-icon><p>article</p>", "<title-bar></title-bar><p>article</p>", "<template-x><p>article</p></template-x>",
    "<svg class=i /><p>article</p>", '<svg class="i"/><p>article</p><svg><text>x</text></svg>', "<math/><p>article</p>", "<svg><title/></svg><p>article</p>", "<svg><title>Icon</svg><p>article</p>",
    "<svg><path><p>article</p>", "<video src=x><p>article</p><video>none</video>", "<noscript><p>article</p>", "<iframe src=x><p>article</p>", "<canvas><p>article</p>", "<template><p>article</p>",
    "<p><math><mi>article</mi></math></p>", "<object data=x><p>article</p></object>", "<iframe src=/a/>none</iframe><p>article</p>",
    "<noscript>no<p>x</p></noscript><template>a<template>b</template>c</template><script>'<p>'</script><style>s</style><textarea>t</textarea><p>article</p>",
])
def test_html_skips_no_article(inner):
    assert [b.text for b in html_text.leaf_blocks(f"<head><title>T</title></head><body><p>a</p>{inner}<p>b</p>")] == ["a", "article", "b"]


def test_html_rows(spark):
    rows = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p"), (3, "u", "<p"), (4, "u", "<article><p>Some words of a text. And more of them.</p></article>")], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(rows).orderBy("page_id").collect()]
    assert got == [(1, "", 0), (2, "", 0), (3, "", 0), (3, "", 0), (4, "Some words of a text. And more of them.", 39)]


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 16))
    vectors = [(b + rng.standard_normal(16) * 0.12).tolist() for b in np.repeat(base, 12, axis=0)]
    vectors += [vectors[0]] * 5 + [[0.0] * 16, None, [float("nan")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows = embedding_dedup.near_vectors(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"), recall=0.9999).collect()
    ok = [i for i, v in enumerate(vectors) if v and np.isfinite(v).all() and any(v)]
    edges = [(i, j) for i in ok for j in ok if i < j and len(vectors[i]) == len(vectors[j]) and np.dot(vectors[i], vectors[j]) / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[j]) >= 0.9]
    want, links = groups(edges, range(len(vectors))), Counter(x for e in edges for x in e)
    assert {r["vec_id"]: (r["component_id"], r["n_links"], r["kept"]) for r in rows} == {i: (want[i], links[i], want[i] == i) for i in want}


@pytest.mark.parametrize("width", [1, 6])
def test_near_duplicates(spark, width):
    rows = list(enumerate(texts(240)))
    sets = {i: {tuple(w[k : k + 4]) for w in [t.split()] for k in range(max(1, len(w) - 3))} for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(edges, sets)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neighbours=width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in want}


def test_near_duplicates_odd(docs, none):
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == sorted(str(x) for x in [(1, 1), (2, 2), (3, 3), (4, 1), (5, 5), (6, 6), (7, 7), (8, 8), (8, 8), (None, None)])
    assert near_dedup.near_duplicates(none).count() == 0


def test_fingerprints(spark, none):
    import hashlib

    rows = [(i, t) for i, t in enumerate(texts(80))] + [(200, None), (201, ""), (202, "a\nb\n" * 500)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), buckets=7).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    cut = lambda t: {p for line in t.split("\n") for p in re.findall(".{1,%d}" % fingerprints.PIECE, line)}
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_edited"] == pytest.approx(likeness(cut(t), cut(edited)))
        assert got[i]["near_next"] == pytest.approx(likeness(cut(t), cut(after)))
    assert got[200]["fingerprint"] == got[201]["fingerprint"]
    assert fingerprints.fingerprints(none).count() == 0


def _ids(text):
    from tokenizers import Tokenizer

    _ids.tokenizer = getattr(_ids, "tokenizer", None) or Tokenizer.from_file(tokens.default_tokenizer())
    return _ids.tokenizer.encode(text or "", add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    pieces = Counter()
    for i, t in ODD:
        ids = [*_ids(t), 1]
        for k in range(0, len(ids), 2048):
            pieces[i, k, len(ids[k : k + 2048]), _crc(ids[k : k + 2048]), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == pieces
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack(none).count() == 0


def test_token_store(spark, docs, none, tmp_path):
    path = f"file://{tmp_path}/t"
    token_store.write_shards(docs, path, segment_tokens=50)
    rows = sorted(token_store.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == list(np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter((i, len(_ids(t)) + 1, _crc([*_ids(t), 2])) for i, t in ODD)
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 8]
    token = _ids("word")[0]
    assert sum(r["n"] for r in token_store.lookup(spark, path, token).collect()) == sum(_ids(t).count(token) for _, t in ODD)
    first = spark.read.parquet(path).orderBy("shard", "segment").first()
    assert token_store.token_at(spark, path, first["shard"], first["segment"], 0) is not None and token_store.token_at(spark, path, -1, 0, 0) is None
    token_store.write_shards(none, f"file://{tmp_path}/n")
    assert token_store.read_documents(spark, f"file://{tmp_path}/n").count() == 0


@pytest.mark.parametrize("n", [0, 1, 700, 65_536, 200_000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(1).integers(0, 40, n).astype(np.uint32)
    m = token_store.WaveletMatrix(token_store.WaveletMatrix.build(ids))
    assert (m.decode() == ids).all() and all(m.access(i) == ids[i] for i in range(0, n, max(1, n // 50)))
    assert len(m._blocks) <= token_store.BLOCKS_KEPT
    for v in (0, 7, 39, 63, 5000):
        at = np.flatnonzero(ids == v)
        assert m.count(v) == len(at) and m.count(v, n // 2) == (at < n // 2).sum()
        assert [m.locate(v, k) for k in range(0, len(at), max(1, len(at) // 40))] == at[:: max(1, len(at) // 40)].tolist() and m.locate(v, len(at)) == -1


def test_wavelet_matrix_reads_few_blocks():
    ids = np.random.default_rng(2).integers(0, 49_000, 1_000_000).astype(np.uint32)
    m = token_store.WaveletMatrix(token_store.WaveletMatrix.build(ids))
    assert m.access(777_777) == ids[777_777] and len(m._blocks) <= m.width


def test_encoder_equals_library():
    rng = random.Random(8)
    alphabet = "aabcdeE  é'sñ.,1 2\n\t\x1c-don't İ ſ K中́<|x|>ß"
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 90))) for _ in range(400)] + [t or "" for _, t in ODD]
    ids, sizes = tokens.encoder(tokens.default_tokenizer()).encode(some)
    at = 0
    for t, n in zip(some, sizes):
        assert ids[at : at + n].tolist() == _ids(t), repr(t)
        at += n


def test_toxicity(spark, none):
    rng = random.Random(3)
    plain = lambda: [f"{rng.choice('abcdefgh')}{rng.choice(['on', 'er', 'ing', 'ed'])}{rng.choice(['', 'the', 'an'])}" for _ in range(rng.randrange(20, 120))]
    rows = []
    for i in range(400):
        w = plain()
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["scoundrel", "wretch", "villain"])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    got = toxicity.score(df, model).collect()
    held = [r for r in got if toxicity.crc_remainder(r["doc_id"]) == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in held]) > 0.9
    odd = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, text string"), model).collect()
    assert all(0 <= r["score"] < 0.5 for r in odd)
    assert toxicity.score(none, toxicity.train(none, df.select("doc_id", "toxic").limit(0))).count() == 0


def test_toxicity_shares_and_long_texts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        w = [f"{rng.choice('abcdefgh')}{rng.choice(['on', 'er', 'ing', 'ed'])}{rng.choice(['', 'the', 'an'])}" for _ in range(rng.randrange(20, 60))]
        if i % 10 < (2 if i % 10 == 0 else 1) or rng.random() < 0.02:  # a few ordinary texts have the words too
            w[3:5] = [rng.choice(["scoundrel", "wretch", "villain"]), "villain"]
        rows.append((i, " ".join(w * (40 if i % 7 == 0 else 1)), int(i % 10 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen, logistic = [], toxicity._logistic
    toxicity._logistic = lambda x, y: seen.append((x, y)) or logistic(x, y)
    try:
        few = toxicity.train(df, df.select("doc_id", "toxic"), sample_docs=60, sample_chars=600)
    finally:
        toxicity._logistic = logistic
    # as many of both classes in the sample, and yet the share of all training rows in the intercept
    weights, bias = logistic(*seen[0])
    true = [r for r in rows if toxicity.crc_remainder(r[0]) != 0]
    share = sum(r[2] for r in true) / sum(1 - r[2] for r in true)
    assert seen[0][1].mean() == 0.5 and few.bias == pytest.approx(bias + np.log(share))
    # long texts are calibrated on, whole
    lengths = [len(toxicity.windows(r[1])) for r in true if r[0] % 7 == 0]
    x = seen[0][0] * few.scale + few.mean
    shares = np.expm1(x[:, len(toxicity.LEVELS)]) / 1000
    assert (np.expm1(x[:, 0])[shares > 0] / shares[shares > 0]).max() >= min(lengths)


def test_toxicity_bounds():
    text = "".join(chr(97 + i % 26) + str(i) for i in range(5000))
    cut = toxicity.excerpt(text, 2000)
    assert toxicity.excerpt(text[:2000], 2000) == text[:2000] and len(cut.replace("\n", "")) <= 2000
    assert all(p in text for p in cut.split("\n")) and any(text.index(p) > len(text) // 2 for p in cut.split("\n"))
    few = toxicity._lowest([b"%d" % i for i in range(1000)], 100)
    assert len(few) == 100 and int(few[-1]) > 800


def test_pipeline(spark, data):
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("no pipeline here")
    import corpus_pipeline as c

    documents = spark.read.parquet(f"{data}/documents.parquet")
    kept = c.near_dedup(spark, documents, data)
    assert kept.columns == documents.columns
    sets = {r["doc_id"]: {tuple(w[k : k + 5]) for w in [r["text"].lower().split()] for k in range(max(1, len(w) - 4))} for r in documents.collect()}
    want = groups([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], sets)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, top in want.items() if i == top}
    assert c.run(spark, data).count() > 0
    assert "pipeline" in sys.modules["corpus_pipeline"].__name__


def brute_components(sets):
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    return groups(edges, sets)


def shingle_sets(rows, k):
    return {i: {tuple(w[j : j + k]) for w in [(t or "").lower().split()] if w for j in range(max(1, len(w) - k + 1))} for i, t in rows}


def crowd(n=500, seed=9):
    """One passage many times, each with enough changes that members are 0.5 to 0.9 alike."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(220)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice((2, 4, 6, 9))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        out.append((i, " ".join(w)))
    return out


def test_near_duplicates_crowd(spark):
    rows = crowd()
    want = brute_components(shingle_sets(rows, 4))
    assert 20 < len(set(want.values())) < 400
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neighbours=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_block_links_are_few():
    rng = np.random.default_rng(1)
    base = np.arange(300)
    frame = lambda first: __import__("pandas").DataFrame({"id": np.arange(first, first + 200), "comp": np.arange(first, first + 200), "n_set": 300, "hs": [np.unique(np.where(rng.random(300) < 0.02, rng.integers(1000, 9999, 300), base)) for _ in range(200)]})
    got = near_dedup._blocks(frame(0), frame(1000), 80)
    assert 200 < len(got) < 400 and set(got["dst"]) == {0}
    assert len(near_dedup._blocks(frame(0).iloc[:0], frame(0), 80)) == 0


def test_one_of_each(spark):
    a, b = "one two three four five six seven", "other words are here to be read by all"
    rows = [(3, a, 1), (5, a, 1), (5, b, 1), (5, b, 1), (None, a, 1), (None, "alone without any id at all here", 2), (7, None, 1), (8, "", 1), (7, None, 1), (9, b, 2)]
    got = near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, k0 int"), words=5).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[0], rows[2], rows[5], rows[6], rows[8], rows[7]]))


def test_near_duplicates_short_stretches(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "ROWS_PER_TASK", 12)  # stretches shorter than the window
    rows = list(enumerate(texts(80)))
    want = brute_components(shingle_sets(rows, 4))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_long_words_and_texts():
    rng = random.Random(3)
    long = ["x" * 1_000_000, "=" * 140_000, "ab1" * 30_000, "a" * 65_536 + " b", "q" * 65_535 + "-" * 65_537, " ".join(f"w{rng.randrange(300)}" for _ in range(900_000)), "é" * 80_000, "x" * 33 + " " + "x" * 32, ""]
    ids, sizes = tokens.BatchEncoder(tokens.default_tokenizer()).encode(long)
    at = 0
    for t, n in zip(long, sizes):
        assert ids[at : at + n].tolist() == _ids(t), t[:20]
        at += n


def test_encoder_small_table():
    """Words that meet in a table of few places, over many batches, keep their own ids."""
    rng = random.Random(4)
    small = tokens.BatchEncoder(tokens.default_tokenizer(), slots_log2=6)
    for _ in range(20):
        some = [" ".join(f"{rng.choice('abc')}{rng.randrange(200)}\x00"[: rng.randrange(1, 6)] for _ in range(60)) for _ in range(5)]
        ids, sizes = small.encode(some)
        assert ids.tolist() == [x for t in some for x in _ids(t)]


def test_other_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    some = ["Some Text, with Capitals  and  spaces\n", None, "", "don't 12 é <|endoftext|>"]
    ids, sizes = tokens.encoder(path).encode(some)
    assert not tokens.encoder(path).one.by_word and tokens.encoder(tokens.default_tokenizer()).one.by_word
    assert ids.tolist() == [x for t in some for x in Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids] and sizes.tolist()[1:3] == [0, 0]


def test_packing_pads_little(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(int(rng.lognormvariate(5, 1))))) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(12), open_windows=32).groupBy("sequence_id").sum("length").collect()
    total = sum(r[1] for r in got)
    assert total == sum(len(_ids(t)) + 1 for _, t in rows) and len(got) * 2048 < 1.02 * total + 2048


def test_vectors_that_share_an_id(spark):
    rng = np.random.default_rng(21)
    base = rng.normal(size=(40, 8))
    rows = [(int(rng.integers(0, 60)), (base[rng.integers(0, 40)] + rng.normal(size=8) * 0.12 * rng.integers(0, 3)).tolist()) for _ in range(500)] + [(1, [1.0] + [0.0] * 7), (1, [0.95, 0.31] + [0.0] * 6), (1, [1.0] + [0.0] * 7)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    comp = groups([(i, j) for i, j in zip(*np.nonzero(near)) if i < j], range(len(rows)))
    least = {}
    for i, c in comp.items():
        least[c] = min(least.get(c, 10**9), rows[i][0])
    want = sorted((rows[i][0], int(near[i].sum()), least[comp[i]]) for i in range(len(rows)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("cls", "rep", "n", "e")})
    got = embedding_dedup.near_vectors(df, recall=0.999999)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == want
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_recall_of_links_at_the_shipped_setting(spark):
    rng = np.random.default_rng(22)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.normal(size=(1500, 64))
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    c = rng.uniform(0.9005, 0.93, 1500)[:, None]
    other = c * base + np.sqrt(1 - c * c) * off
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, other]))]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.agg(F.sum("n_links")).first()[0] / 2 >= 0.9 * 1500


def test_notices_of_documents(spark, data):
    """Labels of all documents against a plain search for notices and phrases."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = ["Licensed under CC BY-NC 4.0.", "licensed under CC BY-NC-SA 4.0", "Licensed under CC BY 4.0", "Licensed under the GNU General Public License, version 9", "licensed under the GNU Lesser General Public License, version 3", "This work is licensed under the GNU General Public License, version 2 or so", "SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: zlib", "Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 1.0"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, "Before it. " + t + " And after.") for i, t in enumerate(extra)], "doc_id long, text string"))
    inside = lambda w, phrase: any(w[i : i + len(phrase)] == phrase for i in range(len(w) - len(phrase) + 1))
    want = {}
    for r in df.collect():
        w = [x.decode() for x in licenses.words(r["text"])]
        named = {label for label, p in licenses.PHRASES.items() if inside(w, p.split())}
        want[r["doc_id"]] = ",".join(sorted(named | {label for label, p in licenses.NOTICES if inside(w, p.split())}))
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert {i: r["labels"] for i, r in got.items()} == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) for r in got.values())
    assert sum(r["labels"] != r["base_labels"] for r in got.values()) > len(extra) // 2
