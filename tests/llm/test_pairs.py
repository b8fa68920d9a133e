"""Decontamination, hard negatives and alignment against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from quercus.llm import alignment, decontamination, hard_negatives

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, items int, n_words string, hit_start string"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute_hits(docs, bench, width=10):
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for item, t in bench:
            b = words(t)
            k = min(width, len(b))
            wins = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
            for i in range(len(w) - k + 1) if wins else ():
                if tuple(w[i : i + k]) in wins:
                    hit.update(range(i, i + k))
                    items |= {item} - {None}
        out.append((doc_id, len(w), len(hit), sorted(items)))
    return sorted(out, key=repr)


def spans(r):
    return sum(e - s for s, e in zip(r["hit_start"], r["hit_end"]))


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontamination_equals_brute_force(spark, block):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["Ünïcode", "中文" * 9, "x" * 70, "x" * 69 + "y", "don't", "İstanbul"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, line(rng.randrange(1, 25))) for i in range(12)] + [(20, None), (21, ""), (22, "--- ..."), (23, "Single"), (None, "no id at all here"), (24, line(40)), (24, line(14)), (25, "Single")]
    docs = [(i, " ,".join(rng.choice([line(rng.randrange(9)), rng.choice(bench)[1] or "", "other filler words SINGLE"]) for _ in range(rng.randrange(1, 9)))) for i in range(80)]
    docs += [(900, None), (901, ""), (902, "!!"), (3, docs[3][1]), (None, bench[0][1]), (903, ("filler word " * 40 + (bench[15][1] or "") + " ") * 300), (904, "中" * 1_200_000 + " " + bench[15][1])]
    got = decontamination.find(spark.createDataFrame([(i, t, 1, "a", "b") for i, t in docs], DOC), spark.createDataFrame([(i, t, 0) for i, t in bench], "item_id long, text string, doc_id int"), block_pairs=block).collect()
    assert all(spans(r) == r["n_hit"] for r in got)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in got), key=repr) == brute_hits(docs, bench)


def test_decontamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOC), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find(docs, bench).count() == 0
    assert [r["n_hit"] for r in decontamination.find(spark.createDataFrame([(1, "a b", 1, "a", "b")], DOC), bench).collect()] == [0]


def brute_negatives(rows, every=50, positives=5, negatives=3):
    usable = []
    for i, x, label in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        usable.append((i, [math.floor(256 * v) for v in x], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for n, (i, q, label) in enumerate(usable):
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, y)), j is None, j or 0, j, z) for m, (j, y, z) in enumerate(usable) if m != n and len(y) == len(q)]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[4] == label][:positives]:
            found = [s for s in scored if s[4] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:negatives]
            out += [(i, p[3], r + 1, s[3], -p[0], -s[0]) for r, s in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, first, sample", [(2048, 0.8, 1 << 20), (3, 0.2, 200)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, first, sample):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = []
    for i in range(420):
        c = rng.choice(centres)
        rows.append((i if i % 11 else i // 2, [v + rng.gauss(0, 0.4) for v in c], rng.randrange(3)))
    rows += [(1000, [0.5] * 6, 1), (1000, [0.5] * 6, 1), (1001, [0.5] * 6, 2), (1001, [0.5] * 6, 2)] + [(2000 + i, [0.25] * 6, i % 2) for i in range(150)]
    rows += [(3000, None, 1), (3050, [1.0] * 6, None), (3100, [None] + [1.0] * 5, 1), (3150, [math.nan] * 6, 1), (3200, [math.inf] * 6, 2), (None, [0.5] * 6, 2), (None, [0.45] * 6, 1), (3250, [0.0] * 6, 1), (3300, [], 1)]
    rows += [(3350 + i, [1.0, 0.9 - i / 99], i % 4) for i in range(60)] + [(3500, [1.0] * 6, 77), (-50, [-1.0] * 6, -3)] + [(4000 + i, [4000.0 + i % 7, 900.0 * i, 1e5, 3.0], i % 2) for i in range(51)]
    monkeypatch.setattr(hard_negatives, "FIRST", first)
    monkeypatch.setattr(hard_negatives, "SAMPLE_VALUES", sample)
    monkeypatch.setattr(hard_negatives, "PIVOT_ROWS", 64)
    monkeypatch.setattr(hard_negatives, "RUN", 16)
    table = spark.createDataFrame([(i, x, y, 1, "a") for i, x, y in rows], "vec_id long, embedding array<double>, label int, rank int, q string")
    got = sorted((tuple(r) for r in hard_negatives.mine(table, block=block).collect()), key=repr)
    assert got == brute_negatives(rows)


def test_hard_negatives_of_an_empty_table(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert hard_negatives.mine(spark.createDataFrame([], schema)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(0, None, 1), (50, [1e300, 1.0], 1), (51, [1e300, 2.0], 1)], schema)).count() == 0


def brute_alignment(rows):
    """Whole texts through the libraries, and groups and links token by token."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_paths()
    a, b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    alphabet = alignment._byte_alphabet()
    out, held = [], Counter()
    for i, text in rows:
        parts = []
        if text:
            raw = (" " + text).encode()
            ta = [(t, bytes(alphabet[c] for c in a.id_to_token(t))) for t in a.encode(" " + text, add_special_tokens=False).ids]
            tb = [(t, bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("\u2581", " ").encode()) for t in b.encode(text)]
            if b"".join(x for _, x in ta) == raw == b"".join(x for _, x in tb):
                ga, gb, la, lb = [], [], 0, 0
                while ta or tb:
                    if la <= lb:
                        t, x = ta.pop(0)
                        ga, la = [*ga, t], la + len(x)
                    else:
                        t, x = tb.pop(0)
                        gb, lb = [*gb, t], lb + len(x)
                    if la == lb:
                        parts.append((ga, gb, la))
                        ga, gb = [], []
        links = Counter((x, y) for g in parts for x in g[0] for y in g[1])
        held.update(set(links))
        out.append((i, parts, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    digest = lambda parts: hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h, _ in parts).encode()).hexdigest() if parts else ""
    rows = [(i, sum(len(p[0]) for p in parts), sum(len(p[1]) for p in parts), len(parts), sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()), digest(parts)) for i, parts, links in out]
    spans = [(i, s, e, g, h) for i, parts, _ in out for (g, h, e), s in zip(parts, [0, *(p[2] for p in parts)])]
    return sorted(rows, key=repr), sorted(spans, key=repr)


@pytest.mark.parametrize("run, step, block", [(alignment.RUN, alignment.SWEPT, alignment.PAIR_BLOCK), (5, 17, 2000)])
def test_alignment_equals_brute_force(spark, data, run, step, block):
    rng = random.Random(9)
    odd = ["", None, " ", "  a", "a  b", "a\nb\n\nc", "\n", " \nx", "\nx", "x\n", "don't you're it's", "<|endoftext|> <s> </s> <0x41>", "tab\there", "nb\u00a0sp\u2003x", "\u2581lower", "a\u2581b c", "\x00\x01 z", "\x1c x", "日本語のテキスト 中文", "🙂🙂 e\u0301", "x" * 3000, "12 345,678.9", "é" * 50 + " fin", "the the the", "The the\nthe the", "a \nb", "a\n b", "a\r\nb", "\x85 a", "\u2028x y", "foo.\nBar baz"]
    symbols = ["a", "The", "0", " ", "\n", "  ", "é", "\u2581", "'s", "-", "\t", "日", "🙂", ".", "ing"]
    rows = list(enumerate(odd)) + [(100 + i, "".join(rng.choice(symbols) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    rows += [(200, "same text"), (200, "same text"), (None, "no id"), (201, "same text"), (202, " ".join(rng.choice(["word", "other", "alignment", "Übergröße", "x.\ny"]) for _ in range(2000)))]
    rows += [(300 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").limit(12).collect()]
    want, spans = brute_alignment(rows)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, events string, part int")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = alignment.align(table, *alignment.default_paths(), pair_block=block, run=run, step=step).select(*columns)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sorted((tuple(r) for r in alignment.groups(table, *alignment.default_paths(), run=run, step=step).collect()), key=repr) == spans


def test_events_do_not_depend_on_what_is_remembered():
    some = ["a b c", "b\nc a", " x  y", "long" * 30 + " a", None, "c c c"]
    large, small = alignment._Sides(*alignment.default_paths()), alignment._Sides(*alignment.default_paths(), memo=2)
    assert large.cuts
    want = large.events(some)
    assert [small.events([t])[0] for t in some + some] == want + want


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), *alignment.default_paths()).count() == 0
