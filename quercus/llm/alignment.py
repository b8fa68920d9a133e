"""Two tokenizers' tokens of the same texts, aligned by their byte offsets.

A's and B's tokens of a text become end events.  Events of both sides go into
one table, in short runs of one side (token ids and lengths, and the offset
where the run begins); it is repartitioned by document, sorted within
partitions by offset, and streamed through a machine that knows only the
events behind the last common end.  Where both sides end, a group closes: its
ids go into the digest, and all its A-B pairs are links.

A text is cut where neither tokenizer can merge across, before a single space
or line break between other characters, and the events of a stretch that a
worker has met are kept; texts where this isn't proven are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

if TYPE_CHECKING:
    from tiktoken import Encoding

#: An event: the token's id in the lower bits, its bytes above.
ID_BITS = 20
_ID = np.uint32((1 << ID_BITS) - 1)
#: Events of a run, events swept at a time (links: eight times as many), bytes of text encoded at a time.
RUN, SWEPT, PART = 1024, 1 << 17, 1 << 19
#: Stretches a worker remembers for each side, and their longest length; id pairs of a block of counts.
MEMO, MEMO_CHARS, PAIR_BLOCK = 150_000, 48, 2_000_000
#: Longest stretch that is encoded together with others, and how many the second library gets at a time.
TOGETHER, GROUP = 1000, 200
#: Fixed value: how byte-level vocabularies of this kind split a text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_EVENT = "doc_id long, h long, part int, nth int, start long, side int, events binary"
_DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_GROUP = "doc_id long, start long, end long, a array<long>, b array<long>"
_OFFSET = np.int64(40)


def _byte_alphabet() -> dict[str, int]:
    """The bytes that the characters of byte-level vocabularies stand for."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Sides:
    """Both tokenizers, and the events of the stretches met so far."""

    def __init__(self, a_path: str, b_path: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        alphabet = _byte_alphabet()
        self.a_bytes = {i: bytes(alphabet.get(c, 0x3F) for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        if max(max(self.a_bytes), len(pieces)) > _ID or max(map(len, [*self.a_bytes.values(), *self.b_bytes.values()])) >= 1 << (32 - ID_BITS):
            raise ValueError("vocabulary too large, or tokens too long, for events of 32 bits")
        self.space = self.b.piece_to_id("▁")
        self.cuts = self._cuts(a_path, b_path, pieces)
        self.ranked = self._ranked(a_path) if self.cuts else None
        self.sizes = [np.zeros(max(held) + 1, dtype=np.uint32) for held in (self.a_bytes, self.b_bytes)]
        for sizes, held in zip(self.sizes, (self.a_bytes, self.b_bytes)):
            sizes[list(held)] = [len(x) for x in held.values()]
        self.memo = memo
        self.met: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.odd: set[str] = set()

    @staticmethod
    def _cuts(a_path: str, b_path: str, pieces: list[str]) -> bool:
        """Whether no token of either side reaches over the places where texts are cut."""
        with open(a_path, encoding="utf-8") as f:
            rules = json.load(f)
        splits = rules.get("pre_tokenizer") or {}
        plain = rules.get("normalizer") is None and splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space")
        try:
            from sentencepiece import sentencepiece_model_pb2 as model
        except ImportError:
            return False
        with open(b_path, "rb") as f:
            spec = model.ModelProto.FromString(f.read())
        bpe = spec.trainer_spec.model_type == 2 and not spec.trainer_spec.treat_whitespace_as_suffix
        same = spec.normalizer_spec.name == "identity" and spec.normalizer_spec.add_dummy_prefix and not spec.normalizer_spec.remove_extra_whitespaces
        return bool(plain and bpe and same and not any("\n" in p or re.search("[^▁]▁", p) for p in pieces))

    def _ranked(self, a_path: str) -> Encoding | None:
        """The same vocabulary as ranks, where merges are numbered in their order and every token is its own encoding; it is faster over many words."""
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][x + y] for x, y in pairs]
        plain = made == list(range(256, 256 + len(made))) and not any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges", "byte_fallback"))
        if not plain or any([t.id for t in self.a.model.tokenize(token)] != [i] for token, i in model["vocab"].items() if i < 256 + len(made)):
            return None
        from tiktoken import Encoding

        return Encoding("a", pat_str=_SPLIT, mergeable_ranks={x: i for i, x in self.a_bytes.items() if i < 256 + len(made)}, special_tokens={})

    def _together(self, texts: list[str]) -> list[list[bytes]] | None:
        """Both sides' events of stretches that are encoded many at a time; none where that goes wrong.

        Each text that is encoded starts with the stretch `` x``, which is left out again.
        """
        raw = "".join(texts)
        whole = raw.encode()
        ends = np.cumsum([0, *map(len, texts)] if raw.isascii() else [0, *(len(t.encode()) for t in texts)])
        a_ids = self.ranked.encode_ordinary(" x" + raw) if self.ranked else self.a.encode_batch_fast([" x" + raw], add_special_tokens=False)[0].ids
        parts = ["x" + "".join(texts[i : i + GROUP]) for i in range(0, len(texts), GROUP)]
        b_ids = self.b.encode(parts, num_threads=1)
        out, first = [], (self.a.encode(" x", add_special_tokens=False).ids, self.b.encode("x"))
        if len(first[0]) != 1 or len(first[1]) != 1 or a_ids[:1] != first[0] or any(i[:1] != first[1] for i in b_ids):
            return None
        for ids, sizes, held in ((a_ids[1:], self.sizes[0], self.a_bytes), ([x for i in b_ids for x in i[1:]], self.sizes[1], self.b_bytes)):
            ids = np.array(ids, dtype=np.uint32)
            at = np.concatenate([[0], np.cumsum(sizes[ids])])
            cuts = np.searchsorted(at, ends)
            if at[-1] != ends[-1] or (at[cuts] != ends).any() or b"".join(map(held.__getitem__, ids.tolist())) != whole:
                return None
            data, cuts = (sizes[ids] << np.uint32(ID_BITS) | ids).astype("<u4").tobytes(), (4 * cuts).tolist()
            out.append([data[i:j] for i, j in zip(cuts, cuts[1:])])
        return out

    def _learn(self, names: list[str], texts: list[str]) -> None:
        """Events of stretches; ``texts`` are what stands in the document, with the space before."""
        if len(self.met[0]) > self.memo:
            self.forget()
        plain = [i for i, (n, t) in enumerate(zip(names, texts)) if n[0] != "\x00" and len(t) <= TOGETHER and "▁" not in t]
        found = self._together([texts[i] for i in plain]) if plain and self.cuts else None
        if found:
            for met, events in zip(self.met, found):
                met.update(zip([names[i] for i in plain], events))
        done = set(plain) if found else set()
        rest = [i for i in range(len(names)) if i not in done]
        if rest:
            self._singly([names[i] for i in rest], [texts[i] for i in rest])

    def forget(self) -> None:
        self.met[0].clear()
        self.met[1].clear()
        self.odd.clear()

    def _singly(self, names: list[str], texts: list[str]) -> None:
        """Events of stretches, each encoded by itself; those that either side's tokens don't spell are noted."""
        a_ids = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b_ids = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        for name, text, a, b in zip(names, texts, a_ids, b_ids):
            if text[0] != " ":  # the library puts a space before every text
                a, b = a, b[1:] if b[:1] == [self.space] else b
            raw = text.encode()
            sides = [b"".join(map(held.__getitem__, ids)) for held, ids in ((self.a_bytes, a), (self.b_bytes, b))]
            if sides != [raw, raw]:
                self.odd.add(name)
            for met, sizes, ids in zip(self.met, self.sizes, (a, b)):
                ids = np.array(ids, dtype=np.uint32)
                met[name] = (sizes[ids] << np.uint32(ID_BITS) | ids).astype("<u4").tobytes()

    def events(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """Both sides' events of every text; none where the text has no tokens."""
        split, fresh = [], {}
        for text in texts:
            if not text:
                split.append(None)
                continue
            words = text.split() if self.cuts else []
            if words and " ".join(words) == text.replace("\n", " "):
                names = words if "\n" not in text else text.replace("\n", " \n").split(" ")
                look = set(names).difference(self.met[0])
                fresh |= {w: w if w[0] == "\n" else " " + w for w in look if w not in fresh}
            else:  # names of their own, as a line break may follow the space before the text
                names = ["\x00" + s for s in (_CUT.split(" " + text) if self.cuts else [" " + text])]
                fresh |= {w: w[1:] for w in set(names).difference(self.met[0], fresh)}
            split.append(names)
        if fresh:
            known = {w for names in split if names for w in names} if len(self.met[0]) > self.memo else ()
            if known:  # what is cleared is learnt again where it is needed
                fresh = {w: w[1:] if w[0] == "\x00" else w if w[0] == "\n" else " " + w for w in known}
            self._learn(list(fresh), list(fresh.values()))
        out = []
        for names in split:
            ok = names and (not self.odd or self.odd.isdisjoint(names))
            out.append((b"".join(map(self.met[0].__getitem__, names)), b"".join(map(self.met[1].__getitem__, names))) if ok else None)
        for name in fresh:
            if len(name) > MEMO_CHARS:
                del self.met[0][name], self.met[1][name]
                self.odd.discard(name)
        return out


_SIDES: dict[tuple[str, str], _Sides] = {}


def _events(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, length: int) -> Iterator[pa.RecordBatch]:
    """Runs of events of every row.  A row's key is its id, its text's hash, the task, and which of equal rows of the task it is."""
    sides = _SIDES.setdefault((a_path, b_path), None) or _Sides(a_path, b_path)
    _SIDES[a_path, b_path] = sides
    part, seen = TaskContext.get().partitionId(), Counter()
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PART)))
            ids, texts = batch["doc_id"].slice(lo, hi - lo).to_pylist(), batch["text"].slice(lo, hi - lo).to_pylist()
            lo = hi
            doc, h, nth, start, side, runs = [], [], [], [], [], []
            for i, text, found in zip(ids, texts, sides.events(texts)):
                key = i, xxhash.xxh3_64_intdigest((text or "").encode()) - (1 << 63)
                for s, raw in enumerate(found or (b"",)):
                    at = 0
                    for k in range(0, max(1, len(raw)), 4 * length):
                        run = raw[k : k + 4 * length]
                        doc.append(i), h.append(key[1]), nth.append(seen[key]), start.append(at), side.append(s), runs.append(run)
                        if len(raw) > 4 * length:
                            at += int((np.frombuffer(run, dtype="<u4") >> np.uint32(ID_BITS)).sum())
                seen[key] += 1
            columns = [pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array([part] * len(doc), pa.int32()), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(side, pa.int32()), pa.array(runs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "part", "nth", "start", "side", "events"])
    sides.forget()  # the worker's next task may be of another kind


def swept(docs: DataFrame, a_path: str, b_path: str, run: int = RUN) -> DataFrame:
    """The event table of ``docs`` (doc_id, text), together by document and sorted by offset, in runs of ``run`` events."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = ["doc_id", "h", "part", "nth"]
    return rows.mapInArrow(lambda it: _events(it, a_path, b_path, run), _EVENT).repartition(*key).sortWithinPartitions(*key, "start", "side")


class _Open:
    """The document a sweep is in: counts so far, the digest, and the events behind the last common end."""

    def __init__(self, key: tuple):
        self.key, self.n, self.digest = key, np.zeros(4, np.int64), hashlib.sha256()
        self.tail = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]
        self.upto, self.pairs = 0, []


class _Sweep:
    """Streams sorted runs, some at a time; gives a row for each document, or for each group."""

    def __init__(self, groups: bool, links: int):
        self.groups, self.links, self.open, self.out = groups, links, None, []
        self.digits = np.zeros((0, 8), np.uint8)
        self.length = np.zeros(0, np.int64)

    def _written(self, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids with the character before each, one after the other, and where each ends."""
        if len(ids) and ids.max() >= len(self.length):
            n = int(ids.max()) + 1
            text = [str(i) for i in range(n)]
            self.length = np.array([len(t) + 1 for t in text])
            self.digits = np.array([list(t.ljust(7).encode()) for t in text], dtype=np.uint8)
            self.digits = np.concatenate([np.zeros((n, 1), np.uint8), self.digits], axis=1)
        rows, size = self.digits[ids], self.length[ids]
        rows[:, 0] = before
        return rows[np.arange(8)[None, :] < size[:, None]], np.cumsum(size)

    def add(self, keys: list[tuple], docs: np.ndarray, start: np.ndarray, side: np.ndarray, runs: list[bytes]) -> None:
        """Takes rows in order; ``docs`` numbers the documents of these rows from 0, ``keys`` are theirs."""
        first = self.open if self.open and self.open.key == keys[0] else None
        if self.open and not first:
            self.close(self.open)
        held = [first or _Open(keys[0]), *map(_Open, keys[1:])]
        size = np.array([len(r) // 4 for r in runs], dtype=np.int64)
        event = np.frombuffer(b"".join(runs), dtype="<u4")
        long = (event >> np.uint32(ID_BITS)).astype(np.int64)
        end = np.cumsum(long)
        row_end = np.cumsum(size)
        before = np.concatenate([[0], end])[row_end - size]
        end = end - np.repeat(before - start - (docs.astype(np.int64) << _OFFSET), size)
        of_side = np.repeat(side, size)
        ends, ids = [], []
        for s in range(2):
            tail = held[0].tail[s]
            mine = of_side == s
            ends.append(np.concatenate([tail[0], end[mine]]))
            ids.append(np.concatenate([tail[1], (event[mine] & _ID).astype(np.int64)]))
        at = np.searchsorted(ends[1], ends[0])
        both = ends[0][(at < len(ends[1])) & (ends[1][np.minimum(at, max(0, len(ends[1]) - 1))] == ends[0])] if len(ends[1]) else ends[1]
        group = [np.searchsorted(both, e) for e in ends]
        shut = [g < len(both) for g in group]
        for s in range(2):  # of the last document what isn't closed yet is kept
            shut[s] &= (both[np.minimum(group[s], max(0, len(both) - 1))] >> _OFFSET == ends[s] >> _OFFSET) if len(both) else False
            rest = ~shut[s]
            held[-1].tail[s] = ends[s][rest] & ((1 << int(_OFFSET)) - 1), ids[s][rest]
        (ga, gb), (ia, ib) = [g[k] for g, k in zip(group, shut)], [i[k] for i, k in zip(ids, shut)]
        na, nb = np.bincount(ga, minlength=len(both)), np.bincount(gb, minlength=len(both))
        doc = (both >> _OFFSET).astype(np.int64)
        sums = np.zeros((len(held), 4), np.int64)
        for k, x in enumerate((na, nb, np.ones(len(both), np.int64), na * nb)):
            np.add.at(sums[:, k], doc, x)
        if self.groups:
            self._rows(held, both, doc, na, nb, ia, ib)
        else:
            self._digest(held, doc, na, nb, ga, gb, ia, ib)
            self._links(held, doc, na, nb, ga, ia, ib)
        for k, x in enumerate(held):
            x.n += sums[k]
        for x in held[:-1]:
            self.close(x)
        self.open = held[-1]

    def _digest(self, held: list[_Open], doc: np.ndarray, na: np.ndarray, nb: np.ndarray, ga: np.ndarray, gb: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> None:
        upto_a, upto_b = np.cumsum(na), np.cumsum(nb)
        place_a, place_b = np.arange(len(ga)) + (upto_b - nb)[ga], np.arange(len(gb)) + upto_a[gb]
        all_ids, before = np.empty(len(ga) + len(gb), np.int64), np.full(len(ga) + len(gb), 0x2C, np.uint8)
        all_ids[place_a], all_ids[place_b] = ia, ib
        begin = upto_a + upto_b - na - nb
        before[begin], before[begin + na] = 0x3B, 0x7C
        text, ends = self._written(all_ids, before)
        view = memoryview(np.ascontiguousarray(text)).cast("B")
        per = np.zeros(len(held), np.int64)
        np.add.at(per, doc, na + nb)
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])].tolist()
        for x, lo, hi in zip(held, cuts, cuts[1:]):
            x.digest.update(view[lo + (x.n[2] == 0 and hi > lo) : hi])

    def _links(self, held: list[_Open], doc: np.ndarray, na: np.ndarray, nb: np.ndarray, ga: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> None:
        """Distinct id pairs of each document and how often each is linked."""
        times, begin = nb[ga], (np.cumsum(nb) - nb)[ga]
        upto = np.cumsum(times)
        lo = 0
        while lo < len(ga):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + self.links)))
            n = times[lo:hi]
            b = ib[np.repeat(begin[lo:hi] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            key, count = np.unique(np.repeat(doc[ga[lo:hi]] << (2 * ID_BITS) | ia[lo:hi] << ID_BITS, n) | b, return_counts=True)
            of = key >> (2 * ID_BITS)
            cuts = np.flatnonzero(np.diff(of, prepend=-1))
            for c, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)]):
                held[of[c]].pairs.append((key[c:e] & ((1 << 2 * ID_BITS) - 1), count[c:e]))
            lo = hi

    def _rows(self, held: list[_Open], both: np.ndarray, doc: np.ndarray, na: np.ndarray, nb: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> None:
        end = both & ((1 << int(_OFFSET)) - 1)
        start = np.concatenate([[0], end[:-1]]) if len(end) else end
        fresh = np.flatnonzero(np.diff(doc, prepend=-1))
        start[fresh] = [held[d].upto for d in doc[fresh]]
        for d in np.unique(doc).tolist():
            held[d].upto = int(end[doc == d][-1])
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(i, pa.int64())) for n, i in ((na, ia), (nb, ib))]
        self.out.append(pa.RecordBatch.from_arrays([pa.array([held[d].key[0] for d in doc], pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), *lists], ["doc_id", "start", "end", "a", "b"]))

    def close(self, x: _Open) -> None:
        if self.groups:
            return
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(x.pairs) == 1:
            pairs, times = x.pairs[0]
        elif x.pairs:
            pairs, at = np.unique(np.concatenate([p for p, _ in x.pairs]), return_inverse=True)
            times = np.bincount(at, weights=np.concatenate([t for _, t in x.pairs])).astype(np.int64)
        self.out.append((x.key[0], *x.n.tolist(), x.digest.hexdigest() if x.n[2] else "", pairs, times))

    def taken(self) -> Iterator[pa.RecordBatch]:
        """The rows that are ready."""
        out, self.out = self.out, []
        if self.groups:
            yield from out
        elif out:
            columns = list(zip(*out))
            kinds = [pa.int64()] * 5 + [pa.string()]
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.array(np.concatenate(c), pa.int64())) for c in columns[6:]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds)], *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def _machine(batches: Iterator[pa.RecordBatch], groups: bool, step: int) -> Iterator[pa.RecordBatch]:
    sweep = _Sweep(groups, 8 * step)
    for batch in batches:
        keys = list(zip(*[batch[c].to_pylist() for c in ("doc_id", "h", "part", "nth")]))
        start, side, runs = batch["start"].to_numpy(), batch["side"].to_numpy(), batch["events"].to_pylist()
        new = np.array([i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))], dtype=bool)
        upto, lo = np.cumsum([len(r) // 4 for r in runs]), 0
        while lo < len(keys):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + step)))
            docs = np.cumsum(new[lo:hi])
            docs -= docs[0]
            own = [keys[lo], *[keys[i] for i in (np.flatnonzero(new[lo + 1 : hi]) + lo + 1).tolist()]]
            sweep.add(own, docs, start[lo:hi], side[lo:hi], runs[lo:hi])
            lo = hi
            yield from sweep.taken()
    if sweep.open:
        sweep.close(sweep.open)
    yield from sweep.taken()


def groups(docs: DataFrame, a_path: str, b_path: str, run: int = RUN, step: int = SWEPT) -> DataFrame:
    """The groups of all texts: doc_id, start and end (bytes of the text with a space before it), a and b (token ids).

    Handles rows as ``align`` does; texts without tokens have no groups.
    """
    return swept(docs, a_path, b_path, run).mapInArrow(lambda it: _machine(it, True, step), _GROUP)


def _counted(batches: Iterator[pa.RecordBatch], counts: Broadcast, keep: bool) -> Iterator[pa.RecordBatch]:
    """Adds up a block of id pairs' counts over the links of every document."""
    known, n, best = counts.value
    for batch in batches:
        of = pc.list_parent_indices(batch["pairs"]).to_numpy().astype(np.int64)
        pairs, times = pc.list_flatten(batch["pairs"]).to_numpy(), pc.list_flatten(batch["times"]).to_numpy()
        at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
        hit = np.flatnonzero(known[at] == pairs) if len(known) else np.zeros(0, np.int64)
        at, of, times = at[hit], of[hit], times[hit]
        sums = {"n_best": np.zeros(len(batch), np.int64), "count_sum": np.zeros(len(batch), np.int64)}
        np.add.at(sums["n_best"], of, times * best[at])
        np.add.at(sums["count_sum"], of, times * n[at])
        held = {c: batch[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        held |= {c: pc.add(batch[c], pa.array(x, pa.int64())) for c, x in sums.items()}
        held |= {c: batch[c] for c in ("pairs", "times")} if keep else {}
        yield pa.RecordBatch.from_arrays(list(held.values()), list(held))


def align(docs: DataFrame, a_path: str, b_path: str, pair_block: int = PAIR_BLOCK, run: int = RUN, step: int = SWEPT) -> DataFrame:
    """Counts and digest of the groups and links of ``docs`` (doc_id, text; other columns are ignored), a row for each of its rows.

    ``a_path`` is a file of the library tokenizers with a byte-level vocabulary,
    ``b_path`` a sentencepiece model.  Texts that are null or empty, or that
    either side's tokens don't spell, have no tokens: zeros and an empty
    digest.  Repeated rows and rows that share an id count each; an empty table gives an empty result.
    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The counts of id pairs come to the workers in blocks of about
    ``pair_block`` distinct pairs, one block after the other.  ``run`` events
    are a row of the event table, ``step`` of them are swept at a time.
    """
    spark = docs.sparkSession
    zero = [F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum")]
    rows = stored(swept(docs, a_path, b_path, run).mapInArrow(lambda it: _machine(it, False, step), _DIGEST)).select("*", *zero)
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.shiftright("pair", ID_BITS)))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = stored(counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    blocks = max(1, -(-counts.count() // pair_block))
    own = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    for b in range(blocks):
        some = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == b).toArrow()  # a block
        pair = some["pair"].to_numpy()
        order = np.argsort(pair)
        held = spark.sparkContext.broadcast((pair[order], some["n"].to_numpy()[order], some["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)))
        keep = b < blocks - 1
        rows = rows.mapInArrow(lambda it, held=held, keep=keep: _counted(it, held, keep), own + ", pairs array<long>, times array<long>" if keep else own)
        rows = stored(rows) if keep else rows
    return rows


def default_paths() -> tuple[str, str]:
    """The vocabularies of the query; other files may be passed instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both vocabularies' tokens of all documents."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_paths())
