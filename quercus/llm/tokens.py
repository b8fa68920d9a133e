"""Token ids of whole texts by the ``tokenizers`` library, word by word.

The word-level BPE vocabularies drop white space and never merge across the
pre-tokens of their split pattern, so the ids of a text are the ids of its
pre-tokens one after the other.  A worker therefore keeps the ids of the words
it has met and asks the library's BPE model only about new ones.  Texts with
characters outside the range the fast path is proven for (anything beyond
Latin Extended-A, where normalisation or Unicode tables could matter) go
through the library's own full pipeline, and so do all texts where the tokenizer
file has other rules than these vocabularies.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable

import numpy as np

#: Words a worker remembers; the memo starts afresh beyond it (a speed setting, ids do not depend on it).
MEMO_WORDS = 1_000_000

_LETTERS = "a-zªµºß-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = "\t-\r \u0085 "
_PRETOKEN = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_BEYOND = re.compile("[^\x00-įı-ſ]")
_SPECIAL = "<|"
#: The rules of a tokenizer file that the fast path follows.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [_SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Control characters on which libraries differ about white space.
_CONTROL = re.compile("[\x1c-\x1f]")


def _byte_alphabet() -> dict[int, str]:
    """The byte-to-character alphabet of byte-level BPE: printable bytes stand for themselves, the rest are numbered from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _follows(rules: dict) -> bool:
    """Whether a tokenizer file has the rules of the fast path."""
    model, added = rules.get("model", {}), rules.get("added_tokens") or []
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    same = rules.get("normalizer") == _NORMALIZER and rules.get("pre_tokenizer") == _PRE_TOKENIZER and not rules.get("truncation") and not rules.get("padding")
    return plain and same and all(_SPECIAL in t["content"] and not t.get("normalized") for t in added)


class WordEncoder:
    """Encodes texts with the tokenizer file at ``path``; ids come as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memo: dict[str, bytes] = {}
        self.alphabet = _byte_alphabet()
        with open(path, encoding="utf-8") as f:
            self.by_word = _follows(json.load(f))

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token, straight from the library's BPE model."""
        mapped = word if word.isascii() and word.isalpha() else "".join(map(self.alphabet.__getitem__, word.encode()))
        return [t.id for t in self.model.tokenize(mapped)]

    def whole(self, text: str) -> bytes:
        """The library's own pipeline over one text."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of one text (null: none)."""
        if not text:
            return b""
        if not self.by_word or _SPECIAL in text or _CONTROL.search(text) or not text.isascii() and _BEYOND.search(text):
            return self.whole(text)
        words = _PRETOKEN.findall(text.lower())
        memo = self.memo
        try:
            return b"".join(map(memo.__getitem__, words))
        except KeyError:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            for w in set(words).difference(memo):
                memo[w] = np.array(self.word(w), dtype="<u4").tobytes()
            return b"".join(map(memo.__getitem__, words))


#: Longest word, in bytes, that the table of seen words holds; longer ones are looked up one by one.
_TABLE_BYTES = 32
#: Bytes that are worked on at a time.
_PART = 1 << 20
#: By number of bytes, the bits of an eight-byte number that they fill.
_FILLED = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[range(0x61, 0x7B)] = 1
_CLASS[0x80:] = 1
_CLASS[range(0x30, 0x3A)] = 2
#: Lower-cased texts of these characters only are split on their bytes: ASCII, and Latin letters of two bytes.
_NOT_PLAIN = re.compile("[^\x00-\x7fà-öø-įı-ſß]")
_BREAK = re.compile(rb"[ \t-\r]")
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class BatchEncoder:
    """Encodes many texts at a time: words are found over the whole byte buffer, and a table of the words met gives their ids."""

    def __init__(self, path: str, slots_log2: int = 19):
        self.one = WordEncoder(path)
        self.slots = 1 << slots_log2
        self.head = np.zeros(self.slots, dtype=np.uint64)
        self.rest = np.zeros((self.slots, _TABLE_BYTES // 8 - 1), dtype=np.uint64)
        self.length = np.zeros(self.slots, dtype=np.uint8)
        self.at = np.zeros(self.slots, dtype=np.int64)
        self.n_ids = np.zeros(self.slots, dtype=np.uint8)  # a byte makes one id at most
        self.flat, self.used = np.zeros(1 << 20, dtype=np.uint32), 0

    def _compact(self) -> None:
        """Keeps the ids of the words that are in the table."""
        live = np.flatnonzero(self.n_ids)
        size = self.n_ids[live].astype(np.int64)
        to = np.cumsum(size) - size
        ids = self.flat[np.repeat(self.at[live] - to, size) + np.arange(int(size.sum()))]
        self.flat, self.at[live], self.used = np.concatenate([ids, np.zeros(1 << 20, dtype=np.uint32)]), to, len(ids)

    @staticmethod
    def _eights(data: bytes, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k+8 of words as numbers, zero beyond the words' ends."""
        some = np.ndarray(len(data) + 1, dtype="<u8", buffer=data + bytes(8), strides=(1,))
        return some[np.minimum(start + 8 * k, len(data))] & _FILLED[np.clip(size - 8 * k, 0, 8)]

    def _split(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens."""
        kind = _CLASS[buf]
        before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
        edge = (kind != before) | (kind == 2)
        quotes = np.flatnonzero(buf == 0x27)
        if len(quotes):
            padded = np.concatenate([buf, np.full(3, 0x20, np.uint8)])
            alone = quotes[(before[quotes] != 3) & (_CLASS[padded[quotes + 1]] == 1)]
            one, two = padded[alone + 1], padded[alone + 2]
            size = np.where(np.isin(one, [0x73, 0x74, 0x6D, 0x64]), 1, 0)
            size[((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)] = 2
            alone, size = alone[size > 0], size[size > 0]
            edge[alone + 1] = False
            rest = alone + 1 + size
            edge[rest[rest < len(buf)]] = True  # what follows begins anew, or is white space
        marks = np.flatnonzero(edge)
        ends = np.append(marks[1:], len(buf))
        words = kind[marks] != 0
        return marks[words], ends[words]

    def _learn(self, buf: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that the table lacks, one call to the library for each distinct word."""
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        alike = (word == word[first][back]).all(axis=1) & (end - start == (end - start)[first][back])
        if not alike.all():  # different words of one hash
            first, back = np.arange(len(h)), np.arange(len(h))
        ids = [self.one.word(buf[s:e].decode()) for s, e in zip(start[first].tolist(), end[first].tolist())]
        size, at = np.array([len(x) for x in ids], dtype=np.int64), self._kept(ids)
        todo = np.arange(len(first))
        for shift in (0, 24):  # where a word's first place is taken, it displaces what holds its second
            slot = ((h[first][todo] >> np.uint64(shift)) & np.uint64(self.slots - 1)).astype(np.int64)
            free = self.n_ids[slot] == 0 if shift == 0 else np.ones(len(slot), bool)
            put, _ = np.unique(slot[free], return_index=True)
            put = todo[free][_]
            to = slot[free][_]
            self.head[to], self.rest[to], self.length[to], self.at[to], self.n_ids[to] = word[first[put], 0], word[first[put], 1:], (end - start)[first[put]], at[put], size[put]
            todo = np.setdiff1d(todo, put)
        return at[back], size[back]

    def _kept(self, ids: list[list[int]]) -> np.ndarray:
        """Puts ids behind those that are kept; returns where each list starts."""
        flat = np.array([x for w in ids for x in w], dtype=np.uint32)
        size = np.array([len(w) for w in ids], dtype=np.int64)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        return at

    def _part(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words of a part start, how many ids each has, and all ids."""
        if self.used > 4 * self.slots:
            self._compact()
        start, end = self._split(np.frombuffer(data, dtype=np.uint8))
        length = end - start
        at, size = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64)
        long = np.flatnonzero(length > _TABLE_BYTES)
        head = self._eights(data, start, length, 0)
        more = np.flatnonzero((length > 8) & (length <= _TABLE_BYTES))
        rest = np.stack([self._eights(data, start[more], length[more], k) for k in range(1, _TABLE_BYTES // 8)], axis=1)
        h = (head + length.astype(np.uint64)) * _MIX[0]
        for k in range(rest.shape[1]):
            h[more] = (h[more] ^ (rest[:, k] * _MIX[k + 1])) * _MIX[0]
        h ^= h >> np.uint64(29)
        h *= _MIX[1]
        h ^= h >> np.uint64(32)
        size[long] = 0
        within = np.zeros(len(start), np.int64)  # of words beyond eight bytes: their place among these
        within[more] = np.arange(len(more))
        todo = np.arange(len(start))
        for shift in (0, 24):
            slot = ((h[todo] >> np.uint64(shift)) & np.uint64(self.slots - 1)).astype(np.int64)
            hit = (self.n_ids[slot] > 0) & (self.length[slot] == length[todo]) & (self.head[slot] == head[todo])
            beyond = np.flatnonzero(hit & (length[todo] > 8))
            hit[beyond] = (self.rest[slot[beyond]] == rest[within[todo[beyond]]]).all(axis=1)
            at[todo[hit]], size[todo[hit]] = self.at[slot[hit]], self.n_ids[slot[hit]]
            todo = np.flatnonzero(size < 0)
        if len(todo):
            word = np.zeros((len(todo), _TABLE_BYTES // 8), dtype=np.uint64)
            word[:, 0] = head[todo]
            beyond = np.flatnonzero(length[todo] > 8)
            word[beyond, 1:] = rest[within[todo[beyond]]]
            at[todo], size[todo] = self._learn(data, start[todo], end[todo], h[todo], word)
        if len(long):
            words = [data[s:e] for s, e in zip(start[long].tolist(), end[long].tolist())]
            met = {w: self.one.word(w.decode()) for w in set(words)}
            places = dict(zip(met, self._kept(list(met.values())).tolist()))
            at[long], size[long] = [places[w] for w in words], [len(met[w]) for w in words]
        ids = self.flat[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        return start, size, ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), and how many each text has."""
        plain, odd = [], {}
        for i, t in enumerate(texts):
            if not t:
                plain.append(b"")
                continue
            low = t.lower()
            if self.one.by_word and (t.isascii() or not _NOT_PLAIN.search(low) and not _BEYOND.search(t)) and _SPECIAL not in t and not _CONTROL.search(t):
                plain.append(low.encode())
            else:
                plain.append(b"")
                odd[i] = np.frombuffer(self.one.encode(t), dtype="<u4")
        data = b"\n".join(plain) + b"\n"
        starts, sizes, ids, lo = [], [], [], 0
        while lo < len(data):  # parts end behind white space, so no word is cut
            hi = lo + _PART
            if hi < len(data):
                behind = _BREAK.search(data, hi)
                hi = behind.end() if behind else len(data)
            start, size, own = self._part(data[lo:hi])
            starts.append(start + lo)
            sizes.append(size)
            ids.append(own)
            lo = hi
        start, size, flat = np.concatenate(starts), np.concatenate(sizes), np.concatenate(ids)
        bounds = np.cumsum([0, *(len(r) + 1 for r in plain)])
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, bounds)]
        if odd:
            parts = [odd.get(i, flat[upto[i] : upto[i + 1]]) for i in range(len(texts))]
            return np.concatenate(parts).astype(np.uint32), np.array([len(p) for p in parts], dtype=np.int64)
        return flat, np.diff(upto)


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """The worker's encoder for a tokenizer file, made once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    """The word-level vocabulary the queries use; any other file of the library may be passed instead."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ids_crc32(chunks: Iterable[bytes]) -> int:
    """Unsigned crc32 over ids as little-endian unsigned 32-bit integers."""
    crc = 0
    for c in chunks:
        crc = zlib.crc32(c, crc)
    return crc
