"""Encoding with the tokenizers library, each distinct piece once.

Byte-level BPE with its usual splitting pattern never merges over a blank that a visible character follows,
nor over a line feed between two visible characters. So texts are cut there, and the pieces are encoded
alone. Pieces repeat: what the library gave for one is kept in a hash table of numpy arrays and looked up,
for all pieces of a batch at once, by two 64-bit hashes. Pieces of over MOST bytes, and texts that hold one
of the tokenizer's special strings, always go to the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

MOST, LONG = 64, 1 << 20
LONG_CUT = re.compile(" (?=[!-~])")


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Bytes that begin a character which no definition of white space includes. Fewer cuts are always safe.
SEEN = np.zeros(256, bool)
SEEN[0x21:0x7F] = SEEN[0xC3:0xC9] = True
#: Bytes after which a text is certainly not in white space: visible ASCII.
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = True


def cut_long(text: str):
    """A long text in parts of about LONG characters, cut where pieces begin anyway; the last may be longer."""
    begin = 0
    while len(text) - begin > LONG:
        at = LONG_CUT.search(text, begin + LONG - (LONG >> 3))
        end = at.start() if at else len(text)
        if end - begin > LONG:
            break
        yield text[begin:end]
        begin = end
    yield text[begin:]


class Hasher:
    """Two polynomial hashes mod 2^64 of many slices of a buffer, by prefix sums."""

    def __init__(self):
        rng = np.random.default_rng(20240229)
        self.bases = [int(x) | 1 for x in rng.integers(1 << 40, 1 << 62, 2)]
        self.values = [rng.integers(1, 1 << 63, 256).astype(np.uint64) for _ in range(2)]
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []

    def grow(self, n: int) -> None:
        if self.powers and len(self.powers[0][0]) > n:
            return
        size = (n >> 18) + 1 << 18
        self.powers = []
        for base in self.bases:
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                out = np.ones(1, np.uint64)
                while len(out) < size:
                    out = np.concatenate([out, out[: size - len(out)] * np.uint64(pow(b, len(out), 1 << 64))])
                pair.append(out)
            self.powers.append(tuple(pair))

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.grow(len(buf))
        out = []
        for value, (up, down) in zip(self.values, self.powers):
            sums = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(value[buf] * up[: len(buf)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * down[starts]
            h ^= h >> np.uint64(32)
            out.append(h * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))  # never 0: that's an empty slot
        return out[0], out[1]


class Table:
    """Open-addressing table: two hashes to a place in a pool of ids. Filled to 60 %, it starts anew."""

    def __init__(self, dtype: np.dtype, bits: int):
        self.bits, self.dtype, self.era = bits, dtype, 0
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        self.era += 1
        self.h1, self.h2, self.at, self.n = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int32), np.zeros(n, np.uint8)
        self.pool, self.used, self.entries = np.zeros(1 << 16, self.dtype), 0, 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slots, -1 where there's none."""
        mask = (1 << self.bits) - 1
        out = np.full(len(h1), -1, np.int64)
        slot, left = self._slot(h1), np.arange(len(h1))
        while len(left):
            own = self.h1[slot]
            same = (own == h1[left]) & (self.h2[slot] == h2[left])
            out[left[same]] = slot[same]
            on = ~same & (own != 0)
            left, slot = left[on], (slot[on] + 1) & mask
        return out

    def add(self, h1: np.ndarray, h2: np.ndarray, ids: list[bytes]) -> None:
        """New, distinct keys."""
        if self.entries + len(h1) > 0.6 * (1 << self.bits):
            while len(h1) > 0.6 * (1 << self.bits):  # one batch alone is more: grow
                self.bits += 1
            self.clear()
        sizes = np.array([len(x) // self.dtype.itemsize for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), self.dtype)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(flat), self.used), self.dtype)])
        self.pool[self.used : self.used + len(flat)] = flat
        begin = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.entries += len(h1)
        mask = (1 << self.bits) - 1
        slot, left = self._slot(h1), np.arange(len(h1))
        while len(left):
            free = np.nonzero(self.h1[slot] == 0)[0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            s, k = slot[won], left[won]
            self.h1[s], self.h2[s], self.at[s], self.n[s] = h1[k], h2[k], begin[k], sizes[k]
            on = np.ones(len(left), bool)
            on[won] = False
            left, slot = left[on], (slot[on] + 1) & mask


class Encoder:
    """encode(texts) gives little-endian ids (2 bytes each if the vocabulary allows, else 4) per text.

    bits: the table of remembered pieces has 2^bits slots, of 21 bytes each.
    """

    def __init__(self, path: str, bits: int = 22):
        self.tok = load_tokenizer(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cuttable = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        added = [a["content"] for a in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.hasher, self.table = Hasher(), Table(self.dtype, bits)
        self.feed = self.library(["\n"])[0]

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str], run: int = 4000) -> list[bytes]:
        """Ids of pieces. Those without white space inside are encoded in runs, a line feed between each two: it's
        always a token of its own there, so the ids can be told apart again."""
        out: list[bytes] = [b""] * len(pieces)
        plain, other = [], []
        for i, x in enumerate(pieces):
            (plain if x[0] in " \n" and x[1:2].strip() and x[1:].isprintable() and x[-1] != " " else other).append(i)
        for i, ids in zip(other, self.library([pieces[i] for i in other])):
            out[i] = ids
        size = self.dtype.itemsize
        for k in range(0, len(plain), run):
            part = plain[k : k + run]
            raw = self.library(["".join([pieces[i] if pieces[i][0] == "\n" else "\n" + pieces[i] for i in part])])[0]
            at = (np.nonzero(np.frombuffer(raw, self.dtype) == np.frombuffer(self.feed, self.dtype)[0])[0] * size).tolist()
            if len(at) != len(part):
                raise AssertionError("pieces ran together")
            for i, begin, end in zip(part, at, (*at[1:], len(raw))):
                out[i] = raw[begin if pieces[i][0] == "\n" else begin + size : end]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        rest = [i for i, t in enumerate(texts) if t and len(t) <= LONG]
        for i, t in enumerate(texts):
            if t and len(t) > LONG:
                exact = self.cuttable and not (self.special and self.special.search(t))
                out[i] = b"".join([self.encode([x])[0] if len(x) <= LONG else self.library([x])[0] for x in (cut_long(t) if exact else [t])])
        if not self.cuttable:
            whole = rest
        else:
            whole = [i for i in rest if self.special and self.special.search(texts[i])]
            held = set(whole)
            self._pieces([i for i in rest if i not in held], texts, out)
        for i, ids in zip(whole, self.library([texts[i] for i in whole])):
            out[i] = ids
        return out

    def _pieces(self, which: list[int], texts: list, out: list[bytes]) -> None:
        if not which:
            return
        raw = [texts[i].encode() for i in which]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        begins = np.cumsum([0, *map(len, raw)])
        follows = np.empty(len(buf), bool)
        follows[:-1] = SEEN[buf[1:]]
        follows[begins[1:] - 1] = False  # what follows a text's end is another text
        cut = (buf == 0x20) & follows
        feeds = np.nonzero((buf == 0x0A) & follows)[0]
        feeds = feeds[feeds > 0]
        cut[feeds[SOLID[buf[feeds - 1]]]] = True
        cut[begins[:-1]] = True  # texts are not empty
        starts = np.nonzero(cut)[0]
        ends = np.append(starts[1:], len(buf))
        h1, h2 = self.hasher(buf, starts, ends)
        long = ends - starts > MOST
        slot = np.full(len(starts), -1, np.int64)
        short = np.nonzero(~long)[0]
        slot[short] = self.table.find(h1[short], h2[short])
        miss = short[slot[short] < 0]
        if len(miss):
            new = miss[self._distinct(h1[miss], h2[miss])]
            ids = self.learn([buf[a:b].tobytes().decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            era = self.table.era
            self.table.add(h1[new], h2[new], ids)
            if self.table.era == era:
                slot[miss] = self.table.find(h1[miss], h2[miss])
            else:  # it has started anew: all that this batch needs, again
                self.table.clear()
                new = short[self._distinct(h1[short], h2[short])]
                self.table.add(h1[new], h2[new], self.learn([buf[a:b].tobytes().decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())]))
                slot[short] = self.table.find(h1[short], h2[short])
        n = self.table.n[slot].astype(np.int64)
        at = self.table.at[slot].astype(np.int64)
        pool = self.table.pool
        extra = np.nonzero(long)[0]
        if len(extra):
            ids = self.library([buf[a:b].tobytes().decode() for a, b in zip(starts[extra].tolist(), ends[extra].tolist())])
            sizes = np.array([len(x) // self.dtype.itemsize for x in ids], np.int64)
            n[extra], at[extra] = sizes, self.table.used + np.cumsum(sizes) - sizes
            pool = np.concatenate([pool[: self.table.used], np.frombuffer(b"".join(ids), self.dtype)])
        total = np.cumsum(n)
        first = total - n
        tokens = pool[np.repeat(at - first, n) + np.arange(total[-1])]
        edges = np.append(first[np.searchsorted(starts, begins[:-1])], total[-1]).tolist()
        for i, a, b in zip(which, edges, edges[1:]):
            out[i] = tokens[a:b].tobytes()

    @staticmethod
    def _distinct(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        keep = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        return order[keep]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(values: list, most_bytes: int = 1 << 20):
    """Runs of consecutive rows of about most_bytes of text, so that work space stays bounded."""
    begin = size = 0
    for i, v in enumerate(values):
        size += len(v or "")
        if size >= most_bytes:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(values):
        yield begin, len(values)
