"""Operator 2: token counts from a compiled finite-state tokenizer.

A byte-level BPE tokenizer file becomes two deterministic transducers.

* The splitter has 12 states over 13 character classes; a transition tells whether a word begins at the
  character read or at the one before (two outcomes need one character of look-ahead). A batch of texts is
  cut into chunks of equal length; for each chunk, all start states are run at once, giving the chunk's
  state map. The maps compose through a parallel prefix scan (log2 of the number of chunks steps), which
  gives each chunk its true start state; a second run marks the word starts.
* The counter reads the bytes of a word. Its state is all that later bytes can depend on: the longest
  suffix that may grow into a token and, for each place in it, the last token of the encoding up to there
  and the difference in tokens to here. A transition is annotated with the change of the token count (it
  may be negative, where bytes merge). Transitions are compiled when first taken and kept.

All words of a batch advance through the counter in lockstep; words of over LONG bytes alone. Character
classes are compiled by probing the library itself, so both agree on letters, numbers and white space.
Special strings inside a text count as one token, as the library's default has it.

Null text: empty, no token. Repeated rows: counted each. Any doc_id, null too, is carried along. Empty
tables give empty results. Only tokenizer files of this kind are supported: ValueError for others.
"""

from __future__ import annotations

import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import texts_of, trim

OTHER, LETTER, NUMBER, BLANK, WHITE, QUOTE, STMD, R, E, V, L, END, SPECIAL = range(13)
START, LET, NUM, OTH, BLANK1, WHITE1, BLANKS, WHITES, Q, QR, QV, QL = range(12)
N_STATES, N_CLASSES = 12, 13
HERE, BEFORE = 1, 2
CHUNK, LONG = 256, 1024
END_BYTE, SPECIAL_BYTE = 0xFF, 0xFE  # in no UTF-8 text


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and emissions (HERE, BEFORE) by state * N_CLASSES + class."""
    letters = (LETTER, STMD, R, E, V, L)
    fresh = {c: LET for c in letters} | {NUMBER: NUM, BLANK: BLANK1, WHITE: WHITE1, QUOTE: Q, OTHER: OTH}
    joined = {c: LET for c in letters} | {NUMBER: NUM, OTHER: OTH, QUOTE: OTH}
    white = (BLANK, WHITE)
    step, emit = np.zeros((N_STATES, N_CLASSES), np.uint8), np.zeros((N_STATES, N_CLASSES), np.uint8)

    def rule(state, c, to, what=0):
        step[state, c], emit[state, c] = to, what

    for state in range(N_STATES):
        late = BEFORE if state in (QR, QV, QL) else 0
        for c in (END, SPECIAL):
            rule(state, c, START, late)
        for c, to in fresh.items():
            rule(state, c, to, HERE | late)
        for c in letters if state in (LET, QR, QV, QL) else ():
            rule(state, c, LET, late)
    rule(NUM, NUMBER, NUM)
    for c in (OTHER, QUOTE):
        rule(OTH, c, OTH)
        rule(Q, c, OTH)
    for state in (BLANK1, WHITE1, BLANKS, WHITES):
        for c in white:
            rule(state, c, BLANKS if c == BLANK else WHITES)
    for c, to in joined.items():
        rule(BLANK1, c, to)
        rule(BLANKS, c, to, BEFORE)
    for c, to in fresh.items():
        if c not in white:
            rule(WHITES, c, to, HERE | BEFORE)
    rule(Q, STMD, START)
    for c, to in ((R, QR), (V, QV), (L, QL)):
        rule(Q, c, to)
    rule(QR, E, START)
    rule(QV, E, START)
    rule(QL, L, START)
    return step.ravel(), emit.ravel()


def probe_classes(tok) -> np.ndarray:
    """The class of every assigned code point, found by letting the library split probe texts."""
    points = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    out = np.full(0x110000, OTHER, np.uint8)

    def bounds(lead: str) -> np.ndarray:
        text = "".join(f"{lead}{chr(c)}!" for c in points)
        at = np.zeros(len(text) + 1, bool)
        for _, (a, _b) in tok.pre_tokenizer.pre_tokenize_str(text):
            at[a] = True
        return at[: len(text)].reshape(-1, 3)

    after_letter, after_digit = bounds("a"), bounds("1")
    idx = np.array(points)
    letter, number = ~after_letter[:, 1], ~after_digit[:, 1]
    out[idx[letter]] = LETTER
    out[idx[number]] = NUMBER
    out[idx[after_letter[:, 1] & after_digit[:, 1] & after_letter[:, 2]]] = WHITE
    out[ord(" ")], out[ord("'")] = BLANK, QUOTE
    for c in "stmd":
        out[ord(c)] = STMD
    for c, k in zip("revl", (R, E, V, L)):
        out[ord(c)] = k
    return out


def byte_chars() -> dict[str, int]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def compile_spec(path: str) -> dict:
    """What the workers need of a tokenizer file: character classes, vocabulary, merges, special strings."""
    from graphloom.llm.encoder import load_tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or model.get("type") != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError("only byte-level BPE files without normalizer can be compiled")
    added = spec.get("added_tokens", [])
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
        raise ValueError("special strings that take white space along can't be compiled")
    return {"path": path, "classes": zlib.compress(probe_classes(load_tokenizer(path)).tobytes()), "special": [a["content"] for a in added]}


class Counter:
    """The lazily compiled counter transducer. most: states kept before it starts anew."""

    SHIFT, BIAS = 6, 48

    def __init__(self, path: str, most: int = 200_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        chars = byte_chars()
        as_bytes = {t: bytes(chars[c] for c in t) for t in model["vocab"] if all(c in chars for c in t)}
        self.vocab = {b: model["vocab"][t] for t, b in as_bytes.items()}
        self.bytes_of = {i: b for b, i in self.vocab.items()}
        self.merges = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[model["vocab"][a], model["vocab"][b]] = (rank, model["vocab"][a + b])
        self.prefixes = {b[:k] for b in self.vocab for k in range(len(b) + 1)}
        self.most, self.pairs = most, {}
        self.reset()

    def reset(self) -> None:
        self.columns = np.full(256, -1, np.int32)
        self.n_columns, self.wide = 0, 64
        self.states: list = [(b"", ((-1, 0),))]
        self.number = {self.states[0]: 0}
        self.table = np.full((4096, self.wide), -1, np.int32)

    def bpe(self, data: bytes) -> list[int]:
        """Plain merging by rank, for the compiler."""
        ids = [self.vocab[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min((self.merges[p][0] for p in zip(ids, ids[1:]) if p in self.merges), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(ids):
                got = self.merges.get((ids[i], ids[i + 1])) if i + 1 < len(ids) else None
                if got and got[0] == best:
                    out.append(got[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def follows(self, a: int, b: int) -> bool:
        """Whether b can stand after a (-1: at the start) in an encoding."""
        key = (a, b)
        if key not in self.pairs:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[key] = self.bpe(self.bytes_of[b]) == [b] if a < 0 else self.bpe(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self.pairs[key]

    def compile(self, state: int, byte: int) -> int:
        """The packed transition of a state: next state and change of the count."""
        window, ends = self.states[state]
        grown = window + bytes((byte,))
        for size in range(len(grown), 0, -1):
            token = self.vocab.get(grown[-size:])
            if token is not None and self.follows(ends[size - 1][0], token):
                break
        change = ends[size - 1][1] + 1
        ends = ((token, 0), *((t, d - change) for t, d in ends))
        while grown not in self.prefixes:
            grown = grown[1:]
        key = (grown, ends[: len(grown) + 1])
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return to << self.SHIFT | change + self.BIAS

    def column(self, byte: int) -> int:
        if self.columns[byte] < 0:
            if self.n_columns == self.wide:
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
                self.wide *= 2
            self.columns[byte] = self.n_columns
            self.n_columns += 1
        return self.columns[byte]

    def fill(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Packed transitions of many (state, byte) pairs; compiles those that are missing."""
        cols = self.columns[data]
        if (cols < 0).any():
            for b in np.unique(data[cols < 0]).tolist():
                self.column(b)
            cols = self.columns[data]
        got = self.table[states, cols]
        if (got < 0).any():
            lost = got < 0
            for key in np.unique(states[lost].astype(np.int64) << 8 | data[lost]).tolist():
                state, byte = key >> 8, key & 255
                v = self.compile(state, byte)
                self.table[state, self.columns[byte]] = v
            got = self.table[states, cols]
        return got

    def count(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each word buf[start : start + length]."""
        if len(self.states) > self.most:
            self.reset()
        out = np.zeros(len(starts), np.int64)
        for i in np.nonzero(lengths > LONG)[0]:
            out[i] = self.count_long(buf[starts[i] : starts[i] + lengths[i]])
        short = np.nonzero(lengths <= LONG)[0]
        order = short[np.argsort(-lengths[short], kind="stable")]
        begin, size = starts[order], lengths[order]
        state, total = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
        left = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for k, n in enumerate(left):
            got = self.fill(state[:n], buf[begin[:n] + k])
            state[:n] = got >> self.SHIFT
            total[:n] += (got & (1 << self.SHIFT) - 1) - self.BIAS
        out[order] = total
        return out

    def count_long(self, word: np.ndarray) -> int:
        state = total = 0
        known: dict[int, int] = {}
        for byte in word.tolist():
            key = state << 8 | byte
            got = known.get(key)
            if got is None:
                got = known[key] = int(self.fill(np.array([state]), np.array([byte]))[0])
            state = got >> self.SHIFT
            total += (got & (1 << self.SHIFT) - 1) - self.BIAS
        return total


def classes_of(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and class of each character; END_BYTE and SPECIAL_BYTE count as characters."""
    at = np.nonzero((buf & 0xC0) != 0x80)[0].astype(np.int32)
    lead = buf[at]
    out = table[lead]
    out[lead == END_BYTE] = END
    out[lead == SPECIAL_BYTE] = SPECIAL
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        i = np.nonzero((lead >= low) & (lead < high))[0]
        point = (lead[i] & mask).astype(np.int32)
        for k in range(1, more + 1):
            point = point << 6 | buf[at[i] + k] & 0x3F
        out[i] = table[point]
    return at, out


def word_starts(classes: np.ndarray, step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Marks of the characters that begin a word: chunk maps, prefix scan, second run."""
    n = max(1, -(-len(classes) // CHUNK))
    padded = np.full(n * CHUNK, END, np.uint8)
    padded[: len(classes)] = classes
    columns = np.ascontiguousarray(padded.reshape(n, CHUNK).T)
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (n, 1))
    for c in columns:
        maps = step[maps * np.uint8(N_CLASSES) + c[:, None]]
    d = 1
    while d < n:
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d].copy(), axis=1)
        d *= 2
    state = np.full(n, START, np.uint8)
    state[1:] = maps[:-1, START]
    marks = np.empty((CHUNK, n), np.uint8)
    for k, c in enumerate(columns):
        at = state * np.uint8(N_CLASSES) + c
        marks[k], state = emit[at], step[at]
    flat = marks.T.ravel()[: len(classes)]
    begins = (flat & HERE).astype(bool)
    begins[np.nonzero(flat & BEFORE)[0] - 1] = True
    return begins


class FiniteStateCounter:
    def __init__(self, spec: dict):
        self.step, self.emit = splitter()
        self.table = np.frombuffer(zlib.decompress(spec["classes"]), np.uint8)
        self.special = [s.encode() for s in sorted(spec["special"], key=len, reverse=True)]
        self.counter = Counter(spec["path"])

    def counts(self, texts: list[bytes]) -> np.ndarray:
        parts = []
        for t in texts:
            for s in self.special:
                if s in t:
                    t = t.replace(s, bytes((SPECIAL_BYTE,)))
            parts += (t, b"\xff")
        buf = np.frombuffer(b"".join(parts), np.uint8)
        at, classes = classes_of(buf, self.table)
        begins = word_starts(classes, self.step, self.emit)
        begins |= classes >= END
        edges = at[begins]
        real = classes[begins] < END
        lengths = np.diff(edges, append=len(buf))[real]
        starts = edges[real]
        ends = np.nonzero(buf == END_BYTE)[0]
        specials = np.nonzero(buf == SPECIAL_BYTE)[0]
        words = self.counter.count(buf, starts, lengths)
        out = np.bincount(np.searchsorted(ends, starts), weights=words, minlength=len(texts))
        return (out + np.bincount(np.searchsorted(ends, specials), minlength=len(texts))).astype(np.int64)


_counters: dict[str, FiniteStateCounter] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text."""
    spec = compile_spec(tokenizer)

    def run(batches):
        from graphloom.llm.encoder import slices

        if spec["path"] not in _counters:
            _counters[spec["path"]] = FiniteStateCounter(spec)
        fst = _counters[spec["path"]]
        for batch in batches:
            ids = batch.column(0)
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            counts = np.zeros(len(texts), np.int64)
            for a, b in slices(texts, 2 << 20):
                counts[a:b] = fst.counts(texts[a:b])
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
            trim()

    return texts_of(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
