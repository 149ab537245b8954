"""Operator 12: alignment of two tokenizers' tokens by the bytes they cover.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model. Both split the same bytes (a blank, then
the text). A batch's texts lie one after the other in one byte space; the starts and ends of B's tokens are a
static interval index, in which each A token's span is stabbed by bisection: its first overlapping B token is the
first that ends after its start, its last the last that starts before its end. These overlaps are the links.
Where tokens of both end, no link spans the gap: it's the boundary of a group.

The corpus is encoded once and the ids are written. Tasks count links by id pair in sorted arrays and merge them
before Spark adds them up. A pair's count and whether it's its B id's highest are needed at each link: pairs from
a threshold count upwards, at most MOST_SENT, are sent to the workers as sorted arrays; a document's links of
rarer pairs are joined with the table of pairs, no key of which is frequent, and added up by row.

Special strings in texts are plain text. A text has no tokens if it is null or empty or if either side's bytes
aren't a blank and the text (such as with a character that the model normalises). Null doc_id: kept. Repeated
rows: each is a document. Empty table: empty result. Further columns are left out.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, texts_of, trim

#: Pairs that are sent to the workers (16 bytes each), and pairs that a task holds before it gives them to Spark.
MOST_SENT, HELD = 2_000_000, 1 << 21
#: A pair's key is A's id times WIDTH plus B's.
WIDTH = 1 << 31
#: Chunks that a worker remembers B's tokens of.
REMEMBERED = 200_000
#: Bytes of text that are aligned at once.
RUN = 1 << 19

CHUNK = re.compile(" +[^ ]*")
_BLANK = "▁"


def byte_level_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: visible Latin-1 stands for itself, the rest from U+0100 on, in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Sides:
    """Both tokenizers, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        from graphloom.llm.encoder import Encoder

        self.a = Encoder(a_path, bits=20)
        self.a.tok.encode_special_tokens, self.a.special = True, None  # special strings are plain text
        letters = byte_level_alphabet()
        vocab = self.a.tok.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes([letters[c] for c in entry]) if all(c in letters for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(piece)]
        self.cuttable = not any(_BLANK in p.lstrip(_BLANK) for p in piece)  # no piece has a blank after another character
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.known: dict[str, bytes] = {}
        self.blank = self.b.encode("a ")[len(self.b.encode("a")) :]  # of a text's last blank; an empty text has no token

    def b_ids(self, texts: list[str]) -> list[bytes]:
        """B's ids of each text as 32-bit integers. Chunks of blanks and what follows them are encoded alone, each distinct one once."""
        if not self.cuttable:
            return [np.array(x, "<i4").tobytes() for x in self.b.encode(texts, num_threads=1)]
        chunks = [CHUNK.findall(" " + t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({c for x in chunks for c in x}.difference(self.known))
        ids = self.b.encode([c[1:] for c in new], num_threads=1)
        self.known.update((c, np.array(self.blank if c == " " else x, "<i4").tobytes()) for c, x in zip(new, ids))
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in chunks]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides by text, empty where the sides' bytes differ from a blank and the text."""
        none = np.zeros(0, np.int32)
        out = [(none, none)] * len(texts)
        held = [i for i, t in enumerate(texts) if t]
        a_ids = self.a.encode([" " + texts[i] for i in held])
        for i, a, b in zip(held, a_ids, self.b_ids([texts[i] for i in held])):
            a, b, raw = np.frombuffer(a, self.a.dtype), np.frombuffer(b, "<i4"), b" " + texts[i].encode()
            if b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw == b"".join(map(self.b_bytes.__getitem__, b.tolist())):
                out[i] = (a.astype(np.int32), b)
        return out


_sides: dict[tuple, Sides] = {}


def sides(a_path: str, b_path: str) -> Sides:
    """One per Python worker."""
    if (a_path, b_path) not in _sides:
        _sides[a_path, b_path] = Sides(a_path, b_path)
    return _sides[a_path, b_path]


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens of each overlapping pair, by A token; both cover the same bytes from 0 on."""
    b_starts = np.append(0, b_ends[:-1])
    first = np.searchsorted(b_ends, np.append(0, a_ends[:-1]), side="right")
    n = np.searchsorted(b_starts, a_ends, side="left") - first
    upto = np.cumsum(n)
    return np.repeat(np.arange(len(a_ends)), n), np.arange(upto[-1] if len(n) else 0) + np.repeat(first - (upto - n), n)


class Pairs:
    """Counts of keys, in sorted arrays that are merged as they grow."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        at = np.searchsorted(self.keys, keys)
        same = at < len(self.keys)
        same[same] = self.keys[at[same]] == keys[same]
        self.counts[at[same]] += counts[same]
        self.keys, self.counts = np.insert(self.keys, at[~same], keys[~same]), np.insert(self.counts, at[~same], counts[~same])


def _runs(sizes: list[int]):
    """Slices of consecutive rows of about RUN bytes."""
    begin = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= RUN:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


IDS = "row long, doc_id long, a array<int>, b array<int>"


def _encode(a_path: str, b_path: str):
    def run(batches):
        from pyspark import TaskContext

        both, row = sides(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in _runs([len(t or "") for t in texts]):
                found = both.encode(texts[i:j])
                lists = [pa.ListArray.from_arrays(np.append(0, np.cumsum([len(x[s]) for x in found])).astype(np.int32), pa.array(np.concatenate([x[s] for x in found]).astype(np.int32))) for s in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + j - i)), ids.slice(i, j - i), *lists], ["row", "doc_id", "a", "b"])
                row += j - i
            trim()

    return run


def _flat(batch: pa.RecordBatch):
    """Runs of rows as (first row, row after the last, A's ids, A's edges by row, B's ids, B's edges)."""
    columns = []
    for name in ("a", "b"):
        c = batch.column(name)
        columns.append((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()))
    (a, a_at), (b, b_at) = columns
    for i, j in _runs((3 * np.diff(a_at)).tolist()):
        yield i, j, a[a_at[i] : a_at[j]], a_at[i : j + 1] - a_at[i], b[b_at[i] : b_at[j]], b_at[i : j + 1] - b_at[i]


def _count(a_path: str, b_path: str):
    """mapInArrow: ids to (pair, n), pairs of a task added up."""

    def run(batches):
        both, held = sides(a_path, b_path), Pairs()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys // WIDTH), pa.array(held.keys % WIDTH), pa.array(held.counts)], ["a", "b", "n"])

        for batch in batches:
            for _, _, a, _, b, _ in _flat(batch):
                i, j = links(np.cumsum(both.a_sizes[a]), np.cumsum(both.b_sizes[b]))
                held.add(a[i].astype(np.int64) * WIDTH + b[j])
            if len(held.keys) > HELD:
                yield out()
                held = Pairs()
        yield out()

    return run


OUT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rare array<struct<a:long,b:long,n:long>>"


def _align(a_path: str, b_path: str, sent):
    """mapInArrow: ids to a row a document; links whose pair isn't among those sent stand in rare."""

    def run(batches):
        both = sides(a_path, b_path)
        keys, counts, best = sent.value
        width, size = len(both.b_sizes), len(both.a_sizes)
        # Ids as text, with what follows: another id of the side, or the other side, or another group.
        text = [b"%d," % i for i in range(size)] + [b"%d|" % i for i in range(size)] + [b"%d," % i for i in range(width)] + [b"%d;" % i for i in range(width)]
        for batch in batches:
            for row, end, a, a_at, b, b_at in _flat(batch):
                a_ends, b_ends = np.cumsum(both.a_sizes[a]), np.cumsum(both.b_sizes[b])
                i, j = links(a_ends, b_ends)
                key = a[i].astype(np.int64) * WIDTH + b[j]
                at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
                n, top = (np.where(known, x[at], 0) if len(keys) else np.zeros(len(key), np.int64) for x in (counts, best))
                link_at = np.searchsorted(i, a_at)
                last_a, last_b = np.isin(a_ends, b_ends, assume_unique=True), np.isin(b_ends, a_ends, assume_unique=True)
                # An A token stands after its own and the B tokens of earlier groups; a B token after its own and the A tokens of its group and earlier ones.
                group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
                upto_b = np.append(0, np.nonzero(last_b)[0] + 1)
                upto_a = np.append(np.nonzero(last_a)[0] + 1, 0)
                code = np.empty(len(a) + len(b), np.int64)
                code[np.arange(len(a)) + upto_b[group_a]] = a + np.where(last_a, size, 0)
                code[np.arange(len(b)) + upto_a[group_b]] = b + 2 * size + np.where(last_b, width, 0)
                sums = [np.append(0, np.cumsum(x)) for x in (n, top, last_a)]
                of = lambda x, edges: np.diff(x[edges])
                digests = [hashlib.sha256(b"".join(map(text.__getitem__, code[x:y].tolist()))[:-1]).hexdigest() if y > x else "" for x, y in zip((a_at + b_at)[:-1].tolist(), (a_at + b_at)[1:].tolist())]
                lost = np.nonzero(~known)[0]
                rare = [[] for _ in range(end - row)]
                if len(lost):
                    doc = np.searchsorted(link_at, lost, side="right") - 1
                    pairs, times = np.unique(np.stack([doc, key[lost]]), axis=1, return_counts=True)
                    for d, p, m in zip(pairs[0].tolist(), pairs[1].tolist(), times.tolist()):
                        rare[d].append({"a": p // WIDTH, "b": p % WIDTH, "n": m})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(row, end - row), batch.column("doc_id").slice(row, end - row),
                        *(pa.array(x.astype(np.int64)) for x in (np.diff(a_at), np.diff(b_at), of(sums[2], a_at), np.diff(link_at), of(sums[1], link_at), of(sums[0], link_at))),
                        pa.array(digests), pa.array(rare, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))),
                    ],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rare"],
                )
            trim()

    return run


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): the alignment of A's and B's tokens by document."""
    spark = docs.sparkSession
    ids = materialize(texts_of(docs).mapInArrow(_encode(a_path, b_path), IDS), "ids")
    pairs = ids.select("a", "b").mapInArrow(_count(a_path, b_path), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs, "pairs")
    highest = pairs.groupBy("b").agg(F.max("n").alias("top"))
    pairs = materialize(pairs.join(highest, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best")), "counts")
    # The least count of pairs that are sent: counts fall into classes of a factor of two in quarters, a few hundred rows.
    step = F.floor(4 * F.log2("n"))
    least, total, n_pairs = 0, 0, pairs.count()
    if n_pairs > most_sent:
        least = None
        for _, low, n in sorted(map(tuple, pairs.groupBy(step.alias("s")).agg(F.min("n").alias("low"), F.count("*").alias("m")).collect()), reverse=True):
            if total + n > most_sent:
                break
            least, total = low, total + n
    often = pairs.where(F.col("n") >= least) if least is not None else pairs.limit(0)
    table = often.toArrow()
    a, b, n, best = (table.column(c).to_numpy() for c in ("a", "b", "n", "best"))
    key = a.astype(np.int64) * WIDTH + b
    order = np.argsort(key)
    sent = spark.sparkContext.broadcast((key[order], n[order].astype(np.int64), best[order].astype(np.int64)))
    rows = ids.mapInArrow(_align(a_path, b_path, sent), OUT)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if len(key) == n_pairs:
        return rows.select(*names)
    rows = materialize(rows, "aligned")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.a", "r.b", F.col("r.n").alias("times"))
    more = rare.join(pairs.where(F.col("n") < least) if least is not None else pairs, ["a", "b"]).groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("better"))
    add = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    whole = rows.drop("rare").join(more, "row", "left").withColumns({"n_best": add("n_best", "better"), "count_sum": add("count_sum", "more")})
    return whole.select(*names)
