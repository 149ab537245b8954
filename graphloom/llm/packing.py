"""Operator 3: sequences packed by lexical retrieval (sharded BM25).

Documents become token ids with an end id. Those are dealt to shards by range of (signature, doc_id): the
signature is the least hash of a document's id pairs, so that documents that share phrases tend to be
neighbours, and the ranges have even sizes whatever a signature's frequency. A shard is closed at
SHARD_TOKENS ids; it holds an inverted index over its own documents (all their ids, BM25 weights).

Packing a shard: the first unused document is the seed. Its ids fill windows of max_tokens; into the rest of
its last window go its unused neighbours, best BM25 score first, each as a whole or cut at the window's end.
The remainder of a cut neighbour begins the next window and is the next seed. So all windows of a shard but
the last are full; the last is padded, unless its length is a power of two.

Null text: only the end id. Null doc_id: sorts first, carried along. Repeated rows: packed each. Empty
table: empty result. A document of any length is cut into as many pieces as it needs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import materialize, texts_of, trim, width

SHARD_TOKENS = 1 << 18
K1, B = 1.2, 0.75


def signature(ids: np.ndarray) -> int:
    """Least hash of neighbouring id pairs (of the single id where there's one), hashed again: least hashes of long
    documents are small, which would gather those in the first ranges. A signed 64-bit number."""
    x = ids.astype(np.uint64)
    pairs = (x[:-1] << np.uint64(32) | x[1:]) if len(x) > 1 else x
    h = (pairs ^ (pairs >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    least = (h ^ (h >> np.uint64(32))).min(keepdims=True)
    least = (least ^ (least >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return int((least ^ (least >> np.uint64(27))).view(np.int64)[0])


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """doc_id, sig, ids (little-endian, the encoder's width, end id included)."""

    def run(batches):
        from graphloom.llm.encoder import encoder, slices

        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            doc_ids, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts):
                ids = [x + end for x in enc.encode(texts[a:b])]
                sigs = [signature(np.frombuffer(x, enc.dtype)) for x in ids]
                wide = [enc.dtype.itemsize] * len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], pa.int64()), pa.array(sigs, pa.int64()), pa.array(wide, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "sig", "wide", "ids"])
            trim()

    return texts_of(docs).mapInArrow(run, "doc_id long, sig long, wide int, ids binary")


class Bm25:
    """Inverted index of one shard: for each term, the documents that have it and their weights, idf included."""

    def __init__(self, docs: list[np.ndarray]):
        self.n, self.docs = len(docs), docs
        length = np.array([len(d) for d in docs], np.float64)
        doc = np.repeat(np.arange(self.n), length.astype(np.int64))
        flat = np.concatenate(docs)
        kind = np.uint32 if (int(flat.max()) + 1) * self.n < 1 << 32 else np.uint64
        pairs, tf = np.unique(flat.astype(kind) * kind(self.n) + doc.astype(kind), return_counts=True)  # by term, then document
        term = (pairs // kind(self.n)).astype(np.int64)
        self.doc = pairs.astype(np.int64) - term * self.n
        df = np.bincount(term)
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * length / length.mean()))[self.doc])
        self.begin = np.concatenate([[0], np.cumsum(df)])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard, the seed's distinct terms being the query."""
        t = np.unique(self.docs[seed])
        begin = self.begin[t]
        size = self.begin[t.astype(np.int64) + 1] - begin
        last = np.cumsum(size)
        at = np.repeat(begin - last + size, size) + np.arange(last[-1])
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def pack_shard(docs: list[np.ndarray], limit: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of one shard."""
    index = Bm25(docs)
    unused, pieces, sequence, offset, nxt = np.ones(len(docs), bool), [], 0, 0, 0

    def put(d: int, start: int) -> int:
        nonlocal sequence, offset
        n = min(limit - offset, len(docs[d]) - start)
        pieces.append((d, start, n, sequence, offset))
        offset += n
        if offset == limit:
            sequence, offset = sequence + 1, 0
        return start + n

    seed = start = None
    while True:
        if seed is None:
            while nxt < len(docs) and not unused[nxt]:
                nxt += 1
            if nxt == len(docs):
                return pieces
            seed, start = nxt, 0
            unused[seed] = False
        while start < len(docs[seed]):
            start = put(seed, start)
        query, seed = seed, None
        if offset and unused.any():
            score = np.where(unused, index.scores(query), -1.0)
            while offset:
                d = int(score.argmax())
                if score[d] < 0:
                    break
                unused[d], score[d] = False, -1.0
                start = put(d, 0)
                if start < len(docs[d]):
                    seed = d
                    break


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_encoded(encoded: DataFrame, limit: int) -> DataFrame:
    """The pieces of encode_documents()' rows."""

    def run(batches):
        from pyspark import TaskContext

        base, sequence = TaskContext.get().partitionId() << 40, 0
        ids: list = []
        docs: list[np.ndarray] = []
        size = 0

        def close():
            nonlocal sequence
            found = pack_shard(docs, limit)
            out = [(ids[d], s, n, zlib.crc32(docs[d][s : s + n].astype("<u4").tobytes()), len(docs[d]), base + sequence + q, o) for d, s, n, q, o in found]
            sequence += 1 + max(q for _, _, _, q, _ in found)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for doc_id, wide, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "wide", "ids"))):
                ids.append(doc_id)
                docs.append(np.frombuffer(raw, f"<u{wide}"))
                size += len(docs[-1])
                if size >= SHARD_TOKENS:
                    yield close()
                    ids, docs, size = [], [], 0
        if docs:
            yield close()

    n = width(encoded.sparkSession)
    return encoded.repartitionByRange(n, "sig", "doc_id").sortWithinPartitions("sig", "doc_id", "ids").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 0) -> DataFrame:
    """Encode, write (the ranges need a look at the signatures), deal to shards, pack."""
    return pack_encoded(materialize(encode_documents(docs, tokenizer, end_id), "encoded"), limit)
