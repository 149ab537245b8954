"""Operator 11: ranked lexical search over a tiered index, with proofs of exactness.

Index. Documents are tokenised once, where they lie; a shard is a run of them with about SHARD postings, and one
row of the index table, so nothing is shuffled and no term, however frequent, gathers anywhere. In a shard each
term's postings stand by falling impact and are cut into tiers: the first holds whole lists of terms in up to
1/32 of the shard's documents and the top sixteenth of longer ones, the second lists of up to 1/8 and the top
quarter, the last the rest. For each term and tier the row keeps the residual bound, the largest impact further
down. Tiers are column groups of the Parquet table: a pass over the first tier reads no column of the others.

Search. Items go in blocks of at most BLOCK (item, term) pairs. A pass adds up, in each shard and for each item,
the impacts of the tiers it has; the shard gives its best k sums, which are lower bounds, and the largest upper
bound of documents whose sum isn't exact yet (to a sum, the residual bounds of the terms not met in the document
are added). The k-th sum of all shards is the item's threshold. If every shard's upper bound is below it, the
item is proved and done. Other items fall through: the next pass reads a further tier, only for them and only of
shards that could still matter. The last tier has no residual, so each item ends with the exact ranking.

Impact is (10^9 tf) div (1000 tf + 12 m), with m from the document's length; a term's weight multiplies it at
search, so that the index doesn't depend on the items (`vocabulary` may restrict it to the terms of some).

Null or empty text: no term, counts in no statistic. Rows without doc_id take no part. Rows that share a doc_id
are documents of their own and may each be ranked. Items: rows without item_id or without terms give nothing;
rows that share an item_id are one item with the terms of all its distinct texts. Empty tables: empty result.
Further columns are left out.
"""

from __future__ import annotations

from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, texts_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings (or documents) of a shard, (item, term) pairs of a block, terms that are sent to restrict an index.
SHARD, BLOCK, VOCABULARY = 1 << 20, 200_000, 1 << 18
#: Of each tier, with those above it: the part of a list that it holds, and the share of the shard's documents up to which lists are whole.
TIERS, SHORT = ((1 / 16, 1 / 32), (1 / 4, 1 / 8), (1.0, 1.0)), 32

#: A-Z to a-z, and all that is no part of a term to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _ints(values, kind=pa.int32()) -> pa.Array:
    """One row, a list."""
    values = pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _np(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


RAW = "shard long, doc_ids array<long>, lengths array<int>, terms array<string>, df array<int>, docs array<int>, tf array<int>, n_docs long, n_terms long"


def _raw_shards(vocabulary: frozenset[bytes] | None, most: int):
    """mapInArrow: (doc_id, text) to shards of unordered postings."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 31
        ids, lengths, codes, docs, tf, known = array("q"), array("i"), array("i"), array("i"), array("i"), {}

        def shard():
            code, doc, n = (np.frombuffer(x, np.int32) if x else np.zeros(0, np.int32) for x in (codes, docs, tf))
            order, names = np.argsort(code, kind="stable"), list(known)
            held = np.frombuffer(lengths, np.int32)
            out = {
                "shard": pa.array([number], pa.int64()), "doc_ids": _ints(np.frombuffer(ids, np.int64), pa.int64()), "lengths": _ints(held),
                "terms": _ints([t.decode() for t in names], pa.string()), "df": _ints(np.bincount(code, minlength=len(names)).astype(np.int32)),
                "docs": _ints(doc[order]), "tf": _ints(n[order]), "n_docs": pa.array([int((held > 0).sum())], pa.int64()), "n_terms": pa.array([int(held.sum(dtype=np.int64))], pa.int64()),
            }
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = terms_of(text.as_py() or b"")
                if not words:
                    continue
                counts = Counter(words)
                found = counts.items() if vocabulary is None else [(t, counts[t]) for t in counts.keys() & vocabulary]
                codes.extend([known.setdefault(t, len(known)) for t, _ in found])
                tf.extend([n for _, n in found])
                docs.extend([len(ids)] * len(found))
                ids.append(doc_id)
                lengths.append(len(words))
                if len(codes) >= most or len(ids) >= most:
                    yield shard()
                    number += 1
                    ids, lengths, codes, docs, tf, known = array("q"), array("i"), array("i"), array("i"), array("i"), {}
        if ids:
            yield shard()

    return run


def _tier(k: int) -> str:
    return ", ".join(f"{c}{k} array<int>" for c in ("starts", "docs", "impacts", "rest"))


INDEX = "shard long, doc_ids array<long>, terms array<string>, " + ", ".join(map(_tier, range(len(TIERS))))


def impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of a score that tf and a document's length make; 64-bit integers, rounding down."""
    m = 75 + 25 * lengths.astype(np.int64) * n_docs // n_terms
    return 10**9 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 12 * m)


def _tiered(n_docs: int, n_terms: int):
    """mapInArrow: shards of unordered postings to shards in tiers."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                lengths, df, docs, tf = (_np(batch, c, row) for c in ("lengths", "df", "docs", "tf"))
                impact = impacts(tf, lengths[docs], n_docs, n_terms)
                term = np.repeat(np.arange(len(df)), df)
                order = np.lexsort((docs, -impact, term))
                docs, impact = docs[order], impact[order].astype(np.int32)
                first = np.cumsum(df) - df
                place = np.arange(len(docs)) - np.repeat(first, df)
                out = {"shard": batch.column("shard").slice(row, 1), "doc_ids": batch.column("doc_ids").slice(row, 1), "terms": batch.column("terms").slice(row, 1)}
                begin = np.zeros(len(df), np.int64)
                for k, (part, whole) in enumerate(TIERS):
                    end = np.where(df <= max(SHORT, whole * len(lengths)), df, np.ceil(df * part).astype(np.int64))
                    held = (place >= np.repeat(begin, df)) & (place < np.repeat(end, df))
                    below = np.append(impact, 0)[np.minimum(first + end, len(impact))]
                    out |= {f"starts{k}": _ints(np.append(0, np.cumsum(end - begin))), f"docs{k}": _ints(docs[held]), f"impacts{k}": _ints(impact[held]), f"rest{k}": _ints(np.where(end < df, below, 0))}
                    begin = end
                yield pa.RecordBatch.from_pydict(out)

    return run


@dataclass(frozen=True)
class LexicalIndex:
    """shards: the tiers; terms: (term, df); n_docs and n_terms: documents with a term, and all their terms."""

    shards: DataFrame
    terms: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None, shard: int = SHARD) -> LexicalIndex:
    """Index docs (doc_id, text), whole; with vocabulary (term), the postings of these terms only, if they are few enough to be sent."""
    known = None
    if vocabulary is not None and vocabulary.count() <= VOCABULARY:
        known = frozenset(r.term.encode() for r in vocabulary.select("term").collect())
    raw = materialize(texts_of(docs).where("doc_id is not null").mapInArrow(_raw_shards(known, shard), RAW), "postings")
    n_docs, n_terms = raw.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    terms = raw.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
    shards = raw.select("shard", "doc_ids", "lengths", "terms", "df", "docs", "tf").mapInArrow(_tiered(n_docs, n_terms), INDEX)
    return LexicalIndex(materialize(shards, "tiers"), materialize(terms, "terms"), n_docs, n_terms)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n): how often a term stands in an item's distinct texts."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").distinct()
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rows.select("item_id", F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))


FOUND = "shard long, item_id long, doc_id long, score long, bound long"


def _search(items: dict[int, list[tuple[str, int]]], thresholds: dict[int, int], tiers: int, k: int):
    """mapInArrow: shards to each item's best k sums, in rows with the shard's upper bound of inexact sums (0: none)."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard, ids = batch.column("shard")[row].as_py(), _np(batch, "doc_ids", row)
                place = {t: i for i, t in enumerate(batch.column("terms")[row].as_py())}
                data = [[_np(batch, f"{c}{t}", row) for c in ("starts", "docs", "impacts", "rest")] for t in range(tiers)]
                out: list[tuple] = []

                def lists(own, first: int, last: int, rest):
                    for starts, docs, impact, _ in data[first:last]:
                        for t, w in own:
                            a, b = starts[t], starts[t + 1]
                            if a < b:
                                yield docs[a:b], impact[a:b].astype(np.int64), w, int(rest[t])

                for item, terms in items.items():
                    own = [(place[t], w) for t, w in terms if t in place]
                    if not own:
                        continue
                    score, bound = np.zeros(len(ids), np.int64), 0
                    for tier, (*_, rest) in enumerate(data):
                        for docs, impact, w, _ in lists(own, tier, tier + 1, rest):
                            score[docs] += impact * w
                        bound = sum(w * int(rest[t]) for t, w in own)
                        if bound:  # of documents not met; of others, what is left of terms not met in them
                            upper = score + bound
                            for docs, _, w, left in lists(own, 0, tier + 1, rest):
                                upper[docs] -= left * w
                            bound = int(upper[upper > score].max(initial=0))
                        if bound < max(1, thresholds.get(item, 0)):
                            break
                    best = np.nonzero(score > 0)[0]
                    if len(best) > k:
                        best = best[score[best] >= np.partition(score[best], len(best) - k)[len(best) - k]]
                    best = best[np.lexsort((ids[best], -score[best]))][:k]
                    out += [(shard, item, d, s, bound) for d, s in zip(ids[best].tolist(), score[best].tolist())]
                    if bound and not len(best):
                        out.append((shard, item, None, 0, bound))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["shard", "item_id", "doc_id", "score", "bound"])

    return run


def search(index: LexicalIndex, items: DataFrame, k: int = 20, block: int = BLOCK, report: list | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, equal scores by doc_id.

    report: gets for each block and tier the number of items that were open before it.
    """
    spark = index.shards.sparkSession
    pairs = item_terms(items)
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1)))
    pairs = materialize(pairs.join(index.terms, "term").select("item_id", "term", (F.col("n") * weight).cast("long").alias("w")).where("w > 0"), "pairs")
    blocks = max(1, -(-pairs.count() // block))
    done = []
    for number in range(blocks):
        open_: dict[int, list] = {}
        for item, term, w in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect():
            open_.setdefault(item, []).append((term, w))
        thresholds: dict[int, int] = {}
        shards, before = index.shards, None
        for tiers in range(1, len(TIERS) + 1):
            if not open_:
                break
            if report is not None:
                report.append((number, tiers, len(open_)))
            columns = ["shard", "doc_ids", "terms", *(f"{c}{t}" for t in range(tiers) for c in ("starts", "docs", "impacts", "rest"))]
            found = shards.select(*columns).mapInArrow(_search(open_, thresholds, tiers, k), FOUND)
            if before is not None:
                found = found.unionByName(before)
            found = materialize(found, "found")
            best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
            top = materialize(found.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "top")
            least = top.where(F.col("rank") == k).select("item_id", F.col("score").alias("threshold"))
            verdict = found.groupBy("item_id").agg(F.max("bound").alias("bound")).join(least, "item_id", "left").select("item_id", "bound", F.coalesce("threshold", F.lit(0)).alias("threshold"))
            verdict = materialize(verdict.withColumn("proved", (F.col("bound") == 0) | (F.col("bound") < F.col("threshold"))), "verdict")
            done.append(top.join(verdict.where("proved").select("item_id"), "item_id", "left_semi").select("item_id", "rank", "doc_id", "score"))
            thresholds = dict(map(tuple, verdict.where("not proved").select("item_id", "threshold").collect()))
            open_ = {i: open_[i] for i in thresholds}
            # Only shards that may still hold a result of an open item are read again; what the others gave stays.
            still = found.join(verdict.where("not proved").select("item_id", "threshold"), "item_id")
            again = materialize(still.where("bound > 0 and bound >= threshold").select("shard").distinct(), "again")
            before = still.join(again, "shard", "left_anti").select("shard", "item_id", "doc_id", "score", F.lit(0).cast("long").alias("bound"))
            shards = index.shards.join(again, "shard", "left_semi")
    if not done:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """search() over an index of the items' terms."""
    return search(build_index(docs, item_terms(items).select("term").distinct()), items, k)
