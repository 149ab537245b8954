"""Operator 8: benchmark decontamination by spaced-seed hashing.

Words are runs of \\w, lowered. A mask keeps some positions of a window and ignores the others; the hash of
the kept words, with the mask's number, is joined between benchmark and training texts. The MASKS together
hit every aligned stretch of 13 words with up to 2 substitutions, of 15 with up to 3 and of 20 with up to 4,
wherever these are, and so all that is accepted: a longer stretch without five equal words at its beginning is
accepted without these five, too. Items of fewer than MIN_WORDS words are found by the SHORT masks. Around a hit, benchmark item and document are aligned word by word, and the
longest stretch of which at least 80 % of the words are equal is the overlap. It counts from MIN_WORDS words
on (for shorter items: the whole item).

The benchmark is the stated query set: Spark writes it in blocks of about BLOCK_WORDS words to the shared folder.
Workers index HELD of them at most at a time and hold all documents, read once, against each, CHUNK_WORDS words of
documents after the other. Nothing is collected, broadcast, shuffled or paired, and a hash that many documents or
items share costs work only where it's met.

Null text: no words, and items of no words are not looked for. Null ids are carried along. Repeated
rows: reported each. Empty tables: no overlap. All words of a text are hashed, whatever its length.
"""

from __future__ import annotations

import functools
import posixpath
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import open_fs, scratch, small_batches, texts_of, trim

#: Kept positions of the spaced seeds (fixed values, found by search; see above for what they guarantee).
MASKS = ("11111", "110101101", "1001110101", "1101100011", "1110111")
#: For items of one word, of two, and (both) of three words or more.
SHORT = ("1", "11", "111", "11011")
MIN_WORDS, SIMILARITY = 13, 0.8
BLOCK_WORDS, HELD, CHUNK_WORDS = 1 << 19, 4, 1 << 20
WORD = re.compile(r"\w+")


def word_hashes(text: str | None) -> np.ndarray:
    import xxhash

    return np.array([*map(xxhash.xxh64_intdigest, WORD.findall((text or "").lower()))], np.uint64)


def masks_for(n: int) -> list[int]:
    """Numbers of the masks, SHORT after MASKS, for an item of n words."""
    first = len(MASKS)
    return [*range(first)] if n >= MIN_WORDS else [first + n - 1] if n < 3 else [first + 2, first + 3]


def seeds(words: np.ndarray, number: int) -> np.ndarray:
    """Hash of each window's kept words, for one mask."""
    mask = (*MASKS, *SHORT)[number]
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number + 1, np.uint64)
    for at, keep in enumerate(mask):
        if keep == "1":
            out = (out ^ words[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class Index:
    """Seeds of a block of benchmark items, sorted, with a bit map in front."""

    BITS = 22

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items = [(i, w) for i, w in ((i, word_hashes(t)) for i, t in items) if len(w)]
        hashes, item, place = [], [], []
        for k, (_, words) in enumerate(self.items):
            for m in masks_for(len(words)):
                h = seeds(words, m)
                hashes.append(h)
                item.append(np.full(len(h), k, np.int32))
                place.append(np.arange(len(h), dtype=np.int32))
        self.masks = sorted({m for _, words in self.items for m in masks_for(len(words))})
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        hashes, item, place = cat(hashes, np.uint64), cat(item, np.int32), cat(place, np.int32)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.map = np.zeros(1 << self.BITS, bool)
        self.map[self._slot(self.hashes)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def overlaps(self, words: np.ndarray) -> list[tuple[int | None, int, int, int, int]]:
        """(item_id, first word in the document, in the item, words, equal words): the longest of each item."""
        found: dict[int, tuple[int, int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for m in self.masks:
            h = seeds(words, m)
            at = np.nonzero(self.map[self._slot(h)])[0]
            left, right = (np.searchsorted(self.hashes, h[at], side=s) for s in ("left", "right"))
            for p, a, b in zip(at[right > left].tolist(), left[right > left].tolist(), right[right > left].tolist()):
                for k, q in zip(self.item[a:b].tolist(), self.place[a:b].tolist()):
                    if (k, p - q) in tried:
                        continue
                    tried.add((k, p - q))
                    got = self.stretch(words, self.items[k][1], p - q)
                    if got and got[2] > found.get(k, (0, 0, 0, 0))[2]:
                        found[k] = got
        return [(self.items[k][0], *v) for k, v in sorted(found.items())]

    @staticmethod
    def stretch(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
        begin, end = max(0, -shift), min(len(item), len(words) - shift)
        same = words[begin + shift : end + shift] == item[begin:end]
        s = np.concatenate([[0], np.cumsum(np.where(same, 1, -SIMILARITY / (1 - SIMILARITY)))])
        s = np.round(s).astype(np.int64)  # 1 and -4
        best = np.maximum.accumulate(s[::-1])[::-1]  # not rising: the last place that is high enough
        last = np.searchsorted(-best, -s, side="right") - 1
        i = int(np.argmax(last - np.arange(len(s))))
        n = int(last[i]) - i
        if n < min(MIN_WORDS, len(item)):
            return None
        return begin + shift + i, begin + i, n, int(same[i : i + n].sum())


def write_blocks(benchmark: DataFrame) -> tuple[str, int]:
    """Folder of the benchmark's (item_id, text) in blocks of about BLOCK_WORDS words, and their number."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(chars) // (6 * BLOCK_WORDS)))
    path = scratch(items.sparkSession, "benchmark")
    items.where("text is not null").withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).write.partitionBy("block").parquet(path)
    return path, blocks


@functools.lru_cache(maxsize=HELD)
def load_block(path: str, block: int) -> Index | None:
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSelector

    fs, at = open_fs(posixpath.join(path, f"block={block}"))
    files = sorted(f.path for f in fs.get_file_info(FileSelector(at, allow_not_found=True)) if f.path.endswith(".parquet"))
    rows = ds.dataset(files, filesystem=fs).to_table(columns=["item_id", "text"]).to_pylist() if files else []
    return Index([(r["item_id"], r["text"]) for r in rows]) if rows else None


def searched(batches, text_at: int, path: str, blocks: int):
    """(batches, overlaps of each of their rows), some batches at a time."""
    held, words, total = [], [], 0

    def overlaps():
        out: list[list] = [[] for _ in words]
        for b in range(blocks):
            index = load_block(path, b)
            for found, w in zip(out, words) if index else ():
                found += index.overlaps(w)
        return held, out

    for batch in batches:
        held.append(batch)
        words += map(word_hashes, batch.column(text_at).to_pylist())
        total += sum(map(len, words[-batch.num_rows :] if batch.num_rows else ()))
        if total >= CHUNK_WORDS:
            yield overlaps()
            held, words, total = [], [], 0
            trim()
    if held:
        yield overlaps()
    load_block.cache_clear()  # the worker lives on, for other work
    trim()


OVERLAPS = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long"


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and the overlap of every document with every benchmark item that it contains."""
    path, blocks = write_blocks(benchmark)

    def search(batches):
        for some, found in searched(batches, 1, path, blocks):
            ids = [d for batch in some for d in batch.column(0).to_pylist()]
            rows = [(d, *o) for d, overlaps in zip(ids, found) for o in overlaps]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal"])

    return texts_of(docs).mapInArrow(search, OVERLAPS)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that overlap no benchmark item, all columns. Works on rows, so null or repeated ids do no harm."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    path, blocks = write_blocks(benchmark)

    def keep(batches):
        for some, found in searched(batches, at, path, blocks):
            begin = 0
            for batch in some:
                yield batch.filter(pa.array([not o for o in found[begin : begin + batch.num_rows]], pa.bool_()))
                begin += batch.num_rows

    return docs.mapInArrow(keep, docs.schema)
