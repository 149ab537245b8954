"""Operator 10: quality rules and n-gram perplexity bands.

Base rules, from whole texts: words are [^\\x20\\x09-\\x0D]+; fewer than 50 words fail, as do texts of which
more than half of the words lie in 3-word windows that occur twice or more.

Perplexity: a modified Kneser-Ney model of order 5 over code points, none folded, one for each language. Tasks
count 5-grams of all documents, Spark adds the counts up and makes the model: continuation counts below the
highest order (plain counts where a gram begins a text), three discounts an order from the counts of counts,
back-off weights, interpolation down to a uniform distribution over code points. It's stored as sorted arrays
of 64-bit hashes in shards by range of the hash, which grow in number with the corpus. A worker holds at most
SHARDS_HELD of them at once and reads others again when it needs them, so its memory is bounded at any size.

A document must not speak for itself: a gram or context of which the corpus has no more occurrences than the
document is unknown to the document's score, and the next lower order is asked. So a gram seen once needs no
place in the arrays (its only reader is the document that has it), and there's none.

Bands: a document's log-perplexity (over its characters) is compared with the median of its language's
documents that pass the base rules. The usual deviation of a document of n characters is
sqrt(mad^2 + noise^2 / n), both terms measured: mad is the scaled median absolute deviation of long documents,
noise that of short ones times the square root of their length. Where a language has few documents to measure
them by, PRIOR documents of the whole corpus's spread are added to its own, and two standard errors of such a
measure (DEVIATION_ERROR / sqrt(documents) of it) on top. Documents of more than BAND_ABOVE such deviations
above are rejected. Under the whole model, whatever other documents repeat (copies, edited copies, shared
passages) is well foretold, and a band below would take whole families of good documents, the original with its
copies. So the band below goes by the model's grams of order LOW: their probabilities come from counts of distinct
characters before them, to which a copy adds nothing. Documents of more than BAND_BELOW deviations below are
rejected by it: text that stays within a few letter sequences.

Null text: no words, so the base rules fail. Null lang: a language of its own. Repeated rows: judged each,
and counted each in the model. Languages with no document that passes the base rules have no band and no
document to judge. Empty table: empty result.
"""

from __future__ import annotations

import functools
import posixpath
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import WHITE_STR, materialize, open_fs, scratch, small_batches, trim

ORDER = 5
#: Order of the grams that the band below goes by.
LOW = 3
#: Bits of a code point; three fit a signed long.
POINT = 21
#: Stands before a text's first character: a code point that is no character.
PAD = 0x10FFFF
CODE_POINTS = 0x110000
BAND_BELOW, BAND_ABOVE = 4.0, 4.0
#: Documents of at least LONG_DOC characters show the spread of styles, shorter ones that of chance.
LONG_DOC = 2000
#: Documents' worth of the whole corpus's spread in each language's, and the relative standard error of a median absolute deviation from one document.
PRIOR, DEVIATION_ERROR = 30, 1.17
SHARD_ROWS, SHARDS_HELD = 1 << 21, 16
SYMBOLS = "#*$%&|<>"
NO_LANG = "\x00none"
LONG_WORDS = 100_000
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


# --- grams: the last three code points in lo, those before in hi, right-aligned


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, each behind ORDER - 1 PADs, and where each text's begin and end."""
    pad = chr(PAD) * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths + ORDER - 1) - lengths
    return points, begins, begins + lengths


def inside(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places of the texts' characters, without the PADs before them."""
    real = np.ones(len(points), bool)
    real[(begins[:, None] - np.arange(1, ORDER)).ravel()] = False
    return np.nonzero(real)[0]


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of the ORDER code points that end at each place from ORDER - 1 on."""
    n, shift = len(points) - ORDER + 1, np.uint64(POINT)
    lo = points[ORDER - 3 : ORDER - 3 + n] << shift
    lo |= points[ORDER - 2 : ORDER - 2 + n]
    lo <<= shift
    lo |= points[ORDER - 1 :]
    hi = points[:n] << shift
    hi |= points[1 : 1 + n]
    return hi, lo


def gram_of(points: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of the grams of this order that end at the places at."""
    hi = lo = np.zeros(len(at), np.uint64)
    for back in range(order - 1, -1, -1):
        p = points[at - back]
        if back < 3:
            lo = lo << np.uint64(POINT) | p
        else:
            hi = hi << np.uint64(POINT) | p
    return hi, lo


def hash_of(hi: np.ndarray, lo: np.ndarray, order: int | np.ndarray) -> np.ndarray:
    salt = order * np.uint64(0xC2B2AE3D27D4EB4F) if isinstance(order, np.ndarray) else np.uint64(order * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
    h = lo * np.uint64(0x9E3779B97F4A7C15) ^ (hi + salt) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def by_language(langs: list, ids: range | list) -> dict[str, list[int]]:
    groups: dict[str, list[int]] = {}
    for i in ids:
        groups.setdefault(NO_LANG if langs[i] is None else langs[i], []).append(i)
    return groups


def merged(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal grams added up, by one sort of hash and place in a 64-bit number. Grams whose hashes agree in
    the upper bits may stay in two rows; Spark adds those up."""
    size = max(1, len(lo) - 1).bit_length()
    packed = hash_of(hi, lo, 0) >> np.uint64(size) << np.uint64(size) | np.arange(len(lo), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << size) - 1)).astype(np.int64)
    hi, lo = hi[order], lo[order]
    first = np.nonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))[0]
    return hi[first], lo[first], np.add.reduceat(n[order], first)


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, hi, lo, n: the 5-grams of all documents (lang, text)."""

    def run(batches):
        from graphloom.llm.encoder import slices

        held: dict[str, list[tuple]] = {}
        fresh: dict[str, int] = {}

        def close(lang):
            held[lang] = [merged(*(np.concatenate(x) for x in zip(*held[lang])))]
            fresh[lang] = 0

        for batch in batches:
            langs, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts, 1 << 18):
                for lang, at in by_language(langs, range(a, b)).items():
                    points, begins, _ = points_of([texts[i] or "" for i in at])
                    ends = inside(points, begins) - (ORDER - 1)
                    if not len(ends):
                        continue
                    held.setdefault(lang, []).append(merged(*(x[ends] for x in grams(points)), np.ones(len(ends), np.int64)))
                    fresh[lang] = fresh.get(lang, 0) + len(held[lang][-1][0])
                    if fresh[lang] > max(1 << 18, len(held[lang][0][0])):
                        close(lang)
            trim()
        for lang in held:
            close(lang)
            hi, lo, n = held[lang][0]
            for i in range(0, len(n), 1 << 16):
                cut = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n[cut]), pa.string()), *(pa.array(c[cut].astype(np.int64)) for c in (hi, lo, n))], ["lang", "hi", "lo", "n"])

    return docs.mapInArrow(run, "lang string, hi long, lo long, n long").groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n"))


# --- the model, by Spark


def suffix_of(order: Column, k: int) -> Column:
    """order, hi, lo of the last k code points."""
    keep = lambda c, points: F.col(c).bitwiseAND(F.lit((1 << POINT * points) - 1)) if points < 3 else F.col(c)
    hi = keep("hi", k - 3) if k > 3 else F.lit(0).cast("long")
    return F.struct(order.alias("order"), hi.alias("hi"), (keep("lo", k) if k else F.lit(0).cast("long")).alias("lo"))


def by_order(column) -> Column:
    """column(k) for rows of order k."""
    out = F.when(F.col("order") == 1, column(1))
    for k in range(2, ORDER + 1):
        out = out.when(F.col("order") == k, column(k))
    return out


def of_language(rows: DataFrame, table: DataFrame, most: int = 1 << 16) -> DataFrame:
    """rows joined with table (a row a language and order): sent to the workers while these are few, else by salted keys."""
    if table.count() <= most:
        return rows.join(F.broadcast(table), ["lang", "order"])
    salts = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("hi", "lo"), F.lit(16)).cast("int")).join(salts, ["lang", "order", "salt"]).drop("salt")


def levels_of(counts: DataFrame) -> DataFrame:
    """lang, order, hi, lo, c (the count that the order goes by), n (occurrences): grams of all orders."""
    gram = ["lang", "order", "hi", "lo"]
    longer = counts.select("lang", "n", F.explode(F.array(*(suffix_of(F.lit(k), k + 1) for k in range(1, ORDER)))).alias("g"))
    longer = longer.select("lang", "g.*", "n").groupBy(*gram).agg(F.sum("n").alias("n"))  # each distinct gram of order + 1
    own = by_order(lambda k: suffix_of(F.col("order"), k)).alias("g")
    lower = longer.select("lang", own, "n").select("lang", "g.*", "n").groupBy(*gram).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    first = by_order(lambda k: F.shiftrightunsigned("hi", POINT * (k - 4)) if k > 3 else F.shiftrightunsigned("lo", POINT * (k - 1)))
    lower = lower.withColumn("c", F.when(first == PAD, F.col("n")).otherwise(F.col("c")))
    return counts.select("lang", F.lit(ORDER).alias("order"), "hi", "lo", F.col("n").alias("c"), "n").unionByName(lower)


def discounts(levels: DataFrame) -> DataFrame:
    """lang, order, d1, d2, d3: the three discounts of each order, from the counts of counts."""
    n = [F.greatest(F.count(F.when(F.col("c") == k, 1)), F.lit(1)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}") for k in (1, 2, 3)]
    clipped = [F.least(F.greatest(x, F.lit(0.05 * k)), F.lit(0.95 * k)).alias(f"d{k}") for k, x in enumerate(d, 1)]
    return levels.groupBy("lang", "order").agg(*n).select("lang", "order", *clipped)


def fit(counts: DataFrame, path: str) -> DataFrame:
    """lang, order, hi, lo, p, n (occurrences), gamma (back-off weight as a context), m (occurrences as a context)."""
    save = lambda df, what: materialize(df, what, posixpath.join(path, what))
    levels = save(levels_of(counts), "levels")
    rows = of_language(levels, save(discounts(levels), "discounts"))
    rows = rows.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
    carried = F.shiftleft(F.col("hi").bitwiseAND(F.lit((1 << POINT) - 1)), 2 * POINT)
    rows = rows.select("lang", "order", "hi", "lo", "c", "n", "d", F.shiftright("hi", POINT).alias("chi"), F.shiftright("lo", POINT).bitwiseOR(carried).alias("clo"))
    context = ["lang", "order", "chi", "clo"]
    contexts = rows.groupBy(*context).agg(F.sum("c").alias("total"), F.sum("d").alias("given"), F.sum("n").alias("m"))
    parts = rows.join(contexts, context).select(*context, "hi", "lo", "n", "m", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), (F.col("given") / F.col("total")).alias("gamma"))
    parts = save(parts, "parts")
    lower, entries = None, parts.select("lang", (F.col("order") - 1).alias("order"), F.col("chi").alias("hi"), F.col("clo").alias("lo"), F.lit(None).cast("double").alias("p"), F.lit(0).cast("long").alias("n"), "gamma", "m").where("m > 1")
    for k in range(1, ORDER + 1):
        now = parts.where(F.col("order") == k)
        below = F.lit(1.0 / CODE_POINTS)
        if lower is not None:
            now = now.withColumn("s", suffix_of(F.lit(k - 1), k - 1)).select("*", F.col("s.hi").alias("shi"), F.col("s.lo").alias("slo"))
            now = now.join(lower.select("lang", F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("below")), ["lang", "shi", "slo"])
            below = F.col("below")
        lower = now.select("lang", "order", "hi", "lo", (F.col("own") + F.col("gamma") * below).alias("p"), "n")
        entries = entries.unionByName(lower.where("n > 1").withColumns({"gamma": F.lit(None).cast("double"), "m": F.lit(0).cast("long")}))
    return entries.groupBy("lang", "order", "hi", "lo").agg(F.max("p").alias("p"), F.max("n").alias("n"), F.max("gamma").alias("gamma"), F.max("m").alias("m"))


#: Occurrences beyond 2^32 - 1 are stored as that: no document has as many.
ARRAYS = {"hash": np.uint64, "p": np.float32, "n": np.uint32, "gamma": np.float32, "m": np.uint32}
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def store(model: DataFrame, path: str) -> tuple[str, int]:
    """(path, bits that tell the shard). Sorted hash arrays of each language, in shards by range of the hash, as Parquet under path. One shard has about
    SHARD_ROWS entries or less, whatever the size of the model."""

    def hashed(batches):
        for batch in batches:
            hi, lo, order = (batch.column(c).to_numpy() for c in ("hi", "lo", "order"))
            h = hash_of(hi.view(np.uint64), lo.view(np.uint64), order.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(h.view(np.int64)), *(batch.column(c) for c in ("p", "n", "gamma", "m"))], ["lang", "hash", "p", "n", "gamma", "m"])

    rows = materialize(model.mapInArrow(hashed, "lang string, hash long, p double, n long, gamma double, m long"), "entries", posixpath.join(path, "entries"))
    most = rows.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, (most - 1).bit_length() - (SHARD_ROWS - 1).bit_length())
    shard = F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)

    def pack(key, table):
        h = table.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(h)
        cols = {c: np.nan_to_num(table.column(c).to_numpy().astype(np.float64), nan=1.0)[order] for c in ("p", "gamma")}
        cols = {"hash": h[order], "p": np.log(cols["p"]), "gamma": np.log(cols["gamma"])} | {c: np.minimum(table.column(c).to_numpy()[order], 0xFFFFFFFF) for c in ("n", "m")}
        cols["hash"] = np.append(cols["hash"], LAST)  # where a look-up ends
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "shard": pa.array([key[1].as_py()], pa.int32()), "bits": pa.array([bits], pa.int32()), **{c: pa.array([cols[c].astype(t).tobytes()], pa.binary()) for c, t in ARRAYS.items()}})

    schema = "lang string, shard int, bits int, " + ", ".join(f"{c} binary" for c in ARRAYS)
    packed = rows.withColumn("shard", shard).groupBy("lang", "shard").applyInArrow(pack, schema)
    out = posixpath.join(path, "models")
    packed.write.parquet(out)
    return out, bits


# --- scoring


class Shard:
    """Look-ups in the sorted arrays of one hash range, from a guess by the hash's upper bits."""

    def __init__(self, arrays: dict[str, np.ndarray], bits: int = 0):
        self.a = arrays
        self.keys, keys = arrays["hash"], arrays["hash"][:-1]
        self.bits = max(4, len(keys).bit_length() + 1)
        self.skip = np.uint64(bits)
        places = np.arange((1 << self.bits) + 1, dtype=np.uint64)
        upper = keys << self.skip >> np.uint64(64 - self.bits) if bits else keys >> np.uint64(64 - self.bits)
        self.begin = np.searchsorted(upper, places).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where there's none."""
        at = self.begin[(h << self.skip >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        left = np.nonzero(self.keys[at] < h)[0]
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] < h[left]]
        at[(self.keys[at] != h) | (at == len(self.keys) - 1)] = -1
        return at


@functools.lru_cache(maxsize=SHARDS_HELD)
def load_shard(path: str, lang: str, shard: int) -> Shard | None:
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSelector

    fs, at = open_fs(path)
    files = [f.path for f in fs.get_file_info(FileSelector(at)) if f.path.endswith(".parquet")]
    rows = ds.dataset(files, filesystem=fs).to_table(filter=(ds.field("lang") == lang) & (ds.field("shard") == shard)).to_pylist() if files else []
    return Shard({c: np.frombuffer(rows[0][c], t) for c, t in ARRAYS.items()}, rows[0]["bits"]) if rows else None


class Model:
    """One language's model: shard(number) gives the arrays of a hash range."""

    def __init__(self, shard, bits: int):
        self.shard, self.bits = shard, bits

    def look_up(self, h: np.ndarray, what: str, often: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(an entry's own number or -1, value, occurrences) of each hash."""
        if not self.bits:
            return self._in(self.shard(0), h, what, often)
        out = np.full(len(h), -1, np.int64), np.zeros(len(h), np.float32), np.zeros(len(h), np.int64)
        number = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(number, kind="stable")
        edges = np.searchsorted(number[order], np.arange((1 << self.bits) + 1))
        for s in np.unique(number).tolist():
            own = order[edges[s] : edges[s + 1]]
            for o, v in zip(out, self._in(self.shard(s), h[own], what, often)):
                o[own] = v
        np.copyto(out[0], h.view(np.int64), where=out[0] >= 0)  # places differ by shard: the hash itself tells entries apart
        return out

    @staticmethod
    def _in(shard: Shard | None, h: np.ndarray, what: str, often: str):
        if shard is None:
            return np.full(len(h), -1, np.int64), np.zeros(len(h), np.float32), np.zeros(len(h), np.int64)
        at = shard.find(h)
        return at, shard.a[what][at], np.where(at >= 0, shard.a[often][at], 0).astype(np.int64)

    def known(self, doc: np.ndarray, sizes: np.ndarray, entry: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Whether the corpus has more occurrences than the document itself."""
        if self.bits:
            out = often > sizes[doc]
        else:  # no document has an entry more often than all of these texts together
            out = often > np.bincount(entry + 1)[entry + 1]
        rare = np.nonzero(~out & (often > 0))[0]
        if len(rare):
            size = len(rare).bit_length()
            packed = hash_of(doc[rare].astype(np.uint64), entry[rare].view(np.uint64), 0) >> np.uint64(size) << np.uint64(size) | np.arange(len(rare), dtype=np.uint64)
            packed.sort()
            place = rare[(packed & np.uint64((1 << size) - 1)).astype(np.int64)]
            group = packed >> np.uint64(size)
            first = np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0]
            own = np.diff(first, append=len(place))
            out[place] = often[place] > np.repeat(own, own)
        return out

    def log_p(self, texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the characters' log-probabilities from order - 1 characters of context, and their number, of each text."""
        points, begins, ends = points_of(texts)
        sizes = ends - begins
        doc = np.repeat(np.arange(len(texts)), sizes)
        at = inside(points, begins)
        score = np.zeros(len(at), np.float64)
        left = np.arange(len(at))
        for k in range(order, 0, -1):
            h = hash_of(*grams(points), k)[at - (ORDER - 1)] if k == ORDER else hash_of(*gram_of(points, at[left], k), k)
            entry, value, often = self.look_up(h, "p", "n")
            known = self.known(doc[left], sizes, entry, often)
            score[left[known]] += value[known]
            left = left[~known]
            if not len(left):
                break
            entry, value, often = self.look_up(hash_of(*gram_of(points, at[left] - 1, k - 1), k - 1), "gamma", "m")
            known = self.known(doc[left], sizes, entry, often)
            score[left[known]] += value[known]
        score[left] -= np.log(CODE_POINTS)
        return np.bincount(doc, weights=score, minlength=len(texts)), sizes


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a 3-word window that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    if n <= LONG_WORDS:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen = Counter(windows)
        often = np.array([seen[w] > 1 for w in windows])
    else:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
        pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
        _, at, count = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        often = count[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= often
    return int(covered.sum())


def base_features(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = text.encode().split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(WHITE_STR):
            seen.add(line)
    chars = len(text) - sum(map(text.count, WHITE_STR))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def open_model(path: str, lang: str, bits: int) -> Model:
    return Model(lambda shard: load_shard(path, lang, shard), bits)


def judge(docs: DataFrame, carry: list[str], models: str, bits: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """carry and, with two underscores before their names, the features, base_failed, language, log-perplexities by orders ORDER and LOW and number of characters."""
    extra = [T.StructField(f"__{n}", T.LongType()) for n in FEATURES] + [T.StructField("__base_failed", T.BooleanType()), T.StructField("__language", T.StringType()), T.StructField("__log_ppl", T.DoubleType()), T.StructField("__low_ppl", T.DoubleType()), T.StructField("__chars", T.LongType())]
    schema = T.StructType([*docs.select(*carry).schema.fields, *extra])
    rows = docs.select(*carry, F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        from graphloom.llm.encoder import slices

        for batch in batches:
            n = batch.num_columns
            langs, texts = batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()
            features = np.array([base_features(t) for t in texts], np.int64).reshape(-1, len(FEATURES))
            scores = {order: np.full(len(texts), np.nan) for order in (ORDER, LOW)}
            for a, b in slices(texts, 1 << 18):
                for lang, at in by_language(langs, range(a, b)).items():
                    model, some = open_model(models, lang, bits), [texts[i] or "" for i in at]
                    for order, score in scores.items():
                        sums, sizes = model.log_p(some, order)
                        with np.errstate(invalid="ignore"):
                            score[at] = -sums / sizes
            failed = (features[:, 0] < 50) | (100 * features[:, 4] > 50 * features[:, 0])
            more = [*(pa.array(f) for f in features.T.copy()), pa.array(failed), pa.array([NO_LANG if x is None else x for x in langs], pa.string()), *(pa.array(s, mask=np.isnan(s)) for s in scores.values()), pa.array([len(t or "") for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], *more], names=[f.name for f in schema.fields])
            trim()
        load_shard.cache_clear()  # the worker lives on, for other work
        trim()

    return rows.mapInArrow(run, schema)


def quality_rules(docs: DataFrame, carry: list[str], below: float = BAND_BELOW, above: float = BAND_ABOVE) -> DataFrame:
    """judge()'s columns, __off and __off_low (deviations from the median of the language, by orders ORDER and LOW) and __kept."""
    small_batches(docs.sparkSession)
    path = scratch(docs.sparkSession, "quality")
    save = lambda df, what: materialize(df, what, posixpath.join(path, what))
    grams = save(count_grams(docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))), "grams")
    models, bits = store(fit(grams, path), path)
    rows = save(judge(docs, carry, models, bits), "judged")
    usual = rows.where("not __base_failed and __log_ppl is not null")
    measures = {"__log_ppl": "__off", "__low_ppl": "__off_low"}
    middle = save(usual.groupBy("__language").agg(*(F.percentile_approx(c, 0.5, 10_000).alias(f"{c}_mid") for c in measures)), "middle")  # a row a language, written: Spark knows its size before it joins
    long = F.col("__chars") >= LONG_DOC
    scaled = lambda x, name: F.coalesce(1.4826 * F.percentile_approx(x, 0.5, 10_000), F.lit(0.0)).alias(name)
    own, whole = [F.count(F.when(long, 1)).alias("__n_mad"), F.count(F.when(~long, 1)).alias("__n_noise")], []
    for c in measures:
        off = F.abs(F.col(c) - F.col(f"{c}_mid"))
        own.append(F.first(f"{c}_mid").alias(f"{c}_mid"))
        for what, x in (("mad", F.when(long, off)), ("noise", F.when(~long, off * F.sqrt("__chars")))):
            own.append(scaled(x, f"{c}_{what}"))
            whole.append(scaled(x, f"{c}_{what}_all"))
    usual = usual.join(middle, "__language")
    corpus = usual.agg(*whole).first().asDict()  # four numbers
    bands = save(usual.groupBy("__language").agg(*own), "bands")
    for c in measures:
        for what in ("mad", "noise"):
            n = F.col(f"__n_{what}")
            shrunk = F.sqrt((n * F.col(f"{c}_{what}") ** 2 + PRIOR * F.lit(corpus[f"{c}_{what}_all"]) ** 2) / (n + PRIOR))
            bands = bands.withColumn(f"{c}_{what}", shrunk * (1 + 2 * DEVIATION_ERROR / F.sqrt(n + PRIOR)))
    rows = rows.join(bands, "__language", "left")
    for c, name in measures.items():
        usual_off = F.sqrt(F.col(f"{c}_mad") ** 2 + F.col(f"{c}_noise") ** 2 / F.col("__chars")) + 1e-9
        rows = rows.withColumn(name, (F.col(c) - F.col(f"{c}_mid")) / usual_off)
    usual_text = (F.col("__off") <= above) & (F.col("__off_low") >= -below)
    return rows.withColumn("__kept", ~F.col("__base_failed") & F.coalesce(usual_text, F.lit(True)))
