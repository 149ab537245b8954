"""Operator 9: URL filter by host rules and a character language-model ratio. DataFrame functions only.

Rules (host, path prefix) decide where one fits, the longest first, block before allow among equals. The
rest is judged by two smoothed variable-order Markov models over characters, one of URLs that rules accept
and one of those that they reject. A model of order k interpolates with the order below (Witten-Bell):

    p_k(c | h) = (n(hc) + t(h) p_{k-1}(c | h')) / (n(h) + t(h))

where t(h) is the number of different characters seen after h, and the order below 0 is uniform over
ALPHABET. The score of a URL is the difference of both log-likelihoods, by length. It's calibrated on
rule-labelled URLs held out of the models (one in FOLDS by hash): the threshold is where both classes, as
normal distributions of the measured mean and spread, are equally often wrong.

The counts of all orders are one table, made from the counts of the highest; a gram's rows in it, one an order,
are joined once and folded from order 0 up. Orders 0 and 1, whose keys are single characters and the empty context,
are sent to the workers (as many rows as there are pairs of characters). Log-ratios are computed once for each
distinct gram; texts meet them in a join on the gram, salted where more than CROWD characters have it, so grams
that nearly every URL has don't land in one task. Nothing is gathered by URL or collected.

Null URL, or without ://: host and path empty, no rule; nothing to score, so the verdict is allow. Where a
class has no URL, there is no threshold and all others are allowed. Repeated rows: judged alike. Host and
path are as written, A-Z of the host lowered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, width

ORDER, FOLDS, SALTS, ALPHABET = 4, 5, 32, 128
#: Characters with one gram from which on it's salted; rows of a table that's sent to the workers.
CROWD, MOST_SENT = 1 << 12, 1 << 17
START = "\x02"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; rules: (verdict, host and path prefix)."""
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[0] != "block", x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    empty = F.lit(None).cast("string")
    return (rule, verdict) if rule is not None else (empty, empty)


def grams(urls: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each character of url: gram, the character after its ORDER predecessors."""
    padded = F.concat(F.lit(START * ORDER), "url")
    at = F.explode(F.sequence(F.lit(1), F.length("url"))).alias("at")
    return urls.where("length(url) > 0").select(*keep, padded.alias("padded"), at).select(*keep, F.expr(f"substring(padded, at, {ORDER + 1})").alias("gram"))


def sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MOST_SENT else table


def log_ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, ratio: ln p(accepted) - ln p(rejected) of each wanted gram. counts: gram, a, r (both classes' counts)."""
    # order k: the last k characters, then the one that follows
    orders = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.expr(f"right(gram, {k + 1})").alias("g")) for k in range(ORDER + 1)))).alias("o")
    before = F.expr("left(g, length(g) - 1)").alias("h")
    seen = materialize(counts.select("a", "r", orders).select("a", "r", "o.*").groupBy("k", "g").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "seen")
    kinds = (F.count(F.when(F.col(c) > 0, 1)).alias(f"t_{c}") for c in "ar")
    heads = materialize(seen.groupBy("k", before).agg(*(F.sum(c).alias(f"n_{c}") for c in "ar"), *kinds), "heads")
    asked = wanted.select("gram").distinct().select("gram", orders).select("gram", "o.*").withColumn("h", before)
    low = asked.where("k < 2").join(sent(seen.where("k < 2")), ["k", "g"], "left").join(sent(heads.where("k < 2")), ["k", "h"], "left")
    high = asked.where("k >= 2").join(seen.where("k >= 2"), ["k", "g"], "left").join(heads.where("k >= 2"), ["k", "h"], "left")
    found = [F.coalesce(c, F.lit(0)).alias(c) for c in ("a", "r", "n_a", "n_r", "t_a", "t_r")]
    rows = low.unionByName(high).groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", *found))).alias("o"))

    def p(c: str) -> Column:
        step = lambda below, o: F.when(o[f"n_{c}"] > 0, (o[c] + o[f"t_{c}"] * below) / (o[f"n_{c}"] + o[f"t_{c}"])).otherwise(below)
        return F.aggregate("o", F.lit(1.0 / ALPHABET), step)

    return rows.select("gram", (F.ln(p("a")) - F.ln(p("r"))).alias("ratio"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides or there's nothing to score)."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("by_rule", verdict)
    # each distinct URL is scored once; it has one rule at most, which its own text decides
    held = (F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("long") % FOLDS == 0).alias("held")
    urls = rows.where("url like '%://%'").groupBy("url").agg(F.first("by_rule").alias("by_rule")).select("url", "by_rule", held)
    urls = materialize(urls.repartition(width(pages.sparkSession), F.xxhash64("url")), "urls")
    fit = grams(urls.where("by_rule is not null and not held"), ["by_rule"])
    counts = fit.groupBy("gram").agg(F.count(F.when(F.col("by_rule") == "allow", 1)).alias("a"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("r"))
    judged = grams(urls.where("by_rule is null or held"), ["url", "by_rule"])
    wanted = materialize(judged.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "wanted")
    crowded = materialize(wanted.where(F.col("n") > CROWD).select("gram", F.lit(SALTS).alias("salts")), "crowded")  # written: Spark knows its size
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    ratios = log_ratios(counts, wanted).join(crowded, "gram", "left").select("gram", "ratio", salts)
    salted = judged.join(crowded, "gram", "left").withColumn("salt", F.pmod(F.xxhash64("url"), F.coalesce("salts", F.lit(1))).cast("int"))
    scores = salted.join(ratios, ["gram", "salt"]).groupBy("url").agg(F.avg("ratio").alias("score"), F.first("by_rule").alias("by_rule"))
    scores = materialize(scores, "scores")
    of = lambda v, f, name: f(F.when(F.col("by_rule") == v, F.col("score"))).alias(name)
    spread = lambda c: F.coalesce(F.stddev_pop(c), F.lit(0.0)) + 1e-6
    limits = scores.agg(of("allow", F.avg, "m_a"), of("block", F.avg, "m_r"), of("allow", spread, "s_a"), of("block", spread, "s_r"))
    limit = limits.select(((F.col("m_a") * F.col("s_r") + F.col("m_r") * F.col("s_a")) / (F.col("s_a") + F.col("s_r"))).alias("threshold"))
    open_ = scores.where("by_rule is null").select(F.col("url").alias("scored"), "score")
    joined = rows.join(open_, (F.col("url") == F.col("scored")) & F.col("by_rule").isNull(), "left")
    joined = joined.withColumn("one", F.lit(1)).join(F.broadcast(limit.withColumn("one", F.lit(1))), "one", "left")  # the one row of an aggregate
    method = F.when(F.col("score") < F.col("threshold"), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "score")
