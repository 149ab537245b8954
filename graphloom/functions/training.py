"""Expressions on arrays of tokens, rewards and log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import let

IGNORED = -100


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def best_cut(n: Column, b: int) -> Column:
    """The largest x up to min(n, b) that divides b."""
    return F.array_max(F.filter(F.sequence(F.lit(1), F.least(n, F.lit(b)).cast("int")), lambda x: F.lit(b) % x == 0))


def approximate_kl(log_p: Column, log_base: Column, kind: str = "k1") -> Column:
    """Per-token estimates of the divergence: k1 the difference, k2 half its square, k3 unbiased and positive."""
    k1 = F.zip_with(log_p, log_base, lambda a, b: a - b)
    if kind == "k2":
        return F.transform(k1, lambda x: x * x / 2)
    return F.transform(k1, lambda x: F.exp(-x) - 1 + x) if kind == "k3" else k1


def adaptive_coefficient(initial: float, kls: Column, target: float, horizon: int, steps: int, clip: float = 0.2) -> Column:
    """The coefficient after a sequence of observed divergences."""
    return F.aggregate(kls, F.lit(float(initial)), lambda v, k: v * (1 + F.greatest(F.least(k / target - 1, F.lit(clip)), F.lit(-clip)) * steps / horizon))


def log_sum_exp(a: Column) -> Column:
    within = lambda a: let(F.array_max(a), lambda m: m + F.ln(total(F.transform(a, lambda x: F.exp(x - m)))))
    return let(a, within)


def log_softmax_at(logits: Column, i: Column) -> Column:
    """log-probability of index i (from 0)."""
    return F.element_at(logits, (i + 1).cast("int")) - log_sum_exp(logits)


def pad(a: Column, size: Column, side: str = "left", value=0) -> Column:
    fill = F.array_repeat(F.lit(value), F.greatest(size - F.size(a), F.lit(0)).cast("int"))
    return F.concat(fill, a) if side == "left" else F.concat(a, fill)


def trim_padding(a: Column, mask: Column) -> Column:
    """The values from the first to the last place that the mask keeps."""
    first = F.array_position(mask, 1)
    last = F.size(mask) - F.array_position(F.reverse(mask), 1) + 1
    return F.when(first > 0, F.slice(a, first.cast("int"), (last - first + 1).cast("int"))).otherwise(F.slice(a, 1, 0))


def masks(ids: Column, prompt_length: Column, end: int, padding: int) -> Column:
    """Struct of attention and action masks: actions are what follows the prompt, up to and with the first end id."""
    n = F.size(ids)
    tail = F.slice(ids, (prompt_length + 1).cast("int"), F.greatest(n - prompt_length, F.lit(0)).cast("int"))
    at = F.array_position(tail, end)
    stop = F.when(at > 0, prompt_length + at).otherwise(n)
    return F.struct(
        F.transform(ids, lambda x, i: ((x != padding) & (i < stop)).cast("int")).alias("attention"),
        F.transform(tail, lambda x, i: (i + prompt_length < stop).cast("int")).alias("action"),
    )


def scatter_labels(ids: Column, placeholder: int, labels: Column) -> Column:
    """The k-th label at the k-th placeholder, IGNORED elsewhere; labels beyond are dropped."""
    seen = lambda i: F.size(F.filter(F.slice(ids, 1, i + 1), lambda y: y == placeholder))
    return F.transform(ids, lambda x, i: F.when(x == placeholder, F.coalesce(F.try_element_at(labels, seen(i)), F.lit(IGNORED))).otherwise(F.lit(IGNORED)))


def response_ranges(lengths: Column, is_response: Column) -> Column:
    """(first, last) token offsets of the responses among consecutive segments."""
    before = lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda s, x: s + x.cast("int"))
    both = F.transform(lengths, lambda n, i: F.struct(before(i).alias("first"), (before(i) + n.cast("int") - 1).alias("last"), F.element_at(is_response, i + 1).alias("own")))
    return F.transform(F.filter(both, lambda x: x["own"]), lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last")))


def sft_labels(ids: Column, attention: Column, ranges: Column) -> Column:
    """The ids inside response ranges and attended to, IGNORED elsewhere."""
    inside = lambda i: F.exists(ranges, lambda r: (i >= r["first"]) & (i <= r["last"]))
    return F.transform(ids, lambda x, i: F.when((F.element_at(attention, i + 1) == 1) & inside(i), x).otherwise(F.lit(IGNORED)))


def log_sigmoid(x: Column) -> Column:
    return -(F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0)))


def policy_loss(log_p: Column, old: Column, advantage: Column, clip: float = 0.2) -> Column:
    ratio = F.exp(log_p - old)
    return -F.least(ratio * advantage, F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip)) * advantage)


def value_loss(value: Column, old: Column, returns: Column, clip: float = 0.2) -> Column:
    clipped = old + F.least(F.greatest(value - old, F.lit(-clip)), F.lit(clip))
    return 0.5 * F.greatest((clipped - returns) * (clipped - returns), (value - returns) * (value - returns))


def pairwise_loss(chosen: Column, rejected: Column, margin: Column | None = None) -> Column:
    return -log_sigmoid(chosen - rejected - (margin if margin is not None else F.lit(0.0)))


def log_exp_loss(chosen: Column, rejected: Column) -> Column:
    return F.log1p(F.exp(rejected - chosen))


def dpo_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1, smoothing: float = 0.0, ipo: bool = False) -> Column:
    x = (chosen - rejected) - (ref_chosen - ref_rejected)
    if ipo:
        return (x - 1 / (2 * beta)) * (x - 1 / (2 * beta))
    return -log_sigmoid(beta * x) * (1 - smoothing) - log_sigmoid(-beta * x) * smoothing


def kto_loss(log_p: Column, ref: Column, kl: Column, desirable: Column, beta: float = 0.1, weight: float = 1.0, undesirable_weight: float = 1.0) -> Column:
    """1 - sigmoid of the gain over the reference point, either way round; the point is kl, at least 0."""
    gain = beta * (log_p - ref - F.greatest(kl, F.lit(0.0)))
    sigmoid = lambda x: F.exp(log_sigmoid(x))
    return F.when(desirable, weight * (1 - sigmoid(gain))).otherwise(undesirable_weight * (1 - sigmoid(-gain)))


def cross_entropy(logits: Column, label: Column) -> Column:
    return -log_softmax_at(logits, label)


def language_model_loss(logits: Column, labels: Column) -> Column:
    """Mean cross-entropy of each next label (IGNORED left out) by the logits before it; null where there's none."""
    pairs = F.filter(F.arrays_zip(F.slice(logits, 1, F.greatest(F.size(logits) - 1, F.lit(0))).alias("x"), F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))).alias("y")), lambda p: p["y"] != IGNORED)
    return F.when(F.size(pairs) > 0, total(F.transform(pairs, lambda p: cross_entropy(p["x"], p["y"]))) / F.size(pairs))


def distillation_loss(student: Column, teacher: Column) -> Column:
    """Cross-entropy of the teacher's distribution under the student's, for one token's logits."""

    def within(p: Column) -> Column:
        norms = F.struct(log_sum_exp(p["t"]).alias("t"), log_sum_exp(p["s"]).alias("s"))
        return let(norms, lambda n: -total(F.zip_with(p["t"], p["s"], lambda a, b: F.exp(a - n["t"]) * (b - n["s"]))))

    return let(F.struct(teacher.alias("t"), student.alias("s")), within)


def process_reward_loss(logits: Column, labels: Column) -> Column:
    """Struct of mean cross-entropy and accuracy over the places that have a label."""
    pairs = F.filter(F.arrays_zip(logits.alias("x"), labels.alias("y")), lambda p: p["y"] != IGNORED)
    n = F.size(pairs)
    right = F.size(F.filter(pairs, lambda p: F.array_position(p["x"], F.array_max(p["x"])) == p["y"] + 1))
    return F.when(n > 0, F.struct((total(F.transform(pairs, lambda p: cross_entropy(p["x"], p["y"]))) / n).alias("loss"), (right / n).alias("accuracy")))


def sequence_log_prob(log_ps: Column, prompt_length: Column, mean: bool = False) -> Column:
    """Sum (or mean) of the log-probabilities behind the prompt."""
    own = F.slice(log_ps, (prompt_length + 1).cast("int"), F.greatest(F.size(log_ps) - prompt_length, F.lit(0)).cast("int"))
    return F.when(F.size(own) > 0, total(own) / F.size(own)) if mean else total(own)
