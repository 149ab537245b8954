"""Steps and plug-ins: named DataFrame functions, chained by keys; injected functions in place of model calls."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Steps:
    """A registry of steps; run() chains configured ones by the keys of their inputs and outputs."""

    def __init__(self):
        self.known: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str):
        def add(f: Callable[..., DataFrame]):
            self.known[name] = f
            return f

        return add

    def run(self, config: list[dict], inputs: dict[str, DataFrame], common: dict | None = None) -> dict[str, DataFrame]:
        """config: dicts with name, input, output and the step's own options, over those common to all."""
        held = dict(inputs)
        for step in config:
            options = (common or {}) | {k: v for k, v in step.items() if k not in ("name", "input", "output")}
            if step["name"] not in self.known:
                raise KeyError(f"no step named {step['name']}")
            held[step["output"]] = self.known[step["name"]](held[step["input"]], **options)
        return held


def rejection_sampling(rows: DataFrame) -> DataFrame:
    """(input, output, reward, seq): the first best output of each input."""
    from graphloom.operators.aggregates import best_of

    return best_of(rows, ["input"], "reward", "seq")


def conditional(rows: DataFrame, template: str = "{input} <reward>{reward}") -> DataFrame:
    from graphloom.functions.text import with_reward

    return rows.withColumn("input", with_reward(F.col("input"), F.col("reward"), template))


def pairs(rows: DataFrame) -> DataFrame:
    from graphloom.operators.aggregates import preference_pairs

    return preference_pairs(rows, "input", "reward", "seq")


PROCESSORS: dict[str, Callable[[DataFrame], DataFrame]] = {"rs": rejection_sampling, "csft": conditional, "iter_dpo": pairs}


def scorer(f: Callable[[list[str], list[str]], list[float]], prompt: Column, completion: Column) -> Column:
    """A reward function of lists of prompts and completions, applied a batch at a time."""

    @F.pandas_udf("double")
    def run(p: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(f(p.tolist(), c.tolist()), dtype="float64")

    return run(prompt, completion)


def weighted_scores(scores: list[tuple[Column, float]]) -> Column:
    from graphloom.operators.aggregates import weighted_reward

    return weighted_reward(F.array(*(c for c, _ in scores)), [w for _, w in scores])


def extractor(f: Callable[[str], dict], schema: str, text: Column) -> Column:
    """A function of a text to a row, injected in place of a model call."""

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(x) for x in s])

    return run(text)


def cached_map(rows: DataFrame, cache: DataFrame, key_text: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, value) for all rows: from the cache (key, value), else by work on the distinct misses (key and key_text)."""
    from graphloom.sources.files import cache_misses

    misses = cache_misses(rows.select(key_text), cache, key_text).dropDuplicates(["key"])
    known = cache.join(rows.select(F.md5(F.col(key_text)).alias("key")).distinct(), "key", "left_semi")
    return known.select("key", "value").unionByName(work(misses).select("key", "value"))


def explode_extracted(rows: DataFrame, f: Callable[[str], list[dict]], schema: str, text: str) -> DataFrame:
    """One row for each of the rows that f makes of a text."""

    @F.pandas_udf(f"array<struct<{schema}>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(x or ""))

    return rows.withColumn("__made", run(text)).select("*", F.inline("__made")).drop("__made")


class Tools:
    """Named DataFrame functions with argument specifications: (type, required) by argument."""

    def __init__(self):
        self.known: dict[str, tuple[Callable[..., DataFrame], dict[str, tuple[type, bool]]]] = {}

    def register(self, name: str, **spec: tuple[type, bool]):
        def add(f: Callable[..., DataFrame]):
            self.known[name] = (f, spec)
            return f

        return add

    def call(self, name: str, rows: DataFrame, **arguments) -> DataFrame:
        """Run a tool; KeyError for unknown names, TypeError for arguments that don't fit its specification."""
        f, spec = self.known[name]
        missing = [k for k, (_, required) in spec.items() if required and k not in arguments]
        wrong = [k for k, v in arguments.items() if k not in spec or not isinstance(v, spec[k][0])]
        if missing or wrong:
            raise TypeError(f"{name}: missing {missing}, wrong {wrong}")
        return f(rows, **arguments)
