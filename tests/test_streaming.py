"""State across micro-batches and restarts, and exactly-once incremental output."""

import glob
import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import stateful as S
from graphloom.streaming.incremental import read_log
from graphloom.streaming.ledger import Ledger

SCHEMA = "k long, seq long, x double"


def rows(rng, n, first=0):
    return [(rng.choice([1, 2, 3, None]), first + i, rng.choice([None, rng.uniform(0, 40)])) for i in range(n)]


def fed(spark, folder, run, parts):
    """run(stream) after each part, as a query that starts anew each time; some parts in several files, so that a query has more batches."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").json(f"{folder}/log")
        run(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/log"))


def test_buffer_outlives_its_query(spark, tmp_path):
    rng, folder = random.Random(1), f"file://{tmp_path}"
    parts = [rows(rng, 40), rows(rng, 25, 40), rows(rng, 3, 65), [(9, 500, 1.0)]]
    fed(spark, folder, lambda s: S.run_to_end(S.newest_rows(s, "k", "seq", 4), f"{folder}/gone", f"{folder}/ck"), parts)
    every = [r for p in parts for r in p]
    want = set()
    for k in {r[0] for r in every}:
        want |= set(sorted((r for r in every if r[0] == k), key=lambda r: r[1])[-4:])
    assert {tuple(r) for r in S.state_of(spark, f"{folder}/ck", "buffer").select("k", "seq", "x").collect()} == want
    gone = [tuple(r) for r in spark.read.parquet(f"{folder}/gone").select("k", "seq", "x").collect()]
    assert len(gone) == len(every) - len(want) and set(gone) | want == set(every)


def test_controller_goes_on(spark, tmp_path):
    rng, folder = random.Random(2), f"file://{tmp_path}"
    parts = [rows(rng, 30), rows(rng, 30, 30)]
    fed(spark, folder, lambda s: S.run_to_end(S.adaptive_controller(s, "k", "x", 0.2, 20.0, 100, 4), f"{folder}/out", f"{folder}/ck"), parts)
    state = {r.k: (r.coefficient, r.updates) for r in S.state_of(spark, f"{folder}/ck", "controller").collect()}
    for k in (1, 2, 3, None):
        xs = [r[2] for p in parts for r in p if r[0] == k and r[2] is not None]
        assert state[k][1] == len(xs)
        assert state[k][0] == pytest.approx(0.2 * math.prod(1 + max(-0.2, min(0.2, x / 20 - 1)) * 4 / 100 for x in xs))


def test_counters_are_reset(spark, tmp_path):
    rng, folder = random.Random(3), f"file://{tmp_path}"
    parts = [rows(rng, 30), rows(rng, 30, 30)]

    def run(s):
        s = s.select("k", "seq", F.col("seq").alias("n"), (F.col("x") > 30).alias("again"))
        S.run_to_end(S.running_totals(s, "k", "seq", "n", "again"), f"{folder}/out", f"{folder}/ck")

    # one file a part: batches must follow each other in order
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/log")
        run(read_log(spark, f"{folder}/log", SCHEMA))
    want, used = {}, {}
    for k, seq, x in (r for p in parts for r in p):
        used[k] = seq + (0 if x is not None and x > 30 else used.get(k, 0))
        want[seq] = (k, used[k])
    assert {r.seq: (r.k, r.used) for r in spark.read.parquet(f"{folder}/out").collect()} == want


def ids(ledger):
    return sorted(((r.id, r.x) for r in ledger.rows().collect()), key=lambda r: (r[0] is None, r[0]))


def table(spark, values):
    return spark.createDataFrame([(v, f"t{v}") for v in values], "id long, x string")


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_ledger(spark, tmp_path, format):
    led = Ledger(spark, f"file://{tmp_path}/l", ["id"], buckets=8, slots=256, format=format)
    assert led.rows() is None and led.last() == -1
    seen = []
    work = lambda d: (seen.append(d.count()), d)[1]
    assert led.process(table(spark, [1, 2, 3, 3, None]), work)
    assert led.process(table(spark, [2, 3, 4, None, *range(100, 140)]), work)
    assert seen == [4, 41]
    assert sorted(map(str, ids(led))) == sorted(map(str, [(v, f"t{v}") for v in (1, 2, 3, None, 4, *range(100, 140))]))
    assert not led.process(table(spark, [77]), work, epoch=1), "an epoch that is committed is not run again"
    again = Ledger(spark, f"file://{tmp_path}/l", ["id"], buckets=8, slots=256, format=format)
    assert again.last() == 1 and again.process(table(spark, [1, 4]), work)
    assert seen[-1] == 0 and len(ids(again)) == 45


def test_killed_between_write_and_commit(spark, tmp_path):
    led = Ledger(spark, f"file://{tmp_path}/l", ["id"], buckets=4)
    led.process(table(spark, range(10)), lambda d: d)
    led.write(table(spark, range(5, 15)), 1, lambda d: d)  # and then the driver is lost
    assert len(ids(led)) == 10
    after = Ledger(spark, f"file://{tmp_path}/l", ["id"], buckets=4)
    led.write(table(spark, [500]), 1, lambda d: d)  # lost again, with another batch: its key isn't done
    assert after.process(table(spark, range(5, 15)), lambda d: d)
    assert ids(after) == [(v, f"t{v}") for v in range(15)]
    assert after.process(table(spark, [500]), lambda d: d) and ids(after)[-1] == (500, "t500")
    assert after.process(table(spark, range(20)), lambda d: d) and ids(after) == [(v, f"t{v}") for v in (*range(20), 500)]


def test_few_keys_read_few_buckets(spark, tmp_path):
    led = Ledger(spark, f"file://{tmp_path}/l", ["id"], buckets=64)
    led.process(table(spark, range(2000)), lambda d: d)
    led.process(table(spark, [5, 9, 10**6, 10**6 + 1]), lambda d: d)
    assert 1 <= len(led.read_buckets) <= 4
    led.process(table(spark, range(5 * 10**6, 5 * 10**6 + 40)), lambda d: d)
    assert len(led.read_buckets) <= 4, "filters let hardly any new key through"
    assert len(ids(led)) == 2042
    read = led._stored("keys", led.read_buckets or [0], led.last())
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_stream_is_followed_once(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for values in (range(10), range(5, 20), [3]):
        table(spark, values).coalesce(1).write.mode("append").json(f"{folder}/log")
        Ledger(spark, f"{folder}/l", ["id"], buckets=4).follow(read_log(spark, f"{folder}/log", "id long, x string"), f"{folder}/ck", lambda d: d)
    led = Ledger(spark, f"{folder}/l", ["id"], buckets=4)
    assert ids(led) == [(v, f"t{v}") for v in range(20)]
    assert glob.glob(f"{tmp_path}/l/commits/*")


def test_loop_ends_on_an_empty_draw(spark, tmp_path):
    from graphloom.streaming.incremental import train_loop

    updates = []
    run = lambda n: train_loop(table(spark, range(n)), Ledger(spark, f"file://{tmp_path}/l", ["id"], buckets=4), "id", 4, lambda rows, step: rows, lambda b, step: updates.append((step, b.count())))
    assert run(10) == 3 and updates == [(0, 4), (1, 4), (2, 2)]
    assert run(10) == 3 and len(updates) == 3
    assert run(13) == 4 and updates[-1] == (3, 3)
    assert ids(Ledger(spark, f"file://{tmp_path}/l", ["id"], buckets=4)) == [(v, f"t{v}") for v in range(13)]


def test_barrier_waits_for_all(spark):
    import pyarrow as pa

    from graphloom.streaming.incremental import in_barrier

    def run(batches, offset):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("actor"), b.column("seq"), pa.array(range(offset, offset + b.num_rows), pa.int64())], ["actor", "seq", "place"])
            offset += b.num_rows

    rows = [(i % 3, 100 - i) for i in range(50)]
    table_ = spark.createDataFrame(rows, "actor long, seq long").repartition(5)
    got = [tuple(r) for r in in_barrier(table_, 3, run, "actor long, seq long, place long").collect()]
    assert sorted(got) == [(*r, i) for i, r in enumerate(sorted(rows))]
    with pytest.raises(Exception, match="submitted nothing: \\[1\\]"):
        in_barrier(table_.where("actor <> 1"), 3, run, "actor long, seq long, place long").collect()


def test_a_draw_sorts_only_its_last_range(spark):
    """The same rows as a sort of all with a limit, without one task that takes them."""
    from graphloom.streaming.incremental import earliest

    rows, order = spark.range(5000).repartition(3), [F.xxhash64(F.lit(0), "id"), F.col("id")]
    for most in (0, 1, 1700, 4999, 5000, 9000):
        drawn, n = earliest(rows, order, most)
        assert n == min(most, 5000)
        assert sorted(r.id for r in drawn.collect()) == sorted(r.id for r in rows.orderBy(*order).limit(most).collect())
    drawn, _ = earliest(rows, order, 1700)
    last = drawn._jdf.queryExecution().analyzed().toString()
    assert "Union" in last and last.index("Union") < last.index("GlobalLimit")  # the limit is on the last range only
    assert earliest(rows.limit(0), order, 5)[1] == 0
