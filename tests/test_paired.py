"""Pairs of two lists leave a task in runs, not all pairs of two bundles at once."""

from graphloom.operators import joins as jn


def test_pairs_leave_in_runs(spark, monkeypatch):
    monkeypatch.setattr(jn, "BUNDLE", 40)
    monkeypatch.setattr(jn, "UNFOLDED", 16)
    calls = spark.createDataFrame([(f"c{i}" if i else None, "s") for i in range(50)] + [("c1", "t")], "src string, symbol string")
    nodes = spark.createDataFrame([(i or None, "s") for i in range(30)] + [(7, None)], "dst long, symbol string")
    out = jn.paired(calls, nodes.where("symbol is not null"))
    want = [(f"c{i}" if i else None, d or None) for i in range(50) for d in range(30)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Generate") == 1  # two, one upon the other, hold all pairs of two bundles
    assert out.schema.simpleString() == "struct<src:string,dst:bigint>"
    assert jn.paired(calls, nodes.limit(0)).count() == 0
