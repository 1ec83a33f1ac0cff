"""Windows over blocks, selection and spreading against brute force."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracegrid.operators import blocks as bl
from tracegrid.operators import quantiles as qu

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SLOW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.one_of(st.none(), st.integers(0, 5))), min_size=1, max_size=40, unique_by=lambda r: r[:2]), st.integers(1, 30))
def test_along_by_brute_force(spark, rows, width):
    df = spark.createDataFrame([(k, t, v, "x") for k, t, v in rows] + [(None, 1, 1, "x")], "k string, t bigint, v int, other string")
    got = bl.along(df, ["k"], ["t"], F.expr(f"t div {width}"), before=["t", "v"], after=["t"], number="n", latest={"up": F.col("v")}, upcoming={"down": F.col("v")}, sums={"s": F.col("v")})
    found = {(r.k, r.t): (r.before and tuple(r.before), r.after and r.after.t, r.n, r.up, r.down, r.s, r.other) for r in got.collect()}
    expected = {}
    for key in {k for k, *_ in rows}:
        own = sorted((t, v) for k, t, v in rows if k == key)
        for i, (t, _) in enumerate(own):
            upto, onwards = [x for _, x in own[: i + 1] if x is not None], [x for _, x in own[i:] if x is not None]
            expected[key, t] = (own[i - 1] if i else None, own[i + 1][0] if i + 1 < len(own) else None, i + 1, upto[-1] if upto else None, onwards[0] if onwards else None, sum(upto), "x")
    assert found == expected


def test_along_of_nothing_and_without_neighbours(spark):
    df = spark.createDataFrame([("a", 1, 2)], "k string, t bigint, v int")
    assert bl.along(df.limit(0), ["k"], ["t"], F.lit(0), number="n").count() == 0
    r = bl.along(df, ["k"], ["t"], F.lit(0), before=["v"], after=["v"], number="n").first()
    assert (r.before, r.after, r.n, r.v) == (None, None, 1, 2)


def test_stored_once(spark):
    rows = [("f", 1, i, float(i), j) for i in (0, 1, bl.BLOCK - 1, bl.BLOCK, 3 * bl.BLOCK) for j in range(2)] + [("f", 1, None, 5.0, 0)] * 2 + [("f", 2, 0, None, 0)]
    s = spark.createDataFrame(rows, "file string, channel_id int, sample_index bigint, value double, n int")
    got = bl.stored_once(s.repartition(5)).collect()
    assert sorted((r.channel_id, -1 if r.sample_index is None else r.sample_index) for r in got) == [(1, -1), (1, -1), (1, 0), (1, 1), (1, bl.BLOCK - 1), (1, bl.BLOCK), (1, 3 * bl.BLOCK), (2, 0)]


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("c").alias("y")).repartition(7)
    assert all(r.x == r.at for r in bl.numbered(df, [F.col("x").asc()], "at").collect())
    assert bl.numbered(df.limit(0), [F.col("x").asc()], "at").count() == 0


@pytest.mark.parametrize("sorted_at_once", [1 << 20, 50])
def test_exact_quantiles(spark, monkeypatch, sorted_at_once):
    monkeypatch.setattr(qu, "SORTED", sorted_at_once)
    r = np.random.default_rng(3)
    groups = {"many": r.normal(size=6000).round(3), "ties": r.choice([1.0, 2.0, 3.0], 3000), "one": np.array([4.5]), "two": np.array([1.0, 2.0])}
    rows = [(k, float(v), 1) for k, x in groups.items() for v in x] + [("many", None, 1), ("many", float("nan"), 1), ("none", None, 1), (None, 1.0, 1), ("many", float("inf"), 1)]
    df = spark.createDataFrame(rows, "k string, value double, n int").repartition(5)
    ranks = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    got = {x.k: x for x in qu.exact_quantiles(df, ["k"], ranks).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k].n == len(x) and np.allclose(got[k].quantiles, np.quantile(x, ranks), rtol=0, atol=1e-12)
    for x in qu.exact_quantiles(df, ["k"], ranks, discrete=True).collect():
        assert x.quantiles == np.quantile(groups[x.k], ranks, method="inverted_cdf").tolist()
    assert qu.exact_quantiles(df.limit(0), ["k"], ranks).count() == 0


def test_partitions_follow_the_input(spark, monkeypatch, tmp_path):
    from tracegrid import runtime

    spark.range(200_000).withColumn("x", F.rand(1)).repartition(4).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert "hashpartitioning(id" in runtime.spread(t, t, "id")._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(runtime, "BYTES_A_TASK", 1 << 16)
    wide = runtime.spread(t, t, "id")
    assert wide.rdd.getNumPartitions() > 4 and wide.count() == 200_000
    # A source of unknown size leaves the session's number.
    rdd = spark.createDataFrame([(1,)], "id int")
    assert runtime.spread(rdd, rdd, "id").count() == 1
