import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.errors import DataRefusal, NumericRefusal, RandomRefusal
from lumenframe.operators import compare, join, matrix, random, select, stats


def frame(spark, **cols):
    return spark.createDataFrame(pa.table(cols))


def test_selection(spark):
    df = frame(spark, z=pa.array([1, 2, 3, 2, None, 2]), s=pa.array([2.0, 4, 6, None, 10, 8]), w=pa.array([1, 3, 2, 1, 1, 5]))
    row = select.select_stats(df, "z", 1, 3, "s", "w").first()
    assert (row["selected"], row["used"], row["weight_sum"]) == (4, 3, 9.0) and row["mean"] == pytest.approx(54 / 9)
    with pytest.raises(DataRefusal):
        select.select_stats(df, "z", 3, 1, "s")
    for lo, w in ((9, None), (1, "w")):
        bad = df.withColumn("w", F.lit(0))
        with pytest.raises(Exception, match="G601"):
            select.select_stats(bad, "z", lo, lo + 1, "s", w).collect()


def test_predicates(spark):
    df = frame(spark, a=pa.array([1, None, 3]))
    n = lambda p: df.filter(select.predicate(p)).count()
    assert [n(select.where("a", op, 1)) for op in ("==", "!=", "<", ">=")] == [1, 1, 0, 2]
    assert n(select.where("a", "is_null")) == 1 and n(select.any_of([select.where("a", "is_null"), select.where("a", "==", 3)])) == 2
    with pytest.raises(DataRefusal):
        select.all_of([])
    deep = select.where("a", "==", 1)
    with pytest.raises(DataRefusal):
        for _ in range(20):
            deep = select.all_of([deep])


def test_reductions(spark):
    df = frame(spark, i=pa.array(range(3)), x=pa.array([1e16, 1.0, -1e16]))
    assert stats.compensated_sum(df, "x") == 1.0 and stats.compensated_sum(df, "x", "i", exact=True) == 1.0
    big = frame(spark, x=pa.array([1.7e308, 1.7e308]))
    assert big.agg(stats.scaled_mean("x").alias("m")).first()["m"] == pytest.approx(1.7e308)
    with pytest.raises(NumericRefusal):
        stats.compensated_sum(big, "x")
    empty = df.where("i > 9")
    with pytest.raises(DataRefusal):
        stats.compensated_sum(empty, "x")
    for agg in (stats.median("x"), stats.std_population("x"), stats.ecdf("x", 1)):
        with pytest.raises(Exception, match="G601"):
            empty.agg(agg).collect()
    with pytest.raises(Exception, match="G601"):
        df.where("i = 0").agg(stats.std_sample("x")).collect()
    q = frame(spark, x=pa.array([4.0, 1, 3, 2]))
    assert q.agg(stats.quantile("x", 0.25)).first()[0] == 1.75
    s = frame(spark, x=pa.array([2.0, 4, 4, 4, 5, 5, 7, 9])).agg(stats.std_population("x"), stats.std_sample("x")).first()
    assert s[0] == 2.0 and s[1] == pytest.approx(math.sqrt(32 / 7))


def test_statistics_are_compensated(spark):
    df = frame(spark, x=pa.array([1e16, 1.0, -1e16, 1.0])).coalesce(1)
    row = stats.scan_stats(df, "x").first()
    assert (row["count"], row["sum"], row["mean"], row["min"], row["max"]) == (4, 2.0, 0.5, -1e16, 1e16)
    gap = frame(spark, x=pa.array([1e16, None, 1.0, -1e16])).repartition(3)
    assert tuple(stats.column_stats(gap, "x").first()) == (3, 1 / 3, -1e16, 1e16)
    for bad in (gap, df.where("x > 1e17")):
        with pytest.raises(Exception, match="G601"):
            stats.scan_stats(bad, "x").collect()
    with pytest.raises(Exception, match="G601"):
        stats.column_stats(df.where("x > 1e17"), "x").collect()
    a = spark.createDataFrame([(0, k, v) for k, v in enumerate([1e16, 1.0, -1e16])], "row long, col long, value double")
    one = spark.createDataFrame([(k, 0, 1.0) for k in range(3)], "row long, col long, value double")
    assert matrix.multiply_compensated(a, one).first()["value"] == 1.0


def test_ordered_sum_over_many_ranges(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(200_000) * 10.0 ** rng.integers(-12, 12, 200_000)
    df = spark.createDataFrame(pa.table({"i": np.arange(len(x)), "x": x})).repartition(9)
    assert stats.compensated_sum(df, "x", "i", exact=True) == sum(stats.neumaier(x))
    gap = frame(spark, x=pa.array([1.0, None, 3.0]), y=pa.array([1.0, 2.0, 4.0]))
    for agg in (stats.std_population("x"), stats.std_sample("x")):
        with pytest.raises(Exception, match="G601"):
            gap.agg(agg).collect()
    with pytest.raises(Exception, match="G601"):
        stats.covariance(gap, ["x", "y"], 1).collect()


def test_two_sum_matches_fsum():
    rng = np.random.default_rng(3)
    x = rng.standard_normal(10_001) * 10.0 ** rng.integers(-20, 20, 10_001)
    s, e = stats.two_sum(x)
    assert s + e == pytest.approx(math.fsum(x), rel=1e-15)


def test_histogram(spark):
    df = frame(spark, x=pa.array([0.0, 1, 2, 3, 4]))
    assert [r["n"] for r in stats.histogram(df, "x", 4).orderBy("bin").collect()] == [1, 1, 1, 2]
    same = frame(spark, x=pa.array([5.0, 5]))
    assert [r["n"] for r in stats.histogram(same, "x", 4, True).orderBy("bin").collect()] == [0, 0, 2, 0]
    with pytest.raises(Exception, match="G202"):
        stats.histogram(same, "x", 4).collect()


def test_rows(spark):
    df = stats.with_ordinal(spark.range(100).select((F.lit(99) - F.col("id")).alias("k")).repartition(7), "k")
    assert df.where("_ord <> k").count() == 0
    assert sorted(r["_ord"] for r in stats.even_rows(df, 4).collect()) == [0, 33, 66, 99]
    assert stats.row_slice(df, 5, 8).count() == 3


def test_ordinals_of_many_wide_rows(spark):
    # more rows than the range exchange samples, with a payload that the result uses
    n = 2_000_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("payload"), "id").repartition(16)
    got = stats.with_ordinal(rows, "k")
    good = (F.col("_ord") == F.col("k")) & (F.col("payload") == F.repeat(F.sha2(F.col("id").cast("string"), 256), 2))
    out = got.agg(F.count("*").alias("n"), F.count_distinct("_ord").alias("places"), F.min("_ord").alias("lo"), F.max("_ord").alias("hi"), F.count_if(good).alias("good"), F.sum(F.length("payload")).alias("chars")).first()
    assert tuple(out) == (n, n, 0, n - 1, n, 128 * n)
    tied = stats.with_ordinal(rows.select((F.col("k") % 3).alias("k"), "payload"), "k").agg(F.count("*").alias("n"), F.count_distinct("_ord").alias("places"), F.max("_ord").alias("hi")).first()
    assert tuple(tied) == (n, n, n - 1)


def test_join(spark):
    left = frame(spark, id=pa.array(["9007199254740993", "9007199254740992", "0007", "7"]), value=pa.array(["a", "b", "c", "d"]))
    right = frame(spark, id=pa.array(["7", "9007199254740992", "9007199254740993", "8"]), value=pa.array(["x", "y", "z", "w"]))
    out = join.join_one_to_one(left, right, "id", "id", "left", "L_", "R_")
    assert out.columns == ["__join_matched", "L_id", "L_value", "R_id", "R_value"]
    assert {r["L_id"]: (r["__join_matched"], r["R_value"]) for r in out.collect()} == {"9007199254740993": (True, "z"), "9007199254740992": (True, "y"), "0007": (False, None), "7": (True, "x")}
    for bad in (["9", "9"], ["", "1"], ["\\N", "1"], [None, "1"]):
        with pytest.raises(DataRefusal):
            join.join_one_to_one(left, frame(spark, id=pa.array(bad, pa.string()), v=pa.array(["", ""])), "id", "id", "inner", "L_", "R_")
    with pytest.raises(DataRefusal):
        join.join_one_to_one(left, right, "id", "id", "inner", "", "")
    with pytest.raises(DataRefusal):
        join.join_one_to_one(left, right, "id", "id", "full", "L_", "R_")


def test_published_words():
    assert [random.Stream(42, 54).word() for _ in range(1)] == [0xA15C02B7]
    s = random.Stream(42, 54)
    assert [s.word() for _ in range(4)] == [0xA15C02B7, 0x7B47F409, 0xBA1D3330, 0x83D2F293]
    assert random.Stream(42, 54).words(4).tolist() == [0xA15C02B7, 0x7B47F409, 0xBA1D3330, 0x83D2F293]


def test_streams(spark):
    a, b = random.Stream(1, 2), random.Stream(1, 2)
    assert a.uniforms(1000).tolist() == [b.uniform() for _ in range(1000)] and a.state == b.state
    assert a.indices(500, 7).tolist() == [b.integer(0, 7) for _ in range(500)] and a.state == b.state
    got = [r["u"] for r in random.uniform_frame(spark, 1, 2, 1000, chunk=64).orderBy("i").collect()]
    assert got == random.Stream(1, 2).uniforms(1000).tolist()
    runs = random.Streams()
    runs.seed(5, 1)
    with pytest.raises(RandomRefusal):
        runs.seed(6, 1)
    with pytest.raises(RandomRefusal):
        runs[2]
    with pytest.raises(RandomRefusal):
        a.integer(3, 3)


def test_resampling(spark):
    df = frame(spark, k=pa.array(range(5)), v=pa.array([10.0, 20, 30, 40, 50]))
    want = random.Stream(9, 1).indices(8, 5)
    assert [r["value"] for r in random.resample(df, "v", "k", 8, 9, 1).orderBy("pos").collect()] == [10.0 * (i + 1) for i in want]
    idx = random.Stream(9, 1).indices(15, 5).reshape(3, 5)
    got = [r["value"] for r in random.bootstrap(df, "v", "k", 3, "mean", 9, 1).orderBy("rep").collect()]
    assert got == pytest.approx([float(np.mean(10.0 * (i + 1))) for i in idx])


def test_draws_go_on_after_rejected_words(spark):
    # one word in 2049 is rejected
    size, n = 2**64 // 2049 + 1, 20_000
    got = [r["idx"] for r in random.index_frame(spark, 4, 1, n, size, chunk=1 << 10).orderBy("i").collect()]
    assert (random.Stream(4, 1).words(2 * n)[::2].astype(np.uint64) << np.uint64(32) < np.uint64(2**64 % size)).any()
    assert got == random.Stream(4, 1).indices(n, size).tolist()


@pytest.mark.parametrize("sent", [1 << 19, 1])
def test_bootstrap_of_many_rows(spark, monkeypatch, sent):
    # more than a million draws, whose values are sent to the tasks or shuffled
    monkeypatch.setattr(random, "TASK_ROWS", sent, raising=False)
    n, reps = 400_000, 3
    df = spark.range(n).select("id", (F.col("id") * 7919 % n).cast("double").alias("v")).repartition(5)
    idx = random.Stream(9, 1).indices(reps * n, n).reshape(reps, n)
    got = [r["value"] for r in random.bootstrap(df, "v", "id", reps, "mean", 9, 1).orderBy("rep").collect()]
    assert got == pytest.approx([float(np.mean(i * 7919 % n)) for i in idx], rel=1e-12)
    assert random.resample(df, "v", "id", 1_100_000, 9, 1).agg(F.count("*"), F.max("pos")).first() == (1_100_000, 1_099_999)


def test_matrices(spark):
    a = [4.0, 2.0, 2.0, 3.0]
    low = np.array(matrix.cholesky(a, 2, 1e-12)).reshape(2, 2)
    assert low @ low.T == pytest.approx(np.array(a).reshape(2, 2))
    for bad in ([1.0, 2.0, 2.0, 1.0], [1.0, 1.0, 1.0, 1.0], [1.0, 0.5, 0.4, 1.0], [0.0] * 4):
        with pytest.raises(NumericRefusal):
            matrix.cholesky(bad, 2, 1e-9)
    s, t = random.Stream(1), random.Stream(1)
    z = t.normals(2)
    assert matrix.mvnormal([1.0, 2.0], a, 2, 1e-9, s) == pytest.approx(list(np.array([1, 2]) + low @ z))
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)], "row long, col long, value double")
    got = {(r["row"], r["col"]): r["value"] for r in matrix.multiply(m, matrix.transpose(m)).collect()}
    assert got == {(0, 0): 5.0, (0, 1): 6.0, (1, 0): 6.0, (1, 1): 9.0}


def test_line(spark):
    df = frame(spark, x=pa.array([0.0, 1, 2, 3, 4]), y=pa.array([3.0, 5, 7, 9, 11]))
    fit = matrix.fit_line(df, "x", "y", 5000, 0.05)
    assert fit["slope"] == pytest.approx(2) and fit["intercept"] == pytest.approx(3) and fit["final_mse"] == pytest.approx(0, abs=1e-9)
    with pytest.raises(NumericRefusal):
        matrix.fit_line(df, "x", "y", 5000, 50.0)


def test_comparisons(spark):
    a = frame(spark, p=pa.array(["a", "b", "c", "d"]), h=pa.array(["1", "2", "3", "4"]))
    b = frame(spark, p=pa.array(["a", "b", "d", "e"]), h=pa.array(["1", "9", None, "5"]))
    assert {r["key"]: r["status"] for r in compare.baseline_compare(a, b, "p", "h").collect()} == {"a": "MATCH", "b": "CONTENT_CHANGED", "c": "MISSING", "d": "UNREADABLE", "e": "ADDED"}
    chain = frame(spark, g=pa.array([1, 1, 1]), n=pa.array([0, 1, 2]), h=pa.array(["x", "y", "z"]), p=pa.array([None, "x", "?"]))
    assert compare.chain_check(chain, "n", "h", "p", "g").first()["broken"] == 1
