"""Scans over groups of any size against windows, and what is built on them."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankscope.operators.ranking import range_number
from rankscope.operators.runs import best_epochs
from rankscope.operators.scan import Scan, running


def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", "hot", None, "a", f"k{rng.randrange(40)}"]), k, rng.choice([None, rng.randrange(50)]))
            for k in range(900)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "g string, at long, x long")


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_scans_equal_windows(spark, partitions):
    df = rows(spark)
    scans = {f"{kind}_{inclusive}": Scan(kind, F.col("x"), inclusive) for kind in ("sum", "min", "max")
             for inclusive in (True, False)}
    got = running(df, ["g"], [F.col("at").desc()], scans, partitions)
    want = df
    for name, s in scans.items():
        w = Window.partitionBy("g").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
        value = getattr(F, s.kind)("x").over(w)
        want = want.withColumn(name, F.coalesce(value, F.lit(0)) if s.kind == "sum" else value)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_numbers_and_weights(spark):
    df = rows(spark).withColumn("w", F.col("at") % 4)
    all_rows = sorted((r.at, r.rank) for r in range_number(df, [], [F.col("at").asc()], partitions=13).collect())
    assert all_rows == [(k, k + 1) for k in range(900)]
    sums = {r.at: r.s for r in range_number(df, [], [F.col("at").asc()], "s", 13, weight="w").collect()}
    assert sums[899] == sum(k % 4 for k in range(900)) and sums[5] == 0 + 1 + 2 + 3 + 0 + 1
    assert range_number(df.limit(0), ["g"], [F.col("at").asc()]).count() == 0
    again = range_number(df.withColumn("rank", F.lit(7)), ["g"], [F.col("at").asc()])
    assert again.columns == ["g", "at", "x", "w", "rank"] and again.where("rank = 1").count() == df.select("g").distinct().count()
    with pytest.raises(ValueError):
        running(df, ["g"], [F.col("at")], {"m": Scan("mean", F.col("x"))})


def replay(metrics, patience, lower):
    best, last, out, stop = None, None, [], None
    for e, m in enumerate(metrics, 1):
        improves = best is None or (m is not None and (m < best if lower else m > best))
        if improves:
            last = e
        if m is not None and (best is None or (m < best if lower else m > best)):
            best = m
        out.append((e, improves, e - last))
        if patience and stop is None and e - last >= patience:
            stop = e
    chosen = max(e for e, improves, _ in out if improves and (stop is None or e <= stop))
    return [(e, i, n, stop, stop is None or e <= stop, chosen, e == chosen, stop is not None) for e, i, n in out]


@pytest.mark.parametrize("patience, lower", [(0, False), (3, False), (4, True)])
def test_best_epochs_of_a_hot_run(spark, patience, lower):
    rng = random.Random(9)
    runs = {"hot": [rng.randrange(1000) / 7 for _ in range(700)], "tie": [1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 1.5],
            "null": [None, None, 3.0, None, 1.0, 5.0], "one": [2.0], None: [1.0, 2.0, 0.5, 0.5, 0.5, 0.5, 9.0]}
    data = [(r, e, m) for r, ms in runs.items() for e, m in enumerate(ms, 1)]
    rng.shuffle(data)
    log = spark.createDataFrame(data, "run_id string, epoch long, metric double")
    out = best_epochs(log, patience=patience, lower_is_better=lower)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(run_id" not in plan
    for r, ms in runs.items():
        mine = out.where(F.col("run_id").eqNullSafe(F.lit(r))).orderBy("epoch").collect()
        assert [(x.epoch, x.is_improvement, x.no_improve_epochs, x.stop_epoch, x.kept, x.best_epoch, x.is_best_epoch,
                 x.early_stopped) for x in mine] == replay(ms, patience, lower)
