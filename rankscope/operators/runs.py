"""Best-epoch selection over many training-run logs (W4), re-aimed at Spark.

For each run the first epoch always improves; later epochs improve when they
are strictly better than the best so far (lower for val_loss, higher
otherwise).  no_improve_epochs counts epochs since the last improvement;
with patience > 0 a run stops at the first epoch that reaches it.  The best
epoch is the last improvement at or before the stop, marked on every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankscope.operators.scan import Scan, running


def best_epochs(log: DataFrame, metric: str = "metric", lower_is_better: bool = False, patience: int = 0,
                run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """``log`` plus is_improvement, no_improve_epochs, stop_epoch, kept, best_epoch, is_best_epoch and early_stopped.

    A run may hold any share of the rows: the running best and the last
    improvement are scans over a range-partitioned sort, the stop and the best
    epoch are aggregates of a row per run.  Epochs are unique within a run; a
    null metric improves only as a run's first.
    """
    m = F.col(metric).cast("double")
    best = Scan("min" if lower_is_better else "max", m, inclusive=False)
    df = running(log, [run], [F.col(epoch)], {"_best": best})
    better = (m < F.col("_best")) if lower_is_better else (m > F.col("_best"))
    df = df.withColumn("is_improvement", F.col("_best").isNull() | F.coalesce(better, F.lit(False)))
    improved = F.when(F.col("is_improvement"), F.col(epoch))
    df = running(df.drop("_best"), [run], [F.col(epoch)], {"_last_imp": Scan("max", improved)})
    # epochs are consecutive integers within a run, so the distance is a count
    df = df.withColumn("no_improve_epochs", (F.col(epoch) - F.col("_last_imp")).cast("int"))
    at_stop = F.struct(F.col(epoch).cast("long").alias("epoch"), F.col("_last_imp").alias("best"))
    stop = F.min(F.when(F.col("no_improve_epochs") >= patience, at_stop)) if patience > 0 else F.lit(None).cast(
        "struct<epoch: long, best: long>")
    runs = (df.groupBy(F.col(run).alias("_run")).agg(stop.alias("_stop"), F.max(improved).alias("_best"))
            .select("_run", F.col("_stop.epoch").alias("stop_epoch"), F.coalesce("_stop.best", "_best").alias("best_epoch")))
    return (df.join(runs, df[run].eqNullSafe(F.col("_run"))).drop("_run", "_last_imp")
            .withColumn("kept", F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
            .withColumn("is_best_epoch", F.col(epoch) == F.col("best_epoch"))
            .withColumn("early_stopped", F.col("stop_epoch").isNotNull()))
