"""Session helpers: sane defaults, checkpoint folder, bounded broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows allowed on the build side of a broadcast that is not bounded by
# construction.  Callers count the side first and fall back to a shuffle join.
DEFAULT_BROADCAST_ROWS = 2_000_000

# Groups larger than this are ranked by the range-partitioned path instead of
# one window task (see operators.ranking).
DEFAULT_HOT_GROUP_ROWS = 5_000_000

# Rows that a task sorts or aggregates by group, about; more rows get more tasks.
DEFAULT_TASK_ROWS = 1_000_000

# Pairs of texts that a task compares, and rows that a task of a fit reads over and over, about: their time is in
# the rows, not in the bytes by which partitions are joined up.
DEFAULT_PAIR_ROWS = 20_000
DEFAULT_FIT_ROWS = 50_000


def session_defaults() -> dict[str, str]:
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # tables bucketed by qid also serve joins by (qid, context_id)
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }


def get_session(master: str | None = None, app: str = "rankscope",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = session_defaults()
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the whole cluster
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where none is set.

    On a cluster the folder must be shared storage named by
    ``spark.checkpoint.dir``; only a local-mode session (tests, laptop) gets a
    private temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running rankscope on a cluster")
    local = tempfile.mkdtemp(prefix="rankscope-ckpt-")
    sc.setCheckpointDir(local)
    return local


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    v = spark.conf.get(key, None)
    return int(v) if v not in (None, "") else default


def bounded_broadcast(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only after checking that it holds at most ``max_rows``.

    Beyond the bound the frame is returned unchanged, so the planner falls back
    to a shuffle join.  Use only on small derived tables (the count is an
    action over ``df``).
    """
    spark = df.sparkSession
    limit = max_rows if max_rows is not None else conf_int(
        spark, "rankscope.broadcastRows", DEFAULT_BROADCAST_ROWS)
    n = df.count()
    return F.broadcast(df) if n <= limit else df


def num_partitions(spark: SparkSession) -> int:
    return conf_int(spark, "spark.sql.shuffle.partitions", 200)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of at most ``rows`` rows, dealt by ``keys`` over more partitions than the session's where these would get
    more than ``rankscope.taskRows`` rows each, so that a task's memory does not grow with the input."""
    spark = df.sparkSession
    wanted = -(-rows // conf_int(spark, "rankscope.taskRows", DEFAULT_TASK_ROWS))
    return df.repartition(wanted, *keys) if wanted > num_partitions(spark) else df


def join_where_dealt(spark: SparkSession) -> None:
    """From now on frames that are dealt by some of the keys of a join meet as they lie, as ``session_defaults`` has it."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def dealt_evenly(df: DataFrame, rows: int, task_rows: int, *keys: str) -> DataFrame:
    """``df`` of ``rows`` rows, dealt by ``keys`` into parts of about ``task_rows`` whatever their bytes; few rows as they are."""
    wanted = -(-rows // task_rows)
    return df.repartition(wanted, *keys) if wanted > 1 else df


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
