"""Session helpers: lineage cuts in the shared folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows a side may have before it is no longer broadcast.
BROADCAST_ROW_LIMIT = 200_000


class ContractError(ValueError):
    """A table broke a stated contract (duplicate key, wrong values, leakage)."""


def local_session(cores: str = "8", app: str = "lumbre") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="lumbre-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    else:
        raise ContractError("set spark.checkpoint.dir to a shared folder on the cluster")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back from there.

    Used where two branches of a plan must see one and the same table even when executors are
    lost in between, and to cut lineage between the levels of a bounded loop.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def has_at_most(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has no more than ``limit`` rows; each task sends its count only."""
    return df.count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only when the row count is proven small; else leave the join to Spark."""
    return F.broadcast(df) if has_at_most(df, limit) else df


def assert_empty(violations: DataFrame, what: str) -> None:
    """Raise with a few examples when a violations table has rows."""
    sample = violations.limit(5).collect()
    if sample:
        raise ContractError(f"{what}: {[row.asDict() for row in sample]}")
