"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidemark",
                  extra_conf: dict[str, str] | None = None) -> SparkSession:
    """A local session tuned for small scale factors (tests, bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster it must already name shared storage (checkpoints and scratch
    output must survive a lost executor); only a local-mode session (tests,
    bench) without the setting gets a scratch folder of its own.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint folder
        sc = None
    if not current:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster file system)")
        current = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc is not None:
        sc.setCheckpointDir(current)
    return current


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` from compressed columns on the shared folder; lineage ends there.

    A checkpoint would hold the rows uncompressed, several times as large.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tidemark-{name}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes that the rows of one task may come to after an explode; what does not fit in memory spills once.
TASK_BYTES = 1 << 30
#: More reducers than this cost the shuffle more than they save.
MAX_PARTITIONS = 200_000


def input_bytes(df) -> int:
    """Bytes of the files and frames that ``df`` reads, from the planner's statistics of its leaves; unknown sizes count 0."""
    if not hasattr(df, "_jdf"):  # Spark Connect keeps the plan on the server
        return 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 60)  # Spark gives a frame of unknown size the largest long


def fanout_partitions(df, factor: int, task_bytes: int = TASK_BYTES) -> int:
    """Partition count for a shuffle whose rows are exploded ``factor``-fold right after it.

    AQE sizes coalesced partitions by the bytes that cross the shuffle (raw
    text), not by what the tasks make of them. The count follows the input:
    ``factor`` times its bytes at ``task_bytes`` a task, and never fewer than
    ``spark.sql.shuffle.partitions``.
    """
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, base, min(MAX_PARTITIONS, -(-input_bytes(df) * factor // task_bytes)))
