"""Session construction and lineage cutting."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        # Small tables: spread work by its cost rather than by its bytes.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
        "spark.driver.host": "127.0.0.1",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quern")
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared folder of ``spark.checkpoint.dir``. Where none is named a session on one machine uses a
    folder of its own until it ends; on a cluster, whose executors could not read that, this raises."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not named:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="quern-checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there, so that a lost executor costs no
    recomputation of what led to them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new place in the checkpoint folder, for tables and streams of one query."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def shared(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast of an object with the code of its class, so that executors need not have the package. For objects of
    bounded size only."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(held: Broadcast) -> object:
    """The object of :func:`shared`, in a task."""
    return cloudpickle.loads(held.value)
