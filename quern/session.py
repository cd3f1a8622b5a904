"""Where intermediate results are kept: always a folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The folder of the ``workspace`` that is open, if one is.
_PLACE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own (tests); a session on a cluster is refused,
    since a machine-local folder would not be seen by the other machines.
    """
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        own = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    sub = f"/{_PLACE['sub']}" if "sub" in _PLACE else ""
    return f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}{sub}/{label}-{uuid.uuid4().hex}"


def drop_intermediates(spark: SparkSession) -> None:
    """Delete what this application has kept in the shared folder; results that still read it must have been written
    before."""
    drop_dir(spark, f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}")


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """What operators keep in the shared folder while the block runs is deleted at its end; results must have been
    written or collected in it."""
    was = dict(_PLACE)
    _PLACE["sub"] = f"work-{uuid.uuid4().hex}"
    own = f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}/{_PLACE['sub']}"
    try:
        yield
    finally:
        _PLACE.clear()
        _PLACE.update(was)
        drop_dir(spark, own)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back, so a lost executor costs no
    recomputation."""
    spark = df.sparkSession
    at = fresh_dir(spark, label)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop_dir(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
