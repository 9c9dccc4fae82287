"""Sessions, table access and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kosha")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", f"file://{os.path.join(tempfile.gettempdir(), 'kosha-shared')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python once a context, so that they need no installation."""
    sc = spark.sparkContext
    if getattr(sc, "_kosha_shipped", False):
        return
    here = Path(__file__).parent
    out = Path(tempfile.mkdtemp(prefix="kosha-")) / "kosha.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path(here.name) / p.relative_to(here))
    sc.addPyFile(str(out))
    sc._kosha_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(df: DataFrame) -> Column:
    """The rows of a table of fixed size (a reference list, the combinations of an experiment) as one literal array of structs."""
    item = lambda r: F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in df.schema])
    return F.array(*map(item, df.collect())).cast(f"array<{df.schema.simpleString()}>")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local session may do without; a cluster is refused then."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'kosha-shared')}"
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/kosha/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Deletes what stored() and built() wrote for this application; results that still read it must have been written before."""
    _BUILT.clear()
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back.

    Unlike a cache the files survive the loss of any executor. They are deleted when the application ends, or before by clean().
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if getattr(spark.sparkContext, "_kosha_own", None) is None:
        own = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
        spark.sparkContext._kosha_own = own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return spark.read.schema(df.schema).parquet(path)


_BUILT: dict[tuple[str, ...], DataFrame] = {}


def built(spark: SparkSession, name: str, d: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of one application read: built and stored at its first use, by its name and the folder of its inputs."""
    key = (spark.sparkContext.applicationId, name, d)
    if key not in _BUILT:
        _BUILT[key] = stored(build())
    return _BUILT[key]
