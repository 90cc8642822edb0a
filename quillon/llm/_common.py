"""What the operators share: tables, materialised intermediates, checks of input columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word and text contracts: space and the controls 09 to 0D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. On one machine without it one of our own will do; on a cluster its absence is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders of tables that this process has written, by session.
_written: dict[int, list[str]] = {}


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation. `clean` removes such tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(id(spark._jsparkSession), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Removes the tables that `materialise` has written in this session. DataFrames that were built on them can't be read afterwards, so results come first."""
    paths = _written.pop(id(spark._jsparkSession), [])
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def crc_fold(id_col: str, k: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(k))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name
