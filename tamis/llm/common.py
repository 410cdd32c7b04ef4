"""Helpers that the corpus operators share: tables, hold-out hashes, shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators between words of the whitespace token class, as a regular expression and as characters.
SPACES_RE = r"[ \t-\r]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(col: str, mod: int) -> Column:
    """crc32 of the column as text, modulo mod; null for null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def held_out(col: str, mod: int, remainder: int) -> Column:
    """Whether a row is kept from training; rows without an id are never held out."""
    return F.coalesce(bucket(col, mod) == remainder, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where none is set in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not at:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "tamis-shared")
        spark.conf.set("spark.checkpoint.dir", at)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one written table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """df, computed once and read back from reliable storage in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder; narrower than a checkpoint where columns compress or are pruned."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def free(names: tuple[str, ...], taken: list[str]) -> list[str]:
    """names, ending in as many underscores as it takes to differ from the taken ones, of any case."""
    end, low = "", {x.lower() for x in taken}
    while any((n + end).lower() in low for n in names):
        end += "_"
    return [n + end for n in names]


class Scratch:
    """A folder of the shared one for tables that are read during one run only."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, new_path(spark, name), 0

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{name}-{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def remove(self) -> None:
        """Deletes the folder; nothing that reads it may be left."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(col, UPPER, LOWER)


def n_tokens(col: Column) -> Column:
    """Number of whitespace tokens; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")
