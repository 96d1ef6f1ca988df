"""Tables in the shared scratch folder, and row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it back.

    The written table cuts the lineage: when an executor is lost its tasks read
    files again instead of recomputing what came before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables made by ``materialize`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have: ``name`` with underscores behind it as needed."""
    taken = {n.lower() for n in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(doc_id: Column | str, text: Column | str) -> Column:
    """A key of a row by its id and text; rows alike in both share it.  Nulls are told from empty values."""
    i = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    t = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(i, i.isNull(), t, t.isNull())
