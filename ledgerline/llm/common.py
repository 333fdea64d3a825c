"""What the operators of this package share: table reading, written intermediate tables, small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call white space: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master may do without it."""
    if conf := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/ledgerline-shared"


#: Paths of the tables that written() made and nobody has removed yet.
_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: cuts the lineage, survives lost executors.

    What comes back has one fixed set of rows, whatever is computed again later. The files stay until forget() or
    remove() is told that no result needs them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table's folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def mark() -> int:
    """A point of time for forget()."""
    return len(_made)


def forget(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes the tables written between two marks; call it when the results that read them have been written."""
    gone = _made[since:until]
    del _made[since:until]
    for path in gone:
        remove(spark, path)


def text_of(docs: DataFrame, text_col: str = "text") -> Column:
    """The text column with nulls as empty texts."""
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
