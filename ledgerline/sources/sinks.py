"""Writers: accepted rows and quarantine side by side, exports, and removal of one import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_import(rows: DataFrame, path: str, import_id: str, reason: str = "reason") -> None:
    """Rows without a reason go to {path}/rows, the others to {path}/quarantine, both partitioned by import: writing
    an import again replaces it, so a repeated import stays the same."""
    tagged = rows.withColumn("import_id", F.lit(import_id))
    for name, part in (("rows", tagged.filter(F.col(reason).isNull()).drop(reason)), ("quarantine", tagged.filter(F.col(reason).isNotNull()))):
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("import_id").parquet(f"{path}/{name}")


def read_import(spark: SparkSession, path: str, name: str = "rows") -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


#: Tables that belong to an import.
TABLES = ("rows", "quarantine", "observations", "registry")


def write_unknown(raw: DataFrame, path: str, import_id: str) -> None:
    """K3: rows of a sheet that nothing recognises, whole and as they are, in quarantine with a reason."""
    text = raw.select(F.to_json(F.struct(*(F.col(f"`{n}`") for n in raw.columns))).alias("original_data"), F.lit("UNKNOWN_CONCEPT").alias("reason"), F.lit(import_id).alias("import_id"))
    text.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("import_id").parquet(f"{path}/quarantine")


def observations(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """K4: one observation a filled cell: key, concept, value (where it is a number), text."""
    cells = [F.struct(F.lit(n).alias("concept"), F.col(f"`{n}`").cast("string").alias("text")) for n in columns]
    x = rows.select(F.col(f"`{key}`").alias("entity_id"), F.explode(F.array(*cells)).alias("x")).select("entity_id", "x.*")
    return x.filter("trim(text) <> ''").withColumn("value", F.col("text").try_cast("double"))


def write_observations(rows: DataFrame, path: str, import_id: str, key: str, columns: list[str]) -> None:
    """K4: the observations of the rows that an import has put in, and of no others."""
    inserted = read_import(rows.sparkSession, path).filter(F.col("import_id") == import_id).select(F.col(key).alias("__key")).distinct()
    own = observations(rows.join(inserted, rows[key] == inserted["__key"], "left_semi"), key, columns).withColumn("import_id", F.lit(import_id))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("import_id").parquet(f"{path}/observations")


def write_registry(judged: DataFrame, path: str, import_id: str) -> None:
    """K2: one row for each row that was not taken in, with its status and reason."""
    apart = judged.filter(~F.col("status").isin("IMPORTED", "POTENTIAL_DUPLICATE")).select("row_no", "status", "reason", "original_data", F.lit(import_id).alias("import_id"))
    apart.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("import_id").parquet(f"{path}/registry")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def delete_import(spark: SparkSession, path: str, import_id: str) -> None:
    """K7: drops one import's rows, quarantine, observations and registry, through Hadoop's file system, wherever they are."""
    for name in TABLES:
        _delete(spark, f"{path}/{name}/import_id={import_id}")


def purge(spark: SparkSession, paths: list[str], keep: tuple[str, ...] = ()) -> list[str]:
    """K8: drops all tables under the paths but those named in `keep`; gives back what was dropped."""
    gone = [f"{path}/{name}" for path in paths for name in TABLES if name not in keep]
    for path in gone:
        _delete(spark, path)
    return gone


def export_csv(df: DataFrame, path: str) -> None:
    """K5: CSV for spreadsheets: a byte order mark, a header, quotes doubled, one file for each partition."""
    first = df.columns[0]
    df.withColumnRenamed(first, f"\ufeff{first}").write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=False, encoding="UTF-8")
