"""What several operators of this folder share: work folders, text sizes, hash keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One white-space character as the contracts define it.
SPACE = r"[\x20\x09-\x0D]"
#: The same six characters for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Spark's setting by which shuffle files go when the query that made them ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without that setting, which then gets a temporary one."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="loomwork-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. Its files stay until purge() or delete(), as results may read them lazily."""
    return f"{shared_folder(spark)}/loomwork/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df below the shared folder and reads it back: this cuts the lineage and survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a work folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def purge(spark: SparkSession) -> None:
    """Removes all work folders. Call it once the results that were wanted are written."""
    delete(spark, f"{shared_folder(spark)}/loomwork")


def word_count(text: Column) -> Column:
    """Number of runs of other than white space; null counts 0."""
    inner = F.regexp_replace(text, f"^{SPACE}+", "")
    # A trailing separator leaves one empty piece, an empty text is one empty piece.
    pieces = F.split(inner, f"{SPACE}+")
    return F.coalesce(F.size(pieces) - F.when(F.element_at(pieces, -1) == "", 1).otherwise(0), F.lit(0)).cast("long")


def row_key(*cols: str | Column) -> list[Column]:
    """Two 64-bit hashes that tell rows apart even where ids repeat or are null."""
    return [F.xxhash64(F.lit(1), *cols).alias("_k1"), F.xxhash64(F.lit(2), *cols).alias("_k2")]


def least_hash(share: float) -> int:
    """The bound below which a share of all 64-bit hashes lies; however small the share, some do."""
    return max(-(1 << 63) + 1, int(min(1.0, share) * (1 << 64)) - (1 << 63)) if share < 1 else (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inner_names(docs: DataFrame, *roles: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but roles under names of their own, and the columns that give the old names back."""
    names = {c: c if c in roles else f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]
