"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of the contracts are separated by these ASCII characters only.
BLANK = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset a folder of
    our own is made, which only a local master (one machine) allows.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='lawloom-')}"
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses, removed when Spark ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage in a way that survives lost executors, and gives later
    steps the same rows even if the plan above is not deterministic.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id falls in fold null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def batches_of(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches handed to Python, as single texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hot_join(many: DataFrame, one: DataFrame, on: list[str], by: str, rows: str, most: int = 2000) -> DataFrame:
    """``spread_join`` where a column ``rows`` of ``one`` tells how many rows of ``many`` its key meets, at least about.

    Only keys that meet more than ``most`` rows are dealt to several tasks, about ``most`` rows each. These keys are
    broadcast (at most one for ``most`` rows of ``many``); all other rows of ``one`` are sent once.
    """
    shares = F.ceil(F.col(rows) / F.lit(most)).cast("int")
    hot = F.broadcast(one.where(F.col(rows) > most).select(*on, shares.alias("shares")))
    dealt = many.join(hot, on, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("shares")).cast("int"), F.lit(0))).drop("shares")
    copies = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1)))
    return dealt.join(copies, [*on, "salt"]).drop("salt")


def spread_join(many: DataFrame, one: DataFrame, on: list[str], by: str, salts: int = 16) -> DataFrame:
    """Inner join on a key that is unique in ``one`` but may be very frequent in ``many``.

    Rows of ``many`` are dealt by the key and a hash of their column ``by``, so a hot key is shared by up
    to ``salts`` tasks; rows of ``one`` are sent once for each.
    """
    copies = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return dealt.join(copies, [*on, "salt"]).drop("salt")
