"""Readers with fixed schemas, and the materialised training matrix."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..contract import EVENT, LABELLED

_OWN_FOLDERS: dict[str, str] = {}


def read_labelled(spark: SparkSession, path: str, fmt: str = "csv", limit: int | None = None) -> DataFrame:
    """Labelled transfer rows. The schema is fixed: cards are digit strings, never numbers."""
    reader = spark.read.schema(LABELLED)
    rows = reader.csv(path, header=True, enforceSchema=False) if fmt == "csv" else reader.format(fmt).load(path)
    return rows if limit is None else rows.orderBy("event_time", "transaction_id").limit(limit)


def read_banks(spark: SparkSession, path: str) -> DataFrame:
    """Card prefixes and their banks from a CSV file with a header. An empty registry is an error, as it would name no bank ever."""
    schema = "bin string, code string, name string, cards_mln double"
    rows = spark.read.schema(schema).csv(path, header=True).select(
        F.trim("bin").alias("bin"), F.trim("code").alias("code"), F.trim("name").alias("name"),
        F.coalesce("cards_mln", F.lit(0.0)).alias("cards_mln")).filter(F.col("bin") != "")
    if rows.isEmpty():
        raise ValueError(f"no card prefix in {path}")
    return rows


def wire_stream(spark: SparkSession, **options) -> DataFrame:
    """The raw topic from its start or the query's checkpoint; needs the Kafka package."""
    kafka = spark.readStream.format("kafka").option("startingOffsets", "earliest").options(**options)
    return kafka.load().select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrived"))


def file_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Wire records from a folder of text files, one record a line."""
    return (spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
            .select("value", F.current_timestamp().alias("arrived")))


#: What the panels read of a scored record.
SCORED = ("transaction_id string, event_time timestamp, decision string, predicted_type string, model_version string, ml_score double, "
          "final_score double, rule_hits array<string>, scored_at_job double")


def scored_stream(lines: DataFrame) -> DataFrame:
    """Decision records from the lines (`value`) of the scored topic. A line that is no record is left out."""
    return lines.select(F.from_json("value", SCORED).alias("r")).select("r.*").filter("transaction_id is not null and event_time is not null")


def fingerprint(rows: DataFrame, columns: list[str]) -> str:
    """What a materialised matrix was built from: its columns and its input's content, as a sum of
    row hashes that no order or partitioning changes."""
    content = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((sorted(columns), content[0], str(content[1]))).encode()).hexdigest()[:32]


def materialised(build, source: DataFrame, columns: list[str], folder: str, refuse_other: bool = False) -> DataFrame:
    """`build()`'s rows, read from `folder` when it holds them for this source and these columns,
    else written there. `refuse_other` raises when it holds a matrix built from something else."""
    spark = source.sparkSession
    path = f"{folder}/matrix={fingerprint(source, columns)}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    here = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    if not here(f"{path}/_SUCCESS"):
        if refuse_other and here(folder) and len(fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))):
            raise ValueError(f"matrices in {folder} do not belong to this source and these columns")
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all nodes share, as the session's spark.checkpoint.dir names it. Only a session on one machine may leave it
    unset: then a folder is made there. On a cluster that is refused, as each node would write to a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        named = _OWN_FOLDERS.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _OWN_FOLDERS[spark.sparkContext.applicationId] = named
    return named.rstrip("/")


def stored(rows: DataFrame) -> DataFrame:
    """`rows` written once, as a table in the shared folder, and read from there: for a result that several plans go on from."""
    path = f"{shared_folder(rows.sparkSession)}/stored-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
