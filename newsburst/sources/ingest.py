"""Reading, defaulting and validating article records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsburst.functions.scalars import parse_vector
from newsburst.schemas import ARTICLE_RECORD, ARTICLES, DEFAULT_WEIGHT


def read_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Article records as JSON lines, or with ``multi_line`` as JSON arrays."""
    return spark.read.schema(ARTICLE_RECORD).option("multiLine", multi_line).json(path)


def apply_defaults(records: DataFrame, received_at=None, system_id: int | None = None) -> DataFrame:
    """Records as posted to article rows: weight 1, not shared, not deleted, created on receipt."""
    now = F.current_timestamp() if received_at is None else F.lit(received_at)
    time_type = records.schema["createTime"].dataType
    return records.select(
        "id",
        F.lit(system_id).cast("bigint").alias("system_id"),
        F.coalesce("isShared", F.lit(False)).alias("is_shared"),
        "title",
        "summary",
        F.col("fullText").alias("full_text"),
        F.coalesce("weight", F.lit(DEFAULT_WEIGHT)).cast("decimal(16,4)").alias("weight"),
        F.coalesce("createTime", now.cast(time_type)).alias("create_time"),
        "source",
        F.col("metadata").alias("attr"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.lit(False).alias("is_deleted"),
    )


def field_errors(title="title", weight="weight", embedding=None, dimension: int | None = None):
    """Array of error texts of one row; empty when the row is valid."""
    checks = [
        # Blank: nothing above U+0020, as tabs and line feeds are.
        F.when(~F.coalesce(F.col(title).rlike("[^\\x00-\\x20]"), F.lit(False)), F.lit("title: must not be blank")),
        F.when(F.col(weight).isNull(), F.lit("weight: must not be null")),
        F.when(F.col(weight) <= 0, F.lit("weight: must be greater than 0")),
    ]
    if embedding is not None and dimension is not None:
        checks.append(
            F.when(
                F.col(embedding).isNotNull() & (F.size(embedding) != dimension),
                F.lit(f"embedding: must have {dimension} dimensions"),
            )
        )
    return F.array_compact(F.array(*checks))


def with_errors(rows: DataFrame, dimension: int | None = None) -> DataFrame:
    """Rows with their ``errors``, an empty list when valid."""
    embedding = "embedding" if "embedding" in rows.columns else None
    return rows.withColumn("errors", field_errors(embedding=embedding, dimension=dimension))


def validate(rows: DataFrame, dimension: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Split rows into accepted ones and rejected ones with their ``errors``."""
    judged = with_errors(rows, dimension)
    accepted = judged.filter(F.size("errors") == 0).drop("errors")
    return accepted, judged.filter(F.size("errors") > 0)


# The export holds vectors as text and zone-less times; everything else is as in the table.
_EXPORT_COLUMNS = ", ".join(
    f"{f.name} {'STRING' if f.name == 'embedding' else f.dataType.simpleString()}"
    for f in ARTICLES.fields
)
_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "nullValue": "\\N", 
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def write_export(articles: DataFrame, path: str) -> None:
    """Article table as CSV with vectors as ``[..]`` text."""
    columns = [
        F.col(f.name).cast("string").alias(f.name)
        if f.name == "embedding"
        else F.col(f.name).cast(f.dataType).alias(f.name)
        for f in ARTICLES.fields
    ]
    articles.select(*columns).write.options(**_CSV).csv(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.schema(_EXPORT_COLUMNS).options(**_CSV).csv(path)
    return text.withColumn("embedding", parse_vector(F.col("embedding")))


def write_articles(articles: DataFrame, path: str) -> None:
    """Article table partitioned by day, so a time window reads only its days."""
    articles.withColumn("create_date", F.to_date("create_time")).repartition(
        "create_date", F.pmod(F.xxhash64("id"), F.lit(64))
    ).write.mode("append").partitionBy("create_date").parquet(path)


def read_articles(
    spark: SparkSession, path: str, as_of=None, hours: int | None = None, keep_day: bool = False
) -> DataFrame:
    """Article table; with a window only the days that can hold its rows are listed.

    ``keep_day`` leaves the ``create_date`` column in, by which every later time window of the
    operators prunes days as well.
    """
    articles = spark.read.parquet(path)
    if as_of is not None and hours is not None:
        first = F.to_date(F.lit(str(as_of)).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours)))
        articles = articles.filter(F.col("create_date") >= first)
    return articles if keep_day else articles.drop("create_date")
