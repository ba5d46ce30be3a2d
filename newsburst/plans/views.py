"""Article, tenant, config and link tables derived from the driver's test tables.

The SQL form of the same views (for the checks) lives in ``plans/oracle.py``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsburst.functions.scalars import moment
from newsburst.operators.cluster import backfill_events, rank_events
from newsburst.operators.events import event_article_rows, snapshot_rows, with_limits
from newsburst.session import scratch_path, stage
from newsburst.sources.store import SnapshotStore


RAW_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}


# What stands for the encoder's name in stored snapshots.
MODEL = "token-hash-64"

_newest: dict[tuple[str, str], dt.datetime] = {}
_stores: dict[tuple[str, str], str] = {}


class Tables:
    """Lazy views over one test-data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A test table; the declared schema spares the job that would infer it."""
        if name not in self._raw:
            path = f"{self.folder}/{name}.parquet"
            self._raw[name] = self.spark.read.schema(RAW_SCHEMAS[name]).parquet(path)
        return self._raw[name]

    @property
    def systems(self) -> DataFrame:
        return self.raw("region").select(
            (F.col("r_regionkey") + 1).cast("bigint").alias("system_id"),
            F.lower("r_name").alias("system_code"),
            F.col("r_name").alias("system_name"),
            (F.col("r_regionkey") != 4).alias("is_active"),
        )

    @property
    def active_systems(self) -> DataFrame:
        return self.systems.filter("is_active")

    @property
    def configs(self) -> DataFrame:
        rows = [
            (1, 720, 0.65, 3, 80000, 100),
            (2, 720, 0.6, 2, 80000, 5),
            (3, 480, 0.65, 2, 120, 100),
            (4, 24, 0.38, 3, 0, 100),
            (5, 720, 0.6, 3, 80000, 100),
        ]
        return self.spark.createDataFrame(
            rows,
            "system_id BIGINT, default_hours INT, default_eps DOUBLE, default_min_samples INT, "
            "max_articles_limit INT, snapshot_limit INT",
        )

    @property
    def articles(self) -> DataFrame:
        documents = self.raw("documents")
        events = self.raw("events").select("event_id", "ts", "value")
        vectors = self.raw("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        labels = self.raw("labels").select("doc_id", "toxic")
        event_count = self.raw("events").agg(F.count("*")).scalar()
        d = F.col("doc_id")
        first_line = F.split_part("text", F.lit("\n"), F.lit(1))
        second_line = F.split_part("text", F.lit("\n"), F.lit(2))
        return (
            documents.withColumn("event_id", (d * 7919) % event_count)
            .join(events, "event_id")
            .join(vectors, "doc_id", "left")
            .join(labels, "doc_id", "left")
            .select(
                d.alias("id"),
                F.when(d % 11 != 0, d % 5 + 1).alias("system_id"),
                (d % 7 == 0).alias("is_shared"),
                first_line.alias("title"),
                F.when(d % 3 != 0, second_line).alias("summary"),
                F.col("text").alias("full_text"),
                F.when(d % 97 == 0, F.lit(0)).otherwise(F.col("value")).cast("decimal(16,4)").alias("weight"),
                F.col("ts").alias("create_time"),
                "source",
                F.concat(
                    F.lit('{"author":"'),
                    "source",
                    F.lit('","tags":["'),
                    "lang",
                    F.lit('"],"viewCount":'),
                    F.col("n_chars").cast("string"),
                    F.lit("}"),
                ).alias("attr"),
                "embedding",
                F.when(d % 101 != 0, F.coalesce("toxic", F.lit(0)) == 1).alias("is_deleted"),
            )
        )

    @property
    def links(self) -> DataFrame:
        ids = self.raw("documents").select(F.col("doc_id").alias("article_id"))
        a = F.col("article_id")
        fourth = ids.filter(a % 4 == 0).select(a, ((a * 3 + 1) % 5 + 1).alias("system_id"))
        sixth = ids.filter(a % 6 == 0).select(a, ((a + 2) % 5 + 1).alias("system_id"))
        return fourth.union(sixth).distinct()

    @property
    def as_of(self):
        """The newest article time: one value, read once per session and folder."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _newest:
            _newest[key] = self.articles.agg(F.max("create_time")).first()[0]
        return _newest[key]

    @property
    def store(self) -> SnapshotStore:
        """Stored snapshots: all tenants at a first tick, tenants 1 and 2 again ten days later.

        Built once per session and folder, as a refresh job would; readers only read it.
        """
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _stores:
            path = scratch_path(self.spark, "store")
            store = SnapshotStore(self.spark, path)
            minutes = 240 * 60
            newest = self.as_of
            first = newest - dt.timedelta(minutes=minutes)
            events = backfill_events(
                self.articles, self.links, self.active_systems, self.configs, first, 2, minutes
            )
            ranked = stage(rank_events(with_limits(events, self.configs), ["system_id", "tick"], "snapshot_limit"), "ranked")
            tenants = self.active_systems
            for tick, refreshed in (
                (first, tenants),
                (newest, tenants.filter(F.col("system_id").isin(1, 2))),
            ):
                at = moment(tick, self.articles)
                rows = ranked.filter(F.col("tick") == at).join(refreshed.select("system_id"), "system_id", "left_semi")
                store.commit(
                    snapshot_rows(rows, at, MODEL), event_article_rows(rows, self.articles, at), refreshed, at, keep=2
                )
            _stores[key] = path
        return SnapshotStore(self.spark, _stores[key])
