"""Structured Streaming jobs: continuous ingest, periodic encoding, periodic refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsburst.functions.scalars import article_text, is_pending, moment
from newsburst.operators.encode import encode_texts
from newsburst.operators.events import build_snapshot
from newsburst.operators.shared import GraphStore
from newsburst.schemas import ARTICLE_RECORD, DEFAULT_MODEL
from newsburst.session import file_system
from newsburst.sources.ingest import apply_defaults, with_errors
from newsburst.sources.store import SnapshotStore

EMBED_EVERY = "8 minutes"
REFRESH_EVERY = "12 minutes"


def _start(writer, every: str | None):
    """``every`` is the trigger interval; None works off what is there and stops."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def unseen(rows: DataFrame, path: str, number: int) -> DataFrame:
    """One row of each id that no micro-batch before ``number`` stored in ``path``, and all rows without an id.

    Of the stored table only ids between the smallest and the largest new one are read: its files are sorted by id,
    so their minima and maxima rule most of them out where ids grow with time, and the stored ids are the
    left side of a semi-join, where Spark can put a Bloom filter of the new ones.
    """
    spark = rows.sparkSession
    keyed = rows.filter("id IS NOT NULL").dropDuplicates(["id"])
    files, place = file_system(spark, path)
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    if low is not None and files.exists(place):
        stored = spark.read.schema("id long, batch long").parquet(path)
        stored = stored.filter((F.col("batch") < number) & F.col("id").between(low, high)).select("id")
        keyed = keyed.join(stored.join(keyed.select("id"), "id", "left_semi"), "id", "left_anti")
    return keyed.select(rows.columns).unionByName(rows.filter("id IS NULL"))


def ingest_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str,
    system_id: int | None = None, every: str | None = None, rejected: str | None = None,
):
    """JSON article files to an article table, invalid records with their errors to ``rejected``
    (by default ``target`` with ``_rejected`` behind it).

    An old article that comes late is stored like any other. An id that comes again, however late, is
    dropped, valid and invalid records apart: each micro-batch is compared with the ids stored before it, so
    there is no state to keep and none to expire. Records without an id, malformed lines among them, are
    all kept. Each micro-batch is written under its own number, so one that runs again replaces its
    earlier attempt and is not compared with it.
    """
    records = spark.readStream.schema(ARTICLE_RECORD).json(source)
    judged = with_errors(apply_defaults(records, system_id=system_id))
    rejected = rejected or f"{target.rstrip('/')}_rejected"

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        valid = F.size("errors") == 0
        try:
            for path, rows in ((target, batch.filter(valid).drop("errors")), (rejected, batch.filter(~valid))):
                new = unseen(rows, path, number).sortWithinPartitions("id")
                new.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    writer = judged.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return _start(writer, every).start()


def embed_stream(
    articles_stream: DataFrame, target: str, checkpoint: str, encoder_factory=None,
    every: str | None = EMBED_EVERY,
):
    """Encode each micro-batch of new articles that still lacks vectors, and append the
    vectors to their own table; text is never rewritten.

    A batch is written under its own number, so a batch that runs again after a failure
    replaces its earlier attempt.
    """

    def encode(batch: DataFrame, number: int) -> None:
        todo = batch.filter(is_pending(F.col("embedding"))).select("id", article_text().alias("text"))
        encode_texts(todo, encoder_factory).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = articles_stream.writeStream.foreachBatch(encode).option("checkpointLocation", checkpoint)
    return _start(writer, every).start()


def due_tenants(systems: DataFrame, schedule: DataFrame, last_run: DataFrame, now) -> DataFrame:
    """Active tenants whose last refresh is at least their own interval ago, or missing.

    ``schedule``: system_id, interval_minutes; ``last_run``: system_id, snapshot_time.
    """
    waited = now - F.make_dt_interval(F.lit(0), F.lit(0), F.col("interval_minutes"))
    return (
        systems.filter("is_active")
        .join(schedule, "system_id")
        .join(last_run, "system_id", "left")
        .filter(F.col("snapshot_time").isNull() | (F.col("snapshot_time") <= waited))
        .select("system_id")
    )


def interval_minutes(cron) -> object:
    """Minutes of an every-n-minutes schedule text (``*/n * * * *``); null for any other."""
    return F.nullif(F.regexp_extract(cron, r"^\*/(\d+) ", 1), F.lit("")).cast("int")


def refresh_stream(
    ticks: DataFrame, store: SnapshotStore, checkpoint: str,
    load: Callable[[], tuple[DataFrame, DataFrame, DataFrame, DataFrame]],
    every: str | None = REFRESH_EVERY, keep: int = 1, model_name: str = DEFAULT_MODEL,
    graph: GraphStore | None = None, **grid,
):
    """Refresh, on every tick, the snapshots of the tenants that are due.

    With a ``graph`` the neighbours found stay from tick to tick: a tick compares new articles with the
    window and the slice of time that its end cuts, and takes the rest as it stands. Then all active tenants
    are clustered, so that those that are not due keep their part, and the due ones are stored.

    ``ticks`` is a stream with an ``as_of`` column (a rate source, or the ingest table);
    ``load`` returns the current articles, links, systems and configs. A tenant is due when its
    ``clustering_cron`` interval has passed since its last snapshot; one without an interval always is.
    """

    def refresh(batch: DataFrame, number: int) -> None:
        as_of = batch.agg(F.max("as_of")).first()[0]
        if as_of is None:
            return
        articles, links, systems, configs = load()
        moment_ = moment(as_of, articles)
        cron = F.col("clustering_cron") if "clustering_cron" in configs.columns else F.lit(None).cast("string")
        schedule = configs.select("system_id", F.coalesce(interval_minutes(cron), F.lit(0)).alias("interval_minutes"))
        last = store.heads().groupBy("system_id").agg(F.max("snapshot_time").alias("snapshot_time"))
        due = due_tenants(systems, schedule, last, moment_.cast("timestamp"))
        if graph is None:
            found = build_snapshot(articles, links, due, configs, as_of, moment_, model_name, **grid)
        else:
            active = systems.filter("is_active")
            found = build_snapshot(
                articles, links, active, configs, as_of, moment_, model_name, due=due, store=graph, **grid
            )
        store.commit(*found, due, moment_, keep=keep)

    writer = ticks.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return _start(writer, every).start()
