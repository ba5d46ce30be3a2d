"""Tenant and configuration tables, default-tenant migration, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsburst.schemas import CONFIG_DEFAULTS
from newsburst.session import stage

CONFIG_COLUMNS = list(CONFIG_DEFAULTS)
DEFAULT_CODE = "default"


def with_config_defaults(configs: DataFrame) -> DataFrame:
    """Fill settings that are null or absent."""
    columns = ["system_id"]
    for name, value in CONFIG_DEFAULTS.items():
        given = F.col(name) if name in configs.columns else F.lit(None)
        columns.append(F.coalesce(given, F.lit(value)).alias(name))
    return configs.select(*columns)


def _time(now):
    return F.current_timestamp() if now is None else F.lit(now).cast("timestamp")


def create_tenants(
    systems: DataFrame, requests: DataFrame, now=None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New tenants and their configurations, both with ``create_time`` and ``update_time``; ``now`` is a
    time or a column, by default the current time.

    ``requests``: system_code, system_name, description and any settings. A code that is
    taken, or asked for twice, is an error. Returns (tenants, configs, errors). Ids are
    unique and above all existing ones, not consecutive - no task numbers all rows.
    """
    asked = requests.join(systems.select("system_code", F.lit(True).alias("_taken")), "system_code", "left")
    repeated = requests.groupBy("system_code").count().filter("count > 1").select(
        "system_code", F.lit(True).alias("_repeated")
    )
    judged = asked.join(repeated, "system_code", "left").withColumn(
        "error",
        F.when(F.col("_taken"), "code already exists").when(F.col("_repeated"), "code given twice"),
    )
    errors = judged.filter(F.col("error").isNotNull()).select("system_code", "error").distinct()
    top = systems.agg(F.coalesce(F.max("system_id"), F.lit(0))).scalar()
    created = stage(
        judged.filter(F.col("error").isNull())
        .drop("_taken", "_repeated", "error")
        .withColumn("system_id", (top + 1 + F.monotonically_increasing_id()).cast("long"))
        .withColumn("_now", _time(now)),
        "tenants",
    )
    tenants = created.select(
        "system_id", "system_code", "system_name", "description", F.lit(True).alias("is_active"),
        F.col("_now").alias("create_time"), F.col("_now").alias("update_time"),
    )
    times = created.select("system_id", F.col("_now").alias("create_time"), F.col("_now").alias("update_time"))
    return tenants, with_config_defaults(created).join(times, "system_id"), errors


def merge_configs(configs: DataFrame, changes: DataFrame, now=None) -> DataFrame:
    """Change only the settings a change row gives; null keeps the old value. Where the table has an
    ``update_time``, changed rows get ``now``, by default the current time; ``create_time`` stays."""
    if "update_time" in configs.columns:
        changes = changes.drop("create_time").withColumn("update_time", _time(now))
    settings = [c for c in configs.columns if c != "system_id"]
    given = [c for c in settings if c in changes.columns]
    renamed = changes.select("system_id", *[F.col(c).alias(f"_new_{c}") for c in given])
    merged = [
        F.coalesce(f"_new_{c}", c).cast(configs.schema[c].dataType).alias(c) if c in given else F.col(c)
        for c in settings
    ]
    return configs.join(renamed, "system_id", "left").select("system_id", *merged)


def list_tenants(systems: DataFrame, is_active=None, system_id=None, system_code=None) -> DataFrame:
    if is_active is not None:
        systems = systems.filter(F.col("is_active") == F.lit(is_active))
    if system_id is not None:
        systems = systems.filter(F.col("system_id") == system_id)
    if system_code is not None:
        systems = systems.filter(F.col("system_code") == system_code)
    return systems


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Add rows whose key is not there yet; existing rows win, and of several new rows of one
    key the smallest in the order of the columns."""
    new = rows.join(table.select(key), key, "left_anti")
    one = new.groupBy(key).agg(F.min(F.struct(*table.columns)).alias("_row"))
    return table.unionByName(one.select("_row.*"))


def migrate_to_default(systems: DataFrame, table: DataFrame) -> DataFrame:
    """Give rows without a tenant to the default tenant."""
    found = systems.filter(F.col("system_code") == DEFAULT_CODE).select("system_id").limit(1).collect()
    if not found:
        raise ValueError("there is no default tenant")
    return table.withColumn("system_id", F.coalesce("system_id", F.lit(found[0][0]).cast("long")))


def delete_tenants(gone: DataFrame, systems, configs, articles, links, snapshot, event_articles) -> dict:
    """Remove tenants with everything that hangs on them; their articles lose the owner."""
    gone = gone.select("system_id").distinct()
    marked = gone.withColumn("_gone", F.lit(True))
    without_owner = F.when(F.col("_gone").isNull(), F.col("system_id")).alias("system_id")
    kept = articles.join(marked, "system_id", "left").select(
        *[without_owner if c == "system_id" else c for c in articles.columns]
    )
    rest = {
        name: df.join(gone, "system_id", "left_anti").select(df.columns)
        for name, df in [
            ("systems", systems),
            ("configs", configs),
            ("links", links),
            ("snapshot", snapshot),
            ("event_articles", event_articles),
        ]
    }
    return {**rest, "articles": kept}


def delete_articles(gone: DataFrame, articles, links, event_articles) -> dict:
    ids = gone.select("id").distinct()
    as_link = ids.withColumnRenamed("id", "article_id")
    return {
        "articles": articles.join(ids, "id", "left_anti").select(articles.columns),
        "links": links.join(as_link, "article_id", "left_anti").select(links.columns),
        "event_articles": event_articles.join(as_link, "article_id", "left_anti").select(
            event_articles.columns
        ),
    }


def duplicate_keys(name: str, table: DataFrame, keys: list[str]) -> DataFrame:
    repeated = table.groupBy(*keys).count().filter("count > 1")
    return repeated.agg(F.count("*").alias("violations")).select(
        F.lit(f"{name}: repeated {', '.join(keys)}").alias("rule"), "violations"
    )


def dangling(name: str, table: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    orphans = table.filter(F.col(column).isNotNull()).join(
        parents.select(F.col(key).alias(column)), column, "left_anti"
    )
    return orphans.agg(F.count("*").alias("violations")).select(
        F.lit(f"{name}: {column} without parent").alias("rule"), "violations"
    )


def audit(systems, configs, articles, links) -> DataFrame:
    """Number of violations per integrity rule."""
    checks = [
        duplicate_keys("systems", systems, ["system_code"]),
        duplicate_keys("systems", systems, ["system_id"]),
        duplicate_keys("configs", configs, ["system_id"]),
        duplicate_keys("articles", articles, ["id"]),
        duplicate_keys("links", links, ["article_id", "system_id"]),
        dangling("configs", configs, "system_id", systems, "system_id"),
        dangling("articles", articles, "system_id", systems, "system_id"),
        dangling("links", links, "article_id", articles, "id"),
        dangling("links", links, "system_id", systems, "system_id"),
    ]
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result
