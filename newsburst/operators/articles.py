"""Changes to the article and link tables: old table and change set in, new table out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsburst.functions.scalars import is_pending


def lookup(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Articles whose ``id`` is listed."""
    return articles.join(ids.select("id").distinct(), "id", "left_semi")


def unknown_ids(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Listed ids that no article has."""
    return ids.select("id").distinct().join(articles.select("id"), "id", "left_anti")


def _patch(table: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` where a change is given for the id; column order is kept.

    Of several changes for one id the largest value wins; ``unknown_ids`` lists ids without an article.
    """
    changes = changes.groupBy("id").agg(F.max(column).alias("_new"))
    patched = F.coalesce("_new", column).cast(table.schema[column].dataType).alias(column)
    return table.join(changes, "id", "left").select(
        *[patched if c == column else c for c in table.columns]
    )


def update_weights(articles: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: id, weight. Any weight is accepted here, zero included."""
    return _patch(articles, changes, "weight")


def soft_delete(articles: DataFrame, ids: DataFrame) -> DataFrame:
    return _patch(articles, ids.select("id").withColumn("is_deleted", F.lit(True)), "is_deleted")


def write_back_vectors(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """``vectors``: id, embedding. Articles without a new vector keep what they had."""
    return _patch(articles, vectors, "embedding")


def still_pending(articles: DataFrame) -> DataFrame:
    return articles.filter(is_pending(F.col("embedding")))


def share(links: DataFrame, changes: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add (article_id, system_id) links that are not there yet.

    Returns the new link table and the changes whose article does not exist.
    """
    keys = ["article_id", "system_id"]
    known = articles.select(F.col("id").alias("article_id"))
    wanted = changes.select(*keys).distinct()
    accepted = wanted.join(known, "article_id", "left_semi")
    rejected = wanted.join(known, "article_id", "left_anti")
    added = accepted.join(links, keys, "left_anti")
    return links.select(*keys).unionByName(added), rejected


def unshare(links: DataFrame, pairs: DataFrame | None = None, article_ids: DataFrame | None = None) -> DataFrame:
    """Remove single pairs, or every link of the given articles."""
    if pairs is not None:
        links = links.join(pairs, ["article_id", "system_id"], "left_anti")
    if article_ids is not None:
        links = links.join(article_ids.select("article_id"), "article_id", "left_anti")
    return links
