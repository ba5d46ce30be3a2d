"""Which tenant may see which article.

An article is visible to a tenant that owns it, that it is linked to, or - when it has an
owner and is shared - to every tenant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible_to(articles: DataFrame, links: DataFrame, system_id: int) -> DataFrame:
    """Articles one tenant sees. Own and shared ones are a filter at the scan; only the rest
    meets the tenant's links, in a semi-join that no row fans out of."""
    linked = links.filter(F.col("system_id") == system_id).select(F.col("article_id").alias("id"))
    direct = (F.col("system_id") == system_id) | (F.col("is_shared") & F.col("system_id").isNotNull())
    rest = articles.filter(~F.coalesce(direct, F.lit(False))).join(linked, "id", "left_semi")
    return articles.filter(direct).unionByName(rest.select(*articles.columns))


def shared_pool(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("is_shared") & F.col("system_id").isNotNull())


def exclusive_pairs(articles: DataFrame, links: DataFrame, systems: DataFrame) -> DataFrame:
    """(tenant, article) pairs that come from ownership or a link only.

    Articles of the shared pool are left out, since every tenant sees those anyway. What
    remains is a union of two equi-join paths instead of one join with an OR condition.
    """
    tenants = systems.select("system_id")
    carried = [c for c in articles.columns if c not in ("id", "system_id", "is_shared")]
    pooled = F.coalesce(F.col("is_shared") & F.col("system_id").isNotNull(), F.lit(False))
    private = articles.filter(~pooled)
    own = private.join(tenants, "system_id", "left_semi").select("system_id", "id", *carried)
    linked = (
        links.join(tenants, "system_id", "left_semi")
        .select(F.col("article_id").alias("id"), "system_id")
        .distinct()
        .join(private.withColumnRenamed("system_id", "_owner"), "id")
        .filter(F.col("_owner").isNull() | (F.col("_owner") != F.col("system_id")))
        .select("system_id", "id", *carried)
    )
    return own.unionByName(linked)


def visible_pairs(articles: DataFrame, links: DataFrame, systems: DataFrame) -> DataFrame:
    """(tenant, article) pairs of all given tenants; other article columns are carried along.

    Own, linked and pooled articles are disjoint sets here, so no distinct is needed.
    Pooled articles are repeated per tenant with a generator over the tenant ids.
    """
    carried = [c for c in articles.columns if c not in ("id", "system_id", "is_shared")]
    ids = systems.agg(F.sort_array(F.collect_set("system_id")).alias("ids"))
    pool = shared_pool(articles).select(
        F.explode(ids.scalar()).alias("system_id"), "id", *carried
    )
    return exclusive_pairs(articles, links, systems).unionByName(pool)


def links_of_system(links: DataFrame, system_id: int) -> DataFrame:
    return links.filter(F.col("system_id") == system_id).select("article_id")


def links_of_article(links: DataFrame, article_id: int) -> DataFrame:
    return links.filter(F.col("article_id") == article_id).select("system_id")


def codes_exist(requested: DataFrame, systems: DataFrame) -> DataFrame:
    """``system_code`` -> does an active tenant have it."""
    known = systems.filter("is_active").select("system_code", F.lit(True).alias("_known"))
    return requested.join(known, "system_code", "left").select(
        "system_code", F.coalesce("_known", F.lit(False)).alias("system_exists")
    )


def resolve_codes(requested: DataFrame, systems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requested codes into resolved (code, id) and unknown-or-inactive ones."""
    known = systems.filter("is_active").select("system_code", "system_id")
    resolved = requested.join(known, "system_code")
    rejected = requested.join(known, "system_code", "left_anti").select(
        "system_code", F.lit("tenant does not exist or is inactive").alias("error")
    )
    return resolved, rejected
