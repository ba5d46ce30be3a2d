"""Column expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsburst.schemas import ARTICLE_METADATA, TEXT_SEPARATOR


def moment(value, like: DataFrame, column: str = "create_time") -> Column:
    """``value`` (datetime, string or Column) with the timestamp type of ``like[column]``.

    Goes through text so that a naive datetime means the same wall clock in a
    zone-less column as in a zoned one.
    """
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast(like.schema[column].dataType)


def hours_interval(hours) -> Column:
    hours = hours if isinstance(hours, Column) else F.lit(hours)
    return F.make_dt_interval(F.lit(0), hours.cast("int"))


def age_micros(time: Column, kind: T.DataType) -> Column:
    """Microseconds before 1970, so that newer rows have smaller values.

    A zone-less time is counted field by field: going through a zoned one could reorder
    rows around a change of clocks.
    """
    if isinstance(kind, T.TimestampType):
        return -F.unix_micros(time)
    days = F.date_diff(time.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    minutes = (days * 24 + F.hour(time)) * 60 + F.minute(time)
    seconds = F.extract(F.lit("SECOND"), time)
    return -(minutes * 60000000 + (seconds * 1000000).cast("long"))


def article_text(title="title", summary="summary", full_text="full_text") -> Column:
    sep = F.lit(TEXT_SEPARATOR)
    empty = F.lit("")
    return F.concat(
        F.col(title), sep, F.coalesce(F.col(summary), empty), sep, F.coalesce(F.col(full_text), empty)
    )


def cluster_weight(weight: Column) -> Column:
    """Weight as clustering sees it: both null and zero count as one."""
    one = F.lit(1).cast("decimal(16,4)")
    return F.when(F.coalesce(weight, F.lit(0)) == 0, one).otherwise(weight)


def link_weight(weight: Column) -> Column:
    """Weight as stored with an event's articles: only null becomes one."""
    return F.coalesce(weight, F.lit(1).cast("decimal(16,4)"))


def hot_score(total_weight: Column, article_count: Column) -> Column:
    return F.round(
        total_weight.cast("double") * F.pow(F.log2(F.lit(1) + article_count), F.lit(1.8)), 6
    )


def is_pending(embedding: Column) -> Column:
    """No vector yet, or the one-element placeholder."""
    placeholder = (F.size(embedding) == 1) & (embedding[0] == 0)
    return embedding.isNull() | placeholder


def parse_vector(text: Column) -> Column:
    """``[1,2]``, ``{1,2}`` or a bare number as text to an array of floats."""
    parts = F.split(F.translate(text, "[]{}", ""), ",")
    kept = F.filter(parts, lambda p: F.trim(p) != "")
    return F.transform(kept, lambda p: F.trim(p).cast("float"))


def vector_norm(vector: Column) -> Column:
    squares = F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def l2_normalize(vector: Column) -> Column:
    """Unit-length copy as doubles; a zero vector stays zero."""
    # Bound in a one-element array, the norm is computed once and not for every element.
    bound = F.array(F.struct(vector.alias("v"), vector_norm(vector).alias("norm")))
    scaled = F.transform(
        bound,
        lambda p: F.transform(
            p["v"], lambda x: F.when(p["norm"] == 0, F.lit(0.0)).otherwise(x.cast("double") / p["norm"])
        ),
    )
    return scaled[0]


def cosine_distance(left: Column, right: Column) -> Column:
    """One minus the cosine; one when either vector is zero."""
    dot = F.aggregate(
        F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    norms = vector_norm(left) * vector_norm(right)
    return F.when(norms == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot / norms)


def decode_metadata(text: Column) -> Column:
    return F.from_json(text, ARTICLE_METADATA, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})


def encode_metadata(metadata: Column) -> Column:
    return F.to_json(metadata, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})


def join_first(values: Column, k: int, separator: str) -> Column:
    return F.array_join(F.slice(values, 1, k), separator)
