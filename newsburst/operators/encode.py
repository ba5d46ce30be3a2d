"""Article text to unit vectors: token hashing in SQL, or any batch encoder in Python workers."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsburst.functions.scalars import article_text, l2_normalize
from newsburst.operators import filters
from newsburst.operators.visibility import visible_to
from newsburst.schemas import (
    ENCODER_BATCH_ROWS,
    ENCODER_REQUEST_ROWS,
    LONG,
    table,
)
from newsburst.session import spread, stage

# How text is cut into tokens, the same in SQL and in Python.
TOKEN_BREAK = "[ \t\r\n。]+"
HASH_DIMENSION = 64

VECTORS = table(id=LONG, embedding=T.ArrayType(T.FloatType()))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, TOKEN_BREAK), lambda t: t != "")


def token_rows(docs: DataFrame) -> DataFrame:
    """(id, token) for (id, text); a document without tokens keeps one null row."""
    docs = spread(docs.select("id", "text"))
    return docs.select("id", F.explode_outer(tokens(F.col("text"))).alias("token"))


def remove_stopwords(token_table: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Drop listed words. Null tokens stay, so no document disappears."""
    return token_table.join(stopwords.select(F.col("word").alias("token")), "token", "left_anti").select(
        "id", "token"
    )


def hash_encode(token_table: DataFrame, dimension: int = HASH_DIMENSION) -> DataFrame:
    """Token counts hashed into ``dimension`` buckets, log-damped and scaled to unit length.

    Counts are combined before the shuffle, so a document sends at most ``dimension`` rows.
    """
    bucket = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long") % dimension
    counts = token_table.groupBy("id", bucket.cast("int").alias("bucket")).agg(
        F.log1p(F.count("token").cast("double")).alias("value")
    )
    entries = F.map_from_entries(
        F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "value")))
    )
    raw = counts.groupBy("id").agg(entries.alias("m"))
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(dimension - 1)),
        lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)),
    )
    return raw.select("id", slots.alias("v")).select("id", l2_normalize(F.col("v")).alias("embedding"))


class TokenHashEncoder:
    """The same encoding as ``hash_encode`` for callers that want a batch encoder."""

    def __init__(self, dimension: int = HASH_DIMENSION):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> list[list[float]]:
        vectors = []
        for text in texts:
            counts = [0] * self.dimension
            for token in re.split(TOKEN_BREAK, text):
                if token:
                    digest = hashlib.md5(token.encode("utf-8")).hexdigest()
                    counts[int(digest[:8], 16) % self.dimension] += 1
            vectors.append([math.log1p(c) for c in counts])
        return vectors


def pending_texts(
    articles: DataFrame, as_of, links: DataFrame | None = None, system_id: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """(id, text) still to be encoded: of all articles, or of those one tenant sees.

    By default all of them; ``rows`` caps one run, newest first (``EMBED_BATCH_ROWS`` in the
    schemas is the usual batch). The capped ids are picked before any text is moved.
    """
    todo = filters.pending_embedding(articles, as_of)
    if system_id is not None:
        todo = visible_to(filters.not_deleted(todo), links, system_id)
    if rows is not None:
        picked = filters.embed_batch(todo.select("id", "create_time"), rows).select("id")
        todo = todo.join(picked, "id", "left_semi")
    return todo.select("id", "create_time", article_text().alias("text"))


def encode_batches(docs: DataFrame, encoder_factory, batch_rows: int = ENCODER_BATCH_ROWS) -> DataFrame:
    """Run a batch encoder over (id, text) and scale its vectors to unit length.

    ``encoder_factory`` is called once per Python worker task and returns a function from a
    list of texts to a list of vectors.
    """

    def encode(frames):
        encoder = encoder_factory()
        for frame in frames:
            for start in range(0, len(frame), batch_rows):
                part = frame.iloc[start : start + batch_rows]
                vectors = encoder(part["text"].tolist())
                if len(vectors) != len(part):
                    raise ValueError(f"encoder gave {len(vectors)} vectors for {len(part)} texts")
                matrix = np.asarray(vectors, dtype=float).reshape(len(part), -1)
                norms = np.linalg.norm(matrix, axis=1, keepdims=True)
                scaled = matrix / np.where(norms == 0, 1, norms)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": list(scaled)})

    return spread(docs.select("id", "text")).mapInPandas(encode, VECTORS)


def encoder_requests(docs: DataFrame, model: str | None = None, rows: int = ENCODER_REQUEST_ROWS) -> DataFrame:
    """Request bodies of up to ``rows`` texts: (batch, ids, body).

    Rows are numbered inside their partition, so no task sees all of them; a capped, sorted
    input is one partition and is numbered in its order.
    """
    place = F.monotonically_increasing_id()
    numbered = docs.select("id", "text", place.alias("place")).withColumns(
        {
            "partition": F.shiftright("place", 33),
            "slot": F.floor(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(rows)),
        }
    )
    grouped = numbered.groupBy("partition", "slot").agg(
        F.array_sort(F.collect_list(F.struct("place", "id", "text"))).alias("items")
    )
    texts = F.transform("items", lambda i: i["text"]).alias("texts")
    # A null model is left out of the JSON text.
    body = F.to_json(F.struct(texts, F.lit(model).cast("string").alias("model")))
    return grouped.select(
        F.concat_ws("-", "partition", "slot").alias("batch"),
        F.transform("items", lambda i: i["id"]).alias("ids"),
        body.alias("body"),
    )


# The response shapes an encoder service may answer with. The first bracket, or
# the first two, tell which one to read, so a response is parsed once.
RESPONSE_SHAPES = {
    "object": "STRUCT<embeddings: ARRAY<ARRAY<FLOAT>>, data: ARRAY<STRUCT<embedding: ARRAY<FLOAT>>>>",
    "lists": "ARRAY<ARRAY<FLOAT>>",
    "objects": "ARRAY<STRUCT<embedding: ARRAY<FLOAT>>>",
}


def decode_response(response: Column) -> Column:
    """Response text to an array of vectors; null when it has none of the known shapes."""
    read = {name: F.from_json(response, shape) for name, shape in RESPONSE_SHAPES.items()}
    named = F.transform(
        F.array(read["object"]),
        lambda r: F.coalesce(r["embeddings"], F.transform(r["data"], lambda d: d["embedding"])),
    )[0]
    return (
        F.when(response.rlike(r"^\s*\{"), named)
        .when(response.rlike(r"^\s*\[\s*\["), read["lists"])
        .when(response.rlike(r"^\s*\["), F.transform(read["objects"], lambda d: d["embedding"]))
    )


def decode_responses(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch, ids, response) to vectors by id, and to batches that failed.

    A batch fails as a whole when its shape is unknown or the counts differ.
    """
    decoded = answers.withColumn("vectors", decode_response(F.col("response")))
    complete = F.forall("vectors", lambda v: v.isNotNull())
    good = F.coalesce((F.size("vectors") == F.size("ids")) & complete, F.lit(False))
    vectors = (
        decoded.filter(good)
        .select(F.explode(F.arrays_zip("ids", "vectors")).alias("pair"))
        .select(F.col("pair.ids").alias("id"), F.col("pair.vectors").alias("embedding"))
    )
    error = F.when(F.col("vectors").isNull() | ~complete, "unknown response shape").otherwise(
        "vector count differs from text count"
    )
    return vectors, decoded.filter(~good).select("batch", "ids", error.alias("error"))


def encode_texts(docs: DataFrame, encoder_factory=None) -> DataFrame:
    """(id, embedding) of (id, text): by token hashing in SQL, or by a caller's batch encoder."""
    if encoder_factory is not None:
        return encode_batches(docs, encoder_factory)
    return hash_encode(token_rows(docs)).withColumn("embedding", F.col("embedding").cast("array<float>"))


def embed_pending(articles, as_of, encoder_factory=None, links=None, system_id=None,
                  rows: int | None = None) -> DataFrame:
    """Vectors of the pending articles: (id, embedding), to be joined back in bulk."""
    return encode_texts(pending_texts(articles, as_of, links, system_id, rows), encoder_factory)


def embed_through_requests(
    docs: DataFrame, answer_factory, model: str | None = None, rows: int = ENCODER_REQUEST_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Encode (id, text) through request bodies: (id, embedding), and the failed batches.

    ``answer_factory`` is called once per task and returns a function from a request body to the
    text of its response; what a service does per request stays with the caller. Vectors
    are kept as the service gave them; a batch whose count or shape is wrong fails as a whole and is
    reported with its ids. Answers are written once, so no request is sent again for the second output.
    """

    # Kept for the task: a request is a group of its own, so a worker holds one body at a time.
    started = []

    def ask(frame):
        if not started:
            started.append(answer_factory())
        return pd.DataFrame(
            {"batch": frame["batch"], "ids": frame["ids"], "response": [started[0](b) for b in frame["body"]]}
        )

    requests = encoder_requests(docs, model, rows).groupBy("batch")
    answered = stage(requests.applyInPandas(ask, "batch STRING, ids ARRAY<BIGINT>, response STRING"), "answers")
    return decode_responses(answered)
