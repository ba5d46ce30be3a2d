"""Toxicity by a classifier chain: linear models for one category after another, each given the
words and word beginnings of a text and the probabilities of the categories before it.

Training uses a bounded sample of labelled documents, ``train_rows`` of them, taken by the hash
of their ids: the only bound here. Within it a later model is trained with out-of-fold
probabilities of the earlier ones (folds by hash of the id), so it sees them as imprecise as they
will be. Each model picks its features by chi-square and is a logistic regression on the logarithms of their
counts and of the text's length.

The models are small (``features`` words a category) and go to the tasks; all documents are
scored in place, whole, with no shuffle.

Defined results: null and empty texts get the models' intercepts. A category without both
outcomes in the sample has its smoothed share as a constant probability; with no labels at all that is 0.5,
and nothing is above it. Several label rows of a document count as one with the larger values.
Rows are scored one by one, repeated ones alike; an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import chain as chain_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsburst.llm.common import slices, texts
from newsburst.llm.decontam import words_of
from newsburst.session import stage

SLICE_BYTES = 8 << 20
#: Labelled documents that training takes at most.
TRAIN_ROWS = 6000


#: Lengths of the word beginnings that are features besides whole words.
PREFIXES = (4, 5, 6, 7)
MEMO_WORDS = 300_000


def features_of(word: bytes) -> list[bytes]:
    """The word itself, and its beginnings in characters."""
    text = word.decode(errors="replace")
    return [b"=" + word[:64], *(b"^" + text[:n].encode() for n in PREFIXES if len(text) >= n)]


def scaled(counts: np.ndarray) -> np.ndarray:
    return np.log2(1 + np.minimum(counts, 15)) / 4


@dataclass
class Entries:
    """Sparse rows: feature number, row and value of each entry, and a length per row."""

    features: np.ndarray
    rows: np.ndarray
    values: np.ndarray
    lengths: np.ndarray

    def part(self, chosen: np.ndarray) -> Entries:
        number = np.cumsum(chosen) - 1
        held = chosen[self.rows]
        return Entries(self.features[held], number[self.rows[held]], self.values[held], self.lengths[chosen])

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=weights[self.features] * self.values, minlength=len(self.lengths))


@dataclass
class Sample:
    vocabulary: list[bytes]
    entries: Entries
    folds: np.ndarray
    labels: np.ndarray  # documents x categories


def length_of(n_words: np.ndarray) -> np.ndarray:
    return np.log2(1 + n_words) / 8


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Linear:
    """Logistic regression on feature values, text length and earlier probabilities."""

    features: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    dense: np.ndarray = field(default_factory=lambda: np.zeros(1))  # of the length, then of earlier categories
    bias: float = 0.0

    def scores(self, entries: Entries, before: np.ndarray, total: int) -> np.ndarray:
        spread = np.zeros(total)
        spread[self.features] = self.weights
        given = np.column_stack([entries.lengths, before])[:, : len(self.dense)]
        return logistic(entries.sums(spread) + given @ self.dense + self.bias)


def _chi_square(entries: Entries, y: np.ndarray, total: int) -> np.ndarray:
    n, positive = len(y), y.sum()
    df = np.bincount(entries.features, minlength=total).astype(float)
    with_label = np.bincount(entries.features, weights=y[entries.rows], minlength=total)
    expected = df * positive / n
    score = (with_label - expected) ** 2 / np.maximum(expected * (1 - positive / n) * (1 - df / n), 1e-9)
    score[(df < 5) | (df > 0.9 * n)] = 0
    return score


def fit(
    entries: Entries, y: np.ndarray, before: np.ndarray, total: int, n_features: int, steps: int = 200, ridge: float = 1e-3
) -> Linear:
    """Accelerated gradient steps on the log loss, their size from the curvature's bound: the
    same result every time."""
    n = len(y)
    if not n or y.min() == y.max():
        share = (y.sum() + 1) / (n + 2)
        return Linear(bias=float(np.log(share / (1 - share))))
    score = _chi_square(entries, y, total)
    best = np.argsort(-score, kind="stable")[:n_features]
    best = np.sort(best[score[best] > 3.84])
    place = np.full(total, -1)
    place[best] = np.arange(len(best))
    held = place[entries.features] >= 0
    x = Entries(place[entries.features[held]], entries.rows[held], entries.values[held], entries.lengths)
    dense = np.column_stack([entries.lengths, before, np.ones(n)])
    # A rare outcome weighs as much as the common one.
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n
    norms = np.bincount(x.rows, weights=x.values**2, minlength=n) + (dense**2).sum(axis=1)
    rate = 1 / (0.25 * float(weight @ norms) + ridge)
    w, d = np.zeros(len(best)), np.zeros(dense.shape[1])
    w_old, d_old = w, d
    for step in range(steps):
        push = step / (step + 3)
        wy, dy = w + push * (w - w_old), d + push * (d - d_old)
        error = (logistic(x.sums(wy) + dense @ dy) - y) * weight
        slope = np.bincount(x.features, weights=error[x.rows] * x.values, minlength=len(w)) + ridge * wy
        w_old, d_old = w, d
        w, d = wy - rate * slope, dy - rate * (dense.T @ error + ridge * dy)
    return Linear(best, w, d[:-1], float(d[-1]))


def fit_chain(sample: Sample, n_folds: int, n_features: int) -> list[Linear]:
    """One model per category, later ones trained with out-of-fold probabilities of earlier ones."""
    total, entries = len(sample.vocabulary), sample.entries
    before = np.zeros((len(sample.folds), 0))
    chain = []
    for j in range(sample.labels.shape[1]):
        y = sample.labels[:, j].astype(float)
        chain.append(fit(entries, y, before, total, n_features))
        unseen = np.zeros(len(y))
        for f in range(n_folds):
            out = sample.folds == f
            model = fit(entries.part(~out), y[~out], before[~out], total, n_features)
            unseen[out] = model.scores(entries.part(out), before[out], total)
        before = np.column_stack([before, unseen])
    return chain


def gather(
    docs: DataFrame, labels: DataFrame, categories: list[str], train_rows: int, n_folds: int, least_rows: int = 6, candidates: int = 4000
) -> Sample:
    """The bounded sample: words made on the executors, ``train_rows`` rows at most here."""
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        *(F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c) for c in categories)
    )
    order = F.xxhash64("doc_id")
    chosen = marks.orderBy(order, "doc_id").limit(train_rows).withColumn("fold", F.pmod(order, F.lit(n_folds)))
    # At most train_rows short rows: a broadcast of fixed size.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    names = ["doc_id", "fold", *categories]

    def to_features(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            split = [words_of(t) for t in texts(batch.column("text"))]
            counted = [Counter(f for w in words for f in features_of(w)) for words in split]
            columns = [batch.column(c).cast(pa.int64()) for c in names]
            columns.append(pa.array([len(w) for w in split], pa.int64()))
            columns.append(pa.array([list(c.items()) for c in counted], pa.map_(pa.binary(), pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "counts"])

    schema = ", ".join(f"{c} long" for c in [*names, "n_words"]) + ", counts map<binary,int>"
    worded = stage(joined.mapInArrow(to_features, schema), "training")
    chosen_features = _candidates(worded, categories, n_folds, least_rows, candidates)
    vocabulary = [bytes(r.feature) for r in chosen_features.select("feature").collect()]
    numbered = docs.sparkSession.createDataFrame(
        [(bytearray(f), i) for i, f in enumerate(vocabulary)], "feature binary, number int"
    )
    # Numbers and counts of the bounded sample, document by document.
    pairs = worded.select("doc_id", F.explode("counts").alias("feature", "n")).join(F.broadcast(numbered), "feature")
    held = pairs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("number", "n"))).alias("held"))
    found = (
        worded.drop("counts").join(held, "doc_id", "left").orderBy("doc_id")
        .select(*names, "n_words", F.col("held.number").alias("features"), F.col("held.n").alias("times"))
    ).toArrow()
    column = {c: found.column(c).combine_chunks() for c in found.column_names}
    sizes = pa.compute.list_value_length(column["features"]).fill_null(0).to_numpy(zero_copy_only=False)
    entries = Entries(
        column["features"].flatten().to_numpy(zero_copy_only=False).astype(np.int64),
        np.repeat(np.arange(len(sizes)), sizes).astype(np.int64),
        scaled(column["times"].flatten().to_numpy(zero_copy_only=False).astype(float)),
        length_of(column["n_words"].to_numpy(zero_copy_only=False).astype(float)),
    )
    labels_ = np.column_stack([column[c].to_numpy(zero_copy_only=False) for c in categories]).astype(np.int64)
    return Sample(vocabulary, entries, column["fold"].to_numpy(zero_copy_only=False).astype(np.int64), labels_)


def _candidates(worded: DataFrame, categories: list[str], n_folds: int, least_rows: int, most: int) -> DataFrame:
    """The features of at least ``least_rows`` sample documents that tell most about some category, by
    chi-square over all of the sample or without one fold: as many as ``most``. Each model picks its
    own from these."""
    folds = [F.lit(True), *(F.col("fold") != f for f in range(n_folds))]
    totals = worded.agg(
        *(F.count_if(part).alias(f"n{k}") for k, part in enumerate(folds)),
        *(F.count_if(part & (F.col(c) == 1)).alias(f"p{k}_{j}") for k, part in enumerate(folds) for j, c in enumerate(categories)),
    ).first()
    exploded = worded.select("fold", *categories, F.explode("counts").alias("feature", "times"))
    counts = exploded.groupBy("feature").agg(
        *(F.count_if(part).alias(f"n{k}") for k, part in enumerate(folds)),
        *(F.count_if(part & (F.col(c) == 1)).alias(f"p{k}_{j}") for k, part in enumerate(folds) for j, c in enumerate(categories)),
    )
    scores = [F.lit(0.0)]
    for k in range(len(folds)):
        for j in range(len(categories)):
            n, positive = totals[f"n{k}"], totals[f"p{k}_{j}"]
            if 0 < positive < n:
                share = positive / n
                expected = F.col(f"n{k}") * share
                noise = expected * (1 - share) * (1 - F.col(f"n{k}") / n)
                scores.append(F.when(noise > 0, (F.col(f"p{k}_{j}") - expected) ** 2 / noise).otherwise(0.0))
    best = F.greatest(*scores, F.lit(0.0))
    told = counts.filter(F.col("n0") >= least_rows).select("feature", best.alias("score")).filter("score > 3.84")
    return told.orderBy(F.col("score").desc(), "feature").limit(most)


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: list[str],
    train_rows: int = TRAIN_ROWS,
    n_folds: int = 3,
    n_features: int = 1000,
) -> tuple[dict[bytes, int], list[Linear]]:
    """The chain for ``categories`` (0/1 columns of ``labels``, by doc_id) and its features."""
    sample = gather(docs, labels, categories, train_rows, n_folds)
    chain = fit_chain(sample, n_folds, n_features)
    used = sorted({int(f) for model in chain for f in model.features})
    number = {f: i for i, f in enumerate(used)}
    for model in chain:
        model.features = np.array([number[int(f)] for f in model.features], np.int64)
    return {sample.vocabulary[f]: i for f, i in number.items()}, chain


def score(docs: DataFrame, vocabulary: dict[bytes, int], chain: list[Linear], categories: list[str]) -> DataFrame:
    """(doc_id, p_<category> ...) for every row of ``docs`` (doc_id, text)."""
    names = [f"p_{c}" for c in categories]

    def run(batches):
        memo: dict[bytes, tuple[int, ...]] = {}

        def known(word: bytes) -> tuple[int, ...]:
            numbers = memo.get(word)
            if numbers is None:
                numbers = tuple(vocabulary[f] for f in features_of(word) if f in vocabulary)
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                if len(word) <= 64:
                    memo[word] = numbers
            return numbers

        for batch in slices(batches, "text", SLICE_BYTES):
            split = [words_of(t) for t in texts(batch.column("text"))]
            counted = [Counter(chain_.from_iterable(map(known, words))) for words in split]
            entries = Entries(
                np.array([f for c in counted for f in c], np.int64),
                np.repeat(np.arange(len(counted)), [len(c) for c in counted]).astype(np.int64),
                scaled(np.array([n for c in counted for n in c.values()], float)),
                length_of(np.array([len(words) for words in split], float)),
            )
            before = np.zeros((len(split), 0))
            for model in chain:
                before = np.column_stack([before, model.scores(entries, before, len(vocabulary))])
            columns = [batch.column("doc_id")] + [pa.array(before[:, j]) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names])

    schema = docs.select("doc_id").schema
    for name in names:
        schema = schema.add(name, "double")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


#: Words that mark the categories of the registered query among toxic documents (fixed values);
#: they make its training labels and are not given to the models.
CATEGORY_WORDS = {
    "insult": ("idiot", "moron", "stupid", "clown", "loser"),
    "contempt": ("trash", "pathetic", "worthless", "disgusting", "scum"),
}


def category_labels(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Labels (doc_id, toxic) of the training sample, with a column per category: toxic documents
    that hold its words. The sample is bounded, so its ids are broadcast and no text is shuffled."""
    toxic = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    marked = toxic.filter("toxic = 1").select("doc_id")
    texts_ = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id", "left_semi")
    found = texts_.groupBy("doc_id").agg(
        *(F.max(F.col("text").rlike(rf"(?i)\b(?:{'|'.join(words)})\b").cast("int")).alias(c) for c, words in CATEGORY_WORDS.items())
    )
    return toxic.join(found, "doc_id", "left").select(
        "doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in CATEGORY_WORDS), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )
