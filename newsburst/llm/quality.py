"""Quality rules: plain counts of each document, and how far its character classes and common
words lie from those of its language.

References are made from all documents given: the summed histograms of each language. A
document's histogram is compared with its language's by the Jensen-Shannon distance (the square
root of the divergence to base 2, so between 0 and 1). Short documents are too noisy for that:
guards set a least number of words for either comparison.

Everything is DataFrame expressions, in one pass over the texts: features are written to the
shared folder, beside the columns asked for, summed per language with partial aggregates, and read
again for the verdict. Where whole documents are filtered, the sums have a pass of their own.
References go to the tasks as one row per profiled language, of fixed size.

Words are runs of characters other than space and ``\\t`` to ``\\r``. Defined results: a null text
has no words and fails the base rules, as does any text of fewer words than the least. A null
language, or one without a profile, is not compared. Rows, repeated or not, are judged one by
one. An empty table gives none. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsburst.llm.common import fresh
from newsburst.session import stage

WINDOW = 5
SPACE = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
CLASSES = ("lower", "space", "upper", "digit", "stop", "symbol", "ascii", "other")

#: Common words of the profiled languages (fixed values).
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as by be this are at from".split(),
    "de": "der die und in den von zu das mit sich des auf für nicht ist im dem ein eine als".split(),
    "fr": "de la le et les des en un du que une pour est dans qui pas par sur au avec".split(),
    "es": "de la que el en y los se las del con un por no una su para es al lo".split(),
}


@dataclass(frozen=True)
class Limits:
    """Base rules, guards and the largest distances of a document that is kept."""

    least_words: int = 10
    most_repeated: int = 20  # percent of the words
    class_words: int = 40
    class_distance: float = 0.30
    common_words: int = 80
    common_distance: float = 0.28


def _with_counts(docs: DataFrame, text: Column, out: str) -> DataFrame:
    """Adds struct ``out`` of all features, layer by layer so that each is computed once.

    Repeated words: only documents with an equal pair of window hashes sort them; neighbours of
    equal hash give the repeated places, and the places in order the words that they cover.
    """
    names = {k: fresh(docs, f"_{k}") for k in ("text", "words", "hashes", "order", "twice", "rest", "signs", "common")}
    c = {k: F.col(f"`{v}`") for k, v in names.items()}
    profile = [w for words in COMMON_WORDS.values() for w in words]
    empty = F.array().cast("array<int>")

    layered = docs.withColumn(names["text"], F.coalesce(text, F.lit("")))
    layered = layered.withColumns(
        {
            names["words"]: F.array_remove(F.split(c["text"], SPACE, -1), ""),
            names["rest"]: F.regexp_replace(c["text"], "[a-z]+", ""),
        }
    )
    n_windows = F.size(c["words"]) - (WINDOW - 1)
    places = F.when(n_windows > 0, F.sequence(F.lit(0), n_windows - 1)).otherwise(empty)
    layered = layered.withColumns(
        {
            names["hashes"]: F.transform(places, lambda i: F.xxhash64(F.slice(c["words"], i + 1, WINDOW))),
            names["signs"]: F.regexp_replace(c["rest"], SPACE, ""),
            names["common"]: F.filter(c["words"], lambda w: w.isin(*profile)),
        }
    )
    pairs = F.transform(c["hashes"], lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    layered = layered.withColumn(
        names["order"],
        F.when(F.size(F.array_distinct(c["hashes"])) < F.size(c["hashes"]), F.sort_array(pairs)).otherwise(
            F.array().cast("array<struct<h:bigint,i:int>>")
        ),
    )

    def twice(pair, k):
        before = F.try_element_at(c["order"], F.when(k > 0, k)).h
        after = F.try_element_at(c["order"], k + 2).h
        return before.eqNullSafe(pair.h) | after.eqNullSafe(pair.h)

    layered = layered.withColumn(
        names["twice"], F.sort_array(F.transform(F.filter(c["order"], twice), lambda pair: pair.i))
    )
    following = F.transform(
        c["twice"],
        lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.try_element_at(c["twice"], k + 2) - i, F.lit(WINDOW))),
    )
    lines = F.filter(F.split(c["text"], "\n", -1), lambda line: F.btrim(line, F.lit(" \t\x0b\x0c\r")) != "")

    def count(pattern: str) -> Column:
        return F.regexp_count(c["signs"], F.lit(pattern)).cast("long")

    n_symbols = F.length(c["signs"]) - F.length(F.regexp_replace(c["signs"], SYMBOLS, ""))
    n_lower = F.length(c["text"]) - F.length(c["rest"])
    n_space = F.length(c["rest"]) - F.length(c["signs"])
    upper, digit, stop = count("[A-Z]"), count("[0-9]"), count(r"[.,;:!?'\"()-]")
    ascii_signs, other = count(r"[+/=@\[\\\]^_`{}~\x00-\x08\x0E-\x1F\x7F]"), count(r"[^\x00-\x7F]")
    no_words = F.array().cast("array<bigint>")
    per_language = no_words
    for lang, listed in COMMON_WORDS.items():
        held = [F.size(c["common"]) - F.size(F.array_remove(c["common"], w)) for w in listed]
        per_language = F.when(F.col("`lang`") == lang, F.array(*(h.cast("long") for h in held))).otherwise(per_language)
    features = F.struct(
        F.size(c["words"]).cast("long").alias("n_words"),
        (F.length(c["text"]) - n_space).cast("long").alias("word_chars"),
        n_symbols.cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.aggregate(following, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.array(
            *(x.cast("long") for x in (n_lower, n_space, upper, digit, stop, n_symbols, ascii_signs, other))
        ).alias("classes"),
        per_language.alias("common"),
    )
    return layered.select(*(docs[f"`{x}`"] for x in docs.columns), features.alias(out))


def _histogram(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / total)


def _with_rest(counts: Column, total: Column) -> Column:
    """The counts and what is left of the total, as shares."""
    left = total - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return _histogram(F.concat(counts, F.array(left)), total)


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two histograms of shares, given as arrays of one length."""

    def part(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)) / 2)


def references(counted: DataFrame, features: str) -> DataFrame:
    """(lang, ref_classes, ref_common): shares over all documents of each profiled language."""
    profiled = counted.filter(F.col("`lang`").isin(*COMMON_WORDS))
    n_common = {len(w) for w in COMMON_WORDS.values()}.pop()
    sums = [F.sum(F.get(f"{features}.classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.get(f"{features}.common", F.lit(i))).alias(f"w{i}") for i in range(n_common)]
    total = profiled.groupBy(F.col("`lang`").alias("ref_lang")).agg(*sums, F.sum(f"{features}.n_words").alias("words"))
    classes = F.array(*(f"c{i}" for i in range(len(CLASSES))))
    chars = F.aggregate(classes, F.lit(0).cast("long"), lambda a, x: a + x)
    common = F.array(*(f"w{i}" for i in range(n_common)))
    return total.filter("words > 0").select(
        "ref_lang",
        _histogram(classes, chars).alias("ref_classes"),
        _with_rest(common, F.col("words")).alias("ref_common"),
    )


def judge(docs: DataFrame, limits: Limits = Limits(), keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Columns ``keep`` (default: all) of ``docs`` (text, lang, ...) with a struct of the counts,
    class_distance and common_distance (null where a guard holds), base_failed and kept; and the
    struct's name."""
    features = fresh(docs, "quality")
    counted = _with_counts(docs, docs["`text`"], features)
    kept = keep or docs.columns
    wanted = dict.fromkeys([*kept, next(c for c in docs.columns if c.lower() == "lang")])
    counted = stage(counted.select(*(f"`{c}`" for c in wanted), features), "quality")
    return _verdicts(counted, features, limits, kept), features


def _verdicts(counted: DataFrame, features: str, limits: Limits, kept: list[str]) -> DataFrame:
    """Columns ``kept`` of rows with their features, and the verdict in place of these."""
    # One row for each profiled language at most: a broadcast of fixed size.
    judged = counted.join(
        F.broadcast(references(counted, features)), F.col("`lang`") == F.col("ref_lang"), "left"
    )
    f = {name: F.col(f"{features}.{name}") for name in counted.schema[features].dataType.names}
    n = f["n_words"]
    chars = F.aggregate(f["classes"], F.lit(0).cast("long"), lambda a, x: a + x)
    class_distance = F.when(
        (n >= limits.class_words) & F.col("ref_classes").isNotNull(),
        jensen_shannon(_histogram(f["classes"], chars), F.col("ref_classes")),
    )
    common_distance = F.when(
        (n >= limits.common_words) & F.col("ref_common").isNotNull(),
        jensen_shannon(_with_rest(f["common"], n), F.col("ref_common")),
    )
    base_failed = (n < limits.least_words) | (100 * f["n_repeat_words"] > limits.most_repeated * n)
    near = (F.coalesce(class_distance, F.lit(0.0)) <= limits.class_distance) & (
        F.coalesce(common_distance, F.lit(0.0)) <= limits.common_distance
    )
    verdict = F.struct(
        *(f[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        class_distance.alias("class_distance"),
        common_distance.alias("common_distance"),
        base_failed.alias("base_failed"),
        (~base_failed & near).alias("kept"),
    )
    return judged.select(*(f"`{c}`" for c in kept), verdict.alias(features))


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``docs`` without the documents that the rules reject. Whole documents are not written on the way: the
    references come from a pass of their own, which counts only what they need."""
    features, row = fresh(docs, "quality"), fresh(docs, "_row")
    counted = _with_counts(docs, docs["`text`"], features)
    # Nothing is pushed below a column that is not deterministic. A filter on the verdict would otherwise
    # go below the layers of the features, and split and hash their arrays again for every window.
    counted = counted.withColumn(row, F.monotonically_increasing_id())
    judged = _verdicts(counted, features, limits, [*docs.columns, row])
    return judged.filter(F.col(f"{features}.kept") & (F.col(row) >= 0)).drop(features, row)
