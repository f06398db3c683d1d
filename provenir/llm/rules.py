"""Quality rules: base counts of a text, then a hashed n-gram likelihood ratio.

Everything runs as DataFrame expressions.  The verdict compares two multinomials, a trusted
target, the documents labelled good, and the raw corpus, over two kinds of hashed n-grams:
pairs of lower-cased words, and word shapes (capitals, small letters and digits each become
one sign, other signs stay).  Each kind has buckets of its own.  A document's mean log ratio
over its n-grams must reach ``FLOOR``; every document is thresholded alike, nothing is
drawn.

The raw counts cover all documents.  The target's rows are the labelled good documents, at
most about ``TRUSTED`` of them, chosen by a hash of the id; both tables have ``SHAPES`` +
``PAIRS`` entries, whatever the input.

Defined cases: null text counts as empty and fails for its few words; without labels the
ratio is 0 everywhere and only the base rule decides; repeated rows are judged one by one.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm.common import SPACE, hash_share, table
from provenir.runtime import materialize

SHAPES, PAIRS, TRUSTED, FLOOR, SMOOTH, WINDOW = 4096, 1 << 16, 20_000, -0.15, 1.0, 8
BUCKETS = SHAPES + PAIRS
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to (.., text)."""
    text, n = F.coalesce("text", F.lit("")), F.col("n_words")
    lines = F.filter(F.split("text_", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = docs.withColumn("text_", text).withColumns({"words_": words(F.col("text_")), "lines_": lines})
    out = out.withColumns(
        {
            "n_words": F.size("words_").cast("long"),
            "word_chars": F.length(F.array_join("words_", "")).cast("long"),
            "n_symbols": (F.length("text_") - F.length(F.regexp_replace("text_", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
        }
    )
    # a 64-bit hash of each window, by doubling: of words, pairs, fours, eights; most texts
    # repeat no four words and stop there
    out = out.withColumn("hashes_", F.when(n > WINDOW, F.transform("words_", lambda w: F.xxhash64(w))))
    for k in (1, 2, 4):
        out = out.withColumn("hashes_", F.zip_with("hashes_", F.slice("hashes_", k + 1, F.greatest(n, F.lit(1)).cast("int")), lambda x, y: F.xxhash64(x, y)))
        if 2 * k > 2:
            out = out.withColumn("hashes_", F.slice("hashes_", F.lit(1), F.greatest(n - 2 * k + 1, F.lit(0)).cast("int")))
        if 2 * k == 4:
            out = out.withColumn("hashes_", F.when(F.size(F.array_distinct("hashes_")) < F.size("hashes_"), F.col("hashes_")))
    placed = F.sort_array(F.transform("hashes_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("placed_", F.when(F.size(F.array_distinct("hashes_")) < F.size("hashes_"), placed))
    same = lambda x, k: F.coalesce(x["h"] == F.get("placed_", k)["h"], F.lit(False))
    twice = F.filter("placed_", lambda x, k: same(x, k - 1) | same(x, k + 1))
    out = out.withColumn("starts_", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "starts_",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("words_", "lines_", "hashes_", "placed_", "starts_", "text_")


def shapes(text: Column) -> Column:
    """A text's words with capitals, small letters and digits reduced to one sign each."""
    # ranges first: most letters are told by them, categories cost more
    small = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[a-z\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "a"), r"[A-Z\p{Lu}]+", "A")
    return words(F.regexp_replace(small, r"\p{N}+", "0"))


def lower_words(text: Column) -> Column:
    return words(F.lower(F.coalesce(text, F.lit(""))))


def pair_bucket(word: Column, after: Column) -> Column:
    """Of a word and the one behind it (null at the end)."""
    return (F.pmod(F.xxhash64(word, after), F.lit(PAIRS)) + F.lit(SHAPES)).cast("int")


def shape_bucket(shape: Column) -> Column:
    return F.pmod(F.xxhash64(shape), F.lit(SHAPES)).cast("int")


def _next(array: Column) -> Column:
    return F.slice(array, 2, F.greatest(F.size(array), F.lit(1)))


def bucketed(docs: DataFrame) -> DataFrame:
    """Adds shapes_ and pairs_, the buckets of all n-grams of a text, to (.., text)."""
    out = docs.withColumns({"shape_": shapes(F.col("text")), "low_": lower_words(F.col("text"))})
    low = F.col("low_")
    return out.withColumns({"shapes_": F.transform("shape_", shape_bucket), "pairs_": F.zip_with(low, _next(low), pair_bucket)}).drop("shape_", "low_")


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id") -> list[float]:
    """log(target share / raw share) of every bucket, smoothed; zeros without a target."""
    return bucket_ratios(bucketed(docs.select(id_col, "text")), trusted_ids, id_col)


def bucket_ratios(rows: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id") -> list[float]:
    """``log_ratios`` of rows that have their buckets."""
    marked = trusted_ids.select(id_col, F.lit(True).alias("trusted"))
    rows = rows.select(id_col, "shapes_", "pairs_").join(F.broadcast(marked), id_col, "left")
    flat = rows.select("trusted", F.explode(F.concat("shapes_", "pairs_")).alias("bucket"))
    counted = flat.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target")).collect()  # BUCKETS rows
    raw, target = [SMOOTH] * BUCKETS, [SMOOTH] * BUCKETS
    for r in counted:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if sum(target) == SMOOTH * BUCKETS:
        return [0.0] * BUCKETS
    base = math.log(sum(raw)) - math.log(sum(target))
    return [round(math.log(t) - math.log(r) + base, 9) for t, r in zip(target, raw, strict=True)]


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", most: int = TRUSTED) -> DataFrame:
    """Ids of about ``most`` good documents, never over twice as many: a bounded broadcast."""
    good = labels.filter("quality = 1").select(id_col).distinct()
    return good.filter(hash_share(good, id_col, most)).limit(2 * most)


def judge(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """Adds the base counts, base_failed, ratio and kept to (.., text)."""
    return verdicts(bucketed(base_counts(docs)), ratios)


def verdicts(rows: DataFrame, ratios: list[float]) -> DataFrame:
    """Adds base_failed, ratio and kept to rows with base counts and buckets, which go."""
    lookup = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    total_of = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.get(lookup, x))
    # a text has as many lower-cased words as words and the last of them starts a pair with nothing
    mean = (total_of("pairs_") + total_of("shapes_")) / F.greatest(2 * F.size("pairs_"), F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = rows.withColumns({"base_failed": failed, "ratio": mean}).drop("shapes_", "pairs_")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= FLOOR))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # counts and buckets are made once from the text and written, about as large as the text
    rows = materialize(bucketed(base_counts(docs)).drop("text"), "buckets")
    ratios = bucket_ratios(rows, trusted_ids(table(spark, sf_dir, "labels")))
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept ratio"
    return verdicts(rows, ratios).select(*columns.split())
