"""Corpus pipeline: language, near-duplicates, personal data, mixture, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a
DataFrame that is written as Parquet and reread as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm import language, mixing, packing, pii, resemblance, simhash
from provenir.llm.components import connected_components
from provenir.runtime import keep, materialize, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: How far the best language's pooled probability must lie between chance and certainty:
#: short texts and texts in two languages stay, only what looks alike in all of them goes.
SURE = 0.12


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those whose language stays unclear.

    The bound follows the number of languages; where fewer than two can be learned, all
    documents with a letter stay.  Null and empty texts have no letter; ids, sources and
    repeated rows play no part.
    """
    net = language.train(docs)
    if net is None or len(net.languages) < 2:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    chance = 1 / len(net.languages)
    judged = language.predict(docs, net, keep=COLUMNS[1:])
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= chance + SURE * (1 - chance))).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The stage's rows with a row_id of their own, written so that every later read agrees on it."""
    return materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_id")), "rows")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of each near-duplicate group that has the least id, nulls last.

    Groups are the components of SimHash links and of links between texts that share 0.8
    or more of their five-word shingles.  They are groups of rows: a null or repeated id
    joins nothing, only texts do.
    """
    rows = numbered(docs)
    with scratch(spark):  # of all that the search writes, only the rows that go are read later
        found = simhash.near_duplicates(rows, "row_id").filter("row_id != component_id")
        links = found.select(F.col("row_id").alias("a"), F.col("component_id").alias("b")).unionByName(resemblance.similar(rows, "row_id"))
        roots = connected_components(materialize(links, "alike")).withColumnRenamed("node", "row_id")
        order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "row_id")
        members = materialize(roots.join(rows.select("row_id", order.alias("order")).hint("merge"), "row_id"), "members")
        first = members.groupBy("component").agg(F.min("order").alias("order")).select(F.col("order.row_id").alias("row_id"))
        gone = keep(members.select("row_id").join(first.hint("merge"), "row_id", "left_anti"), "gone")
    # rows of all documents have no size bound: a merge join at every size, not a broadcast
    return rows.join(gone.hint("merge"), "row_id", "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each span of personal data by its kind; no document is dropped.

    A null text stays null, and so does its n_chars; rows with null or repeated
    ids and equal texts are rewritten one by one, alike.
    """
    found = materialize(pii.candidates(docs.select(*COLUMNS)), "candidates")
    spans = pii.detect(found, pii.fit(found))
    clean = spans.withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each row as often as the mixture takes it, whatever its id; rows taken 0 times go.

    Null sources are a source of their own; a row without words is taken as often as its
    source's target is a whole multiple of its size; equal rows are drawn one by one.
    """
    rows = numbered(docs)
    with scratch(spark):
        taken = keep(mixing.mix_sources(rows, "row_id").select("row_id", "copies"), "copies")
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return rows.join(taken.hint("merge"), "row_id").select(*COLUMNS, times.alias("copy")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their windows."""
    return packing.pack(materialize(packing.tokenized(docs), "pieces"))


STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_each),
    ("personal_data", redact_personal_data),
    ("mixture", mix_to_targets),
    ("packing", pack_windows),
]

#: Models, hashes and draws can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote for itself goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
