"""Phrases that must not appear on a surface.

A phrase matches at a leading word boundary, without one behind it, whatever the case.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenir.runtime import materialize

_ALL = ("why", "report", "help", "status", "connect", "off")
#: Phrase -> surfaces on which it is blocked.
BLOCKED = (
    ("why this line exists", ("why", "help", "report")),
    ("why the agent wrote this", ("why", "help", "report")),
    ("the reasoning behind this line", ("why", "help", "report")),
    ("see what prompt produced a given line", ("why", "help", "report")),
    ("verifiable", _ALL),
    ("tamper-proof", _ALL),
    ("immutable", _ALL),
    ("provable", _ALL),
    ("attest", _ALL),
    ("durable", ("report", "help")),
    ("durability", ("report", "help")),
    ("survives", ("report", "help")),
    ("human-written", ("why", "report", "help", "status")),
    ("not ai", ("why", "report", "help", "status")),
    ("no ai involvement", ("why", "report", "help", "status")),
    ("ai code quality", ("report", "help")),
    ("wasted spend", ("report", "help")),
    ("signed receipts", ("why", "report", "help", "connect")),
    ("proves", _ALL),
    ("signed receipt", _ALL),
    ("signed bundle", _ALL),
    ("prompt produced", _ALL),
    ("source-available", _ALL),
    ("seen during the session", ("why",)),
    ("we observed", ("why",)),
    ("watched", ("why",)),
    ("not agent-authored", ("why", "report", "help", "status")),
    ("open source", _ALL),
    ("open-source", _ALL),
    ("read the source", _ALL),
    ("read the client", _ALL),
    ("secure", ("connect",)),
    ("safe", ("connect",)),
    ("protected", ("connect",)),
    ("encrypted", ("connect",)),
)
#: Phrase rows and code points of one automaton at most; more of them are joined on their keys.
BOUND, SIGNS = 100_000, 1_000_000
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def blocked_phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, list(s)) for p, s in BLOCKED], "phrase string, surfaces array<string>")


def phrase_key(phrase: Column) -> Column:
    """A run of word signs that every text with the phrase holds: its longest one, whole.

    Where the phrase's only run is its end, a text may go on behind it: the key is then a
    prefix, marked by its length.  Null for a phrase without any run.
    """
    low = F.translate(phrase, _CAPITALS, _CAPITALS.lower())
    runs = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
    open_end = low.rlike("[a-z0-9_]$")
    inner = F.when(open_end, F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0)))).otherwise(runs)
    longest = F.array_max(F.transform(inner, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
    last = F.element_at(runs, -1)
    return F.when(F.size(inner) > 0, longest).when(F.size(runs) > 0, F.concat(F.length(last).cast("string"), F.lit(":"), last))


class _Folded(dict):
    """Code points to what they are compared as, one to one: their upper case, unless that is
    longer or would turn a letter beyond ASCII into an ASCII one."""

    def __missing__(self, point: int) -> int:
        upper = chr(point).upper()
        stays = len(upper) != 1 or (point > 127 and ord(upper) < 128)
        self[point] = found = point if stays else ord(upper)
        return found


_FOLDED = _Folded()


def folded(text: str) -> str:
    """The text without case, as long as before."""
    return text.upper() if text.isascii() else text.translate(_FOLDED)


def holds(text: str, phrase: str) -> bool:
    """Whether the phrase begins somewhere in the text behind no ASCII word sign, whatever the case."""
    low, wanted, at = folded(text), folded(phrase), -1
    while (at := low.find(wanted, at + 1)) >= 0:
        if at == 0 or text[at - 1] not in _WORD_SIGNS:
            return True
    return False


def automaton(phrases: tuple[str, ...]):
    """One Aho-Corasick automaton of non-empty folded phrases; None without any."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, phrase in enumerate(phrases):
        out.add_word(phrase, k)
    if not phrases:
        return None
    out.make_automaton()
    return out


def found_in(text: str, phrases: tuple[str, ...], machine) -> set[int]:
    """Which of the machine's phrases begin at a word boundary of the text, in one pass over it."""
    out: set[int] = set()
    for end, k in machine.iter(folded(text)) if machine is not None else ():
        start = end - len(phrases[k])
        if k not in out and (start < 0 or text[start] not in _WORD_SIGNS):
            out.add(k)
    return out


_WORD_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def _scan_by_automaton(texts: DataFrame, rows: list[tuple[str, str]]) -> DataFrame:
    """``scan`` for phrase rows (phrase, surface) of bounded size."""
    forms: dict[str, list[str]] = {}
    where: dict[str, set[str]] = {}
    for phrase, surface in rows:
        where.setdefault(phrase, set()).add(surface)
    for phrase in where:
        forms.setdefault(folded(phrase), []).append(phrase)
    words = tuple(sorted(x for x in forms if x))
    shared = texts.sparkSession.sparkContext.broadcast((words, [forms[w] for w in words], where, forms.get("", [])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, spelled, surfaces, empty = shared.value
        machine = automaton(words_)
        for batch in batches:
            taken, hits = [], []
            for k, (text, surface) in enumerate(zip(batch.column("text").to_pylist(), batch.column("surface").to_pylist(), strict=True)):
                if text is not None:
                    own = [p for i in found_in(text, words_, machine) for p in spelled[i]] + empty
                    own = [p for p in own if surface in surfaces[p]]
                    taken += [k] * len(own)
                    hits += own
            out = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(hits, pa.string())], [*out.schema.names, "phrase"])

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("phrase", T.StringType())]))


def scan(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(every column of texts, phrase) for each violation.

    texts has (surface, text), phrases (phrase, surfaces).  Up to BOUND phrase rows of SIGNS
    code points, counted first, become one automaton that is run once over each text, in time
    linear in the text and its hits, whatever the number of phrases.  More of them are joined:
    a text meets only the phrases whose key is among its distinct words (or their prefixes, of
    the lengths that occur) by an equi-join of (text's number, key) that carries no text, and
    what meets is verified on the text; phrases without an ASCII
    word are then compared with every text of their surface.  Null texts, surfaces and
    phrases match nothing; an empty phrase is in every text.
    """
    rows = phrases.select("phrase", F.explode("surfaces").alias("surface")).filter("phrase is not null and surface is not null").distinct()
    size = rows.limit(BOUND + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("signs")).first()
    if size["n"] <= BOUND and size["signs"] <= SIGNS:
        return _scan_by_automaton(texts, [tuple(r) for r in rows.collect()])
    return _scan_by_keys(texts, rows)


def _scan_by_keys(texts: DataFrame, rows: DataFrame) -> DataFrame:
    keyed = rows.withColumn("key_", phrase_key(F.col("phrase")))
    prefixes = keyed.filter(F.contains("key_", F.lit(":"))).select(F.substring_index("key_", ":", 1).cast("int").alias("n")).distinct()
    lengths = sorted(r["n"] for r in prefixes.collect())  # one row a length
    words = F.array_distinct(F.split("low_", "[^a-z0-9_]+"))
    cut = lambda n: F.transform(F.filter("words_", lambda w: F.length(w) >= n), lambda w: F.concat(F.lit(f"{n}:"), F.left(w, F.lit(n))))
    keys = F.array_distinct(F.concat("words_", *map(cut, lengths)))
    # the empty word stands for phrases without a key
    keyed = keyed.withColumn("key_", F.coalesce("key_", F.lit("")))
    own = texts.columns
    texts = materialize(texts.withColumn("uid_", F.monotonically_increasing_id()), "texts")
    low = F.translate("text", _CAPITALS, _CAPITALS.lower())
    spread = texts.withColumn("low_", low).withColumn("words_", F.array_union(words, F.array(F.lit("")))).select("uid_", "surface", F.explode(keys).alias("key_"))
    pairs = spread.join(keyed, ["surface", "key_"]).select("uid_", "phrase")
    met = texts.join(pairs, "uid_").select(*own, "phrase")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [holds(text, phrase) for text, phrase in zip(batch.column("text").to_pylist(), batch.column("phrase").to_pylist(), strict=True)]
            yield batch.filter(pa.array(hits, pa.bool_()))

    return met.mapInArrow(verify, met.schema)
