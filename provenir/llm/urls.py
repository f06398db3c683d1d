"""URL filter: host and path rules first, then naive Bayes over segmented tokens.

Host labels are split into words by a unigram Viterbi search.  Its word counts come from
the text of all pages; a label is joined with just those of its substrings that occur as
words, so no vocabulary is broadcast.  The words of host and path are hashed into
``BUCKETS`` and scored by a multinomial naive Bayes model.  Its training rows are labelled
by what a rule judged: a rule for a whole host labels the host's words, a rule for a path
labels the tokens behind the part of the path that it matched; the rule's own tokens are
left out, and a token counts once a host.  Hosts that no such rule blocks and that hold no
seed word are the allowed ones; seed words are pseudo-counts of the blocked class.  Pages
without a rule are blocked where the log odds reach ``MARGIN``.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and
is allowed; null html has no words; an empty table trains on the seeds alone; equal urls
have equal verdicts, repeated pages are judged one by one; tags that never close are text.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm.common import lower_ascii, small_batches, table, utf8
from provenir.runtime import materialize

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words that mark unwanted hosts and paths, as pseudo-counts of both models.
SEEDS = ("ad", "ads", "adult", "bet", "bets", "bonus", "casino", "cheap", "click", "free", "gamble", "jackpot", "loan", "loans", "lottery", "pill", "pills", "poker", "porn", "prize", "sex", "slots", "spam", "track", "tracker", "viagra", "win", "xxx")
BUCKETS, SEED_WEIGHT, SMOOTH, MARGIN, LONGEST, HOT = 65536, 500, 1.0, 2.0, 24, 512
_RAW = re.compile(rb"<(script|style)\b")
_ENTITY = re.compile(rb"&[a-z]+;")
_WORD = re.compile(r"[^\W\d_]+")


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def visible(html: bytes) -> str:
    """Lower-cased text outside tags, scripts and styles, in one pass whatever is left open."""
    low, out, at, gone = html.lower(), [], 0, set()
    while (start := low.find(b"<", at)) >= 0:
        out.append(low[at:start])
        end, raw = -1, _RAW.match(low, start)
        if raw and raw[1] not in gone:
            close = low.find(b"</" + raw[1], start)
            if close < 0:  # nor for any later one
                gone.add(raw[1])
            else:
                end = low.find(b">", close)
        if end < 0:
            end = low.find(b">", start)
        if end < 0:
            at = start + 1
            break
        at = end + 1
    return _ENTITY.sub(b" ", b" ".join([*out, low[at:]])).decode("utf-8", "replace").lower()


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over the visible text of all pages, counted before the shuffle."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for html in utf8(batch, "html"):
                seen.update(_WORD.findall(visible(html)))
            if len(seen) > 200_000:
                yield _counted(seen)
                seen = Counter()
        yield _counted(seen)

    return pages.select("html").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def viterbi(name: str, counts: dict[str, int], total: float, longest: int = LONGEST) -> list[str]:
    """The most probable split into words; unknown stretches cost more the longer they are.

    Words beyond ``longest`` are looked for at their own lengths; an unknown stretch is never
    cheaper whole than in parts of up to ``longest``.
    """
    best: list[tuple[float, int]] = [(0.0, 0)]
    further = sorted({len(w) for w in counts if len(w) > longest})
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - longest), end):
            part = name[start:end]
            p = math.log(counts[part] / total) if part in counts else -math.log(total) - 3.0 * len(part)
            options.append((best[start][0] + p, start))
        for n in further:
            if n <= end and (part := name[end - n : end]) in counts:
                options.append((best[end - n][0] + math.log(counts[part] / total), end - n))
        best.append(max(options))
    out, end = [], len(name)
    while end:
        out.append(name[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def segmented(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words): the words of every label but the last, for distinct hosts.

    A label meets its substrings of up to ``LONGEST`` signs, and longer ones of the lengths
    that longer words have, so that the work grows with the label, not with its square.
    """
    total = float((words.agg(F.sum("n")).first()[0] or 0) + SEED_WEIGHT * len(SEEDS) + 1)
    further = sorted(r["n"] for r in words.filter(F.length("word") > LONGEST).select(F.length("word").alias("n")).distinct().collect())
    label = F.split(F.regexp_replace("host", r"\.[^.]*$", ""), r"[^\p{L}\p{M}\p{N}]+")
    labels = hosts.select("host", F.explode(F.array_distinct(F.array_remove(label, ""))).alias("name"))
    names = materialize(labels.select("name").distinct().withColumn("place", F.monotonically_increasing_id()), "labels")
    sizes = (*range(1, LONGEST + 1), *further)

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, words_ = [], []
            for place, name in zip(batch.column("place").to_pylist(), batch.column("name").to_pylist(), strict=True):
                for first in range(0, len(name), 4096):
                    starts = range(first, min(first + 4096, len(name)))
                    seen = {name[i : i + k] for i in starts for k in sizes if i + k <= len(name)}
                    places += [place] * len(seen)
                    words_ += seen
                    if len(words_) > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(words_, pa.string())], ["place", "word"])
                        places, words_ = [], []
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(words_, pa.string())], ["place", "word"])

    # a long label goes by its place, not by itself, or its substrings would carry its square
    subs = names.select("place", "name").mapInArrow(substrings, "place long, word string").distinct()
    own = subs.join(words, "word").groupBy("place").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, known in zip(batch.column("name").to_pylist(), batch.column("known").to_pylist(), strict=True):
                counts = {x["word"]: x["n"] for x in known or []}
                for w in SEEDS:
                    if w in name:
                        counts[w] = counts.get(w, 0) + SEED_WEIGHT
                out.append(viterbi(name, counts, total))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    split = names.join(own, "place", "left").select("name", "known").mapInArrow(run, "name string, words array<string>")
    words_of = F.coalesce("words", F.array("name"))
    return labels.join(split, "name", "left").groupBy("host").agg(F.flatten(F.collect_list(words_of)).alias("words"))


def path_tokens(path: Column) -> Column:
    """Lower-case runs of letters; a run of digits is one token, whatever its value."""
    return F.array_remove(F.split(F.regexp_replace(lower_ascii(path), "[0-9]+", " 0 "), r"[^\p{L}0]+"), "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def training_tokens(base: DataFrame, split: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(class, word): a row for each distinct host and word, from (host, path) and (host, words)."""
    seed = lambda c: F.arrays_overlap(c, F.array(*map(F.lit, SEEDS)))
    whole = tuple(r for r in rules if r[1] == "/")
    judged = split.withColumn("hit", rule_of(F.col("host"), F.lit("/"), whole))
    own = F.coalesce(F.split(F.regexp_replace("hit.rule", "/$", ""), r"[^\p{L}\p{M}\p{N}]+"), F.array().cast("array<string>"))
    hosts = judged.filter((F.col("hit.verdict") == "block") | ~seed(F.col("words"))).select(F.coalesce("hit.verdict", F.lit("allow")).alias("class"), F.explode(F.array_except("words", own)).alias("word"))
    pages = base.filter("verdict is not null")
    at = F.locate("/", F.col("rule"))
    rest = F.substr("path", F.length("rule") - at + 2)
    paths = pages.filter(at < F.length("rule")).select("host", F.col("verdict").alias("class"), F.explode(path_tokens(rest)).alias("word")).distinct()
    return hosts.unionByName(paths.select("class", "word"))


def bayes(tokens: DataFrame) -> list[float]:
    """Log odds of block against allow per bucket, from (class, word)."""
    counts = {"block": [SMOOTH] * BUCKETS, "allow": [SMOOTH] * BUCKETS}
    flat = tokens.select("class", bucket(F.col("word")).alias("b"), F.lit(1).alias("n"))
    seeds = tokens.sparkSession.range(1).select(F.lit("block").alias("class"), F.explode(F.array(*map(F.lit, SEEDS))).alias("word"))
    flat = flat.unionByName(seeds.select("class", bucket(F.col("word")).alias("b"), F.lit(SEED_WEIGHT).alias("n")))
    for r in flat.groupBy("b", "class").agg(F.sum("n").alias("n")).collect():  # two rows a bucket at most
        counts[r["class"]][r["b"]] += r["n"]
    sums = {k: sum(v) for k, v in counts.items()}
    return [round(math.log(x / sums["block"]) - math.log(y / sums["allow"]), 9) for x, y in zip(counts["block"], counts["allow"], strict=True)]


def with_host_words(base: DataFrame, hosts: DataFrame, split: DataFrame) -> DataFrame:
    """Adds each row's host words; hosts is (host, count), split (host, words), both written.

    A host with at least 1 / HOT of all rows would pile up in one task of a shuffle.  There
    are at most HOT of them, so their words are broadcast; all other hosts are joined.
    """
    none = F.array().cast("array<string>")
    total = hosts.agg(F.sum("count")).first()[0] or 0
    hot = hosts.filter(F.col("count") * HOT >= total).select("host").limit(HOT)
    met = base.join(F.broadcast(split.join(F.broadcast(hot), "host", "left_semi")), "host", "left")
    here = met.filter("words is not null or host = ''").withColumn("words", F.coalesce("words", none))
    return here.unionByName(met.filter("words is null and host != ''").drop("words").join(split, "host"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", rules: tuple = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, log_odds) for every page."""
    host, path = parsed(F.col("url"))
    base = pages.select(id_col, host.alias("host"), path.alias("path"))
    base = base.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).select(id_col, "host", "path", "hit.rule", "hit.verdict")
    words = materialize(word_counts(pages), "words")
    hosts = materialize(base.filter("host != ''").groupBy("host").count(), "hosts")
    names = hosts.select("host")
    split = names.join(segmented(names, words), "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    split = materialize(split, "segments")
    odds = F.from_json(F.lit(json.dumps(bayes(training_tokens(base, split, rules)))), "array<double>")
    rows = with_host_words(base, hosts, split)
    rows = rows.withColumn("buckets", F.transform(F.concat("words", path_tokens(F.col("path"))), bucket)).drop("words")
    score = F.aggregate("buckets", F.lit(0.0), lambda acc, b: acc + F.get(odds, b))
    verdict = F.coalesce("verdict", F.when(score >= MARGIN, "block").otherwise("allow"))
    return rows.select(id_col, "host", "path", "rule", verdict.alias("verdict"), score.alias("log_odds"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
