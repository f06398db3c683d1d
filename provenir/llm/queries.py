"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm import mixing, pii, rules, urls
from provenir.llm.audit import OP13_SQL, op13_audit
from provenir.llm.common import SPACE, table
from provenir.llm.language import op1_language
from provenir.llm.maxent import op6_maxent
from provenir.llm.media import op2_media
from provenir.llm.merkle import OP11_SQL, op11_manifest
from provenir.llm.mixing import op9_mixing
from provenir.llm.oddsketch import OP12_SQL, op12_minhash
from provenir.llm.packing import op7_packing
from provenir.llm.pii import op8_pii
from provenir.llm.quality import op5_quality
from provenir.llm.rules import op10_rules
from provenir.llm.simhash import op4_simhash
from provenir.llm.urls import op3_urls

QUERIES = {
    "op1_language": op1_language,
    "op2_media": op2_media,
    "op3_urls": op3_urls,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_maxent": op6_maxent,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_mixing": op9_mixing,
    "op10_rules": op10_rules,
    "op11_manifest": op11_manifest,
    "op12_minhash": op12_minhash,
    "op13_audit": op13_audit,
}

#: Models, byte formats, 64-bit hashes and draws can't be written in SQL: tests/llm holds the
#: queries above against brute force, round trips and held-out rows.  What SQL can express of
#: them, the columns that no model decides, are queries of their own below.
ORACLE_SQL: dict[str, str] = {"op11_manifest": OP11_SQL, "op12_minhash": OP12_SQL, "op13_audit": OP13_SQL}


def base_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every url, as op3 reads them."""
    host, path = urls.parsed(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    return rows.withColumn("hit", urls.rule_of(F.col("host"), F.col("path"))).select("page_id", "host", "path", "hit.rule")


_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
ORACLE_SQL["base_url_rules"] = f"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
q AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT *, CASE WHEN {_FITS.format("example.net", "/en/")} THEN 'example.net/en/' WHEN {_FITS.format("example.com", "/de/")} THEN 'example.com/de/'
  WHEN {_FITS.format("org", "/fr/")} THEN 'org/fr/' WHEN {_FITS.format("net", "/")} THEN 'net/' END AS rule FROM q"""


def base_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many valid spans of each base kind every text has, as op8 finds them."""
    kinds = F.transform("base", lambda x: x["kind"])
    rows = table(spark, sf_dir, "documents").select("doc_id", pii.base_spans(F.coalesce("text", F.lit(""))).alias("base"))
    return rows.select("doc_id", *((F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS[:4])))


_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
ORACLE_SQL["base_pii_counts"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)'), lambda x: regexp_full_match(x, '0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){{3}}'))) AS n_ip,
  len(list_filter(regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+'), lambda x: length({_DIGITS}) BETWEEN 12 AND 19
    AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INT) ELSE 2 * CAST(d AS INT) - CASE WHEN CAST(d AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card,
  len(list_filter(regexp_extract_all(t, '\\+[0-9][ ().0-9-]+[0-9]'), lambda x: length({_DIGITS}) BETWEEN 9 AND 15)) AS n_phone FROM t"""


def base_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and target of every source, as op9 sets them."""
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    sizes = table(spark, sf_dir, "documents").select("source", size.alias("size"))
    return mixing.source_targets(sizes).select("source", "source_size", F.round("target", 3).alias("target"))


_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '[{SPACE}]+'), lambda x: x <> '')"
ORACLE_SQL["base_mix_targets"] = f"""
WITH s AS (SELECT source, CAST(sum(len({_WORDS})) AS BIGINT) AS source_size FROM documents GROUP BY source),
w AS (SELECT *, 2.0 * source_size AS cap, ([3, 1, 2])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM s),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER r, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER r, 0)) AS level, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS turn
      FROM w WINDOW r AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT arg_min(level, turn) FROM l WHERE level * w <= cap) AS found FROM l)
SELECT source, source_size, round(coalesce(least(cap, found * w), cap), 3) AS target FROM f"""


def base_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every text, as op10 makes them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.base_counts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


ORACLE_SQL["base_rule_counts"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines FROM documents),
w AS (SELECT doc_id, i, hash(array_to_string(words[i : i + 7], ' ')) AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM t)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM w) WHERE n > 1),
c AS (SELECT doc_id, CAST(sum(least(8, i - before)) AS BIGINT) AS n FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8) AS before FROM r) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM t LEFT JOIN c USING (doc_id)"""

QUERIES |= {f.__name__: f for f in (base_url_rules, base_pii_counts, base_mix_targets, base_rule_counts)}
