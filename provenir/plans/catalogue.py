"""Registered queries over the driver's tables and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.functions import decode, identity, policy, text
from provenir.operators import attribution, claims, coverage, keyed, ledger, manifest
from provenir.plans.registry import ORACLE_SQL, QUERIES, query
from provenir.plans.standins import GRADE, STATUS, attempts, edges, load, mapped, ref_commits, spread
from provenir.streaming import delivery

_GRADE_SQL = "CASE l_returnflag WHEN 'A' THEN 'derived' WHEN 'N' THEN 'observed' WHEN 'R' THEN 'declared' END"
_STATUS_SQL = "CASE event_type WHEN 'view' THEN 200 WHEN 'purchase' THEN 200 WHEN 'click' THEN 503 WHEN 'signup' THEN 413 WHEN 'error' THEN 401 END"
_CLASS_SQL = "CASE event_type WHEN 'view' THEN 'ok' WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'later' WHEN 'signup' THEN 'never' WHEN 'error' THEN 'fatal' ELSE 'later' END"
_ATTEMPTS_SQL = f"""
  SELECT user_id AS key, ts AS happened, event_id AS attempt_id, {_CLASS_SQL} AS outcome, CAST(ts AS DATE) AS fingerprint,
         CAST(sum(1 + CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS eof
  FROM events"""


@query(f"""
WITH held AS (
  SELECT l_orderkey AS sha, count(*) FILTER (l_returnflag = 'A') AS derived, count(*) FILTER (l_returnflag = 'N') AS observed, count(*) FILTER (l_returnflag = 'R') AS declared
  FROM lineitem GROUP BY 1),
unit AS (
  SELECT o_orderpriority AS ref,
         count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') AS window_commits,
         count(sha) AS edges_held,
         count(sha) FILTER (o_orderstatus = 'O') AS reachable,
         count(sha) FILTER (o_orderstatus = 'P') AS exact_successors,
         count(sha) FILTER (o_orderstatus = 'F') AS probable_count,
         CAST(coalesce(sum(derived), 0) AS BIGINT) AS grade_derived, CAST(coalesce(sum(observed), 0) AS BIGINT) AS grade_observed, CAST(coalesce(sum(declared), 0) AS BIGINT) AS grade_declared
  FROM orders LEFT JOIN held ON o_orderkey = sha GROUP BY 1)
SELECT *, reachable + exact_successors AS counted,
       CASE WHEN edges_held > 0 THEN CAST(floor((reachable + exact_successors) / edges_held * 100 + 0.5) AS BIGINT) END AS percent,
       CASE WHEN window_commits = 0 THEN 'no_commits' WHEN edges_held = 0 THEN 'no_sessions' WHEN reachable + exact_successors > edges_held THEN 'malformed' ELSE 'coverage' END AS state
FROM unit""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ref is an order priority, a commit an order, an edge a line item."""
    return coverage.coverage(ref_commits(spark, sf_dir), edges(spark, sf_dir))


@query("""
SELECT l_orderkey AS sha, CASE min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 WHEN 'A' THEN 2 END) WHEN 0 THEN 'declared' WHEN 1 THEN 'observed' WHEN 2 THEN 'derived' END AS floor, count(*) AS edges
FROM lineitem GROUP BY 1""")
def grade_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.grade_floors(edges(spark, sf_dir))


@query(f"""
SELECT l_orderkey AS sha, {_GRADE_SQL} AS grade, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def grade_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per commit and grade; a grade without edges has no row."""
    return edges(spark, sf_dir).groupBy("sha", "grade").agg(F.count("*").alias("n"))


@query(f"""SELECT event_id, {_STATUS_SQL} AS status, {_CLASS_SQL} AS class FROM events""")
def status_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("status", mapped("event_type", STATUS))
    return e.select("event_id", "status", policy.classify_status(F.col("status")).alias("class"))


_FOLD_SQL = f"""
WITH a AS ({_ATTEMPTS_SQL}),
b AS (SELECT *, coalesce(max(CASE WHEN outcome = 'fatal' THEN 1 END) OVER (PARTITION BY key, fingerprint ORDER BY happened, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS attempted FROM a),
c AS (SELECT *, coalesce(max(CASE WHEN attempted AND outcome IN ('ok', 'never') THEN eof END) OVER (PARTITION BY key ORDER BY happened, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_before FROM b)
SELECT key, count(*) FILTER (attempted) AS seq,
       coalesce(max(CASE WHEN attempted AND outcome IN ('ok', 'never') THEN eof END), 0) AS sent,
       CAST(coalesce(sum(CASE WHEN attempted AND outcome = 'never' THEN eof - sent_before END), 0) AS BIGINT) AS gap_bytes,
       count(*) FILTER (attempted AND outcome = 'never') AS gap_count
FROM c GROUP BY key"""


@query(_FOLD_SQL)
def ledger_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger_window(attempts(spark, sf_dir))


_CAPPED_SQL = f"""
WITH RECURSIVE a AS (SELECT CAST(key AS VARCHAR) AS key, epoch_us(happened) // 1000 AS at_ms, eof, outcome, CAST(fingerprint AS VARCHAR) AS fp, row_number() OVER (PARTITION BY key ORDER BY happened, attempt_id) AS r FROM ({_ATTEMPTS_SQL})),
s(key, r, sent, backlog, gap_bytes, gap_count, last, stopped, seq) AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS STRUCT(f BIGINT, t BIGINT, a BIGINT)[]), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM a
  UNION ALL
  SELECT key, r, CASE WHEN idle THEN sent WHEN outcome IN ('ok', 'never') THEN eof WHEN len(kept) > 0 THEN kept[1].f WHEN len(held) > 0 THEN held[len(held)].t ELSE start END,
    CASE WHEN idle THEN backlog WHEN outcome IN ('ok', 'never') THEN [] ELSE kept END,
    gap_bytes + CASE WHEN idle OR outcome = 'ok' THEN 0 WHEN outcome = 'never' THEN eof - start WHEN len(held) = len(kept) THEN 0 WHEN len(kept) > 0 THEN kept[1].f - held[1].f ELSE held[len(held)].t - held[1].f END,
    gap_count + CASE WHEN idle OR outcome = 'ok' THEN 0 WHEN outcome = 'never' THEN 1 ELSE len(held) - len(kept) END,
    CASE WHEN NOT idle AND outcome = 'ok' THEN at_ms ELSE last END, CASE WHEN NOT idle AND outcome = 'fatal' THEN fp ELSE stopped END, seq + CASE WHEN idle THEN 0 ELSE 1 END
  FROM (SELECT *, list_filter(held, lambda x, i: NOT (held[len(held)].t - x.f > 8388608 OR at_ms - x.a > 86400000 OR len(held) - i + 1 > 512)) AS kept FROM (
    SELECT *, CASE WHEN eof > coalesce(open[len(open)].t, start) THEN list_append(open, {{f: coalesce(open[len(open)].t, start), t: eof, a: at_ms}}) ELSE open END AS held FROM (
      SELECT s.key, a.r, s.sent, s.backlog, s.gap_bytes, s.gap_count, s.last, s.stopped, s.seq, a.at_ms, a.eof, a.outcome, a.fp,
        CASE WHEN s.sent > a.eof THEN 0 ELSE s.sent END AS start, CASE WHEN s.sent > a.eof THEN [] ELSE s.backlog END AS open,
        coalesce(s.stopped = a.fp, FALSE) OR a.eof <= CASE WHEN s.sent > a.eof THEN 0 ELSE s.sent END AS idle
      FROM s JOIN a ON a.key = s.key AND a.r = s.r + 1)))),
z AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r DESC) AS back FROM s)
SELECT key, seq, sent, len(backlog) AS backlog_entries, CAST(CASE WHEN len(backlog) > 0 THEN backlog[len(backlog)].t - backlog[1].f ELSE 0 END AS BIGINT) AS pending_bytes, gap_bytes, gap_count, last AS last_sent_at, stopped FROM z WHERE back = 1"""


@query(_CAPPED_SQL)
def ledger_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the caps on held spans, which no SQL aggregate follows: a recursive query does, an attempt of every key a round."""
    return ledger.ledger_fold(attempts(spark, sf_dir))


@query(f"SELECT CAST(key AS VARCHAR) AS key, * EXCLUDE (key) FROM ({_FOLD_SQL})")
def ledger_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered fold without caps gives what the windows give."""
    inf = float("inf")
    return ledger.ledger_fold(attempts(spark, sf_dir), (inf, inf, inf)).select("key", "seq", "sent", "gap_bytes", "gap_count")


_FILES_SQL = """
  SELECT d.doc_id AS file, d.source AS session, d.n_chars AS size,
         coalesce(CASE WHEN l.quality = 1 AND l.toxic = 1 THEN 2 * d.n_chars WHEN l.quality = 1 THEN d.n_chars WHEN l.doc_id IS NOT NULL THEN d.n_chars // 2 END, 0) AS sent
  FROM documents d LEFT JOIN labels l USING (doc_id)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of sessions; labels say how much of each was sent."""
    d, lab = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    size = F.col("n_chars")
    sent = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), 2 * size).when(F.col("quality") == 1, size).when(F.col("labelled"), F.floor(size / 2))
    return d.select("doc_id", "source", "n_chars").join(lab, "doc_id", "left").select(F.col("doc_id").alias("file"), F.col("source").alias("session"), size.alias("size"), F.coalesce(sent, F.lit(0)).cast("long").alias("sent"))


@query(f"""
SELECT file, size, sent, CASE WHEN size > start THEN start END AS from_off, CASE WHEN size > start THEN size END AS to_off
FROM (SELECT *, CASE WHEN sent > size THEN 0 ELSE sent END AS start FROM ({_FILES_SQL}))""")
def next_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).withColumn("span", policy.next_span(F.col("sent"), F.col("size")))
    return f.select("file", "size", "sent", "span.from_off", "span.to_off")


@query(f"""
SELECT session, file, size, sent, CAST(place AS BIGINT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY file) AS place FROM ({_FILES_SQL}) WHERE sent < size)
WHERE place <= 8""")
def pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    known = f.select("session", "file", "sent")
    out = ledger.pending_files(f.select("session", "file", F.col("file").alias("mtime"), "size"), known)
    return out.select("session", "file", "size", "sent", F.col("place").cast("long").alias("place"))


@query(f"""
SELECT key, epoch_us(happened) AS last_us, attempt_id FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY happened DESC, attempt_id) AS r FROM ({_ATTEMPTS_SQL}) WHERE outcome = 'ok')
WHERE r = 1""")
def last_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.last_send(attempts(spark, sf_dir))
    return out.select("key", F.unix_micros(F.col("last_at").cast("timestamp")).alias("last_us"), "attempt_id")


def _asof_sql(seconds: int) -> str:
    return f"""
SELECT c.event_id AS commit_id, c.user_id AS repo,
       arg_max(t.event_id, (t.ts, t.event_id)) AS session_id, max(epoch_us(t.ts)) AS touched_us
FROM (SELECT * FROM events WHERE event_type = 'purchase') c
LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') t
  ON t.user_id = c.user_id AND t.ts <= c.ts AND epoch_us(c.ts) - epoch_us(t.ts) <= CAST({seconds} AS BIGINT) * 1000000
GROUP BY 1, 2"""


def _asof(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    """Purchases are commits, views are touches of sessions, a user is a repository."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), F.col("ts").alias("at"), "event_id", "event_type")
    commits = e.filter("event_type = 'purchase'").withColumn("commit_id", F.col("event_id"))
    touches = e.filter("event_type = 'view'").withColumns({"session_id": F.col("event_id"), "touch_id": F.col("event_id")})
    return attribution.active_session(commits, touches, seconds).select("commit_id", "repo", "session_id", "touched_us")


@query(_asof_sql(1800))
def active_session_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, policy.LIVE_SECONDS)


@query(_asof_sql(21600))
def active_session_asof_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, 21600)


def _sessions_sql(seconds: int) -> str:
    return f"""
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < CAST({seconds} AS BIGINT) * 1000000 THEN 0 ELSE 1 END AS fresh, event_id FROM events),
h AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id AS key, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + CAST({seconds} AS BIGINT) * 1000000 AS end_us, count(*) AS n FROM h GROUP BY user_id, island"""


def _sessions(spark: SparkSession, sf_dir: str, gap: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return delivery.live_sessions(e, gap).select("key", micros("start").alias("start_us"), micros("end").alias("end_us"), "n")


@query(_sessions_sql(1800))
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir, "30 minutes")


@query(_sessions_sql(21600))
def session_windows_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir, "6 hours")


@query("""
SELECT user_id, day, event_id, event_type FROM (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, event_type, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def once_per_key_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("day", text.utc_day(F.col("ts")))
    return keyed.once_per_key(e.select("user_id", "day", "ts", "event_id", "event_type"), ["user_id", "day"], ["ts", "event_id"]).drop("ts")


@query("""
SELECT user_id, event_id, CAST(place AS BIGINT) AS place FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events) WHERE place <= 32""")
def spool_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keyed.first_per_key(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], policy.MAX_COMMITS)
    return out.select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("""SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20""")
def recent_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.newest(load(spark, sf_dir, "events"), 20, "ts", "event_id").select("event_id", "user_id", "event_type")


@query(r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
       lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)) AS host,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?[^/?#:]*(?::[0-9]*)?([^?#]*)', 1) AS path FROM pages),
s AS (SELECT *, list_filter(string_split(regexp_replace(path, '\.git$', ''), '/'), lambda x: x <> '') AS parts FROM p),
k AS (SELECT *, scheme IN ('https', 'http', 'ssh', 'git') AND len(parts) = 2 AND regexp_full_match(parts[1], '[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?')
       AND regexp_full_match(parts[2], '[A-Za-z0-9._-]+') AND parts[2] NOT IN ('.', '..') AND regexp_full_match(host, '[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?') AS ok FROM s)
SELECT page_id, CASE WHEN ok THEN host || '/' || parts[1] || '/' || parts[2] ELSE 'local:' || substr(sha256(url), 1, 12) END AS repo_slug FROM k""")
def repo_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", identity.resolve_repo_slug(F.col("url"), F.col("url")).alias("repo_slug"))


@query("""
WITH m AS (SELECT event_id, (SELECT max(epoch_ms(ts)) FROM events) - epoch_ms(ts) AS gone FROM events)
SELECT event_id, CASE WHEN gone < 60000 THEN 'just now'
  WHEN gone < 3600000 THEN (gone // 60000) || CASE WHEN gone // 60000 = 1 THEN ' minute ago' ELSE ' minutes ago' END
  WHEN gone < 86400000 THEN (gone // 3600000) || CASE WHEN gone // 3600000 = 1 THEN ' hour ago' ELSE ' hours ago' END
  ELSE (gone // 86400000) || CASE WHEN gone // 86400000 = 1 THEN ' day ago' ELSE ' days ago' END END AS age FROM m""")
def relative_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    now = e.agg(F.max("ms")).first()[0]
    return e.select("event_id", text.relative_age(F.col("ms"), F.lit(now)).alias("age"))


@query("""
WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, min(place) AS first, max(place) AS last, max(total) AS total, min(place) > 1 OR max(place) < max(total) AS partial FROM r WHERE place <= 4 GROUP BY conv_id""")
def turn_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"))
    return attribution.turn_windows(c, ["conv_id"], 4)


@query("""
SELECT conv_id, turn, CASE role WHEN 'assistant' THEN '· sub-agent ' || turn WHEN 'user' THEN '' ELSE '· actor not recorded' END AS marker,
       '    turn ' || turn || CASE WHEN role = 'system' THEN '' ELSE '  [' || role || ']' END
       || CASE role WHEN 'assistant' THEN '  · sub-agent ' || turn WHEN 'user' THEN '' ELSE '  · actor not recorded' END AS row_text
FROM conversations""")
def turn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns have an agent, user turns are the main thread, system turns don't say."""
    c = load(spark, sf_dir, "conversations")
    agent = F.when(F.col("role") == "assistant", F.col("turn").cast("string"))
    marker = text.attribution_marker(agent, F.col("role") != "system", F.lit(None).cast("long"))
    tool = F.when(F.col("role") != "system", F.col("role"))
    row = text.turn_row(F.col("turn"), tool, F.array().cast("array<string>"), marker)
    return c.select("conv_id", "turn", marker.alias("marker"), row.alias("row_text"))


@query("""
WITH t AS (SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn, role) AS roles, count(*) FILTER (role = 'system') AS unrecorded FROM conversations GROUP BY 1)
SELECT t.conv_id, CASE WHEN l.doc_id IS NULL THEN 'no_edge' ELSE 'turns' END AS state,
       CASE l.quality WHEN 1 THEN 'derived' WHEN 0 THEN 'declared' END AS grade, turns, roles, unrecorded
FROM t LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = t.conv_id""")
def why_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is the file of a blamed commit; a label is the edge."""
    c = load(spark, sf_dir, "conversations")
    repo = F.lit("r").alias("repo")
    agent = F.when(F.col("role") == "assistant", F.col("turn").cast("string"))
    turns = c.select(repo, F.col("conv_id").alias("sha"), F.lit("f").alias("file"), F.col("turn").alias("position"), F.col("role").alias("tool"), F.array().cast("array<string>").alias("files"), agent.alias("agent_id"), (F.col("role") != "system").alias("agent_id_recorded"), F.lit(None).cast("long").alias("subagent_count"))
    lab = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    edge = lab.select(repo, F.col("doc_id").alias("sha"), F.lit(None).cast("long").alias("session_id"), F.when(F.col("quality") == 1, "derived").otherwise("declared").alias("grade"))
    blamed = c.select(repo, F.col("conv_id").alias("sha"), F.lit("f").alias("file")).distinct()
    doc = attribution.why_turns(blamed, edge, turns)
    return doc.select(
        F.col("sha").alias("conv_id"),
        "state",
        text.grade_floor(F.col("grades")).alias("grade"),
        F.size("turns").cast("long").alias("turns"),
        F.array_join(F.transform("turns", lambda t: t["tool"]), ",").alias("roles"),
        F.size(F.filter("turns", lambda t: ~t["agent_id_recorded"])).cast("long").alias("unrecorded"),
    )


_PHRASE_SQL = "SELECT item_id, array_to_string(string_split(text, ' ')[1:2], ' ') AS phrase FROM benchmark"


@query(f"""
SELECT d.doc_id, p.phrase FROM documents d JOIN (SELECT DISTINCT phrase FROM ({_PHRASE_SQL})) p
  ON contains(lower(d.text), lower(p.phrase)) AND regexp_matches(d.text, '(?i)(^|[^A-Za-z0-9_])' || regexp_escape(p.phrase))""")
def claims_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of each benchmark text as phrases, on one surface."""
    words = F.split("text", " ")
    phrase = F.array_join(F.slice(words, 1, 2), " ")
    phrases = load(spark, sf_dir, "benchmark").select(phrase.alias("phrase")).distinct().select("phrase", F.array(F.lit("why")).alias("surfaces"))
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", F.lit("why").alias("surface"))
    return claims.scan(docs, phrases).select("doc_id", "phrase")


@query("""
WITH m AS (SELECT doc_id AS path, sha256(coalesce(source, '')) AS h FROM documents), p AS (SELECT doc_id + 7 AS path, sha256(coalesce(source, '')) AS h FROM documents)
SELECT CAST(coalesce(m.path, p.path) AS VARCHAR) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN m.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM m FULL OUTER JOIN p ON m.path = p.path WHERE p.path IS NULL OR m.path IS NULL OR m.h <> p.h""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a tree, against the same tree with its paths moved by seven."""
    d = load(spark, sf_dir, "documents")
    tree = lambda moved: d.select((F.col("doc_id") + moved).cast("string").alias("path"), F.sha2(F.coalesce("source", F.lit("")).cast("binary"), 256).alias("sha256"))
    return manifest.diff(tree(0), tree(7))


@query("""
SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes,
       sha256(string_agg(sha256(text) || '  ' || path || chr(10), '' ORDER BY path)) AS digest
FROM (SELECT source, n_chars, text, CAST(doc_id AS VARCHAR) AS path FROM documents) GROUP BY source""")
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    tree = d.select("source", F.col("doc_id").cast("string").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("n_chars").alias("length"))
    return manifest.measure(tree, "source")


@query("""SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def consent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = load(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("key"))
    c = load(spark, sf_dir, "conversations").withColumn("key", F.col("conv_id"))
    return keyed.with_consent(c, allowed).select("conv_id", "turn", "role")


@query("""
SELECT user_id AS key, epoch_us(max(ts)) AS at_us FROM events WHERE event_type IN ('view', 'error') GROUP BY user_id
HAVING arg_max(event_type, (ts, event_id)) = 'view'""")
def consent_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views grant, errors revoke; the latest entry decides."""
    e = load(spark, sf_dir, "events").filter("event_type in ('view', 'error')")
    log = e.select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "view", "grant").otherwise("revoke").alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("entry_id"))
    return keyed.consented(log).select("key", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.k') AS present,
       coalesce(json_type(props, '$.k') = 'NULL', FALSE) AS is_null, json_exists(props, '$.agent_id') AS agent_present FROM events""")
def json_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("v", decode.parse(F.col("props")))
    k = decode.field(F.col("v"), "k")
    return e.select("event_id", decode.as_count(k).alias("k"), k.isNotNull().alias("present"), decode.is_null(k).alias("is_null"), decode.field(F.col("v"), "agent_id").isNotNull().alias("agent_present"))


@query("""
SELECT event_id, 's' || user_id AS session_id, '/t/' || event_id || '.jsonl' AS transcript_path, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS hook_event_name FROM events WHERE event_type <> 'signup'""")
def hook_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON records and decoded again; signups have an empty session and drop."""
    e = spread(load(spark, sf_dir, "events").select("event_id", "event_type", "user_id"))
    session = F.when(F.col("event_type") == "signup", "").otherwise(F.concat(F.lit("s"), F.col("user_id")))
    name = F.when(F.col("event_type") != "error", F.col("event_type"))
    raw = F.to_json(F.struct(session.alias("session_id"), F.concat(F.lit("/t/"), F.col("event_id"), F.lit(".jsonl")).alias("transcript_path"), name.alias("hook_event_name")))
    out = e.select("event_id", decode.sound(decode.hook_event(raw)).alias("h"))
    return out.select("event_id", "h.session_id", "h.transcript_path", "h.hook_event_name")


@query("""SELECT doc_id, octet_length(encode(text)) AS bytes, octet_length(encode(text)) AS redacted_bytes, octet_length(encode(text)) > 29 + length(CAST(octet_length(encode(text)) AS VARCHAR)) AS long_form FROM documents""")
def length_preserving_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").withColumn("r", text.redact_span(F.col("text")))
    return d.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.octet_length("r").cast("long").alias("redacted_bytes"), F.col("r").startswith("[OUT-OF-TREE: ").alias("long_form"))


_CLOSURE_SQL = """
WITH RECURSIVE r(root, node) AS (
  SELECT root, root FROM (SELECT max(p_partkey) AS root FROM part UNION ALL SELECT max(p_partkey) // 3 FROM part)
  UNION SELECT r.root, e.parent FROM r JOIN (
    SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey // 2 > 0
    UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey // 3 > 0) e ON e.child = r.node)"""


def commit_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(starts, parents): parts as commits; the parents of k are k div 2 and k div 3, so that histories merge."""
    k = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("child"))
    parents = k.select("child", F.explode(F.array(F.floor(F.col("child") / 2), F.floor(F.col("child") / 3))).alias("parent")).filter("parent > 0")
    top = k.agg(F.max("child").alias("m"))
    starts = top.select(F.posexplode(F.array(F.col("m"), F.floor(F.col("m") / 3))).alias("slot", "root"))
    return starts.select("slot", "root", F.col("root").alias("node")), parents


@query(f"{_CLOSURE_SQL} SELECT root, node FROM r")
def reachable_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.reachable(*commit_graph(spark, sf_dir))


@query(f"""{_CLOSURE_SQL},
broken AS (SELECT root, count(*) FILTER (node = (SELECT max(p_partkey) // 2 FROM part)) > 0 AS broken FROM r GROUP BY root),
c AS (SELECT DISTINCT l_partkey AS sha, CASE WHEN l_linestatus = 'O' THEN (SELECT max(p_partkey) FROM part) ELSE (SELECT max(p_partkey) // 3 FROM part) END AS ref FROM lineitem),
j AS (SELECT c.ref, c.sha, CASE WHEN r.node IS NOT NULL THEN TRUE WHEN b.broken THEN NULL ELSE FALSE END AS reachable
      FROM c JOIN broken b ON b.root = c.ref LEFT JOIN r ON r.root = c.ref AND r.node = c.sha)
SELECT ref, count(*) AS edges_held, CASE WHEN count(reachable) = count(*) THEN count(*) FILTER (reachable) END AS reachable,
       CASE WHEN count(reachable) = count(*) THEN CAST(floor(count(*) FILTER (reachable) / count(*) * 100 + 0.5) AS BIGINT) END AS percent,
       CASE WHEN count(reachable) = count(*) THEN 'coverage' ELSE 'unknown' END AS state FROM j GROUP BY ref""")
def coverage_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured commits (parts of line items, by line status) against the closure of two refs, one of which
    has a commit that isn't there: what it doesn't reach is unknown and refuses its rate."""
    starts, parents = commit_graph(spark, sf_dir)
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("sha"))
    known = part.join(part.agg(F.floor(F.max("sha") / 2).alias("sha")), "sha", "left_anti")
    refs = starts.select("slot", F.col("root").alias("ref"), F.col("node").alias("sha"))
    li = load(spark, sf_dir, "lineitem")
    edge = li.select(F.col("l_partkey").alias("sha"), mapped("l_returnflag", GRADE).alias("grade"))
    slot = F.when(F.col("l_linestatus") == "O", 0).otherwise(1)
    captured = li.select(F.col("l_partkey").alias("sha"), slot.alias("slot")).distinct().join(refs.select("slot", "ref"), "slot").drop("slot")
    met = coverage.with_reachability(captured, refs, parents, known)
    commits = met.select("ref", "sha", F.lit(True).alias("in_window"), "reachable", F.lit(None).cast("string").alias("successor"))
    return coverage.coverage(commits, edge).select("ref", "edges_held", "reachable", "percent", "state")


@query(r"""
SELECT page_id, CASE WHEN length(url) <= 24 THEN url ELSE '…' || right(url, 23) END AS left_cut,
       CASE WHEN length(url) <= 65 THEN url ELSE left(url, 64) || '…' END AS right_cut,
       substr(url, 1, 7) AS short, replace(replace(url, '/', '-'), '.', '-') AS encoded,
       substr(sha256(url), 1, 32) AS digest, 
       CASE WHEN starts_with(url, 'https://') THEN TRUE ELSE FALSE END AS allowed,
       left(CASE WHEN regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') = '' THEN '_' ELSE regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') END, 128) AS file_name FROM pages""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, url = load(spark, sf_dir, "pages"), F.col("url")
    return p.select(
        "page_id",
        text.truncate_path(url, F.lit(24)).alias("left_cut"),
        text.bound_quote(url).alias("right_cut"),
        text.short_sha(url).alias("short"),
        identity.project_dir_name(url).alias("encoded"),
        identity.repo_digest(url).alias("digest"),
        identity.is_allowed_ingest_url(url).alias("allowed"),
        identity.sanitise(url).alias("file_name"),
    )


@query("""
SELECT event_id, greatest(50, CAST(floor(greatest(0, 5000 - ms) * 0.6) AS BIGINT)) AS send_ms, least(250, CAST(floor(ms * 0.3) AS BIGINT)) AS settle_ms,
       CASE WHEN ms >= 50 THEN least(2000, ms) END AS spawn_ms FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS ms FROM events)""")
def time_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("ms"))
    ms = F.col("ms")
    return e.select("event_id", policy.send_timeout_ms(F.lit(policy.HOOK_BUDGET_MS), ms).alias("send_ms"), policy.settle_delay_ms(ms).alias("settle_ms"), policy.spawn_timeout_ms(ms, F.lit(2000)).alias("spawn_ms"))


@query("""
SELECT conv_id, turn, strftime(DATE '1970-01-01' + CAST(floor((conv_id * 3600 + turn * 600 * 60 - 36000) / 86400) AS INTEGER), '%Y-%m-%d') AS author_day,
       'Line ' || turn || ' → ' || left(sha256(CAST(conv_id AS VARCHAR)), 7) || ' · ' || role || ' (git blame)' AS identity FROM conversations""")
def blame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author-local dates (an offset of -1000, ten hours) and the identity line."""
    c = load(spark, sf_dir, "conversations")
    day = text.author_date(F.col("conv_id") * 3600 + F.col("turn") * 36000, F.lit("-1000"))
    line = text.identity_line(F.col("turn"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256), F.col("role"))
    return c.select("conv_id", "turn", day.alias("author_day"), line.alias("identity"))


@query("""
SELECT i.doc_id FROM (SELECT doc_id FROM documents) i WHERE i.doc_id NOT IN (SELECT doc_id FROM labels)""")
def import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents import their labels; what is not there is unresolved."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("bin/"), F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), F.concat(F.lit("./../lib/"), F.col("doc_id").cast("string")).alias("specifier"))
    tree = load(spark, sf_dir, "labels").select(F.concat(F.lit("lib/"), F.col("doc_id").cast("string")).alias("path"))
    return manifest.import_failures(d, tree).filter("kind = 'unresolved'").select("doc_id")


_LINKS_SQL = """SELECT page_id, regexp_extract(url, '://[^/]*/([a-z]*)', 1) AS lang, unnest(range(len(l))) AS place, unnest(l) AS word FROM (SELECT page_id, url, regexp_extract_all(html, 'href="/([^"/]*)"', 1) AS l FROM pages)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page in order: page_id, lang, place, word."""
    p = load(spark, sf_dir, "pages")
    found = F.regexp_extract_all("html", F.lit('href="/([^"/]*)"'), F.lit(1))
    return p.select("page_id", F.regexp_extract("url", "://[^/]*/([a-z]*)", 1).alias("lang"), F.posexplode(found).alias("place", "word"))


def _modules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as modules that import what they link to, and the tree of files that are there."""
    links = _links(spark, sf_dir)
    quoted = lambda before, after: F.concat(F.lit(before), F.col("word"), F.lit(after))
    kinds = (quoted('import a from "./', '.js";'), quoted('await import( "../', '.js" );'), quoted('export * from "', '";'), quoted('from "../.././../', '.js"'), quoted('import fs from "node:', '";'))
    line = F.element_at(F.array(*kinds), F.col("place") % 5 + 1)
    path = F.concat("lang", F.lit("/"), F.col("page_id").cast("string"), F.lit(".js"))
    text_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n")
    modules = links.groupBy(path.alias("path")).agg(text_.alias("text"))
    here = links.filter(F.length("word") % 2 == 0).select(F.concat("lang", F.lit("/"), "word", F.lit(".js")).alias("path"))
    above = links.filter(F.length("word") % 3 == 0).select(quoted("", ".js").alias("path"))
    return modules, here.unionByName(above)


@query(f"""
WITH l AS ({_LINKS_SQL}), t AS (SELECT DISTINCT lang || '/' || word || '.js' AS target FROM l WHERE length(word) % 2 = 0 UNION SELECT word || '.js' FROM l WHERE length(word) % 3 = 0),
i AS (SELECT page_id, place, CASE place % 5 WHEN 0 THEN lang || '/' || word || '.js' WHEN 1 THEN word || '.js' WHEN 3 THEN '../../' || word || '.js' END AS target FROM l WHERE place % 5 <> 4 AND (place % 5 <> 2 OR word <> '')),
k AS (SELECT i.*, CASE WHEN target IS NULL THEN 'bare' WHEN starts_with(target, '..') THEN 'escaping' WHEN t.target IS NULL THEN 'unresolved' END AS kind FROM (SELECT page_id, place, i.target FROM i) i LEFT JOIN t USING (target))
SELECT page_id, kind, target, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL""")
def import_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports found in modules' text that leave what is shipped, leave the tree, or find nothing there."""
    modules, tree = _modules(spark, sf_dir)
    found = manifest.import_failures(manifest.imports_of(modules), tree)
    page = F.regexp_extract("path", "([0-9]+)[.]js$", 1).cast("long")
    return found.groupBy(page.alias("page_id"), "kind", "target").agg(F.count("*").alias("n"))


@query(f"""
WITH RECURSIVE l AS ({_LINKS_SQL}), e AS (SELECT DISTINCT a.word AS a, b.word AS b FROM l a JOIN l b ON a.page_id = b.page_id AND b.place = a.place + 1),
r(root, node) AS (SELECT DISTINCT lang, word FROM l WHERE place = 0 UNION SELECT root, b FROM r JOIN e ON a = node)
SELECT root, node FROM r""")
def link_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each language's first links, every link that follows another on some page: a graph full of cycles."""
    links = _links(spark, sf_dir)
    edges = links.select("page_id", "place", F.col("word").alias("child")).join(links.select("page_id", (F.col("place") - 1).alias("place"), F.col("word").alias("parent")), ["page_id", "place"])
    return coverage.reachable(links.filter("place = 0").select(F.col("lang").alias("root"), F.col("word").alias("node")), edges)


@query("""
SELECT to_json({schema: 1, verb: 'report', outcome: 'coverage', l_orderkey: l_orderkey, l_linenumber: l_linenumber, l_returnflag: CASE WHEN l_linestatus = 'O' THEN l_returnflag END, l_partkey: l_partkey}) AS value FROM lineitem""")
def machine_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as one-line documents; what is absent is written as null."""
    li = load(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("l_returnflag"), "l_partkey")
    return delivery.machine_documents(rows, "report", "coverage")


@query(r"""
SELECT conv_id, turn, coalesce(list_reduce(list_prepend('', list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')),
  lambda a, w: CASE WHEN a = '' THEN '  ' || w WHEN length(regexp_extract(a, '[^\n]*$')) + 1 + length(w) > 80 THEN a || chr(10) || '  ' || w ELSE a || ' ' || w END), '') AS lines FROM conversations""")
def wrapped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts wrapped to the screen, the lines joined."""
    c = load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(text.wrap(F.col("text"), 2), "\n").alias("lines"))


from provenir.plans import logs, records  # noqa: E402, F401  registers the queries over records and files
