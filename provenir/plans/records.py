"""Queries over records, files and scalars: what the parsers, readers and policies make of
the driver's tables written in the wire's own forms, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenir.functions import decode, identity, policy, redaction, text
from provenir.operators import attribution, keyed, ledger, manifest, patches
from provenir.plans.registry import query
from provenir.plans.standins import load, mapped, spread
from provenir.runtime import materialize, shared_dir
from provenir.sources import files, git_tables
from provenir.streaming import delivery


def _raw(*parts: Column | str) -> Column:
    """JSON text from literal pieces and columns."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _written(rows: DataFrame, value: Column) -> str:
    """A folder of text files with one line a row, below the shared folder."""
    path = f"{shared_dir(rows.sparkSession)}/lines-{uuid.uuid4().hex}"
    rows.select(value.alias("value")).write.text(path)
    return path


# records of the capture client

_SPOOL_SQL = """
SELECT sha256(CAST(event_id AS VARCHAR)) AS sha, CASE WHEN event_type <> 'view' THEN event_type END AS branch, CAST(event_id AS VARCHAR) AS at, 'f' || user_id || ',g' AS files
FROM events WHERE event_type <> 'signup'"""


def _spool_line() -> Column:
    sha = F.when(F.col("event_type") == "signup", "none").otherwise(F.sha2(F.col("event_id").cast("string").cast("binary"), 256))
    branch = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    return _raw('{"sha":"', sha, '","branch":"', branch, '","at":"', F.col("event_id"), '","files":["f', F.col("user_id"), '",7,null,"g"]}')


@query(_SPOOL_SQL)
def spool_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observed commits; a sign-up's id is no sha, and files that are no strings go."""
    e = spread(load(spark, sf_dir, "events").select("event_id", "event_type", "user_id")).select(decode.sound(decode.spool_entry(_spool_line())).alias("e"))
    return e.select("e.sha", "e.branch", "e.at", F.array_join("e.files", ",").alias("files"))


@query(_SPOOL_SQL)
def spool_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines written as spool files and read back."""
    path = _written(load(spark, sf_dir, "events"), _spool_line())
    return files.spool(spark, path).select("sha", "branch", "at", F.array_join("files", ",").alias("files"))


@query("""
SELECT o_orderkey, CASE WHEN good THEN o_custkey ELSE 0 END AS seq, CASE WHEN good AND o_orderkey % 3 <> 0 THEN 'f' || o_orderkey END AS fingerprint,
       CASE WHEN good THEN o_orderkey END AS sent, CASE WHEN NOT good THEN 0 WHEN o_orderkey % 2 = 0 THEN 3 ELSE 1 END AS entries,
       CASE WHEN NOT good THEN 0 WHEN o_orderkey % 2 = 0 THEN 30 ELSE 5 END AS pending, CASE WHEN good THEN 0 END AS gap_bytes, CASE WHEN good THEN 2 END AS gap_count, CASE WHEN good THEN o_custkey END AS last_sent
FROM (SELECT *, o_orderkey % 11 <> 0 AS good FROM orders)""")
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as state files: held spans are cut where they don't continue, a broken file is the empty state."""
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    stop = F.when(k % 3 == 0, "null").otherwise(_raw('{"at":"t","fingerprint":"f', k, '"}'))
    spans = _raw('[{"from":', k, ',"to":', k + 5, ',"at":1},{"from":', k + 5 + k % 2, ',"to":', k + 20, ',"at":2},{"from":', k + 20, ',"to":', k + 30, ',"at":3}]')
    main = _raw('{"sentOffset":', k, ',"backlog":', spans, ',"gapBytes":-3,"gapCount":2.7,"lastSentAt":', n, "}")
    raw = F.when(k % 11 == 0, '{"seq":').otherwise(_raw('{"seq":', n, ',"stop":', stop, ',"files":{"main":', main, ',"odd":7}}'))
    s = spread(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select("o_orderkey", decode.session_state(raw).alias("s")).withColumn("f", F.try_element_at("s.files", F.lit("main")))
    entries = F.when(F.col("f.backlog").isNotNull(), F.size("f.backlog")).otherwise(0).cast("long")
    pending = F.when(entries > 0, policy.pending_bytes(F.col("f.backlog"))).otherwise(0).cast("long")
    return s.select("o_orderkey", "s.seq", F.col("s.stop.fingerprint").alias("fingerprint"), F.col("f.sent_offset").alias("sent"), entries.alias("entries"), pending.alias("pending"), "f.gap_bytes", "f.gap_count", F.col("f.last_sent_at_ms").alias("last_sent"))


@query("""
SELECT p_partkey, 'r' || p_partkey AS ref, p_partkey AS edges_held, CAST(p_size AS BIGINT) AS derived, CAST(1 AS BIGINT) AS observed, CAST(2 AS BIGINT) AS shas, CAST(2 AS BIGINT) AS exact_successors, CAST(p_size AS BIGINT) AS probable
FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 13 <> 0""")
def coverage_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as coverage answers; a grade outside the set, a count in quotes or an empty sha refuses the whole answer."""
    k, n = F.col("p_partkey"), F.col("p_size")
    grade = F.when(k % 5 == 0, "guessed").otherwise("observed")
    held = F.when(k % 7 == 0, _raw('"', k, '"')).otherwise(k.cast("string"))
    second = F.when(k % 13 == 0, " ").otherwise("b")
    raw = _raw('{"ref":"r', k, '","edges_held":', held, ',"captured_shas":["a","', second, '"],"by_grade":{"derived":', n, ',"', grade, '":1.0},"exact_successors":2,"probable_line":{"count":', n, "}}")
    c = spread(load(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", decode.sound(decode.coverage_payload(raw)).alias("c"))
    grade_of = lambda g: F.try_element_at("c.by_grade", F.lit(g)).alias(g)
    return c.select("p_partkey", "c.ref", "c.edges_held", grade_of("derived"), grade_of("observed"), F.size("c.captured_shas").cast("long").alias("shas"), "c.exact_successors", F.col("c.probable_count").alias("probable"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'turns' WHEN 'F' THEN 'no_edge' ELSE 'squash_resolved' END AS state,
       CASE WHEN o_orderstatus <> 'F' THEN 's' || o_orderkey END AS recorded_sha, CASE WHEN o_orderstatus = 'P' THEN 'probable' END AS match_kind,
       CASE WHEN o_orderstatus = 'O' THEN 'declared' END AS floor, CAST(CASE WHEN o_orderstatus = 'O' THEN 3 END AS BIGINT) AS turns, CAST(CASE WHEN o_orderstatus = 'O' THEN 2 END AS BIGINT) AS recorded,
       CASE WHEN o_orderstatus = 'O' THEN o_orderkey END AS total, CAST(CASE WHEN o_orderstatus = 'O' THEN o_custkey % 3 END AS BIGINT) AS missing
FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderkey % 2 = 0) AND NOT (o_orderstatus = 'O' AND o_orderkey < 3)""")
def blame_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers for blamed commits; a rewritten one must say how it was matched."""
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    state = F.when(F.col("o_orderstatus") == "O", "turns").when(F.col("o_orderstatus") == "F", "no_edge").otherwise("squash_resolved")
    match = F.when((F.col("o_orderstatus") == "P") & (k % 2 == 1), '"probable"').otherwise("null")
    turns = '[{"position":1,"tool":"Edit","files":["f"],"excerpt":["q"],"agent_id":null},{"position":2,"files":null,"agent_id":"a"},{"position":3,"files":[]}]'
    raw = _raw('{"state":"', state, '","match_kind":', match, ',"recorded_sha":"s', k, '","grades":["derived","declared"],"turns":' + turns + ',"window":{"first":1,"last":3,"total":', k, '},"files_without_turn":', n % 3, "}")
    b = spread(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")).select("o_orderkey", decode.sound(decode.blame_payload(raw)).alias("b"))
    count = lambda c: F.when(F.col("b.turns").isNotNull(), F.size(c)).cast("long")
    return b.select(
        "o_orderkey",
        "b.state",
        "b.recorded_sha",
        "b.match_kind",
        text.grade_floor(F.col("b.grades")).alias("floor"),
        count(F.col("b.turns")).alias("turns"),
        count(F.filter("b.turns", lambda t: t["agent_id_recorded"])).alias("recorded"),
        F.col("b.window.total").alias("total"),
        F.col("b.files_without_turn").alias("missing"),
    )


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'unreachable' WHEN 'signup' THEN 'unauthorized' WHEN 'error' THEN 'rpc-error' ELSE 'ok' END AS kind,
       CASE event_type WHEN 'view' THEN '{"a":' || user_id || '}' WHEN 'purchase' THEN '[]' END AS answer, CASE event_type WHEN 'view' THEN FALSE WHEN 'purchase' THEN TRUE END AS is_error,
       CAST(CASE event_type WHEN 'error' THEN -32000 - user_id END AS BIGINT) AS code, CASE event_type WHEN 'error' THEN 'no' END AS message FROM events""")
def tool_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(load(spark, sf_dir, "events").select("event_id", "event_type", "user_id"))
    status = mapped("event_type", {"view": 200, "purchase": 200, "signup": 401, "error": 200})
    ok = _raw('{"result":{"content":[{"type":"text","text":"{\\"a\\":', F.col("user_id"), '}"}],"isError":false}}')
    failed = _raw('{"error":{"code":', -32000 - F.col("user_id"), ',"message":"no"}}')
    body = F.when(F.col("event_type") == "view", ok).when(F.col("event_type") == "error", failed).otherwise('{"result":{"content":[{"text":"[]"}],"isError":true}}')
    a = e.select("event_id", decode.tool_answer(status, body).alias("a"))
    return a.select("event_id", "a.kind", F.col("a.text").alias("answer"), "a.is_error", "a.code", "a.message")


@query("""
SELECT event_id, CASE event_type WHEN 'view' THEN 'owner_pending' WHEN 'purchase' THEN 'other' END AS code, CASE event_type WHEN 'view' THEN user_id END AS owners,
       CASE WHEN event_type IN ('view', 'purchase') THEN event_type = 'view' END AS recorded, event_type = 'view' AS pending FROM events""")
def error_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of error bodies, nested or not; a long or broken body says nothing."""
    body = F.when(F.col("event_type") == "view", _raw('{"error":{"code":"owner_pending","owners_notified":', F.col("user_id"), "}}"))
    body = body.when(F.col("event_type") == "purchase", '{"code":"other"}').when(F.col("event_type") == "click", _raw('{"code":"', F.repeat(F.lit("x"), F.lit(70_000)), '"}')).otherwise("<html>")
    d = spread(load(spark, sf_dir, "events").select("event_id", "event_type", "user_id")).select("event_id", decode.error_detail(body).alias("d"))
    return d.select("event_id", "d.code", F.col("d.owners_notified").alias("owners"), F.col("d.owners_recorded").alias("recorded"), decode.approval_pending(F.col("d"), "owner_pending").alias("pending"))


@query("""
SELECT conv_id, turn, left(sha256(CAST(conv_id AS VARCHAR)), 40) AS sha, CAST(turn AS BIGINT) AS line, conv_id * 3600 AS epoch, '-1000' AS tz FROM conversations WHERE role <> 'system'""")
def blame_porcelain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as blamed lines; a line that isn't committed yet has the zero sha and goes."""
    sha = F.when(F.col("role") == "system", "0" * 40).otherwise(F.left(F.sha2(F.col("conv_id").cast("string").cast("binary"), 256), F.lit(40)))
    out = _raw(sha, " 7 ", F.col("turn"), " 1\nauthor A B\nauthor-mail <a@b>\nauthor-time ", F.col("conv_id") * 3600, "\nauthor-tz -1000\nsummary author-time 5\nfilename f\n\tcode")
    b = load(spark, sf_dir, "conversations").select("conv_id", "turn", decode.sound(decode.blame_porcelain(out)).alias("b"))
    return b.select("conv_id", "turn", "b.sha", "b.line", "b.epoch", F.col("b.offset").alias("tz"))


# files and listings


@query("""
SELECT CAST(event_id AS VARCHAR) AS sha, event_type || CASE WHEN event_id % 2 = 0 THEN chr(9) || 'more' ELSE '' END AS subject, strftime(ts, '%Y-%m-%d') AS author_date FROM events WHERE event_type <> 'error'""")
def recent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines whose subjects may hold tabs; a line of too few fields is no commit."""
    e = load(spark, sf_dir, "events")
    subject = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "\tmore").otherwise(""))
    line = F.when(F.col("event_type") == "error", F.col("event_id").cast("string")).otherwise(F.concat_ws("\t", F.col("event_id").cast("string"), subject, text.utc_day(F.col("ts"))))
    return files.recent_log(spark, _written(e, line))


def _listing(spark: SparkSession, sf_dir: str, path: Column) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    size = F.when(F.col("doc_id") % 5 == 0, 0).otherwise(F.col("n_chars"))
    return d.select(path.alias("path"), F.timestamp_seconds(F.col("doc_id") % 50).alias("modificationTime"), size.cast("long").alias("length"))


@query("""
SELECT '/t/' || source AS folder, first(path ORDER BY doc_id % 50 DESC, path) AS path FROM (SELECT *, '/t/' || source || '/' || doc_id || '.jsonl' AS path FROM documents)
WHERE doc_id % 5 <> 0 AND n_chars > 0 AND source IS NOT NULL GROUP BY source""")
def current_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcripts of their sources: the newest that isn't empty."""
    path = _raw("/t/", F.col("source"), "/", F.col("doc_id"), ".jsonl")
    return files.current_transcript(_listing(spark, sf_dir, path).filter("path is not null")).select("folder", "path")


@query("""
SELECT path, 'agent-' || doc_id AS file_key FROM (SELECT *, '/t/' || source || '/subagents/agent-' || doc_id || '.jsonl' AS path FROM documents)
WHERE doc_id % 5 <> 0 AND n_chars > 0 AND doc_id % 3 <> 0 AND source = 'src1'""")
def subagent_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-agent files inside one session's folder; other names and other folders go."""
    name = F.when(F.col("doc_id") % 3 == 0, "notes-").otherwise("agent-")
    path = _raw("/t/", F.col("source"), "/subagents/", name, F.col("doc_id"), ".jsonl")
    return files.subagents_of(_listing(spark, sf_dir, path), F.lit("/t/src1")).select("path", "file_key")


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '')) AS sha256 FROM documents""")
def manifest_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written and read back."""
    d = load(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    git_tables.write_manifest(d.select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256")), path)
    return git_tables.read_manifest(spark, path)


# git exports


@query("""SELECT o_custkey AS repo, o_orderkey AS sha, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS branch FROM orders WHERE o_orderstatus = 'O'""")
def branch_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders as heads; odd ones are detached."""
    o = load(spark, sf_dir, "orders")
    refs = o.select(F.col("o_custkey").alias("repo"), F.col("o_orderpriority").alias("ref"), F.col("o_orderkey").alias("sha"), (F.col("o_orderstatus") == "O").alias("is_head"), (F.col("o_orderkey") % 2 == 0).alias("is_branch"))
    return git_tables.heads(refs)


@query("""
SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN 'own/r' || c_custkey WHEN 1 THEN 'code.example.org/own/r' || c_custkey WHEN 2 THEN 'local:' || left(sha256('/p/' || c_custkey), 12) ELSE 'h' || (c_custkey % 10) || '/own/r' || c_custkey END AS repo_slug,
       c_custkey % 3 = 1 AS complete FROM customer""")
def repository_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as clones behind ssh aliases; whether a clone is shallow is unknown for a third."""
    k = F.col("c_custkey")
    remote = F.when(k % 10 != 2, _raw("git@h", k % 10, ":own/r", k, ".git"))
    repos = load(spark, sf_dir, "customer").select("c_custkey", _raw("/p/", k).alias("path"), remote.alias("remote"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("shallow"))
    aliases = spark.range(2).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("alias"), F.when(F.col("id") == 0, "github.com").otherwise("code.example.org").alias("hostname"))
    return git_tables.repositories(repos, aliases).select("c_custkey", "repo_slug", "complete")


_PARTS_SQL = """
WITH RECURSIVE r(node) AS (SELECT max(p_partkey) FROM part UNION SELECT e.parent FROM r JOIN (
    SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey // 2 > 0
    UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey // 3 > 0) e ON e.child = r.node)"""


@query(f"{_PARTS_SQL} SELECT 'main' AS ref, CAST(node AS VARCHAR) AS sha FROM r JOIN part ON p_partkey = node WHERE p_size >= 20")
def window_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as commits dated by their size: those on the ref of the greatest part since day 20."""
    part = load(spark, sf_dir, "part")
    k, repo = F.col("p_partkey"), F.lit("r").alias("repo")
    commits = part.select(repo, k.cast("string").alias("sha"), F.timestamp_seconds(F.col("p_size") * 86400).alias("committed_at"))
    parents = part.select(repo, k.cast("string").alias("child"), F.explode(F.array(F.floor(k / 2), F.floor(k / 3))).alias("parent")).filter("parent > 0")
    refs = part.agg(F.max("p_partkey").cast("string").alias("sha")).select(repo, F.lit("main").alias("ref"), "sha")
    return git_tables.window_commits(commits, parents.withColumn("parent", F.col("parent").cast("string")), refs, "1970-01-21").select("ref", "sha")


def _touched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, repo = load(spark, sf_dir, "orders"), F.lit("r").alias("repo")
    touched = load(spark, sf_dir, "lineitem").select(repo, F.col("l_orderkey").alias("sha"), F.col("l_partkey").cast("string").alias("path"))
    second = F.when(F.col("o_orderstatus") == "P", F.array(F.col("o_orderkey") - 1, F.col("o_orderkey") - 2)).otherwise(F.array(F.col("o_orderkey") - 1))
    return touched, o.select(repo, F.col("o_orderkey").alias("child"), F.explode(second).alias("parent"))


@query("""
SELECT l_orderkey AS sha, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS files FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as touched files; orders in progress are merges and touch none."""
    return git_tables.changed_files(*_touched(spark, sf_dir)).select("sha", F.array_join("files", ",").alias("files"))


@query("""
SELECT o_orderkey AS sha, o_custkey AS session_id, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) END AS files
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey % 2 = 1""")
def observed_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits with consent and a live session; others leave no trace."""
    o = load(spark, sf_dir, "orders").withColumn("repo", F.col("o_orderpriority"))
    touched, parents = _touched(spark, sf_dir)
    changed = git_tables.changed_files(touched, parents).join(o.select(F.col("o_orderkey").alias("sha"), F.col("repo").alias("own")), "sha").select(F.col("own").alias("repo"), "sha", "files")
    commits = o.select("repo", F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("committed_at"))
    sessions = o.select("repo", F.col("o_orderkey").alias("sha"), F.when(F.col("o_custkey") % 2 == 1, F.col("o_custkey")).alias("session_id"))
    allowed = o.filter(F.col("repo").isin("1-URGENT", "2-HIGH")).select("repo").distinct()
    return git_tables.observed(commits, changed, sessions, allowed).select("sha", "session_id", F.size("files").cast("long").alias("files"))


@query("""
SELECT o_orderpriority AS repo, o_orderkey AS new_sha, old_sha, 'probable' AS match_kind FROM (
  SELECT *, first_value(o_orderkey) OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate, o_orderkey) AS old_sha FROM orders WHERE o_orderstatus <> 'P') WHERE old_sha <> o_orderkey""")
def patch_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits whose patch id is the customer; an order in progress has none."""
    o = load(spark, sf_dir, "orders")
    patch = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    return attribution.same_patch(o.select(F.col("o_orderpriority").alias("repo"), F.col("o_orderkey").alias("sha"), patch.alias("patch_id"), F.col("o_orderdate").alias("committed_at")))


@query()
def patch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as revisions of files, 64 neighbouring ids of a source each: every one's change of the
    one before, over whole texts.  A shortest edit script is beyond SQL; a test compares all rows with a plain one."""
    d = load(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("f"), F.floor(F.col("doc_id") / 64).cast("string")))
    before = F.lag("text").over(Window.partitionBy("source", "path").orderBy("doc_id"))
    revisions = d.select(F.col("source").alias("repo"), F.col("doc_id").alias("sha"), "path", before.alias("before"), F.col("text").alias("after"))
    return patches.patch_ids(revisions)


@query("""
SELECT doc_id AS sha, CAST(1 AS BIGINT) AS hunks, CAST(0 AS BIGINT) AS removed, CAST(1 AS BIGINT) AS added, nullif(min(doc_id) OVER (PARTITION BY source, doc_id % 5), doc_id) AS old_sha
FROM documents WHERE source IS NOT NULL""")
def patch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same line put in front of or behind whole texts is one patch, wherever it lies."""
    d = load(spark, sf_dir, "documents").filter("source is not null")
    text_, note = F.coalesce("text", F.lit("")), F.concat(F.lit("note "), (F.col("doc_id") % 5).cast("string"))
    behind = F.concat(text_, F.when((text_ == "") | text_.endswith("\n"), "").otherwise("\n"), note)
    after = F.when(F.col("doc_id") % 2 == 0, F.concat(note, F.lit("\n"), text_)).otherwise(behind)
    ids = patches.patch_ids(d.select(F.col("source").alias("repo"), F.col("doc_id").alias("sha"), F.lit("f").alias("path"), text_.alias("before"), after.alias("after")))
    ids = materialize(ids, "patches")
    found = attribution.same_patch(ids.withColumn("committed_at", F.col("sha"))).select("repo", F.col("new_sha").alias("sha"), "old_sha")
    return ids.join(found, ["repo", "sha"], "left").select("sha", "hunks", "removed", "added", "old_sha")


@query("""
SELECT l_orderkey AS sha, l_linenumber AS line, CASE WHEN o_orderstatus <> 'O' THEN o_orderkey + 1 END AS recorded_sha, CASE o_orderstatus WHEN 'P' THEN 'exact' WHEN 'F' THEN 'probable' END AS match_kind
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def successor_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blamed lines whose commit was rewritten; exact and probable successors stay apart."""
    o = load(spark, sf_dir, "orders").filter("o_orderstatus != 'O'")
    kind = F.when(F.col("o_orderstatus") == "P", "exact").otherwise("probable")
    blamed = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_linenumber").alias("line"))
    return attribution.with_recorded_commit(blamed, o.select(F.col("o_orderkey").alias("new_sha"), (F.col("o_orderkey") + 1).alias("old_sha"), kind.alias("match_kind"))).select("sha", "line", "recorded_sha", "match_kind")


@query("""
WITH m AS (SELECT l_orderkey AS sha, count(DISTINCT l_partkey) - count(DISTINCT CASE WHEN l_partkey IN (SELECT t.l_partkey FROM lineitem t WHERE t.l_orderkey = lineitem.l_orderkey AND t.l_returnflag = 'R') THEN l_partkey END) AS missing FROM lineitem GROUP BY 1)
SELECT sha, missing, missing || CASE WHEN missing = 1 THEN ' more file in this commit has no linked turn.' ELSE ' more files in this commit have no linked turn.' END AS sentence FROM m WHERE missing > 0""")
def files_without_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as touched files; returned ones have a turn."""
    li = load(spark, sf_dir, "lineitem").select(F.lit("r").alias("repo"), F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("file"), "l_returnflag")
    out = attribution.files_without_turn(li, li.filter("l_returnflag = 'R'"))
    return out.select("sha", "missing", text.files_without_turn(F.col("missing")).alias("sentence"))


@query("""
SELECT p_partkey AS bundle, p_partkey % 2 = 1 AS content_moved, p_partkey % 3 = 1 AS commit_moved, p_partkey % 5 <> 0 AND p_partkey % 2 = 1 AS digest_moved,
       (p_partkey % 2 = 1) <> (p_partkey % 5 <> 0 AND p_partkey % 2 = 1) OR (p_partkey % 2 = 1) <> (p_partkey % 3 = 1) AS drifted FROM part""")
def bundle_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as bundles of two moments; content, commit and digest must move together."""
    k = F.col("p_partkey")
    tree = lambda c, v, d: load(spark, sf_dir, "part").select(k.alias("bundle"), c.alias("content"), v.alias("commit"), d.alias("digest"))
    same = F.col("p_size")
    moved = F.when(k % 2 == 1, same + 1).otherwise(same)
    after = tree(moved, F.when(k % 3 == 1, same + 1).otherwise(same), F.when(k % 5 != 0, moved).otherwise(same))
    return manifest.drift(tree(same, same, same), after)


@query("""
SELECT doc_id AS path, line_no, line FROM (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE contains(line, 'Licensed')""")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that hold a needle."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return manifest.mentions(d.withColumn("line_no", F.col("line_no").cast("long")), "Licensed")


@query("""
WITH l AS (SELECT doc_id AS path, line_no, CASE WHEN line_no = 0 THEN line || ' x' || left(sha256(CAST(doc_id % 1000 AS VARCHAR)), 20) ELSE line END AS line
  FROM (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
p AS (SELECT DISTINCT left(sha256(CAST(doc_id AS VARCHAR)), 40) AS sha FROM labels)
SELECT path, line_no, md5(line) AS line, sha FROM l JOIN p ON contains(line, left(sha, 7))""")
def pinned_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of whole documents that hold one of many pinned ids; a label's row pins the id of its document."""
    sha = lambda c: F.sha2(c.cast("string").cast("binary"), 256)
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    held = F.when(F.col("line_no") == 0, F.concat("line", F.lit(" x"), F.left(sha(F.col("path") % 1000), F.lit(20)))).otherwise(F.col("line"))
    lines = d.select("path", F.col("line_no").cast("long").alias("line_no"), held.alias("line"))
    pins = load(spark, sf_dir, "labels").select(F.left(sha(F.col("doc_id")), F.lit(40)).alias("sha"))
    return manifest.pinned_mentions(lines, pins).withColumn("line", F.md5("line"))


_SSH_CONFIG = """
Host *.example.net !m.* !www.*
  HostName %h.mirror.test
Host m.*
  User git
  HostName mobile.test
host = "????????.example.???"
  hostname eight.test
Match exec "true"
  HostName never.test
Host www.* *.org
  HostName bad_name!
Host *
  HostName late.test
"""


@query(r"""
SELECT page_id, host, CASE WHEN hostname = 'bad_name!' THEN host ELSE hostname END || '/o/p' || page_id AS repo_slug FROM (
  SELECT *, CASE WHEN regexp_matches(host, '^.*\.example\.net$') AND NOT regexp_matches(host, '^(m|www)\.') THEN host || '.mirror.test' WHEN starts_with(host, 'm.') THEN 'mobile.test'
    WHEN regexp_matches(host, '^.{8}\.example\..{3}$') THEN 'eight.test' WHEN starts_with(host, 'www.') OR regexp_matches(host, '\.org$') THEN 'bad_name!' ELSE 'late.test' END AS hostname
  FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages))""")
def host_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages as ssh hosts, looked up in a client's ordered patterns; a name that is none leaves the host."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    rows = load(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.concat(F.lit("git@"), host, F.lit(":o/p"), F.col("page_id").cast("string"), F.lit(".git")).alias("remote"), F.lit("/x").alias("path"))
    return identity.with_repo_slug(rows, rules=identity.ssh_rules(_SSH_CONFIG)).select("page_id", "host", "repo_slug")


@query("""
SELECT doc_id, TRUE AS same_length, CAST(34 + CASE WHEN doc_id % 3 = 0 THEN 23 ELSE 0 END AS BIGINT) AS withheld,
  md5(coalesce(text, '') || ' in /work/r' || doc_id % 7 || '/a.py, [OUT-OF-TREE]............ and ' || CASE WHEN doc_id % 3 = 0 THEN '[OUT-OF-TREE]..........' ELSE 'src/lib/x.py' END || ' https://h/a/b .........') AS text
FROM documents""")
def structural_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in JSON records: paths outside the record's tree go, all else stays byte for byte."""
    d = load(spark, sf_dir, "documents")
    tail = F.concat(F.lit(" in /work/r"), (F.col("doc_id") % 7).cast("string"), F.lit("/a.py, /home/someone/.ssh/config and "), F.when(F.col("doc_id") % 3 == 0, "/work/r99/../secret.key").otherwise("src/lib/x.py"), F.lit(" https://h/a/b /etc/pass"))
    raw = F.to_json(F.struct(F.col("doc_id"), F.concat(F.coalesce("text", F.lit("")), tail).alias("text"), F.lit("line\nbreak").alias("note")))
    rows = d.select("doc_id", raw.alias("raw"), F.octet_length(raw).alias("size"), F.concat(F.lit("/work/r"), (F.col("doc_id") % 7).cast("string")).alias("root"))
    out = redaction.redact_records(rows, "raw", "root")
    text_ = F.get_json_object("raw", "$.text")
    return out.select("doc_id", (F.octet_length("raw") == F.col("size")).alias("same_length"), "withheld", F.md5(text_).alias("text"))


# deliveries


@query("""
SELECT user_id AS session, event_id AS seq, event_id * 10 AS from_off, 'main' AS file, 'o/r' AS repo_slug, '1.0' AS client_version, CASE WHEN event_type <> 'view' THEN event_type END AS head_sha,
       CASE WHEN user_id % 2 = 1 THEN 'b' || user_id END AS branch, CASE event_type WHEN 'click' THEN NULL ELSE event_id || ',' || user_id END AS shas FROM events""")
def delivery_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is absent stays null and is never an empty header."""
    e = load(spark, sf_dir, "events")
    shas = F.when(F.col("event_type") == "click", F.array().cast("array<string>")).otherwise(F.array(F.col("event_id").cast("string"), F.col("user_id").cast("string")))
    branch = F.when(F.col("user_id") % 2 == 1, F.concat(F.lit("b"), F.col("user_id").cast("string"))).otherwise("")
    head = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    sent = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") * 10).alias("offset"), F.lit("main").alias("file"), F.lit("o/r").alias("repo_slug"), F.lit("1.0").alias("client_version"), head.alias("head_sha"), branch.alias("branch"), shas.alias("shas"))
    return delivery.header_rows(sent).withColumnRenamed("offset", "from_off")


@query("""SELECT conv_id, turn FROM conversations LEFT JOIN (SELECT doc_id, min(quality) * 2 AS consumed FROM labels GROUP BY 1) ON doc_id = conv_id WHERE turn >= coalesce(consumed, 0)""")
def unsent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as spool lines; labels say how many were consumed."""
    done = load(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("conv_id")).agg((F.min("quality") * 2).alias("consumed"))
    return keyed.unsent(load(spark, sf_dir, "conversations").select("conv_id", "turn"), done, ["conv_id"], "turn")


@query("""
SELECT session, file, event_id, shas FROM (
  SELECT user_id AS session, 'main' AS file, event_id, CAST(event_id AS VARCHAR) AS shas FROM events WHERE event_type = 'view'
  UNION ALL SELECT user_id, 'agent-' || event_type, event_id, NULL FROM events WHERE event_type <> 'view')""")
def united_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as main deliveries, all other events as sub-agents'; commits go with the main one only."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.when(F.col("event_type") == "view", "main").otherwise(F.concat(F.lit("agent-"), F.col("event_type"))).alias("file"), "event_id", F.array(F.col("event_id").cast("string")).alias("shas"))
    out = ledger.all_deliveries(e.filter("file = 'main'"), e.filter("file != 'main'"))
    return out.select("session", "file", "event_id", F.when(F.col("shas").isNotNull(), F.array_join("shas", ",")).alias("shas"))


_PENDING_SQL = """
  SELECT source AS session, doc_id AS file, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, 300 + n_chars % 900 AS cost_ms FROM documents WHERE n_chars > 0"""


@query(f"""
SELECT session, file, place, left_ms FROM (
  SELECT *, CAST(5000 - coalesce(sum(cost_ms) OVER (PARTITION BY session ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_ms FROM ({_PENDING_SQL}) WHERE place <= 8)
WHERE left_ms >= 400""")
def started_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files that were never sent, oldest first, within one budget a session."""
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("session"), F.col("doc_id").alias("file"), F.col("n_chars").alias("size"))
    nothing = d.select("session", "file", F.lit(0).alias("sent")).filter("false")
    pending = ledger.pending_files(d.select("session", "file", F.col("file").alias("mtime"), "size"), nothing)
    out = ledger.started_files(pending.withColumn("cost_ms", 300 + F.col("size") % 900), policy.HOOK_BUDGET_MS)
    return out.select("session", "file", F.col("place").cast("long").alias("place"), "left_ms")


@query("""
WITH f AS (SELECT source AS session, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY source) THEN 'main' ELSE 'agent-' || doc_id END AS file, n_chars AS size, doc_id FROM documents WHERE source IS NOT NULL),
l AS (SELECT f.*, f.session IN ('src1', 'src3', 'src5') AS ended, x.doc_id IS NOT NULL AS known FROM f LEFT JOIN (SELECT DISTINCT doc_id FROM labels) x USING (doc_id))
SELECT session, file, CASE WHEN ended AND file <> 'main' AND size > (CASE WHEN known THEN size // 2 ELSE 0 END) THEN size WHEN known THEN size // 2 ELSE 0 END AS sent,
       CASE WHEN ended AND file <> 'main' THEN size - (CASE WHEN known THEN size // 2 ELSE 0 END) ELSE 0 END AS gap_bytes,
       CAST(CASE WHEN ended AND file <> 'main' AND size > (CASE WHEN known THEN size // 2 ELSE 0 END) THEN 1 ELSE 0 END AS BIGINT) AS gap_count FROM l WHERE ended OR known""")
def session_end_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, labels as what the ledger knows (half of each was sent); three sources end."""
    d = load(spark, sf_dir, "documents").filter("source is not null")
    least = d.groupBy("source").agg(F.min("doc_id").alias("least"))
    name = F.when(F.col("doc_id") == F.col("least"), "main").otherwise(F.concat(F.lit("agent-"), F.col("doc_id").cast("string")))
    f = d.join(least, "source").select("doc_id", F.col("source").alias("session"), name.alias("file"), F.col("n_chars").alias("size"))
    known = load(spark, sf_dir, "labels").select("doc_id").distinct()
    held = f.join(known, "doc_id").select("session", "file", F.floor(F.col("size") / 2).alias("sent"), F.lit(0).alias("gap_bytes"), F.lit(0).alias("gap_count"))
    ended = d.filter(F.col("source").isin("src1", "src3", "src5")).select(F.col("source").alias("session"))
    return ledger.session_end_gaps(held, f, ended)


@query("""SELECT conv_id, turn, place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) WHERE place <= 4""")
def shown_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four turns of each conversation."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("position"))
    return attribution.shown_turns(c, ["conv_id"], 4).select("conv_id", "turn", F.col("place").cast("long").alias("place"))


# scalars


@query("""
SELECT page_id, CASE WHEN page_id % 3 >= 1 AND page_id % 7 <> 0 THEN url END AS file, CAST(CASE WHEN page_id % 3 >= 1 AND page_id % 7 <> 0 AND url IS NOT NULL THEN page_id % 3 END AS BIGINT) AS line, page_id % 2 = 0 AS since_ok FROM pages""")
def parsed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls as files with a line behind the last colon; line 0 and what looks like an option are none."""
    k = F.col("page_id")
    raw = F.concat(F.when(k % 7 == 0, "-").otherwise(""), F.col("url"), F.lit(":"), (k % 3).cast("string"))
    since = F.when(k % 2 == 0, "2026-01-05").otherwise("2026-1-5")
    t = text.parse_target(raw)
    return load(spark, sf_dir, "pages").select("page_id", t["file"].alias("file"), t["line"].alias("line"), text.valid_since(since).alias("since_ok"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 12.5 ELSE 7.0 END AS number, greatest(NULLIF(event_id % 5, 0), CASE WHEN event_id % 5 <> 0 THEN NULLIF(event_id % 7, 0) END) AS settled,
       event_id % 3 = 0 AS stopped, left(sha256('k' || event_id), 16) AS fingerprint, CASE event_type WHEN 'view' THEN 'The receiver did not take the data now; it is held and tried again.' WHEN 'click' THEN 'The receiver refuses this data; it is skipped and counted as a gap.'
       WHEN 'error' THEN 'The credential is not accepted; delivery stops until it changes.' END AS sentence, event_id * 1000 - 60000 > 500000 AS fresh, CAST(floor(event_id * 0.6) AS BIGINT) AS spawn_ms FROM events""")
def policy_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = load(spark, sf_dir, "events"), F.col("event_id")
    value = F.when(k % 4 == 0, "12.5").when(k % 4 == 1, "-1").when(k % 4 == 2, "many")
    stop = F.when(k % 3 == 0, "a").when(k % 3 == 1, "b")
    cls = mapped("event_type", {"view": "later", "click": "never", "error": "fatal", "purchase": "ok"})
    return e.select(
        "event_id",
        policy.positive_or(value, 7.0).alias("number"),
        policy.settled_size(F.nullif(k % 5, F.lit(0)), F.nullif(k % 7, F.lit(0))).alias("settled"),
        policy.is_stopped(stop, F.lit("a")).alias("stopped"),
        policy.credential_fingerprint(_raw("k", k)).alias("fingerprint"),
        policy.failure_copy(cls).alias("sentence"),
        policy.is_fresh(k * 1000, F.lit(500_000)).alias("fresh"),
        policy.spawn_budget_ms(k).alias("spawn_ms"),
    )


@query("""
SELECT event_id, (20 + event_id % 5, event_id % 20, 0) >= (22, 15, 0) AS new_enough, event_id % 2 = 0 AS control, event_id % 3 <> 2 AS agreed, CASE WHEN event_id % 2 = 0 THEN '~/x' ELSE '/home/user/x' END AS short_path,
       rtrim(replace(replace(to_base64(unhex(sha256(CAST(event_id AS VARCHAR)))), '+', '-'), '/', '_'), '=') AS digest, event_id % 3 || CASE WHEN event_id % 3 = 1 THEN ' file' ELSE ' files' END AS counted,
       '  key        ' || event_id AS labelled, event_id % 4 < 2 AS inside FROM events""")
def text_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = load(spark, sf_dir, "events"), F.col("event_id")
    path = F.when(k % 4 == 0, "/r/a").when(k % 4 == 1, "/r/a/b").when(k % 4 == 2, "/r/ab")
    return e.select(
        "event_id",
        text.version_at_least(_raw("v", 20 + k % 5, ".", k % 20, ".0")).alias("new_enough"),
        text.has_control_character(F.when(k % 2 == 0, "a\tb").otherwise("a b")).alias("control"),
        text.is_affirmative(F.when(k % 3 == 0, " YES ").when(k % 3 == 1, "y").otherwise("yep")).alias("agreed"),
        text.tildify(F.when(k % 2 == 0, "/home/u/x").otherwise("/home/user/x"), F.lit("/home/u")).alias("short_path"),
        text.base64url_sha256(k.cast("string")).alias("digest"),
        text.counted(k % 3, "file", "files").alias("counted"),
        text.labelled(2, F.lit("key"), k.cast("string")).alias("labelled"),
        identity.is_inside(F.lit("/r/a"), path).alias("inside"),
    )


@query("""
SELECT o_orderkey, 'No commits on ' || o_orderpriority || ' in 7 days.' AS no_commits, 'No recorded sessions for the ' || o_custkey || ' commits in 7 days.' AS no_sessions,
       'This line is attributed to ' || o_orderkey || '; the session we hold was recorded against ' || o_custkey || '.' AS squash, o_custkey || ' more matched by patch id, reported separately and not counted above.' AS probable,
       CASE WHEN o_custkey > 3 THEN 'Showing turns 1-3 of ' || o_custkey || ' that touched this file in this commit, in turn order.' END AS truncation,
       CASE o_orderstatus WHEN 'O' THEN 'The agent reported this commit. It is not in the transcript record.' WHEN 'F' THEN 'The commit command is recorded in this session''s transcript.' END AS grade FROM orders""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = load(spark, sf_dir, "orders"), F.col("o_custkey")
    window = F.lit("7 days")
    return o.select(
        "o_orderkey",
        text.no_commits(F.col("o_orderpriority"), window).alias("no_commits"),
        text.no_sessions(n, window).alias("no_sessions"),
        text.squash_resolved(F.col("o_orderkey").cast("string"), n.cast("string")).alias("squash"),
        text.probable_line(n).alias("probable"),
        text.truncation(F.lit(1), F.lit(3), n).alias("truncation"),
        text.grade_sentence(mapped("o_orderstatus", {"O": "declared", "F": "derived"})).alias("grade"),
    )
