"""Structured Streaming: deliveries through the ledger, notices once per key, live sessions."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from provenir.functions.policy import CAP_AGE_MS, CAP_BYTES, CAP_ENTRIES, LIVE_SECONDS
from provenir.operators.ledger import GrowingStream, Stream

ATTEMPT = "session string, file string, at_ms long, attempt_id long, eof long, outcome string, fingerprint string, last boolean"
DELIVERY = "session string, file string, attempt_id long, seq long, result string, sent long, backlog_entries long, gap_bytes long, gap_count long"
_FILE = "sent long, backlog array<struct<from_off:long,to_off:long,at_ms:long>>, gap_bytes long, gap_count long, last_sent_at long"


class LedgerProcessor(StatefulProcessor):
    """Folds a session's attempts in order; state is one sequence number and stop, and a map of files.

    The key is the session, so that its files share one sequence.  On a session's last
    event every sub-agent file that is still behind is stamped as a gap; the main one isn't.
    """

    stream = Stream

    def __init__(self, caps: tuple[float, float, float] = (CAP_BYTES, CAP_AGE_MS, CAP_ENTRIES)) -> None:
        self.caps = caps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "file string", _FILE)
        self.session = handle.getValueState("session", "seq long, stopped string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(["at_ms", "attempt_id"], kind="stable")
        self._open()
        out = [line for r in pdf.itertuples(index=False) for line in self._attempt(key[0], r)]
        self._save()
        yield _rows(out)

    def _open(self) -> None:
        self.seq, self.stopped = self.session.get() if self.session.exists() else (0, None)
        self.held: dict[str, Stream] = {}

    def _stream(self, name: str) -> Stream:
        s = self.held.get(name) or self._load(name)
        s.seq, s.stopped = self.seq, self.stopped
        self.held[name] = s
        return s

    def _attempt(self, session: str, r) -> Iterator[tuple]:
        s = self._stream(r.file)
        result = s.apply(int(r.eof), r.outcome, int(r.at_ms), r.fingerprint, self.caps)
        self.seq, self.stopped = s.seq, s.stopped
        if r.last and r.file != "main":
            s.close(int(r.eof))
        yield session, r.file, r.attempt_id, self.seq, result, s.sent, len(s.backlog), s.gap_bytes, s.gap_count

    def _save(self) -> None:
        for name, s in self.held.items():
            self.files.updateValue((name,), (s.sent, [tuple(b) for b in s.backlog], s.gap_bytes, s.gap_count, s.last_sent_at))
        self.session.update((self.seq, self.stopped))

    def _load(self, name: str) -> Stream:
        if not self.files.containsKey((name,)):
            return self.stream()
        sent, backlog, gap_bytes, gap_count, last = self.files.getValue((name,))
        return self.stream(sent, [tuple(b) for b in backlog or []], gap_bytes, gap_count, last)

    def close(self) -> None:
        pass


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[x.split()[0] for x in DELIVERY.split(", ")]).astype({"attempt_id": "Int64"})


class IdleSessions(LedgerProcessor):
    """The ledger of sessions that end by silence: ``idle_ms`` of event time without an attempt.

    At its end every sub-agent file that is still behind what was seen of it is stamped as a
    gap, once (result ``session-ended``, without an attempt), and all state of the session
    goes.  An attempt behind a longer silence ends the session before it even if both come in
    one micro-batch, so that results don't depend on how the stream is cut; what no attempt
    ends, a timer does when the watermark passes.  An attempt that comes after the end begins
    the session anew, from offset 0 and sequence 1, which a receiver that keeps one row per
    offset ignores; one that is older than the watermark is dropped by the engine.

    ``grows``: files never shrink; where an attempt tells of a smaller end than one before it
    (both in one millisecond, say), the furthest end is the file's.
    """

    def __init__(self, idle_ms: int, caps: tuple[float, float, float] = (CAP_BYTES, CAP_AGE_MS, CAP_ENTRIES), grows: bool = False) -> None:
        super().__init__(caps)
        self.idle_ms, self.grows = idle_ms, grows
        self.stream = GrowingStream if grows else Stream

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.ends = handle.getMapState("ends", "file string", "eof long")
        self.touched = handle.getValueState("touched", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(["at_ms", "attempt_id"], kind="stable")
        last = self.touched.get()[0] if self.touched.exists() else None
        if last is not None:
            self.handle.deleteTimer(last + self.idle_ms + 1)
        self._open()
        self.seen = self._seen()
        out = []
        for r in pdf.itertuples(index=False):
            if last is not None and r.at_ms - last > self.idle_ms:
                out += self._ended(key[0])
            out += self._attempt(key[0], r)
            self.seen[r.file] = max(int(r.eof), self.seen.get(r.file, 0)) if self.grows else int(r.eof)
            last = max(last or 0, int(r.at_ms))
        self._save()
        for name, eof in self.seen.items():
            self.ends.updateValue((name,), (eof,))
        self.touched.update((last,))
        self.handle.registerTimer(last + self.idle_ms + 1)
        yield _rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._open()
        self.seen = self._seen()
        yield _rows(self._ended(key[0]))

    def _seen(self) -> dict[str, int]:
        return {k[0]: v[0] for k, v in self.ends.iterator()} if self.ends.exists() else {}

    def _ended(self, session: str) -> list[tuple]:
        """Rows of the gaps that the end leaves; the session's state is empty afterwards."""
        out = []
        for name, eof in sorted(self.seen.items()):
            s = self._stream(name)
            before = s.gap_count
            if name != "main":
                s.close(eof)
            if s.gap_count > before:
                out.append((session, name, None, self.seq, "session-ended", s.sent, 0, s.gap_bytes, s.gap_count))
        for state in (self.files, self.ends, self.session, self.touched):
            state.clear()
        self.seq, self.stopped, self.held, self.seen = 0, None, {}, {}
        return out


def timed_deliveries(attempts: DataFrame, idle_ms: int = LIVE_SECONDS * 1000, late: str = "10 minutes", caps: tuple[float, float, float] = (CAP_BYTES, CAP_AGE_MS, CAP_ENTRIES), grows: bool = False) -> DataFrame:
    """``deliveries`` of a stream whose sessions end after ``idle_ms`` of silence.

    The watermark follows ``at_ms``, ``late`` behind; a session's end is told once it passes.
    ``grows`` says that files never shrink (``IdleSessions``).
    """
    rows = attempts.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", late)
    return rows.groupBy("session").transformWithStateInPandas(IdleSessions(idle_ms, caps, grows), DELIVERY, "Append", "EventTime")


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed processors need, for the queries started inside."""
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def deliveries(attempts: DataFrame, caps: tuple[float, float, float] = (CAP_BYTES, CAP_AGE_MS, CAP_ENTRIES)) -> DataFrame:
    """One row per attempt with the ledger after it; attempts has the columns of ATTEMPT, batch or stream.

    The session needs the RocksDB state store.  A micro-batch brings a session's rows to
    one task in memory (bound it with maxFilesPerTrigger); for whole histories in batch,
    ledger_fold streams over sorted rows instead.
    """
    # a batch query looks for the coordinator that the stream manager starts
    _ = attempts.sparkSession.streams.active
    mode = "Append" if attempts.isStreaming else "Update"
    return attempts.groupBy("session").transformWithStateInPandas(LedgerProcessor(caps), DELIVERY, mode, "None")


def notices_once(events: DataFrame, by: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark; the time column is ``ts``."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(by)


def live_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of activity per key with their number of events (batch or stream)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def header_rows(sent: DataFrame) -> DataFrame:
    """The header of each delivery; what is absent stays null, never empty."""
    optional = lambda c: F.nullif(F.col(c), F.lit(""))
    shas = F.when(F.size("shas") > 0, F.array_join("shas", ","))
    return sent.select("session", "seq", F.col("offset").cast("long").alias("offset"), "file", "repo_slug", "client_version", optional("head_sha").alias("head_sha"), optional("branch").alias("branch"), shas.alias("shas"))


def idempotent_sink(path: str, key: list[str], partitions: int | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: the table below ``path`` holds one row a key, whatever is redelivered.

    Delivery is at least once and the receiver keeps one row per (repo, session, file,
    offset).  A batch is reduced to one row a key and to the keys that no other batch wrote;
    a batch that is run again replaces its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(key)
        if _batches(spark, path):
            known = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", path).parquet(path)
            rows = rows.join(known.filter(F.col("batch") != batch_id).select(*key), key, "left_anti")
        rows = rows if partitions is None else rows.coalesce(partitions)
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch_id}")

    return write


def _batches(spark: SparkSession, path: str) -> bool:
    """Whether any batch has a folder yet."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/*.parquet")
    hits = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)
    return hits is not None and len(hits) > 0


def documents_sink(rows: DataFrame, verb: str, outcome: str, path: str) -> None:
    """One-line JSON documents with schema and verb first; nulls are written, not dropped."""
    machine_documents(rows, verb, outcome).write.mode("overwrite").text(path)


def machine_documents(rows: DataFrame, verb: str, outcome: str) -> DataFrame:
    body = F.struct(F.lit(1).alias("schema"), F.lit(verb).alias("verb"), F.lit(outcome).alias("outcome"), *rows.columns)
    return rows.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))
