"""Delivery policy as columns: status classes, byte spans, time budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Status -> class; every other 2xx is ok, every other status is tried later.
NEVER, FATAL = (400, 413), (401,)
#: Limits of what is held back, and budgets in milliseconds.
CAP_BYTES, CAP_AGE_MS, CAP_ENTRIES = 8 * 1024 * 1024, 24 * 3600 * 1000, 512
HOOK_BUDGET_MS, SEND_SHARE, SEND_FLOOR_MS = 5000, 0.6, 50
SETTLE_MS, SETTLE_SHARE = 250, 0.3
SPAWN_SHARE, SPAWN_FLOOR_MS = 0.6, 50
START_FLOOR_MS, MAX_FILES, MAX_COMMITS, LIVE_SECONDS = 400, 8, 32, 1800


def classify_status(status: Column) -> Column:
    """ok, never, fatal or later; no status (nobody answered) is later too."""
    return (
        F.when(status.between(200, 299), "ok")
        .when(status.isin(*NEVER), "never")
        .when(status.isin(*FATAL), "fatal")
        .otherwise("later")
    )


def next_span(sent: Column, eof: Column) -> Column:
    """struct(from_off, to_off) still to deliver, null if none; a file that shrank restarts at 0."""
    start = F.when(sent > eof, F.lit(0)).otherwise(sent)
    return F.when(eof > start, F.struct(start.cast("long").alias("from_off"), eof.cast("long").alias("to_off")))


def pending_bytes(backlog: Column) -> Column:
    """Bytes from the first held span's start to the last one's end; 0 for none."""
    held = F.element_at(backlog, -1)["to_off"] - F.element_at(backlog, 1)["from_off"]
    return F.when(F.size(backlog) > 0, held).otherwise(F.lit(0)).cast("long")


def positive_or(value: Column, default: float) -> Column:
    """A finite number above 0, else the default."""
    number = value.try_cast("double")
    return F.when((number > 0) & (number < F.lit(math.inf)) & ~F.isnan(number), number).otherwise(F.lit(float(default)))


def send_timeout_ms(budget: Column, consumed: Column) -> Column:
    return F.greatest(F.lit(SEND_FLOOR_MS), F.floor(F.greatest(F.lit(0), budget - consumed) * SEND_SHARE)).cast("long")


def settle_delay_ms(budget: Column, configured: Column | None = None) -> Column:
    wanted = F.lit(SETTLE_MS) if configured is None else F.coalesce(configured, F.lit(SETTLE_MS))
    return F.least(wanted, F.floor(budget * SETTLE_SHARE)).cast("long")


def spawn_budget_ms(budget: Column) -> Column:
    """The share of the hook's budget in which processes may be started."""
    return F.floor(budget * SPAWN_SHARE).cast("long")


def spawn_timeout_ms(remaining: Column, ceiling: Column) -> Column:
    """Null where too little time is left to start a process."""
    return F.when(remaining >= SPAWN_FLOOR_MS, F.least(ceiling, remaining)).cast("long")


def settled_size(first: Column, second: Column) -> Column:
    """The larger of two readings; no first reading means no size, a failed second keeps the first."""
    return F.when(first.isNotNull(), F.greatest(first, second)).cast("long")


def is_stopped(stop_fingerprint: Column, fingerprint: Column) -> Column:
    """A stop binds only the credential that it was met with."""
    return F.coalesce(stop_fingerprint == fingerprint, F.lit(False))


def credential_fingerprint(secret: Column) -> Column:
    return F.substr(F.sha2(secret.cast("binary"), 256), F.lit(1), F.lit(16))


def failure_copy(cls: Column) -> Column:
    """A sentence for each class but ok."""
    return (
        F.when(cls == "later", "The receiver did not take the data now; it is held and tried again.")
        .when(cls == "never", "The receiver refuses this data; it is skipped and counted as a gap.")
        .when(cls == "fatal", "The credential is not accepted; delivery stops until it changes.")
    )


def is_fresh(expires_at_ms: Column, now_ms: Column, margin_ms: int = 60_000) -> Column:
    """A token that is still valid a minute from now."""
    return expires_at_ms - margin_ms > now_ms
