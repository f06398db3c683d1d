"""Strict decoding of JSON records through VARIANT.

A record is decoded whole or not at all, and three facts stay apart: a field that is
absent, one that is present and null, and one with a value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenir.functions.text import GRADES

#: The states and kinds of the wire format, whose field names stand below.
_STATES = ("cold_start", "no_edge", "squash_resolved", "turns")
_KINDS = ("exact", "probable")
_STRINGS = "array<string>"
_SPAN = "struct<from_off:bigint,to_off:bigint,at_ms:bigint>"
_FILE = f"struct<sent_offset:bigint,backlog:array<{_SPAN}>,gap_bytes:bigint,gap_count:bigint,last_sent_at_ms:bigint>"


def parse(raw: Column) -> Column:
    """VARIANT, null for anything that is no JSON."""
    return F.try_parse_json(raw)


def field(v: Column, name: str) -> Column:
    """A field as VARIANT: null if absent, a VARIANT null if present and null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it.

    Without it a parsed record would be parsed again wherever one of its fields is named.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fields(v: Column, **readers: Callable[[Column], Column]) -> Column:
    """struct of the named fields, each taken out and read once."""
    return F.struct(*(let(field(v, name), read).alias(name) for name, read in readers.items()))


def sound(decoded: Column) -> Column:
    """A generator of the decoded record, no row where it is null.

    A filter on it would be pushed below the decoding and decode every record twice.
    """
    return F.explode(F.filter(F.array(decoded), lambda x: x.isNotNull()))


def kind(v: Column) -> Column:
    """The schema's name: exact for scalars, with parts for others, ABSENT for null."""
    return F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))


def is_null(v: Column) -> Column:
    return v.isNotNull() & F.is_variant_null(v)


def missing(v: Column) -> Column:
    """Absent or present and null."""
    return v.isNull() | F.is_variant_null(v)


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_string(v: Column) -> Column:
    return kind(v) == "STRING"


def _number(v: Column) -> Column:
    """As double where it is a real number of at least 0."""

    def told(k: Column) -> Column:
        return k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL")

    x = F.when(let(kind(v), told), F.try_variant_get(v, "$", "double"))
    return let(x, lambda x: F.when(x >= 0, x))


def as_string(v: Column) -> Column:
    """Only real strings; null for numbers and the like."""
    return F.when(is_string(v), F.try_variant_get(v, "$", "string"))


def as_text(v: Column) -> Column:
    """A string with something else than blanks in it."""
    return let(as_string(v), lambda s: F.when(F.trim(s) != "", s))


def as_count(v: Column) -> Column:
    """A whole number of at least 0 (1.0 counts, "1" doesn't), else null."""
    return F.when(let(_number(v), lambda x: x == F.floor(x)), F.try_variant_get(v, "$", "long"))


def floored(v: Column) -> Column:
    """A number of at least 0 rounded down; anything else is 0."""
    return F.coalesce(F.floor(_number(v)), F.lit(0)).cast("long")


def items(v: Column) -> Column:
    """The entries of a JSON array as VARIANTs, null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def whole(entries: Column) -> Column:
    """The array if none of its entries is null, else null."""
    return let(entries, lambda x: F.when(F.forall(x, lambda e: e.isNotNull()), x))


def as_strings(v: Column) -> Column:
    """An array of nothing but strings, else null."""
    return whole(F.transform(items(v), as_string))


def own_strings(v: Column) -> Column:
    """The strings of an array; other entries are left out."""
    return F.filter(F.transform(items(v), as_string), lambda x: x.isNotNull())


def hook_event(raw: Column) -> Column:
    """struct(session_id, transcript_path, cwd, hook_event_name), null where it is dropped."""

    def told(f: Column) -> Column:
        event = F.struct(f["session_id"].alias("session_id"), f["transcript_path"].alias("transcript_path"), f["cwd"].alias("cwd"), F.coalesce(f["hook_event_name"], F.lit("")).alias("hook_event_name"))
        return F.when((f["session_id"] != "") & (f["transcript_path"] != ""), event)

    names = ("session_id", "transcript_path", "cwd", "hook_event_name")
    return let(parse(raw), lambda v: let(fields(v, **dict.fromkeys(names, as_string)), told))


def spool_entry(raw: Column) -> Column:
    """struct(sha, branch, at, files) of an observed commit, null for a line that is skipped."""

    def told(f: Column) -> Column:
        good = f["sha"].rlike("^(?:[0-9a-f]{40}|[0-9a-f]{64})$") & f["at"].isNotNull()
        files = F.coalesce(f["files"], F.array().cast(_STRINGS))
        return F.when(good, F.struct(f["sha"].alias("sha"), F.nullif(f["branch"], F.lit("")).alias("branch"), f["at"].alias("at"), files.alias("files")))

    return let(parse(raw), lambda v: let(fields(v, sha=as_string, branch=as_string, at=as_string, files=own_strings), told))


def backlog(v: Column) -> Column:
    """Held spans, cut before the first that is empty or doesn't continue the one before."""
    read = {"from": floored, "to": floored, "at": floored}
    spans = F.transform(F.coalesce(items(v), F.array().cast("array<variant>")), lambda x: fields(x, **read).cast(_SPAN))
    none = F.array().cast(f"array<{_SPAN}>")

    def add(acc: Column, s: Column) -> Column:
        fits = acc["open"] & (s["to_off"] > s["from_off"]) & (acc["to"].isNull() | (s["from_off"] == acc["to"]))
        step = lambda f: F.struct(F.when(f, F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"]).alias("kept"), F.when(f, s["to_off"]).otherwise(acc["to"]).alias("to"), f.alias("open"))
        return let(fits, step)

    start = F.struct(none.alias("kept"), F.lit(None).cast("long").alias("to"), F.lit(True).alias("open"))
    return F.aggregate(spans, start, add, lambda acc: acc["kept"])


def file_state(v: Column) -> Column:
    read = fields(v, sentOffset=floored, backlog=backlog, gapBytes=floored, gapCount=floored, lastSentAt=floored)
    return read.cast(_FILE)


def session_state(raw: Column) -> Column:
    """struct(seq, stop, files); any failure is the empty state, which resends from 0."""
    empty = F.map_from_entries(F.array().cast(f"array<struct<key:string,value:{_FILE}>>"))

    def stop(v: Column) -> Column:
        told = lambda s: F.when((s["at"] != "") & (s["fingerprint"] != ""), s)
        return let(fields(v, at=as_string, fingerprint=as_string), told)

    def files(v: Column) -> Column:
        found = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, x: is_object(x))
        return F.coalesce(F.transform_values(found, lambda _, x: file_state(x)), empty)

    return let(parse(raw), lambda v: fields(v, seq=floored, stop=stop, files=files))


def coverage_payload(raw: Column) -> Column:
    """The coverage document, null if any part of it is off."""

    def grades(v: Column) -> Column:
        counts = F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, x: as_count(x))
        return let(counts, lambda m: F.when(F.forall(F.map_entries(m), lambda e: e["value"].isNotNull() & e["key"].isin(*GRADES)), m))

    def told(f: Column) -> Column:
        names = {"ref": "ref", "edges_held": "edges_held", "by_grade": "by_grade", "captured_shas": "captured_shas", "exact_successors": "exact_successors", "probable_line": "probable_count"}
        good = F.lit(True)
        for name in names:
            good = good & f[name].isNotNull()
        return F.when(good, F.struct(*(f[name].alias(as_) for name, as_ in names.items())))

    texts = lambda v: whole(F.transform(items(v), as_text))
    read = {"ref": as_text, "edges_held": as_count, "by_grade": grades, "captured_shas": texts, "exact_successors": as_count, "probable_line": lambda v: let(field(v, "count"), as_count)}
    return let(parse(raw), lambda v: let(fields(v, **read), told))


def _optional(v: Column, read: Callable[[Column], Column]) -> Column:
    """struct(value, sound): what is missing is sound and has no value."""
    return let(read(v), lambda x: F.struct(x.alias("value"), (missing(v) | x.isNotNull()).alias("sound")))


def turn(v: Column) -> Column:
    """struct of one turn, null if it is malformed; agent_id_recorded tells absent from null."""
    none = F.array().cast(_STRINGS)

    def told(f: Column) -> Column:
        good = f["position"].isNotNull() & f["files"].isNotNull() & f["excerpt"].isNotNull() & f["tool"]["sound"] & f["agent_id"]["sound"]
        return F.when(
            good,
            F.struct(
                f["position"].alias("position"),
                f["tool"]["value"].alias("tool"),
                f["files"].alias("files"),
                f["excerpt"].alias("excerpt"),
                f["agent_id"]["value"].alias("agent_id"),
                f["agent_id"]["recorded"].alias("agent_id_recorded"),
                f["subagent_count"].alias("subagent_count"),
            ),
        )

    read = {
        "position": as_count,
        "files": lambda x: F.when(is_null(x), none).otherwise(as_strings(x)),
        "excerpt": lambda x: F.when(missing(x), none).otherwise(as_strings(x)),
        "tool": lambda x: _optional(x, as_string),
        "agent_id": lambda x: let(_optional(x, as_text), lambda o: F.struct(o["value"].alias("value"), o["sound"].alias("sound"), x.isNotNull().alias("recorded"))),
        "subagent_count": as_count,
    }
    return let(fields(v, **read), told)


def turn_window(v: Column) -> Column:
    told = lambda w: F.when((w["first"] <= w["last"]) & (w["last"] <= w["total"]), w)
    return let(fields(v, first=as_count, last=as_count, total=as_count), told)


def blame_payload(raw: Column) -> Column:
    """The answer for one blamed commit, null if any part of it is off."""

    def told(f: Column) -> Column:
        state, match, recorded, grades = f["state"], f["match_kind"], f["recorded_sha"], f["grades"]
        is_turns, squashed = state == "turns", state == "squash_resolved"
        match_ok = match["missing"] | match["value"].isin(*_KINDS)
        turns_ok = (F.size(grades) > 0) & F.forall(grades, lambda g: g.isin(*GRADES)) & f["turns"].isNotNull() & f["window"]["sound"] & recorded["sound"]
        squash_ok = recorded["value"].isNotNull() & ~match["missing"]
        good = state.isin(*_STATES) & match_ok & F.when(is_turns, turns_ok).when(squashed, squash_ok).otherwise(F.lit(True))
        return F.when(
            F.coalesce(good, F.lit(False)),
            F.struct(
                state.alias("state"),
                F.when(is_turns | squashed, recorded["value"]).alias("recorded_sha"),
                match["value"].alias("match_kind"),
                F.when(is_turns, grades).otherwise(F.array().cast(_STRINGS)).alias("grades"),
                F.when(is_turns, f["turns"]).alias("turns"),
                F.when(is_turns, f["window"]["value"]).alias("window"),
                F.when(is_turns, f["files_without_turn"]).alias("files_without_turn"),
            ),
        )

    read = {
        "state": as_string,
        "match_kind": lambda x: F.struct(as_string(x).alias("value"), missing(x).alias("missing")),
        "recorded_sha": lambda x: _optional(x, as_text),
        "grades": as_strings,
        "turns": lambda x: whole(F.transform(items(x), turn)),
        "window": lambda x: _optional(x, turn_window),
        "files_without_turn": as_count,
    }
    return let(parse(raw), lambda v: let(fields(v, **read), told))


def error_detail(body: Column, most: int = 64 * 1024) -> Column:
    """struct(code, owners_notified, owners_recorded) of an error body of bounded size."""

    def owners(v: Column) -> Column:
        return F.struct(as_count(v).alias("n"), v.isNotNull().alias("recorded"))

    def told(f: Column) -> Column:
        return F.struct(f["code"].alias("code"), f["owners_notified"]["n"].alias("owners_notified"), f["owners_notified"]["recorded"].alias("owners_recorded"))

    def document(v: Column) -> Column:
        return F.when(is_object(v), let(F.coalesce(field(v, "error"), v), lambda e: let(fields(e, code=as_string, owners_notified=owners), told)))

    return let(parse(F.when(F.octet_length(body) <= most, body)), document)


def tool_answer(status: Column, body: Column) -> Column:
    """struct(kind, text, is_error, code, message) of one read over JSON-RPC.

    kind is unreachable (no status), unauthorized, malformed, rpc-error or ok; only an ok
    answer has a text, and whether the tool itself failed stays a field of its own.
    """

    def error(v: Column) -> Column:
        return F.struct((~missing(v)).alias("there"), F.coalesce(F.try_variant_get(v, "$.code", "long"), F.lit(0)).alias("code"), F.coalesce(let(field(v, "message"), as_string), F.lit("")).alias("message"))

    def result(v: Column) -> Column:
        text = let(F.get(items(field(v, "content")), F.lit(0)), lambda c: let(field(c, "text"), as_string))
        return F.struct(text.alias("text"), F.coalesce(F.try_variant_get(v, "$.isError", "boolean"), F.lit(False)).alias("failed"))

    def told(f: Column) -> Column:
        kind_ = F.when(status.isNull(), "unreachable").when(status == 401, "unauthorized").when(~f["parsed"], "malformed").when(f["error"]["there"], "rpc-error").when(parse(f["result"]["text"]).isNull(), "malformed").otherwise("ok")
        return let(
            kind_,
            lambda k: F.struct(
                k.alias("kind"),
                F.when(k == "ok", f["result"]["text"]).alias("text"),
                F.when(k == "ok", f["result"]["failed"]).alias("is_error"),
                F.when(k == "rpc-error", f["error"]["code"]).alias("code"),
                F.when(k == "rpc-error", f["error"]["message"]).alias("message"),
            ),
        )

    def parts(v: Column) -> Column:
        return F.struct(v.isNotNull().alias("parsed"), let(field(v, "error"), error).alias("error"), let(field(v, "result"), result).alias("result"))

    return let(parse(body), lambda v: let(parts(v), told))


def approval_pending(detail: Column, code: str) -> Column:
    """Whether a delivery waits for an owner: the error's own code decides, not its status."""
    return F.coalesce(detail["code"] == code, F.lit(False))


def blame_porcelain(out: Column) -> Column:
    """struct(sha, line, epoch, offset) of one blamed line; null where it is not committed."""
    sha, line = F.regexp_extract(out, r"^([0-9a-f]{40}) \d+ (\d+)", 1), F.regexp_extract(out, r"^([0-9a-f]{40}) \d+ (\d+)", 2).try_cast("long")
    epoch = F.regexp_extract(out, r"(?m)^author-time +(\d+)", 1).try_cast("long")
    good = (sha != "") & (sha != "0" * 40) & epoch.isNotNull()
    return F.when(good, F.struct(sha.alias("sha"), line.alias("line"), epoch.alias("epoch"), F.regexp_extract(out, r"(?m)^author-tz +([+-]\d{4})\s*$", 1).alias("offset")))
