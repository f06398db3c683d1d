"""Scalar text functions of the read side: ages, dates, bounded strings, rendered rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layout and wording.
COLUMNS, GUTTER, ABBREV, ELLIPSIS, GAP, TURN_INDENT, EXCERPT_INDENT = 80, 11, 7, "…", "  ", 4, 13
GRADES = ("declared", "observed", "derived")
GRADE_SENTENCES = {
    "derived": "The commit command is recorded in this session's transcript.",
    "observed": "This commit appeared while the session was running. The commit command was not in the transcript, so it may include work from outside this session.",
    "declared": "The agent reported this commit. It is not in the transcript record.",
}


def relative_age(then_ms: Column, now_ms: Column) -> Column:
    """just now (also for the future), then whole minutes, hours or days."""
    gone = now_ms - then_ms

    def since(unit_ms: int, unit: str) -> Column:
        n = F.floor(gone / unit_ms)
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return (
        F.when(gone < 60_000, "just now")
        .when(gone < 3_600_000, since(60_000, "minute"))
        .when(gone < 86_400_000, since(3_600_000, "hour"))
        .otherwise(since(86_400_000, "day"))
    )


def utc_day(ts: Column) -> Column:
    """The day in UTC whatever the session's zone; a timestamp without a zone is in UTC."""
    here = ts.cast("timestamp_ntz")
    return F.date_format(F.when(F.typeof(ts) == "timestamp_ntz", here).otherwise(F.convert_timezone(None, F.lit("UTC"), here)), "yyyy-MM-dd")


def author_date(epoch: Column, offset: Column) -> Column:
    """The author's own date from epoch seconds and ±HHMM (unreadable offset: UTC)."""
    parts = [F.regexp_extract(F.trim(offset), r"^([+-])(\d{2})(\d{2})$", k) for k in (1, 2, 3)]
    minutes = F.coalesce(parts[1].try_cast("int") * 60 + parts[2].try_cast("int"), F.lit(0))
    shift = F.when(parts[0] == "-", -minutes).otherwise(minutes) * 60
    # whole days since the epoch, so that no session time zone plays a part
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor((epoch + shift) / 86400).cast("int")), "yyyy-MM-dd")


def short_sha(sha: Column) -> Column:
    return F.substr(sha, F.lit(1), F.lit(ABBREV))


def truncate_path(path: Column, most: Column) -> Column:
    """Keeps the right end behind an ellipsis."""
    return F.when(F.length(path) <= most, path).otherwise(F.concat(F.lit(ELLIPSIS), F.right(path, most - 1)))


def bound_quote(quote: Column, most: int = COLUMNS - EXCERPT_INDENT - 2) -> Column:
    """Keeps the left end before an ellipsis, by code points."""
    return F.when(F.length(quote) <= most, quote).otherwise(F.concat(F.left(quote, F.lit(most - 1)), F.lit(ELLIPSIS)))


def pad_end(value: Column, width: int = GUTTER) -> Column:
    """Blanks up to the width; longer values stay whole."""
    return F.when(F.length(value) >= width, value).otherwise(F.rpad(value, width, " "))


def labelled(indent: int, key: Column, value: Column) -> Column:
    return F.concat(F.lit(" " * indent), pad_end(key), value)


def wrap(text: Column, indent: int = 0, hanging: int | None = None, width: int = COLUMNS) -> Column:
    """Lines of at most ``width``, filled greedily; longer words stand alone, unbroken."""
    later = " " * (indent if hanging is None else hanging)
    parts = F.array_remove(F.split(text, r"\s+"), "")

    def add(acc: Column, word: Column) -> Column:
        line = F.concat(acc["line"], F.when(acc["empty"], "").otherwise(" "), word)
        full = ~acc["empty"] & (F.length(line) > width)
        lines = F.when(full, F.concat(acc["lines"], F.array(acc["line"]))).otherwise(acc["lines"])
        return F.struct(lines.alias("lines"), F.when(full, F.concat(F.lit(later), word)).otherwise(line).alias("line"), F.lit(False).alias("empty"))

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("lines"), F.lit(" " * indent).alias("line"), F.lit(True).alias("empty"))
    return F.aggregate(parts, start, add, lambda acc: F.when(acc["empty"], none).otherwise(F.concat(acc["lines"], F.array(acc["line"]))))


def attribution_marker(agent_id: Column, recorded: Column, subagents: Column) -> Column:
    """Agent, else a positive count, else nothing for the main thread, else 'not recorded'."""
    return (
        F.when(agent_id.isNotNull(), F.concat(F.lit("· sub-agent "), agent_id))
        .when(subagents > 0, F.concat(F.lit("· "), subagents.cast("string"), F.when(subagents == 1, " sub-agent").otherwise(" sub-agents")))
        .when(recorded, "")
        .otherwise("· actor not recorded")
    )


def turn_row(position: Column, tool: Column, files: Column, marker: Column) -> Column:
    """One turn; a missing part leaves no separator and no trailing blanks."""
    head = F.concat(F.lit(" " * TURN_INDENT + "turn "), position.cast("string"), F.coalesce(F.concat(F.lit(f"{GAP}["), tool, F.lit("]")), F.lit("")))
    tail = F.when(marker == "", "").otherwise(F.concat(F.lit(GAP), marker))
    listed = F.array_join(F.coalesce(files, F.array().cast("array<string>")), ", ")
    room = F.greatest(F.lit(8), COLUMNS - F.length(head) - F.length(tail) - len(GAP))
    return F.when(listed == "", F.concat(head, tail)).otherwise(F.concat(head, F.lit(GAP), truncate_path(listed, room), tail))


def grade_rank(grade: Column) -> Column:
    """0 for the weakest grade; null outside the closed set."""
    out = F.lit(None).cast("int")
    for k, g in enumerate(GRADES):
        out = F.when(grade == g, k).otherwise(out)
    return out


def grade_floor(grades: Column) -> Column:
    """The weakest grade of an array; null for an empty one."""
    lowest = F.array_min(F.transform(grades, grade_rank))
    return F.get(F.array(*map(F.lit, GRADES)), lowest)


def identity_line(line: Column, sha: Column, date: Column) -> Column:
    return F.format_string("Line %d → %s · %s (git blame)", line, short_sha(sha), date)


def grade_sentence(grade: Column) -> Column:
    out = F.lit(None).cast("string")
    for g, sentence in GRADE_SENTENCES.items():
        out = F.when(grade == g, sentence).otherwise(out)
    return out


def valid_since(value: Column) -> Column:
    """The shape of a day; whether the day exists is not asked."""
    return F.coalesce(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


# The sentences below are the client's wording.


def no_commits(ref: Column, window: Column) -> Column:
    return F.format_string("No commits on %s in %s.", ref, window)


def no_sessions(count: Column, window: Column) -> Column:
    return F.format_string("No recorded sessions for the %d commits in %s.", count, window)


def squash_resolved(blamed: Column, recorded: Column) -> Column:
    return F.format_string("This line is attributed to %s; the session we hold was recorded against %s.", blamed, recorded)


def probable_line(count: Column) -> Column:
    return F.concat(count.cast("string"), F.lit(" more matched by patch id, reported separately and not counted above."))


def files_without_turn(count: Column) -> Column:
    return F.when(count > 0, counted(count, "more file in this commit has no linked turn.", "more files in this commit have no linked turn."))


def truncation(first: Column, last: Column, total: Column) -> Column:
    """Only where the shown turns are not all."""
    line = F.format_string("Showing turns %d-%d of %d that touched this file in this commit, in turn order.", first, last, total)
    return F.when((first > 1) | (last < total), line)


def tildify(path: Column, home: Column) -> Column:
    inside = (path == home) | path.startswith(F.concat(home, F.lit("/")))
    return F.when(F.coalesce(inside, F.lit(False)), F.concat(F.lit("~"), F.substr(path, F.length(home) + 1))).otherwise(path)


def counted(n: Column, one: str, many: str) -> Column:
    """'1 one' or 'n many'."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def base64url_sha256(value: Column) -> Column:
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(value.cast("binary"), 256))), "+/=", "-_"))


def parse_target(raw: Column) -> Column:
    """struct(file, line) of <file>:<line>, split at the last colon; null for anything else."""
    file, digits = (F.regexp_extract(raw, r"(?s)^(.+):([0-9]+)$", k) for k in (1, 2))
    line = digits.try_cast("long")
    return F.when(~raw.startswith("-") & (file != "") & (line >= 1), F.struct(file.alias("file"), line.alias("line")))


def version_at_least(version: Column, floor: tuple[int, int, int] = (22, 15, 0)) -> Column:
    parts = [F.regexp_extract(version, r"^v?(\d+)\.(\d+)\.(\d+)", k).try_cast("int") for k in (1, 2, 3)]
    return F.coalesce(F.struct(*parts) >= F.struct(*map(F.lit, floor)), F.lit(False)) & parts[0].isNotNull()


def has_control_character(value: Column) -> Column:
    return value.rlike(r"[\x00-\x1F\x7F]")


def is_affirmative(value: Column) -> Column:
    return F.lower(F.trim(value)).isin("y", "yes")


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; null where nothing is counted."""
    return F.when(whole > 0, F.floor(part / whole * 100 + 0.5)).cast("long")


def redact_span(text: Column) -> Column:
    """A marker of the same number of bytes as the text, shortened where it doesn't fit."""
    n = F.octet_length(text)
    long = F.concat(F.lit("[OUT-OF-TREE: "), n.cast("string"), F.lit(" bytes withheld"))
    short = F.lit("[OUT-OF-TREE]")
    fill = lambda head, k: F.concat(head, F.repeat(F.lit("."), k))
    return (
        F.when(n > F.length(long), F.concat(fill(long, n - F.length(long) - 1), F.lit("]")))
        .when(n >= F.length(short), fill(short, n - F.length(short)))
        .otherwise(F.repeat(F.lit("."), n))
    )
