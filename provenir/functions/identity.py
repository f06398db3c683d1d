"""Repository identity and path confinement as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grammar of a remote's parts.
HOSTNAME = "^[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?$"
OWNER = "^[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?$"
REPO = "^[A-Za-z0-9._-]+$"
SHA = "^(?:[0-9a-f]{40}|[0-9a-f]{64})$"
UNQUALIFIED = ("github.com", "ssh.github.com")
SCHEMES = ("https", "http", "ssh", "git")
SLUG_MAX = 256

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"
_SCP = r"^(?:[^@/]+@)?([^@/:]+):(.+)$"


def remote_parts(remote: Column) -> tuple[Column, Column, Column]:
    """(host, path, ssh) of a remote; host is null where it is neither a URL nor scp-like."""
    raw = F.trim(remote)
    url = raw.contains("://")
    scheme = F.lower(F.regexp_extract(raw, _URL, 1))
    known = scheme.isin(*SCHEMES)
    host = F.when(url, F.when(known, F.regexp_extract(raw, _URL, 2))).otherwise(F.nullif(F.regexp_extract(raw, _SCP, 1), F.lit("")))
    path = F.when(url, F.regexp_extract(raw, _URL, 3)).otherwise(F.regexp_extract(raw, _SCP, 2))
    return host, path, F.when(url, scheme == "ssh").otherwise(F.lit(True))


def parse_remote_slug(remote: Column, alias_host: Column | None = None) -> Column:
    """owner/repo or host/owner/repo, null where the grammar refuses the remote.

    ``alias_host`` is the looked-up host name of an ssh alias (left-joined), used only for
    ssh transports and never for a host that is known already.
    """
    host, path, ssh = remote_parts(remote)
    parts = F.array_remove(F.split(F.regexp_replace(path, r"\.git$", ""), "/"), "")
    owner, repo = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    known = F.lower(host).isin(*UNQUALIFIED)
    if alias_host is not None:
        usable = ssh & ~known & host.rlike(HOSTNAME) & alias_host.rlike(HOSTNAME)
        host = F.when(F.coalesce(usable, F.lit(False)), alias_host).otherwise(host)
    host = F.lower(host)
    short = host.isin(*UNQUALIFIED)
    slug = F.when(short, F.concat_ws("/", owner, repo)).otherwise(F.concat_ws("/", host, owner, repo))
    ok = (F.size(parts) == 2) & owner.rlike(OWNER) & repo.rlike(REPO) & ~repo.isin(".", "..") & (short | host.rlike(HOSTNAME)) & (F.length(slug) <= SLUG_MAX)
    return F.when(ok, slug)


def local_slug(path: Column) -> Column:
    return F.concat(F.lit("local:"), F.substr(F.sha2(path.cast("binary"), 256), F.lit(1), F.lit(12)))


def resolve_repo_slug(remote: Column, path: Column, alias_host: Column | None = None) -> Column:
    return F.coalesce(parse_remote_slug(remote, alias_host), local_slug(path))


def with_repo_slug(repos: DataFrame, aliases: DataFrame | None = None, rules: list[tuple[list[str], str]] | None = None) -> DataFrame:
    """Adds repo_slug to (remote, path).

    An ssh host that isn't known by itself may be an alias: ``aliases`` is (alias, hostname),
    joined where rows need it; ``rules`` are those of a client's configuration (``ssh_rules``),
    for hosts that no alias names.
    """
    if aliases is None and not rules:
        return repos.withColumn("repo_slug", resolve_repo_slug(F.col("remote"), F.col("path")))
    host, _, ssh = remote_parts(F.col("remote"))
    needs = F.when(ssh & ~F.lower(host).isin(*UNQUALIFIED), host)
    out = repos.withColumn("alias_", needs).withColumn("hostname_", F.lit(None).cast("string"))
    if aliases is not None:
        out = out.drop("hostname_").join(aliases.select(F.col("alias").alias("alias_"), F.col("hostname").alias("hostname_")), "alias_", "left")
    if rules:
        out = out.withColumn("hostname_", F.coalesce("hostname_", ssh_hostname(F.col("alias_"), rules)))
    return out.withColumn("repo_slug", resolve_repo_slug(F.col("remote"), F.col("path"), F.col("hostname_"))).drop("alias_", "hostname_")


#: Rules of one configuration at most: they are evaluated one after the other on every row.
MOST_RULES = 1000


def ssh_rules(config: str) -> list[tuple[list[str], str]]:
    """(patterns, host name) of a client configuration's blocks that set one, in order.

    Keywords have no case; a value may stand behind ``=`` and in quotes.  What precedes the
    first block holds for every host; of several names in a block the first counts.  A
    ``Match all`` block holds for every host, any other ``Match`` depends on more than the
    host and is left out.
    """
    out: list[tuple[list[str], str]] = []
    patterns: list[str] | None = ["*"]
    for line in config.splitlines():
        found = re.match(r"\s*([A-Za-z]+)(?:\s*=\s*|\s+)(.*?)\s*$", line)
        if not found or line.lstrip().startswith("#"):
            continue
        word, values = found[1].lower(), re.findall(r'"([^"]*)"|(\S+)', found[2])
        values = [a or b for a, b in values]
        if word == "host":
            patterns = values
        elif word == "match":
            patterns = ["*"] if [v.lower() for v in values] == ["all"] else None
        elif word == "hostname" and patterns and values:
            out.append((patterns, values[0]))
            patterns = None
    if len(out) > MOST_RULES:
        raise ValueError(f"{len(out)} rules; at most {MOST_RULES} are evaluated as one column")
    return out


def _glob(pattern: str) -> str:
    signs = {"*": ".*", "?": "."}
    return "".join(signs.get(c) or (c if c.isalnum() else "\\" + c) for c in pattern)


def ssh_hostname(host: Column, rules: list[tuple[list[str], str]]) -> Column:
    """The host name that the first fitting rule gives a host, null without one.

    A rule fits if one of its patterns does (``*`` any signs, ``?`` one) and none that begins
    with ``!``.  In the name, ``%h`` is the host and ``%%`` a percent sign.
    """
    if not rules:
        return F.lit(None).cast("string")

    def rule(patterns: list[str], name: str) -> Column:
        wanted = "|".join(_glob(p) for p in patterns if not p.startswith("!"))
        unwanted = "|".join(_glob(p[1:]) for p in patterns if p.startswith("!"))
        # a list of nothing but exceptions fits no host
        return F.struct(F.lit(f"^(?:{wanted})$" if wanted else "$^x").alias("wanted"), F.lit(f"^(?:{unwanted})$" if unwanted else "$^x").alias("unwanted"), F.lit(name).alias("name"))

    table = F.array(*(rule(p, n) for p, n in rules))
    fits = F.filter(table, lambda r: F.rlike(host, r["wanted"]) & ~F.rlike(host, r["unwanted"]))
    name = F.get(fits, F.lit(0))["name"]
    halves = F.transform(F.split(name, "%%"), lambda x: F.replace(x, F.lit("%h"), host))
    return F.array_join(halves, "%")


def sanitise(value: Column) -> Column:
    """A file name component: other signs become _, at most 128, never empty or only dots."""
    cut = F.substr(F.regexp_replace(value, "[^A-Za-z0-9._-]", "_"), F.lit(1), F.lit(128))
    return F.when((cut == "") | cut.rlike(r"^\.+$"), "_").otherwise(cut)


def repo_digest(repo_key: Column) -> Column:
    return F.substr(F.sha2(repo_key.cast("binary"), 256), F.lit(1), F.lit(32))


def is_inside(root: Column, candidate: Column) -> Column:
    """Equal, or below root; both are canonical paths, an unresolved one is outside."""
    below = candidate.startswith(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/")))
    return F.coalesce((candidate == root) | below, F.lit(False))


def is_sha(value: Column) -> Column:
    return value.rlike(SHA)


def is_allowed_ingest_url(url: Column) -> Column:
    """https anywhere, http on a loopback host only; anything else is refused."""
    scheme, host = F.lower(F.regexp_extract(url, _URL, 1)), F.lower(F.regexp_extract(url, _URL, 2))
    loopback = host.isin("localhost", "127.0.0.1") | F.lower(url).rlike(r"^http://(?:[^/?#]*@)?\[::1\]")
    return F.coalesce(((scheme == "https") & (host != "")) | ((scheme == "http") & loopback), F.lit(False))


def ingest_url(override: Column, default: str) -> Column:
    """The override if it is allowed; a refused one is null and never falls back to the default."""
    trimmed = F.trim(override)
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(default)).when(is_allowed_ingest_url(trimmed), trimmed)


def subagent_file_key(path: Column) -> Column:
    """agent-* base name without .jsonl, 1 to 128 characters, else null."""
    key = F.regexp_extract(path, r"(?:^|/)(agent-[^/]*)\.jsonl$", 1)
    return F.when(F.length(key).between(1, 128), key)


def subagents_dir(transcript: Column) -> Column:
    """The folder beside a transcript that holds its sub-agents' transcripts."""
    return F.when(transcript.endswith(".jsonl"), F.concat(F.regexp_replace(transcript, r"\.jsonl$", ""), F.lit("/subagents")))


def project_dir_name(path: Column) -> Column:
    return F.translate(path, "/.", "--")
