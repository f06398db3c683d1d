"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Everything runs as DataFrame expressions.  Four base kinds (email, ip, card, phone) are
found by patterns with checks and always stay.  Further candidates (secrets, obfuscated
mail addresses, phone numbers without a plus) are voted on by six labelers, each for,
against or abstaining, by rules of their own for each kind: words before that announce
personal data or something else (a commit, a checksum, an order), the signs around, the
shape, the variety of signs, the changes between letters and digits (digits in base 16 tell
nothing by these two), and what is known not to be personal: paths, dated slugs, words
joined by dashes, numbers right behind a word for something else, a sentence's end where an
address should go on.  The last ones are the negative evidence.  Votes are counted
per pattern (at most 1,458 rows, whatever the input); expectation-maximisation, from a
stated prior that the corpus moves, estimates each labeler's reliability, and a logistic
span classifier is trained on the soft labels of all patterns that could occur, those that
did weighing most.  Base spans take no part in either: all true, they would teach nothing.

The patterns below start only where a leftmost match can start and are possessive where
nothing follows, so that long runs cost linear time and no stack.

Defined cases: null text counts as empty; equal texts have equal spans; offsets are code
points, ends exclusive; a candidate that overlaps a base span is dropped; keys of fewer than
20 signs are no candidates; rows that repeat an id or a text are judged alike; an empty
table leaves the prior as it is; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm.common import table
from provenir.runtime import materialize

KINDS = ("email", "ip", "card", "phone", "secret")
#: Java patterns of the base kinds; \G continues right behind the match before.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[ -]?+[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Further candidates: hexadecimal secrets, keys of letters and digits, mail addresses spelled out, phones without a plus.
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
KEY = r"(?<![0-9A-Za-z_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[0-9A-Za-z_+/-]{20,}+"
SPELLED = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]++(?: ?[\[(.] ?(?:dot|DOT)? ?[\])]? ?[A-Za-z0-9-]{2,}+)++"
LOCAL = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
EXTRA = f"(?:{SECRET})|(?:{SPELLED})|(?:{LOCAL})|(?:{KEY})"
#: Words that announce personal data of a kind (email, phone, secret), and words that announce something else.
ANNOUNCE = {
    0: ("address", "contact", "email", "mail", "mailto", "reach", "write"),
    3: ("call", "cell", "contact", "dial", "fax", "mobile", "phone", "ring", "sms", "tel", "telephone", "text", "whatsapp"),
    4: ("api", "apikey", "auth", "authorization", "bearer", "credential", "credentials", "key", "passphrase", "passwd", "password", "private", "pwd", "secret", "token"),
}
OTHER = (
    "article", "at", "blob", "checksum", "chapter", "class", "commit", "digest", "docs", "etag", "figure", "file", "folder", "function", "hash", "invoice", "isbn", "issue",
    "item", "md", "merge", "order", "page", "parent", "part", "path", "post", "ref", "rev", "revision", "serial", "sha", "slug", "tree", "url", "uuid", "version",
)
DOMAINS = "com|org|net|edu|gov|info|io|co|de|fr|es|uk|it|eu|ch|at|nl"
LABELERS, CONTEXT, DECIDE, ROUNDS, CUT, NEAR = 6, 40, 0.5, 60, 8192, 3
FOR, AGAINST, ABSTAIN = 1, 0, 2
#: Prior reliabilities: chances of a vote (against, for, abstain) of a false and of a true candidate.
PRIOR = (
    ((0.40, 0.03, 0.57), (0.02, 0.55, 0.43)),
    ((0.30, 0.10, 0.60), (0.05, 0.50, 0.45)),
    ((0.60, 0.15, 0.25), (0.20, 0.55, 0.25)),
    ((0.40, 0.35, 0.25), (0.05, 0.70, 0.25)),
    ((0.50, 0.25, 0.25), (0.10, 0.65, 0.25)),
    ((0.50, 0.01, 0.49), (0.01, 0.01, 0.98)),
)
#: Prior share of true candidates; weight of the priors of a labeler and of that share, in patterns.
SHARE, STRENGTH, SHARE_STRENGTH = 0.3, 20.0, 100.0
_SPAN = "struct<start:int,kind:int,end:int,text:string,before:string,after:string>"
_NONE = f"array<{_SPAN}>"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunks(x: Column) -> Column:
    """An array cut into about as many chunks as each has entries: walks over it that append or
    compare then cost the power 1.5 of its size, not the square."""
    width = F.greatest(F.ceil(F.sqrt(F.size(x))), F.lit(1)).cast("int")
    most = F.greatest(F.ceil(F.size(x) / width).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), most), lambda k: F.slice(x, k * width + 1, width))


def running(sizes: Column) -> Column:
    """Sums of all entries up to each one, itself included."""
    add = lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))
    zero = F.array(F.lit(0))

    def whole(inner: Column) -> Column:
        before = F.aggregate(F.transform(inner, lambda p: F.element_at(p, -1)), zero, add)
        return F.flatten(F.zip_with(inner, F.slice(before, F.lit(1), F.size(inner)), lambda p, o: F.transform(F.slice(p, F.lit(2), F.size(p)), lambda v: v + o)))

    return _let(sizes, lambda x: _let(F.transform(_chunks(x), lambda c: F.aggregate(c, zero, add)), whole))


def _found(text: Column, pattern: str, kind: Column | int, trigger: Column) -> Column:
    """Leftmost non-overlapping matches as spans: the text between matches gives the offsets.

    What stands before and after a match is read off its neighbours as well: walking to a
    place in the text would cost the text's length for every match.
    """
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    none = F.lit("")
    parts = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def spans(x: Column) -> Column:
        between = lambda i: F.coalesce(F.get(x["p"], i), none)
        match = lambda i: F.coalesce(F.get(x["m"], i), none)
        ends = running(F.transform(x["m"], lambda m, i: F.length(between(i)) + F.length(m)))
        before = lambda i: F.right(F.concat(F.when(i > 0, match(i - 1)).otherwise(none), between(i)), F.lit(CONTEXT))
        after = lambda i: F.left(F.concat(between(i + 1), match(i + 1)), F.lit(1))
        span = lambda m, end, i: F.struct((end - F.length(m)).alias("start"), kind.alias("kind"), end.alias("end"), m.alias("text"), before(i).alias("before"), after(i).alias("after"))
        return _let(ends, lambda e: F.transform(x["m"], lambda m, i: span(m, F.get(e, i), i)))

    return F.when(trigger, _let(parts, spans)).otherwise(F.array().cast(_NONE))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is divisible by 10."""
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _ip_ok(text: Column) -> Column:
    def part(x: Column) -> Column:
        short = F.regexp_replace(x, "^0+(?=.)", "")
        return F.when(F.length(short) > 3, False).otherwise(F.substr(short, F.lit(1), F.lit(3)).cast("int") <= 255)

    return F.forall(F.split(text, r"\."), part)


def base_spans(text: Column) -> Column:
    """All valid spans of the base kinds, by start and then kind."""
    digit = text.rlike("[0-9]")
    card = lambda x: F.length(_digits(x["text"])).between(12, 19)
    emails = _found(text, EMAIL, 0, F.contains(text, F.lit("@")))
    ips = F.filter(_found(text, IP, 1, digit), lambda x: _ip_ok(x["text"]))
    cards = F.filter(_found(text, CARD, 2, digit), lambda x: F.when(card(x), luhn(_digits(x["text"]))).otherwise(False))
    phones = F.filter(_found(text, PHONE, 3, F.contains(text, F.lit("+"))), lambda x: F.length(_digits(x["text"])).between(9, 15))
    return F.array_sort(F.concat(emails, ips, cards, phones))


def extra_spans(text: Column) -> Column:
    kind = lambda m: F.when(m.rlike("^[0-9A-Fa-f]{32,}$"), 4).when(m.rlike("[\\[(] ?(?:at|AT)"), 0).when(m.rlike(f"^{LOCAL}$"), 3).otherwise(4)
    raw = _found(text, EXTRA, -1, text.rlike("[0-9]|[\\[(] ?(?:at|AT)"))
    return F.transform(raw, lambda x: x.withField("kind", kind(x["text"])))


def _labels(x: Column) -> list[Column]:
    """The labelers' votes on one further candidate."""
    m, kind, before, after = x["text"], x["kind"], x["before"], x["after"]
    vote = lambda good, bad: F.when(bad, AGAINST).when(good, FOR).otherwise(ABSTAIN)
    by_kind = lambda email, phone, secret: F.when(kind == 0, email).when(kind == 3, phone).otherwise(secret)
    words = F.regexp_extract_all(F.lower(before), F.lit("[a-z]+"), F.lit(0))
    near = F.slice(words, F.greatest(F.size(words) - (NEAR - 1), F.lit(1)), NEAR)
    named = lambda names: F.exists(near, lambda w: w.isin(*names))
    announced = by_kind(named(ANNOUNCE[0]), named(ANNOUNCE[3]), named(ANNOUNCE[4]))
    context = F.when(announced & ~named(OTHER), FOR).when(named(OTHER) & ~announced, AGAINST).otherwise(ABSTAIN)
    quoted = before.rlike("[\"']$") & after.rlike("^[\"']")
    around = vote(before.rlike("[=:<] ?$") | quoted | (before.rlike("[=:] ?[\"']$")), before.rlike("[/\\\\#@.$]$") | after.rlike("^[/\\\\@]"))
    digits, letters = _digits(m), F.regexp_replace(m, "[^A-Za-z]", "")
    hexed = m.rlike("^[0-9A-Fa-f]+$")
    joined = m.rlike("(?:^|[-_/])[a-z]{3,}[-_/](?:[a-z0-9.]*[-_/])*[a-z]{3,}(?:$|[-_/])")
    mixed = m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    spelled = m.rlike("(?i)[\\[(] ?dot ?[\\])]| dot ") | m.rlike(f"[a-z0-9-][.](?:[a-z0-9-]+[.])*(?:{DOMAINS})$")
    even = m.rlike(r"^\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}$")
    shape = by_kind(vote(spelled, m.rlike("[.] [A-Z]")), vote(even, ~even), vote(mixed | m.rlike("^[A-Z]{2,}[A-Z0-9]*[0-9]") | m.rlike("^[a-z]{2,}_[a-z]+_[0-9A-Za-z]"), hexed | joined))
    kinds = F.size(F.array_distinct(F.split(m, "")))
    variety = by_kind(vote(kinds >= 8, kinds < 5), vote(F.size(F.array_distinct(F.split(digits, ""))) >= 4, F.size(F.array_distinct(F.split(digits, ""))) < 3), vote((kinds >= 10) & ~joined & ~hexed, (kinds < 8) | joined))
    # runs of letters and of digits, without the signs between them
    runs = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[^A-Za-z0-9]", ""), "[A-Za-z]+", "a"), "[0-9]+", "0"))
    tail = m.rlike(f"(?i)(?:[.]|dot[\\])]? ?)(?:{DOMAINS})$")
    changes = by_kind(vote(tail, ~tail & m.rlike("[.] [A-Z]|[^A-Za-z][A-Za-z]{1,2}$")), vote(~digits.rlike("^[01]"), digits.rlike("^0{3}")), vote(((runs >= 5) & ~hexed) | (m.rlike("[a-z][A-Z]") & (runs >= 3)), (runs <= 2) | (F.length(letters) >= 0.9 * F.length(m))))
    path = m.rlike("^/?(?:[a-z][a-z._-]*[0-9]{0,2}/){2,}[A-Za-z0-9._-]*$")
    named_so = F.exists(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), lambda w: w.isin(*OTHER)) & ~announced
    known = by_kind(m.rlike("[.] [A-Z]"), named_so, (hexed & named_so) | path | m.rlike("^[0-9]{4}[-_/][0-9]{2}[-_/][0-9]{2}(?:[-_/]|$)") | (joined & ~mixed & ~m.rlike("[0-9][a-z]+[0-9]")))
    return [context, around, shape, variety, changes, F.when(known, AGAINST).otherwise(ABSTAIN)]


def voted(spans: Column) -> Column:
    """Each span with its labelers' votes (0 against, 1 for, 2 abstains)."""
    votes = lambda x: F.struct(*(v.alias(f"v{k}") for k, v in enumerate(_labels(x))))
    return F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"], votes(x).alias("votes")))


def placed(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"]))


def candidates(docs: DataFrame) -> DataFrame:
    """Adds ``base``, an array of spans, and ``extra``, one of voted spans, to rows with a ``text``."""
    rows = docs.withColumn("text_", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"base_": base_spans(F.col("text_")), "extra_": extra_spans(F.col("text_"))})
    extra = F.col("extra_")
    meets = lambda x, y: (y["start"] < x["end"]) & (x["start"] < y["end"])
    bounded = lambda c: F.struct(F.array_min(F.transform(c, lambda y: y["start"])).alias("start"), F.array_max(F.transform(c, lambda y: y["end"])).alias("end"), c.alias("spans"))
    apart = lambda cs: F.filter(extra, lambda x: ~F.exists(cs, lambda c: meets(x, c) & F.exists(c["spans"], lambda y: meets(x, y))))
    near = F.when(F.size("base_") > 0, F.transform(_chunks(F.col("base_")), bounded)).otherwise(F.array().cast(f"array<struct<start:int,end:int,spans:{_NONE}>>"))
    clear = F.when(F.size(extra) > 0, _let(near, apart)).otherwise(extra)
    return rows.withColumns({"base": placed(F.col("base_")), "extra": voted(clear)}).drop("text_", "base_", "extra_")


def vote_patterns(found: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """((kind, v0..v5), count) over all further candidates: at most 3 * 3**5 * 2 patterns."""
    flat = found.select(F.explode("extra").alias("s")).select("s.kind", "s.votes.*")
    return sorted((tuple(r[:-1]), r[-1]) for r in flat.groupBy(*flat.columns).count().collect())


Tables = list[list[list[float]]]


def posterior(votes: tuple[int, ...], share: float, tables: Tables) -> float:
    """Probability that a candidate with these votes is true; a known structure makes it false."""
    if votes[LABELERS - 1] == AGAINST:
        return 0.0
    odds = math.log(share / (1 - share)) + sum(math.log(tables[k][1][x] / tables[k][0][x]) for k, x in enumerate(votes))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], rounds: int = ROUNDS, strength: float = STRENGTH, share_strength: float = SHARE_STRENGTH) -> tuple[float, Tables]:
    """EM of the two-class labeler model: (share of true candidates, chances tables[labeler][class][vote]).

    patterns are (kind and votes, weight).  The prior counts as ``strength`` candidates of
    each class, so that a corpus of one pattern can't overturn what the labelers mean.
    """
    share, tables = SHARE, [[list(row) for row in labeler] for labeler in PRIOR]
    for _ in range(rounds):
        post = [posterior(p[1:], share, tables) for p, _ in patterns]
        mass = [sum(n * (y if c else 1 - y) for (_, n), y in zip(patterns, post, strict=True)) for c in (0, 1)]
        share = (share_strength * SHARE + mass[1]) / (share_strength + sum(mass)) if share_strength + sum(mass) else SHARE
        share = min(0.99, max(0.01, share))
        tables = [[[max(1e-6, strength * x) for x in row] for row in labeler] for labeler in PRIOR]
        for (p, n), y in zip(patterns, post, strict=True):
            for k, x in enumerate(p[1:]):
                tables[k][1][x] += n * y
                tables[k][0][x] += n * (1 - y)
        tables = [[[x / sum(row) for x in row] for row in labeler] for labeler in tables]
    return share, tables


def all_patterns() -> list[tuple[int, ...]]:
    """Every pattern that a candidate can have."""
    return [(kind, *v, last) for kind in ANNOUNCE for v in product((AGAINST, FOR, ABSTAIN), repeat=LABELERS - 1) for last in (AGAINST, ABSTAIN)]


def _features(pattern: tuple[int, ...]) -> list[str]:
    kind, *votes = pattern
    return ["bias", f"kind={kind}", *(f"v{k}={x}" for k, x in enumerate(votes))]


def train_classifier(patterns: list[tuple[tuple[int, ...], float]], share: float, tables: Tables, steps: int = 400) -> dict[str, float]:
    """Logistic weights of one-hot span features, fitted to the soft labels of all patterns.

    A pattern weighs what its kind's share of the model expects of it, and what was seen of it.
    """
    seen = dict(patterns)
    rows = all_patterns()
    names = sorted({x for p in rows for x in _features(p)})
    at = {x: i for i, x in enumerate(names)}
    chance = lambda votes, c: math.prod(tables[k][c][x] for k, x in enumerate(votes))
    weight = np.array([share * chance(p[1:], 1) + (1 - share) * chance(p[1:], 0) + 1e-4 for p in rows])
    weight = weight / weight.sum()
    if seen:
        told = np.array([seen.get(p, 0.0) for p in rows])
        weight = 0.5 * weight + 0.5 * told / told.sum()
    label = np.array([posterior(p[1:], share, tables) for p in rows])
    x = np.zeros((len(rows), len(names)))
    for i, p in enumerate(rows):
        x[i, [at[f] for f in _features(p)]] = 1
    w = np.zeros(len(names))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        w = 0.9995 * w + 4.0 * (x.T @ (weight * (label - p)))
    return {name: round(float(v), 6) for name, v in zip(names, w, strict=True)}


def fit(found: DataFrame) -> dict[str, float]:
    """Weights of the span classifier from all candidates of ``found``; a pattern weighs the log of its count."""
    patterns = [(p, math.log1p(n)) for p, n in vote_patterns(found)]
    return train_classifier(patterns, *reliabilities(patterns))


def probability(span: Column, weights: dict[str, float]) -> Column:
    def pick(name: str, value: Column) -> Column:
        own = [(x.rpartition("=")[2], w) for x, w in weights.items() if x.startswith(f"{name}=")]
        out = F.lit(0.0)
        for x, w in own:
            out = F.when(value == int(x), w).otherwise(out)
        return out

    total = F.lit(weights.get("bias", -20.0)) + pick("kind", span["kind"])
    for k in range(LABELERS):
        total = total + pick(f"v{k}", span["votes"][f"v{k}"])
    return 1 / (1 + F.exp(-total))


def detect(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds ``spans``: the base spans and the candidates that the classifier accepts."""
    slim = lambda x: F.struct(x["start"], x["kind"], x["end"])
    base = F.transform("base", slim)
    added = F.transform(F.filter("extra", lambda x: probability(x, weights) >= DECIDE), slim)
    return found.withColumns({"base": base, "spans": F.array_sort(F.concat(base, added))}).drop("extra")


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined in the array's order."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlaps count once.

    A place in a text is found by walking to it, so the text is cut at every ``CUT`` code
    points first, and each part is rewritten by the spans that touch it.
    """
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)

    def part(piece: Column, i: Column, spans: Column) -> Column:
        first = i * CUT
        end = first + F.length(piece)
        cut = lambda a, b: F.substr(piece, a - first + 1, F.greatest(b - a, F.lit(0)))

        def step(acc: Column, x: Column) -> Column:
            mark = F.when(x["start"] >= acc["at"], F.concat(F.lit("["), F.upper(name(x["kind"])), F.lit("]"))).otherwise("")
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], cut(acc["at"], x["start"]), mark).alias("out"))

        own = F.filter(spans, lambda x: (x["start"] < end) & (x["end"] > first))
        start = F.struct(first.alias("at"), F.lit("").alias("out"))
        return F.when(F.size(own) == 0, piece).otherwise(F.aggregate(own, start, step, lambda acc: F.concat(acc["out"], cut(acc["at"], end))))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    whole = _let(spans, lambda s: F.array_join(F.transform(pieces, lambda p, i: part(p, i, s)), ""))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(candidates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "spans")
    spans = detect(found, fit(found))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return spans.select("doc_id", *counts, F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))
