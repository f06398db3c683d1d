"""One pass of an automaton over each text against the pattern that each phrase stands for."""

import random
import time

import pytest

from provenir.operators import claims, manifest


def rows_of(df):
    return sorted((r["k"], r["phrase"]) for r in df.collect())


def canonical(sign):
    """How one sign is compared where case doesn't count."""
    upper = sign.upper()
    return sign if len(upper) != 1 or (ord(sign) > 127 and ord(upper) < 128) else upper


def plain(texts, phrases):
    out = set()
    for k, surface, text in texts:
        for phrase, surfaces in phrases:
            if text is None or phrase is None or surface not in (surfaces or []) or surface is None:
                continue
            for at in range(len(text) - len(phrase) + 1):
                same = all(canonical(x) == canonical(y) for x, y in zip(text[at:], phrase, strict=False))
                if same and (at == 0 or not (text[at - 1].isascii() and (text[at - 1].isalnum() or text[at - 1] == "_"))):
                    out.add((k, phrase))
    return sorted(out)


@pytest.mark.parametrize("signs_", [10**6, 3])
def test_scan_equals_every_place_of_every_phrase(spark, monkeypatch, signs_):
    monkeypatch.setattr(claims, "SIGNS", signs_)
    rng = random.Random(3)
    signs = "abAB _.éſKİı😀ßẞ-\n"
    texts = [(k, rng.choice(["x", "y", None]), "".join(rng.choice(signs) for _ in range(rng.randrange(25)))) for k in range(400)] + [(900, "x", None), (901, "x", "")]
    phrases = [("".join(rng.choice(signs) for _ in range(rng.randint(1, 3))), rng.choice([["x"], ["y"], ["x", "y"], [], None])) for _ in range(150)]
    phrases += [("", ["x"]), (None, ["x"]), ("s", ["x", "y"]), ("k", ["x"]), ("İ", ["x"]), ("ß", ["y"])]
    t = spark.createDataFrame(texts, "k int, surface string, text string")
    p = spark.createDataFrame(phrases, "phrase string, surfaces array<string>")
    want = plain(texts, phrases)
    assert rows_of(claims.scan(t, p)) == want and len(want) > 300


def test_joined_phrases_equal_the_automaton(spark, monkeypatch):
    texts = spark.createDataFrame([(k, "x", f"Word{k} alpha beta-{k % 3} gamma. proves it, disproves") for k in range(40)], "k int, surface string, text string")
    phrases = spark.createDataFrame([(w, ["x"]) for w in ("alpha BETA", "beta-1", "prove", "word1", "gamma.", "--", "a b c")], "phrase string, surfaces array<string>")
    want = rows_of(claims.scan(texts, phrases))
    monkeypatch.setattr(claims, "SIGNS", 3)
    assert rows_of(claims.scan(texts, phrases)) == want and len(want) > 80


def test_a_long_text_takes_linear_time():
    words = tuple(f"PHRASE NUMBER {k}" for k in range(20_000))
    machine = claims.automaton(words)
    text = " ".join(f"some phrase number {k * 7}x" for k in range(400_000))  # 10 MB
    began = time.perf_counter()
    assert len(claims.found_in(text, words, machine)) == 20_000
    assert time.perf_counter() - began < 20


def test_many_pins_at_once(spark):
    rng = random.Random(1)
    sha = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    pins = [sha() for _ in range(300)]
    lines = [("p", k, rng.choice(["", "see ", "ff"]) + rng.choice([*pins[:5], sha()])[: rng.choice([6, 7, 12, 40])] + rng.choice(["", " end", "0"])) for k in range(400)]
    lines += [("q", 0, None), ("q", 1, ""), ("q", 2, pins[7].upper()), ("q", 3, pins[8] + pins[9] + pins[8]), ("q", 4, "a" * 50_000)]
    df = spark.createDataFrame(lines, "path string, line_no int, line string")
    found = manifest.pinned_mentions(df, spark.createDataFrame([(p,) for p in [*pins, pins[0], "short", None]], "sha string"))
    want = sorted((path, n, p) for path, n, line in lines for p in set(pins) if line and p[:7] in line)
    assert sorted((r["path"], r["line_no"], r["sha"]) for r in found.collect()) == want and len(want) > 100
