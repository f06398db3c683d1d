"""Language identification by a bidirectional gated recurrent network over bytes.

The network (GRU, one per direction, byte embeddings folded into the input weights) labels
every byte position of every window of a text; a document's probabilities are the mean of
its positions' probabilities.  It is trained on the driver in numpy by backpropagation
through time, on the whole texts of a sample of rows: about ``per_language`` of each
language and about ``sample`` in all, at least one of each language however many there are.
Scoring reads whole texts.

Defined cases: a text without a letter (Unicode category L), an empty or a null one gives
``und`` with score 0; a table without labelled training rows gives ``und`` everywhere; ties
go to the first language by code point; rows with a null id and repeated rows are trained
on and scored like any other; a window holds ``WINDOW`` bytes, the last one is masked.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm.common import crc_mod, small_batches, table, utf8

WINDOW, HIDDEN, PAD = 128, 12, 256
PER_LANGUAGE, SAMPLE, STEPS, BATCH = 600, 20_000, 320, 256
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: Windows scored at a time, times the languages: bounds the memory of position probabilities.
_ROWS = 16_384


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(unicodedata.category(c)[0] == "L" for c in text.decode("utf-8", "replace"))


@dataclass
class ByteGru:
    """Weights: for each direction X (byte, 3H), U (H, 2H), N (H, H); output V (2H, K), c."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> ByteGru:
        rng = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}
        for d in "fb":
            w["X" + d] = rng.normal(0, 0.3, (PAD + 1, 3 * hidden))
            w["U" + d] = rng.normal(0, 0.5 / hidden**0.5, (hidden, 2 * hidden))
            w["N" + d] = rng.normal(0, 1 / hidden**0.5, (hidden, hidden))
        w["V"] = rng.normal(0, 0.3, (2 * hidden, len(languages)))
        w["c"] = np.zeros(len(languages))
        return ByteGru(languages, {k: v.astype(np.float32) for k, v in w.items()})

    def states(self, steps: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states (T, B, H) for bytes (T, B); gates are 0.5 + 0.5 tanh."""
        X, U, N = (self.weights[k + d] for k in "XUN")
        H = len(U)
        out = np.empty((*steps.shape, H), np.float32)
        h = np.zeros((steps.shape[1], H), np.float32)
        kept = []
        order = range(len(steps)) if d == "f" else range(len(steps) - 1, -1, -1)
        for t in order:
            x = X.take(steps[t], 0)
            g = h @ U
            g += x[:, : 2 * H]
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            rh = g[:, H:] * h
            n = rh @ N
            n += x[:, 2 * H :]
            np.tanh(n, out=n)
            if keep:
                kept.append((t, h, g, rh, n))
            h = h + g[:, :H] * (n - h)
            out[t] = h
        return out, kept

    def positions(self, steps: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, K) of every position."""
        w, H = self.weights, len(self.weights["Uf"])
        logits = self.states(steps, "f")[0] @ w["V"][:H]
        logits += self.states(steps, "b")[0] @ w["V"][H:]
        logits += w["c"]
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def gradients(self, steps: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over unmasked positions, and its gradients through time."""
        w, H = self.weights, len(self.weights["Uf"])
        hf, kf = self.states(steps, "f", True)
        hb, kb = self.states(steps, "b", True)
        both = np.concatenate([hf, hb], -1)
        logits = both @ w["V"] + w["c"]
        logits -= logits.max(-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(-1, keepdims=True)
        mask = (steps != PAD).astype(np.float32)
        total = max(float(mask.sum()), 1.0)
        rows = np.arange(steps.shape[1])
        loss = -float((np.log(p[:, rows, labels] + 1e-9) * mask).sum()) / total
        p[:, rows, labels] -= 1
        p *= (mask / total)[..., None]
        grads = {"V": both.reshape(-1, 2 * H).T @ p.reshape(-1, p.shape[-1]), "c": p.sum((0, 1))}
        dboth = p @ w["V"].T
        for d, kept, dout in (("f", kf, dboth[..., :H]), ("b", kb, dboth[..., H:])):
            U, N = w["U" + d], w["N" + d]
            dU, dN = np.zeros_like(U), np.zeros_like(N)
            dx = np.empty((*steps.shape, 3 * H), np.float32)
            dh = np.zeros((steps.shape[1], H), np.float32)
            for t, h, g, rh, n in reversed(kept):
                dh = dh + dout[t]
                z, r = g[:, :H], g[:, H:]
                dn = dh * z * (1 - n * n)
                drh = dn @ N.T
                dg = np.concatenate([dh * (n - h), drh * h], 1) * (2 * g * (1 - g))
                dN += rh.T @ dn
                dU += h.T @ dg
                dx[t, :, : 2 * H], dx[t, :, 2 * H :] = dg, dn
                dh = dh * (1 - z) + drh * r + dg @ U.T
            flat = steps.ravel()
            order = np.argsort(flat, kind="stable")
            at = np.flatnonzero(np.diff(flat[order], prepend=-1))
            dX = np.zeros_like(w["X" + d])
            dX[flat[order][at]] = np.add.reduceat(dx.reshape(-1, 3 * H)[order], at, 0)
            grads |= {"X" + d: dX, "U" + d: dU, "N" + d: dN}
        return loss, grads

    def fit(self, windows: np.ndarray, firsts: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam on batches of windows (n, WINDOW), a random one of a random document each.

        ``firsts`` are the places of the documents' first windows, ``labels`` their languages.
        """
        rng = np.random.default_rng(seed)
        sizes = np.diff(firsts, append=len(windows))
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses = []
        for i in range(1, steps + 1):
            doc = rng.integers(0, len(firsts), batch)
            take = firsts[doc] + (rng.random(batch) * sizes[doc]).astype(np.int64)
            loss, grads = self.gradients(np.ascontiguousarray(windows[take].T), labels[doc])
            losses.append(loss)
            norm = sum(float((g * g).sum()) for g in grads.values()) ** 0.5
            lr = rate * min(1.0, 2 * (1 - i / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                self.weights[k] -= (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v2[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return losses

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Pooled probabilities (documents, K) of whole texts; empty texts give zeros."""
        windows, first = windows_of(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(first, append=len(windows)))
        out = np.zeros((len(texts), len(self.languages)))
        rows = max(64, _ROWS // max(8, len(self.languages)))
        for i in range(0, len(windows), rows):
            steps = np.ascontiguousarray(windows[i : i + rows].T)
            p = self.positions(steps)
            p *= (steps != PAD)[..., None]
            np.add.at(out, owner[i : i + rows], p.sum(0))
        return out / np.maximum(list(map(len, texts)), 1)[:, None]


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all windows of whole texts, place of each text's first one); the last of a text is masked."""
    counts = -(-np.array([len(t) for t in texts], np.int64) // WINDOW)
    first = np.cumsum(counts) - counts
    flat = np.full(int(counts.sum()) * WINDOW, PAD, np.int16)
    for text, k in zip(texts, first.tolist(), strict=True):
        flat[k * WINDOW : k * WINDOW + len(text)] = np.frombuffer(text, np.uint8)
    return flat.reshape(-1, WINDOW), first


def train(docs: DataFrame, id_col: str = "doc_id", per_language: int = PER_LANGUAGE, sample: int = SAMPLE, steps: int = STEPS) -> ByteGru | None:
    """Fit on a bounded sample of the rows with a language and a text that isn't empty, chosen
    by a hash of id and text; None if there is no such row."""
    rows = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select(id_col, "lang", "text")
    # one row a language goes to the driver
    counts = {r["lang"]: (r["n"], r["least"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(_draw(id_col)).alias("least")).collect()}
    if not counts:
        return None
    each = min(per_language, max(1, sample // len(counts)))
    bounds = docs.sparkSession.createDataFrame([(k, max(least, int(min(1.0, each / n) * (1 << 30)))) for k, (n, least) in counts.items()], "lang string, bound long")
    # one row a language, as in the model itself, which is broadcast too
    chosen = rows.join(F.broadcast(bounds), "lang").filter(_draw(id_col) <= F.col("bound")).select("lang", id_col, "text").limit(2 * each * len(counts))
    found = sorted((r["lang"], r[id_col] or 0, r["text"].encode()) for r in chosen.collect())
    languages = sorted(counts)
    place = {x: k for k, x in enumerate(languages)}
    net = ByteGru.fresh(languages)
    net.fit(*windows_of([x[2] for x in found]), np.array([place[x[0]] for x in found]), steps)
    return net


def _draw(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("lang"), id_col, "text"), F.lit(1 << 30))


def predict(docs: DataFrame, net: ByteGru | None, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, *keep) for every row; the text alone decides."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(net)  # about 100 KB, and 100 bytes more a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            texts = utf8(batch, "text")
            open_ = [net is not None and has_letter(t) for t in texts]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            rows = [i for i, x in enumerate(open_) if x]
            if rows:
                p = net.documents([texts[i] for i in rows])
                for i, k, s in zip(rows, p.argmax(1), p.max(1), strict=True):
                    langs[i], scores[i] = net.languages[k], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(langs), pa.array(scores), *(batch.column(c) for c in keep)], [id_col, "lang_pred", "score", *keep]
            )

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"{id_col} {fields[id_col]}, lang_pred string, score double" + "".join(f", `{c}` {fields[c]}" for c in keep)
    return docs.select(id_col, *({"text": None} | dict.fromkeys(keep))).mapInArrow(run, schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs.filter(crc_mod("doc_id", 4) != 2))
    return predict(docs, net).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
