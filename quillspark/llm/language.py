"""Language identification by a byte convolutional network, trained and run in numpy.

A text's UTF-8 bytes are read in windows of `LENGTH`, which overlap so that no run of bytes that a filter can see is missed; the last is filled up
with zero bytes. Bytes are embedded, filters of several widths slide over a window, the greatest value of each is kept, and a softmax layer gives
the languages' probabilities. A text's probabilities are those of all its windows, weighted by the bytes they hold.

The network is trained in the driver on windows of at most `per_lang` labelled texts a language, and `MOST` in all; the windows start anywhere in a
text and are cut at any length, so that short texts are known too. All documents are predicted, over their whole texts.

Defined results: a null text or one without a letter is `und` with score 0, as is every text if there is nothing to learn from; null languages are not
learnt, the empty one is a language; rows of one doc_id are predicted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written
from .labelled import held_out
from .words import parts

MOD, REST = 4, 2
PER_LANG, MOST, PICKS = 1500, 60_000, 4
LENGTH, WIDTHS, FILTERS, DIMS = 256, (2, 3, 4, 5), 12, 6
WIDEST = max(WIDTHS)
STRIDE = LENGTH - WIDEST + 1
STEPS, BATCH, RATE = 900, 96, 0.01
UNKNOWN = "und"


class Net:
    """Embedding of bytes, filters, and the layer that tells languages; filters of all widths are one matrix, zero beyond a filter's width."""

    def __init__(self, langs: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.langs = langs
        self.mask = np.repeat(np.arange(WIDEST)[:, None] < np.repeat(WIDTHS, FILTERS), DIMS, 0).astype(np.float32)
        self.p = {
            "bytes": rng.normal(0, 0.5, (256, DIMS)).astype(np.float32),
            "filters": (rng.normal(0, 0.4, (WIDEST * DIMS, n)) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": rng.normal(0, 0.1, (n, len(langs))).astype(np.float32),
            "base": np.zeros(len(langs), np.float32),
        }

    def seen(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, WIDEST * DIMS): the embedded bytes from each place on."""
        e = self.p["bytes"][windows].reshape(len(windows), -1)
        runs = np.lib.stride_tricks.sliding_window_view(e, WIDEST * DIMS, axis=1)[:, ::DIMS]
        return np.ascontiguousarray(runs)

    def convolved(self, seen: np.ndarray) -> np.ndarray:
        return (seen.reshape(-1, seen.shape[2]) @ self.p["filters"]).reshape(*seen.shape[:2], -1)

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.p["bias"], 0) @ self.p["out"] + self.p["base"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def probabilities(self, windows: np.ndarray, at_once: int = 64) -> np.ndarray:
        got = [self.softmax(self.convolved(self.seen(windows[a : a + at_once])).max(1)) for a in range(0, len(windows), at_once)]
        return np.concatenate(got) if got else np.zeros((0, len(self.langs)), np.float32)

    def gradients(self, windows: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and its gradients; through a maximum only its place learns."""
        p, seen = self.p, self.seen(windows)
        z = self.convolved(seen)
        at = z.argmax(1)
        pooled = np.take_along_axis(z, at[:, None], 1)[:, 0]
        prob, rows = self.softmax(pooled), np.arange(len(y))
        d = prob.copy()
        d[rows, y] -= 1
        d /= len(y)
        active = np.maximum(pooled + p["bias"], 0)
        back = (d @ p["out"].T) * (active > 0)
        best = seen[rows[:, None], at]
        g = {"out": active.T @ d, "base": d.sum(0), "bias": back.sum(0), "filters": np.einsum("bf,bfk->kf", back, best) * self.mask}
        to = back[:, :, None] * p["filters"].T
        g["bytes"] = np.zeros_like(p["bytes"])
        for j in range(WIDEST):
            np.add.at(g["bytes"], windows[rows[:, None], at + j].ravel(), to[:, :, j * DIMS : (j + 1) * DIMS].reshape(-1, DIMS))
        return float(-np.log(prob[rows, y] + 1e-12).mean()), g


def train(langs: list[str], texts: list[bytes], y: np.ndarray, steps: int = STEPS, seed: int = 5) -> Net:
    """Adam over batches in which all languages are alike frequent; a text is cut at a random length, half of the time."""
    net, rng = Net(langs), np.random.default_rng(seed)
    held = np.zeros((len(texts), LENGTH), np.uint8)
    for i, t in enumerate(texts):
        held[i, : len(t)] = np.frombuffer(t[:LENGTH], np.uint8)
    of = [np.flatnonzero(y == c) for c in range(len(langs))]
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        lang = rng.integers(0, len(langs), BATCH)
        batch = held[[of[c][rng.integers(len(of[c]))] for c in lang]]
        cut = np.where(rng.random(BATCH) < 0.5, LENGTH, rng.integers(16, LENGTH, BATCH))
        batch = np.where(np.arange(LENGTH) < cut[:, None], batch, 0).astype(np.uint8)
        _, g = net.gradients(batch, lang)
        rate = RATE * (1 - 0.9 * step / steps)
        for k, v in g.items():
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> list:
    """Rows (lang, piece) to learn from: PICKS pieces of each of at most `per_lang` texts a language, the first by a hash of their id and text.

    Hashes over a bound, which a language's number of texts sets, go before texts are ranked, so a language of most texts is not one task's."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), MOD, REST)).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = written(known.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    most = max(1, min(per_lang, MOST // max(1, sizes.count())))
    span = F.greatest(F.length("text") - LENGTH // 2, F.lit(1))
    pieces = [F.substring(F.col("text"), (F.pmod(F.xxhash64(F.lit(k), F.col("doc_id"), F.col("text")), span) + 1).cast("int"), F.lit(LENGTH)) for k in range(PICKS)]
    rows = known.select("lang", F.xxhash64("doc_id", "text").alias("at"), F.array(*pieces).alias("pieces")).join(sizes, "lang")
    share = (F.col("at").cast("double") + float(1 << 63)) / float(1 << 64)
    rows = rows.where(share * F.col("n") <= 1.5 * most + 100)
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("at", "pieces"))).where(F.col("rn") <= most)
    return sorted(rows.select("lang", F.explode("pieces").alias("piece")).where(F.col("piece") != "").collect())


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Net | None:
    got = sample(docs, per_lang)
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}
    return train(langs, [r["piece"].encode()[:LENGTH] for r in got], np.array([number[r["lang"]] for r in got]))


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts, the first window of each text, and how many of a text's bytes each window holds."""
    size = np.array([len(t) for t in texts])
    n = np.maximum(1, -(-(size - WIDEST + 1) // STRIDE))
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    doc = np.repeat(np.arange(len(texts)), n)
    at = (np.arange(n.sum()) - first[doc]) * STRIDE
    left = np.minimum(size[doc] - at, LENGTH)
    raw = np.frombuffer(b"".join(texts) + bytes(LENGTH), np.uint8)
    start = (np.cumsum(size) - size)[doc] + at
    windows = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[start]
    return np.where(np.arange(LENGTH) < left[:, None], windows, 0).astype(np.uint8), first, left


def identify(docs: DataFrame, per_lang: int = PER_LANG, carry: list[str] | None = None) -> DataFrame:
    """docs (or its columns `carry`) with lang_pred, a language of docs.lang, and score, its probability. Columns of these names are replaced."""
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, per_lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            some = [i for i, t in enumerate(texts) if model is not None and t and any(map(str.isalpha, t))]
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [texts[i].encode() for i in some]
            for a, b in parts(known):
                windows, first, held = windows_of(known[a:b])
                p = np.add.reduceat(model.probabilities(windows) * held[:, None], first) / np.add.reduceat(held, first)[:, None]
                for i, row in zip(some[a:b], p, strict=True):
                    pred[i], score[i] = model.langs[row.argmax()], min(1.0, float(row.max()))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(pred, pa.string()), pa.array(score)], ["own", "lang_pred", "score"])

    own = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("lang_pred", "score")]
    df = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"))
    kind = df.schema["own"].dataType.simpleString()
    found = df.mapInArrow(run, f"own {kind}, lang_pred string, score double")
    return found.select("own.*", "lang_pred", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, carry=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), MOD, REST).alias("held_out"), "lang_pred", "score")
