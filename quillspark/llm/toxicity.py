"""Toxicity: a bidirectional gated recurrent network with attention, over words and characters, trained and run in numpy.

A text's words (digits, letters and non-ASCII bytes, A-Z lowered) are read in overlapping windows of 32 words, 16 apart. A word's
input is its hashed embedding beside the mean of the embeddings of its runs of 3 and of 5 characters. Forward and backward gated
recurrent units read the window, attention pools their states, and a logistic output scores it. The text's score is that of
its worst window, put through a logistic curve fitted on the training texts.

Training sees at most `per_class` labelled texts of either label, whole, in all their windows. Only texts are labelled. So a
column of either embedding is first trained alone, by gradient descent, for a text to be toxic if some word of it is; then all
weights are trained on windows: of a toxic text the one that scores highest so far, of a clean text the highest and a random
one. Every few rounds all windows are scored anew.

All documents are scored over all their windows. Defined results: a null or empty text is scored as a window without words; if a label
is missing from the sample, every text gets the sample's prior; rows of one doc_id are scored one by one, and one of them may be learnt from; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from .common import carried, table, unpacked, with_own
from .labelled import held_out, sample
from .words import ALNUM, Words, mix, parts

PER_CLASS = 1000
WINDOW, STEP = 32, 16
WORD_BITS, CHAR_BITS = 14, 15
WORD_ROWS, CHAR_ROWS = 1 << WORD_BITS, 1 << CHAR_BITS
WORD_DIMS, CHAR_DIMS, HIDDEN, ATTENTION = 8, 16, 8, 8
GRAMS = (3, 5)
DROP = 0.2
#: Training of the first column: steps for words' and for character runs' values, the logit of an unknown word, decay; and its scale in the embeddings.
FIRST = {"rounds": 200, "rate": 4.0, "char_rate": 320.0, "base": -8.0, "decay": 1e-4}
SCALE = 3.0
SLOW = 0.1  # embeddings learn so much slower than the rest, or few texts would teach their other words
CUT = 0.7
MOD, REST = 3, 1


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Inputs:
    """Distinct words of a batch: hashed word row, hashed trigram rows with where each word's begin, and windows over them."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, step: int = STEP):
        w = Words(texts, ALNUM)
        self.n_texts = len(texts)
        distinct, where, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        self.word = (distinct >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        start, size = w.start[where], w.end[where] - w.start[where]
        # runs of characters of the word between two marks: of each length as many as it has bytes
        own = np.repeat(np.arange(len(size)), size)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        raw, rows = w.raw.astype(np.uint64), []
        for n in GRAMS:
            h = np.full(len(k), np.uint64(n))
            for j in range(n):
                at = k + j - 1
                byte = raw[np.clip(start[own] + at, 0, max(0, len(raw) - 1))] if len(k) else h
                h = (h << np.uint64(8)) | np.where(at < 0, np.uint64(1), np.where(at < size[own], byte, np.uint64(2)))
            rows.append((mix(h) >> np.uint64(64 - CHAR_BITS)).astype(np.int64))
        order = np.argsort(np.concatenate([own] * len(GRAMS)), kind="stable")
        self.tri = np.concatenate(rows)[order]
        self.size = size * len(GRAMS)
        self.first = np.cumsum(self.size) - self.size
        self.doc_words = w.doc, inverse.reshape(-1)
        # windows
        n = np.maximum(1, -(-np.maximum(w.n - step, 1) // step))
        self.text = np.repeat(np.arange(len(texts)), n)
        begin = (np.arange(len(self.text)) - np.repeat(np.cumsum(n) - n, n)) * step
        left = w.n[self.text] - begin
        place = (w.first[:-1][self.text] + begin)[:, None] + np.arange(window)
        self.mask = np.arange(window) < left[:, None]
        self.ids = inverse.reshape(-1)[np.minimum(place, max(0, len(inverse) - 1))] if len(inverse) else np.zeros(place.shape, np.int64)
        self.ids[~self.mask] = 0
        self.n_words = len(distinct)


class Net:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        d = WORD_DIMS + CHAR_DIMS

        def small(*shape, scale=None):
            return (rng.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)

        self.p = {
            "word": small(WORD_ROWS, WORD_DIMS, scale=0.1), "char": small(CHAR_ROWS, CHAR_DIMS, scale=0.1),
            "fx": small(d, 3 * HIDDEN), "fh": small(HIDDEN, 3 * HIDDEN), "fb": np.zeros(3 * HIDDEN, np.float32),
            "bx": small(d, 3 * HIDDEN), "bh": small(HIDDEN, 3 * HIDDEN), "bb": np.zeros(3 * HIDDEN, np.float32),
            "aw": small(2 * HIDDEN, ATTENTION), "av": small(ATTENTION), "ow": small(2 * HIDDEN), "ob": np.zeros(1, np.float32),
        }
        self.slope, self.offset, self.prior = 1.0, 0.0, None

    def inputs(self, x: Inputs) -> np.ndarray:
        """(distinct words, dims)"""
        if not x.n_words:
            return np.zeros((1, WORD_DIMS + CHAR_DIMS), np.float32)
        chars = np.add.reduceat(self.p["char"][x.tri], x.first, axis=0) / x.size[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][x.word], chars], 1)

    def read(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (time, windows, HIDDEN) of one direction; gates holds the input's share for each distinct word."""
        n, steps = ids.shape
        h, out, wh = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32), self.p[side + "h"]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            gx, gh, m = gates[ids[:, t]], h @ wh, mask[:, t, None]
            zr = sigmoid(gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
            z, r, hn = zr[:, :HIDDEN], zr[:, HIDDEN:], gh[:, 2 * HIDDEN :]
            new = np.tanh(gx[:, 2 * HIDDEN :] + r * hn)
            if keep is not None:
                keep.append((t, h, z, r, hn, new, m))
            h = np.where(m, new + z * (h - new), h)
            out[t] = h
        return out

    def forward(self, words: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window."""
        states = []
        for side in "fb":
            saved = [] if keep is not None else None
            states.append(self.read(words @ self.p[side + "x"] + self.p[side + "b"], ids, mask, side, saved))
            if keep is not None:
                keep[side] = saved
        h = np.concatenate(states, 2)
        u = np.tanh(h @ self.p["aw"])
        a = np.where(mask.T, u @ self.p["av"], -1e9)
        a = np.exp(a - a.max(0)) * mask.T
        a /= np.maximum(1e-9, a.sum(0))
        pooled = (a[:, :, None] * h).sum(0)
        if keep is not None:
            keep |= {"h": h, "u": u, "a": a, "pooled": pooled}
        return pooled @ self.p["ow"] + self.p["ob"][0]

    def backward(self, words: np.ndarray, ids: np.ndarray, keep: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of all but the embeddings, and of the words' inputs."""
        p, g = self.p, {}
        h, u, a, pooled = keep["h"], keep["u"], keep["a"], keep["pooled"]
        g["ow"], g["ob"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
        dpooled = dlogit[:, None] * p["ow"]
        dh = a[:, :, None] * dpooled
        da = (h * dpooled).sum(2)
        ds = a * (da - (a * da).sum(0))
        g["av"] = (ds[:, :, None] * u).sum((0, 1))
        du = ds[:, :, None] * p["av"] * (1 - u * u)
        g["aw"] = np.tensordot(h, du, ((0, 1), (0, 1)))
        dh = dh + du @ p["aw"].T
        dwords = np.zeros_like(words)
        for k, side in enumerate("fb"):
            dgates, wh = np.zeros((len(words), 3 * HIDDEN), np.float32), p[side + "h"]
            g[side + "h"] = np.zeros_like(wh)
            nxt = np.zeros((ids.shape[0], HIDDEN), np.float32)
            for t, before, z, r, hn, new, m in reversed(keep[side]):
                total = nxt + dh[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                d = total * m
                dn = d * (1 - z) * (1 - new * new)
                dz = d * (before - new) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                np.add.at(dgates, ids[:, t], np.concatenate([dz, dr, dn], 1))
                gh = np.concatenate([dz, dr, dn * r], 1)
                g[side + "h"] += before.T @ gh
                nxt = total * ~m + d * z + gh @ wh.T
            g[side + "x"], g[side + "b"] = words.T @ dgates, dgates.sum(0)
            dwords += dgates @ p[side + "x"].T
        return g, dwords

    def window_logits(self, x: Inputs, most: int = 8192) -> np.ndarray:
        words = self.inputs(x)
        return np.concatenate([self.forward(words, x.ids[i : i + most], x.mask[i : i + most]) for i in range(0, len(x.ids), most)] or [np.zeros(0, np.float32)])

    def text_logits(self, x: Inputs) -> np.ndarray:
        out = np.full(x.n_texts, -np.inf, np.float32)
        np.maximum.at(out, x.text, self.window_logits(x))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        return sigmoid(self.slope * self.text_logits(Inputs(texts)).astype(np.float64) + self.offset)


def some_word(x: Inputs, y: np.ndarray, rounds: int, rate: float, char_rate: float, base: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """A column of either embedding table, trained by gradient descent so that a text is toxic if some word of it is: a word's logit is
    the sum of its word's and the mean of its character runs' values, and words count as independent causes (noisy or). Steps
    are not scaled row by row, so what many toxic texts share is learnt first and then explains them."""
    pair = np.unique(x.doc_words[0] * np.int64(max(1, x.n_words)) + x.doc_words[1])
    doc, word = pair // max(1, x.n_words), pair % max(1, x.n_words)
    weight = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))
    of = np.repeat(np.arange(x.n_words), x.size)
    share = 1 / np.repeat(x.size, x.size)
    a, c = np.zeros(WORD_ROWS), np.zeros(CHAR_ROWS)
    va, vc = np.zeros_like(a), np.zeros_like(c)
    for _ in range(rounds):
        s = base + a[x.word] + np.bincount(of, c[x.tri] * share, x.n_words)
        each = np.logaddexp(0, s)
        total = np.bincount(doc, each[word], len(y))
        pull = np.where(y == 1, 1 / np.expm1(np.maximum(total, 1e-9)), -1.0) * weight
        g = np.bincount(word, pull[doc], x.n_words) * sigmoid(s)
        va = 0.9 * va + np.bincount(x.word, g, WORD_ROWS) - decay * a
        vc = 0.9 * vc + np.bincount(x.tri, np.repeat(g, x.size) * share, CHAR_ROWS) - decay * rate / char_rate * c
        a, c = a + rate * va, c + char_rate * vc
    return a, c


def train(texts: list[bytes], y: np.ndarray, rounds: int = 9, batch: int = 256, rate: float = 0.01, first: bool = True) -> Net:
    """Texts are read whole, in all their windows."""
    net = Net()
    if len(np.unique(y)) < 2:
        net.prior = float(y.mean()) if len(y) else 0.5
        return net
    x = Inputs(texts)
    ids, mask, text_of = x.ids, x.mask, x.text
    if first:
        net.p["word"][:, 0], net.p["char"][:, 0] = (v / SCALE for v in some_word(x, y, **FIRST))
    rng = np.random.default_rng(2)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    cut = np.searchsorted(text_of, np.arange(len(y) + 1))
    order = np.arange(len(ids))
    words = net.inputs(x)
    logits = np.where(mask, (words[:, 0] + words[:, WORD_DIMS])[ids], -99).max(1)
    for turn in range(rounds):
        picked = []
        for d in range(len(y)):
            own = order[cut[d] : cut[d + 1]]
            if len(own):
                picked.append(own[logits[own].argmax()])
                if y[d] == 0:
                    picked.append(rng.choice(own))
        picked = rng.permutation(np.array(picked))
        share = (y[text_of[picked]] == 1).mean()
        for a in range(0, len(picked), batch):
            at = picked[a : a + batch]
            need, local = np.unique(ids[at], return_inverse=True)
            local = local.reshape(len(at), -1)
            size = x.size[need]
            first = np.cumsum(size) - size
            tri = x.tri[np.repeat(x.first[need], size) + np.arange(size.sum()) - np.repeat(first, size)]
            chars = np.add.reduceat(net.p["char"][tri], first, axis=0) / size[:, None].astype(np.float32)
            words = np.concatenate([net.p["word"][x.word[need]], chars], 1)
            words *= rng.random((len(words), 1)) >= DROP
            keep: dict = {}
            got = net.forward(words, local, mask[at], keep)
            target = y[text_of[at]].astype(np.float32)
            weight = np.where(target == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
            g, dwords = net.backward(words, local, keep, (sigmoid(got) - target) * weight / len(at))
            dwords *= words.any(1)[:, None]
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], x.word[need], dwords[:, :WORD_DIMS])
            np.add.at(g["char"], tri, np.repeat(dwords[:, WORD_DIMS:] / size[:, None], size, 0))
            step += 1
            for k, v in net.p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                # embeddings share one scale, so that rows of rare words move little
                s += 0.01 * ((np.square(g[k]).sum() / max(1, np.count_nonzero(g[k])) if k in ("word", "char") else g[k] * g[k]) - s)
                v -= (rate * SLOW if k in ("word", "char") else rate) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
        if turn % 3 == 2:
            logits = net.window_logits(x)
    top = np.full(len(y), -30.0)
    np.maximum.at(top, text_of, logits)
    net.slope, net.offset = curve(top, y)
    return net


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, both labels weighing alike; the slope stays moderate where labels part cleanly."""
    a, b = 1.0, 0.0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(200):
        err = (sigmoid(a * x + b) - y) * weight
        a, b = max(0.05, a - 0.3 * ((err * x).sum() + 0.01 * (a - 1))), b - 0.3 * err.sum()
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Net:
    got = sample(docs, labels, "toxic", MOD, REST, per_class).select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), "y").collect()
    rows = sorted((r["y"], bytes(r["text"])) for r in got)  # the order in which tasks end must not matter
    return train([t for _, t in rows], np.array([y for y, _ in rows], np.int64))


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, carry: list[str] | None = None) -> DataFrame:
    """docs (or its columns `carry`) with score (0 to 1, higher: likelier toxic) and predicted (1 if score >= 0.7)."""
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            got = [net.value.scores(texts[a:b]) for a, b in parts(texts)]
            s = np.concatenate(got).astype(np.float64) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s), pa.array((s >= CUT).astype(np.int32))], [*batch.schema.names[1:], "score", "predicted"])

    own = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("score", "predicted")]
    df = carried(docs, own, F.col("text").cast("binary").alias("text"))
    return unpacked(df.mapInArrow(run, with_own(df, "score double, predicted int")), own, "score", "predicted")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, table(spark, sf_dir, "labels"), carry=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), MOD, REST).alias("held_out"), "score", "predicted")
