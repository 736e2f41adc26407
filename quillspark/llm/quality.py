"""Quality classifier: nearest-neighbour votes among labelled latent-semantic vectors.

A text's terms are runs of three characters, with letters, capitals, digits, non-ASCII bytes and spaces put in classes and
symbols as they are, marks for words that repeat the word before, and the words themselves, in lower case. Runs are hashed to `TERMS` columns and
words to `WORDS`, weighted by the square root of their share and by inverse document frequency, and projected to `DIMS` latent dimensions by a singular value
decomposition of the labelled sample. The sample's vectors are broadcast (at most 2 * per_class * DIMS floats); for every
document the cosines with all of them are computed in blocks, exactly, and the `k` nearest vote with weights that grow with
similarity.

Only the fit uses a sample, of at most `per_class` labelled rows of either label. All documents are scored, over their whole texts.

Defined results: a null or empty text has no terms and gets the sample's prior, as does every text if a label is missing from the sample;
rows of one doc_id are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, table, unpacked, with_own
from .labelled import held_out, sample
from .words import ALNUM, Words, parts

PER_CLASS = 1500
TERMS = 2048
DIMS = 48
NEIGHBOURS = 15
SHARPNESS = 8
CUT = 0.7
MOD, REST = 4, 2

#: Class of each byte: symbols are classes of their own.
CLASS = np.zeros(256, np.int64)
for _c in range(256):
    CLASS[_c] = 0 if _c in b" \t\n\r\x0b\x0c" else 1 if 97 <= _c <= 122 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 4 if _c >= 128 else 5 + _c % 59
_COLUMN = (np.arange(1 << 18, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 11)).astype(np.int64)
REPEATS = 8  # columns for repeated words
WORDS, WORD_SHARE = 4096, 0.25  # columns of words, and what they weigh in all beside the runs
ROWS = 1000
END = b"\n\n\n"


def counts(texts: list[bytes]) -> np.ndarray:
    """(texts, TERMS + REPEATS + WORDS): share of each term, under a square root."""
    lengths = np.array([len(t) for t in texts])
    raw = CLASS[np.frombuffer(END.join([*texts, b""]), np.uint8)]
    doc = np.repeat(np.arange(len(texts)), lengths + len(END))
    term = _COLUMN[(raw[:-2] << 12) | (raw[1:-1] << 6) | raw[2:]]
    own = np.ones(len(doc), bool)  # not runs that start in what parts the texts
    ends = np.cumsum(lengths + len(END))
    for k in range(1, len(END) + 1):
        own[ends - k] = False
    own = own[: len(term)]
    out = np.bincount(doc[: len(term)][own] * TERMS + term[own], minlength=len(texts) * TERMS).reshape(-1, TERMS).astype(np.float32)
    w = Words(texts)
    same = np.zeros(len(w.doc), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    share = np.bincount(w.doc[same], minlength=len(texts)) / np.maximum(1, w.n)
    out /= np.maximum(1, out.sum(1, keepdims=True))
    repeats = np.repeat((share / REPEATS)[:, None], REPEATS, 1).astype(np.float32)
    w = Words(texts, ALNUM)
    words = np.bincount(w.doc * WORDS + (w.hash >> np.uint64(64 - 12)).astype(np.int64), minlength=len(texts) * WORDS).reshape(-1, WORDS).astype(np.float32)
    words *= WORD_SHARE / np.maximum(1, w.n)[:, None]
    return np.sqrt(np.concatenate([out, repeats, words], 1))


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded bytes and number, as a row of counts takes the same room for any text."""
    for a, b in parts(texts):
        yield from ((i, min(b, i + ROWS)) for i in range(a, b, ROWS))


class Model:
    """Term weights, projection, and the labelled vectors with their labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, dims: int = DIMS):
        self.y = y.astype(np.float32)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.fits = len(np.unique(y)) == 2
        if not self.fits:
            return
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
        x = x * self.idf
        rng = np.random.default_rng(11)
        basis = np.linalg.qr(x @ rng.standard_normal((x.shape[1], min(dims + 16, *x.shape))).astype(np.float32))[0]
        for _ in range(3):
            basis = np.linalg.qr(x @ (x.T @ basis))[0]
        _, _, vt = np.linalg.svd(basis.T @ x, full_matrices=False)
        self.project = np.ascontiguousarray(vt[:dims].T, dtype=np.float32)
        self.vectors = self.latent(x, weighted=True)

    def latent(self, x: np.ndarray, weighted: bool = False) -> np.ndarray:
        v = (x if weighted else x * self.idf) @ self.project
        return v / np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))

    def score(self, x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Votes of the k nearest by exact cosine. Both labels weigh alike however many rows of each were sampled."""
        if not self.fits or not len(x):
            return np.full(len(x), self.prior)
        near = self.latent(x) @ self.vectors.T
        k = min(k, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(1e-6, np.take_along_axis(near, top, 1)) ** SHARPNESS
        balance = np.where(self.y == 1, 1 / self.y.sum(), 1 / (1 - self.y).sum())
        weight = weight * balance[top]
        got = (weight * self.y[top]).sum(1) / weight.sum(1)
        return np.where(x.any(1), got, self.prior).clip(0, 1)


def features(rows: DataFrame) -> list[tuple[np.ndarray, int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            for a, b in pieces(texts):
                x = counts(texts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(a, b - a)], ["x", "y"])

    got = rows.select(F.col("text").cast("binary"), "y").mapInArrow(run, "x binary, y int").collect()
    return [(np.frombuffer(r["x"], np.float32), r["y"]) for r in got]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    got = features(sample(docs, labels, "quality", MOD, REST, per_class))
    got.sort(key=lambda r: (r[1], r[0].tobytes()))  # the order in which tasks end must not matter
    x = np.stack([r[0] for r in got]) if got else np.zeros((0, TERMS + REPEATS + WORDS), np.float32)
    return Model(x, np.array([r[1] for r in got]))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, carry: list[str] | None = None) -> DataFrame:
    """docs (or its columns `carry`) with score (0 to 1) and predicted (1 if score >= 0.7)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            got = [model.value.score(counts(texts[a:b])) for a, b in pieces(texts)]
            score = np.concatenate(got).astype(np.float64) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), pa.array((score >= CUT).astype(np.int32))], [*batch.schema.names[1:], "score", "predicted"])

    own = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("score", "predicted")]
    df = carried(docs, own, F.col("text").cast("binary").alias("text"))
    return unpacked(df.mapInArrow(run, with_own(df, "score double, predicted int")), own, "score", "predicted")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classify(docs, table(spark, sf_dir, "labels"), carry=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), MOD, REST).alias("held_out"), "score", "predicted")
