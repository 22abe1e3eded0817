"""A quality classifier from compressed sizes under dictionaries of good and of bad text."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import column_bytes
from .store import bounded_broadcast, freed

#: Labelled rows of each class that a fit reads at most, and bytes of a text that may be among them.
SAMPLE, SAMPLE_BYTES = 3000, 100_000
DICT_BYTES, BLOCK, LEVEL = 96 << 10, 1024, 3
#: Score from which a text is predicted to be of label 1.
THRESHOLD = 0.3


def crc_bucket(col: Column, n: int = 5) -> Column:
    """crc32 of the value as text, mod ``n``; a null counts as an empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def size(self) -> int:
        return len(self.good) + len(self.bad) + 1000


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    opts = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    if not content:
        return zstandard.ZstdCompressor(**opts)
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, **opts)


def _train_dictionary(texts: list[bytes]) -> bytes:
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    if not blocks:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text for a dictionary with statistics
        return b"".join(blocks)[-DICT_BYTES:]


class Scorer:
    """Features and scores of texts under a model."""

    def __init__(self, model: Model):
        self.model, self.good, self.bad = model, _compressor(model.good), _compressor(model.bad)

    def features(self, text: bytes) -> list[float]:
        """Normalised differences of compressed sizes: of the whole text, and of its worst block.

        Texts are compressed in blocks, all of them, so that a long text doesn't
        become its own dictionary.
        """
        a = b = 0
        worst, sizes = 1.0, []
        for i in range(0, len(text), BLOCK):
            part = text[i : i + BLOCK]
            g, w = len(self.good.compress(part)), len(self.bad.compress(part))
            a, b = a + g, b + w
            sizes.append(((w - g) / max(w, g), len(part)))
        if not sizes:
            return [0.0, 0.0, 0.0, 1.0]
        worst = min((d * min(1.0, n / (BLOCK / 4)) for d, n in sizes))
        n = len(text)
        return [(b - a) / max(a, b), worst, min(a, b) / n, 0.0]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        m = self.model
        x = (rows - m.mean) / m.scale
        z = x @ m.weights[:-1] + m.weights[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the intercept), means and scales of a ridge logistic fit by Newton's steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.eye(len(w)) * 1e-2
    ridge[-1, -1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def fit_texts(good: list[bytes], bad: list[bytes], odds: float | None = None) -> Model:
    """Dictionaries from every other text, calibration on the rest; ``odds`` are those of label 1 where the texts are drawn from."""
    one = Model(_train_dictionary(good[::2]), _train_dictionary(bad[::2]), np.zeros(5), np.zeros(4), np.ones(4))
    scorer = Scorer(one)
    rest = [(t, 1.0) for t in good[1::2] or good] + [(t, 0.0) for t in bad[1::2] or bad]
    if not rest:
        return one
    y = np.array([v for _, v in rest])
    one.weights, one.mean, one.scale = _logistic(np.array([scorer.features(t) for t, _ in rest]), y)
    if odds and 0 < y.mean() < 1:
        one.weights[-1] += np.log(odds) - np.log(y.mean() / (1 - y.mean()))
    return one


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows of each class, those of the smallest hash of the id.

    Rows whose ``crc_bucket`` is 0, null ids and other labels than 0 and 1 are
    left out, as are texts of more than ``SAMPLE_BYTES``.  The ids are picked
    from ``labels`` alone and broadcast, so documents are scanned once; of
    several documents of one id the least text counts, and an id with both
    labels counts for both.  The calibration weighs the two classes as often as
    ``labels`` has them.  Without rows of both classes the scores are the prior.
    """
    pool = labels.where(F.col(f"`{id_col}`").isNotNull() & (crc_bucket(F.col(f"`{id_col}`")) != 0)).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    pool = pool.withColumn("h", F.xxhash64("doc_id"))
    shares = {r["label"]: r["count"] for r in pool.where("label IN (0, 1)").groupBy("label").count().collect()}
    picked = [r for v in (1, 0) for r in pool.where(F.col("label") == v).orderBy("h", "doc_id").limit(sample).collect()]
    spark = docs.sparkSession
    if not picked:
        return fit_texts([], [])
    ids = spark.createDataFrame([(r["doc_id"], r["label"]) for r in picked], T.StructType([pool.schema["doc_id"], pool.schema["label"]])).distinct()
    texts = (
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        .where(F.octet_length("text") <= SAMPLE_BYTES)
        .join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    )
    texts.sort(key=lambda r: (r["doc_id"], r["label"]))
    of = lambda v: [r["text"].encode() for r in texts if r["label"] == v and r["text"]]
    return fit_texts(of(1), of(0), shares[1] / shares[0] if len(shares) == 2 else None)


def classify(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every whole text.

    A null text is scored as an empty one, whose score is the model's at no
    evidence.  Only the text enters the score; equal texts score the same.
    Null ids are passed on, other columns ignored; an empty table gives no
    rows.  One pass, no shuffle.
    """
    shared = bounded_broadcast(df.sparkSession, model, model.size(), 64 << 20)
    base = df.select(F.col(f"`{id_col}`").alias("doc_id"), (crc_bucket(F.col(f"`{id_col}`")) == 0).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([*base.schema.fields[:2]]).add("score", "double").add("predicted", "integer")

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            buf, off = column_bytes(b.column("text"))
            data = buf.tobytes()
            rows = np.array([scorer.features(data[i:j]) for i, j in itertools.pairwise(off.tolist())]).reshape(-1, 4)
            score = scorer.scores(rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return base.mapInArrow(freed(run), schema)


def keep_good(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose text scores at least ``threshold``, with all their columns, whatever their names.

    Null texts are scored as empty ones; equal texts, and so repeated rows, stay
    or go together; an empty table gives no rows.
    """
    shared = bounded_broadcast(df.sparkSession, model, model.size(), 64 << 20)
    at = df.columns.index(text)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            buf, off = column_bytes(b.column(at))
            data = buf.tobytes()
            rows = np.array([scorer.features(data[i:j]) for i, j in itertools.pairwise(off.tolist())]).reshape(-1, 4)
            yield b.filter(pa.array(scorer.scores(rows) >= threshold))

    return df.mapInArrow(freed(run), df.schema)
