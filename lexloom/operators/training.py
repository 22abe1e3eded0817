"""Training and evaluation of the boundary model."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.segment import Segmenter, features, is_japanese

_WORDS = T.ArrayType(T.StringType())
_SAMPLES = T.ArrayType(T.StructType([T.StructField("features", _WORDS), T.StructField("label", T.DoubleType())]))
#: Pairs of feature and sample up to which training runs in the driver's memory.
LOCAL_PAIRS = 5_000_000


def gold_words(line: str | None) -> list[str] | None:
    """The words of a line parted by spaces; None for a blank line or a comment."""
    s = (line or "").strip()
    return None if not s or s.startswith("#") else [w for w in s.split(" ") if w]


def line_samples(line: str | None) -> list[dict]:
    """A sample for each gap between two Japanese characters: its features, and 1 at the end of a word, else -1."""
    words = gold_words(line)
    if not words:
        return []
    chars = "".join(words)
    ends, at = set(), 0
    for w in words:
        at += len(w)
        ends.add(at - 1)
    ends.discard(len(chars) - 1)
    out, prior = [], []
    for i in range(len(chars) - 1):
        cut = i in ends
        if is_japanese(chars[i]) and is_japanese(chars[i + 1]):
            out.append({"features": features(chars, i, prior), "label": 1.0 if cut else -1.0})
        prior = ["B" if cut else "O", *prior[:2]]
    return out


@F.pandas_udf(_SAMPLES)
def _line_samples(line: pd.Series) -> pd.Series:
    return line.map(line_samples)


def training_samples(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """(sample_id, features, label) of all lines; an id is the line's number and the place in the line, so ids follow the lines."""
    rows = lines.select(F.col(order).alias("n"), F.posexplode(_line_samples(F.col(line))).alias("i", "s"))
    return rows.select(F.struct("n", "i").alias("sample_id"), "s.features", "s.label")


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, active) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in active)

    def predict(self, active) -> bool:
        return self.score(active) > 0

    def save_json(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"bias": self.bias, "weights": dict(sorted(self.weights.items()))}, f, ensure_ascii=False, indent=2)

    @classmethod
    def load_json(cls, path: str) -> Model:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        return cls(d["bias"], d["weights"])


def train(samples: DataFrame, rounds: int) -> Model:
    """AdaBoost over presence of single features.

    Each round takes the feature of the least weighted error, ties to the
    first in order of code points, as "present means boundary" or the reverse,
    and reweights the samples.  Small sets are trained in memory, larger ones by
    joins of weights to (feature, sample) pairs.
    """
    pairs = samples.select("sample_id", "label", F.explode("features").alias("feature"))
    if not samples.limit(1).count():
        raise ValueError("there are no samples")
    if pairs.count() <= LOCAL_PAIRS:
        rows = samples.orderBy("sample_id").select("features", "label").toPandas()
        return train_local(list(rows["features"]), rows["label"].to_numpy(), rounds)
    return _train_spread(samples, pairs, rounds)


def _step(err_pos: float) -> tuple[float, float]:
    """The error and polarity of a rule from its error as "present means boundary"."""
    return (err_pos, 1.0) if err_pos <= 1.0 - err_pos else (1.0 - err_pos, -1.0)


def _alpha(err: float) -> float:
    err = min(max(err, 1e-6), 1 - 1e-6)
    return 0.5 * float(np.log((1 - err) / err))


def train_local(active: list, label: np.ndarray, rounds: int) -> Model:
    names = sorted({f for fs in active for f in fs})
    number = {f: i for i, f in enumerate(names)}
    feat = np.array([number[f] for fs in active for f in fs], np.int64)
    samp = np.repeat(np.arange(len(active)), [len(fs) for fs in active])
    sign = np.where(label > 0, 1.0, -1.0)
    w = np.full(len(active), 1.0 / len(active))
    model = Model()
    for _ in range(rounds if names else 0):
        fires = np.bincount(feat, weights=w[samp], minlength=len(names))
        right = np.bincount(feat, weights=np.where(sign > 0, w, 0.0)[samp], minlength=len(names))
        pos = (w[sign > 0].sum() - right) + (fires - right)
        best = int(np.argmin(np.minimum(pos, 1.0 - pos)))
        err, polarity = _step(float(pos[best]))
        alpha = _alpha(err)
        model.weights[names[best]] = model.weights.get(names[best], 0.0) + alpha * polarity
        guess = np.full(len(active), -polarity)
        guess[samp[feat == best]] = polarity
        w = w * np.exp(-alpha * sign * guess)
        w /= w.sum()
    return model


def _train_spread(samples: DataFrame, pairs: DataFrame, rounds: int) -> Model:
    pairs = pairs.persist()
    n = samples.count()
    weights = samples.select("sample_id", "label", F.lit(1.0 / n).alias("w"))
    model = Model()
    for _ in range(rounds):
        positive = weights.where("label > 0").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        by = pairs.select("sample_id", "feature").join(weights, "sample_id").groupBy("feature").agg(F.sum("w").alias("fires"), F.sum(F.when(F.col("label") > 0, F.col("w")).otherwise(0.0)).alias("right"))
        pos = F.lit(positive) - F.col("right") + F.col("fires") - F.col("right")
        row = by.withColumn("pos", pos).orderBy(F.least("pos", 1 - F.col("pos")), "feature").first()
        err, polarity = _step(row["pos"])
        alpha = _alpha(err)
        model.weights[row["feature"]] = model.weights.get(row["feature"], 0.0) + alpha * polarity
        fired = pairs.where(F.col("feature") == row["feature"]).select("sample_id", F.lit(True).alias("hit")).distinct()
        guess = F.when(F.col("hit"), polarity).otherwise(-polarity)
        new = weights.join(fired, "sample_id", "left").select("sample_id", "label", (F.col("w") * F.exp(-alpha * F.when(F.col("label") > 0, 1.0).otherwise(-1.0) * guess)).alias("w")).persist()
        total = new.agg(F.sum("w")).first()[0]
        weights = new.withColumn("w", F.col("w") / total)
    return model


def predictions(model: Model, samples: DataFrame) -> DataFrame:
    """Adds ``score`` and ``predicted``."""
    table = F.create_map(*[F.lit(x) for kv in sorted(model.weights.items()) for x in kv]) if model.weights else F.create_map().cast("map<string,double>")
    score = F.aggregate("features", F.lit(float(model.bias)), lambda s, f: s + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
    return samples.withColumn("score", score).withColumn("predicted", F.col("score") > 0)


def evaluate(model: Model, samples: DataFrame) -> DataFrame:
    """One row (accuracy, precision, recall), 0 where nothing is to be divided by."""
    count = lambda p, a: F.sum(F.when((F.col("predicted") == F.lit(p)) & ((F.col("label") > 0) == F.lit(a)), 1).otherwise(0))
    c = predictions(model, samples).agg(count(True, True).alias("tp"), count(True, False).alias("fp"), count(False, True).alias("fn"), F.count("*").alias("n"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, n = (F.coalesce(F.col(x), F.lit(0)) for x in ("tp", "fp", "fn", "n"))
    return c.select(share(n - fp - fn, n).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"))


def from_counts(tp: int, fp: int, fn: int) -> tuple[float, float, float]:
    """Precision, recall and F1, the first two 1 where nothing is to be divided by."""
    p = tp / (tp + fp) if tp + fp else 1.0
    r = tp / (tp + fn) if tp + fn else 1.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def japanese_runs(words: list[str]) -> list[list[str]]:
    """Maximal runs of words all of whose characters are Japanese."""
    out: list[list[str]] = [[]]
    for w in words:
        if w and all(map(is_japanese, w)):
            out[-1].append(w)
        elif out[-1]:
            out.append([])
    return [r for r in out if r]


def boundary_offsets(words: list[str]) -> list[int]:
    return [int(x) for x in np.cumsum([len(w) for w in words])[:-1]]


def common_count(a: list[str], b: list[str]) -> int:
    """Size of the intersection of two lists as multisets."""
    return (Counter(a) & Counter(b)).total()


def evaluate_lines(lines: DataFrame, segmenter: Segmenter, line: str = "line") -> DataFrame:
    """One row of boundary and word precision, recall and F1, runs and exact_runs, over runs of two words or more."""
    schema = "tp long, fp long, fn long, hits long, gold long, guess long, exact long"

    def run(batches):
        for b in batches:
            rows = []
            for text in b[line]:
                for gold in japanese_runs(gold_words(text) or []):
                    if len(gold) < 2:
                        continue
                    guess = segmenter.words("".join(gold))
                    x, y = set(boundary_offsets(gold)), set(boundary_offsets(guess))
                    rows.append((len(x & y), len(y - x), len(x - y), common_count(gold, guess), len(gold), len(guess), int(gold == guess)))
            yield pd.DataFrame(rows, columns=["tp", "fp", "fn", "hits", "gold", "guess", "exact"])

    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    c = lines.select(line).mapInPandas(run, schema).agg(*map(total, ("tp", "fp", "fn", "hits", "gold", "guess", "exact")), F.count("*").alias("runs"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    f1 = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    bp, br = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    wp, wr = share(F.col("hits"), F.col("guess")), share(F.col("hits"), F.col("gold"))
    named = {"boundary_precision": bp, "boundary_recall": br, "boundary_f1": f1(bp, br), "word_precision": wp, "word_recall": wr, "word_f1": f1(wp, wr)}
    return c.select(*[v.alias(k) for k, v in named.items()], "runs", F.col("exact").alias("exact_runs"))
