"""Quality by Bradley-Terry ranking: a document's score is linear in features of its text, and the
chance that one document is better than another is the logistic function of the scores' difference.

Weights are fitted by Newton's method on the logistic loss over pairs (good document, bad document)
of a bounded labelled sample; the pairs' feature differences need no intercept. The threshold is a
quantile of the sample's scores, the one that parts the sample's labels best. Scores map to 0..1 so
that the threshold becomes ``CUT``.

Null and empty texts have all features zero and are scored like others. Without good or without bad
documents in the sample all scores are 1. Null ids are scored; repeated rows are scored each;
an empty table gives an empty result. Further columns, clashing names included, are kept by
``keep_good`` and not returned by ``scores``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planledger.llm import labelled
from planledger.llm.common import byte_view, hashes, mix, rounds, sized, token_runs

#: Labelled rows used for fitting, at most; and pairs per document of the larger class.
SAMPLE, PAIRS, CUT, RIDGE = 20_000, 4, 0.3, 1e-3

_SIGNS = b".,!?|#$%&*@;:-_/\\<>()[]{}=+~^\"'"


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Signs counted per word: sentence ends, commas, stops with force, bars, other signs, digits.
CLASSES = [_table(x) for x in (b".", b",", b"!?", b"|", b"#$%&*@~^_<>{}[]=+\\", b"0123456789")]
_UPPER, _LETTER, _BREAK = _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)])), _table(b"\n")


def features(texts: pa.Array) -> np.ndarray:
    """One row per text. Shares and logarithms only, so that length alone says little."""
    data, starts = byte_view(texts)
    n = len(starts) - 1
    begin, end = token_runs(data, starts)
    owner = np.searchsorted(starts, begin, side="right") - 1
    words = np.bincount(owner, minlength=n)
    per_word = 1.0 / np.maximum(words, 1)
    size = np.diff(starts)

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[starts[1:]] - sums[starts[:-1]]).astype(float)

    def repeated(width: int) -> np.ndarray:
        """Share of the runs of so many words that occurred before in the text."""
        if len(h) < width:
            return np.zeros(n)
        code, who = h[: len(h) - width + 1].copy(), owner[: len(h) - width + 1]
        for k in range(1, width):
            code = code * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
        inside = owner[width - 1 :] == who
        code, who = mix(code[inside] ^ mix(who[inside].astype(np.uint64))), who[inside]
        total = np.bincount(who, minlength=n)
        first = np.unique(code, return_index=True)[1]
        return (total - np.bincount(who[first], minlength=n)) / np.maximum(total, 1)

    h = hashes(data, begin, end)
    letters = count(_LETTER[data])
    same = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    length = np.bincount(owner, weights=end - begin, minlength=n) * per_word
    long_word = np.bincount(owner, weights=(end - begin) > 24, minlength=n) * per_word
    columns = [np.log1p(count(c[data]) * per_word * 10) for c in CLASSES]
    columns += [
        count(_UPPER[data]) / np.maximum(letters, 1),
        letters / np.maximum(size, 1),
        np.log1p(length),
        long_word,
        np.bincount(owner[1:][same], minlength=n) * per_word if len(h) else np.zeros(n),
        repeated(1),
        repeated(3),
        np.log1p(words),
        np.minimum(words, 5) / 5.0,
        np.log1p(count(_BREAK[data]) * per_word * 10),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    steep: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.steep * (raw - self.threshold) + np.log(CUT / (1 - CUT)), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS) -> Model | None:
    """The ranking model for features and labels 0/1; None without both labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = ((x - mean) / scale).clip(-8, 8)
    m = pairs * max(len(good), len(bad))
    draw = np.random.default_rng(7)
    one, two = draw.permutation(np.resize(good, m)), draw.permutation(np.resize(bad, m))
    diff = z[one] - z[two]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -500, 500)))
        gradient = diff.T @ (1 - p) / m - RIDGE * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / m + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ w
    order = np.argsort(raw, kind="stable")
    # Errors if the lowest k are called bad; the quantile is the middle of the best places.
    errors = np.concatenate(([0], np.cumsum(np.where(y[order] == 1, 1, -1)))) + len(bad)
    best = np.flatnonzero(errors == errors.min())
    k = best[len(best) // 2]
    threshold = float(raw[order[0]] - 1 if k == 0 else raw[order[-1]] if k == len(y) else np.quantile(raw, (k - 0.5) / (len(y) - 1)) if len(y) > 1 else raw[0])
    return Model(mean, scale, w, threshold, 1.0)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on at most about ``bound`` labelled rows; what reaches the driver is their features."""
    width = features(pa.array([""])).shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rounds(batches):
            rows = pa.FixedSizeListArray.from_arrays(pa.array(features(batch.column("text")).ravel()), width)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("target"), rows.cast(pa.list_(pa.float64()))], names=["id", "target", "x"])

    chosen = labelled.sample(docs, labels, target, bound, id_col, text_col)
    kind = T.StructType([T.StructField("id", chosen.schema["id"].dataType), T.StructField("target", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    found = chosen.mapInArrow(run, kind).toPandas()
    if not len(found):
        return None
    x, y, ids = np.stack(found["x"].to_numpy()), found["target"].to_numpy(), found["id"].to_numpy()
    order = np.lexsort((*x.T, y, ids))  # rows come in any order; the fit shall not depend on it
    return fit(x[order], y[order])


def _scored(df: DataFrame, model: Model | None, text_col: str, keep: list[str], cut: float | None) -> DataFrame:
    own = sized(df).select(F.struct(*keep).alias("row"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rounds(batches):
            score = model.score(features(batch.column("text"))) if model else np.ones(batch.num_rows)
            made = pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score)], names=["row", "score"])
            yield made if cut is None else made.filter(pa.array(score >= cut))

    return own.mapInArrow(run, T.StructType([own.schema["row"], T.StructField("score", T.DoubleType())]))


def scores(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``score`` and ``predicted``."""
    rows = _scored(df, model, text_col, [id_col], None)
    return rows.select(f"row.{id_col}", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose score reaches the threshold."""
    return _scored(df, model, text_col, df.columns, CUT).select("row.*")
