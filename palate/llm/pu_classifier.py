"""Quality classifier: positive-unlabelled learning.

Trusted positives are training documents labelled 1; every document of the training folds is unlabelled text, its label
unread. The class prior is the share of label 1 among the labelled training rows. A logistic model over counts of the
text minimises the non-negative unbiased risk: prior * loss(positives as 1) + max(0, loss(unlabelled as 0) -
prior * loss(positives as 0)); while the second part is negative, its gradient is reversed.

The model is fitted on bounded samples (SAMPLE rows each, those with the smallest hash of the id), which are the only rows
that reach the driver. Features and scores are computed for every whole text, on the executors.

Defined results: null and empty texts count as zero words and get the score of that point; ids without a label are only
unlabelled text; several labels of one id count as their minimum; null ids are scored and never trained on; without
positives or without other rows the score is the prior (0.5 without labels). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.llm.common import bound_batches
from palate.llm.shingles import text_words, windows
from palate.session import stage

#: Most positives and most unlabelled documents that the model is fitted on.
SAMPLE = 20_000
STEPS = 400
FOLDS, HELD_OUT = 3, 1

_SEGMENT = 1 << 20
_KINDS = ("lower", "upper", "digit", "blank", "line", "wide", "stop", "mark", "symbol", "bar")
_KIND = np.full(256, _KINDS.index("symbol"), np.int64)
for _kind, _bytes in {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "blank": b" \t\r\x0b\x0c",
    "line": b"\n",
    "wide": range(128, 256),
    "stop": b".,;:?'\"()-",
    "mark": b"!",
    "bar": b"|",
}.items():
    _KIND[list(_bytes)] = _KINDS.index(_kind)
N_FEATURES = len(_KINDS) + 6


def _kind_counts(texts: pa.Array) -> np.ndarray:
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    counts = np.zeros((len(texts), len(_KINDS)), np.int64)
    for at in range(int(offsets[0]), int(offsets[-1]), _SEGMENT):
        end = min(at + _SEGMENT, int(offsets[-1]))
        low = int(np.searchsorted(offsets, at, "right")) - 1
        high = int(np.searchsorted(offsets, end, "left"))
        inside = np.diff(np.clip(offsets[low : high + 1], at, end))
        row = np.repeat(np.arange(high - low) * len(_KINDS), inside)
        counts[low:high] += np.bincount(row + _KIND[data[at:end]], minlength=(high - low) * len(_KINDS)).reshape(high - low, -1)
    return counts


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of counts and shares for each text; no text has none of it missing."""
    counts = _kind_counts(texts).astype(float)
    rest = np.zeros((len(texts), 6))
    for i, words in enumerate(text_words(texts)):
        n = len(words)
        if n:
            values, times = np.unique(words, return_counts=True)
            spans = windows(words)
            rest[i] = (
                np.log1p(n),
                len(values) / n,
                times.max() / n,
                np.count_nonzero(words[1:] == words[:-1]) / n,
                len(np.unique(spans)) / len(spans),
                np.log1p(counts[i].sum() / n),
            )
    size = np.maximum(counts.sum(1, keepdims=True), 1)
    return np.c_[np.sqrt(counts / size), rest]


@dataclass(frozen=True)
class Model:
    center: list[float]
    scale: list[float]
    weights: list[float]
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_expand(features, np.array(self.center), np.array(self.scale)) @ np.array(self.weights), -40, 40)))


def _expand(features: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = np.clip((features - center) / scale, -4, 4)
    return np.c_[x, x * x, np.ones(len(x))]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative risk by full-batch adaptive steps; deterministic."""
    center, scale = unlabelled.mean(0), unlabelled.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    p, u = _expand(positive, center, scale), _expand(unlabelled, center, scale)
    w, first, second = np.zeros(p.shape[1]), 0.0, 0.0
    ridge = np.r_[np.full(len(w) - 1, 1e-4), 0.0]
    for t in range(1, STEPS + 1):
        at_p, at_u = np.clip(p @ w, -40, 40), np.clip(u @ w, -40, 40)
        yes_p, yes_u = 1 / (1 + np.exp(-at_p)), 1 / (1 + np.exp(-at_u))
        # Logistic loss of calling everything negative, and its gradient.
        negative = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
        down = (u * yes_u[:, None]).mean(0) - prior * (p * yes_p[:, None]).mean(0)
        up = -prior * (p * (1 - yes_p)[:, None]).mean(0)
        gradient = (up + down if negative >= 0 else -down) + ridge * w
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w = w - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(center.tolist(), scale.tolist(), w.tolist(), prior)


def _featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = text_features(batch.column("text")).astype(np.float32).ravel()
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(flat), N_FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), vectors], ["id", "features"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "id bigint, features array<float>")


def held_out(id_col: str = "id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _sample(rows: DataFrame) -> np.ndarray:
    picked = rows.select("id", "features").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    return np.array(picked["features"].to_pylist(), float).reshape(-1, N_FEATURES)


def pu_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    bound_batches(docs.sparkSession)
    rows = stage(_featured(docs, id_col, text_col), "features")
    training = rows.where(F.col("id").isNotNull() & ~held_out())
    marks = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("mark")).where("id is not null and mark is not null")
    marks = marks.where(~held_out()).groupBy("id").agg(F.min("mark").alias("mark"))
    known = marks.agg(F.avg((F.col("mark") == 1).cast("double"))).first()[0]
    prior = 0.5 if known is None else min(max(float(known), 0.01), 0.99)
    positive = _sample(training.join(marks.where("mark = 1"), "id", "left_semi"))
    unlabelled = _sample(training)
    model = fit(positive, unlabelled, prior) if len(positive) and len(unlabelled) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(float)
            score = model.score(x) if model else np.full(len(x), prior)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], ["id", "score"])

    scored = rows.mapInArrow(run, "id bigint, score double")
    return scored.select(
        F.col("id").alias(id_col),
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts. Equal texts share a verdict, so a repeated id is no matter."""
    scored = pu_classifier(docs, labels)
    good = scored.groupBy("doc_id").agg(F.max("predicted").alias("keep")).where("keep = 1").select(F.col("doc_id").alias("good_id"))
    return docs.join(good, docs["doc_id"].eqNullSafe(good["good_id"]), "left_semi")
