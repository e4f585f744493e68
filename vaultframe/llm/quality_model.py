"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete and of equal depth, flattened into three arrays, so a batch of
documents walks all trees at once: ``node = 2 * node + 1 + (x[feature] > threshold)``.
The trees, some tens of kilobytes, travel with the task; texts are read once and not
exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text_stats
from .common import as_bytes, table

#: At most so many labelled rows are fitted: those with the least hashes of their ids.
MAX_TRAINING_ROWS = 40_000
FOLDS, THRESHOLD = 5, 0.3
FEATURES = (
    "words", "word_length", "longest_word", "words_a_line", "lines", "dup_lines", "repeat_words", "distinct_words", "distinct_windows", "stop_lines",
    "symbols", "upper", "lower", "other_letters", "digits", "exclaims", "stops", "commas", "quotes", "other_punct", "upper_share",
)


def features(stats: np.ndarray) -> np.ndarray:
    """FEATURES of rows of text_stats.FIELDS; shares of nothing are 0."""
    c = {n: stats[:, i].astype(np.float64) for i, n in enumerate(text_stats.FIELDS)}
    over = lambda a, b: c[a] / np.maximum(c[b], 1)
    ascii_seen = c["n_upper"] + c["n_lower"] + c["n_digits"] + c["n_symbols"] + c["n_exclaim"] + c["n_stops"] + c["n_commas"] + c["n_quotes"] + c["n_other_punct"]
    return np.column_stack([
        np.log1p(c["n_words"]), over("word_chars", "n_words"), np.log1p(c["longest_word"]), over("n_words", "n_lines"), np.log1p(c["n_lines"]), over("n_dup_lines", "n_lines"), over("n_repeat_words", "n_words"),
        over("n_distinct_words", "n_words"), over("n_distinct_windows", "n_words"), over("n_stop_lines", "n_lines"), over("n_symbols", "n_words"), over("n_upper", "word_chars"), over("n_lower", "word_chars"),
        (c["word_chars"] - np.minimum(ascii_seen, c["word_chars"])) / np.maximum(c["word_chars"], 1), over("n_digits", "word_chars"), over("n_exclaim", "n_words"), over("n_stops", "n_words"),
        over("n_commas", "n_words"), over("n_quotes", "n_words"), over("n_other_punct", "n_words"), c["n_upper"] / np.maximum(c["n_upper"] + c["n_lower"], 1),
    ])


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``threshold``: (trees, 2**depth - 1); ``value``: (trees, 2**depth)."""

    bias: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        n, (trees, inner) = len(x), self.feature.shape
        if not trees:
            return np.full(n, 1 / (1 + np.exp(-self.bias)))
        total = np.empty(n)
        for at in range(0, n, 4096):
            part = x[at : at + 4096]
            rows, which = np.arange(len(part))[:, None], np.arange(trees)
            node = np.zeros((len(part), trees), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (part[rows, self.feature[which, node]] > self.threshold[which, node])
            total[at : at + 4096] = self.value[which, node - inner].sum(1)
        return 1 / (1 + np.exp(-(total + self.bias)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 3.0, ridge: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss on quantile histograms.

    Splits are the best by gain over all features and bins, the first of equals; a node
    without a gain keeps sending all rows left. Without both classes only the smoothed
    share of the labels is left as score.
    """
    good = float(y.sum()) if len(y) else 0.0
    bias = float(np.log((good + 1) / (len(y) - good + 1)))
    inner = 2**depth - 1
    if not len(y) or good in (0.0, float(len(y))):
        return Trees(bias, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.int64)
    out_f, out_t, out_v, margin = [], [], [], np.full(len(y), bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            own = node - first
            best, where, cut = np.zeros(width), np.zeros(width, np.int64), np.full(width, -1)
            for j, c in enumerate(cuts):
                key = own * bins + binned[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain[:, len(c) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best + 1e-9
                best, where, cut = np.where(better, top, best), np.where(better, j, where), np.where(better, at, cut)
            for i in np.flatnonzero(cut >= 0):
                feature[first + i], threshold[first + i] = where[i], cuts[where[i]][cut[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        out_f.append(feature)
        out_t.append(threshold)
        out_v.append(value)
    return Trees(bias, np.array(out_f), np.array(out_t), np.array(out_v))


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 0 by FOLDS; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Trees:
    """Fits on labelled documents outside the held-out fold, ``max_rows`` at most.

    Of several labels of one id the least counts; a null label or one other than 0 or 1
    isn't one. Without labels the score is the same for all documents.
    """
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", as_bytes().alias("_bytes")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), *text_stats.batch(batch.column(2).to_pylist())], names=["doc_id", "quality", *text_stats.FIELDS])

    found = texts.mapInArrow(run, "doc_id long, quality long, " + ", ".join(f"{n} long" for n in text_stats.FIELDS)).toArrow()
    rows = np.column_stack([c.to_numpy() for c in found.columns]).reshape(-1, 2 + len(text_stats.FIELDS))
    rows = rows[np.lexsort(rows.T[::-1])]
    return fit(features(rows[:, 2:]), rows[:, 1].astype(np.float64))


def scored(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row for each row of ``docs``.

    Only the text enters the score. Null texts are scored as empty ones, repeated rows
    alike; an empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([text_stats.statistics(t or b"") for t in batch.column(2).to_pylist()], np.int64).reshape(-1, len(text_stats.FIELDS))
            score = trees.score(features(stats))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), as_bytes()).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 over all documents."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels")))
