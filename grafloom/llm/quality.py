"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector over hashed text and ascending thresholds t_k
(t_0, then positive steps), fitted by Adam with decay in one task on about ``SAMPLE_ROWS`` rated rows: a
documented bound. Every whole text then gets its expected grade and the probability of the top grade, on
which selection rests.

Defined cases: null or empty text has no features and gets what the thresholds alone say; rows without a
rating aren't learned from; with fewer than two grades the one grade (or 0) is expected with probability 1;
rows with null or repeated ids are scored row by row; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import bounded_sample, dense_batches, dense_table, sparse_rows
from .shared import bounded_batches, fit_in_task, lean

SAMPLE_ROWS = 3_000


@dataclass
class OrdinalModel:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k but the last."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - (x @ self.weights)[:, None], -40, 40)))


def grade(quality: Column, toxic: Column) -> Column:
    """0: poor; 1: good prose but toxic; 2: good. Null where the quality is unknown."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when(quality == 1, 2)


def fit_ordinal(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> OrdinalModel:
    grades = sorted(set(y.tolist()))
    k = len(grades)
    if k < 2:
        return OrdinalModel(grades or [0], np.zeros(x.shape[1], np.float32), np.zeros(0))
    place = np.searchsorted(grades, y)
    above = (place[:, None] > np.arange(k - 1)).astype(np.float64)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    steps_up = np.maximum(np.diff(start), 1e-2)
    p = np.concatenate([[start[0]], np.log(steps_up), np.zeros(x.shape[1])])
    weight = (len(y) / (k * np.bincount(place, minlength=k)))[place]
    weight = np.sqrt(weight) / np.sqrt(weight).mean()
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        up = np.exp(p[1 : k - 1])
        cuts = p[0] + np.append(0, np.cumsum(up))
        tail = 1 / (1 + np.exp(np.clip(cuts - (x @ p[k - 1 :].astype(np.float32))[:, None], -40, 40)))
        full = np.hstack([np.ones((len(y), 1)), tail, np.zeros((len(y), 1))])
        mass = np.maximum(full[np.arange(len(y)), place] - full[np.arange(len(y)), place + 1], 1e-9)
        bend = np.hstack([np.zeros((len(y), 1)), tail * (1 - tail), np.zeros((len(y), 1))])
        hit, miss = bend[np.arange(len(y)), place] / mass, bend[np.arange(len(y)), place + 1] / mass
        slope = -(hit - miss) * weight / len(y)
        by_cut = np.zeros(k + 1)
        np.add.at(by_cut, place, hit * weight / len(y))
        np.add.at(by_cut, place + 1, -miss * weight / len(y))
        d_cut = by_cut[1:k]
        later = np.cumsum(d_cut[::-1])[::-1]
        g = np.concatenate([[later[0]], later[1:] * up, x.T @ slope.astype(np.float32) + decay * p[k - 1 :]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(grades, p[k - 1 :].astype(np.float32), p[0] + np.append(0, np.cumsum(np.exp(p[1 : k - 1]))))


def _fit(table: pa.Table | None) -> OrdinalModel:
    if table is None or not table.num_rows:
        return OrdinalModel([0], np.zeros(0, np.float32), np.zeros(0))
    y = table.column("grade").to_numpy()
    x = dense_table(table, True)
    order = np.lexsort((x[:, :16].sum(1), y))
    return fit_ordinal(x[order], y[order])


def train(rated: DataFrame, text_col: str = "text", grade_col: str = "grade", key_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Learns from rows with a text and a grade."""
    rows_in = rated.filter(F.col(text_col).isNotNull() & F.col(grade_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(grade_col).cast("long").alias("grade"), F.col(key_col).alias("key"))
    sample = bounded_sample(rows_in, "grade", F.col("key"), rows).select("text", "grade")
    return fit_in_task(sample.mapInArrow(lean(sparse_rows(True, [("grade", pa.int64())])), "cells binary, vals binary, grade long"), _fit)


def score(docs: DataFrame, model: OrdinalModel, keep: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_grade, tail_prob, selected) of every row."""
    low, steps = model.grades[0], np.diff(model.grades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in dense_batches(batch.column(1), True):
                if len(model.thresholds):
                    tails = model.tails(x)
                    mean, top = low + tails @ steps, tails[:, -1]
                else:
                    mean, top = np.full(b - a, float(low)), np.ones(b - a)
                yield pa.record_batch([batch.column(0)[a:b], pa.array(mean, pa.float64()), pa.array(top, pa.float64()), pa.array(top >= keep)], ["id", "expected_grade", "tail_prob", "selected"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "id long, expected_grade double, tail_prob double, selected boolean").withColumnRenamed("id", id_col)


def rate_documents(docs: DataFrame, labels: DataFrame, keep: float = 0.5, id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fits on about ``rows`` labelled documents of each grade and scores all documents.

    The sample is drawn from the labels, so only its ids (a broadcast of bounded size) meet the texts; of
    documents that repeat a sampled id the least text is learned from.
    """
    bounded_batches(docs.sparkSession)
    rated = labels.groupBy(F.col(id_col).alias("_id")).agg(grade(F.min("quality"), F.max("toxic")).alias("grade"))
    drawn = bounded_sample(rated.filter("_id IS NOT NULL AND grade IS NOT NULL"), "grade", F.col("_id"), rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    hits = texts.join(F.broadcast(drawn), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.min("grade").alias("grade"))
    return score(docs, train(hits, key_col="_id", rows=rows), keep, id_col)
