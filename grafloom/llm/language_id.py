"""Language identification by error-correcting output codes.

Each language has a codeword; for every bit a logistic classifier over hashed byte n-grams tells on which
side a text stands. Decoding is loss-weighted: a language's loss is the sum over bits of
log(1 + exp(-bit x margin)), weighted by how well the bit did in training, and the least loss wins. The
score is the softmax of the negative losses; where the two best lie within ``AMBIGUOUS`` of each other the
row is flagged.

Up to seven languages get all codewords' splits (2^(L-1) - 1 bits), more get seeded random splits. Training
takes about ``SAMPLE_ROWS`` labelled rows in all, equally many of each language and one at least, chosen by hash:
a documented bound. Prediction reads every whole text and nothing else.

Defined cases: null text or text without a letter is ``und`` with score 0 and not ambiguous; without any
labelled row every text is ``und``; one learned language is always predicted, with score 1; rows with null
or repeated ids are predicted row by row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .features import bounded_sample, dense_batches, dense_table, sparse_rows
from .shared import bounded_batches, fit_in_task, lean

SAMPLE_ROWS = 4_000
AMBIGUOUS = 0.05
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # language x bit, 1 or -1
    weights: np.ndarray  # cell x bit
    bias: np.ndarray
    trust: np.ndarray  # of each bit


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of distinct signs; for n up to 7 every split of the languages into two parts once."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.where(splits[None, :] >> np.arange(n)[:, None] & 1, 1.0, -1.0)
    rng, best, apart = np.random.default_rng(seed), None, -1
    bits = 8 * int(np.ceil(np.log2(n)))
    for _ in range(64):
        codes = rng.choice([-1.0, 1.0], (n, bits))
        codes = codes[:, np.abs(codes.sum(0)) < n]
        least = int(((codes[:, None] != codes[None]).sum(2) + 10**6 * np.eye(n, dtype=int)).min())
        if least > apart:
            best, apart = codes, least
    return best


def logistic_bits(x: np.ndarray, signs: np.ndarray, steps: int = 250, rate: float = 4.0, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated gradient descent for all bits at once; classes of a bit weigh the same."""
    n, bits = signs.shape
    up = (signs > 0).sum(0)
    weight = np.where(signs > 0, n / (2 * np.maximum(up, 1)), n / (2 * np.maximum(n - up, 1))).astype(np.float32)
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    vw, vb = w.copy(), b.copy()
    for t in range(steps):
        pull = t / (t + 3)
        yw, yb = w + pull * (w - vw), b + pull * (b - vb)
        vw, vb = w, b
        slope = (-signs * weight / (1 + np.exp(np.clip(signs * (x @ yw + yb), -30, 30)))).astype(np.float32) / n
        w = yw - rate * (x.T @ slope + decay * yw)
        b = yb - rate * slope.sum(0)
    return w, b


def _fit(table: pa.Table | None) -> LanguageModel:
    if table is None or not table.num_rows:
        return LanguageModel([], np.ones((0, 0)), np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    names = np.array(table.column("lang").to_pylist())
    languages = sorted(set(names))
    codes = codewords(len(languages))
    x = dense_table(table, False)
    order = np.lexsort((x[:, :16].sum(1), names))  # rows arrive in any order
    x, names = x[order], names[order]
    signs = codes[np.searchsorted(languages, names)].astype(np.float32)
    w, b = logistic_bits(x, signs)
    right = ((x @ w + b) * signs > 0).mean(0) if codes.shape[1] else np.zeros(0)
    return LanguageModel(languages, codes, w, b, np.clip(right, 0.5, 1) * 2 - 1)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> LanguageModel:
    bounded_batches(docs.sparkSession)
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(key_col).alias("key"))
    sample = bounded_sample(labelled, "lang", F.col("key"), total=rows).select("text", "lang")
    return fit_in_task(sample.mapInArrow(lean(sparse_rows(False, [("lang", pa.string())])), "cells binary, vals binary, lang string"), _fit)


def decode(model: LanguageModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the nearest codeword, its score, and whether it is ambiguous."""
    if len(model.languages) == 1:
        n = len(margins)
        return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
    loss = (np.logaddexp(0, -margins[:, None, :] * model.codes[None]) * model.trust).sum(2)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    two = np.sort(p, 1)[:, -2:]
    return best, p[np.arange(len(p)), best], two[:, 1] - two[:, 0] < AMBIGUOUS


def _judge(model: LanguageModel, lead: list[str]):
    """Rows (text, lettered, the columns of ``lead``) become rows of these columns, lang_pred, score, ambiguous."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            void = ~np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for a, b, x in dense_batches(batch.column(0), False):
                if model.languages:
                    best, score, vague = decode(model, x @ model.weights + model.bias)
                    names = [UNDETERMINED if v else model.languages[k] for v, k in zip(void[a:b], best, strict=True)]
                else:
                    names, score, vague = [UNDETERMINED] * (b - a), np.zeros(b - a), np.zeros(b - a, bool)
                own = [batch.column(c)[a:b] for c in range(2, batch.num_columns)]
                yield pa.record_batch([*own, pa.array(names, pa.string()), pa.array(np.where(void[a:b], 0.0, score), pa.float64()), pa.array(vague & ~void[a:b])], [*lead, "lang_pred", "score", "ambiguous"])

    return run


def _judged(docs: DataFrame, model: LanguageModel, text_col: str, lead: dict[str, Column]) -> DataFrame:
    bounded_batches(docs.sparkSession)
    text: Column = F.col(text_col).cast("string")
    rows = docs.select(text.alias("text"), text.rlike(r"\p{L}").alias("lettered"), *(c.alias(name) for name, c in lead.items()))
    schema = StructType(rows.schema.fields[2:]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return rows.mapInArrow(lean(_judge(model, list(lead))), schema)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) of every row."""
    return _judged(docs, model, text_col, {"id": F.col(id_col).cast("long")}).withColumnRenamed("id", id_col)


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns with them, whose text is neither ``und`` nor ambiguous, row by row."""
    model = train(docs.filter(~held_out(id_col)), text_col, lang_col, id_col)
    found = _judged(docs, model, text_col, {"row": F.struct(*(F.col(f"`{c}`") for c in docs.columns))})
    return found.filter((F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous")).select("row.*")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model learns from: CRC-32 of the id's decimal text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that aren't held out and predicts all: (id, held_out, lang_pred, score, ambiguous)."""
    model = train(docs.filter(~held_out(id_col)), text_col, lang_col, id_col)
    return predict(docs, model, id_col, text_col).withColumn("held_out", held_out(id_col)).select(id_col, "held_out", "lang_pred", "score", "ambiguous")
