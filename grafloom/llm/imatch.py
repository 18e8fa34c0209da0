"""I-Match fingerprints: terms in a band of inverse document frequency, hashed by randomised subsets of the lexicon.

A term is a run of bytes outside space and 0x09-0x0D with A-Z lower-cased. The lexicon holds the terms of at least two
documents whose document frequency, counted over all documents, is at least one in ``RAREST`` and at most one in
``COMMONEST`` (or two). A text's distinct terms of the lexicon are sorted by bytes; one that has under a quarter of its
terms there is taken with all its terms, so that a text copied by a great part of the corpus keeps a fingerprint. On each
level from ``LEVELS`` the bits of a term's MD5 deal the lexicon to 2**level cells, of which the first ``SUBSETS`` are the
randomised subsets; a subset's code is the first 16 bits of the MD5 of the text's terms in it, joined by spaces. The
fingerprint lists the codes, sparsest level first: four hexadecimal digits, or a dot for no terms. Two fingerprints are
compared on the first ``COMPARED`` subsets that either has terms in: the share of equal codes. These are the sparsest ones
whatever the length of the texts, so a subset holds about one term and the share follows that of common terms.

Bound: frequencies of a corpus add up to its distinct terms, so the lexicon that goes to all tasks has at most ``RAREST``
times as many terms (and bytes) as a document has on average.

Defined cases: null text is empty; an empty or wordless text has no codes and is only like another such one (1.0);
equal texts have equal fingerprints; order and repetition of terms don't count; extra columns are ignored; rows with null
or repeated ids are fingerprinted row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import bounded_batches, lean

RAREST, COMMONEST = 2048, 8
LEVELS = range(4, 15)
SUBSETS = 16
COMPARED = 24
#: Terms whose partial counts a task holds before it hands them on.
HELD_TERMS = 1 << 18
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WIDTH = SUBSETS * len(LEVELS)


def _slices() -> list[tuple[int, int, int]]:
    """(level, word, shift): levels up to 10 read the second 64 bits of the MD5 from below, the others the first."""
    out, at = [], [0, 0]
    for level in LEVELS:
        word = int(level <= 10)
        out.append((level, word, at[word]))
        at[word] += level
    return out


def in_band(df: Column, total: Column) -> Column:
    return (df >= 2) & (df * RAREST >= total) & ((df * COMMONEST <= total) | (df <= 2))


def term_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, start) of every word of the texts."""
    hashes, at = tk.word_hashes(data, offs)
    return hashes, np.repeat(np.arange(len(offs) - 1), np.diff(at)), at


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text) to partial document frequencies (term, n)."""
    count: dict[bytes, int] = {}

    def told() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["term", "n"])

    for batch in batches:
        for _, _, data, offs in tk.byte_slices(batch.column(0)):
            raw = data.tobytes().translate(_LOWER)
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                for term in set(raw[a:b].split()):
                    count[term] = count.get(term, 0) + 1
            if len(count) >= HELD_TERMS:
                yield told()
                count = {}
    if count:
        yield told()


@dataclass
class Lexicon:
    """terms: sorted by bytes."""

    terms: list[bytes]

    @cached_property
    def digests(self) -> np.ndarray:
        """First and second 64 bits of every term's MD5."""
        raw = b"".join(md5(t).digest() for t in self.terms)
        return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)

    @cached_property
    def by_hash(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the terms, and the place of each."""
        ends = np.cumsum([len(t) for t in self.terms], dtype=np.int64)
        hashes = tk.span_hashes(np.frombuffer(b"".join(self.terms), np.uint8), np.append(0, ends[:-1]).astype(np.int64), ends) if self.terms else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        return hashes[order], order

    def codes(self, texts: list[bytes]) -> np.ndarray:
        """A row of codes for each text, -1 for a subset without terms."""
        out = np.full((len(texts), _WIDTH), -1, np.int32)
        if not texts:
            return out
        offs = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        hashes, at = tk.word_hashes(np.frombuffer(b"".join(texts), np.uint8), offs)
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))[: len(doc)]
        hashes, doc = hashes[new], doc[new]
        known, place = self.by_hash
        spot = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
        fit = known[spot] == hashes if len(known) else np.zeros(len(hashes), bool)
        whole = np.bincount(doc, minlength=len(texts))
        own = np.bincount(doc[fit], minlength=len(texts))
        plain = 4 * own < whole
        fit &= ~plain[doc]
        doc, term = doc[fit], place[spot[fit]] if len(known) else doc[:0]
        order = np.lexsort((term, doc))
        _subset_codes(out, doc[order], term[order], self.digests, self.terms)
        for r in np.flatnonzero(plain).tolist():
            terms = sorted(set(texts[r].translate(_LOWER).split()))
            one = Lexicon(terms)
            _subset_codes(out[r : r + 1], np.zeros(len(terms), np.int64), np.arange(len(terms)), one.digests, terms)
        return out


def _subset_codes(out: np.ndarray, doc: np.ndarray, term: np.ndarray, digests: np.ndarray, terms: list[bytes]) -> None:
    keys, mine = [], []
    for level, word, shift in _slices():
        cell = (digests[term, word] >> np.uint64(shift)) & np.uint64((1 << level) - 1)
        in_ = np.flatnonzero(cell < SUBSETS)
        keys.append(doc[in_] * _WIDTH + SUBSETS * (LEVELS[-1] - level) + cell[in_].astype(np.int64))
        mine.append(term[in_])
    key, term = np.concatenate(keys), np.concatenate(mine)
    order = np.argsort(key, kind="stable")
    key, term = key[order], term[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    size = np.diff(np.append(begin, len(key)))
    flat = out.reshape(-1)
    alone = size == 1
    flat[key[begin[alone]]] = (digests[term[begin[alone]], 0] >> np.uint64(48)).astype(np.int32)
    names = term.tolist()
    for a, n in zip(begin[~alone].tolist(), size[~alone].tolist(), strict=True):
        flat[key[a]] = int.from_bytes(md5(b" ".join([terms[t] for t in names[a : a + n]])).digest()[:2], "big")


def written(codes: np.ndarray) -> list[str]:
    return ["".join(["." if c < 0 else f"{c:04x}" for c in row]) for row in codes.tolist()]


def parsed(fingerprint: str) -> np.ndarray:
    out, at = [], 0
    while at < len(fingerprint):
        empty = fingerprint[at] == "."
        out.append(-1 if empty else int(fingerprint[at : at + 4], 16))
        at += 1 if empty else 4
    return np.array(out, np.int32)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of codes row by row: 0 to 1."""
    either = (a >= 0) | (b >= 0)
    used = either & (np.cumsum(either, 1) <= COMPARED)
    n = used.sum(1)
    return np.where(n > 0, (used & (a == b)).sum(1) / np.maximum(n, 1), 1.0)


def likeness(left: Column, right: Column) -> Column:
    """How alike two fingerprint columns are; null where one is."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
        return pa.array([None if x is None or y is None else float(alike(parsed(x)[None], parsed(y)[None])[0]) for x, y in pairs], pa.float64())

    return run(left, right)


def fit_lexicon(docs: DataFrame, text_col: str = "text") -> Lexicon:
    """The lexicon of a corpus; see the module for its bound."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    total = texts.count()
    counts = texts.mapInArrow(lean(_term_counts), "term binary, n long").groupBy("term").agg(F.sum("n").alias("df"))
    kept = counts.filter(in_band(F.col("df"), F.lit(total))).select("term")
    return Lexicon(sorted(bytes(r["term"]) for r in kept.toLocalIterator()))


def fingerprints(docs: DataFrame, lexicon: Lexicon | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""
    lexicon = lexicon or fit_lexicon(docs, text_col)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in tk.byte_slices(batch.column(1)):
                raw = data.tobytes()
                yield pa.record_batch([batch.column(0)[i:j], pa.array(written(lexicon.codes([raw[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)])))], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


# -- texts in order of their ids ---------------------------------------------
#: Text of a bucket, the most buckets, and the rows a bucket is drawn from.
BUCKET_BYTES = 64 << 20
MOST_BUCKETS = 1 << 14
SAMPLED = 20
_KEY = ["void", "turned", "tie", "row"]


def _place(bounds: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """How many of the bounds, sorted by their columns in turn, go before or equal each key."""
    low, high = np.searchsorted(bounds[0], keys[0], "left"), np.searchsorted(bounds[0], keys[0], "right")
    if len(bounds) == 1:
        return high
    for a, b in {(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True) if b > a}:
        mine = np.flatnonzero((low == a) & (high == b))
        high[mine] = a + _place([x[a:b] for x in bounds[1:]], [k[mine] for k in keys[1:]])
    return high


def _bucket_of(bounds: list[tuple]):
    columns = [np.array(x, np.int64) for x in zip(*bounds, strict=True)]

    @F.arrow_udf("int")
    def run(*keys: pa.Array) -> pa.Array:
        if not columns:
            return pa.array(np.zeros(len(keys[0]), np.int32))
        return pa.array(_place(columns, [k.to_numpy(zero_copy_only=False) for k in keys]).astype(np.int32))

    return run


def _guest_of(heads: dict[int, int]):
    rows = np.array(sorted(heads), np.int64)
    to = np.array([heads[r] for r in sorted(heads)], np.int32)

    @F.arrow_udf("int")
    def run(row: pa.Array) -> pa.Array:
        at = np.minimum(np.searchsorted(rows, row.to_numpy()), len(rows) - 1)
        return pa.array(to[at], mask=rows[at] != row.to_numpy())

    return run


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (..., text): the text compressed, as its way through the shuffle is most of the work."""
    for batch in batches:
        texts = [t.as_buffer() for t in batch.column(batch.num_columns - 1).fill_null("")]
        packed = [len(t).to_bytes(8, "little") + pa.compress(t, "zstd", asbytes=True) for t in texts]
        yield pa.record_batch([*batch.columns[:-1], pa.array(packed, pa.binary())], [*batch.schema.names[:-1], "body"])


def _text_of(body: bytes) -> str:
    return pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True).decode()


def in_sequence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, guest, void, turned, tie, row, body) of all documents, by descending id, nulls last; rows with one id
    in the order of a hash of their text and then of the table. They are partitioned and sorted by bucket; after the rows
    of a bucket comes, as a guest, a copy of the row that follows them, and the very first row follows the last.

    Buckets are drawn from a hashed sample of about ``SAMPLED`` keys a bucket; a bucket boundary may fall within an id,
    so a hot or null id is split."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ids, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    keyed = docs.select(ids.isNull().cast("long").alias("void"), F.coalesce(F.bitwise_not(ids), F.lit(0)).alias("turned"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    count, size = keyed.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, max(parts, (size or 0) // BUCKET_BYTES))
    draw = F.pmod(F.xxhash64(*_KEY), F.lit(1 << 30)) <= F.lit(int((1 << 30) * min(1.0, SAMPLED * buckets / max(1, count))))
    sample = sorted(tuple(r) for r in keyed.filter(draw).select(*_KEY).toLocalIterator())
    bounds = sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if sample else []
    rows = keyed.withColumn("bucket", _bucket_of(bounds)(*_KEY))
    first = {r["bucket"]: r["k"]["row"] for r in rows.groupBy("bucket").agg(F.min(F.struct(*_KEY)).alias("k")).collect()}
    live = sorted(first)
    heads = {first[b]: live[i - 1] for i, b in enumerate(live)}
    every = rows.withColumn("guest", F.lit(False))
    if heads:
        every = every.unionByName(rows.withColumn("bucket", _guest_of(heads)("row")).filter("bucket is not null").withColumn("guest", F.lit(True)))
    packed = every.select("bucket", "guest", *_KEY, "text").mapInArrow(lean(_squeezed), "bucket int, guest boolean, void long, turned long, tie long, row long, body binary")
    order = ["bucket", "guest", *_KEY]
    return packed.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions(*order)


def edited(text: str, after: str) -> str:
    """``text`` with its last third (rounded down) replaced by as many code points from the start of ``after``, or all."""
    m = len(text) // 3
    return text[: len(text) - m] + after[:m]


def _compared(lexicon: Lexicon):
    """Rows of ``in_sequence`` to the fingerprints of texts and edited texts, and how alike they are."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def told(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Of each text but the last, which only follows."""
        changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:], strict=False)]
        own = lexicon.codes([t.encode() for t in texts])
        new = lexicon.codes(changed)
        cols = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([sha256(t).hexdigest() for t in changed]), pa.array(written(own[:-1])), pa.array(written(new)), pa.array(alike(own[:-1], new)), pa.array(alike(own[:-1], own[1:]))]
        return pa.record_batch(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for guest, void, turned, body in zip(*(batch.column(c).to_pylist() for c in ("guest", "void", "turned", "body")), strict=True):
                texts.append(_text_of(body))
                held += len(texts[-1])
                if guest or held >= tk.SLICE_BYTES and len(texts) > 1:
                    yield told(ids, texts)
                    # The last text opens the next stretch, unless it is a guest.
                    ids, texts, held = [], ([] if guest else texts[-1:]), 0
                if not guest:
                    ids.append(None if void else ~turned)
        if len(texts) > 1:
            raise AssertionError("a bucket without a row behind it")

    return run


def edit_likeness(docs: DataFrame, lexicon: Lexicon | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row: each text
    against itself with the last third taken from the next document, and against the next document, by descending id."""
    lexicon = lexicon or fit_lexicon(docs, text_col)
    kind = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_sequence(docs, id_col, text_col).mapInArrow(lean(_compared(lexicon)), kind).withColumnRenamed("id", id_col)


def _sql() -> str:
    levels = ", ".join(f"({level}, {word}, {shift})" for level, word, shift in _slices())
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS after,
         coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id FROM documents),
e AS (SELECT doc_id, next_id, n, text, substr(text, 1, n - n // 3) || substr(after, 1, n // 3) AS changed FROM d),
texts AS (SELECT doc_id, 0 AS side, text FROM e UNION ALL SELECT doc_id, 1, changed FROM e),
terms AS (
  SELECT DISTINCT doc_id, side, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS t FROM texts),
band AS (
  SELECT t FROM terms WHERE side = 0 GROUP BY t
  HAVING count(*) >= 2 AND count(*) * {RAREST} >= (SELECT count(*) FROM documents) AND (count(*) * {COMMONEST} <= (SELECT count(*) FROM documents) OR count(*) <= 2)),
marked AS (SELECT x.doc_id, x.side, x.t, b.t IS NOT NULL AS own, md5(x.t) AS h FROM terms x LEFT JOIN band b ON b.t = x.t),
share AS (SELECT doc_id, side, 4 * sum(CAST(own AS INTEGER)) < count(*) AS plain FROM marked GROUP BY doc_id, side),
kept AS (
  SELECT m.doc_id, m.side, m.t, CAST('0x' || substr(h, 1, 16) AS UBIGINT) AS w0, CAST('0x' || substr(h, 17, 16) AS UBIGINT) AS w1
  FROM marked m JOIN share s ON s.doc_id = m.doc_id AND s.side = m.side WHERE own OR plain),
celled AS (
  SELECT doc_id, side, t, level, CAST((CASE word WHEN 0 THEN w0 ELSE w1 END >> shift) & CAST((1 << level) - 1 AS UBIGINT) AS INTEGER) AS cell
  FROM kept, (VALUES {levels}) v(level, word, shift)),
codes AS (
  SELECT doc_id, side, {SUBSETS} * ({LEVELS[-1]} - level) + cell AS spot, substr(md5(string_agg(t, ' ' ORDER BY t)), 1, 4) AS code
  FROM celled WHERE cell < {SUBSETS} GROUP BY doc_id, side, level, cell),
lists AS (SELECT doc_id, side, map(list(spot), list(code)) AS m FROM codes GROUP BY doc_id, side),
prints AS (
  SELECT x.doc_id, x.side, list_transform(range({_WIDTH}), lambda i: coalesce(l.m[CAST(i AS INTEGER)], '.')) AS f
  FROM texts x LEFT JOIN lists l ON l.doc_id = x.doc_id AND l.side = x.side),
pairs AS (
  SELECT e.doc_id, e.n, e.changed, a.f AS own, b.f AS new,
         list_filter(list_zip(a.f, b.f), lambda z: z[1] <> '.' OR z[2] <> '.')[:{COMPARED}] AS x,
         list_filter(list_zip(a.f, c.f), lambda z: z[1] <> '.' OR z[2] <> '.')[:{COMPARED}] AS y
  FROM e JOIN prints a ON a.doc_id = e.doc_id AND a.side = 0 JOIN prints b ON b.doc_id = e.doc_id AND b.side = 1 JOIN prints c ON c.doc_id = e.next_id AND c.side = 0)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(changed) AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(new, '') AS edited_fingerprint,
       CASE WHEN len(x) = 0 THEN 1.0 ELSE len(list_filter(x, lambda z: z[1] = z[2])) / CAST(len(x) AS DOUBLE) END AS near_edited,
       CASE WHEN len(y) = 0 THEN 1.0 ELSE len(list_filter(y, lambda z: z[1] = z[2])) / CAST(len(y) AS DOUBLE) END AS near_next
FROM pairs
"""


IMATCH_SQL = _sql()
