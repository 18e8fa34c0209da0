"""I-Match fingerprints against a plain version, and the likeness of near and other texts."""

import random
from collections import Counter
from hashlib import md5, sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from grafloom.llm import imatch
from grafloom.llm.registry import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return set(text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split())


def lexicon_of(texts):
    df, n = Counter(t for x in texts for t in words(x)), len(texts)
    return {t for t, c in df.items() if c >= 2 and c * 2048 >= n and (c * 8 <= n or c <= 2)}


def plain_print(text, lexicon):
    own = words(text)
    kept = own & lexicon
    if 4 * len(kept) < len(own):
        kept = own
    cells = {}
    for t in sorted(kept):
        h = md5(t).digest()
        word = {False: int.from_bytes(h[:8], "big"), True: int.from_bytes(h[8:], "big")}
        at = {False: 0, True: 0}
        for level in range(4, 15):
            side = level <= 10
            cell = word[side] >> at[side] & (1 << level) - 1
            at[side] += level
            if cell < 16:
                cells.setdefault((14 - level) * 16 + cell, []).append(t)
    return [md5(b" ".join(cells[i])).hexdigest()[:4] if i in cells else "." for i in range(176)]


def plain_likeness(a, b):
    pairs = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != (".", ".")][:24]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


def rows():
    rng = random.Random(7)
    pool = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "Su") for b in ("ra", "ti", "vo", "xe") for c in ("n", "r", "é", "")]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    out = [(i, text(rng.randint(1, 60))) for i in range(0, 120, 3)]
    out += [(1, ""), (2, None), (4, " \t\n"), (5, "one"), (7, "日本語 \U0001f600 x"), (8, "w " * 200_000 + "end"), (10, out[3][1]), (-4, "minus"), (2**62, "large")]
    out += [(50, "same text here") for _ in range(30)] + [(50, f"another {i % 3}") for i in range(12)] + [(None, text(9)) for _ in range(20)] + [(None, None)] * 2
    return out


def compare(spark, data):
    df = spark.createDataFrame([(i, t, 1, "a", "b") for i, t in data], "doc_id long, text string, n_chars int, bucket string, guest string").repartition(3)
    lexicon = lexicon_of([t or "" for _, t in data])
    assert imatch.fit_lexicon(df).terms == sorted(lexicon)
    told = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    line = [(r.doc_id, r.text or "") for r in sorted(told, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))]
    want = []
    for (i, text), (_, after) in zip(line, line[1:] + line[:1], strict=True):
        m = len(text) // 3
        changed = text[: len(text) - m] + after[:m]
        own, new, other = (plain_print(t, lexicon) for t in (text, changed, after))
        want.append((str(i), len(text), sha256(changed.encode()).hexdigest(), "".join(own), "".join(new), plain_likeness(own, new), plain_likeness(own, other)))
    got = imatch.edit_likeness(df).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)
    prints = {(str(r.doc_id), r.fingerprint) for r in imatch.fingerprints(df).collect()}
    assert prints == {(w[0], w[3]) for w in want}


def test_plainly(spark, monkeypatch):
    compare(spark, rows())
    monkeypatch.setattr(imatch, "BUCKET_BYTES", 20_000)  # many buckets, within one id too
    monkeypatch.setattr(imatch.tk, "SLICE_BYTES", 300)
    monkeypatch.setattr(imatch, "HELD_TERMS", 10)
    compare(spark, rows())


@pytest.mark.parametrize("data", [[(1, "alone it stands")], [(None, None)], [(3, "a b c"), (3, "a b c")]])
def test_small(spark, data):
    compare(spark, data)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert imatch.edit_likeness(df).count() == 0 and imatch.fingerprints(df).count() == 0


def test_likeness(spark):
    """Exact copies are 1, edited texts clearly above others; a text that half of the corpus copies keeps a fingerprint."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    text = docs.orderBy(F.desc(F.length("text"))).first()["text"][:3000]
    copies = [(10_000 + i, text if i % 2 else text + f" tail{i}") for i in range(200)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    rows = imatch.edit_likeness(both).collect()
    own = [r for r in rows if r.doc_id < 10_000]
    assert sum(r.near_edited > r.near_next for r in own) > 0.95 * len(own)
    assert sorted(r.near_next for r in own)[int(0.99 * len(own))] < 0.3
    assert min(r.near_next for r in rows if r.doc_id > 10_000) > 0.7
    pairs = spark.createDataFrame([("." * 176, "." * 176), (rows[0].fingerprint, rows[0].fingerprint), (None, "." * 176)], "a string, b string")
    assert [r[0] for r in pairs.select(imatch.likeness(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, None]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got, want = queries()["op13_imatch"](spark, FOLDER), con.sql(oracle_sql()["op13_imatch"])
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.select(*names).fetchall())
