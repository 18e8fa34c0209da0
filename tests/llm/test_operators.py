import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grafloom.llm import ann, language_id, maxscore, mixing, ngram_join, packing, quality, secret_forest, textkit, token_counts, token_files, tokens
from grafloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, source string, lang string, score string, size string, id long"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def rows():
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "su") for b in ("ra", "ti", "vo", "xe", "zu", "pa")]
    base = [rng.choice(words) for _ in range(80)]
    out = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base[:70], "other", *base[71:]])), (4, "\n".join(base[:40])), (5, None), (6, ""), (7, " \t "), (8, "one two"), (9, "ONE  two"), (None, " ".join(base)), (10, "x" * 5000 + " end"), (3, " ".join(base))]
    out += [(100 + i, " ".join(base[:60] + [rng.choice(words) for _ in range(i)])) for i in range(12)]
    return [(i, t, None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", None if i == 8 else "en", "a", "b", 1) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_set(text):
    w = bytes((text or "").encode()).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_ngram_join(docs, empty):
    data = [(r[0], plain_set(r[1])) for r in rows()]
    root = {i: i for i, _ in data if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in data:
        for j, b in data:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = sorted((str(i), len(s), str(None if i is None else find(i))) for i, s in data)
    got = ngram_join.ngram_jaccard_join(docs).documents.collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert ngram_join.ngram_jaccard_join(empty).documents.count() == 0


def test_ngram_links(spark, monkeypatch):
    """A group of near copies with exact copies in it, a chain and a couple; in one block and in several."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    data = [(i, " ".join(base[:p] + [f"x{i}"] + base[p:])) for i, p in enumerate([0, 60, 59, 58, 1, 2, 30, 30, 57, 3])]
    data += [(20 + i, data[i % 4][1]) for i in range(7)] + [(40 + i, " ".join(words[4 * i : 4 * i + 60])) for i in range(6)]
    data += [(60, "a b c d e f g h i j k"), (61, "a b c d e f g h i j k l"), (70, "alone and by itself it stands here"), (80, ""), (81, None), (None, data[0][1])]
    sets = {i: plain_set(t) for i, t in data if i is not None}
    linked = {i: [j for j, b in sets.items() if j != i and a and b and 100 * len(a & b) >= 75 * len(a | b)] for i, a in sets.items()}
    assert max(map(len, linked.values())) > 8
    for shingles, classes in ((ngram_join.UNIT_SHINGLES, ngram_join.UNIT_CLASSES), (300, 6)):
        monkeypatch.setattr(ngram_join, "UNIT_SHINGLES", shingles)
        monkeypatch.setattr(ngram_join, "UNIT_CLASSES", classes)
        join = ngram_join.ngram_jaccard_join(spark.createDataFrame(data, "doc_id long, text string"))
        found = join.documents.collect()
        assert {r.doc_id: r.n_links for r in found} == {i: len(x) for i, x in linked.items()} | {None: None}
        one = {r.class_id for r in found if r.doc_id is not None and r.n_shingles}
        want = sorted((a, b, len(sets[a] & sets[b])) for a in one for b in linked[a] if b in one and a < b)
        assert sorted(map(tuple, join.links.collect())) == want


def plain_join(data):
    """Rows (id, text): for each its links and, of its id, the smallest id reachable; ids on several rows tie them."""
    sets = [plain_set(t) for _, t in data]
    root = {i: i for i, _ in data if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = [[j for j, b in enumerate(sets) if j != i and data[i][0] is not None and data[j][0] is not None and a and b and 100 * len(a & b) >= 75 * len(a | b)] for i, a in enumerate(sets)]
    for i, js in enumerate(linked):
        for j in js:
            x, y = sorted((find(data[i][0]), find(data[j][0])))
            root[y] = x
    return [(str(i), len(s), None if i is None else find(i), None if i is None else len(js)) for (i, _), s, js in zip(data, sets, linked, strict=True)], linked


def tangled():
    """Ids on rows with different texts, repeated rows, clashing columns; 7 is near the second text of 3."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    x, y, z = ([rng.choice(words) for _ in range(50)] for _ in range(3))
    near = lambda t, i: " ".join([*t[:i], "extra", *t[i + 1 :]])
    data = [(3, " ".join(x)), (3, " ".join(y)), (7, near(y, 0)), (9, near(x, 49)), (5, near(z, 0)), (6, " ".join(z)), (6, ""), (6, near(y, 49)), (8, "alone it is and stays so"), (8, "alone it is and stays so"), (11, None), (11, None), (None, " ".join(x)), (None, None)]
    return data + [(20, "long " * 300_000 + "end"), (21, "long " * 300_000 + "end here"), (22, "\u65e5\u672c" * 5000)]


def test_ngram_repeated_ids(spark):
    data = tangled()
    df = spark.createDataFrame([(i, t, 1, "a", True) for i, t in data], "doc_id long, text string, id int, key string, stays boolean")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.n_links) for r in ngram_join.ngram_jaccard_join(df).documents.collect())
    assert sorted(map(str, got)) == sorted(map(str, plain_join(data)[0]))


def kept_plainly(data):
    _, linked = plain_join(data)
    seen, out = set(), []
    for i in range(len(data)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        least = min((data[j][0] for j in group), default=None) if len(group) > 1 else None
        out.append((len(group), least, {data[j] for j in group if len(group) == 1 or data[j][0] == least}))
    return out


def test_keep_one(spark, empty):
    """One row of each group by links of texts; rows without words or id stay; other columns come back untouched."""
    data = tangled()
    df = spark.createDataFrame([(i, t, n, "a", True) for n, (i, t) in enumerate(data)], "doc_id long, text string, id int, key string, stays boolean")
    got = ngram_join.keep_one(df)
    assert got.columns == df.columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    want = kept_plainly(data)
    assert len(rows) == len(want)
    for _, _, allowed in want:
        assert sum(r in allowed for r in set(rows)) >= 1
    assert ngram_join.keep_one(empty).count() == 0


def test_word_hashes_of_complementary_words():
    """Words that any polynomial hash modulo a power of two takes for one: bits and counter-bits of Thue-Morse."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = ("".join("ab"[b ^ x] for b in bits) for x in (0, 1))
    data, offs = textkit.text_buffers(pa.array([one, two, "AB ab", "a" * 63, "a" * 64, "a" * 65]))
    words, at = textkit.word_hashes(data, offs)
    assert at.tolist() == [0, 1, 2, 4, 5, 6, 7] and len(set(words.tolist())) == 6 and words[2] == words[3]
    for path, lead in ((WORD, False), (BYTE, True)):
        coder, plain = tokens.ChunkEncoder(path, lead), Tokenizer.from_file(path)
        ids, at = coder.encode(data, offs)
        assert [ids[a:b].tolist() for a, b in zip(at[:2], at[1:3], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in (one, two)]


def test_bitmap_bounds():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
        y = np.unique(np.concatenate([x[: rng.integers(1, len(x))], rng.integers(0, 1 << 62, 100).astype(np.uint64)]))
        assert textkit.overlap_bound(len(x), len(y), textkit.bitmap(x), textkit.bitmap(y)) >= len(np.intersect1d(x, y))


def test_components(spark):
    edges = spark.createDataFrame([(5, 6), (6, 9), (1, 2), (2, 3), (3, 4), (9, 9), (None, 1)], "a long, b long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {5: 5, 6: 5, 9: 5, 1: 1, 2: 1, 3: 1, 4: 1}


@pytest.mark.parametrize(("path", "lead"), [(WORD, False), (BYTE, True)])
def test_chunks_equal_library(path, lead):
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "a", "B", "é", "́", "'s", "'", "1", "23", "!", "<|endoftext|>", "<|ENDOFTEXT|>", "ß", "Σ", "日", "\x1c", "\x85", "　", "word", ", "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["", " ", "x" * 3000]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    coder, got = tokens.ChunkEncoder(path, lead), []
    for _, _, data, offs in textkit.byte_slices(pa.array(texts), 20_000):
        ids, at = coder.encode(data, offs)
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == want


def encoded(path):
    t = Tokenizer.from_file(path)
    return sorted(((r[0], r[1] or "", t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_token_counts(docs, empty, spark):
    want = sorted((str(i), len(t.encode()), len(x), len(x) > 512) for i, t, x in encoded(BYTE))
    cache = token_files.new_folder(spark, "test-cache")
    for _ in range(2):  # the second run finds every digest
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BYTE, cache).collect()) == want
    assert token_counts.open_cache(spark, cache).count() == len({r[1] or "" for r in rows()})
    assert token_counts.count_tokens(empty, BYTE).count() == 0


def test_token_files(docs, empty):
    got = sorted(token_files.write_token_files(docs, WORD, 2).read().collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.append(0, np.cumsum([r.n_tokens for r in got])[:-1]).tolist()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, _, x in encoded(WORD))
    assert token_files.write_token_files(empty, WORD, 2).read().count() == 0
    numbers = np.random.default_rng(0).choice([0, 200, 300, 70_000, 20_000_000, 2**32 - 1], 1001).astype(np.uint32)
    control, body = token_files.pack_ranks(numbers)
    assert (token_files.unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(body, np.uint8), 1001) == numbers).all()


def test_packing(docs, empty):
    got = packing.pack_documents(docs, WORD, 2, capacity=256).toPandas()
    assert got.length.sum() == sum(len(x) + 1 for _, _, x in encoded(WORD)) and got.length.max() <= 256
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 256
    ids = {i: [*x, 2] for i, _, x in encoded(WORD) if i not in (None, 3)}
    for r in got[got.doc_id.isin(list(ids))].itertuples():
        assert zlib.crc32(np.array(ids[int(r.doc_id)][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert packing.pack_documents(empty, WORD, 2).count() == 0


def test_cutting_stock_holds_demand():
    demand = np.bincount(np.random.default_rng(5).integers(1, 65, 3000), minlength=65)
    used = packing.cutting_stock(demand)
    assert (sum(p * t for p, t in used) == demand).all() and all(p @ np.arange(65) <= 64 for p, _ in used)
    assert sum(t for _, t in used) <= 1.02 * (demand @ np.arange(65)) / 64 + 1


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs).toPandas()
    assert ((got.times >= 0) & (got.times <= 2)).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs((g.times * g["size"]).sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1e-6
        assert g.target.iloc[0] <= 2 * g.source_size.iloc[0]
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(empty).count() == 0


def vectors(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((300, 8))
    v[50:90] = v[50]
    out = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [float("nan")] * 8), (402, [None] * 8), (403, [0.0] * 8), (None, [1.0] * 8), (404, [1.0, 2.0]), (405, [])]
    return v, spark.createDataFrame(out, "vec_id long, embedding array<double>")


def test_top_k(spark):
    v, df = vectors(spark)
    got = maxscore.top_k(df, F.col("vec_id") % 10 == 0).toPandas()
    whole = np.vstack([np.floor(1024 * v), np.zeros(8)]).astype(int)
    ids = np.append(np.arange(300), 403)
    for q in range(0, 300, 10):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:10]
        g = got[got.query_id == q].sort_values("rank")
        assert g.vec_id.tolist() == ids[order].tolist() and g.score.tolist() == s[order].tolist()


def test_neighbours_recall(spark):
    v, df = vectors(spark)
    got = ann.nearest(df, F.col("vec_id") % 5 == 0).toPandas()
    unit, hits = v / np.linalg.norm(v, axis=1)[:, None], 0
    for q in range(0, 300, 5):
        s = unit @ unit[q]
        s[q] = -2
        hits += (got[got.query_id == q].score >= np.sort(s)[-5] - 1e-9).sum()
    assert hits >= 0.9 * 5 * 60


def test_language(spark, empty):
    rng = random.Random(1)
    kinds = {"aa": ["kaku", "buko", "loka"], "bb": ["sisi", "temi", "neri"], "cc": ["ozo", "uzzu", "wox"]}
    data = [(i, " ".join(rng.choice(kinds[k]) for _ in range(30)), "s", k, "a", "b", 1) for i, k in enumerate(list(kinds) * 40)]
    df = spark.createDataFrame([*data, (900, "12 34", "s", "aa", "a", "b", 1), (901, None, "s", None, "a", "b", 1)], SCHEMA)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert all(got[r[0]].lang_pred == r[3] for r in data if got[r[0]].held_out)
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in data)
    assert got[900].lang_pred == got[901].lang_pred == "und"
    assert language_id.identify(empty).count() == 0


def test_quality(spark, empty):
    good, bad = "calm clear prose about rivers and trees", "BUY!! NOW!! CLICK!! WIN!!"
    df = spark.createDataFrame([(i, (good if i % 3 else bad) + f" {i}", "s", "en", "a", "b", 1) for i in range(90)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.rate_documents(df, labels).collect()}
    assert all(got[i].selected == (i % 3 > 0) for i in range(60, 90)) and len(got) == 90
    assert quality.rate_documents(empty, labels).count() == 0


def test_secrets(spark, empty):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'some text token = "{key}" end', f"fixed in commit {key} yesterday", "plain words only", None, "card 4785380592391139 here", "x\u0001y token = \"" + key + '"']
    df = spark.createDataFrame([(i, t, "src", "en", "a", "b", 1) for i, t in enumerate(texts)], SCHEMA)
    forest = secret_forest.train(spark)
    got = [(r.doc_id, texts[r.doc_id][r.start : r.stop]) for r in secret_forest.scan(df, forest).collect() if r.is_secret]
    assert sorted(got) == [(0, key), (5, key)]
    red = {r.doc_id: r.text for r in secret_forest.redact(df, forest).collect()}
    assert red[0] == 'some text token = "[secret]" end' and [red[i] for i in (1, 2, 3, 4)] == texts[1:5]
    assert secret_forest.scan(empty, forest).count() == 0
