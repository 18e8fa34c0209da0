"""Every stage of the pipeline against a plain version, and the whole run."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from grafloom.llm import secret_forest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra array<int>"
EN, DE = "the old house by the river was quiet and the people of the town walked there {}", "das alte haus an dem fluss war still und die leute der stadt gingen dort hin {}"
KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def plain_set(text):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def prose(rng, lang, n):
    words = {"en": "the of and house river people town quiet walked old there was by night after water stone".split(), "de": "das der und haus fluss leute stadt still gingen alte dort war an nacht nach wasser stein".split()}[lang]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(i, prose(rng, "en" if i % 2 else "de", 30 + i % 40), "en" if i % 2 else "de", f"s{i % 3}", 0, [i]) for i in range(240)]
    out += [(300 + i, out[i][1] + " end", out[i][2], "s1", 0, None) for i in range(20)]  # near copies
    out += [(400 + i, out[5][1], "en", "s0", 0, []) for i in range(30)]  # a hot group of copies
    out += [(500, f'{prose(rng, "en", 20)} token = "{KEY}" {prose(rng, "en", 20)}', "en", "s2", 0, [1]), (501, prose(rng, "en", 6000), "en", None, 0, None)]
    out += [(i, t, "en", "s1", 2, None) for i in (None, 7, 600) for t in (None, "", "123 456")]
    return out + [(None, prose(rng, "en", 31), "en", "s0", 3, [1, 2]), (7, prose(rng, "de", 33), "de", "s0", 3, []), (9, out[9][1], "en", "s0", 3, [])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def told(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_language_stage(spark, docs, rows):
    got = corpus_pipeline.language(spark, docs, "")
    assert got.schema == docs.schema
    assert told(got) == sorted(str(r) for r in rows if r[1] not in (None, "", "123 456"))
    assert corpus_pipeline.language(spark, docs.limit(0), "").count() == 0


def test_near_duplicate_stage(spark, docs, rows):
    """One row of each group linked by texts stays, that with the smallest id; null ids and wordless rows all stay."""
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.schema == docs.schema
    sets = [plain_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    free = [r[0] is None or not s for r, s in zip(rows, sets, strict=True)]
    for i, a in enumerate(sets):
        for j in range(i):
            if not free[i] and not free[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(("alone", i) if free[i] else find(i), []).append(r)
    left = [(min(r[0] for r in g) if len(g) > 1 else g[0][0], [r for r in g if len(g) == 1 or r[0] == min(x[0] for x in g)]) for g in groups.values()]
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == len(left) and all(any(tuple(r) in kept for r in some) for _, some in left)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_secret_stage(spark, docs, rows):
    """The planted key goes and n_chars follows; every other text stays as it is."""
    got = corpus_pipeline.secrets(spark, docs, "")
    assert got.schema == docs.schema
    want = []
    for i, t, *rest, n, extra in rows:
        t = t and t.replace(KEY, "[secret]")
        want.append((i, t, *rest, None if t is None else len(t), extra))
    assert told(got) == sorted(map(str, want))
    assert corpus_pipeline.secrets(spark, docs.limit(0), "").count() == 0


def test_mixture_stage(spark, docs, rows):
    """A source's words come near its target, no row comes more than twice, nothing else is altered."""
    got = corpus_pipeline.mixture(spark, docs, "")
    assert got.schema == docs.schema
    size = lambda t: len((t or "").encode().split())
    had, has, sums = Counter(str(r) for r in rows), Counter(told(got)), Counter()
    assert set(has) <= set(had) and all(has[r] <= 2 * had[r] for r in has)
    names = sorted({r[3] for r in rows if r[3]}) + [None]
    own = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(own.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * own[s]}
        for s in full or open_:
            target[s] = 2 * own[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    for r in got.collect():
        sums[r.source] += size(r.text)
    for s in names:
        assert abs(sums[s] - target[s]) <= max(size(r[1]) for r in rows if r[3] == s) / 2 + 1e-6
    assert corpus_pipeline.mixture(spark, docs.limit(0), "").count() == 0


def test_pack_stage(spark, docs, rows):
    got = corpus_pipeline.pack(spark, docs, "").toPandas()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert got.length.sum() == sum(len(lib.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 4096
    assert corpus_pipeline.pack(spark, docs.limit(0), "").count() == 0


def test_run_chains_the_stages(spark, docs, tmp_path):
    """run() gives what the stages give one after the other, and no row of a rejected or repeated text."""
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
    want = corpus_pipeline.STAGES[-1][1](spark, step, str(tmp_path))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert told(got.select(*cols)) == told(want.select(*cols))
    ids = {r.doc_id for r in got.collect()}
    assert not ids & set(range(300, 320)) and not ids & set(range(400, 430)) and 600 not in ids
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "secret scans", "mixing sources", "packing"]
    assert secret_forest.scan(step).filter("is_secret").count() == 0
