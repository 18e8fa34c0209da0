"""Texts that share passages in a ring are compared in their tiles, not as one transitive group."""

import random

from grafloom.llm import ngram_join
from tests.llm.test_operators import plain_set


def pool(n, seed=1, passages=6, words=40):
    rng = random.Random(seed)
    made = [" ".join(f"p{i}w{rng.randint(0, 9999)}" for _ in range(words)) for i in range(n // 10)]
    return [(i, " ".join(rng.sample(made, passages))) for i in range(n)]


def counted(monkeypatch, join):
    """The join's rows with what was dealt to units."""
    seen, units = [], ngram_join._units

    def watched(groups, percent):
        out = units(groups, percent)
        seen.append((groups.count(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "_units", watched)
    return join().documents.collect(), seen[-1]


def test_shared_passages_make_no_units(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "UNIT_CLASSES", 100)
    data = pool(600)
    # Some real copies among them.
    rng = random.Random(2)
    for i in range(40):
        w = data[i][1].split()
        w[rng.randrange(len(w))] = "changed"
        data.append((1000 + i, " ".join(w)))
    rows, (left, dealt) = counted(monkeypatch, lambda: ngram_join.ngram_jaccard_join(spark.createDataFrame(data, "doc_id long, text string")))
    sets = {i: plain_set(t) for i, t in data}
    want = {i: [j for j, b in sets.items() if j != i and 100 * len(a & b) >= 75 * len(a | b)] for i, a in sets.items()}
    assert {r.doc_id: r.n_links for r in rows} == {i: len(x) for i, x in want.items()} and sum(map(len, want.values())) >= 80
    # Hardly any class but those of the copies is left to compare, and none is dealt more often than thrice.
    assert left < 200 and dealt <= 3 * left, (left, dealt)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Groups over the limits, near copies tied to passages of others: all links, in several units."""
    monkeypatch.setattr(ngram_join, "UNIT_CLASSES", 12)
    monkeypatch.setattr(ngram_join, "UNIT_SHINGLES", 3000)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    data = pool(120, 3)
    for i in range(50):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(80)] = f"x{i}"
        data.append((500 + i, " ".join(w)))
    data += [(600 + i, " ".join(base) + " " + data[i][1]) for i in range(20)]
    rows = ngram_join.ngram_jaccard_join(spark.createDataFrame(data, "doc_id long, text string"))
    sets = {i: plain_set(t) for i, t in data}
    want = {i: [j for j, b in sets.items() if j != i and 100 * len(a & b) >= 75 * len(a | b)] for i, a in sets.items()}
    assert {r.doc_id: r.n_links for r in rows.documents.collect()} == {i: len(x) for i, x in want.items()}
    links = {(r.a, r.b) for r in rows.links.collect()}
    one = {r.class_id for r in rows.documents.collect()}
    assert links == {(i, j) for i in one for j in want[i] if i < j and j in one and sets[i] != sets[j]}
