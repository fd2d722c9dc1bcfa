"""Which documents the dropping stages keep, with equal and null ids."""

import random

import numpy as np

from labelworks.llm import exact, licenses, near

DOCS = "doc_id long, text string, kind string, _rows long, text_sha256 string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "k", 7, "x") for r in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_different_texts_under_one_id_stay(spark):
    rng = random.Random(1)
    texts = [prose(rng, 30) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (9, texts[4]), (5, None), (6, ""), (None, None)]
    df = docs_of(spark, rows)
    plain = sorted(map(str, rows))
    assert sorted(str((r["doc_id"], r["text"])) for r in near.drop_near(df).collect()) == plain
    got = sorted(str((r["doc_id"], r["text"])) for r in exact.drop_exact(df).collect())
    # null and empty texts are equal: the smallest id stays
    assert got == sorted(map(str, [*rows[:5], (5, None)]))


def test_repeated_rows_and_copies_leave_one(spark):
    rng = random.Random(2)
    a, b, c = prose(rng, 40), prose(rng, 40), prose(rng, 40)
    near_a = a + " more"
    rows = [(5, a)] * 3 + [(5, a.replace(" ", "  ")), (5, b), (4, b), (None, c), (None, c), (7, near_a), (5, near_a)]
    df = docs_of(spark, rows)
    got = [(r["doc_id"], r["text"]) for r in exact.drop_exact(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(5, rows[3][1]), (4, b), (None, c), (5, near_a)]))
    got = [(r["doc_id"], r["text"]) for r in near.drop_near(df).collect()]
    assert len(got) == 3 and {r for r in got if r[0] != 5} == {(4, b), (None, c)}
    assert next(r for r in got if r[0] == 5)[1] in (a, rows[3][1], near_a)


def test_blocks_give_forests_of_exact_links(spark):
    """A chain of texts just above the threshold, and one just below it, with buckets split into many blocks."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, 150).astype(np.uint64)) for _ in range(60)]
    sets += [np.delete(sets[0], [i, i + 1]) for i in range(0, 100, 2)]
    both = near.shared(sets)
    for i in range(0, len(sets), 7):
        for j in range(0, len(sets), 5):
            assert both[i, j] == len(np.intersect1d(sets[i], sets[j]))
    nodes = np.arange(len(sets))
    a, b = near._links(nodes, nodes, sets, 80)
    assert len(a) <= len(sets) - 1
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            n = both[i, j]
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    found = list(range(len(sets)))

    def root2(i):
        while found[i] != i:
            i = found[i]
        return i

    for i, j in zip(a, b):
        found[root2(i)] = root2(j)
    assert len({root(i) for i in nodes}) == len({root2(i) for i in nodes})


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 2_000)
    rng = random.Random(4)
    base = prose(rng, 120).split()
    rows = []
    for i in range(80):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(0, 6)):
            words[at] = prose(rng, 1)
        rows.append((i, " ".join(words)))
    rows += [(100 + i, prose(rng, 60)) for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs_of(spark, rows)).collect()}
    grams = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    parent = {i: i for i in grams}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in grams:
        for j in grams:
            if i < j and 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in grams}


def test_an_empty_template_table_finds_nothing(spark):
    none = spark.createDataFrame([], "license string, text string")
    df = docs_of(spark, [(1, "Licensed under the MIT License")])
    assert [r["matches"] for r in licenses.license_matches(df, none).collect()] == [[]]
