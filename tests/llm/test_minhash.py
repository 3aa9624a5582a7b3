import random
import re

import pyarrow as pa
import pytest

from plazaworks.llm.minhash import near_components, near_dedup
from plazaworks.llm.shingles import shingle_sets


def plain_sets(texts):
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(words) >= 5:
            yield {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        else:
            yield {tuple(words)} if words else set()


def plain_components(rows):
    """Brute force: (n, component) by id."""
    ids, sets = [r[0] for r in rows], list(plain_sets([r[1] for r in rows]))
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            shared = len(sets[x] & sets[y])
            if shared and 100 * shared >= 75 * len(sets[x] | sets[y]):
                a, b = sorted((root(ids[x]), root(ids[y])))
                up[b] = a
    return {i: (len(s), root(i)) for i, s in zip(ids, sets, strict=True)}


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    line = "this common line stands in very many texts of the corpus"
    rows, k = [], 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9, 40, 150]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append((k, " ".join(changed(rng, base, rng.choice([0, 0, 1, 2, 4, 6])))))
            k += 1
    group = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(120):  # near copies, hardly any two of which are linked
        rows.append((k, " ".join(changed(rng, group, rng.randrange(2, 8)))))
        k += 1
    for _ in range(40):
        rows.append((k, line + "\n" + " ".join(rng.choice(vocabulary) for _ in range(30))))
        k += 1
    for text in (None, "", " \t\n", "One", "one ", "a b c d", "A  B\tC\nD", "é " * 3000, "é " * 2900 + "z"):
        rows.append((k, text))
        k += 1
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    found = {r.doc: (r.n_shingles, r.component_id, r.kept) for r in near_components(docs).collect()}
    wanted = plain_components(corpus)
    assert found == {i: (n, c, c == i) for i, (n, c) in wanted.items()}
    assert 30 < len({c for _, c in wanted.values()}) < len(wanted) - 40


def test_query_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = {r.doc: (r.n_shingles, r.component_id) for r in near_components(docs).collect()}
    assert found == plain_components(rows)


def test_odd_rows(spark):
    text = "a b c d e f g h i j"
    rows = [(None, text, 1), (3, text, 2), (3, text, 3), (2, text, 4), (2, "other words here", 5), (None, None, 6), (9, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc int")
    found = sorted(((r.doc, r.component_id, r.kept) for r in near_components(docs).collect()), key=str)
    assert found == sorted([(None, None, True), (None, None, True), (2, 2, True), (2, 2, True), (3, 2, False), (3, 2, False), (9, 9, True)], key=str)
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 2, 9]
    assert near_components(docs.limit(0)).count() == near_dedup(docs.limit(0)).count() == 0


def test_long_texts_are_hashed_as_one():
    words = [f"word{k % 7919}" for k in range(700_000)]
    long = " ".join(words)
    some = list(shingle_sets(pa.array(["x", long, "x" * 5_000_000 + " a b c d e f", None])))
    assert [len(s) for s in some] == [1, 7919, 3, 0]
    assert set(some[1]) == set(next(shingle_sets(pa.array([" ".join(words[: 7919 + 4])]))))
