import itertools
import math

import numpy as np

from plazaworks.llm import lattice


def plain(rows, threshold=0.93):
    """{vec_id: (n_links, component)} by comparing all pairs, vectors divided by their largest component."""
    good = [(i, label, np.array(v, dtype=float) / max(map(abs, v))) for i, v, label in rows if label is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    links = {i: set() for i, _, _ in rows}
    for (i, a, x), (j, b, y) in itertools.combinations(good, 2):
        if a == b and len(x) == len(y) and x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= threshold:
            links[i].add(j)
            links[j].add(i)
    component = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i in links:
            least = min([component[i], *(component[j] for j in links[i])])
            changed |= least < component[i]
            component[i] = least
    return {i: (len(links[i]), component[i]) for i in links}


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 3
    near = lattice.decode_e8(x)
    assert ((near % 2 == near[:, :1] % 2).all()) and (near.sum(axis=1) % 4 == 0).all()
    own = ((x - near / 2) ** 2).sum(axis=1)
    assert (own <= 1 + 1e-9).all()  # the covering radius
    for v in lattice._NEIGHBOURS:
        assert (own <= ((x - (near + v) / 2) ** 2).sum(axis=1) + 1e-9).all()
    assert len({tuple(v) for v in lattice._NEIGHBOURS.tolist()}) == 240


def test_recall_at_the_bound():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    (own, seen), (own2, seen2) = lattice.cells_of(x), lattice.cells_of(y)
    met = (seen == own2[:, :, None]).any(axis=(1, 2)) | (seen2 == own[:, :, None]).any(axis=(1, 2))
    assert met.mean() > 0.99


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        base = rng.normal(size=64)
        for _ in range(rng.integers(1, 9)):
            v = base + rng.normal(size=64) * rng.choice([0, 0.1, 0.25, 0.4])
            rows.append((len(rows), (v * rng.uniform(0.1, 50)).astype(np.float32).tolist(), int(k % 3)))
    n = len(rows)
    one = [1.0, 0.0] * 32
    odd = [None, [], [0.0] * 64, [None, *one[1:]], [float("nan"), *one[1:]], [float("inf"), *one[1:]], one, one, [-0.0, 1.0, *one[2:]], [0.0, 1.0, *one[2:]], [1.0, 2.0], [2.0, 4.0], [1e30] * 64, [1e-30] * 64]
    rows += [(n + k, v, 1) for k, v in enumerate(odd)] + [(n + 100, one, None), (n + 101, one, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    found = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(df).collect()}
    wanted = plain(rows)
    assert found == wanted
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_the_ends_of_double(spark):
    turned = [-1.0, *[1.0] * 7]
    vectors = [[1e-200] * 8, [1.1e-200] * 8, [1e200] * 8, [1e200 * x for x in turned], [5e-324] * 8, [1.7e308] * 8, [1e300, *[1e-300] * 7], [1.0, *[0.0] * 7], [1.0] * 9]
    rows = [(k, v, 1) for k, v in enumerate(vectors)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert found == plain(rows) and found[0] == (4, 0) and found[3] == (0, 3) and found[6] == (1, 6) and found[8] == (0, 8)


def cloud(rng, base, angles):
    """Unit vectors at given angles from base."""
    base = base / np.linalg.norm(base)
    side = rng.normal(size=(len(angles), len(base)))
    side -= (side @ base)[:, None] * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return np.cos(angles)[:, None] * base + np.sin(angles)[:, None] * side


def test_wide_and_touching_groups_of_several_lengths(spark):
    rng = np.random.default_rng(11)
    rows, widest = [], math.acos(0.93)
    for dim in (16, 64):
        for label in range(3):
            base = rng.normal(size=dim)
            axis = cloud(rng, base, np.array([1.3 * widest]))[0]
            groups = [cloud(rng, base, rng.uniform(0, 0.4 * widest, 60)), cloud(rng, axis, rng.uniform(0, 0.5 * widest, 40)), cloud(rng, base + axis, rng.uniform(0, 0.9 * widest, 40)), rng.normal(size=(20, dim))]
            rows += [(v * rng.uniform(0.1, 9)).tolist() for v in np.concatenate(groups)]
    rows = [(k, v, k // 160 % 3) for k, v in zip(rng.permutation(len(rows)).tolist(), rows)]
    rows = [(k, v, n // 160 % 3) for n, (k, v, _) in enumerate(rows)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    wanted = plain(rows)
    links = sum(n for n, _ in wanted.values())
    assert links > 10_000 and sum(n for n, _ in found.values()) >= 0.999 * links
    assert all(found[k][0] <= n for k, (n, _) in wanted.items())
    assert np.mean([found[k] == wanted[k] for k in wanted]) > 0.98


def test_rows_without_or_with_the_same_id(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(None, v, 1), (1, v, 1), (1, v, 1), (5, w, 1), (2, v, 1), (2, w, 1)], "vec_id long, embedding array<float>, label int")
    found = sorted(map(tuple, lattice.near_vectors(df).collect()), key=str)
    assert found == sorted([(None, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (5, 1, 2, False), (2, 1, 1, False), (2, 1, 1, False)], key=str)


def test_query_on_the_small_table(spark):
    from plazaworks.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op10_embedding_near_dedup"](spark, folder).collect()}
    assert found == plain(rows)
