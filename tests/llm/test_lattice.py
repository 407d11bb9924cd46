"""Lattice hashing: decoding against all lattice points near, links and components against all pairs, edge cases."""
import duckdb
import itertools

import numpy as np
import pytest

from chronotext.llm import lattice

TYPE = "vec_id long, embedding array<{}>, label int, node long, cell string"


def expected(rows, least=0.93):
    """{place: (n_links, component, kept)} by all pairs of (vec_id, vector, label)."""
    fit = [v is not None and len(v) > 0 and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    links = [[] for _ in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if fit[i] and fit[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
            x, y = np.float64(rows[i][1]), np.float64(rows[j][1])
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i].append(j)
                links[j].append(i)
    out, seen = {}, {}
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            seen |= {j: min(ids, default=None) for j in group}
        out[i] = (len(links[i]), seen[i], rows[i][0] == seen[i])
    return out


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 5, "x") for i, v, label in rows], TYPE.format(kind))


def compare(made, rows):
    want = sorted((str(rows[i][0]), *map(str, w)) for i, w in expected(rows).items())
    assert sorted((str(r.vec_id), str(r.n_links), str(r.component_id), str(r.kept)) for r in made.collect()) == want


def near(random, x, cosine):
    g = random.standard_normal(len(x))
    g -= (g @ x) * x / (x @ x)
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * g / np.linalg.norm(g)


def clusters(seed=1, dimension=64):
    random = np.random.default_rng(seed)
    rows = []
    for k in range(40):
        x = random.standard_normal(dimension)
        rows += [(len(rows) + c, np.float32(near(random, x, 0.995) * (c + 1)), k % 3) for c in range(k % 7 + 1)]
    rows += [(1000 + i, v, label) for i, v, label in rows[::9]]  # exact copies under other ids
    return rows + [(2000 + k, np.float32(random.standard_normal(dimension)), 1) for k in range(60)]


def test_decoding_finds_the_nearest_point():
    random = np.random.default_rng(2)
    minimal = lattice.minimal_vectors()
    assert len(minimal) == 240 and np.allclose((minimal**2).sum(1), 2)
    x = random.uniform(-3, 3, (500, 8))
    got = lattice.nearest_e8(x)
    twice = np.rint(2 * got)
    assert np.allclose(twice, 2 * got) and len(set(map(tuple, twice % 2))) == 2 and all(len(set(r % 2)) == 1 and r.sum() % 4 == 0 for r in twice)
    # A point is nearest if none of its neighbours over minimal vectors is nearer: these make the walls of its region.
    own = ((x - got) ** 2).sum(1)
    others = ((x[:, None] - got[:, None] - minimal[None]) ** 2).sum(2).min(1)
    assert (own <= others + 1e-9).all()


def test_cells_do_not_depend_on_the_batch():
    random = np.random.default_rng(3)
    x = lattice.units(random.standard_normal((200, 64)))
    hashing = lattice.Hashing(64)
    whole = hashing.cells(x)
    assert (np.concatenate([hashing.cells(x[k : k + 1]) for k in range(200)]) == whole).all()
    assert all(len(set(cells)) == 3 for row in whole for cells in row)


@pytest.mark.parametrize("dimension", [64, 3, 100])
def test_recall_at_the_threshold(dimension):
    random = np.random.default_rng(4)
    x = lattice.units(random.standard_normal((1500, dimension)))
    hashing = lattice.Hashing(dimension)
    a = hashing.cells(x)
    for cosine, least in ((0.9301, 0.93), (0.96, 0.98)):
        b = hashing.cells(lattice.units(np.array([near(random, v, cosine) for v in x])))
        met = ((b == a[:, :, :1]).any(2) | (a == b[:, :, :1]).any(2)).any(1)
        assert met.mean() >= least


@pytest.mark.parametrize("block,kind", [(2048, "float"), (3, "float"), (2048, "double")])
def test_links_against_all_pairs(spark, block, kind):
    rows = clusters()
    compare(lattice.link_vectors(frame(spark, rows, kind).repartition(5), block=block), rows)


def test_hot_cell_in_blocks(spark):
    random = np.random.default_rng(5)
    x = random.standard_normal(16)
    rows = [(k, np.float32(x + random.standard_normal(16) * 0.26 * np.linalg.norm(x) / 4), 0) for k in range(150)]
    every = expected(rows)
    assert 0 < sum(w[0] for w in every.values()) < 150 * 149
    compare(lattice.link_vectors(frame(spark, rows).repartition(4), block=20, probes=12, tables=12), rows)


def test_edge_cases(spark):
    v, w = [1.0] + [0.0] * 15, [0.0, 1.0] + [0.0] * 14
    big, nan = [1e38] * 16, float("nan")
    rows = [(1, v, 0), (1, v, 0), (2, v, 1), (3, v, None), (4, None, 0), (5, [0.0] * 16, 0), (6, [None] + v[1:], 0), (7, [nan] * 16, 0), (8, [float("inf")] * 16, 0), (9, v[:8], 0), (10, [], 0),
            (11, w, 0), (12, [-0.0, 2.0] + [-0.0] * 14, 0), (None, w, 0), (None, v, 2), (None, None, 0), (13, big, 0), (14, [1e-38] * 16, 0), (15, [2.0], 0), (16, [3.0], 0), (17, [-3.0], 0)]
    compare(lattice.link_vectors(frame(spark, rows)), rows)
    compare(lattice.link_vectors(frame(spark, rows, "double")), rows)
    assert lattice.link_vectors(frame(spark, rows).limit(0)).collect() == []


def test_sql_on_clusters(spark):
    rows = clusters()
    made = lattice.link_vectors(frame(spark, rows))
    con = duckdb.connect()
    con.register("embeddings", made.sparkSession.createDataFrame([(i, [float(x) for x in v], label) for i, v, label in rows], "vec_id long, embedding array<float>, label int").toArrow())
    assert sorted(con.sql(lattice.SQL).fetchall()) == sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in made.collect())
