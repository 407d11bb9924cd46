"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points in several tables.

A unit vector is turned by random rotations.  A table takes ``POINTS`` blocks of eight coordinates of its own; each
block, shifted and scaled, is decoded to the nearest point of the E8 lattice, and the points of a table name its cell.
A vector lies in its home cell of each table and also visits the ``PROBES`` neighbouring cells that lie nearest, over
all 240 minimal vectors of each block.  Two vectors meet where one is at home and the other at home or on a visit; all
that meet are compared by cosine in double precision.

Projections are sums of whole numbers below 2**53, so a cell doesn't depend on the batch a vector comes in.  That lets
a pair be counted once without listing pairs: of all places where two vectors meet, the first one in the order of
tables counts the link, and every place can tell from the two vectors alone whether it is that one.  Links leave a task
as a number for each vector and as edges that span what is linked there.

Cells that many vectors share are cut into blocks of about ``BLOCK`` rows by hash, and every two blocks of a cell meet
in a task of their own, so a task holds two blocks whatever a cell's share of the rows is.  Equal vectors of a label
are one vector with a weight before any cell is named, so exact copies are never compared.

Settings: ``SCALE`` is the lattice's unit against the deviation of a coordinate of a unit vector, so it holds for any
dimension.  In simulation the four tables of two points with two probes find a pair of cosine 0.93 with 0.97, one of
0.96 with 0.996; a cell holds one of 1,900 unrelated vectors.  More ``points`` make cells smaller, more ``tables`` make
up for it.  Pairs that meet nowhere are not linked; pairs below the threshold never are.

Only vectors of the same label and dimension are compared.  Null labels, vectors that are null, empty, zero or hold
null or non-finite components link with nothing, and are their own component.  Rows of one id are vectors of their own:
equal ones are linked with each other.  A null id counts as the greatest; a component of null ids alone has a null
component_id and is kept.  An empty table gives an empty result.  Other columns are not read.  Vectors are known by
64-bit hashes between tasks.
"""
import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .arrays import lean, mix
from .components import components
from .store import discard, stored

TABLES, POINTS, PROBES, SCALE = 4, 2, 2, 2.8
LEAST = 0.93
BLOCK = 2048
SLICE = 4096  # vectors whose projections, or pairs whose cosines, are worked out at once
SEED = 12


def minimal_vectors():
    """The 240 shortest vectors of E8: two coordinates of 1 or -1, or all of 1/2 or -1/2 with an even number below 0."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = a, b
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def _d8(x):
    """The nearest point of D8 (whole numbers of even sum) of each row."""
    out = np.rint(x)
    error = x - out
    odd = np.flatnonzero(out.sum(1) % 2)
    worst = np.abs(error[odd]).argmax(1)
    out[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return out


def nearest_e8(x):
    """The nearest point of E8 (D8 and D8 moved by a half) of each row; of two equally near ones that of D8."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def units(vectors):
    """Rows of finite, non-zero vectors brought to length 1 in double precision."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


@functools.lru_cache(maxsize=8)
def hashing(dimension, tables=TABLES, points=POINTS, probes=PROBES, scale=SCALE):
    return Hashing(dimension, tables, points, probes, scale)


class Hashing:
    """Home and visited cells of vectors of one dimension."""

    def __init__(self, dimension, tables=TABLES, points=POINTS, probes=PROBES, scale=SCALE):
        self.tables, self.points, self.probes = tables, points, probes
        self.size = max(dimension, 8 * points)
        random = np.random.Generator(np.random.PCG64([SEED, dimension]))
        turned = []
        while sum(map(len, turned)) < 8 * points * tables:
            whole = self.size // 8 * 8
            turned.append(np.linalg.qr(random.standard_normal((self.size, self.size)))[0][:whole])
        rows = np.concatenate(turned)[: 8 * points * tables, :dimension]
        self.rows = np.rint(rows * 2.0**18).T.copy()
        self.factor = np.sqrt(self.size) / scale / 2.0**36
        self.shift = random.uniform(-1, 1, 8 * points * tables)
        self.minimal = minimal_vectors()
        self.longer = (self.minimal**2).sum(1)
        self.weights = mix(np.arange(1, 8 * points + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)

    def _named(self, table, cells):
        """64-bit names of cells: twice the coordinates are whole numbers."""
        twice = np.rint(2 * cells).astype(np.int64).astype(np.uint64)
        return mix((twice * self.weights).sum(1, dtype=np.uint64) + np.uint64((table + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))

    def cells(self, x):
        """(rows, tables, 1 + probes) names of the cells of unit vectors: home first, then visits, nearest first."""
        out = np.empty((len(x), self.tables, 1 + self.probes), dtype=np.uint64)
        for a in range(0, len(x), SLICE):
            part = x[a : a + SLICE]
            turned = np.rint(part * 2.0**18) @ self.rows * self.factor + self.shift
            turned = np.rint(turned * 2.0**20) / 2.0**20
            for t in range(self.tables):
                blocks = [turned[:, 8 * k : 8 * k + 8] for k in range(t * self.points, (t + 1) * self.points)]
                homes = [nearest_e8(b) for b in blocks]
                home = np.concatenate(homes, axis=1)
                out[a : a + SLICE, t, 0] = self._named(t, home)
                further = np.concatenate([self.longer - 2 * ((b - h) @ self.minimal.T) for b, h in zip(blocks, homes)], axis=1)
                every = np.arange(len(part))
                for p in range(1, self.probes + 1):
                    best = further.argmin(1)
                    further[every, best] = np.inf
                    moved = home.copy().reshape(len(part), self.points, 8)
                    moved[every, best // 240] += self.minimal[best % 240]
                    out[a : a + SLICE, t, p] = self._named(t, moved.reshape(len(part), -1))
        return out


def _vectors(column):
    """{dimension: (rows, matrix)} of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    length = np.diff(offsets)
    for d in np.unique(length):
        rows = np.flatnonzero(length == d)
        yield int(d), rows, flat[offsets[rows][:, None] + np.arange(d)]


def _raw(matrix):
    """Rows of numbers as a binary column."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def _entries(settings, with_vectors):
    """From (node, label, weight, vector) one row for each home (visit 0) and visit: with ``with_vectors`` all of it,
    else the cell alone."""
    def entries(batches):
        for batch in batches:
            node, label, weight = batch.column(0), batch.column(1), batch.column(2)
            for d, rows, matrix in _vectors(batch.column(3)):
                for a in range(0, len(rows), SLICE):
                    at, part = rows[a : a + SLICE], matrix[a : a + SLICE]
                    cells = hashing(d, *settings).cells(units(part)).view(np.int64)
                    take = pa.array(at)
                    fixed = [node.take(take), label.take(take), weight.take(take), _raw(part)] if with_vectors else [label.take(take)]
                    for t in range(cells.shape[1]):
                        for p in range(cells.shape[2]):
                            columns = [pa.array(np.ascontiguousarray(cells[:, t, p])), pa.array(np.full(len(at), d, np.int32))]
                            if with_vectors:
                                columns += [pa.array(np.full(len(at), t, np.int32)), pa.array(np.full(len(at), p > 0))]
                            names = ["cell", "dimension", "place", "visits", "node", "label", "weight", "vector"] if with_vectors else ["cell", "dimension", "label"]
                            yield pa.RecordBatch.from_arrays([*columns, *fixed], names=names)
    return entries


def spanning(a, b, n):
    """Of pairs (a, b) of 0 to n - 1, edges (first of a group, other) that join the same groups."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(n))
    return root[other], other


class Cell:
    """Rows of one block pair of a cell; finds the links that are counted here."""

    def __init__(self, cell, table, dimension, settings, least):
        self.cell, self.table, self.hashing, self.least = np.uint64(cell % (1 << 64)), table, hashing(dimension, *settings), least

    def links(self, x, visits, node, side):
        """Pairs of rows (i, j) that are linked and counted here.  ``side`` tells the two blocks apart; with one value
        only, all pairs inside the block are meant."""
        n, both = len(x), len(np.unique(side)) > 1
        first, second = [], []
        for a in range(0, n, 1024):
            s = x[a : a + 1024] @ x.T
            near = np.abs(s - self.least) < 1e-9
            if near.any():  # decided in one fixed order of summation
                i, j = np.nonzero(near)
                s[i, j] = (x[a + i] * x[j]).sum(1)
            hit = s >= self.least
            hit &= ~(visits[a : a + 1024, None] & visits[None])
            if both:
                hit &= side[a : a + 1024, None] < side[None]
            else:
                hit &= np.arange(a, a + len(s))[:, None] < np.arange(n)[None]
            i, j = np.nonzero(hit)
            first.append(a + i)
            second.append(j)
        i, j = np.concatenate(first), np.concatenate(second)
        if not len(i):
            return i, j
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        cells = self.hashing.cells(x[used])
        at_i, at_j = at[: len(i)], at[len(i) :]
        parts = [slice(k, k + SLICE) for k in range(0, len(i), SLICE)]
        counted = np.concatenate([self._counted(cells[at_i[p]], cells[at_j[p]], node[i[p]] < node[j[p]]) for p in parts])
        return i[counted], j[counted]

    def _counted(self, a, b, a_first):
        """Whether this is the first place where rows of cells ``a`` and ``b`` meet."""
        at_a = (b == a[:, :, :1]).any(2)  # b comes to a's home
        at_b = (a == b[:, :, :1]).any(2)
        before = (at_a[:, : self.table] | at_b[:, : self.table]).any(1)
        home_a, home_b = a[:, self.table, 0] == self.cell, b[:, self.table, 0] == self.cell
        # Where each visits the other's home, the home of the smaller node counts.
        twice = at_a[:, self.table] & at_b[:, self.table] & ~(home_a & home_b)
        return ~before & (~twice | np.where(a_first, home_a, home_b))


def _linked(settings, least):
    """From entries sorted by cell and block pair: (a, null, n) for a's number of links, (a, b, null) for edges."""
    def linked(batches):
        key, parts = None, []

        def close():
            rows = pa.Table.from_batches(parts)
            if len(rows) < 2:
                return None
            names = rows.column_names
            column = {c: rows.column(c) for c in names}
            cell, dimension, place, side = (column[c][0].as_py() for c in ("cell", "dimension", "place", "side"))
            data = b"".join(column["vector"].to_pylist())
            x = units(np.frombuffer(data, np.float32 if len(data) == 4 * dimension * len(rows) else np.float64).reshape(len(rows), dimension))
            node, weight, visits, sides = (column[c].to_numpy() for c in ("node", "weight", "visits", "side"))
            if key[-1] and sides.min() == sides.max():
                return None  # a pair of blocks of which one is empty
            i, j = Cell(cell, place, dimension, settings, least).links(x, visits, node, sides)
            if not len(i):
                return None
            n = np.zeros(len(rows), np.int64)
            np.add.at(n, i, weight[j])
            np.add.at(n, j, weight[i])
            have = np.flatnonzero(n)
            root, other = spanning(i, j, len(rows))
            a = np.concatenate([node[have], node[root]])
            b = np.concatenate([np.zeros(len(have), np.int64), node[other]])
            edge = np.arange(len(a)) >= len(have)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=~edge), pa.array(np.concatenate([n[have], np.zeros(len(root), np.int64)]), mask=edge)], names=["a", "b", "n"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "cell", "dimension", "one", "two", "cross"))))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != key and parts:
                    if (out := close()) is not None:
                        yield out
                    parts = []
                key = keys[at]
                parts.append(batch.slice(at, end - at))
                at = end
        if parts and (out := close()) is not None:
            yield out
    return linked


def link_vectors(rows, vec_id="vec_id", vector="embedding", label="label", least=LEAST, tables=TABLES, points=POINTS, probes=PROBES, scale=SCALE, block=BLOCK):
    """One row per row: its id, n_links (other vectors linked with it), component_id (the smallest id that it reaches
    by links) and kept (it is that one)."""
    settings = (tables, points, probes, scale)
    inner = rows.schema[vector].dataType.elementType.simpleString()
    kind = inner if inner in ("float", "double") else "double"
    v = F.col(vector).cast(f"array<{kind}>")
    zero = F.lit(0).cast(kind)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast(kind)))
    fit = F.col(label).isNotNull() & v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    clean = F.transform(v, lambda x: x + zero)  # no negative zeros
    source = rows.select(F.col(vec_id).alias("vec_id"), F.when(fit, F.xxhash64(F.col(label).cast("string"), clean)).alias("node"),
                         F.when(fit, F.xxhash64(F.col(label).cast("string"))).alias("label"), F.when(fit, clean).alias("vector"))
    classes = stored(source.where("node is not null").groupBy("node", "label", "vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first")), "vectors")
    narrow = classes.select("node", "label", "weight", "vector")
    where = narrow.mapInArrow(lean(_entries(settings, False)), "cell long, dimension int, label long")
    keys = ["label", "cell", "dimension"]
    large = stored(where.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > block), "large-cells").select(*keys, F.ceil(F.col("rows") / block).cast("int").alias("blocks"))
    wide = narrow.mapInArrow(lean(_entries(settings, True)), "cell long, dimension int, place int, visits boolean, node long, label long, weight long, vector binary").join(large, keys, "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("node", F.lit(SEED)), blocks).cast("int")
    met = wide.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select(*keys, F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), (F.col("side") != F.col("other")).alias("cross"), "side", "place", "visits", "node", "weight", "vector")
    group = [*keys, "one", "two"]
    dealt = met.repartition(*group).sortWithinPartitions(*group, "node")
    found = stored(dealt.mapInArrow(lean(_linked(settings, least)), "a long, b long, n long"), "links")
    edges = found.where("b is not null").select("a", "b")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    roots = components(edges)
    rooted = classes.select("node", "first", "weight").join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    about = stored(rooted.join(smallest, "root").select("node", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "vector-classes")
    discard(classes, found, roots)
    out = source.select("vec_id", "node").join(about, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(F.col("vec_id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_lattice(spark, sf_dir):
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# All pairs of a label, and a closure over the links; hashing is held against it.
SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e, label FROM embeddings
), fit AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM fit a JOIN fit b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT r, r AS to_r FROM v UNION SELECT reach.r, link.b FROM reach JOIN link ON link.a = reach.to_r
), low AS (
  SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.to_r GROUP BY reach.r
)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = v.r) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN low USING (r)
"""
