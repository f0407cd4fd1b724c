"""Exact near-duplicate join of embeddings: pivots part the sphere, the triangle inequality sets what crosses a border."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceloom.llm.components import connected_components
from sliceloom.llm.store import save

#: Most pivots: bounds the broadcast to PIVOTS vectors whatever the table's size.
PIVOTS = 1024
#: Vectors a cell should have where borders are seldom crossed and where they often are, and vectors on one side of a task.
FINE, COARSE, CHUNK = 256, 4096, 4096
#: Mean cells of a vector up to which the finer cells are taken.
FEW_VISITS = 8
_ROUNDING = 1e-9
#: Single precision decides pairs farther than this from the threshold, double precision the others.
_MARGIN = 1e-4


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def _components(linked: np.ndarray) -> np.ndarray:
    """Labels of homes and then targets of a boolean matrix: equal labels, connected by it."""
    nh, nt = linked.shape
    label_h, label_t = np.arange(nh), np.full(nt, nh + nt)
    rows, cols = np.nonzero(linked)
    if not len(rows):
        return np.concatenate((label_h, nh + np.arange(nt)))
    order = np.argsort(cols, kind="stable")
    row_at, row_first = np.unique(rows, return_index=True)
    col_at, col_first = np.unique(cols[order], return_index=True)
    while True:
        before = label_h.copy()
        label_t[col_at] = np.minimum(label_t[col_at], np.minimum.reduceat(label_h[rows[order]], col_first))
        label_h[row_at] = np.minimum(label_h[row_at], np.minimum.reduceat(label_t[cols], row_first))
        label_h = label_h[label_h]
        if (before == label_h).all():
            break
    alone = label_t == nh + nt
    label_t[alone] = nh + np.flatnonzero(alone)
    return np.concatenate((label_h, label_t))


def _linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    near = a.astype(np.float32) @ b.astype(np.float32).T
    linked = near >= least + _MARGIN
    i, j = np.nonzero(np.abs(near - np.float32(least)) < 2 * _MARGIN)
    for k in range(0, len(i), 1 << 16):
        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        linked[x, y] = (a[x] * b[y]).sum(axis=1) >= least
    return linked


def _compare(table: pa.Table, least: float) -> pa.Table:
    """One task's homes against its targets: (node, other, n): n vectors linked with a home, or other in node's component."""
    home = np.asarray(table.column("side")) == 0
    column = table.column("vector").combine_chunks()
    x = _matrix(column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks))
    node, n = np.asarray(table.column("node")), np.asarray(table.column("n"))
    homes, targets = np.flatnonzero(home), np.flatnonzero(~home)
    rows: list[tuple[np.ndarray, np.ndarray | None, np.ndarray]] = []
    for k in range(0, len(homes) if len(targets) else 0, 1024):
        part = homes[k : k + 1024]
        linked = _linked(x[part], x[targets], least) & (node[part][:, None] != node[targets][None, :])
        counts = linked @ n[targets]
        some = np.flatnonzero(counts)
        if len(some):
            label, both = _components(linked), np.concatenate((node[part], node[targets]))
            edge = np.flatnonzero(both[label] != both)
            rows += [(node[part][some], None, counts[some]), (both[edge], both[label][edge], np.zeros(len(edge), np.int64))]
    other = [pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()) for a, b, _ in rows]
    columns = [pa.chunked_array([pa.array(a, pa.int64()) for a, _, _ in rows], pa.int64()), pa.chunked_array(other, pa.int64()), pa.chunked_array([pa.array(c, pa.int64()) for _, _, c in rows], pa.int64())]
    return pa.table(columns, names=["node", "other", "n"])


def _crossings(d: np.ndarray, cell: np.ndarray, between: np.ndarray, r: float) -> np.ndarray:
    """Whether a vector's ball of radius r can reach over the plane between its own pivot and each other pivot."""
    own, gap = d[np.arange(len(d)), cell][:, None], between[cell]
    plane = np.where(gap > 1e-6, (d * d - own * own) / np.maximum(2.0 * gap, 1e-6), 0.0)
    crosses = plane <= r + _ROUNDING + 1e-9 / np.maximum(gap, 1e-6)
    crosses[np.arange(len(d)), cell] = True
    return crosses


def _every_pair(vectors: DataFrame, total: int, least: float) -> DataFrame:
    """range_join where nothing can be left out: blocks of about CHUNK vectors against blocks, read again for each other block instead of shuffled for it, so that the disk holds the vectors once and again as blocks."""
    blocks = max(1, -(-total // CHUNK))

    def packed(table: pa.Table) -> pa.Table:
        return pa.table({"block": table.column("block").slice(0, 1), "node": [table.column("node").to_pylist()], "n": [table.column("n").to_pylist()], "vectors": [_packed(table.column("vector").combine_chunks())]}, schema=pa.schema([("block", pa.int64()), ("node", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("vectors", pa.binary())]))

    dealt = vectors.select(F.pmod(F.xxhash64("node", F.lit(9)), F.lit(blocks)).cast("long").alias("block"), "node", "n", "vector")
    held = save(dealt.groupBy("block").applyInArrow(packed, "block long, node array<long>, n array<long>, vectors binary"), "blocks")
    spread = min(blocks, max(32, -(-blocks // 4)))  # tasks: its square; a task gets few pairs of blocks at once
    side = lambda name: held.select(*[F.col(c).alias(f"{name}_{c}") for c in held.columns]).repartition(spread, f"{name}_block")
    names = ("block", "node", "n", "vectors")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                home, other = ([batch.column(f"{s}_{c}")[at] for c in names] for s in ("a", "b"))
                found = _compare_blocks(_unpacked(home), _unpacked(other), home[0].as_py() == other[0].as_py(), least)
                yield from found.to_batches()

    pairs = side("a").hint("shuffle_replicate_nl").crossJoin(side("b")).where("a_block <= b_block")
    return pairs.mapInArrow(compare, "node long, other long, n long")


def _packed(column: pa.Array | pa.ChunkedArray) -> bytes:
    """Components as they are: in single precision where that loses nothing."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).astype(np.float64)
    with np.errstate(over="ignore"):
        short = flat.astype(np.float32)
    return b"4" + short.tobytes() if (short == flat).all() else b"8" + flat.tobytes()


def _unpacked(block: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, node, n, held = block
    raw = held.as_py()
    flat = np.frombuffer(raw, np.float32 if raw[:1] == b"4" else np.float64, offset=1).astype(np.float64)
    node = node.values.to_numpy()
    return node, n.values.to_numpy(), _matrix(pa.FixedSizeListArray.from_arrays(pa.array(flat), len(flat) // len(node)))


def _compare_blocks(home: tuple, other: tuple, same: bool, least: float) -> pa.Table:
    """_compare of one block with another, seen from both ends; of a block with itself, once."""
    (node, n, x), (theirs, m, y) = home, other
    mine, yours, edges = np.zeros(len(node), np.int64), np.zeros(len(theirs), np.int64), []
    for k in range(0, len(node), 1024):
        linked = _linked(x[k : k + 1024], y, least) & (node[k : k + 1024, None] != theirs[None])
        mine[k : k + 1024] = linked @ m
        if not same:
            yours += n[k : k + 1024] @ linked
        if linked.any():
            label, both = _components(linked), np.concatenate((node[k : k + 1024], theirs))
            edge = np.flatnonzero(both[label] != both)
            edges.append((both[edge], both[label][edge]))
    a, b = np.flatnonzero(mine), np.flatnonzero(yours)
    nodes = np.concatenate([node[a], theirs[b], *[e for e, _ in edges]])
    others = pa.concat_arrays([pa.nulls(len(a) + len(b), pa.int64()), *[pa.array(o, pa.int64()) for _, o in edges]])
    counts = np.concatenate([mine[a], yours[b], np.zeros(len(nodes) - len(a) - len(b), np.int64)])
    return pa.table([pa.array(nodes, pa.int64()), others, pa.array(counts, pa.int64())], names=["node", "other", "n"])


def range_join(vectors: DataFrame, least: float) -> DataFrame:
    """vectors (node long, vector array<double>, n long), of one length each -> (node, other, n) as in _compare, exact at `least`.

    Every vector has a home, the cell of its nearest pivot, and also visits each cell whose border its ball of the
    join radius can cross: by the distance to the bisecting plane of the two pivots, and by the triangle inequality
    with the cell's radius. Homes of a cell meet its homes and visitors, so each pair is seen from both ends and cells
    stay independent. Where even coarse cells are mostly crossed, blocks of vectors meet as they are (see _every_pair). Large cells are cut into chunks; pivots are a sample fixed by a hash, of at most PIVOTS;
    where the sample shows that balls reach many cells, as in high dimensions without clusters, cells are coarser, so that
    vectors are not sent to ever more cells for the same comparisons.
    """
    spark = vectors.sparkSession
    total, = vectors.agg(F.count(F.lit(1))).first()
    wanted, coarse = (min(PIVOTS, max(1, -(-total // k))) for k in (FINE, COARSE))
    share = max(1, int(wanted / max(1, total) * 2**31))
    sampled = vectors.withColumn("_hash", F.shiftrightunsigned(F.xxhash64("node", F.lit(6)), 33)).where(F.col("_hash") < share)
    pivots = [r["vector"] for r in sampled.select("vector").limit(4 * PIVOTS).collect()] or [r["vector"] for r in vectors.select("vector").limit(1).collect()]
    if not pivots:
        return spark.createDataFrame([], "node long, other long, n long")
    p = _matrix(pa.array(sorted(pivots), pa.list_(pa.float64())))
    p = p[np.random.default_rng(len(p)).permutation(len(p))]
    r = math.sqrt(2.0 - 2.0 * least)
    d = _distances(p[:512], p)
    np.fill_diagonal(d, np.inf)  # a pivot is judged as a vector of some other cell
    if len(p) > coarse and _crossings(d, d.argmin(axis=1), _distances(p, p), r).sum(axis=1).mean() > FEW_VISITS:
        p = p[:coarse]
        d = _distances(p[:512], p)
        np.fill_diagonal(d, np.inf)
        if len(p) > FEW_VISITS and _crossings(d, d.argmin(axis=1), _distances(p, p), r).sum(axis=1).mean() > len(p) / 2:
            return _every_pair(vectors, total, least)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = _distances(_matrix(batch.column("vector")), p)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "cell", "far"])

    homes = save(vectors.select("node", "vector", "n").mapInArrow(settle, "node long, vector array<double>, n long, cell int, far double"), "homes")
    radii = np.full(len(p), -np.inf)
    for row in homes.groupBy("cell").agg(F.max("far").alias("far")).collect():  # a row a pivot
        radii[row["cell"]] = row["far"]
    between = _distances(p, p)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                d = _distances(_matrix(batch.column("vector")), p)
                cell = batch.column("cell").to_numpy()
                crosses = _crossings(d, cell, between, r) & (d <= radii[None, :] + r + 1e-6)
                crosses[np.arange(len(d)), cell] = True
                rows, cells = np.nonzero(crosses)
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([taken.column("node"), taken.column("vector"), taken.column("n"), pa.array(cells, pa.int32())], names=["node", "vector", "n", "cell"])

    targets = save(homes.mapInArrow(visit, "node long, vector array<double>, n long, cell int"), "targets")
    pieces = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias(name))
    chunks = pieces(homes, "hs").join(pieces(targets, "ts"), "cell")
    to = lambda own, other: (F.pmod(F.xxhash64("node"), F.col(own)).alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("theirs"))
    left = homes.join(F.broadcast(chunks), "cell").select("cell", "node", "vector", "n", *to("hs", "ts")).select(F.xxhash64("cell", "mine", "theirs").alias("task"), F.lit(0).alias("side"), "node", "vector", "n")
    right = targets.join(F.broadcast(chunks), "cell").select("cell", "node", "vector", "n", *to("ts", "hs")).select(F.xxhash64("cell", "theirs", "mine").alias("task"), F.lit(1).alias("side"), "node", "vector", "n")
    return left.unionByName(right).groupBy("task").applyInArrow(lambda t: _compare(t, least), "node long, other long, n long")


def _classes(rows: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows with node, classes): a number for each distinct vector, null for vectors that link with nothing. Vectors of one number are compared; where two differ, all are numbered anew."""
    salt = 0
    while True:
        low = F.lit((1 << bits) - 1 if bits < 64 and not salt else -1).cast("long")
        numbered = rows.withColumn("node", F.when(F.col("good"), F.xxhash64("vector", F.lit(salt)).bitwiseAND(low)))
        classes = save(numbered.where("good").groupBy("node", "vector").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")), "classes")
        if classes.groupBy("node").count().where("count > 1").isEmpty():
            return numbered, classes
        salt += 1


def near_duplicates(embeddings: DataFrame, least: float = 0.9, bits: int = 64) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings (vec_id long, embedding array of float or double).

    Rows link at a cosine of at least `least` in double precision; only vectors of equal length are compared. Equal
    vectors are one class, joined as one vector and counted by its rows, so a very common vector costs one. Null or
    zero vectors and those with null or non-finite components link with nothing and are kept. A row without vec_id
    counts as a link of others but is never a component's id. Repeated rows are vectors like others; other columns
    play no part; an empty table gives an empty table. bits: of the numbers of distinct vectors at first.
    """
    rows = embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    bad = F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("vector", lambda x: x != 0.0)
    rows, classes = _classes(save(rows.withColumn("good", ~F.coalesce(bad, F.lit(True))), "vectors"), bits)
    found = None
    for (length,) in classes.select(F.size("vector").alias("k")).distinct().collect():  # a row for each length of vector
        part = range_join(classes.where(F.size("vector") == length).select("node", "vector", "n"), least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = save(found, "links")
    links = found.where("other is null").groupBy("node").agg(F.sum("n").alias("others"))
    labels = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = classes.select("node", "n", "least").join(links, "node", "left").join(labels, "node", "left")
    component = known.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    ends = known.join(component, "root", "left").select("node", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    out = rows.select("vec_id", "node").join(ends, "node", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
