"""Near-duplicate detection by min-max hashing: both ends of every permutation, banded, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceloom.llm import kernels as K
from sliceloom.llm.components import connected_components
from sliceloom.llm.store import prefix_for, save

U = np.uint64
BANDS, ROWS = 32, 4
#: Least similarity in hundredths.
PERCENT = 75
#: Texts on one side of a comparing task, and their UTF-8 bytes.
CHUNK, CHUNK_BYTES = 256, 4 << 20


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(31)
    return rng.integers(0, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n).astype(np.uint32)


def set_key(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set (0 for an empty one)."""
    total = np.concatenate((np.zeros(1, U), np.cumsum(K.mix(hashes ^ U(0x5851F42D4C957F2D)))))
    n = np.diff(first).astype(U)
    key = K.mix(total[first[1:]] - total[first[:-1]] + n * U(0x9E3779B97F4A7C15))
    return np.where(n > 0, key, U(0)).view(np.int64)


def signatures(hashes: np.ndarray, first: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys (sets x bands) of non-empty sets: band b holds minimum and maximum under rows / 2 permutations of its own."""
    each = rows // 2
    a, b = _permutations(bands * each)
    short = (hashes >> U(32)).astype(np.uint32)
    at = first[:-1]
    keys = np.empty((len(at), bands), U)
    for band in range(bands):
        key = np.full(len(at), U(band + 1))
        for p in range(band * each, band * each + each):
            h = short * a[p] + b[p]
            ends = np.minimum.reduceat(h, at).astype(U) << U(32) | np.maximum.reduceat(h, at).astype(U)
            key = K.mix(key + ends)
        keys[:, band] = key
    return keys.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, hashes, first in K.shingle_sets(batch.column("text")):
            n = np.diff(first)
            full = np.flatnonzero(n)
            keys = np.zeros((0, BANDS), np.int64)
            if len(full):
                keys = signatures(hashes, np.append(first[:-1][full], len(hashes)))
            ends = np.zeros(j - i + 1, np.int32)
            ends[1:] = np.cumsum((n > 0) * BANDS)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
            rows = [batch.column(c).slice(i, j - i) for c in ("doc_id", "text_hash")]
            size = pa.array(np.diff(K.buffers(batch.column("text").slice(i, j - i))[1]))
            yield pa.RecordBatch.from_arrays([*rows, size, pa.array(n), pa.array(set_key(hashes, first)), bands], names=["doc_id", "text_hash", "bytes", "n_shingles", "node", "bands"])


def intersections(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of every set of a with every set of b, by an inverted index.

    Hashes in few sets are counted by their pairs, those in many by a matrix product over them, so common shingles
    cost no more memory than the result.
    """
    na, nb = len(a_first) - 1, len(b_first) - 1
    out = np.zeros(na * nb, np.float64)
    a_owner, b_owner = np.repeat(np.arange(na), np.diff(a_first)), np.repeat(np.arange(nb), np.diff(b_first))
    order = np.argsort(a, kind="stable")
    a, a_owner = a[order], a_owner[order]
    order = np.argsort(b, kind="stable")
    b, b_owner = b[order], b_owner[order]
    values, b_start, b_count = np.unique(b, return_index=True, return_counts=True)
    lo, hi = np.searchsorted(a, values, "left"), np.searchsorted(a, values, "right")
    a_count = hi - lo
    many = a_count * b_count > 64
    few = np.flatnonzero((a_count > 0) & ~many)
    if len(few):
        pairs = a_count[few] * b_count[few]
        which = np.repeat(np.arange(len(few)), pairs)
        k = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        wide = b_count[few][which]
        np.add.at(out, a_owner[lo[few][which] + k // wide] * nb + b_owner[b_start[few][which] + k % wide], 1.0)
    out = out.reshape(na, nb)
    dense = np.flatnonzero(many)
    for i in range(0, len(dense), 4096):
        part = dense[i : i + 4096]
        ma, mb = np.zeros((na, len(part)), np.float32), np.zeros((len(part), nb), np.float32)
        for m, owner, start, count in ((ma.T, a_owner, lo, a_count), (mb, b_owner, b_start, b_count)):
            row = np.repeat(np.arange(len(part)), count[part])
            k = np.arange(len(row)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            m[row, owner[start[part][row] + k]] = 1
        out += ma @ mb
    return out


def _compare(table: pa.Table) -> pa.Table:
    """Rows (side, node, label, text) of one task -> links (a, b) of a spanning forest: sets of side 0 with those of side 1, or of side 0 with each other where there is no side 1."""
    sides = []
    side_of = np.asarray(table.column("side"))
    for side in (0, 1):
        rows = table.filter(pa.array(side_of == side))
        nodes, labels = np.asarray(rows.column("node")), np.asarray(rows.column("label"))
        hashes, sizes, keys = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, _, h, first in K.shingle_sets(rows.column("text")) if len(nodes) else ():
            hashes.append(h)
            sizes.append(np.diff(first))
            keys.append(set_key(h, first))
        hashes, sizes, keys = (np.concatenate(x) for x in (hashes, sizes, keys))
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        right = np.flatnonzero(keys == nodes)  # another text under the same id is not this node's
        right = right[np.unique(nodes[right], return_index=True)[1]]
        parts = [hashes[first[i] : first[i + 1]] for i in right]
        sides.append((nodes[right], labels[right], sizes[right], np.concatenate(parts) if parts else np.zeros(0, U), np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes[right])))))
    (na, la, sa, ha, fa), (nb, lb, sb, hb, fb) = sides if len(sides[1][0]) else (sides[0], sides[0])
    both = intersections(ha, fa, hb, fb)
    linked = (100 * both >= PERCENT * (sa[:, None] + sb[None, :] - both)) & (la[:, None] != lb[None, :]) & (na[:, None] != nb[None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = find(int(la[i])), find(int(lb[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            links.append((int(na[i]), int(nb[j])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _links(needs: DataFrame, texts: DataFrame, tasks: str) -> DataFrame:
    """needs (tasks key, side, node, label) -> confirmed links (a, b)."""
    return needs.join(texts, "node").select(tasks, "side", "node", "label", "text").groupBy(tasks).applyInArrow(lambda t: _compare(t), "a long, b long")


def similar_sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """nodes (node, doc_id, text_hash, bytes, bands) of docs (doc_id, text) -> links (a, b) that connect what links of at least PERCENT connect.

    First every set meets the smallest node of each of its buckets, in linear work: that joins most of a group of
    copies. Then the buckets of three and more sets that still hold several components are compared as a whole, in
    tasks of bounded chunks, skipping pairs already connected: no bucket is capped and no link that would join two
    components is lost. Buckets of equal members are compared once, chunks of one component never.
    """
    exploded = nodes.select("node", "bytes", F.explode("bands").alias("bucket"))
    firsts = exploded.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "head")
    shared = save(exploded.join(firsts, "bucket").select("bucket", "head", "node", "bytes"), "buckets")
    stars = save(shared.where("node <> head").select("head", "node", "bytes").distinct(), "stars")
    members = shared.select("node").distinct().join(nodes.select("node", F.col("doc_id").alias("_id"), "text_hash"), "node")
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("text_hash"))
    texts = save(docs.join(members, same).select("node", "text"), "candidates")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("bytes") / CHUNK_BYTES), F.lit(1)).cast("long")
    chunks = stars.groupBy("head").agg(parts.alias("chunks"))
    dealt = stars.join(chunks, "head").select("head", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), "node")
    task = F.xxhash64("head", "chunk").alias("task")
    each = chunks.select("head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    needs = dealt.select(task, F.lit(1).alias("side"), "node", F.col("node").alias("label")).unionByName(each.select(task, F.lit(0).alias("side"), F.col("head").alias("node"), F.col("head").alias("label")))
    found = save(_links(needs, texts, "task"), "links")
    labels = connected_components(found)
    labelled = shared.select("bucket", "node", "bytes").join(labels, "node", "left").select("bucket", "node", "bytes", F.coalesce("root", "node").alias("label"))
    apart = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x")).where("lo <> hi and n > 2")
    groups = apart.groupBy("n", "x").agg(F.min("bucket").alias("bucket")).select("bucket")
    loose = save(labelled.join(groups, "bucket"), "loose")
    pieces = loose.groupBy("bucket", "label").agg(parts.alias("pieces"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    # small components share chunks; a large one has chunks of its own
    whole = pieces.where("pieces = 1").groupBy("bucket").agg(F.greatest(F.ceil(F.sum("n") / CHUNK), F.ceil(F.sum("b") / CHUNK_BYTES)).cast("long").alias("shared"))
    placed = loose.join(pieces.select("bucket", "label", "pieces"), ["bucket", "label"]).join(whole, "bucket", "left")
    own = F.when(F.col("pieces") > 1, F.xxhash64("label", F.pmod(F.xxhash64("node"), F.col("pieces")))).otherwise(F.pmod(F.xxhash64("label"), F.coalesce("shared", F.lit(1).cast("long"))))
    placed = save(placed.select("bucket", "node", "label", own.alias("chunk"), F.when(F.col("pieces") > 1, F.col("label")).alias("one")), "placed")
    blocks = placed.groupBy("bucket", "chunk").agg(F.max("one").alias("one"))
    x, y = (blocks.select("bucket", F.col("chunk").alias(c), F.col("one").alias(o)) for c, o in (("ca", "oa"), ("cb", "ob")))
    pairs = x.join(y, "bucket").where("ca <= cb and (oa is null or ob is null or oa <> ob)").select("bucket", "ca", "cb")
    task = F.xxhash64("bucket", "ca", "cb").alias("task")
    sides = pairs.select(task, "bucket", F.lit(0).alias("side"), F.col("ca").alias("chunk")).unionByName(pairs.where("ca < cb").select(task, "bucket", F.lit(1).alias("side"), F.col("cb").alias("chunk")))
    rest = _links(sides.join(placed, ["bucket", "chunk"]).select("task", "side", "node", "label"), texts, "task")
    return found.unionByName(save(rest, "links"))


def _graph(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of rows (doc_id, text); nodes (node, least, first, doc_id, text_hash, bytes, bands); labels (node, root) of linked nodes.

    first is the row (doc_id, text_hash) of a node that stands for it: the smallest doc_id, rows without one last.
    """
    sketched = save(rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketch, "doc_id long, text_hash long, bytes long, n_shingles long, node long, bands array<long>"), "sketches")
    one = F.max(F.struct("doc_id", "text_hash", "bytes", "bands"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash"))
    nodes = sketched.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), first.alias("first"), one.alias("one"))
    nodes = save(nodes.select("node", "least", "first", "one.*"), "nodes")
    return sketched, nodes, connected_components(similar_sets(nodes.select("node", "doc_id", "text_hash", "bytes", "bands"), rows))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id long, text).

    Sets are the distinct 5-word shingles of the text with A-Z lowered (all words as one below 5 words). Rows with
    equal sets are one node; nodes link at a Jaccard similarity of at least PERCENT / 100 on full sets, among the
    pairs that share a band of min-max hashes (a pair at the threshold shares none with probability (1 - 0.75^4)^32,
    5e-6, where sets are large; a permutation's ends are not independent in small ones, and the rate is 1.0e-4 for a
    union of 4 shingles, 2.0e-5 for 8, 8.6e-6 for 20). component_id is the smallest doc_id reachable. Null and blank texts have no shingles and stand alone; a row
    without doc_id is never a component's id, takes the id of its component if that has one, and is not kept unless it
    has none; repeated rows share a component. Other columns play no part; an empty table gives an empty table.
    """
    sketched, nodes, labels = _graph(docs.select("doc_id", "text"))
    least = labels.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    component = labels.join(least, "root").select("node", "component")
    of_node = nodes.select("node", "least").join(component, "node", "left").select("node", F.coalesce("component", "least").alias("component_id"))
    ends = sketched.join(of_node, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return ends.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the smallest doc_id (rows without one last), of its texts the smallest hash.

    Rows are told apart by doc_id and text, so rows without doc_id, or of one doc_id with several texts, go only as
    copies of their own component; of rows equal in both one stays. Blank and null texts are no copies of each other
    and stay.
    """
    _, nodes, labels = _graph(docs.select("doc_id", "text"))
    kept = nodes.join(labels, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    own = prefix_for(docs)
    kept = kept.select(F.col("first.doc_id").alias(f"{own}id"), F.col("first.text_hash").alias(f"{own}text"))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    same = F.col("doc_id").eqNullSafe(F.col(f"{own}id")) & (F.xxhash64("text") == F.col(f"{own}text"))
    first = docs.where(~blank).join(kept, same, "left_semi").withColumn(f"{own}text", F.xxhash64("text"))
    return first.dropDuplicates(["doc_id", f"{own}text"]).drop(f"{own}text").unionByName(docs.where(blank))
