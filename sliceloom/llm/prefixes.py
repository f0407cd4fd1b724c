"""Conversation prefix trie by rolling fingerprints, verified turn by turn.

A conversation's prefix of d turns has the fingerprint sum(t_i * B^i), i <= d, modulo 2^64, where t_i stands for turn i:
a numpy scan over blocks of rows sorted by conversation and depth gives all of them. Rows of one depth and
fingerprint are a candidate node. It is one node if all its rows have the turn and the parent of its representative,
the smallest conversation; since that holds at every depth above, the whole prefixes are then equal. Both checks
compare least and largest values, so they combine before the shuffle and no group meets in one task. Where a check fails, rows that differ
get different marks, the marks are scanned like turns, and the check is made again.

Subtree figures need no walk by depth: each node hands its value to its representative, whose path passes through all
its ancestors, so a scan from the last turn back and one sum a node roll everything up. Conversations of any length
are cut into blocks; texts are shuffled once, to tell different turns of one hash apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceloom.llm.kernels import mix
from sliceloom.llm.store import save

U = np.uint64
#: Turns of a conversation that meet in one task at most.
BLOCK = 4096
#: Bits of turn and prefix fingerprints.
BITS = 64
#: Code points by which turns of one number are told apart before their hash is.
TIE = 64
#: Bounds of the shared beginnings in rebuild(): conversations to one that gives its turns, and turns given, exclusive.
FAMILY, SHARED = 100, 6
_TURNS, _MARKS = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_KEY = ["depth", "fp", "mark"]


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base^e modulo 2^64 by squaring, for all exponents at once."""
    out, square, left = np.ones(len(exponents), U), U(base), exponents.astype(U)
    while left.any():
        out = np.where(left & U(1), out * square, out)
        left, square = left >> U(1), square * square
    return out


def _running(new: np.ndarray, values: np.ndarray, carry: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of the rows of values within segments, each beginning where new is; the first goes on from carry."""
    total = np.cumsum(values, axis=0, dtype=U)
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
    base = total[start] - values[start]
    base[start < 0] = U(0) - carry
    return total - base


def _longs(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1) if names else np.zeros((batch.num_rows, 0), np.int64)


def _scan_of(by: list[str], value: Callable[[pa.RecordBatch], np.ndarray], sums: list[str], before: list[str]) -> Callable:
    """A mapper over sorted rows: running sums of `value` within equal `by`, and (before) the same without the row's own."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, np.zeros(len(sums), U)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, values = _longs(batch, by), value(batch)
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            new[0] = last is None or (keys[0] != last).any()
            found = _running(new, values, carry)
            last, carry = keys[-1], found[-1]
            columns = [found[:, i] for i in range(len(sums))] + [found[:, i] - values[:, i] for i in range(len(before))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c.view(np.int64)) for c in map(np.ascontiguousarray, columns)]], names=[*batch.schema.names, *sums, *before])

    return scan


def _with(df: DataFrame, names: list[str]) -> str:
    return ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{c} long" for c in names])


def _scanned(rows: DataFrame, value: Callable[[pa.RecordBatch], np.ndarray], sums: list[str], before: list[str], block: int, back: bool = False) -> DataFrame:
    """rows (conv_id, depth, ...) with running sums of `value` along each conversation, from its start or (back) from its end.

    Blocks of a conversation are scanned apart; where there is more than one, their totals are scanned in turn, one row a full block.
    """
    at = F.col("depth").desc() if back else F.col("depth")
    dealt = rows.withColumn("_block", F.floor(F.col("depth") / block).cast("long")).repartition("conv_id", "_block").sortWithinPartitions("conv_id", "_block", at)
    found = save(dealt.mapInArrow(_scan_of(["conv_id", "_block"], value, sums, before), _with(dealt, sums + before)), "scan")
    if found.where("_block > 0").isEmpty():
        return found.drop("_block")
    edge, step = (F.lit(0), -1) if back else (F.lit(block - 1), 1)
    ends = found.where(F.pmod("depth", F.lit(block)) == edge).select("conv_id", (F.col("_block") + step).alias("_block"), *sums)
    ends = ends.repartition("conv_id").sortWithinPartitions("conv_id", F.col("_block").desc() if back else F.col("_block"))
    offsets = [f"_o{i}" for i in range(len(sums))]
    totals = ends.mapInArrow(_scan_of(["conv_id"], lambda b: _longs(b, sums).view(U), offsets, []), _with(ends, offsets)).select("conv_id", "_block", *offsets)
    joined = found.join(totals, ["conv_id", "_block"], "left").fillna(0, offsets)
    out = [f.name for f in found.schema.fields if f.name != "_block"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = _longs(batch, offsets).view(U)
            added = {c: pa.array((_longs(batch, [c]).view(U)[:, 0] + more[:, i]).view(np.int64)) for names in (sums, before) for i, c in enumerate(names)}
            yield pa.RecordBatch.from_arrays([added.get(c, batch.column(c)) for c in out], names=out)

    return save(joined.mapInArrow(add, found.select(*out).schema), "scan")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ones = _scan_of(["conv_id"], lambda b: np.ones((b.num_rows, 1), U), ["until"], ["at"])
    for batch in ones(batches):
        yield batch.select(["part", "conv_id", "h", "no", "chars", "at"])


def turn_table(conversations: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations (conv_id, turn, role, text): turns (conv_id, at from 0, h, no, chars), lengths (conv_id, n).

    Equal (h, no) mean equal role and text: where a hash of `bits` bits has several texts, no tells them apart. Null
    role and text count as empty. Turns are ordered by number (null first), those of one number by role and text, in
    their first TIE code points and then by hash, equal ones in any order. Rows without conv_id belong to no conversation and are left out.
    Rows are range-sorted, so a conversation of any length spreads over tasks; at most one row a task carries the count over.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    low = F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("h", F.xxhash64("role", "text").bitwiseAND(low))
    different = rows.select("h", "role", "text").distinct()
    clashing = different.groupBy("h").count().where("count > 1").select("h")
    no = F.lit(0).cast("long")
    if not clashing.isEmpty():
        number = (F.row_number().over(Window.partitionBy("h").orderBy("role", "text")) - 1).cast("long")
        rows = rows.join(save(different.join(clashing, "h", "left_semi").withColumn("no", number).where("no > 0"), "clashes"), ["h", "role", "text"], "left")
        no = F.coalesce("no", no)
    short = rows.select("conv_id", "turn", F.substring("role", 1, TIE).alias("r"), F.substring("text", 1, TIE).alias("t"), "h", no.alias("no"), F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), *map(F.col, ("r", "t", "h", "no", "row"))]
    dealt = short.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv_id", "h", "no", "chars")
    placed = save(dealt.mapInArrow(_number, "part int, conv_id long, h long, no long, chars long, at long"), "turns")
    pieces = save(placed.groupBy("conv_id", "part").agg((F.max("at") + 1).alias("n")), "pieces")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = pieces.select("conv_id", "part", before.alias("more")).where("more > 0")  # only the first conversation of a task
    turns = placed.join(F.broadcast(carried), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"), "h", "no", "chars")
    return turns, pieces.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuild(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of the conversations with shared beginnings: c begins with the first h turns of c - c % FAMILY (all, if those are fewer; none, if it is absent), then come its own after its first h; h = crc32(decimal c) % SHARED.

    Joins are by conversation and block of turns, or by the giving conversation, whose key has fewer than 2 * FAMILY * SHARED rows.
    """
    own = F.col("conv_id")
    each = lengths.select("conv_id", "n", F.pmod(F.crc32(own.cast("string").cast("binary")), F.lit(SHARED)).alias("cut"), (own - own % FAMILY).alias("giver"))
    givers = lengths.where(own % FAMILY == 0).select(own.alias("giver"), F.least("n", F.lit(SHARED - 1)).alias("has"))
    each = each.join(givers, "giver", "left").withColumn("given", F.least("cut", F.coalesce("has", F.lit(0))))
    each = save(each.select("conv_id", "cut", "giver", "given", "n", (F.col("given") + F.greatest(F.lit(0), F.col("n") - F.col("cut"))).alias("long")), "rebuilt")
    piece = F.floor(F.col("at") / block).cast("long").alias("_block")
    blocks = each.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block).cast("long"))))
    kept = turns.withColumn("_block", piece).join(blocks, ["conv_id", "_block"]).where("at >= cut").select("conv_id", (F.col("at") - F.col("cut") + F.col("given")).alias("at"), "h", "no", "chars", "long")
    heads = turns.where((own % FAMILY == 0) & (F.col("at") < SHARED - 1)).withColumnRenamed("conv_id", "giver")
    given = each.where("given > 0").join(heads, "giver").where("at < given").select("conv_id", "at", "h", "no", "chars", "long")
    return kept.unionByName(given).withColumnRenamed("long", "n"), each.select("conv_id", F.col("long").alias("n"))


def _terms(batch: pa.RecordBatch) -> np.ndarray:
    """What a row adds to its conversation's fingerprint and to its marks; the root adds nothing."""
    h, no, split, depth = (_longs(batch, [c])[:, 0] for c in ("h", "no", "split", "depth"))
    turn = mix(h.view(U) + no.view(U) * U(_MARKS)) * _powers(_TURNS, depth)
    marks = split.view(U) * _powers(_MARKS, depth)
    return np.stack([np.where(depth > 0, turn, U(0)), marks], axis=1)


def nodes_of(turns: DataFrame, lengths: DataFrame, bits: int = BITS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows (conv_id, depth, n, ...) with the key (depth, fp, mark) of their node; nodes with conv_id, the smallest member, their parent's fingerprint pfp and mark pmark, n_convs and chars."""
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", zero.alias("depth"), zero.alias("h"), zero.alias("no"), zero.alias("chars"), "n")
    rows = turns.select("conv_id", (F.col("at") + 1).alias("depth"), "h", "no", "chars", "n").unionByName(roots).withColumn("split", zero)
    low = F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long")
    plain = rows.columns
    same = ["pfp", "pmark", "h", "no"]
    while True:
        found = _scanned(rows, _terms, ["fp", "mark"], ["pfp", "pmark"], block).withColumn("fp", F.col("fp").bitwiseAND(low)).withColumn("pfp", F.col("pfp").bitwiseAND(low))
        ends = [f(c).alias(f"{n}_{c}") for c in same for n, f in (("lo", F.min), ("hi", F.max))]
        nodes = save(found.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), *ends), "nodes")
        mixed = nodes.where(" or ".join(f"lo_{c} <> hi_{c}" for c in same)).select(*_KEY)
        if mixed.isEmpty():
            return found, nodes.select(*_KEY, "conv_id", "n_convs", "chars", F.col("lo_pfp").alias("pfp"), F.col("lo_pmark").alias("pmark"))
        # one mark for each turn and parent of a candidate that holds several; the least keeps none
        kinds = found.join(mixed, _KEY, "left_semi").select(*_KEY, *same).distinct()
        number = (F.row_number().over(Window.partitionBy(*_KEY).orderBy(*same)) - 1).cast("long")
        marks = save(kinds.withColumn("_no", number).where("_no > 0"), "marks")
        split = F.when(F.col("_no").isNull(), F.col("split")).otherwise(F.xxhash64("split", "_no"))
        rows = found.join(marks, [*_KEY, *same], "left").withColumn("split", split).select(*plain)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> a row for each node of a batch, its ids joined by commas."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = _longs(batch, _KEY), batch.column("conv_id").to_pylist()
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
        texts = [",".join(map(str, ids[i:j])) for i, j in zip(starts, starts[1:])]
        yield pa.RecordBatch.from_arrays([*[pa.array(keys[starts[:-1], i]) for i in range(3)], pa.array([ids[i] for i in starts[:-1]], pa.int64()), pa.array(texts, pa.string())], names=[*_KEY, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces -> one digest a node; pieces go through the hash one after another and are not kept."""
    last, state = None, None

    def row(key: tuple, digest: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in key], pa.array([digest])], names=[*_KEY, "ends_sha256"])

    for batch in batches:
        done: list[tuple] = []
        for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*_KEY, "ids")], strict=True):
            if key == last:
                state.update(b",")
            else:
                if state is not None:
                    done.append((*last, state.hexdigest()))
                last, state = key, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([*[pa.array([d[i] for d in done], pa.int64()) for i in range(3)], pa.array([d[3] for d in done])], names=[*_KEY, "ends_sha256"])
    if state is not None:
        yield row(last, state.hexdigest())


def end_digests(rows: DataFrame) -> DataFrame:
    """(depth, fp, mark, ends_sha256): of the ids of the conversations that end at a node, ascending. Ids are joined range by range; only the joined pieces of a node meet, in order, in a running hash."""
    ends = rows.where("depth = n").select(*_KEY, "conv_id")
    order = [*_KEY, "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined_ids, "depth long, fp long, mark long, first long, ids string")
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digests, "depth long, fp long, mark long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """The prefix trie of turns (conv_id, at from 0, h, no, chars, n) and lengths (conv_id, n): a row for each node.

    conv_id: smallest conversation that begins with the node's turns; depth: how many; parent_conv_id: the parent's
    conv_id, null for the root; n_convs; n_children; n_leaves, childless nodes in its subtree; saved_tokens, summed over
    the subtree, (n_convs - 1) times the code points of a node's last text; ends_sha256, of the ids of the conversations that end there, ascending,
    joined by commas. The text of a node is that of turn depth - 1 of conversation conv_id. No conversation, no node;
    one without turns is a member of the root only.
    """
    rows, nodes = nodes_of(turns, lengths, bits, block)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pfp").alias("fp"), F.col("pmark").alias("mark")).agg(F.count(F.lit(1)).alias("n_children"))
    full = save(nodes.join(children, _KEY, "left").fillna(0, ["n_children"]), "nodes")
    parents = full.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("pfp"), F.col("mark").alias("pmark"), F.col("conv_id").alias("parent_conv_id"))
    linked = full.join(parents, ["depth", "pfp", "pmark"], "left")
    # each node's own figures travel along its representative's path: one row a node, joined by conversation and depth
    own = full.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("w"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    path = rows.select("conv_id", *_KEY).join(own, ["conv_id", "depth"], "left").fillna(0, ["w", "leaf"])
    below = _scanned(path, lambda b: _longs(b, ["w", "leaf"]).view(U), ["saved", "leaves"], [], block, back=True)
    rolled = below.groupBy(*_KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    out = linked.join(rolled, _KEY).join(end_digests(rows), _KEY, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """trie() of conversations (conv_id, turn, role, text) as they are; see turn_table() for order, nulls and ties. Other columns play no part."""
    turns, lengths = turn_table(conversations, bits)
    pieces = lengths.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block).cast("long"))))
    counted = turns.withColumn("_block", F.floor(F.col("at") / block).cast("long")).join(pieces, ["conv_id", "_block"]).drop("_block")
    return trie(counted, lengths, bits, block)


def rebuilt_trie(conversations: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """trie() of the conversations that rebuild() makes of these."""
    return trie(*rebuild(*turn_table(conversations, bits), block), bits, block)
