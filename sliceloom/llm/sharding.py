"""K-d tree sharding: recursive splits at distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sliceloom.llm.ranks import hashed_order, name_ranks, running
from sliceloom.llm.store import save

#: Equal bins of a node's range in each pass of the median search.
BINS = 1024


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus 1; a null text has none."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + 1


#: Nodes of a tree whose table, some tens of bytes a row, is sent to every task; more meet the items by a shuffle.
BROADCAST_NODES = 1 << 17


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row for each node of the tree."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_NODES else table


def _median_cuts(items: DataFrame, nodes: dict[int, tuple[int, int, float]], slack: float) -> dict[int, int]:
    """nodes: node -> (least key, greatest key, share of the weight for the left) -> node -> cut; keys below it go left.

    Histogram refinement over all nodes at once: a pass reads the item table once and finds on the cluster the bin that
    holds each node's median, so one row a node returns, and the next looks only into that bin. A node is done when the
    bin is one key or weighs no more than `slack` of it.
    """
    spark, cuts = items.sparkSession, {}
    search = {k: (lo, hi + 1, 0, None) for k, (lo, hi, _) in nodes.items()}
    while search:
        steps = {k: -(-(hi - lo) // BINS) for k, (lo, hi, _, _) in search.items()}
        rows = [(k, Decimal(lo), Decimal(hi), Decimal(steps[k]), below, None if goal is None else float(goal), float(nodes[k][2])) for k, (lo, hi, below, goal) in search.items()]
        table = _table(spark, rows, "node long, lo decimal(38,0), hi decimal(38,0), step decimal(38,0), below long, goal double, share double")
        inside = items.join(table, "node").where("key >= lo and key < hi")
        bins = inside.groupBy("node", F.expr("cast((key - lo) div step as long)").alias("bin")).agg(F.sum("weight").alias("w"), F.first("below").alias("below"), F.first("goal").alias("goal"), F.first("share").alias("share"))
        node = Window.partitionBy("node")
        upto = bins.withColumns({"upto": F.col("below") + F.sum("w").over(node.orderBy("bin")), "goal": F.coalesce("goal", F.col("share") * F.sum("w").over(node))})
        first = F.struct((F.col("upto") < F.col("goal")).alias("short"), F.when(F.col("upto") >= F.col("goal"), F.col("bin")).otherwise(-F.col("bin")).alias("at"))  # the first that reaches the goal, or the last
        for r in upto.groupBy("node").agg(F.min_by(F.struct("bin", "w", "upto", "goal"), first).alias("b")).collect():
            k, (b, w, reached, goal) = r["node"], r["b"]
            below, start = reached - w, search[k][0] + b * steps[k]
            if steps[k] == 1 or w <= slack * goal:
                cuts[k] = start if goal - below <= reached - goal else start + steps[k]
                del search[k]
            else:
                search[k] = (start, start + steps[k], below, goal)
    return cuts


def kd_leaves(items: DataFrame, dimensions: Sequence[str], leaves: int, slack: float = 1e-4) -> DataFrame:
    """Add `leaf` in 0..leaves-1; leaf weights near equal.

    items: long columns `dimensions` of at least 0, a long `weight`, and a long `tie` under 2^40 that tells items of
    equal value apart; no nulls. A node is cut along the dimension whose range, over the whole table's range, is
    widest in it. Only one row a node reaches the driver in a pass.
    """
    spark = items.sparkSession
    bounds = [f(d).alias(f"{n}{i}") for i, d in enumerate(dimensions) for n, f in (("lo", F.min), ("hi", F.max))]
    keys = [f"cast(`{d}` as decimal(38,0)) * {1 << 40}BD + tie" for d in dimensions]
    items = items.withColumn("node", F.lit(0).cast("long"))
    parts, whole = {0: (0, leaves)}, None
    while split := {k: v for k, v in parts.items() if v[1] - v[0] > 1}:
        ranges = {r["node"]: r for r in items.groupBy("node").agg(*bounds).collect()}
        whole = whole or {i: max(1, r[f"hi{i}"] - r[f"lo{i}"]) for r in ranges.values() for i in range(len(dimensions))}
        chosen, nodes = {}, {}
        for k in split.keys() & ranges.keys():
            r, (lo, hi) = ranges[k], split[k]
            i = chosen[k] = max(range(len(dimensions)), key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / whole[i], -i))
            nodes[k] = (r[f"lo{i}"] << 40, (r[f"hi{i}"] + 1 << 40) - 1, (hi - lo) // 2 / (hi - lo))
        if not nodes:
            break
        dims = _table(spark, list(chosen.items()), "node long, dim long")
        key = F.expr("case dim " + " ".join(f"when {i} then cast({e} as decimal(38,0))" for i, e in enumerate(keys)) + " end")
        keyed = items.join(dims, "node", "left").withColumn("key", key).drop("dim")
        cuts, sides = _median_cuts(keyed, nodes, slack), []
        for k in nodes:
            (lo, hi), n = parts.pop(k), max(parts, default=k) + k + 1
            parts[n], parts[n + 1] = (lo, lo + (hi - lo) // 2), (lo + (hi - lo) // 2, hi)
            sides.append((k, Decimal(cuts[k]), n, n + 1))
        parts = {k: v for k, v in parts.items() if k not in split or k in nodes}
        moved = keyed.join(_table(spark, sides, "node long, cut decimal(38,0), l long, r long"), "node", "left")
        node = F.expr("case when cut is null then node when key < cut then l else r end")
        items = save(moved.withColumn("node", node).drop("key", "cut", "l", "r"), "kd")
    return items.join(_table(spark, [(k, lo) for k, (lo, _) in parts.items()], "node long, leaf long"), "node").drop("node")


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, tolerance: float = 0.002) -> DataFrame:
    """Columns doc_id, size, text_crc32, shard, slot; shards near equal in bytes.

    Give the number of shards or the target bytes of one. Rows with equal texts are one item with the metadata
    (source, language, by the rank of the whole name) of their smallest row, so they share a shard; a group over `tolerance` of a shard is dealt
    into pieces by a hash of its ids first, which keeps hot groups from unbalancing a shard. Null texts count 1
    byte and form a group of their own; null metadata sorts first; repeated rows are rows like others; an empty
    table gives an empty table. No row takes part in a sort of a whole shard: slots come from bucket totals.
    """
    crc = F.coalesce(F.crc32(F.encode(F.col("text"), "UTF-8")), F.lit(0)).cast("long")
    rows = save(docs.select("doc_id", size_of(F.col("text")).alias("size"), crc.alias("text_crc32"), F.xxhash64("text", F.octet_length("text")).alias("_group"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("_chars"), F.col("source").cast("string").alias("_source"), F.col("lang").cast("string").alias("_lang")), "rows")
    n, whole = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    leaves = shards or max(1, -(-whole // (target_bytes or 1 << 30)))
    most = max(1.0, tolerance * whole / leaves)

    # only groups above the bound are dealt into pieces; groups are pre-aggregated, so a hot one is a row here
    heavy = rows.groupBy("_group").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).where((F.col("w") > most) & (F.col("n") > 1))
    heavy = heavy.select("_group", F.least(F.col("n"), F.ceil(F.col("w") / F.lit(most))).cast("long").alias("_pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("_pieces")), F.lit(0).cast("long"))
    dealt = save(rows.join(heavy, "_group", "left").withColumn("_piece", piece).drop("_pieces"), "pieces")
    items = dealt.groupBy("_group", "_piece").agg(F.sum("size").alias("weight"), F.min("_chars").alias("chars"), F.min(F.struct("doc_id", "_source", "_lang")).alias("m"))
    items = items.withColumns({"_source": F.col("m._source"), "_lang": F.col("m._lang")})
    for c in ("source", "lang"):
        items = items.join(name_ranks(dealt, f"_{c}").select(F.col("name").alias(f"_name_{c}"), F.col("rank").alias(c)), F.col(f"_{c}").eqNullSafe(F.col(f"_name_{c}")))
    items = items.select("_group", "_piece", "weight", "chars", "source", "lang", F.shiftrightunsigned(F.xxhash64("_group", "_piece"), 24).alias("tie"))
    leaf = kd_leaves(items, ["source", "lang", "chars"], leaves).select("_group", "_piece", F.col("leaf").cast("int").alias("shard"))
    dealt = dealt.join(leaf, ["_group", "_piece"]).select("doc_id", "size", "text_crc32", "shard")
    return running(dealt, ["shard"], hashed_order(F.col("doc_id"), F.col("text_crc32")), [F.col("doc_id"), F.col("text_crc32")], F.lit(1).cast("long"), n, "slot")
