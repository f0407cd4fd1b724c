"""Benchmark decontamination by word windows. Native: regular expressions, array functions, joins and aggregates only.

The distinct windows of the benchmark are a hash set that every task gets; the token windows of each text are made,
hashed and looked up where the text is read, so neither texts nor windows are shuffled. A hit counts when its words
are equal, not its hash alone. The set is sent in slices of a checked size, one reading of the texts each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceloom.llm.store import prefix_for, save

#: Words of a window.
WIDTH = 10
#: Bytes of windows that are sent to every task at once; a larger set goes in slices.
BROADCAST_BYTES = 64 << 20
#: Bytes of a window beside its words, in a hash table.
ROW_BYTES = 64
#: Pairs of window and item that may be sent to every task.
BROADCAST_PAIRS = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but ASCII signs, in lowered texts and in texts as they are.
LOWERED, WRITTEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text with A-Z lowered; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(LOWERED), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(windows, owners), both written: windows (window, key, n, words joined by spaces), one row for each distinct window; owners (window, item_id), distinct.

    An item of fewer than `width` words, but not none, is one window.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    each = items.select("item_id", n.alias("n"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at")).select("item_id", "n", F.slice("w", F.col("at"), F.col("n")).alias("w"))
    pairs = save(each.select("item_id", "n", F.xxhash64("w").alias("key"), F.array_join("w", " ").alias("words")).distinct(), "benchmark")
    windows = save(pairs.select("key", "n", "words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    owners = save(pairs.join(windows, ["key", "n", "words"]).select("window", "item_id"), "owners")
    return windows, owners


def _met(rows: DataFrame, windows: DataFrame, lengths: list[int], width: int) -> DataFrame:
    """rows (_row, doc_id, _text, w) -> (_row, doc_id, _text, n_words, code, window): a row with code -1 for each text, and one for each hit.

    A code is (first word) * (width + 1) + (words). Every text meets one entry of the hash set without words, so one
    pass and one inner join give hits and texts without any.
    """
    base, size = F.lit(width + 1), F.size("w")
    starts = [F.when(size >= m, F.sequence(F.lit(m).cast("long"), (size - m).cast("long") * base + m, base.cast("long"))).otherwise(F.array().cast("array<long>")) for m in lengths]
    codes = rows.select("_row", "doc_id", "_text", "w", F.explode(F.concat(F.array(F.lit(-1).cast("long")), *starts)).alias("code"))
    at, n = (F.floor(F.col("code") / base) + 1).cast("int"), F.pmod("code", base).cast("int")
    text = F.col("code") < 0
    mine = F.slice("w", F.greatest(F.lit(1), at), n)
    looked = codes.withColumn("look", F.when(text, F.lit(0).cast("long")).otherwise(F.xxhash64(mine)))
    spark = rows.sparkSession
    entries = windows.select("key", "window", "words").unionByName(spark.range(1).select(F.lit(0).cast("long").alias("key"), F.lit(None).cast("long").alias("window"), F.lit(None).cast("string").alias("words")))
    same = (text & F.col("words").isNull()) | (~text & (F.array_join(mine, " ") == F.col("words")))
    return looked.join(F.broadcast(entries), (F.col("look") == F.col("key")) & same).select("_row", "doc_id", "_text", F.size("w").alias("n_words"), "code", "window")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame, list[int]]:
    """(rows, owners, lengths): for every row of docs its number _row, doc_id, _text (a hash of the text), n_words, codes of its hits and the windows met."""
    windows, owners = benchmark_windows(benchmark, width)
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most `width` of them
    weight = windows.agg(F.sum(F.octet_length("words") + ROW_BYTES).alias("b")).first()["b"] or 0
    slices = max(1, -(-weight // broadcast_bytes))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col("text").alias("_whole"))
    if slices > 1:
        rows = save(rows, "numbered")  # every reading must number the rows alike
    rows = rows.select("_row", "doc_id", F.xxhash64("_whole").alias("_text"), words(F.col("_whole")).alias("w"))
    met = None
    for k in range(slices):
        part = windows if slices == 1 else windows.where(F.pmod(F.hash("key"), F.lit(slices)) == k)
        found = _met(rows, part, lengths, width)
        met = found if met is None else met.unionByName(found.where("code >= 0"))
    real = F.col("code") >= 0
    grouped = met.groupBy("_row").agg(
        F.max(F.when(~real, F.col("doc_id"))).alias("doc_id"),
        F.max(F.when(~real, F.col("_text"))).alias("_text"),
        F.max(F.when(~real, F.col("n_words"))).cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.when(real, F.col("code")))).alias("codes"),
        F.collect_set("window").alias("windows"),
    )
    return save(grouped, "hits"), owners, lengths


def _covered(lengths: list[int], width: int) -> Column:
    """Places of the words inside the hits, ascending and distinct, from sorted codes; each length is walked once, so the work is linear."""
    base, parts = width + 1, []
    for m in lengths:
        at = F.transform(F.filter("codes", lambda c: F.pmod(c, F.lit(base)) == m), lambda c: F.floor(c / base).cast("int"))

        def walk(at: Column, m: int = m) -> Column:
            last = lambda x, i: F.least(x + (m - 1), F.coalesce(F.get(at, i + 1) - 1, x + (m - 1)))
            return F.flatten(F.transform(at, lambda x, i: F.sequence(x, last(x, i))))

        parts.append(walk(at))
    if not parts:
        return F.array().cast("array<int>")
    return parts[0] if len(parts) == 1 else F.sort_array(F.array_distinct(F.concat(*parts)))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, _text, n_words, n_hit, covered, items for every row of docs (doc_id, text); benchmark has (item_id, text).

    Words are runs of anything but ASCII signs, blanks and controls, with A-Z lowered. A window is `width` consecutive
    words of an item, or all words of a shorter one; a word of a text is hit if it lies in an occurrence of a window.
    covered: places of the hit words, ascending, from 0; items: distinct item_ids with a window in the text, sorted as
    strings. Null texts and items have no words; an item without id marks words and counts as one item, null, at the
    end of items. Equal rows are rows like others, equal items and items of one id count once; other columns play no
    part. An empty docs gives an empty table, an empty benchmark hits nothing.
    """
    found, owners, lengths = hits(docs, benchmark, width, broadcast_bytes)
    if owners.count() <= BROADCAST_PAIRS:
        owners = F.broadcast(owners)
    met = found.select("_row", F.explode("windows").alias("window")).join(owners, "window").select("_row", "item_id").distinct()
    name = F.col("item_id").cast("string")
    of = met.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(name.isNull().alias("last"), name.alias("id")))).alias("items")).select("_row", F.transform("items", lambda x: x["id"]).alias("items"))
    out = found.select("_row", "doc_id", "_text", "n_words", _covered(lengths, width).alias("covered")).join(of, "_row", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "_text", "n_words", F.size("covered").cast("long").alias("n_hit"), "covered", F.coalesce("items", none).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (the ids joined by commas, one without id left out), contaminated: the digest of contamination()."""
    found = contamination(docs, benchmark, width)
    digest = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _cut(text: Column, covered: Column) -> Column:
    """text without the words at `covered` and what stands between them; what stands on both sides of a cut stays."""
    pairs = F.arrays_zip(F.split(text, WRITTEN, -1).alias("g"), F.regexp_extract_all(text, F.lit(WRITTEN), F.lit(0)).alias("w"))
    tokens = F.flatten(F.transform(pairs, lambda x: F.array(x["g"], F.coalesce(x["w"], F.lit("")))))  # gap, word, gap, ..., gap, ""
    begins = F.filter(covered, lambda x, i: ~F.coalesce(F.get(covered, i - 1) == x - 1, F.lit(False)))
    ends = F.filter(covered, lambda x, i: ~F.coalesce(F.get(covered, i + 1) == x + 1, F.lit(False)))
    kept = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1)).alias("a"), F.concat(begins, F.array(F.lit(None).cast("int"))).alias("b"))
    piece = lambda t, x: F.array_join(F.slice(t, 2 * x["a"] + 1, 2 * (F.coalesce(x["b"], F.floor(F.size(t) / 2).cast("int") - 1) - x["a"]) + 1), "")
    return F.array_join(F.transform(kept, lambda x: piece(tokens, x)), "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, whole: bool = False, width: int = WIDTH) -> DataFrame:
    """docs, with its columns, without what it shares with the benchmark: hit spans are cut, or with `whole` documents with a hit go.

    Only contaminated rows are joined back, by id and a hash of the text; clean rows keep their text to the last code
    point, null texts stay null. Other columns may have any name; equal rows are treated alike.
    """
    own = prefix_for(docs)
    bad = contamination(docs, benchmark, width).where("n_hit > 0").dropDuplicates(["doc_id", "_text"])
    bad = bad.select(F.col("doc_id").alias(f"{own}id"), F.col("_text").alias(f"{own}hash"), F.col("covered").alias(f"{own}covered"))
    same = F.col("doc_id").eqNullSafe(F.col(f"{own}id")) & (F.xxhash64("text") == F.col(f"{own}hash"))
    if whole:
        return docs.join(bad, same, "left_anti")
    joined = docs.join(bad, same, "left")
    text, covered = F.col("text"), F.col(f"{own}covered")
    return joined.select(*[F.when(covered.isNull(), text).otherwise(_cut(text, covered)).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
