"""Best-fit packing with certified bin counts: partitions that miss their lower bound exchange documents and pack again."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sliceloom.llm.store import save

CAPACITY = 2048
_CUT = ["doc_id", "piece", "start", "length", "ids_crc32"]
#: Pieces of one packing task.
ITEMS = 4096
#: Most pieces of a task in later rounds, however far the table is from its bound: what one task holds.
MOST_ITEMS = 1 << 18
#: Share of its pieces that a round must close for another to follow, once tasks can grow no more.
LEAST_CLOSED = 1 / 16

#: Fixed value: the word pattern of the public byte-level vocabularies.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on which every Unicode version and both regular-expression engines agree.
_PLAIN = re.compile(r"[\t\n\r -~¡-¬®-ɏ–—‘-”•…€]*")


class Encoder:
    """Token ids of a tokenizers file. Byte-level vocabularies encode plain texts by a faster engine with the same ids; all other texts go through the tokenizer."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast, self.special = None, [t["content"] for t in spec.get("added_tokens", [])]
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model", {})
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        if plain and model.get("type") == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and not model.get("ignore_merges"):
            ranks = self._ranks(model["vocab"], model["merges"])
            if ranks:
                import tiktoken

                self.fast = tiktoken.Encoding("plain", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def _ranks(self, vocabulary: dict[str, int], merges: list) -> dict[bytes, int] | None:
        """Bytes -> id where merging by id is merging in the file's order, else None."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        out = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in self.special and all(c in byte_of for c in t)}
        ids = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in merges]
        ordered = all(a < b for a, b in zip(ids, ids[1:], strict=False))
        return out if ordered and all(bytes([b]) in out for b in range(256)) and sorted(out.values()) == list(range(len(out))) else None

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, place: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, and place): every text's ids and a final 0, cut into pieces of at most `capacity`; only a first piece may be shorter than that.

    A null text is empty: its one piece is the final 0. place names a long column that goes with every piece. Rows are
    read once and stay apart; nothing is shuffled.
    """
    more = ["place"] * (place is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.load(path)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                row, number, start, length, crc, kept = [], [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.array([*(encode(text) if text else ()), 0], "<u4")
                    first = (len(ids) - 1) % capacity + 1
                    for k, lo in enumerate([0, *range(first, len(ids), capacity)]):
                        hi = first + k * capacity
                        row.append(i)
                        number.append(k)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(ids[lo:hi].tobytes()))
                        if with_ids:
                            kept.append(ids[lo:hi].astype(np.int32))
                at_place = [part.column("place").take(pa.array(row, pa.int32()))] if more else []
                columns = [part.column("doc_id").take(pa.array(row, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []) + at_place, names=[*_CUT, *["ids"] * with_ids, *more])

    read = ["doc_id", "text", *[F.col(f"`{place}`").cast("long").alias("place") for _ in more]]
    return docs.select(*read).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", place long" * len(more))


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by two families of dual feasible functions over the histogram of lengths.

    Threshold t <= capacity / 2: over capacity - t counts a whole bin, under t nothing, the rest its share.
    Rounding k: floor((k + 1) x / capacity) / k, or x / capacity where (k + 1) x / capacity is whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(0, capacity // 2 + 1)
    low = np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    big = n[-1] - n[capacity - t]
    best = int(np.max(big * capacity + total[capacity - t] - low))
    bound = -(-best // capacity)
    for k in range(1, 101):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        value = int((count * np.where(whole, size * k, scaled // capacity * capacity)).sum())
        bound = max(bound, -(-value // (k * capacity)))
    return bound


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item by best-fit decreasing; one bit for each free length finds the fullest bin that fits."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        fits = mask >> x
        if fits:
            free = x + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, opened
            opened += 1
        bins[i], offsets[i] = b, capacity - free
        if free > x:
            by_free[free - x].append(b)
            mask |= 1 << (free - x)
    return bins, offsets


def _pack(table: pa.Table, capacity: int, number: int, last: bool) -> pa.Table:
    """Pack one task; `open` marks what goes on to the next round: the documents of bins with room where the bound is missed, and always those of the emptiest bin.

    task_bins and bound: the bins that the task's pieces took, and how few any packing of them needs.
    """
    table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
    lengths = table.column("length").to_numpy()
    bins, offsets = best_fit(lengths, capacity)
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    bound = lower_bound(lengths, capacity)
    loose = np.zeros(len(fill), bool)
    if not last:
        if len(fill) > bound:
            loose = fill < capacity
        if fill.min() < capacity:
            loose[int(fill.argmin())] = True
    task = number << 24 | table.column("part")[0].as_py()
    out = table.select([c for c in table.column_names if c in (*_CUT, "place")])
    columns = {"sequence_id": bins + (task << 32), "offset": offsets, "open": loose[bins], "task_bins": np.full(len(bins), len(fill)), "bound": np.full(len(bins), bound)}
    for name, values in columns.items():
        out = out.append_column(name, pa.array(values))
    return out


_PACKED = "sequence_id long, offset long, open boolean, task_bins long, bound long"


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (doc_id, piece, start, length, ids_crc32, perhaps place) + sequence_id, offset, certified, task_bins, bound: sequences of at most `capacity`, offsets gapless.

    Tasks of about ITEMS pieces pack by best-fit decreasing and compare with a lower bound. A task that meets it is
    certified and closed but for its emptiest bin; the others keep their full bins and send the rest on, dealt anew
    into tasks of twice as many. Rounds go on while more than one task is left and tasks can grow, or the last round closed a
    share of LEAST_CLOSED of what it was given, so their number is bounded by the logarithm of the pieces; the last closes all. Pieces are dealt by a
    hash, or, where they have a place, by ranges of it: then what is packed together stands together, and exchange is
    between neighbours. task_bins, bound: the bins of the task that closed the piece's sequence, and how few any packing of the
    task's pieces needs; certified: they are equal. Only lengths, ids and places move, never tokens.
    """
    placed = "place" in cut.columns
    left, done, number, before = cut, [], 0, None
    while True:
        n = left.count()
        items = min(MOST_ITEMS, ITEMS << number)
        parts = max(1, -(-n // items))
        last = parts == 1 or (items == MOST_ITEMS and before is not None and before - n < LEAST_CLOSED * before)
        if placed:
            dealt = left.repartitionByRange(parts, "place", "piece").withColumn("part", F.spark_partition_id())
        else:
            dealt = left.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(number)), F.lit(parts)).cast("int"))
        kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema.fields)
        packed = save(dealt.groupBy("part").applyInArrow(_packer(capacity, number, last), f"{kept}, {_PACKED}"), "packed")
        done.append(packed.where("not open").withColumn("certified", F.col("task_bins") <= F.col("bound")).drop("open"))
        if last:
            break
        left, number, before = packed.where("open").select(*cut.columns), number + 1, n
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def _packer(capacity: int, number: int, last: bool):
    def call(table):
        return _pack(table, capacity, number, last)

    return call


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, place: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified, task_bins, bound for every piece of docs (doc_id long, text).

    place: a long column with the rows' places in training, distinct. Sequences are then made of rows that stand near
    each other, and the result has place and sequence_place, the least place in a sequence, by which sequences are read.
    Repeated rows, null ids and null texts are documents like others (a null text has only the final 0); other columns
    play no part; an empty table gives an empty table. Without places the deal also hashes a row's position in the written piece table, so
    that many equal rows spread over the tasks.
    """
    out = assign(save(pieces(docs, path, capacity, place=place), "pieces"), capacity)
    if place is None:
        return out
    return out.withColumn("sequence_place", F.min("place").over(Window.partitionBy("sequence_id")))
