"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range, and the few smallest of short texts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceloom.llm import kernels as K
from sliceloom.llm.store import total_bytes

U = np.uint64
#: The fraction 1 / SCALE of the hash range is kept, and at least the FLOOR smallest hashes.
SCALE, FLOOR = 8, 32
WIDTH = 5
#: UTF-8 bytes of a range of ids, and most ranges.
RANGE_BYTES, MOST_RANGES = 8 << 20, 1 << 16
TOP = 2**64 - 1


def sketches(texts: pa.Array, scale: int = SCALE, floor: int = FLOOR) -> list[np.ndarray]:
    """For each text the ascending hashes it keeps. Null and blank texts keep none."""
    limit, out = U(TOP // scale), []
    for i, j, hashes, first in K.shingle_sets(texts, width=WIDTH):
        ends = first[:-1] + np.maximum(_below(hashes, first, limit), np.minimum(floor, np.diff(first)))
        out += [hashes[first[k] : ends[k]].copy() for k in range(j - i)]
    return out


def _below(hashes: np.ndarray, first: np.ndarray, limit: np.uint64) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(hashes <= limit)))[first])


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> np.ndarray:
    """The sketch of the union of two texts' shingles, from their sketches alone."""
    both = np.union1d(a, b)
    return both[: max(int(np.searchsorted(both, U(TOP // scale), "right")), min(floor, len(both)))]


def complete_to(a: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> int:
    """The greatest hash up to which a sketch holds every hash of its text."""
    if len(a) < floor:
        return TOP
    return max(int(a[-1]), TOP // scale)


def compare(a: np.ndarray, b: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> tuple[float, float, float]:
    """(likeness, part of a in b, part of b in a), over the hashes that both sketches hold whole; two empty sketches are alike."""
    if not len(a) or not len(b):
        return (1.0, 1.0, 1.0) if len(a) == len(b) else (0.0, 0.0, 0.0)
    most = U(min(complete_to(a, scale, floor), complete_to(b, scale, floor)))
    a, b = a[: np.searchsorted(a, most, "right")], b[: np.searchsorted(b, most, "right")]
    if not len(a) or not len(b):
        return 0.0, 0.0, 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both), both / len(a), both / len(b)


def write(a: np.ndarray) -> str:
    """A sketch as text: base64 of its big-endian hashes."""
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(U)


def fingerprint(docs: DataFrame, scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """docs + fingerprint, in one pass without a shuffle. Null and blank texts have an empty one; a column of that name is replaced."""
    rest = docs.drop("fingerprint")
    at = rest.columns.index("text")
    plain = rest.toDF(*[f"_{i}" for i in range(len(rest.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([write(s) for s in sketches(batch.column(at), scale, floor)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=[*batch.schema.names, "fingerprint"])

    schema = T.StructType([*plain.schema.fields, T.StructField("fingerprint", T.StringType())])
    return plain.mapInArrow(run, schema).toDF(*rest.columns, "fingerprint")


def range_bounds(docs: DataFrame, ranges: int) -> np.ndarray:
    """The least ids of at most `ranges` ranges of near equal counts of distinct ids, ascending. One id a range reaches the driver."""
    spread = docs.select("doc_id").where("doc_id is not null").distinct().repartitionByRange(ranges, "doc_id")
    least = spread.groupBy(F.spark_partition_id().alias("range")).agg(F.min("doc_id").alias("least")).collect()
    return np.array(sorted(r["least"] for r in least), np.int64)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"


def edited_likeness(docs: DataFrame, scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """For every row of docs (doc_id long, text): its fingerprint, that of its edited text, and likeness to it and to the next document.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document's: the one of the next distinct doc_id (its smallest text if rows repeat the id), after the last the
    first. A null text counts as empty; a row without doc_id has no next document: nothing replaces its tail and
    near_next is 0. contained_* is the part of the row's sketch in the other's. Other columns play no part; an empty
    table gives an empty table.
    Texts are shuffled once, into ranges of ids; the first document of a range also goes to the end of the range
    before, so every row meets its successor in its own task, which reads its rows in order and holds one batch.
    """
    ranges = min(MOST_RANGES, max(16, -(-total_bytes(docs, "text") // RANGE_BYTES)))
    bounds = range_bounds(docs, ranges)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            part = np.where(there, np.searchsorted(bounds, ids, "right") - 1, np.arange(len(ids)) % max(1, len(bounds)))
            first = np.flatnonzero(there & (bounds[np.maximum(part, 0)] == ids)) if len(bounds) else np.zeros(0, np.int64)
            rows = np.concatenate((np.arange(len(ids)), first))
            turn = np.concatenate((np.where(there, 0, 2), np.where(part[first] == 0, 1, 0)))
            part = np.concatenate((part, np.where(part[first] == 0, len(bounds), part[first]) - 1))
            guard = np.arange(len(rows)) >= len(ids)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(turn, pa.int32()), pa.array(guard), *taken.columns], names=["part", "turn", "guard", "doc_id", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # rows of one id, until the next id's text is seen
        at = None
        for whole in batches:
            for start in range(0, len(whole), 1000):
                batch, ready = whole.slice(start, 1000), []
                columns = [batch.column(c).to_pylist() for c in ("part", "turn", "guard", "doc_id", "text")]
                for part, turn, guard, doc_id, text, own in zip(*columns, sketches(batch.column("text"), scale, floor), strict=True):
                    if (part, turn, doc_id) != at or turn == 2:
                        known = at is not None and at[0] == part and turn != 2 and at[1] != 2
                        ready += [(*row, text, own) if known else (*row, None, None) for row in waiting]
                        waiting, at = [], (part, turn, doc_id)
                    if not guard:
                        waiting.append((doc_id, text, own))
                if ready:
                    yield _digest(ready, scale, floor)
        if waiting:
            yield _digest([(*row, None, None) for row in waiting], scale, floor)

    dealt = texts.mapInArrow(deal, "part int, turn int, guard boolean, doc_id long, text string")
    return dealt.repartition(ranges, "part").sortWithinPartitions("part", "turn", "doc_id", "text").mapInArrow(digest, _OUT)


def _digest(rows: list[tuple], scale: int, floor: int) -> pa.RecordBatch:
    """rows: (doc_id, text, its sketch, next text, its sketch or None)."""
    edited = [text[: len(text) - len(text) // 4] + (following or "")[: len(text) // 4] for _, text, _, following, _ in rows]
    new = sketches(pa.array(edited, pa.string()), scale, floor)
    to_edited = [compare(row[2], b, scale, floor) for row, b in zip(rows, new, strict=True)]
    to_next = [compare(row[2], row[4], scale, floor) if row[4] is not None else (0.0, 0.0, 0.0) for row in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row[0] for row in rows], pa.int64()),
            pa.array([len(row[1]) for row in rows], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array([write(row[2]) for row in rows], pa.string()),
            pa.array(map(write, new), pa.string()),
            *[pa.array([x[k] for x in pairs], pa.float64()) for k in (0, 1) for pairs in (to_edited, to_next)],
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"],
    )
