"""Exact substring dedup by fixed-block anchors.

Texts are dealt into buckets by a hash. Every text gives its non-overlapping blocks of half a window as anchors and
every rolling block as probe; a window of 2 b words holds at least one whole anchor of b words wherever it starts,
so two equal windows always meet at an anchor. Each bucket sends the distinct probes once, sorted and packed, so a
passage that a third of all documents share costs a bucket one entry. Windows around met anchors are candidates, each
distinct one sent once with the first place of its smallest document; every bucket learns the place of the smallest document
that has its window. Windows in a row whose places are in a row too are one hit: it is extended while both texts go on
alike, to a maximal exact repeat, and its words are compared with those at the other place, which travel once for each
bucket that needs them. Hashes only find hits. Where the words of one differ, all is done again under other hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceloom.llm import kernels as K
from sliceloom.llm.store import save, total_bytes

U = np.uint64
WINDOW = 50
#: UTF-8 bytes of a bucket: what one grouped call holds.
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 48
_LAST = np.iinfo(np.int64).max
_BLOBS = "part int, bucket int, probes binary, extra binary"


def _parts(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    """Ends of the equal hash ranges in a sorted array."""
    bounds = (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(U)
    return np.concatenate(([0], np.searchsorted(sorted_hashes, bounds), [len(sorted_hashes)])).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Byte planes: bytes of equal rank together, which the shuffle's codec packs well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pack(values: np.ndarray) -> bytes:
    """Sorted values as differences, in 4 bytes where they fit."""
    steps = np.diff(values, prepend=U(0))
    return b"4" + _planes(steps.astype(np.uint32)) if not len(steps) or int(steps.max()) < 2**32 else b"8" + _planes(steps)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data[1:], np.uint32 if data[:1] == b"4" else U).astype(U), dtype=U)


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A bucket's rows by id and text, and their ids: a row's number is the same in every reading, but among equal rows."""
    ids = table.column("doc_id").fill_null(_LAST).to_numpy()
    order = np.lexsort((table.column("text_hash").to_numpy(), ids))
    return table.take(pa.array(order)), ids[order]


class _Bucket:
    """The words of a bucket's texts and its distinct probes; equal for equal rows in any order."""

    def __init__(self, table: pa.Table, window: int, shift: int, seed: int = 0, bits: int = 64):
        self.window, self.block, self.shift = window, window // 2, U(shift)
        self.number = table.column("bucket")[0].as_py() if len(table) else 0
        table, self.ids = _ordered(table)
        self.data, self.offsets = K.buffers(table.column("text"))
        hashes, self.first = K.hashed_words(self.data, self.offsets, lower=False, seed=seed)
        if bits < 64:
            hashes = hashes & U((1 << bits) - 1)
        counts = np.diff(self.first)
        self.n = len(hashes)
        self.owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(self.n) - self.first[self.owner] if self.n else np.zeros(0, np.int64)
        long = counts[self.owner] >= window if self.n else np.zeros(0, bool)
        rolling = K.windows(hashes, self.block)
        self.at = np.flatnonzero(K.inside(self.first, self.block)[: len(rolling)] & long[: len(rolling)]) if len(rolling) else np.zeros(0, np.int64)
        probes, self.which, times = np.unique(rolling[self.at] >> self.shift, return_inverse=True, return_counts=True)
        self.probes = probes  # the upper bits: what chance adds is dropped with the full windows
        anchored = np.bincount(self.which[place[self.at] % self.block == 0], minlength=len(probes)) > 0
        self.anchored, self.again = anchored, anchored & (times > 1)
        self.hashes = hashes

    def probe_blobs(self, parts: int, bucket: int) -> pa.Table:
        ends = _parts(self.probes << self.shift, parts)
        spans = [(k, ends[k], ends[k + 1]) for k in range(parts) if ends[k] < ends[k + 1]]
        return _blobs(bucket, [(k, _pack(self.probes[i:j]), np.packbits(self.anchored[i:j]).tobytes()) for k, i, j in spans])

    def candidates(self, met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows that hold a met block, both hashes of the distinct ones, ascending, and which each start has."""
        full = K.windows(self.hashes, self.window)
        if not len(full):
            return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
        hit = np.zeros(self.n + 1, np.int64)
        hit[self.at[(met | self.again)[self.which]] + 1] = 1
        total = np.cumsum(hit)
        starts = np.flatnonzero(K.inside(self.first, self.window)[: len(full)])
        starts = starts[total[np.minimum(starts + self.window - self.block + 1, self.n)] > total[starts]]
        order, new = _grouped(one := full[starts], two := K.windows(self.hashes, self.window, second=True)[starts])
        which = np.empty(len(starts), np.int64)
        which[order] = np.cumsum(new) - 1
        return starts, one[order][new], two[order][new], which

    def places(self, starts: np.ndarray, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct window the smallest id here and where it first stands in that row: row << 32 | word. Rows are in order of their ids."""
        first = np.full(n, len(starts), np.int64)
        np.minimum.at(first, which, np.arange(len(starts)))
        at = starts[first]
        row = self.owner[at]
        return self.ids[row], row << 32 | (at - self.first[row])

    def bits(self, replies: pa.Table, hashes: np.ndarray, parts: int, shift: int) -> np.ndarray:
        ends, out = _parts(hashes << U(shift), parts), np.zeros(len(hashes), bool)
        for part, data in zip(replies.column("part").to_pylist(), replies.column("bits").to_pylist(), strict=True):
            i, j = ends[part], ends[part + 1]
            out[i:j] = np.unpackbits(np.frombuffer(data, np.uint8), count=j - i).astype(bool)
        return out

    def hits(self, blocks: pa.Table, windows: pa.Table, parts: int) -> pa.Table:
        """Maximal repeats of what a smaller document has: row and word here, how many windows, and bucket, row and word there."""
        starts, distinct, _, which = self.candidates(self.bits(blocks, self.probes, parts, int(self.shift)))
        least, place = self.places(starts, len(distinct), which)
        bucket = np.full(len(distinct), self.number, np.int64)
        ends, elsewhere = _parts(distinct, parts), np.zeros(len(distinct), bool)
        for part, data, there in zip(*(windows.column(c).to_pylist() for c in ("part", "bits", "places")), strict=True):
            i, j = ends[part], ends[part + 1]
            mine = i + np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), count=j - i))
            elsewhere[mine] = True
            half = len(there) // 3
            bucket[mine], place[mine] = _unplanes(there[:half], np.int32), _unplanes(there[half:], np.int64)
        gone = np.flatnonzero(elsewhere[which] | (self.ids[self.owner[starts]] > least[which]))
        at, of = starts[gone], which[gone]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (bucket[of][1:] != bucket[of][:-1]) | (place[of][1:] != place[of][:-1] + 1)
        first = np.flatnonzero(new)
        row = self.owner[at[first]]
        columns = {"bucket": np.full(len(first), self.number), "row": row, "word": at[first] - self.first[row], "n": np.diff(np.append(first, len(at))), "its_bucket": bucket[of][first], "its_row": place[of][first] >> 32, "its_word": place[of][first] & 0xFFFFFFFF}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in columns.items()})


def _grouped(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by both hashes, and where in it a new pair begins."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def _blobs(bucket: int, rows: list[tuple[int, bytes, bytes]]) -> pa.Table:
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "probes": pa.array([r[1] for r in rows], pa.binary()), "extra": pa.array([r[2] for r in rows], pa.binary())})


def _replies(part: int, buckets: list[int], bits: list[bytes], places: list[bytes] | None = None) -> pa.Table:
    kind = "block" if places is None else "window"
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "kind": pa.array([kind] * len(buckets), pa.string()), "part": pa.array([part] * len(buckets), pa.int32()), "bits": pa.array(bits, pa.binary()), "places": pa.array(places or [None] * len(buckets), pa.binary())})


_REPLY = "bucket int, kind string, part int, bits binary, places binary"


def _meet_blocks(table: pa.Table) -> pa.Table:
    """Blocks that an anchor of any bucket has and another bucket has too."""
    probes = [_unpack(x) for x in table.column("probes").to_pylist()]
    anchored = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("extra").to_pylist(), probes, strict=True)]
    everything = np.concatenate(probes)
    order = np.argsort(everything, kind="stable")
    value = everything[order]
    new = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    met = np.logical_or.reduceat(np.concatenate(anchored)[order], new) & (np.diff(np.append(new, len(value))) > 1)
    out = np.empty(len(value), bool)
    out[order] = np.repeat(met, np.diff(np.append(new, len(value))))
    ends = np.cumsum([0, *map(len, probes)])
    return _replies(table.column("part")[0].as_py(), table.column("bucket").to_pylist(), [np.packbits(out[i:j]).tobytes() for i, j in zip(ends, ends[1:])])


def _meet_windows(table: pa.Table) -> pa.Table:
    """Windows whose smallest document is in another bucket, and where it has them."""
    blobs, buckets = table.column("probes").to_pylist(), table.column("bucket").to_pylist()
    one, two = (np.concatenate([_unplanes(x[k * len(x) // 2 : (k + 1) * len(x) // 2], U) for x in blobs]) for k in (0, 1))
    extra = table.column("extra").to_pylist()
    ids, places = ([_unplanes(x[k * len(x) // 2 : (k + 1) * len(x) // 2], np.int64) for x in extra] for k in (0, 1))
    bucket = np.repeat(np.array(buckets, np.int32), [len(x) for x in ids])
    least, place = np.concatenate(ids), np.concatenate(places)
    order = np.lexsort((bucket, least, two, one))
    a, b = one[order], two[order]
    begins = np.ones(len(order), bool)
    begins[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    smallest = np.empty(len(order), np.int64)  # the entry of the smallest document that has the same window
    smallest[order] = order[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
    out = least[smallest] < least
    ends = np.cumsum([0, *map(len, ids)])
    there = []
    for i, j in zip(ends, ends[1:]):
        mine = smallest[i:j][out[i:j]]
        there.append(_planes(bucket[mine]) + _planes(place[mine]))
    return _replies(table.column("part")[0].as_py(), buckets, [np.packbits(out[i:j]).tobytes() for i, j in zip(ends, ends[1:])], there)


_HIT = "bucket long, row long, word long, n long, its_bucket long, its_row long, its_word long"
_THERE = ["its_bucket", "its_row", "its_word", "n"]
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, unlike long"


def _words(table: pa.Table, row: int) -> list[bytes]:
    text = table.column("text")[row]
    return bytes(text.as_buffer()).split() if text.is_valid else []


def _passages(window: int):
    """The words that hits of other buckets refer to, one row for each distinct place and length."""

    def call(table: pa.Table, asked: pa.Table) -> pa.Table:
        table, _ = _ordered(table)
        asked = asked.sort_by("its_row")
        row, words, found = None, [], []
        for at, first, n in zip(*(asked.column(c).to_pylist() for c in _THERE[1:]), strict=True):
            if at != row:
                row, words = at, _words(table, at)
            found.append(b" ".join(words[first : first + n + window - 1]))
        return pa.table([*[asked.column(c) for c in _THERE], pa.array(found, pa.binary())], names=[*_THERE, "passage"])

    return call


def _kept(window: int, with_text: bool):
    """Every text without the words of its hits; unlike counts the hits whose words are not those of the other place."""

    def call(table: pa.Table, hits: pa.Table) -> pa.Table:
        table, _ = _ordered(table)
        by_row: dict[int, list[tuple[int, int, bytes]]] = {}
        for row, first, n, passage in zip(*(hits.column(c).to_pylist() for c in ("row", "word", "n", "passage")), strict=True):
            by_row.setdefault(row, []).append((first, n, passage))
        out: list[list] = [[], [], [], [], []]
        for row in range(len(table)):
            words, unlike = _words(table, row), 0
            total, left = len(words), words
            if row in by_row:
                gone = np.zeros(total, bool)
                for first, n, passage in by_row[row]:
                    unlike += b" ".join(words[first : first + n + window - 1]) != passage
                    gone[first : first + n + window - 1] = True
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            text = b" ".join(left)
            for column, value in zip(out, (total, total - len(left), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None, unlike), strict=True):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.table([table.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "unlike"])

    return call


def _attempt(docs: DataFrame, window: int, with_text: bool, seed: int, bits: int) -> DataFrame:
    """The result under one choice of hashes, written; unlike is not 0 where hashes took different words for equal."""
    whole = total_bytes(docs, "text")
    buckets = max(LEAST_BUCKETS, -(-whole // BUCKET_BYTES))
    parts = buckets
    shift = 64 - min(64, max(40, whole.bit_length() + 10))  # so many bits that probes of a table of any size seldom meet by chance
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket")
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), spread).repartition(buckets, "bucket")

    def blocks_of(table: pa.Table) -> pa.Table:
        return (bucket := _Bucket(table, window, shift, seed, bits)).probe_blobs(parts, bucket.number)

    def windows_of(table: pa.Table, replies: pa.Table) -> pa.Table:
        bucket = _Bucket(table, window, shift, seed, bits)
        starts, distinct, second, which = bucket.candidates(bucket.bits(replies, bucket.probes, parts, shift))
        least, place = bucket.places(starts, len(distinct), which)
        ends = _parts(distinct, parts)
        spans = [(k, ends[k], ends[k + 1]) for k in range(parts) if ends[k] < ends[k + 1]]
        return _blobs(bucket.number, [(k, _planes(distinct[i:j]) + _planes(second[i:j]), _planes(least[i:j]) + _planes(place[i:j])) for k, i, j in spans])

    def hits_of(table: pa.Table, replies: pa.Table) -> pa.Table:
        kind = np.asarray(replies.column("kind").to_pylist(), object)
        of = lambda k: replies.filter(pa.array(kind == k, pa.bool_()))
        return _Bucket(table, window, shift, seed, bits).hits(of("block"), of("window"), parts)

    block_replies = dealt.groupBy("bucket").applyInArrow(blocks_of, _BLOBS).repartition(parts, "part").groupBy("part").applyInArrow(_as_udf(_meet_blocks), _REPLY)
    window_blobs = dealt.groupBy("bucket").cogroup(block_replies.groupBy("bucket")).applyInArrow(windows_of, _BLOBS)
    window_replies = window_blobs.repartition(parts, "part").groupBy("part").applyInArrow(_as_udf(_meet_windows), _REPLY)
    replies = block_replies.unionByName(window_replies)
    hits = save(dealt.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(hits_of, _HIT), "hits")
    asked = hits.select(*_THERE).distinct().withColumn("bucket", F.col("its_bucket").cast("int"))
    passages = dealt.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_passages(window), ", ".join(f"{c} long" for c in _THERE) + ", passage binary")
    answered = hits.join(passages, _THERE).select(F.col("bucket").cast("int").alias("bucket"), "row", "word", "n", "passage")
    return save(dealt.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(_kept(window, with_text), _RESULT), "repeats")


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept, the words left joined by spaces, for every row of docs (doc_id long, text).

    A word goes if a window of `window` words that covers it also starts in a row with a smaller doc_id; windows are
    judged on the input. window must be even. Null and blank texts have no words; rows without doc_id come after all
    others and take nothing from each other, nor do rows of one doc_id; other columns play no part; an empty table gives
    an empty table. Rows are dealt by id and text, so rows without id, or of one id, spread over the buckets; a text of any
    length stands in one bucket. Texts are shuffled once by bucket. Every hit is confirmed on its words; should hashes
    have taken different words for equal (bits: those of a word's hash at first), the whole is done again under others.
    """
    seed = 0
    while True:
        found = _attempt(docs, window, with_text, seed, bits if seed == 0 else 64)
        if found.where("unlike > 0").isEmpty():
            return found.drop("unlike")
        seed += 1


def _as_udf(f):
    """The engine looks at a function's parameters and annotations; give it a plain one."""

    def call(table):
        return f(table)

    return call
