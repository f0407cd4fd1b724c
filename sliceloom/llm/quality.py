"""Quality classifier from weak labels: overlapping heuristics, their accuracies by expectation-maximisation, and a hashed linear scorer.

Two questions are asked of a text, each with labellers of its own: is it prose (and not markup debris, tables,
shouting or stutter), and is it free of abuse. A labeller votes bad or keeps silent; as there are many ways to be bad,
silence tells only where all of them keep it. For abuse the labellers are lists of insults that share no word, and a
lexicon of word beginnings learned from annotated texts: insults are an open class, differ by language and are
inflected, so no list holds them. The lexicon is cross-fitted: a text is judged by what the other half of the annotated
sample taught, so its accuracy is estimated on texts that it has not seen. Annotations of some texts, where there are
any, are one labeller more, whose accuracy is estimated like the others' and whose silence tells nothing. Votes are
counted over the whole corpus as patterns, so what the driver fits on is bounded; posteriors of a bounded sample train
the scorer, which then decides on every text. The sample never comes to the driver: a task fits on it and sends the result.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceloom.llm import kernels as K
from sliceloom.llm.store import save, total_bytes

#: Insults by what they call somebody, in lists that share no word, and frequent function words of four languages.
INSULTS = (
    ("idiot", "moron", "stupid", "imbecile", "dumb", "fool", "clown"),
    ("trash", "scum", "garbage", "vermin", "filth", "loser", "bastard"),
    ("worthless", "pathetic", "disgusting", "useless", "hateful"),
)
COMMON = "a an and are as at be by for from he her his i in is it of on or that the this to was were with you " "der die das und ist nicht ein eine zu den dem von mit auf für im es ich sie er sich des " "le la les de et un une des du en est que qui dans pour pas sur au par ce " "el los las y que en un una por con se su para del al es lo como"
#: Bound of the sample that trains the scorer and the lexicon, in documents, by expectation; the sample is fixed by a hash of the id.
SAMPLE = 6000
#: Bound of the UTF-8 bytes of its texts, by expectation: where the texts are longer, the sample is thinned evenly.
SAMPLE_BYTES = 64 << 20
#: Code points of a word's beginnings that are features beside the word.
STEMS = (3, 4, 5, 6)
#: UTF-8 bytes and texts of a block that Python looks at in one go.
BLOCK_BYTES, BLOCK_TEXTS = 1 << 18, 1024
#: Words of ordinary text that every share is smoothed by: few words move a share little.
SMOOTH = 8
#: How many times as often the lexicon's beginnings must stand in bad texts, and texts that a feature must stand in to weigh.
TELLING, LEAST_DF = 50, 5
#: Shares of a text's words that make features of their own where a word or beginning stands twice at least.
DENSE = (1 / 400, 1 / 100, 1 / 30)
SILENT, BAD, GOOD = 0, 1, 2

_CLASSES = np.full(256, 9, np.uint16)  # other signs
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58], _CLASSES[128:] = 0, 1, 2, 3
for _c, _k in ((0x20, 4), (0x0A, 5), (0x2E, 6), (0x2C, 7), (0x7C, 8)):
    _CLASSES[_c] = _k
#: Triples of byte classes, and the numbers the prose heuristics look at.
TRIPLES, MEASURES = 1000, 7
SHAPES = TRIPLES + MEASURES
#: Heuristics of each question; the lexicon is the last one on abuse.
PROSE, ABUSE = 7, len(INSULTS) + 1


def _word_hash(words) -> np.ndarray:
    data, offsets = K.buffers(pa.array(list(words), pa.string()))
    return np.sort(K.hashed_words(data, offsets, lower=True)[0])


_COMMON_HASH, _INSULT_HASH = _word_hash(set(COMMON.split())), [_word_hash(set(x)) for x in INSULTS]


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


@dataclass
class Block:
    """What one block of texts has: byte classes, and the hashes of words and of their beginnings (0 where a word is no longer than that)."""

    classes: np.ndarray
    offsets: np.ndarray
    words: np.ndarray
    stems: list[np.ndarray]
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Block:
        classes = _CLASSES[data]
        clean = np.where(classes >= 4, np.uint8(0x20), data)  # words for the lists are runs of letters and digits
        starts, ends, first = K.word_bounds(clean, offsets)
        points = np.flatnonzero((clean & 0xC0) != 0x80)
        own = np.searchsorted(points, starts)
        cuts = [np.maximum(starts + 1, np.minimum(ends, points[np.minimum(own + k, len(points) - 1)])) if len(points) else ends for k in STEMS]
        words, *stems = K.part_hashes(clean, starts, ends, [ends, *cuts], lower=True)
        stems = [np.where(cut < ends, K.mix(h + np.uint64(k)), np.uint64(0)) for k, cut, h in zip(STEMS, cuts, stems, strict=True)]
        return cls(classes, offsets, words, stems, first)

    def per_text(self, hit: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(hit)))[bounds])

    @cached_property
    def measures(self) -> np.ndarray:
        """texts x MEASURES: runs of signs a word, upper-case share, pipes a word, signs a byte, common words, stops a word, repeats of the word before; each smoothed by SMOOTH words of ordinary text."""
        c, n = self.classes, np.diff(self.first)
        count = {k: self.per_text(c == k, self.offsets) for k in (0, 1, 2, 3, 6, 7, 8, 9)}
        words, letters = n + SMOOTH, 5 * SMOOTH
        pair, again = np.zeros(len(c), bool), np.zeros(len(self.words), bool)
        pair[1:] = (c[1:] == 9) & (c[:-1] == 9)
        again[1:] = self.words[1:] == self.words[:-1]
        again[self.first[:-1][n > 0]] = False
        parts = (
            self.per_text(pair, self.offsets) / words,
            count[1] / (count[0] + count[1] + count[3] + letters),
            count[8] / words,
            (count[9] + count[8] + count[2]) / (np.diff(self.offsets) + letters),
            (self.per_text(_in(self.words, _COMMON_HASH), self.first) + 0.3 * SMOOTH) / words,
            (count[6] + count[7] + 0.1 * SMOOTH) / words,
            self.per_text(again, self.first) / words,
        )
        return np.stack(parts, axis=1) if len(n) else np.zeros((0, MEASURES))

    def votes(self) -> tuple[np.ndarray, np.ndarray]:
        """Base-3 patterns of the votes on prose and of the lists on abuse; heuristics vote bad or keep silent."""
        runs, upper, pipes, signs, common, stops, again = self.measures.T
        prose = [np.where(bad, BAD, SILENT) for bad in (runs > 0.1, upper > 0.2, pipes > 0.05, signs > 0.06, common < 0.08, stops < 0.03, again > 0.25)]
        abuse = [np.where(self.per_text(_in(self.words, h), self.first) > 0, BAD, SILENT) for h in _INSULT_HASH]
        return tuple(sum(v * 3**i for i, v in enumerate(votes)).astype(np.int64) for votes in (prose, abuse))

    @cached_property
    def bases(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(30-bit hashes, their texts): words, then each length of beginnings, as often as they stand."""
        owner, out = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)), []
        for hashes in (self.words, *self.stems):
            there = np.flatnonzero(hashes)
            out.append(((hashes[there] >> np.uint64(34)).astype(np.uint32), owner[there]))
        return out

    def levels(self, bases: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Ascending text << 32 | feature of the distinct features: a hash and 0 for its presence, 1 to 3 where it stands twice and as densely as DENSE."""
        keys, times = np.unique(owner.astype(np.int64) << 30 | bases, return_counts=True)
        density = times / np.maximum(1, np.diff(self.first))[keys >> 30]
        parts = [keys << 2] + [keys[(times > 1) & (density >= least)] << 2 | t for t, least in enumerate(DENSE, 1)]
        return np.sort(np.concatenate(parts))

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(32-bit features, first): those of text i are features[first[i]:first[i + 1]]."""
        keys = self.levels(*(np.concatenate(x) for x in zip(*self.bases, strict=True)))
        return (keys & 0xFFFFFFFF).astype(np.uint32), np.searchsorted(keys, np.arange(len(self.first), dtype=np.int64) << 32)

    def kinds(self) -> np.ndarray:
        """The smallest shingle hash of each text: near copies mostly share it, other texts do not."""
        hashes, owner = K.shingles(self.words, self.first)
        out = np.zeros(len(self.first) - 1, np.uint64)
        if len(owner):
            at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            out[owner[at]] = np.minimum.reduceat(hashes, at)
        return out.view(np.int64)

    def shapes(self) -> np.ndarray:
        """texts x SHAPES: shares of byte-class triples, and measures."""
        c = self.classes
        out = np.zeros((len(self.offsets) - 1, SHAPES), np.float32)
        out[:, TRIPLES:] = self.measures
        for i in range(len(out)):
            part = c[self.offsets[i] : self.offsets[i + 1]]
            if len(part) > 2:
                out[i, :TRIPLES] = np.bincount(part[:-2] * 100 + part[1:-1] * 10 + part[2:], minlength=TRIPLES) / (len(part) - 2)
        return out


def blocks_of(texts: pa.Array) -> Iterator[tuple[int, int, Block]]:
    data, offsets = K.buffers(texts)
    for i, j in K.blocks(offsets, BLOCK_BYTES, BLOCK_TEXTS):
        yield i, j, Block.of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


class Weights:
    """Weights of few features among 2^32: a text's sum over its distinct ones."""

    def __init__(self, features: np.ndarray, weights: np.ndarray):
        order = np.argsort(features)
        self.features, self.weights = features[order], weights[order]
        self._bases = np.unique(self.features >> np.uint32(2))
        self._some: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_some": None}

    def sums(self, block: Block) -> np.ndarray:
        n = len(block.first) - 1
        if not len(self.features):
            return np.zeros(n)
        if self._some is None:  # one bit for the upper half of a hash passes few words on
            self._some = np.zeros(1 << 16, bool)
            self._some[self._bases >> np.uint32(14)] = True
        found = []
        for bases, owner in block.bases:
            near = np.flatnonzero(self._some[bases >> np.uint32(14)])
            near = near[_in(bases[near], self._bases)]
            found.append((bases[near], owner[near]))
        keys = block.levels(*(np.concatenate(x) for x in zip(*found, strict=True)))
        features = (keys & 0xFFFFFFFF).astype(np.uint32)
        hit = _in(features, self.features)
        return np.bincount(keys[hit] >> 32, weights=self.weights[np.searchsorted(self.features, features[hit])], minlength=n)


@dataclass
class Labellers:
    """Accuracies of overlapping labellers, the last one the annotator: the share of bad, P(vote | bad or good) of each, and of all heuristics' silence."""

    prior: float
    table: np.ndarray
    silence: np.ndarray

    def bad(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of bad given base-3 vote patterns."""
        votes = (np.asarray(patterns, np.int64)[:, None] // 3 ** np.arange(len(self.table))) % 3
        ratio = np.log(self.table[:, 0] / self.table[:, 1])
        logit = np.log(self.prior / (1 - self.prior)) + sum(ratio[k, votes[:, k]] for k in range(len(ratio)))
        quiet, loud = np.log(self.silence[0] / self.silence[1]), np.log((1 - self.silence[0]) / (1 - self.silence[1]))
        return 1 / (1 + np.exp(-np.clip(logit + np.where((votes[:, :-1] == SILENT).all(axis=1), quiet, loud), -40, 40)))


def estimate(counts: dict[int, int], labellers: int, rounds: int = 200) -> Labellers:
    """Expectation-maximisation over counts of vote patterns.

    Starts from any bad vote as bad, less so where the annotator says good. Counts are smoothed, so no accuracy reaches
    0 or 1, and a heuristic is never taken to vote bad more on good texts than on bad ones. No patterns: nothing tells.
    """
    even = Labellers(0.1, np.ones((labellers, 2, 3)), np.full(2, 0.5))
    if not counts:
        return even
    patterns = np.array(sorted(counts), np.int64)
    weight = np.array([counts[int(p)] for p in patterns], float)
    votes = (patterns[:, None] // 3 ** np.arange(labellers)) % 3
    quiet = (votes[:, :-1] == SILENT).all(axis=1)
    p = np.where((votes == BAD).any(axis=1), np.where(votes[:, -1] == GOOD, 0.1, 0.9), 0.02)
    found = even
    for _ in range(rounds):
        table, silence = np.ones((labellers, 2, 3)), np.empty(2)
        for y, q in enumerate((weight * p, weight * (1 - p))):
            silence[y] = (q[quiet].sum() + 0.5) / (q.sum() + 1)
            for k in range(labellers - 1):
                table[k, y, BAD] = (q[votes[:, k] == BAD].sum() + 0.5) / (q[~quiet].sum() + 1)
            hits = np.array([q[votes[:, -1] == v].sum() + 0.5 for v in (BAD, GOOD)])
            table[-1, y, [BAD, GOOD]] = hits / hits.sum()
        table[:-1, 1, BAD] = np.minimum(table[:-1, 1, BAD], table[:-1, 0, BAD])
        found = Labellers(float(np.clip((weight * p).sum() / weight.sum(), 1e-4, 0.5)), table, silence)
        before, p = p, found.bad(patterns)
        if np.abs(before - p).max() < 1e-7:
            break
    return found


@dataclass
class Scorer:
    """A linear scorer over hashed words and beginnings present, and byte-class triples: probability of bad."""

    words: Weights
    shapes: np.ndarray | None
    bias: float

    def __call__(self, block: Block, shapes: np.ndarray) -> np.ndarray:
        z = self.words.sums(block) + self.bias
        if self.shapes is not None:
            z = z + shapes @ self.shapes
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def telling(place: np.ndarray, first: np.ndarray, size: int, target: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, log ratios of their rates in bad and good texts): those whose rates differ by more than chance.

    place[first[i]:first[i + 1]]: distinct features of text i, under size; target: probability of bad; share: how much a
    text counts (near copies one between them, 0: not at all). The test is the likelihood ratio of the two rates, held
    against the log of the number of features, so few of them pass by chance however many are tried; a feature of fewer
    than LEAST_DF texts never passes.
    """
    classes = np.stack((share * (1 - target), share * target))
    there, n = np.zeros((2, size)), classes.sum(axis=1)
    for i in range(0, len(target), 500):  # small blocks: memory stays near the sample's size
        j = min(len(target), i + 500)
        part, counts = place[first[i] : first[j]], np.diff(first[i : j + 1])
        for y in (0, 1):
            there[y] += np.bincount(part, weights=np.repeat(classes[y, i:j], counts), minlength=size)
    rate, both = (there + 0.5) / (n[:, None] + 1), there.sum(axis=0) / max(1e-9, n.sum())
    g = np.zeros(size)
    for y in (0, 1):
        for seen, mean in ((there[y], both), (n[y] - there[y], 1 - both)):
            g += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(n[y] * mean, 1e-12)), 0.0)
    tried = max(2, int((both > 0).sum()))
    passed = np.flatnonzero((g > np.log(tried) + 5) & (there.sum(axis=0) >= LEAST_DF))
    return passed, np.log(rate[1] / rate[0])[passed]


def _entries(place: np.ndarray, first: np.ndarray, size: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number in chosen, text) of the entries whose feature is chosen."""
    number = np.full(size, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    at = np.flatnonzero(number[place] >= 0)
    return number[place[at]], np.searchsorted(first, at, "right") - 1


def _descend(at: np.ndarray, first: np.ndarray, scale: np.ndarray, shapes: np.ndarray | None, target: np.ndarray, weight: np.ndarray, strength: float, rounds: int, begin: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted logistic regression on soft targets by Adam: (weights of features times scale, of shapes, bias). begin: weights of shapes and bias to start from. Deterministic."""
    n, size, wide = len(target), len(scale), 0 if shapes is None else shapes.shape[1]
    share = float(np.clip((weight * target).sum(), 1e-3, 1 - 1e-3))
    x = np.concatenate((np.zeros(size + wide), [np.log(share / (1 - share))]))
    if begin is not None:
        x[size:-1], x[-1] = begin
    owner, state = np.repeat(np.arange(n), np.diff(first)), [np.zeros(len(x)) for _ in range(2)]
    for step in range(1, rounds + 1):
        z = np.bincount(owner, weights=(x[:size] * scale)[at], minlength=n) + x[-1]
        if wide:
            z += shapes @ x[size:-1].astype(np.float32)
        miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * weight
        gradient = np.concatenate((np.bincount(at, weights=miss[owner], minlength=size) * scale, (miss.astype(np.float32) @ shapes) if wide else (), [miss.sum()]))
        gradient[:-1] += strength * x[:-1]
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient * gradient
        x = x - 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
    return x[:size] * scale, x[size:-1], float(x[-1])


#: Strengths of the penalty that are tried on held-out rows.
STRENGTHS = (1e-4, 1e-3, 1e-2)
#: Shares are small numbers; this brings them near the others.
_SCALE = 30.0


def train(vocabulary: np.ndarray, place: np.ndarray, first: np.ndarray, shapes: np.ndarray | None, target: np.ndarray, share: np.ndarray, rate: np.ndarray, rounds: int = 120) -> Scorer:
    """A scorer of soft targets. Features are screened by telling() and enter scaled by their log ratios; every fifth row is held out to choose the penalty, then all rows train. Deterministic."""
    n, weight = len(target), share / rate
    if not n or target.max() - target.min() < 1e-6:
        mean = float(np.clip(target.mean(), 1e-3, 0.1)) if n else 0.1
        return Scorer(Weights(np.zeros(0, np.uint32), np.zeros(0)), None, float(np.log(mean / (1 - mean))))
    used = np.zeros(0, np.int64) if shapes is None else np.flatnonzero(shapes.any(axis=0))
    dense = None if shapes is None else shapes[:, used].astype(np.float32) * np.float32(_SCALE)

    def fitted(rows: np.ndarray, strengths: tuple[float, ...], begin: tuple[np.ndarray, float] | None = None) -> Iterator[tuple]:
        """(entries' numbers, their texts, features, their weights, those of shapes, bias) for each strength."""
        features, scale = telling(place, first, len(vocabulary), target, share * rows)
        at, owner = _entries(place, first, len(vocabulary), features)
        use, part = rows[owner], None if dense is None else dense[rows]
        ends = np.searchsorted((np.cumsum(rows) - 1)[owner[use]], np.arange(rows.sum() + 1))
        for strength in strengths:
            found = _descend(at[use], ends, scale, part, target[rows], weight[rows] / weight[rows].sum(), strength, rounds if begin is None else rounds // 2, begin)
            begin = found[1:]
            yield at, owner, features, *found

    best, begin, out = STRENGTHS[0], None, np.arange(n) % 5 == 4
    if out.any() and 0 < target[~out].sum() < (~out).sum():
        losses = []
        for at, owner, _, w, d, bias in fitted(~out, STRENGTHS):
            z = np.bincount(owner, weights=w[at], minlength=n)[out] + bias + (0 if dense is None else dense[out] @ d)
            p = np.clip(1 / (1 + np.exp(-np.clip(z, -40, 40))), 1e-6, 1 - 1e-6)
            losses.append(-(weight[out] * (target[out] * np.log(p) + (1 - target[out]) * np.log(1 - p))).sum())
        best, begin = STRENGTHS[int(np.argmin(losses))], (d, bias)
    _, _, features, w, d, bias = next(fitted(np.ones(n, bool), (best,), begin))
    whole = np.zeros(SHAPES)
    whole[used] = d * _SCALE
    return Scorer(Weights(vocabulary[features], w), None if dense is None else whole, bias)


def lexicon(vocabulary: np.ndarray, place: np.ndarray, first: np.ndarray, target: np.ndarray, share: np.ndarray) -> Weights:
    """Words and beginnings that stand at least TELLING times as often in bad texts, by more than chance."""
    features, ratio = telling(place, first, len(vocabulary), target, share)
    strong = ratio >= np.log(TELLING)
    return Weights(vocabulary[features[strong]], np.ones(int(strong.sum())))


@dataclass
class Model:
    """Fitted on one corpus: a lexicon of abuse for each half of the rows, labellers and a scorer for each question."""

    lexicons: tuple[Weights, Weights]
    prose: Labellers
    abuse: Labellers
    prose_scorer: Scorer
    abuse_scorer: Scorer


def _annotations(labels: DataFrame) -> DataFrame:
    """doc_id, prose, abuse: votes of annotations (doc_id, quality, toxic); of several for one id the worst counts, nulls abstain."""
    vote = lambda c, bad: F.max(F.when(F.col(c).isNull(), SILENT).when(F.col(c) == bad, 2).otherwise(1))
    worst = labels.where("doc_id is not null").groupBy("doc_id").agg(vote("quality", 0).alias("q"), vote("toxic", 1).alias("t"))
    turned = lambda c: F.when(F.col(c) == 2, BAD).when(F.col(c) == 1, GOOD).otherwise(SILENT).cast("long")
    return worst.select(F.col("doc_id").alias("_id"), turned("q").alias("said_prose"), turned("t").alias("said_abuse"))


def half_of(doc_id: Column) -> Column:
    """0 or 1 by a hash of the id: a row's half, whose lexicon is learned on the other one."""
    return F.pmod(F.xxhash64(doc_id, F.lit(11)), F.lit(2)).cast("int")


def _learned(block: Block, half: np.ndarray, lexicons: tuple[Weights, Weights]) -> np.ndarray:
    """The lexicon's vote on each text, in its place of the pattern."""
    bad = np.where(half == 0, lexicons[0].sums(block) > 0, lexicons[1].sums(block) > 0)
    return np.where(bad, BAD, SILENT).astype(np.int64) * 3 ** len(INSULTS)


@dataclass
class Sample:
    """The rows that train: places of the distinct features of each in the ascending vocabulary, shapes, votes and what was said, halves and rates, and how much each counts (near copies one between them); in an order that does not depend on tasks."""

    vocabulary: np.ndarray
    place: np.ndarray
    first: np.ndarray
    shapes: np.ndarray
    prose: np.ndarray
    abuse: np.ndarray
    half: np.ndarray
    rate: np.ndarray
    share: np.ndarray


_DESCRIBED = "words binary, shapes binary, prose long, abuse long, half int, rate double, kind long"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, said_prose, said_abuse, half, rate -> what a Sample has of the row; the lexicon's vote is not known yet."""
    for batch in batches:
        said = [batch.column(c).to_numpy() for c in ("said_prose", "said_abuse")]
        for i, j, block in blocks_of(batch.column("text")):
            flat, first = block.features()
            words = [flat[first[k] : first[k + 1]].tobytes() for k in range(j - i)]
            prose, abuse = block.votes()
            shapes = [x.tobytes() for x in block.shapes().astype(np.float16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(shapes, pa.binary()), pa.array(prose + said[0][i:j] * 3**PROSE), pa.array(abuse + said[1][i:j] * 3**ABUSE), batch.column("half").slice(i, j - i), batch.column("rate").slice(i, j - i), pa.array(block.kinds())],
                names=["words", "shapes", "prose", "abuse", "half", "rate", "kind"],
            )


def _thinned(chosen: DataFrame) -> DataFrame:
    """chosen, written, and where its texts are over SAMPLE_BYTES an even part of it by a hash of the text, at the lower rate that makes."""
    chosen = save(chosen, "sample")
    over = total_bytes(chosen, "text") / SAMPLE_BYTES
    if over <= 1:
        return chosen
    return chosen.where(F.shiftrightunsigned(F.xxhash64("text", F.lit(13)), 33) < 2**31 / over).withColumn("rate", F.col("rate") / over)


def _described(chosen: DataFrame) -> DataFrame:
    """chosen (text, said_prose, said_abuse, half, rate) as _describe gives it, written: two tasks read it."""
    return save(chosen.mapInArrow(_describe, _DESCRIBED), "described")


def _fitted(described: DataFrame, run: Callable[[Sample], object]) -> object:
    """What run makes of the sample, in one task: the sample is bounded, and the driver gets the result alone."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(run(_gathered(batches)))], pa.binary())], names=["out"])

    found = described.repartition(1).mapInArrow(task, "out binary").collect()
    return pickle.loads(found[0]["out"]) if found else run(_gathered(iter(())))  # no task runs over no rows


def _gathered(batches: Iterator[pa.RecordBatch]) -> Sample:
    """The described rows, about as many as the sample's bound.

    Rows stay in their Arrow buffers until features that too few of them have are gone, which most are: a table of counts
    by the upper bits of a feature tells, and keeps every feature that might have enough.
    """
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    table = pa.Table.from_batches(batches, pa.schema([(c, kinds[kind]) for c, kind in (x.split() for x in _DESCRIBED.split(", "))]))
    words, shapes = ([x.as_buffer() for chunk in table.column(c).chunks for x in chunk] for c in ("words", "shapes"))
    order = sorted(range(len(words)), key=lambda i: (zlib.crc32(words[i]), zlib.crc32(shapes[i]), words[i].size))  # tasks end in any order; sums of floats should not
    rest = [table.column(c).to_numpy()[order] if order else np.zeros(0, np.int64) for c in ("prose", "abuse", "half", "rate", "kind")]
    seen, dense, parts = np.zeros(1 << 24, np.uint8), np.empty((len(order), SHAPES), np.float16), [np.zeros(0, np.uint32)]
    for x in words:
        at = np.frombuffer(x, np.uint32) >> np.uint32(8)
        seen[at] = np.minimum(seen[at], 254) + 1
    for k, i in enumerate(order):
        dense[k] = np.frombuffer(shapes[i], np.float16)
        x = np.frombuffer(words[i], np.uint32)
        parts.append(x[seen[x >> np.uint32(8)] >= LEAST_DF])
    del table, words, shapes, seen
    vocabulary, times = np.unique(np.concatenate(parts), return_counts=True)
    vocabulary = vocabulary[times >= LEAST_DF]  # others never pass the test
    for k, x in enumerate(parts):
        parts[k] = np.searchsorted(vocabulary, x[_in(x, vocabulary)]).astype(np.int32)
    first = np.cumsum([len(x) for x in parts], dtype=np.int64)
    _, kind, copies = np.unique(rest.pop(), return_inverse=True, return_counts=True)
    return Sample(vocabulary, np.concatenate(parts), first, dense, *rest, 1 / copies[kind])


def _no_lexicons() -> tuple[Weights, Weights]:
    return Weights(np.zeros(0, np.uint32), np.zeros(0)), Weights(np.zeros(0, np.uint32), np.zeros(0))


def _cross_fitted(sample: Sample) -> tuple[Weights, Weights]:
    """For each half the lexicon of the other half's annotated rows."""
    said, out = sample.abuse // 3**ABUSE, []
    bad = (said == BAD).astype(float)
    for half in (0, 1):
        rows = (sample.half != half) & (said != SILENT)
        both = 0 < bad[rows].sum() < rows.sum()
        out.append(lexicon(sample.vocabulary, sample.place, sample.first, bad, sample.share * rows) if both else _no_lexicons()[0])
    return out[0], out[1]


def _sample_votes(sample: Sample, lexicons: tuple[Weights, Weights]) -> np.ndarray:
    """The rows' patterns on abuse with the lexicons' votes."""
    bad = np.zeros(len(sample.rate), bool)
    for half, known in enumerate(lexicons):
        _, owner = _entries(sample.place, sample.first, len(sample.vocabulary), np.searchsorted(sample.vocabulary, known.features))
        bad |= (np.bincount(owner, minlength=len(bad)) > 0) & (sample.half == half)
    return sample.abuse + np.where(bad, BAD, SILENT) * 3 ** len(INSULTS)


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> Model:
    """Vote patterns are counted over all rows. The lexicons and the scorers see about `sample` rows, fixed by a hash of the id.

    With labels (doc_id, quality 0/1, toxic 0/1) that hold bad ones the sample is of annotated rows: half of those
    annotated bad, half of the others, weighted back to their shares. Without, there is no lexicon, and half of the
    sample is of rows on which some heuristic votes, half of the others.
    """
    texts = docs.select("doc_id", "text").withColumn("half", half_of(F.col("doc_id")))
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(9)), 33)
    part = lambda wanted, there: min(1.0, wanted / max(1, there))
    said, rows, lexicons, rare = None, None, _no_lexicons(), 0
    if labels is not None:
        said = _annotations(labels)
        bad = (F.col("said_prose") == BAD) | (F.col("said_abuse") == BAD)
        rare, told = said.agg(F.coalesce(F.sum(bad.cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    if rare:
        rates = part(sample / 2, rare), part(sample / 2, told - rare)
        ids = said.withColumn("rate", F.when(bad, rates[0]).otherwise(rates[1])).withColumnRenamed("_id", "doc_id").where(hashed < F.col("rate") * 2**31)
        chosen = texts.join(F.broadcast(ids), "doc_id")  # about `sample` ids
        rows = _described(_thinned(chosen.select("text", "said_prose", "said_abuse", "half", "rate")))
        lexicons = _fitted(rows, _cross_fitted)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column("half").to_numpy()
            for i, j, block in blocks_of(batch.column("text")):
                prose, abuse = block.votes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(prose), pa.array(abuse + _learned(block, half[i:j], lexicons))], names=["doc_id", "prose", "abuse"])

    votes = texts.mapInArrow(vote, "doc_id long, prose long, abuse long")
    if said is not None:
        votes = votes.join(said, F.col("doc_id") == F.col("_id"), "left")
    else:
        votes = votes.withColumns({"said_prose": F.lit(0).cast("long"), "said_abuse": F.lit(0).cast("long")})
    whole = [(F.col("prose") + F.coalesce("said_prose", F.lit(0)) * 3**PROSE).alias("prose"), (F.col("abuse") + F.coalesce("said_abuse", F.lit(0)) * 3**ABUSE).alias("abuse")]
    counts = votes.select(*whole).groupBy("prose", "abuse").agg(F.count(F.lit(1)).alias("n")).collect()  # at most a row for each pair of patterns
    tables: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for r in counts:
        for table, k in zip(tables, (r["prose"], r["abuse"]), strict=True):
            table[k] = table.get(k, 0) + r["n"]
    prose, abuse = estimate(tables[0], PROSE + 1), estimate(tables[1], ABUSE + 1)
    if rows is None:
        heard = lambda p, a: (p % 3**PROSE > 0) | (a % 3**ABUSE > 0)
        loud = sum(r["n"] for r in counts if heard(r["prose"], r["abuse"]))
        rates = part(sample / 2, sum(r["n"] for r in counts) - loud), part(sample / 2, loud)
        rows = _described(_thinned(_by_votes(texts.withColumn("hashed", hashed), rates, said).select("text", "said_prose", "said_abuse", "half", "rate")))

    def scorers(rows: Sample) -> list[Scorer]:
        patterns = rows.prose, _sample_votes(rows, lexicons)
        targets = [known.bad(p) for known, p in zip((prose, abuse), patterns, strict=True)]
        return [train(rows.vocabulary, rows.place, rows.first, s, t, rows.share, rows.rate) for s, t in zip((rows.shapes, None), targets, strict=True)]

    return Model(lexicons, prose, abuse, *_fitted(rows, scorers))


def _by_votes(texts: DataFrame, rates: tuple[float, float], said: DataFrame | None) -> DataFrame:
    """Rows of texts by the hash of their id, at one rate where all heuristics are silent and another where some votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = batch.column("hashed").to_numpy()
            for i, j, block in blocks_of(batch.column("text")):
                prose, abuse = block.votes()
                rate = np.where((prose > 0) | (abuse > 0), rates[1], rates[0])
                at = i + np.flatnonzero(hashed[i:j] < rate * 2**31)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in ("doc_id", "text", "half")] + [pa.array(rate[at - i])], names=["doc_id", "text", "half", "rate"])

    chosen = texts.mapInArrow(run, "doc_id long, text string, half int, rate double")
    if said is None:
        return chosen.withColumns({"said_prose": F.lit(0).cast("long"), "said_abuse": F.lit(0).cast("long")})
    left = chosen.join(said, F.col("doc_id") == F.col("_id"), "left")
    return left.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("said_prose", "said_abuse")})


_MARKS = ("weak_bad", "weak_toxic", "bad", "toxic")
_MARKED = T.StructType([*[T.StructField(c, T.DoubleType()) for c in _MARKS], T.StructField("kept", T.BooleanType())])


def _marks(text: Column, doc_id: Column, model: Model) -> Column:
    """A struct of the scores of a text and whether it is kept. Only texts go to Python and only marks come back."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, halves in batches:
            half, parts = halves.to_numpy(), [np.zeros((len(_MARKS), 0))]
            for i, j, block in blocks_of(texts):
                (prose, abuse), shapes = block.votes(), block.shapes()
                abuse = abuse + _learned(block, half[i:j], model.lexicons)
                parts.append(np.stack((model.prose.bad(prose), model.abuse.bad(abuse), model.prose_scorer(block, shapes), model.abuse_scorer(block, shapes))))
            values = np.concatenate(parts, axis=1)
            kept = pa.array((values[2] < 0.5) & (values[3] < 0.5))
            yield pa.StructArray.from_arrays([*map(pa.array, values), kept], names=_MARKED.names)

    marks = F.arrow_udf(run, _MARKED)
    return marks(text, half_of(doc_id))


def score(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """docs' columns as _0, _1, ... and weak_bad, weak_toxic (vote posteriors), bad, toxic (scores) and kept.

    kept: neither score reaches 0.5. A null or blank text has no words and no signs; it is scored like any other
    short text, by what little it has. Repeated rows score alike; an empty table gives an empty table.
    """
    model = model or fit(docs, labels, sample)
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: names[docs.columns.index(c)] for c in ("text", "doc_id")}
    return plain.select("*", _marks(F.col(at["text"]), F.col(at["doc_id"]), model).alias("_marks")).select(*names, *[F.col("_marks")[c].alias(c) for c in _MARKED.names])


def filter_quality(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns, whatever their names.

    A null or blank text has no words and no signs and is judged like any other short text; very long texts are read
    whole, block by block; repeated rows are kept or go alike; rows without doc_id are judged, but no annotation is theirs.
    labels may be empty or None: then the heuristics alone teach. An empty table gives an empty table.
    """
    return docs.where(_marks(F.col("text"), F.col("doc_id"), fit(docs, labels, sample))["kept"])
