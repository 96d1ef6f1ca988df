"""Boosted trees of a search, many fits at once: each task grows all trees of one fit.

A search draws many parameter sets of hundreds of trees.  Where every level of every tree is a Spark
job of its own, the jobs' start-up is most of the time.  Here the rows are coded once a
training set (quantile bins of imputed numbers, kept levels of text: a few bytes a row), the codes go to all tasks,
and a task fits one candidate on one set.  Candidates that differ in their number of trees only are one fit, scored at each
number.  Codes beyond ``CODE_BYTES`` stay distributed, and trees deeper than ``DEEPEST`` are
Spark's too: ``fits`` returns None and the search fits them by Spark.

The model is that of ``models.boosted_trees``: least-squares trees on the slope of the logistic loss, the first one on the
labels (-1, 1), at most ``BINS`` bins of a number, one split a level against the rest, columns sampled per node, rows per tree.
Bins are cut at exact quantiles (Spark's at those of a sample), and the random draws are others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colref import c
from .batchfit import Batch, Design, Layout, raw_columns

BINS = 32  # of a number at most, GBTClassifier's default
JOINT = 1024  # codes that features counted together have at most
PART = 1 << 15  # rows worked through at a time: their arrays stay in a core's cache
CODE_BYTES = 64 << 20  # codes of a training set that are sent to every task
DEEPEST = 6  # levels whose leaves are the bits of a number


@dataclass
class Coding:
    """The features of a training set as small codes, several features in one."""

    sizes: list[int]  # codes of each feature
    slots: list[list[int]]  # the column of the feature vector that each split of a feature is on
    rules: list[np.ndarray]  # splits x codes of each feature: which codes go right
    groups: list[list[int]]  # features counted together
    width: int  # columns of the feature vector

    def joint(self, group: Sequence[int]) -> int:
        return int(np.prod([self.sizes[f] for f in group]))


def _levels(design: Design) -> list[np.ndarray]:
    """Of each text column: the code of every listed level, of any other and of a missing one; none is the last code."""
    out = []
    for goes in design.goes:
        kept = np.unique(goes[goes >= 0])
        out.append(np.where(goes >= 0, np.searchsorted(kept, goes), len(kept)))
    return out


def coding(design: Design) -> Coding:
    sizes, slots, rules, width = [], [], [], 0
    for edges in design.bins:
        size = len(edges) + 1
        sizes.append(size)
        rules.append(np.arange(size)[None, :] > np.arange(size - 1)[:, None])
        slots.append([width] * (size - 1))
        width += 1
    for goes in design.goes:
        kept = len(np.unique(goes[goes >= 0]))
        sizes.append(kept + 1)
        rules.append(np.arange(kept + 1)[None, :] == np.arange(kept)[:, None])
        slots.append(list(range(width, width + kept)))
        width += kept
    groups: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        room = next((g for g in groups if sizes[f] * np.prod([sizes[x] for x in g]) <= JOINT), None)
        if room is None:
            groups.append([f])
        else:
            room.append(f)
    return Coding(sizes, slots, rules, groups or [[]], width)


_CODED = "key binary, codes binary, positive binary, held binary"


def _code(layout: Layout, design: Design, cod: Coding):
    """Blocks of rows: a hash of the id, the joint codes, the label and whether the row is held out."""
    levels = _levels(design)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            num, codes = layout.encode(batch)
            x = np.where(np.isnan(num), design.medians, num)
            own = [np.searchsorted(edges, x[:, j], side="right") for j, edges in enumerate(design.bins)]
            own += [table[code] for table, code in zip(levels, codes.T, strict=True)]
            joint = np.zeros((len(cod.groups), batch.num_rows), dtype=np.uint16)
            for g, group in enumerate(cod.groups):
                at = np.zeros(batch.num_rows, dtype=np.int64)
                for f in group:
                    at = at * cod.sizes[f] + own[f]
                joint[g] = at
            column = lambda name: batch.column(batch.schema.names.index(name)).to_numpy(zero_copy_only=False)
            parts = (column("_key").astype(np.int64), joint.T, (column("label") == 1).astype(np.uint8), column("_held").astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts], names=["key", "codes", "positive", "held"])
    return run


def _collected(folded: DataFrame, layout: Layout, design: Design, cod: Coding, fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(joint codes by group, label, held out) of all rows, in the order of their ids' hashes: however the table is dealt, the same."""
    src = folded.select(*raw_columns(layout.cat, layout.num), c("label").cast("double").alias("label"), F.xxhash64("_id").alias("_key"), (c("_fin") == fold).alias("_held"))
    found = src.mapInArrow(_code(layout, design, cod), _CODED).collect()  # ``CODE_BYTES`` at most
    joined = lambda name, kind: np.frombuffer(b"".join(r[name] for r in found), dtype=kind)
    key, codes, positive, held = joined("key", np.int64), joined("codes", np.uint16).reshape(-1, len(cod.groups)), joined("positive", np.uint8), joined("held", np.uint8)
    order = np.lexsort((positive, *codes.T, key))
    return np.ascontiguousarray(codes[order].T), positive[order] == 1, held[order] == 1


# ---------------------------------------------------------------- one fit

@dataclass
class Tree:
    """Leaves as bits: of each group, the leaves that a row with a joint code can be in; the one leaf in all groups' sets is the row's."""

    masks: list[np.ndarray]
    values: np.ndarray  # of each leaf

    def leaves(self, codes: Sequence[np.ndarray]) -> np.ndarray:
        at = self.masks[0].take(codes[0])
        for mask, own in zip(self.masks[1:], codes[1:], strict=True):
            at &= mask.take(own)
        # the place of the only bit is the exponent of the number
        return self.values.take((at.astype(np.float64).view(np.int64) >> 52) - 1023)


def _bits(lo: int, hi: int) -> np.uint64:
    return np.uint64((1 << hi) - (1 << lo))


def _tree(levels: int, splits: Sequence[tuple[int, int, int, np.ndarray]], values: np.ndarray, sizes: Sequence[int]) -> Tree:
    """A tree of (level, node, group, which joint codes go right); rows of a node that is not split go left."""
    masks = [np.full(s, _bits(0, 1 << levels), dtype=np.uint64) for s in sizes]
    parted = {(level, k) for level, k, _, _ in splits}
    for level, k, g, rule in splits:
        half = 1 << (levels - level - 1)
        at = 2 * k * half
        masks[g] &= np.where(rule, ~_bits(at, at + half), ~_bits(at + half, at + 2 * half))
    gone = np.uint64(0)
    for level in range(levels):
        half = 1 << (levels - level - 1)
        for k in range(1 << level):
            if (level, k) not in parted:
                gone |= _bits((2 * k + 1) * half, (2 * k + 2) * half)
    masks[0] &= ~gone
    return Tree(masks, values)


def grow(cod: Coding, codes: Sequence[np.ndarray], slope: np.ndarray, inside: np.ndarray | None, depth: int, share: float, rng: np.random.Generator) -> Tree:
    """A least-squares tree of ``slope`` (0 where a row is not ``inside``); a leaf's value is the mean of its rows."""
    sizes = [cod.joint(g) for g in cod.groups]
    n = len(slope)
    node = np.zeros(n, dtype=np.int64)
    taken = int(np.ceil(share * cod.width))
    split_slot = np.array([s for own in cod.slots for s in own], dtype=np.int64)
    starts = np.cumsum([0, *[len(own) for own in cod.slots]])
    place = {f: (g, i) for g, group in enumerate(cod.groups) for i, f in enumerate(group)}
    splits: list[tuple[int, int, int, np.ndarray]] = []
    tables: dict[int, np.ndarray] = {}  # of the last level: group -> whether (node, joint code) goes right
    values = np.zeros(1)
    levels = 0
    for level in range(depth):
        nodes = 1 << level
        sums = [np.zeros((2, nodes * s)) for s in sizes]
        for lo in range(0, n, PART):
            hi = min(lo + PART, n)
            own = node[lo:hi]
            if tables:
                turn = [table.take(own * sizes[g] + codes[g][lo:hi]) for g, table in tables.items()]
                own *= 2
                for right in turn:
                    own += right
            for g, s in enumerate(sizes):
                at = own * s + codes[g][lo:hi] if level else codes[g][lo:hi]
                sums[g][0] += np.bincount(at, weights=slope[lo:hi], minlength=nodes * s)
                sums[g][1] += np.bincount(at, weights=None if inside is None else inside[lo:hi], minlength=nodes * s)
        whole = sums[0].reshape(2, nodes, -1).sum(axis=2)[:, :, None]
        if not level:
            values = np.array([whole[0, 0, 0] / whole[1, 0, 0] if whole[1, 0, 0] else 0.0])
        if not len(split_slot):
            break
        right = np.zeros((2, nodes, len(split_slot)))
        for g, group in enumerate(cod.groups):
            cells = sums[g].reshape(2, nodes, *[cod.sizes[f] for f in group])
            for i, f in enumerate(group):
                one = cells.sum(axis=tuple(2 + k for k in range(len(group)) if k != i))
                right[:, :, starts[f]: starts[f + 1]] = one @ cod.rules[f].T
        left = whole - right
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - whole[0] ** 2 / whole[1]
        gain[(left[1] < 0.5) | (right[1] < 0.5)] = -np.inf
        if taken < cod.width:
            drawn = np.zeros((nodes, cod.width), dtype=bool)
            np.put_along_axis(drawn, np.argsort(rng.random((nodes, cod.width)), axis=1)[:, :taken], True, axis=1)
            gain[~drawn[:, split_slot]] = -np.inf
        best = gain.argmax(axis=1)
        parted = np.flatnonzero(gain[np.arange(nodes), best] > 1e-10)
        if not len(parted):
            break
        levels = level + 1
        values = np.repeat(values, 2)
        tables = {}
        for k in parted.tolist():
            s = int(best[k])
            values[2 * k], values[2 * k + 1] = left[0, k, s] / left[1, k, s], right[0, k, s] / right[1, k, s]
            f = int(np.searchsorted(starts, s, side="right")) - 1
            g, i = place[f]
            shape = [cod.sizes[x] for x in cod.groups[g]]
            rule = np.broadcast_to(cod.rules[f][s - starts[f]].reshape([-1 if x == i else 1 for x in range(len(shape))]), shape).ravel()
            splits.append((level, k, g, rule))
            if g not in tables:
                tables[g] = np.zeros(nodes * sizes[g], dtype=np.int8)
            tables[g][k * sizes[g]: (k + 1) * sizes[g]] = rule
    return _tree(levels, splits, values, sizes)


def boost(cod: Coding, codes: np.ndarray, positive: np.ndarray, held: np.ndarray, params: Mapping, counts: Sequence[int], seed: int) -> dict[int, float | None]:
    """AUROC of the held-out rows after each number of trees in ``counts``."""
    train, test = ([x[own].astype(np.int64) for x in codes] for own in (~held, held))
    sign, y = np.where(positive[~held], 1.0, -1.0), positive[held]
    rate, depth, sub, share = float(params.get("learning_rate", 0.1)), int(params.get("max_depth", 4)), float(params.get("subsample", 1.0)), float(params.get("colsample_bytree", 1.0))
    margin, out_margin, slope = np.zeros(len(sign)), np.zeros(len(y)), sign.copy()
    out: dict[int, float | None] = {}
    for m in range(max(counts)):
        rng = np.random.default_rng([seed, m])
        inside = (rng.random(len(sign), dtype=np.float32) < sub).astype(np.float64) if sub < 1 else None
        tree = grow(cod, train, slope if inside is None else slope * inside, inside, depth, share, rng)
        tree.values *= rate if m else 1.0  # the first tree has weight 1
        for lo in range(0, len(sign), PART):
            part = slice(lo, lo + PART)
            margin[part] += tree.leaves([x[part] for x in train])
            with np.errstate(over="ignore"):
                slope[part] = 4.0 * sign[part] / (1.0 + np.exp(2.0 * sign[part] * margin[part]))
        for lo in range(0, len(y), PART):
            part = slice(lo, lo + PART)
            out_margin[part] += tree.leaves([x[part] for x in test])
        if m + 1 in counts:
            with np.errstate(over="ignore"):
                out[m + 1] = auroc(1.0 / (1.0 + np.exp(-2.0 * out_margin)), y)
    return out


def auroc(score: np.ndarray, positive: np.ndarray) -> float | None:
    """Tie-aware; None with one class."""
    above, below = np.sort(score[positive]), np.sort(score[~positive])
    if not len(above) or not len(below):
        return None
    return float((np.searchsorted(below, above).sum() + np.searchsorted(below, above, side="right").sum()) / 2 / (len(above) * len(below)))


# ---------------------------------------------------------------- all fits of a search

def fits(folded: DataFrame, cands: Sequence[Mapping], cat_cols: Sequence[str], num_cols: Sequence[str], inner: int, seed: int, min_freq: float) -> dict[int, float | None] | None:
    """AUROC on the rows of each fold ``_fin`` of every candidate fitted on the others, fold by fold; None if the codes are too many to send."""
    if any(int(p.get("max_depth", 4)) > DEEPEST for p in cands):
        return None
    folded = folded.filter(c("label").isNotNull())
    groups = len(list(cat_cols)) + len(list(num_cols))  # joint codes at most
    if folded.count() * (2 * groups + 10) > CODE_BYTES:
        return None
    sc = folded.sparkSession.sparkContext
    times = F.array(*[(c("_fin") != f).cast("tinyint") for f in range(1, inner + 1)])
    batch = Batch.prepare(folded, cat_cols, num_cols, times, inner, min_freq)
    designs = batch.binned(BINS)
    sent = []
    for f, design in enumerate(designs):
        cod = coding(design)
        sent.append(sc.broadcast((cod, *_collected(folded, batch.layout, design, cod, f + 1))))
    batch.discard()
    # candidates with the same trees, as many as the longest has
    alike: dict[tuple, list[int]] = {}
    for k, p in enumerate(cands):
        alike.setdefault(tuple(sorted((n, v) for n, v in p.items() if n != "n_estimators")), []).append(k)
    trees = lambda k: int(cands[k].get("n_estimators", 300))
    work = [(f, own) for own in alike.values() for f in range(inner)]
    # the longest first, so that no task begins late
    work.sort(key=lambda w: -max(trees(k) for k in w[1]) * int(cands[w[1][0]].get("max_depth", 4)))
    todo = [(f, dict(cands[own[0]]), sorted({trees(k) for k in own})) for f, own in work]

    def run(item):
        f, params, counts = item
        return boost(*sent[f].value, params, counts, seed)

    found = sc.parallelize(todo, len(todo)).map(run).collect() if todo else []
    out = {f * len(cands) + k: aucs[trees(k)] for (f, own), aucs in zip(work, found, strict=True) for k in own}
    for b in sent:
        b.destroy()
    return out


__all__ = ["fits", "boost", "grow", "coding", "auroc"]
