"""Many weighted elastic-net fits over one table, solved together.

A search over folds or a bootstrap is many fits of one model to the same rows under
different row weights and penalties.  Here all of them run in step: every
iteration is one pass over the rows that returns each fit's loss, gradient and
curvature, and the driver takes one proximal Newton step a fit (coordinate descent
on a few dozen coefficients).  A pass costs the same number of jobs for one
fit as for five hundred, and what it returns is bounded by fits x features^2.

Each training set (a fold's complement, a draw) has its own preprocessing: medians,
means and deviations, modes and kept levels, class weights.  None needs a table of its own:
imputed, scaled and one-hot features are linear in the raw values, their
missing marks and the level marks, so a set's preprocessing is a small matrix
applied to coefficients and gradients, never to rows.

* ``Batch.prepare`` packs the rows into numpy blocks in a written table (with each row's count in each set)
  and gathers every set's statistics: one pass for moments, levels and value ranges, and a few that narrow
  the ranges of the medians until the exact value is known.
* ``Batch.fit`` solves fits (set, C, l1_ratio) and returns their coefficients.
* ``Batch.score`` gives probabilities of chosen fits for rows of any table.

The objective is that of ``models.elasticnet`` on ``prep.fit_preprocessor`` features: sum of weighted
log losses + (l1_ratio |b| + (1 - l1_ratio) / 2 |b|^2) / C, the intercept free, class weights balanced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colref import c
from ..session import remove_scratch, scratch_path
from .draws import counts

SPLIT = 256  # parts of a value range that a pass counts
EXACT = 4096  # rows of a range below which its values are listed
ROWS = 512  # rows of a block's part that are multiplied at a time: their arrays stay in a core's cache
RUN = 64  # mean rows of a run of like rows from which runs are worked through one by one
FEW = 6  # fits up to which a curvature is one product a fit
SHRINK = 0.1  # of the last step: a fit whose step is longer gets a curvature of its own
GATHER = 1 << 16  # rows whose scores a task orders at a time
CUTS = 1024  # parts of the score range that the first pass counts
BUCKET = 1 << 20  # scores of a fit that one task ranks
SMALL, LARGE = 4096, 1 << 18  # rows of a task at least and at most
OTHER = "Other"


# ---------------------------------------------------------------- order-preserving keys of doubles

def _keys(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles (-0.0 as 0.0)."""
    bits = (np.asarray(x, dtype=np.float64) + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def _values(keys: np.ndarray) -> np.ndarray:
    top = np.uint64(1 << 63)
    return np.where(keys & top, keys & ~top, ~keys).view(np.float64)


# ---------------------------------------------------------------- sums of arrays over tasks

_PARTS = "key int, part binary"


def _part(key: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([np.ascontiguousarray(values, dtype=np.float64).tobytes()], pa.binary())], names=["key", "part"])


def _add_up(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(part.as_buffer(), dtype=np.float64)
            if key in total:
                total[key] += x
            else:
                total[key] = x.copy()
    for key, x in total.items():
        yield _part(key, x)


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums by key of the arrays that tasks return, added up in Spark; one array a key comes back."""
    return {r["key"]: np.frombuffer(r["part"]) for r in parts.repartition("key").mapInArrow(_add_up, _PARTS).collect()}


# ---------------------------------------------------------------- rows as matrices

@dataclass
class Layout:
    """Columns, their listed levels, and the center that numbers are stored against."""

    num: list[str]
    cat: list[str]
    levels: list[list[str]]  # of each text column, alphabetical; any other value is one code, null the next
    center: np.ndarray

    @property
    def width(self) -> int:
        return 2 * len(self.num) + 1 + sum(len(v) + 2 for v in self.levels)

    def starts(self) -> list[int]:
        at, out = 2 * len(self.num) + 1, []
        for v in self.levels:
            out.append(at)
            at += len(v) + 2
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of raw columns (first not after second) whose product is not always zero: marks of two levels of one column never meet."""
        block = np.arange(self.width)
        for at, v in zip(self.starts(), self.levels, strict=True):
            block[at: at + len(v) + 2] = at
        a, e = np.triu_indices(self.width)
        ok = (a == e) | (block[a] != block[e])
        return a[ok], e[ok]

    def encode(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(numbers with NaN for missing, level codes) of a batch with columns ``num`` and ``cat``."""
        names = batch.schema.names
        num = np.column_stack([batch.column(names.index(f"_n{k}")).to_numpy(zero_copy_only=False) for k in range(len(self.num))]) if self.num else np.zeros((batch.num_rows, 0))
        codes = np.zeros((batch.num_rows, len(self.cat)), dtype=np.int32)
        for k, levels in enumerate(self.levels):
            values = batch.column(names.index(f"_c{k}"))
            at = pc.index_in(values, value_set=pa.array(levels, pa.string())).fill_null(len(levels)).to_numpy(zero_copy_only=False)
            codes[:, k] = np.where(values.is_null().to_numpy(zero_copy_only=False), len(levels) + 1, at)
        return num.astype(np.float64), codes

    def matrix(self, num: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Centered numbers (0 where missing), missing marks, a constant and level marks."""
        p, n = len(self.num), len(codes) if len(self.cat) else len(num)
        z = np.zeros((n, self.width))
        missing = np.isnan(num)
        z[:, :p] = np.where(missing, 0.0, num - self.center)
        z[:, p: 2 * p] = missing
        z[:, 2 * p] = 1.0
        rows = np.arange(n)
        for k, at in enumerate(self.starts()):
            z[rows, at + codes[:, k]] = 1.0
        return z


def raw_columns(cat_cols: Sequence[str], num_cols: Sequence[str]) -> list[Column]:
    """The columns that ``Layout.encode`` reads."""
    number = lambda n: F.nanvl(c(n).cast("double"), F.lit(None).cast("double"))
    return [number(n).alias(f"_n{k}") for k, n in enumerate(num_cols)] + [c(n).cast("string").alias(f"_c{k}") for k, n in enumerate(cat_cols)]


_BLOCK = "n int, num binary, codes binary, label binary, times binary"


def _pack(layout: Layout, sets: int, draws: tuple[int, float] | None):
    """Blocks of rows: numbers, codes, labels and each row's count in every set."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            num, codes = layout.encode(batch)
            names = batch.schema.names
            label = batch.column(names.index("label")).to_numpy(zero_copy_only=False).astype(np.float64)
            if draws is None:
                times = batch.column(names.index("_times")).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(n, sets)
                # rows of one label and the same sets lie together: ``_curves`` takes them as one
                order = np.lexsort((*times.T, label == 1))
                num, codes, label, times = num[order], codes[order], label[order], times[order]
            else:
                times = hashed_draws(batch.column(names.index("_key")).to_pylist(), sets, *draws)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (num, codes, label, times))],
                                             names=[f.split()[0] for f in _BLOCK.split(", ")])
    return run


def hashed_draws(ids: list[str | None], sets: int, seed: int, frac: float) -> np.ndarray:
    """Each row's count in each draw, as ``stability.draw_weight`` has it (rows x draws)."""
    from .stability import poisson_thresholds

    # a missing id leaves out its separator too, as ``concat_ws`` does
    return counts([f"{seed}|{d}".encode() for d in range(sets)], [b"" if i is None else f"|{i}".encode() for i in ids], poisson_thresholds(frac)).T


class _Rows:
    """A block of the packed table."""

    def __init__(self, layout: Layout, sets: int, record: dict):
        n = record["n"]
        self.num = np.frombuffer(record["num"]).reshape(n, len(layout.num))
        self.codes = np.frombuffer(record["codes"], dtype=np.int32).reshape(n, len(layout.cat))
        self.label = np.frombuffer(record["label"])
        self.times = np.frombuffer(record["times"], dtype=np.uint8).reshape(n, sets)


def _blocks(batches, layout: Layout, sets: int):
    for batch in batches:
        for record in batch.to_pylist():
            yield _Rows(layout, sets, record)


def _sums_by(code: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows of ``times`` by code (size x sets)."""
    out = np.zeros((size, times.shape[1]))
    order = np.argsort(code, kind="stable")
    at = np.flatnonzero(np.append(True, np.diff(code[order]) > 0)) if len(code) else np.zeros(0, dtype=np.int64)
    if len(at):
        out[code[order][at]] = np.add.reduceat(times[order].astype(np.float64), at, axis=0)
    return out


def _statistics(layout: Layout, sets: int):
    """Counts by class, of each level and of missing numbers, and centered moments of numbers, for every set."""
    def run(batches):
        p = len(layout.num)
        classes = np.zeros((2, sets))
        moments = np.zeros((3, p, sets))
        levels = [np.zeros((len(v) + 2, sets)) for v in layout.levels]
        for b in _blocks(batches, layout, sets):
            t = b.times.astype(np.float64)
            classes += np.array([t[b.label != 1].sum(axis=0), t[b.label == 1].sum(axis=0)])
            here = ~np.isnan(b.num)
            x = np.where(here, b.num - layout.center, 0.0)
            moments += np.array([here.astype(np.float64).T @ t, x.T @ t, (x * x).T @ t])
            for k, own in enumerate(levels):
                own += _sums_by(b.codes[:, k], b.times, len(own))
        yield _part(0, classes)
        yield _part(1, moments)
        for k, own in enumerate(levels):
            yield _part(2 + k, own)
    return run


def _count_ranges(layout: Layout, sets: int, cuts: dict[int, np.ndarray]):
    """Rows of each set by where their value's key lies among a column's cuts."""
    def run(batches):
        out = {j: np.zeros((len(keys) + 1, sets)) for j, keys in cuts.items()}
        for b in _blocks(batches, layout, sets):
            for j, keys in cuts.items():
                here = ~np.isnan(b.num[:, j])
                out[j] += _sums_by(np.searchsorted(keys, _keys(b.num[here, j]), side="right"), b.times[here], len(keys) + 1)
        for j, own in out.items():
            yield _part(j, own)
    return run


def _list_values(layout: Layout, sets: int, ranges: dict[int, list[tuple[int, int]]]):
    """Distinct values inside the ranges (low key included, high not) with each set's rows."""
    def run(batches):
        for b in _blocks(batches, layout, sets):
            for j, own in ranges.items():
                here = ~np.isnan(b.num[:, j])
                keys, times = _keys(b.num[here, j]), b.times[here]
                inside = np.zeros(len(keys), dtype=bool)
                for low, high in own:
                    inside |= (keys >= np.uint64(low)) & (keys < np.uint64(high))
                if inside.any():
                    found, code = np.unique(keys[inside], return_inverse=True)
                    sums = _sums_by(code, times[inside], len(found))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), j), pa.int32()), pa.array(found.view(np.int64)), pa.array([r.tobytes() for r in sums], pa.binary())],
                                                     names=["j", "value", "part"])
    return run


def _add_values(batches):
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for r in batch.to_pylist():
            key, x = (r["j"], r["value"]), np.frombuffer(r["part"])
            total[key] = total[key] + x if key in total else x
    rows = list(total.items())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([j for (j, _), _ in rows], pa.int32()), pa.array([v for (_, v), _ in rows], pa.int64()),
                                          pa.array([x.tobytes() for _, x in rows], pa.binary())], names=["j", "value", "part"])


# ---------------------------------------------------------------- what a set's preprocessing is

@dataclass
class Prepared:
    """The preprocessing of every set, as matrices from raw columns to slots (the last slot is the intercept)."""

    maps: np.ndarray  # sets x (slots + 1) x raw columns
    slots: list[tuple[int, str, str, str | None]]
    size: np.ndarray  # rows of each set
    classes: np.ndarray  # 2 x sets
    medians: np.ndarray  # sets x numbers
    rows: np.ndarray  # numbers x sets: rows with a value
    goes: list[list[list[int | None]]]  # of each set and text column: the level slot of every code

    def balance(self, balanced: bool) -> np.ndarray:
        """Class weights (sets x 2): rows / (2 x rows of the class), or 1; 0 for a set with one class."""
        both = (self.classes > 0).all(axis=0)
        weight = np.where(both, self.size / np.maximum(2 * self.classes, 1e-300), 0.0).T
        return weight if balanced else (weight > 0).astype(np.float64)


@dataclass
class Design:
    """A set's features that are not linear in the raw values: bins or splines of imputed numbers, and its level slots."""

    set: int
    medians: np.ndarray
    bins: list[np.ndarray] | None  # inner edges of each number's bins
    knots: tuple[int, np.ndarray, np.ndarray] | None  # number of knots, least and greatest values
    goes: list[np.ndarray]  # slot of each code, -1 for none
    width: int  # slots without the intercept

    def matrix(self, num: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Features and a constant."""
        n = len(codes) if len(self.goes) else len(num)
        z = np.zeros((n, self.width + 1))
        z[:, -1] = 1.0
        rows, at = np.arange(n), 0
        x = np.where(np.isnan(num), self.medians, num)
        for j in range(num.shape[1]):
            if self.bins is not None:
                z[rows, at + np.searchsorted(self.bins[j], x[:, j], side="right")] = 1.0
                at += len(self.bins[j]) + 1
            else:
                k, low, high = self.knots[0], self.knots[1][j], self.knots[2][j]
                h = (high - low) / (k - 1) if high > low else 1.0
                u = (np.clip(x[:, j], low, high) - low) / h
                for s in range(k + 1):
                    z[:, at + s] = _cubic(u - (s - 3))
                at += k + 1
        for goes, code in zip(self.goes, codes.T, strict=True):
            slot = goes[code]
            z[rows[slot >= 0], at + slot[slot >= 0]] = 1.0
        return z


def _cubic(u: np.ndarray) -> np.ndarray:
    """Uniform cubic B-spline with support [0, 4]."""
    v = np.abs(u - 2.0)
    return np.where(v < 1, (4 - 6 * v * v + 3 * v ** 3) / 6, np.where(v < 2, (2 - np.minimum(v, 2.0)) ** 3 / 6, 0.0))


@dataclass
class LinearFit:
    """Coefficients by slot, the intercept, and the weights of raw columns that they amount to."""

    set: int
    coef: np.ndarray
    intercept: float
    raw: np.ndarray | None
    steps: int
    design: Design | None = None


class Batch:
    """Rows and training sets that fits are made on."""

    def __init__(self, layout: Layout, sets: int, packed: DataFrame, path: str, prepared: Prepared, tasks: int, cuts: dict[int, np.ndarray]):
        self.layout, self.sets, self.packed, self.path, self.prepared, self.tasks, self.cuts = layout, sets, packed, path, prepared, tasks, cuts

    @classmethod
    def prepare(cls, df: DataFrame, cat_cols: Sequence[str], num_cols: Sequence[str], times: Column | None, sets: int, min_freq: float = 0.01,
                draws: tuple[int, float] | None = None, id_col: str = "_id", least: float | None = None) -> Batch:
        """``df`` has ``label`` (0 or 1) and the raw columns.  A row's counts in the sets are the array ``times``, or
        those of ``sets`` hashed bootstrap draws of (seed, frac) ``draws`` by ``id_col``."""
        cat_cols, num_cols = list(cat_cols), list(num_cols)
        n, levels, center, cuts = _dictionary(df, cat_cols, num_cols, times, sets, min_freq, draws, least)
        layout = Layout(num_cols, cat_cols, levels, center)
        own = F.lit(None).cast("string").alias("_key") if draws is None else c(id_col).cast("string").alias("_key")
        src = df.select(*raw_columns(cat_cols, num_cols), c("label").cast("double").alias("label"), own, *([] if times is None else [times.alias("_times")]))
        path = scratch_path(df.sparkSession, "packed-rows")
        # every pass is work on all cores: a small table is spread too, a large one keeps its tasks long
        tasks = max(min(-(-n // SMALL), 2 * df.sparkSession.sparkContext.defaultParallelism), -(-n // LARGE), 1)
        src.repartition(tasks).mapInArrow(_pack(layout, sets, draws), _BLOCK).write.parquet(path)
        packed = df.sparkSession.read.schema(_BLOCK).parquet(path)
        found = _summed(packed.mapInArrow(_statistics(layout, sets), _PARTS))
        shapes = [(2, sets), (3, len(num_cols), sets), *((len(v) + 2, sets) for v in levels)]
        stats = [found[k].reshape(shape) if k in found else np.zeros(shape) for k, shape in enumerate(shapes)]
        rows = stats[0].sum(axis=0)
        if draws is not None and least is None and rows.size and rows.min() < rows.mean() / 2:  # a draw smaller than the levels were listed for
            remove_scratch(df.sparkSession, path)
            return cls.prepare(df, cat_cols, num_cols, times, sets, min_freq, draws, id_col, float(rows.min()))
        medians = weighted_medians(packed, layout, sets, stats[1][0], cuts)
        return cls(layout, sets, packed, path, _prepared(layout, stats, medians, min_freq), tasks, cuts)

    def discard(self) -> None:
        remove_scratch(self.packed.sparkSession, self.path)

    def fit(self, fits: Sequence[tuple[int, float, float]], balanced: bool = True) -> list[LinearFit | None]:
        """Solves all (set, C, l1_ratio) on standardized numbers and levels; None for a set with one class only."""
        prep = self.prepared
        which = np.array([t for t, _, _ in fits], dtype=np.int64)
        weight = prep.balance(balanced)
        a, e = self.layout.pairs()
        d = self.layout.width

        def curves(live: np.ndarray, b: np.ndarray, source: np.ndarray):
            # fits of a set with the same coefficients are worked through once, curvatures only where one is used
            _, first, place = np.unique(np.column_stack([which[live], b]), axis=0, return_index=True, return_inverse=True)
            place, own = place.ravel(), live[first]
            bent, used = np.unique(place[source], return_inverse=True)
            maps = prep.maps[which[own]]
            raw = np.einsum("bs,bsd->bd", b[first], maps)
            found = _summed(self.packed.mapInArrow(_curves(self.layout, self.sets, raw, which[own], weight[which[own]], bent), _PARTS))
            loss, grad = np.array([found[k][0] for k in range(len(own))]), np.array([found[k][1: 1 + d] for k in range(len(own))])
            full = np.zeros((len(bent), d, d))
            full[:, a, e] = full[:, e, a] = np.array([found[k][1 + d:] for k in bent])
            curve = maps[bent] @ full @ maps[bent].transpose(0, 2, 1)
            return loss[place], np.einsum("bsd,bd->bs", maps, grad)[place], curve[used.ravel()]

        usable = (weight[which] > 0).all(axis=1) if len(fits) else np.zeros(0, dtype=bool)
        b, steps = _solve(curves, [f[1:] for f in fits], prep.maps.shape[1], usable, which)
        raw = np.einsum("bs,bsd->bd", b, prep.maps[which]) if len(fits) else b
        return [LinearFit(int(which[k]), b[k, :-1], float(b[k, -1]), raw[k], int(steps[k])) if usable[k] else None for k in range(len(fits))]

    def fit_designs(self, fits: Sequence[tuple[Design, float]], balanced: bool) -> list[LinearFit | None]:
        """Solves all (design, C) with a ridge penalty; None for a set with one class only."""
        weight = self.prepared.balance(balanced)
        width = max((f.width for f, _ in fits), default=0) + 1
        slots = [np.append(np.arange(f.width), width - 1) for f, _ in fits]

        def curves(live: np.ndarray, b: np.ndarray, _source: np.ndarray):
            work = [(fits[k][0], b[i][slots[k]], weight[fits[k][0].set]) for i, k in enumerate(live)]
            found = _summed(self.packed.mapInArrow(_design_curves(self.layout, self.sets, work), _PARTS))
            loss, grad, curve = np.zeros(len(live)), np.zeros((len(live), width)), np.zeros((len(live), width, width))
            for i, k in enumerate(live):
                own, n = found[i], len(slots[k])
                loss[i], grad[i, slots[k]] = own[0], own[1: 1 + n]
                curve[i][np.ix_(slots[k], slots[k])] = own[1 + n:].reshape(n, n)
            return loss, grad, curve

        usable = np.array([bool((weight[f.set] > 0).all()) for f, _ in fits], dtype=bool)
        b, steps = _solve(curves, [(cost, 0.0) for _, cost in fits], width, usable)
        return [LinearFit(f.set, b[k, : f.width], float(b[k, -1]), None, int(steps[k]), f) if usable[k] else None for k, (f, _) in enumerate(fits)]

    def binned(self, max_bins: int) -> list[Design]:
        """Each set's quantile bins of its imputed numbers, and its levels."""
        prep, wanted, spot = self.prepared, {}, {}
        for j in self.cuts:
            for t in range(self.sets):
                n, size = int(prep.rows[j, t]), int(prep.size[t])
                if n:
                    # imputed values stand behind the lower middle one
                    ranks = [max(0, -(-i * size // max_bins) - 1) for i in range(1, max_bins)]
                    spot[j, t] = [r if r <= (n - 1) // 2 else None if r <= (n - 1) // 2 + size - n else r - (size - n) for r in ranks]
                    wanted[j, t] = [r for r in spot[j, t] if r is not None]
        found = order_statistics(self.packed, self.layout, self.sets, wanted, self.cuts)
        edges = lambda j, t: np.unique([prep.medians[t, j] if r is None else found[j, t, r] for r in spot.get((j, t), [])])
        return [self._design(t, [edges(j, t) for j in range(len(self.layout.num))], None) for t in range(self.sets)]

    def splined(self, n_knots: int) -> list[Design]:
        """Each set's spline basis between its least and greatest values, and its levels."""
        prep = self.prepared
        ends = {(j, t): [0, int(prep.rows[j, t]) - 1] for j in self.cuts for t in range(self.sets) if prep.rows[j, t]}
        found = order_statistics(self.packed, self.layout, self.sets, ends, self.cuts)
        at = lambda t, k: np.array([found.get((j, t, ends[j, t][k]), 0.0) if (j, t) in ends else 0.0 for j in range(len(self.layout.num))])
        return [self._design(t, None, (n_knots, at(t, 0), at(t, 1))) for t in range(self.sets)]

    def _design(self, t: int, bins, knots) -> Design:
        slots = sum(len(x) + 1 for x in bins) if bins is not None else (knots[0] + 1) * len(self.layout.num)
        goes = [np.array([-1 if x is None else x for x in own]) for own in self.prepared.goes[t]]
        levels = 1 + max((x for own in self.prepared.goes[t] for x in own if x is not None), default=-1)
        return Design(t, np.nan_to_num(self.prepared.medians[t]), bins, knots, goes, slots + levels)

    def score(self, df: DataFrame, fits: Sequence[LinearFit | None], keep: Sequence[str], groups: Column, per_group: int) -> DataFrame:
        """(keep..., _group, _fit, prob): every row of ``df`` under the fits of each group in its array ``groups``.

        Group g holds fits g * per_group to (g + 1) * per_group - 1; rows of fits that are None are left out.
        """
        fields = [f for f in df.select(*[c(k) for k in keep]).schema.fields]
        src = df.select(*[c(k) for k in keep], *raw_columns(self.layout.cat, self.layout.num), groups.alias("_groups"))
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        return src.repartition(self.tasks).mapInArrow(_scores(self.layout, Margins(fits), [f.name for f in fields], per_group), f"{ddl}, _group int, _fit int, prob double")

    def aucs(self, df: DataFrame, fits: Sequence[LinearFit | None], groups: Column, per_group: int, label: str = "label", bucket: int = BUCKET) -> dict[int, float | None]:
        """Tie-aware AUROC of every fit over the rows of ``df`` in its group; None with one class or without the fit.

        Scores never travel as rows: tasks send each fit's distinct scores with class counts as arrays, dealt by (fit,
        bucket of scores).  Buckets are cut by counts of ever finer parts of the score range until each holds at
        most ``bucket`` rows or one score, so no task holds more however a fit's scores crowd.
        """
        src = df.select(c(label).cast("double").alias("_label"), *raw_columns(self.layout.cat, self.layout.num), groups.alias("_groups")).filter("_label is not null").repartition(self.tasks)
        return _rank(src, _row_scores(self.layout, Margins(fits), per_group), len(fits), bucket)

    def held_aucs(self, fits: Sequence[LinearFit | None], held: Sequence[tuple[int, int]], per_group: int, bucket: int = BUCKET) -> dict[int, float | None]:
        """``aucs`` over the packed rows: group g is the rows of set ``held[g][0]`` (-1: of all) that are not in set ``held[g][1]``."""
        return _rank(self.packed, _packed_scores(self.layout, self.sets, Margins(fits), held, per_group), len(fits), bucket)


def _rank(src: DataFrame, scored, n: int, bucket: int) -> dict[int, float | None]:
    """AUROC of ``n`` fits by what ``scored`` makes of a task's batches, see ``Batch.aucs``."""
    edges = {k: _keys(np.arange(CUTS) / CUTS) for k in range(n)}  # the first key of each part
    split = dict(edges)
    counts: dict[int, np.ndarray] = {}
    while split:
        count = _count_scores(scored, {k: edges[k] for k in split}) if counts else _count_parts(scored, n)
        found = _summed(src.mapInArrow(count, _PARTS))
        counts.update({k: found[k].reshape(-1, 2) if k in found else np.zeros((len(edges[k]), 2)) for k in split})
        split = {}
        for k, own in counts.items():
            upper = np.append(edges[k][1:], _keys(np.array([1.0])) + np.uint64(1))
            wide = np.flatnonzero((own.sum(axis=1) > bucket) & (upper - edges[k] > 1))
            if len(wide):
                inner = {int(edges[k][i]) + int(upper[i] - edges[k][i]) * s // SPLIT for i in wide for s in range(SPLIT)}
                split[k] = edges[k] = np.array(sorted(inner | {int(x) for x in edges[k]}), dtype=np.uint64)
    # neighbouring parts are one bucket as long as they hold ``bucket`` rows together
    starts, below = {}, {}
    for k, own in counts.items():
        at, rows = [0], 0
        for i, more in enumerate(own.sum(axis=1)):
            if rows and rows + more > bucket:
                at.append(i)
                rows = 0
            rows += more
        starts[k] = edges[k][at]
        total = np.concatenate([np.zeros((1, 2)), np.cumsum(own, axis=0)])
        below[k] = total[at]
    parts = src.mapInArrow(_send(scored, starts), _SCORES)
    wins = parts.repartition("fit", "bucket").sortWithinPartitions("fit", "bucket").mapInArrow(_wins, "fit int, bucket int, pos double, wins double").collect()  # one row a bucket
    u = dict.fromkeys(range(n), 0.0)
    for r in wins:
        u[r["fit"]] += r["wins"] + r["pos"] * below[r["fit"]][r["bucket"], 0]
    out: dict[int, float | None] = {}
    for k in range(n):
        neg, pos = counts[k].sum(axis=0)
        out[k] = u[k] / (neg * pos) if neg and pos else None
    return out


def _dictionary(df: DataFrame, cat_cols, num_cols, times, sets, min_freq, draws, least=None):
    """The number of rows, levels that can be kept in some set of ``least`` rows or more, a center for each number, and cuts of its values' range.

    Each text column's most frequent level is listed too; modes are looked for among listed levels.
    """
    from .stability import poisson_thresholds

    aggs = [F.count(F.lit(1)).alias("n")]
    counted = df
    if times is not None:
        # a row's counts once, not once a set
        counted = df.select(*[c(n) for n in dict.fromkeys(num_cols)], times.alias("_times"))
        aggs += [F.sum(F.get("_times", F.lit(t)).cast("long")).alias(f"t{t}") for t in range(sets)]
    for k, n in enumerate(num_cols):
        x = F.nanvl(c(n).cast("double"), F.lit(None).cast("double"))
        aggs.append(F.percentile_approx(x, [i / SPLIT for i in range(SPLIT + 1)], 1000).alias(f"q{k}"))
    row = counted.agg(*aggs).first()
    n = row["n"] or 0
    # a level kept in a set has min_freq of its rows, copies counted
    if least is None:
        least = min((row[f"t{t}"] or 0 for t in range(sets)), default=0) if times is not None else n * draws[1] / 2
    need = min_freq * least / (1 if draws is None else len(poisson_thresholds(draws[1])))
    levels: list[list[str]] = [[] for _ in cat_cols]
    if cat_cols:
        cells = [F.struct(F.lit(k).alias("k"), c(name).cast("string").alias("value")) for k, name in enumerate(cat_cols)]
        counts = df.select(F.inline(F.array(*cells))).filter("value is not null").groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"))
        top = counts.groupBy("k").agg(F.max_by("value", F.struct("n", "value")).alias("value"), F.max("n").alias("n"))
        for r in counts.filter(c("n") >= F.lit(need)).unionByName(top.select("k", "value", "n")).distinct().collect():
            levels[r["k"]].append(r["value"])
    quantiles = [[v for v in (row[f"q{k}"] or []) if v is not None] for k in range(len(num_cols))]
    center = np.array([q[len(q) // 2] if q else 0.0 for q in quantiles])
    # a value's range ends right after it: one that many rows have is found by the first count
    cuts = {k: np.unique(_keys(np.array(q))[:, None] + np.arange(2, dtype=np.uint64)) for k, q in enumerate(quantiles) if q}
    return n, [sorted(set(v)) for v in levels], center, cuts


def weighted_medians(packed: DataFrame, layout: Layout, sets: int, rows: np.ndarray, cuts: dict[int, np.ndarray]) -> np.ndarray:
    """Exact medians (sets x numbers) of the sets' rows; NaN where a set has no value."""
    middle = {(j, t): [int(rows[j, t] - 1) // 2, int(rows[j, t]) // 2] for j in cuts for t in range(sets) if rows[j, t]}
    found = order_statistics(packed, layout, sets, middle, cuts)
    out = np.full((sets, len(layout.num)), np.nan)
    for (j, t), (low, high) in middle.items():
        a, b = found[j, t, low], found[j, t, high]
        out[t, j] = a + (b - a) * 0.5
    return out


def order_statistics(packed: DataFrame, layout: Layout, sets: int, wanted: dict[tuple[int, int], list[int]], cuts: dict[int, np.ndarray]) -> dict[tuple[int, int, int], float]:
    """Exact values at ranks (from 0) of a number's values in a set: {(number, set, rank): value}.

    Each pass counts the rows of every set between cuts of the value range and keeps the ranges that hold a wanted
    rank, until these are short enough to list their values.  The first cuts are a sketch's; wrong ones only cost another pass.
    """
    ranks = {(j, t, r) for (j, t), own in wanted.items() for r in own}
    found: dict[tuple[int, int, int], float] = {}
    top = (1 << 64) - 1  # above every key of a number
    open_ranges: dict[int, list[tuple[int, int]]] = {j: [(0, top)] for j in {j for j, _, _ in ranks}}
    first = True
    while open_ranges:
        at = {}
        for j, own in open_ranges.items():
            if first:
                at[j] = cuts[j]
            else:
                inner = {low + (high - low) * s // SPLIT for low, high in own for s in range(SPLIT + 1)}
                at[j] = np.array(sorted(x for x in inner if 0 < x < top), dtype=np.uint64)
        counts = {j: x.reshape(-1, sets) for j, x in _summed(packed.mapInArrow(_count_ranges(layout, sets, at), _PARTS)).items()}
        listed: dict[int, dict[tuple[int, int], np.ndarray]] = {}  # range: rows of each set below it
        split: dict[int, list[tuple[int, int]]] = {}
        for j, t, r in sorted(ranks - found.keys()):
            below = np.concatenate([[0.0], np.cumsum(counts[j][:, t])])
            k = int(np.searchsorted(below[1:], r, side="right"))
            part = (int(at[j][k - 1]) if k else 0, int(at[j][k]) if k < len(at[j]) else top)
            if part[1] - part[0] <= 1:
                found[j, t, r] = float(_values(np.array([part[0]], dtype=np.uint64))[0])
            elif counts[j][k].max() <= EXACT:
                listed.setdefault(j, {})[part] = counts[j][:k].sum(axis=0)
            elif part not in split.setdefault(j, []):
                split[j].append(part)
        if listed:
            parts = packed.mapInArrow(_list_values(layout, sets, {j: list(own) for j, own in listed.items()}), "j int, value bigint, part binary")
            values: dict[int, list] = {}
            for r in parts.repartition("j", "value").mapInArrow(_add_values, "j int, value bigint, part binary").collect():  # ``EXACT`` rows of a set a range at most
                values.setdefault(r["j"], []).append((np.int64(r["value"]).view(np.uint64), np.frombuffer(r["part"])))
            for j, own in listed.items():
                here = sorted(values[j], key=lambda x: x[0])
                keys, weight = np.array([k for k, _ in here], dtype=np.uint64), np.array([w for _, w in here])
                for (low, high), below in own.items():
                    lo, hi = int(np.searchsorted(keys, np.uint64(low))), int(np.searchsorted(keys, np.uint64(high)))
                    upto = below + np.cumsum(weight[lo:hi], axis=0)
                    for jj, t, r in ranks:
                        if jj == j and below[t] <= r and hi > lo and upto[-1, t] > r:
                            found[j, t, r] = float(_values(keys[lo + int(np.searchsorted(upto[:, t], r, side="right"))][None])[0])
        open_ranges, first = split, False
    return found


def _prepared(layout: Layout, stats: list[np.ndarray], medians: np.ndarray, min_freq: float) -> Prepared:
    classes, moments, levels = stats[0], stats[1], stats[2:]
    sets, p = classes.shape[1], len(layout.num)
    size = classes.sum(axis=0)
    names = [sorted({*v, OTHER}) for v in layout.levels]
    slots: list[tuple[int, str, str, str | None]] = [(j, n, n, None) for j, n in enumerate(layout.num)]
    for column, own in zip(layout.cat, names, strict=True):
        slots += [(len(slots) + k, f"{column}={lv}", column, lv) for k, lv in enumerate(own)]
    maps = np.zeros((sets, len(slots) + 1, layout.width))
    const = 2 * p
    maps[:, -1, const] = 1.0
    where: list[list[list[int | None]]] = [[[None] * (len(v) + 2) for v in layout.levels] for _ in range(sets)]
    for t in range(sets):
        if not size[t]:
            continue
        for j in range(p):
            n, s, ss = moments[:, j, t]
            m = medians[t, j]
            if not n:
                continue
            mean, gone = s / n, size[t] - n
            var = max(ss / n - mean * mean, 0.0)
            d = m - layout.center[j]  # the imputed value against the center
            all_mean = (n * mean + gone * d) / size[t]
            all_var = (n * (var + (mean - all_mean) ** 2) + gone * (d - all_mean) ** 2) / size[t]
            std = np.sqrt(max(all_var, 0.0))
            if std:
                maps[t, j, j], maps[t, j, const], maps[t, j, p + j] = 1.0 / std, -all_mean / std, d / std
        first = p
        for k, at in enumerate(layout.starts()):
            own, count = layout.levels[k], levels[k][:, t]
            known, rest, null = count[: len(own)], count[len(own)], count[len(own) + 1]
            seen = known.max(initial=0) > 0 or rest > 0
            mode = int(np.argmax(known)) if known.max(initial=0) > 0 else None  # the first of the most frequent, in order of the alphabet
            kept = [known[x] + (null if x == mode else 0) >= min_freq * size[t] for x in range(len(own))]
            place = {lv: first + x for x, lv in enumerate(names[k])}
            has_other = rest > 0 or any(known[x] > 0 and not kept[x] for x in range(len(own)))
            other = place[OTHER] if has_other or any(kept[x] and own[x] == OTHER for x in range(len(own))) else None
            goes = [place[own[x]] if kept[x] else other for x in range(len(own))] + [other]
            goes.append(None if not seen else goes[mode] if mode is not None else other)
            where[t][k] = [None if slot is None else slot - p for slot in goes]
            for x, slot in enumerate(goes):
                if slot is not None:
                    maps[t, slot, at + x] = 1.0
            first += len(names[k])
    return Prepared(maps, slots, size, classes, medians, moments[0], where)


# ---------------------------------------------------------------- iterations

def _runs(b: _Rows, sets: np.ndarray) -> list[tuple[slice, bool]]:
    """Parts of a block, and whether all rows of a part have one label and the same count in each of ``sets``."""
    n = len(b.label)
    positive, times = b.label == 1, b.times[:, sets]
    at = np.append(np.flatnonzero(np.append(True, (positive[1:] != positive[:-1]) | (times[1:] != times[:-1]).any(axis=1))), n)
    alike = n >= RUN * (len(at) - 1)
    ends = list(zip(at, at[1:], strict=False)) if alike else [(0, n)]
    return [(slice(lo, min(lo + ROWS, end)), alike) for start, end in ends for lo in range(start, end, ROWS)]


def _logistic(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """1 + exp(-s), slope and exp(-s) of the log loss at margins ``s`` (clipped in place) towards the wrong class; the loss is
    s + log(1 + exp(-s)), the curvature exp(-s) slope^2."""
    np.maximum(s, -500.0, out=s)
    h = np.exp(-s)
    rest = 1.0 + h
    return rest, np.reciprocal(rest), h


def _loss_sums(s: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Sums over rows of s + log(rest), by the logarithm of a product (of ``ROWS`` numbers at most) where that is in range."""
    with np.errstate(over="ignore"):
        product = np.multiply.reduce(rest, axis=0)
    return s.sum(axis=0) + (np.log(product) if np.isfinite(product).all() else np.log(rest).sum(axis=0))


def _curves(layout: Layout, sets: int, raw: np.ndarray, which: np.ndarray, balance: np.ndarray, bent: np.ndarray):
    """Every fit's loss and gradient, and the curvature of those in ``bent``, over the raw columns, summed over a task's rows.

    Rows of one label that are in the same sets have one weight in each fit; fits whose set lacks them pass them by.
    """
    def run(batches):
        fits, d = raw.shape
        a, e = layout.pairs()
        used = np.unique(which)
        loss, grad, curve = np.zeros(fits), np.zeros((fits, d)), np.zeros((len(bent), len(a)))
        place = np.full(fits, -1)
        place[bent] = np.arange(len(bent))
        seen = False
        for b in _blocks(batches, layout, sets):
            seen = seen or len(b.label) > 0
            for part, alike in _runs(b, used):
                y = b.label[part] == 1
                if alike:
                    own = np.flatnonzero(b.times[part.start, which])
                    if not len(own):
                        continue
                    w = b.times[part.start, which[own]] * balance[own, int(y[0])]
                else:
                    own = np.arange(fits)
                    w = b.times[part][:, which] * np.where(y[:, None], balance[:, 1], balance[:, 0])
                z = layout.matrix(b.num[part], b.codes[part])
                z[y] *= -1.0  # towards the wrong class
                m = z @ raw[own].T
                rest, slope, h = _logistic(m)
                at = np.flatnonzero(place[own] >= 0)
                to = place[own[at]]
                if len(at) < len(own):
                    h = h[:, at] * slope[:, at] ** 2
                else:
                    h *= slope
                    h *= slope
                if alike:
                    loss[own] += w * _loss_sums(m, rest)
                else:
                    m += np.log(rest)
                    loss += np.einsum("ij,ij->j", w, m)
                    slope *= w
                    h *= w[:, at]
                    w = np.ones(fits)
                grad[own] += w[:, None] * (slope.T @ z)
                if len(at) <= FEW:
                    for i, k in enumerate(at):
                        curve[to[i]] += w[k] * (z.T @ (z * h[:, i: i + 1]))[a, e]
                else:
                    columns = np.ascontiguousarray(z.T)
                    curve[to] += w[at, None] * (h.T @ (columns[a] * columns[e]).T)  # products of columns once for all fits
        if seen:
            for k in range(fits):
                yield _part(k, np.concatenate([loss[k: k + 1], grad[k], curve[place[k]] if place[k] >= 0 else curve[:0].ravel()]))
    return run


class _Steps:
    """A binned design's features as codes: one slot of each feature is 1 in a row (``-1`` in ``slots``: none)."""

    def __init__(self, design: Design, union: list[np.ndarray]):
        self.lookup, self.slots, at = [], [], 0
        for j, edges in enumerate(design.bins):
            # bins of the parts between the cuts of all designs; the last entry is that of a missing number
            self.lookup.append(np.searchsorted(edges, np.concatenate([[-np.inf], union[j], design.medians[j: j + 1]]), side="right"))
            self.slots.append(at + np.arange(len(edges) + 1))
            at += len(edges) + 1
        self.slots += [np.where(goes >= 0, at + goes, -1) for goes in design.goes]

    def codes(self, parts: list[np.ndarray], levels: np.ndarray) -> list[np.ndarray]:
        return [table[own] for table, own in zip(self.lookup, parts, strict=True)] + [levels[:, k].astype(np.int64) for k in range(levels.shape[1])]

    def add(self, out: np.ndarray, codes: list[np.ndarray], b: np.ndarray, sign: np.ndarray, w: np.ndarray) -> None:
        """Adds loss, gradient and curvature of coefficients ``b``: sums by code and by pair of codes."""
        n = len(b)
        known = np.append(b[:-1], 0.0)  # without a slot: 0
        m = np.full(len(sign), b[-1])
        for own, slots in zip(codes, self.slots, strict=True):
            m += known[slots][own]
        m *= sign
        rest, slope, h = _logistic(m)
        h *= slope
        h *= slope
        slope *= w * sign
        h *= w
        grad, curve = np.zeros(n + 1), np.zeros((n + 1, n + 1))  # the last is for rows without a slot
        grad[n - 1], curve[n - 1, n - 1] = slope.sum(), h.sum()
        for f, (own, slots) in enumerate(zip(codes, self.slots, strict=True)):
            at = np.where(slots >= 0, slots, n)
            np.add.at(grad, at, np.bincount(own, weights=slope, minlength=len(at)))
            once = np.bincount(own, weights=h, minlength=len(at))
            np.add.at(curve, (at, at), once)
            np.add.at(curve, (at, n - 1), once)
            np.add.at(curve, (n - 1, at), once)
            for g in range(f):
                other = np.where(self.slots[g] >= 0, self.slots[g], n)
                both = np.bincount(own * len(other) + codes[g], weights=h, minlength=len(at) * len(other)).reshape(len(at), len(other))
                np.add.at(curve, (at[:, None], other[None, :]), both)
                np.add.at(curve, (other[:, None], at[None, :]), both.T)
        out[0] += w @ (m + np.log(rest))
        out[1: 1 + n] += grad[:n]
        out[1 + n:] += curve[:n, :n].ravel()


def _design_curves(layout: Layout, sets: int, work: list[tuple[Design, np.ndarray, np.ndarray]]):
    """Loss, gradient and curvature of fits on designs, summed over a task's rows; a design's features are made once for its fits."""
    by_design: dict[int, list[int]] = {}
    for k, (design, _, _) in enumerate(work):
        by_design.setdefault(id(design), []).append(k)
    groups = list(by_design.values())
    binned = [work[group[0]][0] for group in groups if work[group[0]][0].bins is not None]
    union = [np.unique(np.concatenate([d.bins[j] for d in binned])) for j in range(len(layout.num))] if binned else []

    def run(batches):
        out = [np.zeros(1 + len(b) + len(b) ** 2) for _, b, _ in work]
        steps = [None if work[group[0]][0].bins is None else _Steps(work[group[0]][0], union) for group in groups]
        seen = False
        for rows in _blocks(batches, layout, sets):
            y = rows.label == 1
            cut = [np.where(np.isnan(rows.num[:, j]), len(cuts) + 1, np.searchsorted(cuts, rows.num[:, j], side="right")) for j, cuts in enumerate(union)]
            for group, step in zip(groups, steps, strict=True):
                design = work[group[0]][0]
                own = np.flatnonzero(rows.times[:, design.set])
                size = ROWS if step is None else max(1, len(own))
                for lo in range(0, len(own), size):
                    part = own[lo: lo + size]
                    sign = np.where(y[part], -1.0, 1.0)
                    z = step.codes([x[part] for x in cut], rows.codes[part]) if step else design.matrix(rows.num[part], rows.codes[part])
                    for k in group:
                        _, b, weight = work[k]
                        w = rows.times[part, design.set] * np.where(y[part], weight[1], weight[0])
                        if step:
                            step.add(out[k], z, b, sign, w)
                            continue
                        n = len(b)
                        m = (z @ b) * sign
                        rest, slope, h = _logistic(m)
                        h *= slope
                        h *= slope
                        out[k][0] += w @ (m + np.log(rest))
                        out[k][1: 1 + n] += z.T @ (w * sign * slope)
                        out[k][1 + n:] += (z.T @ (z * (w * h)[:, None])).ravel()
            seen = True
        if seen:
            for k, own in enumerate(out):
                yield _part(k, own)
    return run


def _solve(curves, penalties: Sequence[tuple[float, float]], width: int, usable: np.ndarray, groups: np.ndarray | None = None, tol: float = 1e-8,
           max_steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Proximal Newton steps of all usable fits; ``curves(live, coefficients, source)`` gives their losses and gradients, and for each
    the curvature of the live fit ``source``.

    Fits of a group (one training set, other penalties) lie close together.  One of each is solved first and the others
    start from it; then they share one curvature, as long as each step is less than ``SHRINK`` of the one before.
    """
    n = len(penalties)
    l1 = np.array([ratio / cost for cost, ratio in penalties])
    l2 = np.array([(1.0 - ratio) / cost for cost, ratio in penalties])
    b = np.zeros((n, width))
    before, step, value, steps = b.copy(), np.zeros_like(b), np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    size = np.full(n, np.inf)
    alone = np.full(n, groups is None)  # takes its own curvature
    todo = np.flatnonzero(usable)
    lead = todo
    if groups is not None:
        # the one of middle penalty
        lead = np.array([sorted(own, key=lambda k: (l1[k] + l2[k], k))[len(own) // 2] for own in (todo[groups[todo] == g] for g in np.unique(groups[todo]))], dtype=np.int64)
    for live in (lead, np.setdiff1d(todo, lead)):
        if live is not lead:
            own = dict(zip(groups[lead].tolist(), lead.tolist(), strict=True)) if len(live) else {}
            for k in live:
                b[k] = b[own[int(groups[k])]]
        while len(live):
            source = np.arange(len(live))
            if groups is not None:
                first: dict[int, int] = {}
                for i, k in enumerate(live):
                    if not alone[k]:
                        source[i] = first.setdefault(int(groups[k]), i)
            loss, grad, curve = curves(live, b[live], source)
            slots = b[live][:, :-1]
            now = loss + l1[live] * np.abs(slots).sum(axis=1) + l2[live] / 2 * (slots ** 2).sum(axis=1)
            worse = now > value[live] + 1e-10 * np.abs(now)
            # a step that raised the objective is halved; the others go on from here
            halve, on, good = live[worse], live[~worse], ~worse
            step[halve] /= 2
            b[halve] = before[halve] + step[halve]
            value[on] = now[good]
            step[on] = _newton_steps(grad[good], curve[good], b[on], l1[on], l2[on])
            before[on] = b[on]
            b[on] += step[on]
            steps[live] += 1
            last, size[live] = size[live], np.abs(step[live]).max(axis=1)
            alone[live] |= worse | (size[live] > SHRINK * last)
            live = live[(size[live] > tol) & (steps[live] < max_steps)]
    return b, steps


def _newton_steps(grad, curve, b, l1, l2, sweeps: int = 20, tol: float = 1e-11) -> np.ndarray:
    """The minimum of each fit's quadratic model plus penalty, as a step from ``b``; the last slot has no penalty.

    Some sweeps of coordinate descent over all fits at once find most signs, then each fit is solved
    exactly on its nonzero slots; slots without curvature (a set lacks them) stay.
    """
    fits, width = b.shape
    ridge = np.append(np.ones(width - 1), 0.0)
    lasso, ridge = l1[:, None] * ridge, l2[:, None] * ridge
    system = curve + np.einsum("bs,st->bst", ridge, np.eye(width))
    linear = grad - np.einsum("bst,bt->bs", curve, b)  # the model is v system v / 2 + linear v + lasso |v|
    diag = np.einsum("bss->bs", system)
    free = np.einsum("bss->bs", curve) > 1e-300
    v = b.copy()
    rest = np.flatnonzero((lasso > 0).any(axis=1))
    for _ in range(sweeps):
        if not len(rest):
            break
        moved = np.zeros(len(rest))
        for s in range(width):
            ok = free[rest, s]
            own = rest[ok]
            at = v[own, s]
            goal = diag[own, s] * at - linear[own, s] - (system[own, s] * v[own]).sum(axis=1)
            v[own, s] = np.sign(goal) * np.maximum(np.abs(goal) - lasso[own, s], 0.0) / diag[own, s]
            moved[ok] = np.maximum(moved[ok], np.abs(v[own, s] - at))
        rest = rest[moved > tol]
    for k in range(fits):
        own = free[k]
        v[k, own] = _signed_minimum(system[k][np.ix_(own, own)], linear[k, own], lasso[k, own], v[k, own])
    return v - b


def _signed_minimum(system: np.ndarray, linear: np.ndarray, lasso: np.ndarray, v: np.ndarray, most: int = 200) -> np.ndarray:
    """Minimum of v system v / 2 + linear v + sum(lasso |v|): solve for the nonzero slots with their signs, stop at the best
    point where a sign would change, take in the slot that violates its bound most, until none does."""
    value = lambda x: 0.5 * x @ system @ x + linear @ x + lasso @ np.abs(x)
    scale = 1e-10 * max(1.0, np.abs(linear).max(initial=0.0))
    hair = 1e-11 * max(np.diag(system).max(initial=0.0), 1e-300)
    sign = np.sign(v)
    for _ in range(most):
        active = np.flatnonzero((sign != 0) | (lasso == 0))
        goal = np.zeros_like(v)
        if len(active):
            # a hair of ridge: along a direction without curvature the goal lies far off, and a sign change ends the way to it
            a = system[np.ix_(active, active)] + np.diag(hair * (lasso[active] > 0))
            goal[active] = np.linalg.lstsq(a, -(linear[active] + lasso[active] * sign[active]), rcond=1e-15)[0]
        turned = [s for s in active if lasso[s] > 0 and goal[s] * sign[s] < 0]
        if turned:
            # the best of the goal and the points on the way where a slot is zero
            points = [goal]
            for s in turned:
                part = v[s] / (v[s] - goal[s])
                point = v + part * (goal - v)
                point[s] = 0.0
                points.append(point)
            v = min(points, key=value)
            sign = np.where(lasso > 0, np.sign(v), sign)
            continue
        v = goal
        slope = system @ v + linear
        out = np.where((sign == 0) & (lasso > 0), np.abs(slope) - lasso, -1.0)
        worst = int(np.argmax(out))
        if out[worst] <= scale:
            break
        sign[worst] = -np.sign(slope[worst])
    return v


class Margins:
    """The margins of fits for rows: one product for all fits on raw columns, one for each design."""

    def __init__(self, fits: Sequence[LinearFit | None]):
        self.n = len(fits)
        self.plain = [k for k, f in enumerate(fits) if f is not None and f.design is None]
        self.raw = np.array([fits[k].raw for k in self.plain]).T
        self.designs: list[tuple[Design, list[int], np.ndarray]] = []
        by_design: dict[int, list[int]] = {}
        for k, f in enumerate(fits):
            if f is not None and f.design is not None:
                by_design.setdefault(id(f.design), []).append(k)
        for own in by_design.values():
            self.designs.append((fits[own[0]].design, own, np.array([np.append(fits[k].coef, fits[k].intercept) for k in own]).T))

    def of(self, layout: Layout, num: np.ndarray, codes: np.ndarray, fits: slice | None = None) -> np.ndarray:
        """Margins (rows x fits) of the fits in a range, all by default; NaN for fits that are None."""
        fits = fits or slice(0, self.n)
        out = np.full((len(num), fits.stop - fits.start), np.nan)
        inside = lambda own: [i for i, k in enumerate(own) if fits.start <= k < fits.stop]
        if at := inside(self.plain):
            out[:, [self.plain[i] - fits.start for i in at]] = layout.matrix(num, codes) @ self.raw[:, at]
        for design, own, coef in self.designs:
            if at := inside(own):
                out[:, [own[i] - fits.start for i in at]] = design.matrix(num, codes) @ coef[:, at]
        return out


def _probabilities(layout: Layout, raw: Margins, per_group: int, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, fit, probability) of a batch's rows under the fits of their groups."""
    groups = batch.column(batch.schema.names.index("_groups"))
    row = pc.list_parent_indices(groups).to_numpy(zero_copy_only=False)
    group = pc.list_flatten(groups).to_numpy(zero_copy_only=False).astype(np.int64)
    margin = raw.of(layout, *layout.encode(batch))
    row, fit = np.repeat(row, per_group), (group[:, None] * per_group + np.arange(per_group)).ravel()
    m = margin[row, fit]
    ok = ~np.isnan(m)
    return row[ok], fit[ok], 1.0 / (1.0 + np.exp(-np.clip(m[ok], -500, 500)))


def _scores(layout: Layout, raw: Margins, keep: list[str], per_group: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            row, fit, prob = _probabilities(layout, raw, per_group, batch)
            kept = [batch.column(names.index(k)).take(pa.array(row)) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array((fit // per_group).astype(np.int32)), pa.array((fit % per_group).astype(np.int32)), pa.array(prob)],
                                             names=[*keep, "_group", "_fit", "prob"])
    return run


def _gathered(parts):
    """Lists of parts of ``GATHER`` rows together; ``parts`` are pairs of a part and its rows."""
    own, n = [], 0
    for part, rows in parts:
        if rows:
            own.append(part)
            n += rows
        if n >= GATHER:
            yield own
            own, n = [], 0
    if own:
        yield own


def _under(layout: Layout, raw: Margins, per_group: int, g: int, num: np.ndarray, codes: np.ndarray) -> tuple[int, np.ndarray]:
    """(first fit of a group, probabilities (fits x rows) under its fits)."""
    fits = slice(g * per_group, (g + 1) * per_group)
    margin = raw.of(layout, num, codes, fits)
    np.clip(margin, -500, 500, out=margin)
    np.negative(margin, out=margin)
    np.exp(margin, out=margin)
    margin += 1.0
    return fits.start, np.ascontiguousarray(np.reciprocal(margin, out=margin).T)


def _row_scores(layout: Layout, raw: Margins, per_group: int):
    """Scores of rows in their groups ``_groups``: (first fit, probabilities (fits x rows), which rows are positive)."""
    def run(batches):
        for gathered in _gathered((b, b.num_rows) for b in batches):
            batch = pa.Table.from_batches(gathered).combine_chunks().to_batches()[0]
            groups = batch.column(batch.schema.names.index("_groups"))
            row = pc.list_parent_indices(groups).to_numpy(zero_copy_only=False)
            group = pc.list_flatten(groups).to_numpy(zero_copy_only=False)
            label = batch.column(batch.schema.names.index("_label")).to_numpy(zero_copy_only=False) == 1
            num, codes = layout.encode(batch)
            for g in np.unique(group):
                own = row[group == g]
                yield *_under(layout, raw, per_group, int(g), num[own], codes[own]), label[own]
    return run


def _packed_scores(layout: Layout, sets: int, raw: Margins, held: Sequence[tuple[int, int]], per_group: int):
    """The same of packed rows, by the sets that they are in and not in."""
    def run(batches):
        for gathered in _gathered((b, len(b.label)) for b in _blocks(batches, layout, sets)):
            num, codes, label, times = (np.concatenate([getattr(b, name) for b in gathered]) for name in ("num", "codes", "label", "times"))
            known = ~np.isnan(label)
            for g, (within, without) in enumerate(held):
                own = np.flatnonzero(known & (times[:, without] == 0) & (within < 0 or times[:, within] > 0))
                if len(own):
                    yield *_under(layout, raw, per_group, g, num[own], codes[own]), label[own] == 1
    return run


def _by_fit(scored, batches):
    """(fit, keys of its negative rows' scores in order, those of its positive rows), of ``GATHER`` rows at a time."""
    for first, prob, y in scored(batches):
        for k, own in enumerate(prob):
            if not np.isnan(own[0]):  # a fit that is None gives NaN for all rows
                yield first + k, _keys(np.sort(own[~y])), _keys(np.sort(own[y]))


def _count_parts(scored, n: int):
    """Negative and positive rows of each of ``n`` fits in each of ``CUTS`` equal parts of the score range."""
    def run(batches):
        out = np.zeros((n, 2, CUTS))
        for first, prob, y in scored(batches):
            ok = np.flatnonzero(~np.isnan(prob[:, 0]))
            at = (prob[ok] * CUTS).astype(np.int64)  # exact: a power of two
            np.minimum(at, CUTS - 1, out=at)
            at += CUTS * y
            for k, own in zip(ok, at, strict=True):
                out[first + k] += np.bincount(own, minlength=2 * CUTS).reshape(2, CUTS)
        for k in np.flatnonzero(out.any(axis=(1, 2))):
            yield _part(int(k), out[k].T)
    return run


def _count_scores(scored, edges: dict[int, np.ndarray]):
    """Negative and positive rows of each fit in each part of the score range."""
    def run(batches):
        out = {k: np.zeros((len(own), 2)) for k, own in edges.items()}
        for fit, *keys in _by_fit(scored, batches):
            if fit in out:
                for k, own in enumerate(keys):
                    out[fit][:, k] += np.diff(np.append(np.searchsorted(own, edges[fit]), len(own)))
        for k, own in out.items():
            if own.any():
                yield _part(k, own)
    return run


_SCORES = "fit int, bucket int, positive boolean, keys binary, counts binary"


def _send_scores(layout: Layout, raw: Margins, per_group: int, starts: dict[int, np.ndarray]):
    """``_send`` of rows in their groups ``_groups``."""
    return _send(_row_scores(layout, raw, per_group), starts)


def _send(scored, starts: dict[int, np.ndarray]):
    """Each fit's scores of a class by bucket; with their rows where that is shorter than to repeat them."""
    def run(batches):
        for fit, *both in _by_fit(scored, batches):
            rows = []
            for positive, keys in zip((False, True), both, strict=True):
                at = np.append(np.searchsorted(keys, starts[fit]), len(keys))
                for b in np.flatnonzero(np.diff(at)):
                    own, counts = keys[at[b]: at[b + 1]], None
                    first = np.flatnonzero(np.append(True, np.diff(own) > 0))
                    if 12 * len(first) < 8 * len(own):
                        counts, own = np.diff(np.append(first, len(own))).astype(np.uint32).tobytes(), own[first]
                    rows.append((fit, int(b), positive, own.tobytes(), counts))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()))],
                                             names=["fit", "bucket", "positive", "keys", "counts"])
    return run


def _ordered(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray | None]:
    """Scores of parts in order, and the rows of each (None: one each)."""
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, dtype=np.uint64)
    if all(n is None for _, n in parts):
        return np.sort(keys), None
    counts = np.concatenate([np.ones(len(k)) if n is None else n for k, n in parts])
    order = np.argsort(keys)
    return keys[order], counts[order]


def _wins(batches):
    """Of each bucket: its positives, and the pairs inside it that a positive wins (ties count half)."""
    def closed(place, neg, pos):
        (lower, n_neg), (upper, n_pos) = _ordered(neg), _ordered(pos)
        rows = float(len(upper) if n_pos is None else n_pos.sum())
        # the fewer scores are looked for among the others
        few, many, n_few, n_many = (upper, lower, n_pos, n_neg) if len(upper) <= len(lower) else (lower, upper, n_neg, n_pos)
        below = np.arange(len(many) + 1.0) if n_many is None else np.append(0.0, np.cumsum(n_many))
        won = (below[np.searchsorted(many, few)] + below[np.searchsorted(many, few, side="right")]) / 2
        total = float(won.sum() if n_few is None else (won * n_few).sum())
        if few is lower:  # what the negatives win, the positives lose
            total = rows * float(len(lower) if n_neg is None else n_neg.sum()) - total
        return pa.RecordBatch.from_arrays([pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int32()), pa.array([rows]), pa.array([total])],
                                          names=["fit", "bucket", "pos", "wins"])

    place, own = None, ([], [])
    for batch in batches:
        for r in batch.to_pylist():
            if place != (r["fit"], r["bucket"]):
                if place is not None:
                    yield closed(place, *own)
                place, own = (r["fit"], r["bucket"]), ([], [])
            counts = None if r["counts"] is None else np.frombuffer(r["counts"], dtype=np.uint32)
            own[int(r["positive"])].append((np.frombuffer(r["keys"], dtype=np.uint64), counts))
    if place is not None:
        yield closed(place, *own)
