"""Language identification with interpolated Kneser-Ney character models.

One model per language over characters of order ``ORDER``: letters lower-cased,
every run of other characters one boundary symbol.  Probabilities are stored in
sorted hash arrays, one per order, shared by all languages: a key is the 64-bit
hash of an n-gram seen in any language, and its row holds the interpolated
probability under each.  An n-gram absent there falls back to its context's
back-off weight and the next lower order.  The language with the lowest cross-entropy
per character wins.

Calibration uses labelled texts kept out of the counts: a temperature turns
cross-entropies into a probability (the score), and each language gets a
cross-entropy above which a text is rejected, on the way from its own texts' mean
to the mean of other languages' texts.

Fitting reads a bounded sample of whole labelled texts (``budget`` bytes of text
a language, ``total`` bytes in all, drawn by hash), and of each language at least its
``LEAST_TEXTS`` first texts by hash, however long; every text is then scored in full.

Defined results: null texts and texts without a letter are ``und`` with score 0,
not accepted; so is everything when no labelled text was given.  Rows alike get
like results; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text as t
from ._tables import row_key

ORDER = 4
UND = "und"
_POWERS = np.array([pow(0x9DDFEA08EB382D69, k, 1 << 64) for k in range(ORDER)], dtype=np.uint64)
TOWARDS_FOREIGN = 0.7  # how far from the own mean to the foreign mean a text may lie
EVIDENCE = 200  # characters that count as independent evidence in the score
LEAST_TEXTS = 5  # with a letter, of each language in the sample


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case code point if it is a letter, else 0 (from Python's Unicode tables)."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and boundaries of each row as code points (0 is the boundary), with row bounds.

    Every row begins with ORDER - 1 boundaries, runs of other characters are one.
    """
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    at = t.code_points(data)[offs]
    s = _letters()[cps]
    if len(s) == 0:
        return np.zeros((ORDER - 1) * (len(offs) - 1), dtype=np.uint32), np.arange(len(offs)) * (ORDER - 1)
    begins = np.zeros(len(s) + 1, dtype=bool)
    begins[at] = True
    keep = s != 0
    inner = ~keep[1:] & keep[:-1] & ~begins[1:-1]
    keep[1:] |= inner
    count = np.concatenate([[0], np.cumsum(keep)])[at]
    pad = ORDER - 1
    rows = len(offs) - 1
    bounds = count + pad * np.arange(rows + 1)
    out = np.zeros(int(bounds[-1]), dtype=np.uint32)
    row_of = np.repeat(np.arange(rows), np.diff(count))
    out[np.arange(int(count[-1])) + pad * (row_of + 1)] = s[keep]
    return out, bounds


def gram_hashes(sym: np.ndarray) -> list[np.ndarray]:
    """For k = 0..ORDER: hash at each position of the k symbols that end there (wraps at the start; callers mask pads)."""
    c = t.mix(sym.astype(np.uint64) + np.uint64(1))
    out = [np.zeros(len(sym), dtype=np.uint64)]
    for k in range(ORDER):
        out.append(out[-1] + np.roll(c, k) * _POWERS[k])
    return out


def _counts(batches):
    """(lang, n-gram as UTF-32, count) of the rows of each batch."""
    for rows, data, offs in t.text_slices(batches):
        sym, bounds = symbols(data, offs)
        langs = np.array(rows.column(rows.schema.get_field_index("lang")).to_pylist(), dtype=object)
        names = []
        grams, counts = [], []
        real = np.ones(len(sym), dtype=bool)
        for k in range(ORDER - 1):
            real[bounds[:-1] + k] = False
        row_of = np.repeat(np.arange(rows.num_rows), np.diff(bounds))
        for lang in dict.fromkeys(langs):
            pos = np.flatnonzero(real & (langs == lang)[row_of])
            if len(pos) == 0:
                continue
            g = np.stack([sym[pos - k] for k in range(ORDER - 1, -1, -1)], axis=1)
            u, n = np.unique(np.ascontiguousarray(g).view(f"V{4 * ORDER}").ravel(), return_counts=True)
            names += [lang] * len(u)
            grams += [x.tobytes() for x in u]
            counts.append(n)
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(grams, type=pa.binary()), pa.array(np.concatenate(counts))], names=["lang", "gram", "n"])


def _key(g: np.ndarray) -> np.ndarray:
    """Hash of each row of symbols, equal to ``gram_hashes`` for the same symbols."""
    acc = np.zeros(len(g), dtype=np.uint64)
    for k in range(g.shape[1]):
        acc = acc + t.mix(g[:, g.shape[1] - 1 - k].astype(np.uint64) + np.uint64(1)) * _POWERS[k]
    return acc


class _Counts:
    """One language: n-grams of every order with counts; below the top order, continuation counts."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.grams, self.n = {ORDER: grams}, {ORDER: n.astype(np.float64)}
        for k in range(ORDER - 1, 0, -1):
            shorter, c = np.unique(self.grams[k + 1][:, 1:], axis=0, return_counts=True)
            self.grams[k], self.n[k] = shorter, c.astype(np.float64)
        self.index = {}
        for k in range(1, ORDER + 1):
            key, ctx, n = _key(self.grams[k]), _key(self.grams[k][:, :-1]), self.n[k]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            order = np.argsort(key)
            u, where = np.unique(ctx, return_inverse=True)
            total, types = np.bincount(where, weights=n), np.bincount(where)
            self.index[k] = (key[order], n[order], u, total, types, float(d))

    def probabilities(self, k: int, key: np.ndarray, ctx: np.ndarray, below: np.ndarray) -> np.ndarray:
        keys, n, ctxs, total, types, d = self.index[k]
        i, j = np.minimum(np.searchsorted(keys, key), len(keys) - 1), np.minimum(np.searchsorted(ctxs, ctx), len(ctxs) - 1)
        c, known = np.where(keys[i] == key, n[i], 0.0), ctxs[j] == ctx
        return np.where(known, np.maximum(c - d, 0) / total[j] + d * types[j] / total[j] * below, below)

    def backoff(self, k: int, ctx: np.ndarray) -> np.ndarray:
        _, _, ctxs, total, types, d = self.index[k]
        j = np.minimum(np.searchsorted(ctxs, ctx), len(ctxs) - 1)
        return np.where(ctxs[j] == ctx, d * types[j] / total[j], 1.0)


@dataclass
class Model:
    """Sorted hash arrays of each order: keys with log2 probabilities, contexts with log2 back-off weights."""

    langs: list[str]
    floor: float
    keys: dict[int, np.ndarray]
    logp: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    logb: dict[int, np.ndarray]
    limit: np.ndarray | None = None  # rejection: cross-entropy per language
    spread: np.ndarray | None = None  # of one character, per language
    temperature: float = 1.0

    def log_probabilities(self, h: list[np.ndarray], pos: np.ndarray) -> np.ndarray:
        """log2 p of the symbol at each position under every language (positions x languages)."""
        out = np.zeros((len(pos), len(self.langs)), dtype=np.float32)
        todo = np.arange(len(pos))
        for k in range(ORDER, 0, -1):
            key = h[k][pos[todo]]
            i = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
            hit = self.keys[k][i] == key
            out[todo[hit]] += self.logp[k][i[hit]]
            todo = todo[~hit]
            if len(todo) == 0:
                return out
            ctx = h[k - 1][pos[todo] - 1]
            j = np.minimum(np.searchsorted(self.contexts[k], ctx), len(self.contexts[k]) - 1)
            known = self.contexts[k][j] == ctx
            out[todo[known]] += self.logb[k][j[known]]
        out[todo] += np.float32(self.floor)
        return out

    def cross_entropies(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row: number of symbols scored, and bits per symbol under each language (0 symbols without a letter)."""
        sym, bounds = symbols(data, offs)
        h = gram_hashes(sym)
        real = np.ones(len(sym), dtype=bool)
        for k in range(ORDER - 1):
            real[bounds[:-1] + k] = False
        pos = np.flatnonzero(real)
        lp = self.log_probabilities(h, pos)
        total = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(lp, axis=0, dtype=np.float64)])
        at = np.searchsorted(pos, bounds)
        n = np.diff(at)
        has = np.concatenate([[0], np.cumsum(sym != 0)])
        n = np.where(has[bounds[1:]] > has[bounds[:-1]], n, 0)
        return n, -(total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)[:, None]

    def posterior(self, n: np.ndarray, xent: np.ndarray) -> np.ndarray:
        z = -xent * (np.minimum(n, EVIDENCE) * self.temperature * np.log(2))[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """``counts``: language -> (n-grams as rows of ORDER code points, counts)."""
    langs = sorted(counts)
    per = [_Counts(*counts[x]) for x in langs]
    alphabet = len(np.unique(np.concatenate([p.grams[1].ravel() for p in per]))) + 1
    m = Model(langs, float(-np.log2(alphabet)), {}, {}, {}, {})
    below_keys, below = np.zeros(0, dtype=np.uint64), None
    for k in range(1, ORDER + 1):
        grams = np.unique(np.concatenate([p.grams[k] for p in per]), axis=0)
        key = _key(grams)
        order = np.argsort(key)
        grams, key = grams[order], key[order]
        ctx = _key(grams[:, :-1])
        if k == 1:
            lower = np.full((len(key), len(langs)), 1.0 / alphabet)
        else:
            lower = below[np.searchsorted(below_keys, _key(grams[:, 1:]))]
        prob = np.stack([p.probabilities(k, key, ctx, lower[:, j]) for j, p in enumerate(per)], axis=1)
        m.keys[k], m.logp[k] = key, np.log2(prob).astype(np.float32)
        m.contexts[k] = np.unique(ctx)
        m.logb[k] = np.log2(np.stack([p.backoff(k, m.contexts[k]) for p in per], axis=1)).astype(np.float32)
        below_keys, below = key, prob
    return m


def calibrate(m: Model, truth: np.ndarray, n: np.ndarray, xent: np.ndarray) -> None:
    """Set temperature and limits from held-out texts: ``truth`` index of the language, ``xent`` rows x languages."""
    ok = n > 0
    truth, n, xent = truth[ok], n[ok], xent[ok]
    best = None
    for temp in 2.0 ** np.arange(-7, 1.5, 0.5):
        m.temperature = float(temp)
        if len(truth):
            loss = -np.log(np.maximum(m.posterior(n, xent)[np.arange(len(truth)), truth], 1e-12)).sum()
            best = min(best or (loss, temp), (loss, temp))
    m.temperature = float(best[1]) if best else 1.0
    m.limit, m.spread = np.full(len(m.langs), -m.floor), np.ones(len(m.langs))
    for j in range(len(m.langs)):
        own, other = truth == j, truth != j
        if own.sum() < 5:
            continue
        w = n[own]
        mean = np.average(xent[own, j], weights=w)
        m.spread[j] = max(0.1, np.sqrt(np.average((xent[own, j] - mean) ** 2 * w, weights=w)))
        foreign = np.average(xent[other, j], weights=n[other]) if other.any() else -m.floor
        m.limit[j] = max(mean + TOWARDS_FOREIGN * max(foreign - mean, 0), np.quantile(xent[own & (n >= 50), j], 0.999) if (own & (n >= 50)).any() else 0)


def _collect_counts(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    found = rows.select("text", "lang").mapInArrow(_counts, "lang string, gram binary, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    tab = found.toArrow()
    langs = np.array(tab.column("lang").to_pylist(), dtype=object)
    grams = np.frombuffer(b"".join(tab.column("gram").to_pylist()), dtype=np.uint32).reshape(-1, ORDER)
    n = np.array(tab.column("n").to_pylist(), dtype=np.int64)
    return {x: (grams[langs == x], n[langs == x]) for x in set(langs)}


def _scorer(shared):
    def run(batches):
        m: Model = shared.value
        for rows, data, offs in t.text_slices(batches, limit=512 << 10):
            n, xent = m.cross_entropies(data, offs)
            best = xent.argmin(axis=1)
            score = m.posterior(n, xent)[np.arange(len(best)), best]
            x = xent[np.arange(len(best)), best]
            ok = (n > 0) & (x <= m.limit[best] + 3 * m.spread[best] / np.sqrt(np.maximum(n, 1)))
            names = np.array(m.langs, dtype=object)[best]
            names[n == 0] = UND
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), rows.column(2), pa.array(names, type=pa.string()), pa.array(np.where(n > 0, score, 0.0)),
                 pa.array(np.where(n > 0, x, 0.0)), pa.array(ok)],
                names=["doc_id", "row_key", "held_out", "lang_pred", "score", "bits", "accepted"])
    return run


def _calibration(shared):
    def run(batches):
        m: Model = shared.value
        for rows, data, offs in t.text_slices(batches, limit=512 << 10):
            n, xent = m.cross_entropies(data, offs)
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("lang")), pa.array(n), pa.array(list(xent), type=pa.list_(pa.float64()))], names=["lang", "n", "xent"])
    return run


def fit(train: DataFrame, budget: int = 4_000_000, total: int = 64_000_000) -> Model | None:
    """A model from ``train`` (text, lang, row_key): null languages are left out.

    Nine in ten sampled texts are counted, the tenth calibrates; a language with no text
    in the nine is counted on all its sampled texts and left out of the calibration.  The sample is
    whole texts by hash, with ``budget`` bytes a language expected and ``total`` in all, and
    the ``LEAST_TEXTS`` first by hash of every language.
    """
    train = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = {r["lang"]: r for r in train.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect() if r["b"]}
    sizes = {lang: r["b"] for lang, r in found.items()}
    if not sizes:
        return None
    each = min(budget, total / len(sizes))
    shares = F.create_map(*[F.lit(x) for lang, b in sizes.items() for x in (lang, min(1.0, each / b))])
    unit = F.pmod(F.xxhash64("row_key", F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = unit < shares[F.col("lang")]
    few = [lang for lang, r in found.items() if each < r["b"] and r["n"] * each < 10 * LEAST_TEXTS * r["b"]]
    if few:
        # the first texts by hash of languages of which the share may draw too few
        rank = F.xxhash64("row_key", F.lit("least"))
        some = train.filter(F.col("lang").isin(few) & F.col("text").rlike(r"\p{L}")).select("lang", rank.alias("rank")).distinct()
        some = some.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("rank"))).filter(F.col("k") <= LEAST_TEXTS)
        last = {r["lang"]: r["last"] for r in some.groupBy("lang").agg(F.max("rank").alias("last")).collect()}
        if last:
            bound = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
            drawn = drawn | F.coalesce((rank <= bound[F.col("lang")]) & F.col("text").rlike(r"\p{L}"), F.lit(False))
    sample = train.filter(drawn).withColumn("_fold", F.pmod(F.xxhash64("row_key", F.lit("fold")), F.lit(10)))
    counts = _collect_counts(sample.filter("_fold <> 0"))
    unheard = sorted(sizes.keys() - counts.keys())
    if unheard:
        counts |= _collect_counts(sample.filter(F.col("lang").isin(unheard)))
    if not counts:
        return None
    m = build(counts)
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(m)
    cal = sample.filter("_fold = 0")
    if unheard:
        cal = cal.filter(~F.col("lang").isin(unheard))
    cal = cal.select("text", "lang").mapInArrow(_calibration(shared), "lang string, n bigint, xent array<double>").toArrow()
    index = {x: j for j, x in enumerate(m.langs)}
    rows = [(index[x], n, e) for x, n, e in zip(cal.column("lang").to_pylist(), cal.column("n").to_pylist(), cal.column("xent").to_pylist(), strict=True) if x in index]
    calibrate(m, np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64),
              np.array([r[2] for r in rows], dtype=np.float64).reshape(-1, len(m.langs)))
    return m


def in_fold(doc_id: Column, parts: int, part: int) -> Column:
    """crc32(doc_id as text) mod ``parts`` equals ``part``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == F.lit(part)


def identify(docs: DataFrame, held_out: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **bounds) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, held_out, lang_pred, score, bits (per symbol), accepted."""
    held = (F.lit(False) if held_out is None else held_out).alias("held_out")
    src = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), held)
    m = fit(src.filter(~F.col("held_out")).select("text", "lang", "row_key"), **bounds)
    kind = dict(src.dtypes)["doc_id"]
    if m is None:
        return src.select("doc_id", "row_key", "held_out", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(m)
    schema = f"doc_id {kind}, row_key bigint, held_out boolean, lang_pred string, score double, bits double, accepted boolean"
    return src.select("doc_id", "row_key", "held_out", "text").mapInArrow(_scorer(shared), schema)
