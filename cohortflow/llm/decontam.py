"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Every window of a training text is a query.  Its terms (words between ASCII
white space and punctuation, A-Z lower-cased) score the test items by BM25; an
item is retrieved when its score reaches ``share`` of the score it gets from its
own text.  Impacts are divided by that threshold, so every item must reach 1.

* An item's most common terms, up to ``EASY`` of the threshold, are not
  essential: no item is retrieved without ``1 - EASY`` from its other terms.
* Essential postings are grouped in blocks of ``BLOCK`` items.  A block's bound for a
  window is the sum of the block maxima of the window's terms; blocks whose bound
  stays below ``1 - EASY`` are skipped, the others are scored in full.

Retrieved pairs are verified: enough of the word trigrams of the item's question
and of its answer must occur in the window.  The answer is the item's last line,
or else its last sentence, or else its last quarter.

Windows have ``2 * step`` words and begin every ``step`` words, with ``step`` no
shorter than the longest item, so that each copy lies whole in some window and
whole texts are covered.  The index is broadcast; items beyond ``shard_words``
words go to further shards, each scanned in turn against global statistics.

Defined results: null and empty texts and items match nothing; items alike in id
and text count as one; rows alike get like results; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _text as t
from ._tables import row_key, unused

K1, B = 1.2, 0.75
BLOCK = 8
EASY = 0.5
_SEP = t._WS.copy()
_SEP[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_TERMS = "item bigint, term bigint, tf int, length int"


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = t.lower(data)
    starts, ends, bounds = t.spans(low, offs, _SEP)
    return t.span_hashes(low, starts, ends), starts, ends, bounds


def _item_terms(batches):
    for rows, data, offs in t.text_slices(batches):
        h, _, _, bounds = terms(data, offs)
        for k in range(rows.num_rows):
            u, n = np.unique(h[bounds[k]: bounds[k + 1]], return_counts=True)
            if len(u):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows.column(0)[k].as_py()] * len(u)), pa.array(t.signed(u)), pa.array(n.astype(np.int32)),
                     pa.array(np.full(len(u), bounds[k + 1] - bounds[k], dtype=np.int32))], names=["item", "term", "tf", "length"])


def split_answer(text: str) -> tuple[str, str]:
    """(question, answer) of an item's text."""
    text = text.strip()
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    for cut in range(len(text) - 2, 0, -1):
        if text[cut] in ".!?" and text[cut + 1] == " " and text[cut + 1:].strip():
            return text[: cut + 1], text[cut + 1:]
    w = text.split()
    k = max(1, len(w) // 4)
    return " ".join(w[:-k]), " ".join(w[-k:])


def _grams(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    h, _, _, _ = terms(raw, np.array([0, len(raw)]))
    return np.unique(t.windows(h, min(3, len(h)))) if len(h) else np.zeros(0, dtype=np.uint64)


@dataclass
class Index:
    """Items sorted by length of text within blocks of BLOCK; all arrays are sorted by term hash."""

    ids: list
    threshold: np.ndarray  # BM25 an item must reach
    vocab: np.ndarray  # all term hashes
    ptr: np.ndarray  # postings of a term: items[ptr[i]:ptr[i + 1]], weights (impact / threshold)
    items: np.ndarray
    weights: np.ndarray
    eptr: np.ndarray  # essential blocks of a term: eblock, emax
    eblock: np.ndarray
    emax: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    step: int

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)


def build_index(items: list[tuple], postings: list[tuple], n_items: int, mean_length: float, step: int, share: float) -> Index:
    """``items``: (key, id, text); ``postings``: (key, term, tf, length, df); statistics are those of all test items."""
    items = sorted(items, key=lambda x: (len(x[2]), x[0]))
    at = {x[0]: i for i, x in enumerate(items)}
    item = np.array([at[p[0]] for p in postings], dtype=np.int64)
    term = np.array([p[1] for p in postings], dtype=np.int64).view(np.uint64)
    tf, length, df = (np.array([p[k] for p in postings], dtype=np.float64) for k in (2, 3, 4))
    idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
    impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
    threshold = share * np.bincount(item, weights=impact, minlength=len(items))
    w = impact / threshold[item]
    # common terms of an item are not essential until they carry EASY of its threshold
    order = np.lexsort((term, -df, item))
    run = np.cumsum(w[order])
    first = np.searchsorted(item[order], np.arange(len(items)))
    base = np.concatenate([[0.0], run])[first]
    essential = np.empty(len(w), dtype=bool)
    essential[order] = run - base[item[order]] > EASY
    order = np.lexsort((item, term))
    item, term, w, essential = item[order], term[order], w[order], essential[order]
    vocab, start = np.unique(term, return_index=True)
    ti = np.searchsorted(vocab, term)
    e = essential
    pair, where = np.unique(ti[e] * (len(items) + 1) + item[e] // BLOCK, return_inverse=True)
    emax = np.zeros(len(pair))
    np.maximum.at(emax, where, w[e])
    qa = [split_answer(x[2]) for x in items]
    return Index([x[1] for x in items], threshold, vocab, np.append(start, len(term)), item, w,
                 np.searchsorted(pair // (len(items) + 1), np.arange(len(vocab) + 1)), (pair % (len(items) + 1)).astype(np.int64), emax,
                 [_grams(q) for q, _ in qa], [_grams(a) for _, a in qa], step)


def _ranges(ptr: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the positions ptr[i]..ptr[i + 1], flat, and which of ``i`` each belongs to."""
    n = ptr[i + 1] - ptr[i]
    owner = np.repeat(np.arange(len(i)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ptr[i], n), owner


def retrieve(ix: Index, h: np.ndarray, bounds: np.ndarray):
    """(window row, window start word, window end word, item, score / threshold) of all windows of the rows that reach an item."""
    i = np.minimum(np.searchsorted(ix.vocab, h), len(ix.vocab) - 1)
    known = ix.vocab[i] == h
    words = np.diff(bounds)
    n_win = np.maximum(1, -(-words // ix.step) - 1) * (words > 0)
    first_win = np.concatenate([[0], np.cumsum(n_win)])
    total = int(first_win[-1])
    row_of = np.repeat(np.arange(len(words)), n_win)
    # a word lies in the window that begins at its step and in the one before
    pos = np.flatnonzero(known & (np.diff(ix.eptr)[i] > 0))
    row = np.searchsorted(bounds, pos, side="right") - 1
    step = (pos - bounds[row]) // ix.step
    win = np.concatenate([first_win[row] + np.minimum(step, n_win[row] - 1), (first_win[row] + step - 1)[(step > 0) & (step < n_win[row])]])
    term = np.concatenate([i[pos], i[pos][(step > 0) & (step < n_win[row])]])
    key = np.unique(win * len(ix.vocab) + term)  # a window's distinct essential terms
    win, term = key // len(ix.vocab), key % len(ix.vocab)
    where, owner = _ranges(ix.eptr, term)
    slot, inv = np.unique(win[owner] * ix.blocks + ix.eblock[where], return_inverse=True)
    bound = np.bincount(inv, weights=ix.emax[where], minlength=len(slot))
    alive = slot[bound >= 1 - EASY - 1e-9]
    out = []
    for w in np.unique(alive // ix.blocks) if total else ():
        r = row_of[w]
        a = bounds[r] + (w - first_win[r]) * ix.step
        z = min(a + 2 * ix.step, bounds[r + 1]) if w + 1 < first_win[r + 1] else bounds[r + 1]
        seen = np.unique(i[a:z][known[a:z]])
        where, owner = _ranges(ix.ptr, seen)
        lo, hi = np.searchsorted(alive, [w * ix.blocks, (w + 1) * ix.blocks])
        open_ = np.zeros(ix.blocks, dtype=bool)
        open_[alive[lo:hi] - w * ix.blocks] = True
        where = where[open_[ix.items[where] // BLOCK]]
        score = np.bincount(ix.items[where], weights=ix.weights[where], minlength=len(ix.ids))
        out += [(int(r), int(a), int(z), int(k), float(score[k])) for k in np.flatnonzero(score >= 1 - 1e-9)]
    return out


_HITS = "doc_id {doc_type}, row_key bigint, item_id {item_type}, score double, question_overlap double, answer_overlap double, start bigint, `end` bigint"


def _search(shared, least: float, item_type):
    def share_of(gram: np.ndarray, found: np.ndarray) -> float:
        return float(np.isin(gram, found).mean()) if len(gram) else 1.0

    def run(batches):
        ix: Index = shared.value
        for rows, data, offs in t.text_slices(batches):
            h, starts, ends, bounds = terms(data, offs)
            if len(h) == 0:
                continue
            cps = None
            best = {}
            for r, a, z, k, score in retrieve(ix, h, bounds):
                found = np.concatenate([t.windows(h[a:z], m) for m in (1, 2, 3)])
                q, s = share_of(ix.question[k], found), share_of(ix.answer[k], found)
                if q >= least and s >= least and score > best.get((r, k), (0.0,))[0]:
                    best[r, k] = (score, q, s, a, z)
            if best:
                cps = t.code_points(data) if cps is None else cps
                keys = sorted(best)
                got = [best[x] for x in keys]
                row = pa.array([r for r, _ in keys])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(row), rows.column(1).take(row), pa.array([ix.ids[k] for _, k in keys], type=item_type),
                     pa.array([g[0] * ix.threshold[k] for g, (_, k) in zip(got, keys, strict=True)]), pa.array([g[1] for g in got]), pa.array([g[2] for g in got]),
                     pa.array([int(cps[starts[g[3]]] - cps[offs[r]]) for g, (r, _) in zip(got, keys, strict=True)]),
                     pa.array([int(cps[ends[g[4] - 1]] - cps[offs[r]]) for g, (r, _) in zip(got, keys, strict=True)])],
                    names=["doc_id", "row_key", "item_id", "score", "question_overlap", "answer_overlap", "start", "end"])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 share: float = 0.6, least: float = 0.5, shard_words: int = 500_000) -> DataFrame:
    """One row per text and test item found in it: doc_id, row_key, item_id, BM25 score of the best window,
    shares of the question's and the answer's trigrams in it, and its code point offsets."""
    spark = docs.sparkSession
    items = benchmark.select(row_key(item_id, item_text).alias("item"), F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    items = items.filter(F.col("text").isNotNull()).dropDuplicates(["item"])
    posts = items.select("item", "text").mapInArrow(_item_terms, _TERMS)
    posts = posts.join(posts.groupBy("term").agg(F.count("*").alias("df")), "term")
    stats = posts.groupBy("item").agg(F.max("length").alias("length")).agg(
        F.count("*").alias("n"), F.avg("length").alias("mean"), F.sum("length").alias("words"), F.max("length").alias("longest")).first()
    src = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))
    schema = _HITS.format(doc_type=dict(src.dtypes)["doc_id"], item_type=dict(items.dtypes)["item_id"])
    if not stats["n"]:
        return spark.createDataFrame([], schema)
    shards = -(-stats["words"] // shard_words)
    step = max(64, stats["longest"])
    out = None
    for s in range(shards):  # one for any index within the bound of a broadcast
        mine = F.pmod(F.col("item"), F.lit(shards)) == s
        rows = [(r["item"], r["item_id"], r["text"]) for r in items.filter(mine).collect()]
        found = [(r["item"], r["term"], r["tf"], r["length"], r["df"]) for r in posts.filter(mine).collect()]
        if not found:
            continue
        have = {p[0] for p in found}
        ix = build_index([r for r in rows if r[0] in have], found, stats["n"], stats["mean"], step, share)
        hits = src.mapInArrow(_search(spark.sparkContext.broadcast(ix), least, to_arrow_type(items.schema["item_id"].dataType)), schema)
        out = hits if out is None else out.unionAll(hits)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows in which a test item was found; all other rows and columns as they are."""
    hit = unused(docs, "_hit")
    hits = contaminated(docs, benchmark, **options).select(F.col("row_key").alias(hit)).distinct()
    key = row_key(docs[options.get("doc_id", "doc_id")], docs[options.get("text", "text")])
    return docs.join(hits, key == F.col(hit), "left_anti").select(*docs.columns)
