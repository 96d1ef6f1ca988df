"""Quality rules on repetition, by suffix arrays over the words of each text.

A suffix array sorts all suffixes of a text's word sequence; neighbours' longest
common prefixes (LCP) bound its LCP intervals, and each interval is a maximal
repeated run of words.  The spans of all repeats of ``min_words`` words or more
are united; a text is kept if they cover at most ``max_fraction`` of its words and
the longest has at most ``max_longest`` words.  The array is built by prefix
doubling, and the common prefixes are read off the ranks of the doubling steps.
Texts without any repeated run of ``min_words`` words (found by hashing) have no
such interval and need no array; that changes no result.

Counts beside it: words, code points in words, symbols, repeated lines, and words
in three-word windows that occur twice or more.

Defined results: null, empty and blank texts have zero counts and fail the base
rule (fewer than 50 words); rows alike get like results; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t

MIN_WORDS, MAX_FRACTION, MAX_LONGEST = 8, 0.3, 300
BASE_WORDS, BASE_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP of each suffix with the one before it) of a sequence of integers."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int32) + 1
    levels, step = [rank], 1
    while rank.max() < n:
        shifted = np.zeros(n, dtype=np.int64)
        shifted[: n - step] = rank[step:]
        rank = np.unique(rank.astype(np.int64) * (n + 1) + shifted, return_inverse=True)[1].astype(np.int32) + 1
        levels.append(rank)
        step *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank - 1] = np.arange(n)
    lcp = np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 2, -1, -1):  # the last level tells all suffixes apart
        # equal ranks at this level mean 2**k equal words, if both suffixes are that long
        inside = (a + (1 << k) <= n) & (b + (1 << k) <= n)
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        lcp[1:] += same.astype(np.int64) << k
        a += same.astype(np.int64) << k
        b += same.astype(np.int64) << k
    return order, lcp


def repeat_spans(ids: np.ndarray, min_words: int = MIN_WORDS) -> tuple[list[tuple[int, int]], int]:
    """United spans (word positions) of all repeated runs of ``min_words`` words or more, and the longest run."""
    if len(ids) <= min_words:
        return [], 0
    order, lcp = suffix_array(ids)
    # a suffix's longest repeat is its larger LCP with its two neighbours
    length = np.maximum(lcp, np.append(lcp[1:], 0))
    reach = np.zeros(len(ids), dtype=np.int64)
    reach[order] = np.where(length >= min_words, length, 0)
    at = np.flatnonzero(reach)
    if len(at) == 0:
        return [], 0
    ends = np.maximum.accumulate(at + reach[at])
    cut = np.append(True, at[1:] > ends[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(at)) - 1
    return list(zip(at[first].tolist(), ends[last].tolist(), strict=True)), int(reach.max())


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeat_words(h: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more."""
    runs = t.windows(h, 3)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs)
    same = runs[order[1:]] == runs[order[:-1]]
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return int((twice | np.append(False, twice[:-1]) | np.append([False, False], twice[:-2])).sum())


_COLUMNS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
            "repeat_fraction double, longest_repeat bigint, kept boolean")


def _rules(min_words: int, max_fraction: float, max_longest: int):
    def run(batches):
        for rows, data, offs in t.text_slices(batches):
            h, starts, ends, bounds = t.words(data, offs)
            cps = t.code_points(data)
            n_words = np.diff(bounds)
            chars = _sums(cps[ends] - cps[starts], bounds)
            symbols = _sums(_SYMBOL[data], offs)
            ls, le, lb = t.spans(data, offs, _NEWLINE)
            full = np.searchsorted(starts, le) > np.searchsorted(starts, ls)  # lines that hold a word
            lh = t.span_hashes(data, ls, le)
            dup, repeat = np.zeros(rows.num_rows, dtype=np.int64), np.zeros(rows.num_rows, dtype=np.int64)
            fraction, longest = np.zeros(rows.num_rows), np.zeros(rows.num_rows, dtype=np.int64)
            for k in range(rows.num_rows):
                lines = lh[lb[k]: lb[k + 1]][full[lb[k]: lb[k + 1]]]
                dup[k] = len(lines) - len(np.unique(lines))
                w = h[bounds[k]: bounds[k + 1]]
                repeat[k] = _repeat_words(w)
                if repeat[k] < min_words:
                    continue
                runs = np.sort(t.windows(w, min_words))
                if len(runs) > 1 and (runs[1:] == runs[:-1]).any():
                    spans, longest[k] = repeat_spans(w, min_words)
                    fraction[k] = sum(b - a for a, b in spans) / len(w)
            failed = (n_words < BASE_WORDS) | (100 * repeat > BASE_REPEAT_PERCENT * n_words)
            kept = ~failed & (fraction <= max_fraction) & (longest <= max_longest)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(x) for x in (n_words, chars, symbols, dup, repeat, failed, fraction, longest, kept))],
                names=["doc_id", *(c.split()[0] for c in _COLUMNS.split(", "))])
    return run


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                  max_fraction: float = MAX_FRACTION, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, repeat_fraction, longest_repeat (words) and kept."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(_rules(min_words, max_fraction, max_longest), f"doc_id {dict(src.dtypes)['doc_id']}, {_COLUMNS}")
