"""Language-model scoring by deleted interpolation.

Tokens are words (A-Z lower-cased) and one end per text.  A token's probability
after a context mixes the maximum-likelihood estimate of its bigram with a lower model:

    p(w | h) = m * f(w | h) + (1 - m) * q(w | h)
    q(w | h) = l2 * f(class(w) | class(h)) * f(w | class(w)) + l1 * f(w) + l0 / (V + 1)

Bigram and unigram counts are exact for every pair and token of the corpus.  In q alone,
the ``VOCAB`` most frequent tokens are classes of their own and all rarer ones share a
class (in which f(w | class) is their unigram share): a table of bounded size.
The weights belong to buckets of the context's frequency (powers of two), and
expectation-maximisation learns them from counts held out of the estimates: a
tenth of the training texts, by hash; first those of q, then m.  The final estimates
use all training texts.

Counts of rare tokens, and of pairs with one, grow with the corpus, so no task holds them
all.  Texts are dealt into blocks of about ``BLOCK_BYTES``; one pass gives each rare token
and pair of a block with its count there, one shuffle by ranges of the keys (parts) adds the
counts up, and each block gets the counts of its own keys back.  Rows carry many keys each,
sorted, as compressed differences.  What comes back are counts alone, in the order of the block's
sorted keys, which the block finds again in its texts; so the texts must be the same whenever
they are read.  A rare token holds less than 1 / ``VOCAB`` of all tokens, so no key is hot.
The held-out texts find the estimates that m is learned from among the same counts.

Defined results: null and empty texts have one token, the end; without training
texts all counts are 0 and every token has probability 1 / (V + 1) = 1; rows alike
get like scores; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._tables import discard, materialize, row_key

VOCAB = 2046  # classes of single tokens, besides the end and the class of rare tokens
END, RARE, BEGIN = VOCAB, VOCAB + 1, VOCAB + 2  # class numbers; BEGIN is a context only
CLASSES = VOCAB + 2
BLOCK_BYTES = 8 << 20
BINS = 64  # of counts, powers of two
FLUSH = 1 << 20
LEARN, WEIGH, SCORE = 0, 1, 2  # folds: of the estimates, of the weights, not learned from
NEVER = -1 << 20  # the ratio of a bigram without a count
ASK = np.dtype([("key", "<u8"), ("block", "<i4"), ("keep", "<i4"), ("held", "<i4")])
_BEGIN_HASH, _END_HASH = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)


def _rows_of(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _sum_by_key(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = np.concatenate([p[0] for p in parts])
    u, inv = np.unique(key, return_inverse=True)
    keep, held = (np.bincount(inv, weights=np.concatenate([p[k] for p in parts]), minlength=len(u)).astype(np.int64) for k in (1, 2))
    return u, keep, held


def _counted(slices, keys_of):
    """(key, keep, held) of the keys, pre-aggregated in the task and given out whenever FLUSH keys have gathered."""
    parts, size = [], 0

    def out():
        u, keep, held = _sum_by_key(parts)
        return pa.RecordBatch.from_arrays([pa.array(t.signed(u)), pa.array(keep), pa.array(held)], names=["key", "keep", "held"])

    for fold, h, bounds in slices:
        key, row = keys_of(h, bounds)
        u, inv = np.unique(key, return_inverse=True)
        n_held = np.bincount(inv, weights=fold[row], minlength=len(u))
        parts.append((u, np.bincount(inv, minlength=len(u)) - n_held, n_held))
        size += len(u)
        if size >= FLUSH:
            yield out()
            parts, size = [], 0
    if parts:
        yield out()


def _folds_and_words(batches):
    for rows, data, offs in t.text_slices(batches):
        h, _, _, bounds = t.words(t.lower(data), offs)
        yield rows.column(rows.schema.get_field_index("held")).to_numpy(zero_copy_only=False).astype(bool), h, bounds


def _unigrams(batches):
    """Counts of the words."""
    yield from _counted(_folds_and_words(batches), lambda h, bounds: (h, _rows_of(bounds)))


def pack(x: np.ndarray) -> bytes:
    """``x`` compressed, bytes of like place together; nothing for no entries."""
    if len(x) == 0:
        return b""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype, n = np.dtype(dtype), int.from_bytes(data[:8], "little")
    if n == 0:
        return np.zeros(0, dtype=dtype)
    planes = np.frombuffer(pa.decompress(data[8:], n * dtype.itemsize, codec="zstd"), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(-1, n).T).view(dtype).ravel()


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Places at which the entry of a (sorted) column changes, the first included."""
    apart = np.zeros(len(columns[0]), dtype=bool)
    apart[:1] = True
    for x in columns:
        apart[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(apart)


def distinct(x: np.ndarray) -> np.ndarray:
    """As np.unique, which hashes before it sorts and takes ten times as long for many entries that are mostly apart."""
    x = np.sort(x)
    return x[_starts(x)]


def order_by(key: np.ndarray, second: np.ndarray) -> np.ndarray:
    """An order by ``key``, then ``second`` (0 to 2**32 - 1); entries alike in both in any order.  Two sorts of plain numbers, faster than np.lexsort."""
    order = np.argsort(key)
    code = np.zeros(len(key), dtype=np.uint64)
    code[_starts(key[order])] = 1
    np.cumsum(code, out=code)
    code <<= np.uint64(32)
    code |= second[order].astype(np.uint64)
    again = np.argsort(code)
    del code
    return order[again]


def _ranges(starts: np.ndarray, n: int):
    return zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True)


def rare_keys(h: np.ndarray, bounds: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows of the rare words and the pairs with one."""
    r = rare_transitions(h, bounds, c)
    return np.concatenate([h[c == RARE], r.key]), np.concatenate([_rows_of(bounds)[c == RARE], r.row])


def _asks(shared, parts: int):
    """(part, asks): the keys of each block, with counts in its texts (0 where no text that has the key is learned from).  Parts are ranges of the keys."""
    def run(batches):
        vocab, number = shared.value
        found, size = [], 0

        def out():
            key, block, fold = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            order = order_by(key, block)
            key, block, fold = key[order], block[order], fold[order]
            first = _starts(key, block)
            asks = np.empty(len(first), dtype=ASK)
            asks["key"], asks["block"] = key[first], block[first]
            for name, k in (("keep", LEARN), ("held", WEIGH)):
                asks[name] = np.add.reduceat((fold == k).astype(np.int32), first, dtype=np.int32)
            part = ((asks["key"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            start, rows = _starts(part), []
            for lo, hi in _ranges(start, len(asks)):
                asks["key"][lo:hi] = np.diff(asks["key"][lo:hi], prepend=np.uint64(0))
                rows.append(pack(asks[lo:hi]))
            return pa.RecordBatch.from_arrays([pa.array(part[start]), pa.array(rows, pa.binary())], names=["part", "asks"])

        for rows, data, offs in t.text_slices(batches):
            h, _, _, bounds = t.words(t.lower(data), offs)
            block, fold = (rows.column(rows.schema.get_field_index(x)).to_numpy() for x in ("block", "fold"))
            key, row = rare_keys(h, bounds, classes(h, vocab, number))
            found.append((key, block[row], fold[row].astype(np.int8)))
            size += len(row)
            if size >= FLUSH:
                yield out()
                size = 0
        if size:
            yield out()
    return run


def _answers(rows: pa.Table) -> pa.Table:
    """(block, part, n, keep) of one part: the corpus counts n of the block's keys, and the counts without the held-out texts of the keys that its held-out texts have."""
    asks = [unpack(x.as_py(), ASK) for x in rows.column("asks")]
    key = np.concatenate([np.cumsum(x["key"], dtype=np.uint64) for x in asks])
    block, keep, held = (np.concatenate([x[name] for x in asks]) for name in ("block", "keep", "held"))
    del asks
    # arrays go as soon as they are not needed: a part has millions of entries
    order = order_by(key, block)
    key = key[order]
    block = block[order]
    keep = keep[order]
    held = held[order]
    first, own = _starts(key), _starts(key, block)
    del key, order
    block, weigh = block[own], np.add.reduceat(held, own) > 0
    of = np.searchsorted(first, own, side="right") - 1
    del own
    by_block = block.astype(np.uint64) << np.uint64(32)
    by_block |= np.arange(len(block), dtype=np.uint64)
    by_block.sort()
    by_block &= np.uint64(0xFFFFFFFF)
    block, weigh, of = block[by_block], weigh[by_block], of[by_block]
    del by_block
    every = np.add.reduceat(keep, first, dtype=np.int64)[of]
    keep += held
    del held
    n = np.add.reduceat(keep, first, dtype=np.int64)[of]
    del keep, of
    start = _starts(block)
    back = [(pack(n[lo:hi]), pack(every[lo:hi][weigh[lo:hi]])) for lo, hi in _ranges(start, len(block))]
    part = np.full(len(start), rows.column("part")[0].as_py(), dtype=np.int32)
    return pa.table({"block": block[start], "part": part, "n": pa.array([x for x, _ in back], pa.binary()), "keep": pa.array([x for _, x in back], pa.binary())})


def classes(h: np.ndarray, vocab: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Class of each word hash (``vocab`` sorted, ``number`` its classes)."""
    if len(vocab) == 0:
        return np.full(len(h), RARE)
    # hashes are spread evenly: the first 14 bits lead to one of the few entries that share them
    shift = np.uint64(50)
    slot = vocab >> shift
    first = np.minimum(np.searchsorted(slot, np.arange(1 << 14, dtype=np.uint64)), len(vocab) - 1)
    i = first[h >> shift]
    for _ in range(int(np.bincount(slot.astype(np.int64)).max()) - 1):
        i = np.minimum(i + (vocab[i] < h), len(vocab) - 1)
    return np.where(vocab[i] == h, number[i], RARE)


def pair_codes(c: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes context * CLASSES + class of every word, and of each row's end."""
    before = np.empty(len(c), dtype=np.int64)
    before[1:] = c[:-1]
    filled = bounds[:-1] < bounds[1:]
    before[bounds[:-1][filled]] = BEGIN
    last = np.full(len(bounds) - 1, BEGIN, dtype=np.int64)
    last[filled] = c[bounds[1:][filled] - 1]
    return before * CLASSES + c, last * CLASSES + END


@dataclass
class Transitions:
    """Pairs of neighbouring tokens in which a word has no class of its own: the words' pairs first, then those of ends."""

    at: np.ndarray  # place of the second word among the words; number of words + row for an end
    row: np.ndarray
    before: np.ndarray  # place of the first word, or -1 at a beginning
    context: np.ndarray  # class of the first
    key: np.ndarray


def rare_transitions(h: np.ndarray, bounds: np.ndarray, c: np.ndarray) -> Transitions:
    inner, ends = pair_codes(c, bounds)
    context = np.concatenate([inner, ends]) // CLASSES
    last = np.where(bounds[:-1] < bounds[1:], bounds[1:] - 1, -1)
    before = np.concatenate([np.arange(len(h)) - 1, last])
    at = np.flatnonzero((context == RARE) | (np.concatenate([c, np.full(len(ends), END)]) == RARE))
    row = np.concatenate([_rows_of(bounds), np.arange(len(ends))])[at]
    context = context[at]
    before = np.where(context == BEGIN, -1, before[at])
    first = np.append(h, _BEGIN_HASH)[before]
    second = np.concatenate([h, np.full(len(ends), _END_HASH)])[at]
    return Transitions(at, row, before, context, t.mix(t.mix(first) * np.uint64(0xD1342543DE82EF95) + second))


def _bigrams(shared):
    def run(batches):
        vocab, number = shared.value
        total = [np.zeros((BEGIN + 1) * CLASSES, dtype=np.int64) for _ in range(2)]
        for rows, data, offs in t.text_slices(batches):
            h, _, _, bounds = t.words(t.lower(data), offs)
            inner, ends = pair_codes(classes(h, vocab, number), bounds)
            fold = rows.column(rows.schema.get_field_index("held")).to_numpy(zero_copy_only=False).astype(bool)
            held = fold[_rows_of(bounds)]
            for k in (0, 1):
                codes = np.concatenate([inner[held == k], ends[fold == k]])
                u, n = np.unique(codes, return_counts=True)
                total[k][u] += n
        at = np.flatnonzero((total[0] > 0) | (total[1] > 0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0][at]), pa.array(total[1][at])], names=["pair", "keep", "held"])
    return run


def buckets(n: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + floor(log2(n))."""
    return np.where(n > 0, 1 + np.floor(np.log2(np.maximum(n, 1))), 0).astype(np.int64)


def learn_weights(keep: np.ndarray, held: np.ndarray, rare_bins: list[tuple[float, float]], types: int, rounds: int = 60) -> np.ndarray:
    """Weights (BINS x 3: bigram, unigram, uniform) by expectation-maximisation on held-out bigram counts.

    ``keep`` and ``held`` are context x class counts.  A held-out rare token has
    the count in ``keep`` that ``rare_bins`` (mean count, held-out tokens) say, in every
    context alike.  Ratios of the estimates are rounded to an eighth of a power of
    two, so the data of the iteration is a small histogram.
    """
    context, total = keep.sum(axis=1), max(1, keep.sum())
    one = keep.sum(axis=0)
    bucket = buckets(context)
    h, w = np.nonzero(held)
    plain = w != RARE
    n = held[h, w].astype(np.float64)
    f2 = keep[h, w] / np.maximum(context[h], 1)
    f1 = one[w] / total
    data = [(bucket[h[plain]], n[plain], f2[plain], f1[plain])]
    seen = sum(x for _, x in rare_bins)
    for mean, tokens in rare_bins if seen else ():
        r = ~plain
        share = mean / max(1, one[RARE])
        data.append((bucket[h[r]], n[r] * (tokens / seen), f2[r] * share, np.full(r.sum(), mean / total)))
    b, n, f2, f1 = (np.concatenate(x) for x in zip(*data, strict=True))
    f0 = 1.0 / (types + 1)

    def coarse(f):
        return np.where(f > 0, np.round(8 * np.log2(np.maximum(f, 1e-300) / f0)), -1 << 20)

    cell, inv = np.unique(np.stack([b, coarse(f2), coarse(f1)], axis=1), axis=0, return_inverse=True)
    n = np.bincount(inv.ravel(), weights=n, minlength=len(cell))
    b = cell[:, 0].astype(np.int64)
    p = np.stack([np.where(cell[:, k] > -1 << 19, 2.0 ** (cell[:, k] / 8), 0.0) for k in (1, 2)] + [np.ones(len(cell))], axis=1)

    def fit(groups: np.ndarray, size: int) -> np.ndarray:
        lam = np.full((size, 3), 1 / 3)
        for _ in range(rounds):
            r = lam[groups] * p
            r *= (n / r.sum(axis=1))[:, None]
            new = np.stack([np.bincount(groups, weights=r[:, k], minlength=size) for k in range(3)], axis=1)
            mass = new.sum(axis=1, keepdims=True)
            lam = np.where(mass > 0, (new + 1e-6) / (mass + 3e-6), lam)
        return lam

    if len(n) == 0:
        return np.tile([0.0, 0.0, 1.0] if types == 0 else [0.3, 0.6, 0.1], (BINS, 1))
    every = fit(np.zeros(len(b), dtype=np.int64), 1)
    lam = fit(b, BINS)
    heard = np.bincount(b, weights=n, minlength=BINS) > 0
    lam = np.where(heard[:, None], lam, every)
    lam[0] = [0.0, lam[0, 1] + lam[0, 0], lam[0, 2]]  # an unseen context has no bigram estimate
    return lam


def ratios(f2: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The bigram estimate over that of the lower model, in eighths of a power of two."""
    return np.where(f2 > 0, np.round(8 * np.log2(np.maximum(f2, 1e-300) / np.maximum(q, 1e-300))), NEVER).astype(np.int64)


def pair_weights(bucket: np.ndarray, ratio: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weight of the exact bigram in each bucket, by expectation-maximisation on ``n`` held-out tokens of each ratio."""
    if len(n) == 0 or n.sum() == 0:
        return np.zeros(BINS)
    r = np.where(ratio > NEVER, 2.0 ** (np.maximum(ratio, -8000) / 8), 0.0)

    def fit(groups: np.ndarray) -> np.ndarray:
        m = np.full(BINS, 0.5)
        mass = np.bincount(groups, weights=n, minlength=BINS)
        for _ in range(rounds):
            g = m[groups] * r
            m = np.where(mass > 0, (np.bincount(groups, weights=n * g / (g + 1 - m[groups]), minlength=BINS) + 1e-6) / (mass + 2e-6), m)
        return m
    out = np.where(np.bincount(bucket, weights=n, minlength=BINS) > 0, fit(bucket), fit(np.zeros(len(n), dtype=np.int64))[0])
    out[0] = 0.0  # an unseen context has no bigram estimate
    return out


@dataclass
class Model:
    vocab: np.ndarray  # sorted hashes of the tokens with a class of their own
    number: np.ndarray
    counts: np.ndarray  # of each class's token (END included; RARE unused)
    context: np.ndarray  # count of each class as a context
    logp: np.ndarray  # log10 q of a class's token after each context, float32; after ``with_pairs`` log10 p, but in the context RARE
    rare_a: np.ndarray  # q of a rare token with count c: rare_a[h] * c + rare_b[h]
    rare_b: np.ndarray
    lam: np.ndarray
    tokens: int
    types: int
    weight: np.ndarray | None = None  # of the exact bigram, by bucket of its context's count


def build_model(vocab: np.ndarray, number: np.ndarray, keep: np.ndarray, held: np.ndarray, rare_bins, types: int) -> Model:
    """The lower model."""
    return lower_model(vocab, number, keep + held, learn_weights(keep, held, rare_bins, types), types)


def lower_model(vocab: np.ndarray, number: np.ndarray, pairs: np.ndarray, lam: np.ndarray, types: int) -> Model:
    both = pairs.astype(np.float64)
    context, one, total = both.sum(axis=1), both.sum(axis=0), max(1.0, both.sum())
    l2, l1, l0 = lam[buckets(context)].T
    uniform = l0 / (types + 1)
    f2 = both / np.maximum(context, 1)[:, None]
    p = l2[:, None] * f2 + (l1[:, None] / total) * one[None, :] + uniform[:, None]
    logp = np.log10(np.maximum(p, 1e-300)).astype(np.float32)
    rare_a = l2 * f2[:, RARE] / max(1.0, one[RARE]) + l1 / total
    return Model(vocab, number, one.astype(np.int64), context.astype(np.int64), logp, rare_a, uniform, lam, int(both.sum()), types)


def with_pairs(m: Model, pairs: np.ndarray, weight: np.ndarray) -> None:
    """Mix the exact bigrams of tokens with classes of their own into ``m``; those of rare words are looked up in scoring."""
    m.weight = weight
    own = np.arange(BEGIN + 1) != RARE
    w = weight[buckets(m.context[own])][:, None]
    p = w * (pairs[own] / np.maximum(m.context[own], 1)[:, None]) + (1 - w) * 10.0 ** m.logp[own].astype(np.float64)
    m.logp[own] = np.log10(np.maximum(p, 1e-300)).astype(np.float32)


def _look_up(h: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if len(keys) == 0 or len(h) == 0:
        return np.zeros(len(h), dtype=np.int64)
    # sorted first, so that the search goes through ``keys`` once and not all over memory
    order = np.argsort(h)
    i = np.empty(len(h), dtype=np.int64)
    i[order] = np.minimum(np.searchsorted(keys, h[order]), len(keys) - 1)
    return np.where(keys[i] == h, counts[i], 0)


def rare_estimates(m: Model, h: np.ndarray, bounds: np.ndarray, c: np.ndarray, keys: np.ndarray, counts: np.ndarray):
    """Counts of all words; and of the transitions with a rare word: place, bucket of the context, f(w | h) and q(w | h)."""
    n = m.counts[c].copy()
    rare = np.flatnonzero(c == RARE)
    n[rare] = _look_up(h[rare], keys, counts)
    r = rare_transitions(h, bounds, c)
    is_end = r.at >= len(h)
    # END stands for the words that are not there, where the transition is an end
    word, n_word = (np.append(x, y)[np.where(is_end, len(h), r.at)] for x, y in ((c, END), (n, 0)))
    n_context = np.where(r.context == RARE, np.append(n, 0)[r.before], m.context[r.context])
    q = np.where(word == RARE, m.rare_a[r.context] * n_word + m.rare_b[r.context], 10.0 ** m.logp[r.context, word].astype(np.float64))
    return n, r.at, buckets(n_context), _look_up(r.key, keys, counts) / np.maximum(n_context, 1), q


def score_rows(m: Model, h: np.ndarray, bounds: np.ndarray, c: np.ndarray, keys: np.ndarray, counts: np.ndarray):
    """(n_tokens, n_known, base_score, score) of each row; ``keys`` (sorted) and ``counts`` of its rare words and pairs."""
    n, at, bucket, f2, q = rare_estimates(m, h, bounds, c, keys, counts)
    lp = m.logp.ravel()[np.concatenate(pair_codes(c, bounds))].astype(np.float64)
    w = m.weight[bucket]
    lp[at] = np.log10(np.maximum(w * f2 + (1 - w) * q, 1e-300))
    n_end = int(m.counts[END])

    def per_row(x):
        run = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
        return run[bounds[1:]] - run[bounds[:-1]]

    floor = np.log10(m.tokens + (m.types + 1))
    base = per_row(np.log10(n + 1.0) - floor) + (np.log10(n_end + 1.0) - floor)
    known = np.rint(per_row(n > 0)).astype(np.int64) + (n_end > 0)
    return np.diff(bounds) + 1, known, base, per_row(lp[: len(h)]) + lp[len(h):]


def _block(m: Model, docs: pa.Table, known: pa.Table, count: str):
    """Of a block's texts: slices (rows, word hashes, bounds, classes), the sorted keys and their counts."""
    slices, keys = [], [np.zeros(0, dtype=np.uint64)]
    for rows, data, offs in t.text_slices(docs.combine_chunks().to_batches()):
        h, _, _, bounds = t.words(t.lower(data), offs)
        c = classes(h, m.vocab, m.number)
        slices.append((rows, h, bounds, c))
        keys.append(distinct(rare_keys(h, bounds, c)[0]))
    keys = distinct(np.concatenate(keys))
    counts = np.concatenate([np.zeros(0, dtype=np.int64), *(unpack(x.as_py(), np.int64) for x in known.sort_by("part").column(count))])
    if len(keys) != len(counts):
        raise ValueError(f"the texts are not the same when read again: {len(counts)} keys of a block before, {len(keys)} now")
    return slices, keys, counts


def _cells(shared):
    """Held-out transitions with a rare word: tokens by bucket of the context and ratio of the estimates."""
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        m: Model = shared.value
        slices, keys, counts = _block(m, docs, known, "keep")
        found = [np.zeros(0, dtype=np.int64)]
        for _, h, bounds, c in slices:
            _, _, bucket, f2, q = rare_estimates(m, h, bounds, c, keys, counts)
            found.append(bucket << 32 | ratios(f2, q) - NEVER)
        cell, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.table({"bucket": cell >> 32, "ratio": (cell & 0xFFFFFFFF) + NEVER, "n": n.astype(np.int64)})
    return run


def _scores(shared):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        m: Model = shared.value
        slices, keys, counts = _block(m, docs, known, "n")
        got = []
        for rows, h, bounds, c in slices:
            n, k, base, score = score_rows(m, h, bounds, c, keys, counts)
            got.append(pa.table({"doc_id": rows.column(rows.schema.get_field_index("doc_id")), "held_out": rows.column(rows.schema.get_field_index("held_out")),
                                 "n_tokens": n, "n_known": k, "train_tokens": np.full(len(n), m.tokens, dtype=np.int64), "base_score": base, "score": score}))
        return pa.concat_tables(got)
    return run


def fit(src: DataFrame) -> tuple[Model, DataFrame]:
    """The model of ``src`` (text, block, fold; from ``in_blocks``), and the counts (block, part, n) of the blocks' keys."""
    train = src.filter(F.col("fold") != SCORE).select("text", (F.col("fold") == WEIGH).alias("held"))
    spark = train.sparkSession
    counts = materialize(train.mapInArrow(_unigrams, "key bigint, keep bigint, held bigint").groupBy("key").agg(F.sum("keep").alias("keep"), F.sum("held").alias("held")), "lm-counts")
    n = F.col("keep") + F.col("held")
    top = counts.orderBy(n.desc(), "key").limit(VOCAB).collect()
    vocab = np.array([r["key"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(vocab)
    vocab, number = vocab[order], order.astype(np.int64)
    shared = spark.sparkContext.broadcast((vocab, number))
    pairs = train.mapInArrow(_bigrams(shared), "pair int, keep bigint, held bigint").groupBy("pair").agg(F.sum("keep").alias("keep"), F.sum("held").alias("held")).toArrow()
    at = pairs.column("pair").to_numpy()
    keep, held = (np.zeros((BEGIN + 1) * CLASSES, dtype=np.int64) for _ in range(2))
    keep[at], held[at] = pairs.column("keep").to_numpy(), pairs.column("held").to_numpy()
    rare = counts.filter(~F.col("key").isin([r["key"] for r in top])) if len(top) < 50 else counts.join(
        F.broadcast(spark.createDataFrame([(r["key"],) for r in top], "key bigint")), "key", "left_anti")
    bin_ = F.when(F.col("keep") > 0, F.floor(F.log2("keep")) + 1).otherwise(0)
    found = rare.groupBy(bin_.alias("bin")).agg(F.sum(F.col("keep") * F.col("held")).alias("weighted"), F.sum("held").alias("tokens"), F.count("*").alias("types")).collect()
    bins = [((r["weighted"] / r["tokens"]) if r["tokens"] else 0.0, float(r["tokens"])) for r in found]
    types = sum(r["types"] for r in found) + len(top) + int((keep + held).sum() > 0)
    shape = (BEGIN + 1, CLASSES)
    keep, held = keep.reshape(shape), held.reshape(shape)
    m = build_model(vocab, number, keep, held, bins, types)
    discard(counts)
    # a part holds about as many keys as two blocks
    asked = src.select("text", "block", "fold").mapInArrow(_asks(shared, 1 + src._blocks // 2), "part int, asks binary")
    known = materialize(asked.groupBy("part").applyInArrow(_answers, "block int, part int, n binary, keep binary"), "lm-known")
    early = lower_model(vocab, number, keep, m.lam, types)
    own = held.copy()
    own[RARE], own[:, RARE] = 0, 0
    h, w = np.nonzero(own)
    cells = [(buckets(early.context[h]), ratios(keep[h, w] / np.maximum(early.context[h], 1), 10.0 ** early.logp[h, w].astype(np.float64)), own[h, w])]
    early = spark.sparkContext.broadcast(early)
    rows, mine = src.filter(F.col("fold") == WEIGH).select("block", "text"), known.filter(F.length("keep") > 0).select("block", "part", "keep")
    rest = rows.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(_cells(early), "bucket bigint, ratio bigint, n bigint")
    rest = rest.groupBy("bucket", "ratio").agg(F.sum("n").alias("n")).toArrow()
    cells.append(tuple(rest.column(x).to_numpy() for x in ("bucket", "ratio", "n")))
    with_pairs(m, keep + held, pair_weights(*(np.concatenate(x) for x in zip(*cells, strict=True))))
    return m, known.select("block", "part", "n")


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (row_key, text, ...) with a block instead of the row_key."""
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = 1 + size // BLOCK_BYTES
    out = rows.withColumn("block", F.pmod("row_key", F.lit(n)).cast("int")).drop("row_key")
    out._blocks = n
    return out


def score_texts(docs: DataFrame, held_out: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows with ``held_out`` are scored and not learned from.
    """
    held = (F.lit(False) if held_out is None else held_out).alias("held_out")
    src = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.coalesce(F.col(text), F.lit("")).alias("text"), held)
    tenth = F.pmod(F.xxhash64("row_key", F.lit("lm")), F.lit(10)) == 0
    src = in_blocks(src.withColumn("fold", F.when(F.coalesce("held_out", F.lit(True)), SCORE).when(tenth, WEIGH).otherwise(LEARN)))
    model, known = fit(src)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(src.dtypes)["doc_id"]
    return src.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        _scores(shared), f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
