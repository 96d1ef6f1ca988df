"""Exact byte-level BPE token counts at every prefix of a text, by prefix dynamic programming.

The tokenizer splits a text into pieces by a fixed pattern and merges bytes
inside each piece.  Inside a piece, the merge rules give every prefix a unique
last token: the one that, after the tokens of the prefix before it, stays
unmerged.  So ``count[i] = count[i - len(last token)] + 1``, one table per piece.
A text's prefix counts are running totals over its pieces plus the table of the
piece that is cut; the few cuts that change the pieces before them (runs of
white space, contractions, special tokens) are counted anew from where they
change, never from the start.

Truncating a text to a token budget, counting the tokens of a prefix and testing
a limit are lookups in this array; the text is not encoded again.  Tables of
short pieces are kept per worker, ``CACHE`` of them at most.

Defined results: a null text counts as empty (0 bytes, 0 tokens); white space alone
has tokens; very long pieces cost their length times the longest token; rows
alike get like results; empty tables give no rows.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t

PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the byte-level splitting pattern
_WHITE = regex.compile(r"\s+")
CACHE, CACHED_LENGTH = 1_000_000, 64


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which a vocabulary file writes bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class _Totals(dict):
    """Token totals of pieces, computed when first asked for."""

    def __init__(self, run):
        super().__init__()
        self.run = run

    def __missing__(self, piece: str) -> int:
        n = self.run(piece.encode("utf-8"))[-1]
        if len(piece) <= CACHED_LENGTH and len(self) < CACHE:
            self[piece] = n
        return n


def _white(s: str) -> bool:
    return _WHITE.fullmatch(s) is not None


class PrefixCounter:
    """Prefix counts with the merges of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        plain = (model["type"] == "BPE" and spec.get("normalizer") is None and pre["type"] == "ByteLevel" and not pre.get("add_prefix_space")
                 and pre.get("use_regex", True) and not model.get("dropout") and not model.get("ignore_merges")
                 and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
        added = [a for a in spec.get("added_tokens", [])]
        if not plain or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("prefix counts need a plain byte-level BPE vocabulary")
        back = byte_alphabet()
        raw = lambda s: bytes(back[c] for c in s)
        skip = {a["content"] for a in added if a.get("special")}
        self.vocab = {raw(s): i for s, i in model["vocab"].items() if s not in skip}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        # how the merges build each token: its last merge and its parts
        self.parts: dict[bytes, tuple[int, bytes, bytes]] = {}
        for (a, b), k in self.rank.items():
            self.parts.setdefault(a + b, (k, a, b))
        self.vocab = {b: i for b, i in self.vocab.items() if len(b) == 1 or self._reachable(b)}
        self.longest = max(map(len, self.vocab))
        self.tails = {b[k:] for b in self.vocab for k in range(len(b))}
        self.special = [a["content"] for a in added]
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.tables: dict[str, np.ndarray] = {}
        self.total = _Totals(self._run).__getitem__
        self.fits: dict[tuple[bytes, bytes], bool] = {}

    def _merge(self, piece: bytes) -> list[bytes]:
        """Plain merging of a short byte string: used on tokens themselves, not on texts."""
        parts = [piece[k: k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: (self.rank.get((parts[k], parts[k + 1]), 1 << 60), k))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best: best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _reachable(self, token: bytes) -> bool:
        return self._merge(token) == [token]

    def _compatible(self, a: bytes, b: bytes) -> bool:
        """Tokens ``a`` then ``b`` are what merging their bytes gives: no rule joins across their border.

        Both are undone merge by merge, latest first; a rule between the bytes that
        then touch must not come before the merge that was undone (earlier or, at
        equal rank, to its left).
        """
        key = (a, b)
        got = self.fits.get(key)
        if got is None:
            got = self._no_merge_across(a, b)
            if len(self.fits) < 2_000_000:
                self.fits[key] = got
        return got

    def _no_merge_across(self, a: bytes, b: bytes) -> bool:
        limit = 1 << 60
        while True:
            across = self.rank.get((a, b), 1 << 60)
            if across < limit:
                return False
            ra = self.parts[a][0] if len(a) > 1 else -1
            rb = self.parts[b][0] if len(b) > 1 else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the later merge is undone first
                limit, a = ra, self.parts[a][2]
            else:  # of equal merges the left one comes first, so one across would precede this one
                limit, b = rb + 1, self.parts[b][1]

    def _run(self, raw: bytes) -> list[int]:
        """The dynamic programme over one piece: token count after each byte."""
        n = len(raw)
        count, last = [0] * (n + 1), [b""] * (n + 1)
        vocab, fits, tails, longest = self.vocab, self.fits, self.tails, self.longest
        for i in range(1, n + 1):
            low = i - 1  # the longest byte string that ends here and ends some token
            stop = max(0, i - longest)
            while low > stop and raw[low - 1: i] in tails:
                low -= 1
            for start in range(low, i):
                tok = raw[start:i]
                if tok in vocab:
                    if start:
                        prev = last[start]
                        ok = fits.get((prev, tok))
                        if ok is None:
                            ok = self._compatible(prev, tok)
                        if not ok:
                            continue
                    last[i], count[i] = tok, count[start] + 1
                    break
        return count

    def table(self, piece: str) -> np.ndarray:
        """Token count after each byte of one piece (length bytes + 1)."""
        got = self.tables.get(piece)
        if got is None:
            got = np.array(self._run(piece.encode("utf-8")), dtype=np.int32)
            if len(piece) <= CACHED_LENGTH and len(self.tables) < CACHE // 4:
                self.tables[piece] = got
        return got

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special tokens: (piece of text, is special)."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            return [(text, False)] if text else []
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            if m.start() > at:
                out.append((text[at: m.start()], False))
            out.append((m.group(), True))
            at = m.end()
        return [*out, (text[at:], False)] if at < len(text) else out

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last prefix count, from piece totals."""
        return sum(1 if special else sum(map(self.total, self.pieces.findall(part))) for part, special in self.segments(text))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact token count of text[:i] for every i in 0..len(text) (code points)."""
        out = np.zeros(len(text) + 1, dtype=np.int32)
        base, start = 0, 0
        border = (0, 0)  # where the last piece that is not white space begins, and the count there
        for part, special in self.segments(text):
            if special:
                # a cut inside a special token leaves ordinary text, which continues the pieces before it
                tail, before = border
                for k in range(1, len(part)):
                    out[start + k] = before + sum(map(self.total, self.pieces.findall(text[tail: start + k])))
                base += 1
                out[start + len(part)] = base
                border = (start + len(part), base)
            else:
                base, border = self._ordinary(part, start, base, out)
            start += len(part)
        return out

    def _ordinary(self, part: str, start: int, base: int, out: np.ndarray) -> tuple[int, tuple[int, int]]:
        """Fill in the counts of ordinary text that begins at ``start`` after ``base`` tokens.

        Returns the count at its end, and the last border before which no continuation changes a piece.
        """
        border = (start, base)
        run = None  # of white space that reaches the present piece: where it begins, and the count there
        for m in self.pieces.finditer(part):
            p, at = m.group(), m.start()
            tab = self.table(p)
            ends = slice(1, None) if p.isascii() else np.cumsum([len(c.encode("utf-8")) for c in p])
            out[start + at + 1: start + m.end() + 1] = base + tab[ends]
            if _white(p):
                run = run or (at, base)
                for k in range(at + 1, m.end() + 1) if run[0] < at else ():
                    out[start + k] = run[1] + self.total(part[run[0]: k])  # cut here, the run is one piece
            else:
                if run and _white(p[0]):  # cut after the one space that this piece took
                    out[start + at + 1] = run[1] + self.total(part[run[0]: at + 1])
                run = None
                border = (start + at, base)
                if p in ("'re", "'ve", "'ll"):  # cut inside 're, 've or 'll, the quote and the letter are two pieces
                    out[start + at + 2] = base + self.total("'") + self.total(p[1])
            base += int(tab[-1])
        return base, border


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _totals(path: str):
    def run(batches):
        c = counter(path)
        for rows, _, offs in t.text_slices(batches):
            texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
            n = np.array([c.count(x) if x else 0 for x in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offs)), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes (UTF-8), n_tokens.  ``path`` is a file that every executor has."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(_totals(path), f"doc_id {dict(src.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint")


def _prefixes(path: str):
    def run(batches):
        c = counter(path)
        for rows, _, _ in t.text_slices(batches, limit=1 << 20):
            texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([c.prefix_counts(x or "") for x in texts], type=pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])
    return run


def prefix_table(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, prefix_tokens): entry i is the exact token count of the first i code points."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(_prefixes(path), f"doc_id {dict(src.dtypes)['doc_id']}, prefix_tokens array<int>")


def tokens_of_prefix(prefix_tokens, n_chars):
    """Tokens of the first ``n_chars`` code points, as a Column over a stored table."""
    return F.get(prefix_tokens, F.least(n_chars, F.size(prefix_tokens) - 1))


def longest_prefix(prefix_tokens, budget):
    """Code points of the longest prefix with at most ``budget`` tokens (counts may fall as a text grows)."""
    return F.array_max(F.transform(prefix_tokens, lambda c, i: F.when(c <= budget, i)))
