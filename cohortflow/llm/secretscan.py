"""Secret scan: fixed patterns, and probabilistic automata inferred from the credentials that they label.

1. Three patterns (``assign``, ``access``, ``hex``) are looked for in whole texts, leftmost
   and without overlap per kind.  Their values are the labelled credentials of each kind;
   every other long run of value characters is an ordinary string.
2. Of each label at most ``sample`` distinct strings, those of the least hashes over the
   whole corpus, are learned from (a bounded sample of labelled rows).  Grammar inference
   (state merging): the strings' prefix tree is folded by joining states whose ending
   and next-symbol frequencies agree within Hoeffding bounds, recursively.
   Symbols are character classes; a class's characters are alike likely.
3. Every candidate (run of ``MIN_LENGTH`` value characters or more that no pattern covers)
   of every text is scored by its log-likelihood under each kind's automaton
   less that under the ordinary one.  One beyond the limit is a span of kind
   ``like_<kind>``.

Each task keeps the least hashes of its strings, so what is shuffled and collected
is bounded by ``sample``; the corpus itself is only read, twice.

Defined results: null and empty texts have no spans; rows alike get like spans;
a kind with fewer than ``MIN_STRINGS`` distinct strings has no automaton; null ids
stay null; extra columns are not read, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import discard, materialize

#: The patterns of the base kinds and the least length of each (group 2 of ``assign``).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = tuple(LEAST)

MIN_LENGTH = 16  # characters of a candidate
SAMPLE = 2000  # distinct strings of a label that the automata learn from
MIN_STRINGS = 20
CONFIDENCE = 0.05  # of the Hoeffding bounds
FALSE_RATE = 0.001  # chance of an ordinary string to pass the limit
MOST_UNLABELLED = 0.05  # share of ordinary strings that may be credentials without a label
ORDINARY = "ordinary"

_HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs of HEX that are long enough
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_LENGTH)

# symbols: classes of value characters
_CLASSES = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-"]
_SYMBOL = {ch: k for k, chars in enumerate(_CLASSES) for ch in chars}
_SIZE = np.array([len(chars) for chars in _CLASSES], dtype=float)
_OF_BYTE = np.zeros(256, dtype=np.int8)
for _ch, _k in _SYMBOL.items():
    _OF_BYTE[ord(_ch)] = _k
END = len(_CLASSES)  # the symbol of a string's end


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in ``KINDS``, end, value) of the base kinds, in code points, by start and kind."""
    assigns = ASSIGN.finditer(text) if ":" in text or "=" in text else ()  # no match lacks both
    out = [(m.start(), 0, m.end(), m.group(2)) for m in assigns if len(m.group(2)) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), m.group()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: s[:2])


def candidates(text: str, found) -> list[tuple[int, int, str]]:
    """(start, end, string) of the long runs of value characters that no base span touches; full stops at their ends are not theirs."""
    out, k = [], 0
    taken = sorted((s[0], s[2]) for s in found)
    for m in _CANDIDATE.finditer(text):
        run = m.group()
        start = m.start() + len(run) - len(run.lstrip("."))
        run = run.strip(".")
        end = start + len(run)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if len(run) >= MIN_LENGTH and not any(a < end and start < b for a, b in taken[k:k + 1]):
            out.append((start, end, run))
    return out


# ---------------------------------------------------------------- grammar inference

class Automaton:
    """A probabilistic automaton over ``_CLASSES``: next states and log probabilities, by state and symbol."""

    def __init__(self, step: np.ndarray, logp: np.ndarray):
        self.step, self.logp = step, logp

    def score(self, strings: list[bytes]) -> np.ndarray:
        """Log probability of each string and its end, all strings in step; a string's characters share their class's mass."""
        if not strings:
            return np.zeros(0)
        length = np.array([len(s) for s in strings])
        order = np.argsort(-length, kind="stable")
        offs = np.concatenate([[0], np.cumsum(length)])[:-1][order]
        data = _OF_BYTE[np.frombuffer(b"".join(strings), dtype=np.uint8)]
        state, total = np.zeros(len(strings), dtype=np.int64), np.zeros(len(strings))
        longest_first = length[order]
        live = len(strings)
        for k in range(int(longest_first[0])):
            while longest_first[live - 1] <= k:
                live -= 1
            symbol = data[offs[:live] + k]
            total[:live] += self.logp[state[:live], symbol]
            state[:live] = self.step[state[:live], symbol]
        total += self.logp[state, END]
        out = np.empty(len(strings))
        out[order] = total
        return out


class _Folding:
    """The prefix tree of some strings, folded by merging compatible states (state 0 is its root)."""

    def __init__(self, strings: list[str], confidence: float):
        self.next: list[dict[int, int]] = [{}]
        self.through: list[dict[int, int]] = [{}]
        self.ends, self.visits = [0], [0]
        self.bound = math.sqrt(0.5 * math.log(2.0 / confidence))
        for s in strings:
            at = 0
            self.visits[0] += 1
            for ch in s:
                k = _SYMBOL[ch]
                if k not in self.next[at]:
                    self.next[at][k] = len(self.next)
                    self.next.append({})
                    self.through.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                self.through[at][k] = self.through[at].get(k, 0) + 1
                at = self.next[at][k]
                self.visits[at] += 1
            self.ends[at] += 1

    def _far(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (n ** -0.5 + m ** -0.5)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the states' endings and successions agree, and those of their successors."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            n, m = self.visits[p], self.visits[q]
            if self._far(self.ends[p], n, self.ends[q], m):
                return False
            for k in self.next[p].keys() | self.next[q].keys():
                if self._far(self.through[p].get(k, 0), n, self.through[q].get(k, 0), m):
                    return False
                if k in self.next[p] and k in self.next[q]:
                    todo.append((self.next[p][k], self.next[q][k]))
        return True

    def fold(self, keep: int, gone: int) -> None:
        """Adds the tree below ``gone`` to that of ``keep``."""
        todo = [(keep, gone)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            self.visits[p] += self.visits[q]
            for k, child in self.next[q].items():
                self.through[p][k] = self.through[p].get(k, 0) + self.through[q][k]
                if k in self.next[p]:
                    todo.append((self.next[p][k], child))
                else:
                    self.next[p][k] = child

    def run(self) -> list[int]:
        """Merges until every state that is left is kept; the kept states, root first."""
        kept = [0]
        while True:
            rim = [(self.visits[child], -child, state, k) for state in kept for k, child in self.next[state].items() if child not in kept]
            if not rim:
                return kept
            _, child, state, k = max(rim)  # the state seen most often first; ties to the first made
            child = -child
            match = next((old for old in kept if self.compatible(old, child)), None)
            if match is None:
                kept.append(child)
            else:
                self.next[state][k] = match
                self.fold(match, child)


def infer(strings: list[str], confidence: float = CONFIDENCE) -> Automaton:
    """The automaton that state merging infers from distinct strings, smoothed by half a count for each symbol."""
    tree = _Folding(sorted(strings), confidence)
    kept = tree.run()
    place = {s: k for k, s in enumerate(kept)}
    step = np.zeros((len(kept), END), dtype=np.int64)
    count = np.full((len(kept), END + 1), 0.5)
    for s, k in place.items():
        count[k, END] += tree.ends[s]
        for symbol, child in tree.next[s].items():
            step[k, symbol] = place[child]
            count[k, symbol] += tree.through[s][symbol]
    logp = np.log(count / count.sum(axis=1, keepdims=True))
    logp[:, :END] -= np.log(_SIZE)
    return Automaton(step, logp)


class Formats:
    """Automata of the kinds and of ordinary strings.

    Ordinary strings may hold credentials that no pattern labels.  Those likelier under a kind's
    automaton than under the first ordinary one are taken out before that is inferred again.  Where they
    are more than ``most_unlabelled`` of the ordinary strings kept out of the fit, the kind's values have
    no format of their own (words, say) and the kind adds no spans.
    A string of the ordinary automaton passes the limit ``log(1 / false_rate)`` on its log-likelihood ratio
    with a probability of ``false_rate`` at most, as the ratio's mean is 1.
    """

    def __init__(self, labelled: dict[str, list[str]], false_rate: float = FALSE_RATE, most_unlabelled: float = MOST_UNLABELLED):
        held = lambda s: xxhash.xxh64_intdigest(s, seed=1) % 4 == 0
        plain = labelled.get(ORDINARY) or ["a"]
        self.limit = math.log(1.0 / false_rate)
        self.kinds = [kind for kind in KINDS if len(labelled.get(kind, [])) >= MIN_STRINGS]
        self.automata = [infer(labelled[kind]) for kind in self.kinds]
        self.ordinary = infer([s for s in plain if not held(s)] or plain)
        raw = [s.encode() for s in plain]
        ratios = [a.score(raw) - self.ordinary.score(raw) for a in self.automata]
        unseen = np.array([held(s) for s in plain]) if any(map(held, plain)) else np.ones(len(plain), dtype=bool)
        told = [k for k, ratio in enumerate(ratios) if (ratio[unseen] > 0).mean() <= most_unlabelled]
        self.kinds, self.automata = [self.kinds[k] for k in told], [self.automata[k] for k in told]
        if told:
            rest = np.max([ratios[k] for k in told], axis=0) <= 0
            self.ordinary = infer([s for s, ok in zip(plain, rest, strict=True) if ok] or plain)

    def score(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(best kind's place in ``kinds``, log-likelihood ratio) of each string."""
        if not self.kinds or not strings:
            return np.zeros(len(strings), dtype=np.int64), np.full(len(strings), -np.inf)
        each = np.array([a.score(strings) for a in self.automata])
        return each.argmax(axis=0), each.max(axis=0) - self.ordinary.score(strings)


# ---------------------------------------------------------------- over the corpus

def _labels(sample: int):
    def run(batches):
        least: dict[str, dict[str, int]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                found = base_spans(text)
                seen = [(KINDS[s[1]], s[3]) for s in found] + [(ORDINARY, s[2]) for s in candidates(text, found)]
                for label, value in seen:
                    own = least.setdefault(label, {})
                    if value not in own:
                        own[value] = xxhash.xxh64_intdigest(value) >> 1
                        if len(own) > 4 * sample:
                            least[label] = dict(heapq.nsmallest(sample, own.items(), key=lambda x: (x[1], x[0])))
        for label, own in least.items():
            rows = heapq.nsmallest(sample, own.items(), key=lambda x: (x[1], x[0]))
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(rows)), pa.array([v for v, _ in rows]), pa.array([h for _, h in rows], pa.int64())],
                                             names=["label", "value", "h"])
    return run


def labelled_strings(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict[str, list[str]]:
    """Of each label the ``sample`` distinct strings of least hash in the corpus."""
    found = docs.select(F.col(text).alias("text")).mapInArrow(_labels(sample), "label string, value string, h bigint")
    found = materialize(found, "secret-labels")
    distinct = found.dropDuplicates(["label", "value"])
    parts = [distinct.filter(F.col("label") == label).orderBy("h", "value").limit(sample) for label in (*KINDS, ORDINARY)]
    out: dict[str, list[str]] = {}
    for r in reduce(DataFrame.unionAll, parts).collect():  # at most ``sample`` strings of each of four labels
        out.setdefault(r["label"], []).append(r["value"])
    discard(found)
    return out


_SPAN = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"


def _scan(formats: Formats):
    names = list(KINDS) + [f"like_{kind}" for kind in formats.kinds]

    def run(batches):
        for batch in batches:
            rows, strings = [], {}
            for text in batch.column(1).to_pylist():
                found = base_spans(text) if text else []
                more = candidates(text, found) if text else []
                rows.append((found, more))
                for *_, value in more:
                    strings.setdefault(value.encode(), len(strings))
            best, score = formats.score(list(strings))
            spans = []
            for found, more in rows:
                own = [(start, kind, end, None) for start, kind, end, _ in found]
                for start, end, value in more:
                    k = strings[value.encode()]
                    if score[k] > formats.limit:
                        own.append((start, len(KINDS) + int(best[k]), end, float(score[k])))
                spans.append([{"kind": names[kind], "start": start, "end": end, "score": s} for start, kind, end, s in sorted(own, key=lambda x: x[:2])])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])
    return run


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, false_rate: float = FALSE_RATE) -> DataFrame:
    """One row per row of ``docs``: doc_id and its spans (kind, start, end in code points, score), by start and kind.

    Base spans have no score; that of a ``like_`` span is its log-likelihood ratio.
    """
    formats = Formats(labelled_strings(docs, text, sample), false_rate)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(_scan(formats), f"doc_id {dict(src.dtypes)['doc_id']}, spans {_SPAN}")


def joined(spans) -> F.Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, spans of each base kind, the digest of the base spans and all spans as text."""
    n_of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: reduce(or_, [s["kind"] == kind for kind in KINDS]))
    return found.select("doc_id", *[n_of(kind) for kind in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
