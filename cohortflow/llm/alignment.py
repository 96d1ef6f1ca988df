"""Alignment of two tokenizers over a corpus, in Arrow.

Each text is encoded by both tokenizers.  Byte offsets at which a token of either
side ends cut its bytes into groups, the smallest parts that both sides write with
whole tokens.  Every token of one side is linked with every token of the other
side in its group, and a pair of ids is counted by the documents that hold it linked.

On each slice of rows: list flatten and parent indices give one row per token,
segmented cumulative sums of token lengths their ends, and an Acero hash join on
(document, end) the common ends.  ``Table.group_by`` counts each document's linked pairs,
and then each block's documents of a pair.  Spark merges these partial counts by pair,
finds each first id's highest count, and sends every block the counts of its own
pairs, where they are summed up over the links of each document.

A pair travels as one number, ``a * size of b's vocabulary + b``.  A block holds
``BLOCK`` bytes of text (one longer text is a block of its own), so no task holds
more than a block, whatever a pair's frequency; nothing is broadcast or collected.

Defined results: null and empty texts, and texts that one tokenizer does not give back byte by
byte (after the space put before them), have no tokens: zeros and an empty digest.
Rows alike count as documents of their own; null ids stay null; extra columns are
not read, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as t
from ._tables import discard, materialize
from .tokencounts import PIECES, PrefixCounter, byte_alphabet

BLOCK = 4 << 20  # bytes of text whose pairs are counted together
SLICE = 1 << 20  # bytes of text that are aligned at a time
ENCODED = 1 << 18  # bytes of text that are encoded at a time
PAIRS = 1 << 22  # links that are written out at a time
WIDE = 1024  # links of a group from which its ids are counted first

SPACE = "▁"  # how a piece vocabulary writes a space


class Encoder:
    """A tokenizer file (.json or .model): ids of texts, and the bytes of each id.

    A plain byte-level vocabulary whose ids follow its merges' order is run by the faster of the two
    libraries that know such vocabularies; ids that no merging reaches are left out, so both give the same.
    """

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            entries = [self._piece(self.model.id_to_piece(k), self.model.is_byte(k)) for k in range(self.model.get_piece_size())]
            self.encode_all = lambda texts: self.model.encode(texts, num_threads=1)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task is one thread
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.encode_special_tokens = True  # their strings in a text are plain text
            back = byte_alphabet()
            names = {i: s for s, i in self.model.get_vocab(with_added_tokens=True).items()}
            entries = [bytes(back[ch] for ch in names.get(k, "") if ch in back) for k in range(max(names, default=-1) + 1)]
            ranked = self._ranked(path)
            self.encode_all = ranked or (lambda texts: [e.ids for e in self.model.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)])
        self.bytes = pa.array(entries, pa.large_binary())
        self.length = np.array([len(e) for e in entries], dtype=np.int64)
        self.size = len(entries)

    @staticmethod
    def _piece(piece: str, one_byte: bool) -> bytes:
        return bytes([int(piece[3:5], 16)]) if one_byte else piece.replace(SPACE, " ").encode()

    @staticmethod
    def _ranked(path: str):
        """Encoding by ranks; None where the file is no such vocabulary."""
        try:
            plain = PrefixCounter(path)
        except ValueError:
            return None
        order = [plain.vocab[a + b] for (a, b), _ in sorted(plain.rank.items(), key=lambda x: x[1]) if a + b in plain.vocab]
        if order != sorted(order) or any(bytes([k]) not in plain.vocab for k in range(256)):
            return None
        import tiktoken

        model = tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks=plain.vocab, special_tokens={})
        return lambda texts: [model.encode_ordinary(" " + x) for x in texts]

    def encode(self, texts: list[str]) -> pa.Array:
        """A list of ids for each text."""
        return pa.array(self.encode_all(texts), pa.large_list(pa.int32()))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Side:
    """The tokens of one tokenizer on a slice of texts: ids, texts' places and ends, and where each text's tokens begin."""

    def __init__(self, enc: Encoder, texts: list[str | None], offs: np.ndarray):
        places = [k for k, x in enumerate(texts) if x]
        parts, lo = [], 0
        ends = np.cumsum([offs[k + 1] - offs[k] for k in places]) if places else np.zeros(0, dtype=np.int64)
        while lo < len(places):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ENCODED, side="right")))
            parts.append(enc.encode([texts[k] for k in places[lo:hi]]))
            lo = hi
        lists = pa.chunked_array(parts, pa.large_list(pa.int32())).combine_chunks()
        flat = pc.list_flatten(lists)
        self.ids = flat.to_numpy(zero_copy_only=False)
        self.row = np.array(places, dtype=np.int64)[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)] if places else np.zeros(0, dtype=np.int64)
        self._finish(enc, len(texts))
        self.raw = enc.bytes.take(flat)

    def _finish(self, enc: Encoder, n: int) -> None:
        self.bounds = np.searchsorted(self.row, np.arange(n + 1))
        total = np.concatenate([[0], np.cumsum(enc.length[self.ids])])
        self.before = total[self.bounds]  # token bytes before each text's own
        self.ends = total[1:] - self.before[self.row]

    def keep(self, enc: Encoder, ok: np.ndarray) -> None:
        """Leaves only the tokens of texts that are ``ok``."""
        if not ok.all():
            held = ok[self.row]
            self.ids, self.row = self.ids[held], self.row[held]
            self._finish(enc, len(ok))

    def text(self) -> bytes:
        """The bytes of all tokens, joined."""
        raw = self.raw.buffers()[2]
        return raw.to_pybytes()[: int(self.before[-1])] if raw is not None else b""

    def table(self, name: str) -> pa.Table:
        return pa.table({"row": self.row, "end": self.ends, name: np.arange(len(self.ids))})


def _given_back(a: Side, b: Side, data: bytes, offs: np.ndarray) -> np.ndarray:
    """Whether both sides' tokens of each text join to a space and the text."""
    n = len(offs) - 1
    ok = np.zeros(n, dtype=bool)
    joined = (a.text(), b.text())
    for k in range(n):
        size = int(offs[k + 1] - offs[k])
        if size and all(s.before[k + 1] - s.before[k] == size + 1 for s in (a, b)):
            want = b" " + data[offs[k]: offs[k + 1]]
            ok[k] = all(raw[s.before[k]: s.before[k + 1]] == want for s, raw in zip((a, b), joined, strict=True))
    return ok


class Aligned:
    """Groups of two sides' tokens: group g holds tokens a_from[g]:a_from[g + 1] and b_from[g]:b_from[g + 1]."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        cuts = a.table("a").join(b.table("b"), keys=["row", "end"], join_type="inner", use_threads=False)
        last_a, last_b = (np.sort(cuts[s].combine_chunks().to_numpy(zero_copy_only=False)) for s in "ab")
        self.row = a.row[last_a]
        self.a_from, self.b_from = (np.concatenate([[0], x + 1]).astype(np.int64) for x in (last_a, last_b))
        self.n_a, self.n_b = np.diff(self.a_from), np.diff(self.b_from)

    def per_row(self, values: np.ndarray, n: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        at = np.searchsorted(self.row, np.arange(n + 1))
        return total[at[1:]] - total[at[:-1]]

    def pairs(self, size_b: int) -> pa.Table:
        """(row, code, times): how often each pair of ids is linked in each text."""
        links = self.n_a * self.n_b
        wide = np.flatnonzero(links > WIDE)
        plain = np.flatnonzero(links <= WIDE)
        parts, lo = [], 0
        total = np.cumsum(links[plain])
        while lo < len(plain):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, side="right")))
            g = plain[lo:hi]
            each = np.repeat(g, links[g])
            k = np.arange(len(each)) - np.repeat(np.cumsum(links[g]) - links[g], links[g])
            code = self.a.ids[self.a_from[each] + k // self.n_b[each]].astype(np.int64) * size_b + self.b.ids[self.b_from[each] + k % self.n_b[each]]
            parts.append(_counted(pa.table({"row": self.row[each], "code": code, "times": np.ones(len(code), dtype=np.int64)})))
            lo = hi
        for g in wide:  # a group of many tokens: its ids are counted before they are paired, some of one side at a time
            ua, na = np.unique(self.a.ids[self.a_from[g]: self.a_from[g + 1]], return_counts=True)
            ub, nb = np.unique(self.b.ids[self.b_from[g]: self.b_from[g + 1]], return_counts=True)
            step = max(1, PAIRS // len(ub))
            for k in range(0, len(ua), step):
                code = (ua[k: k + step, None].astype(np.int64) * size_b + ub).ravel()
                parts.append(pa.table({"row": np.full(len(code), self.row[g]), "code": code, "times": (na[k: k + step, None] * nb).ravel()}))
        empty = pa.table({"row": np.zeros(0, dtype=np.int64), "code": np.zeros(0, dtype=np.int64), "times": np.zeros(0, dtype=np.int64)})
        out = _counted(pa.concat_tables(parts)) if len(parts) > 1 else parts[0] if parts else empty
        return out.take(np.argsort(out["row"].to_numpy(), kind="stable"))

    def texts(self, n: int, names: pa.Array, size_a: int, size_b: int) -> list[bytes]:
        """``a1,a2|b1;...`` of each text; ``names`` holds the ids with what follows them (see ``id_names``)."""
        at_a = np.arange(len(self.a.ids)) + np.repeat(self.b_from[:-1], self.n_a)
        at_b = np.arange(len(self.b.ids)) + np.repeat(self.a_from[1:], self.n_b)
        which = np.empty(len(at_a) + len(at_b), dtype=np.int64)
        pick_a = self.a.ids.astype(np.int64)
        pick_a[self.a_from[1:] - 1] += size_a
        pick_b = self.b.ids.astype(np.int64)
        pick_b[self.b_from[1:] - 1] += size_b
        full = self.b.bounds[1:][np.diff(self.b.bounds) > 0] - 1  # the last token of each text
        pick_b[full] += size_b
        which[at_a], which[at_b] = pick_a, pick_b + 2 * size_a
        found = names.take(pa.array(which))
        offs = np.frombuffer(found.buffers()[1], dtype=np.int64)[: len(which) + 1]
        raw = found.buffers()[2].to_pybytes() if len(which) else b""
        cut = (offs if len(which) else np.zeros(1, dtype=np.int64))[self.a.bounds + self.b.bounds]
        return [raw[cut[k]: cut[k + 1]] for k in range(n)]


def _counted(pairs: pa.Table) -> pa.Table:
    return pairs.group_by(["row", "code"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["row", "code", "times"])


@lru_cache(maxsize=2)
def id_names(size_a: int, size_b: int) -> pa.Array:
    """Decimal ids with what follows them: a's inside a group, its last; b's inside a group, its last, the text's last."""
    return pa.array([f"{k}{end}" for size, ends in ((size_a, ",|"), (size_b, (",", ";", ""))) for end in ends for k in range(size)], pa.large_string())


def _code_type(codes: int) -> pa.DataType:
    return pa.int32() if codes <= 1 << 31 else pa.int64()


_FIELDS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def _encode(path_a: str, path_b: str, with_groups: bool, block_bytes: int):
    def run(batches):
        a_enc, b_enc = encoder(path_a), encoder(path_b)
        names = id_names(a_enc.size, b_enc.size)
        block, filled = TaskContext.get().partitionId() << 32, 0
        for rows, data, offs in t.text_slices(batches, limit=min(SLICE, block_bytes)):
            n = rows.num_rows
            if filled and filled + len(data) > block_bytes:
                block, filled = block + 1, 0
            filled += len(data)
            texts = rows.column(1).to_pylist()
            a, b = Side(a_enc, texts, offs), Side(b_enc, texts, offs)
            ok = _given_back(a, b, data.tobytes(), offs)
            a.keep(a_enc, ok)
            b.keep(b_enc, ok)
            al = Aligned(a, b)
            groups = al.texts(n, names, a_enc.size, b_enc.size)
            pairs = al.pairs(b_enc.size)
            at = np.searchsorted(pairs["row"].to_numpy(), np.arange(n + 1)).astype(np.int32)
            code = pairs["code"].combine_chunks().cast(_code_type(a_enc.size * b_enc.size))
            lists = [pa.ListArray.from_arrays(pa.array(at), x) for x in (code, pairs["times"].combine_chunks())]
            columns = [rows.column(0), *(pa.array(x.astype(np.int64)) for x in (np.diff(a.bounds), np.diff(b.bounds), al.per_row(np.ones(len(al.row), dtype=np.int64), n),
                                                                                al.per_row(al.n_a * al.n_b, n))),
                       pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups])]
            labels = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            if with_groups:
                columns, labels = [*columns, pa.array([g.decode() for g in groups])], [*labels, "groups"]
            else:
                columns, labels = [*columns, pa.array(np.full(n, block)), *lists], [*labels, "block", "codes", "times"]
            yield pa.RecordBatch.from_arrays(columns, names=labels)
    return run


def _block_counts(batches):
    """How many documents of a block hold each pair, from their lists of distinct pairs."""
    for batch in batches:
        lists = batch.column(1)
        table = pa.table({"block": batch.column(0).take(pc.list_parent_indices(lists)), "code": pc.list_flatten(lists)})
        out = table.group_by(["block", "code"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["block", "code", "n"])
        yield from out.to_batches()


def _look_up(key, docs: pa.Table, found: pa.Table) -> pa.Table:
    """Sums of a block's pair counts over the links of each of its documents."""
    code = found["code"].to_numpy()
    code, at = np.unique(code, return_index=True)  # a block read in two parts asks twice
    count, best = found["count"].to_numpy()[at], found["best"].to_numpy(zero_copy_only=False)[at]
    lists, times = (docs[name].combine_chunks() for name in ("codes", "times"))
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    n = docs.num_rows
    where = np.searchsorted(code, pc.list_flatten(lists).to_numpy(zero_copy_only=False))
    times = pc.list_flatten(times).to_numpy(zero_copy_only=False)
    total = lambda x: np.concatenate([[0], np.cumsum(x)])[np.searchsorted(parent, np.arange(n + 1))]
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    sums = (times * best[where], times * count[where]) if len(where) else (times, times)
    for name, values in zip(("n_best", "count_sum"), sums, strict=True):
        out = out.append_column(name, pa.array(np.diff(total(values)).astype(np.int64)))
    return out


def token_groups(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, token, group and link counts, the digest of the groups and the groups themselves as ``a1,a2|b1;a3|b2,b3``."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(_encode(path_a, path_b, True, block), f"doc_id {dict(src.dtypes)['doc_id']}, {_FIELDS}, groups string")


def pair_counts(parts: DataFrame, size_b: int) -> DataFrame:
    """(code, count, best): documents that hold each pair, and whether no pair of its first id has more."""
    counts = parts.groupBy("code").agg(F.sum("n").alias("count"))
    of_a = Window.partitionBy(F.floor(F.col("code") / size_b))  # at most one row per id of the other side
    return counts.select("code", "count", (F.col("count") == F.max("count").over(of_a)).alias("best"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is its first id's most
    frequent), count_sum (of the pair counts over links) and groups_sha256."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = dict(src.dtypes)["doc_id"]
    size_b = encoder(path_b).size
    code = "int" if _code_type(encoder(path_a).size * size_b) == pa.int32() else "bigint"
    aligned = materialize(src.mapInArrow(_encode(path_a, path_b, False, block),
                                         f"doc_id {id_type}, {_FIELDS}, block bigint, codes array<{code}>, times array<bigint>"), "aligned")
    parts = materialize(aligned.select("block", "codes").mapInArrow(_block_counts, f"block bigint, code {code}, n bigint"), "pair-parts")
    found = parts.select("block", "code").join(pair_counts(parts, size_b), "code")
    summed = aligned.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_look_up, f"doc_id {id_type}, {_FIELDS}, n_best bigint, count_sum bigint")
    out = materialize(summed, "aligned-sums")
    discard(aligned, parts)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
