"""Tokenizer alignment against a plain version, groups rebuilt from their text, and the corner cases."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest

from cohortflow.llm import alignment
from cohortflow.llm.alignment import align_tokenizers, encoder, token_groups

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plain_tokens(text):
    """(ids, byte strings) of both sides, straight from the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    global _tools
    if "_tools" not in globals():
        t = Tokenizer.from_file(A)
        t.encode_special_tokens = True
        _tools = t, sentencepiece.SentencePieceProcessor(model_file=B)
    t, s = _tools
    back = alignment.byte_alphabet()
    a = t.encode(" " + text, add_special_tokens=False).ids
    b = s.encode(text)
    piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    return (a, [bytes(back[c] for c in t.id_to_token(i)) for i in a]), (b, [piece(s.id_to_piece(i)) for i in b])


def plain_groups(text):
    if not text:
        return []
    (a, ab), (b, bb) = plain_tokens(text)
    if b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
        return []
    ends = lambda parts: np.cumsum([len(x) for x in parts]).tolist()
    ea, eb = ends(ab), ends(bb)
    out, lo = [], 0
    for cut in sorted(set(ea) & set(eb)):
        out.append(([i for i, e in zip(a, ea) if lo < e <= cut], [i for i, e in zip(b, eb) if lo < e <= cut]))
        lo = cut
    return out


def brute(rows):
    groups = [plain_groups(text) for _, text in rows]
    linked = [collections.Counter((x, y) for ga, gb in g for x in ga for y in gb) for g in groups]
    count = collections.Counter(p for own in linked for p in own)
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (i, _), g, own in zip(rows, groups, linked, strict=True):
        s = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        out.append((i, sum(len(ga) for ga, _ in g), sum(len(gb) for _, gb in g), len(g), sum(own.values()), sum(n for p, n in own.items() if count[p] == top[p[0]]),
                    sum(n * count[p] for p, n in own.items()), hashlib.sha256(s.encode()).hexdigest() if s else ""))
    return out


TEXTS = ["Hello  world", " leading and trailing ", "naïve café über Straße", "日本語のテキスト、句読点。", "😀😃🧪 emoji👩‍👩‍👧", "tabs\tand\nlines\r\n\r\n  x", "a", "▁ a literal space mark",
         "<s> </s> <unk> <|endoftext|> special strings", "ﬁ ligature é combining", "x" * 3000, "    " * 50, "def f(x):\n        return x ** 2  # ok\n", "\x00 nul", "0123456789" * 30,
         "ÀÉÎÕÜ ñ", "한국어 텍스트", "עִברִית", "﻿bom", "​​ zero width", None, ""]


@pytest.mark.parametrize("block", [alignment.BLOCK, 200])
def test_matches_the_plain_version(spark, block):
    """All texts in one block a task, and in many blocks."""
    rows = [(k, x) for k, x in enumerate(TEXTS * 2)] + [(None, "Hello  world"), (None, None), (7, "Hello  world"), (7, "Hello  world")]
    docs = spark.createDataFrame([(i, x, "own", 1, 2) for i, x in rows], "doc_id long, text string, block string, code int, n int").repartition(3)
    got = [tuple(r) for r in align_tokenizers(docs, A, B, block=block).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("encoded, pairs, wide", [(1 << 18, 1 << 22, 1024), (64, 50, 4), (1, 1, 0)])
def test_pairs_and_texts_in_parts(monkeypatch, encoded, pairs, wide):
    """Few texts encoded at a time, few pairs written out at a time, and wide groups whose ids are counted first."""
    for name, value in (("ENCODED", encoded), ("PAIRS", pairs), ("WIDE", wide)):
        monkeypatch.setattr(alignment, name, value)
    offs = np.concatenate([[0], np.cumsum([len((x or "").encode()) for x in TEXTS])])
    data = "".join(x or "" for x in TEXTS).encode()
    ea, eb = encoder(A), encoder(B)
    a, b = alignment.Side(ea, TEXTS, offs), alignment.Side(eb, TEXTS, offs)
    ok = alignment._given_back(a, b, data, offs)
    assert ok.tolist() == [bool(plain_groups(x)) for x in TEXTS] and 0 < ok.sum() < len(ok)
    a.keep(ea, ok)
    b.keep(eb, ok)
    al = alignment.Aligned(a, b)
    want = [plain_groups(x) for x in TEXTS]
    texts = al.texts(len(TEXTS), alignment.id_names(ea.size, eb.size), ea.size, eb.size)
    assert [x.decode() for x in texts] == [";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g) for g in want]
    found = collections.Counter()
    for r in al.pairs(eb.size).to_pylist():
        found[r["row"], r["code"] // eb.size, r["code"] % eb.size] += r["times"]
    assert found == collections.Counter((k, x, y) for k, g in enumerate(want) for ga, gb in g for x in ga for y in gb)


def test_groups_hold_all_tokens(spark, sf_dir):
    """Round trip: the groups' ids, read back from their text, spell the documents on both sides."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    back_a, back_b = encoder(A).bytes.to_pylist(), encoder(B).bytes.to_pylist()
    seen = 0
    for r in token_groups(docs, A, B).collect():
        assert (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") == r["groups_sha256"]
        if not r["groups"]:
            continue
        joined = [b"", b""]
        for g in r["groups"].split(";"):
            sides = [b"".join(back[int(i)] for i in part.split(",")) for part, back in zip(g.split("|"), (back_a, back_b), strict=True)]
            assert sides[0] == sides[1]
            joined = [x + y for x, y in zip(joined, sides, strict=True)]
        assert joined[0] == joined[1] and texts[r["doc_id"], joined[0].decode()[1:]] >= 1
        seen += 1
    assert seen > 190


def test_query_matches_the_plain_version(spark, sf_dir):
    from cohortflow.llm import registry

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r) for r in registry.op12_align_tokenizers(spark, sf_dir).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_long_texts_and_empty_tables(spark):
    long = " ".join(f"word{k % 977}" for k in range(60_000)) + "日" * 5000
    docs = spark.createDataFrame([("a", long), ("b", long), (None, "")], "name string, body string")
    got = {r["doc_id"]: r for r in align_tokenizers(docs, A, B, "name", "body", block=1000).collect()}
    assert tuple(got["a"])[1:] == tuple(got["b"])[1:] and got["a"]["n_best"] > 0 and got["a"]["count_sum"] == 2 * got["a"]["n_links"]
    assert tuple(got[None])[1:] == (0, 0, 0, 0, 0, 0, "")
    assert align_tokenizers(docs.limit(0), A, B, "name", "body").count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in align_tokenizers(only, A, B).collect()) == [(1, 0, 0), (2, 0, 0)]
