"""Each operator against brute force, and the corner cases: nulls, empty and long texts, ties, empty tables, clashing columns."""

import collections
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import _text as t
from cohortflow.llm import decontam, hostrep, langid, linededup, lmscore, mixing, ngramjoin, quality, registry, sitetree, tokencounts
from cohortflow.llm._components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, h int, node int, token string"


def docs_frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, x, lang, source, len(x) if x is not None else None, "own", 7, 8, "t") for i, x, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


def corner_rows():
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    return [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (None, "lone words here", None, None),
            (None, None, None, None), (2, None, "en", "b"), (3, "", "en", "b"), (4, " \t\n ", None, "b"), (5, long, "en", "a"), (6, "x", "de", "c")]


@pytest.fixture(scope="module")
def corners(spark):
    return docs_frame(spark, corner_rows())


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# ------------------------------------------------------------------ 1

def test_op1_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    want = con.execute(registry.ORACLE_SQL["op1_url_filter"]).df().sort_values("page_id").reset_index(drop=True)
    got = registry.op1_url_filter(spark, sf_dir).toPandas().sort_values("page_id").reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == float:
            assert np.allclose(got[c], want[c], atol=2e-6)
        else:
            assert got[c].where(got[c].notna(), None).tolist() == want[c].where(want[c].notna(), None).tolist()


def test_op1_takes_whole_numbers(spark, tmp_path):
    """A path of 19 digits and more names no document whose number begins alike."""
    urls = ["http://a.org/12", "http://a.org/1234567890123456781", "http://a.org/99999999999999999999", "http://a.org/x", None]
    spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(12, 1, 0), (123456789012345678, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["page_id"]: r["n_labelled"] for r in registry.op1_url_filter(spark, str(tmp_path)).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}


def test_op1_parts_and_rules(spark):
    cases = {"http://WWW.Example.com/en/x?y": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
             "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
             "http://a.com?q=/en/": ("a.com", "", None, "allow"), "http://a.net/fr/1#t": ("a.net", "/fr/1", "net/fr/", "block"),
             "http://example.com": ("example.com", "", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"),
             "ftp://x.org:80/Es/": ("x.org:80", "/Es/", None, "allow"), "http://mynet/es/": ("mynet", "/es/", None, "allow")}
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(cases)], "page_id long, url string, host int")
    out = hostrep.judge_urls(pages, spark.createDataFrame([], "url string, good boolean")).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in out] == list(cases.values())
    assert {r["good_rate"] for r in out} == {hostrep.NEUTRAL}


def test_op1_shrinks_and_blocks(spark):
    """A host with many bad pages is blocked, one with two bad pages is not: its domain holds it up."""
    rows = [(f"http://good.site.org/{k}", k % 10 != 0) for k in range(200)] + [(f"http://bad.spam.org/{k}", k % 20 == 0) for k in range(200)]
    rows += [("http://new.site.org/1", False), ("http://new.site.org/2", False), ("http://odd.org/1", None)]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    out = hostrep.judge_urls(pages, spark.createDataFrame(rows, "url string, good boolean")).groupBy("host").agg(
        F.min("verdict").alias("v"), F.max("good_rate").alias("r"), F.max("n_labelled").alias("n")).collect()
    got = {r["host"]: r for r in out}
    assert got["bad.spam.org"]["v"] == "block" and got["good.site.org"]["v"] == "allow" and got["new.site.org"]["v"] == "allow"
    assert 0 < got["new.site.org"]["r"] < got["good.site.org"]["r"] and got["odd.org"]["n"] == 0


# ------------------------------------------------------------------ 2

def brute_targets(sizes):
    """Water filling by rounds: sources above their cap are fixed, the rest share what is left by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_op2_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 5, 100, 5000]) for s in ["b", "a", "Z", "é", "日", None, "c"]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-9)


def test_op2_takes_near_target_and_reruns_agree(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), "en", rng.choice(["hot"] * 6 + ["b", "c", None])) for i in range(1500)]
    df = docs_frame(spark, rows)
    a, b = (mixing.mix_sources(d).select("doc_id", "size", "source_size", "target", "taken").toPandas().sort_values("doc_id").reset_index(drop=True)
            for d in (df, df.repartition(7)))
    assert a.equals(b)
    assert a["size"].tolist() == [len(WORD.findall(x)) for _, x, _, _ in rows]
    assert (a.taken <= 3 * a["size"]).all()
    for (_, target), g in a.groupby(["source_size", "target"]):
        assert abs(g.taken.sum() - target) <= 60


def test_op2_corners(spark, corners, nothing):
    out = mixing.mix_sources(corners).toPandas()
    assert len(out) == 9 and out["size"].tolist().count(0) == 4 and (out[out["size"] == 0].taken == 0).all()
    assert mixing.mix_sources(nothing).count() == 0


# ------------------------------------------------------------------ 3

def brute_links(rows, size=4, percent=85):
    sets = []
    for _, x, *_ in rows:
        w = WORD.findall(lower(x or ""))
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for k, r in enumerate(rows):
        ids[find(k)].append(r[0])
    return [len(s) for s in sets], [min((i for i in ids[find(k)] if i is not None), default=None) for k in range(len(rows))]


def near_rows(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 5, 8, 40, 90]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            k = rng.randrange(len(w))
            w[k:k + rng.choice([0, 1])] = [rng.choice(words)]
        text = " ".join(w)
        rows.append((i, text.upper() if rng.random() < 0.2 else text, "en", "s"))
    return rows + [(n, None, None, None), (n + 1, "", "en", "s"), (n + 2, " ", "en", "s")]


@pytest.mark.parametrize("list_rows", [8192, 2])
def test_op3_matches_brute_force(spark, monkeypatch, list_rows):
    """Also with lists that are salted into many parts."""
    monkeypatch.setattr(ngramjoin, "LIST_ROWS", list_rows)
    rows = near_rows(1)
    n, component = brute_links(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.near_duplicates(docs_frame(spark, rows)).collect()}
    assert got == {r[0]: (a, b) for r, a, b in zip(rows, n, component, strict=True)}
    assert len(set(component)) < 120


def test_op3_without_the_early_round(spark, monkeypatch):
    """The full join alone finds the same components: early links only save work."""
    monkeypatch.setattr(ngramjoin, "LIKELY", 1e9)
    rows = near_rows(2, 90)
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.near_duplicates(docs_frame(spark, rows)).collect()}
    assert got == dict(zip([r[0] for r in rows], brute_links(rows)[1], strict=True))


def test_op3_chain_is_one_component(spark):
    """Each text is linked with the next only: the component spans them all."""
    words = [f"w{k}" for k in range(150)]
    rows = [(i, " ".join(words[3 * i: 3 * i + 100]), "en", "s") for i in range(15)]
    n, component = brute_links(rows)
    assert set(component) == {0}
    assert {r["component_id"] for r in ngramjoin.near_duplicates(docs_frame(spark, rows)).collect()} == {0}


def test_op3_prefix_choice():
    assert ngramjoin.choose_matches(np.zeros(100), 100, 85) == (1, 16)
    costs = np.full(100, 50.0)
    assert ngramjoin.choose_matches(costs, 100, 85)[0] == ngramjoin.MAX_MATCH
    assert ngramjoin.choose_matches(np.zeros(1), 1, 85) == (1, 1)


def test_op3_corners(spark, corners, nothing):
    out = ngramjoin.near_duplicates(corners).toPandas()
    assert len(out) == 9 and (out.n_shingles == 0).sum() == 4
    kept = ngramjoin.drop_near_duplicates(corners)
    assert kept.columns == corners.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter([1, None, None, 2, 3, 4, 5, 6])
    assert ngramjoin.near_duplicates(nothing).count() == 0 and ngramjoin.drop_near_duplicates(nothing).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# ------------------------------------------------------------------ 4

@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_op4_every_prefix(vocabulary):
    from tokenizers import Tokenizer

    lib, mine = Tokenizer.from_file(vocabulary), tokencounts.PrefixCounter(vocabulary)
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "don't", "a", "the", "ing", "tion", "é", "ß", "日本", "1", "23", "!", "...", "<|", "|>",
            "<|endoftext|>", "<|endof", "😀", "\xa0", "\x85", "\x1c", "Ab", "\r\n", "_", "٣", "\x00"]
    for _ in range(300):
        s = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 14)))
        want = [len(lib.encode(s[:i], add_special_tokens=False).ids) for i in range(len(s) + 1)]
        assert mine.prefix_counts(s).tolist() == want, repr(s)
        assert mine.count(s) == want[-1]


def test_op4_counts_and_budgets(spark, sf_dir, vocabulary, corners, nothing):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    out = {r["doc_id"]: r for r in registry.op4_token_counts(spark, sf_dir).collect()}
    assert out.keys() == texts.keys()
    for i, x in texts.items():
        n = len(lib.encode(x, add_special_tokens=False).ids)
        assert (out[i]["n_bytes"], out[i]["n_tokens"], out[i]["over_limit"]) == (len(x.encode()), n, n > 512)
    small = spark.createDataFrame([(1, "the quick brown fox, don't jump"), (2, None)], "doc_id long, text string")
    table = tokencounts.prefix_table(small, vocabulary)
    r = table.select("doc_id", tokencounts.tokens_of_prefix(F.col("prefix_tokens"), F.lit(9)).alias("nine"),
                     tokencounts.longest_prefix(F.col("prefix_tokens"), F.lit(4)).alias("cut")).orderBy("doc_id").collect()
    text = "the quick brown fox, don't jump"
    assert r[0]["nine"] == len(lib.encode(text[:9]).ids)
    assert r[0]["cut"] == max(i for i in range(len(text) + 1) if len(lib.encode(text[:i]).ids) <= 4)
    assert (r[1]["nine"], r[1]["cut"]) == (0, 0)
    assert tokencounts.token_counts(corners, vocabulary).count() == 9 and tokencounts.token_counts(nothing, vocabulary).count() == 0


# ------------------------------------------------------------------ 5

def test_op5_held_out_accuracy(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    out = registry.op5_language_id(spark, sf_dir).collect()
    assert len(out) == len(lang)
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    assert np.mean([r["accepted"] for r in out]) >= 0.97


def test_op5_probabilities_sum_to_one():
    """Interpolated estimates of every order, for every language, add up to 1 over the alphabet of a context."""
    texts = {"x": "abab abba baba ab", "y": "cac acca cc a"}
    import pyarrow as pa

    counts = {}
    for name, s in texts.items():
        b = next(langid._counts([pa.RecordBatch.from_pydict({"text": [s] * 3, "lang": [name] * 3})]))
        g = np.frombuffer(b"".join(b.column("gram").to_pylist()), dtype=np.uint32).reshape(-1, langid.ORDER)
        counts[name] = (g, b.column("n").to_numpy())
    m = langid.build(counts)
    alphabet = [0, *map(ord, "abcq")]  # q stands for what no language has
    for context in ([0, 0, 0], [0, ord("a"), ord("b")], [ord("c"), ord("a"), ord("c")], [ord("z")] * 3):
        total = np.zeros(2)
        for s in alphabet:
            sym = np.array([*context, s], dtype=np.uint32)
            total += 2.0 ** m.log_probabilities(langid.gram_hashes(sym), np.array([3]))[0]
        assert total == pytest.approx(np.ones(2), abs=1e-5)


def test_op5_rejects_what_is_no_language(spark, sf_dir):
    rng = random.Random(1)
    rows = [(r["doc_id"], r["text"], r["lang"], "s") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    junk = [(10_000 + k, "".join(rng.choice("qxzjwvkбдж") for _ in range(300)), None, "s") for k in range(5)]
    none = [(20_000, None, "en", "s"), (20_001, "", "en", "s"), (20_002, "123 !!", "en", "s")]
    got = {r["doc_id"]: r for r in langid.identify(docs_frame(spark, rows + junk + none)).collect()}
    assert not any(got[i]["accepted"] for i, *_ in junk + none)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i, *_ in none)


def test_op5_learns_languages_of_few_long_texts(spark):
    """A language whose texts are all far above the budget is learned."""
    rng = random.Random(2)

    def text(alphabet, n):
        return " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(n))
    rows = [(k, text("abcdefg", 40), "x", "s") for k in range(60)] + [(100 + k, text("nopqrst", 4000), "y", "s") for k in range(3)]
    rows += [(200, text("nopqrst", 50), None, "s")]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs_frame(spark, rows), budget=50).collect()}
    assert [got[i] for i in (100, 101, 102, 200)] == ["y"] * 4 and got[3] == "x"


def test_op5_learns_languages_of_the_calibration_fold(spark):
    """A language whose texts all fall into the fold that calibrates is learned."""
    from cohortflow.llm._tables import row_key

    rng = random.Random(5)

    def text(alphabet, n):
        return " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(n))
    some = docs_frame(spark, [(k, text("nopqrst", 40), "y", "s") for k in range(60)])
    fold = F.pmod(F.xxhash64(row_key("doc_id", "text"), F.lit("fold")), F.lit(10))
    rows = some.filter(fold == 0).limit(2).unionAll(docs_frame(spark, [(100 + k, text("abcdefg", 40), "x", "s") for k in range(60)]))
    got = {(r["doc_id"] < 100, r["lang_pred"]) for r in langid.identify(rows).collect()}
    assert got == {(True, "y"), (False, "x")}


def test_op5_corners(spark, corners, nothing):
    assert langid.identify(corners).count() == 9
    assert langid.identify(nothing).count() == 0
    unlabelled = corners.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}


# ------------------------------------------------------------------ 6

def test_op6_base_counts_and_held_out_gain(spark, sf_dir):
    import math

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    count = collections.Counter()
    for i, x in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*WORD.findall(lower(x)), None])
    n, v = sum(count.values()), len(count)
    out = registry.op6_lm_score(spark, sf_dir).collect()
    assert {r["doc_id"] for r in out} == texts.keys()
    for r in out:
        tokens = [*WORD.findall(lower(texts[r["doc_id"]])), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op6_model_is_a_distribution():
    """Over all known tokens and one unknown, the mixture adds up to 1 in every context."""
    rng = np.random.default_rng(0)
    keep, held = (np.zeros((lmscore.BEGIN + 1, lmscore.CLASSES), dtype=np.int64) for _ in range(2))
    for table in (keep, held):
        table[rng.integers(0, 30, 400), rng.integers(0, 30, 400)] += rng.integers(1, 9, 400)
        table[:30, lmscore.RARE] += 5
        table[:30, lmscore.END] += 2
    rare = int((keep + held)[:, lmscore.RARE].sum())
    types = 31 + rare // 5
    m = lmscore.build_model(np.arange(30, dtype=np.uint64), np.arange(30), keep, held, [(3.0, 100.0), (0.0, 50.0)], types)
    for h in (0, 7, lmscore.BEGIN, lmscore.RARE):
        p = 10.0 ** m.logp[h].astype(float)
        known = p[:30].sum() + p[lmscore.END]
        rares = (rare // 5) * (m.rare_a[h] * 5 + m.rare_b[h])
        assert known + rares + m.rare_b[h] == pytest.approx(1.0, abs=1e-5)


def test_op6_weights_follow_the_data():
    """Where bigrams tell all, they get the weight; where they tell nothing, unigrams do."""
    sure, noise = (np.zeros((lmscore.BEGIN + 1, lmscore.CLASSES), dtype=np.int64) for _ in range(2))
    for k in range(40):
        sure[k, (k + 1) % 40] = 50
    noise[:40, :40] = 2
    b = int(lmscore.buckets(np.array([50]))[0])
    lam = lmscore.learn_weights(sure, sure, [], 40)
    assert lam[b, 0] > 0.95 and lam.sum(axis=1) == pytest.approx(np.ones(lmscore.BINS), abs=1e-6)
    rng = np.random.default_rng(1)
    train, test = rng.poisson(2, (40, 40)), rng.poisson(2, (40, 40))
    noise[:40, :40] = train
    other = np.zeros_like(noise)
    other[:40, :40] = test
    assert lmscore.learn_weights(noise, other, [], 40)[int(lmscore.buckets(np.array([80]))[0]), 0] < 0.6


def test_op6_bigrams_of_rare_words_are_exact(spark):
    """Two words outside the classes that always stand together are a likely pair; others as frequent are not."""
    rng = random.Random(9)
    common = [f"c{k}" for k in range(lmscore.VOCAB + 50)]
    rows = [(k, " ".join(rng.sample(common, len(common))), "en", "s") for k in range(40)]
    rows += [(100 + k, " ".join([rng.choice(common), "new", "zealand", rng.choice(common), rng.choice(common), "old", rng.choice(common)]), "en", "s") for k in range(20)]
    rows += [(900, "new zealand", "en", "s"), (901, "old zealand", "en", "s")]
    out = {r["doc_id"]: r for r in lmscore.score_texts(docs_frame(spark, rows), held_out=F.col("doc_id") >= 900).collect()}
    assert out[900]["base_score"] == pytest.approx(out[901]["base_score"])
    assert out[900]["score"] > out[901]["score"] + 1


def brute_deleted_interpolation(m, train, text):
    """log10 probability by plain counts of words, pairs and classes, with the weights of ``m``."""
    own = set(m.vocab.tolist())
    names = {}

    def cls(w):
        if w not in ("<b>", "<e>") and w not in names:
            data = np.frombuffer(w.encode(), dtype=np.uint8)
            names[w] = int(t.words(data, np.array([0, len(data)]))[0][0]) in own
        return w if w in ("<b>", "<e>") or names[w] else "<rare>"

    def steps(x):
        words = ["<b>", *WORD.findall(lower(x)), "<e>"]
        return list(zip(words, words[1:], strict=False))
    pair = collections.Counter(s for x in train for s in steps(x))
    word, context, cc, context_class, word_class = (collections.Counter() for _ in range(5))
    for (h, w), n in pair.items():
        word[w] += n
        context[h] += n
        cc[cls(h), cls(w)] += n
        context_class[cls(h)] += n
        word_class[cls(w)] += n
    total, types, out = sum(word.values()), len(word), 0.0
    for h, w in steps(text):
        l2, l1, l0 = m.lam[int(lmscore.buckets(np.array([context_class[cls(h)]]))[0])]
        q = l1 * word[w] / total + l0 / (types + 1)
        if word_class[cls(w)] and context_class[cls(h)]:
            q += l2 * cc[cls(h), cls(w)] / context_class[cls(h)] * word[w] / word_class[cls(w)]
        mix = m.weight[int(lmscore.buckets(np.array([context[h]]))[0])]
        out += np.log10(mix * pair[h, w] / max(1, context[h]) + (1 - mix) * q)
    return out


def test_op6_score_matches_plain_counts(spark, monkeypatch):
    """Blocks, counts that stay with their texts and counts that come back give the plain model's scores."""
    rng = random.Random(10)
    common = [f"c{k}" for k in range(lmscore.VOCAB + 30)]
    rows = [(k, " ".join(rng.sample(common, 700) + [f"once{k}", f"some{k % 5}"] * (1 + k % 2)), "en", "s") for k in range(50)]
    rows += [(900, "once7 some7 some2 once7 never c1", "en", "s"), (901, "", "en", "s"), (902, rows[3][1], "en", "s"), (903, "Some2 never never", "en", "s")]
    rows += [rows[4], rows[4]]
    seen, fit = [], lmscore.fit
    monkeypatch.setattr(lmscore, "fit", lambda src: seen.append(fit(src)) or seen[-1])
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 1 << 14)
    out = lmscore.score_texts(docs_frame(spark, rows), held_out=F.col("doc_id") >= 900).collect()
    train = [r[1] for r in rows if r[0] < 900]
    want = {r[0]: brute_deleted_interpolation(seen[0][0], train, r[1]) for r in rows}
    assert len(out) == len(rows)
    for r in out:
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-5), r["doc_id"]


def test_op6_pairs_keep_a_distribution():
    """With exact pairs, p adds up to 1 after a rare word and after a common one."""
    size, rare = 10, [50, 51, 52]
    table = np.zeros((lmscore.BEGIN + 1, lmscore.CLASSES), dtype=np.int64)
    table[:size, :size] = np.random.default_rng(3).integers(0, 5, (size, size))
    after = {(50, 1): 3, (50, 51): 2, (2, 50): 5, (51, 50): 1, (51, None): 1, (2, 52): 2, (52, 3): 2}
    for (h, w), n in after.items():
        table[h if h < size else lmscore.RARE, lmscore.END if w is None else w if w < size else lmscore.RARE] += n
    count = {r: sum(n for (h, _), n in after.items() if h == r) for r in rare}
    # each word follows something as often as it is a context
    count = {50: 5, 51: 2, 52: 2}
    table[lmscore.BEGIN, lmscore.RARE] += sum(count.values()) - table[:, lmscore.RARE].sum()
    words = np.arange(size, dtype=np.uint64)
    m = lmscore.lower_model(words, np.arange(size), table, np.tile([0.5, 0.3, 0.2], (lmscore.BINS, 1)), size + len(rare) + 1)
    lmscore.with_pairs(m, table, np.where(np.arange(lmscore.BINS) > 0, 0.6, 0.0))

    def key(h, w):
        row = np.array([h, w] if w is not None else [h], dtype=np.uint64)
        r = lmscore.rare_transitions(row, np.array([0, len(row)]), lmscore.classes(row, m.vocab, m.number))
        return r.key[r.at == (1 if w is not None else 1)][0]
    found = sorted([(np.uint64(r), n) for r, n in count.items()] + [(key(h, w), n) for (h, w), n in after.items()])
    keys, counts = np.array([k for k, _ in found], dtype=np.uint64), np.array([n for _, n in found])

    def p(h, w):
        row = np.array([h, w] if w is not None else [h], dtype=np.uint64)
        bounds, c = np.array([0, len(row)]), lmscore.classes(row, m.vocab, m.number)
        _, at, bucket, f2, q = lmscore.rare_estimates(m, row, bounds, c, keys, counts)
        if 1 in at:
            k = list(at).index(1)
            return m.weight[bucket[k]] * f2[k] + (1 - m.weight[bucket[k]]) * q[k]
        return 10.0 ** m.logp[c[0], lmscore.END if w is None else c[1]].astype(float)
    for h in (50, 2):
        total = sum(p(h, w) for w in [*range(size), *rare, None]) + p(h, 99)
        assert total == pytest.approx(1.0, abs=1e-4)
    assert p(50, 1) > 0.36 > p(50, 2)


def asks_of(batches, parts):
    """Rows that the counting pass of op6 gives, with 50 words of their own classes."""
    vocab = np.sort(t.words(*t.column_buffers(pa.array([" ".join(f"c{k}" for k in range(50))])))[0])
    shared = type("Shared", (), {"value": (vocab, np.arange(50))})
    return vocab, pa.Table.from_batches(list(lmscore._asks(shared, parts)(iter(batches))))


def test_op6_counts_go_and_come_back_in_small_rows(monkeypatch):
    """The counting pass writes under 9 bytes a key and block, a row for many keys; the counts come back without the keys."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice([f"c{rng.randrange(50)}", f"r{rng.randrange(3000)}"]) for _ in range(300)) for _ in range(400)]
    rows = pa.table({"text": texts, "block": pa.array([k % 7 for k in range(400)], pa.int32()), "fold": pa.array([rng.randrange(3) for _ in range(400)], pa.int32())})
    monkeypatch.setattr(lmscore, "FLUSH", 40_000)
    batches = [b for lo in range(0, 400, 50) for b in rows.slice(lo, 50).combine_chunks().to_batches()]
    vocab, asks = asks_of(batches, 3)
    want = collections.defaultdict(lambda: [0, 0, 0])
    for b in batches:
        h, _, _, bounds = t.words(*t.column_buffers(b.column(0)))
        for key, row in zip(*(x.tolist() for x in lmscore.rare_keys(h, bounds, lmscore.classes(h, vocab, np.arange(50)))), strict=True):
            want[key, b.column(1)[row].as_py()][b.column(2)[row].as_py()] += 1
    assert sum(len(x) for x in asks.column("asks").to_pylist()) < 9 * len(want) and asks.num_rows < len(want) / 500
    total = collections.defaultdict(lambda: [0, 0, 0])
    for (key, _), n in want.items():
        total[key] = [x + y for x, y in zip(total[key], n, strict=True)]
    assert set(asks.column("part").to_pylist()) == {0, 1, 2}
    back = pa.concat_tables([lmscore._answers(asks.filter(pc.equal(asks.column("part"), k))) for k in range(3)]).to_pylist()
    for block in range(7):
        mine = sorted((x for x in back if x["block"] == block), key=lambda x: x["part"])
        n, keep = ([int(v) for x in mine for v in lmscore.unpack(x[c], np.int64)] for c in ("n", "keep"))
        keys = sorted(k for k, b in want if b == block)
        assert n == [total[k][lmscore.LEARN] + total[k][lmscore.WEIGH] for k in keys]
        assert keep == [total[k][lmscore.LEARN] for k in keys if want[k, block][lmscore.WEIGH]]


def test_op6_a_block_finds_its_keys_in_little_more_time_than_its_words():
    """Finding a block's keys again costs CPU like splitting and hashing its texts, not many times that."""
    rng = np.random.default_rng(5)
    names = np.array([f"c{k}" for k in range(2000)] + [f"r{k}" for k in range(60_000)])
    texts = [" ".join(x) for x in names[np.where(rng.random((3000, 150)) < 0.5, rng.integers(0, 2000, (3000, 150)), rng.integers(2000, len(names), (3000, 150)))]]
    docs = pa.table({"text": texts})
    vocab = np.sort(t.words(*t.column_buffers(pa.array([" ".join(names[:2000])])))[0])
    m = type("Model", (), {"vocab": vocab, "number": np.arange(2000)})
    h, _, _, bounds = t.words(*t.column_buffers(docs.column(0)))
    want = np.unique(lmscore.rare_keys(h, bounds, lmscore.classes(h, vocab, m.number))[0])
    known = pa.table({"part": pa.array([0], pa.int32()), "n": [lmscore.pack(np.arange(len(want)))]})

    def seconds(f):
        start = time.process_time()
        f()
        return time.process_time() - start
    slices, keys, counts = lmscore._block(m, docs, known, "n")
    assert (keys == want).all() and (counts == np.arange(len(want))).all() and sum(len(x[1]) for x in slices) == len(h)
    plain = min(seconds(lambda: t.words(*t.column_buffers(docs.column(0)))) for _ in range(5))
    assert min(seconds(lambda: lmscore._block(m, docs, known, "n")) for _ in range(5)) < 6 * plain


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_op6_sorts_and_classes_as_plain_numpy_gives_them(n):
    rng = np.random.default_rng(n)
    key, second = rng.integers(0, 50, n).astype(np.uint64) * np.uint64(2**64 // 50), rng.integers(0, 2**32, n)
    order, want = lmscore.order_by(key, second), np.lexsort((second, key))
    assert (key[order] == key[want]).all() and (second[order] == second[want]).all() and sorted(order) == list(range(n))
    assert (lmscore.distinct(key) == np.unique(key)).all()
    vocab = np.unique(np.concatenate([rng.integers(0, 2**64, n, dtype=np.uint64), np.array([0, 1, 2, 2**50, 2**50 + 1, 2**64 - 2, 2**64 - 1], dtype=np.uint64)]))
    h = np.concatenate([vocab, vocab + np.uint64(1), vocab - np.uint64(1), rng.integers(0, 2**64, 1000, dtype=np.uint64)])
    place = {int(x): k for k, x in enumerate(vocab)}
    assert lmscore.classes(h, vocab, np.arange(len(vocab))).tolist() == [place.get(int(x), lmscore.RARE) for x in h]


@pytest.mark.parametrize("x", [np.zeros(0, dtype=np.int64), np.array([7], dtype=np.int64), np.array([0, 2**63, 2**64 - 1, 5], dtype=np.uint64), np.arange(1000) << 40])
def test_op6_packed_columns(x):
    assert lmscore.unpack(lmscore.pack(x), x.dtype).tolist() == x.tolist()


def test_op6_corners(spark, corners, nothing):
    out = lmscore.score_texts(corners).toPandas()
    assert len(out) == 9 and (out.n_tokens == 1).sum() == 4 and out.score.notna().all()
    assert lmscore.score_texts(nothing).count() == 0
    alone = lmscore.score_texts(corners, held_out=F.lit(True)).toPandas()
    assert (alone.base_score == 0).all() and (alone.train_tokens == 0).all() and np.allclose(alone.score, 0)


# ------------------------------------------------------------------ 7

def test_op7_extracts_the_documents(spark, sf_dir):
    """The pages hold the documents: heading, then one block a line."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    out = registry.op7_html_text(spark, sf_dir).collect()
    assert len(out) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    for r in out:
        doc = int(re.search(r"/(\d+)", r["url"].split("://")[1])[1])
        lines = [" ".join(x.split()) for x in texts[doc].split("\n") if x.strip()]
        assert r["text"].split("\n")[1:] == lines and r["n_chars"] == len(r["text"])


def test_op7_parts_of_a_page():
    page = ("<html><head><title>T</title><style>x{}</style></head><body><header>Top</header><div id=menu>Home</div>"
            "<main><h1>A &amp; B</h1><p>One&nbsp; <b>two</b>three<br>four<p>five<ul><li>a<li>b</ul><!-- no --><table><tr><td>c<td>d</table>"
            "<div class='post-comments'><p>me too</div><form>q<input></form><script>var s='</p>';</script><aside>side</aside></main>"
            "<div class='cookie-notice'>ok?</div><footer>&copy; x</footer></body></html>")
    assert sitetree.main_text(sitetree.parse(page)) == "A & B\nOne twothree\nfour\nfive\na\nb\nc\nd"
    assert sitetree.main_text(sitetree.parse("<p>a < b & c")) == "a < b & c"
    assert sitetree.main_text(sitetree.parse("x<script>never closed <p>y")) == "x"
    assert sitetree.main_text(sitetree.parse("</p></div><a href='x>y'>z</a>")) == "z"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert sitetree.main_text(sitetree.parse(deep)) == "deep"


def test_op7_site_tree_removes_what_all_pages_share(spark):
    """A block without a telling tag or class, alike on every page of the host, goes; so it stays on other hosts."""
    def html(k, extra):
        return f"<body><div><span>{extra}</span></div><div><p>story {k} is about {k * 7}</p><p>more {k}</p></div></body>"
    rows = [(k, f"http://h.org/{k}", html(k, "Follow us today")) for k in range(20)]
    rows += [(100 + k, f"http://other.org/{k}", html(k, f"Chapter {k}")) for k in range(20)]
    rows += [(200 + k, f"http://copies.org/{k}", html(1, "x")) for k in range(10)] + [(300, None, None), (301, "http://h.org/e", "")]
    out = {r["page_id"]: r["text"] for r in sitetree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "story 3 is about 21\nmore 3"
    assert out[103] == "Chapter 3\nstory 3 is about 21\nmore 3"
    assert "story 1 is about 7" in out[203]  # a host of copies keeps its text
    assert out[300] == "" and out[301] == ""
    assert sitetree.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string, low int")).count() == 0


def test_op7_keeps_all_of_an_article(spark):
    """Parts of an article that read alike on a host's pages stay, on hosts of copies too; a small article does not hide the rest."""
    def page(k, rest=""):
        return f"<body><div><h1>Head {k}</h1><h2>Sub {k}</h2><p>{f'story {k} goes on ' * 9}</p><ul><li>item {k}</ul></div>{rest}</body>"

    def recipe(k):
        return f"<body><div><span>Follow us</span></div><article><h2>Ingredients</h2><p>{f'take {k} eggs ' * 6}</p></article></body>"

    def front(k):
        return f"<body><article><p>Teaser {k} of ten words in all, just so</p></article><div><p>{f'body {k} text ' * 9}</p></div></body>"
    rows = [(k, f"http://copies.org/{k}", page(0 if k < 9 else k)) for k in range(10)]
    rows += [(100 + k, f"http://mixed.org/{k}", page(0 if k < 54 else k, "<div><span>Follow us</span></div>")) for k in range(60)]
    rows += [(200 + k, f"http://recipes.org/{k}", recipe(k)) for k in range(20)] + [(300 + k, f"http://front.org/{k}", front(k)) for k in range(3)]
    out = {r["page_id"]: r["text"] for r in sitetree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "Head 0\nSub 0\n" + "story 0 goes on " * 8 + "story 0 goes on\nitem 0"
    assert out[3] == out[103] == whole and out[159] == whole.replace("0", "59")
    assert out[207].split("\n")[0] == "Ingredients" and "Follow us" not in out[207]
    assert out[301].startswith("Teaser 1 of") and "body 1 text" in out[301]


# ------------------------------------------------------------------ 8

def brute_units(text):
    """(start, end, normalised words) of the units of a text, by characters."""
    out = []
    for line in re.finditer(r"[^\n]+", text):
        unit = []
        for w in WORD.finditer(line.group()):
            first = w.group()[0]
            if unit and (unit[-1].group()[-1] in ".!?" or "A" <= first <= "Z" or "À" <= first <= "Þ"):
                out.append((line.start(), unit))
                unit = []
            unit.append(w)
        if unit:
            out.append((line.start(), unit))
    return [(at + u[0].start(), at + u[-1].end(), tuple(lower(w.group()) for w in u)) for at, u in out]


def brute_spans(rows, min_words):
    order = sorted({(i, x) for i, x, *_ in rows if x}, key=lambda r: (r[0] is None, r[0] or 0))
    first, spans = {}, {}
    for i, x in order:
        for k, (_, _, words) in enumerate(brute_units(x)):
            first.setdefault(words, (i, x, k))
    for i, x in order:
        runs, now = [], []
        units = brute_units(x)
        for k, (s, e, words) in enumerate(units):
            if first[words] != (i, x, k):
                now.append((s, e, len(words)))
            elif now:
                runs.append(now)
                now = []
        if now:
            runs.append(now)
        spans[i] = [(r[0][0], r[-1][1]) for r in runs if sum(n for _, _, n in r) >= min_words]
    return {i: s for i, s in spans.items() if s}


def test_op8_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(60)]

    def sentence():
        return " ".join(rng.choice(vocab) for _ in range(rng.randrange(2, 9))).capitalize() + rng.choice([".", ".", "!", ""])
    shared = [" ".join(sentence() for _ in range(6)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [sentence() for _ in range(rng.randrange(1, 8))]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        rows.append((i, rng.choice([" ", "\n"]).join(parts), "en", "s"))
    df = docs_frame(spark, rows)
    got = {}
    for r in linededup.duplicate_spans(df, min_words=12).collect():
        i = next(i for i, x, *_ in rows if x == rows[i][1] and sitekey(spark, df, i) == r["row_key"])
        got[i] = [(s["start"], s["end"]) for s in r["spans"]]
    want = brute_spans(rows, 12)
    assert got == want and len(want) > 10
    texts = {r["doc_id"]: r["text"] for r in linededup.drop_repeats(df, min_words=12).collect()}
    for i, x, *_ in rows:
        at, out = 0, ""
        for s, e in want.get(i, []):
            out, at = out + x[at:s], e
        assert texts[i] == out + x[at:]


_KEYS = {}


def sitekey(spark, df, doc_id):
    from cohortflow.llm._tables import row_key

    if id(df) not in _KEYS:
        _KEYS[id(df)] = {r["doc_id"]: r["k"] for r in df.select("doc_id", row_key("doc_id", "text").alias("k")).collect()}
    return _KEYS[id(df)][doc_id]


def test_op8_pasted_passages_and_clean_texts(spark):
    """A passage of over 50 words pasted into the middle of a sentence is cut from all but the first; others stay."""
    rng = random.Random(4)

    def prose(n, tag):
        return " ".join(" ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(9)).capitalize() + "." for _ in range(n))
    passage = prose(7, "p")
    rows = [(k, prose(4, "a") + f" and so{k} " + passage + f" it goes{k} on " + prose(3, "b"), "en", "s") for k in (4, 9, 17)]
    rows += [(k, prose(9, "c"), "en", "s") for k in (20, 21)] + [(30, "All rights reserved.", "en", "s"), (31, "All rights reserved.", "en", "s")]
    out = {r["doc_id"]: r["text"] for r in linededup.drop_repeats(docs_frame(spark, rows)).collect()}
    assert out == {i: (x.replace(passage, "") if i in (9, 17) else x) for i, x, *_ in rows}


def test_op8_corners(spark, corners, nothing):
    out = linededup.drop_repeats(corners)
    assert out.columns == corners.columns and out.count() == 9
    assert linededup.duplicate_spans(nothing).count() == 0 and linededup.drop_repeats(nothing).count() == 0


# ------------------------------------------------------------------ 9

def test_op9_suffix_arrays():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(1, 60)
        a = np.array([rng.randrange(3) for _ in range(n)])
        order, lcp = quality.suffix_array(a)
        want = sorted(range(n), key=lambda i: tuple(a[i:]))

        def common(i, j):
            k = 0
            while i + k < n and j + k < n and a[i + k] == a[j + k]:
                k += 1
            return k
        assert order.tolist() == want and lcp.tolist() == [0] + [common(want[k - 1], want[k]) for k in range(1, n)]
        covered, longest = set(), 0
        for i in range(n):
            for j in range(i):
                c = common(i, j)
                if c >= 4:
                    covered |= set(range(i, i + c)) | set(range(j, j + c))
                    longest = max(longest, c)
        spans, got = quality.repeat_spans(a, 4)
        assert got == longest and {p for s, e in spans for p in range(s, e)} == covered


def test_op9_counts(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in registry.op9_quality_rules(spark, sf_dir).collect():
        x = texts[r["doc_id"]] or ""
        w = WORD.findall(x)
        grams = collections.Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        repeat = {p for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [s for s in x.split("\n") if WORD.search(s)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(repeat))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_op9_verdicts_and_corners(spark, corners, nothing):
    rng = random.Random(6)
    fresh = [f"u{k}" for k in range(1200)]
    rng.shuffle(fresh)
    rows = [(1, " ".join(fresh), "en", "s"), (2, " ".join(fresh[:300] + fresh[:140] + fresh[300:500]), "en", "s"),
            (3, " ".join(fresh[:400] + fresh[:10] + fresh[400:800]), "en", "s"), (4, " ".join(fresh * 2), "en", "s")]
    got = {r["doc_id"]: r for r in quality.quality_rules(docs_frame(spark, rows)).collect()}
    assert got[1]["kept"] and got[3]["kept"] and not got[2]["kept"] and not got[4]["kept"]
    assert got[2]["longest_repeat"] == 140 and got[2]["repeat_fraction"] == pytest.approx(280 / 640) and not got[2]["base_failed"]
    out = quality.quality_rules(corners).toPandas()
    assert len(out) == 9 and (out.n_words == 0).sum() == 4 and quality.quality_rules(nothing).count() == 0


# ------------------------------------------------------------------ 10

def test_op10_finds_every_copy_and_no_other(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in registry.op10_decontaminate(spark, sf_dir).collect()}
    assert got == {(i, k) for i, x in docs.items() for k, s in items.items() if x and s in x} and got


def test_op10_retrieval_matches_plain_bm25(spark, sf_dir):
    """Block-max skipping and essential terms lose no item that full scoring of every window finds."""
    import math

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rng = random.Random(1)
    words = [w for _, s in items for w in s.split()]
    texts = []
    for _ in range(40):
        parts = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        s = rng.choice(items)[1].split()
        kept = [w for w in s if rng.random() < rng.choice([0.5, 0.7, 1.0])]
        at = rng.randrange(len(parts))
        texts.append(" ".join(parts[:at] + kept + parts[at:]))
    raw = [np.frombuffer(x.encode(), dtype=np.uint8) for x in texts]
    bags = [decontam.terms(np.frombuffer(s.encode(), dtype=np.uint8), np.array([0, len(s.encode())]))[0] for _, s in items]
    df = collections.Counter(int(t) for b in bags for t in np.unique(b))
    n, mean, step = len(items), float(np.mean([len(b) for b in bags])), 64
    posts = []
    for k, b in enumerate(bags):
        u, c = np.unique(b, return_counts=True)
        posts += [(k, int(np.int64(np.uint64(t).view(np.int64))), int(m), len(b), df[int(t)]) for t, m in zip(u, c, strict=True)]
    ix = decontam.build_index([(k, i, s) for k, (i, s) in enumerate(items)], posts, n, mean, step, 0.6)

    def bm25(bag, query):
        tf = collections.Counter(map(int, bag))
        return sum(math.log1p((n - df[t] + .5) / (df[t] + .5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (.25 + .75 * len(bag) / mean)) for t in query if t in tf)
    found = 0
    for data in raw:
        h, _, _, bounds = decontam.terms(data, np.array([0, len(data)]))
        got = {(a, z, ix.ids[k]): s for _, a, z, k, s in decontam.retrieve(ix, h, bounds)}
        want = {}
        windows = max(1, -(-len(h) // step) - 1)
        for w in range(windows):
            a, z = w * step, (w + 2) * step if w + 1 < windows else len(h)
            query = {int(t) for t in h[a:z]}
            for (i, _), bag in zip(items, bags, strict=True):
                share = bm25(bag, query) / (0.6 * bm25(bag, {int(t) for t in bag}))
                if share >= 1:
                    want[a, min(z, len(h)), i] = share
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)
        found += len(want)
    assert found > 20


def test_op10_shards_and_corners(spark, sf_dir, corners, nothing):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = {(r["doc_id"], r["item_id"], round(r["score"], 6)) for r in decontam.contaminated(docs, bench).collect()}
    many = {(r["doc_id"], r["item_id"], round(r["score"], 6)) for r in decontam.contaminated(docs, bench, shard_words=300).collect()}
    assert one == many
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "one two three four five six"), (1, None)], "item_id long, text string")
    out = decontam.contaminated(corners, odd).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(1, None)} and len(out) == 2
    assert decontam.contaminated(nothing, bench).count() == 0
    assert decontam.contaminated(corners, bench.limit(0)).count() == 0
    assert collections.Counter(r["doc_id"] for r in decontam.drop_contaminated(corners, odd).collect()) == collections.Counter([None, None, 2, 3, 4, 5, 6])


def test_op10_answers():
    assert decontam.split_answer("What is it?\nA cat.") == ("What is it?", "A cat.")
    assert decontam.split_answer("Who did it? The butler.") == ("Who did it?", " The butler.")
    assert decontam.split_answer("a b c d e f g h") == ("a b c d e f", "g h")
