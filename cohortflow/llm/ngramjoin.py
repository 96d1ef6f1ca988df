"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A text's set holds the hashes of its distinct ``SHINGLE``-word runs.  Texts are
linked when 100 * intersection >= ``percent`` * union.  Texts with equal sets form one
node; only nodes are joined.

Prefixes.  Shingles are ordered by estimated frequency (a sketch counted over all
texts), then hash.  Two sets that meet the threshold share ``l`` of the first
``n - ceil(percent * n / 100) + l`` shingles of both, for every ``l``.  Each text
picks its own ``l`` of 1..``MAX_MATCH`` with the least estimated cost: posting
entries read, plus verifications, of which there can be ``1 / l`` as many.  A pair
needs as many shared prefix shingles as the smaller ``l`` of the two.

Exact bounds drop candidates, most of them inside the join of the postings.  A pair of
sizes n and m needs an intersection of ``need = ceil(percent * (n + m) / (100 + percent))``,
so its ``l``-th shared shingle stands among the first ``n - need + l`` of one set and
``m - need + l`` of the other: postings further back form no pair.  A parity bitmap of
each set bounds the symmetric difference from below.  And after the last shared
shingle found, no more can follow than the shorter of the two rests has.

The frequency sketch has 2^``SKETCH_BITS`` buckets whatever the input.  The finer it is, the
surer are shingles of one text told from those of a few, and the first places of
a text that is no near copy filled with its own.

Groups of near copies are linked without forming all their pairs: first each
posting meets its list's centre, the node with the fewest shingles of its own (an
original among its edited copies), and a few neighbours in a random order of the
nodes, which is linear in the postings; pairs that meet in many lists are verified on
the texts and merged into components.  Then the lists are joined in full, for pairs that
still lie in different components.  Every pair at or above the threshold is so
either verified or already connected: components are exact.

Defined results: null, empty and blank texts have no shingle and are linked with
nothing; texts of fewer than ``SHINGLE`` words have their whole sequence as one;
a component's id is its smallest document id, null only if all its ids are null;
rows alike share a node; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text as t
from ._components import connected_components
from ._tables import discard, materialize, row_key, unused

SHINGLE, PERCENT, MAX_MATCH = 4, 85, 4
SKETCH_BITS = 21
SKETCH_BLOCK = 1 << 12  # buckets in one row of the sketch
VERIFY_COST = 20.0  # of one candidate, in posting entries
MAPS = 4  # longs of the parity bitmap
LIST_ROWS = 8192  # postings of one shingle sorted in one task; longer lists are salted
NEIGHBOURS = 3
LIKELY = 0.25  # of the shorter prefix: lists in which two nodes must meet to be verified early


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, _, _, bounds = t.words(t.lower(data), offs)
    runs = t.windows(h, size)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= size:
            out.append(np.unique(runs[lo: hi - size + 1]))
        elif hi > lo:
            out.append(t.mix(t.windows(h[lo:hi], int(hi - lo)) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(size: int):
    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for _, data, offs in t.text_slices(batches):
            for s in shingle_sets(data, offs, size):
                np.add.at(total, _bucket(s), 1)
        yield from _sketch_rows(total)
    return run


_SKETCH_ROW = "block int, at binary, n binary"


def _sketch_rows(total: np.ndarray):
    """(block, places in it, counts up to 2^31 - 1) of the blocks with a count."""
    blocks = total.reshape(-1, SKETCH_BLOCK)
    for some in np.array_split(np.flatnonzero(blocks.any(axis=1)), 8):
        at = [np.flatnonzero(blocks[k]) for k in some]
        n = [np.minimum(blocks[k][x], (1 << 31) - 1).astype(np.int32).tobytes() for k, x in zip(some, at, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([x.astype(np.uint16).tobytes() for x in at], type=pa.binary()),
                                          pa.array(n, type=pa.binary())], names=["block", "at", "n"])


def _add_rows(batches, total: np.ndarray) -> None:
    blocks = total.reshape(-1, SKETCH_BLOCK)
    for batch in batches:
        for k, at, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            blocks[k, np.frombuffer(at.as_buffer(), dtype=np.uint16)] += np.frombuffer(n.as_buffer(), dtype=np.int32)


def _add_sketches(batches):
    """Sums of the blocks that reach a task, one after the other."""
    total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    _add_rows(batches, total)
    yield from _sketch_rows(total)


def frequency_sketch(texts: DataFrame, size: int) -> np.ndarray:
    """Texts that hold a shingle of each bucket, up to 2^31 - 1: 8 MB whatever the input.

    Tasks send the buckets that they met; the sums of a block are made in one task, so the driver gets each bucket once.
    """
    parts = texts.mapInArrow(_sketch(size), _SKETCH_ROW).repartition("block").mapInArrow(_add_sketches, _SKETCH_ROW).toArrow()
    total = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
    _add_rows(parts.to_batches(), total)
    return total


def choose_matches(cost: np.ndarray, n: int, percent: int, most: int = MAX_MATCH) -> tuple[int, int]:
    """(l, prefix length) of a set of ``n`` shingles whose ordered posting costs are ``cost``."""
    need = -(-percent * n // 100)
    lengths = [n - need + k for k in range(1, min(most, need) + 1)]
    run = np.concatenate([[0.0], np.cumsum(cost[: lengths[-1]])])
    best = min(range(len(lengths)), key=lambda k: (run[lengths[k]] * (1 + VERIFY_COST / (k + 1)), k))
    return best + 1, lengths[best]


_ROW = "row_key bigint, n bigint, node bigint, matches int, used int, prefix array<bigint>, parts array<int>, map array<bigint>"


def _features(shared, size: int, percent: int):
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    none = (0, 0, 0, 0, [], None, [])

    def features(s: np.ndarray, sketch: np.ndarray, noise: float) -> tuple:
        if len(s) == 0:
            return none
        node = t.mix(t.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s)))
        freq = sketch[_bucket(s)]
        order = np.lexsort((s, freq))
        others = np.maximum(freq[order] - noise, 0.0)
        matches, used = choose_matches(others, len(s), percent)
        kept = order[:used]
        parts = (1 + others[:used] // LIST_ROWS).astype(np.int32)
        bits = np.bincount((s & np.uint64(64 * MAPS - 1)).astype(np.int64), minlength=64 * MAPS) & 1
        return (len(s), int(t.signed(node)[0]), matches, used, t.signed(s[kept]),
                parts if parts.max() > 1 else None, np.packbits(bits.astype(np.uint8)).view(np.int64))

    def run(batches):
        sketch = shared.value
        noise = sketch.sum(dtype=np.int64) / len(sketch)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), longs, ints, longs]
        for rows, data, offs in t.text_slices(batches):
            cols = list(zip(*(features(s, sketch, noise) for s in shingle_sets(data, offs, size)), strict=True))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), *(pa.array(x, type=k) for x, k in zip(cols, types, strict=True))],
                names=["doc_id", *(x.split()[0] for x in _ROW.split(", "))])
    return run


def _verify(size: int, percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.schema.get_field_index("text_a"), batch.schema.get_field_index("text_b")
            da, oa = t.column_buffers(batch.column(a))
            db, ob = t.column_buffers(batch.column(b))
            keep = []
            for lo, hi in t.row_slices(oa + ob):
                left = shingle_sets(da[oa[lo]: oa[hi]], oa[lo: hi + 1] - oa[lo], size)
                right = shingle_sets(db[ob[lo]: ob[hi]], ob[lo: hi + 1] - ob[lo], size)
                for k, (x, y) in enumerate(zip(left, right, strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append(lo + k)
            if keep:
                yield batch.select(["a", "b"]).take(pa.array(keep))
    return run


def _close(a, b, percent: int) -> Column:
    """Sizes and parity bitmaps allow the threshold (a, b: accessors of n and map)."""
    total = a("n") + b("n")
    apart = sum((F.bit_count(F.get(a("map"), F.lit(k)).bitwiseXOR(F.get(b("map"), F.lit(k)))) for k in range(1, MAPS)),
                F.bit_count(F.get(a("map"), F.lit(0)).bitwiseXOR(F.get(b("map"), F.lit(0)))))
    return ((100 * F.least(a("n"), b("n")) >= percent * F.greatest(a("n"), b("n")))
            & ((100 + percent) * apart <= (100 - percent) * total))


class _Join:
    def __init__(self, docs: DataFrame, doc_id: str, text: str, size: int, percent: int):
        self.spark, self.size, self.percent = docs.sparkSession, size, percent
        self.src = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))
        sketch = frequency_sketch(self.src.select("text"), size)
        shared = self.spark.sparkContext.broadcast(sketch)
        kind = dict(self.src.dtypes)["doc_id"]
        self.rows = materialize(self.src.mapInArrow(_features(shared, size, percent), f"doc_id {kind}, {_ROW}"), "join-rows")
        self.some = self.rows.filter("n > 0")
        self.nodes = materialize(self.some.select("node", "n", "matches", "used", "map", "row_key").dropDuplicates(["node"]), "join-nodes")

    def postings(self) -> DataFrame:
        """(token, salt, node, place in the node's prefix) of prefix shingles that more than one node may hold; salt -1 in lists of one part."""
        one = self.some.select("node", "prefix", "parts").dropDuplicates(["node"])
        flat = one.select("node", F.posexplode("prefix").alias("k", "token"), "parts")
        part = F.get("parts", F.col("k"))
        flat = flat.select("token", F.when(part > 1, F.pmod(F.xxhash64("node"), part)).otherwise(-1).cast("int").alias("salt"), "node", F.col("k").alias("place"))
        w = W.partitionBy("token", "salt").orderBy("node")
        flat = flat.withColumns({"before": F.lag("node").over(w), "after": F.lead("node").over(w)})
        return flat.filter("salt >= 0 or before is not null or after is not null").select("token", "salt", "node", "place")

    def with_nodes(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, ...) with both nodes' features as structs x and y."""
        x = self.nodes.select(F.col("node").alias("a"), F.struct("n", "used", "map").alias("x"))
        return pairs.join(x, "a").join(x.withColumnsRenamed({"a": "b", "x": "y"}), "b")

    def likely(self, posts: DataFrame) -> DataFrame:
        """Pairs that meet in many lists: a node with the lists' centres, and neighbours in one random order of the nodes.

        All lists are sorted alike, so near copies stand side by side in most of the lists they share.  Salted
        parts of a list are chained by their first postings; centres are minima, so lists of any length have one.
        """
        shared = posts.groupBy("node").agg(F.count("*").alias("shared"))
        alone = self.nodes.select("node", "used").join(shared, "node").select("node", (F.col("used") - F.col("shared")).alias("alone"))
        at = posts.join(alone, "node").withColumn("at", F.xxhash64("node"))
        centres = at.groupBy("token").agg(F.min(F.struct("alone", "at", "node")).alias("c")).select("token", F.col("c.node").alias("y"))
        met = posts.join(centres, "token").select(F.col("node").alias("x"), "y").filter("x <> y")
        w = W.partitionBy("token", "salt").orderBy("at", "node")
        near = at.withColumns({f"y{k}": F.lag("node", k).over(w) for k in range(1, NEIGHBOURS + 1)})
        near = near.select(F.col("node").alias("x"), F.explode(F.array(*[f"y{k}" for k in range(1, NEIGHBOURS + 1)])).alias("y")).filter("y is not null")
        heads = at.filter("salt >= 0").groupBy("token", "salt").agg(F.min(F.struct("at", "node")).alias("h"))
        heads = heads.select("token", F.col("h.node").alias("x"), F.lag("h.node").over(W.partitionBy("token").orderBy("h")).alias("y")).select("x", "y").filter("y is not null")
        pairs = met.withColumn("way", F.lit(0)).unionAll(near.unionAll(heads).withColumn("way", F.lit(1)))
        pairs = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "way").count().groupBy("a", "b").agg(F.max("count").alias("met"))
        often = self.with_nodes(pairs).filter(F.col("met") >= LIKELY * F.least("x.used", "y.used"))
        return often.filter(_close(lambda c: F.col("x")[c], lambda c: F.col("y")[c], self.percent)).select("a", "b")

    def remaining(self, posts: DataFrame) -> DataFrame:
        """All pairs across components that share enough prefix shingles."""
        mixed = posts.groupBy("token").agg(F.min("component").alias("l"), F.max("component").alias("h")).filter("l <> h").select("token")
        features = self.nodes.select("node", "n", "map", "matches")
        posts = posts.join(mixed, "token").select("token", "node", "component", "place").join(features, "node")
        x, y = posts.alias("x"), posts.alias("y")
        on = (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
        # places of a pair's first ``least`` shared shingles, and what can be shared up to here and after
        need = F.expr(f"({self.percent} * (x.n + y.n) + {99 + self.percent}) div {100 + self.percent}")
        least = F.least("x.matches", "y.matches")
        early = (F.col("x.place") < F.col("x.n") - need + least) & (F.col("y.place") < F.col("y.n") - need + least)
        rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
        pairs = x.join(y, on & early & (F.least("x.place", "y.place") + rest >= need) & _close(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), self.percent))
        # both prefixes have one order: the last shared shingle is the last in both
        pairs = pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(
            F.count("*").alias("shared"), F.first(least).alias("least"), F.first(need).alias("need"), F.min(rest).alias("rest"))
        return pairs.filter((F.col("shared") >= F.col("least")) & (F.col("shared") - 1 + F.col("rest") >= F.col("need"))).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole texts meet the threshold."""
        pairs = materialize(pairs, "join-pairs")
        ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
        keys = self.nodes.select("node", "row_key").join(ends, "node")
        texts = self.src.select("row_key", "text").join(keys, "row_key").select("node", "text").dropDuplicates(["node"])
        got = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
               .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))
        out = materialize(got.mapInArrow(_verify(self.size, self.percent), "a bigint, b bigint"), "join-links")
        discard(pairs)
        return out

    def with_components(self, posts: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return posts.withColumn("component", F.col("node"))
        return posts.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def labels(self) -> DataFrame | None:
        """(node, component) of linked nodes, or None without a link."""
        posts = materialize(self.postings(), "join-postings")
        labels = None
        early = self.verified(self.likely(posts))
        if not early.isEmpty():
            labels = materialize(connected_components(early), "join-labels")
        late = self.verified(self.remaining(self.with_components(posts, labels)))
        discard(posts, early)
        if late.isEmpty():
            return labels
        if labels is None:
            return materialize(connected_components(late), "join-labels")
        # the late links join components: their components, then each node's
        own = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        links = late.join(own, "a", "left").join(own.withColumnsRenamed({"a": "b", "ca": "cb"}), "b", "left")
        merged = connected_components(links.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        merged = materialize(merged.withColumnsRenamed({"node": "old", "component": "new"}), "join-merged")
        known = labels.join(merged, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
        fresh = merged.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
        return materialize(known.unionAll(fresh), "join-labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, n_shingles, component_id, first.

    ``first`` marks the rows (alike in id and text, so one but for repeats) that rank first in their component.
    """
    j = _Join(docs, doc_id, text, size, percent)
    labels = j.labels()
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    per_node = j.some.groupBy("node").agg(F.min(place).alias("place"))
    per_node = j.with_components(per_node, labels)
    best = per_node.groupBy("component").agg(F.min("place").alias("best"))
    per_node = materialize(per_node.select("node", "component").join(best, "component").select(
        "node", F.col("best.doc_id").alias("component_id"), F.col("best.row_key").alias("best_key")), "join-components")
    rows = j.rows.select("doc_id", "row_key", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    linked = rows.filter("n > 0").join(per_node, "node").select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"), "component_id", (F.col("row_key") == F.col("best_key")).alias("first"))
    alone = rows.filter("n = 0").select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return linked.unionAll(alone)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the first by id; texts without a word stay."""
    mine, kept, copies, size_of = (unused(docs, n) for n in ("_key", "_keep", "_copies", "_n"))
    found = near_duplicates(docs, doc_id, text, size, percent).filter("first")
    keep = materialize(found.groupBy("row_key").agg(F.count("*").alias(copies), F.max("n_shingles").alias(size_of)).withColumnRenamed("row_key", kept), "join-keep")
    rows = docs.withColumn(mine, row_key(doc_id, text))
    alone = (F.col(copies) == 1) | (F.col(size_of) == 0)
    once = rows.join(keep.filter(alone), F.col(mine) == F.col(kept), "left_semi")
    more = rows.join(keep.filter(~alone), F.col(mine) == F.col(kept), "left_semi").dropDuplicates([mine])
    return once.unionAll(more).select(*docs.columns)
