"""Remove passages that occur before, by global hashes of normalised units.

A unit is a sentence of a line: lines end at ``\\n``; inside a line a unit ends
after a word with a final ``.``, ``!`` or ``?``, and before a word that begins
with an upper-case ASCII letter or a two-byte letter of the block C3 80 - C3 9E
(so a passage pasted into the middle of a sentence still starts a unit).  A
unit's digest is the hash of its words, A-Z lower-cased and white space
collapsed.  Digests are grouped over the whole corpus; the occurrence that ranks
first (document id with null last, then text hash, then position) is kept.

Repeated units are removed where they form a run: neighbouring units of a
document, all repeats, with ``min_words`` words or more in all.  A whole line
is therefore removed when it is long enough, a short phrase alone never is.
Spans carry code point offsets into the original text.

Defined results: null and empty texts have no units; rows alike in id and text
are one occurrence and keep or lose the same spans; a unit repeated inside one
text is kept at its first position; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import _text as t
from ._tables import materialize, row_key, unused

_FINAL = np.zeros(256, dtype=bool)
_FINAL[[ord("."), ord("!"), ord("?")]] = True
_UNIT_SCHEMA = "doc_rank {id_type}, row_key bigint, digest bigint, unit int"


def _upper(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    first = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    return ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))


def unit_table(data: np.ndarray, offs: np.ndarray):
    """Units of a slice of rows: (first word, last word + 1, digest, unit bounds per row, word starts, word ends)."""
    starts, ends, bounds = t.spans(data, offs)
    n = len(starts)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(0, dtype=np.uint64), np.zeros(len(offs), dtype=np.int64), starts, ends
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    new = np.zeros(n, dtype=bool)
    new[bounds[:-1][bounds[:-1] < n]] = True
    new[1:] |= (lines[starts[1:]] != lines[ends[:-1]]) | _FINAL[data[ends[:-1] - 1]] | _upper(data, starts[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)
    # an order-dependent digest: word hashes weighted by powers of an odd base, shifted to the unit's start
    h = t.span_hashes(t.lower(data), starts, ends)
    up, down = t._Powers.get(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * up[:n], out=total[1:])
    digest = t.mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    return first, last, digest, np.searchsorted(first, bounds), starts, ends


def _units(batches):
    for rows, data, offs in t.text_slices(batches):
        _, _, digest, bounds, _, _ = unit_table(data, offs)
        per_row = np.diff(bounds)
        take = pa.array(np.repeat(np.arange(len(per_row)), per_row))
        index = np.arange(len(digest)) - np.repeat(bounds[:-1], per_row)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).take(take), rows.column(1).take(take), pa.array(t.signed(digest)), pa.array(index.astype(np.int32))],
            names=["doc_rank", "row_key", "digest", "unit"])


_SPAN = "start bigint, `end` bigint, n_words bigint, n_units int, kept_doc_id {id_type}"


def _spans(min_words: int, id_type: pa.DataType):
    """Runs of repeated units of each text: needs the units' numbers in ``repeats`` (sorted array) with ``first_doc``."""
    schema = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()), ("n_units", pa.int32()), ("kept_doc_id", id_type)])

    def run(batches):
        for rows, data, offs in t.text_slices(batches):
            first, last, _, bounds, starts, ends = unit_table(data, offs)
            cps = t.code_points(data)
            reps = rows.column(rows.schema.get_field_index("repeats"))
            out = []
            for k in range(rows.num_rows):
                r = reps[k].as_py() or []
                spans = []
                if r:
                    r = sorted((x["unit"], x["first_doc"]) for x in r)
                    idx = np.array([x[0] for x in r], dtype=np.int64)
                    cut = np.flatnonzero(np.diff(idx) != 1) + 1
                    for lo, hi in zip(np.append(0, cut), np.append(cut, len(idx)), strict=True):
                        a, b = bounds[k] + idx[lo], bounds[k] + idx[hi - 1]
                        n_words = int(last[b] - first[a])
                        if n_words >= min_words:
                            s, e = starts[first[a]], ends[last[b] - 1]
                            spans.append({"start": int(cps[s] - cps[offs[k]]), "end": int(cps[e] - cps[offs[k]]), "n_words": n_words,
                                          "n_units": int(hi - lo), "kept_doc_id": r[lo][1]})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, type=pa.list_(schema))], names=["row_key", "spans"])
    return run


def duplicate_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 20) -> DataFrame:
    """One row per text that loses something: doc_id, row_key, text, spans (array of struct, in order).

    Digests are counted globally with map-side partial counts, so a line that a
    third of all documents share reaches its reducer as one row per task.  Only
    units whose digest occurs again are ranked and meet their first place (a
    join Spark can split by skew), and only texts that have such units meet
    their unit numbers.
    """
    src = docs.select(F.col(doc_id).alias("doc_rank"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))
    id_type = dict(src.dtypes)["doc_rank"]
    units = materialize(src.mapInArrow(_units, _UNIT_SCHEMA.format(id_type=id_type)), "dedup-units")
    common = materialize(units.groupBy("digest").count().filter("count > 1").select("digest"), "dedup-common")
    repeated = materialize(units.join(common, "digest"), "dedup-repeats")
    place = F.struct(F.col("doc_rank").isNull().alias("no_id"), "doc_rank", "row_key", "unit")
    first = repeated.groupBy("digest").agg(F.min(place).alias("a"))
    # written, so that the join below has exchanges of its own, which Spark may split where a digest is frequent
    first = materialize(first.select("digest", F.col("a.row_key").alias("first_key"), F.col("a.unit").alias("first_unit"),
                                     F.col("a.doc_rank").alias("first_doc")), "dedup-first")
    again = (repeated.join(first, "digest").filter("row_key <> first_key or unit <> first_unit")
             .select("row_key", "unit", "first_doc"))
    per_text = again.groupBy("row_key").agg(F.collect_set(F.struct("unit", "first_doc")).alias("repeats"))
    hit = src.select(F.col("row_key"), "doc_rank", "text").join(per_text, "row_key")
    spans = hit.select("row_key", "text", "repeats").mapInArrow(
        _spans(min_words, to_arrow_type(src.schema["doc_rank"].dataType)),
        T.StructType([T.StructField("row_key", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType.fromDDL(_SPAN.format(id_type=id_type))))]))
    return spans.filter(F.size("spans") > 0).dropDuplicates(["row_key"])


def remove_spans(text, spans):
    """The text without its spans (code point offsets), as a Column: the pieces between them, joined as they stand."""
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    pieces = F.zip_with(edges, stops, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.array_join(pieces, "")


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 20) -> DataFrame:
    """``docs`` with repeated runs removed from ``text``; all other columns as they are, all rows kept."""
    key, spans = unused(docs, "_cut_key"), unused(docs, "_cut_spans")
    cut = duplicate_spans(docs, doc_id, text, min_words).withColumnsRenamed({"row_key": key, "spans": spans})
    joined = docs.join(cut, row_key(docs[doc_id], docs[text]) == F.col(key), "left")
    new = F.when(F.col(spans).isNotNull(), remove_spans(F.col(text), F.col(spans))).otherwise(F.col(text))
    return joined.withColumn(text, new).select(*docs.columns)
