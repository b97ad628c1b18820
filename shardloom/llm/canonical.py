"""Canonical exact digests of documents.

A text's canonical form is NFKC, case-folded, NFKC again, with runs of white
space as one space and none at the ends.  Documents are grouped by the 128-bit
xxh3 of that form.  Digests are counted first, so only documents whose digest
repeats have their form made again and compared byte for byte: the least and the
greatest form of a digest are kept while aggregating, one for each task, and a
group of copies never meets in one place.  Where they differ, each form is a
group of its own.

Defined results: a null text has a null digest and is a group of its own row;
empty and blank texts share the empty form; very long texts are taken whole; a
null identifier takes part like any other but never names a group that has a
non-null one; identifiers keep their type; repeated rows count as copies; an
empty table gives an empty result; other columns are ignored.  Rows are told
apart by 128-bit keys of identifier and text.
"""

from __future__ import annotations

import sys
import unicodedata

import pyarrow as pa
import xxhash
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import kind_of, limited, row_key, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    text = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(unicodedata.normalize("NFKC", text).split())


def form_batches(digest_of, keep: bool):
    """(k, digest, bytes of the form) of each row, and the form as a zstd frame where it is kept; equal frames and equal forms imply each other."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for batch in batches:
            forms = [canonical(x).encode() for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([digest_of(x) for x in forms], pa.string()), pa.array([len(x) for x in forms], pa.int64())]
            if keep:
                columns.append(pa.array(map(squeeze.compress, forms), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["k", "digest", "form_bytes", "form"][: len(columns)])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_of=xxhash.xxh3_128_hexdigest) -> DataFrame:
    """(doc_id, digest, form_bytes, group_id, copies) of every row; group_id is the smallest identifier with the same form."""
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("doc_id"), row_key(id_col, text_col).alias("key")).alias("k"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = f"k struct<doc_id: {kind_of(docs, id_col)}, key: struct<a: long, b: long>>, digest string, form_bytes long"
    marked = stored(rows.where("text IS NOT NULL").mapInArrow(form_batches(digest_of, False), kind).select("k.*", "digest", "form_bytes"))
    groups = stored(marked.groupBy("digest").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("copies")))
    many = marked.join(groups.where("copies > 1").select("digest"), "digest").select("key").distinct()
    again = rows.where("text IS NOT NULL").join(limited(stored(many)), F.col("k.key") == F.col("key"), "left_semi").mapInArrow(form_batches(digest_of, True), f"{kind}, form binary")
    differ = stored(again.groupBy("digest").agg((F.min("form") != F.max("form")).alias("differ")).where("differ").select("digest"))
    found = marked.join(groups, "digest")
    if not differ.isEmpty():
        # Different forms of one digest: few, so their forms may be grouped as they are.
        apart = again.join(F.broadcast(differ), "digest")
        named = apart.groupBy("digest", "form").agg(F.min("k.doc_id").alias("group_id"), F.count(F.lit(1)).alias("copies"))
        apart = apart.join(named, ["digest", "form"]).select("digest", "k.doc_id", "k.key", "form_bytes", "group_id", "copies")
        found = found.join(F.broadcast(differ), "digest", "left_anti").unionByName(apart)
    none = rows.where("text IS NULL").select("k.doc_id", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("form_bytes"), F.col("k.doc_id").alias("group_id"), F.lit(1).cast("long").alias("copies"))
    return found.select("doc_id", "digest", "form_bytes", "group_id", "copies").unionByName(none)
