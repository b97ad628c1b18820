"""Exact dedup by a log-structured merge index.

Digests (128 bits) stream into memtables.  A full memtable is flushed as a
sorted run: one segment for each digest range, with a Bloom filter.  Compaction
goes by levels: FANOUT runs of a range are merged into one run of the next level
until FANOUT at most are left.  Of these, a digest that is single in its run and
that no other run's filter admits is unique without a merge; the rest are merged.
Hits are only candidates until their texts are compared byte for byte: a digest
whose least and greatest text are equal is one group; where they differ, each
text is.  The smallest identifier of a group is kept.  Texts are aggregated
before they move, so a group of copies costs one text for each task.

Defined results: a null text is content of its own kind and never a copy; empty
texts are copies of one another, and very long texts are taken whole; a null
identifier sorts after all others; identifiers keep their type; repeated rows
(same identifier and text) count as one document in ``exact_duplicates`` and lose
all but one row in ``exact_stage``; an empty table gives an empty result; other
columns, whatever their names, are ignored or, in the stage, carried.  Rows are
told apart by 128-bit keys of identifier and text.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import kernels
from .common import keep_rows, limited, partitions, row_key, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])
MEMTABLE_ENTRIES = 1_000_000
FILTER_BITS = 12
FILTER_HASHES = 5
FANOUT = 8
SPAN_ENTRIES = 500_000
ENTRY = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("a", "<i8"), ("b", "<i8")])  # digest and row key
RUN_SCHEMA = "span int, run long, entries binary, filter binary"
HIT_SCHEMA = "a long, b long, hi long, lo long"


def filter_slots(hi: np.ndarray, lo: np.ndarray, bits: int) -> np.ndarray:
    steps = np.arange(FILTER_HASHES, dtype=np.uint64)[:, None]
    return (kernels.mix(lo ^ hi)[None, :] + steps * (lo | np.uint64(1))[None, :]) % np.uint64(bits)


def build_filter(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    bits = np.zeros(max(64, -(-len(hi) * FILTER_BITS // 8) * 8), bool)
    bits[filter_slots(hi, lo, len(bits)).ravel().astype(np.int64)] = True
    return np.packbits(bits)


def in_filter(packed: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    slots = filter_slots(hi, lo, len(packed) * 8).astype(np.int64)
    return ((packed[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1).all(axis=0)


def flush(memtable: list[np.ndarray], run: int, spans: int) -> pa.RecordBatch:
    """A sorted run, cut into its digest ranges."""
    entries = np.concatenate(memtable)
    entries = entries[np.lexsort((entries["b"], entries["a"], entries["lo"], entries["hi"]))]
    span = ((entries["hi"] >> np.uint64(32)) * np.uint64(spans)) >> np.uint64(32)
    rows = []
    for s in np.unique(span):
        part = entries[span == s] if spans == 1 else entries[np.searchsorted(span, s) : np.searchsorted(span, s, "right")]
        rows.append((int(s), run, part.tobytes(), build_filter(part["hi"], part["lo"]).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["span", "run", "entries", "filter"])


def memtables(spans: int, limit: int):
    def run_task(batches):
        from pyspark import TaskContext

        run, held, count = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            part = np.zeros(batch.num_rows, ENTRY)
            for at, name in enumerate(("hi", "lo", "a", "b")):
                part[name] = batch.column(at).to_numpy(zero_copy_only=False).astype(part[name].dtype)
            for cut in range(0, len(part), limit):
                held.append(part[cut : cut + limit])
                count += len(held[-1])
                if count >= limit:
                    yield flush(held, run, spans)
                    run, held, count = run + 1, [], 0
        if count:
            yield flush(held, run, spans)

    return run_task


def merged(runs: list[np.ndarray]) -> np.ndarray:
    entries = np.concatenate(runs)
    return entries[np.lexsort((entries["b"], entries["a"], entries["lo"], entries["hi"]))]


def repeats(run: np.ndarray) -> np.ndarray:
    """Which entries of a sorted run have a neighbour of the same digest."""
    same = (run["hi"][1:] == run["hi"][:-1]) & (run["lo"][1:] == run["lo"][:-1])
    out = np.zeros(len(run), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def compact(runs: list[np.ndarray], filters: list[np.ndarray]) -> np.ndarray:
    """The entries whose digest occurs more than once, sorted by digest."""
    while len(runs) > FANOUT:
        runs = sorted(runs, key=len)
        runs = [merged(runs[i : i + FANOUT]) for i in range(0, len(runs), FANOUT)]
        filters = [build_filter(r["hi"], r["lo"]) for r in runs]
    alive = []
    for i, run in enumerate(runs):
        maybe = repeats(run)
        for j, other in enumerate(filters):
            if i != j and not maybe.all():
                left = np.flatnonzero(~maybe)
                maybe[left[in_filter(other, run["hi"][left], run["lo"][left])]] = True
        alive.append(run[maybe])
    found = merged(alive)
    return found[repeats(found)]


def compact_span(group: pa.Table) -> pa.Table:
    runs = [np.frombuffer(x.as_buffer(), ENTRY) for x in group.column("entries")]
    filters = [np.frombuffer(x.as_buffer(), np.uint8) for x in group.column("filter")]
    hits = compact(runs, filters)
    return pa.table([pa.array(hits[c].astype(np.int64)) for c in ("a", "b", "hi", "lo")], names=["a", "b", "hi", "lo"])


def md5_halves(text: Column) -> list[Column]:
    digest = F.md5(text)
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return [F.shiftleft(word(at), 32).bitwiseOR(word(at + 8)) for at in (1, 17)]


def digest_hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_entries: int = MEMTABLE_ENTRIES, spans: int | None = None, digest=md5_halves) -> DataFrame:
    """(k, hi, lo) of the rows that share a digest with another row: runs, then their compaction."""
    spans = spans or max(partitions(docs.sparkSession), -(-docs.count() // SPAN_ENTRIES))
    hi, lo = digest(F.col(f"`{text_col}`").cast("binary"))
    rows = docs.where(F.col(f"`{text_col}`").isNotNull()).select(hi.alias("hi"), lo.alias("lo"), row_key(id_col, text_col).alias("k")).select("hi", "lo", "k.a", "k.b")
    hits = rows.mapInArrow(memtables(spans, memtable_entries), RUN_SCHEMA).groupBy("span").applyInArrow(compact_span, HIT_SCHEMA)
    return hits.select(F.struct("a", "b").alias("k"), "hi", "lo").distinct()


def verified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_entries: int = MEMTABLE_ENTRIES, digest=md5_halves) -> DataFrame:
    """(k, i, group) of the rows whose digest others have: key, identifier, and a name of their text, equal for equal texts only."""
    hits = stored(digest_hits(docs, id_col, text_col, memtable_entries, digest=digest))
    texts = docs.select(row_key(id_col, text_col).alias("k"), F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("binary").alias("bytes"))
    found = texts.join(limited(hits), "k")
    told = stored(found.groupBy("hi", "lo").agg((F.min("bytes") != F.max("bytes")).alias("differ")))
    rows = found.select("k", "i", "hi", "lo").join(told.where("NOT differ").select("hi", "lo"), ["hi", "lo"]).select("k", "i", F.struct("hi", "lo", F.lit(0).alias("n")).alias("group"))
    clash = told.where("differ").select("hi", "lo")
    if clash.isEmpty():
        return rows
    # Different texts of one digest: few, so their texts may be grouped as they are.
    apart = stored(found.join(F.broadcast(clash), ["hi", "lo"]))
    names = apart.select("hi", "lo", "bytes").distinct().withColumn("n", F.row_number().over(Window.partitionBy("hi", "lo").orderBy("bytes")))
    return rows.unionByName(apart.join(names, ["hi", "lo", "bytes"]).select("k", "i", F.struct("hi", "lo", "n").alias("group")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_entries: int = MEMTABLE_ENTRIES, digest=md5_halves) -> DataFrame:
    """(doc_id, duplicate_of): each document that is a byte-for-byte copy, with the smallest identifier of its group."""
    rows = stored(verified(docs, id_col, text_col, memtable_entries, digest).select("i", "group").distinct())
    kept = rows.groupBy("group").agg(F.min(F.struct(F.col("i").isNull().alias("none"), "i"))["i"].alias("keep"))
    return rows.join(kept, "group").where("NOT (i <=> keep)").select(F.col("i").alias("doc_id"), F.col("keep").alias("duplicate_of")).distinct()


def exact_stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_entries: int = MEMTABLE_ENTRIES, digest=md5_halves) -> DataFrame:
    """docs with one row of each text: that of the smallest identifier; rows with null text stay."""
    groups = stored(verified(docs, id_col, text_col, memtable_entries, digest).select("k", "group").distinct())
    return keep_rows(docs, groups, id_col, text_col)
