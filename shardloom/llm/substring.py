"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every ``ANCHOR_SPREAD`` neighbouring hashes of
``ANCHOR_TOKENS`` tokens the smallest is kept, so two texts that share
``MIN_TOKENS`` = ANCHOR_TOKENS + ANCHOR_SPREAD - 1 tokens share an anchor at the
same place in them.  Documents are joined on the anchors.  An anchor that lies in
more than one place is extended both ways: each window of MIN_TOKENS tokens
around it, for which it is the winnowed one, is compared with the windows around
the other places, and the match grows token by token as long as the next window
is also found elsewhere.  What can't grow further is a maximal repeat.  No pair
of documents is ever formed, so a passage in a million documents costs a million
rows and not their square, and nothing is capped.

A repeat is a maximal run of tokens in which every window of MIN_TOKENS tokens
occurs at another place (of this or another document).  Windows are compared by
64-bit hashes of the whole window.  Runs are cut where the set of matching places
changes, so all places of a piece hold the whole piece.

Defined results: null, empty and short texts have no repeats; very long texts are
taken whole; a null identifier takes part and is given as null; identifiers keep
their type; repeated rows (same identifier and text) are one document; two texts
with one identifier are two documents; in a run of one repeated token every place
matches its neighbours; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from . import kernels
from .common import limited, partitions, row_key, stored
from .kernels import U64

cloudpickle.register_pickle_by_value(sys.modules[__name__])
ANCHOR_TOKENS = 10
ANCHOR_SPREAD = 41
MIN_TOKENS = ANCHOR_TOKENS + ANCHOR_SPREAD - 1
HOT_PLACES = 100_000  # of an anchor; beyond, its windows are summed up instead of coming together
RUNS = "doc_id long, k long, first int, windows int, shape long, away long"
NONE = U64(0xFFFFFFFFFFFFFFFF)


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every ``width`` neighbours, by doubling."""
    out, span = values, 1
    while span * 2 <= width:
        out, span = best(out[:-span], out[span:]), span * 2
    return best(out[: len(values) - width + 1], out[width - span :]) if span < width else out


def winnow(bounds: np.ndarray, hashes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash at each token, least anchor hash of each window of k + w - 1 tokens, is the window within one row)."""
    size = k + w - 1
    if len(hashes) < size:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool)
    at, g = kernels.grams(bounds, hashes, k)
    anchor = np.full(len(hashes) - k + 1, NONE)
    anchor[at] = np.minimum(g, NONE - U64(1))
    least = sliding(anchor, w, np.minimum)
    inside = np.repeat(bounds[1:], np.diff(bounds))[: len(least)] - np.arange(len(least)) >= size
    return anchor, least, inside


def anchors(bounds: np.ndarray, hashes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(token positions, hashes) of the winnowed anchors."""
    anchor, least, inside = winnow(bounds, hashes, k, w)
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, U64)
    spread = np.concatenate([np.zeros(w - 1, U64), np.where(inside, least, U64(0)), np.zeros(w - 1, U64)])
    at = np.flatnonzero((sliding(spread, w, np.maximum) == anchor) & (anchor != NONE))
    return at, anchor[at]


def seed_batches(k: int, w: int):
    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for lo, hi, offsets, raw in kernels.chunks(batch.column(2)):
                bounds, hashes = kernels.tokens(offsets, raw)
                at, g = anchors(bounds, hashes, k, w)
                rows = kernels.row_of(bounds, at)
                take = pa.array(rows + lo)
                yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), pa.array((at - bounds[rows]).astype(np.int32)), pa.array(g.view(np.int64))], names=["doc_id", "k", "at", "anchor"])
            kernels.release()

    return run


def window_batches(k: int, w: int):
    """For each seed that lies in several places, the hashes of the windows for which it is the winnowed anchor."""
    size = k + w - 1

    def run(batches):
        for batch in batches:
            ids, keys, seeds = batch.column(0), batch.column(1), batch.column(3)
            for lo, hi, offsets, raw in kernels.chunks(batch.column(2)):
                bounds, hashes = kernels.tokens(offsets, raw)
                anchor, least, inside = winnow(bounds, hashes, k, w)
                if not len(least):
                    continue
                part = seeds.slice(lo, hi - lo)
                counts = np.diff(np.asarray(part.offsets))
                shared = np.zeros(len(hashes), bool)
                shared[np.repeat(bounds[:-1], counts) + part.flatten().to_numpy()] = True
                sums = kernels.prefix(hashes)
                starts = np.flatnonzero(inside)
                found = last_equal(anchor, least, starts, w)
                ok = shared[found]
                starts, found = starts[ok], found[ok]
                if not len(starts):
                    continue
                whole = kernels.mix((sums[starts + size] - sums[starts]) * kernels.powers(len(hashes))[1][starts] + U64(size))
                cut = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]) | (starts[1:] != starts[:-1] + 1)])
                rows = kernels.row_of(bounds, starts[cut])
                take = pa.array(rows + lo)
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer((np.r_[cut, len(starts)] * 8).astype(np.int32).tobytes()), pa.py_buffer(whole.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[found[cut]].view(np.int64)), ids.take(take), keys.take(take), pa.array((starts[cut] - bounds[rows]).astype(np.int32)), packed], names=["anchor", "doc_id", "k", "start", "windows"])

    return run


def last_equal(anchor: np.ndarray, least: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    """The last position in [start, start + w) whose anchor hash is the window's least."""
    found = np.full(len(starts), -1)
    left = np.arange(len(starts))
    for back in range(w - 1, -1, -1):
        hit = anchor[starts[left] + back] == least[starts[left]]
        found[left[hit]] = starts[left[hit]] + back
        left = left[~hit]
        if not len(left):
            break
    return found


def shape_of(count: np.ndarray, names: np.ndarray, moved: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A name of a set of places that stays when all move on together.

    names: the sum of the documents' names; moved: the same sum, each times its
    start; first: the start of the first place.  All are sums or minima, so the
    places of a set needn't come together.
    """
    with np.errstate(over="ignore"):
        return kernels.mix(kernels.mix(names + count.astype(U64)) ^ (moved - names * first.astype(np.int64).view(U64)))


def extend_places(group: pa.Table) -> pa.Table:
    """Runs of windows whose places all move on together: (doc_id, k, first window, windows, shape of the set of places, distance to its first place).

    Two neighbouring windows have the same places, one token on, if these have the
    same distances to the first of them, and the window itself has too.
    """
    group = group.combine_chunks()
    column = group.column("windows").chunk(0)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8
    windows = np.frombuffer(column.buffers()[2], U64)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    start = group.column("start").to_numpy()[row].astype(np.int64) + np.arange(len(windows)) - offsets[row]
    key = group.column("k").to_numpy()[row]
    none = np.iinfo(np.int64).max
    ids = group.column("doc_id").fill_null(none).to_numpy()[row]
    order = np.lexsort((start, key, ids, windows))
    start, key, ids, windows = start[order], key[order], ids[order], windows[order]
    new = np.r_[True, (windows[1:] != windows[:-1]) | (ids[1:] != ids[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1])]  # repeated rows are one
    start, key, ids, windows = start[new], key[new], ids[new], windows[new]
    head = np.flatnonzero(np.r_[True, windows[1:] != windows[:-1]])
    count = np.diff(np.r_[head, len(windows)])
    away = start - np.repeat(start[head], count)
    name = kernels.mix(ids.view(U64) ^ key.view(U64))  # of the document
    names, moved = np.add.reduceat(name, head), np.add.reduceat(name * start.view(U64), head)
    shape = np.repeat(shape_of(count, names, moved, start[head]), count)
    many = np.repeat(count, count) > 1
    start, key, ids, away, shape = start[many], key[many], ids[many], away[many], shape[many]
    order = np.lexsort((start, key, ids))
    start, key, ids, away, shape = start[order], key[order], ids[order], away[order], shape[order]
    differs = lambda x: x[1:] != x[:-1]
    cut = np.flatnonzero(np.r_[True, differs(ids) | differs(key) | differs(away) | differs(shape) | (start[1:] != start[:-1] + 1)]) if len(start) else np.zeros(0, int)
    length = np.diff(np.r_[cut, len(start)])
    return pa.table({"doc_id": pa.array(ids[cut], mask=ids[cut] == none), "k": pa.array(key[cut], pa.int64()), "first": pa.array(start[cut], pa.int32()), "windows": pa.array(length, pa.int32()), "shape": pa.array(shape[cut].view(np.int64)), "away": pa.array(away[cut], pa.int64())})


def window_rows(batches):
    """(window, place) of every window of every row."""
    for batch in batches:
        offsets, raw = kernels.string_parts(batch.column(3))
        count = np.diff(offsets) // 8
        row = np.repeat(np.arange(len(count)), count)
        start = batch.column(2).to_numpy().astype(np.int64)[row] + np.arange(len(row)) - (offsets[:-1] // 8)[row]
        take = pa.array(row)
        name = kernels.mix(batch.column(0).to_numpy().view(U64) ^ batch.column(1).to_numpy().view(U64))[row]
        sums = [name, name * start.view(U64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(raw).view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(start), *(pa.array(x.view(np.int64)) for x in sums)], names=["window", "doc_id", "k", "start", "name", "moved"])
        kernels.release()


def wrapped_halves(column: str) -> list:
    """The low and high 32 bits of a number, whose sums can't overflow."""
    return [F.sum(F.col(column).bitwiseAND((1 << 32) - 1)).alias(f"{column}_low"), F.sum(F.shiftrightunsigned(column, 32)).alias(f"{column}_high")]


def shape_batches(batches):
    """The runs of one window each, from rows with their window's sums."""
    for batch in batches:
        doc, k, start, count, first, *halves = (batch.column(i) for i in range(9))
        names, moved = (low.to_numpy().astype(U64) + (high.to_numpy().astype(U64) << U64(32)) for low, high in (halves[:2], halves[2:]))
        shape = shape_of(count.to_numpy(), names, moved, first.to_numpy())
        away = start.to_numpy() - first.to_numpy()
        yield pa.RecordBatch.from_arrays([doc, k, start.cast(pa.int32()), pa.array(np.ones(len(doc), np.int32)), pa.array(shape.view(np.int64)), pa.array(away)], names=["doc_id", "k", "first", "windows", "shape", "away"])


def hot_runs(windows: DataFrame) -> DataFrame:
    """What extend_places gives, for anchors with very many places: sums for each window, joined back, and no group in one task."""
    rows = windows.select("doc_id", "k", "start", "windows").mapInArrow(window_rows, "window long, doc_id long, k long, start long, name long, moved long").distinct()
    first = F.min(F.struct("doc_id", "k", "start")).alias("head")
    told = rows.groupBy("window").agg(F.count(F.lit(1)).alias("n"), first, *wrapped_halves("name"), *wrapped_halves("moved")).where("n > 1")
    both = rows.select("window", "doc_id", "k", "start").join(told, "window").select("doc_id", "k", "start", "n", "head.start", "name_low", "name_high", "moved_low", "moved_high")
    both = both.toDF("doc_id", "k", "start", "n", "first", "name_low", "name_high", "moved_low", "moved_high")
    return both.mapInArrow(shape_batches, RUNS)


def shared_windows(rows: DataFrame, k: int, w: int) -> DataFrame:
    """(anchor, doc_id, k, start, windows, bucket, hot) around the anchors that lie in several places of rows(doc_id, k, text)."""
    seeds = rows.mapInArrow(seed_batches(k, w), "doc_id long, k long, at int, anchor long")
    shared = stored(seeds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    places = seeds.join(limited(shared.select("anchor")), "anchor").groupBy(F.col("doc_id").alias("s_id"), F.col("k").alias("s_k")).agg(F.collect_set("at").alias("seeds"))
    texts = rows.join(places, (rows.k == places.s_k) & (rows.doc_id == places.s_id)).select("doc_id", "k", "text", "seeds")
    windows = texts.mapInArrow(window_batches(k, w), "anchor long, doc_id long, k long, start int, windows binary")
    hot = shared.where(F.col("n") > HOT_PLACES).select("anchor", F.lit(True).alias("hot"))
    windows = windows.withColumn("hot", F.lit(None).cast("boolean")) if hot.isEmpty() else windows.join(limited(hot), "anchor", "left")
    return windows.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(4 * partitions(rows.sparkSession))))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = ANCHOR_TOKENS, w: int = ANCHOR_SPREAD) -> DataFrame:
    """(doc_id, start, tokens, passage, places): where each passage of k + w - 1 tokens or more lies that has several places.

    passage names it, places counts its places.  A passage ends where the set of its places would change, so every place that has its name
    holds the whole of it.  Every window belongs to one passage, so the result is never larger than the texts.
    """
    key = row_key(id_col, text_col)
    rows = docs.where(F.length(f"`{text_col}`") >= k + w - 1).select(key["a"].alias("doc_id"), key["b"].alias("k"), F.lower(f"`{text_col}`").alias("text"))
    windows = shared_windows(rows, k, w)
    runs = windows.where("hot IS NULL").drop("hot").groupBy("bucket").applyInArrow(extend_places, RUNS)
    runs = runs.unionByName(hot_runs(windows.where("hot")))
    # Runs from neighbouring anchors that touch and have the same places are one.
    document = Window.partitionBy("doc_id", "k").orderBy("first")
    before = lambda x: F.lag(x).over(document)
    same = (before(F.col("first") + F.col("windows")) == F.col("first")) & (before("shape") == F.col("shape")) & (before("away") == F.col("away"))
    joined = runs.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("island", F.sum("new").over(document))
    found = joined.groupBy("doc_id", "k", "island").agg(F.min("first").alias("start"), F.sum("windows").alias("windows"), F.first("shape").alias("shape"), F.first("away").alias("away"))
    named = stored(found.select(F.struct(F.col("doc_id").alias("a"), F.col("k").alias("b")).alias("key"), "start", (F.col("windows") + (k + w - 2)).cast("int").alias("tokens"), F.hex(F.xxhash64("shape", F.col("start") - F.col("away"), "windows")).alias("passage")))
    counted = named.groupBy("passage").agg(F.count(F.lit(1)).alias("places"))
    ids = docs.select(key.alias("key"), F.col(f"`{id_col}`").alias("doc_id")).join(limited(named.select("key").distinct()), "key", "left_semi").distinct()
    return named.join(counted, "passage").join(ids, "key").select("doc_id", "start", "tokens", "passage", "places")
