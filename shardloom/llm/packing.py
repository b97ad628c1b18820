"""Sum-of-squares online packing of documents into windows of fixed length.

Documents come in the order of their identifiers.  A level array counts the
partially filled windows at every fill level; a document goes to the level where
the sum of the squared counts grows least (an empty window is level 0; full
windows aren't counted; among equals, the fullest level).  A document longer
than a window fills whole windows of its own first; only its rest is placed.

To pack in parallel the documents are dealt to ``lanes`` by a hash of identifier
and text; each lane is an online packing of its own, which one task runs as a
stream: it holds the level array and the open windows' numbers, never texts.  The
number of lanes is a parameter and doesn't depend on the data, so a document's
place doesn't change when rows that go to other lanes are added.

Every row carries its part of the text: the tokens of a window are those of its
rows in the order of ``start``.  A token is a run without ASCII white space.

Defined results: a document without tokens (null, empty or blank) gets one row
with a null window, a null text and length 0; very long texts are cut into
windows; a null identifier sorts first and is packed, in all lanes; identifiers
keep their type; repeated rows are packed each time; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from . import kernels
from .common import kind_of, row_key

cloudpickle.register_pickle_by_value(sys.modules[__name__])
WINDOW_TOKENS = 2048
LANES = 64
BATCH_BYTES = 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Packer:
    """The online packing of one lane."""

    def __init__(self, capacity: int):
        self.capacity, self.windows = capacity, 0
        self.level = np.zeros(capacity + 1, np.int64)  # level[capacity] stays 0
        self.waiting: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int):
        """(window, start, length) of each piece of a document."""
        while length >= self.capacity:
            yield self.windows, 0, self.capacity
            self.windows, length = self.windows + 1, length - self.capacity
        if not length:
            return
        level, capacity = self.level, self.capacity
        growth = 2 * (level[length:] - level[: capacity + 1 - length]) + 2
        growth[-1] -= 1  # a window that becomes full leaves the count
        growth[level[: capacity + 1 - length] == 0] = np.iinfo(np.int64).max
        growth[0] = 2 * level[length] + 1
        at = len(growth) - 1 - int(np.argmin(growth[::-1]))
        if at:
            window = self.waiting[at].pop()
            level[at] -= 1
        else:
            window, self.windows = self.windows, self.windows + 1
        yield window, at, length
        if at + length < capacity:
            level[at + length] += 1
            self.waiting[at + length].append(window)


def place_all(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, window, start, length) of each piece of the items, in the order of placing."""
    packer = Packer(capacity)
    cols = np.array([(item, *piece) for item, length in enumerate(lengths.tolist()) for piece in packer.place(length)], np.int64).reshape(-1, 4)
    return cols[:, 0], cols[:, 1], cols[:, 2], cols[:, 3]


def token_edges(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, first bytes, bytes after the last) of all tokens."""
    some, edge = ~SPACE[raw], np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins, ends = some.copy(), some.copy()
    begins[1:] &= ~some[:-1] | edge[1:-1]
    ends[:-1] &= ~some[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return np.searchsorted(starts, offsets), starts, np.flatnonzero(ends) + 1


def lane_batches(capacity: int):
    """Pieces with their texts, from rows (doc_id, text, lane) in the order of lanes and identifiers."""

    def run(batches):
        packer = current = None
        for batch in batches:
            lanes = batch.column(2).to_pylist()
            for lo, hi, offsets, raw in kernels.chunks(batch.column(1), BATCH_BYTES):
                bounds, starts, stops = token_edges(offsets, raw) if len(raw) else (np.zeros(hi - lo + 1, np.int64),) * 3
                rows, out, cuts = [], [], []
                for i in range(hi - lo):
                    if lanes[lo + i] != current:
                        current, packer = lanes[lo + i], Packer(capacity)
                    token, end = int(bounds[i]), int(bounds[i + 1])
                    if token == end:
                        rows.append(lo + i)
                        out.append((0, current, None, 0, 0))
                        cuts.append((0, 0))
                    for piece, (window, start, length) in enumerate(packer.place(end - token)):
                        rows.append(lo + i)
                        out.append((piece, current, window, start, length))
                        cuts.append((int(starts[token]), int(stops[token + length - 1])))
                        token += length
                data = raw.tobytes()
                texts = [data[a:b].decode() if b else None for a, b in cuts]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns, pa.array(texts, pa.string())], names=["doc_id", "piece", "lane", "window", "start", "length", "text"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = WINDOW_TOKENS, lanes: int = LANES) -> DataFrame:
    """(doc_id, piece, lane, window, start, length, text): where each piece of each document lies, and its text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), row_key(id_col, text_col).alias("k"))
    rows = rows.withColumn("lane", F.pmod("k.a", F.lit(lanes)).cast("int"))
    rows = rows.repartition("lane").sortWithinPartitions("lane", F.col("doc_id").asc_nulls_first(), "k").select("doc_id", "text", "lane")
    kind = kind_of(docs, id_col)
    return rows.mapInArrow(lane_batches(capacity), f"doc_id {kind}, piece int, lane int, window long, start int, length int, text string")
