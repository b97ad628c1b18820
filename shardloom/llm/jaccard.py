"""N-gram Jaccard join by universe partitioning.

A document is the set of its distinct token n-grams.  If two sets have Jaccard
similarity >= t, their symmetric difference is at most
H = (1 - t) / (1 + t) * (|a| + |b|).  Sets are put into overlapping size bands
such that every pair that can reach t shares a band.  A band hashes the universe
into m > H segments; of two similar sets at least m - H segments are equal
(pigeonhole).  So it is enough that each set indexes the H + 1 cheapest of its m
segments, cost being how common the segment's tokens are in the whole corpus
(for a common order of segments, the H + 1 rarest of two sets with m - H equal
ones meet: prefix filtering).  Bands of small sets, where a segment has too few
tokens to tell sets apart, use larger segments with their one-deletion
neighbourhoods: each spends two differences (equal, or equal after one deletion
on either side), and the allocation of H between the two kinds is the one with
the least expected cost.  Candidate pairs are verified exactly on whole texts.

Nothing that is shuffled grows with the square of a group of near copies:

* Equal sets are one node with a number of documents.
* Nodes that share a min-hash key (rare grams weigh most) get one *cell*.  Within
  a cell every pair is verified in place, without signatures; so postings of one
  cell are dropped, and a large cell is one entry of a posting, however many
  members it has.  Any cells give the same result; good ones are only cheaper.
* Entries tell sizes, so sets that are too far apart in size aren't paired.  A set
  indexes AGREE - 1 segments more than it must; similar sets then meet AGREE times,
  and pairs that meet less often go before anything is read of them.
* The rest are checked by parity sketch (a bit differs only if an odd number of
  grams does, so sketches bound the symmetric difference from below).
* A cell's texts travel to one place; a cell of more than ``BLOCK`` nodes is cut
  into blocks, and each pair of blocks is a place of its own.
* A place returns, for each node, its number of links and the smallest node it is
  connected with, never the pairs.

``links`` gives one row for each row of the table: (doc_id, class_id, links).
class_id is the smallest identifier of the documents that are connected by links;
links is the number of other rows with a similarity of t or more, equal ones
included.  ``near_stage`` keeps one document of each class.

Defined results: null and token-less texts have no set, so no links and a class
of their own; texts with fewer than n tokens use the n-gram of all their tokens;
very long texts are taken whole; a null identifier takes part like any other and
names a class only if all its identifiers are null; identifiers keep their type;
repeated rows are linked with one another, and ``near_stage`` keeps one; an empty
table gives an empty result; other columns, whatever their names, are ignored by
``links`` and carried by the stage.  Grams are compared by 64-bit hashes, sets by
64-bit names of these: for s grams in a pair the odds of a wrong similarity are
s**2 / 2**65, for n sets those of one wrong equality n**2 / 2**65.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from . import kernels
from .common import KEY_TYPE, components, keep_rows, limited, partitions, row_key, stored
from .kernels import U64, packed, unpacked

cloudpickle.register_pickle_by_value(sys.modules[__name__])
NGRAM = 1
THRESHOLD = 0.8
BAND_STEP = 2  # a band begins every 1 / THRESHOLD ** BAND_STEP
SLACK = 1.3  # segments for each one that is indexed
RARITY_BITS = 21
RARITY_RANGES = 32
BLOCK = 2048  # nodes of a cell in one place
LARGE_CELL = 4096  # nodes from which a cell is one entry of a posting
KEYS, KEY_GRAMS = 3, 4  # min-hash keys of a set, and the grams that make up one
SIGNATURE_BYTES = 6
SIZE_CODES = 100
AGREE = 4  # at most 7
COMMON = 0.05  # chance that two unrelated documents agree on a token, for the allocation
SKETCH_SHIFT = 20
SIGNATURE_COST = 2e-3  # of a signature row, against a candidate


def gram_sets(offsets: np.ndarray, raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, values): each row's sorted distinct n-gram hashes."""
    bounds, hashes = kernels.tokens(offsets, raw)
    rows = len(offsets) - 1
    if n == 1:
        return kernels.row_sets(np.repeat(np.arange(rows), np.diff(bounds)), hashes, rows)
    at, g = kernels.grams(bounds, hashes, n)
    owner = kernels.row_of(bounds, at)
    count = np.diff(bounds)
    for r in np.flatnonzero((count > 0) & (count < n)):  # a short text is one gram
        owner, g = np.r_[owner, r], np.r_[g, kernels.mix(kernels.prefix(hashes[bounds[r] : bounds[r + 1]])[-1:] + U64(count[r]))]
    order = np.argsort(owner, kind="stable")
    return kernels.row_sets(owner[order], g[order], rows)


def set_ids(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set that doesn't depend on order."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(kernels.mix(values ^ U64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    return kernels.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(U64))


def count_batches(n: int):
    """Of each of RARITY_RANGES ranges of hash buckets the counts of its grams, compressed; range -1 counts sets."""

    def run(batches):
        total, sets = np.zeros(1 << RARITY_BITS, np.uint32), 0
        for batch in batches:
            for _, _, offsets, raw in kernels.chunks(batch.column(0)):
                bounds, values = gram_sets(offsets, raw, n)
                at, times = np.unique((values >> U64(64 - RARITY_BITS)).astype(np.int64), return_counts=True)
                total[at] += times.astype(np.uint32)
                sets += int((np.diff(bounds) > 0).sum())
        cells = [zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes(), 1) for x in np.split(total, RARITY_RANGES)]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, np.arange(RARITY_RANGES)], pa.int32()), pa.array([np.array([sets], np.int64).tobytes(), *cells], pa.binary())], names=["range", "counts"])

    return run


def sum_range(group: pa.Table) -> pa.Table:
    """The counts of a range over all tasks: of sets as they are, of grams 4 times their logarithm."""
    cells = group.column("counts").to_pylist()
    if group.column("range")[0].as_py() < 0:
        out = np.sum([np.frombuffer(x, np.int64) for x in cells], axis=0).tobytes()
    else:
        total = sum(np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64) for x in cells)
        out = np.rint(4 * np.log2(total + 1)).astype(np.uint8).tobytes()
    return pa.table({"range": group.column("range").slice(0, 1), "counts": pa.array([out], pa.binary())})


def rarity(rows: DataFrame, n: int) -> np.ndarray:
    """Of each of 2 ** RARITY_BITS hash buckets, 4 times the log of how rare its grams are in the corpus (2 MB whatever the corpus, so collected)."""
    schema = "range int, counts binary"
    found = {r["range"]: bytes(r["counts"]) for r in rows.select("text").mapInArrow(count_batches(n), schema).groupBy("range").applyInArrow(sum_range, schema).collect()}
    if not found:
        return np.zeros(1 << RARITY_BITS, np.uint8)
    logs = np.frombuffer(b"".join(found[r] for r in range(RARITY_RANGES)), np.uint8).astype(np.int64)
    return (round(4 * np.log2(np.frombuffer(found[-1], np.int64)[0] + 1)) - logs).clip(0, 255).astype(np.uint8)


def allocate(low: int, high: int, budget: int) -> tuple[int, int]:
    """(segments with deletions, exact segments) for a band of sets of low..high grams and at most ``budget`` differences."""
    best, middle = (math.inf, 0, 1), (low + high) / 2
    for twos in {0, *(x for x in (1, 2, 3, (budget + 1) // 2) if 2 * x <= budget + 1)}:
        ones = budget + 1 - 2 * twos
        exact = math.ceil(ones * SLACK) if ones else 0
        each = middle / (2 * twos + max(1, exact) if ones else twos)
        cost = twos * ((2 * each + 1) * SIGNATURE_COST + COMMON ** max(0.5, 2 * each - 1)) + ones * (SIGNATURE_COST + COMMON ** max(0.5, each))
        best = min(best, (cost, twos, exact))
    return best[1:]


class Bands:
    """The bands of a threshold; each starts at ``step ** t`` and reaches far enough for all partners."""

    def __init__(self, threshold: float, step: int = BAND_STEP):
        self.t, self.ratio = threshold, (1 / threshold) ** step
        self.alpha = (1 - threshold) / (1 + threshold)
        self.known: dict[int, tuple[int, int, int, int]] = {}

    def differences(self, total: np.ndarray) -> np.ndarray:
        return np.floor(self.alpha * total + 1e-9).astype(np.int64)

    def of(self, sizes: np.ndarray):
        """(band, members, largest size, segments with deletions, exact segments) for every band of the sizes."""
        top = np.floor(np.log(np.maximum(sizes, 1)) / np.log(self.ratio) + 1e-9).astype(np.int64)
        for band in np.unique(top):
            yield from self.one(int(band), sizes)
        for band in np.setdiff1d(np.unique(top) - 1, np.unique(top)):
            if band >= 0:
                yield from self.one(int(band), sizes)

    def one(self, band: int, sizes: np.ndarray):
        low = self.ratio**band
        high = low * self.ratio / self.t
        member = np.flatnonzero((sizes >= low - 1e-6) & (sizes <= high + 1e-6))
        if len(member):
            if band not in self.known:
                lo, hi = math.ceil(low - 1e-6), math.floor(high + 1e-6)
                self.known[band] = (hi, *allocate(lo, hi, int(self.differences(np.array(2 * hi)))))
            yield band, member, *self.known[band]


def meetings(spare: int) -> int:
    """How many equal segments to ask for, if so many beyond the differences can be indexed: a divisor of AGREE."""
    return max(m for m in range(1, AGREE + 1) if AGREE % m == 0 and m <= max(1, spare))


def weighted(sig: np.ndarray, weight: int) -> np.ndarray:
    """Signatures with their weight in the lowest bits: similar sets of a band meet under weights of AGREE in all."""
    return (sig & ~U64(7)) | U64(weight)


def signatures(bounds: np.ndarray, values: np.ndarray, rare: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of everything the rows index."""
    sizes, rows_out, sigs_out = np.diff(bounds), [], []
    row_all = np.repeat(np.arange(len(sizes)), sizes)
    for band, member, high, twos, ones in bands.of(sizes):
        slot = np.full(len(sizes), -1)
        slot[member] = np.arange(len(member))
        mine = slot[row_all] >= 0
        v, row = values[mine], slot[row_all[mine]]
        size = sizes[member]
        salt = U64((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        # The larger segments, with deletions, come first in the universe: each has the share of two exact ones.
        units = 2 * twos + ones
        unit = (((v & U64(0xFFFFFFFF)) * U64(units)) >> U64(32)).astype(np.int64)
        segment = np.where(unit < 2 * twos, unit // 2, unit - twos)
        count = twos + ones
        key = row * count + segment
        total = len(member) * count
        low, top = v & U64(0xFFFFFFFF), v >> U64(32)
        content = np.bincount(key, low.astype(np.float64), total).astype(U64) + (np.bincount(key, top.astype(np.float64), total).astype(U64) << U64(32))
        name = kernels.mix(np.tile(np.arange(1, count + 1).astype(U64), len(member)) * U64(0xD6E8FEB86659FD93) + salt)
        if twos:
            two = np.flatnonzero(segment < twos)
            whole = (np.arange(total) % count) < twos
            rows_out += [member[np.flatnonzero(whole) // count], member[row[two]]]
            sigs_out += [weighted(kernels.mix(x), AGREE) for x in (content[whole] ^ name[whole], (content[key[two]] - v[two]) ^ name[key[two]])]
        if ones:
            # Differences left if no segment with deletions meets: each of these then has at least two.
            # AGREE segments more are indexed where the band has them: similar sets then meet that often.
            differ = np.maximum(-1, bands.differences(size + np.minimum(np.floor(size / bands.t + 1e-9), high)) - 2 * twos)
            cost = np.bincount(key, rare[(v >> U64(64 - RARITY_BITS)).astype(np.int64)], total).astype(np.int64)
            exact = np.flatnonzero((np.arange(total) % count) >= twos)
            row_of, sig = exact // count, kernels.mix(content[exact] ^ name[exact])
            order = np.lexsort((sig, -cost[exact], row_of))
            rank = np.arange(len(exact)) - row_of * ones
            meet = 1 if twos else meetings(ones - int(differ.max()))
            keep = order[rank < np.minimum(differ + meet, ones)[row_of]]
            rows_out.append(member[row_of[keep]])
            sigs_out.append(weighted(sig[keep], AGREE // meet))
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(rows_out), np.concatenate(sigs_out)


def sketches(bounds: np.ndarray, values: np.ndarray) -> list[bytes]:
    """Of each row the parity of its grams in a power of two of bits, about as many as it has grams, and 64 at least."""
    size = np.diff(bounds)
    bits = 64 << np.rint(np.log2(np.maximum(1, size / 64))).astype(np.int64)
    begin = np.r_[0, np.cumsum(bits)]
    row = np.repeat(np.arange(len(size)), size)
    place = begin[row] + ((values >> U64(SKETCH_SHIFT)) & (bits[row] - 1).astype(U64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=begin[-1]) & 1).astype(bool), bitorder="little").tobytes()
    return [packed[begin[i] >> 3 : begin[i + 1] >> 3] for i in range(len(size))]


def cell_keys(bounds: np.ndarray, values: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """KEYS numbers for each row that near copies are likely to share: each names KEY_GRAMS grams drawn by weighted min-hash."""
    size = np.diff(bounds)
    some = np.flatnonzero(size)
    out = np.zeros((len(size), KEYS), U64)
    if not len(some):
        return out
    weight = rare[(values >> U64(64 - RARITY_BITS)).astype(np.int64)] + 1e-3
    begin, row = bounds[:-1][some], np.repeat(np.arange(len(some)), size[some])
    for key in range(KEYS):
        name = np.full(len(some), U64(key + 1))
        for draw in range(KEY_GRAMS):
            mixed = kernels.mix(values ^ U64((key * KEY_GRAMS + draw + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64)))
            cost = -np.log(((mixed >> U64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
            best = np.minimum.reduceat(cost, begin)
            drawn = np.maximum.reduceat(np.where(cost == best[row], mixed, U64(0)), begin)
            name = kernels.mix(name * kernels.BASE + drawn)
        out[some, key] = name
    return out


def set_batches(n: int, rare):
    def run(batches):
        for batch in batches:
            for lo, hi, offsets, raw in kernels.chunks(batch.column(1)):
                bounds, values = gram_sets(offsets, raw, n)
                keys = cell_keys(bounds, values, rare.value).view(np.int64)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(set_ids(bounds, values).view(np.int64)), pa.array(np.diff(bounds).astype(np.int32)), pa.array(sketches(bounds, values), pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), KEYS).cast(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "sid", "size", "sketch", "keys"]).filter(pa.array(np.diff(bounds) > 0))
            kernels.release()

    return run


def signature_batches(n: int, threshold: float, rare):
    """(sid, signatures): one row for each document, SIGNATURE_BYTES for each signature."""

    def run(batches):
        bands = Bands(threshold)
        for batch in batches:
            for _, _, offsets, raw in kernels.chunks(batch.column(0)):
                bounds, values = gram_sets(offsets, raw, n)
                row, sig = signatures(bounds, values, rare.value, bands)
                order = np.argsort(row, kind="stable")
                data = np.ascontiguousarray(sig[order]).view(np.uint8).reshape(-1, 8)[:, :SIGNATURE_BYTES].tobytes()
                cut = np.searchsorted(row[order], np.arange(len(bounds))) * SIGNATURE_BYTES
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(bounds, values).view(np.int64)), packed], names=["sid", "sigs"]).filter(pa.array(np.diff(bounds) > 0))
            kernels.release()

    return run


def entry_batches(batches):
    """(sig, node) of each signature of each node."""
    for batch in batches:
        offsets, raw = kernels.string_parts(batch.column(1))
        sig = np.zeros((len(raw) // SIGNATURE_BYTES, 8), np.uint8)
        sig[:, :SIGNATURE_BYTES] = raw.reshape(-1, SIGNATURE_BYTES)
        node = np.repeat(batch.column(0).to_numpy(), np.diff(offsets) // SIGNATURE_BYTES)
        yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64).ravel()), pa.array(node)], names=["sig", "node"])


def folded(sketch: np.ndarray, width: int) -> np.ndarray:
    while sketch.shape[1] > width:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def sketch_rows(offsets: np.ndarray, raw: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The sketches of rows that all have ``width`` words."""
    return raw.view(U64)[(offsets[at] // 8)[:, None] + np.arange(width)]


def near_enough(a: np.ndarray, b: np.ndarray, size: np.ndarray, offsets: np.ndarray, raw: np.ndarray, threshold: float, bands: Bands) -> np.ndarray:
    """Which of the pairs of rows a, b their sizes and sketches don't exclude; rows without a sketch aren't excluded."""
    words = np.diff(offsets) // 8
    bare = (words[a] == 0) | (words[b] == 0)
    keep = bare | (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9)
    told = np.flatnonzero(keep & ~bare)
    shape = words[a[told]] << 32 | words[b[told]]
    for both in np.unique(shape):
        for at in np.array_split(told[shape == both], max(1, int((shape == both).sum()) >> 15)):
            wide = (int(both) >> 32, int(both) & 0xFFFFFFFF)
            left, right = (folded(sketch_rows(offsets, raw, x[at], w), min(wide)) for x, w in zip((a, b), wide))
            keep[at] = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64) <= bands.differences(size[a[at]] + size[b[at]])
    return keep


def meeting_batches(threshold: float, places: int):
    """The pairs of nodes of different cells and near sizes that share a posting, with their weights: compressed, by place."""
    apart = size_distance(threshold)

    def flush(held):
        a, b, weight = (np.concatenate(x) for x in zip(*held))
        place = (kernels.mix(a.view(U64) + kernels.mix(b.view(U64))) % U64(places)).astype(np.int32)
        order = np.lexsort((b, a, place))
        a, b, weight, place = a[order], b[order], weight[order], place[order]
        cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]).tolist()
        rows = [(int(place[i]), packed(np.diff(a[i:j].view(U64), prepend=U64(0))), packed(b[i:j].view(U64)), packed(weight[i:j])) for i, j in zip(cuts, [*cuts[1:], len(a)])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["place", "a", "b", "weight"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            lists, weight = batch.column(0), batch.column(1).to_numpy()
            node, cuts = lists.flatten().to_numpy(), np.asarray(lists.offsets)
            cell, code = node >> 32, node & 1023
            end, weight = np.repeat(cuts[1:] - cuts[0], np.diff(cuts)), np.repeat(weight, np.diff(cuts))
            at, step = np.arange(len(node)), 1
            while True:
                at = at[at + step < end[at]]  # pairs of entries ``step`` apart, for every posting at once
                if not len(at):
                    break
                near = (cell[at] != cell[at + step]) & ((code[at] == 0) | (code[at + step] == 0) | (np.abs(code[at] - code[at + step]) <= apart))
                a, b = node[at[near]], node[at[near] + step]
                held.append((np.minimum(a, b), np.maximum(a, b), np.where((code[at[near]] == 0) | (code[at[near] + step] == 0), AGREE, weight[at[near]]).astype(np.uint64)))
                rows, step = rows + len(a), step + 1
                if rows > 500_000:
                    yield flush(held)
                    held, rows = [], 0
        if rows:
            yield flush(held)

    return run


def enough_meetings(group: pa.Table) -> pa.Table:
    """(a, b) of the pairs of a place that meet under weights of AGREE or more."""
    a = np.concatenate([np.cumsum(unpacked(x), dtype=np.uint64) for x in group.column("a").to_pylist()]).view(np.int64)
    b, weight = (np.concatenate([unpacked(x) for x in group.column(c).to_pylist()]) for c in ("b", "weight"))
    order = np.lexsort((b, a))
    a, b, weight = a[order], b.view(np.int64)[order], weight[order].astype(np.int64)
    head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    good = head[np.add.reduceat(weight, head) >= AGREE]
    return pa.table({"a": pa.array(a[good]), "b": pa.array(b[good])})


def near_batches(threshold: float):
    """(a, b) of the pairs that their sizes and sketches don't exclude; one without a sketch isn't excluded."""

    def run(batches):
        bands = Bands(threshold)
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            size, n = np.concatenate([a, b]), batch.num_rows
            (left, x), (right, y) = (kernels.string_parts(batch.column(i)) for i in (4, 5))
            keep = near_enough(np.arange(n), np.arange(n) + n, size, np.concatenate([left, left[-1] + right[1:]]), np.concatenate([x, y]), threshold, bands)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def first_rows(batches):
    """Each sid once for each batch."""
    for batch in batches:
        _, at = np.unique(batch.column(0).to_numpy(), return_index=True)
        yield batch.take(pa.array(np.sort(at)))


class Groups:
    """Links and connected groups of the nodes of a place."""

    def __init__(self, sids: np.ndarray, docs: np.ndarray):
        self.docs, self.links, self.parent = docs, np.zeros(len(sids), np.int64), list(range(len(sids)))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, a: np.ndarray, b: np.ndarray):
        np.add.at(self.links, a, self.docs[b])
        np.add.at(self.links, b, self.docs[a])
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)


def common_grams(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many values each two of the sets share."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, name, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    renamed = np.full(len(times), -1)
    renamed[times > 1] = np.arange((times > 1).sum())
    name = renamed[name]
    row, name = row[name >= 0], name[name >= 0]
    out, order = np.zeros((len(sets), len(sets)), np.float32), np.argsort(name, kind="stable")
    row, name = row[order], name[order]
    for low in range(0, int(name[-1]) + 1 if len(name) else 0, columns):
        part = slice(*np.searchsorted(name, [low, low + columns]))
        x = np.zeros((len(sets), min(columns, int(name[-1]) + 1 - low)), np.float32)
        x[row[part], name[part] - low] = 1
        out += x @ x.T
    return out


def verifier(n: int, threshold: float):
    """Links and groups of one place.  Its rows: members of a unit (x, side), any two of which are compared, or left with right; and single pairs (x, y)."""

    def verify(wanted: pa.Table, texts: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        grams: dict[int, np.ndarray] = {}
        names = texts.column("sid").to_numpy()
        if len(texts):
            for lo, hi, offsets, raw in kernels.chunks(texts.column("text").chunk(0)):
                bounds, values = gram_sets(offsets, raw, n)
                for i in range(hi - lo):
                    grams[int(names[lo + i])] = values[bounds[i] : bounds[i + 1]]
        sids = np.array(sorted(grams), np.int64)
        docs = np.ones(len(sids), np.int64)
        docs[np.searchsorted(sids, names)] = texts.column("docs").to_numpy()
        sets = [grams[s] for s in sids.tolist()]
        size, groups = np.array([len(s) for s in sets], np.float64), Groups(sids, docs)
        unit, x, y, side = (wanted.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "x", "y", "side"))
        enough = lambda both, a, b: both >= threshold * (size[a] + size[b] - both) - 1e-9
        single = side == 3
        order = np.lexsort((y[single], x[single]))
        left, right = np.searchsorted(sids, x[single][order]), np.searchsorted(sids, y[single][order])
        both = np.array([np.intersect1d(sets[a], sets[b], assume_unique=True).size for a, b in zip(left.tolist(), right.tolist())], np.float64)
        good = enough(both, left, right) if len(left) else np.zeros(0, bool)
        groups.link(left[good], right[good])
        order = np.flatnonzero(~single)  # a node is in a unit once
        order = order[np.lexsort((x[order], unit[order]))]
        cut = np.flatnonzero(np.r_[True, unit[order][1:] != unit[order][:-1]]) if len(order) else np.zeros(0, int)
        for begin, end in zip(cut, np.r_[cut[1:], len(order)]):
            member = np.searchsorted(sids, x[order[begin:end]])
            part = side[order[begin:end]]
            shared = common_grams([sets[i] for i in member.tolist()])
            a, b = np.nonzero(np.triu(enough(shared, member[:, None], member[None, :]), 1))
            keep = (part[a] == 0) | (part[a] != part[b])
            groups.link(member[a[keep]], member[b[keep]])
        at = np.flatnonzero(groups.links)
        kernels.release()
        return pa.table({"sid": pa.array(sids[at]), "root": pa.array(sids[[groups.root(i) for i in at.tolist()]], pa.int64()), "links": pa.array(groups.links[at])})

    return verify


def size_code(size: str) -> Column:
    """A number from 1 to 1023 that grows by one for every percent of size."""
    return F.least(F.lit(1023), F.floor(F.log(F.col(size).cast("double")) * SIZE_CODES) + 1).cast("long")


def size_distance(threshold: float) -> int:
    """How far apart the size codes of similar sets can be."""
    return math.ceil(-math.log(threshold) * SIZE_CODES + 1e-9)


def meeting(nodes: str, threshold: float) -> Column:
    """The entries of a list that have one of another cell and a size near theirs; long lists are left as they are."""
    apart = size_distance(threshold)
    cell, code = (lambda x: F.shiftright(x, 32)), (lambda x: x.bitwiseAND(1023))
    near = lambda x, y: (cell(x) != cell(y)) & ((code(x) == 0) | (code(y) == 0) | (F.abs(code(x) - code(y)) <= apart))
    return F.when(F.size(nodes) <= 64, F.filter(nodes, lambda x: F.exists(nodes, lambda y: near(x, y)))).otherwise(F.col(nodes))


def cells_of(nodes: DataFrame) -> DataFrame:
    """(sid, cell): nodes that share a key, or share one with a node that does, mostly get one cell; cells are numbers of 32 bits."""
    keys = nodes.select("sid", F.explode("keys").alias("key"))
    label = nodes.select("sid", F.col("sid").alias("label"))
    for _ in range(2):
        least = keys.join(label, "sid").groupBy("key").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        found = keys.join(least, "key").groupBy("sid").agg(F.min("label").alias("near"))
        label = label.join(found, "sid", "left").select("sid", F.least("label", "near").alias("label"))
    return label.select("sid", F.shiftright(F.xxhash64("label"), 32).cast("int").alias("cell"))


def linked_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(documents with their sets: k, sid; sets with links to others: sid, root, links); k is the row's key."""
    spark = docs.sparkSession
    rows = docs.where(F.col(f"`{text_col}`").isNotNull()).select(row_key(id_col, text_col).alias("k"), F.lower(f"`{text_col}`").alias("text"))
    rare = spark.sparkContext.broadcast(rarity(rows, n))
    sets = stored(rows.mapInArrow(set_batches(n, rare), f"{KEY_TYPE}, sid long, size int, sketch binary, keys array<long>"))
    nodes = sets.groupBy("sid").agg(F.count(F.lit(1)).alias("docs"), F.min("k").alias("k"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    nodes = stored(nodes.join(cells_of(nodes), "sid").drop("keys"))
    crowd = nodes.groupBy("cell").agg(F.count(F.lit(1)).alias("crowd"))
    # An entry has its cell in the upper half, then bits of the set's name and its size; where two sets of a cell coincide, both are candidates.
    nodes = nodes.join(crowd.where("crowd > 1"), "cell", "left").withColumn("crowd", F.coalesce("crowd", F.lit(1)))
    entry = F.when(F.col("crowd") >= LARGE_CELL, F.shiftleft(F.col("cell").cast("long"), 32)).otherwise(F.shiftleft(F.col("cell").cast("long"), 32).bitwiseOR(F.when(F.col("crowd") > 1, F.shiftleft(F.col("sid").bitwiseAND((1 << 22) - 1), 10)).otherwise(0)).bitwiseOR(size_code("size")))
    nodes = stored(nodes.withColumn("node", entry))
    signed = rows.select("text").mapInArrow(signature_batches(n, threshold, rare), "sid long, sigs binary").groupBy("sid").agg(F.first("sigs").alias("sigs"))
    entries = signed.join(nodes.select("sid", "node"), "sid").select("node", "sigs").mapInArrow(entry_batches, "sig long, node long")
    posts = entries.groupBy("sig").agg(F.collect_set("node").alias("nodes")).where(F.shiftright(F.array_min("nodes"), 32) != F.shiftright(F.array_max("nodes"), 32))
    posts = posts.select(meeting("nodes", threshold).alias("nodes"), F.col("sig").bitwiseAND(7).alias("weight")).where("size(nodes) > 1")
    met = posts.mapInArrow(meeting_batches(threshold, 2 * partitions(spark)), "place int, a binary, b binary, weight binary").groupBy("place").applyInArrow(enough_meetings, "a long, b long")
    met = stored(met)
    large = nodes.where(F.col("crowd") >= LARGE_CELL).select("node", "cell").distinct()
    told = nodes.where(F.col("crowd") < LARGE_CELL).select("node", "size", "sketch").unionByName(large.select("node", F.lit(0).alias("size"), F.lit(b"").alias("sketch")))
    said = lambda x: told.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("sketch").alias(f"{x}_sketch"))
    described = met.join(said("a"), "a").join(said("b"), "b").select("a", "b", "a_size", "b_size", "a_sketch", "b_sketch")
    pairs = stored(described.mapInArrow(near_batches(threshold), "a long, b long").distinct())
    # Back to sets.  A pair with a large cell stands for all its members: the other side is a guest of the cell.
    few, many, host = nodes.where(F.col("crowd") < LARGE_CELL), nodes.where(F.col("crowd") >= LARGE_CELL), large
    side = lambda df, x: df.withColumnRenamed("node", x)
    few, many = few.select("node", "sid", "cell"), many.select("node", "sid")
    single = pairs.join(side(few, "a"), "a").withColumnRenamed("sid", "x").join(side(few.select("node", F.col("sid").alias("y")), "b"), "b").select("cell", "x", "y")
    turned = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    guest = turned.join(side(host, "a"), "a").join(side(few.select("node", "sid"), "b"), "b").select("cell", "sid")
    guest = guest.unionByName(pairs.join(side(host, "a"), "a").join(side(many, "b"), "b").select("cell", "sid")).distinct()
    guests = guest.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(8 * partitions(spark))).cast("int")
    blocks = F.ceil(F.col("crowd") / BLOCK).cast("int")
    member = nodes.where("crowd > 1").select("cell", "sid", blocks.alias("blocks"), F.pmod(F.xxhash64("sid"), blocks).cast("int").alias("mine"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    row = lambda low, high, side, x="sid", y="sid": [place("cell", low, high).alias("place"), F.xxhash64("cell", low, high).alias("unit"), F.col(x).alias("x"), F.col(y).alias("y"), F.coalesce(side, F.lit(0)).alias("side")]
    zero = F.lit(0)
    work = single.select(*row(zero, zero, F.lit(3), "x", "y"))
    work = work.unionByName(member.withColumn("other", every("blocks")).select(*row(low, high, F.when(F.col("mine") < F.col("other"), 1).when(F.col("mine") > F.col("other"), 2))))
    work = work.unionByName(member.join(guests, "cell").withColumn("part", every("parts")).select(*row(-1 - F.col("part"), F.col("mine"), F.lit(1))))
    guest = guest.join(guests, "cell").join(crowd, "cell").withColumn("blocks", blocks).withColumn("mine", every("blocks"))
    work = stored(work.unionByName(guest.select(*row(-1 - F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"), F.col("mine"), F.lit(2)))))
    wanted = work.select(F.col("place").alias("spot"), F.explode(F.array("x", "y")).alias("sid")).distinct()
    source = limited(stored(wanted.select("sid").distinct().join(nodes.select("sid", "k", "docs"), "sid")))
    texts = rows.join(source, "k").select("sid", "docs", "text").mapInArrow(first_rows, "sid long, docs long, text string")
    texts = wanted.join(texts, "sid").select("spot", "sid", "docs", "text")
    found = stored(work.groupBy("place").cogroup(texts.groupBy("spot")).applyInArrow(verifier(n, threshold), "sid long, root long, links long"))
    return sets.select("k", "sid"), found


def classes(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> DataFrame:
    """(k, root, links) of every row that has a set; root names the class."""
    sets, found = linked_sets(docs, id_col, text_col, n, threshold)
    roots = components(found, "sid", "root")
    known = found.groupBy("sid").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    copies = sets.groupBy("sid").agg((F.count(F.lit(1)) - 1).alias("more"))
    known = copies.join(known, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("more")).alias("links"))
    return sets.join(known, "sid").select("k", "root", "links")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of every row."""
    found = classes(docs, id_col, text_col, n, threshold).distinct()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(id_col, text_col).alias("k")).join(found, "k", "left")
    first = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rows.join(first, "root", "left").select("doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def near_stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: that of the smallest identifier."""
    found = classes(docs, id_col, text_col, n, threshold).select("k", F.col("root").alias("group")).distinct()
    return keep_rows(docs, found, id_col, text_col)
