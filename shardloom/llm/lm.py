"""Language-model scoring by deleted interpolation.

Tokens are runs of letters, digits and non-ASCII characters as they are written,
and single other characters that aren't white space.  Two start tokens precede a
text and an end token follows it.  Trigrams, bigrams and unigrams of all texts are
counted, over an open vocabulary: what is counted grows with the corpus.

The probability of a token mixes the maximum-likelihood estimates of orders 3, 2,
1 and the uniform one over the vocabulary.  The weights depend on the bucket of
the context's frequency and are learned by expectation-maximisation on held-out
counts: those of the documents whose key's hash falls in one of ten parts, against
the counts of the others.  For scoring all documents are in the counts, and every
occurrence is deleted from the counts it is scored by, so a text that the corpus
has once doesn't predict itself and one that it has twice does.

Texts are kept in compressed chunks of about ``CHUNK_BYTES``.  A chunk sends each
distinct n-gram once, as a fingerprint, to the place of its range; a place sums
the counts of all chunks and answers each with as many totals as it sent
fingerprints.  Then a chunk has all it needs.  Fingerprints have ``SPARE_BITS``
bits more than the logarithm of the corpus's tokens, so an n-gram coincides with
another with odds of 2 ** -SPARE_BITS whatever the size.

For the weights, estimates are rounded to ``1 / OCTAVE`` of an octave, so equal
ones can be counted; scores are exact.

Defined results: texts without tokens (null, empty, blank) have 0 tokens and a
null score; very long texts are a chunk of their own; a null identifier is scored
like any other; identifiers keep their type; repeated rows count and are scored
each time; if no document or every one is held out, all serve for both, each
occurrence deleted; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from . import kernels
from .common import kind_of, partitions, row_key, stored
from .kernels import U64, packed, place_cuts, unpacked

cloudpickle.register_pickle_by_value(sys.modules[__name__])
ORDER = 3
HELD_OUT = 10  # one part of so many
BUCKETS = 24
ROUNDS = 30
CHUNK_BYTES = 2 << 20
SPARE_BITS = 16
PLACE_GRAMS = 3_000_000
OCTAVE = 2
START, END = U64(1), U64(2)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK_COLUMNS = "chunk long, held boolean, lengths binary, texts binary, events long, docs long"


def tokens(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes) of all tokens."""
    if not len(raw):
        return np.zeros(len(offsets), np.int64), np.zeros(0, U64)
    word, edge = kernels.WORD[raw], np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins, ends = ~SPACE[raw], ~SPACE[raw]
    begins[1:] &= ~(word[1:] & word[:-1]) | edge[1:-1]
    ends[:-1] &= ~(word[1:] & word[:-1]) | edge[1:-1]
    starts, stops, sums = np.flatnonzero(begins), np.flatnonzero(ends) + 1, kernels.prefix(raw.astype(U64) + U64(1))
    hashes = kernels.mix((sums[stops] - sums[starts]) * kernels.powers(len(raw))[1][starts])
    return np.searchsorted(starts, offsets), np.maximum(hashes, U64(3))


def events(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row of each predicted token, [it, the token before, the one before that]); each row with tokens ends with END."""
    bounds, hashes = tokens(offsets, raw)
    count = np.diff(bounds)
    some = count > 0
    row = np.repeat(np.arange(len(count)), count + some)
    last = np.cumsum(count + some)[some] - 1
    token = np.empty(len(row), U64)
    inner = np.ones(len(row), bool)
    inner[last] = False
    token[inner], token[last] = hashes, END
    out = [token]
    for back in (1, 2):
        before = np.full(len(token), START)
        before[back:] = token[:-back]
        before[back:][row[back:] != row[:-back]] = START
        out.append(before)
    return row, out


def fingerprints(history: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Of orders 1 to 3; the lowest bit tells a unigram."""
    now, one, two = history
    grams = [kernels.mix(now), kernels.mix(kernels.mix(one + U64(0x51)) * kernels.BASE + now), kernels.mix(kernels.mix(kernels.mix(two + U64(0xA7)) * kernels.BASE + one) * kernels.BASE + now)]
    low = U64(1)
    return [(g >> U64(64 - bits)) | low if order == 0 else (g >> U64(64 - bits)) & ~low for order, g in enumerate(grams)]


def chunk_batches(batches):
    """Rows of texts in compressed chunks, held-out documents apart."""
    from pyspark import TaskContext

    chunk, squeeze = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
    for batch in batches:
        held = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
        for flag in (False, True):
            part = batch.filter(pa.array(held == flag))
            for lo, hi, offsets, raw in kernels.chunks(part.column(2), CHUNK_BYTES):
                row, history = events(offsets, raw)
                arrays = [pa.array([chunk]), pa.array([flag]), pa.array([packed(np.diff(offsets))]), pa.array([squeeze.compress(raw.tobytes())]), pa.array([len(row)]), pa.array([len(np.unique(row))])]
                ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), part.column(0).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([*arrays, ids], names=["chunk", "held", "lengths", "texts", "events", "docs", "ids"])
                chunk += 1


def opened(lengths: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.r_[0, np.cumsum(unpacked(lengths).astype(np.int64))]
    return offsets, np.frombuffer(zstandard.ZstdDecompressor().decompress(texts, max_output_size=max(1, int(offsets[-1]))), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)


def request_batches(bits: int, places: int):
    def run(batches):
        for batch in batches:
            for chunk, held, lengths, texts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                grams, times = np.unique(np.concatenate(fingerprints(events(*opened(lengths, texts))[1], bits)), return_counts=True)
                cuts = place_cuts(grams, places, bits)
                rows = [(p, chunk, held, packed(np.diff(grams[a:b], prepend=U64(0))), packed(times[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], names=["place", "chunk", "held", "grams", "times"])

    return run


def answer(group: pa.Table) -> pa.Table:
    """The totals of all fingerprints of a place, for each chunk in the order in which it sent them."""
    grams = [np.cumsum(unpacked(x), dtype=np.uint64) for x in group.column("grams").to_pylist()]
    cuts = np.cumsum([len(g) for g in grams])[:-1]
    times = np.concatenate([unpacked(x) for x in group.column("times").to_pylist()]).astype(np.float64)
    known, at = np.unique(np.concatenate(grams), return_inverse=True)
    held = np.repeat(np.asarray(group.column("held").to_numpy(zero_copy_only=False), bool), [len(g) for g in grams])
    total, apart = (np.bincount(at, w, len(known)).astype(np.uint64) for w in (times, times * held))
    words = np.zeros(len(grams), np.int64)
    words[0] = (known & U64(1)).sum()
    cells = [pa.array([packed(t[x]) for x in np.split(at, cuts)], pa.binary()) for t in (total, apart)]
    del grams, times, known, at, held, total, apart
    kernels.release()
    return pa.table({"chunk": group.column("chunk"), "held": group.column("held"), "place": group.column("place"), "totals": cells[0], "apart": cells[1], "words": pa.array(words)})


def counts_of(chunk: dict, answers: pa.Table, bits: int, columns: tuple) -> tuple:
    """(row of each event, and for each column of the answers the counts of orders 1 to 3) of a chunk."""
    row, history = events(*opened(chunk["lengths"], chunk["texts"]))
    grams, at = np.unique(np.concatenate(fingerprints(history, bits)), return_inverse=True)
    answers, places = answers.sort_by("place"), np.split(at, ORDER)
    out = []
    for column in columns:
        cells = [unpacked(x) for x in answers.column(column).to_pylist()]
        total = np.concatenate(cells).astype(np.float64) if cells else np.zeros(0)
        if len(total) != len(grams):
            raise RuntimeError("a chunk got other answers than it asked for")
        out.append([total[x] for x in places])
    return row, *out


def mixture_parts(row: np.ndarray, counts: list[np.ndarray], events_: float, docs: float, vocabulary: int, less: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, estimates of orders 0 to 3) of each event; ``less``: occurrences of its own to delete."""
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    one, two, three = (np.maximum(c - less, 0) for c in counts)
    before = lambda x: np.r_[0.0, x[:-1]] if len(x) else x
    contexts = [np.where(first, docs - less, before(counts[0]) - less), np.where(first, docs - less, before(counts[1]) - less)]
    parts = np.empty((len(row), ORDER + 1))
    parts[:, 0], parts[:, 1] = 1 / vocabulary, one / max(1, events_ - less)
    for order, n, context in ((2, two, contexts[0]), (3, three, contexts[1])):
        parts[:, order] = n / np.maximum(context, 1)
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(np.maximum(contexts[1], 0) + 1))).astype(np.int64), parts


def rounded(parts: np.ndarray) -> np.ndarray:
    """The logarithms in parts of an octave; 0 is the least."""
    return np.where(parts > 0, np.rint(OCTAVE * np.log2(np.maximum(parts, 1e-300))), -32768).astype(np.int16)


def learn(bucket: np.ndarray, parts: np.ndarray, n: np.ndarray, vocabulary: int) -> np.ndarray:
    """Weights [bucket, order] by expectation-maximisation; parts are rounded estimates of orders 1 to 3."""
    value = np.column_stack([np.full(len(n), 1 / vocabulary), np.where(parts > -32768, 2.0 ** (parts / OCTAVE), 0)])
    weights = np.full((BUCKETS, ORDER + 1), 1 / (ORDER + 1))
    for _ in range(ROUNDS):
        share = weights[bucket] * value
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(ORDER + 1)], axis=1)
        total = sums.sum(axis=1, keepdims=True)
        weights = np.where(total > 0, sums / np.maximum(total, 1e-300), weights)
    # The uniform part keeps a little weight: no text is impossible.
    weights = np.maximum(weights, 1e-9)
    return weights / weights.sum(axis=1, keepdims=True)


def held_counts(bits: int, size: dict, vocabulary: int, deleted: bool):
    """(bucket, rounded estimates, how often) of the events of a chunk."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        row, total, apart = counts_of(chunks.slice(0, 1).to_pylist()[0], answers, bits, ("totals", "apart"))
        counts = total if deleted else [t - a for t, a in zip(total, apart)]
        bucket, parts = mixture_parts(row, counts, size["events"], size["docs"], vocabulary, int(deleted))
        key = np.column_stack([bucket.astype(np.int16), rounded(parts[:, 1:])])
        found, n = np.unique(np.ascontiguousarray(key).view(np.uint64).ravel(), return_counts=True)
        cells = found.view(np.int16).reshape(-1, 4)
        kernels.release()
        return pa.table([pa.array(cells[:, i], pa.int16()) for i in range(4)] + [pa.array(n, pa.int64())], names=["bucket", "p1", "p2", "p3", "n"])

    return run


def scorer(bits: int, size: dict, vocabulary: int, weights: np.ndarray):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        ids = chunks.column("ids").combine_chunks().flatten()
        row, total = counts_of(chunks.select(["lengths", "texts"]).slice(0, 1).to_pylist()[0], answers, bits, ("totals",))
        bucket, parts = mixture_parts(row, total, size["events"], size["docs"], vocabulary, 1)
        logs = np.log2((weights[bucket] * parts).sum(axis=1))
        n = np.bincount(row, minlength=len(ids))
        mean = np.bincount(row, logs, len(ids)) / np.maximum(1, n)
        del row, total, bucket, parts, logs
        kernels.release()
        return pa.table({"doc_id": ids, "tokens": pa.array(n.astype(np.int64)), "mean_log2_probability": pa.array(np.round(mean, 6), mask=n == 0)})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, mean_log2_probability) of every row under the corpus's own model; tokens include the end token."""
    spark, kind = docs.sparkSession, kind_of(docs, id_col)
    held = F.pmod(row_key(id_col, text_col)["a"], F.lit(HELD_OUT)) == 0
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held.alias("held"), F.col(f"`{text_col}`").cast("string").alias("text"))
    chunks = stored(rows.mapInArrow(chunk_batches, f"{CHUNK_COLUMNS}, ids array<{kind}>"), "lm-chunks")
    sizes = {r["held"]: {"events": r["events"], "docs": r["docs"]} for r in chunks.groupBy("held").agg(F.sum("events").alias("events"), F.sum("docs").alias("docs")).collect()}
    whole = {k: sum(s[k] for s in sizes.values()) for k in ("events", "docs")}
    bits = min(64, SPARE_BITS + 1 + max(8, int(whole["events"]).bit_length()))
    places = max(2 * partitions(spark), -(-ORDER * whole["events"] // PLACE_GRAMS))
    asked = chunks.select("chunk", "held", "lengths", "texts").mapInArrow(request_batches(bits, places), "place int, chunk long, held boolean, grams binary, times binary")
    answers = stored(asked.groupBy("place").applyInArrow(answer, "chunk long, held boolean, place int, totals binary, apart binary, words long"), "lm-answers")
    vocabulary = max(1, answers.agg(F.sum("words")).first()[0] or 0)
    deleted = not all(sizes.get(flag, {}).get("events") for flag in (False, True))
    size, some = (whole, lambda df: df) if deleted else (sizes[False], lambda df: df.where("held"))
    told = some(chunks).select("chunk", "lengths", "texts").groupBy("chunk").cogroup(some(answers).select("chunk", "place", "totals", "apart").groupBy("chunk"))
    told = told.applyInArrow(held_counts(bits, size, vocabulary, deleted), "bucket short, p1 short, p2 short, p3 short, n long")
    told = told.groupBy("bucket", "p1", "p2", "p3").agg(F.sum("n").alias("n")).toArrow()  # a bounded number of rounded estimates
    bucket, p1, p2, p3, n = (told.column(c).to_numpy().astype(np.int64) for c in ("bucket", "p1", "p2", "p3", "n"))
    order = np.lexsort((p3, p2, p1, bucket))
    weights = learn(bucket[order], np.column_stack([p1, p2, p3])[order], n[order], vocabulary)
    scored = chunks.select("chunk", "lengths", "texts", "ids").groupBy("chunk").cogroup(answers.select("chunk", "place", "totals").groupBy("chunk"))
    return scored.applyInArrow(scorer(bits, whole, vocabulary, weights), f"doc_id {kind}, tokens long, mean_log2_probability double")
