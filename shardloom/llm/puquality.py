"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled clean (quality 1, toxic 0); unlabelled
are the documents without a label.  A linear model on indicators (tokens and
beginnings of tokens that are far more frequent in unlabelled documents than in
positives) and on the shape of the text (binned at the quantiles of the
positives) minimises the non-negative unbiased risk

    pi R_p(+) + max(0, R_u(-) - pi R_p(-))

with logistic loss; where the second part turns negative, by more than one
standard error of its estimate, its gradient is reversed.  The class prior pi is estimated from the scores of two
positive-against-unlabelled models, each fitted on one half and used on the
other: the smallest bound, over score thresholds, of the ratio of the unlabelled
to the positive share above the threshold.

All documents with a text count: word counts for the indicators, the two shares
for the prior, and the risk, whose last ``ALL_STEPS`` gradient steps go over the
stored features of every positive and unlabelled document.  Only these are
bounded: the quantiles and the model those steps begin with use the ``sample``
positives and ``sample`` unlabelled rows with the smallest hash, and the model has
the ``VOCABULARY`` indicators whose contrast is greatest, ``MIN_Z`` at least.  An
indicator can only speak against a document.

Defined results: a null or blank text is rejected; very long texts are scored
whole; a score of 0 is kept; documents with a null identifier are scored like
others and count as unlabelled; identifiers keep their type; repeated rows get
equal scores; with fewer than ``MIN_POSITIVES`` positives, or no unlabelled rows,
nothing is known and every document with text is kept with a null score; an empty
table gives an empty result; other columns, whatever their names, are carried by
``quality_stage``.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from . import kernels
from .common import columns, kind_of, limited, partitions, stored
from .kernels import U64, packed, place_cuts, unpacked

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SAMPLE = 8000
VOCABULARY = 1024
MIN_Z = 4.5
PREFIXES = (6, 7, 8)  # bytes of a token's beginning
QUANTILES = [0.005, 0.05, 0.25, 0.75, 0.95, 0.995, 1.0]
BINS = len(QUANTILES) + 1
MIN_POSITIVES = 20
STEPS = 500
ALL_STEPS = 30
RATE = 0.1  # below the inverse of the risk's curvature
SCORE_BINS, SCORE_RANGE = 4096, 32.0  # of the histograms for the prior
DECAY = 5e-4
CONFIDENCE = 0.1
WORD_BITS = 63
FLUSH_WORDS = 2_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"?-()", "!", "|", "*#$%&@^~_=+<>/\\{}[]", "\n"]
CLASS_OF = np.zeros(256, np.uint8)
for _i, _c in enumerate(CLASSES):
    CLASS_OF[[ord(x) for x in _c]] = _i + 1


def features(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows and hashes of all tokens and of their beginnings, a row of shape numbers for each row)."""
    n = len(offsets) - 1
    bounds, hashes, begin_rows, begins = kernels.tokens_and_prefixes(offsets, LOWER[raw] if len(raw) else raw, PREFIXES)
    count, size = np.diff(bounds), np.maximum(1, np.diff(offsets))
    rows = np.repeat(np.arange(n), count)
    set_bounds, _ = kernels.row_sets(rows, hashes, n)
    byte_row = np.repeat(np.arange(n), np.diff(offsets))
    classes = np.bincount(byte_row * 8 + CLASS_OF[raw], minlength=8 * n).reshape(n, 8)[:, 1:]
    again = np.zeros(n)
    if len(hashes) > 1:
        same = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
        again = np.bincount(rows[1:][same], minlength=n)
    per = np.maximum(1, count)
    shape = np.column_stack([classes / size[:, None], classes[:, 3:6] / per[:, None], again / per, np.diff(set_bounds) / np.sqrt(per), size / per, np.log2(size)])
    return np.concatenate([rows, begin_rows]), np.concatenate([hashes, begins]), shape


def found_words(words: np.ndarray, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in words) of every distinct word of a row; words are sorted."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(1 << 16, bool)
    first[(words >> U64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(first[(values >> U64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(words, values[maybe]), len(words) - 1)
    hit = words[at] == values[maybe]
    pairs = np.unique(rows[maybe[hit]] * len(words) + at[hit])
    return pairs // len(words), pairs % len(words)


def merged_counts(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, positive rows, unlabelled rows) of several such triples."""
    known, at = np.unique(np.concatenate([w for w, _, _ in parts]), return_inverse=True)
    return known, *(np.bincount(at, np.concatenate([x[k] for x in parts]), len(known)).astype(np.uint64) for k in (1, 2))


def word_batches(places: int):
    """Of the distinct words of the rows, how many positive and unlabelled rows have each: compressed, by the place of their range."""

    def flush(parts):
        known, p, u = merged_counts(parts)
        cuts = place_cuts(known, places, WORD_BITS)
        rows = [(at, packed(np.diff(known[a:b], prepend=U64(0))), packed(p[a:b]), packed(u[a:b])) for at, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["place", "words", "p", "u"])

    def run(batches):
        parts = []
        for batch in batches:
            positive = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
            for lo, hi, offsets, raw in kernels.chunks(batch.column(1)):
                rows, values, _ = features(offsets, raw)
                order = np.argsort(rows, kind="stable")
                bounds, values = kernels.row_sets(rows[order], values[order] >> U64(64 - WORD_BITS), hi - lo)
                flag = np.repeat(positive[lo:hi], np.diff(bounds))
                parts.append(merged_counts([(values, flag, ~flag)]))
                if len(parts) > 8:
                    parts = [merged_counts(parts)]
                if sum(len(w) for w, _, _ in parts) > FLUSH_WORDS:
                    yield flush(parts)
                    parts = []
            kernels.release()
        if sum(len(w) for w, _, _ in parts):
            yield flush(parts)

    return run


def contrast(p, u, n_p: int, n_u: int):
    """How many standard deviations more often the unlabelled have a word."""
    share = (p + u + 1) / (n_p + n_u + 2)
    return (u / n_u - p / n_p) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))


def contrasting(n_p: int, n_u: int):
    """The words of a place whose contrast is MIN_Z at least."""

    def run(group: pa.Table) -> pa.Table:
        words = [np.cumsum(unpacked(x), dtype=np.uint64) for x in group.column("words").to_pylist()]
        known, at = np.unique(np.concatenate(words), return_inverse=True)
        p, u = (np.bincount(at, np.concatenate([unpacked(x) for x in group.column(c).to_pylist()]).astype(np.float64), len(known)) for c in ("p", "u"))
        z = np.round(contrast(p, u, n_p, n_u), 9)
        best = np.flatnonzero(z >= MIN_Z)
        return pa.table({"word": pa.array(known[best].astype(np.int64)), "z": pa.array(z[best])})

    return run


def indicators(rows: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """Of the words of rows(positive, t), those that the unlabelled have far more often."""
    places = 2 * partitions(rows.sparkSession)
    counts = rows.select("positive", "t").mapInArrow(word_batches(places), "place int, words binary, p binary, u binary")
    found = counts.groupBy("place").applyInArrow(contrasting(n_p, n_u), "word long, z double")
    best = found.orderBy(F.desc("z"), "word").limit(VOCABULARY).select("word").toArrow()
    return np.sort(best.column("word").to_numpy().astype(np.uint64))


def shape_batches(batches):
    for batch in batches:
        for _, _, offsets, raw in kernels.chunks(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in features(offsets, raw)[2]], pa.binary())], names=["shape"])


def active(model: dict, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the features a row has, in the order of rows: indicators, bins of its shape, whether it has any indicator, and 1."""
    words, cuts = model["words"], model["cuts"]
    rows, values, shape = features(offsets, raw)
    row, at = found_words(words, rows, values >> U64(64 - WORD_BITS))
    n, told = len(offsets) - 1, np.unique(row)
    bins = np.column_stack([len(words) + j * BINS + np.searchsorted(cuts[j], shape[:, j], "right") for j in range(shape.shape[1])])
    any_ = len(words) + shape.shape[1] * BINS
    row = np.concatenate([row, np.repeat(np.arange(n), shape.shape[1]), told, np.arange(n)])
    at = np.concatenate([at, bins.ravel(), np.full(len(told), any_), np.full(n, any_ + 1)])
    order = np.lexsort((at, row))
    return row[order], at[order]


def width(model: dict) -> int:
    return len(model["words"]) + len(model["cuts"]) * BINS + 2


def feature_batches(model: dict):
    """(positive, h, features) of rows (positive, h, t)."""

    def run(batches):
        for batch in batches:
            for lo, hi, offsets, raw in kernels.chunks(batch.column(2)):
                row, at = active(model, offsets, raw)
                cut = np.searchsorted(row, np.arange(hi - lo + 1)) * 2
                packed_ = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(at.astype(np.uint16).tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), packed_], names=["positive", "h", "features"])
            kernels.release()

    return run


def sparse_rows(column) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, features) of rows of features; every row has some."""
    offsets, raw = kernels.string_parts(column)
    return offsets // 2, np.ascontiguousarray(raw).view(np.uint16).astype(np.int64)


def dense(column, size: int) -> np.ndarray:
    bounds, at = sparse_rows(column)
    out = np.zeros((len(bounds) - 1, size), np.float32)
    out[np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), at] = 1
    return out


def risk_batches(w: np.ndarray):
    """Sums over the rows of a task, for positives and unlabelled: rows, loss of label -1 and its square, gradients of both labels."""

    def run(batches):
        sums = {flag: np.zeros(3 + 2 * len(w)) for flag in (True, False)}
        for batch in batches:
            flags = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
            bounds, at = sparse_rows(batch.column(1))
            z = np.add.reduceat(w[at], bounds[:-1])
            p, each = sigmoid(z), np.diff(bounds)
            for flag, out in sums.items():
                mine, spread = flags == flag, np.repeat(flags == flag, each)
                loss = np.logaddexp(0, z[mine])
                out[:3] += [mine.sum(), loss.sum(), (loss * loss).sum()]
                for k, slope in enumerate((p - 1, p)):
                    out[3 + k * len(w) : 3 + (k + 1) * len(w)] += np.bincount(at[spread], np.repeat(slope, each)[spread], len(w))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["positive", "sums"])

    return run


def excess(u, p, prior: float) -> tuple[float, float]:
    """The risk of label -1 that is left for the unlabelled negatives, and its standard error, from (rows, sum, sum of squares) of losses."""
    (mean_u, var_u), (mean_p, var_p) = ((s / n, max(0.0, q / n - (s / n) ** 2) / n) for n, s, q in (u, p))
    return mean_u - prior * mean_p, (var_u + prior * prior * var_p) ** 0.5


def risk_gradient(rows: DataFrame, prior: float):
    """Of weights the gradient of the non-negative risk over all rows(positive, features)."""

    def gradient(w):
        got = rows.select("positive", "features").mapInArrow(risk_batches(w), "positive boolean, sums binary").collect()
        p, u = (sum(map(np.frombuffer, sorted(bytes(r.sums) for r in got if r.positive == flag))) for flag in (True, False))
        plus, minus = slice(3, 3 + len(w)), slice(3 + len(w), None)
        g_minus = u[minus] / u[0] - prior * p[minus] / p[0]
        r_minus, error = excess(u[:3], p[:3], prior)
        return (prior * p[plus] / p[0] + g_minus if r_minus >= -error else -g_minus) + penalty(w)

    return gradient


def share_batches(halves: list[np.ndarray]):
    """Histograms of the scores that the model of the other half gives."""

    def run(batches):
        out = np.zeros((2, 2, SCORE_BINS), np.int64)
        for batch in batches:
            flags = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
            half = batch.column(1).to_numpy() & 1
            bounds, at = sparse_rows(batch.column(2))
            for h in (0, 1):
                bin_ = score_bin(np.add.reduceat(halves[1 - h][at], bounds[:-1]))
                for flag in (True, False):
                    out[h, int(flag)] += np.bincount(bin_[(half == h) & (flags == flag)], minlength=SCORE_BINS)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["counts"])

    return run


def score_bin(z: np.ndarray) -> np.ndarray:
    return np.clip((z + SCORE_RANGE) * (SCORE_BINS / (2 * SCORE_RANGE)), 0, SCORE_BINS - 1).astype(np.int64)


def prior_of(counts: np.ndarray) -> float:
    """The share of positives among the unlabelled, from histograms [half, positive, bin] of scores."""
    found = []
    for u, p in counts:
        if not p.sum() or not u.sum():
            continue
        above_p, above_u = p[::-1].cumsum() / p.sum(), u[::-1].cumsum() / u.sum()
        slack = np.sqrt(np.log(4 / CONFIDENCE) / 2)
        some = np.flatnonzero(above_p)
        at = some[np.argmin((above_u[some] + slack / np.sqrt(u.sum()) + slack / np.sqrt(p.sum())) / above_p[some])]
        found.append(above_u[at] / above_p[at])
    return float(np.clip(np.mean(found), 0.05, 1.0)) if found else 1.0


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(gradient, w: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Adam on a full-batch gradient."""
    w, m, v = w.copy(), np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def penalty(w: np.ndarray) -> np.ndarray:
    g = DECAY * w
    g[-1] = 0
    return g


def nn_pu(xp: np.ndarray, xu: np.ndarray, prior: float) -> np.ndarray:
    """Weights (the bias last) that minimise the non-negative unbiased risk on dense rows."""

    def gradient(w):
        w32 = w.astype(np.float32)
        zp, zu = xp @ w32, xu @ w32
        sp, su = sigmoid(zp), sigmoid(zu)
        g_minus = xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp)
        lu, lp = np.logaddexp(0, zu).astype(np.float64), np.logaddexp(0, zp).astype(np.float64)
        r_minus, error = excess((len(lu), lu.sum(), lu @ lu), (len(lp), lp.sum(), lp @ lp), prior)
        return (prior * (xp.T @ (sp - 1)) / len(xp) + g_minus if r_minus >= -error else -g_minus) + penalty(w)

    return descend(gradient, np.zeros(xp.shape[1]))


def against(tp: np.ndarray, tu: np.ndarray) -> np.ndarray:
    """Weights of positives against unlabelled, both classes of equal weight."""
    slope = lambda x, w, y: x.T @ (sigmoid(x @ w.astype(np.float32)) - y) / max(1, len(x))
    return descend(lambda w: slope(tp, w, 1) + slope(tu, w, 0) + penalty(w), np.zeros(tp.shape[1]), STEPS // 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict | None:
    marks = labels.select(F.col("doc_id").cast("string").alias("i"), "quality", "toxic").where("i IS NOT NULL")
    marks = limited(stored(marks.groupBy("i").agg(F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("clean"))))
    rows = docs.where(has_text(text_col)).select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).join(marks, "i", "left")
    rows = rows.where("clean OR clean IS NULL").select(F.coalesce("clean", F.lit(False)).alias("positive"), F.xxhash64(F.lit(5), "i", "t").alias("h"), "t")
    n = {r["positive"]: r["count"] for r in rows.groupBy("positive").count().collect()}
    if n.get(True, 0) < MIN_POSITIVES or not n.get(False):
        return None
    model = {"words": indicators(rows, n[True], n[False])}
    bound = {flag: rows.where(F.col("positive") == flag).select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0] for flag in n}
    shapes = rows.where((F.col("positive")) & (F.col("h") <= bound[True])).select("t").mapInArrow(shape_batches, "shape binary").toArrow()
    model["cuts"] = np.quantile(np.array([np.frombuffer(x) for x in sorted(shapes.column("shape").to_pylist())]), QUANTILES, axis=0).T
    told = stored(rows.mapInArrow(feature_batches(model), "positive boolean, h long, features binary"), "quality")
    some = told.where(F.col("h") <= F.when(F.col("positive"), bound[True]).otherwise(bound[False])).toArrow().sort_by([("h", "ascending"), ("positive", "ascending")])
    x, positive, half = dense(some.column("features"), width(model)), some.column("positive").to_numpy().astype(bool), some.column("h").to_numpy() & 1
    halves = [against(x[positive & (half == h)], x[~positive & (half == h)]) for h in (0, 1)]
    counts = sum(np.frombuffer(r.counts, np.int64).reshape(2, 2, SCORE_BINS) for r in told.mapInArrow(share_batches(halves), "counts binary").collect())
    model["prior"] = prior_of(counts)
    model["w"], slope = nn_pu(x[positive], x[~positive], model["prior"]), risk_gradient(told, model["prior"])
    for _ in range(ALL_STEPS):
        model["w"] = model["w"] - RATE * slope(model["w"])
    return model


def scores(model: dict, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    row, at = active(model, offsets, raw)
    return np.bincount(row, model["w"][at], len(offsets) - 1)


def row_scores(model: dict, column) -> np.ndarray:
    """The score of every row, NaN for one that says nothing."""
    out = np.full(len(column), np.nan)
    for lo, hi, offsets, raw in kernels.chunks(column):
        out[lo:hi] = np.round(scores(model, offsets, raw), 9)
    return out


def scorer(model: dict):
    def run(batches):
        for batch in batches:
            score = row_scores(model, batch.column(1))
            keep = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool) & (score >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"]).filter(pa.array(keep))

    return run


def keeper(model: dict, text_at: int):
    """Passes on the rows that the model keeps; the last column says which have a text."""

    def run(batches):
        for batch in batches:
            some = np.asarray(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), bool)
            keep = some & (row_scores(model, batch.column(text_at)) >= 0)
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep))

    return run


def has_text(text_col: str):
    return F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"\S"), F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of the documents that the classifier keeps; scores are positive for clean ones."""
    model = fit(docs, labels, id_col, text_col, sample)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), has_text(text_col).alias("some"))
    if model is None:
        return rows.where("some").select("doc_id", F.lit(None).cast("double").alias("score"))
    return rows.mapInArrow(scorer(model), f"doc_id {kind_of(docs, id_col)}, score double")


def quality_stage(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """docs without the rejected rows, in one pass that adds no column under a name that docs could have."""
    model = fit(docs, labels, id_col, text_col, sample)
    if model is None:
        return docs.where(has_text(text_col))
    marked = docs.select(*columns(docs), has_text(text_col).alias("__some__" + "_".join(docs.columns)))
    return marked.mapInArrow(keeper(model, docs.columns.index(text_col)), docs.schema)
