"""The classifier against plain Python: indicators, prior, risk, weights and decisions."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom.llm import kernels, puquality
from shardloom.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, SF, "labels").collect()}
    rows = [(labels.get(i) == (1, 0), t) for i, t in docs.items() if i not in labels or labels[i] == (1, 0)]
    return [r for r in rows if r[1] and r[1].strip()]


def words(text):
    """The distinct tokens and beginnings of tokens, by their bytes."""
    out = set()
    for w in re.findall(rb"(?:[a-z0-9]|[\x80-\xff])+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode())):
        out.add((w, 0))
        out.update((w[:n], n) for n in puquality.PREFIXES if len(w) > n)
    return out


def test_indicators_equal_a_count_in_python(spark, corpus, monkeypatch):
    monkeypatch.setattr(puquality, "MIN_Z", 3.0)
    n = Counter(flag for flag, _ in corpus)
    seen = {True: Counter(), False: Counter()}
    for flag, text in corpus:
        seen[flag].update(words(text))
    z = {}
    for w in seen[False] | seen[True]:
        p, u = seen[True][w], seen[False][w]
        share = (p + u + 1) / (n[True] + n[False] + 2)
        z[w] = (u / n[False] - p / n[True]) / math.sqrt(share * (1 - share) * (1 / n[True] + 1 / n[False]))
    expected = sum(1 for x in z.values() if round(x, 9) >= 3.0)
    got = puquality.indicators(spark.createDataFrame(corpus, "positive boolean, t string"), n[True], n[False])
    assert len(got) == min(expected, puquality.VOCABULARY) and len(set(got.tolist())) == len(got)
    best = max(z, key=z.get)
    raw = np.frombuffer(best[0] + (b"" if not best[1] else b"zzzz"), np.uint8)
    _, whole, _, begins = kernels.tokens_and_prefixes(np.array([0, len(raw)]), raw, puquality.PREFIXES)
    assert set(np.concatenate([whole, begins]) >> np.uint64(1)) & set(got)


def fitted(spark, corpus):
    rng = np.random.default_rng(6)
    model = {"words": np.sort(rng.integers(0, 1 << 63, 5).astype(np.uint64))}
    shapes = np.concatenate([puquality.features(*kernels.string_parts(pa.array([t])))[2] for flag, t in corpus if flag])
    model["cuts"] = np.quantile(shapes, puquality.QUANTILES, axis=0).T
    df = spark.createDataFrame(corpus, "positive boolean, t string").withColumn("h", F.xxhash64("t")).select("positive", "h", "t")
    return model, df.mapInArrow(puquality.feature_batches(model), "positive boolean, h long, features binary").repartition(3).cache()


def test_the_distributed_gradient_is_that_of_the_risk(spark, corpus):
    model, told = fitted(spark, corpus)
    rows = told.toArrow()
    x, positive = puquality.dense(rows.column("features"), puquality.width(model)).astype(float), np.array(rows.column("positive").to_pylist())
    rng = np.random.default_rng(1)

    def risk(w, prior):
        zp, zu = x[positive] @ w, x[~positive] @ w
        minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        decay = puquality.DECAY / 2 * (w[:-1] ** 2).sum()
        error = np.sqrt(np.logaddexp(0, zu).var() / len(zu) + prior**2 * np.logaddexp(0, zp).var() / len(zp))
        return prior * np.logaddexp(0, -zp).mean() + minus + decay if minus >= -error else -minus + decay

    for prior, scale in ((0.4, 0.3), (0.99, 3.0)):
        w = rng.normal(0, scale, x.shape[1])
        g = puquality.risk_gradient(told, prior)(w)
        for i in rng.integers(0, len(w), 12):
            step = np.zeros(len(w))
            step[i] = 1e-5
            assert abs((risk(w + step, prior) - risk(w - step, prior)) / 2e-5 - g[i]) < 1e-6


def test_weights_and_decisions_equal_a_plain_minimiser(spark, corpus):
    """The convex branch of the risk has one minimum: plain gradient descent must find the same decisions."""
    model, told = fitted(spark, corpus)
    rows = told.toArrow().sort_by("h")
    x, positive = puquality.dense(rows.column("features"), puquality.width(model)), np.array(rows.column("positive").to_pylist())
    prior = 0.5
    ours = puquality.nn_pu(x[positive], x[~positive], prior)
    w = np.zeros(x.shape[1])
    for _ in range(6000):
        slope = lambda rows, y: rows.T @ (1 / (1 + np.exp(-(rows @ w))) - y) / len(rows)  # noqa: E731, B023
        g = prior * slope(x[positive], 1) + slope(x[~positive], 0) - prior * slope(x[positive], 0)
        g[:-1] += puquality.DECAY * w[:-1]
        w -= 0.5 * g
    assert ((x @ ours >= 0) == (x @ w >= 0)).mean() > 0.97


def test_prior_is_the_least_ratio_of_shares():
    rng = np.random.default_rng(1)
    counts = np.zeros((2, 2, puquality.SCORE_BINS), np.int64)
    p, u = rng.normal(2, 1, 40_000), np.concatenate([rng.normal(2, 1, 24_000), rng.normal(-3, 1, 16_000)])
    for h in (0, 1):
        for flag, z in ((1, p[h::2]), (0, u[h::2])):
            counts[h, flag] = np.bincount(puquality.score_bin(z), minlength=puquality.SCORE_BINS)
    assert 0.55 < puquality.prior_of(counts) < 0.65


def test_the_query_keeps_clean_documents_and_rejects_poor_ones(spark):
    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    kept = {r.doc_id for r in puquality.quality(table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")).collect()}
    share = lambda want: np.mean([i in kept for i, x in labels.items() if x == want])
    print({x: (share(x), Counter(labels.values())[x]) for x in set(labels.values())})
    assert share((1, 0)) > 0.98 and share((0, 0)) < 0.12 and share((1, 1)) < 0.3
