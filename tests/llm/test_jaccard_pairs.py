"""Links and classes against brute force over documents, not sets."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import jaccard
from shardloom.llm.common import table
from shardloom.llm.queries import queries
from tests.llm.test_llm import DATA, EDGE, docs_of, words


def grams(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else None)


def brute_links(rows, threshold=0.8, n=1):
    """Counter of (doc_id, class_id, links) and the pairs."""
    sets, parent, links, found = [grams(t, n) for _, t in rows], list(range(len(rows))), Counter(), []

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        p, q = sets[a], sets[b]
        if p and q and min(len(p), len(q)) >= threshold * max(len(p), len(q)) - 1e-9 and (both := len(p & q)) >= threshold * len(p | q) - 1e-9 and both:
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
            found.append((rows[a][0], rows[b][0]))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return Counter((doc, least.get(root(i)), links[i]) for i, (doc, _) in enumerate(rows)), found


def edited(texts):
    rng = np.random.default_rng(2)
    rows = list(texts.items())
    for i in range(60):
        rows.append((5000 + i, " ".join(w for w in words(texts[i]) if rng.random() > 0.08)))
    rows += [(6000 + i, " ".join(f"x{j}" for j in rng.choice(12, 9, replace=False))) for i in range(80)]
    base = [f"w{i}" for i in range(40)]
    rows += [(7000 + i, " ".join([*base[:at], f"new{i}", *base[at + 1 :]])) for i, at in enumerate(rng.integers(0, 40, 60))]
    return [*rows, *EDGE]


@pytest.fixture(scope="module")
def texts(spark):
    return {r[0]: r[1] for r in table(spark, DATA, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("n", [1, 3])
def test_links_equal_brute_force(spark, texts, n):
    rows = edited(texts)
    expected, found = brute_links(rows, n=n)
    assert len(found) > 200
    assert Counter(map(tuple, jaccard.links(docs_of(spark, rows), n=n).collect())) == expected


def test_large_cells_and_blocks_give_the_same(spark, texts, monkeypatch):
    rows = edited(texts)
    monkeypatch.setattr(jaccard, "LARGE_CELL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    assert Counter(map(tuple, jaccard.links(docs_of(spark, rows)).collect())) == brute_links(rows)[0]


def test_any_cells_give_the_same(spark, texts, monkeypatch):
    rows = edited(texts)
    monkeypatch.setattr(jaccard, "cells_of", lambda nodes: nodes.select("sid", F.pmod("sid", F.lit(50)).cast("int").alias("cell")))
    assert Counter(map(tuple, jaccard.links(docs_of(spark, rows)).collect())) == brute_links(rows)[0]
    monkeypatch.setattr(jaccard, "cells_of", lambda nodes: nodes.select("sid", F.shiftright("sid", 32).cast("int").alias("cell")))
    assert Counter(map(tuple, jaccard.links(docs_of(spark, rows)).collect())) == brute_links(rows)[0]


def test_string_identifiers(spark):
    rows = [("b", "one two three four five"), ("a", "one two three four five"), ("c", "other words"), (None, "other words")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(map(tuple, jaccard.links(df).collect()), key=repr) == [("a", "a", 1), ("b", "a", 1), ("c", "c", 1), (None, "c", 1)]
    assert sorted(r.doc_id for r in jaccard.near_stage(df).collect()) == ["a", "c"]


def test_the_query(spark):
    rows = [tuple(r) for r in table(spark, DATA, "documents").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries()["op7_jaccard"](spark, DATA).collect())) == brute_links(rows)[0]
