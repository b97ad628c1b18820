"""Passages with their places against brute force."""

from collections import Counter, defaultdict

import numpy as np

from shardloom.llm import substring
from shardloom.llm.common import table
from shardloom.llm.queries import queries
from tests.llm.test_llm import DATA, EDGE, docs_of, words


def brute_passages(rows, size=substring.MIN_TOKENS):
    docs, places = sorted(set(rows), key=repr), defaultdict(set)
    for d, (_, t) in enumerate(docs):
        w = words(t)
        for at in range(len(w) - size + 1):
            places[" ".join(w[at : at + size])].add((d, at))
    sets = {frozenset(p) for p in places.values() if len(p) > 1}
    on = lambda p, by: frozenset((d, at + by) for d, at in p)
    out = Counter()
    for p in sets:
        if on(p, -1) not in sets:
            n = 0
            while on(p, n + 1) in sets:
                n += 1
            out[n + size, tuple(sorted(((docs[d][0], at) for d, at in p), key=repr))] += 1
    return out


def given(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r.passage, r.tokens, r.places].append((r.doc_id, r.start))
    assert all(len(p) == n for (_, _, n), p in found.items())
    return Counter((tokens, tuple(sorted(p, key=repr))) for (_, tokens, _), p in found.items())


def test_each_passage_names_the_places_that_hold_it(spark):
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"z{x}" for x in rng.integers(0, 10**6, n)]
    one, two = fresh(200), fresh(90)
    edited = [[*one[:at], "edit", *one[at + 1 :]] for at in (60, 100, 130)]
    rows = [(7000 + i, " ".join(w)) for i, w in enumerate([one + two, *edited, two, one[:80] + fresh(5) + two[20:], two[:60] + two[:60], ["a", "b", "c"] * 40])]
    rows += [(7100, " ".join(["same"] * 120)), *[r for r in EDGE if len(r[1] or "") < 1000]]
    got = given(substring.passages(docs_of(spark, rows)))
    assert got == brute_passages(rows)
    assert any({7000, 7001} == {i for i, _ in places} for _, places in got)


def test_hot_anchors_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"z{x}" for x in rng.integers(0, 10**6, n)]
    one = fresh(150)
    rows = [(i, " ".join(fresh(5) + one[: 60 + 3 * i] + fresh(4))) for i in range(20)] + [(100 + i, " ".join(one[40:120])) for i in range(3)] + [(200, " ".join(one + fresh(3) + one)), (201, " ".join(["same"] * 90))]
    rows += [rows[3], rows[3], (None, rows[4][1])]
    expected = brute_passages(rows)
    for hot in (1, 5, 10**9):
        monkeypatch.setattr(substring, "HOT_PLACES", hot)
        assert given(substring.passages(docs_of(spark, rows))) == expected


def test_the_query_names_all_places(spark):
    rows = [tuple(r) for r in table(spark, DATA, "documents").select("doc_id", "text").collect()]
    assert given(queries()["op9_substring"](spark, DATA)) == brute_passages(rows)


def test_no_documents(spark):
    assert substring.passages(docs_of(spark, EDGE).where("false")).count() == 0
