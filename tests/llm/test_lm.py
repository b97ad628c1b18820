"""Language-model scores against brute force."""

import re
from collections import Counter, defaultdict
from math import ceil, log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import kernels, lm
from shardloom.llm.common import row_key, table
from shardloom.llm.queries import queries
from tests.llm.test_llm import DATA, EDGE, docs_of


def events(text):
    found = re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+|[^\s]", text or "", re.ASCII)
    w = ["<s>", "<s>", *found, "</s>"]
    return [tuple(w[at - 2 : at + 1]) for at in range(2, len(w))] if found else []


def counted(texts):
    count, context, docs = [Counter() for _ in range(4)], [Counter() for _ in range(4)], 0
    for t in texts:
        for e in events(t):
            for order in (1, 2, 3):
                count[order][e[3 - order :]] += 1
                context[order][e[3 - order : 2]] += 1
    return count, context


def parts_of(e, count, context, vocabulary, less):
    out = [1 / vocabulary]
    for order in (1, 2, 3):
        out.append(max(0, count[order][e[3 - order :]] - less) / max(1, context[order][e[3 - order : 2]] - less))
    return ceil(log2(max(0, context[3][e[:2]] - less) + 1)), np.array(out)


def rounded(parts):
    return np.array([parts[0], *(2.0 ** (np.rint(lm.OCTAVE * np.log2(p)) / lm.OCTAVE) if p else 0 for p in parts[1:])])


def brute_scores(rows, held):
    """[(tokens, mean log2 probability)] of the rows; held: which are held out."""
    count, context = counted(t for _, t in rows)
    vocabulary = len(count[1])
    deleted = not (any(events(t) for (_, t), h in zip(rows, held) if h) and any(events(t) for (_, t), h in zip(rows, held) if not h))
    c, x = (count, context) if deleted else counted(t for (_, t), h in zip(rows, held) if not h)
    told = Counter()
    for (_, t), h in zip(rows, held):
        if h or deleted:
            told.update(events(t))
    vectors = [(*parts_of(e, c, x, vocabulary, int(deleted)), n) for e, n in told.items()]
    weights = np.full((lm.BUCKETS, 4), 0.25)
    for _ in range(lm.ROUNDS):
        sums = np.zeros_like(weights)
        for b, p, n in vectors:
            share = weights[b] * rounded(p)
            sums[b] += n * share / share.sum()
        weights = np.where(sums.sum(1, keepdims=True) > 0, sums / np.maximum(sums.sum(1, keepdims=True), 1e-300), weights)
    weights = np.maximum(weights, 1e-9)
    weights /= weights.sum(1, keepdims=True)
    out = []
    for _, t in rows:
        logs = []
        for e in events(t):
            b, p = parts_of(e, count, context, vocabulary, 1)
            logs.append(log2(weights[b] @ p))
        out.append((len(logs), sum(logs) / len(logs) if logs else None))
    return out


def same_scores(spark, rows, chunk_bytes=None):
    df = docs_of(spark, rows)
    held = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", (F.pmod(row_key()["a"], F.lit(lm.HELD_OUT)) == 0).alias("h")).collect()}
    expected = brute_scores(rows, [held[r] for r in rows])
    got, want = defaultdict(list), defaultdict(list)
    for r in lm.score(df).collect():
        got[r.doc_id].append((r.tokens, r.mean_log2_probability))
    for (i, _), e in zip(rows, expected, strict=True):
        want[i].append(e)
    assert got.keys() == want.keys()
    for i in want:
        for a, b in zip(sorted(got[i], key=repr), sorted(want[i], key=repr), strict=True):
            assert a[0] == b[0] and (a[1] is b[1] or a[1] == pytest.approx(b[1], abs=1e-5)), i


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(lm, "SPARE_BITS", 30)
    texts = [tuple(r) for r in table(spark, DATA, "documents").select("doc_id", "text").orderBy("doc_id").limit(80).collect()]
    same_scores(spark, [*texts, *EDGE, (9000, "call 555 1234, now; é"), (9001, "call 555 9876, now: è\x1f!")])


def test_too_few_documents_to_hold_out(spark):
    same_scores(spark, [(1, "one two three one two"), (2, None), (3, " \t")])


def test_a_text_that_occurs_twice_scores_apart_and_digits_differ(spark):
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{x}" for x in rng.zipf(1.3, 60) % 500)
    rows = [(i, text()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(20)] + [(400 + i, f"number {111 if i < 3 else 900 + i} here") for i in range(6)]
    got = {r.doc_id: r.mean_log2_probability for r in lm.score(docs_of(spark, rows)).collect()}
    twice, once = [got[i] for i in range(20)], [got[i] for i in range(20, 300)]
    assert min(twice) > max(once) and got[400] > got[405]


def test_packing_of_numbers():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5, 5, 1 << 63], rng.integers(0, 1 << 40, 1000)):
        values = np.array(values, np.uint64)
        assert kernels.unpacked(kernels.packed(values)).tolist() == values.tolist()


def test_what_is_gathered_grows_with_the_corpus(spark):
    words = lambda n: docs_of(spark, [(i, " ".join(f"w{i}x{j}" for j in range(100))) for i in range(n)])
    sent = []
    for n in (10, 40):
        rows = words(n).select("doc_id", F.lit(False), "text").mapInArrow(lm.chunk_batches, f"{lm.CHUNK_COLUMNS}, ids array<long>")
        asked = rows.select("chunk", "held", "lengths", "texts").mapInArrow(lm.request_batches(40, 4), "place int, chunk long, held boolean, grams binary, times binary")
        sent.append(sum(len(kernels.unpacked(bytes(r.grams))) for r in asked.collect()))
    assert sent[1] > 3.8 * sent[0]


def test_no_documents(spark):
    assert lm.score(docs_of(spark, [(1, "x")]).where("false")).count() == 0
    got = sorted(map(tuple, lm.score(docs_of(spark, [(1, None), (2, ""), (2, "")])).collect()))
    assert got == [(1, 0, None), (2, 0, None), (2, 0, None)]
    assert queries()["op10_lm"](spark, DATA).count() == table(spark, DATA, "documents").count()
