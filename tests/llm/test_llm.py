"""The corpus operators against brute force, and their edge cases."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shardloom.llm import canonical, chat, exact, jaccard, kernels, lm, mixing, packing, puquality, sstable, substring
from shardloom.llm.common import components, row_key, table
from shardloom.llm.queries import oracle_sql, queries
from tests.oracle import same

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """rows: (doc_id, text); with extra columns whose names the operators use inside."""
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA)
    return df.withColumn("k", F.lit(1)).withColumn("sid", F.lit("x")).withColumn("n", F.lit(2)).withColumn("lane", F.lit(0)).withColumn("digest", F.lit("z"))


EDGE = [(1, None), (2, ""), (3, "  \n"), (None, "alpha beta gamma"), (4, "alpha beta gamma"), (4, "alpha beta gamma"), (5, "alpha beta gamma delta"), (6, "w " * 30_000), (6, "other text here"), (7, "")]


@pytest.fixture(scope="module")
def texts(spark):
    return {r[0]: r[1] for r in table(spark, DATA, "documents").select("doc_id", "text").collect()}


def words(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    same(queries()[name](spark, DATA), oracle_sql()[name], DATA)


def test_empty_tables_give_empty_results(spark):
    none, labels = docs_of(spark, [(1, "x")]).where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (puquality.quality(none, labels), puquality.quality_stage(none, labels), sstable.shards(none), canonical.fingerprints(none), packing.pack(none), mixing.mix(none), mixing.mix_stage(none), jaccard.links(none), jaccard.near_stage(none), exact.exact_duplicates(none), exact.exact_stage(none), substring.passages(none), lm.score(none)):
        assert df.count() == 0
    assert chat.canonical_turns(spark.createDataFrame([], "conv_id long, record string")).count() == 0


# 1


def test_quality_learns_from_positives_and_unlabelled(spark):
    rng = np.random.default_rng(5)
    good, bad = [f"word{i}" for i in range(300)], ["trashy", "filthy", "rotten"]
    rows, labels = [], []
    for i in range(900):
        text = list(rng.choice(good, 60))
        spoiled = i >= 300 and i % 4 == 0
        if spoiled:
            text[10:13] = bad
        rows.append((i, " ".join(text)))
        if i < 300:
            labels.append((i, 1, 0))
    kept = {r.doc_id for r in puquality.quality(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    wrong = {i for i in range(300, 900) if i % 4 == 0}
    assert len(wrong & kept) <= 3 and len(set(range(900)) - wrong - kept) <= 12


def test_quality_edges(spark):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    kept = puquality.quality(docs_of(spark, EDGE), labels).collect()
    assert Counter(r.doc_id for r in kept) == Counter({None: 1, 4: 2, 5: 1, 6: 2}) and all(r.score is None for r in kept)
    df = docs_of(spark, EDGE)
    assert puquality.quality_stage(df, labels).columns == df.columns


# 2


def test_sstable_lookup_and_order(spark):
    rows = [(i * 7 % 1000, f"text {i} é") for i in range(1000)] + EDGE
    found = defaultdict(list)
    for r in sstable.shards(docs_of(spark, rows), shard_bytes=20_000, block_bytes=1000).collect():
        found[r.shard].append(r)
    readers, every = {}, []
    for shard, parts in sorted(found.items()):
        readers[shard] = sstable.Reader(b"".join(bytes(p.bytes) for p in sorted(parts, key=lambda p: p.seq)))
        every += [k for k, _ in readers[shard].scan()]
    assert len(readers) > 1 and every == sorted(every) and len(every) == len(rows)
    expected = defaultdict(list)
    for i, t in rows:
        expected[i].append(t)
    for i, t in expected.items():
        assert sorted((v["text"] for r in readers.values() for v in r.get(i)), key=str) == sorted(t, key=str)
    assert not any(r.get(5000) for r in readers.values())
    assert sum(r.may_contain(sstable.key_of(i)) for i in range(10_000, 11_000) for r in readers.values()) < 50 * len(readers)


def test_sstable_files_and_lookup_over_all_of_them(spark, tmp_path):
    rows = [(i * 7 % 1000, f"text {i} é") for i in range(1000)] + EDGE
    listed = sstable.write_files(docs_of(spark, rows).repartition(4), str(tmp_path / "sst"), shard_bytes=20_000, block_bytes=1000).collect()
    assert len(listed) > 1 and sum(r.entries for r in listed) == len(rows) and all((tmp_path / "sst" / r.path.rsplit("/", 1)[1]).stat().st_size == r.size for r in listed)
    found = sstable.Shards(spark, str(tmp_path / "sst"))
    for i in (0, 3, 4, 6, 500, 999, None):
        assert sorted((v["text"] for v in found.get(i)), key=str) == sorted((t for j, t in rows if j == i), key=str)
    assert found.get(5000) == [] and not list(tmp_path.glob("**/*.part"))
    with pytest.raises(ValueError):
        sstable.Reader(b"short")


def test_common_prefix_of_keys():
    rng = np.random.default_rng(9)
    for _ in range(300):
        a, b = (bytes(rng.integers(0, 2, rng.integers(0, 12)).tolist()) for _ in range(2))
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert sstable.common_prefix(a, b) == n


# 3


def test_fingerprints_are_groups_of_equal_canonical_texts(spark, texts):
    rows = [*texts.items(), (9001, "ﬁne  Straße\n"), (9002, "FINE strasse"), *EDGE]
    forms = defaultdict(list)
    for i, t in rows:
        if t is not None:
            forms[canonical.canonical(t)].append(i)
    got = canonical.fingerprints(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    expected = Counter()
    for form, ids in forms.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            expected[(i, xxhash.xxh3_128_hexdigest(form.encode()), len(form.encode()), min(known) if known else None, len(ids))] += 1
    expected[(1, None, None, 1, 1)] += 1
    assert Counter(map(tuple, got)) == expected


def test_equal_digests_of_different_forms_are_told_apart(spark):
    rows = [(1, "A b"), (2, "a  B"), (3, "a c"), (None, "A C"), (4, "longer text")]
    got = {(r.doc_id, r.group_id, r.copies) for r in canonical.fingerprints(docs_of(spark, rows), digest_of=lambda form: str(len(form))).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (3, 3, 2), (None, 3, 2), (4, 4, 1)}


# 4


def test_chat_layouts_and_edges(spark):
    rows = [
        (1, '{"messages":[{"role":"human","content":"a"},{"role":"GPT","content":"b"}]}'), (2, '{"instruction":"a","input":"","output":"b"}'), (3, '{"utterances":["a","b","c"]}'), (4, None), (5, "broken"),
        (6, '{"unknown":1}'), (7, '{"messages":[]}'), (8, '{"prompt":"a","response":null,"meta":{"x":[1]}}'), (8, '{"prompt":"a","response":null,"meta":{"x":[1]}}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, record string").withColumn("turn", F.lit(9)).withColumn("role", F.lit("r"))
    got = sorted(map(tuple, chat.canonical_turns(df).collect()))
    assert got == [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (8, 0, "user", "a"), (8, 0, "user", "a")]
    assert {r.conv_id for r in chat.unmapped(df).collect()} == {4, 5, 6, 7}


def test_chat_mappings_need_only_their_required_fields(spark):
    rows = [
        (1, '{"instruction":"i","input":"x","output":"o","text":"all of it"}'), (2, '{"system":"s","conversations":[{"from":"human","value":"q"}]}'), (3, '{"prompt":"p","messages":[{"role":"user","content":"p"},{"role":"assistant","content":"r"}]}'),
        (4, '{"messages":[{"role":"user","content":[{"type":"text","text":"one "},{"type":"image","url":"u"},{"type":"text","text":"two"}]},{"role":"assistant","content":"[not a list]"},{"role":"user","content":["a","b"]}]}'),
        (5, "[" * 200_000 + "]" * 200_000), (6, '{"a":' * 200_000), (None, '{"text":"' + "long " * 50_000 + '"}'), (7, ""), (8, '"text"'), (9, '{"text":{"x":1}}'), (10, '{"messages":[{"role":"tool","content":""},{"role":"odd","content":" "}],"other":[{"deep":[1,{"x":null}]}]}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, record string").withColumn("layout", F.lit(1)).withColumn("fingerprint", F.lit(2)).withColumn("__print", F.lit(3))
    got = sorted(((r.conv_id or 0, r.turn, r.role, r.text) for r in chat.canonical_turns(df).collect()))
    assert got == [
        (0, 0, "user", "long " * 50_000), (1, 0, "user", "i"), (1, 1, "user", "x"), (1, 2, "assistant", "o"), (2, 0, "system", "s"), (2, 1, "user", "q"), (3, 0, "user", "p"), (3, 1, "assistant", "r"),
        (4, 0, "user", "one two"), (4, 1, "assistant", "[not a list]"), (4, 2, "user", "ab"), (9, 0, "user", '{"x":1}'), (10, 0, "user", " "),
    ]
    assert {r.conv_id for r in chat.unmapped(df).collect()} == {5, 6, 7, 8}


def test_chat_query_writes_every_layout(spark):
    import json

    fields = Counter(k for r in chat.as_records(table(spark, "/root/testdata/sf0.01", "conversations")).collect() if not r.record.startswith('{"broken') for k in json.loads(r.record))
    assert set(fields) >= {"messages", "conversations", "dialogue", "turns", "instruction", "response", "completion", "question", "utterances", "text", "unknown"}


# 5


def brute_pack(lengths, capacity):
    level, windows, out = Counter(), 0, []
    for n in lengths:
        while n >= capacity:
            windows, n = windows + 1, n - capacity
        if n:
            best = None
            for at in range(capacity - n, -1, -1):
                if at and not level[at]:
                    continue
                after = level.copy()
                if at:
                    after[at] -= 1
                if at + n < capacity:
                    after[at + n] += 1
                cost = sum(v * v for v in after.values()) - sum(v * v for v in level.values())
                if best is None or cost < best[0]:
                    best = (cost, at, after)
            level = best[2]
            windows += best[1] == 0
            out.append(best[1])
    return out, windows


def test_packing_places_like_brute_force():
    lengths = np.random.default_rng(3).integers(0, 45, 400)
    item, window, start, length = packing.place_all(lengths, 32)
    expected, windows = brute_pack(lengths.tolist(), 32)
    assert [s for s, n in zip(start, length) if n < 32] == expected and window.max() + 1 == windows
    filled = defaultdict(list)
    for w, s, n in zip(window, start, length):
        filled[w].append((s, n))
    for parts in filled.values():
        parts.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(n for _, n in parts) <= 32


def test_packing_keeps_all_tokens_and_orders_lanes(spark):
    rows = [*EDGE, *((100 + i, " ".join(f"é{i}t{j}" for j in range(i * 7 % 90))) for i in range(60)), *((None, f"null {i}") for i in range(40))]
    got = packing.pack(docs_of(spark, rows), capacity=100, lanes=3).collect()
    tokens, texts, windows = Counter(), defaultdict(list), defaultdict(list)
    for r in sorted(got, key=lambda r: r.piece):
        tokens[r.doc_id] += r.length
        assert r.length == len((r.text or "").split()) and (r.window is None) == (r.text is None)
        windows[r.lane, r.window].append((r.start, r.length))
        texts[r.doc_id].append(r.text)
    want = Counter()
    for i, t in rows:
        want[i] += len((t or "").split())
    assert tokens == want and len({r.lane for r in got if r.doc_id is None}) == 3
    assert all(" ".join(x for x in texts[i] if x) == " ".join(t.split()) for i, t in rows if i is not None and i >= 100)
    for (_, window), parts in windows.items():
        parts.sort()
        assert window is None or (parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])))
    # each lane is the packing of its documents in the order of their identifiers
    for lane in range(3):
        mine = [r for r in got if r.lane == lane and r.doc_id is not None and r.doc_id >= 100 and r.length]
        first = [r for r in got if r.lane == lane and r.window is not None]
        lengths = {}
        for r in first:
            lengths.setdefault((r.doc_id is not None, r.doc_id or 0, r.text if r.doc_id is None or r.doc_id < 100 else ""), []).append(r)
        assert mine and {r.window for r in first} == set(range(max(r.window for r in first) + 1))


def placed_as_brute_force(spark, docs, packed):
    by = defaultdict(list)
    for r in docs.select("doc_id", "text", F.pmod(row_key()["a"], F.lit(packing.LANES)).alias("lane")).collect():
        by[r.lane].append((r.doc_id, len((r.text or "").split())))
    got = defaultdict(list)
    for r in packed:
        if 0 < r.length < packing.WINDOW_TOKENS:
            got[r.lane].append((r.doc_id, r.start))
    for at, items in by.items():
        items.sort()
        starts, _ = brute_pack([n for _, n in items], packing.WINDOW_TOKENS)
        ids = [i for i, n in items if n % packing.WINDOW_TOKENS]
        assert sorted(zip(ids, starts)) == sorted(got[at])


def test_packing_query_is_the_brute_force_packing_of_each_lane(spark):
    placed_as_brute_force(spark, table(spark, DATA, "documents"), queries()["op5_packing"](spark, DATA).collect())


# 6


def test_mixing_totals_and_edges(spark):
    rows = [(i, f"t{i}", "en", "big" if i < 900 else "small" if i < 1000 else None, 1) for i in range(1010)] + [(None, None, None, "small", None)] * 2
    df = spark.createDataFrame(rows, SCHEMA).withColumn("__x", F.lit(1))
    got = mixing.mix(df).groupBy("source").agg(F.sum("copies").alias("c")).collect()
    totals = {r.source: r.c for r in got}
    assert sum(totals.values()) == 1012 and totals["small"] > 200 and totals[None] > 60
    assert mixing.mix_stage(df).columns == df.columns
    only = mixing.with_copies(df, weights={"big": 1.0}).groupBy("row.source").agg(F.sum("copies").alias("c")).collect()
    assert {r.source: r.c for r in only if r.c} == {"big": 1012}


def test_the_budget_is_hit_exactly_under_ties(spark):
    rows = [(None, f"t{i % 400}", "en", "a", 1) for i in range(1000)] + [(7, f"same id {i}", "en", "b", 1) for i in range(500)] + [(8, "alike", "en", "b", 2)] * 700 + [(100 + i, "x", "en", "c", 3) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    for budget in (0.2, 0.5, 1.0):
        assert mixing.mix(df, budget=budget).agg(F.sum("copies")).first()[0] == round(budget * 3000) == mixing.mix_stage(df, budget=budget).count()


# 7


def test_near_stage_keeps_one_of_a_group(spark):
    df = docs_of(spark, EDGE)
    kept = jaccard.near_stage(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 2: 1, 3: 1, 7: 1, 4: 1, 5: 1, 6: 2})  # of repeated rows one stays


def test_sketches_never_exclude_a_pair():
    rng = np.random.default_rng(4)
    for size in (1, 5, 70, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, max(1, size // 20)).astype(np.uint64)])
        x, y = (np.frombuffer(s, np.uint64)[None] for s in jaccard.sketches(np.array([0, len(a), len(a) + len(b)]), np.r_[a, b]))
        width = min(x.shape[1], y.shape[1])
        assert np.bitwise_count(jaccard.folded(x, width) ^ jaccard.folded(y, width)).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


# 8


def test_exact_duplicates_through_many_memtables(spark, texts):
    rows = [*texts.items(), *((3000 + i, texts[i]) for i in range(50)), *EDGE]
    groups = defaultdict(set)
    for i, t in rows:
        if t is not None:
            groups[t].add(i)
    expected = {(i, min(x for x in g if x is not None)) for g in groups.values() if len(g) > 1 for i in g} - {(i, i) for i, _ in rows}
    got = [tuple(r) for r in exact.exact_duplicates(docs_of(spark, rows), memtable_entries=7).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    kept = [r.text for r in exact.exact_stage(docs_of(spark, rows), memtable_entries=7).select("text").collect()]
    assert Counter(kept) == Counter([*groups, None])


def test_compaction_gives_all_entries_of_repeated_digests():
    rng = np.random.default_rng(3)
    for count in (1, 2, 9, 70, 300):
        runs = []
        for _ in range(count):
            run = np.zeros(40, exact.ENTRY)
            run["hi"], run["lo"] = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
            run["a"] = rng.integers(0, 1 << 40, 40)
            runs.append(exact.merged([run]))
        every = np.concatenate(runs)
        times = Counter(zip(every["hi"].tolist(), every["lo"].tolist()))
        got = exact.compact(runs, [exact.build_filter(r["hi"], r["lo"]) for r in runs])
        assert sorted(got.tolist()) == sorted(e for e in every.tolist() if times[e[:2]] > 1)


def test_equal_digests_are_verified_by_bytes(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (None, "b"), (5, "longer"), (6, "longer")]
    clash = lambda text: [F.length(text).cast("long"), F.lit(0).cast("long")]
    assert sorted(map(tuple, exact.exact_duplicates(docs_of(spark, rows), digest=clash).collect()), key=repr) == [(3, 1), (6, 5), (None, 2)]
    assert sorted(r.text for r in exact.exact_stage(docs_of(spark, rows), digest=clash).collect()) == ["a", "b", "c", "longer"]


# pipeline


def test_tokens_and_prefixes():
    raw = np.frombuffer("réeuxmo ab\nréeuxpa".lower().encode(), np.uint8)
    bounds, hashes, rows, begins = kernels.tokens_and_prefixes(np.array([0, len(raw)]), raw, (3, 6))
    assert bounds.tolist() == [0, 3] and len(set(hashes.tolist())) == 3
    assert rows.tolist() == [0] * 4 and len(set(begins.tolist())) == 2


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_jaccard_pairs import brute_links

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    columns = table(spark, DATA, "documents").columns
    docs, seen = table(spark, DATA, "documents"), {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(at)))
        docs = spark.read.parquet(str(tmp_path / str(at)))
        seen[at] = docs.collect()
        assert at == 4 or docs.columns == columns
    first = {r.text: r.doc_id for r in sorted(seen[0], key=lambda r: -r.doc_id)}
    assert sorted(r.doc_id for r in seen[1]) == sorted(first.values())
    parent = {r.doc_id: r.doc_id for r in seen[1]}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute_links([(r.doc_id, r.text) for r in seen[1]])[1]:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert sorted(r.doc_id for r in seen[2]) == sorted({root(i) for i in parent})
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/2/*.parquet'")
    assert Counter(r.doc_id for r in seen[3]) == Counter({i: n for i, _, n in con.sql(mixing.ORACLE_SQL).fetchall()})
    tokens = Counter()
    for r in seen[4]:
        tokens[r.doc_id] += r.length
    expected = Counter()
    for r in seen[3]:
        expected[r.doc_id] += len(r.text.split())
    assert tokens == expected
    placed_as_brute_force(spark, spark.read.parquet(str(tmp_path / "3")), seen[4])
    same_rows = lambda rows: Counter((r.doc_id, r.piece, r.lane, r.window, r.start, r.length, r.text) for r in rows)
    assert same_rows(corpus_pipeline.run(spark, DATA).collect()) == same_rows(seen[4])
