"""Every operator and stage on tables whose other columns have the names used inside, on string identifiers, and on edge rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from shardloom.llm import canonical, exact, jaccard, lm, mixing, packing, puquality, sstable, substring
from tests.llm.test_llm import EDGE

NAMES = "__row_k __gone_k __gone_id __rank __u __f __q __copies __copy __print k K row group sid size sketch keys cell node i t u v n w e of whole source_ digest form copies lane window start length place positive h features some key".split()
LONG = "long words " * 60_000


def clashing(spark, rows, kind="long"):
    df = spark.createDataFrame([(None if i is None else i if kind == "long" else f"id-{i}", t, f"s{(i or 0) % 2}") for i, t in rows], f"doc_id {kind}, text string, source string")
    taken = set()
    for name in NAMES:
        if name.lower() not in taken:
            taken.add(name.lower())
            df = df.withColumn(name, F.lit(f"mine {name}"))
    return df


ROWS = [*EDGE, (20, LONG), (21, LONG), (22, "ties one"), (22, "ties two"), (23, " ".join(f"w{j}" for j in range(80))), (24, "x " + " ".join(f"w{j}" for j in range(80)))]
LABELS = [(i, 1, 0) for i in (4, 5, 20)] + [(None, 1, 0), (23, 0, None), (4, None, None)]


def labels_of(spark, kind):
    return spark.createDataFrame([(None if i is None else i if kind == "long" else f"id-{i}", q, t) for i, q, t in LABELS], f"doc_id {kind}, quality int, toxic int")


def texts(rows):
    return Counter(t for _, t in rows)


STAGES = {
    "quality": (lambda df, labels: puquality.quality_stage(df, labels), lambda got: got == Counter({t: n for t, n in texts(ROWS).items() if t and t.strip()})),
    "exact": (lambda df, labels: exact.exact_stage(df), lambda got: got == Counter(set(texts(ROWS)))),
    "near": (lambda df, labels: jaccard.near_stage(df), lambda got: got[LONG] == 1 and got["alpha beta gamma"] == 1 and got[""] == 2 and got[None] == 1),
    "mixing": (lambda df, labels: mixing.mix_stage(df, budget=3.0), lambda got: sum(got.values()) == 3 * len(ROWS)),
}
OPERATORS = {
    "quality": lambda df, labels: puquality.quality(df, labels),
    "fingerprint": lambda df, labels: canonical.fingerprints(df),
    "packing": lambda df, labels: packing.pack(df),
    "mixing": lambda df, labels: mixing.mix(df),
    "links": lambda df, labels: jaccard.links(df),
    "exact": lambda df, labels: exact.exact_duplicates(df),
    "substring": lambda df, labels: substring.passages(df),
    "lm": lambda df, labels: lm.score(df),
}


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_carry_all_columns(spark, name, kind):
    stage, right = STAGES[name]
    df = clashing(spark, ROWS, kind)
    got = stage(df, labels_of(spark, kind))
    assert got.columns == df.columns and got.dtypes == df.dtypes
    rows = got.collect()
    assert right(Counter(r.text for r in rows))
    assert all(r[n] == f"mine {n}" for r in rows for n in NAMES if n != "K")


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_keep_the_identifiers(spark, name, kind):
    df = clashing(spark, ROWS, kind)
    got = OPERATORS[name](df, labels_of(spark, kind))
    assert dict(got.dtypes)["doc_id"] == ("bigint" if kind == "long" else "string")
    known = {r.doc_id for r in df.select("doc_id").collect()}
    found = [r.doc_id for r in got.collect()]
    assert found and set(found) <= known
    if name in ("fingerprint", "links", "lm"):
        assert Counter(found) == Counter(r.doc_id for r in df.select("doc_id").collect())


def test_tables_of_string_identifiers(spark):
    rows = {(bytes(r.first_key), r.entries) for r in sstable.shards(clashing(spark, ROWS, "string")).where("kind = 'footer'").collect()}
    assert sum(n for _, n in rows) == len(ROWS)


def test_fitted_classifier_on_edge_rows(spark):
    """Null, blank, empty, very long and repeated rows meet a fitted model."""
    good = [(1000 + i, " ".join(f"word{(i * 7 + j) % 90}" for j in range(30))) for i in range(60)]
    bad = [(2000 + i, "trash filth " + " ".join(f"word{(i * 5 + j) % 90}" for j in range(28))) for i in range(60)]
    rows = [*good, *bad, *EDGE, (20, LONG), (21, "trash filth " * 30_000), (None, "trash filth word1 word2"), (22, "word1 word2"), (22, "word1 word2")]
    labels = spark.createDataFrame([(1000 + i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    got = puquality.quality(clashing(spark, rows), labels).collect()
    kept = Counter(r.doc_id for r in got)
    assert not kept[1] and not kept[2] and not kept[3] and not kept[7] and kept[22] in (0, 2) and all(r.score >= 0 for r in got)
    assert sum(kept[i] for i, _ in good) >= 57 and sum(kept[i] for i, _ in bad) <= 3 and not kept[21]
    stage = puquality.quality_stage(clashing(spark, rows), labels)
    assert Counter(r.doc_id for r in stage.collect()) == kept


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_edge_rows_and_on_none(spark, tmp_path, empty):
    import corpus_pipeline

    docs = clashing(spark, [*ROWS, (None, "a null identifier"), (None, "a null identifier")]).where(F.lit(not empty))
    columns = docs.columns
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        assert at == 4 or docs.columns == columns
        if at == 2:
            kept = Counter(r.text for r in docs.collect())
            assert empty or (max(kept.values()) == 1 and {"a null identifier", LONG, "ties one"} <= set(kept) and None not in kept and "" not in kept)
    rows = docs.collect()
    assert not rows if empty else sum(r.length for r in rows) > 100_000
