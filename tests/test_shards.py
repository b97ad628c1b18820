import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom.errors import EmptyOutputError, KeyMismatchError, SchemaDriftError, ShardMissingError
from shardloom.functions import codecs, keys
from shardloom.operators import index, links, validate
from shardloom.operators.shards import OFFSET, SHARD
from shardloom.plans.dataset import Dataset
from shardloom.sources import sink
from shardloom.sources.catalog import Catalog, object_path
from shardloom.sources.sink import batch_size, drop_columns, write_file, write_shards


def make(root, name, shards, column, value, min_bytes=64):
    for shard, ids in shards.items():
        write_file(pa.table({"__key__": [f"f_{i:08d}" for i in ids], column: [value(i) for i in ids]}), f"{root}/{name}/{shard}.shard", min_bytes=min_bytes)


@pytest.fixture
def zipped(tmp_path):
    shards = {"a.b[1]": range(10), "b_2": range(10, 17), "c": range(17, 18)}
    make(tmp_path, "one", shards, "x", lambda i: i)
    make(tmp_path, "two", shards, "y.z", lambda i: np.float16(i / 2))
    return tmp_path


def test_two_groups_are_zipped_and_only_needed_ones_opened(spark, zipped):
    data = Dataset(spark, str(zipped))
    rows = data.select("x + 1 AS x1", "y.z", "__shard__", "__shard_offset__").collect()
    assert [(r.x1 - 1) / 2 for r in rows] == [r["y.z"] for r in rows] and len(rows) == 18
    os.remove(zipped / "two" / "c.shard")
    assert data.select("x").count() == 18 and data.select("x", "y.z").count() == 17
    assert data.select("count(x) AS n", per_shard=True).count() == 3
    assert [r["__key__"] for r in data.where_keys("x > 15").collect()] == ["f_00000016", "f_00000017"]


def test_damaged_shard_with_an_index_gives_null_rows(spark, zipped):
    sizes = spark.createDataFrame([("", "a.b[1]", 10), ("", "b_2", 7), ("", "c", 1)], "partition string, shard string, n_samples long")
    (zipped / "two" / "b_2.shard").write_bytes(b"broken")
    data = Dataset(spark, str(zipped), shards=sizes)
    rows = data.select("x", "y.z", "__key__").collect()
    assert len(rows) == 18 and sum(r.x is None and r["__key__"] is None for r in rows) == 7
    assert data.select("x").where("x IS NULL").count() == 0 and len(data) == 18
    for shard in ("a.b[1]", "c"):
        (zipped / "two" / f"{shard}.shard").write_bytes(b"")
    with pytest.raises(ShardMissingError):
        data.select("y.z")


def test_subsample_iteration_and_lookup(spark, zipped):
    data = Dataset(spark, str(zipped), segmented=True)
    assert data.select("x", shard_subsample=0.4, seed=1).count() in (1, 7, 10)
    assert [r.x for r in data.sequence(("", "a.b[1]"), ["x"], 3, 4)] == [3, 4, 5, 6]
    assert [r.x for r in data.filtered("x > 3", ["x"], shuffle=False)] == list(range(4, 18)) and data.last_query_n_samples == 14
    draws = [[r.x for r in data.filtered("x > 3", ["x"], shuffle=False, n=3, seed=s)] for s in range(8)]
    assert all(d == sorted(set(d)) and len(d) == 3 for d in draws) and len(set(map(tuple, draws))) > 1
    assert sorted(r.x for r in data.filtered("x > 12", ["x"], seed=1)) == [13, 14, 15, 16, 17]
    assert list(data.filtered("x > 99", ["x"], infinite=True)) == [] and data.last_query_n_samples == 0
    again = [r.x for r in data.filtered("x > 12", ["x"], infinite=True, n=12)]
    assert len(again) == 12 and set(again[:5]) == set(again[5:10]) == {13, 14, 15, 16, 17}
    assert {r.x for r in data.filtered("x >= 0", ["x"], shard_subsample=0.4, rng=1)} < set(range(18))
    assert data.random_positions(5, 1) == data.random_positions(5, 1)
    assert len(next(data.random_chunks(["x"], 3))) <= 3
    assert data.sample("f_00000016", ["x"]).x == 16 and data.sample("f_9", ["x"]) is None
    files, shards = data.build_index()
    assert [(r["shard"], r["global_offset"]) for r in shards.orderBy("shard_id").collect()] == [("a.b[1]", 0), ("b_2", 10), ("c", 17)]
    probes = spark.createDataFrame([(0,), (9,), (10,), (17,), (18,), (-1,)], "i long")
    got = {r.i: r.x for r in data.rows_at(probes, shards, ["x"]).collect()}
    assert got == {0: 0, 9: 9, 10: 10, 17: 17, 18: None, -1: None}


def test_samples_by_key_and_index(spark, zipped):
    data = Dataset(spark, str(zipped))
    with pytest.raises(ValueError):
        data[0]
    path = data.write_index(str(zipped / "index"), note="x")
    data = Dataset(spark, str(zipped))
    assert data.open_index(path)["fields"] and data.open_index()["note"] == "x"
    assert data[16]["x"] == 16 and data["f_00000016"]["y.z"] == 8 and data["f_00000016"].ref == ("", "b_2")
    assert data[18] is None and data[-1] is None and data["f_00000099"] is None and data["other_00000000"] is None
    with pytest.raises(TypeError):
        data[1.5]
    one = data["f_00000003"]
    assert "x" in one and "no" not in one and one.get_one_of("no", "x") == 3 and one.row("x", "y.z") == {"x": 3, "y.z": 1.5}
    with pytest.raises(KeyError):
        one["no"]
    one["x"] = 7
    assert one["x"] == 7 and one.get("no", 5) == 5
    assert data.random_sample()["x"] in range(18) and len(list(data.random_samples(2))) == 2
    first = next(iter(data))
    assert first["x"] in range(18)
    assert data.index_sql("SELECT sum(n_samples) AS n FROM {shards}").first().n == 18


def test_keys_of_all_groups_must_agree(spark, tmp_path):
    write_file(pa.table({"__key__": ["a", "b", "c"], "x": [1, 2, 3]}), f"{tmp_path}/one/s.shard")
    write_file(pa.table({"__key__": ["a", "ZZZ", "c"], "y": [1, 2, 3]}), f"{tmp_path}/two/s.shard")
    data = Dataset(spark, str(tmp_path))
    data.write_index()
    assert data.sample("a", ["x"]).x == 1
    for read in (lambda: data.sample("b", ["x", "y"]), lambda: data["b"].row("x", "y"), lambda: Dataset(spark, str(tmp_path)).sample("b", ["x", "y"])):
        with pytest.raises(Exception, match="one has b, two has ZZZ"):
            read()
    assert [tuple(r) for r in data.key_mismatches("one", "two").select("left_key", "right_key").collect()] == [("b", "ZZZ")]


def test_columns_are_those_that_the_analysis_finds(spark, zipped):
    os.remove(zipped / "two" / "c.shard")
    (zipped / "three").mkdir()
    make(zipped, "three", {"b_2": range(10, 17)}, "y", lambda i: i)
    data = Dataset(spark, str(zipped))
    assert data.select("x AS y").count() == data.select("x AS z").count() == 18
    assert data.referenced(["x + 1 AS `y.z`", "'y'"]) == ["x"] and data.referenced(["count(1)"]) == [] and data.referenced(["`y.z` + x"]) == ["x", "y.z"]
    assert data.select("upper(concat(x, 'y')) AS X").count() == 18
    with pytest.raises(Exception, match="no_such"):
        data.select("no_such + 1")


def test_a_shard_is_written_as_a_stream(spark, tmp_path):
    df = spark.range(20_000).select(F.lit("s").alias(SHARD), F.col("id").alias(OFFSET), F.col("id").cast("string").alias("__key__"), F.repeat(F.lit("ab"), 100).alias("t"))
    report = write_shards(df, str(tmp_path), "one", min_bytes=20_000).first()
    assert (report.n_rows, report.batch_size, report.n_batches) == (20_000, 128, 157)
    found = validate.footers(spark, Catalog.discover(str(tmp_path))).first()
    assert found.ok and found.even and (found.n_rows, found.batch_size, found.n_batches) == (20_000, 128, 157)
    assert Dataset(spark, str(tmp_path)).select("__key__", "__shard_offset__").where("__key__ = __shard_offset__").count() == 20_000
    assert not list(tmp_path.glob("**/*.part"))


def test_rows_come_to_the_sink_in_small_batches(spark, tmp_path, monkeypatch):
    class Seen(sink.ShardFile):
        most = 0

        def add(self, rows):
            self.most = max(self.most, rows.nbytes)
            super().add(rows)

    def reported(shard, file):
        size, batches = file.close()
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([str(file.most)]), pa.array([file.rows]), pa.array([size]), pa.array([batches])], names=["shard", "path", "n_rows", "batch_size", "n_batches"])

    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(conf, None)
    spark.conf.unset(conf)
    monkeypatch.setattr(sink, "ShardFile", Seen)
    monkeypatch.setattr(sink, "reported", reported)
    df = spark.range(9000).select(F.concat(F.lit("s"), F.col("id") % 2).alias(SHARD), F.col("id").alias(OFFSET), F.col("id").cast("string").alias("__key__"), F.repeat(F.lit("ab"), 1000).alias("t"))
    try:
        report = write_shards(df, str(tmp_path), "one").collect()
        assert sorted((r["shard"], r.n_rows) for r in report) == [("s0", 4500), ("s1", 4500)] and max(int(r.path) for r in report) < 2 << 20
        assert spark.conf.get(conf, None) is None
        spark.conf.set(conf, str(64 << 10))
        assert max(int(r.path) for r in write_shards(df, str(tmp_path), "two").collect()) < 128 << 10 and spark.conf.get(conf) == str(64 << 10)
    finally:
        spark.conf.unset(conf)
        if kept is not None:
            spark.conf.set(conf, kept)


@pytest.mark.parametrize("short", [0, 5000, 16_384, 40_000])
def test_long_rows_after_short_ones_are_not_held(tmp_path, short):
    file, most = sink.ShardFile(f"{tmp_path}/one/s.shard"), 0
    tables = [pa.table({"x": range(at, min(at + 1000, short)), "t": ["x"] * (min(at + 1000, short) - at)}) for at in range(0, short, 1000)]
    tables += [pa.table({"x": range(at, at + 50), "t": [str(i) * 10_000 for i in range(at, at + 50)]}) for at in range(short, short + 2010, 50)]
    for table in tables:
        file.add(table)
        most = max(most, sum(t.nbytes for t in file.held))
    size, batches = file.close()
    assert most <= 33 << 20 and os.listdir(tmp_path / "one") == ["s.shard"]
    with pa.ipc.open_file(f"{tmp_path}/one/s.shard") as reader:
        rows = [reader.get_batch(i).num_rows for i in range(reader.num_record_batches)]
        assert set(rows[:-1]) == {size} and 0 < rows[-1] <= size and len(rows) == batches and int(reader.schema.metadata[b"batch_size"]) == size
        assert reader.read_all().equals(pa.concat_tables(tables))


def test_a_group_keeps_its_schema(spark, tmp_path):
    row = lambda shard, x: spark.createDataFrame([(shard, 0, "k", x)], f"{SHARD} string, {OFFSET} long, __key__ string, x {'long' if isinstance(x, int) else 'string'}")
    write_shards(row("a", 1), str(tmp_path), "one")
    write_shards(row("b", 2), str(tmp_path), "one")
    with pytest.raises(SchemaDriftError, match="x is string, was bigint"):
        write_shards(row("c", "3"), str(tmp_path), "one")
    assert write_shards(row("c", "3"), str(tmp_path), "one", schema={"x": "long"}).count() == 1


def test_loaders_alternatives_and_field_maps(spark):
    links.alias("other_name", "prefix")
    assert links.REGISTRY.pop("other_name") is links.REGISTRY["prefix"]
    df = spark.createDataFrame([(None, 2), (1, 3)], "a long, b long")
    assert [r[0] for r in df.select(links.first_available(df, ["no", "a", "b"])).collect()] == [2, 1]
    with pytest.raises(KeyError):
        links.first_available(df, ["no"])
    assert links.merge_field_maps([{"x": 1}, {"x": 2, "y": 3}]) == ({"x": 1, "y": 3}, [(1, "x", 2)])


def test_collisions_links_and_computed_columns(spark, zipped):
    make(zipped, "three", {"a.b[1]": range(10)}, "x", lambda i: -i)
    data = Dataset(spark, str(zipped))
    assert {"one.x", "three.x"} <= set(data.schema.names) and "x" not in data.schema.names
    data.add_computed("clip", spark.createDataFrame([("f_00000001", "t")], "file string, title string"), loader="prefix", key_prefix="s.")
    assert data.linked("clip").where("`s.title` = 't'").count() == 1
    with pytest.raises(ValueError):
        data.select("clip")
    with pytest.raises(ValueError):
        links.build({"loader": ["os", "system"]}, None, None)


def test_sink_checks_keys_emptiness_and_atomicity(spark, tmp_path):
    df = spark.createDataFrame([("s", i, f"k{i}", float(i)) for i in range(5)], f"{SHARD} string, {OFFSET} long, __key__ string, v double")
    report = write_shards(df, str(tmp_path), "g", sibling=df, schema={"v": "float"}).collect()
    assert report[0]["n_rows"] == 5 and os.listdir(tmp_path / "g") == ["s.shard"]
    with pytest.raises(KeyMismatchError):
        write_shards(df, str(tmp_path), "h", sibling=df.withColumn("__key__", F.concat("__key__", F.lit("!"))))
    with pytest.raises(EmptyOutputError):
        write_shards(df.where("false"), str(tmp_path), "h")
    path = f"{tmp_path}/g/s.shard"
    assert drop_columns(spark.createDataFrame([(path,)], "path string"), ["v", "none"]).first()["dropped"] == 1
    assert Catalog.discover(str(tmp_path)).schemas["g"].names == ["__key__"]


def test_reports(spark, zipped):
    catalog = Catalog.discover(str(zipped))
    found = validate.footers(spark, catalog)
    assert found.count() == 6 and validate.uneven_batches(found).count() == 0 and validate.row_count_conflicts(found).count() == 0
    assert validate.schema_groups(found).count() == 2
    problems = validate.check_artifacts(catalog, {"one": {"x": "STRING", "w": ""}, "gone": {}})
    assert ("gone", "", "missing") in problems and ("one", "w", "missing") in problems and ("two", "", "not in the specification") in problems


def test_new_shards_are_streamed(spark, zipped, tmp_path):
    data = Dataset(spark, str(zipped))
    q = data.stream(["x", "__shard__"]).writeStream.format("memory").queryName("shards_seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT * FROM shards_seen").count() == 18


def test_golden_keys_and_codecs(spark):
    name = "20VC with Harry Stebbings/[HGF1a_ULnik] Gina Gotthilf"
    df = spark.createDataFrame([(name, 1254), ("a\nb_1", 7)], "file string, segment long").select("*", keys.make_key(F.col("file"), F.col("segment")).alias("k"))
    back = df.select("file", "segment", keys.key_file(F.col("k")).alias("f"), keys.key_segment(F.col("k")).alias("s"), "k").collect()
    assert all(r.file == r.f and r.segment == r.s for r in back) and back[0].k == name + "_00001254"
    cells = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.5]],), ([],), (None,)], "v array<array<double>>")
    out = cells.select("v", codecs.decode("vad.npy", codecs.encode("vad.npy", F.col("v"), "array")).alias("w")).collect()
    assert [r.w for r in out] == [[[1.0, 2.0], [3.0, 4.5]], [], None]
    with pytest.raises(ValueError):
        codecs.decode("x.pyd", F.lit(None))
    assert codecs.first_audio(["x", "a.mp3", "b.flac"]) == "b.flac"
    assert object_path("", "../p", "q/../r") == "p/r"
    assert batch_size(pa.table({"x": range(100)}), 64) == 8


def test_lookup_by_index_with_many_shards(spark, monkeypatch):
    shards = spark.createDataFrame([(0, 0, 3), (1, 3, 0), (2, 3, 5)], "shard_id int, global_offset long, n_samples long")
    probes = spark.createDataFrame([(i,) for i in range(-1, 9)], "i long")
    rows = lambda: sorted(map(tuple, index.lookup_by_index(probes, shards).collect()), key=repr)
    small = rows()
    monkeypatch.setattr(index, "BROADCAST_SHARDS", 1)
    assert rows() == small and (4, 2, 1) in small and (8, None, None) in small
