import io
import json
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom.plans import commands
from shardloom.plans.dataset import Dataset
from shardloom.sources.sink import write_file


def make(root, name, column, keys=None, batch=64):
    for shard, ids in {"a": range(5), "b": range(5, 8)}.items():
        write_file(pa.table({"__key__": [(keys or "f_{:03d}").format(i) for i in ids], column: [float(i) for i in ids]}), f"{root}/{name}/{shard}.shard", min_bytes=batch)


@pytest.fixture
def root(tmp_path):
    make(tmp_path / "d", "one", "x")
    make(tmp_path / "d", "two", "y")
    return tmp_path / "d"


def test_looking_at_a_dataset(spark, root, capsys):
    data = Dataset(spark, str(root))
    assert list(commands.list_keys(data, ("", "b"))) == ["f_005", "f_006", "f_007"]
    assert {(r.field, r.dir) for r in commands.inspect(data).collect()} >= {("x", "one"), ("y", "two")}
    assert [r.x for r in commands.head_shard(data, ("", "a"), 2, ["x"])] == [0.0, 1.0]
    assert commands.main(["validate", str(root)]) == 1 and "no index" in capsys.readouterr().out
    assert commands.main(["init", str(root)]) == 0 and commands.main(["validate", str(root)]) == 0
    data.open_index()
    assert {(r["name"], r["offset"]) for r in commands.files_of_shard(data, "", "b").collect()} == {("f_005", 0), ("f_006", 1), ("f_007", 2)}
    capsys.readouterr()
    assert commands.main(["dump_index", str(root)]) == 0 and len(capsys.readouterr().out.splitlines()) == 8
    assert commands.main(["list", str(root), "--shard", "a"]) == 0 and capsys.readouterr().out.split() == [f"f_{i:03d}" for i in range(5)]
    assert commands.main(["inspect", str(root)]) == 0 and commands.main(["head_shard", str(root), "--shard", "a", "-n", "1"]) == 0
    (root / "one" / "a.shard").write_bytes(b"broken")
    assert commands.main(["list", str(root), "--shard", "a"]) == 1


def test_validation_finds_problems(spark, root, tmp_path):
    make(root, "three", "z", keys="g_{:03d}")
    assert any("keys differ" in p for _, p in commands.validate_dataset(spark, str(root)))
    make(tmp_path / "tree" / "one", "c", "x")
    assert commands.validate_tree(spark, str(tmp_path / "tree")) == [(f"one: {tmp_path / 'tree' / 'one'}", "has no index")]
    (root / "two" / "a.shard").write_bytes(b"")
    assert ("two/a", "damaged") in commands.validate_dataset(spark, str(root))
    assert commands.validate_dataset(spark, str(tmp_path / "nothing"))[0][1].startswith("no dataset")


def test_a_group_in_progress_is_renamed_when_it_is_complete(tmp_path):
    make(tmp_path, "c.in-progress", "x")
    (tmp_path / "c.in-progress" / "late.shard").write_bytes(b"")
    assert not commands.finish(str(tmp_path / "c.in-progress"))
    (tmp_path / "c.in-progress" / "late.shard").unlink()
    assert commands.finish(str(tmp_path / "c.in-progress")) and (tmp_path / "c" / "a.shard").exists() and not commands.finish(str(tmp_path / "c"))


def test_extracted_lists_become_one_index(spark, root, tmp_path):
    make(tmp_path / "e", "one", "x", keys="h_{:03d}")
    log = commands.extract(spark, {"d": str(root), "e": str(tmp_path / "e"), "gone": str(tmp_path / "gone")}, str(tmp_path / "out"), segmented=True, audio_duration="x", speech_duration="x / 2")
    assert {(r["name"], r["files"]) for r in log.collect()} == {("d", 2), ("e", 2), ("gone", None)} and log.where("error IS NOT NULL").count() == 1
    assert "x" in json.loads(spark.read.text(f"{tmp_path}/out/d/fields").first()[0])
    with pytest.raises(ValueError, match="other durations: f"):
        commands.merge_index(spark, f"{tmp_path}/out", f"{tmp_path}/index")
    commands.extract(spark, {"d": str(root), "e": str(tmp_path / "e")}, str(tmp_path / "out"), audio_duration="x", speech_duration="x / 2")
    files, shards = commands.merge_index(spark, f"{tmp_path}/out", f"{tmp_path}/index", segmented=False)
    assert files.count() == 16 and shards.agg(F.sum("n_samples")).first()[0] == 16
    assert commands.index_totals(files, shards, {})["audio_duration"] == 56 and commands.index_totals(files, shards, {"audio_duration": 9.5})["audio_duration"] == 9.5


def test_sqlite_index_links_and_file_objects(spark, tmp_path):
    with sqlite3.connect(tmp_path / "index.sqlite3") as db:
        db.execute("CREATE TABLE files (name TEXT, shard_id INT, offset INT, audio_duration REAL, speech_duration REAL)")
        db.execute("CREATE TABLE shards (shard_id INT, shard TEXT, n_samples INT, global_offset INT, partition TEXT)")
        db.execute("CREATE TABLE metadata (value TEXT)")
        db.executemany("INSERT INTO files VALUES (?, 0, ?, 1.5, -1)", [(f"n{i}", i) for i in range(5)])
        db.execute("INSERT INTO shards VALUES (0, 's', 5, 0, NULL)")
        db.execute("INSERT INTO metadata VALUES ('{\"segmented\": true}')")
    files, shards, metadata = commands.sqlite_index(spark, str(tmp_path / "index.sqlite3"))
    assert files.count() == 5 and shards.first().n_samples == 5 and metadata == {"segmented": True}
    path = commands.write_link(str(tmp_path), "audio", "../source", "vad.npy")
    assert json.loads(path.read_text()) == {"dataset_dir": "../source", "loader": "segment", "vad_column": "vad.npy"} and path.name == "audio.shard-link"
    (tmp_path / "raw").write_bytes(b"abc")
    assert [commands.as_file(v).read() for v in (str(tmp_path / "raw"), b"abc", pa.scalar(b"abc"), io.BytesIO(b"abc"))] == [b"abc"] * 4
