"""Writing Arrow shards: adaptive batches, atomic files, keys aligned with a sibling column group."""

from __future__ import annotations

import sys
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from shardloom.errors import EmptyOutputError, KeyMismatchError, SchemaDriftError
from shardloom.operators.shards import OFFSET, SHARD, misaligned_keys
from shardloom.shared import small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])
MIN_BATCH_BYTES = 4 << 20
MAX_BATCH_ROWS = 16384
HELD_BYTES = 32 << 20
SENT_BYTES = 1 << 20  # Spark's batches of 64 MB or 10 000 rows would be held by each worker several times
REPORT = "shard string, path string, n_rows long, batch_size long, n_batches long"


def batch_size(table: pa.Table, min_bytes: int, max_rows: int = MAX_BATCH_ROWS) -> int:
    """The first power of two whose rows reach ``min_bytes``, at most ``max_rows``."""
    size = 1
    while size < max_rows and size < table.num_rows and table.slice(0, size).nbytes < min_bytes:
        size *= 2
    return size


class ShardFile:
    """A shard written batch by batch under another name and moved into place at the end, so that a reader never sees part of one.

    The size of its batches is settled by the first rows, so only about one batch is held.
    If later rows are so long that a batch would take more than ``HELD_BYTES``, the size is
    halved as often as that needs; what was written before is cut to it at the end.
    """

    def __init__(self, path: str, compression: str | None = "zstd", min_bytes: int = MIN_BATCH_BYTES):
        self.filesystem, self.target = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.filesystem.create_dir(self.target.rsplit("/", 1)[0], recursive=True)
        self.parts: list[str] = []
        self.compression, self.min_bytes, self.bound = compression, min_bytes, max(HELD_BYTES, 4 * min_bytes)
        self.held, self.rows, self.size, self.writer = [], 0, 0, None

    def add(self, rows: pa.Table) -> None:
        self.held.append(rows)
        self.rows += rows.num_rows
        if self.size or sum(t.num_rows for t in self.held) >= MAX_BATCH_ROWS or sum(t.nbytes for t in self.held) >= 2 * self.min_bytes:
            self.drain(False)
            while sum(t.nbytes for t in self.held) > self.bound:
                count = sum(t.num_rows for t in self.held)
                self.size = min(self.size or MAX_BATCH_ROWS, 1 << count.bit_length() - 1)  # powers of two: whole batches stay whole when cut
                self.drain(False)

    def open(self, schema: pa.Schema) -> None:
        self.schema = schema.with_metadata({**(schema.metadata or {}), b"batch_size": str(self.size).encode()})
        self.parts.append(f"{self.target}.{uuid.uuid4().hex}.part")
        self.stream = self.filesystem.open_output_stream(self.parts[-1])
        self.writer, self.opened = pa.ipc.new_file(self.stream, self.schema, options=pa.ipc.IpcWriteOptions(compression=self.compression)), self.size

    def drain(self, last: bool) -> None:
        table = pa.concat_tables(self.held)
        if not self.size:
            self.size = batch_size(table, self.min_bytes)
            if self.size >= table.num_rows and not last and self.size < MAX_BATCH_ROWS:
                self.size = 0  # the rows so far don't settle it
                return
        if self.writer is None:
            self.open(table.schema)
        whole = table.num_rows if last else table.num_rows // self.size * self.size
        if whole:
            done = table.slice(0, whole).combine_chunks().cast(self.schema)
            self.writer.write_table(done, max_chunksize=self.size)
        self.held = [table.slice(whole)]

    def shut(self) -> None:
        self.writer.close()
        self.stream.close()

    def cut(self) -> None:
        """The part once more, in batches of the size that its last rows have."""
        self.open(self.schema)
        with self.filesystem.open_input_file(self.parts[-2]) as source, pa.ipc.open_file(source) as reader:
            for number in range(reader.num_record_batches):
                self.writer.write_table(pa.Table.from_batches([reader.get_batch(number)]).cast(self.schema), max_chunksize=self.size)
        self.shut()
        self.filesystem.delete_file(self.parts.pop(-2))

    def close(self) -> tuple[int, int]:
        """(batch size, batches)"""
        self.drain(True)
        self.shut()
        if self.opened != self.size:
            self.cut()
        self.filesystem.move(self.parts[-1], self.target)
        return self.size, -(-self.rows // self.size)

    def abandon(self) -> None:
        if self.writer is not None:
            self.shut()
        for part in self.parts:
            if self.filesystem.get_file_info(part).type != pafs.FileType.NotFound:
                self.filesystem.delete_file(part)


def write_file(table: pa.Table, path: str, compression: str | None = "zstd", min_bytes: int = MIN_BATCH_BYTES) -> tuple[int, int]:
    """Write a whole table as a shard; (batch size, batches)."""
    file = ShardFile(path, compression, min_bytes)
    try:
        file.add(table)
        return file.close()
    except BaseException:
        file.abandon()
        raise


def drifted(schema, folder: str, suffix: str) -> str | None:
    """How the columns differ from those of a shard that the column group has; None if it has none or they are the same."""
    import os

    from shardloom.sources.catalog import read_schema
    from shardloom.sources.types import spark_schema

    names = sorted(e for e in os.listdir(folder) if e.endswith(suffix)) if "://" not in folder and os.path.isdir(folder) else []
    there = next((x for x in (read_schema(f"{folder}/{n}") for n in names) if x is not None), None)
    if there is None:
        return None
    old = {f.name: f.dataType.simpleString() for f in spark_schema(there)}
    new = {f.name: f.dataType.simpleString() for f in schema}
    wrong = [f"{c} is {new.get(c, 'missing')}, was {old.get(c, 'missing')}" for c in sorted({*old, *new}) if old.get(c) != new.get(c)]
    return "; ".join(wrong) or None


def reported(shard: str, file: ShardFile) -> pa.RecordBatch:
    size, batches = file.close()
    return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([file.target]), pa.array([file.rows]), pa.array([size]), pa.array([batches])], names=["shard", "path", "n_rows", "batch_size", "n_batches"])


def write_shards(
    df: DataFrame, root: str, column_dir: str, *, suffix: str = ".shard", sibling: DataFrame | None = None, key: str = "__key__", compression: str | None = "zstd",
    min_bytes: int = MIN_BATCH_BYTES, allow_empty: bool = False, schema: dict[str, str] | None = None,
) -> DataFrame:
    """Write df (with shard and offset columns) as one file for each shard; a report of the files.

    ``sibling``: a column group of the same shards; every key must be at the same
    place in both.  ``schema``: column types to cast to.  Columns must be those of the
    shards that the column group has already.
    """
    if sibling is not None:
        wrong = misaligned_keys(df, sibling, key).orderBy(SHARD, OFFSET).limit(5).collect()
        if wrong:
            raise KeyMismatchError("; ".join(f"{r[SHARD]}[{r[OFFSET]}]: {r['left_key']!r} is not {r['right_key']!r}" for r in wrong))
    if schema:
        df = df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in schema.items()})

    drift = drifted(df.drop(SHARD, OFFSET).schema, f"{root}/{column_dir}", suffix)
    if drift:
        raise SchemaDriftError(f"{root}/{column_dir}: {drift}")
    at, columns = df.columns.index(SHARD), [c for c in df.columns if c not in (SHARD, OFFSET)]

    def write(batches):
        file = current = None
        try:
            for batch in batches:
                shards = batch.column(at).to_pylist()
                cuts = [0, *(i for i in range(1, len(shards)) if shards[i] != shards[i - 1]), len(shards)]
                for low, high in zip(cuts, cuts[1:]):
                    if high > low and (file is None or shards[low] != current):
                        if file is not None:
                            yield reported(current, file)
                        current = shards[low]
                        file = ShardFile(f"{root}/{column_dir}/{current}{suffix}", compression, min_bytes)
                    if high > low:
                        file.add(pa.Table.from_batches([batch.slice(low, high - low)]).select(columns))
            if file is not None:
                yield reported(current, file)
        except BaseException:
            if file is not None:
                file.abandon()
            raise

    with small_batches(df.sparkSession, SENT_BYTES):
        report = df.repartition(SHARD).sortWithinPartitions(SHARD, OFFSET).mapInArrow(write, REPORT).toArrow()
    if not report.num_rows and not allow_empty:
        raise EmptyOutputError(f"no rows for {root}/{column_dir}")
    return df.sparkSession.createDataFrame(report, REPORT)  # from Arrow: no executor starts Python for it


def drop_columns(paths: DataFrame, columns: list[str], compression: str | None = "zstd") -> DataFrame:
    """Rewrite the shards of paths(path) without the columns; files that have none of them aren't touched."""

    def rewrite(batches):
        for batch in batches:
            done = []
            for path in batch.column(0).to_pylist():
                with pa.memory_map(path) as source:
                    table = pa.ipc.open_file(source).read_all()
                    gone = [c for c in columns if c in table.column_names]
                    if gone:
                        write_file(table.drop_columns(gone), path, compression)
                done.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.int32())], names=["path", "dropped"])

    return paths.select("path").mapInArrow(rewrite, "path string, dropped int")
