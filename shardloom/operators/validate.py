"""Integrity reports over a catalog: schemas, batches, row counts, artifacts.  Footers are read by Spark tasks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shardloom.sources.catalog import Catalog, has_tail

FOOTER = "dir string, partition string, shard string, ok boolean, fields string, n_batches int, batch_size long, n_rows long, even boolean"


def read_footer(path: str) -> dict:
    """Schema text, batches and rows; ``even``: all batches but the last have the stated size."""
    try:
        with pa.memory_map(path) as source:
            schema = pa.ipc.open_file(source).schema
            narrow = min(range(len(schema)), key=lambda i: getattr(schema.field(i).type, "bit_width", 1 << 20) if pa.types.is_primitive(schema.field(i).type) else 1 << 20, default=0)
            reader = pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=[narrow]))  # the others stay compressed
            size = int((schema.metadata or {}).get(b"batch_size", 0))
            rows = [reader.get_batch(i).num_rows for i in range(reader.num_record_batches)]
            fields = ", ".join(f"{f.name}: {f.type}" for f in schema)
            even = all(r == size for r in rows[:-1]) and all(0 < r <= size for r in rows[-1:])
            return {"ok": has_tail(path), "fields": fields, "n_batches": len(rows), "batch_size": size, "n_rows": sum(rows), "even": even}
    except (OSError, pa.ArrowInvalid):
        return {"ok": False, "fields": None, "n_batches": None, "batch_size": None, "n_rows": None, "even": None}


def footers(spark: SparkSession, catalog: Catalog, dirs: list[str] | None = None) -> DataFrame:
    """A row for each shard file of each column group, or of ``dirs``."""
    paths = [(d, p, s, path) for d, shards in catalog.shards.items() if dirs is None or d in dirs for (p, s), path in shards.items()]

    def scan(batches):
        for batch in batches:
            found = [{**dict(zip(("dir", "partition", "shard"), key)), **read_footer(key[3])} for key in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("dir", pa.string()), ("partition", pa.string()), ("shard", pa.string()), ("ok", pa.bool_()), ("fields", pa.string()), ("n_batches", pa.int32()), ("batch_size", pa.int64()), ("n_rows", pa.int64()), ("even", pa.bool_())]))

    rows = spark.createDataFrame(paths, "dir string, partition string, shard string, path string")
    return rows.repartition(max(1, min(1024, len(paths) // 64))).mapInArrow(scan, FOOTER)


def schema_groups(found: DataFrame) -> DataFrame:
    """(dir, fields, n): more than one row for a dir is a conflict; damaged files have no schema and aren't counted."""
    return found.where("ok").groupBy("dir", "fields").agg(F.count(F.lit(1)).alias("n"))


def uneven_batches(found: DataFrame) -> DataFrame:
    return found.where("ok AND NOT even").select("dir", "partition", "shard", "n_batches", "batch_size", "n_rows")


def row_count_conflicts(found: DataFrame) -> DataFrame:
    """Shards whose column groups differ in their numbers of rows."""
    return found.where("ok").groupBy("partition", "shard").agg(F.min("n_rows").alias("least"), F.max("n_rows").alias("most")).where("least <> most")


def check_artifacts(catalog: Catalog, spec: dict[str, dict[str, str]]) -> list[tuple[str, str, str]]:
    """(dir, column, problem) against {dir: {column: part of the type's name, in any case, or ''}}."""
    out = [(d, "", "missing") for d in sorted(set(spec) - set(catalog.shards))] + [(d, "", "not in the specification") for d in sorted(set(catalog.shards) - set(spec))]
    for d in sorted(set(spec) & set(catalog.schemas)):
        schema = catalog.schemas[d]
        out += [(d, c, "missing") for c in sorted(set(spec[d]) - set(schema.names))]
        out += [(d, c, "not in the specification") for c in schema.names if c not in spec[d] and c != "__key__"]
        out += [(d, c, f"has type {schema.field(c).type}") for c, kind in spec[d].items() if c in schema.names and kind.lower() not in str(schema.field(c).type).lower()]
    return out
