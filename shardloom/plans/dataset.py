"""A dataset of Arrow shards as one wide table: expressions, filters, lookups, iteration."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import NullType, StructField, StructType

from shardloom.errors import ShardMissingError
from shardloom.functions.keys import dataset_key
from shardloom.operators import index as ix
from shardloom.operators import links as lk
from shardloom.operators.shards import misaligned_keys
from shardloom.sources.arrow import FORMAT, SPECIAL, register
from shardloom.sources.catalog import KEY, Catalog, valid_shards

DEFAULT_SHARDS = 150


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def references(frame: DataFrame) -> set[str]:
    """The columns of a one-table plan that its expressions use, after analysis."""
    plan = frame._jdf.queryExecution().analyzed()
    leaf = plan.collectLeaves().head()
    names = {a.exprId().id(): a.name() for a in seq(leaf.output())}
    found, nodes = set(), [plan]
    while nodes:
        node = nodes.pop()
        if not node.children().isEmpty():
            found |= {names[a.exprId().id()] for a in seq(node.references().toSeq()) if a.exprId().id() in names}
            nodes += seq(node.children())
    return found


def seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


class Sample:
    """A sample of a dataset: a mapping from fields to values that reads a field when it is asked for.

    The first column group that is read gives the key; every other one is checked
    against it.  A value that is set stands before the stored one.
    """

    def __init__(self, dataset: Dataset, ref: tuple[str, str], offset: int, overrides: dict | None = None):
        self.dataset, self.ref, self.offset, self.overrides, self.known = dataset, ref, offset, dict(overrides or {}), {}

    def keys(self) -> set[str]:
        return {*self.dataset.schema.names, *self.overrides}

    def __contains__(self, field: str) -> bool:
        return field in self.keys()

    def __getitem__(self, field: str):
        if field in self.overrides:
            return self.overrides[field]
        if field not in self.dataset.schema.names:
            raise KeyError(field)
        if field not in self.known:
            wanted = list(dict.fromkeys([*self.known, field]))  # with the groups read before, so keys are compared
            row = self.dataset.row_at(self.ref, self.offset, wanted)
            if row is None:
                raise IndexError(f"{self.ref} has no row {self.offset}")
            self.known = {f: row[f] for f in wanted}
        return self.known[field]

    def __setitem__(self, field: str, value) -> None:
        self.overrides[field] = value

    def get(self, field: str, default=None):
        return self[field] if field in self else default

    def get_one_of(self, *fields: str, default=None):
        return next((self[f] for f in fields if f in self), default)

    def row(self, *fields: str) -> dict:
        """Several fields by one read."""
        stored = [f for f in fields if f not in self.overrides]
        row = self.dataset.row_at(self.ref, self.offset, list(dict.fromkeys([*self.known, *stored]))) if stored else {}
        if row is None:
            raise IndexError(f"{self.ref} has no row {self.offset}")
        return {f: self.overrides[f] if f in self.overrides else row[f] for f in fields}


class Dataset:
    """``shards``: the index's shards table (partition, shard, n_samples); with it a damaged shard gives NULL rows, without it none."""

    def __init__(self, spark: SparkSession, root: str, *, segmented: bool = False, shards: DataFrame | None = None, suffix: str = ".shard", partitions: tuple[str, ...] = ("",)):
        register(spark)
        self.spark, self.segmented = spark, segmented
        self.catalog = Catalog.discover(root, suffix, partitions)
        self.schema = self.catalog.schema()
        self.sizes = None if shards is None else {(r["partition"] or "", r["shard"]): r["n_samples"] for r in shards.select("partition", "shard", "n_samples").toLocalIterator()}
        self.computed = {name: dict(link) for name, link in self.catalog.links.items()}
        self.sources: dict[str, DataFrame] = {}
        self.index: tuple[DataFrame, DataFrame] | None = None
        self.last_query_n_samples: int | None = None
        self.rng = random.Random()

    def add_computed(self, name: str, source: DataFrame, **link) -> None:
        """A column that comes from another table; ``link`` names the loader and its settings."""
        self.computed[name], self.sources[name] = link, source

    def linked(self, name: str, *columns: str) -> DataFrame:
        """The key and columns of all rows, joined with those of a link's source: the join is made only when it is asked for."""
        rows = self.select(KEY, *columns)
        file, segment = dataset_key(F.col(KEY), self.segmented)
        return lk.build(self.computed[name], rows.withColumn("file", file).withColumn("segment", segment), self.sources[name])

    def referenced(self, expressions: list[str]) -> list[str]:
        """Fields that the expressions use, as Spark's analysis sees them; those of computed columns are refused."""
        computed = [c for c in self.computed if c not in self.schema.names]
        empty = self.spark.createDataFrame([], StructType([*self.schema.fields, *(StructField(c, NullType()) for c in computed)]))
        used = references(empty.selectExpr(*expressions))
        if used & set(self.computed):
            raise ValueError(f"{min(used & set(self.computed))} is a computed column; use linked()")
        return [n for n in self.schema.names if n in used]

    def chosen(self, subsample: float | None, seed: int) -> list[tuple[str, str]]:
        """Shards of the query: all, or a seeded sample of them in the order drawn; ``None`` aims at 150 shards."""
        refs = sorted(self.sizes) if self.sizes is not None else self.catalog.shard_list()
        if subsample is None:
            subsample = 1 if self.sizes is None or len(refs) < DEFAULT_SHARDS else DEFAULT_SHARDS / len(refs)
        if subsample >= 1:
            return refs
        return random.Random(seed).sample(refs, max(1, int(len(refs) * subsample)))

    def frame(self, fields: list[str], refs: list[tuple[str, str]] | None = None, verify: bool = False) -> DataFrame:
        """The wide table with just these columns; only the column groups that hold them are opened.  ``verify``: all groups must have the same keys."""
        refs = self.chosen(1, 0) if refs is None else refs
        places = {f: (None if f in SPECIAL else self.catalog.fields[f][0]) for f in fields}
        dirs = list(dict.fromkeys(p[0] for p in places.values() if p)) or [self.catalog.fields[KEY][0][0]]
        if KEY in fields and len(dirs) > 1:  # the key of a group that is open anyhow
            alternatives = [p for p in self.catalog.fields[KEY] if p[0] in {q[0] for f, q in places.items() if q and f != KEY}]
            places[KEY] = (alternatives or self.catalog.fields[KEY])[0]
            dirs = list(dict.fromkeys(p[0] for p in places.values() if p))
        good = valid_shards(self.spark, self.catalog, refs, dirs)
        if not any(good.values()):
            raise ShardMissingError(f"no shard of {self.catalog.root} is complete in {dirs}")
        shards = [
            {"ok": good[r], "n": (self.sizes or {}).get(r), "partition": r[0], "shard": r[1], "key_path": self.catalog.path(dirs[0], r), "paths": {d: self.catalog.path(d, r) for d in dirs}}
            for r in refs
            if good[r] or self.sizes is not None
        ]
        columns = [[f] if places[f] is None else [f, *places[f]] for f in fields]
        if all(p is None for p in places.values()):  # something must say how many rows there are
            fields, columns = [*fields, KEY], [*columns, [KEY, *self.catalog.fields[KEY][0]]]
        schema = StructType([self.schema[f] for f in fields])
        options = {"columns": json.dumps(columns), "shards": json.dumps(shards), "schema": json.dumps(schema.jsonValue())}
        if verify:
            options["verify"] = json.dumps([d for d in dirs if KEY in self.catalog.schemas[d].names])
        return self.spark.read.format(FORMAT).options(**options).schema(schema).load()

    def quote(self, expression: str) -> str:
        """A field with a dot in its name may be given bare if it is the whole expression."""
        return quoted(expression) if "." in expression and expression in self.schema.names else expression

    def select(self, *expressions: str, shard_subsample: float | None = 1, seed: int = 42, per_shard: bool = False) -> DataFrame:
        """A DataFrame of scalar expressions; ``per_shard``: each is an aggregate, with one row for each shard."""
        expressions = [self.quote(e) for e in expressions]
        fields = self.referenced(expressions)
        refs = self.chosen(shard_subsample, seed)
        if not per_shard:
            return self.frame(fields or [KEY], refs).selectExpr(*expressions)
        fields += [f for f in ("__partition__", "__shard__") if f not in fields]
        return self.frame(fields, refs).groupBy("__partition__", "__shard__").agg(*[F.expr(e) for e in expressions])

    def where_keys(self, predicate: str, **options) -> DataFrame:
        """Keys of the rows for which the predicate is TRUE."""
        return self.select(f"({predicate}) AS __hit", KEY, **options).where("__hit").where(F.col(KEY).isNotNull()).select(KEY)

    def filtered(self, predicate: str, fields: list[str], infinite: bool = False, shuffle: bool = True, n: int | None = None, seed: int | None = None, shard_subsample: float | None = 1, rng: int = 42) -> Iterator[Row]:
        """Rows that match: all of them, or ``n`` drawn at random; shuffled, or in the order of the dataset.

        ``infinite`` begins again, with another order and draw, until ``n`` rows in
        all were given.  ``last_query_n_samples`` is the number of matches.
        """
        places = ["__partition__", "__shard__", "__shard_offset__"]
        names = list(dict.fromkeys([*self.referenced([predicate]), KEY, *fields, *places]))
        rows = self.frame(names, self.chosen(shard_subsample, rng)).where(F.expr(predicate)).where(F.col(KEY).isNotNull())
        self.last_query_n_samples = rows.count()
        seed, turn, given = random.randrange(1 << 31) if seed is None else seed, 0, 0
        while self.last_query_n_samples and (n is None or given < n):
            draw = F.xxhash64(F.lit(seed), F.lit(turn), KEY, *places)
            picked = rows if n is None else rows.withColumn("__draw", draw).orderBy("__draw", *places).limit(n - given)
            picked = picked.orderBy(draw, *places) if shuffle else picked.orderBy(*places)
            for row in picked.select(KEY, *[quoted(f) for f in fields if f != KEY]).toLocalIterator(prefetchPartitions=True):
                given += 1
                yield row
            if not infinite:
                return
            turn += 1

    # -- index and lookups

    def build_index(self) -> tuple[DataFrame, DataFrame]:
        """(files, shards) from the keys of all shards."""
        rows = self.frame([KEY, "__partition__", "__shard__", "__shard_offset__"])
        file, segment = dataset_key(F.col(KEY), self.segmented)
        shard = F.struct("__partition__", "__shard__")
        parts = rows.select(shard.alias("shard"), file.alias("file"), F.col("__shard_offset__").alias("offset"), F.lit(0.0).alias("duration"))
        found = ix.episodes(parts)
        counted = found.groupBy("shard").agg(F.sum("n_segments").cast("bigint").alias("n_samples")).select(F.col("shard.__partition__").alias("partition"), F.col("shard.__shard__").alias("shard"), "n_samples")
        shards = ix.running_offsets(counted, ["partition", "shard"]).select("shard_id", "partition", "shard", "n_samples", "global_offset")
        files = found.select(F.col("shard.__partition__").alias("partition"), F.col("shard.__shard__").alias("shard"), "file", "offset", "n_segments").join(shards.select("partition", "shard", "shard_id"), ["partition", "shard"])
        return files.select(F.col("file").alias("name"), "shard_id", "offset", "n_segments"), shards

    def write_index(self, path: str | None = None, **metadata) -> str:
        """Make the index and store it: files, shards, and what is known of the dataset."""
        path = path or f"{self.catalog.root}/index"
        files, shards = self.build_index()
        files.repartitionByRange("name").sortWithinPartitions("name").write.mode("overwrite").parquet(f"{path}/files")
        shards.coalesce(1).write.mode("overwrite").parquet(f"{path}/shards")
        said = {"fields": sorted(self.catalog.fields), "computed_columns": sorted(self.computed), "segmented": self.segmented, **metadata}
        self.spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
        self.open_index(path)
        return path

    def open_index(self, path: str | None = None) -> dict:
        """Use a stored index for lookups; its metadata."""
        path = path or f"{self.catalog.root}/index"
        self.index = self.spark.read.parquet(f"{path}/files"), self.spark.read.parquet(f"{path}/shards")
        return json.loads(self.spark.read.text(f"{path}/metadata").first()[0])

    def index_sql(self, query: str) -> DataFrame:
        """Any SQL over the index's tables ``files`` and ``shards``."""
        if self.index is None:
            raise ValueError("the dataset has no index")
        return self.spark.sql(query, files=self.index[0], shards=self.index[1])

    def locate(self, key_or_index: str | int) -> tuple[tuple[str, str], int, int] | None:
        """((partition, shard), offset in the shard, index) of a sample, by the index."""
        if isinstance(key_or_index, bool) or not isinstance(key_or_index, (str, int)):
            raise TypeError(f"a sample has a key or an index, not {type(key_or_index).__name__}")
        if self.index is None:
            raise ValueError("the dataset has no index; write_index() or open_index() first")
        files, shards = self.index
        if isinstance(key_or_index, int):
            found = shards.where((F.col("global_offset") <= key_or_index) & (F.col("global_offset") + F.col("n_samples") > key_or_index)).select("partition", "shard", (F.lit(key_or_index) - F.col("global_offset")).alias("offset"), F.lit(key_or_index).alias("i"))
        else:
            file, segment = dataset_key(F.lit(key_or_index), self.segmented)
            probe = self.spark.range(1).select(file.alias("file"), segment.alias("segment")).first()
            hit = files.where((F.col("name") == probe["file"]) & (F.col("n_segments") > F.lit(probe["segment"])) & (F.lit(probe["segment"]) >= 0)).join(shards, "shard_id")
            found = hit.select("partition", "shard", (F.col("offset") + probe["segment"]).alias("offset"), (F.col("global_offset") + F.col("offset") + probe["segment"]).alias("i")).orderBy("i")
        row = found.first()
        return row and ((row["partition"], row["shard"]), row["offset"], row["i"])

    def __getitem__(self, key_or_index: str | int) -> Sample | None:
        """The sample with a key or an index; None if there is none."""
        found = self.locate(key_or_index)
        return found and Sample(self, found[0], found[1])

    def row_at(self, ref: tuple[str, str], offset: int, fields: list[str]) -> Row | None:
        """Fields of one row of a shard, by a read of that row alone; the keys of all groups that are read must agree."""
        self.catalog.require(ref)
        return self.frame(list(dict.fromkeys([*fields, "__shard_offset__"])), [ref], verify=True).where(F.col("__shard_offset__") == offset).first()

    def rows_at(self, probes: DataFrame, shards: DataFrame, fields: list[str], index: str = "i") -> DataFrame:
        """probes(i) with the fields of the sample at each global index; NULLs beyond the end.  One job for any number of probes."""
        at = ix.lookup_by_index(probes, shards, index).join(shards.select("shard_id", "partition", "shard"), "shard_id", "left").withColumnRenamed("offset", "__at")
        return self.joined_at(at, probes.columns, fields)

    def rows_of(self, probes: DataFrame, files: DataFrame, shards: DataFrame, fields: list[str], key: str = "key") -> DataFrame:
        """probes(key) with the fields of the sample that has the key; keys that the index lacks vanish."""
        file, segment = dataset_key(F.col(key), self.segmented)
        found = ix.lookup_by_key(probes.withColumn("file", file).withColumn("segment", segment), files, shards)
        at = found.join(shards.select("shard_id", "partition", "shard"), "shard_id").withColumnRenamed("offset", "__at")
        return self.joined_at(at, probes.columns, fields)

    def joined_at(self, at: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
        data = self.frame([*[f for f in fields if f not in SPECIAL], "__partition__", "__shard__", "__shard_offset__"], verify=True)
        on = (at["partition"] == data["__partition__"]) & (at["shard"] == data["__shard__"]) & (at["__at"] == data["__shard_offset__"])
        return at.join(data, on, "left").select(*[at[c] for c in columns], *[data[f] for f in fields])

    def key_mismatches(self, left: str, right: str) -> DataFrame:
        """Positions at which two column groups have different keys."""
        sides = []
        for d in (left, right):
            names = [KEY, "__shard__", "__shard_offset__"]
            shards = [{"ok": True, "n": None, "partition": r[0], "shard": r[1], "key_path": path, "paths": {d: path}} for r, path in sorted(self.catalog.shards[d].items())]
            schema = StructType([self.schema[f] for f in names])
            options = {"columns": json.dumps([[KEY, d, KEY], ["__shard__"], ["__shard_offset__"]]), "shards": json.dumps(shards), "schema": json.dumps(schema.jsonValue())}
            sides.append(self.spark.read.format(FORMAT).options(**options).schema(schema).load())
        return misaligned_keys(*sides, key=KEY)

    def sample(self, key: str, fields: list[str]) -> Row | None:
        """One sample by its key, checked against the key of every column group that is read; by the index if there is one, else by a scan."""
        if self.index is None:
            return self.frame([KEY, *fields], verify=True).where(F.col(KEY) == key).first()
        found = self.locate(key)
        return found and self.row_at(found[0], found[1], [KEY, *fields])

    def random_sample(self) -> Sample:
        """One sample, each with the same chance."""
        return self[self.rng.randrange(len(self))]

    def random_samples(self, n: int = 1) -> Iterator[Sample]:
        for _ in range(n):
            yield self.random_sample()

    def __iter__(self) -> Iterator[Sample]:
        """Without end: from a random place to the end of its shard, then from another."""
        while len(self):
            first = self.random_sample()
            for offset in range(first.offset, self.row_count(first.ref)):
                yield Sample(self, first.ref, offset)

    # -- iteration

    def sequence(self, ref: tuple[str, str], fields: list[str], start: int = 0, n: int | None = None) -> Iterator[Row]:
        """Consecutive rows of one shard; the reader skips the batches before ``start``."""
        self.catalog.require(ref)
        rows = self.frame([*fields, "__shard_offset__"], [ref]).where(F.col("__shard_offset__") >= start)
        if n is not None:
            rows = rows.where(F.col("__shard_offset__") < start + n)
        yield from rows.orderBy("__shard_offset__").select(*map(quoted, fields)).toLocalIterator()

    def random_positions(self, n: int, seed: int | random.Random = 42) -> list[int]:
        """Global indices drawn with replacement."""
        rng = seed if isinstance(seed, random.Random) else random.Random(seed)
        total = len(self)
        return [rng.randrange(total) for _ in range(n)] if total else []

    def random_chunks(self, fields: list[str], n: int, seed: int = 42) -> Iterator[list[Row]]:
        """Without end: up to ``n`` consecutive rows from a random place, not beyond its shard."""
        rng, refs = random.Random(seed), self.catalog.shard_list()
        sizes = {r: self.row_count(r) for r in refs}
        total = sum(sizes.values())
        while total:
            at = rng.randrange(total)
            for ref in refs:
                if at < sizes[ref]:
                    yield list(self.sequence(ref, fields, at, n))
                    break
                at -= sizes[ref]

    def row_counts(self) -> dict[tuple[str, str], int]:
        """Rows of all shards: of the index, else from the footers, read by a Spark job."""
        if self.sizes is None:
            from shardloom.operators.validate import footers

            group = self.catalog.fields[KEY][0][0]
            rows = footers(self.spark, self.catalog, [group]).where("ok").select("partition", "shard", "n_rows")
            self.sizes_found = getattr(self, "sizes_found", None) or {(r["partition"], r["shard"]): r["n_rows"] for r in rows.toLocalIterator()}
            return self.sizes_found
        return self.sizes

    def row_count(self, ref: tuple[str, str]) -> int:
        return self.row_counts().get(ref, 0)

    def __len__(self) -> int:
        return sum(self.row_counts().values())

    def summary(self) -> str:
        spaced = lambda n: f"{n:,}".replace(",", " ")
        return f"{spaced(len(self.catalog.shards))} column groups, {spaced(len(self.catalog.shard_list()))} shards, {spaced(len(self))} samples"

    def stream(self, fields: list[str]) -> DataFrame:
        """A structured stream of the rows of shards as they appear."""
        places = {f: self.catalog.fields[f][0] for f in fields if f not in SPECIAL}
        dirs = {p[0]: str(self.catalog.root / p[0]) for p in places.values()}
        columns = [[f] if f in SPECIAL else [f, *places[f]] for f in fields]
        schema = StructType([self.schema[f] for f in fields])
        options = {"columns": json.dumps(columns), "dirs": json.dumps(dirs), "suffix": self.catalog.suffix, "schema": json.dumps(schema.jsonValue())}
        return self.spark.readStream.format(FORMAT).options(**options).schema(schema).load()
