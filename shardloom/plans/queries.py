"""Queries of the dataset operators over the driver's tables, with their SQL.

Roles: conversations are a segmented dataset (file = conversation, segment =
turn, 16 conversations a shard); documents a source dataset (shard = source);
labels a column group with gaps; the events of a user the segments of a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shardloom.functions import codecs, keys
from shardloom.operators import index as ix
from shardloom.operators import links, shards as sh
from shardloom.operators.shards import OFFSET, SHARD
from shardloom.shared import shared_path

QUERIES: dict = {}
SQL: dict[str, str] = {}

DOCS_SQL = "docs AS (SELECT *, source AS shard, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS off FROM documents)"
SEGMENTS_SQL = "seg AS (SELECT floor(conv_id / 16)::INT AS shard_id, 'conv' || conv_id AS file, turn AS segment, row_number() OVER (PARTITION BY floor(conv_id / 16) ORDER BY conv_id, turn) - 1 AS off, length(text) AS dur, role, text FROM conversations)"
FILES_SQL = SEGMENTS_SQL + ", files AS (SELECT file AS name, shard_id, min(off) AS foff, count(*) AS n_seg, sum(dur)::BIGINT AS dur FROM seg GROUP BY ALL)"
SHARDS_SQL = FILES_SQL + ", shards AS (SELECT shard_id, n, coalesce(sum(n) OVER (ORDER BY shard_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS go FROM (SELECT shard_id, count(*) AS n FROM seg GROUP BY shard_id))"


def query(sql: str | None = None, name: str | None = None):
    def add(function):
        at = name or function.__name__
        QUERIES[at] = function
        if sql:
            SQL[at] = sql
        return function

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d, *columns):
    df = table(spark, d, "documents")
    df = df.select("doc_id", "source", *columns) if columns else df
    return sh.with_shards(df, F.col("source"), [F.col("doc_id")])


def segments(spark, d, *columns):
    df = table(spark, d, "conversations")
    df = df.select(F.floor(F.col("conv_id") / 16).cast("int").alias("shard_id"), F.concat(F.lit("conv"), "conv_id").alias("file"), F.col("turn").alias("segment"), "conv_id", F.length("text").cast("bigint").alias("duration"), *columns)
    return sh.with_shards(df, F.col("shard_id"), [F.col("conv_id"), F.col("segment")]).withColumnRenamed(OFFSET, "offset").drop(SHARD)


def files(spark, d):
    found = ix.episodes(segments(spark, d).withColumnRenamed("shard_id", "shard"))
    return found.select(F.col("file").alias("name"), F.col("shard").alias("shard_id"), "offset", "n_segments", "duration")


def shard_table(spark, d):
    counted = table(spark, d, "conversations").groupBy(F.floor(F.col("conv_id") / 16).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n_samples"))
    return ix.running_offsets(counted, ["shard"]).select(F.col("shard").alias("shard_id"), "n_samples", "global_offset", F.col("shard").cast("string").alias("shard"))


def names(sql_alias: str, *columns: str) -> str:
    return ", ".join(f"{sql_alias}.{c}" for c in columns)


# -- keys


@query(f"WITH {SEGMENTS_SQL} SELECT shard_id, off AS \"offset\", file || '_' || lpad(segment::VARCHAR, 8, '0') AS key FROM seg")
def make_key(spark, d):
    return segments(spark, d).select("shard_id", "offset", keys.make_key(F.col("file"), F.col("segment")).alias("key"))


@query("SELECT 'conv' || conv_id AS file, turn AS segment FROM conversations")
def parse_key(spark, d):
    key = keys.make_key(F.concat(F.lit("conv"), "conv_id"), F.col("turn"))
    return table(spark, d, "conversations").select(key.alias("k")).select(keys.key_file(F.col("k")).alias("file"), keys.key_segment(F.col("k")).alias("segment"))


@query("SELECT source AS file, 'rawvad' AS kind, doc_id AS segment FROM documents")
def parse_key_two_parts(spark, d):
    key = keys.make_key(F.concat("source", F.lit("_rawvad")), F.col("doc_id"))
    file, kind, segment = keys.key_parts(F.col("k"))
    return table(spark, d, "documents").select(key.alias("k")).select(file.alias("file"), kind.alias("kind"), segment.alias("segment"))


@query("SELECT url, contains(url, '*') OR contains(url, '?') OR contains(url, '[') AS magic FROM pages")
def has_magic(spark, d):
    return table(spark, d, "pages").select("url", keys.has_magic(F.col("url")).alias("magic"))


# -- selection


@query("SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * l_tax AS tax FROM lineitem")
def select_exprs(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_extendedprice * (1 - l_discount) AS net", "l_extendedprice * l_tax AS tax")


@query("SELECT doc_id, n_chars FROM documents WHERE text ILIKE '%the%' AND n_chars > 500")
def filter_ilike(spark, d):
    return table(spark, d, "documents").where("CAST(text AS string) ILIKE '%the%' AND n_chars > 500").select("doc_id", "n_chars")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality < 1 AND d.doc_id IS NOT NULL")
def filter_numeric_keys(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.where("quality < 1").where("doc_id IS NOT NULL").select("doc_id")


@query(f"WITH {DOCS_SQL} SELECT doc_id, shard, off AS \"offset\" FROM docs")
def special_columns(spark, d):
    return documents(spark, d, "lang").select("doc_id", F.col(SHARD).alias("shard"), F.col(OFFSET).alias("offset"))


@query(f"WITH {DOCS_SQL} SELECT docs.shard, off AS \"offset\", doc_id, n_chars, quality, toxic FROM docs LEFT JOIN labels USING (doc_id)")
def zip_column_dirs(spark, d):
    docs = documents(spark, d, "n_chars")
    other = docs.join(table(spark, d, "labels"), "doc_id", "left").select(SHARD, OFFSET, "quality", "toxic")
    return sh.zip_columns(docs, other).select(F.col(SHARD).alias("shard"), F.col(OFFSET).alias("offset"), "doc_id", "n_chars", "quality", "toxic")


@query(f"WITH {DOCS_SQL} SELECT shard, off AS \"offset\", CASE WHEN shard <> 'src3' THEN doc_id END AS doc_id, CASE WHEN shard <> 'src3' THEN n_chars END AS n_chars FROM docs")
def missing_shard_nullfill(spark, d):
    docs = documents(spark, d, "n_chars").select(SHARD, OFFSET, "doc_id", "n_chars")
    sizes = table(spark, d, "documents").groupBy(F.col("source").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    filled = sh.null_fill(sizes, docs, F.col("shard") == "src3")
    return filled.select(F.col(SHARD).alias("shard"), F.col(OFFSET).alias("offset"), "doc_id", "n_chars")


@query(f"WITH {DOCS_SQL} SELECT shard, off AS \"offset\", doc_id FROM docs WHERE shard <> 'src3'")
def missing_shard_skip(spark, d):
    return documents(spark, d, "lang").where(F.col("source") != "src3").select(F.col(SHARD).alias("shard"), F.col(OFFSET).alias("offset"), "doc_id")


@query("SELECT source AS shard, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(doc_id) AS least FROM documents GROUP BY source")
def per_shard_agg(spark, d):
    df = table(spark, d, "documents").withColumn(SHARD, F.col("source"))
    return sh.per_shard_agg(df, F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("least")).withColumnRenamed(SHARD, "shard")


@query(f"WITH {DOCS_SQL} SELECT doc_id, n_chars - lag(n_chars) OVER (PARTITION BY shard ORDER BY off) AS step FROM docs")
def per_shard_lag(spark, d):
    return documents(spark, d, "n_chars").select("doc_id", (F.col("n_chars") - F.lag("n_chars").over(sh.per_shard_window())).alias("step"))


@query(f"WITH {DOCS_SQL} SELECT shard, doc_id, sum(n_chars) OVER (PARTITION BY shard ORDER BY off ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM docs")
def shard_pipe(spark, d):
    import pyarrow as pa
    import pyarrow.compute as pc

    def running(t: pa.Table) -> pa.Table:
        return pa.table({"shard": t.column(SHARD), "doc_id": t.column("doc_id"), "upto": pc.cumulative_sum(t.column("n_chars"))})

    return sh.shard_pipe(documents(spark, d, "n_chars").select(SHARD, OFFSET, "doc_id", "n_chars"), running, "shard string, doc_id long, upto long")


# -- index


@query(f"WITH {FILES_SQL} SELECT name, shard_id, foff AS \"offset\", n_seg AS n_segments, dur AS duration FROM files")
def episodes(spark, d):
    return files(spark, d)


@query(f"WITH {SHARDS_SQL} SELECT shard_id, n AS n_samples, go AS global_offset FROM shards")
def shard_index(spark, d):
    found = ix.shard_index(files(spark, d).select(F.col("shard_id").alias("shard"), "n_segments"), segmented=True)
    return found.select(F.col("shard").alias("shard_id"), "n_samples", "global_offset")


@query("SELECT event_id, len(x)::INT AS n, round(list_sum(x), 6) AS total FROM (SELECT event_id, list_concat([value, value * 2], list_resize([]::DOUBLE[], (event_id % 3)::BIGINT, 0.0::DOUBLE)) AS x FROM events)")
def pad_right(spark, d):
    """Samples with zeros up to a length, summed and counted."""
    padded = keys.pad_right(F.array(F.col("value"), F.col("value") * 2), 2 + F.col("event_id") % 3)
    df = table(spark, d, "events").select("event_id", padded.alias("x"))
    return df.select("event_id", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(f"WITH {SHARDS_SQL} SELECT (SELECT count(*) FROM shards) AS n_shards, (SELECT sum(n) FROM shards)::BIGINT AS n_samples, count(*) AS n_files, sum(dur)::BIGINT AS audio_duration, sum(dur)::BIGINT AS speech_duration FROM files")
def index_totals(spark, d):
    f = files(spark, d).withColumn("audio_duration", F.col("duration")).withColumn("speech_duration", F.col("duration"))
    return ix.totals(f, shard_table(spark, d))


@query(f"WITH {SHARDS_SQL}, p AS (SELECT event_id AS i FROM events) SELECT i, shard_id, i - go AS \"offset\" FROM p LEFT JOIN shards ON i >= go AND i < go + n")
def lookup_by_index(spark, d):
    return ix.lookup_by_index(table(spark, d, "events").select(F.col("event_id").alias("i")), shard_table(spark, d))


@query(f"WITH {SHARDS_SQL} SELECT name AS file, turn AS segment, shard_id, foff + turn AS \"offset\", go + foff + turn AS global_offset FROM (SELECT 'conv' || conv_id AS file, turn FROM conversations) c JOIN files ON c.file = files.name AND turn < n_seg JOIN shards USING (shard_id)")
def lookup_by_key(spark, d):
    key = keys.make_key(F.concat(F.lit("conv"), "conv_id"), F.col("turn"))
    probes = table(spark, d, "conversations").select(key.alias("k")).select(keys.key_file(F.col("k")).alias("file"), keys.key_segment(F.col("k")).alias("segment"))
    return ix.lookup_by_key(probes, files(spark, d), shard_table(spark, d))


@query(f"WITH {SHARDS_SQL} SELECT name, shard_id::VARCHAR AS shard, foff AS \"offset\" FROM files")
def index_dump(spark, d):
    return ix.dump(files(spark, d), shard_table(spark, d))


@query(f"WITH {SHARDS_SQL} SELECT name, dur AS audio_duration, dur AS speech_duration, shard_id::VARCHAR AS shard, n AS n_samples FROM files JOIN shards USING (shard_id)")
def index_export(spark, d):
    f = files(spark, d).withColumn("audio_duration", F.col("duration")).withColumn("speech_duration", F.col("duration"))
    return ix.export(f, shard_table(spark, d))


@query(f"WITH {SHARDS_SQL}, f AS (SELECT name, shard_id, foff, dur FROM files) SELECT shard_id, n AS n_samples, go AS global_offset, count(*) AS n_files, min(name) AS first_name FROM f JOIN shards USING (shard_id) GROUP BY ALL")
def shard_attributes(spark, d):
    per = files(spark, d).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_files"), F.min("name").alias("first_name"))
    return per.join(shard_table(spark, d).select("shard_id", "n_samples", "global_offset"), "shard_id")


@query(f"WITH {FILES_SQL} SELECT name AS file, n_seg AS n_segments, dur AS duration, n_chars::DOUBLE AS audio_duration FROM files JOIN (SELECT 'conv' || doc_id AS src, n_chars FROM documents) ON name = src")
def source_duration_join(spark, d):
    sources = table(spark, d, "documents").select(F.concat(F.lit("conv"), "doc_id").alias("name"), F.col("n_chars").cast("double").alias("audio_duration"))
    return ix.with_source_durations(files(spark, d).select(F.col("name").alias("file"), "n_segments", "duration"), sources)


@query("SELECT name, min(batch)::INT AS batch, min_by(line, (batch, line)) AS line FROM (SELECT l_orderkey AS name, l_linenumber AS line, (l_linenumber > 3)::INT AS batch FROM lineitem) GROUP BY name")
def merge_unique_sort(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("line"))
    return ix.merge([lines.where("line <= 3"), lines.where("line > 3")], order=["line"]).select("name", "batch", "line")


@query(
    "WITH f AS (SELECT l_orderkey AS name, l_quantity AS duration, l_linenumber, l_partkey, first_value(l_quantity) OVER w AS first_duration, row_number() OVER w AS r FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) "
    "SELECT name, duration, first_duration, CASE WHEN abs(duration - first_duration) < 0.01 THEN 'skip' ELSE 'error' END AS action FROM f WHERE r > 1"
)
def duplicate_episodes(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_quantity").alias("duration"), *order)
    return ix.duplicate_files(lines, order).select("name", "duration", "first_duration", "action")


@query(
    f"WITH {SHARDS_SQL}, m AS (SELECT shard_id, name, foff, lead(foff, 1, n) OVER (PARTITION BY shard_id ORDER BY foff) - foff AS m FROM files JOIN shards USING (shard_id)), e AS (SELECT shard_id, name, foff, unnest(range(m)) AS s FROM m) "
    "SELECT shard_id, foff + s AS \"offset\", name || '_' || lpad(s::VARCHAR, 3, '0') AS key FROM e"
)
def expected_keys(spark, d):
    return ix.expected_keys(files(spark, d), shard_table(spark, d))


@query("SELECT file, bool_and(step = 1) AS consecutive, count(*) AS n_segments FROM (SELECT 'conv' || conv_id AS file, coalesce(turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), 1) AS step FROM conversations) GROUP BY file")
def consecutive_segments(spark, d):
    return ix.episode_stats(segments(spark, d).select("file", "segment", F.col("segment").alias("position")))


@query(
    "WITH s AS (SELECT doc_id::VARCHAR AS file FROM documents), a AS (SELECT conv_id::VARCHAR AS file, bool_and(step = 1) AS c, count(*) AS n FROM (SELECT conv_id, coalesce(turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), 1) AS step FROM conversations) GROUP BY 1) "
    "SELECT coalesce(s.file, a.file) AS file, c AS consecutive_turns, n AS n_segments_turns FROM s FULL JOIN a ON s.file = a.file"
)
def diff_keys(spark, d):
    stats = ix.episode_stats(table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("segment"), F.col("turn").alias("position")))
    return ix.diff_keys(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file")), {"turns": stats})


@query(f"WITH {DOCS_SQL}, b AS (SELECT shard, off, CASE WHEN off % 7 = 3 THEN doc_id + 1 ELSE doc_id END AS k FROM docs WHERE off % 11 <> 5) SELECT a.shard, a.off AS \"offset\", a.doc_id AS left_key, b.k AS right_key FROM docs a FULL JOIN b ON a.shard = b.shard AND a.off = b.off WHERE a.doc_id IS DISTINCT FROM b.k")
def key_alignment(spark, d):
    docs = documents(spark, d, "lang").select(SHARD, OFFSET, F.col("doc_id").alias("__key__"))
    other = docs.where(f"{OFFSET} % 11 <> 5").withColumn("__key__", F.when(F.col(OFFSET) % 7 == 3, F.col("__key__") + 1).otherwise(F.col("__key__")))
    return sh.misaligned_keys(docs, other).select(F.col(SHARD).alias("shard"), F.col(OFFSET).alias("offset"), "left_key", "right_key")


# -- links


def user_spans(spark, d):
    """user -> array of (tstart, tend), sorted: the segments of a file."""
    when = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    span = F.struct(when.alias("tstart"), (when + F.col("value")).alias("tend"))
    return table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("file")).agg(F.array_sort(F.collect_list(span)).alias("vad"))


@query(
    "WITH e AS (SELECT user_id::VARCHAR AS file, epoch_us(ts) / 1e6 AS tstart, epoch_us(ts) / 1e6 + value AS tend, row_number() OVER (PARTITION BY user_id ORDER BY ts, epoch_us(ts) / 1e6 + value) - 1 AS segment FROM events) "
    "SELECT c.conv_id::VARCHAR AS file, c.turn AS segment, e.tstart, e.tend FROM conversations c LEFT JOIN e ON e.file = c.conv_id::VARCHAR AND e.segment = c.turn"
)
def segment_link(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("segment"))
    return links.build({"loader": "segment", "vad_column": "vad"}, rows, user_spans(spark, d))


@query("SELECT user_id::VARCHAR AS file, round(sum((epoch_us(ts) / 1e6 + value) - epoch_us(ts) / 1e6), 3) AS seconds FROM events GROUP BY user_id")
def vad_speech_seconds(spark, d):
    pairs = F.transform("vad", lambda s: F.array(s["tstart"], s["tend"]))
    return user_spans(spark, d).select("file", F.round(keys.speech_seconds(pairs), 3).alias("seconds"))


@query("SELECT l_orderkey AS file, l_linenumber, o_orderstatus AS src_o_orderstatus, o_totalprice AS src_o_totalprice FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def prefix_link(spark, d):
    source = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), "o_orderstatus", "o_totalprice")
    return links.build({"loader": "prefix", "key_prefix": "src_"}, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), "l_linenumber"), source)


@query("SELECT page_id, regexp_extract(url, '([0-9]+)', 1) AS video_id, 'https://www.youtube.com/watch?v=' || regexp_extract(url, '([0-9]+)', 1) || '&t=' || (page_id % 5)::VARCHAR || 's' AS url FROM pages")
def regex_link(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.col("url").alias("file"), (F.col("page_id") % 5).alias("segment"))
    source = rows.select("file", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.array(i.cast("double"), i + 0.5)).alias("vad")).distinct()
    return links.build({"loader": "video", "youtube_id_regexp": "([0-9]+)"}, rows, source).select("page_id", "video_id", "url")


@query("SELECT doc_id, coalesce(quality, toxic, -1) AS first FROM documents LEFT JOIN labels USING (doc_id)")
def failover(spark, d):
    df = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return df.select("doc_id", F.coalesce(links.first_available(df, ["absent", "quality", "toxic"]), F.lit(-1)).alias("first"))


@query(f"WITH {DOCS_SQL}, f AS (SELECT doc_id, toxic = 1 AS flag FROM labels) SELECT documents.doc_id AS global_offset, lang, flag AS clean FROM documents LEFT JOIN f USING (doc_id)")
def overlay_filter(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("global_offset"), "lang")
    return ix.overlay(rows, table(spark, d, "labels").select(F.col("doc_id").alias("global_offset"), (F.col("toxic") == 1).alias("flag")), "clean")


@query("SELECT count_if(toxic = 1)::BIGINT AS support, count(*) AS n FROM labels")
def overlay_support(spark, d):
    return table(spark, d, "labels").agg(F.count_if(F.col("toxic") == 1).alias("support"), F.count(F.lit(1)).alias("n"))


# -- sets


@query("SELECT d.doc_id, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_semi")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id AS id FROM documents UNION ALL SELECT conv_id FROM conversations")
def union_all(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")).unionByName(table(spark, d, "conversations").select(F.col("conv_id").alias("id")))


@query("SELECT doc_id AS id FROM documents UNION SELECT conv_id FROM conversations")
def set_union(spark, d):
    return union_all(spark, d).distinct()


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query(
    "WITH p AS (SELECT DISTINCT lang AS dir, source AS shard FROM documents WHERE n_chars > 9000), u AS (SELECT DISTINCT shard FROM p), g AS (SELECT dirs.dir, u.shard, p.shard IS NOT NULL AS here FROM (VALUES ('en'), ('de'), ('fr'), ('es')) dirs(dir) CROSS JOIN u LEFT JOIN p ON p.dir = dirs.dir AND p.shard = u.shard) "
    "SELECT dir, count_if(here)::BIGINT AS n_present, count_if(NOT here)::BIGINT AS n_missing, CASE WHEN bool_and(here) THEN 'COMPLETE' ELSE 'MISSING ' || count_if(NOT here) END AS state FROM g GROUP BY dir"
)
def missing_matrix(spark, d):
    return sh.missing_matrix(table(spark, d, "documents").where("n_chars > 9000").select(F.col("lang").alias("dir"), F.col("source").alias("shard")), ["en", "de", "fr", "es"])


# -- order, top, sampling


@query(f"WITH {DOCS_SQL} SELECT shard, off AS \"offset\", doc_id FROM docs WHERE off >= 5 AND off < 12")
def chunk(spark, d):
    """Up to 7 consecutive rows from the sixth of every shard."""
    return documents(spark, d, "lang").where((F.col(OFFSET) >= 5) & (F.col(OFFSET) < 12)).select(F.col(SHARD).alias("shard"), F.col(OFFSET).alias("offset"), "doc_id")


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def head(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").orderBy("doc_id").limit(5)


@query("WITH e AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS r FROM e) SELECT vec_id, i - 1 AS place, v AS value FROM r WHERE r <= 10")
def top_columns(spark, d):
    """The ten largest of the 64 columns of each row."""
    pair = F.transform("embedding", lambda v, i: F.struct((-v.cast("double")).alias("n"), i.cast("bigint").alias("place")))
    top = F.explode(F.slice(F.array_sort(pair), 1, 10))
    return table(spark, d, "embeddings").select("vec_id", top.alias("t")).select("vec_id", F.col("t.place").alias("place"), (-F.col("t.n")).alias("value"))


@query("SELECT conv_id, turn, md5('42:' || conv_id || ':' || turn) AS draw FROM conversations ORDER BY draw LIMIT 50")
def shuffle_topn(spark, d):
    """A seeded sample of 50 keys in shuffled order."""
    draw = F.md5(F.concat(F.lit("42:"), "conv_id", F.lit(":"), "turn").cast("binary"))
    return table(spark, d, "conversations").select("conv_id", "turn", draw.alias("draw")).orderBy("draw").limit(50)


@query(f"WITH {SHARDS_SQL}, t AS (SELECT sum(n)::BIGINT AS total FROM shards), p AS (SELECT event_id, ('0x' || substr(md5('42:' || event_id), 1, 12))::BIGINT % total AS i FROM events, t) SELECT event_id, i, shard_id, i - go AS \"offset\" FROM p LEFT JOIN shards ON i >= go AND i < go + n")
def random_samples(spark, d):
    """One draw with replacement for every event: a seeded global index and its place."""
    shards = shard_table(spark, d)
    total = shards.agg(F.sum("n_samples").alias("total"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("42:"), "event_id").cast("binary")), 1, 12), 16, 10).cast("bigint")
    probes = table(spark, d, "events").select("event_id").crossJoin(F.broadcast(total)).select("event_id", (draw % F.col("total")).alias("i"))
    return ix.lookup_by_index(probes, shards)


@query("WITH s AS (SELECT DISTINCT source FROM documents), c AS (SELECT source FROM (SELECT source, row_number() OVER (ORDER BY md5('42:' || source)) AS r, count(*) OVER () AS n FROM s) WHERE r <= greatest(1, n // 4)) SELECT doc_id, source FROM documents JOIN c USING (source)")
def shard_subsample(spark, d):
    """All rows of a seeded quarter of the shards."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    every = docs.select("source").distinct().withColumn("draw", F.md5(F.concat(F.lit("42:"), "source").cast("binary")))
    ranked = every.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("draw"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    return docs.join(ranked.where("r <= greatest(1, n div 4)").select("source"), "source", "left_semi")


# -- scalars and codecs


@query("SELECT doc_id, CASE WHEN h > 1e6 THEN printf('%.2f M hours', h / 1e6) WHEN h > 1000 THEN printf('%.2f k hours', h / 1000) WHEN h < 1 THEN printf('%.1f minutes', h * 60) ELSE printf('%.2f hours', h) END AS duration FROM (SELECT doc_id, n_chars / 977.0::DOUBLE AS h FROM documents)")
def format_duration(spark, d):
    return table(spark, d, "documents").select("doc_id", keys.format_duration(F.col("n_chars") / F.lit(977.0)).alias("duration"))


@query("SELECT event_id, greatest(0.0, value - 2.5) AS tstart, value + 10 + 1.5 AS tend, value + 10 - value AS length FROM events")
def segment_context(spark, d):
    start, end = F.col("value"), F.col("value") + 10
    first, last = keys.with_context(start, end, 2.5, 1.5)
    return table(spark, d, "events").select("event_id", first.alias("tstart"), last.alias("tend"), keys.segment_duration(start, end).alias("length"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 0.0 END, value) AS tstart, coalesce(CASE WHEN event_id % 5 = 0 THEN 99.0 END, value + 10) AS tend FROM events")
def with_timestamps(spark, d):
    i = F.col("event_id")
    start, end = keys.with_timestamps(F.col("value"), F.col("value") + 10, F.when(i % 3 == 0, 0.0), F.when(i % 5 == 0, 99.0))
    return table(spark, d, "events").select("event_id", start.alias("tstart"), end.alias("tend"))


@query("SELECT event_id, round(value * 16000)::BIGINT + CASE WHEN value > 0 THEN 1105 ELSE 0 END AS first, 16000 * 10::BIGINT AS n FROM events")
def sample_range(spark, d):
    first, n = keys.sample_range(F.col("value"), F.col("value") + 10, 16000, 1105)
    return table(spark, d, "events").select("event_id", first.alias("first"), n.alias("n"))


@query("SELECT doc_id, coalesce(nullif(quality, 0), nullif(toxic, 0), -1) AS duration FROM documents LEFT JOIN labels USING (doc_id)")
def duration_falsy(spark, d):
    df = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return df.select("doc_id", keys.known_duration(F.col("quality"), F.col("toxic")).alias("duration"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def decode_json(spark, d):
    cell = codecs.decode("props.json", F.encode("props", "utf-8"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(cell, "$.k", "bigint").alias("k"))


@query("SELECT vec_id, round(list_sum(embedding)::DOUBLE, 4) AS total, len(embedding)::INT AS n FROM embeddings")
def npy_roundtrip(spark, d):
    cell = codecs.decode("vec.npy", codecs.encode("vec.npy", F.col("embedding").cast("array<double>"), "array<double>"), dims=1)
    df = table(spark, d, "embeddings").select("vec_id", cell.alias("x"))
    return df.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.size("x").alias("n"))


@query("SELECT vec_id, round(list_sum(embedding)::DOUBLE, 4) AS total, list_max(embedding)::DOUBLE AS top FROM embeddings")
def array_aggregate(spark, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(total, 4).alias("total"), F.array_max("embedding").cast("double").alias("top"))


@query("SELECT doc_id, octet_length(encode(text))::INT AS n_bytes, text IS NULL AS none, CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...' ELSE text END AS short FROM documents")
def cell_views(spark, d):
    """Byte sizes, null masks and shortened texts."""
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"), F.isnull("text").alias("none"), keys.short_text(F.col("text")).alias("short"))


@query("SELECT page_id, substr(url, 5, 12) AS part FROM pages")
def byte_range(spark, d):
    return table(spark, d, "pages").select("page_id", keys.byte_range(F.encode("url", "utf-8"), 4, 16).cast("string").alias("part"))


@query("SELECT event_id::INT AS event_id, value::REAL AS value, event_type FROM events")
def storage_cast(spark, d):
    return keys.cast_for_storage(table(spark, d, "events").select("event_id", "value", "event_type"))


@query(
    "SELECT p_partkey, abs(p_size - 25) AS a, ceil(p_retailprice)::BIGINT AS c, floor(p_retailprice)::BIGINT AS f, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, p_size % 7 AS m, p_size // 7 AS q, xor(p_size & 6, 3) AS b, upper(p_brand) AS u, left(p_name, 4) AS lf, right(p_name, 4) AS rt, length(p_type) AS n, replace(p_type, ' ', '-') AS r, reverse(p_brand) AS rv, "
    "instr(p_type, 'T') AS i, split_part(p_type, ' ', 2) AS sp, starts_with(p_name, 'p') AS sw, regexp_matches(p_type, '^[A-Z]+') AS rx, nullif(p_size, 1) AS ni, greatest(p_size, 10) AS g, try_cast(p_name AS INT) AS tc, concat_ws('/', p_brand, p_type) AS cw FROM part"
)
def scalar_surface(spark, d):
    return table(spark, d, "part").selectExpr(
        "p_partkey", "abs(p_size - 25) AS a", "CAST(ceil(p_retailprice) AS BIGINT) AS c", "CAST(floor(p_retailprice) AS BIGINT) AS f", "round(sqrt(p_retailprice), 6) AS s", "round(ln(p_retailprice), 6) AS l", "p_size % 7 AS m", "CAST(p_size div 7 AS INT) AS q", "(p_size & 6) ^ 3 AS b",
        "upper(p_brand) AS u", "left(p_name, 4) AS lf", "right(p_name, 4) AS rt", "CAST(length(p_type) AS BIGINT) AS n", "replace(p_type, ' ', '-') AS r", "reverse(p_brand) AS rv", "CAST(instr(p_type, 'T') AS BIGINT) AS i", "split_part(p_type, ' ', 2) AS sp", "startswith(p_name, 'p') AS sw", "regexp_like(p_type, '^[A-Z]+') AS rx",
        "nullif(p_size, 1) AS ni", "greatest(p_size, 10) AS g", "try_cast(p_name AS INT) AS tc", "concat_ws('/', p_brand, p_type) AS cw",
    )


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, strftime(o_orderdate, '%Y-%m-%d') AS day, date_trunc('month', o_orderdate)::DATE AS month, strptime('2000-01-02', '%Y-%m-%d')::DATE AS fixed FROM orders")
def temporal_surface(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey", "CAST(date_part('YEAR', o_orderdate) AS INT) AS y", "CAST(extract(MONTH FROM o_orderdate) AS INT) AS m", "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "CAST(date_trunc('month', o_orderdate) AS DATE) AS month", "CAST(to_timestamp('2000-01-02', 'yyyy-MM-dd') AS DATE) AS fixed")


@query(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS avg_quantity, min(l_tax) AS least_tax, max(l_tax) AS most_tax, median(l_quantity) AS median_quantity, round(stddev_samp(l_quantity), 6) AS sd, round(corr(l_quantity, l_extendedprice), 6) AS r, quantile_cont(l_quantity, 0.9) AS p90, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL"
)
def weighted_revenue(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity"), F.min("l_tax").alias("least_tax"), F.max("l_tax").alias("most_tax"), F.median("l_quantity").alias("median_quantity"),
        F.round(F.stddev("l_quantity"), 6).alias("sd"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.percentile("l_quantity", 0.9).alias("p90"), F.count_distinct("l_suppkey").alias("suppliers"),
    )


# -- shard files


def written(spark, d, damage=None):
    """documents as shard files of two column groups, whole texts included; (dataset, reports).  ``damage`` changes the keys of the second group."""
    from shardloom.plans.dataset import Dataset
    from shardloom.sources.sink import write_shards

    root = shared_path(spark, "shards").removeprefix("file:").replace("///", "/")
    docs = documents(spark, d, "text", "lang", "n_chars").withColumn("__key__", F.col("doc_id").cast("string"))
    key = {"text": F.col("__key__"), "size": F.col("__key__") if damage is None else damage}
    reports = [write_shards(docs.select(SHARD, OFFSET, key[name].alias("__key__"), *columns), root, name) for name, columns in (("text", ["text", "lang"]), ("size", ["n_chars"]))]
    return Dataset(spark, root), reports


@query(f"WITH {DOCS_SQL} SELECT doc_id::VARCHAR AS key, shard, off AS \"offset\", lang, n_chars * 2 AS twice, md5(text) AS digest FROM docs")
def arrow_roundtrip(spark, d):
    """Written as shards of two column groups, and read again with their columns zipped."""
    data, _ = written(spark, d)
    return data.select("__key__ AS key", "__shard__ AS shard", "__shard_offset__ AS offset", "lang", "n_chars * 2 AS twice", "md5(text) AS digest")


@query("SELECT doc_id::VARCHAR AS __key__ FROM documents WHERE n_chars > 3000 AND lang = 'en'")
def dataset_filter(spark, d):
    data, _ = written(spark, d)
    return data.where_keys("n_chars > 3000 AND lang = 'en'")


@query("SELECT source AS shard, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def dataset_per_shard(spark, d):
    data, _ = written(spark, d)
    return data.select("count(1) AS n", "sum(n_chars) AS chars", per_shard=True).select(F.col("__shard__").alias("shard"), "n", "chars")


@query("SELECT dir, count(DISTINCT source)::BIGINT AS n FROM documents, (VALUES ('size'), ('text')) v(dir) GROUP BY dir")
def schema_groups(spark, d):
    from shardloom.operators import validate

    data, _ = written(spark, d)
    return validate.schema_groups(validate.footers(spark, data.catalog)).select("dir", "n")


@query("SELECT source AS shard, dir, count(*) AS n_rows, true AS even FROM documents, (VALUES ('size'), ('text')) v(dir) GROUP BY ALL")
def shard_footers(spark, d):
    """Rows of each shard file, and whether all its batches but the last are full."""
    from shardloom.operators import validate

    data, _ = written(spark, d)
    return validate.footers(spark, data.catalog).select("shard", "dir", "n_rows", "even")


@query("WITH s AS (SELECT source AS shard, count(*) AS n FROM documents GROUP BY source) SELECT shard, n AS n_samples, coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS global_offset FROM s")
def build_index(spark, d):
    """The index made from the keys of all shard files."""
    data, _ = written(spark, d)
    return data.build_index()[1].select("shard", "n_samples", "global_offset")


@query("SELECT source AS shard, count(*) AS n_rows FROM documents GROUP BY source")
def write_report(spark, d):
    """The sink's report of one column group, with keys checked against its sibling."""
    from shardloom.sources.sink import write_shards

    docs = documents(spark, d, "text", "lang").withColumn("__key__", F.col("doc_id").cast("string")).select(SHARD, OFFSET, "__key__", "text", "lang")
    root = shared_path(spark, "shards").removeprefix("file:").replace("///", "/")
    return write_shards(docs, root, "text", sibling=docs.select(SHARD, OFFSET, "__key__")).select("shard", "n_rows")


PLACED_SQL = "shards AS (SELECT source, coalesce(sum(count(*)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS go FROM documents GROUP BY source), placed AS (SELECT docs.*, go + off AS i FROM docs JOIN shards USING (source))"


@query("SELECT doc_id::VARCHAR AS key, lang, n_chars FROM documents")
def sample_by_key(spark, d):
    """Every document by its key, and keys that nothing has, through the index; keys of both column groups agree."""
    data, _ = written(spark, d)
    key = F.col("doc_id").cast("string")
    probes = table(spark, d, "documents").select(F.explode(F.array(key, F.concat(F.lit("no"), key))).alias("key"))
    return data.rows_of(probes, *data.build_index(), ["lang", "n_chars"])


@query(f"WITH {DOCS_SQL}, {PLACED_SQL}, t AS (SELECT count(*) + 9 AS n FROM documents) SELECT event_id, event_id % n AS i, doc_id::VARCHAR AS key, lang, n_chars FROM events, t LEFT JOIN placed ON placed.i = event_id % n")
def sample_by_index(spark, d):
    """The sample at an index for each event; NULLs beyond the end."""
    data, _ = written(spark, d)
    _, shards = data.build_index()
    probes = table(spark, d, "events").select("event_id", (F.col("event_id") % (len(data) + 9)).alias("i"))
    found = data.rows_at(probes, shards, ["__key__", "lang", "n_chars"])
    return found.withColumnRenamed("__key__", "key")


@query(f"WITH {DOCS_SQL}, {PLACED_SQL} SELECT doc_id::VARCHAR AS name, source AS shard, off AS \"offset\", i FROM placed")
def index_roundtrip(spark, d):
    """The index stored, opened again and asked by SQL."""
    data, _ = written(spark, d)
    data.write_index(shared_path(spark, "index"))
    return data.index_sql("SELECT name, shard, offset, global_offset + offset AS i FROM {files} JOIN {shards} USING (shard_id)")


@query(f"WITH {DOCS_SQL} SELECT source AS shard, off AS \"offset\", doc_id::VARCHAR AS left_key, 'x' || doc_id AS right_key FROM docs WHERE doc_id % 97 = 0")
def key_mismatch(spark, d):
    """Where two column groups have different keys."""
    key = F.col("doc_id").cast("string")
    data, _ = written(spark, d, F.when(F.col("doc_id") % 97 == 0, F.concat(F.lit("x"), key)).otherwise(key))
    return data.key_mismatches("text", "size").select(F.col(SHARD).alias("shard"), F.col(OFFSET).alias("offset"), "left_key", "right_key")


@query(f"WITH {DOCS_SQL}, {PLACED_SQL} SELECT source AS shard, count(*) AS n, max(off) AS last_offset FROM placed GROUP BY source")
def index_sql(spark, d):
    """Any SQL over the index of a dataset."""
    data, _ = written(spark, d)
    data.write_index(shared_path(spark, "index"))
    return data.index_sql("SELECT shard, count(*) AS n, max(offset) AS last_offset FROM {files} JOIN {shards} USING (shard_id) GROUP BY shard")


@query(
    "SELECT p_partkey, round(cbrt(p_size), 6) AS cb, round(exp(p_size / 50.0::DOUBLE), 6) AS ex, round(log2(p_size), 6) AS l2, round(log10(p_size), 6) AS l10, round(ln(1 + p_size), 6) AS l1, round(pow(p_size, 0.5::DOUBLE), 6) AS pw, sign(p_size - 25)::INT AS sg, round(pi(), 6) AS p, "
    "round(sin(p_size), 6) AS si, round(cos(p_size), 6) AS co, round(tan(p_size), 6) AS ta, round(asin(p_size / 100.0::DOUBLE), 6) AS asi, round(acos(p_size / 100.0::DOUBLE), 6) AS aco, round(atan(p_size), 6) AS ata, round(atan2(p_size, 7), 6) AS a2, round(degrees(p_size), 6) AS de, round(radians(p_size), 6) AS ra, bit_count(p_size)::INT AS bc, "
    "bit_length(p_name)::INT AS bl, ltrim('  ' || p_name) AS lt, rtrim(p_name || '  ') AS rt, ends_with(p_name, '1') AS ew, regexp_matches(p_name, '[0-5]$') AS rl, len(string_split(p_type, ' '))::INT AS ns, list_contains(string_split(p_type, ' '), 'TIN') AS ac, "
    "len(list_distinct(string_split(p_type, ' ')))::INT AS ad, array_to_string(list_reverse(string_split(p_type, ' ')), '|') AS ar, ifnull(nullif(p_size, 1), 0) AS nu, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, repeat(left(p_brand, 2), 3) AS re, ascii(p_brand) AS asc_, lower(p_type) AS lo, trim('  ' || p_type || ' ') AS tr, least(p_size, 9) AS le FROM part"
)
def scalar_surface_2(spark, d):
    return table(spark, d, "part").selectExpr(
        "p_partkey", "round(cbrt(p_size), 6) AS cb", "round(exp(p_size / 50D), 6) AS ex", "round(log2(p_size), 6) AS l2", "round(log10(p_size), 6) AS l10", "round(log1p(p_size), 6) AS l1", "round(pow(p_size, 0.5D), 6) AS pw", "CAST(sign(p_size - 25) AS INT) AS sg", "round(pi(), 6) AS p",
        "round(sin(p_size), 6) AS si", "round(cos(p_size), 6) AS co", "round(tan(p_size), 6) AS ta", "round(asin(p_size / 100D), 6) AS asi", "round(acos(p_size / 100D), 6) AS aco", "round(atan(p_size), 6) AS ata", "round(atan2(p_size, 7), 6) AS a2", "round(degrees(p_size), 6) AS de", "round(radians(p_size), 6) AS ra", "bit_count(p_size) AS bc",
        "bit_length(p_name) AS bl", "ltrim('  ' || p_name) AS lt", "rtrim(p_name || '  ') AS rt", "endswith(p_name, '1') AS ew", "rlike(p_name, '[0-5]$') AS rl", "size(split(p_type, ' ')) AS ns", "array_contains(split(p_type, ' '), 'TIN') AS ac",
        "size(array_distinct(split(p_type, ' '))) AS ad", "array_join(reverse(split(p_type, ' ')), '|') AS ar", "ifnull(nullif(p_size, 1), 0) AS nu", "lpad(p_brand, 12, '*') AS lp", "rpad(p_brand, 12, '*') AS rp", "repeat(left(p_brand, 2), 3) AS re", "ascii(p_brand) AS asc_", "lower(p_type) AS lo", "trim('  ' || p_type || ' ') AS tr", "least(p_size, 9) AS le",
    )


@query(
    "SELECT l_returnflag, round(variance(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp, round(stddev_pop(l_tax), 6) AS sp, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(covar_pop(l_quantity, l_tax), 6) AS cp, quantile_disc(l_quantity, 0.25) AS q25, bool_and(l_tax >= 0) AS ba, bool_or(l_tax > 0.07) AS bo, bit_or(l_linenumber)::INT AS bitor, "
    "bit_and(l_linenumber)::INT AS bitand, bit_xor(l_linenumber)::INT AS bitxor, count(*) FILTER (WHERE l_tax > 0.05) AS nf, approx_count_distinct(l_returnflag) AS acd FROM lineitem GROUP BY l_returnflag"
)
def aggregate_surface(spark, d):
    return spark.sql(
        "SELECT l_returnflag, round(variance(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp, round(stddev_pop(l_tax), 6) AS sp, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(covar_pop(l_quantity, l_tax), 6) AS cp, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q25, bool_and(l_tax >= 0) AS ba, bool_or(l_tax > 0.07) AS bo, bit_or(l_linenumber) AS bitor, "
        "bit_and(l_linenumber) AS bitand, bit_xor(l_linenumber) AS bitxor, count(*) FILTER (WHERE l_tax > 0.05) AS nf, approx_count_distinct(l_returnflag) AS acd FROM {lineitem} GROUP BY l_returnflag",
        lineitem=table(spark, d, "lineitem"),
    )
