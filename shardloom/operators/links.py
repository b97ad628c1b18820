"""Columns that come from another dataset: segment, prefixed and video links, and failover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

REGISTRY: dict[str, Callable] = {}


def loader(name: str):
    """Register a link builder (segments, link, source) -> DataFrame; only registered names can be loaded."""

    def add(function: Callable) -> Callable:
        REGISTRY[name] = function
        return function

    return add


def alias(other: str, name: str) -> None:
    """Let link files that call a loader ``other`` use the one registered as ``name``."""
    REGISTRY[other] = REGISTRY[name]


def build(link: dict, segments: DataFrame, source: DataFrame) -> DataFrame:
    name = link.get("loader")
    name = name[-1] if isinstance(name, (list, tuple)) else name
    if name not in REGISTRY:
        raise ValueError(f"no link loader is registered as {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](segments, link, source)


@loader("segment")
def segment_link(segments: DataFrame, link: dict, source: DataFrame) -> DataFrame:
    """segments(file, segment, ...) with tstart and tend: element ``segment`` of the source's array; NULL without a source or element.

    ``audio_columns`` names the source's audio columns; the first that isn't NULL is taken along.
    """
    vad = link.get("vad_column", "vad")
    audio = [F.col(f"`{c}`") for c in link.get("audio_columns", []) if c in source.columns]
    s = source.select(F.col("file").alias("__file"), F.col(f"`{vad}`").alias("__vad"), *([F.coalesce(*audio).alias("audio")] if audio else []))
    joined = segments.join(s, segments["file"] == s["__file"], "left").withColumn("__v", F.get("__vad", F.col("segment").cast("int")))
    kind = joined.schema["__v"].dataType.typeName()
    at = (lambda i: F.col("__v").getField(("tstart", "tend")[i])) if kind == "struct" else (lambda i: F.get("__v", F.lit(i)))
    return joined.withColumn("tstart", at(0)).withColumn("tend", at(1)).drop("__file", "__vad", "__v")


@loader("prefix")
def prefixed_link(segments: DataFrame, link: dict, source: DataFrame) -> DataFrame:
    """segments(file, ...) with every field of the source but its key, under a prefix."""
    prefix = link.get("key_prefix", "source.")
    fields = [F.col(f"`{c}`").alias(prefix + c) for c in source.columns if c not in ("file", "__key__")]
    return segments.join(source.select(F.col("file").alias("__file"), *fields), F.col("file") == F.col("__file"), "left").drop("__file")


@loader("video")
def video_link(segments: DataFrame, link: dict, source: DataFrame) -> DataFrame:
    """A segment link with the video's id, from the file's name, and its URL at the segment's second; a name without an id is an error."""
    pattern = link["youtube_id_regexp"]
    found = F.regexp_extract("file", pattern, 1)
    ident = F.when(found == "", F.raise_error(F.concat(F.lit("no video id in "), F.col("file")))).otherwise(found)
    out = segment_link(segments, link, source).withColumn("video_id", ident)
    return out.withColumn("url", F.format_string("https://www.youtube.com/watch?v=%s&t=%ds", F.col("video_id"), F.floor("tstart")))


def first_available(df: DataFrame, alternatives: list[str]) -> Column:
    """The first of a field's locations that is there and not NULL."""
    there = [F.col(f"`{c}`") for c in alternatives if c in df.columns]
    if not there:
        raise KeyError(alternatives)
    return F.coalesce(*there)


def merge_field_maps(maps: list[dict]) -> tuple[dict, list[tuple]]:
    """(one field map: the first definition wins, conflicts: (batch, field, definition that was dropped))."""
    merged, conflicts = {}, []
    for batch, fields in enumerate(maps):
        for name, where in fields.items():
            if merged.setdefault(name, where) != where:
                conflicts.append((batch, name, where))
    return merged, conflicts
