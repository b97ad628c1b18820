"""Scalar column expressions: sample keys, durations, segment arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, StructField, StructType

KEY_DIGITS = 8


def make_key(file: Column, segment: Column, digits: int = KEY_DIGITS) -> Column:
    """``file_00000042``; longer numbers are never cut."""
    return F.format_string(f"%s_%0{digits}d", file.cast("string"), segment.cast("bigint"))


def key_file(key: Column) -> Column:
    """All before the last underscore; NULL if the key has no numeric segment."""
    return F.nullif(F.regexp_extract(key, r"(?s)^(.*)_([0-9]+)$", 1), F.lit(""))


def key_segment(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"(?s)^(.*)_([0-9]+)$", 2), F.lit("")).try_cast("bigint")


def key_parts(key: Column) -> tuple[Column, Column, Column]:
    """(file, kind, segment) of ``file_kind_00000042``."""
    pattern = r"(?s)^(.*)_([^_]*)_([0-9]+)$"
    part = lambda i: F.nullif(F.regexp_extract(key, pattern, i), F.lit(""))
    return part(1), part(2), part(3).try_cast("bigint")


def dataset_key(key: Column, segmented: bool) -> tuple[Column, Column]:
    """(file, segment); a dataset without segments has one row for each file."""
    return (key_file(key), key_segment(key)) if segmented else (key, F.lit(0).cast("bigint"))


def two_digits(value: Column, digits: int) -> Column:
    """A number rounded as its exact binary value is, which plain string formatting of decimals isn't."""
    scaled = value.cast("decimal(38,18)")
    return F.format_string(f"%.{digits}f", F.bround(scaled, digits).cast("double"))


def format_duration(hours: Column) -> Column:
    """Hours as text: millions, thousands, hours, or minutes below one hour."""
    return (
        F.when(hours > 1e6, F.concat(two_digits(hours / 1e6, 2), F.lit(" M hours")))
        .when(hours > 1000, F.concat(two_digits(hours / 1000, 2), F.lit(" k hours")))
        .when(hours < 1, F.concat(two_digits(hours * 60, 1), F.lit(" minutes")))
        .otherwise(F.concat(two_digits(hours, 2), F.lit(" hours")))
    )


def has_magic(path: Column) -> Column:
    """Does the path hold characters that a glob would expand?"""
    return path.rlike(r"[*?\[]")


def known_duration(loaded: Column, estimated: Column) -> Column:
    """The first of the two that is neither NULL nor 0, else -1."""
    return F.coalesce(F.nullif(loaded, F.lit(0)), F.nullif(estimated, F.lit(0)), F.lit(-1))


def segment_duration(start: Column, end: Column) -> Column:
    return end - start


def with_context(start: Column, end: Column, before: float, after: float) -> tuple[Column, Column]:
    """The segment with some seconds more on either side, not before 0."""
    return F.greatest(F.lit(0.0), start - F.lit(float(before))), end + F.lit(float(after))


def with_timestamps(start: Column, end: Column, new_start: Column, new_end: Column) -> tuple[Column, Column]:
    return F.coalesce(new_start, start), F.coalesce(new_end, end)


def sample_range(start: Column, end: Column, rate: int, skip: int = 0) -> tuple[Column, Column]:
    """(first sample, number of samples) of a segment; ``skip`` is a codec's delay, met only after the beginning."""
    first = F.round(start * rate).cast("bigint") + F.when(start > 0, F.lit(skip)).otherwise(F.lit(0))
    return first, F.round((end - start) * rate).cast("bigint")


def pad_right(samples: Column, length: Column) -> Column:
    """An array of samples with zeros at its end up to ``length``."""
    missing = F.greatest(F.lit(0), length - F.size(samples)).cast("int")
    return F.concat(samples, F.array_repeat(F.lit(0.0), missing))


def speech_seconds(segments: Column) -> Column:
    """Sum of the last minus the last but one value of each segment; 0 if there are none."""
    return F.aggregate(segments, F.lit(0.0), lambda total, s: total + (F.element_at(s, -1) - F.element_at(s, -2)).cast("double"))


def short_text(text: Column, limit: int = 1000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def shard_name(path: Column, suffix: str = ".shard") -> Column:
    """The file name without its suffix; NULL if the path has another one."""
    escaped = suffix.replace(".", r"\.")
    return F.nullif(F.regexp_extract(path, rf"([^/]+){escaped}$", 1), F.lit(""))


def byte_range(data: Column, start: int, end: int) -> Column:
    """Bytes [start, end) of a binary, as far as it goes."""
    return F.substring(data, start + 1, max(0, end - start))


def storage_type(kind: DataType) -> DataType:
    """Doubles as floats and longs as ints, in nested types too; others as they are."""
    if isinstance(kind, DoubleType):
        return FloatType()
    if isinstance(kind, LongType):
        return IntegerType()
    if isinstance(kind, ArrayType):
        return ArrayType(storage_type(kind.elementType), kind.containsNull)
    if isinstance(kind, MapType):
        return MapType(storage_type(kind.keyType), storage_type(kind.valueType), kind.valueContainsNull)
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, storage_type(f.dataType), f.nullable) for f in kind.fields])
    return kind


def cast_for_storage(df):
    return df.select(*[F.col(f"`{f.name}`").cast(storage_type(f.dataType)).alias(f.name) for f in df.schema.fields])
