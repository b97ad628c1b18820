"""Arrow types as Spark can read them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.types import StructField, StructType


def readable(kind: pa.DataType) -> pa.DataType:
    """The nearest type without loss that Spark's Arrow conversion takes; TypeError if there is none."""
    t = pa.types
    if t.is_float16(kind):
        return pa.float32()
    for wide, test in ((pa.int16(), t.is_uint8), (pa.int32(), t.is_uint16), (pa.int64(), t.is_uint32), (pa.decimal128(20, 0), t.is_uint64)):
        if test(kind):
            return wide
    if t.is_string_view(kind) or t.is_large_string(kind):
        return pa.string()
    if t.is_binary_view(kind) or t.is_fixed_size_binary(kind) or t.is_large_binary(kind):
        return pa.binary()
    if t.is_date64(kind):
        return pa.date32()
    if t.is_time(kind):
        return pa.time64("us")
    if t.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    if t.is_decimal256(kind):
        if kind.precision > 38:
            raise TypeError(f"{kind} is wider than 38 digits")
        return pa.decimal128(kind.precision, kind.scale)
    if t.is_dictionary(kind) or t.is_run_end_encoded(kind):
        return readable(kind.value_type)
    if t.is_map(kind):
        return pa.map_(readable(kind.key_type), readable(kind.item_type))
    if t.is_struct(kind):
        return pa.struct([pa.field(f.name, readable(f.type), f.nullable) for f in (kind.field(i) for i in range(kind.num_fields))])
    if any(test(kind) for test in (t.is_list, t.is_large_list, t.is_fixed_size_list, t.is_list_view, t.is_large_list_view)):
        return pa.list_(readable(kind.value_type))
    if t.is_union(kind) or t.is_interval(kind):
        raise TypeError(f"{kind} has no Spark type")
    return kind


def spark_schema(schema: pa.Schema) -> StructType:
    from pyspark.sql.pandas.types import from_arrow_type

    return StructType([StructField(f.name, from_arrow_type(readable(f.type)), True) for f in schema])


def as_readable(column: pa.Array, kind: pa.DataType) -> pa.Array:
    if column.type == kind:
        return column
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    elif pa.types.is_run_end_encoded(column.type):
        import pyarrow.compute as pc

        column = pc.run_end_decode(column)
    return column.cast(kind, safe=False) if pa.types.is_timestamp(kind) else column.cast(kind)
