"""Cell codecs that a column's suffix selects: ``vad.npy``, ``meta.json``, ``title.txt``; others are opaque."""

from __future__ import annotations

import io
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])
AUDIO = ("flac", "mp3", "wav", "ogg", "opus", "m4a", "audio")


def suffix_of(name: str) -> str:
    """After the last dot, or the whole name."""
    return name.rsplit(".", 1)[-1]


def loaded(cell):
    """The array of a cell; pickled objects are refused."""
    return None if cell is None else np.load(io.BytesIO(cell), allow_pickle=False).astype(float)


def npy_rows(column: Column) -> Column:
    def rows(cells):
        return cells.map(lambda b: None if b is None else loaded(b).tolist())

    return F.pandas_udf(rows, "array<array<double>>")(column)


def npy_vector(column: Column) -> Column:
    def vector(cells):
        return cells.map(lambda b: None if b is None else loaded(b).ravel().tolist())

    return F.pandas_udf(vector, "array<double>")(column)


def packed(value) -> bytes | None:
    if value is None:
        return None
    rows, out = [list(x) if isinstance(x, np.ndarray) else x for x in value], io.BytesIO()
    np.save(out, np.array(rows, dtype=float), allow_pickle=False)
    return out.getvalue()


def to_npy(column: Column) -> Column:
    return F.pandas_udf(lambda values: values.map(packed), "binary")(column)


def decode(name: str, column: Column, dims: int = 2) -> Column:
    """The cell of a binary column as its suffix says; ``pyd`` pickles are never opened, as that would run their code."""
    kind = suffix_of(name)
    if kind == "npy":
        return npy_rows(column) if dims == 2 else npy_vector(column)
    if kind == "txt":
        return F.decode(column, "utf-8")
    if kind == "json":
        return F.try_parse_json(F.decode(column, "utf-8"))
    if kind == "pyd":
        raise ValueError(f"{name}: pickles are not decoded")
    return column


def encode(name: str, column: Column, kind: str) -> Column:
    """The inverse of decode for a column of Spark type ``kind``; binaries and texts pass through."""
    if kind == "binary":
        return column
    if suffix_of(name) == "npy":
        return to_npy(column)
    if suffix_of(name) == "json":
        return F.encode(F.to_json(column), "utf-8")
    return column


def first_audio(columns: list[str]) -> str | None:
    """The first column that holds audio, in the order of AUDIO."""
    return next((c for a in AUDIO for c in columns if suffix_of(c) == a), None)
