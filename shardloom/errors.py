"""Errors of the dataset layer."""


class ShardMissingError(FileNotFoundError):
    """A shard, or all shards of a query, can't be found."""


class KeyMismatchError(ValueError):
    """Keys of two column groups don't lie at the same positions."""


class SchemaDriftError(ValueError):
    """Shards of one column group have different schemas."""


class EmptyOutputError(ValueError):
    """Nothing was written."""
