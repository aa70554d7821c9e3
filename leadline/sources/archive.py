"""Indexed archive containers: many small files in a few large blocks.

A block holds the original bytes of its members one after the other; its index
names each member's path, offset, length and checksum.  Blocks are rows of a
Parquet table in the shared folder: the index is read without the payload,
members are cut out of it in the JVM, and every block can be read by a task of
its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, new_path

BLOCK_BYTES = 32 << 20
#: Groups beyond this number are joined by a shuffle instead of a broadcast.
_BROADCAST_GROUPS = 200_000


@dataclass(frozen=True)
class Archive:
    """An archive written at ``location``; ``split`` tells whether any group has more than one block."""

    spark: SparkSession
    location: str
    group: tuple[str, ...]
    split: bool = True

    def blocks(self) -> DataFrame:
        """One row a block: the group's columns, ``bucket``, ``of`` how many in the group, ``members`` and ``payload``."""
        return self.spark.read.parquet(self.location)

    def index(self) -> DataFrame:
        """One row a member: the group's columns, ``bucket``, ``path``, ``offset``, ``length``, ``checksum`` and what was carried."""
        return self.blocks().select(*self.group, "bucket", F.explode("members").alias("m")).select(*self.group, "bucket", "m.*")

    def contents(self, blocks: DataFrame | None = None) -> DataFrame:
        """The index with ``content``, each member's original bytes; of some ``blocks`` only, if given."""
        at = (self.blocks() if blocks is None else blocks).select(*self.group, "bucket", "payload", F.explode("members").alias("m"))
        return at.select(*self.group, "bucket", "m.*", F.expr("substring(payload, cast(m.offset as int) + 1, cast(m.length as int))").alias("content"))

    def lookup(self, paths: DataFrame) -> DataFrame:
        """The contents of the paths in the column ``path`` of ``paths``; paths not in the archive give no row.

        The index is asked first, without the payloads; only blocks that hold
        one of the paths are opened, and only those members are cut out.
        """
        keys = [*self.group, "bucket"]
        wanted = self.index().join(paths.select("path").distinct(), "path", "left_semi").select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(keys)], F.struct("path", "offset", "length", "checksum").alias("_m"))
        wanted = wanted.groupBy(*[f"_w{i}" for i in range(len(keys))]).agg(F.collect_list("_m").alias("_ms"))  # at most a block's members
        same = [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(keys)]
        opened = self.blocks().select(*keys, "payload").join(wanted, on=same).select(*keys, "payload", F.explode("_ms").alias("m"))
        return opened.select(*keys, "m.*", F.expr("substring(payload, cast(m.offset as int) + 1, cast(m.length as int))").alias("content"))

    def verify(self) -> DataFrame:
        """Members whose bytes don't agree with their checksum: empty if all is well."""
        return self.contents().where(F.sha2("content", 256) != F.col("checksum")).drop("content")


def pack(files: DataFrame, path: str, content: str, group: list[str], carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES, size: str | None = None) -> Archive:
    """Write the files, one row each, to an archive of blocks of about ``block_bytes`` a group.

    A group of any size is dealt out to as many blocks as it needs by a hash of
    the path, so no task holds more than a block or so.  Rows of a group that
    agree in path, content and what is carried are packed once; files of one
    path that differ in any of these are all kept, each a member of its own.
    A row with a null path or null content is no file; an empty content is kept
    as a member of length 0.  Null group columns make a group of their own.
    ``carry`` names further columns for the index.  ``size`` names a column
    with the length of the content, where that is known without it; then no
    content may be null.
    """
    carry = carry or []
    rows = files.where(F.col(path).isNotNull())
    rows = rows.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col(path).cast("string").alias("_path"), F.col(content).alias("_content"), (F.col(size) if size else F.length(content)).alias("_size"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    keys = [f"_g{i}" for i in range(len(group))]
    sizes = rows.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.sum("_size") / F.lit(block_bytes))).cast("int").alias("_blocks"))
    many = cut(sizes.where("_blocks > 1")).toDF(*[f"_m{i}" for i in range(len(keys))], "_blocks")
    n_many = many.count()
    if n_many:
        same = [F.col(k).eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate(keys)]
        rows = rows.join(F.broadcast(many) if n_many <= _BROADCAST_GROUPS else many, on=same, how="left").drop(*[f"_m{i}" for i in range(len(keys))]).fillna(1, ["_blocks"])
    else:
        rows = rows.withColumn("_blocks", F.lit(1))
    if not size:  # a filter on the content would make it twice
        rows = rows.where(F.col("_content").isNotNull())
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_path"), F.col("_blocks")).cast("int")).withColumn("_sum", F.sha2("_content", 256)).drop("_size")
    kinds = dict(rows.dtypes)
    carried = "".join(f", {c}: {kinds[f'_c{i}']}" for i, c in enumerate(carry))
    member = f"struct<path: string, offset: bigint, length: bigint, checksum: string{carried}>"
    schema = ", ".join([*[f"`{c}` {kinds[k]}" for c, k in zip(group, keys, strict=True)], "bucket int", "of int", f"members array<{member}>", "payload binary"])
    order = ["_path", "_sum", *[f"_c{i}" for i in range(len(carry))]]

    def block(t: pa.Table) -> pa.Table:
        t = t.take(pa.compute.sort_indices(t, sort_keys=[(c, "ascending") for c in order]))
        codes = [t.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in order]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
        if not new.all():
            t = t.filter(pa.array(new))
        content = t.column("_content").combine_chunks()
        length = pa.compute.binary_length(content).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [t.column("_path").combine_chunks(), pa.array(np.cumsum(length) - length), pa.array(length), t.column("_sum").combine_chunks(), *[t.column(f"_c{i}").combine_chunks() for i in range(len(carry))]]
        members = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), pa.StructArray.from_arrays(parts, ["path", "offset", "length", "checksum", *carry]))
        first = t.slice(0, 1)
        out = {c: first.column(k) for c, k in zip(group, keys, strict=True)}
        return pa.table(out | {"bucket": first.column("_bucket"), "of": first.column("_blocks"), "members": members, "payload": pa.array([b"".join(content.to_pylist())], pa.binary())})

    location = new_path(files.sparkSession, "archive")
    rows.groupBy(*keys, "_bucket").applyInArrow(block, schema).write.parquet(location)
    return Archive(files.sparkSession, location, tuple(group), n_many > 0)


# Arrays of 64-bit ids as bytes, eight each, the highest first: whole columns at a time.


def ids_to_bytes(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list array without nulls among them, and the offsets of its lists; a null list is empty."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    flat = ids.flatten()  # values of null lists are left out
    size = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.r_[0, np.cumsum(size)]
    if flat.null_count:
        valid = flat.is_valid().to_numpy(zero_copy_only=False)
        offsets = np.r_[0, np.cumsum(valid)][offsets]
        flat = flat.drop_null()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64), offsets


def binary_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Ids and the offsets of their lists as an array of bytes."""
    raw = values.astype(">i8").tobytes()
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 8).astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.binary())


@F.arrow_udf(T.BinaryType())
def _encode(ids: pa.Array) -> pa.Array:
    return binary_array(*ids_to_bytes(ids))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _decode(content: pa.Array) -> pa.Array:
    size = pa.compute.fill_null(pa.compute.binary_length(content), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    raw = b"".join(x[: len(x) // 8 * 8] for x in content.to_pylist() if x)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(np.frombuffer(raw, ">i8").astype(np.int64)))


def encode_ids(ids: Column) -> Column:
    """An array of 64-bit ids as bytes, eight each, the highest first; nulls in it are left out, a null array is empty."""
    return _encode(ids)


def decode_ids(content: Column) -> Column:
    """The ids of :func:`encode_ids`; null gives an empty array."""
    return _decode(content)
