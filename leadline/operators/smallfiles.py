"""Too many small files: archive them, drop those that add nothing, keep each record once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.archive import BLOCK_BYTES, Archive, binary_array, decode_ids, ids_to_bytes, pack
from ..sources.shared import cut

GROUP = ("grid_name", "tile_name", "layer")
#: Holders of its rarest record that a file is compared with at first, the largest; doubled for files still open.
_HOLDERS = 4


def _distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each list's distinct values in order, and the offsets of those."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.r_[0, np.cumsum(np.bincount(owner[new], minlength=len(offsets) - 1))]


@F.arrow_udf(T.StructType([T.StructField("content", T.BinaryType()), T.StructField("n_distinct", T.IntegerType()), T.StructField("set_checksum", T.StringType())]))
def _file(ids: pa.Array) -> pa.Array:
    values, offsets = ids_to_bytes(ids)
    sets, at = _distinct(values, offsets)
    raw, cuts = memoryview(sets.astype(">i8").tobytes()), (at * 8).tolist()
    sums = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.StructArray.from_arrays([binary_array(values, offsets), pa.array(np.diff(at).astype(np.int32)), pa.array(sums)], ["content", "n_distinct", "set_checksum"])


def archive_files(files: DataFrame, key: str = "file_id", path: str = "file_path", ids: str = "record_ids", group: tuple[str, ...] = GROUP, block_bytes: int = BLOCK_BYTES) -> Archive:
    """Pack the files; the index carries each file's key, its number of distinct records and the checksum of their set.

    The bytes of a file are its record ids in their order, repeats included.
    Null ids within a file are no records; a null list is an empty file.  Files
    are told apart by key: two of one path are both kept.  Rows that agree in
    all of this count once; rows with a null key are no files.
    """
    rows = files.where(F.col(key).isNotNull()).select(*[F.col(c) for c in group], F.col(key).alias("_key"), F.coalesce(F.col(path), F.concat(F.lit("file:"), F.col(key))).alias("_path"), F.col(ids).cast("array<bigint>").alias("_ids"))
    size = F.coalesce(F.size("_ids"), F.lit(0)) * 8
    rows = rows.select(*group, F.col("_key").alias("key"), "_path", F.greatest(size, F.lit(0)).cast("bigint").alias("_size"), _file("_ids").alias("_f"))
    rows = rows.select(*group, "key", "_path", "_size", F.col("_f.content").alias("_content"), F.col("_f.n_distinct").alias("n_distinct"), F.col("_f.set_checksum").alias("set_checksum"))
    return pack(rows, "_path", "_content", list(group), ["key", "n_distinct", "set_checksum"], block_bytes, "_size")


def _sets(members: pa.Array, payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: the position of each non-empty file, its distinct records in order, and their offsets; rows of one key and one set once."""
    key, n, start, length = (members.field(c).to_numpy(zero_copy_only=False) for c in ("key", "n_distinct", "offset", "length"))
    sums = members.field("set_checksum").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((sums, key))
    first = np.ones(len(order), bool)
    first[1:] = (key[order][1:] != key[order][:-1]) | (sums[order][1:] != sums[order][:-1])
    at = np.sort(order[first & (n[order] > 0)])
    values = np.frombuffer(payload, ">i8")
    size, begin = length[at] // 8, start[at] // 8
    offsets = np.r_[0, np.cumsum(size)]
    take = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) + np.repeat(begin, size)
    return at, *_distinct(values[take].astype(np.int64), offsets)


def contained(keys: np.ndarray, sums: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which of a group's sets (distinct values in order, side by side) are part of another that is larger, or equal and of a smaller key.

    Of equal sets, told by checksum, all but the least key are.  A set that is
    part of another has its rarest value there; the holders of that value are
    tried from the largest down, a few first, and more only for those still
    open, so that nested chains and popular values stay cheap.
    """
    n = np.diff(offsets)
    found = np.zeros(len(keys), bool)
    code = np.unique(sums, return_inverse=True)[1]
    order = np.lexsort((keys, code))
    repeated = np.r_[False, code[order][1:] == code[order][:-1]]
    found[order[repeated]] = True
    # Postings: every value with its holders, the largest first.
    owner = np.repeat(np.arange(len(keys)), n)
    alive = ~found[owner]
    ids = np.unique(values, return_inverse=True)[1]
    post = np.lexsort((-n[owner], ids))
    post = post[alive[post]]
    p_id, p_owner = ids[post], owner[post]
    first = np.searchsorted(p_id, np.arange(int(ids.max()) + 1 if len(ids) else 0))
    holders = np.diff(np.r_[first, len(p_id)])
    # Each value of each set: is it held, and by how many.
    h = holders[ids] if len(ids) else np.zeros(0, np.int64)
    begin = offsets[:-1]
    rarest = np.minimum.reduceat(h, begin) if len(keys) else np.zeros(0, np.int64)
    open_ = np.flatnonzero(~found & (rarest > 1))
    if not len(open_):
        return found
    by_rarity = np.lexsort((h, owner))  # each set's values, the rarest first
    pairs_code = np.sort(p_id.astype(np.int64) * len(keys) + p_owner)
    start, width = 0, _HOLDERS
    while len(open_):
        rare = ids[by_rarity[begin[open_]]]
        left = np.minimum(holders[rare] - start, width)
        a = np.repeat(open_, np.maximum(left, 0))
        place = np.arange(len(a)) - np.repeat(np.cumsum(np.maximum(left, 0)) - np.maximum(left, 0), np.maximum(left, 0))
        b = p_owner[np.repeat(first[rare] + start, np.maximum(left, 0)) + place]
        keep = n[b] > n[a]
        a, b = a[keep], b[keep]
        # All values of a must be among those of b: the next rarest by itself, then all, some millions at a time.
        second = ids[by_rarity[np.minimum(begin[a] + 1, offsets[a + 1] - 1)]]
        keep = _held(pairs_code, second * len(keys) + b)
        a, b = a[keep], b[keep]
        piece = np.cumsum(n[a]) // 4_000_000
        for p in np.unique(piece):
            x, y = a[piece == p], b[piece == p]
            at = np.repeat(begin[x], n[x]) + np.arange(int(n[x].sum())) - np.repeat(np.cumsum(n[x]) - n[x], n[x])
            ok = _held(pairs_code, ids[at] * len(keys) + np.repeat(y, n[x]))
            found[x[np.logical_and.reduceat(ok, np.cumsum(n[x]) - n[x])]] = True
        # Holders come by size: beyond one that is not larger there are none.
        more = start + width < holders[rare]
        nxt = np.minimum(first[rare] + start + width, len(p_owner) - 1)
        open_ = open_[more & (n[p_owner[nxt]] > n[open_]) & ~found[open_]]
        start, width = start + width, 2 * width
    return found


def _held(codes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of ``asked`` are among the sorted ``codes``."""
    at = np.minimum(np.searchsorted(codes, asked), max(len(codes) - 1, 0))
    return codes[at] == asked if len(codes) else np.zeros(len(asked), bool)


def _whole_groups(archive: Archive) -> DataFrame:
    """Blocks that hold their group alone."""
    return archive.blocks().where("of = 1") if archive.split else archive.blocks()


def files_adding_nothing(archive: Archive) -> DataFrame:
    """``(key)`` of the non-empty files whose distinct records all occur in one other file of their group that has more of them, or as many and a smaller key.

    A group that fits a block is decided by the task that reads the block.
    Larger groups are compared across tasks, in the same way: files of equal
    sets share the set's checksum; of the rest, those of which others hold
    every record are looked up in the largest files that hold their rarest
    record, in more of these only while they are open.  Files with a null
    group column belong to no group and are never listed.
    """
    kind = dict(archive.index().dtypes)["key"]
    whole = _whole_groups(archive).dropna(subset=list(archive.group)).select("members", "payload")

    def decide(batches):
        for b in batches:
            for i in range(b.num_rows):
                members, payload = b.column("members")[i].values, b.column("payload")[i].as_py()
                at, values, offsets = _sets(members, payload)
                key = members.field("key").take(pa.array(at))
                sums = members.field("set_checksum").take(pa.array(at)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                ranks = np.argsort(np.argsort(key.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
                yield pa.RecordBatch.from_arrays([key.filter(pa.array(contained(ranks, sums, values, offsets)))], ["key"])

    found = whole.mapInArrow(decide, f"key {kind}")
    return found.unionByName(_across_blocks(archive)) if archive.split else found


def _across_blocks(archive: Archive) -> DataFrame:
    """The same for groups of several blocks."""
    group, blocks = list(archive.group), archive.blocks().where("of > 1").dropna(subset=list(archive.group))
    index = blocks.select(*group, F.explode("members").alias("m")).select(*group, "m.key", "m.n_distinct", "m.set_checksum").where("n_distinct > 0").distinct()
    # A group goes by its least key from here on: one number instead of its columns with every record.
    of = index.groupBy(*group).agg(F.min("key").alias("of"))
    files = cut(index.join(of, group).select("of", "key", "n_distinct", "set_checksum"))
    keep = cut(files.groupBy("of", "set_checksum").agg(F.min("key").alias("key"), F.first("n_distinct").alias("n_distinct")))
    twins = files.select("of", "set_checksum", "key").join(keep.select("of", "set_checksum", F.col("key").alias("_least")), ["of", "set_checksum"]).where("key > _least").select("key")
    contents = archive.contents(blocks).dropDuplicates(["key", "set_checksum"]).select("key", "set_checksum", "content").join(keep, ["key", "set_checksum"])
    records = cut(contents.select("of", "key", "n_distinct", F.explode(F.array_distinct(decode_ids(F.col("content")))).alias("id")))
    # A file can only be part of another if others hold each of its records.
    holders = records.groupBy("of", "id").agg(F.count("*").alias("_holders")).where("_holders > 1")
    covered = records.join(holders, ["of", "id"]).groupBy("of", "key", "n_distinct").agg(F.count("*").alias("_covered"), F.min(F.struct("_holders", "id")).alias("_r"))
    open_ = cut(covered.where("_covered = n_distinct").select("of", "key", "n_distinct", F.col("_r.id").alias("id"), F.col("_r._holders").alias("_holders")))
    found, width, start = twins, 2 * _HOLDERS, 0
    by_size = Window.partitionBy("of", "id").orderBy(F.desc("n_distinct"), "key")
    while not open_.isEmpty():
        # The largest holders of each rarest record; a hot record is cut down to them before the shuffle.
        largest = records.join(open_.select("of", "id").distinct(), ["of", "id"], "left_semi").withColumn("_rank", F.row_number().over(by_size)).where(F.col("_rank") <= start + width)
        pairs = cut(open_.join(largest.where(F.col("_rank") > start).select("of", "id", F.col("key").alias("other"), F.col("n_distinct").alias("_n")), ["of", "id"]).where("_n > n_distinct").select("key", "other"))
        asked = pairs.select("key").union(pairs.select("other")).distinct()
        sets = archive.contents(blocks).join(asked, "key", "left_semi").dropDuplicates(["key"]).select("key", decode_ids(F.col("content")).alias("_ids"))
        mine, theirs = sets.withColumnRenamed("_ids", "_mine"), sets.toDF("other", "_theirs")
        inside = cut(pairs.join(mine, "key").join(theirs, "other").where(F.size(F.array_except("_mine", "_theirs")) == 0).select("key").distinct())
        found = found.unionByName(inside)
        start, width = start + width, 8 * width
        open_ = cut(open_.where(F.col("_holders") > start).join(inside, "key", "left_anti"))
    return found


def consolidate(files: DataFrame, key: str = "file_id", path: str = "file_path", ids: str = "record_ids", group: tuple[str, ...] = GROUP, block_bytes: int = BLOCK_BYTES) -> Archive:
    """An archive in which each record of a group occurs exactly once.

    A record stays with the file of its group that has the most distinct
    records, the least key among equals; files left with nothing are dropped.
    A group that fits a block is settled by the task that reads the block.
    """
    first = archive_files(files, key, path, ids, group, block_bytes)
    kinds = dict(first.index().dtypes)
    fields = ", ".join([*[f"`{c}` {kinds[c]}" for c in group], f"`{key}` {kinds['key']}", f"`{path}` string", f"`{ids}` array<bigint>"])

    def settle(batches):
        for b in batches:
            for i in range(b.num_rows):
                members, payload = b.column("members")[i].values, b.column("payload")[i].as_py()
                at, values, offsets = _sets(members, payload)
                n, key_of = np.diff(offsets), members.field("key").take(pa.array(at))
                ranks = np.argsort(np.argsort(key_of.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
                owner = np.repeat(np.arange(len(at)), n)
                order = np.lexsort((ranks[owner], -n[owner], values))
                mine = order[np.r_[True, values[order][1:] != values[order][:-1]]] if len(order) else order
                mine = np.sort(mine)
                left = np.bincount(owner[mine], minlength=len(at))
                some = pa.array(np.flatnonzero(left > 0))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(left[left > 0])], pa.int32()), pa.array(values[mine]))
                same = [b.column(c).slice(i, 1).take(pa.array(np.zeros(len(some), np.int64))) for c in group]
                yield pa.RecordBatch.from_arrays([*same, key_of.take(some), members.field("path").take(pa.array(at)).take(some), lists], [*group, key, path, ids])

    rows = _whole_groups(first).select(*group, "members", "payload").mapInArrow(settle, fields)
    if first.split:
        records = first.contents(first.blocks().where("of > 1")).select(*group, "key", "path", "n_distinct", F.explode(F.array_distinct(decode_ids(F.col("content")))).alias("id"))
        owned = records.groupBy(*group, "id").agg(F.max_by(F.struct("key", "path"), F.struct("n_distinct", -F.col("key"))).alias("_o"))
        kept = owned.groupBy(*group, F.col("_o.key").alias(key)).agg(F.min("_o.path").alias(path), F.array_sort(F.collect_list("id")).alias(ids))  # at most a file's records
        rows = rows.unionByName(kept)
    return archive_files(rows, key, path, ids, group, block_bytes)
