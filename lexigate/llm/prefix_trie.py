"""The trie of conversation prefixes, by collapse of whole sequences.

Identical conversations become one sequence with a weight and the list of those that end there.
Sequences that are proper prefixes of others are dropped by an anti-join: the rest are the leaves.
Then weighted prefixes are added up. Every value of a node is a sum over the sequences that
begin with it: a node belongs to the sequence of its smallest member, whose own nodes are always
a lower end of its path, so what counts a node once (children, bytes kept) is known from the
depth at which that end begins. No step walks the trie level by level.

A node's id is a 128-bit digest chained over its turns; texts are read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigate.llm._session import cut, drop, prepare

#: Conversations share the start of the first of each GROUP, of fewer than HEAD turns.
GROUP, HEAD = 5, 9
#: Ids of one part of an end list lie in a range of so many bits.
PART_BITS = 10
_PATH = "conv_id bigint, depth bigint, node_id binary, parent_id binary, n_bytes bigint, upto bigint, ends boolean"


@dataclass
class Trie:
    """nodes: node_id, parent_id, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_bytes.
    ends: node_id, part, conv_ids (ascending, at most 2**PART_BITS in a part): the conversations that end at a node."""

    nodes: DataFrame
    ends: DataFrame


def turns(convs: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, turn_id, n_bytes) of every turn, by turn, null first, ties by turn_id."""
    prepare(convs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = convs.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("turn_id"), F.octet_length(text).cast("bigint").alias("n_bytes")).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_id")
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("bigint").alias("pos"), "turn_id", "n_bytes")


def named(rows: DataFrame) -> DataFrame:
    """``turns`` with a row without turn_id before each conversation's first, which stands for the conversation."""
    return rows.unionByName(_names(rows))


def _names(rows: DataFrame) -> DataFrame:
    return rows.where("pos = 0").select("conv_id", F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("turn_id"), F.lit(0).cast("bigint").alias("n_bytes"))


def rebuild(rows: DataFrame) -> DataFrame:
    """``turns`` with the start of each conversation replaced.

    Conversation c begins with the first h turns of c - c % GROUP (none if that is absent), h the
    crc32 of its decimal id modulo HEAD; its own turns follow after the first h of them. A row
    without turn_id stands for each conversation, also for those left without turns.
    """
    h = lambda c: F.crc32(c.cast("string").cast("binary")) % HEAD
    own = rows.where(F.col("pos") >= h(F.col("conv_id")))
    base = rows.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEAD - 1))
    near = base.select("conv_id", "pos", "turn_id", "n_bytes", F.explode(F.array(*[F.try_add("conv_id", F.lit(k).cast("bigint")) for k in range(1 - GROUP, GROUP)])).alias("c"))
    near = near.where((F.col("c") - F.col("c") % GROUP == F.col("conv_id")) & (F.col("pos") < h(F.col("c"))))
    return _names(rows).unionByName(near.select(F.col("c").alias("conv_id"), "pos", "turn_id", "n_bytes")).unionByName(own)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations that follow one another -> their paths; only the last row is carried."""
    names = [x.split()[0] for x in _PATH.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
    last: list | None = None
    for batch in batches:
        out = []
        for conv, pos, turn, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if pos < 0:  # the conversation exists: its path begins at the root
                if last:
                    out.append([*last, True])
                last = [conv, 0, b"", None, 0, 0]
            elif last and last[0] == conv:
                out.append([*last, False])
                last = [conv, last[1] + 1, hashlib.md5(last[2] + turn).digest(), last[2], size, last[5] + size]
        yield _paths(out, kinds, names)
    if last:
        yield _paths([[*last, True]], kinds, names)


def _paths(rows: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def prefix_trie(rows: DataFrame) -> Trie:
    """The trie over rows of ``named`` or ``rebuild``.

    A node is a distinct sequence of first turns, the root the empty one; its members are the
    conversations that begin with it, and its subtree holds the node itself. saved_bytes adds up,
    over the subtree, the members of each node but one, times the bytes of its last text. Rows
    without an id form no conversation. Without conversations there is no node, not even a root.
    """
    paths = cut(rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_chain, _PATH))
    ended = paths.where("ends")
    part = F.shiftright("conv_id", PART_BITS).alias("part")
    ends = ended.groupBy("node_id", part).agg(F.array_sort(F.collect_list("conv_id")).alias("conv_ids"))
    # whole-sequence collapse: one weighted sequence for identical conversations
    sequences = cut(ended.groupBy("node_id").agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("length"), F.max("upto").alias("total")))
    path = cut(paths.drop("ends").join(sequences.drop("node_id"), "conv_id"))
    met = cut(path.groupBy("node_id").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("length").alias("longest"), F.max("n_bytes").alias("n_bytes")))
    # leaves: what is left when proper prefixes of other sequences are dropped
    leaves = sequences.join(met.where("longest > depth").select("node_id"), "node_id", "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    own = met.groupBy("conv_id").agg(F.min("depth").alias("start"), F.sum("n_bytes").alias("own_bytes"))
    notes = sequences.select("conv_id").join(own, "conv_id", "left").join(leaves, "conv_id", "left")
    # aggregate weighted prefixes
    start = F.coalesce("start", F.col("length") + 1)
    below = F.col("total") - F.col("upto") + F.col("n_bytes")
    once = F.when(F.col("depth") >= start, below).otherwise(F.coalesce("own_bytes", F.lit(0)))
    child = ((F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= start)).cast("bigint")
    nodes = cut(
        path.join(notes, "conv_id")
        .groupBy("node_id")
        .agg(
            F.max("parent_id").alias("parent_id"),
            F.max("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.sum(child).alias("n_children"),
            F.sum(F.coalesce("leaf", F.lit(0)).cast("bigint")).alias("n_leaves"),
            F.sum(F.col("weight") * below - once).alias("saved_bytes"),
        )
    )
    ends = cut(ends)
    drop(paths, sequences, path, met)
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    return Trie(nodes.join(parents, "parent_id", "left").select("node_id", "parent_id", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes"), ends)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, sha, first = None, None, True
    for batch in batches:
        ids, digests = [], []
        for node, conv_ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if sha is None or node != last:
                if sha is not None:
                    ids.append(last)
                    digests.append(sha.hexdigest())
                last, sha, first = node, hashlib.sha256(), True
            sha.update(("" if first else ",").encode() + ",".join(map(str, conv_ids)).encode())
            first = False
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(digests, pa.string())], ["node_id", "ends_sha256"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["node_id", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node_id, ends_sha256): SHA-256 of the decimal ids that end at a node, ascending, comma-joined.

    A digest is sequential: a node's parts pass one task as a stream, a thousand ids to a row.
    """
    return ends.repartition("node_id").sortWithinPartitions("node_id", "part").select("node_id", "conv_ids").mapInArrow(_digests, "node_id binary, ends_sha256 string")
