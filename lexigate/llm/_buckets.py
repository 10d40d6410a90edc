"""Links between members of index buckets, without expanding a bucket into all its pairs."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigate.llm._graph import components
from lexigate.llm._session import cut, drop

Side = Callable[[str], Column]

#: One node in SAMPLE is looked at for hot keys, and at most so many keys are taken as hot.
SAMPLE, HOT_KEYS = 64, 10_000
#: Pairs of a key and a node that a task packs together.
PACKED = 1 << 20
#: Members of a bucket up to which the last comparison of all is no more work than the rounds before it.
FEW = 8


def shared_buckets(nodes: DataFrame, keys: Column) -> DataFrame:
    """(key, node, meets) for the keys that two nodes or more have; meets: buckets' sizes summed over a node.

    ``nodes`` has a column node and those that ``keys`` reads. A key that holds so large
    a share of a sample of nodes that it would overload one task is known to be shared: its
    rows go round the exchange on the key. HOT_KEYS bounds the table of such keys: each holds
    more than its share of the sample, so there are no more of them.
    """
    exploded = nodes.select("node", F.explode(keys).alias("key"))
    some = exploded.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count("*").alias("seen"))
    least = some.agg(F.greatest(F.lit(16), F.sum("seen") / HOT_KEYS).alias("least")).first()["least"]
    hot = cut(some.where(F.col("seen") > least))
    marked = exploded.join(F.broadcast(hot), "key", "left")
    cold = marked.where("seen is null").select("key", "node").repartition("key")
    size = cold.groupBy("key").agg(F.count("node").alias("size")).where("size > 1")  # of the node, so that both sides share one exchange
    met = cold.join(size.hint("merge"), "key").unionByName(marked.where("seen is not null").select("key", "node", (F.col("seen") * SAMPLE).alias("size")))
    return met.select("key", "node", F.sum("size").over(Window.partitionBy("node")).alias("meets"))


def packed_keys(batches: Iterator[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """part, keys, nodes out of (keys, nodes) of equal length: those of a part in one row for each PACKED pairs, each pair once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for more in itertools.chain(batches, [None]):
        if more is not None:
            held.append(more)
        if held and (more is None or sum(len(k) for k, _ in held) >= PACKED):
            keys, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, nodes = _distinct(keys, nodes)
            part = (keys.view(np.uint64) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            ids, first = np.unique(part[order], return_index=True)
            ends = pa.py_buffer(np.append(first * 8, len(part) * 8).astype(np.int32))
            packed = [pa.Array.from_buffers(pa.binary(), len(ids), [None, ends, pa.py_buffer(x[order])]) for x in (keys, nodes)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *packed], ["part", "keys", "nodes"])
            held = []


def _distinct(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order of keys, each once."""
    order = np.argsort(keys, kind="stable")
    keys, nodes = keys[order], nodes[order]
    again = np.append(False, keys[1:] == keys[:-1])
    if again.any():  # nodes in order where a key has several
        several = np.flatnonzero(again | np.append(again[1:], False))
        several_ = several[np.lexsort((nodes[several], keys[several]))]
        nodes[several] = nodes[several_]
        new = ~again
        new[1:] |= nodes[1:] != nodes[:-1]
        keys, nodes = keys[new], nodes[new]
    return keys, nodes


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, node and the key's number of nodes, of the keys that two nodes or more have; whole parts come to one task."""
    got = [[np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(c)] for batch in batches for c in (1, 2)]
    keys, nodes = ([x for part in got[c::2] for x in part] for c in (0, 1))
    if keys:
        key, node = _distinct(np.concatenate(keys), np.concatenate(nodes))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        size = np.repeat(size, size)
        met = size > 1
        out = pa.Table.from_arrays([pa.array(x[met]) for x in (key, node, size)], ["key", "node", "size"])
        yield from out.to_batches(max_chunksize=1 << 16)


def met_buckets(packed: DataFrame) -> DataFrame:
    """(key, node, meets) as ``shared_buckets`` gives them, for rows of ``packed_keys``, where pairs may come repeatedly.

    The pairs of a part meet in one task, as arrays of 16 bytes a pair, where sorting tells the shared keys; only
    the pairs of these become rows.
    """
    met = packed.repartition("part").mapInArrow(_met, "key bigint, node bigint, size bigint")
    return cut(met.select("key", "node", F.sum("size").over(Window.partitionBy("node")).alias("meets")))


def least_shared(key: Column, x: Side, y: Side) -> Column:
    """Whether a key is the least of those that two nodes share."""
    return key == F.array_min(F.array_intersect(x("keys"), y("keys")))


def bucket_components(buckets: DataFrame, nodes: DataFrame, near: Callable[[Side, Side], Column], confirm: Callable[[DataFrame], DataFrame], rounds: int, first: Callable[[Column, Side, Side], Column] = least_shared, close: Callable[[Side, Side], Column] = lambda x, y: F.lit(True), picks: int = 1, among: int = 1, last: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) over all confirmed links between nodes that share a bucket.

    ``buckets`` has (key, node) and may have meets, ``nodes`` has node and the columns that ``near`` and
    ``first`` read; ``confirm`` takes (a, b) pairs and returns the confirmed ones as (u, v).
    ``first`` is true for one of the keys that a pair shares; without it nodes have their ``keys``.
    ``close`` is a costlier test than ``near``, put to the pairs that are near. ``picks`` members
    of a bucket stand for it in the rounds after the first, which look at one key ``among`` so many, other keys in every round.

    First each node is compared with one node only: of the most connected member of each of
    its buckets, the one that it meets in most of them. The document that a family was
    copied from meets nearly all of it. Nodes that this leaves alone are then compared with
    one member of each of their buckets, another one in every bucket. After that a bucket's
    main component is the one with most members there, and the members outside it are
    compared with one member of it, again another one in every bucket. These rounds leave
    out buckets of FEW members, which the last step settles as cheaply.
    At last every two members of one bucket that still lie in different components are
    compared, so no component is left split; pairs inside a component need no comparison.
    ``last`` does that by itself, from (key, node, comp) to the confirmed pairs as (u, v).
    """
    columns = [c for c in nodes.columns if c != "node"]

    def side(x: str) -> DataFrame:
        return nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])

    def of(x: str) -> Side:
        return lambda c: F.col(f"{c}_{x}")

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        candidates = cut(both.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").where(near(of("a"), of("b")) & close(of("a"), of("b"))).select("a", "b"))
        found = cut(confirm(candidates))
        drop(candidates)
        return found

    if "meets" not in buckets.columns:
        buckets = buckets.withColumn("meets", F.lit(0))
    centre = buckets.groupBy("key").agg(F.max_by("node", F.struct("meets", "node")).alias("centre"))
    met = buckets.join(centre.hint("merge"), "key").where("node <> centre")
    often = met.repartition("node").groupBy("node", "centre").agg(F.count("*").alias("times"))
    links = [linked(often.groupBy("node").agg(F.max_by("centre", F.struct("times", "centre")).alias("centre")))]

    def looked_at(turn: int) -> Column:
        return (F.col("c") > FEW) & (F.pmod(F.xxhash64("key"), F.lit(among)) == turn % among)

    def some(turn: int) -> Column:
        picked = [F.min_by("node", F.struct(F.xxhash64("node", "key", F.lit(turn), F.lit(p)), "node")) for p in range(picks)]
        return F.array_distinct(F.array(*picked)).alias("centres")

    if rounds > 1:
        have = links[0].select(F.explode(F.array("u", "v")).alias("node")).distinct()
        alone = buckets.select("key", "node").join(have.hint("merge"), "node", "left_anti")
        other = buckets.groupBy("key").agg(some(1), F.count("*").alias("c")).where(looked_at(1))
        links.append(linked(alone.join(other.hint("merge"), "key").select("node", F.explode("centres").alias("centre")).where("node <> centre")))
    labelled = _label(buckets, links)
    for turn in range(2, rounds):
        if labelled.isEmpty():
            break
        groups = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"), some(turn))
        main = groups.groupBy("key").agg(F.max_by(F.struct("comp", "centres"), F.struct("c", "comp")).alias("main"), F.sum("c").alias("c")).where(looked_at(turn))
        outside = labelled.join(main.hint("merge"), "key").where("comp <> main.comp").select("node", F.explode("main.centres").alias("centre"))
        links.append(linked(outside))
        before, labelled = labelled, _label(labelled.select("key", "node"), links)
        drop(before)

    if last is not None:
        links.append(last(labelled))
        out = components(_all(links))
        drop(labelled, *links)
        return out
    groups = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = groups.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    member = labelled.join(main.hint("merge"), "key").withColumnRenamed("node", "m")
    x = member.where("comp <> main").select("key", F.col("m").alias("a"), F.col("comp").alias("comp_a")).join(side("a").hint("merge"), "a")
    y = member.select("key", F.col("m").alias("b"), F.col("comp").alias("comp_b"), "main").join(side("b").hint("merge"), "b")
    rest = x.join(
        y.hint("merge"),
        (x["key"] == y["key"])
        & (F.col("comp_a") != F.col("comp_b"))
        & ((F.col("comp_b") == F.col("main")) | (F.col("a") < F.col("b")))
        & near(of("a"), of("b"))
        & first(x["key"], of("a"), of("b"))
        & close(of("a"), of("b")),
    ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if not labelled.isEmpty():
        last = cut(rest.distinct())
        links.append(cut(confirm(last)))
        drop(last)
    out = components(_all(links))
    drop(labelled, *links)
    return out


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _label(buckets: DataFrame, links: list[DataFrame]) -> DataFrame:
    """(key, node, comp) of the buckets whose members still lie in different components."""
    comp = components(_all(links))
    labelled = buckets.join(comp.withColumnRenamed("component", "comp").hint("merge"), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    spread = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    out = cut(labelled.join(spread.hint("merge"), "key", "left_semi"))
    drop(comp)
    return out
