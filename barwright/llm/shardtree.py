"""Sharding by a weighted hash tree: regions hold racks, racks hold shards.

A document descends by levels. At each node it draws one waiting time for every child, exponential at the
rate of the child's weight, from a hash of its id and the child's path; the child with the least draw is
taken, so each is taken in proportion to its weight, and only the nodes along the way are looked at. A
node's time is its parent's time plus what its draw exceeds the least of its siblings' draws by; so the
time of every leaf is as if it had waited for itself alone, while the least of them is known from the top.

A leaf may be reserved: it weighs in its nodes' weights but takes no documents. A node that has reserved
leaves below it can't be judged by its own time; the times of its parts are compared instead, level by
level, along the one path where shards still end. When a reserved leaf opens, no other time changes, and
the new shard takes documents only into itself. A changed weight changes the draws of its own ancestors
only: a heavier subtree takes documents into itself, a lighter one gives some away, and all other
movement is within it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barwright.llm import shared


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0
    reserved: bool = False


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """Shards 0 to shards - 1 of weight 1, filling racks and regions in turn; what the last region has
    left is reserved."""
    whole = -(-shards // (per_rack * racks)) * per_rack * racks
    return [Leaf(s // (per_rack * racks), s // per_rack, s, 1.0, s >= shards) for s in range(whole)]


def with_one_more(tree: list[Leaf], weight: float = 1.0) -> tuple[list[Leaf], int]:
    """The tree with its first reserved leaf opened, or else a region of its own, and that shard."""
    for k, leaf in enumerate(tree):
        if leaf.reserved:
            return [*tree[:k], replace(leaf, reserved=False), *tree[k + 1 :]], leaf.shard
    shard = max(leaf.shard for leaf in tree) + 1
    return [*tree, Leaf(max(x.region for x in tree) + 1, max(x.rack for x in tree) + 1, shard, weight)], shard


def _draw(key: Column, path: tuple[int, ...], weight: float) -> Column:
    name = F.lit("/".join(map(str, path)))
    share = (F.shiftrightunsigned(F.xxhash64(name, key), 11) + F.lit(0.5)) / F.lit(2.0**53)
    return -F.ln(share) / F.lit(float(weight))


def _children(leaves: list[Leaf], level: int) -> dict[int, list[Leaf]]:
    found: dict[int, list[Leaf]] = {}
    for leaf in leaves:
        found.setdefault((leaf.region, leaf.rack, leaf.shard)[level], []).append(leaf)
    return found


def _least(options: list[tuple[Column, Column]]) -> Column:
    """The result of the option with the least time, which alone is computed."""
    if len(options) == 1:
        return options[0][1]
    best = F.least(*(t for t, _ in options))
    out = options[-1][1]
    for time, result in reversed(options[:-1]):
        out = F.when(time == best, result).otherwise(out)
    return out


def _parts(key: Column, leaves: list[Leaf], path: tuple[int, ...], time: Column, level: int) -> list[tuple[Column, Column]]:
    """(time, shard) of the parts of a node: one of a node without reserved leaves, else those below it."""
    if all(x.reserved for x in leaves):
        return []
    if level == 3 or not any(x.reserved for x in leaves):
        return [(time, _inside(key, leaves, path, level))]
    draws = {n: _draw(key, (*path, n), sum(x.weight for x in below)) for n, below in _children(leaves, level).items()}
    least = F.least(*draws.values()) if len(draws) > 1 else next(iter(draws.values()))
    parts = []
    for n, below in _children(leaves, level).items():
        parts += _parts(key, below, (*path, n), time + (draws[n] - least), level + 1)
    return parts


def _inside(key: Column, leaves: list[Leaf], path: tuple[int, ...], level: int) -> Column:
    """The shard within a node without reserved leaves: the child with the least draw, level by level."""
    if level == 3:
        return F.lit(leaves[0].shard)
    nodes = _children(leaves, level)
    return _least([(_draw(key, (*path, n), sum(x.weight for x in below)), _inside(key, below, (*path, n), level + 1)) for n, below in nodes.items()])


def descend(key: Column, tree: list[Leaf]) -> Column:
    """The shard of each key."""
    options = []
    for n, below in _children(tree, 0).items():
        options += _parts(key, below, (n,), _draw(key, (n,), sum(x.weight for x in below)), 1)
    return _least(options)


def assign(
    docs: DataFrame, shards: int = 8, tree: list[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the id and the shards decide alone; grown_shard is the shard if there were one
    more. size is the text's UTF-8 bytes plus 1, a null text having none, and its CRC that of nothing;
    texts of any length are measured whole. Null ids all draw alike. Repeated rows share a shard and have
    slots of their own. Other columns, whatever their names, are ignored; an empty table has no rows.
    Slots are gapless from 0 within a shard: rows are numbered within each input partition and shard, and
    the partitions' counts, a few numbers each, are summed up in order; so no shard's rows meet in one
    task.
    """
    tree = tree or even_tree(shards)
    grown, _ = with_one_more(tree)
    text = shared.text_bytes(text_col)
    at = F.monotonically_increasing_id()
    key = F.col(id_col)
    rows = shared.stored(
        docs.select(
            key,
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            descend(key, tree).alias("shard"),
            descend(key, grown).alias("grown_shard"),
            at.alias("_at"),
        ).withColumn("_part", F.shiftright("_at", 33))
    )
    counts = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("shard", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    nth = F.row_number().over(W.partitionBy("shard", "_part").orderBy("_at")) - 1
    return (
        rows.withColumn("_nth", nth)
        .join(before, ["shard", "_part"])
        .select(
            id_col,
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("_before") + F.col("_nth")).alias("slot"),
            "grown_shard",
        )
    )
