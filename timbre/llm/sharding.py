"""Sharding by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards, shards have weights. From the root down, a key draws a number
for each child from a hash of the key and the child's path, -ln(u) / weight, and goes to the child
with the least: each gets keys in proportion to its weight. Draws of children whose weight stays
don't change, so rows move only into or out of subtrees whose weights change. A cluster grows by a
region: then one more shard takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbre.llm.common import checkpointed, schema

#: A tree maps names of regions to racks, those to shards, and those (shard numbers) to weights.
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def even_tree(shards: int, racks: int = 2, regions: int = 2) -> dict:
    """``shards`` of weight 1, dealt to so many racks in each of so many regions."""
    tree: dict = {}
    for s in range(shards):
        rack = s * racks * regions // shards
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack % racks}", {})[s] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> dict:
    """The tree with one more shard, in a region of its own."""
    return {**tree, f"region-of-{shard}": {"rack0": {shard: weight}}}


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, Mapping) else float(node)


def descend(key: Column, tree, path: str = "") -> Column:
    """Number of the shard that a key belongs to. Its text decides, so whole numbers of any width agree."""
    children = {str(name): (name, node, w) for name, node in sorted(tree.items(), key=lambda x: str(x[0])) if (w := _weight(node)) > 0}
    if not children:
        raise ValueError(f"no shard with a weight under {path or 'the root'}")
    draws = []
    for name, (_, _, w) in children.items():
        bits = F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(f"{path}/{name}")), 11)
        draws.append(F.struct((-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(w)).alias("draw"), F.lit(name).alias("child")))
    chosen = F.array_min(F.array(*draws))["child"] if len(draws) > 1 else F.lit(next(iter(children)))
    out = None
    for name, (shard, node, _) in children.items():
        below = descend(key, node, f"{path}/{name}") if isinstance(node, Mapping) else F.lit(int(shard))
        out = F.when(chosen == name, below) if out is None else out.when(chosen == name, below)
    return out


def numbered(rows: DataFrame, group: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... within each value of ``group``, in any order.

    A task numbers what it has; a sum over the counts of the tasks before gives the rest. No group
    is gathered: the only rows moved by group are one per task. The rows are checkpointed in
    between, so that numbers stay when an executor is lost.
    """
    out = schema(rows, rows.columns, "_part int, _rank long")
    at = rows.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            values = batch.column(at).to_numpy(zero_copy_only=False)
            rank = np.zeros(len(values), np.int64)
            for v in np.unique(values):
                here = np.flatnonzero(values == v)
                rank[here] = seen.get(v, 0) + np.arange(len(here))
                seen[v] = seen.get(v, 0) + len(here)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(values), part, np.int32)), pa.array(rank)], names=out.names)

    local = checkpointed(rows.mapInArrow(run, out))
    before = F.sum("n").over(Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    counts = local.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).agg(F.count("*").alias("n"))
    firsts = counts.select("_group", "_of", F.coalesce(before, F.lit(0)).alias("_first"))
    joined = local.join(firsts, (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_of")))
    return joined.select(*rows.columns, (F.col("_rank") + F.col("_first")).alias(name))


def shard(docs: DataFrame, tree: Tree, more: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``size`` (UTF-8 bytes and 1), ``text_crc32``, ``law`` ('key'), ``shard``, ``slot``
    (gapless from 0 in each shard) and ``grown_shard``, the shard in the tree ``more``.

    The id and the tree alone decide, so rows of one id, and all rows without id, share a shard.
    Null texts count as empty. Texts aren't moved. Other columns play no part; an empty table gives
    an empty result.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        docs[id_col], (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), descend(docs[id_col], tree).alias("shard"), descend(docs[id_col], more).alias("grown_shard")
    )
    return numbered(rows, "shard", "slot").select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
