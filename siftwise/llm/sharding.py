"""Hierarchical weighted hash tree: region, rack and shard by weighted hash draws.

At each level every child draws ln(u) / weight, where u is a hash of the key and the child's
name alone, and the largest draw wins. A child's chance is in proportion to its weight, and a
change of one weight changes that child's draw only: rows move into it or out of it, within
the subtree whose weights changed. Capacity is added as new subtrees, so that an added shard
takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwise.llm.ordering import in_order, with_ranks
from siftwise.llm.scratch import Scratch

#: Bytes that a row takes besides its text.
ROW_OVERHEAD = 16


@dataclass(frozen=True)
class Node:
    """A shard (no children) or an inner node, whose weight is the sum of its children's."""

    name: str
    own_weight: float = 1.0
    shard: int = -1
    children: tuple[Node, ...] = field(default=())

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def uniform_tree(shards: int, racks: int = 8, regions: int = 2) -> Node:
    """Shards 0..n-1 of weight 1, dealt in runs to racks, the racks in runs to regions."""
    per_rack = -(-shards // racks)
    racks_made = [
        Node(f"rack{r}", children=tuple(Node(f"shard{s}", shard=s) for s in range(r * per_rack, min(shards, (r + 1) * per_rack))))
        for r in range(racks)
        if r * per_rack < shards
    ]
    per_region = -(-len(racks_made) // regions)
    return Node(
        "root",
        children=tuple(
            Node(f"region{g}", children=tuple(racks_made[g * per_region : (g + 1) * per_region]))
            for g in range(regions)
            if g * per_region < len(racks_made)
        ),
    )


def grow(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    leaf = Node(f"shard{shard}", own_weight=weight, shard=shard)
    region = Node(f"region-of-{shard}", children=(Node(f"rack-of-{shard}", children=(leaf,)),))
    return Node(tree.name, children=(*tree.children, region))


def _draw(key: Column, node: Node) -> Column:
    # 53 bits of the hash, never zero
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11)
    return F.ln((bits.cast("double") + F.lit(0.5)) / F.lit(2.0**53)) / F.lit(node.weight)


def shard_of(key: Column, tree: Node) -> Column:
    """The shard of a key. A null key is one key of its own. Weights must be above zero."""
    if not tree.children:
        return F.lit(tree.shard)
    if len(tree.children) == 1:
        return shard_of(key, tree.children[0])
    draws = [F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(tree.children)]
    won = F.greatest(*draws)["i"]
    if all(not c.children for c in tree.children):
        return F.element_at(F.array(*[F.lit(c.shard) for c in tree.children]), won + 1)
    # only the winner's subtree is descended: the branches of a CASE are lazy
    case = F.when(won == 0, shard_of(key, tree.children[0]))
    for i, c in enumerate(tree.children[1:], 1):
        case = case.when(won == i, shard_of(key, c))
    return case


def shard_documents(docs: DataFrame, tree: Node, added: int) -> DataFrame:
    """Law `key`: doc_id and the tree decide the shard.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard once shard
    number `added` has joined). A null text counts as empty, with no bytes; a null doc_id is a key
    like any other; repeated rows each get a slot; a very long text is hashed as a whole; an empty table gives no rows; columns of docs
    besides doc_id and text are not read. Slots are gapless from 0 in each shard, in order of doc_id (null first) and a hash of the text, so
    that reruns agree.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    slim = scratch.save(
        docs.select(
            "doc_id",
            (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + ROW_OVERHEAD).alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.lit("key").alias("law"),
            shard_of(F.col("doc_id"), tree).cast("int").alias("shard"),
            shard_of(F.col("doc_id"), grow(tree, added)).cast("int").alias("grown_shard"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_hash"),
        )
    )
    ordered = in_order(slim, scratch, "shard", "doc_id", "_text_hash", "size", "text_crc32")
    return with_ranks(ordered, ["shard"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, tree: Node, path: str, rows_per_file: int = 1_000_000) -> None:
    """Writes whole rows into a folder per shard. Large shards get several files."""
    placed = docs.withColumn("_shard", shard_of(F.col("doc_id"), tree))
    placed.write.partitionBy("_shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
