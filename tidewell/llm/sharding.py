"""Placement by a hierarchical weighted hash tree (DataFrame operations only).

A key descends from the root through region and rack to a shard.  At each level every
child draws -ln(u) / weight, where u in (0, 1) is a hash of key and child, and the
smallest draw wins, so a child wins in proportion to its weight.  A draw depends on
the child's own weight only: when weights change below one child, keys move only into
or out of that child's subtree, and all other subtrees keep theirs.

Shards are added as a new region, rack or shard of the tree.  A shard that comes as a
region of its own changes no other weight, so rows move to it and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import gapless_rank

#: region -> rack -> {shard number: weight}
Tree = dict[str, dict[str, dict[int, float]]]
#: Row numbering is spread over this many buckets of a shard.
BUCKETS = 1024


def default_tree(shards: int = 8, racks: int = 2, per_rack: int = 2) -> Tree:
    """Regions of ``racks`` racks of ``per_rack`` shards of weight 1; what is left over forms a last, smaller region."""
    tree: Tree = {}
    for s in range(shards):
        region, at = divmod(s, racks * per_rack)
        tree.setdefault(f"g{region}", {}).setdefault(f"g{region}/r{at // per_rack}", {})[s] = 1.0
    return tree


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    new = 1 + max((s for racks in tree.values() for rack in racks.values() for s in rack), default=-1)
    name = f"g{len(tree)}"
    while name in tree:
        name += "+"
    return {**tree, name: {f"{name}/r0": {new: weight}}}


def uniform(key: Column, node: str) -> Column:
    """Hash of key and node, strictly between 0 and 1: the first 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(node), key)), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def _descend(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    live = [(name, weight, value) for name, weight, value in children if weight > 0]
    if len(live) == 1:
        return live[0][2]
    draws = [F.struct((-F.log(uniform(key, name)) / weight).alias("d"), F.lit(i).alias("i")) for i, (name, weight, _) in enumerate(live)]
    winner = F.least(*draws)["i"]
    out = live[-1][2]
    for i in range(len(live) - 2, -1, -1):
        out = F.when(winner == i, live[i][2]).otherwise(out)
    return out


def place(key: Column, tree: Tree) -> Column:
    """Shard number for ``key`` (a string that is not null)."""
    regions = []
    for region, racks in tree.items():
        inside = [(rack, sum(shards.values()), _descend(key, [(f"{rack}/s{s}", w, F.lit(s)) for s, w in shards.items()])) for rack, shards in racks.items()]
        regions.append((region, sum(w for _, w, _ in inside), _descend(key, inside)))
    return _descend(key, regions)


def shard_documents(docs: DataFrame, tree: Tree | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id_col, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the id and the tree decide.  ``size`` is the UTF-8 length of the
    text (none if null) plus 1, ``text_crc32`` the CRC of those bytes (0 if null),
    ``slot`` numbers the rows of a shard 0, 1, 2 ..., ``grown_shard`` is the shard after
    ``grow``.  Null ids all take the place of the key "null"; rows that repeat an id
    share its shard.  Slots are dealt out by bucket of (id, text), then id, so no task
    holds a shard.  Other columns are ignored.
    """
    tree = default_tree() if tree is None else tree
    key = F.coalesce(F.col("_id").cast("string"), F.lit("null"))
    rows = docs.select(F.col(id_col).alias("_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"))
    rows = rows.select("*", F.lit("key").alias("law"), place(key, tree).cast("int").alias("shard"), place(key, grow(tree)).cast("int").alias("grown_shard"))
    bucket = F.conv(F.substring(F.md5(F.concat_ws("|", key, F.col("text_crc32").cast("string"))), 14, 5), 16, 10).cast("long") % BUCKETS
    ranked = gapless_rank(rows, "shard", [F.col("_id"), F.col("text_crc32"), F.col("size")], bucket, "slot")
    return ranked.select(F.col("_id").alias(id_col), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
