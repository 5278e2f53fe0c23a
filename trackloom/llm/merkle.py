"""Merkle manifest of a table: a persistent tree per group, a tree of their roots, proofs and versions.

Rows of a group are leaves in the order of their keys; on every level two consecutive nodes, the last
one possibly alone, become the hash of both. The roots of the groups, in order, form the top tree.

The trees are cut into aligned blocks of 2^``BITS`` nodes. A block is built in one task as an immutable
tree; its root is a node of the level of blocks above, and so on. Proofs are made on the way down:
every block adds the siblings inside it to those above it. A changed leaf makes a version of its
own by path copying: new nodes for the ancestors of that leaf inside its block, all others shared with
the first version; above the block the version goes on with one new node for each level beside the
siblings that the block was given, so no task holds the versions of more than one block.

Places in the order are found without one sorted group: rows are dealt by ranges of (group, key),
numbered inside each written part, and lifted by the rows of earlier parts.

Edge cases: a null group comes first and differs from an empty one; null keys come first; equal keys are
ordered by their leaf, so repeated rows are leaves of their own; null fields are written ``-``; an empty
table gives no rows; a text of any length counts as one field; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import remainder, rows_of, sliced, written

BITS = 10
#: A step of a path: the side on which the sibling stands and its hash, or ``-`` and a filler.
ALONE = "-" * 65
STEP = len(ALONE)

Node = tuple  # (hash, left, right); a leaf has no children


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parent(left: Node, right: Node | None) -> Node:
    return digest(left[0] + (right[0] if right else "")), left, right


def build(leaves: Sequence[str], height: int) -> Node:
    """Tree over ``leaves`` of exactly ``height`` levels above them."""
    nodes: list[Node] = [(leaf, None, None) for leaf in leaves]
    for _ in range(height):
        nodes = [parent(nodes[i], nodes[i + 1] if i + 1 < len(nodes) else None) for i in range(0, len(nodes), 2)]
    (root,) = nodes
    return root


def put(root: Node, height: int, index: int, leaf: str) -> Node:
    """A version of the tree with another leaf: its ancestors are copied, every other node is shared."""
    if not height:
        return leaf, None, None
    _, left, right = root
    if index >> (height - 1) & 1:
        return parent(left, put(right, height - 1, index, leaf))
    return parent(put(left, height - 1, index, leaf), right)


def leaf_at(root: Node, height: int, index: int) -> str:
    for level in range(height - 1, -1, -1):
        root = root[2] if index >> level & 1 else root[1]
    return root[0]


def path(root: Node, height: int, index: int) -> str:
    """Siblings of a leaf and of its ancestors, from the leaf up."""
    steps = []
    for level in range(height - 1, -1, -1):
        _, left, right = root
        if index >> level & 1:
            steps.append("l" + left[0])
            root = right
        else:
            steps.append("r" + right[0] if right else ALONE)
            root = left
    return "".join(reversed(steps))


def lift(node: str, steps: str) -> str:
    """Root above ``node`` when the other nodes are those of ``steps``."""
    for at in range(0, len(steps), STEP):
        side, other = steps[at], steps[at + 1 : at + STEP]
        node = digest(node if side == "-" else other + node if side == "l" else node + other)
    return node


def folded_root(tree: Node, height: int, index: int, changed: str | None, steps: str) -> str:
    """Root recomputed from a leaf and the siblings of ``steps``, or from the leaf of its own version.

    A changed leaf is folded through the version that path copying makes of the block, then above it.
    An unchanged one is folded over all its siblings, so a wrong step shows in its root too.
    """
    if changed is None:
        return lift(leaf_at(tree, height, index), steps)
    return lift(put(tree, height, index, changed)[0], steps[height * STEP :])


def height_of(nodes: int, bits: int) -> int:
    """Levels inside a block of a tree that has ``nodes`` nodes at the level of the block's leaves."""
    return min(bits, (nodes - 1).bit_length())


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with ``place`` and ``nodes``: their number within ``lane`` by ``order``, from 0, and the lane's size.

    ``order`` must tell all rows of a lane apart, and ``rows`` must be a written table.
    """
    lane = rows.columns.index("lane")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            places = []
            for name in batch.column(lane).to_pylist():
                places.append(seen.get(name, 0))
                seen[name] = places[-1] + 1
            columns = [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "local"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", part int, local bigint"
    keys = ["lane", *order]
    dealt = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, schema), "numbered")
    parts = dealt.groupBy("lane", "part").agg(F.count("*").alias("rows"), F.min(F.struct(*order)).alias("first"))
    before = Window.partitionBy("lane").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "lane",
        "part",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("lift"),
        F.sum("rows").over(Window.partitionBy("lane")).alias("nodes"),
    )
    return dealt.join(parts, ["lane", "part"]).withColumn("place", F.col("local") + F.col("lift")).drop("part", "local", "lift")


def blocks(nodes: DataFrame, payload: Sequence[str], bits: int) -> DataFrame:
    """One row per aligned block: its nodes in order, the size of its level, and its root."""
    block = F.shiftright("place", bits).alias("block")
    inside = F.array_sort(F.collect_list(F.struct("place", "hash", *payload)))
    rows = nodes.groupBy("lane", block).agg(F.first("nodes").alias("nodes"), inside.alias("items"))

    def crown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            roots = []
            for n, items in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                roots.append(build(items.values.field("hash").to_pylist(), height_of(n, bits))[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots)], names=[*batch.schema.names, "top"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", top string"
    return written(rows.mapInArrow(crown, schema), "blocks")


def forest(nodes: DataFrame, payload: Sequence[str], bits: int) -> tuple[list[DataFrame], DataFrame]:
    """Block tables from the leaves up, and (lane, hash) of every lane's root."""
    levels = [blocks(nodes, payload, bits)]
    while levels[-1].where("block > 0").limit(1).count():
        up = levels[-1].select(
            "lane",
            F.col("block").alias("place"),
            F.shiftright(F.col("nodes") + ((1 << bits) - 1), bits).alias("nodes"),
            F.col("top").alias("hash"),
        )
        levels.append(blocks(up, (), bits))
    return levels, levels[-1].select("lane", F.col("top").alias("hash"))


def descend(level: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """Per node of a level, in the lane's order: (lane, block, steps, subroot, root) for the block below it."""
    rows = level.join(above, ["lane", "block"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 8):
            out = []
            for lane, block, n, items, steps, subroot, root in rows_of(batch, "lane", "block", "nodes", "items", "steps", "subroot", "root"):
                height = height_of(n, bits)
                tree = build([x["hash"] for x in items], height)
                out += [(lane, (block << bits) + i, path(tree, height, i) + steps, subroot, root) for i in range(len(items))]
            names = ("lane", "block", "steps", "subroot", "root")
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(down, "lane string, block bigint, steps string, subroot string, root string")


def leaf_hash(*fields: str | Column) -> Column:
    """Hash of fields, each written as its size in bytes, a colon and its text; null as ``-``."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def manifest(rows: DataFrame, group: str, key: str, leaf: Column, changed: Column, bits: int = BITS) -> DataFrame:
    """(key, leaf, subroot, root, steps, folded_root) of every row.

    ``leaf`` is the row's hash, and ``changed`` the hash that a version of its own has at its place, or null.
    ``steps`` are the siblings up to the root of all, ``folded_root`` is the root of the row's version.
    """
    # A lane is never null and sorts as its group does, null first.
    lane = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("lane")
    leaves = rows.select(lane, F.col(key).alias("key"), leaf.alias("hash"), changed.alias("changed"), F.monotonically_increasing_id().alias("row"))
    kind = dict(leaves.dtypes)["key"]
    nodes = numbered(written(leaves, "leaves"), ("key", "hash", "row"))
    levels, subroots = forest(nodes, ("key", "changed"), bits)
    tops = subroots.select(F.lit("").alias("lane"), F.col("lane").alias("own"), "hash")
    top_levels, top = forest(numbered(written(tops, "subroots"), ("own",)), ("own",), bits)

    steps = top.select("lane", F.lit(0).cast("long").alias("block"), F.lit("").alias("steps"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    for level in reversed(top_levels):
        steps = descend(level, steps, bits)
    owners = top_levels[0].select(F.explode("items").alias("item")).select(
        F.col("item.place").alias("block"), F.col("item.own").alias("own"), F.col("item.hash").alias("subroot")
    )
    steps = owners.join(steps.drop("lane", "subroot"), "block").select(
        F.col("own").alias("lane"), F.lit(0).cast("long").alias("block"), "steps", "subroot", "root"
    )
    for level in reversed(levels[1:]):
        steps = descend(level, steps, bits)
    ready = levels[0].join(steps, ["lane", "block"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 8):
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                ((n, above, subroot, root),) = rows_of(one, "nodes", "steps", "subroot", "root")
                items = one.column(one.schema.get_field_index("items"))[0].values
                hashes, others = items.field("hash").to_pylist(), items.field("changed").to_pylist()
                height = height_of(n, bits)
                tree = build(hashes, height)
                paths = [path(tree, height, i) + above for i in range(len(hashes))]
                folded = [folded_root(tree, height, i, other, steps) for i, (other, steps) in enumerate(zip(others, paths, strict=True))]
                same = [pa.array([x] * len(hashes)) for x in (subroot, root)]
                yield pa.RecordBatch.from_arrays(
                    [items.field("key"), pa.array(hashes), *same, pa.array(paths), pa.array(folded)],
                    names=["key", "leaf", "subroot", "root", "steps", "folded_root"],
                )

    return ready.mapInArrow(finish, f"key {kind}, leaf string, subroot string, root string, steps string, folded_root string")


def proof(steps: Column) -> Column:
    """Hash of the siblings of ``steps``, from the leaf up."""
    bare = F.regexp_replace(F.regexp_replace(steps, "-{65}", ""), "[lr]", "")
    return F.sha2(F.encode(bare, "UTF-8"), 256)


def report(documents: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text") -> DataFrame:
    """Leaf, roots, proof and the root of the version in which a seventh of the rows has one more in ``n_chars``."""
    own = leaf_hash(doc_id, source, lang, n_chars, text)
    other = F.when(remainder(doc_id, 7) == 0, leaf_hash(doc_id, source, lang, F.col(n_chars) + 1, text))
    found = manifest(documents, lang, doc_id, own, other)
    return found.select(
        F.col("key").alias(doc_id),
        "leaf",
        "subroot",
        "root",
        proof(F.col("steps")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
