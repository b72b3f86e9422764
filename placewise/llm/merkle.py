"""Merkle manifest of a data set as a persistent tree: every changed leaf makes a version that shares what it does not touch.

A leaf is the digest of one row. The leaves of a source, in order of doc_id, form a tree in which every `FAN` consecutive
nodes have one parent; the tops of the sources, in order of the source, form another tree, whose top is the root.

1. Leaves are ranked inside their source over range partitions; a source with a third of all rows spreads over many.
2. Aligned blocks of `FAN ** LEVELS` nodes are the units of work: a task builds the levels of one block and hands its top
   on, which is a node of the next round, dealt to blocks alike. A round divides the nodes by 4,096, so two or three
   rounds reach the tops, and no task holds more than a block.
3. From the top down, each block learns its path: the siblings on the left and right of each of its ancestors. There is
   one path for a block, not for a leaf.
4. A version of the tree copies the nodes between its changed leaf and the top of the block, looks all others up in the
   block that it shares with the other versions, and continues along the block's path through the upper versions.

Digests are lowercase hex SHA-256 over their inputs, concatenated; digests go in as hex text. Equal doc_ids of a source are
ordered by their leaves, a null doc_id comes first, and so does the null source. Null values count as `-`, which no text
equals, as values carry their length. Empty tables have no root and no versions. Very long texts are hashed in the JVM and do
not reach the blocks. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from placewise.llm.storage import shipped, stored

FAN = 16
#: Levels of a block; a block has FAN ** LEVELS nodes at most.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Siblings of an ancestor, each side end to end as hex text.
_PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 length, a colon and the value, `-` if null."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, change: Column | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """doc_id, source, leaf, and `changed`: the leaf after the text has become `change`; null where that is null."""
    held = [F.col(f"`{f}`") for f in fields]
    replaced = [F.lit(None).cast("string") if change is None else change if f == "text" else F.col(f"`{f}`") for f in fields]
    changed = F.lit(None).cast("string") if change is None else F.when(change.isNotNull(), leaf(replaced))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(held).alias("leaf"), changed.alias("changed"))


def ranked(rows: DataFrame, group: Column, order: Sequence[str], name: str) -> DataFrame:
    """The rows with grp, pos (from 0 in the group, by `order`) and size (rows of the group), stored.

    Rows are dealt by ranges of (group, order) and numbered inside their range; what stands before a range comes from a
    table of one row per range and group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["grp", *order]
    dealt = rows.withColumn("grp", group).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("turn")), name)
    heads = dealt.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("turn").alias("first"))
    own = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = heads.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(own).alias("size"))
    return dealt.join(starts, ["grp", "part"]).withColumn("pos", F.col("turn") + F.col("shift")).drop("part", "turn", "shift")


def blocked(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / FAN**height).cast("bigint"))


def levels_of(size: int, height: int) -> int:
    """Levels that a block builds: all of them, or as many as leave one node of a group that fits into the block."""
    count = 0
    while size > 1 and count < height:
        size, count = -(-size // FAN), count + 1
    return count


class Version:
    """A version of a block's tree: its own copies of some nodes, and all others from the tree it was made from."""

    def __init__(self, base: list[list[str]] | Version, copies: dict[tuple[int, int], str] | None = None):
        self.base, self.copies = base, copies or {}

    @classmethod
    def built(cls, nodes: list[str], levels: int) -> Version:
        made = [nodes]
        for _ in range(levels):
            below = made[-1]
            made.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
        return cls(made)

    def node(self, level: int, at: int) -> str:
        found = self.copies.get((level, at))
        if found is not None:
            return found
        return self.base.node(level, at) if isinstance(self.base, Version) else self.base[level][at]

    def width(self, level: int) -> int:
        return self.base.width(level) if isinstance(self.base, Version) else len(self.base[level])

    def levels(self) -> int:
        return self.base.levels() if isinstance(self.base, Version) else len(self.base) - 1

    def run(self, level: int, at: int) -> list[str]:
        """The node and its siblings, in order."""
        first = at // FAN * FAN
        return [self.node(level, i) for i in range(first, min(first + FAN, self.width(level)))]

    def top(self) -> str:
        return self.node(self.levels(), 0)

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """Those on the left and on the right of each ancestor of leaf `at` below the top, from the leaf on."""
        found = []
        for level in range(self.levels()):
            run, place = self.run(level, at), at % FAN
            found.append(("".join(run[:place]), "".join(run[place + 1 :])))
            at //= FAN
        return found

    def replaced(self, at: int, leaf: str) -> Version:
        """The version in which leaf `at` is another one: a copy of the leaf and of its ancestors."""
        version = Version(self, {(0, at): leaf})
        for level in range(self.levels()):
            version.copies[level + 1, at // FAN] = digest("".join(version.run(level, at)))
            at //= FAN
        return version


def folded(node: str, path: Sequence[tuple[str, str]]) -> str:
    """The root above a node, from the siblings of its ancestors."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _block(nodes: pa.Table, height: int) -> Version:
    """The tree of a block's nodes, which are in order."""
    return Version.built(nodes.column("node").to_pylist(), levels_of(nodes.column("size")[0].as_py(), height))


def _tops(height: int):
    def tops(key: tuple, nodes: pa.Table) -> pa.Table:
        nodes = _in_order(nodes)
        above = -(-nodes.column("size")[0].as_py() // FAN**height)
        return pa.table({"grp": [key[0].as_py()], "pos": [key[1].as_py()], "size": [above], "node": [_block(nodes, height).top()]})

    return tops


def _path_of(above: pa.Table) -> list[tuple[str, str]]:
    return [(p["left"], p["right"]) for p in above.column("path")[0].as_py()]


def _paths(height: int):
    def paths(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, upper = _in_order(nodes), _path_of(above)
        tree = _block(nodes, height)
        found = [[{"left": a, "right": b} for a, b in tree.siblings(at) + upper] for at in range(nodes.num_rows)]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({"grp": nodes.column("grp"), "pos": nodes.column("pos"), "path": pa.array(found, kind)})

    return paths


def _with_paths(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """grp, pos and path of the nodes, from the paths of their blocks."""
    pairs = nodes.groupBy("grp", "block").cogroup(above.groupBy("grp", "block"))
    return pairs.applyInArrow(_paths(height), f"grp string, pos bigint, path {_PATH}")


@dataclass
class Tree:
    """The rounds of blocks, from the leaves up, and the tops (grp, node) of all groups."""

    rounds: list[DataFrame]
    tops: DataFrame
    height: int

    def paths(self, above: DataFrame) -> DataFrame:
        """(grp, block, path) of the blocks of leaves, from paths (grp, path) of the tops."""
        known = above.select("grp", F.lit(0).cast("bigint").alias("block"), "path")
        for nodes in reversed(self.rounds[1:]):
            known = _with_paths(nodes, known, self.height).withColumnRenamed("pos", "block")
        return known


def tree(leaves: DataFrame, height: int = LEVELS) -> Tree:
    """The tree of every group of (grp, pos, size, node); a round of blocks at a time until one node a group is left."""
    shipped(leaves.sparkSession)
    rounds, nodes = [], blocked(leaves, height)
    while True:
        rounds.append(nodes)
        blocks = nodes.select("grp", "block", "pos", "size", "node").groupBy("grp", "block")
        nodes = blocked(stored(blocks.applyInArrow(_tops(height), "grp string, pos bigint, size bigint, node string"), "merkle-tops"), height)
        if (nodes.agg(F.max("size")).first()[0] or 1) == 1:
            return Tree(rounds, nodes.select("grp", "node"), height)


def _of_source(source: Column) -> Column:
    """The source as a group name that is never null: null first, then by bytes."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


@dataclass
class Manifest:
    """Leaves with places, subroots (grp, node), the root (None of an empty table), and per block its path and subroot."""

    leaves: DataFrame
    subroots: DataFrame
    root: str | None
    paths: DataFrame
    height: int


def manifest(rows: DataFrame, height: int = LEVELS) -> Manifest:
    """The tree over (doc_id, source, leaf, changed), in blocks of `height` levels; the height changes no digest."""
    placed = ranked(rows, _of_source(F.col("source")), ["doc_id", "leaf"], "merkle-leaves").withColumnRenamed("leaf", "node")
    sources = tree(placed, height)
    # one node a source: ranked like the leaves, as their number has no bound
    listed = blocked(ranked(sources.tops.select(F.col("grp").alias("name"), "node"), F.lit(""), ["name"], "merkle-subroots"), height)
    whole = tree(listed, height)
    top = whole.paths(whole.tops.select("grp", F.array().cast(_PATH).alias("path")))
    above = listed.join(_with_paths(listed, top, height), ["grp", "pos"]).select(F.col("name").alias("grp"), "path")
    root = whole.tops.first()
    paths = sources.paths(above).join(sources.tops.withColumnRenamed("node", "subroot"), "grp")
    return Manifest(blocked(placed, height), sources.tops, root and root["node"], paths, height)


def _versions(height: int, copies: bool):
    def versions(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, upper = _in_order(nodes), _path_of(above)
        tree, originals = _block(nodes, height), nodes.column("node").to_pylist()
        first = nodes.column("pos")[0].as_py()
        beyond = "".join(a + b for a, b in upper)
        proofs, roots, copied = [], [], []
        for at, changed in enumerate(nodes.column("changed").to_pylist()):
            proofs.append(digest("".join(a + b for a, b in tree.siblings(at)) + beyond))
            version = tree.replaced(at, originals[at] if changed is None else changed)
            roots.append(folded(version.top(), upper))
            own = [] if changed is None else sorted(version.copies.items())
            copied.append([{"level": level, "place": place + first // FAN**level, "node": node} for (level, place), node in own])
        subroot = pa.array(above.column("subroot").to_pylist() * nodes.num_rows, pa.string())
        held = {"doc_id": nodes.column("doc_id"), "leaf": nodes.column("node"), "subroot": subroot, "proof_sha256": proofs, "folded_root": roots}
        if copies:
            held["copies"] = pa.array(copied, pa.list_(pa.struct([("level", pa.int32()), ("place", pa.int64()), ("node", pa.string())])))
        return pa.table(held)

    return versions


def versions(made: Manifest, copies: bool = False) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, proof_sha256 (of the untouched tree) and folded_root of the leaf's version.

    A leaf that was not changed has the version in which it replaces itself. `copies` adds the nodes (level, place, node)
    up to the top of its block that a changed leaf's version holds on its own.
    """
    schema = "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string"
    schema += ", copies array<struct<level:int,place:bigint,node:string>>" if copies else ""
    leaves = made.leaves.select("grp", "block", "pos", "size", "doc_id", "node", "changed")
    return leaves.groupBy("grp", "block").cogroup(made.paths.groupBy("grp", "block")).applyInArrow(_versions(made.height, copies), schema)


def audited(rows: DataFrame, height: int = LEVELS) -> DataFrame:
    """Per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, which is false if the change shows."""
    made = manifest(rows, height)
    root = F.lit(made.root).cast("string")
    return versions(made).select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as leaves; where 5 divides the unsigned CRC-32 of the doc_id as text, A-Z of the text is lower-cased."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return audited(leaves(docs, F.when(chosen, F.translate("text", _UPPER, _LOWER))))


def _op13_sql() -> str:
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    fields = lambda text: " || ".join(value(c) for c in FIELDS[:-1]) + " || " + value(text)
    # CRC-32 bit by bit: a byte is taken in, a -1 shifts
    steps = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"list_reduce([4294967295] || {steps}, lambda a, x: CASE WHEN x < 0 THEN xor(a >> 1, 3988292384 * (a & 1)) ELSE xor(a, x) END)"
    grown = lambda name, base: f"""{name}(grp, level, pos, h, size) AS (
    {base}
    UNION ALL
    SELECT grp, level + 1, pos // {FAN}, sha256(string_agg(h, '' ORDER BY pos)), (size + {FAN - 1}) // {FAN} FROM {name} WHERE size > 1 GROUP BY grp, level, pos // {FAN}, size
)"""  # noqa: E731
    beside = lambda name, nodes: f"""{name} AS (
    SELECT a.grp, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM {nodes} a JOIN {nodes} b ON a.grp = b.grp AND a.level = b.level AND a.pos // {FAN} = b.pos // {FAN} WHERE a.size > 1 GROUP BY 1, 2, 3
)"""  # noqa: E731
    climbed = lambda name, base, sides: f"""{name}(place, grp, level, pos, node, proof) AS (
    {base}
    UNION ALL
    SELECT place, u.grp, u.level + 1, u.pos // {FAN}, sha256(l || node || r), proof || l || r FROM {name} u JOIN {sides} s ON u.grp = s.grp AND u.level = s.level AND u.pos = s.pos
)"""  # noqa: E731
    top = lambda name: f"SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY place ORDER BY level DESC) = 1"
    return f"""
WITH RECURSIVE leaf AS (
    SELECT row_number() OVER () AS place, doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS grp, sha256({fields('text')}) AS h,
        CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN sha256({fields(f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS changed FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS size FROM leaf
), {grown('nodes', 'SELECT grp, 0, pos, h, size FROM placed')}, {beside('siblings', 'nodes')}, sources AS (
    SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, h, count(*) OVER () AS size, grp AS name FROM nodes WHERE size = 1
), {grown('uppers', 'SELECT grp, 0, pos, h, size FROM sources')}, {beside('upper_siblings', 'uppers')},
{climbed('climb', "SELECT place, grp, 0, pos, coalesce(changed, h), '' FROM placed", 'siblings')}, tops AS ({top('climb')}),
{climbed('upper_climb', "SELECT place, '', 0, s.pos, node, proof FROM tops t JOIN sources s ON t.grp = s.name", 'upper_siblings')}, roots AS ({top('upper_climb')})
SELECT doc_id, p.h AS leaf, s.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = u.h AS verified
FROM placed p JOIN sources s ON p.grp = s.name JOIN roots r ON r.place = p.place, (SELECT h FROM uppers WHERE size = 1) u
"""


OP13_SQL = _op13_sql()
