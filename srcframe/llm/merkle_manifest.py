"""Merkle manifest of a table, kept as postorder append logs.

Every row is a leaf; the leaves of a source, in order of their key, make a tree of runs of
three; the roots of the sources, in order of the source, make the tree above. A digest is
the lower-case hex SHA-256 of its inputs laid end to end, with digests as hex text.

Leaves get their place by prefix sums over range partitions. They are dealt into aligned
sections of ``FAN ** HEIGHT`` leaves, each a whole subtree, so that sections are built side
by side whatever the size of a source. A builder appends each node when it is complete: a
leaf, then the node above it if it was the last of its run, and so on. The roots of the
sections are the leaves of the next layer, until a tree has one section.

The log needs no index. In a section of m leaves the node (level, i) is complete at its last
leaf ``e = min((i + 1) * 3^level, m) - 1``; before it stand all nodes of its level and of
those below that are complete by ``e``, and the nodes above that were complete before. So
its place is a sum of quotients (:func:`position`), and siblings are read by place. Proofs
are taken layer by layer from the top: a section gets the path of its root, and hands each
of its leaves the siblings on the way.

Defined results: a null key stands first in its source, a null source before all others.
Rows with the same key are ordered by their leaf; equal rows are leaves of their own. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from srcframe.llm.common import stored
from srcframe.operators.ordering import running_total
from srcframe.session import broadcast_if_small

FAN = 3
HEIGHT = 8
SECTION = FAN ** HEIGHT
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value with its number of bytes before it; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def append_log(leaves: list[bytes], height: int) -> list[bytes]:
    """All nodes of a section in the order of their completion."""
    log: list[bytes] = []
    runs: list[list[bytes]] = [[] for _ in range(height)]
    for i, node in enumerate(leaves):
        last = i == len(leaves) - 1
        log.append(node)
        for run in runs:
            run.append(node)
            if len(run) < FAN and not last:
                break
            node = digest(*run)
            run.clear()
            log.append(node)
    return log


def height_of(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    height = 0
    while FAN ** height < leaves:
        height += 1
    return height


def position(level: int, i, leaves: int, height: int):
    """Place in the log of node ``i`` of a level; ``i`` may be an array."""
    import numpy as np

    end = np.minimum((i + 1) * FAN ** level, leaves) - 1
    place = np.full_like(end, -1)
    for other in range(height + 1):
        width = FAN ** other
        if other > level:
            place += end // width
        else:  # the last leaf closes the unfinished runs as well
            place += np.where(end == leaves - 1, -(-leaves // width), (end + 1) // width)
    return place


def _hex_nodes(packed: bytes, level: int, leaves: int, height: int) -> list[bytes]:
    """The nodes of one level, read from the log."""
    import numpy as np

    places = position(level, np.arange(-(-leaves // FAN ** level)), leaves, height)
    return [packed[p * DIGEST:(p + 1) * DIGEST].hex().encode() for p in places.tolist()]


class Section:
    """A section's log, and the path from its root on."""

    def __init__(self, packed: bytes, leaves: int, height: int, above: bytes):
        self.levels = [_hex_nodes(packed, level, leaves, height) for level in range(height)]
        self.above = above

    def path(self, i: int) -> bytes:
        """``left|right`` siblings of leaf ``i`` and of the nodes above it, up to the root, split by ``;``."""
        steps = []
        for nodes in self.levels:
            start = i - i % FAN
            steps.append(b"".join(nodes[start:i]) + b"|" + b"".join(nodes[i + 1:start + FAN]))
            i //= FAN
        return b";".join([*steps, self.above] if self.above else steps)


def folded(node: bytes, path: bytes) -> bytes:
    for step in path.split(b";") if path else ():
        left, right = step.split(b"|")
        node = digest(left, node, right)
    return node


def proof_digest(path: bytes) -> str:
    """Digest of all siblings, level by level, left to right."""
    return hashlib.sha256(path.replace(b"|", b"").replace(b";", b"")).hexdigest()


# --- building -----------------------------------------------------------------------------

LOG = "tree string, section bigint, leaves bigint, top boolean, nodes binary, root binary"


def build_layer(leaves: DataFrame) -> DataFrame:
    """Logs of the sections of ``leaves (tree, i, n, node)``; ``n`` is the size of the tree's layer."""
    def build(table):
        import pyarrow as pa

        table = table.sort_by("i")
        held, size = [v.hex().encode() for v in table.column("node").to_pylist()], table.column("n")[0].as_py()
        top = size <= SECTION
        log = append_log(held, height_of(size) if top else HEIGHT)
        nodes = bytes.fromhex(b"".join(log).decode())
        return pa.table({
            "tree": table.column("tree").slice(0, 1), "section": pa.array([table.column("i")[0].as_py() // SECTION], pa.int64()),
            "leaves": pa.array([len(held)], pa.int64()), "top": pa.array([top]),
            "nodes": pa.array([nodes], pa.binary()), "root": pa.array([nodes[-DIGEST:]], pa.binary())})

    dealt = leaves.select("tree", "i", "n", "node", F.floor(F.col("i") / SECTION).alias("_section"))
    return dealt.groupBy("tree", "_section").applyInArrow(
        lambda table: build(table.drop_columns(["_section"])), LOG)


def build(leaves: DataFrame) -> list[DataFrame]:
    """Stored logs, layer by layer, of ``leaves (tree, i, n, node)``; the last has the roots of all trees."""
    layers, most = [], leaves.agg(F.max("n")).first()[0] or 0
    while True:
        log = stored(build_layer(leaves))
        layers.append(log)
        if most <= SECTION:
            return layers
        most = -(-most // SECTION)
        # a finished tree has its root in this layer already
        open_ = log.where(~F.col("top"))
        sizes = open_.groupBy("tree").agg(F.count("*").alias("n"))
        leaves = open_.join(sizes, "tree").select("tree", F.col("section").alias("i"), "n", F.col("root").alias("node"))


def roots(layers: list[DataFrame]) -> DataFrame:
    """``tree`` and ``root`` of every tree."""
    out = None
    for log in layers:
        found = log.where("top").select("tree", "root")
        out = found if out is None else out.unionByName(found)
    return out


# --- proofs -------------------------------------------------------------------------------

def _section_of(log, above: bytes) -> Section:
    leaves = log.column("leaves")[0].as_py()
    height = height_of(leaves) if log.column("top")[0].as_py() else HEIGHT
    return Section(log.column("nodes")[0].as_py(), leaves, height, above)


def with_paths(log: DataFrame, top_paths: DataFrame, upper: DataFrame | None) -> DataFrame:
    """``log`` with ``above``, the path from each section's root.

    ``top_paths (tree, path)`` serve the roots of trees, ``upper (tree, section, path)`` the
    sections whose root is a leaf of the next layer.
    """
    done = log.where("top").join(top_paths, "tree").withColumnRenamed("path", "above")
    if upper is None:
        return done
    rest = log.where(~F.col("top")).join(upper, ["tree", "section"]).withColumnRenamed("path", "above")
    return done.unionByName(rest)


def leaf_paths(log: DataFrame) -> DataFrame:
    """``tree``, ``section`` (number of the leaf) and ``path`` of every leaf of ``log`` with ``above``."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                section = _section_of(one, one.column("above")[0].as_py())
                first, count = one.column("section")[0].as_py() * SECTION, one.column("leaves")[0].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array([one.column("tree")[0].as_py()] * count, pa.string()),
                    pa.array(range(first, first + count), pa.int64()),
                    pa.array([section.path(i) for i in range(count)], pa.binary())], names=["tree", "section", "path"])

    return log.select("tree", "section", "leaves", "top", "nodes", "above").mapInArrow(run, "tree string, section bigint, path binary")


def all_paths(layers: list[DataFrame], top_paths: DataFrame) -> DataFrame:
    """The lowest layer's logs with the path above each section, from the top layer down."""
    upper = None
    for depth, log in enumerate(reversed(layers)):
        log = with_paths(log, top_paths, upper)
        if depth < len(layers) - 1:
            upper = stored(leaf_paths(log))
    return log


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Stored ``rows`` with place ``i`` in their ``tree`` and its size ``n``."""
    sizes = stored(rows.groupBy("tree").agg(F.count("*").alias("n")))
    placed = running_total(rows, ["tree"], order, F.lit(1), "i")
    return stored(placed.join(broadcast_if_small(sizes), "tree"))


def manifest(docs: DataFrame, tampered: Column | None = None, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of every row.

    ``tampered`` is the text that a checker was given, the stored one by default.
    """
    names = {"doc_id": key, "text": text, "source": part}
    values = [F.col(f"`{names.get(f, f)}`") for f in FIELDS]
    claimed = values[:-1] + [values[-1] if tampered is None else tampered]
    # a null source stands before the empty one, and joins need a value
    tree = F.coalesce(F.concat(F.lit("1"), values[1].cast("string")), F.lit("0"))
    leaves = stored(docs.select(
        tree.alias("tree"), values[0].alias("_key"), F.unhex(leaf_of(*values)).alias("node"),
        F.unhex(leaf_of(*claimed)).alias("_claim"), F.monotonically_increasing_id().alias("_row")))
    leaves = ranked(leaves, ["_key", "node", "_row"])
    layers = build(leaves)
    subroots = stored(roots(layers).withColumnRenamed("tree", "_tree"))
    forest = ranked(subroots.select(F.lit("").alias("tree"), "_tree", F.col("root").alias("node")), ["_tree"])
    above = build(forest.select("tree", "i", "n", "node"))
    root = roots(above).select("tree", F.col("root").alias("_root"))
    top = all_paths(above, above[-1].where("top").select("tree", F.lit(b"").alias("path")))
    source_paths = leaf_paths(top).select(F.col("section").alias("i"), "path")
    by_source = stored(forest.join(source_paths, "i").join(root, "tree").select(
        F.col("_tree").alias("tree"), F.col("node").alias("_subroot"), "_root", "path"))
    lowest = all_paths(layers, by_source.select("tree", "path"))
    lowest = lowest.join(by_source.select("tree", "_subroot", "_root"), "tree").withColumnRenamed("section", "_section")

    def prove(rows, log):
        import pyarrow as pa

        section = _section_of(log, log.column("above")[0].as_py())
        first = log.column("_section")[0].as_py() * SECTION
        paths = [section.path(i - first) for i in rows.column("i").to_pylist()]
        claims = [c.hex().encode() for c in rows.column("_claim").to_pylist()]
        return pa.table({
            "_key": rows.column("_key"), "leaf": pa.array([v.hex() for v in rows.column("node").to_pylist()]),
            "subroot": pa.array([log.column("_subroot")[0].as_py().hex()] * len(paths)),
            "root": pa.array([log.column("_root")[0].as_py().hex()] * len(paths)),
            "proof_sha256": pa.array([proof_digest(p) for p in paths]),
            "folded_root": pa.array([folded(c, p).decode() for c, p in zip(claims, paths)])})

    kind = leaves.schema["_key"].dataType.simpleString()
    rows = leaves.withColumn("_section", F.floor(F.col("i") / SECTION)).groupBy("tree", "_section")
    proven = rows.cogroup(lowest.groupBy("tree", "_section")).applyInArrow(
        prove, f"_key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return proven.select(
        F.col("_key").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
