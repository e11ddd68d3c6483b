"""N-gram Jaccard join with prefix trees.

A document is the set of its word n-grams, as 63-bit hashes in one global order: rare ones
first, by hash; the most frequent ones last, by rising frequency. Equal sets are one node.
Two sets at or above the threshold share an n-gram in the first part of both (the prefix),
so prefixes that share an n-gram make the groups in which links can be. The join runs in
two rounds:

1. In each group every node is paired with the group's centre, the node that shares most.
   Each node keeps the centre it shares most with. So a group of near copies takes as many
   tests as it has members, and not all pairs.
2. Groups whose nodes are in several components by then give the pairs between different
   components that could still reach the threshold by size, by the number of n-grams that
   their prefixes share, and by what is left of either set after those. So no link is lost:
   what is not tested is in one component already.

The first pass over the texts sends the prefixes in pieces of an n-gram each, and one narrow
row for each document; prefixes themselves are not kept. The pieces of a frequent n-gram are
dealt into several buckets.

The sets to be tested are brought together in blocks and joined with a prefix tree: a set is
traversed along the tree and shares the overlap counted so far with all sets below; a
subtree is left when the n-grams that remain cannot reach the overlap that its sizes need,
or when it belongs to the same component already.

Defined results: a null or empty text, and one without words, has the empty set and links
with nothing. Rows without a key take no part and are returned with themselves alone. Rows of
the same key are judged each by its own text. An empty table gives no rows.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, functions as F

from srcframe.llm.common import own_name, pieces, release_worker, stored, trim_driver
from srcframe.llm.components import components
from srcframe.session import broadcast_if_small


@dataclasses.dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    # How many of the most frequent n-grams get a place by frequency. This bounds the list
    # that tasks get; it only changes the order, and any order gives the same links.
    frequent: int = 100_000
    # sets in a block of the tree join
    block: int = 200
    # prefix entries in a bucket, about
    bucket: int = 400_000


FREQUENT = 1 << 63


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set at the threshold."""
    return -(-percent * n // 100)


def ngram_set(text: str, n: int):
    """Sorted hashes of the distinct word n-grams; of the whole sequence if it is shorter."""
    import numpy as np
    import xxhash

    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    # bytes.split() takes exactly space and \t to \r as white space
    words = text.encode("utf-8", "surrogatepass").translate(lower).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    step, size = np.uint64(0x9E3779B97F4A7C15), min(n, len(words))
    rolled = hashes[:len(words) - size + 1] + np.uint64(size)
    for i in range(1, size):
        rolled = rolled * step + hashes[i:len(words) - size + 1 + i]
    rolled ^= rolled >> np.uint64(31)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled >> np.uint64(1))


class Order:
    """The global order: a frequent n-gram gets a number above all hashes."""

    def __init__(self, frequent):
        import numpy as np

        # frequent[i], by rising frequency, gets place i
        turn = np.argsort(frequent)
        self.frequent, self.place = frequent[turn], turn.astype(np.uint64)

    def apply(self, tokens):
        import numpy as np

        if not len(self.frequent) or not len(tokens):
            return tokens
        at = np.searchsorted(self.frequent, tokens)
        at[at == len(self.frequent)] = 0
        found = self.frequent[at] == tokens
        return np.sort(np.where(found, np.uint64(FREQUENT) + self.place[at], tokens)) if found.any() else tokens


def node_of(tokens) -> int:
    """A number for a set; equal sets get the same."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _map_sets(docs: DataFrame, key: str, text: str, settings: Settings, schema: str, make) -> DataFrame:
    """``make()`` gives a function from a piece of rows (``_key, _text, _hash``) and its sets to a record batch or table."""
    words = settings.words

    def run(batches):
        release_worker()
        work = make()
        for whole in batches:
            for batch in pieces(whole, "_text"):
                sets = [ngram_set(t or "", words) for t in batch.column("_text").to_pylist()]
                made = work(batch, sets)
                yield from made.to_batches() if hasattr(made, "to_batches") else (made,)

    return docs.select(
        F.col(f"`{key}`").cast("bigint").alias("_key"), F.col(f"`{text}`").alias("_text"), text_hash(f"`{text}`").alias("_hash")
    ).mapInArrow(run, schema)


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


# Numbers of rows that are no n-grams: all set members, all sets.
MEMBERS, SETS = -2, -1


def frequent_ngrams(docs: DataFrame, key: str, text: str, settings: Settings) -> dict:
    """The most frequent n-grams by rising frequency, at most ``settings.frequent`` of them: their
    ``tokens`` and ``counts``; and the number of all ``sets`` and of their ``members``.

    Tasks count over a piece of their texts first, and leave out n-grams met once there, so
    the counts are lower bounds; an n-gram of a large share of all texts loses next to nothing.
    """
    def make():
        import numpy as np
        import pyarrow as pa

        def work(_, sets):
            tokens, counts = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays([
                pa.array(np.r_[tokens[often].view(np.int64), MEMBERS, SETS]),
                pa.array(np.r_[counts[often].astype(np.int64), counts.sum(), len(sets)].astype(np.int64))], names=["token", "n"])

        return work

    import numpy as np

    counted = _map_sets(docs, key, text, settings, "token bigint, n bigint", make)
    total = counted.groupBy("token").agg(F.sum("n").alias("n")).where((F.col("n") > 3) | (F.col("token") < 0))
    # the two sums are no smaller than any count
    rows = total.orderBy(F.desc("n"), "token").limit(settings.frequent + 2).toArrow()
    tokens, counts = (np.asarray(rows.column(c).to_numpy())[::-1] for c in ("token", "n"))
    sums, often = {int(t): int(n) for t, n in zip(tokens[tokens < 0], counts[tokens < 0])}, tokens >= 0
    return {
        "tokens": tokens[often].view(np.uint64), "counts": counts[often].copy(),
        "sets": sums.get(SETS, 0), "members": sums.get(MEMBERS, 0)}


ENTRY = [("token", "<u8"), ("node", "<i8"), ("at", "<i4"), ("n", "<i4")]
DOC = [("key", "<i8"), ("known", "u1"), ("node", "<i8"), ("n", "<i4"), ("last", "<i8"), ("hash", "<i8")]
KNOWN_SCHEMA = "token bigint, node bigint, at int, n int, size bigint, key bigint, last bigint, hash bigint, is_doc boolean"


def _dealt(values, bucket):
    """Structured values as packed rows by bucket."""
    import numpy as np
    import pyarrow as pa

    turn = np.argsort(bucket, kind="stable")
    values, bucket = values[turn], bucket[turn]
    full, first = np.unique(bucket, return_index=True)
    bounds = np.r_[first, len(values)]
    return pa.RecordBatch.from_arrays([
        pa.array(full.astype(np.int64)), pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())],
        names=["bucket", "packed"])


def known_and_entries(docs: DataFrame, frequent, key: str, text: str, settings: Settings) -> DataFrame:
    """One row for each document, and the prefix n-grams that two nodes share.

    Documents (``is_doc``) have ``key``, ``n`` (size of the set), ``node``, ``last`` (the last
    n-gram of the prefix, in an order that signed numbers keep) and the text's ``hash``. The others have
    ``token``, ``node``, its place ``at``, ``n`` and the ``size`` of the group in its bucket. Entries travel packed, by a hash of the
    n-gram; equal nodes of a piece travel once, and a frequent n-gram's by the node as well.
    """
    percent, most = settings.percent, settings.bucket
    held = frequent.value
    buckets = max(64, -(-(held["members"] * (100 - percent) // 100 + held["sets"]) // most))

    def make():
        import numpy as np
        import pyarrow as pa

        place = Order(frequent.value["tokens"])
        splits = np.maximum(1, -(-2 * frequent.value["counts"] // most)).astype(np.uint64)

        def bucket_of(entries):
            token = entries["token"].astype(np.uint64)
            often = token >= np.uint64(FREQUENT)
            salt = np.zeros(len(token), np.uint64)
            salt[often] = entries["node"][often].astype(np.uint64) % splits[(token[often] - np.uint64(FREQUENT)).astype(np.int64)]
            mixed = (token + salt * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
            return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)

        def work(batch, sets):
            keys = batch.column("_key")
            rows = np.zeros(len(sets), DOC)
            rows["hash"] = batch.column("_hash").to_numpy()
            rows["known"] = ~np.asarray(keys.is_null())
            rows["key"] = keys.fill_null(0).to_numpy(zero_copy_only=False)
            rows["n"] = [len(s) for s in sets]
            rows["node"] = [node_of(s) for s in sets]
            seen, parts = set(), []
            for i, tokens in enumerate(sets):
                n, node = len(tokens), int(rows["node"][i])
                if not n:
                    continue
                prefix = place.apply(tokens)[:n - needed(n, percent) + 1]
                rows["last"][i] = np.uint64(prefix[-1] ^ np.uint64(FREQUENT)).view(np.int64)
                if rows["known"][i] and node not in seen:
                    seen.add(node)
                    part = np.empty(len(prefix), ENTRY)
                    part["token"], part["node"], part["at"], part["n"] = prefix, node, np.arange(len(prefix)), n
                    parts.append(part)
            entries = np.concatenate(parts) if parts else np.empty(0, ENTRY)
            spread = (rows["node"].astype(np.uint64) + np.arange(len(rows), dtype=np.uint64)) % np.uint64(buckets)
            return pa.Table.from_batches([_dealt(entries, bucket_of(entries)), _dealt(rows, -1 - spread.astype(np.int64))])

        return work

    def meet(table):
        import numpy as np
        import pyarrow as pa

        is_doc = table.column("bucket")[0].as_py() < 0
        packed = table.column("packed").to_pylist()
        del table
        values = np.concatenate([np.frombuffer(p, DOC if is_doc else ENTRY) for p in packed])
        del packed
        if not is_doc:
            values = values[np.lexsort((values["node"], values["token"]))]
            token, node = values["token"], values["node"]
            fresh = np.ones(len(values), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            values = values[fresh]
            token = values["token"]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            sizes = np.diff(np.r_[starts, len(token)])
            # nodes of a frequent n-gram may stand in other buckets
            sizes = np.repeat(sizes, sizes)
            some = (sizes > 1) | (token >= np.uint64(FREQUENT))
            values, sizes = values[some], sizes[some]
        n = len(values)
        nulls = lambda kind: pa.nulls(n, kind)
        column = lambda name: np.ascontiguousarray(values[name])
        return pa.table({
            "token": nulls(pa.int64()) if is_doc else pa.array(column("token").view(np.int64)),
            "node": pa.array(column("node")), "at": nulls(pa.int32()) if is_doc else pa.array(column("at")), "n": pa.array(column("n")),
            "size": nulls(pa.int64()) if is_doc else pa.array(sizes.astype(np.int64)),
            "key": pa.array(column("key"), mask=column("known") == 0) if is_doc else nulls(pa.int64()),
            "last": pa.array(column("last")) if is_doc else nulls(pa.int64()),
            "hash": pa.array(column("hash")) if is_doc else nulls(pa.int64()), "is_doc": pa.array(np.full(n, is_doc))})

    packed = _map_sets(docs, key, text, settings, "bucket bigint, packed binary", make)
    return packed.groupBy("bucket").applyInArrow(meet, KNOWN_SCHEMA)


def _sizes_allow(a_n, b_n, percent: int):
    return 100 * F.least(a_n, b_n) >= percent * F.greatest(a_n, b_n)


def _allows(overlap, a_n, b_n, percent: int):
    """Whether an overlap of this size is enough."""
    return (100 + percent) * overlap >= percent * (a_n + b_n)


def _beyond(n, percent: int):
    """How many n-grams of a set stand after its prefix."""
    return F.floor((n * percent + 99) / 100) - 1


def able(pairs: DataFrame, entries: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs (u, v)`` that can be links, by the n-grams that their prefixes share.

    What else two sets share stands after the end of the prefix that ends first.
    """
    pairs = stored(pairs)
    ends = stored(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
    ends = stored(nodes.select("node", "last").join(broadcast_if_small(ends), "node"))
    # no longer than a prefix; n-grams of one set only are not among the entries
    held = stored(entries.join(broadcast_if_small(ends), "node").groupBy("node").agg(
        F.collect_list("token").alias("tokens"), F.max("n").alias("n"), F.max("last").alias("last")))
    # prefixes are not broadcast: they would all pass through the driver
    of = lambda end: held.select(
        F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("tokens", "n", "last")])
    met = pairs.join(of("u"), "u").join(of("v"), "v")
    first_end = F.when(F.col("u_last") <= F.col("v_last"), F.col("u_n")).otherwise(F.col("v_n"))
    most = F.size(F.array_intersect("u_tokens", "v_tokens")) + _beyond(first_end, percent)
    return met.where(_allows(most, F.col("u_n"), F.col("v_n"), percent)).select("u", "v")


def _possible(other: str, percent: int):
    """Whether sizes, and what is left after a shared n-gram, allow a link.

    The second test holds for the first n-gram that two sets share. A pair that passes with
    none of its n-grams is no link.
    """
    n, m = F.col("n"), F.col(f"{other}n")
    left = F.least(n - F.col("at"), m - F.col(f"{other}at"))
    return _sizes_allow(n, m, percent) & _allows(left, n, m, percent)


def star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """``u`` (centre) and ``v``: each node with the centre it shares most n-grams with.

    The centre of a group is the node whose groups are largest.
    """
    degree = stored(entries.groupBy("node").agg(F.sum("size").alias("degree")))
    ranked = entries.join(broadcast_if_small(degree), "node")
    centres = ranked.groupBy("token").agg(F.max(F.struct("degree", "node", "at", "n")).alias("c")).select(
        "token", F.col("c.degree").alias("c_degree"), F.col("c.node").alias("c_node"), F.col("c.at").alias("c_at"), F.col("c.n").alias("c_n"))
    met = entries.join(centres, "token").where((F.col("node") != F.col("c_node")) & _possible("c_", percent))
    shared = met.groupBy("node", "c_node").agg(F.count("*").alias("shared"), F.max("c_degree").alias("c_degree"))
    best = shared.groupBy("node").agg(F.max(F.struct("shared", "c_degree", "c_node")).alias("best"))
    return best.select(F.col("best.c_node").alias("u"), F.col("node").alias("v"))


def cross_pairs(entries: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """``u``, ``v``: the pairs of a group, in different components, that can be links.

    One side of such a pair is outside the group's largest component, so only those nodes
    are compared with the group.
    """
    named = entries.join(broadcast_if_small(stored(labels)), "node", "left").withColumn("label", F.coalesce("label", "node"))
    spread = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    met = stored(named.join(spread, "token").select("token", "node", "at", "n", "label"))
    counted = met.groupBy("token", "label").agg(F.count("*").alias("size"))
    main = counted.groupBy("token").agg(F.max(F.struct("size", "label")).alias("m")).select("token", F.col("m.label").alias("main"))
    few = met.join(main, "token").where(F.col("label") != F.col("main"))
    few = few.select("token", "main", *[F.col(c).alias(f"f_{c}") for c in ("node", "label", "at", "n")])
    pairs = few.join(met, "token").where(
        (F.col("label") != F.col("f_label"))
        & ((F.col("label") == F.col("main")) | (F.col("f_node") < F.col("node"))) & _possible("f_", percent))
    return pairs.select(F.least("f_node", "node").alias("u"), F.greatest("f_node", "node").alias("v")).distinct()


class Tree:
    """A prefix tree of ordered sets, with runs of n-grams on its edges."""

    class Node:
        __slots__ = ("run", "depth", "below", "ends", "least", "most", "member")

        def __init__(self, run, depth):
            self.run, self.depth = run, depth  # n-grams of the edge; their number down to its end
            self.below, self.ends = {}, []
            self.least, self.most = 1 << 60, 0  # sizes of the sets here and below
            self.member = -1  # a set of the one component of all sets here and below, or -2

    def __init__(self, percent: int):
        import numpy as np

        self.percent = percent
        self.root = self.Node(np.empty(0, np.uint64), 0)
        self.parent: list[int] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def add(self, tokens) -> list[int]:
        """Insert a set; the sets it links with, one for each component it was not in yet."""
        me = len(self.parent)
        self.parent.append(me)
        found: list[int] = []
        if len(tokens):
            self._traverse(self.root, tokens, 0, 0, me, found)
            self._insert(tokens, me)
        return found

    def _traverse(self, node, tokens, at: int, overlap: int, me: int, found: list[int]) -> None:
        """``overlap`` n-grams are shared so far with the first ``at`` of ``tokens``."""
        import numpy as np

        for child in node.below.values():
            if child.member >= 0 and self.find(child.member) == self.find(me):
                continue
            size = len(tokens)
            least = max(child.least, self._low(size))
            need = -(-self.percent * (size + least) // (100 + self.percent))
            if child.most < least or overlap + min(size - at, child.most - node.depth) < need:
                continue
            run = child.run
            to = at + int(np.searchsorted(tokens[at:], run[-1], side="right"))
            shared = overlap + len(np.intersect1d(tokens[at:to], run, assume_unique=True))
            for other, other_size in child.ends:
                union = size + other_size - shared
                if 100 * shared >= self.percent * union and self.find(other) != self.find(me):
                    self.parent[self.find(other)] = self.find(me)
                    found.append(other)
            if child.below and shared + min(size - to, child.most - child.depth) >= need:
                self._traverse(child, tokens, to, shared, me, found)

    def _low(self, size: int) -> int:
        return -(-self.percent * size // 100)

    def _insert(self, tokens, me: int) -> None:
        import numpy as np

        node, at, size = self.root, 0, len(tokens)
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            if node.member == -1:
                node.member = me
            elif node.member >= 0 and self.find(node.member) != self.find(me):
                node.member = -2
            if at == size:
                node.ends.append((me, size))
                return
            first = int(tokens[at])
            child = node.below.get(first)
            if child is None:
                child = node.below[first] = self.Node(tokens[at:], size)
                child.least = child.most = size
                child.member = me
                child.ends.append((me, size))
                return
            both = min(len(child.run), size - at)
            differs = np.flatnonzero(child.run[:both] != tokens[at:at + both])
            same = int(differs[0]) if len(differs) else both
            if same < len(child.run):  # the edge splits where the sets part
                upper = self.Node(child.run[:same], node.depth + same)
                upper.least, upper.most, upper.member = child.least, child.most, child.member
                child.run = child.run[same:]
                upper.below[int(child.run[0])] = child
                node.below[first] = child = upper
            node, at = child, at + same


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, frequent, key: str, text: str, settings: Settings) -> DataFrame:
    """The links among ``pairs (u, v)``, tested on the sets with a prefix tree.

    The pairs, a stored table, are dealt into blocks of a ``u``, and each block gets the set of ``u``. Sets
    are made again from the texts of the nodes in question, one text for each node.
    """
    blocks = pairs.groupBy("u").agg(F.ceil(F.count("*") / settings.block).alias("blocks"))
    dealt = pairs.join(blocks, "u").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")))
    places = stored(
        dealt.select("u", "block", F.col("v").alias("node")).union(dealt.select("u", "block", F.col("u").alias("node")).distinct()))
    named = broadcast_if_small(stored(places.select("node").distinct()))
    wanted = stored(nodes.join(named, "node").select(F.col("key").alias("_doc")).distinct())
    texts = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).join(broadcast_if_small(wanted), "_doc")

    def make():
        import numpy as np
        import pyarrow as pa

        place = Order(frequent.value["tokens"])
        return lambda _, sets: pa.RecordBatch.from_arrays(
            [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([place.apply(s).tobytes() for s in sets], pa.binary())],
            names=["node", "tokens"])

    sets = _map_sets(texts, "_doc", "_text", settings, "node bigint, tokens binary", make)
    percent = settings.percent

    def join(table):
        import numpy as np
        import pyarrow as pa

        sets = dict(zip(table.column("node").to_pylist(), table.column("tokens").to_pylist()))
        centre = table.column("u")[0].as_py()
        names = sorted(sets, key=lambda n: n != centre)
        tree, links = Tree(percent), []
        for i, name in enumerate(names):
            links += [(name, names[j]) for j in tree.add(np.frombuffer(sets[name], np.uint64))]
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    met = sets.join(broadcast_if_small(places), "node").select("u", "block", "node", "tokens")
    return met.groupBy("u", "block").applyInArrow(join, "u bigint, v bigint")


def classes(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id``, ``copies_of`` (the class of equal sets) and ``text_hash`` of every row."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_ngrams(docs, key, text, settings))
    made = stored(known_and_entries(docs, frequent, key, text, settings))
    known = made.where("is_doc").select("key", "n", "node", "last", "hash")
    # one row for each set, so that copies meet no join
    nodes = stored(known.where(F.col("key").isNotNull() & (F.col("n") > 0)).groupBy("node").agg(
        F.min("key").alias("key"), F.max("n").alias("n"), F.max("last").alias("last")))
    entries = made.where("not is_doc").select("token", "node", "at", "n", "size")

    def links(pairs: DataFrame) -> DataFrame:
        # each step leaves its plans and lists of tasks in the driver
        trim_driver(docs.sparkSession)
        pairs = stored(able(pairs, entries, nodes, settings.percent))
        trim_driver(docs.sparkSession)
        found = stored(verified(pairs, nodes, docs, frequent, key, text, settings))
        trim_driver(docs.sparkSession)
        return found

    first = links(star_pairs(entries, settings.percent))
    labels = stored(components(first))
    second = links(cross_pairs(entries, labels, settings.percent))
    frequent.unpersist()
    labels = components(first.union(second))
    trim_driver(docs.sparkSession)
    named = known.select("key", "n", "node", "hash").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stored(named)
    full = named.where((F.col("n") > 0) & F.col("key").isNotNull())
    # a component of a single row has that row's key, so few rows are stored and met
    least = stored(full.groupBy("label").agg(F.min("key").alias("component_id"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    joined = named.join(broadcast_if_small(least), "label", "left")
    grouped = (F.col("n") > 0) & F.col("key").isNotNull() & F.col("component_id").isNotNull()
    return joined.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(grouped, F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
        F.col("node").alias("copies_of"), F.col("hash").alias("text_hash"))


def one_of_each(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the smallest key (and text hash, where
    a key repeats). Rows are told apart by key and text; of rows that repeat both, one stays.
    Rows with an empty set or without a key stay.
    """
    found = classes(docs, settings, key, text)
    grouped = found.where(F.col(f"`{key}`").isNotNull() & (F.col("n_shingles") > 0)).select(
        F.col(f"`{key}`").alias("_key"), F.col("text_hash").alias("_hash"), "component_id")
    grouped = stored(grouped)
    trim_driver(docs.sparkSession)
    first = grouped.groupBy("component_id").agg(F.min(F.struct("_key", "_hash")).alias("_first"), F.count("*").alias("_n"))
    # a component of a single row has nothing to drop, so narrow rows meet few
    first = stored(first.where("_n > 1").drop("_n"))
    row = F.struct("_key", "_hash")
    gone = stored(grouped.join(broadcast_if_small(first), "component_id").where(row != F.col("_first")).select("_key", "_hash").distinct())
    # names of the lists that the table has not
    names = own_name(docs, "_key"), own_name(docs, "_hash")
    is_row = (F.col(f"`{key}`").cast("bigint") == F.col(names[0])) & (text_hash(f"`{text}`") == F.col(names[1]))
    kept = docs.join(broadcast_if_small(gone.toDF(*names)), is_row, "left_anti")
    again = stored(grouped.groupBy("_key", "_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_key", "_hash"))
    trim_driver(docs.sparkSession)
    if again.isEmpty():
        return kept
    listed = broadcast_if_small(again.toDF(*names))
    hashed = own_name(docs, "text_hash")
    once = kept.join(listed, is_row, "left_semi").withColumn(hashed, text_hash(f"`{text}`")).dropDuplicates([key, hashed]).drop(hashed)
    return kept.join(listed, is_row, "left_anti").unionByName(once)
