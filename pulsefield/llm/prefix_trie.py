"""Conversation prefix trie: one row for each distinct beginning of a conversation, with sums over its subtree.

A conversation is a path of turns (role, text) from the textless root. Its prefixes are named by chained
128-bit digests, and texts are read once, to a hash and a length, so that only numbers are shuffled.

1. Paths stream through tasks by conversation. A shard is a run of whole conversations with about `SHARD`
   prefixes; `NodeTable` lists a shard's distinct digests and gives each its slot by a minimal perfect hash,
   checked against the stored digest. Where conversations end is scattered into flat arrays, and accumulated
   from child to parent slots in depth order: members and the smallest member of each node.
2. Shards' nodes are added up by digest: the node table. A node belongs to its smallest member.
3. A node's own share of the subtree sums (is it childless; what it saves) meets the path of its smallest
   member by (conversation, depth), keys that repeat nowhere. Paths stream again, shares are scattered into
   slots and accumulated in depth order, and the shards' sums are added up by digest.

A prefix common to very many conversations is one row of each shard. Nodes meet their parents in `attach`,
so that a parent of very many children burdens no task. The ids that end at a node are sorted by ranges and
joined in pieces of `PIECE`; only the hash of the pieces runs in one stream for each node. Memory of a task is
a shard and its longest conversation, some 200 bytes a turn.

Defined cases: a null role or text is empty; turns are ordered null first, turns of one number by the hash of
role and text; repeated rows are turns of their own; rows with a null conv_id belong to no conversation; very
long texts are hashed whole; an empty table gives an empty result; other columns are never read. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefield.llm.common import attach, cut, shuffle_partitions

#: Prefixes in a shard; ids in a piece of a list; first turns that the query takes from another conversation, at most.
SHARD, PIECE, BORROWED = 50_000, 4096, 8
_U = np.uint64


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ _U(salt * 0x632BE5AB + 1)) * _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return x ^ (x >> _U(32))


class NodeTable:
    """Distinct digests in slots 0 to n - 1 of a minimal perfect hash.

    Level by level, the keys that are alone at their place of a bit array stay there; the others go on to the
    next, smaller level. A key's slot is the number of taken places before its own. Slots store the digests,
    so that a lookup is verified, and a foreign key is found out.
    """

    def __init__(self, digests: np.ndarray):
        """`digests` has two columns of 64 bits."""
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        ordered = digests[order]
        fresh = np.ones(len(ordered), bool)
        fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        keys = ordered[fresh]
        self.n, self.levels, left, before = len(keys), [], keys, 0
        slots = []
        while len(left):
            salt, size = len(self.levels) + 1, 2 * len(left)
            place = (_mix(left[:, 0] ^ _mix(left[:, 1], 97), salt) % _U(size)).astype(np.int64)
            taken = np.bincount(place, minlength=size) == 1
            rank = before + np.cumsum(taken) - taken
            self.levels.append((size, taken, rank))
            stay = taken[place]
            slots.append((left[stay], rank[place[stay]]))
            before += int(taken.sum())
            left = left[~stay]
        self.digests = np.empty((self.n, 2), np.uint64)
        for kept, at in slots:
            self.digests[at] = kept

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 for one that is not in the table."""
        out, left = np.full(len(digests), -1), np.arange(len(digests))
        for salt, (size, taken, rank) in enumerate(self.levels, 1):
            some = digests[left]
            place = (_mix(some[:, 0] ^ _mix(some[:, 1], 97), salt) % _U(size)).astype(np.int64)
            here = taken[place]
            out[left[here]] = rank[place[here]]
            left = left[~here]
        wrong = (out >= 0) & (self.digests[out] != digests).any(axis=1)
        out[wrong] = -1
        return out


class Shard:
    """The slots, parents and depths of the prefixes of some whole paths.

    A path's rows follow each other, from depth 0 (the root) down; a row's parent is the row before it.
    """

    def __init__(self, digests: np.ndarray, depth: np.ndarray):
        self.table = NodeTable(digests)
        self.slot = self.table.slots(digests)
        if (self.slot < 0).any():
            raise ValueError("a digest has no slot")
        self.first = np.full(self.table.n, len(digests))  # a row that shows the node
        np.minimum.at(self.first, self.slot, np.arange(len(digests)))
        self.depth = depth[self.first]
        self.parent = np.where(self.depth > 0, self.slot[np.maximum(self.first - 1, 0)], -1)
        self.order = np.argsort(-self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.depth[self.order])) + 1
        self.ranks = [r for r in np.split(self.order, cuts) if len(r) and self.depth[r[0]] > 0]

    def scatter(self, rows: np.ndarray | slice, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.table.n, np.int64)
        np.add.at(out, self.slot[rows], values)
        return out

    def add_up(self, values: np.ndarray) -> np.ndarray:
        """Each node's sum over its subtree: depth by depth from the deepest, children are added to parents."""
        for r in self.ranks:
            np.add.at(values, self.parent[r], values[r])
        return values

    def least_up(self, values: np.ndarray) -> np.ndarray:
        for r in self.ranks:
            np.minimum.at(values, self.parent[r], values[r])
        return values


_PATH = "conv_id long, depth long, d1 long, d2 long, bytes long, last boolean"
_NODE = "d1 long, d2 long, p1 long, p2 long, depth long, bytes long, n_convs long, conv_id long"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, at, h1, h2, bytes) by conversation and turn, the root first (at -1), to paths."""
    held: tuple | None = None  # a row waits for the next one, to know whether it is its conversation's last

    for batch in batches:
        conv, _, h1, h2, size = (c.to_pylist() for c in batch.columns)
        out: list[tuple] = []
        for c, a, b, n in zip(conv, h1, h2, size, strict=True):
            if held is None or held[0] != c:
                if held is not None:
                    out.append((*held, True))
                held = (c, 0, 0, 0, 0)
            else:
                out.append((*held, False))
                chain = b"".join(x.to_bytes(8, "little", signed=True) for x in (held[2], held[3], a, b))
                digest = hashlib.blake2b(chain, digest_size=16).digest()
                held = (c, held[1] + 1, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), n)
        yield _batch(out)
    if held is not None:
        yield _batch([(*held, True)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.int64()] * 5 + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "depth", "d1", "d2", "bytes", "last"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole conversations with about `SHARD` rows; `conv_id` and `depth` are the first columns."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= SHARD:
            whole = pa.concat_tables(held)
            roots = np.flatnonzero(whole.column("depth").to_numpy() == 0)
            end = int(roots[-1])  # the last conversation may go on in the next batch
            if end:
                yield whole.slice(0, end)
            held = [whole.slice(end)]
    if held:
        yield pa.concat_tables(held)


def _digests(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("d1", "d2")], axis=1)


def _local_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _shards(batches):
        conv, depth, size = (table.column(c).to_numpy() for c in ("conv_id", "depth", "bytes"))
        digests, last = _digests(table), table.column("last").to_numpy()
        shard = Shard(digests, depth)
        members = shard.add_up(shard.scatter(last, np.ones(int(last.sum()), np.int64)))
        least = np.full(shard.table.n, np.iinfo(np.int64).max)
        np.minimum.at(least, shard.slot[last], conv[last])
        least = shard.least_up(least)
        above = np.where((shard.depth > 0)[:, None], shard.table.digests[np.maximum(shard.parent, 0)], _U(0))
        columns = [*shard.table.digests.T, *above.T, shard.depth, size[shard.first], members, least]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], ["d1", "d2", "p1", "p2", "depth", "bytes", "n_convs", "conv_id"])


def _local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _shards(batches):
        shard = Shard(_digests(table), table.column("depth").to_numpy())
        sums = [shard.add_up(shard.scatter(slice(None), table.column(c).to_numpy())) for c in ("leaf", "saved")]
        columns = [*(np.ascontiguousarray(c).view(np.int64) for c in shard.table.digests.T), *sums]
        use = (sums[0] != 0) | (sums[1] != 0)
        yield pa.RecordBatch.from_arrays([pa.array(c[use]) for c in columns], ["d1", "d2", "leaves", "saved"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (d1, d2, conv_id) to (d1, d2, first id, ids joined by commas), `PIECE` ids at most in a row."""
    for batch in batches:
        d1, d2, conv = (c.to_numpy() for c in batch.columns)
        fresh = np.ones(len(conv), bool)
        fresh[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        starts = np.flatnonzero(fresh)
        starts = np.unique(np.concatenate([starts, np.arange(0, len(conv), PIECE)])).astype(np.int64) if len(conv) else starts
        joined = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(conv)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(d1[starts]), pa.array(d2[starts]), pa.array(conv[starts]), pa.array(joined, pa.string())], ["d1", "d2", "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (d1, d2, sha256 of all of a node's pieces joined by commas)."""
    now, state = None, None
    for batch in batches:
        d1, d2, _, ids = (c.to_pylist() for c in batch.columns)
        out = []
        for a, b, piece in zip(d1, d2, ids, strict=True):
            if now == (a, b):
                state.update(b"," + piece.encode())
            else:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (a, b), hashlib.sha256(piece.encode())
        yield _sha_batch(out)
    if now is not None:
        yield _sha_batch([(*now, state.hexdigest())])


def _sha_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["d1", "d2", "ends_sha256"])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0), h1, h2, bytes of every turn in its order; the hashes name role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    known = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit("second"), text, role).alias("h2"), F.octet_length(text).cast("long").alias("bytes"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "h1", "h2")
    return known.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("at"), "h1", "h2", "bytes")


def with_shared_starts(rows: DataFrame, of: Column, n: Column, most: int) -> DataFrame:
    """Turns where each conversation begins with the first `n` turns of conversation `of` in place of its own.

    `of` and `n` (`most` at most) are columns over conv_id; all turns of `of` are taken where it has fewer, none
    where it is absent. Each conversation also has a row for the root, at -1, so that one without turns stays.
    """
    n = n.cast("long")
    ids = rows.select("conv_id").distinct().withColumns({"of": of, "n": n})
    starts = rows.filter(F.col("at") < most).withColumnRenamed("conv_id", "of").join(ids, "of").filter(F.col("at") < F.col("n"))
    rest = rows.filter(F.col("at") >= n)
    roots = ids.select("conv_id", F.lit(-1).cast("long").alias("at"), *[F.lit(0).cast("long").alias(c) for c in ("h1", "h2", "bytes")])
    return roots.unionByName(starts.select(*rows.columns)).unionByName(rest)


def with_roots(rows: DataFrame) -> DataFrame:
    """Turns, and a row for the root of each conversation, at -1."""
    return with_shared_starts(rows, F.col("conv_id"), F.lit(0), 0)


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of `rows` (conv_id, at, h1, h2, bytes; a root row for each conversation).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    dealt = rows.repartition(shuffle_partitions(rows), "conv_id").sortWithinPartitions("conv_id", "at")
    paths = cut(dealt.select("conv_id", "at", "h1", "h2", "bytes").mapInArrow(_paths, _PATH))
    nodes = paths.mapInArrow(_local_nodes, _NODE).groupBy("d1", "d2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")
    )  # equal in all shards, but for the last two
    nodes = cut(nodes)
    n = nodes.count()
    children = nodes.filter("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children")).withColumnsRenamed({"p1": "d1", "p2": "d2"})
    nodes = nodes.join(children, ["d1", "d2"], "left").na.fill(0, ["n_children"])
    own = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    shared = paths.select("conv_id", "depth", "d1", "d2").join(own, ["conv_id", "depth"], "left").na.fill(0, ["leaf", "saved"])
    shared = shared.repartition(shuffle_partitions(rows), "conv_id").sortWithinPartitions("conv_id", "depth")
    sums = shared.mapInArrow(_local_sums, "d1 long, d2 long, leaves long, saved long")
    sums = sums.groupBy("d1", "d2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = paths.filter("last").select("d1", "d2", "conv_id").repartitionByRange(shuffle_partitions(rows), "d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id")
    pieces = ends.mapInArrow(_pieces, "d1 long, d2 long, first long, ids string")
    hashes = pieces.repartition(shuffle_partitions(rows), "d1", "d2").sortWithinPartitions("d1", "d2", "first").mapInArrow(_hashes, "d1 long, d2 long, ends_sha256 string")
    found = nodes.join(sums, ["d1", "d2"], "left").join(hashes, ["d1", "d2"], "left")
    parents = nodes.filter("n_children > 0").select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_children"))
    # The root is no child: its key has no parent's row.
    placed = found.withColumn("p1", F.when(F.col("depth") > 0, F.col("p1")))
    met = attach(placed, parents, ["p1", "p2"], "_children", n, F.xxhash64("d1", "d2").bitwiseAND(F.lit((1 << 40) - 1)))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return met.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
