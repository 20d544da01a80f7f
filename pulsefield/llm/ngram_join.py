"""N-gram Jaccard join: near-duplicates by word shingles, with Bayesian pruning of candidate pairs.

Texts are sets of shingles of `SHINGLE` words. Two texts are linked where the Jaccard similarity of
their sets is at least `THRESHOLD`.

1. Equal sets collapse to one node with its number of rows, so exact copies are never paired.
2. Banded MinHash values put similar nodes in common buckets. A bucket links its nodes to its least one;
   the components of those links hold every candidate pair.
3. A component is cut into blocks of about `BLOCK` nodes, and two blocks make a tile, so that a component
   of any size spreads over many tasks. A node goes only to the tiles of blocks that hold a node of one
   of its buckets: a chain of unlike nodes costs its common buckets, not the square of its length. A tile
   compares MinHash values incrementally and drops a pair as soon as the posterior probability that its
   similarity reaches the threshold (uniform prior, m of n values equal) falls below `TOLERANCE`.
   Survivors are verified exactly on their shingles.
4. A tile returns a row per node: how many rows its links reach, and the least node of its linked group.
   Components of the verified links are the classes. Pairs are never written out.

Banding misses a pair of similarity 0.8 with probability (1 - 0.8^5)^30 < 1e-5, if no tile holds the two
for the sake of others.

Defined cases: texts of fewer words than a shingle are one shingle of all their words; texts without
words (null, empty) have no links and are classes of their own; rows of one id are rows of their own;
rows with a null id have a null class and no links; an empty table gives an empty result; other columns
are never read. Ids are integers. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsefield.llm.common import cut
from pulsefield.llm.components import connected_components

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 30, 5
#: MinHash values compared before each pruning.
STEPS = (16, 32, 64, 100, 150)
#: Nodes along a tile's side; copies of nodes for each task of tiles.
BLOCK, PER_TASK = 512, 500
CODES = 300_000
_U = np.uint64
_random = np.random.default_rng(20240229)
_XOR = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_TIMES = _random.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)


class Codes(dict):
    """Word (bytes) to a 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        code = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < CODES:
            self[word] = code
        return code


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ _U(salt)) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingles(text: bytes | None, codes: Codes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    ws = (text or b"").split()
    if not ws:
        return np.zeros(0, _U)
    h = np.fromiter(map(codes.__getitem__, ws), _U, len(ws))
    size = min(SHINGLE, len(ws))
    g = np.full(len(ws) - size + 1, size, _U)
    for k in range(size):
        g = g * _U(0xC2B2AE3D27D4EB4F) + h[k : k + len(g)]
    return np.unique(_mix(g, 7))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of MinHash values for each set (none empty)."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    low = 0
    while low < len(sets):
        high, n = low, 0
        while high < len(sets) and (n == 0 or n + len(sets[high]) <= 60_000):
            n += len(sets[high])
            high += 1
        x = (np.concatenate(sets[low:high]) >> _U(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[low : high - 1]], dtype=np.int64)])
        y = np.empty_like(x)
        for k in range(BANDS * ROWS):
            np.bitwise_xor(x, _XOR[k], out=y)
            np.multiply(y, _TIMES[k], out=y)
            out[low:high, k] = np.minimum.reduceat(y, starts)
        low = high
    return out


def _bands(signatures: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signatures), BANDS), _U)
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(_U)
    for k in range(ROWS):
        keys = _mix(keys + rows[:, :, k], 31 + k)
    return _mix(keys + np.arange(BANDS, dtype=_U), 41).view(np.int64)


def _node(s: np.ndarray) -> int:
    """A set's name: a hash of its hashes in any order."""
    both = np.array([_mix(s, 51).sum(dtype=_U) + _U(len(s)), np.bitwise_xor.reduce(_mix(s, 52))], _U)
    return int(_mix(both[:1] ^ _mix(both[1:], 53), 54).view(np.int64)[0])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = Codes()
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            some = batch.slice(low, 1024)
            sets = [shingles(t, codes) for t in some.column("text").cast(pa.binary()).to_pylist()]
            full = [s for s in sets if len(s)]
            keys = iter(_bands(minhashes(full)).tolist() if full else [])
            bands = [next(keys) if len(s) else None for s in sets]
            nodes = [_node(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), some.column("tie"), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "tie", "node", "bands"]
            )


@cache
def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest equal values of n with which P(similarity >= threshold) is still at least `tolerance`."""
    grid = np.linspace(0, 1, 20_001)[1:-1]
    for m in range(n + 1):
        log = m * np.log(grid) + (n - m) * np.log1p(-grid)
        p = np.exp(log - log.max())
        if p[grid >= threshold].sum() / p.sum() >= tolerance:
            return m
    return n + 1


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (one of left, one of right, each pair once) whose similarity reaches the threshold."""
    signatures = minhashes(sets)
    alive_a, alive_b = [], []
    for rows in np.array_split(left, max(1, len(left) // 64)):
        a, b = (x.ravel() for x in np.meshgrid(rows, right, indexing="ij"))
        use = a < b if left is right else np.ones(len(a), bool)
        a, b = a[use], b[use]
        same, done = np.zeros(len(a), np.int64), 0
        for step in STEPS:
            same += (signatures[a, done:step] == signatures[b, done:step]).sum(axis=1)
            keep = same >= least_matches(step)
            a, b, same, done = a[keep], b[keep], same[keep], step
        alive_a.append(a)
        alive_b.append(b)
    a, b = np.concatenate(alive_a), np.concatenate(alive_b)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(flat, np.cumsum(sizes)[:-1])
    inside, common = np.zeros(flat.max(initial=-1) + 1, bool), np.zeros(len(a), np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else []
    for low, high in zip(cuts, np.append(cuts[1:], len(a)) if len(a) else [], strict=True):
        inside[ids[a[low]]] = True
        others = b[low:high]
        starts = np.concatenate([[0], np.cumsum(sizes[others])[:-1]])
        common[low:high] = np.add.reduceat(inside[np.concatenate([ids[k] for k in others])].astype(np.int64), starts)
        inside[ids[a[low]]] = False
    keep = common >= THRESHOLD * (sizes[a] + sizes[b] - common) - 1e-9
    return a[keep], b[keep]


def _least_linked(n: int, a: np.ndarray, b: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least name in its group of linked nodes."""
    low = names.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        if (new == low).all():
            return low
        low = new


def _verify(table: pa.Table) -> pa.Table:
    """All tiles of a task: links counted and the least linked node, a row per node of a tile."""
    codes, out = Codes(), []
    tile = np.stack([table.column(c).to_numpy() for c in ("component", "i", "j")])
    order = np.lexsort(tile[::-1])
    fresh = np.flatnonzero(np.concatenate([[True], (tile[:, order][:, 1:] != tile[:, order][:, :-1]).any(axis=0)]))
    text = table.column("text").cast(pa.binary())
    names, rows, block, i, j = (table.column(c).to_numpy() for c in ("node", "n", "block", "i", "j"))
    for low, high in zip(fresh, np.append(fresh[1:], len(order)), strict=True):
        at = order[low:high]
        sets = [shingles(text[int(k)].as_py(), codes) for k in at]
        _, once = np.unique(names[at], return_index=True)  # rows repeated with one id are one node
        at, sets = at[once], [sets[x] for x in once]
        if len(at) < 2:
            continue
        left = np.flatnonzero(block[at] == i[at[0]])
        right = left if i[at[0]] == j[at[0]] else np.flatnonzero(block[at] == j[at[0]])
        a, b = linked_pairs(sets, left, right)
        links = np.zeros(len(at), np.int64)
        np.add.at(links, a, rows[at[b]])
        np.add.at(links, b, rows[at[a]])
        hub = _least_linked(len(at), a, b, names[at])
        use = links > 0
        out.append((names[at][use], links[use], hub[use]))
    columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("node", "links", "hub"), columns, strict=True)})


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, tie, node) and, for each node, its class and links; `tie` is a hash of the text.

    A class is named by its least (doc_id, tie).
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    rows = cut(texts.mapInArrow(_nodes, "doc_id long, tie long, node long, bands array<long>"))
    known = rows.filter("doc_id is not null and node is not null")
    nodes = known.groupBy("node").agg(F.min(F.struct("doc_id", "tie")).alias("least"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    hubs = spread.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("bucket", "hub")
    near = connected_components(spread.join(hubs, "bucket").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    sizes = near.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = near.join(sizes, "component").select("node", "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    # The blocks that a node's buckets reach; a component of one block needs no look.
    spread = nodes.select("node", "bands").join(blocks.filter("blocks > 1").select("node", "block"), "node").select("node", "block", F.explode("bands").alias("bucket"))
    reached = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.collect_set("block").alias("others")).filter("n > 1").drop("n")
    others = spread.join(reached, "bucket").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
    placed = blocks.join(others, "node", "left").withColumn("others", F.coalesce("others", F.array(F.lit(0))))
    placed = cut(placed.join(nodes.select("node", "least.doc_id", "least.tie", "n"), "node"))
    # A node is copied to each of its tiles, so tasks are counted in copies, not in documents.
    copies = placed.agg(F.sum(F.size("others"))).first()[0] or 0
    tasks = 1 + copies // PER_TASK
    with_text = texts.filter("doc_id is not null").join(placed, ["doc_id", "tie"])
    if not known.groupBy("doc_id", "tie").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        with_text = with_text.dropDuplicates(["node"])  # rows repeated with one id: one text goes to the tiles
    tiled = with_text.withColumn("other", F.explode("others"))
    tiled = tiled.select("component", "node", "n", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "text")
    tiled = tiled.withColumn("task", F.pmod(F.xxhash64("component", "i", "j"), F.lit(tasks)))
    verified = cut(tiled.groupBy("task").applyInArrow(_verify, "node long, links long, hub long"))
    classes = connected_components(verified.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    classes = classes.join(nodes.select("node", "least"), "node")
    least = classes.groupBy("component").agg(F.min("least").alias("class"))
    of_node = classes.join(least, "component").select("node", "class")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    found = nodes.select("node", "least", "n").join(of_node, "node", "left").join(links, "node", "left")
    found = found.select("node", F.coalesce("class", "least").alias("class"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.select("doc_id", "tie", "node"), found


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), n_links (other rows linked to it) of every row."""
    rows, found = _classes(docs)
    joined = rows.join(found, "node", "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("class.doc_id", "doc_id"))
    return joined.select("doc_id", alone.alias("class_id"), F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each class: that of the least id, among rows of one id that of the least text hash.

    Rows of one id are judged by their own texts, so a row stays although another with its id goes; of
    rows equal in id and text one stays. Rows with a null id and texts without words all stay.
    """
    rows, found = _classes(docs)
    known = rows.filter("doc_id is not null and node is not null").groupBy("doc_id", "tie", "node").agg(F.count("*").alias("n")).join(found, "node")
    stays = (F.col("class.doc_id") == F.col("doc_id")) & (F.col("class.tie") == F.col("tie"))
    marks = known.select("doc_id", "tie", "n", stays.alias("stays")).filter("not stays or n > 1").drop("n")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"))
    first = F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("tie")) == 1
    judged = whole.join(marks, ["doc_id", "tie"], "left").withColumn("first", first)
    kept = judged.filter(F.col("stays").isNull() | (F.col("stays") & F.col("first")))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
