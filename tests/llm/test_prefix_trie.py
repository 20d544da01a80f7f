import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsefield.llm import prefix_trie
from pulsefield.llm.common import id_bucket

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, rebuild=True):
    """Nodes by dictionaries of prefixes, for small inputs without ties."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = convs.get(base, [])[:h] + own[h:]
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in cs if len(built[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return Counter(out)


def found(df, rebuild=True):
    turns = prefix_trie.turns(df)
    conv = F.col("conv_id")
    rows = prefix_trie.with_shared_starts(turns, conv - conv % 5, id_bucket("conv_id", 9), 8) if rebuild else prefix_trie.with_roots(turns)
    return Counter(tuple(r) for r in prefix_trie.trie(rows).select(*COLUMNS).collect())


ODD = [
    (0, 0, "user", "hello"), (0, 1, "assistant", "hi"), (0, None, None, None), (1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 2, "user", "naïve ☃"), (2, 5, "user", ""), (2, 6, None, "x"),
    (None, 0, "user", "lost"), (7, 0, "user", "long " * 50_000), (8, 0, "user", "long " * 50_000), (11, 3, "assistant", None), (-3, 0, "user", "hello"), (-1, 0, "user", "hello"), (40, 0, "user", "same"), (40, 0, "user", "same"),
]


@pytest.mark.parametrize("rebuild", [True, False])
def test_odd_rows_equal_the_plain_version(spark, rebuild):
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in ("at", "depth", "d1", "n", "of", "bytes", "last")})
    assert found(df, rebuild) == plain(ODD, rebuild)


def test_small_shards_and_pieces_give_the_same_nodes(spark, sf, monkeypatch):
    """Shards of 20 rows and pieces of two ids, in this process: tasks read the module's own values."""
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert found(df) == plain(rows)
    monkeypatch.setattr(prefix_trie, "SHARD", 20)
    paths = [(c, d, c if d else 0, d, 1, d == 3) for c in range(30) for d in range(4)]
    batches = [prefix_trie._batch(paths[k : k + 7]) for k in range(0, len(paths), 7)]
    shards = list(prefix_trie._shards(iter(batches)))
    assert pa.concat_tables(shards).num_rows == len(paths) and len(shards) > 3
    assert all(t.column("depth")[0].as_py() == 0 and t.column("depth")[t.num_rows - 1].as_py() == 3 for t in shards)
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    ends = pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 2]), pa.array([0, 0, 0, 0]), pa.array([3, 5, 9, 4])], ["d1", "d2", "conv_id"])
    pieces = list(prefix_trie._pieces(iter([ends])))
    assert pieces[0].column(3).to_pylist() == ["3,5", "9", "4"]
    shas = [r for b in prefix_trie._hashes(iter(pieces)) for r in b.to_pylist()]
    assert [r["ends_sha256"] for r in shas] == [hashlib.sha256(x).hexdigest() for x in (b"3,5,9", b"4")]


def test_empty_table(spark):
    assert prefix_trie.trie(prefix_trie.with_roots(prefix_trie.turns(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_a_first_turn_common_to_most_and_a_deep_conversation(spark):
    rows = [(c, 0, "user", "the same") for c in range(3000)] + [(c, 1, "assistant", f"answer {c}") for c in range(2500)] + [(9999, d, "user", f"t{d}") for d in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = prefix_trie.trie(prefix_trie.with_roots(prefix_trie.turns(df)))
    top = {r["depth"]: r for r in nodes.filter("n_convs > 1").collect()}
    assert top[0]["n_convs"] == 3001 and top[0]["n_leaves"] == 2501 and top[0]["n_children"] == 2
    assert top[1]["n_convs"] == 3000 and top[1]["n_children"] == 2500 and top[1]["saved_tokens"] == 2999 * 8
    assert top[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(2500, 3000))).encode()).hexdigest()
    assert nodes.filter("depth = 2 and parent_conv_id = 0").count() == 2500
    assert nodes.agg(F.max("depth"), F.count("*")).first() == (3000, 1 + 1 + 2500 + 3000)


def test_slots_are_a_bijection_and_unknown_digests_have_none():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    table = prefix_trie.NodeTable(np.concatenate([keys, keys[:1000]]))
    assert table.n == 5000
    assert sorted(table.slots(keys)) == list(range(5000))
    assert (table.slots(rng.integers(0, 1 << 63, (500, 2)).astype(np.uint64)) == -1).all()
    assert prefix_trie.NodeTable(np.zeros((0, 2), np.uint64)).n == 0
