import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pulsefield.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SPACE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(?:s?(?:ua)+)?")


def cheapest(rows):
    """The least (cost, audit) by every audit up to a length, without bounds; rows are (initial, must go, truncated)."""
    best = (10**9, "")
    most = 3 * len(rows)  # deleting all is legal
    stack = [(0, "", "", 0)]
    while stack:
        at, roles, audit, cost = stack.pop()
        if cost > most or cost > best[0]:
            continue
        if at == len(rows) and LEGAL.fullmatch(roles):
            best = min(best, (cost, audit))
        for r in "ua":
            stack.append((at, roles + r, audit + "I", cost + 2))
        if at < len(rows):
            initial, gone, cut_off = rows[at]
            stack.append((at + 1, roles, audit + "D", cost + 3))
            if not gone:
                stack.append((at + 1, roles + (initial or "?"), audit + "K", cost + cut_off))
                stack += [(at + 1, roles + r, audit + "R", cost + 2 + cut_off) for r in "ua"]
    return best


def least_first(rows):
    """The least (cost, audit) by a queue in that order, without bounds or a stack."""
    queue, seen = [(0, "", 0, "")], set()
    while True:
        cost, audit, at, roles = heapq.heappop(queue)
        if (at, roles[-1:]) in seen:
            continue
        seen.add((at, roles[-1:]))
        if at == len(rows) and roles[-1:] in ("", "a"):
            return cost, audit
        after = "a" if roles.endswith("u") else "u"
        heapq.heappush(queue, (cost + 2, audit + "I", at, roles + after))
        if at < len(rows):
            initial, gone, cut_off = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, roles))
            if not gone:
                heapq.heappush(queue, (cost + 2 + cut_off, audit + "R", at + 1, roles + after))
                if initial == after or (initial == "s" and not roles):
                    heapq.heappush(queue, (cost + cut_off, audit + "K", at + 1, roles + initial))


def plain(rows, damage=True):
    convs = {}
    sp = lambda v: " " if v is None else str(v)
    for c, turn, role, text in rows:
        role, text, copies = sp(role), sp(text), 1
        kind = zlib.crc32(f"{sp(c)}:{sp(turn)}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs.setdefault(c, []).extend([(turn is not None, turn or 0, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = []
    for c, held in convs.items():
        seen, coded, faults = set(), [], Counter()
        held = sorted(held)
        for _, _, role, text in held:
            last = text.rstrip(SPACE)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            coded.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for known, t, _, _ in held if known}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(coded))
        cost, audit = least_first(coded)
        done, rest = [], iter(held)
        for edit in audit:
            before = done[-1].split(":")[0][:1] if done else "s"
            name = "assistant" if before == "u" else "user"
            if edit == "I":
                done.append(f"{name}:")
            else:
                _, _, role, text = next(rest)
                if edit != "D":
                    done.append(f"{role if edit == 'K' else name}:{text}")
        sha = hashlib.sha256("\n".join(done).encode()).hexdigest()
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha))
    return Counter(out)


def found(df, damage=True):
    rows = cr.damaged(df) if damage else df
    return Counter(tuple(r) for r in cr.repair(rows, F.col("gone") if damage else None).select(*COLUMNS).collect())


def test_search_equals_every_audit_on_random_conversations():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice("suuaaax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 3))]
        rows = [(i, g, c and not g) for i, g, c in rows]
        assert cr.search(rows) == cheapest(rows) == least_first(rows), rows


def test_search_equals_the_queue_on_longer_conversations():
    rng = random.Random(5)
    for _ in range(400):
        rows = [(rng.choice("suuaaax"), rng.random() < 0.2, False) for _ in range(rng.randint(0, 30))]
        rows = [(i, g, not g and rng.random() < 0.2) for i, g, _ in rows]
        assert cr.search(rows) == least_first(rows), rows


def test_search_stays_exact_with_weaker_bounds(monkeypatch):
    """Bounds of what must go alone: the incumbent and the dominance tables then do the work."""
    def weak(rows):
        left, out = 0, [[0] * 4]
        for _, gone, cut_off in reversed(rows):
            left += 3 if gone else 0
            out.append([left] * 4)
        return out[::-1]

    rng = random.Random(4)
    cases = [[(rng.choice("suuaa"), rng.random() < 0.2, False) for _ in range(rng.randint(0, 9))] for _ in range(60)]
    exact = [cr.search(rows) for rows in cases]
    monkeypatch.setattr(cr, "bounds", weak)
    assert [cr.search(rows) for rows in cases] == exact


def test_a_long_conversation_is_searched_in_linear_steps():
    rows = [("ua"[k % 2 if k % 7 else 0], k % 11 == 0, k % 5 == 0 and k % 11 > 0) for k in range(20_000)]
    cost, audit = cr.search(rows)
    assert sum(e != "I" for e in audit) == len(rows) and cost < 3 * len(rows)


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, None, None, None), (2, 3, "user", "no end"), (3, 0, "system", "Be good."), (3, 1, "assistant", "Fine!"), (3, 1, "assistant", "Fine!"), (3, 9, "user", " \t"),
    (None, 0, "user", "Lost?"), (None, None, "assistant", "Found."), (4, 0, "", "Empty role."), (4, 1, "User", "Upper."), (5, 0, "user", "long " * 40_000 + "."), (5, 1, "assistant", "Short. \n"), (6, -4, "user", "naïve ☃."), (7, 0, "assistant", "A."),
    *((k, 0, "user", "Only.") for k in range(20, 60)),
]


@pytest.mark.parametrize("damage", [True, False])
def test_odd_rows_equal_the_plain_version(spark, damage):
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in ("found", "cost", "h1", "audit", "initial", "copies")})
    if not damage:
        df = df.withColumn("gone", F.lit("x"))
    assert found(df, damage) == plain(ODD, damage)


def test_corpus_equals_the_plain_version(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert found(df) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_empty_table(spark):
    assert cr.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_conversation_that_is_gone_has_zeros(spark):
    df = spark.createDataFrame([(1, 0, "user", "x.")], SCHEMA)
    assert tuple(cr.repair(df, F.lit(True)).first()) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
