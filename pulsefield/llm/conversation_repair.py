"""Conversation structure repair: the cheapest edits that give a conversation legal roles, by branch and bound.

Roles are legal when their initials read `(s?(ua)+)?`. Keeping a row costs 0, reroling it to user or assistant 2,
deleting it 3, inserting an empty user or assistant row 2; blank rows and duplicates must go, and a truncated
row that stays adds 1. The audit is the edits' initials (D, I, K, R) in order. Of equally cheap audits the one
that is least in ASCII is taken.

`search` goes depth first with a stack of its own. A node is a row, a state of the role pattern and the cost so
far; a sweep from the end gives each row and state a lower bound of what must still be paid. The child of the
least bound is entered first. A node is left when its bound exceeds the incumbent (cost, audit), when it ties
with it and its audit is greater, or when a dominance table shows that its row and state were reached as
cheaply by a smaller audit. When the stack is empty the incumbent is proved the best.

Texts are not needed to search: each row goes as its initial, its faults and two hashes, sorted by conversation
through the tasks. The audits then meet the texts, which stream past once to be hashed. A task holds some hundred
bytes a row of one conversation, never its texts; a conversation is one task's, as its SHA-256 is one stream.

Defined cases: a null role or text is one space (so it is blank); a null conv_id is a conversation of its own;
turns are ordered null first, turns of one number by role and the hash of role and text, so that equal rows
are adjacent; very long texts are read whole; an empty table gives an empty result; other columns, whatever their
names, are never read. Ids and turns are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefield.llm.common import cut, shuffle_partitions

SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the pattern: nothing yet, after s, after u, after a. What an inserted or reroled row becomes, and then is.
NEXT_ROLE, NEXT_STATE = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (True, False, False, True)
_NONE = 1 << 60


def children(rows: list[tuple[str, bool, bool]], at: int, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, its cost, next row, next state) from before row `at`; rows are (initial, must go, truncated)."""
    out = []
    if at < len(rows):
        initial, gone, cut_off = rows[at]
        out.append(("D", DELETE, at + 1, state))
        if not gone:
            if initial in KEEPS[state]:
                out.append(("K", TRUNCATED * cut_off, at + 1, KEEPS[state][initial]))
            out.append(("R", REROLE + TRUNCATED * cut_off, at + 1, NEXT_STATE[state]))
    out.append(("I", INSERT, at, NEXT_STATE[state]))
    return out


def bounds(rows: list[tuple[str, bool, bool]]) -> list[list[int]]:
    """For each row (and the end) and state, what must be paid at least from there on."""
    out = [[_NONE] * 4 for _ in range(len(rows) + 1)]
    for at in range(len(rows), -1, -1):
        here = out[at]
        for state in range(4):
            ahead = [cost + out[to][after] for edit, cost, to, after in children(rows, at, state) if edit != "I"]
            here[state] = min(ahead, default=0 if ENDS[state] else _NONE)
        for _ in range(2):  # inserts go from state to state at one row; after two no way is new
            for state in range(4):
                here[state] = min(here[state], INSERT + here[NEXT_STATE[state]])
    return out


def search(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """The least (cost, audit) of a conversation."""
    low = bounds(rows)
    edits, above = [""], [-1]  # nodes of the tree: the edit that led there, and the node before
    best_cost, best, on_best = _NONE, "", {}
    reached: dict[tuple[int, int], tuple[int, int]] = {}  # row, state: the least cost there, and the node that had it
    stack = [(0, 0, 0, 0)]  # node, row, state, cost

    def audit(node: int) -> str:
        path = []
        while node > 0:
            path.append(edits[node])
            node = above[node]
        return "".join(reversed(path))

    def greater(node: int) -> bool:
        """Whether all audits from this node on are greater than the incumbent's."""
        tail = []
        while node not in on_best:
            tail.append(edits[node])
            node = above[node]
        return "".join(reversed(tail)) > best[on_best[node] : on_best[node] + len(tail)]

    while stack:
        node, at, state, cost = stack.pop()
        bound = cost + low[at][state]
        if bound > best_cost or (bound == best_cost and greater(node)):
            continue
        before = reached.get((at, state))
        # Equal costs: neither audit begins with the other, for what an audit goes on with at one row are inserts.
        if before and (before[0] < cost or (before[0] == cost and audit(before[1]) < audit(node))):
            continue
        reached[at, state] = (cost, node)
        if at == len(rows) and ENDS[state]:
            best_cost, best, on_best = cost, audit(node), {}
            for k in range(len(best), -1, -1):
                on_best[node] = k
                node = above[node]
            continue  # what follows an end costs more
        ahead = [(cost + c + low[to][after], edit, c, to, after) for edit, c, to, after in children(rows, at, state)]
        for total, edit, c, to, after in sorted(ahead, reverse=True):
            if total <= best_cost:
                edits.append(edit)
                above.append(node)
                stack.append((len(edits) - 1, to, after, cost + c))
    return best_cost, best


_FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _judged(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit of one conversation's (turn, initial, blank, truncated, h1, h2)."""
    seen, coded, faults = set(), [], [0, 0, 0]
    for _, initial, blank, cut_off, h1, h2 in rows:
        duplicate = (h1, h2) in seen
        seen.add((h1, h2))
        fault = 0 if blank else 1 if duplicate else 2 if cut_off else None
        if fault is not None:
            faults[fault] += 1
        coded.append((initial, blank or duplicate, fault == 2))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:], strict=False))
    return (gaps, *faults, illegal, *search(coded))


def _search_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, gone, turn, initial, blank, truncated, h1, h2) to a row per conversation."""
    now, rows, begun = None, [], False
    kinds = [pa.int64()] * 7 + [pa.string()]
    names = ["conv_id", *[x.split()[0] for x in _FOUND.split(", ")]]
    pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 8, kinds, strict=True)], names)
    for batch in batches:
        out = []
        for conv, gone, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or conv != now:
                if begun:
                    out.append((now, *_judged(rows)))
                now, rows, begun = conv, [], True
            if not gone:
                rows.append(tuple(row))
        yield pack(out)
    if begun:
        yield pack([(now, *_judged(rows))])


class _Repaired:
    """The SHA-256 of a repaired conversation, fed row by row in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first, self.sha = audit, 0, 0, True, hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._write(NEXT_ROLE[self.state], "")
            self.state, self.at = NEXT_STATE[self.state], self.at + 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self._write(role, text)
            self.state = KEEPS[self.state][role[:1]]
        elif edit == "R":
            self._write(NEXT_ROLE[self.state], text)
            self.state = NEXT_STATE[self.state]

    def end(self) -> str:
        self._insert()
        return self.sha.hexdigest()


def _hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, found, role, text), a conversation's row with `found` before its texts, to the results."""
    held, state = None, None
    names = [x.split()[0] for x in _FOUND.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 9, kinds, strict=True)], ["conv_id", *names, "repaired_sha256"])
    for batch in batches:
        out = []
        for conv, found, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if found is not None:
                if held is not None:
                    out.append((*held, state.end()))
                held, state = (conv, *(found[n] for n in names)), _Repaired(found["audit"])
            else:
                state.row(role, text)
        yield pack(out)
    if held is not None:
        yield pack([(*held, state.end())])


def repair(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Rows where `gone` holds are not part of it, but a conversation of such rows alone is in the result.
    """
    n = shuffle_partitions(conversations)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), (F.lit(False) if gone is None else gone).alias("gone"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text")
    )
    rows = rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("second"), "text", "role")})
    order = [F.asc_nulls_first("turn"), "role", "h1", "h2"]
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    light = rows.select("conv_id", "gone", "turn", F.left("role", F.lit(1)).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut_off"), "role", "h1", "h2")
    light = light.repartition(n, "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *order)
    found = cut(light.select("conv_id", "gone", "turn", "initial", "blank", "cut_off", "h1", "h2").mapInArrow(_search_all, f"conv_id long, {_FOUND}"))
    heads = found.select("conv_id", F.struct(*found.columns[1:]).alias("found"))
    both = heads.unionByName(rows.filter("not gone"), allowMissingColumns=True)
    both = both.repartition(n, "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.col("found").isNull(), *order)
    return both.select("conv_id", "found", "role", "text").mapInArrow(_hash_all, f"conv_id long, {_FOUND}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows with the faults that crc32 of `conv_id:turn` modulo 20 names.

    0 marks the row as gone, 1 empties the text, 2 takes its marks `[.!?]`, 3 repeats the row, 4 makes it the user's.
    A null is one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies.alias("copy")).drop("copy")
