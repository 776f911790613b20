"""Conversations: prefix trie and structure repair against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache

import pytest

from xrefloom.llm import prefix_trie, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed: int) -> list[tuple]:
    """Shared beginnings, repeated turns and rows, nulls, odd roles, hundreds without a first conversation."""
    r = random.Random(seed)
    texts = ["Hello there.", "So it goes", "What? ", "", " \t", "Yes!", "é no", None]
    out = []
    for conv in [*range(0, 12), *range(100, 104), *range(205, 212), 300, 1000001]:
        turns = [(k, r.choice(["user", "assistant"]) if r.random() < 0.3 else ("user", "assistant")[k % 2], r.choice(texts)) for k in range(r.choice([0, 1, 2, 4, 6, 9]))]
        if r.random() < 0.3:
            turns = [(-1, "system", "Be kind."), *turns]
        for turn, role, text in turns:
            out += [(conv, None if r.random() < 0.1 else turn * r.choice([1, 1, 1, 2]), None if r.random() < 0.05 else r.choice([role, role, role, "tool", ""]), text)] * r.choice([1, 1, 1, 1, 2])
    r.shuffle(out)
    return out


def ordered(rows: list[tuple]) -> dict[int, list[tuple]]:
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role, text))
    return {c: sorted(v) for c, v in by.items()}


def trie(rows: list[tuple]) -> set[tuple]:
    own = {c: [x[2:] for x in v] for c, v in ordered([(c, t, r or "", x or "") for c, t, r, x in rows]).items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = sum(1 for n in below if not any(len(m) == len(n) + 1 and m[:-1] == n for m in members))
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        children = sum(1 for m in members if len(m) == len(node) + 1 and m[:-1] == node)
        ends = ",".join(map(str, sorted(c for c in convs if len(full[c]) == len(node))))
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 4), (3, 2)])
def test_trie_equals_brute_force(spark, seed, block):
    rows = conversations(seed)
    got = [tuple(r) for r in prefix_trie.rebuilt_trie(spark.createDataFrame([*rows, (None, 1, "user", "x")], SCHEMA), block).collect()]
    assert len(got) == len(set(got)) and set(got) == trie(rows)


def test_trie_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 5)
    rows = [(c, t, "user", f"t{t}" if t != 57 else f"{c % 3}") for c in range(400, 409) for t in range(60 if c % 2 else 75)]
    got = {tuple(r) for r in prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    assert got == trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.rebuilt_trie(empty).count() == 0
    clash = spark.createDataFrame([(7, 0, "user", "x", "a", {"y": 1})], SCHEMA + ", node string, `odd name` map<string,int>")
    assert {tuple(r) for r in prefix_trie.rebuilt_trie(clash).collect()} == trie([(7, 0, "user", "x")])


def cheapest(rows: list[tuple]) -> tuple[int, str, list[tuple]]:
    """All cheapest edits by plain recursion: rows are (role, text, must go, truncated)."""

    @cache
    def best(i: int, state: str, inserts: int):
        options = []
        if i == len(rows) and state in ("", "sua", "ua"):
            options.append((0, "", ()))
        want = "assistant" if state.endswith("u") else "user"
        steps = []
        if i < len(rows):
            role, text, gone, cut = rows[i]
            steps.append((2, "D", i + 1, state, (), 0))
            if not gone:
                if role[:1] == want[:1] or (role[:1] == "s" and state == ""):
                    steps.append((5 * cut, "K", i + 1, after(state, role[:1]), ((role, text),), 0))
                steps.append((1 + 5 * cut, "R", i + 1, after(state, want[0]), ((want, text),), 0))
        if inserts < 2:
            steps.append((5, "I", i, after(state, want[0]), ((want, ""),), inserts + 1))
        for cost, edit, j, to, rows_, n in steps:
            if (rest := best(j, to, n)) is not None:
                options.append((cost + rest[0], edit + rest[1], rows_ + rest[2]))
        return min(options, default=None)

    def after(state: str, initial: str) -> str:
        return {"s": "s", "u": "u", "a": "ua"}[initial]

    return best(0, "", 0)


def repairs(rows: list[tuple]) -> dict:
    by = defaultdict(list)
    convs = {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        fate = zlib.crc32(f"{conv if conv is not None else ' '}:{turn if turn is not None else ' '}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(x for x in text if x not in ".!?") if fate == 2 else text
        by[conv] += [(turn is not None, turn or 0, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for c in convs:
        own, seen, faults, plain = sorted(by[c]), set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, _, role, text in own:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            plain.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for known, t, _, _ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(plain, plain[1:], strict=False))
        cost, audit, fixed = cheapest(tuple(plain))
        out[c] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (4, 1), (5, 2), (6, 3), (7, 5)])
def test_repair_equals_brute_force(spark, seed, block):
    rows = [*conversations(seed), *conversations(seed + 50), (None, 3, "user", "Hi."), (None, None, None, None)]
    got = repair.repair(repair.damaged(spark.createDataFrame(rows, SCHEMA)), block_rows=block).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == repairs(rows) and len(got) == len({r[0] for r in rows})


def test_search_in_blocks_equals_one_search():
    r = random.Random(8)
    for _ in range(300):
        rows = [(r.choice("suax"), r.random() < 0.15, r.random() < 0.3) for _ in range(r.randrange(1, 30))]
        whole = repair.search([(0, 0)], rows, True)[0]
        live, size = [(0, 0, "")], r.choice([1, 2, 7])
        for k in range(0, len(rows), size):
            live = [(s, c, live[i][2] + a) for s, c, i, a in repair.search([x[:2] for x in live], rows[k : k + size], k + size >= len(rows))]
        assert (live[0][1], live[0][2]) == (whole[1], whole[3])


def test_repair_of_nothing_and_of_dropped_rows(spark):
    assert repair.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = repair.repaired(spark.createDataFrame([(5, gone, "user", "x", 1)], SCHEMA + ", gone int")).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
