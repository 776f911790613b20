"""Conversation structure repair: A* on the edit lattice of every conversation.

A conversation is to have role initials of the form (s?(ua)+)?. A lattice point is (rows read, state), with the states
START (nothing written), SYSTEM (a leading system row written; a user row must follow), USER (an assistant row must follow)
and PAIR (complete; a user row may follow). Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (all that a blank or
duplicate row allows), Insert a row with an empty text 5; a truncated row that stays costs 5 more.

The search pops points by (cost plus heuristic, audit). The heuristic is the suffix sum of what the rows still to come
cost in any case: 2 for each blank or duplicate row (its deletion) and 2 for each truncated one (deleted for 2 or kept for
5). It never falls by more than an edit costs, so the first pop of a point is its cheapest path with the smallest audit.

Rows come in order, one conversation after the other, and are searched in blocks of bounded rows and bytes: a block starts
from the at most four states that the rows before can have led to, each with its cost, its rank by audit and the running
hash of what it has written. Costs to go from any two states differ by 10 at most, so a state that is dearer by more than
that is dropped without loss. All of a conversation's paths up to one row end in an edit that reads a row, so none of their
audits continues another, and ranks order them as whole audits would. A task so holds one block, the audit of its
conversation and four hashes, however long the conversation is; the contract's hash of the whole repaired text is one
sequential pass over a conversation in any case.

Rows that repeat a role and text of an earlier turn are found by a join on hashes beforehand, not by a set in the task.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql

START, SYSTEM, USER, PAIR = range(4)
DELETE, RESTORE, INSERT, CUT = 2, 1, 5, 5
#: No state's cost to go exceeds another's by more: two rows are inserted (5 each).
SPREAD = 2 * INSERT
LEGAL = {"su", "ua", "au"}
ENDS, SPACE = ".!?", " \t\n\v\f\r"
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def expected(state: int) -> tuple[str, int]:
    """The role that a state asks for, and the state after it."""
    return ("assistant", PAIR) if state == USER else ("user", USER)


def kept(state: int, initial: str) -> int | None:
    """The state after a row whose role has this initial; None if it may not stand here."""
    if initial == "s":
        return SYSTEM if state == START else None
    role, after = expected(state)
    return after if initial == role[0] else None


def search(entries: list[tuple[int, int]], rows: list[tuple[str, bool, bool]], last: bool) -> list[tuple[int, int, int, str]]:
    """A* over a block of rows (role initial, must go, truncated) from entries (state, cost), which are in order of their audits.

    Returns exits (state, cost, index of the entry, audit of the block) in order of their whole audits: the one cheapest
    exit of the conversation's last block; all exits within SPREAD of the cheapest one otherwise.
    """
    n = len(rows)
    due = [*accumulate(((DELETE if gone or cut else 0) for _, gone, cut in reversed(rows)), initial=0)][::-1]
    heap = [(cost + due[0], k, "", 0, state, cost) for k, (state, cost) in enumerate(entries)]
    heapq.heapify(heap)
    done: set[tuple[int, int]] = set()
    exits, best = [], None

    def push(cost: int, k: int, audit: str, at: int, state: int) -> None:
        if (at, state) not in done:
            heapq.heappush(heap, (cost + due[at], k, audit, at, state, cost))

    while heap:
        f, k, audit, at, state, cost = heapq.heappop(heap)
        if best is not None and f > best + SPREAD:
            break
        if (at, state) in done:
            continue
        done.add((at, state))
        role, after = expected(state)
        if at == n:
            if not last:
                best = f if best is None else best
                exits.append((state, cost, k, audit))
                continue
            if state in (START, PAIR):
                return [(state, cost, k, audit)]
        else:
            initial, gone, cut = rows[at]
            push(cost + DELETE, k, audit + "D", at + 1, state)
            if not gone:
                stay = CUT if cut else 0
                if (to := kept(state, initial)) is not None:
                    push(cost + stay, k, audit + "K", at + 1, to)
                push(cost + RESTORE + stay, k, audit + "R", at + 1, after)
        push(cost + INSERT, k, audit + "I", at, after)
    return sorted(exits, key=lambda x: x[2:])


class _Conversation:
    """One conversation as its rows come in."""

    def __init__(self, conv_id, block_rows: int, block_bytes: int):
        self.conv_id, self.most, self.most_bytes = conv_id, block_rows, block_bytes
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.before = None
        self.turns = 0
        self.rows, self.faults, self.size = [], [], 0
        # of each live state: state, cost, audit so far as a chain of (chain before, part), hash, whether it has written a row
        self.live = [(START, 0, None, hashlib.sha256(), False)]

    def add(self, turn, role: str, text: str, again: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.before is not None:
            self.counts["illegal"] += (self.before[1][:1] + role[:1]) not in LEGAL
        body = text.rstrip(SPACE)
        # the rows of one turn are sorted, so an equal one is the row before
        fault = "blank" if not body else "duplicate" if again or self.before == (turn, role, text) else "truncated" if body[-1] not in ENDS else ""
        if fault:
            self.counts[fault] += 1
        self.before = (turn, role, text)
        if self.rows and (len(self.rows) >= self.most or self.size + len(text) > self.most_bytes):
            self._block(False)
        self.rows.append((role, text))
        self.faults.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        self.size += len(text)

    def _block(self, last: bool) -> None:
        live = []
        for state, cost, k, part in search([(s, c) for s, c, *_ in self.live], self.faults, last):
            at, _, chain, digest, wrote = self.live[k]
            digest = digest.copy()
            rows = iter(self.rows)
            for edit in part:
                role, text = next(rows) if edit != "I" else ("", "")
                if edit == "D":
                    continue
                want, after = expected(at)
                at, role = (kept(at, role[:1]), role) if edit == "K" else (after, want)
                digest.update(f"{chr(10) if wrote else ''}{role}:{text}".encode())
                wrote = True
            live.append((state, cost, (chain, part), digest, wrote))
        self.live, self.rows, self.faults, self.size = live, [], [], 0

    def result(self) -> tuple:
        self._block(True)
        _, cost, chain, digest, _ = self.live[0]
        parts = []
        while chain is not None:
            chain, part = chain
            parts.append(part)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), cost, "".join(reversed(parts)), digest.hexdigest())


def _repairer(block_rows: int, block_bytes: int):
    names = [c.split()[0] for c in OUT.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in OUT.split(", ")]

    def run(batches):
        now, done, size = None, [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

        for b in batches:
            for conv, turn, role, text, gone, again in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "again")), strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.result())
                        size += len(done[-1][7])
                        if len(done) >= 2000 or size > 4 << 20:
                            yield batch()
                            done, size = [], 0
                    now = _Conversation(conv, block_rows, block_bytes)
                if not gone:
                    now.add(turn, role, text, again)
        if now is not None:
            done.append(now.result())
            yield batch()

    return run


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to conv_id, turn, role, text, by the crc32 of `conv_id:turn` (nulls: one space) modulo 20: 1 empties the text,
    2 takes out its sentence ends, 3 repeats the row, 4 makes the role user; 0 drops the row, which stays here marked as gone, without texts."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    d = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fate"))
    role = F.when(F.col("fate") == 0, "").when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("gone"), F.explode(copies).alias("_copy")).drop("_copy")


def order() -> list[Column]:
    """Rows of a conversation by turn, null first; rows of one turn by role and text."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def repair(rows: DataFrame, block_rows: int = 512, block_bytes: int = 4 << 20) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text, gone): faults, cheapest edits and the hash of the repaired conversation.

    Rows marked gone count for nothing but keep their conversation in the result; a conversation without others has zeros, an
    empty audit and the hash of nothing. A null conv_id is a conversation of its own. Roles and texts are not null; an empty
    role has no initial. Equal rows of one turn stand next to each other, and all but the first are duplicates. An empty
    table gives an empty table. Further columns are left out.
    """
    key = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.octet_length("role").cast("string"), "role", "text"), 256))
    keyed = rows.withColumn("_key", key)
    # role and text at several turns of a conversation; their rows after the first turn (null comes before all) are duplicates
    turns = keyed.filter(~F.col("gone")).groupBy("_key").agg(F.min("turn").alias("_low"), F.max("turn").alias("_high"), F.max(F.col("turn").isNull()).alias("_none"))
    several = turns.filter("_low <> _high or (_none and _low is not null)").select("_key", "_low", "_none")
    again = (F.col("_none") & F.col("turn").isNotNull()) | (F.col("turn") > F.col("_low"))
    marked = keyed.join(several, "_key", "left").select("conv_id", "turn", "role", "text", "gone", F.coalesce(again, F.lit(False)).alias("again"))
    return marked.repartition("conv_id").sortWithinPartitions("conv_id", *order()).mapInArrow(_repairer(block_rows, block_bytes), OUT)


def repaired(conversations: DataFrame) -> DataFrame:
    """The contract's result over conversations (conv_id, turn, role, text): damaged first, then repaired."""
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return repair(damaged(own))



def duckdb_sql() -> str:
    """The repair of the table conversations in DuckDB: the cheapest edits by going over the lattice row by row."""
    fate = crc32_sql("name")
    body = "regexp_replace(text, '[ \\t\\n\\v\\f\\r]+$', '')"

    def edit(before: str, cost: str, letter: str, row: str = "") -> str:
        text = f"coalesce({before}.t || chr(10), '') || {row}" if row else f"{before}.t"
        return f"CASE WHEN {before} IS NOT NULL THEN {{'c': {before}.c + {cost}, 'a': {before}.a || '{letter}', 't': {text}}} END"

    def put_in(before: str, role: str) -> str:
        return edit(before, str(INSERT), "I", f"'{role}:'")

    least = lambda *x: f"list_min([{', '.join(x)}])"
    into = {START: [], SYSTEM: [("w0", "s")], USER: [("w0", "u"), ("w1", "u"), ("w3", "u")], PAIR: [("w2", "a")]}
    stays = f"{CUT} * cut"

    def step(state: int) -> str:
        out = [edit(f"w{state}", str(DELETE), "D")]
        for before, initial in into[state]:
            out.append(f"CASE WHEN NOT gone AND left(role, 1) = '{initial}' THEN {edit(before, stays, 'K', 'role || chr(58) || text')} END")
            if initial != "s":
                role = {"u": "user", "a": "assistant"}[initial]
                out.append(f"CASE WHEN NOT gone THEN {edit(before, f'{RESTORE} + {stays}', 'R', f'{chr(39)}{role}:{chr(39)} || text')} END")
        return least(*out)

    # inserts before a row: into USER from the three other states, and from there into PAIR
    more_user = least("v2", *(put_in(f"v{s}", "user") for s in (START, SYSTEM, PAIR)))
    kind = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    return f"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
fated AS (SELECT conv_id, turn, role, text, {fate} % 20 AS fate FROM named),
rows_ AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fated),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM rows_),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS role_before, {body} AS body FROM placed),
faulty AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM seen),
lattice AS (SELECT conv_id, i, role, text, fault IN ('b', 'd') AS gone, (fault = 't')::INT AS cut FROM faulty),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (role_before IS NOT NULL AND left(role_before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faulty GROUP BY conv_id),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 't': NULL}}::{kind} AS v0, NULL::{kind} AS v1, NULL::{kind} AS v2, NULL::{kind} AS v3 FROM conversations
  UNION ALL SELECT conv_id, i + 1, ({step(START)})::{kind}, ({step(SYSTEM)})::{kind}, ({step(USER)})::{kind}, ({step(PAIR)})::{kind} FROM (
    SELECT *, v0 AS w0, v1 AS w1, {least("v3", put_in("w2", "assistant"))} AS w3 FROM (
      SELECT walk.*, role, text, gone, cut, {more_user} AS w2 FROM walk JOIN lattice ON lattice.conv_id IS NOT DISTINCT FROM walk.conv_id AND lattice.i = walk.i + 1))),
ended AS (SELECT walk.conv_id, {least("v0", "v3", put_in("w2", "assistant"))} AS best FROM (SELECT *, {more_user} AS w2 FROM walk) AS walk LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM walk.conv_id WHERE i = coalesce(n, 0))
SELECT ended.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM ended LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ended.conv_id"""
