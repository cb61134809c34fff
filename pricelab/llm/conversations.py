"""Operator 11: conversation structure repair by Wagner-Fischer target alignment.

Grammar of a conversation's role initials: ``(s?(ua)+)?``.  A stretch of turns
is aligned to every feasible length of the alternating target string that can
stand there: one Wagner-Fischer table for each length, only within the Ukkonen
band that the cheapest alignment so far leaves, and the audits (edit initials)
that are traced back through the tables are compared where costs are equal.

The grammar has four states, so a stretch of at most ``STRETCH`` turns is known
by its cheapest alignment from each state to each state.  Insertions stand
before the turn they precede (those at the end of a conversation close it);
then no audit of a stretch begins another, a cheapest least audit of a
conversation is made of such audits of its stretches, and stretches combine in
order at constant size.  So a conversation of any length is spread over tasks:
turns are dealt by range of (conversation, turn), each task solves what it
holds whole, and conversations at its edges or beyond ``BLOCK`` turns go on as
blocks, of which only costs and the order of audits are put together.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize
from .common import small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: State of the grammar after a role initial: 0 start, 1 after s, 2 after u, 3 after a.
STATES = range(4)
NAME = {"u": "user", "a": "assistant"}
#: Edits that end a conversation in a state: user and assistant, or assistant, inserted.
CLOSING = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}
#: Turns aligned as one stretch; turns of one block of a long conversation.
STRETCH, BLOCK = 48, 4096
BLANK, DUPLICATE, CUT_OFF, SOUND = "b", "d", "t", "."

_INK = re.compile(r"[^\x20\x09-\x0D]")
_WHITE = "\x20\x09\x0A\x0B\x0C\x0D"


def targets(state: int) -> list[str]:
    """First symbols of the target strings that can follow ``state`` (each then alternates)."""
    return {0: ["s", "u"], 1: ["u"], 2: ["a"], 3: ["u"]}[state]


def target(first: str, length: int) -> str:
    """The alternating string of ``length`` that begins with ``first`` (s, u or a)."""
    pattern = {"s": "s" + "ua" * (length // 2), "u": "ua" * (length // 2 + 1), "a": "au" * (length // 2 + 1)}[first]
    return pattern[:length]


def table(turns: str, want: str, limit: float) -> tuple[float, str] | None:
    """Cheapest alignment of ``turns`` to ``want`` and its least audit; None if it costs more than ``limit``.

    ``turns`` has two characters a turn: role initial (any other: ``?``) and fault.
    costs[i][j]: cheapest edits of the turns from i on to the symbols from j on.
    """
    n, m, inf = len(turns) // 2, len(want), float("inf")
    skew = m - n
    low = high = 0                                             # band of j - i that a path within the limit can reach
    for sign, cost in ((1, INSERT), (-1, DELETE)):
        d = sign
        while abs(d) <= max(n, m) and (INSERT * max(d, 0) + DELETE * max(-d, 0)
                                       + INSERT * max(skew - d, 0) + DELETE * max(d - skew, 0)) <= limit:
            d += sign
        low, high = (low, d - 1) if sign > 0 else (d + 1, high)
    if not low <= skew <= high:
        return None
    costs = [{} for _ in range(n + 1)]
    costs[n][m] = 0
    for i in range(n - 1, -1, -1):
        role, fault = turns[2 * i], turns[2 * i + 1]
        gone = fault in (BLANK, DUPLICATE)
        fix = TRUNCATED if fault == CUT_OFF else 0
        here, after = costs[i], costs[i + 1]
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            best = DELETE + after.get(j, inf)
            if j < m:
                best = min(best, INSERT + here.get(j + 1, inf))
                if not gone:
                    step = KEEP if role == want[j] else REROLE if want[j] != "s" else inf
                    best = min(best, step + fix + after.get(j + 1, inf))
            here[j] = best
    total = costs[0].get(0, inf)
    if total > limit:
        return None
    audit, i, j = [], 0, 0
    while i < n:                                               # D, I, K, R: the least edit that keeps to the cost
        role, fault = turns[2 * i], turns[2 * i + 1]
        here = costs[i][j]
        fix = TRUNCATED if fault == CUT_OFF else 0
        if here == DELETE + costs[i + 1].get(j, inf):
            audit.append("D")
            i += 1
        elif j < m and here == INSERT + costs[i].get(j + 1, inf):
            audit.append("I")
            j += 1
        else:
            audit.append("K" if role == want[j] else "R")
            i, j = i + 1, j + 1
    return total, "".join(audit)


@lru_cache(maxsize=100_000)
def stretch(turns: str, state: int) -> dict[int, tuple[float, str]]:
    """(cost, audit) of the cheapest alignment of a stretch from ``state`` to each state that it can end in."""
    n = len(turns) // 2
    found: dict[int, tuple[float, str]] = {}
    for first in targets(state):
        # lengths from the stretch's own outwards: near ones give the incumbent that bounds the others
        for length in sorted(range(0 if first != "s" else 1, 2 * n + 4), key=lambda m: (abs(m - n), m)):
            want = target(first, length)
            end = {"s": 1, "u": 2, "a": 3}[want[-1]] if want else state
            best = found.get(end)
            got = table(turns, want, best[0] if best else 10 ** 9)
            if got is not None and (best is None or got < best):
                found[end] = got
    return found


def chain(first: dict[int, tuple], then: Callable[[int], dict[int, tuple]]) -> dict[int, tuple]:
    """The cheapest least audits of a part and the part after it."""
    out: dict[int, tuple] = {}
    for state, (cost, audit) in first.items():
        for end, (more, rest) in then(state).items():
            got = (cost + more, audit + rest)
            if end not in out or got < out[end]:
                out[end] = got
    return out


def through(turns: str, state: int) -> dict[int, tuple[float, str]]:
    """stretch() for any number of turns."""
    out = {state: (0, "")}
    for i in range(0, len(turns), 2 * STRETCH):
        out = chain(out, lambda s: stretch(turns[i:i + 2 * STRETCH], s))
    return out


def closed(turns: str) -> tuple[float, str]:
    """(cost, audit) of a whole conversation."""
    ends = through(turns, 0)
    return min((cost + CLOSING[s][0], audit + CLOSING[s][1]) for s, (cost, audit) in ends.items())


def repaired(rows: list[tuple[str, str]], audit: str, state: int = 0) -> tuple[list[tuple[str, str]], int]:
    """(role, text) of the turns that the edits leave, and the state they end in."""
    out, at = [], iter(rows)
    for edit in audit:
        due = "a" if state == 2 else "u"
        if edit == "I":
            out.append((NAME[due], ""))
        else:
            role, text = next(at)
            if edit == "D":
                continue
            if edit == "R":
                role = NAME[due]
            due = role[:1]
            out.append((role, text))
        state = {"s": 1, "u": 2, "a": 3}[due]
    return out, state


def fault_of(role: str, text: str, seen: bool) -> str:
    if not _INK.search(text):
        return BLANK
    if seen:
        return DUPLICATE
    return SOUND if text.rstrip(_WHITE)[-1] in ".!?" else CUT_OFF


def legal(before: str, role: str) -> bool:
    return before[:1] + role[:1] in ("su", "ua", "au")


def signature(roles: list[str], faults: list[str]) -> str:
    return "".join((r[:1] if r[:1] in ("s", "u", "a") and r else "?") + f for r, f in zip(roles, faults))


def damage(conversations: DataFrame) -> DataFrame:
    """The operator's test damage: rows of (conv_id, turn, role, text), nulls of role and text
    one space, by crc32 of ``conv_id:turn`` mod 20 dropped (0), emptied (1), without ``.!?`` (2),
    twice (3) or of role user (4)."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"),
                                text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("k")).where("k != 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")
_DEALT = RESULT + ", part int, number int, turns array<long>, roles array<string>, texts array<string>"
_SOLVED = ("conv_id long, part int, number int, faults string, costs array<long>, ranks array<int>, blank long, "
           "duplicate long, truncated long, illegal long, low long, high long, distinct long, "
           "first_turn long, last_turn long, first_role string, last_role string")
_CHOSEN = RESULT.replace(", audit string, repaired_sha256 string", ", part int, number int, state int, end int, last boolean")


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _arrow(schema: str) -> pa.Schema:
    """The schema as Arrow's, also inside a task, where Spark's own parser is not at hand."""
    return pa.schema([(name, pa.list_(_KINDS[kind[6:-1]]) if kind.startswith("array<") else _KINDS[kind])
                      for name, kind in (field.split(" ") for field in schema.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _key(role: str, text: str) -> bytes:
    r, t = role.encode(), text.encode()
    return hashlib.blake2b(len(r).to_bytes(8, "little") + r + t, digest_size=16).digest()


def _digest(rows: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def _faults(roles: list[str], texts: list[str], before: set[bytes]) -> list[str]:
    """Faults of a stretch of turns; ``before``: keys of the turns among them that earlier turns have."""
    seen, out = set(before), []
    for r, t in zip(roles, texts):
        key = _key(r, t)
        out.append(fault_of(r, t, key in seen))
        seen.add(key)
    return out


def _illegal(roles: list[str]) -> int:
    return sum(not legal(a, b) for a, b in zip(roles, roles[1:]))


def _whole(conv: int | None, turns: list, roles: list[str], texts: list[str]) -> tuple:
    """The result of a conversation that one task holds, and its repaired turns."""
    faults = _faults(roles, texts, set())
    cost, audit = closed(signature(roles, faults))
    rows, _ = repaired(list(zip(roles, texts)), audit)
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return (conv, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT_OFF), _illegal(roles), cost, audit,
            _digest(rows), None, None, None, [r for r, _ in rows], [t for _, t in rows])


def _deal(block: int, chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over sorted turns: results of the conversations that lie whole inside a task, blocks of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, schema = TaskContext.get().partitionId(), _arrow(_DEALT)
        out: list[tuple] = []
        held: list[tuple] = []                                 # (turn, role, text) of the conversation being read
        conv, number, size, inner, cut = None, 0, 0, False, False

        def as_block() -> tuple:
            return (conv, *[None] * 8, part, number, *map(list, zip(*held)))

        started = False
        for b in batches:
            for c, *row in zip(*(col.to_pylist() for col in b.columns)):
                if started and c != conv:
                    if inner and not cut:                      # neither the first nor the last one of the task
                        out.append(_whole(conv, *map(list, zip(*held))))
                    else:
                        out.append(as_block())
                        number += 1
                    held, size, inner, cut = [], 0, True, False
                elif held and (len(held) == block or size > chars):
                    out.append(as_block())
                    held, size, number, cut = [], 0, number + 1, True
                conv, started = c, True
                held.append(tuple(row))
                size += len(row[2])
            if len(out) > 200:
                yield _batch(out, schema)
                out = []
        if held:
            out.append(as_block())
        if out:
            yield _batch(out, schema)

    return run


def _seen_before(blocks: DataFrame) -> DataFrame:
    """(part, number, seen): keys of a block's turns that an earlier block of its conversation has."""
    schema = "conv_id long, part int, number int, keys array<binary>"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, p, n, sorted({_key(r, t) for r, t in zip(roles, texts)}))
                    for c, p, n, roles, texts in zip(*(col.to_pylist() for col in b.columns))]
            if rows:
                yield _batch(rows, _arrow(schema))

    has = blocks.select("conv_id", "part", "number", "roles", "texts").mapInArrow(keys, schema)
    has = materialize(has.select("conv_id", "part", "number", F.explode("keys").alias("key")), "turn-keys")
    first = (has.groupBy("conv_id", "key").agg(F.min(F.struct("part", "number")).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first"))
    later = has.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")))
    return (later.where(F.struct("part", "number") != F.col("first"))
            .groupBy("part", "number").agg(F.collect_list("key").alias("seen")))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: faults, cheapest cost from state to state (null: none) and the order of
    the audits from one state, and what the counts of the conversation need."""
    schema = _arrow(_SOLVED)
    for b in batches:
        rows = []
        for conv, part, number, turns, roles, texts, seen in zip(*(col.to_pylist() for col in b.columns)):
            faults = _faults(roles, texts, set(seen or ()))
            sign = signature(roles, faults)
            costs, ranks = [], []
            for state in STATES:
                ends = through(sign, state)
                order = sorted(audit for _, audit in ends.values())
                for end in STATES:
                    cost, audit = ends.get(end, (None, None))
                    costs.append(cost)
                    ranks.append(None if audit is None else order.index(audit))
            known = [t for t in turns if t is not None]
            rows.append((conv, part, number, "".join(faults), costs, ranks, faults.count(BLANK), faults.count(DUPLICATE),
                         faults.count(CUT_OFF), _illegal(roles), min(known, default=None), max(known, default=None),
                         len(set(known)), known[0] if known else None, known[-1] if known else None, roles[0][:1], roles[-1][:1]))
        if rows:
            yield _batch(rows, schema)


def _choose(blocks: pa.Table) -> pa.Table:
    """The states between the blocks of one conversation on its cheapest least audit; the last
    block's row has the conversation's counts."""
    rows = sorted(blocks.to_pylist(), key=lambda r: (r["part"], r["number"]))
    after = {s: CLOSING[s][0] for s in STATES}
    ways = []
    for r in reversed(rows):
        way, now = {}, {}
        for s in STATES:
            ends = [(r["costs"][4 * s + e] + after[e], r["ranks"][4 * s + e], e)
                    for e in STATES if r["costs"][4 * s + e] is not None and e in after]
            if ends:
                now[s], _, way[s] = min(ends)
        ways.append(way)
        after = now
    between = list(zip(rows, rows[1:]))
    distinct = sum(r["distinct"] for r in rows) - sum(
        a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in between)
    low, high = ([r[k] for r in rows if r[k] is not None] for k in ("low", "high"))
    totals = [sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal")]
    totals[3] += sum(not legal(a["last_role"], b["first_role"]) for a, b in between)
    gaps = max(high) - min(low) + 1 - distinct if low else 0
    out, state = [], 0
    for r, way in zip(rows, reversed(ways)):
        end = way[state]
        out.append((r["conv_id"], gaps, *totals, after[0], r["part"], r["number"], state, end, r is rows[-1]))
        state = end
    return pa.Table.from_batches([_batch(out, _arrow(_CHOSEN))])


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and repaired turns of each block between the states chosen for it."""
    schema = _arrow(_MENDED)
    for b in batches:
        rows = []
        for *key, roles, texts, faults, state, end, last in zip(*(col.to_pylist() for col in b.columns)):
            audit = through(signature(roles, list(faults)), state)[end][1] + (CLOSING[end][1] if last else "")
            left, _ = repaired(list(zip(roles, texts)), audit, state)
            rows.append((*key, audit, [r for r, _ in left], [t for _, t in left]))
        if rows:
            yield _batch(rows, schema)


_MENDED = "conv_id long, part int, number int, audit string, roles array<string>, texts array<string>"


def _join_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over mended blocks in order: audit and digest of each conversation, read as a stream."""
    schema = _arrow("conv_id long, audit string, repaired_sha256 string")
    conv, audit, sha, empty = None, [], None, True
    for b in batches:
        out = []
        for c, edits, roles, texts in zip(*(col.to_pylist() for col in b.columns)):
            if sha is not None and c != conv:
                out.append((conv, "".join(audit), sha.hexdigest()))
                sha = None
            if sha is None:
                conv, audit, sha, empty = c, [], hashlib.sha256(), True
            audit.append(edits)
            if roles:
                text = "\n".join(f"{r}:{t}" for r, t in zip(roles, texts))
                sha.update((text if empty else "\n" + text).encode())
                empty = False
        if out:
            yield _batch(out, schema)
    if sha is not None:
        yield _batch([(conv, "".join(audit), sha.hexdigest())], schema)


def _solution(conversations: DataFrame, block: int, chars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dealt conversations, the choices for those in blocks, and their mended blocks."""
    small_batches(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                                 *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    turns = turns.withColumn("n", F.monotonically_increasing_id())  # equal turns need not meet in one task
    order = ("conv_id", "turn", "role", "text", "n")
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("n")
    dealt = materialize(dealt.mapInArrow(_deal(block, chars), _DEALT), "conversations")
    blocks = dealt.where("part is not null").select("conv_id", "part", "number", "turns", "roles", "texts")
    solved = blocks.join(_seen_before(blocks), ["part", "number"], "left").select(*blocks.columns, "seen")
    solved = materialize(solved.mapInArrow(_solve, _SOLVED), "solved-blocks")
    chosen = materialize(solved.groupBy("conv_id").applyInArrow(_choose, _CHOSEN), "chosen-states")
    mended = (blocks.drop("turns").join(solved.select("part", "number", "faults"), ["part", "number"])
              .join(chosen.select("part", "number", "state", "end", "last"), ["part", "number"])
              .select("conv_id", "part", "number", "roles", "texts", "faults", "state", "end", "last")
              .mapInArrow(_mend, _MENDED))
    return dealt, chosen, mended


def repair(conversations: DataFrame, ids: DataFrame | None = None, block: int = BLOCK, chars: int = 8_000_000) -> DataFrame:
    """One row for each conversation (conv_id) of ``conversations`` (conv_id, turn, role, text)
    and of ``ids`` (conv_id): the columns of ``RESULT``.

    Null roles and texts are one space; turns go by turn (nulls first), then role and text.
    A turn's first fault counts: blank, duplicate (role and text of an earlier turn), truncated
    (last character that is not white space none of ``.!?``).  Keep costs 0, Rerole (to user or
    assistant) 1, Delete 2, Insert (an empty user or assistant turn) 5; blank and duplicate turns
    have to go, a truncated one that stays adds 5.  audit: initials of the cheapest edits that make
    the role initials ``(s?(ua)+)?``, of equal ones the least.  A role that is empty or begins with
    another letter fits nowhere unless it is changed.  gaps: turn numbers missing between the least
    and the greatest.  A null conv_id is a conversation like others; one of ``ids`` without turns
    has zeros, an empty audit and the digest of nothing; an empty table gives no rows.

    A conversation of more than ``block`` turns or ``chars`` characters is solved in blocks by
    several tasks; only its digest, which SHA-256 defines over the whole text in order, is
    taken by one task, as a stream.
    """
    dealt, chosen, mended = _solution(conversations, block, chars)
    names = [f.name for f in StructType.fromDDL(RESULT)]
    joined = (mended.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
              .select("conv_id", "audit", "roles", "texts")
              .mapInArrow(_join_digests, "conv_id long, audit string, repaired_sha256 string"))
    counts = chosen.where("last").withColumnRenamed("conv_id", "c")
    in_blocks = joined.join(counts, F.col("conv_id").eqNullSafe(F.col("c"))).select(*names)
    result = dealt.where("part is null").select(*names).unionByName(in_blocks)
    if ids is None:
        return result
    all_ids = ids.select(F.col("conv_id").cast("long").alias("c")).distinct()
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return (all_ids.join(result, F.col("c").eqNullSafe(F.col("conv_id")), "left")
            .select(F.col("c").alias("conv_id"), *(F.coalesce(n, empty.get(n, F.lit(0))).alias(n) for n in names[1:])))


def repaired_turns(conversations: DataFrame, block: int = BLOCK, chars: int = 8_000_000) -> DataFrame:
    """(conv_id, part, number, i, role, text): the turns that repair() leaves, in order of part,
    number and i within a conversation."""
    dealt, _, mended = _solution(conversations, block, chars)
    columns = ("conv_id", "part", "number", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "z"))
    rows = dealt.where("part is null").select(*columns).unionByName(mended.select(*columns))
    return rows.select("conv_id", "part", "number", "i", F.col("z.roles").alias("role"), F.col("z.texts").alias("text"))
