"""Conversation repair against a plain recursion over edits and a recount of the faults."""
import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from pricelab.llm import conversations as C
from pricelab.llm.queries import op11_conversation_repair

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def best_audit(roles, faults):
    """Least (cost, audit) of the edits from the last turn backwards (insertions at most three in a row)."""
    n = len(roles)

    @lru_cache(None)
    def go(i, state, inserted):
        options = []
        if i == n and state in (0, 3):
            options.append((0, ""))
        if inserted < 3:
            for r in "ua":
                if (state, r) in NEXT:
                    cost, audit = go(i, NEXT[state, r], inserted + 1)
                    options.append((cost + 5, "I" + audit))
        if i < n:
            cost, audit = go(i + 1, state, 0)
            options.append((cost + 2, "D" + audit))
            if faults[i] not in "bd":
                for r, edit in ((roles[i][:1], "K"), ("u", "R"), ("a", "R")):
                    if (state, r) in NEXT:
                        cost, audit = go(i + 1, NEXT[state, r], 0)
                        options.append((cost + (edit == "R") + 5 * (faults[i] == "t"), edit + audit))
        return min(options, default=(10 ** 9, ""))

    return go(0, 0, 0)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if k:
            out += [(conv, turn, "user" if k == 4 else role,
                     "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (2 if k == 3 else 1)
    return out


def brute_force(rows, ids):
    by = {c: [] for c in ids}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        by.setdefault(conv, []).append((turn is not None, turn, role, text))
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2].encode(), t[3].encode()))
        roles, texts = [t[2] for t in turns], [t[3] for t in turns]
        faults, seen = "", set()
        for r in zip(roles, texts):
            ink = re.findall(r"[^\x20\x09-\x0D]", r[1])
            faults += "b" if not ink else "d" if r in seen else "." if ink[-1] in ".!?" else "t"
            seen.add(r)
        cost, audit = best_audit(tuple(roles), faults)
        known = {t[1] for t in turns if t[0]}
        illegal = sum((a[:1], b[:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(roles, roles[1:]))
        left, state, i = [], 0, 0
        for e in audit:
            if e == "I":
                role, text = ("assistant" if state == 2 else "user"), ""
            else:
                role, text = roles[i], texts[i]
                i += 1
                if e == "D":
                    continue
                if e == "R":
                    role = "assistant" if state == 2 else "user"
            state = NEXT[state, role[:1]]
            left.append(f"{role}:{text}")
        out.append((conv, max(known) - min(known) + 1 - len(known) if known else 0, faults.count("b"), faults.count("d"),
                    faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark):
    rows = duckdb.sql("select conv_id, turn, role, text from '/root/testdata/sf0.01/conversations.parquet'").fetchall()
    assert rows_of(op11_conversation_repair(spark, "/root/testdata/sf0.01")) == brute_force(damaged(rows), [r[0] for r in rows])


def test_every_short_signature():
    for n in range(1, 5):
        for roles in itertools.product("sua?", repeat=n):
            for faults in itertools.product(".tb", repeat=n):
                assert C.closed(C.signature(list(roles), list(faults))) == best_audit(roles, "".join(faults)), (roles, faults)


def test_long_signatures_over_stretches(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(C, "STRETCH", 7)
    for _ in range(30):
        n = rng.randint(8, 40)
        roles = [rng.choice("uauausa?") for _ in range(n)]
        faults = "".join(rng.choice("......tbd") for _ in range(n))
        assert C.closed(C.signature(roles, list(faults))) == best_audit(tuple(roles), faults)


ODD = [(None, 0, "user", "Hi."), (None, 1, "assistant", None), (None, None, None, "Yes."), (None, 2, "", "What?"),
       (1, 0, "system", "Be good."), (1, 1, "user", "a\x0b"), (1, 1, "user", "a\x0b"), (1, 4, "USER", "A."), (1, 5, "assistant", "B!"),
       (2, None, "user", ""), (3, 7, "user", "only"), (4, 0, "assistant", " "), (4, 0, "assistant", "x.\n"), (4, 2, "ux", "y?"),
       (5, 1, "user:u", "t."), (5, 1, "user", "u:t.")]


@pytest.mark.parametrize("block,parts", [(4096, 8), (3, 8), (1, 3)])
def test_odd_rows_and_long_conversations(spark, block, parts):
    rng = random.Random(block)
    rows = ODD + [(9, rng.randint(0, 60), rng.choice(["user", "assistant", "system"]), rng.choice(["One.", "two", "Three?", "", "Four!"]) + str(
        rng.randint(0, 3)) * rng.randint(0, 1)) for _ in range(150)] + [(10, 3, "user", "Same row.")] * 90
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = rows_of(C.repair(df, ids=spark.createDataFrame([(1,), (77,), (None,)], "conv_id long").union(df.select("conv_id")), block=block))
        turns = C.repaired_turns(df, block=block).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = brute_force(rows, [77])
    assert got == want
    for conv, *_, digest in want:
        left = sorted(((r.part or 0, r.number or 0, r.i), f"{r.role}:{r.text}") for r in turns if r.conv_id == conv)
        assert hashlib.sha256("\n".join(t for _, t in left).encode()).hexdigest() == digest


def test_damage_and_empty_table(spark):
    rows = [(c, t, r, x) for c in range(40) for t, r, x in ((0, "user", "Q?"), (None, "assistant", None), (1, None, "A. B."))]
    rows += [(None, 3, "user", "z!")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(str, (tuple(r) for r in C.damage(df).collect()))) == sorted(map(str, damaged(rows)))
    assert C.repair(C.damage(df.limit(0)), ids=df.limit(0)).collect() == []
