"""Conversation repair against a search over all edits."""

import hashlib
import itertools
import random
import zlib

from pyspark.sql import functions as F

from changetree.llm.repair import END_NODE, audit, damaged, node_before, repair

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
SPACE = " \t\n\v\f\r"


def by_hand(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of the rows (turn, role, text) in order."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        solid = text.strip(SPACE)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = {("", 0): (0, "", ())}  # (state, rows taken) -> (cost, audit, lines); costs grow, so rounds settle it
    for _ in range(3 * len(rows) + 6):
        now = dict(best)
        for (state, k), (cost, done, lines) in best.items():
            wanted = "a" if state == "u" else "u"
            role = {"u": "user", "a": "assistant"}[wanted]
            moves = [(NEXT[state][wanted], k, cost + 5, "I", (f"{role}:",))]
            if k < len(rows):
                _, own, text = rows[k]
                late = 5 * (faults[k] == "truncated")
                moves.append((state, k + 1, cost + 2, "D", ()))
                if faults[k] not in ("blank", "duplicate"):
                    moves.append((NEXT[state][wanted], k + 1, cost + 1 + late, "R", (f"{role}:{text}",)))
                    if own[:1] in NEXT[state]:
                        moves.append((NEXT[state][own[:1]], k + 1, cost + late, "K", (f"{own}:{text}",)))
            for to, at, c, letter, line in moves:
                found = (c, done + letter, lines + line)
                now[to, at] = min(now.get((to, at), found), found)
        best = now
    cost, letters, lines = min(best[s, len(rows)] for s in ("", "a") if (s, len(rows)) in best)
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(rows):
    out = {}
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        own = out.setdefault(conv, [])
        if fault == 1:
            text = ""
        if fault == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if fault == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    digest = lambda x: hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()
    return {c: by_hand(sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), digest(x)))) for c, own in out.items()}


def run(spark, rows, schema="conv_id long, turn long, role string, text string"):
    df, copies = damaged(spark.createDataFrame(rows, schema))
    return {r.conv_id: tuple(r)[1:] for r in repair(df, copies=copies).collect()}


def test_smallest_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, rows) == expected(rows)


def test_random_rows_with_nulls_ties_and_repeats(spark):
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "User", "", None, "usher"], ["Yes.", "No!", "What?  \n", "cut off", "", " \t", None, "é. ", "a.b"]
    rows = [(c, rng.choice([None, -3, 0, 1, 2, 3, 7, 7]), rng.choices(roles, [6, 6, 3, 1, 1, 1, 1, 1])[0], rng.choice(texts)) for c in [*range(150), None] for _ in range(rng.randint(1, 7))]
    rows += [(2**62 + 1, t, r, "Fine.") for t, r in ((1, "user"), (2, "assistant"))]
    want = expected(rows)
    got = run(spark, rows)
    assert got.keys() == want.keys()
    assert {c: v for c, v in got.items() if v != want[c]} == {}


def test_conversation_over_many_tasks(spark):
    """One long conversation, cut into pieces, equals the same rows in one task."""
    rows = [(1, t // 2, ("user", "assistant", "system")[t % 3], f"Line {t % 400}.") for t in range(3000)] + [(2, 1, "user", "Hello.")]
    many = run(spark, rows)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = run(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert many == one and len(many) == 2 and len(many[1][6]) >= 2000


def test_every_short_signature():
    """Costs and audits of all signatures of up to four signs."""
    rows_of = {"s": (None, "system", "Ok."), "u": (None, "user", "Ok."), "a": (None, "assistant", "Ok."), "o": (None, "tool", "Ok."), "U": (None, "user", "Ok"), "-": (None, "user", "")}
    for n in range(5):
        for signs in itertools.product(rows_of, repeat=n):
            signature, nodes = "".join(signs), [END_NODE]
            for sign in reversed(signature):
                nodes.append(node_before(sign, nodes[-1]))
            rows = [(t, r, x[:-1] + f"{k}" + x[-1:] if x else x) for k, (t, r, x) in enumerate(rows_of[s] for s in signs)]
            rows = [(t, r, x if s not in "U" else f"cut {k}") for k, (s, (t, r, x)) in enumerate(zip(signs, rows))]
            *_, cost, letters, _ = by_hand(rows)
            assert (nodes[-1][0][0], audit(signature, nodes)) == (cost, letters), signature


def test_empty_clashing_and_dropped(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert run(spark, []) == {} and repair(empty).columns[0] == "conv_id"
    rows = spark.createDataFrame([("x", 1, "user", "Hi.", "p"), ("x", 2, "assistant", "Ho.", "p")], "conv_id string, turn int, role string, text string, part string")
    (row,) = repair(rows.withColumn("conv", F.lit(1)).withColumn("fault", F.lit(2))).collect()
    assert (row.conv_id, row.cost, row.audit, row.gaps) == ("x", 0, "KK", 0)
    (row,) = repair(rows, copies=F.lit(0)).collect()
    assert tuple(row) == ("x", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
