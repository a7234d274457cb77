"""Operator 13, conversation structure repair: cheapest edits by a suffix-shared automaton over all conversations.

Each row of a conversation becomes one sign: what its role begins with and whether it must go or ends early. Signatures are
dealt by the order of their reversed signs, so that conversations with a common end are neighbours, and the automaton is
built from the end: a node stands for a suffix, and while a task walks its signatures in order, it keeps only the nodes on
the way from the end to the signature at hand. For each node and state of the role grammar the cost-to-go and the first edit
of the cheapest, ASCII-least audit are computed once, however many conversations share the node. A path through
the states gives the audit, and one stream over each conversation's rows applies it."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, free_name, persisted, small_batches, table

#: States of the grammar (s?(ua)+)?: at the start, after s, after u, after a.
STATES = range(4)
WANTED = "uuau"  # the role that rerole and insert give in a state
THEN = (2, 2, 3, 2)  # the state after it
ENDS = (True, False, False, True)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
MUST_GO = "-"  # the sign of a blank or repeated row; the others are s, u, a, o, in capitals if truncated
ROLES = {"u": "user", "a": "assistant"}

Node = tuple[tuple[int, str], ...]


def _with_inserts(own: list[tuple[int, str]]) -> Node:
    """Per state the cheapest of its own edit and an insertion; three rounds reach every state."""
    best = list(own)
    for _ in STATES:
        best = [min(best[q], (INSERT + best[THEN[q]][0], "I")) for q in STATES]
    return tuple(best)


END_NODE = _with_inserts([(0, "") if ENDS[q] else (1 << 60, "") for q in STATES])


def node_before(sign: str, after: Node) -> Node:
    """The node of a suffix with one more sign in front: per state (cost to go, first edit). Of equal costs the letter that is
    least in ASCII is right, because each letter leads to one state only."""
    own = []
    for q in STATES:
        edits = [(DELETE + after[q][0], "D")]
        if sign != MUST_GO:
            late, role = TRUNCATED * sign.isupper(), sign.lower()
            edits.append((REROLE + late + after[THEN[q]][0], "R"))
            if role == WANTED[q]:
                edits.append((KEEP + late + after[THEN[q]][0], "K"))
            elif role == "s" and q == 0:
                edits.append((KEEP + late + after[1][0], "K"))
        own.append(min(edits))
    return _with_inserts(own)


def audit(signature: str, nodes: list[Node]) -> str:
    """The edits from the start; nodes has the node of each suffix, the empty one first."""
    out, q, k = [], 0, 0
    while True:
        letter = nodes[len(signature) - k][q][1]
        if not letter:
            return "".join(out)
        out.append(letter)
        if letter == "K":
            q = 1 if signature[k].lower() == "s" else THEN[q]
        elif letter in "RI":
            q = THEN[q]
        k += letter != "I"


def _repairs(batches):
    """(signature, cost, audit) for signatures that come in the order of their reversed signs."""
    last, nodes = "", [END_NODE]
    for pdf in batches:
        out = []
        for turned in pdf["turned"]:
            same = 0
            for a, b in zip(last, turned):
                if a != b:
                    break
                same += 1
            del nodes[same + 1 :]
            for sign in turned[same:]:
                nodes.append(node_before(sign, nodes[-1]))
            last, signature = turned, turned[::-1]
            out.append((signature, nodes[-1][0][0], audit(signature, nodes)))
        yield pd.DataFrame(out, columns=["signature", "cost", "audit"])


def repairs(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) for each distinct value of the column signature."""
    turned = signatures.select(F.reverse("signature").alias("turned")).distinct()
    return turned.repartitionByRange("turned").sortWithinPartitions("turned").mapInPandas(_repairs, "signature string, cost long, audit string")


def _pieces(batches):
    """What each part of a conversation's ordered rows holds, a row for each part that lies in this task."""
    piece: dict | None = None
    done: list[tuple] = []
    layout = ["conv", "part", "signature", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role", "turns", "first_turn", "last_turn"]

    def close() -> None:
        if piece:
            done.append((piece["conv"], piece["part"], "".join(piece["signs"]), *(piece[c] for c in layout[3:])))

    for pdf in batches:
        for r in pdf.itertuples(index=False):
            conv = r.conv
            if piece is None or piece["conv"] != conv:
                close()
                piece = {"conv": conv, "part": r.part, "signs": [], "first_role": None, "last_role": None, "first_turn": None, "last_turn": None} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
            if not r.copies:  # stands for rows that were dropped
                continue
            turn = None if r.turn is None else int(r.turn)
            if turn is not None and turn != piece["last_turn"]:
                piece["turns"] += 1
                piece["first_turn"] = turn if piece["first_turn"] is None else piece["first_turn"]
                piece["last_turn"] = turn
            if piece["last_role"] is not None:
                piece["illegal"] += piece["last_role"] + r.initial not in ("su", "ua", "au")
            else:
                piece["first_role"] = r.initial
            piece["last_role"] = r.initial
            piece["illegal"] += r.copies - 1
            again = 0 if r.first else 1
            repeats = r.copies - 1 + again
            if r.blank:
                piece["blank"] += r.copies
                piece["signs"].append(MUST_GO * r.copies)
                continue
            piece["duplicate"] += repeats
            sign = r.initial if r.initial in ("s", "u", "a") else "o"
            if not again:
                piece["truncated"] += bool(r.cut)
                piece["signs"].append(sign.upper() if r.cut else sign)
            piece["signs"].append(MUST_GO * repeats)
        if len(done) > 4096:
            yield pd.DataFrame(done, columns=layout)
            done = []
    close()
    yield pd.DataFrame(done, columns=layout)


def _hashes(batches):
    """Per conversation the hash of its repaired rows; first comes its audit, then its rows in order."""
    state: dict | None = None

    def line(text: str) -> None:
        state["hash"].update((("\n" if state["lines"] else "") + text).encode("utf-8", "surrogatepass"))
        state["lines"] += 1

    def step(row) -> bool:
        """Take the next letter of the audit, for an insertion if row is None; False if it is of the other kind."""
        letter = state["audit"][state["at"] : state["at"] + 1]
        if (letter == "I") != (row is None) or not letter:
            return False
        state["at"] += 1
        role, q = row.role if row is not None else "", state["q"]
        if letter == "K":
            line(f"{role}:{row.text}")
            state["q"] = 1 if role[:1] == "s" else THEN[q]
        elif letter in "RI":
            line(f"{ROLES[WANTED[q]]}:{row.text if row is not None else ''}")
            state["q"] = THEN[q]
        return True

    def close() -> list:
        if not state:
            return []
        while step(None):
            pass
        return [(*state["sums"], state["audit"], state["hash"].hexdigest())]

    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    for pdf in batches:
        done = []
        for r in pdf.itertuples(index=False):
            if r.is_row:
                for _ in range(r.copies):
                    while step(None):
                        pass
                    step(r)
            else:
                done += close()
                state = {"sums": tuple(getattr(r, c) for c in names), "audit": r.text, "at": 0, "q": 0, "lines": 0, "hash": hashlib.sha256()}
        yield pd.DataFrame(done, columns=[*names, "audit", "repaired_sha256"])
    yield pd.DataFrame(close(), columns=[*names, "audit", "repaired_sha256"])


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    copies is how often each row stands, 1 if not given; a conversation all of whose rows stand 0 times has zeros, an empty audit and the
    hash of an empty string. Rows are taken by turn, nulls first; rows of one turn by role, then by the SHA-256 of role and
    text, so that equal rows are neighbours. A null role or text is one space. A null id is a conversation of its own. A
    role that begins with none of s, u and a fits nowhere as it is. An empty table gives no rows; other columns aren't read.

    Only a conversation's signature and its audit, one letter for each of its rows, are held whole, because the audit is one value of
    the result; its rows are counted and dealt in pieces. Its hash needs its rows one after the other in one stream."""
    small_batches(conversations.sparkSession)
    of = lambda c: F.col(f"`{c}`")
    space = lambda c: F.coalesce(of(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        of(conv_col).cast("string").alias("conv"), of(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"),
        (F.lit(1) if copies is None else copies).cast("int").alias("copies"),
    )
    stands = F.col("copies") > 0
    solid = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    meta = rows.select(
        "conv", *(F.when(stands, c).alias(n) for n, c in (("turn", F.col("turn")), ("role", F.col("role")), ("digest", digest), ("blank", solid == ""), ("cut", ~F.substring(solid, -1, 1).isin(".", "!", "?")))), "copies"
    )
    meta = persisted(meta.groupBy("conv", "turn", "role", "digest", "blank", "cut").agg(F.sum("copies").cast("int").alias("copies")))
    # Of rows with equal role and text the one of the smallest turn is the first; a null turn is smaller than all.
    order = F.coalesce(F.col("turn"), F.lit(-(1 << 63)))
    many = meta.where(stands).groupBy("conv", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), order)).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    many = many.select(F.col("conv").alias("conv_"), F.col("digest").alias("digest_"), "least")
    firsts = meta.join(many, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("digest") == F.col("digest_")), "left")
    firsts = firsts.withColumn("first", F.coalesce(F.col("least") == F.struct(F.col("turn").isNotNull(), order), F.lit(True)))
    placed = firsts.select("conv", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "blank", "cut", "copies", "first")
    placed = placed.repartitionByRange("conv", "turn", "role", "digest").sortWithinPartitions("conv", "turn", "role", "digest")
    placed = placed.withColumn("part", F.spark_partition_id()).withColumn("turn", F.col("turn").cast("string")).drop("role", "digest")
    layout = "conv string, part int, signature string, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, turns long, first_turn long, last_turn long"
    pieces = placed.mapInPandas(_pieces, layout)
    held = F.sort_array(F.collect_list(F.struct("part", "signature", "first_role", "last_role", "turns", "first_turn", "last_turn")))
    whole = pieces.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")), F.min("first_turn").alias("least"), F.max("last_turn").alias("most"), held.alias("held"))
    # Where a conversation goes on in the next task, its two rows around the cut are judged here.
    with_roles, with_turns = F.filter("held", lambda x: x["last_role"].isNotNull()), F.filter("held", lambda x: x["last_turn"].isNotNull())
    cuts = lambda parts, judge: F.aggregate(F.zip_with(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), parts, lambda b, a: F.when(b.isNotNull() & judge(a, b), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    whole = whole.select(
        "conv", "blank", "duplicate", "truncated",
        (F.col("illegal") + cuts(with_roles, lambda a, b: ~F.concat(a["last_role"], b["first_role"]).isin("su", "ua", "au"))).alias("illegal"),
        F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns") + cuts(with_turns, lambda a, b: a["last_turn"] == b["first_turn"]), F.lit(0)).alias("gaps"),
        F.array_join(F.transform("held", lambda x: x["signature"]), "").alias("signature"),
    )
    whole = persisted(whole)
    dropped(meta)
    judged = whole.join(repairs(whole), "signature").drop("signature")
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    audits = judged.select("conv", F.lit(False).alias("is_row"), none("turn", "long"), none("role", "string"), none("digest", "string"), F.col("audit").alias("text"), F.lit(0).alias("copies"), *sums)
    texts = rows.where(stands).select("conv", F.lit(True).alias("is_row"), "turn", "role", digest.alias("digest"), "text", "copies", *(none(c, "long") for c in sums))
    stream = audits.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "is_row", "turn", "role", "digest")
    stream = stream.select(*("conv is_row role text copies".split()), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums))
    out = stream.mapInPandas(_hashes, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return out.select(F.col("conv").cast(conversations.schema[conv_col].dataType).alias(conv_col), *out.columns[1:])


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """conversations (conv_id, turn, role, text) with the faults that crc32 of `conv_id:turn` modulo 20 puts in, and how often each row
    stands; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    name = free_name(conversations, "fault")
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    out = conversations.withColumn(name, fault)
    fault = F.col(name)
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    out = out.withColumn("text", text).withColumn("role", F.when(fault == 4, "user").otherwise(space("role")))
    return out, F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return repair(rows, copies=copies).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
