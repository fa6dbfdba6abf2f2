"""Repair of conversations: the cheapest edits after which roles read ``(s?(ua)+)?``.

Four states say how far a conversation has come: nothing yet, after the system message, after a user
message, after an assistant message. A row moves the states by a 4 x 4 table of costs, and so does
any run of rows. Hirschberg's scheme finds the edits in linear space: forward costs to the middle and
backward costs from the end meet there, the crossing state is chosen, both halves are solved alike.
The same step works on rows inside a block and on blocks inside a conversation, so a conversation of
any length is spread over tasks: the tables of its blocks are multiplied up in groups of bounded size,
crossings are handed down, and every block is solved alone.

Of equally cheap edits the ASCII-least sequence is taken. Edits up to a row boundary end with the edit
of a row and contain one such edit per row, so none is the beginning of another, and the order of two
whole sequences is that of their parts before the crossing. Ranks beside the costs carry that order.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import rank_in_group, written

# Costs of the edits by initial, and what an undeleted truncated row adds.
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user or an assistant message may follow, and the state after it.
_AFTER_TURN = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: The code of the row that closes a conversation.
END = "EE"

#: Rows per block, and blocks per group on the way up.
BLOCK, FAN = 4096, 1024
#: Rows that are solved with kept pointers instead of being halved again.
_SHORT = 48
_FAR = 1 << 60

_BLANKS = " \t\n\x0b\x0c\r"


def _moves(code: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of one row: its role's initial, then b(lank), d(uplicate), t(runcated) or k."""
    best = {}

    def offer(start, end, cost, edits):
        if (start, end) not in best or (cost, edits) < best[start, end]:
            best[start, end] = (cost, edits)

    for start in range(4):
        state, before = start, ""
        for _ in range(4):
            paid = COSTS["I"] * len(before)
            if code == END:
                if state in (NOTHING, ASSISTANT):
                    offer(start, NOTHING, paid, before)
            else:
                role, fault = code
                offer(start, state, paid + COSTS["D"], before + "D")
                if fault in "tk":
                    paid += TRUNCATED * (fault == "t")
                    after = _AFTER_TURN[state]
                    offer(start, after, paid + COSTS["R"], before + "R")
                    if role == ("a" if state == USER else "u"):
                        offer(start, after, paid, before + "K")
                    if role == "s" and state == NOTHING:
                        offer(start, SYSTEM, paid, before + "K")
            state, before = _AFTER_TURN[state], before + "I"
    return [(s, e, cost, edits) for (s, e), (cost, edits) in sorted(best.items())]


def _ranked(moves: list[tuple[int, int, int, str]]) -> tuple[list[tuple[int, int, int, int]], dict]:
    """(from, to, cost, rank of the edits), and the edits themselves by (from, to)."""
    order = {edits: n for n, edits in enumerate(sorted({m[3] for m in moves}))}
    return [(s, e, c, order[t]) for s, e, c, t in moves], {(s, e): t for s, e, _, t in moves}


def tables() -> dict[str, tuple]:
    codes = [role + fault for role in "suax" for fault in "bdtk"] + [END]
    return {code: _ranked(_moves(code)) for code in codes}


def _forward(steps, low, high, start, keep=None):
    """Costs and ranks of the four states after ``steps[low:high]``; ``keep`` gathers where each came from."""
    cost, rank = [_FAR] * 4, [0] * 4
    cost[start] = 0
    for n in range(low, high):
        found = [None] * 4
        for s, e, c, r in steps[n]:
            if cost[s] < _FAR:
                new = (cost[s] + c, rank[s], r, s)
                if found[e] is None or new < found[e]:
                    found[e] = new
        if keep is not None:
            keep.append([f[3] if f else -1 for f in found])
        cost = [f[0] if f else _FAR for f in found]
        order = sorted({f[1:3] for f in found if f})
        rank = [order.index(f[1:3]) if f else 0 for f in found]
    return cost, rank


def _backward(steps, low, high, end):
    cost = [_FAR] * 4
    cost[end] = 0
    for n in range(high - 1, low - 1, -1):
        new = [_FAR] * 4
        for s, e, c, _ in steps[n]:
            if cost[e] + c < new[s]:
                new[s] = cost[e] + c
        cost = new
    return cost


def crossings(steps: list, start: int, end: int) -> list[int]:
    """The state at each of the ``len(steps) + 1`` boundaries of the best way from start to end."""
    states = [start] + [end] * len(steps)
    work = [(0, len(steps), start, end)]
    while work:
        low, high, a, b = work.pop()
        if high - low < 2:
            continue
        if high - low <= _SHORT:
            came: list = []
            _forward(steps, low, high, a, came)
            state = b
            for n in range(high - 1, low, -1):
                state = came[n - low][state]
                states[n] = state
            continue
        middle = (low + high) // 2
        cost, rank = _forward(steps, low, middle, a)
        rest = _backward(steps, middle, high, b)
        state = min(range(4), key=lambda s: (cost[s] + rest[s], rank[s]))
        states[middle] = state
        work += [(low, middle, a, state), (middle, high, state, b)]
    return states


def product(steps: list) -> list[tuple[int, int, int, int]]:
    """One step that stands for all of them."""
    result = []
    for start in range(4):
        cost, rank = _forward(steps, 0, len(steps), start)
        result += [(start, e, cost[e], rank[e]) for e in range(4) if cost[e] < _FAR]
    return result


# --- rows -----------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage of the contract, by crc32 of ``conv_id:turn``; NULLs in any field are one space."""
    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(copies).alias("copy"),
    ).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with ``digest``, the same for equal role and text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).withColumn(
        "digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def _places(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``(conv_id, turn, digest, is_end, initial, fault, pos)``: every row's place and first fault, and a closing row."""
    last = F.right(F.rtrim("text", F.lit(_BLANKS)), F.lit(1))
    narrow = rows.select(
        "conv_id", F.lit(0).alias("is_end"), "turn", "digest", F.substring("role", 1, 1).alias("initial"),
        F.when(last == "", "b").when(last.isin(".", "!", "?"), "k").otherwise("t").alias("fault"))
    ends = ids.select(
        "conv_id", F.lit(1).alias("is_end"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("digest"),
        F.lit("E").alias("initial"), F.lit("E").alias("fault"))
    ranked = rank_in_group(narrow.union(ends), ["conv_id"], ["is_end", "turn", "digest"], "pos")
    # A row is no duplicate if it is the first of its conversation with that role and text.
    first = ranked.filter("is_end = 0").groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select(
        "conv_id", "pos", F.lit(True).alias("is_first"))
    same = F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.pos") == F.col("f.pos"))
    joined = ranked.alias("r").join(first.alias("f"), same, "left")
    duplicate = (F.col("is_end") == 0) & (F.col("fault") != "b") & F.col("is_first").isNull()
    return written(joined.select(
        *[F.col(f"r.{c}") for c in ranked.columns if c != "fault"],
        F.when(duplicate, "d").otherwise(F.col("fault")).alias("fault")), "places")


def _blocks(places: DataFrame) -> DataFrame:
    """``(conv_id, block, codes)``, two letters a row; a block begins with the last row of the one before."""
    role = F.when(F.col("initial").isin("s", "u", "a", "E"), F.col("initial")).otherwise("x")
    block = F.floor(F.col("pos") / BLOCK)
    both = F.when(F.col("pos") % BLOCK == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))
    coded = places.select("conv_id", "pos", F.concat(role, "fault").alias("code"), F.explode(both).alias("block"))
    listed = coded.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    codes = listed.select("conv_id", "block", F.transform("rows", lambda r: r["code"]).alias("codes"))
    # The last block may hold nothing but the row before it, where a conversation ends on a border.
    return written(codes.filter((F.col("block") == 0) | (F.size("codes") > 1)), "blocks")


def _own(block: int, codes) -> list[str]:
    return list(codes[1:] if block else codes)


def _crossed(blocks: DataFrame) -> DataFrame:
    """``(conv_id, block, entry, exit)`` of the blocks of conversations with more than one."""
    several = blocks.filter("block = 1").select("conv_id").alias("m")
    long = blocks.alias("b").join(
        several, F.col("b.conv_id").eqNullSafe(F.col("m.conv_id")), "left_semi")

    def summed(batches):
        known = tables()
        for batch in batches:
            rows = [(c, n, [v for step in product([known[code][0] for code in _own(n, codes)]) for v in step])
                    for c, n, codes in zip(batch["conv_id"], batch["block"], batch["codes"])]
            yield _frame(rows, ["conv_id", "node", "step"])

    def multiplied(batches):
        for batch in batches:
            rows = [(c, n, [v for step in product([_unpacked(s["step"]) for s in steps]) for v in step])
                    for c, n, steps in zip(batch["conv_id"], batch["node"], batch["steps"])]
            yield _frame(rows, ["conv_id", "node", "step"])

    step_type = "conv_id string, node long, step array<long>"
    level = written(long.mapInPandas(summed, step_type), "steps")
    groups = []
    top = level.agg(F.max("node")).first()[0]
    while top is not None and (top > 0 or not groups):
        group = written(level.groupBy("conv_id", F.floor(F.col("node") / FAN).alias("node")).agg(
            F.array_sort(F.collect_list(F.struct("node", "step"))).alias("steps")), "groups")
        groups.append(group)
        level = group.mapInPandas(multiplied, step_type)
        top //= FAN

    def handed(batches):
        for batch in batches:
            rows = []
            for c, steps, a, b in zip(batch["conv_id"], batch["steps"], batch["entry"], batch["exit"]):
                states = crossings([_unpacked(s["step"]) for s in steps], int(a), int(b))
                rows += [(c, int(s["node"]), states[i], states[i + 1]) for i, s in enumerate(steps)]
            yield _frame(rows, ["conv_id", "block", "entry", "exit"])

    known = None
    for group in reversed(groups):
        if known is None:
            open_ends = group.withColumns({"entry": F.lit(NOTHING), "exit": F.lit(NOTHING)})
        else:
            same = F.col("g.conv_id").eqNullSafe(F.col("k.conv_id")) & (F.col("g.node") == F.col("k.block"))
            open_ends = group.alias("g").join(known.alias("k"), same).select("g.*", "k.entry", "k.exit")
        known = open_ends.mapInPandas(handed, "conv_id string, block long, entry int, exit int")
    if known is None:
        return blocks.sparkSession.createDataFrame([], "conv_id string, block long, entry int, exit int")
    return known


def _unpacked(flat) -> list[tuple[int, int, int, int]]:
    flat = [int(v) for v in flat]
    return [tuple(flat[i:i + 4]) for i in range(0, len(flat), 4)]


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    frame["conv_id"] = frame["conv_id"].astype(object)
    return frame


def _solved(blocks: DataFrame) -> DataFrame:
    """``(conv_id, block, audit, cost, illegal, edits)``; an edit is (pos, before, act): roles inserted
    before the row, then ``K``, the role it gets, or nothing for the closing row."""
    same = F.col("b.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("b.block") == F.col("c.block"))
    ends = blocks.alias("b").join(_crossed(blocks).alias("c"), same, "left").select(
        "b.conv_id", "b.block", "b.codes", F.coalesce("c.entry", F.lit(NOTHING)).alias("entry"),
        F.coalesce("c.exit", F.lit(NOTHING)).alias("exit"))
    names = {USER: "user", ASSISTANT: "assistant"}

    def solve(batches):
        known = tables()
        for batch in batches:
            rows = []
            for conv_id, block, codes, a, b in zip(*[batch[c] for c in ("conv_id", "block", "codes", "entry", "exit")]):
                block, all_codes, codes = int(block), list(codes), _own(int(block), codes)
                states = crossings([known[c][0] for c in codes], int(a), int(b))
                audit, edits, cost = [], [], 0
                for i, code in enumerate(codes):
                    done = known[code][1][states[i], states[i + 1]]
                    audit.append(done)
                    cost += sum(COSTS[x] for x in done)
                    cost += TRUNCATED * (code[1] == "t" and done[-1] in "KR")
                    state, before = states[i], []
                    for _ in range(done.count("I")):
                        state = _AFTER_TURN[state]
                        before.append(names[state])
                    act = "" if code == END else done[-1]
                    if act == "R":
                        act = names[states[i + 1]]
                    if act != "D" or before:
                        edits.append((block * BLOCK + i, ",".join(before), act))
                initials = [c[0] for c in all_codes if c != END]
                illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
                rows.append((conv_id, block, "".join(audit), cost, illegal, edits))
            yield _frame(rows, ["conv_id", "block", "audit", "cost", "illegal", "edits"])

    return written(ends.mapInPandas(solve, (
        "conv_id string, block long, audit string, cost long, illegal long, "
        "edits array<struct<pos:long,before:string,act:string>>"
    )), "solved")


def repaired_rows(rows: DataFrame, places: DataFrame, solved: DataFrame) -> DataFrame:
    """Texts and edits in the order of each conversation, on one partition per conversation.

    An edit (``kind`` 0) comes right before the texts it may belong to (``kind`` 1). The first of equal
    rows takes it; the others are duplicates and deleted.
    """
    edits = solved.select(F.col("conv_id"), F.inline("edits"))
    same = F.col("p.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("p.pos") == F.col("e.pos"))
    placed = places.alias("p").join(edits.alias("e"), same).select(
        "p.conv_id", "p.is_end", "p.turn", "p.digest", F.lit(0).alias("kind"), "e.before", "e.act",
        F.lit("").alias("text"))
    texts = rows.select(
        "conv_id", F.lit(0).alias("is_end"), "turn", "digest", F.lit(1).alias("kind"), F.lit("").alias("before"),
        F.col("role").alias("act"), "text")
    order = ["conv_id", "is_end", "turn", "digest", "kind"]
    return placed.union(texts).repartition("conv_id").sortWithinPartitions(*order)


def _hashed(lines: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)``: lines stream through the hash, whatever their number.

    A hash of a whole conversation has to read its lines one after another, in one task; that task
    holds one batch and sorts on disk.
    """

    def stream(batches):
        held, state, started, pending = None, None, False, None

        def put(role, text):
            nonlocal started
            state.update(f"{chr(10) if started else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            started = True

        for batch in batches:
            done = []
            for conv_id, turn, digest, kind, before, act, text in zip(
                    *[batch[c] for c in ("conv_id", "turn", "digest", "kind", "before", "act", "text")]):
                if state is None or conv_id != held:
                    if state is not None:
                        done.append((held, state.hexdigest()))
                    held, state, started, pending = conv_id, hashlib.sha256(), False, None
                if kind == 0:
                    for role in before.split(",") if before else []:
                        put(role, "")
                    pending = (str(turn), digest, act) if act not in ("", "D") else None
                elif pending and pending[:2] == (str(turn), digest):
                    put(act if pending[2] == "K" else pending[2], text)
                    pending = None
            if done:
                yield _frame(done, ["conv_id", "repaired_sha256"])
        if state is not None:
            yield _frame([(held, state.hexdigest())], ["conv_id", "repaired_sha256"])

    ready = lines.withColumn("turn", F.col("turn").cast("string"))
    return ready.mapInPandas(stream, "conv_id string, repaired_sha256 string")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired text, per conversation.

    ``rows`` holds ``(conv_id, turn, role, text)``; ``ids`` names the conversations to report where
    some may have lost all rows. Rows are ordered by turn, NULL first, then by a digest of role and
    text; equal rows are interchangeable. A NULL role or text is one space; a NULL ``conv_id`` is a
    conversation of its own; other columns are not read. Conversations without rows get zeros, an
    empty audit and the digest of nothing; an empty table gives no rows. A gap count beyond a long is
    given as the largest long.

    Rows travel as digests and two letters; whole texts are shuffled once, for the final digest.
    """
    id_type = rows.schema["conv_id"].dataType
    rows = _keyed(rows)
    ids = (rows if ids is None else ids).select(F.col("conv_id").cast("string").alias("conv_id")).distinct()
    places = _places(rows, ids)
    solved = _solved(_blocks(places))
    fault = F.col("fault")
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count_distinct("turn")
    counts = places.groupBy("conv_id").agg(
        F.when(F.max("turn").isNull(), 0).otherwise(
            F.least(span, F.lit(2**63 - 1).cast("decimal(38,0)"))).cast("long").alias("gaps"),
        *[F.count(F.when(fault == letter, 1)).alias(name) for letter, name in
          (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))])
    parts = F.array_sort(F.collect_list(F.struct("block", "audit")))
    edits = solved.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
    digests = _hashed(repaired_rows(rows, places, solved))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [counts, edits, digests])
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return merged.groupBy("conv_id").agg(*[F.max(n).alias(n) for n in names]).withColumn(
        "conv_id", F.col("conv_id").cast(id_type))
