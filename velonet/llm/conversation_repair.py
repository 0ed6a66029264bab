"""Operator 13, conversation repair: least-cost edits to a grammar of turns, found in layers of increasing cost.

The grammar has four states: nothing yet, after the system turn, after a user turn, after an assistant turn. For each cost,
a layer holds for every turn the bitset of the states from which the rest can be repaired at just that cost; keeping a turn
stays in its layer, other edits look into the layers below. The first layer whose first bitset holds the beginning gives the
cost, and going forward through the bits, the least letter first, gives the least audit.

A conversation of more than ``most`` turns is dealt out by ranges of its order and cut into blocks. A block's layers are run
to each of its last states; a block becomes a small matrix of costs, the matrices meet one after another, and then each
block knows what follows it and traces its own edits. Copies of a turn are found by a grouped minimum of places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: What a turn that stays truncated costs.
TRUNCATED = 5
#: States as bits. A conversation may end where it has nothing or an answer.
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
STATES, ACCEPT = (START, SYSTEM, USER, ASSISTANT), START | ASSISTANT
#: Where the next turn of the grammar leads, and its role; only the beginning may also keep a system turn.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Initials of roles as numbers; others are 0.
INITIALS = {"s": 1, "u": 2, "a": 3}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\f\r"
#: Turns of a block of a long conversation: a power of two.
BLOCK_BITS = 8


def after(state: int, initial: int) -> int:
    """The state that keeping a turn leads to; 0 if the grammar has none."""
    if initial == INITIALS["s"]:
        return SYSTEM if state == START else 0
    to = NEXT[state]
    return to if initial == (INITIALS["u"] if to == USER else INITIALS["a"]) else 0


def before(step) -> list[int]:
    """For each bitset of states, the bitset of the states that a step leads into it."""
    return [sum(s for s in STATES if step(s) & to) for to in range(16)]


KEPT = [before(lambda s, i=i: after(s, i)) for i in range(4)]
TURNED = before(NEXT.__getitem__)


def layers(turns: list[tuple[int, bool, bool]], ends: dict[int, int], until: int, open_end: bool) -> list[bytearray]:
    """Layers by cost: at each place, the states from which the turns (initial, must go, truncated) that follow can be left
    in a state of ``ends`` at just that cost, what ``ends`` says included. They go on until the first bitsets have held all
    states of ``until``. Turns may be put in at the end only where it is ``open_end``.
    """
    n, out, seen = len(turns), [], 0
    none = bytearray(n + 1)
    back = lambda c: out[c] if c >= 0 else none
    while seen & until != until:
        c = len(out)
        now = bytearray(n + 1)
        one, two, five, six = (back(c - k) for k in (COST[REROLE], COST[DELETE], COST[INSERT], TRUNCATED + COST[REROLE]))
        now[n] = sum(s for s, cost in ends.items() if cost == c) | (TURNED[five[n]] if open_end else 0)
        for i in range(n - 1, -1, -1):
            initial, gone, cut = turns[i]
            bits = two[i + 1] | TURNED[five[i]]
            if not gone:
                bits |= KEPT[initial][five[i + 1]] | TURNED[six[i + 1]] if cut else KEPT[initial][now[i + 1]] | TURNED[one[i + 1]]
            now[i] = bits
        out.append(now)
        seen |= now[0]
    return out


def trace(turns: list[tuple[int, bool, bool]], found: list[bytearray], state: int, ends: dict[int, int], open_end: bool) -> tuple[str, int]:
    """(letters of the least audit among the cheapest, last state) from ``state`` through the layers."""
    n, i, out = len(turns), 0, []
    c = next(c for c, layer in enumerate(found) if layer[0] & state)
    has = lambda cost, place, bits: cost >= 0 and found[cost][place] & bits
    while i < n or (open_end and c != ends.get(state)):
        if i < n:
            initial, gone, cut = turns[i]
            more = TRUNCATED if cut else 0
        if i < n and has(c - COST[DELETE], i + 1, state):
            out.append(DELETE)
            c, i = c - COST[DELETE], i + 1
        elif has(c - COST[INSERT], i, NEXT[state]):
            out.append(INSERT)
            c, state = c - COST[INSERT], NEXT[state]
        elif (to := after(state, initial)) and not gone and has(c - more, i + 1, to):
            out.append(KEEP)
            c, i, state = c - more, i + 1, to
        else:
            out.append(REROLE)
            c, i, state = c - more - COST[REROLE], i + 1, NEXT[state]
    return "".join(out), state


def cheapest(turns: list[tuple[int, bool, bool]]) -> str:
    """The audit of a whole conversation."""
    ends = {START: 0, ASSISTANT: 0}
    return trace(turns, layers(turns, ends, START, True), START, ends, True)[0]


def roles_of(audit: str, turns: list[tuple[int, bool, bool]], state: int = START) -> Iterator[tuple[str, int | None, str | None]]:
    """(letter, place of the turn or None, new role or None) for each letter of an audit."""
    i = 0
    for letter in audit:
        if letter in (REROLE, INSERT):
            state = NEXT[state]
        elif letter == KEEP:
            state = after(state, turns[i][0])
        yield letter, None if letter == INSERT else i, ROLE[state] if letter in (REROLE, INSERT) else None
        i += letter != INSERT


def prepared(conversations: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, digest, initial, blank, cut); nulls of conversation, role and text count as one space."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    filled = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    number = F.lit(0)
    for letter, k in INITIALS.items():
        number = F.when(F.substring("role", 1, 1) == letter, k).otherwise(number)
    return filled.select("*", F.xxhash64("text").alias("digest"), number.alias("initial"), (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("cut"))


#: The order of a conversation's turns: equal turns by role, then by hash of the text; equal rows are alike.
ORDER = ("conv", "turn", "role", "digest")  # nulls come first
REPAIRED = "conv string, part long, k long, edit string, turn long, was string, role string, text string, fault string"


def faults(rows: Iterable[tuple[str, str, bool, bool]]) -> list[str | None]:
    """The first fault of each (role, text, blank, cut), in order."""
    seen, out = set(), []
    for role, text, blank, cut in rows:
        again = (role, text) in seen
        seen.add((role, text))
        out.append("blank" if blank else "duplicate" if again else "truncated" if cut else None)
    return out


def _short(rows: DataFrame) -> DataFrame:
    """Repaired turns of conversations that fit a task, one after another."""
    names = ["turn", "role", "text", "initial", "blank", "cut"]

    def mend(conv: str, rows: list[tuple]) -> Iterator[tuple]:
        found = faults((r[1], r[2], r[4], r[5]) for r in rows)
        turns = [(int(r[3]), f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, found, strict=True)]
        for k, (letter, i, role) in enumerate(roles_of(cheapest(turns), turns)):
            turn, was, text = (None, None, "") if i is None else rows[i][:3]
            yield conv, 0, k, letter, turn, was, role or was, text, None if i is None else found[i]

    def mended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, held = None, []
        columns = [x.split()[0] for x in REPAIRED.split(", ")]
        for batch in batches:
            out = []
            for key, *row in zip(batch["conv"], *[batch[c] for c in names], strict=True):
                if key != conv:
                    out += mend(conv, held)
                    conv, held = key, []
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held and (out := list(mend(conv, held))):
            yield pd.DataFrame(out, columns=columns)

    dealt = rows.repartition("conv").sortWithinPartitions(*ORDER)
    return dealt.select("conv", F.col("turn").cast("string").alias("turn"), *names[1:]).mapInPandas(mended, REPAIRED.replace("turn long", "turn string")).withColumn("turn", F.col("turn").cast("long"))


def _turns(codes: Iterable[int]) -> list[tuple[int, bool, bool]]:
    return [(c & 3, bool(c & 4), bool(c & 8)) for c in codes]


def _long(rows: DataFrame) -> DataFrame:
    """Repaired turns of conversations of any length, block by block."""
    placed = common.materialize(rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("place", F.monotonically_increasing_id()))
    text_key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = placed.groupBy("conv", text_key.alias("key")).agg(F.min("place").alias("place")).select("place", F.lit(False).alias("again"))
    marked = placed.select("conv", "place", "initial", "blank", "cut").join(firsts, "place", "left").withColumn("again", F.coalesce("again", F.lit(True)))
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
    marked = common.materialize(marked.select("conv", "place", F.shiftright("place", BLOCK_BITS).alias("part"), "initial", fault.alias("fault")))
    code = F.col("initial") + F.when(F.col("fault").isin("blank", "duplicate"), 4).when(F.col("fault") == "truncated", 8).otherwise(0)
    blocks = marked.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("place", code.alias("code")))).alias("turns"))
    blocks = common.materialize(blocks.select("conv", "part", F.col("turns.place").alias("places"), F.col("turns.code").alias("codes")))
    inf = float("inf")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Costs from state to state (-1: no way), and from each state to the end of the conversation."""
        for batch in batches:
            out = []
            for conv, part, codes in zip(batch["conv"], batch["part"], batch["codes"], strict=True):
                turns, costs = _turns(codes), []
                some = any(t[0] == INITIALS["s"] and not t[1] for t in turns)
                for to in STATES:
                    # nothing leads back to the beginning, and only a system turn of the beginning leads behind one
                    froms = {START: START, SYSTEM: START | SYSTEM if some else SYSTEM}.get(to, 15)
                    found = layers(turns, {to: 0}, froms, False)
                    costs += [next((c for c, layer in enumerate(found) if layer[0] & s), -1) for s in STATES]
                closing = layers(turns, {START: 0, ASSISTANT: 0}, 15, True)
                out.append((conv, part, costs, [next(c for c, layer in enumerate(closing) if layer[0] & s) for s in STATES]))
            if out:
                yield pd.DataFrame(out, columns=["conv", "part", "costs", "closing"])

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        """What remains after each block, from each state; -1 in the last one."""
        group = group.sort_values("part")
        rest, out = None, []
        for part, costs, closing in reversed(list(zip(group["part"], group["costs"], group["closing"], strict=True))):
            out.append((part, rest or [-1] * 4))
            if rest is None:
                rest = [int(x) for x in closing]
            else:
                rest = [int(min(inf if costs[4 * t + s] < 0 else costs[4 * t + s] + rest[t] for t in range(4))) for s in range(4)]
        return pd.DataFrame([(group["conv"].iloc[0], *x) for x in out], columns=["conv", "part", "rest"])

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Audit and last state of each block for each state before it."""
        for batch in batches:
            out = []
            for conv, part, codes, rest in zip(batch["conv"], batch["part"], batch["codes"], batch["rest"], strict=True):
                turns, last = _turns(codes), rest[0] < 0
                low = 0 if last else min(rest)
                ends = {START: 0, ASSISTANT: 0} if last else {s: int(r - low) for s, r in zip(STATES, rest, strict=True)}
                found = layers(turns, ends, 15, last)
                both = [trace(turns, found, s, ends, last) for s in STATES]
                out.append((conv, part, [a for a, _ in both], [STATES.index(s) for _, s in both]))
            if out:
                yield pd.DataFrame(out, columns=["conv", "part", "audits", "exits"])

    def enter(group: pd.DataFrame) -> pd.DataFrame:
        """The state before each block."""
        group, s, out = group.sort_values("part"), 0, []
        for part, exits in zip(group["part"], group["exits"], strict=True):
            out.append((part, s))
            s = int(exits[s])
        return pd.DataFrame([(group["conv"].iloc[0], *x) for x in out], columns=["conv", "part", "entry"])

    def edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, part, places, codes, audit, entry in zip(*[batch[c] for c in ("conv", "part", "places", "codes", "audit", "entry")], strict=True):
                for k, (letter, i, role) in enumerate(roles_of(audit, _turns(codes), STATES[entry])):
                    # inserted turns get places of their own, so that the join has no hot key
                    out.append((conv, part, k, letter, -1 - k if i is None else int(places[i]), role))
            if out:
                yield pd.DataFrame(out, columns=["conv", "part", "k", "edit", "place", "new"])

    rest = blocks.mapInPandas(matrices, "conv string, part long, costs array<long>, closing array<long>").groupBy("conv").applyInPandas(follow, "conv string, part long, rest array<long>")
    ways = common.materialize(blocks.join(rest, ["conv", "part"]).mapInPandas(traced, "conv string, part long, audits array<string>, exits array<int>"))
    entry = ways.select("conv", "part", "exits").groupBy("conv").applyInPandas(enter, "conv string, part long, entry int")
    chosen = blocks.join(ways.join(entry, ["conv", "part"]).select("conv", "part", "entry", F.col("audits")[F.col("entry")].alias("audit")), ["conv", "part"])
    done = chosen.mapInPandas(edits, "conv string, part long, k long, edit string, place long, new string")
    original = placed.select("place", "turn", F.col("role").alias("was"), "text").join(marked.select("place", "fault"), "place")
    return done.join(original, "place", "left").select("conv", "part", "k", "edit", "turn", "was", F.coalesce("new", "was").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "fault")


def repair(conversations: DataFrame, most: int = 512) -> DataFrame:
    """Rows (conv, part, k, edit, turn, was, role, text, fault) of ``conversations`` (conv_id, turn, role, text): every turn
    and every inserted one, in the order of part and k, with its edit; those whose edit is D are gone from the repair.

    Keep costs 0, Rerole to user or assistant 1, Delete 2 (required for blank and duplicate turns), Insert of an empty turn
    5; a truncated turn that stays adds 5. The edits are the cheapest that give initials ``(s?(ua)+)?``; of several, those
    whose letters are least. Nulls of conversation, role and text count as one space (``conv`` is a string); null turns come
    first; equal turns go by role and hash of the text. Repeated rows are duplicates; empty texts are blank; an empty table
    gives no rows; texts are handled whole and may be long; other columns are ignored. Conversations of more than ``most``
    turns are mended in blocks, with the same result.
    """
    rows = prepared(conversations)
    large = common.materialize(rows.groupBy("conv").count().filter(F.col("count") > most).select("conv"))
    if large.isEmpty():
        return _short(rows)
    return _short(rows.join(large, "conv", "left_anti")).unionByName(_long(rows.join(large, "conv", "left_semi")))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each conversation of the sorted turns, in the memory of an audit."""

    class Reading:
        def __init__(self, conv: str) -> None:
            self.conv, self.hash, self.audit, self.kept = conv, hashlib.sha256(), [], False
            self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            self.first = self.last = self.was = None
            self.turns = 0

        def add(self, edit, turn, was, role, text, fault) -> None:
            self.audit.append(edit)
            self.n["cost"] += COST[edit] + (TRUNCATED if fault == "truncated" and edit != DELETE else 0)
            if edit != INSERT:
                if fault:
                    self.n[fault] += 1
                if self.was is not None and self.was[:1] + was[:1] not in LEGAL:
                    self.n["illegal"] += 1
                self.was = was
                if turn is not None and (turn := int(turn)) != self.last:
                    self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
            if edit != DELETE:
                self.hash.update((("\n" if self.kept else "") + role + ":" + text).encode())
                self.kept = True

        def row(self) -> tuple:
            gaps = self.last - self.first + 1 - self.turns if self.turns else 0
            return self.conv, gaps, *self.n.values(), "".join(self.audit), self.hash.hexdigest()

    columns = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    reading = None
    for batch in batches:
        out = []
        for conv, *row in zip(*[batch[c] for c in ("conv", "edit", "turn", "was", "role", "text", "fault")], strict=True):
            if reading is None or conv != reading.conv:
                if reading is not None:
                    out.append(reading.row())
                reading = Reading(conv)
            reading.add(*row)
        if out:
            yield pd.DataFrame(out, columns=columns)
    if reading is not None:
        yield pd.DataFrame([reading.row()], columns=columns)


def report(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one for each conversation
    of ``conversations``, from its turns in ``repaired``; one without turns has zeros and the hash of nothing.

    A hash over all turns of a conversation needs them one after another: they stream through a task, which holds the
    audit, never the texts.
    """
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    turns = repaired.select("conv", "part", "k", "edit", F.col("turn").cast("string").alias("turn"), "was", "role", "text", "fault")
    sums = turns.repartition("conv").sortWithinPartitions("conv", "part", "k").mapInPandas(_digests, f"conv string, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    return every.join(sums, "conv", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults by the crc32 of conversation and turn modulo 20: 0 drops a row, 1 empties its text, 2
    removes its closing marks, 3 repeats it, 4 makes it the user's. Nulls count as one space, but turns stay null."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    m = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), m.alias("m")).filter("m <> 0")
    text = F.when(F.col("m") == 1, "").when(F.col("m") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("m") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("m") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
