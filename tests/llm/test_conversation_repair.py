"""Conversation repair against a plain recursion over places and states."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
import xxhash
from velonet.llm import conversation_repair as repair

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user:", "a": "assistant:"}
NONE = (10**9, "")


def text_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        turns = out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        m = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if m == 1 else "".join(c for c in text if c not in ".!?") if m == 2 else text
        turns += [(turn, "user" if m == 4 else role, text)] * (0 if m == 0 else 2 if m == 3 else 1)
    return out


def cheapest(turns, fault):
    """(cost, audit) by the least of all ways from the end."""
    best = dict.fromkeys(NEXT, NONE) | {"": (0, ""), "a": (0, "")}
    for i in range(len(turns), -1, -1):
        if i < len(turns):
            rest, best, first = best, {}, turns[i][1][:1]
            for s in NEXT:
                ways = [(rest[s][0] + 2, "D" + rest[s][1])]
                if fault[i] not in ("blank", "duplicate"):
                    more = 5 * (fault[i] == "truncated")
                    to = "s" if first == "s" and s == "" else NEXT[s] if first == NEXT[s] else None
                    if to:
                        ways.append((rest[to][0] + more, "K" + rest[to][1]))
                    ways.append((rest[NEXT[s]][0] + more + 1, "R" + rest[NEXT[s]][1]))
                best[s] = min(ways)
        for _ in range(4):
            for s in NEXT:
                best[s] = min(best[s], (best[NEXT[s]][0] + 5, "I" + best[NEXT[s]][1]))
    return best[""]


def plain(rows):
    out = {}
    for conv, turns in damaged(rows).items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), text_hash(t[2])))
        seen, fault = set(), []
        for _, role, text in turns:
            end = text.rstrip(SPACE)[-1:]
            fault.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest(turns, fault)
        i, s, kept = 0, "", []
        for letter in audit:
            if letter in "IR":
                s = NEXT[s]
                kept.append(ROLES[s] + ("" if letter == "I" else turns[i][2]))
            elif letter == "K":
                s = "s" if turns[i][1][:1] == "s" else NEXT[s]
                kept.append(turns[i][1] + ":" + turns[i][2])
            i += letter != "I"
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out[conv] = (gaps, *map(fault.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def talks():
    rng = random.Random(1)
    out = []
    for conv in [*range(60), None, -3, 2**62 + 1]:
        for k in range(900 if conv == 7 else rng.choice([1, 2, 3, 6, 20])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool", "", "unknown"])
            out.append((conv, rng.choice([None, k, k, k, k + rng.randint(0, 3), 2**60 + k]), role, rng.choice(["hi.", "yes!", "so what", "", None, "  ", "no \n", f"t{k}.", f"x{k}?", f"é{k}. ", "\x85"])))
    return [*out, (5, 4, "user", "word " * 200_000 + "."), (5, 4, "user", "word " * 200_000 + "."), *[(61, k, "user", "again and again.") for k in range(700)]]


def report(df, most):
    rows = repair.report(repair.repair(repair.damaged(df), most), df).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("most", [10**6, 512, 3])
def test_report(spark, most):
    df = spark.createDataFrame([(*r, "k", 5) for r in talks()], "conv_id long, turn long, role string, text string, edit string, part int").repartition(4)
    assert report(df, most) == plain(talks())


def test_turns_are_whole(spark):
    rows = [(1, 0, "user", "hi."), (1, 1, "user", "you there?"), (1, 2, "assistant", "yes."), (2, 0, "assistant", "so.")]
    got = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv", "part", "k").collect()
    assert [(r.conv, r.edit, r.turn, r.was, r.role, r.text) for r in got] == [
        ("1", "D", 0, "user", "user", "hi."), ("1", "K", 1, "user", "user", "you there?"), ("1", "K", 2, "assistant", "assistant", "yes."), ("2", "D", 0, "assistant", "assistant", "so."),
    ]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert report(empty, 512) == {}
    gone = spark.createDataFrame([(9, 1, "user", "hi.")], "conv_id long, turn long, role string, text string")
    none = repair.report(repair.repair(gone.limit(0)), gone).first()
    assert tuple(none) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
