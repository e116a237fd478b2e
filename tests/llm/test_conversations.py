"""Repairs against an exhaustive search and a plain walk; odd rows; long conversations on many tasks."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from jobsieve.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, at string, audit int"
FORM = re.compile(r"(s?(ua)+)?")


def exhaustive(symbols):
    """Least (cost, audit) among all edits with up to n + 2 insertions."""
    best = None
    n = len(symbols)
    for edits in itertools.product("KRD", repeat=n):
        base, options = 0, []
        for (initial, gone, truncated), e in zip(symbols, edits):
            if e != "D" and gone:
                break
            base += {"K": 0, "R": 3, "D": 4}[e] + (3 if truncated and e != "D" else 0)
            options.append({"K": [initial], "R": ["u", "a"], "D": [""]}[e])
        else:
            for k in itertools.product(range(3), repeat=n + 1):
                if sum(k) > n + 2 or best and base + 3 * sum(k) > best[0]:
                    continue
                audit = "I" * k[0] + "".join(e + "I" * m for e, m in zip(edits, k[1:]))
                places = [["u", "a"]] * k[0]
                for o, m in zip(options, k[1:]):
                    places = [*places, o, *[["u", "a"]] * m]
                if any(FORM.fullmatch("".join(x)) for x in itertools.product(*places)):
                    best = min(best or (99, ""), (base + 3 * sum(k), audit))
    return best


def walked(symbols):
    """The least (cost, audit) by a walk over the rows, state by state."""
    inf = (1 << 40, "")

    def closed(s):
        for _ in range(3):
            s = [s[0], s[1], min(s[2], *[(s[p][0] + 3, s[p][1] + "I") for p in (0, 1, 3)]), min(s[3], (s[2][0] + 3, s[2][1] + "I"))]
        return s

    state = closed([(0, ""), inf, inf, inf])
    for initial, gone, truncated in symbols:
        new = [(c + 4, a + "D") for c, a in state]
        if not gone:
            for (p, role), q in C.STEPS.items():
                for edit, cost in (("K", 0), ("R", 3)):
                    if edit == "K" and role == initial or edit == "R" and role in "ua":
                        new[q] = min(new[q], (state[p][0] + cost + 3 * truncated, state[p][1] + edit))
        state = closed(new)
    return min(state[0], state[3])


def plain(rows):
    """All results by the definition. `rows`: (conv_id, turn, role, text)."""
    after, out = {}, []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = after.setdefault(conv, [])
        if what == 0:
            continue
        role = "user" if what == 4 else role
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        kept += [(turn, role, text)] * (2 if what == 3 else 1)
    for conv, kept in after.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, counts = set(), [], [0, 0, 0]
        for _, role, text in kept:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            symbols.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = walked(symbols)
        todo, fixed, last = iter(kept), [], ""
        for e in audit:
            row = None if e == "I" else next(todo)
            if e != "D":
                last = row[1][0] if e == "K" else "a" if last == "u" else "u"
                fixed.append((row[1] if e == "K" else {"u": "user", "a": "assistant"}[last]) + ":" + (row[2] if row else ""))
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in C.damaged_repairs(df).collect()), key=str)


def symbols(n, rng):
    return [(str(rng.choice(list("suat"), p=[0.15, 0.4, 0.4, 0.05])), bool(rng.random() < 0.15), bool(rng.random() < 0.2))
            for _ in range(n)]


def test_parse_finds_the_least_edits():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3, 3, 4):
        s = symbols(n, rng)
        assert C.result(C.parsed(s)) == exhaustive(s), s


@pytest.mark.parametrize("n", [5, 12, 30, 61])
def test_parse_of_longer_rows(n):
    rng = np.random.default_rng(n)
    s = symbols(n, rng)
    assert C.result(C.parsed(s)) == walked(s)
    stretch = C._Stretch({})
    for x in s:
        stretch.add(x)
    assert C.result(stretch.cell()) == walked(s)        # pieces joined


def conversation(conv, n, rng):
    text = ["Hello there.", "no end", "What?", "Again!  \n", "", " \t", "Same words.", "Fine, thanks"]
    return [(conv, t, str(rng.choice(["system", "user", "assistant", "tool"], p=[0.1, 0.45, 0.4, 0.05])),
             str(rng.choice(text)) + str(rng.integers(4)) * int(rng.random() < 0.5)) for t in range(n)]


def test_against_plain_walk(spark):
    rng = np.random.default_rng(7)
    rows = [r for c in range(120) for r in conversation(c, int(rng.integers(1, 10)), rng)]
    assert got(spark, rows, 5) == plain(rows)


def test_one_conversation_with_most_rows(spark):
    rng = np.random.default_rng(8)
    rows = conversation(1, 700, rng) + [r for c in range(2, 40) for r in conversation(c, 6, rng)]
    assert got(spark, rows, 7) == plain(rows)


def test_odd_rows(spark):
    long = "word " * 200_000
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (5, None, "assistant", "Late."),
            (5, None, "user", "Early."), (5, 2, None, "Nobody."), (5, 3, "user", None), (6, 1, "", "No role."),
            (6, 1, "user", long + "."), (6, 2, "assistant", long), (7, -3, "user", "é!"), (7, 4, "assistant", "ü"),
            (7, 4, "assistant", "ü\x00"), (8, 1, "ubuntu", "Kept as it is."), (8, 2, "assistant", "Yes.")]
    assert got(spark, rows) == plain(rows)


def test_conversations_without_rows(spark):
    gone = [t for t in range(400) if zlib.crc32(f"9:{t}".encode()) % 20 == 0][:3]
    (row,) = got(spark, [(9, t, "user", "Hi.") for t in gone])
    assert row == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(spark, []) == []


def test_repaired_rows():
    rows = [("user", "a"), ("user", "b"), ("system", "c")]
    assert C.repaired_rows(rows, "KIRR") == [("user", "a"), ("assistant", ""), ("user", "b"), ("assistant", "c")]
    assert C.repaired_rows([], "") == []
