import hashlib
import itertools
import re
import zlib

import pytest

from labelmill.llm import repair

LETTERS = "".join(sorted("DIKR"))
VALID = re.compile(r"(s?(ua)+)?")
#: What may follow what in a valid conversation.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def choices(initial, gone, cut):
    return [("D", 2, "")] if gone else [("D", 2, ""), ("R", 1 + 5 * cut, "u"), ("R", 1 + 5 * cut, "a"), ("K", 5 * cut, initial or "none")]


def exhaustive(symbols):
    """Cheapest valid edits of (initial, must go, cut off) rows, by trying all, at most two inserts between rows."""
    best = None
    gaps = [["", "u", "a", "ua", "au"]] * (len(symbols) + 1)
    for choice in itertools.product(*(choices(*s) for s in symbols)):
        for between in itertools.product(*gaps):
            roles = "".join(a + c[2] for a, c in zip(between, [*choice, ("", 0, "")]))
            if VALID.fullmatch(roles):
                audit = "".join("I" * len(a) + c[0] for a, c in zip(between, [*choice, ("", 0, "")]))
                found = sum(c[1] for c in choice) + 5 * sum(map(len, between)), audit
                best = min(best or found, found)
    return best


def brute(symbols):
    """The same from the first row on: of all starts with the same last initial, the least."""
    def grown(starts, options):
        out = {}
        for end, (cost, audit) in starts.items():
            for edit, more, initial in options:
                if initial in NEXT[end]:
                    to = initial or end
                    out[to] = min(out.get(to, (10**9, "")), (cost + more, audit + edit))
        return out

    starts = {"": (0, "")}
    for k in range(len(symbols) + 1):
        for _ in range(2):
            for end, found in grown(starts, [("I", 5, "u"), ("I", 5, "a")]).items():
                starts[end] = min(starts.get(end, found), found)
        if k < len(symbols):
            starts = grown(starts, choices(*symbols[k]))
    return min(v for end, v in starts.items() if end in ("", "a"))


SYMBOLS = {"x": ("u", True, False), "s": ("s", False, False), "u": ("u", False, False), "a": ("a", False, False), "o": ("t", False, False),
           "S": ("s", False, True), "U": ("u", False, True), "A": ("a", False, True), "O": ("t", False, True)}


def test_cheapest_edits_of_all_short_signatures():
    nodes = repair.Automaton()
    for n in range(4):
        for signature in sorted(map("".join, itertools.product(SYMBOLS, repeat=n)), key=lambda s: s[::-1]):
            nodes.open(signature)
            assert nodes.best() == brute([SYMBOLS[c] for c in signature]), signature
            if n < 3:
                assert nodes.best() == exhaustive([SYMBOLS[c] for c in signature])


def test_longer_signatures_and_shared_nodes():
    import random

    rng = random.Random(3)
    some = sorted({"".join(rng.choice("xsuaoSUA") for _ in range(rng.randrange(12))) for _ in range(200)}, key=lambda s: s[::-1])
    nodes = repair.Automaton()
    for signature in some:
        nodes.open(signature)
        assert nodes.best() == brute([SYMBOLS[c] for c in signature])
    nodes.open("ua" * 50_000)
    assert nodes.best() == (0, "K" * 100_000)
    kept = nodes.paths[60_000]
    nodes.open("uu" + "ua" * 40_000)
    assert nodes.paths[60_000] is kept and nodes.best() == (1, "KR" + "K" * 80_000)
    assert len(nodes.known) < 200


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(rows):
    for conv, kept in damaged(rows).items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, symbols, faults = set(), [], [0, 0, 0]
        for _, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            if fault < 3:
                faults[fault] += 1
            seen.add((role, text))
            symbols.append((role[:1], fault < 2, fault == 2))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = brute(symbols)
        out, state, at = [], "", 0
        for edit in audit:
            needed = "assistant" if state == "u" else "user"
            role, text = (needed, "") if edit == "I" else kept[at][1:]
            at += edit != "I"
            if edit != "D":
                role = needed if edit == "R" else role
                out.append(f"{role}:{text}")
                state = role[:1]
        yield conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


ROWS = [(c, t, ("user", "assistant", "system", "tool", "", None)[(c * 7 + t * t) % 6 if c % 3 else t % 2], ("Done.", "so", " \t", None, "x! ", "Why?", "é.\n")[(c + t * 3) % 7])
        for c in range(40) for t in range(c % 5)]
ROWS += [(-7, 2, "user", "a."), (-7, 90, "assistant", "b."), (None, 0, "user", "no id."), (None, None, "assistant", "nor turn."), (50, None, "user", "q?"),
         (50, 1, "user", "q?"), (51, 0, "system", "Be."), (51, 1, "user", "e\n."), (51, 2, "assistant", "\x1c"), (50, 3, "user", "q?")]


def test_conversations_against_all_edits(spark):
    turns = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "conv_id long, turn long, role string, text string, signature int, audit int")
    got = repair.repaired(turns.repartition(5))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(ROWS), key=str)
    assert repair.repaired(turns.filter("false")).count() == 0


def test_a_conversation_without_rows(spark):
    conv = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    turns = spark.createDataFrame([(conv, 0, "user", "gone")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair.repaired(turns).collect()] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_a_long_conversation_with_repeats(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t if t % 10 else 0}.") for t in range(5000)]
    turns = spark.createDataFrame(rows * 2, "conv_id long, turn long, role string, text string")
    (got,) = repair.repaired(turns).collect()
    kept = damaged(rows * 2)[1]
    distinct = {(r, x) for _, r, x in kept if x}
    assert got.duplicate == sum(1 for _, _, x in kept if x) - len(distinct) and got.blank == sum(not x for _, _, x in kept)
    left = [e for e in got.audit if e != "I"]
    assert len(left) == len(kept) and set(got.audit) <= set(LETTERS)


@pytest.mark.parametrize("state, initial, after", [(0, "s", 1), (0, "u", 2), (0, "a", None), (1, "s", None), (2, "a", 3), (2, "u", None), (3, "u", 2), (3, "s", None), (0, "", None)])
def test_grammar(state, initial, after):
    assert repair.kept_state(state, initial) == after
