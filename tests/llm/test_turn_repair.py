import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from tapeloom.llm import queries, turn_repair
from tests.conftest import SF

SPACE = " \t\n\x0b\x0c\r"
LEGAL = re.compile("(s?(ua)+)?")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [row, row] if kind == 3 else [row]
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        left = text.rstrip(SPACE)
        out.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def least(rows, found):
    """Cost and least audit by the recurrence over whole strings: forward, without checkpoints."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def better(table, state, cost, audit, turns):
        if state not in table or (cost, audit) < table[state][:2]:
            table[state] = (cost, audit, turns)

    def inserted(table):
        for _ in range(4):
            for state, (cost, audit, turns) in list(table.items()):
                for letter, name in (("u", "user"), ("a", "assistant")):
                    if (state, letter) in after:
                        better(table, letter, cost + 5, audit + "I", (*turns, f"{name}:"))
        return table

    for (role, text), fault in zip(rows, found, strict=True):
        new = {}
        for state, (cost, audit, turns) in inserted(best).items():
            better(new, state, cost + 2, audit + "D", turns)
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if (state, role[:1]) in after:
                better(new, after[state, role[:1]], cost + more, audit + "K", (*turns, f"{role}:{text}"))
            for letter, name in (("u", "user"), ("a", "assistant")):
                if (state, letter) in after:
                    better(new, letter, cost + more + 1, audit + "R", (*turns, f"{name}:{text}"))
        best = new
    ends = [v for k, v in inserted(best).items() if k in ("", "a")]
    return min(ends, key=lambda v: v[:2])


def brute(rows):
    out, by = {}, {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in damage(rows):
        mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        by[conv].append(((turn is not None, turn or 0), mark, turn, role, text))
    for conv, found in by.items():
        found.sort()
        turns, rs = [t for *_, t, _, _ in found if t is not None], [(r, x) for *_, r, x in found]
        kinds = faults(rs)
        cost, audit, repaired = least(rs, kinds)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(repaired)))
    return out


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, run int, at int").repartition(3)
    got = turn_repair.repaired(docs).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r[0]: tuple(r[1:]) for r in got}


def made(rnd, convs, most):
    texts = ["Yes.", "No!", "Well", " ", "", None, "What? ", "Longer one.\n", "x", "é?\t"]
    roles = ["system", "user", "assistant", "tool", None, "", "u", "User"]
    for conv in convs:
        for k in range(rnd.randint(1, most)):
            yield conv, rnd.choice([k, k, k, k + 1, None]), rnd.choice(roles[:3] * 4 + roles), rnd.choice(texts) if rnd.random() < 0.4 else f"Turn {rnd.randint(0, 60)}."


def test_recurrence_equals_all_edit_strings():
    rnd = random.Random(3)
    for _ in range(60):
        rows = [(rnd.choice(["system", "user", "assistant", "tool"]), rnd.choice(["A.", "B", "", "C!"])) for _ in range(rnd.randint(0, 3))]
        kinds, best = faults(rows), None
        for n in range(len(rows) + 4):
            for edits in product("DIKR", repeat=n):
                if sum(e != "I" for e in edits) != len(rows):
                    continue
                cost, options, at, legal = 0, [""], 0, True
                for e in edits:
                    cost += {"D": 2, "I": 5, "K": 0, "R": 1}[e]
                    if e == "I":
                        options = [o + x for o in options for x in "ua"]
                        continue
                    role, kind = rows[at][0], kinds[at]
                    at += 1
                    legal &= e == "D" or kind not in ("blank", "duplicate")
                    cost += 5 * (e != "D" and kind == "truncated")
                    options = options if e == "D" else [o + role[0] for o in options] if e == "K" else [o + x for o in options for x in "ua"]
                if legal and any(LEGAL.fullmatch(o) for o in options) and (best is None or (cost, "".join(edits)) < best):
                    best = (cost, "".join(edits))
        assert least(rows, kinds)[:2] == best, rows
        back = turn_repair.Backward()
        codes = "".join(next(c for c, v in turn_repair.CODES.items() if v == (r[0] if r[0] in "sua" else "x", k)) for (r, _), k in zip(rows, kinds, strict=True))
        assert back.before(codes, turn_repair.END)[turn_repair.START] == best[0]
        assert back.walk(codes, turn_repair.END, turn_repair.START, True)[0] == best[1]


def test_walk_keeps_square_roots_alone(monkeypatch):
    rnd = random.Random(4)
    codes = "".join(rnd.choice("ABEFIJMCGK") for _ in range(10_000))
    back = turn_repair.Backward()
    audit, _ = back.walk(codes, turn_repair.END, turn_repair.START, True)
    assert sum(e != "I" for e in audit) == len(codes) and len(back.known) < 2000


@pytest.mark.parametrize("run", [3, 4096])
def test_repair_equals_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(turn_repair, "RUN", run)
    rows = list(made(random.Random(run), [*range(120), None, -5], 9))
    assert found(spark, rows) == brute(rows)


def test_a_long_conversation_is_repaired_by_runs(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "RUN", 64)
    monkeypatch.setattr(turn_repair, "PIECE", 100)
    rows = list(made(random.Random(1), [7] * 400, 9)) + list(made(random.Random(2), range(20, 30), 5))
    rows = [(c, k if c == 7 else t, r, x) for k, (c, t, r, x) in enumerate(rows)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    whole = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 > 4)
    rows = [(lost, 0, "user", "Hi."), (whole, 0, "user", "x" * 300_000 + "."), (None, None, None, None), (-1, None, "assistant", "A.")] + [(-2, 3, "user", "Same.")] * 5
    got = found(spark, rows)
    assert got == brute(rows)
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", sha("")) and got[whole][5:7] == (2, "D")
    assert found(spark, []) == {}


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in queries.op12_turn_repair(spark, SF).collect()}
    assert got == brute(rows)
