"""Conversation repair against a plain forward search over the same rules."""

import hashlib
import random
import zlib

import pytest

from medoidlab.llm import conversation_repair as repair
from medoidlab.llm.lattice import END, SIGNS, UNREACHED, Block, transfer

TURNS = "conv_id long, turn long, role string, text string, key string, rank int"
WHITE = " \t\n\x0b\f\r"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def cheapest(turns):
    """Least (cost, edits) with the repaired lines; ``turns`` are (status, role, text)."""

    def inserted(best):
        for _ in range(4):
            for q, (cost, edits, lines) in list(best.items()):
                way = (cost + 2, edits + "I", [*lines, NAME[NEXT[q]] + ":"])
                best[NEXT[q]] = min(best.get(NEXT[q], way), way)
        return best

    best = inserted({"": (0, "", [])})
    for status, role, text in turns:
        ways = {}
        for q, (cost, edits, lines) in best.items():
            options = [(q, (cost + 3, edits + "D", lines))]
            if status in ("fine", "truncated"):
                more = cost + (status == "truncated")
                to = AFTER.get((q, role[:1]))
                if to:
                    options.append((to, (more, edits + "K", [*lines, f"{role}:{text}"])))
                options.append((NEXT[q], (more + 2, edits + "R", [*lines, f"{NAME[NEXT[q]]}:{text}"])))
            for to, way in options:
                ways[to] = min(ways.get(to, way), way)
        best = inserted(ways)
    return min(best[q] for q in ("", "a") if q in best)


def brute(rows):
    """The contract on (conv_id, turn, role, text) rows after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(
            ((t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv),
            key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]),
        )
        seen, judged = set(), []
        for _, role, text in turns:
            end = text.rstrip(WHITE)
            status = "blank" if not end else "duplicate" if (role, text) in seen else "fine" if end[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((status, role, text))
        numbers = [t for t, *_ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        count = [sum(s == k for s, *_ in judged) for k in ("blank", "duplicate", "truncated")]
        pairs = zip(judged, judged[1:])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
        cost, audit, lines = cheapest(judged)
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def harmed(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def conversations(n=120, longest=12):
    rng = random.Random(7)
    rows = []
    for c in range(n):
        turn = 0
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Ünser"])
            text = rng.choice(["A b.", "Why?", "cut off", " \t", "", None, "Long. " * 40, f"t {rng.random()}!", "é\n"])
            rows.append((c if c else None, None if rng.random() < 0.05 else turn, role, text))
    return rows + [rows[-1]] * 3


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    in_order, edits, fixed = repair.repair(df)
    digest = {r.key: r.sha256 for r in repair.digests(fixed).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {
        None if r.key == "-" else int(r.key[1:]): (
            r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digest.get(r.key, empty)
        )
        for r in repair.faults(in_order, edits).collect()
    }


def audit(turns):
    return "".join("I" if c in "ua" else "R" if c in "UA" else c for t in turns for c in t)


STATUS = ("fine", "truncated", "blank", "duplicate")


def as_turns(signs):
    return [(STATUS[SIGNS.index(s) >> 2], "suax"[SIGNS.index(s) & 3], "") for s in signs]


@pytest.mark.parametrize("width", [1, 2, 5, 16])
def test_lattice_matches_forward_search(width):
    rng = random.Random(width)
    for _ in range(400):
        signs = "".join(rng.choice(SIGNS) for _ in range(rng.randint(1, 14)))
        cost, turns, _ = Block(signs, width=width).edits()
        assert (cost, audit(turns)) == cheapest(as_turns(signs))[:2], signs
        assert len(turns) == len(signs)


def test_blocks_compose():
    rng = random.Random(3)
    for _ in range(150):
        signs = "".join(rng.choice(SIGNS) for _ in range(rng.randint(2, 30)))
        cut = rng.randint(1, len(signs) - 1)
        last = Block(signs[cut:], END).entry
        costs = [c + e for c, e in zip(transfer(signs[:cut])[0], last) if c is not UNREACHED and e is not UNREACHED]
        _, first, state = Block(signs[:cut], last, False).edits()
        _, rest, _ = Block(signs[cut:]).edits(state)
        assert (min(costs), audit(first + rest)) == cheapest(as_turns(signs))[:2]


@pytest.mark.parametrize("block", [3, 4096])
def test_repair_matches_brute_force_also_over_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = conversations()
    assert result(spark, rows) == brute(rows)


def test_damage_and_query_keep_every_conversation(spark, tmp_path):
    rows = conversations(200, 3)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    damaged = [tuple(r) for r in repair.damaged(df).collect()]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(damaged, key=order) == sorted(harmed(rows), key=order)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    out = repair.op12_conversation_repair(spark, str(tmp_path)).collect()
    want = brute(harmed(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert len(out) == 200 and {r.conv_id for r in out} == {r[0] for r in rows}
    assert any(r.conv_id not in want for r in out)
    assert all(tuple(r)[1:] == want.get(r.conv_id, empty) for r in out)


def test_repaired_turns_are_rows_and_nothing_gives_nothing(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Go."), (1, 1, "user", "Go."), (1, 2, "tool", "Done.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    _, _, fixed = repair.repair(df)
    got = [(r.role, r.text, r.edit) for r in fixed.orderBy("rank", "place").collect()]
    assert got == [("user", "", "I"), ("assistant", "Hi.", "K"), ("user", "Go.", "K"), ("assistant", "Done.", "R")]
    in_order, edits, fixed = repair.repair(df.limit(0))
    assert fixed.count() == 0 and repair.faults(in_order, edits).count() == 0
