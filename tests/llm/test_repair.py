"""Operator 11 against an exhaustive search over edits."""

import hashlib
import random
import zlib

import pytest

from tallyspark.llm import repair

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        said = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        fault = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2:]
        if fault == 0:
            continue
        text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
        out += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def expected(rows):
    """Least (cost, audit) by carrying every state's best pair; kept apart from the operator's backward vectors."""
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.strip(SPACE)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        faults.append(fault)
        seen.add((role, text))
    ins = {"": "u", "s": "u", "u": "a", "a": "u"}

    def closed(best):
        for _ in range(3):
            for s, (cost, audit, out) in list(best.items()):
                t = ins[s]
                new = (cost + 3, audit + "I", out + (("user" if t == "u" else "assistant", ""),))
                best[t] = min(best.get(t, new), new)
        return best

    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        after = {}

        def offer(s, x):
            after[s] = min(after.get(s, x), x)

        for s, (cost, audit, out) in closed(best).items():
            offer(s, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault == "truncated" else 0
            c = role[:1]
            if c and (c == ins[s] or (c == "s" and s == "")):
                offer(c, (cost + extra, audit + "K", out + ((role, text),)))
            offer(ins[s], (cost + extra + 3, audit + "R", out + (("user" if ins[s] == "u" else "assistant", text),)))
        best = after
    best = closed(best)
    cost, audit, out = min(best[s] for s in ("", "a") if s in best)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def random_rows(rng, convs, longest):
    texts = ["a.", "b!", "c", "d?", "", " \t", None, "long é text.", "x　", "y.\n"]
    roles = ["user", "assistant", "system", "tool", "", None, "u2", "User"]
    out = []
    for conv in [None, *range(convs)]:
        n = rng.randint(0, longest)
        turns = [rng.choice([None, rng.randint(-3, 3 * n)]) if rng.random() < 0.2 else i for i in range(n)]
        out += [(conv, t, rng.choices(roles, [6, 6, 2, 1, 1, 1, 1, 1])[0], rng.choice([rng.choice(texts), f"say {rng.randint(0, 9)}{rng.choice(['.', '', '!'])}"])) for t in turns]
    out += rng.sample(out, min(len(out), 20))  # repeated rows
    return out


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, copies int")
    got = repair.report(repair.repair(repair.damage(frame), copies="copies")).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("block", [4096, 3])
def test_damaged_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    rows = random_rows(random.Random(block), 60, 14)
    assert run(spark, rows) == {c: expected(damaged(r)) for c, r in by_conversation(rows).items()}


def test_whole_conversations_in_small_blocks():
    rng = random.Random(5)
    for _ in range(400):
        rows = [(i, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", f"{i}."])) for i in range(rng.randint(0, 12))]
        blocks, block = [], repair._Block(1)
        seen = set()
        for turn, role, text in rows:
            if len(block.symbols) >= rng.randint(1, 4):
                blocks.append(block)
                block = repair._Block(1)
            said = text.strip(SPACE)
            block.add(turn, role, text, 1, not said, (role, text) in seen, bool(said) and said[-1] not in ".!?")
            seen.add((role, text))
        blocks.append(block)
        rows_ = [b.row(0, k) for k, b in enumerate(blocks)]
        ends = [repair.END]
        for r in rows_[:0:-1]:
            ends.append(repair.through(r[7], ends[-1]))
        ends.reverse()
        state, cost, audit, said = repair.NONE, 0, "", []
        for k, b in enumerate(blocks):
            s, c, x = repair.walk(bytes(b.symbols), b.copies, ends[k], k == len(blocks) - 1)[state]
            roles, texts = repair.edited(state, bytes(b.symbols), b.copies, b.roles, b.texts, x)
            said += [f"{r}:{t}" for r, t in zip(roles, texts)]
            state, cost, audit = s, cost + c, audit + x
        assert (cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()) == expected(rows)[5:]


def test_very_long_conversation_and_repeated_rows(spark, monkeypatch):
    """One conversation of 3,000 rows in blocks of 100, one row 5,000 times, one very long text, and conversations that lose all rows."""
    monkeypatch.setattr(repair, "BLOCK_ROWS", 100)
    rng = random.Random(1)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["ok.", f"n{i}.", f"n{i}", ""])) for i in range(3000)]
    rows += [(8, 1, "user", "again.")] * 5000 + [(9, 0, "user", "é " * 1_000_000 + "."), (9, 1, "assistant", "short.")]
    gone = [(c, 0, "user", "bye.") for c in range(100, 300) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    rows += gone
    got = run(spark, rows)
    assert got == {c: expected(damaged(r)) for c, r in by_conversation(rows).items()}
    assert got[gone[0][0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_rows_without_damage_and_an_empty_table(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    pieces = repair.repair(frame)
    assert [(r.role, r.text) for r in repair.turns(pieces).orderBy("place").collect()] == [("user", "a."), ("assistant", "b.")]
    assert repair.report(pieces).first().audit == "KK"
    assert repair.report(repair.repair(frame.limit(0))).count() == 0
