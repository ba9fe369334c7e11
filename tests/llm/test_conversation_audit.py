"""Audits against a programme over whole strings, and conversations that are settled in parts."""

import hashlib
import random

from tidemark.llm import conversation_audit as ca


def plain(rows):
    """(cost, audit, text) of the cheapest repair of rows (role, text, initial, fault), all strings held."""
    best = {"": (0, "", "")}

    def insert(best):
        for after, before, role in (("u", ("", "s", "a"), "user"), ("a", ("u",), "assistant")):
            for s in before:
                if s in best:
                    c, a, r = best[s]
                    best[after] = min(best.get(after, (10**9, "", "")), (c + 3, a + "I", r + f"{role}:\n"))
        return best

    best = insert(best)
    for role, text, initial, fault in rows:
        new = {}
        for s, (c, a, r) in best.items():
            options = [(s, c + 4, "D", "")]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if s == "u":
                    options.append(("a", c + 3 + more, "R", f"assistant:{text}\n"))
                else:
                    options.append(("u", c + 3 + more, "R", f"user:{text}\n"))
                if (s, initial) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    options.append((initial, c + more, "K", f"{role}:{text}\n"))
            for to, cost, letter, said in options:
                new[to] = min(new.get(to, (10**9, "", "")), (cost, a + letter, r + said))
        best = insert(new)
    cost, audit, text = min(best[s] for s in ("", "a") if s in best)
    return cost, audit, hashlib.sha256(text[:-1].encode()).hexdigest()


def drawn(rng, n):
    role = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "": ""}
    out = []
    for i in range(n):
        initial = rng.choice("suauauax") if rng.random() < 0.9 else ""
        out.append((role[initial], f"t{i}", initial, rng.choice([None, None, "truncated", "blank", "duplicate"])))
    return out


def fed(rows, every):
    audit = ca.Audit(every)
    for i, (role, text, initial, fault) in enumerate(rows):
        audit.add(i, role, text, initial, fault)
    return audit


def test_equals_the_plain_programme():
    rng = random.Random(3)
    for k in range(300):
        rows = drawn(rng, rng.randrange(0, 25))
        for every in (1, 3, 4096):
            assert fed(rows, every).finish()[5:] == plain(rows), (k, rows)


def test_a_long_conversation_is_let_go():
    rng = random.Random(4)
    rows = drawn(rng, 6000)
    audit, most = ca.Audit(50), 0
    for i, (role, text, initial, fault) in enumerate(rows):
        audit.add(i, role, text, initial, fault)
        most = max(most, len(audit.rows))
    assert most < 200
    assert audit.finish()[5:] == plain(rows)


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(ca, "_PRIME", 2)
    rng = random.Random(5)
    for _ in range(100):
        rows = drawn(rng, 14)
        assert fed(rows, 5).finish()[5:] == plain(rows)


def test_frames(spark):
    rows = [(1, 0, "user", "Hi.", 9), (1, 1, "assistant", "Yes.", 9), (None, 5, "user", "Hm", 9), (None, None, None, None, 9), (2, 3, "user", "a.", 9), (2, 3, "user", "a.", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost long")
    got = {r["conv_id"]: r.asDict() for r in ca.audits(df).collect()}
    assert set(got) == {1, 2, None}
    assert got[1]["audit"] == "KK" and got[1]["cost"] == 0 and got[1]["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    assert (got[None]["blank"], got[None]["truncated"], got[None]["audit"], got[None]["gaps"]) == (1, 1, "DD", 0)
    assert (got[2]["duplicate"], got[2]["gaps"]) == (1, 0)
    names = spark.createDataFrame([("a", 1, "user", "x" * 300_000 + ".")], "conv_id string, turn long, role string, text string")
    assert [tuple(r)[0::7] for r in ca.audits(names).collect()] == [("a", "KI")]
    assert ca.audits(df.where("false")).collect() == []
