import random

from marlstone.llm import chat as m


def brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    convs = {c: [v[2:] for v in sorted(t)] for c, t in convs.items()}
    rank = lambda c: (c is None, c or 0)
    out = {}
    for c, turns in convs.items():
        longer = [o for o, other in convs.items() if len(other) > len(turns) and other[: len(turns)] == turns]
        same = min((o for o in convs if convs[o] == turns), key=rank)
        best = min(longer, key=lambda o: (-len(convs[o]), *rank(o))) if longer else None
        kept = not longer and same == c
        body = "".join(f"<|{r}|>\n{x}<|end|>\n" for _, r, _, x in turns)
        out[c] = (len(turns), kept, None if kept else best if longer else same, body if kept else None)
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant"][t % 2 :][:1] + ["user"]), rng.choice(["hi", "hi", None, "", "ok"])))
    rows += [(70, 0, None, None), (71, 0, None, ""), (72, 0, "user", "x" * 300_000), (73, 0, "user", "x" * 300_000), (73, 1, "assistant", "y")]
    rows += rows[:7]  # repeated rows
    rows += [(80, None, "user", "hi"), (80, 1, "user", "hi")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: (r.n_turns, r.kept, r.covered_by, r.rendered) for r in m.collapse(table).collect()}
    assert got == brute(rows)


def test_empty(spark):
    assert m.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
