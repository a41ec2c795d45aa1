"""Operator 3 against a plain version and its SQL."""

import itertools

from bspgraph.llm.preference import ORACLE, preference_pairs
from bspgraph.llm.queries import op3_preference_formatting

TURNS = "pair_id long, turn long, role string, text string, side string, c string, t string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)


def plain(turns):
    return sorted(((t is not None, t), r or "", x or "") for t, r, x in turns)


def render(turns):
    return "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, r, x in turns)


def mask(turns):
    out, at = [], 0
    for _, r, x in turns:
        start = at + len("<|im_start|>") + len(r) + 1
        end = start + len(x) + len("<|im_end|>")
        if r == "assistant":
            out.append(f"{start}:{end}")
        at = end + 1
    return ",".join(out)


def expected(chosen, rejected):
    out = {}
    for pair in {r[0] for r in chosen} & {r[0] for r in rejected} - {None}:
        a, b = (plain([r[1:] for r in side if r[0] == pair]) for side in (chosen, rejected))
        n = len(list(itertools.takewhile(lambda x: x[0][1:] == x[1][1:], zip(a, b, strict=False))))
        out[pair] = (n, render(a[:n]), render(a[n:]), render(b[n:]), mask(a[n:]), mask(b[n:]))
    return out


def test_pairs(spark):
    chosen = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", None), (3, 1, None, ""), (4, 0, "user", "only chosen"),
        (5, 2, "assistant", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (6, 0, "system", "x" * 50_000), (6, 1, "assistant", "ü" * 100), (7, None, "user", "no turn"), (None, 0, "user", "no pair"),
    ]
    rejected = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "assistant", "really"), (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", ""), (3, 1, "", None), (3, 2, "assistant", None),
        (5, 1, "user", "a"), (5, 2, "user", "a"), (6, 0, "system", "x" * 50_000), (7, 0, "assistant", "other"), (8, 0, "user", "only rejected"), (None, 0, "user", "no pair"),
    ]
    got = {r.pair_id: (r.prompt_turns, r.prompt, r.chosen, r.rejected, r.chosen_mask, r.rejected_mask) for r in preference_pairs(table(spark, chosen), table(spark, rejected)).collect()}
    assert got == expected(chosen, rejected)
    assert got[2][2:] == ("", "", "", "")


def test_empty(spark):
    assert preference_pairs(table(spark, []), table(spark, [])).count() == 0


def test_query_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    df = op3_preference_formatting(spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE})").fetchall())
    assert len(got) >= 10
