"""Operator 7 against brute force and SQL."""

import hashlib
import random

from llm_fixtures import collected, documents, leaks, prose

from bspgraph.llm.decontaminate import PositionalIndex, contamination


def items_table(spark, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc string, term string")


def check(spark, rows, items, size=13, **more):
    got = collected(contamination(spark, documents(spark, rows), items_table(spark, items), size=size, **more), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for i, text in rows:
        n, hit, names = leaks(text, items, size)
        assert got[i] == (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and 20 * hit >= n), (i, text)
    assert len(got) == len(rows)


def planted(seed, n, size, vocabulary):
    """Documents of few words with item passages, whole and cut short, among them."""
    rng = random.Random(seed)
    items = [(k, " ".join(prose(rng, rng.randrange(1, 40), vocabulary))) for k in range(25)]
    rows = []
    for k in range(n):
        words = prose(rng, rng.randrange(0, 80), vocabulary)
        for _ in range(rng.randrange(3)):
            said = rng.choice(items)[1].split()
            a = rng.randrange(len(said))
            part = said[a : a + size + rng.randrange(-3, 6)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        rows.append((k, " ".join(words).upper() if k % 5 == 0 else ", ".join(words)))
    return rows, items


def test_windows(spark):
    check(spark, *planted(1, 150, 13, 300))


def test_few_words(spark):
    """Two or three words in all: lists of every term are long and windows overlap themselves."""
    check(spark, *planted(2, 80, 4, 3), size=4)
    check(spark, *planted(3, 80, 4, 3), size=4, rarest=1)
    check(spark, *planted(4, 80, 4, 3), size=4, rarest=4)


def test_odd_texts(spark):
    items = [(1, "Short item"), (2, "!!! ..."), (3, None), (4, ""), (5, "naïve Ünïcode wörds — 日本語 x"), (6, "same words here"), (7, "SAME words here"), (10, "short item")]
    long = "filler " * 50_000 + "same words here"
    rows = [(1, None), (2, ""), (3, "a short ITEM, indeed"), (4, "short-item"), (5, "xx naïve ünïcode"), (6, "Naïve Ünïcode wörds 日本語 X"), (7, long), (8, "same words here " * 3), (9, "shortitem short"), (10, "NAÏVE Ünïcode wörds 日本語 X")]
    check(spark, rows, items)


def test_ties_nulls_and_empty_tables(spark):
    items = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (None, "delta epsilon")]
    rows = [(4, "alpha beta gamma"), (4, "alpha beta gamma"), (4, "other"), (None, "delta epsilon"), (None, "alpha beta gamma")]
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contamination(spark, documents(spark, rows), items_table(spark, items)).collect())
    assert got == [("4", 1, 0, 0, False), ("4", 3, 3, 1, True), ("4", 3, 3, 1, True), ("None", 2, 2, 0, True), ("None", 3, 3, 1, True)]
    assert contamination(spark, documents(spark, []), items_table(spark, items)).count() == 0
    clean = contamination(spark, documents(spark, rows), items_table(spark, [])).collect()
    assert len(clean) == len(rows) and not any(r.n_hit or r.contaminated for r in clean)


def test_proximity(spark):
    """Looked-up terms near each other in another order are proximity matches, not phrase matches."""
    items = [(1, "red green blue"), (2, "one two")]
    rows = [(1, "blue x green y red"), (2, "red " + "far " * 60 + "green blue"), (3, "red green blue"), (4, "two, one"), (5, "red")]
    index = PositionalIndex(spark, documents(spark, rows), items_table(spark, items), 3, 3, "doc_id", "text", "item_id", "text")
    near = {(r.doc, r.item) for r in index.proximity_matches(8).collect()}
    assert near == {(1, "1"), (3, "1"), (4, "2")}
    assert {r.doc for r in index.phrase_candidates().collect()} == {3}


def test_query_against_sql(spark, sf):
    import duckdb

    from bspgraph.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.op7_benchmark_decontamination(spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()['op7_benchmark_decontamination']})").fetchall())
    assert any(r[columns.index("contaminated")] for r in got)


def test_proximity_of_repeated_and_absent_terms(spark):
    """A repeated term hides no close pair, and a window that the corpus lacks a term of still has its others."""
    def near(rows, items, slop, size=3, rarest=2):
        index = PositionalIndex(spark, documents(spark, rows), items_table(spark, items), size, rarest, "doc_id", "text", "item_id", "text")
        return {tuple(r) for r in index.proximity_matches(slop).collect()}

    text = lambda places: " ".join(places.get(k, f"f{k}") for k in range(40))
    assert near([(1, text({0: "a", 8: "a", 13: "b"}))], [(1, "a b")], 10) == {(1, "1", 8, 13)}
    assert near([(1, text({3: "a", 9: "b"})), (2, text({3: "a"}))], [(1, "a missing b")], 10) == {(1, "1", 3, 9)}
    assert near([(1, text({3: "a"}))], [(1, "a missing gone")], 10) == set()
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60)))) for k in range(40)]
    items = [(1, "a b c"), (2, "d d e"), (3, "f")]
    want = set()
    for i, t in rows:
        words = t.split()
        for k, said in items:
            terms = set(said.split())
            spans = [(x, y) for x in range(len(words)) for y in range(x, min(x + 6, len(words))) if terms <= set(words[x : y + 1])]
            want |= {(i, str(k), x, y) for x, y in spans if not any((x, y) != o and x <= o[0] and o[1] <= y for o in spans)}
    assert near(rows, items, 5, rarest=3) == want
