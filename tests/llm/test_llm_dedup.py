"""Operators 4 and 6 against brute force and SQL."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import collected, documents, near_components, prose, repeats

from bspgraph.llm.components import connected_components
from bspgraph.llm.neardup import minwise, near_duplicates, pack_set, shingle_sets, unpack_set, without_near_duplicates
from bspgraph.llm.shared import Scratch
from bspgraph.llm.substring import cut_spans, pack_entries, removal_digest, remove_repeats, unpack_entries


def changed(rng, words, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def families(seed: int, sizes, length: int, share: float, start: int = 0):
    """Groups of near copies: each copy of the group's text with a share of its words replaced."""
    rng, rows = random.Random(seed), []
    for size in sizes:
        base = prose(rng, length)
        rows += [" ".join(changed(rng, base, share if k else 0)) for k in range(size)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(start + i, rows[k]) for i, k in enumerate(order)]


def check(spark, rows, size, percent, **more):
    got = near_duplicates(spark, documents(spark, rows), shingle=size, percent=percent, **more).collect()
    want = near_components(rows, size, percent)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == sorted((i, c, i == c) for (i, _), c in zip(rows, want, strict=True))


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_about_the_threshold(spark, percent):
    """Documents one replaced word after another: similarities lie on both sides of the threshold, some exactly on it."""
    rng, rows = random.Random(percent), []
    for g in range(40):
        base = prose(rng, 40 + g)
        at = rng.sample(range(len(base)), 5)
        for k in range(5):
            rows.append((len(rows), " ".join(f"y{g}" if j in at[:k] else w for j, w in enumerate(base))))
    check(spark, rows, 3, percent)


def test_exact_threshold(spark):
    """17 of 20 shingles shared: 85 %, linked; 16 of 19: below, not linked."""
    a = [f"a{k}" for k in range(22)]
    rows = [(1, " ".join(a[:20])), (2, " ".join(a[:19])), (3, " ".join([f"b{k}" for k in range(19)])), (4, " ".join([f"b{k}" for k in range(22)])), (5, " ".join([f"c{k}" for k in range(21)])), (6, " ".join([f"c{k}" for k in range(18)]))]
    check(spark, rows, 3, 85)


def test_families_larger_than_a_node(spark):
    rows = families(3, [150, 90, 60, 5, 2, 2], 120, 0.02)
    rows += [(len(rows) + k, " ".join(prose(random.Random(k), 60))) for k in range(150)]
    check(spark, rows, 3, 85, node_size=16)


def test_mixed_large_nodes(spark):
    """Texts of a few words share minwise tokens by chance; small nodes at every level and outsiders of large ones."""
    rng = random.Random(9)
    rows = [(k, " ".join(["common passage of many words that stands everywhere in all texts"] * 3 + prose(rng, 3, 12))) for k in range(300)]
    check(spark, rows, 3, 85, node_size=8, levels=2)


def test_copies_and_odd_rows(spark):
    long = " ".join(f"l{k % 7919}" for k in range(120_000))
    rows = [(5, "one two three four"), (3, "ONE two\tthree  four"), (9, "one two three four"), (1, ""), (2, " \n "), (4, "word"), (6, "WORD"), (7, "two words"), (8, "words two"), (10, long), (11, long + " end"), (12, "É é"), (13, "é é")]
    check(spark, rows, 3, 85)
    docs = documents(spark, [*rows, (20, None), (5, "one two three four"), (None, "one two three four"), (None, None)])
    got = near_duplicates(spark, docs, shingle=3, percent=85).collect()
    assert len(got) == len(rows) + 4
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert by[20] == {(0, 20, True)}
    assert by[5] == {(2, 3, False)}
    assert by[None] == {(2, 3, False), (0, None, True)}
    assert by[10] == {(r := next(iter(by[10])))} and r[2]


def test_empty_and_lonely(spark):
    assert near_duplicates(spark, documents(spark, [])).count() == 0
    assert without_near_duplicates(spark, documents(spark, [])).count() == 0
    check(spark, [(k, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(20)], 5, 80)


def test_one_of_each_class_stays(spark):
    rows = families(11, [20, 3, 2, 1, 1], 80, 0.01)
    docs = documents(spark, [*rows, (500, None), (501, ""), (0, rows[0][1])])
    got = without_near_duplicates(spark, docs)
    assert got.columns == docs.columns
    want = {c for (i, _), c in zip(rows, near_components(rows, 5, 80), strict=True)}
    assert sorted(r.doc_id for r in got.collect()) == sorted([*want, 500, 501])


def test_one_row_stays_where_ids_are_null_or_shared(spark):
    rng = random.Random(12)
    base = [prose(rng, 80, 3000) for _ in range(4)]
    text = lambda b, k: " ".join([*base[b][:-1], f"end{k}"])
    rows = [(None, text(0, k)) for k in range(4)] + [(7, text(1, k)) for k in range(3)] + [(None, text(2, 0)), (9, text(2, 1)), (8, text(2, 2)), (8, text(2, 3)), (None, text(3, 0)), (None, text(3, 0)), (None, None), (7, "")]
    got = sorted((str(r.doc_id), r.text) for r in without_near_duplicates(spark, documents(spark, rows)).collect() if r.text)
    assert [i for i, _ in got] == ["7", "8", "None", "None"]
    assert set(got) <= {(str(i), t) for i, t in rows}
    assert sorted(next(k for k in range(4) if t.startswith(" ".join(base[k][:-1]))) for _, t in got) == [0, 1, 2, 3]


def test_minwise_tokens_estimate_similarity():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(300):
        both = rng.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, 10, dtype=np.uint64)])) for _ in range(2))
        agree.append((minwise(a) == minwise(b)).mean())
    assert abs(np.mean(agree) - 0.8) < 0.02


def test_packed_sets():
    import pyarrow as pa

    x = shingle_sets(pa.array([" ".join(f"w{k}" for k in range(500))]), 3)[0]
    assert (unpack_set(pack_set(x)) == x >> np.uint64(16)).all()
    assert len(unpack_set(pack_set(np.zeros(0, np.uint64)))) == 0


@pytest.mark.parametrize("one_task_rows", [0, 10**6])
def test_components(spark, one_task_rows):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(120)] + [(500, 500), (7, 3), (7, 3)] + [(900, 901 + k) for k in range(50)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), one_task_rows=one_task_rows).collect()
    assert {(r.node, r.root) for r in got} == {(x, find(x)) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert len({r.node for r in got}) == len(got)
    none = connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), one_task_rows=one_task_rows)
    assert none.count() == 0


def digest_of(words):
    import hashlib

    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def check_repeats(spark, rows, window):
    got = collected(removal_digest(spark, documents(spark, rows), window), "doc_id", "n_words", "n_removed", "kept_sha256")
    for i, (words, gone) in repeats(rows, window).items():
        assert got[i] == (len(words), sum(gone), digest_of([w for w, g in zip(words, gone, strict=True) if not g])), i
    assert len(got) == len(rows)


def shared_passages(seed, n, window):
    rng = random.Random(seed)
    passages = [prose(rng, window + d, 50) for d in (-1, 0, 1, 7, 40)]
    rows = []
    for k in range(n):
        words = prose(rng, rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((rng.randrange(10**9), " ".join(words)))
    return list(dict(rows).items())


@pytest.mark.parametrize("window", [5, 20])
def test_removed_words(spark, window):
    check_repeats(spark, shared_passages(window, 250, window), window)


def test_repeats_within_documents(spark):
    loop = "a b c d e "
    check_repeats(spark, [(3, loop * 30), (1, "z " + loop * 8), (2, "é " * 50), (7, "one word " * 25), (9, ""), (10, "x"), (11, ("tab\tline\n" * 15))], 20)


def test_one_passage_everywhere(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    check_repeats(spark, [(k, f"head{k} {passage} tail{k}") for k in range(400)], 20)


def test_odd_repeats(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    long = " ".join(f"l{k}" for k in range(150_000))
    rows = [(4, passage), (None, passage), (5, None), (6, long), (7, long), (4, passage)]
    got = removal_digest(spark, documents(spark, rows), 20).collect()
    assert sorted(((r.doc_id is not None, r.doc_id), r.n_words, r.n_removed) for r in got) == [((False, None), 30, 0), ((True, 4), 30, 30), ((True, 4), 30, 30), ((True, 5), 0, 0), ((True, 6), 150_000, 0), ((True, 7), 150_000, 150_000)]
    twice = removal_digest(spark, documents(spark, [(4, passage), (4, passage)]), 20).collect()
    assert [r.n_removed for r in twice] == [0, 0]  # equal starts of one id
    assert removal_digest(spark, documents(spark, []), 20).count() == 0
    assert remove_repeats(spark, documents(spark, []), 20).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_rows_that_share_ids(spark, parts):
    """Each row is judged alone: smaller ids and earlier places of its own text count, rows of the same id don't."""
    window, rows = 6, [(i % 40, t) for i, t in shared_passages(5, 160, 6)]
    words = [t.split() for _, t in rows]
    first, own = {}, [{} for _ in rows]
    for k, (i, _) in enumerate(rows):
        for s in range(len(words[k]) - window + 1):
            g = tuple(words[k][s : s + window])
            first[g] = min(first.get(g, i), i)
            own[k].setdefault(g, s)
    want = []
    for k, (i, _) in enumerate(rows):
        gone = set()
        for s in range(len(words[k]) - window + 1):
            g = tuple(words[k][s : s + window])
            if first[g] < i or own[k][g] < s:
                gone.update(range(s, s + window))
        want.append((i, len(words[k]), len(gone)))
    got = removal_digest(spark, documents(spark, rows).repartition(parts), window)
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got.collect()) == sorted(want)


def test_entries_survive_packing():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000):
        h, extra, at = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64)), rng.integers(0, 2**16, n).astype(np.uint16), rng.integers(0, 2**31, n)
        for ids in (rng.integers(-(2**63), 2**63 - 1, n), rng.integers(10, 20, n), np.full(n, -(2**63))):
            assert all((a == b).all() for a, b in zip(unpack_entries(pack_entries(h, extra, at, ids)), (h, extra, at, ids), strict=True))


def test_texts_without_repeats(spark):
    rows = shared_passages(77, 120, 12)
    docs = documents(spark, [*rows, (-5, None)])
    out = remove_repeats(spark, docs, 12)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r.doc_id: r for r in out.collect()}
    assert got[-5].text is None
    for i, (words, gone) in repeats(rows, 12).items():
        assert got[i].text.split(" ") == ([w for w, g in zip(words, gone, strict=True) if not g] or [""]) or got[i].text.split() == [w for w, g in zip(words, gone, strict=True) if not g]
        assert got[i].key == "key"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é\t\n ", max_size=60), st.integers(0, 10), st.integers(1, 10))
def test_cut_spans(text, a, n):
    words = text.encode().split()
    a, b = min(a, len(words)), min(a + n, len(words))
    if a < b:
        left = cut_spans(text, [a, b])
        assert left.encode().split() == words[:a] + words[b:]
    assert cut_spans(text, None) == text


@pytest.mark.parametrize("name", ["op4_minhash_near_dedup", "op6_substring_dedup"])
def test_queries_against_sql(spark, sf, name):
    import duckdb

    from bspgraph.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall())
