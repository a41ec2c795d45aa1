"""The five stages on a small corpus: what each decides, judged on its own input."""

import random

import pytest
from llm_fixtures import SPACED, documents, leaks, near_components, prose, repeats
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels, items):
    spark.createDataFrame([(i, t, "en", "web", len(t) if t else 0) for i, t in docs], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def corpus(seed):
    rng = random.Random(seed)
    docs, labels = [], []
    abuse = "scum vermin filth".split()
    for k in range(160):
        words = prose(rng, 80, 3000)
        toxic = k % 8 == 0
        if toxic:
            for _ in range(12):
                words[rng.randrange(80)] = rng.choice(abuse)
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    base = docs[1][1].split()
    docs += [(200 + k, " ".join(f"n{k}" if j == 10 * k else w for j, w in enumerate(base))) for k in range(5)]
    passage = prose(rng, 70, 3000)
    docs += [(300 + k, " ".join([*prose(rng, 60, 3000), *passage, *prose(rng, 60, 3000)])) for k in range(4)]
    items = [(k, " ".join(prose(rng, 30, 3000))) for k in range(5)]
    docs += [(400, " ".join([*prose(rng, 40, 3000), *items[2][1].split(), *prose(rng, 40, 3000)]))]
    docs += [(500, ""), (501, None), (502, "!")]
    return docs, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return write(spark, f"file://{tmp_path_factory.mktemp('pipeline')}", *corpus(8))


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, folder):
    docs, labels, items = corpus(8)
    table = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "substring_dedup", "decontaminate", "encode"]
    clean = stages["toxicity"](spark, table, folder)
    toxic = {i for i, _, y in labels if y}
    assert {i for i, _ in docs} - {r.doc_id for r in clean.collect()} == toxic
    assert clean.columns == table.columns
    unlike = stages["near_dedup"](spark, clean, folder)
    before = [x for x in docs if x[0] not in toxic]
    roots = near_components([(i, t) for i, t in before], 5, 80)
    after = [x for x, r in zip(before, roots, strict=True) if x[0] == r]
    assert rows(unlike) == sorted(after, key=str)
    assert not {200, 201, 202, 203, 204} & {i for i, _ in after}
    cut = stages["substring_dedup"](spark, unlike, folder)
    words = repeats(after, 50)
    got = {r.doc_id: r for r in cut.collect()}
    for i, (w, gone) in words.items():
        assert SPACED.findall(got[i].text or "") == [x for x, g in zip(w, gone, strict=True) if not g]
        assert got[i].n_chars == (None if got[i].text is None else len(got[i].text))
    assert [sum(words[300 + k][1]) for k in range(4)] == [0, 70, 70, 70]
    fresh = stages["decontaminate"](spark, cut, folder)
    want = []
    for i in words:
        n, hit, _ = leaks(got[i].text, items, 13)
        if not (hit and (20 * hit >= n or hit >= 13)):
            want.append((i, got[i].text))
    assert rows(fresh) == sorted(want, key=str)
    assert 400 not in {i for i, _ in want} and {500, 501, 502} <= {i for i, _ in want}
    last = stages["encode"](spark, fresh, folder)
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.ids for r in last.collect()} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in want}
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect()) == sorted((r.doc_id, r.n_tokens) for r in last.collect())


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, tmp_path, empty):
    docs, labels, items = corpus(1)
    docs, labels, items = ([] if empty == name else x[:20] for name, x in (("documents", docs), ("labels", labels), ("benchmark", items)))
    got = corpus_pipeline.run(spark, write(spark, f"file://{tmp_path}", docs, labels, items)).collect()
    assert len(got) <= len(docs) and (empty == "documents") == (not got)


def test_odd_rows_and_columns(spark, folder):
    """Nulls in any column, repeated rows and columns with the operators' own names pass through the filters."""
    odd = documents(spark, [(1, "some clean words"), (1, "some clean words"), (None, None), (None, "no id here at all"), (3, None), (4, ""), (5, "long " * 100_000)]).withColumn("n_chars", F.lit(None).cast("long"))
    now = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == odd.columns
    assert sorted(str(r.doc_id) for r in now.collect()) == ["1", "3", "4", "5", "None", "None"]
    assert corpus_pipeline.STAGES[-1][1](spark, now, folder).count() == 6


def test_clean_rows_stay_beside_contaminated_ones(spark, tmp_path):
    """An id, or a null one, that a contaminated row and a clean one share removes the contaminated row alone."""
    rng = random.Random(3)
    item = " ".join(prose(rng, 30, 3000))
    clean = [" ".join(prose(rng, 40, 3000)) for _ in range(4)]
    dirty = f"{clean[0]} {item} {clean[1]}"
    docs = [(1, clean[0]), (1, dirty), (1, clean[0]), (None, clean[1]), (None, dirty), (None, None), (2, clean[2]), (3, dirty)]
    folder = write(spark, f"file://{tmp_path}", docs, [(1, 1, 0)], [(1, item)])
    got = corpus_pipeline.decontaminate(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert rows(got) == sorted([x for x in docs if x[1] != dirty], key=str)
