"""Each stage on its own input, and the whole run."""

import pytest

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_bpe import check_pieces, library  # noqa: F401
from tests.llm.test_native import base_spans, dropped
from tests.llm.test_pairs import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Every stage's input, written and read again as the driver does."""
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found.append(docs)
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*found, docs]


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_stay(steps):
    assert all(df.columns == COLUMNS for df in steps[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "secret_scan", "packing"]


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    before, after = rows(steps[0]), rows(steps[1])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i in before if labels.get(i) == 0]
    toxic = [i for i in before if labels.get(i) == 1]
    assert all(after[i] == before[i] for i in after) and sum(i in after for i in clean) >= 0.98 * len(clean)
    assert sum(i not in after for i in toxic) >= 0.6 * len(toxic)


def test_line_stage(steps):
    before, after = steps[1].collect(), rows(steps[2])
    want = dropped([(r["source"], r["text"]) for r in before])
    assert [after[r["doc_id"]]["text"] for r in before] == want and len(after) == len(before)
    assert all(r["n_chars"] == len(r["text"] or "") for r in after.values())


def test_near_copy_stage(steps):
    before, after = rows(steps[2]), rows(steps[3])
    groups = brute([(i, r["text"]) for i, r in before.items()])
    assert set(after) == {c if n else i for i, n, c in groups} and all(after[i] == before[i] for i in after)


def test_secret_stage(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    for i, r in before.items():
        if not base_spans(r["text"] or "") and "[SECRET]" not in (after[i]["text"] or ""):
            assert after[i]["text"] == r["text"]
        assert not base_spans(after[i]["text"] or "")


def test_packing_stage(steps, library):  # noqa: F811
    check_pieces(steps[5].collect(), [(r["doc_id"], r["text"]) for r in steps[4].collect()], library)


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    total = lambda df: df.groupBy("doc_id").sum("length").orderBy("doc_id").collect()
    assert total(got) == total(steps[-1])


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_cases(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = cases.documents(spark)
    got = stage(spark, docs, SF)
    kept = got.collect()
    if name == "packing":
        assert len([p for p in kept if p["start"] == 0]) == docs.count()
    else:
        assert got.columns == docs.columns
        assert len(kept) == docs.count() - (2 if name == "ngram_join" else 0)  # two copies of one text go
    assert stage(spark, cases.empty(spark), SF).count() == 0
