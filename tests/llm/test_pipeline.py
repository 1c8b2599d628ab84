"""Each stage on its own input against a plain Python version; the whole on odd rows."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millwarden.llm import quality, toxicity
from millwarden.session import cut_lineage
from tests.llm.test_operators import brute_components, brute_measures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    """Input of the first stage, then what each stage kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], SF)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns_and_shrink(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "decontamination", "packing"]
    for before, after in zip(staged[:-2], staged[1:-1]):
        assert after.columns == before.columns and after.exceptAll(before).isEmpty()


def test_quality_stage(staged):
    before, after = texts(staged[0]), texts(staged[1])
    for key, text in before.items():
        n_words, _, _, _, repeats = brute_measures(text)
        if n_words < 20 or 100 * repeats > 30 * n_words:
            assert key not in after
    rated = quality.measured(staged[0])
    kept = quality.rate(rated, quality.fit_rules(rated)).filter("kept")
    assert {r.doc_id for r in kept.collect()} == set(after)


def test_toxicity_stage(spark, staged):
    model = toxicity.fit(staged[1], spark.read.parquet(f"{SF}/labels.parquet"))
    score, hashes = model.scorer(), toxicity.WordHashes()
    want = {k for k, t in texts(staged[1]).items() if score(toxicity.features(t, hashes)) < corpus_pipeline.TOXIC}
    assert set(texts(staged[2])) == want


def test_near_duplicate_stage(staged):
    rows = sorted(texts(staged[2]).items())
    assert set(texts(staged[3])) == {k for k, (_, component) in brute_components(rows).items() if k == component}


def test_decontamination_stage(spark, staged):
    def words(text):
        return re.sub(r"[^\w]+", " ", (text or "").lower()).split()

    grams = {tuple(w[k:k + 13]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words(r.text)] for k in range(len(w) - 12)}
    before, after = texts(staged[3]), texts(staged[4])
    leaking = {k for k, t in before.items() if any(tuple(w[j:j + 13]) in grams for w in [words(t)] for j in range(len(w) - 12))}
    assert leaking and set(before) - set(after) == leaking


def test_packing_stage(staged):
    pieces = staged[5].collect()
    totals = {r.doc_id: r.doc_tokens for r in pieces}
    assert set(totals) == set(texts(staged[4]))
    assert sum(r.length for r in pieces) == sum(totals.values())


def test_stages_on_odd_rows(spark):
    rows = [(1, "Words enough are here. " * 3 + " ".join(f"w{k}" for k in range(60)) + ". End of it.", "en", None, 5, "own"), (None, None, None, None, None, None),
            (2, "", "en", "s", 0, "own"), (3, " ".join(f"x{k}" for k in range(5000)) + ".", None, "s", 1, None)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, source string, n_chars long, node string")
    for table in (docs, docs.limit(0)):
        out = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = cut_lineage(stage(spark, out, SF))
            assert out.columns == docs.columns, name
        assert out.filter("doc_id = 1").count() == (1 if table is docs else 0)
        assert corpus_pipeline.STAGES[-1][1](spark, out, SF).agg(F.sum("length")).count() == 1
