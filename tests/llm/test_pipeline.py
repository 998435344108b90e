"""The pipeline's stages against plain versions, each on its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate
from tests.llm.test_jaccard import plain
from tests.llm.test_operators import LETTER_WORD, lower

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after)
        if name != "encoding":
            assert docs.columns == columns
        if name == "language_id":
            assert set(after) == {k for k, r in before.items() if r.text and re.search(r"[^\W\d_]", r.text)}
        if name == "near_duplicates":
            assert sorted(after) == plain([(k, r.text) for k, r in before.items()])
        if name == "decontamination":
            windows = {tuple(w[j : j + decontaminate.SIZE]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if (w := LETTER_WORD.findall(lower(r.text))) for j in range(max(1, len(w) - 9))}
            hit = lambda w: any(tuple(w[j : j + n]) in windows for n in {len(x) for x in windows} for j in range(len(w) - n + 1))
            assert set(after) == {k for k, r in before.items() if not hit(LETTER_WORD.findall(lower(r.text)))}
        if name == "personal_data":
            assert set(after) == set(before)
            assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text) for r in after.values())
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "encoding":
            assert set(after) == set(before) and all(r.round_trip for r in after.values())
        before = after


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 100


LONG = "palabra larga y otra cosa " * 40_000
MAIL = "mail a@b.co now"
ODD = [(9_000_001, None), (9_000_002, ""), (9_000_003, " \n "), (9_000_004, "123 ²½"), (9_000_005, MAIL), (9_000_005, MAIL), (None, MAIL), (None, "other text of its own here"), (9_000_006, LONG), (-(2**63), "the smallest id of all ids")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows among real ones, with columns named as the stages name their own."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    clash = {"row": F.lit(7), "row_": F.lit(8), "__row": F.lit(9), "k0": F.lit("a"), "__k0": F.lit("b"), "__k1": F.lit("c"), "spans": F.lit("d"), "code": F.lit(1.5), "score": F.lit(None).cast("int")}
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").limit(80).unionByName(rows).withColumns(clash).checkpoint()


@pytest.mark.parametrize("place", range(5))
def test_stages_on_odd_rows(spark, odd, place):
    name, stage = corpus_pipeline.STAGES[place]
    found = stage(spark, odd, DATA)
    rows = found.collect()
    if name != "encoding":
        assert found.columns == odd.columns
        assert all((r["row"], r["row_"], r["__row"], r["k0"], r["__k0"], r["__k1"], r["spans"], r["code"], r["score"]) == (7, 8, 9, "a", "b", "c", "d", 1.5, None) for r in rows)
    texts = [r.text for r in rows] if name != "encoding" else []
    if name == "language_id":
        assert not {None, "", " \n ", "123 ²½"} & set(texts)
        assert texts.count(MAIL) in (0, 3)
    if name == "near_duplicates":
        assert texts.count(MAIL) == 1 and texts.count("other text of its own here") == 1 and LONG in texts
        assert sum(t is None or not t.strip() for t in texts) == 1
    if name == "decontamination":
        assert texts.count(MAIL) == 3 and texts.count(None) == 1 and LONG in texts
    if name == "personal_data":
        assert len(texts) == odd.count() and texts.count("mail [EMAIL] now") == 3 and texts.count(None) == 1 and LONG in texts
    if name == "encoding":
        assert len(rows) == odd.count() and sum(r.ids is None for r in rows) == 1 and all(r.round_trip is not False for r in rows)
    assert stage(spark, odd.limit(0), DATA).count() == 0
