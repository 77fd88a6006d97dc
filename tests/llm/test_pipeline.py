import re

import pytest
from pyspark.sql import functions as F
from test_decontaminate import plain as plain_marks
from test_mixing import plain as plain_mix
from test_mixing import size
from test_simhash import plain as plain_groups
from test_tokens import expected as plain_tokens

import __spark_entry__ as contract
import corpus_pipeline
from folioflow.llm import toxicity


def test_stages_have_the_columns_of_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").collect() == []


def test_run_by_plain_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r in rows if lexicon.score(r[1]) < toxicity.THRESHOLD]
    groups = plain_groups([r[:2] for r in rows])
    rows = [r for r in rows if r[0] in {c for _, _, c in groups}]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {m[0] for m in plain_marks([r[:2] for r in rows], bench) if m[5]}
    assert hit
    rows = [r for r in rows if r[0] not in hit]
    taken = {m[0]: m[4] for m in plain_mix(rows)}
    texts = {r[0]: r[1] for r in rows}
    # A document without words is taken with its source's passes; there is none here.
    assert all(size(t) for t in texts.values())
    rows = [(i, texts[i]) for i, n in taken.items() for _ in range(n // size(texts[i]))]
    found = sorted((tuple(r) for r in contract.queries()["pipeline"](spark, sf_dir).collect()), key=lambda r: r[1])
    assert found == plain_tokens(rows)


@pytest.mark.parametrize("name", ["toxicity", "decontamination"])
def test_a_task_gets_and_gives_a_text_once(spark, name):
    docs = spark.createDataFrame([(1, "some words", "en", None, 10), (None, None, None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect())) and kept.schema == docs.schema
    (step,) = re.findall(r"MapInArrow \w+\(([^)]*)\)[^\[]*\[([^\]]*)\]", kept._jdf.queryExecution().optimizedPlan().toString())
    assert len(step[0].split(",")) == 5
    assert len(step[1].split(",")) == (6 if name == "toxicity" else 8)
    numbers = docs.withColumn("text", F.lit(7))
    assert dict(corpus_pipeline.STAGES)[name](spark, numbers, "/root/testdata/sf0.001").select("text").distinct().collect() == [(7,)]
