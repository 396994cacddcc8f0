from collections import Counter

import pytest

import corpus_pipeline as c
from tests.llm.cases import awkward, frame, prose
from verdikt.llm import dsir, packing, quality_rules, registry, simhash

SF = "/root/testdata/sf0.001"


def test_stages_act_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in c.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), docs.schema)
        kept[name] = (Counter(r["doc_id"] for r in docs.collect()), Counter(r["doc_id"] for r in after.collect()))
        assert not kept[name][1] - kept[name][0] and 0 < after.count() < docs.count()
        docs = after
    placed = c.pack_documents(spark, docs, SF).collect()
    assert {r["doc_id"] for r in placed} == {r["doc_id"] for r in docs.collect()}
    assert Counter(r["doc_id"] for r in c.run(spark, SF).collect()) == Counter(r["doc_id"] for r in placed)


def test_each_stage_is_its_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(c.keep_by_rules(spark, docs, SF)) == ids(quality_rules.op1(spark, SF).where("kept"))
    assert ids(c.keep_by_classifier(spark, docs, SF)) == ids(dsir.op10(spark, SF).where("kept"))
    assert ids(c.drop_near_duplicates(spark, docs, SF)) == ids(simhash.op9(spark, SF).where("doc_id = component_id"))
    assert ids(c.pack_documents(spark, docs, SF)) == ids(packing.op5(spark, SF))


def test_stages_take_awkward_rows_and_empty_tables(spark):
    rows = awkward() + [(500 + i, prose(90, 9), "en", "hot", 0) for i in range(20)]
    for start in (frame(spark, rows, extra=True), frame(spark, [], extra=True)):
        docs = start
        for _, stage in c.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), start.schema)
        assert c.pack_documents(spark, docs, SF).count() >= docs.count()


def test_registry_has_one_query_an_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14)) and set(registry.ORACLE) <= set(registry.QUERIES)


# (Spelling groups are words, held against brute force in their own test.)
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"op12_spelling_groups"}))
def test_queries_return_every_row(spark, name):
    df = registry.QUERIES[name](spark, SF)
    table, key = ("pages", "page_id") if "page_id" in df.columns else ("conversations", "conv_id") if "conv_id" in df.columns else ("documents", "doc_id")
    if name.startswith("op11"):
        assert df.count() == df.select("conv_id").distinct().count()
    want = Counter(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    got = Counter(r[0] for r in df.select(key).collect())
    assert set(got) == set(want) and (got == want or name.startswith(("op5", "op11")))


def test_only_the_last_stage_stays(spark):
    """Of the stages' tables a run leaves the one that its result reads."""
    from verdikt.session import child_folders, ensure_checkpoint_dir

    stages = lambda: {f for f in child_folders(spark, ensure_checkpoint_dir(spark)) if f.startswith("llm-stage-")}
    before = stages()
    placed = c.run(spark, SF)
    assert len(stages() - before) == 1 and placed.count() > 0
