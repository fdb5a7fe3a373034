"""The corpus pipeline, stage by stage, on small whole tables."""

import corpus_pipeline
from ruletrace.llm.common import shared_path
from ruletrace.llm.decontamination import contaminated
from ruletrace.llm.toxicity import toxicity
from tests.llm import test_near_copies
from tests.llm.samples import doc_rows, docs as sample
from tests.llm.test_texts import plain_removals

SF_DIR = "/root/testdata/sf0.001"


def test_each_stage_takes_effect(spark):
    docs, kept = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    tables = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("labels", "benchmark")}
    for name, stage in corpus_pipeline.STAGES:
        path = shared_path(spark, "stage")
        out = stage(spark, docs, SF_DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        out.write.parquet(path)
        kept[name] = (docs, docs := spark.read.parquet(path))
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    before, after = kept["toxicity"]
    assert ids(after) == ids(toxicity(before, tables["labels"]).where("predicted = 0"))
    before, after = kept["simhash near-dedup"]
    test_near_copies.check(spark, [(r["doc_id"], r["text"]) for r in before.collect()], after)
    before, after = kept["suffix-array dedup"]
    plain = plain_removals([(r["doc_id"], r["text"]) for r in before.collect()], 100)
    assert ids(after) == ids(before)
    lengths = {r["doc_id"]: len(r["text"].encode()) for r in after.collect()}
    # A character that lost a byte goes as a whole: three bytes at most at each end of a span.
    assert all(0 <= n - removed - lengths[d] <= 6 * spans for d, n, removed, spans, _ in plain)
    before, after = kept["benchmark decontamination"]
    found = {r["doc_id"] for r in contaminated(before, tables["benchmark"]).collect()}
    assert found and ids(after) == sorted(set(ids(before)) - found)
    before, after = kept["best-fit packing"]
    assert set(ids(after)) == set(ids(before))


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "piece", "start", "n_tokens", "source", "bin"] and out.count() > 100


def tables_in(folder, documents, labels, benchmark):
    for name, df in (("documents", documents), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated ids and rows, columns with clashing names."""
    rows = doc_rows()
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (2, 0, None)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, rows[0][1]), (None, None), (2, "")], "item_id long, text string")
    sf_dir = tables_in(tmp_path, sample(spark, rows, extra=True), labels, benchmark)
    columns = sample(spark, rows, extra=True).columns
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = shared_path(spark, "stage")
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    left = [r["doc_id"] for r in docs.collect()]
    assert left.count(None) == 2 and 0 not in left  # rows without id stay, the benchmark text goes
    packed = corpus_pipeline.run(spark, sf_dir)
    words = {r["doc_id"] for r in docs.where("trim(text) <> '' AND doc_id IS NOT NULL").collect()}
    assert words <= {r["doc_id"] for r in packed.collect()}


def test_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    sf_dir = tables_in(tmp_path, sample(spark, [], extra=True), labels, benchmark)
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
