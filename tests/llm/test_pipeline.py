import corpus_pipeline
from staveframe.llm import jaccard, line_dedup


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            after = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
            assert set(after) <= set(before)
            if name == "quality":
                assert all(after[i] == before[i] for i in after)
            if name == "lines":
                assert set(after) == set(before)
                gone = {k for t in before.values() for k in map(line_dedup.line_key, (t or "").split("\n")) if k}
                assert gone
            if name == "near duplicates":
                kept = {r.doc_id for r in jaccard.join(docs).where("kept").collect()}
                assert set(after) == kept
            if name == "secrets":
                assert set(after) == set(before)
            docs = out.cache()
        else:
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(before)


def test_run_and_odd_rows(spark, docs, empty, tmp_path):
    from pyspark.sql import functions as F

    for k, table in enumerate((docs, empty)):
        path = f"{tmp_path}/{k}"
        table.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{path}/documents.parquet")
        assert corpus_pipeline.run(spark, path).count() >= (5 if k == 0 else 0)
