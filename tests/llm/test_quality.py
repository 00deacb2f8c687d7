import numpy as np

from staveframe.llm import quality


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.85
    chance = np.array([[0.7, 0.01], [0.5, 0.02], [0.4, 0.01], [0.6, 0.03]])
    votes = np.ones((len(good), len(quality.LABELLERS)), dtype=np.int64)
    votes[:, 4:] = 0
    for j in range(4):
        votes[:, j] = np.where(rng.random(len(good)) < np.where(good, chance[j, 1], chance[j, 0]), -1, 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.LabelModel(patterns, counts.astype(float))
    assert abs(model.good - 0.85) < 0.03 and np.abs(model.bad[:4] - chance).max() < 0.06
    assert ((model.posterior(votes) > 0.5) == good).mean() > 0.95


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id: r.keep for r in quality.score(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "keep").collect()}
    good, bad = [k for k in labels if labels[k]], [k for k in labels if not labels[k]]
    assert sum(kept[k] for k in good) >= 0.99 * len(good)
    assert sum(not kept[k] for k in bad) >= 0.9 * len(bad)


def test_odd_rows(docs, empty, rows):
    got = quality.score(docs).select("doc_id", "text", "score", "keep").collect()
    assert len(got) == len(rows) and all(r.keep for r in got if not (r.text or "").strip())
    assert quality.score(empty).count() == 0


def test_same_scores_however_rows_are_dealt(spark):
    """Labels, sample and scorer depend on the rows alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = quality.fit_labels(docs)
    first, second = (quality.fit_scorer(d, labels, fit_rows=300) for d in (docs, docs.repartition(7)))
    assert np.abs(first[0] - second[0]).max() < 1e-6 and abs(first[1] - second[1]) < 1e-6
