"""The label model against a simulation, and the whole against held-out labels."""

from __future__ import annotations

import numpy as np

from ebbline.llm import classifier as c


def test_em_recovers_how_labellers_vote():
    rng = np.random.default_rng(1)
    n, m = 40_000, len(c.LABELLERS)
    truth = rng.random(n) < 0.7
    rates = np.empty((m, 2, 3))
    for j in range(m):
        right, nothing = rng.uniform(0.6, 0.9), rng.uniform(0.0, 0.3)
        rates[j] = [[right * (1 - nothing), nothing, (1 - right) * (1 - nothing)], [(1 - right) * (1 - nothing), nothing, right * (1 - nothing)]]
    cum = rates.cumsum(2)[:, truth.astype(int)]
    votes = (rng.random((m, n, 1)) > cum).sum(2).T.clip(0, 2)
    code, counts = np.unique((votes * 3 ** np.arange(m)).sum(1), return_counts=True)
    model = c.LabelModel.fit(code, counts)
    assert abs(model.good - 0.7) < 0.02 and np.abs(model.rates - rates).max() < 0.03
    found = model.posterior[(votes * 3 ** np.arange(m)).sum(1)] > 0.5
    majority = (votes - 1).sum(1) > 0
    assert (found == truth).mean() >= (majority == truth).mean() > 0.8


def test_votes_on_plain_cases():
    by = lambda text: dict(zip(c.LABELLERS, c.votes(text)))
    assert by(None) == by("") == by(" \n") and by("")["length"] == -1
    good = by("The house of the old man is in the town. It was built by a carpenter for his two children. " * 3)
    assert min(v for k, v in good.items() if k not in ("repeats", "length")) >= 0
    assert by("WORD!! OTHER!! LOUD!! " * 30)["capitals"] == -1
    assert by("same same same same " * 30)["repeats"] == by("same " * 90)["variety"] == -1
    junk = by("word*** other$$$ more%%% " * 30)
    assert junk["symbols"] == junk["letters"] == junk["plain_words"] == -1


def test_held_out_accuracy(spark):
    from ebbline.llm.queries import queries

    folder = "/root/testdata/sf0.01"
    rows = queries()["op1_quality_classifier"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    pairs = [(r.quality, r.kept) for r in rows.join(labels, "doc_id").collect()]
    assert rows.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert np.mean([bool(q) == k for q, k in pairs]) > 0.95
    assert np.mean([k for q, k in pairs if q]) > 0.97 and np.mean([not k for q, k in pairs if not q]) > 0.7


def test_defined_results(spark):
    docs = spark.createDataFrame(
        [(1, "a word or two", 1), (1, "a word or two", 2), (None, None, 3), (4, "", 4)], "doc_id long, text string, score int"
    )
    rows = c.classify(docs).collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 1, 4] and all(0 <= r.score <= 1 for r in rows)
    models = c.fit(docs)
    again = c.classify(docs, models=models).collect()
    assert [(r.doc_id, r.score) for r in again] == [(r.doc_id, r.score) for r in rows]
    assert c.classify(docs.limit(0)).count() == 0
