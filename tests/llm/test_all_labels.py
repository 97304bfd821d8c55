import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_engine.llm import quality
from evidence_engine.llm.common import keyed


@pytest.mark.parametrize("sent", [quality.SENT_LABELS, 100])
def test_every_label_counts(spark, monkeypatch, sent):
    """More labelled documents than were once sampled: the model is that of all of them."""
    monkeypatch.setattr(quality, "SENT_LABELS", sent)
    n, bits = 20_400, 10
    rows = [(i, f"w{i % 97} v{i % 89} {'fine' if i % 3 else 'poor'} u{i % 1013}", int(i % 3 > 0)) for i in range(n)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    ratio, threshold = quality.fit(keyed(docs), labels, bits)

    def logs(texts):
        total = np.full(1 << bits, 0.5)
        for tokens in quality.token_hashes([t.encode() for t in texts]):
            np.add.at(total, quality.grams(tokens, bits), 1)
        return np.log(total / total.sum())

    expected = logs([r[1] for r in rows if r[2]]) - logs([r[1] for r in rows])
    assert np.array_equal(ratio, expected)
    scores = quality.scores_of([r[1].encode() for r in rows], expected, bits)
    assert threshold == quality.best_threshold(np.array(scores), np.array([r[2] > 0 for r in rows]))


def test_threshold_in_ranges(spark, monkeypatch):
    random = np.random.default_rng(5)
    for n, ranges in ((1, 4), (7, 4), (900, 7), (900, 200)):
        monkeypatch.setattr(quality, "RANGES", ranges)
        for shift in (-0.4, 0.0, 0.4):
            good = random.random(n) < 0.6
            scores = np.round(random.normal(size=n) + shift * good, 2)
            table = spark.createDataFrame(list(zip(scores.tolist(), good.tolist())), "score double, good boolean")
            counted = table.groupBy("score").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
            assert quality.threshold_of(counted) == quality.best_threshold(scores, good)
