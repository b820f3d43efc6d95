"""Toxicity: the label model on made votes, held-out accuracy, and defined cases."""

import random
import zlib

import numpy as np

from tickwise.llm import toxicity


def test_label_model_recovers_rates_and_sees_copies():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.15
    votes = np.column_stack([np.where(y, rng.random(4000) < p, rng.random(4000) < q)
                             for p, q in ((0.7, 0.02), (0.5, 0.05), (0.6, 0.01), (0.3, 0.3))])
    votes = np.column_stack([votes, votes[:, 0], votes[:, 0]])  # one voter three times
    marked = np.where(y, rng.random(4000) < 0.8, rng.random(4000) < 0.02)
    model = toxicity.LabelModel()
    post = model.fit(votes, marked)
    assert ((post >= 0.5) == y).mean() > 0.95
    assert abs(model.prior - 0.15) < 0.04
    assert abs(model.rates[1][0] - 0.7) < 0.1
    assert model.correlations[0, 4] > 0.9 > 0.4 > model.correlations[0, 1]


def made(spark, n=600):
    rng = random.Random(8)
    syllables = ["ta", "ri", "mo", "sen", "lu", "ka", "dor", "pe", "vi"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    docs, labels, truth = [], [], {}
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 150))]
        truth[i] = int(rng.random() < 0.25)
        if truth[i]:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "vexqu" + word(), "scum"])
        docs.append((i, " ".join(w), "en", "src0", "x"))
        if i % 10 < 7:
            labels.append((i, 1, truth[i] if rng.random() > 0.03 else 1 - truth[i]))
    return docs, labels, truth


def test_held_out_accuracy_and_cases(spark):
    docs, labels, truth = made(spark)
    extra = [(1000, None, "en", "s", "x"), (1001, "", "en", "s", "x"), (None, "an idiot", "en", "s", "x"), (5, docs[5][1], "", "", "x"),
             (1002, "calm " * 20000, "en", "s", "x")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, source string, score string").repartition(4)
    lab = spark.createDataFrame([*labels, (7, None, None), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(d, lab).collect()
    assert len(got) == len(docs) + len(extra)
    by_id = {r.doc_id: r for r in got}
    for i, r in by_id.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [i for i in truth if by_id[i].held_out]
    assert sum(by_id[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert by_id[1000].score == by_id[1001].score < 0.5 and by_id[1002].predicted == 0 and by_id[None].predicted == 1
    assert [r.score for r in got if r.doc_id == 5][0] == [r.score for r in got if r.doc_id == 5][1]
    kept = toxicity.drop_toxic(d, lab).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels, _ = made(spark, 200)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score string")
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(d, spark.createDataFrame(
        x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flipped))
    assert one == two


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity(d, none).collect()} == {1: 1, 2: 0}
    assert toxicity.toxicity(d.limit(0), none).count() == 0


def test_the_sample_holds_twelve_thousand_rows(spark):
    docs = spark.range(17_000).selectExpr("id as doc_id", "concat('a', id, ' b', id, ' c', id) as text")
    labels = spark.range(17_000).selectExpr("id as doc_id", "cast(id % 9 = 0 as int) as toxic")
    assert toxicity.training_rows(docs, labels).count() == 12_000
