import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import toxicity

from .helpers import awkward, documents, empty

INSULTS = ["blockhead", "dimwit", "nitwit", "scoundrel"]


def brute_kernel(s, t, p=3, decay=0.7):
    total = 0.0
    for a in combinations(range(len(s)), p):
        for b in combinations(range(len(t)), p):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


@pytest.mark.parametrize("landmark", ["^idiot$", "abcab", "zzz"])
def test_kernel_equals_enumeration(landmark):
    some = ["idiot", "^idiot$", "i.d.i.o.t", "abcabc", "", "zz", "zzzz", "unrelated"]
    assert toxicity.kernel(some, landmark) == pytest.approx([brute_kernel(s, landmark) for s in some])


def test_common_length():
    words = ["idiot", "idxiot", "toidi", "zzzzz", "iot"]
    codes = np.array([[ord(w[i]) if i < len(w) else 0 for w in words] for i in range(6)], np.int32)
    assert toxicity.common_length(codes, "idiot").tolist() == [5, 5, 3, 0, 3]


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ne", "tu", "ra", "so", "vi", "pe", "du"]
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 90))]
        toxic = rng.random() < 0.25
        for _ in range(rng.randint(2, 3) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        rows.append((i, ". ".join(" ".join(w[k : k + 8]) for k in range(0, len(w), 8))))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_changed_insults(spark):
    rows, labels = corpus()
    changed = {1000: "kalo mine blockxhead tura dimwwit soviso", 1001: "kalo n i t w i t mine b.l.o.c.k.h.e.a.d tura", 1002: "kalo mine tura soviso pedu"}
    found = {r.doc_id: r for r in toxicity.toxicity(documents(spark, rows + list(changed.items())), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    truth = dict(labels)
    held = [i for i in truth if found[i].held_out]
    assert 40 < len(held) < 120
    assert sum(found[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    assert found[1000].predicted and found[1001].predicted and not found[1002].predicted


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = corpus(120)
    docs = documents(spark, rows)
    plain = spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = plain.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.training_rows(docs, plain) == toxicity.training_rows(docs, flipped)


def test_awkward_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(empty(spark), none).count() == 0
    rows = toxicity.toxicity(awkward(spark), none).collect()
    assert len(rows) == 10 and not any(r.predicted for r in rows)
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 0), (5, 0), (99, 1), (2, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(awkward(spark), odd).count() == 10


def test_input_columns_stay(spark):
    docs = documents(spark, [(1, "fine words here"), (2, "you dimwit")], "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string")
    rows = [(f"calm text number {k} about trees", 0) for k in range(60)] + [(f"you dimwit number {k}, go", 1) for k in range(60)]
    model = toxicity.fit(rows)
    scored = toxicity.with_scores(docs, model)
    assert scored.columns == ["doc_id", "text", "lang", "source", "n_chars", "score_input", "predicted_input", "score", "predicted", "worst_sentence"]
    assert {(r.doc_id, r.score_input, r.predicted) for r in scored.collect()} == {(1, "x", 0), (2, "x", 1)}
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and [(r.doc_id, r.score, r.predicted) for r in kept.collect()] == [(1, "x", "x")]


def test_training_texts_are_bounded_in_bytes(spark):
    docs = documents(spark, [(i, "x" * (100 * (i % 5 + 1))) for i in range(200)])
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    some = toxicity.training_rows(docs, labels, limit_bytes=2000)
    assert all(1500 < sum(len(t) for t, x in some if x == label) <= 2000 for label in (0, 1))
    every = toxicity.training_rows(docs, labels)
    assert set(some) <= set(every) and len(every) > len(some)
