import random
import re
from collections import Counter

from plumbline.llm import phrase_index

from .helpers import CLASHING, awkward, documents, empty

BENCH = "item_id long, text string, terms string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    out = {}
    for i, t in texts:
        w, hit, ids = split(t), set(), set()
        for item, x in items:
            v = split(x)
            n = min(13, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[k : k + n]:
                        hit |= set(range(at, at + n))
                        ids.add(str(item))
        out[i] = (len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w))
    return out


def case(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["the", "of", "é"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12, 13, 14, 30])))) for i in range(12)] + [(100, None), (101, "..."), (102, "The, OF")]
    texts = []
    for d in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            v = split(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(v) - 13))
            k = rng.randint(0, len(w))
            w[k:k] = v[a : a + rng.choice([5, 13, 20])]
        texts.append((d, rng.choice([" ", ", ", "\n"]).join(w).title()))
    return texts, items


def found(spark, texts, items, **how):
    rows = phrase_index.contamination(documents(spark, texts, CLASHING), spark.createDataFrame([(*x, "t") for x in items], BENCH), **how).collect()
    return {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows}


def test_phrases_equal_brute_force_in_one_block_and_in_many(spark):
    texts, items = case()
    expected = brute(texts, items)
    assert sum(x[1] > 0 for x in expected.values()) > 20
    assert found(spark, texts, items) == expected
    assert found(spark, texts, items, block_bytes=60) == expected


def brute_near(texts, items, terms, span):
    count = Counter(w for _, t in texts for w in split(t))
    out = {}
    for i, t in texts:
        w = split(t)
        out[i] = set()
        for item, x in items:
            some = sorted(set(split(x)), key=lambda v: (count[v], v.encode()))[:terms]
            if item is not None and some and any(set(some) <= set(w[k : k + span]) for k in range(len(w))):
                out[i].add(str(item))
    return out


def test_proximity_equals_brute_force_whatever_the_segments(spark, monkeypatch):
    texts, items = case(2)
    expected = brute_near(texts, items, 3, 6)
    assert sum(map(bool, expected.values())) > 10
    for segment, how in ((4 << 20, {}), (300, {}), (300, {"block_bytes": 60})):
        monkeypatch.setattr(phrase_index, "SEGMENT_BYTES", segment)
        rows = phrase_index.find_items(documents(spark, texts), spark.createDataFrame([(*x, "t") for x in items], BENCH), proximity=(3, 6), **how).collect()
        assert {r.doc_id: set(r.near_items) for r in rows} == expected


def test_a_stored_index_answers_a_second_test_set(spark, monkeypatch):
    monkeypatch.setattr(phrase_index, "SEGMENT_BYTES", 500)
    monkeypatch.setattr(phrase_index, "OPEN", 40)
    texts, items = case(3)
    index = phrase_index.build_index(documents(spark, texts, CLASHING))
    assert index.count() > 5
    for some in (items, items[::2]):
        rows = phrase_index.find_in(index, spark.createDataFrame([(*x, "t") for x in some], BENCH)).collect()
        whole = brute(texts, some)
        assert {r.doc_id: (sum(h.end_word - h.first_word for h in r.hits), r["items"]) for r in rows} == {i: x[1:3] for i, x in whole.items()}


def test_items_without_an_id_hit_words_but_are_not_named(spark):
    docs = documents(spark, [(1, "alpha beta gamma"), (2, "delta")])
    rows = phrase_index.contamination(docs, spark.createDataFrame([(None, "beta gamma", "t")], BENCH), proximity=(3, 5)).collect()
    assert {r.doc_id: (r.n_hit, r["items"], r.near_items, r.contaminated) for r in rows} == {1: (2, [], [], True), 2: (0, [], [], False)}


def test_only_contaminated_rows_go(spark):
    texts, items = case(4)
    docs = documents(spark, texts + [(900, None), (901, ""), (None, "clean words only")], CLASHING)
    bench = spark.createDataFrame([(*x, "t") for x in items], BENCH)
    kept = phrase_index.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in brute(texts, items).items() if not x[3]} | {900, 901, None}


def test_awkward_tables(spark):
    none = spark.createDataFrame([], BENCH)
    assert phrase_index.contamination(empty(spark), none).count() == 0
    rows = phrase_index.contamination(awkward(spark), none).collect()
    assert len(rows) == 10 and not any(r.contaminated for r in rows)
    assert phrase_index.decontaminate(awkward(spark), none).count() == 10
    odd = spark.createDataFrame([(None, None, "t"), (1, "alpha", "t"), (1, "alpha", "t")], BENCH)
    rows = phrase_index.contamination(awkward(spark), odd).collect()
    assert [r.n_hit for r in rows if r.doc_id == 1] == [1, 1]
