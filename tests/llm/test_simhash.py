import random
import re

import pytest
import xxhash

from plumbline.llm import components, simhash

from .helpers import awkward, documents, empty


def brute_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_prints_equal_spark_hash_and_brute_force(spark):
    texts = ["a b c d", "A B c", "one", "", None, "x y z   é É", "a b c a b c a b c", "w " * 500]
    rows = simhash.fingerprints(documents(spark, list(enumerate(texts)))).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in rows} == {i: brute_print(t) for i, t in enumerate(texts)}
    assert spark.sql("select xxhash64('a b c') as h").first().h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("cap", [64, 2])
def test_links_leave_the_components_of_all_pairs(spark, cap):
    rng = random.Random(cap)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(10):
            base ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(base)
    prints |= {rng.getrandbits(64) for _ in range(50)} | {0, 1, 3, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(s, s) for s in signed], "node long, fp long")
    edges = [(r.a, r.b) for r in simhash.links(table, cap).collect()]
    mask = (1 << 64) - 1
    expected = closure(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2])
    assert closure(signed, edges) == expected
    found = {r.node: r.component for r in components.connected_components(simhash.links(table, cap)).collect()}
    assert all(expected[n] == found.get(n, n) for n in signed)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 9)] + [(50, 50), (7, 200), (200, 201), (201, 7), (None, 3)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 100 for i in range(100, 141)) and all(found[i] == 0 for i in (*range(9), 200, 201)) and found[50] == 50


def test_one_document_of_each_group_stays(spark):
    text = "the quick brown fox jumps over the lazy dog and runs into the dark wood at night"
    rows = [(5, text), (3, text), (3, text), (9, text.upper()), (4, "something else entirely with other words in it"), (8, None), (7, ""), (None, "all alone here with no id at all")]
    docs = documents(spark, rows)
    near = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert near == {(5, 3), (3, 3), (9, 3), (4, 4), (8, 7), (7, 7), (None, None)}
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, text), (4, rows[4][1]), (7, ""), (None, rows[7][1])], key=str)


def test_awkward_tables(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_representatives(empty(spark)).count() == 0
    assert simhash.near_duplicates(awkward(spark)).count() == 10
    assert simhash.keep_representatives(awkward(spark)).columns == awkward(spark).columns
