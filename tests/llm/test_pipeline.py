"""The pipeline stage by stage on the smallest tables, each against a plain version of its own decision."""

import os
import random
import zlib
from collections import defaultdict
from urllib.parse import urlparse

import pytest

import corpus_pipeline
from plumbline.llm import toxicity

from ..conftest import DATA
from .test_phrase_index import brute

from .test_simhash import brute_print, closure

SF = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the tables are not here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], str(SF)).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(d.columns == columns for d in kept[:5])
    rows = [{(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()} for d in kept[:5]]
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    rejected = {r.doc_id for r in toxicity.with_scores(docs, model).where("predicted = 1").collect()}
    assert rows[1] == {x for x in rows[0] if x[0] not in rejected}
    prints = {i: brute_print(t) for i, t in rows[1]}
    groups = closure(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {i for i, _ in rows[2]} == set(groups.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = brute(sorted(rows[2]), items)
    assert {i for i, _ in rows[3]} == {i for i, x in leaked.items() if not x[3]}
    before = dict(rows[3])
    assert all(set(t.split()) <= set(before[i].split()) for i, t in rows[4])
    last = kept[5].collect()
    assert len(last) == kept[4].count()
    bytes_of, slots = defaultdict(int), defaultdict(list)
    for r in last:
        bytes_of[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(bytes_of) <= set(range(40))
    crcs = {(i, zlib.crc32(t.encode())) for i, t in rows[4]}
    assert {(r.doc_id, r.text_crc32) for r in last} == crcs
    assert sorted((r.doc_id, r.text) for r in last) == sorted((r.doc_id, r.text) for r in kept[4].select("doc_id", "text").collect())


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, str(SF))
    assert set(out.columns) == {"doc_id", "text", "size", "text_crc32", "shard", "slot", "lang", "source", "n_chars"}
    (at,) = {os.path.dirname(urlparse(f).path) for f in out.inputFiles()}
    assert os.listdir(os.path.dirname(at)) == ["4"]


CLASHING = "doc_id long, text string, source string, score string, _row string, _key string, shard string, predicted string, text_key string, m map<string,int>"


def through(spark, tmp_path, rows):
    """What each stage leaves of ``rows``, with every column compared by doc_id."""
    docs = spark.createDataFrame(rows, CLASHING)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(SF)).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        assert after.columns == docs.columns if k < 4 else after.columns == [*docs.columns[:6], "shard_input", *docs.columns[7:], "size", "text_crc32", "shard", "slot"]
        docs = after
    return docs.collect()


def test_clashing_columns_and_awkward_rows(spark, tmp_path):
    def row(i, text, source="a"):
        return (i, text, source, f"s{i}", f"r{i}", f"k{i}", f"h{i}", f"p{i}", f"t{i}", {"i": i or 0})

    rng = random.Random(2)
    long = " ".join("".join(rng.choice("bcdfgh") + rng.choice("aiou") for _ in range(4)) for _ in range(20_000))
    texts = [" ".join("".join(rng.choice("bcdfgh") + rng.choice("aiou") for _ in range(3)) for _ in range(rng.randint(100, 300))) for _ in range(30)]
    rows = [row(i, t, "ab"[i % 2]) for i, t in enumerate(texts)] + [row(3, texts[3], "b")] * 2 + [row(100, None), row(101, ""), row(None, long, None), row(102, None, None)]
    out = through(spark, tmp_path, rows)
    assert {r.doc_id for r in out} == {*range(30), None}  # what holds no words ends in the mix
    for r in out:
        i = r.doc_id
        assert (r.score, r["_row"], r["_key"], r.shard_input, r.predicted, r.text_key, r.m) == (f"s{i}", f"r{i}", f"k{i}", f"h{i}", f"p{i}", f"t{i}", {"i": i or 0})
        assert r.text and r.size == len(r.text.encode()) + 16 and 0 <= r.shard < 40


def test_an_empty_table(spark, tmp_path):
    assert through(spark, tmp_path, []) == []
