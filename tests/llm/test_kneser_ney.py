"""The sharded model against the one for small tables, over more trusted texts than were once counted."""

from __future__ import annotations

import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pyspark
from pyspark.sql import functions as F

from loam.llm import common, kneser_ney, quality
from loam.llm.common import Scratch


def test_all_learned_texts_are_counted(spark, monkeypatch):
    """More texts than the 2,400 that were the bound, over many chunks and shards: scores are those of all of them."""
    monkeypatch.setattr(kneser_ney, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 20_000)
    draw = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(draw.choices(words, [1 / (j + 1) for j in range(300)], k=draw.randrange(25))), None if k % 9 == 0 else "en") for k in range(4_000)]
    rows += [(4_000, None, "xx"), (4_001, " \n", "en"), (None, "w1 w2 w3 new", "en"), rows[7], (4_002, "w0 " * 9_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    learned = spark.range(3_000).select("id")
    got = kneser_ney.score(docs, learned, Scratch(spark, "test"))
    model = quality.fit_model(docs.where("doc_id < 3000 and text is not null"))
    want = {(r.doc_id, r.n_words): r.log_ppl for r in quality.score(docs, model).collect()}
    have = got.collect()
    lang = {i: x for i, _, x in rows}
    assert len(have) == len(rows) and all(r.lang == lang[r.doc_id] for r in have)
    for r in have:
        w = want[r.doc_id, r.n_words]
        assert (w is None) == (r.log_ppl is None) and abs((w or 0) - (r.log_ppl or 0)) < 1e-4
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("loam_chunks")]


def test_half_of_the_trusted_are_counted_and_the_rest_give_thresholds(spark, monkeypatch):
    """Of 6,000 trusted texts some 3,000 are learned from, not 2,400 at most."""
    seen, real = [], kneser_ney.score
    monkeypatch.setattr(kneser_ney, "score", lambda docs, learned, scratch: seen.append(learned.count()) or real(docs, learned, scratch))
    docs = spark.range(6_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id") % 7).alias("text"), F.lit("en").alias("lang"))
    got = quality.classify(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    assert 2_800 < seen[0] < 3_200 and got.where("kept").count() == 6_000


def test_few_texts_lie_on_disk_as_chunks(spark, monkeypatch):
    """Of the texts that are scored no more than a part lies in chunks at a time; with many learned ids texts meet them
    part by part, with the same scores."""
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b"), F.col("id") % 7, F.col("id") % 11).alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionAll(docs.select(F.lit(None).cast("long"), "text", "lang"))
    there, most, add, drop = {}, [], Scratch.add, Scratch.drop

    def added(self, name, df, n, by):
        out = add(self, name, df, n, by)
        if "sizes" in out.columns:
            there[name] = out.agg(F.sum(F.size("sizes"))).first()[0]
            most.append(sum(there.values()))
        return out

    monkeypatch.setattr(Scratch, "add", added)
    monkeypatch.setattr(Scratch, "drop", lambda self, *names: [there.pop(x, None) for x in names] and drop(self, *names))
    read = lambda: {(r.doc_id or r.lang, r.n_words, round(r.log_ppl, 9)) for r in kneser_ney.score(docs, spark.range(300).select("id"), Scratch(spark, "test")).collect()}
    few = read()
    assert len(few) > 900 and max(most) <= 900
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    assert read() == few


def test_memory_of_a_chunk(monkeypatch):
    """Words of 8 MB of text are found a slice at a time: less than 20 times its bytes (12), where it took 39."""
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 3))
    draw = random.Random(1)
    texts = [" ".join(draw.choices(["alpha", "beta", "gamma", "delta"], k=1_000)) for _ in range(1_400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_400)), pa.array(texts), pa.array(["en"] * 1_400)], ["doc_id", "text", "lang"])
    tracemalloc.start()
    try:
        (row,) = kneser_ney._chunks([batch])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert row.column("sizes")[0].as_py() == [1_000] * 1_400 and row.column("chunk")[0].as_py() == 3 << 32
    assert peak < 20 * batch.column("text").nbytes
