from __future__ import annotations

import random

import brute
import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skywarden.llm.queries import BYTE_BPE


def test_stages_keep_what_brute_force_keeps(spark, messy_rows, tmp_path):
    docs = spark.createDataFrame(messy_rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [row for row, m in zip(messy_rows, brute.measures(messy_rows)) if m[-1]]
    rows = [row for row, c in zip(rows, brute.copies(rows)) if c[3]]
    rows = [row for row, c in zip(rows, brute.components(rows)) if c[0] == c[2]]
    whole = Tokenizer.from_file(BYTE_BPE)
    expected = {doc: n for doc, _, n, _ in brute.substring(rows)}
    untouched = {doc: len(whole.encode(text, add_special_tokens=False).ids) + 1 for doc, text in rows if not expected[doc]}

    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        step = stage(spark, step, str(tmp_path))
        assert step.dtypes == docs.dtypes
        step.write.parquet(f"{tmp_path}/{i}")
        step = spark.read.parquet(f"{tmp_path}/{i}")
    packed = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    found = {r.doc_id: r for r in packed.collect()}
    assert set(found) == set(expected)
    assert all(r.n == r["all"] for r in found.values())
    assert {d: found[d].n for d in untouched} == untouched
    assert any(expected.values())


def test_near_stage_links_five_word_shingles_from_four_fifths(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for n, changes in ((200, 4), (200, 5), (1000, 20), (1000, 23), (60, 1), (60, 2), (4, 1)):
        words = [f"n{rng.randrange(10 ** 6)}" for _ in range(n)]
        rows.append((len(rows), " ".join(words)))
        for i in range(changes):
            words[(2 * i + 1) * n // (2 * changes)] = f"x{i}"
        rows.append((len(rows), " ".join(words)))
    kept = [doc for doc, _, component in brute.components(rows, 80, 5) if doc == component]
    assert 1 not in kept and 5 not in kept and 3 in kept
    assert {1, 5} <= {doc for doc, _, component in brute.components(rows) if doc == component}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == kept
