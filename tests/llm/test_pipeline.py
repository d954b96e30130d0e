"""The pipeline on a small table against plain Python, stage by stage."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from corpuscle.llm import mixing, toxicity

from .test_dedup import slow_groups, slow_simhash


def test_stages(spark, tmp_path):
    rows = [(k, f"word{k % 40} some more text number {k % 60} goes here and ends", "en", f"s{k % 3}", 10) for k in range(120)]
    rows += [(500, None, "en", "s1", 0), (501, "", "en", "s1", 0), (502, rows[0][1].upper(), "en", "s2", 0)]
    rows += [(600 + k, f"this is nasty stuff {k} nasty", "en", "s0", 0) for k in range(40)]
    labels = [(r[0], int(r[0] >= 600), 1) for r in rows]
    sf = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, function in corpus_pipeline.STAGES:
        before = docs
        docs = function(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        seen.append((before.collect(), docs.collect()))
    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(spark.createDataFrame(seen[0][0]), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert {r.doc_id for r in seen[0][1]} == {i for i, p in scores.items() if not p}
    assert not {r.doc_id for r in seen[0][1]} & set(range(600, 640))
    largest = {}
    for r in seen[1][0]:
        largest[r.text or ""] = max(largest.get(r.text or "", -1), r.doc_id)
    assert {r.doc_id for r in seen[1][1]} == set(largest.values())
    groups = slow_groups([r.doc_id for r in seen[2][0]], [slow_simhash(r.text) for r in seen[2][0]])
    assert {r.doc_id for r in seen[2][1]} == set(groups.values())
    chars: dict = {}
    for r in seen[3][0]:
        chars[r.source] = chars.get(r.source, 0) + len(r.text or "")
    weights = {s: c**mixing.TEMPERATURE for s, c in chars.items() if c}
    expected = 0
    for r in seen[3][0]:
        rate = weights[r.source] / sum(weights.values()) * sum(chars.values()) / chars[r.source]
        u = int(hashlib.md5(f"{mixing.SEED}|{r.doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        expected += sum(c <= u for c in mixing.poisson_cdf(rate))
    assert len(seen[3][1]) == expected
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in seen[4][1]) == sum(len(tokenizer.encode(r.text or "").ids) + 1 for r in seen[4][0])
    assert corpus_pipeline.run(spark, sf).count() == len(seen[4][1])


def test_last_stage_holds_the_ids(spark):
    """The table that training reads: whole sequences of token ids, not their places alone."""
    docs = spark.createDataFrame([(k, f"text {k} " * 300) for k in range(20)] + [(20, None)], "doc_id long, text string")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = corpus_pipeline.pack(spark, docs, "").collect()
    assert all(len(r.ids) == 1024 and not any(r.ids[r.length :]) for r in found)
    assert sorted(x for r in found for x in r.ids[: r.length]) == sorted(x for d in docs.collect() for x in [*tokenizer.encode(d.text or "").ids, 0])


def test_pipeline_on_nothing_and_odd_rows(spark, tmp_path):
    """Empty tables give no rows; null ids, sources and texts and rows that repeat go through every stage."""
    schema, marks = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, toxic int, quality int"
    odd = [(None, "a text without an id", None, None, 20), (None, "a text without an id", None, None, 20), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "words of a text " * 40, "en", None, 600), (3, "words of a text " * 40, "en", None, 600)]
    for name, rows, labels in (("none", [], []), ("odd", odd, []), ("marked", odd, [(3, 0, 1), (None, None, None), (3, 0, 1)])):
        sf = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(labels, marks).write.parquet(f"{sf}/labels.parquet")
        found = corpus_pipeline.run(spark, sf).collect()
        assert bool(found) == bool(rows) and all(len(r.ids) == 1024 for r in found)
