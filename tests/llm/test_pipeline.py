"""The pipeline's stages against brute force, on small tables."""

import base64
import collections
import math
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pixelquarry.llm import pfair, ppm_language, secret_ledger
from pixelquarry.session import table
from tests.llm.test_operators import classes, spans


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    given = {r.doc_id: r for r in docs.collect()}
    kept = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == set(given)
    single = corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir)
    stay = {r.doc_id for r in single.collect()}
    assert single.columns == docs.columns and stay == set(classes(sorted((i, r.text) for i, r in given.items())).values())
    clean = corpus_pipeline.redact_secrets(spark, single, sf_dir)
    after = {r.doc_id: r for r in clean.collect()}
    assert clean.schema["n_chars"].dataType == docs.schema["n_chars"].dataType and after.keys() == stay
    for i, r in after.items():
        if not spans(given[i].text):
            assert r.text == given[i].text
        else:
            assert "[secret]" in r.text and not any(re.search(x.pattern, r.text) for x in secret_ledger.RULES[1:])
        assert r.n_chars == len(r.text)
    mixed = corpus_pipeline.mix_sources(spark, clean, sf_dir)
    assert mixed.columns == docs.columns and sorted(map(tuple, mixed.collect())) == sorted(map(tuple, clean.collect()))
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.collect()} == stay and out.where("n_pieces <> size(pieces) or n_pieces = 0").count() == 0


def test_noise_goes_at_any_table_size(spark):
    """Noise with letters goes whether or not it is labelled, has an id, or is repeated."""
    rng = np.random.default_rng(7)
    noise = [base64.b64encode(rng.bytes(2250)).decode() for _ in range(4)]
    ids, langs, picks = [-1, -2, None, -3, -4], ["en", None, "en", "de", "de"], [0, 1, 2, 3, 3]
    for sf in ("sf0.001", "sf0.01"):
        docs = table(spark, f"/root/testdata/{sf}", "documents")
        clean = {r.doc_id for r in docs.select("doc_id").collect()}
        bad = spark.createDataFrame([(i, noise[k], v) for i, v, k in zip(ids, langs, picks, strict=True)], "doc_id long, text string, lang string")
        given = docs.unionByName(bad, allowMissingColumns=True)
        kept = corpus_pipeline.identify_language(spark, given, "")
        assert kept.columns == docs.columns and sorted(r.doc_id if r.doc_id is not None else 0 for r in kept.collect()) == sorted(clean)
    sampled = ppm_language.recognised(given, docs_per_lang=50)
    assert {r.doc_id for r in sampled.collect()} == clean


def test_mix_order_reaches_the_result(spark, tmp_path):
    """Any prefix by mix_position is less than a block a source away from the weights, though the last part is read first."""
    rows = [(i, "w " * (2000 if i % 3 else 1), "en", "abc"[min(i % 7, 2)], 1) for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = pfair.mix(docs.select("doc_id", "source", F.struct("*").alias("_row")))
    # parts of 300 positions, the last one the largest
    pfair.in_order(mixed, rows_per_part=300).select("_row.*").withColumn(
        "text", F.when(F.spark_partition_id() >= 4, F.concat("text", F.sha2("text", 256), F.repeat(F.uuid(), 50))).otherwise(F.col("text"))
    ).write.parquet(f"{tmp_path}/mix")
    read = spark.read.parquet(f"{tmp_path}/mix")
    assert [r.doc_id for r in read.collect()] != [r.doc_id for r in mixed.orderBy("mix_position").collect()]
    got = corpus_pipeline.encode_pieces(spark, read, "").orderBy("mix_position").select("mix_position", "doc_id", "source").collect()
    assert [r.mix_position for r in got] == list(range(1400))
    assert [r.doc_id for r in got] == [r.doc_id for r in mixed.orderBy("mix_position").collect()]
    counts = collections.Counter(r.source for r in got)
    weights = pfair.default_weights(counts)
    seen, first = collections.Counter(), min(k for k in range(1, 1401) if max(collections.Counter(r.source for r in got[:k])[x] - counts[x] for x in counts) == 0)
    for n, r in enumerate(got[:first], 1):  # then a source has run out and the weights are scaled
        seen[r.source] += 1
        assert all(abs(seen[k] - n * w / sum(weights.values())) < 1 for k, w in weights.items()), n
    assert first > 400


def test_awkward_tables(spark):
    """Null and empty texts, repeated rows, null ids and columns, further columns with names that operators use, empty tables."""
    long = " ".join(f"the word of number {i} is said" for i in range(3000))
    rows = [
        (1, "the house and the garden of the neighbour", "en", "a", 41), (1, "the house and the garden of the neighbour", "en", "a", 41), (None, "la maison de la ville est grande", None, None, None),
        (2, None, "en", "a", None), (3, "", "en", None, 0), (4, long, None, "b", len(long)), (5, "password = hunter2hunter2 and more words to say", "en", "b", 1), (6, "12345", None, "b", 5),
        (None, "un autre texte sans numero et sans nom", "fr", "c", 3),
    ]
    clash = ["score", "rank", "node", "class_id", "digest", "pieces", "blob", "_blob", "_spans", "spans", "slot", "block", "row", "seen", "id", "mix_position", "component", "_key", "_rank"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.select("*", *[F.lit("mine").alias(c) for c in clash])
    for given in (docs, wide):
        out = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, "")
            assert out.columns == given.columns, name
        kept = out.collect()
        assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "5", "None", "None"]
        assert next(r.text for r in kept if r.doc_id == 5) == "[secret] and more words to say" and all(r.lang for r in kept)
        assert given is docs or {r[c] for r in kept for c in clash} == {"mine"}
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, given.limit(0), "").count() == 0


def test_run_on_empty_and_repeated_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "it is the same text of words again and again"
    for k, rows in enumerate(([], [(9, text, "en", "a", 1)] * 40 + [(None, None, None, None, None)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        assert [(r.mix_position, r.doc_id) for r in got] == [(0, 9)][: len(set(rows)) // 2]
