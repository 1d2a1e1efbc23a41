"""A training-data pipeline over ``documents``: five stages, each a table of documents for the next.

1. language ID: texts that are in no language go, each judged by statistics of other texts only; a
   null lang becomes the predicted one.
2. near-duplicates: one document of each class stays.
3. secret scans: spans of secrets are replaced by ``[secret]`` (and n_chars follows).
4. source mixing: rows are laid out in the order of the mix, by part and inside parts.
5. SentencePiece: the kept documents as pieces, (mix_position, doc_id, lang, source, n_pieces, pieces);
   mix_position counts the rows of the mix from 0, as the parts of stage 4 hold them.

No stage drops rows for any other reason. PPM, dart sketches and merge-dropout cannot be said in
SQL, so there is no SQL twin; the tests compare the stages with brute force.
"""

from __future__ import annotations

import re
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.llm import dart_minhash, merge_dropout, pfair, ppm_language, secret_ledger
from pixelquarry.session import shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ppm_language.recognised(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.survivors(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kind = docs.schema["n_chars"].dataType
    return secret_ledger.redact(docs).withColumn("n_chars", F.length("text").cast(kind))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "source", F.struct("*").alias("_row"))
    return pfair.in_order(pfair.mix(rows)).select("_row.*")


def in_written_order(docs: DataFrame) -> DataFrame:
    """Adds mix_position, the place of each row in written parts taken in turn; a reader deals parts in any order."""
    placed = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = placed.groupBy("_file").agg((F.max("_row") + 1).alias("n")).collect()  # one row a part
    before, starts = 0, []
    for r in sorted(sizes, key=lambda r: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", r["_file"])]):
        starts.append((r["_file"], before))
        before += r["n"]
    start = docs.sparkSession.createDataFrame(starts, "_file string, _start long")
    return placed.join(F.broadcast(start), "_file").withColumn("mix_position", F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return merge_dropout.with_pieces(in_written_order(docs).select("mix_position", "doc_id", "lang", "source", "text"), model).select(
        "mix_position", "doc_id", "lang", "source", F.size("pieces").cast("long").alias("n_pieces"), "pieces"
    )


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
