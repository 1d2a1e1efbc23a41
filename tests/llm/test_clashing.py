"""Every operator on tables with many columns of clashing names, and the twins on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from pixelquarry.llm import chat, dart_minhash, merge_dropout, merkle, pfair, ppm_language, prefix_trie, quality_llr, queries, secret_ledger, simhash, token_fst, topk, toxic_crf
from pixelquarry.session import table

SF = "/root/testdata/sf0.001"
NAMES = """a b at bare base below bit block blob bucket class_id component content count digest due depth end fingerprint first found grp h hub id ids keep kept key keys
    label last lead level node n number of own pairs part path place pos prefix rank rep root row rows said score seen side size slot spans start tail turn_no unit up value weight word words""".split()


def ordered(df):
    return sorted((str(r.asDict()) for r in df.collect()))


def wide(df):
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(NAMES) if c not in have])


OPERATORS = {
    "language": lambda d, t: ppm_language.language_id(d),
    "recognised": lambda d, t: ppm_language.recognised(d).select("doc_id", "text", "lang", "source", "n_chars"),
    "mix": lambda d, t: pfair.mix(d).select("doc_id", "source", "rank", "slot", "mix_position"),
    "near": lambda d, t: dart_minhash.near_duplicates(d).select("doc_id", "class_id"),
    "quality": lambda d, t: quality_llr.quality_llr(d, t("labels")),
    "dropout": lambda d, t: merge_dropout.round_trip(d, public_tokenizers.path("piece_bpe_32k.model")),
    "tokens": lambda d, t: token_fst.token_counts(d, public_tokenizers.path("word_bpe_49k.json")),
    "secrets": lambda d, t: secret_ledger.redact(d).select("doc_id", "text", "lang"),
    "toxicity": lambda d, t: toxic_crf.toxicity(d, t("labels")).select("doc_id", "held_out", "predicted"),
    "simhash": lambda d, t: simhash.near_duplicates(d),
    "merkle": lambda d, t: merkle.manifest(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents_with_clashing_columns(spark, name):
    docs = table(spark, SF, "documents")
    plain = OPERATORS[name](docs, lambda t: table(spark, SF, t))
    clashing = OPERATORS[name](wide(docs), lambda t: wide(table(spark, SF, t)))
    assert ordered(clashing) == ordered(plain)


def test_conversations_and_vectors_with_clashing_columns(spark):
    talks, vectors = table(spark, SF, "conversations"), table(spark, SF, "embeddings")
    for run in (
        lambda t: chat.digest(chat.format_conversations(t)), lambda t: prefix_trie.trie(prefix_trie.prefixes(t)),
    ):
        assert ordered(run(wide(talks))) == ordered(run(talks))
    top = lambda t: topk.exact_topk(t, F.col("vec_id") % 100 == 0, k=3)
    assert ordered(top(wide(vectors))) == ordered(top(vectors))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)

    def rows(df):
        return sorted(tuple("NULL" if pd.isna(v) else str(v) if isinstance(v, (str, bool)) else str(float(v)) for v in r) for r in df[columns].astype(object).itertuples(index=False, name=None))

    assert rows(ours) == rows(theirs)
