"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.llm import chat, dart_minhash, merge_dropout, merkle, pfair, ppm_language, prefix_trie, quality_llr, secret_ledger, simhash, token_fst, topk, toxic_crf
from pixelquarry.llm.ppm_language import fold
from pixelquarry.session import table


def op1_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a fifth of the ids teaches nothing."""
    return ppm_language.language_id(table(spark, sf_dir, "documents"))


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix, with square-root weights of the sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair.mix(docs).select("doc_id", "source", "rank", "block", "release", "deadline", "slot", "mix_position")


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op4_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts, log-likelihood ratio and verdict of every document."""
    return quality_llr.quality_llr(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with merge-dropout and decoded again."""
    return merge_dropout.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the compiled transducer."""
    return token_fst.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, over a history of two scans.

    The first scan sees one half of the documents; the second sees all of them and looks only at blobs
    that the first has not seen, and the findings of both are joined to all documents.
    """
    documents = table(spark, sf_dir, "documents")
    _, ledger = secret_ledger.scan(documents.where(fold(parts=2) == 0), ["doc_id"])
    paths, ledger = secret_ledger.scan(documents, ["doc_id"], ledger=ledger)
    return secret_ledger.digest(secret_ledger.findings(paths, ledger))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and one that says the template's control strings."""
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    says = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(given.unionByName(own)))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of every vector whose id is divisible by 100."""
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the labels of a quarter of the ids teach nothing."""
    return toxic_crf.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with the first turns of the first one of its hundred."""
    conv_id = F.col("conv_id")
    rows = prefix_trie.prefixes(table(spark, sf_dir, "conversations"), base=conv_id - conv_id % 100, heads=fold("conv_id", parts=6), most_heads=5)
    return prefix_trie.trie(rows)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what its tampered or original leaf folds to."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """DuckDB: the spans of one kind, from the pieces between its matches."""
    return f"""
  SELECT blob, {rank} AS rank, '{kind}' AS kind, pos AS start_, pos + length(hit) AS finish FROM (
    SELECT blob, hit, part, before + list_sum(list_transform(pieces[:i], lambda p: length(p)))::BIGINT AS pos FROM (
      SELECT blob, i, hits[i] AS hit, parts[i] AS part, pieces,
             coalesce(list_sum(list_transform(hits[:i-1], lambda h: length(h))), 0)::BIGINT AS before
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT blob, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS parts,
               string_split_regex(text, '{pattern}') AS pieces
        FROM blobs WHERE regexp_matches(text, '{pattern}'))))
  ) WHERE length(part) >= {least}"""


def _op7_sql() -> str:
    found = "\n  UNION ALL".join(
        _spans_sql(r.kind, i, r.pattern.replace("'", "''"), r.group, r.least) for i, r in enumerate(secret_ledger.RULES)
    )
    base = "kind IN ('assign', 'access', 'hex')"
    joined = "string_agg(kind || ':' || start_ || ':' || finish, ',' ORDER BY start_, rank)"
    return f"""
WITH docs AS (SELECT doc_id, sha256(coalesce(text, '')) AS blob, coalesce(text, '') AS text FROM documents),
blobs AS (SELECT blob, any_value(text) AS text FROM docs GROUP BY blob),
found AS ({found}),
per_blob AS (
  SELECT blob, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, {joined} FILTER ({base}) AS base, {joined} AS spans
  FROM found GROUP BY blob)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per_blob USING (blob)
"""


CRC_TABLE = """crc AS (
  SELECT list(c ORDER BY i) AS crc_table FROM (
    SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(0, 256) t(i)))"""


def _crc32(text: str) -> str:
    """DuckDB: crc32 of an ASCII text by the table ``crc_table``."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda k: ord(({text})[k])::BIGINT)"
    return f"xor(4294967295, list_reduce({codes}, lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"


def _op13_sql() -> str:
    def field(name: str) -> str:
        return f"coalesce(strlen(({name})::VARCHAR) || ':' || ({name})::VARCHAR, '-')"

    def leaf(n_chars: str) -> str:
        return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"

    def levels(name: str, bottom: str) -> str:
        return f"""{name}(level, grp, pos, h, n) AS (
  SELECT 0, grp, pos, h, n FROM {bottom}
  UNION ALL
  SELECT any_value(level) + 1, grp, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY grp, pos // 2
)"""

    def carried(name: str, begin: str, tree: str) -> str:
        return f"""{name}(id, level, grp, pos, n, cur, proof) AS (
  SELECT id, 0, grp, pos, n, cur, proof FROM {begin}
  UNION ALL
  SELECT f.id, f.level + 1, f.grp, f.pos // 2, (f.n + 1) // 2,
    CASE WHEN f.pos % 2 = 0 THEN sha256(f.cur || coalesce(s.h, '')) ELSE sha256(s.h || f.cur) END, f.proof || coalesce(s.h, '')
  FROM {name} f LEFT JOIN {tree} s ON s.level = f.level AND s.grp = f.grp AND s.pos = xor(f.pos, 1) WHERE f.n > 1
)"""

    return f"""
WITH RECURSIVE {CRC_TABLE},
given AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {leaf('n_chars')} AS leaf,
    CASE WHEN coalesce({_crc32('doc_id::VARCHAR')} % 7 = 0, false) THEN {leaf('n_chars + 1')} ELSE {leaf('n_chars')} END AS cur
  FROM documents, crc
), bottom AS (
  SELECT *, leaf AS h, '' AS proof, row_number() OVER () AS id, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY grp) AS n
  FROM given
), {levels('lower_levels', 'bottom')},
subroots AS (SELECT grp AS of_grp, h, '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM lower_levels WHERE n = 1),
{levels('upper_levels', 'subroots')},
{carried('lower_fold', 'bottom', 'lower_levels')},
middle AS (SELECT f.id, s.grp, s.pos, s.n, f.cur, f.proof FROM lower_fold f JOIN subroots s ON f.grp = s.of_grp WHERE f.n = 1),
{carried('upper_fold', 'middle', 'upper_levels')},
top AS (SELECT h AS root FROM upper_levels WHERE n = 1)
SELECT b.doc_id, b.leaf, s.h AS subroot, root, sha256(f.proof) AS proof_sha256, f.cur AS folded_root, f.cur = root AS verified
FROM bottom b JOIN subroots s ON b.grp = s.of_grp JOIN upper_fold f ON f.id = b.id AND f.n = 1, top
"""


OP11_SQL = f"""
WITH {CRC_TABLE},
turns AS (
  SELECT conv_id::BIGINT AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS i, x, size
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, length(coalesce(text, ''))::BIGINT AS size
        FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (SELECT c, c - c % 100 AS base, {_crc32("c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT c FROM turns), crc),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, x, size FROM (
    SELECT convs.c, 0 AS own, i, x, size FROM convs JOIN turns ON turns.c = base AND i <= h
    UNION ALL SELECT c, 1, i, x, size FROM turns JOIN convs USING (c) WHERE i > h)
), chains AS (
  SELECT c, 0 AS d, '' AS node, NULL AS up, 0 AS size FROM convs
  UNION ALL SELECT c, d, string_agg(x, '') OVER w, coalesce(string_agg(x, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), size
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)
), marked AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS last FROM chains),
nodes AS (
  SELECT node, any_value(up) AS up, min(c) AS c, any_value(d) AS d, count(*) AS n, any_value(size) AS size,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends
  FROM marked GROUP BY node
), children AS (SELECT up AS node, count(*) AS k FROM nodes WHERE d > 0 GROUP BY up),
full_nodes AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN children USING (node)),
below AS (
  SELECT m.node, count(*) FILTER (x.k = 0) AS leaves, sum((x.n - 1) * x.size) AS saved
  FROM full_nodes x JOIN marked m ON m.c = x.c AND m.d <= x.d GROUP BY m.node
)
SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.k::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_nodes f JOIN below USING (node) LEFT JOIN nodes p ON f.up = p.node AND f.d > 0
"""

OP9_SQL = """
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    length(regexp_replace(regexp_replace(replace(role, '\\', '\\\\'), '<(/?s>)', '__\\1', 'g'), '\\[(/?INST\\])', '__\\1', 'g')) AS role_chars,
    length(regexp_replace(regexp_replace(replace(text, '\\', '\\\\'), '<(/?s>)', '__\\1', 'g'), '\\[(/?INST\\])', '__\\1', 'g')) AS text_chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(17 + role_chars + text_chars))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.v, v.v)::BIGINT AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.v) = len(v.v)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES = {
    "op1_ppm_language": op1_ppm_language,
    "op2_pfair_mix": op2_pfair_mix,
    "op3_dart_minhash": op3_dart_minhash,
    "op4_quality_llr": op4_quality_llr,
    "op5_merge_dropout": op5_merge_dropout,
    "op6_token_counts": op6_token_counts,
    "op7_secret_ledger": op7_secret_ledger,
    "op8_exact_topk": op8_exact_topk,
    "op9_chat_format": op9_chat_format,
    "op10_toxic_crf": op10_toxic_crf,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_simhash": op12_simhash,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {
    "op7_secret_ledger": _op7_sql(),
    "op9_chat_format": OP9_SQL,
    "op8_exact_topk": OP8_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op13_merkle_manifest": _op13_sql(),
}
