"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Word unigrams and bigrams are hashed into ``BUCKETS`` counters. One multinomial is counted over
the whole raw corpus, one over trusted documents; a document's score is the mean of
log(p_target / p_raw) over its n-grams, and every document is decided by one fixed threshold.

The trusted documents are a sample of those labelled quality 1 of about ``TRUSTED_ROWS`` rows,
chosen by a hash of doc_id; the raw counts cover every document. All counts are integers, so the
score of a document is the same however the input is partitioned.

Defined cases: a null text has no words; a document with fewer than ``MIN_WORDS`` words or with
more than half of its words in repeated 3-word windows fails the base rules; with no trusted
document the ratio is 0 everywhere and only the base rules decide. Repeated rows are each
decided alike. Labels for absent or null documents are unused. Extra columns of the input are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquarry.llm import bytescan as bs
from pixelquarry.llm.sampling import id_hash, last_hash
from pixelquarry.session import ship

BUCKETS = 1 << 15
TRUSTED_ROWS = 20_000
MIN_WORDS = 50
#: Documents whose mean log ratio (nats an n-gram) is below this are rejected.
THRESHOLD = -0.03
#: The target is smoothed towards the raw corpus by so many times its own n-grams, so that a trusted sample moves no
#: document far. A share, not a number: a table and the same table twice over decide alike.
SMOOTHING = 2.0
SYMBOLS = b"#*$%&|<>"

OUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, llr double, kept boolean"
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _words(pack: bs.Pack) -> tuple[np.ndarray, np.ndarray]:
    begins, ends = bs.spans_of(~bs.IS_SPACE[pack.buf])
    return bs.span_hashes(pack.buf, begins, ends), pack.doc_of(begins)


def ngram_buckets(words: np.ndarray, docs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every unigram and bigram."""
    pairs, at = bs.window_hashes(words, docs, 2)
    hashed = np.concatenate((bs.mix(words), pairs))
    return (hashed % np.uint64(buckets)).astype(np.int64), np.concatenate((docs, docs[at]))


def _repeats(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of items equal to an earlier item, and to any other item, of their document."""
    keys = bs.mix(hashes ^ bs.mix(docs.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    return later, any_


def _sum_in_docs(mask: np.ndarray, pack: bs.Pack) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask)))
    return total[pack.last] - total[pack.first]


def base_counts(pack: bs.Pack) -> dict[str, np.ndarray]:
    """The rule counts of each document of a pack, and its words' hashes and documents."""
    buf, n = pack.buf, pack.n
    inside = ~bs.IS_SPACE[buf]
    words, docs = _words(pack)
    newline = np.flatnonzero(buf == 0x0A)
    begins, ends = newline[:-1] + 1, newline[1:]
    seen = np.concatenate(([0], np.cumsum(inside)))
    real = seen[ends] > seen[begins]
    begins, ends = begins[real], ends[real]
    line_docs = pack.doc_of(begins)
    later, _ = _repeats(bs.span_hashes(buf, begins, ends), line_docs)
    triples, at = bs.window_hashes(words, docs, 3)
    _, twice = _repeats(triples, docs[at])
    covered = np.zeros(len(words) + 2, bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return {
        "words": words,
        "docs": docs,
        "n_words": np.bincount(docs, minlength=n),
        "word_chars": _sum_in_docs(inside & ((buf & 0xC0) != 0x80), pack),
        "n_symbols": _sum_in_docs(_SYMBOL[buf], pack),
        "n_dup_lines": np.bincount(line_docs[later], minlength=n),
        "n_repeat_words": np.bincount(docs[covered[: len(words)]], minlength=n),
    }


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Distinct ids of about ``rows`` documents labelled quality 1, chosen by hash."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    total = good.count()
    if total <= rows:
        return good
    return good.where(id_hash() <= last_hash(rows, total))


def fit(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS, rows: int = TRUSTED_ROWS) -> np.ndarray:
    """log(p_target / p_raw) by bucket; the raw counts cover all documents."""
    ship(documents.sparkSession)
    # about `rows` ids, a fixed bound whatever the input
    flagged = documents.select("doc_id", "text").join(
        F.broadcast(trusted_ids(labels, rows).withColumn("trusted", F.lit(True))), "doc_id", "left"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            trusted = np.asarray(batch.column("trusted").is_valid())
            for begin, end, pack in bs.slices(batch.column("text")):
                bucket, docs = ngram_buckets(*_words(pack), buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[trusted[begin:end][docs]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, raw[at], target[at])], ["bucket", "raw", "target"])

    counts = (
        flagged.select("text", "trusted")
        .mapInArrow(count, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas()  # at most `buckets` rows
    )
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    out, seen, n = np.zeros(buckets), raw > 0, target.sum()
    if n:  # a bucket that no document has is asked for by none
        out[seen] = np.log((target[seen] / n / (raw[seen] / raw.sum()) + SMOOTHING) / (1 + SMOOTHING))
    return out


def judge(documents: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """Rule counts, ratio score and verdict of every document."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(ratio)
    return documents.select("doc_id", "text").mapInArrow(_judge(shared, threshold, min_words), OUT)


def _judge(shared, threshold: float, min_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            for begin, end, pack in bs.slices(batch.column("text")):
                c = base_counts(pack)
                bucket, docs = ngram_buckets(c["words"], c["docs"], len(ratio))
                grams = np.bincount(docs, minlength=pack.n)
                llr = bs.per_doc(ratio[bucket], docs, pack.n) / np.maximum(grams, 1)
                failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                numbers = [c[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[begin:end], *map(pa.array, [*numbers, failed, llr, ~failed & (llr >= threshold)])],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"],
                )

    return run


def quality_llr(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit the two multinomials and decide every document; see the module's text for the cases."""
    return judge(documents, fit(documents, labels), threshold)
