"""Language ID by prediction by partial matching (PPM).

For each language a variable-order byte context tree is counted: how often each byte follows each
context of up to ``ORDER`` bytes. The code length of a byte under a language is PPM's, with escape
method C: in a context seen n times with d distinct successors, a byte seen c times costs
-log2(c / (n + d)); an unseen one costs an escape, -log2(d / (n + d)), plus its cost in the context
one byte shorter; contexts never seen cost nothing to skip; below order 0 all 256 bytes are alike.
The statistics are frozen after the fit, so the code length of a text is a plain sum over its
bytes, and costs of all seen byte strings are tabulated once for all languages.

The prediction is the language of the shortest code, ties to the smaller name; the score is its
posterior among the languages under equal priors, 2^-bits normalised. A text that is null, empty
or without any letter is ``und`` with score 0, as is every text if nothing could be learned.

The fit reads at most about ``DOCS_PER_LANG`` documents per language, chosen by a hash of
doc_id (a bound on labelled rows; smaller inputs are used whole), each in full. Rows with a null
lang, text or doc_id teach nothing. Repeated rows count repeatedly and are predicted alike.
Whole texts are scored. Columns other than doc_id, text and, for the fit, lang are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.llm import bytescan as bs
from pixelquarry.llm.sampling import id_hash, last_hash
from pixelquarry.session import settled, ship

ORDER = 4
DOCS_PER_LANG = 1500
UNDETERMINED = "und"
#: A text whose shortest code takes more than this many bits a byte and so many bits besides is no language.
#: Prose in capitals that a small sample lacks takes up to 9 bits a byte, letters at random 11 to 20.
REJECT_RATE, REJECT_BITS = 10.0, 512.0
#: Parts of the texts; each is judged by the statistics of the others.
PARTS = 2
#: Verdicts (about 60 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: All languages in one: what a language lacks in few documents, as capitals or marks, others may have.
ANY = "any"

OUT = "doc_id long, lang_pred string, score double, bits_per_byte double"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SLOT_BITS = 20  # at most


def grams(pack: bs.Pack, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte string of ``width`` bytes that ends at each text byte, as a number, and its document."""
    lens = pack.last - pack.first
    docs = np.repeat(np.arange(pack.n), lens)
    at = np.arange(len(docs)) + (pack.first - np.concatenate(([0], np.cumsum(lens)[:-1])))[docs]
    key = np.zeros(len(at), np.uint64)
    for back in range(width - 1, -1, -1):
        key = (key << np.uint64(8)) | pack.buf[at - back]
    return key, docs


@dataclass
class Table:
    """Rows of values by 64-bit key: a direct slot for most keys, a binary search for the others."""

    keys: np.ndarray
    values: np.ndarray
    slots: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "values": self.values, "slots": None}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.slots).bit_length())

    def _search(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where absent."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        if len(keys) < 30_000:  # slots pay only for the bulk of the bytes
            return self._search(keys)
        if self.slots is None:
            self.slots = np.full(1 << min(_SLOT_BITS, len(self.keys).bit_length() + 2), -1, np.int32)
            self.slots[self._slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)
        row = self.slots[self._slot(keys)]
        other = np.flatnonzero((row >= 0) & (self.keys[row] != keys))  # no key has an empty slot
        if len(other):
            row[other] = self._search(keys[other])
        return row


@dataclass
class Model:
    """Cost tables by order: of whole strings (context and byte), and of escapes from contexts."""

    langs: list[str]
    cost: list[Table]
    escape: list[Table]

    def bits(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code length of each string's last byte after its first ``order`` bytes, by language."""
        if order < 0:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        row = self.cost[order].find(keys)
        out = self.cost[order].values[row]
        new = np.flatnonzero(row < 0)
        if len(new):
            some = keys[new]
            shorter = self.bits(some & np.uint64((1 << 8 * order) - 1), order - 1)
            context = self.escape[order].find(some >> np.uint64(8))
            leave = np.where(context[:, None] < 0, np.float32(0), self.escape[order].values[context]) if len(self.escape[order].keys) else 0.0
            out[new] = shorter + leave
        return out


def build(langs: list[str], keys: list[np.ndarray], counts: list[np.ndarray], order: int = ORDER) -> Model:
    """Context trees of all languages from their counted strings of order + 1 bytes."""
    model = Model(langs, [], [])
    for k in range(order + 1):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        seen = [np.unique(x & mask, return_inverse=True) for x in keys]
        sums = [np.bincount(inv, weights=c, minlength=len(u)) for (u, inv), c in zip(seen, counts, strict=True)]
        union = np.unique(np.concatenate([u for u, _ in seen]))
        contexts = np.unique(union >> np.uint64(8))
        cost, leave = np.zeros((len(union), len(langs))), np.zeros((len(contexts), len(langs)))
        # strings new to a language fall back to one byte less
        lower = model.bits(union & np.uint64((1 << 8 * k) - 1), k - 1)
        for j, ((own, _), c) in enumerate(zip(seen, sums, strict=True)):
            ctx = np.searchsorted(contexts, own >> np.uint64(8))
            n, d = np.bincount(ctx, weights=c, minlength=len(contexts)), np.bincount(ctx, minlength=len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                leave[:, j] = np.where(n > 0, -np.log2(d / (n + d)), 0.0)
            cost[:, j] = lower[:, j] + leave[np.searchsorted(contexts, union >> np.uint64(8)), j]
            cost[np.searchsorted(union, own), j] = -np.log2(c / (n + d)[ctx])
        model.cost.append(Table(union, cost.astype(np.float32)))
        model.escape.append(Table(contexts, leave.astype(np.float32)))
    return model


def _sample(documents: DataFrame, docs_per_lang: int) -> tuple[list[str], DataFrame]:
    """The languages, and (lang, text) of the documents to learn from."""
    known = documents.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    totals = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not totals:
        return [], known.limit(0).select("lang", "text")
    last = F.create_map(*[F.lit(x).cast(kind) for k, n in totals.items() for x, kind in ((k, "string"), (last_hash(docs_per_lang, n), "long"))])
    return sorted(totals), known.where(id_hash() <= F.element_at(last, F.col("lang"))).select("lang", "text")


def _lang_code(langs: list[str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)]), F.col("lang"))


def _counted(sample: DataFrame, order: int, code: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, string, number) of the strings of order + 1 bytes in the sample's texts, by their code."""
    ship(sample.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.asarray(batch.column("code"))
            for begin, end, pack in bs.slices(batch.column("text"), gap=order, filler=0):
                key, docs = grams(pack, order + 1)
                of = codes[begin:end][docs]
                for j in np.unique(of):
                    strings, n = np.unique(key[of == j], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(strings), j, np.int32)), pa.array(strings.view(np.int64)), pa.array(n.astype(np.int64))], ["code", "string", "n"]
                    )

    counted = (
        sample.select(code.cast("int").alias("code"), "text").mapInArrow(count, "code int, string long, n long")
        .groupBy("code", "string").agg(F.sum("n").alias("n"))
    )
    found = counted.toArrow()  # distinct strings of the bounded sample
    return tuple(found.column(c).to_numpy() for c in ("code", "string", "n"))


def fit(documents: DataFrame, order: int = ORDER, docs_per_lang: int = DOCS_PER_LANG) -> Model | None:
    """Frozen statistics of every lang value, or None where there is nothing to learn from."""
    langs, sample = _sample(documents, docs_per_lang)
    if not langs:
        return None
    of, strings, n = _counted(sample, order, _lang_code(langs))
    seen = [j for j in range(len(langs)) if (of == j).any()]
    if not seen:
        return None
    return build([langs[j] for j in seen], [strings[of == j].view(np.uint64) for j in seen], [n[of == j].astype(float) for j in seen], order)


def text_part(parts: int = PARTS) -> Column:
    """crc32 of the text, modulo ``parts``: copies of a text are in one part; 0 for a null text."""
    return F.coalesce(F.crc32(F.col("text").cast("binary")) % parts, F.lit(0))


def _built_apart(sample: DataFrame, langs: list[str], parts: int, order: int) -> list[Model | None]:
    of, strings, n = _counted(sample, order, _lang_code(langs) * parts + text_part(parts))
    models: list[Model | None] = []
    for part in range(parts):
        other = of % parts != part
        names, keys, counts = [], [], []
        for name, own in [*((k, other & (of // parts == j)) for j, k in enumerate(langs)), (ANY, other)]:
            if own.any():
                found, at = np.unique(strings[own].view(np.uint64), return_inverse=True)
                names, keys, counts = [*names, name], [*keys, found], [*counts, np.bincount(at, weights=n[own])]
        models.append(build(names, keys, counts, order) if names else None)
    return models


def fit_apart(documents: DataFrame, parts: int = PARTS, order: int = ORDER, docs_per_lang: int = DOCS_PER_LANG) -> list[Model | None]:
    """For each part of the texts, statistics of the other parts: of every language, and last of ``ANY``.

    Noise among few documents can make noise look familiar: texts that the first statistics code in
    more than 8 bits a byte take no part in the final ones.
    """
    langs, sample = _sample(documents, docs_per_lang)
    if not langs:
        return [None] * parts
    sample = settled(sample, "language-sample")  # bounded by its definition
    first = _built_apart(sample, langs, parts, order)
    # written down in between: two Python functions in one stage take two workers a core, and all of them stay
    plain = settled(_familiar(sample, first, parts, 8.0), "language-sample")
    return _built_apart(plain, langs, parts, order)


def _letters(pack: bs.Pack) -> np.ndarray:
    """Whether each document holds a letter."""
    seen = np.concatenate(([0], np.cumsum(_LETTER[pack.buf])))
    out = seen[pack.last] > seen[pack.first]
    for i in np.flatnonzero(~out):
        raw = pack.buf[pack.first[i] : pack.last[i]]
        if (raw >= 0x80).any():
            out[i] = any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace")))
    return out


def code_lengths(model: Model, pack: bs.Pack) -> np.ndarray:
    """Bits of each document under each language."""
    order = len(model.cost) - 1
    key, _ = grams(pack, order + 1)
    bits = model.bits(key, order)
    lens = pack.last - pack.first
    some = np.flatnonzero(lens)
    out = np.zeros((pack.n, len(model.langs)))
    if len(some):
        out[some] = np.add.reduceat(bits, (np.cumsum(lens) - lens)[some], axis=0, dtype=float)
    return out


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of every document."""
    spark = documents.sparkSession
    ship(spark)
    # bounded by the fit's sample, whatever the input
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for begin, end, pack in bs.slices(batch.column("text"), gap=ORDER if m is None else len(m.cost) - 1, filler=0):
                letters = _letters(pack)
                if m is None:
                    names, score, rate = np.full(pack.n, UNDETERMINED, object), np.zeros(pack.n), np.full(pack.n, 8.0)
                else:
                    bits = code_lengths(m, pack)
                    best = bits.argmin(axis=1)
                    least = bits.min(axis=1)
                    score = np.where(letters, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1), 0.0)
                    names = np.where(letters, np.array(m.langs, object)[best], UNDETERMINED)
                    rate = least / np.maximum(pack.last - pack.first, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[begin:end], pa.array(names, pa.string()), pa.array(score), pa.array(rate)],
                    ["doc_id", "lang_pred", "score", "bits_per_byte"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def _costs(texts: pa.Array, of: np.ndarray, models: list[Model | None]) -> Iterator[tuple[np.ndarray, bs.Pack, np.ndarray | None, Model | None]]:
    """(rows, their texts, code lengths, model) of slices of texts, each under the model of its part; null code lengths without a model."""
    for part in np.unique(of):
        rows, m = np.flatnonzero(of == part), models[part]
        for begin, end, pack in bs.slices(texts.take(pa.array(rows)), gap=ORDER if m is None else len(m.cost) - 1, filler=0):
            yield rows[begin:end], pack, None if m is None else code_lengths(m, pack), m


def _familiar(documents: DataFrame, models: list[Model | None], parts: int, rate: float) -> DataFrame:
    """The rows of a bounded sample whose text costs at most ``rate`` bits a byte under the statistics of the other parts."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.ones(len(batch), bool)
            for at, pack, bits, _ in _costs(batch.column("text"), batch.column("_part").to_numpy(zero_copy_only=False), shared.value):
                if bits is not None:
                    out[at] = bits.min(axis=1) <= rate * (pack.last - pack.first)
            yield batch.drop_columns(["_part"]).filter(pa.array(out))

    # the same kind of function as all others here: each kind has Python workers of its own, which stay with their models
    return documents.withColumn("_part", text_part(parts).cast("int")).mapInArrow(run, documents.schema)


def _judged(documents: DataFrame, models: list[Model | None], parts: int) -> DataFrame:
    """(digest, lang, kept) of the texts that are rejected or that lack a language, under the statistics of the other parts.

    Only texts go to Python, and of most of them nothing comes back.
    """
    spark = documents.sparkSession
    ship(spark)
    # bounded by the fit's sample, whatever the input
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, bare = batch.column("text"), batch.column("bare").to_numpy(zero_copy_only=False)
            for at, pack, bits, m in _costs(texts, batch.column("part").to_numpy(zero_copy_only=False), shared.value):
                keep, lang = _letters(pack), np.full(pack.n, None, object)
                if bits is not None:
                    keep &= bits.min(axis=1) <= REJECT_RATE * (pack.last - pack.first) + REJECT_BITS
                    if len(m.langs) > 1:
                        lang = np.array(m.langs[:-1], object)[bits[:, :-1].argmin(axis=1)]
                told = np.flatnonzero(~keep | (bare[at] & np.not_equal(lang, None)))
                digests = [hashlib.sha256(texts[int(k)].as_py().encode()).digest() for k in at[told]]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(lang[told], pa.string()), pa.array(keep[told])], ["digest", "lang", "kept"])

    bare = F.col("lang").isNull() if "lang" in documents.columns else F.lit(False)
    asked = documents.where("text is not null").select("text", text_part(parts).cast("int").alias("part"), bare.alias("bare"))
    return asked.mapInArrow(run, "digest binary, lang string, kept boolean")


def recognised(documents: DataFrame, parts: int = PARTS, docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """The rows whose text is in some language, in place and with all columns; a null lang becomes the predicted one.

    Every text is judged by statistics that hold neither it nor a copy of it (``fit_apart``).
    Rejected are texts that are null or without letters, and those that no language, nor all in one,
    codes in at most ``REJECT_RATE`` bits a byte and ``REJECT_BITS`` bits besides: one rule for all lengths, under
    which the evidence of a few bytes is never enough. Where nothing could be learned only the former
    are. A verdict is one on a text: those that change anything are written down by the text's digest and
    joined to the rows; the rows themselves stay where they are.
    """
    models = fit_apart(documents, parts=parts, docs_per_lang=docs_per_lang)
    told = settled(_judged(documents, models, parts), "language-verdicts").groupBy("digest").agg(F.max("lang").alias("said"), F.min("kept").alias("kept"))
    told = settled(told, "language-verdicts")
    n = told.limit(BROADCAST_ROWS + 1).count()
    there = documents.where("text is not null")
    if not n:
        return there
    digest = F.unhex(F.sha2(F.col("text"), 256))
    rows = there.select(F.struct("*").alias("row"), digest.alias("digest"))
    kept = rows.join(F.broadcast(told) if n <= BROADCAST_ROWS else told, "digest", "left").where("kept is null or kept")
    fields = {c: F.col("row").getField(c).alias(c) for c in documents.columns}
    if "lang" in fields:
        fields["lang"] = F.coalesce(F.col("row.lang"), F.col("said")).alias("lang")
    return kept.select(*fields.values())


def fold(doc_id: str | Column = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % parts


def language_id(documents: DataFrame, held_out: int = 0, parts: int = 5) -> DataFrame:
    """Fit on the other folds, predict every document, and say which were held out."""
    model = fit(documents.where(fold(parts=parts) != held_out))
    return predict(documents, model).select(
        "doc_id", F.coalesce(fold(parts=parts) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte"
    )
