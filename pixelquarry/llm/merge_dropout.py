"""SentencePiece encoding and decoding with seeded merge-dropout.

A text is cut into units where two characters never stand side by side in a piece: no merge
crosses there, so units are merged on their own. Candidate merges of a unit wait in an agenda by
piece score, then position. Each one that is taken up is a step, and a keyed hash of (seed, doc_id,
place of the unit in the text, step) decides whether it is skipped; a skipped merge may come up
again only with other neighbours. With probability 0 the result is the library's encoding.

Every occurrence of a word has draws of its own, so it can be cut in all ways that skips allow,
however often it occurs; nothing is remembered between texts. The units of a slice of documents go
through their steps together, one numpy operation for all of them: an agenda is a column of a
table of ranks, and its least entry is the next merge. Units of over ``LONG_UNIT`` characters have
a heap of their own instead. The same seed always gives the same pieces, however the rows are dealt.

Characters without a piece become byte pieces. The space mark itself (U+2581) is written as byte
pieces too, so that decoding gives back every text exactly.

Defined cases: a null or empty text has no pieces; a null doc_id takes the place of 0; lone
surrogates cannot occur in Spark strings; repeated rows get equal pieces. Very long units are
merged in n log n. Whole texts are encoded, long ones in ranges that end between units. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelquarry.llm import bytescan as bs
from pixelquarry.session import ship

MARK = "▁"
DROPOUT = 0.1
SEED = 17
#: Units of more characters are merged with a heap; positions of the others take 6 bits.
LONG_UNIT = 64
#: Characters that are merged together.
RANGE_CHARS = 400_000

_NONE = np.int32(2**31 - 1)
_GONE = np.int32(-2)
_STEP = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def unit_keys(doc_ids: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """The key of each unit's draws: by seed, document and the unit's first character in the text."""
    return bs.mix(places.astype(np.uint64) + bs.mix(doc_ids.astype(np.int64).view(np.uint64) ^ np.uint64(seed << 40 & _ALL)))


def skipped(keys: np.ndarray, step: int, dropout: float) -> np.ndarray:
    """Whether the step is skipped, for each key: one draw a step."""
    return (bs.mix(keys + np.uint64((step + 1) * _STEP & _ALL)) >> np.uint64(11)) * 2.0**-53 < dropout


class Pairs:
    """The row of each pair of pieces that merge: hashed slots, those that clash in a further table."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables = keys, []
        rows, bits = np.arange(len(keys), dtype=np.int32), max(4, int(len(keys)).bit_length() + 3)
        while len(rows):
            factor = np.uint64(bs.mix(np.array([len(self.tables) + 1], np.uint64))[0] | np.uint64(1))
            slots, at = np.full(1 << bits, -1, np.int32), (keys[rows] * factor) >> np.uint64(64 - bits)
            slots[at] = rows
            self.tables.append((factor, np.uint64(64 - bits), slots))
            rows = rows[slots[at] != rows]

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair, -1 for pairs that do not merge; pieces below 0 merge with none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(len(keys), -1, np.int32)
        at = slice(None)
        for factor, shift, slots in self.tables:
            some = keys[at]
            row = slots[(some * factor) >> shift]
            good = self.keys[row] == some  # an empty slot reads the last key, which has no empty slot itself
            out[at] = np.where(good, row, -1)
            clash = np.flatnonzero(~good & (row >= 0))
            if not len(clash):
                break
            at = clash if isinstance(at, slice) else at[clash]
        return out


class Pieces:
    """Vocabulary of a BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        byte_of = {i: int(self.text[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.byte = np.zeros(256, np.int32)
        self.byte[list(byte_of.values())] = list(byte_of)
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        # characters: a number for each that occurs in a piece (0: none), and its own piece
        chars = sorted(set("".join(self.id)))
        self.number = np.zeros(0x110000, np.int16 if len(chars) < 1 << 15 else np.int32)
        self.number[[ord(" " if c == MARK else c) for c in chars]] = np.arange(1, len(chars) + 1)
        if " " not in chars:
            self.number[ord(MARK)] = 0  # a mark of the text itself has no piece, so that it is written as bytes
        self.single = np.array([-1, *(self.id.get(c, -1) for c in chars)], np.int32)
        place = {c: k for k, c in enumerate(chars, 1)}
        self.beside = np.zeros((len(chars) + 1,) * 2, bool)
        for t in self.id:
            for a, b in zip(t, t[1:]):
                self.beside[place[a], place[b]] = True
        # merges: rank (equal scores share one) and resulting piece
        order = {x: k for k, x in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        merges = {}
        for t, i in self.id.items():
            for cut in range(1, len(t)):
                a, b = self.id.get(t[:cut]), self.id.get(t[cut:])
                if a is not None and b is not None:
                    merges[a << 32 | b] = (order[model.get_score(i)], i)
        self.merges = merges
        self.pairs = Pairs(np.array(list(merges), np.uint64))
        self.rank = np.array([r for r, _ in merges.values()], np.int32)
        self.into = np.array([i for _, i in merges.values()], np.int32)
        # what each piece decodes to
        raw = [bytes([byte_of[i]]) if i in byte_of else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_from = np.cumsum(self.raw_size) - self.raw_size

    def merge(self, ids: np.ndarray, begins: np.ndarray, keys: np.ndarray, dropout: float) -> None:
        """Merge units in place: ``ids`` of characters end to end, units from ``begins``; merged-away places are ``_GONE``."""
        ends = np.append(begins[1:], len(ids))
        size = ends - begins
        for i in np.flatnonzero(size > LONG_UNIT):
            self._merge_long(ids[begins[i] : ends[i]], keys[i], dropout)
        found = self.pairs.find(ids[:-1], ids[1:])
        left, right = np.arange(-1, len(ids) - 1), np.arange(1, len(ids) + 1)
        shortest = 2
        for widest in (4, 8, 16, LONG_UNIT):
            own = np.flatnonzero((size >= shortest) & (size <= widest))
            own = own[np.argsort(-size[own], kind="stable")]
            shortest = widest + 1
            if len(own):
                self._merge_units(ids, begins[own], ends[own], keys[own], dropout, found, left, right)

    def _merge_units(self, ids, begin, end, key, dropout, found, left, right) -> None:
        """The agendas of some units, the longest first, side by side: entry (c, u) is the rank of unit u's pair at c, and c."""
        width = int(end[0] - begin[0])
        agenda = np.full((width - 1, len(begin)), _NONE, np.int32)
        for c in range(width - 1):
            n = int(np.searchsorted(begin - end, -c - 1, side="left"))  # units of more than c + 1 characters
            row = found[begin[:n] + c]
            agenda[c, :n] = np.where(row >= 0, self.rank[row] << 6 | c, _NONE)
        step = 0
        while len(begin):
            least = agenda.min(axis=0)
            live = np.flatnonzero(least != _NONE)
            if len(live) < 0.75 * len(begin):  # units that are done leave
                begin, end, key, agenda, least = begin[live], end[live], key[live], agenda[:, live], least[live]
                live = np.arange(len(live))
            skip = skipped(key[live], step, dropout) if dropout > 0 else np.zeros(len(live), bool)
            step += 1
            c = least[live] & 63
            agenda[c, live] = _NONE
            u, c = live[~skip], c[~skip]
            b = begin[u]
            p = b + c
            q = right[p]
            ids[p], ids[q] = self.into[found[p]], _GONE
            after = right[q]
            right[p] = after
            agenda[np.minimum(q - b, width - 2), u] = _NONE  # the last character has no entry of its own; before it stands p or one that is gone
            inner, before = np.flatnonzero(after < end[u]), left[p]
            left[after[inner]] = p[inner]
            outer = np.flatnonzero(before >= b)
            at = np.concatenate((p[inner], before[outer]))
            row = self.pairs.find(ids[at], np.concatenate((ids[after[inner]], ids[p[outer]])))
            found[at] = row
            of = np.concatenate((inner, outer))
            place = (at - b[of]).astype(np.int32)
            agenda[place, u[of]] = np.where(row >= 0, self.rank[row] << 6 | place, _NONE)

    def _merge_long(self, ids: np.ndarray, key: np.uint64, dropout: float) -> None:
        """The same for one unit, with a heap and linked places, in n log n."""
        n, own = len(ids), ids.tolist()
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and own[i] >= 0 and own[after[i]] >= 0:
                rank, merged = self.merges.get(own[i] << 32 | own[after[i]], (0, -1))
                if merged >= 0:
                    heapq.heappush(agenda, (rank, i, merged, own[i], own[after[i]]))

        for i in range(n - 1):
            offer(i)
        step, some, keys = 0, [], np.array([key])
        while agenda:
            _, i, merged, a, b = heapq.heappop(agenda)
            j = after[i]
            if own[i] != a or j >= n or own[j] != b:
                continue
            if step >= len(some):  # draws of the next steps
                some += [bool(skipped(keys, s, dropout)[0]) for s in range(step, step + 64)] if dropout > 0 else [False] * (n + 1)
            step += 1
            if some[step - 1]:
                continue
            own[i], own[j], after[i] = merged, int(_GONE), after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        ids[:] = own

    def encode(self, codes: np.ndarray, docs: np.ndarray, places: np.ndarray, doc_ids: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, document of each) of code points: ``docs`` and ``places`` say whose they are and where they stand there."""
        number = self.number[codes]
        opens = np.ones(len(codes), bool)
        opens[1:] = ~self.beside[number[:-1], number[1:]] | (docs[1:] != docs[:-1])
        begins, out, of = np.flatnonzero(opens), [], []
        first = 0
        while first < len(begins):
            last = max(first + 1, int(np.searchsorted(begins, begins[first] + RANGE_CHARS, side="right")) - 1) if begins[-1] > begins[first] + RANGE_CHARS else len(begins)
            a, b = int(begins[first]), int(begins[last]) if last < len(begins) else len(codes)
            ids, own = self.single[number[a:b]], begins[first:last]
            self.merge(ids, own - a, unit_keys(doc_ids[docs[own]], places[own], seed), dropout)
            left = np.flatnonzero(ids != _GONE)
            ids, whose, bare = ids[left], docs[a:b][left], np.flatnonzero(ids[left] < 0)
            if len(bare):  # byte pieces
                code = codes[a:b][left[bare]]
                size = np.ones(len(ids), np.int64)
                size[bare] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
                raw = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
                missing = np.repeat(ids < 0, size)
                ids, whose = np.repeat(ids, size), np.repeat(whose, size)
                ids[missing] = self.byte[raw]
            out.append(ids)
            of.append(whose)
            first = last
        return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def encode_rows(self, texts: pa.Array, doc_ids: pa.Array, dropout: float, seed: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, pieces, number of pieces of each row) of consecutive row ranges."""
        for begin, end, pack in bs.slices(texts, filler=0x20):  # the model puts a space before every text
            codes = np.frombuffer(pack.buf[:-1].tobytes().decode().encode("utf-32-le"), "<u4")
            point = np.cumsum((pack.buf & 0xC0) != 0x80) - 1  # the character of each byte
            start = point[pack.first - 1]
            docs = np.repeat(np.arange(pack.n), np.diff(np.append(start, len(codes))))
            places = np.arange(len(codes)) - start[docs]
            full = (pack.last > pack.first)[docs]  # an empty text has no space before it
            ids = doc_ids[begin:end].cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            pieces, of = self.encode(codes[full], docs[full], places[full], ids, dropout, seed)
            yield begin, end, pieces, np.bincount(of, minlength=pack.n)

    def decode_rows(self, pieces: np.ndarray, count: np.ndarray) -> pa.Array:
        """The texts of rows of so many pieces each: byte pieces are read as UTF-8, marks as spaces; the first mark was added."""
        size = self.raw_size[pieces]
        at = np.arange(size.sum()) + np.repeat(self.raw_from[pieces] - (np.cumsum(size) - size), size)
        last = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(count)))]
        some = np.flatnonzero(np.diff(last) > 0)
        buf = np.delete(self.raw[at], last[some])
        ends = last - np.concatenate(([0], np.cumsum(np.diff(last) > 0)))
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(buf)])
        return raw.cast(pa.large_string())

    def encode_text(self, text: str | None, doc_id: int | None = None, dropout: float = DROPOUT, seed: int = SEED) -> np.ndarray:
        """The pieces of one text."""
        return next(self.encode_rows(pa.array([text], pa.large_string()), pa.array([doc_id], pa.int64()), dropout, seed))[2]


_vocabularies: dict[str, Pieces] = {}


def vocabulary(path: str) -> Pieces:
    """One a process and model."""
    if path not in _vocabularies:
        _vocabularies[path] = Pieces(path)
    return _vocabularies[path]


def _lists(pieces: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(pieces.astype(np.int32)))


def with_pieces(documents: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """The rows with their ``pieces`` in place of ``text``; ``model`` is a path on all executors."""
    ship(documents.sparkSession)
    others = [c for c in documents.columns if c not in ("text", "pieces")]
    schema = T.StructType([*(documents.schema[c] for c in others), T.StructField("pieces", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            for begin, end, pieces, count in words.encode_rows(batch.column("text"), batch.column("doc_id"), dropout, seed):
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*map(part.column, others), _lists(pieces, count)], [*others, "pieces"])

    return documents.drop("pieces").mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of encoded documents; a null piece list decodes to null."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            lists = batch.column("pieces")
            count = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = words.decode_rows(lists.flatten().to_numpy(zero_copy_only=False), count)
            texts = pc.if_else(lists.is_null(), pa.scalar(None, pa.large_string()), texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts.cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")


def round_trip(documents: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_pieces, pieces_sha256, lossless): the encoding of every document, decoded again and compared.

    ``pieces_sha256`` is over the piece numbers as 32-bit little-endian integers.
    """
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for begin, end, pieces, count in words.encode_rows(texts, ids, dropout, seed):
                given = texts[begin:end].cast(pa.large_string()).fill_null("")
                last = np.cumsum(count)
                raw = pieces.astype("<i4")
                digest = [hashlib.sha256(raw[b - n : b]).hexdigest() for b, n in zip(last.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids[begin:end], pa.array(count, pa.int64()), pa.array(digest, pa.string()), pc.equal(words.decode_rows(pieces, count), given)],
                    ["doc_id", "n_pieces", "pieces_sha256", "lossless"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_pieces long, pieces_sha256 string, lossless boolean"
    )
