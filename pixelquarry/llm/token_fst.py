"""Token counts by a finite-state compilation of a byte-pair tokenizer.

A BPE encoding has a local test: a token sequence is the encoding of its text if and only if each
adjacent pair of tokens is the encoding of the pair's text. So the last token of every prefix
is found from the last tokens of shorter prefixes, and a deterministic transducer can count: its
state holds, for each suffix of the prefix that may still grow into a token, the token that ends
before that suffix and how many tokens have come since. A transition reads one byte and is
annotated with the change of the token count; the last byte of a word (the vocabulary marks it)
has its own annotation and leads back to the start. States and transitions are determinised as
they are first met, then kept in dense tables.

Texts are run in chunks of ``CHUNK`` bytes, all in lockstep. A chunk's state map sends the unknown
state at its left edge through the bytes before its first word start (its head) and is constant
from there on. One pass runs all chunks from their first word start; the maps are then composed
along the text: heads whose left neighbour's end state is known run in lockstep, until every
chunk is known (one round, unless a word is longer than a chunk).

Defined cases: a null text is empty and has no tokens; strings of added tokens inside a text count
as one token each, as the library has it by default; nothing is added or cut. Repeated rows
are counted alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pixelquarry.llm import bytescan as bs
from pixelquarry.session import ship

LIMIT = 2048
CHUNK = 256
#: Most states of the compiled tables; beyond, they are emptied and compiled anew as needed.
MOST_STATES = 200_000
FINAL = 256

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_letters() -> dict[str, int]:
    """The printable stand-in letters of byte-level vocabularies: printable bytes stand for
    themselves, the others for the letters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _all_points() -> np.ndarray:
    """All code points that tables may say something about; the planes beyond are unassigned or private."""
    return np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x40000), np.arange(0xE0000, 0xE1000)))


def char_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other, as the library's patterns have them."""
    from tokenizers import Regex, pre_tokenizers

    out, points = np.full(0x110000, OTHER, np.uint8), _all_points()
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for _, (begin, end) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            out[points[begin:end]] = kind
    return out


def lowering() -> tuple[dict[int, str], np.ndarray]:
    """The library's lower-casing where it changes a code point; whether Python's tables may be of another version for a code point."""
    from tokenizers import normalizers

    points = _all_points()
    points = points[points != 0x0A]
    lower = normalizers.Lowercase().normalize_str("\n".join(map(chr, points))).split("\n")
    table = {int(cp): x for cp, x in zip(points, lower, strict=True) if x != chr(cp)}
    odd = np.ones(0x110000, bool)
    odd[_all_points()] = False
    odd[[cp for cp, x in zip(points.tolist(), lower, strict=True) if x != chr(cp).lower() or unicodedata.category(chr(cp)) == "Cn"]] = True
    return table, odd


Tables = tuple[np.ndarray, dict[int, str], np.ndarray]


@functools.cache
def unicode_tables() -> Tables:
    """Classes and lower-casing of the library; some seconds, so that workers get them from the driver."""
    return char_classes(), *lowering()


class Bpe:
    """A merge table over symbols: byte b is symbol b, the last byte of a word FINAL + b."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        suffix = model["end_of_word_suffix"]
        self.added = [t["content"] for t in spec.get("added_tokens", [])]

        def symbols(text: str) -> tuple[int, ...]:
            ends = text.endswith(suffix)
            raw = [letters[c] for c in (text[: -len(suffix)] if ends else text)]
            return (*raw[:-1], raw[-1] + FINAL) if ends else tuple(raw)

        self.spell: list[tuple[int, ...]] = []
        self.of: dict[tuple[int, ...], int] = {}
        for s in [(x,) for x in range(2 * FINAL)]:
            self._add(s)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = symbols(a), symbols(b)
            self.merges.setdefault((self._add(left), self._add(right)), (rank, self._add(left + right)))
        self.valid: dict[tuple[int, int], bool] = {}

    def _add(self, s: tuple[int, ...]) -> int:
        if s not in self.of:
            self.of[s] = len(self.spell)
            self.spell.append(s)
        return self.of[s]

    def encode(self, symbols: tuple[int, ...]) -> list[int]:
        """Plain merging: the pair of least rank, leftmost first."""
        out = [self.of[(s,)] for s in symbols]
        while len(out) > 1:
            best = min(((*self.merges[p], i) for i, p in enumerate(zip(out, out[1:])) if p in self.merges), key=lambda x: (x[0], x[2]), default=None)
            if best is None:
                break
            out[best[2] : best[2] + 2] = [best[1]]
        return out

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their joint text."""
        key = (left, right)
        if key not in self.valid:
            self.valid[key] = self.encode(self.spell[left] + self.spell[right]) == [left, right]
        return self.valid[key]


class Transducer:
    """The compiled tables: next state, and the change of the token count, by state and byte."""

    def __init__(self, path: str):
        self.bpe = Bpe(path)
        self.child: dict[tuple[int, int], int] = {}
        self.token: list[int] = [-1]
        for t, s in enumerate(self.bpe.spell):
            if self.bpe.encode(s) == [t]:
                node = 0
                for x in s:
                    if (node, x) not in self.child:
                        self.child[node, x] = len(self.token)
                        self.token.append(-1)
                    node = self.child[node, x]
                self.token[node] = t
        self._empty()

    def _empty(self) -> None:
        self.column = np.full(256, -1, np.int32)  # bytes get a column when first met
        self.columns = 0
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next = np.full((1024, 16), -1, np.int32)
        self.step = np.zeros((1024, 16), np.int8)
        self.last = np.full((1024, 16), -128, np.int8)
        # a state: for each open suffix, longest first, (trie node, token before it, tokens since)
        self._state(((0, -1, 0),))

    def _state(self, key: tuple) -> int:
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
            if len(self.states) > len(self.next):
                more = len(self.next) // 4
                grow = lambda x, v: np.concatenate((x, np.full_like(x[:more], v)))
                self.next, self.step, self.last = grow(self.next, -1), grow(self.step, 0), grow(self.last, -128)
        return self.known[key]

    def columns_of(self, data: np.ndarray) -> np.ndarray:
        """Table columns of bytes; new bytes widen the tables."""
        for b in np.flatnonzero((self.column < 0) & (np.bincount(data, minlength=256) > 0)):
            if self.columns == self.next.shape[1]:
                grow = lambda x, v: np.concatenate((x, np.full_like(x, v)), axis=1)
                self.next, self.step, self.last = grow(self.next, -1), grow(self.step, 0), grow(self.last, -128)
            self.column[b] = self.columns
            self.columns += 1
        return self.column[data]

    def _advance(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """The open suffixes after one more symbol, and the change of the count."""
        grown, found = [], None
        for node, before, since in state:
            child = self.child.get((node, symbol))
            if child is None:
                continue
            token = self.token[child]
            if found is None and token >= 0 and (before < 0 or self.bpe.follows(before, token)):
                found = (token, 1 - since)
            grown.append((child, before, since))
        token, change = found
        return (*((n, b, s + change) for n, b, s in grown), (0, token, 0)), change

    def compile(self, states: np.ndarray, data: np.ndarray, final: np.ndarray) -> None:
        """Fill in the transitions that are not yet in the tables."""
        for key in np.unique(states.astype(np.int64) << 9 | data.astype(np.int64) << 1 | final):
            q, b, end = int(key >> 9), int(key >> 1) & 255, bool(key & 1)
            target, change = self._advance(self.states[q], b + FINAL * end)
            c = self.column[b]
            if end:
                self.last[q, c] = change
            else:
                target = self._state(target)
                self.next[q, c], self.step[q, c] = target, change

    def run(self, data: np.ndarray, columns: np.ndarray, ends: np.ndarray, state: np.ndarray, begin: np.ndarray, stop: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Run rows of a (steps, chunks) matrix in lockstep from ``begin`` to ``stop``; counts go to out."""
        state = state.copy()
        for j in range(int(begin.min(initial=0)), int(stop.max(initial=0))):
            at = np.flatnonzero((begin <= j) & (j < stop))
            if not len(at):
                continue
            q, c, e = state[at], columns[j, at], ends[j, at]
            new = np.where(e, self.last[q, c] == -128, self.next[q, c] < 0)
            if new.any():
                self.compile(q[new], data[j, at[new]], e[new])
            out[j, at] = np.where(e, self.last[q, c], self.step[q, c])
            state[at] = np.where(e, 0, self.next[q, c])
        return state

    def counts(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The change of the token count at each byte of words laid end to end; ``first`` marks word starts."""
        if len(self.states) > MOST_STATES:
            self._empty()
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        chunks = -(-n // CHUNK)

        def shaped(x: np.ndarray, fill) -> np.ndarray:
            padded = np.full(chunks * CHUNK, fill, x.dtype)
            padded[:n] = x
            return np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)

        ends = np.append(first[1:], True)
        m, e = shaped(data, 0), shaped(ends, False)
        cols = shaped(self.columns_of(data).astype(np.int32), 0)
        starts = shaped(first, False)
        size = np.full(chunks, CHUNK)
        size[-1] = n - (chunks - 1) * CHUNK
        head = np.where(starts.any(axis=0), starts.argmax(axis=0), size)
        out = np.zeros((CHUNK, chunks), np.int64)
        state = self.run(m, cols, e, np.zeros(chunks, np.int32), head, size, out)
        open_ = head == size  # no word starts inside: the end state awaits the left neighbour
        todo = np.flatnonzero(head > 0)
        while len(todo):
            ready = todo[~open_[todo - 1]]
            part = np.zeros((CHUNK, len(ready)), np.int64)
            ended = self.run(m[:, ready], cols[:, ready], e[:, ready], state[ready - 1], np.zeros(len(ready), np.int64), head[ready], part)
            out[:, ready] += part
            whole = open_[ready]
            state[ready[whole]] = ended[whole]
            open_[ready] = False
            todo = np.setdiff1d(todo, ready, assume_unique=True)
        return out.T.reshape(-1)[:n]


class Counter:
    """Normalises texts, marks words and counts tokens with a transducer."""

    def __init__(self, path: str, tables: Tables):
        from tokenizers import normalizers

        self.machine = Transducer(path)
        self.classes, self.lower, self.odd = tables
        self.nfc = normalizers.NFC().normalize_str

    def normal(self, text: str) -> tuple[str, int]:
        """The text as the tokenizer sees it, and how many added tokens stood in it."""
        extra = 0
        for s in self.machine.bpe.added:
            if s in text:
                extra += text.count(s)
                text = text.replace(s, " ")
        if not text.isascii():
            if self.odd[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
                return self.nfc(text).translate(self.lower), extra
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma is lowered without regard to its place
        return text.lower(), extra

    def words(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kept, first): code points that are in words, and those that start one."""
        kind = self.classes[cp]
        before = np.concatenate(([SPACE], kind[:-1])).astype(np.uint8)
        first = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
        quote = np.flatnonzero((cp == 0x27) & (before != OTHER))
        if len(quote):
            ahead = np.concatenate((cp, [0x20, 0x20, 0x20]))
            one, two = ahead[quote + 1], ahead[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            hit = short | long
            first[quote[hit] + 1] = False
            after = quote[hit] + np.where(short[hit], 2, 3)
            first[quote[hit & ~short] + 2] = False
            after = after[after < len(cp)]
            first[after] = kind[after] != SPACE
        return kind != SPACE, first

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        normal = [self.normal(t) for t in texts]
        joined = "\n".join(t for t, _ in normal)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) + 1 for t, _ in normal])
        kept, first = self.words(cp)
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) != len(cp):
            keep = np.repeat(kept, width)
            starts = np.zeros(len(data), bool)
            starts[(np.cumsum(width) - width)[first]] = True
        else:
            keep, starts = kept, first
        change = self.machine.counts(data[keep], starts[keep])
        docs = np.repeat(np.arange(len(texts)), lengths)[: len(cp)]
        at = np.repeat(docs, width)[keep]
        return bs.per_doc(change, at, len(texts)).astype(np.int64) + np.array([x for _, x in normal], np.int64)


_counters: dict[str, Counter] = {}


def counter(path: str, tables: Tables | None = None) -> Counter:
    """One compiled counter a process and vocabulary."""
    if path not in _counters:
        _counters[path] = Counter(path, tables or unicode_tables())
    return _counters[path]


def token_counts(documents: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; ``vocabulary`` is a path on all executors."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(unicode_tables())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(vocabulary, shared.value)
        for batch in batches:
            column = batch.column("text")
            size = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
            begin = 0
            while begin < len(batch):  # bounded slices, by bytes
                end = begin + max(1, int(np.searchsorted(np.cumsum(size[begin:]), bs.SLICE_BYTES, side="right")))
                n = machine.count([t or "" for t in column[begin:end].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[begin:end], pa.array(size[begin:end]), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )
                begin = end

    return documents.select("doc_id", "text").mapInArrow(run, OUT)
