"""Brute-force checks of the Merkle manifest, the prefix trie and the SimHash components."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelquarry.llm import bytescan as bs
from pixelquarry.llm import merkle, prefix_trie, queries, simhash
from pixelquarry.llm.dart_minhash import components
from pixelquarry.llm.ppm_language import fold
from pixelquarry.session import table


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda t: tuple((x is not None, x) for x in t))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp string, pos long, node string, key long, fingerprint long, block int"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like those that the operators make."""
    texts = [None, "", " \n\t ", "one two", "Ab CD ef gh " * 9000, "日本語 ▁ é 😀 A", "x" * 3000 + " y z w", "same text of a few words"]
    rows = [(i, t, ("en", None, "é", "")[i % 4], None if i % 3 else "s", None if i % 5 == 4 else i, "g", 1, "n", 2, 3, 4) for i, t in enumerate(texts * 3)]
    rows += [rows[7], rows[7], (None, *rows[7][1:]), (None, *rows[7][1:]), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


# Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, n_chars):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n_chars, r.text)))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def plain_manifest(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in names:
        groups[k].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.n_chars)))
        trees[k] = levels([leaf(r, r.n_chars) for r in groups[k]], fanout)
    top = levels([trees[k][-1][0] for k in names], fanout)
    for g, k in enumerate(names):
        for i, r in enumerate(groups[k]):
            struck = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            now, siblings = leaf(r, r.n_chars + struck if struck else r.n_chars), []
            for tree, j in ((trees[k], i), (top, g)):
                for level in tree[:-1]:
                    run, at = level[j // fanout * fanout :][:fanout], j % fanout
                    siblings += run[:at] + run[at + 1 :]
                    now, j = digest(*run[:at], now, *run[at + 1 :]), j // fanout
            yield leaf_row(r, trees[k][-1][0], top[-1][0], digest(*siblings), now)


def leaf_row(r, subroot, root, proof, folded):
    return r.doc_id, leaf(r, r.n_chars), subroot, root, proof, folded, folded == root


def test_midstates_are_sha256():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 32, (5, 8), dtype=np.uint64).astype(np.uint32)
    state = merkle.start(5)
    for n in range(4):
        texts = [(b"".join(int(w).to_bytes(4, "big") for w in row).hex() * n).encode() for row in words]
        got = merkle.finish(state, np.full(5, n)).astype(">u4").tobytes()
        assert got == b"".join(hashlib.sha256(t).digest() for t in texts)
        state = merkle.absorb(state, merkle.as_text(words))


@pytest.mark.parametrize(("fanout", "block_levels"), [(2, 12), (2, 2), (3, 2)])
def test_manifest_is_that_of_a_plain_tree(spark, awkward, sf_dir, fanout, block_levels):
    """Trees of one block and of several rounds of blocks, with groups of one, of null and of repeated rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars").unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars"))
    got = ordered(merkle.manifest(docs, fanout, block_levels).collect())
    assert got == ordered(plain_manifest(docs.collect(), fanout))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_few_rows(spark, awkward):
    assert merkle.manifest(awkward.limit(0)).count() == 0
    assert ordered(merkle.manifest(awkward).collect()) == ordered(plain_manifest(awkward.collect()))
    one = awkward.where("doc_id = 3").limit(1)
    assert ordered(merkle.manifest(one).collect()) == ordered(plain_manifest(one.collect()))


# prefix trie


def plain_trie(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    nodes, children, sums = {}, {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        below = [sums[x] for x in children.get(k, [])]
        sums[k] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0))
        ends = ",".join(str(c) for c in sorted(nodes[k]) if len(built[c]) == len(k))
        yield min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(below), *sums[k], digest(ends)


def rebuilt(df, **how):
    c = F.col("conv_id")
    return ordered(prefix_trie.trie(prefix_trie.prefixes(df, base=c - c % 100, heads=fold("conv_id", parts=6), most_heads=5), **how).collect())


def test_trie_is_that_of_a_plain_walk(spark, monkeypatch):
    """Shared and lone tails, negative and missing bases, turnless conversations, ties, nulls; also with a sketch too small to prove anything."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{(c % 3) * (t > 1)}-{t}" if t < 4 else f"é{c % 7}") for c in range(-130, 450) for t in range(c % 8)]
    rows += [(1000, None, None, None), (1000, 1, "a", "x"), (1000, 1, "a", "x"), (1000, 1, "a", None), (None, 1, "u", "x"), (1199, 0, "a", "b"), (1200, 5, "a", "b")]
    rows += [(c, t, "user", f"{c} {t}") for c in range(2000, 2030) for t in range(30)]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id long, turn long, role string, text string, base long, node string")
    want = ordered(plain_trie(rows))
    assert rebuilt(df) == want
    assert rebuilt(df.limit(0)) == []
    monkeypatch.setattr(prefix_trie, "LEAST_WIDTH", 64)
    monkeypatch.setattr(prefix_trie, "_SEGMENT", 64)
    monkeypatch.setattr(prefix_trie, "_CHUNK", 3)
    assert rebuilt(df, most_width=64) == want


def test_sketch_never_counts_too_few(spark):
    rows = prefix_trie.prefixes(table(spark, "/root/testdata/sf0.001", "conversations")).persist()
    for width in (1 << 16, 1 << 17):
        seen = prefix_trie.screened(rows, prefix_trie.sketch(rows, width)).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("alone").alias("alone"))
        assert seen.where("alone and n > 1").count() == 0
        assert seen.where("not alone and n = 1").count() <= 0.01 * seen.count()


# SimHash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """Fingerprint to a name of its component, by trying all values two bits away."""
    up = {f: f for f in prints}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for f in prints:
        for i in range(64):
            for j in range(i + 1):
                g = f ^ (1 << i) ^ (1 << j if j < i else 0)
                if g in up:
                    up[find(f)] = find(g)
    return {f: find(f) for f in prints}


def plain_simhash(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    names, least = plain_classes({f for _, f in prints}), {}
    for i, f in prints:
        if i is not None:
            least[names[f]] = min(i, least.get(names[f], i))
    return ordered((i, f"{f:016x}", least.get(names[f])) for i, f in prints)


def test_xxh64_is_that_of_the_library():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 5000).astype(np.uint8)
    begins = rng.integers(0, 4000, 3000)
    ends = begins + rng.integers(0, 400, 3000)
    assert simhash.xxh64(buf, begins, ends).tolist() == [xxhash.xxh64_intdigest(buf[a:b].tobytes(), 42) for a, b in zip(begins, ends, strict=True)]


def test_fingerprints_of_odd_texts():
    texts = ["A b C", "", None, "x", " \n", "ÀB cd\tEF  gh\x0bij " + "z" * 700 + " q", "one two", "日本 語 😀 a A"] * 3
    (_, _, pack), = bs.slices(pa.array(texts))
    assert simhash.fingerprints_of(pack).tolist() == [plain_fingerprint(t) for t in texts]


def test_simhash_of_documents(spark, awkward):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = ordered(queries.op12_simhash(spark, "/root/testdata/sf0.01").collect())
    assert got == plain_simhash([(r.doc_id, r.text) for r in docs.collect()])
    assert ordered(simhash.near_duplicates(awkward).collect()) == plain_simhash([(r.doc_id, r.text) for r in awkward.collect()])
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0
    bare = awkward.where("doc_id is null")
    assert ordered(simhash.near_duplicates(bare).collect()) == plain_simhash([(r.doc_id, r.text) for r in bare.collect()])


def test_large_keys_lose_no_link(spark):
    """A crowd around one fingerprint: every key of it is large, or none is, and the components are the same."""
    rng = np.random.default_rng(3)
    base, prints = int(rng.integers(0, 1 << 62)), {int(x) for x in rng.integers(0, 1 << 63, 300)}
    while len(prints) < 1500:
        f = base
        for _ in range(int(rng.integers(0, 9))):
            f ^= 1 << int(rng.integers(0, 20 if rng.random() < 0.7 else 64))
        prints.add(f)
    want = {}
    for f, name in plain_classes(prints).items():
        want.setdefault(name, set()).add(f)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in prints}
    df = spark.createDataFrame([(f,) for f in signed.values()], "fingerprint long")
    for bucket in (2, 48, 10**6):
        to = {r.node: r.component for r in components(simhash.links(df, bucket)).collect()}
        got = {}
        for f, s in signed.items():
            got.setdefault(to.get(s, s), set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
