"""Sharding, packing, SimHash and BPE against brute force."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortlake.llm import bpe, ffd, rendezvous, simhash
from cohortlake.llm.queries import RANKS, WORDS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp int, shard string"
TEXTS = ["Hello there, it's 42 o'clock.\nNew line", "Hello there, it's 42 o'clock.\nNew line", "", None, "one", "two words", "  lead\t\ttab \n\n x ", "naïve  Éa ß Ω 漢字 é\x1c\x85z", "ab " * 5000, "x" * 3000 + " " * 70, "the cat sat on the mat and the dog lay down by it " * 7, "the cat sat on the mat and the dog lay down by it " * 8]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", 1, "clash", 1, "c") for i, t in enumerate(TEXTS)]
    rows += [(3, None, None, None, None, None, None, None), (None, "one", None, None, None, None, None, None), (None, "one", None, None, None, None, None, None), (0, TEXTS[0], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rendezvous_law_slots_and_weights(docs, empty):
    got = rendezvous.shard_documents(docs).collect()
    assert len(got) == 16
    for r in got:
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
    by_key = defaultdict(set)
    slots = defaultdict(list)
    for r in got:
        by_key[r.doc_id].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_key.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    for r in got:
        if r.doc_id is not None:
            assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]))
    assert rendezvous.shard_documents(empty).count() == 0


def test_rendezvous_follows_weights(spark):
    got = rendezvous.rendezvous_shard(spark.range(20000).withColumnRenamed("id", "doc_id"), weights=(1, 3), grown_weight=4.0)
    n = {(r.shard, r.grown_shard): r["count"] for r in got.groupBy("shard", "grown_shard").count().collect()}
    assert abs(n[1, 1] + n[1, 2] - 15000) < 300 and abs(n[0, 2] + n[1, 2] - 10000) < 300 and (0, 1) not in n and (1, 0) not in n


def test_bpe_equals_library(docs, empty):
    enc = reference_encoding()
    got = bpe.decode_ids(bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(got) == 16
    for r in got:
        if r.doc_id is not None:
            text = TEXTS[r.doc_id] or ""
            assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(text)
            assert bytes(r.decoded) == text.encode()
    assert bpe.encode_texts(empty, RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abeinrst '\n\t.19é漢 ", max_size=80)))
def test_bpe_equals_library_on_any_text(text):
    c = bpe.codec(RANKS, public_tokenizers.PATTERN)
    assert np.frombuffer(c.encode(text), "<u4").tolist() == reference_cached().encode_ordinary(text)


_kept = []


def reference_cached():
    if not _kept:
        _kept.append(reference_encoding())
    return _kept[0]


def test_bpe_every_code_point_class():
    c = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for start in range(0, 0x30000, 0x400):
        text = "a".join(chr(x) for x in range(start, start + 0x400) if not 0xD800 <= x < 0xE000)
        assert np.frombuffer(c.encode(text), "<u4").tolist() == reference_cached().encode_ordinary(text), hex(start)


def test_packing_is_whole_and_first_fit(docs, empty):
    tok = Tokenizer.from_file(WORDS)
    for keep in (True, False):
        got = ffd.pack(ffd.tokenize(docs, WORDS), room=512, keep_ids=keep).collect()
        seen = defaultdict(list)
        for r in got:
            seen[r.sequence_id].append((r.offset, r.length))
            if r.doc_id is not None:
                ids = [*tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 2]
                part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
                assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part)
                if keep:
                    assert bytes(r.ids) == part
        for pieces in seen.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 512
        total = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in [*TEXTS, None, "one", "one", TEXTS[0]])
        assert sum(r.length for r in got) == total
        assert len(seen) <= total // 512 + 4
    assert ffd.pack(ffd.tokenize(empty, WORDS)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_tournament_is_first_fit(sizes):
    free, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if at == len(free):
            free.append(100)
        free[at] -= sizes[i]
        want[i] = at
    assert ffd.first_fit_decreasing(sizes, 100) == want


def naive_fingerprint(text):
    words = [w for w in (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(ids, fps, t):
    comp = dict.fromkeys(fps)
    for f in comp:
        if comp[f] is None:
            group, todo = {f}, [f]
            while todo:
                x = todo.pop()
                for y in comp:
                    if y not in group and (x ^ y).bit_count() <= t:
                        group.add(y)
                        todo.append(y)
            for x in group:
                comp[x] = group
    return [min((i for i, g in zip(ids, fps, strict=True) if g in comp[f] and i is not None), default=None) for f in fps]


def test_simhash_fingerprints_and_classes(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 16
    want = {i: naive_fingerprint(t) for i, t in enumerate(TEXTS)}
    for r in got:
        assert r.fp & (2**64 - 1) == (want[r.doc_id] if r.doc_id is not None else naive_fingerprint("one"))
    ids, fps = [r.doc_id for r in got], [r.fp & (2**64 - 1) for r in got]
    assert [r.component_id for r in got] == naive_components(ids, fps, 2)
    assert simhash.near_duplicates(empty).count() == 0


def test_anchors_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, np.uint64)
    chain = [base]
    for _ in range(4):
        flips = sum((np.uint64(1) << rng.integers(0, 64, 300, np.uint64)) * np.uint64(0) for _ in range(1)) + np.uint64(0)
        for _ in range(2):
            flips = flips ^ (np.uint64(1) << rng.integers(0, 64, 300, np.uint64))
        chain.append(chain[-1] ^ flips)
    fps = np.unique(np.concatenate(chain))
    row, anchor = simhash.anchors(fps, 2)
    at = defaultdict(set)
    for i, a in zip(row.tolist(), anchor.tolist(), strict=True):
        at[i].add(a)
    pairs = [(i, j) for ii, jj in simhash.close_pairs(fps, 2) for i, j in zip(ii.tolist(), jj.tolist(), strict=True)]
    assert len(pairs) >= 1000 and all(at[i] & at[j] for i, j in pairs)
    d = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    links = {(r.src, r.dst) for r in simhash.near_links(d).collect()}
    whole = {int(f) & (2**64 - 1) for f in fps}
    assert all((a ^ b) & (2**64 - 1) in range(2**64) and ((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    from cohortlake.llm._common import connected_components

    got = {r.node: r.component for r in connected_components(spark.createDataFrame(list(links), "src long, dst long")).collect()}
    signed = [int(f) for f in fps.view(np.int64)]
    want = naive_components(signed, [f & (2**64 - 1) for f in signed], 2)
    assert [got.get(f, f) for f in signed] == want and len(whole) == len(signed)


def test_sha_of_decoded(docs):
    ids = bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    r = bpe.decode_ids(ids, RANKS).where("doc_id = 8").first()
    assert hashlib.sha256(bytes(r.decoded)).hexdigest() == hashlib.sha256(TEXTS[8].encode()).hexdigest()
