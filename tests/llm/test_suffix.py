"""Suffix sorting and the removal of repeated bytes against brute force."""

import hashlib
import random
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlake.llm import _windows, induced, suffix

SCHEMA = "doc_id long, text string, uid string, spans int, kept string, source string"


def naive(texts, length=100):
    """(n_bytes, n_removed, n_spans, sha256) of each text, in order."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(b[i : i + length])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "u", 1, "k", None) for i, t in rows], SCHEMA)
    removed = suffix.remove_repeats(df, **options)
    assert removed.columns == ["doc_id", "text", "uid", "source", "spans", "kept"]
    got = sorted((r.doc_id is not None, r.doc_id, tuple(r)[1:]) for r in suffix.digest(removed).collect())
    ordered = sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    want = naive([r[1] for _, r in ordered], options.get("length", 100))
    assert got == sorted((r[0] is not None, r[0], w) for (_, r), w in zip(ordered, want, strict=True))
    return removed


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 7))) for _ in range(n))


def test_edge_cases(spark):
    rng = random.Random(3)
    passage, line = prose(rng, 60), prose(rng, 12)
    rows = [(5, passage), (3, None), (4, ""), (2, "short"), (9, passage), (None, prose(rng, 10) + passage[20:300]), (None, None)]
    rows += [(7, "x" * 900), (8, "y" + "x" * 500), (10, "ab" * 400), (11, passage[:150] + passage[10:160]), (12, passage[:99]), (9, passage)]
    rows += [(20 + i, prose(rng, 30) + line + prose(rng, 5) + line + passage[i : i + 120]) for i in range(40)]
    rows += [(100, prose(rng, 30_000)), (101, "z" + rows[-1][1] * 3)]
    rng.shuffle(rows)
    check(spark, rows)
    check(spark, rows, shard_bytes=2000, sort_bytes=1500)
    check(spark, [])
    check(spark, [(1, None), (2, "tiny")])


def test_hot_grams_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 4)
    rng = random.Random(4)
    line = prose(rng, 14)
    rows = [(i, prose(rng, 25) + line + prose(rng, 25)) for i in range(60)]
    rows += [(100 + i, rows[i][1][40:400]) for i in range(20)]
    check(spark, rows, sort_bytes=3000)


def test_whole_characters(spark):
    rng = random.Random(5)
    passage = "é" * 30 + prose(rng, 60)
    df = spark.createDataFrame([(1, "a" + passage), (2, "b" + passage), (3, "é" + passage.encode()[1:].decode("utf-8", "ignore"))], "doc_id long, text string")
    for r in suffix.remove_repeats(df, whole=True).collect():
        assert bytes(r.kept).decode() in r.text or bytes(r.kept).decode()[0] in r.text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=1, max_size=8), st.sampled_from([3, 8, 20, 100]), st.sampled_from([2, 30, 1 << 20]))
def test_suffix_order_and_common_prefixes(parts, depth, queue):
    text = np.frombuffer("".join(p + "\0" for p in parts).encode().translate(bytes([0, *range(1, 97), 1, 2, *range(99, 256)])), np.uint8)
    blocks = list(induced.sort_suffixes(text, depth, queue))
    sa, common = (np.concatenate(x) for x in zip(*blocks, strict=True))
    data = text.tobytes() + b"\0" * depth
    heads = [data[i : i + depth] for i in sa]
    assert sorted(sa.tolist()) == list(range(len(text) - 1)) and heads == sorted(heads)
    for a, b, c in zip(heads, heads[1:], common[1:], strict=False):
        want = next((k for k in range(depth) if a[k] != b[k]), depth)
        assert want == c


def test_equal_windows_choose_equal_grams():
    rng = random.Random(6)
    passage = prose(rng, 40).encode()
    a, b = prose(rng, 50).encode() + passage + b"1", prose(rng, 9).encode() + passage + b"2" * 300
    chosen = []
    for t in (a, b):
        p, lo, hi = _windows.occurrences(t)
        assert lo[0] == 0 and hi[-1] == len(t) - 100 and (lo[1:] == hi[:-1] + 1).all()
        start = t.index(passage)
        chosen.append([int(p[np.searchsorted(hi, s)]) - start for s in range(start, start + len(passage) - 99)])
    assert chosen[0] == chosen[1]


def test_shard_many_times_larger_than_the_queues(monkeypatch):
    monkeypatch.setattr(induced, "CHUNK", 2000)
    stored, held = [], []
    store, push = induced.TupleStore._store, induced.TupleStore.push

    def counted(self, zone):
        stored.append(self.sizes[zone])
        store(self, zone)

    def watched(self, tuples):
        push(self, tuples)
        held.append(self.held)

    monkeypatch.setattr(induced.TupleStore, "_store", counted)
    monkeypatch.setattr(induced.TupleStore, "push", watched)
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    parts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 200))) for _ in range(120)]
    parts += [p[rng.randint(0, 9) :] + p[:150] for p in parts[:40]]
    raw = np.frombuffer(("\0".join(parts) + "\0").encode(), np.uint8)
    codes = np.unique(raw, return_inverse=True)[1].astype(np.uint8)
    found = []
    for suffixes, heads in induced.repeats(codes, 100, 1000):
        found += [frozenset(x.tolist()) for x in np.split(suffixes, heads[1:])]
    want = {}
    data = codes.tobytes() + b"\0" * 100
    for i in range(len(codes) - 1):
        want.setdefault(data[i : i + 100], []).append(i)
    assert sorted(map(sorted, found)) == sorted(v for v in want.values() if len(v) > 1)
    assert len(codes) > 80 * 1000 and max(held) <= 1000 and sum(stored) > len(codes)


def test_common_grams_are_chosen_last():
    rng = random.Random(12)
    phrase = prose(rng, 30).encode()[:150]
    texts = [prose(rng, 40).encode() + phrase + prose(rng, 40).encode() for _ in range(50)]
    hot = _windows.Hot(_windows.common_grams(texts, 44, 20))
    assert len(hot.hashes) == len(phrase) - 43
    inside = 0
    for t in texts:
        start = t.index(phrase)
        p, lo, hi = _windows.occurrences(t, 100, 44, hot)
        assert lo[0] == 0 and hi[-1] == len(t) - 100 and (lo[1:] == hi[:-1] + 1).all()
        for a, z, q in zip(lo.tolist(), hi.tolist(), p.tolist(), strict=True):
            if start <= q <= start + len(phrase) - 44:
                inside += 1
                assert a >= start and z + 100 <= start + len(phrase)
    assert inside >= 50


def test_clashing_columns_and_spilling_queues(spark):
    rng = random.Random(13)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 40) + passage[i : i + 140] + prose(rng, 20), "a", "b", "c") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __uid string, __text string, _key string")
    removed = suffix.remove_repeats(df, queue_tuples=500, sample_bytes=2000)
    assert removed.columns == ["doc_id", "text", "__uid", "__text", "_key", "spans", "kept"]
    got = sorted((r.doc_id, tuple(r)[1:]) for r in suffix.digest(removed).collect())
    assert got == sorted((r[0], w) for r, w in zip(rows, naive([r[1] for r in rows]), strict=True))
    assert {(r["__uid"], r["__text"], r["_key"]) for r in removed.collect()} == {("a", "b", "c")}


def test_few_files_are_written_and_nothing_stays_on_disk(spark):
    rng = random.Random(12)
    df = spark.createDataFrame([(i, prose(rng, 60)) for i in range(200)] * 2, "doc_id long, text string").repartition(8)
    folder, cached = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")), spark.sparkContext._jsc.getPersistentRDDs
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        before, held = set(folder.rglob("part-*")), cached().size()
        removed = suffix.remove_repeats(df, shard_bytes=8000, sort_bytes=4000)
        total = sum(len(t.encode()) for (t,) in df.select("text").collect())
        assert 1 <= len(set(folder.rglob("part-*")) - before) <= -(-(-(-total // 8000)) // suffix.SHARDS_A_FILE)
        assert cached().size() == held
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert suffix.digest(removed).where("n_removed > 0").count() == 200
    assert suffix.digest(removed).rdd.getNumPartitions() == 1
