"""Near-duplicate classes of the pipeline against brute force."""

import random

import numpy as np

import corpus_pipeline
from cohortlake.llm import similar, simhash


def sets(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(500)]
    passage = [rng.choice(words) for _ in range(60)]
    out = ["", None, "one", "One", "two words", "a b c d e"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        out.append(" ".join(base))
        for changes in (1, 2, 3, 5, 8):
            copy = list(base)
            for at in rng.sample(range(len(base)), min(changes, len(base) // 20 + 1)):
                copy[at] = rng.choice(words)
            out.append(" ".join(copy))
    out += [" ".join([*(rng.choice(words) for _ in range(rng.randint(5, 20))), *passage]) for _ in range(60)]
    base = [rng.choice(words) for _ in range(90)]
    out += [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(90)]
    return out


def classes(rows):
    own, group = [sets(t) for t in rows], list(range(len(rows)))
    far = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if own[i] == own[j] or 10 * both >= 8 * len(own[i] | own[j]):
                far += (simhash.fingerprint(rows[i] or "") ^ simhash.fingerprint(rows[j] or "")).bit_count() > 2
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group, far


def test_stage_finds_all_pairs_of_the_similarity(spark):
    rows = texts(3)
    group, far = classes(rows)
    assert far > 100  # pairs that two bits of SimHash do not reach
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.simhash_dedup(spark, df, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(group)) and got.dtypes == df.dtypes
    found = {r.doc_id: r.component for r in similar.similar_documents(df, "doc_id").collect()}
    assert len({(found[i], g) for i, g in enumerate(group)}) == len(set(group)) == len(set(found.values()))
    assert similar.similar_documents(df.where("false"), "doc_id").count() == 0


def family(size, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    out = []
    for _ in range(size):
        copy = list(base)
        for at in rng.sample(range(len(base)), rng.randint(1, 4)):
            copy[at] = rng.choice(words)
        out.append(" ".join(copy))
    return out


def test_pairs_of_a_family_of_near_copies_do_not_grow_with_its_square(spark, monkeypatch):
    counted, seen = similar._counted, []

    def watched(pairs, *rest):
        seen.append(pairs.count())
        return counted(pairs, *rest)

    monkeypatch.setattr(similar, "_counted", watched)
    rows = family(800)
    group, _ = classes(rows)
    assert len(set(group)) < len(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.component for r in similar.similar_documents(df, "doc_id").collect()}
    assert len({(found[i], g) for i, g in enumerate(group)}) == len(set(group)) == len(set(found.values()))
    assert sum(seen) < 12 * len(rows), seen


def test_parities_never_rule_out_similar_sets():
    rng = np.random.default_rng(2)
    sets = []
    for n in (1, 2, 9, 10, 100, 900, 3000):
        base = rng.integers(-(1 << 63), (1 << 63) - 1, 2 * n)
        sets += [np.unique(np.r_[base[k : k + n - n // 20], rng.integers(-(1 << 63), (1 << 63) - 1, n // 20)]) for k in range(0, n // 5 + 1, max(1, n // 60))]
    rows = np.array([[0, i, len(s), 0, i, *np.frombuffer(similar._parities(s), np.int64)] for i, s in enumerate(sets)], np.int64)
    x, y = np.triu_indices(len(sets), 1)
    held = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)])
    alike = (100 + similar.PERCENT) * held >= similar.PERCENT * (rows[x, 2] + rows[y, 2])
    close = similar._close(rows, x, y, 100)
    assert close[alike].all() and alike.sum() > 50 and not close.all()
