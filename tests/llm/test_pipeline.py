"""The pipeline against its stages by brute force."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cohortlake.llm import ffd, simhash
from cohortlake.llm.queries import WORDS


def texts(rng):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) for _ in range(60)]
    out += [out[3], out[3], out[4] + " end", out[5][:200] + out[6], "", None, "é" * 300, "x" + "é" * 300]
    toxic = ["you idiot scum " + t for t in out[20:40]]
    return out, toxic


def brute(rows, toxic_ids):
    rows = [r for r in rows if r[0] not in toxic_ids]
    fps = [simhash.fingerprint(t or "") for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    rows = [r for i, r in enumerate(rows) if group[i] == i]
    seen, tok, total = set(), Tokenizer.from_file(WORDS), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            while a < z and b[a] & 0xC0 == 0x80:
                gone[a] = False
                a += 1
            while a < z < len(b) and b[z] & 0xC0 == 0x80:
                z -= 1
                gone[z] = False
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]).decode()
        total[i] = len(tok.encode(kept, add_special_tokens=False).ids) + 1
    return total


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    clean, toxic = texts(rng)
    rows = list(enumerate(clean + toxic))
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= len(clean))) for i, _ in rows if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, {i for i, _ in rows if i >= len(clean)}


def test_pipeline(spark, folder):
    path, rows, toxic_ids = folder
    got = corpus_pipeline.run(spark, path).collect()
    want = brute(rows, toxic_ids)
    assert {r.doc_id: r.doc_tokens for r in got} == want
    assert sum(r.length for r in got) == sum(want.values())
    seen = {}
    for r in got:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 4096 for v in seen.values())


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.dtypes == docs.dtypes, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder[0]).count() == 0, name


def test_one_of_repeated_rows_stays(spark, folder):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7)] * 3 + [(None, "e f g h i", "en", "s", 9)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.simhash_dedup(spark, docs, "").count() == 2


def test_clashing_columns_nulls_and_very_long_texts(spark, folder):
    rng = random.Random(10)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(120_000))
    rows = [(1, long, "a", 1), (2, long + " more", "b", 2), (3, None, "c", 3), (4, "", "d", 4), (None, "x y z", "e", 5)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), r, h) for i, t, r, h in rows], "doc_id long, text string, lang string, source string, n_chars long, __row string, id long")
    kept = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert kept.dtypes == docs.dtypes and sorted(r["__row"] for r in kept.collect()) == ["a", "c", "e"]
    kept.write.mode("overwrite").parquet(f"{folder[0]}/kept.parquet")
    cut_out = corpus_pipeline.suffix_dedup(spark, spark.read.parquet(f"{folder[0]}/kept.parquet"), "")
    assert cut_out.dtypes == docs.dtypes and {r.doc_id: r.n_chars for r in cut_out.collect()}[3] is None
    packed = corpus_pipeline.packing(spark, cut_out, "").collect()
    assert {r.doc_id for r in packed} == {1, 3, None} and sum(r.length for r in packed if r.doc_id == 3) == 1


def test_packing_has_one_worker_a_task_and_the_rows_of_its_two_steps(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    packed = corpus_pipeline.packing(spark, docs, "")
    assert packed._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2  # on either side of the exchange
    two = ffd.pack(ffd.tokenize(docs, WORDS), keep_ids=False)
    assert packed.dtypes == two.dtypes and sorted(packed.collect(), key=str) == sorted(two.collect(), key=str)
