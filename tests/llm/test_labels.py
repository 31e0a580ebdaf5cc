"""License scan, toxicity chain and quotation linking."""

import re
import textwrap

import numpy as np
import pytest

from cohortlake.llm import licenses, quotes, toxicity

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, label string, block int, n_words int"


def naive_scan(text, threshold=0.8):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lower)
    hits = [(i, name) for i in range(len(words)) for p, name in licenses.PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    base = sorted({n for _, n in hits})
    shares = {}
    for name, t in licenses.TEMPLATES.items():
        whole, wide = set(licenses.words_of(t)), licenses.width(t)
        for a in range(0, len(words), wide // 2):
            own = set(words[a : a + wide])
            if len(own & whole) >= threshold * len(whole) - 1e-9 and own.issuperset(licenses.NAMES.get(name, [])):
                shares[name] = max(shares.get(name, 0), len(own & whole) / len(whole))
    at = [i for i, _ in hits]
    return (len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *shares})), 1.0 if hits else max(shares.values(), default=0.0))


def test_license_scan(spark):
    t = licenses.TEMPLATES
    texts = ["", None, "no license here", "MIT License", "the mit\nlicense; CC--BY apache license apache License", "cc by", "xcc by", "GNU General Public Licenses", "...,", "é MİT License ß", "Keep the MIT license"]
    texts += [x + "\nmore words" for x in t.values()] + [x.upper() for x in t.values()]
    texts += [" ".join(x.split()[: int(len(x.split()) * s)]) + " and other words" for x in t.values() for s in (0.5, 0.75, 0.85, 0.95)]
    texts += ["\n".join(t.values()), "word " * 20000 + t["mpl-2.0-notice"], " ".join(reversed(t["isc-header"].split()))]
    rows = [(i, x, "l", 1, 2) for i, x in enumerate(texts)] + [(None, texts[3], None, None, None), (3, texts[3], None, None, None), (3, texts[5], None, None, None)]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, str(r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted(((i, *naive_scan(x)) for i, x, *_ in rows), key=key)
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wrapped_notices_are_found_and_loose_ones_are_not(spark):
    wrapped = {n: "some words before " + "\n// ".join(textwrap.wrap(t, 30)) + "\n and more behind it" for n, t in licenses.TEMPLATES.items()}
    loose = ["Released under the BSD License", "Licensed under CC BY 4.0", "Licensed under the Mozilla License, Version 2.0", "permission is given " + "to write more of it " * 9 + "any person may use this software for free and the documentation of it without a copy " + "as before " * 20 + "restriction and associated files"]
    rows = [(i, x) for i, x in enumerate([*wrapped.values(), *loose])]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(wrapped):
        assert name in got[i].labels.split(",") and got[i].score == 1.0, name
    for i, text in enumerate(loose, len(wrapped)):
        assert set(got[i].labels.split(",")) <= {*got[i].base_labels.split(","), ""}, text


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    got = toxicity.classify(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("toxic", "is_toxic").collect()
    hit = sum(r.is_toxic for r in got if r.toxic)
    false = sum(r.is_toxic for r in got if not r.toxic)
    assert hit >= 0.8 * sum(r.toxic for r in got) and false <= 0.03 * len(got)


def test_toxicity_edge_cases(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    rows = [(1, None), (2, ""), (3, "you idiot and moron, worthless scum"), (3, "you idiot and moron, worthless scum"), (None, "plain words"), (4, "fine " * 50000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, is_toxic string")
    got = toxicity.classify(df, model).collect()
    assert len(got) == 6 and not any(r.is_toxic for r in got if r.doc_id in (None, 1, 2, 4)) and all(r.is_toxic for r in got if r.doc_id == 3)
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "None"]
    none = toxicity.train(docs, labels.where("false"))
    assert not any(r.is_toxic for r in toxicity.classify(df, none).collect())
    assert toxicity.train(docs.where("false"), labels).threshold == 1.0
    only_clean = toxicity.train(docs, labels.where("toxic = 0").unionByName(labels.where("toxic = 0").selectExpr("cast(null as bigint) doc_id", "quality", "cast(null as int) toxic")))
    assert not any(r.is_toxic for r in toxicity.classify(df.where("doc_id = 4"), only_clean).collect())


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(1)
    n = 600
    first = rng.random(n) < 0.4
    second = first ^ (rng.random(n) < 0.05)
    rows, cols = np.flatnonzero(first), np.zeros(first.sum(), np.int64)
    model = toxicity.fit_chain(rows, cols, np.column_stack([first, second]).astype(int), {"w": 0}, ("a", "b"))
    assert model.models[1].chained[0] > 0.2
    p = model.predict(rows, cols, n)
    assert np.mean((p[:, 1] > 0.5) == second) > 0.9


MAIL = [
    (1, 0, "a", "Shall we meet on Monday?\nThe hall is free.\n\nBest"),
    (1, 1, "b", "Tuesday is better."),
    (1, 2, "c", "On Monday a wrote:\n> Shall we meet on Monday?\n> The hall  is FREE!\nYes, Monday."),
    (1, 3, "d", ">> shall we meet on monday\n> Yes, Monday.\nNo.\n> unknown words\n\n\nBye"),
    (1, 4, "e", "> Tuesday is better.\nAgreed"),
    (2, 0, "a", "> Shall we meet on Monday?\nelsewhere"),
    (2, 1, "b", None),
    (None, 1, "b", "> Tuesday is better."),
    (1, None, "b", "no turn"),
    (3, 5, "a", ""),
    (3, 5, "a", ""),
]


def test_quotes_are_linked(spark):
    df = spark.createDataFrame([(*m, "x") for m in MAIL], "conv_id long, turn long, role string, text string, body string")
    got = quotes.conversations(quotes.link(df)).collect()
    assert len(got) == len(MAIL)
    by = {(r.conv_id, r.turn): r for r in got}
    want = {(1, 0): (None, 0, 0, 0, 0), (1, 1): (None, 1, 0, 0, 0), (1, 2): (0, 0, 1, 2, 2), (1, 3): (2, 0, 2, 3, 2), (1, 4): (1, 1, 1, 1, 1), (2, 0): (None, 0, 0, 1, 0)}
    for k, (parent, root, depth, quoted, links) in want.items():
        r = by[k]
        assert (r.parent_turn, r.root_turn, r.depth, r.n_quoted, r.n_linked) == (parent, root, depth, quoted, links), k
    assert by[1, 2].body == "Yes, Monday." and by[1, 3].body == "No.\n\nBye" and by[2, 1].body == ""
    assert [r.turn for r in sorted((r for r in got if r.conv_id == 1 and r.turn is not None), key=lambda r: r.position)] == [0, 2, 3, 1, 4]
    for conv in (1, 2, 3, None):
        assert sorted(r.position for r in got if r.conv_id == conv) == list(range(sum(m[0] == conv for m in MAIL)))
    assert quotes.conversations(quotes.link(df.where("false"))).count() == 0


def test_long_reply_chains(spark):
    chain = [(7, i, "r", (f"> message number {i - 1} stands\n" if i else "") + f"message number {i} stands") for i in range(40)]
    got = quotes.link(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")).collect()
    assert all((r.depth, r.root_turn) == (r.turn, 0) for r in got)


def test_parse_levels():
    assert quotes.parse("a\n> b\n> > c\n>>d\n  >e\n    > f") == [(0, "a"), (1, "b"), (2, "c"), (2, "d"), (1, "e"), (0, "    > f")]
