"""False marks and recall of the chain by length and language, on labelled documents held out."""

import numpy as np

from cohortlake.llm import toxicity


def test_length_adds_no_evidence(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    rows = docs.join(labels.where("doc_id % 2 = 1").dropDuplicates(["doc_id"]), "doc_id").select("doc_id", "text", "lang", "toxic").orderBy("doc_id").collect()
    bad = model.score([r.text or "" for r in rows])[:, -1] >= model.threshold
    toxic, lang, size = np.array([r.toxic for r in rows]), np.array([r.lang for r in rows]), np.array([len(r.text or "") for r in rows])
    rng, joined = np.random.default_rng(0), {}
    for name in ("de", "en", "es", "fr"):
        clean = [r.text for r in rows if r.lang == name and not r.toxic and r.text]
        joined[name] = float(np.mean(model.score([" ".join(rng.choice(clean, 20, replace=False)) for _ in range(30)])[:, -1] >= model.threshold))
    recall = {x: round(float(bad[(toxic == 1) & (lang == x)].mean()), 3) for x in joined}
    false = {a: round(float(bad[(toxic == 0) & (size >= a) & (size < z)].mean()), 4) for a, z in ((0, 2000), (2000, 8000), (8000, 10**9))}
    print("recall", round(float(bad[toxic == 1].mean()), 3), recall, "false", false, "20 joined", joined)
    assert bad[toxic == 1].mean() >= 0.85 and false[8000] <= 0.02
    assert joined["de"] <= 0.2 and joined["en"] <= 0.2 and joined["fr"] <= 0.2


def test_passages_are_whole():
    text = " ".join(f"w{i}" for i in range(1001))
    parts = toxicity.passages(text)
    assert len(parts) == 3 and set().union(*parts) == toxicity.words(text) and toxicity.passages("") == [set()]
    assert toxicity.ChainModel.worst(np.array([[0.1, 0.2], [0.3, 0.9], [0.5, 0.4]]), np.array([2, 1])).tolist() == [[0.3, 0.9], [0.5, 0.4]]


def naive_fit(x, before, y, steps=120, penalty=1e-3):
    """The logistic model on a dense matrix, step by step."""
    n, width, k = len(y), x.shape[1], before.shape[1]
    a = np.c_[x, before, np.ones(n)]
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / n
    theta, m, v = np.zeros(width + k + 1), 0.0, 0.0
    for step in range(1, steps + 1):
        g = a.T @ (weight * (1 / (1 + np.exp(-np.clip(a @ theta, -40, 40))) - y))
        g[:-1] += penalty * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta


def test_chain_and_folds_against_dense_models():
    rng = np.random.default_rng(7)
    n, width, folds = 90, 12, 5
    x = (rng.random((n, width)) < 0.3).astype(float)
    labels = np.c_[x[:, 0] > 0, (x[:, 0] + x[:, 1] > 0) ^ (rng.random(n) < 0.1)].astype(int)
    rows, cols = np.nonzero(x)
    model = toxicity.fit_chain(rows, cols, labels, {str(i): i for i in range(width)}, ("a", "b"), folds)
    fold = np.random.default_rng(3).permutation(n) % folds
    before = np.zeros((n, 0))
    for c in range(2):
        y = labels[:, c].astype(float)
        theta = naive_fit(x, before, y)
        assert np.allclose(np.r_[model.models[c].weights, model.models[c].chained, model.models[c].bias], theta, atol=1e-6)
        out = np.zeros(n)
        for f in range(folds):
            own = fold == f
            out[own] = 1 / (1 + np.exp(-np.c_[x, before, np.ones(n)][own] @ naive_fit(x[~own], before[~own], y[~own])))
        before = np.c_[before, out]
    assert np.isclose(model.threshold, toxicity.best_threshold(before[:, 1], labels[:, 1]), atol=1e-6)


def test_classify_against_plain_loops(spark):
    rng = np.random.default_rng(8)
    known = ["idiot", "scum", "plain", "idio*", "scu*", "word*", "worthl*"]
    model = toxicity.ChainModel({w: i for i, w in enumerate(known)}, ("a", "b"), [toxicity.Logistic(rng.normal(size=7), 0.2, np.zeros(0)), toxicity.Logistic(rng.normal(size=7), -0.3, np.array([1.5]))], 0.55)
    vocabulary = ["Idiot!", "scum", "plain", "worthless", "wording", "other", "x" * 60]
    texts = [" ".join(rng.choice(vocabulary, size=size)) for size in (1, 3, 5, 399, 401, 1500, 2)] + ["", None, "idiot, idiots; scum"]
    got = {r.doc_id: (r.p_a, r.p_b, r.is_toxic) for r in toxicity.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        found = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        n = max(1, -(-len(found) // 400))
        judged = []
        for k in range(n):
            own = set()
            for w in found[k * len(found) // n : (k + 1) * len(found) // n]:
                own |= {w} | {w[:m] + "*" for m in range(4, 9) if len(w) > m}
            p = []
            for part in model.models:
                z = part.bias + sum(part.weights[model.vocabulary[o]] for o in own if o in model.vocabulary) + sum(a * b for a, b in zip(p, part.chained))
                p.append(1 / (1 + np.exp(-z)))
            judged.append(p)
        worst = max(judged, key=lambda p: p[-1])
        assert np.allclose(got[i][:2], worst) and got[i][2] == (bool(t) and worst[-1] >= 0.55)
