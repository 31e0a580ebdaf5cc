"""Toxicity by a chain of linear classifiers.

Categories, columns of the given labels, are predicted one after the other:
each logistic model sees the words of the text and the probabilities that the
models before it gave. For training, those probabilities are out-of-fold
predictions, so a later model never learns from a fit on the same document.
The last category decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_text, cut, schema

#: Columns of the labels (0 or 1) in the chain's order; the last one decides.
CHAIN = ("quality", "toxic")

_BREAKS = {c: " " for c in range(0x80) if not chr(c).isalnum()} | {ord(c): " " for c in "‘’“”–—…«»"}


def words(text: str) -> set[str]:
    """Distinct lower-case words."""
    return set(text.lower().translate(_BREAKS).split())


def passages(text: str, most: int = 400) -> list[set[str]]:
    """Distinct words of even parts of at most ``most`` words; one empty part if there are none."""
    found = text.lower().translate(_BREAKS).split()
    n = max(1, -(-len(found) // most))
    return [set(found[i * len(found) // n : (i + 1) * len(found) // n]) for i in range(n)]


def traits(word: str) -> tuple[str, ...]:
    """A word and its longer beginnings (marked by ``*``), so that inflected forms count alike."""
    return (word, *(f"{word[:k]}*" for k in range(4, 9) if len(word) > k))


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float
    chained: np.ndarray

    def logit(self, rows: np.ndarray, cols: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        return np.bincount(rows, self.weights[cols], n) + before @ self.chained + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, before: np.ndarray, y: np.ndarray, width: int, penalty: float = 1e-3, steps: int = 120) -> Logistic:
    """Logistic regression on binary word features and dense ``before``, by Adam on the whole batch, classes weighted to even halves."""
    n, k = len(y), before.shape[1]
    share = y.mean()
    weight = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / max(n, 1)
    theta = np.zeros(width + k + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.bincount(rows, theta[cols], n) + before @ theta[width : width + k] + theta[-1]
        d = weight * (sigmoid(z) - y)
        g = np.r_[np.bincount(cols, d[rows], width), d @ before, d.sum()]
        g[:-1] += penalty * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Logistic(theta[:width], float(theta[-1]), theta[width : width + k])


@dataclass
class ChainModel:
    """The fitted chain: columns of words, a model per category, and the threshold of the last category's probability."""

    vocabulary: dict[str, int]
    names: tuple[str, ...]
    models: list[Logistic]
    threshold: float

    def predict(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 0))
        for model in self.models:
            out = np.c_[out, sigmoid(model.logit(rows, cols, n, out))]
        return out

    def score(self, texts: list[str], seen: dict[str, tuple[int, ...]] | None = None, most: int = 100_000) -> np.ndarray:
        """Probabilities, one row for each text and one column for each category: those of its worst passage.

        So words that are met by chance do not add up with a text's length.
        ``seen`` keeps the columns of up to ``most`` words from call to call.
        """
        seen, known, hits, sizes = {} if seen is None else seen, self.vocabulary, [], []
        for t in texts:
            parts = passages(t)
            sizes.append(len(parts))
            for found in parts:
                own: set[int] = set()
                for w in found:
                    cols = seen.get(w)
                    if cols is None:
                        cols = tuple(known[x] for x in traits(w) if x in known)
                        if len(w) <= 40:  # longer ones hardly come again
                            if len(seen) >= most:
                                seen.clear()
                            seen[w] = cols
                    own.update(cols)
                hits.append(own)
        rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
        cols = np.fromiter((c for h in hits for c in h), np.int64, len(rows))
        return self.worst(self.predict(rows, cols, len(hits)), np.array(sizes, np.int64))

    @staticmethod
    def worst(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of runs of ``sizes`` rows, the first row of the highest probability in the last column."""
        own = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((-p[:, -1], own))
        return p[order[np.cumsum(sizes) - sizes]]


def held_out(rows: np.ndarray, cols: np.ndarray, before: np.ndarray, y: np.ndarray, width: int, fold: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Probability of every text, and of each of its passages, from a model fitted on the other folds.

    ``parts``: the passages' rows, columns, owners and earlier probabilities.
    """
    part_rows, part_cols, owner, judged = parts
    whole, by_part = np.zeros(len(y)), np.zeros(len(owner))
    for f in np.unique(fold):
        train = fold != f
        inner = train[rows]
        renumber = np.cumsum(train) - 1
        model = fit_logistic(renumber[rows[inner]], cols[inner], before[train], y[train], width)
        whole[~train] = sigmoid(model.logit(rows, cols, len(y), before))[~train]
        out = ~train[owner]
        by_part[out] = sigmoid(model.logit(part_rows, part_cols, len(owner), judged))[out]
    return whole, by_part


def fit_chain(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, vocabulary: dict[str, int], names: tuple[str, ...], folds: int = 5, seed: int = 3, parts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> ChainModel:
    """Fit the chain on sparse word features; ``labels`` has one 0/1 column for each name, in the chain's order.

    ``parts``: rows and columns of the texts' passages and the number of each
    text's, on which held-out probabilities for the threshold are taken, as in
    :meth:`ChainModel.score`; without them texts are one passage.
    """
    n, width = len(labels), len(vocabulary)
    part_rows, part_cols, sizes = parts or (rows, cols, np.ones(n, np.int64))
    owner = np.repeat(np.arange(n), sizes)
    fold = np.random.default_rng(seed).permutation(n) % folds
    before, models, judged = np.zeros((n, 0)), [], np.zeros((len(owner), 0))
    for c in range(len(names)):
        y = labels[:, c].astype(float)
        whole, by_part = held_out(rows, cols, before, y, width, fold, (part_rows, part_cols, owner, judged))
        models.append(fit_logistic(rows, cols, before, y, width))
        before, judged = np.c_[before, whole], np.c_[judged, by_part]
    return ChainModel(vocabulary, names, models, best_threshold(ChainModel.worst(judged, sizes)[:, -1], labels[:, -1]) if n else 0.5)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the widest-margin cut of best F1 on out-of-fold probabilities; 0.5 without positives."""
    if not y.any():
        return 0.5
    order = np.argsort(-p)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = 0
    at = int(np.argmax(f1))
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + below) / 2)


def _few(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that few texts' words are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = 12_000, features: int = 4096, fewest: int = 4, categories: tuple[str, ...] = CHAIN) -> ChainModel:
    """Fit the chain on at most ``sample`` labelled documents, those of least hash of their keys.

    Words and beginnings of words in at least ``fewest`` of them compete for
    ``features`` columns by the chi-square of their excess in documents with or
    without the last category. Only the sample's labels are broadcast and only
    its sparse features (at most ``sample`` x ``features`` short numbers) reach
    the driver. Rows with a null key or category are left out, keys that repeat
    count once (the largest label, the first text in order); without any labels
    nothing is marked.
    """
    last = categories[-1]
    usable = F.col(key).isNotNull()
    for c in categories:
        usable = usable & F.col(c).isin(0, 1)
    given = labels.where(usable).groupBy(key).agg(*[F.max(c).cast("int").alias(f"_{i}") for i, c in enumerate(categories)])
    total, h = given.count(), F.pmod(F.xxhash64(key, F.lit("train")), F.lit(1 << 40))
    share = min(1.0, (sample + 6 * sample**0.5) / max(1, total))
    given = given.where(h < int(share * (1 << 40))).orderBy(h, key).limit(sample)
    given = given.select(key, F.array(*[f"_{i}" for i in range(len(categories))]).alias("_labels"))

    def split(texts: list[str], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([[sorted(x) for x in passages(t)] for t in texts], pa.list_(pa.list_(pa.string())))], [key, "labels", "parts"])

    picked = docs.select(key, F.col("text").cast("string").alias("_text")).join(F.broadcast(given), key).groupBy(key).agg(F.first("_labels").alias("_labels"), F.min("_text").alias("_text"))
    seen = cut(picked.mapInArrow(by_text("_text", split, 1 << 20), schema(picked, key, labels="array<int>", parts="array<array<string>>")))
    n1, n0 = seen.agg(F.count_if(F.get("labels", F.lit(len(categories) - 1)) == 1), F.count_if(F.get("labels", F.lit(len(categories) - 1)) == 0)).first()

    def count(batches):
        def rows() -> pa.RecordBatch:
            both = list(held[0].keys() | held[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([held[c][t] for t in both], pa.int64()) for c in (1, 0))], ["trait", "a", "b"])

        held = Counter(), Counter()
        for b in _few(batches):
            for marks, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                held[marks[-1]].update({t for x in parts for w in x for t in traits(w)})
            if len(held[0]) + len(held[1]) > 200_000:
                yield rows()
                held = Counter(), Counter()
        yield rows()

    counts = seen.mapInArrow(count, "trait string, a long, b long").groupBy("trait").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") >= fewest)
    held, share = F.col("a") + F.col("b"), n1 / max(1, n1 + n0)
    excess = F.col("a") - held * share
    chi = excess * excess / (held * max(share, 1e-9)) / (1 - held / F.lit(n1 + n0) + 1e-9)
    chosen = [r["trait"] for r in counts.orderBy(chi.desc(), "trait").limit(features).collect()]
    vocabulary = {t: i for i, t in enumerate(chosen)}

    def encode(batches):
        for b in _few(batches):
            cols, parts = [], []
            for split_up in b.column(2).to_pylist():
                held = {w: [vocabulary[t] for t in traits(w) if t in vocabulary] for w in set().union(*split_up)}
                cols.append(sorted({c for x in held.values() for c in x}))
                parts.append([sorted({c for w in x for c in held[w]}) for x in split_up])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols, pa.list_(pa.int32())), pa.array(parts, pa.list_(pa.list_(pa.int32())))], [key, "labels", "cols", "parts"])

    got = seen.mapInArrow(encode, schema(seen, key, "labels", cols="array<int>", parts="array<array<int>>")).orderBy(F.xxhash64(key), key).toArrow()
    if not got.num_rows:
        return ChainModel({}, categories, [Logistic(np.zeros(0), 0.0, np.zeros(i)) for i in range(len(categories))], 1.0)

    def sparse(lists: list) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([c for x in lists for c in x], np.int64)

    parts = got["parts"].to_pylist()
    sizes = np.array([len(x) for x in parts], np.int64)
    return fit_chain(*sparse(got["cols"].to_pylist()), np.array(got["labels"].to_pylist()), vocabulary, categories, parts=(*sparse([x for p in parts for x in p]), sizes))


def _judge(model, text_col: str, rows):
    """mapInArrow: ``rows(p, marked, part)`` of each part; columns of words are kept for the length of the task only."""

    def run(batches):
        seen: dict[str, tuple[int, ...]] = {}

        def part_of(texts: list[str], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            p = model.value.score(texts, seen)
            yield rows(p, (p[:, -1] >= model.value.threshold) & np.array([bool(t) for t in texts], bool), part)

        yield from by_text(text_col, part_of, 1 << 20)(batches)

    return run


def classify(docs: DataFrame, model: ChainModel, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key``, a probability ``p_<category>`` for each category, and ``is_toxic`` for every row.

    Whole texts are read, very long ones passage by passage; null and empty
    texts have no words and are judged by the models' constants alone, which
    mark nothing. Repeated rows and null keys stay; an empty table gives no
    rows; other columns are not read. The model (``features`` numbers for each
    category) is broadcast.
    """
    names = [f"p_{n}" for n in model.names]

    def rows(p: np.ndarray, bad: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(c)) for c in p.T), pa.array(bad)], [key, *names, "is_toxic"])

    source = docs.select(key, F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(model), "_text", rows), schema(source, key, **dict.fromkeys(names, "double"), is_toxic="boolean"))


def keep_clean(docs: DataFrame, model: ChainModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the chain does not mark as toxic; null and empty texts stay."""

    def rows(p: np.ndarray, bad: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array(~bad))

    return docs.mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(model), text_col, rows), schema(docs, *docs.columns))
