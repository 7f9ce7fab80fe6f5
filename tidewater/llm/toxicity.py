"""Toxicity: a chain of linear models over words and word beginnings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, chunks, segment_hash, text_bytes
from .common import discard, save, ship
from .quality import training_rows

#: Most labelled texts the chain is fitted on; features that are looked at, those of most documents; features that a model keeps.
TRAINING_ROWS, CANDIDATES, FEATURES = 8_000, 32_768, 1_024
#: Categories of toxic documents besides toxic itself, and folds of the out-of-fold predictions.
KINDS, FOLDS = 2, 5
#: Beginnings of words that are features, in bytes.
BEGINNINGS = (4, 6)
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(doc, feature): the distinct hashes of each text's words and beginnings of words, of the whole text.
    A word is a run of letters and digits; letters of ASCII and Latin-1 are lower-cased."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    low = LOWER[data]
    accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1 if len(data) else np.zeros(0, np.int64)
    low[accented] += 0x20
    inside = LETTER[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1 : len(low)]
    stops[:-1] &= ~inside[1:] | edge[1 : len(low)]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    kinds = [segment_hash(low, starts, ends)]
    docs = [doc]
    for size in BEGINNINGS:
        some = ends - starts > size
        kinds.append(segment_hash(low, starts[some], starts[some] + size) ^ np.uint64(size))
        docs.append(doc[some])
    doc, feature = np.concatenate(docs), np.concatenate(kinds)
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1]))[: len(doc)]
    return doc[fresh], feature[fresh]


@dataclass
class Linear:
    """Log-odds = bias + weights of the features present + chain @ earlier probabilities. Features go by their places among the candidates."""

    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def probability(self, doc: np.ndarray, place: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        total = np.full(n, self.bias) + (earlier @ self.chain if earlier.shape[1] else 0)
        total += np.bincount(doc, self.weights[place], n)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


@dataclass
class Chain:
    """The models in order, the last for toxic; the features they know, ascending; and the probability from which on a document is toxic."""

    names: np.ndarray
    models: list[Linear]
    threshold: float


def excess_of(doc: np.ndarray, place: np.ndarray, y: np.ndarray, n_places: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """How many documents have each feature, and by how many deviations the positive ones among them are more than expected."""
    present = np.bincount(place, minlength=n_places)
    expected = present * share
    excess = (np.bincount(place, y[doc], n_places) - expected) / np.sqrt(expected * (1 - share) + 0.5)
    excess[present < 2] = 0
    return present, excess


def fit_linear(doc: np.ndarray, place: np.ndarray, n_places: int, y: np.ndarray, use: np.ndarray, earlier: np.ndarray, most: int = FEATURES, rounds: int = 120, ridge: float = 1e-3) -> Linear:
    """Logistic regression on the rows where ``use`` holds. Of all features those stay whose presence tells most about the label."""
    n, count = len(y), max(1, int(use.sum()))
    share = float(np.clip(y[use].sum() / count, 1e-4, 1 - 1e-4))
    weights, v, b = np.zeros(n_places), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share)))
    if not n_places or not 0 < y[use].sum() < count:
        return Linear(weights, v, b)
    keep = use[doc]
    doc, place = doc[keep], place[keep]
    excess = np.abs(excess_of(doc, place, y, n_places, share)[1])
    best = np.argsort(-excess, kind="stable")[:most]
    best = np.sort(best[excess[best] > 3])
    where = np.full(n_places, -1)
    where[best] = np.arange(len(best))
    hit = where[place] >= 0
    d, c = doc[hit], where[place[hit]]
    w = np.zeros(len(best))
    heat = [np.full(len(best), 1e-3), np.full(len(v), 1e-3), 1e-3]  # sums of squared gradients
    for _ in range(rounds):
        total = b + np.bincount(d, w[c], n) + (earlier @ v if len(v) else 0)
        off = np.where(use, 1 / (1 + np.exp(-np.clip(total, -40, 40))) - y, 0)
        grads = [np.bincount(c, off[d], len(best)) / count + ridge / 10 * w, earlier.T @ off / count + ridge * v, float(off.sum() / count)]
        heat = [h + g * g for h, g in zip(heat, grads, strict=True)]
        w = w - 0.5 * grads[0] / np.sqrt(heat[0])
        v = v - 0.3 * grads[1] / np.sqrt(heat[1])
        b = float(b - 0.3 * grads[2] / np.sqrt(heat[2]))
    weights[best] = w
    return Linear(weights, v, b)


def kinds_of(doc: np.ndarray, place: np.ndarray, n_places: int, toxic: np.ndarray, kinds: int = KINDS, telling: int = 256, rounds: int = 20) -> np.ndarray:
    """For each row the category of toxic documents it belongs to, -1 for the others: clusters by cosine of the features that tell most
    about the label. The first center is the toxic row with most of these features, each further one the row least like those before."""
    out = np.full(len(toxic), -1)
    share = float(np.clip(toxic.mean() if len(toxic) else 0, 1e-4, 1 - 1e-4))
    excess = excess_of(doc, place, toxic, n_places, share)[1]
    best = np.sort(np.argsort(-excess, kind="stable")[:telling])
    best = best[excess[best] > 3]
    rows = np.flatnonzero(toxic > 0)
    if not len(best) or len(rows) < 2 * kinds:
        return out
    where, line = np.full(n_places, -1), np.full(len(toxic), -1)
    where[best], line[rows] = np.arange(len(best)), np.arange(len(rows))
    hit = (where[place] >= 0) & (line[doc] >= 0)
    x = np.zeros((len(rows), len(best)))
    x[line[doc[hit]], where[place[hit]]] = 1
    some = x.sum(1) > 0
    x, rows = x[some] / np.sqrt(x[some].sum(1))[:, None], rows[some]
    if len(rows) < 2 * kinds:
        return out
    centers = [x[np.argmax((x > 0).sum(1))]]
    while len(centers) < kinds:
        centers.append(x[np.argmin(np.max([x @ c for c in centers], axis=0))])
    middle = np.array(centers)
    for _ in range(rounds):
        own = np.argmax(x @ middle.T, axis=1)
        sums = np.array([x[own == k].sum(0) for k in range(kinds)])
        middle = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), middle)
    out[rows] = np.argmax(x @ middle.T, axis=1)
    return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Halfway between the two neighbouring probabilities between which a cut gives the best F1; one half where there is nothing to choose by."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = -1  # no cut between equals
    k = int(np.argmax(f1))
    below = p[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((p[order[k]] + below) / 2)


def fit_chain(names: np.ndarray, doc: np.ndarray, place: np.ndarray, labels: list[np.ndarray], folds: np.ndarray) -> Chain:
    """One model per category, in order. The later ones see the earlier categories' probabilities; in training these come
    from models that haven't seen the row, so that a later model learns how far to trust them. The threshold comes from
    such predictions of the last category."""
    n = len(folds)
    earlier = np.zeros((n, 0))
    models = []
    for y in labels:
        models.append(fit_linear(doc, place, len(names), y, np.ones(n, bool), earlier))
        out = np.zeros(n)
        for fold in range(FOLDS):
            held = folds == fold
            out[held] = fit_linear(doc, place, len(names), y, ~held, earlier).probability(doc, place, n, earlier)[held]
        earlier = np.column_stack([earlier, out])
    return Chain(names, models, best_threshold(earlier[:, -1], labels[-1]))


def places_of(names: np.ndarray, doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (doc, feature) whose feature is one of the names, and its place there."""
    if not len(names):
        return doc[:0], doc[:0]
    at = np.minimum(np.searchsorted(names, feature), len(names) - 1)
    hit = names[at] == feature
    return doc[hit], at[hit]


def predict_chain(chain: Chain, texts: pa.Array) -> np.ndarray:
    doc, place = places_of(chain.names, *features_of(texts))
    found = np.zeros((len(texts), 0))
    for model in chain.models:
        found = np.column_stack([found, model.probability(doc, place, len(texts), found)])
    return found


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, candidates: int = CANDIDATES) -> Chain:
    """The chain, fitted on a bounded sample of labelled texts: first the categories, clusters of the toxic ones among them, then toxic itself.

    The tasks that read the texts turn them into hashes of features, which go to the shared folder. The driver gets the ``candidates`` features
    that most of these texts have, then for each text which of them it has, in an order that reruns share: at most ``most`` rows of at most
    ``candidates`` numbers of two bytes, however long the texts are.

    Nulls: rows with a null label or identifier are not learnt from; a null text counts as empty. Without toxic rows, or with none but those, the
    chain gives every text their share. Repeated rows count once. Other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            doc, feature = features_of(batch.column(3))
            edges = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(edges, feature.view(np.int64))], names=["label", "doc_id", "tkey", "x"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3)
            doc = np.repeat(np.arange(len(x)), np.diff(np.asarray(x.offsets)))
            doc, at = places_of(names, doc, x.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            edges = np.searchsorted(doc, np.arange(len(x) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(edges, at.astype(np.int16))], names=["label", "doc_id", "tkey", "x"])

    rows = training_rows(docs, labels, "toxic", most).mapInArrow(measure, f"label double, doc_id {kind}, tkey long, x array<long>")
    sample = save(rows.dropDuplicates(["doc_id", "tkey"]), "toxicity-sample")
    frequent = sample.select(F.explode("x").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "name").limit(candidates)
    names = np.sort(frequent.select("name").toArrow()["name"].to_numpy().view(np.uint64))
    placed = sample.mapInArrow(place, f"label double, doc_id {kind}, tkey long, x array<short>")
    found = placed.orderBy(F.xxhash64("doc_id", "tkey"), "doc_id", "tkey").select("label", "x").toArrow()
    discard(sample)
    x = found["x"].combine_chunks()
    sizes = np.diff(np.asarray(x.offsets)) if len(x) else np.zeros(0, int)
    doc, at = np.repeat(np.arange(len(x)), sizes), x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    toxic = (found["label"].to_numpy() > 0).astype(float)
    kinds = kinds_of(doc, at, len(names), toxic)
    return fit_chain(names, doc, at, [*((kinds == k).astype(float) for k in range(KINDS)), toxic], np.arange(len(x)) % FOLDS)


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, a probability for each category of the chain (p_kind_1, p_kind_2) and ``score``, that of toxic.

    Nulls: a null text counts as empty and gets the chain's score without features; a null identifier is passed through. Repeated rows are
    scored alike; an empty table gives no rows. Texts are read whole; nothing is shuffled. Other columns are ignored.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [*(f"p_kind_{k + 1}" for k in range(len(chain.models) - 1)), "score"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            p = predict_chain(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, k]) for k in range(p.shape[1])]], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(apply, f"doc_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in names))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    toxic = F.col("score") >= chain.threshold
    return score_toxicity(docs, chain).withColumns({"held_out": held_out, "predicted": toxic.cast("int"), "toxic": toxic})
