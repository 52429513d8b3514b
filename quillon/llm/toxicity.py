"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import pieces

#: log2 of the number of hashed features; labelled documents to fit on, at most; passes over them.
BITS, SAMPLE, PASSES = 20, 20_000, 3
#: FTRL's learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 8.0, 1.0
#: Of the sample, held out to choose the threshold.
HELD_OUT = 0.2


@dataclass
class Model:
    """Weights that aren't zero; a document is toxic if its score reaches the threshold."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    threshold: float
    bits: int
    held_out: dict[str, float]


def features(hashes: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of all words, word pairs, and pairs with one word between."""
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    shift = np.uint64(64 - bits)
    out_doc, out = [doc], [_text.mix(hashes ^ np.uint64(0xA5A5)) >> shift]
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(hashes) > gap:
            same = doc[gap:] == doc[:-gap]
            out_doc.append(doc[gap:][same])
            out.append((_text.mix(hashes[:-gap] * np.uint64(factor) + hashes[gap:]) >> shift)[same])
    return np.concatenate(out_doc), np.concatenate(out).astype(np.int64)


def fit_arrays(texts: list[np.ndarray], labels: np.ndarray, bits: int, passes: int = PASSES) -> Model:
    """Fit on sorted feature sets; the last HELD_OUT of them choose the threshold."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    cut = len(texts) - int(len(texts) * HELD_OUT)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(passes):
        for x, y in zip(texts[:cut], labels[:cut].tolist(), strict=True):
            zi, ni = z[x], n[x]
            w = weights(zi, ni)
            wb = -zb / ((BETA + nb**0.5) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            g = float(p - y)
            root = np.sqrt(ni + g * g)
            z[x] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
            n[x] = ni + g * g
            rb = (nb + g * g) ** 0.5
            zb, nb = zb + g - (rb - nb**0.5) / ALPHA * wb, nb + g * g
    w = weights(z, n)
    bias = -zb / ((BETA + nb**0.5) / ALPHA)
    judged, truth = (texts[cut:], labels[cut:]) if len(set(labels[cut:].tolist())) == 2 else (texts, labels)
    scores = np.array([w[x].sum() + bias for x in judged])
    threshold, held_out = choose_threshold(scores, truth)
    index = np.flatnonzero(w)
    return Model(index, w[index], float(bias), threshold, bits, held_out)


def choose_threshold(scores: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, float]]:
    """The score that gives the best F1, in the middle of its gap; with no toxic document, none is caught."""
    if not (truth == 1).any():
        return float("inf"), {"f1": 0.0, "precision": 0.0, "recall": 0.0}
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], truth[order]
    hits = np.cumsum(y)
    ends = np.append(s[1:] != s[:-1], True)
    recall, precision = hits / hits[-1], hits / np.arange(1, len(y) + 1)
    f1 = np.where(ends & (hits > 0), 2 * recall * precision / np.maximum(recall + precision, 1e-12), -1.0)
    i = int(f1.argmax())
    below = s[i + 1] if i + 1 < len(s) else s[i] - 1.0
    return float((s[i] + below) / 2), {"f1": float(f1[i]), "precision": float(precision[i]), "recall": float(recall[i])}


def _train(bits: int, passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, np.ndarray]] = []
        for batch in pieces(batches, "text"):
            w = _text.words(batch.column("text"))
            doc, f = features(w.hashes, w.first, bits)
            pairs = np.unique((doc << np.int64(bits)) | f)
            cuts = np.searchsorted(pairs >> np.int64(bits), np.arange(batch.num_rows + 1))
            f = (pairs & np.int64((1 << bits) - 1)).astype(np.int32)
            place, toxic = batch.column("place").to_pylist(), batch.column("toxic").to_pylist()
            rows += [(place[i], toxic[i], f[cuts[i] : cuts[i + 1]].copy()) for i in range(batch.num_rows)]
        rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        if not rows:
            return
        m = fit_arrays([r[2] for r in rows], np.array([r[1] for r in rows]), bits, passes)
        h = m.held_out
        yield pa.record_batch([pa.array([m.index.tolist()], pa.list_(pa.int32())), pa.array([m.weight.tolist()], pa.list_(pa.float64())), pa.array([m.bias]), pa.array([m.threshold]), *(pa.array([h[k]]) for k in ("f1", "precision", "recall"))], names=["index", "weight", "bias", "threshold", "f1", "precision", "recall"])

    return run


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE, passes: int = PASSES) -> Model | None:
    """Fit on labelled documents; None where there are none.

    ``sample`` bounds the labelled documents that are used: those with the
    smallest hashes of doc_id, the same at every size. Labels that are null, or
    whose doc_id is null or has no document, aren't used; of several labels of
    one document the greatest counts.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(sample)
    # at most ``sample`` ids, so this side's size is bounded whatever the data
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id").select("place", "toxic", "text")
    got = rows.repartition(1).mapInArrow(_train(bits, passes), "index array<int>, weight array<double>, bias double, threshold double, f1 double, precision double, recall double").first()
    if got is None:
        return None
    return Model(np.array(got["index"], dtype=np.int64), np.array(got["weight"]), got["bias"], got["threshold"], bits, {k: got[k] for k in ("f1", "precision", "recall")})


def score_batch(column: pa.Array, model: Model, dense: np.ndarray) -> np.ndarray:
    """Score of each text: the weights of the features it has."""
    w = _text.words(column)
    doc, f = features(w.hashes, w.first, model.bits)
    some = np.flatnonzero(dense[f])
    pairs = np.unique((doc[some] << np.int64(model.bits)) | f[some])
    return np.bincount(pairs >> np.int64(model.bits), weights=dense[pairs & np.int64((1 << model.bits) - 1)], minlength=len(column)) + model.bias


def score(docs: DataFrame, model: Model | None, passing: bool = False) -> DataFrame:
    """All rows with their score and whether they are toxic.

    Returns (doc_id, score, toxic); with ``passing`` all columns of docs, less
    the toxic rows. A null or empty text has only the bias and is never toxic;
    texts of any length count whole. Without a model (no labels) nothing is toxic
    and the score is null. Every row is judged by itself, repeated ones alike; a
    score equal to the threshold is toxic. Extra columns, whatever their names,
    play no part; an empty table gives no rows.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    if model is None:
        return docs.select(*own) if passing else docs.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("toxic"))
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = weights.value
        dense = np.zeros(1 << m.bits)
        dense[m.index] = m.weight
        for batch in pieces(batches, "text"):
            scores = score_batch(batch.column("text"), m, dense)
            some = np.diff(_text.utf8(batch.column("text"))[0]) > 0
            toxic = (scores >= m.threshold) & some
            if passing:
                yield batch.filter(pa.array(~toxic))
            else:
                yield pa.record_batch([batch.column("doc_id"), pa.array(scores), pa.array(toxic)], names=["doc_id", "score", "toxic"])

    if passing:
        return docs.select(*own).mapInArrow(run, docs.schema)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, toxic boolean")
