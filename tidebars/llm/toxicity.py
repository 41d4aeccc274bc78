"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a score, the logistic of a bias and the weights of its distinct words
(hashed); a document is toxic if one of its sentences is, so its score is their noisy-or, 1 - prod(1 - p). Only documents
are labelled: the weights maximise the likelihood of their labels through the noisy-or, with a penalty on every weight,
and the sentence scores that come out of it locate what offends. When documents are scored, sentences below ``FLOOR`` speak
through the best of them only: a text is not toxic for being long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm._shared import slices

BUCKETS = 1 << 18
#: A sentence's score from which on it adds to its document's.
FLOOR = 0.02
_SENTENCE = re.compile(r"[^.!?|\n]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Bias and one weight for each hash bucket."""

    bias: float
    weights: np.ndarray


def held_out(doc_id: str) -> Column:
    """Whether a row is kept from training: crc32 of its doc_id as text is divisible by 5. Null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def bucket(word: str) -> int:
    return xxhash.xxh64_intdigest(word) % BUCKETS


class _Memo(dict):
    """Word -> ``f(word)``, forgotten when full."""

    def __init__(self, f) -> None:
        self.f = f

    def __missing__(self, word: str):
        if len(self) >= 300_000:
            self.clear()
        self[word] = out = self.f(word)
        return out


def bags(rows: DataFrame) -> DataFrame:
    """(doc_id, toxic, ids, sizes): the distinct word buckets of each sentence of each row, one sentence after the other, and
    their numbers; both as little-endian 32-bit integers, which keeps a sample small on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(bucket)
        for b in slices(batches):
            ids, sizes = [], []
            for t in b.column("text").to_pylist():
                found = [x for s in _SENTENCE.findall((t or "").lower()) if (x := {memo[w] for w in _WORD.findall(s)})]
                ids.append(np.array([i for x in found for i in sorted(x)], "<i4").tobytes())
                sizes.append(np.array([len(x) for x in found], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(ids, pa.binary()), pa.array(sizes, pa.binary())], ["doc_id", "toxic", "ids", "sizes"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "toxic", "text").mapInArrow(run, f"doc_id {kind}, toxic int, ids binary, sizes binary")


def fit(ids: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, sample_weight: np.ndarray, epochs: int = 120, penalty: float = 1e-4) -> Model:
    """Gradient ascent (Adam) on the noisy-or likelihood. ``ids`` and ``sizes``: each document's sentences as in ``bags``.

    Words of fewer than three documents are left out, and an L1 penalty keeps only words that tell.
    """
    prior = float((sample_weight * labels).sum() / max(sample_weight.sum(), 1e-9))
    docs = [i for i, s in enumerate(sizes) if len(s)]
    if not docs or prior <= 0 or prior >= 1:
        return Model(-8.0 if prior < 1 else 0.0, np.zeros(BUCKETS))
    spread = np.zeros(BUCKETS, np.int32)
    for i in docs:
        spread[np.unique(ids[i])] += 1
    used = np.flatnonzero(spread >= 3)
    slot = np.full(BUCKETS, -1, np.int32)
    slot[used] = np.arange(len(used))
    per_doc = np.array([len(sizes[i]) for i in docs])
    of_doc = np.repeat(np.arange(len(docs), dtype=np.int32), per_doc)
    index = slot[np.concatenate([ids[i] for i in docs])]
    of_sentence = np.repeat(np.arange(len(of_doc), dtype=np.int32), np.concatenate([sizes[i] for i in docs]))[index >= 0]
    index = index[index >= 0]
    y, weight = labels[docs].astype(float), sample_weight[docs]
    w, bias, total = np.zeros(len(used)), -6.0, weight.sum()
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    doc_starts = np.cumsum(per_doc) - per_doc
    for t in range(1, epochs + 1):
        z = bias + np.bincount(of_sentence, w[index], len(of_doc))
        p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
        none = np.exp(np.add.reduceat(np.log1p(-p), doc_starts))
        pull = weight * np.where(y > 0, none / np.maximum(1 - none, 1e-9), -1.0) / total
        g = pull[of_doc] * p
        grad = np.append(np.bincount(index, g[of_sentence], len(used)), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        scale = np.sqrt(v / (1 - 0.99**t)) + 1e-8
        step = 0.3 * (m / (1 - 0.9**t)) / scale
        pulled = w + step[:-1]
        w = np.sign(pulled) * np.maximum(np.abs(pulled) - 0.3 * penalty / scale[:-1], 0)
        bias += step[-1]
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return Model(float(bias), weights)


def train(docs: DataFrame, labels: DataFrame, most: int = 8_000, most_chars: int = 100_000) -> Model:
    """Fit on labelled rows that are not held out: at most ``most``, half of them toxic, drawn by a hash of the doc_id, less
    those of more than ``most_chars`` characters (which are scored whole like all others).

    So what is collected is bounded: word buckets of ``most`` documents of ``most_chars`` characters. Either class counts by
    its share of all labels. Labels without doc_id or value are left out; rows of a doc_id that is labelled twice count twice.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out("doc_id"))
    sizes = dict(known.groupBy("toxic").count().collect())
    order = F.xxhash64(F.col("doc_id").cast("string"))
    sample = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(most // 2)
        sample = part if sample is None else sample.unionByName(part)
    rows = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= most_chars).join(F.broadcast(sample), "doc_id")  # of `most` rows at most
    got = sorted(bags(rows).collect(), key=lambda r: (str(r["doc_id"]), r["toxic"]))
    y = np.array([r["toxic"] for r in got])
    share = {c: sizes.get(c, 0) / max((y == c).sum(), 1) for c in (0, 1)}
    ids, sizes_ = ([np.frombuffer(r[c], "<i4") for r in got] for c in ("ids", "sizes"))
    return fit(ids, sizes_, y, np.array([share[c] for c in y.tolist()]))


def sentence_scores(text: str | None, bias: float, memo) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Places and scores of the sentences with words."""
    z, at = [], []
    for s in _SENTENCE.finditer((text or "").lower()):
        words = set(_WORD.findall(s[0]))
        if words:
            z.append(sum(map(memo.__getitem__, words)))
            at.append(s.span())
    return at, 1 / (1 + np.exp(-np.maximum(bias + np.array(z, float), -500)))


def noisy_or(p: np.ndarray) -> float:
    """Score of a document: noisy-or of the sentences from FLOOR on and the best of those below."""
    if not len(p):
        return 0.0
    low = p[p < FLOOR]
    p = np.append(p[p >= FLOOR], low.max(initial=0.0))
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def lookup(model: Model):
    """A memo of words' weights; only the few that are not zero are sent to the workers."""
    on = np.flatnonzero(model.weights)
    known = dict(zip(on.tolist(), model.weights[on].tolist()))
    return lambda: _Memo(lambda w: known.get(bucket(w), 0.0))


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``; defined like ``score``."""
    bias, start = model.bias, lookup(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = start()
        for b in slices(batches):
            good = [noisy_or(sentence_scores(t, bias, memo)[1]) < threshold for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, offending) of each row: offending holds (start, end, score) of sentences at or above
    ``threshold``, in code points of the lower-cased text.

    Null and empty texts have no sentence and so score 0. All words of all sentences count; repeated rows and null doc_ids
    are scored like others, other columns are ignored, an empty table gives no rows.
    """
    bias, start = model.bias, lookup(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = start()
        for b in slices(batches):
            scores, spans = [], []
            for t in b.column("text").to_pylist():
                at, p = sentence_scores(t, bias, memo)
                scores.append(noisy_or(p))
                spans.append([{"start": at[i][0], "end": at[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= threshold).tolist()])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, kind)],
                ["doc_id", "score", "predicted", "offending"],
            )

    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")
