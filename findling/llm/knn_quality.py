"""Quality by the votes of nearest neighbours in a latent-semantic space.

A bounded sample of labelled texts is turned into counts of terms, weighted by rarity and
reduced by a singular value decomposition. Its vectors and labels are broadcast (their
size is set by parameters), every document's whole text is folded into the same space,
and blocks of documents are multiplied with all labelled vectors, so the similarities are
exact. The nearest labelled texts vote, weighted by similarity.

Terms are whole words without their marks, the shapes of words (letters by case, digits, marks; longer runs cut to
two), words that repeat the one before and lines that repeat an earlier one. All are hashed into one vocabulary and
weighted by the same rule; the decomposition decides what counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findling.llm.common import REMEMBERED, Columns
from findling.session import ship

#: Labelled texts of each label in the sample and their most characters, columns of the space, neighbours that vote.
SAMPLE, SAMPLE_CHARS, DIMENSIONS, NEIGHBOURS = 2000, 50_000, 48, 15
#: Hashed terms; how sharply votes fall with the distance.
BUCKETS, SHARPNESS = 1 << 13, 16
MEMO = 300_000
_MARKS = ".,;:!?\"'()[]|#*$%&<>"


def _bucket(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode()) % BUCKETS


def shape(word: str) -> str:
    """Lower-case letters as a, others as A, digits as 9, marks as they are; runs of more than two as two."""
    out = ""
    for c in word:
        kind = "9" if c.isdigit() else ("a" if c.islower() else "A") if c.isalpha() else c
        if not out.endswith(2 * kind):
            out += kind
    return out


class _Terms(dict):
    """Word -> buckets of the word and of its shape."""

    def __missing__(self, word: str) -> tuple[int, int]:
        out = (_bucket("word " + word.strip(_MARKS).lower()), _bucket("shape " + shape(word)))
        if len(word) <= REMEMBERED:
            if len(self) > MEMO:
                self.clear()
            self[word] = out
        return out


_TERMS = _Terms()
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def terms(text: str | None) -> dict[int, float]:
    """Weights of the terms of a whole text, of length 1."""
    words = _SPLIT.findall(text or "")
    out: Counter[int] = Counter()
    for word, times in Counter(words).items():
        for term in _TERMS[word]:
            out[term] += times
    lines = [s for s in (text or "").split("\n") if s.strip()]
    for name, times in (("word again", sum(map(str.__eq__, words, words[1:]))), ("line again", len(lines) - len(set(lines))), ("nothing", int(not words))):
        if times:
            out[_bucket(name)] += times
    weights = {t: 1 + math.log(n) for t, n in out.items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {t: w / norm for t, w in weights.items()}


@dataclass(frozen=True)
class NeighbourModel:
    """rarity: of terms; fold: terms x dimensions; vectors: of the labelled texts, of length 1."""

    rarity: np.ndarray
    fold: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS

    def embed(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.fold.shape[1]), np.float32)
        for i, t in enumerate(texts):
            w = terms(t)
            at = np.fromiter(w.keys(), np.int64, len(w))
            out[i] = (np.fromiter(w.values(), np.float32, len(w)) * self.rarity[at]) @ self.fold[at]
        return _unit(out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Chance of label 1 by weighted votes, if both labels were equally frequent: votes count by how rare their label is in the sample."""
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        near = self.embed(texts) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        # Votes count by similarity, beside that of the nearest.
        likeness = np.take_along_axis(near, top, axis=1).astype(np.float64)
        weight = np.exp(SHARPNESS * (likeness - likeness.max(axis=1, keepdims=True)))
        vote = self.labels[top]
        share = [0.5 / max(1e-9, self.labels.mean()), 0.5 / max(1e-9, 1 - self.labels.mean())]
        good, bad = (weight * vote).sum(axis=1) * share[0], (weight * (1 - vote)).sum(axis=1) * share[1]
        ground = 1e-3
        return (good + ground * self.prior) / (good + bad + ground)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def fit_neighbours(texts: list[str], labels: list[int], prior: float, dimensions: int = DIMENSIONS) -> NeighbourModel:
    """Latent-semantic space of the sample, by a randomised decomposition with a fixed start."""
    size = BUCKETS
    if not texts:
        return NeighbourModel(np.ones(size, np.float32), np.zeros((size, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior)
    x = np.zeros((len(texts), size), np.float32)
    for i, t in enumerate(texts):
        for k, w in terms(t).items():
            x[i, k] = w
    rarity = (np.log((1 + len(texts)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x *= rarity
    d = min(dimensions, *x.shape)
    q = np.random.default_rng(7).standard_normal((size, min(size, d + 10))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    fold = (q @ v.T)[:, :d]
    return NeighbourModel(rarity, fold, _unit(x @ fold), np.array(labels, np.float64), prior)


def training_sample(
    docs: DataFrame, labels: DataFrame, usable, per_class: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_chars: int = SAMPLE_CHARS
) -> tuple[list[str], list[int], float]:
    """Texts and labels of at most ``per_class`` usable rows of each label, by a hash of the identifier; the share of label 1.

    Only texts of at most ``most_chars`` characters are drawn, so the sample is bounded in bytes; texts of all lengths
    are scored. Of several rows of an identifier the least text is taken, null counts as empty.
    """
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).filter(F.length("t") <= most_chars)
    usable_labels = labels.filter(usable & F.col(label_col).isin(0, 1)).select(F.col(f"`{id_col}`").alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    prior = usable_labels.agg(F.avg("y")).first()[0]
    picked = None
    for y in (0, 1):
        part = usable_labels.filter(F.col("y") == y).join(known.select("id").hint("merge"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 x per_class identifiers, so broadcasting them is bounded.
    rows = known.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("t").alias("t")).orderBy("id", "y").collect()
    return [r["t"] for r in rows], [r["y"] for r in rows], 0.5 if prior is None else float(prior)


def score_quality(docs: DataFrame, model: NeighbourModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``: 0 to 1, higher where label 1 is likelier.

    Only the text counts. Null, empty and wordless texts share one vector and are scored
    like any other; without labelled texts every score is the prior. Whole texts are read.
    Rows are independent, so repeats and null identifiers don't matter. Of labelled texts that are equally near at the
    last place that votes, the partition of the similarities picks; equal texts get equal votes up to rounding. An empty table
    gives an empty result. Columns may have any names; one called ``name``, in any case, is replaced.
    """
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    # (2 x SAMPLE) x DIMENSIONS and BUCKETS x DIMENSIONS numbers, whatever the input.
    held = sc.broadcast(model)
    own = Columns(docs, [name])
    carried = own.kept
    source = own.table.select(*carried, F.col(own.at(text_col)).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                scores = held.value.score(part.column(len(carried)).to_pylist())
                yield pa.record_batch([*part.columns[:-1], pa.array(scores, pa.float64())], names=[*carried, "score"])

    return source.mapInArrow(vote, source.schema[:-1].add("score", "double")).select(*own.own(), F.col("score").alias(name))
