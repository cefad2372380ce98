"""Toxicity by a counterfactually regularised classifier.

Logistic regression over the presence of hashed words and word beginnings. For labelled sentences that mention an
identity term, each term is swapped for the others of its group; the squared change of the score (as a logit) is part of
the loss, so neutral mentions of a group don't move the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 18
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")
ALL, SWAP = -1, -2  # rows of the tally that are no feature's

#: Groups of terms that may stand for one another, in the languages of the corpus.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("schwule", "lesben", "transgender"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
)


def features_of(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself, and its first 4, 5 and 6 characters if it is longer."""
    names = [f"w {word}", *(f"{n} {word[:n]}" for n in (4, 5, 6) if len(word) > n)]
    return tuple(xxhash.xxh3_64_intdigest(x) % DIMENSIONS for x in names)


class Features(dict):
    """Word -> features; forgets all when it holds ``limit`` words. With ``active``, only features that count."""

    def __init__(self, active: np.ndarray | None = None, limit: int = 300_000):
        super().__init__()
        self.active, self.limit = active, limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        found = features_of(word)
        if self.active is not None:
            found = tuple(i for i in found if self.active[i])
        self[word] = found
        return found

    def of(self, words: set[str]) -> set[int]:
        out: set[int] = set()
        for x in map(self.__getitem__, words):
            if x:
                out.update(x)
        return out


def swaps(text: str, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Iterator[tuple[list[int], list[int]]]:
    """(features that go, features that come) for each swap of an identity term in a sentence of a lower-case text."""
    other, features = {t: g for g in groups for t in g}, Features()
    for sentence in SENTENCE.split(text):
        words = WORD.findall(sentence)
        for term in {w for w in words if w in other}:
            before = features.of(set(words))
            for new in other[term]:
                if new != term:
                    after = features.of({new if w == term else w for w in words})
                    yield sorted(before - after), sorted(after - before)


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # float32, DIMENSIONS


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 12_000, penalty: float = 1.0, ridge: float = 2e-4, rounds: int = 120, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Model:
    """Fit on the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic 0/1) marks.

    At most ``max_docs`` labelled documents are used (those first in a hashed order), with their whole texts and all their
    swaps. Executors count features and swaps; the driver gets one row a feature, one for each kind of swap (there are as many
    as the identity terms allow, however many sentences mention them), and the telling features of each document. Rows
    without a label, doc_id or text are left out; of conflicting labels, 1 holds; repeated rows count each. ``penalty`` weighs
    the mean squared change of the logit under a swap. Without any labels all scores are 0.5, with one class only they are
    that class's share.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_docs).toArrow()  # max_docs rows at most
    sample = spark.createDataFrame(chosen) if chosen.num_rows else known.limit(0)
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(sample), "id")
    rows = rows.select("id", F.col("toxic").cast("int").alias("toxic"), "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            n, k, kinds, toxic = np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, np.int64), Counter(), 0
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                text = text.lower()
                found = np.fromiter(features.of(set(WORD.findall(text))), np.int64)
                n[found] += 1
                k[found] += y
                toxic += y
                kinds.update((tuple(went), tuple(came)) for went, came in swaps(text, groups))
            at = np.flatnonzero(n)
            empty, kind = len(at) + 1, pa.list_(pa.int32())
            yield pa.record_batch([
                pa.array([*at.tolist(), ALL, *[SWAP] * len(kinds)], pa.int32()), pa.array([*n[at].tolist(), batch.num_rows, *kinds.values()], pa.int64()), pa.array([*k[at].tolist(), toxic, *[0] * len(kinds)], pa.int64()),
                pa.array([*[()] * empty, *(a for a, _ in kinds)], kind), pa.array([*[()] * empty, *(b for _, b in kinds)], kind),
            ], ["feature", "n", "k", "went", "came"])

    counts = rows.mapInArrow(tally, "feature int, n long, k long, went array<int>, came array<int>").groupBy("feature", "went", "came").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).toArrow()
    of, n, k = (counts.column(c).to_numpy() for c in ("feature", "n", "k"))
    total, toxic = int(n[of == ALL].sum()), int(k[of == ALL].sum())
    if total == 0 or toxic in (0, total):
        share = min(max(toxic / total, 1e-6), 1 - 1e-6) if total else 0.5
        return Model(float(np.log(share / (1 - share))), np.zeros(DIMENSIONS, np.float32))
    used = telling(of[of >= 0], n[of >= 0], k[of >= 0], total, toxic)
    kinds = sorted(zip(*(counts.filter(pa.array(of == SWAP)).column(c).to_pylist() for c in ("went", "came", "n")), strict=True))
    shipped = spark.sparkContext.broadcast(used)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active, place = np.zeros(DIMENSIONS, bool), np.zeros(DIMENSIONS, np.int32)
        active[shipped.value], place[shipped.value] = True, np.arange(len(shipped.value))
        features = Features(active)
        for batch in batches:
            found = [np.sort(place[np.fromiter(features.of(set(WORD.findall(x.lower()))), np.int64)]) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["id", "toxic", "features"])

    data = rows.mapInArrow(pick, "id long, toxic int, features array<int>").toArrow().sort_by([("id", "ascending")])
    y = data.column("toxic").to_numpy().astype(np.float64)
    lists = data.column("features").combine_chunks()
    owner = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    objective = Objective(y, owner, lists.flatten().to_numpy(), used, kinds, penalty, ridge)
    w, b = descend(objective, len(used), float(np.log(toxic / (total - toxic))), rounds)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = w
    return Model(b, weights)


def telling(of: np.ndarray, n: np.ndarray, k: np.ndarray, total: int, toxic: int, least: int = 3, least_z: float = 4.0, most: int = 8192) -> np.ndarray:
    """The features whose share of toxic documents differs by more than chance, in order: others would only learn the sample
    by heart. ``most`` bounds the model: the features that differ most."""
    share = toxic / total
    z = np.abs(k - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
    ok = np.flatnonzero((n >= least) & (z >= least_z))
    return np.sort(of[ok[np.lexsort((of[ok], -z[ok]))][:most]])


class Objective:
    """Mean log loss, ridge, and the mean squared change of the logit over all swaps; its value and gradient."""

    def __init__(self, y: np.ndarray, owner: np.ndarray, ids: np.ndarray, used: np.ndarray, kinds: list, penalty: float, ridge: float):
        self.y, self.owner, self.ids, self.penalty, self.ridge = y, owner, ids, penalty, ridge
        at = {int(f): i for i, f in enumerate(used)}
        flat = [(i, at[f], sign) for i, (went, came, _) in enumerate(kinds) for part, sign in ((went, -1.0), (came, 1.0)) for f in part if f in at]
        kind, feature, sign = zip(*flat, strict=True) if flat else ((), (), ())
        self.kind, self.feature, self.sign = np.array(kind, np.int64), np.array(feature, np.int64), np.array(sign, np.float64)
        self.times = np.array([x[2] for x in kinds], np.float64)
        self.times /= max(1.0, self.times.sum())

    def __call__(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        z = np.clip(b + np.bincount(self.owner, w[self.ids], len(self.y)), -30, 30)
        g = (1 / (1 + np.exp(-z)) - self.y) / len(self.y)
        grad = np.bincount(self.ids, g[self.owner], len(w)) + self.ridge * w
        loss = float(np.mean(np.logaddexp(0, z) - self.y * z)) + self.ridge / 2 * float(w @ w)
        if len(self.kind):
            change = np.bincount(self.kind, self.sign * w[self.feature], len(self.times))
            loss += self.penalty * float(self.times @ change**2)
            grad += np.bincount(self.feature, 2 * self.penalty * self.sign * (self.times * change)[self.kind], len(w))
        return loss, grad, float(g.sum())


def descend(objective: Objective, size: int, b: float, rounds: int) -> tuple[np.ndarray, float]:
    """Proximal Adam from weights 0 and bias ``b``; weights that nothing holds up go to 0."""
    w = np.zeros(size)
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, rounds + 1):
        _, grad, gb = objective(w, b)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.1 / (1 + step / 60)
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * 0.002, 0)
    return w, b


class Scorer:
    """Scores of texts; null and empty texts get that of a text without features."""

    def __init__(self, model: Model):
        self.of, self.bias = Features(model.weights != 0).of, model.bias
        self.weight = dict(enumerate(model.weights.tolist())).__getitem__

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        z = [self.bias + sum(map(self.weight, sorted(self.of(set(WORD.findall(x.lower())))))) if x else self.bias for x in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row's whole text, however long; rows of equal texts score alike."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB
    held: dict = {}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held["s"] = Scorer(shipped.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(held["s"](batch.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 0 modulo 5; false without doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose ``score`` is below ``threshold``, all columns kept; each row is judged by its own text, a
    null or empty one by the score of a text without features."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    held: dict = {}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held["s"] = Scorer(shipped.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array(held["s"](texts) < threshold))

    return docs.mapInArrow(keep, docs.schema)
