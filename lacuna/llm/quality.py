"""Quality rules (operator 7): a classifier on hashed word and character n-grams beside fixed counting rules.

The classifier is a logistic regression on hashed features: words, pairs of adjacent words, and grams of three
characters of words with a blank on either side, each kind averaged over the text. It is trained on a bounded sample
of the labelled rows (SAMPLE per class, chosen by a hash of doc_id; of rows that repeat an id, the text with the
least hash counts), whose features are taken in tasks: the driver gets BUCKETS numbers a row at most. Its scores
are calibrated by a logistic curve fitted on rows held out from training, and the calibrated probability of good
quality is compared with a fixed threshold. Texts are scored in Arrow batches; each worker keeps a word's weight
once computed, in tables of bounded size.

Null texts have no words and fail by the rule on n_words, as empty ones do. Repeated rows get equal results, ties
at the threshold are kept. Rows without a label are scored like others; labels of unknown documents are ignored.
With fewer than MIN_ROWS sampled rows of either class nothing is learned and the base rules alone decide. A very
long text is scored whole, on its own. An empty table gives an empty one. Other columns, whatever their names,
are passed on by keep() and not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, give_back, kept, lean, text_steps
from .words import WordTable, split_step, window_hashes, word_hashes

#: Labelled rows of each class that training sees at most; the one bound on what it reads.
SAMPLE = 800
MIN_ROWS = 5
BUCKETS = 1 << 15
#: Documents with a smaller calibrated probability of good quality are rejected.
THRESHOLD = 0.5
SCALE = 30.0

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
MOST_REPEATED = 30


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -60, 60)))


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0x632BE59BD9B4E019 & (2**64 - 1))) >> np.uint64(64 - 15)).astype(np.int64)


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' grams of three characters, one after another, and the number of each word's; as many as it has."""
    c = np.frombuffer((b" " + b" ".join(words) + b" ").decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(c == ord(" "))  # words hold no blanks
    sizes = np.diff(ends) - 1
    keep = np.ones(len(c) - 2, bool)
    keep[ends[1:-1] - 1] = False  # the gram around the blank between two words
    g = c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42)
    return _bucket(g[keep], 3), sizes


def _features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and values of each text's features, for training."""
    out = []
    for t in texts:
        words = t.split()
        if not words:
            out.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        h = word_hashes(words)
        g, sizes = _grams(words)
        buckets = [_bucket(h, 1), g]
        values = [np.full(len(h), 1 / len(h)), np.repeat(1 / sizes / len(h), sizes)]
        if len(h) > 1:
            buckets.append(_bucket(_pairs(h), 2))
            values.append(np.full(len(h) - 1, 1 / (len(h) - 1)))
        where, at = np.unique(np.concatenate(buckets), return_inverse=True)
        out.append((where, np.bincount(at, np.concatenate(values)) * SCALE))
    return out


def _pairs(h: np.ndarray) -> np.ndarray:
    return h[:-1] * np.uint64(31) ^ h[1:]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, steps: int = 150, ridge: float = 1e-4) -> Model | None:
    """Trains on three quarters of the rows, given by their features, and calibrates on the rest."""
    good = np.asarray(good, float)
    if min(good.sum(), len(good) - good.sum()) < MIN_ROWS:
        return None
    held = np.arange(len(good)) % 4 == 3
    sizes = np.array([len(x[0]) for x in rows])
    where, value = np.concatenate([x[0] for x in rows]).astype(np.int32), np.concatenate([x[1] for x in rows]).astype(np.float32)
    row, count = np.repeat(np.arange(len(rows), dtype=np.int32), sizes), len(rows)
    balance = np.where(good > 0, 0.5 / max(good[~held].mean(), 1e-9), 0.5 / max(1 - good[~held].mean(), 1e-9)) * ~held
    w, b = np.zeros(BUCKETS), 0.0
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    scores = lambda: np.bincount(row, value * w[where], count) + b
    for i in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(scores(), -60, 60))) - good) * balance / (~held).sum()
        gw, gb = np.bincount(where, value * error[row], BUCKETS) + ridge * w, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        at = 0.05 / (1 - 0.9**i)
        w = w - at * m / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        b = b - at * mb / (np.sqrt(vb / (1 - 0.99**i)) + 1e-8)
    z, y = scores()[held], good[held]
    slope, shift = _calibrate(z, y)
    return Model(w, b, slope, shift)


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's curve, with his smoothed targets, by Newton's method; the classes count alike."""
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    count = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    x = np.stack([z / (np.abs(z).max() + 1e-9), np.ones(len(z))], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -60, 60)))
        grad = x.T @ (count * (p - target)) + 1e-4 * theta
        theta = theta - np.linalg.solve((x * (count * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(2), grad)
    return float(theta[0] / (np.abs(z).max() + 1e-9)), float(theta[1])


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features and labels of at most most rows of each class, the same ones on every run."""
    bound_batches(docs.sparkSession)
    good = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("good"))
    # A document labelled both ways has no label.
    good = good.groupBy("id").agg(F.min("good").alias("good"), F.max("good").alias("top")).where("good = top").select("id", "good", F.xxhash64("id").alias("at"))
    chosen = good.where("good = 1").orderBy("at", "id").limit(most).union(good.where("good = 0").orderBy("at", "id").limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "good", "at").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))

    def run(batches):
        for part, raws in text_steps(batches):
            found = _features(raws)
            where, value = (pa.array([f[k].astype(t).tobytes() for f in found], pa.binary()) for k, t in ((0, np.int32), (1, np.float32)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("good"), part.column("at"), where, value], ["id", "good", "at", "places", "amounts"])

    rows = texts.mapInArrow(lean(run), "id long, good int, at long, places binary, amounts binary").toArrow().sort_by([("at", "ascending"), ("id", "ascending")])
    features = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(b, np.float32)) for a, b in zip(rows.column("places").to_pylist(), rows.column("amounts").to_pylist())]
    return features, rows.column("good").to_numpy()


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model | None:
    return fit(*sample(docs, labels, most))


class Scorer:
    def __init__(self, model: Model | None):
        self.model = model
        self.table = WordTable(self._word)

    def _word(self, words: list[bytes]) -> list[np.ndarray]:
        length = np.array([len(w.decode()) for w in words])
        symbols = np.array([len(w) - len(w.translate(None, SYMBOLS)) for w in words])
        h = word_hashes(words)
        if self.model is None:
            return [h, length, symbols, np.zeros(len(words))]
        g, sizes = _grams(words)
        inner = np.add.reduceat(self.model.weights[g], np.cumsum(sizes) - sizes) / sizes
        return [h, length, symbols, self.model.weights[_bucket(h, 1)] + inner]

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        self.table.start()
        words, bounds = split_step(texts)
        n = np.diff(bounds)
        row = np.repeat(np.arange(len(texts)), n)
        add = lambda x: np.bincount(row, x, len(texts))
        dup = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            lines = [x for x in t.split(b"\n") if x and not x.isspace()]
            dup[i] = len(lines) - len(set(lines))
        if not words:
            zero = np.zeros(len(texts), np.int64)
            return {"n_words": n, "word_chars": zero, "n_symbols": zero, "n_dup_lines": dup, "n_repeat_words": zero, "probability": np.zeros(len(texts))}
        ids, (h, length, symbols, weight) = self.table.of(words)
        out = {"n_words": n, "word_chars": add(length[ids]).astype(np.int64), "n_symbols": add(symbols[ids]).astype(np.int64), "n_dup_lines": dup, "n_repeat_words": self._repeated(h[ids], bounds, row)}
        z = add(weight[ids]) / np.maximum(n, 1)
        if self.model is not None:
            if len(words) > 1:
                inside = row[1:] == row[:-1]
                pair = self.model.weights[_bucket(_pairs(h[ids]), 2)]
                z = z + np.bincount(row[1:][inside], pair[inside], len(texts)) / np.maximum(n - 1, 1)
            out["probability"] = self.model.probability(SCALE * z + self.model.bias)
        else:
            out["probability"] = np.ones(len(texts))
        return out

    def _repeated(self, h: np.ndarray, bounds: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Words in windows that a text holds twice or more."""
        windows, of = window_hashes(h, bounds, WINDOW)
        at = np.flatnonzero(of >= 0)
        marks = np.zeros(len(h) + 1, np.int64)
        if len(at):
            key = windows[at] ^ (of[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            twice = at[count[inverse] > 1]
            np.add.at(marks, twice, 1)
            np.add.at(marks, twice + WINDOW, -1)
        return np.bincount(row, np.cumsum(marks[:-1]) > 0, len(bounds) - 1).astype(np.int64)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability of every document."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))  # BUCKETS numbers

    def run(batches):
        name, own = sent.value
        scorer = kept(f"quality {name}", lambda: Scorer(own))
        for part, texts in text_steps(batches):
            x = scorer.score(texts)
            failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MOST_REPEATED * x["n_words"])
            x = {"doc_id": part.column("doc_id")} | {k: pa.array(v) for k, v in x.items() if k != "probability"} | {"base_failed": pa.array(failed), "kept": pa.array(~failed & (x["probability"] >= threshold)), "probability": pa.array(np.round(x["probability"], 6))}
            yield pa.RecordBatch.from_pydict(x)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run, keeps=True), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def keep(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns as they are, whose text is kept."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        name, own = sent.value
        scorer, out = kept(f"quality {name}", lambda: Scorer(own)), []
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        for _, texts in text_steps([batch]):
            x = scorer.score(texts)
            out.append((x["n_words"] >= MIN_WORDS) & (100 * x["n_repeat_words"] <= MOST_REPEATED * x["n_words"]) & (x["probability"] >= threshold))
        give_back()
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(good(docs["text"]))
