"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import chunks, flat
from .wordhash import _BACK, _BASE, _LOWER, BYTES, mixed, powers

#: Rows of the vector table, values in each, values of a word's own index vector that are not 0, words on either side.
VOCABULARY, SIZE, ONES, WINDOW = 1 << 14, 64, 8, 2
#: Vectors of so many words make one row between tasks.
GROUP = 256
#: Shares of the tasks whose tables are summed before the rest.
SHARES = 64
_UPPER_WORD, _NUMBER = 0, 1  # fixed rows for words with several capitals and for digits

_CLASS = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 other
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """A sparse vector of +1 and -1 for each row, the same everywhere."""
    out = np.zeros((VOCABULARY, SIZE), np.int8)
    draws = mixed(np.arange(1, VOCABULARY * ONES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1, ONES)
    rows = np.arange(VOCABULARY)
    for k in range(ONES):
        out[rows, (draws[:, k] % np.uint64(SIZE)).astype(np.int64)] += np.where(draws[:, k] >> np.uint64(63), 1, -1).astype(np.int8)
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the tokens of texts laid end to end (runs of letters, digits or other signs), and each text's offsets."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    fresh = np.ones(n, bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(fresh)
    end = np.append(start[1:], n)
    seen = kind[start] > 0
    start, end = start[seen], end[seen]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[_LOWER[data]] * powers(_BASE, n), out=sums[1:])
    hashes = mixed((sums[end] - sums[start]) * powers(_BACK, n)[start])
    rows = (hashes % np.uint64(VOCABULARY - 2)).astype(np.int64) + 2
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    rows[(upper[end] - upper[start]) >= 2] = _UPPER_WORD
    rows[kind[start] == 2] = _NUMBER
    return rows, np.searchsorted(start, offsets)


def _parts(part: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and offsets of a chunk; a text over ``limit`` bytes is cut where a blank stands, if one does."""
    data, offsets = flat(part.column("text"))
    if len(offsets) > 2 or len(data) <= limit:
        yield tokens(data, offsets)
        return
    found, start = [], 0
    while start < len(data):
        stop = min(len(data), start + limit)
        blanks = np.flatnonzero(_CLASS[data[start + limit // 2 : stop]] == 0) if stop < len(data) else ()
        if len(blanks):
            stop = start + limit // 2 + int(blanks[-1])
        found.append(tokens(data[start:stop], np.array([0, stop - start]))[0])
        start = stop
    rows = np.concatenate(found)
    yield rows, np.array([0, len(rows)])


def _sum_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all texts of a task: per token the sum of its neighbours' index vectors, and its count in the last place."""
    index = index_vectors()
    total = np.zeros((VOCABULARY, SIZE + 1), np.int64)
    for part in chunks(batches, "text", 1 << 20):
        for rows, offsets in _parts(part):
            for begin in range(0, len(rows), 1 << 18):  # a long text in blocks: neighbours do not cross them
                block = rows[begin : begin + (1 << 18)]
                text = np.searchsorted(offsets, np.arange(begin, begin + len(block)), "right")
                near = np.zeros((len(block), SIZE), np.int16)
                own = index[block]
                for step in range(1, WINDOW + 1):
                    same = (text[step:] == text[:-step])[:, None]
                    near[step:] += own[:-step] * same
                    near[:-step] += own[step:] * same
                order = np.argsort(block, kind="stable")
                word, first, count = np.unique(block[order], return_index=True, return_counts=True)
                total[word, :SIZE] += np.add.reduceat(near[order], first, axis=0, dtype=np.int64)
                total[word, SIZE] += count
    for g in range(0, VOCABULARY, GROUP):
        if total[g : g + GROUP].any():
            yield _blob(g // GROUP, total[g : g + GROUP])


def _blob(group: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([values.tobytes()])], ["g", "v"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for g, v in zip(batch.column("g").to_pylist(), batch.column("v").to_pylist()):
            values = np.frombuffer(v, np.int64)
            held[g] = held[g] + values if g in held else values
    for g, values in held.items():
        yield _blob(g, values)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """A weighted unit vector for each row of the table, from the contexts in all texts.

    Each task adds up its texts in a table of fixed size; tables are summed by parts of it, first those of a share of
    the tasks and then over the shares, and the sum (VOCABULARY x (SIZE + 1) numbers, whatever the corpus) comes to the
    driver. Frequent words weigh less.
    """
    parts = "g int, v binary"
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_sum_contexts, parts)
    found = found.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES))).repartition(count, "g", "share")
    found = found.select("g", "v").mapInArrow(_add, parts).repartition(VOCABULARY // GROUP, "g").mapInArrow(_add, parts).collect()
    total = np.zeros((VOCABULARY, SIZE + 1))
    for row in found:
        total[row.g * GROUP : (row.g + 1) * GROUP] = np.frombuffer(row.v, np.int64).reshape(-1, SIZE + 1)
    counts, vectors = total[:, SIZE], total[:, :SIZE]
    vectors = vectors - np.outer(counts, vectors.sum(axis=0) / max(1.0, counts.sum()))  # less what any word would have
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    weight = 1e-3 / (1e-3 + counts / max(1.0, counts.sum()))
    return (vectors * np.sqrt(weight)[:, None]).astype(np.float32)


#: Numbers of a document: six pooled vectors.
FEATURES = 6 * SIZE
#: Tokens of which the vectors are laid out at once.
_BLOCK = 1 << 15


def pooled(own: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The vectors of a document's tokens, pooled: their mean, that of the distinct tokens, their deviation, their sum over
    the root of their number, and the mean products of neighbours one and two places apart. All 0 without tokens."""
    if not len(own):
        return np.zeros(FEATURES, np.float32)
    word, times = np.unique(own, return_counts=True)
    used = vectors[word]
    total = times @ used
    mean = total / len(own)
    deviation = np.sqrt(np.maximum(times @ (used * used) / len(own) - mean * mean, 0))
    near = np.zeros((2, SIZE))
    for begin in range(0, len(own), _BLOCK):
        block = vectors[own[begin : begin + _BLOCK + 2]]
        for step in (1, 2):
            left = block[: max(0, min(_BLOCK, len(block) - step))]
            near[step - 1] += np.einsum("ij,ij->j", left, block[step : step + len(left)], dtype=np.float64)
    near /= np.maximum(1, len(own) - np.array([[1], [2]]))
    return np.concatenate([mean, used.mean(axis=0), deviation, total / np.sqrt(len(own)), *near]).astype(np.float32)


def features(part: pa.RecordBatch, vectors: np.ndarray) -> np.ndarray:
    """Per text its pooled vectors."""
    out = np.zeros((part.num_rows, FEATURES), np.float32)
    for rows, offsets in _parts(part):
        for k in range(part.num_rows):
            out[k] = pooled(rows[offsets[k] : offsets[k + 1]], vectors)
    return out


class Network:
    """Two layers (tanh, logistic) with a temperature; weights are drawn from a seed and fitted by Adam."""

    def __init__(self, hidden: int = 24, seed: int = 7):
        self.hidden, self.seed = hidden, seed

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4):
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        held = np.arange(len(x)) % 5 == 4
        self.weights = [
            rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], self.hidden)), np.zeros(self.hidden),
            rng.normal(0, 1 / np.sqrt(self.hidden), self.hidden), np.zeros(1),
        ]
        self.temperature = 1.0
        tx, ty, step = x[~held], y[~held], 0
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        for _ in range(rounds):
            order = rng.permutation(len(tx))
            for k in range(0, len(order), batch):
                bx, by = tx[order[k : k + batch]], ty[order[k : k + batch]]
                h = np.tanh(bx @ self.weights[0] + self.weights[1])
                error = (_logistic(h @ self.weights[2] + self.weights[3]) - by) / len(bx)
                back = np.outer(error, self.weights[2]) * (1 - h * h)
                slopes = [bx.T @ back, back.sum(axis=0), h.T @ error, error.sum(keepdims=True)]
                step += 1
                for i, slope in enumerate(slopes):
                    slope = slope + decay * self.weights[i]
                    first[i] = 0.9 * first[i] + 0.1 * slope
                    second[i] = 0.999 * second[i] + 0.001 * slope * slope
                    self.weights[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        if held.sum() >= 20:
            z, hy = self._logit(x[held]), y[held]
            losses = {t: -np.mean(np.log(np.where(hy > 0, _logistic(z / t), 1 - _logistic(z / t)) + 1e-12)) for t in np.geomspace(0.25, 8, 61)}
            self.temperature = min(losses, key=losses.__getitem__)
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self._logit((x - self.mean) / self.scale) / self.temperature)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(key: Column, modulus: int = 4, rest: int = 2) -> Column:
    """Whether the id falls in the part whose labels are not learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus == rest


def training_rows(docs: DataFrame, labels: DataFrame, vectors, id_col: str, text_col: str, label_col: str, bound: int):
    """Features and labels of at most ``bound`` labelled ids outside the held-out part, those with the smallest hashes. Of
    several texts with one id the one with the smallest features counts, so no more than ``bound`` rows leave the tasks."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    share = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    known = known.where(share < min(1.0, 0.9 * bound / max(1, known.count()))).orderBy(share, "id").limit(bound)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(known), "id").withColumn("id", F.col("id").cast("string"))  # at most ``bound`` pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found = features(part, vectors.value)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("y"), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "y", "x"]
            )

    rows = texts.mapInArrow(run, "id string, y double, x binary").groupBy("id").agg(F.min(F.struct("x", "y")).alias("r"))
    rows = sorted((bytes(r.x), r.y) for r in rows.select("r.*").collect())
    order = np.random.default_rng(11).permutation(len(rows))
    x = np.array([np.frombuffer(rows[k][0], np.float32) for k in order], float).reshape(len(rows), FEATURES)
    return x, np.array([rows[k][1] for k in order])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.7,
    bound: int = 16_000,
) -> DataFrame:
    """Per row: the id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold).

    Word vectors come from the contexts of all texts; the network is fitted to at most ``bound`` labelled rows outside
    the held-out quarter, a fifth of which set its temperature; then every whole text is scored. Inputs of a score are
    the text's token vectors only. The vectors and the network have a fixed size and are sent to every executor. The table
    has VOCABULARY rows: words share rows by their hash, so in a corpus of many more distinct words than rows a rare word's
    vector is that of all words of its row. All words with two or more capitals share one row, and all numbers another.

    Null or empty text is scored as a text without tokens. With no labels of both kinds, every score is the share of
    label 1 (0.5 without any). Repeated rows get results of their own; an id labelled twice takes the larger label. No
    rows give no rows. Other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    vectors = sc.broadcast(word_vectors(docs, text_col))
    x, y = training_rows(docs, labels, vectors, id_col, text_col, label_col, bound)
    network = Network().fit(x, y) if len(set(y)) == 2 else None
    share = float(y.mean()) if len(y) else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found = network.predict(features(part, vectors.value)).round(9) if network else np.full(part.num_rows, share)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", predicted)
