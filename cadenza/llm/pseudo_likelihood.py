"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Corpus counts of hashed words, over all documents, fix the vocabulary: the most frequent slots are tokens of
their own, the others share tokens, inside which a word has its share of the counts. A small numpy network
(position-weighted embeddings of the tokens on both sides, a tanh layer, a two-level softmax) is trained on all documents, by
synchronous rounds: every task runs gradient steps on its part from the common weights, and the weights are averaged
by a grouped sum. A document's score is the sum of its tokens' conditional log-probabilities.

The number of hashed slots grows with the corpus's distinct words, from 2^20 up to 2^23 (48 MB in memory), so that words share few counts.
Averaged training depends on how the documents are dealt over tasks: another partitioning gives slightly other weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import add_columns, col, text_batches, write_shared
from cadenza.llm.word_hashes import word_hashes

#: Bits of a slot: the least, and the most, which bounds what is broadcast.
MIN_BITS, MAX_BITS = 20, 23
OWN = 768
CLASSES = 32
PER_CLASS = 32
TOKENS = CLASSES * PER_CLASS
DIM = 16
SIDES = (-2, -1, 1, 2)
EDGE = TOKENS
BATCH = 8192
RATE = 0.08
ROUNDS = 2
F32 = np.float32


@dataclass(frozen=True)
class Vocabulary:
    """Token of each hashed slot and the log-share of the slot within its token (six bytes a slot, 48 MB at most)."""

    token: np.ndarray
    share: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.token).bit_length() - 1


def slots_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Slot of each word hash."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def corpus_counts(documents: DataFrame) -> np.ndarray:
    """Count of every hashed slot over all documents; each task sums its own part before the shuffle.

    Counts are gathered in the finest slots; they are folded while under a quarter of the slots would be in use, so a small
    corpus has a small table. Slots are sent to the driver as arrays of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << MAX_BITS, np.int64)
        for _, texts in text_batches(batches):
            for hashes, _ in word_hashes(texts):
                np.add.at(counts, slots_of(hashes, MAX_BITS), 1)
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["slot", "n"])

    got = documents.select(col("text")).mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << MAX_BITS, np.float64)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    while len(counts) > 1 << MIN_BITS and got.num_rows * 4 < len(counts):
        counts = counts.reshape(-1, 2).sum(axis=1)
    return counts


def vocabulary(counts: np.ndarray) -> Vocabulary:
    """The ``OWN`` most frequent slots become tokens by rank; the rest fold into the other tokens by slot number."""
    slots = np.arange(len(counts))
    token = (OWN + slots % (TOKENS - OWN)).astype(np.int16)
    token[np.lexsort((slots, -counts))[:OWN]] = np.arange(OWN)
    # One is added to every slot, so that words never seen have a probability too.
    totals = np.bincount(token, counts + 1, TOKENS)
    return Vocabulary(token, np.log((counts + 1) / totals[token]).astype(F32))


Weights = dict[str, np.ndarray]


def first_weights(seed: int = 7) -> Weights:
    """Starting weights, the same for every task."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(F32)
    embed = small(TOKENS + 1, DIM)
    return {
        "embed": embed, "place": np.ones((len(SIDES), DIM), F32) + small(len(SIDES), DIM), "inner": np.eye(DIM, dtype=F32) + small(DIM, DIM),
        "inner_bias": np.zeros(DIM, F32), "group": small(CLASSES, DIM), "group_bias": np.zeros(CLASSES, F32),
        "word": small(TOKENS, DIM), "word_bias": np.zeros(TOKENS, F32),
    }


def _context(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Tokens at each side offset; ``EDGE`` beyond a document's ends. ``starts`` gives each token's document number."""
    n = len(tokens)
    out = np.full((len(SIDES), n), EDGE, np.int16)
    for k, side in enumerate(SIDES):
        low, high = max(0, -side), min(n, n - side)
        if low < high:
            same = starts[low + side : high + side] == starts[low:high]
            out[k, low:high] = np.where(same, tokens[low + side : high + side], EDGE)
    return out


def _hidden(w: Weights, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bag = w["embed"][context[0]] * w["place"][0]
    for k in range(1, len(SIDES)):
        bag += w["embed"][context[k]] * w["place"][k]
    return bag, np.tanh(bag @ w["inner"] + w["inner_bias"])


def _by_class(tokens: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Order that brings equal classes together, and the class boundaries in it; one byte a class lets numpy use a radix sort."""
    group = (tokens // PER_CLASS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    return order, np.searchsorted(group[order], np.arange(CLASSES + 1)).tolist()


def _target_log(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-softmax of each row at its target."""
    x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(x)), target]
    return own - np.log(np.exp(x, out=x).sum(axis=1))


def _error(x: np.ndarray, target: np.ndarray, scale: float) -> np.ndarray:
    """(softmax - one-hot target) * scale, in place of ``x``."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x *= scale / x.sum(axis=1, keepdims=True)
    x[np.arange(len(x)), target] -= scale
    return x


def log_probabilities(w: Weights, tokens: np.ndarray, context: np.ndarray) -> np.ndarray:
    """log P(token | both sides) of each token."""
    _, hidden = _hidden(w, context)
    out = _target_log(hidden @ w["group"].T + w["group_bias"], tokens // PER_CLASS)
    order, edges = _by_class(tokens)
    near, place, inner = hidden[order], (tokens % PER_CLASS)[order], np.empty(len(tokens), F32)
    for c in range(CLASSES):
        if (low := edges[c]) < (high := edges[c + 1]):
            block = slice(c * PER_CLASS, (c + 1) * PER_CLASS)
            inner[low:high] = _target_log(near[low:high] @ w["word"][block].T + w["word_bias"][block], place[low:high])
    out[order] += inner
    return out


def gradient_step(w: Weights, tokens: np.ndarray, context: np.ndarray, state: Weights, rate: float) -> None:
    """One step on a batch: mean gradient scaled by its running squares (Adagrad); changes ``w`` and ``state``."""
    n = len(tokens)
    bag, hidden = _hidden(w, context)
    scale = F32(1.0 / n)
    grad: Weights = {}
    error = _error(hidden @ w["group"].T + w["group_bias"], tokens // PER_CLASS, scale)
    grad["group"], grad["group_bias"] = error.T @ hidden, error.sum(axis=0)
    back = error @ w["group"]
    grad["word"], grad["word_bias"] = np.zeros_like(w["word"]), np.zeros_like(w["word_bias"])
    order, edges = _by_class(tokens)
    near, place, inner = hidden[order], (tokens % PER_CLASS)[order], np.empty_like(hidden)
    for c in range(CLASSES):
        if (low := edges[c]) < (high := edges[c + 1]):
            block = slice(c * PER_CLASS, (c + 1) * PER_CLASS)
            error = _error(near[low:high] @ w["word"][block].T + w["word_bias"][block], place[low:high], scale)
            grad["word"][block], grad["word_bias"][block] = error.T @ near[low:high], error.sum(axis=0)
            inner[low:high] = error @ w["word"][block]
    back[order] += inner
    back *= 1 - hidden**2
    grad["inner"], grad["inner_bias"] = bag.T @ back, back.sum(axis=0)
    back = back @ w["inner"].T
    grad["place"] = np.zeros_like(w["place"])
    grad["embed"] = np.zeros_like(w["embed"])
    for k in range(len(SIDES)):
        # Sums of rows by token: sorted by token (two bytes each, a radix sort), runs are summed at once.
        by = np.argsort(context[k], kind="stable")
        ids = context[k][by]
        heads = np.flatnonzero(np.diff(ids, prepend=-1))
        sums = np.add.reduceat(back[by], heads, axis=0)
        met = ids[heads]
        grad["place"][k] = (sums * w["embed"][met]).sum(axis=0)
        grad["embed"][met] += sums * w["place"][k]
    for name, g in grad.items():
        state[name] += g * g
        w[name] -= rate * g / (np.sqrt(state[name]) + 1e-8)


def _streams(texts: list[str], words: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, slots, text numbers) of blocks of whole texts."""
    for hashes, numbers in word_hashes(texts):
        if len(hashes):
            slots = slots_of(hashes, words.bits)
            yield words.token[slots], slots, numbers


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the sums of all rows of a task."""
    seen, total = 0.0, 0.0
    for batch in batches:
        if batch.num_rows:
            seen += float(batch.column(0).to_numpy().sum())
            total = total + batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([total], pa.list_(pa.float64()))], names=["seen", "total"])


def train(documents: DataFrame, words: Vocabulary, rounds: int = ROUNDS, rate: float = RATE) -> Weights:
    """Weights trained on every document once: each round takes the documents whose text hash falls to it.

    In a round every task starts from the same weights and its result counts by its number of tokens; the weighted sums are
    added up in tasks before a few of them reach the driver.
    """
    spark = documents.sparkSession
    weights = first_weights()
    shared_words = spark.sparkContext.broadcast(words)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            w = {k: v.copy() for k, v in shared.value.items()}
            state = {k: np.full_like(v, 1e-6) for k, v in w.items()}
            seen = 0
            for _, texts in text_batches(batches):
                for tokens, _, starts in _streams(texts, shared_words.value):
                    context = _context(tokens, starts)
                    for at in range(0, len(tokens), BATCH):
                        gradient_step(w, tokens[at : at + BATCH], context[:, at : at + BATCH], state, rate)
                    seen += len(tokens)
            if seen:
                flat = np.concatenate([w[k].ravel() for k in w]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([flat * seen], pa.list_(pa.float64()))], names=["seen", "total"])

        part = documents.select(col("text")).where(F.pmod(F.xxhash64(col("text")), F.lit(rounds)) == turn)
        parts = write_shared(part.mapInArrow(run, "seen double, total array<double>"), "weights")
        # Sums of sums: about the square root of the number of tasks arrays meet in a task, and as many reach the driver.
        tasks = max(1, int(parts.count() ** 0.5))
        sums = parts.repartition(tasks).mapInArrow(_summed, "seen double, total array<double>").toArrow()
        if not sums.num_rows:
            continue
        total = sums.column("total").combine_chunks().flatten().to_numpy().reshape(sums.num_rows, -1).sum(axis=0) / sums.column("seen").to_numpy().sum()
        edges = np.cumsum([v.size for v in weights.values()])[:-1]
        weights = {k: x.reshape(v.shape).astype(F32) for (k, v), x in zip(weights.items(), np.split(total, edges))}
    return weights


@dataclass(frozen=True)
class LanguageModel:
    words: Vocabulary
    weights: Weights


def fit(documents: DataFrame) -> LanguageModel:
    """Vocabulary and network from all documents; an empty table gives the starting weights."""
    words = vocabulary(corpus_counts(documents))
    return LanguageModel(words, train(documents, words))


def with_scores(documents: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``documents`` with ``n_tokens bigint`` and ``log_likelihood double``, the summed conditional log-probabilities.

    Null texts count as empty: no tokens and a score of 0. Columns of these names are replaced, others pass through.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        m = shared.value
        n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for tokens, slots, starts in _streams(texts, m.words):
            context = _context(tokens, starts)
            for at in range(0, len(tokens), BATCH):
                part = slice(at, at + BATCH)
                values = log_probabilities(m.weights, tokens[part], context[:, part]).astype(np.float64) + m.words.share[slots[part]]
                total += np.bincount(starts[part], values, len(texts))
            n += np.bincount(starts, minlength=len(texts))
        return [pa.array(n), pa.array(total)]

    return add_columns(documents, "n_tokens bigint, log_likelihood double", make, text)


def perplexity() -> Column:
    """exp(-log_likelihood / n_tokens); null without tokens."""
    return F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_likelihood") / F.col("n_tokens")))


def score_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and perplexity of every document under a model of the same documents."""
    slim = documents.select(col("doc_id"), col("text"))
    return with_scores(slim, fit(slim)).select("doc_id", "n_tokens", "log_likelihood", perplexity().alias("perplexity"))
