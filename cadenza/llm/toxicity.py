"""Toxic passages as maximum-scoring segments of token log-odds.

Each token carries the log-odds that a labelled document holding it is toxic, shrunk by nested
Dirichlet priors: a word's rate towards that of the other words with the same beginning of seven
characters, that towards five, four and all documents. A linear scan finds all maximal scoring segments of a text, repeated
passages included. Their scores are calibrated by extreme-value theory (scale and constant fitted on clean texts), joined
by the sum statistic over all segments, in which a repeated token counts once, and mapped to a probability by a logistic
curve fitted on labelled rows outside the counts used for them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import add_columns, bounded_sample, col, crc_mod4, ridge_logistic, sigmoid, text_batches

SLOTS = 1 << 20
PRIOR = 4.0
DRIFT = 0.5
CAUTION = 1.5
MAX_LABELS = 200_000
MEMO_TOKENS = 250_000
_TOKEN = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityModel:
    """Document counts of hashed tokens (two floats for each of ``SLOTS`` slots: 8 MB at any input size) and the calibration."""

    toxic: np.ndarray
    clean: np.ndarray
    n_toxic: float
    n_clean: float
    scale: float = 1.0
    constant: float = 1.0
    slope: float = 1.0
    intercept: float = -4.0


def slots_of(word: str) -> tuple[int, ...]:
    """Hashed slots of a word and of its first seven, five and four characters."""
    crc = zlib.crc32
    return (crc(b"w" + word.encode()) & (SLOTS - 1), *[crc(b"%d" % n + word[:n].encode()) & (SLOTS - 1) for n in (7, 5, 4)])


class TokenScorer:
    """Log-odds of tokens under a model, with a bounded memo."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.root = (model.n_toxic + 0.5) / (model.n_toxic + model.n_clean + 1.0)
        self.base = math.log(self.root / (1 - self.root))
        self.memo: dict[str, float] = {}

    def score(self, word: str) -> float:
        known = self.memo.get(word)
        if known is None:
            rate = self.root
            slots = slots_of(word)
            toxic, clean = self.model.toxic[list(slots)].tolist(), self.model.clean[list(slots)].tolist()
            for level in (3, 2, 1, 0):
                # A level adds what it holds beyond the next longer beginning, so no document counts twice.
                t = max(0.0, toxic[level] - toxic[level - 1]) if level else toxic[0]
                c = max(0.0, clean[level] - clean[level - 1]) if level else clean[0]
                rate = (t + PRIOR * rate) / (t + c + PRIOR)
            # What few documents say is taken with caution: so many standard errors of the log-odds are taken off.
            weight = t + c + PRIOR
            error = math.sqrt(1 / (weight * rate) + 1 / (weight * (1 - rate)))
            known = math.log(rate / (1 - rate)) - self.base - CAUTION * error - DRIFT
            if len(self.memo) >= MEMO_TOKENS:
                self.memo.clear()
            if len(word) <= 100:
                self.memo[word] = known
        return known

    def scores(self, words: list[str]) -> np.ndarray:
        known, score = self.memo.get, self.score
        return np.fromiter([k if (k := known(w)) is not None else score(w) for w in words], np.float64, len(words))


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of a sequence, left to right, in linear time.

    Segments wait on a stack with the running totals before and after them. A new positive score looks
    back for the nearest segment that began lower; if that one also ended lower than the new one ends,
    they and all between become one segment, which looks back again. Each waiting segment remembers the
    next lower beginning, so every look is paid for once.
    """
    totals = np.concatenate([[0.0], np.cumsum(scores)])
    waiting: list[tuple[int, int, float, float, int]] = []
    for at in np.flatnonzero(scores > 0).tolist():
        start, low, high = at, float(totals[at]), float(totals[at + 1])
        while True:
            back = len(waiting) - 1
            while back >= 0 and waiting[back][2] >= low:
                back = waiting[back][4]
            if back < 0 or waiting[back][3] >= high:
                waiting.append((start, at + 1, low, high, back))
                break
            start, low = waiting[back][0], waiting[back][2]
            del waiting[back:]
    return [(a, b, high - low) for a, b, low, high, _ in waiting]


def fresh_segments(words: list[str], scores: np.ndarray) -> list[float]:
    """Scores of all maximal segments of a text, best first, in which each positive token counts only where it comes first.

    A text does not grow more toxic by saying the same again; ``maximal_segments`` itself still finds each repeat.
    """
    seen: set[str] = set()
    out = []
    for start, end, score in maximal_segments(scores):
        for at in (np.flatnonzero(scores[start:end] > 0) + start).tolist():
            if words[at] in seen:
                score -= float(scores[at])
            seen.add(words[at])
        if score > 0:
            out.append(score)
    return sorted(out, reverse=True)


def sum_statistic(normal: list[float]) -> float:
    """-log of the smallest sum-statistic p-value over the r best normalised scores, doubled for each r tried."""
    best, total = 0.0, 0.0
    for r, value in enumerate(normal, 1):
        total += value
        if total <= 0:
            break
        # P(sum of r >= s) ~ exp(-s) s^(r-1) / (r! (r-1)!)
        log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2)
        best = max(best, -log_p)
    return best


def evidence(segments: list[float], length: int, model: ToxicityModel) -> float:
    """-log p of a text of ``length`` tokens with these segment scores, best first; 0 without any."""
    if not segments or not length:
        return 0.0
    bar = math.log(model.constant * length)
    return sum_statistic([model.scale * s - bar for s in segments])


def text_evidence(text: str, scorer: TokenScorer, model: ToxicityModel) -> float:
    """Evidence of a whole text."""
    words = tokens_of(text)
    return evidence(fresh_segments(words, scorer.scores(words)), len(words), model)


def _labelled(documents: DataFrame, labels: DataFrame, allowed: Column | None, max_labels: int) -> DataFrame:
    """``text, toxic, part`` of labelled documents; part 3 is kept for the calibration.

    A doc_id labelled more than once counts as toxic if any row says so; any label above 0 means toxic. The labels that are
    broadcast are a hashed sample of at most ``max_labels`` ids.
    """
    marks = labels.where(col("doc_id").isNotNull() & col("toxic").isNotNull())
    marks = marks.groupBy(col("doc_id")).agg(F.max((col("toxic") > 0).cast("int")).alias("toxic"))
    if allowed is not None:
        marks = marks.where(allowed)
    marks = bounded_sample(marks, "doc_id", max_labels)
    joined = documents.select(col("doc_id"), col("text")).join(F.broadcast(marks), "doc_id")
    return joined.select("text", "toxic", crc_mod4(F.col("doc_id")).cast("int").alias("part"))


def _token_counts(rows: DataFrame) -> DataFrame:
    """(slot, held, toxic, n): documents with each slot, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((4, SLOTS + 1), np.int32)
        memo: dict[str, tuple[int, ...]] = {}
        for batch, texts in text_batches(batches):
            kinds = zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist())
            for text, toxic, part in kinds:
                seen: set[int] = set()
                for word in set(tokens_of(text)):
                    slots = memo.get(word)
                    if slots is None:
                        if len(memo) >= MEMO_TOKENS:
                            memo.clear()
                        slots = memo[word] = slots_of(word)
                    seen.update(slots)
                row = counts[2 * (part == 3) + toxic]
                row[np.fromiter(seen, np.int64, len(seen))] += 1
                row[SLOTS] += 1
        for kind in range(4):
            at = np.flatnonzero(counts[kind])
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.astype(np.int32)), pa.array(np.full(len(at), kind, np.int32)), pa.array(counts[kind][at].astype(np.int64))],
                    names=["slot", "kind", "n"],
                )

    return rows.mapInArrow(run, "slot int, kind int, n bigint").groupBy("slot", "kind").agg(F.sum("n").cast("int").alias("n"))


def fit(documents: DataFrame, labels: DataFrame, allowed: Column | None = None, max_labels: int = MAX_LABELS) -> ToxicityModel:
    """Model from the labelled documents whose label row meets ``allowed`` (all by default).

    At most about ``max_labels`` labelled ids are used. Without any label the model scores every text alike.
    """
    rows = _labelled(documents, labels, allowed, max_labels)
    # Bounded by the number of slots: four integers for each at most.
    counted = _token_counts(rows).toArrow()
    counts = np.zeros((4, SLOTS + 1), np.float32)
    counts[counted.column("kind").to_numpy(), counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    part = ToxicityModel(counts[1][:SLOTS], counts[0][:SLOTS], float(counts[1][SLOTS]), float(counts[0][SLOTS]))
    full = ToxicityModel(
        counts[1][:SLOTS] + counts[3][:SLOTS], counts[0][:SLOTS] + counts[2][:SLOTS],
        float(counts[1][SLOTS] + counts[3][SLOTS]), float(counts[0][SLOTS] + counts[2][SLOTS]),
    )
    return replace(full, **_calibrate(rows.where("part = 3"), part))


def _calibrate(rows: DataFrame, model: ToxicityModel) -> dict[str, float]:
    """Extreme-value scale and constant from clean texts, and the logistic curve, on rows outside the counts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    edges = np.linspace(-12.0, 12.0, 241)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = TokenScorer(shared.value)
        hist = np.zeros(240, np.int64)
        for batch, texts in text_batches(batches):
            out = []
            for text in texts:
                words = tokens_of(text)
                scores = scorer.scores(words)
                hist += np.histogram(np.clip(scores, -11.99, 11.99), edges)[0]
                out.append((len(words), max(fresh_segments(words, scores), default=0.0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64()), pa.nulls(len(out), pa.list_(pa.int64()))],
                names=["length", "best", "hist"],
            )
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([hist.tolist()], pa.list_(pa.int64()))], names=["length", "best", "hist"])

    # At most a quarter of max_labels rows of two numbers, and one histogram a task.
    clean = rows.where("toxic = 0").select("text").mapInArrow(run, "length bigint, best double, hist array<bigint>").toArrow().to_pydict()
    hist = sum((np.array(h) for h in clean["hist"] if h is not None), np.zeros(240))
    fitted = replace(model, scale=_scale(hist, (edges[:-1] + edges[1:]) / 2))
    bests = [(n, b) for n, b in zip(clean["length"], clean["best"]) if n]
    weight = sum(n * math.exp(-fitted.scale * s) for n, s in bests)
    fitted = replace(fitted, constant=max(len(bests), 1) / weight if weight else 1.0)
    marked = with_evidence(rows.select("text", "toxic"), fitted).select("toxic", "z").toArrow()
    if not marked.num_rows:
        return {}
    z, toxic = marked.column("z").to_numpy(), marked.column("toxic").to_numpy().astype(float)
    slope, intercept = ridge_logistic(np.column_stack([np.minimum(z, 30.0) / 10, np.ones(len(z))]), toxic, 0.05)
    return {"scale": fitted.scale, "constant": fitted.constant, "slope": float(max(slope, 0.0)) / 10, "intercept": float(intercept)}


def _scale(hist: np.ndarray, middle: np.ndarray) -> float:
    """The positive root of sum p exp(scale * s) = 1; scores have a negative mean."""
    if not hist.sum():
        return 1.0
    p = hist / hist.sum()
    low, high = 1e-3, 8.0
    if (p * middle).sum() >= 0 or not (p[middle > 0]).sum():
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if (p * np.exp(mid * middle)).sum() > 1:
            high = mid
        else:
            low = mid
    return (low + high) / 2


def with_evidence(documents: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``documents`` with ``z double``, the evidence of each text; null texts count as empty and have none."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    scorers: list[TokenScorer] = []

    def make(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        if not scorers:
            scorers.append(TokenScorer(shared.value))
        return [pa.array([text_evidence(t, scorers[0], shared.value) for t in texts], pa.float64())]

    return add_columns(documents, "z double", make, text)


def with_scores(documents: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``documents`` with ``toxicity double``, the calibrated probability of being toxic.

    Null texts count as empty. A text without tokens gets the score of no evidence. Other columns pass
    through; a column named toxicity is replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    scorers: list[TokenScorer] = []

    def make(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        if not scorers:
            scorers.append(TokenScorer(shared.value))
        fitted = shared.value
        z = np.array([text_evidence(t, scorers[0], fitted) for t in texts])
        return [pa.array(sigmoid(fitted.intercept + fitted.slope * np.minimum(z, 30.0)), pa.float64())]

    return add_columns(documents, "toxicity double", make, text)


def passages(documents: DataFrame, model: ToxicityModel, max_e: float = 0.01) -> DataFrame:
    """Every significant toxic passage: doc_id, first and last token (exclusive), passage, score, e_value.

    A passage is a maximal segment expected at most ``max_e`` times in a clean text of its length.
    Null and empty texts give none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, fitted = TokenScorer(shared.value), shared.value
        for batch, texts in text_batches(batches):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                lowered = text.lower()
                words = tokens_of(text)
                spans = None
                for start, end, score in maximal_segments(scorer.scores(words)):
                    e_value = fitted.constant * len(words) * math.exp(-fitted.scale * score)
                    if e_value <= max_e:
                        spans = spans or [m.span() for m in _TOKEN.finditer(lowered)]
                        out.append((doc_id, start, end, lowered[spans[start][0] : spans[end - 1][1]], score, e_value))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
                names = ["doc_id", "first_token", "end_token", "passage", "score", "e_value"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    schema = "doc_id bigint, first_token bigint, end_token bigint, passage string, score double, e_value double"
    return documents.select(col("doc_id").cast("long").alias("doc_id"), col("text")).mapInArrow(run, schema)


def held_out_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels of held-out ids (crc32 mod 4 = 2) are never read."""
    model = fit(documents, labels, crc_mod4(F.col("doc_id")) != 2, max_labels)
    scored = with_scores(documents.select(col("doc_id"), col("text")), model)
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod4(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labels: int = MAX_LABELS) -> DataFrame:
    """``documents`` without those scored at or above ``threshold``; all columns pass through."""
    model = fit(documents, labels, None, max_labels)
    columns = [col(c) for c in documents.columns]
    return with_scores(documents, model).where(F.col("toxicity") < threshold).select(*columns)
