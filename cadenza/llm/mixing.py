"""Soft-membership mixing: document rates whose expected domain token totals match target weights.

A softmax classifier, fitted on the labelled table, gives each document's posterior over the
domains. Rates r minimise, subject to 0 <= r <= repeats,
    sum over domains of (expected tokens - target)^2 / (2 * available) + pull/2 * sum of tokens * (r - start)^2.
At the fixed point of projected gradient steps every rate is max(0, start - posterior . slope), the slope being one number for each
domain: its residual over its available tokens and the pull. So only these few numbers are iterated: a step sums over all documents
what their projected rates give and how the sums would change with the slopes, and moves the slopes by the projected gradient in that metric, halved
until the objective falls. Some ten distributed sums end at a projected gradient of zero; nothing is stopped before.

Copies are whole numbers: each task goes through its rows and rounds every rate so that the domain totals, expected and realised, stay together.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import add_columns, bounded_sample, col, crc_mod4, forget, text_batches, text_of, write_shared
from cadenza.llm.word_hashes import word_hashes

DOMAINS = ("good", "junk", "toxic")
TARGETS = {"good": 0.97, "junk": 0.02, "toxic": 0.01}
MAX_LABELS = 50_000
#: Weight of staying near the start: so little that reachable targets are met.
PULL = 1e-6
#: Projected gradient, as a share of the targets, at which the fit ends, and steps after which it has failed.
TOLERANCE = 1e-7
MOST_STEPS = 100
#: Greatest rate of a document. A domain is asked for no more than its own documents give at it; what a target wants beyond that is out of reach.
REPEATS = 8.0
#: Tokens asked for, as a multiple of those that meet the target of the domain with the most to give.
GROWTH = 1.25
#: Share of its target by which a domain may miss it without a warning.
MISS = 0.05


#: Hashed slots of words and of word beginnings, the bytes of a beginning, and the prior weight of the domain rates.
SLOTS = 1 << 18
BEGINNING = 5
PRIOR = 4.0
CAUTION = 1.5
_KINDS = [b"\n", b" ", b"|", b"#%&$*", b"!?", b".,;:", b"0123456789", bytes(range(65, 91)), bytes(range(128, 256))]
_KIND = np.full(256, len(_KINDS))
for _i, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes)] = _i


@dataclass(frozen=True)
class DomainModel:
    """Log-odds of every slot for every domain (2 x ``SLOTS`` x 3 floats, 6 MB at any input size) and the softmax over the features."""

    odds: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray


def _slots(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, text numbers) of words and, from ``SLOTS`` on, of their beginnings."""
    for kind, prefix in enumerate((0, BEGINNING)):
        for hashes, numbers in word_hashes(texts, prefix=prefix):
            yield (hashes >> np.uint64(46)).astype(np.int64) + kind * SLOTS, numbers


def _features(texts: list[str], odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of texts, and their numbers of words (at least one).

    For each domain the mean log-odds of the words and the summed log-odds of those that speak for it (a repeated word
    once), and the shares of kinds of characters.
    """
    n, k = len(texts), odds.shape[1]
    words = np.zeros(n)
    mean, strong = np.zeros((n, k)), np.zeros((n, k))
    for slots, numbers in _slots(texts):
        if not len(slots):
            continue
        found = odds[slots]
        # Texts come in order, so each one's words are a run.
        heads = np.flatnonzero(np.diff(numbers, prepend=-1))
        met, count = numbers[heads], np.diff(heads, append=len(numbers))
        words[met] = count
        mean[met] += np.add.reduceat(found, heads, axis=0) / count[:, None]
        for d in range(k):
            speaks = np.flatnonzero(found[:, d] > 0)
            once = np.unique(numbers[speaks].astype(np.int64) * (2 * SLOTS) + slots[speaks])
            strong[:, d] += np.bincount(once // (2 * SLOTS), odds[once % (2 * SLOTS), d], n)
    shares = np.zeros((n, len(_KINDS)))
    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        shares[i] = np.bincount(_KIND[data], minlength=len(_KINDS) + 1)[:-1] / max(len(data), 1)
    return np.column_stack([mean, np.minimum(strong, 30) / 10, np.minimum(10 * shares, 5), np.log1p(words) / 10]), np.maximum(words, 1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 1.0, steps: int = 300) -> np.ndarray:
    """Softmax regression by accelerated gradient steps; the last row of the weights is the constant."""
    w = np.zeros((x.shape[1], classes))
    ahead, momentum = w.copy(), 1.0
    rate = 1.0 / (0.5 * np.linalg.norm(x, 2) ** 2 + ridge) if len(x) else 1.0
    target = np.eye(classes)[y]
    for _ in range(steps):
        grad = x.T @ (softmax(x @ ahead) - target) + ridge * np.vstack([ahead[:-1], 0 * ahead[-1:]])
        new = ahead - rate * grad
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / later * (new - w), new, later
    return w


def _labelled(documents: DataFrame, labels: DataFrame, max_labels: int) -> DataFrame:
    """``text, y, part`` of a hashed sample of labelled documents; y is the worst label's domain."""
    known = labels.where(col("doc_id").isNotNull() & (col("quality").isNotNull() | col("toxic").isNotNull()))
    worst = F.when(F.max(F.coalesce(col("toxic"), F.lit(0))) > 0, 2).when(F.min(F.coalesce(col("quality"), F.lit(1))) < 1, 1).otherwise(0)
    marks = bounded_sample(known.groupBy(col("doc_id")).agg(worst.alias("y")), "doc_id", max_labels)
    rows = documents.select(col("doc_id"), col("text")).join(F.broadcast(marks), "doc_id")
    return rows.select("text", "y", crc_mod4(F.col("doc_id")).cast("int").alias("part"))


def _slot_counts(rows: DataFrame) -> DataFrame:
    """(slot, kind, n): documents of each domain and part that hold a slot, summed in each task before the shuffle."""
    kinds = 2 * len(DOMAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2 * SLOTS + 1, kinds), np.int64)
        for batch, texts in text_batches(batches):
            kind = np.array(batch.column(1)) + len(DOMAINS) * (np.array(batch.column(2)) == 3)
            for at in range(0, len(texts), 256):
                for slots, numbers in _slots(texts[at : at + 256]):
                    once = np.unique(numbers.astype(np.int64) * (2 * SLOTS) + slots)
                    np.add.at(counts, (once % (2 * SLOTS), kind[at + once // (2 * SLOTS)]), 1)
            counts[-1] += np.bincount(kind, minlength=kinds)
        for k in range(kinds):
            held = np.flatnonzero(counts[:, k])
            if len(held):
                yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(np.full(len(held), k, np.int32)), pa.array(counts[held, k])], names=["slot", "kind", "n"])

    return rows.mapInArrow(run, "slot int, kind int, n bigint").groupBy("slot", "kind").agg(F.sum("n").cast("int").alias("n"))


def log_odds(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Shrunk log-odds of each domain in each slot against the domain's share, ``CAUTION`` standard errors nearer zero."""
    n = counts.sum(axis=1, keepdims=True)
    base = (totals + 0.5) / (totals.sum() + 0.5 * len(totals))
    rate = (counts + PRIOR * base) / (n + PRIOR)
    odds = np.log(rate / (1 - rate)) - np.log(base / (1 - base))
    error = CAUTION * np.sqrt(1 / ((n + PRIOR) * rate) + 1 / ((n + PRIOR) * (1 - rate)))
    return (np.sign(odds) * np.maximum(np.abs(odds) - error, 0)).astype(np.float32)


def fit(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DomainModel:
    """Domain classifier from the labelled table: toxic, else junk (quality 0), else good.

    A doc_id labelled more than once takes its worst label; rows without a label at all are left out. At most about
    ``max_labels`` ids are used; a quarter of them (by crc32 of the id) fits the softmax over log-odds counted on the rest.
    Without labels every domain is equally likely.
    """
    rows = _labelled(documents, labels, max_labels)
    # Bounded by the slots: at most six numbers for each.
    got = _slot_counts(rows).toArrow()
    k = len(DOMAINS)
    counts = np.zeros((2 * SLOTS + 1, 2 * k))
    counts[got.column("slot").to_numpy(), got.column("kind").to_numpy()] = got.column("n").to_numpy()
    part, rest = counts[:, :k], counts[:, k:]
    shared = documents.sparkSession.sparkContext.broadcast(log_odds(part[:-1], part[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            for at in range(0, len(texts), 256):
                x, _ = _features(texts[at : at + 256], shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1).slice(at, 256)], names=["x", "y"])

    held = rows.where("part = 3").select("text", "y").mapInArrow(run, "x array<double>, y int").toArrow()
    width = 2 * k + len(_KINDS) + 1
    x = np.array(held.column("x").combine_chunks().flatten(), float).reshape(-1, width)
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(width), np.ones(width))
    design = np.column_stack([np.clip((x - mean) / spread, -8, 8), np.ones(len(x))])
    whole = part + rest
    return DomainModel(log_odds(whole[:-1], whole[-1]), mean, spread, fit_softmax(design, held.column("y").to_numpy(), k))


def _judge(texts: list[str], m: DomainModel) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors over the domains, and words (one at least), of each text."""
    x, words = _features(texts, m.odds)
    return softmax(np.clip((x - m.mean) / m.spread, -8, 8) @ m.weights[:-1] + m.weights[-1]), words


def with_posteriors(documents: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """``documents`` with ``tokens double`` (words, at least one) and ``posterior array<double>`` over ``DOMAINS``; null texts count as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        posterior, words = _judge(texts, shared.value)
        return [pa.array(words, pa.float64()), pa.array(posterior.tolist(), pa.list_(pa.float64()))]

    return add_columns(documents, "tokens double, posterior array<double>", make, text)


def _free_rate(posterior: Column, slopes: list[float]) -> Column:
    return 1.0 - sum((posterior[k] * float(x) for k, x in enumerate(slopes)), F.lit(0.0))


def rate_of(posterior: Column, slopes: list[float], repeats: float = REPEATS) -> Column:
    """A document's rate under one slope for each domain."""
    return F.least(F.lit(repeats), F.greatest(F.lit(0.0), _free_rate(posterior, slopes)))


def fit_rates(rows: DataFrame, targets: dict[str, float], growth: float = GROWTH, pull: float = PULL, repeats: float = REPEATS) -> tuple[list[float], dict[str, float]]:
    """The slopes of the domains and the target totals for rows with ``posterior`` and ``tokens``.

    Target weights are scaled to one. The budget is ``growth`` times what the scarcest-wanted domain would need: the available tokens of the first target domain over its weight. A
    domain is asked for no more than it has when its own documents, those of which no other domain is likelier, come ``repeats`` times: what is left of it in other documents does not make
    these come a hundred times.
    """
    weights = np.array([targets[d] for d in DOMAINS], float)
    weights /= weights.sum()
    k = len(DOMAINS)
    p, tokens = F.col("posterior"), F.col("tokens")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    likeliest = F.array_max(p)
    own = [total(F.when(p[i] >= likeliest, tokens * p[i])).alias(f"own_{d}") for i, d in enumerate(DOMAINS)]
    got = rows.agg(*[total(tokens * p[i]).alias(d) for i, d in enumerate(DOMAINS)], *own).first()
    available, own = np.array(got[:k]), np.array(got[k:])
    lead = int(weights.argmax())
    totals = weights * (growth * available[lead] / weights[lead])
    wanted = np.minimum(totals, available + (repeats - 1) * own)
    scale = np.maximum(available, 1e-9 * max(available.sum(), 1.0))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(slopes: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Objective of the slopes, its gradient (expected less wanted totals and the pull, from rates projected to their bounds), and how that changes."""
        free = _free_rate(p, slopes.tolist())
        rate = F.least(F.lit(repeats), F.greatest(F.lit(0.0), free))
        open_ = F.when((free > 0) & (free < repeats), tokens).otherwise(0.0)
        got = rows.agg(
            total(tokens * (free * rate - rate * rate / 2)), *[total(tokens * p[i] * rate).alias(f"h{i}") for i in range(k)], *[total(open_ * p[i] * p[j]).alias(f"m{i}{j}") for i, j in pairs]).first()
        metric = np.diag(pull * scale)
        for (i, j), x in zip(pairs, got[1 + k :]):
            metric[i, j] += x
            metric[j, i] = metric[i, j]
        return got[0] + wanted @ slopes + 0.5 * pull * (scale * slopes) @ slopes, wanted - np.array(got[1 : 1 + k]) + pull * scale * slopes, metric

    slopes = np.zeros(k)
    value, gradient, metric = sums(slopes)
    small = TOLERANCE * np.maximum(wanted, 1e-6 * max(wanted.sum(), 1.0))
    for _ in range(MOST_STEPS):
        if (np.abs(gradient) <= small).all():
            break
        step, length = np.linalg.solve(metric + 1e-12 * np.diag(scale), gradient), 1.0
        while True:
            trial = sums(slopes - length * step)
            if trial[0] <= value - 1e-4 * length * gradient @ step or length < 1e-6:
                break
            length /= 2
        slopes = slopes - length * step
        value, gradient, metric = trial
    else:
        raise RuntimeError(f"rates did not settle: projected gradient {gradient.tolist()} for {wanted.tolist()}")
    return slopes.tolist(), dict(zip(DOMAINS, totals.tolist()))


class _Rounding:
    """Rounds the rates of one task's rows, in their order, so that its domain totals stay near the expected ones, each as a share of its target."""

    def __init__(self, totals: dict[str, float]):
        self.share = 1.0 / np.maximum(np.array([totals[d] for d in DOMAINS]), 1e-9 * max(sum(totals.values()), 1.0))
        self.owed = [0.0] * len(DOMAINS)

    def copies(self, rate: np.ndarray, tokens: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        down = np.floor(rate)
        # A document's whole weight on each domain, as a share of the target.
        whole = (posterior * tokens[:, None] * self.share).tolist()
        owed, up = self.owed, np.zeros(len(rate), bool)
        for i, (w, f) in enumerate(zip(whole, (rate - down).tolist())):
            if f > 0:
                # Up is nearer if the middle between both is still owed in the document's direction.
                more = sum([(o + x * (f - 0.5)) * x for o, x in zip(owed, w)]) > 0
                owed = [o + x * (f - more) for o, x in zip(owed, w)]
                up[i] = more
        self.owed = owed
        return (down + up).astype(np.int32)


def with_copies(rows: DataFrame, totals: dict[str, float]) -> DataFrame:
    """Rows with ``tokens``, ``posterior`` and ``rate`` and their ``copies``: the rate rounded down or up.

    A task takes for each of its rows the number that keeps its domain totals nearer to the expected ones, what was
    rounded so far included. So every task is off by a document or so, however many rows it has; repeated rows may differ by one. A rate of 0 gives no copy.
    """
    rounding = _Rounding(totals)

    def make(batch: pa.RecordBatch, _: list[str]) -> list[pa.Array]:
        rate, tokens, posterior = (batch.column(batch.schema.get_field_index(c)) for c in ("rate", "tokens", "posterior"))
        flat = posterior.flatten().to_numpy().reshape(batch.num_rows, len(DOMAINS))
        return [pa.array(rounding.copies(rate.to_numpy(), tokens.to_numpy(), flat), pa.int32())]

    # Every task gets a rounding of its own, as it is sent one.
    return add_columns(rows, "copies int", make, None)


def _judged_copies(documents: DataFrame, model: DomainModel, slopes: list[float], totals: dict[str, float], text: str) -> DataFrame:
    """``documents`` with their ``copies`` in one pass over the texts."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rounding, fall = _Rounding(totals), np.array(slopes)

    def make(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        posterior, words = _judge(texts, shared.value)
        return [pa.array(rounding.copies(np.clip(1.0 - posterior @ fall, 0.0, REPEATS), words, posterior), pa.int32())]

    return add_columns(documents, "copies int", make, text)


def reached(rated: DataFrame, totals: dict[str, float]) -> dict[str, tuple[float, float, float]]:
    """Target, expected and realised tokens of each domain for rows with posterior, tokens, rate and copies; a warning names those that miss their target."""
    of = lambda n: [F.coalesce(F.sum(F.col("tokens") * F.col("posterior")[k] * F.col(n)), F.lit(0.0)).alias(f"{n}{k}") for k in range(len(DOMAINS))]
    got = list(rated.agg(*of("rate"), *of("copies")).first())
    out = {d: (totals[d], got[k], got[k + len(DOMAINS)]) for k, d in enumerate(DOMAINS)}
    missed = [f"{d}: target {t:.0f}, expected {e:.0f}, realised {r:.0f}" for d, (t, e, r) in out.items() if max(abs(e - t), abs(r - t)) > MISS * t]
    if missed:
        warnings.warn("targets of the mixture not met, in tokens: " + "; ".join(missed), stacklevel=3)
    return out


def mixture(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, tokens, p_good, p_junk, p_toxic, rate, copies of every document.

    Null texts count as empty (one token), repeated rows each get the same rate (and copies that differ by one at most), extra
    columns are ignored and an empty table gives no rows. Posteriors are written once to the shared folder and
    every step reads only them.
    """
    model = fit(documents, labels, max_labels)
    slim = with_posteriors(documents.select(col("doc_id"), text_of().alias("text")), model)
    rows = write_shared(slim.select("doc_id", "tokens", "posterior"), "posteriors")
    slopes, totals = fit_rates(rows, targets)
    rated = write_shared(with_copies(rows.withColumn("rate", rate_of(F.col("posterior"), slopes)), totals), "rates")
    forget(rows)
    reached(rated, totals)
    shares = [F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return rated.select("doc_id", F.col("tokens").cast("long").alias("tokens"), *shares, "rate", "copies")


def mix(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_labels: int = MAX_LABELS) -> DataFrame:
    """``documents`` repeated by their copies (0 drops a row); all columns pass through.

    Null texts count as empty (one token), repeated rows may differ by a copy, an empty table gives no rows. Texts are judged once for the fit, which keeps their posteriors alone, and
    once where they are repeated, so no copy of them is written. The totals that are reported are those of the posteriors rounded in their own tasks.
    """
    model = fit(documents, labels, max_labels)
    own = documents.columns
    slim = with_posteriors(documents.select(col("doc_id"), col("text")), model)
    rows = write_shared(slim.select("tokens", "posterior"), "posteriors")
    slopes, totals = fit_rates(rows, targets)
    # Numbered names keep the columns apart from those added here.
    numbered = documents.select(*[col(c).alias(f"_{i}") for i, c in enumerate(own)])
    reached(with_copies(rows.withColumn("rate", rate_of(F.col("posterior"), slopes)), totals), totals)
    forget(rows)
    marked = _judged_copies(numbered, model, slopes, totals, f"_{own.index('text')}")
    repeated = marked.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(own)])
