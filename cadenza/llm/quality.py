"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic classifier on surface features gives each document's evidence. Outcomes (the classifier's probabilities, and the labels
as observations beside them) are summed by path within host and by host; each level's rate is shrunk towards the one above with a
prior strength estimated from the spread between sites, so sparse sites lean on the global rate. The document's posterior
combines its own evidence with its path's rate in place of the global one: its own evidence is taken out of every level first, so
none counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import add_columns, bounded_sample, col, ridge_logistic, text_batches, write_shared

MAX_LABELS = 50_000
BROADCAST_SITES = 100_000
FEATURES = (
    "log_bytes", "upper", "digit", "blank", "newline", "high_byte", "pipe", "hash", "percent", "ampersand", "dollar", "star", "bang", "dot",
    "comma", "other_ascii", "word_length", "long_words", "distinct_words", "distinct_lines", "line_words", "odd_endings",
)
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_OTHER = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "|#%&$*!.,"]
_ODD = tuple("|#%&$*!@~^=+<>_")


def features_of(text: str) -> list[float]:
    """Surface features of a whole text; an empty one has zeros."""
    data = text.encode()
    if not data:
        return [0.0] * len(FEATURES)
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = lambda c: float(counts[ord(c)]) / n
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    m, k = max(len(words), 1), max(len(lines), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [
        float(np.log1p(n)) / 10, float(counts[65:91].sum()) / max(int(counts[_LETTERS].sum()), 1), float(counts[48:58].sum()) / n, share(" "),
        share("\n"), float(counts[128:].sum()) / n, *[10 * share(c) for c in "|#%&$*!"], share("."), share(","), float(counts[_OTHER].sum()) / n,
        float(lengths.sum()) / m / 10, float((lengths > 20).sum()) / m, len(set(words)) / m, len(set(lines)) / k, min(m / k, 200.0) / 100,
        sum([w.endswith(_ODD) for w in words]) / m,
    ]


@dataclass(frozen=True)
class QualityModel:
    """Standardised logistic weights; the prior rate is that of the labelled rows."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float


def labelled_features(documents: DataFrame, labels: DataFrame, target: str, allowed: Column | None, max_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and targets of a hashed sample of at most about ``max_labels`` labelled ids (22 numbers each, to the driver)."""
    marks = labels.where(col("doc_id").isNotNull() & col(target).isNotNull()).groupBy(col("doc_id")).agg(F.min(col(target)).cast("double").alias("y"))
    marks = bounded_sample(marks if allowed is None else marks.where(allowed), "doc_id", max_labels)
    rows = documents.select(col("doc_id"), col("text")).join(F.broadcast(marks), "doc_id").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array([features_of(t) for t in texts], pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    got = rows.mapInArrow(run, "x array<double>, y double").toArrow()
    if not got.num_rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return np.array(got.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES)), got.column("y").to_numpy()


def fit(documents: DataFrame, labels: DataFrame, target: str = "quality", allowed: Column | None = None, max_labels: int = MAX_LABELS) -> QualityModel:
    """Classifier of ``target`` (1 good); of an id labelled more than once the lowest label counts.

    Without labels every text gets even odds.
    """
    x, y = labelled_features(documents, labels, target, allowed, max_labels)
    if not len(y):
        d = len(FEATURES)
        return QualityModel(np.zeros(d), np.ones(d), np.zeros(d + 1), 0.5)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    design = np.column_stack([np.clip((x - mean) / spread, -8, 8), np.ones(len(y))])
    return QualityModel(mean, spread, ridge_logistic(design, y, 1.0), float((y.sum() + 1) / (len(y) + 2)))


def with_evidence(documents: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``documents`` with ``evidence double``, the log-odds of good quality from the text alone; null texts count as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        m = shared.value
        x = (np.array([features_of(t) for t in texts]) - m.mean) / m.spread
        return [pa.array(np.clip(np.clip(x, -8, 8) @ m.weights[:-1] + m.weights[-1], -30, 30), pa.float64())]

    return add_columns(documents, "evidence double", make, text)


def _strength(total: Column, n: Column) -> Column:
    """Moment estimate of a beta prior's strength from rates of sites with five rows or more, between 1 and 10,000."""
    enough = n >= 5
    mean = F.sum(F.when(enough, total)) / F.sum(F.when(enough, n))
    between = F.var_pop(F.when(enough, total / n)) - F.avg(F.when(enough, 1.0 / n)) * mean * (1 - mean)
    return F.coalesce(F.when(between > 0, F.least(F.greatest(mean * (1 - mean) / between - 1, F.lit(1.0)), F.lit(10_000.0))), F.lit(10_000.0))


def _site_sums(rows: DataFrame, host: str, path: str) -> DataFrame:
    """``(host, path, good, n)`` of rows with host, path and ``_outcome``, pre-aggregated before the shuffle and written."""
    sums = rows.groupBy(col(host).alias("host"), col(path).alias("path")).agg(F.sum("_outcome").alias("good"), F.count("*").cast("double").alias("n"))
    return write_shared(sums, "paths")


def _levels(paths: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Path sums beside their host's, and the world's sums with the two prior strengths (four numbers to the driver)."""
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    world = hosts.agg(
        F.coalesce(F.sum("host_good"), F.lit(0.0)).alias("good"), F.coalesce(F.sum("host_n"), F.lit(0.0)).alias("n"),
        _strength(F.col("host_good"), F.col("host_n")).alias("host_k"),
    ).first().asDict()
    world["path_k"] = paths.agg(_strength(F.col("good"), F.col("n")).alias("k")).first()["k"]
    return paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"]), world


def _rates(world: dict[str, float], site: Column, own: Column, count: int) -> tuple[Column, Column]:
    """Host and path rate of a site (a struct of sums) without ``count`` rows whose outcomes sum to ``own``."""
    top = (F.lit(world["good"]) - own + 1) / (world["n"] - count + 2)
    host_rate = (site["host_good"] - own + world["host_k"] * top) / (site["host_n"] - count + world["host_k"])
    return host_rate, (site["good"] - own + world["path_k"] * host_rate) / (site["n"] - count + world["path_k"])


def site_rates(evidence: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(host, path, n, host_rate, path_rate) of every site from rows with host, path and evidence.

    Null hosts and paths form sites of their own. Rows are pre-aggregated before the shuffle, so a host with a
    third of all rows costs one record for each task.
    """
    joined, world = _levels(_site_sums(evidence.withColumn("_outcome", 1 / (1 + F.exp(-F.col("evidence")))), host, path))
    host_rate, path_rate = _rates(world, F.struct("host_good", "host_n", "good", "n"), F.lit(0.0), 0)
    return joined.select("host", "path", F.col("n").cast("long").alias("n"), host_rate.alias("host_rate"), path_rate.alias("path_rate"))


def score_evidence(
    marked: DataFrame, prior: float, labels: DataFrame | None = None, host: str = "source", path: str = "lang", summed: DataFrame | None = None
) -> DataFrame:
    """Rows with ``evidence`` and their host_rate, path_rate and quality (posterior).

    Sites are summed over ``summed``, written rows with doc_id, host, path and evidence of the same documents (``marked`` itself if
    left out, which must then be written). Both rates leave the row's own evidence out. ``labels`` (doc_id, quality; of several the lowest) add an observation each to their
    document's site; they meet ids and sites only, so no text is shuffled. The site table is broadcast only up to ``BROADCAST_SITES``
    sites; beyond that the join is left to Spark, which may split a hot site's rows.
    """
    marked = marked.select(*[col(c) for c in marked.columns if c not in ("host_rate", "path_rate", "quality")])
    rows = marked.withColumn("_outcome", 1 / (1 + F.exp(-F.col("evidence"))))
    summed = marked if summed is None else summed
    seen = summed.select(col(host).alias("host"), col(path).alias("path"), (1 / (1 + F.exp(-F.col("evidence")))).alias("_outcome"))
    if labels is not None:
        known = labels.where(col("doc_id").isNotNull() & col("quality").isNotNull()).groupBy(col("doc_id").alias("_labelled")).agg(
            F.min((col("quality") > 0).cast("double")).alias("_outcome"))
        at = summed.select(col("doc_id").alias("_labelled"), col(host).alias("host"), col(path).alias("path"))
        seen = seen.union(at.join(known, "_labelled").select("host", "path", "_outcome"))
    joined, world = _levels(_site_sums(seen, "host", "path"))
    sites = write_shared(joined, "sites")
    side = sites.select(F.struct(*[F.col(c) for c in sites.columns]).alias("_site"))
    if sites.count() <= BROADCAST_SITES:
        side = F.broadcast(side)
    met = rows.join(side, col(host).eqNullSafe(F.col("_site")["host"]) & col(path).eqNullSafe(F.col("_site")["path"]))
    host_rate, path_rate = _rates(world, F.col("_site"), F.col("_outcome"), 1)
    met = met.withColumns({"host_rate": host_rate, "path_rate": path_rate})
    logit = lambda p: F.log(p / (1 - p))
    shifted = F.col("evidence") - float(np.log(prior / (1 - prior))) + logit(F.least(F.greatest(F.col("path_rate"), F.lit(1e-4)), F.lit(1 - 1e-4)))
    return met.withColumn("quality", 1 / (1 + F.exp(-shifted))).drop("_site", "_outcome")


def score(documents: DataFrame, model: QualityModel, labels: DataFrame | None = None, host: str = "source", path: str = "lang") -> DataFrame:
    """``documents`` with evidence, host_rate, path_rate and quality; columns of these names are replaced.

    Only ids, sites and evidence are written before sites are summed: the evidence of a text is made again where its row is judged, so
    that no copy of the texts is kept and none is shuffled.
    """
    slim = with_evidence(documents.select(*[col(c) for c in dict.fromkeys(("doc_id", "text", host, path))]), model).drop("text")
    return score_evidence(with_evidence(documents, model), model.prior, labels, host, path, write_shared(slim, "evidence"))


def quality_table(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, quality, keep of every document (repeated rows each give one)."""
    model = fit(documents, labels, max_labels=max_labels)
    marked = with_evidence(documents.select(*[col(c) for c in ("doc_id", "text", "lang", "source")]), model)
    scored = score_evidence(write_shared(marked.drop("text"), "evidence"), model.prior, labels)
    return scored.select("doc_id", "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= threshold).alias("keep"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labels: int = MAX_LABELS) -> DataFrame:
    """``documents`` whose posterior reaches ``threshold``; all columns pass through."""
    model = fit(documents, labels, max_labels=max_labels)
    marked = documents.withColumns({f"_keep_{c}": col(c) for c in documents.columns if c in ("evidence", "host_rate", "path_rate", "quality")})
    kept = score(marked, model, labels).where(F.col("quality") >= threshold)
    return kept.select(*[F.col(f"_keep_{c}").alias(c) if f"_keep_{c}" in kept.columns else col(c) for c in documents.columns])
