"""Document quality: a classifier's evidence combined with host and path posteriors by empirical Bayes."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, maybe_broadcast
from .memos import claim

#: Labelled rows on which the classifier is fitted, at most; the rows with the least hashes of doc_id are taken.
SAMPLE_ROWS = 10_000
#: A word is evidence of toxicity if this many sample documents hold it and its log-odds reach this.
WORD_DOCS, WORD_LOG_ODDS = 5, 1.5
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"!%$&*#|@~^<>=+_\\{}[]"
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SPACED = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


@dataclass
class Model:
    """Two logistic heads over standardised features, and the words that speak for toxicity."""

    words: dict[bytes, float]
    mean: np.ndarray
    scale: np.ndarray
    junk: np.ndarray
    toxic: np.ndarray
    keep_rate: float


def plain_words(text: str) -> set[bytes]:
    """Distinct lower-cased words without ASCII punctuation."""
    return set(text.encode("utf-8", "surrogatepass").lower().translate(_SPACED).split())


def features(text: str, weights: dict[bytes, float]) -> list[float]:
    """Features of a whole text; none needs more than one pass over it."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    lines = raw.split(b"\n")
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    hits = sorted((weights[w] for w in plain_words(text) & weights.keys()), reverse=True) if weights else []
    return [
        np.log1p(len(words)),
        len(set(words)) / n ** 0.8,
        sum(map(operator.eq, words, words[1:])) / n,
        share(_SYMBOLS),
        share(_UPPER),
        share(_DIGITS),
        len(raw) / n / 10,
        1 - len(set(lines)) / len(lines),
        sum(hits[:3]),
        float(min(len(hits), 4)),
    ]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def _odds(bad: int, n: int, nt: int, nc: int) -> float:
    return math.log((bad + 0.5) / (nt + 1)) - math.log((n - bad + 0.5) / (nc + 1))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word of each document."""
    for batch in batches:
        words = [list(plain_words(t)) for t in batch.column("text").to_pylist()]
        toxic = np.repeat([int(t > 0) for t in batch.column("toxic").to_pylist()], [len(w) for w in words]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([w for ws in words for w in ws], pa.binary()), pa.array(toxic)], ["word", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits the classifier on at most `sample_rows` labelled documents. Words are counted by aggregation; features come to the driver."""
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    held = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("quality", "toxic", "text")  # bounded by sample_rows
    held = checkpointed(held)
    told = held.mapInArrow(_votes, "word binary, toxic int").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    totals = held.agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("int")).alias("bad")).first()
    if not totals["n"]:
        return Model({}, np.zeros(10), np.ones(10), np.zeros(11), np.zeros(11), 0.5)
    nt, nc = totals["bad"], totals["n"] - totals["bad"]
    # only words that some toxic document holds more often than clean ones come to the driver
    told = told.where((F.col("n") >= WORD_DOCS) & (F.col("bad") / (nt + 1) > (F.col("n") - F.col("bad")) / (nc + 1)))
    counts = {bytes(r["word"]): (r["bad"], r["n"]) for r in told.toLocalIterator()}
    weights = {w: min(odds, 6.0) for w, (bad, n) in counts.items() if (odds := _odds(bad, n, nt, nc)) >= WORD_LOG_ODDS}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = [int(t > 0) for t in batch.column("toxic").to_pylist()]
            x = []
            for text, t in zip(batch.column("text").to_pylist(), toxic, strict=True):
                own = {}  # the evidence of its words, without its own vote
                for w in plain_words(text) & counts.keys():
                    bad, n = counts[w][0] - t, counts[w][1] - 1
                    if n >= WORD_DOCS and bad > 0 and (odds := _odds(bad, n, nt - t, nc - 1 + t)) >= WORD_LOG_ODDS:
                        own[w] = min(odds, 6.0)
                x.append(features(text, own))
            columns = [batch.column("quality").cast(pa.int32()), pa.array(toxic, pa.int32()), pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["quality", "toxic", "x"])

    rows = held.mapInArrow(sample, "quality int, toxic int, x array<double>").toArrow()  # sample_rows rows of ten numbers
    toxic = rows.column("toxic").to_numpy().astype(float)
    junk = 1.0 - rows.column("quality").to_numpy().astype(float)
    x = np.array(rows.column("x").to_pylist())
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = _standard(x, mean, scale)
    return Model(weights, mean, scale, _logistic(z, junk), _logistic(z, toxic), float(np.clip(((1 - junk) * (1 - toxic)).mean(), 0.01, 0.99)))


def keep_evidence(texts: list[str | None], model: Model) -> np.ndarray:
    """Log-odds that a text is good and not toxic; null texts count as empty."""
    x = np.array([features(t or "", model.words) for t in texts]).reshape(len(texts), 10)
    z = np.hstack([_standard(x, model.mean, model.scale), np.ones((len(x), 1))])
    good = 1 / (1 + np.exp(np.clip(z @ model.junk, -30, 30))) / (1 + np.exp(np.clip(z @ model.toxic, -30, 30)))
    good = np.clip(good, 1e-9, 1 - 1e-9)
    return np.log(good / (1 - good))


def _evidence(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def evidence(texts: pa.Array) -> pa.Array:
        claim("quality")
        return pa.array(keep_evidence(texts.to_pylist(), model), pa.float64())

    return evidence(text)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(0.001)), F.lit(0.999))
    return F.log(p / (1 - p))


def _by_path(site: DataFrame) -> DataFrame:
    """(host, path, n, s): how many documents have a share p, and its sum. Groups without one are left out after counting, as a
    filter by p would judge each text a second time, beside the first in a worker of its own."""
    return site.groupBy("host", "path").agg(F.count("p").alias("n"), F.sum("p").alias("s")).where("n > 0")


def _strength(groups: DataFrame) -> float:
    """Prior strength of a level by the method of moments: how many documents a parent's rate counts as.

    `groups` has n, s and rate, the parent's. The spread of group means around their parents' rates beyond what
    sampling explains is the variance between groups."""
    p = F.least(F.greatest("rate", F.lit(0.001)), F.lit(0.999))
    r = groups.where("n > 1").agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(p * (1 - p)).alias("noise"), F.sum(F.col("n") * p * (1 - p)).alias("scale"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - p) ** 2).alias("ss"),
    ).first()
    if not r["g"] or r["g"] < 2:
        return 50.0
    between = max((r["ss"] - r["noise"]) / r["n"], 1e-6)
    return float(min(max(r["scale"] / r["n"] / between - 1, 1.0), 1e4))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """`docs` with evidence, posterior (double) and keep (boolean).

    evidence is the classifier's log-odds that the text is good and not toxic. Over all documents the
    expected share of good ones is aggregated per host and per (host, path); a host's rate is shrunk
    towards the global one and a path's towards its host's, by strengths that the spread of the groups around
    their parents' rates gives, so sparse sites stay near the prior. A document's own share is left out of the
    rates that judge it. posterior adds the path's log-odds, relative to those of
    the labelled sample, to the evidence; keep is posterior >= `threshold`.

    A null or empty text has nothing to keep: posterior 0. Null hosts or paths form groups of their own.
    With no labels every text's evidence is 0. Labels of one document combine to the worst; repeated
    rows are judged alike; an empty table gives no rows. Columns named evidence, posterior or keep are
    replaced, others pass."""
    docs = docs.drop("evidence", "posterior", "keep")
    model = fit(docs, labels, sample_rows)
    # the columns of docs stay inside a struct, so that none clashes with a helper
    site = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(host.cast("string"), F.lit("\0")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("\0")).alias("path"), _evidence(F.col("text"), model).alias("evidence"),
    )
    site = site.withColumn("p", F.when(F.length("row.text") > 0, 1 / (1 + F.exp(-F.col("evidence")))))
    paths = checkpointed(_by_path(site))
    hosts = checkpointed(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(total["s"] / total["n"], 0.001), 0.999) if total["n"] else 0.5
    kh = _strength(hosts.withColumn("rate", F.lit(mean)))
    rate = lambda s, n, k, prior: (s + k * prior) / (n + k)
    hosts = hosts.select(F.col("host").alias("host_of"), F.col("n").alias("hn"), F.col("s").alias("hs"))
    groups = checkpointed(paths.join(hosts, F.col("host") == F.col("host_of")).drop("host_of"))
    kp = _strength(groups.withColumn("rate", rate(F.col("hs"), F.col("hn"), kh, F.lit(mean))))
    groups = maybe_broadcast(groups).withColumnsRenamed({"host": "g_host", "path": "g_path"})
    joined = site.join(groups, (F.col("host") == F.col("g_host")) & (F.col("path") == F.col("g_path")), "left")
    host_rate = rate(F.col("hs") - F.col("p"), F.col("hn") - 1, kh, F.lit(mean))
    path_rate = rate(F.col("s") - F.col("p"), F.col("n") - 1, kp, host_rate)
    logit = F.col("evidence") + _logit(F.coalesce(path_rate, F.lit(mean))) - _logit(F.lit(model.keep_rate))
    posterior = F.when(F.col("p").isNull(), F.lit(0.0)).otherwise(1 / (1 + F.exp(-logit)))
    judged = joined.select("row", "evidence", posterior.alias("posterior"))
    return judged.select(*[F.col("row")[c].alias(c) for c in docs.columns], "evidence", "posterior", (F.col("posterior") >= threshold).alias("keep"))
