"""Quality and toxicity with hierarchical empirical Bayes.

1. Evidence of a document: how the words of the labelled documents are spread over a
   label, in a hashed table of fixed size (``BUCKETS``), and shape statistics of the
   whole text, joined by a logistic regression.
2. Sites: the documents' probabilities are summed by path and host in grouped
   aggregations.  A document's host rate is that of the host's **other** documents, shrunk
   toward the global rate; its path rate that of the path's other documents, shrunk
   toward its host rate.  Prior weights come from the method of moments, so sparse sites
   stay near their parent, and a document's own evidence is not counted twice.
3. Posterior: the evidence's log odds plus the site's log-odds shift, times a weight
   that is fitted on the labelled rows (0 if sites tell nothing).

The classifier is fitted on a bounded sample: at most ``max_labelled`` labelled ids by hash
order, of which one half is for the words, the other for the regressions; an id with several
rows or labels counts once.  Every word takes part.  Sites cover all documents; their sums are joined by
Spark, which decides how.

Defined results: a null or empty text has the evidence of the empty text and is
not kept; null hosts and paths are sites of their own; without labelled rows the evidence is the prior,
without labelled rows of both kinds a label's evidence is 0; repeated rows count as often as they occur.
The input's other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize
from .decontaminate import _WORD_BYTES
from .substring_dedup import word_hashes

LABELS = ("quality", "toxic")
EVIDENCE_DDL = "quality double, toxic double"
BUCKETS = 1 << 18
_CHANCE = 2.5  # roots of the likelihood ratio up to here are taken for chance
_MAX_ROOT = 30.0
_U = np.uint64
_STOPS, _SYMBOLS, _BANGS = (np.frombuffer(x, np.uint8) for x in (b".,;:", b"#$%&*@^~|<>=+_{}[]\\", b"!?"))


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; null if it has none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path_of(url: Column) -> Column:
    """First folder of a URL's path, ``/`` for the root."""
    return F.concat(F.lit("/"), F.get(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), F.lit(1)))


def shape(raw: bytes, words: np.ndarray, n_chars: int) -> list[float]:
    """Statistics of the whole text, each about in 0 to 1; ``words`` are hashes in order."""
    n = max(1, n_chars)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    k = max(1, len(words))
    pairs = words[:-1] * _U(0x9E3779B97F4A7C15) + words[1:]
    lines = raw.split(b"\n")
    return [
        counts[65:91].sum() / n,
        counts[48:58].sum() / n,
        counts[_SYMBOLS].sum() / n,
        counts[_BANGS].sum() / n,
        counts[124] / n,
        counts[_STOPS].sum() / n,
        len(np.unique(words)) / k,
        1 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0.0,
        1 - len(set(lines)) / len(lines),
        min(2.0, np.log1p(len(words)) / 8),
        min(2.0, n_chars / k / 10),
        1.0 / k,
    ]


def _words(raw: bytes) -> np.ndarray:
    return word_hashes(raw.translate(_WORD_BYTES))


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


@dataclass
class Model:
    roots: dict[str, np.ndarray]  # by bucket of a word's hash
    coef: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    site_weight: dict[str, float] = field(default_factory=lambda: dict.fromkeys(LABELS, 0.0))

    def features(self, text: str | None) -> np.ndarray:
        raw = _raw(text)
        words = _words(raw)
        buckets = np.unique((words & _U(BUCKETS - 1)).astype(np.int64))
        extra = []
        for k in LABELS:
            own = self.roots[k][buckets]
            up, down = np.sort(own[own > 0])[::-1], np.sort(-own[own < 0])[::-1]
            extra += [min(_MAX_ROOT, x[i]) if len(x) > i else 0.0 for x in (up, down) for i in (0, 1)]
            extra += [np.log1p(up.sum()), np.log1p(down.sum())]
        return np.array(shape(raw, words, len(text or "")) + extra)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.stack([np.clip(z @ self.coef[k][1:] + self.coef[k][0], -12, 12) for k in LABELS], axis=1)


def likelihood_roots(n: np.ndarray, pos: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Signed roots of the likelihood ratio that a bucket's documents, ``n`` with
    ``pos`` of the label, are spread as all are; pulled toward 0 by what chance gives."""
    if not n_pos or not n_neg:
        return np.zeros(len(n))
    a, b = pos + 0.5, n - pos + 0.5
    ratio = 2 * (a * np.log(a * (n_pos + n_neg) / ((a + b) * n_pos)) + b * np.log(b * (n_pos + n_neg) / ((a + b) * n_neg)))
    return np.sign(a * n_neg - b * n_pos) * np.maximum(0.0, np.sqrt(np.maximum(0.0, ratio)) - _CHANCE)


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labelled: int) -> DataFrame | None:
    """id, text, quality, toxic, half: one row for each of at most ``max_labelled`` ids."""
    spark = docs.sparkSession
    usable = labels.where("quality is not null and toxic is not null").where(F.col(id_col).isNotNull())
    one = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = one.orderBy(F.xxhash64("id"), "id").limit(max_labelled).collect()
    if not chosen:
        return None
    kind = one.schema["id"].dataType.simpleString()
    small = spark.createDataFrame([(r.id, r.quality, r.toxic, i % 2) for i, r in enumerate(chosen)], f"id {kind}, quality int, toxic int, half int")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(small), "id")  # bounded by max_labelled
    return materialize(rows.groupBy("id", "quality", "toxic", "half").agg(F.min("text").alias("text")))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000) -> Model:
    rows = labelled_rows(docs, labels, id_col, text_col, max_labelled)
    return fit_rows(rows)


def fit_rows(labelled: DataFrame | None) -> Model:
    model = Model({k: np.zeros(BUCKETS) for k in LABELS}, {}, np.zeros(0), np.ones(0))
    n_features = len(model.features(""))
    model.mean, model.scale = np.zeros(n_features), np.ones(n_features)
    model.coef = {k: np.zeros(n_features + 1) for k in LABELS}
    if labelled is None:
        return model

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((3, BUCKETS), np.int64)
        for frame in frames:
            for text, *marks in zip(frame["text"], frame["quality"], frame["toxic"], strict=True):
                own = np.unique((_words(_raw(text)) & _U(BUCKETS - 1)).astype(np.int64))
                for row, mark in zip(sums, (1, *marks), strict=True):
                    row[own] += int(mark)
        used = np.flatnonzero(sums[0])
        yield pd.DataFrame({"bucket": used.astype(np.int32), "n": sums[0, used], "quality": sums[1, used], "toxic": sums[2, used]})

    first = labelled.where("half = 0")
    counts = first.select("text", "quality", "toxic").mapInPandas(count, "bucket int, n long, quality long, toxic long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", *LABELS)]).toArrow()
    n, bucket = np.zeros(BUCKETS), counts["bucket"].to_numpy()
    n[bucket] = counts["n"].to_numpy()
    total = first.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in LABELS]).first()
    for k in LABELS:
        pos = np.zeros(BUCKETS)
        pos[bucket] = counts[k].to_numpy()
        model.roots[k] = likelihood_roots(n, pos, total[k], total["n"] - total[k])

    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"x": [shared.value.features(t) for t in frame["text"]], "quality": frame["quality"], "toxic": frame["toxic"]})

    rows = labelled.where("half = 1").select("text", "quality", "toxic").mapInPandas(features, "x array<double>, quality int, toxic int").toPandas()
    if len(rows):
        x = np.array(rows["x"].to_list())
        model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = np.hstack([np.ones((len(x), 1)), (x - model.mean) / model.scale])
        model.coef = {k: _logistic(z, rows[k].to_numpy(dtype=float)) for k in LABELS}
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30, offset: np.ndarray | float = 0.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        g = x.T @ (p - y) + reg * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def evidence(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "evidence") -> DataFrame:
    """``docs`` with a struct column of log odds for each label. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(EVIDENCE_DDL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([(k, pa.float64()) for k in LABELS])
        for batch in batches:
            if len(batch):
                odds = shared.value.log_odds(np.array([shared.value.features(t.as_py()) for t in batch]))
                yield pa.StructArray.from_arrays([pa.array(odds[:, j]) for j in range(len(LABELS))], fields=list(kind))
            else:
                yield pa.array([], kind)

    return docs.withColumn(out, run.asNondeterministic()(F.col(text_col)))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_sums(scored: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float, float]]]:
    """One row a (host, path) with the numbers of documents and the sums of their
    probabilities, by path and by host; and for each label the global rate and the prior
    weights of hosts and paths: ``m (1 - m) / between-site variance - 1``, from 1 to 1e6."""
    probability = {k: 1 / (1 + F.exp(-F.col(k))) for k in LABELS}
    sums = [F.count("*").alias("n")] + [F.sum(p).alias(f"s_{k}") for k, p in probability.items()] + [F.sum(p * p).alias(f"ss_{k}") for k, p in probability.items()]
    paths = materialize(scored.groupBy("host", "path").agg(*sums))
    names = ["n", *[f"{c}_{k}" for k in LABELS for c in ("s", "ss")]]
    hosts = paths.groupBy(F.col("host").alias("h_")).agg(*[F.sum(c).alias(f"host_{c}") for c in names])
    both = materialize(paths.join(hosts, paths.host.eqNullSafe(F.col("h_"))).drop("h_"))
    total = paths.agg(*[F.sum(c).alias(c) for c in names]).first()
    priors = {}
    for k in LABELS:
        mean = min(1 - 1e-4, max(1e-4, total[f"s_{k}"] / total["n"])) if total["n"] else 0.5

        def weight(sites: DataFrame, n: str, s: str, ss: str, parent: Column) -> float:
            """Moments: spread of the sites' means about their parent's, less what sampling explains."""
            m = F.col(s) / F.col(n)
            inner = F.greatest(F.lit(0.0), F.col(ss) / F.col(n) - m * m)
            r = sites.agg(F.sum(F.col(n) * (m - parent) * (m - parent)).alias("between"), F.sum(inner).alias("noise"), F.sum(n).alias("n")).first()
            spread = max(1e-9, ((r.between or 0) - (r.noise or 0)) / max(1, r.n or 1))
            return float(min(1e6, max(1.0, mean * (1 - mean) / spread - 1)))  # noqa: B023

        k_host = weight(hosts, "host_n", f"host_s_{k}", f"host_ss_{k}", F.lit(mean))
        host_rate = (F.col(f"host_s_{k}") + k_host * mean) / (F.col("host_n") + k_host)
        priors[k] = (mean, k_host, weight(both, "n", f"s_{k}", f"ss_{k}", host_rate))
    return both, priors


def with_site_rates(scored: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float, float]]]:
    """``scored`` with ``<label>_rate``, the shrunk rate of the site's other documents, and
    ``<label>_shift``, its log odds less those of the global rate."""
    sites, priors = site_sums(scored)
    sites = sites.withColumnsRenamed({"host": "h_", "path": "p_"})
    rows = scored.join(sites, scored.host.eqNullSafe(F.col("h_")) & scored.path.eqNullSafe(F.col("p_")))
    for k, (mean, k_host, k_path) in priors.items():
        own = 1 / (1 + F.exp(-F.col(k)))
        host_rate = (F.col(f"host_s_{k}") - own + k_host * mean) / (F.col("host_n") - 1 + k_host)
        rate = (F.col(f"s_{k}") - own + k_path * host_rate) / (F.col("n") - 1 + k_path)
        rows = rows.withColumn(f"{k}_rate", F.least(F.lit(1 - 1e-4), F.greatest(F.lit(1e-4), rate)))
        rows = rows.withColumn(f"{k}_shift", _logit(F.col(f"{k}_rate")) - float(np.log(mean / (1 - mean))))
    return rows.select(*scored.columns, *[f"{k}_{x}" for k in LABELS for x in ("rate", "shift")]), priors


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: Column, path: Column, site_weight: float | None = None, max_labelled: int = 20_000) -> DataFrame:
    """id, host, path, p_quality, p_toxic, keep. Texts are read by the evidence
    pass only; what is shuffled are sums by site and narrow rows.  ``site_weight`` is fitted if not given."""
    labelled = labelled_rows(docs, labels, id_col, text_col, max_labelled)
    model = fit_rows(labelled)
    rows = docs.select(F.col(id_col).alias("doc_id"), host.alias("host"), path.alias("path"), F.col(text_col).alias("text"))
    scored = materialize(evidence(rows, model).select("doc_id", "host", "path", (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("has_text"), *[F.col(f"evidence.{k}").alias(k) for k in LABELS]))
    out, _ = with_site_rates(scored)
    weights = dict.fromkeys(LABELS, site_weight or 0.0)
    if site_weight is None and labelled is not None:
        marks = labelled.where("half = 1").select(F.col("id").alias("doc_id"), *[F.col(k).alias(f"y_{k}") for k in LABELS])
        known = out.join(F.broadcast(marks), "doc_id").groupBy("doc_id", *[f"y_{k}" for k in LABELS])  # bounded by max_labelled
        known = known.agg(*[F.min(c).alias(c) for k in LABELS for c in (k, f"{k}_shift")]).toPandas()
        for k in LABELS:
            shift, y = known[f"{k}_shift"].to_numpy(float), known[f"y_{k}"].to_numpy(float)
            if len(known):
                fitted = _logistic(np.stack([np.ones(len(y)), shift], axis=1), y, offset=known[k].to_numpy(float))
                weights[k] = float(max(0.0, fitted[1]))
    for k in LABELS:
        out = out.withColumn(f"p_{k}", 1 / (1 + F.exp(-(F.col(k) + weights[k] * F.col(f"{k}_shift")))))
    return out.select("doc_id", "host", "path", "p_quality", "p_toxic", "quality_rate", "toxic_rate", (F.col("has_text") & (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)).alias("keep"))
