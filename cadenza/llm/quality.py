"""Quality classifier by hierarchical empirical Bayes.

1. Evidence: two logistic regressions, for quality and for being toxic, give every document its log-odds of being good (quality and not toxic).
   Their inputs are twelve shape ratios and the shares of words and of beginnings of words, by hash, that differ significantly between the classes
   of a bounded sample of labelled rows. A few insults in a long text count by their share, and a stem counts in all its forms.
2. Sites: the expected numbers of good documents are summed by host and path over all documents. A host's rate is
   shrunk toward the global rate and a path's toward its host's, by as much as the spread between sites (method of
   moments) says: sparse sites take their parent's rate, large ones keep their own.
3. Posterior: evidence plus the log-odds of the document's path, less the global log-odds.

Nulls, empties, repeats: a null text is empty and has evidence from its bias alone; null hosts and paths are sites of their own
(the empty name); repeated rows count as often as they stand there in the rates, once in the fit; a label whose classes
aren't both there is left out, and without either the evidence is 0 and everything is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

#: Labelled ids, at most, that the regressions are fitted to: those with the least hash.
SAMPLE = 12_000
BUCKETS = 1 << 18
#: A word or beginning is taken if its documents' shares in the classes differ by so many deviations, and so many documents have it; of more than MOST_WORDS the most different.
DEVIATIONS, LEAST_DOCS, MOST_WORDS = 4.0, 5, 2048
#: Bytes of the beginnings of longer words; words of a text that make a word count in full (as a share).
BEGINNINGS, FULL = (4, 6, 8), 0.02
RIDGE = 1e-3
#: A label that the sample's own rows don't show by this share of each class, on average, is left out.
LEAST_SHOWN = 0.75
TARGETS = ("quality", "toxic")
THRESHOLD = 0.5
#: Sites, at most, that are broadcast; beyond, the join is by shuffle.
SITES = 100_000
#: A site's prior weighs as so many documents at least and at most.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e9

_CLASSES = [re.compile(p) for p in (r"[A-Z]", r"[a-z]", r"[0-9]", r"[!?]", r"[#$%&*|~^=_<>{}\[\]\\/@+`]", r"\n", r" ")]
_KIND = np.array([1 if b > 127 else next((k for k, c in enumerate(_CLASSES) if c.match(chr(b))), 7) for b in range(256)])
_SALT = wordhash._random(max(BEGINNINGS) + 1, 11)
N_SHAPE = 12


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: buckets of its distinct words and beginnings, how much each counts (0 to 1), and shape ratios."""
    raws, lows = [t.encode() for t in texts], [t.lower().encode() for t in texts]
    b = np.frombuffer(b" ".join(lows), np.uint8)
    start, end = wordhash.bounds(b, wordhash.NOT_WORD)
    words = wordhash.spans(b, start, end)
    parts = [(words, np.arange(len(words)))]
    for k in BEGINNINGS:
        longer = np.flatnonzero(end - start > k)
        parts.append((wordhash.spans(b, start[longer], start[longer] + k) ^ _SALT[k], longer))
    stops = np.searchsorted(start, np.cumsum([len(t) + 1 for t in lows])).tolist()
    cuts = [np.searchsorted(at, [0, *stops]).tolist() for _, at in parts]
    for i, (raw, x, y) in enumerate(zip(raws, [0, *stops], stops)):
        own, n, m = words[x:y], max(1, len(raw)), max(1, y - x)
        buckets, times = np.unique(np.concatenate([h[c[i] : c[i + 1]] for (h, _), c in zip(parts, cuts)]) & np.uint64(BUCKETS - 1), return_counts=True)
        kinds, lines = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8), raw.split(b"\n")
        again = float((own[1:] == own[:-1]).mean()) if len(own) > 1 else 0.0
        shape = np.array([*np.sqrt(kinds[[0, 2, 3, 4, 5, 6, 7]] / n), np.sqrt(again), len(np.unique(own)) / m, np.log1p(y - x), len(raw) / m / 10, 1 - len(set(lines)) / len(lines)])
        yield buckets.astype("<u4"), np.minimum(1.0, times / (m * FULL)).astype("<f4"), shape


class Evidence:
    """Sorted buckets, and for each label that was learned its sign (1: good) and its weights of these, of shape ratios, and its bias."""

    def __init__(self, buckets: np.ndarray, targets: list[tuple[int, np.ndarray, np.ndarray, float]]):
        self.buckets, self.targets = buckets, targets

    def taken(self, found: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the buckets, and shares, of those of a text that are there."""
        at = np.searchsorted(self.buckets, found)
        own = np.flatnonzero(self.buckets[np.minimum(at, len(self.buckets) - 1)] == found) if len(self.buckets) else np.zeros(0, np.int64)
        return at[own], shares[own]

    @staticmethod
    def shown(sizes: np.ndarray, at: np.ndarray, shares: np.ndarray, shapes: np.ndarray, w: np.ndarray, shape: np.ndarray, bias: float) -> np.ndarray:
        """Log-odds of a label for texts whose ``sizes`` buckets stand one after the other."""
        rows = np.repeat(np.arange(len(sizes)), sizes)
        return np.bincount(rows, weights=w[at] * shares, minlength=len(sizes)) + shapes @ shape + bias

    def of(self, texts: list[str]) -> list[float]:
        return [self._odds(*self.taken(found, shares), shape) for found, shares, shape in features(texts)]

    def _odds(self, at: np.ndarray, shares: np.ndarray, shape: np.ndarray) -> float:
        """Log-odds that all labels are good at once."""
        if not self.targets:
            return 0.0
        good = sum(-np.logaddexp(0.0, -sign * (weights[at] @ shares + shape @ own + bias)) for sign, weights, own, bias in self.targets)
        return float(np.clip(good - np.log(-np.expm1(min(good, -1e-13))), -30, 30))


def fit(rows: np.ndarray, at: np.ndarray, shares: np.ndarray, shapes: np.ndarray, y: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression of ``y`` on sparse shares (``rows``, ``at``) and shapes, by Newton steps with conjugate gradients; both classes weigh the same in all."""
    n = len(y)
    middle, spread = shapes.mean(axis=0), shapes.std(axis=0) + 1e-9
    dense = np.hstack([(shapes - middle) / spread, np.ones((n, 1))])
    weight, ridge = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum()), np.full(n_buckets + dense.shape[1], RIDGE)
    ridge[-1] = 1e-9
    score = lambda w: np.bincount(rows, weights=w[at] * shares, minlength=n) + dense @ w[n_buckets:]
    back = lambda r: np.r_[np.bincount(at, weights=r[rows] * shares, minlength=n_buckets), dense.T @ r]
    w = np.zeros(len(ridge))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(score(w), -30, 30)))
        left = -(back(weight * (p - y)) + ridge * w)
        if left @ left < 1e-14:
            break
        curve, step, way, size = weight * p * (1 - p), np.zeros_like(w), left.copy(), left @ left
        for _ in range(100):
            bent = back(curve * score(way)) + ridge * way
            far = size / (way @ bent)
            step += far * way
            left = left - far * bent
            size, before = left @ left, size
            if size < 1e-16:
                break
            way = left + size / before * way
        w += step
    own = w[n_buckets:-1] / spread
    return w[:n_buckets], own, float(w[-1] - own @ middle)


def _emit_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        found = list(features(common.column(batch, "text")))
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("place", "doc_id", *TARGETS)]
        made = [pa.array([f[k].tobytes() for f in found], pa.binary()) for k in range(2)] + [pa.array([f[2] for f in found], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*kept, *made], ["place", "doc_id", *TARGETS, "words", "shares", "shape"])


def _emit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket that the task's texts have: how many have it, and how many of each label."""
    total = np.zeros((1 + len(TARGETS), BUCKETS), np.int64)
    for batch in batches:
        for words, *labels in zip(*(common.column(batch, c) for c in ("words", *TARGETS))):
            at = np.frombuffer(words, "<u4")
            for k, has in enumerate((True, *labels)):
                if has:
                    total[k, at] += 1
    at = np.flatnonzero(total[0])
    yield pa.record_batch({"at": at, "n": total[0, at]} | {t: total[k + 1, at] for k, t in enumerate(TARGETS)})


def _emit_fit(buckets: np.ndarray):
    """A row of weights for each label that has both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, shares, sizes, shapes, labels = Evidence(buckets, []), [], [], [], [], []
        for batch in batches:
            for words, share, shape, *label in zip(*(common.column(batch, c) for c in ("words", "shares", "shape", *TARGETS))):
                a, v = own.taken(np.frombuffer(words, "<u4"), np.frombuffer(share, "<f4"))
                at.append(a.astype(np.uint16))
                shares.append(v)
                sizes.append(len(a))
                shapes.append(shape)
                labels.append(label)
        y = np.array(labels, bool).reshape(-1, len(TARGETS))
        for k in range(len(TARGETS) if len(y) else 0):
            if y[:, k].any() and not y[:, k].all():
                w, shape, bias = fit(np.repeat(np.arange(len(y), dtype=np.int32), sizes), np.concatenate(at), np.concatenate(shares), np.array(shapes, float), y[:, k], len(buckets))
                shown = own.shown(np.array(sizes), np.concatenate(at), np.concatenate(shares), np.array(shapes, float), w, shape, bias) > 0
                if (shown[y[:, k]].mean() + (~shown[~y[:, k]]).mean()) / 2 < LEAST_SHOWN:
                    continue
                yield pa.record_batch({"target": pa.array([k], pa.int64()), "words": pa.array([w], pa.list_(pa.float64())), "shape": pa.array([shape], pa.list_(pa.float64())), "bias": pa.array([bias], pa.float64())})

    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Evidence:
    """Fit to at most ``sample`` labelled ids; ``labels``: doc_id, quality, toxic.

    An id has quality if all its labels say so, and is toxic if any does; of rows that repeat an id, one counts. Features are made where texts lie and written
    once; Spark counts them by class and the driver gets those that differ; one task fits the weights from these alone.
    """
    some = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0)) == 1).alias("quality"), F.max(F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))
    some = some.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("place", "doc_id", *TARGETS, "text")
    found = rows.mapInArrow(_emit_features, "place long, doc_id long, quality boolean, toxic boolean, words binary, shares binary, shape array<double>")
    found = found.groupBy("place", "doc_id").agg(F.min(F.struct("words", "shares", "shape", *TARGETS)).alias("x")).select("place", "doc_id", "x.*")
    found = common.materialize(found, "quality-features")
    total = found.agg(F.count("*").alias("n"), *[F.count_if(t).alias(t) for t in TARGETS]).first()
    counts = found.mapInArrow(_emit_counts, "at long, n long, quality long, toxic long").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)])
    gap, n = F.lit(0.0), F.col("n")
    for t in TARGETS:
        ones, zeros = total[t], total["n"] - total[t]
        if ones and zeros:
            p = n / total["n"]
            off = F.abs(F.col(t) / ones - (n - F.col(t)) / zeros) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / ones + 1 / zeros))
            gap = F.greatest(gap, off)
    differ = counts.where(n >= LEAST_DOCS).withColumn("gap", gap).where(F.col("gap") >= DEVIATIONS).orderBy(F.col("gap").desc(), "at").limit(MOST_WORDS).select("at")
    buckets = np.array(sorted(r["at"] for r in differ.collect()), "<u4")
    fitted = found.repartition(1).sortWithinPartitions("place", "doc_id").mapInArrow(_emit_fit(buckets), "target long, words array<double>, shape array<double>, bias double").collect()
    return Evidence(buckets, [(1 if TARGETS[r["target"]] == "quality" else -1, np.array(r["words"]), np.array(r["shape"]), r["bias"]) for r in fitted])


def _emit_evidence(own: Evidence):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            scores = pa.array(own.of(common.column(batch, "text")), pa.float64())
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*kept, scores], ["doc_id", "host", "path", "evidence"])

    return run


def _prior_weight(rows: DataFrame, rate: str, parent: str) -> float:
    """Documents that a parent's rate weighs as: mean p(1-p) over the spread of rates that sampling doesn't explain."""
    p = F.col(parent)
    r = rows.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col(rate) - p) ** 2).alias("spread"), F.sum(F.col("n") * p * (1 - p)).alias("noise"), F.sum(p * (1 - p)).alias("sampled")).first()
    if not r["n"] or not r["noise"]:
        return LEAST_WEIGHT
    between = (r["spread"] - r["sampled"]) / r["n"]
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, r["noise"] / r["n"] / between - 1)) if between > 0 else MOST_WEIGHT


def site_rates(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, n, host_rate, path_rate; global rate) from host, path, evidence of all documents."""
    good = 1 / (1 + F.exp(-F.col("evidence")))
    paths = common.materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(good).alias("good")), "paths")
    total = paths.agg(F.sum("n"), F.sum("good")).first()
    rate = min(1 - 1e-6, max(1e-6, (total[1] or 0.5) / (total[0] or 1)))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    hosts = hosts.withColumns({"rate": F.col("good") / F.col("n"), "parent": F.lit(rate)})
    weight = _prior_weight(hosts, "rate", "parent")
    hosts = hosts.select("host", ((F.col("good") + weight * rate) / (F.col("n") + weight)).alias("host_rate"))
    paths = common.materialize(paths.join(hosts, "host").withColumn("rate", F.col("good") / F.col("n")), "site-rates")
    weight = _prior_weight(paths, "rate", "host_rate")
    shrunk = (F.col("good") + weight * F.col("host_rate")) / (F.col("n") + weight)
    return paths.select("host", "path", "n", "host_rate", F.least(F.greatest(shrunk, F.lit(1e-6)), F.lit(1 - 1e-6)).alias("path_rate")), rate


def site_of(url: Column) -> tuple[Column, Column]:
    """Host, and first part of the path, of a URL: a site's two levels, for ``host_col`` and ``path_col``."""
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)), F.regexp_extract(url, r"^[a-z]+://[^/?#]+/([^/?#]*)", 1)


def _rows(docs: DataFrame, host_col: str, path_col: str, id_col: str, text_col: str) -> DataFrame:
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((host_col, "host"), (path_col, "path"))]
    return common.id_text(docs, *names, id_col=id_col, text_col=text_col)


def _learned(docs: DataFrame, labels: DataFrame, sample: int, *cols: str) -> tuple[Evidence, DataFrame, DataFrame, float]:
    """(evidence, scored rows, sites, global log-odds)."""
    rows = _rows(docs, *cols)
    own = learn(rows, labels, sample)
    scored = common.materialize(rows.mapInArrow(_emit_evidence(own), "doc_id long, host string, path string, evidence double"), "evidence")
    sites, rate = site_rates(scored)
    sites = common.bounded_broadcast(common.materialize(sites.select("host", "path", "path_rate"), "sites"), SITES)
    return own, scored, sites, float(np.log(rate / (1 - rate)))


def _posterior(evidence, path_rate, global_odds: float):
    return 1 / (1 + F.exp(-(evidence + F.log(path_rate / (1 - path_rate)) - global_odds)))


#: ``documents`` has no URL: its source is taken as the host, and a source's part in one language as the path. Tables with URLs name the columns made by ``site_of``.
HOST, PATH = "source", "lang"


def classify(docs: DataFrame, labels: DataFrame, host_col: str = HOST, path_col: str = PATH, threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host, path, evidence (log-odds), path_rate, posterior, kept of each row."""
    _, scored, sites, odds = _learned(docs, labels, sample, host_col, path_col, id_col, text_col)
    out = scored.join(sites, ["host", "path"], "left").withColumn("posterior", _posterior(F.col("evidence"), F.col("path_rate"), odds))
    return out.select("doc_id", "host", "path", "evidence", "path_rate", "posterior", (F.col("posterior") >= threshold).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, host_col: str = HOST, path_col: str = PATH, threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns. Texts are scored again where they lie, as a join would move them."""
    own, _, sites, odds = _learned(docs, labels, sample, host_col, path_col, id_col, text_col)

    sites = sites.toDF("__host", "__path", "__rate")
    site = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (host_col, path_col)]
    scored = common.map_texts(docs, text_col, own.of, "__evidence", "double")
    found = scored.join(sites, (site[0] == sites["__host"]) & (site[1] == sites["__path"]), "left")
    return found.where(_posterior(F.col("__evidence"), F.col("__rate"), odds) >= threshold).select(*[scored[c] for c in docs.columns])
