"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class gets a mean and a covariance shrunk towards the pooled covariance and its diagonal; the score is the
posterior of class 1 from the difference of the Gaussian log-densities, whose Mahalanobis terms use Cholesky factors
and their inverses, computed once. The sufficient statistics (counts, sums, cross products) are sums over all labelled training rows, so
no sample is needed and what reaches the driver has a fixed size.

Defined results: a null or empty text has all-zero counts and is scored like any other; null or missing labels never
train; labels repeated for a doc_id count as their largest value; repeated rows are scored each; without training
rows of both classes every score is the prior 0.5; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import checkpointed, fold, only, pieces, release, with_text
from reelframe.llm.textstats import Words, salted

THRESHOLD = 0.3
#: Weight of the pooled covariance in each class covariance, and of the pooled diagonal in that.
POOLED, DIAGONAL = 0.15, 0.05
NAMES = ("log_words", "log_bytes", "word_length", "upper", "digit", "symbol", "mark", "bang", "bar", "wide", "line", "blank", "adjacent", "distinct", "long_word", "capitalised", "all_caps", "marked_word")
_KINDS = np.zeros(256, np.uint8)
for _code, _kind in [*((x, 1) for x in range(65, 91)), *((x, 2) for x in range(97, 123)), *((x, 3) for x in range(48, 58)), *((x, 4) for x in b"#*$%&<>@~^_={}[]\\"), *((x, 5) for x in b".,;:'\"-?()/"), (33, 6), (124, 7), *((x, 8) for x in range(128, 256)), (10, 9), (32, 10)]:
    _KINDS[_code] = _kind


def features(column: pa.Array) -> np.ndarray:
    """A row of transformed statistics per text; every ratio is smoothed and log-scaled, so that tails stay tame."""
    words = Words(column)
    n = words.n
    doc_of_byte = np.repeat(np.arange(n), np.diff(words.offsets))
    kinds = _KINDS[words.flat]
    by_kind = np.bincount(doc_of_byte * 11 + kinds, minlength=n * 11).reshape(n, 11).astype(float)
    size, count = np.diff(words.offsets).astype(float), words.per_doc.astype(float)
    hashes = words.hashes(True)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    adjacent = np.bincount(words.doc[same], minlength=n)
    distinct = np.bincount(words.doc[np.unique(salted(hashes, words.doc), return_index=True)[1]], minlength=n)
    span = words.ends - words.starts
    first, last = _KINDS[words.flat[words.starts]], _KINDS[words.flat[words.ends - 1]]
    upper = np.concatenate([[0], np.cumsum(kinds == 1)])
    small = np.concatenate([[0], np.cumsum(kinds == 2)])
    caps = (upper[words.ends] - upper[words.starts] > 1) & (small[words.ends] == small[words.starts])
    per = lambda mask: np.bincount(words.doc[mask], minlength=n) / np.maximum(count, 1)
    share = lambda k: by_kind[:, k] / np.maximum(size, 1)
    squash = lambda x: np.log(x + 0.01)
    columns = [
        np.log1p(count), np.log1p(size), np.log1p(size / np.maximum(count, 1)), squash(share(1)), squash(share(3)), squash(share(4)), squash(share(5)), squash(share(6)), squash(share(7)), squash(share(8)), squash(share(9)), squash(share(10)),
        squash(adjacent / np.maximum(count, 1)), squash(distinct / np.maximum(count, 1) ** 0.85), squash(per(span > 14)), squash(per(first == 1)), squash(per(caps)), squash(per(np.isin(last, (4, 6, 7)))),
    ]
    return np.column_stack(columns) if n else np.empty((0, len(NAMES)))


SCHEMA = "row long, doc_id long, features array<double>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        x = features(batch.column("text"))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), values], ["row", "doc_id", "features"])


def featured(documents: DataFrame) -> DataFrame:
    """row, doc_id and features of every document, in shared storage."""
    return checkpointed(with_text(documents.withColumn("row", F.monotonically_increasing_id()), "row").mapInArrow(_rows, SCHEMA))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = np.array(batch.column("features").flatten()).reshape(-1, d)
        y = batch.column("label").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            own = x[y == k]
            total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    yield pa.RecordBatch.from_pydict({"moments": [total.ravel().tolist()]})
    release()


class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances, their log-determinants, and log-priors."""

    def __init__(self, moments: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL):
        d = len(NAMES)
        moments = moments.reshape(2, -1)
        self.counts = moments[:, 0]
        self.ready = bool((self.counts >= 2).all())
        if not self.ready:
            return
        self.means = moments[:, 1 : 1 + d] / self.counts[:, None]
        scatter = moments[:, 1 + d :].reshape(2, d, d) - self.counts[:, None, None] * self.means[:, :, None] * self.means[:, None, :]
        common = scatter.sum(0) / self.counts.sum() + 1e-3 * np.eye(d)
        common = (1 - diagonal) * common + diagonal * np.diag(np.diag(common))
        self.factors, self.inverses, self.logdets = [], [], []
        for k in (0, 1):
            weight = max(pooled, d / (d + self.counts[k]))
            covariance = (1 - weight) * scatter[k] / self.counts[k] + weight * common
            self.factors.append(np.linalg.cholesky(covariance))
            self.inverses.append(np.linalg.solve(self.factors[-1], np.eye(d)))
            self.logdets.append(2 * np.log(np.diag(self.factors[-1])).sum())
        self.priors = np.log(self.counts / self.counts.sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1."""
        if not self.ready:
            return np.full(len(x), 0.5)
        densities = []
        for k in (0, 1):
            z = self.inverses[k] @ (x - self.means[k]).T
            densities.append(self.priors[k] - 0.5 * (self.logdets[k] + (z * z).sum(0)))
        return 1 / (1 + np.exp(np.clip(densities[0] - densities[1], -700, 700)))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from the labelled rows outside fold 0; only two fixed-size moment vectors per task reach the driver."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = stats.filter(fold(F.col("doc_id")) != 0).join(given, "doc_id").select("features", "label")
    parts = rows.mapInArrow(_moments, "moments array<double>")
    size = 2 * (1 + len(NAMES) + len(NAMES) ** 2)
    summed = parts.select(F.posexplode("moments")).groupBy("pos").agg(F.sum("col").alias("total")).collect()
    moments = np.zeros(size)
    for x in summed:
        moments[x["pos"]] = x["total"]
    return Discriminant(moments)


def scored(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per input row: row, doc_id, held_out, score, predicted."""
    stats = featured(documents)
    model = documents.sparkSession.sparkContext.broadcast(fit(stats, labels))  # a few kilobytes at any size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("features").flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(model.value.scores(x))], ["row", "doc_id", "score"])
        release()

    out = stats.mapInArrow(score, "row long, doc_id long, score double")
    return out.select("row", "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    return only(documents, scored(documents, labels, threshold).filter("predicted = 1"))
