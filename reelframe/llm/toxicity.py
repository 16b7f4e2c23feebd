"""Toxicity: class-conditional Kneser-Ney models of words, compared by length-normalised log-likelihood.

Each class (toxic, ordinary) has a word model of two orders over a spelling model:

* after the previous word, discounted counts of the class, with the discounts' mass on
* the class's continuation counts (how many different words a word was seen after), with the mass on
* the continuation counts of both classes together, with the mass on
* the word's spelling: its next byte given its whole beginning, from the class's counts of different words that begin
  so, with the mass on the discounted counts of both classes' words together.

The mass at a place is the same for both classes (that of the class which leaves more), so an expression that is rare in
either class rests on counts that both share and says nothing about the class, and a word that was never seen is judged
by how far its spelling is known. A document's statistic is the difference of the two log-likelihoods of its words divided by
(words + ADDED_LENGTH); a logistic curve over its signed root, fitted on labelled rows the counts have not seen, makes
it a score. Where a place's counts don't tell the classes apart (_significance), the backoff alone speaks.

Training rows are the labelled rows outside fold 0, at most MAX_TRAINING of them (the smallest hashes of doc_id); rows
of fold 1 fit the curve, the others are counted. Counts of pairs of words and of beginnings that the sample has but once
are not kept: both classes then use the estimate that backs them.

Defined results: a null or empty text has no words and scores as the curve says for no difference; null or missing
labels never train; a doc_id labelled twice counts as its largest label; repeated rows and null doc_ids are scored each
(a null hashes as empty text); a score that equals the threshold predicts 1; without training rows of both classes the
score is 0; other columns are ignored; an empty table gives an empty result. A very long text is one piece of its
own; temporaries take some 150 bytes per text byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import checkpointed, flat_bytes, fold, gather, pieces, with_text
from reelframe.llm.textstats import Words, mix, prefix_hashes, span_hashes

MAX_TRAINING = 6_000
DISCOUNT = 0.75
#: Classes whose rates of an expression differ by less than this factor are taken to agree in it; and the odds that they
#: differ, before its counts are seen.
FACTOR = 2.0
PRIOR = 1e-3
ADDED_LENGTH = 10
MIN_COUNT = 2
_END = np.uint64(0x8BB84B93962EACC9)
_START = np.uint64(0x2D358DCCAA6C78A5)
_TRIMMED = np.zeros(256, bool)
_TRIMMED[list(b".,!?;:*$%&#|\"'()")] = True


class Spelled:
    """The words of a batch, lower-cased (A-Z) and without trailing punctuation, as hashes, with their distinct forms.

    word: distinct form of each word. hashes, starts, size: of the distinct forms. pair: hash of each word's neighbours.
    """

    def __init__(self, column: pa.Array):
        self.words = Words(column)
        self.prefix = prefix_hashes(self.words.flat, True)
        ends = self.words.ends.copy()
        while len(ends) and (cut := (ends - self.words.starts > 1) & _TRIMMED[self.words.flat[ends - 1]]).any():
            ends = ends - cut
        self.hashes, first, self.word = np.unique(span_hashes(self.prefix, self.words.starts, ends), return_index=True, return_inverse=True)
        self.starts, self.size = self.words.starts[first], (ends - self.words.starts)[first]
        own = self.hashes[self.word]
        self.before = np.full(len(own), _START)
        self.before[1:] = own[:-1]
        heads = self.words.first[self.words.per_doc > 0]
        self.before[heads] = _START
        self.pair = pair_keys(self.before, own)
        self.earlier = np.full(len(own), _START)
        self.earlier[1:] = self.before[:-1]
        self.earlier[heads] = _START


def beginnings(prefix: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: the keys of its beginnings of 1 byte, 2 bytes, ..., the whole, and then its end; their word, their depth."""
    form = np.repeat(np.arange(len(size)), size + 1)
    depth = gather(np.ones(len(size), np.int64), size + 1)
    whole = depth > size[form]
    key = span_hashes(prefix, starts[form], starts[form] + np.minimum(depth, size[form]))
    return np.where(whole, mix(key ^ _END), key), form, depth


TRIPLES = "context long, word long, earlier int, toxic boolean"
FORMS = "word long, form binary"


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _columns(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for n, v in columns.items()})


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different (word before the first, pair of words, class) of each batch; of the first word 32 bits tell enough."""
    for batch in pieces(batches):
        own = Spelled(batch.column("text"))
        toxic = batch.column("label").to_numpy(zero_copy_only=False)[own.words.doc] == 1
        first = np.unique(mix(own.pair + mix(own.earlier) + toxic), return_index=True)[1]
        yield _columns(context=own.before[first], word=own.hashes[own.word[first]], earlier=(own.earlier[first] >> np.uint64(32)).astype(np.uint32).view(np.int32), toxic=toxic[first])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each batch."""
    for batch in pieces(batches):
        own = Spelled(batch.column("text"))
        data = own.words.flat.tobytes()
        forms = [data[i : i + n].lower() for i, n in zip(own.starts.tolist(), own.size.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(own.hashes.view(np.int64)), pa.array(forms, pa.binary())], ["word", "form"])


PACKED = "context binary, word binary, toxic binary, ordinary binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the triples of a task, which has all of a pair: each pair's different words before it, in one row of arrays."""
    held = [b for b in batches if b.num_rows]
    if held:
        mine = pa.Table.from_batches(held)
        context, word, earlier = (mine.column(n).to_numpy() for n in ("context", "word", "earlier"))
        toxic = mine.column("toxic").to_numpy(zero_copy_only=False)
        order = np.lexsort((toxic, earlier, word, context))
        context, word, earlier, toxic = (x[order] for x in (context, word, earlier, toxic))
        pair = np.ones(len(order), bool)
        pair[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
        new = pair.copy()
        new[1:] |= (earlier[1:] != earlier[:-1]) | (toxic[1:] != toxic[:-1])
        heads = np.flatnonzero(pair)
        sums = [np.add.reduceat((new & x).astype(np.int32), heads, dtype=np.int32) for x in (toxic, ~toxic)]
        yield pa.RecordBatch.from_pydict({n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("context", "word", "toxic", "ordinary"), (context[heads], word[heads], *sums), strict=True)})


def _summed(keys: dict[str, np.ndarray], by: str, sums: dict[str, np.ndarray]) -> pa.Table:
    """The keys of different values of keys[by], with the sums of their rows."""
    _, first, at = np.unique(keys[by], return_index=True, return_inverse=True)
    return pa.table({n: k[first].view(np.int64) for n, k in keys.items()} | {n: np.bincount(at, weights=x, minlength=len(first)).astype(np.int64) for n, x in sums.items()})


class Table:
    """Sorted keys with rows of values; unknown keys get the place -1."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [v[order] for v in values]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(wanted), -1)
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, place, -1)


def _significance(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Chance that the classes differ in an event by more than FACTOR: the binomial likelihood ratio against PRIOR."""
    ordinary, toxic = counts.astype(float)
    size = np.maximum(totals.astype(float), 1e-9)
    low, high = (size[1] * f / (size[1] * f + size[0]) for f in (1 / FACTOR, FACTOR))
    share = toxic / np.maximum(ordinary + toxic, 1e-9)
    near = np.clip(np.clip(share, low, high), 1e-9, 1 - 1e-9)
    gain = toxic * np.log(np.maximum(share, 1e-9) / near) + ordinary * np.log(np.maximum(1 - share, 1e-9) / (1 - near))
    return 1 / (1 + np.exp(np.clip(-np.log(PRIOR) - gain, -60, 60)))


class Contexts:
    """Per context the classes' totals, and the mass that both leave to the backoff.

    The mass is that of the class which leaves more, so an expression that neither model knows is as likely in both.
    """

    def __init__(self, total: np.ndarray, types: np.ndarray):
        """Rows of both classes; the last context stands for none."""
        self.total, self.kept = (np.pad(x, ((0, 0), (0, 1))).astype(np.float32) for x in (total, np.maximum(total - DISCOUNT * types, 0)))
        self.mass = np.where((self.total > 0).all(0), 1 - (self.kept / np.maximum(self.total, 1e-9)).min(0), 1.0)

    def estimate(self, slot: np.ndarray, counts: np.ndarray, backoff: np.ndarray) -> np.ndarray:
        """Both classes' estimates: discounted counts and the backoff's share; the backoff alone where the classes agree. slot -1: no context."""
        own = (1 - self.mass[slot]) * np.maximum(counts - DISCOUNT, 0) / np.maximum(self.kept[:, slot], 1e-9) + self.mass[slot] * backoff
        weight = np.where((slot >= 0) & (self.mass[slot] < 1), _significance(counts, self.total[:, slot]), 0)
        return weight * own + (1 - weight) * backoff


class ClassModels:
    """Both classes' models (rows 0: ordinary, 1: toxic of each table) and the logistic curve."""

    def __init__(self, pairs: pa.Table, contexts: pa.Table, words: pa.Table, nodes: pa.Table):
        """Tables of key, ordinary, toxic: pairs of words (context, word), words that stand before another (and of how many different ones:
        ordinary_types, toxic_types), words, and beginnings (context: the shorter one)."""
        keys = lambda t, name="key": t.column(name).to_numpy().view(np.uint64)
        both = lambda t, *names: np.stack([t.column(n).to_numpy().astype(np.float32) for n in names])
        self.pairs = Table(pair_keys(keys(pairs, "context"), keys(pairs, "word")), *both(pairs, "ordinary", "toxic"))
        # A context without a kept pair leaves all to the backoff, as an unknown one does.
        before = Table(keys(contexts), *both(contexts, "ordinary", "toxic", "ordinary_types", "toxic_types"))
        used = np.isin(before.keys, keys(pairs, "context"))
        self.before = Table(before.keys[used])
        total, types = (np.stack([x[used] for x in before.values[k : k + 2]]) for k in (0, 2))
        self.after = Contexts(total, types)
        company = both(words, "ordinary", "toxic")
        total = max(float(company.sum()), 1.0)
        self.rest = DISCOUNT * company.shape[1] / total
        self.words = Table(keys(words), *company, (np.maximum(company.sum(0) - DISCOUNT, 0) / total).astype(np.float32))
        self.any = Contexts(company.sum(1, keepdims=True), (company > 0).sum(1, keepdims=True))
        self.ready = bool((company.sum(1) > 0).all())
        self.curve = np.array([-np.inf, 0.0])
        self.nodes = Table(keys(nodes), keys(nodes, "context"), *both(nodes, "ordinary", "toxic"))
        above, counts = self.nodes.values[0], np.stack(self.nodes.values[1:]).astype(float)
        self.nodes.values = []
        root = above == 0
        parent = self.nodes.find(above)
        size = len(above) + 1
        slot = np.where(root, size - 1, parent)
        summed = lambda x: np.bincount(slot, weights=x, minlength=size)
        pooled = counts.sum(0)
        shared = (np.maximum(pooled - DISCOUNT, 0) + DISCOUNT * summed(pooled > 0)[slot] / 257) / np.maximum(summed(pooled)[slot], 1)
        following = Contexts(np.stack([summed(x) for x in counts]), np.stack([summed(x > 0) for x in counts]))
        logs, up = np.log(following.estimate(slot, counts, np.stack([shared, shared]))), np.where(root, -1, parent)
        while (up >= 0).any():  # log-likelihoods of beginnings, summed along the way by doubling
            more = up >= 0
            logs = logs + np.where(more, logs[:, up], 0)
            up = np.where(more, up[up], -1)
        self.spelled = logs.astype(np.float32)

    def spelling(self, own: Spelled) -> np.ndarray:
        """Log-likelihood of each form's spelling in both classes; what follows the longest known beginning is equal in both."""
        n = len(own.size)
        if not n or not len(self.nodes.keys):
            return np.zeros((2, n))
        key, _, depth = beginnings(own.prefix, own.starts, own.size)
        place = self.nodes.find(key)
        heads = np.cumsum(own.size + 1) - (own.size + 1)
        known = np.maximum.reduceat(np.where(place >= 0, depth, 0), heads)
        out = np.where(known > 0, self.spelled[:, place[heads + np.maximum(known - 1, 0)]], 0.0)
        return np.maximum(out - (own.size + 1 - known) * np.log(257), -600)

    def differences(self, own: Spelled) -> np.ndarray:
        """Of each word, its log-likelihood in the toxic model minus that in the ordinary one."""
        logs = self.spelling(own)
        take = lambda table, place, *of: np.stack([np.where(place >= 0, table.values[k][place] if len(table.keys) else 0, 0) for k in of])
        at = self.words.find(own.hashes)
        # A known word's shared estimate leans to the class whose words are spelled like it; an unknown one has its spelling alone.
        spelled = np.where(at >= 0, np.exp(logs - np.logaddexp(*logs)) * 2 * take(self.words, at, 2), self.rest * np.exp(logs))
        single = self.any.estimate(np.zeros(len(at), np.int64), take(self.words, at, 0, 1), spelled)
        pair = self.after.estimate(self.before.find(own.before), take(self.pairs, self.pairs.find(own.pair), 0, 1), single[:, own.word])
        return np.log(pair[1]) - np.log(pair[0])

    def statistics(self, column: pa.Array) -> np.ndarray:
        own = Spelled(column)
        n, doc = own.words.n, own.words.doc
        plain = np.bincount(doc, weights=self.differences(own), minlength=n) / (own.words.per_doc + ADDED_LENGTH)
        return np.column_stack([np.ones(n), np.sign(plain) * np.sqrt(np.abs(plain))])

    def fit_curve(self, x: np.ndarray, y: np.ndarray, rounds: int = 50) -> None:
        """Newton steps for a lightly ridged logistic regression on the difference."""
        if len(y) == 0 or y.min() == y.max():
            self.curve = np.array([0.0, 10.0])
            return
        scale = max(float(x[:, 1].std()), 1e-9)
        z, w = x / [1, scale], np.zeros(2)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            ridge = 1e-3 * np.array([0.0, 1.0])
            w = w - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge + 1e-6), z.T @ (p - y) + ridge * w)
        self.curve = w / [1, scale]

    def scores(self, column: pa.Array) -> np.ndarray:
        if np.isinf(self.curve[0]):
            return np.zeros(len(column))
        return 1 / (1 + np.exp(-np.clip(self.statistics(column) @ self.curve, -30, 30)))


def count(sample: DataFrame) -> tuple[pa.Table, pa.Table, pa.Table, pa.Table]:
    """The four tables of ClassModels from rows of label and text.

    A pair counts the different words before it, a word the different words before it, and a beginning what its words
    count, so copies of a text count once. The driver holds the sample's different pairs and words, 24 bytes each.
    """
    rows = sample.select("label", "text")
    packed = rows.mapInArrow(_triples, TRIPLES).repartition("context", "word").mapInArrow(_packed, PACKED).toArrow()
    context, word, toxic, ordinary = (np.concatenate([np.empty(0, t), *(np.frombuffer(x, t) for x in packed.column(n).to_pylist())]) for n, t in (("context", np.uint64), ("word", np.uint64), ("toxic", np.int32), ("ordinary", np.int32)))
    types = {"toxic_types": toxic > 0, "ordinary_types": ordinary > 0}
    contexts = _summed({"key": context}, "key", {"toxic": toxic, "ordinary": ordinary} | types)
    words = _summed({"key": word}, "key", {"toxic": toxic > 0, "ordinary": ordinary > 0})
    several = toxic + ordinary >= MIN_COUNT
    pairs = pa.table({"context": context[several].view(np.int64), "word": word[several].view(np.int64), "toxic": toxic[several], "ordinary": ordinary[several]})
    forms = rows.mapInArrow(_forms, FORMS).groupBy("word").agg(F.min("form").alias("form")).toArrow().combine_chunks().sort_by("word")
    own = words.take(pa.compute.index_in(forms.column("word"), words.column("key").combine_chunks()))
    flat, offsets = flat_bytes(forms.column("form").combine_chunks())
    key, form, depth = beginnings(prefix_hashes(flat), offsets[:-1], np.diff(offsets))
    above = np.where(depth > 1, np.roll(key, 1), np.uint64(0))
    nodes = _summed({"key": key, "context": above}, "key", {n: own.column(n).to_numpy()[form] for n in ("toxic", "ordinary")})
    return pairs, contexts, words, nodes.filter(pa.compute.greater_equal(pa.compute.add(nodes.column("toxic"), nodes.column("ordinary")), MIN_COUNT))


def fit(documents: DataFrame, labels: DataFrame, bound: int = MAX_TRAINING) -> ClassModels:
    """Learn from at most bound rows; the tables that reach the driver grow with these alone."""
    given = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    # At most bound rows of two numbers: small enough to broadcast at any size of the tables.
    sample = checkpointed(with_text(documents).join(F.broadcast(given), "doc_id"))
    model = ClassModels(*count(sample.filter(fold(F.col("doc_id")) != 1)))
    if not model.ready:
        return model
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = shared.value.statistics(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"label": batch.column("label").to_pylist(), "x": x.tolist()})

    seen = sample.filter(fold(F.col("doc_id")) == 1).select("label", "text").mapInArrow(measure, "label long, x array<double>").toArrow()
    shared.destroy()
    model.fit_curve(np.array(seen.column("x").to_pylist(), float).reshape(-1, 2), np.array(seen.column("label").to_pylist(), float))
    return model


def scored(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = MAX_TRAINING) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by models learned from the labelled rows."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, bound))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.scores(batch.column("text")))], ["doc_id", "score"])

    out = with_text(documents).mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
