"""Each operator against a brute-force version or an exact round trip, with nulls, empties, ties, repeats and odd columns."""

import collections
import functools
import hashlib
import math
import random
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelframe.llm import components, context_tree, license_scan, ngram_join, packing, piece_bpe, quality_classifier, quality_rules, registry, suffix_dedup, toxicity, transport_stream

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, spans string"


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


def corpus():
    """Prose, copies, near copies, shared passages, periodic text, empties, nulls, repeated rows and odd characters."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice(["th", "er", "on", "an", "é", "in", "st", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).capitalize() + ".\nAll rights reserved."
    base, passage = prose(120), prose(70)
    texts = [prose(r.randint(1, 200)) for _ in range(40)] + [base] * 4
    for k in range(12):
        words = base.split(" ")
        words[10 * k % len(words)] = f"new{k}"
        texts.append(" ".join(words))
    texts += [prose(60) + "\n" + passage + "\n" + prose(40) for _ in range(6)]
    texts += [None, "", " \n\t ", "one two", "One TWO", "word " * 300, "ab" * 300, "x" * 199, "x" * 200, "y" * 450, "日本語 " * 80, "Released under the MIT License.\nApache License mit license", "İK Licence general PUBLIC license", "\x00\x01 a b", "<|endoftext|> it's 12,5"]
    rows = [(k, t, "en", f"src{k % 3}" if k % 7 else None, 0, 5, "z") for k, t in enumerate(texts)]
    return rows + [rows[0], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def labels(spark, rows):
    return spark.createDataFrame([(i, k % 2, int(i % 4 == 0)) for k, (i, _) in enumerate(rows) if i is not None] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_suffix_dedup_equals_brute_force(docs, rows, none):
    texts = [t.encode() for _, t in rows]
    counts = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    expected = []
    for (doc, _), t in zip(rows, texts, strict=True):
        covered = bytearray(len(t))
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                covered[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        expected.append((doc, len(t), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.digests(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert suffix_dedup.digests(none).count() == 0


def test_suffix_dedup_cleans_with_all_columns(docs):
    out = suffix_dedup.cleaned(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("row = 5 AND spans = 'z'").count() == docs.filter("row = 5").count()


def test_suffix_sort_is_the_lexicographic_order():
    r = random.Random(3)
    flat = np.frombuffer(bytes(r.choice(b"ab") for _ in range(900)) * 2, np.uint8)
    own = suffix_dedup.Suffixes(flat, 64)
    places = np.arange(len(flat) - 64)
    order, group = own.sort(places)
    data = flat.tobytes()
    for k in range(1, len(order)):
        if group[k] == group[k - 1]:
            assert data[order[k - 1] : order[k - 1] + 64] <= data[order[k] : order[k] + 64]
    classes = own.classes(places)
    by_text = collections.defaultdict(set)
    for p in places:
        by_text[data[p : p + 64]].add(classes[p])
    assert all(len(x) == 1 for x in by_text.values()) and len(set(classes)) == len(by_text)


def test_ngram_join_equals_brute_force(docs, rows, none):
    sets = []
    for _, t in rows:
        w = WORD.findall(t.translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    expected = [(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]
    got = [tuple(r) for r in ngram_join.grouped_documents(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert ngram_join.grouped_documents(none).count() == 0
    groups = len({find(i) for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)
    assert ngram_join.representatives(docs).count() == groups


def test_ngram_join_finds_every_link(spark, docs, rows, monkeypatch):
    r = random.Random(3)
    base = [f"b{k}" for k in range(150)]
    more = []
    for k in range(40):  # a group of near copies, where some pairs link and some don't
        words = list(base)
        for j in r.sample(range(150), 1 + k % 4):
            words[j] = f"n{k}x{j}"
        more.append((1000 + k, " ".join(words)))
    more += more[:3]
    frame = docs.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    sets = []
    for doc, t in rows + more:
        w = WORD.findall(t.translate(LOWER))
        sets.append((doc, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])))
    linked = lambda x, y: bool(x) and 100 * len(x & y) >= 80 * len(x | y)
    want = [(doc, sum(linked(x, y) for _, y in sets) - bool(x)) for doc, x in sets]
    assert len({n for _, n in want}) > 5
    assert sorted(map(tuple, ngram_join.grouped_documents(frame).select("doc_id", "n_links").collect()), key=str) == sorted(want, key=str)
    distinct = list({x for _, x in sets})
    pairs = sum(linked(x, y) for i, x in enumerate(distinct) for y in distinct[:i])
    found = ngram_join.linked_classes(ngram_join.shingled(frame)).collect()
    assert len(found) == len({(x.a, x.b) for x in found}) == pairs and all(x.a < x.b for x in found)
    for sets_, shingles in ((7, 1 << 20), (1024, 500)):  # many tiles, by number and by weight, give the same links
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", sets_)
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", shingles)
        assert sorted(map(tuple, ngram_join.grouped_documents(frame).select("doc_id", "n_links").collect()), key=str) == sorted(want, key=str)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_piece_bpe_equals_the_library(docs, rows, none):
    sentencepiece = pytest.importorskip("sentencepiece")
    name = path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=name), piece_bpe.model(name)
    r = random.Random(5)
    odd = ["", "▁", "  ▁", "=" * 1000, "ab" * 900, "a" * 777, "thethethe" * 80] + ["".join(r.choice("abc the  ▁\n\t.é!!=-日本語😀ɐ́\x00xxaa") for _ in range(r.choice([1, 5, 20, 600]))) for _ in range(500)]
    ids = own.encode(odd)
    expected = library.encode(odd, add_bos=True, add_eos=True)
    assert [x.tolist() for x in ids] == expected
    assert [own.decode(x) for x in ids] == [library.decode(x) for x in expected]
    broken = [[r.choice([r.randint(0, 300), r.randint(0, 31999), 13]) for _ in range(r.randint(1, 12))] for _ in range(500)]
    assert [own.decode(x) for x in broken] == [library.decode(x) for x in broken]
    want = []
    for doc, t in rows:
        e = library.encode(t, add_bos=True, add_eos=True)
        want.append((doc, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(e).encode()).hexdigest()))
    assert sorted(map(tuple, piece_bpe.digests(docs, name).collect()), key=str) == sorted(want, key=str)
    assert piece_bpe.digests(none, name).count() == 0


def test_quality_rules_counts(docs, rows, none):
    expected = []
    for doc, t in rows:
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        held = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(held) > 50 * len(w)
        expected.append((doc, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(held), failed))
    got = quality_rules.assess(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == sorted(expected, key=str)
    assert got.filter("kept AND base_failed").count() == 0
    assert quality_rules.assess(none).count() == 0


def test_frequent_lines_are_counted_per_host_and_copies_once(spark):
    body = lambda k: "\n".join(f"line {k} {j} of its own words here" for j in range(12))
    furniture = "\n".join("home about contact terms and privacy" for _ in range(1))
    rows = [(k, f"{furniture}\n{body(k)}", "h") for k in range(30)] + [(100 + k, body(999), "h") for k in range(30)]
    rows += [(200 + k, f"{furniture}\nshort tail {k}", "h") for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stats = quality_rules.document_lines(frame)
    assert quality_rules.frequent_lines(stats).count() == 1  # copies of one text don't make its lines frequent
    removed = {r.doc_id: r.removed_words for r in quality_rules.assess(frame).collect()}
    assert removed[0] == 6 and removed[100] == 0 and removed[200] == 6


def test_frequent_lines_count_distinct_documents_by_brute_force(spark):
    shared = [f"menu entry number {j} of the site" for j in range(10)]
    rows = [(k, "\n".join([*shared, f"only page {k} says this"]), "a") for k in range(100)]
    rows += [(200 + k, "\n".join(shared[j] for j in range(10) if k >> j & 1), "b") for k in range(1, 60)]
    rows += [(300 + k, "\n".join(f"page {k % 40} line {j}" for j in range(3)) + ("\nrare footer" if k % 40 < 3 else ""), "c") for k in range(400)]
    want = set()
    for host in "abc":
        sets = {frozenset(t.split("\n")) for _, t, h in rows if h == host}
        counts = collections.Counter(x for s in sets for x in s)
        want |= {(host, x) for x, n in counts.items() if n >= max(3, 0.05 * len(sets))}
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stats = quality_rules.document_lines(frame)
    got = quality_rules.frequent_lines(stats, 3, 0.05).groupBy("host").count().collect()
    assert {r["host"]: r["count"] for r in got} == dict(collections.Counter(h for h, _ in want))
    removed = {r.doc_id: r.removed_words for r in quality_rules.assess(frame, 3, 0.05).collect()}
    assert removed == {k: sum(len(x.split(" ")) for x in set(t.split("\n")) if (h, x) in want) for k, t, h in rows}


def test_accepted_documents_lose_their_frequent_lines(spark):
    menu = ["Home  About us", "über uns und mehr"]
    body = lambda k: [" ".join(f"é{k}w{11 * j + i}" for i in range(11)) for j in range(6)]
    rows = [(k, "\n".join([menu[0], "", *body(k)[:3], menu[1], *body(k)[3:], *[menu[0].upper()] * (k % 2)]), "h") for k in range(30)]
    rows += [(100 + k, "\n".join([*menu * 25, f"tail {k} of it"]), "h") for k in range(5)] + [(200, "\n".join([*body(200), ""]), "h"), (201, None, "h"), (202, menu[0], None)]
    frame = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, source string, n_chars long, more string")
    got = quality_rules.accepted(frame)
    assert got.columns == frame.columns
    gone = {" ".join(x.translate(LOWER).split()) for x in menu}
    want = {k: "\n".join(x for x in t.split("\n") if " ".join(x.translate(LOWER).split()) not in gone) for k, t, _ in rows if k < 100 or k == 200}
    kept = {r.doc_id: r for r in got.collect()}
    assert {k: r.text for k, r in kept.items()} == want
    assert all(r.n_chars == len(r.text) and r.more == "z" and r.source == "h" for r in kept.values())
    assert quality_rules.accepted(frame.limit(0)).count() == 0


def test_toxicity_scores(spark, docs, rows, none):
    out = toxicity.scored(docs, labels(spark, rows)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in out)
    assert toxicity.scored(none, labels(spark, rows)).count() == 0
    assert {r.score for r in toxicity.scored(docs, labels(spark, [])).collect()} == {0.0}


def test_toxicity_held_out_accuracy(spark):
    r = random.Random(1)
    words, bad = [f"w{r.randint(0, 3000)}x" for _ in range(3000)], ["slurone", "slurtwo"]
    rows = []
    for k in range(1500):
        toxic = int(k % 10 == 0)
        text = [r.choice(words) for _ in range(60)]
        if toxic:
            text[r.randrange(60)] = text[r.randrange(60)] = r.choice(bad) + r.choice(["", "s", "ish"])
        rows.append((k, " ".join(text), toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.scored(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")).filter("held_out").join(frame, "doc_id").collect()
    assert sum(x.predicted == x.toxic for x in got) / len(got) > 0.97


def test_toxicity_reads_words_to_their_end_and_their_neighbours(spark):
    r = random.Random(4)
    words = [f"wort{r.randint(0, 900)}" for _ in range(900)]
    rows = []
    for k in range(1500):
        toxic, text = int(k % 5 == 0), [r.choice(words) for _ in range(30)]
        for _ in range(4):  # the same long beginning, and the same two words, in both classes
            at = r.randrange(29)
            text[at : at + 2] = ["unbeschreiblichervorgang" + "ab"[toxic], "und"] if k % 2 else ["links", "rechts"] if toxic else ["rechts", "links"]
        rows.append((k, " ".join(text), toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.scored(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")).filter("held_out").join(frame, "doc_id").collect()
    for part in (0, 1):
        own = [x for x in got if x.doc_id % 2 == part]
        assert sum(x.predicted == x.toxic for x in own) / len(own) > 0.95


def test_toxicity_counts_and_estimates_by_brute_force(spark):
    """Continuation counts of a small sample, and estimates that sum to one over what may follow."""
    texts = [("a bad cat sat", 1), ("a bad cat sat", 1), ("the bad cat ran", 1), ("a good cat sat", 0), ("the good dog sat", 0), ("", 0)]
    frame = spark.createDataFrame([(t, y) for t, y in texts], "text string, label int")
    pairs, contexts, words, nodes = ([types.SimpleNamespace(**r) for r in t.to_pylist()] for t in toxicity.count(frame))
    triples = {(y, *x) for t, y in texts for w in [["^", "^", *t.split()]] for x in zip(w, w[1:], w[2:]) if t}
    company = collections.Counter((y, w) for y, _, v, w in {(y, 0, v, w) for y, _, v, w in triples})
    assert sorted(r.toxic for r in words) == sorted(company[1, w] for w in {w for _, w in company})
    assert sorted(r.ordinary for r in words) == sorted(company[0, w] for w in {w for _, w in company})
    after = collections.Counter((y, v) for y, _, v, _ in triples)
    assert sorted((r.toxic, r.ordinary) for r in contexts) == sorted((after[1, v], after[0, v]) for v in {v for _, v in after})
    begin = collections.Counter((y, w[:k] + ("$" if k > len(w) else "")) for (y, w), n in company.items() for k in range(1, len(w) + 2) for _ in range(n))
    several = {b for _, b in begin if begin[0, b] + begin[1, b] > 1}
    assert sorted((r.toxic, r.ordinary) for r in nodes) == sorted((begin[1, b], begin[0, b]) for b in several)
    own = toxicity.Contexts(np.array([[7.0], [5.0]]), np.array([[2.0], [2.0]]))
    counts, backoff = np.array([[4.0, 3.0, 0.0], [1.0, 4.0, 0.0]]), np.array([[0.5, 0.3, 0.2]] * 2)
    assert np.allclose(own.mass[0] * backoff.sum(1) + (1 - own.mass[0]) * (np.maximum(counts - 0.75, 0) / own.kept[:, :1]).sum(1), 1)


def test_quality_classifier(spark, docs, rows, none):
    out = quality_classifier.scored(docs, labels(spark, rows)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert quality_classifier.scored(none, labels(spark, rows)).count() == 0
    assert {r.score for r in quality_classifier.scored(docs, labels(spark, [])).collect()} == {0.5}
    assert quality_classifier.accepted(docs, labels(spark, [])).columns == docs.columns


def test_quality_classifier_equals_dense_densities():
    r = np.random.default_rng(1)
    d = len(quality_classifier.NAMES)
    x = [r.normal(k, 1 + k, (300, d)) for k in (0, 1)]
    model = quality_classifier.Discriminant(np.concatenate([np.concatenate([[len(o)], o.sum(0), (o.T @ o).ravel()]) for o in x]))
    point = r.normal(0, 1, d)
    logs = []
    for k in (0, 1):
        covariance = model.factors[k] @ model.factors[k].T
        z = point - model.means[k]
        logs.append(model.priors[k] - 0.5 * (np.linalg.slogdet(covariance)[1] + z @ np.linalg.solve(covariance, z)))
    assert model.scores(point[None])[0] == pytest.approx(1 / (1 + math.exp(logs[0] - logs[1])))


def test_context_tree_base_and_normalisation(docs, rows, none):
    counts, tokens = collections.Counter(), []
    for doc, t in rows:
        w = [*WORD.findall(t.translate(LOWER)), None]
        tokens.append(w)
        if zlib.crc32(str("" if doc is None else doc).encode()) % 5 != 1:
            counts.update(w)
    total, distinct = sum(counts.values()), len(counts)
    expected = sorted((str(doc), len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), 6)) for (doc, _), w in zip(rows, tokens, strict=True))
    got = context_tree.scored(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
    assert {r.train_tokens for r in got} == {total} and all(r.score < 0 for r in got)
    assert context_tree.scored(none).count() == 0


def pairs_of(texts):
    """Training counts of contexts and symbols, with every symbol after every context that occurs."""
    keys = context_tree.keys_of(*context_tree.flat_bytes(pa.array(texts)))[0]
    every = (np.unique(keys >> np.uint64(8))[:, None] << np.uint64(8) | np.arange(256, dtype=np.uint64)).ravel()
    found, n = np.unique(keys, return_counts=True)
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, found)] = n
    return keys, every, counts


def test_context_tree_weights_equal_a_recursion():
    """The mixture over all depths against the recursive definition, on a small text."""
    keys, every, counts = pairs_of(["abracadabra abracadabra"])
    none = np.empty(0, np.int64)
    got = dict(zip(every.tolist(), context_tree.Divided(none, none).log_chances(every, counts), strict=True))
    text = b"abracadabra abracadabra\0"
    places = [(bytes(6) + text)[i : i + 6] for i in range(len(text))]

    @functools.cache
    def node(before, prefix, bits):
        own = [s for c, s in zip(places, text, strict=True) if c.endswith(before) and s >> 8 - bits == prefix]
        ones = sum(s >> 7 - bits & 1 for s in own)
        block = math.lgamma(len(own) - ones + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(len(own) + 1) - 2 * math.lgamma(0.5)
        if len(before) == 6:
            return block, block, (ones + 0.5) / (len(own) + 1)
        longer = {c[5 - len(before) :] for c in places if c.endswith(before)}
        return block, math.log(0.5) + np.logaddexp(block, sum(node(c, prefix, bits)[1] for c in longer)), (ones + 0.5) / (len(own) + 1)

    for key in [*set(keys.tolist()), int(keys[5]) ^ 1, int(keys[9]) ^ 64]:
        before, symbol = (key >> 8).to_bytes(6, "little"), key & 255
        expected = 0.0
        for bits in range(8):
            p = None
            for depth in range(6, -1, -1):
                block, weighted, chance = node(before[6 - depth :], symbol >> 8 - bits, bits)
                p = chance if p is None else (w := math.exp(block + math.log(0.5) - weighted)) * chance + (1 - w) * p
            expected += math.log10(p if symbol >> 7 - bits & 1 else 1 - p)
        assert got[key] == pytest.approx(expected, rel=1e-9)


def test_context_tree_divided(docs, rows, monkeypatch):
    """Divided contexts: chances sum to one, groups stay small, and the exchange gives each text its chances."""
    table = docs.select("doc_id", "text").withColumn("learned", context_tree.fold(docs.doc_id) != 1)
    for name, value in (("LEAST", 1), ("SHARES", 50)):
        monkeypatch.setattr(context_tree, name, value)
    divided = context_tree.fit(table)
    assert len(divided.contexts[0]) == 1 and len(divided.contexts[1]) > 5 and len(divided.contexts[2]) > 1
    training = [t for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 5 != 1]
    _, every, counts = pairs_of(training)
    assert np.allclose((10.0 ** divided.log_chances(every, counts)).reshape(-1, 256).sum(1), 1, atol=1e-5)
    everything = context_tree.keys_of(*context_tree.flat_bytes(pa.array([t for _, t in rows])))[0]
    rising = np.sort(everything)
    home = divided.home(rising)
    groups = collections.Counter(zip(home.tolist(), (rising >> (8 * (7 - home)).astype(np.uint64)).tolist(), strict=True))
    assert max(n for (d, _), n in groups.items() if d < context_tree.DEPTH) <= len(everything) / 50
    learned = np.concatenate([np.full(len(t.encode()) + 1, zlib.crc32(str("" if d is None else d).encode()) % 5 != 1) for d, t in rows])
    keys, n = context_tree.counted(everything, learned)
    chance = divided.log_chances(keys, n)
    expected = [(str(d), chance[np.searchsorted(keys, context_tree.keys_of(*context_tree.flat_bytes(pa.array([t])))[0])].sum()) for d, t in rows]
    got = sorted((str(r.doc_id), r.score) for r in context_tree.scored(docs).collect())
    assert [d for d, _ in got] == [d for d, _ in sorted(expected)]
    assert np.allclose([s for _, s in got], [s for _, s in sorted(expected)], rtol=1e-3)


def test_context_tree_divided_or_not(docs, rows, monkeypatch):
    """The same chances and scores whether and wherever contexts are divided."""
    table = docs.select("doc_id", "text").withColumn("learned", context_tree.fold(docs.doc_id) != 1)
    learned = np.concatenate([np.full(len(t.encode()) + 1, zlib.crc32(str("" if d is None else d).encode()) % 5 != 1) for d, t in rows])
    keys, n = context_tree.counted(context_tree.keys_of(*context_tree.flat_bytes(pa.array([t for _, t in rows])))[0], learned)
    whole = context_tree.fit(table)
    assert not whole.any()
    scores = sorted((str(r.doc_id), r.score) for r in context_tree.scored(docs).collect())
    for least, shares in ((1, 50), (1, 400)):
        for name, value in (("LEAST", least), ("SHARES", shares)):
            monkeypatch.setattr(context_tree, name, value)
        divided = context_tree.fit(table)
        assert len(divided.contexts[2]) > 1
        assert np.allclose(divided.log_chances(keys, n), whole.log_chances(keys, n), rtol=1e-9, atol=1e-9)
    assert sorted((str(r.doc_id), r.score) for r in context_tree.scored(docs).collect()) == scores


def test_context_tree_learns_beyond_letters(spark):
    """What only long contexts tell lowers the score of words that the text breaks off."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    texts = [(k, " ".join(r.choice(words) for _ in range(60)), "", "", 0, 0, "") for k in range(200)]
    texts.append((1000, " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60)), "", "", 0, 0, ""))
    got = {x.doc_id: x for x in context_tree.scored(spark.createDataFrame(texts, SCHEMA)).collect()}
    held = [x.score for x in got.values() if x.held_out and x.doc_id < 1000]
    assert np.mean(held) > 0.5 * got[1000].score


def test_packing(docs, rows, none):
    tokenizers = pytest.importorskip("tokenizers")
    name = path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(name)
    ids = [[*library.encode(t, add_special_tokens=False).ids, 0] for _, t in rows]
    got = packing.packed(docs, name, capacity=256).collect()
    want = [(str(doc), k // 256, k, len(x[k : k + 256]), zlib.crc32(np.array(x[k : k + 256], "<u4").tobytes())) for (doc, _), x in zip(rows, ids, strict=True) for k in range(0, len(x), 256)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1]) and sum(n for _, n in own) <= 256
    assert len(bins) <= math.ceil(sum(map(len, ids)) / 256) + 2
    assert packing.packed(none, name).count() == 0


@pytest.mark.parametrize("sizes", [[], [5], [2048] * 3, [1000, 1000, 48, 47, 1], [1, 2, 3] * 500, list(range(1, 2049, 7))])
def test_best_two_fit(sizes):
    bins = packing.best_two_fit(sizes)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= math.ceil(sum(sizes) / 2048) * 1.1 + 1


def test_license_scan_base(docs, rows, none):
    phrases = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    expected = []
    for doc, t in rows:
        w, places, found = words.findall(t.translate(LOWER)), [], set()
        for phrase, label in phrases:
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            found |= {label} if at else set()
        expected.append((doc, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))))
    got = license_scan.scanned(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(expected, key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert license_scan.scanned(none).count() == 0


def test_license_scan_templates(spark):
    near = license_scan.TEMPLATES[6][1].replace("modification", "alteration")
    rows = [(0, f"Foo bar. {near.upper()}!"), (1, "redistribution of source"), (2, "Licensed under CC BY-NC 4.0."), (3, "binary forms source and in use and redistribution")]
    got = {r.doc_id: r.labels for r in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "bsd", 1: "", 2: "cc-by-nc", 3: ""}


def test_transport_stream_round_trips(docs, rows, none):
    got = {}
    for r in transport_stream.digests(docs).collect():
        got.setdefault(str(r.doc_id), []).append(r)
    for doc, t in rows:
        p = transport_stream.padded(t)
        assert any((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for r in got[str(doc)])
    assert transport_stream.digests(none).count() == 0
    units = transport_stream.stored(docs).select(F.explode("units").alias("u")).select("u.*")
    assert units.filter("pts IS NULL").count() == 0 and units.filter("pts = 0 AND random_access").count() == len(rows)


def test_transport_stream_tables_span_packets():
    """A program map of 120 streams takes several packets; the last stream is found only when they are put together."""
    t = transport_stream
    pat = t._section(t.PAT_ID, 1, (7).to_bytes(2, "big") + (0xE000 | 0x100).to_bytes(2, "big"))
    pids = [0x200 + k for k in range(120)]
    body = (0xE000 | pids[0]).to_bytes(2, "big") + b"\xf0\x00" + b"".join(bytes([6]) + (0xE000 | p).to_bytes(2, "big") + b"\xf0\x03\x05\x01\x00" for p in pids)
    pmt = b"\x00" + t._section(t.PMT_ID, 7, body)
    parts = [pmt[i : i + t.ROOM].ljust(t.ROOM, b"\xff") for i in range(0, len(pmt), t.ROOM)]
    media = t._packet(0, 0, True, (b"\x00" + pat).ljust(t.ROOM, b"\xff")) + b"".join(t._packet(0x100, k, k == 0, x) for k, x in enumerate(parts))
    got = t.read_stream(media)
    assert len(parts) > 3 and got["programs"] == {7: {p: 6 for p in pids}} and got["errors"] == 0


def test_transport_stream_survives_damage():
    media = transport_stream.write_stream(bytes(range(256)) * 60)
    assert transport_stream.read_stream(media)["errors"] == 0
    assert transport_stream.read_stream(media[: 188 * 9] + media[188 * 10 :])["errors"] >= 1
    r = random.Random(2)
    for _ in range(200):
        bad = bytearray(media)
        for _ in range(9):
            bad[r.randrange(len(bad))] = r.getrandbits(8)
        transport_stream.read_stream(bytes(bad[: r.randrange(len(bad))]))
    for n in range(1, 400):
        assert transport_stream.described(transport_stream.write_stream(b"x" * n))[0] == b"x" * n


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op3_ngram_join", "op5_quality_rules"])
def test_operators_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    result = connection.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    got = registry.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(repr, (r[c] for c in columns))) for r in got.collect()) == sorted(tuple(map(repr, r)) for r in result.fetchall())


def test_packing_refuses_to_split_for_another_vocabulary(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    import json

    settings = json.load(open(path("word_bpe_49k.json"), encoding="utf-8"))
    assert packing.splits_at_blanks(settings)
    settings["normalizer"]["normalizers"].pop()
    name = str(tmp_path / "cased.json")
    json.dump(settings, open(name, "w", encoding="utf-8"))
    texts = ["Some Text it's 12,5", "", "ÄÖ x  y"]
    library = tokenizers.Tokenizer.from_file(name)
    assert [x.tolist() for x in packing.ChunkIds(name).encode(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_encodes_parts_in_joined_strings(monkeypatch):
    """The library's ids, with plain parts encoded once and many to a string, whatever a worker still keeps."""
    tokenizers = pytest.importorskip("tokenizers")
    name = path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(name)
    odd = ["0 00 a0b 10.0", "it's I'LL x'", "ÀÉß×÷ÿ Ü", "e\u0301 İ ǅ 日本 \u00a0 \u0085z", "<| <|endoftext|>x a<b|c <", "|d \x00\x1c \x7f~", "", " \n"]
    texts = odd + [" ".join(f"{a}{b}{c}," for a in "kmt" for b in "aeiou" for c in "rsxz") + f" {k}" for k in range(5)]
    for kept in (4, 1000):
        monkeypatch.setattr(packing, "KEPT_PARTS", kept)
        own, sent = packing.ChunkIds(name), []
        model = own.words
        own.words = types.SimpleNamespace(encode_batch_fast=lambda many, model=model, sent=sent, **k: sent.append(len(many)) or model.encode_batch_fast(many, **k))
        for part in (texts, texts[::-1]):
            assert [x.tolist() for x in own.encode(pa.array(part))] == [library.encode(t, add_special_tokens=False).ids for t in part]
        assert sum(sent) <= 2 * (2 if kept == 4 else 1)


def test_license_scan_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    name = "/root/testdata/sf0.001/documents.parquet"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{name}'")
    result = connection.execute(license_scan.oracle_sql())
    columns = [d[0] for d in result.description]
    got = license_scan.scanned(spark.read.parquet(name))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(repr, (r[c] for c in columns))) for r in got.collect()) == sorted(tuple(map(repr, r)) for r in result.fetchall())
