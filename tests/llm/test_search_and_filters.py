"""URL filters, centroid clustering and lexical search against brute force, with nulls, empties, ties, repeats and odd columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from reelframe.llm import centroid_clustering, lexical_search, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judged_plainly(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group().translate(LOWER)
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    fits = []
    for h, p, v in rules:
        h, p = (h or "").translate(LOWER), p or ""
        if (h in ("", host) or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), v, h + p))
    best = max(fits, default=(0, 0, otherwise, None))
    return host, path, best[3], best[2]


def urls():
    r = random.Random(3)
    hosts = ["example.org", "a.example.org", "b.a.example.org", "org", "EXAMPLE.com", "badexample.org", "a..org", "example.org.", "x.y", "com", "öl.de", ""]
    paths = ["", "/", "/en", "/en/1", "/en/12", "/en/1/x", "/es/", "/EN/1", "/en/1?x=/es/", "#/en", "?a://b/", "/e" * 300]
    made = [f"{r.choice(['http', 'https', ''])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(600)]
    return made + [None, "", "no scheme", "://", "a://b://c/d", "http://example.org/en/1\n/x"] + ["https://a.example.org/en/1"] * 300


RULES = [("org", "/", "allow"), ("example.org", "/en/1", "block"), ("example.org", "/en", "allow"), ("a.example.org", "", "block"), ("a.example.org", "/en/1", "allow"), ("com", "/es", "block"), ("Example.com", "/es/", "allow"), ("y", "en", "block"), ("x.y", "/en", "allow"), ("x.y", "/en", "block"), ("öl.de", "/", "block")]


@pytest.mark.parametrize("rules", [RULES, RULES + [("", "/EN", "block"), (None, None, "allow")], [], RULES[:1]])
def test_url_filter_equals_brute_force(spark, rules):
    given = urls()
    pages = spark.createDataFrame([(k if k % 50 else None, u, 1, "h") for k, u in enumerate(given)], "page_id long, url string, row int, host string").repartition(3)
    got = url_filter.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(k if k % 50 else None, *judged_plainly(u, rules)) for k, u in enumerate(given)]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_url_filter_ranges(spark):
    """Bounds cut a key that very many rows share, and a rule reaches each range that its interval meets."""
    pages = spark.createDataFrame([(k, "http://a.org/x" if k % 3 else f"http://b.org/{k}") for k in range(6000)], "page_id long, url string")
    rows = url_filter.points(pages, 1, 2)
    ends = url_filter.bounds(rows, 6000, 16)
    assert len(ends) == 15 and sum(k == "org.a./x" for k, _ in ends) >= 2
    sizes = collections.Counter(r.part for r in rows.mapInArrow(url_filter._dealt(ends), ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", part int").collect())
    assert len(sizes) == 16 and max(sizes.values()) < 4 * 12000 / 16
    own = url_filter.canonical(spark.createDataFrame([("org", "/", "allow"), ("a.org", "/x", "block")], "host string, path string, verdict string")).drop("labels")
    spread = collections.Counter(r.rule for r in own.mapInArrow(url_filter._replicated(ends), "key string, rule string, verdict string, n int, h int, part int").collect())
    assert spread["a.org/x"] >= 3
    empty = url_filter.judged(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string"))
    assert empty.count() == 0


def lloyd_plainly(rows, clusters=16, rounds=3):
    held = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            held.append((i, [math.floor(64 * x) for x in v]))
    order = sorted(held, key=lambda x: (hashlib.sha256(f"1:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))
    centroids = [v for _, v in order[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in held:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(own[k]) for x in zip(*own[k], strict=True)] if own[k] else c for k, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in held]
    of = collections.Counter()
    for _, c, d in found:
        of[c] += d
    return [(i, c, d, of[c], sum(of.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found]


def test_centroid_clustering_equals_brute_force(spark):
    r = random.Random(5)
    vector = lambda: np.float32([r.gauss(0, 0.4) for _ in range(64)]).tolist()
    same = vector()
    rows = [(k, vector()) for k in range(120)] + [(200 + k, same) for k in range(60)] + [(2**60 + 1, vector()), (None, vector()), (5, vector())]
    odd = [(300, None), (301, []), (302, same[:63]), (303, [None] + same[1:]), (304, [float("nan")] + same[1:]), (305, [float("inf")] + same[1:]), (306, same + [0.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<float>, v string, cluster int").repartition(5)
    got = centroid_clustering.clustered(frame)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted(lloyd_plainly(rows), key=repr)
    few = rows[:3] + [(7, rows[0][1])]
    got = centroid_clustering.clustered(frame.filter("vec_id < 3").select("vec_id", "embedding").union(spark.createDataFrame(few[3:], "vec_id long, embedding array<float>")))
    assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted(lloyd_plainly(few), key=repr)
    assert centroid_clustering.clustered(frame.limit(0)).count() == 0


def test_centroid_clustering_of_huge_components(spark):
    frame = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.5] * 64)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in centroid_clustering.clustered(frame, clusters=1, rounds=1).collect()}
    assert got[1].distance <= centroid_clustering.LONGEST and all(r.inertia > 0 for r in got.values())


def search_plainly(documents, items, k=50):
    term = re.compile(lexical_search.TERM)
    texts = [(row, doc, term.findall((text or "").translate(LOWER))) for row, (doc, text) in enumerate(documents)]
    texts = [(row, doc, words, collections.Counter(words)) for row, doc, words in texts if words]
    total, length = len(texts), sum(len(w) for _, _, w, _ in texts)
    out = []
    for item, text in items:
        scores = collections.Counter()
        for t in set(term.findall((text or "").translate(LOWER))):
            df = sum(t in c for *_, c in texts)
            w = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
            for row, doc, words, c in texts:
                if t in c:
                    m = 100 - 50 + (50 * len(words) * total) // length
                    scores[row, doc] += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
        best = sorted(((-s, doc is None, doc or 0, row, doc) for (row, doc), s in scores.items() if s > 0))[:k]
        out += [(item, n + 1, x[4], -x[0]) for n, x in enumerate(best)]
    return out


def search_case():
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(300)] + ["Été", "日本語", "the", "of"]
    prose = lambda n: " ".join(r.choice(vocabulary[: r.randint(3, len(vocabulary))]) + r.choice(["", ",", "\n"]) for _ in range(n)) + " the THE of"
    copy = prose(50)
    documents = [(k, prose(r.randint(1, 120))) for k in range(150)] + [(1000 - k, copy) for k in range(70)] + [(None, None), (None, copy), (5, "the"), (6, ""), (7, " ,.! "), (9, "w1 " * 3000), (10, "x" * 5000)]
    items = [(k, prose(r.randint(1, 40))) for k in range(12)] + [(50, copy), (51, "the of"), (52, ""), (None, None), (53, "nowhere"), (54, "W1 w1 W1"), (50, copy), (55, "x" * 5000)]
    return documents, items


@pytest.mark.parametrize("k,block", [(50, 1 << 18), (5, 1 << 18), (5, 60), (50, 1)])
def test_lexical_search_equals_brute_force(spark, k, block, monkeypatch):
    documents, items = search_case()
    monkeypatch.setattr(lexical_search, "PAIRS", 500)
    frame = spark.createDataFrame([(*d, "en", 3, 0) for d in documents], "doc_id long, text string, lang string, n int, row int").coalesce(1)
    if block == 1:
        items = items[:3]
    got = lexical_search.ranked(frame, spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, row int"), k=k, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted(search_plainly(documents, items, k), key=repr)


def test_lexical_search_of_empty_tables(spark):
    documents, items = search_case()
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.ranked(frame.limit(0), asked).count() == 0
    assert lexical_search.ranked(frame, asked.limit(0)).count() == 0


def test_bounds_prune_terms_and_lose_nothing(spark):
    """Terms at the end whose largest impacts stay under the bound generate no candidates, and are still scored."""
    highest = np.array([100, 50, 9, 5, 3])
    plan = lexical_search.Plan(np.zeros(5, np.int64), np.arange(5), 1, highest, np.array([18]))
    assert np.diff(plan.hit_ptr).tolist() == [1, 1, 0, 0, 0] and plan.rest.tolist() == [17] and len(plan.terms) == 5
    equal = lexical_search.Plan(np.zeros(5, np.int64), np.arange(5), 1, highest, np.array([17]))
    assert np.diff(equal.hit_ptr).tolist() == [1, 1, 1, 0, 0] and equal.rest.tolist() == [8]


def test_words_in_windows(monkeypatch):
    text = ("Ab c1," + "é" * 40 + "; x ").encode() * 50
    whole = [w for part in lexical_search.words(text) for w in part]
    monkeypatch.setattr(lexical_search, "WINDOW", 7)
    assert [w for part in lexical_search.words(text) for w in part] == whole == [w.encode() for w in re.findall(lexical_search.TERM, text.decode().translate(LOWER))]
