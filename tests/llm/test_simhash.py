import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash

from . import messy


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode("utf-8", "replace"), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(ids, fps, budget=4):
    """Smallest id reachable, by brute force over distinct fingerprints."""
    v = np.unique(np.array(fps, np.uint64))
    links = simhash.Links(len(v))
    for i in range(len(v)):
        j = np.flatnonzero(np.bitwise_count(v ^ v[i]) <= budget)
        links.add(np.full(len(j), i), j)
    root = dict(zip(v.tolist(), links.to.tolist(), strict=True))
    least = {}
    for i, f in zip(ids, fps, strict=True):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    return [least.get(root[f]) for f in fps]


def test_walk_is_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    v = np.unique(np.array([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(25)], np.uint64))
    to = simhash.walk(v, np.zeros(len(v), int), np.array([0]), np.array([0]))
    links = simhash.Links(len(v))
    i, j = np.triu_indices(len(v), 1)
    near = np.bitwise_count(v[i] ^ v[j]) <= 4
    links.add(i[near], j[near])
    assert np.array_equal(to, links.to) and len(set(to.tolist())) < len(v)


@pytest.mark.parametrize(("piece", "mean"), [(1024, 256), (7, 256), (16, 1)])
def test_classes_on_documents(spark, piece, mean):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    found = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs, piece=piece, mean=mean).collect()}
    for r, f, c in zip(rows, fps, plain_components([r.doc_id for r in rows], fps), strict=True):
        assert found[r.doc_id] == (f, c)


def test_dense_group_in_pieces(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(400):
        w = list(words)
        for _ in range(random.randint(0, 3)):
            w[random.randrange(60)] = f"x{random.random()}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_components(range(len(texts)), fps)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, piece=32).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_messy(spark):
    rows = messy.docs(spark).collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = sorted(zip([str(r.doc_id) for r in rows], fps, map(str, plain_components([r.doc_id for r in rows], fps)), strict=True))
    found = simhash.near_duplicates(messy.docs(spark)).collect()
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in found) == want
    assert simhash.near_duplicates(messy.empty(spark)).collect() == []


def plain_similarities(texts, least):
    """{(i, j): Jaccard similarity of five-word shingles} of the pairs that reach ``least``, by an inverted index."""
    sets = []
    for text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    holders, common = {}, {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for at in holders.values():
        for k, j in enumerate(at):
            for i in at[:k]:
                common[i, j] = common.get((i, j), 0) + 1
    found = {(i, j): n / (len(sets[i]) + len(sets[j]) - n) for (i, j), n in common.items()}
    return {k: v for k, v in found.items() if v >= least}


def joined(n, pairs):
    """The smallest position that each of n reaches by the pairs."""
    links = simhash.Links(n)
    for i, j in pairs:
        links.add(np.array([i]), np.array([j]))
    return links.to.tolist()


def check_similar(ids, texts, component):
    """Nearly all pairs of a similarity of 0.8 or more are in one class, all of 0.9 or more, and no class goes beyond links of 0.6."""
    pairs = plain_similarities(texts, 0.6)
    for least, share in ((0.9, 1), (0.8, 0.95)):
        want = [k for k, v in pairs.items() if v >= least]
        assert sum(component[ids[i]] == component[ids[j]] for i, j in want) >= share * len(want)
    loose = {i: r for i, r in zip(ids, joined(len(ids), pairs), strict=True)}
    assert all(loose[i] == loose[c] for i, c in component.items())


@pytest.mark.parametrize("piece", [1024, 5])
def test_similar_on_documents(spark, piece):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    found = {r.doc_id: r.component_id for r in simhash.similar(docs, piece=piece).collect()}
    check_similar([r.doc_id for r in rows], [r.text for r in rows], found)
    assert 1 < len(set(found.values())) < len(found)


def test_similar_edits(spark):
    rng, texts = random.Random(9), []
    for n in range(120):  # each base text, a copy with few words changed, and one with many
        words = [f"w{rng.randrange(5000)}" for _ in range(150 + n)]
        few, many = list(words), list(words)
        few[20] = few[90] = "other"
        for k in range(0, len(words), 8):
            many[k] = "else"
        texts += [" ".join(words), " ".join(few), " ".join(many)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert [found[i] for i in range(len(texts))] == [i - 1 if i % 3 == 1 else i for i in range(len(texts))]


def test_similar_messy(spark):
    rows = messy.docs(spark).collect()
    words = lambda t: tuple(re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()))
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[words(r.text)] = min(least.get(words(r.text), r.doc_id), r.doc_id)
    found = simhash.similar(messy.docs(spark)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == sorted((str(r.doc_id), str(least.get(words(r.text)))) for r in rows)
    assert simhash.similar(messy.empty(spark)).collect() == []


def test_similar_dense_groups_in_stars(spark):
    """Groups of near copies in tries far beyond a piece, with rows between that only pairs of pieces link."""
    rng, texts = random.Random(4), []
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(300)]
        for _ in range(150):
            w = list(base)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(300)] = f"x{rng.random()}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {piece: sorted((r.doc_id, r.component_id) for r in simhash.similar(docs, piece=piece).collect()) for piece in (1024, 16)}
    assert found[16] == found[1024]
    check_similar(range(len(texts)), texts, dict(found[16]))


def test_star_cells_meet_all_but_one_star(spark):
    nodes = [(0, 7, n, 1, star) for n, star in enumerate([0] * 9 + [1] * 12 + [2] * 5)]
    cut = simhash.star_cells(spark.createDataFrame(nodes, "forest int, trie bigint, node bigint, weight int, star int"), 4).collect()
    own, star, met = {}, {r[2]: r[4] for r in nodes}, set()
    for r in cut:
        own.setdefault((r.i, r.j), []).append((r.node, r.own))
    for (i, j), rows in own.items():
        met |= {(a, b) for a, p in rows for b, q in rows if a < b and (i == j or p != q)}
    assert met == {(a, b) for a in star for b in star if a < b and (star[a] != star[b] or star[a] == 0)}


@pytest.mark.parametrize("piece", [1024, 16])
def test_similar_is_exact(spark, piece):
    """Classes are those of all pairs of an exact similarity of 0.8 or more that share a forest, for short texts and for groups a little to both sides of 0.8."""
    rng, texts = random.Random(11), []
    for n in range(150):  # four of five shingles in common
        words = [f"s{rng.randrange(10**6)}" for _ in range(9)]
        texts += [" ".join(words[:8]), " ".join(words)]
    for n in range(60):  # one base and copies of it with one to four words changed
        base = [f"w{rng.randrange(10**6)}" for _ in range(100 + n)]
        texts.append(" ".join(base))
        for changes in (1, 2, 2, 3, 3, 4):
            w = list(base)
            for k in rng.sample(range(len(w)), changes):
                w[k] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar(docs, piece=piece).collect()}
    pairs = plain_similarities(texts, 0.8)
    keys = simhash.sketch_many(texts)[1]
    met = [(i, j) for i, j in pairs if (keys[i] == keys[j]).any()]  # two cases in 10,000 share no forest
    assert len(pairs) - len(met) <= 1
    assert [found[i] for i in range(len(texts))] == joined(len(texts), met)


def test_large_and_small_tries_have_the_same_links(spark):
    """The pairs of a trie link alike whether it is one cell, or is cut to pieces around hubs."""
    rng, texts = random.Random(8), []
    for _ in range(40):  # a chain of steps, each a little from the last, so that links need what lies between
        w = [f"v{rng.randrange(10**6)}" for _ in range(80)]
        for _ in range(6):
            w = list(w)
            w[rng.randrange(80)] = f"y{rng.random()}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {piece: sorted((r.doc_id, r.component_id) for r in simhash.similar(docs, piece=piece).collect()) for piece in (1024, 3)}
    assert found[3] == found[1024] and len({c for _, c in found[3]}) < len(texts)


def test_representatives_are_rows(spark):
    """Ids may have several texts, and rows may be equal: one row of each class stays, by its text."""
    a, b = "one text that is about this " * 5, "quite another that nothing else is like " * 5
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b), (None, a), (None, "a third one of which no row has an id")], "doc_id bigint, text string")
    kept = simhash.representatives(simhash.similar(docs))
    th = {r.th: r.text for r in docs.select("text", F.xxhash64("text").alias("th")).collect()}
    assert sorted((str(r.doc_id), th[r.th]) for r in kept.collect()) == sorted([("3", a), ("5", b), ("None", "a third one of which no row has an id")])
