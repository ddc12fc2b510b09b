import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import fim, merkle, queries, toxicity
from millrace.llm.common import bucket

from . import messy

SF = "/root/testdata/sf0.01"
FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fields(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def plain_manifest(rows):
    """Proofs by walking each tree in memory; rows as (doc_id, text, lang, source, n_chars)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(enc(v) for v in (r[0], r[3], r[2], r[4], t)))
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
        return levels

    def climb(levels, at, proof, now):
        for nodes in levels[:-1]:
            run = nodes[at - at % 8 : at - at % 8 + 8]
            left, right = "".join(run[: at % 8]), "".join(run[at % 8 + 1 :])
            proof, now, at = proof + left + right, sha(left + now + right), at // 8
        return proof, now

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    made = []
    for j, g in enumerate(names):
        for i, (_, _, h, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            proof, now = climb(trees[g], i, "", leaf(r, lower(r[1])) if hit else h)
            proof, now = climb(top, j, proof, now)
            made.append((r[0], h, trees[g][-1][0], top[-1][0], sha(proof), now, now == top[-1][0]))
    return made


def by_text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("sizes", [(1,), (9, 1), (8, 64, 65), (1,) * 10 + (2,), (513, 3)])
def test_manifest_is_brute_force(spark, sizes):
    rows = [(100 * g + i if i % 7 else None, f"Text {g} {i % 5} É" if i % 4 else None, f"l{g}" if g else None, None if i % 3 else "s", i) for g, n in enumerate(sizes) for i in range(n)]
    found = [tuple(r) for r in merkle.audited(fields(spark, rows)).collect()]
    assert by_text(found) == by_text(plain_manifest(rows))


def test_manifest_messy(spark):
    rows = [tuple(r) for r in messy.docs(spark).select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert by_text(tuple(r) for r in merkle.audited(messy.docs(spark)).collect()) == by_text(plain_manifest(rows))
    assert merkle.audited(messy.empty(spark)).collect() == []


def test_manifest_other_payload_and_group(spark):
    rows = spark.createDataFrame([(i, f"g{i % 3}", "x") for i in range(30)], "k int, grp string, steps string").withColumn("leaf", merkle.leaf(F.col("k")))
    found = merkle.manifest(rows, "grp", "k").collect()
    assert len(found) == 30 and len({r.root for r in found}) == 1 and len({r.subroot for r in found}) == 3


def same_as_sql(spark, name, sf=SF):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    found = queries.QUERIES[name](spark, sf).select(*names).collect()
    assert by_text(tuple(r) for r in found) == by_text(want.fetchall())


def test_manifest_sql(spark):
    same_as_sql(spark, "op11_merkle")


def test_fim_sql(spark):
    same_as_sql(spark, "op12_fim")


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    one, two = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, len(units), "plain", None, None, sha(text), sha(text))
    spm = h4 % 100 < 20
    output = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(units), "spm" if spm else "psm", len(p), len(m), sha(output), sha(text))


def test_fim_is_brute_force(spark):
    odd = ["", "a", "<P", "<<S", "x<M>y", "É à\r\n\t", "\U0001f600a\U0001f600", "ab" * 3000 + " " + "é" * 700, "S> <", "<", ">" * 40]
    rows = [(i, odd[i % len(odd)] + ("" if i % 2 else "<" * (i % 5))) for i in range(400)] + [(None, "one Two"), (7, None), (7, "x y"), (7, "x y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [tuple(r) for r in fim.digests(docs).collect()]
    assert by_text(found) == by_text(plain_fim(*r) for r in rows)


def test_fim_of_a_hot_text_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(fim, "CHUNK", 50)
    rows = [(i, "the Same text, often" if i % 3 else f"text {i}") for i in range(900)]
    found = [tuple(r) for r in fim.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert by_text(found) == by_text(plain_fim(*r) for r in rows)


def test_fim_messy(spark):
    rows = [tuple(r) for r in messy.docs(spark).select("doc_id", "text").collect()]
    assert by_text(tuple(r) for r in fim.digests(messy.docs(spark)).collect()) == by_text(plain_fim(*r) for r in rows)
    assert fim.digests(messy.empty(spark)).collect() == []


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, gap in ((1, 1), (5, 1000), (3000, 1), (3000, 9), (700, 100_000)):
        values = np.cumsum(rng.integers(1, gap + 1, n))
        ef = fim.EliasFano.load(fim.EliasFano.of(values).dump())
        assert [ef[i] for i in range(n)] == values.tolist()
        assert len(ef.dump()) < 40 + n * (np.log2(values[-1] / n) + 3) / 8 + 8 * (n // fim.SKIP + 1)
    assert fim.EliasFano.of(np.zeros(0, np.int64)).n == 0


def toxic_rows(n, seed):
    """Clean texts of two languages; the toxic ones have one word of their language's stem, in some inflection."""
    rng = np.random.default_rng(seed)
    stems, rows = {"aa": ("grom", ["kal", "tori", "ven", "dula"]), "bb": ("zwep", ["ostri", "miel", "ruc", "pana"])}, []
    for i in range(n):
        lang, (stem, parts) = list(stems.items())[i % 2]
        words = ["".join(rng.choice(parts, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(8, 60)))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            words[int(rng.integers(len(words)))] = stem + str(rng.choice(parts))
        rows.append((i, " ".join(words), lang, toxic))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows(900, 3)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, toxic int")
    held_out = bucket(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, labels, held_out)
    scored = toxicity.score(docs.drop("lang"), model).join(labels, "doc_id").where(held_out).collect()
    right = [(r.score >= 0.5) == (r.toxic == 1) for r in scored]
    assert len(right) > 120 and np.mean(right) > 0.97
    # Labels of the held-out rows change nothing, nor do ids, languages or other rows of the scored table.
    other = toxicity.fit(docs, labels.withColumn("toxic", F.when(held_out, 1 - F.col("toxic")).otherwise(F.col("toxic"))), held_out)
    texts = [r[1] for r in rows[:40]]
    assert np.array_equal(model.scores(texts), other.scores(texts)) and np.array_equal(model.scores(texts[5:9]), model.scores(texts)[5:9])


def plain_logit(model, text):
    """One window after another."""
    x = [sum(model.net.E[b].astype(np.float64) for b in toxicity.buckets_of(w)) for w in toxicity.words_of(text)]
    best, c = [], 0
    for k, m in toxicity.WIDTHS:
        for j in range(m):
            best.append(max((sum(x[i + q] @ model.net.f[:, c + q * m + j].astype(np.float64) for q in range(k) if i + q < len(x)) for i in range(len(x))), default=-1e3))
        c += k * m
    return np.maximum(0, np.array(best) + model.net.b) @ model.net.w + model.net.a


def test_toxicity_is_brute_force(monkeypatch):
    rows = toxic_rows(120, 5)
    model = toxicity.Model([r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows])
    model.unpack()
    texts = ["", "a", "a b", rows[0][1], rows[1][1] * 3, "É ñ x" * 20]
    want = [plain_logit(model, t) for t in texts]
    assert np.allclose(model.raw(texts, toxicity.Rows(model))[0], want, atol=1e-4)
    monkeypatch.setattr(toxicity, "BLOCK", 5)
    monkeypatch.setattr(toxicity, "CACHE", 10)
    assert np.allclose(model.raw(texts, toxicity.Rows(model))[0], want, atol=1e-4)


def test_toxicity_gradients_lower_the_loss():
    rows = toxic_rows(200, 6)
    y = np.array([r[3] for r in rows])
    before, after = (toxicity.Model([r[1] for r in rows], y.tolist(), [r[2] for r in rows], epochs=n) for n in (0, 10))
    loss = lambda m: -np.log(np.where(y > 0, m.scores([r[1] for r in rows]), 1 - m.scores([r[1] for r in rows]))).mean()
    assert loss(after) < 0.7 * loss(before)


def test_toxicity_learns_from_all_rows(spark, monkeypatch):
    """Rows in shards: every labelled row is counted and calibrated on, once; the model is as good, and the same again."""
    monkeypatch.setattr(toxicity, "SHARD", 200)
    seen = {}
    calibrate, counts_of = toxicity.calibrate_dealt, toxicity.counts_of
    monkeypatch.setattr(toxicity, "calibrate_dealt", lambda blocks, model, n, shares: (seen.update(held=n.tolist(), shares=list(shares)), calibrate(blocks, model, n, shares)))
    monkeypatch.setattr(toxicity, "counts_of", lambda blocks, names: seen.setdefault("counts", counts_of(seen.setdefault("learned", blocks), names)))
    rows = toxic_rows(1500, 8)
    docs = spark.createDataFrame([r[:3] for r in rows] + [rows[1][:3]], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(5000, 1), (None, 0), (7000, 2)], "doc_id bigint, toxic int")
    held_out = bucket(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, labels, held_out)
    mine = {r.doc_id for r in docs.where(~held_out).collect()}
    learned = [np.array([r[f"n{v}"] for r in seen["learned"].collect()]).sum() for v in (0, 1)]
    assert [a + b for a, b in zip(learned, seen["held"], strict=True)] == [sum(r[0] in mine and r[3] == v for r in rows) for v in (0, 1)]
    assert 0.1 * len(mine) < sum(seen["held"]) < 0.3 * len(mine)
    # Counts of buckets and of languages' words, against plain ones of the same rows.
    mine_rows = [(docs_, table, y, langs) for _, docs_, table, y, langs in toxicity.unpacked(iter(seen["learned"].toArrow().to_batches()))]
    plain = np.zeros_like(seen["counts"])
    for docs_, table, y, langs in mine_rows:
        for d, label, lang in zip(docs_, y, langs, strict=True):
            plain[int(label), list(set(table[d].ravel()))] += 1
            np.add.at(plain[2 + model.tongues.names.index(lang)], table[d, 0], 1)
    assert np.array_equal(seen["counts"], plain)
    scored = toxicity.score(docs.drop("lang"), model).join(labels, "doc_id").where(held_out).collect()
    right = [(r.score >= 0.5) == (r.toxic == 1) for r in scored]
    assert len(right) > 200 and np.mean(right) > 0.97
    texts = [r[1] for r in rows[:40]]
    again = toxicity.fit(docs.repartition(7), labels.repartition(3), held_out)
    assert np.allclose(model.scores(texts), again.scores(texts), atol=1e-3)


def test_toxicity_finds_labelled_ids(spark):
    """The bit map of ids loses none and spares the join most of the others; ids of another type are found, too."""
    docs = spark.range(40000).selectExpr("id as _of", "'x' as text")
    kept = {r._of for r in toxicity.likely(docs, spark.range(0, 40000, 10).selectExpr("cast(id as int) as _id"), 4000).collect()}
    assert kept >= set(range(0, 40000, 10)) and len(kept) < 12000


def test_toxicity_thresholds_by_language(spark):
    """A language's threshold maps to one half, and languages come from the text."""
    rows = toxic_rows(400, 7)
    model = toxicity.Model([r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows])
    z, tongue = model.raw([r[1] for r in rows], toxicity.Rows(model))
    assert [model.tongues.names[t] for t in tongue] == [r[2] for r in rows] and set(model.thresholds) == {0, 1}
    t = np.array([model.thresholds[v] for v in tongue])
    assert np.array_equal(model.scores([r[1] for r in rows]) >= 0.5, z >= t)


def test_toxicity_messy(spark):
    docs = messy.docs(spark)
    labels = spark.createDataFrame([(0, 1), (2, 0), (4, 1), (5, 0), (6, None), (None, 1), (8, 0), (8, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, F.lit(False))
    found = toxicity.score(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where("false"), F.lit(False))).collect()} == {0.5}
    assert toxicity.score(messy.empty(spark), model).collect() == [] and {r.score for r in toxicity.score(docs, toxicity.fit(messy.empty(spark), labels, F.lit(False))).collect()} == {0.5}
