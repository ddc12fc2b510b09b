import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import audio, chat, decontaminate, queries, secrets, simhash

from . import messy
from .test_simhash import check_similar
from .test_text_operators import check_packed, plain_hits, plain_spans

SF = "/root/testdata/sf0.01"


def test_preference(spark):
    said = lambda c, xs: [(c, i, r, t) for i, (r, t) in enumerate(xs)]
    common = [("system", "s"), ("user", "hi"), ("assistant", None)]
    rows = said(0, [*common, ("user", "x"), ("assistant", "good")]) + said(1, [*common, ("user", "x"), ("assistant", "bad"), ("assistant", "worse")]) + said(2, common) + said(3, common) + said(4, common) + said(4, common) + [(None, 0, "user", "a"), (6, None, "user", "b")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("side", F.lit("clash"))
    found = chat.preference(turns, F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0)
    made = {r.pair_id: r for r in chat.assembled(found).collect()}
    assert set(made) == {0, 1, 2}
    turn = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
    assert made[0].prompt == turn("system", "s") + turn("user", "hi") + turn("assistant", "") + turn("user", "x")
    good, bad, worse = turn("assistant", "good"), turn("assistant", "bad"), turn("assistant", "worse")
    assert made[0].chosen == good and made[0].chosen_mask == f"0:{len(good)}" and made[0].rejected == bad + worse
    assert made[0].rejected_mask == f"0:{len(bad)},{len(bad)}:{len(bad + worse)}"
    assert made[1].chosen == made[1].rejected == "" and made[2].prompt == "" and made[2].chosen.startswith(turn("system", "s"))
    assert {r.paired for r in found.where("pair_id = 2").collect()} == {False} and found.where("pair_id = 2").count() == 3
    assert chat.preference(turns.limit(0), F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0).collect() == []


def test_preference_of_far_turn_numbers(spark):
    """A pair is one record however far its turns' numbers are apart."""
    rows = [(c, t, "user" if t < 9 else "assistant", "same" if t < 9 else f"end {c}") for c in (0, 1) for t in (-3000, 5, 1500, 10**9)]
    found = chat.paired(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0).collect()
    assert len(found) == 1 and found[0].part == 0 and found[0].prompt.count("same") == 2
    assert found[0].chosen.count("end 0") == found[0].rejected.count("end 1") == 2 and len(found[0].chosen_mask.split(",")) == 2


def test_preference_of_long_conversations(spark):
    """A hundred thousand turns on each side, and a text of a million letters: records of bounded turns that are the whole in order."""
    n, parting = 100_000, 99_000
    turn = F.col("id") % n
    rows = spark.range(2 * n).select(F.floor(F.col("id") / n).alias("conv_id"), turn.alias("turn"), F.when(turn % 2 == 0, "user").otherwise("assistant").alias("role"),
                                     F.when((F.col("id") >= n) & (turn >= parting), F.concat(F.lit("b"), turn)).when(turn == 7, F.repeat(F.lit("x"), 1_000_000)).otherwise(turn.cast("string")).alias("text"))
    found = sorted(chat.paired(rows, F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0).collect(), key=lambda r: r.part)
    assert [r.part for r in found] == list(range(-(-n // chat.PART))) and all(r.paired for r in found)
    said = lambda i, t: f"<|im_start|>{'user' if i % 2 == 0 else 'assistant'}\n{t}<|im_end|>\n"
    assert "".join(r.prompt for r in found) == "".join(said(i, "x" * 1_000_000 if i == 7 else i) for i in range(parting))
    assert "".join(r.rejected for r in found) == "".join(said(i, f"b{i}") for i in range(parting, n))
    for r in found:
        spans = [tuple(map(int, x.split(":"))) for x in r.chosen_mask.split(",") if x]
        assert "".join(r.chosen[a:b] for a, b in spans) == "".join(x for x in r.chosen.split("<|im_start|>") if x.startswith("assistant")).replace("assistant\n", "<|im_start|>assistant\n")


def recordings():
    rng = np.random.default_rng(2)
    tunes = [rng.normal(0, 0.13, 64) for _ in range(30)]
    rows = [(i, t.tolist()) for i, t in enumerate(tunes)]
    rows += [(100 + i, np.concatenate((rng.normal(0, 0.13, 9), t))[:64].tolist()) for i, t in enumerate(tunes[:10])]  # begins nine notes later
    rows += [(200 + i, np.where(rng.random(64) < 0.06, rng.normal(0, 0.13, 64), t).tolist()) for i, t in enumerate(tunes[:10])]  # some notes differ
    return [*rows, (300, tunes[0].tolist()), (301, None), (302, []), (303, [0.1]), (304, [None] * 64)]


def plain_error(a, b):
    """Least bit error over all offsets with half of the positions in common."""
    best = (1.0, 0)
    for o in range(-(len(a) // 2), len(b) // 2):
        s = max(0, -o)
        n = min(len(a) - s, len(b) - s - o)
        if n >= len(a) // 2:
            best = min(best, (float(np.bitwise_count(a[s : s + n] ^ b[s + o : s + o + n]).sum() / (32 * n)), o))
    return best


def test_audio_recall(spark):
    rows = recordings()
    media = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("prints", F.lit(1))
    found = audio.align(audio.fingerprints(media, "vec_id", "embedding", audio.melody), F.col("rec_id") % 20 == 0).collect()
    members = {r.b_id: r.a_id for r in found if r.kind == "member"}
    assert set(members) == {i for i, _ in rows} and members[300] == 0 and members[301] == members[302] == 301
    prints = {i: audio.integers(audio.chroma(audio.melody(list(np.float32(t))))) for i, t in rows if t and len(t) == 64 and t[0] is not None}
    want = {(q, i) for q in {members[q] for q in prints if q % 20 == 0} for i in prints if members[i] == i and i != q and plain_error(prints[q], prints[i])[0] <= audio.ERRORS}
    got = {(r.a_id, r.b_id) for r in found if r.kind == "match"}
    assert want and want == got
    shifted = {r.b_id: r.offset for r in found if r.kind == "match" and r.a_id == 0}
    assert abs(shifted[100] - 18) <= 1
    assert audio.align(audio.fingerprints(media.limit(0), "vec_id", "embedding", audio.melody), F.lit(True)).collect() == []


def test_audio_in_noise(spark):
    """Copies under white noise as loud as they are (0 dB) are found, as are all pairs of the small table that brute force finds."""
    rng = np.random.default_rng(9)
    tunes = [audio.melody(rng.normal(0, 0.13, 64).tolist()) for _ in range(40)]
    noisy = [t + rng.normal(0, np.sqrt(np.mean(t**2)), len(t)).astype(np.float32) for t in tunes]
    rows = spark.createDataFrame([(k * 1000 + i, t.tolist()) for k, ts in enumerate((tunes, noisy)) for i, t in enumerate(ts)], "id bigint, sound array<float>")
    prints = audio.fingerprints(rows, "id", "sound", lambda v: np.array(v, np.float32))
    found = {(r.a_id, r.b_id) for r in audio.align(prints, F.col("rec_id") < 1000).collect() if r.kind == "match"}
    assert sum((i, 1000 + i) in found for i in range(40)) >= 36


def test_audio_query_is_brute_force(spark, monkeypatch):
    media = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    prints = {i: audio.integers(audio.chroma(audio.melody(v))) for i, v in media}
    want = {(q, i): plain_error(prints[q], prints[i]) for q in prints if q % 20 == 0 for i in prints if i != q}
    want = {k: e for k, e in want.items() if e[0] <= audio.ERRORS}
    for block in (audio.BLOCK, 500):  # one block of queries, or several
        monkeypatch.setattr(audio, "BLOCK", block)
        found = {(r.a_id, r.b_id): r.bit_error for r in queries.op5_audio(spark, SF).collect() if r.kind == "match"}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k][0]) < 1e-9 for k in want)


@pytest.fixture(scope="module")
def stages(spark):
    docs, made = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        made.append((name, docs, after))
        docs = after
    return made


def test_pipeline_stages(spark, stages):
    of = {name: ({r.doc_id: r for r in a.collect()}, b.collect()) for name, a, b in stages}
    before, after = of["quality"]
    scored = {r.doc_id: r.predicted for r in queries.op3_quality(spark, SF).collect()}
    assert {r.doc_id for r in after} == {i for i in before if scored[i]} and len(after) < len(before)
    before, after = of["near_duplicates"]
    ids = sorted(before)
    classes = {r.doc_id: r.component_id for r in simhash.similar(next(a for n, a, _ in stages if n == "near_duplicates")).collect()}
    check_similar(ids, [before[i].text for i in ids], classes)
    assert sorted(r.doc_id for r in after) == sorted(set(classes.values())) and len(after) < len(before)
    before, after = of["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert {r.doc_id for r in after} == {i for i, r in before.items() if not plain_hits(r.text, items)[-1]}
    before, after = of["secrets"]
    assert {r.doc_id for r in after} == set(before) and all(not plain_spans(r.text) for r in after)
    assert all(r == before[r.doc_id] for r in after if not re.search(r"\[(SECRET|EXAMPLE)\]", r.text))
    before, after = of["packing"]
    check_packed(after, [(i, r.text) for i, r in before.items()])


def test_pipeline_messy(spark, tmp_path):
    docs = messy.docs(spark)
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this kind")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    single = corpus_pipeline.single(spark, docs, str(tmp_path)).collect()
    assert [r.doc_id for r in single].count(6) == 1 and not {7} & {r.doc_id for r in single}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, messy.empty(spark), str(tmp_path)).collect() == []


def test_operators_take_other_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x")], "key bigint, body string, owner string")
    assert simhash.near_duplicates(docs, "key", "body").first().component_id == 1
    assert secrets.scan(docs, "key", "body", "owner", "key").first().n_hex == 0
    assert decontaminate.contamination(docs, docs, "key", "body", "key", "body").first().n_hit == 5
