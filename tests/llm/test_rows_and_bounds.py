"""Row keys, label ties, dense texts, and what the dedup stage hashes."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from veldspar.llm import decontaminate, exact_dedup, ngram_join, pii, source_mix, text, toxicity


def test_ip_parts_of_any_length():
    zeros = "0" * 5000
    for shown, valid in ((f"{zeros}1.1.1.1", True), (f"{zeros}255.{zeros}0.1.1", True), (f"{zeros}256.1.1.1", False), (f"1{zeros}.1.1.1", False), (f"{zeros}.0.0.0", True)):
        assert [(k, ok) for _, k, _, ok in pii.base_matches(shown) if k == 1] == [(1, valid)]


def brute_judge(found, accepted):
    base, added = [(s, k, e) for s, k, e, _, b in found if b], []
    for s, k, e, code, b in found:
        if b or any(s < e2 and s2 < e for s2, _, e2 in base) or added and s < added[-1][2]:
            continue
        if accepted[code]:
            added.append((s, k, e))
    return base, added


def test_judge_is_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        spans = sorted({(s := rng.randrange(60), rng.randrange(7), s + rng.randrange(1, 20), rng.choice("ab"), rng.random() < 0.3) for _ in range(rng.randrange(25))})
        accepted = {"a": True, "b": False}
        assert pii.judge(spans, dict(accepted), None) == brute_judge(spans, accepted)


def test_dense_text_takes_linear_time():
    rng = random.Random(1)
    piece = lambda i: rng.choice([f"mail b{i}@s.org", f"10.0.{i % 200}.7", f"+49 30 {i:07d}", f"call 555-{i % 900 + 100}-1234", "DE44500105175407324931", "DE45500105175407324931", "Dear Mr James Miller"])
    took = []
    for n in (4_000, 16_000):
        t = " ".join(piece(i) for i in range(n))
        began = time.process_time()
        found = sorted(pii.candidates(t)[1])
        pii.judge([(*x[:3], "c", x[4]) for x in found], {"c": True}, None)
        pii.iban_matches(t)
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.05), took  # four times the text


def test_labels_that_repeat_an_id(spark):
    """The order of label rows is of no account: the larger value of each category holds."""
    docs = spark.createDataFrame([(i, ("awful rotten words " if i % 3 else "kind and gentle words ") * 4 + f"number {i}") for i in range(80)], "doc_id long, text string")
    rows = [(i, 1, int(i % 3 > 0)) for i in range(80)] + [(i, 0, 0) for i in range(0, 80, 2)] + [(i, 1, 0) for i in range(1, 80, 4)]
    scores = []
    for seed in (1, 2, 3):
        random.Random(seed).shuffle(rows)
        chain = toxicity.fit_chain(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int").repartition(seed))
        scores.append(sorted((r.doc_id, r.p_toxic) for r in toxicity.score_toxicity(docs, chain).collect()))
    assert scores[0] == scores[1] == scores[2]


def test_training_bytes_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "BYTES", 3000)
    monkeypatch.setattr(toxicity.Chain, "fit", lambda self, sample, *_: seen.append(sample.sizes.sum()))
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(200)], "doc_id long, text string")
    toxicity.fit_chain(docs, spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int"))
    assert seen == [6000]


def test_rows_are_told_apart_by_128_bits(spark, monkeypatch):
    """With 64 of the bits equal for all rows, no row is taken for another."""
    real = text.row_key
    key = real(F.col("doc_id"), F.col("text"))
    docs = spark.createDataFrame([(i, " ".join(f"{c}{j}" for j in range(30))) for i, c in enumerate("aabbcd")] + [(9, None)], "doc_id long, text string")
    assert {len(r[0]) for r in docs.select(key).collect()} == {16} and docs.select(key).distinct().count() == docs.count()
    same_half = lambda i, t: F.concat(F.to_binary(F.lit("00" * 8), F.lit("hex")), F.substring(real(i, t), 9, 8))
    for module in (ngram_join, decontaminate):
        monkeypatch.setattr(module, "row_key", same_half)
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == [0, 2, 4, 5, 9]
    items = spark.createDataFrame([(1, " ".join(f"b{j}" for j in range(12)))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()) == [0, 1, 4, 5, 9]


def test_dedup_stage_hashes_rows_that_were_found(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}" if i < 20 else f"single {i}") for i in range(60)] + [(None, "text 1"), (None, "alone"), (None, "alone"), (3, "text 3")], "doc_id long, text string")
    kept = exact_dedup.drop_copies(docs)
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted([(i, f"text {i % 7}") for i in range(13, 20)] + [(i, f"single {i}") for i in range(20, 60)] + [(-1, "alone")])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Join" in line]
    assert keys and all("sha2" not in re.split("LeftAnti|Inner|LeftOuter", line)[0] for line in keys)  # before the join type stand the keys


def test_domains_are_few(spark):
    docs = spark.createDataFrame([(i, "some words", f"d{i}") for i in range(80)], "doc_id long, text string, lang string")
    try:
        source_mix.fit_domains(docs, docs.select("doc_id"))
    except ValueError as e:
        assert "more than 64" in str(e)
    else:
        raise AssertionError("80 domains were taken")


def test_long_lists_hold_pairs_against_whole_bitmaps(spark, monkeypatch):
    """A family of variants that share frequent shingles and mostly don't link: pairs of its lists don't grow with their square."""
    rng = random.Random(4)
    texts = {}
    for i in range(120):
        words = [f"w{j}" for j in range(400)]
        for at in range(10, 400, 20):
            words[at] += rng.choice("abc")
        texts[i] = " ".join(words)
    for i in range(0, 120, 10):  # one that links
        texts[1000 + i] = texts[i] + " end"
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    linked = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    least = {i: i for i in sets}
    for _ in range(len(sets)):
        for i, j in linked:
            least[i] = least[j] = min(least[i], least[j])

    made, cut = {}, ngram_join.cut

    def kept(df, name="t", keep=False):
        made[name] = cut(df, name, True)
        return made[name]

    monkeypatch.setattr(ngram_join, "cut", kept)
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, 5, 80).collect()}
    assert got == least and len(linked) >= 12
    assert made["ngram-grouppairs"].count() <= 4 * len(texts)
