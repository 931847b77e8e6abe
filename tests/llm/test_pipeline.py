"""The pipeline's exact stages against brute force; every stage acts, keeps columns and takes what its predecessor kept."""

from __future__ import annotations

import re

import pytest

from tests.llm.test_contract_queries import brute_components
from veldspar.llm.store import cut, table


def test_stages(spark, sf):
    import corpus_pipeline

    docs, seen = table(spark, sf, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = cut(stage(spark, docs, sf))
        seen[name] = before, {r.doc_id: r.text for r in docs.collect()}
        assert set(seen[name][1]) <= set(before)
        assert docs.columns == (columns if name != "source_mix" else [*columns, "n_tokens", "rate"])
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    before, after = seen["exact_dedup"]
    best: dict = {}
    for i, x in before.items():
        best[low(x)] = max(best.get(low(x), -1), i)
    assert set(after) == set(best.values())
    before, after = seen["ngram_jaccard_join"]
    assert set(after) == {root for _, root in brute_components(before, 5, 80).values()}
    before, after = seen["decontaminate"]
    shingles = lambda x: {tuple(w[i : i + 5]) for w in [low(x).split()] for i in range(len(w) - 4)}
    items = [s for s in (shingles(r.text) for r in table(spark, sf, "benchmark").collect()) if s]
    assert set(after) == {i for i, x in before.items() if not any(100 * len(s & shingles(x)) >= 80 * len(s) for s in items)}
    assert len(seen["source_mix"][1]) == len(seen["source_mix"][0]) and len(seen["toxicity"][1]) < len(seen["toxicity"][0])


ODD = [(1, "Same Text of five words here"), (2, "same text of five words here"), (2, "same text of five words here"), (None, "same text of five words here"), (3, None), (4, ""), (None, None), (5, "  \t"), (6, "word " * 200_000), (7, "Ünï côde"), (7, "another text")]
CLASH = {"rate": "x", "n_tokens": "y", "toxic": "z", "band": "b", "h": "h", "c": "c", "n": "n", "count": "k", "doc_key": "d"}


@pytest.mark.parametrize("name", ["toxicity", "exact_dedup", "ngram_jaccard_join", "decontaminate", "source_mix"])
def test_stages_take_odd_rows(spark, sf, name):
    """Nulls, empty, blank and very long texts, ties, repeated rows, clashing names, and an empty table, in each stage."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *CLASH.values()) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH))
    out = cut(stage(spark, docs, sf))
    wanted = [c for c in docs.columns if name != "source_mix" or c not in ("rate", "n_tokens")] + (["n_tokens", "rate"] if name == "source_mix" else [])
    assert out.columns == wanted
    got = sorted(((r.doc_id, (r.text or "")[:12]) for r in out.collect()), key=repr)
    everything = sorted(((i, (t or "")[:12]) for i, t in ODD), key=repr)
    if name == "exact_dedup":  # of equal texts the largest id, once; null counts as empty
        assert got == sorted([(2, "same text of"), (4, ""), (5, "  \t"), (6, "word word wo"), (7, "Ünï côde"), (7, "another text")], key=repr)
    elif name == "ngram_jaccard_join":  # texts without words stay
        assert got == sorted([(1, "Same Text of"), (3, ""), (4, ""), (None, ""), (5, "  \t"), (6, "word word wo"), (7, "Ünï côde"), (7, "another text")], key=repr)
    else:
        assert got == everything
    assert cut(stage(spark, docs.limit(0), sf)).count() == 0


def test_toxicity_through_its_query(spark):
    """The registered query over sf0.01: a row for each document, verdict by the fitted limit, right on the labelled rows."""
    from veldspar.llm import toxicity

    sf = "/root/testdata/sf0.01"
    got = toxicity.op2_toxicity(spark, sf)
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = got.join(labels.withColumnRenamed("toxic", "label"), "doc_id").collect()
    assert got.count() == docs.count() and all(r.kept == (not r.toxic) and 0 <= r.p_toxic <= 1 for r in rows)
    assert sum(r.toxic == (r.label == 1) for r in rows) / len(rows) > 0.97
    again = {r.doc_id: r.p_toxic for r in toxicity.op2_toxicity(spark, sf).collect()}
    assert all(abs(again[r.doc_id] - r.p_toxic) < 1e-9 for r in rows)
