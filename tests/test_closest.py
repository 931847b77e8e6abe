"""Suggestions are the best of all candidates, whatever is scored in full."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.functions.names import similarity
from veldspar.operators import closest, identity

ALIASES = "reporting_period string, firm_name string, frn string, trading_name string"


def _keys(seed, n):
    r = random.Random(seed)
    words = ["ltd"] * 4 + ["bank", "of", "alpha", "alhpa", "beta", "group", "é", "中文字", "longerword" * 8, "supplier", "000123", "000132", "001230"]
    return ["", " x"] + [" ".join(r.choice(words) for _ in range(r.randrange(1, 5))) for _ in range(n)] + [" ".join(r.choice(words) for _ in range(60)) for _ in range(4)]


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(before[j - 1] + 1 if x == y else max(row[-1], before[j]))
    return row[-1]


def test_common_subsequences():
    r = random.Random(3)
    texts = ["".join(r.choice("abc") for _ in range(r.randrange(130))) for _ in range(40)] + ["", "a" * 64, "a" * 65, "a" * 128]
    p = closest.Positions(texts, {x: i for i, x in enumerate("abc")}, 3)
    for text in (*texts[:12], "a" * 130, "zab", ""):
        assert p.common(text).tolist() == [_common(text, t) for t in texts]
        assert p.common(text, np.array([3, 1])).tolist() == [_common(text, texts[i]) for i in (3, 1)]


@pytest.mark.parametrize(("seed", "table"), [(1, 1 << 20), (2, 40), (3, 5000)])
def test_bounds_leave_out_none_of_the_best(monkeypatch, seed, table):
    monkeypatch.setattr(closest, "TABLE", table)
    names, keys = _keys(seed, 25), _keys(seed + 10, 120)
    frns = [str(i % 50) for i in range(len(keys))]
    for name, got in zip(names, closest.best_of(names, keys, frns, 3)):
        each = sorted((-c[2], -c[0], i, c[1], frns[i]) for i, c in enumerate(similarity(name, k) for k in keys))
        want = [x for n, x in enumerate(each) if x[4] not in {y[4] for y in each[:n]}][:3]
        assert got == want


@pytest.mark.parametrize("blocks", [None, (5, 7)])
def test_suggestions_look_at_every_candidate(spark, monkeypatch, blocks):
    """300 candidates share a word and the length with the name; the one it is a misprint of shares none."""
    if blocks:
        monkeypatch.setattr(closest, "NAMES", blocks[0])
        monkeypatch.setattr(closest, "CANDIDATES", blocks[1])
    many = [("H1", f"{i:09d} bank", str(i), "") for i in range(300)]
    right = [("H1", "smithsonbnak", "900", ""), ("H1", "smithsonbank", "901", "smithson-bank"), ("H2", "smithsonbank", "901", "")]
    aliases = spark.createDataFrame(many[: 40 if blocks else None] + right, ALIASES)
    firms = spark.createDataFrame([("H1", "smithson bank"), ("H2", "smithson bank"), ("H1", "Smithson Bank"), ("H1", "000000007 bank"), ("H1", None)], "reporting_period string, firm_name string")
    got = {(r.reporting_period, r.unmatched_firm_name, r.suggestion_rank): (r.candidate_name, r.candidate_frn) for r in identity.suggest(firms, aliases, F.lower).collect()}
    assert len(got) == 12
    for firm in (("H1", "smithson bank"), ("H2", "smithson bank"), ("H1", "Smithson Bank")):
        assert [got[(*firm, i)][1] for i in (1, 2)] == ["901", "900"] and got[(*firm, 1)][0] == "smithson-bank"
    assert got[("H1", "000000007 bank", 1)] == ("000000007 bank", "7")


def test_no_candidates_and_no_names(spark):
    firms, none = spark.createDataFrame([("H1", "a")], "reporting_period string, firm_name string"), spark.createDataFrame([], ALIASES)
    assert identity.suggest(firms, none, F.lower).collect() == []
    assert identity.suggest(firms.limit(0), spark.createDataFrame([("H1", "a", "1", "")], ALIASES), F.lower).collect() == []
