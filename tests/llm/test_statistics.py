"""Scores, step-up, expectation-maximisation and recall of added spans against plain Python and planted cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.llm import pii, secret_scan as S

HEX, ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def plain_scores(t, alphabet):
    """(pairs z, runs z, serial z) by loops."""
    n, k, xs = len(t), len(alphabet), [alphabet.index(c) for c in t]
    pairs, rate = sum(xs[i] == xs[j] for i in range(n) for j in range(i)) or 1e-9, n * (n - 1) / 2 / k
    chi = 3 * math.sqrt(pairs) * (1 - 1 / (9 * pairs) - (rate / pairs) ** (1 / 3))
    up = [x >= k / 2 for x in xs]
    a, runs = sum(up), 1 + sum(x != y for x, y in zip(up, up[1:]))
    mu = 2 * a * (n - a) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    mean = sum(xs) / n
    spread = sum((x - mean) ** 2 for x in xs)
    serial = sum((x - mean) * (y - mean) for x, y in zip(xs, xs[1:])) / spread * math.sqrt(n) if spread else 20.0
    return chi, (runs - mu) / math.sqrt(var) if var > 0 else 20.0, serial


def test_scores_equal_plain_python(spark):
    r = random.Random(1)
    rows = [("".join(r.choice(a) for _ in range(n)), a) for a in (HEX, ALNUM) for n in (20, 24, 32, 41, 64, 200) for _ in range(4)]
    # inferred as alphanumeric and as hex only where characters of each kind occur
    rows = [(t, a) for t, a in rows if a is HEX or (any(c.islower() for c in t) and any(c.isupper() for c in t))] + [("ab" * 20, HEX), ("a1" + "f" * 30, HEX)]
    got = spark.createDataFrame(rows, "t string, a string").withColumn("z", S.z_scores(F.col("t"))).collect()
    for x in got:
        assert (x.z.chi, x.z.runs, x.z.serial) == pytest.approx(plain_scores(x.t, x.a), abs=1e-6), x.t


def test_random_strings_pass_the_battery_as_often_as_they_should(spark):
    r = random.Random(2)
    rows = [(n, "".join(r.choice(a) for _ in range(n))) for a in (HEX, ALNUM) for n in (24, 40, 80) for _ in range(600)]
    ok = S.is_random(S.z_scores(F.col("t")), 0.01)
    share = {x.n: x.s for x in spark.createDataFrame(rows, "n int, t string").groupBy("n").agg(F.avg(ok.cast("int")).alias("s")).collect()}
    assert all(0.975 <= s <= 1 for s in share.values()), share


def test_step_up_equals_benjamini_hochberg(spark):
    """Each band's cutoff against the step-up over its sorted p-values."""
    r = random.Random(4)
    rows = [(n, z, z, z, r.gauss(0, 1) if r.random() < 0.7 else r.gauss(5, 1)) for n in (22, 30, 50, 90) for z in (0.0, 0.0, 9.0) for _ in range(150)]
    df = spark.createDataFrame([(x,) for x in rows], "z struct<n:int,chi:double,runs:double,serial:double,prose:double>")
    got = S.cutoffs(df, 0.01, 0.01)
    p = lambda z: 1 / (1 + math.exp(1.5976 * z + 0.07056 * z**3))
    for band, n in enumerate((22, 30, 50, 90)):
        of = [(math.floor(max(-10, min(20, x[4])) * 8) if x[1] == 0 else None) for x in rows if x[0] == n]
        bins = sorted({b for b in of if b is not None})
        passing = [b for b in bins if p(b / 8) * len(of) <= 0.01 * sum(c is not None and c >= b for c in of)]
        assert got.get(band) == (min(passing) if passing else None)


def test_estimated_reliabilities_follow_the_voters():
    """Votes drawn from known reliabilities: the probabilities tell the classes apart, a voter at random is not followed."""
    r = np.random.default_rng(5)
    counts: dict = {}
    right = wrong = 0
    truth: dict = {}
    for _ in range(4000):
        y = r.random() < 0.4
        vote = [(1 if y else -1) if r.random() < q else (-1 if y else 1) for q in (0.95, 0.9, 0.85)] + [int(r.choice([-1, 1])), 0]
        code = (1, *vote, 2, 2)
        counts[code] = counts.get(code, 0) + 1
        truth.setdefault(code, []).append(y)
    p = pii.estimate(counts)
    for code, ys in truth.items():
        right += sum((p[code] >= 0.5) == y for y in ys)
        wrong += sum((p[code] >= 0.5) != y for y in ys)
    assert right / (right + wrong) > 0.95
    flipped = [abs(p[c] - p[(*c[:4], -c[4], *c[5:])]) for c in counts if (*c[:4], -c[4], *c[5:]) in counts and counts[c] > 20]
    assert max(flipped) < 0.35


def test_added_spans_are_found(spark):
    """Planted names, national numbers, accounts, national phones and written-out addresses among plain prose."""
    r = random.Random(6)
    words = [w for w in "the house stands near river and people walk along quiet roads under old trees while rain falls on green hills".split()]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    accounts = ["DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "ES9121000418450200051332"]
    kinds = {
        "name": lambda i: ("Dear ", f"{r.choice(['Mr', 'Dr', 'Frau', 'Madame'])} {r.choice(['Miller', 'Schmidt', 'Durand', 'Garcia'])}"),
        "ssn": lambda i: ("social security number ", f"{100 + i % 500}-{10 + i % 89}-{1000 + i}"),
        "iban": lambda i: ("to account ", accounts[i % 4]),
        "phone": lambda i: ("call phone ", f"({200 + i % 700}) 555-{1000 + i}"),
        "email": lambda i: ("write mail to ", f"user{i} [at] site{i % 9} [dot] com"),
    }
    rows, want = [], {}
    for i in range(400):
        kind = list(kinds)[i % 5]
        lead, value = kinds[kind](i)
        before = prose(r.randrange(5, 60)) + " " + lead
        rows.append((i, before + value + ". " + prose(r.randrange(5, 40))))
        want[i] = f"{kind}:{len(before)}:{len(before) + len(value)}"
    rows += [(1000 + i, prose(80) + f" order no. {i}-{i}{i} page {i} version 1.{i}.3 " + prose(20)) for i in range(400)]
    got = {x.doc_id: x for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, kind in enumerate(kinds):
        mine = [i for i in want if i % 5 == k]
        recall = sum(want[i] in got[i].spans.split(",") for i in mine) / len(mine)
        assert recall >= 0.9, (kind, recall)
    assert sum(bool(got[1000 + i].n_added) for i in range(400)) <= 4
