"""Decision ledgers: latest decision, history, refused updates, and which files an update rewrites."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest

from veldspar.contracts import ContractError
from veldspar.operators import ledger as L

SMALL = replace(L.PROFILING, buckets=8)


def _decisions(spark, rows):
    return spark.createDataFrame([(k, d, "me", "2025-01-01", "") for k, d in rows], "review_item_id string, decision string, reviewer string, reviewed_at string, reviewer_comment string")


def test_latest_and_history_are_brute_force(spark, tmp_path):
    rng, book, want, told = random.Random(5), L.Ledger(spark, str(tmp_path), SMALL), {}, []
    assert book.latest().count() == book.history().count() == 0
    for update in range(1, 4):
        rows = [(f"k{i}", rng.choice(["approved", "rejected", "", "approved_with_conditions"])) for i in sorted(rng.sample(range(40), 15))]
        assert book.append(_decisions(spark, rows)) == update
        want |= dict(rows)
        told += [(k, d, update) for k, d in rows]
    plain = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert plain(book.latest(), "review_item_id", "decision") == sorted(want.items())
    assert plain(book.history(), "review_item_id", "decision", "update") == sorted(told)
    before = plain(book.latest(), "review_item_id", "decision", "update")
    book.rebuild()
    assert plain(book.latest(), "review_item_id", "decision", "update") == before


def test_an_update_rewrites_the_partitions_it_touches(spark, tmp_path):
    book = L.Ledger(spark, str(tmp_path), SMALL)
    book.append(_decisions(spark, [(f"k{i}", "approved") for i in range(60)]))
    files = lambda: {p.parent.name: {f.name for f in p.parent.glob("*.parquet")} for p in tmp_path.glob("current/bucket=*/*.parquet")}
    first = files()
    assert len(first) == 8
    book.append(_decisions(spark, [("k7", "rejected")]))
    second = files()
    assert sum(first[b] != second[b] for b in first) == 1 and book.latest().count() == 60
    assert book.latest().filter("review_item_id = 'k7'").first().decision == "rejected"


@pytest.mark.parametrize(("rows", "message"), [([("a", "maybe")], "unknown decisions"), ([("a", "approved"), ("a", "rejected")], "keys that repeat")])
def test_refused_updates_leave_no_trace(spark, tmp_path, rows, message):
    book = L.Ledger(spark, str(tmp_path), SMALL)
    book.append(_decisions(spark, [("a", "rejected")]))
    with pytest.raises(ContractError, match=message):
        book.append(_decisions(spark, rows))
    assert book.history().count() == 1 and book.latest().first().decision == "rejected"


def test_approvals_are_signed(spark, tmp_path):
    book = L.Ledger(spark, str(tmp_path / "l"), SMALL)
    one = _decisions(spark, [("a", "approved")]).replace("me", "")
    with pytest.raises(ContractError, match="without reviewer"):
        book.append(one)
    book.append(one.replace("approved", "rejected"))
    (tmp_path / "d.csv").write_text("review_item_id,decision,reviewer,reviewed_at,reviewer_comment\nb,approved,me,2025-02-01,fine\n")
    assert book.load(str(tmp_path / "d.csv")) == 2 and book.latest().count() == 2
    with pytest.raises(ContractError, match="missing columns"):
        book.append(one.drop("reviewer"))


def test_quality_ledger_feeds_the_star(spark, tmp_path):
    book = L.Ledger(spark, str(tmp_path), replace(L.QUALITY, buckets=4))
    rows = [("2025-H1", "w", "s", str(i), "2", "flag", "source_value_confirmed", "me", "2025-01-01", "") for i in range(5)]
    book.append(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in L.QUALITY.all)))
    assert book.latest().filter("quality_review_status = 'source_value_confirmed'").count() == 5
