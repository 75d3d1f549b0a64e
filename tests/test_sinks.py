"""Sinks under repetition and failure, lookups by text, tolerance reads."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vintage.operators import lookup, timeline
from vintage.sources import sinks
from vintage.sources.stored import shared_folder

ROWS = "k long, day date, v double, note string"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_snapshots_append_once(spark):
    path = shared_folder(spark, "test")
    first, second = frame(spark, [(1, day(0), 1.0, None), (1, day(0), 1.0, None), (2, day(1), None, "x")]), frame(spark, [(3, None, 5.0, "y")])
    assert sinks.append_snapshot(first, path, "a") and sinks.append_snapshot(second, path, "b")
    assert not sinks.append_snapshot(second, path, "b")  # a batch that runs again
    got = sinks.read_snapshots(spark, path, ROWS)
    assert sorted((r.k, r.batch) for r in got.collect()) == [(1, "a"), (1, "a"), (2, "a"), (3, "b")]
    m = {r.batch: r for r in sinks.manifest(spark, path).collect()}
    assert m["a"].rows == 3 and m["a"].missing_pct == pytest.approx(3 / 12 * 100) and m["a"].dataset_hash != m["b"].dataset_hash
    other = shared_folder(spark, "test")
    sinks.append_snapshot(first.orderBy(F.desc("k")).repartition(3), other, "a")
    assert sinks.manifest(spark, other).first().dataset_hash == m["a"].dataset_hash  # whatever the order of rows


def test_data_without_a_commit_are_not_read(spark, monkeypatch):
    path = shared_folder(spark, "test")
    rows = frame(spark, [(1, day(0), 1.0, None)])

    def fail(*_):
        raise RuntimeError("the driver is lost before it commits")

    with monkeypatch.context() as m:
        m.setattr(sinks, "_commit", fail)
        with pytest.raises(RuntimeError):
            sinks.append_snapshot(rows, path, "a")
        with pytest.raises(RuntimeError):
            sinks.merge(rows, path + "-merged", "a", ["k"], ["day"], buckets=2)
    assert sinks.read_snapshots(spark, path, ROWS).isEmpty() and sinks.read_merged(spark, path + "-merged", rows.schema).isEmpty()
    assert sinks.append_snapshot(rows, path, "a") and sinks.read_snapshots(spark, path, ROWS).count() == 1
    assert sinks.merge(rows, path + "-merged", "a", ["k"], ["day"], buckets=2) and sinks.read_merged(spark, path + "-merged", rows.schema).count() == 1


def test_merge_keeps_the_newest_row_of_a_key(spark):
    path = shared_folder(spark, "test")
    first = frame(spark, [(k, day(5), float(k), "old") for k in range(40)])
    assert sinks.merge(first, path, "1", ["k"], ["day"], buckets=4)
    change = frame(spark, [(3, day(6), 30.0, "newer"), (4, day(4), 40.0, "older"), (5, day(5), 50.0, "equal"), (99, day(0), 99.0, "new"), (98, day(1), 1.0, "a"), (98, day(2), 2.0, "b")])
    assert sinks.merge(change, path, "2", ["k"], ["day"], buckets=4) and not sinks.merge(change, path, "2", ["k"], ["day"], buckets=4)
    got = {r.k: r.note for r in sinks.read_merged(spark, path, first.schema).collect()}
    assert len(got) == 42 and (got[3], got[4], got[5], got[99], got[98]) == ("newer", "old", "equal", "new", "b")
    one = frame(spark, [(7, day(9), 0.0, "touched")])
    sinks.merge(one, path, "3", ["k"], ["day"], buckets=4)
    held = sinks.manifest(spark, path).orderBy(F.desc("version")).first().buckets
    assert sum(f.startswith("data/3-") for f in held.values()) == 1  # one bucket is written anew, the others stay where they were
    assert {r.k: r.note for r in sinks.read_merged(spark, path, first.schema).collect()} == got | {7: "touched"}


def test_locked_rows_are_refused(spark):
    path = shared_folder(spark, "test")
    rows = frame(spark, [(1, dt.date(2025, 5, 5), 1.0, None)])
    for write in (lambda: sinks.append_snapshot(rows, path, "a", locked="day"), lambda: sinks.merge(rows, path, "a", ["k"], ["day"], locked="day")):
        with pytest.raises(PermissionError):
            write()
    assert sinks.manifest(spark, path).isEmpty()


def test_predictions_meet_their_first_outcome(spark):
    p = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "prediction_id string, price double")
    o = spark.createDataFrame([("a", day(3), 9.0), ("a", day(2), 8.0), ("z", day(1), 7.0)], "prediction_id string, resolved_at date, exit double")
    got = {r.prediction_id: (r.status, r.exit) for r in sinks.reconcile_predictions(p, o).collect()}
    assert got == {"a": ("RESOLVED", 8.0), "b": ("PENDING", None)} and [r.prediction_id for r in sinks.orphans(p, o).collect()] == ["z"]


def test_first_contained_equals_brute_force(spark):
    keys = [(0, "auto"), (1, "it"), (2, "Auto parts"), (3, "a"), (4, None), (5, ""), (2, "auto"), (6, "ü"), (7, "x y")]
    texts = ["Auto parts", " AUTO PARTS ", "furniture", "b", None, "", "Müll", "mix y", "zzz", "auto", "line\nauto"]
    dim = spark.createDataFrame([(*k, f"row{i}") for i, k in enumerate(keys)], "place int, word string, label string")
    facts = spark.createDataFrame(list(enumerate(texts)) + [(50, "auto")], "id int, text string")
    for equal_first in (True, False):
        want = {}
        for i, t in [*enumerate(texts), (50, "auto")]:
            t = (t or "").strip().upper() if t is not None else None
            hits = [((t != k.upper()) if equal_first else 0, p, k.upper(), f"row{n}") for n, (p, k) in enumerate(keys) if k and t is not None and k.upper() in t]
            want[i] = min(hits)[3] if hits else None
        got = {r.id: r.label for r in lookup.first_contained(facts, "text", dim, "word", "place", equal_first).collect()}
        assert got == want
    assert {r.label for r in lookup.first_contained(facts, "text", dim.limit(0), "word", "place").collect()} == {None}


@pytest.mark.parametrize("few", [0, 200, 10_000])
def test_first_contained_with_any_number_of_keys_equals_brute_force(spark, monkeypatch, few):
    """Keys that go to every text, and keys that are met by their pieces; copies of a text, keys of one letter and of many."""
    monkeypatch.setattr(lookup, "FEW", few)
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abü ") for _ in range(n))
    keys = [(draw.randrange(40), word(draw.choice([0, 1, 3, 4, 5, 6, 9]))) for _ in range(300)] + [(1, None), (None, "aabb"), (99, "ab"), (0, "zz")]
    texts = [None, "", "c", "zz", *(word(draw.choice([1, 2, 4, 8, 30])) for _ in range(120))]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    keys = [(p, k, f"row {p} {(k or '').strip()}") for p, k in keys]
    dim, facts = spark.createDataFrame(keys, "place int, word string, label string"), spark.createDataFrame(rows, "id int, text string")
    cleaned = [(-1 if p is None else p, k.strip().upper(), label) for p, k, label in keys if k and k.strip()]
    for equal_first in (True, False):
        want = {}
        for i, t in rows:
            t = None if t is None else t.strip().upper()
            want[i] = min(((equal_first and t != k, p, k, label) for p, k, label in cleaned if t is not None and k in t), default=[None])[-1]
        got = lookup.first_contained(facts, "text", dim, "word", "place", equal_first).collect()
        assert len(got) == len(rows) and {r.id: r.label for r in got} == want


def test_texts_stay_where_they_are_when_keys_are_few(spark):
    """Whole documents were shuffled four times and cut into all their pieces to meet ten keys."""
    plan = entry.queries()["J16_theme_of_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "regexp_extract_all" not in plan


def test_nearest_within_a_tolerance(spark):
    known = spark.createDataFrame([("A", day(0), 1.0), ("A", day(10), 2.0), ("A", day(20), 3.0), ("B", day(5), 9.0), ("A", None, 7.0)], "company_id string, at date, v double")
    wanted = spark.createDataFrame([("A", day(n)) for n in (-3, 0, 4, 5, 6, 15, 27, 99)] + [("B", day(5)), ("C", day(5))], "company_id string, want date")

    def brute(days, preceding):
        out = {}
        for c, w in [tuple(r) for r in wanted.collect()]:
            near = sorted((abs((a - w).days), a) for k, a, _ in [("A", day(0), 1), ("A", day(10), 2), ("A", day(20), 3), ("B", day(5), 9)] if k == c and abs((a - w).days) <= days and (a <= w or not preceding))
            out[c, w] = near[0][1] if near else None
        return out

    for days, preceding in ((0, True), (5, True), (5, False), (8, False), (100, True)):
        got = {(r.company_id, r.want): r.found for r in timeline.nearest_within(wanted, known, "want", "at", days, preceding).collect()}
        assert got == brute(days, preceding), (days, preceding)


def test_carried_periods_are_what_was_known(spark):
    """Late, missing and restated periods: a restatement of an old period never replaces a newer one."""
    rows = [("A", day(91 * q), "QUARTERLY", day(91 * q + 45), 0, float(q)) for q in range(14) if q != 9]
    rows += [("A", day(91 * 9), "QUARTERLY", day(91 * 12 + 50), 0, 9.0), ("A", day(91 * 2), "QUARTERLY", day(91 * 11), 1, 2.5), ("A", day(91 * 10), "QUARTERLY", day(91 * 11 + 46), 1, 10.5), ("A", day(0), "ANNUAL", day(1), 0, -1.0)]
    st = spark.createDataFrame(rows, "company_id string, period_end date, period_type string, published date, vintage int, v double")
    dates = spark.createDataFrame([("A", day(n)) for n in (0, 44, 45, 500, 91 * 11 + 45, 91 * 11 + 46, 91 * 12 + 50, 5000)] + [("B", day(99))], "company_id string, t0 date")
    got = {(r.company_id, r.t0): [p.v for p in r.periods or []] for r in timeline.carried_periods(st, dates, "QUARTERLY", 6).collect()}
    for c, t in [tuple(r) for r in dates.collect()]:
        best = {}
        for k, end, kind, pub, vin, v in sorted(rows, key=lambda r: (r[3], r[4])):
            if k == c and kind == "QUARTERLY" and pub <= t:
                best[end] = v
        assert got[c, t] == [best[e] for e in sorted(best, reverse=True)][:6], (c, t)
