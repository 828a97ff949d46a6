import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmnet.functions.industry_codes import naics_match_len, pad_naics
from firmnet.operators import industry, peers, regression
from firmnet.schemas import DIGITS, LR_INPUT, METRICS, PEER


def edges(spark, rows):
    return spark.createDataFrame(rows, PEER)


def metrics(spark, rows):
    return spark.createDataFrame([(i, *v) for i, v in rows], "firm_id bigint, " + ", ".join(f"{m} double" for m in METRICS))


def test_regression_input(spark):
    every = edges(spark, [(1, 2, 0.9), (1, 3, 0.8), (2, 1, 0.9), (3, 1, 0.1), (4, 99, 0.9)])
    kept = every.where("wtnic_score > 0.5")
    m = metrics(spark, [(1, (1.0, 2.0, 3.0, 4.0)), (2, (10.0, 20.0, 30.0, None)), (3, (30.0, 40.0, 50.0, 60.0)),
                        (4, (0.0,) * 4), (5, (7.0,) * 4)])
    got = {r["focal_firmid"]: tuple(r)[1:] for r in peers.lr_input(every, kept, m).collect()}
    assert peers.lr_input(every, kept, m).columns == LR_INPUT.names
    assert got[1] == (20.0, 30.0, 40.0, 60.0, 1.0, 2.0, 3.0, 4.0, 0)   # a NULL metric does not enter the mean
    assert got[2] == (1.0, 2.0, 3.0, 4.0, 10.0, 20.0, 30.0, None, 0)
    assert got[3] == (0.0, 0.0, 0.0, 0.0, 30.0, 40.0, 50.0, 60.0, 1)   # lost all its edges
    assert 5 not in got and 4 not in got                               # not in the peers; rival unknown
    assert [tuple(r)[:2] for r in peers.unknown_rivals(kept, m).collect()] == [(99, 4)]
    assert {tuple(r) for r in peers.focal_counts(every, kept, peers.lr_input(every, kept, m)).collect()} == {
        ("before_cut", 4), ("after_cut", 3), ("regression", 3)}


def lr_frame(spark, x, y, flag):
    rows = []
    for i in range(len(x)):
        num = lambda v: None if v is None else float(v)
        rows.append((i, *([num(x[i])] * 4), *([num(y[i])] * 4), int(flag[i])))
    return spark.createDataFrame(rows, LR_INPUT)


def numpy_r2(x, y, flag):
    keep = [i for i in range(len(x)) if x[i] is not None and y[i] is not None]
    x, y, flag = (np.array([v[i] for i in keep], float) for v in (x, y, flag))
    if np.ptp(y) == 0:
        return 1.0
    center = lambda v: v - v.mean() if np.ptp(v) else np.zeros(len(v))
    a = np.column_stack([center(x) / (np.ptp(x) or 1), center(flag)])
    y = center(y) / np.ptp(y)
    return 1 - ((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum() / (y**2).sum()


R = np.random.default_rng(5)
X, Y = R.normal(size=60), R.normal(size=60)
FLAG = (R.uniform(size=60) < 0.2).astype(int)


@pytest.mark.parametrize("x, y, flag", [
    (np.where(FLAG == 1, 0.0, X), X + Y, FLAG),
    (X, X + Y, np.zeros(60, int)),                     # no monopolist
    (np.full(60, 3.7), Y, FLAG),                       # one distinct rival value
    (np.full(60, 3.7), Y, np.zeros(60, int)),
    (X, np.full(60, 0.1), FLAG),                       # all-equal target
    (FLAG * 2.5 + 1, Y, FLAG),                         # the flag repeats the other predictor
    ([None, *X[1:]], [Y[0], None, *Y[2:]], FLAG),      # missing values
    (X * 1e9 + 1e12, Y * 1e-6, FLAG),
])
def test_r_squared_equals_least_squares(spark, x, y, flag):
    row = regression.r_squared(lr_frame(spark, list(x), list(y), list(flag))).first()
    assert row["RSQ_valuation"] == pytest.approx(numpy_r2(list(x), list(y), list(flag)), abs=1e-8)
    assert row["RSQ_average"] == pytest.approx((row["RSQ_profit_sales"] + row["RSQ_profit_asset"]) / 2)


def test_sales_are_reported_as_sales(spark):
    df = lr_frame(spark, list(X), list(X + Y), [0] * 60).withColumn("focal_profit_assets", F.col("rival_profit_assets"))
    row = regression.r2_report(df, "a.b_file.csv").first()
    assert row["RSQ_profit_asset"] == pytest.approx(1) and row["RSQ_profit_sales"] < 0.99
    assert row["similarity"] == "AB" and row["no_of_docs"] == "60"
    assert list(row.asDict()) == ["no_of_docs", "input_file_name", "date_run", "similarity", "type", "pruned_words_cutoff",
                                  "WTNIC_Score_Cutoff", "RSQ_average", "RSQ_stock_return", "RSQ_profit_sales",
                                  "RSQ_profit_asset", "RSQ_valuation"]


def test_r_squared_by_year(spark):
    df = lr_frame(spark, list(X), list(X + Y), list(FLAG)).withColumn("year", (F.col("focal_firmid") % 2).cast("int"))
    both = {r["year"]: r for r in regression.r_squared(df, ["year"]).collect()}
    assert both[0]["RSQ_valuation"] == pytest.approx(numpy_r2(X[::2], (X + Y)[::2], FLAG[::2]), abs=1e-9)


@pytest.mark.parametrize("a, b, want", [
    ("123456", "123456", 6), ("123456", "123457", 5), ("123456", "129999", 2), ("123456", "199999", 0),
    ("1234", "1234", 6), ("1234", "123456", 4), ("12", "123456", 2), ("1", "1", 6), (None, "1", None)])
def test_match_len(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(naics_match_len(F.col("a"), F.col("b"))).first()[0] == want


def test_pad(spark):
    df = spark.createDataFrame([("1234",), ("123456",), ("1234567",), (None,)], "c string")
    assert [r[0] for r in df.select(pad_naics(F.col("c"))).collect()] == ["001234", "123456", "1234567", None]


def test_frequencies(spark):
    firm = spark.createDataFrame([("a.com", "1234"), ("b.com", "123456"), ("c.com", "123499"), ("d.com", ""), ("e.com", "123456")],
                                 "company string, naics string")
    listed = spark.createDataFrame([(c,) for c in ("www.a.com", "b.com", "c.com_x", "d.com", "e.com", "zz.com")], "company string")
    codes = industry.entity_codes(listed, firm)
    freq = {(r[0], r[1]): r[2] for r in industry.prefix_frequency(codes).collect()}
    assert freq[2, "00"] == 1 and freq[2, "12"] == 3 and freq[4, "1234"] == 3 and freq[6, "123456"] == 2
    required = {r[0]: r[1] for r in industry.required_pairs(industry.prefix_frequency(codes)).collect()}
    assert required == {2: 6, 3: 6, 4: 6, 5: 2, 6: 2}
    assert codes.count() == 6
    assert all(r["consistent"] and r["coded"] == 4 for r in industry.frequency_check(industry.prefix_frequency(codes), codes).collect())


def loop(pairs, budgets, mode):
    """The budgeted scan one pair at a time."""
    left, found, high, both = dict(budgets), {d: 0 for d in DIGITS}, max(budgets.values()), 0
    for score, f, r, n, missing in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if mode == "all_pairs":
            for d in DIGITS:
                if left[d] > 0:
                    left[d] -= 1
                    found[d] += n >= d
            continue
        if high == 0:
            break
        if missing:
            high -= 1
            left = {d: max(0, v - 1) for d, v in left.items()}
            continue
        both += 1
        for d in DIGITS:
            if n >= d and left[d] > 0:
                left[d] -= 1
                found[d] += 1
    return found, both


@pytest.mark.parametrize("mode", ["reference", "all_pairs"])
@pytest.mark.parametrize("seed", range(6))
def test_budgeted_matches_equal_the_scan(spark, seed, mode):
    r = random.Random(seed)
    pairs = []
    for i in range(400):
        missing = r.random() < 0.15
        score = 0.5 if r.random() < 0.4 else round(r.uniform(0.24, 1), 2)
        pairs.append((score, i % 20, i, 0 if missing else r.choice([0, 2, 3, 4, 5, 6]), missing))
    budgets = {d: r.choice([0, 1, 13, 60, 200, 1000]) for d in DIGITS}
    df = spark.createDataFrame(pairs, "wtnic_score double, focal_firmid int, rival_firmid int, match_len int, missing boolean")
    want, both = loop(pairs, budgets, mode)
    assert industry.budgeted_matches(df, budgets, mode) == want
    if mode == "reference":
        assert industry.pairs_with_both_codes(df, budgets) == both


def test_report_without_same_industry_pairs(spark):
    codes = spark.createDataFrame([("a", "111111"), ("b", "222222"), ("c", None)], "company string, naics string")
    coded = spark.createDataFrame([(1, 2, 0.9, 0, False)],
                                  "focal_firmid bigint, rival_firmid bigint, wtnic_score double, match_len int, missing boolean")
    rows = industry.naics_report(2000, coded, codes).collect()
    assert [(r["digits"], r["total_firms"], r["required"], r["budget"], r["similarity"]) for r in rows] == [
        (d, 3, 0, 0, None) for d in DIGITS]


def test_reports_from_tiles_equal_reports_from_pairs(spark, monkeypatch):
    """Counting pairs where they are multiplied gives what stored pairs give, also where most scores are equal, and stores no pair."""
    import numpy as np

    from firmnet.operators import rank, similarity

    draw = np.random.default_rng(4)
    m = np.concatenate([np.ones((40, 3)), draw.integers(-1, 2, (70, 3))]).astype(float)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "firm_id bigint, v array<double>")
    pool = ["111111", "111122", "1111", "222222", "22", "", None]
    codes = spark.createDataFrame([(i, pool[draw.integers(len(pool))]) for i in range(100)], "firm_id bigint, naics string")
    stored, real = [], similarity.materialize

    def counted(df, label):
        stored.append(real(df, label))
        return stored[-1]

    pairs = industry.with_pair_codes(similarity.cosine_pairs(vectors, min_score=0.2), codes).cache()
    want = {}
    for k in (1, 7, 300, 1500, 3000, 10**6):
        budgets = {d: k * d // 2 for d in DIGITS}
        want[k] = [industry.budgeted_matches(pairs, budgets, mode) for mode in ("reference", "all_pairs")], industry.pairs_with_both_codes(pairs, budgets)
    monkeypatch.setattr(similarity, "materialize", counted)
    monkeypatch.setattr(rank, "materialize", counted)
    tiles = industry.pairs_by_codes(vectors, codes, 0.2, block_rows=30)
    for k, (matches, both) in want.items():
        budgets = {d: k * d // 2 for d in DIGITS}
        assert [industry.budgeted_matches(tiles, budgets, mode) for mode in ("reference", "all_pairs")] == matches
        assert industry.pairs_with_both_codes(tiles, budgets) == both
    assert pairs.count() > 2500 > max(t.count() for t in stored)


def test_a_report_with_both_codes_multiplies_the_pairs_twice(spark, monkeypatch):
    """Once to count scores, once for the ties at all cuts; the firms that the cuts fall into are not sent to tiles again."""
    from firmnet.operators import similarity

    draw = np.random.default_rng(12)
    m = np.concatenate([np.ones((40, 3)), draw.integers(-1, 2, (70, 3))]).astype(float)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "firm_id bigint, v array<double>")
    pool = ["111111", "111122", "1111", "222222", "22", "", None]
    codes = spark.createDataFrame([(i, pool[draw.integers(len(pool))]) for i in range(110)], "firm_id bigint, naics string")
    listed = codes.select(F.col("firm_id").cast("string").alias("company"), F.nullif("naics", F.lit("")).alias("naics"))
    pairs = industry.with_pair_codes(similarity.cosine_pairs(vectors, min_score=0.2), codes).cache()
    passes, real = [], similarity._multiplied
    for mode in ("reference", "all_pairs"):
        want = industry.naics_report(2000, pairs, listed, 0.1, mode, True).collect()
        monkeypatch.setattr(similarity, "_multiplied", lambda *x, **y: passes.append(1) or real(*x, **y))
        passes.clear()
        assert industry.naics_report(2000, industry.pairs_by_codes(vectors, codes, 0.2, block_rows=30), listed, 0.1, mode, True).collect() == want
        assert len(passes) == 2, mode
        monkeypatch.setattr(similarity, "_multiplied", real)
