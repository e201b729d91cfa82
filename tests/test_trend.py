"""Moving averages against plain recurrences."""

import random
import time
from dataclasses import replace

import numpy as np
import pytest

from panelforge.operators import panel, trend
from small import by_key, small_panel

N = 9
SHOPS, ITEMS = (1, 2, 5), tuple(range(20, 33))
KEY = ("shop_id", "item_id", "date_block_num")


def recurrence(values, span):
    alpha, top, bottom, out = 2 / (span + 1), 0.0, 0.0, []
    for value in values:
        top, bottom = top * (1 - alpha) + value, bottom * (1 - alpha) + 1
        out.append(top / bottom)
    return out


@pytest.fixture(scope="module")
def filled(spark):
    rng = random.Random(3)
    rows = [
        (rng.randrange(N), rng.choice(SHOPS), rng.choice(ITEMS), rng.randrange(-3, 25), 1.0)
        for _ in range(400)
    ]
    pairs = [(s, ITEMS[0]) for s in SHOPS] + [(SHOPS[0], i) for i in ITEMS]
    return small_panel(spark, rows, pairs, N)


@pytest.fixture(scope="module")
def series(filled):
    cells = by_key(panel.monthly(filled[0]), *KEY)
    return {
        (s, i): [cells[(s, i, m)]["item_cnt"] for m in range(N)] for s in SHOPS for i in ITEMS
    }


def macds(values, spans=(4, 12, 26)):
    return [a - b for a, b in zip(recurrence(values, spans[0]), recurrence(values, spans[2]))]


def test_two_steps_by_hand(spark):
    one, _ = small_panel(spark, [(0, 1, 1, 1, 1.0), (1, 1, 1, 2, 1.0)], [(1, 1)], 2)
    got = by_key(trend.trend(one), "date_block_num")
    assert got[(1,)]["cnt_ema_s_prev"] == pytest.approx(1)
    assert got[(2,)]["cnt_ema_s_prev"] == pytest.approx(1.625)


def test_along_the_months(filled, series):
    got = by_key(trend.trend(filled[0]), *KEY)
    assert len(got) == N * len(SHOPS) * len(ITEMS)
    for (shop, item), values in series.items():
        expected = {
            "cnt_ema_s_prev": recurrence(values, 4),
            "cnt_ema_m_prev": recurrence(values, 12),
            "cnt_ema_l_prev": recurrence(values, 26),
            "cnt_macd_prev": macds(values),
            "cnt_sig_prev": recurrence(macds(values), 9),
        }
        for name, wanted in expected.items():
            mine = [got[(shop, item, m + 1)][name] for m in range(N)]
            assert mine == pytest.approx(wanted, abs=1e-12)


def test_constant_series_stays_constant(spark):
    one, _ = small_panel(spark, [(m, 1, 1, 7, 1.0) for m in range(34)], [(1, 1)], 34)
    for row in trend.trend(one).collect():
        assert row["cnt_ema_l_prev"] == pytest.approx(7)
        assert row["cnt_macd_prev"] == pytest.approx(0, abs=1e-12)


def test_any_number_of_months(filled, series):
    """Far beyond the reach of the weights of one running sum."""
    got = by_key(trend.trend(replace(filled[0], n_blocks=2000)), *KEY)
    for (shop, item), values in series.items():
        wanted = recurrence(values + [0.0] * (2000 - N), 4)
        mine = [got[(shop, item, m + 1)]["cnt_ema_s_prev"] for m in range(2000)]
        assert mine == pytest.approx(wanted, abs=1e-12)


@pytest.mark.parametrize("signal_span", [9, 200, 1.5])
@pytest.mark.parametrize("max_slice", [1, 4, 1024])
def test_down_the_pairs(filled, series, signal_span, max_slice):
    """Any cut of the pair order gives the same signal, also with weights that reach far."""
    got = by_key(
        trend.trend_pair_signal(*filled, signal_span=signal_span, max_slice=max_slice), *KEY
    )
    order = sorted(series)
    assert len(got) == N * len(order)
    columns = {pair: macds(series[pair]) for pair in order}
    for m in range(N):
        wanted = recurrence([columns[pair][m] for pair in order], signal_span)
        mine = [got[(*pair, m + 1)]["cnt_sig_prev"] for pair in order]
        assert mine == pytest.approx(wanted, abs=1e-10)


def test_down_the_pairs_with_ranked_ranges(filled):
    """The same in any number of ranges of the key lists."""
    few = trend.trend_pair_signal(*filled, max_slice=4)
    many = trend.trend_pair_signal(*filled, max_slice=4, rows_per_slice=1)
    a, b = by_key(few, *KEY), by_key(many, *KEY)
    assert a.keys() == b.keys()
    for key in a:
        assert a[key]["cnt_sig_prev"] == pytest.approx(b[key]["cnt_sig_prev"], abs=1e-12)


def test_cost_is_linear_in_the_months():
    """Time per value does not grow with the number of months."""

    def seconds(months, pairs):
        values = np.ones((months, pairs))
        start = time.perf_counter()
        trend._averages(values, (4, 12, 26))
        return time.perf_counter() - start

    seconds(80, 1000)
    short = min(seconds(80, 2500) for _ in range(5))
    assert min(seconds(2000, 2500) for _ in range(3)) < 2.5 * 25 * short


def test_scan_of_far_reaching_totals(spark):
    """Span 10,000 over a thousand slices: few copies of a total, equal to the recurrence."""
    n, q = 1000, trend.decay(10_000) ** 1024
    rng = random.Random(5)
    totals = {(s, m): rng.uniform(0, 9) for s in range(n) for m in range(3) if rng.random() < 0.3}
    df = spark.createDataFrame(
        [(s, m, v) for (s, m), v in totals.items()], f"_slice long, {panel.BLOCK} int, _total double"
    )
    found = trend.decayed_totals(df, q, n)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 10
    got = by_key(found, "_slice", panel.BLOCK)
    for m in range(3):
        state = 0.0
        for s in range(n):
            state = state * q + totals.get((s, m), 0.0)
            mine = got[(s, m)]["_total"] if (s, m) in got else 0.0
            assert mine == pytest.approx(state, rel=1e-12)
    assert max(s for s, _ in got) == n - 1


def test_pieces_may_end_anywhere(filled, monkeypatch):
    """A slice that is worked on in several pieces keeps its sums."""
    whole = by_key(trend.trend_pair_signal(*filled), *KEY)
    monkeypatch.setattr(trend, "PIECE_ROWS", 2 * N)
    assert by_key(trend.trend_pair_signal(*filled), *KEY) == whole
