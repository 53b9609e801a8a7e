"""What an event may know of its card's past, on a few events with results worked out by hand."""

from datetime import datetime, timedelta

import pytest

from cardlake.functions import events as E
from cardlake.operators import windows as W

T0 = datetime(2024, 3, 1, 12)
KINDS = "id long, card string, t timestamp_ntz, amount double, channel string, merchant_country string, merchant_city string, mcc int, errors string"


def rows(spark, *events):
    """Each event: seconds after T0, amount, city, error, card."""
    full = [(i, card, T0 + timedelta(seconds=at), amount, "chip", "US", city, 5411, error) for i, (at, amount, city, error, card) in enumerate(events)]
    return {r.id: r for r in E.feature_rows(spark.createDataFrame(full, KINDS).repartition(3), "card", "t", "id", ["id"]).collect()}


@pytest.fixture(params=[W.FRAME, 0], ids=["frames", "changes"], autouse=True)
def way(request, monkeypatch):
    trailing = W.trailing
    monkeypatch.setattr(W, "trailing", lambda *a, **k: trailing(*a, **{**k, "frame": request.param}))


def test_an_event_doesn_t_know_itself_or_what_follows(spark):
    got = rows(spark, (0, 10.0, "a", "", "x"), (10, 20.0, "b", "", "x"), (20, 30.0, "a", "", "x"))
    assert [(got[i].txn_count_1h, got[i].amount_sum_1h, got[i].distinct_merchant_city_1h) for i in range(3)] == [(0, 0.0, 0), (1, 10.0, 1), (2, 30.0, 2)]
    assert [got[i].amount_mean_1h for i in range(3)] == [0.0, 10.0, 15.0]


def test_old_events_leave(spark):
    got = rows(spark, (0, 10.0, "a", "", "x"), (7200, 5.0, "a", "", "x"))
    assert (got[1].txn_count_1h, got[1].txn_count_1d, got[1].amount_sum_1d) == (0, 1, 10.0)


def test_an_event_of_exactly_the_window_s_age_counts(spark):
    got = rows(spark, (0, 10.0, "a", "", "x"), (3600, 5.0, "a", "", "x"), (7200.000001, 5.0, "a", "", "x"))
    assert got[1].txn_count_1h == 1 and got[2].txn_count_1h == 0


def test_time_since_the_last_event(spark):
    got = rows(spark, (0, 1.0, "a", "", "x"), (300, 1.0, "a", "", "x"), (300 + 90 * 86_400, 1.0, "a", "", "x"))
    assert [got[i].time_since_last_txn_s for i in range(3)] == [2_592_000.0, 300.0, 2_592_000.0]
    assert got[2].txn_count_30d == 0 and got[2].is_new_city_30d == 1


def test_new_cities(spark):
    got = rows(spark, (0, 1.0, "a", "", "x"), (10, 1.0, "b", "", "x"), (20, 1.0, "a", "", "x"), (20 + 31 * 86_400, 1.0, "b", "", "x"))
    assert [got[i].is_new_city_30d for i in range(4)] == [1, 1, 0, 1]


def test_amount_over_the_mean(spark):
    got = rows(spark, (0, 10.0, "a", "", "x"), (10, 30.0, "a", "", "x"), (20, 40.0, "a", "", "x"))
    assert [got[i].amount_over_mean_30d for i in range(3)] == [10.0, 3.0, 2.0]


def test_cards_and_errors_are_apart(spark):
    got = rows(spark, (0, 1.0, "a", "Bad PIN", "x"), (5, 2.0, "a", "", "y"), (10, 3.0, "a", None, "x"), (20, 4.0, "a", "", "x"))
    assert [(got[i].txn_count_1h, got[i].decline_rate_1h, got[i].has_error) for i in range(4)] == [(0, 0.0, 1), (0, 0.0, 0), (1, 1.0, 0), (2, 0.5, 0)]


def test_peers_of_an_instant_in_their_order(spark):
    got = rows(spark, (0, 1.0, "a", "", "x"), (0, 2.0, "b", "", "x"), (0, 4.0, "a", "", "x"))
    assert [(got[i].txn_count_1h, got[i].amount_sum_1h, got[i].distinct_merchant_city_1h, got[i].is_new_city_30d) for i in range(3)] == [(0, 0.0, 0, 1), (1, 1.0, 1, 1), (2, 3.0, 2, 0)]
