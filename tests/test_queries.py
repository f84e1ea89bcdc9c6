import pytest

from emberlog.plans import oracle, queries
from tests.oracle import connect, same

SQL = oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, sf, name):
    rows = same(queries.queries()[name](spark, sf), connect(sf), SQL[name])
    assert rows or name in ("events_disabled", "issue_seeded")


@pytest.mark.parametrize("hours", [0, 1, 30])
def test_late_windows_with_arrivals_of_one_seq(spark, sf, tmp_path, hours):
    """event_ids that come to one seq, as those of more than 100,003 events do."""
    again = "SELECT event_id + 100003 * k AS event_id, ts + to_minutes((k * {} * 60)::INTEGER) AS ts, user_id, event_type, value, props FROM events, range(3) r(k)"
    connect(sf).sql(again.format(hours)).write_parquet(str(tmp_path / "events.parquet"))
    assert same(queries.queries()["issue_window_count_late"](spark, str(tmp_path)), connect(tmp_path), SQL["issue_window_count_late"])


def test_late_triggers_with_equal_arrivals(spark, sf, tmp_path):
    """Arrivals of one seq are equal here, so the SQL's answer doesn't hang on the order that it leaves open."""
    connect(sf).sql("SELECT event_id + 100003 * k AS event_id, ts, user_id, event_type, value, props FROM events, range(3) r(k)").write_parquet(str(tmp_path / "events.parquet"))
    assert same(queries.queries()["issue_triggers_late"](spark, str(tmp_path)), connect(tmp_path), SQL["issue_triggers_late"])


def test_every_query_is_known(spark, sf):
    assert set(queries.queries()) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
