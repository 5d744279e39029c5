"""Each query of the event engine against its SQL."""

import pytest

from almanac.catalogue import QUERIES, SQL


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, oracle, name):
    oracle(spark, name)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_slug_index_reads_what_it_needs(spark, tmp_path):
    """The slug index meets events by the columns that a slug needs, not by whole rows."""
    from almanac.operators import serve
    from almanac.sources.listing import listing

    events = listing(spark, "/root/testdata/sf0.001")
    kept = []
    whole, serve.first_by_slug = serve.first_by_slug, lambda e: kept.append(e.columns) or whole(e)
    try:
        serve.index_by_slug(events, str(tmp_path / "slugs"), 4)
    finally:
        serve.first_by_slug = whole
    assert sorted(kept[0]) == ["date", "id", "name", "town"]
