"""Two books' totals: what the steps leave on disk, and the prices they give."""

import glob
from datetime import datetime

from fairline.plans import catalog_stored

_COLUMNS = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz"
)


def _folder(spark, path):
    rows = [
        (1, 5, 0, 1, 20.0, "N", datetime(1995, 1, 1)), (1, 5, 0, 3, 30.0, "N", datetime(1995, 1, 2)),  # book-0's over of 2.5: the later one counts
        (1, 5, 1, 1, 40.0, "N", datetime(1994, 1, 1)),                                                # book-1's
        (1, 5, 1, 2, 10.0, "N", datetime(1995, 1, 1)), (1, 5, 2, 2, 50.0, "R", datetime(1995, 1, 1)),  # under, and one without a price
        (1, 4, 2, 1, 10.0, "N", datetime(1995, 1, 1)),                                                # no line: no identity
        (2, 5, 3, 2, 15.0, "A", datetime(1995, 1, 1)), (2, 5, 3, 2, 15.0, "A", datetime(1995, 1, 1)),  # a row that comes twice
    ]
    spark.createDataFrame(rows, _COLUMNS).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_prices_of_two_books(spark, tmp_path):
    got = {
        (r.event_id, float(r.line), r.selection_type): (float(r.best_odds), r.best_book, float(r.price_spread), r.n_books)
        for r in catalog_stored.two_book_prices(spark, _folder(spark, tmp_path)).collect()
    }
    assert got == {
        ("1", 2.5, "over"): (5.0, "book-1", 1.0, 2), ("1", 2.5, "under"): (2.0, "book-1", 0.0, 1), ("2", 2.5, "under"): (2.5, "book-1", 0.0, 1),
    }


def test_only_the_last_step_stays_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog_stored, "new_folder", lambda spark, name: f"{tmp_path}/{name}")
    rows = catalog_stored._shared_totals(spark, _folder(spark, tmp_path))
    assert [x.rsplit("/", 1)[1] for x in glob.glob(f"{tmp_path}/shared-totals/*")] == ["matched"]
    assert dict(rows.dtypes)["market_id"] == dict(rows.dtypes)["canonical_id"] == "binary"
    assert spark.conf.get(catalog_stored._FREED, "false") == "false"
