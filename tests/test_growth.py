"""What only shows on larger tables: values, times and plans that they lead to, on small ones."""

import datetime

import pytest

from bindery.operators import walk
from bindery.plans import catalogue, tables  # noqa: F401  tables registers queries of its own
from bindery.storage import shared_dir
from bindery.streaming import settling


def against_sql(spark, folder, name, **given):
    """A query's rows over these tables, which are those of its SQL."""
    con = pytest.importorskip("duckdb").connect()
    for table, rows in given.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    found = catalogue.QUERIES[name](spark, str(folder))
    ours = sorted(repr(tuple(r)) for r in found.collect())
    assert ours == sorted(repr(r) for r in con.sql(f"select {', '.join(found.columns)} from ({catalogue.ORACLES[name]})").fetchall())
    return found


def parts(spark, n=60):
    return spark.range(n).selectExpr("id AS p_partkey", "concat('red bolt', id % 4) AS p_name", "concat('Brand#', id % 7) AS p_brand", "'SMALL' AS p_type", "cast(id % 50 + 1 AS int) AS p_size", "900.0D AS p_retailprice")


def test_edits_go_with_their_books(spark, tmp_path):
    found = against_sql(spark, tmp_path, "epub_rewrite", part=parts(spark))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_holds_know_days_beyond_2262(spark):
    at = lambda *when: datetime.datetime(*when, tzinfo=datetime.timezone.utc)
    told = [("a", at(2400, 1, 1, 1), True), ("a", at(2400, 1, 1, 23, 59, 59, 999999), False), ("a", at(2400, 1, 2), False), ("b", at(1969, 12, 31, 23), True), ("b", at(1970, 1, 1), True)]
    folder, out = shared_dir(spark, "attempts"), shared_dir(spark, "made")
    rows = spark.createDataFrame(told, "path string, at timestamp, failed boolean")
    rows.write.parquet(folder)
    zone = spark.conf.get("spark.sql.session.timeZone")
    # The day is UTC's in any session.
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stream = settling.hold_until_tomorrow(spark.readStream.schema(rows.schema).parquet(folder))
        settling.drain(stream, shared_dir(spark, "progress"), lambda batch, n: batch.write.mode("append").parquet(out))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    made = spark.read.parquet(out)
    assert made.exceptAll(rows.filter("at <> timestamp '2400-01-01 23:59:59.999999'")).isEmpty() and made.count() == 4


def test_a_lookup_orders_no_rows_of_books(spark, tmp_path):
    found = against_sql(spark, tmp_path, "title_lookup", part=parts(spark, 200))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Each question's records are ranked below the join that gives them to its books.
    assert plan.index("Join") < plan.index("Window")


def test_a_lookup_ranks_the_records_of_all_titles(spark):
    title = "Cragside: A DCI Ryan Mystery"
    books = spark.createDataFrame([(1, title, "en"), (2, title, "en"), (3, None, "en"), (4, "Cragside", None)], "book_id long, title string, language string")
    works = spark.createDataFrame([(title, "en", "eng", 0), ("Cragside", "en", "eng", 1), ("Cragside", "de", "deu", 2), ("Cragside", "en", "eng", 1)], "work_title string, code2 string, code3 string, record_pos long")
    found = sorted(tuple(r) for r in walk.title_lookup(books, works).select("book_id", "work_title", "pos").collect())
    assert found == [(1, "Cragside", 1), (1, title, 0), (2, "Cragside", 1), (2, title, 0), (4, "Cragside", 0), (4, "Cragside", 1)]


def test_confidences_are_rounded_as_sql_rounds_them(spark, tmp_path):
    told = [(0, 1, "view", 285.0), (2, 1, "purchase", 284.0), (4, 2, "view", 145.0), (5, 2, "click", 140.0), (7, 3, "click", 1005.0), (8, 3, "view", 1001.0)]
    events = spark.createDataFrame(told, "event_id long, user_id long, event_type string, value double")
    against_sql(spark, tmp_path, "match_best_wins", events=events)


def test_a_pass_broadcasts_no_table_of_books(spark, tmp_path):
    told = spark._jsparkSession.sharedState().statusStore()
    before = told.executionsCount()
    against_sql(spark, tmp_path, "correction_pass", part=parts(spark, 24))
    ran = [told.executionsList(before, 1000).apply(n) for n in range(told.executionsList(before, 1000).size())]
    plans = [told.planGraph(e.executionId()).allNodes() for e in ran]
    joins = [nodes.apply(n).desc() for nodes in plans for n in range(nodes.size()) if nodes.apply(n).name().endswith("Join")]
    # Lists of genres are short; a book's rows meet by these.
    by_book = [j for j in joins if "[book_id#" in j or "[path#" in j]
    assert by_book and not [j for j in by_book if j.startswith("Broadcast")]
