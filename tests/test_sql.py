"""QUALIFY, MERGE and annotated blocks as SQL text."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators.merge import AmbiguousMergeError
from millrace.sql import blocks, merge_sql, parse_merge, rewrite_qualify, run_blocks, sql

SALES = [("North", "Ana", 100), ("North", "Ben", 90), ("North", "Cy", 60), ("South", "Dee", 200), ("South", "Eli", 50)]


@pytest.fixture
def sales(spark):
    spark.createDataFrame(SALES, "region string, rep string, amount int").createOrReplaceTempView("sales")
    return spark


def names(df):
    return [r.rep for r in df.collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT region, rep, amount FROM sales QUALIFY ROW_NUMBER() OVER (PARTITION BY region ORDER BY amount DESC) = 1 ORDER BY rep;", ["Ana", "Dee"]),
        ("SELECT rep FROM sales QUALIFY amount > AVG(amount) OVER (PARTITION BY region) -- QUALIFY\n ORDER BY rep", ["Ana", "Ben", "Dee"]),
        ("SELECT rep, 'QUALIFY' AS q FROM sales WHERE amount < 200 QUALIFY RANK() OVER w = 1 WINDOW w AS (PARTITION BY region ORDER BY amount DESC) ORDER BY rep", ["Ana", "Eli"]),
        ("WITH best AS (SELECT * FROM sales QUALIFY ROW_NUMBER() OVER (PARTITION BY region ORDER BY amount) = 1) SELECT rep FROM best ORDER BY rep LIMIT 1", ["Cy"]),
        ("SELECT region AS rep, SUM(amount) AS n FROM sales GROUP BY region QUALIFY RANK() OVER (ORDER BY SUM(amount) DESC) = 1", ["North", "South"]),
        ("SELECT rep FROM sales QUALIFY ROW_NUMBER() OVER (ORDER BY amount) = 1 UNION ALL SELECT rep FROM sales WHERE amount = 200", ["Eli", "Dee"]),
    ],
)
def test_qualify(sales, text, want):
    got = sql(sales, text)
    assert "__qualify" not in got.columns
    if want == ["North", "South"]:
        assert set(names(got)) <= set(want)
    else:
        assert names(got) == want


def test_text_without_qualify_is_untouched():
    text = "SELECT 'QUALIFY' AS a, (SELECT 1) -- QUALIFY"
    assert rewrite_qualify(text) == text


def test_blocks(sales):
    text = """-- @label: fails
-- @expect_error
SELECT rep FROM sales WHERE ROW_NUMBER() OVER (ORDER BY amount) = 1
-- @label: works
-- @note: the portable form
SELECT rep FROM sales QUALIFY amount = MAX(amount) OVER ()
"""
    assert [(b.label, b.note, b.expect_error) for b in blocks(text)] == [("fails", None, True), ("works", "the portable form", False)]
    (_, error), (_, df) = run_blocks(sales, text)
    assert "window" in error.lower() and names(df) == ["Dee"]
    with pytest.raises(AssertionError):
        run_blocks(sales, "-- @label: x\n-- @expect_error\nSELECT 1")


@pytest.fixture
def tables(spark):
    spark.createDataFrame([(1, "Ann", 10), (2, "Bob", 20), (3, "Cat", 30)], "id int, name string, balance int").createOrReplaceTempView("dim")
    spark.createDataFrame([(2, "Bob", 25), (3, "Cat", None), (4, "Dan", 40), (None, "Nil", 1)], "id int, name string, balance int").createOrReplaceTempView("stg")
    return spark


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


UPSERT = "MERGE INTO dim AS t USING stg AS s ON t.id = s.id "


@pytest.mark.parametrize(
    ("clauses", "want"),
    [
        ("WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *", [(1, "Ann", 10), (2, "Bob", 25), (3, "Cat", None), (4, "Dan", 40), (None, "Nil", 1)]),
        ("WHEN MATCHED AND s.balance > t.balance THEN UPDATE SET balance = s.balance + 1, t.name = UPPER(s.name) WHEN NOT MATCHED AND s.id IS NOT NULL THEN INSERT (id, name) VALUES (s.id, s.name)", [(1, "Ann", 10), (2, "BOB", 26), (3, "Cat", 30), (4, "Dan", None)]),
        ("WHEN MATCHED AND s.balance IS NULL THEN DELETE WHEN MATCHED THEN UPDATE SET balance = s.balance WHEN NOT MATCHED BY SOURCE THEN DELETE", [(2, "Bob", 25)]),
        ("WHEN NOT MATCHED BY SOURCE AND t.balance < 15 THEN UPDATE SET name = 'gone'", [(1, "gone", 10), (2, "Bob", 20), (3, "Cat", 30)]),
    ],
)
def test_merge(tables, clauses, want):
    assert rows(merge_sql(tables, UPSERT + clauses)) == sorted(want, key=str)


def test_merge_rejects_two_sources_for_a_row(tables):
    twice = tables.createDataFrame([(2, "Bob", 1), (2, "Bob", 99)], "id int, name string, balance int")
    with pytest.raises(AmbiguousMergeError):
        merge_sql(tables, UPSERT + "WHEN MATCHED THEN UPDATE SET *", source=twice)
    narrowed = merge_sql(tables, UPSERT + "WHEN MATCHED AND s.balance > 50 THEN UPDATE SET *", source=twice)
    assert (2, "Bob", 99) in rows(narrowed) and narrowed.count() == 3


def test_parse():
    m = parse_merge("MERGE INTO a.b USING (SELECT 1 AS id) x ON b.id = x.id AND b.k = x.k WHEN MATCHED THEN DELETE")
    assert (m.target, m.target_alias, m.source_alias, m.on) == ("a.b", "b", "x", "b.id = x.id AND b.k = x.k") and m.clauses[0].action == "DELETE"
    with pytest.raises(ValueError):
        parse_merge("SELECT 1")


def test_scalars(spark):
    d = spark.sql("SELECT '' AS e, ' True ' AS f, '-12' AS n, '--1' AS m, timestamp'2024-01-02 03:04:05' AS t, '{\"a\": {\"b\": 7}}' AS j, 'x1y22' AS x, 150 AS v")
    c = F.col
    got = d.select(
        scalars.default_if_empty(c("e"), "-"), scalars.coerce_flag(c("f")), scalars.whole_number(c("n")), scalars.whole_number(c("m")), scalars.run_stamp(c("t")), scalars.variant_field(c("j"), "$.a.b", "int"),
        scalars.digits_only(c("x")), scalars.band(c("v"), 100), scalars.object_path(F.lit("b"), F.lit("k")), F.date_format(scalars.to_utc(c("t"), "America/New_York"), "HH"), scalars.bucket_of(c("x"), n=4) < 4,
    ).first()
    assert tuple(got) == ("-", True, -12, None, "20240102_030405", 7, "122", "high", "s3://b/k", "08", True)
