"""Ledger pages made in plain Python against the same text by built-in functions, on odd orders."""

import datetime
import random

from pyspark.sql import functions as F

from pagegrid.functions.text import div
from pagegrid.plans import derived as D
from pagegrid.plans import page_text


def by_columns():
    """The page of an order as built-in functions write it."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    date, cents = F.col("o_orderdate").cast("date"), D._cents(F.col("o_totalprice"))
    n = (customer % 12).cast("int")

    def invoice(i):
        number = D._text(100000 + key * 13 + (i * 7) % 11)
        kind = F.get(F.array(*[F.lit(t) for t in "IPDX"]), ((key + i) % 4).cast("int"))
        reference = F.concat(F.lit("PO"), D._text(customer), F.lit("A"), D._text(i))
        at_end = F.concat(number, F.lit(" "), reference, F.lit(" "), kind)
        label = F.when(i % 6 == 5, " *CK#: ").otherwise(" *PO#: ")
        inside = F.concat(number, F.lit(" "), kind, label, reference)
        line = F.when(i % 3 == 1, at_end).otherwise(inside)
        stop = F.when((i == 2) & (key % 9 == 0), F.lit("STRIVING TO EARN your trust\n"))
        return F.concat(F.coalesce(stop, F.lit("")), line)

    def money(i):
        cells = [D._day(date, i), D._day(date, i + 30), D._plain_amount(cents + i * 1001)]
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    pairs = [D._day(date, F.lit(i + d)) for i in (0, 1) for d in (0, 30)]
    amounts = [D._plain_amount(cents + i * 1001) for i in range(3)]
    every = F.sequence(F.lit(0), n)
    again = F.when(key % 5 == 0, "\nInvoice No | Type | Reference\n77001 I\n88002 D late")
    lines = F.concat(
        F.array(F.lit("# Account Statement"), F.lit("Invoice No Type Reference")),
        F.transform(every, invoice),
        F.array(F.lit(""), F.lit("| Invoice Date | Due Date | Amount |"), F.lit("|---|---|---|")),
        F.transform(every, money),
        F.array(
            F.concat(F.lit("| "), F.concat_ws(" | ", *pairs, *amounts), F.lit(" |")),
            F.concat(F.lit("Thank you"), F.coalesce(again, F.lit(""))),
        ),
    )
    return F.array_join(lines, "\n")


def test_pages_of_odd_orders(spark, tmp_path):
    rng = random.Random(4)
    day = lambda: rng.choice((None, datetime.datetime(1, 1, 1), datetime.datetime(1582, 10, 10), datetime.datetime(2000, 2, 28, 23)))
    rows = [
        (
            rng.choice((None, -7, 0, 9, 5, 45, k, -k, 10**9 + k)),
            rng.choice((None, 0, 11, -1, -11, k, -k)),
            day() if k % 2 else datetime.datetime(1970, 1, 1) + datetime.timedelta(days=rng.randint(-9000, 90000)),
            rng.choice((None, 0.0, 0.05, -0.05, -1.0, -123.45, 173665.47, k * 1.5, 1e9)),
        )
        for k in range(600)
    ]
    orders = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_totalprice double")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    read = spark.read.parquet(f"{tmp_path}/orders.parquet")
    key = F.col("o_orderkey")
    expected = read.select(div(key, 2).alias("doc_id"), (key % 2 + 1).cast("int").alias("page_no"), by_columns().alias("markdown"))
    got = D.invoice_pages(spark, str(tmp_path))
    assert got.schema.simpleString() == expected.schema.simpleString()
    order = lambda rows: sorted(map(tuple, rows.collect()), key=repr)
    assert order(got) == order(expected)


def test_days_of_any_year(spark):
    rng = random.Random(5)
    days = [rng.randint(-1_500_000, 4_500_000) for _ in range(500)] + [-719_529, -719_528, -719_163, 2_932_896, 2_932_897]
    rows = spark.createDataFrame([(d,) for d in days], "d int")
    text = F.date_format(F.date_from_unix_date("d"), "MM/dd/yyyy")
    for day, expected in rows.select("d", text).collect():
        assert page_text.day_text(day) == expected, day


def test_days_kept_are_bounded():
    days = page_text.Days()
    assert days[0] == days[0] == "01/01/1970"
    for k in range(3 * page_text.DAYS):
        assert days[k] == page_text.day_text(k)
    assert len(days) <= page_text.DAYS


def test_pages_are_not_made_by_lambdas(spark):
    plan = D.invoice_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
