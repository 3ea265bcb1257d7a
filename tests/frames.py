"""Small literal frames."""
from datetime import date, timedelta


def days(n, start=date(2020, 1, 1)):
    return [start + timedelta(days=i) for i in range(n)]


def walk(spark, tickers=(("AAA", 100.0), ("BBB", 200.0)), n=30):
    rows = [(t, d, p + i) for t, p in tickers for i, d in enumerate(days(n))]
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def bars(spark, closes, ticker="AAA", spread=1.0, volume=100.0):
    rows = [(ticker, d, c, c + spread, c - spread, c, volume) for d, c in zip(days(len(closes)), closes)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
