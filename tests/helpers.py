import datetime as dt

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def ts(sec: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=sec)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)
