"""Pandas and Arrow UDFs whose type is read when they are first used, so that modules import without a session."""

from __future__ import annotations

from functools import update_wrapper

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.ship import ship


def _lazy(make: str, kind: str):
    def wrap(f):
        made: dict = {}

        def call(*columns) -> Column:
            sc = SparkContext._active_spark_context
            if sc not in made:
                ship(sc)
                made.clear()
                made[sc] = getattr(F, make)(f, kind)
            return made[sc](*columns)

        return update_wrapper(call, f)

    return wrap


def pandas_udf(kind: str):
    return _lazy("pandas_udf", kind)


def arrow_udf(kind: str):
    return _lazy("arrow_udf", kind)
