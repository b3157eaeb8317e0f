"""Vectorised UDFs that are made when they are called, so modules can be imported on executors."""

from __future__ import annotations

from functools import wraps


def vectorised(return_type: str):
    def mark(f):
        @wraps(f, assigned=("__module__", "__name__", "__qualname__", "__doc__"))
        def call(*columns):
            from pyspark.sql import functions as F

            return F.pandas_udf(f, return_type)(*columns)

        call.plain = f
        return call

    return mark
