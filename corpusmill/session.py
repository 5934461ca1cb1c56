"""Session settings and table access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "corpusmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


class Tenant:
    """Access to tables narrowed to one tenant: every table read through it has the tenant's predicate."""

    def __init__(self, spark: SparkSession, base: str, tenant, column: str = "tenant_id"):
        self.spark, self.base, self.tenant, self.column = spark, base, tenant, column

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.base}/{name}.parquet")
        if self.column not in df.columns:
            raise ValueError(f"{name} has no column {self.column}, so it can't be narrowed to a tenant")
        return df.where(F.col(self.column) == self.tenant)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))
