"""Tables of a data folder, and a catalogue that applies the implicit predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as Spark's Parquet reader sees it: filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class MissingTenant(ValueError):
    """A tenant-scoped table was read without a tenant."""


@dataclass(frozen=True)
class TenantCatalog:
    """Reads with the tenant and soft-delete predicates that every query has by default."""

    spark: SparkSession
    folder: str
    tenant: object = None

    def scoped(self, df: DataFrame, column: str, every_tenant: bool = False, include_deleted: bool = False) -> DataFrame:
        if not every_tenant:
            if self.tenant is None:
                raise MissingTenant(f"no tenant given for {column}")
            df = df.where(F.col(column) == F.lit(self.tenant))
        if "is_deleted" in df.columns and not include_deleted:
            df = df.where(~F.col("is_deleted"))
        return df

    def table(self, name: str, column: str, **options: bool) -> DataFrame:
        return self.scoped(table(self.spark, self.folder, name), column, **options)
