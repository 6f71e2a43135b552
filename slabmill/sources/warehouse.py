"""Parquet tables with declared schemas and idempotent write operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from slabmill.operators.asof import first_by
from slabmill.schemas import TABLES, Table
from slabmill.session import hadoop_path, is_stored, stage


def quantize(df: DataFrame, scales: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Doubles to declared decimals; NaN becomes NULL."""
    columns = {}
    for name, (precision, scale) in scales.items():
        value = F.col(name).cast("double")
        columns[name] = F.round(F.when(~F.isnan(value), value), scale).cast(f"decimal({precision},{scale})")
    return df.withColumns(columns)


class Warehouse:
    """Named tables below one root folder on shared storage."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, Table] = TABLES):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read_table(self, name: str) -> DataFrame:
        """The table, or an empty frame of its declared schema while nothing is stored."""
        table = self.tables[name]
        if not is_stored(self.spark, self.path(name)):
            return self.spark.createDataFrame([], table.schema)
        return self.spark.read.schema(table.schema).parquet(self.path(name))

    def conform(self, df: DataFrame, name: str) -> DataFrame:
        """Cast to the declared schema; absent columns are NULL, NaN is NULL."""
        have = set(df.columns)
        columns = []
        for f in self.tables[name].schema.fields:
            if f.name not in have:
                columns.append(F.lit(None).cast(f.dataType).alias(f.name))
                continue
            value = F.col(f.name)
            if dict(df.dtypes)[f.name] == "double":
                value = F.when(~F.isnan(value), value)
                if f.dataType.typeName() == "decimal":
                    value = F.round(value, f.dataType.scale)
            columns.append(value.cast(f.dataType).alias(f.name))
        return df.select(*columns)

    def _write(self, df: DataFrame, name: str, mode: str, dealt: bool = False) -> int:
        """Write and return the row count measured during the write itself; rows that are ``dealt`` by their key stay where they are."""
        seen = Observation()
        parts = self.tables[name].partitions
        out = df.observe(seen, F.count(F.lit(1)).alias("n"))
        if parts and not dealt:
            out = out.repartition(*[F.col(p) for p in parts], F.pmod(F.xxhash64(*self.tables[name].key), F.lit(64)))
        writer = out.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        (writer.partitionBy(*parts) if parts else writer).parquet(self.path(name))
        try:
            return int(seen.get["n"])
        except (Py4JError, KeyError):
            # A plan the optimizer proves empty never reaches the counter.
            return 0

    def insert_if_absent(self, df: DataFrame, name: str, order: Sequence[str] | None = None) -> int:
        """Append rows whose natural key is new; of equal keys in the batch the least ``order`` wins."""
        key = list(self.tables[name].key)
        rows = self.conform(df, name)
        ranked = first_by(rows, key, list(order or [c for c in rows.columns if c not in key]) or key)
        fresh = ranked.join(self.read_table(name).select(*key), key, "left_anti")
        # Where a key names its partition, the exchange by key is the only one.
        return self._write(fresh.select(*rows.columns), name, "append", dealt=set(self.tables[name].partitions) <= set(key))

    def upsert(self, df: DataFrame, name: str, order: Sequence[str] | None = None) -> int:
        """Insert or replace by key, rewriting only the partitions the batch touches; returns the number of keys in the batch.

        Of equal keys in the batch the least ``order`` (else of all other columns) wins.
        Partition columns are part of the key, so a key never changes its partition.
        The merged rows are staged before their old files are replaced.
        """
        table = self.tables[name]
        key, parts = list(table.key), list(table.partitions)
        least = list(order or [c for c in table.schema.names if c not in key]) or key
        rows = stage(first_by(self.conform(df, name), key, least), f"batch_{name}")
        stored = self.read_table(name)
        if parts:
            stored = stored.join(rows.select(*parts).distinct(), parts, "left_semi")
        merged = stage(stored.join(rows.select(*key), key, "left_anti").unionByName(rows), f"upsert_{name}")
        self._write(merged, name, "overwrite")
        return rows.count()

    def replace_slice(self, df: DataFrame, name: str, slices: Sequence[Mapping[str, object]] = ()) -> int:
        """Replace the partitions present in ``df``, and clear those that ``slices`` names (column to value) first.

        A job that recomputes a slice names it, so that a result without rows leaves no old rows behind.
        """
        parts = self.tables[name].partitions
        if not parts:
            raise ValueError(f"{name} has no slice columns")
        for values in slices:
            if set(values) != set(parts):
                raise ValueError(f"a slice of {name} is one value of each of {parts}")
            files, where = hadoop_path(self.spark, self.path(name) + "".join(f"/{p}={values[p]}" for p in parts))
            files.delete(where, True)
        return self._write(self.conform(df, name), name, "overwrite")
