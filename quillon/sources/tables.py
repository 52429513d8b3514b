"""Parquet and table sources and sinks of collections."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import ColumnNotFound, InvalidArgument, SourceBinding, TypeMismatch
from . import files

#: Payload columns of other types are left out.
PAYLOAD_TYPES = (T.StringType, T.LongType, T.IntegerType, T.DecimalType, T.FloatType, T.DoubleType, T.BooleanType)
ENRICHMENT = ("embeddings", "documents", "authors", "classifications", "access_control")


def payload_of(df: DataFrame, columns: tuple[str, ...] | list[str]) -> Column:
    """The JSON payload of a row.

    A single column named payload that holds JSON is taken as it is; otherwise
    an object of the columns that aren't null; null where there are none.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    for c in columns:
        if c not in kinds:
            raise ColumnNotFound(c)
    parts = []
    for c in columns:
        if isinstance(kinds[c], PAYLOAD_TYPES):
            x = F.col(f"`{c}`")
            if isinstance(kinds[c], (T.FloatType, T.DoubleType)):
                x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
            parts.append(x.alias(c))
    if not parts:
        return F.lit(None).cast("string")
    built = F.to_json(F.struct(*parts))
    built = F.when(built != "{}", built)
    if list(columns) == ["payload"] and isinstance(kinds["payload"], T.StringType):
        return F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")).otherwise(built)
    return built


def rows_of(df: DataFrame, id_column: str, vector_column: str, payload_columns: tuple[str, ...] | list[str] = (), dim: int | None = None) -> DataFrame:
    """(id, vector, payload) of a table, its columns checked. Ids beyond a signed long are refused."""
    kinds = {f.name: f.dataType for f in df.schema}
    for c in (id_column, vector_column):
        if c not in kinds:
            raise ColumnNotFound(c)
    if not isinstance(kinds[id_column], (T.IntegralType, T.DecimalType)):
        raise TypeMismatch(f"{id_column} isn't an integer")
    v = kinds[vector_column]
    if not (isinstance(v, T.ArrayType) and isinstance(v.elementType, T.FloatType)):
        raise TypeMismatch(f"{vector_column} isn't a list of floats")
    wide = F.col(f"`{id_column}`")
    fits = F.when(wide.isNull() | wide.between(-(2**63), 2**63 - 1), wide.cast("long")).otherwise(F.raise_error(F.lit("an id doesn't fit a signed long")))
    id_ = fits if isinstance(kinds[id_column], T.DecimalType) else wide.cast("long")
    out = df.select(id_.alias("id"), F.col(f"`{vector_column}`").alias("vector"), payload_of(df, payload_columns).alias("payload"))
    if dim is not None:
        from ..operators.search import check_dim

        out = check_dim(out, dim)
    return out


def import_parquet(spark: SparkSession, path: str, id_column: str = "id", vector_column: str = "vector", payload_columns: tuple[str, ...] | list[str] = (), dim: int | None = None) -> DataFrame:
    """Rows of Parquet files, local or of any object store that Spark is set up for."""
    return rows_of(spark.read.parquet(path), id_column, vector_column, payload_columns, dim)


def import_bound(spark: SparkSession, binding: SourceBinding, dim: int | None = None) -> DataFrame:
    """Rows of a catalog table (where a catalog is configured, also of its own kind)."""
    return rows_of(spark.table(".".join([*binding.namespace, binding.table])), binding.id_column, binding.vector_column, binding.payload_columns, dim)


def object_store_conf(endpoint: str, access_key: str, secret_key: str) -> dict[str, str]:
    """Settings by which s3a:// paths reach a store with path-style addresses."""
    return {"spark.hadoop.fs.s3a.endpoint": endpoint, "spark.hadoop.fs.s3a.access.key": access_key, "spark.hadoop.fs.s3a.secret.key": secret_key, "spark.hadoop.fs.s3a.path.style.access": "true"}


def export_parquet(rows: DataFrame, path: str) -> None:
    """Write (id, vector, payload)."""
    rows.select("id", rows["vector"].cast("array<float>").alias("vector"), "payload").write.mode("overwrite").parquet(path)


def under_root(root: str | None, path: str) -> str:
    """The path under the root that imports and exports are confined to."""
    if not root:
        raise InvalidArgument("no root for Parquet files is set")
    base = posixpath.normpath(root)
    full = posixpath.normpath(posixpath.join(base, path))
    if not full.startswith(base.rstrip("/") + "/"):
        raise InvalidArgument("the path leaves the root")
    return full


def register_enrichment(spark: SparkSession, folder: str) -> list[str]:
    """Views of the enrichment tables that the folder has; those that are missing are skipped."""
    found = [t for t in ENRICHMENT if files.exists(spark, f"{folder}/{t}.parquet")]
    for t in found:
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)
    return found


def register_namespace(spark: SparkSession, namespace: str) -> list[str]:
    """Views of the enrichment tables that a namespace of the catalog has (catalog.namespace, or a database); the others are skipped."""
    found = []
    for t in ENRICHMENT:
        if spark.catalog.tableExists(f"{namespace}.{t}"):
            spark.table(f"{namespace}.{t}").createOrReplaceTempView(t)
            found.append(t)
    return found
