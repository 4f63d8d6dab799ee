"""The registry of documents: new files, upserts, orphans, deletions, states, batch summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_id(path: Column, size: Column) -> Column:
    """An id that depends on path and size alone, so that a retry gives the same."""
    return F.substring(F.sha2(F.concat_ws("|", path, size.cast("string")), 256), 1, 26)


def new_files(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of a listing (file_path, file_name, file_size) that the registry lacks by (file_name, file_size), one of each."""
    known = registry.select("file_name", "file_size").distinct()
    r = F.row_number().over(Window.partitionBy("file_name", "file_size").orderBy("file_path"))
    return listing.join(known, ["file_name", "file_size"], "left_anti").withColumn("__r", r).where("__r = 1").drop("__r").withColumn("file_id", file_id(F.col("file_path"), F.col("file_size")))


def registered(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Each (file_name, file_size) of a listing with its file_id and state: that of the registry if it is known, else new ones."""
    new = new_files(listing, registry).select("file_name", "file_size", F.lit("new").alias("state"), "file_id")
    known = registry.join(listing.select("file_name", "file_size").distinct(), ["file_name", "file_size"], "left_semi")
    return new.union(known.groupBy("file_name", "file_size").agg(F.min("file_id").alias("file_id")).select("file_name", "file_size", F.lit("known"), "file_id"))


def title_duplicates(rows: DataFrame, order: list[str], title: str = "title") -> DataFrame:
    """rows with gone: whether an earlier row by order has the same title, whatever the case of its letters."""
    r = F.row_number().over(Window.partitionBy(F.lower(title)).orderBy(*order))
    return rows.withColumn("gone", F.col(title).isNotNull() & (r > 1))


def upsert(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key; one pass of grouped maxima, without sorting all rows of a key."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("m"))
    return best.select(*keys, *[F.col(f"m.{c}").alias(c) for c in [*order, *rest]])


def orphans(listing: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """What is stored under a key that the registry doesn't have."""
    return listing.join(registry.select(key).distinct(), key, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every stage's table without the keys in `gone`."""
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def reset_state(registry: DataFrame, key: str, ids: list[str], column: str, state: str) -> DataFrame:
    return registry.withColumn(column, F.when(F.col(key).isin(ids), F.lit(state)).otherwise(F.col(column)))


def pending(registry: DataFrame, column: str, done: tuple[str, ...] = ("Done", "Not_Found")) -> DataFrame:
    """Rows whose state isn't final."""
    return registry.where(F.col(column).isNull() | ~F.col(column).isin(*done))


def doi_state(doi: Column, info: Column, renamed: Column) -> Column:
    return F.when(doi.isNull(), "NOT_DOI").when(info.isNull(), "Doi_Getted").when(~renamed, "Doi_Info_Getted").otherwise("Doi_Updated")


def summary(results: DataFrame) -> DataFrame:
    """(total, success, failed, errors) of results with a boolean `success` and a text `error`.

    errors is an array of (error, n), the most frequent first: a row for each kind of error, however many rows failed.
    """
    failed = F.coalesce(~F.col("success"), F.lit(True))
    kinds = results.where(failed & F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("n"))
    listed = kinds.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "error"))).alias("e"))
    errors = F.transform("e", lambda x: F.struct(x["error"].alias("error"), (-x["less"]).alias("n")))
    counts = results.agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("failed"))
    return counts.join(F.broadcast(listed.select(errors.alias("errors"))))
