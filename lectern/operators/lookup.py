"""Look-ups that cost something: only keys that no cache knows are asked for."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def misses(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The distinct keys that the cache lacks."""
    return keys.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(F.col(key).alias("__known")), F.col(key) == F.col("__known"), "left_anti")


def lookup(keys: DataFrame, cache: DataFrame, key: str, fetch: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], tasks: int = 8, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """keys with the cache's columns joined, and the new cache. fetch maps batches of missing keys to rows of the cache's schema;
    so many tasks call it at a time. What it finds is written to the folder first, if one is named, so that nothing is asked for
    twice; without one, write the new cache before using either."""
    shape = StructType([StructField(f.name, f.dataType) for f in cache.schema])  # what is asked for may be unknown
    found = misses(keys, cache, key).repartition(tasks).mapInPandas(fetch, shape)
    if folder:
        found.write.mode("overwrite").parquet(folder)
        found = keys.sparkSession.read.schema(shape).parquet(folder)
    fresh = cache.unionByName(found)
    return keys.join(fresh, key, "left"), fresh


def patient(ask: Callable[[str], dict | None], key: str, columns: list[str], tries: int = 3, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A fetch for lookup() out of a function that asks for one key. After an OSError it waits, twice as long each time, and
    asks again; a key that fails in all tries gives no row, so the cache does not hold it and the next run asks again. A key that
    nothing is known of (None) gives a row of nulls."""

    def one(value: str) -> dict | None:
        for turn in range(tries):
            try:
                return {**(ask(value) or {}), key: value}
            except OSError:
                if turn + 1 < tries:
                    sleep(wait * 2**turn)
        return None

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([[row.get(c) for c in columns] for v in batch[key] if (row := one(v)) is not None], columns=columns, dtype=object)

    return fetch


def class_codes(xml: Column) -> Column:
    """struct(lcc, ddc) out of MODS records: each code from the first record that has one of its kind; null if none has."""

    def first(authority: str) -> Column:
        return F.nullif(F.trim(F.xpath_string(xml, F.lit(f"(//*[local-name()='classification' and @authority='{authority}'][normalize-space()])[1]"))), F.lit(""))

    return F.struct(first("lcc").alias("lcc"), first("ddc").alias("ddc"))


def status_counts(rows: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """(status, n) in a fixed order, also of what does not occur; other values don't count."""
    one = rows.agg(*(F.count_if(F.col(column) == s).alias(f"c{i}") for i, s in enumerate(order)))
    return one.select(F.posexplode(F.array(*(F.struct(F.lit(s).alias("status"), F.col(f"c{i}").alias("n")) for i, s in enumerate(order)))).alias("rank", "e")).orderBy("rank").select("e.*")
