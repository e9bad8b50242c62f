"""Table sources and sinks: explicit schemas, partitioned writes, key based append, upsert and delete."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS_SCHEMA = T.StructType([
    T.StructField("symbol", T.LongType()), T.StructField("date", T.DateType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])

# fixed values: spellings of the bar columns used by data vendors, lower case
COLUMN_ALIASES = {
    "o": "open", "open_price": "open", "h": "high", "high_price": "high", "l": "low", "low_price": "low",
    "c": "close", "close_price": "close", "adj close": "adj_close", "adjclose": "adj_close",
    "v": "volume", "vol": "volume", "ticker": "symbol", "datetime": "date", "timestamp": "date",
}


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars from parquet or headed CSV, never inferring the schema."""
    reader = spark.read.schema(BARS_SCHEMA)
    return reader.option("header", "true").csv(path) if fmt == "csv" else reader.parquet(path)


def write_bars(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write bars; parquet is partitioned by year so that date filters prune folders."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        df.withColumn("year", F.year("date")).write.mode(mode).partitionBy("year").parquet(path)
    return path


def append_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not in the table yet, ready to append; running it twice adds nothing."""
    return rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def append_bars(rows: DataFrame, path: str, keys=("symbol", "date")) -> DataFrame:
    spark = rows.sparkSession
    fresh = append_new(read_bars(spark, path), rows, list(keys))
    write_bars(fresh, path, mode="append")
    return read_bars(spark, path)


def append_factors(rows: DataFrame, path: str) -> None:
    """Long factor rows, partitioned by factor name so that one factor reads one folder."""
    rows.write.mode("append").partitionBy("factor_name").parquet(path)


def append_strategy_performance(rows: DataFrame, path: str, positions: str = "positions") -> None:
    rows.withColumn(positions, F.to_json(positions)).write.mode("append").parquet(path)


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest version of every key over base and updates."""
    both = base.unionByName(updates)
    cols = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(version, *[c for c in cols if c != version])).alias("_r"))
    return newest.select(*keys, "_r.*")


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that do not match; unknown conditions keep the row."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def first_source_per_symbol(sources: list[DataFrame], key: str = "symbol") -> DataFrame:
    """Union of sources in priority order; a symbol is taken whole from the first source that has it."""
    tagged = None
    for i, src in enumerate(sources):
        d = src.withColumn("_prio", F.lit(i))
        tagged = d if tagged is None else tagged.unionByName(d, allowMissingColumns=True)
    best = tagged.groupBy(key).agg(F.min("_prio").alias("_best"))
    return tagged.join(best, key).where(F.col("_prio") == F.col("_best")).drop("_best").withColumnRenamed("_prio", "source_rank")


def standardize_columns(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    names = {**COLUMN_ALIASES, **(aliases or {})}
    return df.withColumnsRenamed({c: names.get(c.lower().strip(), c.lower().strip()) for c in df.columns})


def symbol_universe(df: DataFrame, column: str) -> DataFrame:
    """Names that are already upper case, all of them, in order."""
    return (df.select(F.col(column).alias("symbol")).where(F.col("symbol") == F.upper("symbol"))
            .distinct().orderBy("symbol"))


def availability(universe: DataFrame, bars: DataFrame) -> DataFrame:
    have = bars.groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                                      F.count(F.lit(1)).alias("records"))
    return universe.join(have, "symbol", "left").withColumns({
        "records": F.coalesce("records", F.lit(0)), "has_data": F.col("first_date").isNotNull().cast("int")})


def latest(df: DataFrame, by=("symbol",), order="date") -> DataFrame:
    """Newest row per key by a partial aggregation, without sorting the series."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")


def report_rows_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report_rows_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


