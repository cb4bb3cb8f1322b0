"""Keyed tables over DataFrames: insert, replace, delete, select; files as storage."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.folders import shared_dir


def with_id(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Adds a number from 1, gapless, in the given order; rows equal in it stand side by side.

    Rows are dealt by ranges of the order, those equal in it by a hash of the row and
    a number of their own, and written, which fixes partitions and places in them;
    one row for each partition shifts these.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != name]).alias("row"))
    plain = [F.col(f"row.`{f.name}`") for f in rows.schema["row"].dataType if "map<" not in f.dataType.simpleString()]
    rows = rows.withColumns({"tie": F.xxhash64(*plain), "at": F.monotonically_increasing_id()})
    by = [*(F.col(f"row.`{c}`") for c in order), F.col("tie"), F.col("at")]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).select("row", F.monotonically_increasing_id().alias("place")).write.parquet(path)
    dealt = spark.read.parquet(path).withColumn("part", F.shiftright("place", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return dealt.join(F.broadcast(starts), "part").select("row.*", number.alias(name))


def merge_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both frames' rows with the columns of either; missing ones are NULL."""
    return old.unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` only where the key is not there yet; of several with one key, the least."""
    rest = [c for c in new.columns if c not in key]
    once = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_rest")).select(*key, "_rest.*") if rest else new.distinct()
    return old.unionByName(once.join(old.select(*key), list(key), "left_anti"))


def insert_replace(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``new`` wins over ``old`` where keys are equal. new: one row for each key."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


def delete(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition does not hold; a NULL condition deletes nothing."""
    return df.where(~F.coalesce(F.expr(condition), F.lit(False)))


def select(tables: Mapping[str, DataFrame], fields: Sequence[str], joins: Sequence[tuple[str, str]] = (), where: Sequence[str] = (), order: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """``table.column`` fields of inner-joined tables.

    joins: pairs of ``table.column`` that are equal; where: conditions that all
    hold; order: (field, asc or desc). Fields are named column, or table_column
    where two would clash.
    """
    first = fields[0].split(".")[0]
    out, seen = tables[first].alias(first), {first}
    todo = list(joins)
    while todo:
        for pair in todo:
            names = [x.split(".")[0] for x in pair]
            if any(n in seen for n in names):
                new = next((n for n in names if n not in seen), None)
                condition = F.col(pair[0]) == F.col(pair[1])
                out = out.where(condition) if new is None else out.join(tables[new].alias(new), condition)
                seen.update(names)
                todo.remove(pair)
                break
        else:
            raise ValueError(f"not connected: {todo}")
    for condition in where:
        out = out.where(condition)
    if order:
        out = out.orderBy(*[F.col(f).desc() if d.lower() == "desc" else F.col(f).asc() for f, d in order])
    plain = [f.split(".")[1] for f in fields]
    return out.select(*[F.col(f).alias(c if plain.count(c) == 1 else f.replace(".", "_")) for f, c in zip(fields, plain)])


def save(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    df.write.mode(mode).parquet(path)
    return load(df.sparkSession, path)


def load(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """Parquet, ORC, JSON, CSV and whatever else Spark reads."""
    return spark.read.format(format).options(**options).load(path)
