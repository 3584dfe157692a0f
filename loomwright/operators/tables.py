"""Relation mode: rows of a DataFrame become grid or table text, group by group, by Spark SQL alone.

A group's rows are the elements of an array of flat objects. Shapes, constants and rows are aggregates and
higher-order functions over rows in the order of ``order``; no Python runs. A group's text is one value, as
the document it stands for would be: groups are meant to be documents, not whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernel.encode import segment


def json_text(c: Column) -> Column:
    """A value's JSON text; the text null for a null."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r'(?s)\A\{"v":(.*)\}\z', 1)


def _rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    cells = [json_text(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)]
    row = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], *cells)
    constants = [F.when(F.min(json_text(F.col(c))) == F.max(json_text(F.col(c))), F.min(json_text(F.col(c)))).alias(f"k{i}") for i, c in enumerate(columns)]
    return df.groupBy(*keys).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(row)).alias("_rows"), *constants).where("_n > 1")


def grid_text(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str], out: str = "body") -> DataFrame:
    """(keys, body): each group of two rows or more as a grid; columns with one value stand in the header."""
    head, cells = [], []
    for i, c in enumerate(columns):
        path = segment(f'"{c}"')
        head.append(F.when(F.col(f"k{i}").isNotNull(), F.concat(F.lit(path + "="), F.col(f"k{i}"))).otherwise(F.lit(path)))
    varies = [F.col(f"k{i}").isNull() for i in range(len(columns))]

    def line(r: Column) -> Column:
        cells = F.array(*[F.when(v, r[f"c{i}"]) for i, v in enumerate(varies)])
        return F.concat(F.lit("+"), F.array_join(cells, ","), F.lit("\n"))

    made = _rows(df, keys, columns, order)
    body = F.concat(F.lit("\n#"), F.col("_n").cast("string"), F.lit("["), F.concat_ws(",", *head), F.lit("]\n"), F.array_join(F.transform("_rows", line), ""))
    return made.select(*keys, body.alias(out))


def table_text(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str], out: str = "body") -> DataFrame:
    """(keys, body): each group of two rows or more as a table with every column in every row."""
    head = ",".join(f'"{c}"' for c in columns)
    line = lambda r: F.concat(F.lit("+["), F.concat_ws(",", *[r[f"c{i}"] for i in range(len(columns))]), F.lit("]\n"))
    made = _rows(df, keys, columns, order)
    return made.select(*keys, F.concat(F.lit("\n#"), F.col("_n").cast("string"), F.lit(f"[{head}]\n"), F.array_join(F.transform("_rows", line), "")).alias(out))


def documents_of(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str], out: str = "content") -> DataFrame:
    """(keys, content): each group's rows as one JSON array of objects."""
    row = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("t"))
    rows = F.array_sort(F.collect_list(row))
    return df.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["t"]), ","), F.lit("]")).alias(out))


def constant_columns(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column, n, n_values, constant): how each column varies in a group; null counts as a value."""
    stacked = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), json_text(F.col(c)).alias("cell")) for c in columns])).alias("x")).select(*keys, "x.*")
    return stacked.groupBy(*keys, "column").agg(F.count("*").alias("n"), F.count_distinct("cell").alias("n_values"), (F.min("cell") == F.max("cell")).alias("constant"))


def value_census(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, cost): how often a string occurs in a group and what its lexeme costs."""
    from ..functions import heuristic_tokens

    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.withColumn("cost", heuristic_tokens(json_text(F.col(value))))


def legend(census: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The first-pass dictionary of each group: entries that pay, in rank order, as array<struct<lexeme,n,cost>>.

    A fold in the JVM: an entry's reference gets longer as entries are kept, so each depends on those before."""
    from ..functions import heuristic_tokens

    entry = F.struct((-F.col("n")).alias("k"), (-F.col("cost")).alias("c"), json_text(F.col(value)).alias("lexeme"), F.col("n"), F.col("cost"))
    lists = census.where("n > 1").groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    kind = "array<struct<lexeme:string,n:bigint,cost:bigint>>"

    def step(kept: Column, e: Column) -> Column:
        price = heuristic_tokens(F.concat(F.lit('"$'), F.size(kept).cast("string"), F.lit('"')))
        pays = e["n"] * (e["cost"] - price) > e["cost"] + 1
        return F.when(pays, F.concat(kept, F.array(F.struct(e["lexeme"].alias("lexeme"), e["n"].alias("n"), e["cost"].alias("cost"))))).otherwise(kept)

    return lists.select(*keys, F.aggregate("e", F.array().cast(kind), step).alias("legend"))
