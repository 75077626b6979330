"""Constraint graphs of two planning problems, generated as incidences of constraints and variables.

Variable names keep their indices apart with ':' so that none collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graphs import incidence_graph


def _upto(n: int, beside: str) -> Column:
    """1..n as an array made where the row is: of two literals Spark would make it in the driver, and write it out in every plan."""
    return F.sequence(F.least(F.col(beside), F.lit(1)), F.lit(n))


def _grid(spark: SparkSession, **sizes: int) -> DataFrame:
    """All combinations of indices 1..size, dealt by the largest of them."""
    first = max(sizes, key=sizes.get)
    out = spark.range(1, sizes[first] + 1).select(F.col("id").cast("int").alias(first))
    for name, n in sizes.items():
        if name != first:
            out = out.select("*", F.explode(_upto(n, first)).alias(name))
    return out


def _name(prefix: str, *parts: str | Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


def _rows(nodes: DataFrame, tag: str, id_: Column, variables: Column) -> DataFrame:
    return nodes.select(id_.cast("long").alias("constraint"), F.lit(tag).alias("tag"), variables.alias("variables"))


def capacity_planning(spark: SparkSession, units: int, products: int, periods: int) -> DataFrame:
    """(constraint, tag, variables): demand (DS), activation (UAC), lead time (L, nonlinear) and cumulative build (CU) rows."""
    k, j, t = F.col("k"), F.col("j"), F.col("t")
    over_k, over_j = _upto(units, "t"), _upto(products, "k")
    ds = _rows(_grid(spark, t=periods, j=products), "DS", (t - 1) * products + j, F.transform(over_k, lambda i: F.concat_ws(":", F.lit("x"), i.cast("string"), F.col("j").cast("string"), F.col("t").cast("string"))))
    at = products * periods
    uac = _rows(_grid(spark, t=periods, j=products, k=units), "UAC", at + ((t - 1) * products + j - 1) * units + k, F.array(_name("x", "k", "j", "t"), _name("y", "k", "t")))
    at += units * products * periods
    lead = _rows(_grid(spark, t=periods, k=units), "L", at + (t - 1) * units + k, F.transform(over_j, lambda i: F.concat_ws(":", F.lit("x"), F.col("k").cast("string"), i.cast("string"), F.col("t").cast("string"))))
    at += units * periods
    build = F.transform(F.sequence(F.lit(1), F.col("t")), lambda i: F.concat_ws(":", F.lit("z"), F.col("k").cast("string"), i.cast("string")))
    cu = _rows(_grid(spark, t=periods, k=units), "CU", at + (t - 1) * units + k, F.concat(F.array(_name("y", "k", "t")), build))
    return ds.unionByName(uac).unionByName(lead).unionByName(cu).withColumn("label", F.concat(F.lit("$"), "tag", F.lit("_{"), F.col("constraint").cast("string"), F.lit("}$")))


def circle_cutting(spark: SparkSession, circles: int, rectangles: int, dimensions: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(constraint, tag, variables): assignment (CA), no-overlap (NO, nonlinear) and boundary (BP) rows."""
    i, j, r = F.col("i"), F.col("j"), F.col("r")
    pairs = circles * (circles - 1) // 2
    ca = _rows(_grid(spark, j=circles), "CA", j, F.transform(_upto(rectangles, "j"), lambda x: F.concat_ws(":", F.lit("α"), F.col("j").cast("string"), x.cast("string"))))

    def spots(c: str) -> list[Column]:
        return [_name("x", c, F.lit(d), "r") for d in dimensions]

    base = circles + (r - 1) * (pairs + circles)
    no = _rows(_grid(spark, r=rectangles, i=circles, j=circles).filter("i < j"), "NO", base + (i - 1) * circles - F.floor(i * (i - 1) / 2) + (j - i), F.array(_name("α", "i", "r"), _name("α", "j", "r"), *spots("i"), *spots("j")))
    bp = _rows(_grid(spark, r=rectangles, j=circles), "BP", base + pairs + j, F.array(_name("α", "j", "r"), *spots("j")))
    return ca.unionByName(no).unionByName(bp).withColumn("label", F.concat("tag", F.col("constraint").cast("string")))


def incidence(rows: DataFrame, integer_prefixes: tuple[str, ...]) -> DataFrame:
    kind = F.when(F.split("variable", ":")[0].isin(*integer_prefixes), "integer").otherwise("continuous")
    return rows.select("constraint", F.explode("variables").alias("variable")).distinct().withColumn("kind", kind)


def constraint_graph(rows: DataFrame, integer_prefixes: tuple[str, ...]) -> DataFrame:
    return incidence_graph(incidence(rows, integer_prefixes))
