"""Exact percentiles of groups of any size by distributed selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .loops import few

c = F.col
#: A sketch of this accuracy brackets each percentile; a group of at most twice as many rows is its own bracket.
ACCURACY = 10_000


def exact_percentiles(rows: DataFrame, keys: list[str], column: str, shares: dict[str, float], more: list[Column] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """(keys, a column for each of shares, aggregates ``more``) of a column's values without nulls; between two values as linear interpolation has it.

    A first pass brackets each percentile by a mergeable sketch, whose error is known. A second pass counts what lies
    below each bracket and each value inside: about 4 / accuracy of a group at most, so no task gets the values of a
    group, and what is counted is added up before it is shuffled. The counts give the values of the exact ranks.
    """
    rows = rows.where(c(column).isNotNull()).withColumn("__v", c(column).cast("double"))
    names, slack = list(shares), 2 / accuracy
    at = [f(p) for p in shares.values() for f in (lambda p: max(0.0, p - slack), lambda p: min(1.0, p + slack))]
    ends = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"), F.percentile_approx("__v", at, accuracy).alias("__at"), *(more or []))
    ends = few(ends)  # a row a group
    whole = c("__n") <= 2 * accuracy
    low = lambda i: F.when(whole, c("__least")).otherwise(c("__at")[2 * i])
    high = lambda i: F.when(whole, c("__most")).otherwise(c("__at")[2 * i + 1])
    brackets = ends.select(*keys, F.array(*[F.struct(F.lit(i).alias("i"), low(i).alias("low"), high(i).alias("high")) for i in range(len(names))]).alias("__brackets"))
    # Below a bracket a row counts only; inside it counts for its value.
    met = rows.select(*keys, "__v").join(brackets, keys)
    seen = F.transform(F.filter("__brackets", lambda b: c("__v") <= b["high"]), lambda b: F.struct(b["i"].alias("i"), F.when(c("__v") >= b["low"], c("__v")).alias("v")))
    counted = met.select(*keys, F.explode(seen).alias("__s")).groupBy(*keys, c("__s.i").alias("__i"), c("__s.v").alias("__v")).agg(F.count("*").alias("__k"))
    share = F.element_at(F.array(*[F.lit(float(p)) for p in shares.values()]), c("__i") + 1)
    rank = share * (c("__n") - 1)
    upto = F.sum("__k").over(Window.partitionBy(*keys, "__i").orderBy(c("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.join(ends.select(*keys, "__n"), keys).withColumn("__upto", upto).withColumn("__rank", rank)
    pick = lambda r: F.min(F.when(c("__upto") > r, c("__v")))
    found = ranked.groupBy(*keys, "__i").agg(pick(F.floor("__rank")).alias("a"), pick(F.ceil("__rank")).alias("b"), F.first("__rank").alias("r"))
    value = F.when(c("a") == c("b"), c("a")).otherwise(c("a") * (F.ceil("r") - c("r")) + c("b") * (c("r") - F.floor("r")))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(c("__i") == i, value)).alias(n) for i, n in enumerate(names)])
    return wide.join(ends.drop("__n", "__least", "__most", "__at"), keys)
