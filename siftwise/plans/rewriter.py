"""Puts predicates right above tables of a Catalyst plan and makes a DataFrame of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from siftwise.plans.reader import seq


def column_of(spark: SparkSession, attribute) -> Column:
    return Column(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(attribute))


def filtered(spark: SparkSession, node, predicate: Column | None):
    """The plan node with a filter above it."""
    if predicate is None:
        return node
    condition = spark._jsparkSession.expression(predicate._jc)
    return spark._jvm.org.apache.spark.sql.catalyst.plans.logical.Filter(condition, node)


def rewritten(spark: SparkSession, plan, predicates: dict[tuple[int, ...], Column], path: tuple[int, ...] = ()):
    """The plan with a filter above the node at each path."""
    if not any(p[: len(path)] == path for p in predicates):
        return plan
    children = seq(plan.children())
    made = [rewritten(spark, c, predicates, (*path, i)) for i, c in enumerate(children)]
    if any(a is not b for a, b in zip(children, made, strict=True)):
        buffer = spark._jvm.java.util.ArrayList()
        for x in made:
            buffer.add(x)
        plan = plan.withNewChildren(spark._jvm.scala.jdk.javaapi.CollectionConverters.asScala(buffer).toIndexedSeq())
    return filtered(spark, plan, predicates.get(path))


def frame(spark: SparkSession, plan) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)
