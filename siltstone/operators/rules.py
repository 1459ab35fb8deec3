"""Conditions, constraints and patterns as tables joined to features.

Features are long rows (entity, feature, value string); rules are small tables. A rule is
evaluated by a join on the feature's name, not by a loop. Rules go to the features: there are
few names of features, so a shuffle by them would bring most rows to a few tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PENALTY, LEAST_SCORE = 0.15, 0.3


def holds(operator: Column, actual: Column, expected: Column) -> Column:
    """A condition on strings; gt and lt compare as numbers, ``in`` takes a list with commas."""
    a, e = actual.try_cast("double"), expected.try_cast("double")
    return F.coalesce(
        F.when(operator == "eq", actual == expected)
        .when(operator == "ne", actual != expected)
        .when(operator == "gt", a > e)
        .when(operator == "lt", a < e)
        .when(operator == "in", F.array_contains(F.split(expected, ","), actual))
        .when(operator == "contains", F.contains(actual, expected)),
        F.lit(False),
    )


def violated(operator: Column, actual: Column, threshold: Column) -> Column:
    """Whether a constraint is violated: gt by an actual above the threshold, eq by another value."""
    a, t = actual.try_cast("double"), threshold.try_cast("double")
    return F.coalesce(
        F.when(operator == "eq", actual != threshold)
        .when(operator == "ne", actual == threshold)
        .when(operator == "gt", a > t)
        .when(operator == "lt", (a != 0) & (a < t))
        .when(operator == "lte", (a != 0) & (a <= t))
        .when(operator == "gte", (a != 0) & (a >= t))
        .when(operator == "required", (actual == "") | (actual == "0") | (F.lower(actual) == "false")),
        F.lit(False),
    )


def violations(features: DataFrame, constraints: DataFrame) -> DataFrame:
    """(entity, constraint, severity): each violated constraint once; constraints: constraint, feature, operator, threshold, severity."""
    j = features.join(F.broadcast(constraints), "feature")
    return j.where(violated(F.col("operator"), F.col("value"), F.col("threshold"))).select("entity", "constraint", "severity").distinct()


def pattern_scores(features: DataFrame, conditions: DataFrame) -> DataFrame:
    """(entity, pattern, matched, score) above 0.3; conditions: pattern, priority, feature, operator, expected."""
    j = features.join(F.broadcast(conditions), "feature")
    hit = holds(F.col("operator"), F.col("value"), F.col("expected")).cast("int")
    g = j.groupBy("entity", "pattern", "priority").agg(F.sum(hit).alias("matched"))
    return g.select("entity", "pattern", F.col("matched").cast("long"), F.least(F.lit(1.0), F.col("matched") + F.col("priority") / 10.0).alias("score")).where(F.col("score") > LEAST_SCORE)


def final_scores(scores: DataFrame, found: DataFrame, priorities: DataFrame) -> DataFrame:
    """Pattern scores with the priority added again and a penalty for each error."""
    errors = found.where("severity = 'error'").groupBy("entity").agg(F.count("*").alias("errors"))
    j = scores.join(F.broadcast(priorities), "pattern").join(errors, "entity", "left")
    raw = F.col("score") + F.col("priority") / 10.0 - PENALTY * F.coalesce("errors", F.lit(0))
    return j.select("entity", "pattern", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("score"))


def all_hold(features: DataFrame, rules: DataFrame) -> DataFrame:
    """(entity, rule) where every condition of the rule holds; rules: rule, feature, operator, expected."""
    need = rules.groupBy("rule").agg(F.count("*").alias("need"))
    j = features.join(F.broadcast(rules), "feature").where(holds(F.col("operator"), F.col("value"), F.col("expected")))
    have = j.groupBy("entity", "rule").agg(F.countDistinct("feature", "operator", "expected").alias("have"))
    return have.join(F.broadcast(need), "rule").where("have = need").select("entity", "rule")


def nested(json: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text."""
    return F.get_json_object(json, "$." + path)


#: Multipliers of traffic, and base costs by words in an architecture's name (fixed values).
TRAFFIC = {"low": 0.5, "medium": 1.0, "high": 2.5, "enterprise": 5.0}
COSTS = [(["serverless", "lambda"], (30, 60, 40, 20)), (["kubernetes", "eks", "gke"], (300, 100, 80, 50)), (["vm", "virtual"], (100, 80, 50, 30)), (["saas", "managed"], (150, 100, 60, 40))]
OTHER_COSTS, CATEGORIES = (100, 75, 50, 25), ("compute", "storage", "network", "other")


def costs(architecture: Column, traffic: Column) -> Column:
    """A struct of whole costs by category and their total."""
    a = F.lower(architecture)
    factor = F.coalesce(F.create_map(*(F.lit(x) for kv in TRAFFIC.items() for x in kv))[F.lower(traffic)], F.lit(1.0))
    parts = []
    for k, name in enumerate(CATEGORIES):
        base = F.lit(OTHER_COSTS[k])
        for found, amounts in reversed(COSTS):
            has = F.contains(a, F.lit(found[0]))
            for w in found[1:]:
                has = has | F.contains(a, F.lit(w))
            base = F.when(has, amounts[k]).otherwise(base)
        parts.append((base * factor).cast("int").alias(name))
    whole = F.struct(*parts)
    return F.struct(*(whole[n].alias(n) for n in CATEGORIES), sum((whole[n] for n in CATEGORIES[1:]), whole[CATEGORIES[0]]).alias("total"))
