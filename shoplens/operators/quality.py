"""Data-quality expectations: rules as data, all rules of a table in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens import schemas


@dataclass(frozen=True)
class Rule:
    kind: str  # columns, unique, between, in_set, not_null, length, lower_in_set
    column: str = ""
    low: float | None = None
    high: float | None = None
    values: tuple = ()
    allow_null: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.column}" if self.column else self.kind

    def row_failure(self) -> Column | None:
        """True where a row breaks the rule; None for rules about the whole table."""
        value = F.col(self.column) if self.column else None
        if self.kind == "between" or self.kind == "length":
            measured = F.length(value) if self.kind == "length" else value
            fits = F.lit(True)
            if self.low is not None:
                fits = fits & (measured >= F.lit(self.low))
            if self.high is not None:
                fits = fits & (measured <= F.lit(self.high))
            return ~F.coalesce(fits, F.lit(self.allow_null))
        if self.kind in ("in_set", "lower_in_set"):
            tested = F.lower(value) if self.kind == "lower_in_set" else value
            return ~F.coalesce(tested.isin(*self.values), F.lit(self.allow_null))
        if self.kind == "not_null":
            return value.isNull()
        return None

    def failures(self, columns: Sequence[str]) -> Column:
        """Aggregate: how many rows (or, for unique, surplus values) break the rule."""
        if self.kind == "columns":
            return F.max(F.lit(0 if list(columns) == list(self.values) else 1)).cast("long")
        if self.column not in columns:
            return F.count(F.lit(1))
        if self.kind == "unique":
            value = F.col(self.column)
            return F.count(value) - F.countDistinct(value) + F.greatest(F.count_if(value.isNull()) - 1, F.lit(0))
        return F.count_if(self.row_failure())


# fixed values: the rules of the four tables
SUITES = {
    "users": [
        Rule("columns", values=tuple(schemas.USERS.names)),
        Rule("unique", "user_id"),
        Rule("unique", "email"),
        Rule("between", "age", 13, 100),
        Rule("in_set", "gender", values=tuple(schemas.GENDERS)),
        Rule("in_set", "income_level", values=tuple(schemas.INCOME_LEVELS)),
        Rule("not_null", "user_id"),
    ],
    "products": [
        Rule("columns", values=tuple(schemas.PRODUCTS.names)),
        Rule("unique", "product_id"),
        Rule("between", "price", 0.01),
        Rule("between", "discount_percentage", 0, 100),
        Rule("between", "rating", 0, 5),
        Rule("between", "stock_quantity", 0),
        Rule("in_set", "availability_status", values=tuple(schemas.AVAILABILITY)),
    ],
    "interactions": [
        Rule("columns", values=tuple(schemas.INTERACTIONS.names)),
        Rule("unique", "interaction_id"),
        Rule("in_set", "interaction_type", values=tuple(schemas.INTERACTION_TYPES)),
        Rule("between", "rating", 1, 5, allow_null=True),
        Rule("between", "quantity", 1),
        Rule("between", "total_amount", 0.01),
        Rule("between", "dwell_time", 0),
        Rule("between", "scroll_depth", 0, 100),
    ],
    "categories": [
        Rule("columns", values=tuple(schemas.CATEGORIES.names)),
        Rule("unique", "category_id"),
        Rule("between", "level", 1, 2),
    ],
}
ROW_RULES = {
    "users": [
        Rule("lower_in_set", "gender", values=tuple(schemas.GENDERS)),
        Rule("lower_in_set", "income_level", values=tuple(schemas.INCOME_LEVELS)),
        Rule("lower_in_set", "device_type", values=tuple(schemas.DEVICES)),
    ],
    "products": [Rule("length", "name", 1, 200), Rule("length", "description", 10, 1000)],
    "interactions": [
        Rule("lower_in_set", "interaction_type", values=tuple(schemas.INTERACTION_TYPES)),
        Rule("length", "review_text", None, 1000, allow_null=True),
    ],
}


def evaluate(df: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: failures and success, from a single pass over the table."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"), *[r.failures(df.columns).alias(f"f{i}") for i, r in enumerate(rules)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("rule_no"), F.lit(r.name).alias("rule"), F.coalesce(f"f{i}", F.lit(0)).alias("failures"))
            for i, r in enumerate(rules)
        ]
    )
    missing = F.array(*[F.lit(r.name) for r in rules if r.column and r.column not in df.columns] or [F.lit("")])
    return (
        counted.select("total_rows", F.explode(entries).alias("e"))
        .select(F.lit(table).alias("table_name"), "total_rows", "e.*")
        .withColumn("success", (F.col("failures") == 0) & ~F.array_contains(missing, F.col("rule")))
    )


def summarise(results: DataFrame, threshold: float = schemas.QUALITY_THRESHOLD) -> DataFrame:
    """Validation row per table: score, error list, and all rows valid or none."""
    scored = results.groupBy("table_name").agg(
        F.max("total_rows").alias("total_rows"),
        (F.count_if(F.col("success")) / F.count(F.lit(1))).alias("quality_score"),
        F.array_sort(F.collect_list(F.when(~F.col("success"), F.concat(F.lit("Rule '"), "rule", F.lit("' is broken")))))
        .alias("validation_errors"),
    )
    passed = F.col("quality_score") >= threshold
    return scored.withColumns(
        {
            "valid_rows": F.when(passed, F.col("total_rows")).otherwise(F.lit(0)),
            "invalid_rows": F.when(passed, F.lit(0)).otherwise(F.col("total_rows")),
        }
    )


def row_validity(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows breaking at least one row rule of a column that exists."""
    broken = F.lit(False)
    for rule in rules:
        if rule.column in df.columns and rule.row_failure() is not None:
            broken = broken | rule.row_failure()
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(broken).alias("invalid_rows"))


def overall(summary: DataFrame) -> DataFrame:
    score = F.col("overall_score")
    return summary.agg(F.avg("quality_score").alias("overall_score")).withColumn(
        "assessment",
        F.when(score >= 0.95, "EXCELLENT").when(score >= 0.90, "GOOD").when(score >= 0.80, "FAIR").otherwise("POOR"),
    )


def require(summary: DataFrame, threshold: float = schemas.QUALITY_THRESHOLD) -> DataFrame:
    """Strict mode: raises when the overall score is below the threshold (reads one row)."""
    row = overall(summary).first()
    if row is None or row["overall_score"] is None or row["overall_score"] < threshold:
        raise ValueError(f"data quality {row and row['overall_score']} is below {threshold}")
    return summary


def references(facts: DataFrame, dimension: DataFrame, column: str, key: str, name: str) -> DataFrame:
    """Fact rows, and distinct values, whose reference does not exist. Values are counted before the join."""
    seen = facts.groupBy(F.col(column).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    lost = seen.join(dimension.select(key).distinct(), key, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_values")).select(
        F.lit(name).alias("reference"), "orphan_rows", "orphan_values"
    )
