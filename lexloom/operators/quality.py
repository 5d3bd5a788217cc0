"""Schema rules, dataset rules and the gate in front of a write."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import urls


@dataclass(frozen=True)
class Rule:
    """A condition one field must meet; a null condition counts as broken."""

    field: str
    message: str
    holds: Column


def required_text(field: str) -> Rule:
    return Rule(field, "must not be empty", F.length(F.col(field)) > 0)


def matches(field: str, pattern: str, message: str) -> Rule:
    return Rule(field, message, F.col(field).rlike(pattern))


def one_of(field: str, values: Sequence[str]) -> Rule:
    return Rule(field, "must be one of " + ", ".join(values), F.col(field).isin(*values))


def between(field: str, low: int, high: int | None = None) -> Rule:
    c = F.col(field)
    if high is None:
        return Rule(field, f"must be at least {low}", c >= low)
    return Rule(field, f"must be {low} to {high}", c.between(low, high))


def at_least_one(field: str) -> Rule:
    return Rule(field, "must have at least one entry", F.size(F.col(field)) >= 1)


def every(field: str, part: str, message: str, holds) -> Rule:
    return Rule(f"{field}.{part}", message, F.forall(F.col(field), lambda e: F.coalesce(holds(e[part]), F.lit(False))))


def optional(rule: Rule) -> Rule:
    """The same rule for a field that may be absent."""
    return Rule(rule.field, rule.message, F.col(rule.field).isNull() | rule.holds)


def iso_date(field: str) -> Rule:
    return matches(field, fv.ISO_DATE, "is no date such as 2031-02-28")


def item_rules() -> list[Rule]:
    return [
        matches("number", fv.ITEM_NUMBER, "is no item number such as 7, 30C or 112BD"),
        matches("part", fv.PART_REFERENCE, "is no part number such as 2 or 6B"),
        required_text("title"),
        at_least_one("clauses"),
        every("clauses", "text", "must not be empty", lambda t: F.length(t) > 0),
        every("clauses", "kind", "must be one of " + ", ".join(fv.CLAUSE_KINDS), lambda k: k.isin(*fv.CLAUSE_KINDS)),
        one_of("status", fv.ITEM_STATUSES),
    ]


def translated_item_rules() -> list[Rule]:
    """Items of a second edition carry their printed number and page as well."""
    return [*item_rules(), required_text("number_hi"), between("page", 0)]


def part_rules() -> list[Rule]:
    return [matches("number", fv.PART_NUMBER, "is no part number such as 2 or 6B"), required_text("name")]


def translated_part_rules() -> list[Rule]:
    return [*part_rules(), required_text("number_hi")]


def schedule_rules() -> list[Rule]:
    return [between("number", 1, 12), required_text("title")]


def amendment_rules(last_year: int) -> list[Rule]:
    dates = ["introduced_in", "passed_lok_sabha", "passed_rajya_sabha", "assent", "in_force"]
    return [
        between("number", 1),
        between("year", 1950, last_year),
        required_text("title"),
        *[optional(iso_date(d)) for d in dates],
        one_of("theme", fv.THEMES),
    ]


def bill_rules() -> list[Rule]:
    return [
        required_text("title"),
        one_of("house", fv.HOUSES),
        one_of("status", fv.BILL_STATUSES),
        optional(iso_date("introduced_on")),
        iso_date("last_verified"),
        Rule("source_url", "must be a URL", urls.scheme(F.col("source_url")) != ""),
    ]


def essential_rules() -> list[Rule]:
    return [
        matches("id", fv.SLUG, "may hold small letters, digits and hyphens only"),
        required_text("title"),
        required_text("summary"),
        at_least_one("refs"),
        every("refs", "type", "must be one of " + ", ".join(fv.REF_TYPES), lambda k: k.isin(*fv.REF_TYPES)),
        every("refs", "value", "must not be empty", lambda v: F.length(v) > 0),
    ]


def with_item_defaults(items: DataFrame) -> DataFrame:
    """Absent clause kinds and amendment lists get their defaults."""
    kinded = F.transform("clauses", lambda c: c.withField("kind", F.coalesce(c["kind"], F.lit("clause"))))
    amended = F.coalesce("amended_by", F.array().cast("array<string>"))
    return items.withColumns({"clauses": kinded, "amended_by": amended})


def with_amendment_defaults(amendments: DataFrame) -> DataFrame:
    touched = F.coalesce("articles_affected", F.array().cast("array<string>"))
    return amendments.withColumns({"theme": F.coalesce("theme", F.lit("general")), "articles_affected": touched})


def schema_errors(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """All broken rules: (keys, field, message); the data is read once."""
    entries = [
        F.when(
            ~F.coalesce(r.holds, F.lit(False)), F.struct(F.lit(r.field).alias("field"), F.lit(r.message).alias("message"))
        )
        for r in rules
    ]
    found = F.array(*entries).cast("array<struct<field:string,message:string>>")  # a type also for no rules at all
    return df.select(*keys, F.inline(F.filter(found, lambda e: e.isNotNull())))


def count_band(df: DataFrame, low: int, high: int, what: str) -> DataFrame:
    """One error row when a table's row count leaves its band."""
    counted = df.agg(F.count(F.lit(1)).alias("n")).filter(~F.col("n").between(low, high))
    text = F.concat(F.col("n").cast("string"), F.lit(f" {what}, must be {low} to {high}"))
    return counted.select(F.lit("error").alias("severity"), F.lit("count").alias("rule"), text.alias("detail"))


def dataset_rules(
    docs: DataFrame,
    items: DataFrame,
    parts: DataFrame,
    schedules: DataFrame,
    key: str = "doc_id",
    landmarks: Sequence[str] = tuple(fv.LANDMARK_ITEMS),
) -> DataFrame:
    """Findings per document: (key, severity, rule, detail).

    ``docs`` holds (key, preamble), items (key, number, part, title, n_clauses),
    parts (key, number, name), schedules (key, number, title, text).
    """

    def found(df: DataFrame, severity: str, rule: str, detail: Column) -> DataFrame:
        return df.select(key, F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))

    def too_few(table: DataFrame, least: int, rule: str) -> DataFrame:
        counted = table.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        short = docs.select(key).join(counted, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
        return found(short.filter(F.col("n") < least), "error", rule, F.col("n"))

    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    expected = docs.select(key, F.explode(F.array(*[F.lit(n) for n in landmarks])).alias("number"))
    findings = [
        found(docs.filter(blank(F.col("preamble"))), "error", "preamble", F.lit("")),
        too_few(parts, fv.MIN_PARTS, "parts"),
        too_few(schedules, fv.MIN_SCHEDULES, "schedules"),
        found(items.groupBy(key, "number").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "error", "duplicate", F.col("number")),
        found(
            items.join(parts.select(key, F.col("number").alias("part")).distinct(), [key, "part"], "left_anti"),
            "error",
            "unknown part",
            F.col("number"),
        ),
        found(items.filter("n_clauses = 0"), "error", "no clauses", F.col("number")),
        found(items.filter(blank(F.col("title"))), "error", "empty title", F.col("number")),
        found(expected.join(items.select(key, "number").distinct(), [key, "number"], "left_anti"), "error", "landmark", F.col("number")),
        found(parts.filter(blank(F.col("name"))), "warning", "part name", F.col("number")),
        found(schedules.filter(blank(F.col("title"))), "warning", "schedule title", F.col("number")),
        found(schedules.filter(blank(F.col("text"))), "warning", "schedule text", F.col("number")),
    ]
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out


def require_clean(errors: DataFrame, what: str, shown: int = 20) -> None:
    """Fail with the first errors and their number before anything is written."""
    n = errors.count()
    if n:
        lines = "\n".join(": ".join(str(v) for v in row) for row in errors.orderBy(*errors.columns).limit(shown).collect())
        raise ValueError(f"{what} failed with {n} problem(s):\n{lines}")
