"""Inspection listing, detail, metrics and acceptance measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ordered
from .quantiles import exact_quantiles

MAX_PAGE_SIZE = 100
EVIDENCE_PAGE_ROWS = 1000


def matches_any(columns: list[str], text: str) -> Column:
    """Case-insensitive contains over several columns; wildcards in ``text`` stay active."""
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{text}%") for c in columns])


def with_names(inspections: DataFrame, recipes: DataFrame, users: DataFrame) -> DataFrame:
    """Inner joins to recipe and operator."""
    r = recipes.select(
        F.col("id").alias("recipe_id"), F.col("slug").alias("recipe_slug"), F.col("name").alias("recipe_name")
    )
    u = users.select(F.col("id").alias("operator_id"), F.col("full_name").alias("operator_name"))
    return inspections.join(r, "recipe_id").join(u, "operator_id")


def filter_inspections(
    listing: DataFrame,
    *,
    result: str | None = None,
    recipe_slug: str | None = None,
    lot: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Optional filters; an empty string means no filter."""
    for column, value in (("result", result), ("recipe_slug", recipe_slug), ("lot", lot)):
        if value:
            listing = listing.where(F.col(column) == value)
    if search:
        listing = listing.where(matches_any(["board_serial", "lot", "recipe_name"], search))
    return listing


def page(df: DataFrame, order: list[Column], page_number: int = 1, page_size: int = 20) -> DataFrame:
    """One page of an ordered listing; page and size are clamped."""
    number = max(page_number, 1)
    size = min(max(page_size, 1), MAX_PAGE_SIZE)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, time: str, key: str, last_time, last_key, page_size: int) -> DataFrame:
    """Keyset page: rows after the last row seen, so deep pages need no offset."""
    older = (F.col(time) < F.lit(last_time)) | (
        (F.col(time) == F.lit(last_time)) & (F.col(key) < F.lit(last_key))
    )
    return df.where(older).orderBy(F.desc(time), F.desc(key)).limit(min(max(page_size, 1), MAX_PAGE_SIZE))


def page_counts(df: DataFrame, page_size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.greatest(F.ceil(F.col("total") / F.lit(page_size)), F.lit(1)).cast("bigint").alias("total_pages"),
    )


def kpis(inspections: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, first-pass yield and pending reviews in one pass, overall or per group."""
    n = F.count(F.lit(1))
    passed = F.count_if(F.col("result") == "PASS")
    measures = [
        n.alias("total_inspections"),
        passed.alias("pass_count"),
        F.count_if(F.col("result") == "FAIL").alias("fail_count"),
        F.count_if(F.col("result") == "REVIEW").alias("review_count"),
        F.round(
            passed.cast("decimal(20,0)") * F.lit(100) / F.greatest(n, F.lit(1)).cast("decimal(20,0)"), 1
        ).cast("double").alias("first_pass_yield"),
        F.coalesce(F.sum("defect_count"), F.lit(0)).cast("bigint").alias("total_defects"),
        F.count_if((F.col("result") == "REVIEW") & F.col("review_decision").isNull()).alias("pending_review"),
    ]
    return inspections.groupBy(*(by or [])).agg(*measures)


def evidence_pages(
    results: DataFrame, evidence: DataFrame, order: list[str], item: Column,
    rows_per_page: int = EVIDENCE_PAGE_ROWS,
) -> DataFrame:
    """Results with their evidence in order, as pages of bounded size.

    A result with few rows has one page, so the nested detail is complete there; a result
    with very many rows spreads over several pages and no array outgrows the limit. Results
    without evidence keep one row with a null page.
    """
    numbered = ordered(evidence, ["result_id"], order, number="seq")
    nested = (
        numbered.withColumn("page", F.floor((F.col("seq") - 1) / F.lit(rows_per_page)).cast("bigint"))
        .groupBy("result_id", "page")
        .agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))).alias("items"))
        .withColumn("items", F.transform("items", lambda i: i["item"]))
    )
    return results.join(nested, results["id"] == nested["result_id"], "left").drop("result_id")


def acceptance(inspections: DataFrame, *, max_p95_ms: float, max_false_call: float, max_escape: float) -> DataFrame:
    """Cycle-time p95, false-call and escape rates, and the verdict against limits."""
    reviewed = F.col("review_decision").isNotNull()
    rates = inspections.agg(
        F.count(F.lit(1)).alias("inspected_board_count"),
        F.count_if((F.col("result") == "FAIL") & reviewed).alias("_f"),
        F.count_if((F.col("result") == "FAIL") & (F.col("review_decision") == "PASS")).alias("_fp"),
        F.count_if((F.col("result") == "PASS") & reviewed).alias("_p"),
        F.count_if((F.col("result") == "PASS") & (F.col("review_decision") == "FAIL")).alias("_pf"),
    )
    p95 = exact_quantiles(
        inspections.select(F.col("cycle_time_ms").cast("double").alias("cycle")), [], "cycle", {"p95": 0.95}
    ).select("p95").scalar()
    return rates.select(
        "inspected_board_count",
        F.round(p95, 6).alias("cycle_time_p95_ms"),
        F.round(F.col("_fp") * 100.0 / F.greatest("_f", F.lit(1)), 6).alias("false_call_rate_percent"),
        F.round(F.col("_pf") * 100.0 / F.greatest("_p", F.lit(1)), 6).alias("escape_rate_percent"),
    ).withColumn(
        "status",
        F.when(
            (F.col("cycle_time_p95_ms") <= max_p95_ms)
            & (F.col("false_call_rate_percent") <= max_false_call)
            & (F.col("escape_rate_percent") <= max_escape),
            "passed",
        ).otherwise("failed"),
    )


def rule_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule; a rule that is null (unknown) counts as kept, as a CHECK does."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(key).alias("id"), F.explode(broken).alias("rule"))


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows plus incoming rows whose key is not there yet."""
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti"))


def contract_violations(df: DataFrame, expected: dict[str, str], row_limit: int) -> DataFrame:
    """Check a result table against declared columns: missing, extra, wrong type, nulls and
    non-finite numbers per column, and a row limit. One row per violation kind and column."""
    actual = dict(df.dtypes)
    schema_rows = [(c, "missing-column") for c in expected if c not in actual]
    schema_rows += [(c, "unexpected-column") for c in actual if c not in expected]
    schema_rows += [(c, "wrong-type") for c, t in expected.items() if c in actual and actual[c] != t]
    present = [c for c in expected if c in actual]
    checks = [F.count(F.lit(1)).alias("_rows")]
    for c in present:
        checks.append(F.count_if(F.col(c).isNull()).alias(f"{c}|null-value"))
        if actual[c] in ("double", "float"):
            bad = F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
            checks.append(F.count_if(bad).alias(f"{c}|non-finite"))
    counted = df.agg(*checks)
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.lit(code).alias("code"), F.lit(1).cast("bigint").alias("n"))
        for c, code in schema_rows
    ]
    for name in counted.columns[1:]:
        c, code = name.split("|")
        entries.append(F.struct(F.lit(c).alias("column_name"), F.lit(code).alias("code"), F.col(f"`{name}`").alias("n")))
    entries.append(
        F.struct(
            F.lit("*").alias("column_name"), F.lit("row-limit").alias("code"),
            F.greatest(F.col("_rows") - F.lit(row_limit), F.lit(0)).cast("bigint").alias("n"),
        )
    )
    return counted.select(F.inline(F.array(*entries))).where("n > 0")


def tagged_union(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    frames = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def first_occurrences(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key by ``order``; pre-aggregated per task, so copies of one
    value do not travel."""
    others = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return first.select(*keys, "_row.*")


def repeat_rows(df: DataFrame, times: int) -> DataFrame:
    if not 1 <= times <= 100:
        raise ValueError("The repeat count must be between 1 and 100.")
    return df.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(times))))
