"""Nested JSON documents: leaves by path, and differences between two versions.

Documents are VARIANT values and are taken apart level by level, so everything stays in Spark's
own expressions and no row moves. How many levels there are is counted first, from the brackets of
the texts; that number is all that reaches the driver.

Values are written as canonical JSON: keys sorted, no spaces, numbers in their shortest decimal
form (``1.0`` is ``1``). Two numbers are equal if their values are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def depth(text: Column) -> Column:
    """How deep arrays and objects of a JSON text are nested."""
    outside = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), r'"[^"]*"', "")
    signs = F.split(F.regexp_replace(outside, r"[^\[\]{}]", ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, sign: Column) -> Column:
        now = at["now"] + F.when(sign.isin("[", "{"), 1).when(sign.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(signs, zero, step, lambda at: at["most"])


def _deepest(df: DataFrame, texts: list[str]) -> int:
    most = [F.max(depth(F.col(t))) for t in texts]
    found = df.agg(F.greatest(*most) if len(most) > 1 else most[0]).first()[0]
    return found or 0


def _entries(value: Column) -> tuple[Column, Column]:
    """The members of an object and of an array, whichever the value is."""
    return F.try_variant_get(value, "$", "map<string,variant>"), F.try_variant_get(value, "$", "array<variant>")


def flatten(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Leaf values by path, such as ``$.a[0]``; empty containers count as leaves.

    A null text has no leaves, unlike the text ``null``. A repeated key in an object is an error.
    """
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.lit("$").alias("path"), F.parse_json(F.col(text)).alias("_v"))
    for _ in range(_deepest(df, [text])):
        # Leaves have no members and stay as they are.
        rows = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).when(
            F.col("pos").isNotNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise("")
        rows = rows.select(*keys, F.concat("path", step).alias("path"), F.coalesce("value", "_v").alias("_v"))
    return rows.select(*keys, "path", F.to_json("_v").alias("value"))


def _number(text: Column) -> Column:
    return F.when(text.rlike("^-?[0-9]"), text.try_cast("double"))


def document_diff(df: DataFrame, key: str, submitted: str, current: str) -> DataFrame:
    """One row per differing path between the two documents of each row.

    A node that only one side has is reported whole, at its own path; where a whole document is
    missing (null), the other is reported at ``$``.
    """
    sides = {"s": submitted, "c": current}
    rows = df.select(
        key, F.lit("$").alias("path"), *[F.parse_json(F.col(name)).alias(f"_{side}") for side, name in sides.items()]
    )

    def different(found: DataFrame) -> DataFrame:
        texts = found.withColumns({f"_t{side}": F.to_json(f"_{side}") for side in sides})
        same = F.col("_ts").eqNullSafe(F.col("_tc")) | F.coalesce(_number(F.col("_ts")) == _number(F.col("_tc")), F.lit(False))
        return texts.where(~same)

    rows = different(rows)
    nothing = F.lit(None).cast("variant")
    for _ in range(_deepest(df, [submitted, current])):
        (s_map, s_list), (c_map, c_list) = _entries(F.col("_s")), _entries(F.col("_c"))
        rows = rows.withColumns({"_sm": s_map, "_cm": c_map, "_sl": s_list, "_cl": c_list})

        def member(path: Column, s: Column, c: Column) -> Column:
            return F.struct(path.alias("path"), s.alias("_s"), c.alias("_c"))

        of_objects = F.transform(
            F.array_union(F.map_keys("_sm"), F.map_keys("_cm")),
            lambda k: member(F.concat(F.col("path"), F.lit("."), k), F.try_element_at("_sm", k), F.try_element_at("_cm", k)),
        )
        of_lists = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size("_sl"), F.size("_cl")) - 1),
            lambda i: member(F.concat(F.col("path"), F.lit("["), i.cast("string"), F.lit("]")), F.get("_sl", i), F.get("_cl", i)),
        )
        both_lists = F.col("_sl").isNotNull() & F.col("_cl").isNotNull()
        members = F.when(F.col("_sm").isNotNull() & F.col("_cm").isNotNull(), of_objects).when(both_lists, of_lists).otherwise(
            F.array(member(F.col("path"), F.coalesce("_s", nothing), F.coalesce("_c", nothing))))
        rows = different(rows.select(key, F.explode(members).alias("m")).select(key, "m.path", "m._s", "m._c"))
    return rows.select(key, "path", F.col("_ts").alias("submitted"), F.col("_tc").alias("current"))
