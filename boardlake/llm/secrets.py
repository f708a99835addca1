"""Secret scan with multipart credential linking.

Three kinds are reported by themselves: secret assignments, access key identifiers and long
hex runs. Parts that mean little alone (an identifier, an opaque value, an endpoint) are weak
candidates. They are placed in scopes, stretches of ``SCOPE`` code points, and joined as
intervals: a part meets the parts of its own and the two adjoining scopes, and is linked when
the gap between them is at most ``SCOPE``. Any run of 20 characters or more is a weak value, a plain long word too: that an identifier
is near is what tells them apart. A weak value is reported when an identifier (weak or
access) is that near; an identifier when a value or base secret is; an endpoint when both are.
A scope holds a bounded number of parts, so no group grows with a document.

Positions are code points, ends exclusive. Null texts are empty and have no spans. Rows with equal doc_id and
text get equal results; rows without doc_id are scanned like all others. Spans that start together are
listed in the order of their kinds. An empty table gives an empty result. Only doc_id and text
are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, let, text_of

#: Fixed patterns of the base kinds, with the least length of the part that counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Patterns of the weak parts.
IDENT = r"""((?i:user(?:name)?|login|account(?:_id)?|client_id|key_id|email))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
VALUE = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+"""

KINDS = ("assign", "access", "hex", "ident", "value", "endpoint")
SCOPE = 200
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def spans(text: Column, pattern: str, kind: str, counted: int | None = None, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs of start, kind and end.

    The pieces between the matches give the positions. Matches whose group ``counted`` is
    shorter than ``least`` are dropped after matching.
    """
    rank = KINDS.index(kind)

    def place(found: Column, pieces: Column, parts: Column) -> Column:
        zipped = F.transform(found, lambda m, i: F.struct(F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("len"), F.length(F.get(parts, i)).alias("part")))
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

        def step(state: Column, m: Column) -> Column:
            start = state["at"] + m["gap"]
            span = F.struct(start.alias("start"), F.lit(rank).alias("kind"), (start + m["len"]).alias("end"))
            out = F.when(m["part"] >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
            return F.struct((start + m["len"]).alias("at"), out.alias("out"))

        return F.aggregate(zipped, zero, step, lambda s: s["out"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(counted or 0))
    return F.when(text.rlike(pattern), let(found, lambda f: place(f, F.split(text, pattern), parts))).otherwise(F.array().cast(SPAN))


def parts_of(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, a hash of the text, the base spans and the weak parts."""
    text = F.col("_text")
    rows = docs.select("doc_id", text_of().alias("_text"))
    found = rows.select(
        "doc_id", "_text", F.xxhash64(text).alias("_th"), F.length(text).alias("_len"),
        spans(text, ASSIGN, "assign", 2, 6).alias("_assign"), spans(text, ACCESS, "access").alias("_access"), spans(text, HEX, "hex").alias("_hex"),
        spans(text, IDENT, "ident").alias("_ident"), spans(text, VALUE, "value").alias("_runs"), spans(text, ENDPOINT, "endpoint").alias("_endpoint"),
    )
    return found.select(
        "doc_id", "_th", "_len", "_assign", "_access", "_hex",
        F.concat("_ident", "_runs", "_endpoint").alias("_weak"),
        # Nothing weak is reported without an identifier, so other texts have nothing to link.
        ((F.size("_access") > 0) | (F.size("_ident") > 0)).alias("_named"),
    )


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts that complementary parts confirm, one row per document that has any."""
    key = ["doc_id", "_th", "_len"]
    some = found.where(F.col("_named") & (F.size("_weak") > 0)).select(*key, F.concat("_assign", "_access", "_hex", "_weak").alias("_all")).dropDuplicates(key)
    parts = some.select(*key, F.explode("_all").alias("s")).select(*key, "s.*")
    names = dict(zip(KINDS, range(len(KINDS))))
    role = F.when(F.col("kind").isin(names["access"], names["ident"]), "id").when(F.col("kind") == names["endpoint"], "at").otherwise("secret")
    parts = parts.withColumn("role", role)
    # A part stands in every scope it touches, so that a long one is met from both ends.
    held = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
    near = held.select(*key, F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("role").alias("o_role"), F.col("kind").alias("o_kind"),
                       F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    weak = held.where(F.col("kind") >= names["ident"])
    on = [weak["doc_id"].eqNullSafe(near["doc_id"]), weak["_th"] == near["_th"], weak["_len"] == near["_len"], weak["cell"] == near["cell"]]
    gap = F.greatest(F.col("start"), F.col("o_start")) - F.least(F.col("end"), F.col("o_end"))
    # A run inside another part's text is that part, not its complement.
    met = weak.join(near, on).where((gap >= 0) & (gap <= scope) & (F.col("role") != F.col("o_role")))
    seen = met.groupBy(*[weak[k].alias(k) for k in key], "start", "kind", "end").agg(F.collect_set("o_role").alias("met"))
    enough = (
        ((F.col("kind") == names["value"]) & F.array_contains("met", "id"))
        | ((F.col("kind") == names["ident"]) & F.array_contains("met", "secret"))
        | ((F.col("kind") == names["endpoint"]) & F.array_contains("met", "id") & F.array_contains("met", "secret"))
    )
    return seen.where(enough).groupBy(*key).agg(F.collect_set(F.struct("start", "kind", "end")).alias("_linked"))


def written_out(found: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(found), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id``, base spans ``base`` and all spans ``found``, both arrays of start, kind and end."""
    found = checkpoint(parts_of(docs))
    more = linked(found, scope).select(F.col("doc_id").alias("_d"), F.col("_th").alias("_t"), F.col("_len").alias("_l"), "_linked")
    on = found["doc_id"].eqNullSafe(more["_d"]) & (found["_th"] == more["_t"]) & (found["_len"] == more["_l"])
    base = F.concat("_assign", "_access", "_hex")
    return found.join(more, on, "left").select(
        "doc_id", "_assign", "_access", "_hex", base.alias("base"),
        F.concat(base, F.coalesce("_linked", F.array().cast(SPAN))).alias("found"),
    )
