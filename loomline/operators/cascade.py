"""The detection cascade: file name, manual overrides, cover text, deep text, and a review level.

Overrides are joined once, before the guards: they set a field's review to none, which is what
the guards ask, and set the same values however often they are applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import fixed
from loomline.functions.rules import FLAGS, any_match, first_match, fiscal_year
from loomline.functions.text import cut, fiscal_ending, fiscal_range, fiscal_starting, normalize, ordinal_half, strip
from loomline.operators.lookup import if_small

UNKNOWN = "unknown"
#: value, source and review of each field
FIELDS = ("type", "fy", "period")


def with_name_pass(docs: DataFrame, name: str = "filename") -> DataFrame:
    """Type, year and period that a file name tells, each with source and review.

    A range that is no fiscal year leaves the year unknown: no single year is looked for then.
    """
    raw, f = F.lower(F.col(name)), normalize(F.col(name))
    kind = first_match(f, fixed.FILENAME_TYPES)
    pattern = FLAGS + r"(20\d{2})[-_](20\d{2}|\d{2})"
    first, second = F.regexp_extract(raw, pattern, 1), F.regexp_extract(raw, pattern, 2)
    single = F.regexp_extract(raw, r"(20\d{2})", 1)
    out = docs.withColumn("type", F.coalesce(kind, F.lit(UNKNOWN)))
    inferred = F.when(single != "", F.when(F.col("type").isin(fixed.FORWARD_TYPES), fiscal_starting(single)).otherwise(fiscal_ending(single)))
    year = F.when(first != "", fiscal_range(first, second)).otherwise(inferred)
    half = F.when(F.col("type") == "cbk_mpc_report", ordinal_half(f))
    period = F.coalesce(first_match(f, fixed.FILENAME_PERIODS), half)
    return out.withColumns({
        "fy": F.coalesce(year, F.lit(UNKNOWN)),
        "period": F.coalesce(period, F.lit("annual")),
        "type_source": F.when(F.col("type") == UNKNOWN, UNKNOWN).otherwise("filename"),
        "type_review": F.when(F.col("type") == UNKNOWN, "hard").otherwise("none"),
        "fy_source": F.when(year.isNull(), UNKNOWN).otherwise("filename"),
        "fy_review": F.when(year.isNull(), "hard").when(first != "", "none").otherwise("soft"),
        "period_source": F.lit("filename"),
        "period_review": F.when(period.isNull(), "soft").otherwise("none"),
    })


def with_overrides(docs: DataFrame, overrides: DataFrame, name: str = "filename") -> DataFrame:
    """Fields that ``overrides`` (filename, o_type, o_year, o_period) sets win; it is broadcast if it is small."""
    out = docs.join(if_small(overrides.withColumnRenamed("filename", "__o")), F.col(name) == F.col("__o"), "left")
    for field, given in zip(FIELDS, ("o_type", "o_year", "o_period")):
        has = F.col(given).isNotNull()
        out = out.withColumns({
            field: F.coalesce(F.col(given), F.col(field)),
            f"{field}_source": F.when(has, "override").otherwise(F.col(f"{field}_source")),
            f"{field}_review": F.when(has, "none").otherwise(F.col(f"{field}_review")),
        })
    return out.drop("__o", "o_type", "o_year", "o_period")


def _open(*reviews: str) -> Column:
    out = F.lit(False)
    for r in reviews:
        out = out | (F.col(r) != "none")
    return out


def with_cover_pass(docs: DataFrame, cover: Column, cover_types=None) -> DataFrame:
    """What the cover adds where a field is open; a cover of under 100 characters is a scan and is left."""
    read = _open("type_review", "fy_review", "period_review")
    scanned = read & (F.length(strip(F.coalesce(cover, F.lit("")))) < fixed.SCANNED_BELOW)
    use = read & ~scanned
    kind = F.when(use & (F.col("type") == UNKNOWN), first_match(normalize(cover), fixed.COVER_TYPES if cover_types is None else cover_types))
    year = F.when(use & F.col("fy_review").isin("hard", "soft"), fiscal_year(cover, fixed.TEXT_YEARS))
    period = F.when(use & F.col("period_review").isin("hard", "soft"), first_match(F.lower(cover), fixed.TEXT_PERIODS))
    staged = docs.withColumns({"__scanned": scanned, "__use": use, "__type": kind, "__fy": year, "__period": period,
                               "supersedes_hint": use & any_match(F.lower(cover), fixed.REVISION_HINTS)})
    for field, review in (("type", "soft"), ("fy", "none"), ("period", "none")):
        new = F.col(f"__{field}")
        staged = staged.withColumns({
            f"{field}_source": F.when(new.isNotNull(), "cover").otherwise(F.col(f"{field}_source")),
            f"{field}_review": F.when(new.isNotNull(), review).otherwise(F.col(f"{field}_review")),
            field: F.coalesce(new, F.col(field)),
        })
    return staged.withColumnRenamed("__scanned", "is_scanned").withColumnRenamed("__use", "cover_read").drop("__type", "__fy", "__period")


def with_deep_pass(docs: DataFrame, deep: Column) -> DataFrame:
    """A year from deeper text, if still unknown, not timeless, and the cover could be read."""
    use = F.col("cover_read") & (F.col("fy") != "na") & ((F.col("fy_review") == "hard") | (F.col("fy") == UNKNOWN))
    new = F.when(use, fiscal_year(deep, fixed.TEXT_YEARS))
    return docs.withColumn("__fy", new).withColumns({
        "fy_source": F.when(F.col("__fy").isNotNull(), "deep").otherwise(F.col("fy_source")),
        "fy_review": F.when(F.col("__fy").isNotNull(), "soft").otherwise(F.col("fy_review")),
        "fy": F.coalesce("__fy", "fy"),
    }).drop("__fy", "cover_read")


def review_level() -> Column:
    """The worst review of a row's fields; a timeless year does not count."""
    rank = lambda c: F.when(c == "hard", 2).when(c == "soft", 1).otherwise(0)
    worst = F.greatest(rank(F.col("type_review")), rank(F.col("period_review")), F.when(F.col("fy") == "na", 0).otherwise(rank(F.col("fy_review"))))
    return F.when(worst == 2, "hard").when(worst == 1, "soft").otherwise("none")


def detect(docs: DataFrame, overrides: DataFrame, text: str | None = "text", name: str = "filename") -> DataFrame:
    """All passes over rows with a file name and, unless ``text`` is None, their text."""
    out = with_overrides(with_name_pass(docs, name), overrides, name)
    if text is None:
        out = out.withColumns({"is_scanned": F.lit(False), "supersedes_hint": F.lit(False)})
    else:
        out = with_cover_pass(out, cut(F.col(text), 0, fixed.COVER_CHARS))
        out = with_deep_pass(out, cut(F.col(text), fixed.COVER_CHARS, fixed.DEEP_CHARS))
    return out.withColumn("review_level", review_level())


def review_counts(docs: DataFrame) -> DataFrame:
    """Rows of each review level, 0 for levels without."""
    levels = docs.sparkSession.createDataFrame([("none",), ("soft",), ("hard",)], "review_level string")
    n = docs.groupBy("review_level").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(n, "review_level", "left").select("review_level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
