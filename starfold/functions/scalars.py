"""Scalar column expressions: text, years, numeric transforms, seeded hashing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LOWEST_RATING = 0.5
HIGHEST_RATING = 5.0
NO_GENRES = "(no genres listed)"
UNKNOWN_TITLE = "Unknown"
TRAILING_YEAR = r"\((\d{4})\)\s*$"
TOKEN = r"[\p{L}\p{N}_]{2,}"


def clamp(score: Column, low: float = LOWEST_RATING, high: float = HIGHEST_RATING) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), score))


def trailing_year(title: Column) -> Column:
    """Year of a title that ends in ``(YYYY)``, else null."""
    return F.nullif(F.regexp_extract(title, TRAILING_YEAR, 1), F.lit("")).cast("int")


def release_year(date: Column) -> Column:
    """Leading year of an ISO date, null unless those characters are all digits."""
    head = F.substring(date, 1, 4)
    return F.when(head.rlike("^[0-9]+$"), head.try_cast("int"))


def release_year_or_zero(date: Column) -> Column:
    """Leading year of an ISO date, 0 for short or missing dates."""
    year = F.when(F.length(date) >= 4, F.substring(date, 1, 4).try_cast("int"))
    return F.coalesce(year, F.lit(0))


def comma_tokens(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda token: F.lower(F.trim(token)))


def has_all_tokens(text: Column, tokens: Column) -> Column:
    lowered = F.lower(text)
    return F.forall(tokens, lambda token: F.contains(lowered, token))


def has_token(text: Column, token: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(NO_GENRES))), F.lit(token.lower()))


def matches_any(text: Column, terms: list[str]) -> Column:
    """Lower-cased text matches one of the regular expressions."""
    return F.lower(text).rlike("|".join(terms))


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def display_title(title: Column, date: Column) -> Column:
    year = F.substring(F.coalesce(date, F.lit("")), 1, 4)
    return F.when(year != "", F.concat(title, F.lit(" ("), year, F.lit(")"))).otherwise(title)


def joined_genres(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.array_join(names, "|")).otherwise(F.lit(NO_GENRES))


def positive_or(value: Column, default: Column) -> Column:
    return F.when(value > 0, value).otherwise(default)


def bayesian_average(mean: Column, count: Column, prior_mean: Column, prior_count: float) -> Column:
    return (count * mean + F.lit(prior_count) * prior_mean) / (count + F.lit(prior_count))


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / std


def usable_std(std: Column) -> Column:
    return F.when(std > 1e-9, std).otherwise(F.lit(1.0))


def billing_weight(order: Column) -> Column:
    return F.lit(1.0) / (order + F.lit(1))


def sublinear_tf(count: Column) -> Column:
    return F.lit(1.0) + F.ln(count)


def smooth_idf(documents: Column, document_frequency: Column) -> Column:
    return F.ln((F.lit(1.0) + documents) / (F.lit(1.0) + document_frequency)) + F.lit(1.0)


def seeded_unit(seed: int | str, *columns: Column) -> Column:
    """Number in [0, 1) that depends on the seed and the values only.

    The same row gets the same number whatever the partitioning, so samples and
    splits built on it are the same after a retry or a repartition.
    """
    text = F.concat_ws("-", F.lit(str(seed)), *[c.cast("string") for c in columns])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)
