"""Normalisation of names, addresses and countries, as column expressions.

The Unicode decomposition is ICU's, which Spark ships, called by the SQL function
reflect(); all else is regular expressions, so that nothing leaves the JVM. On raw text,
where `\\b` and `\\d` mean Unicode words and digits, look-arounds say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entwine.schema import LEGAL_SUFFIXES, NORMALISED

NO_WORD_BEFORE, NO_WORD_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def ascii_fold(text: Column) -> Column:
    """Compatibility decomposition without what is not ASCII; null is empty."""
    split = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.regexp_replace(split, r"[^\x00-\x7F]", "")


def _plain(folded: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(folded), r"[^\w\s]", " "), r"[\s\x1c-\x1f]+", " "))


def normalize_text(text: Column) -> Column:
    return _plain(ascii_fold(text))


def normalize_country(country: Column) -> Column:
    return normalize_text(country)


def normalize_business_name(name: Column) -> Column:
    """The basic form, without words for the ampersand."""
    return normalize_text(name)


def normalize_business_name_advanced(name: Column) -> Column:
    return normalize_text(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")))


def business_name_core(normalized: Column) -> Column:
    """Without legal suffixes at the end, however many."""
    return F.trim(F.regexp_replace(normalized, rf"(?:\s*\b(?:{'|'.join(LEGAL_SUFFIXES)})\b)+$", ""))


def normalize_business_address(address: Column) -> Column:
    out = normalize_text(address)
    for short, whole in (("rd", "road"), ("st", "street"), ("ave", "avenue")):
        out = F.regexp_replace(out, rf"\b{short}\b", whole)
    return out


def postal_code(address: Column) -> Column:
    """The last number of 5 or 6 digits of the raw address, else the empty string."""
    found = F.regexp_extract_all(F.coalesce(address, F.lit("")), F.lit(rf"{NO_WORD_BEFORE}\p{{Nd}}{{5,6}}{NO_WORD_AFTER}"), F.lit(0))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def numeric_tokens(address: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(address, F.lit("")), F.lit(rf"{NO_WORD_BEFORE}\p{{Nd}}+{NO_WORD_AFTER}"), F.lit(0))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def split_list(listed: Column, separator: str = ",") -> Column:
    """The non-empty parts of a separated list; null and blank lists have none."""
    parts = F.filter(F.split(F.coalesce(listed, F.lit("")), separator), lambda x: x != "")
    return F.when(F.trim(F.coalesce(listed, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(parts)


def preprocess(records: DataFrame) -> DataFrame:
    """records with the eight normalised columns; what was there stays as it was."""
    first = records.withColumns(
        {
            "business_name_normalized": normalize_business_name_advanced(F.col("business_name")),
            "business_address_normalized": normalize_business_address(F.col("business_address")),
            "country_normalized": normalize_country(F.col("country")),
        }
    )
    second = first.withColumns(
        {
            "business_name_core": business_name_core(F.col("business_name_normalized")),
            "business_name_tokens": tokens(F.col("business_name_normalized")),
            "business_address_postal": postal_code(F.col("business_address")),
            "business_address_numeric_tokens": numeric_tokens(F.col("business_address")),
            "business_address_tokens": tokens(F.col("business_address_normalized")),
        }
    )
    return second.select(*records.columns, *NORMALISED)
