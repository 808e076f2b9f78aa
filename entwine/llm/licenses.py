"""License scans: canonical digest lookup.

A text's canonical form is in lower case, without copyright lines, with every run of
other characters than letters and digits as one space, and with equivalent spellings
made one. Whole texts, and single lines of them, are looked up by the SHA-256 of
that form: whole texts in a hash join with the digests of known licences, lines among the
known notices, of which there are at most MAX_NOTICES.

Defined results. Null text has the digest of the empty text and is no licence. An empty
table gives an empty result; repeated rows get a row each; very long texts are
canonicalised whole. Extra columns are not read and can have any name.
"""

from __future__ import annotations

import hashlib

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.functions.session import bounded
from entwine.llm.license_digests import DIGESTS
from entwine.llm.license_texts import NOTICES, TEXTS

MAX_NOTICES = 1000
#: Lines that state a copyright: the sign, or the word with its abbreviation, or either of these with a year; and "all rights reserved". A lettered clause "(c)" stays.
COPYRIGHT = r"(^|\n)[^\p{L}\p{N}\n]*(?:copyright[ \t]*(?:\(c\)|©)[^\n]*|©[^\n]*|(?:\(c\)|copyright)[^\p{L}\n]*[0-9]{4}[^\n]*|all rights reserved)"
OTHER = r"[^\p{L}\p{N}]+"
#: Spellings that licence matching treats alike, the second being kept.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("fulfilment", "fulfillment"),
    ("copyright owner", "copyright holder"),
    ("http ", "https "),
)
#: A line can be one of NOTICES only if it has one of these; any other notice is looked for in all lines.
HINTS = ("licen", "public domain", "cc0")


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "\n")
    out = F.trim(F.regexp_replace(out, OTHER, " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def canonical_of(text: str) -> str:
    """canonical() of one string, on the driver."""
    out = regex.sub(COPYRIGHT, "\n", text.lower())
    out = regex.sub(OTHER, " ", out).strip(" ")
    for old, new in SPELLINGS:
        out = out.replace(old, new)
    return out


def digest_of(text: str) -> str:
    return hashlib.sha256(canonical_of(text).encode()).hexdigest()


def known(texts: dict[str, str]) -> dict[str, str]:
    """Digest -> name without what stands in brackets; of texts that are alike the least name."""
    out: dict[str, str] = {}
    for name in sorted(texts):
        out.setdefault(digest_of(texts[name]), name.split(" (")[0])
    return out


def known_whole() -> dict[str, str]:
    """Digests that a whole text is looked up among: licences and notices."""
    return {d: name.split(" (")[0] for d, name in DIGESTS.items()} | known(NOTICES) | known(TEXTS)


def catalogue(spark: SparkSession, digests: dict[str, str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(d).alias("known"), F.lit(n).alias("license")) for d, n in digests.items()])
    return spark.range(1).select(F.explode(pairs).alias("p")).select("p.known", "p.license")


def scan(docs: DataFrame, texts: DataFrame | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest, license, notices, notice_lines for every row of docs (doc_id, text).

    license: the known licence whose whole text this is, else null. notices: names of the
    known notices among the lines, in order, joined by `;`, else null. texts: (known, license),
    distinct digests with names.
    """
    texts = catalogue(docs.sparkSession, known_whole()) if texts is None else texts
    names = known(NOTICES if notices is None else notices)
    if len(names) > MAX_NOTICES:
        raise ValueError(f"more than {MAX_NOTICES} notices")
    text = F.coalesce("text", F.lit(""))
    lines = F.split(F.col("text"), "\n")
    if notices is None:
        lines = F.filter(lines, lambda x: F.lower(x).rlike("|".join(HINTS)))
    lookup = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    found = F.array_compact(F.transform(lines, lambda x: F.try_element_at(lookup, F.sha2(canonical(x), 256))))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), found.alias("found"))
    joined = rows.join(bounded(texts), F.col("digest") == F.col("known"), "left")
    listed = F.when(F.size("found") > 0, F.array_join(F.array_sort(F.array_distinct("found")), ";"))
    return joined.select("doc_id", "digest", "license", listed.alias("notices"), F.size("found").cast("long").alias("notice_lines"))
