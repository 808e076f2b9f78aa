"""Business records from the driver's pages: three sources and a ground truth.

Every page is a record: page_id % 3 says in which source, the title is the name, the
document's language the country, and the address is made from the length of the page and
the host. True matches are pages whose titles have the same letters a to z. So that there are suffixes,
collisions, misses and unknown countries too, some records of the second and third source are
changed after that: names get a legal suffix or marks, or become a bare number; countries become `xx`; some records share a box number as address.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.functions.text import preprocess


@dataclass
class Sources:
    s1: DataFrame
    s2: DataFrame
    s3: DataFrame
    truth: DataFrame
    every: DataFrame | None = None  # the three sources with their number, of one scan


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records(), with the title of the page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    size, i = F.length("html"), F.col("page_id")
    source = F.pmod(i, F.lit(3)) + 1
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    name = F.when((source > 1) & (F.pmod(i, F.lit(11)) == 2), F.concat(F.lit("Unit "), i.cast("string")))
    name = name.when((source == 2) & (F.pmod(i, F.lit(4)) == 1), F.concat(title, F.lit(", Ltd."))).when((source == 3) & (F.pmod(i, F.lit(5)) == 0), F.concat(title, F.lit(" !!!")))
    address = F.concat(size.cast("string"), F.lit(" "), host, F.lit(" St "), (10000 + size % 900).cast("string"))
    address = F.when((source < 3) & F.pmod(i, F.lit(13)).isin(3, 4), F.lit("PO Box 12")).otherwise(address)
    country = F.when((source == 2) & (F.pmod(i, F.lit(7)) == 3), F.lit("xx")).otherwise(F.regexp_extract("html", 'lang="([a-z]*)"', 1))
    return pages.select(
        F.concat(F.lit("S"), source.cast("string"), F.lit("-"), i.cast("string")).alias("entity_id"),
        name.otherwise(title).alias("business_name"),
        address.alias("business_address"),
        country.alias("country"),
        source.cast("int").alias("source"),
        title.alias("title"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, business_name, business_address, country, source."""
    return _titled(spark, sf_dir).drop("title")


def sources(spark: SparkSession, sf_dir: str) -> Sources:
    every = _titled(spark, sf_dir)
    one, two, three = (every.where(F.col("source") == i).drop("source", "title") for i in (1, 2, 3))
    letters = every.withColumn("letters", F.regexp_replace(F.lower("title"), "[^a-z]", "")).where("letters <> ''")
    # a list is made once for all titles of the same letters; only ids that several records have unite theirs, id by id
    lists = letters.where("source > 1").groupBy("letters").agg(F.array_sort(F.collect_set("entity_id")).alias("ids"))
    own = every.where("source = 1").withColumn("letters", F.regexp_replace(F.lower("title"), "[^a-z]", ""))
    own = own.groupBy("entity_id").agg(F.count(F.lit(1)).alias("records"), F.collect_set(F.when(F.col("letters") != "", F.col("letters"))).alias("keys"))
    joined = F.array_join("ids", ",")
    usual = own.where(F.size("keys") <= 1).withColumn("letters", F.try_element_at("keys", F.lit(1)))
    usual = usual.join(lists.select("letters", joined.alias("listed")), "letters", "left").select("entity_id", "records", "listed")
    several = own.where(F.size("keys") > 1).select("entity_id", "records", F.explode("keys").alias("letters")).join(lists, "letters", "left").groupBy("entity_id", "records")
    several = several.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids")).select("entity_id", "records", joined.alias("listed"))
    truth = usual.unionByName(several).withColumn("record", F.explode(F.sequence(F.lit(1), F.col("records").cast("int"))))
    return Sources(one, two, three, truth.select(F.col("entity_id").alias("source1_entity_id"), F.coalesce("listed", F.lit("")).alias("matched_entity_ids")))


def normalised(spark: SparkSession, sf_dir: str) -> Sources:
    got = sources(spark, sf_dir)
    return Sources(preprocess(got.s1), preprocess(got.s2), preprocess(got.s3), got.truth, preprocess(records(spark, sf_dir)))


PREP_SQL = r"""
pages_in AS (
  SELECT page_id, length(html) AS size, regexp_extract(url, '://([^/?#]*)', 1) AS host, (page_id % 3 + 1)::INTEGER AS source,
    regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang="([a-z]*)"', 1) AS lang FROM pages
), raw AS (
  SELECT 'S' || source || '-' || page_id AS entity_id, title,
    CASE WHEN source > 1 AND page_id % 11 = 2 THEN 'Unit ' || page_id WHEN source = 2 AND page_id % 4 = 1 THEN title || ', Ltd.' WHEN source = 3 AND page_id % 5 = 0 THEN title || ' !!!' ELSE title END AS business_name,
    CASE WHEN source = 2 AND page_id % 7 = 3 THEN 'xx' ELSE lang END AS country, source, 
    CASE WHEN source < 3 AND page_id % 13 IN (3, 4) THEN 'PO Box 12' ELSE size || ' ' || host || ' St ' || (10000 + size % 900) END AS business_address FROM pages_in
), plain AS (
  SELECT *,
    trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(replace(lower(business_name), '&', ' and ')), '[^\x00-\x7F]', '', 'g')), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS business_name_normalized,
    trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(business_name), '[^\x00-\x7F]', '', 'g')), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS business_name_basic,
    trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(business_address), '[^\x00-\x7F]', '', 'g')), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS address_plain,
    trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(country), '[^\x00-\x7F]', '', 'g')), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS country_normalized
  FROM raw
), prep AS (
  SELECT * EXCLUDE (address_plain),
    trim(regexp_replace(business_name_normalized, '(?:\s*\b(?:inc|llc|corp|corporation|ltd|limited|pvt|private|co|company)\b)+$', '')) AS business_name_core,
    list_filter(string_split(business_name_normalized, ' '), lambda x: x <> '') AS business_name_tokens,
    regexp_replace(regexp_replace(regexp_replace(address_plain, '\brd\b', 'road', 'g'), '\bst\b', 'street', 'g'), '\bave\b', 'avenue', 'g') AS business_address_normalized,
    coalesce(regexp_extract_all(business_address, '\b[0-9]{5,6}\b')[-1], '') AS business_address_postal,
    regexp_extract_all(business_address, '\b[0-9]+\b') AS business_address_numeric_tokens
  FROM plain
), full_prep AS (
  SELECT *, list_filter(string_split(business_address_normalized, ' '), lambda x: x <> '') AS business_address_tokens FROM prep
), s1 AS (SELECT * FROM full_prep WHERE source = 1), s2 AS (SELECT * FROM full_prep WHERE source = 2), s3 AS (SELECT * FROM full_prep WHERE source = 3),
pool AS (SELECT *, CASE WHEN source = 2 THEN 's2' ELSE 's3' END AS candidate_source FROM full_prep WHERE source > 1),
letters AS (SELECT entity_id, source, regexp_replace(lower(title), '[^a-z]', '', 'g') AS letters FROM full_prep),
truth AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id FROM letters a JOIN letters b USING (letters) WHERE letters <> '' AND a.source = 1 AND b.source > 1),
truth_lists AS (
  SELECT entity_id AS source1_entity_id, coalesce(listed, '') AS matched_entity_ids FROM s1
  LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY cand_id) AS listed FROM truth GROUP BY 1) ON entity_id = s1_id
)
"""
