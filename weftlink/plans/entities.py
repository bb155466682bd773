"""Two overlapping sources made from the customer and nation tables, in SQL that Spark and DuckDB read alike.

A has the customers of remainders 0-84 by 100, B those of 15-99, so seven tenths are in both. B's values are changed by
fixed remainders of the key: case, endings, phone form, missing values, house numbers. Some rows of either side occur
twice, some of B have lost all that could find them or keep them, and some are outdone by a decoy of another entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .model import Mapping

MAPPINGS = (
    Mapping("name", "name", "name", "name_or_title"),
    Mapping("phone", "phone", "phone", "phone", "phone"),
    Mapping("email", "email", "email", "email", "email"),
    Mapping("address", "address", "address", "address"),
    Mapping("city", "city", "city", "geography"),
    Mapping("segment", "segment", "segment", "categorical"),
    Mapping("contact", "contact", "contact", "contact_person"),
    Mapping("ref", "ref", "ref", "persistent_identifier"),
)


def _pick(words: str, n: str) -> str:
    return f"split_part('{words}', ' ', CAST(({n}) % {len(words.split())} AS INT) + 1)"


_BASE = f"""
SELECT c_custkey AS k, CAST(floor(c_custkey / 10) AS BIGINT) AS k1, CAST(floor(c_custkey / 130) AS BIGINT) AS k2,
  {_pick("Amber Brisk Cedar Delta Ember Frost Grand Harbor Iron Jade", "c_custkey")} AS w1,
  {_pick("Analytics Bakery Clinic Dental Energy Foods Gallery Hardware Imaging Joinery Kitchens Labs Motors", "CAST(floor(c_custkey / 10) AS BIGINT)")} AS w2,
  {_pick("North South East West Upper Lower Inner Outer Old New Great Little Far Near", "CAST(floor(c_custkey / 130) AS BIGINT)")} AS w3,
  concat({_pick("Ba Ce Di Fo Gu Ha Je Ki Lo Mu Na Pe Qi Ro Su Ta Ve Wi Xo Yu Za Be Co Du", "CAST(floor(c_custkey / 3) AS BIGINT)")}, {_pick("ne ro sa ti vu wa xo ly bi cu de fa go hi jo ku", "CAST(floor(c_custkey / 72) AS BIGINT)")}, {_pick("dan fel gim hop jur kel mos", "CAST(floor(c_custkey / 1152) AS BIGINT)")}, {_pick("ta su ra", "CAST(floor(c_custkey / 8064) AS BIGINT)")}) AS w4,
  {_pick("Inc LLC Corp Ltd Company", "c_custkey")} AS ending,
  {_pick("Ada Ben Cleo Dan Eva Finn Gus Hope Ida Jon Kim", "c_custkey")} AS first_name,
  {_pick("Moss Reed Stone Vale Wood Hill Lake", "CAST(floor(c_custkey / 7) AS BIGINT)")} AS last_name,
  {_pick("Market Oak Pine Maple Cedar Elm", "c_custkey")} AS street,
  concat(CAST(c_custkey % 25 + 10 AS STRING), '-', lpad(CAST((c_custkey * 7919) % 1000 AS STRING), 3, '0'), '-', lpad(CAST((c_custkey * 3571) % 1000 AS STRING), 3, '0'), '-', lpad(CAST((c_custkey * 4243) % 10000 AS STRING), 4, '0')) AS c_phone,
  n_name, r_name, c_mktsegment, CAST(floor(c_acctbal) AS BIGINT) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
_A = """
SELECT concat('A-', lpad(CAST(k AS STRING), 9, '0'), twin) AS row_id, CASE WHEN twin = '' THEN concat(w1, ' ', w2, ' ', w3, ' ', w4, ' ', ending) ELSE lower(concat(w1, ' ', w2, ' ', w3, ' ', w4)) END AS name,
  CASE WHEN k % 17 = 0 THEN '' ELSE c_phone END AS phone,
  CASE WHEN k % 11 = 0 THEN '' ELSE concat('user', CAST(k AS STRING), '@host', CAST(k % 97 AS STRING), '.example.com') END AS email,
  concat(CAST(k % 900 + 100 AS STRING), ' ', street, ' Street') AS address, n_name AS city, r_name AS region, CASE WHEN k % 67 = 0 THEN concat('NICHE ', CAST(k AS STRING)) ELSE c_mktsegment END AS segment,
  CAST(balance AS STRING) AS balance, concat(first_name, ' ', last_name, ' ', w4) AS contact,
  CASE WHEN k % 3 = 0 THEN concat('C', lpad(CAST(k AS STRING), 8, '0')) ELSE '' END AS ref,
  concat('2024-', lpad(CAST(k % 12 + 1 AS STRING), 2, '0'), '-', lpad(CAST(k % 28 + 1 AS STRING), 2, '0')) AS updated_at,
  concat('https://www.host', CAST(k % 97 AS STRING), '.example.com/about') AS website, k AS entity_id
FROM (SELECT *, '' AS twin FROM base UNION ALL SELECT *, '-2' AS twin FROM base WHERE k % 47 = 0) t WHERE k % 100 < 85
"""
# lost: nothing that a blocker reads is left; faint: only the phone is; weak: no strong value but the name, beside a decoy that has all
_B = """
SELECT concat('B-', lpad(CAST(k AS STRING), 9, '0'), twin) AS row_id,
  CASE WHEN lost OR faint THEN concat('Zz', CAST(k * 7 AS STRING), ' Holding') WHEN k % 5 = 0 THEN upper(concat(w1, ' ', w2, ' ', w3, ' ', w4)) WHEN k % 7 = 0 THEN concat(w1, ' ', w2, ' ', w4, ' ', substr(w3, 1, 3), '.') ELSE concat(w1, ' ', w2, ' ', w3, ' ', w4, ', ', ending) END AS name,
  CASE WHEN lost OR weak OR k % 19 = 0 THEN '' WHEN k % 4 = 0 THEN replace(c_phone, '-', '.') WHEN k % 23 = 0 THEN concat(substr(c_phone, 1, 11), '0000') ELSE c_phone END AS phone,
  CASE WHEN lost OR weak OR k % 13 = 0 THEN '' WHEN k % 3 = 0 AND NOT faint THEN upper(concat('user', CAST(k AS STRING), '@host', CAST(k % 97 AS STRING), '.example.com')) WHEN faint OR k % 31 = 0 THEN concat('other', CAST(k AS STRING), '@host', CAST(k % 97 AS STRING), '.example.com')
    ELSE concat('user', CAST(k AS STRING), '@host', CAST(k % 97 AS STRING), '.example.com') END AS email,
  CASE WHEN lost OR faint THEN concat('PO Box ', CAST(k * 13 AS STRING)) ELSE concat(CAST(CASE WHEN k % 29 = 0 THEN k % 900 + 101 ELSE k % 900 + 100 END AS STRING), ' ', street, CASE WHEN k % 2 = 0 THEN ' St.' ELSE ' Street' END) END AS address,
  CASE WHEN lost OR faint THEN concat('Q', CAST(k AS STRING)) WHEN k % 37 = 0 THEN concat(n_name, 'S') ELSE n_name END AS city, r_name AS region, CASE WHEN k % 67 = 0 THEN concat('NICHE ', CAST(k AS STRING)) ELSE c_mktsegment END AS segment, CAST(balance + k % 2 AS STRING) AS balance,
  CASE WHEN lost OR faint THEN concat('Zed ', CAST(k AS STRING)) WHEN k % 6 = 0 THEN concat(substr(first_name, 1, 1), ' ', last_name, ' ', w4) ELSE concat(first_name, ' ', last_name, ' ', w4) END AS contact,
  CASE WHEN lost OR weak THEN '' WHEN faint THEN concat('X', CAST(k AS STRING)) WHEN k % 3 = 0 THEN concat('C', lpad(CAST(CASE WHEN k % 41 = 0 THEN k + 1 ELSE k END AS STRING), 8, '0')) ELSE '' END AS ref,
  CASE WHEN k % 9 = 0 THEN 'n/a' ELSE concat('2024-', lpad(CAST((k + 5) % 12 + 1 AS STRING), 2, '0'), '-', lpad(CAST(k % 28 + 1 AS STRING), 2, '0'), 'T10:00:00Z') END AS updated_at,
  concat('http://host', CAST(k % 97 AS STRING), '.example.com:8080') AS website, CASE WHEN twin = '-d' THEN -k ELSE k END AS entity_id
FROM (SELECT *, '' AS twin, k % 53 = 0 AS lost, k % 61 = 0 AND k % 53 <> 0 AS faint, k % 59 = 0 AS weak FROM base
  UNION ALL SELECT *, '-2', k % 53 = 0, k % 61 = 0 AND k % 53 <> 0, false FROM base WHERE k % 43 = 0 UNION ALL SELECT *, '-d', false, false, false FROM base WHERE k % 59 = 0) t WHERE k % 100 >= 15
"""


def side_sql(side: str) -> str:
    """A query over customer, nation and region that gives one source."""
    return f"WITH base AS ({_BASE}) {_A if side == 'A' else _B}"


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sources A and B over a folder of tables."""
    from pyspark.sql import functions as F

    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region")}
    a, b = (spark.sql(side_sql(side).replace("FROM customer JOIN nation", "FROM {customer} JOIN {nation}").replace("JOIN region", "JOIN {region}"), **tables) for side in "AB")
    return a.select(*a.columns), b.select(*[F.col(c) for c in b.columns])
