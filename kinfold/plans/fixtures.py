"""The reference concepts over the driver tables, in Spark and as SQL for DuckDB.

Star fixture: customers are entities, every order is a record. An order with ``o_orderkey % 4 = 1`` is an
orphan, any other belongs to its customer. Candidates of a record are its customer
and two decoys of the same country (``custkey % 5``); probabilities are exact integer fractions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.sources.scans import spread, table


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; texts are dealt to all cores where the table is small."""
    df = table(spark, sf, name)
    return spread(df) if name == "documents" else df


def records(spark: SparkSession, sf: str) -> DataFrame:
    """(country, src, rec, parent, cust)."""
    o = read(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 5).alias("country"), (2 + F.col("o_orderkey") % 2).alias("src"), F.col("o_orderkey").alias("rec"), F.when(F.col("o_orderkey") % 4 == 1, -1).otherwise(F.col("o_custkey")).alias("parent"), F.col("o_custkey").alias("cust"))


RECORDS = """records as (select o_custkey % 5 country, 2 + o_orderkey % 2 src, o_orderkey rec,
  case when o_orderkey % 4 = 1 then -1 else o_custkey end parent, o_custkey cust from orders)"""


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """(country, s1, k, fold, name)."""
    k = records(spark, sf).where("parent >= 0").groupBy(F.col("parent").alias("s1")).agg(F.count(F.lit(1)).alias("k"))
    c = read(spark, sf, "customer").select((F.col("c_custkey") % 5).alias("country"), F.col("c_custkey").alias("s1"), F.col("c_mktsegment").alias("name"))
    return c.join(k, "s1", "left").select("country", "s1", F.coalesce("k", F.lit(0)).alias("k"), (F.col("s1") * 31 % 7 % 5).cast("int").alias("fold"), "name")


ENTITIES = """entities as (select c_custkey % 5 country, c_custkey s1, coalesce(k, 0) k, cast(c_custkey * 31 % 7 % 5 as integer) fold, c_mktsegment as name
  from customer left join (select parent, count(*) k from records where parent >= 0 group by 1) on parent = c_custkey)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(country, src, rec, s1, p, label)."""
    r = records(spark, sf)
    n = read(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n"))
    t = r.crossJoin(F.broadcast(n))
    decoys = F.array_distinct(F.array("cust", (F.col("cust") + 5) % F.col("n"), (F.col("cust") + 5 * (F.col("rec") % 97 + 2)) % F.col("n")))
    t = t.select("country", "src", "rec", "parent", F.explode(decoys).alias("s1"))
    p = (F.col("rec") * 7919 + F.col("s1") * 104729) % 1000003 / F.lit(1000003.0)
    return t.select("country", "src", "rec", "s1", p.alias("p"), (F.col("parent") == F.col("s1")).cast("int").alias("label"))


PAIRS = """pairs as (select distinct country, src, rec, s1, ((rec * 7919 + s1 * 104729) % 1000003)::double / 1000003::double p, cast(parent = s1 as integer) label
  from (select country, src, rec, parent, unnest([cust, (cust + 5) % n, (cust + 5 * (rec % 97 + 2)) % n]) s1 from records, (select count(*) n from customer)))"""

STAR = f"with {RECORDS}, {ENTITIES}, {PAIRS}"


def dense_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two retrievers' candidates: by p from 0.35 on, and by another fraction from 0.5 on."""
    t = pairs(spark, sf)
    a = t.where("p >= 0.35").select("country", "src", "rec", "s1", F.col("p").alias("score"), F.lit(0).alias("rank"), F.round(F.col("p") / 2, 6).alias("cos"))
    c = (F.col("rec") * 31 + F.col("s1") * 17) % 1009 / F.lit(1009.0)
    b = t.withColumn("cos", F.round(c, 6)).where("cos >= 0.5").select("country", "src", "rec", "s1", "cos", (F.col("rec") % 4 - 1).cast("int").alias("drank_rec"), (F.col("s1") % 5 - 1).cast("int").alias("drank_s1"))
    return a, b


RETRIEVERS = """tf as (select country, src, rec, s1, p score, 0 rank, round(p / 2, 6) cos from pairs where p >= 0.35),
 de as (select * from (select country, src, rec, s1, round(((rec * 31 + s1 * 17) % 1009)::double / 1009::double, 6) cos, cast(rec % 4 - 1 as integer) drank_rec, cast(s1 % 5 - 1 as integer) drank_s1 from pairs) where cos >= 0.5)"""


def name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(id, a, b): part names against the next part's type, texts with shared words and numbers."""
    p = read(spark, sf, "part")
    b = p.select((F.col("p_partkey") - 1).alias("_k"), F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("b"))
    return p.select(F.col("p_partkey").alias("id"), F.lower(F.concat_ws(" ", "p_brand", "p_name")).alias("a")).join(b, F.col("id") == F.col("_k")).select("id", "a", "b")


NAMES = """names as (select x.p_partkey id, lower(concat_ws(' ', x.p_brand, x.p_name)) a, lower(concat_ws(' ', y.p_name, y.p_brand)) b from part x join part y on y.p_partkey = x.p_partkey + 1)"""
