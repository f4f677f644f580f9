"""The relational questions asked of a knowledge table, one query a shape, over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans import synth
from .queries import KB, query, t


@query(f"WITH {KB} SELECT company, role, product FROM kb WHERE category = 'Tier 1/2'")
def equality_filter(spark, sf_dir):
    return synth.knowledge(spark, sf_dir).filter("Category = 'Tier 1/2'").select(F.col("Company").alias("company"), F.col("EV Supply Chain Role").alias("role"), F.col("Product / Service").alias("product"))


@query(f"WITH {KB} SELECT company, category FROM kb WHERE role IN ('Battery Cell', 'Battery Pack')")
def in_filter(spark, sf_dir):
    return synth.knowledge(spark, sf_dir).filter(F.col("EV Supply Chain Role").isin("Battery Cell", "Battery Pack")).select(F.col("Company").alias("company"), F.col("Category").alias("category"))


@query("SELECT DISTINCT p_brand, p_type FROM part WHERE p_name = 'red widget'")
def lookup_by_name(spark, sf_dir):
    return t(spark, sf_dir, "part").filter("p_name = 'red widget'").select("p_brand", "p_type").distinct()


@query(f"WITH {KB} SELECT company FROM kb WHERE category IN ('Tier 1', 'Tier 2') AND facility = 'Headquarters' AND contains(lower(product), 'line 1')")
def conjunctive_filter(spark, sf_dir):
    k = synth.knowledge(spark, sf_dir)
    return k.filter(F.col("Category").isin("Tier 1", "Tier 2") & (F.col("Primary Facility Type") == "Headquarters") & F.lower("Product / Service").contains("line 1")).select(F.col("Company").alias("company"))


@query(f"WITH {KB} SELECT count(*) AS n FROM kb WHERE employment < 200 AND category = 'Tier 3'")
def range_count(spark, sf_dir):
    return synth.knowledge(spark, sf_dir).filter("Employment < 200 AND Category = 'Tier 3'").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'gear|bolt|plate')")
def keyword_filter(spark, sf_dir):
    return t(spark, sf_dir, "part").filter(F.lower("p_name").rlike("gear|bolt|plate")).select("p_partkey", "p_name")


@query(f"WITH {KB} SELECT company FROM kb WHERE role = 'Materials' OR regexp_matches(product, 'line (3|5)$')")
def equality_or_keyword(spark, sf_dir):
    k = synth.knowledge(spark, sf_dir)
    return k.filter((F.col("EV Supply Chain Role") == "Materials") | F.col("Product / Service").rlike("line (3|5)$")).select(F.col("Company").alias("company"))


@query(f"WITH {KB} SELECT category, role, array_to_string(list_sort(list_distinct(list(company))), ',') AS companies FROM kb GROUP BY 1, 2")
def group_by_two_keys(spark, sf_dir):
    return synth.knowledge(spark, sf_dir).groupBy(F.col("Category").alias("category"), F.col("EV Supply Chain Role").alias("role")).agg(F.array_join(F.array_sort(F.collect_set("Company")), ",").alias("companies"))


@query(f"WITH {KB} SELECT company, employment FROM kb WHERE category = 'OEM' AND employment IS NOT NULL ORDER BY employment DESC, company LIMIT 1")
def argmax_in_group(spark, sf_dir):
    k = synth.knowledge(spark, sf_dir).filter("Category = 'OEM' AND Employment IS NOT NULL")
    return k.orderBy(F.desc("Employment"), "Company").limit(1).select(F.col("Company").alias("company"), F.col("Employment").alias("employment"))


@query(f"WITH {KB} SELECT county, sum(employment) AS total FROM kb GROUP BY 1 ORDER BY total DESC NULLS LAST, county LIMIT 1")
def group_sum_top_one(spark, sf_dir):
    g = synth.knowledge(spark, sf_dir).groupBy("county").agg(F.sum("Employment").alias("total"))
    return g.orderBy(F.desc_nulls_last("total"), "county").limit(1)


@query(f"WITH {KB} SELECT company, employment FROM kb WHERE employment IS NOT NULL ORDER BY employment DESC, company LIMIT 10")
def top_n(spark, sf_dir):
    return synth.knowledge(spark, sf_dir).filter("Employment IS NOT NULL").orderBy(F.desc("Employment"), "Company").limit(10).select(F.col("Company").alias("company"), F.col("Employment").alias("employment"))


@query(f"WITH {KB} SELECT oems, role, min(company) AS company FROM kb GROUP BY 1, 2 HAVING count(DISTINCT company) = 1")
def having_one(spark, sf_dir):
    k = synth.knowledge(spark, sf_dir).groupBy(F.col("Primary OEMs").alias("oems"), F.col("EV Supply Chain Role").alias("role"))
    return k.agg(F.min("Company").alias("company"), F.count_distinct("Company").alias("n")).filter("n = 1").drop("n")


@query(f"WITH {KB} SELECT count(*) AS n, sum(employment) AS total, avg(employment) AS mean FROM kb WHERE relevant = 'Indirect'")
def count_and_sum(spark, sf_dir):
    k = synth.knowledge(spark, sf_dir).filter("`EV / Battery Relevant` = 'Indirect'")
    return k.agg(F.count("*").alias("n"), F.sum("Employment").alias("total"), F.avg("Employment").alias("mean"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def two_memberships(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    both = o.filter("o_orderpriority in ('1-URGENT', '5-LOW')").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n")).filter("n = 2")
    return t(spark, sf_dir, "customer").join(both, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query(f"WITH {KB} SELECT county, count(*) AS n, count(DISTINCT role) AS roles FROM kb WHERE county IN (SELECT county FROM kb WHERE category = 'OEM') GROUP BY 1")
def groups_that_hold(spark, sf_dir):
    g = synth.knowledge(spark, sf_dir).groupBy("county").agg(F.count("*").alias("n"), F.count_distinct("EV Supply Chain Role").alias("roles"), F.bool_or(F.col("Category") == "OEM").alias("any"))
    return g.filter("any").drop("any")


@query("SELECT r_name, n_name, count(DISTINCT s_suppkey) AS suppliers, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2")
def revenue_by_area(spark, sf_dir):
    """Employment summed by area, at the size of line items: the filter reaches the scan, revenue is summed by supplier
    before any join, and what is joined is a row a supplier."""
    l = t(spark, sf_dir, "lineitem").filter("l_shipdate < timestamp'1998-01-01'").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    s = l.join(t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.groupBy("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("r"), 2).alias("revenue"))
