"""Registered queries of greedy grouping and of functions called from SQL text."""
from pyspark.sql import functions as F

from .functions import tables, text
from .operators import aggregates, grouping, statistics
from .queries import register, table


@register("""
WITH r AS (SELECT p_partkey AS k, p_name AS t, p_size > 40 AS odd, p_brand AS v, p_type LIKE '%PROMO%' OR p_brand = 'Brand#11' AS free, p_retailprice AS price FROM part),
b AS (SELECT t, odd, list({'k': k, 'v': v, 'f': free, 'l': [k], 'g': [{'k': k, 'v': v, 'f': free}]} ORDER BY k) AS rows FROM r GROUP BY t, odd),
g AS (SELECT t, odd, rows, list_reduce(rows, lambda a, x: CASE WHEN len(list_filter(a.g, lambda o: o.v = x.v OR o.f OR x.f)) > 0 THEN a ELSE {'k': a.k, 'v': a.v, 'f': a.f, 'l': a.l, 'g': a.g || x.g} END).g AS firsts FROM b),
e AS (SELECT t, odd, firsts, unnest(rows) AS x FROM g), n AS (SELECT x.k AS k, list_min(list_transform(list_filter(firsts, lambda o: o.v = x.v OR o.f OR x.f), lambda o: o.k)) AS first FROM e)
SELECT r.k AS p_partkey, first, row_number() OVER (PARTITION BY first ORDER BY price DESC, r.k DESC) = 1 AS kept FROM r JOIN n ON r.k = n.k""")
def duplicate_parts(spark, sf_dir):
    """Parts of one name and size class are one if their brands are equal or one of the two may be any; the dearest of a
    group, the last of these, is kept."""
    p = table(spark, sf_dir, "part").withColumn("odd", F.col("p_size") > 40)
    free = F.contains("p_type", F.lit("PROMO")) | (F.col("p_brand") == "Brand#11")
    g = grouping.first_groups(p, ["p_name", "odd"], "p_partkey", F.col("p_brand"), free, "first")
    best = g.groupBy("first").agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("best"))
    return g.join(best, "first").select("p_partkey", "first", (F.col("p_partkey") == F.col("best")).alias("kept"))


@register("""
WITH o AS (SELECT DISTINCT o_custkey AS c, epoch_us(o_orderdate) // 86400000000 AS d FROM orders), l AS (SELECT c, list(d ORDER BY d) AS ds FROM o GROUP BY c),
f AS (SELECT c, ds, list_reduce(list_transform(ds, lambda d: [d]), lambda a, x: CASE WHEN x[1] - a[-1] < 180 THEN a ELSE a || x END) AS firsts FROM l), e AS (SELECT c, firsts, unnest(ds) AS d FROM f)
SELECT c AS o_custkey, d - list_max(list_filter(firsts, lambda x: x <= d)) AS days_in, len(list_filter(firsts, lambda x: x <= d)) AS burst FROM e""")
def order_bursts(spark, sf_dir):
    """Days with orders of a customer, in bursts of less than 180 days from their first: pairs of days that near match,
    met in two half-open spans of 180 days, and go through the greedy rounds."""
    span = 180
    days = table(spark, sf_dir, "orders").select("o_custkey", F.unix_date(F.to_date("o_orderdate")).cast("long").alias("d")).distinct()
    days = days.select("*", (F.col("o_custkey") * 100_000 + F.col("d")).alias("node"), F.floor(F.col("d") / span).alias("s"))
    later = days.select("o_custkey", F.col("d").alias("e"), F.col("node").alias("b"), F.explode(F.array("s", F.col("s") - 1)).alias("s"))
    pairs = days.join(later, ["o_custkey", "s"]).where((F.col("e") > F.col("d")) & (F.col("e") - F.col("d") < span)).select(F.col("node").alias("a"), "b")
    g = days.join(grouping.greedy_groups(days.select("node"), pairs, finish=1000), "node").withColumn("first", F.col("group_id") % 100_000)
    place = g.select("o_custkey", "first").distinct().groupBy("o_custkey").agg(F.array_sort(F.collect_list("first")).alias("firsts"))
    return g.join(place, "o_custkey").select("o_custkey", (F.col("d") - F.col("first")).alias("days_in"), F.array_position("firsts", F.col("first")).cast("int").alias("burst"))


@register()
def opening_groups(spark, sf_dir):
    """Documents by the first document whose first eight words resemble theirs."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.first_tokens(F.col("text"), 8), " ").alias("title"))
    return grouping.title_groups(d, "doc_id", "title", 88.0).select("doc_id", "group_id")


def _sql(spark, sf_dir, query, *names, **views):
    """A SQL text over tables of the folder, with the library's functions; {name} stands for a table's frame."""
    tables.register(spark)
    return spark.sql(query, **{n: table(spark, sf_dir, n) for n in names}, **views)


@register("""
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS place, turn::VARCHAR AS marker, role AS credit, length(text) AS n_chars FROM conversations WHERE NOT contains(text, '[') AND NOT contains(text, ']') AND trim(text) <> ''""")
def sections_by_sql(spark, sf_dir):
    """Turns as sections of one text, taken apart by a table function in a lateral join."""
    c = table(spark, sf_dir, "conversations").where("not contains(text, '[') and not contains(text, ']') and trim(text) <> ''")
    parts = aggregates.ordered_text(c.withColumn("part", F.format_string("[%d: %s]\n%s", "turn", "role", "text")), ["conv_id"], "turn", "part", "\n")
    return _sql(spark, sf_dir, "SELECT conv_id, s.place, s.marker, s.credit, length(s.body) AS n_chars FROM {parts}, LATERAL text_sections(joined) s WHERE s.marker <> ''", parts=parts)


@register("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(avg(value), 6) AS trimmed FROM r WHERE i > floor(n * 0.1 + 1e-9) AND i <= n - floor(n * 0.1 + 1e-9) GROUP BY event_type""")
def trimmed_means(spark, sf_dir):
    return statistics.trimmed_means(table(spark, sf_dir, "events"), ["event_type"], "value", 0.1).withColumn("trimmed", F.round("trimmed", 6))


@register()
def change_points_by_sql(spark, sf_dir):
    """Days at which a type's mean value changes its level."""
    return _sql(spark, sf_dir, """
WITH days AS (SELECT event_type, to_date(ts) AS day, avg(value) AS value FROM {events} GROUP BY event_type, to_date(ts))
SELECT event_type, period AS day, round(before, 6) AS before, round(after, 6) AS after FROM change_points(TABLE(days), keys => 'event_type', period => 'day', value => 'value', penalty => 100)""", "events")


@register()
def bootstrap_by_sql(spark, sf_dir):
    """Mean order value of each priority with its interval."""
    return _sql(spark, sf_dir, """
WITH o AS (SELECT o_orderpriority, o_totalprice FROM {orders})
SELECT o_orderpriority, n, round(mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM bootstrap_interval(TABLE(o), keys => 'o_orderpriority', value => 'o_totalprice', draws => 400)""", "orders")
