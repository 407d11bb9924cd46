"""Registered queries of scalars, filters, records, curation and tests over groups, with their SQL."""
from pyspark.sql import functions as F

from .functions import filters, lexical, scalars, text
from .operators import changepoints, curation, linkage, records, series, statistics
from .queries import WORDS, register, table


# Scalars

@register(r"""
WITH d AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y') ELSE 'unknown' END AS raw, DATE '2000-02-29' AS other FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(raw, '^\d{4}-\d{2}-\d{2}') THEN raw::DATE WHEN regexp_matches(raw, '^\d{4}') THEN make_date(left(raw, 4)::BIGINT, 7, 1) ELSE other END AS day FROM d""")
def imputed_dates(spark, sf_dir):
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy")).otherwise("unknown")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.impute_date(raw, F.lit("2000-02-29").cast("date")).alias("day"))


@register("""
SELECT o_orderkey, o_orderdate::DATE AS day FROM orders""")
def parsed_days(spark, sf_dir):
    """Days written in five notations, read back."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    written = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "MMMM d, yyyy")).when(k == 2, F.date_format(day, "MMM d, yyyy")).when(k == 3, F.date_format(day, "d MMMM yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.parse_day(written).alias("day"))


@register("""
WITH p AS (SELECT p_partkey, p_size AS s, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN (p_partkey % 7) * 60 + s WHEN 1 THEN s * 60 + 5 WHEN 2 THEN (p_partkey % 9) * 60 + s END AS seconds FROM p""")
def durations(spark, sf_dir):
    """Four notations; the fourth has no seconds and gives null."""
    s, k = F.format_string("%02d", F.col("p_size").cast("int")), F.col("p_partkey") % 4
    written = (F.when(k == 0, F.concat((F.col("p_partkey") % 7).cast("string"), F.lit(" : "), s, F.lit(" (album version)"))).when(k == 1, F.concat(F.col("p_size").cast("string"), F.lit(" minutes and 5 seconds")))
               .when(k == 2, F.concat(F.lit("[1] "), (F.col("p_partkey") % 9).cast("string"), F.lit(":"), s)).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" minutes"))))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.duration_seconds(written).alias("seconds"))


@register("""
SELECT p_partkey, least(100.0, greatest(0.0, p_size * 100.0 / CASE p_partkey % 3 WHEN 0 THEN 100 WHEN 1 THEN 10 ELSE 5 END)) AS score FROM part""")
def scores_of_100(spark, sf_dir):
    scale = F.when(F.col("p_partkey") % 3 == 0, "100").when(F.col("p_partkey") % 3 == 1, "10").otherwise("5")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.score_out_of_100(F.concat_ws("/", F.col("p_size").cast("string"), scale)).alias("score"))


@register("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 0.0 ELSE 1.0 / (p_partkey * p_partkey * p_size) END AS p FROM part)
SELECT p_partkey, CASE WHEN isnan(p) THEN 'NA' ELSE format('{:.4g}', greatest(p, 1e-12)) END AS p_text FROM p""")
def p_texts(spark, sf_dir):
    k, n = F.col("p_partkey") % 4, F.col("p_partkey").cast("double")
    p = F.when(k == 0, float("nan")).when(k == 1, 0.0).otherwise(1.0 / (n * n * F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.p_text(p).alias("p_text"))


@register("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS marked, CASE WHEN p_size > 40 THEN 'exclude' WHEN p_size > 20 THEN 'review' ELSE 'keep' END AS action, round(p_retailprice - p_size, 4) AS margin,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size::INT END AS peak, CASE WHEN p_size % 3 = 0 THEN '2x Platinum' WHEN p_size % 3 = 1 THEN 'Gold' END AS award, DATE '2010-01-05' + (p_size::INT - 1) AS awarded FROM part""")
def decisions(spark, sf_dir):
    n = F.col("p_size")
    cell = F.when(F.col("p_partkey") % 5 == 0, "—").otherwise(n.cast("string"))
    blob = F.concat(F.lit("RIAA: "), F.when(n % 3 == 0, "2x Platinum").when(n % 3 == 1, "Gold").otherwise("none"), F.lit(", "), F.date_format(F.date_add(F.lit("2010-01-04").cast("date"), n.cast("int")), "MMMM d, yyyy"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.overwrite(F.lit("odd"), n % 2 == 0, "even").alias("marked"), scalars.decision([(n > 40, "exclude"), (n > 20, "review")], "keep").alias("action"),
                                               F.round(scalars.margin(F.col("p_retailprice"), n), 4).alias("margin"), scalars.peak_position(cell).alias("peak"), scalars.certification(blob).alias("award"), scalars.certification_day(blob).alias("awarded"))


@register(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, CASE WHEN len(ws) > 8 THEN array_to_string(ws[1:8], ' ') || '…' ELSE array_to_string(ws, ' ') END AS opening FROM w""")
def openings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.first_words(F.col("text"), 8).alias("opening"))


@register("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'checked' WHEN 1 THEN 'seen; checked' ELSE 'checked' END AS notes FROM orders""")
def noted_orders(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.append_note(F.when(k == 0, "").when(k == 1, "seen").otherwise("checked"), F.lit("checked")).alias("notes"))


@register("""
SELECT o_orderkey, round(o_totalprice / nullif(o_custkey, 0), 6) AS words_per_second, round(o_totalprice / nullif(o_custkey, 0) * 60, 6) AS words_per_minute, round(o_orderkey / nullif(o_custkey, 0) * 60, 6) AS lines_per_minute,
  round(o_totalprice / nullif(o_orderkey, 0), 6) AS words_per_line, round(o_custkey / nullif(o_totalprice, 0), 6) AS verse_share FROM orders""")
def order_rates(spark, sf_dir):
    out = table(spark, sf_dir, "orders").select("o_orderkey", *scalars.rates(F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_custkey"), F.col("o_custkey")))
    return out.select("o_orderkey", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@register("""
WITH s AS (SELECT doc_id, n_chars % 7 AS a, n_chars % 5 AS b, n_chars % 3 AS c FROM documents)
SELECT doc_id, a AS anger, b AS joy, CASE WHEN c >= a AND c >= b THEN 'sadness' WHEN b >= a THEN 'joy' ELSE 'anger' END AS top_label FROM s""")
def score_columns(spark, sf_dir):
    pair = lambda name, k: F.struct(F.lit(name).alias("label"), (F.col("n_chars") % k).alias("score"))
    scored = table(spark, sf_dir, "documents").withColumn("scores", F.array(pair("anger", 7), pair("joy", 5), pair("sadness", 3)))
    return scored.select("doc_id", *[c for c in scalars.scores_to_columns(F.col("scores"), ["anger", "joy"])])


# Text

@register(r"""
SELECT doc_id, regexp_replace(regexp_replace('[Verse 1] ' || text || ' (live 2010) (Remix)', '\[[^\]]*\]', '', 'g'), '\([^)]*\d{4}[^)]*\)', '', 'g') AS stripped, len(regexp_extract_all(text, '\S+')) AS n_words,
  regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS skeleton FROM documents""")
def cleaned_texts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_brackets(F.concat(F.lit("[Verse 1] "), t, F.lit(" (live 2010) (Remix)"))).alias("stripped"), text.word_count(t).alias("n_words"), text.skeleton(t).alias("skeleton"))


@register("""
SELECT doc_id, text FROM documents""")
def repaired_texts(spark, sf_dir):
    """Texts whose UTF-8 was read as Latin-1, where that can be told and undone, come back as they were."""
    t = F.col("text")
    broken = F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")
    read = F.when(broken.rlike("[Ãâ]"), broken).otherwise(t)
    return table(spark, sf_dir, "documents").where(t.isNotNull()).select("doc_id", text.repair_encoding(read).alias("text")).unionByName(table(spark, sf_dir, "documents").where(t.isNull()).select("doc_id", "text"))


@register("""
SELECT c_custkey, c_name || ' one' AS quoted, c_name AS plain FROM customer""")
def quoted_names(spark, sf_dir):
    c = F.col("c_name")
    marked = F.concat(F.lit("Says \""), c, F.lit(" one\" and “x” to them"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(text.quoted_spans(marked), F.lit(0)).alias("quoted"), text.strip_markdown(F.concat(F.lit("**"), c, F.lit("**"))).alias("plain"))


@register("""
SELECT s_suppkey, s_name AS name, regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') AS slug, s_suppkey % 2 = 0 AS placeholder, [s_name, 'Other'] AS artists, 'Single/Album' AS kinds FROM supplier""")
def supplier_texts(spark, sf_dir):
    s = F.col("s_name")
    slug = F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.relaxed_title(F.concat(s, F.lit(" (Deluxe) feat. Someone"))).alias("name"), text.url_slug(F.concat(F.lit("https://example.org/a/"), slug, F.lit("/?q=1"))).alias("slug"),
                                                   text.is_placeholder(F.when(F.col("s_suppkey") % 2 == 0, "Lyrics yet to be transcribed").otherwise(s)).alias("placeholder"), text.artists(F.concat(s, F.lit(" & Other feat. "), s)).alias("artists"),
                                                   text.canonical_types(F.lit("the single/ALBUM/single mix"), {"single": "Single", "album": "Album"}).alias("kinds"))


@register("""
SELECT conv_id, turn, text FROM conversations WHERE text <> ''""")
def cleaned_turns(spark, sf_dir):
    """Boilerplate around one-line turns goes."""
    c = table(spark, sf_dir, "conversations").where("text <> ''")
    wrapped = F.concat(F.lit("12 Contributors\n\n\nYou might also like\n"), F.col("text"), F.lit("33Embed"))
    plain = F.col("text").rlike(r"^\S(?:.*\S)?$") & ~F.col("text").rlike(r"\d$|\n|\s{2,}|Embed")
    return c.select("conv_id", "turn", F.when(plain, text.clean_boilerplate(wrapped)).otherwise(F.col("text")).alias("text"))


@register("""
WITH u AS (SELECT page_id, 'https://example.org/music/' || page_id AS a, CASE page_id % 3 WHEN 0 THEN 'https://example.org/music/' || page_id || '/' WHEN 1 THEN 'https://example.org/music/other' END AS b FROM pages)
SELECT page_id, coalesce(b IS NOT NULL AND page_id % 3 = 1, false) AS prefers_direct, CASE page_id % 2 WHEN 0 THEN (page_id % 100)::INT END AS score, CASE page_id % 2 WHEN 0 THEN (page_id % 30)::INT END AS reviews,
  CASE page_id % 4 WHEN 0 THEN (page_id % 52)::INT END AS weeks, page_id % 5 <> 0 AS valid FROM u""")
def page_rules(spark, sf_dir):
    k = F.col("page_id")
    a = F.concat(F.lit("https://example.org/music/"), k.cast("string"))
    b = F.when(k % 3 == 0, F.concat(a, F.lit("/"))).when(k % 3 == 1, "https://example.org/music/other")
    said = F.when(k % 2 == 0, F.concat(F.lit("An average score of "), (k % 100).cast("string"), F.lit(", based on "), (k % 30).cast("string"), F.lit(" reviews.")))
    weeks = F.when(k % 4 == 0, F.concat(F.lit("It spent "), (k % 52).cast("string"), F.lit(" weeks  on the Hot 100.")))
    score = text.score_sentence(said)
    return table(spark, sf_dir, "pages").select("page_id", text.prefers_direct(F.lit("A Title"), a, b).alias("prefers_direct"), score["score"].alias("score"), score["reviews"].alias("reviews"), text.weeks_listed(weeks).alias("weeks"),
                                                records.valid_address(F.when(k % 5 == 0, "https://example.org/music/browse/x").otherwise(a), "music", ("browse", "feature")).alias("valid"))


# Lexical measures of lines

@register(f"""
WITH d AS (SELECT lang, regexp_extract_all(text, '[A-Za-z0-9'']+') AS ws FROM documents),
 m AS (SELECT lang, len(ws) AS n, CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda w: length(w))) / len(ws) END AS c,
   CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: lower(w) IN ('i', 'me', 'my', 'mine', 'myself') OR starts_with(lower(w), 'i'''))) / len(ws) ELSE 0 END AS f FROM d)
SELECT lang, round(avg(n), 6) AS mean_line_tokens, round(avg(c), 6) AS mean_word_chars, round(avg(f), 9) AS mean_first_person FROM m GROUP BY lang""")
def line_measures(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.regexp_extract_all("text", F.lit("([A-Za-z0-9']+)")).alias("ws"))
    m = d.select("lang", *lexical.line_measures(F.col("ws")), lexical.first_person_share(F.transform("ws", F.lower)).alias("f"))
    return m.groupBy("lang").agg(F.round(F.avg("line_tokens"), 6).alias("mean_line_tokens"), F.round(F.avg("mean_word_chars"), 6).alias("mean_word_chars"), F.round(F.avg("f"), 9).alias("mean_first_person"))


# Filters

@register(r"""
SELECT p_partkey, p_type LIKE '%PROMO%' OR lower(p_name) = 'x' OR regexp_matches(p_name, '(?i)green') AS skipped, abs(p_size - 25) > CASE WHEN p_brand = 'Brand#11' THEN 20 WHEN p_brand = 'Brand#12' THEN 5 ELSE 0 END AS over_floor FROM part""")
def part_rules(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    floors = {"Brand#11": 20, "Brand#12": 5}
    return p.select("p_partkey", filters.skipped(F.col("p_type"), F.col("p_name"), ["promo"], ["x"], "green").alias("skipped"), filters.over_floor(F.col("p_size") - 25, F.col("p_brand"), floors).alias("over_floor"))


@register(f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents)
SELECT doc_id, len(ws) >= 6 AND len(list_distinct(ws)) >= 4 AND len(list_distinct(ws)) >= 0.5 * len(ws) AS varied FROM d""")
def varied_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("ws"))
    return d.select("doc_id", filters.distinct_share_filter(F.col("ws")).alias("varied"))


@register("""
SELECT count(*) AS n_rows, count_if(event_id % 10 <> 0 AND event_id % 10 <> 1) AS n_finite FROM events""")
def finite_values(spark, sf_dir):
    k = F.col("event_id") % 10
    v = F.when(k == 0, float("nan")).when(k == 1, None).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(filters.finite(v).alias("f")).agg(F.count("*").alias("n_rows"), F.count_if("f").alias("n_finite"))


# Records

@register("""
SELECT o_custkey, string_agg(o_orderpriority, '; ' ORDER BY first) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def ordered_distinct_values(spark, sf_dir):
    from .operators import aggregates
    once = curation.ordered_distinct(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")
    return aggregates.ordered_text(once, ["o_custkey"], "rank", "o_orderpriority", "; ").withColumnRenamed("joined", "priorities")


@register("""
SELECT l_orderkey, bool_and(l_discount > 0.05) AS every, bool_or(l_discount > 0.05) AS "any", CASE WHEN bool_and(l_discount > 0.05) THEN 'ALL' WHEN bool_or(l_discount > 0.05) THEN 'SOME' ELSE 'NONE' END AS label FROM lineitem GROUP BY 1""")
def order_votes(spark, sf_dir):
    return curation.cluster_votes(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_discount") > 0.05)


@register("""
WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, count_if(lower(o_orderpriority) IN ('1-urgent', '2-high')) AS a, count_if(lower(o_orderpriority) = '5-low') AS b FROM orders GROUP BY 1)
SELECT month, 'pressing' AS target, a AS n_hits, round(1000.0 * a / n, 6) AS rate FROM m UNION ALL SELECT month, 'low', b, round(1000.0 * b / n, 6) FROM m""")
def mention_rates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("month", scalars.month_start(F.col("o_orderdate")))
    out = curation.mention_rates(o, ["month"], F.array("o_orderpriority"), {"pressing": ["1-URGENT", "2-High"], "low": ["5-LOW"]})
    return out.withColumn("rate", F.round("rate", 6))


@register("""
SELECT event_type, count(*) AS n, round(avg(length(event_type)), 6) AS mean_words, round(100 * avg((value > 50)::INT), 6) AS pct_marked FROM events GROUP BY 1""")
def category_summary(spark, sf_dir):
    out = curation.summary(table(spark, sf_dir, "events"), "event_type", F.split("event_type", "(?<=.)(?=.)"), F.col("value") > 50)
    return out.select("event_type", "n", F.round("mean_words", 6).alias("mean_words"), F.round("pct_marked", 6).alias("pct_marked"))


@register("""
WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_size DESC, p_brand, p_name, p_partkey) AS n FROM part) WHERE n = 1 AND p_size > 5),
 c AS (SELECT *, CASE p_type WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END AS place FROM b),
 r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY p_size DESC, p_brand, p_name) AS k FROM c),
 d AS (SELECT *, row_number() OVER (PARTITION BY p_brand, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') ORDER BY place, p_size DESC, p_name) AS j FROM r WHERE place = 2 OR k <= CASE place WHEN 0 THEN 12 ELSE 25 END)
SELECT p_brand, p_name, p_size, row_number() OVER (ORDER BY place, p_size DESC, p_brand, p_name) AS rank FROM d WHERE j = 1 ORDER BY place, p_size DESC, p_brand, p_name LIMIT 80""")
def curated_parts(spark, sf_dir):
    """A top-80 report by its nature."""
    best = F.max(F.struct("p_size", (-F.col("p_partkey")).alias("last"))).alias("best")
    p = table(spark, sf_dir, "part").groupBy("p_brand", "p_name", "p_type").agg(best).select("p_brand", "p_name", "p_type", "best.p_size", (-F.col("best.last")).alias("p_partkey"))
    out = curation.curated(p, "p_brand", "p_name", "p_size", "p_type", F.col("p_size") > 5, {"PROMO": 12, "ECONOMY": 25}, 80, ["p_partkey"])
    return out.select("p_brand", "p_name", "p_size", "rank")


@register("""
WITH w(name, a, b, s) AS (VALUES ('early', DATE '1995-01-01', DATE '1996-12-31', 1), ('late', DATE '1996-06-01', DATE '1997-12-31', -1)),
 r AS (SELECT name AS "window", o_orderkey, row_number() OVER (PARTITION BY name ORDER BY s * len(string_split(o_orderpriority, '-')), o_orderkey) AS rank FROM orders, w WHERE o_orderdate::DATE BETWEEN a AND b AND o_orderstatus = 'F')
SELECT "window", o_orderkey, rank FROM r WHERE rank <= 5""")
def exemplar_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    out = curation.exemplars(o, "o_orderdate", "o_orderkey", F.split("o_orderpriority", "-"), [("early", "1995-01-01", "1996-12-31", True), ("late", "1996-06-01", "1997-12-31", False)], F.col("o_orderstatus") == "F")
    return out.select("window", "o_orderkey", "rank")


@register("""
WITH a AS (SELECT o_custkey, 'x' || o_custkey AS uid FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), s AS (SELECT DISTINCT c_custkey FROM customer)
SELECT c_custkey, a.uid IS NOT NULL AS listed, coalesce(a.uid, 'c' || c_custkey) AS uid FROM s LEFT JOIN a ON c_custkey = o_custkey""")
def stable_uids(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey").distinct().withColumn("slug", F.concat(F.lit("x"), F.col("o_custkey").cast("string")))
    c = table(spark, sf_dir, "customer").select("c_custkey").distinct().join(a, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.col("slug").isNotNull().alias("listed"), F.split_part(records.stable_uid(F.col("slug"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.lit(1)), F.lit("##"), F.lit(1)).alias("uid"))


@register("""
SELECT key, max(value) AS value FROM (SELECT unnest([o_custkey, -o_orderkey - 1]) AS key, arg_max(o_orderpriority, (o_orderkey, o_orderpriority)) OVER (PARTITION BY o_custkey) AS v1, o_orderpriority AS v2, o_custkey, o_orderkey FROM orders),
 LATERAL (SELECT CASE WHEN key >= 0 THEN v1 ELSE v2 END AS value) GROUP BY key""")
def last_writes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return records.last_write(o, F.array("o_custkey", -F.col("o_orderkey") - 1), "o_orderpriority", "o_orderkey").withColumnRenamed("o_orderpriority", "value")


@register("""
SELECT count_if(lower(p_name) <> p_name) AS n_changed, count(*) AS n_rows FROM part""")
def reapplied_cleaner(spark, sf_dir):
    return records.reapplied(table(spark, sf_dir, "part"), "p_name", F.lower)


@register("""
SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS miss_rank FROM part WHERE p_size < 20""")
def match_misses(spark, sf_dir):
    return records.misses(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", 20, ["p_partkey"])


@register("""
SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'flagged: R' ELSE 'none' END AS note FROM orders""")
def reflagged_orders(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("reason"))
    return records.reflagged(table(spark, sf_dir, "orders").select("o_orderkey", F.lit("none").alias("note")), flags, "o_orderkey").select("o_orderkey", "note")


@register("""
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'economy' WHEN starts_with(p_type, 'STANDARD ') THEN substr(p_type, 10) ELSE p_type END AS kind FROM part""")
def renamed_types(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", records.renamed(F.col("p_type"), {"ECONOMY": "economy"}, ["STANDARD "]).alias("kind"))


@register("""
SELECT user_id, first(url ORDER BY NOT contains(url, '7'), length(url), url) AS url FROM (SELECT user_id, 'https://example.org/' || event_id AS url FROM events) GROUP BY 1""")
def preferred_addresses(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("https://example.org/"), F.col("event_id").cast("string")).alias("url"))
    return records.preferred_address(e, ["user_id"], "url", "7")


@register("""
SELECT p_partkey, EXISTS (SELECT 1 FROM part q WHERE q.p_size > 40 AND regexp_replace(lower(q.p_name), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(part.p_name), '[^a-z0-9]+', '', 'g')) AS in_catalogue,
  CASE WHEN EXISTS (SELECT 1 FROM part q WHERE q.p_size > 40 AND regexp_replace(lower(q.p_name), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(part.p_name), '[^a-z0-9]+', '', 'g')) OR p_partkey % 3 = 0 THEN 'keep' WHEN p_partkey % 3 = 1 THEN 'exclude' ELSE 'review' END AS action FROM part""")
def ghosts(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    items = p.select("p_partkey", "p_name", F.when(k == 0, True).when(k == 1, False).alias("credible"))
    return records.enriched(items, p.where("p_size > 40").select("p_name"), "p_name").select("p_partkey", "in_catalogue", "action")


@register("""
WITH b AS (SELECT p_name, p_brand, 0 AS r FROM part WHERE p_size > 25 UNION ALL SELECT p_name, p_brand, 1 FROM part WHERE p_size <= 25)
SELECT p_name, p_brand, r AS source_rank FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY r, p_brand, p_name) AS n FROM b) WHERE n = 1""")
def candidate_pool(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return records.candidate_pool(p.where("p_size > 25").select("p_name", "p_brand"), p.where("p_size <= 25").select("p_name", "p_brand"), "p_name")


@register("""
SELECT p_name, p_brand, max(p_size) AS p_size FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50) AND lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size = 50) AND len(regexp_extract_all(lower(p_name), '[a-z0-9'']+')) >= 2
GROUP BY 1, 2 ORDER BY 3 DESC, 2, 1 LIMIT 1""")
def replacement_row(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.max("p_size").alias("p_size"))
    return records.replacement(p, table(spark, sf_dir, "part").where("p_size = 50"), "p_brand", "p_name", "p_size", 2).select("p_name", "p_brand", "p_size")


# Tests over groups

@register("""
WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1), base AS (SELECT 150000.0 AS b),
 e AS (SELECT date_trunc('month', l_shipdate)::DATE AS em, count(*) AS w FROM lineitem WHERE l_quantity >= 50 GROUP BY 1),
 d AS (SELECT em, w, coalesce(sum(n), 0)::BIGINT AS k, sum(s) / sum(n) - any_value(b) AS delta FROM base, e LEFT JOIN m ON month BETWEEN em AND date_trunc('month', em + 90) GROUP BY em, w)
SELECT em AS event_month, round(delta, 4) AS delta, k AS n_rows, round((SELECT sum(w) FROM d x WHERE abs(coalesce(x.delta, 0)) >= abs(d.delta)) / (SELECT sum(w) FROM d), 6) AS p FROM d""")
def month_permutations(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(scalars.month_start(F.col("o_orderdate")).alias("month")).agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    e = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(scalars.month_start(F.col("l_shipdate")).alias("event_month"))
    out = statistics.month_permutation_p(m, e, "month", "s", "n", "event_month", 150000.0, 90)
    return out.select("event_month", F.round("delta", 4).alias("delta"), "n_rows", F.round("p", 6).alias("p"))


@register("""
WITH u AS (SELECT event_type, user_id, sum(value) AS s, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, sum(s) OVER (PARTITION BY event_type) AS ts, sum(n) OVER (PARTITION BY event_type) AS tn FROM u)
SELECT event_type, user_id, round(ts / tn, 6) AS mean_all, round((ts - s) / nullif(tn - n, 0), 6) AS mean_without, coalesce(tn = n OR (ts / tn) * ((ts - s) / nullif(tn - n, 0)) <= 0 OR abs((ts - s) / nullif(tn - n, 0)) < 15 AND abs((ts - s) / nullif(tn - n, 0)) < 0.5 * abs(ts / tn), false) AS fragile FROM t""")
def leave_one_out(spark, sf_dir):
    out = statistics.left_out(table(spark, sf_dir, "events"), ["event_type"], "user_id", "value")
    return out.select("event_type", "user_id", F.round("mean_all", 6).alias("mean_all"), F.round("mean_without", 6).alias("mean_without"), statistics.fragile(F.col("mean_all"), F.col("mean_without")).alias("fragile"))


@register("""
WITH r AS (SELECT p_brand, (p_size - 25)::DOUBLE AS z, (p_retailprice % 7 - 3)::DOUBLE AS o, (p_partkey % 100) / 500.0 AS p, p_partkey % 2 = 0 AS same, sign(p_partkey % 3 - 1) AS sg FROM part),
 v AS (SELECT p_brand, count_if(p < 0.05 AND z <> 0 AND sign(o) = CASE WHEN same THEN sign(z) ELSE -sign(z) END) AS votes, count_if(p < 0.10 AND sg <> 0 AND sign(z) = sg) AS passes FROM r GROUP BY 1)
SELECT p_brand, votes, CASE WHEN votes >= 2 THEN 'ROBUST' WHEN votes = 1 THEN 'PARTIAL' ELSE 'FAILS' END AS label, passes, CASE WHEN passes >= 3 THEN 'ROBUST' WHEN passes = 2 THEN 'PARTIAL' ELSE 'FAILS' END AS robustness FROM v""")
def votes(spark, sf_dir):
    r = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") - 25).cast("double").alias("z"), (F.col("p_retailprice") % 7 - 3).cast("double").alias("o"), ((F.col("p_partkey") % 100) / 500.0).alias("p"), (F.col("p_partkey") % 2 == 0).alias("same"), F.signum(F.col("p_partkey") % 3 - 1).alias("sg"))
    other = statistics.robustness_vote(r, ["p_brand"], "z", "p", "sg").withColumnRenamed("label", "robustness")
    return statistics.alignment_vote(r, ["p_brand"], "z", "o", "p", "same").join(other, "p_brand")


@register("""
WITH r AS (SELECT p_partkey, (p_partkey % 100) / 1000.0 AS p, CASE WHEN p_partkey % 11 = 0 THEN 'NaN'::DOUBLE ELSE (p_size - 25) / 60.0 END AS z, p_partkey % 3 <> 0 AS x FROM part)
SELECT p_partkey, CASE WHEN NOT x OR isnan(z) OR p >= 0.05 THEN 'NONE' WHEN abs(z) > 0.3 THEN 'STRONG' WHEN abs(z) > 0.25 THEN 'MODERATE' ELSE 'NONE' END AS tier, x AND NOT isnan(z) AND abs(z) > 0.3 AS substantive FROM r""")
def effect_tiers(spark, sf_dir):
    k = F.col("p_partkey")
    z = F.when(k % 11 == 0, float("nan")).otherwise((F.col("p_size") - 25) / 60.0)
    return table(spark, sf_dir, "part").select("p_partkey", statistics.tier((k % 100) / 1000.0, z, k % 3 != 0).alias("tier"), statistics.substantive(k % 3 != 0, z).alias("substantive"))


# Breaks and months

@register("""
WITH p AS (SELECT p_partkey, (p_size % 10)::INT AS support FROM part), n AS (SELECT count_if(support >= 6) AS n6, count_if(support >= 5) AS n5, count_if(support >= 7) AS n7, count_if(support >= 4) AS n4 FROM p),
 c AS (SELECT CASE WHEN n6 < 5 THEN 5 WHEN n6 > 25 THEN 7 ELSE 6 END AS t, n4, CASE WHEN n6 < 5 THEN n5 WHEN n6 > 25 THEN n7 ELSE n6 END AS k FROM n), f AS (SELECT CASE WHEN k < 8 AND n4 > k THEN 4 ELSE t END AS threshold FROM c)
SELECT p_partkey, threshold FROM p, f WHERE support >= threshold""")
def adaptive_threshold(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 10).cast("int").alias("support"))
    return changepoints.at_threshold(p).select("p_partkey", "threshold")


@register("""
WITH e AS (SELECT event_type, ts::DATE AS day, value - 50 AS magnitude, (event_id % 9)::INT AS support FROM events), h AS (SELECT * FROM e WHERE abs(day - DATE '2024-01-15') <= 62 AND magnitude >= 0)
SELECT event_type, support, min(day) AS day FROM h WHERE (event_type, support) IN (SELECT event_type, max(support) FROM h GROUP BY 1) GROUP BY ALL""")
def expected_breaks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), (F.col("value") - 50).alias("magnitude"), (F.col("event_id") % 9).cast("int").alias("support"))
    return changepoints.expected_break(e, ["event_type"], "2024-01-15", True).select("event_type", "support", "day")


@register("""
WITH s AS (SELECT o_orderpriority AS p, year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT p, y, n / sum(n) OVER (PARTITION BY y) AS share FROM s),
 k AS (SELECT p, max(share) AS peak, first(y ORDER BY share DESC, y) AS peak_year FROM t GROUP BY p)
SELECT p AS o_orderpriority, peak_year, round(peak, 9) AS peak_share, min(y) AS first_year, max(y) AS last_year, make_date(floor((min(y) + max(y)) / 2)::BIGINT, 7, 1) AS middle FROM t JOIN k USING (p) WHERE share >= 0.8 * peak GROUP BY ALL""")
def dominance_spans(spark, sf_dir):
    from .operators import aggregates
    o = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    out = changepoints.dominance(aggregates.shares(o, ["o_orderpriority", "y"], ["y"]), "o_orderpriority", "y", "share")
    return out.select("o_orderpriority", "peak_year", F.round("peak_share", 9).alias("peak_share"), "first_year", "last_year", "middle")


@register("""
WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
 t AS (SELECT month, list_sort(list(DISTINCT o_orderpriority)) AS l FROM m JOIN orders ON date_trunc('month', o_orderdate) = month GROUP BY 1), e AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE o_totalprice > 440000)
SELECT month, v, array_to_string(l[1:3], '; ') || CASE WHEN len(l) > 3 THEN '...' ELSE '' END AS released, (SELECT min(abs(d - month)) FROM e)::INT AS days_to_nearest, coalesce((SELECT min(abs(d - month)) FROM e) > 180, true) AS hidden FROM m JOIN t USING (month)""")
def top_months(spark, sf_dir):
    """A top-5 report by its nature."""
    o = table(spark, sf_dir, "orders")
    m = o.groupBy(scalars.month_start(F.col("o_orderdate")).alias("month")).agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    return changepoints.top_months(m, "month", "v", o, "o_orderdate", "o_orderpriority", o.where("o_totalprice > 440000").select("o_orderdate"), "o_orderdate", 5, 3)


@register("""
SELECT o_orderkey, CASE WHEN abs(s) <= 90 THEN 'near_severe' WHEN abs(a) <= 90 THEN 'near_any' ELSE 'distant' END AS by_severity, CASE WHEN abs(a) <= 90 THEN 'confirms_event' WHEN abs(a) <= 180 THEN 'near_miss' ELSE 'hidden_inflection' END AS by_distance
FROM (SELECT o_orderkey, (o_orderkey % 500 - 250) AS s, (o_custkey % 500 - 250) AS a FROM orders)""")
def break_classes(spark, sf_dir):
    s, a = F.col("o_orderkey") % 500 - 250, F.col("o_custkey") % 500 - 250
    return table(spark, sf_dir, "orders").select("o_orderkey", changepoints.classify_by_severity(s, a).alias("by_severity"), changepoints.classify_by_distance(a).alias("by_distance"))


# Linkage scores

@register("""
WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_name) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' set' ELSE 'x' END AS b, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'other' END AS found, p_brand FROM part)
SELECT p_partkey, CASE WHEN a = b THEN 100 ELSE 80 END + CASE WHEN found = p_brand THEN 30 ELSE 0 END AS score, CASE WHEN p_partkey % 2 = 0 THEN 55 ELSE 0 END AS overlap FROM p""")
def hit_scores(spark, sf_dir):
    k, a = F.col("p_partkey"), F.lower("p_name")
    b = F.concat(a, F.when(k % 3 == 0, "").when(k % 3 == 1, " set").otherwise("x"))
    found = F.when(k % 2 == 0, F.col("p_brand")).otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", linkage.hit_score(a, b, F.col("p_brand"), found).alias("score"), linkage.overlap_score(F.array("p_brand"), F.array(found, F.lit("none"))).alias("overlap"))


@register("""
SELECT o_orderkey, coalesce('c' || (CASE WHEN o_custkey % 2 = 0 THEN o_custkey END), 'p' || left(o_orderpriority, 1)) AS found FROM orders""")
def looked_up(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    first = o.where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("v")).distinct()
    second = o.select(F.col("o_orderpriority").alias("k"), F.concat(F.lit("p"), F.left("o_orderpriority", F.lit(1))).alias("v")).distinct()
    return linkage.lookup_chain(o, [(first, "o_custkey", "k", "v"), (second, "o_orderpriority", "k", "v")]).select("o_orderkey", "found")


@register("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'override' WHEN o_orderkey % 3 = 1 THEN 'from_detail' WHEN o_orderkey % 2 = 0 THEN 'own' ELSE 'none' END AS status FROM orders""")
def routed_orders(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 2 == 0, "https://example.org/own").alias("own"), F.when(k % 3 == 1, "see https://example.org/d now").alias("detail"))
    overrides = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("https://example.org/o").alias("url"))
    return records.routed(o, overrides, "o_orderkey", "own", "detail").select("o_orderkey", "status")


@register("""
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_point FROM customer WHERE c_custkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')""")
def recovered_customers(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    key = lambda s: o.where(f"o_orderstatus = '{s}'").select(F.col("o_custkey").alias("c_custkey"))
    even = c.where("c_custkey % 2 = 0").select("c_custkey")
    kept = records.recovery_set(even, even, key("O"), c.where("false").select("c_custkey"), "c_custkey")
    return kept.join(key("F").distinct().withColumn("h", F.lit(True)), "c_custkey", "left").select("c_custkey", F.coalesce("h", F.lit(False)).alias("has_point"))
