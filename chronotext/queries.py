"""Registered queries of the engine's own operators, with DuckDB SQL for the same tables."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import lexical, scalars, text
from .operators import aggregates, changepoints, evidence, linkage, series, sets, statistics, temporal, vectors, vocabulary

QUERIES, ORACLE_SQL = {}, {}
FLAGSHIP = "lexical_by_language"


def register(sql=None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return put


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS = r"regexp_extract_all(lower(text), '[a-z'']+')"
LETTERS = "regexp_replace(w, '[^a-z]', '', 'g')"
SYLLABLES = (f"CASE WHEN {LETTERS} = '' THEN 0 ELSE greatest(1, len(regexp_extract_all({LETTERS}, '[aeiouy]+')) - CASE WHEN ends_with({LETTERS}, 'e') AND len(regexp_extract_all({LETTERS}, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END"
             f" + CASE WHEN regexp_matches({LETTERS}, '[^aeiouy]le$') THEN 1 ELSE 0 END) END")


# Text and lexical measures

@register(f"""
WITH d AS (SELECT lang, {WORDS} AS ws FROM documents), w AS (SELECT lang, len(ws) AS n, len(list_distinct(ws)) AS types FROM d)
SELECT lang, count(*) AS n_docs, sum(n)::BIGINT AS n_words, round(avg(CASE WHEN n > 0 THEN types / n END), 6) AS avg_ttr FROM w GROUP BY lang""")
def lexical_by_language(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", text.tokens(F.col("text")).alias("ws"))
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size("ws")).alias("n_words"), F.round(F.avg(lexical.type_token_ratio(F.col("ws"))), 6).alias("avg_ttr"))


@register(f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents), s AS (SELECT doc_id, ws, list_transform(ws, lambda w: {SYLLABLES}) AS sy FROM d)
SELECT doc_id, len(ws) AS n_words, round(list_sum(list_transform(ws, lambda w: length(w))) / len(ws), 6) AS avg_word_len, round(list_sum(sy) / len(ws), 6) AS avg_syllables,
  round(len(list_filter(sy, lambda x: x = 1)) / len(ws), 6) AS pct_one_syl, round(len(list_filter(sy, lambda x: x >= 3)) / len(ws), 6) AS pct_three_plus_syl FROM s WHERE len(ws) > 0""")
def word_measures(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(text.has_token(F.col("text"))).select("doc_id", text.tokens(F.col("text")).alias("ws"))
    ws = F.col("ws")
    return d.select("doc_id", F.size("ws").alias("n_words"), F.round(lexical.mean_length(ws), 6).alias("avg_word_len"), F.round(lexical.mean_syllables(ws), 6).alias("avg_syllables"),
                    F.round(lexical.share_of_one_syllable(ws), 6).alias("pct_one_syl"), F.round(lexical.share_of_three_syllables(ws), 6).alias("pct_three_plus_syl"))


@register(f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS sentences FROM documents), s AS (SELECT *, list_sum(list_transform(ws, lambda w: {SYLLABLES})) AS sy FROM d)
SELECT doc_id, CASE WHEN len(ws) > 0 THEN round(0.39 * (len(ws) / sentences) + 11.8 * (sy / len(ws)) - 15.59, 6) ELSE 0 END AS fk_grade FROM s""")
def reading_grade(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("ws"), F.greatest(F.lit(1), F.regexp_count("text", F.lit("[.!?]+"))).alias("sentences"))
    return d.select("doc_id", lexical.flesch_kincaid(F.col("ws"), F.col("sentences"), 6).alias("fk_grade"))


def _factors(words):
    """SQL of the factors of one pass: a fold whose states are structs like the ones that words are wrapped in."""
    types, n = "(s.t + (NOT list_contains(s.seen, x.seen[1]))::INT)", "(s.n + 1)"
    closed = f"({types} / {n} <= 0.72)"
    state = "{'f': 0.0::DOUBLE, 'n': 0, 't': 0, 'seen': []::VARCHAR[]}"
    step = f"{{'f': s.f + {closed}::INT, 'n': CASE WHEN {closed} THEN 0 ELSE {n} END, 't': CASE WHEN {closed} THEN 0 ELSE {types} END, 'seen': CASE WHEN {closed} THEN [] WHEN list_contains(s.seen, x.seen[1]) THEN s.seen ELSE list_append(s.seen, x.seen[1]) END}}"
    return f"list_reduce(list_prepend({state}, list_transform({words}, lambda w: {{'f': 0.0::DOUBLE, 'n': 0, 't': 0, 'seen': [w]}})), lambda s, x: {step})"


@register(f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents), f AS (SELECT doc_id, len(ws) AS n, {_factors('ws')} AS a, {_factors('list_reverse(ws)')} AS b FROM d WHERE len(ws) >= 50),
 r AS (SELECT doc_id, n, a.f + CASE WHEN a.n > 0 THEN (1 - a.t / a.n) / 0.28 ELSE 0 END AS a, b.f + CASE WHEN b.n > 0 THEN (1 - b.t / b.n) / 0.28 ELSE 0 END AS b FROM f)
SELECT d.doc_id, CASE WHEN ws IS NULL THEN NULL ELSE coalesce(round((CASE WHEN a > 0 THEN n / a ELSE 0 END + CASE WHEN b > 0 THEN n / b ELSE 0 END) / 2, 6), 0) END AS mtld FROM d LEFT JOIN r USING (doc_id)""")
def mtld_by_document(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("ws"))
    return d.select("doc_id", lexical.mtld(F.col("ws"), digits=6).alias("mtld"))


@register(f"""
WITH t AS (SELECT doc_id, unnest({WORDS}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY ALL), n AS (SELECT doc_id, c, sum(c) OVER (PARTITION BY doc_id) AS n FROM c),
 h AS (SELECT doc_id, sum(1 - CASE WHEN n - c >= 42 THEN exp(lgamma(n - c + 1) - lgamma(n - c - 41) - lgamma(n + 1) + lgamma(n - 41)) ELSE 0 END) / 42 AS hdd FROM n WHERE n >= 42 GROUP BY doc_id)
SELECT doc_id, round(hdd, 6) AS hdd FROM documents LEFT JOIN h USING (doc_id)""")
def hdd_by_document(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("ws"))
    return d.select("doc_id", F.round(lexical.hdd("ws"), 6).alias("hdd"))


@register(f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+''?[a-z]+|[a-z]+') AS ws FROM documents),
 c AS (SELECT doc_id, len(ws) AS n_tokens, len(list_filter(ws, lambda w: w IN ('i', 'me', 'my', 'mine', 'myself', 'im', 'i''m', 'ill', 'i''ll', 'ive', 'i''ve', 'id', 'i''d'))) AS first_singular,
  len(list_filter(ws, lambda w: w IN ('we', 'us', 'our', 'ours', 'were', 'we''re', 'well', 'we''ll', 'weve', 'we''ve'))) AS first_plural,
  len(list_filter(ws, lambda w: w IN ('you', 'your', 'yours', 'youre', 'you''re', 'youll', 'you''ll', 'yall', 'y''all'))) AS second,
  len(list_filter(ws, lambda w: w IN ('they', 'them', 'their', 'theirs', 'theyre', 'they''re'))) AS third_plural FROM d)
SELECT *, CASE WHEN n_tokens > 0 THEN round(first_singular / n_tokens, 9) ELSE 0 END AS rate_first_singular FROM c""")
def pronouns(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text"), lexical.PRONOUN_TOKENS).alias("ws"))
    ws = F.col("ws")
    return d.select("doc_id", F.size(ws).alias("n_tokens"), *lexical.pronoun_counts(ws), F.round(lexical.pronoun_rates(ws)[0], 9).alias("rate_first_singular"))


@register(r"""
WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 2)) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, max(length(line)) AS longest FROM l GROUP BY doc_id""")
def lines_by_document(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_index", "line"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max(F.length("line")).alias("longest"))


@register("""
WITH c AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, len(list_filter(regexp_split_to_array(trim(t), '\\n\\s*\\n'), lambda x: trim(x) <> '')) AS n_verses FROM c""")
def verses_by_conversation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n\n").alias("t"))
    return c.select("conv_id", F.size(text.verses(F.col("t"))).alias("n_verses"))


@register("""
WITH t AS (SELECT * FROM conversations WHERE role = 'assistant')
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body, count(*) AS n_sections FROM t GROUP BY conv_id""")
def section_bodies(spark, sf_dir):
    """Turns become ``[turn: role] text`` sections of one text, which is parsed again and attributed by credit."""
    c = table(spark, sf_dir, "conversations").withColumn("part", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit(": "), F.col("role"), F.lit("]\n"), F.col("text")))
    whole = aggregates.ordered_text(c, ["conv_id"], "turn", "part", "\n").select("conv_id", text.sections(F.col("joined")).alias("s"))
    mine = F.filter("s", lambda s: s["credit"] == "assistant")
    return whole.where(F.size(mine) > 0).select("conv_id", text.bodies_credited_to(F.col("s"), "assistant", False).alias("body"), F.size(mine).alias("n_sections"))


@register(r"""
SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS title, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS compact,
  regexp_replace(regexp_replace(lower(concat_ws('_', p_name, p_brand)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part""")
def title_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.normal_title(F.col("p_name")).alias("title"), text.compact_title(F.col("p_name")).alias("compact"), scalars.slug(F.col("p_name"), F.col("p_brand")).alias("slug"))


# Vocabulary

@register(f"""
WITH t AS (SELECT lang, unnest({WORDS}) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM t WHERE length(term) > 2 GROUP BY ALL)
SELECT lang, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 20""")
def top_terms(spark, sf_dir):
    counts = vocabulary.term_counts(table(spark, sf_dir, "documents"), ["lang"], text.tokens(F.col("text")))
    return vocabulary.top_terms(counts, ["lang"], 20)


@register(f"""
WITH t AS (SELECT lang, unnest({WORDS}) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM t WHERE term NOT IN ('the', 'and') GROUP BY ALL),
 g AS (SELECT count(DISTINCT lang) AS groups FROM t), d AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) <= 0.85 * (SELECT groups FROM g)),
 w AS (SELECT lang, term, (1 + ln(n)) * (ln((1 + groups) / (1 + df)) + 1) AS w FROM c JOIN d USING (term), g),
 s AS (SELECT lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY lang)) AS tfidf FROM w)
SELECT lang, term, round(tfidf, 6) AS tfidf, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(tfidf, 9) DESC, term) AS rank FROM s) WHERE rank <= 12""")
def distinctive_terms(spark, sf_dir):
    counts = vocabulary.term_counts(table(spark, sf_dir, "documents"), ["lang"], text.tokens(F.col("text")))
    return vocabulary.tfidf(counts, "lang", 12, stop_words=("the", "and")).withColumn("tfidf", F.round("tfidf", 6))


@register(f"""
WITH t AS (SELECT lang, unnest({WORDS}) AS term FROM documents), a AS (SELECT term, count(*) AS a FROM t WHERE lang = 'en' GROUP BY 1), b AS (SELECT term, count(*) AS b FROM t WHERE lang = 'de' GROUP BY 1),
 j AS (SELECT term, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (term)), s AS (SELECT sum(a) AS ta, sum(b) AS tb, count(*) AS v FROM j)
SELECT term, a, b, round(ln((a + 1) / (ta + v)) - ln((b + 1) / (tb + v)), 6) AS log_odds FROM j, s WHERE a + b >= 20""")
def log_odds(spark, sf_dir):
    counts = vocabulary.term_counts(table(spark, sf_dir, "documents").where("lang in ('en', 'de')"), ["lang"], text.tokens(F.col("text")))
    odds = vocabulary.log_odds(counts.where("lang = 'en'"), counts.where("lang = 'de'"))
    return odds.where("a + b >= 20").withColumn("log_odds", F.round("log_odds", 6))


# Rollups

@register("""SELECT date_trunc('month', o_orderdate)::DATE AS period, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def period_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(scalars.month_start(F.col("o_orderdate")).alias("period")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("""
SELECT (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS quarter_end, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1""")
def quarter_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(scalars.quarter_end(F.col("o_orderdate")).alias("quarter_end")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@register("""
WITH l AS (SELECT l_returnflag, l_linestatus, l_discount - 0.05 AS v FROM lineitem)
SELECT l_returnflag, l_linestatus, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(coalesce(stddev_samp(v), 0), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
  round(avg(CASE WHEN v > 0.025 THEN 1 ELSE 0 END), 6) AS pct_above, round(avg(CASE WHEN v < -0.025 THEN 1 ELSE 0 END), 6) AS pct_below, round(avg(CASE WHEN v BETWEEN -0.025 AND 0.025 THEN 1 ELSE 0 END), 6) AS pct_between FROM l GROUP BY ALL""")
def distribution_by_flag(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_discount") - 0.05)
    out = aggregates.distribution(l, ["l_returnflag", "l_linestatus"], "v", 0.025, -0.025)
    return out.select("l_returnflag", "l_linestatus", "n", *[F.round(c, 6).alias(c) for c in out.columns[3:]])


@register("""
SELECT 'event_type' AS grouping, event_type AS key, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type
UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*), round(sum(value), 2) FROM events GROUP BY user_id""")
def twin_rollups(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return aggregates.rollups(e, ["event_type", "user_id"], [F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")])


@register("""
SELECT event_type, user_id, count(*) AS n, round(sum(value), 2) AS total, grouping_id(event_type, user_id)::BIGINT AS level FROM events GROUP BY CUBE (event_type, user_id)""")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "events").cube("event_type", "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.grouping_id("event_type", "user_id").alias("level"))


@register("""
WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, source, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM c""")
def language_shares(spark, sf_dir):
    return aggregates.shares(table(spark, sf_dir, "documents"), ["lang", "source"], ["source"]).withColumn("share", F.round("share", 6))


@register("""
SELECT l_shipmonth, coalesce(sum(n) FILTER (l_returnflag = 'A'), 0)::BIGINT AS "A", coalesce(sum(n) FILTER (l_returnflag = 'N'), 0)::BIGINT AS "N", coalesce(sum(n) FILTER (l_returnflag = 'R'), 0)::BIGINT AS "R"
FROM (SELECT date_trunc('month', l_shipdate)::DATE AS l_shipmonth, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1""")
def pivot_by_flag(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("l_shipmonth", scalars.month_start(F.col("l_shipdate")))
    return l.groupBy("l_shipmonth").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)


@register("""SELECT 'doc_id' AS column_name, count_if(doc_id IS NULL) AS n_missing, count(*) AS n_rows FROM documents UNION ALL SELECT 'text', count_if(text IS NULL OR text = ''), count(*) FROM documents
UNION ALL SELECT 'lang', count_if(lang IS NULL OR lang = ''), count(*) FROM documents UNION ALL SELECT 'source', count_if(source IS NULL OR source = ''), count(*) FROM documents UNION ALL SELECT 'n_chars', count_if(n_chars IS NULL), count(*) FROM documents""")
def null_profile(spark, sf_dir):
    return aggregates.null_profile(table(spark, sf_dir, "documents"))


@register("""
SELECT p_name, string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS groups, count(DISTINCT p_brand) AS n_groups FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 2""")
def title_collisions(spark, sf_dir):
    return aggregates.collisions(table(spark, sf_dir, "part"), "p_name", "p_brand")


@register("""
WITH m AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS v FROM events GROUP BY ALL)
SELECT event_type, max(v) AS peak, min(v) AS trough, first(day ORDER BY v DESC, day) AS peak_label, first(day ORDER BY v, day) AS trough_label FROM m GROUP BY event_type""")
def peaks(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    return aggregates.argmax(daily, ["event_type"], "day", "v")


@register("""
SELECT event_type, quantile_cont(value, 0.025) AS q025, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.975) AS q975 FROM events GROUP BY event_type""")
def quantiles(spark, sf_dir):
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.75), F.lit(0.975)))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(q.alias("q")).select("event_type", F.col("q")[0].alias("q025"), F.col("q")[1].alias("q75"), F.col("q")[2].alias("q975"))


# Temporal joins

SEVERE = "SELECT * FROM events WHERE value > 150"


def severe(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value > 150").select(F.col("event_id").alias("e_id"), F.col("event_type").alias("e_type"), F.col("ts").alias("e_ts"))


@register(f"""
WITH s AS ({SEVERE}) SELECT e.event_id, (SELECT max(s.ts) FROM s WHERE s.ts <= e.ts) AS event_at,
  (SELECT max(s.event_id) FROM s WHERE s.ts = (SELECT max(x.ts) FROM s x WHERE x.ts <= e.ts)) AS e_id FROM events e""")
def asof_event(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return temporal.asof(e, severe(spark, sf_dir), "ts", "e_ts", ["e_id"], unit="DAY").select("event_id", "event_at", "e_id")


@register(f"""
WITH s AS (SELECT event_type, ts, max(event_id) AS e_id FROM ({SEVERE}) GROUP BY ALL)
SELECT e.event_id, s.ts AS event_at, s.e_id FROM events e ASOF LEFT JOIN s ON e.event_type = s.event_type AND e.ts >= s.ts""")
def asof_by_type(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    s = severe(spark, sf_dir).withColumnRenamed("e_type", "event_type")
    return temporal.asof(e, s, "ts", "e_ts", ["e_id"], ["event_type"], unit="DAY").select("event_id", "event_at", "e_id")


@register(f"""
WITH s AS (SELECT ts::DATE AS d, count(*) AS n FROM ({SEVERE}) GROUP BY 1)
SELECT event_id, coalesce((SELECT sum(n) FROM s WHERE d > e.ts::DATE - 3 AND d <= e.ts::DATE), 0)::BIGINT AS events_3d, coalesce((SELECT sum(n) FROM s WHERE d > e.ts::DATE - 7 AND d <= e.ts::DATE), 0)::BIGINT AS events_7d FROM events e""")
def trailing_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return temporal.trailing_counts(e, severe(spark, sf_dir), "ts", "e_ts", [3, 7]).drop("ts")


@register("""
WITH s AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE o_totalprice > 440000), o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders),
 x AS (SELECT o_orderkey, (SELECT max(s.d) FROM s WHERE s.d <= o.d) AS a, (SELECT min(s.d) FROM s WHERE s.d >= o.d) AS b, d FROM o)
SELECT o_orderkey, CASE WHEN b IS NULL OR d - a <= b - d THEN d - a ELSE -(b - d) END::INT AS days_away FROM x""")
def nearest_event(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    s = table(spark, sf_dir, "orders").where("o_totalprice > 440000").select(F.to_date("o_orderdate").alias("sd"), F.col("o_orderkey").alias("s_key"))
    return temporal.nearest(o, s, "d", "sd", ["s_key"]).select("o_orderkey", "days_away")


@register("""
WITH p(name, a, b) AS (VALUES ('early', DATE '1995-01-01', DATE '1997-06-30'), ('late', DATE '1997-01-01', DATE '2001-12-31'), ('gap', DATE '1998-01-01', DATE '1998-03-01'))
SELECT o_orderkey, (SELECT min(name) FROM p WHERE o_orderdate::DATE BETWEEN a AND b) AS name FROM orders""")
def spans(spark, sf_dir):
    p = spark.createDataFrame([("early", "1995-01-01", "1997-06-30"), ("late", "1997-01-01", "2001-12-31"), ("gap", "1998-01-01", "1998-03-01")], "name string, a string, b string")
    return temporal.within_spans(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), p, "o_orderdate", "a", "b", "name").drop("o_orderdate")


@register("""
WITH e AS (SELECT o_orderkey, unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', date_trunc('month', o_orderdate) + INTERVAL 365 DAY), INTERVAL 1 MONTH))::DATE AS month FROM orders WHERE o_totalprice > 440000),
 m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, round(sum(v * n) / sum(n), 4) AS mean_after, sum(n)::BIGINT AS n_after FROM e JOIN m USING (month) GROUP BY 1""")
def post_event_months(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.groupBy(scalars.month_start(F.col("o_orderdate")).alias("month")).agg(F.avg("o_totalprice").alias("v"), F.count("*").alias("n"))
    e = temporal.months_after(o.where("o_totalprice > 440000").select("o_orderkey", "o_orderdate"), "o_orderdate")
    return e.join(F.broadcast(m), "month").groupBy("o_orderkey").agg(F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 4).alias("mean_after"), F.sum("n").alias("n_after"))


@register("""
SELECT event_type, round(avg(value) FILTER (ts::DATE - DATE '2024-01-15' BETWEEN -7 AND -1), 6) AS mean_before, round(avg(value) FILTER (ts::DATE - DATE '2024-01-15' BETWEEN 1 AND 7), 6) AS mean_after,
  count(*) FILTER (ts::DATE - DATE '2024-01-15' BETWEEN -7 AND -1) AS n_before, count(*) FILTER (ts::DATE - DATE '2024-01-15' BETWEEN 1 AND 7) AS n_after FROM events GROUP BY event_type""")
def before_after(spark, sf_dir):
    out = temporal.before_after(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-15").cast("date"), 7, "value", ["event_type"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_before", "mean_after")})


# Windows and series

@register("""
SELECT doc_id, text, lang FROM (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY source, doc_id) AS n FROM documents) WHERE n = 1""")
def priority_dedup(spark, sf_dir):
    return series.first_per_key(table(spark, sf_dir, "documents"), ["text", "lang"], ["source", "doc_id"]).select("doc_id", "text", "lang")


@register("""
SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_orders(spark, sf_dir):
    return series.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@register("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def top_global(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@register("""
SELECT p_partkey, round((rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2) / count(*) OVER (), 9) AS pct_rank FROM part""")
def percentile_ranks(spark, sf_dir):
    return series.percentile_rank(table(spark, sf_dir, "part"), "p_size").select("p_partkey", F.round("pct_rank", 9).alias("pct_rank"))


MONTHLY = "SELECT date_trunc('month', o_orderdate)::DATE AS month, round(avg(o_totalprice), 2) AS v FROM orders WHERE month(o_orderdate) % 3 <> 0 GROUP BY 1"


def gappy(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("month(o_orderdate) % 3 <> 0")
    return o.groupBy(scalars.month_start(F.col("o_orderdate")).alias("month")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"))


@register(f"""
WITH m AS ({MONTHLY}), c AS (SELECT unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH))::DATE AS month)
SELECT month, last_value(v IGNORE NULLS) OVER (ORDER BY month) AS v FROM c LEFT JOIN m USING (month)""")
def filled_months(spark, sf_dir):
    return series.forward_fill(gappy(spark, sf_dir), "month", ["v"])


@register(f"""
WITH m AS ({MONTHLY}), c AS (SELECT unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH))::DATE AS month),
 j AS (SELECT month, v, row_number() OVER (ORDER BY month) AS i FROM c LEFT JOIN m USING (month)), k AS (SELECT i, v FROM j WHERE v IS NOT NULL)
SELECT month, round(coalesce(j.v, (SELECT a.v + (b.v - a.v) * (j.i - a.i) / (b.i - a.i) FROM k a, k b WHERE a.i = (SELECT max(i) FROM k WHERE i < j.i) AND b.i = (SELECT min(i) FROM k WHERE i > j.i))), 3) AS v FROM j""")
def interpolated_months(spark, sf_dir):
    return series.interpolate(gappy(spark, sf_dir), "month", "v").select("month", F.round("v", 3).alias("v"))


@register(f"""
WITH m AS ({MONTHLY}) SELECT month, round(v - lag(v) OVER (ORDER BY month), 2) AS change, round(avg(v) OVER (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 4) AS mean_before,
  round(avg(v) OVER (ORDER BY month ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 4) AS mean_from FROM m""")
def period_changes(spark, sf_dir):
    out = series.around(series.change(gappy(spark, sf_dir), "month", "v"), "month", "v")
    return out.select("month", F.round("change", 2).alias("change"), *[F.round(c, 4).alias(c) for c in ("mean_before", "mean_from")])


@register("""
WITH d AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS gap_start FROM orders), g AS (SELECT *, lead(gap_start) OVER (PARTITION BY o_custkey ORDER BY gap_start) AS gap_end FROM d)
SELECT o_custkey, gap_start, gap_end, (gap_end - gap_start)::INT AS gap_days FROM g WHERE gap_end - gap_start > 700""")
def silences(spark, sf_dir):
    return series.gaps(table(spark, sf_dir, "orders"), "o_orderdate", 700, ["o_custkey"])


# Sets

@register("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def missing_orders(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return sets.missing(table(spark, sf_dir, "orders").select("o_orderkey"), l, ["o_orderkey"])


@register("""SELECT count(*) AS n_common FROM (SELECT user_id AS k FROM events INTERSECT SELECT c_custkey FROM customer)""")
def key_overlap(spark, sf_dir):
    return sets.overlap(table(spark, sf_dir, "events").select(F.col("user_id").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@register("""
SELECT p_partkey, p_name, p_size FROM part WHERE p_size <= 45 UNION ALL SELECT p_partkey, 'replaced', p_size FROM part WHERE p_size > 45 UNION ALL SELECT p_partkey + 1000000000, 'new', NULL FROM part WHERE p_size = 50""")
def upsert_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    changed = p.where("p_size > 45").withColumn("p_name", F.lit("replaced"))
    new = p.where("p_size = 50").select((F.col("p_partkey") + 1000000000).alias("p_partkey"), F.lit("new").alias("p_name"))
    return sets.upsert(p, sets.aligned_union(changed, new), ["p_partkey"])


@register("""
SELECT doc_id FROM documents d WHERE source NOT IN ('src1', 'src2') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)""")
def exclusions(spark, sf_dir):
    s = spark.createDataFrame([("src1",), ("src2",)], "source string")
    bad = table(spark, sf_dir, "labels").where("quality = 0")
    return sets.without_any(table(spark, sf_dir, "documents").select("doc_id", "source"), [(s, ["source"]), (bad, ["doc_id"])]).select("doc_id")


@register("""
SELECT n_name, p_type, coalesce(n, 0) AS n FROM nation CROSS JOIN (SELECT DISTINCT p_type FROM part) LEFT JOIN
 (SELECT n_name, p_type, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL) USING (n_name, p_type)""")
def entity_grid(spark, sf_dir):
    n, p = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return sets.grid(n.select("n_name"), p.select("p_type").distinct(), l.groupBy("n_name", "p_type").agg(F.count("*").alias("n")), ["n_name", "p_type"], "n", 0)


# Linkage

@register()
def fuzzy_parts(spark, sf_dir):
    """Suppliers and customers by their best fuzzy name."""
    s = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    t = s.select(F.col("p_partkey").alias("other"), F.concat(F.col("p_name"), F.lit(" deluxe")).alias("name"))
    out = linkage.best_match(s, t, "p_name", "name", "other", 60.0)
    return out.select("p_partkey", "match.other", F.round("score", 6).alias("score"))


@register("""
WITH a AS (SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS t FROM part), b AS (SELECT DISTINCT trim(regexp_replace(lower(p_name || ' set'), '[^a-z0-9]+', ' ', 'g')) AS t FROM part)
SELECT a.t AS l_title, b.t AS r_title FROM a, b WHERE a.t = b.t OR (length(a.t) > 5 AND length(b.t) > 5 AND (contains(a.t, b.t) OR contains(b.t, a.t)))""")
def contained_titles(spark, sf_dir):
    a = table(spark, sf_dir, "part").select("p_name").distinct()
    b = a.select(F.concat("p_name", F.lit(" set")).alias("name"))
    return linkage.contained(a, b, "p_name", "name").select("l_title", "r_title")


# Vectors

@register("""
WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), a AS (SELECT c.label AS anchor_label, list(c.x ORDER BY c.i) AS v FROM c GROUP BY c.label)
SELECT vec_id, anchor_label, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, a""")
def anchor_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    out = vectors.similarities(e, vectors.centroids(e, "label", "embedding"), "embedding", "label")
    return out.select("vec_id", "anchor_label", F.round("similarity", 6).alias("similarity"))


# Statistics

@register("""
SELECT event_type, round(avg(value), 6) AS mean, count(value) AS n, round((avg(value) - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) + 0.0 AS z FROM events GROUP BY event_type""")
def effect_sizes(spark, sf_dir):
    out = statistics.effect_sizes(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", F.round("mean", 6).alias("mean"), "n", (F.round("z", 6) + 0.0).alias("z"))


@register()
def bootstrap_by_type(spark, sf_dir):
    return statistics.bootstrap_ci(table(spark, sf_dir, "events"), ["event_type"], "value", 1000)


@register("""
WITH v AS (SELECT o_orderpriority AS g, list(o_totalprice ORDER BY o_orderkey) AS vs, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT g, vs, n, unnest(range(40)) AS b FROM v),
 m AS (SELECT g, list_sum(list_transform(range(n), lambda k: vs[(('0x' || substr(md5('7|' || g || '|' || b || '|' || k), 1, 8))::BIGINT % n) + 1])) / n AS m FROM b)
SELECT g AS o_orderpriority, round(quantile_cont(m, 0.025), 4) AS ci_low, round(quantile_cont(m, 0.975), 4) AS ci_high FROM m GROUP BY g""")
def replayable_bootstrap(spark, sf_dir):
    out = statistics.replayable_bootstrap(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", ["o_orderkey"])
    return out.withColumns({c: F.round(c, 4) for c in ("ci_low", "ci_high")})


@register("""
WITH h AS (SELECT p_partkey, CASE p_partkey % 11 WHEN 3 THEN 'NaN'::DOUBLE WHEN 4 THEN 1.5 WHEN 5 THEN NULL ELSE (p_size % 50) / 1000 + 0.001 END AS p FROM part),
r AS (SELECT p_partkey, p, (rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) AS r, count(*) OVER () AS m FROM h WHERE p_partkey % 11 NOT IN (3, 4, 5))
SELECT p_partkey, round(least(1.0, min(p * m / r) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS p_bh FROM r UNION ALL SELECT p_partkey, p FROM h WHERE p_partkey % 11 IN (3, 4, 5)""")
def false_discovery(spark, sf_dir):
    kind = F.col("p_partkey") % 11
    p = F.when(kind == 3, float("nan")).when(kind == 4, 1.5).when(kind != 5, (F.col("p_size") % 50) / 1000 + 0.001)
    h = table(spark, sf_dir, "part").select("p_partkey", p.alias("p"))
    return statistics.benjamini_hochberg_of_many(h, "p").select("p_partkey", F.round("p_bh", 9).alias("p_bh"))


@register("""
WITH r AS (SELECT (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2) AS a, (rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2) AS b FROM part)
SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r""")
def rank_correlation(spark, sf_dir):
    return statistics.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select(F.round("rho", 6).alias("rho"), "n")


@register()
def resampled_p(spark, sf_dir):
    return statistics.resampled_p(table(spark, sf_dir, "events"), ["event_type"], "value")


# Change points

def monthly(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("period", scalars.month_start(F.col("l_shipdate")))
    return l.groupBy("l_returnflag", "period").agg(F.avg("l_discount").alias("value"))


@register()
def change_points(spark, sf_dir):
    s = series.forward_fill(monthly(spark, sf_dir), "period", ["value"], ["l_returnflag"])
    return changepoints.detect(s, ["l_returnflag"], "period", "value", [(m, p) for m in ("l2", "rbf") for p in (0.00001, 3, 5)])


@register()
def consensus_breaks(spark, sf_dir):
    s = series.forward_fill(monthly(spark, sf_dir), "period", ["value"], ["l_returnflag"])
    points = changepoints.detect(s, ["l_returnflag"], "period", "value", [("l2", p / 1e6) for p in (2, 4, 8, 16)] + [("rbf", p) for p in (1, 3)])
    return changepoints.suppress(changepoints.consensus(points, ["l_returnflag"], least=2), ["l_returnflag"])


# Evidence and audits

@register(f"""
WITH d AS (SELECT doc_id, text, {WORDS} AS ws FROM documents)
SELECT doc_id, len(ws) AS n_words, len(ws) >= 5 AND len(list_distinct(ws)) >= 4 AND length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 15 AND len(list_distinct(ws)) >= 0.5 * len(ws) AS good FROM d""")
def evidence_quality(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", text.tokens(F.col("text")).alias("ws"))
    return d.select("doc_id", F.size("ws").alias("n_words"), evidence.quality_filter(F.col("ws"), F.col("text"), least_ratio=0.5).alias("good"))


@register()
def diverse_evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scores = {"length": F.col("n_chars"), "lines": F.regexp_count("text", F.lit("\n")), "exclaimed": F.regexp_count("text", F.lit("!"))}
    out = evidence.diverse(d, scores, text.skeleton(F.col("text")), ["doc_id"], 40)
    return evidence.growing_cap(out, 35).select("doc_id", "category", "rank", F.round("standing", 6).alias("standing"))


@register("""
WITH f AS (SELECT o_custkey, count(*) AS total, count(DISTINCT l_orderkey) AS found FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_custkey, total, found, CASE WHEN found = total THEN 'complete' WHEN found >= 0.8 * total THEN 'nearly' ELSE 'gaps' END AS grade FROM f""")
def completeness(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    o = table(spark, sf_dir, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    out = o.groupBy("o_custkey").agg(F.count("*").alias("total"), F.count("l_orderkey").alias("found"))
    return out.withColumn("grade", F.when(F.col("found") == F.col("total"), "complete").when(F.col("found") >= 0.8 * F.col("total"), "nearly").otherwise("gaps"))


# Pages and streams

@register()
def page_texts(spark, sf_dir):
    from .sources import markup
    p = markup.pages(table(spark, sf_dir, "pages"))
    return p.select("page_id", F.length("text").alias("n_chars"), F.size("paragraphs").alias("n_paragraphs"), F.size("links").alias("n_links"), F.size("rows").alias("n_rows"))


@register("""
SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def windowed_counts(spark, sf_dir):
    from .streaming import windows
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.windowed_counts(e, "ts", ["event_type"], value="value")
    return out.withColumns({"mean": F.round("mean", 6), "window_start": F.col("window_start").cast("timestamp_ntz")})


@register(f"""
WITH s AS (SELECT ts, max(event_type) AS e_type FROM ({SEVERE}) GROUP BY ts), d AS (SELECT ts::DATE AS d, count(*) AS n FROM ({SEVERE}) GROUP BY 1)
SELECT e.event_id, e.ts, s.e_type, s.ts AS event_at, (e.ts::DATE - s.ts::DATE)::INT AS days_since, {', '.join(f"coalesce((SELECT sum(n) FROM d WHERE d > e.ts::DATE - {w} AND d <= e.ts::DATE), 0)::BIGINT AS events_{w}d" for w in (3, 7, 14))} FROM events e ASOF LEFT JOIN s ON e.ts >= s.ts""")
def event_study(spark, sf_dir):
    from .plans import event_study as study
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return study.proximity(e, severe(spark, sf_dir), "ts", "e_ts", "e_type", (3, 7, 14))


@register()
def tiered_groups(spark, sf_dir):
    from .plans import event_study as study
    return study.tested(table(spark, sf_dir, "events"), ["event_type"], "value")


@register()
def document_features(spark, sf_dir):
    from .plans import features
    d = table(spark, sf_dir, "documents")
    return features.rolled_up(features.measured(d), ["lang", "source"])


# Scalars, filters and joins

@register("""
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'first' ELSE o_orderpriority END AS remapped, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 99 END AS rank,
  CASE WHEN starts_with(o_orderpriority, '1') THEN 0 WHEN starts_with(o_orderpriority, '2') THEN 1 ELSE 2 END AS priority, round(o_totalprice / nullif(o_custkey % 3, 0), 4) AS ratio FROM orders""")
def scalar_rules(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", scalars.remap(F.col("o_orderpriority"), {"1-URGENT": "first"}).alias("remapped"), scalars.ordinal(F.col("o_orderstatus"), {"F": 0, "O": 1}).alias("rank"),
                    scalars.prefix_priority(F.col("o_orderpriority"), ["1", "2"]).alias("priority"), F.round(scalars.safe_ratio(F.col("o_totalprice"), F.col("o_custkey") % 3), 4).alias("ratio"))


@register("""SELECT doc_id, regexp_matches(text, '(?i)the [a-z]+ of') AS flagged FROM documents WHERE source IN ('src1', 'src2', 'src3') AND n_chars BETWEEN 500 AND 5000""")
def filtered_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src2", "src3") & F.col("n_chars").between(500, 5000))
    return d.select("doc_id", text.matches(F.col("text"), "the [a-z]+ of").alias("flagged"))


@register("""
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def labelled_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@register("""
WITH a AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, count(*) AS n_lines FROM lineitem GROUP BY 1)
SELECT month, n_orders, n_lines FROM a FULL JOIN b USING (month)""")
def monthly_outer(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(scalars.month_start(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("n_orders"))
    b = table(spark, sf_dir, "lineitem").groupBy(scalars.month_start(F.col("l_shipdate")).alias("month")).agg(F.count("*").alias("n_lines"))
    return a.join(b, "month", "outer")


@register("""
SELECT a.p_partkey, min(b.p_brand) AS other_brand, count(*) AS n_others FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand <> b.p_brand GROUP BY 1""")
def same_title_elsewhere(spark, sf_dir):
    """Counts by title and brand are joined, not pairs of rows."""
    p = table(spark, sf_dir, "part")
    counts = p.groupBy("p_name", "p_brand").agg(F.count("*").alias("n"))
    other = counts.select("p_name", F.col("p_brand").alias("b"), F.col("n").alias("m"))
    groups = counts.join(other, "p_name").where("p_brand <> b").groupBy("p_name", "p_brand").agg(F.min("b").alias("other_brand"), F.sum("m").alias("n_others"))
    return p.join(groups, ["p_name", "p_brand"]).select("p_partkey", "other_brand", "n_others")


@register("""
SELECT conv_id, string_agg(role || ': ' || text, ' / ' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id""")
def ordered_concat(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("part", F.concat(F.col("role"), F.lit(": "), F.col("text")))
    return aggregates.ordered_text(c, ["conv_id"], "turn", "part", " / ")


@register("""
WITH r AS (SELECT vec_id, (rank() OVER (ORDER BY embedding[1]) + (count(*) OVER (PARTITION BY embedding[1]) - 1) / 2) / count(*) OVER () AS a, (rank() OVER (ORDER BY embedding[2]) + (count(*) OVER (PARTITION BY embedding[2]) - 1) / 2) / count(*) OVER () AS b FROM embeddings)
SELECT vec_id FROM r WHERE a >= 0.75 AND b >= 0.75""")
def quartile_consensus(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return series.percentile_rank(series.percentile_rank(e, "x", "a"), "y", "b").where("a >= 0.75 and b >= 0.75").select("vec_id")


# Models and records

LEXICON = {"the": 0.5, "thing": 1.5, "and": -0.5, "ered": 2.0, "inst": -1.0, "que": 1.0, "der": -1.5}


@register(f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents), e AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
w AS (SELECT doc_id, ws[i] AS term, list_filter([CASE WHEN i > 1 THEN ws[i - 1] END, CASE WHEN i > 2 THEN ws[i - 2] END, CASE WHEN i > 3 THEN ws[i - 3] END], lambda x: x IS NOT NULL) AS b FROM e),
l AS (SELECT * FROM (VALUES ('the', 0.5), ('thing', 1.5), ('and', -0.5), ('ered', 2.0), ('inst', -1.0), ('que', 1.0), ('der', -1.5)) t(term, valence)),
v AS (SELECT doc_id, coalesce((valence::DOUBLE + sign(valence) * (CASE WHEN list_contains(b, 'very') THEN 0.293 ELSE 0 END + CASE WHEN list_contains(b, 'really') THEN 0.293 ELSE 0 END + CASE WHEN list_contains(b, 'so') THEN 0.293 ELSE 0 END
  - CASE WHEN list_contains(b, 'slightly') THEN 0.293 ELSE 0 END - CASE WHEN list_contains(b, 'barely') THEN 0.293 ELSE 0 END))
  * CASE WHEN list_has_any(b, ['not', 'no', 'never', 'none', 'nothing', 'cannot', 'can''t', 'don''t', 'isn''t', 'won''t']) THEN -0.74 ELSE 1 END, 0) AS v FROM w LEFT JOIN l USING (term))
SELECT doc_id, round(sum(v) / sqrt(sum(v) * sum(v) + 15), 6) AS compound, round(count(*) FILTER (v > 0) / count(*), 6) AS pos, round(count(*) FILTER (v < 0) / count(*), 6) AS neg, round(count(*) FILTER (v = 0) / count(*), 6) AS neu FROM v GROUP BY doc_id""")
def dictionary_sentiment(spark, sf_dir):
    from .operators import models
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("ws"))
    lexicon = spark.createDataFrame(list(LEXICON.items()), "term string, valence double")
    out = models.sentiment(d, ["doc_id"], F.col("ws"), lexicon)
    return out.withColumns({c: F.round(c, 6) for c in ("compound", "pos", "neg", "neu")})


@register()
def document_topics(spark, sf_dir):
    from .operators import models
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("ws"))
    return models.topics(d, "doc_id", F.col("ws"), k=4, vocabulary=1 << 18)[0]


@register("""
WITH f AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders), p AS (SELECT DISTINCT l_orderkey AS o_orderkey, 1 AS h FROM lineitem)
SELECT o_custkey, count(*) AS total, count(h) AS found, CASE WHEN count(h) = count(*) THEN 'complete' WHEN count(h) >= 0.8 * count(*) THEN 'nearly' ELSE 'gaps' END AS grade FROM f LEFT JOIN p USING (o_orderkey) GROUP BY 1""")
def catalogue_audit(spark, sf_dir):
    from .operators import records
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.audit(table(spark, sf_dir, "orders"), l, "o_custkey", "o_orderkey")


@register("""
SELECT user_id, min(value) AS value, arg_min(event_id, (value, event_id)) AS event_id, count(DISTINCT value) > 1 AS conflicting FROM events GROUP BY user_id""")
def best_values(spark, sf_dir):
    from .operators import records
    return records.best_peak(table(spark, sf_dir, "events"), "user_id", "value", ["event_id"])


@register("""
SELECT o_orderkey, metric, value FROM (SELECT o_orderkey, o_totalprice AS price, o_custkey::DOUBLE AS customer FROM orders) UNPIVOT (value FOR metric IN (price, customer))""")
def metric_rows(spark, sf_dir):
    from .operators import records
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("customer"))
    return records.metric_grid(o, "o_orderkey", ["price", "customer"])


@register("""
WITH m AS (SELECT DISTINCT date_trunc('month', l_shipdate)::DATE AS month FROM lineitem), h AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month FROM orders WHERE o_totalprice > 440000)
SELECT month, h.month IS NOT NULL AS has_point FROM m LEFT JOIN h USING (month)""")
def months_with_points(spark, sf_dir):
    from .operators import records
    months = table(spark, sf_dir, "lineitem").select(scalars.month_start(F.col("l_shipdate")).alias("month")).distinct()
    return records.in_month(table(spark, sf_dir, "orders").where("o_totalprice > 440000"), months, "o_orderdate", "month")


@register("""
SELECT o_orderkey, o_orderdate::DATE > DATE '1996-01-01' AND o_orderdate::DATE <= DATE '1996-12-31' AS after, o_orderdate::DATE > DATE '1995-01-01' AND o_orderdate::DATE <= DATE '1996-01-01' AS before FROM orders""")
def day_windows(spark, sf_dir):
    from .functions import filters
    day, pivot = F.to_date("o_orderdate"), F.lit("1996-01-01").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", filters.after_within(day, pivot, 365).alias("after"), filters.before_within(day, pivot, 365).alias("before"))


@register(r"""
SELECT doc_id, regexp_matches(text, '\b(?:19|20)\d{2}\b') AS dated, regexp_matches(text, '(?i)\b(?:the|and)\b') AS worded FROM documents""")
def flags(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.matches(F.col("text"), r"\b(?:19|20)\d{2}\b").alias("dated"), text.has_word(F.col("text"), ["the", "and"]).alias("worded"))


from . import queries_groups, queries_models, queries_records, queries_texts  # noqa: E402, F401  (registers its own)
