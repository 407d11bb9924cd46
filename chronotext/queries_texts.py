"""Registered queries of page text, titles, attribution, catalogues and constrained matches, with their SQL."""
from pyspark.sql import functions as F

from .functions import text
from .operators import linkage, statistics
from .operators.lineage import cut
from .queries import ORACLE_SQL, register, table
from .sources import markup


def quoted(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# Texts

CHROME = "raw"
for _pattern, _put in text.PAGE_CHROME:
    CHROME = f"regexp_replace({CHROME}, '{_pattern}', '{_put}', 'g')".replace("\n", "' || chr(10) || '")
TRIMMED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@register(rf"""
WITH w AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '12 Contributors, Translations and Lyrics ' || chr(10) WHEN 1 THEN 'About it. Read More ' ELSE '' END || repeat('This song was released as the first of many, and so it is told here at some length again. ' || chr(10) || chr(10), (doc_id % 8)::INT)
    || coalesce(text, '') || chr(10) || 'You might also like' || chr(10) || 'See Them LiveGet tickets as low as $33' || doc_id || 'Embed' AS raw FROM documents),
 c AS (SELECT doc_id, string_split({TRIMMED.format(CHROME)}, chr(10)) AS ls FROM w),
 k AS (SELECT doc_id, ls, array_to_string(list_transform(list_transform(ls, lambda x: {TRIMMED.format('x')}), lambda x: CASE WHEN x = '' THEN 'b' WHEN length(x) > 80 AND ends_with(x, '.') AND regexp_matches(lower(x), '{'|'.join(text.DESCRIPTIONS)}') THEN 'd' ELSE 'x' END), '') AS code FROM c)
SELECT doc_id, md5({TRIMMED.format("array_to_string(ls[length(regexp_extract(code, '^(?:b*d){0,5}')) + 1:], chr(10))")}) AS kept FROM k""")
def page_chrome(spark, sf_dir):
    """Documents inside a page's chrome, cleaned."""
    k = F.col("doc_id")
    prose = F.lit("This song was released as the first of many, and so it is told here at some length again. \n\n")
    raw = F.concat(F.when(k % 3 == 0, "12 Contributors, Translations and Lyrics \n").when(k % 3 == 1, "About it. Read More ").otherwise(""), F.repeat(prose, (k % 8).cast("int")),
                   F.coalesce("text", F.lit("")), F.lit("\nYou might also like\nSee Them LiveGet tickets as low as $33"), k.cast("string"), F.lit("Embed"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_page(raw)).alias("kept"))


@register(rf"""
WITH p AS (SELECT p_partkey, trim(CASE p_partkey % 4 WHEN 0 THEN p_name || ' (Live at Home)' WHEN 1 THEN p_name || ' [Remix] (feat. A)...' WHEN 2 THEN p_name || ' (Deluxe) (Pt. 2)' ELSE p_name || '..' END) AS t FROM part),
 f AS (SELECT p_partkey, t, regexp_replace(t, '\.+$', '') AS u FROM p),
 g AS (SELECT p_partkey, t, regexp_replace(t, '(?i)(?:\s*[\[(](?:{'|'.join(text.SUFFIXES)})[^)\]]*[\])])+\s*$', '') AS ts, u, regexp_replace(u, '(?i)(?:\s*[\[(](?:{'|'.join(text.SUFFIXES)})[^)\]]*[\])])+\s*$', '') AS us FROM f),
 x AS (SELECT p_partkey, unnest([lower(t), lower(ts), lower(u), lower(us)]) AS k FROM g)
SELECT DISTINCT p_partkey, v AS form FROM (SELECT p_partkey, unnest([k, regexp_replace(k, '\.+$', '')]) AS v FROM x) WHERE v <> ''""")
def title_forms(spark, sf_dir):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    title = F.when(k == 0, F.concat(name, F.lit(" (Live at Home)"))).when(k == 1, F.concat(name, F.lit(" [Remix] (feat. A)..."))).when(k == 2, F.concat(name, F.lit(" (Deluxe) (Pt. 2)"))).otherwise(F.concat(name, F.lit("..")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(text.title_forms(text.compatible(title))).alias("form"))


@register(f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') AS ws FROM documents)
SELECT doc_id, CASE WHEN len(ws) > 0 THEN round(len(list_filter(ws, lambda w: trim(w, '''') IN ({quoted(text.FIRST_PERSON)}))) / len(ws), 9) ELSE 0 END AS rate FROM d""")
def first_person(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.first_person_rate(F.col("text")), 9).alias("rate"))


@register("""
WITH p AS (SELECT p_partkey, p_partkey % 2 = 0 AS lead, p_partkey % 5 = 0 AS mine, p_partkey % 3 = 0 AS others, p_partkey % 7 = 0 AS sampled, p_name AS a, p_type AS b, p_brand AS c FROM part),
 s AS (SELECT p_partkey, lead, [CASE WHEN mine THEN 'm' END, CASE WHEN others THEN 'o' END, CASE WHEN sampled THEN 's' ELSE 'n' END] AS kind, [a, b, c] AS body FROM p),
 r AS (SELECT p_partkey, lead, kind[1] AS x, kind[2] AS y, kind[3] AS z, body FROM s)
SELECT p_partkey,
  concat_ws(chr(10) || chr(10), CASE WHEN x = 'm' THEN body[1] END, CASE WHEN lead AND z = 'n' THEN body[3] END) AS track,
  CASE WHEN x = 'm' THEN body[1] WHEN lead THEN concat_ws(chr(10) || chr(10), CASE WHEN y = 'o' THEN body[2] END, body[3]) ELSE '' END AS by_role,
  CASE WHEN x = 'm' THEN 'credited' WHEN NOT lead THEN 'none' WHEN y = 'o' THEN 'solo, partial' ELSE 'solo' END AS method FROM r""")
def attributed_sections(spark, sf_dir):
    """Sections credited to an artist, to others or to nobody, by three rules."""
    k = F.col("p_partkey")
    full = F.concat(F.when(k % 5 == 0, F.concat(F.lit("[Verse 1: The Artist & Guest]\n"), "p_name", F.lit("\n"))).otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("[Chorus: Somebody Else]\n"), "p_type", F.lit("\n"))).otherwise(""),
                    F.when(k % 7 == 0, "[Sample]\n").otherwise("[Hook]\n"), "p_brand")
    parsed, lead = text.sections(full), k % 2 == 0
    return table(spark, sf_dir, "part").select("p_partkey", text.attributed(parsed, "the artist", lead)["body"].alias("track"), text.attributed(parsed, "the artist", lead, "role")["body"].alias("by_role"),
                                               text.attributed(parsed, "the artist", lead, "solo")["method"].alias("method"))


@register("""
SELECT doc_id, source, n_chars FROM documents WHERE NOT (doc_id % 2 = 0 AND len(regexp_extract_all(coalesce(text, ''), '\\S+')) < 20)""")
def guests_with_words(spark, sf_dir):
    """Guest rows of whose text too little is left go; a lead's rows stay."""
    d = table(spark, sf_dir, "documents")
    return d.where((F.col("doc_id") % 2 != 0) | (text.word_count(F.col("text")) >= 20)).select("doc_id", "source", "n_chars")


# Catalogues and pages

def catalogue_lines(spark, sf_dir):
    """A catalogue per manufacturer and size, a line a part."""
    k = F.col("p_partkey") % 6
    line = (F.when(k == 0, F.concat(F.lit("## "), (F.lit(1990) + F.col("p_partkey") % 17).cast("string"), F.lit(" — *"), "p_brand", F.lit("*")))
            .when(k == 1, F.concat(F.lit("**Studio albums** \""), "p_name", F.lit(",\" and \"ab\""))).when(k == 2, F.concat(F.lit("**Leaks** \""), "p_type", F.lit("\"")))
            .when(k == 3, F.concat(F.lit("**"), "p_name", F.lit(" (Feb 10, 2004)** out. **[Solo]**: \"Intro,\" \""), "p_type", F.lit("\"")))
            .when(k == 4, F.concat(F.lit("**Guest spots**: \""), "p_name", F.lit("\" (*"), "p_brand", F.lit("*); \""), "p_type", F.lit("\" (Other)")))
            .otherwise(F.concat(F.lit("plain \""), "p_name", F.lit("\" [Mixtape]"))))
    return table(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("file"), F.col("p_partkey").alias("n"), line.alias("line"))


HEADS = """
WITH l AS (SELECT concat_ws('-', p_brand, p_size) AS file, p_partkey AS n, p_partkey % 6 AS k, p_name, p_type, p_brand, CASE WHEN p_partkey % 6 = 0 THEN 1990 + p_partkey % 17 END AS y FROM part),
 h AS (SELECT *, last_value(y IGNORE NULLS) OVER w AS year, last_value(CASE WHEN k = 0 THEN p_brand END IGNORE NULLS) OVER w AS era FROM l WINDOW w AS (PARTITION BY file ORDER BY n ROWS UNBOUNDED PRECEDING))
"""


@register(HEADS + """
SELECT file, n, year::INT AS year, era, 0 AS place, 'Intro' AS title, p_name AS work, 'Feb 10, 2004' AS day, 'Solo' AS tag, NULL AS credit FROM h WHERE k = 3
UNION ALL SELECT file, n, year::INT, era, 1, p_type, p_name, 'Feb 10, 2004', 'Solo', NULL FROM h WHERE k = 3
UNION ALL SELECT file, n, year::INT, era, 0, p_name, NULL, NULL, NULL, p_brand FROM h WHERE k = 4
UNION ALL SELECT file, n, year::INT, era, 1, p_type, NULL, NULL, NULL, 'Other' FROM h WHERE k = 4""")
def catalogue_mentions(spark, sf_dir):
    return markup.catalogue_mentions(catalogue_lines(spark, sf_dir))


@register(HEADS + """
, s AS (SELECT *, last_value(CASE k WHEN 0 THEN 'unknown' WHEN 1 THEN 'album' WHEN 2 THEN 'leaks' WHEN 4 THEN 'features' END IGNORE NULLS) OVER (PARTITION BY file ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM h),
 t AS (SELECT file, n, year, section, 0 AS place, p_name AS title FROM s WHERE k IN (1, 4) UNION ALL SELECT file, n, year, section, 1, p_type FROM s WHERE k IN (3, 4) UNION ALL SELECT file, n, year, section, 0, 'Intro' FROM s WHERE k = 3),
 u AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM t WHERE year IS NOT NULL AND section <> 'leaks'),
 r AS (SELECT *, row_number() OVER (PARTITION BY file, year, key ORDER BY CASE section WHEN 'album' THEN 1 WHEN 'features' THEN 2 ELSE 3 END, n, place) AS i FROM u)
SELECT file, year::INT AS year, key, n, section, title FROM r WHERE i = 1""")
def sectioned_titles(spark, sf_dir):
    sections = {"leaks": ("leak", "unreleased"), "album": ("album",), "features": ("guest", "feature")}
    return markup.sectioned_titles(catalogue_lines(spark, sf_dir), sections, ("leaks",), ("[Mixtape]",))


@register("""
SELECT page_id, array_to_string(regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1), chr(10)) AS text FROM pages""")
def page_containers(spark, sf_dir):
    return markup.containers(table(spark, sf_dir, "pages"), [("div", "data-container", "true", True), ("div", "class", "Container__", False), ("div", "class", "ad", True)])


@register("""
SELECT s_suppkey AS page_id, s_name AS title, (s_suppkey * 1234567)::BIGINT AS n, CASE WHEN s_suppkey % 2 = 0 THEN 'RIAA: Gold' END AS award, CASE WHEN s_suppkey % 3 = 0 THEN 'Two Words (song)' END AS linked FROM supplier""")
def page_tables(spark, sf_dir):
    """(title, count) rows, a labelled cell and a linked page of small pages."""
    k = F.col("s_suppkey")
    made = F.concat(F.lit("<a href='/wiki/List_of_x'>l</a><a href='/wiki/File:x'>f</a>"), F.when(k % 3 == 0, "<a href='/wiki/Two_Words_%28song%29#top'>t</a>").otherwise(""), F.lit("<table><tr><th>Title</th><th>Count</th></tr><tr><td><a href='#'>"), "s_name",
                    F.lit("</a></td><td>"), F.format_number((k * 1234567).cast("long"), 0), F.lit("</td><td>"), F.when(k % 2 == 0, "RIAA: Gold").otherwise("BPI: Silver"), F.lit("</td></tr></table>"))
    parsed = markup.pages(table(spark, sf_dir, "supplier").select(k.alias("page_id"), made.alias("html")))
    linked = parsed.select(F.col("page_id").alias("p"), markup.linked_slug(F.col("links"), skipped=("Billboard_", "Recording_", "List_of_", "Help:", "Template:", "Category:", "File:")).alias("linked"))
    rows = markup.table_rows(parsed)
    awards = rows.groupBy(F.col("page_id").alias("q")).agg(F.max(markup.labelled_cell(F.col("cells"), "RIAA")).alias("award"))
    return markup.title_counts(rows).join(linked, F.col("page_id") == F.col("p")).join(awards, F.col("page_id") == F.col("q")).select("page_id", "title", "n", "award", "linked")


# Matches

@register("""
WITH c AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 130 WHEN 1 THEN 100 WHEN 2 THEN 60 WHEN 3 THEN 59 ELSE 0 END AS score FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS i FROM c WHERE score >= 60)
SELECT o_custkey, o_orderkey, score FROM r WHERE i = 1""")
def best_hits(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    score = F.when(k == 0, 130).when(k == 1, 100).when(k == 2, 60).when(k == 3, 59).otherwise(0)
    return linkage.best_hit(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", score.alias("score")), ["o_custkey"], "score", [F.col("o_orderkey")])


@register("""
SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN c_name ELSE 'p' || left(o_orderpriority, 1) END AS found FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def guarded_lookups(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), table(spark, sf_dir, "customer")
    o = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey", "left")
    second = o.select(F.col("o_orderpriority").alias("k"), F.concat(F.lit("p"), F.left("o_orderpriority", F.lit(1))).alias("v")).distinct()
    return linkage.lookup_chain(o, [(c, "o_custkey", "c_custkey", "c_name", F.col("c_acctbal") > 0), (second, "o_orderpriority", "k", "v")]).select("o_orderkey", "found")


def _lcs(a, b):
    """SQL for the length of the longest common subsequence: one row of the table for each character of ``a``."""
    step = "{'c': '', 'r': list_reduce(list_transform(range(0, len(x.r)), lambda j: [j]), lambda u, v: CASE WHEN v[1] = 1 THEN [0, CASE WHEN y.c = y.b[1] THEN 1 ELSE x.r[2] END] ELSE u || [CASE WHEN y.c = y.b[v[1]] THEN x.r[v[1]] + 1 ELSE greatest(u[-1], x.r[v[1] + 1]) END] END), 'b': y.b}"
    chars = f"list_transform(string_split({a}, ''), lambda c: {{'c': c, 'r': [0::BIGINT], 'b': string_split({b}, '')}})"
    start = f"{{'c': '', 'r': list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT), 'b': string_split({b}, '')}}"
    return f"list_reduce([{start}] || {chars}, lambda x, y: {step}).r[-1]"


NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
# Pairs of tables a (l) and b (r) of normal titles with their token-set ratio, written out.
TOKEN_SETS = f"""w AS (
  SELECT l, r, list_sort(list_distinct(string_split(l, ' '))) AS x, list_sort(list_distinct(string_split(r, ' '))) AS y FROM a, b WHERE l <> '' AND r <> ''
), s AS (
  SELECT l, r, array_to_string(list_filter(x, lambda q: list_contains(y, q)), ' ') AS c, array_to_string(list_filter(x, lambda q: NOT list_contains(y, q)), ' ') AS p, array_to_string(list_filter(y, lambda q: NOT list_contains(x, q)), ' ') AS q FROM w
), t AS (
  SELECT l, r, c, p, q, trim(c || ' ' || p) AS m, trim(c || ' ' || q) AS n FROM s
), pairs AS (
  SELECT l, r, CASE WHEN c <> '' AND (p = '' OR q = '') THEN 100.0 ELSE greatest(200.0 * {_lcs('m', 'n')} / (length(m) + length(n)),
    CASE WHEN c <> '' THEN 200.0 * length(c) / (length(c) + length(m)) ELSE 0 END, CASE WHEN c <> '' THEN 200.0 * length(c) / (length(c) + length(n)) ELSE 0 END) END AS score FROM t
)"""


@register(f"""
WITH k AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name), o AS (SELECT {NORMAL.format("left(p_name, 2) || p_name[4:]")} AS l, p_partkey FROM k),
h AS (SELECT {NORMAL.format("p_name")} AS r, p_partkey AS other FROM k), a AS (SELECT DISTINCT l FROM o), b AS (SELECT DISTINCT r FROM h), {TOKEN_SETS}
SELECT p_partkey, arg_max(other, {{'s': score, 'o': other}}) AS other, round(max(score), 6) AS score FROM pairs JOIN o USING (l) JOIN h USING (r) WHERE score >= 85 GROUP BY p_partkey""")
def typed_parts(spark, sf_dir):
    """Part names whose third letter was left out, so that a word differs, and the names that they stand for."""
    k = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    typed = k.select("p_partkey", F.concat(F.left("p_name", F.lit(2)), F.substring("p_name", 4, 1000)).alias("typed"))
    out = linkage.best_match(typed, k.select("p_name", F.col("p_partkey").alias("other")), "typed", "p_name", "other", 85.0)
    return out.select("p_partkey", F.col("match.other").alias("other"), F.round("score", 6).alias("score"))


ORACLE_SQL["fuzzy_parts"] = f"""
WITH k AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name), o AS (SELECT {NORMAL.format("p_name")} AS l, p_partkey FROM k),
h AS (SELECT {NORMAL.format("p_name || ' deluxe'")} AS r, p_partkey AS other FROM k), a AS (SELECT DISTINCT l FROM o), b AS (SELECT DISTINCT r FROM h), {TOKEN_SETS}
SELECT p_partkey, arg_max(other, {{'s': score, 'o': other}}) AS other, round(max(score), 6) AS score FROM pairs JOIN o USING (l) JOIN h USING (r) WHERE score >= 60 GROUP BY p_partkey"""


@register()
def typed_titles(spark, sf_dir):
    """First words of all documents, with one letter left out by a hash, and the most frequent right ones."""
    first = F.concat_ws(" ", F.slice(F.split(F.trim("text"), r"\s+", 5), 1, 4))
    titles = cut(table(spark, sf_dir, "documents").select(first.alias("title")).groupBy("title").agg(F.count("*").alias("n")))
    at = F.pmod(F.xxhash64("title"), F.greatest(F.length("title"), F.lit(1))).cast("int")
    typed = titles.select(F.concat(F.left("title", at), F.expr("substring(title, {} + 2)".format("cast(pmod(xxhash64(title), greatest(length(title), 1)) as int)"))).alias("typed")).distinct()
    out = linkage.best_match(typed, titles, "typed", "title", "n")
    return out.select("typed", F.col("match.title").alias("title"), F.col("match.n").alias("n"), F.round("score", 6).alias("score"))


def _titled(spark, sf_dir, tail):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat("p_name", F.lit(tail)).alias("title"), (F.lit(1990) + F.col("p_partkey") % 30).cast("int").alias("year"), F.col("p_brand").alias("artist"), "p_size")


@register()
def constrained_matches(spark, sf_dir):
    """Best titles of 85 or more, at most a year apart, of artists that are alike."""
    out = linkage.constrained_match(_titled(spark, sf_dir, ""), _titled(spark, sf_dir, " deluxe"), "title", "year", "artist", "p_size", years=1)
    return out.select("key", F.col("match.key").alias("matched"), F.round("score", 6).alias("score"))


@register(f"""
WITH u AS (SELECT DISTINCT p_name AS title FROM part), v AS (SELECT DISTINCT 'the ' || p_name || ' set' AS quote FROM part WHERE p_partkey % 2 = 0),
x AS (SELECT title, {NORMAL.format("title")} AS l FROM u), z AS (SELECT quote, {NORMAL.format("quote")} AS r FROM v), a AS (SELECT DISTINCT l FROM x), b AS (SELECT DISTINCT r FROM z), {TOKEN_SETS},
f AS (SELECT title, quote, score, replace(l, ' ', '') AS g, replace(r, ' ', '') AS h FROM pairs JOIN x USING (l) JOIN z USING (r)),
every AS (SELECT title, quote, greatest(score, CASE WHEN length(g) >= 8 AND length(h) >= 8 AND (contains(h, g) OR contains(g, h)) THEN 95 ELSE 0 END,
  CASE WHEN length(g) <= 7 AND (g = h OR (length(g) >= 4 AND starts_with(h, g))) THEN 98 ELSE 0 END) AS score FROM f)
SELECT title, arg_min(quote, {{'s': -score, 'q': quote}}) AS quote, round(max(score), 6) AS score FROM every WHERE score >= 82 GROUP BY title""")
def best_quotes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    quotes = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("the "), "p_name", F.lit(" set")).alias("quote"))
    out = linkage.best_quote(p, quotes, "p_name", "quote")
    return out.select("title", "quote", F.round("score", 6).alias("score"))


@register()
def volatility_p(spark, sf_dir):
    """Each type's mean of daily deviations against as many days drawn from all types' days."""
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.stddev_samp("value").alias("spread"))
    return statistics.resampled_p(daily, ["event_type"], "spread", corrected=False).select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("p", 6).alias("p"))
