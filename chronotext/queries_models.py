"""Registered queries of fitted models: tagging, topics, embeddings, classifiers."""
from pyspark.sql import functions as F

from .functions import text
from .operators import density, embeddings, entities, linear, models, sets, tagging
from .queries import WORDS, register, table

_FIRST = "'i', 'me', 'my', 'mine', 'myself'"


@register(f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
t AS (SELECT doc_id, ws, list_transform(ws, lambda w: CASE WHEN w IN ({_FIRST}) THEN 'PRON' WHEN length(w) % 4 = 0 THEN 'NOUN' WHEN length(w) % 4 = 1 THEN 'VERB' WHEN length(w) % 4 = 2 THEN 'ADJ' ELSE 'DET' END) AS tags FROM d),
p AS (SELECT *, len(list_filter(tags, lambda t: t IN ('NOUN', 'VERB', 'ADJ'))) AS content, len(list_distinct(ws)) AS types,
  len(list_distinct(list_transform(list_filter(list_zip(ws, tags), lambda z: z[2] IN ('NOUN', 'VERB')), lambda z: list_transform([regexp_replace(z[1], '([a-z]{{3}})(ing|ed|es|s)$', '\\1')],
    lambda b: CASE WHEN regexp_matches(b, '[a-z][a-z]..$') AND b[-1] = b[-2] AND b[-1] NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's') THEN b[:-2] ELSE b END)[1]))) AS bases,
  len(list_filter(ws, lambda w: w IN ({_FIRST}) OR starts_with(w, 'i'''))) AS mine, len(list_filter(list_zip(ws, tags), lambda z: z[2] = 'VERB' AND z[1] NOT IN ('be', 'am', 'is', 'are', 'was', 'were', 'been', 'being', '''m'))) AS verbs,
  len(list_filter(list_zip(ws, tags), lambda z: z[2] = 'PRON' AND z[1] IN ({_FIRST}, 'i''m', 'i''ve', 'i''d', 'i''ll'))) AS first FROM t)
SELECT doc_id, content AS content_words, len(ws) >= 6 AND types >= 4 AND types >= 0.5 * len(ws) AND content >= 2 AS varied, len(ws) >= 6 AND types >= 4 AND bases >= 2 AS lexical_line,
  len(ws) >= 7 AND types >= 4 AND mine <= 0.02 * len(ws) AND list_contains(tags, 'NOUN') AND verbs > 0 AS pronoun_line, round(first / greatest(len(ws), 1), 9) AS first_singular FROM p""")
def tag_filters(spark, sf_dir):
    """The filters over words and tags, on tags that stand for a model's: dealt by a word's length."""
    kind = lambda w: F.length(w) % 4
    tag = lambda w: F.when(w.isin("i", "me", "my", "mine", "myself"), "PRON").when(kind(w) == 0, "NOUN").when(kind(w) == 1, "VERB").when(kind(w) == 2, "ADJ").otherwise("DET")
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("ws")).withColumn("tags", F.transform("ws", tag))
    ws, tags = F.col("ws"), F.col("tags")
    return d.select("doc_id", tagging.content_words(tags).alias("content_words"), tagging.varied(ws, tags).alias("varied"), tagging.lexical_line(ws, tags).alias("lexical_line"),
                    tagging.pronoun_line(ws, tags, 0.02).alias("pronoun_line"), F.round(tagging.morphological_rate(ws, tags), 9).alias("first_singular"))


@register()
def document_tags(spark, sf_dir):
    """Tags by a model that all sentences of all documents fit: each document's sentences, nouns, verbs and adjectives,
    and how many of its sentences pass each filter."""
    s = tagging.sentences(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = tagging.fit(s, rounds=4)
    ws, tags = F.col("words"), F.col("tags")
    counts = {t.lower(): F.sum(tagging.count_tags(tags, t)).alias(t.lower()) for t in ("NOUN", "VERB", "ADJ")}
    passed = {"varied": tagging.varied(ws, tags), "lexical": tagging.lexical_line(ws, tags), "pronoun": tagging.pronoun_line(ws, tags, 0.15)}
    return tagging.tagged(s, model).groupBy("doc_id").agg(F.count("*").alias("sentences"), *counts.values(), *(F.count_if(c).alias(f"n_{k}") for k, c in passed.items()))


@register()
def density_topics(spark, sf_dir):
    """Each document's topic by density (-1 for outliers) and the topic's first words."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("ws"))
    assigned, topics = density.density_topics(d, "doc_id", F.col("ws"))
    return assigned.join(topics, "topic").select("doc_id", "topic", "size", F.array_join("top_words", " ").alias("top_words"))


@register(f"""
WITH d AS (SELECT {WORDS} AS ws FROM documents), e AS (SELECT unnest(ws) AS a, unnest(ws[2:]) AS b1, unnest(ws[3:]) AS b2 FROM d),
p AS (SELECT a, b1 AS b FROM e WHERE b1 IS NOT NULL AND a IS NOT NULL UNION ALL SELECT a, b2 FROM e WHERE b2 IS NOT NULL AND a IS NOT NULL),
c AS (SELECT a, b, count(*) AS c FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) GROUP BY a, b), n AS (SELECT a, sum(c) AS n FROM c GROUP BY a), t AS (SELECT sum(c) AS total FROM c),
m AS (SELECT c.a, c.b, ln(c * total / (x.n * y.n)) AS m FROM c JOIN n x ON c.a = x.a JOIN n y ON c.b = y.a, t)
SELECT a AS word, count(*) AS partners, round(max(m), 6) AS most FROM m WHERE m > 0 GROUP BY a""")
def word_information(spark, sf_dir):
    """Each word's partners of positive mutual information at most two places away, and the greatest."""
    d = table(spark, sf_dir, "documents").select(text.tokens(F.col("text")).alias("ws"))
    return embeddings.word_partners(d, F.col("ws"), 2).select("word", "partners", F.round("most", 6).alias("most"))


@register()
def document_embeddings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("ws"))
    vectors, _ = embeddings.word_vectors(d, F.col("ws"), passes=1)
    return embeddings.text_embeddings(d, "doc_id", F.col("ws"), vectors).select("doc_id", F.transform("embedding", lambda v: F.round(v, 6)).alias("embedding"))


@register()
def scored_documents(spark, sf_dir):
    """Three classes learnt from all labelled rows, and scores of every document: negative is toxic, positive of quality."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    kind = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "neutral")
    model = linear.fit(d.join(l, "doc_id").select("text", kind.alias("label")), "text", "label", ["negative", "neutral", "positive"], rounds=10)
    load, schema = linear.scorer(model)
    return models.score_rows(d, "text", load, schema).drop("text")


@register(f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents), g AS (SELECT phrase, min(label) AS label FROM (
  SELECT array_to_string(ws[1:2], ' ') AS phrase, 'PERSON' AS label FROM d WHERE len(ws) >= 3 UNION ALL SELECT array_to_string(ws[1:3], ' '), 'PLACE' FROM d WHERE len(ws) >= 3 AND doc_id % 2 = 0 UNION ALL SELECT ws[3], 'TERM' FROM d WHERE len(ws) >= 3 AND doc_id % 5 = 0) GROUP BY phrase),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), c AS (SELECT doc_id, i - 1 AS s, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase FROM w, (VALUES (1), (2), (3)) t(n) WHERE i + n - 1 <= len(ws)),
h AS (SELECT doc_id, list({{'s': s, 'n': n, 'l': label, 'e': 0::BIGINT, 'k': 0::BIGINT, 'p': 0::BIGINT, 'x': 0::BIGINT}} ORDER BY s, n DESC) AS spans FROM c JOIN g USING (phrase) GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce([{{'s': 0, 'n': 0, 'l': '', 'e': 0::BIGINT, 'k': 0::BIGINT, 'p': 0::BIGINT, 'x': 0::BIGINT}}] || spans, lambda a, b: CASE WHEN b.s >= a.e THEN {{'s': 0, 'n': 0, 'l': '', 'e': b.s + b.n, 'k': a.k + 1, 'p': a.p + CASE WHEN b.l = 'PERSON' THEN 1 ELSE 0 END, 'x': a.x + b.s * b.n}} ELSE a END) AS r FROM h)
SELECT doc_id, coalesce(r.k, 0) AS n_entities, coalesce(r.p, 0) AS n_persons, coalesce(r.x, 0) AS weight FROM d LEFT JOIN f USING (doc_id)""")
def document_entities(spark, sf_dir):
    """Openings of documents as a gazetteer of three labels, found in all documents, the longest of those that start first."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("ws"))
    opening = lambda n, label: F.struct(F.array_join(F.slice("ws", 1, n), " ").alias("phrase"), F.lit(label).alias("label"))
    third = F.struct(F.col("ws")[2].alias("phrase"), F.lit("TERM").alias("label"))
    openings = F.array(opening(2, "PERSON"), F.when(F.col("doc_id") % 2 == 0, opening(3, "PLACE")), F.when(F.col("doc_id") % 5 == 0, third))
    gazetteer = d.where(F.size("ws") >= 3).select(F.explode(openings).alias("x")).where("x is not null").select("x.phrase", "x.label")
    out = entities.entities(d, "doc_id", F.col("ws"), gazetteer)
    weight = F.aggregate("entities", F.lit(0).cast("long"), lambda s, e: s + e["start"] * e["n"])
    return out.select("doc_id", "n_entities", F.size("persons").alias("n_persons"), weight.alias("weight"))


@register("""
SELECT a.p_partkey, b.p_partkey AS other FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS n FROM part) a JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS n FROM part) b USING (n)""")
def zipped_parts(spark, sf_dir):
    """Parts by key beside parts by size, row for row."""
    p = table(spark, sf_dir, "part")
    return sets.zipped(p.select("p_partkey").orderBy("p_partkey"), p.orderBy("p_size", "p_partkey").select(F.col("p_partkey").alias("other")))
