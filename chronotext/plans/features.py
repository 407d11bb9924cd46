"""From raw texts to cleaned, deduplicated and measured documents, and their rollups."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexical, scalars, text
from ..operators import aggregates, series


def cleaned(raw: DataFrame, priorities=()) -> DataFrame:
    """Boilerplate goes; of equal keys the row of the best source stays, then the longest, then the smallest id.

    ``raw``: doc_id, title, group, text, source, released (text)."""
    rows = raw.withColumns({"text": text.clean_boilerplate(F.col("text")), "released": scalars.impute_date(F.col("released")), "key": scalars.slug(F.col("title"), F.col("group")), "priority": scalars.prefix_priority(F.col("source"), priorities)})
    return series.first_per_key(rows, ["key"], ["priority", F.desc(F.length("text")), "doc_id"])


def measured(docs: DataFrame, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    words = text.tokens(F.col(body))
    rows = docs.withColumn("__ws", words)
    ws, n_lines = F.col("__ws"), F.size(text.lines(F.col(body)))
    return rows.select(*docs.columns, F.size(ws).alias("n_words"), n_lines.alias("n_lines"), lexical.type_token_ratio(ws).alias("ttr"), lexical.mtld(ws).alias("mtld"), lexical.mean_length(ws).alias("avg_word_len"), lexical.mean_syllables(ws).alias("avg_syllables"), lexical.flesch_kincaid(ws, F.greatest(n_lines, F.lit(1))).alias("fk_grade"), *lexical.pronoun_counts(ws))


def rolled_up(features: DataFrame, groupings) -> DataFrame:
    return aggregates.rollups(features, groupings, [F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), *[F.avg(c).alias(f"avg_{c}") for c in ("ttr", "mtld", "fk_grade")]])
