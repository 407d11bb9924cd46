"""Token counts: totals by source, language and tokenizer version, maintained from signed changes.

A change says what a document adds to or takes from a group: inserts carry +1 document and +tokens, deletes -1 and
-tokens, revisions 0 documents and the difference.  A batch is aggregated to one row per group and written to a folder of
its own; then an empty file in the folder ``commits``, whose name tells batch, version and folder, commits it at once.
Readers take each batch's last version, so an attempt that fails at any point changes nothing, a batch that is committed
again replaces itself, and readers never see a batch half written or gone.  ``sweep`` deletes the folders that no commit
names any more.  Totals are the sums over the committed batches; groups whose documents and tokens are both zero are left out.

Null sources, languages and versions are groups of their own; null token counts count as 0; null texts have no tokens.
Repeated rows each count.  An empty batch commits no rows.  Changes are read by name, other columns ignored.
"""
import uuid

from pyspark.sql import functions as F

from .store import shared_dir, stored

KEYS = ["source", "lang", "tokenizer"]
DELTA_TYPE = "source string, lang string, tokenizer string, documents long, tokens long"
COUNTERS = {"space-1": r"[^\x20\x09-\x0D]+", "alnum-1": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"}


def count_tokens(text, tokenizer):
    return F.coalesce(F.regexp_count(text, F.lit(COUNTERS[tokenizer])), F.lit(0)).cast("long")


def inserts(rows):
    return rows.select(*KEYS, F.lit(1).cast("long").alias("documents"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def deletes(rows):
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("documents"), (-F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))


def revisions(rows):
    """Rows with ``tokens`` and ``new_tokens``."""
    return rows.select(*KEYS, F.lit(0).cast("long").alias("documents"), (F.coalesce("new_tokens", F.lit(0)) - F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))


def _files(spark, path):
    """The file system of a path, and a maker of its paths."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(context._jsc.hadoopConfiguration()), at


def committed(spark, path):
    """{batch: (version, folder)} of each batch's last version: one name a batch, whatever its rows.

    Of two attempts that reached one version at a time, the greater name counts for all readers."""
    files, at = _files(spark, path)
    folder, last = at(f"{path}/commits"), {}
    for status in files.listStatus(folder) if files.exists(folder) else ():
        batch, version, name = status.getPath().getName().split(".")
        last[int(batch)] = max(last.get(int(batch), (0, "")), (int(version), name))
    return last


def commit(path, batch_id, changes):
    """Adds a batch of changes to the rollup at ``path``; the same batch may be committed again."""
    spark, batch, name = changes.sparkSession, int(batch_id), uuid.uuid4().hex
    delta = changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    delta.write.parquet(f"{path}/batches/{name}")
    files, at = _files(spark, path)
    version = committed(spark, path).get(batch, (0, ""))[0] + 1
    files.create(at(f"{path}/commits/{batch}.{version}.{name}"), False).close()


def sweep(spark, path):
    """Deletes what failed attempts and replaced versions left; to be run while no batch is written or read."""
    files, at = _files(spark, path)
    kept = {name for _, name in committed(spark, path).values()}
    folder = at(f"{path}/batches")
    for status in files.listStatus(folder) if files.exists(folder) else ():
        if status.getPath().getName() not in kept:
            files.delete(status.getPath(), True)


def totals(spark, path):
    folders = [f"{path}/batches/{name}" for _, name in committed(spark, path).values()]
    deltas = spark.read.schema(DELTA_TYPE).parquet(*folders) if folders else spark.createDataFrame([], DELTA_TYPE)
    summed = deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return summed.where("documents <> 0 or tokens <> 0")


def op2_token_rollup(spark, sf_dir):
    """All documents are inserted; then some are deleted, some revised and some moved to another source, in batches of
    which the second is committed twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide = docs.select("doc_id", "source", "lang", *(count_tokens(F.col("text"), t).alias(t) for t in COUNTERS))
    long = stored(wide, "counts").select("doc_id", "source", "lang", F.col("alnum-1").alias("alnum"), F.explode(F.create_map(*(c for t in COUNTERS for c in (F.lit(t), F.col(f"`{t}`"))))).alias("tokenizer", "tokens"))
    gone = F.col("doc_id") % 7 == 3
    revised = (F.col("doc_id") % 5 == 1) & (F.col("tokenizer") == "space-1")
    new = F.when(revised, F.col("alnum")).otherwise(F.col("tokens"))
    path = f"{shared_dir(spark)}/chronotext-rollup-{uuid.uuid4().hex}"
    commit(path, 1, inserts(long))
    second = deletes(long.where(gone)).unionAll(revisions(long.where(~gone & revised).withColumn("new_tokens", F.col("alnum"))))
    commit(path, 2, second)
    commit(path, 2, second)
    moved = long.where(~gone & (F.col("doc_id") % 11 == 4)).withColumn("tokens", new)
    commit(path, 3, deletes(moved).unionAll(inserts(moved.withColumn("source", F.lit("moved")))))
    return totals(spark, path)


SQL = r"""
WITH t AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS a,
    len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS b FROM documents WHERE doc_id % 7 <> 3
), l AS (
  SELECT doc_id, source, lang, 'space-1' AS tokenizer, CASE WHEN doc_id % 5 = 1 THEN b ELSE a END AS tokens FROM t
  UNION ALL SELECT doc_id, source, lang, 'alnum-1', b FROM t
)
SELECT CASE WHEN doc_id % 11 = 4 THEN 'moved' ELSE source END AS source, lang, tokenizer, count(*) AS documents, sum(tokens)::BIGINT AS tokens
FROM l GROUP BY ALL
"""
