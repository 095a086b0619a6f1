"""A search index at rest: postings by the hash of a term's beginning, replaced document by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import build_index
from ..session import cut_lineage
from .canonical import _folder, drop_partition

BUCKETS = 64
#: Letters of a term that its bucket goes by; a query term of as many letters names its bucket.
BEGINNING = 2


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.left(term, F.lit(BEGINNING))), F.lit(buckets)).cast("int")


def _postings(root: str) -> str:
    return f"{root.rstrip('/')}/postings"


def _documents(root: str) -> str:
    return f"{root.rstrip('/')}/documents"


def _at_rest(spark: SparkSession, root: str) -> DataFrame:
    """The postings with their bucket; whether a session infers types of partition columns makes no difference."""
    return spark.read.parquet(_postings(root)).withColumn("bucket", F.col("bucket").cast("int"))


def _there(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, path)
    return bool(fs.exists(folder))


def refresh_index(docs: DataFrame, root: str, *columns: str, buckets: int = BUCKETS) -> dict[str, int]:
    """Bring the index at `root` up to date with `docs` (`doc` and the text columns): counts of documents by status.

    A digest of its texts tells whether a document is `new`, `changed`, `gone` or `unchanged`. Only new and changed
    texts are taken apart, and only the buckets that hold or get postings of a touched document are written again. The
    list of documents is replaced last and touched documents are cleared before they are added, so a run that
    broke off is made good by the next.
    """
    spark = docs.sparkSession
    digest = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    now = docs.select("doc", digest.alias("digest"), *columns)
    known = spark.read.parquet(_documents(root)) if _there(spark, _documents(root)) else now.select("doc", "digest").limit(0)
    status = F.when(F.col("was").isNull(), "new").when(F.col("digest").isNull(), "gone").when(F.col("was") != F.col("digest"), "changed").otherwise("unchanged")
    delta = cut_lineage(now.select("doc", "digest").join(known.select("doc", F.col("digest").alias("was")), "doc", "full").select("doc", "digest", status.alias("status")))
    counts = dict.fromkeys(("new", "changed", "gone", "unchanged", "buckets"), 0)
    counts |= {r.status: r["count"] for r in delta.groupBy("status").count().collect()}
    touched = delta.where("status <> 'unchanged'").select("doc", "status")
    if not sum(counts[s] for s in ("new", "changed", "gone")):
        return counts
    fresh = now.join(touched.where("status <> 'gone'").select("doc"), "doc", "left_semi")
    added = cut_lineage(build_index(fresh, *columns).withColumn("bucket", bucket_of(F.col("term"), buckets)))
    rows, held = added, set()
    if _there(spark, _postings(root)):
        old = _at_rest(spark, root).select(*added.columns)
        held = {r[0] for r in old.join(touched, "doc", "left_semi").select("bucket").distinct().collect()}
        due = sorted(held | {r[0] for r in added.select("bucket").distinct().collect()})
        # the buckets being read are those replaced, so their rows are written aside first
        rows = cut_lineage(old.where(F.col("bucket").isin(due)).join(touched, "doc", "left_anti").unionByName(added))
    left = {r[0] for r in rows.select("bucket").distinct().collect()}
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(_postings(root))
    for gone in held - left:
        drop_partition(spark, _postings(root), "bucket", str(gone))
    delta.where("status <> 'gone'").select("doc", "digest").write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(_documents(root))
    return counts | {"buckets": len(held | left)}


def read_index(spark: SparkSession, root: str, q_terms: DataFrame | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """The index at rest and its documents (`doc`). With the terms of a query, only the buckets they can be in are read.

    That cuts what statistics would need too, so take those of the whole index.
    """
    index, docs = _at_rest(spark, root), spark.read.parquet(_documents(root)).select("doc")
    if q_terms is not None:
        parts = q_terms.select(F.explode(F.split("q_term", " ")).alias("part"))
        short = parts.where(F.length("part") < BEGINNING).limit(1).count()
        if not short:
            named = sorted(r[0] for r in parts.select(bucket_of(F.col("part"), buckets)).distinct().collect())
            index = index.where(F.col("bucket").isin(named))
    return index.drop("bucket"), docs
