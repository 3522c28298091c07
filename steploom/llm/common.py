"""What the training-data operators share: paths, written tables, text scanning and components.

Nothing here holds a whole table on the driver. A table that is used twice is written to the
folder that the session names in ``spark.checkpoint.dir`` and read again, which also cuts its
lineage; a lost executor then costs a re-read, not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

#: A word: a run of anything but blanks and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a new temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="steploom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again with the same schema.

    The files go when the application ends, as lazy results may read them until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._steploom_path = path
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    return out


def bucketed(df: DataFrame, column: str, tag: str) -> DataFrame:
    """``written``, dealt by a column: what groups by it later needs no shuffle of this table.

    The table's name leaves the catalogue at once; the files, which the plan holds, stay until the application ends.
    """
    spark = df.sparkSession
    name, n = f"{tag}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, column).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    out._steploom_path = path
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    return out


def discard(*frames: DataFrame) -> None:
    """Remove written tables that no later plan reads."""
    for df in frames:
        fs, at = _hadoop(df.sparkSession, df._steploom_path)
        fs.delete(at, True)


def words_of(text: Column) -> Column:
    """The words of a text (null: none), in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step, written: neighbours are hung on the least node that a node sees.

    The least nodes are written before the edges meet them, so that their size is known: a small
    table is broadcast and no edge moves by node; a large one meets the edges in a join that can
    split a node which holds many of them.
    """
    if large:
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges
    least = written(seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = seen.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    after = written(out.where("u <> v").distinct(), "cc")
    discard(edges, least)
    return after


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node with an edge; the component is its least node.

    Alternating large-star and small-star steps on a distributed edge table (Kiveris et al. 2014):
    edge counts never grow, minima are combined before each shuffle, and a hub's edges may be
    split over tasks. Each step is written, and the driver sees only a count and a checksum.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    now = written(edges.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct(), "cc")
    before = None
    while True:
        # Every edge goes from a node to a smaller one; done when each node has one edge, to a root.
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = tuple(mark)
        now = _star(_star(now, True), False)
