"""A stored inverted index over chunks: written once, asked without their texts.

Postings are clustered by lecture and term, in order of the chunk. Ranges of ``SPAN`` chunk numbers, the same for all terms, are blocks, each with the best
score that a chunk of it can get from a term. A search for the best k adds up, for each query, what its terms can give at best in each range (which reads no
postings), scores the most promising range, and then only those others that can still beat the k-th score so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.retrieval import K1, B, words_of
from tidemark.sources import folders

#: Chunk numbers in a block.
SPAN = 256


def build(chunks: DataFrame, path: str, span: int = SPAN, bounds: bool = True) -> None:
    """Writes the index of chunks (video_id, chunk, text) into a new folder; their texts are read and shuffled once, words never are.

    postings: video_id, term, chunk, tf, length, df, block, lead (at one term of each chunk); lectures: video_id, n chunks with words, mean number of words; blocks (unless bounds aren't wanted): video_id, term, block, best.
    """
    spark = chunks.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # a given number, as parts that are joined by the size of their texts hold more words than are sorted in memory
    # document frequencies and order go by lecture and term, so an exchange of texts by lecture serves them; a chunk's words are counted where they lie side by side
    texts = chunks.select("video_id", "chunk", "text").repartition(parts, "video_id").groupBy("video_id", "chunk").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    words = texts.select("video_id", "chunk", F.sort_array(words_of("text")).alias("words"))
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1)))
    # outer, or Spark asks beforehand whether there are any, which takes the words apart again for each of them
    runs = words.withColumn("starts", starts).select("video_id", "chunk", "words", "starts", F.posexplode_outer("starts").alias("place", "at"))
    tf = (F.coalesce(F.get("starts", F.col("place") + 1), F.size("words")) - F.col("at")).cast("long")
    counted = runs.select("video_id", F.get("words", F.col("at")).alias("term"), "chunk", F.size("words").cast("long").alias("length"), tf.alias("tf"), (F.col("place") == 0).alias("lead")).where("term is not null")
    whole = Window.partitionBy("video_id", "term").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the order that is stored
    counted = counted.withColumns({"df": F.count("*").over(whole), "block": F.floor(F.col("chunk") / span)})
    counted.sortWithinPartitions("video_id", "term", "chunk").write.parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    n = F.count_if("lead")
    postings.groupBy("video_id").agg(n.alias("n"), (F.sum("tf") / n).alias("mean")).write.parquet(f"{path}/lectures")
    if bounds:
        best = F.max(impact(F.col("tf"), F.col("length"), F.col("df"), F.col("n"), F.col("mean"))).alias("best")
        postings.join(spark.read.parquet(f"{path}/lectures"), "video_id").groupBy("video_id", "term", "block").agg(best).write.parquet(f"{path}/blocks")


def impact(tf: Column, length: Column, df: Column, n: Column, mean: Column) -> Column:
    """What a term gives a chunk."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class Index:
    """A written index."""

    def __init__(self, spark: SparkSession, path: str):
        self.held, self.lectures, self.path = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lectures"), path

    def postings(self) -> DataFrame:
        """(video_id, chunk, term, tf, length)."""
        return self.held.select("video_id", "chunk", "term", "tf", "length")

    def _scored(self, held: DataFrame) -> DataFrame:
        """Scores of the chunks whose postings queries have met. What the terms give is added in order of size, so chunks with the same terms have the same score."""
        part = impact(F.col("tf"), F.col("length"), F.col("df"), F.col("n"), F.col("mean"))
        parts = held.join(self.lectures, "video_id").groupBy("query_id", "video_id", "chunk").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # a query's terms at most
        return parts.select("query_id", "video_id", "chunk", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x).alias("score"))

    def scores(self, queries: DataFrame) -> DataFrame:
        """Score of each query (query_id, video_id, term) against all chunks of its lecture that have a term of it."""
        return self._scored(self.held.join(queries.distinct(), ["video_id", "term"]))

    def top(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, video_id, chunk, score, rank): the k best chunks of each query; equal scores by chunk."""
        spark = queries.sparkSession
        asked = folders.checkpointed(spark)(queries.select("query_id", "video_id", "term").distinct())
        ranges = spark.read.parquet(f"{self.path}/blocks").join(asked, ["video_id", "term"]).groupBy("query_id", "video_id", "block").agg(F.sum("best").alias("bound"))
        order = Window.partitionBy("query_id", "video_id").orderBy(F.desc("bound"), "block")
        ranges = folders.checkpointed(spark)(ranges.withColumn("place", F.row_number().over(order)))
        met = lambda some: self._scored(self.held.join(asked, ["video_id", "term"]).join(some.select("query_id", "video_id", "block"), ["query_id", "video_id", "block"]))
        first = folders.checkpointed(spark)(_best(met(ranges.where("place = 1")), k))
        reached = first.where(F.col("rank") == k).select("query_id", "video_id", F.col("score").alias("least"))
        # a bound is a sum of the same numbers in another order, so equal ones may differ by rounding
        left = ranges.where("place > 1").join(reached, ["query_id", "video_id"], "left").where(F.col("least").isNull() | (F.col("bound") * (1 + 1e-9) >= F.col("least")))
        return _best(first.drop("rank").unionByName(met(left)), k)


def _best(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "video_id").orderBy(F.desc("score"), "chunk")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
