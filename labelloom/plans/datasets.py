"""Data sets made of the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import Dataset
from ..sources.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _meta(examples: DataFrame, n_features: DataFrame, n_labels: DataFrame) -> DataFrame:
    """One row: both counts are one-row tables."""
    return examples.agg(F.count("*").alias("n_examples")).crossJoin(n_features).crossJoin(n_labels)


def embeddings(spark: SparkSession, sf_dir: str) -> Dataset:
    """Dense: 64 columns and a label of ten for each vector."""
    e = table(spark, sf_dir, "embeddings")
    features = e.select(F.col("vec_id").alias("example_id"), F.posexplode("embedding").alias("feature_id", "value")).select("example_id", F.col("feature_id").cast("bigint").alias("feature_id"), F.col("value").cast("double").alias("value"))
    labels = e.select(F.col("vec_id").alias("example_id"), F.col("label").cast("bigint").alias("label_id"))
    examples = e.select(F.col("vec_id").alias("example_id"))
    width = e.agg(F.max(F.size("embedding")).cast("bigint").alias("n_features"))
    return Dataset(features, labels, examples, _meta(examples, width, e.agg((F.max("label") + 1).cast("bigint").alias("n_labels"))))


EMB = """
emb_f as (select vec_id as example_id, cast(unnest(range(0, len(embedding))) as bigint) as feature_id, cast(unnest(embedding) as double) as value from embeddings),
emb_y as (select vec_id as example_id, cast(label as bigint) as label_id from embeddings),
emb_x as (select vec_id as example_id from embeddings),
emb_l as (select cast(unnest(range(0, (select max(label) + 1 from embeddings))) as bigint) as label_id),
emb_m as (select (select count(*) from embeddings) as n_examples, cast((select max(len(embedding)) from embeddings) as bigint) as n_features, cast((select max(label) + 1 from embeddings) as bigint) as n_labels)
"""


LINES = 1 << 19  # rows of lineitem that a task sums


def orders(spark: SparkSession, sf_dir: str) -> Dataset:
    """Multi-label: an order's quantity by brand; its priority, status, market segment and nation as labels.

    Features are dealt by order, over as many tasks as the lines need: what follows by order needs no other deal.
    """
    o, l, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    brands = p.select("p_brand").distinct().select("p_brand", (F.dense_rank().over(Window.orderBy("p_brand")) - 1).cast("bigint").alias("feature_id"))  # the brands there are
    parts = p.select("p_partkey", "p_brand").join(brands, "p_brand").select("p_partkey", "feature_id")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), l.count() // LINES)
    lines = l.join(parts, l.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("example_id"), "feature_id", "l_quantity").repartition(tasks, "example_id")
    features = lines.groupBy("example_id", "feature_id").agg(F.sum("l_quantity").cast("double").alias("value"))
    who = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    tags = F.array(F.concat(F.lit("n:"), "n_name"), F.concat(F.lit("p:"), "o_orderpriority"), F.concat(F.lit("s:"), "o_orderstatus"), F.concat(F.lit("m:"), "c_mktsegment"))
    tagged = who.select(F.col("o_orderkey").alias("example_id"), F.explode(tags).alias("tag"))
    names = tagged.select("tag").distinct().select("tag", (F.dense_rank().over(Window.orderBy("tag")) - 1).cast("bigint").alias("label_id"))
    labels = tagged.join(names, "tag").select("example_id", "label_id")
    examples = o.select(F.col("o_orderkey").alias("example_id"))
    return Dataset(features, labels, examples, _meta(examples, brands.agg(F.count("*").alias("n_features")), names.agg(F.count("*").alias("n_labels"))))


ORD = """
ord_b as (select p_brand, cast(dense_rank() over (order by p_brand) - 1 as bigint) as feature_id from (select distinct p_brand from part)),
ord_f as (select l_orderkey as example_id, feature_id, cast(sum(l_quantity) as double) as value from lineitem join part on l_partkey = p_partkey join ord_b using (p_brand) group by 1, 2),
ord_t as (select o_orderkey as example_id, unnest(['n:' || n_name, 'p:' || o_orderpriority, 's:' || o_orderstatus, 'm:' || c_mktsegment]) as tag from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
ord_n as (select tag, cast(dense_rank() over (order by tag) - 1 as bigint) as label_id from (select distinct tag from ord_t)),
ord_y as (select example_id, label_id from ord_t join ord_n using (tag)),
ord_x as (select o_orderkey as example_id from orders),
ord_l as (select label_id from ord_n),
ord_m as (select (select count(*) from orders) as n_examples, (select count(*) from ord_b) as n_features, (select count(*) from ord_n) as n_labels)
"""


FREQUENT = 1 << 18  # words that each worker holds
TEXT_BYTES = 32 << 20  # text that a task counts the words of


def words(spark: SparkSession, sf_dir: str) -> Dataset:
    """Sparse: counts of words (three documents or more); language, source, quality and toxicity as labels. Features and labels are named by hash: no global numbering."""
    data, _ = counted_words(spark, sf_dir)
    return Dataset(data.features.drop("df"), data.labels, data.examples, data.meta)


def counted_words(spark: SparkSession, sf_dir: str) -> tuple[Dataset, DataFrame]:
    """``words`` whose features have their number of entries as a column ``df``, and these numbers by word: (word, feature_id, n, df).

    Texts are dealt by document once, and its words counted where it is. The words that are kept are written with their
    numbers; the most frequent ones of them, which nearly all entries are of, go to each worker, so that only entries of
    the others are dealt by word.
    """
    d, m = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size // TEXT_BYTES)
    texts = d.select(F.col("doc_id").alias("example_id"), "text").repartition(parts, "example_id")
    tokens = texts.select("example_id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).filter("word <> ''")
    counted = lambda those, *by: those.groupBy("example_id", *by).agg(F.count("*").cast("double").alias("value"))
    code = F.conv(F.substring(F.md5("word"), 1, 13), 16, 10).cast("bigint")
    common = counted(tokens, "word").groupBy("word").agg(F.count("*").alias("n")).filter("n >= 3").select("word", F.monotonically_increasing_id().alias("word_id"), code.alias("feature_id"), "n")
    common = written(common.withColumn("df", F.sum("n").over(Window.partitionBy("feature_id"))), "words")
    entries = lambda those: those.select("example_id", "feature_id", "value", "df")
    few = common.count() <= FREQUENT
    least = 0 if few else common.orderBy(F.desc("n")).select("n").limit(FREQUENT + 1).agg(F.min("n")).first()[0]
    frequent, others = F.broadcast(common.filter(F.col("n") > least)), common.filter(F.col("n") <= least)
    features = entries(counted(tokens.join(frequent, "word"), "word_id", "feature_id", "df"))
    if not few:
        rest = counted(tokens.join(frequent.select("word"), "word", "left_anti"), "word").join(others, "word")
        features = features.unionByName(entries(rest).repartition(parts, "example_id"))
    kinds = F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("source="), "source"))
    tags = d.select(F.col("doc_id").alias("example_id"), F.explode(kinds).alias("tag"))
    tags = tags.unionByName(m.filter("quality = 1").select(F.col("doc_id").alias("example_id"), F.lit("quality").alias("tag"))).unionByName(m.filter("toxic = 1").select(F.col("doc_id").alias("example_id"), F.lit("toxic").alias("tag"))).filter("tag is not null")
    labels = tags.select("example_id", F.conv(F.substring(F.md5("tag"), 1, 13), 16, 10).cast("bigint").alias("label_id"))
    examples = d.select(F.col("doc_id").alias("example_id"))
    return Dataset(features, labels, examples, _meta(examples, common.agg(F.count("*").alias("n_features")), labels.agg(F.count_distinct("label_id").alias("n_labels")))), common


DOC = r"""
doc_w as (select example_id, word, cast(count(*) as double) as value from (select doc_id as example_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) as word from documents) where word <> '' group by 1, 2),
doc_c as (select word from doc_w group by word having count(*) >= 3),
doc_f as (select example_id, cast('0x' || md5(word)[1:13] as bigint) as feature_id, value from doc_w join doc_c using (word)),
doc_t as (select doc_id as example_id, unnest(['lang=' || lang, 'source=' || source]) as tag from documents union all select doc_id, 'quality' from labels where quality = 1 union all select doc_id, 'toxic' from labels where toxic = 1),
doc_y as (select example_id, cast('0x' || md5(tag)[1:13] as bigint) as label_id from doc_t where tag is not null),
doc_x as (select doc_id as example_id from documents),
doc_l as (select distinct label_id from doc_y),
doc_m as (select (select count(*) from documents) as n_examples, (select count(*) from doc_c) as n_features, (select count(distinct label_id) from doc_y) as n_labels)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def universe(data: Dataset) -> DataFrame:
    """All label ids of a data set that numbers them from 0."""
    return data.meta.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_labels") - 1)).alias("label_id"))


def columns(data: Dataset) -> DataFrame:
    return data.meta.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_features") - 1)).alias("feature_id"))
