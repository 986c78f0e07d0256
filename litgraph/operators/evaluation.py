"""Identity groups, recall and precision, rank statistics, time slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import ranked, saver


def identity_groups(records: DataFrame) -> DataFrame:
    """(record, key) pairs to (record, group): records that share keys, directly or through others; the least record names a group."""
    save = saver(records.sparkSession)
    pairs = records.select("record", "key").distinct()
    labels = save(pairs.select("record").distinct().withColumn("group", F.col("record")))
    while True:
        least = pairs.join(labels, "record").groupBy("key").agg(F.min("group").alias("g"))
        new = pairs.join(least, "key").groupBy("record").agg(F.min("g").alias("g"))
        # a label's own label is taken in the same round, so chains shorten fast
        met = save(labels.join(new, "record").select("record", F.least("group", "g").alias("group"), (F.col("g") < F.col("group")).alias("moved")))
        if not met.where("moved").limit(1).count():
            return met.select("record", "group")
        roots = met.select(F.col("record").alias("group"), F.col("group").alias("root"))
        labels = save(met.join(roots, "group").select("record", F.col("root").alias("group")))


def recall_precision(truth: DataFrame, found: DataFrame, included: DataFrame) -> DataFrame:
    """Of groups: recall of candidates and of what was included, and its precision."""
    t, c, i = (x.select("group").distinct() for x in (truth, found, included))
    n = t.agg(F.count("*").alias("n_truth")).join(c.join(t, "group", "left_semi").agg(F.count("*").alias("hit"))).join(i.join(t, "group", "left_semi").agg(F.count("*").alias("kept"))).join(i.agg(F.count("*").alias("n_included")))
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)), 6)
    return n.select(share("hit", "n_truth").alias("candidate_recall"), share("kept", "n_truth").alias("included_recall"), share("kept", "n_included").alias("precision"))


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks from 1 with ties at their average, from the counts of distinct values, summed over ranges of them."""
    counts = rows.groupBy(value).agg(F.count("*").alias("_n"))
    placed = ranked(counts, [F.col(value)], "_to", F.col("_n"))
    return rows.join(placed.select(value, (F.col("_to") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(name)), value)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Null where a side is constant or there are fewer than two rows."""
    ranked = average_ranks(average_ranks(rows.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "ra"), b, "rb")
    stats = ranked.agg(F.count("*").alias("n"), F.stddev_pop("ra").alias("sa"), F.stddev_pop("rb").alias("sb"), F.corr("ra", "rb").alias("c"))
    return stats.select("n", F.when((F.col("n") >= 2) & (F.col("sa") > 0) & (F.col("sb") > 0), F.round("c", 6)).alias("spearman"))


def relevant(rows: DataFrame, uptake: str = "uptake") -> DataFrame:
    """Ids whose uptake is positive and among the top quarter, ties included; the cut comes from the counts of distinct values."""
    n = rows.count()
    k = max(1, -(-n // 4))
    counts = rows.groupBy(uptake).agg(F.count("*").alias("_n"))
    cut = ranked(counts, [F.desc(uptake)], "_to", F.col("_n")).where(F.col("_to") >= k).agg(F.max(uptake).alias("cut"))
    return rows.join(F.broadcast(cut)).where((F.col(uptake) >= F.col("cut")) & (F.col(uptake) > 0)).select("id")


def precision_at(ranked: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    top = ranked.orderBy(F.desc("score"), "id").limit(k).select("id")
    return top.join(hits.withColumn("hit", F.lit(1)), "id", "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("precision"))


def time_slice(works: DataFrame, citations: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Works up to the cutoff (undated go) and the citations among them."""
    past = works.where(F.col("year") <= cutoff)
    own = past.select("id")
    return past, citations.join(own.withColumnRenamed("id", "citing"), "citing", "left_semi").join(own.withColumnRenamed("id", "cited"), "cited", "left_semi").select("citing", "cited")


def future_uptake(works: DataFrame, citations: DataFrame, cutoff: int, horizon: int) -> DataFrame:
    """Per past work the citations that works of (cutoff, cutoff + horizon] give it."""
    later = works.where((F.col("year") > cutoff) & (F.col("year") <= cutoff + horizon)).select(F.col("id").alias("citing"))
    given = citations.join(later, "citing", "left_semi").groupBy(F.col("cited").alias("id")).agg(F.count("*").alias("uptake"))
    return works.where(F.col("year") <= cutoff).select("id").join(given, "id", "left").na.fill(0, ["uptake"])


def weight_grid(spark: SparkSession, values: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), parts: int = 5) -> DataFrame:
    """All vectors of the values, normalised and distinct."""
    out = spark.range(1, numPartitions=1).select()
    for i in range(parts):
        # values ** parts rows, whatever the data; a join of small tables would multiply their partitions instead
        out = out.select("*", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(f"w{i}"))
    total = sum((F.col(f"w{i}") for i in range(1, parts)), F.col("w0"))
    return out.where(total > 0).select(*[F.round(F.col(f"w{i}") / total, 9).alias(f"w{i}") for i in range(parts)]).distinct()


def leave_one_out(scores: DataFrame) -> DataFrame:
    """(fold, choice, score): per fold the choice with the best mean over the other folds, ties by the least choice."""
    total = scores.groupBy("choice").agg(F.sum("score").alias("total"), F.count("*").alias("n"))
    others = scores.join(total, "choice").select("fold", "choice", "score", F.round((F.col("total") - F.col("score")) / (F.col("n") - 1), 9).alias("mean"))
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("mean"), "choice"))
    return others.withColumn("place", place).where("place = 1").select("fold", "choice", F.round("score", 6).alias("score"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both hold the same distinct rows."""
    x, y = a.distinct(), b.select(*a.columns).distinct()
    return x.exceptAll(y).agg(F.count("*").alias("only_left")).join(y.exceptAll(x).agg(F.count("*").alias("only_right"))).select("only_left", "only_right", ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal"))


def random_rate(rows: DataFrame, hit: Column, k: int, draws: int = 20, seed: int = 7, parts: int = 64) -> DataFrame:
    """Mean share of hits among k rows drawn without replacement, by a hash of the seed, the draw and the id. Each of ``parts`` parts of
    a draw gives its first k rows, so that no draw gathers in one task."""
    each = rows.select("id", hit.cast("double").alias("hit"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    each = each.withColumn("mark", F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col("draw").cast("string"), F.col("id").cast("string")))).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    first = lambda df, *by: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("mark", "id"))).where(F.col("place") <= k)
    return first(first(each, "draw", "part"), "draw").groupBy("draw").agg(F.avg("hit").alias("rate")).agg(F.avg("rate").alias("rate"))


def frontier_evaluation(works: DataFrame, citations: DataFrame, scored: DataFrame, cutoff: int, horizon: int) -> DataFrame:
    """(id, score) of a frontier against the uptake of the years after the cutoff: precision at 5 and 10 of its order and of the
    baseline, the order by citations within the slice."""
    uptake = future_uptake(works, citations, cutoff, horizon)
    _, own = time_slice(works, citations, cutoff)
    local = own.groupBy(F.col("cited").alias("id")).agg(F.count("*").alias("local"))
    rows = saver(works.sparkSession)(scored.join(uptake, "id").join(local, "id", "left").na.fill(0, ["local"]))
    hits = relevant(rows)
    out = rows.agg(F.count("*").alias("windowed")).join(hits.agg(F.count("*").alias("relevant")))
    for name, order in (("p", "score"), ("base", "local")):
        for k in (5, 10):
            out = out.join(precision_at(rows.select("id", F.col(order).alias("score")), hits, k).select(F.col("precision").alias(f"{name}{k}")))  # one row each
    return out


def gap_evaluation(works: DataFrame, citations: DataFrame, clusters: DataFrame, work_concepts: DataFrame, pairs: DataFrame, voids: DataFrame, still: DataFrame, cutoff: int, horizon: int) -> DataFrame:
    """kind, hypotheses, hits. A bridge (a, b: clusters) is anticipated if a later work cites both, a void (a, b: concepts) if one carries
    both, stagnation (cluster_id) is confirmed if one later work at most cites the cluster."""
    later = works.where((F.col("year") > cutoff) & (F.col("year") <= cutoff + horizon)).select("id")
    cites = citations.join(later.withColumnRenamed("id", "citing"), "citing", "left_semi").join(clusters.withColumnRenamed("work_id", "cited"), "cited").select("citing", "cluster_id").distinct()
    carries = work_concepts.join(later.withColumnRenamed("id", "work_id"), "work_id", "left_semi").select("work_id", "concept_id").distinct()

    def both(rows: DataFrame, key: str, value: str) -> DataFrame:
        return rows.select(key, F.col(value).alias("a")).join(rows.select(key, F.col(value).alias("b")), key).where("a < b").select("a", "b").distinct().withColumn("hit", F.lit(1))

    count = lambda kind, rows: rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("hypotheses"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("hits"))
    citers = cites.groupBy("cluster_id").agg(F.count("*").alias("n"))
    quiet = still.join(citers, "cluster_id", "left").withColumn("hit", (F.coalesce("n", F.lit(0)) <= 1).cast("int"))
    return count("bridging", pairs.join(both(cites, "citing", "cluster_id"), ["a", "b"], "left")).union(count("stagnation", quiet)).union(count("matrix_void", voids.join(both(carries, "work_id", "concept_id"), ["a", "b"], "left")))
