"""The pN_ queries of the problems for language models and, where SQL can state them, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.llm.containers import fill_report, pack
from tickforge.llm.mixing import mix
from tickforge.llm.subjects import composition, subject_areas
from tickforge.llm.tokens import with_sizes
from tickforge.llm.topn import Desc, latest, top_n
from tickforge.session import materialize, read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["run_id", "generation", "strategy_id"]
    now = latest(read(spark, d, "strategies"), keys, "ingest_id", ["test_sharpe", "robustness_score"])
    now = now.filter("test_sharpe is not null and not isnan(test_sharpe) and abs(test_sharpe) < double('Infinity')")
    best = top_n(now, keys[:2], [Desc(F.col("test_sharpe")), Desc(F.col("robustness_score")), F.col("strategy_id")], ["ingest_id"], 5)
    return best.select("run_id", "generation", "place", "ingest_id")


def _sizes(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    return materialize(with_sizes(read(spark, d, "documents"), keep), "tokens")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sizes(spark, d, ["doc_id"]), read(spark, d, "containers"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p8_containers(spark, d), read(spark, d, "containers"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """(container_kind, documents, lost, doubled, overfull): what p8_containers promises, counted over all rows: every text is placed once, as pieces
    without gaps, and no container holds more than its capacity."""
    sizes, kinds = _sizes(spark, d, ["doc_id"]), read(spark, d, "containers")
    packed = pack(sizes, kinds)
    given = sizes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"), F.sum("n_tokens").alias("tokens"))
    placed = packed.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count_if(F.col("start") == 0).alias("begun"))
    named = F.array(*[F.lit(r[0]) for r in kinds.select("container_kind").distinct().collect()])  # a few rows
    each = given.withColumn("container_kind", F.explode(named)).join(placed, ["container_kind", "doc_id"], "left")
    per = each.groupBy("container_kind").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce("got", F.lit(-1)) < F.col("tokens")).alias("lost"), F.count_if((F.col("got") > F.col("tokens")) | (F.col("begun") > F.col("copies"))).alias("doubled"))
    load = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("load")).join(F.broadcast(kinds), "container_kind")
    return per.join(load.groupBy("container_kind").agg(F.count_if(F.col("load") > F.col("capacity_tokens")).alias("overfull")), "container_kind")


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """(source, above, foreign): per listed source whether a document is used more than max_repeats times, in one row of the selection or in all (repeated
    rows each count as one), and how many selected documents are not of that source. A selected source that is not listed has a row too."""
    mixed, docs = _mixed(spark, d)[0], read(spark, d, "documents").filter("text is not null")
    each = mixed.select("doc_id", "source", "copies", F.lit(0).alias("rows")).unionByName(docs.select("doc_id", "source", F.lit(0).alias("copies"), F.lit(1).alias("rows")))
    uses = each.groupBy("doc_id", "source").agg(F.sum("copies").alias("uses"), F.max("copies").alias("once"), F.sum("rows").alias("rows")).filter("uses > 0")
    most = F.max(F.greatest("once", F.col("uses") / F.greatest("rows", F.lit(1))))
    used = uses.groupBy("source").agg(most.alias("most"), F.count_if(F.col("rows") == 0).alias("foreign"))
    listed = read(spark, d, "mix_targets").select("source", F.max("max_repeats").over(Window.partitionBy("source")).alias("allowed"))  # of a source listed twice the largest, as in mix
    above = F.coalesce("most", F.lit(0)) > F.greatest("allowed", F.lit(0))  # null repeats are 0, as in mix
    return listed.join(used, "source", "full").select("source", above.alias("above"), F.coalesce("foreign", F.lit(0)).alias("foreign"))


def _mixed(spark: SparkSession, d: str, all_met: bool = False) -> tuple[DataFrame, DataFrame]:
    return mix(_sizes(spark, d, ["doc_id", "source"]), read(spark, d, "mix_targets"), all_met=all_met)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The selection when as many tokens are wanted as the listed sources have."""
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Its shares: some sources are held back by max_repeats, and the others fill up for them."""
    return _mixed(spark, d)[1]


def p9_mix_all_met(spark: SparkSession, d: str) -> DataFrame:
    """The largest selection in which every source meets its share."""
    return _mixed(spark, d, True)[0]


def p9_shares_all_met(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d, True)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subject_areas(read(spark, d, "documents"), read(spark, d, "subject_terms"), read(spark, d, "doc_labels"))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return composition(read(spark, d, "documents"), p10_found(spark, d))


QUERIES = {
    "p1_found": p1_found, "p8_containers": p8_containers, "p8_report": p8_report, "p8_checks": p8_checks, "p9_checks": p9_checks, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_mix_all_met": p9_mix_all_met, "p9_shares_all_met": p9_shares_all_met,
    "p10_found": p10_found, "p10_composition": p10_composition,
}

ORACLE = {
    "p8_checks": "SELECT container_kind, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS documents, 0 AS lost, 0 AS doubled, 0 AS overfull FROM containers WHERE capacity_tokens > 0",
    "p9_checks": "SELECT source, false AS above, 0 AS foreign FROM mix_targets",
    "p1_found": """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY run_id, generation, strategy_id ORDER BY ingest_id DESC) AS v FROM strategies),
p AS (SELECT *, row_number() OVER (PARTITION BY run_id, generation ORDER BY test_sharpe DESC, robustness_score DESC NULLS LAST, strategy_id) AS place
      FROM l WHERE v = 1 AND isfinite(test_sharpe))
SELECT run_id, generation, CAST(place AS INTEGER) AS place, ingest_id FROM p WHERE place <= 5""",
}
