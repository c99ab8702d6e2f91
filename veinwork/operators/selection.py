"""Selection of evidence out of re-scored candidates: windows over each question's rows.

Candidates are (qid, ord, score, base, law_title, article_no, source_path, ...); places go by score, then base score, then ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veinwork.functions.text import fold
from veinwork.operators.score import strong_title


def places(*extra: Column, by: tuple[str, ...] = ("qid",)):
    return Window.partitionBy(*by).orderBy(*extra, F.desc("score"), F.desc("base"), F.asc("ord"))


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(places()))


def dedupe_best(rows: DataFrame) -> DataFrame:
    """The best row of each law, article and file. Rows without an article of one file fall together."""
    keyed = rows.withColumn("_key", F.concat_ws("|", fold(F.col("law_title")), fold(F.col("article_no")), fold(F.col("source_path"))))
    return ranked(keyed.withColumn("_n", F.row_number().over(places(by=("qid", "_key")))).where("_n = 1").drop("_n", "_key"))


def above_floor(rows: DataFrame, least: float = 0.03, share: float = 0.55, otherwise: int = 6) -> DataFrame:
    """Rows that reach the share of the question's best score; where none does, the first few."""
    w = Window.partitionBy("qid")
    got = rows.withColumn("_ok", F.col("score") >= F.greatest(F.lit(least), F.max("score").over(w) * share)).withColumn("_any", F.max("_ok").over(w))
    return got.where(F.col("_ok") | (~F.col("_any") & (F.col("rank") <= otherwise))).drop("_ok", "_any", "rank").transform(ranked)


def title_hits_first(rows: DataFrame) -> DataFrame:
    """For questions that quote a title, rows of that title come first. Needs question and title_style."""
    hit = F.col("title_style") & strong_title(F.col("question"), F.col("law_title"))
    return rows.withColumn("_hit", hit).withColumn("rank", F.row_number().over(places(F.desc("_hit")))).drop("_hit")


def ratio_first(rows: DataFrame, keep: int = 3) -> DataFrame:
    """For questions about a ratio with rows that name one: those (domestic ones first), filled up to ``keep``. Needs ratio, ratio_row and domestic_row."""
    w = Window.partitionBy("qid")
    got = rows.withColumn("_hit", F.col("ratio") & F.col("ratio_row")).withColumn("_any", F.max("_hit").over(w))
    order = places(F.desc("_hit"), F.desc(F.col("_hit") & F.col("domestic_row")))
    got = got.withColumn("rank", F.when(F.col("_any"), F.row_number().over(order)).otherwise(F.col("rank")))
    return got.where(~F.col("_any") | F.col("_hit") | (F.col("rank") <= keep)).drop("_hit", "_any")


def leads(rows: DataFrame) -> DataFrame:
    """A row per question: the first and second score, and the lead."""
    w = Window.partitionBy("qid").orderBy("rank")
    got = rows.withColumn("second", F.lead("score").over(w)).where("rank = 1")
    return got.select("qid", F.col("score").alias("top"), "second", (F.col("score") - F.coalesce("second", F.lit(0.0))).alias("gap"))


def single_enough(top: Column, second: Column, gap: Column, definition: Column, anchored: Column) -> Column:
    """One row is enough: it is anchored in the question and clearly ahead."""
    ahead = lambda least, lead, low: (top >= least) & ((gap >= lead) | second.isNull() | (second < low))
    return anchored & F.when(definition, ahead(0.84, 0.18, 0.38)).otherwise(ahead(0.74, 0.12, 0.45))


def fast_single(top: Column, second: Column, broad: Column, compare: Column, lead: float = 0.12) -> Column:
    return second.isNull() | (~broad & ~compare & (top >= 0.58) & (top - second >= max(0.02, lead)))


def evidence_limit(top: Column, second: Column, definition: Column) -> Column:
    strong = (top >= 0.78) & (second.isNull() | (top - second >= 0.18))
    return F.when(~definition, 6).when(top.isNull(), 2).when(strong, 2).otherwise(3)


def per_law(rows: DataFrame, seed: Column, limit: Column | int, most: int = 2) -> DataFrame:
    """Up to ``limit`` rows a question: the seed row, then others in order with at most ``most`` of one law; filled up from the rest."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    law = rows.withColumn("_law", fold(F.col("law_title"))).withColumn("_seed", seed)
    first = Window.partitionBy("qid").orderBy(F.desc("_seed"), "rank")
    law = law.withColumn("_seed", F.col("_seed") & (F.row_number().over(first) == 1))
    law = law.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "_law").orderBy(F.desc("_seed"), "rank")))
    order = Window.partitionBy("qid").orderBy((F.col("_n") > most).cast("int"), F.desc("_seed"), "rank")
    return law.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("_law", "_seed", "_n")
