"""Searches over chunks, articles and rules that build on vector hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The tactics that related articles are searched for, in this order.
TACTICS = (
    "persistence", "privilege escalation", "defense evasion", "credential access", "discovery", "lateral movement", "collection",
    "command and control", "exfiltration", "impact", "initial access", "execution",
)
#: The share of a rule's signature in its similarity.
SIGNATURE_WEIGHT = 0.874


def best_per(hits: DataFrame, *keys: str, tie: str) -> DataFrame:
    """The hit of highest similarity for each key, ties to the smaller tie column; pre-aggregated, without a window."""
    rest = [c for c in hits.columns if c not in keys]
    # The largest of (similarity, -tie) is found before the shuffle.
    packed = F.struct(F.col("similarity").alias("_s"), (-F.col(tie)).alias("_t"), *rest)
    return hits.groupBy(*keys).agg(F.max(packed).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in rest))


def chunk_hits(hits: DataFrame, articles: DataFrame, k: int, *, least_score: float) -> DataFrame:
    """The best chunk of each article among hits (article_id, chunk, similarity), articles of least_score or more, the k best."""
    best = best_per(hits, "article_id", tie="chunk")
    kept = best.join(articles.where(F.col("hunt_score") >= least_score).select("article_id", "hunt_score"), "article_id")
    return kept.orderBy(F.desc("similarity"), "article_id").limit(k)


def unified(*legs: tuple[str, DataFrame]) -> DataFrame:
    """Rows of several searches in one table, tagged by kind; columns that a search lacks are null."""
    out = None
    for kind, rows in legs:
        tagged = rows.select(F.lit(kind).alias("kind"), "*")
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def related_phrases(found: DataFrame, k: int, phrases: tuple[str, ...] = TACTICS) -> DataFrame:
    """Phrases in the texts of ranked articles (rank, title, content, similarity): each from its first article, the first k."""
    text = F.lower(F.concat_ws(" ", "title", "content"))
    here = F.filter(
        F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(p).alias("phrase"), F.contains(text, F.lit(p)).alias("there")) for i, p in enumerate(phrases))), lambda p: p["there"]
    )
    rows = found.select("rank", "similarity", "title", F.explode(here).alias("p"))
    first = rows.groupBy("p.phrase").agg(F.min(F.struct("rank", "p.pos", "similarity", "title")).alias("m"))
    return first.orderBy("m.rank", "m.pos").limit(k).select("phrase", "m.similarity", "m.title")


def rule_matches(hits: DataFrame, *, threshold: float) -> DataFrame:
    """Hits of articles among rules as weighted similarities; the threshold comes after the limit of the search."""
    weighted = F.round(F.col("similarity") * SIGNATURE_WEIGHT, 6)
    return hits.withColumn("similarity", weighted).where(F.col("similarity") >= threshold)


def match_summary(matches: DataFrame, articles: DataFrame, *, covered: float, extended: float) -> DataFrame:
    """For each article its best match, how many it has, and whether that covers it, extends a rule or is new."""
    best = matches.groupBy("article_id").agg(F.count(F.lit(1)).alias("matches"), F.max("similarity").alias("best"))
    joined = articles.select("article_id").join(best, "article_id", "left")
    verdict = F.when(F.col("best") >= covered, "covered").when(F.col("best") >= extended, "extend").otherwise("new")
    return joined.select("article_id", F.coalesce("matches", F.lit(0)).alias("matches"), "best", verdict.alias("coverage"))


def annotation_list(annotations: DataFrame, articles: DataFrame) -> DataFrame:
    """Annotations with title and source of their article; those of unknown articles stay."""
    return annotations.join(articles.select("article_id", "title", "source", "discovered_at"), "article_id", "left")


def grouped_by_article(annotations: DataFrame, *columns: str) -> DataFrame:
    """The annotations of each article in one ordered array, which holds one article's rows only."""
    return annotations.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("annotations"))


def ranked(found: DataFrame, key: str) -> DataFrame:
    """A limited list of hits with their ranks; for results of a top-k only, which fit in one task."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), key)))
