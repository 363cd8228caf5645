"""Graph operators over node and edge tables: neighbours, paths, links through shared targets, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablewright.functions.schema import REVIEW_STATUSES, USABLE
from sablewright.functions.text import GRAPH_WORDS, has_word, phrases
from sablewright.operators.matching import holding
from sablewright.shared import settled


def neighbours(edges: DataFrame, start: DataFrame, relation: str | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, neighbour, relation) of the start nodes along edges, of one relation if asked."""
    e = edges if relation is None else edges.where(F.col("relation") == relation)
    return e.join(start.select(F.col("node").alias(src)).distinct(), src, "left_semi").select(F.col(src).alias("node"), F.col(dst).alias("neighbour"), "relation").distinct()


def shortest_paths(edges: DataFrame, start: str, goal: str | None, most_depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, depth, path) of what is reached from ``start`` in at most ``most_depth`` steps, by one shortest path each.

    Each round joins only the newest nodes to the edges and leaves out what was reached before, so a node is expanded
    once; of several shortest paths the least is kept. Every front is written, so that no round computes the ones before it
    again, and it ends when nothing new is reached.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(src).cast("string").alias("a"), F.col(dst).cast("string").alias("b")).distinct()
    reached = front = spark.createDataFrame([(str(start), 0, [str(start)])], "node string, depth int, path array<string>")
    for depth in range(1, most_depth + 1):
        step = front.join(e, front.node == e.a).select(F.col("b").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("b")).alias("path"))
        front = settled(step.groupBy("node", "depth").agg(F.min("path").alias("path")).join(reached.select("node"), "node", "left_anti"))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached if goal is None else reached.where(F.col("node") == str(goal))


#: Sources of a target that meet in one task, about.
BLOCK_SOURCES = 2_000


#: Shared targets of a source that one task counts, about.
TASK_LINKS = 5_000_000


def links(edges: DataFrame, src: str, target: str, reason: Column, most_reasons: int | None = None, block: int = BLOCK_SOURCES, task: int = TASK_LINKS) -> DataFrame:
    """Pairs of sources that share targets, with the number of shared targets and the sorted reasons.

    Each source counts once for a target. It meets the greater sources of its target as one array (several, where a target has more than
    ``block`` sources), and only these arrays are shuffled, to the source: pairs are made and counted where they arrive. A source with
    more than ``task`` links is dealt to several tasks by its partners.
    """
    one = edges.select(F.col(src).alias("__s"), F.col(target).alias("__t"), reason.alias("reason")).dropna(subset=["__s", "__t"]).groupBy("__s", "__t").agg(F.min("reason").alias("reason"))
    size = one.groupBy("__t").agg(F.count("*").alias("__n")).where("__n > 1")
    met = one.join(size, "__t").withColumn("__blocks", F.ceil(F.col("__n") / F.lit(block)).cast("int"))
    others = met.groupBy("__t", F.pmod(F.xxhash64("__s"), "__blocks").cast("int").alias("__b")).agg(F.sort_array(F.collect_list("__s")).alias("__all"))
    many = met.groupBy("__s").agg(F.ceil(F.sum("__n") / F.lit(task)).cast("int").alias("__parts")).where("__parts > 1")
    own = met.select("__t", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__b"), "__s", "reason")
    rows = own.join(others, ["__t", "__b"]).select("__s", "reason", F.filter("__all", lambda o: o > F.col("__s")).alias("__all")).where(F.size("__all") > 0)
    rows = rows.join(F.broadcast(many), "__s", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    rows = rows.select("__s", "__part", "reason", F.when(F.col("__parts").isNull(), F.col("__all")).otherwise(F.filter("__all", lambda o: F.pmod(F.xxhash64(o), "__parts") == F.col("__part"))).alias("__all"))
    # links come source by source and sorted within a target, so that the aggregate, which sorts them, merges long runs
    rows = rows.withColumnRenamed("__s", "left_id").repartition("left_id", "__part").sortWithinPartitions("left_id", "__part")
    pairs = rows.select("left_id", "__part", "reason", F.explode("__all").alias("right_id"))
    out = pairs.groupBy("left_id", "__part", "right_id").agg(F.count("*").alias("n_shared"), F.sort_array(F.collect_list("reason")).alias("reasons")).drop("__part")
    return out if most_reasons is None else out.withColumn("reasons", F.slice("reasons", 1, most_reasons))


def node_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))


def searched(edges: DataFrame, phrase: str | None = None, relation: str | None = None, relations: tuple[str, ...] = (), status: str | None = None, n: int = 100) -> DataFrame:
    """Edges by phrase, relation and status, the newest first.

    An unknown relation is no filter; no status means usable edges; an unknown status is no filter.
    """
    out = edges
    if phrase:
        text = F.lower(F.concat_ws("\n", "target_name", "evidence"))
        out = out.where(F.contains(text, F.lit(phrase.lower())))
    if relation in relations:
        out = out.where(F.col("relation") == relation)
    if status is None:
        out = out.where(F.col("review_status").isin(*USABLE))
    elif status in REVIEW_STATUSES:
        out = out.where(F.col("review_status") == status)
    return out.orderBy(F.desc("updated_at"), "edge_id").limit(n)


def related_papers(edges: DataFrame, phrase: str, n: int = 12) -> DataFrame:
    """Papers of the first usable edges that hold a phrase."""
    return searched(edges, phrase, n=n).select(F.col("source_paper_id").alias("paper_id")).distinct()


def question_papers(questions: DataFrame, edges: DataFrame, n: int = 12, key: str = "question_id", text: str = "question") -> DataFrame:
    """(key, phrase, paper_id): the papers that the graph proposes for questions that ask for relations.

    Of a question's phrases, the longest first, the first counts that stands in a usable edge's target or evidence; the papers
    of the ``n`` newest such edges are proposed. Phrases meet edges by ``matching.holding``: one pass for each block of them.
    """
    asked = questions.where(has_word(F.col(text), GRAPH_WORDS)).select(key, F.posexplode(phrases(F.col(text))).alias("__k", "phrase"))
    usable = edges.where(F.col("review_status").isin(*USABLE)).select("edge_id", "source_paper_id", "updated_at", F.lower(F.concat_ws("\n", "target_name", "evidence")).alias("__text"))
    # a task gives the newest edges of a phrase only, so that the many others are never sorted
    first = (n, (("updated_at", "descending"), ("edge_id", "ascending")))
    hits = holding(usable, "__text", asked.select(F.lower("phrase").alias("phrase")), first=first).select(F.col("phrase").alias("__p"), "edge_id", "source_paper_id", "updated_at")
    newest = Window.partitionBy("__p").orderBy(F.desc("updated_at"), "edge_id")
    hits = settled(hits.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= n))  # read twice
    first = asked.join(hits.select("__p").distinct(), F.lower("phrase") == F.col("__p"), "left_semi").groupBy(key).agg(F.min_by("phrase", "__k").alias("phrase"))
    return first.join(hits, F.lower("phrase") == F.col("__p")).select(key, "phrase", F.col("source_paper_id").alias("paper_id")).distinct()


def merged_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by type and normal name; existing ids stay."""
    w = Window.partitionBy("node_type", "normalized_name").orderBy("__new", "node_id")
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")
