"""What a repository's history says: edit counts, files edited together, commits before a base."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mossline.runtime import micros

#: Blocks of 2**41 microseconds (25 days).
BLOCK_BITS = 41


def latest_commits(commits: DataFrame) -> DataFrame:
    """sha, repo, message, authored_at, files: one row per commit, that delivered last; files distinct, never null."""
    last = F.max_by(F.struct("repo", "message", "authored_at", "files"), F.struct("ingested_at", F.col("authored_at").isNotNull())).alias("_c")
    return (
        commits.filter("sha is not null").groupBy("sha").agg(last)
        .select("sha", "_c.repo", "_c.message", "_c.authored_at", F.array_distinct(F.filter(F.coalesce("_c.files", F.array().cast("array<string>")), lambda f: f.isNotNull())).alias("files"))
    )


def before(commits: DataFrame, base, limit: int | None = None) -> DataFrame:
    """Commits authored strictly before `base`, the newest `limit` of them."""
    kept = commits.filter(F.col("authored_at") < base)
    return kept.orderBy(F.desc("authored_at"), "sha").limit(limit) if limit else kept


def touched(commits: DataFrame) -> DataFrame:
    return commits.select("repo", "sha", "authored_at", F.explode("files").alias("file_path"))


def edit_counts(commits: DataFrame) -> DataFrame:
    """repo, file_path, n_commits."""
    return touched(commits).groupBy("repo", "file_path").agg(F.count(F.lit(1)).alias("n_commits"))


def most_edited(counts: DataFrame, k: int = 200) -> DataFrame:
    """repo, file_path, n_commits, rank (from 1): the k most edited files of each repository, ties by path."""
    order = Window.partitionBy("repo").orderBy(F.desc("n_commits"), "file_path")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def evolved_by(commits: DataFrame, files: DataFrame) -> DataFrame:
    """repo, src, dst: File to Commit, for files that are kept and known."""
    kept = files.select("repo", "file_path").distinct()
    return touched(commits).join(kept, ["repo", "file_path"], "left_semi").select("repo", F.concat_ws("::", F.lit("file"), "file_path").alias("src"), F.concat_ws("::", F.lit("commit"), "sha").alias("dst")).distinct()


def co_edited(commits: DataFrame, files: DataFrame, least: int = 3) -> DataFrame:
    """repo, src, dst, count: files changed by at least `least` common commits, both ways.

    Commits are cut to kept files first, so one vast commit gives pairs of those only; pairs are made of a commit's own
    sorted file list, without a join of commits with themselves.
    """
    kept = files.select("repo", "file_path").distinct()
    lists = touched(commits).join(kept, ["repo", "file_path"], "left_semi").groupBy("repo", "sha").agg(F.array_sort(F.collect_set("file_path")).alias("f")).filter(F.size("f") > 1)
    later = F.transform("f", lambda a, i: F.transform(F.slice(F.col("f"), i + 2, F.size("f")), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    pairs = lists.select("repo", F.explode(F.flatten(later)).alias("p")).groupBy("repo", "p.a", "p.b").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= least)
    return pairs.select("repo", F.col("a").alias("src"), F.col("b").alias("dst"), "count").union(pairs.select("repo", "b", "a", "count"))


def commits_before_base(issues: DataFrame, commits: DataFrame) -> DataFrame:
    """instance_id, n_before, last_before: how many commits of the issue's repository precede its base, and the last one's time."""
    return before_bases(issues, commits).select("instance_id", "n_before", "last_before")


#: Commits that are looked at before a base.
WINDOW = 7_000


def numbered(commits: DataFrame) -> DataFrame:
    """repo, sha, authored_at, no: commits of a repository numbered by time, of equal times the larger sha first; in blocks of time."""
    made = commits.filter("authored_at is not null and repo is not null").select("repo", "sha", "authored_at", F.shiftright(micros("authored_at"), BLOCK_BITS).alias("block"))
    earlier = Window.partitionBy("repo").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = made.groupBy("repo", "block").count().select("repo", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("repo", "block").orderBy("authored_at", F.desc("sha"))
    return made.withColumn("_n", F.row_number().over(inside)).join(offsets, ["repo", "block"]).select("repo", "sha", "authored_at", (F.col("_before") + F.col("_n")).alias("no"))


def windows_before_bases(issues: DataFrame, commits: DataFrame, limit: int = WINDOW) -> DataFrame:
    """instance_id, repo, first_no, last_no, oldest_sha, oldest_at: the newest `limit` commits before each issue's base, as a range of numbers.

    A window is two numbers, so it takes as much room for seven thousand commits as for one; whoever needs the commits
    joins `numbered` by range. Issues without any commit before their base give no row.
    """
    bounds = before_bases(issues, commits).filter("n_before > 0").select("instance_id", "repo", F.greatest(F.lit(1), F.col("n_before") - limit + 1).alias("first_no"), F.col("n_before").alias("last_no"))
    oldest = numbered(commits).select("repo", F.col("no").alias("first_no"), F.col("sha").alias("oldest_sha"), F.col("authored_at").alias("oldest_at"))
    return bounds.join(oldest, ["repo", "first_no"]).select("instance_id", "repo", "first_no", "last_no", "oldest_sha", "oldest_at")


def before_bases(issues: DataFrame, commits: DataFrame) -> DataFrame:
    """instance_id, repo, n_before, last_before: as commits_before_base.

    Commits and bases of a repository stand in one order of time, bases before commits of the same time, so that equal
    times stay out; running counts replace the join of every issue with every commit. They run within blocks of time, on
    top of what the repository's earlier blocks add up to, so a repository of any size spreads over tasks.
    """
    base = commits.filter("authored_at is not null").select(F.col("sha").alias("base_commit"), F.col("repo").alias("base_repo"), F.col("authored_at").alias("base_at"))
    asked = issues.select("instance_id", "base_commit").distinct().join(base, "base_commit").select(F.col("base_repo").alias("repo"), "instance_id", F.col("base_at").alias("at"), F.lit(0).alias("kind"))
    made = commits.filter("authored_at is not null").select("repo", F.lit(None).cast("string").alias("instance_id"), F.col("authored_at").alias("at"), F.lit(1).alias("kind"))
    marks = asked.union(made).withColumn("block", F.shiftright(micros("at"), BLOCK_BITS))
    earlier = Window.partitionBy("repo").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        made.groupBy("repo", F.shiftright(micros("at"), BLOCK_BITS).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
        .unionByName(asked.select("repo", F.shiftright(micros("at"), BLOCK_BITS).alias("block")).distinct().select("repo", "block", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(commits.schema["authored_at"].dataType).alias("last")))
        .groupBy("repo", "block").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        .select("repo", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_earlier"), F.max("last").over(earlier).alias("last_earlier"))
    )
    order = Window.partitionBy("repo", "block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    counted = (
        marks.withColumn("n", F.coalesce(F.sum("kind").over(order), F.lit(0))).withColumn("last", F.max(F.when(F.col("kind") == 1, F.col("at"))).over(order)).filter("kind = 0")
        .join(blocks, ["repo", "block"])
    )
    return counted.select("instance_id", "repo", (F.col("n") + F.col("n_earlier")).alias("n_before"), F.coalesce("last", "last_earlier").alias("last_before"))
