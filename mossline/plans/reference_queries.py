"""Queries of the retrieval, graph and ranking operators over the project's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mossline.functions import prompts, vectors
from mossline.functions import text as T
from mossline.operators import code_graph, consensus, evaluation, grouping, history, retrieval, seeding, traversal
from mossline.plans import localize as plan
from mossline.plans import providers
from mossline.runtime import cut, table, table_folder
from mossline.sources import diffs, replies, skeletons

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions that several SQL statements begin with.
SQL = {
    "files": "files AS (SELECT repo, file_path, arg_max(content, ingested_at) AS content FROM source_files WHERE repo IS NOT NULL AND file_path IS NOT NULL AND content IS NOT NULL GROUP BY repo, file_path)",
    "reports": "reports AS (SELECT instance_id, arg_max(repo, created_at) AS repo, coalesce(arg_max(problem_statement, created_at), '') AS text FROM issues WHERE instance_id IS NOT NULL GROUP BY instance_id)",
    "commits1": "commits1 AS (SELECT sha, repo, authored_at, list_distinct(coalesce(files, [])) AS files FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY ingested_at DESC) AS k FROM commits WHERE sha IS NOT NULL) WHERE k = 1)",
    "touched": "touched AS (SELECT repo, sha, authored_at, unnest(files) AS file_path FROM commits1)",
    "kept": "kept AS (SELECT repo, file_path, n_commits FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n_commits DESC, file_path) AS k FROM (SELECT repo, file_path, count(*) AS n_commits FROM touched WHERE file_path IS NOT NULL GROUP BY repo, file_path)) WHERE k <= 200)",
    "funcs": "funcs AS (SELECT node_id, repo, file_path, name, qualname, start_line, end_line, docstring FROM (SELECT *, row_number() OVER (PARTITION BY repo, node_id ORDER BY ingested_at DESC) AS k FROM nodes WHERE node_type = 'function' AND node_id IS NOT NULL) WHERE k = 1)",
    "positions": "positions AS (SELECT instance_id, retriever, file_path, score, (row_number() OVER (PARTITION BY instance_id, retriever ORDER BY rank ASC NULLS LAST, score DESC NULLS LAST, file_path) - 1)::INT AS position FROM (SELECT DISTINCT instance_id, retriever, file_path, rank, CASE WHEN isnan(score) THEN NULL ELSE score END AS score FROM rankings WHERE instance_id IS NOT NULL AND file_path IS NOT NULL))",
    "rrf": "rrf AS (SELECT instance_id, file_path, round(sum(w / (60 + position)), 9) AS score, min(struct_pack(i := i, p := position)) AS f FROM positions JOIN (VALUES ('llm', 1.0::DOUBLE, 0), ('bm25', 0.7::DOUBLE, 1), ('dense', 0.7::DOUBLE, 2)) AS weights(retriever, w, i) USING (retriever) GROUP BY instance_id, file_path)",
    "fused": r"fused AS (SELECT instance_id, file_path, score, rank FROM (SELECT instance_id, file_path, s AS score, (row_number() OVER (PARTITION BY instance_id ORDER BY s DESC, f, file_path) - 1)::INT AS rank FROM (SELECT *, round(CASE WHEN regexp_matches(file_path, '(^|/)tests?/|(^|/)tests?\.py$|(^|/)test_[^/]*\.py$|_test\.py$') THEN score * 0.5 ELSE score END, 9) AS s FROM rrf)) WHERE rank < 20)",
    "hunks": r"hunks AS (SELECT DISTINCT instance_id, regexp_extract(patch, '(?m)^\+\+\+ (?:[ab]/)?(\S+)', 1) AS file_path, regexp_extract(h, '@@ -(\d+)', 1)::INT AS start_line, regexp_extract(h, '@@ -(\d+)', 1)::INT + greatest(1, coalesce(nullif(regexp_extract(h, '@@ -\d+,(\d+)', 1), ''), '1')::INT) - 1 AS end_line FROM (SELECT instance_id, patch, unnest(regexp_extract_all(patch, '(?m)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@')) AS h FROM issues WHERE patch IS NOT NULL AND instance_id IS NOT NULL) WHERE regexp_extract(patch, '(?m)^\+\+\+ (?:[ab]/)?(\S+)', 1) LIKE '%.py')",
    "queried": "queried AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0)",
}


def with_parts(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "source_files").filter("repo is not null and file_path is not null and content is not null")
    return rows.groupBy("repo", "file_path").agg(F.max_by("content", "ingested_at").alias("content"))


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest_commits(table(spark, sf_dir, "commits"))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.most_edited(history.edit_counts(_commits(spark, sf_dir)))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.penalised(retrieval.reciprocal_ranks(retrieval.list_positions(table(spark, sf_dir, "rankings"))), 20)


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.functions(table(spark, sf_dir, "nodes"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.reports(table(spark, sf_dir, "issues"))


def _files_of_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).join(_reports(spark, sf_dir).select("instance_id", "repo"), "instance_id")


def bm25_sql(tokens: str) -> str:
    """SQL of the twenty best files by BM25; `tokens` makes a list of terms from a text x."""
    return with_parts("files", "reports") + f"""
, tok AS (SELECT repo, file_path, {tokens.replace("$", "content")} AS t FROM files),
n AS (SELECT repo, count(*) AS n, avg(len(t)) AS avg_len FROM tok GROUP BY repo),
tf AS (SELECT repo, file_path, len, term, count(*) AS tf FROM (SELECT repo, file_path, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL),
idf AS (SELECT repo, term, any_value(avg_len) AS avg_len, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN n USING (repo) GROUP BY repo, term),
fl AS (SELECT repo, 0.25 * avg(idf) AS floor FROM idf GROUP BY repo),
q AS (SELECT instance_id, repo, term, count(*) AS times FROM (SELECT instance_id, repo, unnest({tokens.replace("$", "text")}) AS term FROM reports) GROUP BY ALL),
s AS (SELECT instance_id, file_path, round(sum(times * (CASE WHEN idf < 0 THEN floor ELSE idf END) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score
      FROM q JOIN tf USING (repo, term) JOIN idf USING (repo, term) JOIN fl USING (repo) GROUP BY instance_id, file_path)
SELECT instance_id, file_path, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, file_path)::INT AS rank FROM s) WHERE rank <= 20 AND score > 0
"""


IDENTIFIERS_SQL = "list_transform(regexp_extract_all($, '[A-Za-z_][A-Za-z0-9_]+'), lambda x: lower(x))"
# The pattern's look ahead, put into two replacements: capitals before a digit or underscore go, those before a word are set apart.
CAMEL_SQL = r"regexp_extract_all(regexp_replace(regexp_replace(x, '[A-Z]([0-9_])', ' \1', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+')"
CODE_TOKENS_SQL = (
    "list_transform(flatten(list_transform(regexp_extract_all($, '[A-Za-z_][A-Za-z0-9_]+'), lambda x: list_concat([x], "
    f"CASE WHEN contains(x, '_') THEN list_filter(string_split(x, '_'), lambda p: p <> '') ELSE [] END, CASE WHEN len({CAMEL_SQL}) > 1 THEN {CAMEL_SQL} ELSE [] END))), lambda x: lower(x))"
)


@query(bm25_sql(IDENTIFIERS_SQL))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best files of its repository for each report."""
    index = retrieval.postings(_files(spark, sf_dir), scope="repo", key="file_path", text="content")
    return retrieval.bm25(_reports(spark, sf_dir), index, 20, scope="repo", query="instance_id", text="text", key="file_path")


@query(bm25_sql(CODE_TOKENS_SQL))
def bm25_full_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_topk with tokens split into their parts."""
    index = retrieval.postings(_files(spark, sf_dir), scope="repo", key="file_path", text="content", tokenizer=T.code_tokens)
    return retrieval.bm25(_reports(spark, sf_dir), index, 20, scope="repo", query="instance_id", text="text", key="file_path", tokenizer=T.code_tokens)


@query(with_parts("queried") + """SELECT query_id, vec_id, score, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.v, e.embedding::DOUBLE[]), 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, e.embedding::DOUBLE[]), 12) DESC, e.vec_id)::INT AS rank FROM queried q, embeddings e) WHERE rank <= 10""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every twentieth one."""
    e = table(spark, sf_dir, "embeddings")
    return vectors.top_k(e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e, 10, query_id="query_id", record_id="vec_id", query_vector="embedding", record_vector="embedding", dimensions=64)


@query(with_parts("queried") + """, top AS (SELECT query_id, vec_id, rank - 1 AS old FROM (SELECT q.vec_id AS query_id, e.vec_id,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, e.embedding::DOUBLE[]), 12) DESC, e.vec_id) AS rank FROM queried q, embeddings e) WHERE rank <= 10),
cells AS (SELECT label, i, avg((embedding::DOUBLE[])[i]) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i), means AS (SELECT label, list(m ORDER BY i) AS c FROM cells GROUP BY label),
asked AS (SELECT vec_id AS query_id, list_transform(list_zip(embedding::DOUBLE[], c), lambda x: x[1] + x[2] / (sqrt(list_dot_product(c, c)) + 1e-9)) AS v FROM embeddings JOIN means USING (label) WHERE vec_id % 20 = 0),
s AS (SELECT t.query_id, t.vec_id, t.old, round(list_dot_product(e.embedding::DOUBLE[], a.v), 6) AS score FROM top t JOIN embeddings e ON e.vec_id = t.vec_id JOIN asked a ON a.query_id = t.query_id)
SELECT query_id AS instance_id, vec_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old, vec_id) - 1)::INT AS rank FROM s) WHERE rank < 5""")
def dense_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each query ordered anew by the query as what is known of it adds to it, here its group's mean, and cut to five."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))
    top = dense_topk(spark, sf_dir).withColumn("rank", F.col("rank") - 1)
    means = vectors.unit_mean(e, group="label", vector="embedding")
    asked = e.filter("vec_id % 20 = 0").join(means, "label").select(F.col("vec_id").alias("query_id"), F.zip_with("embedding", "centroid", lambda x, y: x.cast("double") + y).alias("query"))
    candidates = top.join(e, "vec_id").join(asked, "query_id").select(F.col("query_id").alias("instance_id"), "vec_id", F.col("embedding").alias("vector"), "query", "rank")
    return consensus.reranked(candidates, key="vec_id", cut_to=5)


@query("""WITH queried AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
usable AS (SELECT concept_id, centroid::DOUBLE[] AS c, row_number() OVER (PARTITION BY concept_id ORDER BY built_at DESC) AS k FROM concepts
           WHERE len(centroid) = 64 AND len(list_filter(centroid, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
SELECT query_id, concept_id, score, rank FROM (SELECT query_id, concept_id, round(list_dot_product(v, c), 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(v, c), 12) DESC, concept_id)::INT AS rank FROM queried, usable WHERE k = 1) WHERE rank <= 3""")
def concept_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three concepts whose centroids agree most with each query vector."""
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    bad = F.exists("centroid", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    concepts = table(spark, sf_dir, "concepts").filter((F.size("centroid") == 64) & ~bad).groupBy("concept_id").agg(F.max_by("centroid", "built_at").alias("centroid"))
    return vectors.top_k(e, concepts, 3, query_id="query_id", record_id="concept_id", query_vector="embedding", record_vector="centroid", dimensions=64)


@query(with_parts("positions", "rrf") + "SELECT instance_id, file_path, score, f.i AS first_list, f.p AS first_position FROM rrf")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal ranks summed over the three lists."""
    return retrieval.reciprocal_ranks(retrieval.list_positions(table(spark, sf_dir, "rankings")))


@query(with_parts("positions", "rrf", "fused") + "SELECT * FROM fused")
def rrf_penalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test files at half their score, the best 20."""
    return _fused(spark, sf_dir)


@query(with_parts("positions", "rrf", "fused", "files") + """, large AS (SELECT repo FROM files GROUP BY repo HAVING sum(length(content) + 2) > 60000),
pool AS (SELECT DISTINCT instance_id FROM rankings JOIN large USING (repo) WHERE instance_id IS NOT NULL),
without AS (SELECT instance_id FROM pool WHERE instance_id NOT IN (SELECT instance_id FROM positions WHERE retriever = 'llm')),
plain AS (SELECT instance_id, file_path, 0.0::DOUBLE AS score, (row_number() OVER (PARTITION BY instance_id ORDER BY retriever, position, file_path) - 1)::INT AS rank FROM positions JOIN without USING (instance_id) WHERE retriever IN ('bm25', 'dense')),
m AS (SELECT instance_id, file_path, round(CASE WHEN regexp_matches(file_path, '(^|/)tests?/|(^|/)tests?\\.py$|(^|/)test_[^/]*\\.py$|_test\\.py$') THEN s * 0.5 ELSE s END, 9) AS score
      FROM (SELECT instance_id, file_path, round(1.0 / (60 + position), 9) AS s FROM positions WHERE retriever = 'llm' AND instance_id IN (SELECT * FROM pool)))
SELECT instance_id, file_path, score, rank FROM fused WHERE instance_id NOT IN (SELECT * FROM pool)
UNION ALL SELECT * FROM (SELECT instance_id, file_path, score, (row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, file_path) - 1)::INT AS rank FROM m) WHERE rank < 20
UNION ALL SELECT * FROM plain WHERE rank < 20""")
def prefilter_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion, or the model's list for repositories with a long outline (here over 60,000 characters), or without one both others."""
    sizes = retrieval.outline_sizes(_files(spark, sf_dir), scope="repo", text="content")
    return retrieval.prefiltered(table(spark, sf_dir, "rankings"), sizes, limit=60_000)


@query(with_parts("positions") + "SELECT DISTINCT instance_id, file_path FROM positions WHERE retriever IN ('bm25', 'dense') AND position < 100")
def prefilter_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a model would be given to order: the first hundred of both other lists."""
    return retrieval.candidate_pool(retrieval.list_positions(table(spark, sf_dir, "rankings")))


@query(with_parts("files") + "SELECT repo, file_path, running FROM (SELECT repo, file_path, (sum(length(content) + 2) OVER (PARTITION BY repo ORDER BY file_path))::BIGINT AS running FROM files) WHERE running <= 60000")
def outline_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a repository, in order of their paths, that fit a budget of characters."""
    return retrieval.within_budget(_files(spark, sf_dir), scope="repo", key="file_path", text="content", budget=60_000)


@query(with_parts("commits1", "touched") + "SELECT repo, file_path, count(*) AS n_commits FROM touched WHERE file_path IS NOT NULL GROUP BY repo, file_path")
def commit_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: commits per file."""
    return history.edit_counts(_commits(spark, sf_dir))


@query(with_parts("commits1", "touched", "kept") + "SELECT repo, file_path, n_commits, row_number() OVER (PARTITION BY repo ORDER BY n_commits DESC, file_path)::INT AS rank FROM kept")
def top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: the 200 most edited files of each repository."""
    return _kept(spark, sf_dir)


@query(with_parts("commits1", "touched", "kept") + "SELECT DISTINCT repo, 'file::' || file_path AS src, 'commit::' || sha AS dst FROM touched JOIN kept USING (repo, file_path)")
def evolved_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from kept files to their commits."""
    return history.evolved_by(_commits(spark, sf_dir), _kept(spark, sf_dir))


CO_EDITED = with_parts("commits1", "touched", "kept") + """, t AS (SELECT repo, sha, file_path FROM touched JOIN kept USING (repo, file_path)),
co AS (SELECT a.repo, a.file_path AS src, b.file_path AS dst, count(*) AS count FROM t a JOIN t b ON a.repo = b.repo AND a.sha = b.sha AND a.file_path <> b.file_path GROUP BY ALL HAVING count(*) >= 3)
"""


@query(CO_EDITED + "SELECT * FROM co")
def co_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with at least three common commits, both ways."""
    return history.co_edited(_commits(spark, sf_dir), _kept(spark, sf_dir))


@query(with_parts("commits1") + """, asked AS (SELECT DISTINCT instance_id, base_commit FROM issues WHERE instance_id IS NOT NULL),
b AS (SELECT instance_id, c.repo, c.authored_at AS base_at FROM asked JOIN commits1 c ON c.sha = base_commit WHERE c.authored_at IS NOT NULL)
SELECT instance_id, count(c.sha) AS n_before, max(c.authored_at) AS last_before FROM b LEFT JOIN commits1 c ON c.repo = b.repo AND c.authored_at < base_at GROUP BY instance_id, base_at""")
def commits_before_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many commits precede each issue's base, none of them at or after it."""
    return history.commits_before_base(table(spark, sf_dir, "issues"), _commits(spark, sf_dir))


@query(with_parts("commits1") + """, asked AS (SELECT DISTINCT instance_id, base_commit FROM issues WHERE instance_id IS NOT NULL),
b AS (SELECT instance_id, c.repo, c.authored_at AS base_at FROM asked JOIN commits1 c ON c.sha = base_commit WHERE c.authored_at IS NOT NULL),
w AS (SELECT instance_id, b.repo, c.sha, c.authored_at, row_number() OVER (PARTITION BY instance_id, base_at ORDER BY c.authored_at DESC, c.sha) AS k, count(*) OVER (PARTITION BY instance_id, base_at) AS n, base_at FROM b JOIN commits1 c ON c.repo = b.repo AND c.authored_at < base_at)
SELECT instance_id, repo, greatest(1, n - 6999) AS first_no, n AS last_no, sha AS oldest_sha, authored_at AS oldest_at FROM w WHERE k = least(n, 7000)""")
def commit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest seven thousand commits before each issue's base, by number, and the oldest of them."""
    return history.windows_before_bases(table(spark, sf_dir, "issues"), _commits(spark, sf_dir))


KEYWORDS = with_parts("reports", "funcs") + r""", kw AS (
  SELECT DISTINCT instance_id, repo, lower(unnest(list_concat(regexp_extract_all(text, '\b([A-Z]\w*(?:Error|Exception|Warning|Overflow))\b', 1), regexp_extract_all(text, '`([A-Za-z_][\w.]*)`', 1)))) AS keyword FROM reports),
literal AS (SELECT DISTINCT instance_id, node_id FROM kw JOIN funcs f USING (repo) WHERE keyword <> '' AND contains(lower(coalesce(qualname, '') || ' ' || coalesce(docstring, '')), keyword)),
frames AS (SELECT instance_id, repo, unnest(regexp_extract_all(text, 'File "[^"\n]+", line \d+, in \w+')) AS f FROM reports),
stack AS (SELECT DISTINCT instance_id, node_id FROM (SELECT instance_id, repo, regexp_extract(f, 'File "([^"\n]+)"', 1) AS file_path, regexp_extract(f, 'line (\d+)', 1)::INT AS line, regexp_extract(f, 'in (\w+)$', 1) AS func FROM frames) x
  JOIN funcs USING (repo, file_path) WHERE split_part(qualname, '.', -1) = func AND line BETWEEN start_line AND end_line)
"""


@query(KEYWORDS + "SELECT * FROM literal")
def keyword_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that a report's keywords occur in."""
    return seeding.literal_matches(_reports(spark, sf_dir), _functions(spark, sf_dir))


@query(KEYWORDS + """SELECT * FROM stack UNION ALL
SELECT DISTINCT f.repo || '/' || f.file_path AS instance_id, g.node_id FROM funcs f JOIN funcs g ON g.repo = f.repo AND g.file_path = f.file_path AND split_part(g.qualname, '.', -1) = split_part(f.qualname, '.', -1)
  AND f.end_line BETWEEN g.start_line AND g.end_line WHERE regexp_full_match(f.file_path, '[^"\n]+') AND regexp_full_match(split_part(f.qualname, '.', -1), '[A-Za-z0-9_]+')""")
def stack_frame_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that stack frames point into, of all reports and of a trace through the last lines of each file's functions."""
    known = cut(_functions(spark, sf_dir))
    frame = F.concat(F.lit('File "'), "file_path", F.lit('", line '), F.col("end_line").cast("string"), F.lit(", in "), T.last_part(F.col("qualname")))
    traces = known.groupBy("repo", "file_path").agg(F.array_join(F.sort_array(F.collect_list(frame)), "\n").alias("text")).select(F.concat_ws("/", "repo", "file_path").alias("instance_id"), "repo", "text")
    reports = _reports(spark, sf_dir).select("instance_id", "repo", "symptoms").union(traces.select("instance_id", "repo", T.extracted_symptoms(F.col("text"))))
    return seeding.stack_matches(reports, known)


BUDGET = """, ff AS (SELECT fused.instance_id, r.repo, fused.file_path, fused.rank, count(*) OVER (PARTITION BY fused.instance_id) AS n FROM fused JOIN reports r USING (instance_id)),
stage1 AS (SELECT instance_id, node_id, round((0.35 - 0.20 * rank / greatest(1, n - 1)) * (CASE WHEN regexp_matches(file_path, '(^|/)tests?/|(^|/)tests?\\.py$|(^|/)test_[^/]*\\.py$|_test\\.py$') THEN 0.5 ELSE 1.0 END), 6) AS prior FROM (
  SELECT ff.*, funcs.node_id, row_number() OVER (PARTITION BY instance_id, file_path ORDER BY coalesce(start_line, 0), node_id) AS k FROM ff JOIN funcs USING (repo, file_path)) WHERE k <= greatest(2, ceil(8 * exp(-0.4 * rank))))
"""


@query(with_parts("reports", "funcs", "positions", "rrf", "fused") + BUDGET + "SELECT * FROM stage1")
def per_group_budget_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pre-filtered file the first functions, by its rank's budget, with a decaying prior."""
    return seeding.file_matches(_files_of_issues(spark, sf_dir), _functions(spark, sf_dir))


SEEDS = KEYWORDS + ", " + ",\n".join(SQL[n] for n in ("positions", "rrf", "fused")) + BUDGET + """, every AS (
  SELECT instance_id, node_id, 1.0::DOUBLE AS prior, 0 AS place, 'stack' AS provenance FROM stack UNION ALL SELECT instance_id, node_id, 0.8, 1, 'literal' FROM literal UNION ALL SELECT instance_id, node_id, prior, 4, 'stage1' FROM stage1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, node_id ORDER BY prior DESC, place) AS k FROM every) WHERE k = 1),
seeded AS (SELECT instance_id, node_id, prior, provenance, rank FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY prior DESC, place, node_id)::INT AS rank FROM best) WHERE rank <= 30)
"""


@query(SEEDS + "SELECT * FROM seeded")
def seed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 best seeds of each report."""
    return _seeds(spark, sf_dir)


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, known = cut(_reports(spark, sf_dir)), cut(_functions(spark, sf_dir))
    files = _fused(spark, sf_dir).join(asked.select("instance_id", "repo"), "instance_id")
    return seeding.seeds(stack=seeding.stack_matches(asked, known), literal=seeding.literal_matches(asked, known, seeding.SEED_CAP), files=seeding.file_matches(files, known))


@query(with_parts("reports") + r""", s AS (SELECT instance_id, unnest(list_concat(list_transform(list_distinct(regexp_extract_all(text, '\b([A-Z]\w*(?:Error|Exception|Warning|Overflow))\b', 1)), lambda x: struct_pack(o := 0, kind := 'exception', label := x)),
  list_transform(list_distinct(regexp_extract_all(text, '(?m)^[A-Z]\w*(?:Error|Exception|Warning|Overflow): (.+)$', 1)), lambda x: struct_pack(o := 1, kind := 'error_msg', label := x)),
  list_transform(list_distinct(regexp_extract_all(text, '`([A-Za-z_][\w.]*)`', 1)), lambda x: struct_pack(o := 3, kind := 'api', label := x)))) AS x FROM reports)
SELECT instance_id, 'symptom::' || arg_min(x.kind, x.o) || '::' || x.label AS node_id, x.label AS label, arg_min(x.kind, x.o) AS kind FROM s WHERE x.label <> '' GROUP BY instance_id, x.label""")
def symptom_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What patterns extract from a report, one node a label."""
    return seeding.symptom_nodes(_reports(spark, sf_dir))


@query(with_parts("reports") + r""", c AS (SELECT instance_id, len(list_distinct(regexp_extract_all(text, '\b([A-Z]\w*(?:Error|Exception|Warning|Overflow))\b', 1))) AS n_exceptions,
  len(list_distinct(regexp_extract_all(text, '(?m)^[A-Z]\w*(?:Error|Exception|Warning|Overflow): (.+)$', 1))) AS n_messages, len(regexp_extract_all(text, 'File "[^"\n]+", line \d+, in \w+')) AS n_frames,
  len(list_distinct(regexp_extract_all(text, '`([A-Za-z_][\w.]*)`', 1))) AS n_calls FROM reports)
SELECT instance_id, form, (CASE WHEN form = 'cut' THEN 0 ELSE n_exceptions END)::INT AS n_exceptions, (CASE WHEN form = 'cut' THEN 0 ELSE n_messages END)::INT AS n_messages,
  (CASE WHEN form = 'cut' THEN 0 ELSE n_frames END)::INT AS n_frames, (CASE WHEN form = 'cut' THEN 0 ELSE n_calls END)::INT AS n_calls FROM c, (VALUES ('fenced'), ('bare'), ('cut')) AS f(form)""")
def symptom_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symptoms of replies in JSON about each report, in a fence, bare, and cut short, which gives none."""
    rows = _reports(spark, sf_dir).select("instance_id", F.to_json("symptoms").alias("said"))
    form = lambda name, reply: F.struct(F.lit(name).alias("form"), reply.alias("reply"))
    forms = F.array(form("fenced", F.concat(F.lit("As asked:\n```json\n"), "said", F.lit("\n```\n"))), form("bare", F.col("said")), form("cut", F.expr("left(said, length(said) - 1)")))
    replies_of = rows.select("instance_id", F.explode(forms).alias("f")).select("instance_id", "f.form", T.symptoms_of_reply(F.col("f.reply")).alias("s"))
    sizes = {"n_exceptions": "exception_types", "n_messages": "error_messages", "n_frames": "stack_frames", "n_calls": "api_calls_named"}
    return replies_of.select("instance_id", "form", *[F.size(f"s.{field}").alias(name) for name, field in sizes.items()])


REQUESTS = """requests AS (SELECT instance_id, repo, created_at, sha256('{"messages":[{"content":' || to_json(coalesce(problem_statement, ''))::VARCHAR || ',"role":"user"}],"mode":"non-think","model":"local","response_format":{"type":"object"},"seed":0,"temperature":0.0}') AS key
  FROM issues WHERE instance_id IS NOT NULL AND created_at IS NOT NULL AND repo IS NOT NULL)"""


def _requests(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    rows = table(spark, sf_dir, "issues").filter("instance_id is not null and created_at is not null and repo is not null")
    key = T.request_key(model=F.lit("local"), mode=F.lit("non-think"), messages=prompts.messages(F.coalesce("problem_statement", F.lit(""))), response_format=F.struct(F.lit("object").alias("type")), temperature=F.lit(0.0), seed=F.lit(0))
    return rows.select("instance_id", "repo", "created_at", key.alias("key"), F.coalesce("problem_statement", F.lit("")).alias("prompt")).select("instance_id", "repo", "created_at", "key", *more)


@query(f"WITH {REQUESTS} SELECT DISTINCT instance_id, key FROM requests")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of each report's request; what doesn't change the reply isn't in it."""
    return _requests(spark, sf_dir).select("instance_id", "key").distinct()


@query(r"""SELECT DISTINCT r_name, mode, model, CASE WHEN mode = 'non-think' OR regexp_matches(lower(model), 'deepseek-r1|llama|mixtral|gemma|mistral') THEN '{}' ELSE '{"chat_template_kwargs":{"enable_thinking":true,"thinking":true}}' END AS body
FROM region, (VALUES ('non-think'), ('think-high'), ('think-max')) AS a(mode), (VALUES ('local'), ('DeepSeek-AI/DeepSeek-R1'), ('Meta-Llama-3'), ('qwen3')) AS b(model)""")
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each mode adds to a request, for models that think when asked, always or never."""
    every = lambda *values: F.explode(F.array(*[F.lit(v) for v in values]))
    rows = table(spark, sf_dir, "region").select("r_name", every("non-think", "think-high", "think-max").alias("mode")).select("r_name", "mode", every("local", "DeepSeek-AI/DeepSeek-R1", "Meta-Llama-3", "qwen3").alias("model"))
    return rows.select("r_name", "mode", "model", prompts.extra_body(F.col("model"), F.col("mode")).alias("body"))


@query(f"WITH {REQUESTS}, firsts AS (SELECT key, arg_min(repo, struct_pack(a := created_at, b := repo)) AS repo FROM requests GROUP BY key), n AS (SELECT repo, count(*) AS n FROM requests GROUP BY repo), l AS (SELECT repo, count(*) AS n FROM firsts GROUP BY repo) SELECT n.repo, coalesce(l.n, 0) AS n_live, n.n - coalesce(l.n, 0) AS n_cached FROM n LEFT JOIN l USING (repo)")
def llm_cache_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered live and from the cache."""
    return replies.traffic(_requests(spark, sf_dir), key="key", at="created_at", group="repo")


@query(with_parts("hunks") + "SELECT * FROM hunks")
def gold_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that each patch touches, as before it."""
    return diffs.patch_hunks(table(spark, sf_dir, "issues")).select("instance_id", "file_path", "start_line", "end_line").distinct()


ENCLOSING = with_parts("hunks", "funcs", "reports") + """, inside AS (SELECT h.instance_id, h.file_path, h.start_line AS line, f.node_id, row_number() OVER (PARTITION BY h.instance_id, h.file_path, h.start_line ORDER BY f.start_line DESC, f.end_line, f.node_id DESC) AS k
  FROM (SELECT DISTINCT instance_id, file_path, start_line FROM hunks) h JOIN reports r USING (instance_id) JOIN funcs f ON f.repo = r.repo AND f.file_path = h.file_path AND h.start_line BETWEEN f.start_line AND f.end_line)
"""


@query(ENCLOSING + "SELECT instance_id, file_path, line, node_id FROM inside WHERE k = 1")
def enclosing_deepest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost function around the first line of each hunk."""
    lines = gold_ranges(spark, sf_dir).select("instance_id", "file_path", F.col("start_line").alias("line")).distinct().join(_reports(spark, sf_dir).select("instance_id", "repo"), "instance_id")
    return code_graph.enclosing(lines, _functions(spark, sf_dir), keys=["repo", "file_path"]).select("instance_id", "file_path", "line", "node_id")


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    hunks = cut(diffs.patch_hunks(table(spark, sf_dir, "issues")))
    known = _functions(spark, sf_dir)
    lines = hunks.filter("changed_line is not null").select("instance_id", "file_path", F.col("changed_line").alias("line")).distinct().join(_reports(spark, sf_dir).select("instance_id", "repo"), "instance_id")
    functions = code_graph.enclosing(lines, known, keys=["repo", "file_path"]).join(known.select("repo", "node_id", "qualname"), ["repo", "node_id"]).select("instance_id", F.concat_ws("::", "file_path", "qualname").alias("function_key")).distinct()
    return hunks.select("instance_id", "file_path").distinct(), functions, hunks.select("instance_id", "file_path", "start_line", "end_line").distinct()


@query(with_parts("positions", "rrf", "fused", "hunks") + """, gold AS (SELECT DISTINCT instance_id, file_path FROM hunks),
h AS (SELECT g.instance_id, count(*) AS n_gold, min(f.rank + 1) AS best FROM gold g LEFT JOIN fused f USING (instance_id, file_path) GROUP BY g.instance_id)
SELECT instance_id, n_gold, (coalesce(best, 99) <= 1)::INT::DOUBLE AS acc_1, (coalesce(best, 99) <= 5)::INT::DOUBLE AS acc_5, round(coalesce(1.0 / best, 0), 6) AS mrr FROM h""")
def metrics_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and reciprocal rank of the fused files against the patched ones."""
    gold = gold_ranges(spark, sf_dir).select("instance_id", "file_path").distinct()
    ranked = _fused(spark, sf_dir).withColumn("rank", F.col("rank") + 1)
    h = evaluation.hits(ranked, gold, "file_path")
    return h.select("instance_id", "n_gold", evaluation.accuracy_at(1).alias("acc_1"), evaluation.accuracy_at(5).alias("acc_5"), F.round(evaluation.reciprocal_rank(), 6).alias("mrr"))


def _predicted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _seeds(spark, sf_dir).join(_reports(spark, sf_dir).select("instance_id", "repo"), "instance_id")
    return seeds.join(_functions(spark, sf_dir).select("repo", "node_id", "file_path", "start_line", "end_line"), ["repo", "node_id"]).select("instance_id", "rank", "file_path", "start_line", "end_line")


@query(SEEDS + ", " + SQL["hunks"] + """, p AS (SELECT instance_id, rank, f.file_path, f.start_line AS ps, f.end_line AS pe FROM seeded JOIN reports USING (instance_id) JOIN funcs f USING (repo, node_id) WHERE rank <= 5),
m AS (SELECT h.instance_id, h.file_path, h.start_line, h.end_line, max(CASE WHEN p.pe + 10 >= h.start_line AND p.ps - 10 <= h.end_line THEN 1 ELSE 0 END) AS met FROM hunks h LEFT JOIN p USING (instance_id, file_path) GROUP BY ALL)
SELECT instance_id, round(sum(coalesce(met, 0)) / count(*), 6) AS line_recall FROM m GROUP BY instance_id""")
def line_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patched ranges that the first five seeds' lines meet, give or take ten."""
    found = evaluation.line_recall(_predicted_lines(spark, sf_dir), gold_ranges(spark, sf_dir))
    return found.select("instance_id", F.round("line_recall", 6).alias("line_recall"))


@query(with_parts("positions", "rrf", "fused", "hunks") + """, t AS (SELECT f.instance_id, least(1.0, f.score * 20) AS confidence, (EXISTS (SELECT 1 FROM hunks h WHERE h.instance_id = f.instance_id AND h.file_path = f.file_path))::INT AS correct FROM fused f WHERE rank = 0 AND instance_id IN (SELECT instance_id FROM hunks)),
e AS (SELECT i, i * 0.1::DOUBLE AS lo, CASE WHEN i = 9 THEN 1.0 ELSE (i + 1) * 0.1::DOUBLE END AS hi FROM range(10) r(i)),
b AS (SELECT i, count(*) AS m, avg(confidence) AS conf, avg(correct) AS acc FROM t JOIN e ON confidence >= lo AND confidence < hi GROUP BY i)
SELECT round(sum(m / (SELECT count(*) FROM t) * abs(conf - acc)), 6) AS ece FROM b""")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration of the first file's score."""
    gold = gold_ranges(spark, sf_dir).select("instance_id", "file_path").distinct().withColumn("correct", F.lit(1))
    tops = _fused(spark, sf_dir).filter("rank = 0").join(gold.select("instance_id").distinct(), "instance_id", "left_semi").join(gold, ["instance_id", "file_path"], "left")
    return evaluation.calibration_error(tops.select(F.least(F.lit(1.0), F.col("score") * 20).alias("confidence"), F.coalesce("correct", F.lit(0)).alias("correct")))


@query(with_parts("positions") + """, r AS (SELECT instance_id, retriever, file_path, position, 1.0 / (1 + position) AS s FROM positions WHERE position < 20),
n AS (SELECT instance_id, count(DISTINCT retriever) AS n FROM positions GROUP BY instance_id),
v AS (SELECT instance_id, file_path, round(avg(s) * count(DISTINCT retriever) / any_value(n), 6) AS score, count(DISTINCT retriever) AS appearances, any_value(n) AS n FROM r JOIN n USING (instance_id) GROUP BY instance_id, file_path)
SELECT instance_id, file_path, score, appearances, CASE WHEN appearances >= n THEN 'high' WHEN appearances >= greatest(2, n - 1) THEN 'medium' ELSE 'low' END AS label, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, file_path)::INT AS rank FROM v""")
def consistency_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the lists of an issue, each as one run."""
    positions = retrieval.list_positions(table(spark, sf_dir, "rankings"))
    n = positions.groupBy("instance_id").agg(F.count_distinct("retriever").alias("n"))
    runs = positions.join(n, "instance_id").select("instance_id", F.col("retriever").alias("run"), F.col("position").alias("rank"), "file_path", (1.0 / (1 + F.col("position"))).alias("score"), "n")
    return consensus.vote(runs, F.col("n"), key="file_path")


@query(with_parts("positions", "rrf", "fused") + """, l AS (SELECT instance_id, file_path, min(position) AS position, 1.0 / (1 + min(position)) AS confidence FROM positions WHERE retriever = 'llm' GROUP BY instance_id, file_path),
j AS (SELECT f.*, l.position, l.confidence, (f.rank < 10 AND l.position IS NOT NULL) AS matched FROM fused f LEFT JOIN l USING (instance_id, file_path))
SELECT instance_id, file_path, round(CASE WHEN matched THEN confidence ELSE score END, 6) AS score, (row_number() OVER (PARTITION BY instance_id ORDER BY CASE WHEN matched THEN 0 WHEN rank < 10 THEN 1 ELSE 2 END, CASE WHEN matched THEN position ELSE rank END, file_path) - 1)::INT AS rank FROM j""")
def listwise_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten files in the model's order, the rest as they were."""
    model = retrieval.list_positions(table(spark, sf_dir, "rankings")).filter("retriever = 'llm'").withColumn("confidence", 1.0 / (1 + F.col("position")))
    merged = consensus.merged_head(_fused(spark, sf_dir), model, key="file_path")
    return merged.withColumn("score", F.round("score", 6))


@query(with_parts("files") + """, p AS (SELECT DISTINCT repo, array_to_string(list_slice(string_split(file_path, '/'), 1, i), '/') AS dir FROM (SELECT repo, file_path, unnest(range(1, len(string_split(file_path, '/')))) AS i FROM files)) SELECT * FROM p""")
def contain_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All directories above any file."""
    return table(spark, sf_dir, "source_files").filter("repo is not null and content is not null").select("repo", F.explode(T.ancestor_dirs(F.col("file_path"))).alias("dir")).distinct()


@query(with_parts("funcs") + "SELECT repo, name, min(node_id) AS node_id FROM funcs WHERE repo IS NOT NULL AND name IS NOT NULL GROUP BY repo, name HAVING count(DISTINCT node_id) = 1")
def unambiguous_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that resolve to one function of a repository."""
    return code_graph.unambiguous(_functions(spark, sf_dir).filter("repo is not null and name is not null"))


@query(r"""WITH c AS (SELECT *, lag(name) OVER (PARTITION BY repo, file_path ORDER BY start_line, node_id) AS before FROM (SELECT node_id, repo, file_path, name, start_line, code, row_number() OVER (PARTITION BY repo, node_id ORDER BY ingested_at DESC) AS k FROM nodes WHERE node_type = 'class' AND repo IS NOT NULL AND node_id IS NOT NULL) WHERE k = 1),
b AS (SELECT DISTINCT repo, node_id AS src, split_part(trim(b), '.', -1) AS name FROM (SELECT repo, node_id, unnest(string_split(regexp_extract(code, '^\s*class\s+\w+\s*\(([^)]*)\)', 1), ',')) AS b FROM c UNION ALL SELECT repo, node_id, 'own.' || before FROM c WHERE before IS NOT NULL))
SELECT DISTINCT b.repo, src, c.node_id AS dst FROM b JOIN c ON c.repo = b.repo AND c.name = b.name WHERE b.name <> '' AND src <> c.node_id""")
def inherit_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes joined to those with the short name of a base: of their own bases, and as if each also extended the class declared before it."""
    rows = table(spark, sf_dir, "nodes").filter("node_type = 'class' and repo is not null and node_id is not null").groupBy("repo", "node_id").agg(F.max_by(F.struct("file_path", "name", "code", "start_line"), "ingested_at").alias("c"))
    before = F.concat(F.lit("own."), F.lag("c.name").over(Window.partitionBy("repo", "c.file_path").orderBy("c.start_line", "node_id")))
    bases = F.split(F.regexp_extract(F.coalesce("c.code", F.lit("")), r"^\s*class\s+\w+\s*\(([^)]*)\)", 1), ",")
    return code_graph.inherit_edges(rows.select("repo", "node_id", "c.name", F.array_compact(F.concat(bases, F.array(before))).alias("bases")))


@query("""SELECT user_id, event_id, def_id FROM (SELECT user_id, event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_id FROM events) WHERE event_type = 'purchase' AND def_id IS NOT NULL""")
def asof_def_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last view before it, as uses follow definitions."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("ix"), F.when(F.col("event_type") == "view", F.array(F.lit("v"))).otherwise(F.array().cast("array<string>")).alias("defs"), F.when(F.col("event_type") == "purchase", F.array(F.lit("v"))).otherwise(F.array().cast("array<string>")).alias("uses"), F.col("event_id").alias("line"))
    links = code_graph.def_use(events, keys=["user_id"])
    return links.select("user_id", F.col("use_line").alias("event_id"), F.col("def_line").alias("def_id"))


CENTROIDS = """WITH cells AS (SELECT label, i, avg((embedding::DOUBLE[])[i]) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
means AS (SELECT label, list(m ORDER BY i) AS c FROM cells GROUP BY label),
centroids AS (SELECT label::BIGINT AS cluster, list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-9)) AS centroid FROM means)
"""


@query(CENTROIDS + "SELECT cluster, i::INT AS pos, round(centroid[i + 1], 6) AS x FROM centroids, range(64) r(i)")
def kmeans_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit means of the vectors of each label, one row a value."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("cluster"), "embedding")
    return vectors.unit_mean(e, group="cluster", vector="embedding").select("cluster", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(CENTROIDS + "SELECT vec_id, arg_max(cluster, struct_pack(s := s, k := -cluster)) AS cluster, round(max(s), 6) AS similarity FROM (SELECT vec_id, cluster, round(list_dot_product(embedding::DOUBLE[], centroid), 12) AS s FROM embeddings, centroids) GROUP BY vec_id")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the labels' centroids."""
    e = table(spark, sf_dir, "embeddings")
    centroids = vectors.unit_mean(e.select(F.col("label").cast("bigint").alias("cluster"), "embedding"), group="cluster", vector="embedding")
    return grouping.assign(e, centroids, key="vec_id", vector="embedding", dimensions=64)


@query()
def kmeans_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spherical k-means of all vectors; which groups come out depends on the start, so only the rule can be checked."""
    assigned, _ = grouping.kmeans(table(spark, sf_dir, "embeddings"), key="vec_id", vector="embedding", dimensions=64)
    return assigned


@query(CO_EDITED + """, starts AS (SELECT repo || '/' || file_path AS start FROM kept),
e AS (SELECT repo || '/' || src AS src, repo || '/' || dst AS dst FROM co),
one AS (SELECT start, dst AS node FROM starts JOIN e ON src = start), two AS (SELECT start, dst AS node FROM one JOIN e ON src = node),
every AS (SELECT start, start AS node, 0 AS distance FROM starts UNION ALL SELECT start, node, 1 FROM one UNION ALL SELECT start, node, 2 FROM two)
SELECT start, node, min(distance) AS distance FROM every GROUP BY start, node""")
def frontier_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files within two steps of common edits from each kept file."""
    kept = cut(_kept(spark, sf_dir))
    edges = history.co_edited(_commits(spark, sf_dir), kept).select(F.concat_ws("/", "repo", "src").alias("src"), F.concat_ws("/", "repo", "dst").alias("dst"))
    return code_graph.reached(edges, kept.select(F.concat_ws("/", "repo", "file_path").alias("start")), 2)


@query(with_parts("reports", "hunks", "positions", "rrf", "fused") + """, gold AS (SELECT DISTINCT instance_id, file_path FROM hunks),
missed AS (SELECT instance_id, file_path FROM fused f WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.instance_id = f.instance_id AND g.file_path = f.file_path) QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY rank) = 1)
SELECT instance_id, text AS anchor, file_path AS text, 1 AS label FROM reports JOIN gold USING (instance_id)
UNION ALL SELECT g.instance_id, r.text, m.file_path, 0 FROM gold g JOIN reports r USING (instance_id) JOIN missed m ON m.instance_id = g.instance_id""")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with each file that was patched for them and the first ranked one that wasn't."""
    gold = gold_ranges(spark, sf_dir).select("instance_id", "file_path").distinct()
    missed = _fused(spark, sf_dir).join(gold, ["instance_id", "file_path"], "left_anti").groupBy("instance_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "file_path"))), lambda f: f["file_path"]).alias("negatives"))
    pairs = _reports(spark, sf_dir).join(gold, "instance_id").join(missed, "instance_id", "left").select(F.struct("instance_id", "text").alias("anchor"), F.col("file_path").alias("positive"), "negatives")
    return prompts.training_rows(pairs).select("anchor.instance_id", F.col("anchor.text").alias("anchor"), "text", "label")


@query(with_parts("funcs") + r"""SELECT DISTINCT repo, node_id, 'file::' || file_path AS file FROM funcs WHERE file_path IS NOT NULL AND qualname IS NOT NULL""")
def contain_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of each function, up one containment or, through a class, two."""
    nodes = table(spark, sf_dir, "nodes").filter("node_id is not null and repo is not null")
    return code_graph.file_of(_functions(spark, sf_dir), cut(code_graph.contain_edges_of(nodes)))


@query()
def skeleton_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skeleton of every source file."""
    return skeletons.skeletons(table(spark, sf_dir, "source_files"))


@query()
def skeleton_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeletons as compact text."""
    return skeletons.outline_text(skeleton_rows(spark, sf_dir))


@query()
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: nodes of the code graph."""
    return code_graph.graph_nodes(cut(skeleton_rows(spark, sf_dir)))


@query()
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contain, import, inherit and invoke edges."""
    return code_graph.structural_edges(cut(skeleton_rows(spark, sf_dir)))


@query(with_parts("funcs") + """, m AS (SELECT DISTINCT repo, label, unnest(member_function_ids) AS m FROM concepts WHERE label IS NOT NULL AND label <> '')
SELECT DISTINCT m.repo, 'func::' || m AS src, 'concept::' || label AS dst FROM m JOIN funcs ON funcs.repo = m.repo AND funcs.node_id = 'func::' || m WHERE contains(m, '::')""")
def concept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From functions to the concepts that have them as members."""
    return code_graph.concept_graph(table(spark, sf_dir, "concepts"), _functions(spark, sf_dir))[1]


@query("""SELECT repo, 'commit::' || sha AS node_id, left(sha, 12) AS name, left(coalesce(message, ''), 500) AS message, authored_at FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY ingested_at DESC) AS k FROM commits WHERE sha IS NOT NULL) WHERE k = 1""")
def commit_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for every commit."""
    return code_graph.commit_nodes(_commits(spark, sf_dir))


@query(with_parts("files", "funcs") + r"""SELECT node_id, array_to_string(list_slice(regexp_split_to_array(content, '\r\n|\r|\n'), start_line, end_line), chr(10)) AS code FROM funcs JOIN files USING (repo, file_path) WHERE start_line >= 1""")
def function_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source lines of each function, from its file."""
    joined = _functions(spark, sf_dir).filter("start_line >= 1").join(_files(spark, sf_dir), ["repo", "file_path"])
    return joined.select("node_id", T.source_slice(F.col("content"), F.col("start_line"), F.col("end_line")).alias("code"))


@query()
def statement_def_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Def-use links inside each function."""
    rows = skeleton_rows(spark, sf_dir).select("repo", "file_path", F.posexplode("statements").alias("ix", "s"))
    return code_graph.def_use(rows.select("repo", "file_path", F.col("s.function").alias("function"), "ix", "s.line", "s.defs", "s.uses"), keys=["repo", "file_path", "function"])


def _index(spark: SparkSession, sf_dir: str) -> plan.Index:
    skeleton = cut(skeleton_rows(spark, sf_dir))
    edges = cut(code_graph.structural_edges(skeleton).select("repo", "src", "dst", "edge_type").filter("edge_type in ('invoke', 'inherit')"))
    statements = skeleton.select("repo", "file_path", F.explode("statements").alias("s")).select("repo", T.node_id("func", F.col("file_path"), F.col("s.function")).alias("node_id"), "s.line", "s.text")
    sizes = retrieval.outline_sizes(skeletons.outline_text(skeleton), scope="repo", text="outline")
    return plan.Index(table(spark, sf_dir, "nodes"), edges, table(spark, sf_dir, "concepts"), statements, sizes)


@query()
def localized_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and lines that each report points to, by searches, their pools reranked, and a vote."""
    return plan.localize(table(spark, sf_dir, "issues"), table(spark, sf_dir, "rankings"), _index(spark, sf_dir))


def located(spark: SparkSession, sf_dir: str, instance_id: str, limits: traversal.Limits | None = None, top: int = 10) -> dict:
    """What one report points to: why its last search ended, how many steps it took, and its first functions with score, label, runs, lines and chain."""
    issues = table(spark, sf_dir, "issues").filter(F.col("instance_id") == instance_id)
    rankings = table(spark, sf_dir, "rankings").filter(F.col("instance_id") == instance_id)
    searches: dict = {}
    found = plan.localize(issues, rankings, _index(spark, sf_dir), limits=limits or traversal.Limits(), details=searches)
    last = searches["searches"].orderBy(F.desc("run")).select("ended", "iterations").first()
    ranked = [
        {"function_key": r.function_key, "score": r.score, "confidence": r.label, "runs_appearing": r.appearances, "lines": [r.start_line, r.end_line], "chain": r.chain or []}
        for r in found.orderBy("rank").limit(top).collect()
    ]
    return {"instance_id": instance_id, "termination": last.ended if last else "queue_empty", "iterations": last.iterations if last else 0, "ranked": ranked}


@query()
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of metrics of the localized functions and fused files; an instance without a result counts as an empty one."""
    gold_files, gold_functions, gold_lines = _gold(spark, sf_dir)
    found = cut(localized_functions(spark, sf_dir))
    files = _fused(spark, sf_dir).withColumn("rank", F.col("rank") + 1)
    lines = found.select("instance_id", "rank", F.substring_index("function_key", "::", 1).alias("file_path"), "start_line", "end_line")
    return evaluation.report(files, gold_files, found.select("instance_id", "function_key", "rank", "score"), gold_functions, lines, gold_lines, asked=_reports(spark, sf_dir))


@query(SEEDS + ", " + SQL["hunks"] + """, gold AS (SELECT DISTINCT instance_id, file_path FROM hunks),
hf AS (SELECT g.instance_id, min(f.rank + 1) AS best FROM gold g LEFT JOIN fused f USING (instance_id, file_path) GROUP BY g.instance_id),
inside AS (SELECT h.instance_id, f.file_path || '::' || f.qualname AS key, row_number() OVER (PARTITION BY h.instance_id, h.file_path, h.start_line ORDER BY f.start_line DESC, f.end_line, f.node_id DESC) AS k
  FROM (SELECT DISTINCT instance_id, file_path, start_line FROM hunks) h JOIN reports r USING (instance_id) JOIN funcs f ON f.repo = r.repo AND f.file_path = h.file_path AND h.start_line BETWEEN f.start_line AND f.end_line),
gk AS (SELECT DISTINCT instance_id, key FROM inside WHERE k = 1),
sk AS (SELECT instance_id, rank, prior, f.file_path, f.start_line, f.end_line, f.file_path || '::' || f.qualname AS key FROM seeded JOIN reports USING (instance_id) JOIN funcs f USING (repo, node_id)),
hg AS (SELECT instance_id, key, min(rank) AS rank FROM gk LEFT JOIN sk USING (instance_id, key) GROUP BY instance_id, key),
pg AS (SELECT instance_id, count(*) AS n, min(rank) AS best, count(*) FILTER (WHERE rank <= 1) AS r1, count(*) FILTER (WHERE rank <= 3) AS r3, count(*) FILTER (WHERE rank <= 5) AS r5 FROM hg GROUP BY instance_id),
m AS (SELECT h.instance_id, h.file_path, h.start_line, h.end_line, max(CASE WHEN p.end_line + 10 >= h.start_line AND p.start_line - 10 <= h.end_line THEN 1 ELSE 0 END) AS met FROM hunks h LEFT JOIN (SELECT * FROM sk WHERE rank <= 5) p USING (instance_id, file_path) GROUP BY ALL),
pl AS (SELECT instance_id, sum(coalesce(met, 0)) / count(*) AS line_recall FROM m GROUP BY instance_id),
t AS (SELECT sk.instance_id, prior AS confidence, (EXISTS (SELECT 1 FROM gk WHERE gk.instance_id = sk.instance_id AND gk.key = sk.key))::INT AS correct FROM sk WHERE rank = 1 AND instance_id IN (SELECT instance_id FROM gk)),
e AS (SELECT i, i * 0.1::DOUBLE AS lo, CASE WHEN i = 9 THEN 1.0 ELSE (i + 1) * 0.1::DOUBLE END AS hi FROM range(10) r(i)),
b AS (SELECT i, count(*) AS m, avg(confidence) AS conf, avg(correct) AS acc FROM t JOIN e ON confidence >= lo AND confidence < hi GROUP BY i)
SELECT round((SELECT avg((coalesce(best, 99) <= 1)::INT) FROM hf), 6) AS file_acc_1, round((SELECT avg((coalesce(best, 99) <= 3)::INT) FROM hf), 6) AS file_acc_3, round((SELECT avg((coalesce(best, 99) <= 5)::INT) FROM hf), 6) AS file_acc_5,
  round(avg(r1 / n), 6) AS func_recall_1, round(avg(r3 / n), 6) AS func_recall_3, round(avg(r5 / n), 6) AS func_recall_5, round(avg((coalesce(best, 99) <= 1)::INT), 6) AS func_acc_1, round(avg((coalesce(best, 99) <= 5)::INT), 6) AS func_acc_5,
  round(avg(coalesce(1.0 / best, 0)), 6) AS mrr, count(*) AS n_with_gold_function, round((SELECT avg(line_recall) FROM pl), 6) AS line_recall_5,
  (SELECT round(sum(m / (SELECT count(*) FROM t) * abs(conf - acc)), 6) FROM b) AS ece, (SELECT count(*) FROM reports) AS n_predictions FROM pg""")
def report_of_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's row for the seeds as functions, against the functions around the first lines of hunks."""
    known, asked = cut(_functions(spark, sf_dir)), cut(_reports(spark, sf_dir).select("instance_id", "repo"))
    keys = known.select("repo", "node_id", F.concat_ws("::", "file_path", "qualname").alias("function_key"), "file_path", "start_line", "end_line")
    gold = cut(gold_ranges(spark, sf_dir))
    gold_functions = enclosing_deepest(spark, sf_dir).join(asked, "instance_id").join(keys.select("repo", "node_id", "function_key"), ["repo", "node_id"]).select("instance_id", "function_key").distinct()
    seeds = cut(_seeds(spark, sf_dir).join(asked, "instance_id").join(keys, ["repo", "node_id"]).withColumnRenamed("prior", "score"))
    return evaluation.report(_fused(spark, sf_dir).withColumn("rank", F.col("rank") + 1), gold.select("instance_id", "file_path").distinct(), seeds, cut(gold_functions), seeds, gold, asked=asked)


@query(SEEDS + """, keyed AS (SELECT instance_id, file_path || '::' || qualname AS key FROM seeded JOIN reports USING (instance_id) JOIN funcs USING (repo, node_id) WHERE rank = 1),
n AS (SELECT instance_id, count(*) AS n_files FROM fused GROUP BY instance_id)
SELECT instance_id, key AS top1_func, coalesce(n_files, 0)::BIGINT AS n_files FROM reports LEFT JOIN keyed USING (instance_id) LEFT JOIN n USING (instance_id)""")
def per_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: a row for each report, also one without a result: the best seed as its first function, and how many files it was given."""
    asked = _reports(spark, sf_dir)
    seeds = _seeds(spark, sf_dir).join(asked.select("instance_id", "repo"), "instance_id").join(_functions(spark, sf_dir).select("repo", "node_id", F.concat_ws("::", "file_path", "qualname").alias("function_key")), ["repo", "node_id"])
    return evaluation.per_instance(asked, seeds, _fused(spark, sf_dir))


@query(with_parts("funcs") + f""", w AS (SELECT *, list_slice({CODE_TOKENS_SQL.replace("$", "coalesce(name, '')")}, 2, 21) AS l FROM funcs WHERE repo IS NOT NULL),
d AS (SELECT *, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS words FROM w)
SELECT repo, node_id, CASE WHEN coalesce(docstring, '') <> '' THEN split_part(docstring, chr(10), 1) WHEN words <> '' THEN words ELSE name END AS summary FROM d""")
def function_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line about each function, from its docstring or the words of its name."""
    known = _functions(spark, sf_dir).filter("repo is not null").withColumn("node_id", F.struct("repo", "node_id"))
    return providers.summaries(known).select("node_id.*", "summary")


@query(with_parts("funcs") + r""", m AS (SELECT DISTINCT c.repo, c.label AS cluster, f.node_id, f.docstring FROM (SELECT DISTINCT repo, label, unnest(member_function_ids) AS m FROM concepts WHERE label IS NOT NULL AND label <> '') c JOIN funcs f ON f.repo = c.repo AND f.node_id = 'func::' || c.m),
k AS (SELECT *, row_number() OVER (PARTITION BY repo, cluster ORDER BY node_id, docstring) AS k FROM m),
w AS (SELECT repo, cluster, w, count(*) AS n FROM (SELECT repo, cluster, unnest(list_transform(regexp_extract_all(coalesce(docstring, ''), '[A-Za-z_][A-Za-z0-9_]+'), lambda x: lower(x))) AS w FROM k WHERE k <= 8) GROUP BY ALL),
b AS (SELECT repo, cluster, string_agg(w, ' ' ORDER BY r) AS label FROM (SELECT *, row_number() OVER (PARTITION BY repo, cluster ORDER BY n DESC, w) AS r FROM w) WHERE r <= 3 GROUP BY repo, cluster)
SELECT c.repo, c.cluster, left(coalesce(label, ''), 60) AS words FROM (SELECT DISTINCT repo, cluster FROM k) c LEFT JOIN b USING (repo, cluster)""")
def concept_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for each concept, the most frequent words of its first members' docstrings."""
    known = _functions(spark, sf_dir)
    edges = code_graph.concept_graph(table(spark, sf_dir, "concepts"), known)[1]
    members = edges.join(known.select("repo", F.col("node_id").alias("src"), "docstring"), ["repo", "src"])
    named = members.select(F.struct("repo", F.substring("dst", len("concept::") + 1, 10_000).alias("cluster")).alias("cluster"), F.col("src").alias("node_id"), F.col("docstring").alias("summary"))
    return providers.labels(named).select("cluster.*", F.col("label").alias("words"))


@query(with_parts("files", "reports") + """, f AS (SELECT DISTINCT repo, file_path, lower(unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]+'))) AS t FROM files),
q AS (SELECT DISTINCT instance_id, repo, lower(unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]+'))) AS t FROM reports)
SELECT instance_id, file_path, position FROM (SELECT instance_id, file_path, (row_number() OVER (PARTITION BY instance_id ORDER BY count(*) DESC, file_path) - 1)::INT AS position FROM q JOIN f USING (repo, t) GROUP BY instance_id, file_path) WHERE position < 10""")
def overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten files that share most identifiers with each report, the order used without a model."""
    return providers.ranked_by_overlap(_reports(spark, sf_dir), _files(spark, sf_dir).withColumnRenamed("content", "outline"))


@query(SEEDS + """, c AS (SELECT instance_id, node_id FROM seeded WHERE rank <= 5),
extra AS (SELECT instance_id, node_id FROM (SELECT f.instance_id, n.node_id, row_number() OVER (PARTITION BY f.instance_id, f.file_path ORDER BY coalesce(n.start_line, 0), n.node_id) AS k FROM fused f JOIN reports r USING (instance_id) JOIN funcs n ON n.repo = r.repo AND n.file_path = f.file_path
  WHERE f.rank < 3 AND NOT EXISTS (SELECT 1 FROM c WHERE c.instance_id = f.instance_id AND c.node_id = n.node_id)) WHERE k <= 3)
SELECT * FROM c UNION SELECT * FROM extra""")
def extended_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best seeds and of each report's first three files the first three functions that aren't among them."""
    candidates = cut(_seeds(spark, sf_dir).filter("rank <= 5").select("instance_id", "node_id"))
    return consensus.extended_pool(candidates, _files_of_issues(spark, sf_dir), _functions(spark, sf_dir))


@query(SEEDS + ", " + SQL["hunks"] + """, inside AS (SELECT h.instance_id, f.node_id, h.start_line AS line, row_number() OVER (PARTITION BY h.instance_id, h.file_path, h.start_line ORDER BY f.start_line DESC, f.end_line, f.node_id DESC) AS k
  FROM (SELECT DISTINCT instance_id, file_path, start_line FROM hunks) h JOIN reports r USING (instance_id) JOIN funcs f ON f.repo = r.repo AND f.file_path = h.file_path AND h.start_line BETWEEN f.start_line AND f.end_line),
drilled AS (SELECT instance_id, node_id, min(line) AS a, max(line) AS b FROM inside WHERE k = 1 GROUP BY ALL)
SELECT instance_id, node_id, coalesce(a, start_line) AS start_line, coalesce(b, end_line) AS end_line FROM seeded JOIN reports USING (instance_id) JOIN funcs USING (repo, node_id) LEFT JOIN drilled USING (instance_id, node_id)""")
def suspect_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines to look at in each seed: those that its report's patch touches, as if drilled into, else all of it."""
    seeds = _seeds(spark, sf_dir).join(_reports(spark, sf_dir).select("instance_id", "repo"), "instance_id")
    spans = seeds.join(_functions(spark, sf_dir).select("repo", "node_id", "start_line", "end_line"), ["repo", "node_id"])
    return consensus.suspect_lines(spans, enclosing_deepest(spark, sf_dir))


ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query(with_parts("reports") + r""", p AS (SELECT instance_id, regexp_extract_all(text, '\b([A-Z]\w*(?:Error|Exception|Warning|Overflow))\b', 1) AS e, regexp_extract_all(text, '(?m)^[A-Z]\w*(?:Error|Exception|Warning|Overflow): (.+)$', 1) AS m,
  list_transform(regexp_extract_all(text, 'File "[^"\n]+", line \d+, in \w+'), lambda f: regexp_replace(f, 'File "([^"\n]+)", line (\d+), in (\w+)', '\1:\2 in \3')) AS s, regexp_extract_all(text, '`([A-Za-z_][\w.]*)`', 1) AS a FROM reports)
""" + f"SELECT instance_id, concat_ws(chr(10), CASE WHEN len(e) > 0 THEN 'Exceptions: ' || array_to_string({ONCE.format('e')}, ', ') END, CASE WHEN len(m) > 0 THEN 'Errors: ' || array_to_string(list_slice({ONCE.format('m')}, 1, 5), ' | ') END, CASE WHEN len(s) > 0 THEN 'Stack: ' || array_to_string(s, '; ') END, CASE WHEN len(a) > 0 THEN 'APIs: ' || array_to_string({ONCE.format('a')}, ', ') END) AS said FROM p")
def symptom_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symptoms of each report as labelled lines."""
    return _reports(spark, sf_dir).select("instance_id", T.symptom_text(F.col("symptoms")).alias("said"))


@query(with_parts("reports") + "SELECT instance_id, run, CASE WHEN run = 1 THEN text || chr(10) || chr(10) || '[seed=2]' ELSE text END AS text FROM reports, (VALUES (0), (1), (2)) AS r(run)")
def run_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report as three runs see it."""
    variants = plan.distinct_variants(_reports(spark, sf_dir), 3)
    return variants.select("instance_id", F.explode("runs").alias("run"), "text")


@query(with_parts("positions") + """, p AS (SELECT instance_id, file_path, min(position + 1) AS r FROM positions WHERE position < 50 GROUP BY instance_id, file_path)
SELECT instance_id, file_path, row_number() OVER (PARTITION BY instance_id ORDER BY r, file_path)::INT AS rank FROM p""")
def predictions_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all lists of an issue by their first place, each once."""
    return evaluation.ranked_once(retrieval.list_positions(table(spark, sf_dir, "rankings")).withColumn("rank", F.col("position") + 1), "file_path")


@query(with_parts("reports") + """SELECT instance_id, 'List what the report says went wrong. Answer with JSON with the keys exception_types, error_messages, stack_frames (file, func, line), behaviors, api_calls_named.' || chr(10) || chr(10) || 'Report:' || chr(10) || left(text, 6000) AS content, 'user' AS role FROM reports""")
def symptom_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message that asks a model for the symptoms of each report."""
    said = _reports(spark, sf_dir).select("instance_id", F.explode(prompts.messages(prompts.symptom_prompt(F.col("text")))).alias("m"))
    return said.select("instance_id", "m.content", "m.role")


@query(SEEDS + """, s AS (SELECT instance_id, node_id, rank, prior, round(least(1.0, length(coalesce(docstring, '')) / 100.0), 6)::DOUBLE AS sem FROM seeded JOIN reports USING (instance_id) JOIN funcs USING (repo, node_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY sem + 0.6::DOUBLE * prior + 0.2::DOUBLE DESC, rank) AS i FROM s),
t AS (SELECT a.instance_id, a.i, list_slice(list(b.node_id ORDER BY b.sem DESC, b.i), 1, 3) AS top FROM o a JOIN o b ON b.instance_id = a.instance_id AND b.i <= a.i GROUP BY a.instance_id, a.i),
e AS (SELECT instance_id, i, top = lag(top) OVER w AND top = lag(top, 2) OVER w AND top = lag(top, 3) OVER w AS still FROM t WINDOW w AS (PARTITION BY instance_id ORDER BY i)),
stop AS (SELECT instance_id, min(i) AS stop FROM e WHERE still AND i >= 6 GROUP BY instance_id)
SELECT instance_id, node_id, sem AS score, r AS rank FROM (SELECT o.*, row_number() OVER (PARTITION BY o.instance_id ORDER BY sem DESC, i)::INT AS r FROM o LEFT JOIN stop USING (instance_id) WHERE i <= coalesce(stop, 30)) WHERE r <= 15""")
def search_of_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-first searches of the seeds alone, by priority until the best three stay the same, scored by the length of docstrings."""
    asked = _reports(spark, sf_dir).select("instance_id", "repo")
    seeds = cut(_seeds(spark, sf_dir).join(asked, "instance_id").withColumn("run", F.lit(0)))
    sem = F.round(F.least(F.lit(1.0), F.length(F.coalesce("docstring", F.lit(""))) / 100.0), 6)
    scores = seeds.select("instance_id", "repo", "node_id").join(_functions(spark, sf_dir).select("repo", "node_id", sem.alias("sem")), ["repo", "node_id"])
    edges = spark.createDataFrame([], "repo string, src string, dst string, edge_type string")
    return traversal.traversed(seeds, edges, cut(scores), reasoner=traversal.silent_reasoner).select("instance_id", "node_id", "score", "rank")


OUTLINED = with_parts("files") + r""", fn AS (SELECT repo, file_path, qualname, split_part(qualname, '.', -1) AS name, CASE WHEN contains(qualname, '.') THEN regexp_replace(qualname, '[.][^.]*$', '') END AS owner, start_line, coalesce(docstring, '') AS docstring, code
  FROM (SELECT *, row_number() OVER (PARTITION BY repo, node_id ORDER BY ingested_at DESC) AS k FROM nodes WHERE node_type = 'function' AND node_id IS NOT NULL) JOIN (SELECT repo, file_path FROM files) USING (repo, file_path) WHERE k = 1 AND qualname IS NOT NULL),
up AS (SELECT DISTINCT repo, file_path, i, len(p) AS n, array_to_string(list_slice(p, 1, i), '/') AS d FROM (SELECT repo, file_path, p, unnest(range(1, len(p))) AS i FROM (SELECT repo, file_path, string_split(file_path, '/') AS p FROM files)))
"""


def _outlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeletons made of the table of nodes instead of the parser: what precedes a function's name is its class, calls and imports are found by patterns, and each file also imports the one before it."""
    before = F.lag("file_path").over(Window.partitionBy("repo").orderBy("file_path"))
    one = F.concat(F.lit("from "), F.translate(F.regexp_replace(before, "[.]py$", ""), "/", "."), F.lit(" import x"))
    own_imports = F.regexp_extract_all("content", F.lit(r"(?:^|[\r\n])((?:from|import) [^\r\n]*)"), F.lit(1))
    files = _files(spark, sf_dir).select("repo", "file_path", F.array_compact(F.concat(own_imports, F.array(one))).alias("imports"), F.lit(0).alias("n_lines"))
    known = plan.functions(table(spark, sf_dir, "nodes"), code=True).filter("qualname is not null")
    parts = known.select("repo", "file_path", "qualname", F.when(F.col("qualname").contains("."), F.regexp_replace("qualname", "[.][^.]*$", "")).alias("owner"), "start_line", "docstring", "code")
    own = F.struct(T.last_part(F.col("qualname")).alias("name"), "qualname", "start_line", F.lit(0).alias("end_line"), F.coalesce("docstring", F.lit("")).alias("docstring"), F.lit("()").alias("signature"))
    called = F.transform(F.regexp_extract_all(F.coalesce("code", F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1)), lambda c: F.struct(F.col("qualname").alias("caller"), c.alias("callee"), F.col("start_line").alias("line")))
    owners = parts.groupBy("repo", "file_path", "owner").agg(F.sort_array(F.collect_list(own)).alias("f"), F.flatten(F.collect_list(called)).alias("c"))
    classes = F.struct(F.col("owner").alias("name"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.array().cast("array<string>").alias("bases"), F.lit("").alias("docstring"), F.col("f").alias("methods"))
    whole = owners.groupBy("repo", "file_path").agg(F.sort_array(F.collect_list(F.when(F.col("owner").isNotNull(), classes))).alias("classes"), F.flatten(F.collect_list(F.when(F.col("owner").isNull(), F.col("f")))).alias("functions"), F.flatten(F.collect_list("c")).alias("calls"))
    return files.join(whole, ["repo", "file_path"], "left")


@query(OUTLINED + """SELECT DISTINCT repo, 'dir::' || d AS node_id, 'directory' AS node_type, split_part(d, '/', -1) AS name, d AS file_path FROM up
UNION ALL SELECT repo, 'file::' || file_path, 'file', split_part(file_path, '/', -1), file_path FROM files
UNION ALL SELECT DISTINCT repo, 'class::' || file_path || '::' || owner, 'class', owner, file_path FROM fn WHERE owner IS NOT NULL
UNION ALL SELECT DISTINCT repo, 'func::' || file_path || '::' || qualname, 'function', name, file_path FROM fn""")
def outlined_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the code graph, as made of skeletons."""
    return code_graph.graph_nodes(cut(_outlined(spark, sf_dir))).select("repo", "node_id", "node_type", "name", "file_path")


@query(OUTLINED + r""", st AS (SELECT repo, file_path, unnest(regexp_extract_all(content, '(?:^|[\r\n])((?:from|import) [^\r\n]*)', 1)) AS s FROM files UNION ALL SELECT repo, file_path, 'from ' || replace(regexp_replace(lag(file_path) OVER (PARTITION BY repo ORDER BY file_path), '[.]py$', ''), '/', '.') || ' import x' FROM files),
im AS (SELECT DISTINCT repo, file_path, replace(coalesce(nullif(regexp_extract(s, '^\s*from\s+\.*([\w.]*)\s*import\b', 1), ''), nullif(regexp_extract(s, '^\s*import\s+([\w.]+)', 1), '')), '.', '/') || '.py' AS target FROM st),
ca AS (SELECT DISTINCT repo, file_path, 'func::' || file_path || '::' || qualname AS src, start_line AS line, unnest(regexp_extract_all(coalesce(code, ''), '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS name FROM fn),
ids AS (SELECT repo, file_path, name, qualname, owner, 'func::' || file_path || '::' || qualname AS node_id FROM fn),
here AS (SELECT repo, file_path, name, arg_min(node_id, qualname) AS here FROM ids GROUP BY ALL),
single AS (SELECT repo, name, min(node_id) AS there FROM ids GROUP BY repo, name HAVING count(DISTINCT node_id) = 1 AND max(owner) IS NULL),
called AS (SELECT repo, src, coalesce(here, there) AS dst, max(line) AS line FROM ca LEFT JOIN here USING (repo, file_path, name) LEFT JOIN single USING (repo, name) WHERE coalesce(here, there) <> src GROUP BY ALL)
SELECT DISTINCT a.repo, 'dir::' || a.d AS src, 'dir::' || b.d AS dst, 'contain' AS edge_type, NULL::INT AS line FROM up a JOIN up b ON b.repo = a.repo AND b.file_path = a.file_path AND b.i = a.i + 1
UNION ALL SELECT repo, 'dir::' || d, 'file::' || file_path, 'contain', NULL FROM up WHERE i = n - 1
UNION ALL SELECT DISTINCT repo, 'file::' || file_path, 'class::' || file_path || '::' || owner, 'contain', NULL FROM fn WHERE owner IS NOT NULL
UNION ALL SELECT DISTINCT repo, CASE WHEN owner IS NULL THEN 'file::' || file_path ELSE 'class::' || file_path || '::' || owner END, 'func::' || file_path || '::' || qualname, 'contain', NULL FROM fn
UNION ALL SELECT DISTINCT im.repo, 'file::' || im.file_path, 'file::' || target, 'import', NULL FROM im JOIN files f ON f.repo = im.repo AND f.file_path = target
UNION ALL SELECT repo, src, dst, 'invoke', line::INT FROM called""")
def outlined_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contain, import and invoke edges, as made of skeletons."""
    return code_graph.structural_edges(cut(_outlined(spark, sf_dir))).select("repo", "src", "dst", "edge_type", "line")


@query(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x{0b}\f\r]+'))::INT AS n FROM documents")
def whitespace_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens blanks separate in each document."""
    return table(spark, sf_dir, "documents").select("doc_id", T.whitespace_tokens(F.col("text")).alias("n"))


@query(OUTLINED + r""", im AS (SELECT repo, file_path, list_slice(list_filter(list_concat(regexp_extract_all(content, '(?:^|[\r\n])((?:from|import) [^\r\n]*)', 1), ['from ' || replace(regexp_replace(lag(file_path) OVER (PARTITION BY repo ORDER BY file_path), '[.]py$', ''), '/', '.') || ' import x']), lambda x: x IS NOT NULL), 1, 50) AS i FROM files),
de AS (SELECT repo, file_path, owner, string_agg(CASE WHEN owner IS NULL THEN '' ELSE '  ' END || 'def ' || name || '()' || CASE WHEN docstring <> '' THEN chr(10) || CASE WHEN owner IS NULL THEN '' ELSE '  ' END || '  ' || repeat(chr(34), 3) || left(docstring, 120) || repeat(chr(34), 3) ELSE '' END, chr(10) ORDER BY name, qualname) AS body FROM fn GROUP BY ALL),
cl AS (SELECT repo, file_path, string_agg('class ' || owner || chr(10) || body, chr(10) ORDER BY owner) AS classes FROM de WHERE owner IS NOT NULL GROUP BY ALL)
SELECT im.repo, im.file_path, concat_ws(chr(10), 'FILE: ' || im.file_path, CASE WHEN len(i) > 0 THEN 'IMPORTS: ' || array_to_string(i, ', ') END, classes, body) AS outline FROM im LEFT JOIN cl USING (repo, file_path) LEFT JOIN (SELECT * FROM de WHERE owner IS NULL) de ON de.repo = im.repo AND de.file_path = im.file_path""")
def outlined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of skeletons that were written as JSON lines and read again."""
    path = table_folder(spark)
    skeletons.write_skeletons(_outlined(spark, sf_dir), path)
    return skeletons.outline_text(skeletons.read_skeletons(spark, path))


@query("SELECT repo, src, dst FROM (" + ORACLES["outlined_edges"] + ") WHERE edge_type = 'invoke'")
def saved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between functions, out of a graph that was saved in folders by repository and type and loaded again."""
    path, rows = table_folder(spark), cut(_outlined(spark, sf_dir))
    code_graph.save_graph(code_graph.graph_nodes(rows), code_graph.structural_edges(rows), path)
    nodes, edges = code_graph.load_graph(spark, path)
    known = nodes.filter("node_type = 'function'").select("repo", F.col("node_id").alias("src"))
    return edges.filter("edge_type = 'invoke'").join(known, ["repo", "src"], "left_semi").select("repo", "src", "dst")


@query(f"WITH {REQUESTS}, known AS (SELECT DISTINCT r.key FROM requests r JOIN issues i USING (instance_id) WHERE i.patch IS NULL OR i.patch = '')" + """
SELECT DISTINCT r.instance_id, r.key, CASE WHEN r.key IN (SELECT key FROM known) THEN 'cached' ELSE length(coalesce(i.problem_statement, ''))::VARCHAR END AS text
FROM requests r JOIN issues i ON i.instance_id = r.instance_id AND i.created_at = r.created_at AND i.repo = r.repo
WHERE r.key = sha256('{"messages":[{"content":' || to_json(coalesce(i.problem_statement, ''))::VARCHAR || ',"role":"user"}],"mode":"non-think","model":"local","response_format":{"type":"object"},"seed":0,"temperature":0.0}')""")
def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to all requests, those to reports without a patch out of a cache, the rest asked of a model that counts characters."""
    rows = table(spark, sf_dir, "issues").filter("instance_id is not null").select("instance_id", "patch").distinct()
    requests = _requests(spark, sf_dir, "prompt").select("instance_id", "key", "prompt").distinct()
    known = requests.join(rows.filter("patch is null or patch = ''"), "instance_id", "left_semi").select("key", F.lit("cached").alias("text"), F.lit(None).cast("string").alias("reasoning")).distinct()
    path = table_folder(spark)
    replies.add(known, path)
    every, _ = providers.answered(requests, replies.read(spark, path), lambda prompt: (str(len(prompt)), None))
    return every.select("instance_id", "key", "text").distinct()


@query(r"""WITH fn AS (SELECT repo, node_id, code FROM (SELECT *, row_number() OVER (PARTITION BY repo, node_id ORDER BY ingested_at DESC) AS k FROM nodes WHERE node_type = 'function' AND node_id IS NOT NULL) WHERE k = 1 AND repo IS NOT NULL AND code IS NOT NULL),
l AS (SELECT repo, node_id, i AS line, t[i] AS s FROM (SELECT repo, node_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT repo, node_id, regexp_split_to_array(code, '\r\n|\r|\n') AS t FROM fn))),
m AS (SELECT repo, node_id, line, var, bool_or(def) AS def, bool_or(NOT def) AS use FROM (SELECT repo, node_id, line, unnest(regexp_extract_all(s, '^\s*([A-Za-z_][A-Za-z0-9_]*) *=[^=]', 1)) AS var, true AS def FROM l
  UNION ALL SELECT repo, node_id, line, unnest(regexp_extract_all(regexp_replace(s, '^\s*[A-Za-z_][A-Za-z0-9_]* *=([^=])', '\1'), '[A-Za-z_][A-Za-z0-9_]*')), false FROM l) GROUP BY ALL),
d AS (SELECT *, last_value(CASE WHEN def THEN line END IGNORE NULLS) OVER (PARTITION BY repo, node_id, var ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_line FROM m)
SELECT repo, node_id, var, def_line::INT AS def_line, line::INT AS use_line FROM d WHERE use AND def_line IS NOT NULL""")
def line_def_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Def-use links between the lines of each function, a line that begins with a name and = taken for its definition."""
    known = plan.functions(table(spark, sf_dir, "nodes"), code=True).filter("repo is not null and code is not null")
    lines = known.select("repo", "node_id", F.posexplode(F.split("code", "\r\n|\r|\n")).alias("ix", "s"))
    defs = F.regexp_extract_all("s", F.lit(r"^\s*([A-Za-z_][A-Za-z0-9_]*) *=[^=]"), F.lit(1))
    uses = F.regexp_extract_all(F.regexp_replace("s", r"^\s*[A-Za-z_][A-Za-z0-9_]* *=([^=])", "$1"), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return code_graph.def_use(lines.select("repo", "node_id", "ix", (F.col("ix") + 1).alias("line"), defs.alias("defs"), uses.alias("uses")), keys=["repo", "node_id"])


@query(SEEDS + """, s AS (SELECT instance_id, rank, '  n' || left(md5(node_id), 8) || '[' || chr(34) || split_part(file_path, '/', -1) || '::' || qualname || chr(34) || ']' AS line FROM seeded JOIN reports USING (instance_id) JOIN funcs USING (repo, node_id) WHERE rank <= 8)
SELECT instance_id, 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS drawing FROM s GROUP BY instance_id""")
def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the first eight seeds of each report as the nodes of a drawing."""
    seeds = _seeds(spark, sf_dir).join(_reports(spark, sf_dir).select("instance_id", "repo"), "instance_id")
    return prompts.drawn(seeds.join(_functions(spark, sf_dir).select("repo", "node_id", "file_path", "qualname"), ["repo", "node_id"]))
