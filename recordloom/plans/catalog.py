"""Registered queries over the record model and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import extraction
from ..functions import text as T
from ..operators import dedup, greedy, index, lifecycle, quality, upkeep, vector
from ..sources import adapter as A
from ..sources import formats, ingest, store
from ..streaming import progress
from . import graph

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from . import contracts, imports, policies, segmented, walks  # noqa: F401  registers the rest

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    from . import contracts, imports, policies, segmented, walks  # noqa: F401

    return dict(_SQL)


R, M, D = f"({A.RECORDS_SQL})", f"({A.MESSAGES_SQL})", f"({A.DECISIONS_SQL})"
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def TOK(c):  # noqa: N802
    return rf"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({c}, ''))), '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda x: x <> '')"


def NORM(c):  # noqa: N802
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[''\"]', '', 'g'), '{SPACE}', ' ', 'g'))"


_DUP = f"dup AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY project, n ORDER BY CASE provenance WHEN 'verbatim' THEN 1 WHEN 'extracted' THEN 2 ELSE 4 END, length(text) DESC, importance DESC, minute DESC, id) AS place FROM (SELECT *, {NORM('text')} AS n FROM {R}) WHERE length(n) >= 20) WHERE place > 1)"
_BASE = f"d AS (SELECT id, project, minute, text, {TOK('text')} AS t FROM {R}), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d)"


def _bm25_sql(phrases: list[str], match: str, score: str | None = None, limit: int = 10, where: str = "TRUE", hide: bool = False, out: str = "id, round(rank, 6) AS rank") -> str:
    """phrases: SQL for each phrase's frequency on t; match: condition on f0, f1, ...; score: sum over s0, s1, ..."""
    fs = ", ".join(f"{p} AS f{i}" for i, p in enumerate(phrases))
    ds = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(phrases)))
    ss = ", ".join(f"(CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 0.000001 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len(t) / a)) AS s{i}" for i in range(len(phrases)))
    score = score or " + ".join(f"s{i}" for i in range(len(phrases)))
    hidden = "AND id NOT IN (SELECT id FROM dup)" if hide else ""
    return f"WITH {_DUP}, {_BASE}, f AS (SELECT *, {fs} FROM d), c AS (SELECT {ds} FROM f), p AS (SELECT *, {ss} FROM f, s, c) SELECT {out} FROM (SELECT *, -({score}) AS rank FROM p WHERE ({match}) AND {where} {hidden} ORDER BY rank, id LIMIT {limit})"


def _tf(w):
    return f"len(list_filter(t, lambda x: x = '{w}'))"


def _pf(w):
    return f"len(list_filter(t, lambda x: starts_with(x, '{w}')))"


def _phrase(*words):
    return f"len(list_filter(range(1, len(t) - {len(words) - 2}), lambda i: " + " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(words)) + "))"


def _marked(spark, d):
    rows = store.spread(A.records(spark, d)).withColumn("table", F.lit("documents"))
    return dedup.plan_exact(dedup.candidates(rows, F.col("text")))


def _ranked(df):
    return df.select("id", F.round("rank", 6).alias("rank"))


def docs_index(spark, d):
    """The stored index of documents in their present version."""
    docs = A.table(spark, d, "documents")
    return index.open_index(spark, "documents", docs.select(F.col("doc_id").alias("id"), "text"), ["text"], store.version_of(docs))


def messages_index(spark, d):
    rows = A.table(spark, d, "conversations")
    return index.open_index(spark, "messages", A.messages(spark, d).select("id", "content"), ["content"], store.version_of(rows))


def hidden(spark, d):
    """Recorded marks of the documents (id): planned once for each version of them, as a lineage table would hold them."""
    version = store.version_of(A.table(spark, d, "documents"), A.table(spark, d, "labels"))
    return store.derived(spark, "documents-marks", version, lambda: _marked(spark, d).select("survivor", "id"))


def unit_vectors(spark, d):
    e = A.table(spark, d, "embeddings")
    return store.derived(spark, "units", store.version_of(e), lambda: vector.units(e.withColumnRenamed("vec_id", "id")))


def first_vector(spark, d):
    """The query of the vector searches: the vector with the smallest id."""
    return A.table(spark, d, "embeddings").agg(F.min_by("embedding", "vec_id")).first()[0]


def _projects(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project"))


@_query(f"SELECT 'postings' AS part, count(*) AS n FROM (SELECT DISTINCT id, unnest({TOK('text')}) AS term FROM {R}) UNION ALL SELECT 'terms', count(*) FROM (SELECT DISTINCT unnest({TOK('text')}) AS term FROM {R}) UNION ALL SELECT 'rows', count(*) FROM {R}")
def index_build(spark, d):
    """Builds the stored index if this version has none, and counts what it holds."""
    held = docs_index(spark, d)
    count = lambda part, df: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return count("postings", held.postings).unionByName(count("terms", held.terms)).unionByName(spark.range(1).select(F.lit("rows").alias("part"), F.lit(held.n).alias("n")))


@_query(_bm25_sql([_tf("tion"), _tf("erre")], "f0 > 0 OR f1 > 0", hide=True))
def bm25_topk(spark, d):
    return _ranked(index.top(docs_index(spark, d), "tion OR erre", 10, hidden=hidden(spark, d)))


@_query(_bm25_sql([_tf("the"), _tf("thand"), _tf("aux")], "f0 > 0 OR f1 > 0 OR f2 > 0", limit=50))
def bm25_or(spark, d):
    return _ranked(index.top(docs_index(spark, d), "the OR thand OR aux", 50))


@_query(_bm25_sql([_tf("and"), _tf("ener")], "f0 > 0 AND f1 > 0", limit=50))
def bm25_and(spark, d):
    return _ranked(index.top(docs_index(spark, d), "and ener", 50))


@_query(_bm25_sql([_tf("the"), _tf("with")], "f0 > 0 OR f1 > 0", where="project = 'src3'"))
def bm25_project(spark, d):
    return _ranked(index.top(docs_index(spark, d), "the OR with", 10, rows=_projects(spark, d), project="src3"))


@_query(_bm25_sql([_phrase("of", "the")], "f0 > 0", limit=100))
def bm25_phrase(spark, d):
    return _ranked(index.top(docs_index(spark, d), '"of the"', 100))


@_query(_bm25_sql([_pf("tio")], "f0 > 0", limit=100))
def bm25_prefix(spark, d):
    return _ranked(index.top(docs_index(spark, d), "tio*", 100))


@_query(_bm25_sql([_tf("tion"), _tf("and"), _tf("erre"), _tf("aux")], "(f0 > 0 OR (f1 > 0 AND f2 > 0)) AND NOT f3 > 0", score="s0 + CASE WHEN f1 > 0 AND f2 > 0 THEN s1 + s2 ELSE 0 END", limit=100))
def bm25_boolean(spark, d):
    return _ranked(index.top(docs_index(spark, d), "(tion OR and erre) NOT aux", 100))


def _places(w):
    return f"list_filter(range(1, len(t) + 1), lambda i: t[i] = '{w}')"


_NEAR = f"""WITH {_BASE}, p AS (SELECT *, {_places('tion')} AS p0, {_places('the')} AS p1 FROM d),
  o AS (SELECT *, list_concat(list_filter(p0, lambda s: len(list_filter(p1, lambda q: q >= s AND q <= s + 6)) > 0), list_filter(p1, lambda s: len(list_filter(p0, lambda q: q >= s AND q <= s + 6)) > 0)) AS opened FROM p),
  f AS (SELECT *, len(list_filter(p0, lambda q: len(list_filter(opened, lambda s: q >= s AND q <= s + 6)) > 0)) AS f0, len(list_filter(p1, lambda q: len(list_filter(opened, lambda s: q >= s AND q <= s + 6)) > 0)) AS f1 FROM o),
  c AS (SELECT count(*) FILTER (WHERE len(p0) > 0) AS d0, count(*) FILTER (WHERE len(p1) > 0) AS d1 FROM f),
  r AS (SELECT id, -((CASE WHEN (n - d0 + 0.5) / (d0 + 0.5) > 1 THEN ln((n - d0 + 0.5) / (d0 + 0.5)) ELSE 0.000001 END) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len(t) / a)) + (CASE WHEN (n - d1 + 0.5) / (d1 + 0.5) > 1 THEN ln((n - d1 + 0.5) / (d1 + 0.5)) ELSE 0.000001 END) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len(t) / a))) AS rank FROM f, s, c WHERE f0 > 0 AND f1 > 0)
  SELECT id, round(rank, 6) AS rank FROM (SELECT * FROM r ORDER BY rank, id LIMIT 100)"""


@_query(_NEAR)
def bm25_near(spark, d):
    return _ranked(index.top(docs_index(spark, d), "NEAR(tion the, 5)", 100))


def _multi(spark, d, bias=None):
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project"), "text")
    tables = {"documents": (docs_index(spark, d), docs, F.substring("text", 1, 200)), "messages": (messages_index(spark, d), A.messages(spark, d).select("id", "project", "content"), F.substring("content", 1, 200))}
    return index.search_tables(tables, "the OR and", 20, bias=bias).select("table", "id", F.round("rank", 6).alias("rank"))


def _multi_sql(bias):
    part = lambda name, rows: f"""SELECT '{name}' AS "table", id, rank FROM (WITH d AS (SELECT id, {TOK('text')} AS t FROM {rows}), s AS (SELECT count(*) AS n, avg(len(t)) AS a, count(*) FILTER (WHERE list_contains(t, 'the')) AS d0, count(*) FILTER (WHERE list_contains(t, 'and')) AS d1 FROM d),
      p AS (SELECT id, {_tf('the')} AS f0, {_tf('and')} AS f1, len(t) AS l, s.* FROM d, s)
      SELECT id, -((CASE WHEN (n - d0 + 0.5) / (d0 + 0.5) > 1 THEN ln((n - d0 + 0.5) / (d0 + 0.5)) ELSE 0.000001 END) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / a)) + (CASE WHEN (n - d1 + 0.5) / (d1 + 0.5) > 1 THEN ln((n - d1 + 0.5) / (d1 + 0.5)) ELSE 0.000001 END) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / a))) AS rank FROM p WHERE f0 > 0 OR f1 > 0 ORDER BY rank, id LIMIT 20)"""  # noqa: E731
    return f"""SELECT "table", id, round(rank, 6) AS rank FROM ({part('documents', R)} UNION ALL {part('messages', f"(SELECT id, content AS text FROM {M})")}) ORDER BY CASE WHEN "table" = '{bias}' THEN rank * 4 ELSE rank END, rank, "table", id LIMIT 20"""


@_query(_multi_sql("none"))
def bm25_multi_table(spark, d):
    return _multi(spark, d)


@_query(_multi_sql("messages"))
def bm25_bias(spark, d):
    return _multi(spark, d, "messages")


_BATCH = f"""WITH {_BASE}, w AS (SELECT item_id AS query_id, unnest({TOK('text')}) AS term FROM benchmark), v AS (SELECT query_id, term, count(*) AS times FROM w GROUP BY ALL),
  h AS (SELECT id, term, len, count(*) AS f FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM w) GROUP BY ALL), o AS (SELECT term, count(*) AS df FROM h GROUP BY term),
  r AS (SELECT query_id, id, -sum(times * (CASE WHEN (n - df + 0.5) / (df + 0.5) > 1 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 0.000001 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / a))) AS rank FROM v JOIN h USING (term) JOIN o USING (term), s GROUP BY query_id, id),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), id) AS place FROM r)"""


def _batch(spark, d, limit=10):
    q = A.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("terms"))
    return index.search_many(docs_index(spark, d), q, limit)


@_query(_BATCH + " SELECT query_id, id, round(rank, 6) AS rank, CAST(place AS INTEGER) AS place FROM k WHERE place <= 10")
def bm25_batch(spark, d):
    return _batch(spark, d).select("query_id", "id", F.round("rank", 6).alias("rank"), F.col("place").cast("int").alias("place"))


@_query(f"SELECT term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, unnest({TOK('text')}) AS term FROM {R}) GROUP BY term")
def term_frequencies(spark, d):
    return A.records(spark, d).select("id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs"))


@_query(f"SELECT id, sha256({NORM('text')}) AS key FROM {R} WHERE length({NORM('text')}) >= 20")
def normalise_keys(spark, d):
    return dedup.candidates(A.records(spark, d), F.col("text")).select("id", "key")


_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (sqrt(list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform({b}, lambda x: CAST(x AS DOUBLE) * x))))"


@_query(f"SELECT vec_id AS id, round({_COS.format(a='embedding', b='q')}, 6) AS similarity FROM embeddings, (SELECT arg_min(embedding, vec_id) AS q FROM embeddings) ORDER BY {_COS.format(a='embedding', b='q')} DESC, vec_id LIMIT 10")
def knn_topk(spark, d):
    return vector.knn_units(unit_vectors(spark, d), first_vector(spark, d), 10).select("id", F.round("similarity", 6).alias("similarity"))


@_query(f"SELECT query_id, id, round(s, 6) AS similarity, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS place FROM (SELECT x.vec_id AS query_id, y.vec_id AS id, {_COS.format(a='x.embedding', b='y.embedding')} AS s FROM embeddings x, embeddings y WHERE x.vec_id % 20 = 0)) WHERE place <= 5")
def knn_batch(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vector.knn_many(e.filter("id % 20 = 0"), e, 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("int").alias("place"))


def _vectors(spark, d):
    return A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("project"), F.col("vec_id").cast("string").alias("key"), "embedding")


def _pairs_sql(threshold):
    return f"SELECT a, b, s FROM (SELECT x.vec_id AS a, y.vec_id AS b, {_COS.format(a='x.embedding', b='y.embedding')} AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id AND x.label IS NOT DISTINCT FROM y.label) WHERE s >= {threshold}"


_SWEEP = f"""WITH RECURSIVE p AS (SELECT b AS keep, a AS dropped, s, row_number() OVER (ORDER BY s DESC, a, b) AS i FROM ({_pairs_sql(0.3)})),
  w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone, CAST([] AS BIGINT[]) AS kept, FALSE AS ok UNION ALL
        SELECT i, CASE WHEN ok THEN list_append(gone, dropped) ELSE gone END, CASE WHEN ok THEN list_append(kept, keep) ELSE kept END, ok
        FROM (SELECT p.i, gone, kept, dropped, keep, NOT (list_contains(gone, keep) OR list_contains(gone, dropped) OR list_contains(kept, dropped)) AS ok FROM w JOIN p ON p.i = w.i + 1))
  SELECT keep AS survivor, dropped AS id, round(s, 6) AS similarity FROM p JOIN w USING (i) WHERE ok"""

_LEAD = f"""WITH RECURSIVE p AS ({_pairs_sql(0.25)}), v AS (SELECT id, row_number() OVER (ORDER BY id) AS i, (SELECT coalesce(list(a), []) FROM p WHERE b = id) AS before FROM (SELECT a AS id FROM p UNION SELECT b FROM p)),
  w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS lead UNION ALL SELECT v.i, CASE WHEN list_has_any(before, lead) THEN lead ELSE list_append(lead, id) END FROM w JOIN v ON v.i = w.i + 1),
  l AS (SELECT unnest(lead) AS leader FROM w WHERE i = (SELECT max(i) FROM w)),
  m AS (SELECT min(a) AS leader, b AS id FROM p JOIN l ON a = leader WHERE b NOT IN (SELECT leader FROM l) GROUP BY b)
  SELECT leader, id FROM m UNION SELECT leader, leader FROM m"""


@_query(_SWEEP)
def semantic_greedy_marks(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("project"), F.lit(None).cast("string").alias("provenance"), F.lit(1).alias("chars"), F.lit(5).alias("importance"), F.col("vec_id").alias("minute"))
    return greedy.marks(_vectors(spark, d), e, 0.3).select("survivor", "id", F.round("similarity", 6).alias("similarity"))


@_query(_LEAD)
def leader_clusters(spark, d):
    return greedy.leaders(_vectors(spark, d), 0.25)


def _lists(spark, d):
    place = F.row_number().over(W.orderBy("rank", "id"))
    fts = index.top(docs_index(spark, d), "the OR and OR tion", 20).select(F.col("id").alias("key"), place.alias("place"))
    near = vector.knn_units(unit_vectors(spark, d), first_vector(spark, d), 20)
    return fts, near.select(F.col("id").alias("key"), F.row_number().over(W.orderBy(F.desc("similarity"), "id")).alias("place"))


_FTS20 = _bm25_sql([_tf("the"), _tf("and"), _tf("tion")], "f0 > 0 OR f1 > 0 OR f2 > 0", limit=20, out="id, rank")


@_query(f"""WITH a AS (SELECT id AS key, row_number() OVER (ORDER BY rank, id) AS p1 FROM ({_FTS20})), v AS (SELECT vec_id AS key, row_number() OVER (ORDER BY s DESC, vec_id) AS p2 FROM (SELECT vec_id, {_COS.format(a='embedding', b='q')} AS s FROM embeddings, (SELECT arg_min(embedding, vec_id) AS q FROM embeddings) ORDER BY s DESC, vec_id LIMIT 20))
  SELECT key, round(coalesce(1.0 / (60 + p1), 0) + coalesce(1.0 / (60 + p2), 0), 9) AS score, CASE WHEN p1 IS NULL THEN 'vec' WHEN p2 IS NULL THEN 'fts' ELSE 'both' END AS source FROM a FULL JOIN v USING (key) ORDER BY coalesce(1.0 / (60 + p1), 0) + coalesce(1.0 / (60 + p2), 0) DESC, p1 NULLS LAST, p2 NULLS LAST, key LIMIT 10""")  # fmt: skip
def hybrid_search(spark, d):
    return vector.fuse(*_lists(spark, d), 10).select("key", F.round("score", 9).alias("score"), "source")


@_query(f"""WITH a AS (SELECT id AS key, row_number() OVER (ORDER BY rank, id) AS p1 FROM ({_FTS20})) SELECT key, round(1.0 / (60 + p1), 9) AS score, 'fts' AS source FROM a ORDER BY p1 LIMIT 10""")
def hybrid_degraded(spark, d):
    fts, _ = _lists(spark, d)
    return vector.fuse(fts, fts.limit(0), 10).select("key", F.round("score", 9).alias("score"), "source")


_EXACT = f"""WITH c AS (SELECT *, {NORM('text')} AS n FROM {R}), g AS (SELECT id, project, first_value(id) OVER w AS survivor, row_number() OVER w AS place FROM c WHERE length(n) >= 20 WINDOW w AS (PARTITION BY coalesce(project, ''), n ORDER BY CASE provenance WHEN 'verbatim' THEN 1 WHEN 'extracted' THEN 2 ELSE 4 END, length(text) DESC, importance DESC, minute DESC, id))"""


@_query(_EXACT + " SELECT survivor, id FROM g WHERE place > 1")
def dedup_exact_plan(spark, d):
    return _marked(spark, d).select("survivor", "id")


@_query(_EXACT + " SELECT survivor, count(*) AS n FROM g WHERE place > 1 GROUP BY survivor")
def dedup_survivors(spark, d):
    return _marked(spark, d).groupBy("survivor").agg(F.count("*").alias("n"))


@_query(f"SELECT project, count(*) AS n FROM {R} WHERE id NOT IN (SELECT id FROM ({_EXACT} SELECT id FROM g WHERE place > 1)) GROUP BY project")
def dedup_apply_visible(spark, d):
    empty = spark.createDataFrame([], "survivor_id long, duplicate_id long, reason string, status string")
    lineage = dedup.apply_marks(empty, _marked(spark, d), "exact")
    return dedup.visible(A.records(spark, d), lineage).groupBy("project").agg(F.count("*").alias("n"))


@_query(f"SELECT key, array_to_string(list_sort(list(DISTINCT t)), ',') AS tables, count(*) AS n FROM (SELECT 'a' AS t, sha256({NORM('text')}) AS key FROM documents WHERE length({NORM('text')}) >= 20 AND doc_id % 2 = 0 UNION ALL SELECT 'b', sha256({NORM('text')}) FROM documents WHERE length({NORM('text')}) >= 20 AND doc_id % 2 = 1) GROUP BY key HAVING count(DISTINCT t) >= 2")
def dedup_cross_table(spark, d):
    rows = A.records(spark, d).withColumn("table", F.when(F.col("id") % 2 == 0, "a").otherwise("b")).withColumn("project", F.lit("all"))
    return dedup.cross_table(dedup.candidates(rows, F.col("text"))).select("key", F.array_join("tables", ",").alias("tables"), "n")


@_query(f"SELECT id, confidence FROM {D} WHERE status = 'active' ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 1 END, created DESC, id DESC LIMIT 50")
def recent_decisions(spark, d):
    key = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "low", 2).otherwise(1)
    return A.decisions(spark, d).filter("status = 'active'").orderBy(key, F.desc("created"), F.desc("id")).limit(50).select("id", "confidence")


@_query(f"SELECT id FROM {D} WHERE status = 'superseded' AND project = 'c3' ORDER BY created DESC, id DESC LIMIT 100")
def list_by_status(spark, d):
    return A.decisions(spark, d).filter("status = 'superseded' AND project = 'c3'").orderBy(F.desc("created"), F.desc("id")).limit(100).select("id")


@_query(f"SELECT id, minute FROM {M} WHERE project = 'p2' ORDER BY minute DESC, id DESC LIMIT 20")
def recent_messages(spark, d):
    return A.messages(spark, d).filter("project = 'p2'").orderBy(F.desc("minute"), F.desc("id")).limit(20).select("id", "minute")


@_query(f"""SELECT 'messages' AS "table", count(*) AS n, count(*) FILTER (WHERE role = 'user') AS n_filtered FROM {M} UNION ALL SELECT 'documents', count(*), count(*) FILTER (WHERE provenance IS NOT NULL) FROM {R} UNION ALL SELECT 'decisions', count(*), count(*) FILTER (WHERE status = 'active') FROM {D}""")
def stats_counts(spark, d):
    return quality.counts({"messages": (A.messages(spark, d), F.col("role") == "user"), "documents": (A.records(spark, d), F.col("provenance").isNotNull()), "decisions": (A.decisions(spark, d), F.col("status") == "active")})


@_query(f"SELECT coalesce(provenance, 'unknown') AS value, count(*) AS n FROM {R} GROUP BY 1 UNION ALL SELECT 'derived', 0")
def provenance_histogram(spark, d):
    return quality.histogram(A.records(spark, d), "provenance", ("unknown", "derived"))


@_query(f"SELECT m.id FROM {M} m WHERE minute < 3000 AND session_id IN (SELECT id FROM {R} WHERE importance >= 6) AND id % 7 <> 0")
def prune_messages(spark, d):
    m, r = A.messages(spark, d), A.records(spark, d)
    return lifecycle.prune_messages(m, r.filter("importance >= 6").select(F.col("id").alias("session_id")), m.filter("id % 7 = 0"), 3000).select("id")


@_query(f"SELECT id FROM {D} WHERE status IN ('superseded', 'reverted') AND created < TIMESTAMP '2001-09-01' - INTERVAL 90 DAY")
def prune_plan(spark, d):
    return lifecycle.prune_decisions(A.decisions(spark, d), "2001-09-01", 180).select("id")


@_query(f"SELECT id, id % 11 = 0 AS protected FROM {R} WHERE minute < 800 AND importance < 5")
def age_plan(spark, d):
    r = A.records(spark, d)
    return lifecycle.plan_age(r, r.filter("id % 11 = 0"), 800).select("id", "protected")


@_query(f"SELECT project, count(*) AS matched, count(*) FILTER (WHERE id % 11 = 0) AS protected FROM {R} WHERE minute < 800 AND importance < 5 GROUP BY project")
def age_protected_counts(spark, d):
    r = A.records(spark, d)
    return lifecycle.plan_age(r, r.filter("id % 11 = 0"), 800).groupBy("project").agg(F.count("*").alias("matched"), F.count_if("protected").alias("protected"))


@_query(f"SELECT id, new_importance FROM (SELECT *, CASE confidence WHEN 'high' THEN 7 WHEN 'low' THEN 3 ELSE 5 END AS new_importance FROM {D}) WHERE importance = 5 AND importance <> new_importance")
def importance_backfill(spark, d):
    return lifecycle.importance_backfill(A.decisions(spark, d)).select("id", "new_importance")


@_query(f"SELECT id, 'extracted' AS new_provenance FROM {R} WHERE provenance IS NULL AND length(text) >= 500")
def provenance_backfill(spark, d):
    return lifecycle.provenance_backfill(A.records(spark, d), F.length("text") >= 500, "extracted").select("id", "new_provenance")


@_query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN id % 3 = 0 AND status = 'active' THEN 'superseded' ELSE status END AS status FROM {D}) GROUP BY status")
def supersede(spark, d):
    x = A.decisions(spark, d)
    return lifecycle.set_status(x, x.filter("id % 3 = 0"), "superseded").groupBy("status").agg(F.count("*").alias("n"))


@_query(f"SELECT project, bucket, n, representative, bucket * 1440 AS from_minute FROM (SELECT coalesce(project, '') AS project, CAST(floor(minute / 1440.0) AS BIGINT) AS bucket, count(*) AS n, arg_max(id, (length(text), importance, minute, -id)) AS representative FROM {R} WHERE minute < 100000 AND importance < 5 GROUP BY 1, 2) WHERE n >= 3")
def consolidate_buckets(spark, d):
    return lifecycle.consolidate(A.records(spark, d).withColumn("chars", F.length("text")), 1, 100000)


@_query(f"""WITH a AS (SELECT 'loa' AS "table", 0 AS priority, id, importance, minute FROM {R} ORDER BY importance DESC, minute DESC, id DESC LIMIT 6), p AS (SELECT *, row_number() OVER (ORDER BY importance DESC, minute DESC, id DESC) AS place FROM a),
  b AS (SELECT * FROM (SELECT 'messages' AS "table", 1 AS priority, id, importance, minute, row_number() OVER (ORDER BY importance DESC, minute DESC, id DESC) AS place FROM {M}) WHERE place <= 12), u AS (SELECT *, priority = 0 AND place <= 4 AS reserved FROM (SELECT * FROM p UNION ALL SELECT * FROM b))
  SELECT "table", priority, id, importance, minute, reserved FROM u ORDER BY reserved DESC, importance DESC, priority, minute DESC, id DESC LIMIT 12""")  # fmt: skip
def l1_assembly(spark, d):
    cols = lambda df, n, p: df.select(F.lit(n).alias("table"), F.lit(p).alias("priority"), "id", "importance", "minute")
    return lifecycle.tiered_context(cols(A.records(spark, d), "loa", 0), cols(A.messages(spark, d), "messages", 1))


_FREC = "SELECT user_id, n, CASE WHEN age < 60 THEN n * 4.0 WHEN age < 1440 THEN n * 2.0 WHEN age < 10080 THEN n * 0.5 ELSE n * 0.25 END AS score FROM (SELECT user_id, count(*) AS n, 43200 - max(CAST(floor(epoch(ts) / 60) AS BIGINT) - 28401120) AS age FROM events GROUP BY user_id)"


def _frecency(spark, d):
    minute = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60) - 28401120  # minutes since 2024-01-01
    e = A.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max(minute).alias("last"))
    return e.select("user_id", "n", lifecycle.frecency(F.col("n"), F.col("last"), 43200).alias("score"))


@_query(f"SELECT user_id, n, CAST(score AS DOUBLE) AS score FROM ({_FREC})")
def frecency(spark, d):
    return _frecency(spark, d)


@_query(f"SELECT user_id, n, round(CAST(score AS DOUBLE) * CASE WHEN (SELECT sum(score) FROM ({_FREC})) > 1000 THEN 0.9 ELSE 1.0 END, 6) AS score FROM ({_FREC})")
def global_aging(spark, d):
    return lifecycle.age_scores(_frecency(spark, d), 1000).withColumn("score", F.round("score", 6))


@_query("SELECT doc_id, length(regexp_replace(text, '[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{FEFF}]', '', 'g')) AS n FROM documents")
def strip_invisible(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.length(T.strip_invisible(F.col("text"))).cast("long").alias("n"))


@_query()
def redact_secrets(spark, d):
    keywords = r"(?:api[_-]?key|apikey|secret(?:[_-]?key)?|access[_-]?token|auth[_-]?token|client[_-]?secret|password|passwd|token)"
    t = A.table(spark, d, "documents").withColumn("clean", T.redact(F.col("text"), keywords))
    return t.filter("clean <> text").select("doc_id", F.sha2("clean", 256).alias("sha"))


@_query("SELECT doc_id, len(regexp_extract_all(text, '(?i)<\\|?(?:im_start|im_end|system|endoftext)\\|?>')) AS n FROM documents")
def threat_counts(spark, d):
    t = A.table(spark, d, "documents")
    return t.select("doc_id", F.regexp_count("text", F.lit(T.THREATS[3][1])).cast("long").alias("n"))


@_query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 50 AND length(regexp_replace(text, '\\s', '', 'g')) >= 100 AS good FROM documents")
def quality_gate(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.passes_quality(F.col("text")).alias("good"))


@_query(f"""SELECT session_id, string_agg(upper(role) || ': ' || CASE WHEN length(content) > 4000 THEN substr(content, 1, 4000) || '...[truncated]' ELSE content END, chr(10) || chr(10) ORDER BY minute, id) AS transcript, count(*) AS n FROM {M} WHERE role IN ('user', 'assistant') AND length(content) >= 10 AND NOT starts_with(content, '[{{') AND NOT starts_with(content, '{{"tool_use_id"') GROUP BY session_id""")
def transcript_slice(spark, d):
    return ingest.transcript_slice(A.messages(spark, d))


@_query(f"SELECT session_id, min(minute) AS started, max(minute) AS ended, count(*) AS n FROM {M} GROUP BY session_id")
def session_bounds(spark, d):
    return ingest.session_bounds(A.messages(spark, d))


@_query(f"SELECT min(id) AS id, session_id, content FROM {M} m WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM {M} e WHERE e.id % 2 = 0 AND e.session_id IS NOT DISTINCT FROM m.session_id AND e.content IS NOT DISTINCT FROM m.content) GROUP BY session_id, content")
def idempotent_append(spark, d):
    m = A.messages(spark, d)
    return ingest.append_new(m.filter("id % 2 = 0"), m.filter("id % 2 = 1"), ["session_id", "content"], [F.col("id")]).select("id", "session_id", "content")


@_query("""SELECT 'orders-without-lines' AS "check", count(*) AS n, array_to_string(list_slice(list_sort(list(o_orderkey)), 1, 5), ',') AS samples FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) HAVING count(*) > 0
  UNION ALL SELECT 'lines-without-orders', count(*), '' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) HAVING count(*) > 0""")
def orphan_checks(spark, d):
    o, li = A.table(spark, d, "orders"), A.table(spark, d, "lineitem")
    both = quality.orphans(o, "o_orderkey", li, "l_orderkey", "o_orderkey", "orders-without-lines").unionByName(quality.orphans(li, "l_orderkey", o, "o_orderkey", "l_orderkey", "lines-without-orders"))
    return both.withColumn("samples", F.array_join("samples", ","))


@_query(f"SELECT id FROM {R} WHERE length(text) >= 10 AND id NOT IN (SELECT vec_id FROM embeddings)")
def embed_gaps(spark, d):
    return quality.gaps(A.records(spark, d), A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "text").select("id")


@_query(f"SELECT e.label AS \"table\", count(*) AS n, CAST(sum(len(embedding) * 4) AS BIGINT) AS bytes FROM embeddings e GROUP BY e.label")
def embed_stats(spark, d):
    return A.table(spark, d, "embeddings").groupBy(F.col("label").alias("table")).agg(F.count("*").alias("n"), F.sum(F.size("embedding") * 4).alias("bytes"))


@_query(f"SELECT c AS range_id, count(id) AS n, 8 - count(id) AS missing FROM (SELECT DISTINCT conv_id AS c FROM conversations) LEFT JOIN {M} ON id BETWEEN c * 1000 AND c * 1000 + 7 AND session_id = c GROUP BY c")
def range_join_quotes(spark, d):
    m = A.messages(spark, d)
    ranges = m.select(F.col("session_id").alias("c")).distinct()
    own = m.select("id", "session_id")
    j = ranges.join(own, (F.col("session_id") == F.col("c")) & F.col("id").between(F.col("c") * 1000, F.col("c") * 1000 + 7), "left")
    return j.groupBy(F.col("c").alias("range_id")).agg(F.count("id").alias("n"), (8 - F.count("id")).alias("missing"))


@_query("WITH RECURSIVE r AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part), t AS (SELECT CAST(3 AS BIGINT) AS id, 0 AS depth UNION ALL SELECT r.id, depth + 1 FROM r JOIN t ON r.parent = t.id) SELECT id, depth FROM t")
def lineage_closure(spark, d):
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 1, F.expr("p_partkey div 2")).alias("parent"))
    return graph.descendants(rows, "parent", spark.createDataFrame([(3,)], "id long"))


_TRUTH = "SELECT item_id AS query_id, doc_id AS id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)"


@_query(f"{_BATCH}, t AS ({_TRUTH}), z AS (SELECT query_id, count(DISTINCT id) AS relevant FROM t GROUP BY query_id), x AS (SELECT query_id, count(*) AS hits, min(place) AS first FROM k JOIN (SELECT DISTINCT * FROM t) USING (query_id, id) WHERE place <= 5 GROUP BY query_id) SELECT query_id, round(coalesce(hits, 0) / 5.0, 6) AS precision, round(coalesce(hits, 0) / relevant, 6) AS found_share, round(coalesce(1.0 / first, 0), 6) AS rr FROM z LEFT JOIN x USING (query_id)")
def retrieval_metrics(spark, d):
    """Real results (every item searched in all documents) against the documents that hold the item's whole text."""
    items = A.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    # A document that holds the item holds its longest token, so those meet by the index before texts are compared.
    longest = items.withColumn("term", F.element_at(F.array_sort(F.transform(T.tokens(F.col("item")), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"])
    near = docs_index(spark, d).postings.select("term", "id").join(longest, "term").select("query_id", "item", "id").distinct()
    truth = near.join(docs, "id").filter(F.contains("text", "item")).select("query_id", "id")
    m = quality.retrieval_metrics(_batch(spark, d, 5), truth)
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in ("precision", "found_share", "rr")))


@_query("SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM events GROUP BY event_type")
def percentile_nearest_rank(spark, d):
    return quality.nearest_rank(A.table(spark, d, "events"), "event_type", "value")


_EVENTS = "SELECT user_id AS session_id, event_id, event_type IN ('view', 'click') AS is_turn FROM events"


def _session_events(spark, d):
    return A.table(spark, d, "events").select(F.col("user_id").cast("long").alias("session_id"), F.col("event_id").cast("long").alias("event_id"), F.col("event_type").isin("view", "click").alias("is_turn"))


@_query(f"SELECT session_id, count(*) FILTER (WHERE is_turn) AS turns, count(*) FILTER (WHERE NOT is_turn) AS tools, max(event_id) AS last FROM ({_EVENTS}) GROUP BY session_id")
def session_progress(spark, d):
    return _session_events(spark, d).groupBy("session_id").agg(F.count_if("is_turn").alias("turns"), F.count_if(~F.col("is_turn")).alias("tools"), F.max("event_id").alias("last"))


@_query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_activity(spark, d):
    return progress.tumbling(A.table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@_query("WITH o AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, s")
def session_windows(spark, d):
    return progress.sessions(A.table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@_query(f"SELECT count(*) AS n, max(minute) AS last, CASE WHEN max(minute) > 6000 - 48 * 60 THEN 'PASS' ELSE 'WARN' END AS state FROM {M}")
def freshness(spark, d):
    return quality.freshness(A.messages(spark, d), "minute", 6000)


_O = "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders"


def _orders(spark, d):
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


@_query(f"SELECT id, CASE WHEN id % 4 = 0 THEN 'new' ELSE status END AS status, price FROM ({_O})")
def upsert_newest(spark, d):
    o = _orders(spark, d)
    batch = o.filter("id % 4 = 0").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("status", F.when(F.col("version") == 2, "new").otherwise("old"))
    return upkeep.newest_wins(o.withColumn("version", F.lit(0)), batch, ["id"], [F.desc("version")]).drop("version")


@_query(f"SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE status END AS status, price FROM ({_O}) WHERE id % 2 = 0 OR id % 3 = 0")
def upsert_fill_in(spark, d):
    o = _orders(spark, d)
    batch = o.filter("id % 3 = 0").select("id", F.lit("new").alias("status"), F.when(F.col("id") % 2 != 0, F.col("price")).alias("price"))
    return upkeep.fill_in(o.filter("id % 2 = 0"), batch, ["id"])


@_query('SELECT event_type AS "table", user_id AS id, count(DISTINCT event_id // 5) AS access_count, max(event_id) AS last_accessed FROM events GROUP BY 1, 2')
def access_totals(spark, d):
    e = A.table(spark, d, "events").select(F.col("event_type").alias("table"), F.col("user_id").alias("id"), F.expr("event_id div 5").alias("result_set"), F.col("event_id").alias("at"))
    return upkeep.access_totals(e)


_NEW = "thtion thing thble ering nicht erble and thtion"


@_query(rf"SELECT id, shared FROM (SELECT id, len(list_filter(string_split('{_NEW}', ' '), lambda w: length(w) > 4 AND list_contains(regexp_split_to_array(lower(content), '[\t-\r ]+'), w))) AS shared FROM {M}) WHERE shared >= 3")
def superseded_by_words(spark, d):
    m = A.messages(spark, d).select("id", F.col("content").alias("decision"), F.lit("active").alias("status"))
    return upkeep.superseded_by(m, _NEW).select("id", F.col("shared").cast("long").alias("shared"))


@_query("SELECT path, size, reason FROM (SELECT doc_id AS path, n_chars AS size, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 5 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'retry' END WHEN (n_chars - floor(n_chars / (doc_id % 5))) / floor(n_chars / (doc_id % 5)) > 0.5 THEN 'grew' END AS reason FROM documents WHERE n_chars >= 2000) WHERE reason IS NOT NULL")
def extraction_queue(spark, d):
    docs = A.table(spark, d, "documents")
    files = docs.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"))
    k, at = F.col("doc_id") % 5, lambda day: F.to_timestamp(F.lit(f"2024-01-{day:02d}"))
    tracker = docs.filter(k > 0).select(
        F.col("doc_id").alias("path"), F.floor(F.col("n_chars") / k).alias("seen_size"), F.when(k > 1, at(1)).alias("extracted_at"), F.when(k == 1, at(8)).alias("failed_at"),
        F.when((k == 1) & (F.col("doc_id") % 2 != 0), at(20)).alias("retry_after"),
    )
    return upkeep.extraction_queue(files, tracker, at(10))


@_query(f"""SELECT 'documents' AS "table", id, minute FROM (SELECT id, minute FROM {R} ORDER BY minute DESC, id DESC LIMIT 3) UNION ALL SELECT 'messages', id, minute FROM (SELECT id, minute FROM {M} ORDER BY minute DESC, id DESC LIMIT 2)""")
def recent_mix(spark, d):
    return upkeep.recent_mix({"documents": (A.records(spark, d), 3), "messages": (A.messages(spark, d), 2)})


@_query(f"SELECT id FROM {M} WHERE id > (SELECT max(id) FROM {M} WHERE id % 10 = 0 AND session_id < 20)")
def messages_since_last(spark, d):
    m = A.messages(spark, d)
    return upkeep.since_last(m, m.filter("id % 10 = 0 AND session_id < 20").select(F.col("id").alias("range_end"))).select("id")


@_query("SELECT count(*) AS n, count(*) FILTER (WHERE label % 2 = 1) AS n_other, CASE WHEN count(*) FILTER (WHERE label % 2 = 1) > 0 THEN 'stale' ELSE 'match' END AS state FROM embeddings")
def embedding_marker(spark, d):
    e = A.table(spark, d, "embeddings").select(F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model"), F.size("embedding").alias("dimensions"))
    return upkeep.marker_state(e, "m0", 64)


@_query(f"SELECT count(*) FILTER (WHERE id % 9 = 0) AS lacking, CAST(0 AS BIGINT) AS differing, CAST(0 AS BIGINT) AS surplus, 'drift' AS state FROM {R}")
def index_drift(spark, d):
    r = A.records(spark, d)
    return upkeep.index_state(r, upkeep.index_rows(r, ["text"]).filter("id % 9 <> 0"), ["text"])


@_query(f"SELECT id FROM {R} WHERE minute + 100 < 500 AND id % 13 <> 0")
def prune_expired(spark, d):
    r = A.records(spark, d)
    return upkeep.prune_expired(r.withColumn("expires_at", F.col("minute") + 100), F.lit(500), r.filter("id % 13 = 0")).select("id")


@_query(f"SELECT id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM {R}")
def token_estimates(spark, d):
    return A.records(spark, d).select("id", extraction.token_estimate(F.col("text")).alias("tokens"))


@_query(f"SELECT id, decision || chr(10) || chr(10) || 'Reasoning: ' || coalesce(confidence, 'N/A') AS text FROM {D}")
def embedding_texts(spark, d):
    return A.decisions(spark, d).select("id", extraction.embedding_text(F.col("decision"), F.col("confidence"), "Reasoning").alias("text"))


@_query("SELECT 'INSERT INTO suppliers (id, name) VALUES (' || s_suppkey || ', ''' || replace(s_name, '''', '''''') || ''');' AS line FROM supplier")
def export_sql(spark, d):
    return formats.sql_lines(A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "suppliers")


@_query("SELECT '## supplier ' || s_suppkey || chr(10) || chr(10) || '- **name**: ' || s_name || chr(10) AS line FROM supplier")
def export_markdown(spark, d):
    return formats.markdown_sections(A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "supplier")


@_query(f"SELECT role AS query, count(*) AS n, round(avg(importance), 6) AS results FROM {M} GROUP BY role ORDER BY n DESC, role LIMIT 20")
def usage_top_queries(spark, d):
    return upkeep.top_queries(A.messages(spark, d).select(F.col("role").alias("query"), F.col("importance").alias("results"))).withColumn("results", F.round("results", 6))
