"""Registered queries over the segmented index (increments, sorted terms, early-ending searches) and the vector index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells
from ..operators.segments import SegmentIndex
from ..sources import adapter as A
from ..sources import store
from . import catalog as C
from .catalog import _bm25_sql, _pf, _query, _ranked, _tf

MORE = " tion erre"
#: What the increments of changed() leave of the documents.
CHANGED = f"(SELECT * REPLACE (CASE WHEN kind = 'de' THEN text || '{MORE}' ELSE text END AS text) FROM {C.R} WHERE project IS DISTINCT FROM 'src1')"


def _index(spark, d, name: str, **settings) -> SegmentIndex:
    version = store.version_of(A.table(spark, d, "documents"))
    return SegmentIndex(spark, f"{store.shared_dir(spark)}/recordloom-index/{name}/{version}", ["text"], "source", **settings)


def _rows(spark, d):
    return A.table(spark, d, "documents").withColumnRenamed("doc_id", "id")


def documents(spark, d) -> SegmentIndex:
    """The documents, indexed at once: the first batch of this version's index, which is applied once."""
    own = _index(spark, d, "documents")
    own.change(_rows(spark, d).select("id", "source", "text"), batch=("build", 0))
    return own


def changed(spark, d) -> SegmentIndex:
    """The documents by increments: all sources but one, then that one, then new texts for a language, then a source is
    deleted. A batch that this version's index has is not applied again."""
    own, rows = _index(spark, d, "changed"), _rows(spark, d).select("id", "source", "lang", "text")
    late = F.col("source").eqNullSafe("src3")
    own.change(rows.filter(~late), batch=("plan", 0))
    own.change(rows.filter(late), batch=("plan", 1))
    own.change(rows.filter("lang = 'de'").withColumn("text", F.concat("text", F.lit(MORE))), batch=("plan", 2))
    own.change(deleted=rows.filter("source = 'src1'"), batch=("plan", 3))
    return own


@_query(_bm25_sql([_tf("tion"), _tf("erre"), _tf("the")], "f0 > 0 OR f1 > 0 OR f2 > 0", limit=50).replace(C.R, CHANGED))
def index_increments(spark, d):
    return _ranked(changed(spark, d).search("tion OR erre OR the", 50).rows)


@_query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest({C.TOK('text')}) AS term FROM {CHANGED}) GROUP BY term")
def index_increment_terms(spark, d):
    return changed(spark, d).terms()


@_query(_bm25_sql([_tf("the"), _tf("and"), _tf("tion")], "f0 > 0 OR f1 > 0 OR f2 > 0", limit=10, hide=True))
def index_early_top(spark, d):
    return _ranked(documents(spark, d).search("the OR and OR tion", 10, hidden=C.hidden(spark, d)).rows)


@_query(_bm25_sql([_tf("the"), _tf("erre"), _tf("aux")], "f0 > 0 AND f1 > 0 AND NOT f2 > 0", score="s0 + s1", limit=25, where="project = 'src2'"))
def index_early_boolean(spark, d):
    return _ranked(documents(spark, d).search("(the AND erre) NOT aux", 25, project="src2").rows)


@_query(_bm25_sql([_pf("tio"), _tf("and")], "f0 > 0 OR f1 > 0", limit=40))
def index_prefix_range(spark, d):
    return _ranked(documents(spark, d).search("tio* OR and", 40).rows)


def _vectors(spark, d):
    return A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def vector_index(spark, d) -> cells.VectorIndex:
    rows = _vectors(spark, d)
    return cells.VectorIndex.build(spark, "embeddings", rows, store.version_of(rows), rows_per_cell=100)


_NEAREST = f"SELECT vec_id AS id, round({C._COS.format(a='embedding', b='q')}, 6) AS similarity, '{{}}' AS tier FROM embeddings, (SELECT arg_min(embedding, vec_id) AS q FROM embeddings) ORDER BY {C._COS.format(a='embedding', b='q')} DESC, vec_id LIMIT 10"


def _labelled(found: cells.Nearest):
    return found.rows.select("id", F.round("similarity", 6).alias("similarity"), F.lit(found.tier).alias("tier"))


@_query(_NEAREST.format("knn"))
def knn_tiered(spark, d):
    rows = _vectors(spark, d)
    return _labelled(cells.search(vector_index(spark, d), rows, store.version_of(rows), C.first_vector(spark, d), 10))


@_query(_NEAREST.format("bruteforce"))
def knn_stale_index(spark, d):
    """An index of another version of the vectors is passed over."""
    return _labelled(cells.search(vector_index(spark, d), _vectors(spark, d), "another version", C.first_vector(spark, d), 10))
