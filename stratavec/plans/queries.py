"""Registered queries of the core and their SQL for a second engine.

Distances are rounded in the output only, never before ranking, and ties go to the smaller id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavec.functions import names, vectors
from stratavec.operators import badrows, changes, embed, search
from stratavec.session import ensure_checkpoint_dir, table
from stratavec.sources import oplog
from stratavec.sources.store import VectorStore

Query = Callable[[SparkSession, str], DataFrame]
QUERY_TEXT = "the harbour report and the railway"


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.round("distance", 6).alias("dist"))


def _embeddings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings")


def _similar_top10(s: SparkSession, d: str) -> DataFrame:
    return _rounded(search.similar(_embeddings(s, d), 7), "vec_id")


def _duplicates(t: float) -> Query:
    return lambda s, d: _rounded(search.duplicates(_embeddings(s, d), t), "i", "j")


def _knn_all(s: SparkSession, d: str) -> DataFrame:
    e = _embeddings(s, d)
    return search.nearest_all(e, e, 10).select("i", "j", F.round("distance", 6).alias("dist"), F.col("rk").cast("long").alias("rk"))


def _next_pairs(s: SparkSession, d: str) -> DataFrame:
    e = _embeddings(s, d)
    a, b = e.select(F.col("vec_id").alias("i"), F.col("embedding").alias("a")), e.select((F.col("vec_id") - 1).alias("i"), F.col("vec_id").alias("j"), F.col("embedding").alias("b"))
    return a.join(b, "i")


def _compare(s: SparkSession, d: str) -> DataFrame:
    out = search.compare(_next_pairs(s, d), "a", "b")
    return out.select("i", "j", "equal", F.round("distance", 6).alias("dist"))


def _compare_variant(s: SparkSession, d: str) -> DataFrame:
    p = _next_pairs(s, d)
    return p.select("i", "j", *(F.round(vectors.distance(F.col("a"), F.col("b"), v), 6).alias(v) for v in vectors.VARIANTS))


def _normalize_simd(s: SparkSession, d: str) -> DataFrame:
    unit = vectors.normalize(F.col("embedding"), "simd")
    return _embeddings(s, d).select("vec_id", F.posexplode(unit).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("component"))


def _made_vectors(s: SparkSession, d: str) -> DataFrame:
    """Shape and range of made vectors, one of each kind per stored vector."""
    made = _embeddings(s, d).select("vec_id", vectors.empty_embedding(64).alias("zero"), vectors.random_embedding(64).alias("drawn"), vectors.random_normalized_embedding(64, 7).alias("unit"))
    size = lambda c: F.size(c).cast("long")
    inside = (F.array_min("drawn") >= 0) & (F.array_max("drawn") < 1) & (F.array_max("drawn") > F.array_min("drawn"))
    return made.select("vec_id", size("zero").alias("n_zero"), F.aggregate("zero", F.lit(0.0), lambda a, x: a + F.abs(x)).alias("weight"), size("drawn").alias("n_drawn"), inside.alias("in_range"), F.round(vectors.norm(F.col("unit")), 4).alias("norm"))


def _cosine(s: SparkSession, d: str) -> DataFrame:
    return _next_pairs(s, d).select("i", "j", F.round(vectors.cosine_distance(F.col("a"), F.col("b")), 6).alias("dist"))


def _normalize(s: SparkSession, d: str) -> DataFrame:
    return _embeddings(s, d).select("vec_id", F.posexplode(vectors.normalize(F.col("embedding"))).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("component"))


def _pad_trim(s: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    out = _embeddings(s, d).select("vec_id", vectors.pad_trim(e, 60).alias("cut"), vectors.pad_trim(e, 70).alias("filled"))
    return out.select("vec_id", F.size("cut").cast("long").alias("n_cut"), F.size("filled").cast("long").alias("n_filled"), F.element_at("cut", 60).cast("double").alias("last_cut"), F.element_at("filled", 64).cast("double").alias("last_own"), F.element_at("filled", 70).cast("double").alias("last_filled"))


def _analogy(s: SparkSession, d: str) -> DataFrame:
    rows = _embeddings(s, d).filter(F.col("vec_id").isin(1, 2, 3, 4)).groupBy().agg(*(F.max(F.when(F.col("vec_id") == k, F.col("embedding"))).alias(f"v{k}") for k in (1, 2, 3, 4)))
    target = vectors.analogy(F.col("v1"), F.col("v2"), F.col("v3"))
    return rows.select(F.round(vectors.distance(F.col("v4"), target), 6).alias("dist"))


def _centroids(s: SparkSession, d: str) -> DataFrame:
    long = _embeddings(s, d).select("label", F.posexplode("embedding").alias("pos", "x"))
    return long.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def _index_name(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    domain = F.concat(F.lit("docs/"), F.coalesce("source", F.lit("no source")), F.lit(" *~"))
    named = docs.select("doc_id", domain.alias("domain"), names.index_name(domain, F.col("doc_id").cast("string")).alias("name"))
    back = names.parse_index_name(F.col("name"))
    return named.select("doc_id", "name", (back["domain"] == F.col("domain")).alias("same_domain"), back["commit"].alias("commit"))


def _truncate(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    tokens = names.whitespace_tokens(F.col("text"))
    return docs.select("doc_id", F.size(names.truncate_tokens(tokens, 100)).cast("long").alias("n_kept"), F.size(tokens).cast("long").alias("n_tokens"), F.array_join(names.truncate_tokens(tokens, 3), " ").alias("first"))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return changes.chunks(table(s, d, "events"), "event_id")


def _event_ops(s: SparkSession, d: str) -> DataFrame:
    """The events as a change stream: signups insert, purchases change, errors delete, the rest are errors."""
    kind = F.col("event_type")
    op = F.when(kind == "signup", "Inserted").when(kind == "purchase", "Changed").when(kind == "error", "Deleted").otherwise("Error")
    return table(s, d, "events").select(op.alias("op"), F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "props")


def _oplog_latest(s: SparkSession, d: str) -> DataFrame:
    return changes.latest(_event_ops(s, d)).select("id", "op", "seq")


def _incremental(s: SparkSession, d: str) -> DataFrame:
    ops = _event_ops(s, d)
    empty = ops.select("id", "seq").limit(0)
    base = changes.apply_changes(empty, ops.filter("seq < 5000"))
    return changes.apply_changes(base, ops.filter("seq >= 5000"))


def _delete_then_search(s: SparkSession, d: str) -> DataFrame:
    """Every third vector is deleted; the nearest of the rest to vector 7 remain."""
    e = _embeddings(s, d)
    ops = e.filter("vec_id % 3 = 0").select(F.lit("Deleted").alias("op"), F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"))
    live = changes.apply_changes(e.select(F.col("vec_id").alias("id"), F.lit(-1).cast("long").alias("seq")), ops).select(F.col("id").alias("vec_id"))
    return _rounded(search.similar(e.join(live, "vec_id"), 7, order="vec_id"), "vec_id")


def _operations_latest(s: SparkSession, d: str) -> DataFrame:
    ops = changes.validated(table(s, d, "operations").select("op", "id", "string", "message", "seq", "domain"), strict=False)
    return changes.latest(ops).select("id", "op", "seq", "domain")


def _op_problems(s: SparkSession, d: str) -> DataFrame:
    ops = table(s, d, "operations").dropDuplicates(["seq"])
    return ops.withColumn("problem", changes.problem()).filter("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def _hash_counts(docs: DataFrame) -> DataFrame:
    token = F.explode(names.whitespace_tokens(F.col("text"))).alias("token")
    return docs.select("doc_id", token).groupBy("doc_id", embed.hash_position(F.col("token")).cast("long").alias("pos")).agg(F.count(F.lit(1)).alias("n"))


def _search_text(s: SparkSession, d: str) -> DataFrame:
    docs = embed.embed(table(s, d, "documents").select("doc_id", "text"), "text")
    return _rounded(search.nearest(docs, embed.HashingEmbedder().one(QUERY_TEXT), 10, "doc_id"), "doc_id")


_stores: dict[tuple[str, str], VectorStore] = {}
FIRST = 500  # events of the first commit of the store that the queries read


def _string_ops(s: SparkSession, d: str) -> DataFrame:
    return _event_ops(s, d).select("op", F.col("id").cast("string").alias("id"), F.col("props").alias("string"), F.lit("failed").alias("message"), "seq")


def _store(s: SparkSession, d: str) -> VectorStore:
    """A store in the session's shared folder with the events as commits c1 and, on top of it, c2; built once a session."""
    known = (s.sparkContext.applicationId, d)
    if known not in _stores:
        store = VectorStore(s, f"{ensure_checkpoint_dir(s)}/stores/{uuid.uuid4().hex}")
        ops = _string_ops(s, d)
        store.build("events", "c1", ops.filter(F.col("seq") < FIRST))
        store.build("events", "c2", ops.filter(F.col("seq") >= FIRST), "c1")
        _stores[known] = store
    return _stores[known]


def _store_assign(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, d)
    store.assign("events", "c2", "live")
    return store.manifest("events", "live")


def _store_read_back(s: SparkSession, d: str) -> DataFrame:
    """The index of a commit with its vectors, their length and the sum of their components."""
    e = F.col("embedding")
    total = F.aggregate(vectors.as_double(e), F.lit(0.0), lambda a, x: a + x)
    return _store(s, d).cached("events", "c2").select("id", "vec_id", F.size(e).cast("long").alias("dim"), F.round(vectors.norm(e), 4).alias("norm"), F.round(total, 3).alias("total"))


def _store_statistics(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, d)
    return store.lineage().select("commit", "previous", "n_docs", "status").crossJoin(store.statistics("events").select("n_vectors", "last_id")).filter(F.col("commit").isin("c1", "c2"))


def _store_task(s: SparkSession, d: str) -> DataFrame:
    """Two starts of one build in the background: the second gets the task of the first while that runs; then its status."""
    store = _store(s, d)
    ops = _string_ops(s, d).filter(F.col("seq") < FIRST)
    task, same = store.start("events", "task", ops), store.start("events", "task", ops)
    done = store.wait(task)
    return s.createDataFrame([(done["status"], done.get("indexed_documents"), len(task), task == same)], "status string, indexed_documents long, n_letters long, same_task boolean")


def _store_pages(s: SparkSession, d: str) -> DataFrame:
    """A small domain filled one by one and by many, read by page and by id."""
    store = VectorStore(s, f"{ensure_checkpoint_dir(s)}/stores/{uuid.uuid4().hex}")
    one = store.add_and_load("few", [[1.0, 0.0]])
    many = store.add_and_load("few", [[0.0, 1.0], [0.5, 0.5]])
    rows = one.withColumn("what", F.lit("one")).union(many.withColumn("what", F.lit("many"))).union(store.page("few", 1).withColumn("what", F.lit("page")))
    single = s.createDataFrame([(1, store.vector("few", 1), "single"), (9, store.vector("few", 9), "single")], "vec_id long, embedding array<float>, what string")
    return rows.union(single).select("what", "vec_id", F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))


def _read_json_lines(s: SparkSession, d: str) -> DataFrame:
    """The operations written as JSON lines and read again, numbered anew in the order of the files."""
    path = f"{ensure_checkpoint_dir(s)}/lines/{uuid.uuid4().hex}"
    ops = _string_ops(s, d)
    kept = {"op": F.col("op"), "id": F.when(F.col("op") != "Error", F.col("id")), "string": F.when(F.col("op").isin("Inserted", "Changed"), F.col("string")), "message": F.when(F.col("op") == "Error", F.col("message"))}
    ops.repartitionByRange(4, "seq").sortWithinPartitions("seq").select(*(c.alias(n) for n, c in kept.items())).write.json(path)
    return oplog.read_operations(s, path).select("seq", "op", "id", "string", "message")


def _unpack(s: SparkSession, d: str) -> DataFrame:
    packed = oplog.pack_vectors(_embeddings(s, d), 300)
    back = oplog.unpack_vectors(packed, dim=64, first="first")
    return back.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 6).alias("component"))


def _similar_json(s: SparkSession, d: str) -> DataFrame:
    return search.results_json(_rounded(search.similar(_embeddings(s, d), 7), "vec_id").select(F.col("vec_id").alias("id"), F.col("dist").alias("distance")))


def _op_rates(s: SparkSession, d: str) -> DataFrame:
    ops = table(s, d, "operations").dropDuplicates(["seq"]).filter("received_at is not null")
    return ops.groupBy(F.date_trunc("day", F.col("received_at")).cast("date").alias("day"), "op").agg(F.count(F.lit(1)).alias("n"))


def _usable(s: SparkSession, d: str) -> DataFrame:
    """Vectors of the store by the length of their embedding and whether their norm is 1."""
    e = F.col("embedding")
    data = table(s, d, "embedding_data").select("vec_id", e).dropDuplicates(["vec_id"])
    return data.groupBy(F.coalesce(F.size(e), F.lit(-1)).cast("long").alias("dim"), F.coalesce(F.abs(vectors.norm(e) - 1) < 1e-3, F.lit(False)).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Query] = {
    "similar_top10": _similar_top10,
    "duplicates_t030": _duplicates(0.3),
    "duplicates_default": _duplicates(0.0),
    "knn_all_top10": _knn_all,
    "all_pairs_within_030": lambda s, d: _rounded(search.all_pairs_within(_embeddings(s, d), 0.3), "i", "j"),
    "compare": _compare,
    "compare_variant": _compare_variant,
    "cosine_distance": _cosine,
    "normalize": _normalize,
    "pad_trim": _pad_trim,
    "analogy": _analogy,
    "centroids": _centroids,
    "index_name": _index_name,
    "truncate_tokens": _truncate,
    "chunk_counts": _chunks,
    "oplog_latest": _oplog_latest,
    "incremental_index": _incremental,
    "delete_then_search": _delete_then_search,
    "operations_latest": _operations_latest,
    "operation_problems": _op_problems,
    "hash_embed": lambda s, d: _hash_counts(table(s, d, "documents")),
    "search_text": _search_text,
    "normalize_simd": _normalize_simd,
    "made_vectors": _made_vectors,
    "similar_json": _similar_json,
    "store_build": lambda s, d: _store(s, d).manifest("events", "c1"),
    "store_incremental": lambda s, d: _store(s, d).manifest("events", "c2"),
    "store_assign": _store_assign,
    "store_read_back": _store_read_back,
    "store_statistics": _store_statistics,
    "store_task": _store_task,
    "store_pages": _store_pages,
    "read_json_lines": _read_json_lines,
    "unpack_vectors": _unpack,
    "operation_rates": _op_rates,
    "vector_shapes": _usable,
    "p6_found": lambda s, d: badrows.rejected_offsets(table(s, d, "op_lines")),
    "p6_rejects": lambda s, d: badrows.rejects(table(s, d, "op_lines")),
    "p6_operations": lambda s, d: badrows.strict_load(table(s, d, "op_lines")),
}


def _dist(a: str, b: str) -> str:
    return f"least(1.0::double, greatest(0.0::double, (list_dot_product({a}::double[], {b}::double[]) - 1.0::double) / -2.0::double))"


_EVENT_OPS = "ops AS (SELECT CASE event_type WHEN 'signup' THEN 'Inserted' WHEN 'purchase' THEN 'Changed' WHEN 'error' THEN 'Deleted' ELSE 'Error' END AS op, user_id AS id, event_id AS seq FROM events)"
_PAIRS = f"p AS (SELECT a.vec_id AS i, b.vec_id AS j, {_dist('a.embedding', 'b.embedding')} AS d FROM embeddings a CROSS JOIN embeddings b)"
_NEXT = "p AS (SELECT a.vec_id AS i, b.vec_id AS j, a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_TOKENS = r"list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
_HASH = "(('0x' || substr(md5(token), 1, 8))::BIGINT % 64)"


def _duplicates_sql(t: float) -> str:
    return f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk FROM p),
h AS (SELECT * FROM r WHERE rk <= 2 AND d < {t}::double AND i < j), l AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY rk DESC) AS z FROM h)
SELECT i, j, round(d, 6) AS dist FROM l WHERE z = 1"""


_OP_NAME = "CASE WHEN op = 'Replaced' THEN 'Changed' ELSE op END"
_SIMILAR = "SELECT b.vec_id, round({d}, 6) AS dist FROM {base} b, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) ORDER BY {d}, b.vec_id LIMIT 10"

ORACLE_SQL: dict[str, str] = {
    "similar_top10": _SIMILAR.format(d=_dist("b.embedding", "q"), base="embeddings"),
    "duplicates_t030": _duplicates_sql(0.3),
    "duplicates_default": _duplicates_sql(0.0),
    "knn_all_top10": f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk FROM p) SELECT i, j, round(d, 6) AS dist, rk FROM r WHERE rk <= 10",
    "all_pairs_within_030": f"WITH {_PAIRS} SELECT i, j, round(d, 6) AS dist FROM p WHERE i < j AND d < 0.3::double",
    "compare": f"WITH {_NEXT} SELECT i, j, a = b AS equal, round({_dist('a', 'b')}, 6) AS dist FROM p",
    "compare_variant": f'WITH {_NEXT}, q AS (SELECT i, j, round({_dist("a", "b")}, 6) AS x FROM p) SELECT i, j, x AS "default", x AS simd, x AS scalar FROM q',
    "cosine_distance": f"WITH {_NEXT} SELECT i, j, round(least(1.0::double, greatest(0.0::double, (1.0::double - list_cosine_similarity(a::double[], b::double[])) / 2.0::double)), 6) AS dist FROM p",
    "normalize": "WITH n AS (SELECT vec_id, embedding::double[] AS v, sqrt(list_dot_product(embedding::double[], embedding::double[])) AS l FROM embeddings), u AS (SELECT vec_id, unnest(range(0, len(v))) AS pos, unnest(v) AS x, l FROM n) SELECT vec_id, pos, round(x / l, 6) AS component FROM u",
    "pad_trim": "SELECT vec_id, 60::BIGINT AS n_cut, 70::BIGINT AS n_filled, embedding[60]::double AS last_cut, embedding[64]::double AS last_own, 0.0::double AS last_filled FROM embeddings",
    "analogy": f"WITH v AS (SELECT max(CASE WHEN vec_id = 1 THEN embedding::double[] END) AS a, max(CASE WHEN vec_id = 2 THEN embedding::double[] END) AS b, max(CASE WHEN vec_id = 3 THEN embedding::double[] END) AS c, max(CASE WHEN vec_id = 4 THEN embedding::double[] END) AS e FROM embeddings WHERE vec_id IN (1, 2, 3, 4)), t AS (SELECT e, list_transform(range(1, len(a) + 1), lambda k: a[k] - b[k] + c[k]) AS q FROM v) SELECT round({_dist('e', 'q')}, 6) AS dist FROM t",
    "centroids": "WITH u AS (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::double AS x FROM embeddings) SELECT label, pos, round(avg(x), 6) AS mean FROM u GROUP BY label, pos",
    "index_name": "SELECT doc_id, url_encode('docs/' || coalesce(source, 'no source') || ' *~') || '@' || doc_id AS name, TRUE AS same_domain, doc_id::VARCHAR AS commit FROM documents",
    "truncate_tokens": f"WITH t AS (SELECT doc_id, {_TOKENS} AS k, text FROM documents) SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE least(len(k), 100) END AS n_kept, len(k) AS n_tokens, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(k[1:3], ' '), '') END AS first FROM t",
    "chunk_counts": "SELECT event_id // 100 AS chunk, count(*) AS n FROM events GROUP BY 1",
    "oplog_latest": f"WITH {_EVENT_OPS} SELECT id, arg_max(op, seq) AS op, max(seq) AS seq FROM ops WHERE op <> 'Error' AND id IS NOT NULL GROUP BY id",
    "incremental_index": f"WITH {_EVENT_OPS}, l AS (SELECT id, arg_max(op, seq) AS op, max(seq) AS seq FROM ops WHERE op <> 'Error' AND id IS NOT NULL GROUP BY id) SELECT id, seq FROM l WHERE op <> 'Deleted'",
    "delete_then_search": None,
    "operations_latest": f"WITH o AS (SELECT {_OP_NAME} AS op, id, string, message, seq, domain FROM operations), v AS (SELECT * FROM o WHERE id IS NOT NULL AND (op = 'Deleted' OR (op IN ('Inserted', 'Changed') AND string IS NOT NULL))) SELECT id, arg_max(op, seq) AS op, max(seq) AS seq, arg_max(domain, seq) AS domain FROM v GROUP BY id",
    "operation_problems": f"WITH o AS (SELECT DISTINCT seq, op AS raw, {_OP_NAME} AS op, id, string, message FROM operations), w AS (SELECT CASE WHEN op IS NULL OR op NOT IN ('Inserted', 'Changed', 'Deleted', 'Error') THEN 'unknown operation: ' || coalesce(raw, 'null') WHEN op IN ('Inserted', 'Changed', 'Deleted') AND id IS NULL THEN 'operation without id' WHEN op IN ('Inserted', 'Changed') AND string IS NULL THEN 'operation without string' WHEN op = 'Error' AND message IS NULL THEN 'error without message' END AS problem FROM o) SELECT problem, count(*) AS n FROM w WHERE problem IS NOT NULL GROUP BY problem",
    "hash_embed": f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) SELECT doc_id, {_HASH} AS pos, count(*) AS n FROM t GROUP BY 1, 2",
    "made_vectors": "SELECT vec_id, 64::BIGINT AS n_zero, 0.0::double AS weight, 64::BIGINT AS n_drawn, TRUE AS in_range, 1.0::double AS norm FROM embeddings",
    "vector_shapes": "WITH o AS (SELECT vec_id, any_value(embedding::double[]) AS e, any_value(embedding IS NULL) AS missing FROM embedding_data GROUP BY vec_id), n AS (SELECT coalesce(len(e), -1) AS dim, CASE WHEN e IS NULL OR len(list_filter(e, lambda x: x IS NULL)) > 0 THEN NULL ELSE sqrt(list_sum(list_transform(e, lambda x: x * x))) END AS l, len(e) AS k FROM o) SELECT dim, coalesce(abs(CASE WHEN k = 0 THEN 0 ELSE l END - 1) < 1e-3, FALSE) AS unit, count(*) AS n FROM n GROUP BY 1, 2",
    "operation_rates": "WITH o AS (SELECT DISTINCT seq, op, received_at FROM operations WHERE received_at IS NOT NULL) SELECT received_at::DATE AS day, op, count(*) AS n FROM o GROUP BY 1, 2",
}
ORACLE_SQL["delete_then_search"] = "WITH live AS (SELECT * FROM embeddings WHERE vec_id % 3 <> 0) " + _SIMILAR.format(d=_dist("b.embedding", "q"), base="live")
_STORE = f"""WITH ops AS (SELECT CASE event_type WHEN 'signup' THEN 'Inserted' WHEN 'purchase' THEN 'Changed' WHEN 'error' THEN 'Deleted' ELSE 'Error' END AS op, user_id::VARCHAR AS id, props AS text, event_id AS seq FROM events),
live AS (SELECT * FROM ops WHERE op <> 'Error' AND id IS NOT NULL),
last AS (SELECT seq < {FIRST} AS early, id, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(text, seq) AS text FROM live GROUP BY 1, 2),
full_ AS (SELECT *, {_TOKENS} AS tokens FROM last WHERE op <> 'Deleted'),
placed AS (SELECT early, id, tokens, row_number() OVER (ORDER BY early DESC, seq) - 1 AS vec_id FROM full_ WHERE len(tokens) > 0),
c1 AS (SELECT id, vec_id, tokens FROM placed WHERE early),
c2 AS (SELECT id, vec_id, tokens FROM c1 WHERE id NOT IN (SELECT id FROM last WHERE NOT early) UNION ALL SELECT id, vec_id, tokens FROM placed WHERE NOT early)
"""
ORACLE_SQL |= {
    "normalize_simd": ORACLE_SQL["normalize"],
    "similar_json": "WITH s AS (" + ORACLE_SQL["similar_top10"] + ") SELECT to_json({'id': vec_id, 'distance': dist})::VARCHAR AS value FROM s",
    "store_build": _STORE + "SELECT id, vec_id FROM c1",
    "store_incremental": _STORE + "SELECT id, vec_id FROM c2",
    "store_assign": _STORE + "SELECT id, vec_id FROM c2",
    "store_read_back": _STORE + f", t AS (SELECT id, vec_id, unnest(tokens) AS token FROM c2), n AS (SELECT id, vec_id, {_HASH} AS pos, count(*) AS n FROM t GROUP BY 1, 2, 3) SELECT id, vec_id, 64::BIGINT AS dim, 1.0::double AS norm, round(sum(n) / sqrt(sum(n * n)), 3) AS total FROM n GROUP BY 1, 2",
    "store_statistics": _STORE + "SELECT 'c1' AS commit, NULL::VARCHAR AS previous, (SELECT count(*) FROM c1) AS n_docs, 'Complete' AS status, (SELECT count(*) FROM placed) AS n_vectors, (SELECT max(vec_id) FROM placed) AS last_id UNION ALL SELECT 'c2', 'c1', (SELECT count(*) FROM c2), 'Complete', (SELECT count(*) FROM placed), (SELECT max(vec_id) FROM placed)",
    "store_task": _STORE + "SELECT 'Complete' AS status, count(*) AS indexed_documents, 8::BIGINT AS n_letters, TRUE AS same_task FROM c1",
    "store_pages": "SELECT * FROM (VALUES ('one', 0::BIGINT, 1.0::double, 0.0::double), ('many', 1, 0.0, 1.0), ('many', 2, 0.5, 0.5), ('page', 2, 0.5, 0.5), ('single', 1, 0.0, 1.0), ('single', 9, NULL, NULL)) t(what, vec_id, x, y)",
    "read_json_lines": "WITH o AS (SELECT *, CASE event_type WHEN 'signup' THEN 'Inserted' WHEN 'purchase' THEN 'Changed' WHEN 'error' THEN 'Deleted' ELSE 'Error' END AS op FROM events) SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, op, CASE WHEN op <> 'Error' THEN user_id::VARCHAR END AS id, CASE WHEN op IN ('Inserted', 'Changed') THEN props END AS string, CASE WHEN op = 'Error' THEN 'failed' END AS message FROM o",
    "unpack_vectors": "WITH u AS (SELECT vec_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings) SELECT vec_id, pos, round(x::double, 6) AS component FROM u",
}
_SEARCH = f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents), c AS (SELECT doc_id, {_HASH} AS pos, count(*) AS n FROM t GROUP BY 1, 2),
q AS (SELECT {_HASH} AS pos, count(*) AS n FROM (SELECT unnest(string_split('{QUERY_TEXT}', ' ')) AS token) GROUP BY 1),
nd AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM c GROUP BY 1), nq AS (SELECT sqrt(sum(n * n)) AS l FROM q),
s AS (SELECT c.doc_id, sum((c.n / nd.l)::FLOAT::DOUBLE * (q.n / nq.l)::FLOAT::DOUBLE) AS dot FROM c JOIN nd USING (doc_id) JOIN q USING (pos) CROSS JOIN nq GROUP BY 1),
d AS (SELECT nd.doc_id, least(1.0::double, greatest(0.0::double, (coalesce(s.dot, 0.0::double) - 1.0::double) / -2.0::double)) AS dist FROM nd LEFT JOIN s USING (doc_id))
SELECT doc_id, round(dist, 6) AS dist FROM d ORDER BY d.dist, doc_id LIMIT 10"""
ORACLE_SQL["search_text"] = _SEARCH
