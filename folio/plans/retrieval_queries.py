"""Registered queries of the index and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import plugs
from folio.functions.text import l2_normalize, token_count
from folio.operators import index as I
from folio.operators import retrieval as R
from folio.sources.fixtures import fixture, oracle, table
from folio.sources.gates import parse_roles
from folio.sources.shared import new_folder


def _chunks(s, d):
    return fixture(s, d, "fx_doc").select(F.col("doc_id").alias("point_id"), "tenant_id", parse_roles("roles_csv").alias("accessed_role"), "content")


def _vectors(s, d):
    return fixture(s, d, "fx_vec").select(F.col("vec_id").alias("point_id"), "tenant_id", parse_roles("roles_csv").alias("accessed_role"), F.col("embedding").alias("vector"))


def _asked(s, d):
    """Every vector whose id is divisible by 100 asks, in role 2."""
    return _vectors(s, d).where("point_id % 100 = 0").select(F.col("point_id").alias("qid"), "tenant_id", F.lit(2).alias("role_id"), "vector")


def _index(s, d):
    return I.as_chunks(fixture(s, d, "fx_doc")).select("chunk_id", "tenant_id", "src_file", "doc_id", "token_count", F.lit(1).alias("version"))


def _upsert(s, d):
    held = _index(s, d)
    new = held.where("doc_id % 5 = 0").withColumn("token_count", F.lit(0)).withColumn("version", F.lit(2))
    return I.upsert(held.where("doc_id % 3 > 0"), new.unionByName(new.withColumn("version", F.lit(3)))).select("chunk_id", "doc_id", "token_count", "version")


def _rrf(s, d):
    a, b = (table(s, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("point_id"), F.row_number().over(R.Window.partitionBy("user_id").orderBy(*o)).alias("rank")).where("rank <= 40") for o in ((F.desc("value"), "event_id"), (F.desc("ts"), "event_id")))
    return R.rrf([a, b], 20)


def _rerank(s, d):
    pairs = table(s, d, "conversations").alias("a").join(table(s, d, "conversations").alias("b"), F.expr("a.conv_id = b.conv_id and a.turn = 0 and b.turn > 0"))
    hits = pairs.select(F.col("a.conv_id").alias("qid"), F.col("b.turn").alias("point_id"), F.col("b.turn").alias("rank"), F.col("a.text").alias("question"), F.col("b.text").alias("content"))
    return R.rerank(hits, top=3)


def _layout(s, d):
    path = new_folder(s, "index")
    I.write_index(fixture(s, d, "fx_doc").select("tenant_id", "src_file", "doc_id", "n_chars"), path)
    return s.read.parquet(path).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def _vectorized(s, d):
    def load():
        import numpy as np

        return lambda texts: np.array([[len(t), t.count("e"), t.count(" ")] for t in texts])

    return plugs.vectorize(table(s, d, "documents").select("doc_id", "text"), load).select("doc_id", F.col("vector").cast("array<long>").alias("vector"))


def _paired(s, d):
    def load():
        return lambda a, b: [len(set(x) & set(y)) for x, y in zip(a, b, strict=True)]

    rows = table(s, d, "conversations").select("conv_id", "turn", "role", "text")
    return plugs.score_pairs(rows, load, "role", "text").select("conv_id", "turn", "score")


QUERIES = {
    "b4_token_count": lambda s, d: fixture(s, d, "fx_doc").select("doc_id", token_count("content").alias("tokens")),
    "b10_chunk_id": lambda s, d: _index(s, d).select("doc_id", "chunk_id"),
    "d1_upsert_chunks": _upsert,
    "d2_delete_document": lambda s, d: I.delete_documents(_index(s, d), _index(s, d).where("doc_id % 4 = 1")).select("chunk_id", "doc_id"),
    "d3_acl_filter": lambda s, d: R.acl_join(fixture(s, d, "fx_q"), _chunks(s, d)).select("qid", "point_id"),
    "d4_dense_topk": lambda s, d: R.dense_topk(_asked(s, d), _vectors(s, d), 40),
    "d5_sparse_encode": lambda s, d: R.sparse_encode(table(s, d, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6)),
    "d6_sparse_topk": lambda s, d: R.sparse_topk(fixture(s, d, "fx_q"), _chunks(s, d), 40),
    "d7_rrf_fuse": _rrf,
    "d8_rerank": _rerank,
    "d9_hybrid_search": lambda s, d: R.hybrid_search(fixture(s, d, "fx_q"), _chunks(s, d)),
    "d10_l2_normalize": lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode(l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3))).alias("place", "value")).withColumn("value", F.round("value", 9)),
    "d11_tenant_layout": _layout,
    "d12_approx_topk": lambda s, d: R.approx_topk(_asked(s, d), _vectors(s, d), 10),
    "d12_exact_lists": lambda s, d: R.approx_topk(_asked(s, d), _vectors(s, d), 40, reach=1.0),
    "m1_vectorize": _vectorized,
    "m2_score_pairs": _paired,
}

_TERMS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_QT = f"select qid, term, ln(1 + count(*)) as w from (select qid, unnest({_TERMS.format('question')}) as term from fx_q) group by all"
_DT = f"select doc_id, term, ln(1 + count(*)) as w from (select doc_id, unnest({_TERMS.format('content')}) as term from fx_doc) group by all"
_MAY = "list_contains(list_transform(string_split(d.roles_csv, ','), lambda x: trim(x)::int), q.role_id)"
_SPARSE = f"""select *, row_number() over (partition by qid order by score desc, point_id)::int as rank from (
  select q.qid, d.doc_id as point_id, round(sum(x.w * y.w), 6) as score from ({_QT}) x join ({_DT}) y on x.term = y.term
  join fx_q q on q.qid = x.qid join fx_doc d on d.doc_id = y.doc_id and d.tenant_id = q.tenant_id where {_MAY} group by all) qualify rank <= 40"""
_VEC = "select {0}, ('0x' || substr(md5(term), 1, 8))::bigint % 64 as a, sum(w) as w from ({1}) group by all"
_NORM = "select *, w / sqrt(sum(w * w) over (partition by {0})) as u from ({1})"
_DENSE = f"""select *, row_number() over (partition by qid order by score desc, point_id)::int as rank from (
  select q.qid, d.doc_id as point_id, round(coalesce(sum(x.u * y.u), 0), 6) as score
  from fx_q q join fx_doc d on d.tenant_id = q.tenant_id
  join ({_NORM.format('qid', _VEC.format('qid', _QT))}) x on x.qid = q.qid left join ({_NORM.format('doc_id', _VEC.format('doc_id', _DT))}) y on y.doc_id = d.doc_id and y.a = x.a
  where {_MAY} group by all) qualify rank <= 40"""
_RRF = """select *, row_number() over (partition by qid order by score desc, point_id)::int as rank from (
  select qid, point_id, round(sum(1 / (60.0::double + rank)), 9) as score from ({0}) group by all) qualify rank <= 20"""
_SHARE = f"round(coalesce(len(list_intersect(list_distinct({_TERMS.format('question')}), {_TERMS.format('content')})) / nullif(len(list_distinct({_TERMS.format('question')})), 0), 0), 6)"
_CHUNK = "regexp_replace(md5(tenant_id || '_' || src_file || '_0'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"
_TOKENS = "greatest(1, floor((length(content) + 2) / 3)::int)"

ORACLES = {
    "b4_token_count": oracle(f"select doc_id, {_TOKENS} as tokens from fx_doc", "fx_doc"),
    "b10_chunk_id": oracle(f"select doc_id, {_CHUNK} as chunk_id from fx_doc", "fx_doc"),
    "d1_upsert_chunks": oracle(f"select {_CHUNK} as chunk_id, doc_id, case when doc_id % 5 = 0 then 0 else {_TOKENS} end as token_count, case when doc_id % 5 = 0 then 3 else 1 end as version from fx_doc where doc_id % 3 > 0 or doc_id % 5 = 0", "fx_doc"),
    "d2_delete_document": oracle(f"select {_CHUNK} as chunk_id, doc_id from fx_doc where doc_id % 4 <> 1", "fx_doc"),
    "d3_acl_filter": oracle(f"select q.qid, d.doc_id as point_id from fx_q q join fx_doc d on d.tenant_id = q.tenant_id and {_MAY}", "fx_q", "fx_doc"),
    "d4_dense_topk": oracle(
        """select *, row_number() over (partition by qid order by score desc, point_id)::int as rank from (
        select q.vec_id as qid, d.vec_id as point_id, round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda x: x[1]::double * x[2]::double))
          / sqrt(list_sum(list_transform(q.embedding, lambda x: x::double * x::double))) / sqrt(list_sum(list_transform(d.embedding, lambda x: x::double * x::double))), 6) as score
        from fx_vec q join fx_vec d on q.tenant_id = d.tenant_id where q.vec_id % 100 = 0 and d.roles_csv like '%2%') qualify rank <= 40""",
        "fx_vec",
    ),
    "d5_sparse_encode": f"select doc_id, term, round(ln(1 + count(*)), 6) as weight from (select doc_id, unnest({_TERMS.format('text')}) as term from documents) group by all",
    "d6_sparse_topk": oracle(_SPARSE, "fx_q", "fx_doc"),
    "d7_rrf_fuse": _RRF.format(
        "select user_id as qid, event_id as point_id, row_number() over (partition by user_id order by value desc, event_id) as rank from events qualify rank <= 40 union all select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id) as rank from events qualify rank <= 40"
    ),
    "d8_rerank": f"""select qid, point_id, score, row_number() over (partition by qid order by score desc, point_id)::int as rank from (
        select qid, point_id, {_SHARE} as score from (select a.conv_id as qid, b.turn as point_id, a.text as question, b.text as content from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = 0 and b.turn > 0) where content <> '') qualify rank <= 3""",
    "d9_hybrid_search": oracle(
        f"""with f as ({_RRF.format(f"select qid, point_id, rank from ({_DENSE}) union all select qid, point_id, rank from ({_SPARSE})")})
        select qid, point_id, score, row_number() over (partition by qid order by score desc, old)::int as rank from (
        select f.qid, f.point_id, f.rank as old, {_SHARE} as score from f join fx_q q on q.qid = f.qid join fx_doc d on d.doc_id = f.point_id where content <> '') qualify rank <= 5""",
        "fx_q", "fx_doc",
    ),
    "d10_l2_normalize": "select vec_id, (generate_subscripts(embedding, 1) - 1)::int as place, round(unnest(embedding)::double * 3 / sqrt(list_sum(list_transform(embedding, lambda y: y::double * 3 * y::double * 3))), 9) as value from embeddings",
    "m1_vectorize": "select doc_id, [length(text), length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, ' ', ''))] as vector from documents",
    "m2_score_pairs": "select conv_id, turn, len(list_intersect(list_distinct(string_split(role, '')), list_distinct(string_split(text, ''))))::double as score from conversations",
    "d11_tenant_layout": "select source as tenant_id, count(*) as n, sum(n_chars)::bigint as chars from documents group by source",
}
ORACLES["d12_exact_lists"] = ORACLES["d4_dense_topk"]
