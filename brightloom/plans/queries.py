"""Named queries over the given tables, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.functions import text as T
from brightloom.functions import vectors as V
from brightloom.operators import chunking, conversation, graph, meetings, retrieval, search, summary, tables
from brightloom.runtime import spread, table
from brightloom.sources import files
from brightloom.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- vectors

_KNN = """
with q as (select vec_id as query_id, embedding::double[] as qv, label as ql from embeddings where vec_id % 20 = 0),
s as (select query_id, vec_id, {score} as score from q join embeddings e on {on}),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, vec_id, round(score, 6) as score, cast(rank as integer) as rank from r where rank <= 10 {floor}
"""


def _queries(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label")
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(_KNN.format(score="round(list_cosine_similarity(embedding::double[], qv), 9)", on="true", floor=""))
def vec_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return _rounded(search.top_k(e, "vec_id", "embedding", _queries(e), 10))


@query(_KNN.format(score="round(1 / (1 + list_distance(embedding::double[], qv)), 9)", on="true", floor=""))
def vec_euclid_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return _rounded(search.top_k(e, "vec_id", "embedding", _queries(e), 10, "euclidean"))


@query(_KNN.format(score="round(list_inner_product(embedding::double[], qv), 9)", on="e.label = q.ql", floor="and score >= 0.3"))
def vec_dot_same_label_floor(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return _rounded(search.top_k(e, "vec_id", "embedding", _queries(e), 10, "dot", 0.3, same="label"))


@query("""select vec_id, len(embedding) as dims, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as norm,
          len(list_filter(embedding, lambda x: abs(x) > 1e-8)) = 0 as is_zero from embeddings""")
def vec_norms(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.size("embedding").cast("bigint").alias("dims"), F.round(V.norm(F.col("embedding")), 6).alias("norm"), V.is_zero(F.col("embedding")).alias("is_zero"))


@query("""select label, cast(pos as integer) as pos, round(avg(x), 6) as mean, count(*) as n from
          (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by all""")
def vec_label_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("""select label, to_hex(bit_xor(cast('0x' || substring(md5(cast(vec_id as varchar)), 1, 15) as bigint))) as set_id, count(*) as n from embeddings group by label""")
def vec_set_ids(spark: SparkSession, d: str) -> DataFrame:
    """An id of each label's set of vectors, from digests that are combined in any order."""
    each = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 15), 16, 10).cast("bigint")
    return table(spark, d, "embeddings").groupBy("label").agg(F.hex(F.bit_xor(each)).alias("set_id"), F.count(F.lit(1)).alias("n"))


@query("""with k as (select *, md5(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) as h from rerank_candidates),
          r as (select *, row_number() over (partition by h order by coalesce(original_score, '-inf'::double) desc, cand_id) as rn from k)
          select cand_id, original_score from r where rn = 1""")
def hits_dedup_best(spark: SparkSession, d: str) -> DataFrame:
    return search.dedup_hits(table(spark, d, "rerank_candidates").select("cand_id", "content", "original_score"), "content", "original_score", "cand_id").select("cand_id", "original_score")


@query("""with v as (select chunk_id, metadata.kb_id as namespace, row_number() over (partition by chunk_id order by text) as rn from vector_records)
          select namespace, count(*) as n_vectors from v where rn = 1 group by all""")
def vec_collections(spark: SparkSession, d: str) -> DataFrame:
    """Vectors per collection, each chunk once."""
    v = table(spark, d, "vector_records").select("chunk_id", F.col("metadata.kb_id").alias("namespace")).dropDuplicates(["chunk_id"])
    return v.groupBy("namespace").agg(F.count(F.lit(1)).alias("n_vectors"))


# ---------------------------------------------------------------- documents


@query("""select doc_id, length(text) as char_count, strlen(text) as byte_count,
          length(text) - length(replace(text, chr(10), '')) + case when length(text) > 0 and not ends_with(text, chr(10)) then 1 else 0 end as line_count
          from documents""")
def doc_metadata(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.length(t).cast("bigint").alias("char_count"), F.octet_length(t).cast("bigint").alias("byte_count"), T.line_count(t).cast("bigint").alias("line_count")
    )


_FIXED = """select doc_id, cast(i as integer) as chunk_index, substring(text, cast(i * 450 + 1 as bigint), 500) as chunk from
  (select doc_id, text, unnest(range(0, case when length(text) <= 500 then 1 else cast(ceil((length(text) - 500) / 450.0) as bigint) + 1 end)) as i
   from documents where length(text) > 0)"""


@query(f"select doc_id, chunk_index, chunk_index * 450 as start_pos, length(chunk) as n_chars, md5(chunk) as digest from ({_FIXED})")
def doc_fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.fixed_chunks(table(spark, d, "documents"), "doc_id", "text", 500, 50)
    return c.select("doc_id", "chunk_index", "start_pos", F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("digest"))


@query(f"""with c as (select doc_id, length(chunk) as n from ({_FIXED})),
  s as (select doc_id, count(*) as n_chunks, cast(sum(n) as bigint) as total_chars, min(n) as min_chars, max(n) as max_chars,
        round(avg(n), 1) as avg_chars, round(quantile_cont(n, 0.5), 1) as median_chars, list_sort(list(n)) as l from c group by doc_id)
  select doc_id, n_chunks, total_chars, min_chars, max_chars, avg_chars, median_chars,
         l[1 + least(cast(floor(n_chunks * 0.95::double) as bigint), n_chunks - 1)] as p95_chars from s""")
def doc_chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_stats(chunking.fixed_chunks(table(spark, d, "documents"), "doc_id", "text", 500, 50), "doc_id")


@query("""with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n\\s*\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0) as l from documents)
          select doc_id, cast(generate_subscripts(l, 1) - 1 as integer) as chunk_index, unnest(l) as chunk from p""")
def doc_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return chunking.paragraph_chunks(table(spark, d, "documents"), "doc_id", "text")


_SENTENCES = """select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？\\n]+[.!?。！？]*'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 3) as l from documents"""


@query(f"""with s as (select doc_id, cast(generate_subscripts(l, 1) - 1 as integer) as chunk_index, unnest(l) as chunk from ({_SENTENCES}))
  select *, substring(lag(chunk) over w, 1, 200) as context_prefix, substring(lead(chunk) over w, 1, 200) as context_suffix
  from s window w as (partition by doc_id order by chunk_index)""")
def doc_sentences_context(spark: SparkSession, d: str) -> DataFrame:
    return chunking.with_context(chunking.sentence_chunks(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query()
def doc_recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.recursive_chunks(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


_HAN = "length(regexp_replace({x}, '[^\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]', '', 'g'))"


@query(f"""with c as (select doc_id, text, {_HAN.format(x="text")} as han, len(regexp_extract_all(text, '[a-zA-Z]+')) as words,
   length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) as letters, length(regexp_replace(text, '[^ \\t\\n\\x0B\\f\\r]', '', 'g')) as blanks from documents)
   select doc_id, cast(floor(han * 1.5::double + words * 1.3::double + (length(text) - han - letters - blanks) * 0.5::double) as integer) as tokens,
   case when length(regexp_replace(text, '[\\s]', '', 'g')) = 0 then 'unknown'
        when han > length(regexp_replace(text, '[ \\n]', '', 'g')) * 0.3::double then 'zh'
        when length(regexp_replace(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'), '[^\\p{{L}}]', '', 'g')) = 0 then 'en' else 'unknown' end as language from c""")
def doc_tokens_language(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.token_estimate(t).alias("tokens"), T.language(t).alias("language"))


@query("""select doc_id, regexp_replace(translate(regexp_replace(text, '\\r\\n?', chr(10), 'g'),
            array_to_string(list_transform(range(0, 94), lambda i: chr(cast(65281 + i as integer))), '') || chr(12288),
            array_to_string(list_transform(range(0, 94), lambda i: chr(cast(33 + i as integer))), '') || ' '),
            '[\\x{200b}-\\x{200d}\\x{feff}\\x{ad}]', '', 'g') as text from documents""")
def doc_normalised(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalise(F.col("text")).alias("text"))


@query("""select md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as digest, min(doc_id) as first_id, count(*) as copies from documents group by 1""")
def doc_exact_copies(spark: SparkSession, d: str) -> DataFrame:
    return tables.group_copies(table(spark, d, "documents"), "text", "doc_id")


_SCORE = """with s as (select doc_id, len(l) as n, generate_subscripts(l, 1) - 1 as sentence_no, unnest(l) as sentence from ({sentences})),
 c as (select *, length(sentence) as size,
   3.0::double * len(list_filter([{words}], lambda w: contains(lower(sentence), w)))
   + case when regexp_matches(sentence, '[0-9]') then 2 else 0 end + case when regexp_matches(sentence, '[A-Z][a-z]+') then 1 else 0 end
   + case when length(sentence) between 20 and 200 then 1.5 when length(sentence) > 200 then 0.5 else 0 end
   + case when sentence_no = 0 then 2 else 0 end + case when sentence_no = n - 1 then 2 else 0 end
   + case when regexp_matches(sentence, '{fillers}') then -2 else 0 end as score from s),
 r as (select *, row_number() over (partition by doc_id order by score desc, sentence_no) as rn from c)
 select doc_id, cast(sentence_no as integer) as sentence_no, sentence, cast(score as double) as score from r where rn <= greatest(3, floor(n * 0.33::double))"""


@query(_SCORE.format(sentences=_SENTENCES, words=", ".join(f"'{w}'" for w in summary.IMPORTANT), fillers=summary.FILLERS))
def doc_heuristic_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.heuristic_summary(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


@query()
def doc_ranked_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.ranked_summary(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


@query("""select d.doc_id, t.title from documents d join (select distinct title from documents where length(title) > 0) t on contains(d.text, t.title)""")
def doc_contains_titles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return tables.contains_names(docs.select("doc_id", "text"), "text", docs.select("title"), "title").select("doc_id", "title")


@query("""with o as (select distinct on (doc_id) doc_id, content from kb_documents order by doc_id)
   select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '```[^\\n]*', '', 'g'),
     '\\[([^\\]\\n]*)\\]\\([^)\\n]*\\)', '\\1', 'g'), '(^|\\n)[ \\t]*(#{1,6}|[-*+]|[0-9]+\\.)[ \\t]+', '\\1', 'g'), '[*_`]', '', 'g'),
     '\\n{2,}', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as plain from o""")
def kb_plain_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "kb_documents").select("doc_id", "content").dropDuplicates(["doc_id"])
    return docs.select("doc_id", T.strip_markdown(F.col("content")).alias("plain"))


@query("""with o as (select distinct on (doc_id) doc_id, kb_id, file_name from kb_documents order by doc_id),
   s as (select doc_id, kb_id, substring(regexp_replace(regexp_replace(regexp_replace(file_name, '[^0-9A-Za-z_.\\-]+', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 100) as safe from o)
   select doc_id, kb_id, safe, cast(row_number() over (partition by kb_id, safe order by doc_id) - 1 as integer) as suffix from s""")
def kb_file_names(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "kb_documents").select("doc_id", "kb_id", "file_name").dropDuplicates(["doc_id"])
    order = Window.partitionBy("kb_id", "safe").orderBy("doc_id")
    return docs.select("doc_id", "kb_id", T.slug(F.col("file_name")).alias("safe")).withColumn("suffix", (F.row_number().over(order) - 1).cast("int"))


@query("""with o as (select distinct on (doc_id) doc_id, file_path, meta_json from kb_documents order by doc_id)
   select doc_id, lower(regexp_extract(file_path, '(\\.[^./\\\\]+)$', 1)) as extension,
          case when json_valid(meta_json) then try_cast(json_extract_string(meta_json, '$.pages') as integer) end as pages from o""")
def kb_metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "kb_documents").select("doc_id", "file_path", "meta_json").dropDuplicates(["doc_id"])
    pages = F.get_json_object("meta_json", "$.pages").try_cast("int")
    return docs.select("doc_id", files.suffix(F.col("file_path")).alias("extension"), F.when(F.try_parse_json("meta_json").isNotNull(), pages).alias("pages"))


# ---------------------------------------------------------------- retrieval


@query("""with o as (select distinct on (request_id) request_id, query from chat_requests order by request_id),
   k as (select request_id, query, regexp_extract_all(lower(query), '[a-z]{2,}') as words,
         regexp_replace(query, '[^\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]', '', 'g') as han from o),
   a as (select request_id, words || case when length(han) > 1 then list_transform(range(1, length(han)), lambda i: substring(han, i, 2)) else [] end as w from k),
   e as (select request_id, unnest(w) as word, generate_subscripts(w, 1) as i from a),
   f as (select request_id, word, min(i) as i from e group by all),
   r as (select *, row_number() over (partition by request_id order by i) as place from f)
   select request_id, cast(place - 1 as integer) as place, word from r where place <= 20""")
def request_keywords(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "chat_requests").select("request_id", "query").dropDuplicates(["request_id"])
    return r.select("request_id", F.posexplode(T.keywords(F.col("query"))).alias("place", "word"))


_BEST = """with b as (select *, row_number() over (partition by request_id, doc_id order by coalesce(original_score, '-inf'::double) desc, cand_id) as rb from rerank_candidates),
  u as (select * from b where doc_id is null or rb = 1),
  r as (select *, row_number() over (partition by request_id order by coalesce(original_score >= 0.3, false) desc, original_score desc nulls last, cand_id) as place from u)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "rerank_candidates")
    return retrieval.rerank_cut(retrieval.best_by_document(c, "request_id", "doc_id", "original_score", "cand_id"), "request_id", "original_score", "cand_id")


@query(_BEST + " select request_id, cand_id, cast(place as integer) as place from r where place <= 5")
def rerank_top(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("request_id", "cand_id", "place")


@query("""with o as (select distinct on (request_id) request_id, query from chat_requests order by request_id),
   j as (select c.request_id, c.cand_id, list_distinct(regexp_extract_all(lower(o.query), '[a-z0-9]+')) as a, list_distinct(regexp_extract_all(lower(c.content), '[a-z0-9]+')) as b
         from rerank_candidates c join o using (request_id))
   select request_id, cand_id, round(case when a is null or b is null then null when len(list_distinct(a || b)) = 0 then 0 else len(list_intersect(a, b)) / len(list_distinct(a || b)) end, 6) as jaccard from j""")
def candidate_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Shared words of every candidate with its question."""
    r = table(spark, d, "chat_requests").select("request_id", "query").dropDuplicates(["request_id"])
    c = table(spark, d, "rerank_candidates").select("request_id", "cand_id", "content").join(r, "request_id")
    return c.select("request_id", "cand_id", F.round(retrieval.overlap(c, "query", "content"), 6).alias("jaccard"))


_KEYWORDS = """o as (select distinct on (request_id) request_id, query from chat_requests order by request_id),
   k as (select request_id, query, regexp_extract_all(lower(query), '[a-z]{2,}') as words,
         regexp_replace(query, '[^\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]', '', 'g') as han from o),
   a as (select request_id, words || case when length(han) > 1 then list_transform(range(1, length(han)), lambda i: substring(han, i, 2)) else [] end as w from k),
   e as (select request_id, unnest(w) as word, generate_subscripts(w, 1) as i from a), f as (select request_id, word, min(i) as i from e group by all),
   p as (select *, row_number() over (partition by request_id order by i) as place from f), w as (select request_id, list(word) as l from p where place <= 20 group by 1)"""


@query(f"""with {_KEYWORDS}, c as (select c.request_id, cand_id, original_score, coalesce(l, []) as l, lower(c.content) as t from rerank_candidates c join o using (request_id) left join w using (request_id))
   select request_id, cand_id, round(coalesce(original_score, 0) + case when len(l) > 0 and t is not null then least(0.15, 0.15 * len(list_filter(l, lambda x: contains(t, x))) / len(l)) else 0 end, 6) as boosted from c""")
def candidate_boost(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "chat_requests").select("request_id", "query").dropDuplicates(["request_id"])
    c = table(spark, d, "rerank_candidates").select("request_id", "cand_id", "content", "original_score").join(r, "request_id")
    return retrieval.keyword_bonus(c, "query", "content", "original_score").select("request_id", "cand_id", F.round("boosted", 6).alias("boosted"))


_TOKENS = f"""coalesce(cast(floor({_HAN.format(x="content")} * 1.5::double + len(regexp_extract_all(content, '[a-zA-Z]+')) * 1.3::double + (length(content) - {_HAN.format(x="content")}
   - length(regexp_replace(content, '[^a-zA-Z]', '', 'g')) - length(regexp_replace(content, '[^ \\t\\n\\x0B\\f\\r]', '', 'g'))) * 0.5::double) as integer), 0)"""


@query(f"""with recursive n as (select request_id, cand_id, {_TOKENS} as t, row_number() over (partition by request_id order by original_score desc nulls last, cand_id) as n from rerank_candidates),
   g as (select request_id, n, [cand_id] as chosen, greatest(200 - t, 0) as room from n where n = 1
         union all select g.request_id, n.n, case when len(chosen) < 8 and t <= room then list_append(chosen, cand_id) else chosen end, case when len(chosen) < 8 and t <= room then room - t else room end
         from g join n on n.request_id is not distinct from g.request_id and n.n = g.n + 1)
   select request_id, arg_max(chosen, n) as chosen from g group by request_id""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.within_budget(table(spark, d, "rerank_candidates"), "request_id", "content", "original_score", "cand_id", 8, 200)


@query(_BEST + """ select request_id, string_agg('[' || place || '] (' || coalesce(source, '-') || ' | ' || cast(round(coalesce(original_score, 0) * 100) as integer) || '%)' || chr(10) || coalesce(content, ''),
   chr(10) || chr(10) order by place) as context from r where place <= 5 group by request_id""")
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.context_blocks(_ranked(spark, d), "request_id", "place", "source", "content", "original_score")


_ANSWERS = """select distinct on (message_id) message_id, content, case when json_valid(metadata) then json_extract_string(metadata, '$.request_id') end as request_id
   from messages where role = 'assistant' order by message_id"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where("role = 'assistant'")
    return m.select("message_id", "content", F.get_json_object("metadata", "$.request_id").alias("request_id")).dropDuplicates(["message_id"])


@query(f"""with a as ({_ANSWERS}), m as (select message_id, request_id, unnest(regexp_extract_all(content, '\\[([0-9]{{1,6}}(?:(?:-|,)[0-9]{{1,6}})*)\\]', 1)) as mark from a),
  e as (select message_id, request_id, string_split_regex(mark, '[-,]') as p, contains(mark, '-') and not contains(mark, ',') as dash from m),
  n as (select message_id, request_id, unnest(case when dash and len(p) = 2 and cast(p[2] as int) >= cast(p[1] as int) and cast(p[2] as int) - cast(p[1] as int) <= 50
        then range(cast(p[1] as int), cast(p[2] as int) + 1) else list_transform(p, lambda x: cast(x as bigint)) end) as place from e),
  {_BEST.removeprefix("with ")}
  select distinct n.message_id, n.request_id, cast(n.place as integer) as place, r.cand_id from n join r on r.request_id = n.request_id and r.place = n.place and r.place <= 5""")
def answer_citations(spark: SparkSession, d: str) -> DataFrame:
    cited = retrieval.cited_chunks(_answers(spark, d), "message_id", "content", "request_id", _ranked(spark, d).select("request_id", "place", "cand_id"), "place")
    return cited.select("message_id", "request_id", "place", "cand_id")


_UNSURE = " or ".join(f"contains(lower(content), '{u}')" for u in retrieval.UNSURE)


@query(f"""with a as ({_ANSWERS}), s as (select request_id, max(original_score) as top, count(*) as used from rerank_candidates group by request_id),
  j as (select message_id, coalesce(content, '') as content, coalesce(top, 0) as top, coalesce(used, 0) as used,
        len(list_distinct(regexp_extract_all(coalesce(content, ''), '\\[[0-9]{{1,3}}\\]'))) as cited from a left join s using (request_id))
  select message_id, greatest(0, least(1, round((case when used > 0 then top else 0.05 end + case when used > 0 and cited > 0 then least(cited, used) / used when used > 0 then 0.2 else 0.05 end
   + case when {_UNSURE} then 0.15 else 0.85 end + case when length(content) < 30 then 0.1 when length(content) < 100 then 0.5 else 0.9 end
   + case when used > 0 and cited > 0 then least(0.95, 0.5 + least(cited, used) * 0.1) else 0.2 end)::double / 5, 2))) as confidence from j""")
def answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Citations count as grounded up to the number of candidates."""
    pool = table(spark, d, "rerank_candidates").groupBy("request_id").agg(F.max("original_score").alias("top"), F.count(F.lit(1)).alias("used"))
    j = _answers(spark, d).join(pool, "request_id", "left").na.fill({"content": "", "top": 0.0, "used": 0})
    cited = F.size(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\[[0-9]{1,3}\])"), F.lit(1))))
    grounded = F.when(F.col("used") > 0, F.least(cited.cast("bigint"), F.col("used"))).otherwise(0)
    return j.select("message_id", retrieval.confidence(F.col("top"), F.col("used"), grounded, cited, F.col("content")).alias("confidence"))


@query(f"""with a as (select message_id, coalesce(content, '') as content from ({_ANSWERS})) select message_id, length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) < 10 or regexp_matches(content, '{retrieval.DECLINED}') as declined,
   substring(content, 1, 500) as head, length(content) > 500 as is_cut from a""")
def answer_declined(spark: SparkSession, d: str) -> DataFrame:
    """A null answer is one without text."""
    c = F.col("content")
    return _answers(spark, d).na.fill({"content": ""}).select(
        "message_id", ((F.length(T.strip(c)) < 10) | c.rlike(retrieval.DECLINED)).alias("declined"), F.substring(c, 1, 500).alias("head"), (F.length(c) > 500).alias("is_cut")
    )


@query("""with v as (select request_id, doc_id, min(cand_id) as cand_id, 'vector' as origin from rerank_candidates where lower(regexp_replace(source, '[^A-Za-z]', '', 'g')) = 'vector' and doc_id is not null group by all),
   g as (select request_id, doc_id, min(cand_id) as cand_id, 'graph' as origin from rerank_candidates where lower(regexp_replace(source, '[^A-Za-z]', '', 'g')) = 'kg' and doc_id is not null group by all)
   select * from v union all select g.* from g anti join v using (request_id, doc_id)""")
def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "rerank_candidates").where("doc_id is not null")

    def of(source: str, origin: str) -> DataFrame:
        rows = c.where(F.lower(F.regexp_replace("source", "[^A-Za-z]", "")) == source)
        return rows.groupBy("request_id", "doc_id").agg(F.min("cand_id").alias("cand_id")).withColumn("origin", F.lit(origin))

    return retrieval.merged_sources(of("vector", "vector"), of("kg", "graph"), "request_id", "doc_id").select("request_id", "doc_id", "cand_id", "origin")


# ---------------------------------------------------------------- conversations

_MESSAGES = "select distinct on (message_id) * from messages order by message_id"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").dropDuplicates(["message_id"])


@query(f"""with r as (select *, row_number() over (partition by session_id order by created_at desc nulls last, message_id desc) as place from ({_MESSAGES}))
  select session_id, message_id, cast(place as integer) as place from r where place <= 3""")
def conv_last_messages(spark: SparkSession, d: str) -> DataFrame:
    return conversation.last_messages(_messages(spark, d), "session_id", "created_at", "message_id", 3).select("session_id", "message_id", "place")


_POINTS = " or ".join(f"contains(coalesce(query, ''), '{w}')" for w in conversation.PRONOUNS + conversation.CONJUNCTIONS)


@query(f"""with o as (select distinct on (request_id) * from chat_requests order by request_id),
  r as (select *, row_number() over (partition by session_id order by created_at, request_id) > 1 as has_earlier from o)
  select request_id, has_earlier, ({_POINTS}) or (has_earlier and length(coalesce(query, '')) >= 5) as needs_rewrite from r""")
def conv_needs_rewrite(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "chat_requests").dropDuplicates(["request_id"])
    r = conversation.with_earlier(r, "session_id", "created_at", "request_id")
    return r.select("request_id", "has_earlier", conversation.needs_rewrite(F.col("query"), F.col("has_earlier")).alias("needs_rewrite"))


@query(f"""with r as (select *, row_number() over (partition by session_id order by created_at desc nulls last, message_id desc) as place from ({_MESSAGES})),
  k as (select *, row_number() over (partition by session_id order by place) as n from r where place <= 20 and role = 'user' and length(content) > 10)
  select session_id, string_agg(substring(content, 1, 60), '; ' order by n desc) as summary from k where n <= 5 group by session_id""")
def conv_fallback_summary(spark: SparkSession, d: str) -> DataFrame:
    return conversation.fallback_summary(_messages(spark, d), "session_id", "role", "content", "created_at", "message_id")


_DUE = f"select session_id, count(*) as n_messages, cast(floor(count(*) / 4) as integer) as n_summaries from ({_MESSAGES}) group by session_id having count(*) >= 4"


@query(_DUE)
def conv_summary_due(spark: SparkSession, d: str) -> DataFrame:
    return conversation.summary_due(_messages(spark, d), "session_id", 4)


@query("select session_id, count(*) // 4 as n_summaries from messages group by session_id having count(*) >= 4")
def stream_summary_triggers(spark: SparkSession, d: str) -> DataFrame:
    """The stateful stream over the messages as they are delivered, reduced to the triggers per session."""
    fired = streams.run_to_table(streams.summary_triggers(streams.stream_table(spark, f"{d}/messages.parquet"), "session_id", 4))
    return fired.groupBy("session_id").agg(F.max("trigger_no").alias("n_summaries"))


@query("""select m.message_id, m.session_id from (select distinct on (message_id) * from messages order by message_id) m
   where exists (select 1 from chat_requests c where c.session_id = m.session_id and c.user_id % 2 = 0)""")
def conv_owned_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the sessions that the users with even ids own."""
    owned = table(spark, d, "chat_requests").where("user_id % 2 = 0").select("session_id").distinct()
    return _messages(spark, d).join(owned, "session_id", "left_semi").select("message_id", "session_id")


_WORDS = {name: ", ".join(f"'{w}'" for w in words) for name, words in (("d", meetings.DECISIONS), ("t", meetings.TOPICS), ("u", meetings.URGENT), ("l", meetings.LATER))}
_HAS = {k: f"len(list_filter([{w}], lambda w: contains(lower(line), w))) > 0" for k, w in _WORDS.items()}
_DEADLINE = "coalesce(" + ", ".join(f"nullif(regexp_extract(line, '{p}', 1), '')" for p in meetings.DEADLINES) + ")"


@query(f"""with o as (select distinct on (meeting_id) meeting_id, meeting_transcript from meetings order by meeting_id),
  s as (select meeting_id, regexp_split_to_array(meeting_transcript, '\\r?\\n') as l from o),
  e as (select meeting_id, cast(generate_subscripts(l, 1) - 1 as integer) as line_no, regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g') as line from s),
  m as (select *, {_HAS["d"]} as is_decision, {_HAS["t"]} as is_topic from e where length(line) > 0)
  select *, {_DEADLINE} as deadline, case when {_HAS["u"]} then 'high' when {_HAS["l"]} then 'low' else 'medium' end as priority from m where is_decision or is_topic""")
def meeting_marked_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "meetings").select("meeting_id", "meeting_transcript").dropDuplicates(["meeting_id"])
    return meetings.marked_lines(rows, "meeting_id", "meeting_transcript")


# ---------------------------------------------------------------- metrics and events

_SKILLS = "select distinct on (id) * from skill_metrics where id is not null order by id"


def _skills(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "skill_metrics").where("id is not null").dropDuplicates(["id"])


@query(f"""select skill_name, count(*) as n, count(*) filter (where lower(status) <> 'success') as n_failed,
   round(count(*) filter (where lower(status) <> 'success') / count(*), 6) as failure_rate from ({_SKILLS}) group by skill_name""")
def metric_failure_rate(spark: SparkSession, d: str) -> DataFrame:
    bad = F.count_if(F.lower("status") != "success")
    return _skills(spark, d).groupBy("skill_name").agg(F.count(F.lit(1)).alias("n"), bad.alias("n_failed"), F.round(bad / F.count(F.lit(1)), 6).alias("failure_rate"))


@query(f"""with r as (select *, row_number() over (partition by trace_id order by id desc) as place from ({_SKILLS}) where trace_id is not null)
  select trace_id, id, skill_name, cast(place as integer) as place from r where place <= 5""")
def metric_latest_by_trace(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("trace_id").orderBy(F.desc("id"))
    rows = _skills(spark, d).where("trace_id is not null").withColumn("place", F.row_number().over(order))
    return rows.where("place <= 5").select("trace_id", "id", "skill_name", "place")


@query(f"""with f as (select skill_name, id, lower(status) <> 'success' as bad from ({_SKILLS})),
  r as (select *, row_number() over (partition by skill_name order by id) - sum(bad::int) over (partition by skill_name order by id) as run from f)
  select skill_name, count(*) as n_failures, min(id) as first_id from r where bad group by skill_name, run having count(*) >= 2""")
def metric_failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    s = tables.streaks(_skills(spark, d).select("skill_name", "id", "status"), "skill_name", "id", F.lower("status") != "success")
    return s.where("n_failures >= 2")


@query("""with o as (select distinct on (id) * from llm_metrics where id is not null order by id)
   select trace_id, cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens,
          cast(sum(total_tokens) as bigint) as total_tokens, max_by(lower(model), id) as last_model from o where trace_id is not null group by trace_id""")
def metric_token_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "llm_metrics").where("id is not null and trace_id is not null").dropDuplicates(["id"])
    return rows.groupBy("trace_id").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("total_tokens").alias("total_tokens"),
        F.max_by(F.lower("model"), "id").alias("last_model"),
    )


_TUMBLING = """select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all"""


def _windows(df: DataFrame) -> DataFrame:
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(_TUMBLING)
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _windows(streams.windowed(table(spark, d, "events"), "ts", "event_type", "value", "1 hour"))


@query(_TUMBLING)
def stream_events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The same windows by a stream with a watermark, in complete mode over all that is there."""
    out = streams.windowed(streams.stream_table(spark, f"{d}/events.parquet"), "ts", "event_type", "value", "1 hour", late="3650 days")
    return _windows(streams.final_state(out))


@query("""with s as (select unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) as w, event_type, value from events)
   select strftime(w, '%Y-%m-%d %H:%M') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from s group by all""")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _windows(streams.windowed(table(spark, d, "events"), "ts", "event_type", "value", "1 hour", "30 minutes"))


@query("""with l as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minute then 0 else 1 end as opens from events),
   s as (select *, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as no from l)
   select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as session_end, count(*) as n from s group by user_id, no""")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = streams.sessions(table(spark, d, "events"), "ts", "user_id")
    return s.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("session_start", "session_end")], "n")


@query("""with o as (select cast(strftime(o_orderdate, '%Y-%m-%d') as varchar) as day, round(sum(o_totalprice), 2) as total from orders group by 1),
   w as (select *, lag(total) over (order by day) as p, lag(total, 4) over (order by day) as f from o)
   select day, total, case when p > 0 then round((total - p) / p * 100, 2) + 0.0 else 0 end as change_pct,
          case when f is null or total = f then 'flat' when total > f then 'up' else 'down' end as trend from w""")
def orders_daily_trend(spark: SparkSession, d: str) -> DataFrame:
    """Days are few, however many orders there are, so that their window is small."""
    days = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return tables.trend(days, "day", "total")


@query("""select event_type, count(*) filter (where value < 10) as low, count(*) filter (where value >= 10 and value < 50) as medium, count(*) filter (where value >= 50) as high, count(*) as n from events group by event_type""")
def events_by_level(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "medium").when(F.col("value") >= 50, "high")
    e = table(spark, d, "events").withColumn("level", level)
    return e.groupBy("event_type").agg(*[F.count_if(F.col("level") == x).alias(x) for x in ("low", "medium", "high")], F.count(F.lit(1)).alias("n"))


@query("""with r as (select user_id, event_type, value, row_number() over (partition by user_id order by value desc, event_id) as rn from events)
   select user_id, round(sum(value), 4) as impact, count(*) as n from r where rn <= 4 group by user_id""")
def events_top_impact(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the four largest values of every user."""
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    top = table(spark, d, "events").withColumn("rn", F.row_number().over(order)).where("rn <= 4")
    return top.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("impact"), F.count(F.lit(1)).alias("n"))


@query("""select event_id, list_sort(json_keys(props)) as keys from events""")
def events_json_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.sort_array(F.json_object_keys("props")).alias("keys"))


# ---------------------------------------------------------------- catalog


@query("""select c_custkey, c_name, c_acctbal from customer where c_mktsegment = 'BUILDING' and c_name ilike '%customer%' order by c_acctbal desc, c_custkey limit 50 offset 10""")
def catalog_page(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where((F.col("c_mktsegment") == "BUILDING") & F.col("c_name").ilike("%customer%"))
    return tables.page(c, [F.desc("c_acctbal"), F.col("c_custkey")], 50, 10).select("c_custkey", "c_name", "c_acctbal")


@query("""select kb_id, count(*) as n_docs, count(*) filter (where lower(status) = 'indexed') as n_indexed, cast(sum(coalesce(chunk_count, 0)) as bigint) as n_chunks
   from (select distinct on (doc_id) * from kb_documents order by doc_id) group by kb_id""")
def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "kb_documents").dropDuplicates(["doc_id"])
    return docs.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.lower("status") == "indexed").alias("n_indexed"), F.sum(F.coalesce("chunk_count", F.lit(0))).cast("bigint").alias("n_chunks"))


@query("""select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey % 3 <> 0 union all select o_orderkey, o_custkey, 'N' from orders where o_orderkey % 3 = 0""")
def orders_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return tables.upsert(o, o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("N")), ["o_orderkey"])


@query("""select c_custkey, c_name, c_acctbal from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)""")
def customers_cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return tables.delete(table(spark, d, "customer"), gone, ["c_nationkey"]).select("c_custkey", "c_name", "c_acctbal")


@query("""select s_suppkey, case when s_acctbal < 0 then 'suspended' else s_name end as s_name, s_acctbal from supplier""")
def suppliers_updated(spark: SparkSession, d: str) -> DataFrame:
    """Only the allowed column changes, though another change is asked for."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return tables.updated(s, F.col("s_acctbal") < 0, {"s_name": F.lit("suspended"), "s_acctbal": F.lit(0.0)}, {"s_name"})


@query("""with r as (select *, row_number() over (partition by p_name order by p_retailprice, p_partkey) as rn from part) select p_partkey, p_name, p_retailprice from r where rn = 1""")
def parts_first_by_name(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    return tables.first_of(p, [F.col("p_name")], ["p_retailprice", "p_partkey"])


@query("""with b as (select p_brand, avg(p_retailprice) * 0.95 as low, avg(p_retailprice) * 1.05 as high from part group by p_brand)
   select p.p_partkey, p.p_brand, b.p_brand is not null as in_band from part p left join b on b.p_brand = p.p_brand and p.p_retailprice between b.low and b.high""")
def parts_in_band(spark: SparkSession, d: str) -> DataFrame:
    """A left join on brand and price range; the bands are one row a brand."""
    p = table(spark, d, "part")
    b = p.groupBy("p_brand").agg((F.avg("p_retailprice") * 0.95).alias("low"), (F.avg("p_retailprice") * 1.05).alias("high"))
    on = (F.col("p.p_brand") == F.col("b.p_brand")) & F.col("p.p_retailprice").between(F.col("b.low"), F.col("b.high"))
    return p.alias("p").join(b.alias("b"), on, "left").select("p.p_partkey", "p.p_brand", F.col("b.p_brand").isNotNull().alias("in_band"))


@query("""select l_returnflag, quantile_disc(l_quantity, 0.25) as q1, quantile_disc(l_quantity, 0.75) as q3,
   quantile_disc(l_quantity, 0.25) - 1.5 * (quantile_disc(l_quantity, 0.75) - quantile_disc(l_quantity, 0.25)) as low,
   quantile_disc(l_quantity, 0.75) + 1.5 * (quantile_disc(l_quantity, 0.75) - quantile_disc(l_quantity, 0.25)) as high from lineitem group by l_returnflag""")
def lineitem_outlier_bounds(spark: SparkSession, d: str) -> DataFrame:
    return tables.outlier_bounds(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


_PROFILED = ["chunk_id", "text", "category", "chunk_index"]


def _profile_sql() -> str:
    one = """select '{c}' as "column", regexp_replace(cast({x} as varchar), '^\\s+|\\s+$', '', 'g') as value from vector_records"""
    source = {"chunk_id": "chunk_id", "text": "text", "category": "metadata.category", "chunk_index": "metadata.chunk_index"}
    union = " union all ".join(one.format(c=c, x=source[c]) for c in _PROFILED)
    tokens = ", ".join(f"'{t}'" for t in tables.NULL_TOKENS)
    return f"""with l as ({union}), v as (select "column", case when value is null or lower(value) in ({tokens}) then null else value end as v from l),
      f as (select "column", v, coalesce(regexp_matches(v, '^[+-]?[0-9]+$'), false) as i, coalesce(regexp_matches(v, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'), false) as x,
             coalesce(regexp_matches(v, '^[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}'), false) as t from v),
      c as (select "column", count(*) as n, count(*) - count(v) as null_count, count(distinct v) as distinct_count, count(*) filter (where i) as n_int, count(*) filter (where x and not i) as n_float, count(*) filter (where t) as n_date from f group by 1)
      select *, case when n = null_count then 'empty_or_null' when n_date > (n - null_count) * 0.5 then 'datetime' when n_int > (n - null_count) * 0.8 then 'integer'
        when n_int + n_float > (n - null_count) * 0.8 then 'float' when n_int + n_float > (n - null_count) * 0.5 then 'mixed_numeric_string' else 'string' end as dtype from c"""


@query(_profile_sql())
def vector_profile(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vector_records").select("chunk_id", "text", F.col("metadata.category").alias("category"), F.col("metadata.chunk_index").alias("chunk_index"))
    return tables.profile(v, _PROFILED)


@query("""select c_mktsegment, count(*) as num_rows, count(distinct c_nationkey) as max_categories, 2 as num_numeric, false as has_time from customer group by c_mktsegment""")
def chart_features(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    numeric = sum(t in ("int", "bigint", "double", "float") for n, t in c.dtypes if n not in ("c_custkey",))
    has_time = any(t.startswith(("timestamp", "date")) for _, t in c.dtypes)
    return c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("num_rows"), F.count_distinct("c_nationkey").alias("max_categories")).withColumns(
        {"num_numeric": F.lit(numeric), "has_time": F.lit(has_time)}
    )


@query("""select c_mktsegment as category, string_agg('[' || c_nationkey || '] ' || c_name, chr(10) order by c_acctbal desc, c_custkey) as prefix from
   (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rn from customer) where rn <= 20 group by c_mktsegment""")
def ordered_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The 20 first entries of each category rendered in order."""
    order = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    top = table(spark, d, "customer").withColumn("rn", F.row_number().over(order)).where("rn <= 20")
    line = F.concat(F.lit("["), F.col("c_nationkey"), F.lit("] "), F.col("c_name"))
    rows = top.groupBy(F.col("c_mktsegment").alias("category")).agg(F.array_sort(F.collect_list(F.struct("rn", line.alias("l")))).alias("x"))
    return rows.select("category", F.array_join(F.transform("x", lambda e: e["l"]), "\n").alias("prefix"))


# ---------------------------------------------------------------- graph

_EDGES = """select c_name as source, n_name as target from customer join nation on c_nationkey = n_nationkey
  union all select s_name, n_name from supplier join nation on s_nationkey = n_nationkey union all select n_name, r_name from nation join region on n_regionkey = r_regionkey"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("source"), F.col("n_name").alias("target"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("source"), F.col("n_name").alias("target"))
    return c.unionByName(s).unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target")))


@query(f"""with e as ({_EDGES}), k as (select s_name as n from supplier where s_acctbal > 0 union select n_name from nation where n_regionkey = 2)
   select distinct source, target from e where source in (select n from k) or target in (select n from k)""")
def graph_local(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_name").alias("n")).union(table(spark, d, "nation").where("n_regionkey = 2").select("n_name"))
    return graph.neighbourhood(_edges(spark, d), names, "n")


@query("""select r_name as community, string_agg(n_name, ' --- ' order by n_name) as report, count(*) as size from nation join region on n_regionkey = r_regionkey group by r_name""")
def graph_global(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("community")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), " --- ").alias("report"), F.count(F.lit(1)).alias("size"))


@query("""with o as (select distinct doc_id, request_id from rerank_candidates where doc_id is not null and request_id is not null)
   select a.doc_id as source, b.doc_id as target, count(*) as weight from o a join o b on a.request_id = b.request_id and a.doc_id < b.doc_id group by all""")
def graph_co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are candidates of the same request."""
    return graph.co_occurrence(table(spark, d, "rerank_candidates"), "request_id", "doc_id", 200)


@query("""with recursive e as (select session_id as a, 'u' || user_id as b from chat_requests where session_id is not null and user_id is not null), u as (select a, b from e union select b, a from e),
   r as (select a as node, a as c from u union select u.b, r.c from r join u on u.a = r.node) select node, min(c) as component from r group by node""")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chat_requests").select(F.col("session_id").alias("source"), F.concat(F.lit("u"), F.col("user_id")).alias("target"))
    return graph.components(c.where("source is not null and target is not null").distinct())


@query("""with o as (select distinct on (request_id) request_id, query from chat_requests order by request_id),
   w as (select distinct request_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]{3,}')) as w from o),
   n as (select distinct title from documents where title is not null), p as (select distinct title, unnest(regexp_extract_all(lower(title), '[a-z0-9]{3,}')) as w from n),
   h as (select request_id, title, count(*) as hits from w join p using (w) group by all), r as (select *, row_number() over (partition by request_id order by hits desc, title) as rank from h)
   select request_id, title, hits, cast(rank as integer) as rank from r where rank <= 10""")
def graph_entity_match(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "chat_requests").select("request_id", "query").dropDuplicates(["request_id"])
    names = table(spark, d, "documents").where("title is not null").select("title").distinct()
    return graph.top_entities(r, "request_id", "query", names, "title")


# ---------------------------------------------------------------- embedding runs, grounding and simulated answers


@query("""with o as (select distinct on (chunk_id) chunk_id, text, metadata.category as category from vector_records order by chunk_id),
   u as (select regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t, min(chunk_id) as first_id, count(*) as n from o where text is not null group by 1)
   select cast(sum(n) as bigint) as total, count(*) as n_unique, cast(sum(n) - count(*) as bigint) as saved,
          count(*) filter (where ends_with(first_id, '_0')) as hits, count(*) filter (where not ends_with(first_id, '_0')) as misses from u""")
def embed_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """What embedding all chunks costs: each text once, and not those that an earlier run (of the first chunks) has."""
    v = table(spark, d, "vector_records").select("chunk_id", "text").where("text is not null").dropDuplicates(["chunk_id"])
    unique = v.groupBy(T.strip(F.col("text")).alias("t")).agg(F.min("chunk_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    cached = F.endswith(F.col("first_id"), F.lit("_0"))
    return unique.agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_unique"), (F.sum("n") - F.count(F.lit(1))).alias("saved"),
        F.count_if(cached).alias("hits"), F.count_if(~cached).alias("misses"),
    )


@query("""with o as (select distinct on (chunk_id) chunk_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t, metadata.chunk_index as i from vector_records where text is not null order by chunk_id)
   select chunk_id, md5(t) in (select md5(t) from o where i = 0) as is_cached from o""")
def embed_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Which chunks' texts an earlier run, over the first chunk of every document, has embedded already."""
    v = table(spark, d, "vector_records").where("text is not null").select("chunk_id", F.col("metadata.chunk_index").alias("i"), F.md5(T.strip(F.col("text"))).alias("key"))
    v = v.dropDuplicates(["chunk_id"])
    return tables.cache_split(v, "key", v.where("i = 0")).select("chunk_id", "is_cached")


@query("""with o as (select distinct on (chunk_id) chunk_id, text from vector_records order by chunk_id),
   u as (select regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t, min(chunk_id) as source_id from o where text is not null group by 1)
   select chunk_id, source_id from o join u on regexp_replace(o.text, '^\\s+|\\s+$', '', 'g') = u.t""")
def embed_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """For every chunk the one whose embedding it shares."""
    v = table(spark, d, "vector_records").select("chunk_id", "text").where("text is not null").dropDuplicates(["chunk_id"])
    keyed = v.select("chunk_id", F.md5(T.strip(F.col("text"))).alias("k"))
    first = keyed.groupBy("k").agg(F.min("chunk_id").alias("source_id"))
    return keyed.join(first, "k").select("chunk_id", "source_id")


@query()
def embed_hashed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "vector_records").select("chunk_id", "text").where("text is not null").dropDuplicates(["chunk_id"])
    return docs.select("chunk_id", V.hashed_embedding(F.col("text")).alias("embedding"))


_GRAMS = "list_distinct(list_transform(range(1, length({x}) - 2), lambda i: substring({x}, i, 4)))"


@query(f"""with a as ({_ANSWERS}), c as (select request_id, cand_id, content from rerank_candidates),
  j as (select message_id, cand_id, lower(regexp_replace(a.content, '\\s+', '', 'g')) as x, lower(regexp_replace(c.content, '\\s+', '', 'g')) as y
        from a join c using (request_id) where a.content is not null and c.content is not null),
  g as (select message_id, cand_id, case when length(x) >= 4 then {_GRAMS.format(x="x")} else [] end as gx, case when length(y) >= 4 then {_GRAMS.format(x="y")} else [] end as gy from j)
  select message_id, cand_id, round(case when len(gx) = 0 then 0 else len(list_intersect(gx, gy)) / len(gx) end, 6) as coverage from g""")
def answer_grounding(spark: SparkSession, d: str) -> DataFrame:
    """How much of each answer every candidate of its request covers."""
    c = table(spark, d, "rerank_candidates").select("request_id", "cand_id", F.col("content").alias("source"))
    j = _answers(spark, d).where("content is not null").join(c.where("source is not null"), "request_id")
    return j.select("message_id", "cand_id", F.round(T.gram_coverage(F.col("content"), F.col("source")), 6).alias("coverage"))


@query("""with o as (select distinct on (request_id) request_id, query from chat_requests order by request_id),
   k as (select request_id, list_distinct(regexp_extract_all(lower(query), '[a-z]{2,}')) as w from o),
   c as (select request_id, cand_id, content from rerank_candidates),
   l as (select c.request_id, cand_id, cast(generate_subscripts(string_split(content, chr(10)), 1) - 1 as integer) as line_no, regexp_replace(unnest(string_split(content, chr(10))), '^\\s+|\\s+$', '', 'g') as line from c),
   m as (select l.*, row_number() over (partition by request_id order by cand_id, line_no) as rn from l join k using (request_id)
         where length(line) > 20 and len(list_filter(list_slice(w, 1, 20), lambda x: contains(lower(line), x))) > 0)
   select request_id, cand_id, line_no, substring(line, 1, 200) as line from m where rn <= 5""")
def answer_extracts(spark: SparkSession, d: str) -> DataFrame:
    """The first five candidate lines of every request that hold one of its Latin words."""
    r = table(spark, d, "chat_requests").select("request_id", "query").dropDuplicates(["request_id"])
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("([a-z]{2,})"), F.lit(1))), 1, 20)
    c = table(spark, d, "rerank_candidates").select("request_id", "cand_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    j = c.withColumn("line", T.strip(F.col("line"))).where(F.length("line") > 20).join(r.select("request_id", words.alias("w")), "request_id")
    j = j.where(F.exists("w", lambda x: F.contains(F.lower("line"), x)))
    order = Window.partitionBy("request_id").orderBy("cand_id", "line_no")
    return j.withColumn("rn", F.row_number().over(order)).where("rn <= 5").select("request_id", "cand_id", "line_no", F.substring("line", 1, 200).alias("line"))


@query("""select distinct kb_id, coalesce(regexp_matches(kb_id, '^[A-Za-z0-9][A-Za-z0-9_-]{1,61}[A-Za-z0-9]$'), false) as is_valid from documents""")
def kb_names_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("kb_id").distinct().select("kb_id", T.is_namespace(F.col("kb_id")).alias("is_valid"))


@query("""with o as (select distinct on (id) * from llm_metrics where id is not null order by id)
   select lower(trim(model)) as model, count(*) as n, round(count(*) filter (where lower(status) = 'success') / count(*), 6) as success_rate,
          round(avg(elapsed_ms) filter (where elapsed_ms > 0), 4) as mean_ms, cast(max(total_tokens) as integer) as most_tokens from o group by 1""")
def metric_model_report(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "llm_metrics").where("id is not null").dropDuplicates(["id"])
    return m.groupBy(F.lower(F.trim("model")).alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.lower("status") == "success") / F.count(F.lit(1)), 6).alias("success_rate"),
        F.round(F.avg(F.when(F.col("elapsed_ms") > 0, F.col("elapsed_ms"))), 4).alias("mean_ms"), F.max("total_tokens").alias("most_tokens"),
    )
