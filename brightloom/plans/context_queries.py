"""More named queries: context for answers, grounding, overlap, actions, summaries, cleaning and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.functions import text as T
from brightloom.functions import vectors as V
from brightloom.operators import chunking, context, conversation, graph, meetings, retrieval, summary, tables
from brightloom.plans.queries import _ANSWERS, _BEST, _EDGES, _FIXED, _HAS, _MESSAGES, _SENTENCES, _SKILLS, _answers, _edges, _messages, _ranked, _skills, query
from brightloom.runtime import spread, table
from brightloom.sources import files

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')".format


# ---------------------------------------------------------------- context


def _last(x: str, mark: str) -> str:
    escaped = mark.replace(".", "\\.")
    return f"case when contains({x}, '{mark}') then length(regexp_extract({x}, '(?s)^(.*){escaped}', 1)) else -1 end"


def _truncated(x: str, n: int) -> str:
    head = f"substring({x}, 1, {n})"
    at = ", ".join(f"case when {_last(head, m)} >= {int(n * 0.6)} then {_last(head, m)} end" for m in ("\n", "。", ".", " "))
    return f"case when length({x}) > {n} then substring({x}, 1, cast(coalesce({at}, {n}) as bigint)) || '...' else {x} end"


@query(f"select doc_id, md5({_truncated('text', 200)}) as head from documents")
def doc_heads(spark: SparkSession, d: str) -> DataFrame:
    """The beginning of every document, cut where it reads well."""
    return table(spark, d, "documents").select("doc_id", F.md5(T.truncated(F.col("text"), 200)).alias("head"))


_REFERRING = f"""m as ({_MESSAGES}),
   p as (select *, lag(message_id) over w as before, lag(message_id, 3) over w as earlier from m window w as (partition by session_id order by created_at, message_id)),
   t as (select message_id as id, session_id, coalesce('@msg-' || earlier || ' ', '') || coalesce(content, '') || coalesce(' @msg-' || before, '') as text from p where role = 'user'),
   e as (select id, session_id, unnest(regexp_extract_all(text, '@msg-([a-zA-Z0-9-]+)', 1)) as message_id, generate_subscripts(regexp_extract_all(text, '@msg-([a-zA-Z0-9-]+)', 1), 1) - 1 as place from t)"""


def _referring(spark: SparkSession, d: str) -> DataFrame:
    """Questions that refer to the message before them and to one further back, as their users would write it."""
    order = Window.partitionBy("session_id").orderBy("created_at", "message_id")
    m = _messages(spark, d).select("message_id", "session_id", "role", "content", "created_at")
    m = m.withColumn("before", F.lag("message_id").over(order)).withColumn("earlier", F.lag("message_id", 3).over(order)).where("role = 'user'")
    text = F.concat(
        F.coalesce(F.concat(F.lit("@msg-"), "earlier", F.lit(" ")), F.lit("")), F.coalesce("content", F.lit("")), F.coalesce(F.concat(F.lit(" @msg-"), "before"), F.lit(""))
    )
    return m.select(F.col("message_id").alias("id"), "session_id", text.alias("text"))


@query(f"with {_REFERRING} select e.id, cast(place as integer) as place, e.message_id, m.content from e join m on m.session_id = e.session_id and m.message_id = e.message_id")
def conv_references(spark: SparkSession, d: str) -> DataFrame:
    return context.references(_referring(spark, d), "id", "session_id", "text", _messages(spark, d), "message_id", "content")


@query(f"with {_REFERRING} select id, {_STRIP(x="regexp_replace(text, '@msg-([a-zA-Z0-9-]+)', '', 'g')")} as words from t")
def conv_without_references(spark: SparkSession, d: str) -> DataFrame:
    return _referring(spark, d).select("id", context.without_references(F.col("text")).alias("words"))


_RECENT = """select session_id, string_agg('- ' || content, chr(10) order by rn desc) as lines from
   (select *, row_number() over (partition by session_id order by created_at desc nulls last, message_id desc) as rn from ({m}) where role = 'assistant' and length(content) > 0) where rn <= {n} group by session_id"""


@query(_RECENT.format(m=_MESSAGES, n=3))
def conv_recent_lines(spark: SparkSession, d: str) -> DataFrame:
    """The last three answers of every session."""
    return context.recent_lines(_messages(spark, d).where("role = 'assistant'"), "session_id", "created_at", "message_id", "content", 3)


@query(f"""with r as (select *, row_number() over (partition by session_id order by created_at desc nulls last, message_id desc) as place from ({_MESSAGES}) where role = 'assistant')
   select session_id, message_id, cast(place as integer) as place from r where place <= 5""")
def conv_kept_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The five newest of what a session keeps; older ones go."""
    kept = conversation.last_messages(_messages(spark, d).where("role = 'assistant'"), "session_id", "created_at", "message_id", 5)
    return kept.select("session_id", "message_id", "place")


@query(f"""{_BEST}, o as (select request_id, min(struct_pack(created_at, query)).query as query, min(struct_pack(created_at, session_id)).session_id as session_id from chat_requests group by request_id),
   l as (select request_id, string_agg(place || '. ' || coalesce(source, 'unknown') || ' (score: ' || printf('%.2f', coalesce(original_score, 0)) || '): ' || coalesce({_truncated('content', 200)}, ''), chr(10) order by place) as docs
         from r where place <= 5 group by request_id),
   s as ({_RECENT.format(m=_MESSAGES, n=3)})
   select o.request_id, md5(concat_ws(chr(10) || chr(10), '[System]' || chr(10) || 'Answer from the documents.', '[对话摘要]' || chr(10) || s.lines, '[文档]' || chr(10) || l.docs,
          '[用户]' || chr(10) || coalesce({_STRIP(x="regexp_replace(query, '@msg-([a-zA-Z0-9-]+)', '', 'g')")}, ''))) as context
   from o left join l using (request_id) left join s using (session_id)""")
def context_merged(spark: SparkSession, d: str) -> DataFrame:
    """Rules, recent answers, documents and question of every request in one context."""
    first = F.min(F.struct("created_at", "query")), F.min(F.struct("created_at", "session_id"))
    asked = table(spark, d, "chat_requests").groupBy("request_id").agg(first[0].alias("q"), first[1].alias("s")).select("request_id", "q.query", "s.session_id")
    docs = context.document_lines(_ranked(spark, d), "request_id", "place", "source", "content", "original_score").withColumnRenamed("lines", "docs")
    both = asked.join(docs, "request_id", "left").join(conv_recent_lines(spark, d), "session_id", "left")
    whole = context.merged(F.lit("Answer from the documents."), F.col("lines"), F.lit(""), F.col("docs"), F.col("query"))
    return both.select("request_id", F.md5(whole).alias("context"))


_CITED = f"""a as ({_ANSWERS}), m as (select message_id, request_id, unnest(regexp_extract_all(content, '\\[([0-9]{{1,6}}(?:(?:-|,)[0-9]{{1,6}})*)\\]', 1)) as mark from a),
  e as (select message_id, request_id, string_split_regex(mark, '[-,]') as p, contains(mark, '-') and not contains(mark, ',') as dash from m),
  n as (select distinct message_id, request_id, unnest(case when dash and len(p) = 2 and cast(p[2] as int) >= cast(p[1] as int) and cast(p[2] as int) - cast(p[1] as int) <= 50
        then range(cast(p[1] as int), cast(p[2] as int) + 1) else list_transform(p, lambda x: cast(x as bigint)) end) as place from e)"""


@query(f"""with {_CITED}, {_BEST.removeprefix("with ")},
   c as (select n.message_id, n.place, r.cand_id, r.content as source, a.content as answer from n join r on r.request_id = n.request_id and r.place = n.place and r.place <= 5 join a on a.message_id = n.message_id),
   w as (select *, case when instr(answer, '[' || place || ']') > 0 then instr(answer, '[' || place || ']') else coalesce(instr(answer, list_filter(regexp_extract_all(answer, '\\[[0-9]{{1,6}}-[0-9]{{1,6}}\\]'),
            lambda x: cast(regexp_extract(x, '^\\[([0-9]+)-', 1) as int) <= place and place <= cast(regexp_extract(x, '-([0-9]+)\\]$', 1) as int))[1]), 0) end - 1 as pos from c),
   s as (select *, {_STRIP(x="regexp_replace(substring(answer, greatest(pos - 50, 0) + 1, pos + 150 - greatest(pos - 50, 0)), '\\s+', ' ', 'g')")} as sn, {_STRIP(x="regexp_replace(source, '\\s+', ' ', 'g')")} as so from w),
   h as (select *, list_transform(range(1, length(sn) - 1), lambda i: contains(so, substring(sn, i, 3))) as hits from s)
   select message_id, cast(place as integer) as place, cand_id, case when pos < 0 then false when so is null then null when length(sn) < 5 then true
     else len(list_filter(range(1, length(sn) + 1), lambda i: coalesce(hits[i], false) or (i > 1 and coalesce(hits[i - 1], false)) or (i > 2 and coalesce(hits[i - 2], false)))) / length(sn) >= 0.3 end as grounded from h""")
def answer_citation_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Whether the words around each citation come from the candidate it names."""
    ranked = _ranked(spark, d).select("request_id", "place", "cand_id", F.col("content").alias("source"))
    cited = retrieval.cited_chunks(_answers(spark, d), "message_id", "content", "request_id", ranked, "place")
    both = cited.join(_answers(spark, d).select("message_id", F.col("content").alias("answer")), "message_id")
    at = retrieval.marker_place(F.col("answer"), F.col("place"))
    checked = F.when(at < 0, False).when(F.col("source").isNotNull(), retrieval.grounded(F.col("answer"), at, F.col("source")))
    return both.select("message_id", "place", "cand_id", checked.alias("grounded"))


@query(f"""with a as ({_ANSWERS}), j as (select message_id, coalesce(contains(a.content, substring(c.content, 1, 50)), false) as hit from a join rerank_candidates c using (request_id))
   select message_id, count(*) as n_sources, count(*) filter (where hit) as n_found, round(count(*) filter (where hit) / count(*), 6) as coverage, round(count(*) filter (where hit) / count(*), 6) >= 0.6 as passed from j group by 1""")
def answer_feedback(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "rerank_candidates").select("request_id", F.col("content").alias("source"))
    return retrieval.feedback_coverage(_answers(spark, d).join(c, "request_id"), "message_id", "content", "source")


# ---------------------------------------------------------------- chunks and summaries


@query(f"""with c as (select doc_id, chunk_index, chunk, length(chunk) as n from ({_FIXED})),
   k as (select *, list_filter(range(0, 29), lambda k: n > 50 and 50 + (case when k % 2 = 1 then (k + 1) // 2 else -(k // 2) end) between 1 and n - 1
           and contains('。！？.!?' || chr(10), substring(chunk, 51 + (case when k % 2 = 1 then (k + 1) // 2 else -(k // 2) end), 1))) as ks from c),
   a as (select *, case when n <= 50 then 0 when len(ks) = 0 then 50 else 51 + (case when list_min(ks) % 2 = 1 then (list_min(ks) + 1) // 2 else -(list_min(ks) // 2) end) end as aligned from k),
   r as (select *, case when chunk_index > 0 then round(aligned / n, 3) else 0 end as overlap_ratio from a)
   select doc_id, chunk_index, cast(overlap_ratio as double) as overlap_ratio, case when chunk_index > 0 and overlap_ratio >= 0.5 then chunk_index - 1 end as near_duplicate_of from r""")
def doc_aligned_overlap(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunking.fixed_chunks(table(spark, d, "documents"), "doc_id", "text", 500, 50)
    return chunking.with_overlap(chunks, 50).select("doc_id", "chunk_index", "overlap_ratio", "near_duplicate_of")


@query()
def doc_map_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.map_chunks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query()
def doc_terms_summary(spark: SparkSession, d: str) -> DataFrame:
    """The ranked summary on the cosine of weighed words and pairs of words."""
    return summary.ranked_summary(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", by="terms")


_LEAD = f"select doc_id, text, l, not regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') as latin, list_transform(list_slice(l, 1, 3), lambda x: {_STRIP(x='x')}) as s from (select s.doc_id, s.l, d.text from ({_SENTENCES}) s join documents d using (doc_id))"


@query(f"""with b as ({_LEAD}), c as (select *, case when latin then array_to_string(s, ' ') else array_to_string(s, '') end as whole from b where len(l) > 0),
   t as (select *, substring(whole, 1, 150) as head from c), k as (select *, case when latin then {_last('head', '. ')} else {_last('head', '。')} end as pos from t)
   select doc_id, round(length(summary) / greatest(length(text), 1), 4) as ratio, summary from
   (select *, case when length(whole) <= 150 then whole when pos > 75 then substring(head, 1, cast(pos + 1 as bigint)) else regexp_replace(head, '\\s+$', '') || case when latin then '...' else '…' end end as summary from k)""")
def doc_lead_summary(spark: SparkSession, d: str) -> DataFrame:
    """The first three sentences put together and trimmed to 150 characters, with the compression."""
    t = table(spark, d, "documents").select("doc_id", "text", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    t = t.withColumn("latin", ~F.col("text").rlike(r"[\x{4e00}-\x{9fff}]"))
    whole = t.withColumn("whole", summary.assembled(F.slice("s", 1, 3), is_latin=F.col("latin")))
    cut = whole.withColumn("summary", summary.trimmed(F.col("whole"), 150, F.col("latin")))
    return cut.select("doc_id", summary.compression(F.col("summary"), F.col("text")).alias("ratio"), "summary")


@query(f"""with b as ({_LEAD}), p as (select doc_id, latin, list_slice(l, 1, 5) as l from b), e as (select doc_id, latin, cast(generate_subscripts(l, 1) - 1 as integer) as place, unnest(l) as s from p)
   select doc_id, place, case when latin then trim(substring(s, 1, 120)) || case when length(s) > 120 then '...' else '' end else trim(substring(s, 1, 80)) || case when length(s) > 80 then '…' else '' end end as point from e""")
def doc_key_points(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"), (~F.col("text").rlike(r"[\x{4e00}-\x{9fff}]")).alias("latin"))
    return t.select("doc_id", F.posexplode(summary.key_points(F.col("s"), F.col("latin"))).alias("place", "point"))


@query()
def kb_without_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Contents with code and tables told in a few words."""
    docs = table(spark, d, "kb_documents").select("doc_id", "content").dropDuplicates(["doc_id"])
    return docs.select("doc_id", summary.without_blocks(F.col("content")).alias("plain"))


@query()
def doc_nfkc(spark: SparkSession, d: str) -> DataFrame:
    """Texts in normal form, with whether that changed anything."""
    t = table(spark, d, "documents").select("doc_id", "text", T.normalise(T.nfkc(F.col("text"))).alias("normal"))
    return t.select("doc_id", F.md5("normal").alias("digest"), (F.col("normal") != F.col("text")).alias("changed"))


# ---------------------------------------------------------------- meetings

_DEADLINE = "coalesce(" + ", ".join(f"nullif(regexp_extract(line, '{p}', 1), '')" for p in meetings.DEADLINES) + ")"
_ACTION = " union all ".join(
    f"select meeting_id, line_no, line, {i} as no, {_STRIP(x=f"regexp_replace({_STRIP(x=f"regexp_extract(line, '{p}', 1)")}, '^[-*•0-9]+[.、．)\\s]*', '')")} as owner, {_STRIP(x=f"regexp_extract(line, '{p}', 2)")} as task from e"
    for i, p in enumerate(meetings.ACTIONS)
)
_NO_OWNERS = ", ".join(f"'{w}'" for w in meetings.NO_OWNERS)


@query(f"""with o as (select distinct on (meeting_id) meeting_id, meeting_transcript from meetings order by meeting_id),
  s as (select meeting_id, regexp_split_to_array(meeting_transcript, '\\r?\\n') as l from o),
  x as (select meeting_id, cast(generate_subscripts(l, 1) - 1 as integer) as line_no, {_STRIP(x='unnest(l)')} as line from s), e as (select * from x where length(line) > 0),
  a as ({_ACTION}), k as (select *, row_number() over (partition by meeting_id, owner, task order by line_no, no) as rn from a where length(task) >= 2 and length(owner) between 1 and 20 and lower(owner) not in ({_NO_OWNERS}))
  select meeting_id, owner, task, line_no, {_DEADLINE} as deadline, case when {_HAS["u"].replace("lower(line)", "lower(task)")} then 'high' when {_HAS["l"].replace("lower(line)", "lower(task)")} then 'low' else 'medium' end as priority from k where rn = 1""")
def meeting_action_items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "meetings").select("meeting_id", "meeting_transcript").dropDuplicates(["meeting_id"])
    return meetings.action_items(rows, "meeting_id", "meeting_transcript")


# ---------------------------------------------------------------- cleaning


@query(f"""with s as ({_SKILLS}), m as (select skill_name, quantile_disc(elapsed_ms, 0.5) as v from s where elapsed_ms is not null group by 1)
   select id, s.skill_name, coalesce(elapsed_ms, v) as elapsed_ms from s left join m on m.skill_name is not distinct from s.skill_name""")
def metric_imputed(spark: SparkSession, d: str) -> DataFrame:
    """Times that are missing, by the median of their skill."""
    return tables.imputed(_skills(spark, d).select("id", "skill_name", "elapsed_ms"), "elapsed_ms", ["skill_name"])


@query("""with o as (select chunk_id, min(metadata.category) as category from vector_records group by 1), m as (select category as v from o where category is not null group by 1 order by count(*) desc, 1 limit 1)
   select chunk_id, coalesce(category, v) as category from o left join m on true""")
def vector_categories_imputed(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vector_records").groupBy("chunk_id").agg(F.min("metadata.category").alias("category"))
    return tables.imputed_common(v, "category")


@query("""select cand_id, try_cast(nullif(regexp_extract(content, '([0-9]+\\.?[0-9]*)', 1), '') as double) as number from rerank_candidates""")
def candidate_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rerank_candidates").select("cand_id", T.first_number(F.col("content")).alias("number"))


@query("""with c as (select count(*) as n, count(*) filter (where v is null or lower(trim(v)) in ('', 'null', 'none', 'nan', 'n/a', 'na')) as k, c from
   (select unnest(['source', 'doc_id', 'original_score']) as c, unnest([source, doc_id, cast(original_score as varchar)]) as v from rerank_candidates) group by c)
   select count(*) filter (where k > 0 and k / n > 0.3) as high, count(*) filter (where k / n > 0.1 and k / n <= 0.3) as medium, count(*) filter (where k > 0 and k / n <= 0.1) as low, count(*) filter (where k > 0) as total from c""")
def candidate_severities(spark: SparkSession, d: str) -> DataFrame:
    """How many issues of each severity a profile of the candidates shows."""
    c = table(spark, d, "rerank_candidates").select("source", "doc_id", "original_score")
    return tables.severity_counts(tables.profile_issues(tables.profile(c, ["source", "doc_id", "original_score"])))


@query("""select chunk_id, metadata.doc_id as metadata_doc_id, metadata.kb_id as metadata_kb_id, metadata.category as metadata_category, metadata.chunk_index as metadata_chunk_index from vector_records""")
def vector_flattened(spark: SparkSession, d: str) -> DataFrame:
    return tables.flattened(table(spark, d, "vector_records").select("chunk_id", "metadata"), "metadata")


@query("""with o as (select distinct on (doc_id) doc_id, content, file_path from kb_documents order by doc_id)
   select doc_id, greatest(length(content) - length(replace(content, chr(10), '')) + case when length(content) > 0 and not ends_with(content, chr(10)) then 1 else 0 end
          - case when lower(regexp_extract(file_path, '(\\.[^./\\\\]+)$', 1)) in ('.csv', '.tsv') then 1 else 0 end, 0) as n_rows from o""")
def kb_row_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a file by its lines, less a heading in tables."""
    docs = table(spark, d, "kb_documents").select("doc_id", "content", "file_path").dropDuplicates(["doc_id"])
    heading = F.when(files.suffix(F.col("file_path")).isin(".csv", ".tsv"), 1).otherwise(0)
    return docs.select("doc_id", F.greatest(T.line_count(F.col("content")) - heading, F.lit(0)).cast("bigint").alias("n_rows"))


@query("""with o as (select distinct on (doc_id) doc_id, kb_id, lower(status) as s from kb_documents order by doc_id)
   select kb_id, count(*) filter (where s = 'indexed') as n_done, count(*) filter (where s = 'failed') as n_failed,
     case when count(*) filter (where s = 'failed') = 0 then 'success' when count(*) filter (where s = 'indexed') = 0 then 'failed' else 'partial' end as status from o group by kb_id""")
def kb_reindex_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "kb_documents").select("doc_id", "kb_id", F.lower("status").alias("s")).dropDuplicates(["doc_id"])
    done, failed = F.count_if(F.col("s") == "indexed"), F.count_if(F.col("s") == "failed")
    return docs.groupBy("kb_id").agg(
        done.alias("n_done"), failed.alias("n_failed"), F.when(failed == 0, "success").when(done == 0, "failed").otherwise("partial").alias("status")
    )


@query("""with o as (select distinct on (doc_id) doc_id, meta_json from kb_documents order by doc_id),
   p as (select doc_id, meta_json as a, regexp_extract(meta_json, '(?s)(\\{.*\\})', 1) as b from o)
   select doc_id, coalesce(case when json_valid(a) then try_cast(json_extract_string(a, '$.pages') as double) end, case when json_valid(b) then try_cast(json_extract_string(b, '$.pages') as double) end, 0.5) as score from p""")
def kb_json_scores(spark: SparkSession, d: str) -> DataFrame:
    """A number of a JSON text that may be broken or stand among other words, or a default."""
    docs = table(spark, d, "kb_documents").select("doc_id", "meta_json").dropDuplicates(["doc_id"])
    return docs.select("doc_id", T.json_score(F.col("meta_json"), "pages").alias("score"))


@query("""with o as (select distinct on (message_id) message_id, content from messages order by message_id)
   select message_id, regexp_replace(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as plain from o""")
def conv_without_markup(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("message_id", T.strip_html(F.col("content")).alias("plain"))


@query()
def kb_key_values(spark: SparkSession, d: str) -> DataFrame:
    """Named values found in free text."""
    docs = table(spark, d, "kb_documents").select("doc_id", "content").dropDuplicates(["doc_id"]).where("content is not null")
    return docs.select("doc_id", F.explode(files.key_value_pairs(F.col("content"))).alias("name", "value"))


@query("""select vec_id, list_transform(embedding::double[], lambda x: round(x / sqrt(list_inner_product(embedding::double[], embedding::double[])), 6)) as unit from embeddings""")
def vec_units(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.transform(V.unit(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


@query("""with r as (select n_nationkey + 1 as n, n_name from nation) select n_name, repeat('X', cast(n // 10 as integer)) || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][cast(n % 10 + 1 as integer)] as numeral from r""")
def nation_numerals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_name", T.roman(F.col("n_nationkey") + 1).alias("numeral"))


@query(f"""with s as ({_SKILLS}) select count(*) as n, count(distinct skill_name) as n_skills from s
   where json_extract_string(json_object('level', 'info', 'skill', skill_name), '$.level') = 'info'""")
def metric_log_records(spark: SparkSession, d: str) -> DataFrame:
    """Every metric as a log record, read again."""
    records = files.log_records(_skills(spark, d).withColumn("message", F.col("skill_name")), "info", "skill_run", "message", ["trace_id"], ["elapsed_ms", "skill_name"])
    read = records.where(F.get_json_object("record", "$.level") == "info").select(F.get_json_object("record", "$.data.skill_name").alias("s"))
    return read.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("n_skills"))


@query(f"""with f as (select skill_name, id, lower(status) <> 'success' as bad from ({_SKILLS})),
  r as (select *, row_number() over (partition by skill_name order by id) - sum(bad::int) over (partition by skill_name order by id) as run from f),
  k as (select skill_name, run, count(*) as n from r where bad group by 1, 2) select s.skill_name, count(k.n) filter (where k.n >= 3) as n_opened from (select distinct skill_name from f) s left join k on k.skill_name = s.skill_name group by 1""")
def metric_breaker_openings(spark: SparkSession, d: str) -> DataFrame:
    """How often three failures in a row have opened a skill's breaker."""
    s = _skills(spark, d).select("skill_name", "id", "status")
    runs = tables.streaks(s, "skill_name", "id", F.lower("status") != "success").where("n_failures >= 3").groupBy("skill_name").agg(F.count(F.lit(1)).alias("n"))
    return s.select("skill_name").distinct().join(runs, "skill_name", "left").select("skill_name", F.coalesce("n", F.lit(0)).alias("n_opened"))


# ---------------------------------------------------------------- graphs


@query(f"""with e as ({_EDGES}) select (select count(*) from (select source as n from e union select target from e)) as n_entities, (select count(*) from e) as n_relations, (select count(*) from region) as n_communities""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    nodes = e.select(F.col("source").alias("n")).union(e.select("target")).distinct().agg(F.count(F.lit(1)).alias("n_entities"))
    return nodes.join(e.agg(F.count(F.lit(1)).alias("n_relations"))).join(table(spark, d, "region").agg(F.count(F.lit(1)).alias("n_communities")))


@query(f"""with e as (select source, target, 'belongs' as description from ({_EDGES})), f as (select r_name as query, n_name as name, row_number() over (partition by r_name order by n_name) as rank from nation join region on n_regionkey = r_regionkey),
   a as (select query, 0 as part, row_number() over (partition by query order by rank, name) as n, '## Entities' || chr(10) as head, '- **' || name || '** (nation)' || chr(10) || '  ' || 'nation ' || name as line from f),
   x as (select distinct query, source, target, description from f join e on name = source or name = target),
   b as (select query, 1, row_number() over (partition by query order by source, target) as n, chr(10) || '## Relations' || chr(10), '- ' || source || ' → ' || target || ': ' || description from x),
   c as (select distinct query, 2, cast(1 as bigint), chr(10) || '## Reports' || chr(10), 'Report of ' || query from f),
   u as (select * from a where n <= 5 union all select * from b where n <= 10 union all select * from c)
   select query, substring(string_agg(case when n = 1 then head || line else line end, chr(10) order by part, n), 1, 600) as context from u group by query""")
def graph_local_context(spark: SparkSession, d: str) -> DataFrame:
    """What the graph of customers, suppliers and nations knows about each region's nations."""
    pairs = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = pairs.select(F.col("r_name").alias("query"), F.col("n_name").alias("name")).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("name")))
    entities = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("type"), F.concat(F.lit("nation "), F.col("n_name")).alias("description"))
    reports = pairs.select(F.col("n_name").alias("name"), F.concat(F.lit("Report of "), F.col("r_name")).alias("report"))
    return graph.local_context(found, "query", entities, _edges(spark, d).withColumn("description", F.lit("belongs")), reports, tokens=300)
