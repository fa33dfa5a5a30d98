"""DuckDB equivalents of the core queries."""

from __future__ import annotations

from corpusloom.functions.text import GENERIC_PAIRS
from corpusloom.plans.core_queries import SECRETS

ELEMENTS = """
cur as (select element_id, max_by(e, e.loaded_at) r from elements e where processing_version_id is not null and element_id is not null group by element_id),
el as (select r.* from cur)"""
CASES = """
cur as (select case_id, max_by(c, c.loaded_at) r from mapped_cases c where case_id is not null group by case_id),
ca as (select r.* from cur)"""
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]')"
PATH = "coalesce(array_to_string(list_transform(heading_path, lambda x: coalesce(x, chr(0))), chr(31)), '')"
GENERIC = "[" + ", ".join(f"'{p}'" for p in GENERIC_PAIRS) + "]"
BIGRAMS = """list_filter(list_distinct(list_concat(
  list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z][a-z0-9_.]*|[0-9]+(?:\\.[0-9]+)?'), lambda w: length(w) >= 2),
  flatten(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'),
    lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))), lambda g: not list_contains(GENERIC, g))""".replace("GENERIC", GENERIC)
BLANK = "regexp_replace(raw_text, '^[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+|[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+$', '', 'g')"


def bm25(queries: str, texts: str, k: int, key: str = "doc_id") -> str:
    """CTEs up to ``keyword (query_id, key, score, rank)``, from CTEs ``queries`` and ``texts (key, text)``."""
    return f"""
bq as (select query_id, unnest(list_distinct({TOKENS.format("query_text")})) term from {queries}),
bt as (select {key}, {TOKENS.format("text")} tokens from {texts}),
bl as (select {key}, len(tokens) dl from bt where len(tokens) > 0),
bs as (select count(*) n, avg(dl) avgdl from bl),
bp as (select term, {key}, count(*) tf from (select {key}, unnest(tokens) term from bt) group by all),
bf as (select term, count(*) df from bp where term in (select term from bq) group by term),
bscore as (
  select q.query_id, p.{key},
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score
  from bq q join bp p using (term) join bf using (term) join bl using ({key}), bs group by all),
keyword as (
  select * from (select *, row_number() over (partition by query_id order by score desc, {key}) rank from bscore) where rank <= {k})"""


def dense(k: int) -> str:
    """CTEs up to ``dense (query_id, vec_id, score, rank)``."""
    return f"""
dscore as (
  select q.vec_id query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) score
  from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0),
dense as (
  select * from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from dscore) where rank <= {k})"""


#: Cases whose number, the last four hexadecimal digits of the id, is divisible by 50.
CASE_SET = "case_id is not null and regexp_matches(case_id, '[0-9a-f]{4}$') and ('0x' || right(case_id, 4))::int % 50 = 0"
LATEST_TITLES = """lt as (select document_id, max_by(c, (c.loaded_at, c.source_path, c.title, c.doc_format, c.knowledge_base, c.product_version)) r from catalog_entries c where document_id is not null group by 1),
titles as (select document_id, r.title title, r.title text, r.source_path source_path from lt)"""
RANKINGS = f"""{CASES}, {LATEST_TITLES},
asked as (select case_id query_id, question query_text from ca where answerable and {CASE_SET}),
gold as (select distinct case_id query_id, unnest(reference_document_ids) key from ca where answerable and {CASE_SET}),
{bm25("asked", "titles", 5, "document_id")},
top as (select query_id, document_id key, rank from keyword),
sizes as (select query_id, count(*) retrieved from top group by all),
hits as (select g.query_id, count(*) relevant, count(rank) hits, min(rank) first from gold g left join top t using (query_id, key) group by all),
scores as (
  select query_id, round(hits / relevant, 6) recall, round(coalesce(hits / retrieved, 0), 6) "precision", round(coalesce(1.0 / first, 0), 6) reciprocal_rank
  from hits left join sizes using (query_id))"""


HYBRID = f"""{dense(10)},
docs as (select * from documents),
asked as (select doc_id query_id, title query_text from docs where doc_id % 50 = 0 and title is not null),
{bm25("asked", "docs", 10)},
parts as (select query_id, vec_id doc_id, 1.0 / (60 + rank) part from dense union all select query_id, doc_id, 1.0 / (60 + rank) from keyword),
fused as (select query_id, doc_id, round(sum(part::double), 9) score from parts group by all),
best as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from fused) where rank <= 5)"""
LINES = """lines as (
  select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(1, len(string_split(text, chr(10))) + 1)) n from documents)"""
SECTIONS = f"""{LINES}, f as (select *, coalesce(sum(cast(starts_with(ltrim(line, ' '), '```') as int)) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) % 2 shut from lines),
h as (select *, shut = 0 and regexp_matches(line, '^#{{1,6}}[ \\t]+\\S') head from f),
s as (select *, sum(cast(head as int)) over (partition by doc_id order by n) section_no from h),
sections as (
select doc_id, cast(section_no as bigint) section_no, cast(coalesce(max(case when head then length(regexp_extract(line, '^(#+)', 1)) end), 0) as int) "level",
  max(case when head then trim(regexp_extract(line, '^#+[ \\t]+(.*)$', 1), ' ') end) title, cast(min(n) as int) line_start, cast(max(n) as int) line_end from s group by doc_id, section_no)"""
TABLE_ROWS = """with l as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(1, len(string_split(text, chr(10))) + 1)) n from documents),
r as (select doc_id, n, trim(line, ' ') line from l),
c as (select doc_id, n, list_transform(string_split(substr(line, 2, length(line) - 2), '|'), lambda x: trim(x, ' ')) cells from r
  where line like '|%|' and length(line) > 2 and not regexp_full_match(line, '[|: -]+'))
select doc_id, cast(n as int) line_no, cast(len(cells) as int) cells, cells[1] first_cell from c"""
#: Patterns of the secret scan as RE2 spells them; the same as in Java.
SECRET_SQL = " union all ".join(f"select doc_id, '{n}' pattern, len(regexp_extract_all(text, '{p}')) hits from documents" for n, p in sorted(SECRETS.items()))


def core_oracle_sql() -> dict[str, str]:
    tokens = TOKENS.format("text")
    return {
        "hybrid_retrieval": f"with {HYBRID} select query_id, best.doc_id, score, cast(rank as int) rank, title from best left join docs using (doc_id)",
        "context_budget": f"""with {HYBRID}, sized as (select query_id, rank, doc_id, length(trim(text, ' ')) size from best join documents using (doc_id) where length(trim(text, ' ')) > 0),
r as (select *, 2000 - coalesce(sum(size) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) room from sized)
select query_id, cast(rank as int) rank, doc_id, cast(least(size, room) as bigint) used, size > room cut from r where room > 0""",
        "heading_sections": f"""with {SECTIONS} select * from sections""",
        "heading_paths": f"""with {SECTIONS}, hs as (select * from sections where level > 0)
select s.doc_id, s.section_no, string_agg(a.title, ' > ' order by a.section_no) heading_path
from hs s join hs a on a.doc_id = s.doc_id and a.section_no <= s.section_no
where not exists (select 1 from hs b where b.doc_id = s.doc_id and b.section_no > a.section_no and b.section_no <= s.section_no and b.level <= a.level)
group by s.doc_id, s.section_no""",
        "text_paragraphs": f"""with {LINES}, b as (select *, trim(line, ' ') = '' blank from lines),
f as (select *, not blank and coalesce(lag(blank) over (partition by doc_id order by n), true) fresh from b),
p as (select *, sum(cast(fresh as int)) over (partition by doc_id order by n) paragraph_no from f)
select doc_id, cast(paragraph_no as bigint) paragraph_no, cast(min(n) as int) line_start, cast(max(n) as int) line_end, cast(sum(length(line)) as bigint) characters from p where not blank group by doc_id, paragraph_no""",
        "html_table_rows": """with r as (select doc_id, regexp_extract_all(text, '(?is)<tr(?:\\s[^>]*)?>(.*?)</tr>', 1) rows from documents),
u as (select doc_id, unnest(rows) html, unnest(range(1, len(rows) + 1)) n from r), c as (select doc_id, n, regexp_extract_all(html, '(?is)<t[dh](?:\\s[^>]*)?>(.*?)</t[dh]>', 1) cells from u)
select doc_id, cast(n as int) row_no, cast(len(cells) as int) cells, cells[1] first_cell from c""",
        "secret_scan": f"select doc_id, pattern, cast(hits as int) hits from ({SECRET_SQL}) where hits > 0",
        "content_hashes": "select doc_id, sha256(text) sha256, cast(octet_length(encode(text)) as int) bytes from documents",
        "catalog_duplicates": """select document_id, count(*) deliveries, count(distinct sha256) contents, count(distinct split) splits from catalog_entries group by 1 having count(*) > 1""",
        "catalog_page": """select document_id, max(title) title from catalog_entries where document_id is not null group by 1 order by title nulls first, document_id limit 20 offset 20""",
        "document_set_audit": """with a as (select document_id from catalog_entries union select document_id from processing_versions union select document_id from elements),
f as (select document_id in (select document_id from catalog_entries) in_catalog, document_id in (select document_id from processing_versions) in_versions, document_id in (select document_id from elements) in_elements
  from a where document_id is not null)
select in_catalog, in_versions, in_elements, count(*) documents from f group by all""",
        "section_page_span": f"""with {ELEMENTS} select processing_version_id, heading_path[-1] section, min(source.page_number) first_page, max(source.page_number) last_page, count(*) elements
from el where source.kind = 'pdf' and len(heading_path) > 0 group by 1, 2""",
        "title_categories": """select case when lower(title) like '%故障处理%' or lower(title) like '%troubleshooting%' then 'troubleshooting' when lower(title) like '%参数%' or lower(title) like '%parameter reference%' then 'reference'
  when lower(title) like '%升级%' or lower(title) like '%upgrade%' then 'upgrade' when lower(title) like '%部署%' or lower(title) like '%deployment%' then 'deployment' else 'other' end category,
  count(*) documents, count(title) titled from documents group by 1""",
        "event_percentiles": """with v as (select event_type, list_sort(list(round(value, 2))) s from events where value is not null group by 1)
select event_type, s[1 + cast(round_even((len(s) - 1) * 0.5::double, 0) as int)] p50, s[1 + cast(round_even((len(s) - 1) * 0.95::double, 0) as int)] p95 from v""",
        "dense_search": f"with {dense(5)} select query_id, vec_id, score, cast(rank as int) rank from dense",
        "bm25_search": f"""with asked as (select item_id query_id, text query_text from heldout_items where item_id % 50 = 0), {bm25("asked", "documents", 5)}
select query_id, doc_id, score, cast(rank as int) rank from keyword""",
        "bm25_statistics": f"""with t as (select doc_id, unnest({tokens}) term from documents), p as (select term, doc_id, count(*) tf from t group by all),
l as (select doc_id, sum(tf) dl from p group by all)
select (select count(*) from l) docs, (select count(distinct term) from p) terms, (select count(*) from p) postings, (select round(avg(dl), 6) from l) avgdl""",
        "search_token_counts": f"""with t as (select doc_id, unnest({tokens}) term from documents)
select term, count(distinct doc_id) documents, count(*) occurrences from t group by term""",
        "vector_labels": """select label, count(*) vectors, round(avg(list_inner_product(embedding::double[], embedding::double[])), 6) mean_square,
  count(*) filter (embedding is null or len(embedding) <> 64 or len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0 or len(list_filter(embedding, lambda x: x <> 0)) = 0) violations
from embeddings group by label""",
        "title_relevance": f"""select doc_id, cast(len({BIGRAMS.format("title")}) as int) title_terms, cast(len(list_intersect({BIGRAMS.format("title")}, {BIGRAMS.format("text")})) as int) held_terms
from documents where title is not null""",
        "catalog_latest": """select document_id, r.source_path, r.title, r.doc_format, r.knowledge_base, r.product_version, r.loaded_at
from (select document_id, max_by(c, c.loaded_at) r from catalog_entries c where document_id is not null group by 1)""",
        "catalog_upsert": """select document_id, r.title, r.doc_format, r.loaded_at
from (select document_id, max_by(c, (c.loaded_at, c.doc_format = 'md')) r from catalog_entries c where document_id is not null and doc_format is not null group by 1)""",
        "catalog_allowed": "select distinct document_id, title, doc_format from catalog_entries where lower(trim(split, ' ')) = 'dev' and doc_format in ('md', 'txt')",
        "catalog_formats": """select doc_format, selection_bucket, count(*) deliveries, count(distinct document_id) documents, max(selection_score) best_score
from catalog_entries group by 1, 2""",
        "hash_split": """with k as (select distinct coalesce(group_id, document_id) group_key from catalog_entries),
b as (select group_key, cast(('0x' || sha256(cast(to_json(group_key) as varchar))[1:16])::ubigint % 10 as int) bucket from k where group_key is not null)
select group_key, bucket, case when bucket < 6 then 'dev' else 'test' end split_name from b""",
        "split_leakage": """select sha256, count(distinct lower(trim(split, ' '))) splits from catalog_entries where sha256 is not null and split is not null group by 1 having count(distinct lower(trim(split, ' '))) > 1""",
        "capped_selection": """with l as (select document_id, max_by(c, (c.loaded_at, c.selection_bucket, c.selection_score)) r from catalog_entries c where document_id is not null group by 1),
s as (select document_id, r.selection_bucket selection_bucket, r.selection_score selection_score from l where r.selection_bucket is not null and r.selection_score is not null)
select * from (select document_id, selection_bucket, selection_score, cast(row_number() over (partition by selection_bucket order by selection_score desc, document_id) as int) place from s) where place <= 3""",
        "round_robin_subset": """with l as (select document_id, max_by(c, (c.loaded_at, c.selection_bucket, c.selection_score)) r from catalog_entries c where document_id is not null group by 1),
s as (select document_id, r.selection_bucket selection_bucket, r.selection_score selection_score from l where r.selection_bucket is not null and r.selection_score is not null),
t as (select document_id, selection_bucket, cast(row_number() over (partition by selection_bucket order by selection_score desc, document_id) as int) turn from s)
select * from t order by turn, selection_bucket limit 40""",
        "group_signatures": """select source_revision, count(distinct document_id) documents, count(distinct doc_format) formats, count(distinct source_family) families, bool_and(title is not null) titled
from catalog_entries group by 1""",
        "revision_components": """with recursive e as (select distinct sha256 h, document_id d from catalog_entries where document_id is not null and sha256 is not null),
low as (select h, min(d) m from e group by h), pairs as (select distinct e.d x, low.m y from e join low using (h)),
both_ways as (select x, y from pairs union select y, x from pairs),
reach(n, root) as (select distinct d, d from e union select b.y, r.root from reach r join both_ways b on b.x = r.n where r.root < b.y),
parts as (select n, min(root) root from reach group by n)
select 'd' || root component, count(*) documents from parts group by root having count(*) > 1""",
        "element_counts": "select kind, source.kind source_kind, count(*) deliveries, count(distinct element_id) elements from elements group by 1, 2",
        "element_eligibility": f"""with {ELEMENTS}, t as (select element_id, coalesce({BLANK}, '') <> '' or image_ref is not null ok from el)
select element_id, ok index_eligible, case when not ok then 'empty_element' end excluded_reason from t""",
        "location_violations": f"""with {ELEMENTS}, t as (select element_id, case
  when source is null or coalesce(source.kind not in ('text', 'pdf', 'image'), true) then 'location_kind'
  when source.kind = 'pdf' and coalesce(source.page_number < 1, true) then 'location_page'
  when source.kind = 'text' and coalesce(source.line_start < 1 or source.line_end < source.line_start, true) then 'location_lines'
  when source.precision_level = 'region' and source.bbox is null then 'location_region'
  when source.bbox is not null and not coalesce(source.bbox.x0 >= 0 and source.bbox.x0 < source.bbox.x1 and source.bbox.x1 <= 1
    and source.bbox.y0 >= 0 and source.bbox.y0 < source.bbox.y1 and source.bbox.y1 <= 1, false) then 'location_box' end error_code from el)
select * from t where error_code is not null""",
        "heading_runs": f"""with {ELEMENTS},
m as (select *, coalesce(cast(lag(p) over w <> p as int), 1) fresh from (select *, {PATH} p from el) window w as (partition by processing_version_id order by ordinal, element_id)),
r as (select *, sum(fresh) over (partition by processing_version_id order by ordinal, element_id) run_no from m)
select processing_version_id, cast(run_no as bigint) run_no, min(ordinal) first_ordinal, max(ordinal) last_ordinal, count(*) elements, cast(sum(length(coalesce(raw_text, ''))) as bigint) characters
from r group by processing_version_id, run_no""",
        "adjacent_elements": f"""with {ELEMENTS}, t as (select *, {PATH} p from el)
select a.element_id, b.element_id neighbour_id, abs(a.ordinal - b.ordinal) distance from t a join t b on a.processing_version_id = b.processing_version_id and a.p = b.p
where a.kind = 'image' and abs(a.ordinal - b.ordinal) = 1""",
        "visual_context": f"""with {ELEMENTS}, t as (select *, last_value(case when kind <> 'image' and raw_text <> '' then raw_text end ignore nulls)
  over (partition by processing_version_id order by ordinal, element_id rows between unbounded preceding and 1 preceding) context from el)
select element_id, context from t where kind = 'image'""",
        "ordinal_contiguity": f"""with {ELEMENTS} select processing_version_id, count(*) elements, min(ordinal) = 0 and max(ordinal) = count(*) - 1 and count(distinct ordinal) = count(*) contiguous
from el group by 1""",
        "text_length_stats": f"""with {ELEMENTS} select kind, count(*) texts, min(length(raw_text))::int shortest, max(length(raw_text))::int longest, round(avg(length(raw_text)), 4) mean_size, count_if(length(raw_text) < 40)::bigint short_texts
from el where raw_text is not null group by kind""",
        "version_audit": f"""with {ELEMENTS}, s as (select processing_version_id, max_by(v, (v.created_at, v.element_count)).element_count element_count from processing_versions v where processing_version_id is not null group by 1),
a as (select processing_version_id, count(*) elements from el group by 1)
select processing_version_id, element_count, coalesce(elements, 0) elements from s full join a using (processing_version_id) where element_count is distinct from elements""",
        "processing_summary": """select parser_version, count(distinct processing_version_id) versions, count_if(warning_count > 0)::bigint with_warnings, count_if(updated_at < created_at)::bigint backdated,
  cast(sum(cast(json_extract_string(processing_profile, '$.dpi') as bigint)) as bigint) dpi_sum from processing_versions group by 1""",
        "page_headings": f"""with {ELEMENTS}, p as (select *, source.page_number page from el where source.kind = 'pdf'),
h as (select processing_version_id, page, max(raw_text) heading from p where kind = 'heading' and raw_text is not null group by 1, 2),
j as (select p.element_id, p.page, h.heading, h.page marked from p left join h on h.processing_version_id = p.processing_version_id and h.page <= p.page where p.kind = 'text')
select element_id, page, coalesce(arg_max(heading, marked), 'Front matter') heading from j group by element_id, page""",
        "missing_references": """select distinct d document_id from (select unnest(reference_document_ids) d from mapped_cases)
where d is not null and d not in (select document_id from catalog_entries where doc_format in ('md', 'txt') and document_id is not null)""",
        "evidence_status": f"""with {CASES}, m as (select case_type, unnest(evidence_mappings) m from ca)
select case_type, m.status status, count(*) mappings, cast(sum(len(m.chunk_ids)) as bigint) chunks from m group by 1, 2""",
        "retrieval_metrics": f"with {RANKINGS} select * from scores",
        "metrics_by_type": f"""with {RANKINGS} select case_type, count(*) cases, round(avg(recall), 6) mean_recall, round(avg("precision"), 6) mean_precision, round(avg(reciprocal_rank), 6) mean_reciprocal_rank
from scores join ca on ca.case_id = scores.query_id group by case_type""",
        "gold_violations": f"""with {CASES}, t as (select case_id, case when case_id = '' then 'case_id_missing' when trim(coalesce(question, ''), ' ') = '' then 'question_missing'
  when coalesce(answerable, false) and trim(coalesce(reference_answer, ''), ' ') = '' then 'answer_missing' when coalesce(answerable, false) and coalesce(len(chunk_ids), 0) = 0 then 'evidence_missing'
  when not coalesce(answerable, false) and coalesce(len(chunk_ids), 0) > 0 then 'evidence_unexpected' end error_code from ca)
select * from t where error_code is not null""",
        "document_titles": """select doc_id, coalesce(nullif(trim(regexp_extract(text, '(?m)^title:[ \\t]*([^\\n]+)$', 1), ' "'), ''), nullif(trim(regexp_extract(text, '(?m)^#[ \\t]+([^\\n]+)$', 1), ' "'), ''), title, 'document ' || doc_id) title from documents""",
        "table_rows": TABLE_ROWS,
        "paragraph_counts": f"""select lang, count(*) documents, cast(sum(len(list_filter(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda p: trim(p, ' ') <> ''))) as bigint) paragraphs, cast(sum(len({tokens})) as bigint) tokens
from documents group by lang""",
        "source_distinct": "select source, count(*) documents, count(distinct text) texts, max(n_chars) longest from documents group by source",
        "event_windows": "select date_trunc('hour', ts) window_start, event_type, count(*) n from events group by 1, 2",
        "event_stream": """select event_type, count(*) events, round(avg(value), 6) mean_value, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) k_sum
from (select distinct on (event_id) * from events where event_id is not null) group by 1""",
        "user_state": """select user_id, max_by(e, (e.ts, e.event_id)).event_type event_type, max_by(e, (e.ts, e.event_id)).event_id event_id, count(*) events from events e where user_id is not null group by 1""",
    }
