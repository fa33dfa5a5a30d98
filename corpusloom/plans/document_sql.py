"""DuckDB equivalents of the queries of parsing, image evidence, index scopes and answer scores."""

from __future__ import annotations

from corpusloom.plans.core_sql import BIGRAMS, BLANK, CASE_SET, CASES, ELEMENTS, HYBRID, LATEST_TITLES, SECTIONS, TABLE_ROWS, TOKENS, core_oracle_sql

VERSIONS = """vs as (select processing_version_id, max_by(v, (v.created_at, v.document_id, v.version_id, v.parser_version, v.profile_sha256, v.processing_profile, v.quality_status, v.release_status,
  v.element_count, v.warning_count, v.updated_at)) r from processing_versions v where processing_version_id is not null group by 1), ve as (select r.* from vs)"""
IMAGES = f"""{ELEMENTS}, {VERSIONS}, im as (select element_id, el.document_id, el.processing_version_id, ordinal, image_ref, raw_text, coalesce(array_to_string(heading_path, ' / '), '') path, source.source_path source_path
  from el join ve using (processing_version_id) where image_ref is not null and el.document_id is not null and release_status = 'active')"""
STATUS = """case when {0} is null then null when regexp_matches({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)|[?#\\\\]') then 'external_or_invalid_reference'
  when regexp_matches({0}, '(?:^|/)\\.\\.(?:/|$)') then 'unsafe_reference'
  when lower(regexp_extract({0}, '\\.([^./]+)$', 1)) not in ('png', 'jpg', 'jpeg') then 'unsupported_image_format' else 'ready' end"""
REFUSING = "regexp_matches(coalesce(answer, ''), '无法|不能|不足|没有足够|需要明确')"


def shared(text: str, latin: float, other: float) -> str:
    hits = f"list_intersect(asked, {BIGRAMS.format(text)})"
    named = f"len(list_filter({hits}, lambda t: regexp_full_match(t, '[a-z0-9_.-]+')))"
    return f"({named} * {latin} + (len({hits}) - {named}) * {other})"


def oracle_sql() -> dict[str, str]:
    duplicates = "select document_id, count(*) n from catalog_entries where document_id is not null group by 1 having count(*) > 1"
    return {
        "image_references": f"""with r as (select doc_id, text, unnest(regexp_extract_all(text, '!\\[([^\\]]*)\\]\\(([^)\\s]+)[^)]*\\)|<img[^>]+src=["'']([^"'']+)["'']')) whole from documents)
select doc_id, cast(row_number() over (partition by doc_id order by strpos(text, whole)) as int) reference_no,
  cast(1 + len(text[1:strpos(text, whole) - 1]) - len(replace(text[1:strpos(text, whole) - 1], chr(10), '')) as int) line_no, regexp_extract(whole, '!\\[([^\\]]*)\\]', 1) alt,
  regexp_extract(whole, '\\]\\(([^)\\s]+)', 1) target, {STATUS.format("regexp_extract(whole, '\\]\\(([^)\\s]+)', 1)")} status from r""",
        "linked_documents": f"""with {LATEST_TITLES}, l as (select distinct doc_id, unnest(regexp_extract_all(text, '\\]\\(/?([^)#\\s]+\\.md)(?:#[^)]*)?\\)', 1)) path from documents)
select doc_id, document_id from l join titles on titles.source_path = l.path""",
        "row_sections": f"""with {SECTIONS}, rows_there as ({TABLE_ROWS}) select r.doc_id, r.line_no, min(s.section_no) section_no from rows_there r join sections s
on s.doc_id = r.doc_id and r.line_no between s.line_start and s.line_end group by all""",
        "path_safety_gate": """with one as (select document_id, count(*) n, max_by(c, (c.loaded_at, c.source_path, c.doc_format, c.split)) r from catalog_entries c where document_id is not null group by 1),
p as (select document_id, n, r.source_path path, r.doc_format f, lower(trim(r.split, ' ')) split, string_split(r.source_path, '/')[-1] name from one)
select document_id, case when n > 1 then 'manifest_conflict' when coalesce(split, '') <> 'dev' then 'split_not_allowed'
  when path is null or path like '/%' or contains(path, ':') or contains(path, chr(92)) or contains(path, chr(0)) or list_contains(string_split(path, '/'), '..') or name = '' or length(name) > 180 then 'unsafe_path'
  when not coalesce(f in ('md', 'txt', 'pdf') and lower(regexp_extract(path, '(\\.[^./]+)$', 1)) = '.' || f, false) then 'unsupported_format' end reject_code from p""",
        "source_groups": f"""with {ELEMENTS} select regexp_replace(regexp_replace(string_split(image_ref, '/')[-1], '\\.[^.]+$', ''), '(_page_[0-9]+|_[0-9]+)$', '') source_group, count(*) images, count(distinct document_id) documents
from el where image_ref is not null group by 1""",
        "version_page": f"""with {VERSIONS} select processing_version_id, release_status, coalesce(updated_at, created_at) "at", (select count(*) from ve) total from ve
order by coalesce(release_status = 'active', false) desc, coalesce(updated_at, created_at) desc, processing_version_id limit 20 offset 20""",
        "knowledge_overview": f"""with {ELEMENTS}, {VERSIONS}, {LATEST_TITLES},
n as (select document_id, count(*) versions, max_by(ve, (created_at, processing_version_id)) r from ve where document_id is not null group by 1),
c as (select document_id, count(*) elements from el where document_id is not null group by 1)
select document_id, title, coalesce(versions, 0) versions, coalesce(elements, 0) elements, r.processing_version_id latest_version, r.release_status release_status
from titles left join n using (document_id) left join c using (document_id)""",
        "reusable_processing": f"""with {ELEMENTS}, {VERSIONS}, c as (select processing_version_id, count(*) elements from el group by 1),
r as (select *, row_number() over (partition by document_id order by case release_status when 'active' then 0 when 'draft' then 1 else 2 end, coalesce(updated_at, created_at) desc, processing_version_id desc) place
  from ve join c using (processing_version_id) where document_id is not null)
select document_id, processing_version_id, release_status, elements from r where place = 1""",
        "title_images": f"""with {IMAGES}, {LATEST_TITLES},
a as (select *, {STATUS.format("image_ref")} status, case when image_ref like '/%' then ltrim(image_ref, '/') else regexp_extract(source_path, '^(.*/)[^/]*$', 1) || image_ref end asset_path from im),
p as (select *, row_number() over (partition by document_id, status, asset_path order by ordinal, element_id) place from a)
select title, element_id, asset_path, status from p join titles using (document_id) where status <> 'ready' or place = 1""",
        "diverse_images": f"""with {IMAGES}, w as (select *, row_number() over s depth, first_value(ordinal) over s opens from im window s as (partition by processing_version_id, path order by ordinal, element_id)),
t as (select *, row_number() over (partition by processing_version_id order by depth, opens, path) place from w)
select processing_version_id, element_id, cast(place as int) place from t where place <= 3""",
        "visual_selection": f"""with {IMAGES}, {LATEST_TITLES}, {CASES.replace("cur ", "curc ").replace("from cur)", "from curc)")},
q as (select distinct case_id query_id, question, unnest(reference_document_ids) document_id from ca where {CASE_SET}),
s as (select query_id, document_id, case when coalesce(title, '') <> '' then replace(question, title, ' ') else question end question from q join titles using (document_id)),
near as (select element_id, last_value(case when kind <> 'image' and raw_text <> '' then raw_text end ignore nulls)
  over (partition by processing_version_id order by ordinal, element_id rows between unbounded preceding and 1 preceding) near, kind from el),
j as (select query_id, im.element_id, ordinal, lower(question) question, {BIGRAMS.format("question")} asked, concat_ws(' ', raw_text, image_ref, path) own, near.near near
  from s join im using (document_id) left join near on near.element_id = im.element_id and near.kind = 'image'),
sc as (select *, round({shared("own", 3.0, 1.5)} + {shared("near", 2.5, 1.25)}
  + 12.0 * len(list_filter(regexp_extract_all(question, '[“''"]([^”''"]+)[”''"]', 1), lambda x: length(trim(x, ' ')) >= 2 and contains(lower(own), x))), 4) score from j),
p as (select *, row_number() over (partition by query_id order by score desc, ordinal, element_id) place from sc),
m as (select *, max(case when place = 1 then score end) over (partition by query_id) best, max(case when place = 2 then score end) over (partition by query_id) runner_up from p)
select query_id, element_id, cast(score as double) score, cast(place as int) place from m where place <= case when best >= 8 and (runner_up is null or best - runner_up >= 2.5) then 1 else 3 end""",
        "evidence_locations": f"""with {ELEMENTS} select element_id, case when source.kind = 'text' then concat_ws(':', source.source_path, concat_ws('-', source.line_start, source.line_end))
  else concat_ws('#', source.source_path, source.page_number) end "location", array_to_string(heading_path, ' / ') headings from el""",
        "page_labels": f"""with {ELEMENTS} select element_id, source.page_number page, trim(raw_text, ' ') label from el where source.kind = 'pdf' and regexp_full_match(trim(raw_text, ' '), '[0-9]+')""",
        "box_pixels": f"""with {ELEMENTS}, b as (select element_id, source.bbox b, source.image_width w, source.image_height h from el)
select element_id, round(b.x0 * w, 3) x0, round(b.y0 * h, 3) y0, round(b.x1 * w, 3) x1, round(b.y1 * h, 3) y1 from b where b is not null and w is not null and h is not null""",
        "version_gates": f"""with {ELEMENTS}, {VERSIONS}, s as (select processing_version_id, count(*) n, min(ordinal) = 0 and max(ordinal) = count(*) - 1 and count(distinct ordinal) = count(*) contiguous,
  bool_and(coalesce(trim(source.source_path, ' ') <> '', false)) sourced, bool_or(coalesce({BLANK}, '') <> '' or image_ref is not null) indexable from el group by 1),
g as (select processing_version_id, coalesce(element_count = n, false) counted, coalesce(contiguous, false) contiguous, coalesce(sourced, false) sourced, coalesce(indexable, false) indexable from ve left join s using (processing_version_id))
select *, counted and contiguous and sourced and indexable passed from g""",
        "quality_verdicts": f"""with {ELEMENTS}, {VERSIONS}, s as (select processing_version_id, count(*) n, count(*) filter (coalesce({BLANK}, '') <> '' or image_ref is not null) eligible,
  count(*) filter (coalesce(trim(source.source_path, ' '), '') = '') unsourced, count(*) filter (kind = 'image' and image_ref is null) imageless from el group by 1),
r as (select processing_version_id,
  concat_ws(',', case when imageless > 0 then 'missing_image_reference' end, case when unsourced > 0 then 'missing_source_path' end, case when n is null then 'no_elements' end, case when eligible = 0 then 'no_indexable_elements' end) blocking_reasons,
  concat_ws(',', case when eligible < n then 'empty_parsed_element' end, case when warning_count > 0 then 'parser_warnings' end) review_reasons from ve left join s using (processing_version_id))
select processing_version_id, case when blocking_reasons <> '' then 'blocked' when review_reasons <> '' then 'needs_review' else 'candidate' end verdict, blocking_reasons, review_reasons from r""",
        "manifest_hashes": f"""with {ELEMENTS} select processing_version_id, count(*) elements, sha256(string_agg(element_id, chr(10) order by ordinal nulls first, element_id)) ids_sha256 from el group by 1""",
        "scope_changes": """with h as (select distinct parser_version, document_id from processing_versions where release_status = 'active' and document_id is not null),
a as (select distinct parser_version, document_id from processing_versions where release_status = 'draft' and document_id is not null),
u as (select * from h union select * from a), b as (select * from h intersect select * from a), o as (select * from h except select * from a),
g as (select p.parser_version, (select count(*) from h where h.parser_version = p.parser_version) held, (select count(*) from a where a.parser_version = p.parser_version) asked,
  (select count(*) from b where b.parser_version = p.parser_version) kept, (select count(*) from u where u.parser_version = p.parser_version) united,
  (select count(*) from o where o.parser_version = p.parser_version) omitted from (select distinct parser_version from u) p)
select *, omitted = 0 and asked > held strict_superset from g""",
        "rebuild_plan": """with l as (select document_id, max_by(c, (c.loaded_at, c.sha256, c.knowledge_base)) r from catalog_entries c where document_id is not null group by 1),
s as (select r.knowledge_base knowledge_base, exists (select 1 from catalog_entries e where e.document_id = l.document_id and e.sha256 = l.r.sha256 and e.loaded_at < l.r.loaded_at) reused from l)
select knowledge_base, count(*) documents, count_if(reused)::bigint reused, (count(*) - count_if(reused))::bigint "generated", cast(ceil((count(*) - count_if(reused)) / 10) as bigint) requests from s group by 1""",
        "vector_coverage": """with bad as (select vec_id from embeddings where embedding is null or len(embedding) <> 64 or len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0 or len(list_filter(embedding, lambda x: x <> 0)) = 0)
select (select count(distinct doc_id) from documents) needed, (select count(distinct doc_id) from documents where doc_id in (select vec_id from embeddings) and doc_id not in (select vec_id from bad)) covered,
  (select count(distinct doc_id) from documents where doc_id not in (select vec_id from embeddings)) missing,
  (select count(distinct vec_id) from embeddings where vec_id not in (select doc_id from documents)) superfluous, (select count(distinct vec_id) from bad) broken""",
        "reranked_retrieval": f"""with {HYBRID}, t as (select b.query_id, b.doc_id, b.rank was, list_distinct({TOKENS.format("q.title")}) asked, {TOKENS.format("d.text")} tokens
  from best b join documents d on d.doc_id = b.doc_id left join documents q on q.doc_id = b.query_id where trim(d.text, ' ') <> ''),
s as (select query_id, doc_id, was, case when len(asked) > 0 then round(len(list_intersect(asked, tokens)) / len(asked), 6) end score from t),
p as (select *, row_number() over (partition by query_id order by score desc nulls last, was, doc_id) rank from s) select query_id, doc_id, score, cast(rank as int) rank from p where rank <= 10""",
        "citation_metrics": f"""with {CASES}, a as (select case_id, coalesce(answerable, false) answerable, reference_answer answer, coalesce(evidence_mappings, []) m, list_distinct(coalesce(source_evidence_ids, [])) gold from ca),
n as (select *, list_distinct(list_concat(list_transform(regexp_extract_all(coalesce(answer, ''), '\\[([0-9]{{1,9}})\\]', 1), lambda x: x::int),
  list_filter(range(1, len(m) + 1)::int[], lambda i: coalesce(m[i].status = 'mapped', false)))) numbers from a),
k as (select *, list_filter(numbers, lambda i: i between 1 and len(m)) sound from n),
h as (select *, len(list_intersect(gold, list_transform(sound, lambda i: m[i].evidence_id))) hits, len(gold) wanted from k)
select case_id, answerable, case when answerable then round(case when wanted = 0 then 0 else hits / wanted end, 6) end citation_recall, len(sound) = len(numbers) and (not answerable or len(numbers) > 0) citation_valid,
  case when answerable then wanted > 0 and hits = wanted end fully_covered, case when not answerable then {REFUSING} end refused from h""",
        "largest_components": f"select * from ({core_oracle_sql()['revision_components']}) order by documents desc, 1 limit 20",
        "catalog_roundtrip": duplicates,
    }
