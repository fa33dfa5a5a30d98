"""DuckDB equivalents of those training-data queries that SQL can express."""

from __future__ import annotations

from corpusloom.llm.keyed_splits import PLACEHOLDERS
from corpusloom.llm.text_quality import LINE_ENDS, SPACE
from corpusloom.llm.visual_text import shape_table


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def mapped(column: str) -> str:
    """The shape mapping of a column."""
    chars, plain, joined = shape_table()
    text = f"translate({column}, {quoted(chars)}, {quoted(plain)})"
    for c, letters in joined:
        text = f"replace({text}, {quoted(c)}, {quoted(letters)})"
    return text


def shaped(column: str) -> str:
    """The shape mapping and canonical composition of a column."""
    return f"nfc_normalize({mapped(column)})"


TERMS = """
terms as (
  select distinct f.case_id, cast(g.i as int) group_no, cast(t.j as int) term_no, f.required_term_groups[g.i][t.j] term
  from visual_facts f, lateral (select unnest(range(1, len(f.required_term_groups) + 1)) i) g,
       lateral (select unnest(range(1, len(f.required_term_groups[g.i]) + 1)) j) t
  where f.case_id is not null and f.required_term_groups[g.i][t.j] <> ''),
answers as (
  select case_id, arg_max(reference_answer, (loaded_at, reference_answer)) reference_answer from mapped_cases
  where case_id is not null and reference_answer is not null group by case_id)
"""


def presence() -> str:
    return f"""with {TERMS}, presence as (
  select case_id, group_no, term_no, contains(reference_answer, term) exact, contains({shaped("reference_answer")}, {shaped("term")}) visible
  from terms join answers using (case_id))
"""


def comparable(column: str) -> str:
    listed = ", ".join(map(quoted, PLACEHOLDERS))
    plain = f"lower(regexp_replace({column}, '^[\\s\\x{{a0}}\\x{{3000}}]+|[\\s\\x{{a0}}\\x{{3000}}]+$', '', 'g'))"
    return f"case when {plain} not in ({listed}) then {plain} end"


COMPONENTS = f"""with recursive docs as (
  select distinct document_id, {comparable("document_id")} node, {comparable("group_id")} g, {comparable("source_family")} f, {comparable("sha256")} s
  from catalog_entries where {comparable("document_id")} is not null),
keyed as (
  select node, 'g' || g k from docs where g is not null union select node, 'f' || f from docs where f is not null union select node, 's' || s from docs where s is not null),
edges as (
  select distinct a.node x, b.low y from keyed a join (select k, min(node) low from keyed group by k) b using (k)),
links as (select x, y from edges union select y, x from edges),
reach(node, root) as (
  select distinct node, node from docs
  union
  select l.y, r.root from reach r join links l on l.x = r.node where r.root < l.y),
parts as (select node, min(root) root from reach group by node),
named as (select d.document_id, p.root from (select distinct document_id, node from docs) d join parts p using (node)),
components as (select document_id, min(document_id) over (partition by root) component_id from named)
"""


def statistics() -> str:
    space = SPACE.replace("\\x{9}-\\x{d}", "\\x{9}-\\x{d}")
    return f"""with words as (
  select list(distinct lower(word)) filter (not regexp_matches(word, '[\\x{{4e00}}-\\x{{9fff}}]')) latin,
         array_to_string(list_reverse(list_sort(list(distinct printf('%03d', length(word)) || word) filter (regexp_matches(word, '[\\x{{4e00}}-\\x{{9fff}}]')))), '|') tagged
  from common_words where word <> ''),
patterns as (select latin, regexp_replace(tagged, '[0-9]+', '', 'g') chinese from words),
texts as (select doc_id, coalesce(text, '') text from documents where doc_id is not null),
counted as (
  select doc_id,
    regexp_extract_all(text, '(?:[\\p{{N}}_]|[^\\P{{L}}\\x{{4e00}}-\\x{{9fff}}])+') runs,
    length(text) - length(regexp_replace(text, '[\\p{{L}}\\p{{N}}_]', '', 'g')) letters,
    length(regexp_replace(text, '{space}', '', 'g')) dense,
    length(text) - length(regexp_replace(text, '[\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) characters,
    length(text) - length(regexp_replace(text, (select chinese from patterns), '', 'g')) known_characters,
    list_filter([regexp_replace(x, '{space}+$', '') for x in string_split(text, chr(10))], lambda x: x <> '') lines
  from texts),
joined as (select counted.*, patterns.latin from counted, patterns),
parts as (
  select doc_id, len(runs) + characters words, letters, dense, len(lines) lines,
    len(list_filter(lines, lambda x: contains({quoted(LINE_ENDS)}, right(x, 1)))) ended,
    len(list_filter(runs, lambda w: list_contains(latin, lower(w)))) + known_characters known
  from joined)
select doc_id, cast(words as bigint) words,
  round(case when words > 0 then letters / words else 0 end, 6) mean_word_length,
  round(case when dense > 0 then (dense - letters) / dense else 0 end, 6) symbol_share,
  round(case when lines > 0 then ended / lines else 0 end, 6) punctuated_line_share,
  round(case when words > 0 then known / words else 0 end, 6) common_word_share
from parts"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": presence() + "select case_id, group_no, term_no from presence where visible and not exact",
        "p1_group_coverage": presence() + """, grouped as (
  select case_id, group_no, max(cast(visible as bigint)) v, max(cast(exact as bigint)) e from presence group by all)
select case_id, count(*) term_groups, cast(sum(v) as bigint) seen_groups, cast(sum(e) as bigint) matched_groups from grouped group by case_id""",
        "p1_canonical_terms": f"""with {TERMS}, m as (select distinct term, {mapped("term")} mapped from terms),
classes as (select nfc_normalize(mapped) class, arg_min(mapped, (length(mapped), mapped)) canonical from m group by 1)
select term, canonical from m join classes on class = nfc_normalize(mapped)""",
        "p3_found": COMPONENTS + f""", carried as (
  select c.component_id from catalog_entries e join components c using (document_id)
  where {comparable("split")} is not null group by 1 having count(distinct {comparable("split")}) > 1)
select document_id, component_id from components where component_id in (select component_id from carried)""",
        "p3_components": COMPONENTS + "select document_id, component_id from components",
        "p8_statistics": statistics(),
    }
