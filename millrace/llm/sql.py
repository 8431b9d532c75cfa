"""Statements equivalent to those queries of this subpackage that SQL can express."""

_REPO = "nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^[\\s/]+|[\\s/]+$', '', 'g'), '\\.git[\\s/]*$', ''), '\\s*/[\\s/]*', '/', 'g')), '')"

_SPACE = "[\\t\\n\\v\\f\\r \\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"

ORACLES = {
    "p3_found": f"""
with recursive l as (select {_REPO.format('from_repo')} as a, {_REPO.format('to_repo')} as b from repo_links),
e as (select a, b from l where a is not null and b is not null union select b, a from l where a is not null and b is not null),
r as (select distinct a as node, a as seen from e union select r.node, e.b from r join e on r.seen = e.a),
c as (select node, min(seen) as component from r group by 1),
t as (select 'repository_files' as record_table, file_id as record_id, 'r:' || {_REPO.format('repo_name')} as key, split_name from repository_files
union all select 'code_functions', function_id, 'r:' || {_REPO.format('repo_name')}, split_name from code_functions
union all select 'raw_traces', trace_id, 'p:' || problem_id, split_name from raw_traces),
g as (select record_table, record_id, split_name, coalesce('r:' || component, key) as k from t left join c on key = 'r:' || node where key is not null)
select record_table, record_id from g where k in (select k from g group by 1 having count(distinct split_name) > 1)""",
    "p7_counts": f"""
with t as (select doc_id, replace(replace(regexp_replace(text, '^\\x{{FEFF}}+', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) as text from documents where category = 'text' and text is not null),
l as (select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^{_SPACE}+', ''), '{_SPACE}+$', '')), lambda x: x <> '') as lines from t)
select doc_id, length(text) as chars, len(lines) as lines, len(list_filter(lines, lambda x: length(x) < 40)) as short_lines, coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0)::bigint as line_chars from l""",
    # these queries tell of bounds that must hold whatever the tables are
    "p3_bounds": "select split_name as split, true as within, true as together from split_targets",
    "p4_bounds": "select stage, group_name, true as within, true as readings_kept from mixture_groups",
    "p5_bounds": "select distinct seq_len, true as fits, true as tight, true as whole from mixture_groups",
}
