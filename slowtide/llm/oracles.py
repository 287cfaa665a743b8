"""DuckDB texts of the queries that SQL can express on whole tables."""

from slowtide.llm.licenses import BREAK, EMPTY_LINE, END_MARK, IDENTIFIER, LINE_END, RULES, SENTENCES, VERSION, rule_pattern

ORACLES: dict[str, str] = {}

ORACLES["op9_line_dedup"] = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as nth
  from documents),
keyed as (
  select doc_id, nth, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
repeated as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40
  group by key having count(distinct doc_id) >= 5)
select k.doc_id, cast(count(*) as bigint) as n_lines,
       cast(count(*) filter (where r.key is not null and k.doc_id <> r.keeper) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by nth) filter (where r.key is null or k.doc_id = r.keeper), '')) as kept_sha256
from keyed k left join repeated r on k.key = r.key
group by k.doc_id
"""


def _licences() -> str:
    known = ", ".join(f"('{name}', ' {words} ', {i})" for i, (name, words) in enumerate(SENTENCES.items()))
    steps = ["r0 as (select *, rest0 as rest, cast([] as varchar[]) as found from ids)"]
    for i, (name, rule) in enumerate(RULES):
        pattern, left = rule_pattern(rule)
        left = left.replace("$", chr(92))
        steps.append(
            f"r{i + 1} as (select doc_id, n_sentences, sentence_ids, rest0,"
            f" regexp_replace(rest, '{pattern}', '{left}', 'g') as rest,"
            f" case when regexp_matches(rest, '{pattern}') then list_append(found, '{name}') else found end as found from r{i})"
        )
    return f"""
with known(name, words, rank) as (values {known}),
parts as (
  select doc_id, unnest(p) as part, generate_subscripts(p, 1) as nth
  from (
    select doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      replace(lower(coalesce(text, '')), chr({ord(BREAK)}), ' '),
      '{VERSION}', {chr(39)}{chr(92)}1{chr(92)}2 {chr(92)}3{chr(39)}, 'g'),
      '{IDENTIFIER}', chr({ord(BREAK)}) || {chr(39)}spdx license identifier {chr(92)}1 end{chr(39)} || chr({ord(BREAK)}), 'g'),
      '{END_MARK}', {chr(39)}{chr(92)}1{chr(39)} || chr({ord(BREAK)}), 'g'),
      '{EMPTY_LINE}', chr({ord(BREAK)}), 'g'), '{LINE_END}', ' ', 'g'), chr({ord(BREAK)})) as p
    from documents)),
hits as (
  select doc_id, nth, rank, name from parts, known
  where contains(' ' || trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) || ' ', words)),
ids as (
  select d.doc_id, cast(count(name) as bigint) as n_sentences,
         coalesce(string_agg(name, ',' order by nth, rank), '') as sentence_ids,
         coalesce(string_agg(',' || name || ',', '' order by nth, rank), '') as rest0
  from documents d left join hits h on d.doc_id = h.doc_id group by d.doc_id),
{", ".join(steps)}
select doc_id, n_sentences, sentence_ids, array_to_string(list_sort(list_distinct(found)), ',') as licences
from r{len(RULES)}
"""


ORACLES["op10_licenses"] = _licences()

ORACLES["op3_ngram_join"] = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> '') as w from documents),
shingles as (
  select distinct doc_id, unnest(case
    when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as n
  from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id),
links as (
  select a, b from common c join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 5 * c.n >= 4 * (x.n + y.n - c.n)),
reach(doc_id, other) as (
  select doc_id, doc_id from documents
  union
  select r.doc_id, l.b from reach r join links l on l.a = r.other)
select doc_id, min(other) as class_id,
       (select count(*) from links l where l.a = r.doc_id) as n_links
from reach r group by doc_id
"""
