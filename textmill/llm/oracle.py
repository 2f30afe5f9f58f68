"""SQL for the pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+"


def _grams(rows: str, n: int, least: int, name: str) -> str:
    """CTEs: `name` with distinct n-grams (as hashes) of each text of `rows` (id, t), and `name`_size."""
    return f"""{name}_w as materialized (select id, {_WORDS.format('t')} as w from {rows}),
{name} as materialized (select distinct id, hash(w[i:i + {n - 1}]) as g from (select id, w, unnest(range(1, len(w) - {n - 2})) as i from {name}_w where len(w) >= {least})),
{name}_size as materialized (select id, count(*) as n from {name} group by 1)"""


def _alike(name: str, keep: str) -> str:
    return f"""select a.id as x, b.id as y from {name} a join {name} b on a.g = b.g and a.id < b.id join {name}_size m on m.id = a.id join {name}_size n on n.id = b.id {keep}
group by a.id, b.id having count(*) >= 0.6 * (any_value(m.n) + any_value(n.n) - count(*))"""


_TALK = "(select distinct on (conv_id) conv_id, split, array_to_string(list_filter(list_transform(messages, lambda m: case when coalesce(lower(trim(m.role)), '') = 'system' then null else m.content end), lambda c: c is not null), ' ') as t from smoltalk)"
_SPLITS = "where (lower(trim(split)) = 'train' or lower(trim(split)) in ('test', 'validation'))"

_VALUES = """v as (select 'documents.text' as field_name, doc_id as row_id, -1::bigint as turn, text as t from documents union all
  select 'messages.content', conv_id, i - 1, m.content from (select conv_id, unnest(messages) as m, generate_subscripts(messages, 1) as i from (select distinct on (conv_id) * from smoltalk)))"""
#: Documents and items as words with their character ranges; a document's runs of 12 words that some item has.
_RUNS = r"""tokens as (select doc_id, unnest(k) as token, generate_subscripts(k, 1) as i from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') as k from documents where text is not null)),
placed as (select *, sum(length(token)) over (partition by doc_id order by i) as past from tokens),
runs as (select doc_id, past - length(token) as first, max(past) over f as past, list(token) over f as g from placed where regexp_matches(token, '^[\p{L}\p{N}]') window f as (partition by doc_id order by i rows between current row and 11 following)),
e as (select item_id, """ + _WORDS.format("query") + """ as w from eval_items where query is not null), y as (select distinct w[i:i + 11] as g from (select w, unnest(range(1, len(w) - 10)) as i from e where len(w) >= 12)),
hit as (select doc_id, first::bigint as first, past::bigint as past from runs join y using (g))"""

_OVERLAPS = f"""with r as (select conv_id as id, lower(trim(split)) = 'train' as train, t from {_TALK} {_SPLITS}), q as (select item_id as id, lower(trim(split)) = 'train' as train, question as t from (select distinct on (item_id) * from gsm8k) {_SPLITS}),
{_grams('r', 3, 30, 's')}, {_grams('q', 3, 30, 'u')}
select 'smoltalk' as tab, x as id_a, y as id_b from ({_alike('s', 'join r p on p.id = a.id join r o on o.id = b.id and o.train <> p.train')})
union all select 'gsm8k', x, y from ({_alike('u', 'join q p on p.id = a.id join q o on o.id = b.id and o.train <> p.train')})"""

ORACLES = {
    "p1_groups": f"""with recursive d as (select doc_id as id, text as t from documents where text is not null), {_grams('d', 5, 5, 's')},
class as (select id, min(id) over (partition by k) as rep from (select id, list_sort(list(g)) as k from s group by id)),
one as (select s.* from s join class c on c.id = s.id and c.rep = s.id),
edge as (select a.id as x, b.id as y from one a join one b on a.g = b.g and a.id < b.id join s_size m on m.id = a.id join s_size n on n.id = b.id group by a.id, b.id having count(*) >= 0.8 * (any_value(m.n) + any_value(n.n) - count(*))),
way as (select x, y from edge union all select y, x from edge), reach as (select distinct rep as id, rep as root from class union select way.y, reach.root from reach join way on way.x = reach.id),
low as (select id, min(root) as root from reach group by id), links as (select x, count(*) as n from way group by x)
select doc_id, coalesce(low.root, doc_id) as group_id, coalesce(links.n, 0)::bigint as n_links from documents left join class c on c.id = doc_id left join low on low.id = c.rep left join links on links.x = c.rep""",
    "p3_checked": """with i as (select 'documents.text' as field_name, doc_id as id, octet_length(encode(text)) as n from documents union all
  select distinct on (conv_id) 'messages.content', conv_id, octet_length(encode(array_to_string(list_filter(list_transform(messages, lambda m: m.content), lambda c: c is not null), ''))) from smoltalk)
select field_name, count(*) as n_items, sum(n)::bigint as size, true as within, true as whole, true as filled from i where n > 0 group by 1""",
    "p7_checked": """select source, d.s is not null as has_documents, true as reached, true as within_repeats from mix_targets left join (select distinct replace(lower(trim(source)), '-', '_') as s from documents where length(text) > 0) d on d.s = source""",
    "p7_overlap": """with n as (select source, row_number() over (order by source) as k, count(*) over () as c from mix_targets), d as (select doc_id, replace(lower(trim(source)), '-', '_') as s from documents where length(text) > 0),
h as (select s from d union select m.source from d join n on n.source = d.s join n m on m.k = n.k % n.c + 1 where doc_id % 3 = 0)
select source, h.s is not null as has_documents, true as reached, true as within_repeats from mix_targets left join h on h.s = source""",
    "p8_roundtrip": "select true as tried, true as found, true as right",
    "p2_checked": f"with {_VALUES} select v.field_name, row_id, turn, true as within, true as overlaps, true as covers, true as kinds from v join size_limits s on s.field_name = v.field_name and s.purpose = 'split' where length(t) > max_size",
    "p6_removal_spans": f"""with {_RUNS}, edges as (select *, coalesce(first > max(past) over (partition by doc_id order by first, past rows between unbounded preceding and 1 preceding), true) as fresh from hit),
parts as (select *, sum(fresh::int) over (partition by doc_id order by first, past) as part from edges) select doc_id, min(first) as first, max(past) as past from parts group by doc_id, part""",
    "p1_found": f"with d as (select doc_id as id, text as t from documents where text is not null), {_grams('d', 3, 30, 's')} select x as doc_id_a, y as doc_id_b from ({_alike('s', '')})",
    "p2_found": f"""with v as (select 'documents.text' as field_name, doc_id as row_id, -1::bigint as turn, text as t from documents union all
  select 'messages.content', conv_id, i - 1, m.content from (select conv_id, unnest(messages) as m, generate_subscripts(messages, 1) as i from (select distinct on (conv_id) * from smoltalk)))
select v.field_name, row_id, turn, (list_max(list_transform(regexp_split_to_array(t, '{_SPACE}'), lambda x: length(x))) > max_size)::bigint as forced
from v join size_limits s on s.field_name = v.field_name and s.purpose = 'split' where length(t) > max_size""",
    "p5_found": _OVERLAPS,
    "p5_classes": f"""with r as (select 'smoltalk' as tab, conv_id as id, lower(trim(split)) = 'train' as train, t from {_TALK} {_SPLITS} union all select 'gsm8k', item_id, lower(trim(split)) = 'train', question from (select distinct on (item_id) * from gsm8k) {_SPLITS}),
k as (select row_number() over () as id, tab, id as was, train, t from r), {_grams('k', 3, 30, 's')}, sets as (select id, list_sort(list(g)) as s from s group by id),
node as (select k.id, tab, was, train, min(was) over (partition by tab, s) as class_id, min(k.id) over (partition by tab, s, train) as rep, len(s) as n from sets join k using (id)),
p as (select a.id as h, b.id as t, count(*) as c from s a join node m on m.id = a.id and m.rep = a.id and not m.train join s b on a.g = b.g join node o on o.id = b.id and o.rep = b.id and o.train and o.tab = m.tab group by 1, 2),
good as (select h, t, c::double / m.n as overlap from p join node m on m.id = h join node o on o.id = t where c >= 0.6 * (m.n + o.n - c)),
side as (select h as rep, overlap from good union all select t, 1.0 from good), degree as (select rep, count(*) as n_links, max(overlap) as overlap from side group by 1)
select tab, was as id, class_id, n_links, round(overlap, 6) as overlap from node join degree using (rep)""",
    "p5_report": f"""with p as ({_OVERLAPS}), about as (select 'smoltalk' as tab, conv_id as id, split, source from smoltalk union all select 'gsm8k', item_id, split, source from gsm8k),
record as (select tab, id, min(lower(trim(split))) as split, min(replace(lower(trim(source)), '-', '_')) as source from about group by 1, 2),
held as (select p.tab, r.split, r.source, r.id from p join record r on r.tab = p.tab and r.id in (p.id_a, p.id_b) and r.split <> 'train')
select tab, split, source, count(*) as n_pairs, count(distinct id) as n_records from held group by 1, 2, 3""",
    "p6_found": f"""with d as (select doc_id, {_WORDS.format('text')} as w from documents where text is not null), e as (select item_id, {_WORDS.format('query')} as w from eval_items where query is not null),
x as (select doc_id, w[i:i + 11] as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d where len(w) >= 12)), y as (select item_id, w[i:i + 11] as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from e where len(w) >= 12))
select distinct item_id, doc_id from x join y using (g)""",
}
