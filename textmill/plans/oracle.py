"""What the queries must give, as DuckDB SQL."""

from __future__ import annotations

import random

from ..operators.tasks import TEMPLATES

_WS = r"\s\x0b\x{85}\p{Z}"

#: word and how often, by a rewrite of the split pattern without possessive runs and look-ahead: a mark is put before the last blank of a run that precedes a word.
_HISTOGRAM = rf"""
marked as (select regexp_replace(text, '([{_WS}])([^\S\r\n\x0b\x{{85}}\p{{Z}}]|[\t\f\x0b\x{{85}}\p{{Z}} ])([^{_WS}])', '\1'||chr(1)||'\2\3', 'g') as t from documents where text is not null),
cut_up as (select unnest(regexp_extract_all(t, '''(?i:[sdmt]|ll|ve|re)|[^\r\n\p{{L}}\p{{N}}]?\p{{L}}+|\p{{N}}{{1,2}}| ?[^{_WS}\p{{L}}\p{{N}}]+[\r\n]*|[{_WS}]*[\r\n]|[{_WS}]+')) as w from marked),
histogram as (select replace(w, chr(1), '') as word, count(*) as n from cut_up where replace(w, chr(1), '') <> '' group by 1)"""


def _bytes(c: str) -> str:
    return f"list_transform(range(0, octet_length(encode({c}))), lambda i: ('0x' || substr(hex(encode({c})), 2 * i + 1, 2))::int)"


def _check(ids: str) -> str:
    return f"coalesce(list_sum(list_transform({ids}, lambda x, i: x::bigint * ((i - 1) % 1009 + 1))), 0)::bigint"


_PAIRS = f"""
bytes as (select n, {_bytes('word')} as b from histogram where octet_length(encode(word)) > 1),
pairs as (select n, unnest(list_transform(range(1, len(b)), lambda i: {{'a': b[i], 'b': b[i + 1]}})) as p from bytes),
counts as (select p.a as a, p.b as b, sum(n)::bigint as c from pairs group by 1, 2)"""

_TIDY = """
talk as (select distinct on (conv_id) conv_id, list_transform(messages, lambda m: {'role': lower(trim(m.role)), 'content': coalesce(m.content, '')}) as m from smoltalk where messages is not null),
folded as (select conv_id, case when m[1].role = 'system' then (case when len(m) > 1 then list_concat([{'role': m[2].role, 'content': m[1].content || m[2].content}], m[3:]) else m[2:] end) else m end as m from talk),
sound as (select conv_id, m from folded where len(m) > 0 and coalesce(list_bool_and(list_transform(m, lambda x, i: coalesce(x.role = (case when i % 2 = 1 then 'user' else 'assistant' end), false))), false))"""

_RENDER = f"""
turns as (select conv_id, unnest(m) as x, generate_subscripts(m, 1) as i from sound),
coded as (select conv_id, i, {_bytes('x.content')} as b from turns),
framed as (select conv_id, i, case when i % 2 = 1 then list_concat([257], b, [258]) else list_concat([259], b, [260]) end as ids,
  case when i % 2 = 1 then list_transform(range(0, len(b) + 2), lambda k: 0) else list_concat([0], list_transform(range(0, len(b) + 1), lambda k: 1)) end as mask from coded),
rendered as (select conv_id, list_concat([256], flatten(list(ids order by i))) as ids, list_concat([0], flatten(list(mask order by i))) as mask from framed group by 1),
numbered as (select row_number() over (order by conv_id) - 1 as idx, * from rendered)"""

_WORDS = "words as (select distinct w as word from (select unnest(string_split(lower(p_name), ' ')) as w from part) where w <> '')"

_PROMPTS = f"""
prompts as (select item_id, list_transform(choices, lambda c: list_concat([256], {_bytes("(query || ' ' || coalesce(c, ''))")})) as t from eval_items where query is not null and len(choices) > 0),
spread as (select *, list_min(list_transform(t, lambda s: len(s))) as shortest from prompts),
firsts as (select *, coalesce(list_min(list_filter(range(1, shortest + 1), lambda i: len(list_distinct(list_transform(t, lambda s: s[i]))) > 1)) - 1, shortest) as prefix,
  coalesce(list_min(list_filter(range(1, shortest + 1), lambda i: len(list_distinct(list_transform(t, lambda s: s[len(s) - i + 1]))) > 1)) - 1, shortest) as suffix from spread)"""

_LOSSES = """
losses as (select item_id as item, coalesce(task_label, '') as label, gold, i - 1 as choice, ((coalesce(length(c), 0) * 7 + item_id * 3 + (i - 1) * 5) % 101) / 10.0 as loss
  from (select item_id, task_label, gold, unnest(choices) as c, generate_subscripts(choices, 1) as i from eval_items where gold is not null)),
best as (select item, any_value(label) as label, any_value(gold) as gold, arg_min(choice, loss * 1000 + choice) as predicted from losses group by 1)"""

#: The suite of evaluate_model: prompts as bytes, made-up losses over the scored part.
_SUITE = f"""
ci as (select 'choice_' || coalesce(task_label, '') as label, item_id as key, query, choices, gold, row_number() over (partition by coalesce(task_label, '') order by item_id) - 1 as item, count(*) over (partition by coalesce(task_label, '')) as n
  from eval_items where query is not null and gold is not null and len(choices) > 0),
cs as (select s.label, s.item, string_agg(o.query || ' ' || coalesce(o.choices[o.gold + 1], '') || chr(10) || chr(10), '' order by k.k) as head
  from (select *, ('0x' || substr(md5('2026-' || item), 1, 8))::bigint as h from ci) s, (select unnest([0, 1]) as k) k, ci o where o.label = s.label and o.item = (s.item + 1 + (s.h + k.k) % (s.n - 1)) % s.n group by 1, 2),
cp as (select label, item, gold, list_transform(choices, lambda c: list_concat([256], {_bytes("(head || query || ' ' || coalesce(c, ''))")})) as t from ci join cs using (label, item)),
cf as (select *, coalesce(list_min(list_filter(range(1, list_min(list_transform(t, lambda s: len(s))) + 1), lambda i: len(list_distinct(list_transform(t, lambda s: s[i]))) > 1)) - 1, list_min(list_transform(t, lambda s: len(s)))) as a from cp),
co as (select label, item, gold, generate_subscripts(t, 1) - 1 as choice, unnest(t) as s, a from cf),
si as (select item_id, gold, texts, question from (select distinct on (item_id) item_id, list_position(choices.label, upper(answerkey)) - 1 as gold, choices.text as texts, question from arc where question is not null and answerkey is not null) where gold >= 0),
sp as (select 'questions' as label, item_id as item, gold, list_transform(texts, lambda c: list_concat([256], {_bytes("(coalesce(c, '') || ' ' || question)")})) as t from si),
sf as (select *, list_min(list_transform(t, lambda s: len(s))) as shortest from sp),
sg as (select *, coalesce(list_min(list_filter(range(1, shortest + 1), lambda i: len(list_distinct(list_transform(t, lambda s: s[len(s) - i + 1]))) > 1)) - 1, shortest) as suffix from sf),
so as (select label, item, gold, generate_subscripts(t, 1) - 1 as choice, unnest(t) as s, suffix from sg),
options as (select label, item, gold, choice, s, a from co union all select label, item, gold, choice, s, len(s) - suffix from so),
means as (select label, item, gold, choice, list_avg(list_transform(range(a + 1, len(s) + 1), lambda i: ((s[i] * 7 + coalesce(s[i - 1], 0) * 3 + (i - 1)) % 101) / 10.0)) as m from options where len(s) > a),
picked as (select label, item, any_value(gold) as gold, arg_min(choice, (m, choice)) as guess from means group by 1, 2),
lw as (select distinct on (item_id) item_id as item, regexp_replace(question, '^[{_WS}]+|[{_WS}]+$', '', 'g') as c, answer from gsm8k where question is not null and length(answer) > 0),
lt as (select item, list_concat([256], {_bytes("(c || ' ' || answer)")}) as s, octet_length(encode(c)) + 1 as a from lw),
ends as (select 'word_problems' as label, list_bool_and(list_transform(range(a + 1, len(s) + 1), lambda i: (s[i] + i - 1) % 997 <> 0)) as ok from lt),
accuracies as (select label, avg((guess = gold)::int) as accuracy from picked group by 1 union all select label, avg(ok::int) from ends group by 1),
above as (select *, case when label = 'word_problems' then 0.0 when label = 'questions' then 0.2 else 0.25 end as chance from accuracies)"""

def _letter_draws(words: int = 60, longest: int = 16) -> str:
    """What random.Random(2026 + idx) draws: the place of a letter in a word of n, and a template. A rule, not a table."""
    rows = []
    for idx in range(words):
        for n in range(1, longest + 1):
            rng = random.Random(2026 + idx)
            rows.append(f"({idx},{n},{rng.choice(range(n)) + 1},{rng.choice(range(len(TEMPLATES))) + 1})")
    return f"draws(idx, n, place, template) as (values {','.join(rows)})"


def _shuffled(n: int) -> list[int]:
    order = list(range(n))
    random.Random(2026).shuffle(order)
    return order


_TEMPLATES = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in TEMPLATES) + "]"


def _example_draws(n: int = 400, shots: int = 3) -> str:
    """The evaluation items are fixed in number, so their draws are."""
    return ",".join(f"({k},[{','.join(str(j + (j >= k)) for j in random.Random(2026 + k).sample(range(n - 1), shots))}])" for k in range(n))


#: Permutations of as many words as a table may have, and draws of as many items.
_SPLITS = "perm(n, place) as (values " + ",".join(f"({n},{_shuffled(n)})" for n in range(1, 120)) + ")"


ORACLES: dict[str, str] = {
    "fewshot_exact": f"""with items as (select row_number() over (order by item_id) - 1 as idx, * from eval_items where query is not null and gold is not null and len(choices) > 0), draws(idx, picked) as (values {_example_draws()}),
shots as (select i.item_id, any_value(picked) as picked, string_agg(o.query || ' ' || coalesce(o.choices[o.gold + 1], '') || chr(10) || chr(10), '' order by list_position(picked, o.idx::int)) as head from items i join draws using (idx) join items o on list_contains(picked, o.idx::int) group by 1)
select item_id, array_to_string(picked, ',') as shots_idx, md5(array_to_string(list_transform(choices, lambda c: head || query || ' ' || coalesce(c, '')), '|')) as prompts_md5 from items join shots using (item_id)""",
    "escaped_text": r"""select doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c: case when regexp_matches(c, '\p{C}') then printf('\u%04x', unicode(c)) else c end), '')) as escaped_md5 from documents where regexp_matches(text, '[\x00-\x1f\x7f]')""",
    "letter_questions": f"""with {_WORDS}, {_letter_draws()}, w as (select word, row_number() over (order by word) - 1 as idx from words),
d as (select word, substr(word, place::int, 1) as letter, ({_TEMPLATES})[template] as t from w join draws on draws.idx = w.idx and draws.n = length(word)),
q as (select *, length(word) - length(replace(word, letter, '')) as c from d)
select word, replace(replace(t, '{{word}}', word), '{{letter}}', letter) || chr(10) as question, 'There are in total ' || c || ' ' || letter || ' in word ' || word || '. #### ' || c as answer from q""",
    "seeded_split": f"""with {_WORDS}, {_SPLITS}, w as (select word, row_number() over (order by word) - 1 as was, count(*) over () as n from words),
s as (select word, list_position(place, was::int) - 1 as idx, n from w join perm using (n)) select word, idx::bigint as idx, case when idx < floor(n * 0.9) then 'train' else 'test' end as split from s""",
    "evaluate_model": f"with {_SUITE} select label, round(accuracy, 6) as accuracy, round((accuracy - chance) / (1 - chance), 6) as centered, round(avg((accuracy - chance) / (1 - chance)) over (), 6) as core from above",
    "exact_match": f"with g as (select distinct on (item_id) item_id, answer from gsm8k where length(answer) > 0), b as (select item_id, {_bytes('answer')} as t from g) select item_id as item, list_bool_and(list_transform(t, lambda x, i: (x + i - 1) % 331 <> 0)) as correct from b",
    "schema_spans": f"""with a as (select distinct on (item_id) item_id, question, choices.text as o from arc where question is not null and len(choices.text) > 1),
t as (select item_id, list_transform(o, lambda c: {_bytes("(coalesce(c, '') || '| ' || question)")}) as t from a), s as (select *, list_min(list_transform(t, lambda x: len(x))) as shortest from t),
f as (select *, coalesce(list_min(list_filter(range(1, shortest + 1), lambda i: len(list_distinct(list_transform(t, lambda s: s[len(s) - i + 1]))) > 1)) - 1, shortest) as suffix from s)
select item_id, (generate_subscripts(t, 1) - 1)::int as option, (unnest(list_transform(t, lambda x: len(x))) - suffix)::int as starts, unnest(list_transform(t, lambda x: len(x)))::int as ends from f""",
    "sft_validation_loss": f"""with {_TIDY}, {_RENDER}, kept as (select *, idx % 4 as rank, row_number() over (partition by idx % 4 order by idx) - 1 as k from numbered where len(ids) <= 8192),
each as (select rank, k // 8 as batch, list_filter(list_transform(range(2, len(ids) + 1), lambda j: case when mask[j] = 1 then (ids[j] % 17) / 4.0 end), lambda x: x is not null) as l from kept),
means as (select rank, batch, sum(list_sum(l)) / sum(len(l)) as m from each group by 1, 2 having sum(len(l)) > 0) select round(avg(m), 6) as loss, count(*) as n_batches from means""",
    "generated_answers": """with g as (select distinct on (item_id) item_id, answer, nullif(replace(regexp_extract(answer, '#### (-?[0-9.,]+)', 1), ',', ''), '') as gold from gsm8k where length(answer) > 0),
t as (select item_id, gold, k, case when item_id % 3 > k then 'I do not know' when item_id % 5 = 0 then '#### 0.5' else right(answer, 100) end as said from g, (select unnest([0, 1, 2]) as k) where gold is not null),
p as (select item_id, gold, k, nullif(replace(regexp_extract(left(said, 128), '#### (-?[0-9.,]+)', 1), ',', ''), '') as a from t)
select count(*) as n, round(avg(coalesce((a = gold)::int, 0)), 6) as accuracy from (select item_id, any_value(gold) as gold, arg_min(a, k) filter (where a is not null) as a from p group by 1)""",
    "merged_ids": f"""with g as (select distinct on (item_id) item_id, question from gsm8k where question is not null), b as (select item_id, {_bytes('question')} as t from g),
m as (select item_id, list_filter(list_transform(t, lambda x, i: case when x = 116 and t[i + 1] = 104 then 256 when x = 104 and i > 1 and t[i - 1] = 116 then null else x end), lambda x: x is not null) as t from b)
select item_id, len(t)::int as n, {_check('t')} as ids_check, {_check('list_concat(t[2:], t[1:1])')} as rolled_check from m""",
    "split_on_specials": """with g as (select distinct on (item_id) item_id, question, answer from gsm8k where length(question) > 0 and length(answer) > 0)
select item_id, unnest([0, 1, 2, 3])::int as no, unnest(['<|user_start|>', question, '<|user_end|>', answer]) as piece from g""",
    "without_last_message": """with t as (select distinct on (conv_id) conv_id, messages as m from smoltalk where len(messages) > 0) select conv_id, (len(m) - 1)::int as n, case when len(m) > 1 then lower(trim(m[len(m) - 1].role)) end as last_role from t""",
    "event_windows": "select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n from events where ts is not null group by 1, 2",
    "training_plan": """with t as (select sum(octet_length(encode(text))) as n from documents), b as (select unnest([1, 2, 4, 8]) as b)
select b::int as batch, 2::int as accumulation, round_even(n * 20 / (b * 8192.0)::double, 0)::bigint as by_ratio, round_even(6.0e15::double / (6000000.0 * b * 8192), 0)::bigint as by_flops from b, t""",
    "files_round_trip": f"""with {_WORDS} select 'items' as what, count(*) as n, sum(len(choices))::double as x from eval_items union all select 'talk', count(*), sum(len(messages))::double from (select distinct on (conv_id) messages from smoltalk where messages is not null)
union all select 'chances', count(*), round(sum(target_share * 100), 6) from mix_targets union all select 'words', count(*), sum(length(word))::double from words""",
    "encode_decode": "select doc_id, true as encoded, octet_length(encode(text))::int as n_bytes, true as same from documents where text is not null",
    "file_split": "select 'val' as split, 0::int as pf_idx, count(*) as n, sum(length(text))::bigint as chars from documents",
    "row_group_scan": "select 0::int as pf_idx, 0::int as rg_idx, count(*) as n, sum(length(text))::bigint as chars from documents",
    "word_histogram": f"with {_HISTOGRAM} select word, n from histogram",
    "streamed_histogram": f"with {_HISTOGRAM} select word, n from histogram",
    "char_budget_prefix": "select doc_id, before as chars_before from (select doc_id, coalesce(sum(coalesce(length(text), 0)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before from documents) where before < 500000",
    "byte_pair_counts": f"with {_HISTOGRAM}, {_PAIRS} select a, b, c from counts",
    "top_pair": f"with {_HISTOGRAM}, {_PAIRS} select a, b, c from counts order by c desc, a, b limit 1",
    "conversation_fold_system": f"with {_TIDY} select conv_id, len(m)::int as n_messages, m[1].content as first_user, m[len(m)].role as last_role from sound",
    "conversation_render_bytes": f"with {_TIDY}, {_RENDER} select conv_id, len(ids)::int as n_ids, list_sum(mask)::bigint as n_masked, {_check('ids')} as ids_check, {_check('mask')} as mask_check from rendered",
    "sft_targets": f"""with {_TIDY}, {_RENDER},
kept as (select *, (idx % 4)::int as rank, row_number() over (partition by idx % 4 order by idx) - 1 as k from numbered where len(ids) <= 8192),
wide as (select *, k // 8 as batch, max(len(ids)) over (partition by rank, k // 8) as width from kept)
select rank, batch::bigint as batch, idx, width::int as width, {_check('list_concat(ids, list_transform(range(0, width - len(ids)), lambda k: 256))')} as inputs_check,
  {_check('list_concat(list_transform(range(2, len(ids) + 1), lambda j: case when mask[j] = 1 then ids[j] else -1 end), list_transform(range(0, width - len(ids) + 1), lambda k: -1))')} as targets_check from wide""",
    "pack_nextfit": f"""with recursive {_TIDY}, {_RENDER},
kept as (select idx % 4 as rank, row_number() over (partition by idx % 4 order by idx) as k, ids from numbered where len(ids) <= 8193),
fit as (select rank, k, 0 as row, len(ids) as used from kept where k = 1 union all
  select n.rank, n.k, case when f.used + len(n.ids) > 8193 then f.row + 1 else f.row end, case when f.used + len(n.ids) > 8193 then len(n.ids) else f.used + len(n.ids) end from fit f join kept n on n.rank = f.rank and n.k = f.k + 1),
lines as (select fit.rank, row, flatten(list(ids order by fit.k)) as ids from fit join kept on kept.rank = fit.rank and kept.k = fit.k group by 1, 2)
select rank::int as rank, row::bigint as row, {_check('list_concat(ids, list_transform(range(0, 8193 - len(ids)), lambda k: 256))[1:8192]')} as inputs_check, (8193 - len(ids))::int as n_ignored from lines""",
    "task_mixture_schedule": """with s as (select (select count(*) from gsm8k) as a, (select count(*) from arc) as b, (select count(*) from mmlu) as c),
g as (select unnest(range(0, 4 * (2 * (a + b + c) // 4))) as id, a, b, a + b + c as n from s)
select (id % 4)::int as rank, id // 4 as step, (case when id % n < a then 0 when id % n < a + b then 1 else 2 end)::int as task_idx,
  (id % n - case when id % n < a then 0 when id % n < a + b then a else a + b end)::bigint as idx, id // n as epoch, round((id // 4 + 1) * 4 / n::double, 6) as progress from g""",
    "task_mixture": """with g as (select row_number() over (order by item_id) - 1 as idx, regexp_replace(question, '<<|>>', '', 'g') || chr(10) as question, regexp_replace(answer, '<<|>>', '', 'g') as answer from (select distinct on (item_id) * from gsm8k)),
a as (select row_number() over (order by item_id) - 1 as idx, 'Question: ' || question || chr(10) || 'Choices: ' || array_to_string(list_transform(range(1, len(choices.label) + 1), lambda i: choices.label[i] || ':' || coalesce(choices.text[i], '')), '') || chr(10) as question,
  'The correct answer is ' || answerkey || ' #### ' || answerkey as answer from (select distinct on (item_id) * from arc))
select 0 as task_idx, * from g union all select 1, * from a where idx < 50 union all select 2, * from g""",
    "split_train_val": "select doc_id, (doc_id % 16)::int as shard, case when doc_id % 16 = 15 then 'val' else 'train' end as split from documents",
    "shard_assignment": "select doc_id, idx, (idx % 4)::int as rank from (select doc_id, row_number() over (order by doc_id) - 1 as idx from documents)",
    "gsm8k_messages": "select item_id, regexp_replace(question, '<<|>>', '', 'g') || chr(10) as question, regexp_replace(answer, '<<|>>', '', 'g') as answer from gsm8k",
    "mmlu_messages": """select item_id, case when len(choices) = 4 and answer between 0 and 3 then 'Question: ' || question || chr(10) || 'Choices: ' || array_to_string(list_transform(range(1, 5), lambda i: ('ABCD')[i] || ':' || coalesce(choices[i], '')), '') || chr(10) end as question,
  case when len(choices) = 4 and answer between 0 and 3 then 'The correct answer is ' || ('ABCD')[answer + 1] || ' #### ' || ('ABCD')[answer + 1] end as answer from mmlu""",
    "arc_messages": """select item_id, 'Question: ' || question || chr(10) || 'Choices: ' || array_to_string(list_transform(range(1, len(choices.label) + 1), lambda i: choices.label[i] || ':' || coalesce(choices.text[i], '')), '') || chr(10) as question,
  'The correct answer is ' || answerkey || ' #### ' || answerkey as answer from arc""",
    "spelling_messages": f"with {_WORDS} select word, 'Please spell word ' || word || chr(10) as question, array_to_string(string_split(word, ''), ',') as answer from words",
    "letter_count": "select p_partkey, " + ", ".join(f"(length(p_name) - length(replace(lower(p_name), '{c}', '')))::int as n_{c}" for c in "aeinrs") + " from part",
    "extract_answer": "select item_id, number, coalesce(number, '[invalid]') as shown from (select item_id, nullif(replace(regexp_extract(answer, '#### (-?[0-9.,]+)', 1), ',', ''), '') as number from gsm8k)",
    "fewshot_prompts": """with items as (select row_number() over (order by item_id) - 1 as idx, count(*) over () as n, * from eval_items where query is not null and gold is not null and len(choices) > 0),
starts as (select *, ('0x' || substr(md5('2026-' || idx), 1, 8))::bigint as h from items),
shots as (select s.item_id, string_agg(o.query || ' ' || coalesce(o.choices[o.gold + 1], '') || chr(10) || chr(10), '' order by k.k) as head from starts s, (select unnest([0, 1, 2]) as k) k, items o
  where o.idx = (s.idx + 1 + (s.h + k.k) % (s.n - 1)) % s.n group by 1)
select item_id, (i - 1)::int as choice, head || query || ' ' || coalesce(c, '') as prompt from (select item_id, query, unnest(choices) as c, generate_subscripts(choices, 1) as i from items) join shots using (item_id)""",
    "common_prefix_suffix": f"with {_PROMPTS} select item_id, prefix::int as prefix, suffix::int as suffix from firsts",
    "crop_stack": f"""with {_PROMPTS}, each as (select item_id, prefix, list_max(list_transform(t, lambda s: least(len(s), 160))) as width, unnest(t) as s, generate_subscripts(t, 1) as i from firsts),
short as (select *, case when len(s) > 160 then s[len(s) - 159:] else s end as c, greatest(0, len(s) - 160) as gone from each)
select item_id, (i - 1)::int as choice, width::int as width, (prefix - gone)::int as starts, (len(s) - gone)::int as ends, {_check('list_concat(c, list_transform(range(0, width - len(c)), lambda k: 256))')} as ids_check from short""",
    "bits_per_byte": """with l as (select length(question) % 260 - 2 as target, (coalesce(length(answer), 0) % 17) / 10.0 as loss from gsm8k where question is not null),
v as (select i as token_id, case when i % 10 = 0 then 0 else 1 + i % 4 end as n_bytes from range(260) r(i))
select round(sum(loss)::double / ln(2) / sum(n_bytes), 6) as bpb from l join v on target = token_id where n_bytes > 0""",
    "choice_argmin": f"with {_LOSSES} select item, predicted::int as predicted, predicted = gold as correct from best",
    "core_metric": f"""with {_LOSSES}, acc as (select label, avg((predicted = gold)::int) as accuracy from best group by 1), c as (select *, (accuracy - 0.25) / 0.75 as centered from acc)
select label, round(accuracy, 6) as accuracy, round(centered, 6) as centered, round(avg(centered) over (), 6) as core from c""",
    "generative_accuracy": """select count(*) as n, round(avg(coalesce((choices.label[item_id % 4 + 1] = nullif(replace(regexp_extract('The correct answer is ' || answerkey || ' #### ' || answerkey, '#### (-?[0-9.,]+|[A-Z]\\b)', 1), ',', ''), ''))::int, 0)), 6) as accuracy
from arc where answerkey is not null and question is not null""",
    "lr_schedule": """select step, round(case when step < 50 then (step + 1) / 50.0 when step <= 600 then 1.0 else (1000 - step) / 400.0 + (1 - (1000 - step) / 400.0) * 0.1 end::double, 6) as lr,
  round((case when step / 1000.0 < 0.8 then 1.0 else 1 - (step / 1000.0 - 0.8) / 0.2 end)::double, 6) as sft_lr from range(1000) r(step)""",
    "momentum_schedule": "select step, round(((1 - least(step / 300.0, 1.0)) * 0.85 + least(step / 300.0, 1.0) * 0.95)::double, 6) as momentum, round((0.8 * (1 - step / 1000.0))::double, 6) as decay from range(1000) r(step)",
    "ema_loss": """with e as (select event_id, user_id, coalesce(value, 0) as x, row_number() over (partition by user_id order by ts, event_id) as k from events)
select event_id, round(sum(0.1 * x * pow(0.9, -k)) over (partition by user_id order by k) * pow(0.9, k) / (1 - pow(0.9, k)), 6) as ema from e""",
    "running_best": "select event_id, min(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as best from events",
    "training_progress": """with l as (select step, 0.5::double + (step % 8)::double / 8 as seconds from range(500) r(step)), t as (select *, sum(case when step > 10 then seconds else 0 end) over (order by step) as trained from l)
select step, floor(524288 / seconds)::bigint as tokens_per_second, round(trained, 6) as trained, 100.0::double * step / 1000 as percent, round(case when step > 10 then (1000 - step) * trained / (step - 10) end, 3) as eta from t""",
    "topk_with_ties": "select l_suppkey, l_orderkey, l_linenumber, l_quantity from (select *, rank() over (partition by l_suppkey order by l_quantity desc) as r from lineitem) where r <= 3",
    "greedy_tokens": "select user_id, token from (select user_id, length(event_type)::int as token, row_number() over (partition by user_id order by count(*) desc, length(event_type)) as r from events group by user_id, length(event_type)) where r = 1",
    "latest_checkpoint": "select 5000::int as step",
    "metrics_pivot": "select step, step * 1.5::double as loss, step * 1.5::double + 0.5 as bpb, step * 1.5::double + 1.0 as lr from range(20) r(step)",
    "language_spans": """with r as (select distinct on (item_id) item_id, trim(question, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(133) || chr(8203)) as q, regexp_replace(question, '^[\\s\\x0b\\x{85}\\p{Z}]+|[\\s\\x0b\\x{85}\\p{Z}]+$', '', 'g') as c, answer from gsm8k where question is not null and length(answer) > 0)
select item_id, octet_length(encode(c))::int as start, (octet_length(encode(c)) + 1 + octet_length(encode(answer)))::int as "end" from r where length(c) > 0""",
}
