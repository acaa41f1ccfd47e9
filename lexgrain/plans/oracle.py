"""Equivalent SQL of the registered queries, for a side-by-side check in DuckDB.

Each statement is written against the given tables and states the definition of the result, not
the way the Spark side computes it.
"""

from __future__ import annotations

from lexgrain.functions import charclasses as cc
from lexgrain.operators.features import FEATURES
from lexgrain.operators.subwords import byte_letters
from lexgrain.plans.relations import PIECES

WS, NOT_WS = cc.WS, cc.NOT_WS
PUNCT = f"[{cc.PUNCTUATION.replace(chr(39), chr(39) * 2)}]"

SENT = """sent as (
  select d.doc_id as id, d.text as sentence, l.quality as label, d.lang
  from documents d join labels l on d.doc_id = l.doc_id)"""
DIRTY = f"""{SENT},
dirty as (
  select id, label, concat('" ', replace(replace(sentence, '.', ' .'), ' the ', ' / '), ' "')
    as sentence from sent)"""
TEST = """test as (
  select doc_id as id, text as sentence from documents
  where doc_id not in (select doc_id from labels))"""
PAIRS = """turns as (
  select conv_id, turn // 2 as pair_no,
    row_number() over (partition by conv_id, turn // 2 order by turn) - 1 as pos,
    text as sentence, case when role = 'assistant' then 1 else 0 end as label
  from conversations)"""
LOGITS = """logits as (
  select vec_id as id, f::int as fold, embedding[2 * f + 1]::double as l0,
    embedding[2 * f + 2]::double as l1, label % 2 as label
  from embeddings, range(5) r(f))"""
P1 = "exp(l1) / (exp(l0) + exp(l1))"
PREDS = f"""{SENT},
preds as (
  select 'm0' as model, 0 as model_ord, id, label as y, (id % 2)::int as target, lang as experiment
  from sent
  union all
  select 'm1', 1, id, label, case when id % 3 = 0 then 1 else 0 end, lang from sent
  union all
  select 'm2', 2, id, label, case when id % 5 = 0 then 1 - label else label end, lang from sent)"""
RUNS = f"""{PREDS},
by_run as (
  select experiment, model_ord as run_ord, model as name, count(*) as n,
    count(*) filter (y = target) as n_correct, not (model = 'm1' and experiment = 'de') as success
  from preds group by all),
runs as (
  select experiment, run_ord, name, success, n / 100.0::double as time,
    case when success then n_correct::double / n end as accuracy,
    concat('submission_', name, '.csv') as output_file, (n_correct * 10000) // n as bp
  from by_run)"""
KFOLD = f"""{SENT},
sizes as (
  select label, count(*) as c, coalesce(sum(count(*)) over (
    order by label rows between unbounded preceding and 1 preceding), 0) as start
  from sent group by label),
folds as (
  select id, label, ((start + row_number() over (
    partition by label order by md5(concat(id::varchar, ':42')), id) - 1) % 5)::int as fold
  from sent join sizes using (label))"""
HELD_OUT = f"""{KFOLD}, {LOGITS},
held_out as (
  select s.id, s.label, s.fold, {P1} as pred_prob, case when l1 > l0 then 1 else 0 end as target
  from folds s join logits g on s.id = g.id and s.fold = g.fold)"""

CLEAN = f"""regexp_replace(regexp_replace(regexp_replace(
  trim(regexp_replace(sentence, '{WS}+', ' ', 'g')),
  '"[ ](.*?)[ ]"', '"\\1"', 'g'), '[ ]+([.,;!?:''])', '\\1', 'g'), '[ ]*/[ ]*', '/', 'g')"""


def word_list(text: str = "sentence") -> str:
    return f"regexp_extract_all({text}, '{NOT_WS}+')"


def matches(pattern: str) -> str:
    return f"len(regexp_extract_all(sentence, '{pattern}'))"


def ratio(part: str) -> str:
    return f"case when length(sentence) = 0 then 0.0 else ({part})::double / length(sentence) end"


FEATURE_SQL = {
    "char_count": "length(sentence)",
    "word_count": f"len({word_list()})",
    "avg_word_len": f"coalesce(list_avg(list_transform({word_list()}, lambda w: length(w))), 0.0)",
    "punctuation": matches(PUNCT),
    "punctuation_ratio": ratio(matches(PUNCT)),
    "upper_ratio": ratio(matches(cc.UPPER)),
    "digit_ratio": ratio(matches(cc.DIGIT)),
    "space_ratio": ratio(matches(WS)),
}
COUNT_FEATURES = ("char_count", "word_count", "punctuation")


def feature_columns(digits: int | None = None) -> str:
    def column(name):
        if name in COUNT_FEATURES:
            return f"({FEATURE_SQL[name]})::bigint as {name}"
        value = f"({FEATURE_SQL[name]})::double"
        return f"{value if digits is None else f'round({value}, {digits})'} as {name}"

    return ", ".join(column(name) for name in FEATURES)


def featured(relation: str) -> str:
    return f"featured as (select id, {feature_columns()} from {relation})"


WORDS = f"""{SENT},
words as (
  select id, label, unnest(range(len(w))) as pos, unnest(w) as word
  from (select id, label, {word_list("lower(sentence)")} as w from sent))"""
COUNTED = f"""{SENT},
counted as (select label, len({word_list()})::bigint as v from sent)"""


def grams(relation: str, name: str = "grams") -> str:
    tokens = f"regexp_extract_all(lower(sentence), '{cc.WORD_TOKEN}')"
    bigrams = "list_transform(range(1, len(tk)), lambda i: concat(tk[i], ' ', tk[i + 1]))"
    return f"""{name}_lists as (
  select id, list_concat(tk, {bigrams}) as g from (select id, {tokens} as tk from {relation})),
{name} as (select id, unnest(range(len(g))) as pos, unnest(g) as term from {name}_lists)"""


VOCAB = f"""{SENT}, {grams("sent")},
frequency as (
  select term, count(distinct id) as df, count(*) as cf from grams group by term),
vocab as (
  select term, df, cf, ln((1.0 + n) / (1.0 + df)) + 1.0 as idf,
    row_number() over (order by term) - 1 as idx
  from (
    select term, df, cf, n from frequency, (select count(*) as n from sent)
    where df >= 2 and df <= 0.95::double * n order by cf desc, term limit 5000))"""


def weights(source: str) -> str:
    return f"""weighted as (
  select g.id, g.term, (1.0 + ln(count(*))) * any_value(v.idf) as w
  from {source} g join vocab v on g.term = v.term group by g.id, g.term)
select id, term, round(w / sqrt(sum(w * w) over (partition by id)), 6) as weight from weighted"""


def quantile(q: float) -> str:
    return f"quantile_cont(v, {q})"


def length_metric(metric: str, value: str, relation: str) -> str:
    return f"""
select '{metric}' as metric, count(*) as n, round(avg(v), 6) as mean,
  round({quantile(0.5)}::double, 6) as median, round(stddev_pop(v), 6) as std,
  min(v) as min, max(v) as max
from (select ({value})::bigint as v from {relation})"""


REPORT_CLASSES = f"""{PREDS},
classes as (
  select model, c as k,
    count(*) filter (y = c) as support, count(*) filter (target = c) as predicted,
    count(*) filter (y = c and target = c) as hits
  from preds, (select y as c from preds union select target from preds) group by model, c),
scored as (
  select model, k::varchar as class,
    case when predicted = 0 then 0.0 else hits::double / predicted end as precision,
    case when support = 0 then 0.0 else hits::double / support end as recall,
    case when predicted + support = 0 then 0.0 else 2.0 * hits / (predicted + support) end as f1,
    support, hits
  from classes)"""

BOX = f"""{COUNTED},
fences as (
  select label, count(*) as n, avg(v) as mean, quantile_cont(v, 0.25) as q1,
    quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3
  from counted group by label),
placed as (
  select c.label, c.v, f.n, f.mean, f.q1, f.median, f.q3,
    q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi
  from counted c join fences f on c.label = f.label)"""

# Words in byte-level letters, then from place to place by the longest piece; a piece that reaches the
# last letter must hold the end mark as well.
LETTERS = ", ".join("'" + letter.replace("'", "''") + "'" for letter in byte_letters())
SUBWORDS = f"""{WORDS},
pieces as (
  select key as piece, value::int as piece_id, length(key) as size
  from json_each((select content from read_text('{PIECES}')), '$.model.vocab')),
spelled as (
  select word, list_aggregate(list_transform(range(1, octet_length(encode(word)) + 1),
    lambda i: [{LETTERS}][('0x' || hex(encode(word))[2 * i - 1:2 * i])::int + 1]),
    'string_agg', '') as w
  from (select distinct word from words)),
places as (select word, w, unnest(range(1, length(w) + 1)) as place from spelled),
tries as (
  select word, place, size,
    substring(w, place, size) || case when place + size > length(w) then '</w>' else '' end as piece
  from places, (select unnest(range(1, (select max(size) + 1 from pieces))) as size)
  where place + size <= length(w) + 1),
best as (
  select word, place, max(t.size) as step, arg_max(piece_id, t.size) as piece_id
  from tries t join pieces using (piece) group by word, place),
chain as (
  with recursive steps as (
    select word, 1::bigint as place from spelled
    union all
    select s.word, s.place + b.step from steps s join best b on s.word = b.word and s.place = b.place)
  select word, place, piece_id from steps join best using (word, place)),
cut as (select word, list(piece_id order by place) as ids from chain group by word),
pieced as (
  select id, coalesce(flatten(list(ids order by pos)), []) as ids from words join cut using (word)
  group by id),
filled as (
  select sent.id, coalesce(ids, []) as ids from sent left join pieced on sent.id = pieced.id)"""
ORACLE: dict[str, str] = {
    "pair_explode": f"with {PAIRS} select conv_id, pair_no, pos, sentence, label from turns",
    "positional_ids": f"""with {PAIRS}
select row_number() over (order by conv_id, pair_no, pos) - 1 as id, sentence, label from turns""",
    "flat_labelled_scan": f"""with {SENT}
select id // 4 as doc, case when id % 3 <> 0 then id
  else row_number() over (partition by id // 4 order by id) - 1 end as id, sentence, label
from sent""",
    "pair_file_scan": f"with {PAIRS} select pos, sentence, label from turns",
    "test_file_scan": f"with {TEST} select id, sentence from test",
    "oof_csv_roundtrip": f"""with {LOGITS}
select id, label, round({P1}, 6) as pred_prob from logits where fold = 0""",
    "polymorphic_json": """
select conv_id, turn, case when turn % 3 = 1 then turn else 0 end as id, text from conversations
union all select conv_id, turn, 1 as id, role as text from conversations""",
    "csv_roundtrip": f"with {PREDS} select id * 3 + model_ord as id, target from preds",
    "union_existing_sources": f"""with {PREDS}
select model, (case model when 'm2' then 3 else model_ord end)::int as model_ord, id, target
from preds""",
    "project_rename": f"with {SENT} select id, label as labels from sent",
    "filter_by_label": f"with {SENT} select id, sentence, label from sent where label = 1",
    "fold_select": f"with {KFOLD} select id, label, fold from folds where fold <> 0",
    "preview_head": f"""with {PREDS}
select id, target from preds where model = 'm2' order by id limit 10""",
    "run_summary": f"""with {RUNS}
select experiment, run_ord, name, output_file,
  case when success then 'Success' else 'Failed' end as status,
  round(case when success then time end, 6) as time,
  round(nullif(accuracy, 0.0), 6) as accuracy from runs""",
    "prediction_join": f"""with {PREDS}
select a.id, a.target as target_1, b.target as target_2
from preds a join preds b on a.id = b.id where a.model = 'm0' and b.model = 'm1'""",
    "pairwise_agreement": f"""with {PREDS}
select a.model as model_1, b.model as model_2, count(*) filter (a.target = b.target) as agree,
  count(*) as total, round(count(*) filter (a.target = b.target) * 100.0::double / count(*), 6) as pct
from preds a join preds b on a.id = b.id and a.model_ord < b.model_ord group by 1, 2""",
    "oof_alignment_check": f"""with {SENT}, {LOGITS},
a as (select id, label from logits where fold = 0), b as (select id, label from logits where fold = 1),
rows as (
  select 'a_b' as sets, 'x' as side, id, label from a union all
  select 'a_b', 'y', id, label from b union all
  select 'a_sent', 'x', id, label from a union all
  select 'a_sent', 'y', id, label from sent union all
  select 'repeated', 'x', id, label from a union all
  select 'repeated', 'x', id, label from a where id % 3 = 0 union all
  select 'repeated', 'y', id, label from a union all
  select 'repeated', 'y', id, 1 - label from a where id % 3 = 0 union all
  select 'repeated', 'y', id, label from a where id % 5 = 0),
ids as (
  select sets, id, count(*) filter (side = 'x') as nx, count(*) filter (side = 'y') as ny,
    list_sort(list(label) filter (side = 'x')) as lx, list_sort(list(label) filter (side = 'y')) as ly
  from rows group by sets, id)
select sets, count(*) filter (nx = 0) as missing_in_a, count(*) filter (ny = 0) as missing_in_b,
  count(*) filter (nx > 0 and ny > 0 and (
    (nx = ny and lx <> ly) or (nx <> ny and list_distinct(lx).list_sort() <> list_distinct(ly).list_sort())
  )) as label_mismatch,
  count(*) filter (nx > 0 and ny > 0 and nx <> ny) as count_mismatch, count(*) as n_ids
from ids group by sets""",
    "stack_features": f"""with {LOGITS},
oof as (select id, fold, label, round({P1}, 6) as p from logits)
select a.id, a.label, a.p as prob_a, b.p as prob_b
from oof a join oof b on a.id = b.id where a.fold = 0 and b.fold = 1""",
    "oof_assemble": f"""with {HELD_OUT}
select s.id, s.label, round(coalesce(h.pred_prob, 0.0), 6) as pred_prob
from sent s left join held_out h on s.id = h.id""",
    "label_distribution": f"""with {SENT}
select k.label, count(s.id) as n,
  round(count(s.id) * 100.0::double / (select count(*) from sent), 6) as pct
from (select label from sent union select unnest([0, 1, 2])) k
left join sent s on s.label = k.label group by k.label""",
    "prediction_distribution": f"""with {PREDS}
select model, count(*) as n,
  count(*) filter (target = 0) as count_0,
  round(count(*) filter (target = 0) * 100.0::double / count(*), 6) as pct_0,
  count(*) filter (target = 1) as count_1,
  round(count(*) filter (target = 1) * 100.0::double / count(*), 6) as pct_1
from preds group by model""",
    "length_profile": f"with {SENT} "
    + length_metric("chars", "length(sentence)", "sent")
    + " union all "
    + length_metric("words", f"len({word_list()})", "sent"),
    "test_length_profile": f"with {TEST} "
    + length_metric("words", f"len({word_list()})", "test"),
    "stats_by_label": f"""with {SENT},
featured as (select label, {feature_columns()} from sent)
select label, count(*) as n, round(avg(word_count), 6) as word_mean,
  round(stddev_pop(word_count), 6) as word_std, round(avg(char_count), 6) as char_mean,
  round(stddev_pop(char_count), 6) as char_std, round(avg(punctuation), 6) as punct_mean,
  round(avg(upper_ratio), 6) as upper_ratio_mean
from featured group by label""",
    "vocab_totals": f"""with {WORDS}
select count(distinct word) as unique_words, count(*) as total_words,
  round(count(*)::double / (select count(*) from sent), 6) as words_per_sentence from words""",
    "vocab_by_label": f"""with {WORDS}
select label, count(distinct word) as unique_words from words group by label""",
    "feature_means_long": f"""with {SENT},
featured as (select label, {feature_columns()} from sent)
select label, 'word_count' as metric, round(avg(word_count), 6) as value from featured group by label
union all
select label, 'punctuation', round(avg(punctuation), 6) from featured group by label
union all
select label, 'upper_ratio', round(avg(upper_ratio) * 100, 6) from featured group by label""",
    "word_histogram": f"""with {COUNTED},
span as (select min(v)::double as lo, max(v)::double as hi from counted),
range_ as (
  select case when lo = hi then lo - 0.5 else lo end as lo,
    case when lo = hi then hi + 0.5 else hi end as hi from span),
edges as (
  select i, (i - 1) * ((hi - lo) / 30.0::double) + lo as a,
    case when i = 30 then hi else i * ((hi - lo) / 30.0::double) + lo end as b
  from range_, range(1, 31) r(i))
select l.label, e.i as bin, round(e.a, 6) as bin_low, round(e.b, 6) as bin_high, count(c.v) as n
from (select distinct label from counted) l cross join edges e
left join counted c
  on c.label = l.label and c.v >= e.a and (c.v < e.b or (e.i = 30 and c.v <= e.b))
group by all""",
    "box_stats": f"""with {BOX}
select label, n, round(mean, 6) as mean, round(q1, 6) as q1, round(median, 6) as median,
  round(q3, 6) as q3, round(least(min(v) filter (v >= lo), q1), 6)::double as whisker_low,
  round(greatest(max(v) filter (v <= hi), q3), 6)::double as whisker_high,
  count(*) filter (v < lo or v > hi) as n_outliers
from placed group by label, n, placed.mean, placed.q1, placed.median, placed.q3""",
    "box_outliers": f"""with {BOX}
select label, v as value, count(*) as n from placed where v < lo or v > hi group by label, v""",
    "feature_quartiles": f"""with {SENT},
featured as (select label, {feature_columns()} from sent)
"""
    + " union all ".join(
        f"select label, '{f}' as metric, {p}::double as probability, count(*) as n, "
        f"round(quantile_cont({f}, {p}), 6) as value from featured group by label"
        for f in ("avg_word_len", "punctuation_ratio", "upper_ratio", "space_ratio")
        for p in (0.25, 0.5, 0.75)
    ),
    "accuracy_f1": f"""with {PREDS}
select model, count(*) as n, round(avg((y = target)::int), 6) as accuracy,
  round(coalesce(2.0::double * count(*) filter (y = 1 and target = 1)
    / nullif(count(*) filter (y = 1) + count(*) filter (target = 1), 0), 0.0), 6) as f1
from preds group by model""",
    "classification_report": f"""with {REPORT_CLASSES}
select model, class, round(precision, 6) as precision, round(recall, 6) as recall,
  round(f1, 6) as f1, support from scored
union all
select model, 'accuracy', round(sum(hits)::double / sum(support), 6),
  round(sum(hits)::double / sum(support), 6), round(sum(hits)::double / sum(support), 6),
  sum(support)::bigint from scored group by model
union all
select model, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  sum(support)::bigint from scored group by model
union all
select model, 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  sum(support)::bigint from scored group by model""",
    "cv_mean_f1": f"""with {LOGITS},
samples as (select id, label from logits where fold = 0),
sizes as (
  select label, count(*) as c, coalesce(sum(count(*)) over (
    order by label rows between unbounded preceding and 1 preceding), 0) as start
  from samples group by label),
folds as (
  select id, label, ((start + row_number() over (
    partition by label order by md5(concat(id::varchar, ':42')), id) - 1) % 5)::int as fold
  from samples join sizes using (label)),
held_out as (
  select s.label, s.fold, case when l1 > l0 then 1 else 0 end as target
  from folds s join logits g on s.id = g.id and s.fold = g.fold),
per_fold as (
  select fold, coalesce(2.0::double * count(*) filter (label = 1 and target = 1)
    / nullif(count(*) filter (label = 1) + count(*) filter (target = 1), 0), 0.0) as f1
  from held_out group by fold)
select count(*) as n_folds, round(avg(f1), 6) as mean_f1 from per_fold""",
    "fold_prob_mean": f"""with {LOGITS}
select 'a' as model, id, round(avg({P1}), 6) as pred_prob from logits group by id""",
    "fold_logit_mean": f"""with {LOGITS},
means as (select id, avg(l0) as l0, avg(l1) as l1 from logits group by id)
select id, round({P1}, 6) as pred_prob, (case when l1 > l0 then 1 else 0 end)::int as label
from means""",
    "ngram_df": f"""with {SENT}, {grams("sent")}
select term, count(distinct id) as df, count(*) as cf from grams group by term""",
    "standardize_stats": f"with {SENT}, {featured('sent')} "
    + " union all ".join(
        f"select '{f}' as feature, round(avg({f}), 6) as mean, round(stddev_pop({f}), 6) as std "
        "from featured"
        for f in FEATURES
    ),
    "smoothed_cross_entropy": f"""with {LOGITS},
logp as (
  select fold, label, l0 - ln(exp(l0) + exp(l1)) as lp0, l1 - ln(exp(l0) + exp(l1)) as lp1
  from logits)
select fold, count(*) as n, round(avg(
  -0.9 * case when label = 1 then lp1 else lp0 end - 0.1 * (lp0 + lp1) / 2), 6) as loss
from logp group by fold""",
    "stratified_kfold": f"with {KFOLD} select id, label, fold from folds",
    "stratified_holdout": f"""with {SENT},
counts as (select label, count(*) as c from sent group by label),
wanted as (
  select label, c, ceil(0.2::double * sum(c) over ())::bigint as w, (sum(c) over ())::bigint as n
  from counts),
parts as (select label, (c * w) // n as base, (c * w) % n as rest, w from wanted),
quotas as (
  select label, base + case when row_number() over (order by rest desc, label)
    <= w - sum(base) over () then 1 else 0 end as quota from parts)
select id, s.label, row_number() over (
  partition by s.label order by md5(concat(id::varchar, ':42')), id) <= quota as is_test
from sent s join quotas q on s.label = q.label""",
    "vocab_index": f"with {VOCAB} select term, df, cf, round(idf, 6) as idf, idx from vocab",
    "rank_runs": f"""with {RUNS}
select experiment, name, round(accuracy, 6) as accuracy, round(time, 6) as time, output_file,
  1::int as rank
from (select *, row_number() over (partition by experiment order by accuracy desc, run_ord) as r
  from runs where success and accuracy <> 0) where r = 1""",
    "top_words": f"""with {WORDS}
select word, n, round(n * 100.0::double / (select count(*) from words), 6) as pct
from (select word, count(*) as n, min((id, pos)) as first_seen from words group by word)
order by n desc, first_seen limit 20""",
    "natural_sort": f"""with {SENT},
names as (
  select case when id % 50 = 0 then 'final' else concat('fold', id % 12) end as name from sent)
select name, count(*) as n,
  coalesce(nullif(regexp_replace(name, '[^0-9]', '', 'g'), '')::bigint, 999) as sort_key
from names group by name""",
    "subword_inputs": f"""with {SUBWORDS}
select id, array_to_string(list_resize(ids[:128], 128, 0), ',') as input_ids,
  rpad(repeat('1', least(len(ids), 128)::int), 128, '0') as mask, len(ids) as n_pieces,
  len(ids) > 128 as truncated from filled""",
    "vocab_overlap": f"""with {WORDS},
flags as (
  select word, bool_or(label = 0) as a, bool_or(label = 1) as b from words group by word)
select count(*) filter (a and not b) as only_first, count(*) filter (b and not a) as only_second,
  count(*) filter (a and b) as shared from flags""",
    "sketched_vocab_by_label": f"""with {WORDS}
select label, count(distinct word) as unique_words, count(*) as total_words, 0::bigint as bound
from words group by label""",
    "sketched_vocab_overlap": f"""with {WORDS},
flags as (
  select word, bool_or(label = 0) as a, bool_or(label = 1) as b from words group by word)
select count(*) filter (a and not b) as only_first, count(*) filter (b and not a) as only_second,
  count(*) filter (a and b) as shared, 0::bigint as bound from flags""",
    "vocab_except": f"""with {WORDS}
select word from words where label = 0 except select word from words where label = 1""",
    "vocab_intersect": f"""with {WORDS}
select word from words where label = 0 intersect select word from words where label = 1""",
    "union_predictions": f"with {PREDS} select id, target from preds",
    "clean_text": f"with {DIRTY} select id, {CLEAN} as sentence, label from dirty",
    "text_features": f"with {DIRTY} select id, label, {feature_columns(6)} from dirty",
    "streamed_features": f"""with {SENT},
cleaned as (select id, label, {CLEAN} as sentence from sent)
select id, label, {feature_columns(6)} from cleaned""",
    "tokens_ws": f"with {WORDS} select id, pos::int as pos, word as token from words",
    "tokens_word": f"""with {SENT},
lists as (
  select id, regexp_extract_all(lower(sentence), '{cc.WORD_TOKEN}') as tk from sent)
select id, unnest(range(len(tk)))::int as pos, unnest(tk) as token from lists""",
    "ngrams_1_2": f"with {SENT}, {grams('sent')} select id, pos::int as pos, term from grams",
    "tfidf_weights": f"with {VOCAB}, {weights('grams')}",
    "tfidf_transform": f"with {VOCAB}, {TEST}, {grams('test', 'unseen')}, {weights('unseen')}",
    "standardize_apply": f"""with {SENT}, {TEST}, {featured('sent')},
unseen as (select id, {feature_columns()} from test)
select u.id, """
    + ", ".join(
        f"round((u.{f} - (select avg({f}) from featured)) / "
        f"coalesce(nullif((select stddev_pop({f}) from featured), 0), 1), 6) as {f}"
        for f in FEATURES
    )
    + " from unseen u",
    "softmax_probs": f"""with {LOGITS}
select id, fold, round(1 - {P1}, 6) as p0, round({P1}, 6) as p1 from logits""",
    "argmax_label": f"""with {LOGITS}
select id, fold, (case when l1 > l0 then 1 else 0 end)::int as target from logits""",
    "log_metric_extract": f"""with {RUNS}
select concat(experiment, '/', name) as run_id,
  case when success then bp / 10000.0::double end as accuracy from runs""",
    "truncate_pad": f"""with {SENT},
lists as (
  select id, regexp_extract_all(lower(sentence), '{cc.WORD_TOKEN}') as tk from sent)
select id, array_to_string(list_concat(tk[1:128], list_transform(
    range(128 - least(len(tk), 128)), lambda i: '<pad>')), ' ') as padded,
  concat(repeat('1', least(len(tk), 128)), repeat('0', 128 - least(len(tk), 128))) as mask,
  len(tk) > 128 as truncated
from lists""",
    "batch_score": "select vec_id as id, "
    + ", ".join(
        "round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::double "
        f"* (((i * 7 + {3 * c}) % 11 - 5) / 10.0::double))), 6) as l{c}"
        for c in (0, 1)
    )
    + " from embeddings",
}

# Fitted models.  The stacker's objective is strictly convex, so Newton steps give its weights; of
# the other fits the SQL states what does not depend on the random numbers of a library.

STACKED = f"""{LOGITS},
oof as (select id, fold, label, {P1} as p from logits),
stacked as (
  select a.id, a.label::double as y, a.p as a, b.p as b
  from oof a join oof b on a.id = b.id where a.fold = 0 and b.fold = 1)"""

NEWTON = f"""with recursive {STACKED},
newton as (
  select 0 as i, 0.0::double as wa, 0.0::double as wb, 0.0::double as w0
  union all
  select i + 1,
    wa - (ga * (hbb * h00 - hb0 * hb0) - hab * (gb * h00 - hb0 * g0) + ha0 * (gb * hb0 - hbb * g0)) / det,
    wb - (haa * (gb * h00 - g0 * hb0) - ga * (hab * h00 - hb0 * ha0) + ha0 * (hab * g0 - gb * ha0)) / det,
    w0 - (haa * (hbb * g0 - hb0 * gb) - hab * (hab * g0 - gb * ha0) + ga * (hab * hb0 - hbb * ha0)) / det
  from (
    select *, haa * (hbb * h00 - hb0 * hb0) - hab * (hab * h00 - hb0 * ha0)
      + ha0 * (hab * hb0 - hbb * ha0) as det
    from (
      select i, wa, wb, w0, sum((p - y) * a) + wa as ga, sum((p - y) * b) + wb as gb, sum(p - y) as g0,
        sum(q * a * a) + 1 as haa, sum(q * b * b) + 1 as hbb, sum(q) as h00,
        sum(q * a * b) as hab, sum(q * a) as ha0, sum(q * b) as hb0
      from (
        select n.*, s.a, s.b, s.y, 1 / (1 + exp(-(wa * s.a + wb * s.b + w0))) as p,
          1 / (1 + exp(-(wa * s.a + wb * s.b + w0))) * (1 - 1 / (1 + exp(-(wa * s.a + wb * s.b + w0)))) as q
        from newton n, stacked s where n.i < 20)
      group by i, wa, wb, w0))),
fitted as (select wa, wb, w0 from newton where i = 20)"""

ORACLE |= {
    "stacker_fit": f"""{NEWTON},
scored as (
  select y, case when wa * a + wb * b + w0 > 0 then 1 else 0 end as target from stacked, fitted)
select round(wa, 4) as coef_a, round(wb, 4) as coef_b, round(w0, 4) as intercept,
  (select count(*) from scored) as n,
  (select round(coalesce(2.0::double * count(*) filter (y = 1 and target = 1)
    / nullif(count(*) filter (y = 1) + count(*) filter (target = 1), 0), 0.0), 4) from scored) as f1
from fitted""",
    "stacker_predict": f"""{NEWTON},
means as (
  select id, avg(p) filter (fold % 2 = 0) as a, avg(p) filter (fold % 2 = 1) as b from oof group by id)
select id, (case when wa * a + wb * b + w0 > 0 then 1 else 0 end)::int as target from means, fitted""",
}

# One model per fold on the rows of the other folds; Newton steps on all of them at once.
FOLD_MODELS = f"""with recursive {KFOLD}, {TEST},
shaped as (
  select f.id, f.fold, f.label::double as y, ln(length(s.sentence) + 1.0::double) / 10 as a,
    (length(s.sentence) - length(replace(s.sentence, ' ', ''))) / (length(s.sentence) + 1.0::double) as b
  from folds f join sent s on f.id = s.id),
newton as (
  select 0 as i, m::int as m, 0.0::double as wa, 0.0::double as wb, 0.0::double as w0 from range(5) r(m)
  union all
  select i + 1, m,
    wa - (ga * (hbb * h00 - hb0 * hb0) - hab * (gb * h00 - hb0 * g0) + ha0 * (gb * hb0 - hbb * g0)) / det,
    wb - (haa * (gb * h00 - g0 * hb0) - ga * (hab * h00 - hb0 * ha0) + ha0 * (hab * g0 - gb * ha0)) / det,
    w0 - (haa * (hbb * g0 - hb0 * gb) - hab * (hab * g0 - gb * ha0) + ga * (hab * hb0 - hbb * ha0)) / det
  from (
    select *, haa * (hbb * h00 - hb0 * hb0) - hab * (hab * h00 - hb0 * ha0)
      + ha0 * (hab * hb0 - hbb * ha0) as det
    from (
      select i, m, wa, wb, w0, sum((p - y) * a) + wa as ga, sum((p - y) * b) + wb as gb, sum(p - y) as g0,
        sum(q * a * a) + 1 as haa, sum(q * b * b) + 1 as hbb, sum(q) as h00,
        sum(q * a * b) as hab, sum(q * a) as ha0, sum(q * b) as hb0
      from (
        select n.*, s.a, s.b, s.y, 1 / (1 + exp(-(wa * s.a + wb * s.b + w0))) as p,
          1 / (1 + exp(-(wa * s.a + wb * s.b + w0))) * (1 - 1 / (1 + exp(-(wa * s.a + wb * s.b + w0)))) as q
        from newton n join shaped s on s.fold <> n.m where n.i < 12)
      group by i, m, wa, wb, w0))),
fitted as (select * from newton where i = 12),
logits as (
  select t.id, m as fold, wa * (ln(length(sentence) + 1.0::double) / 10) + w0
    + wb * ((length(sentence) - length(replace(sentence, ' ', ''))) / (length(sentence) + 1.0::double)) as l1
  from test t, fitted)"""

# Spark ML's hash of a word: 32-bit MurmurHash3 with seed 42 over its bytes, cut to 16 bits.


def _rotated(value: str, bits: int) -> str:
    return f"((({value} << {bits}) & 4294967295) | ({value} >> {32 - bits}))"


def _hex_digit(position: str) -> str:
    return f"(strpos('0123456789ABCDEF', substr(h, ({position})::bigint, 1)) - 1)"


SLOTS = f"""blocks as (
  select word, size, list_transform(range((size + 3) // 4), lambda i: list_sum(list_transform(range(4),
    lambda j: ({_hex_digit("8 * i + 2 * j + 1")} * 16 + {_hex_digit("8 * i + 2 * j + 2")}) * (1::bigint << (8 * j)))
    )::ubigint) as ks
  from (
    select word, octet_length(encode(word)) as size, rpad(hex(encode(word)), (8 * ((size + 3) // 4))::int, '0') as h
    from (select distinct word from counts))),
mixed as (
  select word, size, list_transform(list_transform(ks, lambda k: (k * 3432918353) & 4294967295),
    lambda k: ({_rotated("k", 15)} * 461845907) & 4294967295) as ks
  from blocks),
summed as (
  select word, xor(size::ubigint, xor(
    list_reduce(ks[:size // 4], lambda h, k: ({_rotated("xor(h, k)", 13)} * 5 + 3864292196) & 4294967295, 42::ubigint),
    case when size % 4 > 0 then ks[-1] else 0 end)) as h
  from mixed),
slots as (
  select word, (xor(h, h >> 16) & 65535)::int as slot from (
    select word, (xor(h, h >> 13) * 3266489909) & 4294967295 as h from (
      select word, (xor(h, h >> 16) * 2246822507) & 4294967295 as h from summed)))"""

# The models of all folds on the hashed words of whole texts.  A row r is a text, with a null fold if
# it has no label; slot -1 is the constant.
WORD_MODELS = f"""with recursive {KFOLD}, {TEST},
texts as materialized (
  select row_number() over () as r, * from (
    select f.id, f.label, f.fold, s.sentence from folds f join sent s on f.id = s.id
    union all
    select id, null, null, sentence from test)),
counts as materialized (
  select r, word, count(*) as n
  from (select r, unnest(regexp_extract_all(lower(sentence), '{cc.WORD_TOKEN}')) as word from texts)
  group by all),
{SLOTS},
counted as materialized (select r, slot, sum(n)::double as tf from counts join slots using (word) group by all),
seen as materialized (
  select r, m::int as m, label::double as y, count(*) over (partition by m) as n
  from texts, range(5) f(m) where label is not null and fold <> m),
idf as (
  select m, slot, ln((n + 1.0::double) / (count(*) + 1)) as idf
  from counted join seen using (r) group by m, slot, n having count(*) >= 2),
weighed as (select r, m, slot, tf * idf as x from counted join idf using (slot) where idf > 0),
inputs as materialized (
  select r, m, slot, x / sqrt(sum(x * x) over (partition by r, m)) as x from weighed
  union all
  select r, m::int, -1, 1.0::double from texts, range(5) f(m)),
known as materialized (select * from inputs join seen using (r, m)),
steps as (
  select 0 as i, m, slot, 0.0::double as w, 0.0::double as ahead from (select distinct m, slot from known)
  union all
  select i + 1, m, slot, w1, w1 + (sqrt(26.0::double) - 1) / (sqrt(26.0::double) + 1) * (w1 - w) from (
    select s.i, s.m, s.slot, s.w, s.ahead - (g.g + case when s.slot >= 0 then 0.02 * s.ahead else 0 end) / 0.52::double as w1
    from steps s join (
      select k.m, k.slot, sum(k.x * e.e) as g
      from known k join (
        select k.m, k.r, (1 / (1 + exp(-sum(s.ahead * k.x))) - any_value(k.y)) / any_value(k.n) as e
        from known k join steps s on k.m = s.m and k.slot = s.slot group by k.m, k.r) e
      on k.m = e.m and k.r = e.r
      group by k.m, k.slot) g on s.m = g.m and s.slot = g.slot
    where s.i < 40)),
logits as (
  select t.id, t.label, t.fold as own, m as fold, sum(w * x) as l1
  from texts t join inputs using (r) join steps using (m, slot) where i = 40
  group by r, t.id, t.label, t.fold, m)"""

ORACLE |= {
    "json_array_scan": f"""with {SENT}
select id // 2000 as file, case when id % 3 <> 0 then id
  else row_number() over (partition by id // 2000 order by id) - 1 end as id, sentence, label
from sent""",
    "oof_generate": f"""{WORD_MODELS}
select id, label::int as label, fold, round(1 / (1 + exp(-l1)), 5) as pred_prob from logits where own = fold""",
    "fold_test_scores": f"""{WORD_MODELS}
select id, round(1 / (1 + exp(-avg(l1))), 5) as pred_prob, (avg(l1) > 0)::int as label, count(*) as n_folds
from logits where own is null group by id""",
    "stored_fold_scores": f"{FOLD_MODELS} select id, fold, round(l1, 5) as l1 from logits",
}
ORACLE["oof_reconciliation"] = ORACLE["oof_alignment_check"]
