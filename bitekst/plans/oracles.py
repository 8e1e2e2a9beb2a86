"""The registered questions as SQL over the same tables (DuckDB dialect)."""

from __future__ import annotations

# Whitespace and word classes, spelled out for the SQL engine's regular expressions.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
W = r"\p{L}\p{N}_"
BLANK = WS.replace(r"\t-\r", r"\t\x0b\x0c")


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{WS}]+|[{WS}]+\z', '', 'g')"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({clean(x)}, ' '), lambda w_: w_ <> '')"


def r6(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) as {name or x}"


# --- derived inputs ------------------------------------------------------------------------

TITLED = r"""
titled as (
  select doc_id, case when lang = 'en' then string_split(text, chr(10))[1] || chr(10) || text
         else text end as text
  from documents)
"""

PAIRS = f"""
pw as (select doc_id, lang, {words('text')} as w from documents),
ph as (
  select doc_id, lang, w,
    case when doc_id % 13 = 0 then list_filter(w, lambda x, i: (i - 1) % 3 = 0)
         when doc_id % 17 = 0 then list_concat(w, w)
         when doc_id % 19 = 0 then list_reverse(w)
         else list_filter(w, lambda x, i: ((i - 1) * 7 + doc_id) % 11 <> 0) end as h
  from pw),
pairs as (
  select doc_id as pair_id, lang, array_to_string(w, ' ') as source,
    array_to_string(h, ' ') as prediction, array_to_string(w, ' ') as reference
  from ph)
"""

CORPUS = f"""
corpus as (
  select doc_id as pair_id, lang, text as source,
    array_to_string(list_reverse({words('text')}), ' ') as target
  from documents)
"""

TURNS = """
turns as (
  select a.conv_id * 1000 + a.turn as pair_id, a.text as source, b.text as target
  from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)
"""

GLOSSARY = f"""
gw as (
  select item_id,
    list_filter(string_split(regexp_replace(text, '[^\\p{{L}}]+', ' ', 'g'), ' '), lambda x: x <> '') as w
  from benchmark),
gk as (select item_id, w, unnest(range(0, greatest((len(w) - 1) // 6, 0) + 1)) as k from gw),
ge as (
  select (item_id * 1000 + k) * 2 as ord, ' ' || w[6 * k + 1] || ' ' || w[6 * k + 2] as en,
    w[6 * k + 3] || ' ' || w[6 * k + 4] as no_ from gk
  union all select (item_id * 1000 + k) * 2 + 1, w[6 * k + 5], w[6 * k + 6] from gk),
gs as (
  select ord, lower({strip("coalesce(en, '')")}) as s, lower({strip("coalesce(no_, '')")}) as t
  from ge),
glossary as (
  select s as src_term, arg_max(t, ord) as tgt_term, min(ord) as ord
  from gs where s <> '' and t <> '' group by s),
inverse as (
  select tgt_term as src_term, arg_max(src_term, ord) as tgt_term, min(ord) as ord
  from glossary group by tgt_term)
"""

SENTENCES = f"""
sb as (
  select e.vec_id // 10 as doc_id, e.vec_id, e.label, coalesce({clean('d.text')}, 'vector ' || e.vec_id) as sent,
    list_transform(e.embedding, lambda x: x::double) as v
  from embeddings e left join documents d on d.doc_id = e.vec_id),
sl as (
  select *, case when label = lag(label) over (partition by doc_id order by vec_id) then 0 else 1 end as fresh
  from sb),
sp as (
  select *, row_number() over (partition by doc_id order by vec_id) - 1 as en_pos,
    sum(fresh) over (partition by doc_id order by vec_id) - 1 as no_pos
  from sl),
en_s as (select doc_id, en_pos::bigint as pos, sent, v from sp),
no_s as (
  select doc_id, no_pos::bigint as pos, 'no: ' || sent as sent,
    list_transform(v, lambda x, i: x + 0.02::double * (((i - 1) * 7 + vec_id) % 5 - 2)) as v
  from sp where fresh = 1),
cnt as (
  select doc_id, count(*) filter (side = 'en') as n_en, count(*) filter (side = 'no') as n_no
  from (select doc_id, 'en' as side from en_s union all select doc_id, 'no' from no_s) group by doc_id),
cells as (
  select a.doc_id, a.pos as en_pos, b.pos as no_pos, a.sent as en, b.sent as no_,
    list_cosine_similarity(a.v, b.v) as sim
  from en_s a join no_s b on a.doc_id = b.doc_id),
seq as (
  select c.* from cells c join cnt using (doc_id)
  where abs(n_en - n_no) <= 1 and en_pos = no_pos and sim >= 0.75),
edges as (
  select c.*, row_number() over (partition by c.doc_id order by sim desc, en_pos, no_pos) as rn
  from cells c join cnt using (doc_id)
  where abs(n_en - n_no) > 1 and sim >= 0.75),
greedy as (
  select doc_id, 0::bigint as rn, []::bigint[] as used_en, []::bigint[] as used_no, false as taken
  from (select distinct doc_id from edges)
  union all
  select g.doc_id, e.rn,
    case when free then list_append(g.used_en, e.en_pos) else g.used_en end,
    case when free then list_append(g.used_no, e.no_pos) else g.used_no end,
    free
  from greedy g join edges e on e.doc_id = g.doc_id and e.rn = g.rn + 1,
    lateral (select not list_contains(g.used_en, e.en_pos) and not list_contains(g.used_no, e.no_pos) as free)),
one_to_one as (
  select e.* exclude (rn) from edges e join greedy g on g.doc_id = e.doc_id and g.rn = e.rn where g.taken),
aligned as (
  select *, 'sequential' as method from seq union all select *, 'mutual' from one_to_one),
doc_stats as (
  select c.doc_id, n_en as en_sentences, n_no as no_sentences, count(sim) as aligned_pairs,
    coalesce(avg(sim), 0) as avg_similarity
  from cnt c left join aligned a on a.doc_id = c.doc_id group by all)
"""

# The best assignment by a table over the sets of taken sentences of the shorter side; the longer side
# goes through it sentence by sentence, each with a partner or without one.
ASSIGNMENT = f"""{SENTENCES},
shape as (select doc_id, n_en, n_no from cnt where abs(n_en - n_no) > 1 and least(n_en, n_no) > 0),
options as (select doc_id, en_pos, no_pos, sim from cells join shape using (doc_id)
  union all select distinct doc_id, en_pos, -1, 0 from cells join shape using (doc_id)),
sets as (
  select doc_id, 0::bigint as n, 0::bigint as taken, struct_pack(total := 0::double, path := []::bigint[]) as b from shape
  union all
  select s.doc_id, s.n + 1, case when o.no_pos < 0 then s.taken else s.taken | (1::bigint << o.no_pos::int) end,
    max(struct_pack(total := s.b.total + o.sim, path := list_append(s.b.path, o.no_pos)))
  from sets s join options o on o.doc_id = s.doc_id and o.en_pos = s.n and (o.no_pos < 0 or s.taken & (1::bigint << o.no_pos::int) = 0)
  group by s.doc_id, s.n + 1, case when o.no_pos < 0 then s.taken else s.taken | (1::bigint << o.no_pos::int) end),
full_ as (
  select s.doc_id, n_no, unnest(b.path) as no_pos, generate_subscripts(b.path, 1) - 1 as en_pos
  from sets s join shape using (doc_id) where n = n_en and taken = (1::bigint << n_no::int) - 1),
assigned as (select c.* from full_ f join cells c on c.doc_id = f.doc_id and c.en_pos = f.en_pos and c.no_pos = f.no_pos)
"""

_PICK = "case {} % 3 when 0 then {} when 1 then {} else {} end"
RUNS = f"""
ln as (
  select l_orderkey, l_linenumber, max(l_partkey) as l_partkey, max(l_suppkey) as l_suppkey,
    max(l_quantity) as l_quantity, max(l_extendedprice) as l_extendedprice,
    max(l_discount) as l_discount, max(l_tax) as l_tax, max(l_returnflag) as l_returnflag,
    max(l_linestatus) as l_linestatus
  from lineitem group by l_orderkey, l_linenumber),
runs as (
  select l_suppkey as experiment, l_orderkey * 10 + l_linenumber as ord, l_partkey % 100 as config_id,
    ({_PICK.format('l_linenumber', 8, 16, 32)})::int as r,
    ({_PICK.format('l_quantity', 16, 32, 64)})::int as alpha,
    l_discount as dropout, l_linenumber as run, l_partkey % 500 + 100 as data_size,
    l_extendedprice / 209000.0::double as test_bleu, l_quantity * 2 as test_chrf, 1 - l_tax as val_loss,
    l_returnflag = 'R' as failed,
    case when l_returnflag = 'R' then 'FAIL' when l_linestatus = 'F' then 'PRUNED' else 'COMPLETE' end as state,
    l_linestatus as stage
  from ln),
valid as (select * from runs where not failed)
"""

CONFIGS = """
configs as (
  select event_id as run_id,
    '{"run":{"id":' || event_id || ',"kind":"' || event_type || '","extra":{"props":' || props ||
    ',"none":{}}},"user":' || user_id || ',"tags":["a",' || user_id || ']}' as config
  from events),
flat as (
  select run_id, 'run.id' as path, config->>'$.run.id' as value from configs
  union all select run_id, 'run.kind', config->>'$.run.kind' from configs
  union all select run_id, 'run.extra.props.' || k, config->>('$.run.extra.props.' || k)
    from (select run_id, config, unnest(json_keys(config, '$.run.extra.props')) as k from configs)
  union all select run_id, 'user', config->>'$.user' from configs
  union all select run_id, 'tags', config->>'$.tags' from configs)
"""

MODELS = """
models as (
  select 'model-' || event_id || '_' || strftime(ts, '%Y%m%d_%H%M%S') as id,
    'model-' || event_id as name, event_type as experiment,
    strftime(ts, '%Y%m%d_%H%M%S') as timestamp,
    'models/experiments/' || event_type || '/model-' || event_id || '_' ||
      strftime(ts, '%Y%m%d_%H%M%S') || '/model' as path,
    value / 100 as test_bleu, ts, event_id
  from events)
"""


# --- n-gram scores -------------------------------------------------------------------------


def tok(x: str) -> str:
    for a, b in (
        ("'<skipped>'", "''"),
        ("'-' || chr(10)", "''"),
        ("chr(10)", "' '"),
        ("'&quot;'", "'\"'"),
        ("'&amp;'", "'&'"),
        ("'&lt;'", "'<'"),
        ("'&gt;'", "'>'"),
    ):
        x = f"replace({x}, {a}, {b})"
    x = f"' ' || {x} || ' '"
    for pattern, replacement in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"
    return f"list_filter(string_split(regexp_replace({x}, '[{WS}]+', ' ', 'g'), ' '), lambda w_: w_ <> '')"


def _ngrams(units: str, sep: str, orders: int, prefix: str) -> str:
    """Rows of clipped counts from units(pair_id, h, r) with lists h and r."""
    leads = "".join(
        f", lead(u, {k}) over (partition by pair_id, hh order by pos) as u{k}" for k in range(1, orders)
    )
    parts = []
    for n in range(1, orders + 1):
        gram = "u" + "".join(f" || '{sep}' || u{k}" for k in range(1, n))
        last = f"u{n - 1} is not null" if n > 1 else "true"
        parts.append(f"select pair_id, {n} as n, {gram} as g, hh, 1 - hh as rr from {prefix}u where {last}")
    union = " union all ".join(parts)
    sums = []
    for n in range(1, orders + 1):
        sums += [
            f"coalesce(sum(least(h, r)) filter (n = {n}), 0)::bigint as m{n}",
            f"coalesce(sum(h) filter (n = {n}), 0)::bigint as h{n}",
            f"coalesce(sum(r) filter (n = {n}), 0)::bigint as r{n}",
        ]
    return f"""
{prefix}place as (
  select pair_id, 1 as hh, unnest(h) as u, unnest(range(0, len(h))) as pos from {units}
  union all select pair_id, 0, unnest(r), unnest(range(0, len(r))) from {units}),
{prefix}u as (select pair_id, hh, u{leads} from {prefix}place),
{prefix}g as ({union}),
{prefix}c as (select pair_id, n, g, sum(hh) as h, sum(rr) as r from {prefix}g group by pair_id, n, g),
{prefix}rows as (
  select p.pair_id, p.lang, {', '.join(sums)}
  from pairs p left join {prefix}c c on c.pair_id = p.pair_id group by p.pair_id, p.lang)
"""


TOKENS = f"tokens as (select pair_id, lang, {tok('prediction')} as h, {tok('reference')} as r from pairs)"
CHARS = f"""chars as (
  select pair_id, lang, string_split(regexp_replace(prediction, '[{WS}]+', '', 'g'), '') as h,
    string_split(regexp_replace(reference, '[{WS}]+', '', 'g'), '') as r
  from (select pair_id, lang, prediction, reference from pairs))"""
WORD_ROWS = TOKENS + "," + _ngrams("tokens", " ", 4, "w")
CHAR_ROWS = CHARS + "," + _ngrams("chars", "", 6, "c")


def bleu(m: str = "m{}", h: str = "h{}", ref: str = "r1") -> str:
    logs = " + ".join(f"ln({m.format(n)} / {h.format(n)})" for n in range(1, 5))
    least = ", ".join(m.format(n) for n in range(1, 5))
    hyp = h.format(1)
    return (
        f"case when least({least}) > 0 and {hyp} > 0 and {ref} > 0 then "
        f"(case when {hyp} > {ref} then 1.0 else exp(1 - {ref} / {hyp}) end) * exp(({logs}) / 4) else 0.0 end"
    )


def chrf(c: str = "") -> str:
    both = [f"(({c}h{n} > 0 and {c}r{n} > 0)::int)" for n in range(1, 7)]
    p = " + ".join(f"(case when {b} = 1 then {c}m{n} / {c}h{n} else 0 end)" for n, b in enumerate(both, 1))
    r = " + ".join(f"(case when {b} = 1 then {c}m{n} / {c}r{n} else 0 end)" for n, b in enumerate(both, 1))
    k = " + ".join(both)
    return (
        f"case when ({k}) > 0 and ({p}) + ({r}) > 0 then 500.0 * (({p}) / ({k})) * (({r}) / ({k}))"
        f" / (4 * (({p}) / ({k})) + (({r}) / ({k}))) else 0.0 end"
    )


def _pooled(source: str, orders: int, by: str = "", guard: bool = False) -> str:
    cols = []
    for n in range(1, orders + 1):
        hyp = f"case when r{n} > 0 then h{n} else 0 end" if guard else f"h{n}"
        cols += [
            f"coalesce(sum(m{n}), 0)::bigint as m{n}",
            f"coalesce(sum({hyp}), 0)::bigint as h{n}",
            f"coalesce(sum(r{n}), 0)::bigint as r{n}",
        ]
    group = f"group by {by}" if by else ""
    return f"select {by + ', ' if by else ''}{', '.join(cols)} from {source} {group}"


ROW_SCORES = f"""
scored as (
  select w.pair_id, {bleu('w.m{}', 'w.h{}', 'w.r1')} as bleu, {chrf('c.')} as chrf
  from wrows w join crows c on c.pair_id = w.pair_id)
"""

ERROR_TYPE = """
  case when len(hw) < len(rw) * 0.5 then 'under_generation'
       when len(hw) > len(rw) * 1.5 then 'over_generation'
       when len(list_intersect(list_distinct(hw), list_distinct(rw))) < len(list_distinct(rw)) * 0.5
         then 'semantic_drift'
       else 'minor_error' end
"""
CLASSES = f"""
classes as (
  select pair_id, {ERROR_TYPE} as error_type
  from (select pair_id, {words('prediction')} as hw, {words('reference')} as rw from pairs))
"""
SAMPLES = """
samples as (
  select p.pair_id, p.source, p.prediction, p.reference, s.bleu, s.chrf, c.error_type
  from scored s join pairs p on p.pair_id = s.pair_id join classes c on c.pair_id = s.pair_id
  where s.bleu < 0.5 order by s.bleu, s.pair_id limit 100)
"""
REPORT = f"""
wp as ({_pooled('wrows', 4)}),
cp as ({_pooled('crows', 6, guard=True)}),
report as (
  select {bleu()} as bleu,
    {', '.join(f'(case when h{n} > 0 then m{n} / h{n} else 0 end) as bleu_{n}' for n in range(1, 5))},
    (select {chrf()} from cp) as chrf
  from wp)
"""
REPORT_BY_LANG = f"""
wp as ({_pooled('wrows', 4, 'lang')}),
cp as ({_pooled('crows', 6, 'lang', True)}),
cl as (select lang, {chrf()} as chrf from cp),
report as (
  select wp.lang, {bleu()} as bleu,
    {', '.join(f'(case when h{n} > 0 then m{n} / h{n} else 0 end) as bleu_{n}' for n in range(1, 5))},
    cl.chrf
  from wp join cl on cl.lang = wp.lang)
"""
BLEUS = ", ".join(r6(c) for c in ("bleu", "bleu_1", "bleu_2", "bleu_3", "bleu_4"))

# --- terminology ---------------------------------------------------------------------------


def escape(x: str) -> str:
    return rf"regexp_replace({x}, '([^{W}])', '\\\1', 'g')"


def bracket(x: str) -> str:
    """Put control characters round every word run, so that word ends are visible."""
    return rf"regexp_replace({x}, '([{W}]+)', chr(1) || '\1' || chr(2), 'g')"


def hits(name: str, rows: str, text: str, terms: str) -> str:
    """Every (row, term) pair is tried: the bracketed term must occur in the bracketed text."""
    return rf"""
{name}_x as (select pair_id, {bracket(f'lower({text})')} as x from {rows}),
{name} as (
  select p.pair_id, t.src_term as term, t.tgt_term, t.ord
  from {name}_x p, (select *, {bracket('src_term')} as b from {terms}) t where contains(p.x, t.b))
"""


def mark(name: str, rows: str, text: str, hit_rows: str) -> str:
    """Replace the terms one after the other, longest first, in the bracketed text."""
    return rf"""
{name}_t as (
  select pair_id, list(term order by length(term) desc, ord) as terms from {hit_rows} group by pair_id),
{name} as (
  select p.pair_id, case when t.terms is null then p.{text} else
    replace(replace(list_reduce(list_prepend({bracket('p.' + text)}, t.terms), lambda acc, t_:
      regexp_replace(acc, '(?i)' || {escape(bracket('t_'))},
        chr(1) || '<' || chr(1) || 'TERM' || chr(2) || '>' || {bracket('t_')} || '</' || chr(1) || 'TERM' || chr(2) || '>', 'g')
    ), chr(1), ''), chr(2), '') end as marked
  from {rows} p left join {name}_t t on t.pair_id = p.pair_id)
"""


TERM_HITS = PAIRS + "," + GLOSSARY + "," + hits("src_hits", "pairs", "source", "glossary")
TERM_CHECK = TERM_HITS + rf""",
expected as (select distinct pair_id, tgt_term as term from src_hits),
texts as (select pair_id, {bracket('lower(prediction)')} as x from pairs),
checked as (
  select e.pair_id, e.term, contains(x, {bracket('e.term')}) as found
  from expected e join texts on texts.pair_id = e.pair_id)
"""
# The longest term of which the characters are counted below.
_LONGEST_TERM = 40
_SHARED = " + ".join(
    f"case when {k} > length(cs) then 0 else least(length(w) - length(replace(w, substr(cs, {k}, 1), '')), "
    f"m - length(replace(s, substr(cs, {k}, 1), ''))) end"
    for k in range(1, _LONGEST_TERM + 1)
)
# Windows of the longer text that could reach the threshold by their characters, then the longest
# common subsequence by bits: a 1 that the sum moves past is a character that is not matched.
FUZZY_CHECK = TERM_CHECK.replace("checked as (", "exact as (") + f""",
open_ as (
  select e.pair_id, e.term, lower(coalesce(p.prediction, '')) as x from exact e join pairs p using (pair_id) where not found),
shorter as (
  select pair_id, term, case when length(term) <= length(x) then term else x end as s,
    case when length(term) <= length(x) then x else term end as l from open_),
ways as (
  select * from shorter where s <> '' union all select pair_id, term, l, s from shorter where s <> '' and length(s) = length(l)),
counted_ as (select *, array_to_string(list_distinct(string_split(s, '')), '') as cs from ways),
parts as (
  select pair_id, term, s, cs, length(s) as m, length(l) as size_, i0, greatest(i0, 0) as p0,
    substr(l, greatest(i0, 0) + 1, i0 + 128 + length(s) - greatest(i0, 0)) as part
  from (select *, unnest(range(1 - length(s), length(l), 128)) as i0 from counted_)),
places as (
  select pair_id, term, s, cs, m, size_, p0, part, unnest(range(i0, least(i0 + 128, size_))) as i from parts),
windows as (
  select pair_id, term, s, cs, m,
    substr(part, greatest(i, 0) - p0 + 1, least(i + m, size_) - greatest(i, 0)) as w from places),
of_set as materialized (
  select * from windows where 2.0::double * (length(w) - length(translate(w, cs, ''))) / (m + length(w)) >= 0.8::double),
likely as (
  select pair_id, term, s, w from of_set
  where 2.0::double * ({_SHARED}) / (length(s) + length(w)) >= 0.8::double),
kept as (select distinct s, w from likely),
bits as (
  select s, w, (1::bigint << length(s)::int) - 1 as whole, list_transform(string_split(w, ''), lambda c:
    list_sum(list_transform(range(length(s)), lambda k: case when substr(s, k + 1, 1) = c then 1::bigint << k::int else 0 end))::bigint) as masks
  from kept),
lcs as (
  select s, w, length(s) - bit_count(list_reduce(list_prepend(whole, masks), lambda v, k: ((v + (v & k)) | (v - (v & k))) & whole)) as common
  from bits),
good as (select s, w from lcs where 2.0::double * common / (length(s) + length(w)) >= 0.8::double),
sizes_ as (select pair_id, term, sum(length(l) + length(s) - 1) as n from ways group by all),
met as (
  select pair_id, term, count(*) as compared, bool_or(good.s is not null) as similar_
  from likely left join good on good.s = likely.s and good.w = likely.w group by all),
rated as (
  select o.pair_id, o.term, coalesce(n, 0) as n, coalesce(compared, 0) as compared, coalesce(similar_, false) as similar_
  from open_ o left join sizes_ z on z.pair_id = o.pair_id and z.term = o.term
  left join met m on m.pair_id = o.pair_id and m.term = o.term),
checked as (
  select e.pair_id, e.term, found or coalesce(similar_, false) as found from exact e
  left join rated r on r.pair_id = e.pair_id and r.term = e.term)
"""
_TERM_ROWS = """,
counted as (
  select pair_id, count(*) as term_count, count(*) filter (found) as correct_terms
  from checked group by pair_id),
term_rows as (
  select p.pair_id, 1.0::double as term_precision,
    coalesce(correct_terms / term_count, 1.0::double) as term_recall,
    coalesce(2 * (correct_terms / term_count) / (1 + correct_terms / term_count), 1.0::double) as term_f1,
    coalesce(term_count, 0) as term_count, coalesce(correct_terms, 0) as correct_terms
  from pairs p left join counted c on c.pair_id = p.pair_id),
term_report as (
  select coalesce(sum(correct_terms) / sum(term_count), 0) as term_accuracy,
    coalesce(avg(term_precision), 0) as term_precision, coalesce(avg(term_recall), 0) as term_recall,
    coalesce(avg(term_f1), 0) as term_f1, count(*) as sentences_with_terms
  from term_rows where term_count > 0)
"""
TERM_ROWS, FUZZY_ROWS = TERM_CHECK + _TERM_ROWS, FUZZY_CHECK + _TERM_ROWS
TERM_REPORT = (
    ", ".join(r6(c) for c in ("term_accuracy", "term_precision", "term_recall", "term_f1"))
    + ", sentences_with_terms"
)

# --- corpus --------------------------------------------------------------------------------


def key(seed: str, row_id: str = "pair_id") -> str:
    return f"md5({seed} || ':' || {row_id})"


def ranked(seed: str = "'42'", rows: str = "corpus") -> str:
    return f"ranked as (select *, row_number() over (order by {key(seed)}) as rn, count(*) over () as total from {rows})"


SPLIT = CORPUS + f""",
{ranked()},
sized as (
  select *, ceil((1 - 0.8::double) * total) as rest from ranked),
split as (
  select pair_id, source, target,
    case when rn <= total - rest then 'train'
         when rn <= total - ceil((1 - 0.1::double / (0.1::double + 0.1::double)) * rest) then 'val'
         else 'test' end as split
  from sized)
"""


def lengths(rows: str) -> str:
    return f"lengths as (select *, len({words('source')}) as s, len({words('target')}) as t from {rows})"


STATS = """count(*) as total, round(coalesce(avg(s), 0), 6) as avg_source_length,
  round(coalesce(avg(t), 0), 6) as avg_target_length, max(s) as max_source_length,
  max(t) as max_target_length, min(s) as min_source_length, min(t) as min_target_length"""

_ABBREVIATIONS = r"Mr|Mrs|Ms|Dr|Prof|St|No|e\.g|i\.e|vs"
DROPPED = f"""
stripped as (select doc_id, text, {strip('text')} as b from titled),
lines as (select doc_id, text, string_split(b, chr(10)) as l from stripped),
body as (
  select doc_id, case when len(l) >= 2 and {strip('l[1]')} <> '' and {strip('l[2]')} <> ''
      and contains({strip('l[2]')}, {strip('l[1]')}) then array_to_string(l[2:], chr(10)) else text end as body
  from lines)
"""
SPLIT_SENTENCES = TITLED + "," + DROPPED + rf""",
held as (select doc_id, regexp_replace(body, '(\A|[^{W}])({_ABBREVIATIONS})\.[{BLANK}]', '\1\2.' || chr(1), 'g') as x from body),
cut as (select doc_id, string_split(regexp_replace(x,
  '([.!?]["'')\]»”’]*)[{WS}]+([^\p{{Ll}}{WS}])', '\1' || chr(10) || '\2', 'g'), chr(10)) as parts from held),
sent as (
  select doc_id, list_filter(list_transform(parts, lambda s: {clean("replace(s, chr(1), ' ')")}),
    lambda s: s <> '' and len(string_split(s, ' ')) >= 3) as s from cut)
"""

MERGED = SPLIT_SENTENCES + """,
folded as (
  select doc_id, list_reduce(list_prepend({done: []::varchar[], held: ''},
      list_transform(s, lambda x: {done: []::varchar[], held: x})),
    lambda acc, x: case when len(string_split(trim(acc.held || ' ' || x.held), ' ')) < 10
      then {done: acc.done, held: trim(acc.held || ' ' || x.held)}
      when acc.held <> '' then {done: list_append(acc.done, acc.held), held: x.held}
      else {done: acc.done, held: x.held} end) as f
  from sent),
merged as (select doc_id, case when f.held <> '' then list_append(f.done, f.held) else f.done end as m from folded)
"""

ORACLES: dict[str, str] = {
    # text
    "clean_text": f"select doc_id, {clean('text')} as cleaned from documents",
    "word_count": f"select doc_id, len({words('text')}) as words from documents",
    "drop_dup_title": f"with {TITLED}, {DROPPED} select doc_id, body from body",
    "split_sentences": f"""with {SPLIT_SENTENCES}
select doc_id, unnest(range(0, len(s))) as pos, unnest(s) as sentence from sent""",
    "merge_short": f"""with recursive {MERGED}
select doc_id, unnest(range(0, len(m))) as pos, unnest(m) as sentence from merged""",
    "strip_outputs": f"""select doc_id as pair_id, {strip("'  ' || text || chr(10)")} as prediction,
  {strip("text || chr(9) || ' '")} as reference from documents""",
    # corpus
    "filter_by_length": f"""with {CORPUS}, {lengths('corpus')}
select pair_id, source, target from lengths where s between 3 and 512 and t between 3 and 512""",
    "preprocess_pairs": f"""with {CORPUS}, {lengths('corpus')},
low as (select pair_id, lower(source) as source, lower(target) as target from lengths
  where s between 3 and 512 and t between 3 and 512)
select min(pair_id) as pair_id, source, target from low group by source, target""",
    "subset": f"with {CORPUS}, {ranked()} select pair_id, source from ranked where rn <= 300",
    "nested_subsets": f"""with {CORPUS}, {ranked()},
rungs as (
  select distinct s from (
    select unnest([100, 500, 1000, 2000, 4000, 6000, 8000, 10000]) as s
    union all select count(*) from corpus)
  where s <= (select count(*) from corpus))
select pair_id, s::bigint as data_size from ranked join rungs on rn <= s""",
    "create_splits": f"with {SPLIT} select pair_id, split from split",
    "create_splits_approx": f"""with {CORPUS},
placed as (select pair_id, ('0x' || substr({key("'42'")}, 1, 8))::bigint / 4294967296.0::double as x from corpus)
select pair_id, case when x < 0.8 then 'train' when x < 0.8::double + 0.1::double then 'val' else 'test' end as split
from placed""",
    "seed_grid": f"""with {CORPUS}, seeds as (select unnest([42, 123, 456])::int as seed),
ranked as (select seed, pair_id, row_number() over (partition by seed order by {key('seed')}) as rn from corpus, seeds)
select seed, pair_id from ranked where rn <= 200""",
    "reverse_pairs": f"""with {CORPUS} select pair_id, target as source, source as target,
  'eng_Latn' as src_lang, 'nob_Latn' as tgt_lang from corpus""",
    "bidirectional": f"""with {CORPUS}
select pair_id * 2 as pair_id, pair_id as base_id, source, target, 'nob_Latn' as src_lang, 'eng_Latn' as tgt_lang, 'forward' as direction from corpus
union all
select pair_id * 2 + 1, pair_id, target, source, 'nob_Latn', 'eng_Latn', 'reverse' from corpus""",
    "split_direction": f"""with {CORPUS}
select pair_id, 'reverse' as part, 'eng_Latn' as src_lang, 'nob_Latn' as tgt_lang from corpus where lang = 'de'
union all
select pair_id, 'forward', 'nob_Latn', 'eng_Latn' from corpus where lang <> 'de'""",
    "mix_corpora": f"""with {CORPUS}, {TURNS},
both_ as (
  select 'documents' as corpus, 'documents:' || pair_id as pair_id, source, target from corpus
  union all select 'turns', 'turns:' || pair_id, source, target from turns),
{lengths('both_')},
firsts as (select source, target, min(pair_id) as pair_id from lengths
  where s between 3 and 512 and t between 3 and 512 group by source, target)
select b.pair_id, b.corpus, b.source, b.target from both_ b join firsts f on f.pair_id = b.pair_id""",
    "preview": f"""with {CORPUS} select pair_id, substr(source, 1, 80) as source, substr(target, 1, 80) as target
from corpus order by pair_id limit 5""",
    "corpus_stats": f"with {CORPUS}, {lengths('corpus')} select {STATS} from lengths",
    "split_stats": f"with {SPLIT}, {lengths('split')} select split, {STATS} from lengths group by split",
    # alignment
    "doc_cosine": f"""with recursive {SENTENCES},
best as (select *, row_number() over (partition by doc_id, en_pos order by sim desc, no_pos) as k,
  avg(sim) over (partition by doc_id, en_pos) as m, count(*) over (partition by doc_id, en_pos) as n from cells)
select doc_id, en_pos, no_pos, {r6('sim', 'similarity')}, {r6('m', 'mean_similarity')}, n as cells from best where k = 1""",
    "align_sequential": f"""with recursive {SENTENCES}
select doc_id, en_pos, no_pos, en, no_ as "no", {r6('sim', 'similarity')}, 'sequential' as method from seq""",
    "align_mutual_round": f"""with recursive {SENTENCES},
sides as (
  select *, row_number() over (partition by doc_id, en_pos order by sim desc, no_pos) as a,
    row_number() over (partition by doc_id, no_pos order by sim desc, en_pos) as b from edges)
select doc_id, en_pos, no_pos, {r6('sim', 'similarity')} from sides where a = 1 and b = 1""",
    "align_one_to_one": f"""with recursive {SENTENCES}
select doc_id, en_pos, no_pos, en, no_ as "no", {r6('sim', 'similarity')}, 'mutual' as method from one_to_one""",
    "align_assignment": f"""with recursive {ASSIGNMENT}
select doc_id, en_pos, no_pos, en, no_ as "no", {r6('sim', 'similarity')}, 'assignment' as method
from assigned where sim >= 0.75""",
    "align_documents_best": f"""with recursive {ASSIGNMENT}
select doc_id, en_pos, no_pos, en, no_ as "no", {r6('sim', 'similarity')}, 'assignment' as method
from assigned where sim >= 0.75
union all select doc_id, en_pos, no_pos, en, no_, {r6('sim')}, 'sequential' from seq""",
    "assignment_totals": f"""with recursive {ASSIGNMENT.replace('(a.v, b.v)', '(a.v[1:3], b.v[1:3])')}
select a.doc_id, count(*) as pairs, {r6('sum(a.sim)', 'best_total')},
  {r6("coalesce((select sum(sim) from one_to_one o where o.doc_id = a.doc_id), 0)", 'mutual_total')}
from assigned a group by a.doc_id""",
    "align_documents": f"""with recursive {SENTENCES}
select doc_id, en_pos, no_pos, en, no_ as "no", {r6('sim', 'similarity')}, method from aligned""",
    "align_long_documents": f"""with recursive {SENTENCES.replace('e.vec_id // 10', 'e.vec_id // 500')}
select doc_id, en_pos, no_pos, en, no_ as "no", {r6('sim', 'similarity')}, method from aligned""",
    "align_from_texts": f"""with recursive {MERGED},
sizes as (
  select m.doc_id, len(s) as a, greatest(len(s) - m.doc_id % 2, 0) as b, len(m) as c, len(m) - m.doc_id % 2 as d
  from merged m join sent using (doc_id) where len(s) > 0)
select doc_id, a as en_sentences, b as no_sentences, case when d > 0 then d else 0 end as aligned_pairs,
  case when d > 0 then 1.0 else 0.0 end::double as avg_similarity from sizes""",
    "align_doc_stats": f"""with recursive {SENTENCES}
select doc_id, en_sentences, no_sentences, aligned_pairs, {r6('avg_similarity')} from doc_stats""",
    "align_progressively": f"""with recursive {SENTENCES}
select doc_id, en_sentences, no_sentences, aligned_pairs, {r6('avg_similarity')} from doc_stats""",
    "align_progress_pairs": f"""with recursive {SENTENCES}
select doc_id, en_pos, no_pos, en, no_ as "no", {r6('sim', 'similarity')}, method from aligned""",
    "align_document_parts_stats": f"""with recursive {SENTENCES}
select doc_id, en_sentences, no_sentences, aligned_pairs, {r6('avg_similarity')} from doc_stats""",
    "align_document_parts": f"""with recursive {SENTENCES}
select doc_id, en_pos, no_pos, en, no_ as "no", {r6('sim', 'similarity')}, method from aligned""",
    "align_summary": f"""with recursive {SENTENCES}
select count(*) as total_mt_pairs, sum(en_sentences)::bigint as total_en_sentences,
  sum(no_sentences)::bigint as total_no_sentences, sum(aligned_pairs)::bigint as total_sentence_pairs,
  round(sum(aligned_pairs) / greatest(sum(en_sentences), sum(no_sentences)) * 100, 6) as alignment_rate,
  (select round(avg(sim), 6) from aligned) as avg_similarity, 0.75::double as similarity_threshold
from doc_stats""",
    "clean_training_pairs": f"""with recursive {SENTENCES}
select doc_id, en_pos, en as source, no_ as target, 'en' as source_lang, 'no' as target_lang from aligned""",
    # terminology
    "glossary_load": f"with {GLOSSARY} select src_term, tgt_term, ord from glossary",
    "read_glossary": f"with {GLOSSARY} select src_term, tgt_term from glossary",
    "glossary_inverse": f"with {GLOSSARY} select src_term, tgt_term, ord from inverse",
    "extract_terms": f"with {TERM_HITS} select pair_id, term from src_hits",
    "mark_terms": f"""with {TERM_HITS}, {mark('m', 'pairs', 'source', 'src_hits')}
select pair_id, marked as source from m""",
    "mark_pairs": f"""with {CORPUS}, {GLOSSARY},
cc as (select pair_id, {clean('source')} as source, target from corpus),
{hits('sh', 'cc', 'source', 'glossary')}, {hits('th', 'cc', 'target', 'inverse')},
{mark('ms', 'cc', 'source', 'sh')}, {mark('mt', 'cc', 'target', 'th')}
select ms.pair_id, ms.marked as source, mt.marked as target, 'true' as marked
from ms join mt on mt.pair_id = ms.pair_id""",
    "term_stats": f"""with {TERM_HITS}
select (select count(*) from pairs) as total_samples, count(distinct pair_id) as samples_with_terms,
  count(*) as total_term_occurrences, round(count(*) / (select count(*) from pairs), 6) as avg_terms_per_sample,
  (select count(*) from glossary) as glossary_size
from src_hits""",
    "term_in_prediction": f"with {TERM_CHECK} select pair_id, term, found from checked",
    "term_accuracy_rows": f"""with {TERM_ROWS}
select pair_id, {r6('term_precision')}, {r6('term_recall')}, {r6('term_f1')}, term_count, correct_terms from term_rows""",
    "term_accuracy": f"with {TERM_ROWS} select {TERM_REPORT} from term_report",
    "evaluate_with_terms": f"""with {TERM_ROWS}, {WORD_ROWS}, {CHAR_ROWS}, {REPORT}
select {BLEUS}, {r6('chrf')}, {TERM_REPORT} from report, term_report""",
    "term_in_prediction_fuzzy": f"with {FUZZY_CHECK} select pair_id, term, found from checked",
    "term_accuracy_rows_fuzzy": f"""with {FUZZY_ROWS}
select pair_id, {r6('term_precision')}, {r6('term_recall')}, {r6('term_f1')}, term_count, correct_terms from term_rows""",
    "term_accuracy_fuzzy": f"with {FUZZY_ROWS} select {TERM_REPORT} from term_report",
    "evaluate_with_terms_fuzzy": f"""with {FUZZY_ROWS}, {WORD_ROWS}, {CHAR_ROWS}, {REPORT}
select {BLEUS}, {r6('chrf')}, {TERM_REPORT} from report, term_report""",
    "fuzzy_windows": f"""with {FUZZY_CHECK}
select count(*) as open_terms, count(*) filter (similar_) as similar_terms, sum(n)::bigint as windows,
  sum(compared)::bigint as compared from rated""",
    # scoring
    "tok13a": f"select doc_id, array_to_string({tok('text')}, ' ') as tokens from documents",
    "bleu_rows": f"""with {PAIRS}, {WORD_ROWS}
select pair_id, {', '.join(f'm{n} as match_{n}' for n in range(1, 5))},
  {', '.join(f'h{n} as possible_{n}' for n in range(1, 5))}, h1 as hyp_len, r1 as ref_len from wrows""",
    "bleu_sentence": f"with {PAIRS}, {WORD_ROWS} select pair_id, {r6(bleu(), 'bleu')} from wrows",
    "bleu_corpus": f"""with {PAIRS}, {WORD_ROWS}, wp as ({_pooled('wrows', 4, 'lang')})
select lang, {r6(bleu(), 'bleu')},
  {', '.join(f'round(case when h{n} > 0 then m{n} / h{n} else 0 end, 6) as bleu_{n}' for n in range(1, 5))} from wp""",
    "chrf_sentence": f"with {PAIRS}, {CHAR_ROWS} select pair_id, {r6(chrf(), 'chrf')} from crows",
    "chrf_corpus": f"""with {PAIRS}, {CHAR_ROWS}, cp as ({_pooled('crows', 6, 'lang', True)})
select lang, {r6(chrf(), 'chrf')} from cp""",
    "classify_error": f"with {PAIRS}, {CLASSES} select pair_id, error_type from classes",
    "error_samples": f"""with {PAIRS}, {WORD_ROWS}, {CHAR_ROWS}, {ROW_SCORES}, {CLASSES}, {SAMPLES}
select pair_id, source, prediction, reference, {r6('bleu')}, {r6('chrf')}, error_type from samples""",
    "error_class_counts": f"""with {PAIRS}, {WORD_ROWS}, {CHAR_ROWS}, {ROW_SCORES}, {CLASSES}, {SAMPLES}
select error_type, count(*) as rows, round(avg(bleu), 6) as bleu, round(avg(chrf), 6) as chrf
from samples group by error_type""",
    "score_distribution": f"""with {PAIRS}, {WORD_ROWS}, s as (select {bleu()} as bleu from wrows)
select round(avg(bleu), 6) as mean, round(stddev_pop(bleu), 6) as std, round(min(bleu), 6) as "min",
  round(max(bleu), 6) as "max", round(median(bleu), 6) as median,
  round(quantile_cont(bleu, 0.25), 6) as q25, round(quantile_cont(bleu, 0.5), 6) as q50,
  round(quantile_cont(bleu, 0.75), 6) as q75 from s""",
    "score_sketches": f"""with {PAIRS}, {WORD_ROWS}, s as (select lang, {bleu()} as bleu from wrows)
select lang, count(*) as rows, round(avg(bleu), 6) as mean, round(stddev_pop(bleu), 6) as std, round(min(bleu), 6) as "min",
  round(max(bleu), 6) as "max", true as q25_within, true as median_within, true as q75_within from s group by lang""",
    "score_summary": """select event_type, round(avg(value / 100), 6) as comet,
  round(stddev_pop(value / 100), 6) as comet_std from events group by event_type""",
    "evaluate_all": f"""with {PAIRS}, {WORD_ROWS}, {CHAR_ROWS}, {REPORT_BY_LANG},
sc as (
  select lang, avg(x) as comet, stddev_pop(x) as comet_std
  from (select lang, length(prediction) / greatest(length(reference), 1) as x from pairs) group by lang)
select report.lang, {BLEUS}, {r6('chrf')}, {r6('comet')}, {r6('comet_std')}
from report join sc on sc.lang = report.lang""",
    "comparison_rows": f"""with {PAIRS}, {WORD_ROWS}, {CHAR_ROWS}, {REPORT_BY_LANG}
select lang, label, round(value, 6) as value from (
  unpivot (select lang, bleu::double as bleu, bleu_1::double as bleu_1, bleu_2::double as bleu_2,
    bleu_3::double as bleu_3, bleu_4::double as bleu_4, chrf::double as chrf from report)
  on bleu, bleu_1, bleu_2, bleu_3, bleu_4, chrf into name label value value)""",
    "predictions": f"with {PAIRS} select pair_id, source, prediction, reference from pairs",
    "predict_batches": f"""with {PAIRS}
select pair_id, array_to_string(list_reverse(string_split(source, ' ')), ' ') as prediction from pairs""",
    # runs
    "param_grid": f"""with {RUNS},
grid as (
  select r::int as r, alpha::int as alpha, dropout::double as dropout,
    'r' || r || '_a' || alpha || '_d' || name as config_name
  from (select unnest([8, 16, 32]) as r), (select unnest([16, 32, 64]) as alpha),
    (values (0.0, '0.0'), (0.05, '0.05'), (0.1, '0.1')) d(dropout, name)),
scored as (select r, alpha, round(dropout, 2) as dropout, count(*) as runs, avg(test_bleu) as test_bleu from runs group by all)
select g.r, g.alpha, round(g.dropout, 6) as dropout, g.config_name, coalesce(s.runs, 0) as runs,
  round(s.test_bleu, 6) as test_bleu
from grid g left join scored s on s.r = g.r and s.alpha = g.alpha and s.dropout = g.dropout""",
    "runs_with_status": f"""with {RUNS}
select experiment, ord, round(case when failed then 0 else test_bleu end, 6) as test_bleu,
  round(case when failed then 0 else test_chrf end, 6) as test_chrf,
  round(case when failed then 999 else val_loss end, 6) as val_loss, failed from runs""",
    "learning_curve": f"""with {RUNS}
select experiment, data_size, ord, 'test_bleu' as metric, round(test_bleu, 6) as value from valid
union all select experiment, data_size, ord, 'test_chrf', round(test_chrf, 6) from valid""",
    "best_run": f"""with {RUNS}
select experiment, round(test_bleu, 6) as test_bleu, ord, r, alpha, round(dropout, 6) as dropout, data_size
from valid where test_bleu > 0
qualify row_number() over (partition by experiment order by test_bleu desc, ord) = 1""",
    "top_configs": f"""with {RUNS}
select experiment, (row_number() over (partition by experiment order by test_bleu desc, ord))::int as rank, ord, r, alpha,
  round(dropout, 6) as dropout, round(test_bleu, 6) as test_bleu
from valid qualify rank <= 5""",
    "top_completed": f"""with {RUNS}
select experiment, (row_number() over (partition by experiment order by test_bleu desc, ord))::int as rank, ord, r, alpha,
  round(dropout, 6) as dropout, round(test_bleu, 6) as test_bleu
from valid where state = 'COMPLETE' qualify rank <= 5""",
    "top_configs_overall": f"""with {RUNS}
select ord, r, alpha, round(dropout, 6) as dropout, round(test_bleu, 6) as test_bleu
from (select * from valid order by test_bleu desc, ord limit 5)""",
    "score_heatmap": f"""with {RUNS}
select experiment, alpha, round(avg(test_bleu) filter (r = 8), 6) as r_8,
  round(avg(test_bleu) filter (r = 16), 6) as r_16, round(avg(test_bleu) filter (r = 32), 6) as r_32
from valid group by experiment, alpha""",
    "config_summary": f"""with {RUNS}
select experiment, config_id, round_even(avg(test_bleu), 4) as bleu_mean,
  round_even(stddev_samp(test_bleu), 4) as bleu_std, round_even(min(test_bleu), 4) as bleu_min,
  round_even(max(test_bleu), 4) as bleu_max, round_even(avg(test_chrf), 4) as chrf_mean,
  round_even(stddev_samp(test_chrf), 4) as chrf_std
from valid group by experiment, config_id""",
    "trial_summary": f"""with {RUNS}
select experiment, count(*) filter (state = 'COMPLETE') as completed, count(*) filter (state = 'PRUNED') as pruned,
  count(*) as total, round(count(*) filter (state = 'PRUNED') / count(*) * 100, 6) as pruned_percent
from runs group by experiment""",
    "pareto_front": f"""with {RUNS}
select experiment, round(test_bleu, 6) as test_bleu, round(test_chrf, 6) as test_chrf, ord from (
  select *, max(test_chrf) over (partition by experiment order by test_bleu desc, test_chrf desc, ord
    rows between unbounded preceding and 1 preceding) as above from valid)
where above is null or test_chrf > above""",
    "pareto_front_overall": f"""with {RUNS}
select round(test_bleu, 6) as test_bleu, round(test_chrf, 6) as test_chrf, ord from (
  select *, max(test_chrf) over (order by test_bleu desc, test_chrf desc, ord
    rows between unbounded preceding and 1 preceding) as above from valid)
where above is null or test_chrf > above""",
    "best_overall": f"""with {RUNS}
select experiment, round(test_bleu, 6) as test_bleu, round(test_chrf, 6) as test_chrf, ord from valid
qualify row_number() over (partition by experiment order by test_bleu + test_chrf desc, ord) = 1""",
    "choose_config": f"""with {RUNS},
s2 as (select r, alpha, dropout, 'stage2' as config_source, 0 as priority from valid
  where stage = 'O' and test_bleu > 0 order by test_bleu desc, ord limit 1),
gr as (select r, alpha, dropout, 'gridsearch', 1 from valid
  where stage = 'F' and test_bleu > 0 order by test_bleu desc, ord limit 1)
select r, alpha, round(dropout, 6) as dropout, config_source from (
  select * from s2 union all select * from gr union all select 16, 32, 0.1, 'default', 2)
order by priority limit 1""",
    "recommended_subset": f"""with {RUNS}, {CORPUS}, {ranked()},
best as (select data_size from valid where test_bleu > 0 order by test_bleu desc, ord limit 1)
select pair_id, source from ranked where rn <= coalesce((select data_size from best), 8000)""",
    "validation_runs": f"""with {RUNS},
top as (
  select experiment, row_number() over (partition by experiment order by test_bleu desc, ord) as rank, r, alpha, dropout
  from valid qualify rank <= 5)
select experiment, rank::int as rank, r, alpha, round(dropout, 6) as dropout, run::int as run, (run + 42)::int as seed
from top, (select unnest([0, 1, 2]) as run)""",
    "early_stop": """with
a as (
  select user_id as run_id, event_id as step, value as v, row_number() over (partition by user_id order by event_id) as n,
    max(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before
  from events where value is not null),
b as (select *, max(case when before is null or v - before > 0.5 then n end)
  over (partition by run_id order by step) as last_gain from a),
c as (select run_id, min(step) filter (n - last_gain >= 3) as stop, max(step) as last from b group by run_id)
select b.run_id, c.stop is not null as stopped_early, max(step) as last_step, max(n) as evaluations,
  arg_max(step, (v, -step)) as best_step, round(max(v), 6) as best_metric
from b join c on c.run_id = b.run_id where b.step <= coalesce(c.stop, c.last) group by b.run_id, c.stop""",
    "final_report": f"""with {RUNS}, {PAIRS}, {SPLIT}, {WORD_ROWS}, {CHAR_ROWS}, {REPORT},
cfg as (select r, alpha, dropout from valid where test_bleu > 0 order by test_bleu desc, ord limit 1),
val as (select avg(test_bleu) as b, avg(test_chrf) as c, avg(val_loss) as l from valid)
select r, alpha, round(dropout, 6) as dropout, round(b, 6) as val_bleu, round(c, 6) as val_chrf, round(l, 6) as val_loss,
  {r6('bleu', 'test_bleu')}, {r6('chrf', 'test_chrf')},
  (select count(*) from split where split = 'train') as train, (select count(*) from split where split = 'val') as val,
  (select count(*) from split where split = 'test') as test
from cfg, val, report""",
    # tracking and registry
    "flatten_config": f"with {CONFIGS} select run_id, path, value from flat",
    "metric_log": """select user_id as run_id, event_type as key, round(arg_max(value, event_id), 6) as value,
  max(event_id) as step from events group by user_id, event_type""",
    "merged_tags": "select event_id, 'mt' as team, event_type as kind, 2::bigint as tags from events",
    "log_experiment": f"""with {CONFIGS}
select run_id, 'param' as kind, path as key, value from flat
union all select event_id, 'metric', event_type, (round(value * 100)::bigint)::varchar from events
union all select event_id, 'artifact', 'report', 'reports/' || event_type from events""",
    "register_model": f"""with {MODELS}
select id, name, experiment, timestamp, 'event of ' || experiment as description, path, true as has_bleu,
  event_id from models""",
    "promote_model": f"with {MODELS} select id as model_id, 'v1.0' as version, path from models where test_bleu > 0.45",
    "current_production": f"""with {MODELS}
select id as model_id, 'v1.0' as version, path from models where test_bleu > 0.45 order by ts desc, id desc limit 1""",
    # sources and sinks
    "run_log_rows": """select conv_id as run_id, turn as step,
  round(case when role <> 'assistant' then length(text)::double end, 6) as loss,
  round(case when role = 'assistant' then length(text)::double end, 6) as eval_bleu from conversations""",
    "read_tmx": f"""with {CORPUS},
flat as (select pair_id, {clean(r"regexp_replace(source, '\p{Cc}', ' ', 'g')")} as s from corpus)
select row_number() over (order by pair_id) - 1 as pair_id, s as source, pair_id || ' & more' as target
from flat where s <> ''""",
    "convert_tmx": f"""with {CORPUS},
flat as (select pair_id, {clean(r"regexp_replace(source, '\p{Cc}', ' ', 'g')")} as s from corpus)
select f as format, s as source, pair_id || ' & more' as target
from flat, (select unnest(['tsv', 'jsonl', 'huggingface']) as f) where s <> ''""",
    "write_fairseq": f"""with {CORPUS},
flat as (select pair_id, {clean(r"regexp_replace(source, '\p{Cc}', ' ', 'g')")} as s from corpus)
select s as "no", pair_id || ' & more' as en from flat where s <> ''""",
    "read_run_logs": """select conv_id // 50 as part, conv_id::double as epoch, turn as step,
  round(case when role <> 'assistant' then length(text)::double end, 6) as loss,
  round(case when role = 'assistant' then length(text)::double end, 6) as eval_bleu from conversations""",
    "read_pairs_json": f"""with {CORPUS}
select row_number() over (order by pair_id) - 1 as pair_id, source,
  case when lang = 'es' then '' else target end as target,
  case when lang = 'de' then 'reverse' else '' end as direction from corpus""",
    "read_document_pairs": f"""with {CORPUS}
select row_number() over (order by pair_id) as doc_id, source as en_text, target as no_text from corpus""",
    "read_pairs_array": f"""with {CORPUS}
select row_number() over (order by pair_id) - 1 as pair_id, source,
  case when lang = 'es' then '' else target end as target,
  case when lang = 'de' then 'reverse' else '' end as direction from corpus""",
    "read_document_array": f"""with {CORPUS}
select row_number() over (order by pair_id) as doc_id, source as en_text, target as no_text from corpus""",
    "read_state_files": """select conv_id as run_id, turn as step,
  round(case when role <> 'assistant' then length(text)::double end, 6) as loss,
  round(case when role = 'assistant' then length(text)::double end, 6) as eval_bleu from conversations""",
    "write_parallel": rf"""with {CORPUS}
select 'no' as side, regexp_replace(source, '[\r\n]+', ' ', 'g') as line from corpus
union all select 'en', regexp_replace(target, '[\r\n]+', ' ', 'g') from corpus""",
    "write_tsv": f"with {CORPUS} select source as norwegian, target as english from corpus",
    "write_jsonl": f"""with {CORPUS}
select source, target, 'nb' as source_lang, 'en' as target_lang from corpus""",
    "write_nested": f"with {CORPUS} select source as nb, target as en from corpus",
    "load_splits": f"""with {SPLIT},
picked as (select pair_id, row_number() over (order by {key("'42'")}) as k from split where split = 'train')
select pair_id, 'train' as split from picked where k <= 100
union all select pair_id, split from split where split <> 'train'""",
}
ORACLES["write_results"] = ORACLES["config_summary"]

_VOCABULARY = f"""
vw as (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as pos
  from (select doc_id, {words('text')} as w from documents)),
vocabulary as (select word, min(doc_id * 100000 + pos + 10) as id from vw where length(word) > 1 group by word)
"""


def _ids(side: str) -> str:
    return f"""
{side}_w as (select pair_id, {words(side)}[:128] as w from corpus),
{side}_x as (select pair_id, unnest(w) as word, unnest(range(0, len(w))) as pos from {side}_w),
{side}_i as (
  select x.pair_id, list(coalesce(v.id, 3) order by x.pos) as ids
  from {side}_x x left join vocabulary v on v.word = x.word group by x.pair_id),
{side}_ids as (select w.pair_id, coalesce(i.ids, []) as ids from {side}_w w left join {side}_i i on i.pair_id = w.pair_id)
"""


_ENCODED = f"""{CORPUS}, {_VOCABULARY}, {_ids('source')}, {_ids('target')},
encoded as (
  select s.pair_id, s.ids as input_ids, list_transform(s.ids, lambda x: 1) as attention_mask, t.ids as labels
  from source_ids s join target_ids t on t.pair_id = s.pair_id)
"""
ORACLES["encode_pairs"] = f"""with {_ENCODED}
select pair_id, array_to_string(input_ids, ' ') as input_ids, array_to_string(attention_mask, ' ') as attention_mask,
  array_to_string(labels, ' ') as labels from encoded"""
ORACLES["pad_batches"] = f"""with {_ENCODED},
placed as (select *, (row_number() over (order by pair_id) - 1) // 8 as batch_id from encoded),
sized as (select *, max(len(input_ids)) over (partition by batch_id) as a, max(len(labels)) over (partition by batch_id) as b
  from placed)
select pair_id, batch_id,
  array_to_string(list_resize(input_ids, a, 1), ' ') as input_ids,
  array_to_string(list_resize(attention_mask, a, 0), ' ') as attention_mask,
  array_to_string(list_resize(labels, b, -100), ' ') as labels
from sized"""
