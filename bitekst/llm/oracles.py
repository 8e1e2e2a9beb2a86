"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

from bitekst.llm import conversations, covertree, decontam, lines, resampling, spans

SENTENCE_SPANS = f"""
with d as (select row_number() over () rid, doc_id, text from documents),
p as (select rid, doc_id, text, list_filter(regexp_extract_all(text,
        '(?:^[ \\t\\n\\r\\f\\x0b]*)?[^.!?\\n]*(?:[.!?]+[^ \\t\\n\\r\\f\\x0b.!?][^.!?\\n]*)*[.!?]*[ \\t\\n\\r\\f\\x0b]*'), lambda x: x <> '') ps from d),
w as (select rid, doc_id, ps, list_transform(ps, lambda x:
        list_filter(regexp_split_to_array(x, '[ \\t\\n\\r\\f\\x0b]+'), lambda y: y <> '')) ws from p),
s as (select rid, doc_id, unnest(range(len(ws))) i, unnest(ws) words from w),
c as (select *, len(words) n, sum(len(words)) over (partition by rid order by i) upto from s),
long as (select a.rid, a.i, b.i j from c a join c b on a.rid = b.rid
        and b.i between a.i + {spans.SENTENCES - 1} and a.i + {spans.WORDS + spans.SENTENCES}
        and b.upto - a.upto + a.n >= {spans.WORDS}),
ends as (select rid, i, min(j) j from long group by rid, i union select rid, max(i), j from long group by rid, j),
runs as (select e.rid, w.doc_id, e.i, e.j, array_to_string(flatten(ws[e.i + 1 : e.j + 1]), ' ') run
        from ends e join w using (rid)),
ranked as (select *, rank() over (partition by run order by doc_id, i) k from runs),
gone as (select rid, list_distinct(flatten(list(range(i, j + 1)))) covered from ranked where k > 1 group by rid)
select w.doc_id, len(ps) n_sentences, coalesce(len(covered), 0) n_removed,
  array_to_string(list_filter(ps, lambda x, i: not list_contains(coalesce(covered, []), i - 1)), '') "text"
from w left join gone using (rid)
"""

_STRIP = "\"'“”‘’«»()\\[\\]{}<>.,;:!?…*_#\\-–—"


def _quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in sorted(words))


def _windows(table: str, key: str, prefix: str) -> str:
    """Template windows of a table's texts, with their slots."""
    p, strip = prefix, _STRIP.replace("'", "''")
    return f"""
{p}r as (select {key} id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') raws from {table}),
{p}t as (select id, unnest(range(len(raws))) pos, unnest(raws) raw from {p}r),
{p}c as (select *, coalesce(nullif(regexp_replace(raw, '^[{strip}]+|[{strip}]+$', '', 'g'), ''), raw) word from {p}t),
{p}k as (select id, pos, lower(word) core,
    regexp_full_match(word, '[+-]?\\d+(?:[.,:/]\\d+)*(?:st|nd|rd|th)?|[+-]?\\d+(?:[.,:/]\\d+)*\\pL+')
      or lower(word) in ({_quoted(decontam.NUMBERS)}) is_number,
    lower(word) in ({_quoted(decontam.UNITS)}) is_unit,
    word[1] <> lower(word[1]) and word[1] = upper(word[1]) is_capital,
    regexp_matches(raw, '[.!?…]["''”’»)\\]}}]*$') ends from {p}c),
{p}f as (select id, pos, core, case when is_number then 'number'
    when is_unit and lag(is_number, 1, false) over (partition by id order by pos) then 'unit'
    when is_capital and not lag(ends, 1, true) over (partition by id order by pos) then 'name' else 'l' end kind
  from {p}k),
{p}l as (select id, pos, list(struct_pack(t := case kind when 'l' then core else '<' || kind || '>' end, kind := kind, core := core))
    over (partition by id order by pos rows between current row and {decontam.WINDOW - 1} following) ws from {p}f),
{p}w as (select id, pos, array_to_string(list_transform(ws, lambda x: x.kind[1] || x.t), ' ') h,
    list_transform(list_filter(ws, lambda x: x.kind <> 'l'), lambda x: x.kind || ':' || x.core) slots from {p}l
  where len(ws) = {decontam.WINDOW}
    and len(list_filter(ws, lambda x: x.kind = 'l')) >= {decontam.LITERAL})"""


TEMPLATE_WINDOWS = f"""
with items as (select min(item_id) item_id, text from benchmark group by text),
{_windows("items", "item_id", "b")},
{_windows("documents", "doc_id", "d")},
size as (select id, count(*) n from bw group by id),
met as (select dw.id doc_id, bw.id item_id, dw.pos - bw.pos diagonal, bw.pos ipos,
    list_transform(range(1, len(bw.slots) + 1), lambda i: [bw.slots[i], dw.slots[i]]) pairs
  from dw join bw on dw.h = bw.h),
aligned as (select doc_id, item_id, diagonal, list_distinct(list(ipos)) ats, list_distinct(flatten(list(pairs))) pairs
  from met group by all),
good as (select doc_id, item_id, unnest(ats) ipos, len(list_filter(pairs, lambda x: x[1] <> x[2])) changed from aligned
  where len(pairs) = len(list_distinct(list_transform(pairs, lambda x: x[1])))
    and len(pairs) = len(list_distinct(list_transform(pairs, lambda x: x[2])))),
best as (select doc_id, item_id, ipos, min(changed) changed from good group by all),
found as (select doc_id, item_id, count(*) n_found, max(changed) n_changed from best group by all)
select doc_id, item_id, n n_windows, n_found, n_found / n::double coverage, n_changed
from found join size on id = item_id where n_found >= ceil({decontam.SHARE}::double * n)
"""

SITE_LINES = f"""
with d as (select row_number() over () rid, doc_id, source, "text", string_split("text", chr(10)) ls from documents),
l as (select rid, source, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x)), lambda x: x <> ''))) line from d),
c as (select source, line, count(*) n from l group by all),
t as (select source, count(*) pages from d group by source),
b as (select c.source, list(line) drops from c join t on c.source is not distinct from t.source
  where n >= {lines.MIN_PAGES} and n > {lines.RATIO}::double * pages group by c.source),
k as (select doc_id, d."text", ls, list_filter(ls, lambda x: not list_contains(coalesce(drops, []), trim(x))) kept
  from d left join b on d.source is not distinct from b.source)
select doc_id, coalesce(len(ls) - len(kept), 0) n_dropped,
  case when len(ls) = len(kept) then "text" else array_to_string(kept, chr(10)) end "text" from k
"""

WARC_SEGMENTS = """
with p as (select page_id, coalesce(html, '') html from pages),
h as (select page_id, octet_length(encode(html)) payload_bytes, sha1(html) sha from p),
b as (select *, array_to_string(list_transform(string_split(sha, ''), lambda c:
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
    [instr('0123456789abcdef', c)]), '') bits, max(page_id) over (partition by sha) head from h)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * substr(bits, 5 * i + 1, 1)::int + 8 * substr(bits, 5 * i + 2, 1)::int + 4 * substr(bits, 5 * i + 3, 1)::int
    + 2 * substr(bits, 5 * i + 4, 1)::int + substr(bits, 5 * i + 5, 1)::int, 1)), '') payload_digest,
  case when page_id = head then 'response' else 'revisit' end record_type,
  case when page_id <> head then head end refers_to, 'ok' status
from b
"""

COVER_TREES = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor({covertree.SCALE} * x::double)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score
  from v q join v c on q.vec_id % {covertree.EVERY} = 0 and q.vec_id <> c.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= {covertree.TOP}
"""

#: The table of CRC-32, and the checksum of a column of texts by it.
_CRC_TABLE = """
crc_table as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) crc_table)"""


def _crc(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)"
    step = "xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: {step}), 4294967295)"


_RESAMPLED_WORDS = """
{p}w as (select id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) word from {p})"""

IMPORTANCE = f"""
with d as (select row_number() over () id, doc_id, text from documents),
b as (select row_number() over () id, text from benchmark),
{_RESAMPLED_WORDS.format(p="d")},
{_RESAMPLED_WORDS.format(p="b")},
{_CRC_TABLE},
hashed as (select word, {_crc("word")} % {resampling.BUCKETS} bucket
  from (select word from dw union select word from bw), crc_table),
s as (select bucket, count(*) n from dw join hashed using (word) group by bucket),
t as (select bucket, count(*) n from bw join hashed using (word) group by bucket),
g as (select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from dw) + {resampling.BUCKETS})
    / ((coalesce(s.n, 0) + 1)::double * ((select count(*) from bw) + {resampling.BUCKETS}))))::bigint gain
  from s full join t using (bucket)),
w as (select id, count(*) n_features, sum(gain) weight from dw join hashed using (word) join g using (bucket) group by id),
h as (select id, doc_id, coalesce(n_features, 0)::bigint n_features, coalesce(weight, 0)::bigint weight,
    ('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8))::bigint::double h from d left join w using (id)),
c as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint score from h),
f as (select *, row_number() over (order by score desc, doc_id) k, count(*) over () n from c
  where n_features >= {resampling.LEAST_WORDS})
select doc_id, n_features, weight, score, case when k <= {resampling.PERCENT} * n // 100 then k end rank from f
union all select *, null from c where n_features < {resampling.LEAST_WORDS}
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: States: 0 nothing kept, 1 behind the system turn, 2 behind a user turn, 3 behind an assistant turn.
AUDIT_REPAIR = f"""
with recursive {_CRC_TABLE},
base as (select conv_id, turn, coalesce(role, ' ') "role", coalesce("text", ' ') "text",
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations),
kinds as (select base.*, {_crc("k")} % 20 kind from base, crc_table),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else "role" end "role",
    case kind when 1 then '' when 2 then regexp_replace("text", '[.!?]', '', 'g') else "text" end "text",
    unnest(range(case when kind = 3 then 2 else 1 end)) copy from kinds where kind <> 0),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, "role", "text") i,
    rtrim("text", {_BLANKS}) ends from damaged),
placed as (select *, row_number() over (partition by conv_id, "role", "text" order by i) nth from ordered),
r as (select conv_id, turn, "role", "text", i, case when ends = '' then 'blank' when nth > 1 then 'duplicate'
    when right(ends, 1) not in ('.', '!', '?') then 'truncated' else '' end fault,
    case left("role", 1) when 's' then 0 when 'u' then 1 when 'a' then 2 else 3 end init from placed),
inserts as (select * from (values (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'),
    (2, 2, 0, ''), (2, 3, 2, 'I'), (3, 3, 0, ''), (3, 2, 2, 'I')) v(before, q, more, edits)),
edits as (select * from (values ('K', 0, 0, 1), ('K', 1, 0, 2), ('K', 1, 1, 2), ('K', 1, 3, 2), ('K', 2, 2, 3),
    ('R', -1, 0, 2), ('R', -1, 1, 2), ('R', -1, 3, 2), ('R', -1, 2, 3),
    ('D', -1, 0, 0), ('D', -1, 1, 1), ('D', -1, 2, 2), ('D', -1, 3, 3)) v(edit, init, before, q)),
dp as (select conv_id, 0::bigint i, q, struct_pack(cost := more::bigint, audit := edits) best
  from (select distinct conv_id from r) c, inserts where before = 0
  union all
  select dp.conv_id, r.i, n.q, min(struct_pack(cost := dp.best.cost + n.more
      + case edit when 'K' then 0 when 'R' then {conversations.REROLE} else {conversations.DELETE} end
      + case when edit <> 'D' and fault = 'truncated' then {conversations.TRUNCATED} else 0 end,
      audit := dp.best.audit || edit || n.edits)) best
  from dp join r on r.conv_id is not distinct from dp.conv_id and r.i = dp.i + 1
  join edits e on e.before = dp.q and (e.init = -1 or e.init = r.init) and (edit = 'D' or fault not in ('blank', 'duplicate'))
  join inserts n on n.before = e.q group by dp.conv_id, r.i, n.q),
stats as (select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps,
    count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate,
    count(*) filter (fault = 'truncated') truncated from r group by conv_id),
pairs as (select conv_id, left("role", 1) || left(lead("role") over (partition by conv_id order by i), 1) pair from r),
wrong as (select conv_id, count(*) illegal from pairs where pair is not null and pair not in ('su', 'ua', 'au') group by conv_id),
done as (select dp.conv_id, min(best) best from dp join stats s on s.conv_id is not distinct from dp.conv_id and dp.i = s.n
  where q in (0, 3) group by dp.conv_id),
steps as (select conv_id, pos, substr(best.audit, pos, 1) edit,
    len(regexp_replace(substr(best.audit, 1, pos), 'I', '', 'g')) i, len(regexp_replace(substr(best.audit, 1, pos), 'D', '', 'g')) o
  from (select *, unnest(range(1, len(best.audit) + 1)) pos from done)),
made as (select s.conv_id, pos, edit, o, r."role", case when edit = 'I' then '' else r."text" end "text",
    max(case when o = 1 and edit = 'K' and init = 0 then 1 else 0 end) over (partition by s.conv_id) sys
  from steps s left join r on r.conv_id is not distinct from s.conv_id and r.i = s.i where edit <> 'D'),
whole as (select conv_id, string_agg(case when edit = 'K' then "role" when (o - sys) % 2 = 1 then 'user' else 'assistant' end
    || ':' || "text", chr(10) order by pos) repaired from made group by conv_id)
select c.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate,
  coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(best.cost, 0) as cost, coalesce(best.audit, '') audit,
  sha256(coalesce(repaired, '')) repaired_sha256
from (select distinct conv_id from conversations) c
left join stats s on s.conv_id is not distinct from c.conv_id left join wrong w on w.conv_id is not distinct from c.conv_id
left join done d on d.conv_id is not distinct from c.conv_id left join whole o on o.conv_id is not distinct from c.conv_id
"""

ORACLES: dict[str, str] = {
    "op1_sentence_spans": SENTENCE_SPANS,
    "op2_template_windows": TEMPLATE_WINDOWS,
    "op6_site_lines": SITE_LINES,
    "op8_warc_segments": WARC_SEGMENTS,
    "op9_cover_trees": COVER_TREES,
    "op12_audit_repair": AUDIT_REPAIR,
    "op13_importance_resampling": IMPORTANCE,
}
