"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from ambler.llm import chat, near_dedup, quality, sharding, url_filter


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op1() -> str:
    digits = sharding._DIGITS

    def shard(n: int) -> str:
        scores = ", ".join(
            f"{{'s': -ln((('0x' || substr(md5(k || '#{i}'), 1, {digits}))::bigint::double + 0.5) / {16**digits}.0), 'i': {i}}}"
            for i in range(n)
        )
        return f"list_min([{scores}]).i::int"

    return f"""
with recursive bits(i, c, k) as (
    select range, range, 0 from range(256)
    union all
    select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8
), crc as (select list(c order by i) as t from bits where k = 8),
d as (
    select doc_id, coalesce(text, '') as text, coalesce(doc_id::varchar, chr(0) || 'null') as k from documents
), h as (
    select doc_id, k, strlen(text) + 1 as size,
           list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint) as b from d
), placed as (
    select doc_id, k, size,
           case when len(b) = 0 then 0 else
               xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::bigint)) end as text_crc32,
           {shard(sharding.SHARDS)} as shard, {shard(sharding.SHARDS + 1)} as grown_shard
    from h, crc
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard,
       row_number() over (partition by shard order by substr(md5(k || '#' || text_crc32), 1, {sharding.SLOT_DIGITS}),
                                                  doc_id nulls first, text_crc32) - 1 as slot, grown_shard
from placed
"""


def op2() -> str:
    k = near_dedup.SHINGLE
    return f"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x20\\x09-\\x0D]+') as w
    from documents
), sets as (
    select doc_id, list_distinct(
        case when len(w) = 0 then []
             when len(w) < {k} then [array_to_string(w, ' ')]
             else list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) end) as s
    from words
), shingles as (select doc_id, len(s) as n, unnest(s) as x from sets),
shared as (
    select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as n
    from shingles a join shingles b on a.x = b.x and a.doc_id < b.doc_id
    group by 1, 2
), links as (
    select a, b from shared where 100 * n >= 85 * (na + nb - n)
    union
    select b, a from shared where 100 * n >= 85 * (na + nb - n)
), reach as (
    select doc_id as node, doc_id as seen from documents
    union
    select r.node, l.b from reach r join links l on r.seen = l.a
)
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id, c.component_id = s.doc_id as kept
from sets s join (select node, min(seen) as component_id from reach group by node) c on c.node = s.doc_id
"""


def _verdicts(url: str) -> tuple[str, str, str]:
    host = f"coalesce(translate(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    path = f"coalesce(regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
    rules = ", ".join(f"{{'v': '{v}', 'h': '{h}', 'p': '{p}'}}" for v, h, p in url_filter.RULES)
    return host, path, rules


def op3() -> str:
    host, path, rules = _verdicts("url")
    return f"""
with recursive tags as (
    select url, unnest(list_concat(
        list_transform(list_filter(regexp_extract_all(html, '(?is)<link\\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\\brel\\s*=\\s*["'']?canonical\\b')),
                       lambda t: regexp_extract(t, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)),
        list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\\b[^>]*>'), lambda t: regexp_matches(t, '(?is)http-equiv\\s*=\\s*["'']?refresh\\b')),
                       lambda t: regexp_extract(t, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)))) as raw
    from pages where url is not null
), targets as (
    select url, regexp_replace(raw, '(?i)&(amp|#38|#x26);', '&', 'g') as t, regexp_extract(url, '^(.*?)://', 1, 's') as scheme,
           regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') as site, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') as here
    from tags
), parts as (
    select *, regexp_extract(t, '^([^?#]*)', 1, 's') as path, regexp_extract(t, '^[^?#]*(.*)$', 1, 's') as rest,
           coalesce(nullif(regexp_extract(here, '^(.*/)', 1, 's'), ''), '/') as folder
    from targets
), segments as (
    select *, string_split(case when starts_with(path, '/') then path else folder || path end, '/')[2:] as segs from parts
), cleaned as (
    select *, list_reduce(list_transform(segs, lambda s: [s]), lambda done, s: case when s[1] = '..' then done[:-2] when s[1] = '.' then done
        else done || s end, []::varchar[]) as done
    from segments
), links as (
    select url as a, case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') then t when site = '' then null when starts_with(t, '//') then scheme || ':' || t
        when starts_with(t, '?') then site || coalesce(nullif(here, ''), '/') || t when t = '' or starts_with(t, '#') then null
        else site || '/' || array_to_string(done, '/') || case when segs[-1] in ('.', '..') and len(done) > 0 then '/' else '' end || rest end as b
    from cleaned
), edges as (
    select a, b from links where contains(b, '://') and a <> b union select b, a from links where contains(b, '://') and a <> b
), reach as (
    select a as node, a as seen from edges
    union
    select r.node, e.b from reach r join edges e on r.seen = e.a
), urls as (
    select url, {host} as host, {path} as path from (select url from pages union select b from edges)
), judged as (
    select url, host, path, list_max(list_transform(list_filter([{rules}],
        lambda r: (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.p)),
        lambda r: {{'n': len(r.h || r.p), 'rule': r.h || r.p, 'verdict': r.v}})) as own
    from urls
), spread as (
    select r.node, min(r.seen) as url_class, bool_or(coalesce(j.own.verdict = 'allow', false)) as allows,
           bool_or(coalesce(j.own.verdict = 'block', false)) as blocks
    from reach r join judged j on j.url = r.seen group by r.node
)
select p.page_id, j.host, j.path, j.own.rule as rule,
       coalesce(j.own.verdict, case when s.blocks and not s.allows then 'block' else 'allow' end) as verdict,
       coalesce(s.url_class, p.url) as url_class
from pages p join judged j on j.url is not distinct from p.url left join spread s on s.node = p.url
"""


def op6() -> str:
    t = chat.TEMPLATE
    open_, close = t["header"]
    fixed = len(open_) + len(close) + len(t["footer"])
    loss = ", ".join(_quoted(x) for x in t["loss"])
    coded = "(length({0}) + length(regexp_replace({0}, '[^\\\\<#]', '', 'g')))"
    moves = ", ".join(f"{_quoted(a + chr(10) + b)}: {_quoted(to)}" for (a, b), to in t["transitions"].items())
    accept = ", ".join(_quoted(x) for x in t["accept"])
    return f"""
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select {chat.PROBE_ID}, 0, 'user', {_quoted(chat.PROBE_TEXT)}
    union all select {chat.PROBE_ID}, 1, 'assistant', {_quoted(chat.PROBE_TEXT)}
), convs as (
    select conv_id, count(*) as n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
           coalesce(sum(length(text)) filter (role in ({loss})), 0) as loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role in ({loss})), '')) as loss_sha256,
           sum({fixed} + {coded.format('text')} + length(role) + length(regexp_replace(role, '[^\\\\<#:]', '', 'g'))) as formatted_chars,
           list_reduce(list(role order by turn, role, text), lambda state, role:
               coalesce(map {{{moves}}}[state || chr(10) || role], 'error'), {_quoted(t['start'])}) in ({accept}) as valid
    from rows group by conv_id
)
select conv_id::bigint as conv_id, n_turns::bigint as n_turns, turns_sha256, loss_chars::bigint as loss_chars, loss_sha256,
       formatted_chars::bigint as formatted_chars, valid
from convs
"""


def quality_base() -> str:
    return f"""
with docs as (
    select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), words as (
    select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
    from docs
), places as (
    select r, unnest(w) as x, generate_subscripts(w, 1) as i from words
), threes as (
    select r, i, x, lead(x) over following as y, lead(x, 2) over following as z from places window following as (partition by r order by i)
), windows as (
    select r, i, count(*) over (partition by r, x, y, z) as n from threes where z is not null
), repeats as (
    select r, count(distinct i + j) as n from windows, unnest([0, 1, 2]) as steps(j) where n > 1 group by r
), counts as (
    select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
           len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
    from words left join repeats using (r)
)
select doc_id::bigint as doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed
from counts
"""


def op10() -> str:
    return """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::bigint as score
    from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""
