"""SQL for DuckDB of the queries in the catalogue, put together from shared common table expressions."""

from __future__ import annotations

from scribeframe.operators.validate import CREDENTIALS
from scribeframe.operators.vocabulary import COMMON

WORDS = r"""
parts as (select conv_id as doc, turn as seg, role, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as l from conversations),
toks as (select doc, seg, role, unnest(l) as text, unnest(range(len(l)))::int as pos from parts),
numbered as (select *, (row_number() over (partition by doc order by seg, pos) - 1)::bigint as idx from toks where text <> ''),
words as (select doc, seg, role, text, pos, idx, (idx * 400 + seg * 1000)::bigint as s, (idx * 400 + seg * 1000 + 300 + 20 * (length(text) % 4))::bigint as e from numbered)"""
SEGMENTS = WORDS + """,
segments as (select doc, seg, role, min(s)::bigint as s, max(e)::bigint as e, string_agg(text, ' ' order by pos) as text, count(*)::bigint as words from words group by doc, seg, role)"""
TURNS = SEGMENTS + """,
base as (select doc, seg, case role when 'user' then 'SPEAKER_00' when 'assistant' then 'SPEAKER_01' else 'SPEAKER_02' end as speaker, s - 150 as s, case when seg % 3 = 1 then e - 900 else e - 250 end as e from segments),
turns as (select * from (
  select doc, speaker, s as ts, e as te from base where seg % 5 <> 2
  union all select doc, speaker, s, s + 550 from base where seg % 5 = 2
  union all select doc, 'SPEAKER_09', s + 550, e from base where seg % 5 = 2) where te > ts and ts >= 0)"""
ASSIGNED = TURNS + """,
scores as (select w.doc, w.idx, t.speaker, sum(least(w.e, t.te) - greatest(w.s, t.ts)) as score from words w join turns t on w.doc = t.doc and t.ts < w.e and t.te > w.s group by all),
ranked as (select *, lead(score) over (partition by doc, idx order by score desc, speaker desc) as nxt, row_number() over (partition by doc, idx order by score desc, speaker desc) as rn from scores where score > 0),
assigned as (select w.*, case when r.nxt is null or r.score > r.nxt then r.speaker end as speaker from words w left join ranked r on w.doc = r.doc and w.idx = r.idx and r.rn = 1),
votes as (select doc, seg, speaker, sum(e - s) as score from assigned where speaker is not null group by all),
vranked as (select *, lead(score) over (partition by doc, seg order by score desc, speaker desc) as nxt, row_number() over (partition by doc, seg order by score desc, speaker desc) as rn from votes),
spoken as (select g.*, case when v.nxt is null or v.score > v.nxt then v.speaker end as speaker from segments g left join vranked v on g.doc = v.doc and g.seg = v.seg and v.rn = 1)"""
# the contract's folding for Latin letters: the case fold of sharp s, dashes that are symbols; no kana in the tables
FOLD = r"regexp_replace(replace(lower({}), 'ß', 'ss'), '[\p{{Z}}\p{{P}}\p{{C}}\s−─━]', '', 'g')"
PHRASE, FOLDED = "then th", "thenth"
HITS = (
    SEGMENTS
    + f""",
folded as (select *, {FOLD.format("text")} as f from words),
placed as (select *, coalesce(sum(length(f)) over (partition by doc order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as a from folded),
streams as (select doc, string_split(string_agg(f, '' order by idx), '{FOLDED}') as p from folded group by doc),
spots as (select doc, unnest(range(len(p) - 1))::int as hit, unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))::bigint + (i - 1) * {len(FOLDED)})) as p from streams where len(p) > 1),
covered0 as (select h.doc, h.hit, h.p, w.seg, w.idx, w.s, w.e, w.text, w.role, w.a, min(w.idx) over (partition by h.doc, h.hit) = w.idx as leads, max(w.idx) over (partition by h.doc, h.hit) = w.idx as trails from spots h join placed w on w.doc = h.doc and length(w.f) > 0 and w.a < h.p + {len(FOLDED)} and w.a + length(w.f) > h.p),
raws as (select *, flatten(list_transform(range(1, length(text) + 1), lambda i: list_transform(range(length({FOLD.format("text[i]")})), lambda j: i))) as raw from covered0),
covered as (select *, substr(text, case when leads then raw[p - a + 1] else 1 end, case when trails then raw[p + {len(FOLDED)} - a] else length(text) end - case when leads then raw[p - a + 1] else 1 end + 1) as piece from raws),
hits as (select doc, hit, min(s)::bigint as start, max(e)::bigint as "end", case when contains(string_agg(text, '' order by idx), '{PHRASE.replace(" ", "")}') then 'exact' else 'normalized' end as match,
  'word' as timing, min(idx)::bigint as first_word, max(idx)::bigint as last_word, min(seg)::bigint as seg, max(seg)::bigint as last_seg, case when count(distinct role) = 1 then min(role) end as speaker, string_agg(piece, ' ' order by idx) as text
  from covered group by doc, hit, p)"""
)


# rounds 2 r and 2 r + 1 have heard a transcript's first r + 1 segments, the second 0.7 s later; times in ms, samples are
# 16 a ms; k of the segments are final after a round, cut is the commit point
FOLLOWED = (
    SEGMENTS
    + """,
lists as (select doc, list(s order by seg) as ss, list(e order by seg) as es, list(text order by seg) as ts, count(*) - 1 as m from segments group by doc),
steps as (
  select doc, -1 as t, 0 as k0, 0 as k, 0::bigint as cut, 0::bigint as heard, false as last, m, ss, es, ts from lists
  union all
  select doc, t, k0, k, case when k = k0 then (case when none and tail > 400000 then greatest(cut, heard - 24000) else cut end) when last then heard
      else (case when stop > begin then (begin + stop) // 2 else begin end) end, heard, last, m, ss, es, ts
  from (select *, greatest(16 * es[k], cut) as begin, least(greatest(case when k < r1 then 16 * ss[k + 1] else heard - 24000 end, 16 * es[k]), heard) as stop from (
    select *, k0 >= r1 as none, case when last then r1 when n > 0 then k0 + n when tail > 400000 and r1 - k0 > 1 then r1 - 1 when tail > 400000 and r1 - k0 = 1 then r1 else k0 end::int as k from (
      select *, len(list_filter(es[k0 + 1 : r1], lambda x: x / 1000.0 <= heard / 16000.0 - 1.5)) as n, heard - cut as tail from (
        select doc, t + 1 as t, k as k0, cut, (t + 1) // 2 + 1 as r1, 16 * (es[(t + 1) // 2 + 1] + (t + 1) % 2 * 700) as heard, t + 1 = 2 * m + 1 as last, m, ss, es, ts from steps where t < 2 * m + 1))))),
final as (select doc, t, 0 as kind, i, i as first, ss[i] as start, es[i] as "end", 1 as segments, ts[i] as text, null::bigint as cut from (select *, unnest(range(k0 + 1, k + 1)) as i from steps)),
part as (select doc, t, 1 as kind, 0 as i, k + 1 as first, ss[k + 1] as start, es[t // 2 + 1] as "end", t // 2 + 1 - k as segments, array_to_string(ts[k + 1 : t // 2 + 1], ' ') as text, cut from steps where t >= 0 and not last and (k > k0 or t % 2 = 0)),
closed as (select doc, t, 2 as kind, 0 as i, null as first, null as start, null as "end", 0 as segments, '' as text, cut from steps where last),
events as (select * from final union all select * from part union all select * from closed)"""
)


def _runs(chosen: str, mode: str) -> str:
    """Selection of the words that satisfy ``chosen`` within transcripts that have any."""
    flag = "coalesce(c.hit, 0) = 1" if mode == "remove" else "coalesce(c.hit, 0) = 0"
    return (
        SEGMENTS
        + f""",
chosen as ({chosen}),
units as (select w.*, {flag} as removed from words w left join (select distinct doc, idx, 1 as hit from chosen) c on w.doc = c.doc and w.idx = c.idx where w.doc in (select doc from scope)),
good as (select * from units where doc in (select doc from units group by doc having bool_or(removed) and not bool_and(removed))),
duration as (select doc, (max(e) + 2000)::bigint as duration from units group by doc),
isl as (select *, sum(case when removed then 0 else 1 end) over (partition by doc order by s, e, idx) as island from good),
runs as (select doc, island, min(s) as start, max(e) as "end", sum(e - s) as speech, count(*) as units, min(idx) as first, max(idx) as last from isl where removed group by doc, island),
spans0 as (select r.*, (select max(k.e) from good k where k.doc = r.doc and not k.removed and k.e <= r.start) as ke, (select min(k.s) from good k where k.doc = r.doc and not k.removed and k.s >= r."end") as ks, d.duration from runs r join duration d on r.doc = d.doc),
spans1 as (select doc, island, start, "end", coalesce(ke, 0) as lo, ke is not null as after_kept, coalesce(ks, duration) as hi, ks is not null as before_kept, speech, units, first, last from spans0),
edge as (select g.doc, min(case when not removed then s end) as k0, max(case when not removed then e end) as k1, min(case when removed then s end) as r0, max(case when removed then e end) as r1, any_value(duration) as duration from good g join duration d on g.doc = d.doc group by g.doc)"""
    )


SCOPE = "top as (select doc, max(idx) as m from words group by doc having max(idx) >= 12), scope as (select doc from top)"
RANGES = "select w.doc, w.idx from words w join top t on w.doc = t.doc where w.idx between 3 and 7 or w.idx between 10 and t.m - 1"
SPAN = """doc, 'r' || row_number() over (partition by doc order by island) as id, start::bigint as start, "end"::bigint as "end", lo::bigint as lo, hi::bigint as hi, after_kept, before_kept, speech::bigint as speech, units::bigint as units, first::bigint as first, last::bigint as last, (hi - lo)::bigint as most"""


def _selection(mode: str, chosen: str, scope: str, query: str) -> str:
    body = _runs(chosen, mode)
    head, rest = body.split(",\nchosen as", 1)
    return f"with {head},\n{scope},\nchosen as{rest}\n{query}"


FLAWED = SEGMENTS + """,
flawed as (select doc, seg, printf('seg_%04d', case when seg % 6 = 5 then seg - 1 else seg end) as id, case when seg % 5 = 3 then s - 4000 else s end as s, case when seg % 7 = 4 then s - 10 else e end as e, text, 60000 as duration from segments),
formed as (select *, s >= 0 and e > s as ok from flawed),
before as (select *, last_value(case when ok then s end ignore nulls) over w as ps, last_value(case when ok then e end ignore nulls) over w as pe, count(*) over (partition by doc, id) as n from formed window w as (partition by doc order by seg rows between unbounded preceding and 1 preceding))"""

CLOCK = "printf('%02d:%02d:%02d{sep}%03d', {t} // 3600000, ({t} // 60000) % 60, ({t} // 1000) % 60, {t} % 1000)"


def _clock(column: str, sep: str) -> str:
    return CLOCK.format(sep=sep, t=f"greatest({column}, 0)::bigint")


def _export(line: str, head: str, between: str, tail: str) -> str:
    return f"""with {SEGMENTS},
numbered_segments as (select *, row_number() over (partition by doc order by seg) as n from segments),
texts as (select doc, {head} || string_agg({line}, {between} order by n) || {tail} as content from numbered_segments group by doc)
select doc, md5(content) as hash, length(content)::int as chars from texts"""


NL = "chr(10)"
NORMALIZED = r"regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{Cf}]', '', 'g'), '[ \t\r\n\x{A0}\x{3000}]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"

SQL = {
    "words_index": f"with {WORDS} select doc, seg, pos, idx, text, s, e from words",
    "segments_view": f"with {SEGMENTS} select doc, seg, role, s, e, words, length(text)::int as chars from segments",
    "normalize": f"select doc_id, md5({NORMALIZED}) as hash from documents",
    "fold_text": f"select doc_id, length({FOLD.format('text')})::int as chars, md5({FOLD.format('text')}) as hash from documents",
    "find_exact": f'with {HITS} select doc, hit, start, "end", match, timing, first_word, last_word, seg, last_seg, speaker, text from hits',
    "find_summary": f"with {HITS}, c as (select doc, count(distinct seg)::bigint as segments, count(*)::bigint as words, true as word_timed from words group by doc) select c.*, coalesce(h.n, 0)::bigint as hits from c left join (select doc, count(*) as n from hits group by doc) h on c.doc = h.doc",
    "find_context": f"""with {HITS}, r as (select *, row_number() over (partition by doc order by seg) as rank from segments),
      h as (select x.doc, x.hit, a.rank as r0, b.rank as r1 from hits x join r a on a.doc = x.doc and a.seg = x.seg join r b on b.doc = x.doc and b.seg = x.last_seg)
      select h.doc, h.hit, coalesce(string_agg(r.text, ' | ' order by r.rank) filter (r.rank < r0), '') as before, coalesce(string_agg(r.text, ' | ' order by r.rank) filter (r.rank > r1), '') as after
      from h join r on r.doc = h.doc and r.rank between r0 - 1 and r1 + 1 group by h.doc, h.hit""",
    "interval_union": """with busy as (select user_id, epoch_us(ts) // 1000 as s, epoch_us(ts) // 1000 + 60000 * (1 + event_id % 90) as e from events),
      m as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as latest from busy),
      g as (select *, sum(case when latest is null or s > latest then 1 else 0 end) over (partition by user_id order by s, e rows unbounded preceding) as g from m)
      select user_id, min(s)::bigint as start, max(e)::bigint as "end" from g group by user_id, g""",
    "event_gaps": """with busy as (select user_id, epoch_us(ts) // 1000 as s, epoch_us(ts) // 1000 + 60000 * (1 + event_id % 90) as e from events),
      m as (select *, lag(e) over (partition by user_id order by s, e) as before from busy),
      g as (select *, sum(case when before is null or s - before > 3600000 then 1 else 0 end) over (partition by user_id order by s, e rows unbounded preceding) as g from m)
      select user_id, g::bigint as g, min(s)::bigint as start, count(*)::bigint as n from g group by user_id, g""",
    "speaker_words": f"with {ASSIGNED} select doc, idx, speaker from assigned",
    "speaker_segments": f"with {ASSIGNED} select doc, seg, speaker from spoken",
    "speaker_counts": f"""with {ASSIGNED} select g.doc, g.segments, g.assigned, g.unassigned, w.words, w.words_assigned from
      (select doc, count(*)::bigint as segments, count(speaker)::bigint as assigned, (count(*) - count(speaker))::bigint as unassigned from spoken group by doc) g join
      (select doc, count(*)::bigint as words, count(speaker)::bigint as words_assigned from assigned group by doc) w on g.doc = w.doc""",
    "speaker_totals": f"with {ASSIGNED} select doc, speaker, count(*)::bigint as segments from spoken where speaker is not null group by doc, speaker",
    "overlap_semi": f"with {SEGMENTS}, regions as (select doc, e - 100 as ts, e + 900 as te from segments where seg % 4 = 1) select doc, seg from segments g where exists (select 1 from regions r where r.doc = g.doc and r.ts < g.e and r.te > g.s)",
    "select_remove_words": _selection("remove", RANGES, SCOPE, f"select {SPAN} from spans1"),
    "select_sentences": _selection("remove", RANGES, SCOPE, "select doc, seg, count(*) filter (removed)::bigint as removed_units, count(*)::bigint as units, coalesce(sum(e - s) filter (removed), 0)::bigint as removed_ms, bool_and(removed) as whole from good group by doc, seg having bool_or(removed)"),
    "select_index_runs": _selection("keep", RANGES, SCOPE, "select doc, min(idx)::bigint as first, max(idx)::bigint as last from (select doc, idx, idx - row_number() over (partition by doc order by idx) as g from good where removed) group by doc, g"),
    "select_keep_segments": _selection("keep", "select doc, idx from words where seg % 3 = 1", "scope as (select distinct doc from words where seg % 3 = 1)", f"""select {SPAN} from (select * from spans1
      union all select doc, -1, 0, 0, 0, false, k0, true, 0, 0, null, null from edge where k0 > 0 and (r0 is null or r0 >= k0)
      union all select doc, 1000000000, duration, duration, k1, true, duration, false, 0, 0, null, null from edge where k1 < duration and (r1 is null or r1 <= k1))"""),
    "validate_segments": f"""with {FLAWED} select doc, seg, 'times' as rule from before where not ok union all select doc, seg, 'end' from before where ok and e > duration + 500
      union all select doc, seg, 'order' from before where ok and s < ps union all select doc, seg, 'overlap' from before where ok and s < pe - 10 union all select doc, seg, 'duplicate_id' from before where n > 1""",
    "validate_words": f"""with {FLAWED}, x as (select w.*, f.s as ss, f.e as se, lag(w.e) over (partition by w.doc, w.seg order by w.pos) as pe from words w join flawed f on w.doc = f.doc and w.seg = f.seg)
      select doc, seg, pos, 'outside' as rule from x where s < ss - 10 or e > se + 10 union all select doc, seg, pos, 'overlap' from x where s < pe - 10 union all select doc, seg, pos, 'times' from x where not (s >= 0 and e > s)""",
    "turn_rules": r"""with t as (select doc_id // 10 as doc, doc_id as n, (doc_id % 10 * 10)::double as s, (doc_id % 10 * 10 + doc_id * 7 % 13 - 1)::double as e, case when doc_id % 13 = 0 then 'Bob' else 'SPEAKER_0' || doc_id % 3 end as speaker from documents),
      l as (select *, lag(e) over (partition by doc order by n) as pe from t)
      select distinct doc, 'times' as rule from l where not (s >= 0 and e > s) union select doc, 'order' from l where s < pe - 0.01 union select doc, 'speaker' from l where not regexp_matches(speaker, '^SPEAKER_\d{2,}$')""",
    "chunk_rules": """with r as (select o_orderkey as req, case when o_orderkey % 3 > 0 then o_orderkey % 4000 end as cs, o_orderkey % 10 as p, o_orderkey % 5 = 0 as anylang, o_orderkey % 7 = 0 as regions from orders)
      select * from (select req, case when cs is not null and cs not between 30 and 3600 then 'chunk_seconds' when cs is not null and anylang then 'language_required_for_chunking' when p not between 1 and 8 then 'parallel'
        when cs is null and (p <> 1 or regions) then 'chunk_seconds_required' end as reason from r) where reason is not null""",
    "chunk_totals": """select l_suppkey as doc, count(*)::bigint as chunks, count(*) filter (l_returnflag = 'R')::bigint as from_cache, count(*) filter (l_returnflag <> 'R')::bigint as recognized,
      round(coalesce(sum(case when l_returnflag <> 'R' then l_linenumber / 8.0::double end), 0), 3)::double as engine_seconds from lineitem group by l_suppkey""",
    "chunk_languages": """with c as (select doc_id % 60 as doc, case when doc_id % 4 = 0 then lang when doc_id % 60 > 20 then 'en' end as language from documents),
      l as (select doc, list_sort(list(distinct language)) as l from c where language is not null group by doc)
      select doc, case when len(l) = 1 then l[1] end as language, case when len(l) > 1 then array_to_string(l, ', ') end as several from l""",
    "leakage_scan": r"""select doc_id as doc, reason from (select doc_id, case
      when regexp_matches(text, '\bsk-[A-Za-z0-9_\-]{16,}') or regexp_matches(text, '\bsk-ant-[A-Za-z0-9_\-]{16,}') or regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b') or regexp_matches(text, '\bhf_[A-Za-z0-9]{20,}')
        or regexp_matches(text, '\bBearer\s+[A-Za-z0-9._\-]{16,}') or regexp_matches(text, '\bgh[pousr]_[A-Za-z0-9]{20,}') or regexp_matches(text, '\b[A-Z_]*(API_KEY|SECRET|TOKEN|PASSWORD)[A-Z_]*=\S+') then 'secret'
      when regexp_matches(text, '^\s*(ffmpeg|ffprobe|whisper|whisper-cli|whisper-cpp|python3?|sh|bash|cmd\.exe|powershell)\b\s+-') or regexp_matches(text, '\$\(|`[^`]+`|\|\s*(sh|bash)\b') then 'command'
      when regexp_matches(text, '^(/|~/)[^\s]+/[^\s]*') or regexp_matches(text, '^[A-Za-z]:\\[^\s]+') then 'path' end as reason from documents) where reason is not null""",
    "required_keys": """with d as (select conv_id as doc, turn from conversations)
      select doc, 'segments[0]' as place, 'words' as key from d where turn % 3 = 0 union all select doc, 'segments[0].words[0]', 'confidence' from d where turn % 3 <> 0 and turn % 4 = 1
      union all select doc, 'source', 'fingerprint' from d where turn % 5 = 2 union all select doc, 'document', 'warnings' from d where turn % 2 = 1
      union all select doc, 'document', k from d, (values ('asset_id'), ('created_at'), ('engine'), ('engine_version'), ('language'), ('language_confidence'), ('language_source'), ('provenance')) v(k)""",
    "provenance_rules": """with d as (select doc_id as doc from documents)
      select doc, 'engine' as rule from d where doc % 3 = 0 union all select doc, 'execution_mode' from d where doc % 4 = 1 union all select doc, 'parameters_hash' from d where doc % 5 = 2
      union all select doc, 'processing_seconds' from d where doc % 7 = 3 union all select doc, 'tool' from d where doc % 6 = 5 union all select doc, 'model' from d where doc % 11 = 4 union all select doc, 'parameters' from d where doc % 8 = 6""",
    "corrections_substring": f"""with {SEGMENTS} select doc, seg, ((length(text) - length(replace(lower(text), 'tion', ''))) // 4)::int as n, md5(regexp_replace(text, '(?i)tion', 'ción', 'g')) as hash from segments""",
    "segment_builder": f"""with {WORDS}, b as (select *, lag(e) over w as pe, lag(text) over w as pt from words window w as (partition by doc order by idx)),
      g as (select *, sum(case when pe is null or s - pe >= 90 or regexp_matches(pt, '[.!?。！？]["''”’)\\]」』]*$') then 1 else 0 end) over (partition by doc order by idx) as g from b)
      select doc, g::bigint as g, min(s)::bigint as s, max(e)::bigint as e, count(*)::bigint as words from g group by doc, g""",
    "clamp_clean": f"""with {SEGMENTS}, raw as (select doc, seg as n, s, case when seg % 4 = 2 then s when e > 15000 and e <= 17000 and s < 15000 then 15000 else e end as e, text from segments),
      kept as (select * from raw where e > s) select doc, n, printf('seg_%04d', row_number() over (partition by doc order by s, e, n)) as id, s::bigint as s, e::bigint as e, length(text)::int as chars from kept""",
    "language_decision": """select doc_id, case when doc_id % 3 = 0 and lang is not null then lang when doc_id % 5 <> 0 and lang is not null and doc_id % 10 >= 5 then lang else 'unknown' end as language,
      case when doc_id % 3 = 0 and lang is not null then 'requested' when doc_id % 5 <> 0 and lang is not null and doc_id % 10 >= 5 then 'detected' else 'unknown' end as source from documents""",
    "engine_filter": """with e(id, available, network, vocabulary, words, detection, languages) as (values
        ('cloud-large', true, true, true, true, true, []), ('fast-local', true, false, true, true, true, []), ('ja-local', true, false, false, false, false, ['ja']),
        ('aligner', false, false, false, true, false, ['en', 'ja', 'zh']), ('program', true, false, false, true, false, ['en', 'fr', 'de'])),
      r as (select doc_id as req, case when doc_id % 7 = 0 then 'fast-local' end as engine, case when doc_id % 4 <> 0 then lang end as language, doc_id % 2 = 0 as offline, doc_id % 3 = 0 as needs_words, doc_id % 5 = 0 as needs_vocabulary from documents)
      select req, id, case when engine is not null and engine <> id then 'engine_id_mismatch' when not available then concat_ws(',', case when offline and network then 'network_required' end, 'engine_not_installed') else
        concat_ws(',', case when offline and network then 'network_required' end, case when language is not null and len(languages) > 0 and not list_contains(languages, language) then 'language_unsupported' end,
          case when language is null and not detection then 'language_detection_unsupported' end, case when needs_words and not words then 'word_timestamps_unsupported' end, case when needs_vocabulary and not vocabulary then 'custom_vocabulary_unsupported' end) end as reasons from r, e""",
    "cache_antijoin": "select o_custkey as doc, o_orderkey as chunk from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')",
    "chunk_join": """with r as (select o.o_custkey as doc, l_orderkey as chunk, l_linenumber::bigint as n, l_linenumber * 6000 - 7000 as s, l_linenumber * 6000 + l_suppkey % 50 * 100 as e, o_orderkey * 30000 as off from lineitem l join orders o on l_orderkey = o_orderkey)
      select doc, chunk, n, (off + greatest(s, 0))::bigint as s, (off + least(e, 30000))::bigint as e from r where s < 30000 and off + least(e, 30000) > off + greatest(s, 0)""",
    "quiet_window": """with f as (select l_suppkey as path, row_number() over (partition by l_suppkey order by l_orderkey * 8 + l_linenumber, l_partkey * 17 % 1009) - 1 as frame, l_partkey * 17 % 1009 as energy from lineitem),
      w as (select path, frame, sum(energy) over (partition by path order by frame rows between 14 preceding and current row) as window_sum from f),
      c as (select path, frame - 7 as centre, window_sum, row_number() over (partition by path order by window_sum, abs(frame - 7 - 50), frame - 7) as rn from w where frame >= 14)
      select path, centre::bigint as centre, window_sum::bigint as "window" from c where rn = 1""",
    "cer": f"""with x as (select item_id, {FOLD.format("text")} as a, {FOLD.format("replace(text, 'tion', 'sion')")} as b from benchmark) select item_id, round_even(levenshtein(a, b)::double / greatest(1, length(a)) * 1000000, 0)::bigint as cer from x""",
    "batch_outcomes": """with r as (select l_orderkey as item, max(case when l_linenumber < 6 then l_partkey end) as result, max(case when l_returnflag = 'R' then 'TIMEOUT' end) as error from lineitem group by 1)
      select o_orderkey as item, r.result is not null and r.error is null as ok, r.result, case when r.result is null then coalesce(r.error, 'NO_RESULT') end as error from orders left join r on o_orderkey = r.item""",
    "export_srt": _export(f"n || {NL} || {_clock('s', ',')} || ' --> ' || {_clock('e', ',')} || {NL} || text || {NL}", "''", NL, "''"),
    "export_vtt": _export(f"{_clock('s', '.')} || ' --> ' || {_clock('e', '.')} || {NL} || text || {NL}", f"'WEBVTT' || {NL} || {NL}", NL, "''"),
    "export_tsv": _export("s || chr(9) || e || chr(9) || text", f"'start' || chr(9) || 'end' || chr(9) || 'text' || {NL}", NL, NL),
    "export_txt": _export("text", "''", NL, NL),
}

_EVENTS = """with {segments}, b as (select *, lag(e) over (partition by doc order by seg) as pe from segments), g as (select *, sum(case when pe is null or s - pe > {gap} then 1 else 0 end) over (partition by doc order by seg) as g from b)
  select doc, doc || '_spev_' || printf('%04d', g::bigint) as event, min(s)::bigint as start, arg_max(e, seg)::bigint as "end", count(*)::bigint as segments, string_agg(text, ' ' order by seg) as text from g group by doc, g"""
SQL["speech_events"] = _EVENTS.format(segments=SEGMENTS, gap=0)
SQL["speech_events_gap"] = _EVENTS.format(segments=SEGMENTS, gap=800)

SQL["token_groups"] = (
    "with "
    + WORDS.lstrip()
    + r""",
tokens as (select doc, idx as n, s, case when idx % 4 in (1, 2) then s else e end as e, case when idx % 4 = 2 or idx % 11 = 1 then ',' else text end as text from words),
kinds as (select *, e > s as closes, e <= s and not regexp_matches(text, '[\p{L}\p{N}]') as mark from tokens),
near as (select *, max(case when closes then n end) over (partition by doc order by n rows between unbounded preceding and current row) as before,
  min(case when closes then n end) over (partition by doc order by n rows between current row and unbounded following) as after,
  max(case when not closes and not mark then n end) over (partition by doc order by n rows between unbounded preceding and current row) as held from kinds),
kept as (select *, mark and before is not null and (held is null or held < before) as attached from near),
anchored as (select *, case when closes then n when attached then before else after end as anchor from kept),
tails as (select doc, max(e) > min(s) as spans from anchored where anchor is null group by doc),
joined as (select a.*, a.anchor is null and not t.spans and a.before is not null as joins from anchored a left join tails t on a.doc = t.doc),
ranked as (select *, dense_rank() over (partition by doc order by coalesce(case when joins then before else anchor end, 9223372036854775807))::bigint as g from joined)
select doc, g, min(case when not attached and not joins then s end)::bigint as s,
  case when max(case when not attached and not joins then e end) > min(case when not attached and not joins then s end) then max(case when not attached and not joins then e end) else min(case when not attached and not joins then s end) + 80 end::bigint as e,
  string_agg(text, '' order by n) as text, count(*)::bigint as tokens
from ranked group by doc, g"""
)

SQL["follow_events"] = f"""with recursive {FOLLOWED} select doc, row_number() over (partition by doc order by t, kind, i) as event, ['final', 'partial', 'end'][kind + 1] as type, segments::bigint as segments,
  case when segments > 0 then printf('seg_%04d', first::bigint) end as first, case when segments > 0 then start end::bigint as start, case when segments > 0 then "end" end::bigint as "end", md5(coalesce(text, '')) as hash, cut as committed from events"""
SQL["follow_replay"] = f"""with recursive {FOLLOWED} select doc, row_number() over (partition by doc order by t, i) as n, start::bigint as s, "end"::bigint as e, md5(text) as hash from final"""

JUDGED = SEGMENTS + """,
judged as (select *, case when idx % 13 <> 0 then idx % 10 end as confidence, case when idx % 5 = 0 then 'interpolated' else 'measured' end as timing from words)"""
# places of the alternation's matches: cut the text at them and add up lengths
EDITED = (
    JUDGED
    + """,
cut as (select doc, seg, s as ss, e as se, text, regexp_extract_all(text, '(?i)e th|tion|n a') as hits, string_split_regex(text, '(?i)e th|tion|n a') as parts from segments),
edits as (select doc, seg, ss, se, text, k, hits[k + 1] as hit, list_sum(list_transform(parts[1 : k + 1], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(hits[1 : k], lambda x: length(x))), 0)::bigint as a from (select *, unnest(range(len(hits))) as k from cut)),
ruled as (select *, a + length(hit) as b, case lower(hit) when 'e th' then 0 when 'tion' then 1 else 2 end as rule, ['e-t', 'ción', 'n-a'][case lower(hit) when 'e th' then 1 when 'tion' then 2 else 3 end] as t from edits),
spots as (select *, (sum(length(text) + 1) over (partition by doc, seg order by pos) - length(text) - 1)::bigint as p from judged),
touched as (select r.doc, r.seg, r.k, r.a, r.b, r.t, w.pos, w.s, w.e from ruled r join spots w on w.doc = r.doc and w.seg = r.seg and w.p < r.b and w.p + length(w.text) > r.a),
reach as (select doc, seg, k, a, min(pos) as lo, max(pos) as hi from touched group by all),
apart as (select *, coalesce(lo > max(hi) over (partition by doc, seg order by a rows between unbounded preceding and 1 preceding), true) as fresh from reach),
grp as (select *, sum(case when fresh then 1 else 0 end) over (partition by doc, seg order by a) as g from apart),
spans as (select doc, seg, g, min(lo) as lo, max(hi) as hi from grp group by all),
merged as (select x.doc, x.seg, x.g, min(w.pos) as pos, min(w.s) as s, max(w.e) as e, case when count(w.confidence) = count(*) then min(w.confidence) end as confidence, case when bool_or(w.timing = 'interpolated') then 'interpolated' else 'measured' end as timing, min(w.p) as lo, max(w.p + length(w.text)) as hi from spans x join spots w on w.doc = x.doc and w.seg = x.seg and w.pos between x.lo and x.hi group by x.doc, x.seg, x.g),
pieces as (select m.doc, m.seg, m.g, r.a, r.b, r.t, r.text, m.lo, m.hi, coalesce(lag(r.b) over (partition by m.doc, m.seg, m.g order by r.a), m.lo) as since, row_number() over (partition by m.doc, m.seg, m.g order by r.a desc) = 1 as last from merged m join grp g on g.doc = m.doc and g.seg = m.seg and g.g = m.g join ruled r on r.doc = g.doc and r.seg = g.seg and r.k = g.k),
renewed as (select doc, seg, g, string_agg(substr(text, since + 1, greatest(greatest(a, lo) - since, 0)) || t || case when last then substr(text, least(b, hi) + 1, greatest(hi - b, 0)) else '' end, '' order by a) as text from pieces group by all)"""
)
SQL["corrected_words"] = f"""with {EDITED.lstrip()} select m.doc, m.seg, m.pos, trim(regexp_replace(r.text, '\\s+', ' ', 'g')) as text, m.s, m.e, m.confidence, m.timing from merged m join renewed r on r.doc = m.doc and r.seg = m.seg and r.g = m.g
  union all select w.doc, w.seg, w.pos, w.text, w.s, w.e, w.confidence, w.timing from spots w where not exists (select 1 from spans x where x.doc = w.doc and x.seg = w.seg and w.pos between x.lo and x.hi)"""
SQL["corrections_applied"] = f"""with {EDITED.lstrip()} select r.doc, r.seg, r.k, r.rule, r.hit as "from", r.t as "to", coalesce(t.s, r.ss) as s, coalesce(t.e, r.se) as e, case when t.s is null then 'segment' else 'word' end as timing
  from ruled r left join (select doc, seg, k, min(s) as s, max(e) as e from touched group by all) t on t.doc = r.doc and t.seg = r.seg and t.k = r.k"""

DICTIONARY = (
    JUDGED
    + """,
units as (select *, s / 1000.0 as us, case when seg % 11 = 5 then s else e end / 1000.0 as ue, (sum(length(text)) over (partition by doc, seg order by pos) - length(text))::bigint as a from judged),
listed as (select doc, seg, replace(text, ' ', '') as target, regexp_extract_all(replace(text, ' ', ''), '.{1,4}') as l from segments),
kept as (select doc, seg, target, case when seg % 7 = 3 then l[1 : len(l) - 1] else l end as l from listed),
tokens as (select doc, seg, unnest(range(len(l)))::int as pos, unnest(l) as text from kept),
places as (select *, (sum(length(text)) over (partition by doc, seg order by pos) - length(text))::bigint as a from tokens),
met as (select t.doc, t.seg, t.pos, t.text, t.a, t.a + length(t.text) as b, u.a as ua, u.a + length(u.text) as ub, u.us, u.ue, u.confidence, u.timing from places t join units u on u.doc = t.doc and u.seg = t.seg and u.a < t.a + length(t.text) and u.a + length(u.text) > t.a),
timed as (select doc, seg, pos, text, a, b,
  min_by(case when a = ua then us else round(us + (ue - us) * (a - ua) / (ub - ua), 6) end, ua) as s, max_by(case when b = ub then ue else round(us + (ue - us) * (b - ua) / (ub - ua), 6) end, ua) as e,
  case when count(confidence) = count(*) then min(confidence) end as confidence, min_by(a = ua and timing = 'measured', ua) and max_by(b = ub and timing = 'measured', ua) as sure from met group by doc, seg, pos, text, a, b),
judgement as (select k.doc, k.seg, case when array_to_string(l, '') <> target then 'tokens_differ' when not (select bool_and(e > s) from timed t where t.doc = k.doc and t.seg = k.seg) then 'no_duration' end as reason from kept k)"""
)
SQL["dictionary_words"] = f"""with {DICTIONARY.lstrip()} select doc, seg, pos, text, round(s * 1000000)::bigint as s, round(e * 1000000)::bigint as e, confidence, case when sure then 'measured' else 'interpolated' end as timing, case when pos % 2 = 0 then 'noun' else 'other' end as tag
  from timed join judgement using (doc, seg) where reason is null"""
SQL["dictionary_refused"] = f"with {DICTIONARY.lstrip()} select doc, seg, reason from judgement where reason is not null"

SQL["untimed_words"] = f"""with {WORDS.lstrip()}, u as (select *, not (idx % 4 = 1 or seg % 5 = 2 or idx % 8 = 3) as timed from words),
  g as (select *, greatest(sum(case when timed then 1 else 0 end) over (partition by doc, seg order by pos), 1) as g from u)
  select doc, seg, min(case when timed then pos end) as pos, case when doc % 3 = 0 then string_agg(text, '' order by pos) else string_agg(text, ' ' order by pos) end as text, max(case when timed then s end) as s, max(case when timed then e end) as e,
    round(greatest(0, least(1, max(case when timed then idx % 7 / 4.0 - 0.25 end))) * 100)::bigint as confidence, count(*) filter (not timed) as merged from g group by doc, seg, g having bool_or(timed)"""
SQL["hypothesis_tokens"] = f"""with {WORDS.lstrip()} select doc, idx as n, case idx % 3 when 2 then '' else text end as text, case idx % 3 when 0 then s else idx * 80 end as s, case idx % 3 when 0 then e else (idx + 2) * 80 end as e,
    case when doc % 5 <> 3 then idx * 7 + 1 end as id from words where doc % 5 <> 4 and doc % 7 <> 6"""

TERMS = (
    r"""
lines as (select doc_id as doc, unnest(range(len(l))) as line, unnest(l) as x from (select doc_id, regexp_split_to_array(coalesce(text, ''), '[\n\r]') as l from documents)),
cut as (select doc, line, regexp_extract_all(x, '([^\p{L}\p{N}]*)([\p{L}\p{N}](?:[\p{L}\p{N}_''’-]*[\p{L}\p{N}])?)', 1) as gaps, regexp_extract_all(x, '([^\p{L}\p{N}]*)([\p{L}\p{N}](?:[\p{L}\p{N}_''’-]*[\p{L}\p{N}])?)', 2) as forms from lines),
flat as (select doc, line, unnest(range(len(forms))) as j, unnest(gaps) as gap, unnest(forms) as form from cut),
placed as (select *, coalesce(bool_or(regexp_matches(form, '\p{L}')) over (partition by doc, line order by j rows between unbounded preceding and 1 preceding), false) as lettered, right(rtrim(gap, ' '), 1) as mark from flat),
marked as (select *, not lettered or (mark <> '' and contains('.!?:;。！？"''(‘“' || chr(9), mark)) as initial, length(regexp_replace(form, '[^\p{Lu}]', '', 'g')) as caps, length(regexp_replace(form, '[^\p{L}]', '', 'g')) as letters, replace(lower(form), 'ß', 'ss') as key from placed),
classed as (select *, case when length(form) >= 4 and (regexp_matches(form, '[\p{Nd}-]') or caps >= 2 or (caps = 1 and regexp_matches(form, '^[^\p{L}]*\p{Lu}') and not initial)) or (caps > 0 and not regexp_matches(form, '\p{Ll}') and letters >= 3) then 0
  when length(form) >= 7 and letters = length(form) then 1 end as class from marked where regexp_matches(form, '[A-Za-zÀ-ɏ]')),
taken as (select * from classed where class is not null and key not in ("""
    + ", ".join(f"'{w}'" for w in COMMON)
    + r""")),
spelt as (select doc, key, form, sum(case when initial then 1 else 2 end) as w from taken group by all),
best as (select doc, key, min_by(form, (-w, form)) as term, bool_or(form = key) as low from spelt group by doc, key),
keyed as (select doc, key, min(class) as class, count(*) as n, min((line, j)) as spot from taken group by doc, key),
counted as (select k.doc, k.key, b.term, case when class = 0 and low and not regexp_matches(k.key, '[\p{Nd}-]') then 1 else class end as kind, n, spot from keyed k join best b on b.doc = k.doc and b.key = k.key),
found as (select * from counted where kind = 0 or length(term) >= 7),
ranked as (select doc, term, row_number() over (partition by doc order by kind, -n, -length(term), spot, key) as rank from found where not ("""
    + " or ".join("regexp_matches(term, '" + p.replace("'", "''") + "')" for p in CREDENTIALS)
    + """) qualify rank <= 50)"""
)
SQL["term_counts"] = f"with {TERMS.lstrip()} select doc, key, term, kind::bigint as kind, n from found"
SQL["terms"] = f"with {TERMS.lstrip()} select doc, rank, term from ranked"
SQL["prompts"] = f"""with {TERMS.lstrip()}, u as (select *, sum(length(term) + case when rank > 1 then 2 else 0 end) over (partition by doc order by rank) + 1 as used from ranked)
  select doc, string_agg(term, ', ' order by rank) || '.' as prompt, count(*)::bigint as used from u where used <= 600 group by doc"""

ASKED = (
    """
asked as (select doc_id as n, case when doc_id % 19 = 4 then 'english' when doc_id % 6 > 0 then lang end as language, case when doc_id % 23 = 5 then 1.5 else doc_id % 10 / 10.0 end as temperature, doc_id % 12 as beam,
  case when doc_id % 5 = 0 then (30 + doc_id % 40)::double end as chunk, case when doc_id % 7 = 1 then substr(text, 1, 60) end as prompt, n_chars from documents),
judged as (select *, case when n % 29 = 6 then '/forbidden_key' when n % 17 = 3 then 'input/missing' when n % 19 = 4 then 'language/code' when temperature > 1 then 'temperature/range' when beam not between 1 and 10 then 'beam_size/range'
  when """
    + " or ".join("regexp_matches(prompt, '" + p.replace("'", "''") + "')" for p in CREDENTIALS)
    + """ then 'initial_prompt/credential' when chunk is not null and language is null then 'chunk_seconds/language_required_for_chunking' end as broken from asked),
sound as (select *, '{"audio_stream": 0, "beam_size": ' || beam || case when chunk is not null then ', "chunking": {"chunk_seconds": ' || chunk || ', "speech_regions": null}' else '' end || ', "initial_prompt": ' || case when trim(coalesce(prompt, ''), chr(9) || chr(10) || chr(13) || ' ') = '' then 'null' else to_json(prompt) end
  || ', "language": ' || coalesce('"' || language || '"', 'null') || ', "temperature": ' || temperature::double || ', "vad_filter": false, "word_timestamps": false}' as parameters from judged where broken is null)"""
)
SQL["request_rules"] = f"with {ASKED.lstrip()} select n as req, split_part(broken, '/', 1) as key, split_part(broken, '/', 2) as reason from judged where broken is not null"
SQL["request_parameters"] = f"with {ASKED.lstrip()} select n as req, 'talk_' || n || '.wav' as input, language, sha256(parameters) as parameters_hash from sound"
SQL["dry_run"] = f"""with {ASKED.lstrip()}, j as (select *, case when n % 11 = 0 then 'FILE_NOT_FOUND' when n % 13 = 2 and n_chars / 100 > 50 or n_chars / 100 > 14400 then 'BUDGET_EXCEEDED' end as reason,
    sha256('{{"engine": {{"execution_mode": "local", "id": "faster_whisper", "version": "1.2"}}, "input": "sha256:' || n || '", "model": {{"name": "base", "version": null}}, "parameters": ' || parameters || '}}') as k from sound)
  select n as req, case when reason is null then case when n % 3 = 0 then 'hit' else 'miss' end end as status, case when reason is null then k end as key, case when reason is null then n % 3 > 0 end as would_run, case when chunk is not null then 'level' end as cuts_from,
    case when chunk is not null and n % 11 > 0 then greatest(1, round_even(n_chars / 100 / chunk, 0))::bigint end as chunks, reason from j"""

SQL["transcripts_built"] = f"""with {SEGMENTS.lstrip()}, ends as (select doc, max(e) as duration from segments group by doc), marked as (select g.*, row_number() over (partition by g.doc order by g.seg) as place, g.e > g.s and seg % 4 <> 2 as stays, d.duration from segments g join ends d using (doc)),
    numbered_segments as (select *, sum(case when stays then 1 else 0 end) over (partition by doc order by seg) as k from marked),
    said as (select doc, -1 as place, 'language could not be detected with confidence; recorded as unknown' as t from ends where doc % 3 = 0 and doc % 2 = 0
      union all select doc, place * 4, printf('dropped zero-length segment at %.2f', s / 1000.0) from numbered_segments where not stays
      union all select doc, place * 4 + 3, printf('seg_%04d: word timestamps discarded (outside at %.2f)', k::bigint, s / 1000.0 + 500) from numbered_segments where stays and seg % 5 = 3)
  select g.doc, count(*) filter (stays) as segments, coalesce(sum(words) filter (stays and seg % 5 <> 3), 0)::bigint as words, coalesce(any_value(w.t), '') as warnings, md5(coalesce(string_agg(text, '|' order by seg) filter (stays), '')) as hash,
    case when g.doc % 3 > 0 then 'requested' when g.doc % 2 = 1 then 'detected' else 'unknown' end as language_source
  from numbered_segments g left join (select doc, string_agg(t, '|' order by place) as t from said group by doc) w on w.doc = g.doc group by g.doc"""
