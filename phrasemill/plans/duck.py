"""Oracle SQL for DuckDB, written independently of the DataFrame operators: shared expressions and a chain of CTEs."""

from __future__ import annotations

from phrasemill import fixtures
from phrasemill.functions import words as lists


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


LEX = "lex as (select * from (values " + ", ".join(f"('{w}', '{t}', '{e}')" for w, t, e in lists.LEXICON) + ") v(word, tag, ent))"
TAG_MAP = "map {" + ", ".join(f"'{w}': '{t}'" for w, t, _ in lists.LEXICON) + "}"
ENT_MAP = "map {" + ", ".join(f"'{w}': '{e}'" for w, _, e in lists.LEXICON) + "}"
PARAMS = "params as (select * from (values " + ", ".join(f"('{k}', {v}::double)" for k, v in lists.PARAMS) + ") v(key, value))"
RX = r"'(?i)^(.+,\s*.+?)\s*,?\s+and\s+(a|an|the)\s+(.+?)\s+of\s+(.+)$'"
RX_THE = r"'(?i)^(.+,\s*.+?)\s*,?\s+and\s+the\s+(.+?)\s+of\s+(.+)$'"


def tok(x: str) -> str:
    return rf"regexp_extract_all({x}, '(?:\p{{L}}\.)+|[\p{{L}}\p{{N}}]+(?:[''&-][\p{{L}}\p{{N}}]+)*|[^\p{{L}}\p{{N}}\s]')"


def tags(x: str) -> str:
    guess = r"case when regexp_full_match(w, '[^\p{L}\p{N}]') then 'PUNCT' when regexp_full_match(w, '\p{N}+') then 'NUM' when regexp_matches(lower(w), '(ous|ful|ive|able|ible|ish|less)$') then 'ADJ' when regexp_matches(lower(w), 'ly$') then 'ADV' else 'NOUN' end"
    return f"list_transform({tok(x)}, lambda w: coalesce({TAG_MAP}[lower(w)], {guess}))"


def ents(x: str) -> str:
    return f"list_transform({tok(x)}, lambda w: coalesce({ENT_MAP}[lower(w)], ''))"


def words(x: str) -> str:
    return rf"(case when trim({x}) = '' then []::varchar[] else string_split_regex(trim({x}), '\s+') end)"


def initials(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '\b([A-Z])\.\s+([A-Z])\.?', '\1.\2.', 'g'), '\b([A-Z])\.\s+([A-Z])\b', '\1.\2.', 'g'))"


def ending(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s*[/:;,.]\s*$', ''))"


def artifacts(x: str) -> str:
    return rf"regexp_matches({x}, '[¿�ÃÂÆ]|[^\x00-\x7FÀ-ɏ–—]')"


def truncated(x: str) -> str:
    return rf"(len({words(x)}) > 1 and regexp_matches({words(x)}[-1], '^\p{{Lu}}([^\p{{Lu}}])?$'))"


def weak(x: str) -> str:
    return f"(lower(trim({x})) in ({quoted((*lists.WEAK, *lists.JARGON))}) or list_has_any({words(f'lower({x})')}, [{quoted(lists.JARGON)}]))"


def shouts(x: str) -> str:
    return f"len(list_filter({words(x)}, lambda w: w = upper(w) and w <> lower(w) and length(w) >= 5)) > 0"


def clean(x: str) -> str:
    return f"({x} <> '' and not {artifacts(x)} and not {truncated(x)} and not {weak(x)})"


def action(x: str) -> str:
    head = f"{words(f'lower({x})')}[-1]"
    return f"(len({words(x)}) between 1 and 3 and not {shouts(x)} and ({head} in ({quoted(lists.ACTIONS)}) or regexp_matches({head}, '({'|'.join(lists.ACTION_ENDINGS)})$')))"


def _tagged(x: str) -> str:
    return f"list_filter(list_zip({tags(x)}, {tok(x)}), lambda z: not (z[1] = 'PUNCT' and z[2] = '-'))"


def _noun(x: str) -> str:
    return f"list_has_any({tags(x)}, ['NOUN', 'PROPN'])"


def item(x: str) -> str:
    return f"(len({words(x)}) between 1 and 3 and not regexp_matches({x}, '[0-9]{{4}}') and not {shouts(x)} and len(list_filter({_tagged(x)}, lambda z: z[1] not in ('NOUN', 'PROPN', 'ADJ'))) = 0 and {_noun(x)})"


def obj(x: str) -> str:
    return f"(len({words(x)}) between 1 and 5 and not regexp_matches({x}, '[0-9]{{4}}') and not {shouts(x)} and len(list_filter({_tagged(x)}, lambda z: z[1] in ('PUNCT', {quoted(lists.REJECTED_TAGS)}))) = 0 and {_noun(x)})"


CLEAN_RECORD = r"trim(regexp_replace(regexp_replace(trim(raw_subtitle), '\s*[/:;.]\s*$', ''), '\s+', ' ', 'g'))"
CLEAN_EDITION = r"regexp_replace(trim(regexp_replace(trim(raw_subtitle), '\s+', ' ', 'g')), '\s*[/:;.]\s*$', '')"

CHAIN = {
    "cleaned": rf"""select id, source_file, case when source_file = 'openlibrary' then trim(title) else trim(regexp_replace(title, '\s*[/:;.]\s*$', '')) end as title, lang, lccn, isbn, work_key, subtitle from (
        select *, case when source_file = 'openlibrary' then {CLEAN_EDITION} else {CLEAN_RECORD} end as subtitle from editions_raw
        where raw_subtitle <> '' and (case when source_file = 'openlibrary' then coalesce(lang = 'eng', false) else lang is null or lang in ('', 'eng') end)) c where length(subtitle) >= 5""",
    "merged": r"""select * from cleaned where source_file <> 'openlibrary' union all
        select id, source_file, title, lang, lccn, isbn, work_key, subtitle from (
          select *, row_number() over (partition by coalesce(nullif(work_key, ''), 'none' || id) order by id) as rn from cleaned e where source_file = 'openlibrary'
          and not exists (select 1 from cleaned r where r.source_file <> 'openlibrary' and r.lccn <> '' and e.lccn <> '' and regexp_replace(r.lccn, '[\s\-]', '', 'g') = regexp_replace(e.lccn, '[\s\-]', '', 'g'))
          and not exists (select 1 from cleaned r where r.source_file <> 'openlibrary' and r.isbn <> '' and r.isbn = e.isbn)) x where rn = 1""",
    "parts0": f"""select id, title, subtitle, {", ".join(f"regexp_extract(subtitle, {RX}, {k}) as p{k}" for k in range(1, 5))} from merged
        where (subtitle ilike '%, % and the % of %' or subtitle ilike '%, % and a % of %' or subtitle ilike '%, % and an % of %')
        and not (source_file = 'openlibrary' and coalesce(isbn, '') = '' and coalesce(lccn, '') = '')
        and not regexp_matches(lower(subtitle), '{"|".join(lists.NOISE)}') and regexp_matches(subtitle, {RX})""",
    "found": rf"""select id as subtitle_id, title, subtitle, list_filter(list_transform(string_split(p1, ','), lambda x: trim(x)), lambda x: x <> '') as list_items, trim(p3) as action_noun, lower(p2) as action_article,
        regexp_replace({ending("p4")}, '(?i)^(?:a|an|the)\s+', '') as of_object, lower(regexp_extract({ending("p4")}, '(?i)^(a|an|the)\s+', 1)) as of_article
        from parts0 where len(list_filter(list_transform(string_split(p1, ','), lambda x: trim(x)), lambda x: x <> '')) >= 2""",
    "norm": f"select subtitle_id, title, subtitle, {initials('action_noun')} as action_noun, {initials('of_object')} as of_object, action_article, of_article, list_transform(list_items, lambda q: {initials(ending('q'))}) as list_items from found",
    "items1": "select subtitle_id, generate_subscripts(list_items, 1) as pos, unnest(list_items) as x from norm",
    "items2": f"select subtitle_id, list(x order by pos) as list_items from items1 where {clean('x')} and {item('x')} group by subtitle_id having count(*) >= 2",
    "valid": f"select n.subtitle_id, n.title, n.subtitle, n.action_noun, n.of_object, n.action_article, n.of_article, i.list_items from norm n join items2 i using (subtitle_id) where {clean('action_noun')} and {action('action_noun')} and {clean('of_object')} and {obj('of_object')}",
    "occ": "select subtitle_id, 'list_item' as slot_type, unnest(list_items) as filler from valid union all select subtitle_id, 'action_noun', action_noun from valid union all select subtitle_id, 'of_object', of_object from valid",
    "pools": "select slot_type, filler, count(*) as freq, min(subtitle_id) as source_subtitle_id from occ group by all",
    "arts": "select slot_type, filler_lc, article, count(*) as n from (select 'of_object' as slot_type, lower(of_object) as filler_lc, of_article as article from valid union all select 'action_noun', lower(action_noun), action_article from valid) a group by all",
    "major": "select slot_type, filler_lc, article from (select *, sum(n) over (partition by slot_type, filler_lc) as total, row_number() over (partition by slot_type, filler_lc order by n desc, length(article) desc) as rn from arts) a where rn = 1 and total >= 1 and n * 2 > total",
    "tagged": f"select filler, freq, source_subtitle_id, {tok('filler')} as tok, {tags('filler')} as tags, {ents('filler')} as ents, len({words('filler')}) as wc from pools where slot_type = 'of_object'",
    "prepped": """select *, list_position(tags, 'ADP') as adp, len(tok) as n from tagged""",
    "halves": """select *, coalesce(adp, 0) > 0 and list_has_any(tags[1:adp - 1], ['NOUN', 'PROPN']) and list_has_any(tags[adp + 1:], ['NOUN', 'PROPN']) as is_prep,
        wc in (2, 3) and n > 1 and not list_contains(ents, 'PERSON') and tags[-1] in ('NOUN', 'PROPN') and not (wc = 2 and len(list_filter(ents, lambda e: e <> 'GPE')) = 0) and not (wc = 2 and len(list_filter(tags, lambda e: e <> 'NOUN')) = 0) as base,
        array_to_string(tok, ' ') = filler and tok[-1] not in ('I', 'II', 'III', 'IV', 'V') as plain from prepped""",
    "cut": """select *, case when is_prep then array_to_string(tok[1:adp - 1], ' ') end as topic, case when is_prep then array_to_string(tags[1:adp - 1], '+') end as topic_pos, case when is_prep then lower(tok[adp]) end as prep,
        case when is_prep then array_to_string(tok[adp + 1:], ' ') end as complement, case when is_prep then array_to_string(tags[adp + 1:], '+') end as complement_pos,
        case when not is_prep and base and plain then array_to_string(tok[1:n - 1], ' ') end as modifier, case when not is_prep and base and plain then array_to_string(tags[1:n - 1], '+') end as modifier_pos,
        case when not is_prep and base and plain then tok[-1] end as head, case when not is_prep and base and plain then tags[-1] end as head_pos,
        case when wc = 1 then null when coalesce(adp, 0) > 0 then 'type2' when base then 'type1' end as remix_type, case when wc > 1 and coalesce(adp, 0) > 0 then lower(tok[adp]) end as remix_prep from halves""",
    "subs": """select 'of_topic' as slot_type, topic as part, topic_pos as pos_tag, prep, freq, source_subtitle_id, filler from cut where topic is not null union all
        select 'of_complement', complement, complement_pos, prep, freq, source_subtitle_id, filler from cut where topic is not null union all
        select 'of_modifier', modifier, modifier_pos, null, freq, source_subtitle_id, filler from cut where modifier is not null union all
        select 'of_head', head, head_pos, null, freq, source_subtitle_id, filler from cut where modifier is not null""",
    "parts": "select slot_type, part as filler, pos_tag, prep, cast(total as bigint) as freq, source_subtitle_id from (select *, sum(freq) over w as total, row_number() over (w order by source_subtitle_id, filler) as rn from subs window w as (partition by slot_type, lower(part))) s where rn = 1",
}


def chain(query: str, views=("editions_raw",), more: str = "") -> str:
    """``query`` after the views, the lexicon and the whole chain."""
    own = ",\n".join(f"{n} as ({q})" for n, q in CHAIN.items())
    return fixtures.with_views(list(views), f", {LEX}, {PARAMS},\n{own}{', ' + more if more else ''}\n{query}")


def uniform(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 13))::bigint / 4503599627370496.0)"


def title(x: str) -> str:
    small = quoted(lists.SMALL_WORDS)
    return rf"""array_to_string(list_transform(string_split({x}, ' '), lambda v, i: case when (regexp_matches(v, '^.+\p{{Lu}}') and v <> upper(v)) or regexp_matches(v, '^\p{{Lu}}{{2,}}$|^(?:\p{{Lu}}\.)+$') then v
        when lower(v) in ({small}) and i > 1 and i < len(string_split({x}, ' ')) then lower(v) else upper(v[1]) || v[2:] end), ' ')"""


def a_or_an(article: str, following: str) -> str:
    w = rf"regexp_extract({following}, '^\S+')"
    an = rf"""case when regexp_matches({w}, '^\p{{Lu}}{{2,}}$|^(?:\p{{Lu}}\.)+$|^\p{{Lu}}$') then regexp_matches({w}, '^[AEFHILMNORSX]') when regexp_matches(lower({w}), '^({"|".join(lists.SILENT_H)})') then true
        when regexp_matches(lower({w}), '{lists.CONSONANT_SOUND}') then false else regexp_matches(lower({w}), '^[aeiou]') end"""
    return f"case when {article} in ('a', 'an') and {w} <> '' then case when {an} then 'an' else 'a' end else {article} end"


#: Of the samples of req_id, trial, seed, tone, remix_prob, min_sim and the locks lk_item1, lk_head, lk_object: CTEs ending in {p}_fin.
_GENERATED = r"""
{p}_slots as (select * from (values ('list_item'), ('action_noun'), ('of_object')) v(slot)),
{p}_tgt as (select tone, slot, avg(value) as target from (select tone, unnest(string_split(tone, ',')) as one from (select distinct tone from {p}_req where tone <> '') a) b, {p}_slots join params on key = 'tone_target_' || one || '_' || slot group by 1, 2),
{p}_fill as (select slot_type, filler, freq, case when length(filler) % 3 <> 0 then log10(1 + freq) / 2 end as popularity, null as prep from pools {where} union all select slot_type, filler, freq, null, prep from parts),
{p}_terms as (select q.trial, q.tone, v.slot, target, blend, missing, spread from (select distinct trial, tone from {p}_req) q join {p}_prm using (trial) cross join {p}_slots v left join {p}_tgt g on g.tone = q.tone and g.slot = v.slot),
{p}_pool as (select pool, filler, sum(freq) as freq, max(popularity) as popularity, sqrt(sum(freq)) as w from (select concat_ws('|', slot_type, case when slot_type = 'of_modifier' then cast(len({words}) as varchar) when slot_type in ('of_topic', 'of_complement') then prep end) as pool, filler, freq, popularity from {p}_fill) f group by 1, 2),
{p}_cum as (select *, sum(w) over (partition by pool order by filler) as hi, sum(w) over (partition by pool) as t from {p}_pool),
{p}_d as (select q.*, z.slot, z.slot as pool, target, blend, missing, spread from {p}_req q join {p}_terms z using (trial, tone)),
{one},
{p}_d2 as (select o.* exclude (filler, lo, w, t, k), o.filler as first, o.lo as first_lo, o.w as first_w from {p}_one o where slot = 'list_item'),
{two},
{p}_got as (select req_id, max(filler) filter (slot = 'list_item') as i1, max(filler) filter (slot = 'action_noun') as a, max(filler) filter (slot = 'of_object') as o from {p}_one group by 1),
{p}_drawn as (select r.*, coalesce(lk_item1, i1) as item1, case when lk_item1 is not null then case when i1 = lk_item1 then s.filler else i1 end else s.filler end as item2, a as action_noun, coalesce(lk_object, o) as of_object from {p}_req r left join {p}_got using (req_id) left join (select req_id, filler from {p}_two) s using (req_id)),
{p}_rx as (select d.*, lk_head is not null as locked, case when lk_head is not null then 'type1' else remix_type end as kind, case when remix_type = 'type1' then wc when lk_head is not null then 2 when remix_type is not null then wc end as words, case when lk_head is null and remix_type = 'type2' then remix_prep end as prep
  from {p}_drawn d left join cut on cut.filler = of_object where lk_object is null and (lk_head is not null or (len({object_words}) >= 2 and {gate} < remix_prob))),
{p}_try as (select *, unnest(range(1, case when locked then 21 else 6 end)) as attempt from {p}_rx where kind = 'type1' or (kind = 'type2' and prep is not null and prep <> 'of')),
{p}_pt as (select req_id, attempt, seed || '/' || attempt as seed, part as slot, trial, tone, case when kind = 'type1' then case when part = 'part1' then concat_ws('|', 'of_modifier', words - 1) else 'of_head' end when part = 'part1' then concat_ws('|', 'of_topic', prep) else concat_ws('|', 'of_complement', prep) end as pool,
  target, blend, missing, spread from {p}_try join (select * exclude (slot) from {p}_terms where slot = 'of_object') z using (trial, tone), (values ('part1'), ('part2')) v(part)),
{parts},
{p}_pick as (select req_id, attempt, max(filler) filter (slot = 'part1') as part1, max(filler) filter (slot = 'part2') as part2 from {p}_ptone group by 1, 2),
{p}_made as (select t.*, part1 as one, case when kind = 'type1' then coalesce(lk_head, part2) else part2 end as two from {p}_try t left join {p}_pick using (req_id, attempt)),
{p}_comp as (select *, case when kind = 'type1' then one || ' ' || two else one || ' ' || prep || ' ' || two end as composed from {p}_made where one is not null and two is not null),
{p}_sc as (select case when slot_type in ('of_modifier', 'of_head') then 'type1' else 'type2' end as kind, slot_type in ('of_modifier', 'of_topic') as first, filler, d, q from psc),
{p}_sim as (select c.*, case when (min_sim > 0 or locked) and x.q + y.q + 2 * sqrt(x.q) * sqrt(y.q) * k.mean_cosine > 0 then (x.d + y.d) / (sqrt(x.q + y.q + 2 * sqrt(x.q) * sqrt(y.q) * k.mean_cosine) * norm) end as sim
  from {p}_comp c left join {p}_sc x on x.kind = c.kind and x.first and x.filler = one left join {p}_sc y on y.kind = c.kind and not y.first and y.filler = two join rc k on k.kind = c.kind, cn where c.kind = 'type1' or locked or len({composed_words}) = words),
{p}_mix as (select * from (select *, row_number() over (partition by req_id order by case when passes then 0 else 1 end, case when passes then attempt end, sim desc nulls last, attempt) as rn from (select *, min_sim <= 0 or sim is null or sim >= min_sim as passes from {p}_sim) z where passes or locked) y where rn = 1),
{p}_best as (select slot_type, filler_lc, sum(n) as total, max(n) as n, arg_max(article, (n, length(article), article)) as article from arts group by 1, 2),
{p}_all as (select d.req_id, d.trial, d.tone, item1, item2, action_noun, coalesce(m.composed, d.of_object) as of_object, m.req_id is not null as remixed, m.kind, m.one, m.two, m.prep, m.sim from {p}_drawn d left join (select req_id, composed, kind, one, two, prep, sim from {p}_mix) m using (req_id)),
{p}_art as (select x.*, coalesce(case when {clear_w} then w.article end, case when {clear_z} then z.article end, '') as of0, coalesce(case when 2 * k.n > k.total and k.total >= 1 and k.article <> '' then k.article end, 'the') as act0
  from {p}_all x left join {p}_best w on w.slot_type = 'of_object' and w.filler_lc = lower(of_object) left join {p}_best z on z.slot_type = 'of_object' and z.filler_lc = lower(case when remixed then case when kind = 'type1' then two else one end when len({object_words}) > 1 then {object_words}[-1] end)
  left join {p}_best k on k.slot_type = 'action_noun' and k.filler_lc = lower(action_noun)),
{p}_raw as (select *, {act} as action_article, {of} as of_article from {p}_art),
{p}_txt as (select *, item1 || ', ' || item2 || ', and ' || action_article || ' ' || action_noun || ' of ' || case when of_article <> '' then of_article || ' ' else '' end || of_object as raw from {p}_raw),
{p}_fin as (select req_id, trial, tone, coalesce({title_raw}, '(not enough fillers)') as text, {titled}, remixed, kind, case when remixed then {title_one} end as one, prep as mid, case when remixed then {title_two} end as two, sim, of_article, action_article from {p}_txt)"""


#: Draws d -> one: tries from the shared pool, the first that is accepted, else one from the draw's own weights.
_BIAS = "case when d.target is null then 1 else 0.05 + 0.95 * exp(-pow(((1 - d.blend) * log10(1 + c.freq) + d.blend * coalesce(c.popularity, d.missing) - d.target) / d.spread, 2)) end"
_DRAWN = """{one}_try as (select *, unnest(range(1, case when target is null then 2 else 65 end)) as k from {d}),
{one}_at as (select y.*, t.total, {u} * (t.total - {taken}) as v from {one}_try y join (select pool, max(t) as total from {cum} group by 1) t using (pool)),
{one}_hit as (select d.* exclude (total, v), c.filler, c.hi - c.w as lo, c.w, c.t from {one}_at d join {cum} c on c.pool = d.pool and {v} >= c.hi - c.w and {v} < c.hi where {luck} < {bias}
  qualify row_number() over (partition by {key} order by k) = 1),
{one}_own as (select d.*, c.filler, c.hi - c.w as lo, c.w, c.t, sum(c.w * {bias}) over (partition by {key} order by c.filler) as own_hi, c.w * {bias} as own_w, sum(c.w * {bias}) over (partition by {key}) as own_t
  from (select * from {d} where ({key}) not in (select ({key}) from {one}_hit)) d join {cum} c on c.pool = d.pool {without}),
{one} as (select * from {one}_hit union all by name select * exclude (own_hi, own_w, own_t), 0 as k from {one}_own where {ux} * own_t >= own_hi - own_w and {ux} * own_t < own_hi)"""


def _drawn(p: str, d: str, one: str, key: str, number: int) -> str:
    letter, second = " ab"[number], number == 2
    u = uniform(f"seed || '|' || slot || '|{number}|{letter}' || case when k = 1 then '' else k::varchar end")
    moved = "(case when d.v >= d.first_lo then d.v + d.first_w else d.v end)" if second else "d.v"
    return _DRAWN.format(
        d=d, one=one, cum=f"{p}_cum", key=key, u=u, taken="first_w" if second else "0", v=moved, luck=uniform(f"seed || '|' || slot || '|{number}|accept' || k"), bias=_BIAS,
        without="and c.filler <> d.first" if second else "", ux=uniform(f"seed || '|' || slot || '|{number}|{letter}x'"),
    )


def generated(p: str) -> str:
    """CTEs named with the prefix ``p``, after those of ``chain``, from the tables {p}_req and {p}_prm (trial, blend, missing, spread)."""
    clear = lambda k: f"case when remixed then {k}.n >= 0.6 * {k}.total else 2 * {k}.n > {k}.total end and {k}.total >= 1 and {k}.article <> ''"
    titled = ", ".join(f"case when raw is not null then {title(c)} else '' end as {c}" for c in ("item1", "item2", "action_noun", "of_object"))
    return _GENERATED.format(
        p=p, where="", one=_drawn(p, f"{p}_d", f"{p}_one", "req_id, slot", 1), two=_drawn(p, f"{p}_d2", f"{p}_two", "req_id", 2), parts=_drawn(p, f"{p}_pt", f"{p}_ptone", "req_id, attempt, slot", 1), words=words("filler"), object_words=words("of_object"), composed_words=words("composed"), gate=uniform("seed || '|gate|0|'"),
        clear_w=clear("w"), clear_z=clear("z"), act=a_or_an("act0", "action_noun"), of=a_or_an("of0", "of_object"), title_raw=title("raw"), titled=titled, title_one=title("one"), title_two=title("two"),
    ).strip()


#: English sentences, their tokens, runs of tokens and templates, by gaps and islands.
TEMPLATES = rf""", sen as (select (doc_id, pos) as id, doc_id, pos, trim(s, ' ') as phrase from (select doc_id, generate_subscripts(x, 1) - 1 as pos, unnest(x) as s from (select doc_id, string_split_regex(text, '[.\n]') as x from documents where lang = 'en') d) e where trim(s, ' ') <> ''),
tk0 as (select id, phrase, {tok("phrase")} as t, {tags("phrase")} as g from sen),
tk1 as (select id, generate_subscripts(t, 1) as pos, unnest(t) as w, unnest(g) as g from tk0),
tk2 as (select *, (g = 'PUNCT' and w in ({quoted(lists.LITERAL_PUNCTUATION)})) as lp, lower(w) in ({quoted(lists.LITERALS)}) as lw from tk1),
tk3 as (select *, case when lp then w when lw then lower(w) else g end as p, not lp and not lw as open from tk2),
tk4 as (select *, case when open and coalesce(lag(open) over o, false) and lag(p) over o = p then 0 else 1 end as new from tk3 window o as (partition by id order by pos)),
tk5 as (select *, sum(new) over (partition by id order by pos) as run from tk4),
rn as (select id, run, any_value(p) as p, any_value(open) as open, count(*) as n, string_agg(w, ' ' order by pos) as words from tk5 group by id, run),
tpl as (select id, doc_id, pos, phrase, coalesce(template, '') as template, coalesce(slots, []) as slots from sen left join (select id, string_agg(p || case when n > 1 then '+' else '' end, ' ' order by run) as template, list(p || '|' || words || '|' || (n > 1) order by run) filter (open) as slots from rn group by id) r using (id))"""
