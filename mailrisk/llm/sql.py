"""The results in DuckDB SQL, for the operators that SQL can express."""

from mailrisk.llm import licenses, mixing

MIXING = f"""
with sized as (
  select doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size
  from documents),
by_source as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select source, source_size, (case (row_number() over (order by source nulls last) - 1) % 3
    when 0 then {mixing.WEIGHTS[0]} when 1 then {mixing.WEIGHTS[1]} else {mixing.WEIGHTS[2]} end)::double as w,
    source_size * {mixing.MOST}::double as cap
  from by_source),
summed as (
  select *, sum(source_size) over () * {mixing.SHARE}::double as whole, sum(w) over () as w_all,
    coalesce(sum(cap) over before, 0) as cap_before, coalesce(sum(w) over before, 0) as w_before
  from ranked
  window before as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
leveled as (
  select *, (whole - cap_before) / (w_all - w_before) as level from summed),
free as (select *, max(case when cap > level * w then level end) over () as final from leveled),
target as (
  select source, source_size, case when final is null then cap else least(cap, final * w) end as target from free),
lined as (
  select s.*, row_number() over (partition by source order by size, doc_id) as place from sized s),
placed as (
  select l.doc_id, l.size, t.source_size, t.target, l.place,
    case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(l.source, '')), 1, 8))::bigint / {float(1 << 32)} as shift
  from lined l join target t on l.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (least({int(mixing.MOST)}, floor(place * rate + shift) - floor((place - 1) * rate + shift))::bigint * size)::bigint as taken
from placed
"""

_TEMPLATES = ", ".join(
    f"({number}, '{name}', '{word}', {count})"
    for number, (name, bag) in enumerate(licenses.bags())
    for word, count in sorted(bag.items())
)

_PIVOTS = ", ".join(f"('{word}', {before}, {n})" for word, before, n in licenses.pivots())


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{licenses.WORDS}'), lambda w: w <> '')"


LICENCES = f"""
with template(number, licence, word, n) as (values {_TEMPLATES}),
longest(word, before, n) as (values {_PIVOTS}),
vocabulary as (select distinct word from template),
files as (
  select doc_id as file_id, text, coalesce(source, 'none') || case
    when doc_id % 256 = 0 then '/LICENSE'
    when doc_id % 64 = 0 then '/' || (doc_id // 64) || '/LICENSE'
    when doc_id % 16 = 0 then '/' || (doc_id // 64) || '/' || (doc_id // 16) || '/LICENSE'
    when doc_id % 4 = 0 then '/' || (doc_id // 64) || '/' || (doc_id // 16) || '/' || (doc_id // 4) || '/LICENSE'
    else '/' || (doc_id // 64) || '/' || (doc_id // 16) || '/' || (doc_id // 4) || '/' || doc_id || '.txt' end as path
  from documents),
lines as (select {_words("line")} as words from (select unnest(string_split(text, chr(10))) as line from files where text is not null)),
total as (select count(*) as n from lines),
seen as (select word, count(*) as df from (select unnest(list_distinct(words)) as word from lines) group by word),
idf as (
  select v.word, ln((1 + t.n) / (1 + coalesce(s.df, 0))::double) + 1 as idf
  from vocabulary v cross join total t left join seen s on s.word = v.word),
worded as (select file_id, text, {_words("text")} as words from files where text is not null),
parts as (
  select file_id, unnest(list_concat({", ".join(f"string_split_regex(text, '{cut}')" for cut in licenses.CUTS)})) as part from worded),
stretches as (
  select w.file_id, w.words[greatest(w.i - p.before, 1) : greatest(w.i - p.before, 1) + p.n - 1] as words
  from (select file_id, words, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from worded) w join longest p on p.word = w.word),
units as (
  select file_id, row_number() over () as nth, words from (
    select distinct file_id, words from (
      select file_id, {_words("part")} as words from parts
      union all select file_id, words from worded
      union all select file_id, words from stretches) where len(words) > 0)),
terms as (select file_id, nth, word, count(*) as tf from (select file_id, nth, unnest(words) as word from units) group by all),
weighted as (
  select t.file_id, t.nth, t.word, t.tf * coalesce(i.idf, ln((1 + n.n)::double) + 1) as weight
  from terms t cross join total n left join idf i on i.word = t.word),
norms as (select file_id, nth, sqrt(sum(weight * weight)) as norm from weighted group by all),
template_norms as (select number, sqrt(sum((n * idf) * (n * idf))) as norm from template join idf using (word) group by number),
scored as (
  select w.file_id, w.nth, t.licence, round(sum(w.weight * t.n * i.idf) / any_value(tn.norm) / any_value(m.norm), 6) as score
  from weighted w join template t on t.word = w.word join idf i on i.word = t.word
  join template_norms tn on tn.number = t.number join norms m on m.file_id = w.file_id and m.nth = w.nth
  group by w.file_id, w.nth, t.number, t.licence),
own as (
  select file_id, min(licence) as licence, max(score) as score
  from (select *, max(score) over (partition by file_id) as top from scored where score >= {licenses.LEAST}) where score = top
  group by file_id),
marked as (
  select f.file_id, f.path, regexp_replace(f.path, '/?[^/]*$', '') as dir, o.licence, o.score
  from files f left join own o on o.file_id = f.file_id),
grants as (
  select dir as above, arg_min(licence, (-score, licence)) as licence, max(score) as score
  from marked where licence is not null and path like '%LICENSE' group by dir),
climbed as (
  select m.file_id, g.licence, g.score,
    row_number() over (partition by m.file_id order by length(g.above) desc) as place
  from marked m join grants g on g.above = '' or m.dir = g.above or starts_with(m.dir, g.above || '/')
  where m.licence is null)
select m.file_id as doc_id, m.path, coalesce(m.licence, c.licence) as licence,
  case when m.licence is not null then 'own' when c.licence is not null then 'inherited' end as origin,
  coalesce(m.score, c.score) as score
from marked m left join climbed c on c.file_id = m.file_id and c.place = 1
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda s: ord(s)::bigint)"
    return f"xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], {codes}), lambda c, b: {bits}))"


URL_FILTER = f"""
with split as (
  select page_id, case when contains(url, '://') then url[strpos(url, '://') + 3:] else '' end as rest from pages),
parts as (
  select page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from split),
rules(host, path, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (
  select p.page_id, max_by(r.host || r.path, length(r.host || r.path)) as rule, max_by(r.verdict, length(r.host || r.path)) as verdict
  from parts p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
  group by p.page_id)
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from parts p left join fits f on f.page_id = p.page_id
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _merkle(name: str, leaves: str, levels: int = 8) -> str:
    """CTEs of a tree over ``leaves`` (``g, idx, node``), level by level: ``name``_paths and ``name``_top."""
    parts = [f"{name}_0 as (select *, count(*) over (partition by g) as n from {leaves})"]
    for k in range(1, levels + 1):
        parts.append(
            f"{name}_{k} as (select g, idx // 8 as idx, case when max(n) = 1 then max(node) else sha256(string_agg(node, '' order by idx)) end as node,"
            f" (max(n) + 7) // 8 as n from {name}_{k - 1} group by g, idx // 8)"
        )
    sides = []
    for k in range(levels):
        sides.append(
            f"select l.g, l.idx as leaf, {k} as level, coalesce(string_agg(b.node, '' order by b.idx) filter (b.idx < l.idx // {8**k}), '') as before,"
            f" coalesce(string_agg(b.node, '' order by b.idx) filter (b.idx > l.idx // {8**k}), '') as after"
            f" from {name}_0 l join {name}_{k} b on b.g = l.g and b.idx // 8 = l.idx // {8 ** (k + 1)} where b.n > 1 group by l.g, l.idx"
        )
    parts.append(f"{name}_sides as ({' union all '.join(sides)})")
    parts.append(
        f"{name}_paths as (select g, leaf as idx, list({{'before': before, 'after': after}} order by level) as path from {name}_sides group by g, leaf)"
    )
    parts.append(f"{name}_top as (select g, node from {name}_{levels})")
    return ",\n".join(parts)


MANIFEST = f"""
with marked as (
  select doc_id, coalesce('=' || lang, '') as g, {_leaf("text")} as leaf,
    case when {crc32("doc_id::varchar")} % 3 = 0 then {_leaf(_LOWER.format("text"))} else {_leaf("text")} end as changed
  from documents),
rows as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as idx from marked),
leaves as (select g, idx, leaf as node from rows),
{_merkle("tree", "leaves")},
heads as (select 0 as g, row_number() over (order by g) - 1 as idx, node, g as of from tree_top),
crown as (select g, idx, node from heads),
{_merkle("head", "crown", 3)},
joined as (
  select r.doc_id, r.leaf, r.changed, h.node as subroot, t.node as root, list_concat(coalesce(p.path, []), coalesce(q.path, [])) as path
  from rows r join heads h on h.of = r.g cross join head_top t
  left join tree_paths p on p.g = r.g and p.idx = r.idx left join head_paths q on q.idx = h.idx),
folded as (
  select *, sha256(coalesce(list_reduce(list_transform(path, lambda s: s.before || s.after), lambda a, b: a || b, ''), '')) as proof_sha256,
    list_reduce(list_concat([{{'before': changed, 'after': ''}}], path), lambda a, s: {{'before': sha256(s.before || a.before || s.after), 'after': ''}}).before as folded_root
  from joined)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folded
"""

_INSERTS = {"s0": [], "s1": [], "s2": ["s0", "s1", "s3"], "s3": ["s2"]}


def _spent(state: str, cost: int, letter: str = "") -> str:
    """A state's ``cost`` and letters as one text that sorts by cost, then by letters; null where it cannot be reached."""
    return f"(lpad(((left({state}, 12))::bigint + {cost})::varchar, 12, '0') || substr({state}, 13) || '{letter}')"


def _least(*options: str) -> str:
    return f"least({', '.join(options)})"


def _inserted(prefix: str) -> dict[str, str]:
    """The states after any insertions that can pay."""
    s = {k: f"{prefix}.{k}" for k in _INSERTS}
    user = _least(s["s2"], *[_spent(s[k], 3, "I") for k in ("s0", "s1", "s3")])
    # an assistant turn follows the user turn, of which two in a row cost six
    assistant = _least(s["s3"], _spent(s["s2"], 3, "I"), *[_spent(s[k], 6, "II") for k in ("s0", "s1")])
    return {"s0": s["s0"], "s1": s["s1"], "s2": user, "s3": assistant}


def _turn() -> dict[str, str]:
    def paid(state, cost, letter):
        return f"case when t.fault = 'truncated' then {_spent(state, cost + 3, letter)} else {_spent(state, cost, letter)} end"

    def kept(state, initial):
        return f"case when t.ok and t.initial = '{initial}' then {paid(state, 0, 'K')} end"

    def changed(state):
        return f"case when t.ok then {paid(state, 3, 'R')} end"

    def dropped(state):
        return _spent(state, 4, "D")

    ahead = ("i.s0", "i.s1", "i.s3")
    return {
        "s0": dropped("i.s0"),
        "s1": _least(dropped("i.s1"), kept("i.s0", "s")),
        "s2": _least(dropped("i.s2"), *[kept(s, "u") for s in ahead], *[changed(s) for s in ahead]),
        "s3": _least(dropped("i.s3"), kept("i.s2", "a"), changed("i.s2")),
    }


def _states(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} as {name}" for name, sql in columns.items())


_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

CONVERSATIONS = f"""
with recursive drawn as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc32("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as draw
  from conversations),
hurt as (
  select conv_id, turn, case when draw = 4 then 'user' else role end as role,
    case when draw = 1 then '' when draw = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when draw = 3 then [0, 1] else [0] end) as copy
  from drawn where draw <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(length(role) || ':' || role || text), copy) as place from hurt),
marked as (
  select *, left(role, 1) as initial, right(rtrim(text, {_BLANK}), 1) as ending,
    row_number() over (partition by conv_id, role, text order by place) > 1 as again,
    lag(left(role, 1)) over (partition by conv_id order by place) as previous
  from placed),
turns as (
  select *, coalesce(conv_id::varchar, '') as ck, fault not in ('blank', 'duplicate') as ok from (
    select *, case when ending = '' then 'blank' when again then 'duplicate' when ending not in ('.', '!', '?') then 'truncated' else '' end as fault
    from marked)),
walked as (
  select distinct ck, 0::bigint as place, repeat('0', 12) as s0, null::varchar as s1, null::varchar as s2, null::varchar as s3 from turns
  union all
  select t.ck, t.place, {_states(_turn())}
  from (select w.ck, w.place, {_states(_inserted("w"))} from walked w) i join turns t on t.ck = i.ck and t.place = i.place + 1),
ended as (
  select i.ck, least(i.s0, i.s3) as best
  from (select w.ck, w.place, {_states(_inserted("w"))} from walked w) i
  join (select ck, max(place) as place from turns group by ck) l on l.ck = i.ck and l.place = i.place),
audited as (select ck, left(best, 12)::bigint as cost, substr(best, 13) as audit from ended),
letters as (select ck, unnest(string_split(audit, '')) as letter, unnest(range(1, length(audit) + 1)) as nth from audited where audit <> ''),
counted as (
  select *, sum((letter <> 'I')::int) over w as place, sum((letter <> 'D')::int) over w as put
  from letters window w as (partition by ck order by nth)),
made as (
  select c.ck, c.nth, c.letter, c.put, t.role, t.text,
    max((c.put = 1 and c.letter = 'K' and t.initial = 's')::int) over (partition by c.ck) as led
  from counted c left join turns t on t.ck = c.ck and t.place = c.place and c.letter <> 'I'),
repaired as (
  select ck, string_agg(case when letter = 'K' then role when (put - led) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by nth) as whole
  from made where letter <> 'D' group by ck),
faults as (
  select ck, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (previous is not null and previous || initial not in ('su', 'ua', 'au')) as illegal
  from turns group by ck)
select o.conv_id, coalesce(f.gaps, 0)::bigint as gaps, coalesce(f.blank, 0)::bigint as blank, coalesce(f.duplicate, 0)::bigint as duplicate,
  coalesce(f.truncated, 0)::bigint as truncated, coalesce(f.illegal, 0)::bigint as illegal, coalesce(a.cost, 0)::bigint as cost,
  coalesce(a.audit, '') as audit, sha256(coalesce(r.whole, '')) as repaired_sha256
from (select distinct conv_id, coalesce(conv_id::varchar, '') as ck from conversations) o
left join faults f on f.ck = o.ck left join audited a on a.ck = o.ck left join repaired r on r.ck = o.ck
"""
