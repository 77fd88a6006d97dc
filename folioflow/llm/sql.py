"""The same results in SQL of another engine, where SQL can express them."""

_SPACE = r"[^\x20\x09-\x0D]+"

OP4 = r"""
with words as (
  select row_number() over () as row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
item_windows as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0)),
lengths as (select distinct n from item_windows),
doc_windows as (
  select row, n, i, array_to_string(w[i : i + n - 1], ' ') as win
  from (select row, w, n, unnest(range(1, len(w) - n + 2)) as i from words, lengths where len(w) >= n)),
found as (select row, i, n, item_id from doc_windows join item_windows using (n, win)),
hit as (select row, count(distinct k) as n_hit from (select row, unnest(range(i, i + n)) as k from (select distinct row, i, n from found)) group by row),
hit_items as (
  select row, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct row, item_id::varchar as id from found) group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (row) left join hit_items using (row)
"""

OP10 = r"""
with recursive sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint as u
  from documents),
source_words as (
  select source, sum(size)::bigint as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight
  from sized group by source),
total as (select sum(source_size) as words from source_words),
-- Sources above three times their size are fixed there, round by round; the rest is shared again.
rounds as (
  select 0 as round, source, source_size, weight, null::double as fixed from source_words
  union all
  select round + 1, source, source_size, weight,
    case when fixed is not null then fixed
         when (words - coalesce(sum(fixed) over (), 0)) * weight / sum(case when fixed is null then weight end) over ()
              > 3 * source_size then 3.0 * source_size end
  from rounds, total where round < 40),
goals as (
  select source, source_size, coalesce(fixed, (words - coalesce(sum(fixed) over (), 0)) * weight
    / sum(case when fixed is null then weight end) over ())::double as target
  from rounds, total where round = 40),
parts as (
  select *, case when source_size > 0 then least(round_even(target, 0)::bigint, 3 * source_size) // source_size else 0 end as passes,
    case when source_size > 0 then least(round_even(target, 0)::bigint, 3 * source_size) % source_size else 0 end as need
  from goals),
places as (
  select source, u, sum(size) as size, sum(sum(size)) over (partition by source order by u) - sum(size) as before
  from sized group by source, u),
chosen as (
  select p.source, u, 2 * before + p.size <= 2 * need and need > 0 and (before < need or p.size = 0) as more
  from places p join parts q on p.source is not distinct from q.source)
select doc_id, size, source_size, target, size * (passes + case when more then 1 else 0 end) as taken
from sized s join parts q on s.source is not distinct from q.source
  join chosen c on s.source is not distinct from c.source and s.u = c.u
"""

OP9 = r"""
with payloads as (
  select page_id, sha256(coalesce(html, '')) as digest, strlen(coalesce(html, ''))::bigint as bytes from pages),
firsts as (
  select digest, min(page_id) as first, count(*) as n from payloads where bytes >= 100 group by digest)
select page_id, bytes as payload_bytes, p.digest as payload_digest,
  case when n > 1 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when n > 1 and page_id <> first then first end as refers_to
from payloads p left join firsts f on p.digest = f.digest
"""


def _any_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


# kind, rank, pattern, group of the value, least length.
_KINDS = (
    ("assign", 0, f"({_any_case('password|passwd|secret|token|api_?key')})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", 1, "AKIA[A-Z0-9]+", 0, 18),
    ("hex", 2, "[0-9a-f]+", 0, 16),
    ("opaque", 3, "[A-Za-z0-9+/_-]{24,}", 0, 24),
)


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return f"""
select * from (
  select row, source, '{kind}' as kind, {rank} as rank, vals[i] as value,
    list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(wholes[1 : i - 1], lambda x: length(x))), 0) as start,
    list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + list_sum(list_transform(wholes[1 : i], lambda x: length(x))) as stop
  from (select row, source, gaps, wholes, vals, unnest(range(1, len(wholes) + 1)) as i
        from (select row, source, string_split_regex(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}', 0) as wholes,
                regexp_extract_all(text, '{pattern}', {group}) as vals from docs)))
where length(value) >= {least}"""


OP1 = f"""
with docs as (select row_number() over () as row, doc_id, coalesce(source, '') as source, coalesce(text, '') as text from documents),
matched as ({" union all ".join(_spans(*k) for k in _KINDS)}),
apart as (
  select * from matched m
  where rank < 3 or (regexp_matches(value, '[0-9]') and regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]')
    and not exists (select 1 from matched b where b.row = m.row and b.rank < 3 and b.start < m.stop and m.start < b.stop))),
counts as (select value, count(distinct row) as n_repos, count(distinct source) as n_owners from apart group by value),
told as (
  select *, n_owners >= 3 or n_repos >= 10 as copied,
    n_owners = 1 and n_repos < 10 and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')
      and len(list_distinct(string_split(value, ''))) >= 8 as live
  from apart join counts using (value)),
shown as (select *, kind || ':' || start || ':' || stop as line from told where rank < 3 or live),
per_row as (
  select row, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex, string_agg(line, ',' order by start, rank) filter (rank < 3) as base,
    string_agg(line, ',' order by start, rank) as spans, count(*) filter (copied) as n_copied, count(*) filter (live) as n_live
  from shown group by row)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_copied, 0)::bigint as n_copied, coalesce(n_live, 0)::bigint as n_live
from docs left join per_row using (row)
"""

OP11 = r"""
with docs as (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
each as (
  select row, i, lines[i] as line,
    trim(translate(lines[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key
  from (select row, lines, unnest(range(1, len(lines) + 1)) as i from docs)),
common as (select key from each where key <> '' group by key having count(distinct row) >= 10),
kept as (
  select row, count(common.key) as n_dropped, string_agg(line, chr(10) order by i) filter (common.key is null) as text
  from each left join common using (key) group by row)
select doc_id, len(lines)::bigint as n_lines, n_dropped::bigint as n_dropped, sha256(coalesce(text, '')) as kept_sha256
from docs join kept using (row)
"""

OP12 = r"""
with clean as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from clean a join clean b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (
  select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank,
    vec_id as negative_id, positive_score, score as negative_score
  from positives join scored using (anchor_id)
  where not same and 80 * positive_score <= 100 * score and score <= positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from ranked where rank <= 5
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"


def _levels(name: str, n: int) -> str:
    """Levels 0 to n of a tree over (g, k, n, node), and the siblings before and after each node of a level."""
    parts = []
    for i in range(n):
        parts.append(f"""
{name}{i}_around as (
  select a.g, a.k, coalesce(string_agg(b.node, '' order by b.k) filter (b.k < a.k), '') as before,
    coalesce(string_agg(b.node, '' order by b.k) filter (b.k > a.k), '') as after
  from {name}{i} a join {name}{i} b on a.g = b.g and a.k // 16 = b.k // 16 where a.n > 1 group by a.g, a.k),
{name}{i + 1} as (
  select g, k // 16 as k, (n + 15) // 16 as n, sha256(string_agg(node, '' order by k)) as node
  from {name}{i} where n > 1 group by g, k // 16, (n + 15) // 16
  union all select g, k, n, node from {name}{i} where n = 1),""")
    return "".join(parts)


def _fold(name: str, n: int, rows: str, key: str, place: str, proof: str, node: str, out: str) -> str:
    """Rows with their siblings appended to ``proof`` and ``node`` folded, level by level."""
    parts = []
    for i in range(n):
        source = rows if i == 0 else f"{out}{i - 1}"
        parts.append(f"""
{out}{i} as (
  select r.* replace ({proof} || coalesce(before || after, '') as {proof},
    case when before is null then {node} else sha256(before || {node} || after) end as {node})
  from {source} r left join {name}{i}_around a on a.g = r.{key} and a.k = r.{place} // {16**i}),""")
    return "".join(parts)


_LEVELS, _SOURCE_LEVELS = 8, 4
OP13 = f"""
with crc as (
  select row, list_reduce(
    flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: case when x >= 0 then xor(c, x) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, 4294967295::bigint) as state
  from (select row_number() over () as row, doc_id from documents)),
rows as (
  select row_number() over () as row, doc_id, case when source is null then '0' else '1' || source end as g, {_leaf("text")} as leaf,
    {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as changed
  from documents),
leaves as (
  select doc_id, g, leaf, case when xor(state, 4294967295) % 5 = 0 then changed else leaf end as folded, '' as proof,
    row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as k, count(*) over (partition by g) as n
  from rows left join crc using (row)),
t0 as (select g, k, n, leaf as node from leaves),{_levels("t", _LEVELS)}
s0 as (select 'all' as g, row_number() over (order by g) - 1 as k, count(*) over () as n, node, g as source from t{_LEVELS}),
s0_names as (select source, k as place, node as subroot from s0),
u0 as (select g, k, n, node from s0),{_levels("u", _SOURCE_LEVELS)}{_fold("t", _LEVELS, "leaves", "g", "k", "proof", "folded", "f")}
placed as (select f.*, 'all' as every, place, subroot from f{_LEVELS - 1} f join s0_names on source = f.g),{_fold("u", _SOURCE_LEVELS, "placed", "every", "place", "proof", "folded", "v")}
root as (select node as root from u{_SOURCE_LEVELS})
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified from v{_SOURCE_LEVELS - 1}, root
"""

SQL: dict[str, str] = {
    "op1_secret_ownership": OP1,
    "op4_decontaminate": OP4,
    "op9_warc": OP9,
    "op10_mix": OP10,
    "op11_line_dedup": OP11,
    "op12_hard_negatives": OP12,
    "op13_merkle": OP13,
}
