"""DuckDB SQL of the operators that SQL can express at test size."""

from __future__ import annotations

from .hard_negatives import ORACLE as NEGATIVES
from .urls import ORACLE as URLS

WORDS = r"[^\x20\x09-\x0D]+"

SUBSTRINGS = f"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') as ws from documents
), windows as (
  select doc_id, i, array_to_string(ws[i:i + 34], ' ') as seq from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35)
), twice as (
  select seq from windows group by seq having count(*) > 1
), gone as (
  select distinct doc_id, unnest(range(i, i + 35)) as spot from windows semi join twice using (seq)
), kept as (
  select doc_id, string_agg(word, ' ' order by spot) as text, count(*) as n
  from (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as spot from w) anti join gone using (doc_id, spot) group by doc_id
)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept using (doc_id)
"""

JACCARD = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') as ws from documents
), shingles as (
  select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 4], ' ') end as s
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), meets as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all
), links as (
  select a, b from meets join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)
), reach(a, b) as (
  select doc_id, doc_id from w union select reach.a, links.b from reach join links on reach.b = links.a
)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, min(b) as component_id from w join reach on reach.a = w.doc_id left join sizes on sizes.doc_id = w.doc_id group by all
"""

ORACLES = {"op3_url_templates": URLS, "op6_jaccard_join": JACCARD, "op9_substrings": SUBSTRINGS, "op11_hard_negatives": NEGATIVES}


def _licenses() -> str:
    from .licenses import CUE, FILE_NAME, HEADER, MATCH, TEMPLATES, WHOLE

    values = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
    terms = r"regexp_extract_all(lower({0}), '[a-z]+|[0-9]+(?:\.[0-9]+)?')"
    return f"""
with files as (
  select doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/' || coalesce(doc_id::varchar, 'unknown') || '.txt' as path, text from documents
), cued as (
  select * from files where regexp_matches(text, '{CUE}')
), heads as (
  select distinct trim(unnest(regexp_extract_all(text, '{HEADER}', 1))) as header from cued
), units as (
  select doc_id, path, trim(unnest(string_split(text, chr(10)))) as header, false as entire from files
  union select doc_id, path, trim(unnest(regexp_extract_all(text, '{HEADER}', 1))), false from cued
  union select doc_id, path, text, true from files
), headers as (
  select * from units where header is not null
), different as (
  select distinct header from headers
), known as (
  select * from (values {values}) t(template, name, text)
), cterm as (
  select distinct header, unnest({terms.format("header")}) as term from heads
), hterm as (
  select header, term, count(*)::double as tf from (select header, unnest({terms.format("header")}) as term from different) group by all
), kterm as (
  select template, name, term, count(*)::double as tf from (select template, name, unnest({terms.format("text")}) as term from known) group by all
), idf as (
  select term, ln(((select count(*) from heads) + {len(TEMPLATES)} + 1)::double / (count(*)::double + 0.5::double)) as idf from (select term from cterm union all select term from kterm) group by term
), hw as (
  select header, term, tf * coalesce(idf, ln(((select count(*) from heads) + {len(TEMPLATES)} + 1)::double / 0.5::double)) as w from hterm left join idf using (term)
), kw as (
  select template, name, term, tf * idf as w from kterm join idf using (term)
), cosine as (
  select d.header, d.name, round(dot / (h.norm * k.norm), 6) as cosine from
    (select header, template, name, sum(hw.w * kw.w) as dot from hw join kw using (term) group by all) d
    join (select header, sqrt(sum(w * w)) as norm from hw group by header) h using (header)
    join (select template, sqrt(sum(w * w)) as norm from kw group by template) k using (template)
), best as (
  select header, cosine, name from (select *, row_number() over (partition by header order by cosine desc, name) as r from cosine) where r = 1 and cosine >= {MATCH}
), matched as (
  select * from headers join best using (header)
), top as (
  select doc_id, path, cosine, name, headers from (
    select doc_id, path, cosine, name, row_number() over w as r, count(*) over (partition by doc_id, path) as headers from matched where not entire
    window w as (partition by doc_id, path order by starts_with(name, 'LicenseRef'), cosine desc, name)) where r = 1
), granted as (
  select directory, name as granted from (
    select regexp_extract(path, '^(.*)/[^/]*$', 1) as directory, name, row_number() over (partition by regexp_extract(path, '^(.*)/[^/]*$', 1) order by starts_with(name, 'LicenseRef'), cosine desc, name) as r
    from matched where regexp_matches(path, '{FILE_NAME}') or entire and cosine >= {WHOLE}) where r = 1
), homes as (
  select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as home from files
), inherited as (
  select home, directory, granted from (
    select home, directory, granted, row_number() over (partition by home order by length(directory) desc) as r
    from homes join granted on home = directory or starts_with(home, directory || '/')) where r = 1
)
select f.doc_id, f.path, t.name as header_license, t.cosine as header_cosine, coalesce(t.headers, 0) as headers, coalesce(t.name, i.granted) as license,
  case when t.name is not null then 'header' when i.granted is not null then 'directory' else 'none' end as basis, case when t.name is null then i.directory end as from_directory
from files f left join top t on t.doc_id = f.doc_id and t.path = f.path left join inherited i on i.home = regexp_extract(f.path, '^(.*)/[^/]*$', 1)
"""


ORACLES["op10_licenses"] = _licenses()
