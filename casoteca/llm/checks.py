"""Check SQL of the queries of this subpackage that SQL can express; written apart from the operators."""

from __future__ import annotations


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))

#: kind, what comes before the body, the body, least length of the body (without a prefix: of the match).
_SECRETS = (
    ("assign", rf"""(?:{_KEYWORDS})["'']?\x20*[:=]\x20*["'']?""", r"[A-Za-z0-9+/_.=-]+", 8),
    ("access", "", "AKIA[A-Z0-9]+", 16),
    ("hex", "", "[0-9a-f]+", 32),
    ("private_key", "", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ("forge_token", "gh[pousr]_", "[A-Za-z0-9]+", 36),
    ("web_token", "", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)

# Between two matches lies a piece of the split text, so lengths of both add up to places.
_FOUND = " union all ".join(f"""
select row_id, {place} as place, '{kind}' as kind, base + length(piece) as start, base + length(piece) + length(hit) as stop
from (select row_id, piece, hit,
        coalesce(sum(length(piece) + length(hit)) over (partition by row_id order by i rows between unbounded preceding
                                                        and 1 preceding), 0) as base
      from (select row_id, unnest(hits) as hit, unnest(pieces[1:len(hits)]) as piece, unnest(range(len(hits))) as i
            from (select row_id, regexp_extract_all(text, '{head}{body}') as hits,
                         string_split_regex(text, '{head}{body}') as pieces from docs)))
where length(regexp_extract(hit, '(?:{head})({body})', 1)) >= {least}
""" for place, (kind, head, body, least) in enumerate(_SECRETS))

SECRETS = f"""
with docs as (select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents),
found as ({_FOUND}),
per_doc as (
  select row_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, place) filter (place < 3) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, place) as spans
  from found group by row_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join per_doc using (row_id)
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RANKED = f"""
with docs as (
  select row_number() over () as row_id, doc_id, regexp_extract_all({_LOWERED.format('text')}, '{_TERM}') as terms
  from documents),
used as (select row_id, doc_id, terms, len(terms)::bigint as n from docs where len(terms) > 0),
sizes as (select count(*)::bigint as total, sum(n)::bigint as words from used),
wanted as (select distinct item_id, unnest(regexp_extract_all({_LOWERED.format('text')}, '{_TERM}')) as term
           from benchmark),
occurrences as (select row_id, term, count(*)::bigint as tf from (select row_id, unnest(terms) as term from used)
                where term in (select term from wanted) group by row_id, term),
weights as (select term, floor(1000 * ln((2 * any_value(total) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
            from occurrences, sizes group by term),
scored as (
  select item_id, doc_id, row_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * total) // words))))::bigint as score
  from wanted join occurrences using (term) join weights using (term) join used using (row_id), sizes
  group by item_id, doc_id, row_id),
placed as (select *, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank
           from scored where score > 0)
select item_id, rank, doc_id, score from placed where rank <= 10
"""

_GRAMS = " union all ".join(
    f"select lang, {k} as words, array_to_string(list[i:i + {k - 1}], ' ') as phrase from "
    f"(select lang, list, unnest(range(1, len(list) - {k} + 2)) as i from pieces where len(list) >= {k})"
    for k in range(1, 6))

COLLOCATIONS = f"""
with pieces as (
  select lang, [x for x in string_split_regex(piece, '[\\x20\\x09]+') if x <> ''] as list
  from (select coalesce(lang, 'und') as lang,
               unnest(string_split_regex({_LOWERED.format('text')}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
totals as (select lang, sum(len(list))::bigint as n from pieces group by lang),
counted as (select lang, words, phrase, count(*)::bigint as f from ({_GRAMS}) group by lang, words, phrase
            having count(*) >= 100),
candidates as (select lang, words, phrase, f as a, string_split(phrase, ' ') as list from counted where words > 1),
cuts as (select lang, phrase, a, list, unnest(range(1, words)) as k from candidates),
halves as (
  select cuts.lang, cuts.phrase, a, k, one.f as l, other.f as r, n,
    (1000::hugeint * a * n) // (one.f::hugeint * other.f) as score
  from cuts join totals using (lang)
  join counted one on one.lang = cuts.lang and one.phrase = array_to_string(list[1:k], ' ')
  join counted other on other.lang = cuts.lang and other.phrase = array_to_string(list[k + 1:], ' ')),
lowest as (select * from halves qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, array_to_string(list[i:i + w - 1], ' ') as phrase, max(a) as longer
  from (select *, unnest(range(1, words - w + 2)) as i
        from (select *, unnest(range(2, words)) as w from candidates)) group by all),
kept as (select lowest.* from lowest left join inside using (lang, phrase)
         where longer is null or 100 * longer < 100 * a),
placed as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint as score from placed where rank <= 2000
"""
