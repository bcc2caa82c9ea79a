"""SQL counterparts of those queries that SQL can express on whole tables.

The others learn (3, 4, 5, 7), hash or follow links by rules that SQL lacks (1, 9, 10), run a tokenizer (6, 13), or
choose windows in turn (2); the tests hold them against brute force, round trips or held-out accuracy.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

_CONTAMINATION = f"""
    with items as (select item_id, {_WORDS} as ws from benchmark),
    docs as (select doc_id, {_WORDS} as ws from documents),
    needles as (
      select distinct cast(item_id as varchar) as item, least(len(ws), 13) as width, array_to_string(ws[pos : pos + least(len(ws), 13) - 1], ' ') as win
      from (select item_id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) as pos from items where len(ws) > 0) i),
    widths as (select distinct width from needles),
    places as (
      select doc_id, width, pos, array_to_string(ws[pos : pos + width - 1], ' ') as win
      from (select doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) as pos from docs, widths where len(ws) >= width) d),
    hits as (select doc_id, p.width, pos, item from places p join needles n on p.win = n.win and p.width = n.width),
    covered as (select doc_id, count(distinct word) as n_hit
      from (select doc_id, unnest(range(pos, pos + width)) as word from (select distinct doc_id, width, pos from hits) h) c group by doc_id),
    named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
      from (select distinct doc_id, item from hits) h group by doc_id)
    select d.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
      coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
    from docs d left join covered c on d.doc_id = c.doc_id left join named n on d.doc_id = n.doc_id"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

_SEARCH = f"""
    with docs as (select doc_id, {_TERMS} as ws from documents),
    sized as (select doc_id, ws, cast(len(ws) as bigint) as n from docs where len(ws) > 0),
    whole as (select cast(count(*) as bigint) as nn, cast(sum(n) as bigint) as ll from sized),
    places as (select doc_id, n, term, cast(count(*) as bigint) as tf from (select doc_id, n, unnest(ws) as term from sized) w group by doc_id, n, term),
    weights as (select term, cast(floor(1000 * ln(cast(2 * nn + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w
      from (select term, count(*) as df from places group by term) f, whole),
    asked as (select distinct item_id, term from (select item_id, unnest({_TERMS}) as term from benchmark) b),
    scored as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) as bigint) as score
      from asked a join places p on a.term = p.term join weights x on a.term = x.term, whole group by item_id, doc_id)
    select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
    from scored where score > 0 qualify rank <= 10"""

_NEGATIVES = """
    with given as (select row_number() over () as pos, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as q
      from embeddings where label is not null and embedding is not null
        and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    scored as (select a.pos as a_pos, a.vec_id as anchor_id, b.pos, b.vec_id, a.label = b.label as same,
        cast(list_sum([a.q[k] * b.q[k] for k in range(1, len(a.q) + 1)]) as bigint) as score
      from given a join given b on a.pos <> b.pos where a.vec_id % 50 = 0),
    near as (select * from scored where same qualify row_number() over (partition by a_pos order by score desc, vec_id) <= 5)
    select n.anchor_id, n.vec_id as positive_id, cast(row_number() over (partition by n.a_pos, n.pos order by h.score desc, h.vec_id) as int) as rank,
      h.vec_id as negative_id, n.score as positive_score, h.score as negative_score
    from near n join scored h on n.a_pos = h.a_pos and not h.same and 50 * n.score <= 100 * h.score and 100 * h.score <= 95 * n.score
    qualify rank <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op8_decontamination": _CONTAMINATION, "op11_lexical_search": _SEARCH, "op12_hard_negatives": _NEGATIVES}
