"""DuckDB SQL for the operators of this subpackage that SQL can express."""

from __future__ import annotations

from .quality_rules import COVERAGE_LIMITS, LEAST_WORDS, LINE_LIMIT, REPEAT_PERCENT, SYMBOL_LIMIT

_WORD = r"[^\x20\x09-\x0D]+"


def quality_rules_sql() -> str:
    ctes, sums, joins, rules = [], [], [], []
    for n, limit in COVERAGE_LIMITS.items():
        gram = " || ' ' || ".join(["word", *[f"lead(word, {k}) over p" for k in range(1, n)]])
        ctes.append(f"""g{n} as (select doc_id, i, word, {gram} as g from tok window p as (partition by doc_id order by i)),
        d{n} as (select doc_id, i, word, (g is not null and count(*) over (partition by doc_id, g) > 1)::int as d from g{n}),
        c{n} as (select doc_id, word, max(d) over (partition by doc_id order by i rows between {n - 1} preceding and current row) as c from d{n}),
        s{n} as (select doc_id, sum(length(word) * c)::bigint as chars, sum(c)::bigint as words from c{n} group by doc_id)""")
        sums.append(f"coalesce(s{n}.chars, 0) as dup_chars_{n}")
        joins.append(f"left join s{n} using (doc_id)")
        rules.append(f"dup_chars_{n} * 1000 <= {round(1000 * limit)} * word_chars")
    return f"""
    with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
    tok as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
    lines as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from w),
    seen as (select doc_id, line, row_number() over (partition by doc_id, line order by i) > 1 as again from lines where regexp_matches(line, '{_WORD}')),
    ln as (select doc_id, sum(again::int)::bigint as n_dup_lines, sum(case when again then length(line) else 0 end)::bigint as dup_line_chars, sum(length(line))::bigint as line_chars from seen group by doc_id),
    {", ".join(ctes)},
    m as (select doc_id, len(ws) as n_words, length(array_to_string(ws, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(s5.words, 0) as n_repeat_words, coalesce(dup_line_chars, 0) as dup_line_chars, coalesce(line_chars, 0) as line_chars, {", ".join(sums)}
        from w left join ln using (doc_id) {" ".join(joins)}),
    b as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed from m)
    select *, not base_failed and {" and ".join(rules)} and dup_line_chars * 1000 <= {round(1000 * LINE_LIMIT)} * line_chars and n_symbols * 1000 <= {round(1000 * SYMBOL_LIMIT)} * word_chars as kept from b"""


NEAR_DUPLICATES = f"""
    with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as ws from documents),
    tok as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
    g as (select doc_id, word || ' ' || lead(word, 1) over p || ' ' || lead(word, 2) over p || ' ' || lead(word, 3) over p || ' ' || lead(word, 4) over p as s from tok window p as (partition by doc_id order by i)),
    sh as (select distinct doc_id, s from g where s is not null union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 4),
    n as (select doc_id, count(*) as n from sh group by doc_id),
    pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
    link as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
    edge as (select a, b from link union all select b, a from link),
    reach as (select doc_id as a, doc_id as b from documents union select r.a, e.b from reach r join edge e on r.b = e.a)
    select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
    from documents d left join n using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by a) c using (doc_id)"""


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Every round as two tables: the nearest entry of each part by all distances, and the means."""
    near = """(select vec_id, n, part, idx, pos, x, dist from (
        select v.vec_id, v.n, v.part, b.idx, sum((v.x - b.x) * (v.x - b.x)) as dist from v join b{r} b using (part, pos) group by v.vec_id, v.n, v.part, b.idx
        qualify row_number() over (partition by v.n, v.part order by dist, b.idx) = 1) join v using (vec_id, n, part))"""
    steps = []
    for r in range(rounds):
        steps.append(f"""b{r + 1} as materialized (select b.part, b.idx, b.pos, coalesce(m.x, b.x) as x from b{r} b left join (
            select part, idx, pos, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::hugeint as x from {near.format(r=r)} group by all) m using (part, idx, pos))""")
    return f"""
    with k as (select vec_id, label, row_number() over (order by vec_id) as n, list_transform(embedding, lambda x : floor({scale} * x::double)::hugeint) as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x : x is null or not isfinite(x))) = 0),
    v as materialized (select vec_id, n, (i - 1) // (len(v) // {parts}) as part, (i - 1) % (len(v) // {parts}) as pos, v[i] as x from (select *, unnest(range(1, len(v) + 1)) as i from k)),
    b0 as materialized (select part, n - 1 as idx, pos, x from v where n <= {entries}),
    {", ".join(steps)},
    z as materialized (select distinct n, part, idx, dist from {near.format(r=rounds)}),
    c as (select n, string_agg(printf('%02x', idx::int), '' order by part) as code, sum(dist)::bigint as error from z group by n),
    s as (select sha256(string_agg(x::varchar, ',' order by part, idx, pos)) as h from b{rounds})
    select k.vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from k join c using (n), s"""


_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def divergence_sql(least_docs: int = 30, smoothing: int = 5, top: int = 50) -> str:
    share = "1 + (1000000000::hugeint * (coalesce(c, 0) + {s})) // (n + {s}::hugeint * v)".format(s=smoothing)
    return f"""
    with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') as ts from documents),
    t as (select i, lang, source, unnest(ts) as term from d),
    kept as materialized (select lang, term from t group by lang, term having count(distinct i) >= {least_docs}),
    g as materialized (select distinct lang, source from d),
    v as (select lang, count(*) as v from kept group by lang),
    c as materialized (select lang, source, term, count(*)::hugeint as c from t semi join kept using (lang, term) group by all),
    n as (select g.lang, g.source, coalesce(sum(c), 0)::hugeint as n from g left join c using (lang, source) group by all),
    p as materialized (select n.lang, n.source, k.term, coalesce(c, 0) as c, ({share})::bigint as p from n join kept k using (lang) join v using (lang) left join c using (lang, source, term)),
    q as (select lang, term, ({share})::bigint as q from (select lang, term, sum(c) as c from c group by all) join (select lang, sum(n) as n from n group by lang) using (lang) join v using (lang)),
    pairs as (select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
        left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
    terms as (select lang, source, term as item, p - q as value from p join q using (lang, term) where c > 0 and p > q),
    r as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from terms)
    select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from r
    qualify part = 'pair' or rank <= {top}"""


ORACLES = {"op11_source_divergence": divergence_sql(), "op12_vector_codes": vector_codes_sql(), "op7_quality_rules": quality_rules_sql(), "op10_minhash_near_dedup": NEAR_DUPLICATES}
