"""The same results as SQL for DuckDB, where SQL can express the operator over whole tables."""

from codexmill.llm.one_form import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS, HARD_SPACES

TOKENS = """
with cur as (select chunk_id, terms from (select *, row_number() over (partition by chunk_id order by analyzed_at desc) rn from tokens where chunk_id is not null) where rn = 1),
t as (select chunk_id, lower(trim(x.term)) term from (select chunk_id, unnest(terms) x from cur) where x.term is not null),
counts as (select term, cast(count(*) as bigint) occurrences, cast(count(distinct chunk_id) as bigint) chunks from t where length(term) between 2 and 40 group by term)
"""
CHUNKS = "cur as (select * from (select *, row_number() over (partition by chunk_id order by written_at desc, text) rn from chunks where chunk_id is not null) where rn = 1)"
LEAKS = """
with it as (select item_id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', ' ', 'g')), ' ') w from eval_items where text is not null),
dw as (select doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', ' ', 'g')), ' ') w from documents where text is not null),
ig as (select item_id, i - 1 q, array_to_string(list_slice(w, i, i + 11), ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) i from it)),
dg as (select doc_id, i - 1 p, array_to_string(list_slice(w, i, i + 11), ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) i from dw)),
met as (select doc_id, item_id, p, q from dg join ig using (g))
"""

ORACLE = {
    "p1_term_counts": TOKENS + "select term, occurrences, chunks from counts",
    "p1_found": TOKENS
    + """select term, mark from (select term, case when chunks < 3 then 'rare' when chunks > 0.28 * (select count(distinct chunk_id) from tokens) then 'common' end mark from counts) where mark is not null""",
    "p2_found": f"""with {CHUNKS} select c.chunk_id from cur c left join chunk_opts o on c.collection = o.collection
        where length(c.text) > case when o.chars > 0 then o.chars else (select chars from chunk_opts where collection = 'default') end""",
    "p9_found": LEAKS + "select distinct doc_id, item_id from met",
    "p9_clean": LEAKS + "select doc_id from documents where doc_id not in (select doc_id from met)",
    "p9_spans": LEAKS
    + """select doc_id, item_id, cast(count(*) + 11 as bigint) words, cast(min(p) as bigint) doc_word, cast(min(q) as bigint) item_word
        from (select *, p - row_number() over (partition by doc_id, item_id, p - q order by p) island from met) group by doc_id, item_id, p - q, island""",
}

PAIRS = """
size as (select id, count(*) n from el group by id),
met as (select x.id a, y.id b, count(*) both_ from el x join el y on x.e = y.e and x.id < y.id group by x.id, y.id)
"""
BOOK_PAIRS = f"""with cur as (select id, title, author from (select *, row_number() over (partition by path order by seq desc) rn from books where path is not null) where rn = 1 and id is not null and title <> ''),
t as (select id, trim(regexp_replace(lower(title || ' ' || coalesce(author, '')), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')) t from cur),
el as (select distinct id, substring(t, i, 3) e from (select id, t, unnest(range(1, length(t) - 1)) i from t)), {PAIRS}
select 'book' kind, a id_a, b id_b from met join size x on x.id = a join size y on y.id = b where 10 * both_ >= 7 * (x.n + y.n - both_)"""
CHUNK_PAIRS = f"""with {CHUNKS},
t as (select chunk_id id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{Nd}} \\t\\n]+', '', 'g'), '[ \\t\\n]+'), lambda w: w <> '') w from cur where text is not null),
el0 as (select distinct id, array_to_string(list_slice(w, i, i + 2), ' ') e from (select id, w, unnest(range(1, len(w) - 1)) i from t)),
el as (select * from el0 where id in (select id from el0 group by id having count(*) >= 25)), {PAIRS}
select 'chunk' kind, a id_a, b id_b from met join size x on x.id = a join size y on y.id = b where 5 * both_ >= 3 * (x.n + y.n - both_)"""
ORACLE["p5_found"] = f"select * from ({BOOK_PAIRS}) union all select * from ({CHUNK_PAIRS})"
ORACLE["p5_documents"] = f"""with t as (select doc_id id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')) t from documents where doc_id is not null),
w as (select id, string_split(t, ' ') w from t where t is not null),
el0 as (select distinct id, array_to_string(list_slice(w, i, i + 4), ' ') e from (select id, w, unnest(range(1, len(w) - 3)) i from w)),
sets as (select id, string_agg(e, '|' order by e) s from el0 group by id),
class as (select id, min(id) over (partition by s) c from sets),
el as (select * from el0 where id in (select c from class)), {PAIRS},
alike as (select a, b from met join size x on x.id = a join size y on y.id = b where 5 * both_ >= 4 * (x.n + y.n - both_)),
links as (select c, count(*) n from (select a c from alike union all select b from alike) group by c)
select t.id doc_id, coalesce(class.c, case when coalesce(t.t, '') <> '' then min(t.id) over (partition by class.c is null, t.t) else t.id end) class_id, coalesce(links.n, 0)::bigint links
    from t left join class on class.id = t.id left join links on links.c = class.c"""
ORACLE["p7_found"] = """with v as (select chunk_id id, q from (select *, row_number() over (partition by chunk_id order by embedded_at desc, q desc) rn from vectors
        where model = 'emb-multi-2' and len(q) = 64 and len(list_filter(q, lambda x: x is null)) = 0 and len(list_filter(q, lambda x: x <> 0)) > 0 and chunk_id is not null) where rn = 1),
    f as (select id, q::double[64] q from v),
    r as (select x.id a, y.id b, array_inner_product(x.q, y.q) / sqrt(array_inner_product(x.q, x.q) * array_inner_product(y.q, y.q)) c from f x join f y on x.id <> y.id),
    k as (select a, b, c from r qualify row_number() over (partition by a order by c desc, b) <= 5)
    select distinct least(a, b) chunk_a, greatest(a, b) chunk_b from k where c >= 0.9"""

#: Letters with an accent whose base looks like a Latin letter, pairwise; others have no composed form of their own.
ACCENTED, ACCENTED_AS = "ёЁїЇѐЀόΌάίΆΈΉΊΎ", "ëËïÏèÈóÓάίÁÉΉÍÝ"
WIDE, WIDE_AS = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " "
_hidden = "\u00ad\u034f\u061c\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff"
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
FORMS = f"""with a as (select doc_id, text, nfc_normalize(regexp_replace(translate(text, {_quoted(WIDE)}, {_quoted(WIDE_AS)}), '[{_hidden}]', '', 'g')) t from documents where text is not null and doc_id is not null),
b as (select doc_id, text, nfc_normalize(translate(t, {_quoted(CYRILLIC + GREEK + ACCENTED + HARD_SPACES)}, {_quoted(CYRILLIC_AS + GREEK_AS + ACCENTED_AS + " " * len(HARD_SPACES))})) form from a),
f as (select * from b where regexp_matches(form, '[\\p{{L}}\\p{{Nd}}]'))
"""
ORACLE["p10_found"] = FORMS + "select x.doc_id doc_a, y.doc_id doc_b from f x join f y on x.form = y.form and x.doc_id < y.doc_id and x.text <> y.text"
ORACLE["p10_classes"] = FORMS + "select doc_id, min(doc_id) over (partition by form) class_id, count(*) over (partition by form) copies from f"


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
