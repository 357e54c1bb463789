"""The core queries as SQL for DuckDB."""

WORD = r"[\p{L}\p{Nd}]+(?:[+#]*[._\-+#/][\p{L}\p{Nd}]+|[+#]+)*"


def _terms(text: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({text}, '{WORD}'), lambda x: regexp_replace(replace(lower(x), 'ё', 'е'), '^[._\-+#/]+|[._\-/]+$', '', 'g')), lambda x: length(x) between 2 and 40)"


CURRENT = "cur as (select * from (select *, row_number() over (partition by chunk_id order by written_at desc, text) rn from chunks where chunk_id is not null) where rn = 1)"
REGISTRY = "reg as (select * from (select *, row_number() over (partition by path order by seq desc) rn from books where path is not null) where rn = 1)"
UNITS = f"{CURRENT}, u as (select doc_id, cast(ord + 1 as int) unit_no, any_value(text) text from cur where text is not null group by all)"
LINES = f"""{UNITS}, l0 as (select doc_id, unit_no, string_split(text, chr(10)) ls from u),
    l as (select doc_id, unit_no, len(ls) n, unnest(ls) line, unnest(range(len(ls))) i from l0),
    edge as (select *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') raw from l where i < 2 or i >= n - 2)"""
INDEX = f"""d as (select doc_id, text, lang from documents where text is not null),
    t as (select doc_id, unnest({_terms("text")}) term from d),
    p as (select term, doc_id, cast(count(*) as bigint) tf from t group by all),
    len0 as (select doc_id, cast(sum(tf) as bigint) n from p group by all),
    len as (select d.doc_id, coalesce(n, 0) len from d left join len0 using (doc_id)),
    st as (select term, cast(count(*) as bigint) df, cast(sum(tf) as bigint) tf from p group by all),
    co as (select count(*) n, greatest(avg(len), 1.0) a from len)"""


def _bm25(name: str, text: str, only: str = "true") -> str:
    """Scores of a query set; names the common tables after it."""
    return f"""{name}_q as (select item_id query_id, {text} text from eval_items where text is not null),
    {name}_w as (select distinct query_id, term from (select query_id, unnest({_terms("text")}) term from {name}_q)),
    {name}_k as (select query_id, term, df, bool_or(df <= n // 3) over (partition by query_id) rare, n // 3 third from {name}_w join st using (term), co),
    {name}_t as (select query_id, term, df from {name}_k where not rare or df <= third),
    {name} as (select query_id, doc_id chunk_id, round(s * (1 + 0.15 * (m - 1)), 6) score from (
        select query_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * len / a))) s, count(*) m
        from {name}_t join p using (term) join len on len.doc_id = p.doc_id join d on d.doc_id = p.doc_id, co where {only} group by all))"""


def _rank(source: str, k: int, score: str = "score") -> str:
    return f"select query_id, cast(row_number() over (partition by query_id order by {score} desc, chunk_id) as int) rank, chunk_id, {score} from {source} qualify rank <= {k}"


QUANT = """n0 as (select vec_id, embedding e, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) nn from embeddings),
    v as (select vec_id, list_transform(e, lambda x: cast(case when nn > 0 then greatest(least(round(cast(x as double) / nn * 127), 127), -127) else 0 end as tinyint)) q from n0),
    c as (select a.vec_id query_id, b.vec_id chunk_id, round(list_sum(list_transform(list_zip(a.q, b.q), lambda z: cast(z[1] as int) * cast(z[2] as int))) / 16129.0, 6) cosine from v a, v b where a.vec_id % 100 = 0)"""
MESSAGES = """m as (select user_id, event_id, ts, case event_type when 'click' then 'user' when 'view' then 'assistant' when 'signup' then 'assistant' when 'purchase' then 'tool' else 'system' end as role, props as content from events)"""
FIT = """f0 as (select l_returnflag, regr_slope(l_extendedprice, l_quantity) slope, regr_intercept(l_extendedprice, l_quantity) base, count(*) n, max(l_quantity) max_x, count(distinct l_quantity) k from lineitem where l_quantity is not null and l_extendedprice is not null group by all),
    f1 as (select * from f0 where k >= 2 and slope > 0),
    lv0 as (select l_returnflag, l_quantity x, avg(l_extendedprice) y from lineitem group by all),
    lv as (select *, row_number() over (partition by l_returnflag order by x desc) r from lv0),
    tp as (select l_returnflag, (max_by(y, x) - min_by(y, x)) / (max(x) - min(x)) top from lv where r <= 2 group by all),
    dv as (select l.l_returnflag, max(abs(l_extendedprice - base - slope * l_quantity)) dev from lineitem l join f1 using (l_returnflag) group by all),
    fit as (select l_returnflag, n, round(base, 4) base, round(slope, 4) slope, round(top, 4) top_slope, round(dev, 4) deviation, max_x from f1 join tp using (l_returnflag) join dv using (l_returnflag))"""
CAPACITY = f"""{FIT}, us as (select unnest([1, 2, 4, 8]) users),
    ca0 as (select *, greatest(slope, top_slope) s from fit, us),
    ca1 as (select *, cast(least(floor(greatest(0.0, (50000000.0 - base) / (s * users)) / 1024) * 1024, 262144) as bigint) as w from ca0),
    ca as (select l_returnflag, users, w as "window", round(base + users * w * s, 2) predicted from ca1)"""


def _schedule() -> str:
    spans = [(1, 22 * 60, 30 * 60), (3, 570, 720), (3, 1200, 1410), (6, 0, 480)]
    return ", ".join(f"({d}, {a}, {b})" for d, a, b in spans)


ORACLE = {
    "tokens_per_doc": f"select doc_id, len(t) n_terms, len(list_distinct(t)) n_distinct from (select doc_id, {_terms('text')} t from documents where text is not null)",
    "term_stats": f"with {INDEX} select term, df, tf from st",
    "postings_tf": f"with {INDEX} select term, doc_id chunk_id, tf from p",
    "vocab_by_lang": f"with {INDEX} select coalesce(lang, '?') lang, count(distinct term) terms from t join d using (doc_id) group by all",
    "query_term_pruning": f"with {INDEX}, {_bm25('s', 'text')} select query_id, term, df from s_t",
    "bm25_topk": f"with {INDEX}, {_bm25('s', 'text')} {_rank('s', 8)}",
    "bm25_filtered": f"with {INDEX}, {_bm25('s', 'text', only=chr(39).join(['lang = ', 'en', '']))} {_rank('s', 8)}",
    "bm25_phrase_boost": f"""with {INDEX}, {_bm25('s', 'text')}, b as ({_rank('s', 96)}),
        e as (select b.query_id, chunk_id, length(trim(s_q.text)) >= 3 and contains(lower(d.text), lower(trim(s_q.text))) exact, score s0 from b join d on d.doc_id = b.chunk_id join s_q on s_q.query_id = b.query_id),
        f as (select query_id, chunk_id, exact, floor(case when exact then s0 * 1.5 else s0 end * 10000 + 0.5) / 10000 score from e)
        select query_id, cast(row_number() over (partition by query_id order by score desc, chunk_id) as int) rank, chunk_id, score, exact from f qualify rank <= 8""",
    "rrf_fusion": f"""with {INDEX}, {_bm25('s', 'text')}, {_bm25('e', 'text', only=chr(39).join(['lang = ', 'en', '']))}, a as ({_rank('s', 200)}), b as ({_rank('e', 200)}),
        f as (select query_id, chunk_id, round(sum(x), 6) score from (select query_id, chunk_id, 1.0::double / (20 + rank) x from a union all select query_id, chunk_id, 0.5::double / (20 + rank) from b) group by all) {_rank('f', 8)}""",
    "vec_quantize": f"with {QUANT} select vec_id, q from v",
    "vec_topk_cosine": f"with {QUANT}, f as (select * from c where cosine >= 0) {_rank('f', 8, 'cosine')}",
    "vec_min_cosine": f"with {QUANT} select query_id, chunk_id, cosine from c where cosine >= 0.5",
    "vec_pair_cosine": f"with {QUANT} select a.vec_id, round(list_sum(list_transform(list_zip(a.q, b.q), lambda z: cast(z[1] as int) * cast(z[2] as int))) / 16129.0, 6) cosine from v a join v b on b.vec_id = a.vec_id + 1",
    "shingle_sets": r"select doc_id, case when len(w) < 3 then 0 else len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')))) end shingles from (select doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') w from documents where text is not null)",
    "neighbours_around": f"with {CURRENT} select a.chunk_id asked_id, b.chunk_id, b.doc_id, b.ord from cur a join cur b on a.doc_id = b.doc_id and b.ord between a.ord - 1 and a.ord + 1 where a.chunk_id % 100 = 0",
    "output_budget": """with r as (select source query_id, doc_id, row_number() over (partition by source order by doc_id) rank, cast(sum(strlen(text)) over (partition by source order by doc_id) + 100 as bigint) used from documents where text is not null)
        select query_id, doc_id, used from r where used <= 4000 or rank = 1""",
    "citations": f"""with {CURRENT}, {REGISTRY} select chunk_id, coalesce(nullif(trim(title), ''), string_split(path, '/')[-1], 'document ' || doc_id) book,
        concat_ws(' ', coalesce(unit_word, 'page'), case when unit_from = unit_to then cast(unit_from as varchar) else concat_ws('-', unit_from, unit_to) end) place from cur left join reg on reg.id = cur.doc_id""",
    "repeated_lines": f"""with {LINES}, k as (select distinct doc_id, unit_no, trim(regexp_replace(lower(regexp_replace(raw, '\\p{{Nd}}', '', 'g')), '\\s+', ' ', 'g')) line from edge where length(raw) <= 90),
        pages as (select doc_id, count(*) pages from u group by all), c as (select doc_id, line, count(*) units from k where line <> '' group by all)
        select doc_id, line, units from c join pages using (doc_id) where pages >= 5 and units >= greatest(4, pages // 20)""",
    "page_offsets": f"""with {LINES}, f as (select doc_id, unit_no, string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ') f from edge where trim(regexp_replace(line, '\\s+', ' ', 'g')) <> '' and length(trim(regexp_replace(line, '\\s+', ' ', 'g'))) <= 90),
        n as (select doc_id, unit_no, unnest([f[1], f[-1]]) x from f), v as (select doc_id, cast(x as int) - unit_no as off, count(*) votes from n where regexp_full_match(x, '[0-9]{{1,4}}') and cast(x as int) > 0 group by all),
        pages as (select doc_id, count(*) pages from u group by all having count(*) >= 10), b as (select * from v qualify row_number() over (partition by doc_id order by votes desc, off) = 1)
        select doc_id, off as "offset", votes from b join pages using (doc_id) where votes * 4 >= pages""",
    "toc_units": f"with {UNITS} select doc_id, unit_no, cast(n as int) toc_lines from (select doc_id, unit_no, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[.·•․‧]{{4,}}\\s*\\d+\\s*$'))) n from u) where n >= 5",
    "junk_filter": f"with {CURRENT} select chunk_id, s >= 12 and l * 3 >= s worth from (select chunk_id, length(regexp_replace(text, '[\\s\\p{{Z}}\\x{{0b}}]', '', 'g')) s, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) l from cur where text is not null)",
    "line_flags": f"""with {CURRENT}, x as (select chunk_id, string_split(text, chr(10)) ls from cur where text is not null)
        select chunk_id, len(list_filter(ls, lambda x: regexp_matches(x, '^[ \\t]*(func |class |def |package |import |#include|public |private |var |const |let |return |if \\(|for \\(|while \\(|\\$ |> |# |sudo |docker |kubectl |git )')
            or (length(x) - length(regexp_replace(x, '^[ \\t]+', '')) >= 2 and regexp_replace(x, '^[ \\t]+', '') <> '' and (length(regexp_replace(x, '^[ \\t]+', '')) - length(regexp_replace(regexp_replace(x, '^[ \\t]+', ''), '[{{}};()=<>/*\\[\\]]', '', 'g'))) * 8 >= length(regexp_replace(x, '^[ \\t]+', ''))))) code_lines,
            len(list_filter(ls, lambda x: contains(x, ' | '))) table_lines from x""",
    "lang_flags": "select doc_id, case when regexp_matches(text, '[а-яА-ЯёЁ]') then 4 else 0 end + case when regexp_matches(text, '[a-zA-Z]') then 8 else 0 end flags from documents where text is not null",
    "html_to_text": r"""with h as (select doc_id, '<html><style>p {}</style><h1>' || title || '</h1>' || chr(10) || '<p>' || replace(text, chr(10), '<br/>') || '</p><script>x = 1' || chr(10) || '</script> &lt;end&gt;</html>' t from documents where text is not null),
        a as (select doc_id, regexp_replace(t, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', '', 'g') t from h),
        b as (select doc_id, regexp_replace(t, '(?i)<br ?/?>|</(?:p|div|h1|h2|h3|h4|li|tr)>', chr(10), 'g') t from a),
        c as (select doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&mdash;', '—'), '&laquo;', '«'), '&raquo;', '»'), '&amp;', '&') t from b),
        e as (select doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))), chr(10)) t from c)
        select doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') as text from e""",
    "grep_lines": "select doc_id, i line_no, left(line, 400) line from (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) i from documents where text is not null) where regexp_matches(line, '(?i)recursive|рекурсивн')",
    "read_lines": "select doc_id, i line_no, line from (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) i from documents where text is not null) where i between 1 and 3",
    "text_measures": r"""select doc_id, (strlen(text) + 2) // 3 tokens, len(regexp_extract_all(text, '[\p{L}\p{Nd}_\-]+')) words,
        len(list_filter(regexp_extract_all(text, '[а-яА-ЯёЁa-zA-Z0-9_'']+'), lambda x: regexp_matches(x, '[а-яА-ЯёЁ]') and regexp_matches(x, '[a-zA-Z]'))) mixed,
        strlen(regexp_extract(text, '(?is)^.*?(?:не могу помочь|не могу предоставить|не буду помогать|это может быть незаконн|i can''?t help|i cannot assist|i''?m sorry,? but i can''?t)')) between 1 and 1200 refused from documents where text is not null""",
    "small_formats": """select p_partkey, translate(p_name, ':/ ', '___') safe, cast(p_size as bigint) * 1024 tokens, 'skipped' kind, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-zа-я ]', '', 'g'), ' +', ' ', 'g')) title from part""",
    "registry_last_wins": f"with {REGISTRY} select path, seq, id, kind from reg",
    "sync_pending": f"""with {REGISTRY}, disk as (select path, mtime m, size s from listings where path is not null qualify row_number() over (partition by path order by mtime desc nulls last, size desc nulls last) = 1),
        x as (select coalesce(disk.path, reg.path) path, case when reg.path is null then 'new' when disk.path is null then 'missing' when disk.s is distinct from reg.size or disk.m is distinct from reg.mtime then 'changed' end change from disk full join reg on reg.path = disk.path)
        select path, change from x where change is not null""",
    "folder_breakdown": f"with {REGISTRY} select string_split(path, '/')[3] folder, count(*) books, cast(coalesce(sum(chunks), 0) as bigint) chunks, count(*) filter (kind <> 'ok') failed from reg group by all",
    "folder_report": f"""with {REGISTRY}, f as (select string_split(path, '/')[3] folder, count(*) books, coalesce(sum(chunks), 0) chunks from reg group by all), r as (select *, row_number() over (order by books desc, folder) r from f)
        select cast(least(r, 5) as int) rank, count(*) folders, cast(sum(books) as bigint) books, cast(sum(chunks) as bigint) chunks from r group by least(r, 5)""",
    "collection_stats": f"""with {REGISTRY}, {CURRENT}, b as (select count(*) filter (kind = 'ok') ok, count(*) filter (kind = 'scan') scan, count(*) filter (kind = 'garbled') garbled, count(*) filter (kind = 'broken') broken, count(*) filter (kind = 'gone') gone, count(*) filter (kind = 'skipped') skipped from reg),
        v as (select distinct chunk_id from vectors where model = 'emb-multi-2' and q is not null), c as (select count(*) chunks, cast(coalesce(sum(strlen(text)), 0) as bigint) bytes, count(v.chunk_id) covered from cur left join v using (chunk_id))
        select *, cast(covered * 100 // chunks as bigint) percent from b, c""",
    "collection_doctor": f"""with {REGISTRY}, t as (select trim(regexp_replace(regexp_replace(lower(title), '[^a-zа-я ]', '', 'g'), ' +', ' ', 'g')) t from reg)
        select kind as "check", count(*) n from reg where kind <> 'ok' group by all union all select 'titles held twice', count(*) from (select t from t where t <> '' group by t having count(*) > 1)""",
    "title_duplicates": f"""with {REGISTRY}, t as (select id, trim(regexp_replace(regexp_replace(lower(title), '[^a-zа-я ]', '', 'g'), ' +', ' ', 'g')) t from reg)
        select t title, count(*) books, min(id) first_id, max(id) last_id from t where t <> '' group by t having count(*) > 1""",
    "tombstones": f"with {REGISTRY}, {CURRENT} select collection, count(*) chunks from cur where doc_id is null or doc_id not in (select id from reg where kind = 'gone' and id is not null) group by all",
    "uncovered_chunks": f"with {CURRENT} select chunk_id from cur where chunk_id not in (select chunk_id from vectors where model = 'emb-multi-2' and q is not null and chunk_id is not null)",
    "evaluation_summary": "select event_type, count(*) attempts, count(*) filter (event_type = 'error') errors, round(avg(value), 6) mean_seconds, round(median(value), 6) median_seconds, round(coalesce(median(case when value - 20 > 0 then value - 20 end), 0), 6) median_rate from events group by all",
    "ols_fit": f"with {FIT} select * from fit",
    "capacity_by_users": f"with {CAPACITY} select *, case when \"window\" >= 262144 then 'limit of the model' when predicted > 0.9 * 50000000 then 'tight' else '' end note from ca",
    "capacity_pivot": f'with {CAPACITY} select l_returnflag, max("window") filter (users = 1) u1, max("window") filter (users = 2) u2, max("window") filter (users = 4) u4, max("window") filter (users = 8) u8 from ca group by all',
    "idle_islands": """with a as (select *, event_type <> 'error' free, epoch_us(ts) / 1e6 s from events),
        b as (select *, (not free) or lag(s) over w is null or s - lag(s) over w > 28800 or not lag(free) over w reset from a window w as (partition by user_id order by ts, event_id)),
        c as (select *, sum(cast(reset as int)) over (partition by user_id order by ts, event_id) i from b)
        select event_id, case when free then round(s - min(s) over (partition by user_id, i), 3) else 0.0 end idle_s from c""",
    "failure_streaks": """with a as (select *, event_type = 'error' h from events), b as (select *, sum(cast(not h as int)) over (partition by user_id order by ts, event_id) g from a),
        c as (select event_id, row_number() over (partition by user_id, g, h order by ts, event_id) run from b where h) select event_id, run from c where run % 2 = 0""",
    "first_free": """with a as (select *, event_type <> 'error' h from events), b as (select *, sum(cast(not h as int)) over (partition by user_id order by ts, event_id) g from a),
        c as (select user_id, event_id, ts, row_number() over (partition by user_id, g, h order by ts, event_id) run from b where h) select user_id, event_id from c where run = 5 qualify row_number() over (partition by user_id order by ts, event_id) = 1""",
    "schedule_windows": f"""with sp(day, a, b) as (values {_schedule()}), c as (select event_id, ts, date_trunc('day', ts) - to_days(cast(k as int)) mid, a, b, day from events, sp, range(0, 2) r(k))
        select event_id, mid + to_minutes(a) window_begin, mid + to_minutes(b - 15) window_deadline from c where isodow(mid) = day and ts >= mid + to_minutes(a) and ts < mid + to_minutes(b)""",
    "liveness": "with p as (select user_id, max(ts) last, count(*) beats from events group by all) select user_id, beats, (epoch_us((select max(last) from p)) - epoch_us(last)) / 1e6 <= 43200 alive from p",
    "attempt_worklist": "select model, task, cast(repeat as int) repeat from (select distinct event_type model from events), (select r_name task from region), (select unnest([1, 2, 3]) repeat) where not (length(model) > length(task) and repeat = 1)",
    "turn_numbers": f"with {MESSAGES} select event_id, cast(sum(cast(role = 'user' as int)) over (partition by user_id order by event_id) as bigint) turn from m",
    "turn_answers": f"""with {MESSAGES}, t as (select *, cast(sum(cast(role = 'user' as int)) over (partition by user_id order by event_id) as bigint) turn from m)
        select user_id, turn, count(*) parts, string_agg(content, chr(10) || chr(10) order by event_id) answer from t where role = 'assistant' and trim(content) <> '' group by all""",
    "compact_history": f"""with {MESSAGES}, r as (select *, row_number() over (partition by user_id order by event_id desc) r from m), a as (select *, coalesce(min(case when r >= 5 and role <> 'tool' then r end) over (partition by user_id), max(r) over (partition by user_id)) a from r)
        select user_id, event_id from a where r <= a""",
    "session_char_totals": f"with {MESSAGES} select user_id, count(*) messages, cast(sum(strlen(content)) as bigint) bytes from m group by all",
    "block_layout": f"with {MESSAGES}, b as (select *, length(content) - 8 lines from m where length(content) > 8) select event_id, lines, cast(coalesce(sum(lines + 1) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as bigint) first_line from b",
    "visible_answer": f"""with {MESSAGES}, b as (select *, length(content) - 8 lines from m where length(content) > 8), l as (select *, coalesce(sum(lines + 1) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) f from b),
        s as (select user_id, event_id, cast(greatest(0, least(f + lines, 22) - greatest(f, 10)) as bigint) seen from l where role = 'assistant')
        select user_id, event_id, seen from s where seen > 0 qualify row_number() over (partition by user_id order by seen desc, event_id desc) = 1""",
    "listing_difference": """with a as (select distinct path from listings where run_id = 1 and path is not null), b as (select distinct path from listings where run_id = 16 and path is not null)
        select path, 'added' change from b where path not in (from a) and exists (from a) union all select path, 'removed' from a where path not in (from b)""",
    "permission_decisions": """select target, case when regexp_matches(target, '^/lib/(?:.*/)?2019/[^/]*$') or starts_with(target, '/lib/legacy') then 'deny' when regexp_matches(target, '^/lib/[^/]*/a/[^/]*\\.pdf$') or starts_with(target, '/lib/golang/') then 'allow' else 'ask' end decision
        from (select distinct path target from listings where path is not null)""",
    "idle_sessions": """with a as (select *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) >= 14400000000, true) fresh from events), b as (select *, sum(cast(fresh as int)) over (partition by user_id order by ts, event_id) i from a)
        select user_id, min(epoch_us(ts)) begin_us, count(*) events from b group by user_id, i""",
    "daily_windows": "select epoch_us(date_trunc('day', ts)) start_us, event_type, count(*) events, round(sum(value), 2) value_sum from events group by all",
    "p4_found": """with o as (select run_id, path, size, mtime from (select *, row_number() over (partition by run_id, path order by seen_at desc, size desc, mtime desc) rn
            from listings where size is not null and mtime is not null) where rn = 1),
        x as (select o.*, r.status = 'ok' ok from o join runs r using (run_id)),
        p as (select *, last_value(case when ok then {'s': size, 'm': mtime} end ignore nulls) over (partition by path order by run_id rows between unbounded preceding and 1 preceding) seen from x)
        select run_id, path from p where seen is null or seen.s <> size or seen.m <> mtime""",
    "books_matching": f"""with {REGISTRY}, w as (select unnest(['go', 'систем', '/old/2019/', 'nowhere']) want)
        select want, id from reg, w where kind = 'ok' and contains(lower(coalesce(title, '') || chr(10) || coalesce(author, '') || chr(10) || coalesce(path, '')), want)""",
    "books_named": f"""with {REGISTRY}, w as (select distinct split_part(path, '/', -1) want from listings where path is not null)
        select want, min(id) id from (select id, split_part(path, '/', -1) want from reg where kind <> 'gone') join w using (want) group by want""",
    "chunk_refs": f"""with {CURRENT}, c as (select * from cur where collection is not null and ord is not null and doc_id is not null)
        select chunk_id, 0::bigint form, doc_id, ord, null::varchar error from c union all select chunk_id, 1, doc_id, ord, null from c union all
        select chunk_id, 2, case when collection = 'attic' then doc_id end, case when collection = 'attic' then ord end, case when collection <> 'attic' then 'other collection' end from c
        union all select chunk_id, 3, null, null, 'malformed' from c""",
    "byte_cuts": """with t as (select doc_id, text, strlen(text) n, len(list_filter(range(1, least(length(text), 1024) + 1), lambda i: strlen(left(text, i)) <= 1024)) k from documents where text is not null)
        select doc_id, case when n <= 1024 then text else left(text, k) || chr(10) || chr(10) || '[cut: ' || strlen(left(text, k)) || ' of ' || n || ' bytes]' end text from t""",
    "numbered_lines": """with t as (select doc_id, string_split(text, chr(10)) l from documents where text is not null)
        select doc_id, case when len(l) < 2 then '[' || len(l) || ' lines, none from 2]' || chr(10)
            else array_to_string(list_transform(range(2, least(len(l), 4) + 1), lambda i: lpad(i::varchar, 6, ' ') || chr(9) || l[i] || chr(10)), '')
                || case when len(l) > 4 then chr(10) || '[lines 2-4 of ' || len(l) || ']' || chr(10) else '' end end text from t""",
    "common_indent": f"""with {CURRENT}, t as (select chunk_id, string_split('  ' || replace(text, chr(10), chr(10) || '  '), chr(10)) l from cur where text is not null),
        m as (select *, list_min(list_transform(list_filter(l, lambda x: trim(regexp_replace(x, '\\s', ' ', 'g')) <> ''), lambda x: length(x) - length(ltrim(x)))) i from t)
        select chunk_id, case when i > 0 then array_to_string(list_transform(l, lambda x: case when length(x) >= i then substring(x, i + 1) else x end), chr(10)) else array_to_string(l, chr(10)) end text from m""",
    "html_links": """with t as (select doc_id, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) t from documents)
        select doc_id, 0::bigint place, 'c' || doc_id || '.html' href, t text from t where t <> '' union all select doc_id, case when t <> '' then 1 else 0 end, '#top', 'up & away' from t""",
    "number_parsers": """with o as (select o_orderkey, o_orderkey::varchar k, o_custkey::varchar c, o_orderkey a, o_custkey b from orders),
        x as (select *, a >= 1 and (b % 2 = 0 or b >= a) good from o)
        select o_orderkey, case when good then a end first_page, case when good then case when b % 2 = 1 then b - a + 1 else 1 end end pages, case when b > 0 then b::int end unit, case when b > 0 then a::int end figure,
            concat_ws(' ', case when a > 0 then (a * 1024)::varchar end, case when b > 0 then (b * 1048576)::varchar end, '7') sizes, true name_ok from x""",
    "context_meters": """with m as (select *, l_partkey + l_suppkey used, l_orderkey - 100 most from lineitem),
        p as (select *, cast(case when most > 0 then least(floor(used * 100 / most), 100) else -1 end as int) percent, (used * 1000000 - 1000000000) ns from m)
        select l_orderkey, l_linenumber, percent, repeat('█', cast(floor(greatest(percent, 0) / 10) as int)) || repeat('░', 10 - cast(floor(greatest(percent, 0) / 10) as int)) bar,
            round(case when l_partkey > 0 and ns > 0 then l_partkey / (ns / 1e9) else 0.0 end, 6) rate from p""",
    "users_at_full_window": f"""with {FIT}, tot as (select l_returnflag, min(l_extendedprice) total from lineitem where l_quantity = 40 and not l_extendedprice > 80000 group by l_returnflag),
        b as (select fit.*, total, coalesce(total, 5e7) usable, case when total is not null then (total - base) / 40.0 else greatest(slope, coalesce(top_slope, slope)) end per from fit left join tot using (l_returnflag))
        select l_returnflag, cast(case when 1024 * per > 0 and usable > base then floor((usable - base) / (1024 * per)) else 0 end as bigint) users, round(usable, 4) usable, round(per, 6) per_token from b""",
    "sample_points": """with m as (select o_orderkey, o_totalprice, o_custkey, case when o_custkey * 17 - 500 > 0 then o_custkey * 17 - 500 else 32768 end w from orders),
        p as (select *, list_transform([w // 8, w // 4, w // 2], lambda x: least(greatest(x // 1024 * 1024, 1024), w)) l from m)
        select o_orderkey, array_to_string(list_filter(l, lambda x, i: i = 1 or not list_contains(l[1:i - 1], x)), ' ') points,
            round(case when o_custkey - 700.0 > 0 then o_custkey - 700.0 - 250.0 else o_totalprice - 1250.0 end, 2) usable from p""",
    "last_question": f"with {MESSAGES} select user_id, coalesce(max(event_id) filter (role = 'user'), -1) last_id from m group by user_id",
    "checklist_scores": "select user_id, round(greatest(coalesce(sum(case when event_type = 'error' then -value else value / 8 end), 0.0), 0.0), 6) score from events group by user_id",
    "p4_ledger": """select run_id, seq from (select b.seq, (select min(r.run_id) from runs r where r.status = 'ok' and b.at_sec <= floor(epoch(r.finished_at))) run_id from books b where b.seq is not null) where run_id is not null""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
