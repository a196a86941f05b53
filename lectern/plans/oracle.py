"""SQL for another engine (DuckDB) that gives the same rows as the queries of the catalogue."""

from __future__ import annotations

from ..functions import text as T

P = "(select distinct on (passage_id) * from passages where passage_id is not null)"
PP = "(select distinct on (arxiv_id) * from parsed_papers where arxiv_id is not null)"
#: White space as the JVM's patterns have it.
WS = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NWS = WS.replace("[", "[^", 1)


def _sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def clean(x: str) -> str:
    t = f"coalesce({x}, '')"
    c = _sub(_sub(_sub(t, T.COLOR, ""), T.LEFT_RIGHT, ""), T.SPACING, " ")
    for _ in range(T.STYLE_PASSES):
        c = _sub(c, T.STYLE, r"\1")
    c = _sub(c, r"[ \t]+", " ")
    return f"(case when not regexp_matches({c}, '{NWS}') and regexp_matches({t}, '{NWS}') then {t} else {c} end)"


def clean_strict(x: str) -> str:
    c = _sub(_sub(_sub(f"coalesce({x}, '')", T.COLOR_STRICT, ""), T.LEFT_RIGHT, ""), T.SPACING_STRICT, " ")
    for _ in range(T.STYLE_PASSES):
        c = _sub(c, T.STYLE, r"\1")
    return _sub(c, r"[ \t]+", " ")


def tokens(x: str, compound: bool = True, stop: bool = False) -> str:
    found = f"regexp_extract_all(lower(coalesce({x}, '')), '{T.TOKEN}')"
    if compound:
        found = f"flatten(list_transform({found}, lambda w: case when contains(w, '-') then list_concat([w], string_split(w, '-')) else [w] end))"
    if stop:
        words = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
        found = f"list_filter({found}, lambda w: w not in ({words}))"
    return found


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def tidy(x: str) -> str:
    return f"trim({_sub(x, WS + '+', ' ')})"


def grams(x: str) -> str:
    return f"list_transform(range(1, len({x}) - 6), lambda i: array_to_string({x}[i:i+7], ' '))"


_ABBR = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)


def sentences(x: str) -> str:
    kept = f"regexp_replace({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({_ABBR})\\.', '\\1\\2' || chr(57344), 'g')"
    cut = f"regexp_replace({kept}, '([.!?]){WS}+', '\\1' || chr(57345), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(57345)), lambda s: regexp_replace(replace(s, chr(57344), '.'), '^{WS}+|{WS}+$', '', 'g')), lambda s: s <> '')"


def _bm25(field: str, k: int = 10, queries: str = "select item_id query_id, text query from eval_items") -> str:
    """Common table expressions up to ``top``."""
    f = f"""docs_{field} as (select passage_id, toks, len(toks) length from (select passage_id, {tokens(clean(field))} toks from {P} where type in ('text', 'table', 'figure')) where len(toks) > 0),
    st_{field} as (select count(*) n, avg(length) avgdl from docs_{field}),
    q_{field} as (select query_id, term, count(*) qtf from (select query_id, unnest({tokens('query')}) term from ({queries})) group by all),
    tf_{field} as (select passage_id, length, term, count(*) tf from (select passage_id, length, unnest(toks) term from docs_{field}) where term in (select term from q_{field}) group by all),
    df_{field} as (select term, count(*) df from tf_{field} group by term),
    sc_{field} as (select query_id, passage_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * length / avgdl))) score from tf_{field} join df_{field} using (term) join q_{field} using (term), st_{field} group by all having score > 0),
    top_{field} as (select query_id, passage_id, round_even(score, 4) score, rank::int rank from (select *, row_number() over (partition by query_id order by round(score, 6) desc, passage_id) rank from sc_{field}) where rank <= {k})"""
    return f


_BOTH = f"with {_bm25('content')}, {_bm25('contextual_content')}"
_OVERLAP = """select query_id, sum(a * b)::bigint common, round_even(sum(a * b) / count(*), 6) jaccard from (
    select query_id, passage_id, max(a) a, max(b) b from (select query_id, passage_id, 1 a, 0 b from top_content union all select query_id, passage_id, 0, 1 from top_contextual_content) group by all) group by query_id"""

_BLOCKS = f"""(select arxiv_id, s - 1 s, sec.section_id section_id, b - 1 b, blk.type as type, blk.content as content from (
    select arxiv_id, s, sec, unnest(sec.blocks) blk, unnest(range(1, len(sec.blocks) + 1)) b from (select arxiv_id, unnest(sections) sec, unnest(range(1, len(sections) + 1)) s from {PP})))"""
_NOISE = f"""(select passage_id, len(regexp_extract_all(content, '{T.COMMAND}')) commands, len({tokens('content')}) terms, len({tokens(clean_strict('content'))}) terms_clean, len({words('content')}) words
    from {P} where type = 'text' and content is not null)"""
def _unmarked(x: str) -> str:
    return f"replace(coalesce({x}, ''), '[EQUATION]', '')"


_SECTIONS = f"""(select arxiv_id, sec.section_id section_id, sec, s from (select arxiv_id, unnest(sections) sec, unnest(range(1, len(sections) + 1)) s from {PP}))"""
_SRC = f"(select arxiv_id, section_id, s, b, unnest({grams('w')}) g from (select *, {words(_unmarked('content'))} w from {_BLOCKS} where type = 'text'))"
_GOT = f"(select passage_id, arxiv_id, section_id, unnest({grams('w')}) g from (select *, {words("coalesce(content, ' ')")} w from {P} where type = 'text'))"
_OWN = f"""(select arxiv_id, section_id, unnest({grams('w')}) g from (select arxiv_id, section_id, {words("array_to_string(list_transform(list_filter(sec.blocks, lambda x: x.type in ('text', 'equation')), lambda x: " + _unmarked('x.content') + "), ' ')")} w
    from {_SECTIONS} qualify row_number() over (partition by arxiv_id, section_id order by s desc) = 1))"""
_SPINE = "(select row_number() over (order by d) - 1 idx, strftime(d, '%Y-%m') as month from unnest(generate_series(date '2024-01-01', date '2025-12-01', interval 1 month)) t(d))"
_QUOTA = f"(select idx::int idx, month, (12 + case when idx < 12 then 1 else 0 end)::int quota from {_SPINE})"
_TAGS = ", ".join(f"'{t}'" for t in T.TAGS)


def queries() -> dict[str, str]:
    q = {
        "clean_latex": f"select passage_id, {clean('content')} cleaned from {P}",
        "clean_latex_strict": f"select passage_id, {clean_strict('content')} cleaned from {P}",
        "tokenize": f"select doc_id, array_to_string({tokens('text')}, ' ') tokens from documents",
        "tokenize_no_compound": f"select doc_id, array_to_string({tokens('text', compound=False)}, ' ') tokens from documents",
        "tokenize_stopwords": f"select doc_id, array_to_string({tokens('text', stop=True)}, ' ') tokens from documents",
        "split_sentences": f"select passage_id, (pos - 1)::int pos, sentence from (select passage_id, unnest(s) sentence, unnest(range(1, len(s) + 1)) pos from (select passage_id, {sentences('content')} s from {P} where content <> ''))",
        "ngram8": f"select doc_id, count(*) grams, count(distinct g) different from (select doc_id, unnest({grams('w')}) g from (select doc_id, {words('lower(text)')} w from documents)) group by doc_id",
        "snippets": f"""select passage_id, substr(content, (greatest(len(content) // 2 - 200, 0) + 1)::int, 400) middle, case when len(content) > 120 then replace(content[1:120], chr(10), ' ') || '...' else replace(content, chr(10), ' ') end preview,
            array_to_string({words('content')}[1:15], ' ') as "first", coalesce(len({words('content')}), 0)::int words from {P}""",
        "index_filter_project": f"select passage_id, type, coalesce(word_count, 0)::int words, content[1:250] content_snippet from {P} where type in ('text', 'figure') and coalesce(word_count, 0) >= 60",
        "bm25_corpus_stats": f"with {_bm25('content')} select n, round_even(avgdl, 6) avgdl from st_content",
        "term_df": f"select term, count(*) df from (select distinct passage_id, unnest({tokens(clean('content'))}) term from {P} where type in ('text', 'table', 'figure')) group by term",
        "bm25_weights": f"""with docs as (select passage_id, toks, len(toks) length from (select passage_id, {tokens(clean('content'))} toks from {P} where type in ('text', 'table', 'figure')) where len(toks) > 0),
            tf as (select passage_id, length, term, count(*) tf from (select passage_id, length, unnest(toks) term from docs) group by all), df as (select term, count(*) df from tf group by term)
            select term, passage_id, tf, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * length / avgdl)), 6) weight from tf join df using (term), (select count(*) n, avg(length) avgdl from docs)""",
        "bm25_batch_topk": f"with {_bm25('content')} select * from top_content",
        "bm25_contextual_topk": f"with {_bm25('contextual_content')} select * from top_contextual_content",
        "bm25_with_metadata": f"with {_bm25('content', 5)} select query_id, t.passage_id, rank, title, section_path, content[1:250] content_snippet from top_content t join {P} p using (passage_id)",
        "bm25_variant_compare": f"{_BOTH} select query_id, a.passage_id a, b.passage_id b, a.passage_id = b.passage_id same from (from top_content where rank = 1) a join (from top_contextual_content where rank = 1) b using (query_id)",
        "bm25_top5_type_hist": f"with {_bm25('content')} select type, count(*) hits from top_content join {P} using (passage_id) where rank <= 5 group by type",
        "retriever_overlap": f"{_BOTH} {_OVERLAP}",
        "retriever_overlap_means": f"{_BOTH} select count(*) queries, round_even(avg(common), 4) mean_common, round_even(avg(jaccard), 4) mean_jaccard from ({_OVERLAP})",
        "rank_fusion": f"{_BOTH} select query_id, passage_id, round_even(sum(1.0::double / (60 + rank)), 8) score from (select query_id, passage_id, rank from top_content union all select query_id, passage_id, rank from top_contextual_content) group by all",
        "dense_batch_topk": """select query_id, passage_id, round(score, 6) score, rank::int rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, passage_id) rank from
            (select q.vec_id query_id, v.vec_id passage_id, list_inner_product(q.embedding::double[], v.embedding::double[]) score from embeddings v, (from embeddings where vec_id % 100 = 0) q)) where rank <= 5""",
        "section_path": f"""select arxiv_id, (s - 1)::int s, sid section_id, case when contains(lower(sid), 'abstract') then 'Abstract' else array_to_string(list_transform(list_filter(range(1, len(chain) + 1), lambda i: i = 1 or chain[i] <> chain[i - 1]), lambda i: chain[i]), ' > ') end section_path,
            not contains(lower(sid), 'abstract') and len(found) < n_prefix missing
            from (select *, list_concat(found, [case when coalesce(own, '') = '' then sid else own end]) chain from (
              select arxiv_id, s, sid, n_prefix, trim(case when sec.section_id is null then sec.heading else list_filter(sections, lambda x: x.section_id = sid)[-1].heading end) own, list_filter(list_transform(prefixes, lambda p: trim(list_filter(sections, lambda x: x.section_id = p)[-1].heading)), lambda h: h is not null and h <> '') found from (
                select arxiv_id, s, sid, sec, sections, len(string_split(sid, '.')) - 1 n_prefix, list_transform(range(1, len(string_split(sid, '.'))), lambda n: array_to_string(string_split(sid, '.')[1:n], '.')) prefixes
                from (select arxiv_id, sections, sec, coalesce(sec.section_id, '') sid, s from (select arxiv_id, sections, unnest(sections) sec, unnest(range(1, len(sections) + 1)) s from {PP})))))""",
        "pack_units": f"""with recursive u as (select doc_id, i, t, len({words('t')}) w from (select doc_id, unnest(s) t, unnest(range(1, len(s) + 1)) i from (select doc_id, {sentences('text')} s from documents where text <> ''))),
            f as (select doc_id, 1::bigint i, 0 chunk, w::bigint size from u where i = 1 union all
              select u.doc_id, u.i, f.chunk + case when f.size >= 250 or f.size > 0 and f.size + u.w > 350 then 1 else 0 end, case when f.size >= 250 or f.size > 0 and f.size + u.w > 350 then u.w else f.size + u.w end from f join u on u.doc_id = f.doc_id and u.i = f.i + 1)
            select doc_id, chunk::int "no", sum(w)::int words, string_agg(t, ' ' order by i) chunk from (select f.doc_id, f.i, f.chunk, u.t, u.w from f join u using (doc_id, i)) group by doc_id, chunk""",
        "chunk_report": f"""select type, count(*) passages, count(*) filter (word_count < 60) short, count(*) filter (word_count > 350) long, min(word_count) least, max(word_count) most, round_even(avg(word_count), 1) mean, median(word_count) median,
            list_sort(list(word_count))[(count(*) * 0.25)::double::int + case when (count(*) * 0.25)::double::int > count(*) * 0.25 then 0 else 1 end] p25, list_sort(list(word_count))[floor(count(*) * 0.75)::int + 1] p75, list_sort(list(word_count))[floor(count(*) * 0.95)::int + 1] p95 from {P} where word_count is not null group by type""",
        "chunk_isolation": f"""select passage_id, (bad_section::int + bad_range::int)::int errors from (select passage_id, n is null or coalesce(p.section_id, '') = '' or contains(p.section_id, ' > ') bad_section,
            n is not null and not coalesce(len(block_range) = 2 and block_range[1] >= 0 and block_range[1] <= block_range[2] and block_range[2] < n, false) bad_range
            from {P} p left join (select arxiv_id, section_id, coalesce(len(sec.blocks), 0) n from {_SECTIONS} qualify row_number() over (partition by arxiv_id, section_id order by s) = 1) x
            on p.arxiv_id = x.arxiv_id and p.section_id is not distinct from x.section_id) where bad_section or bad_range""",
        "contextual_text": f"select passage_id, 'Document: ' || title || chr(10) || 'Section: ' || section_path || chr(10) || chr(10) || content contextual, 'https://arxiv.org/html/' || arxiv_id || '#' || section_id url from {P}",
        "equation_threshold": f"select arxiv_id, s::int s, b::int b, case when len(content) - 4 > 200 then '[EQUATION]' else content end shown from {_BLOCKS} where type = 'equation'",
        "dup_ids": "select arxiv_id, count(*) - 1 repeats from papers group by arxiv_id having count(*) > 1",
        "dup_titles": f"select title, count(*) papers from (select {tidy(_sub('lower(title)', '[^\\p{L}\\p{N}_\\s]', ''))} title from {PP} where title is not null) group by title having count(*) > 1",
        "short_papers": f"select arxiv_id, trim(title) title, coalesce(total_words, 0)::int words from {PP} where coalesce(total_words, 0) < 1500",
        "empty_blocks": f"""select arxiv_id, s::int s, section_id, b::int b from {_BLOCKS} where not regexp_matches(coalesce(content, ''), '{NWS}') union all
            select arxiv_id, (s - 1)::int, sec.section_id, null from (select arxiv_id, unnest(sections) sec, unnest(range(1, len(sections) + 1)) s from {PP}) where len(sec.blocks) = 0 or sec.blocks is null""",
        "residual_tags": f"select doc_id, tags from (select doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '{T.TAG}', 1), lambda t: lower(t)), lambda t: t in ({_TAGS})))), ',') tags from documents) where tags <> ''",
        "residual_markup": f"select arxiv_id, s::int s, b::int b, tags, trim(content)[1:120] snippet from (select *, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(trim(content), '{T.TAG}', 1), lambda t: lower(t)), lambda t: t in ({_TAGS})))), ',') tags from {_BLOCKS}) where tags <> ''",
        "table_outliers": f"""with r as (select arxiv_id, coalesce(block_counts['table'], 0)::int tables from {PP}), l as (select list_sort(list(tables)) x, count(*) n from r),
            q as (select list_transform([1, 3], lambda i: (x[least(greatest(i * (n + 1) // 4, 1), n - 1)] * (4 - (i * (n + 1) - 4 * least(greatest(i * (n + 1) // 4, 1), n - 1))) + x[least(greatest(i * (n + 1) // 4, 1), n - 1) + 1] * (i * (n + 1) - 4 * least(greatest(i * (n + 1) // 4, 1), n - 1))) / 4) v from l where n >= 2)
            select arxiv_id, tables, greatest(1, trunc(v[2] + 1.0 * (v[2] - v[1]))::int)::int threshold from r, q where tables >= greatest(1, trunc(v[2] + 1.0 * (v[2] - v[1]))::int)""",
        "ngram8_coverage": f"""select sum(c)::bigint source, sum(least(c, coalesce(d, 0)))::bigint covered, round_even(sum(least(c, coalesce(d, 0))) * 100.0::double / sum(c), 4) percent
            from (select arxiv_id, section_id, s, b, g, count(*) c from {_SRC} group by all) x left join (select arxiv_id, section_id, g, count(*) d from {_GOT} group by all) y on x.arxiv_id = y.arxiv_id and x.section_id is not distinct from y.section_id and x.g = y.g""",
        "ngram8_leaks": f"""with own as (select distinct * from {_OWN}), got as (select g.* from {_GOT} g where exists (select 1 from {_SECTIONS} x where x.arxiv_id = g.arxiv_id and x.section_id is not distinct from g.section_id))
            select passage_id, count(*)::bigint leaks from got where not exists (select 1 from own where own.arxiv_id = got.arxiv_id and own.section_id is not distinct from got.section_id and own.g = got.g)
            and exists (select 1 from own where own.arxiv_id = got.arxiv_id and own.g = got.g and own.section_id is distinct from got.section_id) group by passage_id""",
        "size_buckets": f"select count(*) passages, count(*) filter (coalesce(word_count, 0) < 60) small, count(*) filter (coalesce(word_count, 0) < 20) tiny, count(*) filter (coalesce(word_count, 0) > 350) large from {P}",
        "latex_noise": f"select passage_id, commands::int commands, terms::int terms, terms_clean::int terms_clean, words::int words from {_NOISE}",
        "latex_noise_stats": f"""select count(*) passages, median(commands) p50, quantile_cont(commands, 0.9) p90, quantile_cont(commands, 0.99) p99, count(*) filter (commands >= 20) noisy, round_even(count(*) filter (commands >= 20) * 100.0::double / count(*), 2) noisy_percent,
            count(*) filter (commands >= 50) very_noisy, round_even(count(*) filter (commands >= 50) * 100.0::double / count(*), 2) very_noisy_percent, count(*) filter (terms > 512) long, count(*) filter (terms > 512 and commands >= 20) long_noisy,
            count(*) filter (terms_clean > 512) long_clean, max(terms)::int most, max(terms_clean)::int most_clean from {_NOISE}""",
        "latex_noise_groups": f"select commands >= 20 noisy, count(*) passages, round_even(median(terms / greatest(words, 1)), 6) ratio, round_even(avg(terms), 4) mean_terms, median(terms) median_terms from {_NOISE} group by 1",
        "latex_noise_papers": f"select string_split(passage_id, '_')[1] paper, count(*) passages from {_NOISE} where commands >= 20 group by 1 order by 2 desc, 1 limit 10",
        "truncation_summary": f"select type, count(*) total, count(*) filter (n > 512) truncated, round_even(count(*) filter (n > 512) * 100.0::double / count(*), 2) percent from (select type, len({tokens(clean('content'))}) n from {P}) group by type",
        "corpus_stats": f"select count(*) papers, round_even(avg(total_words), 1) mean_words, median(total_words) median_words from {PP}",
        "block_totals": f"select type, sum(n)::bigint blocks from (select unnest(map_keys(block_counts)) as type, unnest(map_values(block_counts)) n from {PP}) group by type",
        "month_quotas": f"select * from {_QUOTA}",
        "month_quotas_small": f"select idx::int idx, month, (idx in (select floor(i * (24.0::double / 7))::int from range(7) t(i)))::int quota from {_SPINE}",
        "monthly_breakdown": f"""select month, quota target, coalesce(a, 0) achieved, coalesce(k, 0) skipped, case when coalesce(a, 0) >= quota then 'reached' else 'short by ' || (quota - coalesce(a, 0)) end status from {_QUOTA}
            left join (select month_stratum as month, count(*) a from {PP} group by 1) using (month) left join (select month_stratum as month, count(*) k from skipped_papers group by 1) using (month)""",
        "monthly_search": """select distinct arxiv_id, published from papers where list_has_any(categories, ['xx.RET', 'xx.TXT']) and (contains(lower(coalesce(title, '')), 'retriev') or contains(lower(coalesce(summary, '')), 'retriev'))
            and try_cast(published[1:10] as date) between date '2024-05-01' and date '2024-05-31'""",
        "resume_anti_join": "select distinct arxiv_id from papers anti join parsed_papers using (arxiv_id)",
        "processed_months": "select month_stratum as month, count(distinct arxiv_id) papers from parsed_papers group by 1",
        "text_fingerprints": "select doc_id, sha256(text) sha256 from documents",
        "entry_columns": f"""select distinct arxiv_id, string_split(arxiv_id, 'v')[1] clean_id, coalesce(nullif({tidy('title')}, ''), 'Untitled') title, case when len(coalesce(published, '')) >= 7 then published[1:7] else 'unknown' end month_stratum,
            coalesce(len(authors), 0)::int authors, array_to_string(coalesce(categories, []), ' ') categories from papers""",
        "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') start, event_type, count(*) events, round(sum(value), 4) value from events group by all",
    }
    return q
