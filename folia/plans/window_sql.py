"""Windows that are the same for all strategies as SQL for DuckDB: a window for each document in every round of a recursion."""

from __future__ import annotations

USABLE, OVERLAP = 510, 32


def parts() -> dict[str, str]:
    size = lambda text: f"greatest(1, ceil(length({text}) / 4))::bigint"
    mark = lambda role, text: size(f"'[LAYOUT_{role}] ' || {text}")
    page, row, col = mark("PAGE", "'[PAGE_' || page || ']'"), mark("ROW", "coalesce('[R_' || brow || ']', '[R_UNK]')"), mark("COL", "coalesce('[C_' || bcol || ']', '[C_UNK]')")
    return {
        "fline": "select doc_id, tok_idx, dense_rank() over (partition by doc_id order by page, line_no) - 1 as line from ln",
        # of each strategy and token: pieces of its own, of the markers of page and line, and the token before under the same ones
        "fcost": f"""select strategy, b.doc_id, b.tok_idx, {size("case when trim(text) = '' then '<EMPTY_OCR>' else text end")} + case strategy when 'rowcol_bucket' then {row} + {col} else 0 end as own,
            case when strategy <> 'plain_text' then {page} else 0 end as page_cost, case when strategy = 'line_aware' then {mark('LINE', "'[LINE_' || line || ']'")} else 0 end as line_cost,
            coalesce(lag(b.tok_idx) over (partition by strategy, b.doc_id, b.page order by b.tok_idx), -1) as page_before, coalesce(lag(b.tok_idx) over (partition by strategy, b.doc_id, line order by b.tok_idx), -1) as line_before
            from bk b join fline f on b.doc_id = f.doc_id and b.tok_idx = f.tok_idx cross join (select unnest(['plain_text', 'page_aware', 'rowcol_bucket', 'line_aware']) as strategy)""",
        "fsum": "select doc_id, tok_idx, coalesce(sum(alone) over (partition by doc_id order by tok_idx rows between unbounded preceding and 1 preceding), 0) as before, alone from (select doc_id, tok_idx, max(own + page_cost + line_cost) as alone from fcost group by 1, 2)",
        "fhead": """select doc_id, tok_idx, case when label like 'I-%' and first_value(label) over run like 'B-%' then first_value(tok_idx) over run end as head from (select *, sum((not goes_on)::int) over (partition by doc_id order by tok_idx) as no
            from (select doc_id, tok_idx, label, coalesce(label like 'I-%' and lag(label) over (partition by doc_id order by tok_idx) <> 'O' and substr(label, 3) = substr(lag(label) over (partition by doc_id order by tok_idx), 3), false) as goes_on from bio))
            window run as (partition by doc_id, no order by tok_idx)""",
        "fwin": f"""select doc_id, -1 as chunk, 0::bigint as a, 0::bigint as b, 0::bigint as start, count(*) as n from tok group by 1
            union all select doc_id, chunk + 1, start, stop, greatest(start + 1, coalesce((select max(tok_idx) from fsum s where s.doc_id = z.doc_id and s.tok_idx < stop and s.before <= z.total - {OVERLAP}), start)), n
            from (select y.*, e.before + e.alone as total from (select x.doc_id, chunk, start, n, case when head > start then head else stop end as stop from (
                select doc_id, any_value(chunk) as chunk, any_value(start) as start, any_value(n) as n, coalesce(min(tok_idx) filter (taken > {USABLE}), any_value(n)) as stop from (
                    select w.*, c.tok_idx, sum(own + case when page_before < start then page_cost else 0 end + case when line_before < start then line_cost else 0 end) over (partition by w.doc_id, strategy order by c.tok_idx) as taken
                    from fwin w join fcost c on w.doc_id = c.doc_id and c.tok_idx >= w.start and c.tok_idx <= w.start + {USABLE} where w.b < w.n) group by doc_id) x
                left join fhead h on x.doc_id = h.doc_id and x.stop = h.tok_idx) y join fsum e on y.doc_id = e.doc_id and e.tok_idx = y.stop - 1) z""",
        "fout": """select c.doc_id, strategy, chunk as chunk_index, a as word_start, b as word_end, sum(own + case when page_before < a then page_cost else 0 end + case when line_before < a then line_cost else 0 end) as n_pieces, count(*) as tokens,
            count(*) filter (strategy <> 'plain_text' and page_before < a) + count(*) filter (strategy = 'line_aware' and line_before < a) + case strategy when 'rowcol_bucket' then 2 * count(*) else 0 end as marks
            from fwin w join fcost c on w.doc_id = c.doc_id and c.tok_idx >= a and c.tok_idx < b where chunk >= 0 group by c.doc_id, strategy, chunk, a, b""",
    }


NEEDS = {"fline": ["ln"], "fcost": ["bk", "fline"], "fsum": ["fcost"], "fhead": ["bio"], "fwin": ["fsum", "fhead"], "fout": ["fwin"]}


def statements() -> dict[str, tuple[str, list[str]]]:
    """Name -> (statement, the parts that it needs)."""
    return {
        "fair_windows": ("select doc_id, strategy, chunk_index::int as chunk_index, word_start::int as word_start, word_end::int as word_end, n_pieces::int as n_pieces from fout", ["fout"]),
        "tokenized_runs": (
            """select dataset_name, strategy, 'four letters' as model_name, 512 as effective_max_length, 32 as tokenizer_stride, count(*) as n_base_word_chunks, count(*) as n_tokenized_chunks, count(distinct f.doc_id) as n_docs,
            round(avg(n_pieces + 2), 6) as mean_subtokens, max(n_pieces + 2)::int as max_subtokens, count(*) * 512 as total_padded_subtokens from fout f join doc d on f.doc_id = d.doc_id group by 1, 2""",
            ["fout", "doc"],
        ),
        "window_examples": (
            """select f.doc_id, strategy, chunk_index::int as chunk_index, any_value(tokens + marks)::bigint as n, any_value(tokens)::bigint as n_labelled, case strategy when 'plain_text' then 0 else count(nx0) end::bigint as n_boxes,
            case strategy when 'plain_text' then -any_value(tokens) else sum(page) - any_value(marks) end::bigint as pages from fout f join nb t on f.doc_id = t.doc_id and t.tok_idx >= word_start and t.tok_idx < word_end group by f.doc_id, strategy, chunk_index""",
            ["fout", "nb"],
        ),
    }
