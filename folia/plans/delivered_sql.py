"""The queries of readers, loaders and single rules as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

_PIXEL = "round_even({c} * case when x0 between 0 and 1 and y0 between 0 and 1 and x1 between 0 and 1 and y1 between 0 and 1 then coalesce({size}, 1000.0) else 1.0 end, 0)::int"


def _pixels(extra: str) -> str:
    sides = ", ".join(_PIXEL.format(c=f"t.{c}", size="page_width" if c[0] == "x" else "page_height").replace("x0 between", "t.x0 between").replace("and y0", "and t.y0").replace("and x1", "and t.x1").replace("and y1", "and t.y1") + f" as {c}" for c in ("x0", "y0", "x1", "y1"))
    return f"select {extra}, {sides}, page_width, page_height"


def parts() -> dict[str, str]:
    return {
        "psize": "select raw_id, page_no, s.w as page_width, s.h as page_height from (select raw_id, page_no, max({'w': page_width, 'h': page_height}) as s from ppages where page_width is not null and page_height is not null group by 1, 2)",
        "boxed": """select raw_id as doc_id, no, row_number() over (partition by raw_id order by y, x, no) - 1 as tok_idx, t as text, coalesce(sum(length(t) + 1) over (partition by raw_id order by y, x, no rows between unbounded preceding and 1 preceding), 0) as s, x as x0, y as y0, x2 as x1, y2 as y1
            from (select *, trim(text, ' ') as t, round_even(x0, 0)::int as x, round_even(y0, 0)::int as y, round_even(x1, 0)::int as x2, round_even(y1, 0)::int as y2 from pbox)""",
        "piece": "select doc_id, pos, src, label, n, coalesce(sum(n) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) + 1 as base from (select *, greatest(1, ceil(length(text) / 4))::int as n from pgl)",
        "cut": "select doc_id, n, unnest(generate_series(0, greatest(0, ceil((n - 64) / 48)::int))) as c from (select doc_id, count(*) as n from pgl group by 1)",
    }


NEEDS = {"psize": ["ppages"], "boxed": ["pbox"], "piece": ["pgl"], "cut": ["pgl"]}


def statements(key: Callable, squash: Callable, money: Callable, extracted: Callable, plain: Callable) -> dict[str, tuple[str, list[str]]]:
    """Name -> (statement, the parts that it needs). Further arguments: the rules of labels and values as SQL."""
    pages = "(select raw_id, string_agg(text, chr(10) || chr(10) order by page_no, text) as t from ppages where text <> '' group by 1)"
    shown = lambda c: f"nullif(nullif(trim({c}), ''), '[]')"
    a, b = "case when raw_id % 3 = 0 then '[]' else labels end", "case when raw_id % 2 = 0 then ' ' else labels end"
    raw = "'($ ' || format('{:,.2f}', o_totalprice) || ')'"
    who = "'  ' || o_orderpriority || ' – x '"
    label = "case when t.tok_idx % 2 = 0 then 'Gross Amount' else 'Agency' end"
    score = lambda x, y: f"(doc_id * {x} + tok_idx * {y}) % 101 / 101"
    counted = "select label, count(*) as n from spans group by 1"
    return {
        "csv_rows": ("select c.rec_id, 'ndas' as dataset, 'nda' as source_folder, d.split as source_split, row_number() over (partition by d.split order by c.rec_id) - 1 as source_row_index, coalesce(text, '') as text from canon_docs c join doc d on c.rec_id = d.doc_id where d.split in ('train', 'val', 'test')", ["doc"]),
        "csv_status": ("select 'ndas' as dataset, s as source_split, case when s <> 'val' and s in (select split from doc) then 'ok' else 'error' end as status from (select unnest(['train', 'val', 'test']) as s)", ["doc"]),
        "json_records": (
            """select 'f' || n || case n % 3 when 0 then '.jsonl' when 1 then '.jsonl.gz' else '.json' end as file, case when n % 3 = 2 then k - 1 else 2 * k - 1 end as source_line_number, rec_id, lang
            from (select rec_id, lang, rec_id // 500 as n, row_number() over (partition by rec_id // 500 order by rec_id) as k from canon_docs)""",
            ["doc"],
        ),
        "payloads_by_path": ("select raw_id, length(p) as n_chars, md5(p) as digest from (select raw_id, coalesce(ocr_json, ocr_output, ocr_data) as p from raw_exports)", ["doc"]),
        "record_items": ("select doc_id, 'page_aware' as strategy, pos::int as pos, text, src, role, label from pgl union all select doc_id, 'plain_text', src, text, src, role, label from pgl where src is not null", ["pgl"]),
        "loaded_documents": (
            f"""select r.raw_id as doc_id, 'ndas' as dataset_name, coalesce(case when json_type(j -> '$.text') = 'VARCHAR' then j ->> '$.text' end, t, '') as text, split as source_split
            from raw_exports r left join kind k on r.raw_id = k.raw_id left join {pages} p on r.raw_id = p.raw_id""",
            ["ppages"],
        ),
        "loaded_tokens": (
            f"""select doc_id, (row_number() over (partition by doc_id order by page, char_start, y0, x0, char_end, tok_no) - 1)::int as tok_idx, text, char_start, char_end, page, x0, y0, x1, y1, page_width, page_height
            from ({_pixels("t.raw_id as doc_id, t.page_no as page, tok_no, coalesce(text, '') as text, char_start, char_end")} from ptoks t left join psize s on t.raw_id = s.raw_id and t.page_no = s.page_no)""",
            ["ptoks", "psize"],
        ),
        "loaded_blocks": (f"select * exclude (page_width, page_height) from ({_pixels('t.raw_id as doc_id, block_id, t.page_no as page, char_start, char_end, text')} from pblks t left join psize s on t.raw_id = s.raw_id and t.page_no = s.page_no)", ["pblks", "psize"]),
        "box_tokens": ("select doc_id, tok_idx::int as tok_idx, text, s::bigint as char_start, (s + length(text))::bigint as char_end, 0 as page, x0, y0, x1, y1, max(x1) over (partition by doc_id) as page_width, max(y1) over (partition by doc_id) as page_height, tok_idx::int as block_id from boxed", ["boxed"]),
        "box_texts": ("select doc_id, string_agg(text, chr(10) order by tok_idx) as text from boxed group by 1", ["boxed"]),
        "nested_values": (
            """select rec_id as doc_id, (row_number() over (partition by rec_id order by s, e, label) - 1)::int as ann_idx, label, raw_label, s as char_start, e as char_end, case when label = 'contract_number' then 'far' else substr(text, s + 1, e - s) end as text
            from (select rec_id, text, unnest([{'label': 'gross_amount', 'raw_label': 'gross_amount', 's': 0::bigint, 'e': length(text) % 7 + 1}, {'label': 'sub_amount', 'raw_label': 'Program Desc/Sub Amount', 's': 2, 'e': 5}, {'label': 'contract_number', 'raw_label': 'contract_num', 's': 9999999, 'e': 10000000}], recursive := true)
            from canon_docs where length(text) > 10)""",
            ["doc"],
        ),
        "first_labels": (f"select raw_id, case when {shown('a')} is not null then a when {shown('b')} is not null then b else '[1]' end as labels, case when {shown('a')} is not null then 'a' when {shown('b')} is not null then 'b' else 'c' end as label_source from (select raw_id, {a} as a, {b} as b from raw_exports)", ["doc"]),
        "label_accounting": (f"select raw_label, label, case when label not in (select label from ({counted}) where 2 * n >= (select max(n) from ({counted}))) then 'dropped' when {squash('raw_label')} = label then 'kept' else 'remapped' end as status, count(*) as n from spans group by 1, 2, 3", ["spans"]),
        "invalid_labels": ("select label, count(*) as n from spans where label not in (select label from ann) group by 1", ["spans", "ann"]),
        "normal_values": (
            f"""select o_orderkey, case when o_orderkey % 5 <> 0 then '{{"gross_amount": "' || {money('raw')} || '", "order_date": ["1May2020", "' || o_orderdate::date || '"], "who": "' || {plain('who')} || '"}}' end as value from (select *, {raw} as raw, {who} as who from orders)""",
            ["doc"],
        ),
        "single_rules": (
            f"""select t.doc_id, t.tok_idx, {', '.join(f"round_even(n{s} * {'page_width' if s[0] == 'x' else 'page_height'} / 1000.0::double, 0)::int as p_{s}" for s in ('x0', 'y0', 'x1', 'y1'))}, {extracted(label, 'text')} = {extracted(label, "(' ' || text || ' ')")} as exact,
            regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\-_.]', '_', 'g') as name, 'Total Amount Due' as title, '{{"a":"x","b":[1,null]}}' as marker, case when tok_idx = 0 then 2 else 3 end as n_values from nb t""",
            ["nb"],
        ),
        "best_labels": (f"select doc_id, tok_idx, case when p >= q and p >= r then 'O' when q >= r then 'B-a' else 'I-a' end as label, round(-0.75::double * pow(1 - x, 2) * ln(x), 6) as loss from (select *, (p * 100 + 1) / 102 as x from (select doc_id, tok_idx, {score(7, 13)} as p, {score(11, 5)} as q, {score(3, 29)} as r from tok))", ["tok"]),
        "item_label_ids": (
            f"""select doc_id, pos::int as pos, coalesce(id, -100)::int as label_id from pgl left join (select row_number() over (order by k, p) - 1 as id, bio from (select 'O' as bio, '' as k, '' as p union all select p || '-' || k, k, p from (select distinct {key('label')} as k from ann), (values ('B'), ('I')) v(p))) m on pgl.label = m.bio""",
            ["pgl", "ann"],
        ),
        "positions": ("select doc_id, sum(least(n, 127 - base))::bigint as n, max(least(base + n, 127) - 1)::int as last, count(label) as n_labelled, count(src) as n_first from piece where base < 127 group by 1", ["piece"]),
        "chunk_totals": ("select count(*) as n_base_word_chunks, count(distinct doc_id) as n_docs, round(avg(least(n, c * 48 + 64) - c * 48), 6) as mean_base_chunk_words, max(least(n, c * 48 + 64) - c * 48)::int as max_base_chunk_words from cut", ["cut"]),
        "page_features": ("select doc_id, tok_idx, " + ", ".join(f"round(coalesce(n{s}, 0) / 1000, 6) as f_{s}" for s in ("x0", "y0", "x1", "y1")) + ", round(case when page >= 0 then (least(255, page) + 1) / 256 else 0 end, 6) as f_page from nb", ["nb"]),
        "record_sources": ("select doc_id as id, dataset_name as dataset, coalesce(split, 'none') as split, dataset_name as source_folder, 'kept=yes,new_seeded_split=' || coalesce(split, 'none') || case when split is not null then ',source_split=' || split else '' end || ',split_seed=42' as metadata from doc", ["doc"]),
        "record_slots": ("select rec_id, dataset, doc_key, (row_number() over (partition by dataset, doc_key order by rec_id) - 1)::int as occurrence from (select c.rec_id, d.dataset_name as dataset, coalesce(nullif(c.doc_id, ''), 'f::fallback::' || c.rec_id) as doc_key from canon_docs c join doc d on c.rec_id = d.doc_id)", ["doc"]),
        "first_fold": ("select dataset_name, count(*) as n from doc where doc_id % 5 = 0 group by 1", ["doc"]),
        "best_runs": ("select *, (rank() over (order by mean desc nulls last))::int as place from (select strategy, model_name, round(avg(mean_subtokens), 6) as mean from tokenization_summary group by 1, 2)", ["doc"]),
    }
