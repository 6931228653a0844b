"""The queries as SQL for DuckDB."""

from __future__ import annotations

from folia.plans import delivered_sql, layout_sql, payload_sql, window_sql
from folia.functions.scalars import DATE_PARTS, LABEL_ALIASES, MONEY_PARTS
from folia.plans.adapters import LABELS

_FIELDS = "text, char_start, char_end, page, x0, y0, x1, y1, page_width, page_height, block_id"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def key(x: str) -> str:
    return f"lower(trim(regexp_replace(replace({squash(x)}, '&', ' and '), '[^0-9A-Za-z]+', '_', 'g'), '_'))"


def name(x: str) -> str:
    return f"case {squash(x)} " + " ".join(f"when '{k}' then '{v}'" for k, v in LABEL_ALIASES.items()) + f" else {squash(x)} end"


def is_money(x: str) -> str:
    return f"regexp_matches({key(x)}, '{'|'.join(MONEY_PARTS)}')"


def is_date(x: str) -> str:
    return f"regexp_matches({key(x)}, '{'|'.join(DATE_PARTS)}')"


def bare(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim({x}), '(?i)p-\\d+$', ''), '(?i)p\\d+$', ''))"


def number(x: str) -> str:
    digits = "([0-9][0-9,]*(?:\\.[0-9]+)?)"
    paren, plain = f"regexp_extract({x}, '\\(\\s*\\$?\\s*{digits}\\s*\\)', 1)", f"regexp_extract({x}, '[-+]?\\$?\\s*{digits}', 1)"
    sign = f"case when regexp_extract({x}, '[-+]?\\$?\\s*{digits}', 0) like '-%' then '-' else '' end"
    return f"case when {paren} <> '' then '-' || {paren} when {plain} <> '' then {sign} || {plain} end"


def money(x: str, commas: bool = False) -> str:
    t = bare(squash(x))
    n, b = number(t), f"replace({t}, '$', '')"
    if not commas:
        n, b = f"replace({n}, ',', '')", f"replace({b}, ',', '')"
    return f"coalesce({n}, trim(regexp_replace({b}, '(?i)p-\\d+$', '')))"


def compact(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def date(x: str) -> str:
    return f"replace({squash(x)}, ' ', '')"


def plain(x: str) -> str:
    return f"trim(translate({squash(x)}, '‹›–—', '<>--'))"


def matching(label: str, x: str) -> str:
    return f"case when {x} is null then '' when {is_money(label)} then {money(x)} when {is_date(label)} then {compact(date(x))} else {compact(plain(x))} end"


def extracted(label: str, x: str) -> str:
    return f"case when {x} is null then '' when {is_money(label)} then {money(x)} when {is_date(label)} then {date(x)} else {plain(x)} end"


def _cte() -> dict[str, tuple[str, ...] | str]:
    """Named parts, each with those that it needs first."""
    labels = ", ".join(f"'{x}'" for x in LABELS)
    norm = lambda s, w: f"case when page_width > 0 and page_height > 0 then greatest(0, least(1000, round_even({s} * 1000.0::double / {w}, 0)::int)) end"
    bucket = lambda v: f"greatest(0, least(99, trunc(({v}) * 100 / 1000.0::double)::int))"
    known = lambda v: f"case when page_width > 0 and page_height > 0 then {v} end"
    return {
        "tok": f"""select rec_id as doc_id, tok_idx, coalesce(text, '') as text, char_start, char_end, page, least(x0, x1) as x0, least(y0, y1) as y0,
            greatest(x0, x1) as x1, greatest(y0, y1) as y1, page_width, page_height, block_id
            from (select *, row_number() over (partition by rec_id, tok_idx order by loaded_at desc, {_FIELDS}) as rn from ocr_tokens where rec_id is not null and tok_idx is not null) where rn = 1""",
        "doc": """select rec_id as doc_id, regexp_replace(lower(trim(dataset_name)), '[\\s-]', '_', 'g') as dataset_name,
            case lower(trim(split)) when 'training' then 'train' when 'validation' then 'val' when 'dev' then 'val' else lower(trim(split)) end as split, has_annotations from canon_docs""",
        "led": """select *, lead(text, 1) over w as t1, lead(text, 2) over w as t2, lead(char_end, 1) over w as e1, lead(char_end, 2) over w as e2, (doc_id + tok_idx) % 3 as k from tok
            window w as (partition by doc_id order by tok_idx)""",
        "ann": f"""select doc_id, tok_idx as ann_idx, list_extract([{labels}], ((doc_id + tok_idx) % {len(LABELS)} + 1)::int) as label,
            char_start + shift as char_start, ends + shift as char_end, case when tok_idx % 7 = 0 then 'another text' when tok_idx % 5 = 0 then words || 'P-2' else words end as text
            from (select *, case when k = 1 and e1 is not null then e1 when k = 2 and e2 is not null then e2 else char_end end as ends,
                case when k = 1 and t1 is not null then concat_ws(' ', text, t1) when k = 2 and t2 is not null then concat_ws(' ', text, t1, t2) else text end as words,
                case when doc_id % 10 = 0 and tok_idx % 2 = 0 then 1000000 else 0 end as shift from led) where tok_idx % 9 = 2 or (doc_id % 4 = 0 and tok_idx % 9 = 3)""",
        "hit": """select a.doc_id, a.ann_idx, a.label as a_label, a.char_start as a_start, a.char_end as a_end, a.text as a_text, t.tok_idx, t.text, t.page, t.x0, t.y0, t.x1, t.y1 from ann a join tok t on a.doc_id = t.doc_id
            and least(t.char_end, a.char_end) > greatest(t.char_start, a.char_start)
            and (least(t.char_end, a.char_end) - greatest(t.char_start, a.char_start)) / greatest(1, t.char_end - t.char_start) >= 0.5""",
        "lab": f"""select *, (case when row_number() over (partition by doc_id, ann_idx order by tok_idx) = 1 then 'B-' else 'I-' end) || {key('a_label')} as bio from hit""",
        "ranked": """select *, row_number() over (partition by doc_id, tok_idx order by a_start, a_end, a_label, ann_idx) as up, row_number() over (partition by doc_id, tok_idx order by a_start desc, a_end desc, a_label desc, ann_idx desc) as down from lab""",
        "bio": "select t.*, coalesce(r.bio, 'O') as label from tok t left join (select doc_id, tok_idx, bio from ranked where up = 1) r on t.doc_id = r.doc_id and t.tok_idx = r.tok_idx",
        "agg": """select doc_id, ann_idx, count(*) as n_tokens, string_agg(tok_idx::varchar, ',' order by tok_idx) as token_indices, trim(string_agg(text, ' ' order by tok_idx)) as token_text, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1,
            case when min(page) = max(page) then min(page) end as page from hit group by 1, 2""",
        "ck0": "select a.*, coalesce(n_tokens, 0) as n_tokens, coalesce(token_indices, '') as token_indices, coalesce(token_text, '') as token_text, page, x0, y0, x1, y1 from ann a left join agg g on a.doc_id = g.doc_id and a.ann_idx = g.ann_idx",
        "ck1": f"""select *, {squash('token_text')} = {squash('text')} as strict_match, {matching('label', 'text')} as annotation_norm, {matching('label', 'token_text')} as token_norm from ck0""",
        "ck2": """select *, case when annotation_norm = '' or token_norm = '' then annotation_norm = token_norm else contains(annotation_norm, token_norm) or contains(token_norm, annotation_norm) end as loose_match from ck1""",
        "ck": "select *, case when n_tokens = 0 then 'unavailable' when loose_match then 'ok' else 'loose_mismatch' end as status from ck2",
        "ent": "select *, case when label <> 'O' then substr(label, 3) end as entity, case when label <> 'O' then label[1] end as prefix from bio",
        "isl": """select *, sum(b) over (partition by doc_id order by tok_idx) as inst from (select *, case when entity is not null and (prefix = 'B' or lag(entity) over (partition by doc_id order by tok_idx) is distinct from entity) then 1 else 0 end as b from ent)""",
        "span": """select doc_id, entity as label, trim(string_agg(text, ' ' order by tok_idx)) as text, min(tok_idx) as token_start, max(tok_idx) as token_end, arg_min(char_start, tok_idx) as char_start, arg_max(char_end, tok_idx) as char_end,
            case when min(page) = max(page) then min(page) end as page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from isl where entity is not null group by doc_id, entity, inst""",
        "nb": f"select *, {norm('x0', 'page_width')} as nx0, {norm('y0', 'page_height')} as ny0, {norm('x1', 'page_width')} as nx1, {norm('y1', 'page_height')} as ny1 from tok",
        "bk": f"""select *, {known(bucket('nx0'))} as bx0, {known(bucket('ny0'))} as by0, {known(bucket('nx1'))} as bx1, {known(bucket('ny1'))} as by1, {known(bucket('greatest(0, nx1 - nx0)'))} as bw, {known(bucket('greatest(0, ny1 - ny0)'))} as bh,
            {known(bucket('floor((ny0 + ny1) / 2)'))} as brow, {known(bucket('floor((nx0 + nx1) / 2)'))} as bcol,
            lag(page) over (partition by doc_id order by tok_idx) is distinct from page or lag(tok_idx) over (partition by doc_id order by tok_idx) is null as fresh from nb""",
        "prd": """select doc_id, row_no, tok_idx as src, label as gold, case when e = 0 then 'O' when e = 1 and label like 'B-%' then 'I-' || substr(label, 3) when e = 2 and label = 'O' then 'B-agency' else label end as pred
            from (select *, (doc_id * 7919 + tok_idx * 104729 + row_no * 31) % 10 as e from (select *, unnest(generate_series(greatest(0, floor((tok_idx - 64) / 48)::int + 1), floor(tok_idx / 48)::int)) as row_no from bio))""",
        "vote": """select doc_id, 0 as record, src, gold, pred from (select *, row_number() over (partition by doc_id, src order by n desc, f) as rn from (select doc_id, src, gold, pred, count(*) as n, min(row_no) as f from prd group by all)) where rn = 1""",
        "sides": "select gold as label, 1 as g, 0 as p, (gold = pred)::int as c from vote union all select pred, 0, 1, 0 from vote",
        "lab0": "select label, sum(g) as support, sum(p) as n_pred, sum(c) as n_correct from sides group by 1",
        "lab1": """select label, case when n_pred = 0 then 0 else n_correct / n_pred end as precision, case when support = 0 then 0 else n_correct / support end as recall,
            2 * n_correct / (n_pred + support) as f1, support, n_pred, n_correct from lab0""",
        "strat": """select d.doc_id, coalesce('has_entities:' || entity, 'only_o') as stratum from (select distinct doc_id from doc) d left join
            (select doc_id, entity from (select doc_id, entity, row_number() over (partition by doc_id order by count(*) desc, min(tok_idx)) as rn from isl where entity is not null group by 1, 2) where rn = 1) b on d.doc_id = b.doc_id""",
        "fold0": """select *, (row_number() over (partition by case when outr then stratum else '' end order by md5('42:' || doc_id), doc_id) - 1) % 5 as own from (select s.*, n_strata > 1 and least_size >= 5 as outr from strat s,
            (select count(*) as n_strata, min(size) as least_size from (select stratum, count(*) as size from strat group by 1)))""",
        "fold1": "select doc_id, stratum, outr, own, unnest(generate_series(0, 4)) as fold from fold0",
        "fold2": """select *, count(*) over (partition by fold) as n, count(*) over (partition by fold, stratum) as size, row_number() over (partition by fold, stratum order by md5((42 + fold) || ':' || doc_id), doc_id) as r from fold1 where fold <> own""",
        "fold3": "select f.*, strata, least_size, greatest(1, least(n - 1, round_even(n * 0.1::double, 0)::int)) as n_val from fold2 f join (select fold, count(distinct stratum) as strata, min(size) as least_size from fold2 group by 1) g on f.fold = g.fold",
        "fold4": "select *, strata > 1 and least_size >= 2 and n_val >= strata and n - n_val >= strata as can from fold3",
        "fold5": """select fold, doc_id, stratum, outr, can, case when row_number() over (partition by fold order by case when can then (r - 0.5) / size else 0.0 end, md5((42 + fold) || ':' || doc_id), doc_id) <= n_val then 'validation' else 'train' end as split from fold4""",
        "folds": """select f.fold::int as fold, doc_id, stratum, split, case when outr then 'stratified' else 'plain' end as outer_splitter, case when inner_can then 'stratified' else 'plain' end as inner_splitter
            from (select * from fold5 union all select fold, doc_id, stratum, outr, null, 'test' from fold1 where fold = own) f join (select fold, bool_or(can) as inner_can from fold5 group by 1) g on f.fold = g.fold""",
        "pg": "select doc_id, tok_idx, text, page, label, fresh, sum(1 + fresh::int) over (partition by doc_id order by tok_idx) - 1 as pos from (select *, lag(page) over (partition by doc_id order by tok_idx) is distinct from page or lag(tok_idx) over (partition by doc_id order by tok_idx) is null as fresh from bio)",
        "pgi": "select doc_id, pos, text, tok_idx as src, 'ocr_token' as role, inst, entity from (select p.*, i.inst, i.entity from pg p join isl i on p.doc_id = i.doc_id and p.tok_idx = i.tok_idx) union all select doc_id, pos - 1, '[PAGE_' || page || ']', null, 'page', null, null from pg where fresh",
        "pgl": """select doc_id, pos, text, src, role, case when src is null then null when entity is null then 'O' when lag(inst) over (partition by doc_id, src is null order by pos) = inst and lag(entity) over (partition by doc_id, src is null order by pos) is not null then 'I-' || entity else 'B-' || entity end as label from pgi""",
    }


_NEEDS = {
    "led": ["tok"], "ann": ["led"], "hit": ["ann"], "lab": ["hit"], "ranked": ["lab"], "bio": ["ranked"], "agg": ["hit"], "ck0": ["agg"], "ck1": ["ck0"], "ck2": ["ck1"], "ck": ["ck2"],
    "ent": ["bio"], "isl": ["ent"], "span": ["isl"], "nb": ["tok"], "bk": ["nb"], "prd": ["bio"], "vote": ["prd"], "sides": ["vote"], "lab0": ["sides"], "lab1": ["lab0"],
    "strat": ["isl", "doc"], "fold0": ["strat"], "fold1": ["fold0"], "fold2": ["fold1"], "fold3": ["fold2"], "fold4": ["fold3"], "fold5": ["fold4"], "folds": ["fold5"], "pg": ["bio"], "pgi": ["pg", "isl"], "pgl": ["pgi"],
}


def with_parts(body: str, *needed: str, other: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """A statement with all parts that it needs before it; ``other`` parts, with what they need, stand for those of the same name."""
    other = other or {}
    parts, order = _cte() | layout_sql.parts() | payload_sql.parts() | window_sql.parts() | delivered_sql.parts() | {k: v for k, (v, _) in other.items()}, []

    def add(part: str) -> None:
        for p in (_NEEDS | layout_sql.NEEDS | payload_sql.NEEDS | window_sql.NEEDS | delivered_sql.NEEDS | {k: v for k, (_, v) in other.items()}).get(part, []):
            add(p)
        if part not in order:
            order.append(part)

    for part in needed:
        add(part)
    return "with recursive " + ", ".join(f"{p} as ({parts[p]})" if f"from {p} " in parts[p] or f"from {p}r " in parts[p] else f"{p} as materialized ({parts[p]})" for p in order) + " " + body


def _items(before: list[tuple[str, str, str]], after: list[tuple[str, str, str]], source: str) -> tuple[str, ...]:
    """A strategy: (condition, text, role) of the items before and after each token."""
    own = ("true", "text", "ocr_token")
    every = [*before, own, *after]
    struct = lambda c, t, r: f"case when {c} then [{{'text': {t}, 'src': {'tok_idx' if r == 'ocr_token' else 'null::int'}, 'role': '{r}'}}] else [] end"
    body = f"select doc_id, (row_number() over (partition by doc_id order by tok_idx, k) - 1)::int as pos, i.text as text, i.src as src, i.role as role from (select doc_id, tok_idx, unnest(items) as i, generate_subscripts(items, 1) as k from (select doc_id, tok_idx, {' || '.join(struct(*e) for e in every)} as items from {source}))"
    return (body,)


#: Labels of exports as rows; the Python literals of this table are JSON but for their quotes.
_ITEM = """select raw_id, unnest(from_json(case when contains(labels, '{' || chr(39)) then replace(labels, chr(39), '"') else labels end, '[{"label":"VARCHAR","start":"BIGINT","end":"BIGINT","text":"VARCHAR"}]')) as i from raw_exports where labels is not null and labels <> ''"""
_SPANS = f"""select raw_id as doc_id, row_number() over (partition by raw_id order by i.start, i."end", trim(i.label)) - 1 as ann_idx, {name("trim(i.label)")} as label, trim(i.label) as raw_label, i.start as char_start, i."end" as char_end, coalesce(i.text, '') as text from item"""
_LABELS = f"item as ({_ITEM}), spans as ({_SPANS})"


def statements() -> dict[str, str]:
    w, p = with_parts, {}
    sides = ("x0", "y0", "x1", "y1")
    p["clean_tokens"] = w("select * from tok", "tok")
    p["reading_order"] = w("select doc_id, tok_idx, (row_number() over (partition by doc_id order by page, char_start, y0, x0, char_end, tok_idx) - 1)::int as place from tok", "tok")
    p["layout_order"] = w("select doc_id, tok_idx, (row_number() over (partition by doc_id order by page, y0, x0, char_start, tok_idx) - 1)::int as place from tok", "tok")
    p["page_texts"] = w("select doc_id, page, trim(string_agg(text, ' ' order by tok_idx)) as text from tok group by 1, 2", "tok")
    p["token_context"] = w("select doc_id, tok_idx, array_to_string(list(text) over (partition by doc_id order by tok_idx rows between 5 preceding and 5 following), ' ') as context from tok", "tok")
    p["running_offsets"] = w("select doc_id, box_no, s::bigint as char_start, (s + length(text))::bigint as char_end from (select doc_id, tok_idx as box_no, text, coalesce(sum(length(text) + 1) over (partition by doc_id order by y0, x0, tok_idx rows between unbounded preceding and 1 preceding), 0) as s from tok)", "tok")
    p["normal_boxes"] = w("select doc_id, tok_idx, " + ", ".join(f"n{s} as n_{s}" for s in sides) + " from nb", "nb")
    p["box_buckets"] = w("select doc_id, tok_idx, " + ", ".join(f"b{s} as b_{s}" for s in sides) + ", bw as b_width, bh as b_height, brow as b_row, bcol as b_col from bk", "bk")
    p["raw_buckets"] = w("select doc_id, tok_idx, trunc((y0 + y1) / 2 * 100 / page_height)::int as row, trunc((x0 + x1) / 2 * 100 / page_width)::int as col from tok", "tok")
    area = lambda t: f"(greatest(0, {t}.x1 - {t}.x0) * greatest(0, {t}.y1 - {t}.y0))"
    inter = "(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"
    union = f"({area('a')} + {area('b')} - {inter})"
    p["neighbour_iou"] = w(f"select a.doc_id, a.tok_idx, round(case when {union} > 0 then {inter} / {union} else 0 end, 6) as iou from tok a join tok b on a.doc_id = b.doc_id and b.tok_idx = a.tok_idx + 1", "tok")
    p["page_extents"] = w("select doc_id, page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, round(avg((y0 + y1) / 2), 6) as middle from tok group by 1, 2", "tok")

    p["label_forms"] = w(f"select label, {key('label')} as key, {name('label')} as name, {is_money('label')} as is_money, {is_date('label')} as is_date, {key('label')} like 'line\\_item\\_%' escape '\\' as is_line_item, regexp_replace({key('label')}, '^line_item_', '') as field, 'B-' || {key('label')} as bio from (select distinct label from ann)", "ann")
    p["value_forms"] = w(f"select doc_id, ann_idx, {money('text')} as money, {money('text', True)} as money_commas, {date('text')} as date, {compact('text')} as compact, {matching('label', 'text')} as matching, {extracted('label', 'text')} as extracted from ann", "ann")
    shown = "case o_orderkey % 3 when 0 then '($' || format('{:,.2f}', o_totalprice) || ')' when 1 then ' $' || format('{:,.2f}', o_totalprice) || 'P-' || (o_orderkey % 7) else o_orderpriority end"
    p["money_of_orders"] = f"select o_orderkey, {money('shown')} as money, case when regexp_full_match({money('shown')}, '[-+]?\\d+(\\.\\d+)?') then regexp_replace({money('shown')}, '^(-?)0+(\\d)', '\\1\\2') else {money('shown')} end as decimal_text, {bare('shown')} as bare from (select *, {shown} as shown from orders)"

    p["span_token_join"] = w("select doc_id, ann_idx, tok_idx from hit", "hit")
    p["bio_keep_first"] = w("select doc_id, tok_idx, label from bio", "bio")
    p["bio_overwrite"] = w("select t.doc_id, t.tok_idx, coalesce(bio, 'O') as label from tok t left join (select * from ranked where down = 1) r on t.doc_id = r.doc_id and t.tok_idx = r.tok_idx", "ranked")
    p["align_issues"] = w("select doc_id, 'no_token_match' as issue_type, ann_idx, null::int as tok_idx from ann a where not exists (select 1 from hit h where h.doc_id = a.doc_id and h.ann_idx = a.ann_idx) union all select doc_id, 'label_conflict', ann_idx, tok_idx from ranked where up > 1", "ranked")
    p["annotation_checks"] = w("select doc_id, ann_idx, n_tokens, token_indices, token_text, strict_match, loose_match, annotation_norm, token_norm, status, page, x0, y0, x1, y1 from ck", "ck")
    ignoring = ", x as (select * exclude (label), case when (doc_id + tok_idx) % 23 = 0 then '-100' else label end as label from bio), e as (select *, case when label not in ('O', '-100') then substr(label, 3) end as entity, label like 'B-%' as b from x), n as (select *, sum((entity is not null and (b or before is distinct from entity))::int) over (partition by doc_id order by tok_idx) as no from (select *, lag(entity) over (partition by doc_id order by tok_idx) as before from e)) "
    p["bio_spans"] = w("#", "bio").replace(" #", ignoring + """select doc_id, entity as label, trim(string_agg(text, ' ' order by tok_idx)) as text, min(tok_idx) as token_start, max(tok_idx) as token_end, arg_min(char_start, tok_idx) as char_start, arg_max(char_end, tok_idx) as char_end,
        case when min(page) = max(page) then min(page) end as page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, round(avg(tok_idx % 10 / 10), 6) as score, 'model' as source from n where entity is not null group by doc_id, entity, no""")
    p["field_values"] = w(f"select doc_id, label, count(*) as n_values, string_agg({extracted('label', 'text')}, '|' order by token_start) as value, count(*) > 1 as is_list from span group by 1, 2", "span")
    p["gold_fields"] = w(f"select doc_id, {key('label')} as label, count(*) as n_values, string_agg({extracted('label', 'text')}, '|' order by char_start, char_end, ann_idx) as value, count(*) > 1 as is_list from ann group by 1, 2", "ann")

    rates = "round(avg((n_tokens > 0)::int), 6) as token_available_rate, round(avg(strict_match::int), 6) as strict_match_rate, round(avg(loose_match::int), 6) as loose_value_match_rate"
    p["quality_documents"] = w(f"select d.doc_id, coalesce(n_annotations, 0) as n_annotations, coalesce(token_available_rate, 1) as token_available_rate, coalesce(strict_match_rate, 1) as strict_match_rate, coalesce(loose_value_match_rate, 1) as loose_value_match_rate, coalesce(n_unavailable, 0) as n_unavailable, coalesce(n_loose_mismatch, 0) as n_loose_mismatch from (select distinct doc_id from doc) d left join (select doc_id, count(*) as n_annotations, {rates}, count(*) filter (n_tokens = 0) as n_unavailable, count(*) filter (n_tokens > 0 and not loose_match) as n_loose_mismatch from ck group by 1) c on d.doc_id = c.doc_id", "ck", "doc")
    p["quality_labels"] = w(f"select label, count(*) as n, {rates} from ck group by 1", "ck")
    p["quality_filter"] = w("select doc_id, ann_idx, label from ck where n_tokens > 0 and loose_match", "ck")
    p["gold_spans"] = w(f"select doc_id, ann_idx, {extracted('label', 'text')} as normalized_gold, {extracted('label', 'token_text')} as normalized_token, status from ck where n_tokens > 0", "ck")
    p["label_counts"] = w("select label, count(*) as n_annotations, count(distinct doc_id) as n_documents from ann group by 1", "ann")
    p["labels_of_documents"] = w("select doc_id, string_agg(distinct label, '|' order by label) as labels from ann group by 1", "ann")
    frequency = "select label from (select label, count(distinct doc_id) as n from ann where doc_id in (select doc_id from doc where has_annotations) group by 1), (select count(*) as docs from doc where has_annotations) where "
    p["common_labels"] = w("#", "ann", "doc").replace(" #", ", many as (select doc_id from ann group by 1 having count(*) >= 8 and doc_id in (select doc_id from doc where has_annotations)) select label from (select label, count(distinct doc_id) as n from ann where doc_id in (from many) group by 1), (select count(distinct doc_id) as docs from many) where n = docs")
    p["labels_by_frequency"] = w(frequency + "n >= floor(docs * 0.5 + 0.999999)", "ann", "doc")
    p["bio_label_map"] = w(f"select (row_number() over (order by k, p) - 1)::int as label_id, bio from (select 'O' as bio, '' as k, '' as p union all select p || '-' || k, k, p from (select distinct {key('label')} as k from ann), (values ('B'), ('I')) v(p))", "ann")
    counts = ", ".join(f"count(*) filter (split = '{s}') as {s}_docs, round(avg(n) filter (split = '{s}'), 6) as {s}_mean" for s in ("train", "val", "test"))
    p["split_pivot"] = w(f"select dataset_name, {counts} from (select d.*, coalesce(n, 0) as n from doc d left join (select doc_id, count(*) as n from tok group by 1) c on d.doc_id = c.doc_id) group by 1", "tok", "doc")

    page = ("fresh", "'[PAGE_' || page || ']'", "page")
    mark = lambda m, v: f"coalesce('[{m}_' || {v} || ']', '[{m}_UNK]')"
    p["ser_plain_text"] = w(_items([], [], "bk")[0], "bk")
    p["ser_page_aware"] = w(_items([page], [], "bk")[0], "bk")
    p["ser_rowcol_bucket"] = w(_items([page, ("true", mark("R", "brow"), "row_bucket"), ("true", mark("C", "bcol"), "col_bucket")], [], "bk")[0], "bk")
    p["ser_bbox_token"] = w(_items([("true", "'[P_' || page || ']'", "page_feature"), *(("true", mark(s.upper(), f"b{s}"), f"bbox_{s}") for s in sides)], [], "bk")[0], "bk")
    box = "coalesce('[B_' || page || '_' || bx0 || '_' || by0 || '_' || bx1 || '_' || by1 || ']', '[B_UNK]')"
    p["ser_compact_bbox_token"] = w(_items([("true", box, "compact_bbox")], [], "bk")[0], "bk")
    p["ser_compact_bbox_token_suffix"] = w(_items([], [("true", box, "compact_bbox")], "bk")[0], "bk")
    p["ser_lmdx_coord_suffix"] = w(_items([page], [("true", "coalesce('[L_' || page || '_' || brow || '_' || bcol || ']', '[L_UNK]')", "coord_suffix")], "bk")[0], "bk")
    p["ser_lmdx_coord_suffix_bbox"] = w(_items([page], [("true", "coalesce('[L_' || page || '_' || bx0 || '_' || by0 || '_' || bx1 || '_' || by1 || ']', '[L_UNK]')", "coord_suffix")], "bk")[0], "bk")
    blocked = """, blk as (select doc_id, page, floor(tok_idx / 12)::int as block_id, min(char_start) as s, max(char_end) as e from tok group by 1, 2, 3),
        best as (select t.doc_id, t.tok_idx, b.block_id, row_number() over (partition by t.doc_id, t.tok_idx order by least(t.char_end, b.e) - greatest(t.char_start, b.s) desc, b.block_id desc) as rn from tok t join blk b on t.doc_id = b.doc_id and t.page = b.page and least(t.char_end, b.e) > greatest(t.char_start, b.s) where t.block_id is null),
        own as (select k.* exclude (block_id), coalesce(k.block_id, b.block_id) as block_id from bk k left join best b on k.doc_id = b.doc_id and k.tok_idx = b.tok_idx and b.rn = 1),
        chg as (select *, fresh or lag(block_id) over (partition by doc_id order by tok_idx) is distinct from block_id as turn from own) """
    body = w("#" + _items([page, ("turn", "coalesce('[BLOCK_' || block_id || ']', '[BLOCK_UNK]')", "block")], [], "chg")[0], "bk")
    p["ser_block_aware"] = body.replace(" #", blocked)

    p["t5_prompt"] = w("select d.doc_id, concat_ws(chr(10), 'Dataset: ' || dataset_name, 'Extract the following fields as JSON:' || chr(10) || own, 'Document:', coalesce(body, '')) as input_text from doc d left join (select doc_id, string_agg(case when fresh then '[PAGE_' || page || '] ' || text else text end, ' ' order by tok_idx) as body from bk group by 1) b on d.doc_id = b.doc_id left join (select doc_id, string_agg(distinct label, ', ' order by label) as own from ann group by 1) a on d.doc_id = a.doc_id", "bk", "ann", "doc")
    js = f"to_json({extracted('label', 'text')})::varchar"
    values = f", v as (select doc_id, {key('label')} as k, {js} as v, char_start, char_end, label, ann_idx from ann), kv as (select doc_id, k, case when count(*) = 1 then min(v) else '[' || string_agg(v, ', ' order by char_start, char_end, label, ann_idx) || ']' end as v from v"
    obj = "'{' || string_agg('\"' || k || '\": ' || v, ', ' order by k) || '}'"
    p["t5_target"] = w("#", "ann").replace(" #", f"{values} group by 1, 2) select doc_id, {obj} as target_text from kv group by 1")
    p["t5_line_items"] = w("#", "ann").replace(" #", f"{values} where k not like 'line\\_item\\_%' escape '\\' group by 1, 2), cell as (select doc_id, substr(k, 11) as k, v, row_number() over (partition by doc_id, k order by char_start, char_end, label, ann_idx) as r from v where k like 'line\\_item\\_%' escape '\\'), rec as (select doc_id, r, {obj} as v from cell group by 1, 2), lst as (select doc_id, 'line_items' as k, '[' || string_agg(v, ', ' order by r) || ']' as v from rec group by 1), both_ as (select * from kv union all select * from lst) select doc_id, {obj} as target_text from both_ group by 1")

    p["relabelled"] = w("select doc_id, pos, src, case when entity is null then 'O' when lag(inst) over (partition by doc_id order by pos) = inst and lag(entity) over (partition by doc_id order by pos) is not null then 'I-' || entity else 'B-' || entity end as label from (select doc_id, (row_number() over (partition by doc_id order by page, y0, x0, char_start, tok_idx) - 1)::int as pos, tok_idx as src, inst, entity from isl)", "isl")
    p["collapsed"] = w("select doc_id, src as tok_idx, label from pgl where src is not null", "pgl")
    p["length_multiplier"] = w("select doc_id, (sum(fresh::int) + 3 * count(*))::bigint as n_items, count(*) as n_real, (sum(fresh::int) + 2 * count(*))::bigint as n_layout, round((sum(fresh::int) + 3 * count(*)) / count(*), 6) as length_multiplier from bk group by 1", "bk")
    p["item_problems"] = w("select doc_id, problem, count(*) as n from (select doc_id, 'missing' as problem from tok where (doc_id + tok_idx) % 11 = 0 union all select doc_id, 'repeated' from tok where (doc_id + tok_idx) % 11 <> 0 and (doc_id + tok_idx) % 13 = 0 union all select doc_id, 'labelled layout' from pg where fresh and doc_id % 5 = 0 union all select doc_id, 'no label' from (select doc_id, unnest(case when (doc_id + tok_idx) % 13 = 0 then [1, 2] else [1] end) from tok where (doc_id + tok_idx) % 11 <> 0 and (doc_id + tok_idx) % 17 = 0)) group by 1, 2", "pg")
    p["assembled"] = w("select i.doc_id as id, dataset_name as dataset, 'page_aware' as serializer, count(src) as original_token_count, count(*)::int as serialized_token_count, string_agg(text, ' ' order by pos) as tokens, string_agg(coalesce(label, '-100'), ' ' order by pos) as labels, string_agg(coalesce(src::varchar, '-'), ' ' order by pos) as sources, string_agg(page::varchar, ' ' order by pos) as pages from (select pgl.*, coalesce(t.page, lead(t.page) over (partition by pgl.doc_id order by pos)) as page from pgl left join tok t on pgl.doc_id = t.doc_id and pgl.src = t.tok_idx) i join doc d on i.doc_id = d.doc_id group by 1, 2", "pgl", "doc")

    p["common_documents"] = w("select strategy, doc_id, n::bigint as n from (select 'page_aware' as strategy, doc_id, count(*) + sum(fresh::int) as n from bk where page_width is not null group by 1, 2 union all select 'plain_text', doc_id, count(*) from bk where block_id is not null group by 1, 2) where doc_id in (select doc_id from bk where page_width is not null) and doc_id in (select doc_id from bk where block_id is not null)", "bk")
    p["training_text"] = w("select doc_id, pos::int as pos, case when src is null then '[LAYOUT_PAGE] ' || text when trim(text) = '' then '<EMPTY_OCR>' else text end as text from pgl", "pgl")
    p["word_windows"] = w("select doc_id, c::int as chunk_index, (c * 48)::int as word_start, least(n, c * 48 + 64)::int as word_end, (select count(label) from pgl l where l.doc_id = x.doc_id and l.pos >= x.c * 48 and l.pos < x.c * 48 + 64) as n_labelled from (select doc_id, n, unnest(generate_series(0, greatest(0, ceil((n - 64) / 48)::int))) as c from (select doc_id, count(*) as n from pgl group by 1)) x", "pgl")

    p["split_by_ratio"] = w("select dataset_name, doc_id, case when r <= floor(n * 0.8::double) then 'train' when r <= floor(n * 0.8::double) + floor(n * 0.1::double) then 'val' else 'test' end as split from (select dataset_name, doc_id, count(*) over (partition by dataset_name) as n, row_number() over (partition by dataset_name order by md5('42:' || doc_id), doc_id) as r from (select distinct dataset_name, doc_id from doc))", "doc")
    p["stable_seeds"] = w("select dataset_name, list_reduce(list_transform(string_split(h, ''), lambda c: (strpos('0123456789abcdef', c) - 1)::bigint), lambda a, b: a * 16 + b) as seed from (select dataset_name, substr(md5('42:' || dataset_name), 1, 8) as h from (select distinct dataset_name from doc))", "doc")
    p["sampled_documents"] = w("select doc_id from doc order by md5('42:' || doc_id), doc_id limit 40", "doc")
    p["document_strata"] = w("select * from strat", "strat")
    p["stratified_folds"] = w("select * from folds", "folds")
    p["split_summary"] = w("select 'page_aware' as strategy, fold, split, count(*) as n_docs, sum(n)::bigint as n_items from folds f join (select doc_id, count(*) + sum(fresh::int) as n from bk group by 1) b on f.doc_id = b.doc_id group by 2, 3", "folds", "bk")

    p["token_vote"] = w("select * from vote", "vote")
    three = lambda pre, c, q, g: f"round(coalesce({c} / nullif({q}, 0), 0), 6) as {pre}precision, round(coalesce({c} / nullif({g}, 0), 0), 6) as {pre}recall, round(coalesce(2 * {c} / nullif({q} + {g}, 0), 0), 6) as {pre}f1"
    kinds = ("precision", "recall", "f1")
    p["token_metrics"] = w("select round(sum(n_correct) / sum(support), 6) as accuracy, " + ", ".join([*(f"round(avg({k}), 6) as macro_{k}" for k in kinds), *(f"round(sum({k} * support) / sum(support), 6) as weighted_{k}" for k in kinds)]) + ", " + three("non_o_micro_", "sum(n_correct) filter (label <> 'O')", "sum(n_pred) filter (label <> 'O')", "sum(support) filter (label <> 'O')") + ", sum(support)::bigint as n_eval_tokens from lab1", "lab1")
    p["label_report"] = w("select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::bigint as support from lab1 union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint from lab1 union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from lab1", "lab1")
    fixed = lambda c: f"select doc_id, src, case when {c} = 'O' then 'O' when {c} like 'I-%' and substr(lag({c}) over w, 3) = substr({c}, 3) and lag({c}) over w <> 'O' and lag(src) over w = src - 1 then {c} else 'B-' || substr({c}, 3) end as l from vote window w as (partition by doc_id order by src)"
    p["bio_repair"] = w(f"select doc_id, src, l as pred from ({fixed('pred')})", "vote")
    spans = lambda c: f"select doc_id, substr(l, 3) as entity, min(src) as a, max(src) as b from (select *, sum((l like 'B-%')::int) over (partition by doc_id order by src) as no from ({fixed(c)})) where l <> 'O' group by doc_id, substr(l, 3), no"
    em = f", gs as ({spans('gold')}), ps as ({spans('pred')}), by_e as (select coalesce(g.entity, p.entity) as entity, count(g.doc_id) as ng, count(p.doc_id) as np, count(*) filter (g.doc_id is not null and p.doc_id is not null) as nc from gs g full join ps p on g.doc_id = p.doc_id and g.entity = p.entity and g.a = p.a and g.b = p.b group by 1) select "
    p["entity_metrics"] = w("#", "vote").replace(" #", em + three("entity_micro_", "sum(nc)", "sum(np)", "sum(ng)") + ", round(avg(2 * nc / (ng + np)), 6) as entity_macro_f1, sum(ng)::bigint as n_gold_entities, sum(np)::bigint as n_pred_entities, sum(nc)::bigint as n_correct_entities from by_e")
    p["missing_tokens"] = w("select count(*) as n_missing from tok t where not exists (select 1 from prd p where p.doc_id = t.doc_id and p.src = t.tok_idx and (p.doc_id * 3 + p.src) % 10 <> 0)", "prd")
    p["fold_statistics"] = "select strategy, model_name, round(avg(v), 6) as value_mean, round(stddev_samp(v), 6) as value_std, round(avg(mean_subtokens), 6) as mean_subtokens_mean, round(stddev_samp(mean_subtokens), 6) as mean_subtokens_std, count(*) as n_folds_completed from (select *, n_tokenized_chunks / n_docs as v from tokenization_summary) group by 1, 2"
    p["upserted"] = "select dataset_name, strategy, model_name, n_docs, created_at from (select *, row_number() over (partition by dataset_name, strategy, model_name order by n_docs % 2 desc, n_docs desc nulls last, created_at desc nulls last) as rn from (select lower(trim(dataset_name)) as dataset_name, strategy, model_name, n_docs, created_at from tokenization_summary)) where rn = 1"
    for made, (body, needed) in (layout_sql.statements() | payload_sql.statements() | window_sql.statements()).items():
        p[made] = w(body, *needed)
    p["dead_letters"] = "select rec_id, error from (select rec_id, concat_ws(',', case when text is null then 'no_text' end, case when dataset_name is null then 'no_dataset' end, case when ingested_at > scanned_at + interval 30 days then 'late' end) as error from canon_docs) where error <> ''"
    p["export_labels"] = f"with {_LABELS} select doc_id, ann_idx::int as ann_idx, label, raw_label, char_start, char_end, text from spans"
    p["export_label_report"] = f"with {_LABELS} select raw_label, label, case when {squash('raw_label')} = label then 'kept' else 'remapped' end as status, count(*) as n from spans group by 1, 2, 3"
    spans = {"item": (_ITEM, []), "spans": (_SPANS, ["item"])}
    for made, (body, needed) in delivered_sql.statements(key, squash, money, extracted, plain).items():
        p[made] = w(body, *needed, other=spans)
    exported = {"item": (_ITEM, []), "ann": (_SPANS, ["item", "tok"]), "tok": ("select raw_id as doc_id, tok_no as tok_idx, coalesce(text, '') as text, char_start, char_end, page_no as page, x0, y0, x1, y1 from ptoks", ["ptoks"])}
    p["export_alignment"] = w(f"select label, count(*) as n, {rates} from ck group by 1", "ck", other=exported)
    p["found_entities"] = r"""with word as (select rec_id, text, regexp_extract(text, '^\S+\s+(\S+\s+\S+)', 1) as v from canon_docs where text is not null),
        val as (select rec_id, text, unnest(['words', 'spaced', 'none', 'empty']) as raw_label, unnest([v, regexp_replace(v, '\s+', '   ', 'g'), 'no such value here', '']) as raw_value from word),
        pat as (select *, regexp_extract(text, array_to_string(list_transform(list_filter(string_split_regex(raw_value, '\s+'), lambda x: x <> ''), lambda x: regexp_escape(x)), '\s+')) as found from val),
        hit as (select *, case when raw_value = '' then 'empty_value' when strpos(text, raw_value) > 0 then 'exact' when found <> '' then 'whitespace_normalized' else 'not_found' end as match_status from pat),
        put as (select *, (case match_status when 'exact' then strpos(text, raw_value) - 1 when 'whitespace_normalized' then strpos(text, found) - 1 end)::int as char_start from hit)
        select rec_id as doc_id, upper(raw_label[1]) || raw_label[2:] as label, raw_label, raw_value, char_start, (char_start + length(case match_status when 'exact' then raw_value else found end))::int as char_end, match_status, coalesce(case match_status when 'exact' then raw_value when 'whitespace_normalized' then found end, raw_value) as text from put"""
    return p
