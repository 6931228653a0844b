"""Nested payloads as SQL for DuckDB, by its JSON functions."""

from __future__ import annotations


def _number(x: str) -> str:
    return f"try_cast(({x} ->> '$') as double)"


def _whole(x: str) -> str:
    n = _number(x)
    return f"case when {n} = floor({n}) then {n}::bigint end"


def _first(at: str, names: list[str]) -> str:
    """The first value under these names that isn't null."""
    return "coalesce(" + ", ".join(f"case when json_type({at} -> '$.{n}') <> 'NULL' then {at} -> '$.{n}' end" for n in names) + ")"


def _text(at: str) -> str:
    return f"case when json_type({at} -> '$.text') in ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') then {at} ->> '$.text' end"


def _objects(source: str, at: str, field: str, keys: str, place: str) -> str:
    """The objects of an array as rows: keys, place and e."""
    return f"select * from (select {keys}, unnest({at} -> '$.{field}[*]') as e, generate_subscripts({at} -> '$.{field}[*]', 1) - 1 as {place} from {source}) where json_type(e) = 'OBJECT'"


def parts() -> dict[str, str]:
    quoted = r""""((?:[^"\\]|\\.)*)"|''((?:[^''\\]|\\.)*)''"""
    words = lambda x, a, b: f"regexp_replace({x}, '([:,\\[] )({a})', '\\1{b}', 'g')"
    literal = words(words(f"regexp_replace(p, '{quoted}', '\"\\1\\2\"', 'g')", "None", "null"), "True|False", "true")
    doc = "e -> '$.doc_offset'"
    unit_box = ", ".join(f"{_number(_first(chr(40) + 'e -> ' + chr(39) + '$.position' + chr(39) + chr(41), names))} as {k}" for k, names in (("x0", ["left", "bbLeft", "x0"]), ("y0", ["top", "bbTop", "y0"]), ("x1", ["right", "bbRight", "x1"]), ("y1", ["bottom", "bbBot", "y1"])))
    unit = f"coalesce({_whole(chr(40) + 'e -> ' + chr(39) + '$.page_num' + chr(39) + chr(41))}, 0) as page, {_whole(f'({doc} -> {chr(39)}$.start{chr(39)})')} as s, {_whole(f'({doc} -> {chr(39)}$.end{chr(39)})')} as t, {unit_box}, {_text('e')} as text"
    pair = "case when json_array_length(e -> '$.segments[0]') = 2 then e -> '$.segments[0]' when json_array_length(e -> '$.segment') = 2 then e -> '$.segment' end"
    side = lambda k: _number(f"(e -> ('$.bbox[' || (case n when 5 then {k + 1} else {k} end) || ']'))")
    form = f"""page, case when pair is not null then {_whole("(pair -> '$[0]')")} else {_whole(f"({doc} -> '$.start')")} end as s, case when pair is not null then {_whole("(pair -> '$[1]')")} else {_whole(f"({doc} -> '$.end')")} end as t,
        {', '.join(f'case when n in (4, 5) then {side(k)} end as {name}' for k, name in enumerate(('x0', 'y0', 'x1', 'y1')))}, {_text('e')} as text"""
    valid = "s is not null and t is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null"
    kinds = [("tokens", 0)], [("lines", 0), ("paragraphs", 1)]

    def entries(unit_field: str, form_fields: list[tuple[str, int]]) -> str:
        from_units = f"select raw_id, a, 0 as b, c, {unit} from ({_objects('unit', 'u', unit_field, 'raw_id, a', 'c')})"
        from_forms = " union all ".join(f"select raw_id, a, {rank} as b, c, {form} from (select *, {pair} as pair, json_array_length(e -> '$.bbox') as n from ({_objects('sheet', 'g', field, 'raw_id, a, page', 'c')}))" for field, rank in form_fields)
        return f"select *, row_number() over (partition by raw_id order by a, b, c) - 1 as no from ({from_units} union all {from_forms}) where {valid}"

    return {
        "pay": f"select raw_id, try_cast(case when json_valid(p) then p when json_valid(q) then q end as json) as j from (select raw_id, p, {literal} as q from (select raw_id, coalesce(ocr_json, ocr_output, ocr_data) as p from raw_exports) where p is not null)",
        "kind": "select *, case when json_type(j) = 'ARRAY' then 'list' when coalesce(json_type(j -> '$.ocr_boxes'), 'NULL') <> 'NULL' then 'box' when coalesce(json_type(j -> '$.tokens'), 'NULL') <> 'NULL' or coalesce(json_type(j -> '$.blocks'), 'NULL') <> 'NULL' then 'unit' else 'form' end as k from pay where json_type(j) in ('ARRAY', 'OBJECT')",
        "unit": "select raw_id, 0 as a, j as u from kind where k = 'unit' union all select * from (select raw_id, generate_subscripts(j -> '$[*]', 1) as a, unnest(j -> '$[*]') as u from kind where k = 'list') where json_type(u) = 'OBJECT'",
        "sheet": f"select raw_id, a, e as g, coalesce({_whole(_first('e', ['page_id', 'page_num']))}, a) as page from ({_objects('(from kind where k = ' + chr(39) + 'form' + chr(39) + ')', 'j', 'pages', 'raw_id', 'a')})",
        "ptok": entries("tokens", kinds[0]),
        "pblk": entries("blocks", kinds[1]),
        "pbox": f"""select raw_id, row_number() over (partition by raw_id order by c) - 1 as no, text, (select min({_number("(q -> '$[0]')")}) from (select unnest(points) as q)) as x0, (select min({_number("(q -> '$[1]')")}) from (select unnest(points) as q)) as y0,
            (select max({_number("(q -> '$[0]')")}) from (select unnest(points) as q)) as x1, (select max({_number("(q -> '$[1]')")}) from (select unnest(points) as q)) as y1
            from (select raw_id, c, {_text('e')} as text, e -> '$.points[*]' as points from ({_objects('(from kind where k = ' + chr(39) + 'box' + chr(39) + ')', 'j', 'ocr_boxes', 'raw_id', 'c')})) where regexp_matches(text, '\\S') and len(points) >= 4""",
        "ptoks": """select t.raw_id, t.no as tok_no, t.page as page_no, coalesce((select min(b.no) from pblk b where b.raw_id = t.raw_id and b.page = t.page and b.s <= t.s and t.t <= b.t), -1) as block_id, text, s as char_start, t as char_end, x0, y0, x1, y1 from ptok t
            union all select raw_id, no, 0, no, text, 0, 0, x0, y0, x1, y1 from pbox""",
        "pblks": "select raw_id, no as block_id, page as page_no, text, s as char_start, t as char_end, x0, y0, x1, y1 from pblk union all select raw_id, no, 0, text, 0, 0, x0, y0, x1, y1 from pbox",
        "ppages": f"""select raw_id, coalesce({_whole("(e -> '$.page_num')")}, c) as page_no, {_number("(e -> '$.size.width')")} as page_width, {_number("(e -> '$.size.height')")} as page_height, case when json_type(e -> '$.text') = 'VARCHAR' then e ->> '$.text' end as text from ({_objects('unit', 'u', 'pages', 'raw_id', 'c')})
            union all select raw_id, page, {_number("(g -> '$.dimension.width')")}, {_number("(g -> '$.dimension.height')")}, case when json_type(g -> '$.text') = 'VARCHAR' then g ->> '$.text' end from sheet
            union all select raw_id, 0, max(x1), max(y1), null from pbox group by 1""",
    }


NEEDS = {"kind": ["pay"], "unit": ["kind"], "sheet": ["kind"], "ptok": ["unit", "sheet"], "pblk": ["unit", "sheet"], "pbox": ["kind"], "ptoks": ["ptok", "pblk", "pbox"], "pblks": ["pblk", "pbox"], "ppages": ["unit", "sheet", "pbox"]}


def statements() -> dict[str, tuple[str, list[str]]]:
    """Name -> (statement, the parts that it needs)."""
    return {
        "p3_found": ("select raw_id, tok_no, page_no, block_id from ptoks", ["ptoks"]),
        "p3_tokens": ("select * from ptoks", ["ptoks"]),
        "p3_blocks": ("select * from pblks", ["pblks"]),
        "p3_pages": ("select * from ppages", ["ppages"]),
        "p3_payloads": (
            """select k.raw_id, case k when 'list' then 'unit' when 'form' then case when coalesce(json_type(j -> '$.pages'), 'NULL') <> 'NULL' then 'form' else 'other' end else k end as shape, case when json_type(j -> '$.text') = 'VARCHAR' then j ->> '$.text' end as text,
            (select count(*) from ppages p where p.raw_id = k.raw_id) as n_pages, (select count(*) from ptoks t where t.raw_id = k.raw_id) as n_tokens, (select count(*) from pblks b where b.raw_id = k.raw_id) as n_blocks from kind k""",
            ["ptoks", "pblks", "ppages"],
        ),
    }
