"""Layout by page as SQL for DuckDB: recursion over tokens, lines and regions."""

from __future__ import annotations


def line_parts(name: str, source: str, keys: str, order: str, reach: str, middle: str, inner: str) -> dict[str, str]:
    """Parts <name>o, <name>r and <name>: rows of ``source`` with ``line_no`` and place ``m`` in it, for each value of ``keys``.

    Rows in ``order`` join the oldest line whose mean of ``middle`` is within ``reach``; lines are numbered by mean and the first
    of ``inner``, the order within a line.
    """
    same = " and ".join(f"r.{k} is not distinct from o.{k}" for k in keys.split(", "))
    own = ", ".join(f"r.{k}" for k in keys.split(", "))
    return {
        f"{name}o": f"select *, ({middle})::double as mid, ({reach})::double as reach, row_number() over (partition by {keys} order by {order}) as k, count(*) over (partition by {keys}) as n from {source}",
        f"{name}r": f"""select {keys}, 0::bigint as k, []::double[] as sums, []::bigint[] as cnts, []::bigint[] as own from {name}o where k = 1
            union all select {keys}, k + 1, case when i is null then list_append(sums, mid) else list_concat(list_append(sums[:i - 1], sums[i] + mid), sums[i + 1:]) end,
            case when i is null then list_append(cnts, 1) else list_concat(list_append(cnts[:i - 1], cnts[i] + 1), cnts[i + 1:]) end, list_append(own, coalesce(i, len(sums) + 1))
            from (select {own}, r.k, r.sums, r.cnts, r.own, o.mid, nullif(list_position(list_transform(range(1, len(r.sums) + 1), lambda j: abs(r.sums[j] / r.cnts[j] - o.mid) <= o.reach), true), 0) as i from {name}r r join {name}o o on {same} and o.k = r.k + 1)""",
        f"{name}m": f"select o.*, r.own[o.k] as made from {name}o o join {name}r r on {same} and r.k = o.n",
        f"{name}k": f"select {keys}, made, sum(mid) / count(*) as mean, arg_min(x0, ({inner}, k)) as head from {name}m group by {keys}, made",
        f"{name}n": f"select *, row_number() over (partition by {keys} order by mean, head, made) - 1 as line_no from {name}k",
        name: f"select o.*, r.line_no, row_number() over (partition by {', '.join('o.' + k for k in keys.split(', '))}, r.line_no order by {', '.join('o.' + c for c in inner.split(', '))}, o.k) as m from {name}m o join {name}n r on {same} and r.made = o.made",
    }


def _gaps(name: str, source: str, keys: str, axis: str, least: str, by: str = "") -> str:
    """The widest gap of each region: keys, gap, cut; regions without a gap that is wide enough, and with 8 tokens or more on either side, lack."""
    a, b = f"{axis}0", f"{axis}1"
    return f"""select {keys}, arg_max(gap, (gap, -{a})) as gap, arg_max(cut, (gap, -{a})) as cut from (
        select g.*, (select count(*) from {source} t where {' and '.join(f't.{k} = g.{k}' for k in keys.split(', '))} and (t.{a} + t.{b}) / 2.0 < g.cut) as low from (
            select *, {a} - reached as gap, (reached + {a}) / 2.0 as cut from (select *, max({b}) over (partition by {keys} order by {a}, {b} rows between unbounded preceding and 1 preceding) as reached, count(*) over (partition by {keys}) as size from {source}) where {a} > reached) g
        where size >= 16 and gap >= {least}) where low >= 8 and low <= size - 8 group by {keys}"""


def column_parts() -> dict[str, str]:
    """Part colt: tokens with ``col``, the place of their column from the left."""
    parts = {
        "colw": """select doc_id, page, w, greatest(w * 0.08::double, mw * 2.0::double, w * 0.02::double) as least from (select doc_id, page, coalesce(arg_min(page_width, (char_start, y0, x0)) filter (page_width > 0), max(x1) - min(x0)) as w, median(greatest(1, x1 - x0)) as mw from tok group by 1, 2)""",
        "col0": "select t.*, 0 as reg, least from tok t join colw w on t.doc_id = w.doc_id and t.page = w.page",
    }
    for k in range(3):
        parts |= {
            f"colg{k}": _gaps("", f"col{k}", "doc_id, page, reg", "x", "least"),
            f"colc{k}": f"select g.*, row_number() over (partition by g.doc_id, g.page order by gap desc, left_side, g.reg) as best from colg{k} g join (select doc_id, page, reg, min(x0) as left_side from col{k} group by 1, 2, 3) s on g.doc_id = s.doc_id and g.page = s.page and g.reg = s.reg",
            f"col{k + 1}": f"select t.* exclude (reg), case when c.cut is null then t.reg when (t.x0 + t.x1) / 2.0 < c.cut then {2 * k + 1} else {2 * k + 2} end as reg from col{k} t left join (select * from colc{k} where best = 1) c on t.doc_id = c.doc_id and t.page = c.page and t.reg = c.reg",
        }
    parts["colt"] = "select t.*, col from col3 t join (select doc_id, page, reg, row_number() over (partition by doc_id, page order by min(x0), max(x1)) - 1 as col from col3 group by 1, 2, 3) s on t.doc_id = s.doc_id and t.page = s.page and t.reg = s.reg"
    return parts


def region_parts() -> dict[str, str]:
    """Part xyt: tokens with ``reg``, the number of their region; part xyn: all regions."""
    parts = {"xy0": "select *, '' as path from tok"}
    for k in range(6):
        box = f"(select doc_id, page, path, greatest(1, max(x1) - min(x0)) as w, greatest(1, max(y1) - min(y0)) as h from xy{k} group by 1, 2, 3)"
        parts[f"xyb{k}"] = f"select t.*, w, h, w * 0.06::double as lx, h * 0.035::double as ly from xy{k} t join {box} b on t.doc_id = b.doc_id and t.page = b.page and t.path = b.path where length(t.path) = {k}"
        parts[f"xyx{k}"] = _gaps("", f"xyb{k}", "doc_id, page, path", "x", "lx")
        parts[f"xyy{k}"] = _gaps("", f"xyb{k}", "doc_id, page, path", "y", "ly")
        parts[f"xyc{k}"] = f"""select b.doc_id, b.page, b.path, case when y.gap is null then true when x.gap is null then false else not (y.gap / h >= 0.85::double * (x.gap / w)) end as across, x.cut as cx, y.cut as cy
            from (select distinct doc_id, page, path, w, h from xyb{k}) b left join xyx{k} x on b.doc_id = x.doc_id and b.page = x.page and b.path = x.path left join xyy{k} y on b.doc_id = y.doc_id and b.page = y.page and b.path = y.path where x.gap is not null or y.gap is not null"""
        parts[f"xy{k + 1}"] = f"""select t.* exclude (path), case when c.path is null then t.path when case when across then (x0 + x1) / 2.0 < cx else (y0 + y1) / 2.0 < cy end then t.path || '0' else t.path || '1' end as path
            from xy{k} t left join xyc{k} c on t.doc_id = c.doc_id and t.page = c.page and t.path = c.path"""
    paths = " union ".join([f"select doc_id, page, path from xy{k}" for k in range(7)])
    parts["xyn"] = f"select *, row_number() over (partition by doc_id, page order by path) - 1 as reg from ({paths})"
    parts["xyt"] = "select t.*, n.reg from xy6 t join xyn n on t.doc_id = n.doc_id and t.page = n.page and t.path = n.path"
    return parts


#: Lines of a page with box, first start, number of tokens and place of the first colon.
_LINE = """select doc_id, page, line_no, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, min(char_start) as s, count(*) as size,
    min(m) filter (regexp_matches(trim(text), ':$') or trim(text) = '=') as colon from ln group by 1, 2, 3"""


def parts() -> dict[str, str]:
    made = line_parts("ln", "tok", "doc_id, page", "y0, x0, char_start, tok_idx", "greatest(6.0, greatest(0, y1 - y0) * 0.6::double)", "(y0 + y1) / 2.0", "x0, char_start")
    made |= column_parts() | region_parts()
    made |= line_parts("cl", "colt", "doc_id, page, col", "y0, x0, char_start, tok_idx", "greatest(6.0, greatest(0, y1 - y0) * 0.6::double)", "(y0 + y1) / 2.0", "x0, char_start")
    made |= line_parts("xl", "xyt", "doc_id, page, reg", "y0, x0, char_start, tok_idx", "greatest(6.0, greatest(0, y1 - y0) * 0.6::double)", "(y0 + y1) / 2.0", "x0, char_start")
    made["box"] = _LINE
    wide, shared = "least(a.x1, b.x1) > greatest(a.x0, b.x0)", "greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
    level = f"{shared} * 2 >= greatest(1, least(a.y1 - a.y0, b.y1 - b.y0))"
    made["edge"] = f"""select a.doc_id, a.page, a.line_no as a, b.line_no as b from box a join box b on a.doc_id = b.doc_id and a.page = b.page and a.line_no <> b.line_no
        and (({wide} and b.y0 >= a.y1 and not (b.line_no < a.line_no and b.y1 <= a.y0)) or (not ({wide}) and {level} and b.x0 >= a.x1 and not (b.line_no < a.line_no and b.x1 <= a.x0)))"""
    made["pre"] = "select b.doc_id, b.page, list({'n': line_no, 'y': y0, 'x': x0, 's': s, 'pre': coalesce(pre, [])}) as lines, count(*) as n from box b left join (select doc_id, page, b, list(a) as pre from edge group by 1, 2, 3) e on b.doc_id = e.doc_id and b.page = e.page and b.line_no = e.b group by 1, 2"
    made["topo"] = """select doc_id, page, lines, n, []::bigint[] as done from pre union all select doc_id, page, lines, n, list_append(done, list_sort(list_transform(list_filter(lines, lambda l: not list_contains(done, l.n)),
        lambda l: {'held': len(list_filter(l.pre, lambda q: not list_contains(done, q))) > 0, 'y': l.y, 'x': l.x, 's': l.s, 'n': l.n}))[1].n) from topo where len(done) < n"""
    made["anc0"] = "select doc_id, page, list({'n': line_no, 'x0': x0, 'y0': y0, 'y1': y1, 'size': size, 'c': colon} order by line_no) as lines, count(*) as n from box group by 1, 2"
    made["anc"] = """select doc_id, page, lines, n, 0::bigint as k, []::bigint[] as used, []::struct(n bigint, c bigint, below bigint)[] as made from anc0
        union all select doc_id, page, lines, n, k + 1, case when below is not null then list_append(used, below) else used end,
            case when taken then made else list_append(made, {'n': k, 'c': case when l.c < l.size or below is not null then l.c end, 'below': below}) end
        from (select *, case when not taken and l.c = l.size then list_sort(list_transform(list_filter(lines, lambda o: o.n > k and not list_contains(used, o.n) and o.y0 - l.y1 >= 0 and o.y0 - l.y1 <= 4 * greatest(1, l.y1 - l.y0) and abs(o.x0 - l.x0) <= 3 * greatest(1, l.y1 - l.y0)),
            lambda o: {'g': o.y0 - l.y1, 'a': abs(o.x0 - l.x0), 'n': o.n}))[1].n end as below from (select *, lines[k + 1] as l, list_contains(used, k) as taken from anc where k < n))"""
    made["pair"] = "select doc_id, page, unnest(made, recursive := true) from anc where k = n"
    made["gap"] = """select doc_id, page, line_no, arg_max(m - 1, (g, -m)) as c, max(g) as g, coalesce(arg_min(page_width, m) filter (page_width > 0), max(x1) - min(x0)) as w, median(greatest(1, y1 - y0)) as h
        from (select *, x0 - lag(x1) over (partition by doc_id, page, line_no order by m) as g from ln) group by 1, 2, 3"""
    made["lit"] = "select doc_id, page, token_start, label, text, x0, (y0 + y1) / 2.0 as y from span where label like 'line\\_item\\_%' escape '\\' and page is not null"
    made |= line_parts("li", "lit", "doc_id, page", "y, x0, token_start", "12.0", "y", "x0")
    return made


NEEDS = {
    **{f"{p}{s}": [f"{p}{b}"] for p in ("ln", "cl", "xl", "li") for s, b in (("r", "o"), ("m", "r"), ("k", "m"), ("n", "k"), ("", "n"))},
    "lno": ["tok"], "clo": ["colt"], "xlo": ["xyt"], "lio": ["lit"], "lit": ["span"], "colw": ["tok"], "col0": ["colw"], "xy0": ["tok"], "colt": ["col3"], "xyn": ["xy6"], "xyt": ["xyn"],
    **{f"col{k + 1}": [f"colc{k}"] for k in range(3)}, **{f"colc{k}": [f"colg{k}"] for k in range(3)}, **{f"colg{k}": [f"col{k}"] for k in range(3)},
    **{f"xy{k + 1}": [f"xyc{k}"] for k in range(6)}, **{f"xyc{k}": [f"xyx{k}", f"xyy{k}"] for k in range(6)}, **{f"xy{a}{k}": [f"xyb{k}"] for a in "xy" for k in range(6)}, **{f"xyb{k}": [f"xy{k}"] for k in range(6)},
    "box": ["ln"], "edge": ["box"], "pre": ["edge"], "topo": ["pre"], "anc0": ["box"], "anc": ["anc0"], "pair": ["anc"], "gap": ["ln"],
}


def _numbered(rows: str) -> str:
    """rows (doc_id, page, a, b, m, text, src, role) with pos: pages, then groups a and b, then places m, in order."""
    return f"select doc_id, (row_number() over (partition by doc_id order by page, a, b, m) - 1)::int as pos, text, src, role from ({rows})"


_PAGE = "select distinct doc_id, page, -1 as a, 0 as b, 0 as m, '[PAGE_' || page || ']' as text, null::int as src, 'page' as role from tok"


def statements() -> dict[str, tuple[str, list[str]]]:
    """Name -> (statement, the parts that it needs)."""
    out: dict[str, tuple[str, list[str]]] = {}
    through = "dense_rank() over (partition by doc_id order by page, line_no) - 1"
    lines = f"{_PAGE} union all select distinct doc_id, page, line_no, 0, 0, '[LINE_' || ({through}) || ']', null, 'line' from ln union all select doc_id, page, line_no, 0, m, text, tok_idx, 'ocr_token' from ln"
    out["ser_line_aware"] = _numbered(lines), ["ln"]
    inner = "row_number() over (partition by doc_id, page, {k} order by line_no, m)"
    out["ser_column_aware"] = _numbered(f"{_PAGE} union all select distinct doc_id, page, col, 0, 0, '[COL_' || col || ']', null, 'column' from cl union all select doc_id, page, col, 0, {inner.format(k='col')}, text, tok_idx, 'ocr_token' from cl"), ["cl"]
    run_on = "(select doc_id, page, reg, row_number() over (partition by doc_id order by page, reg) - 1 as no from xyn)"
    out["ser_xycut_aware"] = _numbered(f"{_PAGE} union all select distinct x.doc_id, x.page, x.reg, 0, 0, '[REGION_' || no || ']', null, 'xycut_region' from xl x join {run_on} n on x.doc_id = n.doc_id and x.page = n.page and x.reg = n.reg union all select doc_id, page, reg, 0, {inner.format(k='reg')}, text, tok_idx, 'ocr_token' from xl"), ["xl"]
    place = "(select doc_id, page, unnest(done) as line_no, generate_subscripts(done, 1) - 1 as spot from topo where len(done) = n)"
    out["ser_precedence_graph_order"] = _numbered(f"""{_PAGE} union all select doc_id, page, spot, 0, 0, '[ORDER_LINE_' || (row_number() over (partition by doc_id order by page, spot) - 1) || ']', null, 'line' from {place}
        union all select l.doc_id, l.page, spot, 0, m, text, tok_idx, 'ocr_token' from ln l join {place} p on l.doc_id = p.doc_id and l.page = p.page and l.line_no = p.line_no"""), ["ln", "topo"]  # fmt: skip

    def pairs(cut: str, own: str) -> str:
        """Lines with key and value: ``cut`` (doc_id, page, line_no, c, vals), c null for plain lines; ``own`` gives tokens with line_no, side and m."""
        line = "(select doc_id, page, line_no, row_number() over (partition by doc_id order by page, line_no) - 1 as no from box)"
        return f"""{_PAGE} union all select c.doc_id, c.page, c.line_no, 0, 0, '[LINE_' || no || ']', null, 'line' from ({cut}) c join {line} b on c.doc_id = b.doc_id and c.page = b.page and c.line_no = b.line_no
            union all select doc_id, page, line_no, 1, k, case k when 1 then '[FIELD_' || no || ']' else '[KEY]' end, null, case k when 1 then 'field' else 'key' end from (select *, unnest([1, 2]) as k from (select *, row_number() over (partition by doc_id order by page, line_no) - 1 as no from ({cut}) where c is not null))
            union all select doc_id, page, line_no, 3, 0, '[VALUE]', null, 'value' from ({cut}) where c is not null
            union all select doc_id, page, line_no, side, m, text, tok_idx, 'ocr_token' from ({own})"""

    cut = "select doc_id, page, line_no, case when g >= greatest(w * 0.04::double, h * 2.0::double) then c end as c from gap"
    own = f"select l.doc_id, l.page, l.line_no, case when c.c is null or l.m <= c.c then 2 else 4 end as side, l.m, text, tok_idx from ln l join ({cut}) c on l.doc_id = c.doc_id and l.page = c.page and l.line_no = c.line_no"
    out["ser_key_value_row_pairs"] = _numbered(pairs(cut, own)), ["gap", "box"]
    cut = "select doc_id, page, n as line_no, c from pair"
    own = """select l.doc_id, l.page, l.line_no, case when p.c is null or l.m <= p.c then 2 else 4 end as side, l.m, text, tok_idx from ln l join pair p on l.doc_id = p.doc_id and l.page = p.page and l.line_no = p.n
        union all select l.doc_id, l.page, p.n, 4, l.m, text, tok_idx from ln l join pair p on l.doc_id = p.doc_id and l.page = p.page and l.line_no = p.below"""
    out["ser_key_value_anchor_pairs"] = _numbered(pairs(cut, own)), ["pair", "box"]
    out["line_item_rows"] = "select doc_id, page, line_no::int as row_no, (m - 1)::int as cell_no, label, text from (select doc_id, page, made - 1 as line_no, row_number() over (partition by doc_id, page, made order by x0, k) as m, label, text from lim)", ["lim"]
    return out
