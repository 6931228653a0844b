"""Documents as token sequences: the strategies, each a function from tokens to items.

Items have doc_id, pos (from 0), text, src (the token's tok_idx, null for layout items) and role. Strategies differ
in the order of tokens and in the layout items between them; every token comes exactly once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import scalars as S
from folia.operators import layout
from folia.operators.groups import map_groups

Strategy = Callable[..., DataFrame]
ITEM = "struct<text:string,src:int,role:string>"
OCR = "ocr_token"


def _item(text: Column | str, role: str, src: Column | None = None) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(text.alias("text"), (F.lit(None) if src is None else src).cast("int").alias("src"), F.lit(role).alias("role"))


def _some(when: Column, *items: Column) -> Column:
    return F.when(when, F.array(*items)).otherwise(F.array().cast(f"array<{ITEM}>"))


def _mark(template: str, *values: Column) -> Column:
    """A template with ``{}`` for each value."""
    parts = template.split("{}")
    return F.concat(F.lit(parts[0]), *(x for v, p in zip(values, parts[1:], strict=True) for x in (v.cast("string"), F.lit(p))))


def _by_doc() -> Window:
    return Window.partitionBy("doc_id").orderBy("tok_idx")


def _emit(tokens: DataFrame, before: list[Column], after: list[Column]) -> DataFrame:
    """Each token with items before and after it. Places are prefix sums of the numbers of items, so one sort is enough."""
    own = F.array(_item(F.col("text"), OCR, F.col("tok_idx")))
    rows = tokens.withColumn("items", F.concat(*before, own, *after))
    so_far = _by_doc().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("base", F.sum(F.size("items")).over(so_far) - F.size("items"))
    rows = rows.select("doc_id", "base", F.posexplode("items").alias("k", "i"))
    return rows.select("doc_id", (F.col("base") + F.col("k")).cast("int").alias("pos"), "i.text", "i.src", "i.role")


def _new_page() -> Column:
    last = F.lag("page").over(_by_doc())
    return last.isNull() | (last != F.col("page"))


def _page_marker(on: bool = True, template: str = "[PAGE_{}]") -> Column:
    return _some(_new_page() if on else F.lit(False), _item(_mark(template, F.col("page")), "page"))


def plain_text(tokens: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Tokens in canonical order."""
    return _emit(tokens, [], [])


def page_aware(tokens: DataFrame, blocks: DataFrame | None = None, template: str = "[PAGE_{}]") -> DataFrame:
    """A marker before the first token of a page."""
    return _emit(tokens, [_page_marker(template=template)], [])


def block_of_tokens(tokens: DataFrame, blocks: DataFrame | None) -> DataFrame:
    """Tokens with block_id filled: their own, else that of the block on their page that shares most characters with
    them, of equal ones the largest; null if there is none. Blocks meet tokens by document and page."""
    if blocks is None:
        return tokens
    lack = tokens.where("block_id is null").select("doc_id", "tok_idx", "page", "char_start", "char_end")
    some = blocks.select("doc_id", "page", F.col("block_id").alias("b_id"), F.col("char_start").alias("b_start"), F.col("char_end").alias("b_end"))
    shared = S.overlap(F.col("char_start"), F.col("char_end"), F.col("b_start"), F.col("b_end"))
    best = lack.join(some, ["doc_id", "page"]).where(shared > 0).groupBy("doc_id", "tok_idx").agg(F.max(F.struct(shared.alias("n"), "b_id")).alias("best"))
    rows = tokens.join(best, ["doc_id", "tok_idx"], "left")
    return rows.withColumn("block_id", F.coalesce("block_id", "best.b_id")).drop("best")


def block_aware(tokens: DataFrame, blocks: DataFrame | None = None, page_markers: bool = True, page_template: str = "[PAGE_{}]", template: str = "[BLOCK_{}]", unknown: str = "[BLOCK_UNK]") -> DataFrame:
    """A marker where the block changes, or the page if its markers are on."""
    rows = block_of_tokens(tokens, blocks)
    by = _by_doc()
    first = F.lag("tok_idx").over(by).isNull()
    change = first | ~F.lag("block_id").over(by).eqNullSafe(F.col("block_id"))
    if page_markers:
        change = change | _new_page()
    text = F.coalesce(_mark(template, F.col("block_id")), F.lit(unknown))
    return _emit(rows, [_page_marker(page_markers, page_template), _some(change, _item(text, "block"))], [])


def rowcol_bucket(tokens: DataFrame, blocks: DataFrame | None = None, n_buckets: int = 100, page_markers: bool = True, rows: bool = True, cols: bool = True) -> DataFrame:
    """Row and column buckets before each token."""
    f = S.box_features(n_buckets)
    parts = [_page_marker(page_markers)]
    for on, name, mark, role in ((rows, "row", "R", "row_bucket"), (cols, "col", "C", "col_bucket")):
        if on:
            parts.append(F.array(_item(F.coalesce(_mark(f"[{mark}_{{}}]", f[name]), F.lit(f"[{mark}_UNK]")), role)))
    return _emit(tokens, parts, [])


def bbox_token(tokens: DataFrame, blocks: DataFrame | None = None, n_buckets: int = 100, page: bool = True, sides: tuple[str, ...] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """Page and sides before each token; sides may also name width and height."""
    marks = {"x0": "X0", "y0": "Y0", "x1": "X1", "y1": "Y1", "width": "W", "height": "H"}
    f = S.box_features(n_buckets)
    parts = [F.array(_item(_mark("[P_{}]", F.col("page")), "page_feature"))] if page else []
    for name, mark in marks.items():
        if name in sides:
            parts.append(F.array(_item(F.coalesce(_mark(f"[{mark}_{{}}]", f[name]), F.lit(f"[{name.upper()}_UNK]")), f"bbox_{name}")))
    return _emit(tokens, parts, [])


def compact_bbox_token(tokens: DataFrame, blocks: DataFrame | None = None, n_buckets: int = 100, position: str = "prefix") -> DataFrame:
    """One item for page and box, before or after each token."""
    if position not in ("prefix", "suffix"):
        raise ValueError("position must be prefix or suffix")
    f = S.box_features(n_buckets)
    text = F.coalesce(_mark("[B_{}_{}_{}_{}_{}]", F.col("page"), *(f[s] for s in ("x0", "y0", "x1", "y1"))), F.lit("[B_UNK]"))
    one = [F.array(_item(text, "compact_bbox"))]
    return _emit(tokens, one, []) if position == "prefix" else _emit(tokens, [], one)


def lmdx_coord_suffix(tokens: DataFrame, blocks: DataFrame | None = None, n_buckets: int = 100, mode: str = "center", page_markers: bool = True, suffix: bool = True) -> DataFrame:
    """The place of each token after it: its centre's row and column, or its box."""
    if mode not in ("center", "bbox"):
        raise ValueError("mode must be center or bbox")
    f = S.box_features(n_buckets)
    names = ("row", "col") if mode == "center" else ("x0", "y0", "x1", "y1")
    text = F.coalesce(_mark("[L_{}" + "_{}" * len(names) + "]", F.col("page"), *(f[s] for s in names)), F.lit("[L_UNK]"))
    return _emit(tokens, [_page_marker(page_markers)], [F.array(_item(text, "coord_suffix"))] if suffix else [])


#: For each role of the page strategies: its text with ``{}`` for a number, and the counter that runs on over pages, if any.
_MARKS = {"page": ("[PAGE_{}]", None), "line": ("[LINE_{}]", "a"), "column": ("[COL_{}]", None), "xycut_region": ("[REGION_{}]", "a"), "field": ("[FIELD_{}]", "b"), "key": ("[KEY]", None), "value": ("[VALUE]", None)}
_SIDES = ["x0", "y0", "x1", "y1", "char_start", "text", "page_width"]


#: Names of a role's number in the attributes of items.
_ATTRS = {"line": "line_id", "column": "column_id", "xycut_region": "region_id", "field": "pair_id", "key": "pair_id", "value": "pair_id"}


def _by_page(tokens: DataFrame, work: Callable[[layout.Page], tuple[list[layout.Item], int, int]], marks: dict | None = None, attrs: bool = False) -> DataFrame:
    """Items of a strategy that works page by page; numbers that run through a document are made so afterwards, by prefix sums.
    ``attrs``: with a map of page, number and, of fields, orientation."""

    def run(key: tuple, group: dict[str, list]) -> list[tuple]:
        sides = [group[c] for c in _SIDES]
        items, a, b = work(layout.Page(*sides))
        return [(k, role, number, group["tok_idx"][t] if t >= 0 else t, group["text"][t] if t >= 0 else None, a, b) for k, (role, number, t) in enumerate(items)]

    rows = map_groups(tokens.select("doc_id", "page", "tok_idx", *_SIDES), ["doc_id", "page"], ["tok_idx"], run, "k int, role string, number int, src int, token string, a int, b int")
    by = Window.partitionBy("doc_id").orderBy("page", "k")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    before = {c: F.sum(F.when(F.col("k") == 0, F.col(c)).otherwise(0)).over(so_far) - F.col(c) for c in ("a", "b")}
    rows = rows.withColumns({"before_a": before["a"], "before_b": before["b"], "pos": F.row_number().over(by) - 1})
    text = F.col("token")
    for role, (template, counter) in (_MARKS | (marks or {})).items():
        number = F.col("page") if role == "page" else F.col("number") + (F.col(f"before_{counter}") if counter else F.lit(0))
        text = F.when(F.col("role") == role, _mark(template, number) if "{}" in template else F.lit(template)).otherwise(text)
    if attrs:
        counter = F.lit(None).cast("string")
        for role, name in _ATTRS.items():
            run_on = (_MARKS | (marks or {})).get(role, ("", None))[1] or ("b" if name == "pair_id" else None)
            number = (F.col("number") + (F.col(f"before_{run_on}") if run_on else F.lit(0))).cast("string")
            counter = F.when(F.col("role") == role, F.concat(F.lit(f"{name}="), number)).otherwise(counter)
        side = F.when(F.col("role") == "field", F.when(F.col("src") == layout.BELOW, "orientation=below").otherwise("orientation=right"))
        entries = F.concat_ws(",", F.when(F.col("role") != OCR, F.concat(F.lit("page="), F.col("page").cast("string"))), counter, side)
        made = F.when(entries != "", F.str_to_map(entries, F.lit(","), F.lit("="))).otherwise(F.create_map().cast("map<string,string>"))
        return rows.select("doc_id", "pos", text.alias("text"), F.when(F.col("src") >= 0, F.col("src")).alias("src"), "role", made.alias("attrs"))
    return rows.select("doc_id", "pos", text.alias("text"), F.when(F.col("src") >= 0, F.col("src")).alias("src"), "role")


def line_aware(tokens: DataFrame, blocks: DataFrame | None = None, y_threshold: float | None = None, attrs: bool = False) -> DataFrame:
    """Visual lines from top to bottom, a marker before each, numbered through the document."""
    return _by_page(tokens, partial(layout.line_items, threshold=y_threshold), attrs=attrs)


def column_aware(tokens: DataFrame, blocks: DataFrame | None = None, attrs: bool = False, **options: float) -> DataFrame:
    """Columns from left to right, a marker before each, numbered on each page; lines within them."""
    return _by_page(tokens, partial(layout.column_items, **options), attrs=attrs)


def xycut_aware(tokens: DataFrame, blocks: DataFrame | None = None, attrs: bool = False, **options: float) -> DataFrame:
    """Regions of a recursive XY-cut, a marker before each, numbered through the document; lines within them."""
    return _by_page(tokens, partial(layout.region_items, **options), attrs=attrs)


def precedence_graph_order(tokens: DataFrame, blocks: DataFrame | None = None, attrs: bool = False) -> DataFrame:
    """Lines in the order of a graph of what lies above or left of what."""
    return _by_page(tokens, layout.precedence_items, {"line": ("[ORDER_LINE_{}]", "a")}, attrs)


def key_value_row_pairs(tokens: DataFrame, blocks: DataFrame | None = None, attrs: bool = False, **options: float) -> DataFrame:
    """Lines with a wide gap as key and value."""
    return _by_page(tokens, partial(layout.key_row_items, **options), attrs=attrs)


def key_value_anchor_pairs(tokens: DataFrame, blocks: DataFrame | None = None, attrs: bool = False, **options: float) -> DataFrame:
    """Keys that end with a colon or equals sign, with their value to the right or below."""
    return _by_page(tokens, partial(layout.key_anchor_items, **options), attrs=attrs)


STRATEGIES: dict[str, Strategy] = {
    f.__name__: f
    for f in (plain_text, page_aware, block_aware, line_aware, rowcol_bucket, bbox_token, compact_bbox_token, lmdx_coord_suffix, column_aware, xycut_aware, precedence_graph_order, key_value_row_pairs, key_value_anchor_pairs)
}


def strategy(name: str, **options: object) -> Callable[..., DataFrame]:
    """A registered strategy with its options; register() adds one's own."""
    if name not in STRATEGIES:
        raise KeyError(f"no strategy {name!r}; there are {', '.join(sorted(STRATEGIES))}")
    return partial(STRATEGIES[name], **options)


def register(name: str, function: Strategy) -> None:
    """``function(tokens, blocks, **options)`` must return items; it may use pandas functions."""
    STRATEGIES[name] = function


# documents as prompt and JSON


def prompt(tokens: DataFrame, docs: DataFrame, annotations: DataFrame | None = None, labels: list[str] | None = None, dataset: bool = True, schema: bool = True, page_markers: bool = True, buckets: bool = False, most_tokens: int | None = None) -> DataFrame:
    """(doc_id, input_text) for extraction as JSON; docs (doc_id, dataset_name). Without ``labels``, a document's own are asked for."""
    rows = tokens if most_tokens is None else tokens.where(F.col("tok_idx") < most_tokens)
    items = page_aware(rows) if page_markers else plain_text(rows)
    if buckets:
        items = rowcol_bucket(rows, page_markers=page_markers)
    body = items.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), " ").alias("body"))
    out = docs.select("doc_id", "dataset_name").join(body, "doc_id", "left")
    asked = F.lit(", ".join(labels)) if labels else F.lit(None).cast("string")
    if labels is None and annotations is not None:
        own = annotations.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("own"))
        out, asked = out.join(own, "doc_id", "left"), F.col("own")
    head = F.concat(F.lit("Dataset: "), F.col("dataset_name")) if dataset else F.lit(None)
    fields = F.concat(F.lit("Extract the following fields as JSON:\n"), asked) if schema else F.lit(None)
    return out.select("doc_id", F.concat_ws("\n", head, fields, F.lit("Document:"), F.coalesce("body", F.lit(""))).alias("input_text"))


def json_text(c: Column) -> Column:
    """A string as JSON, non-ASCII characters as they are."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def target(annotations: DataFrame, labels: list[str] | None = None, line_items: bool = False) -> DataFrame:
    """(doc_id, target_text): gold values in their extracted form as JSON with sorted keys, a list where a key has several.
    ``line_items``: keys of line items as records by order of occurrence, under line_items."""
    rows = annotations if labels is None else annotations.where(F.col("label").isin(labels))
    rows = rows.select("doc_id", S.label_key(F.col("label")).alias("key"), json_text(S.extracted_form(F.col("label"), F.col("text"))).alias("v"), F.struct("char_start", "char_end", "label", "ann_idx").alias("o"))
    is_item = F.startswith("key", F.lit("line_item_"))
    plain = rows.where(~is_item) if line_items else rows
    values = F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda p: p["v"])
    one = F.when(F.size(values) == 1, F.element_at(values, 1)).otherwise(F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]")))
    pairs = plain.groupBy("doc_id", "key").agg(one.alias("v"))
    if line_items:
        rank = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("o"))
        cells = rows.where(is_item).select("doc_id", F.regexp_replace("key", "^line_item_", "").alias("key"), "v", rank.alias("r"))
        records = cells.groupBy("doc_id", "r").agg(_object().alias("v"))
        lists = records.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda p: p["v"]), ", "), F.lit("]")).alias("v"))
        pairs = pairs.unionByName(lists.select("doc_id", F.lit("line_items").alias("key"), "v"))
    return pairs.groupBy("doc_id").agg(_object().alias("target_text"))


def _object() -> Column:
    """Columns key and v of a group as a JSON object with sorted keys."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("key", "v"))), lambda p: F.concat(F.lit('"'), p["key"], F.lit('": '), p["v"]))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
