"""Label, value and geometry functions as Column expressions, all inside code generation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of a label's key that make it a label of money or of a date.
MONEY_PARTS = ["amount", "balance", "commission", "cost", "fee", "gross", "net", "price", "rate", "subtotal", "tax", "total", "value"]
DATE_PARTS = ["date", "start_date", "end_date", "effective_date", "expiration_date"]
# Label spellings that stand for another.
LABEL_ALIASES = {"Line Item - Start Data": "Line Item - Start Date", "line item - start data": "Line Item - Start Date"}
# What a number looks like, what tables leave behind one, and signs that are written as others.
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
IN_PARENTHESES, SIGNED = rf"\(\s*\$?\s*{NUMBER}\s*\)", rf"[-+]?\$?\s*{NUMBER}"
LEFT_BEHIND = (r"(?i)p-\d+$", r"(?i)p\d+$")
SIGNS, PLAIN_SIGNS = "‹›–—", "<>--"
# White space of Unicode and the four separators that count as such.
BLANKS = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def squash(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def title_label(label: Column) -> Column:
    """A label with blanks for underscores and every run of letters capitalised."""
    parts = F.regexp_extract_all(F.replace(F.trim(label), F.lit("_"), F.lit(" ")), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "")


def json_marker(value: Column) -> Column:
    """A JSON text with sorted keys, so that equal values are equal texts; what isn't JSON is its own marker."""
    return F.coalesce(F.to_json(F.try_parse_json(value)), value)


def unique_values(values: Column) -> Column:
    """An array of JSON texts without those that are equal to an earlier one, in order."""
    markers = F.transform(values, json_marker)
    return F.filter(values, lambda v, k: (k == 0) | ~F.array_contains(F.slice(markers, F.lit(1), F.greatest(k, F.lit(1))), F.coalesce(json_marker(v), F.lit(""))))


def label_key(c: Column) -> Column:
    """A label as a lower-case key of letters, digits and single underscores; ``&`` reads ``and``."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(squash(c), "&", " and "), "[^0-9A-Za-z]+", "_"), F.lit("_")))


def label_name(c: Column, aliases: dict[str, str] | None = None, as_key: bool = False) -> Column:
    """A label in its usual spelling, aliases resolved."""
    aliases = LABEL_ALIASES if aliases is None else aliases
    clean = squash(c)
    if aliases:
        table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in aliases.items()))
        clean = F.coalesce(F.try_element_at(table, clean), clean)
    return label_key(clean) if as_key else clean


def bio(prefix: Column | str, key: Column) -> Column:
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.lit("-"), key)


def normal_bio(label: Column) -> Column:
    """A BIO label with its name as a key; null if it is no BIO label."""
    ok = label.rlike("^[BI]-")
    return F.when(label == "O", label).when(ok, bio(F.substring(label, 1, 1), label_key(F.substring(label, 3, 1 << 30))))


def bio_prefix(label: Column, strict: bool) -> Column:
    """B or I of a label with an entity, else null. Not ``strict``: any other prefix counts as B."""
    has = F.instr(label, "-") > 0
    prefix = F.substring_index(label, "-", 1)
    entity = bio_entity_raw(label)
    if strict:
        return F.when(has & prefix.isin("B", "I") & (F.length(entity) > 0), prefix)
    return F.when(has & (F.length(entity) > 0), F.when(prefix == "I", "I").otherwise("B"))


def bio_entity_raw(label: Column) -> Column:
    """What follows the first hyphen."""
    return F.substring(label, F.instr(label, "-") + 1, F.length(label))


def bio_entity(label: Column, strict: bool) -> Column:
    """The entity of a BIO label, null for O and for what isn't one."""
    return F.when(bio_prefix(label, strict).isNotNull(), bio_entity_raw(label))


def is_line_item(label: Column) -> Column:
    return F.startswith(label_key(label), F.lit("line_item_"))


def without_line_item(label: Column) -> Column:
    return F.regexp_replace(label_key(label), "^line_item_", "")


def compact(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def is_money(label: Column) -> Column:
    return label_key(label).rlike("|".join(MONEY_PARTS))


def is_date(label: Column) -> Column:
    return label_key(label).rlike("|".join(DATE_PARTS))


def without_ocr_suffix(c: Column) -> Column:
    """Without the marks that tables leave behind numbers: ``$150.00P-2`` is ``$150.00``."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), LEFT_BEHIND[0], ""), LEFT_BEHIND[1], ""))


def first_number(c: Column) -> Column:
    """The first thing like a number; in parentheses it is negative, and such come first. Null if none."""
    bare = lambda pattern, drop: F.nullif(F.regexp_replace(F.regexp_extract(c, pattern, 0), drop, ""), F.lit(""))
    paren = bare(IN_PARENTHESES, r"[()$\s]")
    return F.coalesce(F.concat(F.lit("-"), paren), bare(SIGNED, r"[+$\s]"))


def money(c: Column, keep_commas: bool = False) -> Column:
    """A value of money as plain digits; a value without a number loses ``$`` and commas only."""
    text = without_ocr_suffix(squash(c))
    value = F.coalesce(first_number(text), F.trim(F.regexp_replace(F.replace(text, F.lit("$"), F.lit("")), LEFT_BEHIND[0], "")))
    return value if keep_commas else F.replace(value, F.lit(","), F.lit(""))


def decimal_text(c: Column) -> Column:
    """money() as the text of a decimal number, with the places it is written with; other text stays."""
    text = money(c)
    plain = F.regexp_replace(F.regexp_replace(text, r"^(-?)0+(?=\d)", "$1"), r"^\+", "")
    return F.when(text.rlike(r"^[-+]?\d+(\.\d+)?$"), plain).otherwise(text)


def date_text(c: Column) -> Column:
    """Dates stay text, without blanks."""
    return F.replace(squash(c), F.lit(" "), F.lit(""))


def plain_text(c: Column) -> Column:
    """White space squashed, angle quotes and long dashes in ASCII."""
    return F.trim(F.translate(squash(c), SIGNS, PLAIN_SIGNS))


def matching_form(label: Column, value: Column) -> Column:
    """What gold and token text are compared by; money comes before date; null is empty."""
    return form_by_kind(is_money(label), is_date(label), value)


def form_by_kind(of_money: Column, of_date: Column, value: Column) -> Column:
    """matching_form where the label's kind is known."""
    form = F.when(of_money, money(value)).when(of_date, compact(date_text(value))).otherwise(compact(plain_text(value)))
    return F.when(value.isNull(), "").otherwise(form)


def extracted_form(label: Column, value: Column) -> Column:
    form = F.when(is_money(label), money(value)).when(is_date(label), date_text(value)).otherwise(plain_text(value))
    return F.when(value.isNull(), "").otherwise(form)


def loose_match(label: Column, gold: Column, token: Column) -> Column:
    """Whether one form holds the other; an empty one matches an empty one only."""
    return forms_match(matching_form(label, gold), matching_form(label, token))


def forms_match(a: Column, b: Column) -> Column:
    """loose_match of two matching forms."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), a == b).otherwise(F.contains(a, b) | F.contains(b, a))


def exact_match(label: Column, gold: Column, predicted: Column) -> Column:
    return extracted_form(label, gold) == extracted_form(label, predicted)


# geometry


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def normal_side(side: Column, size: Column, scale: int = 1000) -> Column:
    """A pixel place as a part of ``scale``, rounded half to even; null without a page size."""
    return F.when(size > 0, clamp(F.rint(side * F.lit(float(scale)) / size).cast("int"), 0, scale))


def real_side(side: Column, size: Column, scale: int = 1000) -> Column:
    """The inverse of normal_side."""
    return F.rint(side * size / F.lit(float(scale))).cast("int")


def bucket(value: Column, n: int = 100, scale: int = 1000) -> Column:
    return clamp((value * n / F.lit(float(scale))).cast("int"), 0, n - 1)


def normal_box(prefix: str = "") -> dict[str, Column]:
    """The four sides on the scale of 1000, from columns x0, y0, x1, y1, page_width, page_height; all null if any is."""
    w, h = F.col(f"{prefix}page_width"), F.col(f"{prefix}page_height")
    known = (w > 0) & (h > 0)
    return {s: F.when(known, normal_side(F.col(f"{prefix}{s}"), w if s[0] == "x" else h)) for s in ("x0", "y0", "x1", "y1")}


def box_features(n: int = 100) -> dict[str, Column]:
    """Buckets of the sides, width, height and centre of a token; all null without a page size."""
    box = normal_box()
    out = {s: bucket(v, n) for s, v in box.items()}
    out["width"] = bucket(F.greatest(F.lit(0), box["x1"] - box["x0"]), n)
    out["height"] = bucket(F.greatest(F.lit(0), box["y1"] - box["y0"]), n)
    out["row"] = bucket(F.floor((box["y0"] + box["y1"]) / 2).cast("int"), n)
    out["col"] = bucket(F.floor((box["x0"] + box["x1"]) / 2).cast("int"), n)
    known = (F.col("page_width") > 0) & (F.col("page_height") > 0)
    return {k: F.when(known, v) for k, v in out.items()}


def raw_buckets(n: int = 100) -> dict[str, Column]:
    """Row and column of the centre in pixels, not clamped."""
    cy, cx = (F.col("y0") + F.col("y1")) / 2.0, (F.col("x0") + F.col("x1")) / 2.0
    return {"row": F.try_divide(cy * n, F.col("page_height")).cast("int"), "col": F.try_divide(cx * n, F.col("page_width")).cast("int")}


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes a.x0 .. a.y1 and b.x0 .. b.y1; 0 for boxes without area."""
    side = lambda t, s: F.col(f"{t}.{s}")
    area = lambda t: F.greatest(F.lit(0), side(t, "x1") - side(t, "x0")) * F.greatest(F.lit(0), side(t, "y1") - side(t, "y0"))
    inter = overlap(side(a, "x0"), side(a, "x1"), side(b, "x0"), side(b, "x1")) * overlap(side(a, "y0"), side(a, "y1"), side(b, "y0"), side(b, "y1"))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


# The layout token of each role of a layout item; any other role is [LAYOUT_UNKNOWN].
ROLE_TOKENS = {
    "page": "[LAYOUT_PAGE]",
    "page_feature": "[LAYOUT_PAGE]",
    "block": "[LAYOUT_BLOCK]",
    "line": "[LAYOUT_LINE]",
    "row_bucket": "[LAYOUT_ROW]",
    "col_bucket": "[LAYOUT_COL]",
    "bbox_x0": "[LAYOUT_X0]",
    "bbox_y0": "[LAYOUT_Y0]",
    "bbox_x1": "[LAYOUT_X1]",
    "bbox_y1": "[LAYOUT_Y1]",
    "bbox_width": "[LAYOUT_WIDTH]",
    "bbox_height": "[LAYOUT_HEIGHT]",
    "column": "[LAYOUT_COLUMN]",
    "xycut_region": "[LAYOUT_REGION]",
    "coord_suffix": "[LAYOUT_COORD]",
    "compact_bbox": "[LAYOUT_BBOX]",
    "field": "[LAYOUT_FIELD]",
    "key": "[LAYOUT_KEY]",
    "value": "[LAYOUT_VALUE]",
}


def layout_token(role: Column) -> Column:
    """The one token of a bounded vocabulary that stands for a layout role."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ROLE_TOKENS.items()))
    return F.coalesce(F.try_element_at(table, role), F.lit("[LAYOUT_UNKNOWN]"))


def safe_name(c: Column) -> Column:
    """A name that may stand in a path: all but letters, digits, ``-``, ``_`` and ``.`` becomes ``_``."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}\-_.]", "_")
