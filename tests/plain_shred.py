"""A payload at a time, by parsing: the brute force that shred is held against."""

import ast
import json


def lists(v):
    if isinstance(v, dict):
        return {k: lists(x) for k, x in v.items()}
    return [lists(x) for x in v] if isinstance(v, (list, tuple)) else v


def parse(text):
    for read in (json.loads, lambda t: ast.literal_eval(t.strip())):
        try:
            return lists(read(text))
        except (ValueError, SyntaxError, TypeError, MemoryError):
            pass
    return None


def number(v):
    if isinstance(v, bool) or v is None:
        return None
    try:
        v = float(v)
    except (TypeError, ValueError):
        return None
    return v if abs(v) < float("inf") else None


def whole(v):
    v = number(v)
    return int(v) if v is not None and v == int(v) else None


def get(d, *names):
    return next((d[n] for n in names if isinstance(d, dict) and d.get(n) is not None), None)


def items(v):
    return [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []


def unit_entry(e):
    doc, pos = get(e, "doc_offset"), get(e, "position")
    rng = whole(get(doc, "start")), whole(get(doc, "end"))
    box = [number(get(pos, *n)) for n in (("left", "bbLeft", "x0"), ("top", "bbTop", "y0"), ("right", "bbRight", "x1"), ("bottom", "bbBot", "y1"))]
    page = whole(get(e, "page_num"))
    return None if None in rng or None in box else (0 if page is None else page, *rng)


def form_entry(e, page):
    segments, segment, doc = get(e, "segments"), get(e, "segment"), get(e, "doc_offset")
    pair = lambda v: isinstance(v, list) and len(v) == 2
    if isinstance(segments, list) and segments and pair(segments[0]):
        rng = segments[0][:2]
    elif pair(segment):
        rng = segment[:2]
    else:
        rng = get(doc, "start"), get(doc, "end")
    rng = tuple(map(whole, rng))
    box = get(e, "bbox")
    if not isinstance(box, list) or len(box) not in (4, 5) or None in [number(x) for x in box[len(box) - 4 :]] or None in rng:
        return None
    return (page, *rng)


def token_links(text):
    """[(tok_no, page_no, block_id)] of one payload."""
    v = parse(text) if text is not None else None
    tokens, blocks = [], []
    if isinstance(v, dict) and get(v, "ocr_boxes") is not None:
        ok = [b for b in items(v["ocr_boxes"]) if isinstance(b.get("text"), (str, int, float)) and not isinstance(b["text"], bool) and str(b["text"]).strip() and isinstance(b.get("points"), list) and len(b["points"]) >= 4]
        return [(k, 0, k) for k in range(len(ok))]
    if isinstance(v, list) or (isinstance(v, dict) and (get(v, "tokens") is not None or get(v, "blocks") is not None)):
        for unit in items(v) if isinstance(v, list) else [v]:
            tokens += map(unit_entry, items(get(unit, "tokens")))
            blocks += map(unit_entry, items(get(unit, "blocks")))
    elif isinstance(v, dict):
        for k, page in enumerate(v["pages"] if isinstance(v.get("pages"), list) else []):
            if isinstance(page, dict):
                no = whole(get(page, "page_id", "page_num"))
                no = k if no is None else no
                tokens += [form_entry(e, no) for e in items(get(page, "tokens"))]
                for field in ("lines", "paragraphs"):
                    blocks += [form_entry(e, no) for e in items(get(page, field))]
    tokens, blocks = [t for t in tokens if t], [b for b in blocks if b]
    return [(k, p, next((j for j, (q, x, y) in enumerate(blocks) if q == p and x <= s and e <= y), -1)) for k, (p, s, e) in enumerate(tokens)]
