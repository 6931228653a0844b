import json
import random
import time

import numpy as np
import plain_shred
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folia.operators import shred


def fast(texts):
    """{row: [(tok_no, page_no, block_id)]} by the operator's own path."""
    out = {k: [] for k in range(len(texts))}
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["a", "b"])
    for ids, made in shred._parts(iter([batch])):
        rows = ids.take(pa.array(made.tokens.row)).to_pylist()
        for r, *x in zip(rows, made.tokens.number().tolist(), made.tokens.page.tolist(), made.block_of.tolist(), strict=True):
            out[r].append(tuple(x))
    return out


def check(texts):
    got = fast(texts)
    for k, t in enumerate(texts):
        assert got[k] == plain_shred.token_links(t), t


number = st.one_of(st.integers(0, 60), st.integers(0, 60).map(str), st.floats(0, 60).map(lambda v: round(v, 2)), st.none(), st.just("n/a"), st.just("7.0"))
word = st.one_of(st.text(max_size=6), st.sampled_from(["it's", 'a "q"', "'\"", "\\", "a\\", "{[,:]}", "é\n", " ", "\t", "null", " "]))
span = st.fixed_dictionaries({}, optional={"start": number, "end": number})
side = st.sampled_from(["left", "bbLeft", "x0", "top", "bbTop", "y0", "right", "bbRight", "x1", "bottom", "bbBot", "y1"])
full = st.fixed_dictionaries({"left": number, "top": number, "right": number, "bottom": number})
extra = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), word), lambda x: st.one_of(st.lists(x, max_size=2), st.dictionaries(word, x, max_size=2)), max_leaves=4)
unit_entry = st.fixed_dictionaries({}, optional={"text": word, "doc_offset": st.one_of(span, st.none()), "position": st.one_of(full, st.dictionaries(side, number)), "page_num": number, "style": extra})
box = st.one_of(st.none(), st.lists(st.one_of(number, st.floats(0, 1)), max_size=6))
form_entry = st.fixed_dictionaries({"bbox": box}, optional={"text": word, "segments": st.one_of(st.none(), st.lists(st.lists(number, max_size=3), max_size=2)), "segment": st.lists(number, max_size=3), "doc_offset": span})
entries = lambda e: st.one_of(st.none(), st.lists(st.one_of(e, extra), max_size=4))
unit = st.fixed_dictionaries({}, optional={"pages": entries(extra), "tokens": entries(unit_entry), "blocks": entries(unit_entry)})
form = st.fixed_dictionaries({"pages": st.lists(st.one_of(extra, st.fixed_dictionaries({}, optional={"page_id": number, "page_num": number, "tokens": entries(form_entry), "lines": entries(form_entry), "paragraphs": entries(form_entry)})), max_size=3)})
boxes = st.fixed_dictionaries({"ocr_boxes": entries(st.fixed_dictionaries({}, optional={"text": st.one_of(word, st.none(), st.integers(0, 9), st.booleans()), "points": st.one_of(st.none(), st.lists(st.lists(st.integers(0, 9), min_size=2, max_size=2), max_size=6))}))})
payload = st.one_of(unit, st.lists(unit, max_size=3), form, boxes, extra)


def spell(value, style):
    if style == 0:
        return json.dumps(value)
    if style == 1:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    if style == 2:
        return " " + json.dumps(value, indent=1) + "\n"
    return repr(value)


@settings(max_examples=250, deadline=None)
@given(st.lists(st.tuples(payload, st.integers(0, 3), st.integers(0, 400)), min_size=1, max_size=5))
def test_against_parsing(rows):
    texts = []
    for value, style, cut in rows:
        text = spell(value, style)
        texts += [text, text[:cut]]
    check(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="{}[]:,\"'\\ 01.-eEnulltrue()N#ab", max_size=25))
def test_broken_text(text):
    check([text, f'{{"tokens": [{text}]}}', f"[{{'tokens': {text}}}]"])


def test_odd_rows():
    ok = "{'tokens': [{'doc_offset': {'start': 1, 'end': 2}, 'position': {'x0': 1, 'y0': 1, 'x1': 2, 'y1': 2}}]}"
    texts = [
        "", " ", "null", "[]", "{}", "nonsense", ok, ok + ",", ok[:-1], ok.replace("]", ",]"), ok.replace("[", "(").replace("]", ",)"),
        ok.replace("'start': 1", "'start': 1, 'start': 9"), ok.replace("1", "01"), ok.replace("{'start'", "{5: 6, 'start'"), ok + " " + ok, ok.replace("2", "2 # two\n"),
        ok.replace("'tokens'", '"tokens"'), ok.replace("}}]", ", 'text': 'a' 'b'}}]"), ok.replace("'position'", "'pos\\x69tion'"), ok.replace("None", "null"), ok.replace("2}", "null}"), ok.replace("2}", "-2}"), ok.replace("2}", "2e0}"), ok.replace("2}", "True}"),
        '{"tokens": [{"doc_offset": {"start": 1, "end": 2}, "position": {"left": null, "x0": "1", "top": 1, "right": 2, "bottom": 2}, "text": "it\'s"}], "blocks": null}',
    ]
    check(texts)
    texts += [t for name in ("NaN", "Infinity", "1e999", '{"a\\\\n": 1, "é": 2, "\\u00e9": 3}') for t in [texts[-1].replace("null}", name + "}")]]
    assert all(map(plain_shred.token_links, texts[-4:]))
    long = '{"tokens": [' + ", ".join('{"doc_offset": {"start": %d, "end": %d}, "position": {"left": 1, "top": 1, "right": 2, "bottom": 2}}' % (k, k + 1) for k in range(30_000)) + "]}"
    check([ok, long, ok])


def test_chunks(monkeypatch):
    rng = random.Random(5)
    unit = lambda k: {"tokens": [{"doc_offset": {"start": j, "end": j + 1}, "position": {"x0": 0, "y0": 0, "x1": 1, "y1": 1}, "page_num": j % 2} for j in range(k)], "blocks": [{"doc_offset": {"start": 0, "end": 3}, "position": {"x0": 0, "y0": 0, "x1": 1, "y1": 1}}]}
    texts = [spell([unit(rng.randrange(6)) for _ in range(rng.randrange(4))], rng.randrange(4)) for _ in range(60)]
    for size in (1, 300, 5000):
        monkeypatch.setattr(shred, "CHUNK_BYTES", size)
        check(texts)


def test_tables(spark):
    schema = "raw_id bigint, ocr_json string, ocr_output string, ocr_data string, tok_no string, payload int"
    form = {"pages": [{"page_id": 4, "dimension": {"width": 10, "height": 20}, "tokens": [{"text": "Zél", "segments": [[0, 3]], "bbox": [0, 0.1, 0.2, 0.3, 0.4]}], "lines": [{"text": "Zél x", "segment": [0, 5], "bbox": [0.1, 0.2, 0.3, 0.4]}]}]}
    box = {"ocr_boxes": [{"text": "a\t", "points": [[0, 0], [5, 1], [5, 4], [0, 4]]}, {"text": " \n", "points": [[0, 0], [1, 1], [1, 1], [1, 1]]}]}
    rows = [(1, json.dumps(form), "x", None, "t", 0), (2, None, json.dumps(box), None, "t", 0), (3, "{", json.dumps(box), None, "t", 0), (4, None, None, None, "t", 0), (None, None, None, repr(box), "t", 0), (2, None, json.dumps(box), None, "t", 0)]
    exports = spark.createDataFrame(rows, schema)
    links = sorted(shred.token_links(exports).collect(), key=str)
    assert [tuple(r) for r in links] == sorted([(1, 0, 4, 0), (2, 0, 0, 0), (2, 0, 0, 0), (None, 0, 0, 0)], key=str)
    token = shred.token_table(exports).where("raw_id = 1").first()
    assert (token.text, token.char_start, token.char_end, token.x0, token.y1) == ("Zél", 0, 3, 0.1, 0.4)
    block = shred.block_table(exports).where("raw_id = 1").first()
    assert (block.block_id, block.page_no, block.text, block.char_end) == (0, 4, "Zél x", 5)
    assert [tuple(r) for r in shred.page_table(exports).where("raw_id in (1, 3)").collect()] == [(1, 4, 10.0, 20.0, None)]
    assert shred.page_table(exports).where("raw_id = 2").first().page_width == 5.0
    for f in (shred.token_links, shred.token_table, shred.block_table, shred.page_table):
        assert f(exports.limit(0)).count() == 0


def test_whole_table(spark, data):
    from pyspark.sql import functions as F

    exports = spark.read.parquet(f"{data}/raw_exports.parquet")
    want = set()
    for r in exports.select("raw_id", F.coalesce("ocr_json", "ocr_output", "ocr_data").alias("p")).collect():
        want |= {(r.raw_id, *x) for x in plain_shred.token_links(r.p)}
    got = [tuple(r) for r in shred.token_links(exports).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_ranges():
    assert shred._ranges(np.array([3, 7]), np.array([2, 0])).tolist() == [3, 4]
    with pytest.raises(ValueError):
        json.loads("{")


def entries(rng, n, pages, width, reach):
    row = np.sort(rng.integers(0, 3, n))
    start = rng.integers(0, width, n)
    return shred.Entries(row, rng.integers(0, pages, n), start, start + rng.integers(0, reach, n), np.zeros((n, 4)), np.arange(n))


def test_enclosing_blocks_against_all_pairs():
    rng = np.random.default_rng(6)
    for n, m in ((0, 5), (5, 0), (1, 1), (200, 60), (300, 300)):
        tokens, blocks = entries(rng, n, 3, 100, 8), entries(rng, m, 3, 100, 40)
        number = blocks.number()
        want = [min((int(number[b]) for b in range(m) if blocks.row[b] == tokens.row[t] and blocks.page[b] == tokens.page[t] and blocks.start[b] <= tokens.start[t] and tokens.end[t] <= blocks.end[b]), default=-1) for t in range(n)]
        assert shred._enclosing(tokens, blocks).tolist() == want


def test_a_large_page():
    """100,000 tokens and 25,000 blocks on one page, blocks around blocks."""
    n, m = 100_000, 25_000
    zero = lambda k: np.zeros(k, np.int64)
    start = np.arange(n) * 4
    tokens = shred.Entries(zero(n), zero(n), start, start + 3, np.zeros((n, 4)), np.arange(n))
    b_start = np.arange(m) * 16
    blocks = shred.Entries(zero(m), zero(m), b_start, np.where(np.arange(m) % 100 == 99, n * 4, b_start + 15), np.zeros((m, 4)), np.arange(m))
    began = time.perf_counter()
    made = shred._enclosing(tokens, blocks)
    assert time.perf_counter() - began < 5
    # every hundredth block reaches to the end of the page, so from the first of them on it is the lowest
    assert (made == np.minimum(np.arange(n) // 4, 99)).all()


def test_quotes_of_both_kinds():
    rng = random.Random(2)
    for _ in range(200):
        rows = [[rng.choice("'\"") for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 4))]
        want = []
        for quotes in rows:
            inside = ""
            for q in quotes:
                want.append(inside in ("", q))
                inside = ("" if inside else q) if want[-1] else inside
        double = np.array([q == '"' for r in rows for q in r])
        assert shred._string_quotes(double, np.repeat(np.arange(len(rows)), [len(r) for r in rows])).tolist() == want
