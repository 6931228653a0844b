import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from folia.llm import columns, lookalike

T = lookalike.tables()
LIKE = dict(zip(lookalike.CYRILLIC + lookalike.GREEK, lookalike.CYR_LATIN + lookalike.GRE_LATIN, strict=True))


def plain(text):
    """Character by character, composed by the library."""
    seen = dict(LIKE)
    out = []
    for ch in text:
        if T.size[ord(ch)]:
            out.append(" " if ord(ch) in lookalike.NO_BREAK else lookalike._expand(ch, seen))
    return unicodedata.normalize("NFC", "".join(out))


def many(rows):
    points, offs, _ = columns.code_points(pa.array(rows, pa.string()))
    return columns.strings(*lookalike.consistent(points, offs)).to_pylist()


def test_every_character():
    rows = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert many(rows) == [plain(t) for t in rows]


def test_every_cyrillic_and_greek_letter():
    """The letters that become a Latin one are those listed, and none that only comes near."""
    letters = [chr(c) for lo, hi in ((0x370, 0x400), (0x400, 0x530)) for c in range(lo, hi) if unicodedata.category(chr(c))[0] == "L" and (chr(c) in LIKE or not unicodedata.decomposition(chr(c)))]
    latin = {x: f for x, f in zip(letters, many(letters), strict=True) if f.isascii()}
    assert latin == LIKE and all(x.isupper() == y.isupper() or x == "ӏ" for x, y in LIKE.items())
    assert not set("УгЬѡҽҺγσηωкмнтвΓΔΛΠΣΦΨΩ") & set(latin)


marks = st.sampled_from([chr(c) for c in range(0x300, 0x370)] + ["゙", "़", "ְ", "ֱ"])
busy = st.sampled_from([chr(c) for c in range(0x30000) if T.busy[c]])
hangul = st.sampled_from([chr(c) for c in (0x1100, 0x1112, 0x1161, 0x1175, 0x11A8, 0x11C2, 0xAC00, 0xAC01, 0xD7A3)])
text = st.text(st.one_of(marks, busy, hangul, st.sampled_from("aeiouAEоеcn ﬁ"), st.characters(codec="utf-8")), max_size=12)


@settings(max_examples=400, deadline=None)
@given(st.lists(text, min_size=1, max_size=5))
def test_against_plain(rows):
    made = many(rows)
    assert made == [plain(t) for t in rows]
    assert many(made) == [plain(t) for t in made]


def test_what_looks_the_same():
    form = lookalike.consistent_text
    same = [("Ｔｏｔａｌ １２", "Total 12"), ("ﬁne aﬃliate", "fine affiliate"), ("été", "été"), ("to​t﻿al­", "total"), ("a b c", "a b c"), ("Тоtаl Α", "Total A"), ("ẹ́", "ẹ́"), ("й", "й"), ("한", "한")]
    for a, b in same:
        assert form(a) == form(b), (a, b)
    for a, b in [("Total", "total"), ("été", "ete"), ("a  b", "a b"), ("a\nb", "a b"), ("г", "r"), ("1", "l"), ("a.", "a")]:
        assert form(a) != form(b), (a, b)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, form string, exact int")


def test_pairs(spark):
    rows = [(1, "Total"), (2, "Tоtal"), (3, "Total"), (4, "Ｔotal"), (5, "total"), (6, None), (7, ""), (8, "​"), (9, " "), (10, " "), (11, "x"), (11, "x"), (None, "Total​"), (12, "​​")]
    docs = frame(spark, [(k, t, "z", 0) for k, t in rows])
    pairs = lookalike.Lookalikes(docs).pairs().collect()
    assert len(pairs) == len(set(pairs)) and set(map(tuple, pairs)) == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    texts = {r.doc_id: r.text for r in lookalike.consistent_form(docs.where("doc_id is not null")).collect()}
    assert texts[2] == "Total" and texts[6] is None and texts[7] == "" and texts[8] == ""
    assert lookalike.Lookalikes(docs.limit(0)).pairs().count() == 0 and lookalike.Lookalikes(docs.limit(0)).groups().count() == 0 and lookalike.consistent_form(docs.limit(0)).count() == 0


def test_hot_form(spark):
    """Many copies of one text and one text like it: pairs are those of the one."""
    docs = frame(spark, [(k, "Total due", "", 0) for k in range(3000)] + [(9999, "Total due", "", 0)])
    assert lookalike.Lookalikes(docs).pairs().count() == 3000
    groups = {r.doc_id: (r.form_id, r.class_id, r.n_links) for r in lookalike.Lookalikes(docs).groups().collect()}
    assert len(groups) == 3001 and groups[5] == (0, 0, 1) and groups[9999] == (0, 9999, 3000)


def test_whole_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").where("text is not null").collect()]
    forms = {}
    for k, t in rows:
        if t.strip() and plain(t).strip():
            forms.setdefault(plain(t), []).append((k, t))
    want = {(min(a, b), max(a, b)) for group in forms.values() for a, x in group for b, y in group if x != y}
    assert {tuple(r) for r in lookalike.Lookalikes(spark.read.parquet(f"{data}/documents.parquet")).pairs().collect()} == want
    links = dict.fromkeys((k for p in want for k in p), 0)
    for p in want:
        for k in p:
            links[k] += 1
    assert {r.doc_id: r.n_links for r in lookalike.Lookalikes(spark.read.parquet(f"{data}/documents.parquet")).groups().collect()} == links


def test_very_long_text(spark):
    long = "Тоtаl é " * 100_000
    assert lookalike.consistent_form(frame(spark, [(1, long, "", 0)])).first().text == "Total é " * 100_000
