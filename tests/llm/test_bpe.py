import base64
import os

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folia.llm import bpe, encode, presplit
from folia.llm.columns import chunks, string_array

FOLDER = os.path.dirname(encode.TOKENIZER)
if not os.path.exists(encode.TOKENIZER):
    pytest.skip("no vocabulary files", allow_module_level=True)

#: The pattern with its white space spelled out, as libraries differ in what \\s is.
BLANK = "".join(f"\\u{cp:04x}" for cp in presplit.SPACES)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|[\s]+(?![^\s])|[\s]+".replace(r"\s", BLANK)
texts = st.lists(st.text(st.one_of(st.sampled_from("ab'stdrevlmZ  \t\n09,.-é你"), st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=["Cn"])), max_size=40), min_size=1, max_size=6)


def read(name):
    with open(f"{FOLDER}/{name}", "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def vocab():
    return bpe.parse_vocabulary(read("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def public():
    made = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    made.encode_special_tokens = True
    return lambda rows: [e.ids for e in made.encode_batch(rows, add_special_tokens=False)]


def pieces(rows):
    return encode._pieces(string_array(pa.array(rows, pa.string())))[0]


def ids(encoder, rows):
    return [encoder.gather(encoder.indices(pieces([t]))).tolist() if t else [] for t in rows]


@settings(max_examples=300, deadline=None)
@given(texts)
def test_pieces(rows):
    assert pieces(rows) == [p for t in rows for p in regex.findall(PATTERN, t)]


def test_every_character(vocab, public):
    rows = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}  '{chr(c)}" for c in range(0x3100)]
    assert ids(bpe.Encoder(vocab), rows) == public(rows)


def test_vocabularies_agree(vocab):
    other = bpe.parse_vocabulary(read("byte_bpe_50k.tiktoken"))
    assert (vocab.left == other.left).all() and (vocab.right == other.right).all() and (vocab.ids == other.ids).all()


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids(vocab, public, rows):
    assert ids(bpe.Encoder(vocab), rows) == public(rows)


def test_hard_texts(vocab, public):
    rows = ["", "a", "<|endoftext|>", "x<|endoftext|>y", " " * 70, "0" * 300, "é" * 200, "supercalifragilisticexpialidocious" * 20, "'s's't I'll I'LL ''d '", "​­\x1f\x0c  \r\n 　x", "😀👨‍👩‍👧 ﷺ №", "abc" * 5000]
    encoder = bpe.Encoder(vocab, keep=5)
    assert ids(encoder, rows) == public(rows) == ids(encoder, rows)


def test_multi_vocabulary():
    data = read("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    other = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(bpe.parse_vocabulary(data))
    rows = ["Die Prüfung wird vernichtet, le comité peut déposer 1201 dossiers.", "ημερομηνία копия 請求書"]
    assert ids(encoder, rows) == [other.encode_ordinary(t) for t in rows]


def test_pairs_and_exact_merging(vocab):
    """Every pair that compatible() lets stand is what exact merging gives, and no other."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3000, 4000), rng.integers(0, 3000, 4000)
    ok = bpe.compatible(vocab, a, b)
    symbols, offs = merged(vocab, [vocab.texts[x] + vocab.texts[y] for x, y in zip(a, b, strict=True)])
    want = [symbols[offs[k] : offs[k + 1]].tolist() == [x, y] for k, (x, y) in enumerate(zip(a, b, strict=True))]
    assert ok.tolist() == want and 0 < sum(want) < len(want)


def merged(vocab, pieces):
    flat, offs = bpe.flatten(pieces)
    symbols, counts = bpe.merge_in_step(vocab, flat, np.diff(offs))
    return symbols, np.concatenate([[0], np.cumsum(counts)])


def one_by_one(vocab, piece):
    """The lowest-ranked pair, the leftmost of equal ones, merged again and again."""
    symbols = list(piece)
    while len(symbols) > 1:
        made = vocab.merged(np.array(symbols[:-1]), np.array(symbols[1:]))
        made[made < 0] = bpe.NEVER
        k = int(made.argmin())
        if made[k] == bpe.NEVER:
            break
        symbols[k : k + 2] = [int(made[k])]
    return symbols


def test_merging_in_step(vocab):
    words = [b"abcd" * 9, b"x" * 41, b"", "žluťoučký".encode() * 3, b"aaaa" * 100, "請求書番号".encode() * 60, b"q"]
    symbols, offs = merged(vocab, words)
    for k, w in enumerate(words):
        assert symbols[offs[k] : offs[k + 1]].tolist() == one_by_one(vocab, w)
    assert merged(vocab, [])[1].tolist() == [0] and merged(vocab, [b"", b""])[1].tolist() == [0, 0, 0]


def test_every_symbol_is_proposed_for_its_own_text(vocab):
    """Symbols that exact merging never gives aren't in the tree; all others are their own text's encoding."""
    proposed = set(vocab.accepts[vocab.accepts >= 0].tolist())
    symbols, offs = merged(vocab, vocab.texts)
    assert proposed == {k for k in range(len(vocab.texts)) if symbols[offs[k] : offs[k + 1]].tolist() == [k]}


def test_long_pieces_are_proposed_and_checked_too(vocab, public, monkeypatch):
    """Pieces of many parts: proposed whole, and merged exactly only around pairs that fail."""
    rng = np.random.default_rng(8)
    rows = ["請求書番号合計金額" * 40, "ab" * 700, "a" * 1999, "長" * 100 + "い" * 100, "".join(rng.choice(list("abcdeftinors"), 3000)), "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 500)), "Donaudampfschifffahrtsgesellschaft" * 30]
    proposed = []
    greedy = bpe.greedy
    monkeypatch.setattr(bpe, "greedy", lambda v, flat, starts, ends: proposed.append(int((ends - starts).sum())) or greedy(v, flat, starts, ends))
    encoder = bpe.Encoder(vocab)
    assert ids(encoder, rows) == public(rows)
    assert sum(proposed) == sum(len(t.encode()) for t in rows)
    assert 0 < encoder.redone < encoder.tokens


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aabcdetionrs請求書é"), min_size=30, max_size=400), min_size=1, max_size=4))
def test_long_pieces(vocab, public, rows):
    assert ids(bpe.Encoder(vocab), rows) == public(rows)


def test_chunks():
    column = string_array(pa.array(["ab", None, "c" * 50, "", "é"]))
    assert list(chunks(column, 4)) == [(0, 2), (2, 3), (3, 5)]
    assert list(chunks(column[:0])) == []


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, lang string")


def test_encode(spark, public):
    rows = [(1, "Total: 5", "z", None), (2, None, None, "x"), (3, "", "", "x"), (1, "Total: 5", "z", None), (None, " ", "z", "y"), (9, "long " * 60_000, "", "")]
    made = encode.encode(frame(spark, rows))
    assert made.columns == ["doc_id", "ids"]
    got = sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in made.collect())
    want = sorted((-1 if k is None else k, public([t])[0] if t else []) for k, t, *_ in rows)
    assert got == want
    assert encode.encode(frame(spark, [])).count() == 0


def test_encode_whole_table(spark, data, public):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], public([r.text or "" for r in rows]), strict=True))
    assert {r.doc_id: list(r.ids) for r in encode.encode(spark.read.parquet(f"{data}/documents.parquet")).collect()} == want


def test_subtokens(spark, public):
    canon = spark.createDataFrame([(1, " Fcc-Invoices", "desk", "EN", "Total: 5 EUR"), (2, "ndas", None, None, None), (3, "ndas", "d", "fr", "")], "rec_id bigint, dataset_name string, source string, lang string, text string")
    tokens = spark.createDataFrame([(1, 0, "Total:", 1), (1, 1, "5", 1), (1, 1, "5", 2), (1, 2, None, 1), (1, 3, "", 1), (8, 0, "x", 1)], "rec_id bigint, tok_idx int, text string, source int")
    made = {r.rec_id: r for r in encode.subtokens(canon, tokens).collect()}
    n = lambda t: len(public([t])[0])
    assert (made[1].dataset_name, made[1].lang, made[1].n_subtokens, made[1].n_ocr_tokens, made[1].n_ocr_subtokens) == ("fcc_invoices", "en", n("Total: 5 EUR"), 4, n(" Total:") + n(" 5"))
    assert (made[2].lang, made[2].n_subtokens, made[2].n_ocr_tokens, made[3].n_subtokens) == ("und", 0, 0, 0)
    totals = {(r.by, r.source, r.lang, r.dataset_name): (r.n_records, r.n_subtokens) for r in encode.budget(encode.subtokens(canon, tokens)).collect()}
    assert totals["all", None, None, None] == (3, made[1].n_subtokens) and totals["dataset_name", None, None, "ndas"] == (2, 0)
    assert encode.subtokens(canon.limit(0), tokens).count() == 0


def test_summary_takes_the_last_report(spark):
    schema = "dataset_name string, strategy string, model_name string, effective_max_length int, tokenizer_stride int, n_base_word_chunks bigint, n_tokenized_chunks bigint, n_docs bigint, mean_subtokens double, max_subtokens int, total_padded_subtokens bigint, created_at int"
    rows = [("Ndas", "s", None, 1, 1, 1, 1, 1, 1.0, 1, 1, 1), ("ndas ", "s", None, 1, 1, 7, 1, 1, 1.0, 1, 1, 2)]
    last = encode.latest_summary(spark.createDataFrame(rows, schema)).collect()
    assert [(r.dataset_name, r.n_base_word_chunks) for r in last] == [("ndas", 7)]
