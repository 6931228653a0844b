"""Byte-level BPE as SQL for DuckDB: pieces by pattern, ranks from the public file, one merge of each piece in every round of a recursion."""

from __future__ import annotations

import os

from folia.llm import encode, presplit

RANKS = os.path.splitext(encode.TOKENIZER)[0] + ".tiktoken"


def _pieces(x: str) -> str:
    """The pieces of a text. Where white space ends before something else, its last character is cut off first, as the pattern's
    lookahead does; U+10FFFF marks the cut."""
    blank = "".join(f"\\x{{{cp:X}}}" for cp in presplit.SPACES)
    endings = "|".join("''" + e for e in presplit.ENDINGS)
    pattern = f"{endings}| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{blank}\\p{{L}}\\p{{N}}\\x{{10FFFF}}]+|[{blank}]+"
    return f"regexp_extract_all(regexp_replace({x}, '([{blank}])([^{blank}])', chr(1114111) || '\\1\\2', 'g'), '{pattern}')"


def _parts(texts: str) -> str:
    """Parts up to done: (piece, made), each different piece of ``texts`` (text) with its tokens as hexadecimal bytes."""
    return f"""rank as (select hex(from_base64(t)) as h, id from read_csv('{RANKS}', delim = ' ', header = false, quote = '', escape = '', columns = {{'t': 'VARCHAR', 'id': 'INTEGER'}})),
        piece as materialized (select row_number() over () as no, piece from (select distinct unnest({_pieces('text')}) as piece from {texts} where text <> '')),
        step as (select no, regexp_extract_all(hex(encode(piece)), '..') as s, true as more from piece
            union all select c.no, case when b.i is null then c.s else list_concat(list_append(c.s[:b.i - 1], c.s[b.i] || c.s[b.i + 1]), c.s[b.i + 2:]) end, b.i is not null
            from (from step where more) c left join (select no, arg_min(i, (id, i)) as i from (select no, unnest(list_transform(range(1, len(s)), lambda i: s[i] || s[i + 1])) as h, generate_subscripts(range(1, len(s)), 1) as i from step where more) p join rank r on p.h = r.h group by 1) b on c.no = b.no),
        done as materialized (select piece, s as made from step join piece on step.no = piece.no where not more)"""


def statements() -> dict[str, str]:
    name = "regexp_replace(lower(trim(dataset_name)), '[\\s-]', '_', 'g')"
    each = "(select rec_id, unnest({p}) as piece, {k} as k from {t})"
    words = "(select rec_id, tok_idx, ' ' || any_value(text) as text from ocr_tokens where text <> '' group by 1, 2)"
    records = f"""with recursive word as materialized {words}, every as (select text from canon_docs union all select text from word), {_parts('every')},
        own as (select rec_id, sum(len(made)) as n from {each.format(p=_pieces('text'), k=0, t='canon_docs')} e join done on e.piece = done.piece group by 1),
        ocr as (select rec_id, sum(len(made)) as n from {each.format(p=_pieces('text'), k=0, t='word')} e join done on e.piece = done.piece group by 1),
        held as (select rec_id, count(distinct tok_idx) as n from ocr_tokens group by 1),
        rec as (select c.rec_id, {name} as dataset_name, source, coalesce(lower(trim(lang)), 'und') as lang, coalesce(own.n, 0)::bigint as n_subtokens, coalesce(held.n, 0) as n_ocr_tokens, coalesce(ocr.n, 0)::bigint as n_ocr_subtokens
            from canon_docs c left join own on c.rec_id = own.rec_id left join ocr on c.rec_id = ocr.rec_id left join held on c.rec_id = held.rec_id)"""
    sums = "count(*) as n_records, sum(n_subtokens)::bigint as n_subtokens, sum(n_ocr_tokens)::bigint as n_ocr_tokens, sum(n_ocr_subtokens)::bigint as n_ocr_subtokens"
    run = "dataset_name, strategy, model_name, effective_max_length, tokenizer_stride"
    rest = "n_base_word_chunks, n_tokenized_chunks, n_docs, mean_subtokens, max_subtokens, total_padded_subtokens"
    return {
        "p5_subtokens": f"{records} select * from rec",
        "p5_budget": f"""{records} select case grouping(source, lang, dataset_name) when 0 then 'source,lang,dataset_name' when 3 then 'source' when 5 then 'lang' when 6 then 'dataset_name' else 'all' end as "by", source, lang, dataset_name, {sums}
            from rec group by grouping sets ((source, lang, dataset_name), (source), (lang), (dataset_name), ())""",
        "p5_beside_summary": f"""{records} select s.*, corpus_records, corpus_subtokens, corpus_ocr_subtokens, corpus_mean_subtokens
            from (select {run}, {rest} from (select *, row_number() over (partition by {run} order by created_at desc, {rest.replace(',', ' desc,')} desc) as no from (select * replace ({name} as dataset_name) from tokenization_summary)) where no = 1) s
            left join (select dataset_name, count(*) as corpus_records, sum(n_subtokens)::bigint as corpus_subtokens, sum(n_ocr_subtokens)::bigint as corpus_ocr_subtokens, round(avg(n_subtokens), 6) as corpus_mean_subtokens from rec group by 1) o on s.dataset_name = o.dataset_name""",
    }


def ids() -> str:
    """The statement of p6_ids."""
    return f"""with recursive {_parts('documents')}, num as (select piece, list(id order by k) as ids from (select piece, unnest(made) as h, generate_subscripts(made, 1) as k from done) d join rank on d.h = rank.h group by 1),
        cut as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as k from (select doc_id, {_pieces('text')} as p from documents where text <> ''))
        select d.doc_id, coalesce(ids, []) as ids from documents d left join (select doc_id, flatten(list(ids order by k)) as ids from cut join num on cut.piece = num.piece group by 1) t on d.doc_id = t.doc_id"""
