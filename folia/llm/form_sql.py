"""The consistent form, look-alikes and leaks as SQL for DuckDB, which composes marks by its own nfc_normalize."""

from __future__ import annotations

import unicodedata

from folia.llm import lookalike
from folia.llm.columns import characters


def _changes() -> tuple[list[tuple[str, str]], str]:
    """(character, what it becomes) of those that composing leaves changed, and a pattern of those that show nothing."""
    t = lookalike.tables()
    seen = dict(zip(lookalike.CYRILLIC + lookalike.GREEK, lookalike.CYR_LATIN + lookalike.GRE_LATIN, strict=True))
    rows, dropped = [], []
    for cp in characters():
        if 0xD800 <= cp < 0xE000:
            continue
        if t.size[cp] == 0:
            if dropped and dropped[-1][1] == cp - 1:
                dropped[-1][1] = cp
            else:
                dropped.append([cp, cp])
        elif t.busy[cp]:
            made = " " if cp in lookalike.NO_BREAK else lookalike._expand(chr(cp), seen)
            if unicodedata.normalize("NFC", made) != unicodedata.normalize("NFC", chr(cp)):
                rows.append((chr(cp), made))
    return rows, "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in dropped) + "]"


def _form(source: str, key: str) -> str:
    """Parts like_, char_ and form_ (key, text, form) of a table."""
    rows, nothing = _changes()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows)
    return f"""like_(c, t) as (values {values}), char_ as (select {key}, unnest(chars) as c, generate_subscripts(chars, 1) as k from (select {key}, regexp_extract_all(regexp_replace(text, '{nothing}', '', 'g'), '(?s).') as chars from {source} where text is not null)),
        form_ as (select d.{key}, d.text, case when d.text is not null then coalesce(nfc_normalize(f.form), '') end as form from {source} d left join (select {key}, string_agg(coalesce(t, char_.c), '' order by k) as form from char_ left join like_ on char_.c = like_.c group by 1) f on d.{key} = f.{key})"""


def _windows(name: str, key: str) -> str:
    """Part <name>: each run of twelve words of a form."""
    return f"{name} as (select distinct {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) as run from (select {key}, regexp_extract_all(lower(form), '[\\p{{L}}\\p{{N}}]+') as w from form_))"


def statements() -> dict[str, str]:
    docs = _form("documents", "doc_id")
    shown = "regexp_matches(form, '[^\\s\\p{Z}\\x{85}]')"
    everything = """(select 'd' || doc_id as key, text from documents where doc_id is not null union all select 'i' || item_id, text from heldout_items where item_id is not null)"""
    runs = f"with all_ as {everything}, {_form('all_', 'key')}, {_windows('run_', 'key')}, hit as (select d.key[2:]::bigint as doc_id, i.key[2:]::bigint as item_id, count(*) as n from run_ d join run_ i on d.key[1] = 'd' and i.key[1] = 'i' and d.run = i.run group by 1, 2)"
    return {
        "p8_text": f"with {docs} select doc_id, form as text from form_",
        "p8_found": f"with {docs} select a.doc_id as doc_a, b.doc_id as doc_b from form_ a join form_ b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text where regexp_matches(a.form, '[^\\s\\p{{Z}}\\x{{85}}]')",
        "p8_groups": f"""with {docs} select doc_id, form_id, class_id, n_links from (select doc_id, min(doc_id) over (partition by form) as form_id, min(doc_id) over (partition by form, text) as class_id, count(*) over (partition by form) - count(*) over (partition by form, text) as n_links
            from form_ where {shown}) where n_links > 0""",
        "p7_found": f"{runs} select doc_id, item_id from hit",
        "p7_items": f"""{runs}, have as (select key[2:]::bigint as item_id, count(*) as n from run_ where key[1] = 'i' group by 1), most as (select item_id, count(*) as docs, max(n) as n from hit group by 1)
            select h.item_id, lower(trim(split)) as split, coalesce(have.n, 0) as n_windows, coalesce(docs, 0) as n_docs, coalesce(most.n, 0) as most_windows, case when have.n is not null then round(coalesce(most.n, 0) / have.n, 6) end as containment
            from heldout_items h left join have on h.item_id = have.item_id left join most on h.item_id = most.item_id""",
    }
