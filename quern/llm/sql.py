"""SQL that gives the rows of the queries on text by plainer means, for comparison."""

from __future__ import annotations

from quern.llm.leakage import INLINE, TAGS

# The named character references that the corpus uses.
_REFERENCES = {
    "&ouml;": "ö", "&uuml;": "ü", "&auml;": "ä", "&szlig;": "ß", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&nbsp;": " ",
    "&mdash;": "—", "&amp;": "&"
}


def _words(text: str) -> str:
    """The list of a text's words: escape sequences read, markup and invisible characters left out, lower case."""
    x = f"regexp_replace({text}, '\\\\+[nrtfvb\"''/]', ' ', 'g')"
    codes = f"list_distinct(regexp_extract_all({x}, '\\\\+(u[0-9a-fA-F]{{4}}|x[0-9a-fA-F]{{2}})'))"
    x = f"list_reduce(list_prepend({x}, {codes}), lambda a, m: replace(a, m, chr(CAST('0x' || regexp_extract(m, '[ux]([0-9a-fA-F]+)', 1) AS INTEGER))))"
    for name, character in _REFERENCES.items():
        x = f"replace({x}, '{name}', '{character}')"
    x = f"regexp_replace({x}, '(?i)</?({'|'.join(INLINE.split())})(\\s[^<>]*)?/?>', '', 'g')"
    x = f"regexp_replace({x}, '(?i)</?({'|'.join(TAGS.split())})(\\s[^<>]*)?/?>', ' ', 'g')"
    x = f"regexp_replace({x}, '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}]', '', 'g')"
    return f"regexp_extract_all(lower(nfc_normalize(regexp_replace({x}, '\\*+|~~', '', 'g'))), '[\\pL\\pN]+')"


#: All runs of twelve words of the items, looked up among all those of the documents.
P8_FOUND = f"""WITH d AS (SELECT doc_id, {_words('text')} w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_words("concat_ws(' ', prompt, answer)")} w FROM eval_items),
 runs AS (SELECT DISTINCT item_id, array_to_string(w[k:k+11], ' ') r FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) k FROM i)),
 dr AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+11], ' ') r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) k FROM d))
SELECT DISTINCT doc_id, item_id FROM dr JOIN runs USING (r)"""

P7_KEPT = "SELECT count(*) AS documents, 0 AS over_full, 0 AS broken, 0 AS cut_needlessly FROM documents"
P9_ORDER = "SELECT 0 AS empty, 0 AS overlapping, 0 AS blank_ends, 0 AS outside"
