"""The training-data queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

__all__ = ["oracle_sql"]

#: What the reduction of a text takes away or folds, for DuckDB, which knows accents but no compatibility forms.
_INVISIBLE = "[\\x{AD}\\x{34F}\\x{61C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}]"
_WIDE = "".join(chr(0xFF01 + k) for k in range(94))
_PLAIN = "".join(chr(0x21 + k) for k in range(94)).replace("'", "''")
_FOLDS = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ß": "ss", "¹": "1", "²": "2", "³": "3"}


def _reduced(text: str) -> str:
    out = f"translate(regexp_replace({text}, '{_INVISIBLE}', '', 'g'), '{_WIDE}', '{_PLAIN}')"
    for a, b in _FOLDS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"strip_accents(lower({out}))"


def oracle_sql() -> dict[str, str]:
    words = lambda text: f"regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+')"
    blank = "[\\s\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+"
    return {
        "p1_documents": f"""WITH l AS (SELECT doc_id, source, trim(regexp_replace(line, '{blank}', ' ', 'g')) AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL)),
k AS (SELECT *, lower(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) AS letters FROM l), n AS (SELECT source, greatest(3, 0.1 * count(*)) AS least FROM documents WHERE source IS NOT NULL GROUP BY source),
c AS (SELECT source, letters FROM k JOIN n USING (source) WHERE letters <> '' GROUP BY source, letters, least HAVING count(DISTINCT doc_id) >= least - 1e-9)
SELECT DISTINCT doc_id, left(line, 60) AS line_head FROM k JOIN c USING (source, letters)""",
        "p5_documents": f"""WITH w AS (SELECT doc_id, {words("lower(line)")} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id IS NOT NULL)),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5),
s AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS whole FROM g GROUP BY doc_id), m AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole) AS rep FROM s),
r AS (SELECT g.doc_id, g, n FROM g JOIN m ON g.doc_id = m.doc_id WHERE m.doc_id = rep),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT unnest([a, b]) AS rep FROM p WHERE shared >= 0.8 * (na + nb - shared) - 1e-9), k AS (SELECT rep, count(*) AS links FROM l GROUP BY rep)
SELECT doc_id, m.rep AS rep, coalesce(links, 0) AS links FROM m LEFT JOIN k ON m.rep = k.rep""",
        "p8_found": f"""WITH t AS (SELECT 0 AS item, doc_id AS id, {words(_reduced("text"))} AS w FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 1, item_id, {words(_reduced("text"))} FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item, id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM t WHERE len(w) >= 13)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.g = i.g AND d.item = 0 AND i.item = 1""",
    }
