"""DuckDB SQL of sentence packing: a recursion over the ends of chunks."""

from __future__ import annotations

_WS = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"


def chunk_sql(documents: str, size: int, carry: int, paged: bool = True) -> str:
    """Chunks of ``documents`` (SQL that gives id and text), cut into pages first if ``paged``."""
    blank = f"regexp_replace(coalesce(text, ''), '{_WS}+', '', 'g') = ''"
    pages = (
        f"SELECT id AS doc_id, CAST(i + 1 AS INTEGER) AS page_number, CASE WHEN blank THEN '(empty file)' ELSE regexp_replace(substring(text, i * 3000 + 1, 3000), '^{_WS}+|{_WS}+$', '', 'g') END AS text "
        f"FROM (SELECT *, unnest(range(0, CASE WHEN blank THEN 1 ELSE CAST(ceil(length(text) / 3000) AS BIGINT) END)) AS i FROM (SELECT *, {blank} AS blank FROM docs))"
        if paged else "SELECT id AS doc_id, 1 AS page_number, text FROM docs"
    )
    few = max(1, carry // 5)
    cost, end = "greatest(1, length({}) // 4)", "greatest({} + 1, len(list_filter(s, lambda x: x <= s[{} + 1] + " + str(size) + ")) - 1)"
    return (
        f"WITH RECURSIVE docs AS ({documents}), pg AS ({pages}), "
        rf"sn AS (SELECT doc_id, page_number, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS l FROM pg), "
        f"un AS (SELECT doc_id, page_number, unnest(l) AS t, unnest(range(0, len(l))) AS i FROM sn), lg AS (SELECT *, {cost.format('t')} > {size} AS long FROM un), "
        "pv AS (SELECT *, coalesce(lag(long) OVER (PARTITION BY doc_id, page_number ORDER BY i), false) AS was FROM lg), "
        "sg AS (SELECT *, sum(CASE WHEN long OR was THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY i) AS seg FROM pv), "
        f"it AS (SELECT doc_id, page_number, seg, bool_or(long) AS long, CASE WHEN bool_or(long) THEN list_filter(regexp_split_to_array(min(t), '{_WS}+'), lambda x: x <> '') ELSE list(t ORDER BY i) END AS items FROM sg GROUP BY 1, 2, 3), "
        "ex AS (SELECT doc_id, page_number, seg, long, unnest(items) AS t, generate_subscripts(items, 1) AS k FROM it), "
        f"rs AS (SELECT *, CAST(sum({cost.format('t')}) OVER (PARTITION BY doc_id, page_number, seg ORDER BY k) AS BIGINT) AS run FROM ex), "
        "tot AS (SELECT doc_id, page_number, seg, bool_or(long) AS long, count(*) AS n, list(t ORDER BY k) AS items, list_prepend(0, list(run ORDER BY k)) AS s FROM rs GROUP BY 1, 2, 3), "
        f"r AS (SELECT doc_id, page_number, seg, 0 AS k, CAST(0 AS BIGINT) AS st, CAST({end.format(0, 0)} AS BIGINT) AS en FROM tot UNION ALL SELECT doc_id, page_number, seg, k + 1, st2, CAST({end.format('en', 'st2')} AS BIGINT) FROM ("
        f"SELECT r.doc_id, r.page_number, r.seg, r.k, r.en, t.s, greatest(r.st, CASE WHEN t.long THEN r.en - {few} ELSE len(list_filter(t.s, lambda x: x < t.s[r.en + 1] - {carry})) END) AS st2 FROM r JOIN tot t ON t.doc_id = r.doc_id AND t.page_number = r.page_number AND t.seg = r.seg WHERE r.en < t.n)), "
        "ch AS (SELECT r.doc_id, r.page_number, row_number() OVER (PARTITION BY r.doc_id ORDER BY r.page_number, r.seg, r.k) - 1 AS chunk_index, array_to_string(t.items[r.st + 1:r.en], ' ') AS text FROM r JOIN tot t ON t.doc_id = r.doc_id AND t.page_number = r.page_number AND t.seg = r.seg), "
        "cn AS (SELECT *, doc_id || '__p' || page_number || '__c' || chunk_index AS chunk_id FROM ch) "
        "SELECT chunk_id, doc_id, page_number, CAST(chunk_index AS INTEGER) AS chunk_index, text, CAST(greatest(1, length(text) // 4) AS INTEGER) AS token_count, false AS is_table FROM cn"
    )
