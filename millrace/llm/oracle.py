"""SQL that states what some pN_ queries must give."""

P3_FOUND = r"""
WITH ws AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS w),
r AS (SELECT id, any_value(source) AS source, any_value(text_content) AS t FROM unified_records GROUP BY id),
c AS (SELECT source, max_by(chunk_size, config_id) AS s FROM document_config GROUP BY source),
x AS (SELECT r.id, trim(r.t, ws.w) AS t, coalesce(c.s, (SELECT s FROM c WHERE source = 'default')) AS lim, ws.w
      FROM ws, r LEFT JOIN c ON c.source = r.source AND c.source <> 'default'),
big AS (SELECT * FROM x WHERE length(t) > lim),
parts AS (SELECT id, lim, list_filter(list_transform(regexp_split_to_array(t, '\n[ \t\n\x0B\f\r]*\n'),
                 lambda p: trim(p, w)), lambda p: p <> '') AS ps FROM big),
e AS (SELECT id, lim, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM parts)
SELECT id, CAST(0 AS BIGINT) AS para_no FROM big
UNION ALL SELECT id, CAST(n AS BIGINT) AS para_no FROM e WHERE length(p) > lim
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_FOUND}
