"""The model views of bindings.py as SQL, for the comparison queries."""

#: Names of common table expressions and their bodies; ``sql()`` puts those that a query names before it.
VIEWS = {
    "catalog": """
        SELECT o_orderkey AS id, o_orderpriority || ' ' || c_mktsegment AS title, o_orderdate AS start_at,
               CAST(o_orderdate AS DATE) AS start_day,
               CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 15 AS INTEGER) END AS end_day,
               n_nationkey AS place_id, n_name AS place, r_name AS region,
               CASE WHEN o_totalprice < 50000 THEN 'free' WHEN o_totalprice < 300000 THEN 'paid' END AS price_type,
               CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'draft' ELSE 'archived' END AS status
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "pub": "SELECT * FROM catalog WHERE status = 'published'",
    "cats": """
        SELECT DISTINCT id, axis, category FROM (
            SELECT l_orderkey AS id, 'kind' AS axis, p_type AS category FROM lineitem JOIN part ON l_partkey = p_partkey
            UNION ALL SELECT l_orderkey, 'audience', p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "wks": """
        SELECT id, CAST(date_trunc('week', start_day) AS DATE) + CAST(7 * i AS INTEGER) AS week_start
        FROM pub, (SELECT unnest(generate_series(0, 3)) AS i)
        WHERE CAST(date_trunc('week', start_day) AS DATE) + CAST(7 * i AS INTEGER) <= coalesce(end_day, start_day)""",
    "runs": """
        SELECT user_id AS source, event_id AS id, ts AS fetched_at,
               CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 304 ELSE 200 END AS status,
               event_type <> 'error' AS ok,
               CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 END AS items,
               CAST(floor(value / 20) AS BIGINT) AS hash,
               CASE WHEN event_type <> 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 > 0
                    THEN round((CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) / 10.0, 4) END AS title_fill
        FROM events""",
    "matchable": """
        SELECT o_orderkey AS id, o_custkey AS customer, o_orderpriority || ' ' || c_mktsegment AS title,
               CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey * 37 % 1440 AS BIGINT)) AS start_at, c_nationkey AS place_id,
               CASE WHEN o_orderkey % 4 <> 0 THEN c_mktsegment END AS venue,
               CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'draft' ELSE 'archived' END AS status
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "mpairs": """
        SELECT c.id AS c_id, r.id AS r_id, c.customer = r.customer AS same, trim(regexp_replace(lower(c.title), '[^a-z0-9]+', ' ', 'g')) AS ct,
               trim(regexp_replace(lower(r.title), '[^a-z0-9]+', ' ', 'g')) AS rt, lower(c.venue) AS cv, lower(r.venue) AS rv,
               greatest(0e0, 1 - abs(extract(hour FROM c.start_at) * 60 + extract(minute FROM c.start_at) - extract(hour FROM r.start_at) * 60 - extract(minute FROM r.start_at)) / 180e0) AS time
        FROM (SELECT * FROM matchable WHERE status = 'draft') c JOIN (SELECT * FROM matchable WHERE status = 'published') r
          ON CAST(c.start_at AS DATE) = CAST(r.start_at AS DATE) AND c.place_id = r.place_id""",
    "letters": """
        SELECT * FROM (WITH RECURSIVE each(a, b, i, used, found) AS (
            SELECT a, b, 0, repeat('0', length(b)), '' FROM (SELECT ct AS a, rt AS b FROM mpairs UNION SELECT cv, rv FROM mpairs WHERE cv IS NOT NULL AND rv IS NOT NULL)
            UNION ALL
            SELECT a, b, i + 1, CASE WHEN j IS NULL THEN used ELSE substr(used, 1, j) || '1' || substr(used, j + 2) END, CASE WHEN j IS NULL THEN found ELSE found || substr(a, i + 1, 1) END
            FROM (SELECT *, list_filter(range(greatest(0, i - greatest(length(a), length(b)) // 2 + 1), least(i + greatest(length(a), length(b)) // 2, length(b))),
                      lambda j: substr(b, j + 1, 1) = substr(a, i + 1, 1) AND substr(used, j + 1, 1) = '0')[1] AS j FROM each WHERE i < length(a)))
          SELECT a, b, found, array_to_string(list_transform(list_filter(range(length(b)), lambda j: substr(used, j + 1, 1) = '1'), lambda j: substr(b, j + 1, 1)), '') AS other,
                 length(found) AS m FROM each WHERE i = length(a))""",
    "alike": """
        SELECT a, b, CASE WHEN a = b THEN 1e0 WHEN m = 0 THEN 0e0 ELSE jaro + prefix * 0.1e0 * (1 - jaro) END AS similarity
        FROM (SELECT a, b, m, (m / length(a) + m / length(b) + (m - len(list_filter(range(length(found)), lambda j: substr(found, j + 1, 1) <> substr(other, j + 1, 1))) / 2e0) / m) / 3 AS jaro,
                     len(list_filter(range(1, 5), lambda k: length(a) >= k AND substr(a, 1, k) = substr(b, 1, k))) AS prefix
              FROM (SELECT a, b, found, other, CAST(m AS DOUBLE) AS m FROM letters))""",
    "scored": """
        SELECT c_id, r_id, same, t.similarity AS title, time, v.similarity AS venue,
               round(CASE WHEN v.similarity IS NULL THEN (0.7e0 * t.similarity + 0.15e0 * time) / (0.7e0 + 0.15e0)
                          ELSE (0.7e0 * t.similarity + 0.15e0 * time + 0.15e0 * v.similarity) / (0.7e0 + 0.15e0 + 0.15e0) END, 4) AS score
        FROM mpairs JOIN alike t ON t.a = ct AND t.b = rt LEFT JOIN alike v ON v.a = cv AND v.b = rv""",
    "matches": """
        SELECT c_id, best.r_id AS r_id, best.score AS score, CASE WHEN best.score >= 0.92 THEN 'auto-merge' WHEN best.score >= 0.75 THEN 'review' ELSE 'separate' END AS decision,
               round(best.title, 4) AS title, round(best.time, 4) AS time, round(best.venue, 4) AS venue
        FROM (SELECT c_id, arg_min({'r_id': r_id, 'score': score, 'title': title, 'time': time, 'venue': venue}, (-score, r_id)) AS best FROM scored GROUP BY c_id)""",
    "lines": """
        SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, lang, source,
               trim(regexp_replace(translate(replace(lower(split_part(text, chr(10), 1)), 'ß', 'ss'), '{accented}', '{plain}'), '[^a-z0-9]+', ' ', 'g')) AS title_key
        FROM documents""",
}

#: What each view is made of.
NEEDS = {
    "pub": ("catalog",), "wks": ("catalog", "pub"), "mpairs": ("matchable",), "letters": ("matchable", "mpairs"), "alike": ("matchable", "mpairs", "letters"),
    "scored": ("matchable", "mpairs", "letters", "alike"), "matches": ("matchable", "mpairs", "letters", "alike", "scored"),
}


def sql(body: str, *views: str) -> str:
    """The query with the views it needs before it."""
    from ..functions.text import ACCENTED, PLAIN

    names: list[str] = []
    for v in views:
        names += [x for x in (*NEEDS.get(v, ()), v) if x not in names]
    parts = [f"{n} AS ({VIEWS[n].replace('{accented}', ACCENTED).replace('{plain}', PLAIN)})" for n in names]
    return f"WITH {', '.join(parts)} {body}" if parts else body
