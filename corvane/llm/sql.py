"""DuckDB SQL with the results of the queries that SQL can express."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Lengths of the marks around a turn, and what escaping adds where a text holds a control string or an escape.
CONTROL = "(\\[INST\\]|\\[/INST\\]|<s>|</s>)"

ORACLES = {
    "op2_chat_formatting": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL
            SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
        ), marked AS (
            SELECT *, role = 'assistant' AS own,
                   CASE WHEN regexp_matches(text, '{CONTROL}|\u241b[012]')
                        THEN 2 * len(regexp_extract_all(text, '{CONTROL}')) + len(regexp_extract_all(text, '\u241b')) ELSE 0 END AS more
            FROM turns
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(len(text)) FILTER (own), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (own), '')) AS loss_sha256,
               CAST(sum(len(role) + 1 + len(text) + more + CASE WHEN own THEN 7 ELSE 15 END) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id
    """,
    "op10_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {LOWERED} AS t FROM documents)
        WINDOW w AS (PARTITION BY t)
    """,
}
