"""DuckDB text of the queries that SQL can express on whole tables."""
from __future__ import annotations

from .secret_scan import BASE, RULES


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, unnest(list_transform(range(1, len(hit) + 1), lambda i: {{
        's': list_sum(list_transform(gap[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda h: length(h))), 0),
        'n': length(hit[i]), 'v': length(val[i])}})) AS m
      FROM (SELECT doc_id, string_split_regex(t, '{p}') AS gap, regexp_extract_all(t, '{p}') AS hit, regexp_extract_all(t, '{p}', {group}) AS val
            FROM docs WHERE regexp_matches(t, '{p}')) WHERE len(hit) > 0"""


def _secrets() -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, rank, kind, m.s AS s, m.s + m.n AS e FROM ({_spans(r.kind, i, r.pattern, r.group, r.least)}) WHERE m.v >= {r.least}"
                              for i, r in enumerate(RULES))
    names = ", ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0) AS n_{r.kind}" for r in BASE)
    one = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({each}),
      sums AS (SELECT doc_id, {names}, string_agg({one}, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base,
               string_agg({one}, ',' ORDER BY s, rank) AS spans FROM found GROUP BY doc_id)
      SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
             coalesce(spans, '') AS spans FROM docs d LEFT JOIN sums ON d.doc_id IS NOT DISTINCT FROM sums.doc_id"""


def _escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '\\', '\\s'), '<', '\\l'), '|', '\\p')"


def _spelling(min_chars: int = 6, min_count: int = 5, slip: int = 199, ratio: int = 5) -> str:
    """Words one edit apart share a variant with one letter taken out, or one is such a variant of the other."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    def half(c):
        return f"CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
    rounds = ", ".join(f"b{i + 1} AS (SELECT i, {half('c')} AS c FROM b{i})" for i in range(8))
    return f"""WITH RECURSIVE b0 AS (SELECT i, i AS c FROM range(256) t(i)), {rounds},
      crc AS (SELECT list(c ORDER BY i) AS t FROM b8),
      runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[a-z\u00C0-\u00FF]+')) AS w FROM documents),
      each AS (SELECT doc, w, count(*) AS n FROM runs WHERE length(w) >= {min_chars} GROUP BY doc, w),
      hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(doc || ':' || w)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
        lambda c, x: xor(c >> 8, t[(xor(c & 255, x)) + 1])), 4294967295) AS h FROM each, crc),
      typed AS (SELECT CASE WHEN h % {slip} = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
      words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= {min_chars} GROUP BY word HAVING sum(n) >= {min_count}),
      cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS v FROM words, range(0, 1000) t(i) WHERE i < length(word)),
      pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.v = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.v = b.word),
      sums AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS top, max(near_n) AS top_n FROM pairs GROUP BY word),
      formed AS MATERIALIZED (SELECT w.word, CASE WHEN top_n >= {ratio} * n THEN top END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= {ratio} * n THEN top_n END AS form_n
        FROM words w LEFT JOIN sums USING (word)),
      chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
      SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c USING (word) JOIN formed e ON e.word = c.root AND e.form IS NULL"""


NEGATIVES = """WITH rows AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
      scores AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS s
        FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
      good AS (SELECT anchor_id, vec_id AS positive_id, s AS ps FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5)
      SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, ps AS positive_score, s AS negative_score
      FROM good JOIN scores USING (anchor_id) WHERE NOT same AND 80 * ps <= 100 * s AND s <= ps
      WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


SQL: dict[str, str] = {
    "op11_pivotal_spelling": _spelling(),
    "op12_residue_negatives": NEGATIVES,
    "op3_trigram_secrets": _secrets(),
    "op6_event_chat": f"""WITH said AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
      whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(length({_escaped('role')}) + length({_escaped('text')}) + 8) AS formatted_chars FROM said GROUP BY conv_id)
      SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
             CAST(formatted_chars AS BIGINT) AS formatted_chars FROM whole""",
}
