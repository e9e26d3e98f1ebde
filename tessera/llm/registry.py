"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from tessera.llm import embeddings, html, jaccard, langid, middle, mixing, packing, rindex, rlz, secrets, sharding, trie

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_mixing": mixing.op3_mixing,
    "op4_packing": packing.op4_packing,
    "op5_rlz": rlz.op5_rlz,
    "op6_near": embeddings.op6_near,
    "op7_rindex": rindex.op7_rindex,
    "op8_topk": embeddings.op8_topk,
    "op9_language": langid.op9_language,
    "op10_html": html.op10_html,
    "op11_trie": trie.op11_trie,
    "op12_middle": middle.op12_middle,
    "op13_reshard": sharding.op13_reshard,
}

#: Words of `t`, as a list without empty ones.
_WORDS = "list_filter(string_split_regex({t}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


def _any_case(word: str) -> str:
    """The word with ASCII letters in either case; the SQL engine's own switch folds further letters."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _places(pattern: str, kind: str, where: str = "true") -> str:
    """u, kind, s, e, m of the leftmost non-overlapping matches in d: what lies between matches gives their places."""
    return f"""SELECT u, '{kind}' AS kind, s, s + length(m) AS e FROM (
        SELECT u, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(b[1:i], lambda x: length(x)))
                                                  + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS s
        FROM (SELECT u, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS b FROM d)) WHERE {where}"""


_SIGN = "[\"'']?\\x20*[:=]\\x20*[\"'']?"
_ASSIGN = f"(?:{'|'.join(_any_case(w) for w in ('password', 'passwd', 'secret', 'token', 'api_?key'))}){_SIGN}[A-Za-z0-9+/_.=-]+"
_ACCOUNT = f"\\b(?:{'|'.join(_any_case(w) for w in ('username', 'user', 'login', 'account', 'client_?id'))}){_SIGN}[A-Za-z0-9_.@-]{{3,}}"
_ENDPOINT = "\\b(?:https?|ftp|s3|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\"''<>]+"

ORACLES: dict[str, str] = {
    "op1_secrets": f"""
        WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t FROM documents),
        base AS (SELECT *, 0 AS k, 's' AS role FROM ({_places(_ASSIGN, "assign", "length(regexp_replace(m, '^[^:=]*[:=]\\x20*[\"'']?', '')) >= 8")})
            UNION ALL SELECT *, 1, 'i' FROM ({_places("AKIA[A-Z0-9]+", "access", "length(m) >= 16")})
            UNION ALL SELECT *, 2, 's' FROM ({_places("[0-9a-f]{32,}", "hex")})),
        weak AS (SELECT *, 3 AS k, 's' AS role FROM ({_places("[A-Za-z0-9+/_-]{20,}", "token", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')")})
            UNION ALL SELECT *, 4, 'i' FROM ({_places(_ACCOUNT, "account")})
            UNION ALL SELECT *, 5, 'e' FROM ({_places(_ENDPOINT, "endpoint")})),
        blank AS ({_places("\\n[ \\t\\r]*\\n", "blank")}),
        part AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM weak),
        link AS MATERIALIZED (SELECT a.u, a.s, a.e, a.k, a.kind, b.s AS s2, b.e AS e2, b.k AS k2, b.kind AS kind2 FROM part a JOIN part b ON a.u = b.u AND b.s BETWEEN a.e AND a.e + 200
            WHERE a.role || b.role IN ('si', 'is', 'se', 'es') AND NOT EXISTS (SELECT 1 FROM blank x WHERE x.u = a.u AND x.s >= a.e AND x.s < b.s)),
        spans AS (SELECT u, s, e, k, kind FROM base UNION SELECT u, s, e, k, kind FROM link WHERE k > 2 UNION SELECT u, s2, e2, k2, kind2 FROM link WHERE k2 > 2),
        r AS (SELECT u, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS c, count(*) FILTER (WHERE k = 2) AS h,
                     string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM spans GROUP BY u),
        n AS (SELECT u, count(*) AS n FROM link GROUP BY u)
        SELECT d.doc_id, coalesce(r.a, 0) AS n_assign, coalesce(r.c, 0) AS n_access, coalesce(r.h, 0) AS n_hex, sha256(coalesce(r.base, '')) AS base_sha256,
               coalesce(r.spans, '') AS spans, coalesce(n.n, 0) AS n_links FROM d LEFT JOIN r USING (u) LEFT JOIN n USING (u)""",
    "op2_jaccard": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS t FROM documents),
        w AS (SELECT u, doc_id, {_WORDS.format(t="t")} AS w FROM d),
        sets AS (SELECT u, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
        e AS MATERIALIZED (SELECT u, len(g) AS n, unnest(g) AS g FROM sets),
        links AS MATERIALIZED (SELECT a.u AS a, b.u AS b FROM e a JOIN e b ON a.g = b.g AND a.u <> b.u AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
                  GROUP BY a.u, b.u, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        reach(u, c) AS (SELECT u, doc_id FROM sets UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.u)
        SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, r.component_id FROM sets s JOIN (SELECT u, min(c) AS component_id FROM reach GROUP BY u) r USING (u)""",
    "op5_rlz": f"""
        WITH d AS (SELECT row_number() OVER () AS u, doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
        p AS (SELECT u, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word,
                     unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + 34 <= len(w) THEN md5_number(array_to_string(w[i:i + 34], ' ')) END)) AS h FROM d),
        c AS (SELECT u, p, word, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS hit FROM p),
        k AS (SELECT u, p, word, bool_or(hit) OVER (PARTITION BY u ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
        r AS (SELECT u, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY u)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(r.n_removed, 0) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (u)""",
    "op6_near": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS u, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        ok AS (SELECT u, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        links AS MATERIALIZED (SELECT a.u AS a, b.u AS b FROM ok a JOIN ok b ON a.label = b.label AND a.u <> b.u AND len(a.e) = len(b.e)
                  WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
        reach(u, c) AS (SELECT u, vec_id FROM v UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.u),
        comp AS (SELECT u, min(c) AS component_id FROM reach GROUP BY u),
        n AS (SELECT a AS u, count(*) AS n FROM links GROUP BY a)
        SELECT v.vec_id, coalesce(n.n, 0) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept FROM v JOIN comp USING (u) LEFT JOIN n USING (u)""",
    "op7_rindex": """
        WITH d AS (SELECT row_number() OVER () AS u, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        cut AS (SELECT u, 1000 * c AS base, substr(x, 2000 * c + 1, 2398) AS x, least(1000, length(x) // 2 - 1000 * c) AS n
                FROM (SELECT u, x, unnest(range(0, (length(x) // 2 + 999) // 1000)) AS c FROM d)),
        p AS (SELECT u, base + i AS p, substr(x, 2 * i - 1, 2) AS byte, CASE WHEN 2 * (i + 199) <= length(x) THEN md5_number(substr(x, 2 * i - 1, 400)) END AS h
              FROM (SELECT u, base, x, unnest(range(1, n + 1)) AS i FROM cut)),
        c AS (SELECT u, p, byte, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS hit FROM p),
        k AS (SELECT u, p, byte, bool_or(hit) OVER (PARTITION BY u ORDER BY p ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM c),
        s AS (SELECT u, p, byte, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY u ORDER BY p), false) AS head FROM k),
        r AS (SELECT u, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE head) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM s GROUP BY u)
        SELECT d.doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(r.kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (u)""",
    "op8_topk": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS u, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                   FROM (SELECT DISTINCT vec_id, embedding FROM embeddings)
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.u, q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_trie": """
        WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
        p AS (SELECT c, r, x, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) - 1 AS p FROM t),
        v AS (SELECT c, n, c - c % 20 AS f, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda y: CAST(ascii(y) AS BIGINT))),
                 lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda z, i: xor(z >> 1, CASE WHEN z & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h
              FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
        s AS (SELECT v.*, least(v.h, coalesce(o.n, 0)) AS s FROM v LEFT JOIN v o ON o.c = v.f),
        b AS (SELECT s.c, p.p, r, x FROM s JOIN p ON p.c = s.f WHERE p.p < s.h UNION ALL SELECT s.c, p.p - s.h + s.s, r, x FROM s JOIN p ON p.c = s.c WHERE p.p >= s.h),
        m AS MATERIALIZED (SELECT c, p + 1 AS d, sha256(string_agg(sha256(length(r) || ':' || r || x), '' ORDER BY p) OVER (PARTITION BY c ORDER BY p)) AS k,
                     len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w FROM b UNION ALL SELECT c, 0, '', 0 FROM v),
        g AS (SELECT d, k, min(c) AS top, count(*) AS n, any_value(w) AS w FROM m GROUP BY d, k),
        q AS MATERIALIZED (SELECT m.c, m.d, g.top, g.n, (g.n - 1) * g.w AS w FROM m JOIN g ON g.d = m.d AND g.k = m.k),
        l AS (SELECT c, max(d) AS len FROM m GROUP BY c),
        e AS (SELECT q.d, q.top, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM q JOIN l USING (c) WHERE q.d = l.len GROUP BY q.d, q.top),
        o AS MATERIALIZED (SELECT a.d, a.top, a.n, a.w, b.top AS up FROM q a LEFT JOIN q b ON b.c = a.c AND b.d = a.d - 1 WHERE a.c = a.top),
        kids AS (SELECT d - 1 AS d, up AS top, count(*) AS n FROM o WHERE d > 0 GROUP BY 1, 2),
        z AS (SELECT a.d, a.top, sum(o.w) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves FROM o JOIN q a ON a.c = o.top AND a.d <= o.d LEFT JOIN kids ON kids.d = o.d AND kids.top = o.top GROUP BY 1, 2)
        SELECT o.top AS conv_id, CAST(o.d AS BIGINT) AS depth, o.up AS parent_conv_id, o.n AS n_convs, coalesce(kids.n, 0) AS n_children, CAST(z.leaves AS BIGINT) AS n_leaves,
               CAST(z.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
        FROM o JOIN z ON z.d = o.d AND z.top = o.top LEFT JOIN kids ON kids.d = o.d AND kids.top = o.top LEFT JOIN e ON e.d = o.d AND e.top = o.top""",
    "op12_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
        h AS (SELECT *, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (n + 1) AS b,
                     CASE WHEN n = 0 OR regexp_matches(t, '<[PSM]>') OR CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                          WHEN CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        c AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi FROM h),
        p AS (SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS x FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256 FROM p""",
}
