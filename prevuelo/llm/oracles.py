"""DuckDB SQL for the results that SQL can express."""

ORACLES: dict[str, str] = {
    "op2_repeats": """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), strings AS (
    SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM d, range(0, n - 199) AS t(i)
), again AS (
    SELECT doc_id, i FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)
), marked AS (
    SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM again
), numbered AS (
    SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), runs AS (
    SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, run
), gaps AS (
    SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY run) AS b FROM runs
    UNION ALL SELECT doc_id, 0, min(a) FROM runs GROUP BY doc_id
), rest AS (
    SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
), found AS (
    SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, CAST(count(*) AS BIGINT) AS n_spans FROM runs GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest.h, d.h))) AS kept_sha256
FROM d LEFT JOIN found USING (doc_id) LEFT JOIN rest USING (doc_id)
""",
    "op7_neighbours": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
      AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a
), roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN roots ON roots.a = vec_id LEFT JOIN counts ON counts.a = vec_id
""",
    "op11_fim": r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents
), u AS (
    SELECT *, string_split(t, chr(10)) AS parts, len(t) - len(replace(t, chr(10), '')) AS ends FROM d
), c AS (
    SELECT *, CAST(ends + CASE WHEN t = '' OR t[-1] = chr(10) THEN 0 ELSE 1 END AS BIGINT) AS n,
           CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
           CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM u
), k AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c
), e AS (
    SELECT *, CASE WHEN a > ends THEN len(t) ELSE len(array_to_string(parts[1:a], chr(10))) + CASE WHEN a > 0 THEN 1 ELSE 0 END END AS x,
           CASE WHEN b > ends THEN len(t) ELSE len(array_to_string(parts[1:b], chr(10))) + CASE WHEN b > 0 THEN 1 ELSE 0 END END AS y FROM k
), p AS (
    SELECT *, substr(t, 1, x) AS pre, substr(t, x + 1, y - x) AS mid, substr(t, y + 1) AS suf FROM e
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(x AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(y - x AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
""",
    "op12_spelling": r"""
WITH RECURSIVE steps(i, c, k) AS (
    SELECT i, CAST(i AS UBIGINT), 0 FROM range(256) AS r(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS crcs FROM steps WHERE k = 8),
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents
), counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE len(run) >= 6 GROUP BY doc_id, run),
coded AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM counted),
hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT),
        list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS UBIGINT))),
        lambda c, b: xor(c >> 8, crcs[CAST(xor(c, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS h FROM coded, crc
), changed AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % len(run) AS BIGINT)) || substr(run, CAST(h % len(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), less AS (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, range(len(word)) AS r(i)),
near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less AS a JOIN less AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM less AS a JOIN words AS b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM less AS a JOIN words AS b ON a.rest = b.word
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, hex(encode(other))) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near
), formed AS (
    SELECT w.word, w.n, CAST(coalesce(r.n_near, 0) AS BIGINT) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
           CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
    FROM words AS w LEFT JOIN ranked AS r ON r.word = w.word AND place = 1
), path(word, root) AS (
    SELECT word, word FROM formed
    UNION ALL SELECT p.word, f.form FROM path AS p JOIN formed AS f ON p.root = f.word WHERE f.form IS NOT NULL
), roots AS (SELECT p.word, p.root FROM path AS p JOIN formed AS f ON p.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
""",
}
