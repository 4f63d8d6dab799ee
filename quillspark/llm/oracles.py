"""SQL for DuckDB of the operators that it can express over whole tables."""

_WORDS = r"'[^\x20\x09-\x0D]+'"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _clustering() -> str:
    """Three rounds of k-means, each as two tables; // rounds towards zero, so the remainder goes first."""
    near = lambda c: f"SELECT vec_id, i, v, cluster, d FROM (SELECT vec_id, i, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, {c}) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, cluster) = 1"
    steps = [f"""v AS (SELECT vec_id, row_number() OVER () AS i, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND {_FINITE})""",
             "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v AS c FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < 16)"]
    for r in range(3):
        steps += [
            f"n{r} AS ({near(f'c{r}')})",
            f"s{r} AS (SELECT cluster, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM n{r}) GROUP BY ALL)",
            f"m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{r} GROUP BY cluster)",
            f"c{r + 1} AS (SELECT cluster, coalesce(m.c, p.c) AS c FROM c{r} p LEFT JOIN m{r} m USING (cluster))",
        ]
    steps.append(f"n AS ({near('c3')})")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, cluster::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM n JOIN c3 USING (cluster)"""


def _merkle() -> str:
    """Trees level by level; proofs and folded roots walk up from each document, through its source's tree and then the one above."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars')))} || {field(text)})"
    tree = lambda name, leaves: f"""{name} AS (SELECT 0 AS lv, tree, pos, count(*) OVER (PARTITION BY tree) AS n, digest FROM {leaves} UNION ALL
  SELECT lv + 1, tree, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY lv, tree, pos // 16)"""  # noqa: E731
    up = lambda name, start, nodes: f"""{name} AS ({start} UNION ALL
  SELECT doc_id, any_value(u.claim), lv + 1, tree, u.pos // 16, (any_value(n) + 15) // 16, any_value(proof) || coalesce(string_agg(digest, '' ORDER BY t.pos) FILTER (t.pos <> u.pos), ''), sha256(string_agg(CASE WHEN t.pos = u.pos THEN hash ELSE digest END, '' ORDER BY t.pos))
  FROM {name} u JOIN (SELECT lv, tree, pos, digest FROM {nodes}) t USING (lv, tree) WHERE n > 1 AND t.pos // 16 = u.pos // 16 GROUP BY doc_id, lv, tree, u.pos)"""  # noqa: E731
    return f"""WITH RECURSIVE poly AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf, {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other,
  xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % 5 = 0 AS hit FROM documents, poly),
l AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
{tree('nodes', 'l')}, roots AS (SELECT tree AS name, digest, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos FROM nodes WHERE n = 1), {tree('high', 'roots')},
{up('low', "SELECT doc_id, hit AS claim, 0 AS lv, tree, pos, count(*) OVER (PARTITION BY tree) AS n, '' AS proof, CASE WHEN hit THEN other ELSE leaf END AS hash FROM l", 'nodes')},
{up('over_all', "SELECT doc_id, claim, 0 AS lv, '' AS tree, r.pos, (SELECT count(*) FROM roots) AS n, proof, hash FROM low u JOIN roots r ON r.name = u.tree WHERE u.n = 1", 'high')}
SELECT l.doc_id, l.leaf, roots.digest AS subroot, (SELECT digest FROM high WHERE n = 1) AS root, sha256(proof) AS proof_sha256, hash AS folded_root, hash = (SELECT digest FROM high WHERE n = 1) AS verified
FROM l JOIN roots ON roots.name = l.tree JOIN over_all o ON o.doc_id = l.doc_id WHERE o.n = 1"""


#: What is escaped in chats, and the marks' lengths.
_GUARD = r"<\\*/?s>|\[\\*/?(?:INST|SYS|ANS|ROLE|TURN)\]"

ORACLES = {
    "op11_merkle": _merkle(),
    "op12_clustering": _clustering(),
    "op13_chat": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(i, r)),
p AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_GUARD}')) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 19 + length(role) + len(regexp_extract_all(role, '{_GUARD}')) END AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, (coalesce(sum(length(text)) FILTER (role = 'assistant'), 0))::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, (3 + sum(size))::BIGINT AS formatted_chars FROM p GROUP BY conv_id""",
    "op4_substring": rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS a FROM documents),
p AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(a[i : i + 12], ' ') AS g FROM (SELECT doc_id, a, unnest(range(1, len(a) - 11)) AS i FROM w WHERE len(a) >= 13)),
f AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g), hit AS (SELECT doc_id, i FROM win JOIN f USING (g) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(13)) AS k FROM hit)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(a)::BIGINT AS n_words, len(a) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op6_topk": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS a FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.a, c.a)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.a) = len(c.a) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= 10""",
    "op8_jaccard": rf"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS a FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(a[i : i + 4], ' ') AS g FROM (SELECT doc_id, a, unnest(range(1, len(a) - 3)) AS i FROM w WHERE len(a) >= 5) UNION ALL SELECT doc_id, array_to_string(a, ' ') FROM w WHERE len(a) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (WITH RECURSIVE t(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.node WHERE t.root < e.b) SELECT node, min(root) AS root FROM t GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(r.root, w.doc_id), w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.node = w.doc_id""",
    "op9_vectors": f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND {_FINITE} AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
r AS (WITH RECURSIVE t(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.node WHERE t.root < e.b) SELECT node, min(root) AS root FROM t GROUP BY node)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(r.root, vec_id), vec_id) AS component_id, vec_id = coalesce(least(r.root, vec_id), vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN r ON r.node = vec_id""",
}
