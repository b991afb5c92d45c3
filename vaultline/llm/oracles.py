"""DuckDB SQL for the queries that SQL can express, over whole tables."""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item, array_to_string(w[i : i + 12], ' ') AS p, 13 AS size FROM items, unnest(range(1, len(w) - 11)) AS t(i)
  WHERE len(w) >= 13
  UNION SELECT item, array_to_string(w, ' '), len(w) FROM items WHERE len(w) BETWEEN 1 AND 12),
docs AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS p
  FROM docs, (SELECT DISTINCT size FROM patterns) AS s, unnest(range(1, len(w) - size + 2)) AS t(i)),
hits AS (SELECT doc_id, i, size, item FROM places JOIN patterns USING (p, size)),
words_hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM hits) AS h, unnest(range(i, i + size)) AS t(k)
  GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words_hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text of ASCII characters; reads the list ``crc`` of one table, ``crc_table``."""
    bytes_ = f"list_transform(range(1, length({text}) + 1), lambda k: CAST(ord(substr({text}, k, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {bytes_}), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)"


CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i:
  list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc)"""


def _merkle(tree: str, levels: int) -> str:
    """CTEs over ``{tree}0`` (tree, r, n, d) and ``{tree}f0`` (tree, r, n, leaf, d, proof): the nodes of each level, then each leaf's fold and proof."""
    out = []
    for k in range(1, levels + 1):
        out.append(f"{tree}{k} AS MATERIALIZED (SELECT tree, r // 2 AS r, any_value(n) AS n, sha256(string_agg(d, '' ORDER BY r)) AS d FROM {tree}{k - 1} WHERE n > {1 << (k - 1)} GROUP BY tree, r // 2)")
        beside = f"SELECT tree, xor(r, 1) AS beside, d AS s FROM {tree}{k - 1}"
        out.append(
            f"{tree}f{k} AS MATERIALIZED (SELECT f.tree, r, n, leaf, CASE WHEN n <= {1 << (k - 1)} THEN d WHEN (r >> {k - 1}) % 2 = 1 THEN sha256(coalesce(s, '') || d) ELSE sha256(d || coalesce(s, '')) END AS d,"
            f" CASE WHEN n <= {1 << (k - 1)} THEN proof ELSE proof || coalesce(s, '') END AS proof FROM {tree}f{k - 1} AS f LEFT JOIN ({beside}) AS b ON f.tree = b.tree AND r >> {k - 1} = beside)"
        )
    return ",\n".join(out)


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def _tops(tree: str, levels: int) -> str:
    return " UNION ALL ".join(f"SELECT tree, d FROM {tree}{k} WHERE n <= {1 << k}" + (f" AND n > {1 << (k - 1)}" if k else "") for k in range(levels + 1))


OP13 = f"""
WITH {CRC_TABLE},
docs AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf('n_chars')} AS leaf,
    CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS changed
  FROM documents, crc_table),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY tree) AS n FROM docs),
l0 AS MATERIALIZED (SELECT tree, r, n, leaf AS d FROM placed),
lf0 AS MATERIALIZED (SELECT tree, r, n, leaf, changed AS d, '' AS proof FROM placed),
{_merkle("l", 20)},
subroots AS MATERIALIZED ({_tops("l", 20)}),
t0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS r, count(*) OVER () AS n, d, tree AS of_ FROM subroots),
joined AS MATERIALIZED (
  SELECT t0.r, t0.n, lf20.tree, lf20.r AS own, leaf, lf20.d, proof, t0.d AS subroot FROM lf20 JOIN t0 ON lf20.tree = t0.of_),
tf0 AS MATERIALIZED (SELECT '' AS tree, r, n, tree || '|' || own AS leaf, d, proof FROM joined),
{_merkle("t", 6)},
root AS ({_tops("t", 6)})
SELECT doc_id, placed.leaf, subroot, root.d AS root, sha256(tf6.proof) AS proof_sha256, tf6.d AS folded_root, tf6.d = root.d AS verified
FROM placed JOIN joined ON placed.tree = joined.tree AND placed.r = joined.own JOIN tf6 ON tf6.leaf = joined.tree || '|' || joined.own, root
"""

OP8 = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM docs, unnest(range(1, len(w) - 48)) AS t(i)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
hits AS (SELECT doc_id, i, true AS hit FROM windows JOIN firsts USING (h) WHERE first < doc_id),
words AS (SELECT doc_id, i, w[i] AS word FROM docs, unnest(range(1, len(w) + 1)) AS t(i)),
marked AS (
  SELECT doc_id, i, word, coalesce(bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
  FROM words LEFT JOIN hits USING (doc_id, i)),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

OP9 = r"""
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT doc_id, i, md5_number(array_slice(b, i, i + 49)) AS h FROM docs, unnest(range(1, octet_length(b) - 48)) AS t(i)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE first < doc_id),
marks AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new_ FROM hits),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(new_) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marks) GROUP BY doc_id, g),
gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS a, a AS z FROM spans
  UNION ALL SELECT doc_id, max(z), 2147483647 FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, unhex(string_agg(hex(array_slice(b, a, z - 1)), '' ORDER BY a)) AS kept FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(kept, b)) AS kept_sha256
FROM docs LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_TEXT = "coalesce(text, '')"
_WORDS = rf"regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+')"

#: SQL for those columns of other queries that SQL can express.
COLUMNS = {
    "op2_token_counts": f"SELECT doc_id, CAST(octet_length(encode({_TEXT})) AS BIGINT) AS n_bytes FROM documents",
    "op3_quality_rules": rf"""
WITH docs AS (SELECT doc_id, {_TEXT} AS t, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS h FROM docs, unnest(range(1, len(w) - 6)) AS x(i)),
twice AS (SELECT doc_id, h FROM windows GROUP BY ALL HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM windows JOIN twice USING (doc_id, h)) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(w) AS base_failed
FROM docs JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)""",
    "op4_sharding": f"SELECT doc_id, CAST(octet_length(encode({_TEXT})) + 1 AS BIGINT) AS size, 'rows' AS law FROM documents",
    "op6_secrets": rf"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, {_TEXT} AS t FROM documents)""",
    "op12_embedding_whitening": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) + 1000000) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
each AS (SELECT vec_id, i, x[i] AS x, sum(x[i]) OVER (PARTITION BY i) AS s, count(*) OVER (PARTITION BY i) AS n FROM v, unnest(range(1, len(x) + 1)) AS t(i)),
rows_ AS (SELECT vec_id, any_value(n) AS n, CAST(sum((n * x - s) * (n * x - s)) AS BIGINT) AS deviation FROM each GROUP BY vec_id)
SELECT vec_id, CAST(component AS INTEGER) AS component, n, deviation FROM rows_, unnest(range(1, 33)) AS c(component)""",
}
