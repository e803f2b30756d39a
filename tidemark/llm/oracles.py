"""DuckDB SQL of the operators' queries that SQL can express."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, chr(1))] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], chr(1)))) END AS s FROM w),
 u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
 links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.d, edges.b FROM reach JOIN edges ON edges.a = reach.r),
 c AS (SELECT d, min(r) AS c FROM reach GROUP BY d)
 SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN c ON c.d = s.doc_id"""

OP6 = """WITH z AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS ss FROM z GROUP BY source),
 w AS (SELECT source, ss, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 3.0::DOUBLE * ss AS cap, (sum(ss) OVER ())::DOUBLE AS everything FROM s),
 f AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS i FROM w),
 l AS (SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM f),
 t AS (SELECT source, ss, least(cap, coalesce(w * (SELECT lev FROM l WHERE lev <= cap / w ORDER BY i LIMIT 1), cap)) AS target FROM l),
 p AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS whole, greatest(target - CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END * ss, 0) AS lack FROM t),
 h AS (SELECT z.source, size, lack, size::DOUBLE * size * count(*) AS sq, size * count(*) AS n FROM z JOIN p ON z.source IS NOT DISTINCT FROM p.source WHERE size > 0 AND lack > 0 GROUP BY z.source, size, lack),
 e AS (SELECT source, size, (lack - (sum(n) OVER (PARTITION BY source ORDER BY size DESC) - n)) / sum(sq) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM h),
 v AS (SELECT source, arg_max(rate, size) AS rate FROM e WHERE rate * size < 1 GROUP BY source),
 d AS (SELECT doc_id, size, ss, target, whole, lack, z.source, CASE WHEN lack > 0 AND size > 0 THEN least(1.0::DOUBLE, coalesce(rate, 1.0::DOUBLE) * size) END AS f, (('0x' || substr(md5('17:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
 FROM z JOIN p ON z.source IS NOT DISTINCT FROM p.source LEFT JOIN v ON z.source IS NOT DISTINCT FROM v.source),
 x AS (SELECT *, u * (1 - f) / (u * (1 - f) + (1 - u) * f) AS x FROM d),
 r AS (SELECT source, x, sum(size) OVER (PARTITION BY source ORDER BY x) AS cum, lack FROM x WHERE x IS NOT NULL),
 c AS (SELECT source, x, abs(cum - lack) AS off FROM r UNION ALL SELECT DISTINCT source, -1.0, lack FROM r), b AS (SELECT source, arg_min(x, (off, x)) AS upto FROM c GROUP BY source)
 SELECT doc_id, size, ss AS source_size, round(target, 6) AS target, ((whole + CASE WHEN x <= upto THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM x LEFT JOIN b ON x.source IS NOT DISTINCT FROM b.source"""

_HOST = "translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1), ''), '" + _UP + "', '" + _LOW + "')"


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


def op8(rules: list[tuple[str, str, str]]) -> str:
    """Rules as a chain from the longest to the shortest."""
    chain = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    rule = " ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in chain)
    verdict = " ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in chain)
    return f"WITH u AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages) SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM u"


OP10 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT h, max(page_id) AS top FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
 SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN top IS NOT NULL AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to FROM p LEFT JOIN m USING (h)"""


_UNIT = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"


def _word(at: int) -> str:
    return f"('0x' || substr(h, {8 * at + 1}, 8))::BIGINT"


OP11 = f"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS u, sha256('42:' || doc_id) AS h FROM documents),
 c AS (SELECT doc_id, t, u, len(u) AS n, least({_word(0)} % (len(u) + 1), {_word(1)} % (len(u) + 1)) AS a, greatest({_word(0)} % (len(u) + 1), {_word(1)} % (len(u) + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_word(2)} % 100 >= 50 THEN 'plain' WHEN {_word(3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
 p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
 SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
 sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM p"""

_GAP = " + ".join(f"(q[{j}] - e[{j}]) * (q[{j}] - e[{j}])" for j in range(1, 5))
_MEAN = ", ".join(f"(sum(q[{j}])::BIGINT - ((sum(q[{j}])::BIGINT % count(*)) + count(*)) % count(*)) // count(*)" for j in range(1, 5))


def _assigned(name: str, books: str) -> str:
    return f"""{name} AS (SELECT vec_id, label, part, any_value(q) AS q, arg_min(entry, dist * 64 + entry) AS entry, min(dist) AS dist
 FROM (SELECT vec_id, label, p.part, q, entry, {_GAP} AS dist FROM p JOIN {books} USING (part)) GROUP BY vec_id, label, part)"""


def _refined(name: str, books: str, assigned: str) -> str:
    return f"""{name} AS (SELECT part, entry, coalesce(m, e) AS e FROM {books} LEFT JOIN (SELECT part, entry, [{_MEAN}] AS m FROM {assigned} GROUP BY part, entry) USING (part, entry))"""


#: For vectors of 64 components and unique ids, as the table has them.
OP12 = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT vec_id, label, i AS part, v[4 * i + 1:4 * i + 4] AS q FROM kept, range(16) r(i)),
 b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, q AS e FROM p WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
 {_assigned("a1", "b0")}, {_refined("b1", "b0", "a1")}, {_assigned("a2", "b1")}, {_refined("b2", "b1", "a2")}, {_assigned("a3", "b2")},
 c AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a3 GROUP BY vec_id, label)
 SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256 FROM c"""
