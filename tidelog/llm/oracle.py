"""DuckDB SQL for the operators that SQL can express. Their rows must equal the queries' rows."""

from __future__ import annotations

#: Documents with a key of a secret, its separators and its value; letters of the key in either case.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, ordinal: int, pattern: str, keep: str) -> str:
    """Spans of a pattern: the lengths of gaps and matches before each, summed."""
    upto = lambda of, n: f"coalesce(list_sum(list_transform({of}[1:{n}], lambda x: length(x))), 0)"
    span = f"{{'s': CAST({upto('g', 'i')} + {upto('m', 'i - 1')} AS BIGINT), 'e': CAST({upto('g', 'i')} + {upto('m', 'i')} AS BIGINT), 'm': m[i]}}"
    cut = f"SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d"
    return f"SELECT doc_id, {ordinal} AS o, '{kind}' AS kind, x.s AS s, x.e AS e FROM (SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {span})) AS x FROM ({cut})) WHERE {keep}"


SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS (
  {_spans("assign", 0, ASSIGN, "length(regexp_extract(x.m, '" + ASSIGN + "', 2)) >= 6")}
  UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", "length(x.m) >= 20")}
  UNION ALL {_spans("hex", 2, "[0-9a-f]{24,}", "true")}
), base AS (
  SELECT doc_id, count(*) FILTER (WHERE o = 0) AS a, count(*) FILTER (WHERE o = 1) AS k, count(*) FILTER (WHERE o = 2) AS h, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM found GROUP BY doc_id
), more AS (
  {_spans("pem", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true")} UNION ALL {_spans("forge", 4, "gh[opsu]_[A-Za-z0-9]{36}", "true")}
), whole AS (
  SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM (FROM found UNION ALL FROM more) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base.spans, '')) AS base_sha256, coalesce(whole.spans, '') AS spans
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN whole ON whole.doc_id = d.doc_id"""

#: CRC-32 byte by byte, its table built from the polynomial.
SHARDS = """WITH crc AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), list_transform(range(0, 8), lambda x: CAST(0 AS BIGINT))), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), raw AS (
  SELECT doc_id, source, CAST(strlen(coalesce(text, '')) AS BIGINT) + 16 AS size, hex(encode(coalesce(text, ''))) AS hx FROM documents
), sums AS (
  SELECT doc_id, source, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(hx) // 2), lambda i: CAST(concat('0x', substr(hx, 2 * i + 1, 2)) AS BIGINT))), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM raw, crc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat('11:', doc_id)), doc_id, text_crc32, size) AS r, count(*) OVER (PARTITION BY source) AS n FROM sums
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * n), concat('s', source), r) - 1 AS place, count(*) OVER () AS whole FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 40 // whole AS INTEGER) AS shard, place - (place * 40 // whole * whole + 39) // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed"""

#: Base32 of a SHA-1: each group of five hexadecimal digits is four letters.
PAGES = """WITH d AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), keep AS (
  SELECT hex, payload_bytes, max(page_id) AS keeper FROM d GROUP BY ALL
)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST(concat('0x', substr(hex, i // 4 * 5 + 1, 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d JOIN keep USING (hex, payload_bytes)"""

ORACLE = {"op2_secrets": SECRETS, "op5_sharding": SHARDS, "op10_warc": PAGES}
