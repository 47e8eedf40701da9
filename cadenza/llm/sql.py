"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from cadenza.llm.sharding import MULTIPLIER
from cadenza.llm.url_filter import LONG_SUFFIXES

_STRENGTH = """(SELECT coalesce(CASE WHEN between_ > 0 THEN least(greatest(mean * (1 - mean) / between_ - 1, 1.0), 1000.0) END, 1000.0) FROM (
      SELECT mean, var_pop(good / n) FILTER (n >= 5) - avg(1.0::DOUBLE / n) FILTER (n >= 5) * mean * (1 - mean) AS between_
      FROM {rows}, (SELECT sum(good) FILTER (n >= 5) / sum(n) FILTER (n >= 5) AS mean FROM {rows}) GROUP BY mean))"""

OP10_URL_FILTER = f"""
WITH p AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
keyed AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '(:\\d*)?\\.*$', '') AS site FROM p),
rules AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) r(rh, rp, rv)),
matched AS (
    SELECT page_id, host, path, site, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
    FROM keyed LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
worst AS (SELECT doc_id, least(min(coalesce(quality, 1)), 1 - max(coalesce(toxic, 0))) AS good FROM labels GROUP BY doc_id),
named AS (
    SELECT site AS host, coalesce(CAST(sum(good) AS DOUBLE), 0) AS good, CAST(count(good) AS DOUBLE) AS n FROM (
        SELECT site, try_cast(nullif(regexp_extract(path, '/(\\d{{1,18}})(?:\\.html)?/?$', 1), '') AS BIGINT) AS doc_id FROM keyed) LEFT JOIN worst USING (doc_id)
    WHERE site <> '' GROUP BY site),
parts AS (
    SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS two, array_to_string(string_split(host, '.')[-3:], '.') AS three,
           regexp_matches(host, '^(\\[.*\\]|\\d{{1,3}}(\\.\\d{{1,3}}){{3}})$') AS address FROM named),
hosts AS (
    SELECT host, good, n, CASE WHEN address THEN host WHEN two IN ({", ".join(f"'{x}'" for x in LONG_SUFFIXES)}) THEN three ELSE two END AS domain,
           CASE WHEN address THEN 'address' WHEN two IN ({", ".join(f"'{x}'" for x in LONG_SUFFIXES)}) THEN two ELSE string_split(host, '.')[-1] END AS suffix
    FROM parts),
domains AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM domains GROUP BY ALL),
world AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS prior, coalesce(sum(n), 0) AS seen FROM suffixes),
suffix_prior AS (SELECT suffix, (good + k * prior) / (n + k) AS prior FROM suffixes, world, (SELECT {_STRENGTH.format(rows='suffixes')} AS k)),
domain_prior AS (SELECT domain, (good + k * prior) / (n + k) AS prior FROM domains JOIN suffix_prior USING (suffix), (SELECT {_STRENGTH.format(rows='domains')} AS k)),
host_post AS (SELECT host, n + k AS total, (good + k * prior) / (n + k) AS mean FROM hosts JOIN domain_prior USING (domain), (SELECT {_STRENGTH.format(rows='hosts')} AS k)),
bounds AS (SELECT host AS site, mean - sqrt(mean * (1 - mean) / (total + 1)) AS bound FROM host_post, world WHERE seen > 0)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN bound < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(bound, 6) AS bound
FROM matched LEFT JOIN bounds USING (site)
"""


def _jump(shards: int) -> str:
    """Jump recurrence over unsigned 64-bit states in 128-bit integers; the loop ends after as many steps as there are shards."""
    return f"""list_reduce(list_prepend({{'s': key::HUGEINT, 'b': -1::HUGEINT, 'j': 0::HUGEINT}}, [{{'s': 0::HUGEINT, 'b': 0::HUGEINT, 'j': 0::HUGEINT}} FOR i IN range({shards})]),
        lambda a, x: CASE WHEN a.j < {shards} THEN {{'s': (a.s * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT, 'b': a.j,
          'j': floor((a.j + 1)::DOUBLE * (2147483648::DOUBLE / ((((a.s * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT) // 8589934592::HUGEINT) + 1)::DOUBLE))::HUGEINT}} ELSE a END).b::INTEGER"""


_KEY = "('0x' || left(md5({0}), 15))::BIGINT"

#: CRC-32 by its rule: a table of 256 entries made by eight shift steps each, then one step for each byte of the text.
OP2_SHARDING = f"""
WITH crc_table AS (SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
bytes AS (SELECT text, list_transform(string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g')), ' '), lambda h: CASE WHEN h = '' THEN NULL ELSE ('0x' || h)::BIGINT END) AS bs FROM texts),
crcs AS (SELECT text, CASE WHEN text = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS text_crc32 FROM bytes, crc_table),
rows_ AS (
    SELECT doc_id, strlen(coalesce(d.text, '')) + 1 AS size, text_crc32, {_KEY.format("coalesce(CAST(doc_id AS VARCHAR), 'null key')")} AS key
    FROM documents d JOIN crcs c ON coalesce(d.text, '') = c.text),
placed AS (
    SELECT doc_id, size, text_crc32, {_jump(8)} AS shard, {_jump(9)} AS grown_shard,
           {_KEY.format("concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR), CAST(text_crc32 AS VARCHAR))")} % 4096 AS chunk FROM rows_)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY chunk, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM placed
"""

#: Fill-in-middle: the units as a list, cut by rank; the hash of 42 and the id decides ranks and form.
OP13_FILL_IN_MIDDLE = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
           sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents),
drawn AS (
    SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM units),
formed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
parts AS (
    SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
