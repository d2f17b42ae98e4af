"""DuckDB SQL for those queries of this subpackage that SQL can express."""

ORACLE: dict[str, str] = {}

_REST = "CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0) END"
_HOST = "regexp_extract(rest, '^[^/]*', 0)"

ORACLE["op9_url_filter"] = f"""
WITH parts AS (
  SELECT page_id, translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length({_HOST}) + 1) AS path
  FROM (SELECT page_id, {_REST} AS rest FROM pages)),
rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
ranked AS (
  SELECT page_id, host, path, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS place
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE place = 1
"""

_WORDS = r"[x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') IF x <> '']"


def _runs(k: int) -> str:
    return f"list_distinct([array_to_string(w[i + 1 : i + {k}], ' ') FOR i IN range(len(w) - {k} + 1)])"


ORACLE["op10_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item_id, w, least(len(w), 5) AS k, unnest(CASE WHEN len(w) >= 5 THEN {_runs(5)} ELSE [array_to_string(w, ' ')] END) AS s FROM b WHERE len(w) > 0),
sized AS (SELECT item_id, w, k, count(*) AS n FROM i GROUP BY ALL),
s AS ({" UNION ALL ".join(f"SELECT doc_id, {k} AS k, unnest({_runs(k)}) AS s FROM d WHERE len(w) >= {k} AND {k} IN (SELECT k FROM sized)" for k in range(1, 6))}),
m AS (SELECT doc_id, item_id, i.w AS w, k, count(*) AS matched FROM s JOIN i USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n AS item_shingles, matched FROM m JOIN sized USING (item_id, w, k) WHERE matched >= ceil(n * 0.8 - 1e-9)
"""


def _mixing(alpha: dict[str, float], sweeps: int, tolerance: float, settled: int, gain: float) -> str:
    """Raking as a recursive query: a step is a sweep, and its error and the one before decide on another."""
    dims = ("source", "lang", "topic")
    fewer = lambda x: f"(length(body) - length(replace(body, {x}, '')))"
    topic = f"""CASE WHEN tokens = 0 THEN 'none' WHEN {fewer("'|'")} * 50 >= length(body) THEN 'table' WHEN (length(body) - length(translate(body, '#$%&*+<=>^_{{}}~', ''))) * 100 >= length(body) THEN 'code'
      WHEN contains(body, '://') OR regexp_matches(body, '[A-Za-z0-9]@[A-Za-z0-9]') THEN 'contact' WHEN tokens < 6 * ({fewer("chr(10)")} + 1) THEN 'list' WHEN tokens < 100 THEN 'note' ELSE 'prose' END"""
    known = lambda x: f"coalesce('=' || {x}, '')"
    goals = ", ".join(f"g_{x}" for x in dims)
    steps = [
        f"d AS (SELECT doc_id, {known('source')} AS source, {known('lang')} AS lang, '=' || {topic} AS topic, tokens FROM (SELECT *, coalesce(text, '') AS body, len({_WORDS}) AS tokens FROM documents))",
        "c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        "r0 AS (SELECT * FROM c WHERE tokens > 0)",
        "total AS (SELECT sum(tokens) AS total FROM r0)",
    ]
    for x in dims:
        steps.append(f"t_{x} AS (SELECT {x}, w / sum(w) OVER () * total AS g_{x} FROM (SELECT {x}, pow(sum(tokens) / any_value(total), {alpha[x]}) AS w, any_value(total) AS total FROM r0, total GROUP BY {x}))")
    inner = f"SELECT * FROM r WHERE error > {tolerance!r} AND (k < {settled} OR error <= {gain} * before) AND k < {sweeps}"
    inner = f"SELECT * REPLACE (k + 1 AS k, error AS before, 0.0::DOUBLE AS error) FROM ({inner})"
    for x in dims:
        inner = f"SELECT * EXCLUDE own REPLACE (raked * g_{x} / own AS raked, greatest(error, abs(own - g_{x}) / g_{x}) AS error) FROM (SELECT *, sum(raked) OVER (PARTITION BY {x}) AS own FROM ({inner}))"
    steps.append(f"r AS (SELECT 0 AS k, source, lang, topic, tokens, {goals}, tokens AS raked, 'inf'::DOUBLE AS error, 'inf'::DOUBLE AS before FROM r0 {' '.join(f'JOIN t_{x} USING ({x})' for x in dims)} UNION ALL SELECT * REPLACE (max(error) OVER () AS error) FROM ({inner}))")
    steps.append("p AS (SELECT source, lang, topic, raked / tokens / max(raked / tokens) OVER () AS probability FROM r WHERE k = (SELECT max(k) FROM r) UNION ALL SELECT source, lang, topic, 1.0 FROM c WHERE tokens = 0)")
    draw = "('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0"
    shown = ", ".join(f"CASE WHEN {x} <> '' THEN substr({x}, 2) END AS {x}" for x in dims)
    return f"WITH RECURSIVE {', '.join(steps)} SELECT doc_id, {shown}, round(probability, 9) AS probability FROM d JOIN p USING (source, lang, topic) WHERE {draw} < probability"


ORACLE["op6_mixing"] = _mixing({"source": 0.7, "lang": 1.0, "topic": 1.0}, 60, 1e-9, 8, 0.99)

_BASE32 = "[" + ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, {5 * (k // 4) + 1}, 5))::BIGINT >> {15 - 5 * (k % 4)} & 31)::INT + 1, 1)" for k in range(32)) + "]"

ORACLE["op7_warc"] = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS top FROM pages)
SELECT page_id, payload_bytes, array_to_string({_BASE32}, '') AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM p
"""
