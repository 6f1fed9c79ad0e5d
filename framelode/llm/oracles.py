"""DuckDB SQL of the operators that SQL can express over whole tables.

Secret and personal-data spans (leftmost matches with positions), token counts (byte-pair merges), toxicity (a trained machine) and line
templates (groups by the least hash) have no SQL; tests/llm holds brute-force versions of them, or of the steps that they consist of.
"""

from __future__ import annotations

from . import mixing

SQL_SWEEPS, SQL_CUTS = 24, 6

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Rules as (verdict, host, path); links with a host of their own alone (the tables have no others, tests/llm covers them).
_OP4 = r"""
WITH RECURSIVE rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), tags AS (
  SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM pages
), urls AS (
  SELECT page_id, url, true AS own FROM pages
  UNION ALL SELECT page_id, regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1), false FROM tags WHERE regexp_matches(tag, '(?i)^<link.*\brel\s*=\s*["'']?canonical\b')
  UNION ALL SELECT page_id, regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1), false FROM tags WHERE regexp_matches(tag, '(?i)^<meta.*\bhttp-equiv\s*=\s*["'']?refresh\b')
), rests AS (
  SELECT page_id, own, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM urls
), cuts AS (
  SELECT page_id, own, rest, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rests
), places AS (
  SELECT c.page_id, c.own, c.host, c.path, c.rest, (SELECT arg_max(struct_pack(v := verdict, r := h || p), length(h || p)) FROM rules WHERE (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, p)) AS fit FROM cuts c
), named AS (
  SELECT DISTINCT page_id, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') || '?'
         || array_to_string(list_filter(string_split(substr(regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1), 2), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|gclid|fbclid|ref)(=|$)')), '&') AS address
  FROM places WHERE host <> ''
), e AS (
  SELECT a.page_id AS a, b.page_id AS b FROM named a JOIN (SELECT address, min(page_id) AS page_id FROM named GROUP BY address) b USING (address) WHERE a.page_id <> b.page_id
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (
  SELECT page_id AS n, page_id AS c FROM pages
  UNION SELECT x.b, r.c FROM r JOIN both_ways x ON x.a = r.n
), comp AS (SELECT n AS page_id, min(c) AS component FROM r GROUP BY n),
spread AS (
  SELECT component, bool_or(fit.v = 'allow') AS allowed FROM places JOIN comp USING (page_id) WHERE fit IS NOT NULL GROUP BY component
)
SELECT page_id, host, path, fit.r AS rule, coalesce(fit.v, CASE WHEN allowed THEN 'allow' WHEN NOT allowed THEN 'block' END, 'allow') AS verdict
FROM places JOIN comp USING (page_id) LEFT JOIN spread USING (component) WHERE own"""

_OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), k AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM k),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice WHERE n > 1) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS capitals, length(t) - length(translate(t, '!', '')) AS shouts
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 5 * n_symbols > n_words OR 10 * capitals > 3 * word_chars OR 4 * shouts > n_words
       OR word_chars < 2 * n_words OR word_chars > 30 * n_words OR 100 * n_dup_lines > 40 * n_lines) AS kept
FROM b"""

_OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ') || '  '] ELSE [] END) AS s FROM w
), x AS (SELECT doc_id, unnest(s) AS k FROM s),
n AS (SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT y.b, r.c FROM r JOIN both_ways y ON y.a = r.d)
SELECT doc_id, n.n AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM n JOIN r ON r.d = doc_id GROUP BY doc_id, n.n"""

_OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i : i + l - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') AS k
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw))
), h AS (SELECT doc_id, l, i, item_id FROM dw JOIN bw USING (l, k)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS j FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def mixing_sql(table: str = "documents", final: str | None = None) -> str:
    """The bounded raking of mixing.TARGETS, each sweep written out; SQL_SWEEPS are enough for the tables that SQL is run on."""
    dims = mixing.DIMENSIONS
    own = f"""own AS MATERIALIZED (
  SELECT *, coalesce(CASE WHEN contains(text, ' | ') THEN 'listing' WHEN contains(text, 'License') THEN 'licensed' WHEN n_tokens < 100 THEN 'note'
                 WHEN n_tokens > 1000 THEN 'longform' WHEN text IS NOT NULL THEN 'article' END, 'note') AS topic
  FROM (SELECT doc_id, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM {table})
), c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE / sum(sum(n_tokens)) OVER () AS w,
  sum(n_tokens)::DOUBLE / (sum(sum(n_tokens)) OVER () * {mixing.BUDGET!r}::DOUBLE) AS cap FROM own GROUP BY ALL)"""
    parts = [own]
    for d in dims:
        target = mixing.TARGETS[d]
        if target is None:
            parts.append(f"a_{d}_0 AS MATERIALIZED (SELECT {d}, most, 1.0::DOUBLE / count(*) OVER () AS share FROM (SELECT {d}, sum(tokens) AS t, sum(cap) AS most FROM c0 GROUP BY {d}) WHERE t > 0)")
        else:
            rest = max(0.0, 1 - sum(target.values()))
            case = " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in target.items())
            parts.append(
                f"t_{d} AS (SELECT {d}, t, most, CASE {d} {case} END AS share FROM (SELECT {d}, sum(tokens) AS t, sum(cap) AS most FROM c0 GROUP BY {d}) WHERE t > 0),\n"
                f"g_{d} AS (SELECT {d}, most, coalesce(share, {rest!r}::DOUBLE * t / sum(CASE WHEN share IS NULL THEN t END) OVER ()) AS share FROM t_{d}),\n"
                f"a_{d}_0 AS MATERIALIZED (SELECT {d}, most, share / sum(share) OVER () AS share FROM g_{d})"
            )
        for k in range(SQL_CUTS):
            parts.append(
                f"a_{d}_{k + 1} AS MATERIALIZED (SELECT {d}, most, CASE WHEN share >= most THEN most"
                f" ELSE share * (1 - coalesce(sum(CASE WHEN share >= most THEN most END) OVER (), 0)) / sum(CASE WHEN share < most THEN share END) OVER () END AS share FROM a_{d}_{k})"
            )
    n = 0
    for _ in range(SQL_SWEEPS):
        for d in dims:
            parts.append(
                f"c{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, cap, w * CASE WHEN o > 0 AND s > f THEN (s - f) / o WHEN f + o > s THEN s / (f + o) ELSE 1 END AS w"
                f" FROM (SELECT c.*, coalesce(share, 0) AS s, sum(CASE WHEN w >= cap THEN cap ELSE 0 END) OVER (PARTITION BY c.{d}) AS f, sum(CASE WHEN w < cap THEN w ELSE 0 END) OVER (PARTITION BY c.{d}) AS o"
                f" FROM c{n} c LEFT JOIN a_{d}_{SQL_CUTS} a ON a.{d} = c.{d}))"
            )
            n += 1
    parts.append(
        f"odds AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN cap > 0 THEN least(w, cap) / cap ELSE 0 END AS probability FROM c{n}),\n"
        f"drawn AS (SELECT own.*, probability, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < probability AS sampled FROM own JOIN odds USING (source, lang, topic))"
    )
    return "WITH " + ",\n".join(parts) + "\n" + (final or "SELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability, sampled FROM drawn")


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": _OP4, "op5_mixing": mixing_sql(), "op8_quality_rules": _OP8, "op9_minhash_near_dedup": _OP9, "op10_benchmark_decontamination": _OP10}
