"""The same results in the SQL of another engine, over the given tables."""

from gristmill.llm.licenses import TEMPLATES

SPACES = " \\t\\n\\x0b\\f\\r"
WORD = f"[^{SPACES}]+"

TOKEN_ROLLUP = f"""
WITH once AS (
    SELECT doc_id, source, lang,
           array_to_string(list_distinct(string_split(coalesce(text, ''), chr(10))), chr(10)) AS text
    FROM documents
    WHERE doc_id IS NULL OR doc_id NOT IN (
        SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 0)
), counted AS (
    SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(text, '{WORD}')) AS tokens FROM once
    UNION ALL
    SELECT source, lang, 'pieces-1',
           len(regexp_extract_all(text, '\\p{{L}}+|\\p{{N}}+|[^\\p{{L}}\\p{{N}}{SPACES}]'))
    FROM once
)
SELECT source, lang, version, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens
FROM counted GROUP BY source, lang, version
"""


def _normal(column: str) -> str:
    return (
        f"regexp_replace(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        f"'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    )


def _grams(column: str) -> str:
    words = f"list_filter(string_split({column}, ' '), lambda w: w <> '')"
    return (
        f"list_distinct(list_transform(range(1, len({words})), "
        f"lambda i: ({words})[i] || ' ' || ({words})[i + 1]))"
    )


_TEMPLATES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())

LICENSE_SCAN = f"""
WITH templates AS (
    SELECT name AS license, {_grams("clean")} AS tg
    FROM (SELECT name, {_normal("body")} AS clean FROM (VALUES {_TEMPLATES}) v(name, body))
), lines AS (
    SELECT doc_id, string_split({_normal("text")}, chr(10)) AS l FROM documents
), units AS (
    SELECT doc_id, unnest(l) AS unit, generate_subscripts(l, 1) AS line FROM lines
    UNION ALL
    SELECT doc_id, array_to_string(l, ' '), 0 FROM lines WHERE len(l) > 1
), grams AS (
    SELECT doc_id, line, {_grams("unit")} AS g FROM units
), scored AS (
    SELECT doc_id, line, license, 2.0::DOUBLE * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice
    FROM grams, templates WHERE len(g) > 0 AND len(g) <= 200
)
SELECT doc_id, CAST(line AS BIGINT) AS line, license, round(dice, 4) AS dice
FROM scored WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) = 1
"""


URL_RULES = """
WITH split AS (
    SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT page_id, url, rest,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM split
), rules(verdict, rule, rhost, rpath) AS (
    VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
           ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
           ('block', 'com/de/', 'com', '/de/')
), tokened AS (
    SELECT page_id, host, path,
        CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(
            ['s:' || lower(split_part(url, '://', 1))]
            || list_transform(string_split(host, '.'), lambda x: 'h:' || x)
            || CASE WHEN len(string_split(host, '.')) >= 2
                    THEN ['d:' || array_to_string(string_split(host, '.')[-2:], '.')] ELSE [] END
            || list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
                              lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN 'p:#' ELSE 'p:' || s END)
            || list_transform(list_filter(list_transform(
                   string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'),
                   lambda f: split_part(f, '=', 1)), lambda f: f <> ''), lambda f: 'q:' || f))) END AS tokens
    FROM parts
), judged AS (
    SELECT t.*, r.rule, r.verdict AS told
    FROM tokened t LEFT JOIN LATERAL (
        SELECT rule, verdict FROM rules
        WHERE (t.host = rhost OR ends_with(t.host, '.' || rhost)) AND starts_with(t.path, rpath)
        ORDER BY length(rule) DESC LIMIT 1) r ON true
), labelled AS (
    SELECT row_number() OVER () AS id, tokens, told FROM judged WHERE told IS NOT NULL AND len(tokens) > 0
), least AS (SELECT ceil(0.01 * count(*)) AS least_n FROM labelled
), one AS (SELECT id, told, unnest(tokens) AS a FROM labelled
), sets AS (
    SELECT told, [a] AS needs FROM one
    UNION ALL SELECT x.told, [x.a, y.a] FROM one x JOIN one y ON x.id = y.id AND x.a < y.a
    UNION ALL SELECT x.told, [x.a, y.a, z.a] FROM one x JOIN one y ON x.id = y.id AND x.a < y.a
              JOIN one z ON x.id = z.id AND y.a < z.a
), counted AS (SELECT needs, told, count(*) AS support FROM sets GROUP BY ALL
), totals AS (SELECT needs, sum(support) AS n FROM counted GROUP BY needs
), mined AS (
    SELECT needs, told, support, support / n::DOUBLE AS confidence
    FROM counted JOIN totals USING (needs), least
    WHERE support >= least_n AND support / totals.n::DOUBLE >= 0.8
), matched AS (
    SELECT j.tokens, m.told FROM (SELECT DISTINCT tokens FROM judged WHERE told IS NULL) j
    JOIN mined m ON list_has_all(j.tokens, m.needs)
    QUALIFY row_number() OVER (PARTITION BY j.tokens
        ORDER BY confidence DESC, support DESC, len(needs), array_to_string(needs, chr(1)), m.told) = 1
)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.told, m.told, 'allow') AS verdict
FROM judged j LEFT JOIN matched m ON j.tokens = m.tokens
"""


# Windows of thirteen words with at most two substitutions share a run of four.
DECONTAMINATE = """
WITH d AS (
    SELECT DISTINCT doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\p{L}\\p{N}]+') AS w FROM documents
), b AS (
    SELECT DISTINCT item_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\p{L}\\p{N}]+') AS w FROM benchmark
), dg AS (
    SELECT id, w, i, list_slice(w, i, i + 3) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 2)) AS i FROM d)
), bg AS (
    SELECT id, w, i, list_slice(w, i, i + 3) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 2)) AS i FROM b WHERE len(w) >= 13)
), pairs AS (
    SELECT DISTINCT dg.id AS doc_id, bg.id AS item_id, dg.i - bg.i AS off, dg.w AS dw, bg.w AS bw
    FROM dg JOIN bg ON dg.g = bg.g
), compared AS (
    SELECT doc_id, item_id, off, len(dw) AS n,
           list_transform(range(1, len(bw) + 1), lambda i:
               CASE WHEN off + i BETWEEN 1 AND len(dw) AND dw[off + i] = bw[i] THEN 1 ELSE 0 END) AS eq
    FROM pairs
), found AS (
    SELECT *, list_filter(range(0, len(eq) - 12), lambda i: list_sum(list_slice(eq, i + 1, i + 13)) >= 11) AS wins
    FROM compared
)
SELECT DISTINCT doc_id, item_id, greatest(off + wins[1], 0) AS start_word, least(off + wins[-1] + 13, n) AS end_word,
       CAST(list_sum(list_slice(eq, wins[1] + 1, wins[-1] + 13)) AS BIGINT) AS matched
FROM found WHERE len(wins) > 0
"""


NGRAM_JOIN = f"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1),
            lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g
    FROM split
), grams AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM sets
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, min(a.n) AS na, min(b.n) AS nb, count(*) AS c
    FROM grams a JOIN grams b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs WHERE 100 * c >= 90 * (na + nb - c)
), reach AS (
    SELECT doc_id AS d, doc_id AS r FROM sets
    UNION SELECT reach.d, links.b FROM reach JOIN links ON reach.r = links.a
)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT d, min(r) AS component_id FROM reach GROUP BY d) ON d = doc_id
"""


def _told(value: str) -> str:
    """A value as a Merkle leaf hashes it."""
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_told, ["doc_id", "source", "lang", "n_chars", text])) + ")"


# Unsigned crc32 of the decimal doc_id: a byte, then eight shifts, for each character.
_CRC = """xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""

MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {_leaf("text")}) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size,
    coalesce('=' || lang, '') AS tree, doc_id, {_leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS claim
  FROM documents),
nodes AS (
  SELECT 0 AS level, tree, pos, size, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, tree, pos // 8, (size + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes
  WHERE size > 1 GROUP BY level, tree, pos // 8, size),
tops AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1),
upper AS (
  SELECT 0 AS level, pos, size, subroot AS digest FROM tops
  UNION ALL
  SELECT level + 1, pos // 8, (size + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper
  WHERE size > 1 GROUP BY level, pos // 8, size),
all_nodes AS (
  SELECT tree, level, pos, size, digest FROM nodes
  UNION ALL
  SELECT NULL, 100 + level, pos, size, digest FROM upper),
sides AS (
  SELECT *, coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, pos // 8 ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING), '') AS after
  FROM all_nodes WHERE size > 1),
steps AS (
  SELECT l.tree, l.pos, s.level, s.before, s.after FROM leaves l JOIN sides s ON s.tree = l.tree AND s.pos = l.pos // CAST(8 ** s.level AS BIGINT)
  UNION ALL
  SELECT l.tree, l.pos, s.level, s.before, s.after FROM leaves l JOIN tops t ON t.tree = l.tree
  JOIN sides s ON s.tree IS NULL AND s.pos = t.pos // CAST(8 ** (s.level - 100) AS BIGINT)),
paths AS (
  SELECT tree, pos, list([before, after] ORDER BY level) AS path, string_agg(before || after, '' ORDER BY level) AS proof
  FROM steps GROUP BY tree, pos),
folds AS (
  SELECT l.tree, l.pos, 1 AS k, coalesce(claim, leaf) AS digest, path FROM leaves l LEFT JOIN paths p ON p.tree = l.tree AND p.pos = l.pos
  UNION ALL
  SELECT tree, pos, k + 1, sha256(path[k][1] || digest || path[k][2]), path FROM folds WHERE k <= len(path)),
folded AS (SELECT tree, pos, digest FROM folds WHERE k = coalesce(len(path), 0) + 1)
SELECT l.doc_id, l.leaf, t.subroot, r.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.digest AS folded_root,
  f.digest = r.digest AS verified
FROM leaves l JOIN tops t ON t.tree = l.tree JOIN (SELECT digest FROM upper WHERE size = 1) r ON true
JOIN folded f ON f.tree = l.tree AND f.pos = l.pos LEFT JOIN paths p ON p.tree = l.tree AND p.pos = l.pos
"""


def clusters_sql(k: int = 16, dims: int = 64, rounds: int = 3, scale: int = 64, seed: int = 1) -> str:
    """Rounds of assignment to the nearest of k centroids, as one query."""
    distance = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS j, v AS c FROM kept QUALIFY j < {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS (
  SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT r, j, {distance} AS d FROM kept, c{i}) GROUP BY r)"""
        )
        if i < rounds:
            # The floor of sum / count: // cuts towards zero.
            parts.append(
                f"""m{i} AS (
  SELECT j, list(CAST(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END AS HUGEINT) ORDER BY dim) AS c FROM (
    SELECT j, dim, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (
      SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM kept JOIN a{i} USING (r)) GROUP BY j, dim) GROUP BY j),
c{i + 1} AS (SELECT j, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (j))"""
            )
    return (
        "WITH "
        + ", ".join(parts)
        + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (j)"""
    )


CLUSTERS = clusters_sql()
