"""DuckDB statements of the training-data queries that SQL can express."""

from __future__ import annotations

OP5 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP9 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0),
e AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM i),
n AS (SELECT w.doc_id, count(x) AS n FROM w LEFT JOIN e ON e.doc_id = w.doc_id GROUP BY w.doc_id),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * common >= 85 * (na.n + nb.n - common)
), d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a),
g AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN g ON a = doc_id
"""

LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"'']?\s*((?:https?:)?//[^\"''\s>]+)"


def _host(url: str) -> str:
    rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    return f"coalesce(translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}'), '')"


def _path(url: str) -> str:
    rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    return f"coalesce(regexp_extract({rest}, '^[^/?#]*(/[^?#]*)', 1), '')"


def _spread(name: str, source: str, target: str, seed: str) -> str:
    steps = [
        f"{name}_s AS (SELECT {source} AS src, {target} AS dst, n / sum(n) OVER (PARTITION BY {source}) AS share FROM edges)",
        f"{name}_0 AS (SELECT host, 0.15::DOUBLE * {seed} AS mass FROM hosts WHERE {seed} > 0)",
    ]
    for k in range(1, 11):
        steps.append(
            f"{name}_{k} AS (SELECT host, sum(mass) AS mass FROM (SELECT * FROM {name}_0 UNION ALL "
            f"SELECT dst, 0.85::DOUBLE * share * mass FROM {name}_s JOIN {name}_{k - 1} ON src = host) GROUP BY host)"
        )
    return ",\n".join(steps)


OP10 = f"""
WITH base AS (SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, html FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM base
), judged AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS by_rule
  FROM ruled
), links AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '{LINK}', 1)) AS to_url FROM base WHERE host <> '' AND html IS NOT NULL
), ends AS (
  SELECT src, {_host("(CASE WHEN starts_with(to_url, '//') THEN 'http:' || to_url ELSE to_url END)")} AS dst FROM links
), edges AS (SELECT src, dst, count(*)::DOUBLE AS n FROM ends WHERE dst <> '' AND dst <> src GROUP BY ALL),
hosts AS (
  SELECT host, avg((coalesce(by_rule, '') = 'allow')::INT) AS good, avg((coalesce(by_rule, '') = 'block')::INT) AS bad
  FROM judged WHERE host <> '' GROUP BY host
),
{_spread('t', 'src', 'dst', 'good')},
{_spread('d', 'dst', 'src', 'bad')}
SELECT page_id, j.host, path, rule, coalesce(by_rule, CASE
  WHEN coalesce(d.mass, 0) > 0.5 * 0.15 AND coalesce(d.mass, 0) > coalesce(t.mass, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN t_10 t ON t.host = j.host LEFT JOIN d_10 d ON d.host = j.host
"""

def _mixing(rounds: int = 8, levels: int = 20) -> str:
    """Raking and the level search, step by step."""
    steps = [
        r"""WITH d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS t,
  ('0x' || substr(md5('mix:' || doc_id), 1, 8))::UBIGINT::DOUBLE / 4294967296::DOUBLE AS u FROM documents),
rows AS (SELECT doc_id, source, lang, u, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS tokens, CASE
  WHEN length(regexp_replace(t, '[^#$%&*|<>{}=_\[\]]', '', 'g')) * 25 > length(t) THEN 'markup'
  WHEN (length(t) - length(replace(t, chr(10), ''))) * 60 > length(t) THEN 'list'
  WHEN length(t) < 600 THEN 'note' ELSE 'article' END AS topic FROM d),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL HAVING sum(tokens) > 0)"""
    ]
    for name, power in (("source", 0.5), ("lang", 0.5), ("topic", 1.0)):
        steps.append(
            f"t_{name} AS MATERIALIZED (SELECT v, p / sum(p) OVER () AS target FROM (SELECT {name} AS v, "
            f"pow(sum(tokens), {power}::DOUBLE) AS p FROM cells GROUP BY 1))"
        )
    steps.append("r0 AS (SELECT source, lang, topic, tokens, tokens / sum(tokens) OVER () AS weight FROM cells)")
    k = 0
    for _ in range(rounds):
        for name in ("source", "lang", "topic"):
            steps.append(
                f"r{k + 1} AS (SELECT source, lang, topic, tokens, weight * (target / sum(weight) OVER (PARTITION BY {name})) AS weight "
                f"FROM r{k} JOIN t_{name} ON v = {name})"
            )
            k += 1
    steps.append(f"fitted AS MATERIALIZED (SELECT * FROM r{k})")
    steps.append("l0 AS MATERIALIZED (SELECT 0.5::DOUBLE * sum(tokens) AS wanted, 0.5::DOUBLE * sum(tokens) / sum(weight) AS level FROM fitted)")
    for j in range(levels):
        steps.append(
            f"s{j} AS (SELECT wanted, level, (wanted - coalesce(sum(tokens) FILTER (WHERE weight * level >= tokens), 0)) / "
            f"nullif(sum(weight) FILTER (WHERE weight * level < tokens), 0) AS rise FROM fitted, l{j} GROUP BY 1, 2),"
            f"l{j + 1} AS MATERIALIZED (SELECT wanted, CASE WHEN rise > level * (1 + 1e-9) THEN rise ELSE level END AS level FROM s{j})"
        )
    steps.append(
        f"p AS (SELECT source, lang, topic, weight, least(1, level * weight / tokens) AS probability FROM fitted, l{levels})"
    )
    return ",\n".join(steps) + """
SELECT doc_id, source, lang, topic, tokens, floor(coalesce(weight, 0) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE AS cell_weight,
  floor(pr * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE AS probability, u < pr AS kept
FROM (SELECT *, CASE WHEN tokens > 0 THEN coalesce(probability, 0) ELSE 0::DOUBLE END AS pr
  FROM rows LEFT JOIN p USING (source, lang, topic))
"""



def _merkle(depth: int = 7) -> str:
    """Trees of up to 16**depth leaves a source and as many sources, level by level."""

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    def levels(t: str) -> list[str]:
        steps = []
        for k in range(depth):
            steps.append(
                f"{t}run{k} AS MATERIALIZED (SELECT tree, pos // 16 AS run, c, max(digest) AS one, "
                f"string_agg(digest, '' ORDER BY pos) AS s FROM {t}{k} GROUP BY ALL)"
            )
            steps.append(
                f"{t}{k + 1} AS MATERIALIZED (SELECT tree, run AS pos, CASE WHEN c = 1 THEN one ELSE sha256(s) END AS digest, "
                f"(c + 15) // 16 AS c FROM {t}run{k})"
            )
        return steps

    def path(t: str, p: str, place: str) -> list[str]:
        """p0 holds rows with tree and place; their digest and proof are carried up."""
        steps = []
        for k in range(depth):
            left, right = f"substr(s, 1, 64 * ({place} % 16))", f"substr(s, 64 * ({place} % 16) + 65)"
            steps.append(
                f"{p}{k + 1} AS (SELECT p.* REPLACE ({place} // 16 AS {place}, "
                f"CASE WHEN c > 1 THEN sha256({left} || cur || {right}) ELSE cur END AS cur, "
                f"CASE WHEN c > 1 THEN proof || {left} || {right} ELSE proof END AS proof) "
                f"FROM {p}{k} p JOIN {t}run{k} r ON p.tree IS NOT DISTINCT FROM r.tree AND p.{place} // 16 = r.run)"
            )
        return steps

    first = "||".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    low = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    steps = [
        """WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
  lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)""",
        """marked AS (SELECT d.*, xor(list_reduce(list_concat([4294967295],
  list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS hit FROM documents d, k)""",
        f"hashed AS (SELECT doc_id, source AS tree, sha256({first}||{field('text')}) AS leaf, "
        f"CASE WHEN hit THEN sha256({first}||{field(low)}) END AS changed FROM marked)",
        "leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, "
        "count(*) OVER (PARTITION BY tree) AS c FROM hashed)",
        "a0 AS (SELECT tree, pos, leaf AS digest, c FROM leaves)",
        *levels("a"),
        f"subroots AS MATERIALIZED (SELECT tree AS source, digest AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, "
        f"count(*) OVER () AS c FROM a{depth})",
        "b0 AS (SELECT 0 AS tree, pos, subroot AS digest, c FROM subroots)",
        *levels("b"),
        "p0 AS (SELECT doc_id, tree, pos, leaf, coalesce(changed, leaf) AS cur, '' AS proof FROM leaves)",
        *path("a", "p", "pos"),
        f"q0 AS (SELECT doc_id, leaf, cur, proof, subroot, 0 AS tree, s.pos AS place FROM p{depth} p "
        "JOIN subroots s ON p.tree IS NOT DISTINCT FROM s.source)",
        *path("b", "q", "place"),
    ]
    return ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = digest AS verified
FROM q{depth}, b{depth}"""


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12 = rf"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term FROM documents
), tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
size AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term FROM benchmark
), w AS (
  SELECT item_id, items.term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM items JOIN df ON items.term = df.term, corpus
), s AS (
  SELECT item_id, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM w JOIN tf ON tf.term = w.term JOIN size ON size.doc_id = tf.doc_id, corpus GROUP BY ALL
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


SQL = {"op1_mixing": _mixing(), "op5_exact_dedup": OP5, "op9_near_dedup": OP9, "op10_url_filter": OP10, "op11_merkle": _merkle(), "op12_lexical_search": OP12}
