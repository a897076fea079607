"""DuckDB statements with the expected rows of the queries that SQL can express."""

from __future__ import annotations

from fleetspark.llm import chat_trees, curriculum, url_filter

#: Smallest node reachable from each node of undirected links (a, b), as rows (node, component).
_REACH = """
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS node, a AS other FROM ends
  UNION
  SELECT r.node, e.b FROM reach r JOIN ends e ON e.a = r.other
),
groups AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""

OP4 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
    embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
  FROM embeddings
),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND x.good AND y.good AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.9
),{_REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, coalesce(component, vec_id) AS component_id,
  coalesce(component, vec_id) = vec_id AS kept
FROM v LEFT JOIN groups ON node = vec_id"""


def _position(share: str) -> str:
    """The inverse of the cumulative demand of curriculum.SCHEDULES, dealt by rank."""
    arms = []
    for k, knots in enumerate(curriculum.SCHEDULES):
        whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
        before, pieces = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            w, slope = w0 / whole, (w1 - w0) / (t1 - t0) / whole
            need = f"({share} - {before!r}::DOUBLE)"
            time = f"{t0!r}::DOUBLE + CASE WHEN {need} > 0 THEN 2 * {need} / ({w!r}::DOUBLE + sqrt(greatest({w!r}::DOUBLE * {w!r}::DOUBLE + 2 * {slope!r}::DOUBLE * {need}, 0.0::DOUBLE))) ELSE 0 END"
            pieces.insert(0, f"WHEN {share} >= {before!r}::DOUBLE THEN {time}")
            before += (t1 - t0) * (w0 + w1) / 2 / whole
        arms.append(f"WHEN {k} THEN CASE {' '.join(pieces)} END")
    return f"CASE rank % {len(curriculum.SCHEDULES)} {' '.join(arms)} END"


_WEIGHTS = f"[{', '.join(map(str, curriculum.WEIGHTS))}][1 + rank % {len(curriculum.WEIGHTS)}]"

OP7 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM d GROUP BY source
),
w AS (SELECT *, {_WEIGHTS}::BIGINT AS weight, {curriculum.MAX_PASSES} * source_size AS cap FROM s),
level AS (
  SELECT sum(source_size)::BIGINT AS "left", sum(weight)::BIGINT AS "over" FROM w
  UNION
  SELECT (SELECT sum(source_size) FROM w)::BIGINT - coalesce((SELECT sum(cap) FROM w WHERE "left"::DOUBLE * weight / "over"::DOUBLE > cap), 0)::BIGINT,
    coalesce((SELECT sum(weight) FROM w WHERE NOT "left"::DOUBLE * weight / "over"::DOUBLE > cap), 1)::BIGINT
  FROM level
),
last AS (SELECT max("left"::DOUBLE / "over") AS ratio FROM level),
final AS (SELECT "left", "over" FROM level, last WHERE "left"::DOUBLE / "over" = ratio ORDER BY "over" LIMIT 1),
t AS (SELECT w.*, least(f."left"::DOUBLE * weight / f."over"::DOUBLE, cap::DOUBLE) AS target FROM w, final f),
p AS (
  SELECT doc_id, size, source_size, target, rank,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
q AS (SELECT *, len(list_filter(range(0, {curriculum.MAX_PASSES}), lambda k: size > 0 AND 2 * (k * source_size + start) + size <= 2 * target)) AS passes FROM p)
SELECT doc_id, size, source_size, target, (size * passes)::BIGINT AS taken,
  CASE WHEN passes > 0 THEN {_position("least(start / target, 1.0::DOUBLE)")} END AS first_position
FROM q"""

_AT = """regexp_replace({0}, '^(.|\\n)*?://', '')"""
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)

#: Pages' links by canonical tags with absolute targets; a page without a rule takes its group's verdict.
OP8 = f"""
WITH RECURSIVE rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES}),
u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, html FROM pages
),
l AS (
  SELECT rest, '' AS html, page_id FROM u
  UNION ALL
  SELECT substr(target, strpos(target, '://') + 3), '', NULL
  FROM (SELECT regexp_extract(html, '<link[^>]*rel="canonical"[^>]*href="(https?://[^"]*)"', 1) AS target FROM u) WHERE target <> ''
),
n AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^([^#]*)', 1) AS address
  FROM l
),
fits AS (
  SELECT n.*, (
    SELECT {{'rule': rule_host || rule_path, 'verdict': rule_verdict}} FROM rules
    WHERE host <> '' AND (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    ORDER BY length(rule_host || rule_path) DESC LIMIT 1) AS fit
  FROM n
),
links AS (
  SELECT regexp_extract(rest, '^([^#]*)', 1) AS a, regexp_extract(substr(target, strpos(target, '://') + 3), '^([^#]*)', 1) AS b
  FROM (SELECT rest, regexp_extract(html, '<link[^>]*rel="canonical"[^>]*href="(https?://[^"]*)"', 1) AS target FROM u) WHERE target <> ''
),{_REACH},
said AS (SELECT component, max(fit.verdict = 'allow') AS allows FROM fits JOIN groups ON node = address WHERE fit IS NOT NULL GROUP BY component)
SELECT page_id, host, path, fit.rule AS rule,
  coalesce(fit.verdict, CASE WHEN allows THEN 'allow' WHEN NOT allows THEN 'block' END, 'allow') AS verdict
FROM fits LEFT JOIN groups ON node = address LEFT JOIN said USING (component) WHERE page_id IS NOT NULL"""

OP9 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS gram
  FROM w
),
n AS (SELECT doc_id, count(gram) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n_shingles + q.n_shingles - shared)
),{_REACH},
degree AS (SELECT a AS doc_id, count(*) AS n_links FROM ends GROUP BY a)
SELECT doc_id, n_shingles, coalesce(component, doc_id) AS component_id, coalesce(n_links, 0) AS n_links
FROM n LEFT JOIN groups ON node = doc_id LEFT JOIN degree USING (doc_id)"""


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for mark in chat_trees.CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


OP10 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat_trees.START) + len(chat_trees.END) + 1} + length(replace({_escaped("role")}, chr(10), '\\' || chr(10))) + length({_escaped("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


OP11 = f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]') AS pieces
  FROM documents
),
p AS (SELECT doc, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS piece_no FROM d),
q AS (SELECT doc, lang, piece_no, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
w AS (SELECT doc, lang, piece_no, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM q),
four AS (
  SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4
  FROM w WINDOW o AS (PARTITION BY doc, piece_no ORDER BY place)
),
grams AS (
  SELECT lang, 1 AS size, w1 AS phrase FROM four
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM four WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM four WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM four WHERE w4 IS NOT NULL
),
f AS (SELECT lang, phrase, size, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY ALL),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size > 1 AND f >= 30),
cuts AS (SELECT c.*, k FROM c, range(1, 4) AS s(k) WHERE k < size),
scored AS (
  SELECT x.lang, x.phrase, a, k, p.f AS l, q.f AS r, ((2000000::HUGEINT * a) // (p.f + q.f))::BIGINT AS score
  FROM cuts x JOIN f p ON p.lang = x.lang AND p.phrase = array_to_string(words[1:k], ' ')
    JOIN f q ON q.lang = x.lang AND q.phrase = array_to_string(words[k + 1:], ' ')
),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM c, range(2, 4) AS m(m), range(1, 4) AS i(i) WHERE m < size AND i + m - 1 <= size GROUP BY ALL
),
kept AS (SELECT w.* FROM worst w LEFT JOIN inner_phrases USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


def _share(count: str, total: str) -> str:
    return f"(1 + (1000000000::HUGEINT * ({count} + 2)) // ({total} + 2 * v))"


OP13 = f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text
  FROM documents
),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
size AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
grid AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, lang_n, v, {_share("coalesce(c.n, 0)", "total")} AS p, {_share("lang_n", "lang_total")} AS lang_p
  FROM n JOIN size USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM grid x JOIN grid y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
),
rows AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs p ON p.lang = x.lang AND p.source = x.source AND p.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - lang_p) * (p - lang_p) // (p + lang_p))::BIGINT FROM grid WHERE n > 0 AND p > lang_p
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10"""

ORACLES = {
    "op4_multi_index": OP4,
    "op7_curriculum_mix": OP7,
    "op8_redirect_url_filter": OP8,
    "op9_jaccard_join": OP9,
    "op10_chat_reply_trees": OP10,
    "op11_phrase_automata": OP11,
    "op13_divergence_audit": OP13,
}
