"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from entwine.llm import decontaminate, licenses, neardup, url_filter

MIXING = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), twins AS (
  SELECT *, row_number() OVER (PARTITION BY source, doc_id, size) AS twin FROM sized
), drawn AS (
  SELECT *, (('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), size::VARCHAR, twin::VARCHAR, 'mix-1')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM twins
), sources AS (
  SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM drawn GROUP BY source
), weighed AS (
  SELECT *, ((place - 1) % 3 + 1) AS weight, (sum(words) OVER ())::BIGINT AS total FROM sources
), levels AS (
  SELECT *,
    (total - 3 * (sum(words) OVER w - words))::BIGINT::DOUBLE / (sum(weight) OVER () - sum(weight) OVER w + weight)::DOUBLE AS level,
    row_number() OVER w AS turn
  FROM weighed WINDOW w AS (ORDER BY words::DOUBLE / weight, place ROWS UNBOUNDED PRECEDING)
), found AS (
  SELECT arg_min(level, turn) AS level FROM levels WHERE level * weight <= 3 * words
), goals AS (
  SELECT source, words, least(coalesce((SELECT level FROM found) * weight, 'inf'::DOUBLE), (3 * words)::DOUBLE) AS target FROM levels
), split AS (
  SELECT *, CASE WHEN words > 0 THEN target / words ELSE 0.0::DOUBLE END AS ratio FROM goals
), parts AS (
  SELECT *, floor(ratio) AS whole, target - floor(ratio) * words AS remaining FROM split
), hist AS (
  SELECT source, size, count(*) AS n FROM drawn WHERE size > 0 GROUP BY ALL
), each_size AS (
  SELECT h.source, size, remaining, coalesce(sum(n * size) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS big,
    (sum(n * size) OVER upto)::BIGINT AS rest, (sum(n::HUGEINT * size * size) OVER upto)::DOUBLE AS squares
  FROM hist h JOIN parts p ON h.source IS NOT DISTINCT FROM p.source WINDOW upto AS (PARTITION BY h.source ORDER BY size ROWS UNBOUNDED PRECEDING)
), scales AS (
  SELECT source, max(size) AS top, arg_max(c, size) AS c, arg_max(rest, size) AS rest
  FROM (SELECT *, (remaining - big) / squares AS c FROM each_size) WHERE remaining >= big AND c * size < 1 GROUP BY source
), ranked AS (
  SELECT d.*, p.words, p.target, p.whole, p.remaining, s.top, coalesce(size > s.top, false) AS sure, round(s.c * s.rest) AS n,
    CASE WHEN size > 0 AND size <= s.top AND s.c > 0 THEN (u / (1 - u)) / ((s.c * size) / (1 - s.c * size)) END AS q
  FROM drawn d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN scales s ON d.source IS NOT DISTINCT FROM s.source
), chosen AS (
  SELECT *, sure OR (q IS NOT NULL AND row_number() OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST, size, twin) <= n) AS chosen FROM ranked
), gaps AS (
  SELECT source, any_value(remaining) - sum(CASE WHEN chosen THEN size ELSE 0 END)::BIGINT AS gap FROM chosen GROUP BY source
), candidates AS (
  SELECT c.source, c.size, c.doc_id, c.twin, abs(gap) AS gap FROM chosen c JOIN gaps g ON c.source IS NOT DISTINCT FROM g.source
  WHERE size > 0 AND remaining > 0 AND ((gap > 0 AND NOT chosen) OR (gap < 0 AND chosen AND NOT sure))
  QUALIFY row_number() OVER (PARTITION BY c.source, c.size ORDER BY CASE WHEN g.gap > 0 THEN q ELSE -q END, doc_id, twin) = 1
), picks AS (
  SELECT source, any_value(gap) AS gap, NULL::BIGINT AS size, 0 AS step FROM candidates GROUP BY source
  UNION ALL
  SELECT p.source, any_value(p.gap) - max(c.size), max(c.size), any_value(p.step) + 1 FROM picks p JOIN candidates c ON p.source IS NOT DISTINCT FROM c.source
  WHERE c.size <= p.gap AND (p.size IS NULL OR c.size < p.size) GROUP BY p.source
), ends AS (
  SELECT source, arg_max(gap, step) AS gap FROM picks GROUP BY source
), over AS (
  SELECT c.source, min(c.size) AS size FROM candidates c JOIN ends e ON c.source IS NOT DISTINCT FROM e.source
  WHERE c.size > e.gap AND c.size < 2 * e.gap AND NOT EXISTS (SELECT 1 FROM picks p WHERE p.source IS NOT DISTINCT FROM c.source AND p.size = c.size) GROUP BY c.source
), flips AS (
  SELECT c.source, c.size, c.doc_id, c.twin FROM candidates c JOIN (SELECT source, size FROM picks WHERE size IS NOT NULL UNION ALL SELECT source, size FROM over) p
  ON c.source IS NOT DISTINCT FROM p.source AND c.size = p.size
), final AS (
  SELECT c.* REPLACE (c.chosen <> (f.twin IS NOT NULL) AS chosen) FROM chosen c
  LEFT JOIN flips f ON c.source IS NOT DISTINCT FROM f.source AND c.doc_id IS NOT DISTINCT FROM f.doc_id AND c.size = f.size AND c.twin = f.twin
)
SELECT doc_id, source, size, words AS source_size, target, (whole + chosen::INT)::BIGINT AS copies, (size * (whole + chosen::INT))::BIGINT AS taken
FROM final
"""

CHAT = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS place FROM turns
), hashed AS (
  SELECT *, md5(concat_ws(chr(1), place::VARCHAR, role, text)) AS digest FROM placed
), rolled AS (
  SELECT conv_id, place, role, text, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    sum(('0x' || substr(digest, 1, 15))::BIGINT) OVER w AS h1, sum(('0x' || substr(digest, 16, 15))::BIGINT) OVER w AS h2
  FROM hashed WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
), whole AS (
  SELECT n_turns, h1, h2, min(conv_id) AS conv_id, count(*) AS copies FROM rolled WHERE place = n_turns GROUP BY ALL
), kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM rolled r WHERE r.place = w.n_turns AND r.h1 = w.h1 AND r.h2 = w.h2 AND r.place < r.n_turns)
), snapshots AS (
  SELECT r.conv_id, sum(w.copies) AS snapshots FROM rolled r JOIN kept k ON r.conv_id IS NOT DISTINCT FROM k.conv_id
  JOIN whole w ON w.n_turns = r.place AND w.h1 = r.h1 AND w.h2 = r.h2 WHERE r.place < r.n_turns GROUP BY 1
), texts AS (
  SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered FROM rolled GROUP BY 1
)
SELECT k.conv_id, k.n_turns::BIGINT AS n_turns, k.copies::BIGINT AS copies, coalesce(s.snapshots, 0)::BIGINT AS snapshots, t.rendered
FROM kept k JOIN texts t ON k.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN snapshots s ON k.conv_id IS NOT DISTINCT FROM s.conv_id
"""


def _canonical(text: str) -> str:
    """licenses.canonical() as SQL over the expression text."""
    out = f"regexp_replace(lower({text}), '{licenses.COPYRIGHT}', chr(10), 'g')"
    out = f"trim(regexp_replace({out}, '{licenses.OTHER}', ' ', 'g'), ' ')"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def _values(digests: dict[str, str]) -> str:
    return ", ".join(f"('{d}', '{n}')" for d, n in digests.items())


LICENSES = rf"""
WITH texts(known, license) AS (VALUES {_values(licenses.known_whole())}),
notices(known, name) AS (VALUES {_values(licenses.known(licenses.NOTICES))}),
rows AS (
  SELECT doc_id, row_number() OVER () AS row, text, sha256({_canonical("coalesce(text, '')")}) AS digest FROM documents
), lines AS (
  SELECT row, unnest(string_split(text, chr(10))) AS line FROM rows
), found AS (
  SELECT row, name FROM lines JOIN notices ON sha256({_canonical("line")}) = known WHERE regexp_matches(lower(line), '{"|".join(licenses.HINTS)}')
), listed AS (
  SELECT row, string_agg(DISTINCT name, ';' ORDER BY name) AS notices, count(*) AS notice_lines FROM found GROUP BY row
)
SELECT doc_id, digest, license, notices, coalesce(notice_lines, 0)::BIGINT AS notice_lines
FROM rows LEFT JOIN texts ON digest = known LEFT JOIN listed USING (row)
"""


def _rules() -> str:
    rows = []
    for rule in url_filter.RULES:
        verdict, place = rule.split(" ", 1)
        domain, _, start = place.partition("/")
        rows.append(f"('{place}', '{domain}', '/{start}', '{verdict}')")
    return ", ".join(rows)


URLS = rf"""
WITH RECURSIVE rules(rule, domain, start, decided) AS (VALUES {_rules()}),
parsed AS (
  SELECT row_number() OVER () AS row, page_id, html,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), fitting AS (
  SELECT row, rule, decided FROM parsed JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule) DESC) = 1
), judged AS (
  SELECT p.*, f.rule, f.decided FROM parsed p LEFT JOIN fitting f USING (row)
), links AS (
  SELECT DISTINCT row, host AS src, unnest(regexp_extract_all(html, '{url_filter.LINK.replace("'", "''")}', 1)) AS link FROM judged
), targets AS (
  SELECT src, translate(regexp_extract(CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END, '://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS dst FROM links
), edges AS (
  SELECT src, dst, count(*) AS pages FROM targets WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL
), shares AS (
  SELECT src, dst, pages / sum(pages) OVER (PARTITION BY src) AS share_src, pages / sum(pages) OVER (PARTITION BY dst) AS share_dst FROM edges
), seeds AS (
  SELECT host, sum(allowed)::DOUBLE AS allowed, sum(blocked)::DOUBLE AS blocked FROM (
    SELECT host, (decided = 'allow')::INT AS allowed, (decided = 'block')::INT AS blocked FROM judged WHERE host <> ''
    UNION ALL SELECT src, 0, 0 FROM edges UNION ALL SELECT dst, 0, 0 FROM edges) GROUP BY host
), seeded AS (
  SELECT host, {1 - url_filter.DAMPING}::DOUBLE * coalesce(allowed, 0) AS a, {1 - url_filter.DAMPING}::DOUBLE * coalesce(blocked, 0) AS b FROM seeds
), ranks AS (
  SELECT 0 AS i, host, a AS trust, b AS distrust, a, b FROM seeded
  UNION ALL
  SELECT any_value(i) + 1, host, any_value(a) + {url_filter.DAMPING}::DOUBLE * coalesce(sum(t), 0), any_value(b) + {url_filter.DAMPING}::DOUBLE * coalesce(sum(d), 0), any_value(a), any_value(b)
  FROM (
    SELECT r.i, r.host, r.a, r.b, 0::DOUBLE AS t, 0::DOUBLE AS d FROM ranks r WHERE r.i < {url_filter.ROUNDS}
    UNION ALL SELECT r.i, e.dst, NULL, NULL, r.trust * e.share_src, 0 FROM ranks r JOIN shares e ON r.host = e.src WHERE r.i < {url_filter.ROUNDS}
    UNION ALL SELECT r.i, e.src, NULL, NULL, 0, r.distrust * e.share_dst FROM ranks r JOIN shares e ON r.host = e.dst WHERE r.i < {url_filter.ROUNDS}
  ) GROUP BY host
), final AS (
  SELECT host, trust, distrust FROM ranks WHERE i = {url_filter.ROUNDS}
)
SELECT page_id, j.host, path, rule,
  coalesce(decided, CASE WHEN coalesce(distrust, 0) > {url_filter.RATIO}::DOUBLE * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust
FROM judged j LEFT JOIN final f ON j.host = f.host
"""

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}]+')"

#: All pairs of texts that share a run of words, their similarity, and the connected groups.
NEARDUP = rf"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row, doc_id, {_TOKENS} AS w FROM documents
), runs AS (
  SELECT row, unnest(CASE WHEN len(w) >= {neardup.SHINGLE} THEN [array_to_string(list_slice(w, i, i + {neardup.SHINGLE - 1}), ' ') FOR i IN range(1, len(w) - {neardup.SHINGLE - 2})]
    ELSE ['few: ' || array_to_string(w, ' ')] END) AS run FROM words
), weighed AS (
  SELECT row, run, count(*) AS n FROM runs GROUP BY ALL
), contents AS (
  SELECT row, md5(string_agg(run || ':' || n, '|' ORDER BY run)) AS content, sum(n) AS size FROM weighed GROUP BY row
), firsts AS (
  SELECT content, min(row) AS row, any_value(size) AS size FROM contents GROUP BY content
), mine AS (
  SELECT row, size, run, n FROM firsts JOIN weighed USING (row)
), shared AS (
  SELECT a.row AS a, b.row AS b, any_value(a.size) AS sa, any_value(b.size) AS sb, sum(least(a.n, b.n)) AS m FROM mine a JOIN mine b ON a.run = b.run AND a.row < b.row GROUP BY ALL
), links AS (
  SELECT a, b FROM shared WHERE m / (sa + sb - m) >= {neardup.SIMILARITY}
), reach(a, b) AS (
  SELECT row, row FROM firsts UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a
), roots AS (
  SELECT content, min(b) AS root FROM firsts JOIN reach ON row = a GROUP BY content
), members AS (
  SELECT row, doc_id, root FROM words JOIN contents USING (row) JOIN roots USING (content)
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS class_id, count(*) OVER (PARTITION BY root) AS class_size FROM members
"""


def _masks(masks: tuple[tuple[int, ...], ...]) -> str:
    """Whether the equal places e have all of some mask, somewhere."""
    return "len(list_filter(e, lambda p: " + " OR ".join("(" + " AND ".join(f"list_contains(e, p + {o})" for o in m[1:]) + ")" for m in masks) + ")) > 0"


#: Every alignment of an item with a document on which a seed hits: its equal places, those with support, and stretches.
LEAKS = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, {_TOKENS} AS w FROM documents
), items AS (
  SELECT w, min(item_id) AS item_id, row_number() OVER (ORDER BY min(item_id) NULLS LAST) AS item, len(w) AS size FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark) WHERE len(w) > 0 GROUP BY w
), doc_words AS (
  SELECT row, unnest(w) AS token, unnest(range(0, len(w))) AS place FROM docs
), item_words AS (
  SELECT item, size, unnest(w) AS token, unnest(range(0, len(w))) AS p FROM items
), aligned AS (
  SELECT row, item, any_value(size) AS size, place - p AS shift, list(p ORDER BY p) AS e FROM doc_words JOIN item_words USING (token)
  GROUP BY row, item, place - p HAVING count(*) >= least(any_value(size), 3)
), hit AS (
  SELECT * FROM aligned WHERE CASE WHEN size >= {decontaminate.LONG} THEN {_masks(decontaminate.MASKS)} WHEN size >= {decontaminate.MIN_TOKENS} THEN {_masks(decontaminate.FEW)} ELSE len(e) = size END
), judged AS (
  SELECT *,
    list_filter(e, lambda p: len(list_filter(range(p, p + 5), lambda j: len(list_filter(e, lambda x: x >= j - 4 AND x <= j)) >= {decontaminate.SUPPORT})) > 0) AS good,
    list_filter(range(0, size - 4), lambda f: len(list_filter(e, lambda x: x >= f AND x <= f + 4)) >= {decontaminate.SUPPORT}) AS windows
  FROM hit
), counted AS (
  SELECT row, item, count(DISTINCT p) AS n FROM (SELECT row, item, unnest(good) AS p FROM judged) GROUP BY ALL
), islands AS (
  SELECT row, item, shift, any_value(e) AS e, min(f) AS first, max(f) + 4 AS last FROM (
    SELECT row, item, shift, e, f, f - row_number() OVER (PARTITION BY row, item, shift ORDER BY f) AS island FROM (SELECT row, item, shift, e, unnest(windows) AS f FROM judged)) GROUP BY row, item, shift, island
), stretches AS (
  SELECT row, item, max(last - first + 1 - (NOT list_contains(e, first))::INT - (NOT list_contains(e, last))::INT) AS longest FROM islands GROUP BY ALL
), best AS (
  SELECT row, item, any_value(size) AS size, max(len(e)) AS equal, arg_min(greatest(shift, 0), (-len(e), greatest(shift, 0))) AS start FROM judged GROUP BY ALL
), shares AS (
  SELECT b.*, CASE WHEN size < {decontaminate.MIN_TOKENS} THEN 1.0::DOUBLE ELSE greatest(equal, coalesce(n, 0))::DOUBLE / size END AS similarity, coalesce(longest, 0) AS longest
  FROM best b LEFT JOIN counted USING (row, item) LEFT JOIN stretches USING (row, item)
)
SELECT doc_id, item_id, similarity, start::BIGINT AS start FROM shares JOIN docs USING (row) JOIN (SELECT item, item_id FROM items) USING (item)
WHERE similarity >= {decontaminate.SIMILARITY} OR longest >= {decontaminate.RUN}
"""
