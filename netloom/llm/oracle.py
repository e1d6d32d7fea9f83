"""DuckDB SQL for the queries that SQL can express."""


EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_size, CAST(sum(w) OVER () AS BIGINT) AS all_w,
         row_number() OVER o AS k,
         CAST(coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS size_before,
         CAST(coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS w_before
  FROM s WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / CAST(w AS DOUBLE), source NULLS LAST)),
r AS (SELECT *, all_size - 3 * size_before AS rest, all_w - w_before AS rest_w FROM l),
f AS (SELECT k AS fk, rest AS frest, rest_w AS fw FROM r WHERE w * rest <= 3 * source_size * rest_w ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN fk IS NULL OR k < fk THEN CAST(3 * source_size AS DOUBLE)
                              ELSE CAST(w * frest AS DOUBLE) / CAST(fw AS DOUBLE) END AS target
  FROM r LEFT JOIN f ON true),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
         + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END AS taken
FROM p
"""

QUALITY = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS times
  FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
c AS (
  SELECT doc_id, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM g WHERE times > 1) GROUP BY doc_id),
own AS (SELECT doc_id, unnest(list_distinct(lines)) AS line FROM d),
lw AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]*(?:[#*$%&|<>]|!!)[^\x20\x09-\x0D]*')) AS noise,
         len(regexp_extract_all(line, '[#*$%&|<>]|!!')) AS symbols,
         len(regexp_extract_all(line, '[|\x{bb}\x{203a}\x{2022}]')) AS bars,
         CASE WHEN 2 * (strlen(line) - length(line)) > length(line)
              THEN len(regexp_extract_all(line, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]')) ELSE 0 END AS unspaced
  FROM own),
good AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS clean_words FROM lw
  WHERE (2 * n + unspaced > 24 OR regexp_matches(line, '[.!?:;\x{2026}{other_marks}"''\x{201d}\x{2019}\x{201c}\x{2018}\x{bb}\x{ab}\x{203a}\x{2039})}{other_closing}\]][\x20\x09-\x0D]*$'))
    AND (CASE WHEN unspaced > 0 THEN symbols ELSE noise END) * 10 < 2 * n + unspaced AND NOT 10 * bars > 2 * n + unspaced
    AND NOT (2 * n + unspaced <= 60 AND regexp_matches(line, '(?i)(?:{phrases})'))
  GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(c.n_repeat_words, 0) AS n_repeat_words, coalesce(good.clean_words, 0) AS clean_words
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN good USING (doc_id)),
b AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_words,
       NOT base_failed AND clean_words * 100 >= n_words * 50 AS kept
FROM b
"""
#: Fixed values of the rule, written out here apart from the operator's own.
QUALITY = (
    QUALITY.replace("{phrases}", "|".join(
        [r"all rights reserved", r"cookies? (policy|settings)", r"we use cookies", r"enable javascript", r"privacy policy", r"terms of (use|service)"]
        + [r"sign (in|up)\b", r"log ?in\b", r"subscribe (now|to)", r"click here", r"share (this|on)", r"skip to (main )?content", r"back to top"]
        + [r"alle rechte vorbehalten", r"cookie-(einstellungen|richtlinie)", r"wir verwenden cookies", r"datenschutzerklärung", r"nutzungsbedingungen"]
        + [r"jetzt (anmelden|abonnieren|registrieren)", r"hier klicken", r"zum inhalt springen", r"nach oben scrollen", r"javascript aktivieren"]
        + [r"tous droits réservés", r"politique de confidentialité", r"conditions d.utilisation", r"nous utilisons des cookies", r"gérer les cookies"]
        + [r"se connecter\b", r"abonnez-vous", r"cliquez ici", r"aller au contenu", r"retour en haut", r"activer javascript"]
        + [r"todos los derechos reservados", r"política de (privacidad|cookies)", r"términos (de uso|y condiciones)", r"utilizamos cookies"]
        + [r"iniciar sesión", r"suscríbete", r"haga clic aquí", r"saltar al contenido", r"volver arriba", r"activar javascript"]
    ))
    .replace("{other_marks}", "\u3002\uff01\uff1f\uff1b\uff1a\uff0e\uff61\u061f\u061b\u06d4\u0964\u0965\u0589\u1362\u1367\u1368\u17d4\u17d5\u104b\u0f0d\u0f0e\u1803\u203d\u2047\u2048\u2049")
    .replace("{other_closing}", "\u300d\u300f\uff09\u3011\u300b\u3009\u3015\uff3d\uff5d")
)

SHARDING = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS n))),
d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, size, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
           list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
           lambda c, b: xor(c // 256, crc_table.t[xor(c % 256, b) + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM d, crc_table),
p AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start,
         CAST(sum(size) OVER () AS BIGINT) AS total
  FROM c),
s AS (SELECT *, CAST(((start * 2 + size) * 8) // (2 * total) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT payload, max(page_id) AS top, count(*) AS n FROM p WHERE strlen(payload) >= 1000 GROUP BY payload)
SELECT p.page_id, CAST(strlen(p.payload) AS BIGINT) AS payload_bytes, sha1(p.payload) AS payload_digest,
       CASE WHEN g.n > 1 AND p.page_id IS DISTINCT FROM g.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.n > 1 AND p.page_id IS DISTINCT FROM g.top THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.payload = g.payload
"""


def _licenses() -> str:
    """TF-IDF cosine without anchors: every unit of every text is scored against every template."""
    from netloom.llm.license_texts import RESERVATION, TEMPLATES
    from netloom.llm.licenses import terms

    rows = ", ".join(f"({k}, '{t.license}', '{term}', {n}, {int(term in t.must.split())})" for k, t in enumerate(TEMPLATES) for term, n in sorted(terms(t.text).items()))
    musts = ", ".join(f"({k}, {len(set(t.must.split()))})" for k, t in enumerate(TEMPLATES))
    term = r"'[a-z0-9]+(?:\.[0-9]+)*'"
    return rf"""
WITH tt(t, name, term, n, must) AS (VALUES {rows}),
musts(t, musts) AS (VALUES {musts}),
d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         source || '/' || regexp_replace(CAST(doc_id // 10 AS VARCHAR), '(.)', '\1/', 'g') || CAST(doc_id AS VARCHAR) AS path
  FROM documents),
dt AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), {term}))) AS term FROM d),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
idf AS (
  SELECT v.term, ln((1 + (SELECT n FROM n)) / (1 + count(dt.doc_id))) + 1 AS idf
  FROM (SELECT DISTINCT term FROM tt) v LEFT JOIN dt ON v.term = dt.term GROUP BY v.term),
tl AS (SELECT t, any_value(name) AS name, sqrt(sum((n * idf) ** 2)) AS tl FROM tt JOIN idf USING (term) GROUP BY t),
l AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line, len(ls) AS n_lines
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)),
m AS (
  SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word, regexp_matches(line, '[A-Za-z0-9]') AS alnum,
         regexp_matches(line, '^[ \t]*(?://|/\*|\*|#|--|;|<!--|%|!)') AS sign
  FROM l),
lines AS (
  SELECT doc_id, line AS text, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, count(*) OVER (PARTITION BY doc_id) AS many
  FROM m WHERE has_word),
gaps AS (
  SELECT *, sum(CASE WHEN alnum THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS para,
         sum(CASE WHEN sign THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS run
  FROM m),
paras AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text, count(*) AS lines,
         para = min(para) OVER (PARTITION BY doc_id) OR para = max(para) OVER (PARTITION BY doc_id) AS edge
  FROM gaps WHERE alnum GROUP BY doc_id, para),
runs AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text, count(*) FILTER (alnum) AS lines, min(k) <= 2 OR max(k) = any_value(n_lines) AS edge
  FROM gaps WHERE sign GROUP BY doc_id, run),
units AS (
  SELECT doc_id, text, i = 1 OR i = many AS edge FROM lines
  UNION ALL SELECT doc_id, text, edge FROM paras WHERE lines > 1
  UNION ALL SELECT doc_id, text, edge FROM runs WHERE lines > 1
  UNION ALL SELECT doc_id, text, true FROM d JOIN (SELECT DISTINCT doc_id FROM lines WHERE many > 1) USING (doc_id)),
u AS (SELECT *, row_number() OVER () AS unit FROM units),
ut AS (
  SELECT doc_id, unit, edge, term, count(*) AS tf
  FROM (SELECT doc_id, unit, edge, unnest(regexp_extract_all(lower(text), {term})) AS term FROM u) GROUP BY ALL),
ul AS (
  SELECT unit, sqrt(sum((tf * coalesce(idf, ln(1 + (SELECT n FROM n)) + 1)) ** 2)) AS ul
  FROM ut LEFT JOIN idf USING (term) GROUP BY unit),
dot AS (
  SELECT doc_id, unit, edge, t, sum(tf * n * idf * idf) AS dot, sum(must) AS found
  FROM ut JOIN tt USING (term) JOIN idf USING (term) GROUP BY doc_id, unit, edge, t),
c AS (
  SELECT doc_id, edge, name, tl, round(dot / tl / ul, 6) AS score
  FROM dot JOIN musts USING (t) JOIN tl USING (t) JOIN ul USING (unit) WHERE found = musts),
own AS (
  SELECT doc_id, name AS own_license, score AS own_score, edge FROM c WHERE score >= 0.7
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY name = '{RESERVATION}', round(score * score * tl, 4) DESC, name, score DESC, edge DESC) = 1),
f AS (
  SELECT d.doc_id, d.path, regexp_extract(d.path, '^(.*)/[^/]*$', 1) AS folder, own_license, own_score, coalesce(edge, false) AS is_licence
  FROM d LEFT JOIN own USING (doc_id)),
g AS (SELECT folder, arg_min(own_license, path) AS given FROM f WHERE is_licence GROUP BY folder),
a AS (
  SELECT f.doc_id, g.folder AS ancestor, g.given FROM f JOIN g ON f.folder = g.folder OR starts_with(f.folder, g.folder || '/')
  QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(g.folder) DESC) = 1)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, given) AS license,
       CASE WHEN own_license IS NULL THEN ancestor END AS inherited_from
FROM f LEFT JOIN a USING (doc_id)
"""


LICENSES = _licenses()

#: The scores of vectors by lists; anchors and their positives first, then the window of each positive.
HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
    CAST(coalesce(list_sum(list_transform(range(1, len(a.c) + 1), lambda i: a.c[i] * b.c[i])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), pos AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY rank <= 5
"""

#: Phrases as lists of words, counted at every place of every piece.
COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), places AS (
  SELECT lang, size, ws[i : i + size - 1] AS p
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, range(1, 6) sizes(size) WHERE len(ws) >= size)
), f AS (
  SELECT lang, size, p, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100
), n AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), parts AS (
  SELECT lang, size AS longer, f, size, unnest(range(1, size)) AS len, p FROM f WHERE size > 2
), covered AS (
  SELECT DISTINCT lang, p[i : i + len - 1] AS p, f
  FROM (SELECT *, unnest(range(1, size - len + 2)) AS i FROM parts)
), cuts AS (
  SELECT c.lang, c.p, c.f AS a, n.n, k, x.f AS l, y.f AS r,
    CAST((1000 * CAST(c.f AS HUGEINT) * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) c
  JOIN n ON n.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : k]
  JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1 : c.size]
  WHERE NOT EXISTS (SELECT 1 FROM covered z WHERE z.lang = c.lang AND z.p = c.p AND z.f >= c.f)
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.p ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
  array_to_string(p, ' ') AS phrase, a, l, r, n, score
FROM cuts
QUALIFY rank <= 2000
"""
