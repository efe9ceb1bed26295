"""SQL that gives the rows of the operators' queries, where SQL can."""

from __future__ import annotations

import re

from alertfold.llm.license_scan import BASE_PHRASES, NAMES, TEMPLATES
from alertfold.llm.mixing import MAX_EPOCHS, SEED, WEIGHTS
from alertfold.llm.periodic_runs import MIN_WORDS
from alertfold.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _pattern(template: str) -> str:
    """A template as a regular expression over words with a blank in front of each."""
    out = ""
    for part in template.split():
        out += {"<<optional>>": "(?:", "<<end>>": ")?", "<<any": ""}.get(part, part if part.endswith(">>") else f" {part}")
    return re.sub(r"(\d+)>>", r"(?: [^ ]+){0,\1}", out)


def _mandatory(template: str) -> int:
    plain = re.sub(r"<<any \d+>>", "", template)
    while "<<optional>>" in plain:
        plain = re.sub(r"<<optional>>[^<]*<<end>>", "", plain)
    return len(set(plain.split()))


def _starts(phrases: dict[str, str]) -> str:
    size = {phrase: phrase.count(" ") + 1 for phrase in phrases}
    return " UNION ALL ".join(
        f"SELECT doc_id, unnest(list_filter(range(len(w)), lambda i: array_to_string(w[i + 1:i + {n}], ' ') = '{p}')) AS spot"
        f" FROM worded"
        for p, n in size.items()
    )


def _license_scan() -> str:
    known = [(label, phrase, True) for phrase, label in BASE_PHRASES.items()]
    known += [(label, name, False) for name, label in NAMES.items()]
    known += [(label, template, False) for label, template in TEMPLATES.items()]
    rows = ", ".join(f"('{label}', '{_pattern(t)} ', {_mandatory(t)}, {base})" for label, t, base in known)
    named = ", ".join(f"'{label}'" for label in NAMES.values())
    return f"""
WITH known(label, pattern, mandatory, base) AS (VALUES {rows}),
worded AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lines AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS line FROM worded),
found AS (SELECT doc_id, label, mandatory, base FROM lines, known WHERE regexp_matches(line, pattern)),
labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE NOT base AND label IN ({named})) AS name_labels,
         max(mandatory) AS most
  FROM found GROUP BY doc_id),
places AS ({_starts(BASE_PHRASES)}),
spots AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word FROM places GROUP BY doc_id),
named AS ({_starts(NAMES)}),
names AS (SELECT doc_id, count(*) AS n_names, min(spot) AS first_name, max(spot) AS last_name FROM named GROUP BY doc_id)
SELECT worded.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(most / (most + 1)::DOUBLE, 0.0) AS score,
       coalesce(n_names, 0)::BIGINT AS n_names, first_name::BIGINT AS first_name, last_name::BIGINT AS last_name,
       coalesce(name_labels, '') AS name_labels
FROM worded LEFT JOIN labels USING (doc_id) LEFT JOIN spots USING (doc_id) LEFT JOIN names USING (doc_id)
"""


_SUBSTRING = f"""
WITH docs AS (SELECT doc_id, {_BLANK_WORDS} AS w FROM documents),
spots AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS place FROM spots)
  WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS line
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(line, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

_WEIGHT = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))

_MIX = f"""
WITH sized AS (
  SELECT doc_id, source, len({_BLANK_WORDS})::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, {MAX_EPOCHS} * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {_WEIGHT} END AS weight
  FROM sources),
levels AS (
  SELECT *, row_number() OVER steps AS step, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (steps ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
         sum(weight) OVER (steps ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM weighted WINDOW steps AS (ORDER BY cap / weight::DOUBLE, source NULLS LAST)),
water AS (
  SELECT arg_min((total - clamped)::DOUBLE / free, step) AS level
  FROM levels WHERE cap > weight * ((total - clamped)::DOUBLE / free)),
targets AS (
  SELECT source, source_size,
         CASE WHEN level IS NULL OR cap <= weight * level THEN cap::DOUBLE ELSE weight * level END AS target
  FROM levels, water),
plan AS (
  SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE floor(target / source_size)::BIGINT END AS whole FROM targets),
summed AS (SELECT source, key, sum(size) AS words FROM sized GROUP BY source, key),
placed AS (
  SELECT source, key, sum(words) OVER (PARTITION BY source ORDER BY key) - words / 2.0 AS middle FROM summed)
SELECT sized.doc_id, size, source_size, target,
       (size * (whole + CASE WHEN middle <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized
JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source
JOIN placed ON sized.source IS NOT DISTINCT FROM placed.source AND sized.key = placed.key
"""

_WARC = """
WITH hashed AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes
  FROM pages),
marked AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM hashed)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM marked
"""

_DECONTAMINATE = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, g.n, i FROM grams g JOIN windows USING (n, win)),
spots AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN spots USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_JACCARD = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {_BLANK_WORDS.replace("coalesce(text, '')", _LOWERED)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
reached AS (
  SELECT doc_id AS x, doc_id AS y FROM docs
  UNION SELECT reached.x, links.y FROM reached JOIN links ON links.x = reached.y)
SELECT docs.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM docs LEFT JOIN sizes USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x) USING (doc_id)
"""

_ROUND = """
assigned{r} AS (
  SELECT rid, parts.part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT rid, p.part, entry, p.v AS v,
           list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts p JOIN book{r} b ON p.part = b.part) parts
  GROUP BY rid, parts.part),"""

_MOVE = """
means{r} AS (
  SELECT part, entry, list(x ORDER BY k) AS v FROM (
    SELECT part, entry, k, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (
      SELECT a.part, entry, unnest(p.v) AS x, unnest(range(len(p.v))) AS k
      FROM assigned{r} a JOIN parts p ON a.rid = p.rid AND a.part = p.part)
    GROUP BY part, entry, k)
  GROUP BY part, entry),
book{n} AS (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v
  FROM book{r} b LEFT JOIN means{r} m ON b.part = m.part AND b.entry = m.entry),"""

_CODES = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (
  SELECT rid, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v
  FROM (SELECT rid, v, unnest(range({PARTS})) AS part FROM kept)),
book0 AS (SELECT part, rid - 1 AS entry, v FROM parts WHERE rid <= {ENTRIES}),
{"".join(_ROUND.format(r=r) + _MOVE.format(r=r, n=r + 1) for r in range(ROUNDS))}
{_ROUND.format(r=ROUNDS)}
digest AS (
  SELECT sha256(string_agg(line, ',' ORDER BY part, entry)) AS codebooks_sha256
  FROM (SELECT part, entry, array_to_string(v, ',') AS line FROM book{ROUNDS})),
coded AS (
  SELECT rid, string_agg(substr('0123456789abcdef', (entry // 16 + 1)::INTEGER, 1)
                         || substr('0123456789abcdef', (entry % 16 + 1)::INTEGER, 1), '' ORDER BY part) AS code,
         sum(d)::BIGINT AS error
  FROM assigned{ROUNDS} GROUP BY rid),
errors AS (
  SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (rid) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM coded JOIN kept USING (rid) JOIN errors ON errors.label IS NOT DISTINCT FROM kept.label, digest
"""

# crc32 bit by bit, over the decimal digits of doc_id
_BYTE = "(CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(id, (i // 8 + 1)::INTEGER, 1))::BIGINT) ELSE c END)"
_CRC32 = f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], range(8 * length(id))),
    lambda c, i: xor({_BYTE} >> 1, CASE WHEN {_BYTE} % 2 = 1 THEN 3988292384 ELSE 0 END)))"""

_RUNS = f"""
WITH hashed AS (
  SELECT doc_id, {_BLANK_WORDS} AS w, {_CRC32} AS h
  FROM (SELECT doc_id, text, doc_id::VARCHAR AS id FROM documents)),
drawn AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g,
         (h // 10) % greatest(len(w), 1) AS a
  FROM hashed),
cut AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM drawn),
worded AS (
  SELECT doc_id, n, unnest(range(n)) AS i,
         unnest(CASE WHEN planted
                     THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1])
                     ELSE w END) AS word
  FROM cut),
same AS (
  SELECT x.doc_id, y.i - x.i AS p, x.i AS i
  FROM worded x JOIN worded y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
  WHERE 2 * (y.i - x.i) <= x.n),
enough AS (SELECT doc_id, p FROM same GROUP BY doc_id, p HAVING count(*) >= greatest(p, {MIN_WORDS} - p)),
islands AS (
  SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS g
  FROM same SEMI JOIN enough USING (doc_id, p)),
periods AS (
  SELECT doc_id, p, min(i) AS s, count(*) + p AS l FROM islands GROUP BY doc_id, p, g
  HAVING count(*) >= greatest(p, {MIN_WORDS} - p)),
runs AS (SELECT doc_id, s, l, min(p) AS q FROM periods GROUP BY doc_id, s, l),
digest AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY doc_id),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, s, q) AS place FROM runs) WHERE place = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS line FROM worded ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT cut.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period,
       (1000 * l // q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(line, '')) AS collapsed_sha256
FROM cut LEFT JOIN digest USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_license_scan": _license_scan(),
    "op2_substring_dedup": _SUBSTRING,
    "op3_mix_sources": _MIX,
    "op4_warc": _WARC,
    "op5_decontaminate": _DECONTAMINATE,
    "op9_jaccard_join": _JACCARD,
    "op11_vector_codes": _CODES,
    "op13_periodic_runs": _RUNS,
}
