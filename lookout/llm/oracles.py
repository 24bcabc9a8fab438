"""DuckDB twins of the queries that SQL can express, over the registered tables.

The language model, the fingerprints, the forest and the k-d tree have none;
their tests hold them against brute force or held-out accuracy.
"""

from __future__ import annotations

from lookout.llm.decontaminate import SeedParams
from lookout.llm.license_texts import NAMES, NOTICES, SPELLINGS, TEXTS
from lookout.llm.licenses import COPYRIGHT_LINE
from lookout.llm.mixing import MixParams

BLANK = r"[\x20\x09-\x0D]+"


def _word_list(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{BLANK}'), lambda x: x <> '')"


OP1 = rf"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS th, coalesce(text, '') AS t, {_word_list('text')} AS ws FROM documents),
base AS (
  SELECT doc_id, source, th, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{BLANK}', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM d, unnest(range(1, len(ws) - 1)) AS u(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1),
lines AS (
  SELECT doc_id, source, th, trim(l) AS line, len(string_split(trim(l), ' ')) AS words
  FROM (SELECT doc_id, source, th, unnest(string_split(regexp_replace(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'),
        '\p{{N}}', '0', 'g'), chr(10))) AS l FROM d) WHERE trim(l) <> ''),
common AS (SELECT source, line FROM lines GROUP BY 1, 2 HAVING count(DISTINCT (doc_id, th)) > 20),
per AS (
  SELECT l.doc_id, sum(l.words) AS line_words, sum(l.words) FILTER (WHERE c.line IS NOT NULL) AS removed
  FROM lines l LEFT JOIN common c ON l.line = c.line AND l.source IS NOT DISTINCT FROM c.source GROUP BY 1),
m AS (
  SELECT b.doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words,
    coalesce(line_words, 0)::BIGINT AS line_words
  FROM base b LEFT JOIN cov USING (doc_id) LEFT JOIN per USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * (line_words - removed_words) >= line_words AS kept
FROM m
"""

OP2 = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM t),
p AS (
  SELECT *, string_agg(md5(coalesce('r' || role, 'n') || chr(31) || coalesce('t' || text, 'n')), '')
    OVER (PARTITION BY conv_id ORDER BY k) AS pre, max(k) OVER (PARTITION BY conv_id) AS n FROM k),
whole AS (SELECT pre, n, min(conv_id) AS conv_id, count(*) AS snapshots FROM p WHERE k = n GROUP BY 1, 2),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.pre = w.pre))
SELECT conv_id, kept.n AS n_turns, snapshots,
  string_agg('<|im_start|>' || CASE WHEN lower(trim(role)) IN ('system', 'user', 'assistant', 'tool') THEN lower(trim(role)) ELSE 'user' END
    || chr(10) || regexp_replace(trim(coalesce(text, '')), '<\|(im_start|im_end)\|>', '<\1>', 'g') || '<|im_end|>' || chr(10), '' ORDER BY k) AS text
FROM kept JOIN p USING (conv_id) GROUP BY conv_id, kept.n, snapshots
"""


def _mix_passes() -> str:
    p, out = MixParams(), []
    for i in range(p.max_repeat * p.passes):
        small = "" if i == 0 else " AND size <= open"
        fits = f"open > target * {p.near} AND size > 0 AND n < {p.max_repeat} AND key >= start{small}"
        start = "0" if (i + 1) % p.passes == 0 else "CASE WHEN c IS NULL THEN start ELSE coalesce(edge + 1, 0) END"
        out.append(f"""
e{i} AS MATERIALIZED (SELECT source, key, any_value(open) AS open, sum(size) AS here, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) AS upto
  FROM x{i} WHERE {fits} GROUP BY source, key),
f{i} AS MATERIALIZED (SELECT source, count(*) AS c, min(key) FILTER (WHERE upto > open) AS edge,
    any_value(open) - coalesce(max(upto) FILTER (WHERE upto <= open), 0) AS rest FROM e{i} GROUP BY source),
x{i + 1} AS MATERIALIZED (SELECT x.* REPLACE (n + CASE WHEN c IS NOT NULL AND {fits} AND (edge IS NULL OR key < edge) THEN 1 ELSE 0 END AS n,
    coalesce(rest, open) AS open, {start} AS start)
  FROM x{i} x LEFT JOIN f{i} f ON x.source IS NOT DISTINCT FROM f.source)""")
    return ",".join(out)


_LAST = f"x{MixParams.max_repeat * MixParams.passes}"
OP3 = f"""
WITH r AS (
  SELECT doc_id, source, len({_word_list('text')})::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM r GROUP BY source),
c AS (
  SELECT sum(3 * source_size) OVER w AS caps, sum(weight) OVER w AS weights, (SELECT sum(source_size) FROM s) AS total,
    (SELECT sum(weight) FROM s) AS w_all FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lvl AS (
  SELECT greatest((SELECT max((total - caps)::DOUBLE / (w_all - weights)) FROM c WHERE w_all > weights),
                  (SELECT max(total::DOUBLE / w_all) FROM c)) AS l),
t AS (SELECT *, least(3.0 * source_size, weight * l)::DOUBLE AS target FROM s, lvl),
plan AS (
  SELECT source, source_size, target, whole, target - whole * source_size AS budget
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t)),
x0 AS MATERIALIZED (
  SELECT doc_id, r.source, size, key, source_size, target, budget AS open, 0::BIGINT AS start, whole AS n
  FROM r JOIN plan ON r.source IS NOT DISTINCT FROM plan.source),
{_mix_passes()},
near AS (
  SELECT source, key, sum(size) AS here FROM {_LAST}
  WHERE open > target * {MixParams.near} AND n < {MixParams.max_repeat} AND size > open AND size < 2 * open
  GROUP BY source, key HAVING sum(size) < 2 * any_value(open) QUALIFY row_number() OVER (PARTITION BY source ORDER BY here, key) = 1)
SELECT doc_id, size, source_size, target, size * (n + CASE WHEN near.key IS NULL THEN 0 ELSE 1 END) AS taken
FROM {_LAST} x LEFT JOIN near ON x.source IS NOT DISTINCT FROM near.source AND x.key = near.key
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS first FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""


def _tokens(text: str) -> str:
    return rf"list_filter(string_split(trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"


def _window_seeds(rows: str, keep: str) -> str:
    p = SeedParams()
    each = []
    for m, mask in enumerate(p.masks):
        picked = " || ' ' || ".join(f"ws[i + {k}]" for k, c in enumerate(mask) if c == "1")
        each.append(f"SELECT {keep}, i, '{m} ' || {picked} AS seed FROM {rows}, unnest(range(1, len(ws) - {p.span} + 2)) AS u(i)")
    return " UNION ALL ".join(each)


OP7 = f"""
WITH d AS (SELECT doc_id, {_tokens('text')} AS ws FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_tokens('text')} AS ws FROM benchmark WHERE text IS NOT NULL),
ds AS ({_window_seeds('d', 'doc_id')}),
bs AS ({_window_seeds('b', 'item_id')}),
hits AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS off FROM ds JOIN bs USING (seed)),
cells AS (
  SELECT doc_id, item_id, off, j, CASE WHEN d.ws[j + off] = b.ws[j] THEN 1 ELSE -1 END AS v
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id), unnest(range(greatest(1, 1 - off), least(len(b.ws), len(d.ws) - off) + 1)) AS u(j)),
sums AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, item_id, off ORDER BY j) AS s FROM cells),
runs AS (SELECT doc_id, item_id, s - min(s - v) OVER (PARTITION BY doc_id, item_id, off ORDER BY j) AS run FROM sums)
SELECT doc_id, item_id, max(run)::INTEGER AS score FROM runs GROUP BY 1, 2 HAVING max(run) >= {SeedParams.min_score}
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    own = COPYRIGHT_LINE.replace("'", "''")
    form = rf"regexp_replace(regexp_replace(lower({text}), '{own}', '', 'g'), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for a, b in SPELLINGS:
        form = rf"regexp_replace({form}, '\b{a}\b', '{b}', 'g')"
    return form


def _known_rows() -> str:
    rows = [*TEXTS, *((i, n.format(name)) for i, name in NAMES for n in NOTICES)]
    rows += [(i, f"SPDX-License-Identifier: {i}") for i in dict.fromkeys(i for i, _ in [*TEXTS, *NAMES])]
    return ", ".join(f"({_text(i)}, {_text(t)})" for i, t in rows)


OP10 = rf"""
WITH known AS (
  SELECT form, min(id) AS license_id
  FROM (SELECT id, trim(regexp_replace({_canonical('t')}, '[ \n]+', ' ', 'g')) AS form FROM (VALUES {_known_rows()}) AS k(id, t)) GROUP BY 1),
d AS (SELECT doc_id, {_canonical('text')} AS form FROM documents),
w AS (SELECT doc_id, form, trim(regexp_replace(form, '[ \n]+', ' ', 'g')) AS flat FROM d),
l AS (SELECT DISTINCT doc_id, trim(x) AS line FROM (SELECT doc_id, unnest(string_split(form, chr(10))) AS x FROM d)),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ' ' ORDER BY license_id) AS notices FROM l JOIN known ON l.line = known.form GROUP BY 1)
SELECT w.doc_id, CASE WHEN flat <> '' THEN sha256(flat) END AS digest, license_id, coalesce(notices, '') AS notices
FROM w LEFT JOIN known ON w.flat = known.form LEFT JOIN n USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
gt AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
lt AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY 1),
p AS (SELECT gt.lang, gt.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gt.total + lt.v) AS p,
    1 + (1000000000::HUGEINT * (kept.n + 1)) // (lt.total + lt.v) AS q
  FROM gt JOIN lt USING (lang) JOIN kept ON kept.lang = gt.lang LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
tv AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pair LEFT JOIN pv USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', item, value::BIGINT FROM tv),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 200
"""

ORACLES: dict[str, str] = {
    "op1_line_frequency_rules": OP1, "op2_snapshot_collapse": OP2, "op3_mix_to_weights": OP3, "op6_seekable_warc": OP6,
    "op7_spaced_seed_overlaps": OP7, "op10_license_digests": OP10,
    "op11_source_divergence": OP11}
