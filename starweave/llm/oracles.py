"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from starweave.llm.licence_texts import FULL_TEXTS
from starweave.llm.licences import FULL_THRESHOLD, NAMED, TEMPLATES

_SUBSTRINGS = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM docs
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS w FROM places WHERE i + 12 <= len(words)
), firsts AS (
  SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
  FROM windows JOIN firsts USING (w) WHERE first_doc < doc_id
), kept AS (
  SELECT p.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed,
    coalesce(string_agg(p.words[p.i], ' ' ORDER BY p.i) FILTER (g.i IS NULL), '') AS kept
  FROM places p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""

_FOLDED = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_FOLDED} AS words FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_FOLDED} AS words FROM benchmark),
sized AS (SELECT item_id, words, least(len(words), 10) AS n FROM items WHERE len(words) > 0),
item_places AS (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM sized),
wanted AS (SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS w FROM item_places),
widths AS (SELECT DISTINCT n FROM wanted),
places AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM docs),
windows AS (
  SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS w
  FROM places, widths WHERE i + n - 1 <= len(words)
),
hits AS (SELECT doc_id, i, windows.n, item_id FROM windows JOIN wanted USING (w) WHERE windows.n = wanted.n),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM hits),
counts AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN counts USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_PLAIN = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LICENCES = r"""
WITH templates(template, text) AS (VALUES %(templates)s),
template_words AS (
  SELECT template, word, count(*) AS tf FROM (
    SELECT template, unnest(regexp_split_to_array(%(template_text)s, '[^a-z0-9]+')) AS word FROM templates
  ) WHERE word <> '' GROUP BY ALL
), docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
    coalesce(source, 'unknown') || '/' || CAST(doc_id // 100 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) AS path
  FROM documents
), total AS (SELECT count(*) AS n FROM docs), counts AS (
  SELECT word, count(*) AS df FROM (
    SELECT DISTINCT doc_id, unnest(regexp_split_to_array(%(text)s, '[^a-z0-9]+')) AS word FROM docs
  ) WHERE word IN (SELECT word FROM template_words) GROUP BY word
), idf AS (
  SELECT DISTINCT word, coalesce(df, 0) AS df, ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1.0 AS idf
  FROM template_words LEFT JOIN counts USING (word), total
), vectors AS (SELECT template, word, tf * idf AS weight FROM template_words JOIN idf USING (word)),
units AS (SELECT template, word, weight / sqrt(sum(weight * weight) OVER (PARTITION BY template)) AS unit FROM vectors),
passages AS (
  SELECT path, list_filter(regexp_split_to_array(%(passage)s, '[^a-z0-9]+'), lambda w: w <> '') AS words
  FROM (SELECT path, unnest(regexp_split_to_array(text, '\n|[.!?]+ ')) AS passage FROM docs)
), looked AS (SELECT path, array_to_string(words, ' ') AS passage, words FROM passages
), terms AS (
  SELECT path, passage, word, count(*) AS tf FROM (SELECT path, passage, unnest(words) AS word FROM looked) GROUP BY ALL
), weighted AS (
  SELECT path, passage, word, tf * coalesce(idf, ln((1.0 + n) / 2.0) + 1.0) AS weight
  FROM terms LEFT JOIN idf USING (word), total
), normed AS (
  SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY path, passage)) AS norm FROM weighted
), scored AS (
  SELECT path, passage, template, round(sum(weight * unit) / min(norm), 6) AS score
  FROM normed JOIN units USING (word) GROUP BY ALL HAVING score >= 0.7
), own AS (
  SELECT path, template AS licence, score FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, template) AS r FROM scored
  ) WHERE r = 1
), full_texts(licence, words) AS (VALUES %(full)s),
sets AS (
  SELECT path, list_distinct(list_filter(regexp_split_to_array(%(text)s, '[^a-z0-9]+'), lambda w: w <> '')) AS own FROM docs
), whole AS (
  SELECT path, licence AS whole, score AS whole_score FROM (
    SELECT path, licence, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, licence) AS r FROM (
      SELECT path, licence, round(len(list_intersect(own, words)) / sqrt(len(own) * CAST(len(words) AS DOUBLE)), 6) AS score
      FROM sets, full_texts WHERE len(own) > 0
    ) WHERE score >= %(full_threshold)s
  ) WHERE r = 1
), listed AS (
  SELECT doc_id, docs.path, coalesce(whole, licence) AS licence, coalesce(whole_score, score) AS score,
    CASE WHEN whole IS NOT NULL OR regexp_matches(docs.path, '%(named)s') THEN 0
      WHEN len(list_filter(regexp_split_to_array(text, '\n|[.!?]+ '), lambda p: regexp_matches(p, '[A-Za-z0-9]'))) = 1 THEN 1 END AS gives
  FROM docs LEFT JOIN own USING (path) LEFT JOIN whole USING (path)
), given AS (
  SELECT directory, licence AS given FROM (
    SELECT *, row_number() OVER (PARTITION BY directory ORDER BY gives, score DESC, path) AS r
    FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS directory FROM listed WHERE licence IS NOT NULL AND gives IS NOT NULL)
  ) WHERE r = 1
), ups AS (
  SELECT path, regexp_replace(path, '/[^/]*$', '') AS near_, regexp_replace(path, '/.*$', '') AS far_ FROM listed
)
SELECT doc_id, l.path, coalesce(l.licence, a.given, b.given) AS licence, l.score,
  CASE WHEN l.licence IS NOT NULL THEN 'own' WHEN coalesce(a.given, b.given) IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN l.licence IS NOT NULL THEN NULL WHEN a.given IS NOT NULL THEN a.directory WHEN b.given IS NOT NULL THEN b.directory END AS directory
FROM listed l JOIN ups ON ups.path = l.path
LEFT JOIN given a ON a.directory = ups.near_ LEFT JOIN given b ON b.directory = ups.far_
""" % {
    "templates": ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES.items()),
    "full": ", ".join(f"('{name}', {sorted(set(listed.split()))})" for name, listed in FULL_TEXTS.items()),
    "full_threshold": FULL_THRESHOLD, "named": NAMED,
    "template_text": _PLAIN.format("text"), "text": _PLAIN.format("text"), "passage": _PLAIN.format("passage"),
}

_MIXING = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
    CAST([1, 2, 3][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1] AS DOUBLE) AS weight
  FROM sizes GROUP BY source
), shared AS (
  SELECT 0 AS step, source, source_size, weight, false AS full_, CAST(0 AS DOUBLE) AS target FROM sums
  UNION ALL
  SELECT step + 1, source, source_size, weight, full_ OR share >= 3 * source_size,
    CASE WHEN full_ OR share >= 3 * source_size THEN 3 * source_size ELSE share END
  FROM (
    SELECT *, weight * (sum(source_size) OVER () - sum(CASE WHEN full_ THEN 3 * source_size ELSE 0 END) OVER ())
      / nullif(sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (), 0) AS share
    FROM shared WHERE step < 40
  )
), targets AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, target, CAST(round(target) AS BIGINT) AS budget
  FROM shared WHERE step = 40
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.budget,
    coalesce(sum(s.size) OVER (
      PARTITION BY s.source ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), s.text, '')), s.size, s.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
    + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM placed
"""

#: crc32 of the decimal id, bit by bit, modulo 9.
_CRC_9 = """
    xor(list_reduce(
      flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END,
      CAST(4294967295 AS BIGINT)
    ), 4294967295) % 9"""

_TRIE = r"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv_id, struct_pack(
      key := left(sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text), 32), bytes := strlen(text)
    ) AS said,
    row_number() OVER (
      PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text), 32)
    ) AS i
  FROM told
), own AS (SELECT conv_id, list(said ORDER BY i) AS said FROM turns GROUP BY conv_id),
heads AS (SELECT conv_id, conv_id - conv_id % 5 AS base, said, {crc} AS h FROM own),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.said[1:a.h], []), a.said[a.h + 1:]) AS said
  FROM heads a LEFT JOIN own b ON b.conv_id = a.base
), prefixes AS (
  SELECT conv_id, len(said) AS size, d AS depth,
    array_to_string(list_transform(said[1:d], lambda x: x.key), '') AS path,
    CASE WHEN d > 0 THEN array_to_string(list_transform(said[1:d - 1], lambda x: x.key), '') END AS parent,
    CASE WHEN d > 0 THEN said[d].bytes ELSE 0 END AS bytes
  FROM (SELECT conv_id, said, unnest(range(0, len(said) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends
  FROM prefixes GROUP BY path, depth
), children AS (SELECT parent AS path, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sized AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (path)),
above AS (
  SELECT unnest(list_transform(range(0, depth + 1), lambda d: left(path, CAST(d * 32 AS INT)))) AS path,
    (n_children = 0)::INT AS leaf, (n_convs - 1) * bytes AS saved FROM sized
), totals AS (SELECT path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY path)
SELECT s.conv_id, CAST(s.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(s.n_convs AS BIGINT) AS n_convs,
  CAST(s.n_children AS BIGINT) AS n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
  CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(s.ends) AS ends_sha256
FROM sized s JOIN totals t USING (path) LEFT JOIN nodes p ON p.path = s.parent
""".replace("{crc}", _CRC_9)

_AUDIT = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), fails AS (
  SELECT doc_id, part,
    len(words) < 200 AS fa, 100 * len(list_distinct(words)) < 50 * len(words) AS fb,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS fc,
    regexp_matches(text, '[#$%&*|]') AS fd,
    coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS fe
  FROM docs
), marked AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, fa, fb, fc, fd, fe, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM fails LEFT JOIN marked USING (doc_id) GROUP BY ALL
), letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
held AS (
  SELECT part, filter_order, step, n, good, toxic,
    list_filter([CASE WHEN fa THEN 'A' END, CASE WHEN fb THEN 'B' END, CASE WHEN fc THEN 'C' END, CASE WHEN fd THEN 'D' END,
      CASE WHEN fe THEN 'E' END], lambda x: x IS NOT NULL) AS failed,
    substr(filter_order, CAST(step AS INT), 1) AS own
  FROM counts, steps
), placed AS (
  SELECT *, list_min(list_transform(failed, lambda x: instr(filter_order, x))) AS gone_at FROM held
), summed AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, any_value(own) AS own,
    coalesce(sum(n) FILTER (gone_at IS NULL OR gone_at > step), 0) AS kept,
    coalesce(sum(n) FILTER (gone_at = step), 0) AS removed,
    coalesce(sum(n) FILTER (gone_at < step AND list_contains(failed, own)), 0) AS redundant,
    coalesce(sum(n) FILTER (failed = [own]), 0) AS unique_fails,
    coalesce(sum(good) FILTER (gone_at = step), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (gone_at = step), 0) AS toxic_lost
  FROM placed GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""

ORACLES = {
    "op2_substring_dedup": _SUBSTRINGS,
    "op3_benchmark_decontamination": _DECONTAMINATION,
    "op4_license_scan": _LICENCES,
    "op5_source_mixing": _MIXING,
    "op11_conversation_trie": _TRIE,
    "op12_filter_audit": _AUDIT,
}
