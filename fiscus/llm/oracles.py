"""DuckDB SQL of the training-data queries that SQL can express.

Each is written from the query's contract, by brute force over whole tables:
windows and shingles are compared as texts, components by reachability.
"""

from __future__ import annotations

from fiscus.llm.chat_format import Template
from fiscus.llm.licenses import RULES, SENTENCES

WORD = r"[^\x20\x09-\x0D]+"

#: Rows get a number first, so that repeated and null ids stay apart.
WORDS = f"""d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM d)"""

OP2 = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN MIN(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM r"""

OP3 = """
SELECT doc_id, MAX(doc_id) OVER g AS keep_id, COUNT(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM MAX(doc_id) OVER g AS kept,
       sha256(COALESCE(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY COALESCE(text, ''))"""

# Equal sets are linked through one of them, so only distinct sets are paired.
OP5 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents),
each AS (SELECT r, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
next AS (SELECT r, n, p, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM each WINDOW o AS (PARTITION BY r ORDER BY p)),
lists AS (SELECT r, list_sort(list(DISTINCT concat_ws(' ', x, y, z))) AS s FROM next WHERE p <= n - 2 OR n < 3 AND p = 1 GROUP BY r),
g AS (SELECT r, doc_id, COALESCE(s, []) AS s FROM d LEFT JOIN lists USING (r)),
sets AS (SELECT row_number() OVER () AS k, s, len(s) AS n, MIN(doc_id) AS least_id FROM g WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s),
grams AS (SELECT k, n, unnest(s) AS x FROM sets),
edges AS (SELECT a.k AS a, b.k AS b FROM grams a JOIN grams b ON a.x = b.x AND a.k <> b.k AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
          GROUP BY a.k, a.n, b.k, b.n HAVING 100 * COUNT(*) >= 90 * (a.n + b.n - COUNT(*))),
reach(a, b) AS (SELECT k, k FROM sets UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
part AS (SELECT reach.a AS k, MIN(sets.least_id) AS component_id FROM reach JOIN sets ON sets.k = reach.b GROUP BY reach.a)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles,
       CASE WHEN g.doc_id IS NOT NULL THEN COALESCE(part.component_id, g.doc_id) END AS component_id
FROM g LEFT JOIN sets ON g.s = sets.s LEFT JOIN part ON part.k = sets.k"""

OP6 = f"""
WITH {WORDS},
spans AS (SELECT r, unnest(range(1, len(w) - 33)) AS s, w FROM w WHERE len(w) >= 35),
texts AS (SELECT r, s, array_to_string(w[s:s + 34], ' ') AS x FROM spans),
again AS (SELECT r, s FROM (SELECT r, s, COUNT(*) OVER (PARTITION BY x) AS n FROM texts) WHERE n > 1),
gone AS (SELECT DISTINCT r, s + j AS p FROM again, range(0, 35) AS o(j)),
each AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT r, COUNT(*) AS n, string_agg(word, ' ' ORDER BY p) AS x FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(x, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, COALESCE(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{WORD}') AS w FROM d),
each AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS s FROM w),
next AS (SELECT r, s, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM each WINDOW o AS (PARTITION BY r ORDER BY s)),
grams AS (SELECT r, s, COUNT(*) OVER (PARTITION BY r, x, y, z) AS n FROM next WHERE z IS NOT NULL),
again AS (SELECT r, COUNT(DISTINCT s + j) AS n_repeat FROM grams, range(0, 3) AS o(j) WHERE n > 1 GROUP BY r),
lines AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
plain AS (SELECT r, host, t, line, len(regexp_extract_all(line, '{WORD}')) AS n,
                 trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS x FROM lines),
hosts AS (SELECT host, COUNT(DISTINCT t) AS docs FROM d GROUP BY host),
held AS (SELECT host, x, COUNT(DISTINCT t) AS docs FROM plain WHERE x <> '' GROUP BY host, x),
hot AS (SELECT held.host, held.x FROM held JOIN hosts ON held.host IS NOT DISTINCT FROM hosts.host
        WHERE held.docs >= 20 AND held.docs > 0.10 * hosts.docs),
rest AS (SELECT p.r, SUM(CASE WHEN hot.x IS NULL THEN p.n ELSE 0 END) AS n_left, COUNT(hot.x) AS n_gone,
                COUNT(*) FILTER (p.n > 0) - COUNT(DISTINCT p.line) FILTER (p.n > 0) AS n_dup
         FROM plain p LEFT JOIN hot ON p.host IS NOT DISTINCT FROM hot.host AND p.x = hot.x GROUP BY p.r),
base AS (SELECT d.doc_id, len(w.w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, n_dup AS n_dup_lines, COALESCE(n_repeat, 0) AS n_repeat_words,
                n_left AS n_words_left, n_gone AS n_lines_removed
         FROM d JOIN w USING (r) JOIN rest USING (r) LEFT JOIN again USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND 2 * n_words_left >= n_words AS kept, CAST(n_words_left AS BIGINT) AS n_words_left,
       CAST(n_lines_removed AS BIGINT) AS n_lines_removed
FROM judged"""


def op10() -> str:
    """A rule's sentences, in order: the k-th is the first one of its kind behind the place of the one before."""
    known = ",\n  ".join(f"('{s}', '{k}')" for k, group in SENTENCES.items() for s in group)
    steps = ",\n  ".join(f"({i}, '{name}', '{name}/{kind}', [{', '.join(repr(x) for x in order)}])"
                         for i, (name, kind, order) in enumerate(RULES))
    return rf"""
WITH RECURSIVE known(x, sentence_id) AS (VALUES
  {known}),
rules(rule, license, label, ids) AS (VALUES
  {steps}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(COALESCE(text, ''), '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS s
      FROM documents),
s AS (SELECT r, unnest(s) AS x, generate_subscripts(s, 1) AS place FROM d),
found AS (SELECT r, place, sentence_id FROM s JOIN known ON known.x = trim(regexp_replace(lower(s.x), '[^a-z0-9]+', ' ', 'g'), ' ')),
walk(r, rule, k, place) AS (
  SELECT r, rule, 1, MIN(place) FROM found JOIN rules ON sentence_id = ids[1] GROUP BY r, rule
  UNION ALL
  SELECT walk.r, walk.rule, walk.k + 1, MIN(found.place)
  FROM walk JOIN rules USING (rule) JOIN found ON found.r = walk.r AND found.sentence_id = ids[walk.k + 1] AND found.place > walk.place
  GROUP BY walk.r, walk.rule, walk.k),
hits AS (SELECT r, rule, license, label FROM walk JOIN rules USING (rule) WHERE k = len(ids)),
names AS (SELECT r, license, MIN(rule) AS rule FROM hits GROUP BY r, license),
a AS (SELECT r, COUNT(*) AS n, string_agg(sentence_id, ',' ORDER BY place) AS ids FROM found GROUP BY r),
b AS (SELECT r, string_agg(license, ',' ORDER BY rule) AS licenses FROM names GROUP BY r),
c AS (SELECT r, string_agg(label, ',' ORDER BY rule) AS rules FROM hits GROUP BY r)
SELECT doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_sentences, COALESCE(ids, '') AS sentence_ids, COALESCE(licenses, '') AS licenses,
       COALESCE(c.rules, '') AS rules
FROM d LEFT JOIN a USING (r) LEFT JOIN b USING (r) LEFT JOIN c USING (r)"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII expression, bit by bit."""
    bits = "list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b))"
    return f"xor(4294967295, list_reduce([ascii(z)::BIGINT FOR z IN string_split({text}, '')], lambda c, b: {bits}, 4294967295::BIGINT))"


# Every period up to a third of the text: places whose word comes again so many words later, in unbroken stretches.
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(COALESCE(text, ''), '{WORD}') AS w FROM documents),
h AS (SELECT *, len(w) AS n, CASE WHEN doc_id IS NOT NULL THEN {crc32("CAST(doc_id AS VARCHAR)")} END AS h FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, h // 10 AS g FROM h),
t AS (SELECT r, n, a, 1 + (n - a) // (3 + g % 8) AS p, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM a),
e AS (SELECT t.r, t.n, t.i, CASE WHEN t.a IS NULL OR t.i < t.a THEN t.x ELSE o.x END AS x
      FROM t JOIN t o ON t.r = o.r AND o.i = CASE WHEN t.a IS NULL OR t.i < t.a THEN t.i ELSE t.a + (t.i - t.a) % t.p END),
q AS (SELECT f.r, l.i - f.i AS q, f.i FROM e f JOIN e l ON f.r = l.r AND f.x = l.x AND l.i > f.i AND 3 * (l.i - f.i) <= f.n),
s AS (SELECT r, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k, i FROM q),
m AS (SELECT r, q, MIN(i) AS start, COUNT(*) + q AS length FROM s GROUP BY r, q, k HAVING COUNT(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT r, start, length, MIN(q) AS period FROM m GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS x FROM e ANTI JOIN gone USING (r, i) GROUP BY r),
best AS (SELECT r, COUNT(*) AS n, first(runs ORDER BY length / period DESC, start, period) AS b,
                string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS x FROM runs GROUP BY r)
SELECT doc_id, COALESCE(best.n, 0) AS n_runs, b.start AS start, CAST(b.length AS BIGINT) AS length, b.period AS period,
       CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli, sha256(COALESCE(best.x, '')) AS runs_sha256,
       sha256(COALESCE(kept.x, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""

_KEY = crc32("concat(COALESCE(CAST(conv_id AS VARCHAR), ' '), ':', COALESCE(CAST(turn AS VARCHAR), ' '))")

# One step per row of every conversation at once; between rows at most two insertions can be of use.
OP12 = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, {_KEY} % 20 AS k FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                   CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM (SELECT *, unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM k)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(role || chr(10) || text)) AS i, left(role, 1) AS c FROM damaged),
f AS (SELECT conv_id, turn, role, text, i, c,
             CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE 'none' END AS fault,
             lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS two
      FROM o),
moves(e, s, c, t, cost) AS (VALUES ('D', 0, NULL, 0, 3), ('D', 1, NULL, 1, 3), ('D', 2, NULL, 2, 3), ('D', 3, NULL, 3, 3),
  ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 2, 'a', 3, 0), ('K', 3, 'u', 2, 0),
  ('R', 0, NULL, 2, 2), ('R', 1, NULL, 2, 2), ('R', 2, NULL, 3, 2), ('R', 3, NULL, 2, 2)),
more(s, t, x, cost) AS (VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 2), (1, 2, 'I', 2), (2, 3, 'I', 2),
  (3, 2, 'I', 2), (0, 3, 'II', 4), (1, 3, 'II', 4), (2, 2, 'II', 4), (3, 3, 'II', 4)),
step AS (SELECT moves.e, moves.s, moves.c, more.t, moves.e || more.x AS x, moves.cost + more.cost AS cost FROM moves JOIN more ON more.s = moves.t),
ids AS (SELECT DISTINCT conv_id FROM conversations),
best(conv_id, i, s, b) AS (
  SELECT conv_id, 0, t, {{'cost': cost, 'audit': x}} FROM ids, more WHERE more.s = 0
  UNION ALL
  SELECT f.conv_id, f.i, step.t, MIN({{'cost': b.cost + step.cost + CASE WHEN fault = 'truncated' AND step.e <> 'D' THEN 1 ELSE 0 END, 'audit': b.audit || step.x}})
  FROM best JOIN f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.i = best.i + 1
       JOIN step ON step.s = best.s AND (step.c IS NULL OR step.c = f.c) AND (step.e = 'D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY f.conv_id, f.i, step.t),
sums AS (SELECT conv_id, COUNT(*) AS n, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps,
                COUNT(*) FILTER (fault = 'blank') AS blank, COUNT(*) FILTER (fault = 'duplicate') AS duplicate,
                COUNT(*) FILTER (fault = 'truncated') AS truncated, COUNT(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
         FROM f GROUP BY conv_id),
chosen AS (SELECT sums.conv_id, MIN(b) AS b FROM sums JOIN best ON best.conv_id IS NOT DISTINCT FROM sums.conv_id AND best.i = sums.n AND s IN (0, 3) GROUP BY sums.conv_id),
edits AS (SELECT conv_id, unnest(string_split(b.audit, '')) AS e, generate_subscripts(string_split(b.audit, ''), 1) AS p FROM chosen),
placed AS (SELECT *, COUNT(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM edits),
said AS (SELECT placed.conv_id, p, e, role, text, row_number() OVER (PARTITION BY placed.conv_id ORDER BY p) AS k,
                first(CASE WHEN e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY placed.conv_id ORDER BY p) AS s
         FROM placed LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM placed.conv_id AND f.i = placed.i AND e <> 'I' WHERE e <> 'D'),
repaired AS (SELECT conv_id, string_agg(concat(CASE WHEN e = 'K' THEN role WHEN (k - s) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', text), chr(10) ORDER BY p) AS x
             FROM said GROUP BY conv_id)
SELECT ids.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate,
       COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, CAST(COALESCE(b.cost, 0) AS BIGINT) AS cost,
       COALESCE(b.audit, '') AS audit, sha256(COALESCE(x, '')) AS repaired_sha256
FROM ids LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN chosen ON chosen.conv_id IS NOT DISTINCT FROM ids.conv_id
     LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM ids.conv_id"""


def _escaped(text: str, template: Template) -> str:
    """Length of a text with its backslashes doubled and its control strings broken by one."""
    count = lambda c: f"(len({text}) - len(replace({text}, {_quoted(c)}, ''))) // {len(c)}"
    return " + ".join([f"len({text})", *map(count, ["\\", *template.controls()])])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CHAT = Template()
_MARKS = " ".join(f"WHEN {_quoted(role)} THEN {len(a) + len(b)}" for role, (a, b) in _CHAT.marks.items())

OP13 = f"""
WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, sha256(role || chr(10) || text) AS d FROM t)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, d)) AS turns_sha256,
       CAST(COALESCE(SUM(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, d) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(SUM({_escaped("text", _CHAT)} + CASE role {_MARKS} ELSE {sum(map(len, _CHAT.other))} + {_escaped("role", _CHAT)} END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id"""


ORACLE = {"op2_warc": OP2, "op3_exact_dedup": OP3, "op5_ngram_jaccard": OP5, "op6_substring_dedup": OP6, "op7_quality_rules": OP7,
          "op10_license_scan": op10(), "op11_periodic_runs": OP11, "op12_structure_repair": OP12, "op13_chat_format": OP13}
