"""SQL that must agree with the queries, where SQL can express them."""


def _digest(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace(lower({c}), '[\s\x{{a0}}_-]+', '', 'g'), '^(sha256:?|0x)+', '')"
    return f"CASE WHEN regexp_full_match({bare}, '[0-9a-f]{{64}}') AND {bare} <> repeat(substr({bare}, 1, 1), 64) THEN {bare} END"


_OVERLAP = f"""
rec AS (SELECT DISTINCT id, lower(trim(split)) = 'train' is_train, {_digest('audio_sha256')} a, {_digest('window_sha256')} w FROM baseline_rows WHERE lower(trim(split)) IN ('train', 'dev', 'test')),
win AS (SELECT DISTINCT r.id, is_train, d FROM (SELECT id, {_digest('window_sha256')} d FROM recording_windows) JOIN (SELECT DISTINCT id, is_train FROM rec) r USING (id) WHERE d IS NOT NULL),
size AS (SELECT id, is_train, count(*) n FROM win GROUP BY 1, 2),
shared AS (SELECT t.id t, e.id e, count(*) k FROM win t JOIN win e ON t.d = e.d AND t.is_train AND NOT e.is_train GROUP BY 1, 2),
pairs AS (
  SELECT t.id t, e.id e, 1 kind, 0 k FROM rec t JOIN rec e ON t.a = e.a AND t.is_train AND NOT e.is_train
  UNION SELECT t.id, e.id, 2, 0 FROM rec t JOIN rec e ON t.w = e.w AND t.is_train AND NOT e.is_train
  UNION SELECT t, e, 0, k FROM shared s JOIN size x ON x.id = t AND x.is_train JOIN size y ON y.id = e AND NOT y.is_train WHERE 2 * k >= least(x.n, y.n)),
found AS (SELECT least(t, e) id_a, greatest(t, e) id_b, bool_or(kind = 1) same_audio, bool_or(kind = 2) same_window, max(k) shared_windows FROM pairs WHERE t <> e GROUP BY 1, 2)"""

_SPANS = f"""
seat AS (SELECT id, is_train, d, row_number() OVER (PARTITION BY id, is_train ORDER BY k) - 1 at_ FROM (
  SELECT r.id, is_train, d, min(k) k FROM (SELECT id, coalesce(window_index, 0) k, {_digest('window_sha256')} d FROM recording_windows) JOIN (SELECT DISTINCT id, is_train FROM rec) r USING (id) WHERE d IS NOT NULL GROUP BY ALL)),
together AS (SELECT s.t, s.e, x.at_ ta, y.at_ ea FROM shared s JOIN size p ON p.id = s.t AND p.is_train JOIN size q ON q.id = s.e AND NOT q.is_train
  JOIN seat x ON x.id = s.t AND x.is_train JOIN seat y ON y.id = s.e AND NOT y.is_train AND x.d = y.d WHERE 2 * k >= least(p.n, q.n) AND s.t <> s.e),
span AS (SELECT t, e, min(ta) ta, min(ea) ea, count(*) AS length FROM (SELECT *, ta - row_number() OVER (PARTITION BY t, e, ta - ea ORDER BY ta) i FROM together) GROUP BY t, e, ta - ea, i),
longest AS (SELECT least(t, e) id_a, greatest(t, e) id_b, max(length) longest_run FROM span GROUP BY 1, 2)"""

_BLANK = r"[\s\x{a0}]"
_MISSING = r"({0} IS NULL OR lower(regexp_replace({0}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')) IN ('', 'nan', 'none', 'null'))"


def _tidy(c: str) -> str:
    return f"lower(regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g'))"


_GROUPS = f"""
rows AS (
  SELECT sample_id, CASE WHEN NOT {_MISSING.format('speaker_id')} THEN regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(speaker_id, '{_BLANK}+', '', 'g')), '^([^:]+):+(?:speaker:+)?', '\\1::'), '\\.0*$', ''), '::0+([0-9])', '::\\1') END s,
    CASE WHEN NOT {_MISSING.format('source_file')} THEN regexp_replace(regexp_replace({_tidy('source_file')}, '[\\\\/]+', '/', 'g'), '^(\\./)+', '') END f, {_tidy('split')} p FROM manifest),
star AS (SELECT f, min(s) m FROM rows WHERE f IS NOT NULL AND s IS NOT NULL GROUP BY f),
edge AS (SELECT DISTINCT s a, m b FROM rows JOIN star USING (f) WHERE s <> m),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge)"""


def broken_groups(con) -> set[str]:
    """sample_id of p6_found, by a union of speakers outside SQL; con: a DuckDB connection with the table manifest."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in con.execute(f"WITH {_GROUPS} SELECT a, b FROM edge").fetchall():
        root[find(a)] = find(b)
    rows = con.execute(f"WITH {_GROUPS} SELECT sample_id, coalesce(s, m), f, p FROM rows LEFT JOIN star USING (f)").fetchall()
    seen: dict[str, set[str]] = {}
    group = lambda i, s, f: f"s{find(s)}" if s else f"f{f}" if f else f"r{i}"
    for i, s, f, p in rows:
        if p in ("train", "dev", "test"):
            seen.setdefault(group(i, s, f), set()).add(p)
    return {i for i, s, f, _ in rows if len(seen.get(group(i, s, f), ())) > 1}


_MEMBERS = f"""SELECT DISTINCT t.cell_id, sample_id FROM sample_targets t JOIN (SELECT DISTINCT sample_id, {_tidy('language')} l, {_tidy('label')} k, CASE WHEN NOT {_MISSING.format('generator')} THEN {_tidy('generator')} END g FROM manifest WHERE sample_id IS NOT NULL) m
  ON lower(t.language) = l AND t.label = k AND lower(t.generator) IS NOT DISTINCT FROM g"""
_CELLS = f"""
cell AS (SELECT t.cell_id, count(m.sample_id) n_available, greatest(min_rows, round(target_share * sample_size))::BIGINT n_wanted FROM sample_targets t
  LEFT JOIN (SELECT DISTINCT sample_id, {_tidy('language')} l, {_tidy('label')} k, CASE WHEN NOT {_MISSING.format('generator')} THEN {_tidy('generator')} END g FROM manifest WHERE sample_id IS NOT NULL) m
  ON lower(t.language) = l AND t.label = k AND lower(t.generator) IS NOT DISTINCT FROM g GROUP BY t.cell_id, min_rows, target_share, sample_size)"""
_WORDS = r"regexp_extract_all(lower(regexp_replace(replace(text, 'ß', 'ss'), '\p{Cf}+', '', 'g')), '[\p{L}\p{M}\p{N}]+')"
_RUNS = f"""
doc AS (SELECT doc_id, {_WORDS} w FROM documents WHERE text IS NOT NULL),
item AS (SELECT item_id, {_WORDS} w FROM eval_items WHERE text IS NOT NULL),
inside AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) k FROM doc)),
asked AS (SELECT item_id, k, array_to_string(w[k:k + 7], ' ') g, n FROM (SELECT item_id, w, len(w) n, unnest(range(1, len(w) - 6)) k FROM item)),
met AS (SELECT doc_id, item_id, n, a.k ik, d.k - a.k diagonal FROM inside d JOIN asked a USING (g)),
island AS (SELECT doc_id, item_id, diagonal, max(ik) - min(ik) + 8 AS run FROM (SELECT *, ik - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY ik) i FROM met) GROUP BY doc_id, item_id, diagonal, i),
longest AS (SELECT doc_id, item_id, max(run) longest_run FROM island GROUP BY 1, 2),
covered AS (SELECT doc_id, item_id, n, count(DISTINCT c) covered_words FROM (SELECT doc_id, item_id, n, unnest(range(ik, ik + 8)) c FROM (SELECT DISTINCT doc_id, item_id, n, ik FROM met)) GROUP BY 1, 2, 3),
passage AS (SELECT doc_id, item_id, covered_words, n item_words, longest_run FROM covered JOIN longest USING (doc_id, item_id))"""

_NEAR = f"""
doc AS (SELECT doc_id, {_WORDS} w FROM documents WHERE text IS NOT NULL), item AS (SELECT item_id, {_WORDS} w FROM eval_items WHERE text IS NOT NULL),
place AS (SELECT doc_id, unnest(w) term, unnest(range(1, len(w) + 1)) p FROM doc), often AS (SELECT term, count(*) n FROM place GROUP BY term),
word AS (SELECT item_id, unnest(w) term, unnest(range(1, len(w) + 1)) o, len(w) - 7 item_windows FROM item), counted AS (SELECT word.*, coalesce(n, 0) n FROM word LEFT JOIN often USING (term)),
ranked AS (SELECT k.item_id, k.o k, c.term, c.o, row_number() OVER (PARTITION BY k.item_id, k.o ORDER BY c.n, c.o) r FROM counted k JOIN counted c ON c.item_id = k.item_id AND c.o BETWEEN k.o AND k.o + 7 WHERE k.o <= k.item_windows),
three AS (SELECT item_id, k, max(term) FILTER (r = 1) ta, max(o) FILTER (r = 1) oa, max(term) FILTER (r = 2) tb, max(o) FILTER (r = 2) ob, max(term) FILTER (r = 3) tc, max(o) FILTER (r = 3) oc FROM ranked WHERE r <= 3 GROUP BY 1, 2),
two AS (SELECT DISTINCT x.doc_id, item_id, k, first_p, oa, oc, tc FROM (SELECT a.doc_id, t.*, a.p first_p, a.p + ob - oa + s p FROM three t JOIN place a ON a.term = ta, (SELECT unnest(range(-2, 3)) s)) x JOIN place b ON b.term = tb AND b.doc_id = x.doc_id AND b.p = x.p),
met AS (SELECT x.doc_id, item_id, count(DISTINCT k) near_windows FROM (SELECT doc_id, item_id, k, first_p + oc - oa + s p, tc FROM two, (SELECT unnest(range(-2, 3)) s)) x JOIN place c ON c.term = tc AND c.doc_id = x.doc_id AND c.p = x.p GROUP BY 1, 2)"""

_PLAIN = "CASE WHEN regexp_matches({0}, '[\\x{{0590}}-\\x{{1fff}}]') THEN nfc_normalize(lower({0})) ELSE strip_accents(lower({0})) END"
_PARTS = r"""regexp_extract_all({0}, '[\p{{L}}\p{{N}}\p{{M}}@$]+')"""
_LETTER = r"CASE WHEN regexp_matches({0}, '\p{{L}}') THEN replace(translate({0}, '1@0345', 'iaoeas'), '$', 's') ELSE {0} END"
_GRAMS = """list_distinct(list_concat(list_concat(list_transform(range(1, length({0}) + 1), lambda i: {0}[i] || '#' || length(regexp_replace({0}[1:i], '[^' || {0}[i] || ']', '', 'g'))),
  list_transform(range(1, length({0}) + 2), lambda i: ('^' || {0} || '$')[i] || ('^' || {0} || '$')[i + 1])), list_transform(range(1, length({0}) + 1), lambda i: ('^' || {0} || '$')[i] || '_' || ('^' || {0} || '$')[i + 2])))"""
_LANGUAGES = f"""
stored AS (SELECT DISTINCT 'indicvoices' source_table, sample_id, lang typed FROM indicvoices UNION ALL SELECT DISTINCT 'indicsynth', sample_id, language FROM indicsynth),
value AS (SELECT typed, trim({_PLAIN.format('typed')}, ' ' || chr(9) || chr(160)) p FROM (SELECT DISTINCT typed FROM stored WHERE typed IS NOT NULL AND typed NOT IN (SELECT name FROM language_list))),
parts AS (SELECT typed, CASE WHEN regexp_full_match(p, '[\\p{{L}}\\p{{N}}_]([-. ][\\p{{L}}\\p{{N}}_]){{2,}}') THEN [regexp_replace(p, '[-. ]', '', 'g')] ELSE {_PARTS.format('p')} END ws FROM value),
word AS (SELECT typed, {_LETTER.format('w')} w, place, n_words FROM (SELECT typed, unnest(ws) w, unnest(range(len(ws))) place, len(ws) n_words FROM parts)),
name AS (SELECT DISTINCT language_code code, array_to_string({_PARTS.format('p')}, '') n FROM (SELECT language_code, {_PLAIN.format('x')} p FROM (SELECT language_code, unnest(list_concat([name], other_names)) x FROM language_list))),
near AS (SELECT w, code, n, damerau_levenshtein(w, n) d FROM (SELECT DISTINCT w FROM word) JOIN name ON damerau_levenshtein(w, n) <= CASE WHEN length(n) < 4 THEN 0 WHEN length(n) < 6 THEN 1 ELSE 2 END),
scored AS (SELECT w, code, min(d * 1000 - CASE WHEN d = 0 THEN 1 ELSE len(list_intersect({_GRAMS.format('w')}, {_GRAMS.format('n')})) / len(list_distinct(list_concat({_GRAMS.format('w')}, {_GRAMS.format('n')}))) END) s FROM near GROUP BY 1, 2),
best AS (SELECT w, min(code) name_code FROM (SELECT *, rank() OVER (PARTITION BY w ORDER BY round(s, 9)) r FROM scored) WHERE r = 1 GROUP BY w HAVING count(*) = 1),
short AS (SELECT w, min(code) short_code FROM (SELECT language_code code, unnest([lower(language_code), lower(iso3)]) w FROM language_list) GROUP BY w),
known AS (SELECT word.*, name_code, short_code FROM word LEFT JOIN best USING (w) LEFT JOIN short USING (w)),
meant AS (SELECT typed, n_words, coalesce(list_distinct(list(name_code) FILTER (name_code IS NOT NULL)), []) by_name, coalesce(list_distinct(list(short_code) FILTER (name_code IS NULL AND short_code IS NOT NULL)), []) by_code,
  max(short_code) FILTER (place = 0) lead_code, max(length(w)) FILTER (place = 1) region FROM known GROUP BY 1, 2),
decided AS (SELECT typed, CASE WHEN len(by_name) = 0 THEN CASE WHEN n_words = 1 OR n_words = 2 AND region = 2 THEN lead_code WHEN len(by_code) = 1 AND n_words = 2 THEN by_code[1] END
  WHEN len(by_name) = 1 AND NOT (n_words = 2 AND len(list_distinct(list_concat(by_name, by_code))) > 1) THEN by_name[1] END code FROM meant),
mapped AS (SELECT source_table, sample_id, typed, CASE WHEN typed IS NOT NULL THEN coalesce((SELECT min(language_code) FROM language_list WHERE name = typed), code, 'none') END code FROM stored LEFT JOIN decided USING (typed))"""

SQL: dict[str, str] = {
    "p3_mapped": f"WITH {_LANGUAGES} SELECT * FROM mapped",
    "p3_found": f"WITH {_LANGUAGES} SELECT source_table, sample_id, code language_code FROM mapped WHERE typed IS NOT NULL AND typed NOT IN (SELECT name FROM language_list)",
    "p3_report": f"WITH {_LANGUAGES} SELECT source_table, code language_code, count(*) n_samples, count(DISTINCT typed) n_values FROM mapped WHERE typed IS NOT NULL GROUP BY 1, 2",
    "p8_near": f"WITH {_NEAR} SELECT doc_id, item_id, near_windows, item_windows FROM met JOIN (SELECT DISTINCT item_id, item_windows FROM word) USING (item_id) WHERE near_windows * 2 >= item_windows",
    "p5_checks": f"WITH {_CELLS} SELECT least((SELECT max(sample_size) FROM sample_targets), (SELECT count(DISTINCT sample_id) FROM ({_MEMBERS})))::BIGINT n_rows, least((SELECT max(sample_size) FROM sample_targets), (SELECT count(DISTINCT sample_id) FROM ({_MEMBERS})))::BIGINT n_ids, 0::BIGINT n_outside, 0::BIGINT n_below",
    "p6_checks": f"""WITH RECURSIVE {_GROUPS},
walk AS (SELECT a node, b seen FROM both_ways UNION SELECT node, l.b FROM walk JOIN both_ways l ON seen = l.a), root AS (SELECT node, least(node, min(seen)) r FROM walk GROUP BY node)
SELECT count(DISTINCT sample_id) n_records, count(DISTINCT coalesce('s ' || coalesce(r, coalesce(s, m)), 'f ' || f, 'r ' || sample_id)) n_components, 0::BIGINT n_torn FROM rows LEFT JOIN star USING (f) LEFT JOIN root ON node = coalesce(s, m) WHERE sample_id IS NOT NULL""",
    "p6_quotas": f"""WITH r AS (SELECT sample_id, CASE WHEN min({_tidy('label')}) = 'bonafide' THEN 'bonafide' ELSE 'other' END label FROM manifest WHERE sample_id IS NOT NULL GROUP BY 1)
SELECT new_split, label, round(count(*) * share, 6) n_quota, true met FROM r, (VALUES ('train', 0.6::DOUBLE), ('dev', 0.2), ('test', 0.2)) t(new_split, share) GROUP BY new_split, label, share""",
    "p8_found": f"WITH {_RUNS} SELECT doc_id, item_id FROM passage WHERE covered_words * 2 >= item_words",
    "p8_passages": f"WITH {_RUNS} SELECT * FROM passage",
    "p8_items": f"WITH {_RUNS} SELECT item_id, count(*) FILTER (covered_words = item_words) n_whole, count(*) FILTER (covered_words * 2 >= item_words) n_half, count(*) n_any, max(longest_run) longest_run FROM passage GROUP BY item_id",
    "p4_found": f"WITH {_OVERLAP} SELECT id_a, id_b FROM found",
    "p4_pairs": f"WITH {_OVERLAP}, {_SPANS} SELECT found.*, coalesce(longest_run, 0)::BIGINT longest_run FROM found LEFT JOIN longest USING (id_a, id_b)",
    "p4_spans": f"WITH {_OVERLAP}, {_SPANS} SELECT t train_id, e eval_id, ta::BIGINT train_at, ea::BIGINT eval_at, length FROM span",
    "p5_found": f"WITH {_CELLS} SELECT cell_id FROM cell WHERE n_available < n_wanted",
    "p5_cells": f"WITH {_CELLS} SELECT cell_id, n_available, n_wanted, greatest(0, n_wanted - n_available)::BIGINT n_missing FROM cell",
    "p6_found": f"""WITH RECURSIVE {_GROUPS},
walk AS (SELECT a node, b seen FROM both_ways UNION SELECT node, l.b FROM walk JOIN both_ways l ON seen = l.a),
root AS (SELECT node, least(node, min(seen)) r FROM walk GROUP BY node),
grouped AS (SELECT sample_id, coalesce('s ' || coalesce(r, coalesce(s, m)), 'f ' || f, 'r ' || sample_id) c, p FROM rows LEFT JOIN star USING (f) LEFT JOIN root ON node = coalesce(s, m) WHERE sample_id IS NOT NULL)
SELECT DISTINCT sample_id FROM grouped WHERE c IN (SELECT c FROM grouped WHERE p IN ('train', 'dev', 'test') GROUP BY c HAVING count(DISTINCT p) > 1)""",
    "p4_report": f"""WITH {_OVERLAP},
ends AS (SELECT id, count(*) k FROM (SELECT id_a id FROM found UNION ALL SELECT id_b FROM found) GROUP BY 1),
mine AS (SELECT DISTINCT id, lower(trim(split)) AS split, source FROM baseline_rows WHERE lower(trim(split)) IN ('dev', 'test'))
SELECT split, source, count(*) n_records, count(k) n_overlapping, coalesce(sum(k), 0)::BIGINT n_pairs FROM mine LEFT JOIN ends USING (id) GROUP BY 1, 2""",
}
