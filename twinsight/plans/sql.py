"""DuckDB SQL with the same results as the queries, built from shared common table expressions."""

from __future__ import annotations

import re

from ..config import DEFAULT as D
from .queries import CHANGED_WORDS

_TOKS = "list_transform(list_filter(regexp_split_to_array({0}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), lambda x: CASE WHEN x IN ('0', '1') THEN x ELSE regexp_replace(lower(x), '[0-9]+', 'INT', 'g') END)"
_GROUP = "lang || '-' || fp"


def _units(source: str) -> str:
    return f"SELECT *, len(toks)::BIGINT AS token_count, md5(array_to_string(toks, ' ')) AS fp FROM (SELECT doc_id AS unit_id, coalesce(lang, '') AS lang, coalesce(source, '') AS dir, {_TOKS.format('coalesce(text, chr(32))')} AS toks FROM {source})"


def _reps(units: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, fp ORDER BY unit_id) AS rn FROM {units} WHERE token_count >= {D.min_unit_tokens}) WHERE rn = 1"


def _grams(reps: str, k: int) -> str:
    return f"SELECT unit_id, lang, i - 1 AS pos, array_to_string(toks[i:i + {k - 1}], ' ') AS g FROM (SELECT unit_id, lang, toks, unnest(generate_series(1, len(toks) - {k - 1})) AS i FROM {reps})"


def _jaccard(grams: str) -> str:
    return f"""SELECT lang, unit_a, unit_b, shared, sim FROM (SELECT p.*, shared::DOUBLE / (x.bag + y.bag - shared)::DOUBLE AS sim FROM
        (SELECT a.lang, a.unit_id AS unit_a, b.unit_id AS unit_b, count(*) AS shared FROM {grams}_capped a JOIN {grams}_capped b ON a.lang = b.lang AND a.g = b.g AND a.unit_id < b.unit_id GROUP BY ALL) p
        JOIN {grams}_size x ON x.unit_id = unit_a JOIN {grams}_size y ON y.unit_id = unit_b) WHERE sim >= {D.candidate_sim}"""


def _capped(bags: str) -> str:
    return f"SELECT * FROM {bags} WHERE (lang, g) IN (SELECT (lang, g) FROM {bags} GROUP BY lang, g HAVING count(*) BETWEEN 2 AND {D.df_cap})"


def _closure(pairs: str) -> str:
    return f"""SELECT unit_id, min(c) AS component FROM (
        SELECT unit_id, c FROM {pairs}_reach UNION ALL SELECT unit_id, unit_id FROM {pairs}_reach) GROUP BY unit_id"""


def _reach(pairs: str) -> str:
    return f"""SELECT unit_a AS unit_id, unit_b AS c FROM {pairs} UNION SELECT unit_b, unit_a FROM {pairs}
        UNION SELECT r.unit_id, CASE WHEN r.c = p.unit_a THEN p.unit_b ELSE p.unit_a END FROM {pairs}_reach r JOIN {pairs} p ON r.c = p.unit_a OR r.c = p.unit_b"""


def _summary(pairs: str, parts: str) -> str:
    return f"""SELECT s.component, n_members, s.best.unit_a AS best_a, s.best.unit_b AS best_b, s.best.div AS min_div, max_div FROM
        (SELECT component, min({{'div': div, 'unit_a': unit_a, 'unit_b': unit_b}}) AS best, max(div) AS max_div FROM (SELECT round(1 - round(sim, 6), 6) AS div, unit_a, unit_b FROM {pairs}) JOIN {parts} ON unit_a = unit_id GROUP BY component) s
        JOIN (SELECT component, count(*) AS n_members FROM {parts} GROUP BY component) m USING (component)"""


_AHEAD = " UNION ALL ".join(f"SELECT unit_id, lang, g, pos, lead(g, {k}) OVER w AS h, lead(pos, {k}) OVER w AS p FROM rare_here WINDOW w AS (PARTITION BY unit_id ORDER BY pos)" for k in range(1, D.landmark_fan_out + 1))
_RUNS = " UNION ALL ".join(f"""SELECT unit_id, {p} AS period, min(nth) - {p} AS start_at, max(nth) AS hi, (count(*) + {p}) // {p} AS n_repeats, sum(line_tokens)::BIGINT * {p} // count(*) AS template_tokens FROM
        (SELECT *, z.nth - row_number() OVER (PARTITION BY unit_id ORDER BY z.nth) AS island FROM (SELECT *, lag(line, {p}) OVER (PARTITION BY unit_id ORDER BY nth) AS prev FROM line_at) z WHERE prev = line) GROUP BY unit_id, island""" for p in range(1, D.fold_max_period + 1))

#: Common table expressions; one may use those before it.
CTES: dict[str, str] = {
    "units": _units("documents"),
    "reps": _reps("units"),
    "n_units": "SELECT lang, count(*) AS n_units FROM reps GROUP BY lang",
    "grams5": _grams("reps", D.gram),
    "bags5": "SELECT DISTINCT unit_id, lang, g FROM grams5",
    "bags5_size": "SELECT unit_id, count(*) AS bag FROM bags5 GROUP BY unit_id",
    "bags5_capped": _capped("bags5"),
    "near": _jaccard("bags5"),
    "grams3": _grams("reps", D.landmark_gram),
    "bags3": "SELECT DISTINCT unit_id, lang, g FROM grams3",
    "rare_here": "SELECT g3.* FROM grams3 g3 JOIN (SELECT lang, g FROM (SELECT lang, g, count(*) AS df FROM bags3 GROUP BY lang, g) JOIN n_units USING (lang) WHERE df <= greatest(3, n_units // 20)) USING (lang, g)",
    "marks": f"SELECT DISTINCT unit_id, lang, g || '/' || h || '/' || ((p - pos) // {D.landmark_step}) AS g FROM ({_AHEAD}) WHERE h IS NOT NULL",
    "marks_capped": _capped("marks"),
    "marked": f"SELECT a.lang, a.unit_id AS unit_a, b.unit_id AS unit_b, count(*) AS shared FROM marks_capped a JOIN marks_capped b ON a.lang = b.lang AND a.g = b.g AND a.unit_id < b.unit_id GROUP BY ALL HAVING count(*) >= {D.shared_landmarks}",
    "candidates": "SELECT unit_a, unit_b, bool_or(b) AS by_bag, bool_or(m) AS by_landmark FROM (SELECT unit_a, unit_b, true AS b, false AS m FROM near UNION ALL SELECT unit_a, unit_b, false, true FROM marked) GROUP BY ALL",
    "gated": f"SELECT unit_a, unit_b, x.token_count AS ta, y.token_count AS tb FROM candidates JOIN units x ON x.unit_id = unit_a JOIN units y ON y.unit_id = unit_b WHERE greatest(x.token_count, y.token_count)::DOUBLE <= least(x.token_count, y.token_count)::DOUBLE * {1 + 2 * D.max_divergence + 0.15!r}::DOUBLE + 64",
    "offsets": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, g ORDER BY pos) AS rn FROM grams3) WHERE rn <= {D.histogram_offsets}",
    "inventory": "SELECT unit_id, count(*) AS inv FROM bags3 GROUP BY unit_id",
    "votes": f"SELECT unit_a, unit_b, max(n) AS votes FROM (SELECT unit_a, unit_b, bin, count(*) AS n FROM (SELECT DISTINCT unit_a, unit_b, a.g, (a.pos - b.pos) // {D.histogram_bin} AS bin FROM gated JOIN offsets a ON a.unit_id = unit_a JOIN offsets b ON b.unit_id = unit_b AND a.g = b.g) GROUP BY ALL) GROUP BY ALL",
    "near_reach": _reach("near"),
    "near_parts": _closure("near"),
    "near_summary": _summary("near", "near_parts"),
    "marked_reach": _reach("marked"),
    "marked_parts": _closure("marked"),
    "kgrams": _grams("reps", D.min_seq_tokens),
    "shared_k": "SELECT * FROM kgrams WHERE (lang, g) IN (SELECT (lang, g) FROM kgrams GROUP BY lang, g HAVING min(unit_id) < max(unit_id))",
    "suffixes": f"SELECT s.lang, s.g, s.unit_id, s.pos, r.toks[s.pos + {D.min_seq_tokens} + 1 :] AS after, CASE WHEN s.pos > 0 THEN r.toks[s.pos] END AS before FROM shared_k s JOIN reps r USING (unit_id)",
    "neighbours": "SELECT *, lag(unit_id) OVER w AS u0, lag(pos) OVER w AS p0, lag(before) OVER w AS b0 FROM suffixes WINDOW w AS (PARTITION BY lang, g ORDER BY after, unit_id, pos)",
    "run_pairs": "SELECT lang, least(u0, unit_id) AS unit_a, greatest(u0, unit_id) AS unit_b, CASE WHEN u0 < unit_id THEN p0 ELSE pos END AS pos_a, CASE WHEN u0 < unit_id THEN pos ELSE p0 END AS pos_b FROM neighbours WHERE u0 IS NOT NULL AND u0 <> unit_id AND (before IS NULL OR b0 IS NULL OR before <> b0)",
    "regions": "SELECT DISTINCT lang, unit_a, unit_b, pos_a, pos_b, coalesce(list_position(same, false) - 1, len(same))::BIGINT AS length FROM (SELECT r.*, list_transform(generate_series(1, greatest(len(x.toks) - pos_a, len(y.toks) - pos_b)), lambda i: coalesce(x.toks[pos_a + i] = y.toks[pos_b + i], false)) AS same FROM run_pairs r JOIN reps x ON x.unit_id = unit_a JOIN reps y ON y.unit_id = unit_b)",
    "run_spans": "SELECT unit_a AS unit_id, pos_a AS b0, pos_a + length AS b1 FROM regions UNION SELECT unit_b, pos_b, pos_b + length FROM regions",
    "line_rows": f"SELECT unit_id, lang, dir, i::BIGINT AS line_no, n_lines, array_to_string(toks, ' ') AS line, len(toks)::BIGINT AS line_tokens FROM (SELECT *, {_TOKS.format('ls[i]')} AS toks FROM (SELECT *, unnest(generate_series(1, n_lines)) AS i FROM (SELECT doc_id AS unit_id, coalesce(lang, '') AS lang, coalesce(source, '') AS dir, string_split(coalesce(text, ''), chr(10)) AS ls, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_lines FROM documents))) WHERE len(toks) > 0",
    "line_at": "SELECT unit_id, line, line_tokens, row_number() OVER (PARTITION BY unit_id ORDER BY line_no) AS nth FROM line_rows",
    "line_runs": f"SELECT * FROM ({_RUNS}) WHERE n_repeats >= {D.fold_min_repeats} AND template_tokens * n_repeats >= {D.min_seq_tokens}",
    "exact": f"SELECT *, ((n_members - 1) * token_count * CASE WHEN n_dirs > 1 THEN 1.5 ELSE 1 END)::DOUBLE AS value FROM (SELECT lang, fp, count(*) AS n_members, max(token_count) AS token_count, count(DISTINCT dir) AS n_dirs, min(unit_id) AS first_unit FROM units WHERE token_count >= {D.min_unit_tokens} GROUP BY lang, fp) WHERE n_members >= 2",
    "family": f"SELECT u.unit_id, u.lang, u.fp, e.first_unit FROM units u JOIN exact e ON e.lang = u.lang AND e.fp = u.fp WHERE u.token_count >= {D.min_unit_tokens}",
    "found": f"""SELECT {_GROUP} AS group_id, 'exact-normalized' AS tier, n_members, token_count, first_unit, value FROM exact UNION ALL
        SELECT 'near-' || component, 'near-normalized', n, t, component, ((n - 1) * t * CASE WHEN nd > 1 THEN 1.5 ELSE 1 END)::DOUBLE FROM (SELECT component, count(*) AS n, max(token_count) AS t, count(DISTINCT dir) AS nd FROM near_parts JOIN units USING (unit_id) GROUP BY component)""",
    "member_rows": f"SELECT {_GROUP} AS group_id, unit_id FROM family UNION ALL SELECT 'near-' || component, unit_id FROM near_parts",
    "sections": "SELECT f.*, CASE WHEN all_tests THEN 'test' ELSE 'main' END AS section FROM found f JOIN (SELECT group_id, bool_and(unit_id IN (SELECT doc_id FROM labels WHERE quality = 0)) AS all_tests FROM member_rows GROUP BY group_id) USING (group_id)",
    "ranks": "SELECT *, row_number() OVER (PARTITION BY section ORDER BY value DESC, token_count DESC, first_unit, tier) AS rank FROM sections",
    "large": f"SELECT unit_id, lang FROM units WHERE token_count >= {D.min_unit_tokens}",
    "elements": "SELECT unit_id, lang, name, least(line_no, 3) AS depth, line_no = 1 AS branch, line_no = n_lines AS tail, count(*) AS cnt FROM (SELECT unit_id, lang, line_no, n_lines, unnest(string_split(line, ' ')) AS name FROM line_rows WHERE unit_id IN (SELECT unit_id FROM large)) GROUP BY ALL",
    "weighted": "SELECT e.*, idf, rare FROM elements e JOIN (SELECT lang, name, ln(1 + n_units::DOUBLE / df::DOUBLE) AS idf, df <= greatest(3, n_units // 20) AS rare FROM (SELECT lang, name, count(DISTINCT unit_id) AS df FROM elements GROUP BY lang, name) JOIN (SELECT lang, count(*) AS n_units FROM large GROUP BY lang) USING (lang)) USING (lang, name)",
    "signatures": f"SELECT unit_id, lang, count(*) AS n_elements, count(DISTINCT name) FILTER (rare) AS n_rare, sum(cnt)::BIGINT AS mass, sum(cnt * idf) AS weight FROM weighted GROUP BY unit_id, lang HAVING count(DISTINCT name) FILTER (rare) >= {D.api_min_rare}",
    "names": "SELECT DISTINCT lang, name, unit_id FROM weighted WHERE rare AND unit_id IN (SELECT unit_id FROM signatures)",
    "owned": f"SELECT * FROM names WHERE (lang, name) IN (SELECT (lang, name) FROM names GROUP BY lang, name HAVING count(*) BETWEEN 2 AND {D.owner_cap})",
    "api_pairs": "SELECT a.unit_id AS unit_a, b.unit_id AS unit_b, count(*) AS n_shared FROM owned a JOIN owned b ON a.lang = b.lang AND a.name = b.name AND a.unit_id < b.unit_id GROUP BY ALL",
    "changes": "SELECT doc_id::VARCHAR AS file, (1 + 2 * quality)::BIGINT AS l0, (2 + 2 * quality)::BIGINT AS l1 FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id::VARCHAR, 12, 13 FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id::VARCHAR, NULL, NULL FROM labels WHERE quality = 0 AND toxic <> 1",
    "spans": "SELECT doc_id AS unit_id, doc_id::VARCHAR AS file, 1::BIGINT AS line0, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS line1 FROM documents",
    "touched": "SELECT * FROM spans s WHERE EXISTS (SELECT 1 FROM changes c WHERE c.file = s.file AND (c.l0 IS NULL OR (c.l0 <= s.line1 AND s.line0 <= c.l1)))",
    "counted": f"SELECT {_GROUP} AS fingerprint, count(*) AS n_members, count(*) FILTER (unit_id IN (SELECT unit_id FROM touched)) AS n_touched FROM family GROUP BY ALL",
    "old_docs": "SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "old_units": _units("old_docs"),
    "old_exact": f"SELECT {_GROUP} AS fingerprint, count(*) AS n_members FROM old_units WHERE token_count >= {D.min_unit_tokens} GROUP BY ALL HAVING count(*) >= 2",
    "was_units": f"SELECT * REPLACE (len(toks)::BIGINT AS token_count, md5(array_to_string(toks, ' ')) AS fp) FROM (SELECT * REPLACE (CASE WHEN unit_id IN (SELECT doc_id FROM labels) THEN toks[1:greatest(len(toks) - {CHANGED_WORDS}, 0)] ELSE toks END AS toks) FROM units)",
    "was_reps": _reps("was_units"),
    "was_grams": _grams("was_reps", D.gram),
    "was_bags": "SELECT DISTINCT unit_id, lang, g FROM was_grams",
    "was_bags_size": "SELECT unit_id, count(*) AS bag FROM was_bags GROUP BY unit_id",
    "was_bags_capped": _capped("was_bags"),
    "was_near": _jaccard("was_bags"),
    "was_near_reach": _reach("was_near"),
    "was_near_parts": _closure("was_near"),
    "was_summary": _summary("was_near", "was_near_parts"),
    "near_touched": "SELECT component, count(*) AS n_members, count(*) FILTER (unit_id IN (SELECT unit_id FROM touched)) AS n_touched FROM near_parts GROUP BY component",
    "def_rows": "SELECT lang, dir, unit_id, string_split(line, ' ')[1] AS name FROM line_rows WHERE line_no = 1",
    "call_rows": "SELECT lang, dir, unit_id, line_no, string_split(line, ' ')[1] AS name FROM line_rows WHERE line_no > 1",
    "named": f"SELECT doc_id AS unit_id, coalesce(source, '') AS file, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')[1:3], ' ') AS name, doc_id * 10 AS line0, doc_id * 10 + 9 AS line1 FROM documents",
    "old_members": "SELECT n.* FROM named n JOIN family USING (unit_id)",
    "now_named": "SELECT * FROM named WHERE unit_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "mapped": "SELECT b.unit_id AS member_id, min({'s': b.name <> c.name, 'u': c.unit_id}) AS x FROM old_members b JOIN now_named c ON b.file = c.file AND (b.name = c.name OR (b.line0 <= c.line1 AND c.line0 <= b.line1)) GROUP BY ALL",
    "steps": "SELECT src, dst, count(*) AS n FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY ALL",
    "arrows": "SELECT src, dst FROM steps WHERE n >= (SELECT avg(n) FROM steps)",
    "ways": "SELECT src, dst FROM arrows UNION SELECT w.src, a.dst FROM ways w JOIN arrows a ON w.dst = a.src",
    "groups_of": "SELECT 'near-' || component AS group_id, 1 AS rank, unit_id FROM near_parts UNION ALL SELECT 'mark-' || component, 2, unit_id FROM marked_parts",
    "group_sizes": "SELECT group_id, rank, count(*) AS size FROM groups_of GROUP BY ALL",
}


def with_ctes(query: str) -> str:
    """The query after the expressions it needs, in order."""
    need: set[str] = set()
    queue = [query]
    while queue:
        for name in set(re.findall(r"\w+", queue.pop())) & CTES.keys() - need:
            need.add(name)
            queue.append(CTES[name])
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in need)
    return f"WITH RECURSIVE {parts}\n{query}" if parts else query


_INSIDE = "o.length > i.length AND i.pos_a >= o.pos_a AND i.pos_a + i.length <= o.pos_a + o.length AND i.pos_b >= o.pos_b AND i.pos_b + i.length <= o.pos_b + o.length"
_FIRST = "octet_length(encode(string_split(coalesce(text, ''), chr(10))[1]))"
_MARKED = " OR ".join(f"contains(array_to_string(string_split(coalesce(text, ''), chr(10))[1:5], chr(10)), '{m}')" for m in D.markers)
_RANKS = "CASE tier WHEN 'exact-normalized' THEN 1 WHEN 'near-normalized' THEN 4 END"

_QUERIES = {
    "exact_groups": "SELECT lang, fp AS fingerprint, n_members, token_count, n_dirs, first_unit, value FROM exact",
    "exact_members": "SELECT unit_id, lang, fp AS fingerprint, first_unit FROM family",
    "generated_filter": f"SELECT doc_id AS unit_id, {_FIRST}::BIGINT AS first_line_bytes FROM documents WHERE {_FIRST} >= {D.minified_bytes} OR {_MARKED}",
    "size_floor_stats": f"SELECT lang, count(*) AS n_units, count(*) FILTER (token_count < {D.min_unit_tokens}) AS below_floor, sum(token_count)::BIGINT AS tokens FROM units GROUP BY lang",
    "first_representative": "SELECT unit_id, lang, fp, token_count FROM reps",
    "document_frequency": "SELECT lang, df, count(*) AS n_grams FROM (SELECT lang, g, count(*) AS df FROM bags5 GROUP BY lang, g) GROUP BY lang, df",
    "bag_pairs": "SELECT a.lang, a.unit_id AS unit_a, b.unit_id AS unit_b, count(*) AS shared FROM bags5_capped a JOIN bags5_capped b ON a.lang = b.lang AND a.g = b.g AND a.unit_id < b.unit_id GROUP BY ALL",
    "bag_jaccard": "SELECT lang, unit_a, unit_b, shared, round(sim, 6) AS similarity FROM near",
    "landmark_pairs": "SELECT unit_id, lang, count(*) AS n_landmarks FROM marks GROUP BY ALL",
    "landmark_candidates": "SELECT lang, unit_a, unit_b, shared FROM marked",
    "candidate_union": "SELECT unit_a, unit_b, by_bag, by_landmark FROM candidates",
    "size_gate": "SELECT unit_a, unit_b, ta, tb FROM gated",
    "offset_histogram": f"SELECT g.unit_a, g.unit_b, coalesce(v.votes, 0)::BIGINT AS votes, greatest({D.histogram_min_votes}, least(a.inv, b.inv) // 8)::BIGINT AS needed, coalesce(v.votes, 0) >= greatest({D.histogram_min_votes}, least(a.inv, b.inv) // 8) AS passed FROM gated g LEFT JOIN votes v ON v.unit_a = g.unit_a AND v.unit_b = g.unit_b JOIN inventory a ON a.unit_id = g.unit_a JOIN inventory b ON b.unit_id = g.unit_b",
    "pair_exclusion": "SELECT unit_a, unit_b, shared FROM marked WHERE (unit_a, unit_b) NOT IN (SELECT (unit_a, unit_b) FROM near)",
    "pair_parity": "SELECT lang, count(*) FILTER (b AND m) AS n_both, count(*) FILTER (b AND NOT m) AS n_bag_only, count(*) FILTER (m AND NOT b) AS n_landmark_only FROM (SELECT lang, unit_a, unit_b, bool_or(b) AS b, bool_or(m) AS m FROM (SELECT lang, unit_a, unit_b, true AS b, false AS m FROM near UNION ALL SELECT lang, unit_a, unit_b, false, true FROM marked) GROUP BY ALL) GROUP BY lang",
    "kgram_regions": "SELECT lang, unit_a, unit_b, pos_a, pos_b, length FROM regions",
    "region_containment": f"SELECT lang, unit_a, unit_b, pos_a, pos_b, length FROM regions i WHERE NOT EXISTS (SELECT 1 FROM regions o WHERE o.unit_a = i.unit_a AND o.unit_b = i.unit_b AND {_INSIDE})",
    "nested_exclusion": "SELECT unit_id, b0, b1 FROM run_spans i WHERE NOT EXISTS (SELECT 1 FROM run_spans o WHERE o.unit_id = i.unit_id AND o.b0 <= i.b0 AND i.b1 <= o.b1 AND (o.b0 < i.b0 OR i.b1 < o.b1))",
    "components": "SELECT unit_id, component FROM near_parts",
    "group_template_min_by": "SELECT component, n_members, best_a, best_b, min_div, max_div FROM near_summary",
    "group_containment": "SELECT h, count(*) AS n_members, coalesce(count(fp) = count(*) AND min(fp) = max(fp), false) AS contained FROM (SELECT DISTINCT md5(line) AS h, unit_id FROM line_rows WHERE line_tokens >= 5) LEFT JOIN family USING (unit_id) GROUP BY h HAVING count(*) >= 2",
    "subset_dedupe": "SELECT z.group_id, z.size, z.group_id IN (SELECT x.group_id FROM (SELECT a.group_id AS gx, b.group_id AS gy, count(*) AS n FROM groups_of a JOIN groups_of b ON a.unit_id = b.unit_id AND a.group_id <> b.group_id GROUP BY ALL) JOIN group_sizes x ON x.group_id = gx JOIN group_sizes y ON y.group_id = gy WHERE n = x.size AND (y.size > x.size OR (y.size = x.size AND (y.rank < x.rank OR (y.rank = x.rank AND y.group_id < x.group_id))))) AS dropped FROM group_sizes z",
    "internal_repeats": "SELECT unit_id, period::BIGINT AS period, start_at::BIGINT AS start_at, n_repeats::BIGINT AS n_repeats, template_tokens::BIGINT AS template_tokens FROM line_runs i WHERE NOT EXISTS (SELECT 1 FROM line_runs o WHERE o.unit_id = i.unit_id AND o.period < i.period AND o.start_at <= i.start_at AND i.hi <= o.hi)",
    "consolidation_value": "SELECT group_id, tier, n_members, token_count, value FROM found",
    "test_policy": "SELECT group_id, section FROM sections",
    "rank_sections": "SELECT group_id, section, tier, value, rank FROM ranks",
    "topk": f"SELECT group_id, section, rank FROM ranks WHERE rank <= {D.top}",
    "findings_by_tier": "SELECT tier, count(*) AS n_findings, sum(value) AS value FROM found GROUP BY tier",
    "gate": f"SELECT group_id, tier, {_RANKS}::BIGINT AS fail_rank, coalesce({_RANKS} <= 2, false) AS fails FROM found",
    "dup_line_ratio": "SELECT lang, sum(n)::BIGINT AS n_lines, sum(d)::BIGINT AS dup_lines, round(sum(d)::DOUBLE / sum(n)::DOUBLE, 6) AS ratio FROM (SELECT lang, unit_id, count(*) AS n, CASE WHEN unit_id IN (SELECT unit_id FROM family) THEN count(*) ELSE 0 END AS d FROM line_rows GROUP BY lang, unit_id) GROUP BY lang",
    "dup_token_ratio": "SELECT lang, tokens, saved, round(CASE WHEN tokens > 0 THEN saved::DOUBLE / tokens::DOUBLE ELSE 0 END, 6) AS ratio FROM (SELECT u.lang, tokens, coalesce(saved, 0)::BIGINT AS saved FROM (SELECT lang, sum(token_count)::BIGINT AS tokens FROM units GROUP BY lang) u LEFT JOIN (SELECT lang, sum((n_members - 1) * token_count) AS saved FROM exact GROUP BY lang) e USING (lang))",
    "api_signatures": "SELECT unit_id, lang, n_elements, n_rare, mass FROM signatures",
    "api_pairs": "SELECT unit_a, unit_b, n_shared FROM api_pairs",
    "weighted_jaccard": f"SELECT unit_a, unit_b, similarity, value FROM (SELECT p.unit_a, p.unit_b, round(low / (x.weight + y.weight - low), 6) AS similarity, value FROM (SELECT unit_a, unit_b, sum(least(a.cnt, b.cnt) * a.idf) AS low, sum(least(a.cnt, b.cnt))::BIGINT AS value FROM api_pairs JOIN weighted a ON a.unit_id = unit_a JOIN weighted b ON b.unit_id = unit_b AND a.name = b.name AND a.depth = b.depth AND a.branch = b.branch AND a.tail = b.tail GROUP BY ALL) p JOIN signatures x ON x.unit_id = p.unit_a JOIN signatures y ON y.unit_id = p.unit_b) WHERE similarity >= {D.api_sim}",
    "call_resolution": f"""SELECT c.unit_id, c.line_no, c.name, CASE WHEN f.n IS NOT NULL THEN 'file' WHEN e.n IS NOT NULL THEN 'dir' ELSE 'repo' END AS tier, coalesce(f.n, e.n, r.n) AS n_candidates,
        CASE WHEN coalesce(f.n, e.n, r.n) <= {D.max_candidates} THEN CASE WHEN f.n IS NOT NULL THEN c.unit_id ELSE coalesce(e.t, r.t) END END AS target FROM call_rows c
        LEFT JOIN (SELECT lang, name, unit_id, count(*) AS n FROM def_rows GROUP BY ALL) f ON f.lang = c.lang AND f.name = c.name AND f.unit_id = c.unit_id
        LEFT JOIN (SELECT lang, name, dir, count(*) AS n, min(unit_id) AS t FROM def_rows GROUP BY ALL) e ON e.lang = c.lang AND e.name = c.name AND e.dir = c.dir
        JOIN (SELECT lang, name, count(*) AS n, min(unit_id) AS t FROM def_rows GROUP BY ALL) r ON r.lang = c.lang AND r.name = c.name""",
    "diff_hunks": "SELECT file, l0, l1 FROM changes",
    "touched_units": "SELECT unit_id FROM touched",
    "inconsistent_update": "SELECT fingerprint, n_members, n_touched FROM counted WHERE n_touched > 0 AND n_touched < n_members",
    "check_new": "SELECT fingerprint, n_members, n_touched FROM counted WHERE n_touched > 0 AND fingerprint NOT IN (SELECT fingerprint FROM old_exact)",
    "check_worsened": f"SELECT n.fingerprint, b.n_members AS was, n.n_members AS now, n.n_touched FROM counted n JOIN old_exact b USING (fingerprint) WHERE n.n_touched > 0 AND n.n_members > b.n_members UNION ALL SELECT 'near-' || n.component, b.n_members AS was, n.n_members AS now, t.n_touched FROM near_summary n JOIN was_summary b ON b.component = n.component JOIN near_touched t ON t.component = n.component WHERE t.n_touched > 0 AND (n.n_members > b.n_members OR round(n.max_div - b.max_div, 6) > {D.drift_epsilon})",
    "check_drifting": f"SELECT n.component AS fingerprint, b.max_div AS was, n.max_div AS now FROM near_summary n JOIN was_summary b ON b.component = n.component JOIN near_touched t ON t.component = n.component WHERE t.n_touched = 0 AND round(n.max_div - b.max_div, 6) > {D.drift_epsilon}",
    "base_member_mapping": """SELECT b.unit_id AS member_id, m.x.u AS unit_id, CASE WHEN m.x.s THEN 'span' WHEN NOT m.x.s THEN 'name' ELSE 'none' END AS matched_by FROM old_members b LEFT JOIN mapped m ON m.member_id = b.unit_id""",
    "scc": "SELECT src AS node, least(min(dst), src) AS scc, count(*) AS scc_size FROM ways w WHERE EXISTS (SELECT 1 FROM ways v WHERE v.src = w.dst AND v.dst = w.src) GROUP BY src HAVING count(*) > 1",
    "jscpd_pairs": f"SELECT {_GROUP} AS group_id, first_unit AS first_id, unit_id AS second_id FROM family WHERE unit_id <> first_unit",
    "cpd_file_elements": f"SELECT {_GROUP} AS group_id, unit_id, '<file path=\"' || file || '.txt\" line=\"' || line0 || '\" endline=\"' || line1 || '\"/>' AS xml FROM family JOIN spans USING (unit_id)",
    "cpd_xml": f"SELECT {_GROUP} AS group_id, '<duplication lines=\"' || len(string_split(coalesce(text, ''), chr(10))) || '\" tokens=\"' || token_count || '\">' AS head, '<codefragment><![CDATA[' || replace(coalesce(text, ''), ']]>', ']]]]><![CDATA[>') || ']]></codefragment></duplication>' AS tail FROM exact JOIN documents ON doc_id = first_unit".replace("lang ||", "exact.lang ||"),
    "sarif": f"""SELECT exact.{_GROUP} AS group_id, '{{"ruleId":"exact-normalized","level":"error","message":{{"text":"' || n_members || ' members"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file || '.txt"}},"region":{{"startLine":' || line0 || ',"endLine":' || line1 || '}}}}}}],"partialFingerprints":{{"structural/v1":"' || exact.{_GROUP} || '"}}}}' AS result FROM exact JOIN spans ON unit_id = first_unit""",
}

SQL = {name: with_ctes(query) for name, query in _QUERIES.items()}
