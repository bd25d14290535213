r"""DuckDB SQL with the rows of each query, stated anew rather than derived from the Spark plans."""

from __future__ import annotations

import json

from . import config as C
from .plans import generation as G

W = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAK = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
TAG = r"\[\[(\d+(?:\.\d+)?)\]\]"
D = 1 << 59


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\A{W}+', ''), '{W}+\z', '')"


def lines(x: str) -> str:
    s = f"string_split_regex({x}, '{BREAK}')"
    return f"(CASE WHEN {s}[-1] = '' THEN {s}[:-2] ELSE {s} END)"


def round2(x: str) -> str:
    """Whole points are split off first, so that the rest, scaled by 2**59, is a whole number."""
    size = f"abs({x})"
    n = f"(({size} - floor({size})) * {D}::double)::hugeint * 100"
    cents = f"(floor({size})::hugeint * 100 + ({n}) // {D} + CASE WHEN ({n}) % {D} * 2 > {D} THEN 1 WHEN ({n}) % {D} * 2 = {D} THEN ({n}) // {D} % 2 ELSE 0 END)"
    return f"(sign({x}) * {cents}::double / 100)"


def rows(name: str, columns: str, values: list[tuple]) -> str:
    quote = lambda v: str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(quote, v)) + ")" for v in values) + ")"


H = "(doc_id * 31 + n_chars * 7 + dim_ord * 17 + model_ord * 13 + round * 5) % 23"
SCORE = rf"CASE WHEN regexp_matches(raw, '{TAG}') THEN least(10.0::double, regexp_extract(raw, '{TAG}', 1)::double) ELSE list_filter(list_transform(regexp_extract_all(raw, '(\d+(?:\.\d+)?)', 1), lambda x: x::double), lambda x: x BETWEEN 0 AND 10)[-1] END"
JUDGED = f"""
WITH {rows("dims", "dim_ord, dim, label, w", [(i, d, C.LABELS[d], C.WEIGHTS[d]) for i, d in enumerate(C.DIMENSIONS)])},
{rows("models", "model_ord, model, model_label", [(i, k, label) for i, (k, label) in enumerate(C.MODELS)])},
answers AS (
  SELECT doc_id, round, dim_ord, dim, model_ord, model, model_label,
         CASE WHEN (doc_id + dim_ord) % 11 = 0 OR doc_id % 97 = 0 OR (doc_id % 13 = 0 AND dim_ord <> 2) THEN NULL
              WHEN {H} <= 6 THEN '分数：[[' || {H} || ']]' WHEN {H} <= 13 THEN '分数：[[' || ({H} - 5) || '.25]]'
              WHEN {H} = 14 THEN '评分 8/10 于2024' WHEN {H} = 15 THEN '[[15]]' WHEN {H} <= 19 THEN '无法评分' END AS raw
  FROM documents, dims, models, (VALUES (1), (2), (3)) r(round)),
judged AS (
  SELECT *, {SCORE} AS score FROM answers),
flagged AS (
  SELECT *, CASE WHEN raw IS NULL THEN 'call failed' WHEN score IS NULL THEN '{C.UNPARSED}' END AS error, coalesce(raw, '') AS reason FROM judged),
means AS (
  SELECT doc_id, round, dim_ord, dim, {round2("sum(score) / nullif(count(score), 0)")} AS score FROM flagged GROUP BY ALL),
lasts AS (SELECT * FROM means WHERE round = 3),
wide AS (
  SELECT doc_id, {", ".join(f"max(score) FILTER (dim = '{d}') AS {d}" for d in C.DIMENSIONS)} FROM lasts GROUP BY doc_id),
sums AS (
  SELECT *, 0.0::double + {" + ".join(f"coalesce({d} * {C.WEIGHTS[d]}::double, 0.0::double)" for d in C.DIMENSIONS)} AS total,
         0.0::double + {" + ".join(f"CASE WHEN {d} IS NULL THEN 0.0::double ELSE {C.WEIGHTS[d]}::double END" for d in C.DIMENSIONS)} AS weight FROM wide),
overall AS (SELECT *, CASE WHEN weight > 0 THEN {round2("total / weight")} END AS overall_score FROM sums),
finals AS (
  SELECT doc_id, {", ".join(C.DIMENSIONS)}, overall_score, coalesce(overall_score >= 5, false) AS passed,
         CASE WHEN coalesce(overall_score >= 5, false) THEN '{C.PASSED}' ELSE '{C.FAILED}' END AS conclusion FROM overall),
trend AS (
  SELECT doc_id, dim_ord, dim, {", ".join(f"max(score) FILTER (round = {r}) AS r{r}" for r in (1, 2, 3))} FROM means GROUP BY ALL)
"""

with open(C.PROMPTS, encoding="utf-8") as _f:
    _TEMPLATES = {p["name"]: p["prompt_template"] for p in map(json.loads, filter(str.strip, _f))}
PROMPTS = rows("prompts", "pdim, template", [(d, _TEMPLATES[d]) for d in C.DIMENSIONS])

TEXTS = """
texts AS (
  SELECT conv_id AS id, string_agg(CASE WHEN conv_id % 3 = 1 AND turn % 2 = 1 THEN 'user' ELSE role END || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1
  UNION ALL
  SELECT conv_id + 1000000, string_agg(CASE turn % 3 WHEN 0 THEN 'instruction: ' WHEN 1 THEN 'input：' ELSE 'OUTPUT : ' END || text, chr(10) ORDER BY turn) FROM conversations GROUP BY 1
  UNION ALL SELECT doc_id + 2000000, text FROM documents)
"""


def _segments(out: str, words: str, kinds: str) -> str:
    mark = rf"(?is)\A{W}*({words}){W}*[:：]{W}*(.*)\z"
    return f"""
{out}_lines AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT id, {lines("text")} AS l FROM texts)),
{out}_marks AS (SELECT *, lower(regexp_extract(line, '{mark}', 1)) AS k, {strip(f"regexp_extract(line, '{mark}', 2)")} AS own FROM {out}_lines),
{out}_runs AS (SELECT *, sum(CASE WHEN k <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS seg FROM {out}_marks),
{out} AS (
  SELECT id, seg, {kinds} AS kind, {strip("coalesce(string_agg(CASE WHEN k = '' THEN line ELSE own END, chr(10) ORDER BY n) FILTER (k = '' OR own <> ''), '')")} AS value
  FROM {out}_runs WHERE seg > 0 GROUP BY id, seg)"""


PARSED = f"""
WITH {TEXTS},
{_segments("said", "human|user|assistant|gpt|ai|人|用户|助手", "CASE WHEN max(k) IN ('human', 'user', '人', '用户') THEN 'human' ELSE 'gpt' END")},
{_segments("field", "instruction|input|output|指令|输入|输出", "CASE max(k) WHEN '指令' THEN 'instruction' WHEN '输入' THEN 'input' WHEN '输出' THEN 'output' ELSE max(k) END")},
spoken AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY id ORDER BY seg) THEN 0 ELSE 1 END AS new FROM said WHERE value <> ''),
islands AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY seg) - 1 AS ord FROM spoken),
turns AS (SELECT id, ord, min(kind) AS role, string_agg(value, chr(10) ORDER BY seg) AS value FROM islands GROUP BY id, ord),
fields AS (
  SELECT id, {", ".join(f"coalesce(arg_max(value, seg) FILTER (kind = '{f}'), '') AS {f}" for f in ("instruction", "input", "output"))} FROM field GROUP BY id),
typed AS (
  SELECT id, CASE WHEN id IN (SELECT id FROM turns) THEN 'conversation' WHEN id IN (SELECT id FROM fields) THEN 'alpaca' ELSE 'plain' END AS type, {strip("text")} AS plain FROM texts)
"""

#: score and classes of the dirty reports, from the same case distinctions as the query's input
K = "(doc_id * 37 % 101)"
DIRTY = f"""
WITH d AS (
  SELECT doc_id, doc_id % 14 AS v, doc_id % 5 = 0 AND doc_id % 14 < 12 AS stored,
         CASE WHEN doc_id % 14 <= 5 THEN ({K} // 10 || '.' || {K} % 10)::double WHEN doc_id % 14 = 6 THEN ({K} // 10)::double END AS x FROM documents),
classes AS (
  SELECT doc_id, v,
         CASE WHEN v IN (8, 9, 10, 12, 13) THEN 'skipped' WHEN v = 11 THEN 'kept' WHEN v = 7 OR x < 5 THEN 'low' ELSE 'kept' END AS convert_class,
         CASE WHEN v = 13 THEN 'dropped' WHEN v IN (7, 8, 9, 10, 12) THEN 'invalid' WHEN v = 11 OR x < 5 THEN 'failed' ELSE 'passed' END AS view_class,
         v <> 13 AND (stored OR coalesce(x >= 5, false)) AS web_passed FROM d),
dimrows AS (
  SELECT doc_id, 'safety' AS dim, (doc_id * 13 % 41) / 4.0::double AS score, (doc_id * 13 % 41) / 4.0::double AS loose, 0 AS pos FROM d WHERE v < 12
  UNION ALL SELECT doc_id, 'accuracy', CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 11)::double END, CASE WHEN doc_id % 7 = 0 THEN 1.0::double ELSE (doc_id % 11)::double END, 1 FROM d WHERE v < 12
  UNION ALL SELECT doc_id, 'diversity', (doc_id * 29 % 1001) / 10.0::double, (doc_id * 29 % 1001) / 10.0::double, 2 FROM d WHERE v < 12
  UNION ALL SELECT doc_id, 'format', (doc_id * 17 % 400) / 8.0::double - 25, (doc_id * 17 % 400) / 8.0::double - 25, 3 FROM d WHERE v < 12
  UNION ALL SELECT doc_id, 'style', CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id * 5 % 41) / 4.0::double END, NULL, 4 FROM d WHERE v < 12),
dimtable AS (
  SELECT s.dim, s.label, s.std, sum(score) / nullif(count(score), 0) AS average, count(score) AS n, count(*) FILTER (score < 4) AS low, count(*) FILTER (score >= 4 AND score < 7) AS middle, count(*) FILTER (score >= 7) AS high
  FROM (VALUES ('safety', '安全性', 0), ('accuracy', '准确性', 1), ('diversity', '多样性', 2), ('format', '格式', 3), ('style', 'style', 4)) s(dim, label, std)
  LEFT JOIN dimrows USING (dim) GROUP BY ALL HAVING s.std < 4 OR count(score) > 0),
flat AS (
  SELECT doc_id, r.r AS round, 'safety' AS dim, 'm' || m.m AS model, ((doc_id * (r.r + 2) + m.m * 7) % 41) / 4.0::double AS score
  FROM d, (VALUES (1), (2)) r(r), (VALUES (0), (1), (2)) m(m) WHERE v <> 13 AND (doc_id + r.r + m.m) % 5 <> 0 AND (doc_id + m.m) % 17 <> 0)
"""

FILES = """
f AS (SELECT doc_id, doc_id % 14 AS v, CASE doc_id % 3 WHEN 0 THEN 'lines-' || doc_id // 30 || '.jsonl' WHEN 1 THEN 'array-' || doc_id // 30 || '.json' ELSE 'one-' || doc_id || '.json' END AS file FROM documents)
"""

REASON_W = f"regexp_replace(%s, '{W}+', ' ', 'g')"
_NAMED = rf"regexp_extract(raw, '(?s)精炼理由[:：]{W}*(.+?)(?:完整分析|分数[:：]|\[\[|\z)', 1)"
_BEFORE = rf"CASE WHEN regexp_matches(raw, '{TAG}') THEN regexp_extract(raw, '(?s)\A(.*?){TAG}', 1) ELSE raw END"
_SHORT = "CASE WHEN length({0}) > 100 THEN substr({0}, 1, 100) || '…' ELSE {0} END"

ORACLES: dict[str, str] = {
    "src_lines": f"""WITH l AS (SELECT doc_id, list_filter(list_transform({lines("text")}, lambda x: {strip("x")}), lambda x: x <> '') AS l FROM documents),
        u AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1)::int AS item FROM l)
        SELECT doc_id, item, CASE WHEN item < 10000 THEN lpad(item::varchar, 4, '0') ELSE item::varchar END AS tag, md5(line) AS line_md5 FROM u""",
    "src_whole_doc": f"SELECT doc_id, length(t)::int AS text_length, md5(t) AS text_md5 FROM (SELECT doc_id, {strip('text')} AS t FROM documents) WHERE t <> ''",
    "text_strip": f"SELECT doc_id, md5({strip('text')}) AS text_md5 FROM documents",
    "text_lines": f"""WITH l AS (SELECT doc_id, {lines("(text || chr(11) || 'vt' || chr(8232) || 'ls' || chr(13) || chr(10) || 'crlf' || chr(133) || 'nel' || chr(10))")} AS l FROM documents),
        u AS (SELECT doc_id, unnest(l) AS line, (generate_subscripts(l, 1) - 1)::int AS pos FROM l) SELECT doc_id, pos, md5(line) AS line_md5 FROM u""",
    "text_length": "SELECT doc_id, length(text)::int AS text_length FROM documents",
    "prompts_scan": "SELECT 'n' || item_id % 7 AS name, md5(arg_max(text, item_id)) AS template_md5 FROM benchmark GROUP BY 1",
    "prompts_missing_dims": f"WITH {rows('need', 'n, dim', list(enumerate(C.DIMENSIONS)))} SELECT dim FROM need WHERE n NOT IN (SELECT item_id % 3 FROM benchmark)",
    "task_grid": JUDGED + "SELECT doc_id, round, dim, model FROM answers",
    "prompt_render_r1": f"WITH {PROMPTS}, p AS (SELECT doc_id, pdim AS dim, replace(template, '{{text}}', text) AS p FROM documents, prompts) SELECT doc_id, dim, length(p)::int AS prompt_length, md5(p) AS prompt_md5 FROM p",
    "prompt_refine": JUDGED
    + f""", {PROMPTS}, told AS (
        SELECT doc_id, dim, string_agg('{C.REFINE_LINE[0]}' || model_label || '{C.REFINE_LINE[1]}' || coalesce(score::varchar, '{C.REFINE_NONE}') || '{C.REFINE_LINE[2]}' || substr(replace({strip("reason")}, chr(10), ' '), 1, {C.REFINE_REASON}), chr(10) ORDER BY model_ord) AS told
        FROM flagged WHERE round = 1 GROUP BY ALL),
      p AS (SELECT doc_id, dim, replace(template, '{{text}}', text) || chr(10) || chr(10) || '{C.REFINE_HEAD}' || chr(10) || told || chr(10) || chr(10) || '{C.REFINE_TAIL}' AS p FROM documents JOIN told USING (doc_id) JOIN prompts ON dim = pdim)
      SELECT doc_id, dim, length(p)::int AS prompt_length, md5(p) AS prompt_md5 FROM p""",
    "judge_replay": JUDGED + "SELECT doc_id, round, dim, model, raw, score, CASE WHEN raw IS NULL THEN 'no stored answer' ELSE error END AS error FROM flagged",
    "judge_errors": JUDGED + "SELECT dim, model, error, count(*) AS n, count(*) FILTER (reason = '') AS without_reason FROM flagged WHERE error IS NOT NULL GROUP BY ALL",
    "score_extract": JUDGED + "SELECT doc_id, round, dim, model, score FROM flagged",
    "reason_extract": rf"""WITH r AS (SELECT doc_id, CASE doc_id % 4
          WHEN 0 THEN '精炼理由：' || text || chr(10) || '完整分析：x' || chr(10) || '分数：[[8]]'
          WHEN 1 THEN text || ' [[7.5]] tail'
          WHEN 2 THEN '精炼理由: 。' || text || '。；分数：[[3]]'
          ELSE '精炼理由： 。[[4]]' || text END AS raw FROM documents),
        p AS (SELECT doc_id, trim({REASON_W % _NAMED}, ' 。.；;，,') AS named, {strip(REASON_W % ("(" + _BEFORE + ")"))} AS before FROM r)
        SELECT doc_id, CASE WHEN named <> '' THEN {_SHORT.format("named")} ELSE {_SHORT.format("before")} END AS reason FROM p""",
    "eval_dim_scores": JUDGED + "SELECT doc_id, dim, score FROM lasts",
    "eval_final": JUDGED + "SELECT * FROM finals",
    "eval_contributions": JUDGED + f"SELECT doc_id, label, score, round_even(w::double * 100, 0)::int AS percent, {round2('score * w::double')} AS part FROM lasts JOIN dims USING (dim)",
    "eval_round_trend": JUDGED + "SELECT doc_id, dim, r1, r2, r3 FROM trend",
    "eval_trend": JUDGED
    + """, l AS (SELECT doc_id, dim, list_filter([r1, r2, r3], lambda x: x IS NOT NULL) AS k FROM trend)
      SELECT doc_id, dim, CASE WHEN len(k) < 2 OR k[1] = k[-1] THEN '→' WHEN k[-1] > k[1] THEN '↑' ELSE '↓' END AS arrow FROM l""",
    "filter_passed": JUDGED + "SELECT doc_id, overall_score FROM finals WHERE overall_score >= 5",
    "parse_turns": PARSED + "SELECT id, ord::int AS ord, role, md5(value) AS value_md5 FROM turns",
    "parse_alpaca": PARSED + "SELECT id, md5(instruction) AS instruction_md5, md5(input) AS input_md5, md5(output) AS output_md5 FROM fields JOIN typed USING (id) WHERE type = 'alpaca'",
    "parse_type": PARSED + "SELECT id, type FROM typed",
    "convert_alpaca": PARSED
    + """, talk AS (SELECT id, list(value ORDER BY ord) FILTER (role = 'human') AS h, coalesce(string_agg(value, chr(10) ORDER BY ord) FILTER (role = 'gpt'), '') AS g FROM turns GROUP BY id)
      SELECT id, md5(CASE type WHEN 'conversation' THEN coalesce(h[1], '') WHEN 'alpaca' THEN instruction ELSE plain END) AS instruction_md5,
             md5(CASE type WHEN 'conversation' THEN coalesce(array_to_string(h[2:], chr(10)), '') WHEN 'alpaca' THEN input ELSE '' END) AS input_md5,
             md5(CASE type WHEN 'conversation' THEN g WHEN 'alpaca' THEN output ELSE '' END) AS output_md5
      FROM typed LEFT JOIN talk USING (id) LEFT JOIN fields USING (id)""",
    "convert_sharegpt": PARSED
    + """, asked AS (SELECT id, array_to_string(list_filter([instruction, input], lambda x: x <> ''), chr(10)) AS q, output FROM fields JOIN typed USING (id) WHERE type = 'alpaca')
      SELECT id, ord::int AS ord, role AS speaker, md5(value) AS value_md5 FROM turns
      UNION ALL SELECT id, 0, 'human', md5(q) FROM asked WHERE q <> ''
      UNION ALL SELECT id, CASE WHEN q <> '' THEN 1 ELSE 0 END, 'gpt', md5(output) FROM asked WHERE output <> ''
      UNION ALL SELECT id, 0, 'gpt', md5(plain) FROM typed WHERE type = 'plain'""",
    "convert_stats": DIRTY
    + """SELECT count(*) AS total, count(*) FILTER (convert_class = 'kept') AS kept, count(*) FILTER (convert_class = 'low') AS low, count(*) FILTER (convert_class = 'skipped') AS skipped,
             count(*) FILTER (convert_class = 'kept' AND doc_id % 2 = 1) AS plain FROM classes""",
    "report_nested": JUDGED
    + """SELECT doc_id, length(text)::int AS text_length, overall_score, conclusion, f.format AS format_score, 3 AS third_round,
             (SELECT score FROM flagged g WHERE g.doc_id = f.doc_id AND g.round = 1 AND g.dim_ord = 0 AND g.model_ord = 0) AS first_score,
             (SELECT r2 FROM trend t WHERE t.doc_id = f.doc_id AND t.dim = 'diversity') AS second_diversity,
             (SELECT count(*)::int FROM flagged g WHERE g.doc_id = f.doc_id AND g.error IS NOT NULL) AS n_errors,
             (SELECT count(*)::int FROM flagged g WHERE g.doc_id = f.doc_id AND g.error IS NOT NULL) AS n_error_keys, md5(text) AS text_md5
      FROM finals f JOIN documents USING (doc_id)""",
    "reports_merge": JUDGED + "SELECT doc_id AS ord, overall_score, CASE WHEN overall_score >= 5 THEN 0 WHEN overall_score < 5 THEN 1 ELSE 2 END AS part FROM finals",
    "reports_flatten": DIRTY + "SELECT doc_id, round, dim, model, score FROM flat",
    "reports_scan_strict": f"WITH {FILES} SELECT file, CASE WHEN file LIKE 'one-%' AND max(v) = 13 THEN 2 ELSE count(*) END AS n FROM f GROUP BY file",
    "reports_scan_objects": f"WITH {FILES} SELECT file, count(*) AS n FROM f WHERE v <> 13 GROUP BY file",
    "reports_scan_lenient": f"WITH {FILES} SELECT file, CASE WHEN file LIKE 'one-%' AND max(v) = 13 THEN 2 ELSE count(*) END AS n FROM f GROUP BY file",
    "reports_scan_scores": DIRTY
    + """SELECT convert_class, view_class, count(*) AS n, count(*) FILTER (c.v = 11) AS nan, round(sum(CASE WHEN c.v = 7 THEN 1.0::double WHEN c.v < 7 THEN x END), 6) AS total,
             sum(length(coalesce(text, '')) + CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 0 END)::bigint AS chars
      FROM classes c JOIN d USING (doc_id) JOIN documents USING (doc_id) WHERE c.v <> 13 GROUP BY ALL""",
    "jsonl_preview": """WITH n AS (SELECT 'lines-' || doc_id // 30 || '.jsonl' AS file, count(*) AS k FROM documents GROUP BY 1)
        SELECT file, least(k, 4) AS n_values, 2 AS n_raw, (1 + 2 * least(k, 4))::int AS last_pos FROM n""",
    "viz_summary": DIRTY
    + """SELECT count(*) AS total, count(*) FILTER (view_class = 'passed') AS passed, count(*) FILTER (view_class = 'failed') AS failed, count(*) FILTER (view_class = 'invalid') AS invalid,
             100.0::double * count(*) FILTER (view_class = 'passed') / count(*) AS passed_percent, 100.0::double * count(*) FILTER (view_class = 'failed') / count(*) AS failed_percent,
             100.0::double * count(*) FILTER (view_class = 'invalid') / count(*) AS invalid_percent FROM classes WHERE view_class <> 'dropped'""",
    "viz_dim_avg": DIRTY + "SELECT (row_number() OVER (ORDER BY std))::int AS place, label, round(average, 9) AS average, n FROM dimtable",
    "viz_dim_buckets": DIRTY + "SELECT dim, low, middle, high FROM dimtable",
    "viz_model_consistency": DIRTY
    + """, g AS (SELECT *, sum(score) OVER w AS t, count(*) OVER w AS k FROM flat WINDOW w AS (PARTITION BY doc_id, round, dim))
      SELECT model, count(*) AS n, round(sum(score) / count(*), 9) AS mean, round(coalesce(stddev_samp(score), 0), 9) AS std, round(avg(abs(score - (t - score) / nullif(k - 1, 0))), 9) AS mean_diff FROM g GROUP BY model""",
    "viz_bars": DIRTY + "SELECT dim, repeat('█', b) || repeat('·', 10 - b) AS bar FROM (SELECT dim, coalesce(round_even(least(10, greatest(0, average)), 0), 0)::int AS b FROM dimtable)",
    "web_summary": DIRTY
    + f"""SELECT total, passed, passed / total * 100 AS pass_rate, safety, accuracy, diversity, format
      FROM (SELECT count(*) AS total, count(*) FILTER (web_passed) AS passed FROM classes WHERE view_class <> 'dropped'),
           (SELECT {", ".join(f"{round2('a_' + x)} AS {x}" for x in C.DIMENSIONS)} FROM (SELECT {", ".join(f"sum(loose) FILTER (dim = '{x}') / count(loose) FILTER (dim = '{x}') AS a_{x}" for x in C.DIMENSIONS)} FROM dimrows))""",
    "pipeline_summary": DIRTY
    + """SELECT (SELECT count(*) FROM documents) AS total, count(*) FILTER (view_class = 'passed') AS passed, count(*) FILTER (view_class = 'failed') AS failed, count(*) FILTER (view_class = 'invalid') AS invalid FROM classes""",
    "history_topk": """SELECT (row_number() OVER (ORDER BY id DESC))::int AS place, id, page, substr(log, 1, 1500) AS log
        FROM (SELECT strftime(ts, '%Y%m%d_%H%M%S') || '_' || lpad(event_id::varchar, 9, '0') AS id, event_type AS page, repeat(props, 100) AS log FROM events) ORDER BY id DESC LIMIT 20""",
}

#: files of 500 documents each
_PARTS = "doc_id // 500"
ORACLES["corpus_files"] = f"""
WITH l AS (SELECT doc_id, {_PARTS} AS part, list_filter(list_transform({lines("text")}, lambda x: {strip("x")}), lambda x: x <> '') AS l FROM documents),
u AS (SELECT doc_id, part, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM l),
n AS (SELECT part, line, row_number() OVER (PARTITION BY part ORDER BY doc_id, i) AS item FROM u)
SELECT part, item, CASE WHEN item < 10000 THEN lpad(item::varchar, 4, '0') ELSE item::varchar END AS tag, md5(line) AS line_md5 FROM n"""
_KINDS = "(VALUES ('lines', '.jsonl'), ('array', '.json')) k(kind, suffix)"
ORACLES["report_files_strict"] = f"SELECT kind || '-' || {_PARTS} || suffix AS name, count(*) AS n, count(*) - 1 AS last FROM documents, {_KINDS} GROUP BY 1"
ORACLES["report_files_lenient"] = f"SELECT kind || '-' || {_PARTS} || suffix AS name, count(*) AS n FROM documents, {_KINDS} GROUP BY 1"
ORACLES["report_files_scores"] = (
    DIRTY
    + f"""SELECT kind, convert_class, view_class, count(*) AS n, round(sum(CASE WHEN c.v = 7 THEN 1.0::double WHEN c.v < 7 THEN x END), 6) AS total,
             sum(length(coalesce(text, '')) + CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 0 END)::bigint AS chars
      FROM classes c JOIN d USING (doc_id) JOIN documents USING (doc_id), {_KINDS} WHERE c.v <> 13 GROUP BY ALL"""
)

CURATED = r"""
WITH t AS (SELECT doc_id, text, source, lang, coalesce(text, '') AS x, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS form FROM documents),
b AS (
  SELECT *, list_filter([CASE WHEN NOT regexp_matches(x, '[\p{L}\p{N}]') THEN 'blank' END, CASE WHEN length(x) < 20 THEN 'short' END, CASE WHEN length(x) > 100000 THEN 'long' END,
    CASE WHEN 2 * length(regexp_replace(x, '[^\p{L}]', '', 'g')) < length(x) THEN 'letters' END, CASE WHEN contains(x, chr(65533)) THEN 'undecoded' END,
    CASE WHEN regexp_matches(x, '\{\{|\}\}|\[\[|\]\]') THEN 'template' END], lambda r: r IS NOT NULL) AS violations FROM t),
f AS (SELECT form, count(*) AS n, arg_min(doc_id, (-length(text), doc_id)) AS of FROM b WHERE len(violations) = 0 AND form <> '' GROUP BY form),
m AS (
  SELECT b.*, CASE WHEN len(violations) = 0 AND n > 1 AND doc_id <> of THEN of END AS of FROM b LEFT JOIN f USING (form)),
k AS (SELECT *, len(violations) = 0 AND of IS NULL AS kept FROM m)
"""
ORACLES["curate_ledger"] = CURATED + "SELECT doc_id, unnest(violations) AS rule, NULL::bigint AS of FROM k UNION ALL SELECT doc_id, 'duplicate', of FROM k WHERE of IS NOT NULL"
ORACLES["curate_kept"] = CURATED + "SELECT doc_id, md5(text) AS text_md5 FROM k WHERE kept"
ORACLES["curate_card"] = (
    CURATED
    + """SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'all' END AS section, coalesce(source, lang) AS value, count(*) AS rows, count(*) FILTER (kept) AS kept,
             count(*) FILTER (len(violations) > 0) AS broken, count(of) AS duplicates, coalesce(sum(length(text)) FILTER (kept), 0)::bigint AS chars FROM k GROUP BY GROUPING SETS ((), (source), (lang))"""
)
_ASKS = rows("asks", "paradigm, ask", list(G.ASKS.items()))
_WRITERS = rows("writers", "model", [(m,) for m in G.MODELS])
ORACLES["generation_plan"] = f"""
WITH {_ASKS}, {_WRITERS},
l AS (SELECT *, doc_id || '/' || paradigm || '/' || model || '/1' AS lineage FROM documents, asks, writers WHERE trim(text) <> '')
SELECT lineage, generation, CASE WHEN generation > 1 THEN lineage || '#' || (generation - 1) END AS parent, doc_id AS seed, paradigm, model,
       CASE WHEN generation = 1 THEN md5(replace(ask, '{{text}}', text)) END AS prompt_md5 FROM l, (VALUES (1), (2)) g(generation)"""
COMPARED = (
    JUDGED
    + """, made AS (SELECT doc_id, coalesce(source, '-') AS generator, doc_id // 20 AS seed FROM documents),
s AS (SELECT made.*, model AS judge, score FROM judged JOIN made USING (doc_id) WHERE round = 1 AND score IS NOT NULL),
cells AS (SELECT generator, judge, count(*) AS n, sum(score) / count(*) AS mean FROM s GROUP BY ALL),
matrix AS (SELECT *, (rank() OVER (PARTITION BY judge ORDER BY mean DESC))::int AS place FROM cells)
"""
)
ORACLES["compare_matrix"] = COMPARED + "SELECT * FROM matrix"
ORACLES["compare_agreement"] = (
    COMPARED
    + """, r AS (SELECT *, place + (count(*) OVER (PARTITION BY judge, mean) - 1) / 2 AS r FROM matrix)
SELECT a.judge AS judge_a, b.judge AS judge_b, count(*) AS n, round(corr(a.r, b.r), 9) AS correlation FROM r a JOIN r b USING (generator) WHERE a.judge < b.judge GROUP BY ALL"""
)
ORACLES["compare_wins"] = (
    COMPARED
    + """, one AS (SELECT seed, judge, generator, sum(score) / count(*) AS mean FROM s GROUP BY ALL)
SELECT x.generator AS a, y.generator AS b, count(*) AS games, sum(CASE WHEN x.mean > y.mean THEN 1.0::double WHEN x.mean < y.mean THEN 0.0 ELSE 0.5 END) AS points
FROM one x JOIN one y ON x.seed = y.seed AND x.judge = y.judge AND x.generator < y.generator GROUP BY ALL"""
)
