r"""DuckDB SQL for the opN queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op3_mixing"] = r"""
WITH base AS (
  SELECT doc_id, source, md5(coalesce(cast(doc_id AS varchar), '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size
  FROM documents),
src AS (SELECT source, sum(size)::bigint AS source_size FROM base GROUP BY source),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth FROM src),
weighed AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 5.0::double WHEN 1 THEN 2.0::double ELSE 1.0::double END AS w,
         source_size * 2.0::double AS cap FROM numbered),
levels AS (
  SELECT *, cap / w AS r, row_number() OVER o AS k,
         ((SELECT sum(source_size) FROM src) * 1.5::double
          - coalesce(sum(cap) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / w, nth)),
found AS (SELECT level AS lv FROM levels WHERE level <= r ORDER BY k LIMIT 1),
tgt AS (SELECT source, nth, source_size, least(cap, lv * w) AS target FROM levels, found),
queued AS (
  SELECT b.doc_id, b.size, b.h, t.nth, t.source_size, t.target,
         sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h, b.doc_id, b.size ROWS UNBOUNDED PRECEDING)::bigint AS cum
  FROM base b JOIN tgt t ON b.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT doc_id, h, nth, size, cum, turn, (turn * source_size + cum) / target AS f
  FROM queued, (VALUES (0), (1)) v(turn) WHERE target > 0 AND size > 0),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY f, nth, turn, cum, h, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM turns),
kept AS (
  SELECT nth, h, doc_id, size, cum, count(*) AS times FROM ordered
  WHERE used <= (SELECT floor(sum(size) * 1.5) FROM base) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (coalesce(k.times, 0) * q.size)::bigint AS taken
FROM queued q LEFT JOIN kept k
  ON q.nth = k.nth AND q.h = k.h AND q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.size = k.size AND q.cum = k.cum
"""

#: base 32 of a SHA-1: eight groups of 20 bits
_BASE32 = "translate(" + " || ".join(f"substr(alphabet, (v{i} >> {b})::int % 32 + 1, 1)" for i in range(8) for b in (15, 10, 5, 0)) + ", '', '')"
_GROUPS = ", ".join(f"('0x' || substr(sha, {5 * i + 1}, 5))::bigint AS v{i}" for i in range(8))

ORACLES["op2_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT *, {_GROUPS}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS alphabet, max(page_id) OVER (PARTITION BY sha) AS top FROM p)
SELECT page_id, octet_length(encode(payload))::bigint AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""

ORACLES["op7_line_dedup"] = """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
boiler AS (
  SELECT line FROM (SELECT source, unnest(lines) AS line FROM d WHERE source IS NOT NULL)
  WHERE length(trim(line)) >= 1 GROUP BY line HAVING count(DISTINCT source) >= 5),
all_lines AS (SELECT list(line) AS gone FROM boiler),
k AS (SELECT doc_id, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(gone, x), false)) AS kept FROM d, all_lines)
SELECT doc_id, coalesce(len(lines), 0)::bigint AS n_lines, coalesce(len(lines) - len(kept), 0)::bigint AS n_removed,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM k
"""

#: words of ASCII letters, digits and whatever lies beyond ASCII, A-Z lower-cased
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op6_decontamination"] = rf"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
items AS (SELECT item_id, w, least(13, len(w)) AS k FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT k FROM items),
placed AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
met AS (SELECT r, k, i, item_id FROM placed JOIN win USING (k, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM met) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT r, item_id::varchar AS x FROM met) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(x, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""

ORACLES["op10_substring_dedup"] = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS did, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
placed AS (SELECT r, did, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT r, did, w, unnest(range(1, len(w) - 18)) AS i FROM dw WHERE len(w) >= 20)),
firsts AS (SELECT g, min((did, i)) AS f FROM placed GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS p FROM placed JOIN firsts USING (g) WHERE f < (did, i)),
cut AS (SELECT r, list(p) AS p FROM gone GROUP BY r),
kept AS (SELECT doc_id, w, coalesce(len(p), 0) AS n_removed, list_filter(w, lambda x, i: NOT coalesce(list_contains(p, i), false)) AS k FROM dw LEFT JOIN cut USING (r))
SELECT doc_id, len(w)::bigint AS n_words, n_removed::bigint AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""

ORACLES["op1_ngram_jaccard_join"] = rf"""
WITH RECURSIVE dw AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
grams AS (SELECT DISTINCT r, md5(array_to_string(w[i:i + k - 1], ' ')) AS g FROM (SELECT r, w, least(4, len(w)) AS k, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM dw WHERE len(w) > 0)),
sets AS (SELECT r, count(*) AS n, md5(string_agg(g, '' ORDER BY g)) AS s FROM grams GROUP BY r),
classes AS (SELECT s, min(r) AS r, min(n) AS n FROM sets GROUP BY s),
own AS (SELECT s, g FROM grams JOIN classes USING (r)),
shared AS (SELECT a.s AS a, b.s AS b, count(*) AS c FROM own a JOIN own b ON a.g = b.g AND a.s < b.s GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN classes x ON x.s = a JOIN classes y ON y.s = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(s, t) AS (SELECT s, s FROM classes UNION SELECT reach.s, b FROM reach JOIN both_ways ON t = a),
least_of AS (SELECT s, min(doc_id) AS d FROM sets JOIN dw USING (r) GROUP BY s),
comp AS (SELECT reach.s, min(d) AS component_id FROM reach JOIN least_of ON least_of.s = t GROUP BY reach.s),
counted AS (SELECT a AS s, count(*) AS links FROM both_ways GROUP BY a)
SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(links, 0)::bigint AS links
FROM dw LEFT JOIN sets USING (r) LEFT JOIN comp USING (s) LEFT JOIN counted USING (s)
"""


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Every distance of every round, then the nearest entry by distance and index."""
    ctes = [f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::double))) = 0)""",
        f"""pieces AS (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) t(p))""",
        f"""book0 AS (SELECT p, e, v AS c FROM pieces JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept) USING (r) WHERE e < {entries})"""]
    met = "SELECT r, pieces.p AS p, min((list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, e)) AS b, any_value(v) AS v FROM pieces JOIN {book} USING (p) GROUP BY r, pieces.p"
    field = "b[1]" if False else "struct_extract(b, 1)"
    for i in range(rounds):
        ctes.append(f"near{i} AS ({met.format(book=f'book{i}')})")
        ctes.append(f"""mean{i} AS (SELECT p, e, list(s ORDER BY i) AS c FROM (
  SELECT p, struct_extract(b, 2) AS e, i, (sum(v[i])::hugeint - ((sum(v[i])::hugeint % count(*)) + count(*)) % count(*)) // count(*) AS s
  FROM near{i}, range(1, (SELECT max(len(v)) + 1 FROM pieces)) t(i) GROUP BY p, struct_extract(b, 2), i) GROUP BY p, e)""")
        ctes.append(f"book{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(list_transform(m.c, lambda x: x::bigint), o.c) AS c FROM book{i} o LEFT JOIN mean{i} m USING (p, e))")
    ctes.append(f"last AS ({met.format(book=f'book{rounds}')})")
    ctes.append(f"codes AS (SELECT r, string_agg(printf('%02x', struct_extract(b, 2)::int), '' ORDER BY p) AS code, sum({field})::bigint AS error FROM last GROUP BY r)")
    ctes.append(f"sha AS (SELECT sha256(coalesce(string_agg(x::varchar, ',' ORDER BY p, e, i), '')) AS h FROM (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM book{rounds}))")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, h AS codebooks_sha256 FROM kept JOIN codes USING (r), sha"


ORACLES["op13_vector_codes"] = _vector_codes()


def _conversation_repair() -> str:
    """Conversations from their last row to the first: the cheapest (cost, audit, lines) from each state of the pattern."""
    crc = "list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({s}, ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::bigint[]), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))"
    one = lambda c: f"coalesce({c}::varchar, ' ')"
    joined = one("conv_id") + " || ':' || " + one("turn")
    best = lambda letter, cost, state, line=None: f"""{{'c': v{state}.c + {cost}, 'a': '{letter}' || v{state}.a, 't': {f"list_prepend({line}, v{state}.t)" if line else f"v{state}.t"}}}"""
    fill = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    least = []
    for q in range(4):
        to, who = fill[q]
        own = [best("D", 3, q)]
        own += [f"CASE WHEN NOT must AND sign = '{s}' THEN {best('K', 'late', t, 'line')} END" for (p, s), t in step.items() if p == q]
        own.append(f"CASE WHEN NOT must THEN {best('R', '2 + late', to, chr(39) + who + ':' + chr(39) + ' || text')} END")
        least.append(f"least({', '.join(own)}) AS w{q}")
    add = lambda v, who: f"{{'c': {v}.c + 2, 'a': 'I' || {v}.a, 't': list_prepend('{who}:', {v}.t)}}"
    u, a = f"least(w2, {add('w3', 'assistant')})", f"least(w3, {add('w2', 'user')})"
    end = "{{'c': {c}::bigint, 'a': '{a}', 't': {t}::varchar[]}}"
    ends = [end.format(c=0, a="", t="[]"), end.format(c=4, a="II", t="['user:', 'assistant:']"), end.format(c=2, a="I", t="['assistant:']"), end.format(c=0, a="", t="[]")]
    return f"""
WITH RECURSIVE hashed AS (SELECT conv_id, turn, {one('role')} AS role, {one('text')} AS text, xor({crc.format(s=joined)}, 4294967295) % 20 AS h FROM conversations),
hurt AS (SELECT coalesce(conv_id::varchar, ' ') AS conv, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM hashed, range(2) t(i) WHERE h <> 0 AND (i = 0 OR h = 3)),
numbered AS (SELECT *, left(role, 1) AS sign, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv) AS rows,
  lag(left(role, 1)) OVER w AS ahead, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1, 's') AS last FROM hurt WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text))),
faults AS (SELECT *, last = '' AS blank, last <> '' AND nth > 1 AS again, last <> '' AND nth = 1 AND last NOT IN ('.', '!', '?') AS cut, i > 1 AND ahead || sign NOT IN ('su', 'ua', 'au') AS bad FROM (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS nth FROM numbered)),
plain AS (SELECT conv, i, rows, sign, text, role || ':' || text AS line, blank OR again AS must, cut::int AS late FROM faults),
walk(conv, i, v0, v1, v2, v3) AS (
  SELECT DISTINCT conv, rows + 1, {', '.join(ends)} FROM plain
  UNION ALL
  SELECT conv, i, least(w0, {{'c': u.c + 2, 'a': 'I' || u.a, 't': list_prepend('user:', u.t)}}), least(w1, {{'c': u.c + 2, 'a': 'I' || u.a, 't': list_prepend('user:', u.t)}}), u, a
  FROM (SELECT conv, i, w0, w1, {u} AS u, {a} AS a FROM (SELECT p.conv, p.i, {', '.join(least)} FROM walk JOIN plain p ON p.conv = walk.conv AND p.i = walk.i - 1))),
counted AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::int) AS blank, sum(again::int) AS duplicate, sum(cut::int) AS truncated, sum(bad::int) AS illegal FROM faults GROUP BY conv),
done AS (SELECT conv, v0.c AS cost, v0.a AS audit, sha256(array_to_string(v0.t, chr(10))) AS h FROM walk WHERE i = 1)
SELECT conv_id, {', '.join(f"coalesce({c}, 0)::bigint AS {c}" for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal', 'cost'))}, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::varchar, ' ') AS conv FROM conversations) LEFT JOIN counted USING (conv) LEFT JOIN done USING (conv)
"""


ORACLES["op12_conversation_repair"] = _conversation_repair()
