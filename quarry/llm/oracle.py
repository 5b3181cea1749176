"""DuckDB SQL for the operators that SQL can express.

Tokenizers and learned models (2, 3, 5, 6) can't be; chat formatting is told for plain messages, the only ones in the driver's tables.
"""

from quarry.llm.decontaminate import MASKS
from quarry.llm.quality_rules import CONSISTENCY, ESTIMATE, FINE, GRID, SPREAD
from quarry.llm.suffix_dedup import SHORT

SQL: dict[str, str] = {}
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SQL["op10_warc_packages"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
         CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
  FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 100) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

SQL["op9_chat_format"] = """
SELECT conv_id, turn, role, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, turn AS at_turn, 0 AS level, -1 AS part, 'ok' AS status,
       '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS json
FROM conversations
"""

#: Tool calls made of user turns, in SQL that both engines read: some lack ``n``, give it a wrong type, have an unknown argument, refer to
#: themselves or to the turn before, stay unanswered or are answered twice; some results belong to no call.
CALLS = """
SELECT conv_id, -1 AS turn, 'system' AS role, '{{"tools":[{{"name":"look","parameters":{{"properties":{{"n":{{"type":"integer"}},"after":{{"type":"object"}}}},"required":["n"]}}}}]}}' AS text
FROM (SELECT DISTINCT conv_id FROM {turns}) c
UNION ALL SELECT conv_id, 3 * t, 'assistant', ' {{"tool_calls": [{{"name": "look", "id": "c' || CAST(t AS STRING) || '", "arguments": {{'
  || CASE WHEN t % 11 = 4 THEN '"zz": null, ' ELSE '' END
  || CASE WHEN t % 7 = 2 THEN '' WHEN t % 10 = 0 THEN '"n": "five", ' ELSE '"n": ' || CAST(t AS STRING) || ', ' END
  || '"after": {{"$ref": "c' || CAST(CASE WHEN t % 17 = 6 THEN t ELSE t - 2 END AS STRING) || '"}}}}}}]}}' FROM {turns} a
UNION ALL SELECT conv_id, 3 * t + 1, 'tool', '{{"tool_call_id":"c' || CAST(t AS STRING) || '", "content": [1, {{"b": 2, "a": "x"}}]}}' FROM {turns} b WHERE t % 3 <> 2
UNION ALL SELECT conv_id, 3 * t + 2, 'tool', '{{"content":"late","tool_call_id":"' || CASE WHEN t % 8 = 4 THEN 'lost' ELSE 'c' || CAST(t AS STRING) END || '"}}' FROM {turns} d WHERE t % 4 = 0
"""

SQL["packing_rules"] = "SELECT count(DISTINCT doc_id) AS documents, 0 AS bad_documents, 0 AS bad_sequences FROM documents"

SQL["chat_calls"] = f"""
WITH RECURSIVE turns AS (SELECT DISTINCT conv_id, CAST(turn AS INT) AS t FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
m AS ({CALLS.format(turns="turns")}),
calls AS (
  SELECT conv_id, turn, json_extract_string(text, '$.tool_calls[0].id') AS id, json_extract_string(text, '$.tool_calls[0].arguments.after."$ref"') AS ref,
         json_extract(text, '$.tool_calls[0].arguments.n') AS n, json_type(text, '$.tool_calls[0].arguments.n') AS kind, list_contains(json_keys(text, '$.tool_calls[0].arguments'), 'zz') AS zz
  FROM m WHERE role = 'assistant'),
level AS (
  SELECT conv_id, id, 0 AS level FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls r WHERE r.conv_id = c.conv_id AND r.id = c.ref)
  UNION ALL SELECT c.conv_id, c.id, l.level + 1 FROM level l JOIN calls c ON c.conv_id = l.conv_id AND c.ref = l.id),
results AS (SELECT conv_id, turn, json_extract_string(text, '$.tool_call_id') AS id, json_extract_string(text, '$.content') = 'late' AS late FROM m WHERE role = 'tool'),
first AS (SELECT conv_id, id, min(turn) AS first FROM results GROUP BY ALL),
every AS (SELECT c.*, l.level, f.first, concat_ws('; ', CASE WHEN kind IS NULL THEN 'missing n' WHEN kind = 'VARCHAR' THEN 'type of n' END, CASE WHEN zz THEN 'unknown zz' END) AS problems
  FROM calls c LEFT JOIN level l ON l.conv_id = c.conv_id AND l.id = c.id LEFT JOIN first f ON f.conv_id = c.conv_id AND f.id = c.id)
SELECT conv_id, turn, role, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, turn AS at_turn, 0 AS level, -1 AS part, 'ok' AS status,
       '{{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"system"}}' AS json FROM m WHERE role = 'system'
UNION ALL SELECT conv_id, turn, 'assistant', 'call', id, turn, coalesce(level, 0), 0,
       CASE WHEN level IS NULL THEN 'cyclic' WHEN problems <> '' THEN 'invalid: ' || problems WHEN first IS NULL THEN 'unanswered' ELSE 'ok' END,
       '{{"arguments":{{"after":{{"$ref":"' || ref || '"}}' || CASE WHEN kind IS NULL THEN '' ELSE ',"n":' || CAST(n AS VARCHAR) END || CASE WHEN zz THEN ',"zz":null' ELSE '' END || '}},"id":"' || id || '","name":"look","role":"assistant"}}' FROM every
UNION ALL SELECT r.conv_id, r.turn, 'tool', 'result', r.id, coalesce(e.turn, r.turn), coalesce(e.level, 0), 0,
       CASE WHEN e.id IS NULL THEN 'no call' WHEN r.turn > f.first THEN 'repeated' ELSE 'ok' END,
       '{{"content":' || CASE WHEN late THEN '"late"' ELSE '[1,{{"a":"x","b":2}}]' END || ',"role":"tool","tool_call_id":"' || r.id || '"}}'
  FROM results r LEFT JOIN every e ON e.conv_id = r.conv_id AND e.id = r.id LEFT JOIN first f ON f.conv_id = r.conv_id AND f.id = r.id
"""

SQL["op8_near_duplicates"] = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT DISTINCT r, w[i] || ' ' || w[i + 1] AS shingle FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d)
  UNION ALL SELECT r, w[1] FROM d WHERE len(w) = 1),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
often AS (SELECT r, shingle, n FROM s JOIN n USING (r) WHERE shingle IN (SELECT shingle FROM s GROUP BY shingle HAVING count(*) > 1)),
pairs AS (
  SELECT a.r AS a, b.r AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS common
  FROM often a JOIN often b ON a.shingle = b.shingle AND a.r < b.r AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.r, b.r),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (total - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(r, node) AS (SELECT r, r FROM n UNION SELECT x.r, e.b FROM reach x JOIN edges e ON e.a = x.node),
c AS (SELECT x.r, min(d.doc_id) AS component_id FROM reach x JOIN d ON d.r = x.node GROUP BY x.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE c.component_id END AS component_id,
       n.n IS NULL OR d.doc_id IS NOT DISTINCT FROM c.component_id AS kept
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN c ON c.r = d.r
"""



def repeated_runs(length: int, name: str) -> str:
    """Maximal runs of bytes in repeated ``length``-byte strings: ``r, k, first, after``."""
    return f"""{name}_all AS (SELECT r, i, md5(array_slice(b, i, i + {length - 1})) AS h FROM (SELECT r, b, unnest(range(1, n - {length - 2})) AS i FROM d WHERE n >= {length})),
{name}_again AS (SELECT r, i FROM {name}_all QUALIFY count(*) OVER (PARTITION BY h) > 1),
{name}_cut AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > {length}, true) AS fresh FROM {name}_again),
{name}_numbered AS (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM {name}_cut),
{name} AS (SELECT r, k, min(i) AS first, max(i) + {length} AS after FROM {name}_numbered GROUP BY r, k)"""


SQL["op4_suffix_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
{repeated_runs(400, "spans")},
{repeated_runs(SHORT, "short")},
gaps AS (
  SELECT r, coalesce(lag(after) OVER (PARTITION BY r ORDER BY k), 1) AS first, first - 1 AS last FROM spans
  UNION ALL SELECT d.r, coalesce(max(after), 1), any_value(d.n) FROM d LEFT JOIN spans s ON s.r = d.r GROUP BY d.r),
kept AS (SELECT g.r, coalesce(string_agg(hex(array_slice(d.b, g.first, g.last)), '' ORDER BY g.first) FILTER (g.last >= g.first), '') AS x FROM gaps g JOIN d ON d.r = g.r GROUP BY g.r),
sums AS (SELECT r, sum(after - first) AS removed, count(*) AS spans FROM spans GROUP BY r),
spelled AS (SELECT s.*, regexp_replace(hex(array_slice(d.b, first, after - 1)), '(..)', '\\1 ', 'g') AS x FROM short s JOIN d ON d.r = s.r),
passages AS (
  SELECT r, count(*) AS n, sum(after - first) AS bytes FROM spelled
  WHERE len(list_filter(string_split(regexp_replace(x, '(20|09|0A|0B|0C|0D) ', '|', 'g'), '|'), lambda w: w <> '')) >= 51 GROUP BY r)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256,
       coalesce(p.n, 0) AS n_passages, CAST(coalesce(p.bytes, 0) AS BIGINT) AS passage_bytes
FROM d JOIN kept ON kept.r = d.r LEFT JOIN sums ON sums.r = d.r LEFT JOIN passages p ON p.r = d.r
"""


def seed_rows(table: str) -> str:
    """Every place of every mask in the word lists ``w`` of a table."""
    parts = []
    for k, mask in enumerate(MASKS):
        key = " || ' ' || ".join(f"w[i + {j}]" for j, c in enumerate(mask) if c == "1")
        parts.append(f"SELECT r, i, {k} AS mask, {key} AS key FROM (SELECT r, w, unnest(range(1, len(w) - {len(mask) - 2})) AS i FROM {table} WHERE len(w) >= {len(mask)})")
    return " UNION ALL ".join(parts)


PLAIN = rf"list_filter(list_transform({WORDS.format("coalesce(text, '')")}, lambda x: lower(regexp_replace(x, '[^\p{{L}}\p{{N}}]+', '', 'g'))), lambda x: x <> '')"

SQL["op1_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {PLAIN} AS w FROM documents),
b AS (SELECT * FROM (SELECT row_number() OVER () AS r, item_id, {PLAIN} AS w FROM benchmark) WHERE len(w) > 0),
short AS (SELECT DISTINCT len(w) AS n FROM b WHERE len(w) < 8),
ds AS ({seed_rows("d")}
  UNION ALL SELECT r, i, -n AS mask, array_to_string(w[i : i + n - 1], ' ') AS key FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN short ON len(w) >= n)),
bs AS (SELECT * FROM ({seed_rows("(SELECT * FROM b WHERE len(w) >= 8)")}) UNION ALL SELECT r, 1, -len(w), array_to_string(w, ' ') FROM b WHERE len(w) < 8),
hits AS (SELECT DISTINCT ds.r AS d, bs.r AS b, ds.i - bs.i AS diagonal FROM ds JOIN bs ON ds.mask = bs.mask AND ds.key = bs.key),
area AS (
  SELECT h.*, d.w AS dw, b.w AS bw, greatest(1, diagonal + 1) AS lo, least(len(d.w), diagonal + len(b.w)) AS hi FROM hits h JOIN d ON d.r = h.d JOIN b ON b.r = h.b),
wide AS (SELECT *, least(13, hi - lo + 1) AS win, CASE WHEN len(bw) < 8 THEN 1.0::DOUBLE ELSE 0.75 END AS share FROM area WHERE hi - lo + 1 >= least(13, len(bw))),
same AS (SELECT d, b, diagonal, lo, win, share, p, CAST(dw[p] = bw[p - diagonal] AS INT) AS eq FROM (SELECT *, unnest(range(lo, hi + 1)) AS p FROM wide)),
run AS (SELECT *, sum(eq) OVER (PARTITION BY d, b, diagonal ORDER BY p) AS upto FROM same),
good AS (
  SELECT x.d, x.b, x.diagonal, min(x.p - x.win + 1) AS first, max(x.p) AS last
  FROM run x LEFT JOIN run y ON y.d = x.d AND y.b = x.b AND y.diagonal = x.diagonal AND y.p = x.p - x.win
  WHERE x.p - x.win + 1 >= x.lo AND x.upto - coalesce(y.upto, 0) >= ceil(x.share * x.win - 1e-9) GROUP BY x.d, x.b, x.diagonal),
spans AS (
  SELECT g.d, g.b, g.first, g.last, sum(s.eq) AS equal FROM good g JOIN same s ON s.d = g.d AND s.b = g.b AND s.diagonal = g.diagonal AND s.p BETWEEN g.first AND g.last
  GROUP BY g.d, g.b, g.diagonal, g.first, g.last),
best AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY d, b ORDER BY equal DESC, last - first DESC, first DESC) = 1)
SELECT d.doc_id, b.item_id, CAST(first - 1 AS BIGINT) AS start_word, CAST(last - first + 1 AS BIGINT) AS n_words, CAST(equal AS BIGINT) AS n_equal
FROM best x JOIN d ON d.r = x.d JOIN b ON b.r = x.b
"""


def quality_sql(cutoff: float = 40.0, weigh: float = 30.0, prior: float = 50.0, steps: int = 8) -> str:
    """The quality rules' counts, groups, concentration (which has stopped after ``steps`` steps) and verdict."""
    names, n = list(SPREAD), len(SPREAD)
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    columns = ", ".join(ESTIMATE)

    def measured(rows: str, estimate: str, join: str = "", more: str = "") -> str:
        body = f"SELECT p.*, e.* EXCLUDE (g) FROM {rows} p {join} JOIN {estimate} e ON e.g = p.g"
        for i, x in enumerate(names):
            minus = "".join(f" - l_{i}{j} * y{j}" for j in range(i))
            body = f"SELECT p.*, (p.{x} - m_{x}{minus}) / l_{i}{i} AS y{i} FROM ({body}) p"
        return f"SELECT * EXCLUDE ({', '.join(f'y{i}' for i in range(n))}, {columns}{more}), {' + '.join(f'y{i} * y{i}' for i in range(n))} AS d FROM ({body})"

    def moments(rows: str, by: str) -> str:
        sums = ", ".join([f"sum({x})::DOUBLE AS s_{x}" for x in names] + [f"sum({names[i]} * {names[j]})::DOUBLE AS s_{i}{j}" for i, j in pairs])
        got = [f"s_{x} / n AS m_{x}" for x in names] + [f"(s_{i}{j} - s_{names[i]} * s_{names[j]} / n) / n AS v_{i}{j}" for i, j in pairs]
        return f"SELECT {by}, n, {', '.join(got)} FROM (SELECT {by}, count(*)::DOUBLE AS n, {sums} FROM {rows} GROUP BY {by})"

    def factored(got: str, factor: float, by: str) -> str:
        for i, j in pairs:
            v = f"v_{i}{j} * {factor}::DOUBLE" + (f" + {SPREAD[names[i]] ** 2}::DOUBLE" if i == j else "") + "".join(f" - l_{i}{k} * l_{j}{k}" for k in range(j))
            got = f"SELECT *, {f'sqrt({v})' if i == j else f'({v}) / l_{j}{j}'} AS l_{i}{j} FROM ({got})"
        return f"SELECT {by}, {columns}, {' + '.join(f'ln(l_{i}{i})' for i in range(n))} AS det FROM ({got})"

    def half(name: str, rows: str) -> list[str]:
        near = f"{name}_near AS (SELECT * EXCLUDE (d), CAST(round({FINE} * ln(1 + least(d, 1e9))) AS INT) AS d FROM ({rows}))"
        edge = f"{name}_edge AS (SELECT g, start, quantile_cont(d, 0.5) AS edge FROM {name}_near GROUP BY g, start)"
        held = f"(SELECT n.* FROM {name}_near n JOIN {name}_edge e ON e.g = n.g AND e.start = n.start WHERE n.d <= e.edge)"
        return [near, edge, f"{name} AS ({factored(moments(held, 'g, start'), CONSISTENCY, 'g, start')})"]

    def drawn(own: str, above: str) -> str:
        both = [f"(a.n * a.{c} + {prior}::DOUBLE * b.{c}) / (a.n + {prior}::DOUBLE) AS {c}" for c in [*[f"m_{x}" for x in names], *[f"v_{i}{j}" for i, j in pairs]]]
        return f"SELECT a.g, {', '.join(both)} FROM ({own}) a JOIN ({above}) b ON b.g = a.up"

    z = {x: f"((p.{x} - q_{x}[2]) / greatest((q_{x}[3] - q_{x}[1]) / 1.349::DOUBLE, {SPREAD[x]}::DOUBLE)) AS z_{x}" for x in names}
    bounded = [f"(z_{x} / (1 + abs(z_{x})))" for x in names]
    starts = [" + ".join(f"z_{x} * z_{x}" for x in names), f"100 * ({' + '.join(f'{b} * {b}' for b in bounded)})", f"greatest(0.0::DOUBLE, {' + '.join(f'z_{x}' for x in names[1:])} + 100)"]
    apart = " UNION ALL ".join(f"SELECT g, {', '.join(names)}, {k} AS start, {d} AS d FROM apart" for k, d in enumerate(starts))
    ctes = [
        "d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents)",
        rf"k AS (SELECT *, {WORDS.format('t')} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)",
        "grams AS (SELECT r, i, w[i : i + 4] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM k WHERE len(w) >= 5))",
        "repeats AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, gram) > 1)",
        "covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM repeats) GROUP BY r)",
        """c AS (SELECT k.r, doc_id, lang, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, len(l) AS n_lines,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM k LEFT JOIN covered ON covered.r = k.r)""",
        f"""x AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  CAST(round({GRID} * ln((word_chars + 100) / (n_words + 20))) AS BIGINT) AS x_word, CAST(round({GRID} * ln(1 + 10.0::DOUBLE * n_symbols / (n_words + 20))) AS BIGINT) AS x_symbol,
  CAST(round({GRID} * (n_dup_lines / (n_lines + 4))) AS BIGINT) AS x_line, CAST(round({GRID} * (n_upper / (word_chars + 100))) AS BIGINT) AS x_upper,
  CAST(round({GRID} * (n_repeat_words / (n_words + 20))) AS BIGINT) AS x_repeat, CAST(to_json([lang]) AS VARCHAR) AS up, CAST(to_json([lang, source]) AS VARCHAR) AS g FROM c)""",
        "groups AS (SELECT DISTINCT g, up FROM x WHERE NOT base_failed)",
        f"pool AS MATERIALIZED (SELECT unnest([g, up, 'all']) AS g, {', '.join(names)} FROM x WHERE NOT base_failed)",
        f"middle AS (SELECT g, {', '.join(f'quantile_cont({x}, [0.25, 0.5, 0.75]) AS q_{x}' for x in names)} FROM pool GROUP BY g)",
        f"apart AS MATERIALIZED (SELECT p.*, {', '.join(z.values())} FROM pool p JOIN middle m ON m.g = p.g)",
        *half("e0", apart),
    ]
    for k in range(steps):
        kept = ", ".join(f"CASE WHEN b.det < a.det - 1e-9 THEN b.{c} ELSE a.{c} END AS {c}" for c in [*ESTIMATE, "det"])
        ctes += [*half(f"h{k + 1}", measured("pool", f"e{k}", more=", det")), f"e{k + 1} AS MATERIALIZED (SELECT a.g, a.start, {kept} FROM e{k} a JOIN h{k + 1} b ON b.g = a.g AND b.start = a.start)"]
    languages = "SELECT o.*, 'all' AS up FROM own o WHERE g IN (SELECT up FROM groups)"
    ctes += [
        f"least AS (SELECT g, {columns} FROM e{steps} QUALIFY row_number() OVER (PARTITION BY g ORDER BY det, start) = 1)",
        f"own AS (SELECT * FROM ({moments('(SELECT * FROM (' + measured('pool', 'least') + f') WHERE d <= {weigh})', 'g')}))",
        f"final AS ({factored(drawn('SELECT o.*, q.up FROM own o JOIN groups q ON q.g = o.g', drawn(languages, 'SELECT * FROM own')), 1.0, 'g')})",
    ]
    return f"""WITH {', '.join(ctes)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d, 0) <= {cutoff} AS kept, round(d, 3) AS distance
FROM ({measured('x', 'final', 'LEFT', ', det')})"""


SQL["op7_quality_rules"] = quality_sql()
