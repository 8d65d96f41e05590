"""DuckDB SQL of the block programs and of what reaches their uses, from the line items rather than from the text."""

from __future__ import annotations

from tidemark.plans.sql_fixtures import cte

cte("block_lines", (), """
  SELECT *, CAST((ord - 1) % 4 AS INT) AS nth, (ord - 1) // 4 AS block, ((ord - 1) // 4 + id) % 4 AS kind,
         noted AND id % 3 < 2 AS has_note
  FROM (SELECT l_orderkey AS id, row_number() OVER w AS ord, 'q' || CAST(l_partkey % 3 AS VARCHAR) AS target,
               coalesce('q' || CAST(lag(l_partkey) OVER w % 3 AS VARCHAR), 'base') AS operand,
               CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS factor, CAST(l_suppkey AS VARCHAR) AS note,
               l_returnflag = 'A' AS noted, lead(l_partkey) OVER w IS NULL AS last_one
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))""")

cte("block_parts", ("block_lines",), """
  SELECT *, CASE WHEN nth = 0 AND kind IN (1, 2) THEN (CASE WHEN id % 3 = 0 THEN 'if base > 0:' ELSE 'if (base > 0) {' END)
                 WHEN nth = 0 AND kind = 3 THEN (CASE WHEN id % 3 = 0 THEN 'while base > 0:' ELSE 'while (base > 0) {' END)
                 WHEN nth = 2 AND kind = 1 THEN (CASE WHEN id % 3 = 0 THEN 'else:' ELSE '} else {' END) END AS head,
         CASE WHEN id % 3 = 0 AND kind <> 0 THEN '    ' ELSE '' END AS pad,
         CASE WHEN id % 3 <> 0 AND kind <> 0 AND (last_one OR nth = 3) THEN '}' END AS foot
  FROM block_lines""")

cte("block_programs", ("block_parts",), """
  SELECT id, CASE id % 3 WHEN 0 THEN 'Python' WHEN 1 THEN 'Java' ELSE 'C++' END AS lang,
         (CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'int f(int base) {' || chr(10) ELSE 'int main() {' || chr(10) || 'int base = 1;' || chr(10) END)
         || string_agg(coalesce(head || chr(10), '') || pad || (CASE WHEN id % 3 = 0 THEN '' ELSE 'int ' END) || target || ' = ' || factor
                       || ' * ' || operand || (CASE WHEN id % 3 = 0 THEN '' ELSE ';' END)
                       || (CASE WHEN has_note THEN chr(10) || pad || (CASE WHEN id % 3 = 0 THEN '' ELSE 'String ' END) || 'note = \"\"\"sup '
                           || note || chr(10) || 'q1 = q2' || chr(10) || '\"\"\"' || (CASE WHEN id % 3 = 0 THEN '' ELSE ';' END) ELSE '' END)
                       || coalesce(chr(10) || foot, ''), chr(10) ORDER BY ord)
         || (CASE id % 3 WHEN 0 THEN '' ELSE chr(10) || '}' END) AS text
  FROM block_parts GROUP BY id""")

# line of every statement and of its header
cte("block_at", ("block_parts",), """
  SELECT *, start + CASE WHEN head IS NULL THEN 0 ELSE 1 END AS line
  FROM (SELECT *, CAST((id % 3) + coalesce(sum(1 + (CASE WHEN head IS NULL THEN 0 ELSE 1 END) + (CASE WHEN has_note THEN 3 ELSE 0 END)
                       + (CASE WHEN foot IS NULL THEN 0 ELSE 1 END)) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM block_parts)""")

#: Which definitions reach a use, by cases: d before u or, in a loop, after it; k stands for a definition that hides d.
REACHING = """
SELECT u.id, u.line AS use_line, u.operand AS var, d.line AS def_line
FROM block_at u JOIN block_at d ON d.id = u.id AND d.target = u.operand
WHERE (d.ord < u.ord
       AND NOT (d.block = u.block AND u.kind = 1 AND (d.nth < 2) <> (u.nth < 2))
       AND NOT EXISTS (SELECT 1 FROM block_at k WHERE k.id = u.id AND k.target = u.operand AND k.ord > d.ord AND k.ord < u.ord AND (
             k.kind IN (0, 3)
             OR (k.block = u.block AND (k.kind = 2 OR (k.nth < 2) = (u.nth < 2)))
             OR (k.block = d.block AND (k.kind = 2 OR (k.nth < 2) = (d.nth < 2)))))
       AND NOT EXISTS (SELECT 1 FROM block_at k WHERE k.id = u.id AND k.target = u.operand AND k.kind = 1 AND k.block > d.block AND k.block < u.block
                       GROUP BY k.block HAVING count(DISTINCT k.nth < 2) = 2))
   OR (d.block = u.block AND u.kind = 3 AND d.ord >= u.ord
       AND NOT EXISTS (SELECT 1 FROM block_at k WHERE k.id = u.id AND k.target = u.operand AND k.block = u.block AND (k.ord > d.ord OR k.ord < u.ord)))
UNION ALL
SELECT id, line, 'base', id % 3 - 1 FROM block_at WHERE operand = 'base' AND id % 3 <> 0
UNION ALL
SELECT id, start, 'base', id % 3 - 1 FROM block_at WHERE head LIKE '%base%' AND id % 3 <> 0"""

#: Tokens as structure events, suites opened and closed where the indentation of Python lines changes.
STRUCTURE = """
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS pos, sym, delta FROM (
  SELECT id, pos * 4 + 3 AS pos,
         CASE WHEN token IN ('(', ')') THEN 'paren' WHEN token IN ('[', ']') THEN 'index' WHEN token IN ('{', '}') THEN 'block'
              WHEN kind = 'name' THEN 'n' WHEN kind = 'number' THEN '1' WHEN kind = 'string' THEN 's' ELSE token END AS sym,
         CASE WHEN token IN ('(', '[', '{') THEN 1 WHEN token IN (')', ']', '}') THEN -1 ELSE 0 END AS delta
  FROM b_tok
  UNION ALL
  SELECT id, pos * 4 + CASE WHEN pad > before THEN 2 ELSE 1 END, 'suite', CASE WHEN pad > before THEN 1 ELSE -1 END
  FROM (SELECT id, pos, pad, coalesce(lag(pad) OVER (PARTITION BY id ORDER BY line), 0) AS before
        FROM (SELECT t.id, t.line, min(t.pos) AS pos, any_value(len(regexp_extract(string_split(p.text, chr(10))[t.line + 1], '^ *'))) AS pad
              FROM b_tok t JOIN block_programs p ON p.id = t.id WHERE p.lang = 'Python' GROUP BY t.id, t.line)) WHERE pad <> before
  UNION ALL
  SELECT id, pos * 4 + 4, 'suite', -1
  FROM (SELECT t.id, max(t.pos) AS pos, arg_max(len(regexp_extract(string_split(p.text, chr(10))[t.line + 1], '^ *')), t.pos) AS pad
        FROM b_tok t JOIN block_programs p ON p.id = t.id WHERE p.lang = 'Python' GROUP BY t.id) WHERE pad > 0)"""
