"""DuckDB SQL of the token / data-flow job (oracle side), mirroring ``tidemark.operators.dataflow``."""

from __future__ import annotations

from tidemark.functions.comments import PY_RUNS
from tidemark.functions.keywords import KEYWORDS, LANG_CODE
from tidemark.operators.dataflow import TOKEN, TYPE_WORDS, FlowRules
from tidemark.plans import sql_code as SC
from tidemark.plans.sql_fixtures import NL, sq, sql_list


def _kw(lang: str) -> str:
    cases = " ".join(f"WHEN {sq(n)} THEN {sql_list(KEYWORDS[c])}" for n, c in LANG_CODE.items())
    return f"(CASE {lang} {cases} ELSE []::VARCHAR[] END)"


def flow_ctes(p: str, src: str, ids: list[str]) -> dict[str, str]:
    """CTEs ``{p}_tok`` (tokens), ``{p}_nodes``, ``{p}_edges``, ``{p}_norm`` over ``src(ids..., text, lang)``."""
    i = ", ".join(ids)
    part = ", ".join(ids)
    types = ", ".join(sq(x) for x in TYPE_WORDS)
    return {
        f"{p}_s0": f"SELECT {i}, lang, text, regexp_extract_all(text, {sq(PY_RUNS)}, 0) AS runs FROM ({src})",
        # the whole text at once: lines are counted by the line feeds before a token, those inside strings included
        f"{p}_s1": f"""
  SELECT {i}, lang, k, flat[k] AS tok
  FROM (SELECT {i}, lang, regexp_extract_all({SC.strip_comments('text', 'lang', 'runs')}, {sq(TOKEN + '|' + chr(10))}, 0) AS flat
        FROM {p}_s0), range(1, len(flat) + 1) r(k)""",
        f"{p}_s2": f"""
  SELECT {i}, lang, k, tok, coalesce(sum(len(tok) - len(replace(tok, {NL}, ''))) OVER (
           PARTITION BY {part} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
  FROM {p}_s1""",
        f"{p}_tok": f"""
  SELECT {i}, CAST(row_number() OVER w - 1 AS BIGINT) AS pos, CAST(line AS BIGINT) AS line, tok AS token,
         CASE WHEN starts_with(tok, '"') OR starts_with(tok, '''') THEN 'string'
              WHEN regexp_matches(tok, '^[0-9]') THEN 'number'
              WHEN list_contains({_kw('lang')}, tok) THEN 'keyword'
              WHEN regexp_matches(tok, '^[A-Za-z_]') THEN 'name' ELSE 'op' END AS kind,
         lag(tok) OVER w AS prev_tok, lead(tok) OVER w AS next_tok
  FROM {p}_s2 WHERE tok <> {NL} WINDOW w AS (PARTITION BY {part} ORDER BY k)""",
        f"{p}_t1": f"""
  SELECT {i}, pos, line, token,
         kind = 'name' AND next_tok IS DISTINCT FROM '(' AND {FlowRules().defines_sql()} AS is_def,
         kind = 'name' AND next_tok IS DISTINCT FROM '(' AND NOT {FlowRules().defines_sql()} AS is_use,
         CASE WHEN prev_tok IN ({types}) THEN 'comesFrom' ELSE 'computedFrom' END AS rel
  FROM {p}_tok""",
        f"{p}_t2": f"""
  SELECT *,
    max(CASE WHEN is_def THEN pos END) OVER (PARTITION BY {part}, token ORDER BY line
        RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_pos,
    last_value(CASE WHEN is_def THEN pos END IGNORE NULLS) OVER (PARTITION BY {part}, line ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stmt_pos
  FROM {p}_t1 WHERE is_def OR is_use""",
        f"{p}_recs": f"""
  SELECT {i}, pos AS node, true AS head, token AS var, rel, CAST(NULL AS BIGINT) AS ppos, CAST(NULL AS VARCHAR) AS pname,
         false AS marker FROM {p}_t2 WHERE is_def
  UNION ALL SELECT {i}, pos, true, token, 'comesFrom', def_pos, CASE WHEN def_pos IS NOT NULL THEN token END, false
         FROM {p}_t2 WHERE is_use
  UNION ALL SELECT {i}, def_pos, false, NULL, NULL, NULL, NULL, true FROM {p}_t2 WHERE is_use AND def_pos IS NOT NULL
  UNION ALL SELECT {i}, stmt_pos, false, NULL, NULL, pos, token, false FROM {p}_t2 WHERE is_use AND stmt_pos IS NOT NULL
  UNION ALL SELECT {i}, pos, false, NULL, NULL, NULL, NULL, true FROM {p}_t2 WHERE is_use AND stmt_pos IS NOT NULL""",
        f"{p}_nodes": f"""
  SELECT {i}, node AS pos, max(CASE WHEN head THEN var END) AS var, max(CASE WHEN head THEN rel END) AS rel,
         coalesce(list({{'ppos': ppos, 'pname': pname}} ORDER BY ppos, pname) FILTER (WHERE pname IS NOT NULL),
                  []) AS parents,
         coalesce(bool_or(marker), false) AS is_parent
  FROM {p}_recs GROUP BY {i}, node HAVING bool_or(head)""",
        f"{p}_edges": f"""
  SELECT {i}, pos, var, rel, p.pname AS parent, p.ppos AS parent_pos
  FROM (SELECT {i}, pos, var, rel,
               unnest(CASE WHEN len(parents) = 0 THEN [{{'ppos': CAST(NULL AS BIGINT), 'pname': CAST(NULL AS VARCHAR)}}]
                           ELSE parents END) AS p
        FROM {p}_nodes)""",
        f"{p}_nm": f"""
  SELECT {i}, pos, rel, np, s.sub AS sub, s.name AS name
  FROM (SELECT {i}, pos, rel, len(parents) AS np,
               unnest(list_concat(list_transform(parents, lambda x, j: {{'sub': j - 1, 'name': x.pname}}),
                                  [{{'sub': len(parents), 'name': var}}])) AS s
        FROM {p}_nodes WHERE len(parents) > 0 OR is_parent)""",
        f"{p}_nm2": f"""
  SELECT *, 'var_' || CAST(dense_rank() OVER (PARTITION BY {part} ORDER BY first) - 1 AS VARCHAR) AS vname
  FROM (SELECT *, min({{'pos': pos, 'sub': sub}}) OVER (PARTITION BY {part}, name) AS first FROM {p}_nm)""",
        f"{p}_norm": f"""
  SELECT {i}, pos, arg_max(vname, sub) AS var, max(rel) AS rel,
         coalesce(string_agg(vname, ',' ORDER BY sub) FILTER (WHERE sub < np), '') AS parents
  FROM {p}_nm2 GROUP BY {i}, pos""",
    }


def structure_ctes(p: str, tok_src: str, ids: list[str]) -> dict[str, str]:
    """CTE ``{p}_sig(ids..., signature)`` over ``tok_src(ids..., pos, sym, delta)``."""
    i = ", ".join(ids)
    join_on = " AND ".join(f"x.{c} = s.{c}" for c in ids)
    xi = ", ".join(f"x.{c}" for c in ids)
    return {
        f"{p}_t": f"""
  SELECT {i}, pos, delta, piece,
         CAST(coalesce(sum(length(piece)) OVER w, 0) AS BIGINT) AS off,
         CAST(coalesce(sum(delta) OVER w, 0) AS BIGINT) AS depth
  FROM (SELECT {i}, pos, delta,
               CASE WHEN delta = 1 THEN '(' || sym WHEN delta = -1 THEN ')' ELSE ' ' || sym END AS piece
        FROM ({tok_src}))
  WINDOW w AS (PARTITION BY {i} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        f"{p}_sx": f"SELECT {i}, string_agg(piece, '' ORDER BY pos) AS sexpr FROM {p}_t GROUP BY {i}",
        f"{p}_pr": f"""
  SELECT * FROM (
    SELECT {i}, d, k, min(CASE WHEN delta = 1 THEN pos END) AS o, max(CASE WHEN delta = -1 THEN pos END) AS c,
           min(CASE WHEN delta = 1 THEN off END) AS o_off, max(CASE WHEN delta = -1 THEN off + 1 END) AS c_end
    FROM (SELECT *, row_number() OVER (PARTITION BY {i}, d, delta ORDER BY pos) AS k
          FROM (SELECT *, CASE WHEN delta = 1 THEN depth ELSE depth - 1 END AS d FROM {p}_t WHERE delta <> 0))
    GROUP BY {i}, d, k) WHERE c > o + 1""",
        f"{p}_sig": f"""
  SELECT {xi}, md5(substring(s.sexpr, x.o_off + 1, x.c_end - x.o_off)) AS signature
  FROM {p}_pr x JOIN {p}_sx s ON {join_on}
  UNION ALL SELECT {i}, md5(sexpr) FROM {p}_sx WHERE sexpr <> ''""",
    }


def code_structure_src(tok: str, ids: list[str]) -> str:
    i = ", ".join(ids)
    return f"""
  SELECT {i}, pos,
         CASE WHEN token IN ('(', ')') THEN 'paren' WHEN token IN ('[', ']') THEN 'index'
              WHEN token IN ('{{', '}}') THEN 'block' WHEN kind = 'name' THEN 'n' WHEN kind = 'number' THEN '1'
              WHEN kind = 'string' THEN 's' ELSE token END AS sym,
         CASE WHEN token IN ('(', '[', '{{') THEN 1 WHEN token IN (')', ']', '}}') THEN -1 ELSE 0 END AS delta
  FROM {tok}"""
