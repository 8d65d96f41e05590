"""DuckDB SQL for the derived fixtures (oracle side).

The same rules as ``tidemark.sources.code_corpus`` and
``tidemark.functions.code``, written as SQL so the oracle computes every
value independently from the raw tables.
"""

from __future__ import annotations

from tidemark.functions.code import CPP_DECLARED, JAVA_FOREACH, JAVA_PARAM, NAME_DIGITS, PY_ASSIGNED, WORD_RUNS
from tidemark.functions.keywords import RENAME_EXCLUDE_CPP, RENAME_EXCLUDE_JAVA, rename_exclude_py

NL = "chr(10)"
WS = "[ \\t\\n\\r\\f\\x0B]"


def sq(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(sq(w) for w in words) + "]"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def words_sql(e: str) -> str:
    """Whitespace tokens of an expression, [] for blank text."""
    return f"(CASE WHEN {strip(e)} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({strip(e)}, '{WS}+') END)"


def wrap(key: str, body: str) -> str:
    return (
        f"(CASE WHEN {key} % 3 = 0 THEN '\"\"\"order ' || CAST({key} AS VARCHAR) || '\"\"\"' || {NL} || {body} "
        f"WHEN {key} % 3 = 1 THEN 'int f(int base) {{' || {NL} || {body} || {NL} || '}}' "
        f"ELSE 'int main() {{' || {NL} || '  int base = 1;' || {NL} || {body} || {NL} || '}}' END)"
    )


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


cte("code_lines0", (), """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_discount, l_tax,
         'q' || CAST(l_partkey % 7 AS VARCHAR) AS tgt,
         CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS fac
  FROM lineitem""")

cte("code_lines", ("code_lines0",), f"""
  SELECT l_orderkey AS id, row_number() OVER w AS ord,
         CASE WHEN l_orderkey % 3 = 0 THEN tgt || ' = ' || fac || ' * ' || coalesce(lag(tgt) OVER w, 'base')
              ELSE '  int ' || tgt || ' = ' || fac || ' * ' || coalesce(lag(tgt) OVER w, 'base') || ';' END AS stmt,
         CASE WHEN l_returnflag = 'R' THEN
              (CASE WHEN l_orderkey % 3 = 0 THEN '# sup ' ELSE '  // sup ' END) || CAST(l_suppkey AS VARCHAR) END AS cmt,
         CAST(l_suppkey AS VARCHAR) AS t_input, fac AS t_expected, l_discount, l_tax
  FROM code_lines0
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)""")

_LINE = f"(CASE WHEN cmt IS NULL THEN stmt ELSE cmt || {NL} || stmt END)"
cte("code_per", ("code_lines",), f"""
  SELECT id,
         string_agg({_LINE}, {NL} ORDER BY ord) AS body,
         string_agg(CASE WHEN ord % 3 <> 0 THEN {_LINE} END, {NL} ORDER BY ord) AS body_drop,
         string_agg(stmt, {NL} ORDER BY ord) AS body_plain,
         list({{'input': t_input, 'expected': t_expected}} ORDER BY ord) AS tests
  FROM code_lines GROUP BY id""")

cte("code_corpus", ("code_per",), f"""
  SELECT id,
         (CASE WHEN id % 3 = 0 THEN 'python' WHEN id % 3 = 1 THEN 'java' ELSE 'cpp' END) || '_' ||
         (CASE WHEN id % 5 = 3 THEN 'test' WHEN id % 5 = 4 THEN 'valid' ELSE 'train' END) || '_' ||
         CAST(id % 4 AS VARCHAR) || '.jsonl' AS filename,
         CASE WHEN id % 3 = 1 AND id % 9 = 4 THEN NULL
              WHEN id % 3 = 0 THEN 'Python' WHEN id % 3 = 1 THEN 'Java' ELSE 'C++' END AS type,
         CASE WHEN o_orderstatus = 'F' THEN 'fine' ELSE 'coarse' END AS grade,
         {wrap('id', 'body')} AS code,
         CASE WHEN o_orderstatus = 'F' THEN tests END AS test_case,
         {wrap('id', 'body_drop')} AS code_drop,
         {wrap('id', 'body_plain')} AS code_nocomment
  FROM code_per JOIN orders ON o_orderkey = id""")


cte("actual_outputs", ("code_lines",), f"""
  SELECT id, CAST(ord AS BIGINT) AS test_no,
         '  ' || CAST(CASE WHEN l_discount > 0.08 THEN CAST(t_expected AS BIGINT) + 1 ELSE CAST(t_expected AS BIGINT) END AS VARCHAR) || {NL} AS stdout,
         CASE WHEN l_tax = 0 THEN 1 ELSE 0 END AS status
  FROM code_lines""")


def hashed(key: str, name: str, digits: int) -> str:
    return (
        f"translate(substr(md5(CAST({key} AS VARCHAR) || ':' || {name}), 1, {digits}), "
        f"'0123456789abcdef', 'abcdefghijklmnop')"
    )


def choose_names() -> str:
    """The first length of new names without a clash among themselves, with the record's words or reserved words."""
    reserved = sql_list(dict.fromkeys([*rename_exclude_py(), *RENAME_EXCLUDE_CPP, *RENAME_EXCLUDE_JAVA]))
    whens = " ".join(f"WHEN len(list_distinct(new_{d})) = len(names) AND NOT list_has_any(new_{d}, words) "
                     f"AND NOT list_has_any(new_{d}, {reserved}) THEN new_{d}" for d in NAME_DIGITS)
    return f"CASE {whens} ELSE names END"


def names_py(code: str) -> str:
    return (f"list_filter(list_distinct(regexp_extract_all({code}, {sq(PY_ASSIGNED)}, 1)), "
            f"lambda x: NOT list_contains({sql_list(rename_exclude_py())}, x))")


def names_cpp(code: str) -> str:
    return (f"list_filter(list_distinct(regexp_extract_all({code}, {sq(CPP_DECLARED)}, 1)), "
            f"lambda x: NOT list_contains({sql_list(RENAME_EXCLUDE_CPP)}, x))")


def java_start(code: str) -> str:
    return f"regexp_extract({code}, '^([^(]*\\()', 1)"


def java_rest(code: str) -> str:
    return f"substr({code}, length({java_start(code)}) + 1)"


def java_header(code: str) -> str:
    return f"regexp_extract({java_rest(code)}, '^([^)]*\\))', 1)"


def java_body(code: str) -> str:
    return f"substr({java_rest(code)}, length({java_header(code)}) + 1)"


def names_java(code: str) -> str:
    found = (f"list_concat(regexp_extract_all({java_header(code)}, {sq(JAVA_PARAM)}, 1), "
             f"regexp_extract_all({java_body(code)}, {sq(JAVA_FOREACH)}, 1))")
    return f"list_filter(list_distinct({found}), lambda x: NOT list_contains({sql_list(RENAME_EXCLUDE_JAVA)}, x))"


def rename_ctes(src: str, prefix: str) -> dict[str, str]:
    """CTE bodies renaming ``code`` of ``src(id, type, code)``; output ``{prefix}_out(id, type, renamed)``."""
    lang = "coalesce(nullif(type, ''), 'Java')"
    return {
        f"{prefix}_n": f"""
  SELECT id, type, code, {lang} AS lang,
         CASE WHEN {lang} = 'Python' THEN {names_py('code')}
              WHEN {lang} = 'C++' THEN {names_cpp('code')}
              WHEN {lang} = 'Java' THEN {names_java('code')} END AS names,
         CASE WHEN {lang} = 'Java' THEN {java_start('code')} ELSE '' END AS jstart,
         CASE WHEN {lang} = 'Java' THEN {java_header('code')} ELSE '' END AS jheader
  FROM {src}""",
        f"{prefix}_h": f"""
  SELECT *, {choose_names()} AS newn
  FROM (SELECT *, regexp_extract_all(scope, {sq(WORD_RUNS)}) AS words,
               {', '.join(f"list_transform(names, lambda n: {hashed('id', 'n', d)}) AS new_{d}" for d in NAME_DIGITS)}
        FROM (SELECT *, CASE WHEN lang = 'Java' THEN substr(code, length(jstart) + 1) ELSE code END AS scope
              FROM {prefix}_n))""",
        f"{prefix}_out": f"""
  SELECT id, type,
         CASE WHEN lang = 'Java' AND (jstart = '' OR jheader = '') THEN code
              WHEN lang IN ('Python', 'Java', 'C++') THEN
                (CASE WHEN lang = 'Java' THEN jstart ELSE '' END) ||
                array_to_string(list_transform(words,
                  lambda t: CASE WHEN list_contains(names, t) THEN newn[list_position(names, t)] ELSE t END), '')
         END AS renamed
  FROM {prefix}_h""",
    }


for _name, _body in rename_ctes("code_corpus", "rn").items():
    cte(_name, ("code_corpus",) if _name == "rn_n" else (), _body)
CTES["rn_h"] = (("rn_n",), CTES["rn_h"][1])
CTES["rn_out"] = (("rn_h",), CTES["rn_out"][1])

cte("code_variants", ("code_corpus", "rn_out"), f"""
  SELECT id, 'rename' AS variant, renamed AS text FROM rn_out
  UNION ALL SELECT id, 'drop', code_drop FROM code_corpus
  UNION ALL SELECT id, 'comment', code_nocomment FROM code_corpus
  UNION ALL SELECT id, 'fence', '### Response:' || {NL} || '```' ||
      (CASE coalesce(nullif(type, ''), 'Java') WHEN 'Python' THEN 'python' WHEN 'Java' THEN 'java' ELSE 'cpp' END)
      || {NL} || code || {NL} || '```' FROM code_corpus""")

# documents against themselves with every third line removed
cte("docpair", (), f"""
  SELECT doc_id AS pair_id, lang, source,
         list_filter(string_split(text, {NL}), lambda x, i: i % 3 <> 0) AS hyp,
         string_split(text, {NL}) AS ref
  FROM documents""")


def with_ctes(query: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``query`` with the named CTEs (and their dependencies) in order, each computed once."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]}\n)" for n in order]
    for n, body in (extra or {}).items():
        parts.append(f"{n} AS MATERIALIZED ({body}\n)")
    if not parts:
        return query
    return "WITH " + ",\n".join(parts) + "\n" + query
