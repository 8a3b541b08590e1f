"""Text queries over SQL statements and free prose.

Inputs: ``texts`` = the derived SQL statements plus every ``documents``
text, whole.  The oracle side writes each rule again as DuckDB (RE2) SQL;
patterns are shared where both engines read them the same way.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from columbine.functions import text as T
from columbine.plans.registry import canon_sql, register
from columbine.sources import fixtures as fx
from columbine.sources.io import canonical_mappings


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# --- DuckDB twins of the column rules (oracle side) ---------------------------
WS = T.WS


def d_upper(x: str) -> str:
    # Java and Python upper-case the sharp s to 'SS'; DuckDB does not.
    return f"upper(replace({x}, 'ß', 'SS'))"


def d_norm_ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {q(WS + '+')}, ' ', 'g'))"


def d_py_strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def d_word_count(x: str, word: str) -> str:
    return f"len(list_filter(string_split_regex({x}, {q(T.NON_WORD + '+')}), lambda t: t = {q(word)}))"


def d_char_count(x: str, ch: str) -> str:
    return f"(length({x}) - length(replace({x}, {q(ch)}, '')))"


# DuckDB's regex engine does not recurse, so the patterns stand as they are.
ALL_CONSTANTS = "(?i)" + "|".join(T._ws_pattern(p) for p in T.CONSTANT_PATTERNS)


def d_is_constant(x: str) -> str:
    return f"coalesce(regexp_matches({d_py_strip(x)}, {q(ALL_CONSTANTS)}), false)"


def d_strip_comments(x: str) -> str:
    return f"regexp_replace({x}, {q(T.COMMENTS)}, '\\1', 'g')"


def d_normalize_sql_no_alias(x: str) -> str:
    """normalize_sql without the ``X AS X`` step (needs a back-reference)."""
    s = f"coalesce({x}, '')"
    s = f"regexp_replace({s}, {q(chr(27) + '[[0-9;]*m')}, '', 'g')"
    s = f"regexp_replace({s}, {q('(?i)esc[[][0-9;]*m')}, '', 'g')"
    s = f"regexp_replace({s}, {q('[' + chr(0x2003) + chr(0x2002) + chr(0x2001) + chr(0x2000) + chr(0xA0) + ']+')}, ' ', 'g')"
    for m in T.PLACEHOLDER_MACROS:
        s = f"regexp_replace({s}, {q('(?i)[[]' + m + '[]]')}, {q(chr(39) + 'PLACEHOLDER_' + m + chr(39))}, 'g')"
    s = f"regexp_replace({s}, {q('(?i)' + chr(39) + '[$]([A-Z_][A-Z0-9_]*)' + chr(39))}, {q(chr(39) + 'PLACEHOLDER_' + chr(92) + '1' + chr(39))}, 'g')"
    s = f"regexp_replace({s}, {q('(?i)[$]([A-Z_]*DATE[A-Z0-9_]*)' + chr(92) + 'b')}, {q(T.PLACEHOLDER_DATE)}, 'g')"
    s = f"regexp_replace({s}, {q('(?i)[$]([A-Z_][A-Z0-9_]*)' + chr(92) + 'b')}, {q(chr(39) + 'PLACEHOLDER_' + chr(92) + '1' + chr(39))}, 'g')"
    s = f"regexp_replace({s}, {q('[|][|]' + WS + '*~' + WS + '*[|][|]')}, {q('|| ' + chr(39) + '~' + chr(39) + ' ||')}, 'g')"
    s = f"replace({s}, {q(chr(92) + chr(39))}, {q(chr(39) + chr(39))})"
    s = d_strip_comments(s)
    return d_norm_ws(s)


TEXTS = ["texts"]


def texts(spark, sf_dir):
    return fx.spark_fixture(spark, sf_dir, "texts")


@register("clean_text", needs=TEXTS, oracle=f"""
select text_id, case when lower({d_norm_ws('text')}) = 'nan' then '' else {d_norm_ws('text')} end as clean_text from texts
""")
def q_clean_text(spark, sf_dir):
    """B1: cleaned text of every statement and document."""
    return texts(spark, sf_dir).select("text_id", T.clean_text("text").alias("clean_text"))


@register("normalize_ws", needs=TEXTS, oracle=f"select text_id, {d_norm_ws('text')} as normalized from texts")
def q_normalize_ws(spark, sf_dir):
    """B2: whitespace-normalized text."""
    return texts(spark, sf_dir).select("text_id", T.normalize_ws("text").alias("normalized"))


@register("normalize_identifier", needs=["map_v1"], oracle=f"""
with n as (select source_table as raw from map_v1 union all select lower(dest_field) from map_v1
           union all select '"' || lower(object_name) || '"' from map_v1 union all select '  ' || rules || ' ' from map_v1)
select raw, {d_upper(f"case when {d_norm_ws('raw')} like '\"%' and {d_norm_ws('raw')} like '%\"' then substring({d_norm_ws('raw')}, 2, greatest(length({d_norm_ws('raw')}) - 2, 0)) else {d_norm_ws('raw')} end")} as identifier from n
""")
def q_normalize_identifier(spark, sf_dir):
    """Identifiers as spreadsheets give them (quoted, lower case, padded)."""
    m = fx.spark_fixture(spark, sf_dir, "map_v1")
    raw = (m.select(F.col("source_table").alias("raw"))
           .unionAll(m.select(F.lower("dest_field")))
           .unionAll(m.select(F.concat(F.lit('"'), F.lower("object_name"), F.lit('"'))))
           .unionAll(m.select(F.concat(F.lit("  "), "rules", F.lit(" ")))))
    return raw.select("raw", T.normalize_identifier("raw").alias("identifier"))


LIT = q(T.LITERAL)


@register("normalize_expression", needs=TEXTS, oracle=f"""
with p as (select text_id, string_split_regex(coalesce(text, ''), {LIT}) as segs,
                  regexp_extract_all(coalesce(text, ''), {LIT}) as lits from texts)
select text_id, trim(array_to_string(list_transform(range(1, len(segs) + 1),
        lambda i: {d_upper(f"regexp_replace(segs[i], {q(WS + '+')}, ' ', 'g')")} || coalesce(lits[i], '')), '')) as expression
from p
""")
def q_normalize_expression(spark, sf_dir):
    """Expressions normalized outside their literals."""
    return texts(spark, sf_dir).select("text_id", T.normalize_expression("text").alias("expression"))


CONST_INPUT = """
k as (select expression as v from projections
      union all select text from texts
      union all select unnest(['NULL', ' sysdate ', 'Sys_Guid( )', 'USERENV(''LANG'')', 'N''x''''y''', '-12.5', '1.',
        'DATE ''2024-01-01''', 'interval ''1'' day', '$P_DATE', '[M1]', ':B1', 'UNPIVOT_FOR(C)', 'A.B', '''open']))
"""


@register("is_constant", needs=["texts", "projections"], oracle=f"""
with {CONST_INPUT} select v, {d_is_constant('v')} as is_constant from k
""")
def q_is_constant(spark, sf_dir):
    """Constant test over projection expressions, texts and edge cases."""
    probes = ["NULL", " sysdate ", "Sys_Guid( )", "USERENV('LANG')", "N'x''y'", "-12.5", "1.",
              "DATE '2024-01-01'", "interval '1' day", "$P_DATE", "[M1]", ":B1", "UNPIVOT_FOR(C)", "A.B", "'open"]
    v = (fx.spark_fixture(spark, sf_dir, "projections").select(F.col("expression").alias("v"))
         .unionAll(texts(spark, sf_dir).select("text"))
         .unionAll(spark.createDataFrame([(p,) for p in probes], "v string")))
    return v.select("v", T.is_constant("v").alias("is_constant"))


@register("parse_ref", needs=["projections"], oracle=f"""
with r as (select expression as raw from projections),
n as (select raw, upper({d_norm_ws('raw')}) as u from r)
select raw, case when strpos(u, '.') > 0 then trim(split_part(u, '.', 1)) end as alias,
       case when strpos(u, '.') > 0 then trim(substring(u, strpos(u, '.') + 1)) else trim(u) end as "column"
from n
""")
def q_parse_ref(spark, sf_dir):
    """(alias, column) of every projection expression."""
    p = fx.spark_fixture(spark, sf_dir, "projections").select(F.col("expression").alias("raw"))
    return p.select("raw", T.parse_ref("raw").alias("r")).select("raw", "r.alias", "r.column")


@register("validate_sql", needs=TEXTS, oracle=f"""
with s as (select text_id, coalesce(text, '') as sql from texts),
m as (select text_id, sql,
  case when {d_py_strip('sql')} = '' then 'SQL file is empty or whitespace only'
       when length({d_py_strip('sql')}) < 10 then 'SQL too short (' || length(sql) || ' chars), likely invalid'
       when {d_word_count('upper(sql)', 'SELECT')} = 0 then 'No SELECT keyword found' end as message,
  {d_char_count('sql', '(')} as o, {d_char_count('sql', ')')} as c from s)
select text_id, message is null as valid, coalesce(message, '') as message,
  case when message is null then array_to_string(list_filter([
    case when regexp_matches(sql, {q('(?i)(?:^|' + T.NON_WORD + ')EXECUTE' + WS + '+IMMEDIATE(?:' + T.NON_WORD + '|$)')})
         then 'Contains EXECUTE IMMEDIATE - dynamic SQL cannot be fully traced' end,
    case when regexp_matches(sql, {q('@' + T.WORD)}) then 'Contains DB links (@) - remote tables may not resolve' end,
    case when o <> c then 'Unbalanced parentheses: ' || o || ' open, ' || c || ' close' end], lambda x: x is not null), ' | ')
  else '' end as warnings
from m
""")
def q_validate_sql(spark, sf_dir):
    """Validity, message and warnings of every text."""
    v = texts(spark, sf_dir).select("text_id", T.validate_sql("text").alias("v"))
    return v.select("text_id", "v.valid", "v.message", F.array_join("v.warnings", " | ").alias("warnings"))


@register("strip_comments", needs=TEXTS, oracle=f"select text_id, {d_strip_comments('text')} as stripped from texts")
def q_strip_comments(spark, sf_dir):
    """Comments removed outside literals."""
    return texts(spark, sf_dir).select("text_id", T.strip_comments("text").alias("stripped"))


@register("normalize_sql", needs=TEXTS)
def q_normalize_sql(spark, sf_dir):
    """The full cleaning chain (the ``X AS X`` rule needs a regex
    back-reference, which DuckDB lacks: checked against a brute-force
    Python run of the same rules in tests instead)."""
    return texts(spark, sf_dir).select("text_id", T.normalize_sql("text").alias("normalized"))


@register("diagnose_sql", needs=TEXTS, oracle=f"""
with s as (select text_id, coalesce(text, '') as sql, upper(coalesce(text, '')) as up from texts),
c as (select text_id,
  {d_word_count('up', 'CASE')} as cases,
  {d_word_count('up', 'END')} - len(regexp_extract_all(up, {q('(?:^|' + T.NON_WORD + ')(END' + WS + '+(?:' + '|'.join(T.PLSQL_END_FOLLOWERS) + '))')}, 1)) as ends,
  {d_char_count('sql', '(')} as o, {d_char_count('sql', ')')} as c,
  {d_char_count('sql', "'")} - (length(sql) - length(replace(sql, '''''', ''))) // 2 * 2 as quotes from s)
select text_id, array_to_string(list_filter([
  case when cases <> ends then 'CASE/END mismatch: ' || cases || ' CASE vs ' || ends || ' END' end,
  case when o <> c then 'Parentheses mismatch: ' || o || ' ''('' vs ' || c || ' '')''' end,
  case when quotes % 2 <> 0 then 'Possible unclosed string literal (odd number of single quotes)' end],
  lambda x: x is not null), ' | ') as issues
from c
""")
def q_diagnose_sql(spark, sf_dir):
    """Parse hints for every text."""
    return texts(spark, sf_dir).select("text_id", F.array_join(T.diagnose_sql("text"), " | ").alias("issues"))


KEYWORDS_SQL = "[" + ", ".join(q(k) for k in T.SQL_KEYWORDS) + "]"
FUNCTIONS_SQL = "[" + ", ".join(q(k) for k in T.KNOWN_FUNCTIONS) + "]"


def d_column_refs(x: str) -> str:
    masked = f"regexp_replace(coalesce({x}, ''), {LIT}, '__LIT__', 'g')"
    tight = f"regexp_replace({masked}, {q(WS + '*[.]' + WS + '*')}, '.', 'g')"
    toks = f"list_transform(regexp_extract_all({tight}, {q(T.REF_TOKEN)}, 1), lambda t: upper(t))"
    return (f"list_filter({toks}, lambda t: not list_contains({KEYWORDS_SQL}, t) "
            f"and not (strpos(t, '.') = 0 and list_contains({FUNCTIONS_SQL}, t)) "
            f"and not starts_with(t, '__LIT') and not regexp_matches(t, {q(ALL_CONSTANTS)}))")


@register("column_refs", needs=["texts", "projections"], oracle=f"""
with e as (select 'p' || stmt_id || '_' || scope_id || '_' || ord as id, expression as v from projections
           union all select 't' || text_id, text from texts)
select id, array_to_string({d_column_refs('v')}, ',') as refs from e
""")
def q_column_refs(spark, sf_dir):
    """Column references of projection expressions and whole texts."""
    p = fx.spark_fixture(spark, sf_dir, "projections").select(
        F.concat_ws("_", F.concat(F.lit("p"), "stmt_id"), "scope_id", "ord").alias("id"), F.col("expression").alias("v"))
    t = texts(spark, sf_dir).select(F.concat(F.lit("t"), "text_id").alias("id"), F.col("text").alias("v"))
    return p.unionAll(t).select("id", F.array_join(T.column_refs("v"), ",").alias("refs"))


@register("simple_refs", needs=TEXTS, oracle=f"""
with p as (select text_id, regexp_extract_all(coalesce(text, ''), {q(T.DOTTED_PAIR)}, 1) as a,
                  regexp_extract_all(coalesce(text, ''), {q(T.DOTTED_PAIR)}, 2) as b from texts)
select distinct text_id, upper(a[i]) as "table", upper(b[i]) as "column"
from (select text_id, a, b, unnest(range(1, len(a) + 1)) as i from p)
""")
def q_simple_refs(spark, sf_dir):
    """Distinct dotted pairs in every raw text."""
    return (texts(spark, sf_dir).select("text_id", F.explode(T.simple_refs("text")).alias("r"))
            .select("text_id", "r.table", "r.column"))


@register("scalar_subquery_flag", needs=["texts", "projections"], oracle=f"""
with e as (select expression as v from projections union all select text from texts
           union all select unnest(['NVL((select max(x) from t), 0)', '( SELECT', '(selectx)']))
select v, coalesce(regexp_matches(v, {q('(?i)[(]' + WS + '*SELECT(?:[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]|$)')}), false) as has_scalar_subquery from e
""")
def q_scalar_subquery_flag(spark, sf_dir):
    """Scalar-subquery flag of expressions and texts."""
    probes = ["NVL((select max(x) from t), 0)", "( SELECT", "(selectx)"]
    e = (fx.spark_fixture(spark, sf_dir, "projections").select(F.col("expression").alias("v"))
         .unionAll(texts(spark, sf_dir).select("text"))
         .unionAll(spark.createDataFrame([(p,) for p in probes], "v string")))
    return e.select("v", T.has_scalar_subquery("v").alias("has_scalar_subquery"))


@register("statement_kind", needs=TEXTS, oracle=f"""
with n as (select text_id, upper(regexp_extract({d_normalize_sql_no_alias('text')}, '^[(]*{WS}*([A-Za-z]+)', 1)) as lead from texts)
select text_id, case lead when 'MERGE' then 'MERGE' when 'INSERT' then 'INSERT' else 'OTHER' end as kind from n
""")
def q_statement_kind(spark, sf_dir):
    """MERGE / INSERT / OTHER of every cleaned text."""
    return texts(spark, sf_dir).select("text_id", T.statement_kind("text").alias("kind"))


@register("edge_keys", needs=["map_v1"], oracle=f"""
with v1 as ({canon_sql('map_v1')})
select object_name || '|' || dest_table || '|' || dest_field || '|' || source_table || '|' || source_field as mapping_key,
       rules from v1
""")
def q_edge_keys(spark, sf_dir):
    """Composite mapping keys of every mapping."""
    m = canonical_mappings(fx.spark_fixture(spark, sf_dir, "map_v1"))
    return m.select(T.mapping_key("object_name", "dest_table", "dest_field", "source_table", "source_field")
                    .alias("mapping_key"), "rules")


BULK_SQL = f"""
with c as (select doc_id, list_filter(string_split_regex({d_py_strip('coalesce(text, ' + chr(39) + chr(39) + ')')},
              {q(chr(10) + WS + '*' + chr(10))}), lambda x: {d_py_strip('x')} <> '') as chunks from documents),
u as (select doc_id, unnest(chunks) as chunk, unnest(range(1, len(chunks) + 1)) as position from c),
s as (select doc_id, position, {d_py_strip('chunk')} as sql_text from u)
select doc_id, position, sql_text,
  case when regexp_matches(sql_text, {q(T.BULK_NAME)})
       then {d_upper(d_py_strip("regexp_extract(sql_text, " + q(T.BULK_NAME) + ", 1)"))}
       else 'UNKNOWN_' || position end as object_name
from s
"""


@register("bulk_split", needs=["documents"], oracle=BULK_SQL)
def q_bulk_split(spark, sf_dir):
    """S8 + W6: every document as a bulk file, split into statements."""
    from columbine.sources.corpus import split_bulk_sql

    d = fx.base_table(spark, sf_dir, "documents").select("doc_id", "text")
    return split_bulk_sql(d, "text", ["doc_id"]).select("doc_id", "position", "sql_text", "object_name")


@register("bulk_lines", needs=["documents"], oracle=BULK_SQL)
def q_bulk_lines(spark, sf_dir):
    """S8 + W6: every document as a bulk file that is read by lines, which any task may hold."""
    from columbine.sources.corpus import split_bulk_lines

    d = fx.base_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return split_bulk_lines(d, ["doc_id"], ["at"])
