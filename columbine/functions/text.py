"""Column -> Column text rules over SQL statements, expressions and names.

All rules are built-in expressions (``regexp_replace``, ``regexp_extract_all``,
``split``, higher-order array functions), so they run inside whole-stage
codegen, map-only, without Python in the hot path.

Regex notes
-----------
* Whitespace follows Python's ``\\s`` (Unicode White_Space plus the
  separator controls), written out as an explicit class so the Java engine
  and any RE2 engine agree with it: ``WS``.
* Word boundaries follow Python's ``\\w`` (letters, numbers, underscore):
  ``WORD``.  Whole-word counting splits on non-word runs instead of using
  ``\\b`` (whose meaning differs between engines on non-ASCII text).
* Literal masking uses the flat ``'[^']*'`` form: a doubled quote is two
  adjacent literals, so the covered text is the same as with the grouped
  form, and the flat form cannot exhaust the regex stack on long literals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ----------------------------------------------------------------------------
# Fixed values (must equal the reference's rules)
# ----------------------------------------------------------------------------

# Python's \s as an explicit class (engine independent).
WS = (
    r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Python's \w as an explicit class.
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"

# One SQL string literal, flat form.
LITERAL = r"'[^']*'"
# Oracle constant patterns, in the reference's order (all case-insensitive,
# matched at the start of the stripped value; INTERVAL is not end-anchored).
CONSTANT_PATTERNS = [
    r"^NULL$",
    r"^SYSDATE$",
    r"^SYSTIMESTAMP$",
    r"^CURRENT_DATE$",
    r"^CURRENT_TIMESTAMP$",
    r"^ROWNUM$",
    r"^ROWID$",
    r"^LEVEL$",
    r"^USER$",
    r"^SYS_GUID\(\s*\)$",
    r"^USERENV\s*\(.+\)$",
    r"^SYS_CONTEXT\s*\(.+\)$",
    r"^'(?:[^']|'')*'$",
    r"^N'(?:[^']|'')*'$",
    r"^-?[0-9]+(\.[0-9]+)?$",
    r"^DATE\s*'(?:[^']|'')*'$",
    r"^TIMESTAMP\s*'(?:[^']|'')*'$",
    r"^INTERVAL\s*'(?:[^']|'')*'",
    r"^\$[A-Z_][A-Z0-9_]*$",
    r"^\[[A-Z_][A-Z0-9_]*\]$",
    r"^:[A-Z_][A-Z0-9_]*$",
    r"^UNPIVOT_VALUE\(.+\)$",
    r"^UNPIVOT_FOR\(.+\)$",
]

# Words never taken as column references.
SQL_KEYWORDS = [
    "SELECT", "FROM", "WHERE", "AND", "OR", "NOT", "IN", "IS",
    "NULL", "LIKE", "BETWEEN", "CASE", "WHEN", "THEN", "ELSE",
    "END", "AS", "ON", "JOIN", "LEFT", "RIGHT", "INNER", "OUTER",
    "FULL", "CROSS", "UNION", "ALL", "ORDER", "BY", "GROUP",
    "HAVING", "DISTINCT", "EXISTS", "ANY", "SOME", "TRUE", "FALSE",
    "WITH", "OVER", "PARTITION", "ROWS", "RANGE", "UNBOUNDED",
    "PRECEDING", "FOLLOWING", "CURRENT", "ROW", "ASC", "DESC",
    "NULLS", "FIRST", "LAST", "FETCH", "NEXT", "ONLY", "OFFSET",
    "LIMIT", "FOR", "UPDATE", "NOWAIT", "SKIP", "LOCKED",
]

# Function names never taken as (undotted) column references.
KNOWN_FUNCTIONS = [
    # string
    "NVL", "NVL2", "COALESCE", "DECODE", "TRIM", "LTRIM", "RTRIM",
    "UPPER", "LOWER", "INITCAP", "LENGTH", "LENGTHB", "SUBSTR", "SUBSTRB",
    "INSTR", "INSTRB", "REPLACE", "TRANSLATE", "LPAD", "RPAD",
    "CONCAT", "ASCII", "CHR", "SOUNDEX", "REGEXP_REPLACE", "REGEXP_SUBSTR",
    "REGEXP_INSTR", "REGEXP_LIKE", "REGEXP_COUNT",
    # conversion
    "TO_CHAR", "TO_DATE", "TO_NUMBER", "TO_TIMESTAMP", "TO_CLOB", "TO_LOB",
    "CAST", "CONVERT", "HEXTORAW", "RAWTOHEX", "CHARTOROWID", "ROWIDTOCHAR",
    # numeric
    "ROUND", "TRUNC", "ABS", "CEIL", "FLOOR", "MOD", "POWER", "SQRT",
    "SIGN", "GREATEST", "LEAST", "NULLIF", "EXP", "LN", "LOG", "SIN",
    "COS", "TAN", "ASIN", "ACOS", "ATAN", "SINH", "COSH", "TANH",
    "BITAND", "WIDTH_BUCKET",
    # date / time
    "ADD_MONTHS", "MONTHS_BETWEEN", "NEXT_DAY", "LAST_DAY",
    "EXTRACT", "SYSDATE", "SYSTIMESTAMP", "CURRENT_DATE", "CURRENT_TIMESTAMP",
    "LOCALTIMESTAMP", "DBTIMEZONE", "SESSIONTIMEZONE", "NEW_TIME",
    "NUMTODSINTERVAL", "NUMTOYMINTERVAL", "TO_DSINTERVAL", "TO_YMINTERVAL",
    "TZ_OFFSET", "FROM_TZ", "SYS_EXTRACT_UTC",
    # aggregate
    "COUNT", "SUM", "AVG", "MIN", "MAX", "STDDEV", "VARIANCE", "LISTAGG",
    "MEDIAN", "STATS_MODE", "PERCENTILE_CONT", "PERCENTILE_DISC",
    "CORR", "COVAR_POP", "COVAR_SAMP", "REGR_SLOPE", "REGR_INTERCEPT",
    "CUME_DIST", "PERCENT_RANK", "NTILE",
    # analytic
    "ROW_NUMBER", "RANK", "DENSE_RANK", "LEAD", "LAG",
    "FIRST_VALUE", "LAST_VALUE", "NTH_VALUE", "RATIO_TO_REPORT",
    # other
    "ROWNUM", "ROWID", "LEVEL", "USER", "UID", "SYS_GUID",
    "USERENV", "SYS_CONTEXT", "DUMP", "VSIZE", "ORA_HASH",
    "EMPTY_BLOB", "EMPTY_CLOB", "BFILENAME", "XMLELEMENT", "XMLFOREST",
    "XMLAGG", "XMLROOT", "XMLPARSE", "XMLSERIALIZE",
]

# Placeholder and date substitutions of SQL cleaning.
PLACEHOLDER_DATE = "DATE '2025-09-30'"
PLACEHOLDER_MACROS = ["VARTECHSRC", "PERIMETER"]
PLSQL_END_FOLLOWERS = ["LOOP", "IF", "FUNCTION", "PROCEDURE", "PACKAGE"]

# Table-name layer prefixes and their display order.
LAYER_PREFIXES = [("src_", "SRC"), ("stg_", "STG"), ("dim_", "DIM"), ("fact_", "FACT"), ("rpt_", "RPT")]
LAYER_ORDER = {"SRC": 0, "STG": 1, "DIM": 2, "FACT": 2, "RPT": 3, "OTH": 4}

# Identifier token and dotted pair (ASCII, case-insensitive).
IDENT = r"[A-Za-z_][A-Za-z0-9_]*"

# ----------------------------------------------------------------------------
# Derived patterns
# ----------------------------------------------------------------------------


def _ws_pattern(p: str) -> str:
    """Swap Python's ``\\s`` for the explicit WS class."""
    return p.replace(r"\s", WS)


# A repeated group over a literal's inside would recurse once per quote pair in
# Java, so patterns that end with a literal are tested in two steps: the text
# without doubled quotes against the flat literal form, which is the same set.
# Where anything may follow the literal, its first closing quote is enough.
QUOTED = r"'(?:[^']|'')*'"
CONSTANT_REGEX = "(?i)" + "|".join(
    _ws_pattern(p).replace(QUOTED, LITERAL) for p in CONSTANT_PATTERNS if not p.endswith(QUOTED + "$"))
LITERAL_CONSTANT_REGEX = "(?i)" + "|".join(
    _ws_pattern(p).replace(QUOTED, LITERAL) for p in CONSTANT_PATTERNS if p.endswith(QUOTED + "$"))

# A token (optionally dotted) preceded by start or a non-word character.
REF_TOKEN = rf"(?:^|[^A-Za-z0-9_])({IDENT}(?:\.{IDENT})?)"
DOTTED_PAIR = rf"(?:^|[^A-Za-z0-9_])({IDENT})\.({IDENT})"
COMMENTS = r"('[^']*(?:'|\z))|--[^\n]*|(?s:/\*.*?(?:\*/|\z))"
# Object name of a bulk chunk: text of the first /* .. */ on one line.
BULK_NAME = r"/\*" + WS + r"*([^\n]*?)" + WS + r"*\*/"
# Blank-line separator of bulk SQL text.
BULK_SEPARATOR = "\n" + WS + "*\n"

# ----------------------------------------------------------------------------
# Helpers
# ----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove outer whitespace of any kind."""
    return F.regexp_replace(_c(c), rf"^{WS}+|{WS}+$", "")


def word_count(c, word: str) -> Column:
    """Occurrences of ``word`` as a whole word (Python ``\\b`` semantics)."""
    tokens = F.split(_c(c), rf"{NON_WORD}+", -1)
    return F.size(F.filter(tokens, lambda t: t == F.lit(word))).cast("long")


def char_count(c, ch: str) -> Column:
    col = _c(c)
    return (F.length(col) - F.length(F.replace(col, F.lit(ch), F.lit("")))).cast("long")


def substring_count(c, sub: str) -> Column:
    """Non-overlapping occurrences of ``sub`` (Python ``str.count``)."""
    col = _c(c)
    return ((F.length(col) - F.length(F.replace(col, F.lit(sub), F.lit("")))) / len(sub)).cast("long")


# ----------------------------------------------------------------------------
# B1-B6
# ----------------------------------------------------------------------------


def normalize_ws(c) -> Column:
    """B2: collapse whitespace runs to one blank and trim; NULL -> ''."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), f"{WS}+", " "))


def clean_text(c) -> Column:
    """B1: like B2, and the text 'nan' (any case) also becomes ''."""
    v = normalize_ws(c)
    return F.when(F.lower(v) == "nan", F.lit("")).otherwise(v)


def normalize_identifier(c) -> Column:
    """B2, strip one pair of surrounding double quotes, upper case."""
    v = normalize_ws(c)
    quoted = v.startswith('"') & v.endswith('"')
    inner = F.substring(v, F.lit(2), F.greatest(F.length(v) - 2, F.lit(0)))
    return F.upper(F.when(quoted, inner).otherwise(v))


def _split_literals(c: Column):
    segs = F.split(c, LITERAL, -1)
    lits = F.concat(F.regexp_extract_all(c, F.lit(f"({LITERAL})"), 1), F.array(F.lit("")))
    return segs, lits


def normalize_expression(c) -> Column:
    """Collapse blanks and upper-case outside quoted literals; trim."""
    col = F.coalesce(_c(c), F.lit(""))
    segs, lits = _split_literals(col)
    outside = F.transform(segs, lambda s: F.upper(F.regexp_replace(s, f"{WS}+", " ")))
    joined = F.array_join(F.zip_with(outside, lits, lambda s, l: F.concat(s, F.coalesce(l, F.lit("")))), "")
    return F.trim(joined)


def is_constant(c) -> Column:
    """The stripped value is an Oracle constant (23 patterns)."""
    return F.coalesce(constant_text(py_strip(_c(c))), F.lit(False))


def constant_text(v: Column) -> Column:
    """Whether a stripped text is a constant (NULL stays NULL)."""
    # pairs are counted from behind the quote that opens the literal
    at = F.instr(v, "'")
    inside = F.regexp_replace(F.substring(v, at + 1, F.length(v)), "''", "")
    flat = F.when(at > 0, F.concat(F.substring(v, F.lit(1), at), inside)).otherwise(v)
    return v.rlike(CONSTANT_REGEX) | flat.rlike(LITERAL_CONSTANT_REGEX)


def parse_ref(c) -> Column:
    """struct(alias, column) of ``ALIAS.COLUMN`` or ``COLUMN`` (alias NULL)."""
    v = F.upper(normalize_ws(c))
    parts = F.split(v, r"\.", 2)
    has_dot = F.size(parts) > 1
    return F.struct(
        F.when(has_dot, F.trim(parts[0])).alias("alias"),
        F.when(has_dot, F.trim(parts[1])).otherwise(F.trim(v)).alias("column"),
    )


# ----------------------------------------------------------------------------
# Statement checks and cleaning
# ----------------------------------------------------------------------------


def validate_sql(c) -> Column:
    """struct(valid, message, warnings) of a statement text."""
    sql = F.coalesce(_c(c), F.lit(""))
    stripped = py_strip(sql)
    opens, closes = char_count(sql, "("), char_count(sql, ")")
    has_select = word_count(F.upper(sql), "SELECT") > 0
    message = (
        F.when(stripped == "", F.lit("SQL file is empty or whitespace only"))
        .when(F.length(stripped) < 10,
              F.format_string("SQL too short (%d chars), likely invalid", F.length(sql)))
        .when(~has_select, F.lit("No SELECT keyword found"))
    )
    warnings = F.array_compact(F.array(
        F.when(sql.rlike(f"(?i)(?:^|{NON_WORD})EXECUTE{WS}+IMMEDIATE(?:{NON_WORD}|$)"),
               F.lit("Contains EXECUTE IMMEDIATE - dynamic SQL cannot be fully traced")),
        F.when(sql.rlike(f"@{WORD}"), F.lit("Contains DB links (@) - remote tables may not resolve")),
        F.when(opens != closes,
               F.format_string("Unbalanced parentheses: %d open, %d close", opens, closes)),
    ))
    valid = message.isNull()
    return F.struct(
        valid.alias("valid"),
        F.coalesce(message, F.lit("")).alias("message"),
        F.when(valid, warnings).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def strip_comments(c) -> Column:
    """Drop ``--`` and ``/* */`` comments outside quoted literals.

    ``--`` drops to the end of the line (the newline stays); an unterminated
    block comment drops the rest; an unterminated literal keeps the rest.
    """
    return F.regexp_replace(_c(c), COMMENTS, "$1")


def _where(s: Column, literal: str, step) -> Column:
    """``step`` for the texts that hold ``literal``, without which it changes nothing; ``s`` is evaluated once."""
    return F.transform(F.array(s), lambda x: F.when(x.contains(literal), step(x)).otherwise(x))[0]


def normalize_sql(c) -> Column:
    """The reference's cleaning chain, in its order; a rule that needs a
    certain character is tried on the texts that have it."""
    def macros(s):
        for macro in PLACEHOLDER_MACROS:
            s = F.regexp_replace(s, rf"(?i)\[{macro}\]", f"'PLACEHOLDER_{macro}'")
        return s

    def variables(s):
        s = F.regexp_replace(s, r"(?i)'\$([A-Z_][A-Z0-9_]*)'", "'PLACEHOLDER_$1'")
        s = F.regexp_replace(s, r"(?i)\$([A-Z_]*DATE[A-Z0-9_]*)\b", PLACEHOLDER_DATE)
        return F.regexp_replace(s, r"(?i)\$([A-Z_][A-Z0-9_]*)\b", "'PLACEHOLDER_$1'")

    s = F.coalesce(_c(c), F.lit(""))
    s = _where(s, "\x1b", lambda x: F.regexp_replace(x, r"\x{1B}\[[0-9;]*m", ""))
    s = _where(s, "[", lambda x: F.regexp_replace(x, r"(?i)esc\[[0-9;]*m", ""))
    s = F.regexp_replace(s, r"[\x{2003}\x{2002}\x{2001}\x{2000}\x{A0}]+", " ")
    s = _where(s, "[", macros)
    s = _where(s, "$", variables)
    s = _where(s, "~", lambda x: F.regexp_replace(x, _ws_pattern(r"\|\|\s*~\s*\|\|"), "|| '~' ||"))
    # a name and the blanks behind it are never given back: no shorter match could go on
    s = F.regexp_replace(s, _ws_pattern(r"(?i)\b([A-Z_][A-Z0-9_]*+)\s++AS\s++\1\b"), "$1")
    s = _where(s, "\\'", lambda x: F.regexp_replace(x, r"\\'", "''"))
    s = strip_comments(s)
    return normalize_ws(s)


def diagnose_sql(c) -> Column:
    """Hints for a statement that failed to parse (array of texts)."""
    sql = F.coalesce(_c(c), F.lit(""))
    up = F.upper(sql)
    cases = word_count(up, "CASE")
    followers = "|".join(PLSQL_END_FOLLOWERS)
    plsql_ends = F.size(F.regexp_extract_all(
        up, F.lit(f"(?:^|{NON_WORD})(END{WS}+(?:{followers}))"), 1)).cast("long")
    ends = word_count(up, "END") - plsql_ends
    opens, closes = char_count(sql, "("), char_count(sql, ")")
    quotes = char_count(sql, "'") - substring_count(sql, "''") * 2
    return F.array_compact(F.array(
        F.when(cases != ends, F.format_string("CASE/END mismatch: %d CASE vs %d END", cases, ends)),
        F.when(opens != closes,
               F.format_string("Parentheses mismatch: %d '(' vs %d ')'", opens, closes)),
        F.when(F.pmod(quotes, F.lit(2)) != 0,
               F.lit("Possible unclosed string literal (odd number of single quotes)")),
    ))


# ----------------------------------------------------------------------------
# references
# ----------------------------------------------------------------------------


def mask_literals(c, mark: str = "__LIT__") -> Column:
    return F.regexp_replace(_c(c), LITERAL, mark)


def column_refs(c) -> Column:
    """Column references of an expression, order and duplicates kept.

    Literals are masked, blanks around dots removed, then every ``A`` or
    ``A.B`` token that is not a keyword, an (undotted) known function, a
    literal mark or a constant word is a reference (upper-cased).
    """
    masked = mask_literals(F.coalesce(_c(c), F.lit("")))
    tight = F.regexp_replace(masked, rf"{WS}*\.{WS}*", ".")
    tokens = F.transform(F.regexp_extract_all(tight, F.lit(REF_TOKEN), 1), lambda t: F.upper(t))
    keywords = F.array(*[F.lit(k) for k in SQL_KEYWORDS])
    functions = F.array(*[F.lit(k) for k in KNOWN_FUNCTIONS])
    return F.filter(
        tokens,
        lambda t: ~F.array_contains(keywords, t)
        & ~(~t.contains(".") & F.array_contains(functions, t))
        & ~t.startswith("__LIT")
        & ~constant_text(t),
    )


def simple_refs(c) -> Column:
    """Distinct upper-cased ``TABLE.COLUMN`` pairs in raw text.

    Returns an array of struct(table, column); comments and literals are
    not masked (as in the reference's QA check).
    """
    col = F.coalesce(_c(c), F.lit(""))
    # one pass over the text; a first name is never given back, as no dot could follow inside it
    pair = rf"(?:^|[^A-Za-z0-9_])({IDENT}+)\.({IDENT})"
    return F.array_distinct(F.transform(F.regexp_extract_all(col, F.lit(pair), 0), lambda p: F.struct(
        F.upper(F.regexp_extract(p, pair, 1)).alias("table"), F.upper(F.regexp_extract(p, pair, 2)).alias("column"))))


def has_scalar_subquery(c) -> Column:
    """The expression holds ``( SELECT``."""
    return F.coalesce(_c(c).rlike(_ws_pattern(r"(?i)\(\s*SELECT(?:[^\p{L}\p{N}_]|$)")), F.lit(False))


def common_char_score(target, candidate) -> Column:
    """B13 score: characters of target found in candidate / longer length."""
    t, k = F.upper(_c(target)), F.upper(_c(candidate))
    chars = F.split(t, "", -1)
    chars = F.filter(chars, lambda ch: ch != "")
    common = F.aggregate(chars, F.lit(0), lambda acc, ch: acc + F.when(F.instr(k, ch) > 0, 1).otherwise(0))
    return common / F.greatest(F.length(t), F.length(k))


# ----------------------------------------------------------------------------
# Labels and keys
# ----------------------------------------------------------------------------


def statement_kind(c) -> Column:
    """MERGE / INSERT by the leading keyword of the cleaned text, else OTHER."""
    lead = F.upper(F.regexp_extract(normalize_sql(c), r"^\(*" + WS + r"*([A-Za-z]+)", 1))
    return F.when(lead == "MERGE", "MERGE").when(lead == "INSERT", "INSERT").otherwise("OTHER")


def join_type_label(side, kind) -> Column:
    """``SIDE JOIN``, else ``KIND JOIN``, else ``INNER JOIN``."""
    s, k = F.upper(F.coalesce(_c(side), F.lit(""))), F.upper(F.coalesce(_c(kind), F.lit("")))
    return (F.when(s != "", F.concat(s, F.lit(" JOIN")))
            .when(k != "", F.concat(k, F.lit(" JOIN")))
            .otherwise(F.lit("INNER JOIN")))


def table_layer(c) -> Column:
    """SRC / STG / DIM / FACT / RPT by name prefix, else OTH."""
    low = F.lower(F.coalesce(_c(c), F.lit("")))
    out = None
    for prefix, layer in LAYER_PREFIXES:
        cond = low.startswith(prefix)
        out = F.when(cond, F.lit(layer)) if out is None else out.when(cond, F.lit(layer))
    return out.otherwise(F.lit("OTH"))


def layer_order(layer) -> Column:
    out = None
    for name, pos in LAYER_ORDER.items():
        cond = _c(layer) == name
        out = F.when(cond, F.lit(pos)) if out is None else out.when(cond, F.lit(pos))
    return out.otherwise(F.lit(4))


def mapping_class(c) -> Column:
    """Join / lookup / transform (also calc) / map class of a mapping type."""
    low = F.lower(F.coalesce(_c(c), F.lit("")))
    return (F.when(low.contains("join"), "join-type")
            .when(low.contains("lookup"), "lookup-type")
            .when(low.contains("transform") | low.contains("calc"), "transform-type")
            .otherwise("map-type"))


def mapping_key(sql_file, dest_table, dest_field, source_table, source_field) -> Column:
    """Composite text key of a mapping edge."""
    return F.concat_ws("|", *[F.coalesce(_c(x), F.lit("")) for x in
                              (sql_file, dest_table, dest_field, source_table, source_field)])


def join_key(sql_file, join_seq, left_table, left_field, right_table, right_field) -> Column:
    """Composite text key of a join."""
    return F.concat_ws("|", *[F.coalesce(_c(x).cast("string"), F.lit("")) for x in
                              (sql_file, join_seq, left_table, left_field, right_table, right_field)])


def strip_target_prefix(col, alias, table) -> Column:
    """Remove a leading ``ALIAS.`` or ``TABLE.`` from a SET target."""
    c, a, t = _c(col), F.coalesce(_c(alias), F.lit("")), F.coalesce(_c(table), F.lit(""))
    a_pre, t_pre = F.concat(a, F.lit(".")), F.concat(t, F.lit("."))
    return (F.when((a != "") & c.startswith(a_pre), F.substring(c, F.length(a_pre) + 1, 1 << 30))
            .when((t != "") & c.startswith(t_pre), F.substring(c, F.length(t_pre) + 1, 1 << 30))
            .otherwise(c))


def original_ref(alias, field) -> Column:
    """``ALIAS.FIELD``, or the field alone."""
    return F.concat_ws(".", F.nullif(_c(alias), F.lit("")), _c(field))
