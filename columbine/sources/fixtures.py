"""Derived inputs built from the driver's tables.

The reference ships no sample inputs, so the inputs (mapping tables,
data model, SQL statements, scope catalog) are derived from the TPC-H-like
tables in plain SQL that runs unchanged on Spark and on DuckDB.  The same
text therefore feeds the Spark queries (``spark_fixture``) and the DuckDB
oracle (``duckdb_with``), so both sides see identical input rows.

These recipes only shape rows into the schemas the operators expect; every
result is computed by the operators in ``columbine.operators``.

Placeholders ``{name}`` refer to a driver table or to another fixture.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

FIXTURES: dict[str, str] = {}

# --- mapping tables ---------------------------------------------------------
# A DAG of depth 3: SRC -> STG -> DIM -> RPT.  row_ord stands for the row
# position a spreadsheet would give (later rows win on duplicate keys).
FIXTURES["map_v1"] = """
select concat('SRC_O', o_orderkey % 20) as source_table, concat('K', o_orderkey) as source_field,
       concat('STG_C', o_custkey % 40) as dest_table, concat('K', o_custkey) as dest_field,
       o_orderpriority as rules,
       case o_orderstatus when 'F' then 'MAP' when 'O' then 'JOIN' else 'TRANSFORM' end as mapping_type,
       concat('T2T_C', o_custkey % 40) as object_name,
       o_orderkey * 4 as row_ord
from {orders}
union all
select concat('STG_C', c_custkey % 40), concat('K', c_custkey), concat('DIM_N', c_nationkey),
       concat('K', c_custkey % 9), c_mktsegment, 'MAP', concat('T2T_N', c_nationkey),
       c_custkey * 4 + 1
from {customer}
union all
select concat('SRC_S', s_suppkey % 10), concat('K', s_suppkey), concat('DIM_N', s_nationkey),
       concat('K', s_suppkey % 9), 'SUPP', 'LOOKUP', concat('T2T_N', s_nationkey),
       s_suppkey * 4 + 2
from {supplier}
union all
select distinct concat('DIM_N', n_nationkey), concat('K', c_custkey % 9), concat('RPT_R', n_regionkey),
       concat('K', c_custkey % 9), 'ROLL', 'MAP', concat('T2T_R', n_regionkey),
       (n_nationkey * 16 + c_custkey % 9) * 4 + 3
from {nation} join {customer} on c_nationkey = n_nationkey
"""

# v2: map_v1 without fields ending in 3, rules changed where the field ends
# in 7, plus one new source per part.
FIXTURES["map_v2"] = """
select source_table, source_field, dest_table, dest_field,
       case when source_field like '%7' then concat(rules, '_V2') else rules end as rules,
       mapping_type, object_name, row_ord
from {map_v1} where source_field not like '%3'
union all
select concat('SRC_P', p_partkey % 10), concat('K', p_partkey), concat('STG_C', p_partkey % 40),
       concat('K', p_partkey), p_brand, 'MAP', concat('T2T_C', p_partkey % 40),
       p_partkey * 4 + 100000000000
from {part}
"""

# map_v1 plus four edges from a report table back to sources: a cyclic graph.
FIXTURES["map_cyclic"] = """
select source_table, source_field, dest_table, dest_field, rules, mapping_type, object_name, row_ord
from {map_v1}
union all
select 'RPT_R1', 'K4', concat('SRC_O', k), concat('K', k), 'BACK', 'MAP', 'T2T_BACK', 900000000000 + k
from (values (0), (4), (8), (12)) as v(k)
"""

# Duplicate keys: fields ending in 1 get a later copy (it wins), fields
# ending in 2 an earlier copy (the original wins).
FIXTURES["map_dup"] = """
select source_table, source_field, dest_table, dest_field, rules, mapping_type, object_name,
       row_ord * 2 as row_ord
from {map_v1}
union all
select source_table, source_field, dest_table, dest_field, concat(rules, '_LATE'), mapping_type,
       object_name, row_ord * 2 + 1
from {map_v1} where source_field like '%1'
union all
select source_table, source_field, dest_table, dest_field, concat(rules, '_EARLY'), 'TRANSFORM',
       object_name, row_ord * 2 - 1
from {map_v1} where source_field like '%2'
"""

# --- data model and column catalog ------------------------------------------
FIXTURES["dm_pairs"] = """
select table_name, column_name,
       row_number() over (partition by table_name order by column_name) as ordinal
from (
  select source_table as table_name, source_field as column_name from {map_v1}
  union
  select dest_table, dest_field from {map_v1}
) as t
where column_name not like '%5'
"""

FIXTURES["column_catalog"] = """
select table_name, column_name, 'VARCHAR2' as data_type,
       ordinal = 1 as is_pk, column_name like '%7' as is_fk, '' as description, ordinal
from {dm_pairs}
"""

# Column names of a table per brand, and names near to them: cut words, digits
# behind, and tables without columns.
FIXTURES["named_columns"] = """
select concat('PRODUCT_', p_brand) as table_name,
       upper(concat(p_type, '_', replace(p_name, ' ', '_'), '_', p_size)) as column_name, p_partkey as ordinal
from {part}
"""

FIXTURES["near_names"] = """
select concat('p', p_partkey) as name_id, concat('PRODUCT_', p_brand) as table_name,
       concat(substr(p_type, 1, 4), '_', replace(p_name, ' ', ''), p_size) as target
from {part}
union all
select concat('s', s_suppkey), concat('PRODUCT_Brand#', s_nationkey), s_name from {supplier}
"""

# --- SQL statements ---------------------------------------------------------
FIXTURES["stmts"] = """
select s_suppkey as stmt_id, concat('T2T_N', s_nationkey, '_', s_suppkey) as sql_file,
 concat('T2T_N', s_nationkey, '_', s_suppkey) as object_name,
 case s_suppkey % 6
 when 0 then concat('/* T2T_A */ INSERT INTO DIM_N', s_nationkey, ' (K1,K2) SELECT S.C1, S.C2 AS C2 FROM SRC_S', s_suppkey % 10, ' S -- tail S.GONE')
 when 1 then concat('MERGE INTO DIM_N', s_nationkey, ' T USING (SELECT A.K1, B.V2 FROM SRC_S', s_suppkey % 10, ' A LEFT JOIN STG_C', s_suppkey % 40, ' B ON A.K1 = B.K1 AND B.D > $MISDATE) SRC ON (T.K1 = SRC.K1) WHEN MATCHED THEN UPDATE SET T.V2 = SRC.V2')
 when 2 then concat('SELECT X.C1 || ~ || X.C2, ''a--b'' FROM T', s_suppkey, '@LNK X WHERE X.P = [PERIMETER]')
 when 3 then 'BEGIN EXECUTE IMMEDIATE V_SQL; END; -- SELECT'
 when 4 then concat('INSERT INTO T SELECT NVL(Q.C1, 0) FROM SRC_S', s_suppkey % 10, ' Q WHERE (Q.C2 = 1')
 else 'COMMIT;' end as sql_text
from {supplier}
"""

# Statements plus free prose: the text jobs must hold on both.
FIXTURES["texts"] = """
select stmt_id as text_id, 'stmt' as kind, sql_text as text from {stmts}
union all
select doc_id + 1000000000 as text_id, 'doc' as kind, text from {documents}
"""

# --- scope catalog ------------------------------------------------------------
# Per supplier: ROOT selects from subquery A, A joins subquery B and a
# physical DIM table, B reads a physical SRC table.
FIXTURES["scopes"] = """
select s_suppkey as stmt_id, k as scope_id, case when k = 0 then null else k - 1 end as parent_id,
       case k when 0 then 'ROOT' when 1 then 'ROOT/A' else 'ROOT/A/B' end as scope_name,
       case k when 0 then 'ROOT' else 'SUBQUERY' end as kind
from {supplier} cross join (values (0), (1), (2)) as v(k)
"""

FIXTURES["relations"] = """
select s_suppkey as stmt_id, 0 as scope_id, 0 as ord, 'A' as alias, 'SCOPE' as rel_kind,
       cast(null as varchar(20)) as table_name, 1 as child_scope_id from {supplier}
union all select s_suppkey, 1, 0, 'B', 'SCOPE', null, 2 from {supplier}
union all select s_suppkey, 1, 1, 'N', 'PHYSICAL', concat('DIM_N', s_nationkey), null from {supplier}
union all select s_suppkey, 2, 0, 'P', 'PHYSICAL', concat('SRC_S', s_suppkey % 10), null from {supplier}
"""

FIXTURES["projections"] = """
select s_suppkey as stmt_id, 0 as scope_id, 0 as ord, 'OUT1' as output_name, 'A.X1 + A.X2' as expression from {supplier}
union all select s_suppkey, 0, 1, 'OUT2', 'A.X3' from {supplier}
union all select s_suppkey, 1, 0, 'X1', 'NVL(B.Y1, N.NAME)' from {supplier}
union all select s_suppkey, 1, 1, 'X2', 'B.Y2' from {supplier}
union all select s_suppkey, 1, 2, 'X3', case when s_suppkey % 4 = 0 then 'SYSDATE' when s_suppkey % 4 = 1 then 'B.MISSING' when s_suppkey % 4 = 2 then 'Z.Q' else 'B.Y1' end from {supplier}
union all select s_suppkey, 2, 0, 'Y1', concat('P.C', s_suppkey % 5) from {supplier}
union all select s_suppkey, 2, 1, 'Y2', '''lit''' from {supplier}
"""

# UNPIVOT in scope 2 and an EXISTS body in scope 1 (alias N is taken there).
FIXTURES["unpivots"] = """
select s_suppkey as stmt_id, 2 as scope_id, concat('AMT', s_suppkey % 3) as value_col, 'KIND' as for_col from {supplier}
"""

FIXTURES["exists_tables"] = """
select s_suppkey as stmt_id, 1 as scope_id, 'E' as alias, concat('STG_C', s_suppkey % 40) as table_name from {supplier}
union all select s_suppkey, 1, 'N', 'OTHER_T' from {supplier}
union all select s_suppkey, 1, null, concat('SRC_S', s_suppkey % 7) from {supplier}
"""

# --- DML parts (same statements as the scope catalog) ------------------------
# Odd suppliers are MERGE statements, even ones INSERT ... SELECT.
FIXTURES["root_scopes"] = """
select s_suppkey as stmt_id, 0 as scope_id, concat('DIM_N', s_nationkey) as target_table,
       case when s_suppkey % 2 = 1 then 'MERGE' else 'INSERT' end as stmt_type
from {supplier}
"""

FIXTURES["merge_sets"] = """
select s_suppkey as stmt_id, 0 as when_ord, k as pos, concat('DIM_N', s_nationkey) as target_table, 'T' as target_alias,
       case k when 0 then 'T.OUT1' when 1 then ' out2 ' else concat('DIM_N', s_nationkey, '.OUT3') end as target,
       case k when 0 then 'A.X1 + A.X2' when 1 then 'A.X3' else 'A.X2' end as expression
from {supplier} cross join (values (0), (1), (2)) as v(k) where s_suppkey % 2 = 1
"""

FIXTURES["merge_insert_cols"] = """
select s_suppkey as stmt_id, 1 as when_ord, k as pos, case k when 0 then 'OUT1' when 1 then 'OUT4' else 'OUT5' end as col
from {supplier} cross join (values (0), (1), (2)) as v(k) where s_suppkey % 2 = 1
"""

FIXTURES["merge_insert_vals"] = """
select s_suppkey as stmt_id, 1 as when_ord, k as pos, case k when 0 then 'A.X3' else 'SYSDATE' end as val
from {supplier} cross join (values (0), (1)) as v(k) where s_suppkey % 2 = 1
"""

FIXTURES["insert_cols"] = """
select s_suppkey as stmt_id, concat('DIM_N', s_nationkey) as target_table, k as pos, concat('K', k + 1) as target_column
from {supplier} cross join (values (0), (1), (2)) as v(k) where s_suppkey % 4 = 0
"""

FIXTURES["join_conjuncts"] = """
select s_suppkey as stmt_id, 1 as scope_id, 0 as join_pos, 'LEFT' as side, '' as kind, 'N' as right_alias, k as conj_pos,
       case k when 0 then 'B.Y1 = N.NAME' when 1 then 'N.D > DATE ''2024-01-01''' when 2 then 'N.S IN (''X'')'
              else concat('ATOMIC.DIM_N', s_nationkey, ' IS NOT NULL') end as condition
from {supplier} cross join (values (0), (1), (2), (3)) as v(k)
union all
select s_suppkey, 1, 1, '', 'CROSS', 'Z', 0, cast(null as varchar(10)) from {supplier}
union all
select s_suppkey, 1, 2, '', '', 'N', 0, 'B.Y2 = ''Z''' from {supplier}
"""

FIXTURES["merge_on"] = """
select s_suppkey as stmt_id, k as conj_pos, concat('DIM_N', s_nationkey) as target_table, 'T' as target_alias,
       'A' as using_alias,
       case k when 0 then 'T.K1 = A.X1' when 1 then 'K2 = A.X2' else 'T.F = A.X3' end as condition
from {supplier} cross join (values (0), (1), (2)) as v(k) where s_suppkey % 2 = 1
"""

# --- v1 mapping spec ------------------------------------------------------------
FIXTURES["mapping_spec"] = """
select case when k = 3 then 'OTHER' else 'T2T' end as type,
       concat(' t2t_n', s_nationkey, '_', s_suppkey, ' ') as name,
       concat('DIM_N', s_nationkey) as target_table, concat('OUT', k) as target_column,
       case when k = 0 then concat('SRC_S', s_suppkey % 10) when k = 1 then 'EXPRESSION' else '' end as source_table,
       case when k = 0 then 'C1' when k = 1 then 'C2' else '' end as source_column,
       case when k = 2 then 'A.X1 + 1' else '' end as expression
from {supplier} cross join (values (0), (1), (2), (3)) as v(k)
"""

# Resume manifest: half the objects ran before, some re-ran later.
FIXTURES["manifest"] = """
select object_name, case when stmt_id % 3 = 0 then 'success' when stmt_id % 3 = 1 then 'failed' else 'skipped' end as status,
       1 as run_ord from {stmts} where stmt_id % 2 = 0
union all
select object_name, 'success', 2 from {stmts} where stmt_id % 4 = 1
"""

# --- star and union catalogs ---------------------------------------------------
# ROOT selects *, S.* and one column over subquery S, a DM table and a table
# outside the DM; S selects a column, * over a DM table, and the column again.
FIXTURES["star_scopes"] = """
select s_suppkey as stmt_id, k as scope_id, case when k = 0 then null else 0 end as parent_id,
       case k when 0 then 'ROOT' else 'ROOT/S' end as scope_name, case k when 0 then 'ROOT' else 'SUBQUERY' end as kind,
       cast(null as int) as branch_ord
from {supplier} cross join (values (0), (1)) as v(k)
"""

FIXTURES["star_relations"] = """
select s_suppkey as stmt_id, 0 as scope_id, 0 as ord, 'S' as alias, 'SCOPE' as rel_kind, cast(null as varchar(20)) as table_name, 1 as child_scope_id from {supplier}
union all select s_suppkey, 0, 1, 'D', 'PHYSICAL', concat('DIM_N', s_nationkey), null from {supplier}
union all select s_suppkey, 0, 2, 'X', 'PHYSICAL', 'EXT_T', null from {supplier}
union all select s_suppkey, 1, 0, 'P', 'PHYSICAL', concat('SRC_S', s_suppkey % 10), null from {supplier}
"""

FIXTURES["star_projections"] = """
select s_suppkey as stmt_id, 1 as scope_id, 0 as ord, 'C1' as output_name, 'P.C1' as expression,
       cast(null as varchar(10)) as star_kind, cast(null as varchar(10)) as star_alias from {supplier}
union all select s_suppkey, 1, 1, '*', '*', 'ALL', null from {supplier}
union all select s_suppkey, 1, 2, 'C1', 'P.C1 + 1', null, null from {supplier}
union all select s_suppkey, 0, 0, '*', '*', 'ALL', null from {supplier}
union all select s_suppkey, 0, 1, '*', 'S.*', 'QUALIFIED', 'S' from {supplier}
union all select s_suppkey, 0, 2, 'EXTRA', 'D.K1', null, null from {supplier}
"""

FIXTURES["union_scopes"] = """
select s_suppkey as stmt_id, k as scope_id,
       case k when 0 then null when 1 then 0 when 2 then 1 when 3 then 1 else 3 end as parent_id,
       case k when 0 then 'ROOT' when 1 then 'ROOT/U' when 2 then 'ROOT/U/B1' when 3 then 'ROOT/U/B2' else 'ROOT/U/B2/Q' end as scope_name,
       case k when 0 then 'ROOT' when 1 then 'UNION' when 4 then 'SUBQUERY' else 'UNION_BRANCH' end as kind,
       case k when 2 then 0 when 3 then 1 end as branch_ord
from {supplier} cross join (values (0), (1), (2), (3), (4)) as v(k)
"""

FIXTURES["union_relations"] = """
select s_suppkey as stmt_id, 0 as scope_id, 0 as ord, 'U' as alias, 'SCOPE' as rel_kind, cast(null as varchar(20)) as table_name, 1 as child_scope_id from {supplier}
union all select s_suppkey, 2, 0, 'P', 'PHYSICAL', concat('SRC_S', s_suppkey % 10), null from {supplier}
union all select s_suppkey, 3, 0, 'Q', 'SCOPE', null, 4 from {supplier}
union all select s_suppkey, 3, 1, 'R', 'PHYSICAL', concat('STG_C', s_suppkey % 40), null from {supplier}
union all select s_suppkey, 4, 0, 'Z', 'PHYSICAL', concat('DIM_N', s_nationkey), null from {supplier}
"""

FIXTURES["union_projections"] = """
select s_suppkey as stmt_id, 2 as scope_id, 0 as ord, 'N1' as output_name, 'P.A' as expression from {supplier}
union all select s_suppkey, 2, 1, 'N2', 'NVL(B, 0)' from {supplier}
union all select s_suppkey, 3, 0, 'M1', 'C' from {supplier}
union all select s_suppkey, 3, 1, 'M2', 'Q.D + E' from {supplier}
union all select s_suppkey, 4, 0, 'C', 'Z.C' from {supplier}
union all select s_suppkey, 4, 1, 'D', 'Z.D' from {supplier}
"""

# A CTE defined on ROOT (name W) and shadowed by another W inside S.
FIXTURES["cte_scopes"] = """
select s_suppkey as stmt_id, k as scope_id, case k when 0 then null when 1 then 0 when 2 then 0 when 3 then 2 end as parent_id,
       case k when 0 then 'ROOT' when 1 then 'ROOT/CTE:W' when 2 then 'ROOT/S' else 'ROOT/S/CTE:W' end as scope_name,
       case k when 0 then 'ROOT' when 2 then 'SUBQUERY' else 'CTE' end as kind, cast(null as int) as branch_ord
from {supplier} cross join (values (0), (1), (2), (3)) as v(k)
"""

FIXTURES["cte_relations"] = """
select s_suppkey as stmt_id, 0 as scope_id, 0 as ord, 'A' as alias, 'PHYSICAL' as rel_kind, 'W' as table_name, cast(null as int) as child_scope_id from {supplier}
union all select s_suppkey, 0, 1, 'S', 'SCOPE', null, 2 from {supplier}
union all select s_suppkey, 2, 0, 'B', 'PHYSICAL', 'w', null from {supplier}
union all select s_suppkey, 2, 1, 'C', 'PHYSICAL', concat('SRC_S', s_suppkey % 10), null from {supplier}
"""

# Scalar subqueries in expressions of scope 0: scope 7 is the subquery's own.
FIXTURES["scalars"] = """
select s_suppkey as stmt_id, 0 as scope_id, 0 as expr_id, 7 as sub_scope_id,
       concat('(SELECT MAX(T.X) + COUNT(K) FROM SRC_S', s_suppkey % 10, ' T WHERE T.K = A.X', s_suppkey % 3 + 1,
              ' AND A.X3 = ''A.LIT'')') as subquery
from {supplier}
"""

FIXTURES["scalar_relations"] = """
select s_suppkey as stmt_id, 7 as scope_id, 0 as ord, 'T' as alias, 'PHYSICAL' as rel_kind,
       concat('SRC_S', s_suppkey % 10) as table_name, cast(null as int) as child_scope_id
from {supplier}
"""

FIXTURES["scalar_projections"] = """
select s_suppkey as stmt_id, 7 as scope_id, 0 as ord, 'M' as output_name, 'MAX(T.X) + COUNT(K)' as expression from {supplier}
"""

# Nested scopes that read a column twice at every level: 2^(s_suppkey % 12) paths.
FIXTURES["chain_scopes"] = """
select s_suppkey as stmt_id, k as scope_id, case when k = 0 then null else k - 1 end as parent_id,
       concat('L', k) as scope_name, case k when 0 then 'ROOT' else 'SUBQUERY' end as kind, cast(null as int) as branch_ord
from {supplier} cross join (values (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) as v(k)
where k <= s_suppkey % 12
"""

FIXTURES["chain_relations"] = """
select stmt_id, scope_id, 0 as ord, 'P' as alias, case when scope_id < stmt_id % 12 then 'SCOPE' else 'PHYSICAL' end as rel_kind,
       case when scope_id = stmt_id % 12 then concat('SRC_S', stmt_id % 10) end as table_name,
       case when scope_id < stmt_id % 12 then scope_id + 1 end as child_scope_id
from {chain_scopes}
"""

FIXTURES["chain_projections"] = """
select stmt_id, scope_id, 0 as ord, 'X' as output_name,
       case when scope_id < stmt_id % 12 then 'P.X + P.X' else concat('P.K', stmt_id) end as expression
from {chain_scopes}
"""

FIXTURES["chain_seeds"] = """
select stmt_id, scope_id as root_ord, scope_id, expression from {chain_projections} where scope_id = 0
"""

# One catalog for the rules behind the plain look-ups: A: columns found below a
# scope only; I: identities whose first child may lead nowhere; V: stars over
# stars over a table outside the data model.
FIXTURES["rule_scopes"] = """
select s_suppkey as stmt_id, k as scope_id, nullif(p, -1) as parent_id, n as scope_name, t as kind,
       case k when 5 then 0 when 6 then 1 end as branch_ord
from {supplier} cross join (values
  (0, -1, 'ROOT', 'ROOT'), (1, 0, 'ROOT/A', 'SUBQUERY'), (2, 1, 'ROOT/A/B', 'SUBQUERY'), (3, 2, 'ROOT/A/B/C', 'SUBQUERY'),
  (4, 1, 'ROOT/A/U', 'UNION'), (5, 4, 'ROOT/A/U/B1', 'UNION_BRANCH'), (6, 4, 'ROOT/A/U/B2', 'UNION_BRANCH'),
  (10, 0, 'ROOT/I', 'SUBQUERY'), (11, 10, 'ROOT/I/K1', 'SUBQUERY'), (12, 10, 'ROOT/I/K2', 'SUBQUERY'),
  (20, 0, 'ROOT/V', 'SUBQUERY'), (21, 20, 'ROOT/V/W', 'SUBQUERY')) as v(k, p, n, t)
"""

FIXTURES["rule_relations"] = """
select s_suppkey as stmt_id, k as scope_id, o as ord, a as alias, case when c >= 0 then 'SCOPE' else 'PHYSICAL' end as rel_kind,
       case t when 'S' then concat('SRC_S', s_suppkey % 10) when 'D' then concat('DIM_N', s_nationkey)
              when 'X' then concat('EXT_T', s_suppkey % 7) end as table_name,
       nullif(c, -1) as child_scope_id
from {supplier} cross join (values
  (0, 0, 'A', '', 1), (0, 1, 'I', '', 10), (0, 2, 'V', '', 20), (1, 0, 'B', '', 2), (1, 1, 'U', '', 4), (2, 0, 'C', '', 3),
  (3, 0, 'P', 'S', -1), (5, 0, 'Q', 'S', -1), (6, 0, 'R', 'D', -1), (10, 0, 'K1', '', 11), (10, 1, 'K2', '', 12),
  (11, 0, 'T1', 'S', -1), (12, 0, 'T2', 'D', -1), (20, 0, 'W', '', 21), (21, 0, 'EXT', 'X', -1)) as v(k, o, a, t, c)
"""

FIXTURES["rule_projections"] = """
select s_suppkey as stmt_id, k as scope_id, o as ord, n as output_name,
       case e when 'P.K' then concat('P.K', s_suppkey) when 'T1.C1' then case when s_suppkey % 2 = 0 then 'Z.C1' else 'T1.C1' end
              else e end as expression,
       case e when '*' then 'ALL' end as star_kind, cast(null as varchar(10)) as star_alias
from {supplier} cross join (values
  (1, 0, 'OWN', 'B.BCOL'), (2, 0, 'BCOL', 'C.DEEP'), (3, 0, 'DEEP', 'P.K'), (5, 0, 'E1', 'Q.C1'), (5, 1, 'LATE0', 'Q.C2'),
  (6, 0, 'F1', 'R.C1'), (6, 1, 'LATE', 'R.K7 + 1'), (10, 0, 'C1', 'C1'), (10, 1, 'C2', 'C2'), (11, 0, 'C1', 'T1.C1'),
  (12, 0, 'C1', 'T2.K7'), (12, 1, 'C2', 'T2.C2'), (20, 0, '*', '*'), (21, 0, '*', '*')) as v(k, o, n, e)
"""

FIXTURES["rule_seeds"] = """
select s_suppkey as stmt_id, o as root_ord, 0 as scope_id, e as expression
from {supplier} cross join (values (0, 'A.DEEP'), (1, 'A.LATE || A.LATE0'), (2, 'A.GONE'), (3, 'I.C1'), (4, 'I.C2'),
                                   (5, 'V.COLX + V.COLY')) as v(o, e)
"""

# Root-level expressions to resolve: every projection of scope 0.
FIXTURES["resolve_seeds"] = """
select stmt_id, ord as root_ord, scope_id, output_name as target_column, expression
from {projections} where scope_id = 0
"""

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def deps(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(FIXTURES[name])))


def _closure(names: list[str]) -> list[str]:
    """Fixtures needed by ``names`` in dependency order (dependencies first)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in BASE_TABLES or n in order:
            return
        for d in deps(n):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def duckdb_with(names: list[str], body: str) -> str:
    """``WITH`` prefix defining ``names`` (and their dependencies) for DuckDB."""
    order = _closure(names)
    if not order:
        return body
    ctes = []
    for n in order:
        sql = FIXTURES[n].format(**{d: d for d in deps(n)})
        ctes.append(f"{n} AS ({sql.strip()})")
    head = "WITH " + ",\n".join(ctes)
    stripped = body.lstrip()
    if stripped[:15].lower() == "with recursive ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + stripped[15:]
    if stripped[:5].lower() == "with ":
        # merge the body's own WITH list into ours
        return head + ",\n" + stripped[5:]
    return head + "\n" + body


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spark_fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build fixture ``name`` on Spark from the parquet tables in ``sf_dir``."""
    if name in BASE_TABLES:
        return base_table(spark, sf_dir, name)
    frames = {d: spark_fixture(spark, sf_dir, d) for d in deps(name)}
    return spark.sql(FIXTURES[name], **frames)


@lru_cache(maxsize=None)
def fixture_names() -> tuple[str, ...]:
    return tuple(FIXTURES)
