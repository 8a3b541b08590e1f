"""Queries over statement parts: assignments, joins, edges and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from columbine.functions.text import WS
from columbine.operators import dml as M
from columbine.operators import report as RP
from columbine.operators import resolve as R
from columbine.plans.registry import register
from columbine.plans.resolve_queries import RESOLVE_SQL, catalog_frames
from columbine.plans.text_queries import d_char_count, d_column_refs, d_norm_ws, d_normalize_sql_no_alias, d_word_count
from columbine.sources import corpus as CO
from columbine.sources import fixtures as fx


def fx_(spark, sf_dir, name):
    return fx.spark_fixture(spark, sf_dir, name)


MERGE_SQL = """
ma as (
  select stmt_id, when_ord, pos,
         case when upper(trim(target)) like upper(target_alias) || '.%' then substring(upper(trim(target)), length(target_alias) + 2)
              when upper(trim(target)) like upper(target_table) || '.%' then substring(upper(trim(target)), length(target_table) + 2)
              else upper(trim(target)) end as target_column,
         expression, 'UPDATE_SET' as clause_type from merge_sets
  union all
  select c.stmt_id, c.when_ord, c.pos, upper(trim(c.col)), v.val, 'INSERT_VALUES'
  from merge_insert_cols c join merge_insert_vals v using (stmt_id, when_ord, pos))
"""
MERGE_NEEDS = ["merge_sets", "merge_insert_cols", "merge_insert_vals"]


def _merge(spark, sf_dir):
    return M.merge_assignments(fx_(spark, sf_dir, "merge_sets"), fx_(spark, sf_dir, "merge_insert_cols"),
                               fx_(spark, sf_dir, "merge_insert_vals"))


@register("merge_assignments", needs=MERGE_NEEDS, oracle=f"with {MERGE_SQL} select * from ma")
def q_merge_assignments(spark, sf_dir):
    """SET and INSERT pairs of every MERGE (shorter list wins, DELETE none)."""
    return _merge(spark, sf_dir)


FIRST_SQL = f"""{MERGE_SQL},
fa as (select stmt_id, target_column, when_ord, pos, expression, clause_type from (
  select *, row_number() over (partition by stmt_id, target_column order by when_ord, pos) as rn from ma) z where rn = 1)
"""


@register("first_assignment", needs=MERGE_NEEDS, oracle=f"with {FIRST_SQL} select * from fa")
def q_first_assignment(spark, sf_dir):
    """First assignment per target column of each MERGE."""
    return M.first_assignment(_merge(spark, sf_dir))


INSERT_SQL = """
ir as (select * from root_scopes where stmt_type = 'INSERT'),
items as (select p.stmt_id, p.scope_id, p.ord, p.output_name, p.expression,
                 row_number() over (partition by p.stmt_id, p.scope_id order by p.ord) - 1 as pos
          from projections p join ir r on r.stmt_id = p.stmt_id and r.scope_id = p.scope_id),
ia as (
  select l.stmt_id, l.pos, upper(l.target_column) as target_column, i.expression,
         case when i.expression is null then 'INSERT column ' || upper(l.target_column) || ' at position ' || l.pos
              || ' has no matching SELECT expression' else '' end as warning
  from insert_cols l left join items i on i.stmt_id = l.stmt_id and i.pos = l.pos
  union all
  select i.stmt_id, i.pos, upper(i.output_name), i.expression, '' from items i
  where i.stmt_id not in (select stmt_id from insert_cols)),
ins as (select a.stmt_id, r.scope_id, r.target_table, a.pos as ord, a.target_column, a.expression,
               'INSERT_VALUES' as clause_type, a.warning from ia a join ir r using (stmt_id))
"""


@register("insert_assignments", needs=["projections", "root_scopes", "insert_cols"],
          oracle=f"with {INSERT_SQL} select * from ins")
def q_insert_assignments(spark, sf_dir):
    """INSERT columns paired with the SELECT list by position."""
    return M.insert_assignments(fx_(spark, sf_dir, "insert_cols"), fx_(spark, sf_dir, "projections"),
                                fx_(spark, sf_dir, "root_scopes").where("stmt_type = 'INSERT'"))


JOINS_SQL = """
jn as (select distinct stmt_id, scope_id, join_pos, side, kind from join_conjuncts),
jseq as (select *, dense_rank() over (partition by stmt_id, scope_id order by join_pos) as join_seq from jn),
cc as (select *, trim(regexp_replace(condition, '\\s+', ' ', 'g')) as c from join_conjuncts where condition is not null),
kk as (select *, regexp_extract(c, '^([A-Za-z_][A-Za-z0-9_]*(?:[.][A-Za-z_][A-Za-z0-9_]*)?) = ([A-Za-z_][A-Za-z0-9_]*(?:[.][A-Za-z_][A-Za-z0-9_]*)?)$', 1) as l,
              regexp_extract(c, '^([A-Za-z_][A-Za-z0-9_]*(?:[.][A-Za-z_][A-Za-z0-9_]*)?) = ([A-Za-z_][A-Za-z0-9_]*(?:[.][A-Za-z_][A-Za-z0-9_]*)?)$', 2) as r
       from cc),
keys as (select * from kk where l <> '' and upper(l) not in ('NULL','SYSDATE','SYSTIMESTAMP','CURRENT_DATE','CURRENT_TIMESTAMP','ROWNUM','ROWID','LEVEL','USER')
          and upper(r) not in ('NULL','SYSDATE','SYSTIMESTAMP','CURRENT_DATE','CURRENT_TIMESTAMP','ROWNUM','ROWID','LEVEL','USER')),
flt as (select stmt_id, scope_id, join_pos, string_agg(c, '; ' order by conj_pos) as join_filters from kk
        where not (l <> '' and upper(l) not in ('NULL','SYSDATE','SYSTIMESTAMP','CURRENT_DATE','CURRENT_TIMESTAMP','ROWNUM','ROWID','LEVEL','USER')
          and upper(r) not in ('NULL','SYSDATE','SYSTIMESTAMP','CURRENT_DATE','CURRENT_TIMESTAMP','ROWNUM','ROWID','LEVEL','USER'))
        group by 1, 2, 3),
jc as (
  select k.stmt_id, k.scope_id, s.join_seq,
         case when upper(s.side) <> '' then upper(s.side) || ' JOIN' when upper(s.kind) <> '' then upper(s.kind) || ' JOIN'
              else 'INNER JOIN' end as join_type,
         case when strpos(k.l, '.') > 0 then upper(split_part(k.l, '.', 1)) else '' end as left_table,
         case when strpos(k.l, '.') > 0 then upper(split_part(k.l, '.', 2)) else upper(k.l) end as left_field,
         case when strpos(k.r, '.') > 0 then upper(split_part(k.r, '.', 1)) else '' end as right_table,
         case when strpos(k.r, '.') > 0 then upper(split_part(k.r, '.', 2)) else upper(k.r) end as right_field,
         k.l || ' = ' || k.r as join_condition, coalesce(f.join_filters, '') as join_filters,
         n.scope_name as context_path, k.conj_pos
  from keys k join jseq s using (stmt_id, scope_id, join_pos)
  left join flt f using (stmt_id, scope_id, join_pos)
  left join scopes n on n.stmt_id = k.stmt_id and n.scope_id = k.scope_id)
"""


@register("join_conditions", needs=["join_conjuncts", "scopes"], oracle=f"with {JOINS_SQL} select * from jc")
def q_join_conditions(spark, sf_dir):
    """J14 + W2 + B16: join keys with their filters and sequence numbers."""
    return M.join_conditions(fx_(spark, sf_dir, "join_conjuncts"), fx_(spark, sf_dir, "scopes"))


@register("theta_joins", needs=["join_conjuncts"], oracle=f"""
with {JOINS_SQL}
select stmt_id, scope_id, join_pos, join_filters from flt f
where not exists (select 1 from keys k where k.stmt_id = f.stmt_id and k.scope_id = f.scope_id and k.join_pos = f.join_pos)
""")
def q_theta_joins(spark, sf_dir):
    """Joins with filters only (no key), which give no key row."""
    return M.theta_joins(fx_(spark, sf_dir, "join_conjuncts"))


MERGE_ON_SQL = """
mo as (select *, trim(regexp_replace(condition, '\\s+', ' ', 'g')) as c from merge_on),
ms as (select *, trim(split_part(c, '=', 1)) as l, trim(split_part(c, '=', 2)) as r,
             row_number() over (partition by stmt_id order by conj_pos) as join_seq from mo),
mk as (select stmt_id, join_seq, 'MERGE' as join_type,
       case when strpos(l, '.') > 0 then upper(string_split(l, '.')[-2]) else upper(target_alias) end as left_table,
       upper(string_split(l, '.')[-1]) as left_field,
       case when strpos(r, '.') > 0 then upper(string_split(r, '.')[-2]) else upper(using_alias) end as right_table,
       upper(string_split(r, '.')[-1]) as right_field,
       l || ' = ' || r as join_condition, '' as join_filters, 'MERGE_ON' as context_path
from ms)
"""


@register("merge_on_keys", needs=["merge_on"], oracle=f"with {MERGE_ON_SQL} select * from mk")
def q_merge_on_keys(spark, sf_dir):
    """MERGE ON equalities as join keys."""
    return M.merge_on_keys(fx_(spark, sf_dir, "merge_on"))


JOIN_TABLE_COLUMNS = ("join_seq, join_type, left_table, left_field, right_table, right_field, join_condition, join_filters, "
                      "context_path")


@register("join_table", needs=["join_conjuncts", "scopes", "merge_on", "root_scopes", "stmts"], oracle=f"""
with {JOINS_SQL}, {MERGE_ON_SQL},
j as (select stmt_id, {JOIN_TABLE_COLUMNS} from jc
      union all select mk.stmt_id, {JOIN_TABLE_COLUMNS} from mk join root_scopes on root_scopes.stmt_id = mk.stmt_id)
select sql_file, object_name, {JOIN_TABLE_COLUMNS} from j join stmts on stmts.stmt_id = j.stmt_id
""")
def q_join_table(spark, sf_dir):
    """The join keys of every statement as the output table has them."""
    joins = M.join_conditions(fx_(spark, sf_dir, "join_conjuncts"), fx_(spark, sf_dir, "scopes"))
    merge = M.merge_on_keys(fx_(spark, sf_dir, "merge_on")).join(fx_(spark, sf_dir, "root_scopes").select("stmt_id"), "stmt_id")
    columns = ["stmt_id", *RP.JOIN_COLUMNS[2:]]
    return RP.join_table(joins.select(*columns).unionByName(merge.select(*columns)), fx_(spark, sf_dir, "stmts"))


@register("non_column_refs", needs=["join_conjuncts", "relations", "dm_pairs"], oracle=r"""
with refs as (select stmt_id, scope_id, join_pos, conj_pos, unnest(regexp_extract_all(condition,
                 '(?:^|[^A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*(?:[.][A-Za-z_][A-Za-z0-9_]*)?)', 1)) as ref
              from join_conjuncts where condition is not null),
r2 as (select *, case when strpos(ref, '.') > 0 then upper(split_part(ref, '.', 1)) end as lft,
              case when strpos(ref, '.') > 0 then upper(split_part(ref, '.', 2)) else upper(ref) end as rgt from refs),
t as (select distinct upper(table_name) as t from dm_pairs),
a as (select distinct stmt_id, scope_id, upper(alias) as a from relations)
select stmt_id, scope_id, join_pos, conj_pos, ref from r2 x
where not (
  (lft is not null and lft in ('ATOMIC', 'DBO', 'PUBLIC', 'SYS', 'SCHEMA', 'ADMIN', 'APP') and rgt in (select t from t))
  or (lft is not null and rgt in (select t from t)
      and not exists (select 1 from a where a.stmt_id = x.stmt_id and a.scope_id = x.scope_id and a.a = x.lft))
  or (lft is null and rgt in (select t from t))
  or (lft is null and exists (select 1 from a where a.stmt_id = x.stmt_id and a.scope_id = x.scope_id and a.a = x.rgt)))
""")
def q_non_column_refs(spark, sf_dir):
    """C4: raw tokens of join conditions minus schema.table, table names and bare aliases."""
    from columbine.functions.text import REF_TOKEN
    c = fx_(spark, sf_dir, "join_conjuncts").where(F.col("condition").isNotNull())
    refs = c.select("stmt_id", "scope_id", "join_pos", "conj_pos",
                    F.explode(F.regexp_extract_all("condition", F.lit(REF_TOKEN), 1)).alias("ref"))
    return M.drop_non_columns(refs, fx_(spark, sf_dir, "dm_pairs"), fx_(spark, sf_dir, "relations"))


def _pipeline_parts(spark, sf_dir):
    """Catalog, assignments and join rows of every statement."""
    scopes, rel, proj, dm = catalog_frames(spark, sf_dir)
    cat = R.Catalog(spark, scopes, rel, proj, dm)
    roots = fx_(spark, sf_dir, "root_scopes")
    merges = M.number_assignments(M.first_assignment(_merge(spark, sf_dir))).join(roots, "stmt_id").select(
        "stmt_id", "scope_id", "target_table", "ord",
        "target_column", "expression", "clause_type")
    inserts = (M.insert_assignments(fx_(spark, sf_dir, "insert_cols"), proj,
                                    roots.where(F.col("stmt_type") == "INSERT"))
               .where(F.col("expression").isNotNull())
               .select("stmt_id", "scope_id", "target_table", "ord", "target_column", "expression", "clause_type"))
    assignments = merges.unionByName(inserts)
    joins = M.join_conditions(fx_(spark, sf_dir, "join_conjuncts"), scopes)
    mo = M.merge_on_keys(fx_(spark, sf_dir, "merge_on")).join(roots.select("stmt_id", "scope_id"), "stmt_id") \
        .withColumn("conj_pos", F.col("join_seq").cast("int"))
    joins = joins.unionByName(mo.select(*joins.columns))
    return cat, dm, assignments, joins


# The same composition in SQL: assignments and join references as seeds of one
# resolution, joined back to their rows.
EDGE_NEEDS = ["scopes", "relations", "projections", "dm_pairs", "join_conjuncts", "merge_on", "root_scopes", "stmts",
              "insert_cols", *MERGE_NEEDS]
EDGES_SQL = f"""{FIRST_SQL}, {INSERT_SQL}, {JOINS_SQL}, {MERGE_ON_SQL},
asg as (
  select f.stmt_id, r.scope_id, r.target_table,
         row_number() over (partition by f.stmt_id order by f.when_ord, f.pos) as ord, f.target_column, f.expression,
         f.clause_type from fa f join root_scopes r using (stmt_id)
  union all
  select stmt_id, scope_id, target_table, ord, target_column, expression, clause_type from ins
  where expression is not null),
aj as (
  select stmt_id, scope_id, join_seq, join_type, left_table, left_field, right_table, right_field, join_condition,
         join_filters, context_path from jc
  union all
  select m.stmt_id, r.scope_id, join_seq, join_type, left_table, left_field, right_table, right_field, join_condition,
         join_filters, context_path from mk m join root_scopes r using (stmt_id)),
fr as (select *, unnest({d_column_refs('join_filters')}) as ref from (
  select distinct stmt_id, scope_id, join_seq, join_type, join_filters, context_path from aj where join_filters <> '') z),
fs as (select *, case when strpos(ref, '.') > 0 then upper(split_part(ref, '.', 1)) end as lft,
              case when strpos(ref, '.') > 0 then upper(split_part(ref, '.', 2)) else upper(ref) end as rgt from fr),
fk as (
  select f.* from fs f
  left join (select distinct upper(table_name) as t from dm_pairs) d on d.t = f.rgt
  left join (select distinct stmt_id, scope_id, upper(alias) as a from relations) la
    on la.stmt_id = f.stmt_id and la.scope_id = f.scope_id and la.a = f.lft
  left join (select distinct stmt_id, scope_id, upper(alias) as a from relations) ra
    on ra.stmt_id = f.stmt_id and ra.scope_id = f.scope_id and ra.a = f.rgt
  where not (d.t is not null and (lft is null or la.a is null or lft in ('ATOMIC', 'DBO', 'PUBLIC', 'SYS', 'SCHEMA', 'ADMIN', 'APP')))
    and not (lft is null and ra.a is not null)),
ji as (select *, row_number() over () as item from (
  select stmt_id, scope_id, join_seq, join_type, 'LEFT' as join_side, 'KEY' as field_role, join_condition, context_path,
         case when left_table <> '' then left_table || '.' || left_field else left_field end as ref,
         join_condition as full_expression from aj
  union all
  select stmt_id, scope_id, join_seq, join_type, 'RIGHT', 'KEY', join_condition, context_path,
         case when right_table <> '' then right_table || '.' || right_field else right_field end, join_condition from aj
  union all
  select stmt_id, scope_id, join_seq, join_type, 'FILTER', 'FILTER', join_filters, context_path, ref, join_filters
  from fk) z),
all_seeds as (
  select stmt_id, ord as root_ord, scope_id, expression from asg
  union all select stmt_id, -item, scope_id, ref from ji),
{RESOLVE_SQL.replace('resolve_seeds', 'all_seeds')},
jx as (
  select i.stmt_id, i.join_seq, i.join_type, i.join_side, i.field_role,
         case when strpos(i.ref, '.') > 0 then split_part(upper(i.ref), '.', 1) else '' end as original_alias,
         case when strpos(i.ref, '.') > 0 then split_part(upper(i.ref), '.', 2) else upper(i.ref) end as original_field,
         r.source_type, r.table_name as physical_table, r.column_name as physical_field, r.constant_value, r.dm_match,
         r.trace_path, case when r.source_type = 'UNRESOLVED' then r.reason else '' end as unresolved_reason,
         i.join_condition, i.context_path, i.full_expression
  from ji i join res r on r.stmt_id = i.stmt_id and r.root_ord = -i.item),
je as (select *, case when original_alias <> '' then original_alias || '.' || original_field else original_field end as oref
       from jx where not (join_type = 'MERGE' and source_type = 'UNRESOLVED')),
edges as (
  select s.sql_file, s.object_name, 'MAPPING' as row_type, a.target_table as dest_table, a.target_column as dest_field,
         r.source_type, r.table_name as source_table, r.column_name as source_field, r.source_alias, r.original_ref,
         coalesce(nullif(r.full_expression, ''), a.expression) as full_expression, r.constant_value, a.expression,
         r.dm_match, r.trace_path,
         case when r.reason <> '' then a.clause_type || ': ' || r.reason else a.clause_type end as notes,
         '' as table_alias, '' as join_seq, '' as join_type, '' as join_side, '' as field_role, '' as join_condition,
         '' as context_path, a.stmt_id
  from asg a join res r on r.stmt_id = a.stmt_id and r.root_ord = a.ord join stmts s on s.stmt_id = a.stmt_id
  union all
  select s.sql_file, s.object_name, 'JOIN', '', '', e.source_type, e.physical_table, e.physical_field, e.original_alias,
         e.oref, e.full_expression, e.constant_value, e.oref, e.dm_match, e.trace_path, e.unresolved_reason,
         e.original_alias, case when e.join_seq > 0 then cast(e.join_seq as varchar) else '' end, e.join_type,
         e.join_side, e.field_role, e.join_condition, e.context_path, e.stmt_id
  from je e join stmts s on s.stmt_id = e.stmt_id),
stats as (
  select e.stmt_id, e.sql_file, e.object_name, count(*) as total_rows,
         count(*) filter (row_type = 'MAPPING') as mapping_count, count(*) filter (row_type = 'JOIN') as join_field_count,
         count(*) filter (source_type = 'PHYSICAL') as physical_count,
         count(*) filter (source_type = 'CONSTANT') as constant_count,
         count(*) filter (source_type = 'SEQUENCE') as sequence_count,
         count(*) filter (source_type = 'UNRESOLVED') as unresolved_count,
         count(*) filter (dm_match = 'Y') as dm_match_y, count(*) filter (dm_match = 'N') as dm_match_n,
         count(*) filter (row_type = 'MAPPING' and source_type = 'UNRESOLVED') as mapping_unresolved,
         coalesce(any_value(j.n), 0) as join_count
  from edges e left join (select stmt_id, count(distinct (scope_id, join_seq, join_type)) as n from aj group by 1) j
    on j.stmt_id = e.stmt_id group by 1, 2, 3)
"""


def edges_oracle(body: str) -> str:
    return f"with recursive {EDGES_SQL} {body}"


def _exploded(spark, sf_dir, cat, dm, joins):
    return M.explode_join_keys(spark, joins, cat, dm.select("table_name"))


@register("join_keys_exploded", needs=EDGE_NEEDS, oracle=edges_oracle("select * from jx"))
def q_join_keys_exploded(spark, sf_dir):
    """Every join key and filter reference resolved in its join's scope."""
    cat, dm, _, joins = _pipeline_parts(spark, sf_dir)
    return _exploded(spark, sf_dir, cat, dm, joins)


def _edges(spark, sf_dir):
    """Assignments and join-key references resolved together in one loop
    (join items get negative ``root_ord`` so the two seed sets stay apart)."""
    cat, dm, assignments, joins = _pipeline_parts(spark, sf_dir)
    # both feed the loop's seeds and the final joins (and the sort's sampling pass)
    assignments = assignments.persist()
    items = M.join_key_items(joins, cat, dm.select("table_name")).withColumn("root_ord", -F.col("root_ord")).persist()
    seeds = assignments.select("stmt_id", F.col("ord").alias("root_ord"), "scope_id", "expression").unionByName(
        items.select("stmt_id", "root_ord", "scope_id", F.col("ref").alias("expression")))
    resolved = R.resolve_refs(spark, seeds, None, None, None, None, catalog=cat)
    stmts = fx_(spark, sf_dir, "stmts")
    maps = RP.mapping_edges(assignments, resolved.where(F.col("root_ord") >= 0), stmts)
    jrows = RP.join_edges(M.join_key_rows(items, resolved.where(F.col("root_ord") < 0)), stmts)
    return RP.edge_table(maps, jrows), joins, stmts


@register("edge_table", needs=EDGE_NEEDS, oracle=edges_oracle("select * from edges"))
def q_edge_table(spark, sf_dir):
    """C7 + U2 + C8 + T1: MAPPING and JOIN rows of every statement, sorted per file."""
    edges, _, _ = _edges(spark, sf_dir)
    return RP.sort_edges(edges)


@register("edge_stats", needs=EDGE_NEEDS, oracle=edges_oracle("select * from stats"))
def q_edge_stats(spark, sf_dir):
    """A1: per-statement counts over the edge table."""
    edges, joins, _ = _edges(spark, sf_dir)
    jc = joins.groupBy("stmt_id").agg(F.count_distinct("scope_id", "join_seq", "join_type").cast("long")
                                      .alias("join_count"))
    return RP.edge_stats(edges, jc)


@register("summary_long", needs=EDGE_NEEDS, oracle=edges_oracle(f"""
, nt as (select sql_file, list_filter([
    case when valid and regexp_matches(sql_text, '(?i)(^|[^A-Za-z0-9_])EXECUTE\\s+IMMEDIATE([^A-Za-z0-9_]|$)')
         then 'Contains EXECUTE IMMEDIATE - dynamic SQL cannot be fully traced' end,
    case when valid and regexp_matches(sql_text, '@[A-Za-z0-9_]')
         then 'Contains DB links (@) - remote tables may not resolve' end,
    case when valid and o <> c then 'Unbalanced parentheses: ' || o || ' open, ' || c || ' close' end],
    lambda w: w is not null) as w from (
  select sql_file, sql_text, length(trim(sql_text)) >= 10 and {d_word_count('upper(sql_text)', 'SELECT')} > 0 as valid,
         {d_char_count('sql_text', '(')} as o, {d_char_count('sql_text', ')')} as c from stmts) z),
lg as (unpivot (select sql_file, mapping_count as total_mappings, physical_count as physical, constant_count as constant,
                       sequence_count as sequence, unresolved_count as unresolved, dm_match_y, dm_match_n,
                       join_count as joins from stats)
       on total_mappings, physical, constant, sequence, unresolved, dm_match_y, dm_match_n, joins
       into name metric value value)
select l.sql_file, l.metric, l.value,
       coalesce(len(n.w) || ' warnings' || case when len(n.w) > 0 then ': ' || array_to_string(n.w[1:5], ' | ') else '' end, '') as notes
from lg l left join nt n using (sql_file)
"""))
def q_summary_long(spark, sf_dir):
    """A2 + T5: the stats in long form; notes carry the count and first five validation warnings."""
    from columbine.functions.text import validate_sql

    w = fx_(spark, sf_dir, "stmts").select("sql_file", validate_sql("sql_text")["warnings"].alias("_w"))
    notes = w.select("sql_file", F.concat(F.size("_w").cast("string"), F.lit(" warnings"),
                                          F.when(F.size("_w") > 0, F.concat(F.lit(": "), F.array_join(
                                              F.slice("_w", 1, 5), " | "))).otherwise(F.lit(""))).alias("_n"))
    s = RP.summary_long(q_edge_stats(spark, sf_dir))
    return s.join(notes, "sql_file", "left").select("sql_file", "metric", "value",
                                                    F.coalesce("_n", F.lit("")).alias("notes"))


@register("unresolved_rate", needs=EDGE_NEEDS, oracle=edges_oracle("""
select stmt_id, sql_file, object_name, mapping_count, mapping_unresolved,
       case when mapping_count > 0 then round(mapping_unresolved * 100.0 / mapping_count, 4) end as unresolved_pct,
       coalesce(mapping_unresolved * 100.0 / nullif(mapping_count, 0) > 20, false) as alarm
from stats
"""))
def q_unresolved_rate(spark, sf_dir):
    """A3: unresolved share of mapping rows per statement, with the 20 % alarm."""
    return RP.unresolved_rate(q_edge_stats(spark, sf_dir))


@register("qa_compare", needs=EDGE_NEEDS, oracle=edges_oracle("""
, dp as (select stmt_id, sql_file, object_name, dest_field,
                list_sort(list_distinct(list(source_table || '.' || source_field))) as d
         from edges where source_type = 'PHYSICAL' group by 1, 2, 3, 4),
sp as (select stmt_id, list_sort(list_distinct(list_transform(regexp_extract_all(sql_text,
         '(?:^|[^A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*[.][A-Za-z_][A-Za-z0-9_]*)', 1), lambda x: upper(x)))) as r from stmts)
select dp.stmt_id, sql_file, object_name, 'SOURCE_SET' as check_type, dest_field,
       array_to_string(d, ', ') as deep_sources, array_to_string(coalesce(r, []), ', ') as simple_sources,
       case when d = r then 'Y' else 'N' end as "match", '' as notes
from dp left join sp on sp.stmt_id = dp.stmt_id
"""))
def q_qa_compare(spark, sf_dir):
    """A4: resolved physical sources vs raw dotted pairs per target field."""
    edges, _, stmts = _edges(spark, sf_dir)
    return RP.qa_compare(edges, stmts)


@register("pending_objects", needs=["stmts", "manifest"], oracle="""
with last as (select object_name, arg_max(status, run_ord) as status from manifest group by 1)
select * from stmts s where not exists (
  select 1 from last l where l.object_name = s.object_name and l.status = 'success')
""")
def q_pending_objects(spark, sf_dir):
    """Statements still to process given the resume manifest."""
    return CO.pending(fx_(spark, sf_dir, "stmts"), fx_(spark, sf_dir, "manifest"))


KIND_SQL = f"""
kd as (select *, case when length(trim(sql_text)) = 0 then 'SQL file is empty or whitespace only'
                      when length(trim(sql_text)) < 10 then 'SQL too short (' || length(sql_text) || ' chars), likely invalid'
                      when {d_word_count('upper(sql_text)', 'SELECT')} = 0 then 'No SELECT keyword found' else '' end as message,
              case upper(regexp_extract({d_normalize_sql_no_alias('sql_text')}, '^[(]*{WS}*([A-Za-z]+)', 1))
                when 'MERGE' then 'MERGE' when 'INSERT' then 'INSERT' else 'OTHER' end as kind from stmts)
"""


@register("batch_outcomes", needs=["stmts", "manifest"], oracle=f"""
with {KIND_SQL},
done as (select object_name from manifest group by 1 having arg_max(status, run_ord) = 'success'),
st as (select case when d.object_name is not null then 'skipped' when message = '' and kind <> 'OTHER' then 'success'
              else 'failed' end as status from kd k left join done d using (object_name))
select count(*) as processed, count(*) filter (status = 'success') as success,
       count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'failed') as failed from st
""")
def q_batch_outcomes(spark, sf_dir):
    """Processed / success / skipped / failed counts of a batch."""
    st = CO.outcomes(fx_(spark, sf_dir, "stmts"), fx_(spark, sf_dir, "manifest"))
    return CO.outcome_counts(st)


@register("coverage_report", needs=["stmts", "mapping_spec"], oracle=f"""
with {KIND_SQL},
sc as (select object_name, count(*) as spec_rows from (
  select upper(trim(m.name)) as object_name from mapping_spec m join stmts t
    on upper(trim(coalesce(m.name, ''))) = upper(trim(t.object_name)) where upper(trim(coalesce(m.type, ''))) = 'T2T') z
  group by 1),
wc as (select *, case when message <> '' then 0 else
    cast(regexp_matches(sql_text, '(?i)(^|[^A-Za-z0-9_])EXECUTE\\s+IMMEDIATE([^A-Za-z0-9_]|$)') as int)
    + cast(regexp_matches(sql_text, '@[A-Za-z0-9_]') as int)
    + cast({d_char_count('sql_text', '(')} <> {d_char_count('sql_text', ')')} as int) end as warning_count from kd)
select stmt_id, w.object_name, kind, message = '' as valid, message, warning_count,
       message = '' and kind <> 'OTHER' as processable,
       case when message <> '' then message when kind = 'OTHER' then 'not a MERGE or INSERT statement' else '' end as reason,
       coalesce(sc.spec_rows, 0) as spec_rows
from wc w left join sc on sc.object_name = w.object_name
""")
def q_coverage_report(spark, sf_dir):
    """Kind, validity and spec coverage of every statement."""
    spec = fx_(spark, sf_dir, "mapping_spec")
    spec_obj = M.spec_for_object(spec, fx_(spark, sf_dir, "stmts")).select(
        F.upper(F.trim("name")).alias("object_name"))
    c = CO.coverage(fx_(spark, sf_dir, "stmts"), spec_obj)
    return c.select("stmt_id", "object_name", "kind", "valid", "message", "warning_count", "processable",
                    "reason", "spec_rows")


@register("spec_for_object", needs=["stmts", "mapping_spec"], oracle="""
select s.type, s.name, s.target_table, s.target_column, s.source_table, s.source_column, s.expression, t.stmt_id
from mapping_spec s join stmts t on upper(trim(coalesce(s.name, ''))) = upper(trim(t.object_name))
where upper(trim(coalesce(s.type, ''))) = 'T2T'
""")
def q_spec_for_object(spark, sf_dir):
    """Spec rows of every statement's object, Type T2T only."""
    return M.spec_for_object(fx_(spark, sf_dir, "mapping_spec"), fx_(spark, sf_dir, "stmts"))


@register("direct_mappings", needs=["mapping_spec"], oracle="""
select name, target_column,
  trim(coalesce(expression, '')) = '' and trim(coalesce(source_table, '')) <> '' and trim(coalesce(source_column, '')) <> ''
  and upper(trim(source_table)) <> 'EXPRESSION' as is_direct,
  case when trim(coalesce(expression, '')) = '' and trim(coalesce(source_table, '')) <> ''
            and trim(coalesce(source_column, '')) <> '' and upper(trim(source_table)) <> 'EXPRESSION'
       then upper(trim(source_table)) || '.' || upper(trim(source_column))
       else coalesce(nullif(trim(coalesce(expression, '')), ''), nullif(trim(coalesce(source_column, '')), ''),
                     nullif(trim(coalesce(target_column, '')), ''), '') end as spec_expression
from mapping_spec
""")
def q_direct_mappings(spark, sf_dir):
    """C2 + C3: direct flag and the expression to resolve of every spec row."""
    s = fx_(spark, sf_dir, "mapping_spec")
    return s.select("name", "target_column", M.is_direct(s).alias("is_direct"),
                    M.spec_expression(s).alias("spec_expression"))


@register("direct_fallback", needs=["stmts", "mapping_spec", "scopes", "relations", "projections", "dm_pairs"])
def q_direct_fallback(spark, sf_dir):
    """J18 (v1): spec rows of every statement resolved against its scope
    catalog; a direct mapping left all UNRESOLVED becomes one DIRECT_MAPPING edge."""
    scopes, rel, proj, dm = catalog_frames(spark, sf_dir)
    spec = M.spec_for_object(fx_(spark, sf_dir, "mapping_spec"), fx_(spark, sf_dir, "stmts"))
    # spec rows are told apart by all of their columns; equal rows are interchangeable
    w = F.row_number().over(Window.partitionBy("stmt_id").orderBy(
        "target_column", "target_table", "source_table", "source_column", "direct", "expression"))
    rows = spec.select("stmt_id", "target_table", "target_column", "source_table", "source_column",
                       M.is_direct(spec).alias("direct"), M.spec_expression(spec).alias("expression")) \
        .withColumn("root_ord", w.cast("long"))
    seeds = rows.select("stmt_id", "root_ord", F.lit(0).cast("long").alias("scope_id"), "expression")
    res = R.resolve_refs(spark, seeds, scopes, rel, proj, dm)
    return M.direct_fallback(rows, res, dm).join(rows.select("stmt_id", "root_ord", "target_column"),
                                              ["stmt_id", "root_ord"])


@register("combined_edges", needs=EDGE_NEEDS, oracle=edges_oracle("select * from edges"))
def q_combined_edges(spark, sf_dir):
    """T2 + U3: all statements' edges in the combined output order."""
    edges, _, _ = _edges(spark, sf_dir)
    return RP.sort_combined(edges)


@register("join_keys_sorted", needs=EDGE_NEEDS, oracle=edges_oracle("""
select s.sql_file, s.object_name, x.* exclude (stmt_id) from jx x join stmts s on s.stmt_id = x.stmt_id
"""))
def q_join_keys_sorted(spark, sf_dir):
    """Exploded join keys of all statements in output order, with file names."""
    cat, dm, _, joins = _pipeline_parts(spark, sf_dir)
    ex = _exploded(spark, sf_dir, cat, dm, joins).join(
        fx_(spark, sf_dir, "stmts").select("stmt_id", "sql_file", "object_name"), "stmt_id")
    return RP.sort_exploded(ex.select(*RP.JOIN_KEYS_EXPLODED_COLUMNS))


def _ident(c: str) -> str:
    """Oracle of an identifier without quotes (the sheet's have none)."""
    return f"upper({d_norm_ws(c)})"


@register("mapping_spec_normalized", needs=["mapping_spec"], oracle=f"""
select {_ident('type')} as type, {_ident('name')} as name, {_ident('target_table')} as target_table,
       {_ident('target_column')} as target_column, {_ident('source_table')} as source_table,
       {_ident('source_column')} as source_column, {_ident('expression')} as expression
from mapping_spec
""")
def q_mapping_spec_normalized(spark, sf_dir):
    """The spec sheet as read: headers matched, identifiers and expressions normalized."""
    from columbine.sources.io import read_mapping_spec

    raw = fx_(spark, sf_dir, "mapping_spec").select(
        F.col("type").alias(" TYPE "), F.col("name").alias("Name"), F.col("target_table").alias("Target Table"),
        F.col("target_column").alias("target column"), F.col("source_table").alias("Source Table"),
        F.col("source_column").alias("SOURCE COLUMN"), F.col("expression").alias("Expression"))
    return read_mapping_spec(spark, raw)
