"""Queries over the resolution rules behind the plain look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from columbine.operators import catalog as C
from columbine.operators import resolve as R
from columbine.operators.similar import closest_match
from columbine.plans.registry import register
from columbine.plans.resolve_queries import CAT, RESOLVE_SQL, catalog_frames
from columbine.plans.text_queries import d_column_refs
from columbine.sources import fixtures as fx

RESULT = ("stmt_id, root_ord, source_type, table_name, column_name, constant_value, reason, dm_match, trace_path, "
          "source_alias, original_ref, full_expression")
CHAIN = ["chain_scopes", "chain_relations", "chain_projections", "chain_seeds", "dm_pairs"]


@register("resolve_chain", needs=CHAIN, oracle=f"""
with recursive scopes as (select * from chain_scopes), relations as (select * from chain_relations),
projections as (select * from chain_projections), resolve_seeds as (select * from chain_seeds),
{RESOLVE_SQL} select * from res
""")
def q_resolve_chain(spark, sf_dir):
    """Columns read twice at each of up to 12 levels; every path is a row, every node is resolved once."""
    g = lambda n: fx.spark_fixture(spark, sf_dir, n)
    return R.resolve_refs(spark, g("chain_seeds"), g("chain_scopes"), g("chain_relations"), g("chain_projections"), g("dm_pairs"))


RULES = ["rule_scopes", "rule_relations", "rule_projections", "rule_seeds", "dm_pairs"]


def _rules(spark, sf_dir, condition):
    g = lambda n: fx.spark_fixture(spark, sf_dir, n)
    projections = C.expand_stars(spark, g("rule_scopes"), g("rule_relations"), g("rule_projections"), g("dm_pairs"))
    return R.resolve_refs(spark, g("rule_seeds").where(condition), g("rule_scopes"), g("rule_relations"), projections, g("dm_pairs"))


# a reference per row: (stmt_id, root_ord, expression, alias, col), and the scope that its alias means
_REFS = f"""
q as (select stmt_id, root_ord, expression, unnest({d_column_refs('expression')}) as u from rule_seeds),
t as (select q.*, split_part(u, '.', 1) as alias, split_part(u, '.', 2) as col, r.child_scope_id as top, n.scope_name as root
      from q join rule_relations r on r.stmt_id = q.stmt_id and r.scope_id = 0 and r.alias = split_part(u, '.', 1)
      join rule_scopes n on n.stmt_id = q.stmt_id and n.scope_id = 0),
dmc as (select upper(table_name) as table_name, upper(column_name) as column_name from dm_pairs)"""


@register("resolve_nested", needs=RULES, oracle=f"""
with recursive down(stmt_id, top, node, path) as (
  select stmt_id, scope_id, scope_id, cast([] as bigint[]) from rule_scopes
  union all
  select d.stmt_id, d.top, c.child, list_append(d.path, cast(c.o as bigint)) from down d join (
    select stmt_id, scope_id, child_scope_id as child, ord as o from rule_relations where child_scope_id is not null
    union all select stmt_id, parent_id, scope_id, 1000 + branch_ord from rule_scopes where kind = 'UNION_BRANCH') c
  on c.stmt_id = d.stmt_id and c.scope_id = d.node),
{_REFS},
hit as (select t.*, arg_min(d.node, d.path) as found from t left join (
          select d.*, p.output_name from down d join rule_projections p on p.stmt_id = d.stmt_id and p.scope_id = d.node) d
        on d.stmt_id = t.stmt_id and d.top = t.top and d.output_name = t.col
        where root_ord < 3 group by all),
x as (select h.*, p.expression as e, unnest(case when h.found is null then [null] else {d_column_refs('p.expression')} end) as ref, s.scope_name
      from hit h left join rule_projections p on p.stmt_id = h.stmt_id and p.scope_id = h.found and p.output_name = h.col
      left join rule_scopes s on s.stmt_id = h.stmt_id and s.scope_id = h.found)
select x.stmt_id, root_ord, case when found is null then 'UNRESOLVED' else 'PHYSICAL' end as source_type,
       coalesce(r.table_name, '') as table_name, case when found is null then u else split_part(ref, '.', 2) end as column_name,
       '' as constant_value, case when found is null then 'MISSING_PROJECTION' else '' end as reason,
       case when dmc.table_name is null then 'N' else 'Y' end as dm_match,
       root || coalesce('->' || scope_name || ':' || r.table_name || '.' || split_part(ref, '.', 2), '') as trace_path,
       coalesce(r.alias, '') as source_alias, coalesce(ref, '') as original_ref, expression as full_expression
from x left join rule_relations r on r.stmt_id = x.stmt_id and r.scope_id = x.found and r.alias = split_part(ref, '.', 1)
left join dmc on dmc.table_name = r.table_name and dmc.column_name = split_part(ref, '.', 2)
""")
def q_resolve_nested(spark, sf_dir):
    """Columns that only scopes below the alias project, in depth-first order, union branches last."""
    return _rules(spark, sf_dir, "root_ord < 3")


@register("resolve_identity", needs=RULES, oracle=f"""
with {_REFS},
kid as (select t.*, s.scope_name as mid, k.ord as kid_ord, kn.scope_name as kid, p.expression as ref, r.table_name,
               row_number() over (partition by t.stmt_id, t.root_ord order by k.ord) as nth
        from t join rule_scopes s on s.stmt_id = t.stmt_id and s.scope_id = t.top
        join rule_relations k on k.stmt_id = t.stmt_id and k.scope_id = t.top and k.child_scope_id is not null
        join rule_scopes kn on kn.stmt_id = t.stmt_id and kn.scope_id = k.child_scope_id
        join rule_projections p on p.stmt_id = t.stmt_id and p.scope_id = k.child_scope_id and p.output_name = t.col
        join rule_relations r on r.stmt_id = t.stmt_id and r.scope_id = k.child_scope_id and r.alias = split_part(p.expression, '.', 1)
        where t.root_ord in (3, 4))
select stmt_id, root_ord, 'PHYSICAL' as source_type, kid.table_name, split_part(ref, '.', 2) as column_name, '' as constant_value,
       '' as reason, case when dmc.table_name is null then 'N' else 'Y' end as dm_match,
       root || '->' || mid || '->' || kid || ':' || kid.table_name || '.' || split_part(ref, '.', 2) as trace_path,
       split_part(ref, '.', 1) as source_alias, ref as original_ref, expression as full_expression
from kid left join dmc on dmc.table_name = kid.table_name and dmc.column_name = split_part(ref, '.', 2) where nth = 1
""")
def q_resolve_identity(spark, sf_dir):
    """Identities descend into the first child scope that leads to a result."""
    return _rules(spark, sf_dir, "root_ord in (3, 4)")


@register("resolve_placeholder", needs=RULES, oracle=f"""
with {_REFS},
x as (select t.*, r.table_name from t join rule_relations w on w.stmt_id = t.stmt_id and w.scope_id = t.top
      join rule_relations r on r.stmt_id = t.stmt_id and r.scope_id = w.child_scope_id where root_ord = 5)
select stmt_id, root_ord, 'PHYSICAL' as source_type, table_name, col as column_name, '' as constant_value, '' as reason,
       'N' as dm_match, root || ':' || table_name || '.' || col as trace_path, alias as source_alias, u as original_ref,
       expression as full_expression
from x
""")
def q_resolve_placeholder(spark, sf_dir):
    """Columns read through two stars from a table outside the data model."""
    return _rules(spark, sf_dir, "root_ord = 5")


@register("resolve_scalars", needs=CAT + ["dm_pairs", "scalars", "scalar_relations", "scalar_projections"], oracle=f"""
with recursive sub as (select stmt_id, subquery, unnest({d_column_refs('subquery')}) as ref from scalars),
resolve_seeds as (select stmt_id, 0 as root_ord, 0 as scope_id, ref as expression from sub
                  where strpos(ref, '.') > 0 and split_part(ref, '.', 1) <> 'T'),
{RESOLVE_SQL},
inside as (select p.stmt_id, unnest({d_column_refs('p.expression')}) as ref, 'ROOT->ROOT/SCALAR' as trace from scalar_projections p)
select res.stmt_id, root_ord, source_type, table_name, column_name, constant_value, reason, dm_match, trace_path, source_alias,
       original_ref, s.subquery || ' + 1' as full_expression
from res join scalars s on s.stmt_id = res.stmt_id
union all
select i.stmt_id, 0, case when r.alias is null then 'UNRESOLVED' else 'PHYSICAL' end, coalesce(r.table_name, ''),
       case when r.alias is null then ref else split_part(ref, '.', 2) end, '',
       case when r.alias is null then 'COLUMN_NOT_FOUND' else '' end, 'N',
       trace || coalesce(':' || r.table_name || '.' || split_part(ref, '.', 2), ''), coalesce(r.alias, ''),
       case when r.alias is null then '' else ref end, s.subquery || ' + 1'
from inside i join scalars s on s.stmt_id = i.stmt_id
left join scalar_relations r on r.stmt_id = i.stmt_id and r.alias = split_part(i.ref, '.', 1) and strpos(i.ref, '.') > 0
""")
def q_resolve_scalars(spark, sf_dir):
    """An expression with a scalar subquery: its select list inside, its other aliases outside."""
    scopes, rel, proj, dm = catalog_frames(spark, sf_dir)
    g = lambda n: fx.spark_fixture(spark, sf_dir, n)
    text = F.concat("subquery", F.lit(" + 1"))
    scalars = g("scalars").withColumn("expression", text)
    inner = scalars.select("stmt_id", F.col("sub_scope_id").alias("scope_id"), F.col("scope_id").alias("parent_id"),
                           F.lit("ROOT/SCALAR").alias("scope_name"), F.lit("SCALAR").alias("kind"))
    seeds = scalars.select("stmt_id", F.col("expr_id").alias("root_ord"), "scope_id", "expression")
    return R.resolve_refs(spark, seeds, scopes.unionByName(inner.select(*scopes.columns)),
                          rel.unionByName(g("scalar_relations")), proj.unionByName(g("scalar_projections")), dm, scalars=scalars)


@register("closest_column", needs=["named_columns", "near_names"], oracle="""
with scored as (
  select t.name_id, c.column_name, c.ordinal,
         len(list_filter(string_split(upper(t.target), ''), lambda ch: contains(upper(c.column_name), ch)))
           / greatest(length(t.target), length(c.column_name)) as score
  from near_names t join named_columns c on t.table_name = c.table_name),
best as (select name_id, arg_min(column_name, (-score, ordinal)) as column_name, max(score) as score
         from scored where score > 0.5 group by name_id),
lead as (select table_name, arg_min(column_name, ordinal) as column_name from named_columns group by table_name)
select t.name_id, t.table_name, t.target, coalesce(b.column_name, l.column_name) as closest, b.score
from near_names t left join best b on b.name_id = t.name_id left join lead l on l.table_name = t.table_name
""")
def q_closest_column(spark, sf_dir):
    """The closest column name of its table for every name, else the table's first column."""
    names, columns = (fx.spark_fixture(spark, sf_dir, n) for n in ("near_names", "named_columns"))
    return closest_match(names, columns, ["table_name"], name_col="column_name")
