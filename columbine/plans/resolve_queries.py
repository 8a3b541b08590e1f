"""Queries over the scope catalog: closure, visibility, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from columbine.functions.text import column_refs
from columbine.operators import catalog as C
from columbine.operators import resolve as R
from columbine.plans.registry import register
from columbine.plans.text_queries import d_column_refs, d_is_constant, d_py_strip, d_norm_ws
from columbine.sources import fixtures as fx

CAT = ["scopes", "relations", "projections"]


def catalog_frames(spark, sf_dir):
    g = lambda n: fx.spark_fixture(spark, sf_dir, n)
    return g("scopes"), g("relations"), g("projections"), g("dm_pairs")


CLOSURE_SQL = """
anc(stmt_id, scope_id, ancestor_id, distance) as (
  select stmt_id, scope_id, scope_id, 0 from scopes
  union all
  select a.stmt_id, a.scope_id, s.parent_id, a.distance + 1 from anc a
  join scopes s on s.stmt_id = a.stmt_id and s.scope_id = a.ancestor_id where s.parent_id is not null)
"""


@register("scope_closure", needs=["scopes"], oracle=f"with recursive {CLOSURE_SQL} select * from anc")
def q_scope_closure(spark, sf_dir):
    """Each scope with its ancestors and distance."""
    return C.scope_closure(spark, fx.spark_fixture(spark, sf_dir, "scopes"))


VIS_SQL = f"""{CLOSURE_SQL},
nst(stmt_id, scope_id, desc_id, dist) as (
  select stmt_id, scope_id, child_scope_id, 1 from relations where rel_kind = 'SCOPE' and child_scope_id is not null
  union
  select n.stmt_id, n.scope_id, r.child_scope_id, n.dist + 1 from nst n
  join relations r on r.stmt_id = n.stmt_id and r.scope_id = n.desc_id
  where r.rel_kind = 'SCOPE' and r.child_scope_id is not null),
nd as (select stmt_id, scope_id, desc_id, min(dist) as dist from nst group by 1, 2, 3),
cand as (
  select a.stmt_id, a.scope_id, upper(r.alias) as alias, r.rel_kind, upper(r.table_name) as table_name,
         r.child_scope_id, a.distance as level, 0 as cat, 0 as sub_dist, r.scope_id as at_scope, r.ord
  from anc a join relations r on r.stmt_id = a.stmt_id and r.scope_id = a.ancestor_id
  union all
  select a.stmt_id, a.scope_id, upper(r.alias), r.rel_kind, upper(r.table_name), r.child_scope_id, a.distance,
         case when r.rel_kind = 'SCOPE' then 2 else 3 end, d.dist, r.scope_id, r.ord
  from anc a join nd d on d.stmt_id = a.stmt_id and d.scope_id = a.ancestor_id
  join relations r on r.stmt_id = d.stmt_id and r.scope_id = d.desc_id),
vis as (select stmt_id, scope_id, alias, rel_kind, table_name, child_scope_id, level from (
  select *, row_number() over (partition by stmt_id, scope_id, alias
                               order by level, cat, sub_dist, at_scope, ord) as rn from cand) z where rn = 1)
"""


@register("visible_relations", needs=CAT, oracle=f"with recursive {VIS_SQL} select * from vis")
def q_visible_relations(spark, sf_dir):
    """The relation every alias means in every scope."""
    scopes, rel, _, _ = catalog_frames(spark, sf_dir)
    cl = C.scope_closure(spark, C.with_defaults(scopes))
    return C.visible_relations(C.with_defaults(scopes), rel, cl)


ASKED_SQL = f"""asked as (
  select distinct stmt_id, scope_id, split_part(ref, '.', 1) as alias
  from (select stmt_id, scope_id, unnest({d_column_refs('expression')}) as ref from projections) z
  where contains(ref, '.'))"""


@register("visible_asked", needs=CAT, oracle=f"""
with recursive {VIS_SQL}, {ASKED_SQL}
select v.* from vis v join asked a on a.stmt_id = v.stmt_id and a.scope_id = v.scope_id and a.alias = v.alias
""")
def q_visible_asked(spark, sf_dir):
    """J4 on demand: the relations that the aliases of the projections' references mean."""
    scopes, rel, proj, _ = catalog_frames(spark, sf_dir)
    s = C.with_defaults(scopes)
    asked = proj.select("stmt_id", "scope_id", F.explode(column_refs("expression")).alias("ref")) \
        .where(F.col("ref").contains(".")).select("stmt_id", "scope_id", F.split_part("ref", F.lit("."), F.lit(1)).alias("alias"))
    return C.visible_asked(asked, C.relations_at(s, rel), C.scope_closure(spark, s))


@register("exists_relations", needs=CAT + ["exists_tables"], oracle="""
with add as (select distinct on (stmt_id, scope_id, upper(coalesce(alias, table_name)))
               stmt_id, scope_id, upper(coalesce(alias, table_name)) as alias, upper(table_name) as table_name
             from exists_tables),
new as (select a.* from add a where not exists (
          select 1 from relations r where r.stmt_id = a.stmt_id and r.scope_id = a.scope_id
            and upper(r.alias) = a.alias)),
base as (select stmt_id, scope_id, max(ord) as mx from relations group by 1, 2)
select stmt_id, scope_id, ord, alias, rel_kind, table_name, child_scope_id from relations
union all
select n.stmt_id, n.scope_id, coalesce(b.mx, -1) + row_number() over (partition by n.stmt_id, n.scope_id order by n.alias),
       n.alias, 'PHYSICAL', n.table_name, null
from new n left join base b on b.stmt_id = n.stmt_id and b.scope_id = n.scope_id
""")
def q_exists_relations(spark, sf_dir):
    """EXISTS-body tables registered on the outer scope unless the alias is taken."""
    return C.exists_relations(fx.spark_fixture(spark, sf_dir, "relations"),
                              fx.spark_fixture(spark, sf_dir, "exists_tables"))


@register("unpivot_columns", needs=["projections", "unpivots"], oracle="""
with base as (select stmt_id, scope_id, max(ord) as mx from projections group by 1, 2)
select stmt_id, scope_id, ord, output_name, expression from projections
union all
select u.stmt_id, u.scope_id, coalesce(b.mx, -1) + 1, upper(value_col), 'UNPIVOT_VALUE(' || upper(value_col) || ')'
from unpivots u left join base b on b.stmt_id = u.stmt_id and b.scope_id = u.scope_id
union all
select u.stmt_id, u.scope_id, coalesce(b.mx, -1) + 2, upper(for_col), 'UNPIVOT_FOR(' || upper(for_col) || ')'
from unpivots u left join base b on b.stmt_id = u.stmt_id and b.scope_id = u.scope_id
""")
def q_unpivot_columns(spark, sf_dir):
    """UNPIVOT columns as constant projections."""
    return C.unpivot_columns(fx.spark_fixture(spark, sf_dir, "projections"),
                             fx.spark_fixture(spark, sf_dir, "unpivots"))


def _resolve(spark, sf_dir):
    scopes, rel, proj, dm = catalog_frames(spark, sf_dir)
    seeds = fx.spark_fixture(spark, sf_dir, "resolve_seeds")
    return R.resolve_refs(spark, seeds, scopes, rel, proj, dm)


# Oracle: the qualified-reference path of the rules (the only path the
# fixture's expressions take), as a recursive walk over reference tasks.
RESOLVE_SQL = f"""{VIS_SQL},
names as (select stmt_id, scope_id, scope_name from scopes),
p as (select stmt_id, scope_id, upper(output_name) as name, expression from projections),
fp as (select stmt_id, scope_id, arg_min(upper(table_name), ord) as fp_table from relations
       where rel_kind = 'PHYSICAL' group by 1, 2),
dm as (select upper(table_name) as table_name, upper(column_name) as column_name from dm_pairs),
seeds as (select s.stmt_id, s.root_ord, s.scope_id, s.expression, [n.scope_name] as trace
          from resolve_seeds s join names n using (stmt_id, scope_id)),
et(stmt_id, root_ord, full_expression, scope_id, expr, trace) as (
  select stmt_id, root_ord, expression, scope_id, expression, trace from seeds),
t0 as (select *, {d_column_refs('expr')} as refs from et),
task(stmt_id, root_ord, full_expression, scope_id, ref, trace) as (
  select stmt_id, root_ord, full_expression, scope_id, unnest(refs), trace from t0
  where not {d_is_constant('expr')} and len(refs) > 0
  union all
  select x.stmt_id, x.root_ord, x.full_expression, x.target, unnest(x.refs), x.trace from (
    select k.stmt_id, k.root_ord, k.full_expression, v.child_scope_id as target,
           {d_column_refs('pp.expression')} as refs, list_append(k.trace, n.scope_name) as trace,
           pp.expression as e
    from task k
    join vis v on v.stmt_id = k.stmt_id and v.scope_id = k.scope_id
      and v.alias = split_part(upper({d_norm_ws('k.ref')}), '.', 1)
    join p pp on pp.stmt_id = k.stmt_id and pp.scope_id = v.child_scope_id
      and pp.name = trim(substring(upper({d_norm_ws('k.ref')}), strpos(upper({d_norm_ws('k.ref')}), '.') + 1))
    join names n on n.stmt_id = k.stmt_id and n.scope_id = v.child_scope_id
    where v.rel_kind = 'SCOPE' and v.child_scope_id <> k.scope_id and strpos(k.ref, '.') > 0
      and not {d_is_constant('k.ref')}) x
  where not {d_is_constant('x.e')} and len(x.refs) > 0),
k2 as (select k.*, upper({d_norm_ws('k.ref')}) as u,
         split_part(upper({d_norm_ws('k.ref')}), '.', 1) as al,
         trim(substring(upper({d_norm_ws('k.ref')}), strpos(upper({d_norm_ws('k.ref')}), '.') + 1)) as col
       from task k),
res as (
  select stmt_id, root_ord, 'CONSTANT' as source_type, '' as table_name, '' as column_name,
         {d_py_strip('expr')} as constant_value, '' as reason, 'N' as dm_match,
         array_to_string(trace, '->') || ':CONSTANT(' || {d_py_strip('expr')} || ')' as trace_path,
         '' as source_alias, '' as original_ref, full_expression
  from t0 where {d_is_constant('expr')}
  union all
  select stmt_id, root_ord, 'CONSTANT', '', '', expr, '', 'N', array_to_string(trace, '->') || ':CONSTANT(' || expr || ')',
         '', '', full_expression from t0 where not {d_is_constant('expr')} and len(refs) = 0
  union all
  select stmt_id, root_ord, 'CONSTANT', '', '', u, '', 'N', array_to_string(trace, '->') || ':CONSTANT(' || u || ')',
         '', '', full_expression from k2 where {d_is_constant('ref')}
  union all
  select k.stmt_id, k.root_ord, 'UNRESOLVED', '', k.u, '',
         case when strpos(k.ref, '.') > 0 then 'ALIAS_NOT_FOUND' else 'COLUMN_NOT_FOUND' end, 'N', array_to_string(k.trace, '->'),
         '', '', k.full_expression
  from k2 k left join vis v on v.stmt_id = k.stmt_id and v.scope_id = k.scope_id and v.alias = k.al
  where not {d_is_constant('k.ref')} and v.alias is null
  union all
  select k.stmt_id, k.root_ord, 'PHYSICAL', v.table_name, k.col, '', '',
         case when d.table_name is null then 'N' else 'Y' end,
         array_to_string(k.trace, '->') || ':' || v.table_name || '.' || k.col, k.al, k.u, k.full_expression
  from k2 k join vis v on v.stmt_id = k.stmt_id and v.scope_id = k.scope_id and v.alias = k.al
  left join dm d on d.table_name = v.table_name and d.column_name = k.col
  where not {d_is_constant('k.ref')} and v.rel_kind = 'PHYSICAL'
  union all
  select k.stmt_id, k.root_ord, 'CONSTANT', '', '', {d_py_strip('pp.expression')}, '', 'N',
         array_to_string(list_append(k.trace, n.scope_name), '->') || ':CONSTANT(' || {d_py_strip('pp.expression')} || ')',
         '', '', k.full_expression
  from k2 k join vis v on v.stmt_id = k.stmt_id and v.scope_id = k.scope_id and v.alias = k.al
  join p pp on pp.stmt_id = k.stmt_id and pp.scope_id = v.child_scope_id and pp.name = k.col
  join names n on n.stmt_id = k.stmt_id and n.scope_id = v.child_scope_id
  where not {d_is_constant('k.ref')} and v.rel_kind = 'SCOPE' and {d_is_constant('pp.expression')}
  union all
  select k.stmt_id, k.root_ord, case when f.fp_table is null then 'UNRESOLVED' else 'PHYSICAL' end,
         coalesce(f.fp_table, ''), case when f.fp_table is null then k.al || '.' || k.col else k.col end, '',
         case when f.fp_table is null then 'MISSING_PROJECTION' else '' end,
         case when d.table_name is null then 'N' else 'Y' end,
         array_to_string(k.trace, '->') || coalesce(':' || f.fp_table || '.' || k.col, ''),
         case when f.fp_table is null then '' else k.al end, case when f.fp_table is null then '' else k.u end,
         k.full_expression
  from k2 k join vis v on v.stmt_id = k.stmt_id and v.scope_id = k.scope_id and v.alias = k.al
  left join p pp on pp.stmt_id = k.stmt_id and pp.scope_id = v.child_scope_id and pp.name = k.col
  left join fp f on f.stmt_id = k.stmt_id and f.scope_id = v.child_scope_id
  left join dm d on d.table_name = f.fp_table and d.column_name = k.col
  where not {d_is_constant('k.ref')} and v.rel_kind = 'SCOPE' and v.child_scope_id <> k.scope_id
    and pp.name is null)
"""


@register("resolve_refs", needs=CAT + ["dm_pairs", "resolve_seeds"],
          oracle=f"with recursive {RESOLVE_SQL} select * from res")
def q_resolve_refs(spark, sf_dir):
    """Every root projection resolved to physical columns, constants or reasons."""
    return _resolve(spark, sf_dir)


@register("resolve_status", needs=CAT + ["dm_pairs", "resolve_seeds"], oracle=f"""
with recursive {RESOLVE_SQL}
select source_type, reason, dm_match, count(*) as n from res group by all
""")
def q_resolve_status(spark, sf_dir):
    """J9 summary: result counts per source type, reason and DM match."""
    return _resolve(spark, sf_dir).groupBy("source_type", "reason", "dm_match").agg(
        F.count(F.lit(1)).cast("long").alias("n"))


@register("scalar_subquery_refs", needs=["scalars", "scalar_relations", "scalar_projections"], oracle=f"""
with i as (select s.stmt_id, s.expr_id, p.scope_id, unnest({d_column_refs('p.expression')}) as ref
           from scalars s join scalar_projections p on p.stmt_id = s.stmt_id and p.scope_id = s.sub_scope_id),
o as (select stmt_id, expr_id, scope_id, sub_scope_id, unnest({d_column_refs('subquery')}) as ref from scalars)
select * from i
union all
select stmt_id, expr_id, scope_id, ref from o where strpos(ref, '.') > 0 and not exists (
  select 1 from scalar_relations r where r.stmt_id = o.stmt_id and r.scope_id = o.sub_scope_id
    and upper(r.alias) = split_part(o.ref, '.', 1))
""")
def q_scalar_subquery_refs(spark, sf_dir):
    """References inside and outside of scalar subqueries."""
    return R.scalar_subquery_refs(*[fx.spark_fixture(spark, sf_dir, n)
                                    for n in ("scalars", "scalar_projections", "scalar_relations")])


@register("unresolved_report", needs=CAT + ["dm_pairs", "resolve_seeds"])
def q_unresolved_report(spark, sf_dir):
    """Context of every unresolved reference (rows-only check)."""
    scopes, rel, proj, dm = catalog_frames(spark, sf_dir)
    seeds = fx.spark_fixture(spark, sf_dir, "resolve_seeds")
    cat = R.Catalog(spark, scopes, rel, proj, dm)
    res = R.resolve_refs(spark, seeds, scopes, rel, proj, dm, catalog=cat)
    return R.unresolved_report(res, seeds, cat)


STAR_NEEDS = ["star_scopes", "star_relations", "star_projections", "dm_pairs"]


@register("star_expansion", needs=STAR_NEEDS, oracle="""
with dmc as (select upper(table_name) as t, upper(column_name) as c, ordinal from dm_pairs),
rel as (select stmt_id, scope_id, ord as rel_ord, upper(alias) as alias, rel_kind, upper(table_name) as table_name,
               child_scope_id from star_relations),
p as (select stmt_id, scope_id, cast(ord as bigint) as ord, cast([] as bigint[]) as sub, upper(output_name) as output_name,
             expression, cast(null as varchar) as origin_alias, upper(star_kind) as star_kind,
             upper(star_alias) as star_alias from star_projections),
t1 as (select s.stmt_id, s.scope_id, s.ord, r.rel_ord, r.alias, r.rel_kind, r.table_name, r.child_scope_id
       from p s join rel r on r.stmt_id = s.stmt_id and r.scope_id = s.scope_id
       where s.scope_id = 1 and s.star_kind is not null and (s.star_kind = 'ALL' or r.alias = s.star_alias)),
e1 as (select stmt_id, scope_id, ord, [cast(rel_ord as bigint), cast(ordinal as bigint)] as sub, c as output_name,
              alias || '.' || c as expression, cast(null as varchar) as origin_alias
       from t1 join dmc on dmc.t = t1.table_name where rel_kind = 'PHYSICAL'
       union all
       select stmt_id, scope_id, ord, [cast(rel_ord as bigint)], '*_' || alias, alias || '.*', null from t1
       where rel_kind = 'PHYSICAL' and table_name not in (select t from dmc)),
p1 as (select stmt_id, scope_id, ord, sub, output_name, expression, origin_alias, star_kind, star_alias from p
       where not (scope_id = 1 and star_kind is not null)
       union all select *, null, null from e1),
t0 as (select s.stmt_id, s.scope_id, s.ord, r.rel_ord, r.alias, r.rel_kind, r.table_name, r.child_scope_id
       from p1 s join rel r on r.stmt_id = s.stmt_id and r.scope_id = s.scope_id
       where s.scope_id = 0 and s.star_kind is not null and (s.star_kind = 'ALL' or r.alias = s.star_alias)),
e0 as (select t0.stmt_id, t0.scope_id, t0.ord, list_concat([cast(t0.rel_ord as bigint), c.ord], c.sub) as sub,
              c.output_name, c.expression, t0.alias as origin_alias
       from t0 join p1 c on c.stmt_id = t0.stmt_id and c.scope_id = t0.child_scope_id and c.star_kind is null
       where t0.rel_kind = 'SCOPE'
       union all
       select stmt_id, scope_id, ord, [cast(rel_ord as bigint), cast(ordinal as bigint)], c, alias || '.' || c, null
       from t0 join dmc on dmc.t = t0.table_name where rel_kind = 'PHYSICAL'
       union all
       select stmt_id, scope_id, ord, [cast(rel_ord as bigint)], '*_' || alias, alias || '.*', null from t0
       where rel_kind = 'PHYSICAL' and table_name not in (select t from dmc)),
fin as (select stmt_id, scope_id, ord, sub, output_name, expression, origin_alias from p1
        where star_kind is null and not (scope_id = 0 and star_kind is not null)
        union all select * from e0),
g as (select stmt_id, scope_id, output_name, min((ord, sub)) as first_pos,
             arg_max(expression, (ord, sub)) as expression, arg_max(origin_alias, (ord, sub)) as origin_alias
      from fin group by 1, 2, 3)
select stmt_id, scope_id, row_number() over (partition by stmt_id, scope_id order by first_pos) - 1 as ord,
       output_name, expression, origin_alias from g
""")
def q_star_expansion(spark, sf_dir):
    """* and A.* expanded over a subquery, a DM table and a table outside the DM."""
    g = lambda n: fx.spark_fixture(spark, sf_dir, n)
    return C.expand_stars(spark, g("star_scopes"), g("star_relations"), g("star_projections"), g("dm_pairs"))


UNION_NEEDS = ["union_scopes", "union_relations", "union_projections"]


@register("union_merge", needs=UNION_NEEDS, oracle=f"""
with br as (select stmt_id, parent_id as union_id, scope_id, coalesce(branch_ord, 0) as branch_ord
            from union_scopes where kind = 'UNION_BRANCH'),
bp as (select p.*, b.union_id, b.branch_ord,
              row_number() over (partition by p.stmt_id, p.scope_id order by p.ord) - 1 as pos
       from union_projections p join br b using (stmt_id, scope_id)),
refs as (select stmt_id, union_id, scope_id, branch_ord, pos, unnest(rs) as ref,
                unnest(range(len(rs))) as ref_pos
         from (select *, {d_column_refs('expression')} as rs from bp)),
rel as (select stmt_id, scope_id, ord as rel_ord, upper(alias) as alias, rel_kind, upper(table_name) as table_name,
               child_scope_id from union_relations),
cn as (select stmt_id, scope_id as child_scope_id, upper(output_name) as ref from union_projections),
cand as (select r.stmt_id, r.scope_id, r.pos, r.ref_pos, r.ref,
                arg_min(case when l.rel_kind = 'PHYSICAL' then l.table_name else l.alias end, l.rel_ord) as q
         from refs r join rel l on l.stmt_id = r.stmt_id and l.scope_id = r.scope_id
         left join cn on cn.stmt_id = r.stmt_id and cn.child_scope_id = l.child_scope_id and cn.ref = r.ref
         where strpos(r.ref, '.') = 0 and (l.rel_kind = 'PHYSICAL' or cn.ref is not null)
         group by 1, 2, 3, 4, 5),
q as (select r.*, case when c.q is not null then c.q || '.' || r.ref else r.ref end as qualified
      from refs r left join cand c using (stmt_id, scope_id, pos, ref_pos, ref)),
f as (select stmt_id, union_id, pos, qualified, min((branch_ord, ref_pos)) as k from q group by 1, 2, 3, 4),
s as (select stmt_id, union_id, pos, string_agg(qualified, ',' order by k) as source_refs from f group by 1, 2, 3),
fb as (select stmt_id, union_id, scope_id from (select *, row_number() over (partition by stmt_id, union_id
        order by branch_ord) as rn from br) z where rn = 1)
select b.stmt_id, b.union_id as scope_id, b.pos, upper(b.output_name) as output_name, b.expression,
       coalesce(s.source_refs, '') as source_refs
from bp b join fb using (stmt_id, union_id, scope_id) left join s using (stmt_id, union_id, pos)
""")
def q_union_merge(spark, sf_dir):
    """UNION outputs with the qualified references of every branch."""
    g = lambda n: fx.spark_fixture(spark, sf_dir, n)
    return C.merge_union(g("union_scopes"), g("union_relations"), g("union_projections"))


@register("union_resolve", needs=UNION_NEEDS)
def q_union_resolve(spark, sf_dir):
    """J9 through a UNION: root columns U.N1 / U.N2 by name and by position in each branch."""
    g = lambda n: fx.spark_fixture(spark, sf_dir, n)
    seeds = g("union_scopes").where("scope_id = 0").select(
        "stmt_id", "scope_id", F.inline(F.array(
            F.struct(F.lit(0).cast("long").alias("root_ord"), F.lit("U.N1").alias("expression")),
            F.struct(F.lit(1).cast("long").alias("root_ord"), F.lit("U.N2 || U.N1").alias("expression")))))
    return R.resolve_refs(spark, seeds, g("union_scopes"), g("union_relations"), g("union_projections"), None)


@register("nearest_cte", needs=["cte_scopes", "cte_relations"], oracle=f"""
with recursive {CLOSURE_SQL.replace('scopes', 'cte_scopes')},
ctes as (select stmt_id, parent_id as ancestor_id, scope_id as cte_scope_id,
                upper(regexp_extract(scope_name, '([^/:]+)$', 1)) as cte from cte_scopes where kind = 'CTE'),
cand as (select r.stmt_id, r.scope_id, r.ord, c.cte_scope_id,
                row_number() over (partition by r.stmt_id, r.scope_id, r.ord order by a.distance) as rn
         from cte_relations r join anc a on a.stmt_id = r.stmt_id and a.scope_id = r.scope_id
         join ctes c on c.stmt_id = a.stmt_id and c.ancestor_id = a.ancestor_id
         where r.rel_kind = 'PHYSICAL' and upper(r.table_name) = c.cte)
select r.stmt_id, r.scope_id, r.ord, r.alias,
       case when c.cte_scope_id is not null then 'SCOPE' else r.rel_kind end as rel_kind,
       case when c.cte_scope_id is not null then null else r.table_name end as table_name,
       coalesce(c.cte_scope_id, r.child_scope_id) as child_scope_id
from cte_relations r left join (select * from cand where rn = 1) c using (stmt_id, scope_id, ord)
""")
def q_nearest_cte(spark, sf_dir):
    """Table names that are CTEs become scope relations of the nearest CTE."""
    g = lambda n: fx.spark_fixture(spark, sf_dir, n)
    scopes = g("cte_scopes")
    return C.nearest_cte(g("cte_relations"), scopes, C.scope_closure(spark, scopes))
