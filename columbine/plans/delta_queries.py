"""Queries over two versions of a mapping table (viewer inputs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columbine.operators import delta as D
from columbine.plans.registry import canon_sql, register
from columbine.sources import fixtures as fx
from columbine.sources.io import canonical_mappings


def mappings(spark: SparkSession, sf_dir: str, name: str = "map_v1") -> DataFrame:
    """A mapping table as a user loads it: canonical names, defaults, upper keys."""
    return canonical_mappings(fx.spark_fixture(spark, sf_dir, name))


V1 = f"v1 as ({canon_sql('map_v1')})"
V2 = f"v2 as ({canon_sql('map_v2')})"

LAST_SQL = """
select source_table, source_field, dest_table, dest_field,
       arg_max(rules, row_ord) as rules, arg_max(mapping_type, row_ord) as mapping_type,
       arg_max(object_name, row_ord) as object_name
from {src} group by source_table, source_field, dest_table, dest_field
"""

DELTA_SQL = f"""
, a as ({LAST_SQL.format(src='v1')}), b as ({LAST_SQL.format(src='v2')}),
d as (
select coalesce(a.source_table, b.source_table) as source_table,
       coalesce(a.source_field, b.source_field) as source_field,
       coalesce(a.dest_table, b.dest_table) as dest_table,
       coalesce(a.dest_field, b.dest_field) as dest_field,
       case when b.source_table is null then 'removed'
            when a.source_table is null then 'added'
            when a.rules <> b.rules or a.mapping_type <> b.mapping_type then 'modified'
            else 'unchanged' end as change_type,
       a.rules as v1_rules, b.rules as v2_rules, a.mapping_type as v1_mapping_type,
       b.mapping_type as v2_mapping_type, a.object_name as v1_object_name, b.object_name as v2_object_name
from a full outer join b
  on a.source_table = b.source_table and a.source_field = b.source_field
 and a.dest_table = b.dest_table and a.dest_field = b.dest_field)
"""


@register("mappings_canonical", needs=["map_v1"], oracle="""
select upper(coalesce(source_table, '')) as source_table, upper(coalesce(source_field, '')) as source_field,
       upper(coalesce(dest_table, '')) as dest_table, upper(coalesce(dest_field, '')) as dest_field,
       coalesce(rules, '') as rules, coalesce(mapping_type, '') as mapping_type, '' as object_name, row_ord
from map_v1
""")
def q_mappings_canonical(spark, sf_dir):
    """Headers given as synonyms in mixed case, lower-case names, no object column."""
    raw = fx.spark_fixture(spark, sf_dir, "map_v1")
    messy = raw.select(
        F.lower("source_table").alias(" Source Table "), F.col("source_field").alias("SOURCEFIELD"),
        F.lower("dest_table").alias("Target_Table"), F.col("dest_field").alias("destination field"),
        F.col("rules").alias("Transformation"), F.col("mapping_type").alias("Usage Type"), "row_ord",
    )
    return canonical_mappings(messy).select(
        "source_table", "source_field", "dest_table", "dest_field", "rules", "mapping_type", "object_name", "row_ord")


@register("last_mapping", needs=["map_dup"], oracle=f"""
with v as ({canon_sql('map_dup')}),
c as (select source_table, source_field, dest_table, dest_field, count(*) as copies from v
      group by source_table, source_field, dest_table, dest_field)
select l.*, c.copies from ({LAST_SQL.format(src='v')}) l
join c using (source_table, source_field, dest_table, dest_field)
""")
def q_last_mapping(spark, sf_dir):
    """Duplicate mapping keys, the last row by row order wins."""
    return D.last_mapping(mappings(spark, sf_dir, "map_dup"))


@register("mapping_delta", needs=["map_v1", "map_v2"], oracle=f"with {V1}, {V2} {DELTA_SQL} select * from d")
def q_mapping_delta(spark, sf_dir):
    """Field-level delta of v1 and v2."""
    return D.mapping_delta(mappings(spark, sf_dir, "map_v1"), mappings(spark, sf_dir, "map_v2"))


@register("delta_summary", needs=["map_v1", "map_v2"], oracle=f"""
with {V1}, {V2} {DELTA_SQL}
select count(*) filter (where change_type = 'added') as added_count,
       count(*) filter (where change_type = 'removed') as removed_count,
       count(*) filter (where change_type = 'modified') as modified_count,
       count(*) filter (where change_type = 'unchanged') as unchanged_count
from d
""")
def q_delta_summary(spark, sf_dir):
    """Counts per change type."""
    return D.delta_summary(q_mapping_delta(spark, sf_dir))


@register("delta_filtered", needs=["map_v1", "map_v2"], oracle=f"""
with {V1}, {V2} {DELTA_SQL}
select * from d where change_type is null or change_type in ('added', 'removed', 'modified')
""")
def q_delta_filtered(spark, sf_dir):
    """The default change filter (all but unchanged)."""
    return D.by_change(q_mapping_delta(spark, sf_dir))


@register("delta_nodes", needs=["map_v1", "map_v2"], oracle=f"""
with {V1}, {V2},
n2 as (select source_table as t from v2 union select dest_table from v2),
g as (select * from v1 where not exists (
  select 1 from v2 where v2.source_table = v1.source_table and v2.dest_table = v1.dest_table)),
n1 as (select source_table as t from g union select dest_table from g)
select t as table_name, 'V2' as version from n2
union all select t, 'V1' from n1 where t not in (select t from n2)
""")
def q_delta_nodes(spark, sf_dir):
    """Tables of the delta graph, those of removed edges included."""
    return D.delta_nodes(mappings(spark, sf_dir, "map_v1"), mappings(spark, sf_dir, "map_v2"))


@register("delta_graph", needs=["map_v1", "map_v2"], oracle=f"""
with {V1}, {V2} {DELTA_SQL},
r as (select *, case change_type when 'added' then 4 when 'modified' then 3 when 'removed' then 2 else 1 end as rk
      from d where change_type <> 'unchanged'),
e2 as (select v2.source_table, v2.dest_table, max(coalesce(r.rk, 1)) as rk, count(*) as mapping_count
       from v2 left join r on v2.source_table = r.source_table and v2.source_field = r.source_field
        and v2.dest_table = r.dest_table and v2.dest_field = r.dest_field
       group by v2.source_table, v2.dest_table)
select source_table, dest_table,
       case rk when 4 then 'added' when 3 then 'modified' when 2 then 'removed' else 'unchanged' end as change_type,
       mapping_count from e2
union all
select source_table, dest_table, 'removed', count(*) from v1
where not exists (select 1 from v2 where v2.source_table = v1.source_table and v2.dest_table = v1.dest_table)
group by source_table, dest_table
""")
def q_delta_graph(spark, sf_dir):
    """Table edges marked by their strongest field change."""
    v1, v2 = mappings(spark, sf_dir, "map_v1"), mappings(spark, sf_dir, "map_v2")
    return D.delta_graph(v1, v2, D.mapping_delta(v1, v2))
