"""Queries over the mapping graph of one or two mapping versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from columbine.functions.text import mapping_class, table_layer, layer_order
from columbine.operators import delta as D
from columbine.operators import graph as G
from columbine.operators import substring_index
from columbine.plans.delta_queries import DELTA_SQL, mappings
from columbine.plans.registry import canon_sql, register
from columbine.sources import fixtures as fx
from columbine.sources.io import read_column_catalog

# Search terms a user typed (a parameter of the search operators).
SEARCH_TERMS = ["k1", "dim_n1", "t2t_r", "stg_c3.k7", "zzz"]

# What a user clicked: tables whose fields are traced, and objects.  The last of
# each is unknown.
SELECTED_TABLES = ["RPT_R1", "DIM_N1", "NO_SUCH_TABLE"]
SELECTED_OBJECTS = ["T2T_BACK", "T2T_R1", "NO_SUCH_OBJECT"]

V1 = f"v1 as ({canon_sql('map_v1')})"
V2 = f"v2 as ({canon_sql('map_v2')})"
CYC = f"cyc as ({canon_sql('map_cyclic')})"
CAT = "cat as (select * from column_catalog)"
MAPS = ["map_v1", "map_v2"]
MAP_COLS = "source_table, source_field, dest_table, dest_field, rules, mapping_type, object_name"


def _catalog(spark, sf_dir):
    return read_column_catalog(spark, fx.spark_fixture(spark, sf_dir, "column_catalog"))


def _terms_sql(col: str) -> str:
    return "(" + " union all ".join(
        f"select '{t}' as term" for t in SEARCH_TERMS) + f") as terms on strpos(lower({col}), term) > 0"


TABLES_SQL = """tabs as (select source_table as table_name from v1 union select dest_table from v1
 union select source_table from v2 union select dest_table from v2)"""
FIELDS_SQL = """flds as (select source_table as table_name, source_field as field_name from v2
 union select dest_table, dest_field from v2)"""
LAYER_SQL = """case when lower({c}) like 'src\\_%' escape '\\' then 'SRC' when lower({c}) like 'stg\\_%' escape '\\' then 'STG'
 when lower({c}) like 'dim\\_%' escape '\\' then 'DIM' when lower({c}) like 'fact\\_%' escape '\\' then 'FACT'
 when lower({c}) like 'rpt\\_%' escape '\\' then 'RPT' else 'OTH' end"""


@register("graph_edges", needs=["map_v1"], oracle=f"""
with {V1}
select source_table, dest_table, count(*) as mapping_count,
       string_agg(distinct mapping_type, ',' order by mapping_type) as mapping_types
from v1 group by source_table, dest_table
""")
def q_graph_edges(spark, sf_dir):
    """A5: table edges with mapping counts."""
    return G.graph_edges(mappings(spark, sf_dir)).withColumn(
        "mapping_types", F.array_join("mapping_types", ","))


@register("field_edges", needs=["map_v1"], oracle=f"""
with {V1}
select {MAP_COLS},
       row_number() over (partition by source_table, dest_table
                          order by source_field, dest_field, rules, mapping_type, object_name) - 1 as edge_index,
       count(*) over (partition by source_table, dest_table) as edge_size
from v1
""")
def q_field_edges(spark, sf_dir):
    """One row per mapping with its index and edge size."""
    return G.field_edges(mappings(spark, sf_dir)).select(
        *MAP_COLS.split(", "), "edge_index", "edge_size")


@register("all_tables", needs=MAPS, oracle=f"with {V1}, {V2}, {TABLES_SQL} select table_name from tabs")
def q_all_tables(spark, sf_dir):
    """Tables of both versions, both ends."""
    return G.all_tables(mappings(spark, sf_dir, "map_v1"), mappings(spark, sf_dir, "map_v2"))


@register("table_layers", needs=MAPS, oracle=f"""
with {V1}, {V2}, {TABLES_SQL}
select table_name, {LAYER_SQL.format(c='table_name')} as layer,
  case {LAYER_SQL.format(c='table_name')} when 'SRC' then 0 when 'STG' then 1 when 'DIM' then 2 when 'FACT' then 2
   when 'RPT' then 3 else 4 end as layer_order
from tabs
""")
def q_table_layers(spark, sf_dir):
    """Layer and layer order of every table."""
    t = G.all_tables(mappings(spark, sf_dir, "map_v1"), mappings(spark, sf_dir, "map_v2"))
    return t.select("table_name", table_layer("table_name").alias("layer"),
                    layer_order(table_layer("table_name")).alias("layer_order"))


@register("mapping_classes", needs=["map_v1"], oracle=f"""
with {V1}
select mapping_type,
  case when lower(mapping_type) like '%join%' then 'join-type' when lower(mapping_type) like '%lookup%' then 'lookup-type'
   when lower(mapping_type) like '%transform%' or lower(mapping_type) like '%calc%' then 'transform-type'
   else 'map-type' end as mapping_class, count(*) as mapping_count
from v1 group by all
""")
def q_mapping_classes(spark, sf_dir):
    """Display class of every mapping type, with counts."""
    m = mappings(spark, sf_dir)
    return m.groupBy("mapping_type", mapping_class("mapping_type").alias("mapping_class")).agg(
        F.count(F.lit(1)).cast("long").alias("mapping_count"))


@register("graph_nodes", needs=MAPS + ["column_catalog"], oracle=f"""
with {V1}, {V2}, {CAT}, {TABLES_SQL},
e as (select distinct source_table, dest_table from v2),
up as (select dest_table as table_name, count(*) as upstream_count from e group by 1),
dn as (select source_table as table_name, count(*) as downstream_count from e group by 1),
cc as (select table_name, count(*) as column_count, count(*) filter (where is_pk) as pk_count,
              count(*) filter (where is_fk) as fk_count from cat group by 1)
select t.table_name, {LAYER_SQL.format(c='t.table_name')} as layer,
       coalesce(column_count, 0) as column_count, coalesce(pk_count, 0) as pk_count, coalesce(fk_count, 0) as fk_count,
       coalesce(upstream_count, 0) as upstream_count, coalesce(downstream_count, 0) as downstream_count
from tabs t left join up using (table_name) left join dn using (table_name) left join cc using (table_name)
""")
def q_graph_nodes(spark, sf_dir):
    """Per table metadata and neighbour counts."""
    return G.graph_nodes(mappings(spark, sf_dir, "map_v1"), mappings(spark, sf_dir, "map_v2"),
                         _catalog(spark, sf_dir))


@register("mapped_fields", needs=MAPS, oracle=f"with {V1}, {V2}, {FIELDS_SQL} select * from flds")
def q_mapped_fields(spark, sf_dir):
    """Distinct mapped fields per table (graph of V2)."""
    return G.mapped_fields(mappings(spark, sf_dir, "map_v2"))


@register("field_roles", needs=MAPS, oracle=f"""
with {V2},
x as (select source_table as table_name, source_field as field_name, 1 as o, 0 as i from v2
      union all select dest_table, dest_field, 0, 1 from v2)
select table_name, field_name, sum(o) > 0 as is_source, sum(i) > 0 as is_target,
       sum(o) as mappings_out, sum(i) as mappings_in from x group by 1, 2
""")
def q_field_roles(spark, sf_dir):
    """A10: field roles with mapping counts in and out."""
    return G.field_roles(mappings(spark, sf_dir, "map_v2"))


@register("objects_index", needs=MAPS, oracle=f"""
with {V2} select object_name, count(*) as mapping_count from v2
where object_name not in ('', 'nan') group by 1
""")
def q_objects_index(spark, sf_dir):
    """Mappings per ETL object."""
    return G.objects_index(mappings(spark, sf_dir, "map_v2"))


@register("object_profile", needs=MAPS, oracle=f"""
with {V2} select object_name, count(*) as mapping_count, count(distinct source_table) as source_table_count,
  count(distinct dest_table) as target_table_count from v2 where object_name not in ('', 'nan') group by 1
""")
def q_object_profile(spark, sf_dir):
    """Per object counts of mappings, source and target tables."""
    return G.object_profile(mappings(spark, sf_dir, "map_v2"))


@register("object_targets", needs=MAPS, oracle=f"""
with {V2} select object_name, dest_table, count(*) as mapping_count from v2
where object_name not in ('', 'nan') group by 1, 2
""")
def q_object_targets(spark, sf_dir):
    """Per object, mappings grouped by target table."""
    return G.object_targets(mappings(spark, sf_dir, "map_v2"))


@register("table_profile", needs=MAPS + ["column_catalog"], oracle=f"""
with {V1}, {V2}, {CAT}, {TABLES_SQL}, {FIELDS_SQL},
e as (select distinct source_table, dest_table from v2),
up as (select dest_table as table_name, count(*) as upstream_count from e group by 1),
dn as (select source_table as table_name, count(*) as downstream_count from e group by 1),
mp as (select f.table_name, count(*) as mapped_field_count,
              count(*) filter (where coalesce(c.is_pk, false)) as mapped_pk_count,
              count(*) filter (where coalesce(c.is_fk, false)) as mapped_fk_count
       from flds f left join cat c on c.table_name = f.table_name and c.column_name = f.field_name group by 1),
ot as (select c.table_name, count(*) as other_column_count
       from cat c where not exists (select 1 from flds f where f.table_name = c.table_name and f.field_name = c.column_name)
       group by 1)
select t.table_name, coalesce(upstream_count, 0) as upstream_count, coalesce(downstream_count, 0) as downstream_count,
       coalesce(mapped_field_count, 0) as mapped_field_count, coalesce(mapped_pk_count, 0) as mapped_pk_count,
       coalesce(mapped_fk_count, 0) as mapped_fk_count, coalesce(other_column_count, 0) as other_column_count
from tabs t left join up using (table_name) left join dn using (table_name) left join mp using (table_name)
left join ot using (table_name)
""")
def q_table_profile(spark, sf_dir):
    """Table detail panel data."""
    return G.table_profile(mappings(spark, sf_dir, "map_v2"), _catalog(spark, sf_dir),
                           v1=mappings(spark, sf_dir, "map_v1"))


@register("unmapped_columns", needs=MAPS + ["column_catalog"], oracle=f"""
with {V1}, {V2}, {CAT}, {FIELDS_SQL}
select table_name, column_name as field_name, is_pk, is_fk from cat c
where not exists (select 1 from flds f where f.table_name = c.table_name and f.field_name = c.column_name)
""")
def q_unmapped_columns(spark, sf_dir):
    """Catalog columns without a mapping."""
    return G.unmapped_columns(mappings(spark, sf_dir, "map_v2"), _catalog(spark, sf_dir))


@register("table_list", needs=MAPS, oracle=f"""
with {V1}, {V2}, {TABLES_SQL}, {FIELDS_SQL},
c as (select table_name, count(*) as n from flds group by 1)
select table_name, {LAYER_SQL.format(c='table_name')} as layer,
  case {LAYER_SQL.format(c='table_name')} when 'SRC' then 0 when 'STG' then 1 when 'DIM' then 2 when 'FACT' then 2
   when 'RPT' then 3 else 4 end as layer_order, coalesce(n, 0) as mapped_field_count
from tabs left join c using (table_name) order by table_name
""")
def q_table_list(spark, sf_dir):
    """Sorted table list with layer and mapped-field count."""
    return G.table_list(mappings(spark, sf_dir, "map_v1"), mappings(spark, sf_dir, "map_v2"))


@register("edge_profile", needs=["map_v1"], oracle=f"""
with {V1}
select source_table, dest_table, source_field, dest_field,
  case when mapping_type = '' then 'MAP' else mapping_type end as mapping_type,
  case when rules = 'nan' then '' else rules end as rule,
  case when lower(mapping_type) like '%join%' then 'join-type' when lower(mapping_type) like '%lookup%' then 'lookup-type'
   when lower(mapping_type) like '%transform%' or lower(mapping_type) like '%calc%' then 'transform-type'
   else 'map-type' end as mapping_class,
  case when object_name in ('', 'nan') then '' else object_name end as object_name
from v1
""")
def q_edge_profile(spark, sf_dir):
    """Mapping detail rows of every table edge."""
    return G.edge_profile(mappings(spark, sf_dir))


@register("direct_only_edges", needs=["map_v1"], oracle=f"""
with {V1}
select source_table, dest_table, count(*) as mapping_count,
       string_agg(distinct mapping_type, ',' order by mapping_type) as mapping_types
from v1 where upper(coalesce(mapping_type, 'MAP')) in ('MAP', 'MAPPING', '') group by 1, 2
""")
def q_direct_only_edges(spark, sf_dir):
    """Table edges keeping only direct mappings; emptied edges vanish."""
    return G.graph_edges(G.direct_only(mappings(spark, sf_dir))).withColumn(
        "mapping_types", F.array_join("mapping_types", ","))


@register("preview_fields", needs=MAPS, oracle=f"""
with {V2}, {FIELDS_SQL},
r as (select table_name, field_name, row_number() over (partition by table_name order by field_name) as position,
             count(*) over (partition by table_name) as n from flds)
select table_name, field_name, position, greatest(n - 8, 0) as more_count from r where position <= 8
""")
def q_preview_fields(spark, sf_dir):
    """First 8 mapped fields of each table and how many more."""
    return G.preview_fields(mappings(spark, sf_dir, "map_v2"))


SEARCH_INDEX_SQL = f"""{TABLES_SQL}, {FIELDS_SQL},
idx as (
 select 'table' as kind, table_name, null as field_name, null as object_name, table_name as display,
        cast(null as bigint) as mapping_count, 0 as ord_kind from tabs
 union all
 select 'field', table_name, field_name, null, table_name || '.' || field_name, null, 1 from flds
 union all
 select 'object', null, null, object_name, object_name, count(*), 2 from v2
 where object_name not in ('', 'nan') group by object_name)
"""


@register("search_index", needs=MAPS, oracle=f"""
with {V1}, {V2}, {SEARCH_INDEX_SQL}
select kind, table_name, field_name, object_name, display, mapping_count, ord_kind, lower(display) as search_text
from idx
""")
def q_search_index(spark, sf_dir):
    """Search entries for tables, mapped fields and objects."""
    return G.search_index(mappings(spark, sf_dir, "map_v1"), mappings(spark, sf_dir, "map_v2"))


@register("search_top15", needs=MAPS, oracle=f"""
with {V1}, {V2}, {SEARCH_INDEX_SQL},
hits as (select i.*, term from idx i join {_terms_sql('display')}),
r as (select *, row_number() over (partition by term order by case when kind = 'object' then 1 else 0 end,
        coalesce(table_name, object_name), ord_kind, coalesce(field_name, '')) as rank from hits)
select term, rank, kind, display, table_name, field_name, object_name, mapping_count from r where rank <= 15
""")
def q_search_top15(spark, sf_dir):
    """T4: first 15 index entries per search term."""
    idx = G.search_index(mappings(spark, sf_dir, "map_v1"), mappings(spark, sf_dir, "map_v2"))
    return G.search(idx, SEARCH_TERMS)


@register("search_terms", needs=MAPS, oracle=f"""
with {V1}, {V2}, {SEARCH_INDEX_SQL},
terms as (select distinct lower(trim(object_name)) as term from v1 where trim(object_name) <> ''
          union select lower(dest_field) from v1 where dest_field <> ''
          union select lower(source_field) from v1 where source_field <> ''
          union select lower(trim(object_name)) from v2 where trim(object_name) <> ''
          union select lower(dest_field) from v2 where dest_field <> ''
          union select lower(source_field) from v2 where source_field <> ''
          union select term from (values {', '.join(f"('{t}')" for t in SEARCH_TERMS)}) as s(term)),
hits as (select i.*, term from idx i join terms on contains(lower(display), term)),
r as (select *, row_number() over (partition by term order by case when kind = 'object' then 1 else 0 end,
        coalesce(table_name, object_name), ord_kind, coalesce(field_name, '')) as rank from hits)
select term, rank, kind, display, table_name, field_name, object_name, mapping_count from r where rank <= 15
""")
def q_search_terms(spark, sf_dir):
    """T4: first 15 index entries for every object and field name of both versions (fields of both ends) as a term,
    through the substring index."""
    v1, v2 = mappings(spark, sf_dir, "map_v1"), mappings(spark, sf_dir, "map_v2")
    idx = G.search_index(v1, v2)
    typed = spark.createDataFrame([(t,) for t in SEARCH_TERMS], "term string")
    return G.search_terms(idx, G.all_names(v1, v2).union(typed), substring_index.build(idx, "search_text"))


@register("filter_tables", needs=MAPS, oracle=f"""
with {V1}, {V2}, {TABLES_SQL}, {FIELDS_SQL},
nh as (select table_name, term from tabs join {_terms_sql('table_name')}),
fh as (select table_name, term, count(*) as n from flds join {_terms_sql('field_name')} group by 1, 2)
select coalesce(nh.term, fh.term) as term, coalesce(nh.table_name, fh.table_name) as table_name,
       nh.table_name is not null as table_match, coalesce(fh.n, 0) as matching_field_count
from nh full outer join fh on nh.table_name = fh.table_name and nh.term = fh.term
""")
def q_filter_tables(spark, sf_dir):
    """Tables matching each search term by name or mapped field."""
    return G.filter_tables(mappings(spark, sf_dir, "map_v1"), mappings(spark, sf_dir, "map_v2"), SEARCH_TERMS)


# ---------------------------------------------------------------------------
# traversal
# ---------------------------------------------------------------------------

REACH_UP_SQL = """
e as (select distinct dest_table as st, dest_field as sf, source_table as dt, source_field as df from {m}),
seeds as (select distinct dest_table as seed_table, dest_field as seed_field from {m}
          where dest_table not in (select source_table from {m})),
r(seed_table, seed_field, t, f) as (
  select seed_table, seed_field, seed_table, seed_field from seeds
  union
  select r.seed_table, r.seed_field, e.dt, e.df from r join e on r.t = e.st and r.f = e.sf)
"""

REACH_DOWN_SQL = """
e as (select distinct source_table as st, source_field as sf, dest_table as dt, dest_field as df from {m}),
seeds as (select distinct source_table as seed_table, source_field as seed_field from {m}
          where source_table not in (select dest_table from {m})),
r(seed_table, seed_field, t, f) as (
  select seed_table, seed_field, seed_table, seed_field from seeds
  union
  select r.seed_table, r.seed_field, e.dt, e.df from r join e on r.t = e.st and r.f = e.sf)
"""


def _trace_out(df):
    return df.select("seed_table", "seed_field", *MAP_COLS.split(", "))


@register("trace_upstream", needs=["map_cyclic"], oracle=f"""
with recursive {CYC}, {REACH_UP_SQL.format(m='cyc')}
select r.seed_table, r.seed_field, {', '.join('m.' + c for c in MAP_COLS.split(', '))}
from r join cyc m on m.dest_table = r.t and m.dest_field = r.f
""")
def q_trace_upstream(spark, sf_dir):
    """G1: every mapping upstream of every field of a leaf table, on a cyclic graph."""
    m = mappings(spark, sf_dir, "map_cyclic")
    return _trace_out(G.trace_fields(spark, m, G.leaf_fields(m), upstream=True))


@register("trace_downstream", needs=["map_cyclic"], oracle=f"""
with recursive {CYC}, {REACH_DOWN_SQL.format(m='cyc')}
select r.seed_table, r.seed_field, {', '.join('m.' + c for c in MAP_COLS.split(', '))}
from r join cyc m on m.source_table = r.t and m.source_field = r.f
""")
def q_trace_downstream(spark, sf_dir):
    """G1: every mapping downstream of every field of a root table, on a cyclic graph."""
    m = mappings(spark, sf_dir, "map_cyclic")
    return _trace_out(G.trace_fields(spark, m, G.root_fields(m), upstream=False))


@register("traced_edges", needs=["map_cyclic"], oracle=f"""
with recursive {CYC}, {REACH_UP_SQL.format(m='cyc')}
select r.seed_table, r.seed_field, m.source_table, m.dest_table, count(*) as mapping_count
from r join cyc m on m.dest_table = r.t and m.dest_field = r.f group by all
""")
def q_traced_edges(spark, sf_dir):
    """Upstream traces regrouped into table edges per seed."""
    m = mappings(spark, sf_dir, "map_cyclic")
    return G.regroup_trace(G.trace_fields(spark, m, G.leaf_fields(m), upstream=True))


@register("traced_changes", needs=MAPS, oracle=f"""
with recursive {V1}, {V2} {DELTA_SQL}, {REACH_UP_SQL.format(m='v2')}
select r.seed_table, r.seed_field, m.source_table, m.dest_table, count(*) as mapping_count,
       arg_min(d.change_type, (m.source_field, m.dest_field)) as change_type
from r join v2 m on m.dest_table = r.t and m.dest_field = r.f
left join d on d.source_table = m.source_table and d.source_field = m.source_field
  and d.dest_table = m.dest_table and d.dest_field = m.dest_field
group by r.seed_table, r.seed_field, m.source_table, m.dest_table
""")
def q_traced_changes(spark, sf_dir):
    """Upstream traces of V2 regrouped into table edges with their change types."""
    v1, v2 = mappings(spark, sf_dir, "map_v1"), mappings(spark, sf_dir, "map_v2")
    keys = ["source_table", "source_field", "dest_table", "dest_field"]
    change = D.mapping_delta(v1, v2).select(*keys, "change_type")
    traced = G.trace_fields(spark, v2, G.leaf_fields(v2), upstream=True).join(change, keys, "left")
    return G.regroup_trace(traced)


@register("trace_object", needs=["map_cyclic"], oracle=f"""
with recursive {CYC},
own as (select * from cyc where object_name not in ('', 'nan')),
eu as (select distinct dest_table as st, dest_field as sf, source_table as dt, source_field as df from cyc),
ed as (select distinct source_table as st, source_field as sf, dest_table as dt, dest_field as df from cyc),
ru(o, t, f) as (select object_name, source_table, source_field from own
  union select ru.o, eu.dt, eu.df from ru join eu on ru.t = eu.st and ru.f = eu.sf),
rd(o, t, f) as (select object_name, dest_table, dest_field from own
  union select rd.o, ed.dt, ed.df from rd join ed on rd.t = ed.st and rd.f = ed.sf),
x as (
  select object_name as traced_object, {MAP_COLS}, true as flag from own
  union all
  select ru.o, {', '.join('m.' + c for c in MAP_COLS.split(', '))}, false
  from ru join cyc m on m.dest_table = ru.t and m.dest_field = ru.f
  union all
  select rd.o, {', '.join('m.' + c for c in MAP_COLS.split(', '))}, false
  from rd join cyc m on m.source_table = rd.t and m.source_field = rd.f)
select traced_object, {MAP_COLS}, bool_or(flag) as is_object_mapping from x group by all
""")
def q_trace_object(spark, sf_dir):
    """Each object's mappings plus everything upstream and downstream of them."""
    return G.trace_objects(spark, mappings(spark, sf_dir, "map_cyclic"))


@register("neighbourhood", needs=["map_v1"], oracle=f"""
with {V1},
e as (select distinct source_table, dest_table from v1),
s as (select distinct table_name as seed_table from
      (select source_table as table_name from v1 union select dest_table from v1) t),
d1 as (select seed_table, source_table, dest_table from s join e on e.source_table = s.seed_table),
u1 as (select seed_table, source_table, dest_table from s join e on e.dest_table = s.seed_table),
f as (select distinct seed_table, table_name from (
        select seed_table, dest_table as table_name from d1 union all select seed_table, source_table from u1) z
      where table_name <> seed_table)
select distinct * from (
  select * from d1 union all select * from u1
  union all select f.seed_table, e.source_table, e.dest_table from f join e on e.source_table = f.table_name
  union all select f.seed_table, e.source_table, e.dest_table from f join e on e.dest_table = f.table_name) z
""")
def q_neighbourhood(spark, sf_dir):
    """Two-hop neighbourhood of every table, both directions."""
    m = mappings(spark, sf_dir)
    seeds = G.all_tables(m).select(F.col("table_name").alias("seed_table"))
    return G.neighbourhood(m, seeds)


# the selected tables' fields; walks from them only
SELECTED_SQL = "(" + ", ".join(f"'{t}'" for t in SELECTED_TABLES) + ")"
SELECTED_SEEDS_SQL = f"""
eu as (select distinct dest_table as st, dest_field as sf, source_table as dt, source_field as df from cyc),
ed as (select distinct source_table as st, source_field as sf, dest_table as dt, dest_field as df from cyc),
seeds as (select source_table as seed_table, source_field as seed_field from cyc where source_table in {SELECTED_SQL}
          union select dest_table, dest_field from cyc where dest_table in {SELECTED_SQL}),
ru(seed_table, seed_field, t, f) as (select seed_table, seed_field, seed_table, seed_field from seeds
  union select ru.seed_table, ru.seed_field, eu.dt, eu.df from ru join eu on ru.t = eu.st and ru.f = eu.sf),
rd(seed_table, seed_field, t, f) as (select seed_table, seed_field, seed_table, seed_field from seeds
  union select rd.seed_table, rd.seed_field, ed.dt, ed.df from rd join ed on rd.t = ed.st and rd.f = ed.sf)
"""


def _selected_seeds(m):
    ends = m.select(F.col("source_table").alias("seed_table"), F.col("source_field").alias("seed_field")).union(
        m.select("dest_table", "dest_field"))
    return ends.where(F.col("seed_table").isin(SELECTED_TABLES)).distinct()


@register("trace_selection", needs=["map_cyclic"], oracle=f"""
with recursive {CYC}, {SELECTED_SEEDS_SQL}
select 'up' as direction, r.seed_table, r.seed_field, {', '.join('m.' + c for c in MAP_COLS.split(', '))}
from ru r join cyc m on m.dest_table = r.t and m.dest_field = r.f
union all
select 'down', r.seed_table, r.seed_field, {', '.join('m.' + c for c in MAP_COLS.split(', '))}
from rd r join cyc m on m.source_table = r.t and m.source_field = r.f
""")
def q_trace_selection(spark, sf_dir):
    """G1: every mapping above and below the fields of the selected tables, by the reach index."""
    m = mappings(spark, sf_dir, "map_cyclic")
    seeds = _selected_seeds(m)
    up_index, down_index = G.field_indexes(spark, m)
    up = G.trace_selection(up_index, m, seeds, True)
    down = G.trace_selection(down_index, m, seeds, False)
    return up.withColumn("direction", F.lit("up")).unionByName(down.withColumn("direction", F.lit("down")))


@register("selection_edges", needs=["map_cyclic"], oracle=f"""
with recursive {CYC}, {SELECTED_SEEDS_SQL}
select r.seed_table, r.seed_field, m.source_table, m.dest_table, count(*) as mapping_count
from ru r join cyc m on m.dest_table = r.t and m.dest_field = r.f group by all
""")
def q_selection_edges(spark, sf_dir):
    """Upstream traces of the selected fields regrouped into table edges, by the reach index."""
    m = mappings(spark, sf_dir, "map_cyclic")
    return G.regroup_trace(G.trace_selection(G.field_index(spark, m, True), m, _selected_seeds(m), True))


@register("object_selection", needs=["map_cyclic"], oracle=f"""
with recursive {CYC},
own as (select * from cyc where object_name in ({', '.join(f"'{o}'" for o in SELECTED_OBJECTS)})),
eu as (select distinct dest_table as st, dest_field as sf, source_table as dt, source_field as df from cyc),
ed as (select distinct source_table as st, source_field as sf, dest_table as dt, dest_field as df from cyc),
ru(o, t, f) as (select object_name, source_table, source_field from own
  union select ru.o, eu.dt, eu.df from ru join eu on ru.t = eu.st and ru.f = eu.sf),
rd(o, t, f) as (select object_name, dest_table, dest_field from own
  union select rd.o, ed.dt, ed.df from rd join ed on rd.t = ed.st and rd.f = ed.sf),
x as (
  select object_name as traced_object, {MAP_COLS}, true as flag from own
  union all
  select ru.o, {', '.join('m.' + c for c in MAP_COLS.split(', '))}, false
  from ru join cyc m on m.dest_table = ru.t and m.dest_field = ru.f
  union all
  select rd.o, {', '.join('m.' + c for c in MAP_COLS.split(', '))}, false
  from rd join cyc m on m.source_table = rd.t and m.source_field = rd.f)
select traced_object, {MAP_COLS}, bool_or(flag) as is_object_mapping from x group by all
""")
def q_object_selection(spark, sf_dir):
    """Selected objects' mappings plus everything above and below them, by the reach index."""
    m = mappings(spark, sf_dir, "map_cyclic")
    objects = m.select("object_name").where(F.col("object_name").isin(SELECTED_OBJECTS))
    return G.object_selection(*G.field_indexes(spark, m), m, objects)


@register("neighbourhood_selection", needs=["map_v1"], oracle=f"""
with {V1},
e as (select distinct source_table, dest_table from v1),
s as (select distinct table_name as seed_table from
      (select source_table as table_name from v1 union select dest_table from v1) t where table_name in {SELECTED_SQL}),
d1 as (select seed_table, source_table, dest_table from s join e on e.source_table = s.seed_table),
u1 as (select seed_table, source_table, dest_table from s join e on e.dest_table = s.seed_table),
f as (select distinct seed_table, table_name from (
        select seed_table, dest_table as table_name from d1 union all select seed_table, source_table from u1) z
      where table_name <> seed_table)
select distinct * from (
  select * from d1 union all select * from u1
  union all select f.seed_table, e.source_table, e.dest_table from f join e on e.source_table = f.table_name
  union all select f.seed_table, e.source_table, e.dest_table from f join e on e.dest_table = f.table_name) z
""")
def q_neighbourhood_selection(spark, sf_dir):
    """Two-hop neighbourhood of the selected tables."""
    m = mappings(spark, sf_dir)
    seeds = G.all_tables(m).where(F.col("table_name").isin(SELECTED_TABLES))
    return G.neighbourhood(m, seeds.select(F.col("table_name").alias("seed_table")))


DEPTH_SQL = f"""
{TABLES_SQL},
e as (select distinct source_table, dest_table from v1),
roots as (select table_name from tabs where table_name not in (select dest_table from e)),
p(t, d) as (select table_name, 0 from roots
  union select e.dest_table, p.d + 1 from p join e on p.t = e.source_table and e.source_table <> e.dest_table),
dep as (select table_name, coalesce((select max(d) from p where p.t = tabs.table_name), 0) as depth from tabs)
"""


@register("table_depth", needs=MAPS, oracle=f"with recursive {V1}, {V2}, {DEPTH_SQL} select * from dep")
def q_table_depth(spark, sf_dir):
    """Longest path from a root for every table (V1 edges, nodes of both versions)."""
    v1, v2 = mappings(spark, sf_dir, "map_v1"), mappings(spark, sf_dir, "map_v2")
    return G.table_depth(spark, v1, nodes=G.all_tables(v1, v2))


@register("depth_layers", needs=MAPS, oracle=f"""
with recursive {V1}, {V2}, {DEPTH_SQL}
select table_name, depth, row_number() over (partition by depth order by table_name) - 1 as layer_position,
       count(*) over (partition by depth) as layer_size from dep
""")
def q_depth_layers(spark, sf_dir):
    """Tables laid out by depth layer."""
    return G.depth_layers(q_table_depth(spark, sf_dir)).select(
        "table_name", "depth", "layer_position", "layer_size")


@register("graph_json", needs=MAPS + ["column_catalog"])
def q_graph_json(spark, sf_dir):
    """The viewer's data as JSON lines: config, tables and columns, both versions' graphs, the delta."""
    from columbine.operators.report import graph_json

    return graph_json(mappings(spark, sf_dir, "map_v1"), mappings(spark, sf_dir, "map_v2"), _catalog(spark, sf_dir))


@register("dm_pairs", needs=["map_v1"], oracle=f"""
with {V1},
raw as (select lower(source_table) as t, '"' || source_field || '"' as c, row_ord from v1
        union all select '  ' || dest_table, dest_field, row_ord from v1
        union all select '', 'X', 0 union all select 'T', '   ', 0),
n as (select upper(trim(regexp_replace(t, '\\s+', ' ', 'g'))) as t0, upper(trim(regexp_replace(c, '\\s+', ' ', 'g'))) as c0,
             row_ord from raw),
q as (select case when t0 like '"%"' then substring(t0, 2, length(t0) - 2) else t0 end as table_name,
             case when c0 like '"%"' and length(c0) >= 2 then substring(c0, 2, length(c0) - 2) else c0 end as column_name,
             row_ord from n),
f as (select table_name, column_name, min(row_ord) as p from q where table_name <> '' and column_name <> '' group by 1, 2)
select table_name, column_name, row_number() over (partition by table_name order by p, column_name) as ordinal from f
""")
def q_dm_pairs(spark, sf_dir):
    """S3: data model read from a sheet: identifiers normalized, blanks dropped, distinct, ordinal by first row."""
    from columbine.sources.io import read_data_model

    m = mappings(spark, sf_dir)
    raw = (m.select(F.lower("source_table").alias("Table Physical Name"),
                    F.concat(F.lit('"'), "source_field", F.lit('"')).alias("Column Physical Name"), "row_ord")
           .unionByName(m.select(F.concat(F.lit("  "), "dest_table").alias("Table Physical Name"),
                                 F.col("dest_field").alias("Column Physical Name"), "row_ord"))
           .unionByName(spark.createDataFrame([("", "X", 0), ("T", "   ", 0)],
                                              "`Table Physical Name` string, `Column Physical Name` string, row_ord long")))
    return read_data_model(spark, raw.withColumnRenamed("row_ord", "ordinal"))


@register("column_catalog", needs=["column_catalog"], oracle="""
select table_name, column_name, data_type, coalesce(is_pk, false) as is_pk, coalesce(is_fk, false) as is_fk,
       description from column_catalog
""")
def q_column_catalog(spark, sf_dir):
    """Column catalog read through its sheet headers, flags as booleans."""
    cat = fx.spark_fixture(spark, sf_dir, "column_catalog").select(
        F.col("table_name").alias("Table Name"), F.col("column_name").alias("Column Name"),
        F.col("data_type").alias("Data Type"), F.col("is_pk").cast("string").alias("Is PK"),
        F.col("is_fk").cast("string").alias("Is FK"), F.col("description").alias("Description"))
    return read_column_catalog(spark, cat)


@register("dm_match", needs=MAPS + ["dm_pairs"], oracle=f"""
with {V2}, d as (select distinct upper(table_name) as t, upper(column_name) as c from dm_pairs)
select source_table, source_field, case when d.t is null then 'N' else 'Y' end as dm_match, count(*) as n
from v2 left join d on d.t = v2.source_table and d.c = v2.source_field group by all
""")
def q_dm_match(spark, sf_dir):
    """Y/N data-model match of every source column (broadcast-size DM side chosen by AQE)."""
    m = mappings(spark, sf_dir, "map_v2")
    d = fx.spark_fixture(spark, sf_dir, "dm_pairs").select(
        F.upper("table_name").alias("source_table"), F.upper("column_name").alias("source_field")).distinct() \
        .withColumn("_y", F.lit("Y"))
    return (m.join(d, ["source_table", "source_field"], "left")
            .groupBy("source_table", "source_field", F.coalesce("_y", F.lit("N")).alias("dm_match"))
            .agg(F.count(F.lit(1)).cast("long").alias("n")))
