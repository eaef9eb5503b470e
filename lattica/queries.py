"""Registered queries over the test tables, each with the SQL it is checked against.

The tables stand in for a citation graph: an order is a referenced work with a year, a part a citing work, a line item a
link, a supplier an institution in its nation, a customer an author, an order's priority its source, a brand a subfield, a type a topic.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import filters, labels, links, prune, ranking, rollup, search, similar, slugs, stats
from .plans import api, entities, trees
from .scratch import new_folder, written
from .sources import records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

YEARS = (1995, 1997, 1998, 1999, 2000, 2001)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        name = f.__name__.strip("_")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def i64(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


# --- rollups -----------------------------------------------------------------------------------------------------

_GEO = ["k1", "k2", "k3"]


def lines_extent(t: Tables) -> rollup.Extent:
    return rollup.extent(t.lineitem.select(F.col("l_orderkey").alias("ref")))


def geo_tuples(t: Tables) -> DataFrame:
    """(region, nation of the supplier, brand of the part, order, part, year)."""
    supplier = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey", "n_nationkey")
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey")
    return (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t.orders.select("o_orderkey", F.year("o_orderdate").alias("year")), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("n_regionkey").cast("long").alias("k1"), F.col("n_nationkey").cast("long").alias("k2"), F.col("p_brand").alias("k3"), F.col("l_orderkey").alias("ref"), F.col("l_partkey").alias("cit"), "year")
    )


_GEO_BASE = """
  base as (select distinct cast(sn.n_regionkey as bigint) as k1, cast(sn.n_nationkey as bigint) as k2, p.p_brand as k3,
                  l.l_orderkey as ref, l.l_partkey as cit, year(o.o_orderdate) as year
           from lineitem l join orders o on o.o_orderkey = l.l_orderkey join supplier s on s.s_suppkey = l.l_suppkey
           join nation sn on sn.n_nationkey = s.s_nationkey join part p on p.p_partkey = l.l_partkey)"""


def rollup_sql(keys: list[str], base: str, where: str = "true", select: str | None = None, extra: str = "") -> str:
    """SQL for a rollup: ``base`` defines the relation base(keys, ref, cit, ...)."""
    sets = ", ".join("(" + ", ".join([*keys[:d], *([extra] if extra else []), "ref"]) + ")" for d in range(len(keys) + 1))
    by = ", ".join([*keys, *([extra] if extra else [])])
    depth = " + ".join(f"(1 - grouping({k}))" for k in keys)
    return f"""with {base},
  links as (select distinct {by}, ref, cit from base where {where}),
  g as (select {depth} as depth, {by}, ref, count(distinct cit) as n from links group by grouping sets ({sets})),
  r as (select *, row_number() over (partition by depth, {by} order by n desc, ref) as rn from g),
  tree as (select cast(depth as int) as depth, {by}, cast(sum(n) as bigint) as link_count, count(*) as source_count,
                  max(case when rn = 1 then ref end) as top_source, max(n) as top_source_links from r group by depth, {by})
  {select or "select * from tree"}"""


@query(rollup_sql(_GEO, _GEO_BASE))
def tree_supplier_geo(t):
    return rollup.rollup(geo_tuples(t), _GEO, lines_extent(t))


@query(rollup_sql(_GEO, _GEO_BASE, "year >= 1998"))
def tree_year_filter(t):
    return rollup.rollup(rollup.since_year(geo_tuples(t), 1998), _GEO, lines_extent(t))


_PERIODS_SQL = " union all ".join(f"select {i} as period, base.* from base where year >= {y}" for i, y in enumerate(YEARS))


@query(rollup_sql(_GEO, f"{_GEO_BASE.replace(' base as', ' base0 as')}, base as ({_PERIODS_SQL.replace('base.*', 'base0.*').replace('from base ', 'from base0 ')})", extra="period"))
def tree_all_periods(t):
    return rollup.rollup_periods(geo_tuples(t).withColumn("period", C.period(F.col("year"), YEARS)), _GEO, len(YEARS), lines_extent(t))


def brand_baseline(t: Tables) -> DataFrame:
    """Baselines of brands by their share of all links."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("key")).agg(F.count("*").alias("citations"))
    rows = written(rows, "brands")
    total, n = rows.agg(F.sum("citations"), F.count("*")).first()
    return prune.baseline_share(rows, total, n)


_BRAND_BASE = "base_b as (select p_brand as key, (c * 0.55e0 + sum(c) over () / count(*) over () * 0.45e0) / sum(c) over () as baseline from (select p_brand, count(*) as c from lineitem join part on l_partkey = p_partkey group by p_brand))"


def prune_sql(tree_base: str, keys: list[str], denominators: list[int], baselines: dict[int, str], where: str = "true", last: str = "") -> str:
    out, parts = "", ["l0 as (select * from tree where depth = 0)"]
    for d, key in enumerate(keys):
        above = keys[:d]
        same = lambda a, b, ks: " and ".join(f"{a}.{k} is not distinct from {b}.{k}" for k in ks) or "true"
        base = f"left join {baselines[d]} bl on bl.key = c.{key}" if d in baselines else ""
        ratio = "coalesce(bl.baseline, 1e0)" if d in baselines else "1e0"
        path = ", ".join(f"c.{k}" for k in above) or "c.depth"
        parts.append(
            f"""s{d + 1} as (select c.*, c.link_count / cast(a.link_count as double) / {ratio} as spec, count(*) over (partition by {path}) as nc
      from tree c join tree a on a.depth = {denominators[d]} and {same("a", "c", keys[: denominators[d]])} {base}
      where c.depth = {d + 1} and exists (select 1 from l{d} p where {same("p", "c", above)})),
    k{d + 1}r as (select *, row_number() over (partition by {", ".join(above) or "depth"} order by link_count desc, {key} desc) as rw,
      row_number() over (partition by {", ".join(above) or "depth"} order by spec desc, {key} desc) as rs from s{d + 1} where nc <= 16 or {key} is not null),
    l{d + 1} as (select depth, {", ".join(keys)}, link_count, source_count, top_source, top_source_links from k{d + 1}r where nc <= 16 or rw <= 16 or rs <= 16)"""
        )
        out += f" union all select * from l{d + 1}"
    return rollup_sql(keys, tree_base, where, f", {', '.join(parts)} select * from (select * from l0{out}) {last}")


_PRUNED = prune_sql(f"{_BRAND_BASE}, {_GEO_BASE}", _GEO, [0, 0, 2], {2: "base_b"})


@query(_PRUNED)
def tree_pruned(t):
    return prune.prune(tree_supplier_geo(t), _GEO, [0, 0, 2], {2: brand_baseline(t)})


@query(prune_sql(f"{_BRAND_BASE}, {_GEO_BASE}", _GEO, [0, 0, 2], {2: "base_b"}, last="where depth <= 2"))
def tree_shallow(t):
    return prune.cut(tree_pruned(t), 1)


@query(rollup_sql(_GEO, _GEO_BASE))
def tree_period_fold(t):
    """Two rollups over disjoint years, united."""
    rows, size = geo_tuples(t), lines_extent(t)
    return rollup.union_trees(rollup.rollup(rows.filter("year < 1998"), _GEO, size), rollup.rollup(rows.filter("year >= 1998"), _GEO, size), _GEO)


@query("select p_brand as k1, count(distinct l_orderkey) as refs, cast(count(distinct (l_orderkey, l_partkey)) as bigint) as links from lineitem join part on l_partkey = p_partkey group by p_brand")
def tree_single_level(t):
    nodes = rollup.rollup(geo_tuples(t).select(F.col("k3").alias("k1"), "ref", "cit"), ["k1"], lines_extent(t)).filter("depth = 1")
    return nodes.select("k1", F.col("source_count").alias("refs"), F.col("link_count").alias("links"))


# --- the catalogue of trees ----------------------------------------------------------------------------------------


def order_graph(t: Tables) -> trees.Graph:
    orders = t.orders.select(F.col("o_orderkey").alias("work"), "o_custkey", F.substring("o_orderpriority", 1, 1).cast("long").alias("source"), F.col("o_orderstatus").alias("topic"), F.year("o_orderdate").alias("year"))
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey")
    nation_of = t.supplier.select(F.col("s_suppkey").alias("inst"), F.col("s_nationkey").cast("long").alias("country"))
    r_inst = lines.select(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("inst")).distinct()
    c_inst = lines.select(F.col("l_partkey").alias("work"), F.col("l_suppkey").alias("inst")).distinct()
    r_ci, c_ci = (x.join(nation_of, "inst").select("work", "country", "inst") for x in (r_inst, c_inst))
    segment = orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("work", F.col("c_mktsegment").alias("subfield"), "topic")
    part = t.part.select(F.col("p_partkey").alias("work"), F.col("p_brand").alias("subfield"), F.col("p_type").alias("topic"), (F.col("p_size") % 10).cast("long").alias("source"))
    author = orders.select("work", F.col("o_custkey").alias("author")).union(r_inst).distinct()  # its customer and its suppliers
    tables = {
        ("r", "source"): orders.select("work", "source"), ("r", "quartile_source"): orders.select("work", (F.col("year") % 4).cast("long").alias("quartile"), "source"),
        ("r", "subfield"): segment.select("work", "subfield"), ("r", "subfield_topic"): segment, ("r", "inst"): r_inst, ("r", "country_inst"): r_ci,
        ("r", "author"): author, ("r", "author_inst"): author.join(r_inst, "work"), ("r", "inst_country"): nation_of,
        ("c", "subfield"): part.select("work", "subfield"), ("c", "topic"): part.select("work", "topic"), ("c", "subfield_topic"): part.select("work", "subfield", "topic"),
        ("c", "source"): part.select("work", "source"), ("c", "country_inst"): c_ci, ("c", "country"): c_ci.select("work", "country").distinct(),
    }
    root = lambda frame, col: frame.select(F.col(col).alias("entity"), "work").distinct()
    roots = {"authors": root(author, "author"), "institutions": root(r_inst, "inst"), "countries": root(r_ci, "country"), "sources": root(orders, "source"), "subfields": root(segment, "subfield")}
    citing = lines.select(F.col("l_orderkey").alias("ref"), F.col("l_partkey").alias("cit")).distinct()
    return trees.Graph(citing, orders.select(F.col("work").alias("ref"), "year"), tables, roots, YEARS, extent=lines_extent(t))


_GRAPH_SQL = """
  links as (select distinct l_orderkey as ref, l_partkey as cit from lineitem),
  nation_of as (select s_suppkey as inst, cast(s_nationkey as bigint) as country from supplier),
  r_source as (select o_orderkey as work, cast(left(o_orderpriority, 1) as bigint) as source, cast(year(o_orderdate) % 4 as bigint) as quartile, year(o_orderdate) as year from orders),
  r_segment as (select o_orderkey as work, c_mktsegment as subfield, o_orderstatus as topic from orders join customer on c_custkey = o_custkey),
  r_ci as (select distinct l_orderkey as work, country, inst from lineitem join nation_of on inst = l_suppkey),
  r_author as (select o_orderkey as work, o_custkey as author from orders union select l_orderkey, l_suppkey from lineitem),
  c_part as (select p_partkey as work, p_brand as subfield, p_type as topic, cast(p_size % 10 as bigint) as source from part),
  c_ci as (select distinct l_partkey as work, country, inst from lineitem join nation_of on inst = l_suppkey),
  c_country as (select distinct work, country from c_ci)"""

_ROOT = {
    "authors": (11, "r_author where author = 11"), "institutions": (7, "r_ci where inst = 7"), "countries": (3, "r_ci where country = 3"),
    "sources": (2, "r_source where source = 2"), "subfields": ("BUILDING", "r_segment where subfield = 'BUILDING'"),
}

#: root, number: levels, joins (r tables meet the order, c tables the part), further condition
_TREE_SQL = {
    ("authors", 0): ("rs.source, ref, cc.country, cc.inst", "r_source rs, c_ci cc", ""),
    ("authors", 1): ("co.country, p.subfield, p.topic", "c_country co, c_part p", ""),
    ("authors", 2): ("rg.subfield, cc.country, cc.inst, p.subfield", "r_segment rg, c_ci cc, c_part p", ""),
    ("authors", 3): ("rg.subfield, ref, cc.country, cc.inst", "r_segment rg, c_ci cc", ""),
    ("authors", 4): ("rg.subfield, p.subfield, p.topic", "r_segment rg, c_part p", ""),
    ("authors", 5): ("cc.country, cc.inst, p.subfield, p.topic", "c_ci cc, c_part p", ""),
    ("authors", 6): ("rs.source, rg.subfield, co.country", "r_source rs, r_segment rg, c_country co", ""),
    ("authors", 7): ("ra.author, ref, p.subfield", "r_author ra, c_part p", "ra.author <> 11"),
    ("authors", 8): ("ra.author, cc.country, cc.inst", "r_author ra, c_ci cc", "ra.author <> 11"),
    ("institutions", 0): ("rg.subfield, p.subfield, p.topic", "r_segment rg, c_part p", ""),
    ("institutions", 1): ("p.subfield, p.source, p.topic", "c_part p", ""),
    ("institutions", 2): ("ra.author, rc.country, rc.inst", "r_author ra, r_ci rc", ""),
    ("institutions", 3): ("p.source, cc.country, p.subfield", "c_part p, c_ci cc", ""),
    ("institutions", 4): ("rs.quartile, rs.source, p.subfield, co.country", "r_source rs, c_part p, c_country co", ""),
    ("institutions", 5): ("cc.country, cc.inst, p.subfield, p.topic", "c_ci cc, c_part p", ""),
    ("institutions", 6): ("rc.country, rg.subfield, rc.inst", "r_ci rc, r_segment rg", "rc.inst <> 7"),
    ("institutions", 7): ("rg.subfield, cc.country, cc.inst, p.subfield", "r_segment rg, c_ci cc, c_part p", ""),
    ("institutions", 8): ("rg.subfield, cc.country, cc.inst, p.source", "r_segment rg, c_ci cc, c_part p", ""),
    ("countries", 0): ("m.inst, rg.subfield, cc.country, cc.inst", "r_segment rg, c_ci cc", ""),
    ("countries", 1): ("rc.country, rc.inst, rg.subfield", "r_ci rc, r_segment rg", "rc.country <> 3"),
    ("countries", 2): ("m.inst, rs.source, rg.subfield, co.country", "r_source rs, r_segment rg, c_country co", ""),
    ("sources", 0): ("rg.subfield, cc.country, cc.inst, p.source", "r_segment rg, c_ci cc, c_part p", ""),
    ("sources", 1): ("rc.country, rc.inst, rg.subfield", "r_ci rc, r_segment rg", ""),
    ("sources", 2): ("p.source, cc.country, p.subfield", "c_part p, c_ci cc", ""),
    ("subfields", 0): ("rg.topic, rc.country, rc.inst", "r_segment rg, r_ci rc", ""),
    ("subfields", 1): ("rs.source, rc.country, rc.inst", "r_source rs, r_ci rc", ""),
}


#: of all entities
_ROOTS = {
    "authors": "select distinct author as root, work from r_author", "institutions": "select distinct inst as root, work from r_ci", "countries": "select distinct country as root, work, inst from r_ci",
    "sources": "select distinct source as root, work from r_source", "subfields": "select distinct subfield as root, work from r_segment",
}


def _tree_base(root: str, tid: int, year: int, whole: bool = False) -> tuple[list[str], str]:
    """Level names and the relation base(k1..kn, ref, cit) of one entity, or of all with their ids as ``root``."""
    levels, joins, condition = _TREE_SQL[root, tid]
    keys = [f"k{i + 1}" for i in range(levels.count(",") + 1)]
    select = ", ".join(f"{e.strip()} as {k}" for e, k in zip(levels.split(","), keys))
    joined = " ".join(f"join {j.strip()} on {j.split()[1]}.work = {'ref' if j.strip().startswith('r_') else 'cit'}" for j in joins.split(","))
    works = f"(select distinct work{', inst' if 'm.inst' in levels else ''} from {_ROOT[root][1]})"
    if whole:
        works, select, condition = f"({_ROOTS[root]})", f"m.root, {select}", re.sub(r"<> \d+", "<> m.root", condition)
    base = f"{_GRAPH_SQL}, base as (select distinct {select}, ref, cit from {works} m join links on links.ref = m.work join r_source yr on yr.work = ref {joined} where yr.year >= {year} {'and ' + condition if condition else ''})"
    return keys, base


def _own_links(sql: str) -> str:
    """The graph has a relation "links" too."""
    return sql.replace("  links as (select distinct k1", "  dlinks as (select distinct k1").replace("from links group by", "from dlinks group by")


def tree_sql(root: str, tid: int, year: int = 1998, whole: bool = False) -> str:
    keys, base = _tree_base(root, tid, year, whole)
    return _own_links(rollup_sql(keys, base, extra="root" if whole else ""))


#: trees that are made for all entities at once too: shared counts of works, the root left out, members of a country first, the root's own topics
_FORESTS = [("authors", 4), ("institutions", 6), ("countries", 2), ("subfields", 0)]


def _register_trees():
    for (root, tid) in _TREE_SQL:
        name = f"tree_{root}_{tid}"
        QUERIES[name] = lambda spark, sf_dir, root=root, tid=tid: trees.tree(order_graph(Tables(spark, sf_dir)), root, _ROOT[root][0], tid, 1998)
        ORACLE_SQL[name] = tree_sql(root, tid)
    for root, tid in _FORESTS:
        name = f"forest_{root}_{tid}"
        QUERIES[name] = lambda spark, sf_dir, root=root, tid=tid: trees.forest(order_graph(Tables(spark, sf_dir)), root, tid, 1998)
        ORACLE_SQL[name] = tree_sql(root, tid, whole=True)


_register_trees()


@query(rollup_sql(["k1"], _GEO_BASE.replace("p.p_brand as k3,", "p.p_brand as k3, sn.n_nationkey as nk,"), "true").replace("from base where true", "from base where nk <> 3 and ref in (select ref from base where nk = 3)"))
def tree_other_nations(t):
    """Regions of the other suppliers of orders that a nation's suppliers serve."""
    rows = geo_tuples(t)
    served = rows.filter("k2 = 3").select("ref").distinct()
    return rollup.rollup(rows.filter("k2 <> 3").join(served, "ref", "left_semi").select("k1", "ref", "cit"), ["k1"], lines_extent(t))


# --- links -----------------------------------------------------------------------------------------------------------


@query("select l_partkey as src, l_orderkey as dst from lineitem")
def link_invert(t):
    return links.invert(t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("select distinct l_orderkey as src, cast(s_nationkey as bigint) as dst from lineitem join supplier on s_suppkey = l_suppkey")
def link_collapse(t):
    first = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return links.collapse(first, t.supplier.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst")))


@query("select distinct o_custkey as src, l_suppkey as dst from orders join lineitem on l_orderkey = o_orderkey")
def link_collapse_many(t):
    first = t.orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return links.collapse(first, t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("select cast(s_nationkey as bigint) as src, s_suppkey as dst from supplier")
def link_group_invert(t):
    lists = links.group_invert(t.supplier.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst")))
    return lists.select("src", F.explode("dsts").alias("dst"))


@query("with i as (select p_name as key, row_number() over (order by p_name) as id from (select distinct p_name from part)) select l_orderkey as src, i.id as dst from lineitem join part on p_partkey = l_partkey join i on i.key = p_name")
def link_map(t):
    ids = links.dense_ids(t.part, "p_name").withColumnRenamed("p_name", "key")
    own = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("id"))
    edges = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("src"), F.col("p_name").alias("dst"))
    return links.map_link(edges, own, ids, many=True)


@query("select p_name, row_number() over (order by p_name) as id from (select distinct p_name from part)")
def dense_ids(t):
    return links.dense_ids(t.part, "p_name")


@query("select p_name as key, min(p_partkey) as p_partkey from part group by p_name")
def kv_first_wins(t):
    return links.first_wins(t.part.select(F.col("p_name").alias("key"), "p_partkey"), "key", "p_partkey").select("key", "p_partkey")


@query("""with w as (select l_orderkey as work, l_suppkey as source, min(l_linenumber) as position from lineitem group by all),
  q as (select l_suppkey as source, year(o_orderdate) as year, min(cast(l_quantity as bigint) % 5) as q from lineitem join orders on o_orderkey = l_orderkey group by all),
  k as (select w.work, w.source, row_number() over (partition by w.work order by case when coalesce(q.q, 0) = 0 then 5 else q.q end, position, w.source) as rn
        from w join orders on o_orderkey = w.work left join q on q.source = w.source and q.year = year(o_orderdate))
  select work, source from k where rn = 1""")
def best_link(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("position"), (F.col("l_quantity").cast("long") % 5).alias("q"))
    years = t.orders.select(F.col("o_orderkey").alias("work"), F.year("o_orderdate").alias("year"))
    quartiles = lines.join(years, "work").groupBy("source", "year").agg(F.min("q").alias("q"))
    return links.best_source(lines.groupBy("work", "source").agg(F.min("position").alias("position")), years, quartiles)


# --- filters -----------------------------------------------------------------------------------------------------------

_KEEP = "o_orderstatus <> 'F' and o_orderpriority in ('1-URGENT', '2-HIGH') and year(o_orderdate) > 1995 and year(o_orderdate) <= 2000"


@query(f"select o_orderkey as id from orders where {_KEEP}")
def filter_predicate(t):
    works = t.orders.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("publication_year"), F.col("o_orderpriority").alias("type"), (F.col("o_orderstatus") == "F").alias("is_retracted"))
    from .config import Config

    return filters.keep_works(works, Config(start_year=1995, final_year=2000, work_kinds=("1-URGENT", "2-HIGH"))).select("id")


def order_suppliers(t):
    return t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"))


@query("select l_suppkey as src from lineitem group by l_suppkey having count(distinct l_orderkey) >= 590")
def filter_min_degree(t):
    return filters.degree_filter(links.invert(order_suppliers(t)), least=590)


@query("select l_orderkey as src from lineitem group by l_orderkey having count(distinct l_suppkey) <= 3")
def filter_max_degree(t):
    return filters.degree_filter(order_suppliers(t), most=3)


@query(f"""with w as (select o_orderkey from orders where {_KEEP}),
  s as (select l_suppkey from lineitem where l_orderkey in (select o_orderkey from w) group by l_suppkey having count(distinct l_orderkey) >= 5)
  select l_orderkey as src from lineitem where l_suppkey in (select l_suppkey from s) and l_orderkey in (select o_orderkey from w) group by l_orderkey having count(distinct l_suppkey) <= 4""")
def filter_chain(t):
    works, edges = filter_predicate(t), order_suppliers(t)
    big = filters.degree_filter(links.invert(edges), least=5, targets=works)
    return filters.degree_filter(edges, most=4, sources=works, targets=big)


@query("select distinct l_orderkey as dst from lineitem where l_suppkey in (select l_suppkey from lineitem group by l_suppkey having count(distinct l_orderkey) >= 590)")
def filter_targets(t):
    return filters.linked_targets(links.invert(order_suppliers(t)), filter_min_degree(t))


@query("select s_suppkey as id from supplier where s_suppkey not in (3, 5, 7)")
def filter_drop_list(t):
    return filters.drop_listed(t.supplier.select(F.col("s_suppkey").alias("id")), (3, 5, 7))


@query("""with a as (select o_custkey as id, count(*) as w, cast(sum(o_totalprice) as bigint) as c from orders group by o_custkey)
  select id from a where id in (1, 2, 3) or (w >= 10 and c >= 1000000 and id in (select c_custkey from customer where c_mktsegment = 'BUILDING'))""")
def filter_keep_or(t):
    from .config import Config

    authors = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("works_count"), F.sum("o_totalprice").cast("long").alias("cited_by_count"))
    candidates = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return filters.keep_authors(authors, candidates, Config(min_author_works=10, min_author_citations=1_000_000, fixed_authors=(1, 2, 3)))


@query("select c_custkey as id from customer where c_custkey not in (select o_custkey from orders where year(o_orderdate) >= 2001)")
def filter_complement(t):
    late = t.orders.filter(F.year("o_orderdate") >= 2001)
    return filters.without(t.customer.select(F.col("c_custkey").alias("id")), late.select("o_custkey"), "id")


@query("select user_id, ts from events where year(ts) between (select max(year(ts)) from events) - 1 and (select max(year(ts)) from events) ")
def filter_era(t):
    last = t.events.agg(F.max(F.year("ts"))).first()[0]
    return filters.era(t.events.withColumn("year", F.year("ts")), last, 2).select("user_id", "ts")


# --- statistics ----------------------------------------------------------------------------------------------------------


def customer_orders(t):
    return t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("work"))


def order_parts(t):
    return t.lineitem.select(F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("citing"))


_CUST_C = "cc as (select o_custkey as e, o_orderkey, count(l_partkey) as c from orders left join lineitem on l_orderkey = o_orderkey group by all)"


@query("select o_custkey as entity, count(*) as citations from orders join lineitem on l_orderkey = o_orderkey group by o_custkey")
def cite_count(t):
    return stats.cite_counts(customer_orders(t), stats.citing_counts(order_parts(t)))


@query("select o_custkey as entity, count(*) as papers from orders group by o_custkey")
def work_count(t):
    return stats.work_counts(customer_orders(t))


@query("select l_partkey as work, count(*) as citations from lineitem group by l_partkey having count(*) >= 40")
def hit_items(t):
    return filters.hits(stats.citing_counts(t.lineitem.select(F.col("l_partkey").alias("work"))), 40)


@query("select o_custkey as entity, o_orderpriority as class, count(*) as n from orders group by all")
def histogram_ref(t):
    return stats.histogram(customer_orders(t), t.orders.select(F.col("o_orderkey").alias("work"), F.col("o_orderpriority").alias("class")))


@query("select o_custkey as entity, p_brand as class, count(*) as n from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by all")
def histogram_cit(t):
    return stats.citing_histogram(customer_orders(t), order_parts(t), t.part.select(F.col("p_partkey").alias("work"), F.col("p_brand").alias("class")))


@query("""select o_custkey as entity, y as year, cast(count(case when year(o_orderdate) = y then 1 end) as bigint) as n
  from orders, (select unnest(range(1997, 2002)) as y) group by all""")
def yearly_counts(t):
    series = stats.yearly(t.orders.select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year")), 2001, 5)
    return series.select("entity", F.posexplode("series").alias("i", "n")).select("entity", (F.col("i") + 1997).cast("long").alias("year"), "n")


_H = """select e as entity, cast(coalesce(min(case when i > c then i end), max(n)) as bigint) as h,
  cast(max(case when i = n - 1 - cast(floor(n / 2) as bigint) then c end) as bigint) as upper_median
  from (select e, c, row_number() over (partition by e order by c desc) - 1 as i, count(*) over (partition by e) as n from cc) group by e"""


def customer_counts(t):
    counts = stats.citing_counts(order_parts(t))
    return customer_orders(t).join(counts, "work", "left").select("entity", F.coalesce("citations", F.lit(0)).alias("c"))


@query(f"with {_CUST_C}, h as ({_H}) select entity, h from h")
def h_index(t):
    return stats.h_and_median(customer_counts(t), ["entity"]).select("entity", "h")


@query(f"with {_CUST_C}, h as ({_H}) select entity, upper_median from h")
def upper_median(t):
    return stats.h_and_median(customer_counts(t), ["entity"]).select("entity", "upper_median")


@query(f"""with {_CUST_C}, h as (select e as entity, count(*) filter (where c >= r) as h from (select e, c, row_number() over (partition by e order by c desc) as r from cc) group by e) select * from h""")
def h_index_standard(t):
    return stats.h_and_median(customer_counts(t), ["entity"], standard=True).select("entity", "h")


def _sources(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("source"), (F.col("l_quantity").cast("long") % 5).alias("q"))
    years = t.orders.select(F.col("o_orderkey").alias("work"), F.year("o_orderdate").alias("year"))
    return lines.select("work", "source").distinct(), stats.citing_counts(order_parts(t)), years, lines.join(years, "work").groupBy("source", "year").agg(F.max("q").alias("q"))


_SRC = """w as (select distinct l_orderkey as work, l_suppkey as source from lineitem),
  n as (select l_orderkey as work, count(*) as c from lineitem group by all),
  q as (select l_suppkey as source, year(o_orderdate) as year, max(cast(l_quantity as bigint) % 5) as q from lineitem join orders on o_orderkey = l_orderkey group by all),
  j as (select w.source as e, w.work, n.c, q.q from w join n on n.work = w.work join orders on o_orderkey = w.work left join q on q.source = w.source and q.year = year(o_orderdate)),
  cc as (select e, c from j)"""


@query(f"""with {_SRC}, h as ({_H}), b as (select e, coalesce(min(nullif(q, 0)), 5) as best_q from j group by e)
  select entity as source, h, upper_median, best_q, cast((5 - best_q) * h * 2 + upper_median * 3 as bigint) as value from h join b on b.e = h.entity""")
def source_stats(t):
    return stats.source_stats(*_sources(t)).withColumn("best_q", F.col("best_q").cast("long"))


@query(f"with {_SRC} select q, cast(sum(c) as bigint) as citations from (select distinct coalesce(q, 0) as q, work, c from j) group by q")
def quartile_citations(t):
    return stats.quartile_citations(*_sources(t))


_REL = """r as (select o_custkey as entity, l_suppkey as inst, count(*) as papers, cast(sum(c) as bigint) as citations, min(y) as first_year, max(y) as last_year
  from (select distinct o_custkey, o_orderkey, l_suppkey, year(o_orderdate) as y from orders join lineitem on l_orderkey = o_orderkey)
  join (select l_orderkey, count(*) as c from lineitem group by all) k on k.l_orderkey = o_orderkey group by all)"""


@query(f"with {_REL}, k as (select *, row_number() over (partition by entity order by papers desc, last_year - first_year desc, inst) as rank from r) select * from k where rank <= 8")
def rel_top8(t):
    pairs = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("work"), F.col("l_suppkey").alias("inst"), F.year("o_orderdate").cast("long").alias("year")).distinct()
    return stats.institution_relations(pairs.join(stats.citing_counts(order_parts(t)), "work"), 8).withColumn("rank", F.col("rank").cast("long"))


_PAIR_N = "p as (select o_custkey as entity, l_suppkey as related, count(*) as score from orders join lineitem on l_orderkey = o_orderkey group by all)"


def customer_suppliers(t):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("entity"), F.col("l_suppkey").alias("related")).agg(F.count("*").alias("score"))


@query(f"with {_PAIR_N}, k as (select *, row_number() over (partition by entity order by score desc, related) as rank from p) select * from k where rank <= 3")
def top3_by_count(t):
    return stats.top_related(customer_suppliers(t), 3).withColumn("rank", F.col("rank").cast("long"))


@query("""with p as (select cast(c_nationkey as bigint) as entity, cast(s_nationkey as bigint) as related, count(*) as score from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey group by all),
  k as (select *, row_number() over (partition by entity order by score desc, related) as rank from p where related <> entity) select * from k where rank <= 3""")
def top3_other_nations(t):
    """Of its own kind the entity itself is left out."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    counts = rows.groupBy(F.col("c_nationkey").cast("long").alias("entity"), F.col("s_nationkey").cast("long").alias("related")).agg(F.count("*").alias("score"))
    return stats.top_related(counts, 3, same_kind=True)


@query("""with cites as (select l_partkey as work, count(*) as c from lineitem group by 1), j as (select distinct coalesce(nullif(p_size % 5, 4), 0) as q, p_partkey as work from part)
  select cast(q as bigint) as q, cast(sum(c) as bigint) as citations from j join cites using (work) group by q""")
def quartile_citations_parts(t):
    """Parts as works of sources by size, a source's quartile by its number; sources of no quartile count as 0."""
    works = t.part.select(F.col("p_partkey").alias("work"), F.col("p_size").cast("long").alias("source"), F.lit(2000).alias("year"))
    known = works.select("source", "year", (F.col("source") % 5).alias("q")).distinct().filter("q <> 4")
    cited = stats.citing_counts(t.lineitem.select(F.col("l_partkey").alias("work")))
    return stats.quartile_citations(works.select("work", "source"), cited, works.select("work", "year"), known)


@query(f"with {_PAIR_N}, v as (select s_suppkey as related, cast(floor(s_acctbal) as bigint) as value from supplier), k as (select p.*, v.value, row_number() over (partition by entity order by value desc, score desc, p.related) as rank from p join v on v.related = p.related) select entity, related, score, value, rank from k where rank <= 3")
def top3_by_value(t):
    values = t.supplier.select(F.col("s_suppkey").alias("related"), F.floor("s_acctbal").cast("long").alias("value"))
    return stats.top_by_value(customer_suppliers(t), values, 3).select("entity", "related", "score", "value", F.col("rank").cast("long"))


@query("""with cc as (select s_nationkey as nat, o_custkey as cust, count(*) as c from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey group by s_nationkey, o_custkey, o_orderkey),
  h as (select nat, cust, cast(coalesce(min(case when i > c then i end), max(n)) as bigint) as h from (select *, row_number() over (partition by nat, cust order by c desc) - 1 as i, count(*) over (partition by nat, cust) as n from cc) group by all),
  k as (select *, row_number() over (partition by nat order by h desc, cust) as rank from h) select cast(nat as bigint) as entity, cust as related, h as score, rank from k where rank <= 5""")
def top5_by_h(t):
    rows = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    counts = rows.groupBy(F.col("s_nationkey").cast("long").alias("entity"), F.col("o_custkey").alias("related"), "o_orderkey").agg(F.count("*").alias("c"))
    return stats.top_by_h(counts, 5).withColumn("rank", F.col("rank").cast("long"))


@query("""with s as (select distinct o_custkey as g, p_brand as item from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey)
  select x.item as a, y.item as b, count(*) as n from s x join s y on x.g = y.g and x.item < y.item group by all""")
def cooccurrence_pairs(t):
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return stats.cooccurrence(rows.select(F.col("o_custkey").alias("group"), F.col("p_brand").alias("item")))


@query("select p_brand as key, round((c * 0.55e0 + (sum(c) over () / count(*) over ()) * 0.45e0) / sum(c) over (), 10) as baseline from (select p_brand, count(*) as c from lineitem join part on l_partkey = p_partkey group by p_brand)")
def baseline_share(t):
    return brand_baseline(t).select("key", F.round("baseline", 10).alias("baseline"))


@query(f"with {_BRAND_BASE}, c as (select cast(s_nationkey as bigint) as nation, p_brand as brand, count(distinct (l_orderkey, l_partkey)) as n from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey group by all) select nation, brand, round(n / cast(sum(n) over (partition by nation) as double) / baseline, 9) as spec from c join base_b on key = brand")
def specialization(t):
    counts = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    counts = counts.select(F.col("s_nationkey").cast("long").alias("nation"), F.col("p_brand").alias("brand"), "l_orderkey", "l_partkey").distinct().groupBy("nation", "brand").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("nation")).alias("total")
    rows = counts.select("*", total).join(brand_baseline(t), F.col("key") == F.col("brand"))
    return rows.select("nation", "brand", F.round(F.col("n") / F.col("total") / F.col("baseline"), 9).alias("spec"))


# --- features, ranks, relations --------------------------------------------------------------------------------------------


def customers(t):
    papers = stats.work_counts(customer_orders(t))
    return papers.join(cite_count(t), "entity").select(F.col("entity").alias("id"), "papers", "citations")


_CUST = "cu as (select o_custkey as id, count(distinct o_orderkey) as papers, count(*) as links from orders left join lineitem on l_orderkey = o_orderkey group by all), cs as (select o_custkey as id, count(*) as citations from orders join lineitem on l_orderkey = o_orderkey group by all), c as (select cu.id, papers, citations from cu join cs on cs.id = cu.id)"
_Z = f"{_CUST}, f as (select id, ln(greatest(citations, 1)) as a, citations / cast(greatest(papers, 3) as double) as b from c), z as (select id, (a - avg(a) over ()) / stddev_pop(a) over () as f1, (b - avg(b) over ()) / stddev_pop(b) over () as f2 from f)"


@query(f"with {_CUST} select id, papers, citations from c where id in (1, 2, 3) or citations > 60")
def highlighted(t):
    return filters.highlighted(customers(t), (1, 2, 3), 60).select("id", "papers", "citations")


@query(f"with {_Z} select id, round(f1, 7) as f1, round(f2, 7) as f2 from z")
def features_zscore(t):
    return similar.standardized(customers(t)).select("id", F.round("f1", 7).alias("f1"), F.round("f2", 7).alias("f2"))


@query(f"with {_Z} select z.id, round(sqrt((z.f1 - q.f1) * (z.f1 - q.f1) + (z.f2 - q.f2) * (z.f2 - q.f2)), 7) as distance from z, (select * from z where id = 11) q where z.id <> 11 order by 2, 1 limit 8")
def knn(t):
    near = similar.nearest(similar.standardized(customers(t)).select("id", F.round("f1", 9).alias("f1"), F.round("f2", 9).alias("f2")), 11, 8)
    return near.select("id", F.round("distance", 7).alias("distance"))


def customer_plane(t: Tables) -> DataFrame:
    """Features to nine digits, so that both engines compare the same numbers."""
    return written(similar.standardized(customers(t)).select("id", F.round("f1", 9).alias("f1"), F.round("f2", 9).alias("f2")), "plane")


_PLANE = f"""{_Z}, pl as (select id, round(f1, 9) as f1, round(f2, 9) as f2 from z),
  d as (select a.id, b.id as other, (b.f1 - a.f1) * (b.f1 - a.f1) + (b.f2 - a.f2) * (b.f2 - a.f2) as d from pl a, pl b),
  k as (select *, row_number() over (partition by id order by d, other) as place from d qualify place <= least((select count(*) from pl) // 20, 500))"""


@query(f"with {_PLANE} select id, count(*) as n_pool, sha256(string_agg(cast(other as varchar), ',' order by place)) as pool_sha256, round(sqrt(max(d)), 9) as farthest from k group by id")
def knn_pools(t):
    plane = customer_plane(t)
    pooled = similar.with_pools(plane, similar.neighbour_pools(plane, similar.neighbourhood_size(plane.count())))
    ids = F.array_join(F.transform("near", lambda x: x["id"].cast("string")), ",")
    return pooled.select("id", F.size("near").cast("long").alias("n_pool"), F.sha2(ids, 256).alias("pool_sha256"), F.round(F.sqrt(F.element_at("near", -1)["square"]), 9).alias("farthest"))


@query(f"with {_PLANE}, s as (select id, other, row_number() over (partition by id order by md5('7:' || id || ':' || other)) as draw from k qualify draw <= 8) select id, other as related from s where other <> id")
def similar_entities(t):
    plane = customer_plane(t)
    found = similar.similar_entities(plane, similar.neighbourhood_size(plane.count()), 8, seed=7)
    return found.select("id", F.explode("similar").alias("related"))


@query(f"with {_CUST}, r as (select *, row_number() over (order by citations desc, id) - 1 as rank from c) select * from r where rank >= 20 and rank < 70")
def rank_slice(t):
    ranks = ranking.ranked(customers(t)).select("id", "papers", "citations", "rank")
    return ranking.page(ranks, 20, 70)


@query("select l_orderkey * 16 + l_linenumber as id, l_suppkey as supplier, l_returnflag as flag, row_number() over (order by l_extendedprice desc, l_orderkey * 16 + l_linenumber) - 1 as rank from lineitem")
def rank_lines(t):
    rows = t.lineitem.select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return ranking.ranked(rows, "l_extendedprice").drop("l_extendedprice")


@query("select link, row_number() over (order by link) as id from (select distinct l_orderkey || '-' || l_partkey as link from lineitem)")
def dense_ids_links(t):
    return links.dense_ids(t.lineitem.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("link")), "link")


@query("select 'customers' as entity, count(*) as n from customer union all select 'suppliers', count(*) from supplier union all select 'parts', count(*) from part")
def entity_counts(t):
    return ranking.entity_counts(customers=t.customer, suppliers=t.supplier, parts=t.part)


@query(f"""with {_PAIR_N}, a as (select *, row_number() over (partition by entity order by score desc, related) as rank from p),
  n as (select o_custkey as entity, cast(s_nationkey as bigint) as related, count(*) as score from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey group by all),
  b as (select *, row_number() over (partition by entity order by score desc, related) as rank from n)
  select entity, 0 as rel_type, related, score, rank from a where rank <= 3 union all select entity, 1, related, score, rank from b where rank <= 3""")
def prime_relations(t):
    nations = customer_suppliers(t).join(t.supplier, F.col("s_suppkey") == F.col("related")).groupBy("entity", F.col("s_nationkey").cast("long").alias("nation")).agg(F.sum("score").alias("score"))
    second = stats.top_related(nations.select("entity", F.col("nation").alias("related"), "score"), 3)
    return stats.prime_relations(stats.top_related(customer_suppliers(t), 3), second).withColumn("rank", F.col("rank").cast("long"))


@query("select distinct p_size as size from part order by p_size limit 16")
def smallest_distinct(t):
    return ranking.smallest_distinct(t.part.select(F.col("p_size").alias("size")), "size")


@query("select coalesce(c.k, o.k) as id, case when c.k is null then 'right' when o.k is null then 'left' else 'both' end as side from (select c_custkey as k from customer where c_acctbal > 0) c full join (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT') o on c.k = o.k")
def merge_sides(t):
    """All customers in credit against all with an urgent order."""
    return ranking.merge_sides(t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id")), t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")))


@query("select o_custkey as id from orders where year(o_orderdate) = 1995 union select o_custkey from orders where year(o_orderdate) = 1999")
def union_ids(t):
    buyers = lambda year: t.orders.filter(F.year("o_orderdate") == year).select(F.col("o_custkey").alias("id"))
    return ranking.union_ids(buyers(1995), buyers(1999))


@query("select o_custkey as id from orders where year(o_orderdate) = 1995 except select o_custkey from orders where year(o_orderdate) = 1999")
def difference_ids(t):
    buyers = lambda year: t.orders.filter(F.year("o_orderdate") == year).select(F.col("o_custkey").alias("id"))
    return ranking.difference_ids(buyers(1995), buyers(1999))


@query("select coalesce(o.k, l.k) as id, case when o.k is null then 'right' when l.k is null then 'left' else 'both' end as side from (select distinct cast(o_orderdate as date) as k from orders) o full join (select distinct cast(l_shipdate as date) as k from lineitem) l on o.k = l.k")
def merge_sides_whole(t):
    """Days of orders against days of shipping, over whole tables: all three sides occur at every scale."""
    return ranking.merge_sides(t.orders.select(F.to_date("o_orderdate").alias("id")), t.lineitem.select(F.to_date("l_shipdate").alias("id")))


@query("with a as (select distinct l_orderkey as id from lineitem where l_suppkey = 1), b as (select distinct l_orderkey as id from lineitem where l_suppkey = 2) select id, cast(min(s) as int) as source from (select id, 0 as s from a union all select id, 1 from b) group by id")
def append_missing(t):
    served = lambda k: t.lineitem.filter(F.col("l_suppkey") == k).select(F.col("l_orderkey").alias("id"))
    return ranking.append_missing(served(1), served(2))


@query("select l_orderkey as id from lineitem where l_suppkey = 1 intersect select l_orderkey from lineitem where l_suppkey in (2, 3, 4, 5)")
def intersect_ids(t):
    served = lambda *k: t.lineitem.filter(F.col("l_suppkey").isin(*k)).select(F.col("l_orderkey").alias("id"))
    return ranking.intersect_ids(served(1), served(2, 3, 4, 5))


@query("select cast(depth as int) as depth, k1, label from (select 0 as depth, cast(null as bigint) as k1, cast(null as varchar) as label union all select distinct 1, cast(n_nationkey as bigint), n_name from supplier join nation on n_nationkey = s_nationkey join lineitem on l_suppkey = s_suppkey)")
def tree_labels(t):
    nodes = rollup.rollup(geo_tuples(t).select(F.col("k2").alias("k1"), "ref", "cit"), ["k1"], lines_extent(t))
    names = t.nation.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    return labels.attach(nodes, ["k1"], {0: names}).select("depth", "k1", "label")


@query("select c_custkey as id, cast(c_nationkey as bigint) as nation, n_name as nation_key from customer left join nation on n_nationkey = c_nationkey and n_regionkey > 0")
def external_ids(t):
    ids = t.nation.filter("n_regionkey > 0").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("key"))
    return labels.external_ids(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("nation")), ids, "nation")


# --- links of records ------------------------------------------------------------------------------------------------


@query("select src, s_suppkey as dst from (select l_orderkey as src, max(l_linenumber * 1000000000::bigint + l_suppkey) % 1000000000 as k from lineitem group by 1) left join supplier on s_suppkey = k and s_acctbal > 2000")
def link_single(t):
    """The last supplier listed for an order; suppliers of little credit are unknown."""
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("place"))
    orders = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("id"))
    return links.map_link(edges, orders, t.supplier.filter("s_acctbal > 2000").select(F.col("s_suppkey").alias("key"), F.col("s_suppkey").alias("id")), order="place")


@query("select p_partkey as src, unnest(string_split(p_name, ' ')) as dst from part")
def authorship_institutions(t):
    ships = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("work"), F.col("p_brand").alias("author"), F.replace("p_name", F.lit(" "), F.lit(";")).alias("institutions"))
    return links.authorship_links(ships)[1]


@query("select cast(s_nationkey as bigint) as source, cast(year(l_shipdate) as bigint) as year, cast(min(l_linenumber) as bigint) as q from lineitem join supplier on s_suppkey = l_suppkey group by all")
def source_quartiles(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("id"), F.year("l_shipdate").alias("publication_year"), F.col("l_linenumber").alias("best_q"))
    ids = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("id"))
    return links.source_quartiles(rows, ids).select(*i64("source", "year", "q"))


_ISSN = "pairs as (select distinct id, issn from (select p_partkey as id, unnest(string_split(p_name, ' ')) as issn from part union all select p_partkey, p_brand from part))"


def issn_rows(t):
    return links.issn_pairs(t.part.select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("issn"), F.col("p_brand").alias("issn_l")))


@query(f"with {_ISSN} select * from pairs")
def issn_pairs(t):
    return issn_rows(t)


@query(f"with {_ISSN} select distinct id, area from pairs join (select p_brand as issn, p_type as area from part) using (issn)")
def issn_areas(t):
    return links.issn_join(issn_rows(t), t.part.select(F.col("p_brand").alias("issn"), F.col("p_type").alias("area")))


_HOMES = """base as (select distinct cast(n_regionkey as bigint) as k1, cast(n_nationkey as bigint) as k2, l_orderkey as ref, l_partkey as cit
  from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey)"""


@query(rollup_sql(["k1", "k2"], _HOMES, select="select * from tree where depth = 1"))
def tree_sum_of_children(t):
    """An order has one customer, so regions are the sums of their nations."""
    homes = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    tuples = homes.select(F.col("n_regionkey").cast("long").alias("k1"), F.col("n_nationkey").cast("long").alias("k2"), F.col("o_orderkey").alias("ref"), F.col("l_partkey").alias("cit"))
    return rollup.sum_of_children(rollup.rollup(tuples, ["k1", "k2"], lines_extent(t)), ["k1", "k2"], 1)


@query(f"with {_CUST} select c.id, papers, citations from c join customer on c_custkey = c.id where papers >= 2 and citations >= 3 and papers < 12")
def searchable(t):
    rows = customers(t).join(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id").withColumn("slug", F.lower("name"))
    return filters.searchable(rows, most_papers=12).select("id", "papers", "citations")


@query("select o_custkey as entity, min(case when year(o_orderdate) between 1997 and 2001 then cast(year(o_orderdate) as int) end) as first_year from orders group by 1")
def first_active_year(t):
    series = stats.yearly(t.orders.select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year")), 2001, 5)
    return series.select("entity", C.first_active_year(F.col("series"), 1997).alias("first_year"))


_TOP8 = "k as (select *, row_number() over (partition by entity order by papers desc, last_year - first_year desc, inst) as rank from r) select * from k where rank <= 8"
_R_OF = "r as (select entity, inst, count(*) as papers, cast(sum(c) as bigint) as citations, min(y) as first_year, max(y) as last_year from e join (select l_orderkey, count(*) as c from lineitem group by all) k on k.l_orderkey = work group by all)"


def top_institutions(t, rows):
    years = t.orders.select(F.col("o_orderkey").alias("work"), F.year("o_orderdate").cast("long").alias("year"))
    return stats.institution_relations(rows.join(years, "work").join(stats.citing_counts(order_parts(t)), "work")).withColumn("rank", F.col("rank").cast("long"))


@query(f"with e as (select distinct cast(s_nationkey as bigint) as entity, o_orderkey as work, l_suppkey as inst, year(o_orderdate) as y from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey), {_R_OF}, {_TOP8}")
def country_relations(t):
    """A nation's orders with the suppliers of that nation alone."""
    home = t.supplier.select(F.col("s_suppkey").alias("inst"), F.col("s_nationkey").cast("long").alias("country"))
    works = t.lineitem.select(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("inst")).distinct()
    return top_institutions(t, stats.country_institutions(works.join(home, "inst").select(F.col("country").alias("entity"), "work").distinct(), works, home))


@query(f"with e as (select o_custkey as entity, o_orderkey as work, l_suppkey as inst, year(o_orderdate) as y from lineitem join orders on o_orderkey = l_orderkey where l_linenumber = 1), {_R_OF}, {_TOP8}")
def author_relations(t):
    """A customer's orders with the suppliers of the first line alone, as if only those were the customer's own; repeats count."""
    own = t.lineitem.filter("l_linenumber = 1").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("work"), F.col("o_custkey").alias("author"), F.col("l_suppkey").alias("inst"))
    return top_institutions(t, stats.author_institutions(customer_orders(t), own))


# --- names, slugs, search ----------------------------------------------------------------------------------------------------

_SLUG = "array_to_string([x for x in string_split(regexp_replace(lower({0}), '[^a-z ]', '', 'g'), ' ') if x <> ''], '-')"


@query(f"select p_partkey as id, {_SLUG.format('p_name')} as slug from part")
def slugify(t):
    return t.part.select(F.col("p_partkey").alias("id"), C.slug(F.col("p_name")).alias("slug"))


@query(f"""with s as (select p_partkey as id, {_SLUG.format("p_name")} as slug, p_size as works from part),
  k as (select *, row_number() over (partition by slug order by works desc, id desc) as k from s)
  select id, case when k = 1 then slug when k <= 24 then slug || '-' || substring('23456789abcdefghijklmno', k - 1, 1) else '' end as slug from k""")
def slug_unique(t):
    return slugs.unique_slugs(t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("works"), C.slug(F.col("p_name")).alias("slug")))


@query(f"""with recursive o as (select row_number() over (order by p_size desc, p_partkey desc) as k, p_partkey as id,
    [string_split(p_name, ' ')[1], {_SLUG.format("p_name")}, lower(p_brand), 'part-' || p_partkey] as c from part),
  g as (select cast(0 as bigint) as k, cast(0 as bigint) as id, '' as slug, cast([] as varchar[]) as taken
        union all select k, id, slug, list_append(taken, slug) from (select o.k, o.id, g.taken, [x for x in o.c if not list_contains(g.taken, x)][1] as slug from g join o on o.k = g.k + 1))
  select id, slug from g where k > 0""")
def slug_greedy(t):
    """The last candidate is free for everyone here; tests cover the suffixes."""
    candidates = F.array(F.split("p_name", " ")[0], C.slug(F.col("p_name")), F.lower("p_brand"), F.concat(F.lit("part-"), F.col("p_partkey")))
    return slugs.assign_slugs(t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("works"), candidates.alias("candidates")))


_SUFFIXED = "list_transform(range(1, 24), lambda i: c[len(c)] || '-' || substring('23456789abcdefghijklmno', i, 1))"


@query(f"""with recursive p as (select p_size, p_partkey as id, [string_split(p_name, ' ')[1], {_SLUG.format("p_name")}] as c from part),
  o as (select c[1] as w, row_number() over (partition by c[1] order by p_size desc, id desc) as k, id, list_concat(c, {_SUFFIXED}) as forms from p),
  g as (select distinct w, cast(0 as bigint) as k, cast(0 as bigint) as id, '' as slug, cast([] as varchar[]) as taken from o
        union all select w, k, id, coalesce(slug, ''), list_append(taken, slug) from (select o.w, o.k, o.id, g.taken, list_filter(o.forms, lambda x: not list_contains(g.taken, x))[1] as slug from g join o on o.w = g.w and o.k = g.k + 1))
  select id, slug from g where k > 0""")
def slug_suffixes(t):
    """More rows than forms: suffixes and empty slugs occur. In the SQL a first word's rows are a sequence of their own, as they share no form with others."""
    candidates = F.array(F.split("p_name", " ")[0], C.slug(F.col("p_name")))
    return slugs.assign_slugs(t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("works"), candidates.alias("candidates")))


@query(f"""with p as (select p_partkey as id, p_name, [p_type, p_brand, string_split(p_name, ' ')[1]] as short from part),
  c as (select id, row_number() over (partition by id order by strlen(short[i]), i) - 1 as place, short[i] as name from p, range(1, 4) r(i) union all select id, 3, p_name from p)
  select id, cast(place as int) as place, {_SLUG.format("name")} as slug from c""")
def slug_candidates(t):
    """Alternate titles and abbreviation, shortest first, then the name."""
    found = slugs.source_candidates(F.col("p_name"), F.array("p_type", "p_brand"), F.split("p_name", " ")[0])
    return t.part.select(F.col("p_partkey").alias("id"), F.posexplode(found).alias("place", "slug"))


_NAMED = "n as (select p_partkey as id, p_name as name, p_brand as country, p_type as city from part)"


@query(f"with {_NAMED}, f as (select *, case when count(*) over (partition by name) > 1 then name || ' (' || country || ')' else name end as f from n) select id, case when count(*) over (partition by f) > 1 then name || ' (' || city || ')' else f end as name from f")
def name_disambiguate(t):
    return slugs.distinct_names(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("country"), F.col("p_type").alias("city")))


_TWICE = "p_name || '/' || case when p_size % 2 = 0 then p_name else p_type end"


@query(f"""with n as (select p_partkey as id, {_TWICE} as name from part), s as (select *, string_split(name, '/') as p from n)
  select id, case when len(p) = 2 and least(strlen(p[1]), strlen(p[2])) >= 10 and 1e0 - levenshtein(p[1], p[2]) / cast(least(strlen(p[1]), strlen(p[2])) as double) >= 0.8e0 then p[1] else name end as name from s""")
def name_dedupe(t):
    return t.part.select(F.col("p_partkey").alias("id"), C.journal_name(F.expr(_TWICE)).alias("name"))


def part_index(t):
    ranks = ranking.ranked(t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("citations"), F.col("p_name").alias("name")))
    return search.build_index(ranks.select("rank", "name"))


_RANKED = "n as (select row_number() over (order by p_size desc, p_partkey) - 1 as rank, [x for x in string_split(regexp_replace(lower(p_name), '[^a-z ]', '', 'g'), ' ') if x <> ''] as words from part), w as (select distinct rank, unnest(words) as token from n), i as (select distinct rank, token[k:] as token from w, range(2, 40) r(k) where k < length(token))"


def _search_sql(prefix: str) -> str:
    return f"""with {_RANKED}, p as (select rank, case when token = '{prefix}' then 0 else 1 end as partial from w where starts_with(token, '{prefix}')),
  pd as (select rank, min(partial) as partial from p group by rank), e as (select count(*) as n from pd),
  q as (select rank, partial from pd union all select rank, 1 from i, e where e.n < 16 and left(token, 2) = left('{prefix}', 2) and (starts_with(token, '{prefix}') or starts_with('{prefix}', token)))
  select rank, cast(min(partial) as int) as partial from q group by rank order by 2, 1 limit 16"""


@query(_search_sql("gea"))
def search_prefix(t):
    return search.search(part_index(t), "gea")


@query(_search_sql("lue"))
def search_infix(t):
    return search.search(part_index(t), "lue")


@query(f"""with {_RANKED}, a as (select rank from w where starts_with(token, 're') union select rank from i where left(token, 2) = 're'),
  b as (select rank, case when token = 'bo' then 0 else 1 end as partial from w where length(token) >= 2 and (starts_with(token, 'bo') or starts_with('bo', token))
        union all select rank, 1 from i where left(token, 2) = 'bo')
  select rank, cast(min(partial) as int) as partial from b where rank in (select rank from a) group by rank order by 2, 1 limit 16""")
def search_multi(t):
    return search.search(part_index(t), "Re bo")


@query("select unnest(range(0, 16)) as rank, 0 as partial")
def search_empty(t):
    return search.search(part_index(t), "")


_URL = "regexp_replace(url, '[^a-z]+', ' ', 'g')"
#: Queries made of the words of the addresses: a word, its beginning, its inside, one letter, two and three words, and one of letters and words.
_ASKED = ["split(n, ' ')[1]", "substring(split(n, ' ')[1], 1, 3)", "substring(split(n, ' ')[1], 3, 4)", "substring(split(n, ' ')[1], 2, 1)", "concat(split(n, ' ')[1], ' ', substring(split(n, ' ')[3], 1, 2))", "concat('ex ', substring(split(n, ' ')[1], 2, 5), ' ht')", "concat(substring(split(n, ' ')[1], 1, 1), ' ', split(n, ' ')[2], ' c')"]
_ASKED_SQL = " union ".join("select " + re.sub(r"split\(n, ' '\)\[(\d)\]", lambda m: f"string_split(n, ' ')[{int(m[1]) + 1}]", a) + " as q from u" for a in _ASKED)


@query(f"""with u as (select {_URL} as n, row_number() over (order by page_id) - 1 as rank from pages),
  names as (select rank, [x for x in string_split(n, ' ') if x <> ''] as words from u),
  w as (select distinct rank, unnest(words) as token from names), e as (select distinct rank, token[k:] as token from w, range(2, 60) r(k) where k < length(token)),
  asked as (select q, [x for x in string_split(q, ' ') if x <> ''] as ws from ({_ASKED_SQL})),
  qw as (select q, least(len(ws), 3) as n, i, ws[i] as word from asked, range(1, 4) r(i) where i <= len(ws)),
  found as (select word, rank, min(partial) as partial, min(more) as more, min(case when narrow then partial end) as narrowed from (
      select word, rank, case when token = word then 0 else 1 end as partial, 0 as more, true as narrow from (select distinct word from qw where length(word) > 1) join w on starts_with(token, word)
      union all select word, rank, 1, 2, true from (select distinct word from qw where length(word) > 1) join w on length(token) > 1 and starts_with(word, token)
      union all select word, rank, 1, 1, true from (select distinct word from qw where length(word) > 1) join e on left(token, 2) = left(word, 2) and (starts_with(token, word) or starts_with(word, token))
      union all select word, rank, 0, 0, true from (select word, rank from (select distinct word, rank from qw join w on starts_with(token, word) where length(word) = 1) qualify row_number() over (partition by word order by rank) <= 16)
      union all select word, rank, 1, 1, true from (select word, rank from (select distinct word, rank from qw join e on starts_with(token, word) where length(word) = 1) qualify row_number() over (partition by word order by rank) <= 16)) group by word, rank),
  single as (select q, rank, partial, more, count(*) filter (where more = 0) over (partition by q) as begun from qw join found using (word) where n = 1 and more < 2),
  several as (select a.q, a.rank, coalesce(c.narrowed, b.narrowed) as partial from (select q, n, rank from qw join found using (word) where i = 1 and n > 1 and more < 2) a
      join (select q, rank, narrowed from qw join found using (word) where i = 2) b on b.q = a.q and b.rank = a.rank
      left join (select q, rank, narrowed from qw join found using (word) where i = 3) c on c.q = a.q and c.rank = a.rank where a.n = 2 or c.rank is not null),
  every as (select q, rank, partial from single where more = 0 or begun < 16 union all select q, rank, partial from several
      union all select q, rank, 0 from asked, (select rank from names where len(words) > 0 order by rank limit 16) where len(ws) = 0)
  select q as query, cast(row_number() over (partition by q order by partial, rank) as int) as place, rank, cast(partial as int) as partial from every qualify row_number() over (partition by q order by partial, rank) <= 16""")
def search_many(t):
    folder = new_folder(t.spark, "index")
    search.store_index(ranking.numbered(t.pages.select("page_id", F.regexp_replace("url", "[^a-z]+", " ").alias("name")), [F.col("page_id")], "rank"), folder)
    words = t.pages.select(F.regexp_replace("url", "[^a-z]+", " ").alias("n"))
    asked = words.select(F.explode(F.array(*[F.expr(a) for a in _ASKED])).alias("query"))
    return search.search_many(t.spark, folder, asked.select("query", F.col("query").alias("text")))


# --- serving -------------------------------------------------------------------------------------------------------------------


def customer_service(t: Tables) -> api.Service:
    """Customers as authors with names and slugs; brands have names and baselines, other keys of trees have neither."""
    named = customers(t).join(t.customer.select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("segment")), "id")
    named = named.select("id", F.concat_ws(" ", "segment", "id").alias("name"), F.lit("").alias("extension"), F.concat(F.lit("customer-"), "id").alias("slug"), "papers", "citations")
    graph = order_graph(t)
    names = t.part.select(F.col("p_brand").alias("key"), F.concat(F.lit("the "), F.lower("p_brand")).alias("name")).distinct()
    graph = replace(graph, baselines={"subfield": brand_baseline(t)}, labels={"subfield": names})
    return api.Service({"authors": ranking.ranked(named)}, graph)


@query(f"with {_CUST}, n as (select c.*, row_number() over (order by citations desc, id) - 1 as rank from c) select 'customer-' || n.id as slug, n.papers, n.citations, rank, n.id from n join customer on c_custkey = n.id where rank >= 100 and rank < 400")
def service_slice(t):
    return customer_service(t).slice("authors", 100, 400).select("slug", "papers", "citations", "rank", "id")


@query(f"with {_CUST}, n as (select c.*, lower(c_mktsegment) as name, row_number() over (order by citations desc, id) - 1 as rank from c join customer on c_custkey = c.id) select 'customer-' || id as slug, rank from n where name like 'buil%' order by rank limit 16")
def service_names(t):
    return customer_service(t).names("authors", "Buil-").select("slug", "rank")


_SERVED_KEYS, _SERVED_BASE = _tree_base("authors", 4, 1998)


@query(_own_links(prune_sql(f"{_BRAND_BASE}, {_SERVED_BASE}", _SERVED_KEYS, [0, 1, 1], {0: "base_b", 1: "base_b"})).replace(" select * from (select * from l0", " select *, case when depth = 0 then null when depth = 2 and k2 is not null then 'the ' || lower(k2) when depth < 3 then 'Unknown' end as label from (select * from l0"))
def service_tree(t):
    """A pruned tree of a customer with baselines and names: of brands, all other keys of their kind are unknown, topics have no names."""
    return customer_service(t).tree("authors", "customer-11", 4, 1998)


# --- ingestion ------------------------------------------------------------------------------------------------------------------


@query("select event_id as id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_extract(t):
    return t.events.select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select p_partkey as parent_id, cast(i - 1 as int) as position, string_split(p_name, ' ')[i] as item from part, range(1, 12) r(i) where i <= len(string_split(p_name, ' '))")
def explode_lists(t):
    from .sources.records import child_rows

    return child_rows(t.part.select(F.col("p_partkey").alias("id"), C.split_list(F.col("p_name"), " ").alias("words")), "words")


@query("select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_mktsegment from customer")
def csv_round_trip(t):
    """Written as gzip CSV and read with its columns."""
    rows, folder = t.customer.select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_mktsegment"), new_folder(t.spark, "csv")
    records.write_csv(rows, folder)
    return records.read_csv(t.spark, folder, "c_custkey long, c_name string, c_nationkey long, c_mktsegment string")


@query("select p_partkey as id, p_name as name, string_split(p_name, ' ')[1] as first_word from part")
def json_round_trip(t):
    """Results stored as JSON lines."""
    folder = new_folder(t.spark, "json")
    records.write_json(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.split("p_name", " ").alias("words")), folder)
    return t.spark.read.schema("id long, name string, words array<string>").json(folder).select("id", "name", F.get("words", F.lit(0)).alias("first_word"))


@query("select o_orderkey as id, left(o_orderpriority, 8) as short, cast(year(o_orderdate) - 1990 as int) as year_offset, o_orderkey as number, o_custkey as segment from orders")
def parsed_columns(t):
    """Short keys, years from a start, numbers at the end of addresses and last segments."""
    address, path = F.concat(F.lit("https://host/W"), F.col("o_orderkey")), F.concat(F.lit("https://host/fields/"), F.col("o_custkey"))
    return t.orders.select(F.col("o_orderkey").alias("id"), C.short_key(F.col("o_orderpriority")).alias("short"), C.year_offset(F.year("o_orderdate"), 1990).alias("year_offset"), C.url_number(address).alias("number"), C.last_segment(path).alias("segment"))


@query("select page_id, substr(url, 17) as suffix from pages")
def doi_suffixes(t):
    return t.pages.select("page_id", C.doi_suffix(F.col("url")).alias("suffix"))


def nested_orders(t: Tables) -> DataFrame:
    """Orders as records that hold their lines, each with its part and the words of the part's name."""
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.struct(F.col("p_brand").alias("brand"), F.split("p_name", " ").alias("words")).alias("part"))
    lines = t.lineitem.join(part, "l_partkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_partkey", "part"))).alias("lines"))
    return t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus").join(lines, F.col("id") == F.col("l_orderkey"), "left").select("id", "o_orderstatus", "lines")


_NESTED = "n as (select l_orderkey || '.lines.' || (row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice) - 1) || '.part' as part, l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice) - 1 as i, l_partkey, string_split(p_name, ' ') as words from lineitem join part on p_partkey = l_partkey)"


@query(f"with {_NESTED} select part || '.words.' || (k - 1) as key, part as parent_key, cast(k - 1 as int) as position, words[k] as value from n, range(1, 12) r(k) where k <= len(words)")
def nested_children(t):
    """The words of the parts of the lines of orders: three levels below the records."""
    return records.split_nested(nested_orders(t), "orders")["orders_lines_part_words"]


@query(f"with {_NESTED} select 'order ' || o_orderkey as source, coalesce(p, '') as parts, coalesce(w, '') as words from orders left join (select l_orderkey, string_agg(l_partkey, ',' order by i) as p, string_agg(array_to_string(words, ','), ',' order by i) as w from n group by 1) on l_orderkey = o_orderkey union all select 'document ' || doc_id, '', '' from documents")
def json_paths(t):
    """Numbers and words at paths of raw JSON text; texts that are no JSON have none."""
    raw = nested_orders(t).select(F.concat(F.lit("order "), "id").alias("source"), F.to_json(F.struct("lines")).alias("text"))
    raw = raw.unionByName(t.documents.select(F.concat(F.lit("document "), "doc_id").alias("source"), "text"))
    parts, words = records.json_values(F.col("text"), "$.lines[*].l_partkey", "bigint"), records.json_values(F.col("text"), "$.lines[*].part.words[*]")
    return raw.select("source", F.array_join(parts.cast("array<string>"), ",").alias("parts"), F.array_join(words, ",").alias("words"))


_PRIME_SQL = f"""with {_GRAPH_SQL},
  cites as (select ref as work, count(*) as c from links group by ref), works as (select distinct author as entity, work from r_author),
  counts as (select entity, 0 as rel_type, subfield as related, count(*) as score, 0 as value from works join r_segment using (work) group by all
    union all select entity, 1, p.subfield, count(*), 0 from works w join links l on l.ref = w.work join c_part p on p.work = l.cit group by all
    union all select entity, 2, topic, count(*), 0 from works join r_segment using (work) group by all
    union all select entity, 3, cast(country as varchar), count(*), 0 from works join (select distinct work, country from r_ci) using (work) group by all
    union all select entity, 4, cast(source as varchar), count(*), source * 10 from works join r_source using (work) group by entity, source
    union all select entity, 5, cast(related as varchar), cast(coalesce(min(case when place > c then place end), count(*)) as bigint), 0 from (
      select w.entity, a.author as related, coalesce(c, 0) as c, row_number() over (partition by w.entity, a.author order by coalesce(c, 0) desc) - 1 as place from works w join r_author a using (work) left join cites using (work) where a.author <> w.entity) group by entity, related),
  placed as (select *, row_number() over (partition by entity, rel_type order by value desc, score desc, try_cast(related as bigint), related) as rank from counts)
  select entity, rel_type, related, score, rank from placed where rank <= case rel_type when 5 then 5 else 3 end"""


@query(_PRIME_SQL)
def prime_lists(t):
    """All six top lists of customers and suppliers at once; a source's value is ten times its number."""
    graph = order_graph(t)
    # tables are stored as a build stores them, rows of a work together
    lines = t.lineitem.select(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("inst"), F.col("l_partkey").alias("cit"))
    stored = lambda rows, name: written(rows.repartition("work").distinct(), name)
    author = stored(t.orders.select(F.col("o_orderkey").alias("work"), F.col("o_custkey").alias("author")).union(lines.select("work", "inst")), "authors")
    country = stored(lines.join(graph.tables["r", "inst_country"], "inst").select("work", "country"), "countries")
    citing = stored(lines.select("work", "cit"), "citing").withColumnRenamed("work", "ref")
    segment = written(graph.tables["r", "subfield_topic"], "segments")
    tables = {("r", "author"): author, ("r", "country"): country, ("r", "subfield"): segment.select("work", "subfield"), ("r", "topic"): segment.select("work", "topic").distinct()}
    graph = replace(graph, citing=citing, tables={**graph.tables, **tables}, roots={**graph.roots, "authors": author.select(F.col("author").alias("entity"), "work")})
    values = graph.tables["r", "source"].select("source", (F.col("source") * 10).alias("value")).distinct()
    return entities.prime_lists(graph, "authors", values)


@query("select d.doc_id, d.lang, d.n_chars from documents d join labels l on l.doc_id = d.doc_id where l.quality = 1 and d.n_chars > 500")
def export_filtered(t):
    return t.documents.filter("n_chars > 500").join(t.labels.filter("quality = 1").select("doc_id"), "doc_id").select("doc_id", "lang", "n_chars")


@query("select o_orderkey as id, cast(case when year(o_orderdate) >= 2001 then 5 when year(o_orderdate) >= 2000 then 4 when year(o_orderdate) >= 1999 then 3 when year(o_orderdate) >= 1998 then 2 when year(o_orderdate) >= 1997 then 1 else 0 end as int) as period, case p_q when 1 then 'Q1' when 2 then 'Q2' when 3 then 'Q3' when 4 then 'Q4' else 'Uncategorized' end as label from (select *, o_orderkey % 6 as p_q from orders)")
def period_and_quartile(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), C.period(F.year("o_orderdate"), YEARS).alias("period"), C.quartile_label(F.col("o_orderkey") % 6).alias("label"))


@query("""with w as (select l_orderkey as id from lineitem group by 1 having count(*) >= 2 and bool_or(l_suppkey in (1, 2, 3) and l_quantity / 50e0 > 0.7e0))
  select cast(l_orderkey as varchar) as id, cast(l_suppkey as varchar) as topic, l_quantity / 50e0 as score from lineitem where l_orderkey in (select id from w)""")
def topic_export(t):
    from .sources.records import topic_export as export

    topic = F.struct(F.col("l_suppkey").cast("string").alias("id"), (F.col("l_quantity") / 50).alias("score"))
    lists = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.collect_list(topic).alias("topics"), F.collect_list(F.col("l_partkey").cast("string")).alias("referenced_works"), F.count("*").alias("cited_by_count"))
    return export(lists.withColumn("display_name", F.lit("")).withColumn("publication_year", F.lit(0)), ["1", "2", "3"])[2]
