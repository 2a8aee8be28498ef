"""Named queries over the benchmark tables, and the same in DuckDB SQL.

Every query runs over its whole tables. Where SQL would be too slow on them, or
can't follow, a query has none and is tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.paths import camel_to_snake, common_ancestor, dir_depth, effort, parent_dir, relative_label, strip_prefix, top_level
from plumbline.operators import actions, coupling, history, imports, metrics, reach, rollup, rules, scoring
from plumbline.plans import audit as audits
from plumbline.plans import monorepo
from plumbline.plans.runtime import cut, release, stored
from plumbline.plans.settings import Layer, ModuleConfig, Rule, Settings
from plumbline.sources import graph as graphs
from plumbline.sources import rendered

#: The configuration that the queries on layers, rules and monorepos use.
LAYERS = [Layer("top", "Brand#1*/**"), Layer("middle", "Brand#2*/**", True, 2.5), Layer("low", "Brand#{3,4,5}/**")]
RULES = [Rule("Brand#2/**", "Brand#3/**"), Rule("Brand#4/**", "**/PROMO/**", message="no promotions here"), Rule("Brand#5/**", "Brand#6/**", allow=True)]
MONOREPO = [ModuleConfig("core", "Brand#1", ["tools"]), ModuleConfig("tools", "Brand#2", []), ModuleConfig("apps", "Brand#3", ["core", "tools"]), ModuleConfig("docs", "Brand#4/PROMO", ["core"])]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def take(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return take


def _sql_graph(by_year: bool = False) -> str:
    """CTEs: mods, deps and edges, then pairs, circ, loops and viol, of the graph that ``graphs.load`` makes.

    ``loops`` are strong components of siblings without a mutual pair. A search
    in ascending order comes to each directory by the least simple path, so the
    one of a component that it comes to last, where the loop begins, is the one
    whose least path is greatest; and the loop is the least closed path there.
    """
    snap = "cast(year(o_orderdate) as varchar)" if by_year else "'all'"
    join = "join orders on l_orderkey = o_orderkey" if by_year else ""
    seen = "select distinct snapshot_id, f as id from lines" if by_year else "select 'all' as snapshot_id, p_partkey as id from part"
    return f"""
with recursive lines as (select {snap} as snapshot_id, l_partkey as f, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as t, l_linenumber as line
               from lineitem {join}),
seen as ({seen}),
mods as (select snapshot_id, id, p_brand as brand, p_brand || '/' || p_type as dir, p_brand || '/' || p_type || '/P' || id || '.kt' as path from seen join part on p_partkey = id),
deps as (select distinct snapshot_id, f, t, line from lines where t is not null),
edges as (select d.snapshot_id, a.path as fp, b.path as tp, a.brand as fb, b.brand as tb, a.dir as fd, b.dir as td, line
          from deps d join mods a on a.snapshot_id = d.snapshot_id and a.id = f join mods b on b.snapshot_id = d.snapshot_id and b.id = t),
hits as (select snapshot_id, case when fb <> tb then '' else fb end as parent, case when fb <> tb then fb else fd end as dir_a, case when fb <> tb then tb else td end as dir_b,
                case when fb <> tb then 0 else 2 end as depth, fp, tp, line from edges where fd <> td),
pairs as (select snapshot_id, parent, dir_a, dir_b, depth, count(*) as weight, min(row(fp, tp, line)) as one from hits group by all),
n_mods as (select snapshot_id, count(*) as n from mods group by snapshot_id),
circ as (select x.snapshot_id, x.parent, x.dir_a, x.dir_b, x.depth, x.weight as ab, y.weight as ba, x.one as one_ab, y.one as one_ba
         from pairs x join pairs y on x.snapshot_id = y.snapshot_id and x.dir_a = y.dir_b and x.dir_b = y.dir_a and x.dir_a < x.dir_b),
inn as (select * from pairs where (snapshot_id, dir_a) in (select (snapshot_id, dir_b) from pairs) and (snapshot_id, dir_b) in (select (snapshot_id, dir_a) from pairs)),
clos as (select snapshot_id, parent, dir_a as a, dir_b as b from inn union select c.snapshot_id, c.parent, c.a, i.dir_b from clos c join inn i on c.snapshot_id = i.snapshot_id and c.parent = i.parent and c.b = i.dir_a),
comp as (select x.snapshot_id, x.parent, x.a as m, min(x.b) as rep from clos x join clos y on x.snapshot_id = y.snapshot_id and x.parent = y.parent and x.a = y.b and x.b = y.a group by all),
loops as (select snapshot_id, parent, rep, max(depth) as depth, list(distinct i.dir_a) as members
          from inn i join comp x using (snapshot_id, parent) join comp y using (snapshot_id, parent, rep) where x.m = i.dir_a and y.m = i.dir_b group by all
          having sum(case when (snapshot_id, parent, i.dir_b, i.dir_a) in (select (snapshot_id, parent, dir_a, dir_b) from pairs) then 1 else 0 end) = 0),
roots as (select l.snapshot_id, l.parent, l.rep, l.members, least(l.rep, min(c.a)) as r from loops l left join clos c on c.snapshot_id = l.snapshot_id and c.parent = l.parent and c.b = l.rep group by l.snapshot_id, l.parent, l.rep, l.members),
walk as (select snapshot_id, parent, rep, members, r as node, [r] as way from roots
         union all select w.snapshot_id, w.parent, w.rep, w.members, i.dir_b, list_append(w.way, i.dir_b) from walk w join inn i on i.snapshot_id = w.snapshot_id and i.parent = w.parent and i.dir_a = w.node where not list_contains(w.way, i.dir_b)),
met as (select snapshot_id, parent, rep, members, node, min(way) as way from walk where list_contains(members, node) group by all),
latest as (select snapshot_id, parent, rep, members, arg_max(node, way) as first from met group by all),
round_ as (select snapshot_id, parent, rep, members, first, first as node, [first] as way from latest
           union all select w.snapshot_id, w.parent, w.rep, w.members, w.first, i.dir_b, list_append(w.way, i.dir_b) from round_ w join inn i on i.snapshot_id = w.snapshot_id and i.parent = w.parent and i.dir_a = w.node
                     where list_contains(w.members, i.dir_b) and not list_contains(w.way, i.dir_b)),
closed as (select w.snapshot_id, w.parent, w.rep, min(list_append(w.way, w.first)) as path from round_ w join inn i on i.snapshot_id = w.snapshot_id and i.parent = w.parent and i.dir_a = w.node and i.dir_b = w.first group by all),
hops as (select snapshot_id, parent, rep, path, unnest(path[:-2]) as dir_a, unnest(path[2:]) as dir_b from closed),
told as (select snapshot_id, parent, rep, path, max(i.depth) as depth, sum(weight) as density, min(weight) as least from hops join inn i using (snapshot_id, parent, dir_a, dir_b) group by all),
viol as (select snapshot_id, parent, dir_a, dir_b, one[1] as from_module, one[2] as to_module, one[3] as line_number, depth, weight, weight / (depth + 1.0e0) as severity, 'sibling' as direction,
                false as is_circular, 0 as cycle_order, cast(null as varchar) as weakest_link, 0 as break_cost, weight as density from pairs
         union all
         select snapshot_id, parent, dir_a, dir_b, dir_a, dir_b, 0, depth, 0, n / (depth + 1.0e0) / 10.0e0, 'circular', true, 2,
                case when ab <= ba then dir_a || ' -> ' || dir_b || ' (' || ab else dir_b || ' -> ' || dir_a || ' (' || ba end || case when least(ab, ba) = 1 then ' import)' else ' imports)' end, least(ab, ba), ab + ba
         from circ join n_mods using (snapshot_id)
         union all
         select snapshot_id, parent, path[1], path[-2], path[1], path[-2], 0, depth, 0, n / (depth + 1.0e0) / 10.0e0, 'circular', true, len(path) - 1, list_aggregate(list_transform(path, lambda x: regexp_extract(x, '[^/]*$')), 'string_agg', '->'), least, density from told join n_mods using (snapshot_id)),
risk as (select *, case when direction = 'sibling' then 4.0e0 else 10.0e0 end * greatest(1, density) as rri from viol where is_circular or severity >= 0.2)
"""


def _load(spark: SparkSession, sf_dir: str, **how) -> graphs.Graph:
    return graphs.load(spark, sf_dir, **how)


def _raw(spark: SparkSession, sf_dir: str, **how) -> tuple[graphs.Graph, DataFrame]:
    g = _load(spark, sf_dir, **how)
    return g, audits.raw_violations(g)


def _audit(spark: SparkSession, sf_dir: str, settings: Settings | None = None, **how) -> audits.Audit:
    return audits.audit(_load(spark, sf_dir, **how), settings)


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})  # no negative zero


@query(_sql_graph() + """
select path, split_part(path, '/', 3) as name, dir as directory, brand as top, cast(3 as bigint) as depth, cast(2 as bigint) as dir_depth from mods""")
def module_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _load(spark, sf_dir).modules
    return m.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), parent_dir("path").alias("directory"), top_level(F.col("path")).alias("top"), F.size(F.split("path", "/")).cast("long").alias("depth"), dir_depth(parent_dir("path")).cast("long").alias("dir_depth"))


@query(_sql_graph() + """
, d as (select distinct brand as child, '' as directory from mods union select distinct dir, brand from mods)
select directory, string_agg(child, ',' order by child) as children from d group by directory""")
def dir_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.directory_tree(_load(spark, sf_dir).modules).select("directory", F.array_join("children", ",").alias("children"))


@query(_sql_graph() + """
select dir_a, dir_b, cast(depth as bigint) as depth, cast(weight as bigint) as weight, weight / (depth + 1.0e0) as severity, one[1] as from_module, one[2] as to_module, cast(one[3] as bigint) as line_number from pairs""")
def sibling_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = coupling.sibling_pairs(_load(spark, sf_dir).edges())
    return _longs(pairs.select("dir_a", "dir_b", "depth", "weight", (F.col("weight") / (F.col("depth") + 1.0)).alias("severity"), "from_module", "to_module", "line_number"), "depth", "weight", "line_number")


@query(_sql_graph() + """
select dir_a, dir_b, dir_a || '>' || dir_b || '>' || dir_a as cycle_path, ab || ',' || ba as hop_counts, severity, weakest_link, cast(v.break_cost as bigint) as break_cost
from circ join viol v using (snapshot_id, dir_a, dir_b) where cycle_order = 2""")
def mutual_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, v = _raw(spark, sf_dir)
    return v.where("cycle_order = 2").select("dir_a", "dir_b", F.array_join("cycle_path", ">").alias("cycle_path"), F.array_join(F.transform("cycle_hop_counts", lambda x: x.cast("string")), ",").alias("hop_counts"), "severity", "weakest_link", "break_cost")


@query(_sql_graph(by_year=True) + """
select snapshot_id, parent, list_aggregate(path, 'string_agg', '>') as cycle_path, cast(density as bigint) as imports, cast(least as bigint) as fewest, cast(len(path) - 1 as bigint) as length from told""")
def n_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = coupling.sibling_pairs(_load(spark, sf_dir, by_year=True).edges())
    path = F.col("cycle_path")
    return coupling.long_cycles(pairs).select("snapshot_id", "parent", F.array_join(path, ">").alias("cycle_path"), F.expr("aggregate(cycle_hop_counts, 0L, (a, x) -> a + x)").alias("imports"), F.array_min("cycle_hop_counts").alias("fewest"), (F.size(path) - 1).cast("long").alias("length"))


@query(_sql_graph() + "select dir_a, dir_b, direction, cast(density as bigint) as density, rri from risk")
def rri_by_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _audit(spark, sf_dir).violations
    density = F.when(F.col("is_circular"), F.expr("aggregate(cycle_hop_counts, 0L, (a, x) -> a + x)")).otherwise(F.col("weight"))
    return v.select("dir_a", "dir_b", "direction", density.cast("long").alias("density"), "rri")


_SCORES = """
select m.snapshot_id, cast(n as bigint) as n_modules, round(greatest(0.0e0, 100.0e0 * (1.0e0 - coalesce(s, 0) / n)), 6) as severity_score, round(coalesce(t, 0.0e0), 6) as tri,
       round(greatest(0.0e0, least(100.0e0, 100.0e0 * (1.0e0 - coalesce(t, 0) / (n * 10.0e0)))), 6) as tri_score, cast(xs as bigint) as total_xs
from n_mods m left join (select snapshot_id, sum(severity) as s, sum(rri) as t from {risk} group by 1) using (snapshot_id)
left join (select snapshot_id, sum(case when is_circular then break_cost else weight end) as xs from {xs} group by 1) using (snapshot_id)"""


def _scores(a: audits.Audit) -> DataFrame:
    return _rounded(_longs(a.scores().join(a.total_xs, "snapshot_id", "left"), "n_modules", "total_xs"), "severity_score", "tri", "tri_score").select("snapshot_id", "n_modules", "severity_score", "tri", "tri_score", "total_xs")


@query(_sql_graph(by_year=True) + _SCORES.format(risk="risk", xs="viol"))
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_audit(spark, sf_dir, by_year=True))


@query(_sql_graph(by_year=True) + _SCORES.format(risk="(select * from risk where is_circular)", xs="(select * from risk where is_circular)"))
def actionable_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_audit(spark, sf_dir, Settings(coupling_mode="actionable"), by_year=True))


_FANS = """
, fi as (select snapshot_id, tp as path, count(*) as i from edges group by all), fo as (select snapshot_id, fp as path, count(*) as o from edges group by all),
fans as (select snapshot_id, path, cast(coalesce(i, 0) as bigint) as fan_in, cast(coalesce(o, 0) as bigint) as fan_out,
                case when coalesce(i, 0) + coalesce(o, 0) > 0 then coalesce(o, 0) / cast(coalesce(i, 0) + coalesce(o, 0) as double) else 0.0e0 end as instability
         from mods left join fi using (snapshot_id, path) left join fo using (snapshot_id, path))
"""


@query(_sql_graph() + _FANS + "select path, fan_in, fan_out, instability from fans")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _load(spark, sf_dir)
    return metrics.fan_metrics(g.edges(), g.modules).drop("snapshot_id")


@query()
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _load(spark, sf_dir, by_year=True)
    g = graphs.Graph(stored(g.modules), g.deps)
    release(spark)
    return reach.blast_radius(g.edges(), g.modules)


@query()
def critical_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _load(spark, sf_dir, by_year=True)
    return reach.critical_path(g.edges(), g.modules).select("snapshot_id", "max_depth")


@query(_sql_graph() + """
select dir as directory, cast(n as bigint) as file_count, cast(coalesce(i, 0) as bigint) as internal_deps, coalesce(i, 0) / (n * (n - 1.0e0)) as cohesion
from (select dir, count(*) as n from mods group by dir having count(*) >= 2) left join (select fd as dir, count(*) as i from edges where fd = td group by fd) using (dir)""")
def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _load(spark, sf_dir)
    return metrics.cohesion(g.edges(), g.modules).drop("snapshot_id")


_INDEPENDENCE = """
, ind as (select m.snapshot_id, m.module, cast(n as bigint) as file_count, cast(coalesce(i, 0) as bigint) as internal_deps, cast(coalesce(x, 0) as bigint) as external_deps,
                 case when coalesce(i, 0) + coalesce(x, 0) > 0 then coalesce(i, 0) / cast(coalesce(i, 0) + coalesce(x, 0) as double) else 1.0e0 end as independence
          from (select snapshot_id, brand as module, count(*) as n from mods group by all having count(*) >= 2) m
          left join (select snapshot_id, fb as module, count(*) filter (fb = tb) as i, count(*) filter (fb <> tb) as x from edges group by all) using (snapshot_id, module))
"""


@query(_sql_graph() + _INDEPENDENCE + "select module, file_count, internal_deps, external_deps, independence from ind")
def independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _load(spark, sf_dir)
    return metrics.independence(g.edges(), g.modules).drop("snapshot_id")


@query(_sql_graph() + """
, ends as (select from_module as p, direction, rri from risk union all select to_module, direction, rri from risk),
by_path as (select p, sum(rri) as total, count(*) as n, sum(case when direction = 'sibling' then rri else 0.0e0 end) as sib, sum(case when direction = 'circular' then rri else 0.0e0 end) as cir from ends where p <> '' group by p),
med as (select list_sort(list(total))[cast(floor(count(*) / 2) as bigint) + 1] as m from by_path)
select p as module_path, total as total_rri, cast(n as bigint) as relationship_count, sib as sibling_rri, cir as circular_rri, cast((sib > 0)::int + (cir > 0)::int as bigint) as direction_count
from by_path, med where total > greatest(1.0e0, 2 * m) and n >= 2""")
def gravity_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir).gravity_wells().select("module_path", "total_rri", "relationship_count", "sibling_rri", "circular_rri", "direction_count")


@query(_sql_graph() + """
, sib as (select *, greatest(1, weight) as w from risk where direction = 'sibling'), med as (select list_sort(list(w))[cast(floor(count(*) / 2) as bigint) + 1] as m, count(*) as n from sib)
select 'fused_sibling' as kind, dir_a, dir_b, cast(weight as bigint) as weight, rri from sib, med where n >= 2 and w > greatest(2, 2 * m)""")
def red_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir).red_flags().drop("snapshot_id")


_LAYER = "case when {0} like 'Brand#1%/%' then 0 when {0} like 'Brand#2%/%' then 1 when regexp_matches({0}, '^Brand#(3|4|5)/') then 2 end"


@query(_sql_graph() + f"""
, e as (select *, {_LAYER.format('fp')} as f, {_LAYER.format('tp')} as t from edges)
select fp as from_module, tp as to_module, ['top', 'middle', 'low'][f + 1] as from_layer, ['top', 'middle', 'low'][t + 1] as to_layer, cast(line as bigint) as line_number from e where t < f""")
def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(rules.layer_violations(_load(spark, sf_dir).edges(), LAYERS).drop("snapshot_id"), "line_number")


@query(_sql_graph() + f"""
, v as (select *, {_LAYER.format('from_module')} as f, {_LAYER.format('to_module')} as t from risk)
select dir_a, dir_b, is_circular, case when not is_circular and f = t and f = 1 then 2.5e0 * greatest(1, weight) else rri end as rri from v where is_circular or not coalesce(f < t, false)""")
def layer_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir, Settings(layers=LAYERS)).violations.select("dir_a", "dir_b", "is_circular", "rri")


@query(_sql_graph() + """
select fp as from_module, tp as to_module, 'Forbidden dependency: Brand#2/** -> Brand#3/**' as message, cast(line as bigint) as line_number from edges where fp like 'Brand#2/%' and tp like 'Brand#3/%'
union all select fp, tp, 'no promotions here', cast(line as bigint) from edges where fp like 'Brand#4/%' and tp like '%/PROMO/%'""")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(rules.rule_violations(_load(spark, sf_dir).edges(), RULES).drop("snapshot_id"), "line_number")


_MODULE = "case when {0} like 'Brand#1/%' then 'core' when {0} like 'Brand#2/%' then 'tools' when {0} like 'Brand#3/%' then 'apps' when {0} like 'Brand#4/PROMO/%' then 'docs' end"
_CROSS = f"""
, e as (select *, {_MODULE.format('fp')} as f, {_MODULE.format('tp')} as t from edges),
cross_ as (select * from e where f <> t and not ((f = 'core' and t = 'tools') or (f = 'apps' and t in ('core', 'tools')) or (f = 'docs' and t = 'core')))
"""


@query(_sql_graph() + _CROSS + "select f as from_name, t as to_name, fp as from_module, tp as to_module, cast(line as bigint) as line_number from cross_")
def cross_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(rules.cross_module_violations(_load(spark, sf_dir).edges(), MONOREPO).drop("snapshot_id"), "line_number")


@query(_sql_graph() + _CROSS + f"""
, mm as (select {_MODULE.format('path')} as name, count(*) as n from mods where {_MODULE.format('path')} is not null group by 1),
inner_ as (select f as name, fd, td, count(*) as w from e where f = t and fd <> td group by all),
mutual as (select x.name, count(*) as c from inner_ x join inner_ y on x.name = y.name and x.fd = y.td and x.td = y.fd and x.fd < y.fd group by x.name),
s as (select name, n, greatest(0.0e0, 100.0e0 * (1.0e0 - (coalesce((select sum(w / 3.0e0) from inner_ i where i.name = mm.name), 0) + coalesce((select c * (n / 3.0e0 / 10.0e0) from mutual u where u.name = mm.name), 0)) / n)) as score from mm)
select name, cast(n as bigint) as files, round(score, 6) as score, round(greatest(0.0e0, (select sum(score * n) / sum(n) from s) - 100.0e0 * (select count(*) from cross_) / (select sum(n) from mm)), 6) as overall from s""")
def monorepo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(monorepo.audit_modules(_load(spark, sf_dir), MONOREPO)[0].drop("violations"), "score", "overall")


@query(_sql_graph() + """
, ch as (select p_brand || '/' || p_type || '/P' || p_partkey || '.kt' as file from part where p_partkey % 100 = 0),
hop as (select dir_a, dir_b, unnest([one_ab[1], one_ab[2], one_ba[1], one_ba[2]]) as p from circ)
select dir_a, dir_b, is_circular from risk where not is_circular and (from_module in (from ch) or to_module in (from ch))
union all select dir_a, dir_b, true from (select distinct dir_a, dir_b from hop where p in (from ch))""")
def diff_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _load(spark, sf_dir)
    changed = g.modules.where("id % 100 = 0").select(F.col("path").alias("file"))
    return audits.audit(g).only_changed(changed).violations.select("dir_a", "dir_b", "is_circular")


@query(_sql_graph(by_year=True) + """
, fp as (select snapshot_id, case when cycle_order = 2 then 'circular:2:' || regexp_extract(dir_a, '[^/]*$') || '->' || regexp_extract(dir_b, '[^/]*$') || '->' || regexp_extract(dir_a, '[^/]*$')
    when is_circular then 'circular:' || cycle_order || ':' || weakest_link else 'coupling:' || from_module || ':' || to_module end as fingerprint from risk)
select distinct fingerprint, 'new' as status from fp where snapshot_id = '2000' and fingerprint not in (select fingerprint from fp where snapshot_id = '1999')
union all select distinct fingerprint, 'resolved' from fp where snapshot_id = '1999' and fingerprint not in (select fingerprint from fp where snapshot_id = '2000')""")
def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline(_audit(spark, sf_dir, by_year=True))


def _baseline(a: audits.Audit) -> DataFrame:
    f = a.fingerprints()
    return history.compare_baseline(f.where("snapshot_id = '2000'").select("fingerprint"), f.where("snapshot_id = '1999'").select("fingerprint"))


_YEARLY = """, score as (select m.snapshot_id, greatest(0.0e0, 100.0e0 * (1.0e0 - coalesce(s, 0) / n)) as score from n_mods m left join (select snapshot_id, sum(severity) as s from viol group by 1) using (snapshot_id))
"""


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, v = _raw(spark, sf_dir, by_year=True)
    return scoring.severity_score(v, g.modules).select("snapshot_id", F.col("severity_score").alias("score"))


@query(_sql_graph(by_year=True) + _YEARLY + "select snapshot_id, round(score, 6) as score, round(score - lag(score) over (order by snapshot_id), 6) as delta from score")
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(history.trend(_yearly(spark, sf_dir)), "score", "delta")


_BY_MODULE = """, ms as (select m.snapshot_id, m.module, greatest(0.0e0, 100.0e0 * (1.0e0 - coalesce(s, 0) / n)) as score from (select snapshot_id, brand as module, count(*) as n from mods group by all) m
left join (select snapshot_id, split_part(dir_a, '/', 1) as module, sum(severity) as s from viol group by all) using (snapshot_id, module))
"""


@query(_sql_graph(by_year=True) + _BY_MODULE + """
, d as (select *, score - last_value(score ignore nulls) over (partition by module order by snapshot_id rows between unbounded preceding and 1 preceding) as x from ms)
select snapshot_id, module, round(score, 6) as score, case when x > 0.5 then 'up' when x < -0.5 then 'down' when x is not null then 'flat' end as arrow from d""")
def trend_by_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, v = _raw(spark, sf_dir, by_year=True)
    return _rounded(history.module_trend(history.module_scores(v, g.modules)), "score")


@query(_sql_graph(by_year=True) + """
select c.from_module, c.to_module, cast(count(h.snapshot_id) as bigint) as seen_in, case when count(h.snapshot_id) = 0 then 'new' when count(h.snapshot_id) < 5 then 'recent' else 'chronic' end as age
from (select distinct from_module, to_module from risk where snapshot_id = '2000') c left join (select distinct snapshot_id, from_module, to_module from viol where snapshot_id <> '2000') h using (from_module, to_module) group by all""")
def violation_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ages(_load(spark, sf_dir, by_year=True))


def _ages(g: graphs.Graph) -> DataFrame:
    current = audits.audit(g).violations.where("snapshot_id = '2000'")
    past = audits.raw_violations(g).where("snapshot_id <> '2000'")
    return _longs(history.ages(current, past), "seen_in")


@query(_sql_graph(by_year=True) + """
, p as (select distinct snapshot_id as s, from_module as f, to_module as t from viol), steps as (select snapshot_id as s, lag(snapshot_id) over (order by snapshot_id) as b from n_mods)
select *, introduced - resolved as net from (select s as snapshot_id, cast((select count(*) from p x where x.s = steps.s and not exists (select 1 from p y where y.s = steps.b and y.f = x.f and y.t = x.t)) as bigint) as introduced,
       cast((select count(*) from p x where x.s = steps.b and not exists (select 1 from p y where y.s = steps.s and y.f = x.f and y.t = x.t)) as bigint) as resolved
from steps where b is not null)""")
def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, v = _raw(spark, sf_dir, by_year=True)
    return _longs(history.velocity(v, g.modules), "introduced", "resolved", "net")


@query(_sql_graph(by_year=True) + _BY_MODULE + """
, x as (select snapshot_id, row_number() over (order by snapshot_id) - 1 as x from n_mods)
select module, round(coalesce(regr_slope(score, x), 0.0e0), 6) + 0.0e0 as slope, cast(count(*) as bigint) as points from ms join x using (snapshot_id) group by module""")
def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, v = _raw(spark, sf_dir, by_year=True)
    return _rounded(history.trajectories(history.module_scores(v, g.modules), g.modules), "slope")


@query()
def risk_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.concentration(stored(blast_radius(spark, sf_dir)), "2000", "1999")


@query(_sql_graph(by_year=True) + _YEARLY + """
, e as (select arg_min(score, snapshot_id) as a, arg_max(score, snapshot_id) as b, count(*) as n from score)
select round(a, 6) as first_score, round(b, 6) as last_score, cast(n as bigint) as snapshots, round(b - a, 6) as change, case when b - a > 0.5 then 'improving' when b - a < -0.5 then 'degrading' else 'stable' end as direction from e""")
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(history.headline(_yearly(spark, sf_dir)), "first_score", "last_score", "change")


_LINKS = r"""
with recursive h as (select page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) as module_path, regexp_extract_all(html, 'href="([^"]*)"', 1) as l from pages),
links as (select page_id, module_path, unnest(l) as import_path, generate_subscripts(l, 1) as line_number from h)
"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = pages.select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1).alias("module_path"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("_n", "import_path"))
    return found.select("page_id", "module_path", "import_path", (F.col("_n") + 1).cast("long").alias("line_number"))


@query(_LINKS + "select page_id, module_path, import_path, cast(line_number as bigint) as line_number from links")
def extract_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


@query(_LINKS + """
select module_path, cast(count(*) as bigint) as n from links where ltrim(import_path, '/') not in (select module_path from h) group by module_path""")
def external_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1).alias("_to")).distinct()
    return links.join(pages, F.ltrim("import_path", F.lit("/")) == F.col("_to"), "left_anti").groupBy("module_path").agg(F.count("*").alias("n"))


@query(_sql_graph() + """
, i as (select distinct fp as path, replace(regexp_extract(tp, '/(.*)\\.kt$', 1), '/', '.') as import_path, line from edges)
select i.path, import_path, cast(line as bigint) as line_number, m.path as to_path from i left join (select min(path) as path, regexp_extract(path, '/(.*)$', 1) as tail from mods group by tail) m on m.tail = replace(import_path, '.', '/') || '.kt'""".replace("\\\\", "\\"))
def resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _load(spark, sf_dir)
    return _resolved(g, g.edges())


def _resolved(g: graphs.Graph, edges: DataFrame) -> DataFrame:
    named = edges.select(F.col("from_path").alias("path"), F.translate(F.regexp_extract("to_path", r"/(.*)\.kt$", 1), "/", ".").alias("import_path"), "line_number").distinct()
    stem = F.translate("import_path", ".", "/")
    tries = F.array(*(F.struct(F.lit("suffix").alias("how"), F.concat(stem, F.lit(e)).alias("text")) for e in (".kt", ".kts")))
    return _longs(imports.resolve(named.withColumn("tries", tries), g.modules.select("path")).select("path", "import_path", "line_number", "to_path"), "line_number")


def _scan_sql(language: str) -> str:
    how = rendered.LANGUAGES[language]
    kind = "upper(p_type[1]) || lower(p_type[2:])" if how.capitals else "lower(p_type)"
    src, b, p = ("Src", "B", "P") if how.capitals else ("src", "b", "p")
    return f"""
with lines as (select l_partkey as f, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as t from lineitem),
files as (select p_partkey as id, '{src}/{b}' || p_brand[7:] || '/' || {kind} || '/{p}' || p_partkey || '.{how.extension}' as path from part),
steps as (select f, t, row_number() over (partition by f order by t) as n from (select distinct f, t from lines join part on p_partkey = f where t in (select p_partkey from part)))
select x.path, 'import' as kind, y.path as target, cast(n + 1 as bigint) as number from steps join files x on x.id = f join files y on y.id = t
union all select path, 'external', null, 1 from files
union all select path, 'suppressed', null, 1 from files where id in (select f from steps)"""


def _scan(language: str):
    def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
        deps, external, suppressed = imports.scan(rendered.source_texts(spark, sf_dir, language))
        none = F.lit(None).cast("string")
        found = deps.select(F.col("from_path").alias("path"), F.lit("import").alias("kind"), F.col("to_path").alias("target"), F.col("line_number").cast("long").alias("number"))
        for name, counts in (("external", external), ("suppressed", suppressed)):
            found = found.unionByName(counts.select("path", F.lit(name).alias("kind"), none.alias("target"), F.col("count").alias("number")))
        return found

    scan.__name__ = f"scan_{language}"
    scan.__doc__ = f"The graph, read back from its files in {language}: imports, external imports and suppressed ones."
    return scan


for _language in rendered.LANGUAGES:
    query(_scan_sql(_language))(_scan(_language))


@query(r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where text is not null),
b as (select *, lag(line) over (partition by doc_id order by n) as p from l)
select cast(doc_id as varchar) as path, cast(n as bigint) as line_number from b where contains(line, 'icense') or (contains(p, 'icense') and regexp_matches(trim(p), '^(//|#|--)'))""")
def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), "text")
    return _longs(imports.suppressed_lines(docs, "icense"), "line_number")


_ACTIONS = _FANS + f"""
, hot as (select path, fan_in from fans where fan_in >= 10 qualify row_number() over (order by fan_in desc, path) <= 3),
users as materialized (select distinct fp, tp from edges),
above as (select path, path as src from hot union select a.path, u.fp from above a join users u on u.tp = a.src),
e2 as (select *, {_LAYER.format('fp')} as f, {_LAYER.format('tp')} as t from edges),
act as (
 select 'circular' as category, 'Untangle the loop at ' || regexp_extract(dir_a, '[^/]*$') as title, regexp_extract(dir_a, '[^/]*$') || ' → ' || regexp_extract(dir_b, '[^/]*$') || ' → ' || regexp_extract(dir_a, '[^/]*$') as detail,
        'Cut its thinnest hop: ' || weakest_link as action, cast(greatest(1, break_cost) as bigint) as cost, severity * 2 as impact, severity * 2 / greatest(1, break_cost) as roi from risk where is_circular
 union all select 'layer', 'Import against the layers: ' || ['top', 'middle', 'low'][f + 1] || ' → ' || ['top', 'middle', 'low'][t + 1], fp || ':' || line, 'Drop the import, or keep what both sides need below ' || ['top', 'middle', 'low'][f + 1], 1, 5.0e0, 5.0e0 from e2 where t < f
 union all select 'rule', 'Rule broken: ' || m, fp || ':' || line || ' → ' || tp, m, 1, 3.0e0, 3.0e0 from (select *, 'Forbidden dependency: Brand#2/** -> Brand#3/**' as m from edges where fp like 'Brand#2/%' and tp like 'Brand#3/%' union all select *, 'no promotions here' from edges where fp like 'Brand#4/%' and tp like '%/PROMO/%')
 union all select 'hotspot', 'Look over ' || regexp_extract(path, '[^/]*$'), fan_in || ' users, reached by ' || (select count(*) - 1 from above a where a.path = hot.path), 'Put an interface in front of it: many files change with it', fan_in, cast(fan_in as double), fan_in / 100.0e0 from hot)
"""


def _stored_audit(spark: SparkSession, sf_dir: str) -> audits.Audit:
    """The audit over imports that are written once, for queries that read them several times."""
    g = _load(spark, sf_dir)
    return audits.audit(g, edges=stored(g.edges()))


def _actions(a: audits.Audit) -> DataFrame:
    """All actions of an audit; the search for a radius starts from the three hotspots alone."""
    fans = cut(a.fans())
    radius = reach.radius_of(a.edges, actions.hotspots(fans))
    return actions.all_actions(a.violations, rules.layer_violations(a.edges, LAYERS), rules.rule_violations(a.edges, RULES), fans, radius)


@query(_sql_graph() + _ACTIONS + "select category, title, detail, action, cost, round(impact, 6) as impact, round(roi, 6) as roi from act order by act.roi desc, category, title, detail, action limit 10")
def top_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(actions.top(_actions(_stored_audit(spark, sf_dir)), 10).drop("snapshot_id"), "impact", "roi")


@query(_sql_graph() + _ACTIONS + "select category, title, detail, cost, round(impact, 6) as impact from act order by cost, act.impact desc, category, title, detail, action limit 5")
def quick_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(actions.quick_wins(_actions(_stored_audit(spark, sf_dir))).select("category", "title", "detail", "cost", "impact"), "impact")


@query(_sql_graph() + """
, d as (select '' as directory, count(*) as n, 0 as own from mods union all select brand, count(*), 0 from mods group by brand union all select dir, count(*), count(*) from mods group by dir),
v as (select parent as directory, count(*) as c, count(*) filter (is_circular) as k, sum(severity) as s from risk group by parent)
select directory, cast(n as bigint) as module_count, cast(own as bigint) as direct_files, cast(coalesce(c, 0) as bigint) as violations, cast(coalesce(k, 0) as bigint) as circular,
       round(greatest(0.0e0, 100.0e0 * (1.0e0 - coalesce(s, 0) / n)), 6) as score, c is not null or (directory = '' and exists (from v)) as has_violations from d left join v using (directory)""")
def dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _audit(spark, sf_dir)
    return _rounded(rollup.directory_rollup(a.graph.modules, a.violations).drop("snapshot_id"), "score")


@query(_sql_graph() + _FANS + _INDEPENDENCE + """
, v as (select split_part(dir_a, '/', 1) as module, count(*) as c, count(*) filter (is_circular) as k, sum(case when is_circular then break_cost else weight end) as x, sum(severity) as s from risk group by 1),
f as (select brand as module, count(*) as n, avg(instability) as i from mods join fans using (snapshot_id, path) group by 1)
select module, cast(n as bigint) as files, round(greatest(0.0e0, 100.0e0 * (1.0e0 - coalesce(s, 0) / n)), 6) as score, cast(coalesce(c, 0) as bigint) as violations, cast(coalesce(k, 0) as bigint) as circular,
       cast(coalesce(x, 0) as bigint) as xs, round(coalesce(independence, 1.0e0), 6) as independence, round(coalesce(i, 0.5e0), 6) as instability from f left join v using (module) left join ind using (module)""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _audit(spark, sf_dir)
    card = rollup.scorecard(a.graph.modules, a.violations, metrics.independence(a.edges, a.graph.modules), a.fans())
    return _rounded(card.drop("snapshot_id", "max_blast_radius"), "score", "independence", "instability")


@query(_sql_graph() + """
, imp as (select distinct fp, tp from edges where fd <> td), bad as (select one[1] as fp, one[2] as tp from pairs where weight / (depth + 1.0e0) >= 0.2 union select one_ab[1], one_ab[2] from circ union select one_ba[1], one_ba[2] from circ)
select fp as from_path, tp as to_path, (fp, tp) in (select (fp, tp) from bad) as in_violation from imp""")
def sunburst_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _audit(spark, sf_dir)
    bad = rollup.violation_edges(a.violations).drop("snapshot_id").withColumn("in_violation", F.lit(True))
    return rollup.bundle_edges(a.edges).drop("snapshot_id").join(bad, ["from_path", "to_path"], "left").withColumn("in_violation", F.coalesce("in_violation", F.lit(False)))


@query(_sql_graph() + """
, f as (select unnest([dir_a, dir_b]) as d from circ union select unnest([one_ab[1], one_ab[2], one_ba[1], one_ba[2]]) from circ),
u as (select d as directory from f where not ends_with(d, '.kt') union select split_part(d, '/', 1) from f where contains(d, '/') union select regexp_extract(d, '^(.*)/[^/]*$', 1) from f where ends_with(d, '.kt'))
select directory from u""")
def cycle_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.cycle_ancestors(_audit(spark, sf_dir).violations).select("directory")


@query(_sql_graph() + "select fb as from_dir, tb as to_dir, cast(count(*) as bigint) as imports from edges where fb <> tb group by all")
def level_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.level_edges(_load(spark, sf_dir).edges(), 1).drop("snapshot_id")


@query(_sql_graph() + """
, g as (select regexp_extract(dir_a, '[^/]*$') as s, regexp_extract(dir_b, '[^/]*$') as t, is_circular as c from risk union all select regexp_extract(dir_b, '[^/]*$'), regexp_extract(dir_a, '[^/]*$'), true from risk where is_circular)
select s as source, t as target, cast(count(*) as bigint) as violations, bool_or(c) as circular from g group by all""")
def dir_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.directory_graph(_audit(spark, sf_dir).violations).drop("snapshot_id")


@query(_sql_graph() + """
select case when is_circular then 'circular-dependency' else 'sibling-coupling' end as rule, case when rri >= 160 then 'BLOCKER' when rri >= 80 then 'CRITICAL' when rri >= 40 then 'MAJOR' when rri >= 10 then 'MINOR' else 'INFO' end as severity,
       cast(case when rri >= 160 then 60 when rri >= 80 then 30 when rri >= 40 then 20 when rri >= 10 then 10 else 5 end as bigint) as effort_minutes, from_module as file, cast(greatest(1, line_number) as bigint) as line,
       case when is_circular then 'Circular dependency: ' || dir_a || ' -> ' || dir_b || ' -> ' || dir_a else 'Sibling coupling: ' || dir_a || ' -> ' || dir_b end as message from risk""")
def sonar_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.sonar_issues(_audit(spark, sf_dir).violations).drop("snapshot_id")


@query(r"""
with b as (select p_brand as snapshot_id, 'src/main/' || p_brand || '/' || p_type || '/P' || p_partkey || '.kt' as path from part
           union all select substr(p_brand, 1, 7) || '*', 'src/main/' || p_brand || '/' || p_type || '/P' || p_partkey || '.kt' from part),
d as (select *, string_split(path, '/')[:-2] as dirs, regexp_extract(path, '^(.*)/', 1) as own from b),
n as (select snapshot_id, count(*) as n, min(path) as one from d group by snapshot_id),
k as (select snapshot_id, k, count(distinct dirs[:k]) as kinds, count(*) as c, min(dirs[:k]) as here from d, range(1, 5) r(k) where len(dirs) >= k group by all),
deep as (select snapshot_id, max_by(here, k) as here from k join n using (snapshot_id) where kinds = 1 and c = n group by snapshot_id),
t as (select n.snapshot_id, array_to_string(string_split(one, '/')[:i], '/') as x from n, range(0, 5) r(i) where i < len(string_split(one, '/'))),
begins as (select snapshot_id, x from t join d using (snapshot_id) group by all having bool_and(starts_with(own, x)))
select snapshot_id, array_to_string(here, '/') as common, array_to_string(here[:greatest(1, len(here) - 1)], '/') as above, max_by(x, length(x)) as textual from deep join begins using (snapshot_id) group by snapshot_id, here""")
def common_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories that brands share, each by itself and by their names' first seven letters."""
    paths = _load(spark, sf_dir).modules.select(top_level(F.col("path")).alias("brand"), F.concat(F.lit("src/main/"), "path").alias("path"))
    families = paths.select(F.concat(F.substring("brand", 1, 7), F.lit("*")).alias("snapshot_id"), "path")
    return rollup.common_roots(paths.withColumnRenamed("brand", "snapshot_id").unionByName(families))


@query("""
with p as (select l_orderkey, p_brand as b, p_brand || '/' || p_type as d from lineitem join part on p_partkey = l_partkey)
select l_orderkey, case when count(distinct d) = 1 then min(d) when count(distinct b) = 1 then min(b) else '' end as ancestor from p group by l_orderkey""")
def order_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory that holds all parts of an order; an order has a handful of lines."""
    modules = _load(spark, sf_dir).modules.select(F.col("id").alias("l_partkey"), "path")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    return lines.join(modules, "l_partkey").groupBy("l_orderkey").agg(common_ancestor(F.collect_set("path")).alias("ancestor"))


@query("""
select p_partkey as id, replace(lower(p_name), ' ', '_') as snake, case when p_size <= 1 then 'trivial' when p_size <= 5 then 'small' when p_size <= 20 then 'medium' when p_size <= 50 then 'large' else 'very large' end as effort,
       p_type || '/P' || p_partkey as stripped, p_type || ': P' || p_partkey as below, 'P' || p_partkey as here, p_brand || '/' || p_type || ': P' || p_partkey as elsewhere from part""")
def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and places of the files as reports write them."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = F.concat_ws("/", "p_brand", "p_type", F.concat(F.lit("P"), F.col("p_partkey").cast("string")))
    brand, directory = F.col("p_brand"), F.concat_ws("/", "p_brand", "p_type")
    return parts.select(F.col("p_partkey").alias("id"), camel_to_snake(F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).alias("snake"), effort(F.col("p_size")).alias("effort"), strip_prefix(path, brand).alias("stripped"), relative_label(path, brand).alias("below"), relative_label(path, directory).alias("here"), relative_label(path, F.lit("no/such")).alias("elsewhere"))


@query(_sql_graph(by_year=True) + """
, told_hops as (select snapshot_id, parent, path, unnest(path[:-2]) as dir_a, unnest(path[2:]) as dir_b, generate_subscripts(path[:-2], 1) - 1 as n from closed),
h as (select snapshot_id, parent, dir_a || '>' || dir_b || '>' || dir_a as cycle_path, 0 as n, one_ab[1] as f, one_ab[2] as t, ab as c from circ
      union all select snapshot_id, parent, dir_a || '>' || dir_b || '>' || dir_a, 1, one_ba[1], one_ba[2], ba from circ
      union all select snapshot_id, parent, list_aggregate(path, 'string_agg', '>'), n, one[1], one[2], weight from told_hops join pairs using (snapshot_id, parent, dir_a, dir_b)),
placed as (select *, k as depth, array_to_string(string_split(f, '/')[:k], '/') as x, array_to_string(string_split(t, '/')[:k], '/') as y, case when k = 1 then '' else split_part(f, '/', 1) end as directory from h, range(1, 3) r(k) where k = 1 or split_part(f, '/', 1) = split_part(t, '/', 1)),
w as (select *, row_number() over (partition by snapshot_id, depth, directory, parent, cycle_path order by c, n) = 1 as weakest from placed where x <> y)
select snapshot_id, cast(depth as bigint) as depth, directory, cycle_path, string_agg(x || '>' || y || ':' || c || case when weakest then '*' else '' end, ',' order by n) as hops from w group by snapshot_id, depth, directory, parent, cycle_path having count(*) >= 2""")
def level_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, v = _raw(spark, sf_dir, by_year=True)
    hop = F.transform("hops", lambda h: F.concat(h["from"], F.lit(">"), h["to"], F.lit(":"), h["imports"].cast("string"), F.when(h["weakest"], "*").otherwise("")))
    levels = (rollup.level_cycles(v, k).select("snapshot_id", F.lit(k).cast("long").alias("depth"), "directory", F.array_join("cycle_path", ">").alias("cycle_path"), F.array_join(hop, ",").alias("hops")) for k in (1, 2))
    return reduce(DataFrame.unionByName, levels)


@query(_sql_graph() + """
, r as (select parent, dir_a, dir_b, severity, row_number() over (partition by parent order by severity desc, dir_a, dir_b) as place from risk where not is_circular)
select parent, dir_a, dir_b, severity, cast(place as bigint) as place, place <= 5 as promoted from r""")
def promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(rollup.promoted(_audit(spark, sf_dir).violations).drop("snapshot_id"), "place")


@query(_sql_graph(by_year=True) + """
, c as (select snapshot_id, dir_a, dir_b from risk where is_circular), b as (select c.*, (select count(*) from c x where x.snapshot_id = c.snapshot_id and x.dir_a = c.dir_a and x.dir_b = c.dir_b) as there,
      (select count(*) from c x where x.snapshot_id = c.snapshot_id and x.dir_a = c.dir_b and x.dir_b = c.dir_a) as back from c)
select snapshot_id, dir_a, dir_b, case when there < back then dir_a when there > back then dir_b end as wrong_from, case when there < back then dir_b when there > back then dir_a end as wrong_to from b""")
def direction_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.direction_hints(_audit(spark, sf_dir, by_year=True).violations)


@query(_sql_graph(by_year=True) + """
select snapshot_id, cast(count(is_circular) as bigint) as violations, cast(count(*) filter (is_circular) as bigint) as circular, cast(count(*) filter (not is_circular) as bigint) as coupled, cast(count(*) filter (severity >= 0.5) as bigint) as critical
from n_mods left join risk using (snapshot_id) group by snapshot_id""")
def violation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _audit(spark, sf_dir, by_year=True)
    return rollup.violation_types(a.violations, a.graph.modules)


@query(_sql_graph() + _ACTIONS + """
, v as (select split_part(dir_a, '/', 1) as module, sum(severity) as s from risk group by 1), n as (select brand as module, count(*) as n from mods group by 1),
whole as (select sum(n * greatest(0.0e0, 100.0e0 * (1.0e0 - coalesce(s, 0) / n))) / sum(n) as score, sum(n) as files from n left join v using (module)),
gain as (select coalesce(sum(impact), 0.0e0) as g from (select act.impact from act where category <> 'hotspot' order by act.impact desc limit 3))
select round(score, 6) as score, cast(files as bigint) as files, round(greatest(score, least(100.0e0, score + g)), 6) as projected from whole, gain""")
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _stored_audit(spark, sf_dir)
    card = rollup.scorecard(a.graph.modules, a.violations, metrics.independence(a.edges, a.graph.modules), a.fans())
    return _rounded(actions.projected(rollup.weighted_score(card), _actions(a)).drop("snapshot_id"), "score", "projected")
