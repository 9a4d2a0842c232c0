"""Named queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import components, detect, index, metrics, moves
from ..operators.graph import Graph
from ..sources import edgelist, generate, views
from ..sources.levels import LevelStore
from ..storage import materialize

#: Rounds that ``local_move_k_rounds`` runs, and its active fraction.
ROUNDS, PARTS = 2, 2

E = views.COPURCHASE_SQL
A = f"(select src, dst, w from {E} union all select dst, src, w from {E})"
N = f"(select unnest(range(0, (select max(greatest(src, dst)) + 1 from {E}))) as v)"
K = f"(select src as v, sum(w)::bigint as k, count(*) as deg from {A} group by src)"
V = f"(select v, coalesce(k, 0) as k, coalesce(deg, 0) as deg from {N} left join {K} using (v))"
P = "(select p_partkey as v, p_size::bigint as c from part)"
B = "(select p_partkey as v, dense_rank() over (order by p_brand) - 1 as c from part)"


def copurchases(spark: SparkSession, sf_dir: str, least: int = 1) -> Graph:
    """All pairs of parts of one order (``least``: bought together so often), joined once and stored."""
    return Graph(materialize(views.part_copurchase(spark, sf_dir, least), "copurchases"))


def by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"), F.col("p_size").cast("long").alias("c"))


def by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part")
    brands = part.select("p_brand").distinct().withColumn("c", (F.row_number().over(Window.orderBy("p_brand")) - 1).cast("long"))
    return part.join(F.broadcast(brands), "p_brand").select(F.col("p_partkey").alias("v"), "c")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return keep


@query(f"""select count(*) as nodes, (sum(deg) // 2)::bigint as edges, round(sum(deg)::double / count(*), 9) as avg_degree,
  max(deg) as max_degree, sum((deg = 0)::bigint)::bigint as isolated, round(sum(k)::double / 2, 9) as total_weight from {V}""")
def graph_summary(spark, sf_dir):
    return copurchases(spark, sf_dir).summary()


@query(f"select v, deg from {V}")
def degree_distribution(spark, sf_dir):
    return copurchases(spark, sf_dir).vertices.select("v", "deg")


@query(f"""select b::bigint as bucket, (case when b = 0 then 0 else 2 ** (b - 1) end)::bigint as low, count(*) as n
  from (select case when deg = 0 then 0 else len(bin(deg)) end as b from {V}) group by b""")
def degree_log2_histogram(spark, sf_dir):
    return copurchases(spark, sf_dir).log2_histogram()


@query(f"select v, k::bigint as k from {V}")
def weighted_degree(spark, sf_dir):
    return copurchases(spark, sf_dir).vertices.select("v", "k")


@query(f"""select bytes::bigint as bytes, round(bytes::double / m, 9) as bytes_per_edge, round(bytes::double / (2 * m), 9) as bytes_per_slot
  from (select 8 * (n + 1) + 24 * m + 8 * n as bytes, m from (select count(*) as n, (sum(deg) // 2)::bigint as m from {V}))""")
def memory_model(spark, sf_dir):
    return copurchases(spark, sf_dir).memory_model()


@query(f"select v, (sum(deg) over (order by v) - deg)::bigint as start from {V}")
def adjacency_offsets(spark, sf_dir):
    return copurchases(spark, sf_dir).offsets()


LINES = """(select case when l_linenumber = 1 then '# ' || l_orderkey when l_linenumber = 2 then l_partkey::varchar
  when l_linenumber = 3 then l_partkey || ' ' || l_partkey when l_linenumber = 4 then l_partkey || chr(9) || l_suppkey || '  2.5 x'
  when l_linenumber = 5 then 'x ' || l_suppkey else '  ' || l_partkey || '   ' || l_suppkey end as value from lineitem)"""


@query(f"""select src, dst, coalesce(try_cast(w as double), 1.0) as w, count(*) as n from (
  select p[1]::bigint as src, p[2]::bigint as dst, p[3] as w from (
    select string_split(trim(regexp_replace(value, '\\s+', ' ', 'g')), ' ') as p from {LINES} where not regexp_matches(value, '^[#%]'))
  where len(p) >= 2 and regexp_full_match(p[1], '[0-9]{{1,18}}') and regexp_full_match(p[2], '[0-9]{{1,18}}')) where src <> dst group by all""")
def edge_text_parse(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    part, supp, n = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber")
    value = (
        F.when(n == 1, F.concat(F.lit("# "), F.col("l_orderkey").cast("string")))
        .when(n == 2, part)
        .when(n == 3, F.concat(part, F.lit(" "), part))
        .when(n == 4, F.concat(part, F.lit("\t"), supp, F.lit("  2.5 x")))
        .when(n == 5, F.concat(F.lit("x "), supp))
        .otherwise(F.concat(F.lit("  "), part, F.lit("   "), supp))
    )
    edges = edgelist.parse_edge_lines(li.select(value.alias("value")), weighted=True)
    return edges.groupBy("src", "dst", "w").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with e as {views.PAGE_LINKS_SQL}, d as (select name, row_number() over (order by name) - 1 as id
    from (select src as name from e union select dst from e))
  select a.id as src, b.id as dst, w from e join d a on a.name = e.src join d b on b.name = e.dst""")
def id_remap(spark, sf_dir):
    return edgelist.remap_ids(views.page_links(spark, sf_dir))[0]


@query(f"select least(src, dst) as src, greatest(src, dst) as dst, sum(w)::bigint as w from {views.SUCCESSION_SQL} group by all")
def simplify_multigraph(spark, sf_dir):
    return Graph(views.event_succession(spark, sf_dir)).simplify()


@query(f"select src, dst, w from {views.NATION_TRADE_SQL}")
def nation_trade_edges(spark, sf_dir):
    return views.nation_trade(spark, sf_dir)


CC = f"""recursive a as materialized {A},
r(v, root) using key (v) as (select v, v from {N}
  union select a.dst, min(r.root) from r join a on a.src = r.v join recurring.r q on q.v = a.dst where r.root < q.root group by a.dst)"""


@query(f"with {CC} select v, root from r")
def connected_components(spark, sf_dir):
    g = copurchases(spark, sf_dir)
    return components.connected_components(g.vertices, g.edges)


@query(f"with {CC} select root, count(*) as size from r group by root")
def component_sizes(spark, sf_dir):
    return connected_components(spark, sf_dir).groupBy("root").agg(F.count(F.lit(1)).alias("size"))


def pairs(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("u"), (F.col("p_partkey") * 7 + 3).alias("v"))


PAIRS = "(select p_partkey as u, p_partkey * 7 + 3 as v from part)"


@query(f"with {CC} select p.u, p.v, a.root = b.root as connected from {PAIRS} p left join r a on a.v = p.u left join r b on b.v = p.v")
def reachability_pairs(spark, sf_dir):
    g = copurchases(spark, sf_dir)
    return index.CommunityIndex(g, by_size(spark, sf_dir)).connected(pairs(spark, sf_dir))


@query(f"select p.u, p.v, a.c = b.c as same from {PAIRS} p left join {P} a on a.v = p.u left join {P} b on b.v = p.v")
def same_community_pairs(spark, sf_dir):
    g = copurchases(spark, sf_dir)
    return index.CommunityIndex(g, by_size(spark, sf_dir)).same_community(pairs(spark, sf_dir))


MORE = f"(select v as src, v + 1 as dst from {N} where v % 10 = 0 and v + 1 < (select count(*) from {N}))"


@query(f"""with recursive a as materialized (select src, dst from {A} union all select src, dst from {MORE} union all select dst, src from {MORE}),
r(v, root) using key (v) as (select v, v from {N}
  union select a.dst, min(r.root) from r join a on a.src = r.v join recurring.r q on q.v = a.dst where r.root < q.root group by a.dst)
select v, root from r""")
def add_edges_components(spark, sf_dir):
    g = copurchases(spark, sf_dir)
    more = g.vertices.filter("v % 10 = 0").select(F.col("v").alias("src"), (F.col("v") + 1).alias("dst")).filter(F.col("dst") < g.n)
    return index.add_edges(components.connected_components(g.vertices, g.edges), more)


MOD = f"""select c, sum(i) as i, sum(t) as t from (
  select x.c, case when x.c = y.c then w else 0 end as i, w as t from {A} a join {P} x on x.v = a.src join {P} y on y.v = a.dst) group by c"""


@query(f"""select round(sum(i::double / m - (t::double / m) * (t::double / m)), 9) as modularity
  from ({MOD}), (select sum(w) as m from {A})""")
def modularity_fixed_partition(spark, sf_dir):
    return metrics.modularity(copurchases(spark, sf_dir), by_size(spark, sf_dir))


@query(f"""select c, i::bigint as inside, t::bigint as total, round(i::double / m - (t::double / m) * (t::double / m), 9) as part
  from ({MOD}), (select sum(w) as m from {A})""")
def modularity_per_community(spark, sf_dir):
    sums = metrics.community_sums(copurchases(spark, sf_dir), by_size(spark, sf_dir))
    return sums.select("c", "inside", "total", F.round("part", 9).alias("part"))


@query("""with e as %s, a as (select src, dst, w from e union all select dst, src, w from e), p as (select n_nationkey as v, n_regionkey as c from nation)
  select round(sum(i::double / m - (t::double / m) * (t::double / m)), 9) as modularity from (
    select x.c, sum(case when x.c = y.c then w else 0 end) as i, sum(w) as t from a join p x on x.v = src join p y on y.v = dst group by x.c),
  (select sum(w) as m from a)""" % views.NATION_TRADE_SQL)
def modularity_nation_trade(spark, sf_dir):
    nation = views.table(spark, sf_dir, "nation")
    regions = nation.select(F.col("n_nationkey").cast("long").alias("v"), F.col("n_regionkey").cast("long").alias("c"))
    return metrics.modularity(Graph(views.nation_trade(spark, sf_dir)), regions)


J = f"(select a.c as a, b.c as b, count(*) as n from {P} a join {B} b using (v) group by all)"


@query(f"""with j as {J}, t as (select sum(n)::double as t from j),
  x as (select -sum(n / t * ln(n / t)) as h from (select a, sum(n) as n from j group by a), t),
  y as (select -sum(n / t * ln(n / t)) as h from (select b, sum(n) as n from j group by b), t),
  z as (select -sum(n / t * ln(n / t)) as h from j, t)
  select round(greatest(0, (x.h + y.h - z.h) / sqrt(x.h * y.h)), 9) as nmi from x, y, z""")
def nmi_two_partitions(spark, sf_dir):
    return metrics.nmi(by_size(spark, sf_dir), by_brand(spark, sf_dir))


@query(f"select a, b, n from {J} union all select a, null, sum(n)::bigint from {J} group by a union all select null, b, sum(n)::bigint from {J} group by b")
def contingency_table(spark, sf_dir):
    return metrics.contingency(by_size(spark, sf_dir), by_brand(spark, sf_dir)).select("a", "b", "n")


@query(f"select round(-sum(n / t * ln(n / t)), 9) as entropy from (select count(*)::double as n from {P} group by c), (select count(*)::double as t from {P})")
def entropy(spark, sf_dir):
    return metrics.entropy(by_size(spark, sf_dir))


@query(f"select count(distinct c) as communities from {P}")
def community_count(spark, sf_dir):
    return by_size(spark, sf_dir).agg(F.countDistinct("c").alias("communities"))


@query(f"select least(x.c, y.c) as src, greatest(x.c, y.c) as dst, sum(w)::bigint as w from {E} e join {P} x on x.v = src join {P} y on y.v = dst group by all")
def coarsen_partition(spark, sf_dir):
    return moves.coarsen(copurchases(spark, sf_dir).edges, by_size(spark, sf_dir))


@query(f"select v, id as c from {P} join (select c, row_number() over (order by min(v)) - 1 as id from {P} group by c) using (c)")
def renumber_canonical(spark, sf_dir):
    return moves.renumber(by_size(spark, sf_dir))


@query(f"select src as v, c, sum(w)::bigint as k_in from {A} a join {P} p on p.v = a.dst where src <> dst group by all")
def neighbor_community_weights(spark, sf_dir):
    return moves.neighbor_weights(copurchases(spark, sf_dir).adj, by_size(spark, sf_dir))


def gains_sql(p: str, a: str = "a", k: str = "k") -> str:
    return f"""select o.v, o.c, o.c = h.c as own,
      ((select sum(k) from {k}) * o.k_in - (t.total - case when o.c = h.c then d.k else 0 end) * d.k)::bigint as gain
    from (select v, c, sum(k_in) as k_in from (
        select src as v, c, sum(w) as k_in from {a} join {p} q on q.v = dst where src <> dst group by all
        union all select v, c, 0 from {p} join {k} using (v)) group by all) o
    join {p} h on h.v = o.v join {k} d on d.v = o.v
    join (select c, sum(k) as total from {p} join {k} using (v) group by c) t on t.c = o.c"""


AK = f"a as materialized {A}, k as materialized (select src as v, sum(w)::bigint as k from a group by src), p0 as materialized {P}"


def best_sql(p: str) -> str:
    return f"""select v, c, own as stay, gain from ({gains_sql(p)})
      qualify row_number() over (partition by v order by gain desc, own desc, c) = 1"""


@query(f"with {AK} {gains_sql('p0')}")
def move_gains(spark, sf_dir):
    return moves.move_gains(copurchases(spark, sf_dir).adj, by_size(spark, sf_dir))


@query(f"with {AK} {best_sql('p0')}")
def best_move(spark, sf_dir):
    return moves.best_moves(moves.move_gains(copurchases(spark, sf_dir).adj, by_size(spark, sf_dir)))


def rounds_sql() -> str:
    steps = []
    for i in range(ROUNDS):
        steps.append(f"""p{i + 1} as materialized (select p.v, coalesce(b.c, p.c) as c from p{i} p left join (
          select v, c from ({best_sql(f'p{i}')}) where not stay
            and (((v % 1073741824) * 2654435761 + {i * 40503}) % 4294967296 // 65536) % {PARTS} = 0) b on b.v = p.v)""")
    return f"with {AK}, {', '.join(steps)} select v, c from p{ROUNDS}"


@query(rounds_sql())
def local_move_k_rounds(spark, sf_dir):
    adj, now = copurchases(spark, sf_dir).adj, by_size(spark, sf_dir)
    for turn in range(ROUNDS):
        now = moves.move_round(adj, now, turn, PARTS)
    return now


PIECES = f"""recursive i as materialized (select src, dst from {A} a join {P} x on x.v = src join {P} y on y.v = dst where x.c = y.c),
r(v, root) using key (v) as (select v, v from {P}
  union select i.dst, min(r.root) from r join i on i.src = r.v join recurring.r q on q.v = i.dst where r.root < q.root group by i.dst)"""


@query(f"with {PIECES} select v, dense_rank() over (order by root) - 1 as c from r")
def enforce_connectivity(spark, sf_dir):
    return moves.enforce_connectivity(copurchases(spark, sf_dir), by_size(spark, sf_dir))


@query(f"with {PIECES} select count(*) as splits from (select c from r join {P} p using (v) group by c having count(distinct root) > 1)")
def connectivity_splits(spark, sf_dir):
    return moves.connectivity_splits(copurchases(spark, sf_dir), by_size(spark, sf_dir))


@query(f"""with {AK}, t as (select c, sum(k) as total from p0 join k using (v) group by c),
  e as (select src as v, sum(w) as e from a join p0 x on x.v = src join p0 y on y.v = dst where x.c = y.c and src <> dst group by src)
  select k.v, coalesce(e.e, 0)::double * (select sum(k) from k) >= 0.05::double * k * (total - k) as ok
  from k join p0 using (v) join t using (c) left join e on e.v = k.v""")
def refine_wellconnected_vertices(spark, sf_dir):
    return moves.well_connected_vertices(copurchases(spark, sf_dir), by_size(spark, sf_dir))


@query(f"""with {AK}, q as (select v, c as p, c * 4 + v % 4 as r from p0),
  t as (select p, sum(k) as total from q join k using (v) group by p), s as (select p, r, sum(k) as k from q join k using (v) group by p, r),
  e as (select x.r, sum(w) as e from a join q x on x.v = src join q y on y.v = dst where x.p = y.p and x.r <> y.r group by x.r)
  select s.r, coalesce(e.e, 0)::double * (select sum(k) from k) >= 0.05::double * s.k * (total - s.k) as ok
  from s join t using (p) left join e on e.r = s.r""")
def refine_wellconnected_subcommunities(spark, sf_dir):
    parents = by_size(spark, sf_dir)
    parts = parents.select("v", (F.col("c") * 4 + F.col("v") % 4).alias("c"))
    return moves.well_connected_subcommunities(copurchases(spark, sf_dir), parents, parts)


def fixed_hierarchy(spark, sf_dir):
    """Three nested levels of the parts: by 8, 64 and 512 ids."""
    part = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"))
    levels = [part.select(F.lit(i).alias("level"), "v", F.floor(F.col("v") / 8 ** (i + 1)).alias("c")) for i in range(3)]
    return levels[0].union(levels[1]).union(levels[2])


H = "(select level::int as level, p_partkey as v, (p_partkey // (8 ** (level + 1))::bigint)::bigint as c from part, range(3) t(level))"


@query(f"select distinct a.level, a.c as child, b.c as parent from {H} a join {H} b on a.v = b.v and b.level = a.level + 1")
def hierarchy_dag(spark, sf_dir):
    return index.hierarchy_dag(fixed_hierarchy(spark, sf_dir))


@query(f"select level, child, count(*) as parents from (select distinct a.level, a.c as child, b.c as parent from {H} a join {H} b on a.v = b.v and b.level = a.level + 1) group by all")
def hierarchy_single_parent_check(spark, sf_dir):
    return index.parents_per_child(fixed_hierarchy(spark, sf_dir))


@query(f"""with recursive d as materialized (select distinct a.c * 3 + a.level as src, b.c * 3 + b.level as dst from {H} a join {H} b on a.v = b.v and b.level = a.level + 1),
  r as (select src as node, 0::bigint as level from d where src not in (select dst from d) union select d.dst, r.level + 1 from r join d on d.src = r.node)
  select node, max(level) as level from r group by node""")
def topo_levels(spark, sf_dir):
    dag = index.hierarchy_dag(fixed_hierarchy(spark, sf_dir))
    arcs = dag.select((F.col("child") * 3 + F.col("level")).alias("src"), (F.col("parent") * 3 + F.col("level") + 1).alias("dst"))
    return index.topo_levels(arcs)


@query(f"select v, c from {H} where level = 1")
def community_at_level(spark, sf_dir):
    questions = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"))
    stored = LevelStore.save(fixed_hierarchy(spark, sf_dir))
    found = index.CommunityIndex(copurchases(spark, sf_dir), by_size(spark, sf_dir), stored.table())
    return found.community_at_level(questions, 1)


@query(f"select c, count(*) as size from {P} group by c order by size desc, c limit 10")
def top_communities(spark, sf_dir):
    return by_size(spark, sf_dir).groupBy("c").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "c").limit(10)


@query(f"""with recursive k as materialized (select p_partkey as v from part where p_size <= 25),
  a as materialized (select src, dst from {A} where src in (select v from k) and dst in (select v from k)),
  r(v, root) using key (v) as (select v, v from k
  union select a.dst, min(r.root) from r join a on a.src = r.v join recurring.r q on q.v = a.dst where r.root < q.root group by a.dst)
  select v, root from r""")
def filtered_subgraph_components(spark, sf_dir):
    kept = views.table(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("v"))
    edges = copurchases(spark, sf_dir).edges
    inner = edges.join(kept.withColumnRenamed("v", "src"), "src", "left_semi").join(kept.withColumnRenamed("v", "dst"), "dst", "left_semi")
    return components.connected_components(kept, inner)


@query()
def louvain_communities(spark, sf_dir):
    return detect.last_level(detect.louvain(copurchases(spark, sf_dir)))


@query()
def louvain_hierarchy(spark, sf_dir):
    return detect.louvain(copurchases(spark, sf_dir))


@query()
def leiden_communities(spark, sf_dir):
    return detect.last_level(detect.leiden(copurchases(spark, sf_dir)))


#: Rounds from single vertices whose modularity a detected hierarchy must reach.
BOUND_ROUNDS = 6


def bound_sql(a: str) -> str:
    """CTEs up to ``p{BOUND_ROUNDS}``: the partition after rounds from single vertices of the graph with both directions ``a``."""
    steps = [f"a as materialized {a}, k as materialized (select src as v, sum(w)::bigint as k from a group by src), p0 as (select v, v as c from k)"]
    for i in range(BOUND_ROUNDS):
        steps.append(f"""p{i + 1} as materialized (select p.v, coalesce(b.c, p.c) as c from p{i} p left join (
          select v, c from ({best_sql(f'p{i}')}) where not stay
            and (((v % 1073741824) * 2654435761 + {i * 40503}) % 4294967296 // 65536) % {PARTS} = 0) b on b.v = p.v)""")
    return ", ".join(steps)


def bound(graph: Graph) -> DataFrame:
    """One row ``bound``: the modularity after those rounds, each stored."""
    now = graph.vertices.filter("deg > 0").select("v", F.col("v").alias("c"))
    for turn in range(BOUND_ROUNDS):
        now = materialize(moves.move_round(graph.adj, now, turn, PARTS), "bound-round")
    return metrics.modularity(graph, now).select(F.round("modularity", 6).alias("bound"))


def sound_sql(a: str, n: str, checks: str) -> str:
    last = f"p{BOUND_ROUNDS}"
    return f"""with {bound_sql(a)}
      select (select count(*) from {n}) as nodes, true as covered, true as single_parent, true as dense, {checks},
        (select round(sum(i::double / m - (t::double / m) * (t::double / m)), 6) from (
          select c, sum(i) as i, sum(t) as t from (
            select x.c, case when x.c = y.c then w else 0 end as i, w as t from a join {last} x on x.v = a.src join {last} y on y.v = a.dst) group by c),
          (select sum(w) as m from a)) as bound, true as reached"""


#: What no hierarchy of the algorithm may have: see ``louvain_faults`` and ``leiden_faults``.
LOUVAIN_CHECKS, LEIDEN_CHECKS = "0::bigint as open, 0::bigint as mergeable", "0::bigint as splits"


def level_of(hierarchy: DataFrame, level) -> DataFrame:
    return hierarchy.filter(F.col("level") == level).select("v", "c")


def louvain_faults(graph: Graph, hierarchy: DataFrame) -> DataFrame:
    """``open``: vertices that would gain by leaving their community of the first level;
    ``mergeable``: pairs of communities of the last level whose union has more modularity."""
    gains = moves.move_gains(graph.adj, level_of(hierarchy, 0).join(graph.vertices.filter("deg > 0").select("v"), "v", "left_semi"))
    free = moves.best_moves(gains).agg(F.count_if(~F.col("stay")).alias("open"))
    coarse = Graph(materialize(moves.coarsen(graph.edges, detect.last_level(hierarchy)), "last-level"))
    alone = coarse.vertices.filter("deg > 0").select("v", F.col("v").alias("c"))
    merges = moves.move_gains(coarse.adj, alone).join(moves.move_gains(coarse.adj, alone).filter("own").select("v", F.col("gain").alias("stay")), "v")
    return free.join(F.broadcast(merges.agg((F.count_if(~F.col("own") & (F.col("gain") > F.col("stay"))) / 2).cast("long").alias("mergeable"))))


def leiden_faults(graph: Graph, hierarchy: DataFrame) -> DataFrame:
    """``splits``: communities of any level, as found, that fall into pieces; all levels are one graph side by side."""
    n = graph.n
    levels = materialize(hierarchy.select("level").distinct(), "levels")
    shift = F.col("level") * n
    edges = graph.edges.join(F.broadcast(levels)).select((F.col("src") + shift).alias("src"), (F.col("dst") + shift).alias("dst"), "w")
    return moves.connectivity_splits(Graph(edges), hierarchy.select((F.col("v") + shift).alias("v"), (F.col("c") + shift).alias("c")))


def sound(graph: Graph, hierarchy: DataFrame, faults: DataFrame) -> DataFrame:
    """One row on what every hierarchy must be: each level covers all vertices once, levels nest, labels are dense,
    there are no ``faults``, and the last level reaches ``bound``."""
    n = graph.n
    per = hierarchy.groupBy("level").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("v").alias("vs"), F.countDistinct("c").alias("cs"), F.max("c").alias("top"), F.min("c").alias("low")
    )
    per = per.agg(
        F.max("vs").alias("nodes"),
        (F.min(((F.col("rows") == n) & (F.col("vs") == n)).cast("int")) == 1).alias("covered"),
        (F.min(((F.col("top") + 1 == F.col("cs")) & (F.col("low") == 0)).cast("int")) == 1).alias("dense"),
    )
    parents = index.parents_per_child(hierarchy).agg((F.coalesce(F.max("parents"), F.lit(1)) == 1).alias("single_parent"))
    score = metrics.modularity(graph, detect.last_level(hierarchy))
    out = per.join(F.broadcast(parents)).join(F.broadcast(faults)).join(F.broadcast(bound(graph))).join(F.broadcast(score))
    return out.select("nodes", "covered", "single_parent", "dense", *faults.columns, "bound", (F.col("modularity") >= F.col("bound")).alias("reached"))


@query(sound_sql(A, N, LOUVAIN_CHECKS))
def louvain_invariants(spark, sf_dir):
    graph = copurchases(spark, sf_dir)
    hierarchy = detect.louvain(graph)
    return sound(graph, hierarchy, louvain_faults(graph, hierarchy))


@query(sound_sql(A, N, LEIDEN_CHECKS))
def leiden_invariants(spark, sf_dir):
    graph = copurchases(spark, sf_dir)
    hierarchy = detect.leiden(graph)
    return sound(graph, hierarchy, leiden_faults(graph, hierarchy))


S = views.SUCCESSION_SQL
USERS = f"(select unnest(range(0, (select max(greatest(src, dst)) + 1 from {S}))) as v)"
SUCCESSIONS = f"(select src, dst, w from {S} union all select dst, src, w from {S})"


def successions(spark, sf_dir) -> Graph:
    return Graph(materialize(views.event_succession(spark, sf_dir), "successions"))


@query(sound_sql(SUCCESSIONS, USERS, LOUVAIN_CHECKS))
def louvain_rounds(spark, sf_dir):
    """Over event successions, a multigraph: both directions of a pair are parallel edges. No single task moves the last vertices in turn."""
    graph = successions(spark, sf_dir)
    hierarchy = detect.louvain(graph, tail=0)
    return sound(graph, hierarchy, louvain_faults(graph, hierarchy))


@query(sound_sql(SUCCESSIONS, USERS, LEIDEN_CHECKS))
def leiden_rounds(spark, sf_dir):
    """Over event successions, with refinement on every level. No single task moves the last vertices in turn."""
    graph = successions(spark, sf_dir)
    hierarchy = detect.leiden(graph, tail=0)
    return sound(graph, hierarchy, leiden_faults(graph, hierarchy))


BIPARTITE = """(select distinct o_custkey as src, l_suppkey + (select max(c_custkey) + 1 from customer) as dst, 1::bigint as w
  from lineitem join orders on l_orderkey = o_orderkey)"""


@query(f"""select src as v, count(*) as deg, sum(w)::bigint as k
  from (select src, dst, w from {BIPARTITE} union all select dst, src, w from {BIPARTITE}) group by src""")
def customer_supplier_degrees(spark, sf_dir):
    return Graph(views.customer_supplier(spark, sf_dir)).vertices.filter("deg > 0").select("v", "deg", "k")


@query(f"select count(*)::bigint as nodes, count(distinct c) as communities, (select min(n) from (select count(*) as n from {P} group by c)) as smallest, (select max(n) from (select count(*) as n from {P} group by c)) as largest from {P}")
def community_size_summary(spark, sf_dir):
    return edgelist.size_summary(by_size(spark, sf_dir))


@query()
def lfr_generate(spark, sf_dir):
    return generate.lfr_graph(spark)[0]


@query()
def community_report(spark, sf_dir, least: int = 1):
    """One row: algorithm, nodes, edges, communities, splits, modularity, and the index's answers about two vertices."""
    graph = copurchases(spark, sf_dir, least)
    hierarchy = detect.leiden(graph)
    found = detect.last_level(hierarchy)
    repaired = materialize(moves.enforce_connectivity(graph, found), "repaired")
    demo = index.CommunityIndex(graph, repaired, hierarchy).demo()
    return (
        graph.summary()
        .select(F.lit("leiden").alias("algo"), "nodes", "edges")
        .join(F.broadcast(repaired.agg(F.countDistinct("c").alias("communities"))))
        .join(F.broadcast(moves.connectivity_splits(graph, found)))
        .join(F.broadcast(metrics.modularity(graph, repaired)))
        .join(F.broadcast(demo), F.lit(True), "left")
    )
