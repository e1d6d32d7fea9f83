"""DuckDB SQL for the queries of this package, put together from named steps."""

from __future__ import annotations

import numpy as np

from netloom.functions.dist import critical_r, normal_quantile


def six(x: str) -> str:
    return f"CASE WHEN round({x}, 6) = 0 THEN 0.0 ELSE round({x}, 6) END"


CELLS = """
cells AS (
  SELECT l_returnflag AS net, strftime(l_shipdate, '%Y-%m') AS sample, p_brand AS region, sum(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
ACT = (
    CELLS
    + """,
act AS (
  SELECT s.net, s.sample, r.region, coalesce(c.value, 0.0) AS value
  FROM (SELECT DISTINCT net, sample FROM cells) s CROSS JOIN (SELECT DISTINCT region FROM cells) r
  LEFT JOIN cells c ON s.net = c.net AND s.sample = c.sample AND r.region = c.region)"""
)


def corr(source: str = "act", name: str = "edges") -> str:
    return f"""
{name} AS (
  SELECT a.net, a.region AS src, b.region AS dst,
         covar_samp(a.value, b.value) / nullif(stddev_samp(a.value) * stddev_samp(b.value), 0) AS r, count(*) AS n
  FROM {source} a JOIN {source} b ON a.net = b.net AND a.sample = b.sample AND a.region < b.region GROUP BY ALL)"""


EDGES = ACT + "," + corr()
NODES = """
nodes AS (SELECT a.net, b.region AS node FROM (SELECT DISTINCT net FROM cells) a CROSS JOIN (SELECT DISTINCT region FROM cells) b),
memb AS (SELECT net, node, CAST(substr(node, 7, 1) AS INTEGER) AS comm FROM nodes)"""
HALF = """
g AS (SELECT net, src, dst, r AS weight FROM edges WHERE abs(r) > 0.2),
half AS (SELECT net, src AS node, dst AS other, weight FROM g UNION ALL SELECT net, dst, src, weight FROM g),
sizes AS (SELECT net, count(*) AS n_nodes FROM nodes GROUP BY net)"""
GRAPH = EDGES + "," + NODES + "," + HALF
TREE = """
tree AS (
  SELECT CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 'root' AS region
  UNION ALL SELECT r_regionkey + 1, 0, r_name FROM region
  UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, n_name FROM nation
  UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100, s_name FROM supplier),
up(id, ancestor_id, depth) AS (
  SELECT id, id, 0 FROM tree
  UNION ALL SELECT up.id, t.parent_id, up.depth + 1 FROM up JOIN tree t ON up.ancestor_id = t.id WHERE t.parent_id IS NOT NULL),
counts AS (
  SELECT l_returnflag AS net, l_linestatus AS sample, CAST(l_suppkey + 1000 AS BIGINT) AS id, sum(l_quantity) AS value
  FROM lineitem GROUP BY ALL)"""
PARTITIONS = """
parts AS (
  SELECT 'brands' AS net, part, node,
         CAST((num * part + part * part) % (2 + part % 3) AS INTEGER) AS comm
  FROM (SELECT DISTINCT p_brand AS node, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) AS num FROM part)
  CROSS JOIN (SELECT unnest(range(1, 7)) AS part))"""


def sql(steps: str, body: str) -> str:
    return f"WITH RECURSIVE {steps}\n{body}" if "up(id" in steps else f"WITH {steps}\n{body}"


SIGNED = """
pq AS (
  SELECT n.net, n.node, coalesce(sum(greatest(weight, 0.0)), 0.0) AS p, coalesce(sum(greatest(-weight, 0.0)), 0.0) AS q, any_value(n_nodes) AS nn
  FROM nodes n JOIN sizes USING (net) LEFT JOIN half h ON n.net = h.net AND n.node = h.node GROUP BY n.net, n.node),
signed AS (
  SELECT net, node, p / (nn - 1) AS s_pos, q / (nn - 1) AS s_neg,
         coalesce(p / (nn - 1) - q / nullif(p + q, 0) * (q / (nn - 1)), 0.0) AS s_asym,
         coalesce((p - q) / nullif(p + q, 0), 0.0) AS s_sym
  FROM pq)"""
QPARTS = """
hm AS (
  SELECT h.net, a.comm AS c1, b.comm AS c2, abs(weight) AS w, weight > 0 AS pos
  FROM half h JOIN memb a ON h.net = a.net AND h.node = a.node JOIN memb b ON h.net = b.net AND h.other = b.node),
qc AS (SELECT net, pos, c1, sum(w) AS k, sum(CASE WHEN c1 = c2 THEN w ELSE 0 END) AS wc FROM hm GROUP BY ALL),
qs AS (SELECT net, pos, sum(k) AS v, sum(wc) / nullif(sum(k), 0) - sum(k * k) / nullif(sum(k) * sum(k), 0) AS q FROM qc GROUP BY ALL),
qsig AS (
  SELECT n.net, coalesce(p.q, 0.0) - coalesce(coalesce(m.v, 0.0) / nullif(coalesce(p.v, 0.0) + coalesce(m.v, 0.0), 0), 0.0) * coalesce(m.q, 0.0) AS q_signed
  FROM (SELECT DISTINCT net FROM nodes) n LEFT JOIN qs p ON n.net = p.net AND p.pos LEFT JOIN qs m ON n.net = m.net AND NOT m.pos)"""
BYCOMM = """
bc AS (
  SELECT h.net, h.node, comm, sum(greatest(weight, 0.0)) AS p, sum(greatest(-weight, 0.0)) AS q
  FROM half h JOIN memb m ON h.net = m.net AND h.other = m.node GROUP BY ALL),
bt AS (SELECT net, node, sum(p) AS sp, sum(q) AS sq, sum(p * p) AS p2, sum(q * q) AS q2 FROM bc GROUP BY ALL)"""
COMPONENTS = """
reach(net, node, seen) AS (
  SELECT net, node, node FROM nodes UNION SELECT r.net, r.node, h.other FROM reach r JOIN half h ON r.net = h.net AND r.seen = h.node),
comp AS (SELECT net, node, min(seen) AS component FROM reach GROUP BY ALL)"""


def _signed_out(name: str, a: str, b: str) -> str:
    return f"""
SELECT net, node, {six("a")} AS {name}_pos, {six("b")} AS {name}_neg,
       {six("a - coalesce(sq / nullif(sp + sq, 0), 0.0) * b")} AS {name}_signed
FROM (SELECT m.net, m.node, coalesce({a}, 0.0) AS a, coalesce({b}, 0.0) AS b, coalesce(sp, 0.0) AS sp, coalesce(sq, 0.0) AS sq
      FROM memb m LEFT JOIN x ON m.net = x.net AND m.node = x.node)"""


def _gateway(sign: str, comp: str) -> str:
    s = sign
    return f"""
h{s} AS (SELECT net, node, other, abs(weight) AS w FROM half WHERE weight {comp} 0),
c{s} AS (SELECT net, node, sum(w) AS cent FROM h{s} GROUP BY ALL),
k{s} AS (
  SELECT h.net, h.node, m.comm AS dest, sum(w) AS ks, sum(cent) AS cs
  FROM h{s} h JOIN memb m ON h.net = m.net AND h.other = m.node JOIN c{s} c ON h.net = c.net AND h.other = c.node GROUP BY ALL),
j{s} AS (
  SELECT k.net, m.comm, dest, sum(ks) AS kjs, any_value(z.size) AS size
  FROM k{s} k JOIN memb m USING (net, node) JOIN (SELECT net, comm, count(*) AS size FROM memb GROUP BY ALL) z ON z.net = m.net AND z.comm = m.comm GROUP BY ALL),
x{s} AS (SELECT net, max(c) AS most FROM (SELECT m.net, comm, sum(coalesce(cent, 0.0)) AS c FROM memb m LEFT JOIN c{s} USING (net, node) GROUP BY ALL) GROUP BY net),
g{s} AS (
  SELECT k.net, k.node, sum(ks) AS s, 1 - sum(ks * ks / (tot * tot) * pow(1 - coalesce(ks / nullif(CASE WHEN size <= 1 THEN 0 WHEN j.comm = k.dest THEN kjs / 2 ELSE kjs END, 0), 0.0) * coalesce(cs / nullif(most, 0), 0.0), 2)) AS gw
  FROM (SELECT *, sum(ks) OVER (PARTITION BY net, node) AS tot FROM k{s}) k JOIN memb m USING (net, node)
  JOIN j{s} j ON j.net = k.net AND j.comm = m.comm AND j.dest = k.dest JOIN x{s} x ON x.net = k.net GROUP BY ALL)"""


_LN = "CASE WHEN {0} > 0 THEN -{0} / {1} * ln({0} / {1}) ELSE 0 END"
ORACLE_SQL: dict[str, str] = {
    "brand_network_strength": sql(GRAPH + "," + SIGNED, f"SELECT net, node, {six('s_pos')} AS s_pos, {six('s_neg')} AS s_neg, {six('s_asym')} AS s_signed FROM signed"),
    "signed_strength_asym": sql(GRAPH + "," + SIGNED, f"SELECT net, node, {six('s_pos')} AS s_pos, {six('s_neg')} AS s_neg, {six('s_asym')} AS s_signed FROM signed"),
    "signed_strength_sym": sql(GRAPH + "," + SIGNED, f"SELECT net, node, {six('s_pos')} AS s_pos, {six('s_neg')} AS s_neg, {six('s_sym')} AS s_signed FROM signed"),
    "corr_pearson": sql(EDGES, f"SELECT net, src, dst, {six('r')} AS r, n FROM edges"),
    "corr_by_group": sql(
        """
act AS (
  SELECT l_returnflag || '.' || l_linestatus AS net, strftime(l_shipdate, '%Y-%m') AS sample, p_brand AS region, sum(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),"""
        + corr(),
        f"SELECT net, src, dst, {six('r')} AS r, n FROM edges",
    ),
    "corr_spearman": sql(
        ACT + ", ranked AS (SELECT net, sample, region, rank() OVER (PARTITION BY net, region ORDER BY value) + (count(*) OVER (PARTITION BY net, region, value) - 1) / 2.0 AS value FROM act)," + corr("ranked"),
        f"SELECT net, src, dst, {six('r')} AS r, n FROM edges",
    ),
    "corr_embeddings": sql(
        "act AS (SELECT CAST(label AS VARCHAR) AS net, vec_id AS sample, lpad(CAST(pos AS VARCHAR), 2, '0') AS region, CAST(embedding[pos + 1] AS DOUBLE) AS value FROM (SELECT *, unnest(range(64)) AS pos FROM embeddings))," + corr(),
        f"SELECT net, src, dst, {six('r')} AS r, n FROM edges",
    ),
    "corr_nan_policy": sql(ACT + ", holed AS (SELECT net, sample, region, CASE WHEN region = 'Brand#11' THEN 0.0 ELSE value END AS value FROM act)," + corr("holed"), f"SELECT net, src, dst, {six('coalesce(r, 0.0)')} AS r, n FROM edges"),
    "corr_weak_link": sql(ACT + ", holed AS (SELECT net, sample, region, CASE WHEN region = 'Brand#11' THEN 0.0 ELSE value END AS value FROM act)," + corr("holed"), f"SELECT net, src, dst, {six('coalesce(r, 0.001)')} AS r, n FROM edges"),
    "corr_negs_zero": sql(EDGES, f"SELECT net, src, dst, {six('greatest(r, 0.0)')} AS r, n FROM edges"),
    "corr_negs_abs": sql(EDGES, f"SELECT net, src, dst, {six('abs(r)')} AS r, n FROM edges"),
    "threshold_r": sql(EDGES, f"SELECT net, src, dst, CAST(0.2 AS DOUBLE) AS cut, {six('CASE WHEN abs(r) > 0.2 THEN r ELSE 0.0 END')} AS r, n FROM edges"),
    "threshold_grid": sql(EDGES, f"SELECT net, src, dst, cut, {six('CASE WHEN abs(r) > cut THEN r ELSE 0.0 END')} AS r, n FROM edges CROSS JOIN (SELECT CAST(unnest([0.1, 0.2, 0.3]) AS DOUBLE) AS cut)"),
    "threshold_cost": sql(
        EDGES + ", lim AS (SELECT net, cut, quantile_cont(abs(r), 0.75) AS limit_25, quantile_cont(abs(r), 0.5) AS limit_50 FROM edges CROSS JOIN (SELECT CAST(unnest([0.25, 0.5]) AS DOUBLE) AS cut) GROUP BY ALL)",
        f"SELECT e.net, src, dst, cut, {six('CASE WHEN abs(r) >= CASE WHEN cut = 0.25 THEN limit_25 ELSE limit_50 END THEN r ELSE 0.0 END')} AS r, n FROM edges e JOIN lim USING (net)",
    ),
    "norm_fisherz": sql(EDGES, f"SELECT net, src, dst, {six('atanh(r)')} AS r, n FROM edges"),
    "norm_max": sql(EDGES, f"SELECT net, src, dst, {six('r / max(r) OVER (PARTITION BY net)')} AS r, n FROM edges"),
    "norm_max_min": sql(EDGES, f"SELECT net, src, dst, {six('(r - min(r) OVER (PARTITION BY net)) / (max(r) OVER (PARTITION BY net) - min(r) OVER (PARTITION BY net))')} AS r, n FROM edges"),
    "degree": sql(GRAPH, f"SELECT n.net, n.node, {six('count(h.other) / CAST(any_value(n_nodes) - 1 AS DOUBLE)')} AS degree FROM nodes n JOIN sizes USING (net) LEFT JOIN half h ON n.net = h.net AND n.node = h.node GROUP BY n.net, n.node"),
    "strength": sql(GRAPH, f"SELECT n.net, n.node, {six('coalesce(sum(weight), 0.0)')} AS strength FROM nodes n LEFT JOIN half h ON n.net = h.net AND n.node = h.node GROUP BY n.net, n.node"),
    "leverage": sql(
        GRAPH + "," + SIGNED + ", t AS (SELECT h.net, h.node, (a.s_asym - b.s_asym) / nullif(a.s_asym + b.s_asym, 0) AS term FROM half h JOIN signed a ON h.net = a.net AND h.node = a.node JOIN signed b ON h.net = b.net AND h.other = b.node)",
        f"SELECT n.net, n.node, {six('CASE WHEN count(term) = 0 OR count(term) < count(t.net) THEN -1.0 ELSE avg(term) END')} AS leverage FROM nodes n LEFT JOIN t ON n.net = t.net AND n.node = t.node GROUP BY n.net, n.node",
    ),
    "burt": sql(
        GRAPH
        + """,
ap AS (SELECT net, node, other, abs(weight) AS w FROM half),
p AS (SELECT net, node, other, w / sum(w) OVER (PARTITION BY net, node) AS p FROM ap),
tp AS (SELECT net, node, other, sum(p) AS p FROM (
  SELECT * FROM p UNION ALL SELECT a.net, a.node, b.other, a.p * b.p FROM p a JOIN p b ON a.net = b.net AND a.other = b.node WHERE a.node <> b.other) GROUP BY ALL),
bu AS (SELECT tp.net, tp.node, sum(tp.p * tp.p) AS burt FROM tp JOIN p USING (net, node, other) GROUP BY ALL)""",
        f"SELECT n.net, n.node, {six('coalesce(burt, max(burt) OVER (PARTITION BY n.net) + 0.1)')} AS burt FROM nodes n LEFT JOIN bu ON n.net = bu.net AND n.node = bu.node",
    ),
    "transitivity_local": sql(
        GRAPH + ", tr AS (SELECT a.net, a.node, CASE WHEN g.net IS NULL THEN 0.0 ELSE 1.0 END AS t FROM half a JOIN half b ON a.net = b.net AND a.node = b.node AND a.other < b.other LEFT JOIN g ON g.net = a.net AND g.src = a.other AND g.dst = b.other)",
        f"SELECT n.net, n.node, {six('coalesce(avg(t), 0.0)')} AS transitivity FROM nodes n LEFT JOIN tr ON n.net = tr.net AND n.node = tr.node GROUP BY n.net, n.node",
    ),
    "components": "WITH RECURSIVE " + GRAPH + "," + COMPONENTS + "\nSELECT net, node, component FROM comp",
    "general_measures": "WITH RECURSIVE " + GRAPH + "," + COMPONENTS + "," + QPARTS + f"""
SELECT s.net, {six("coalesce(mean_fc, 0.0)")} AS mean_fc, gc_size, {six("gc_size * 100.0 / n_nodes")} AS gc_pct,
       {six("coalesce(m, 0) * 2.0 / (n_nodes * (n_nodes - 1))")} AS density, {six("q_signed")} AS modularity
FROM sizes s LEFT JOIN (SELECT net, avg(weight) AS mean_fc, count(*) AS m FROM g GROUP BY net) b ON s.net = b.net
JOIN (SELECT net, max(c) AS gc_size FROM (SELECT net, component, count(*) AS c FROM comp GROUP BY ALL) GROUP BY net) c ON s.net = c.net
JOIN qsig ON s.net = qsig.net""",
    "modularity_matrix": sql(
        GRAPH + ", pk AS (SELECT n.net, n.node, coalesce(sum(abs(weight)), 0.0) AS k FROM nodes n LEFT JOIN half h ON n.net = h.net AND n.node = h.node GROUP BY ALL), pv AS (SELECT net, sum(k) AS v FROM pk GROUP BY net)",
        f"SELECT a.net, a.node AS src, b.node AS dst, {six('coalesce(abs(h.weight), 0.0) - coalesce(a.k * b.k / nullif(v, 0), 0.0)')} AS b FROM pk a JOIN pk b ON a.net = b.net JOIN pv ON a.net = pv.net LEFT JOIN half h ON h.net = a.net AND h.node = a.node AND h.other = b.node",
    ),
    "modularity_q": sql(
        GRAPH + ", am AS (SELECT h.net, a.comm AS c1, b.comm AS c2, abs(weight) AS w FROM half h JOIN memb a ON h.net = a.net AND h.node = a.node JOIN memb b ON h.net = b.net AND h.other = b.node), ac AS (SELECT net, c1, sum(w) AS k, sum(CASE WHEN c1 = c2 THEN w ELSE 0 END) AS wc FROM am GROUP BY ALL)",
        f"SELECT n.net, {six('coalesce(sum(wc) / nullif(sum(k), 0) - sum(k * k) / nullif(sum(k) * sum(k), 0), 0.0)')} AS q FROM (SELECT DISTINCT net FROM nodes) n LEFT JOIN ac ON n.net = ac.net GROUP BY n.net",
    ),
    "modularity_signed": sql(GRAPH + "," + QPARTS, f"SELECT net, {six('q_signed')} AS q_signed FROM qsig"),
    "participation": sql(GRAPH + "," + BYCOMM + ", x AS (SELECT net, node, sp, sq, CASE WHEN sp > 0 THEN 1 - p2 / (sp * sp) ELSE 0 END AS a, CASE WHEN sq > 0 THEN 1 - q2 / (sq * sq) ELSE 0 END AS b FROM bt)", _signed_out("p", "x.a", "x.b")),
    "diversity": sql(
        GRAPH + "," + BYCOMM + f", x AS (SELECT bc.net, bc.node, any_value(sp) AS sp, any_value(sq) AS sq, sum({_LN.format('p', 'sp')}) / ln(any_value(m)) AS a, sum({_LN.format('q', 'sq')}) / ln(any_value(m)) AS b FROM bc JOIN bt ON bc.net = bt.net AND bc.node = bt.node JOIN (SELECT net, count(DISTINCT comm) AS m FROM memb GROUP BY net) c ON bc.net = c.net GROUP BY ALL)",
        _signed_out("h", "x.a", "x.b"),
    ),
    "gateway_str": sql(
        GRAPH + "," + _gateway("p", ">") + "," + _gateway("n", "<") + ", x AS (SELECT coalesce(gp.net, gn.net) AS net, coalesce(gp.node, gn.node) AS node, coalesce(gp.gw, 0.0) AS a, coalesce(gn.gw, 0.0) AS b, coalesce(gp.s, 0.0) AS sp, coalesce(gn.s, 0.0) AS sq FROM gp FULL JOIN gn ON gp.net = gn.net AND gp.node = gn.node)",
        _signed_out("gw", "x.a", "x.b"),
    ),
    "within_community_strength": sql(
        GRAPH
        + """,
ih AS (SELECT h.net, h.node, weight FROM half h JOIN memb a ON h.net = a.net AND h.node = a.node JOIN memb b ON h.net = b.net AND h.other = b.node AND a.comm = b.comm),
cs AS (SELECT net, node, comm, count(*) OVER (PARTITION BY net, comm) AS nn FROM memb),
ipq AS (SELECT cs.net, cs.node, any_value(nn) AS nn, coalesce(sum(greatest(weight, 0.0)), 0.0) AS p, coalesce(sum(greatest(-weight, 0.0)), 0.0) AS q FROM cs LEFT JOIN ih ON cs.net = ih.net AND cs.node = ih.node GROUP BY cs.net, cs.node)""",
        f"SELECT net, node, {six('coalesce(coalesce(p / nullif(nn - 1, 0), 0.0) - q / nullif(p + q, 0) * coalesce(q / nullif(nn - 1, 0), 0.0), 0.0)')} AS wcs FROM ipq",
    ),
}

_ADJ = """
q AS (
  SELECT c_custkey AS k, c_mktsegment AS family,
         CASE WHEN c_custkey % 50 <> 0 THEN CAST(c_custkey * 7919 % 1000 AS DOUBLE) / CAST(1000.0 AS DOUBLE) END AS p
  FROM customer),
qm AS (SELECT *, count(p) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST) AS rk FROM q)"""
_BAL = "bal AS (SELECT CAST(c_custkey AS VARCHAR) AS sample, 'balance' AS region, c_mktsegment AS arm, c_acctbal AS value FROM customer)"
_ARMS = _BAL + ", mo AS (SELECT region, arm, count(value) AS n, avg(value) AS mean, var_samp(value) AS v FROM bal GROUP BY ALL), ab AS (SELECT x.region, x.arm AS a, y.arm AS b, x.n AS na, y.n AS nb, x.mean AS ma, y.mean AS mb, x.v AS va, y.v AS vb FROM mo x JOIN mo y ON x.region = y.region AND x.arm < y.arm)"
_RES = """
res AS (
  SELECT ['a ~ ab', 'a ~ b', 'ab ~ b'][p_partkey % 3 + 1] AS contrast, p_name AS node, 'degree' AS metric,
         CAST(p_partkey * 13 % 21 AS DOUBLE) - 10 AS diff, CAST(p_partkey * 37 % 100 AS DOUBLE) / CAST(500.0 AS DOUBLE) AS p_value
  FROM part),
hg AS (SELECT *, CASE WHEN diff > 0 THEN split_part(contrast, ' ~ ', 1) ELSE split_part(contrast, ' ~ ', 2) END AS higher_group FROM res),
sg AS (SELECT *, CAST(p_value <= 0.05 AS INTEGER) AS significant FROM hg)"""
_PROFILE = EDGES + """,
both_ends AS (SELECT net, src AS region, r FROM edges UNION ALL SELECT net, dst, r FROM edges),
prof AS (
  SELECT r.net, r.region, mean_r2, mean_signal, coef_var
  FROM (SELECT net, region, (sum(r * r) + 1) / (count(*) + 1) AS mean_r2, count(*) - count(r) AS gone FROM both_ends GROUP BY ALL) r
  JOIN (SELECT net, region, avg(value) AS mean_signal, stddev_samp(value) / nullif(avg(value), 0) AS coef_var FROM act GROUP BY ALL) s
    ON r.net = s.net AND r.region = s.region
  WHERE gone = 0 AND mean_r2 < 1)"""


def _perm_graph(reps: int = 20, value: str = "a.value") -> str:
    """The steps of GRAPH with a net for each level of each md5 permutation of the samples' labels."""
    return (
        ACT.replace("act AS (", "act0 AS (")
        + """,
base AS (SELECT DISTINCT net || ':' || sample AS sample, net AS level FROM act0),
placed AS (SELECT sample, level, row_number() OVER (ORDER BY level, sample) AS place FROM base),
drawn AS (
  SELECT rep, sample, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep = 0 THEN lpad(CAST(place AS VARCHAR), 12, '0') ELSE md5('0:' || rep || ':' || sample) END, sample) AS place
  FROM placed CROSS JOIN (SELECT unnest(range(@REPS@)) AS rep)),
lab AS (SELECT d.rep, d.sample, p.level FROM drawn d JOIN placed p ON d.place = p.place),
act AS (SELECT l.rep || '|' || l.level AS net, l.sample, a.region, @VALUE@ AS value FROM act0 a JOIN lab l ON a.net || ':' || a.sample = l.sample),""".replace("@REPS@", str(reps + 1)).replace("@VALUE@", value)
        + corr()
        + """,
nodes AS (SELECT DISTINCT net, region AS node FROM act),
memb AS (SELECT net, node, CAST(substr(node, 7, 1) AS INTEGER) AS comm FROM nodes),"""
        + HALF
    )


def _perm(metric: str, reps: int = 20, value: str = "a.value") -> str:
    """Steps up to `sp` (rep, level, node, metric, value) from those up to `mv` (net, node, metric, value)."""
    return (
        _perm_graph(reps, value)
        + metric
        + ", sp AS (SELECT CAST(split_part(net, '|', 1) AS BIGINT) AS rep, split_part(net, '|', 2) AS level, node, metric, value FROM mv)"
    )


def _perm_out(diff: str, name: str, cmp: str) -> str:
    return f""", df AS (
  SELECT x.rep, {name} AS contrast, x.node, x.metric, {diff} AS diff
  FROM sp x JOIN sp y ON x.rep = y.rep AND x.node = y.node AND x.metric = y.metric AND x.level < y.level)
SELECT n.contrast, n.node, n.metric, {six("r.diff")} AS diff, {six(f"avg(CASE WHEN abs(n.diff) {cmp} abs(r.diff) THEN 1.0 ELSE 0.0 END)")} AS p_value
FROM (SELECT * FROM df WHERE rep > 0) n JOIN (SELECT * FROM df WHERE rep = 0) r ON n.contrast = r.contrast AND n.node = r.node AND n.metric = r.metric
GROUP BY n.contrast, n.node, n.metric, r.diff"""


_EDGE_VALUES = ", mv AS (SELECT net, src || ' ~ ' || dst AS node, 'r' AS metric, round(coalesce(r, 0.0), 9) AS value FROM edges)"
_NULLED = (
    ACT
    + """,
twice AS (
  SELECT net, sample, region, CASE WHEN region = 'Brand#11' THEN 0.0 WHEN value >= 20 THEN value END AS value FROM act
  UNION ALL SELECT net, sample, region, CASE WHEN value >= 20 THEN value + 2 END FROM act WHERE region LIKE '%5'),
once AS (SELECT net, sample, region, avg(value) AS value FROM twice GROUP BY ALL)"""
)
_COMPLETE = """,
edges AS (
  SELECT a.net, a.region AS src, b.region AS dst,
         covar_samp(a.value, b.value) / nullif(stddev_samp(a.value) * stddev_samp(b.value), 0) AS r, count(*) AS n
  FROM once a JOIN once b ON a.net = b.net AND a.sample = b.sample AND a.region < b.region
  WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL)"""


def _redrawn() -> str:
    """The first 20 of 400 attempts in which all differences that the data have are defined."""
    steps = _perm(
        """,
net2 AS (SELECT net, count(*) AS n FROM nodes GROUP BY net),
e2 AS (SELECT net, avg(r) AS mean_fc, count(*) AS m FROM edges WHERE abs(r) > 0.31 GROUP BY net),
mv AS (
  SELECT n.net, '' AS node, 'mean_fc' AS metric, round(mean_fc, 6) AS value FROM net2 n LEFT JOIN e2 USING (net)
  UNION ALL SELECT n.net, '', 'density', round(coalesce(m, 0) * 2.0 / (n * (n - 1)), 6) FROM net2 n LEFT JOIN e2 USING (net))""",
        400,
    )
    return sql(
        steps
        + """, df AS (
  SELECT x.rep, x.level || ' ~ ' || y.level AS contrast, x.node, x.metric, abs(x.value - y.value) AS diff
  FROM sp x JOIN sp y ON x.rep = y.rep AND x.node = y.node AND x.metric = y.metric AND x.level < y.level),
r AS (SELECT * FROM df WHERE rep = 0 AND diff IS NOT NULL),
ok AS (
  SELECT df.rep FROM df JOIN r ON df.contrast = r.contrast AND df.metric = r.metric WHERE df.rep > 0 AND df.diff IS NOT NULL
  GROUP BY df.rep HAVING count(*) = (SELECT count(*) FROM r) ORDER BY df.rep LIMIT 20)""",
        f"""SELECT n.contrast, n.node, n.metric, {six("r.diff")} AS diff, {six("avg(CASE WHEN n.diff >= r.diff THEN 1.0 ELSE 0.0 END)")} AS p_value,
  (SELECT count(*) FROM ok) AS replicates, (SELECT max(rep) FROM ok) AS attempts
FROM df n JOIN r ON n.contrast = r.contrast AND n.metric = r.metric WHERE n.rep IN (SELECT rep FROM ok)
GROUP BY n.contrast, n.node, n.metric, r.diff""",
    )


#: Brands by the rest of their number by five; `own` is the first brand with the same rest.
_RESTS = """b AS (SELECT DISTINCT p_brand AS node, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 5 AS rest FROM part),
r AS (SELECT *, min(node) OVER (PARTITION BY rest) AS own FROM b)"""
_FIRST = ("x.value - y.value", "x.level || ' ~ ' || y.level", ">")
_SECOND = ("y.value - x.value", "y.level || ' ~ ' || x.level", ">")
_TREE = lambda body: "WITH RECURSIVE " + TREE + "\n" + body
ORACLE_SQL |= {
    "clean_data": sql(
        ACT + ", holed AS (SELECT net, sample, region, CASE WHEN value >= 20 THEN value END AS value FROM act), sh AS (SELECT *, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY net, region) AS gone FROM holed)",
        f"SELECT net, sample, region, {six('coalesce(value, avg(value) OVER (PARTITION BY net, region))')} AS value FROM sh WHERE gone < 0.25",
    ),
    "drop_zero_regions": sql(ACT, f"SELECT net, sample, region, {six('value')} AS value FROM (SELECT *, sum(value) OVER (PARTITION BY net, region) AS s FROM (SELECT net, sample, region, CASE WHEN region = 'Brand#11' THEN 0.0 ELSE value END AS value FROM act)) WHERE s > 0"),
    "lookup_fill": sql(ACT, f"SELECT net, sample, region, {six('value')} AS value FROM act"),
    "collapse_mean": f"SELECT o_orderpriority AS net, strftime(o_orderdate, '%Y-%m') AS sample, 'all' AS region, {six('avg(ln(o_totalprice))')} AS value FROM orders GROUP BY ALL",
    "zscore_by_level": sql(ACT, f"SELECT net, sample, region, {six('value')} AS value, {six('(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0)')} AS z FROM act WINDOW w AS (PARTITION BY net, region)"),
    "scale_factor": sql(ACT, f"SELECT net, sample, region, {six('value')} AS value, {six('(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0)')} AS z FROM act WINDOW w AS (PARTITION BY net)"),
    "level_vs_corr": sql(_PROFILE, f"SELECT net, region, {six('mean_r2')} AS mean_r2, {six('mean_signal')} AS mean_signal, {six('coef_var')} AS coef_var FROM prof"),
    "filename_factors": """
WITH f AS (SELECT 'exp1_s' || n_nationkey || '_' || CASE WHEN n_regionkey > 1 THEN 'L' ELSE 'R' END || '_fos_' || replace(n_name, '_', '.') || '_Annotated_counts.csv' AS file FROM nation),
s AS (SELECT file, string_split(regexp_replace(file, '_An.*', ''), '_') AS p FROM f)
SELECT file, p[1] AS experiment, p[2] AS subject, p[3] AS hemisphere, p[4] AS signal, p[5] AS "group" FROM s""",
    "tree_sum": _TREE(f"SELECT net, sample, ancestor_id AS id, {six('sum(value)')} AS value FROM counts JOIN up USING (id) GROUP BY ALL"),
    "subtree_filter": _TREE("SELECT t.id, t.parent_id, t.region FROM tree t JOIN up ON t.id = up.id AND up.ancestor_id = 2"),
    "pattern_trim": _TREE(
        ", kept AS (SELECT * FROM tree t WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.id = t.id AND up.ancestor_id = 3) AND NOT (region LIKE '%7%' AND region <> 'Supplier#000000007'))\nSELECT id, parent_id, region FROM kept WHERE id NOT IN (SELECT parent_id FROM kept WHERE parent_id IS NOT NULL)"
    ),
    "noncounted_child": _TREE(
        ", tot AS (SELECT id, sum(value) AS total FROM counts GROUP BY id), ps AS (SELECT parent_id FROM tree LEFT JOIN tot USING (id) GROUP BY parent_id HAVING sum(coalesce(total, 0)) = 0)\nSELECT id, parent_id, region FROM tree t WHERE NOT EXISTS (SELECT 1 FROM ps WHERE ps.parent_id = t.parent_id)"
    ),
    "anatomical_group_map": _TREE(
        ", named AS (SELECT t.id AS ancestor_id, g.grp FROM tree t JOIN (VALUES ('root', 'other'), ('AFRICA', 'south'), ('ASIA', 'east'), ('Nation_3', 'own'), ('NATION_3', 'own')) g(root, grp) ON t.region = g.root), near AS (SELECT up.id, arg_min(grp, depth) AS grp FROM up JOIN named USING (ancestor_id) GROUP BY up.id)\nSELECT t.id, t.region, near.grp AS anatomical_group FROM tree t LEFT JOIN near ON t.id = near.id"
    ),
    "del_isolated": sql(GRAPH, "SELECT DISTINCT net, node FROM half WHERE abs(weight) > 0.3"),
    "nodes_match_zero_fill": sql(GRAPH, f"SELECT a.net, a.node AS src, b.node AS dst, {six('coalesce(g.weight, 0.0)')} AS weight FROM nodes a JOIN nodes b ON a.net = b.net AND a.node < b.node LEFT JOIN g ON g.net = a.net AND g.src = a.node AND g.dst = b.node"),
    "match_net_to_comm": sql(GRAPH, f"SELECT g.net, src, dst, {six('weight')} AS weight FROM g JOIN memb a ON g.net = a.net AND g.src = a.node AND a.comm IN (1, 2) JOIN memb b ON g.net = b.net AND g.dst = b.node AND b.comm IN (1, 2)"),
    "agreement": sql(PARTITIONS, f"SELECT a.net, a.node AS src, b.node AS dst, {six('count(*) / 6.0')} AS weight FROM parts a JOIN parts b ON a.net = b.net AND a.part = b.part AND a.comm = b.comm AND a.node < b.node GROUP BY ALL"),
    "perm_model": sql(PARTITIONS, f"SELECT net, part, {six('sum(s * (s - 1)) / (sum(s) * (sum(s) - 1))')} AS p FROM (SELECT net, part, comm, CAST(count(*) AS DOUBLE) AS s FROM parts GROUP BY ALL) GROUP BY net, part"),
    "local_perm_model": sql(PARTITIONS, f"SELECT net, part, node, {six('(count(*) OVER (PARTITION BY net, part, comm) - 1) / CAST(count(*) OVER (PARTITION BY net, part) - 1 AS DOUBLE)')} AS p FROM parts"),
    "relabel_partitions": sql(PARTITIONS, "SELECT net, part, node, CAST(dense_rank() OVER (PARTITION BY net, part ORDER BY f) AS INTEGER) AS comm FROM (SELECT *, min(node) OVER (PARTITION BY net, part, comm) AS f FROM parts)"),
    "unique_partitions": sql(
        PARTITIONS + ", two AS (SELECT * FROM parts UNION ALL SELECT net, part + 100, node, comm FROM parts), rl AS (SELECT net, part, node, CAST(dense_rank() OVER (PARTITION BY net, part ORDER BY f) AS INTEGER) AS comm FROM (SELECT *, min(node) OVER (PARTITION BY net, part, comm) AS f FROM two)), vec AS (SELECT net, part, list(comm ORDER BY node) AS v FROM rl GROUP BY ALL), kp AS (SELECT net, min(part) AS part FROM vec GROUP BY net, v)",
        "SELECT rl.net, rl.part, rl.node, rl.comm FROM rl JOIN kp ON rl.net = kp.net AND rl.part = kp.part",
    ),
    "welch_t": sql(_ARMS, f"SELECT region, a, b, {six('(ma - mb) / sqrt(va / na + vb / nb)')} AS t, {six('pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1))')} AS df, {six('ma - mb')} AS diff FROM ab"),
    "cohens_d_pairs": sql(_ARMS, f"SELECT region, a, b, {six('(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))')} AS d FROM ab"),
    "cohens_d_one_sample": sql(_BAL, f"SELECT region, arm, {six('abs(4500.0 - avg(value)) / stddev_samp(value)')} AS d FROM bal GROUP BY ALL"),
    "ols_activity_connectivity": sql(
        _PROFILE + ", rg AS (SELECT net, count(*) AS n, avg(mean_signal) AS mx, avg(mean_r2) AS my, var_samp(mean_signal) AS vx, var_samp(mean_r2) AS vy, covar_samp(mean_signal, mean_r2) AS cxy FROM prof GROUP BY net), rb AS (SELECT *, cxy / vx AS beta, vy * (n - 1) AS nd, vy * (n - 1) - cxy / vx * cxy * (n - 1) AS dev FROM rg), rs AS (SELECT *, sqrt(dev / (n - 2) / (vx * (n - 1))) AS se FROM rb)",
        f"SELECT net, n, {six('beta')} AS beta, {six('my - beta * mx')} AS intercept, {six('se')} AS std_error, {six('beta / se')} AS t, {six('1 - dev / nd')} AS r2, {six('pow(beta / se, 2)')} AS f, {six('dev')} AS deviance, {six('nd')} AS null_deviance FROM rs",
    ),
    "p_adjust_bh": sql(_ADJ, f"SELECT k, family, {six('p')} AS p, {six('CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / rk) OVER (PARTITION BY family ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END')} AS p_adjusted FROM qm"),
    "p_adjust_holm": sql(_ADJ, f"SELECT k, family, {six('p')} AS p, {six('CASE WHEN p IS NOT NULL THEN least(1.0, max(p * (m - rk + 1)) OVER (PARTITION BY family ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END')} AS p_adjusted FROM qm"),
    "p_adjust_bonferroni": sql(_ADJ, f"SELECT k, family, {six('p')} AS p, {six('CASE WHEN p IS NOT NULL THEN least(1.0, p * m) END')} AS p_adjusted FROM qm"),
    "significant_comps": sql(_RES, f"SELECT contrast, node, metric, {six('diff')} AS diff, {six('p_value')} AS p_value, higher_group, significant FROM sg"),
    "significant_comps_trimmed": sql(_RES, f"SELECT contrast, node, metric, {six('diff')} AS diff, {six('p_value')} AS p_value, higher_group, significant FROM sg WHERE significant = 1 AND starts_with(contrast, 'a ~')"),
    "higher_group": sql(_RES, f"SELECT contrast, node, metric, {six('diff')} AS diff, {six('p_value')} AS p_value, higher_group FROM hg"),
    "comparison_hubs": sql(
        _RES + ", ea AS (SELECT *, unnest(string_split(contrast, ' ~ ')) AS g FROM sg)",
        'SELECT node, metric, g AS "group", CAST(count(*) FILTER (significant = 1 AND g = higher_group) AS BIGINT) AS won, CAST(count(*) FILTER (significant = 1 AND g <> higher_group) AS BIGINT) AS lost, CAST(count(*) FILTER (significant = 1 AND g = higher_group) - count(*) FILTER (significant = 1 AND g <> higher_group) AS BIGINT) AS score FROM ea GROUP BY node, metric, g',
    ),
    "sig_func_effect": sql(_RES, "SELECT contrast, node, CAST(CASE WHEN p_value > 0.05 THEN 0 WHEN diff >= 0 THEN 1 ELSE -1 END AS INTEGER) AS effect FROM res"),
    "perm_edges": sql(_perm(", mv AS (SELECT net, src || ' ~ ' || dst AS node, 'r' AS metric, round(coalesce(r, 0.0), 9) AS value FROM edges)"), "")[:-1] + _perm_out(*_FIRST),
}


def _ami(pairs: str, keys: str) -> str:
    """AMI of pairs (keys, c1, c2): EMI from the hypergeometric distribution of each two sizes, by lgamma."""
    return f"""
nij AS (SELECT {keys}, c1, c2, CAST(count(*) AS DOUBLE) AS m FROM {pairs} GROUP BY ALL),
ai AS (SELECT {keys}, c1, sum(m) AS x FROM nij GROUP BY ALL), bj AS (SELECT {keys}, c2, sum(m) AS y FROM nij GROUP BY ALL),
tn AS (SELECT {keys}, sum(m) AS n FROM nij GROUP BY ALL),
mi AS (SELECT {keys}, sum(m / n * ln(n * m / (x * y))) AS mi FROM nij JOIN ai USING ({keys}, c1) JOIN bj USING ({keys}, c2) JOIN tn USING ({keys}) GROUP BY ALL),
h1 AS (SELECT {keys}, -sum(x / n * ln(x / n)) AS h1 FROM ai JOIN tn USING ({keys}) GROUP BY ALL),
h2 AS (SELECT {keys}, -sum(y / n * ln(y / n)) AS h2 FROM bj JOIN tn USING ({keys}) GROUP BY ALL),
gr AS (SELECT {keys}, x, y, n, CAST(unnest(range(CAST(greatest(1, x + y - n) AS BIGINT), CAST(least(x, y) AS BIGINT) + 1)) AS DOUBLE) AS m FROM ai JOIN bj USING ({keys}) JOIN tn USING ({keys})),
em AS (
  SELECT {keys}, sum(m / n * ln(n * m / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1)
         - lgamma(n + 1) - lgamma(m + 1) - lgamma(x - m + 1) - lgamma(y - m + 1) - lgamma(n - x - y + m + 1))) AS emi FROM gr GROUP BY ALL)"""


def _ami_out(keys: str) -> str:
    value = six("CASE WHEN abs(greatest(h1, h2) - emi) < 1e-12 THEN 1.0 ELSE (mi - emi) / (greatest(h1, h2) - emi) END")
    return f"SELECT {keys}, {value} AS ami FROM mi JOIN h1 USING ({keys}) JOIN h2 USING ({keys}) JOIN em USING ({keys})"


def _draws(source: str, by: str) -> str:
    """dr (rep, by, sample, times): 30 bootstraps by md5 within `by` of the rows of source, and the rows as rep 0."""
    return f"""
pl AS (SELECT {by}, sample, row_number() OVER (PARTITION BY {by} ORDER BY sample) - 1 AS place, count(*) OVER (PARTITION BY {by}) AS total FROM {source}),
dp AS (
  SELECT rep, {by}, CASE WHEN rep = 0 THEN place ELSE CAST('0x' || substr(md5('0:' || rep || ':' || {by} || ':' || sample), 1, 12) AS BIGINT) % total END AS place
  FROM pl CROSS JOIN (SELECT unnest(range(31)) AS rep)),
dr AS (SELECT d.rep, {by}, p.sample, count(*) AS times FROM dp d JOIN pl p USING ({by}, place) GROUP BY ALL)"""


def _boot_out(keys: str, value: str, more: bool) -> str:
    ci = f", {six('2 * s0 - quantile_cont(x, 0.975)')} AS lower, {six('2 * s0 - quantile_cont(x, 0.025)')} AS upper" if more else ""
    return f"""
SELECT {keys}, {six("s0")} AS stat, {six("stddev_samp(x)")} AS std_error, {six("avg(CASE WHEN abs(x) > abs(s0) THEN 1.0 ELSE 0.0 END)")} AS p{ci}
FROM (SELECT {keys}, {value} AS x FROM bt WHERE rep > 0) JOIN (SELECT {keys}, {value} AS s0 FROM bt WHERE rep = 0) USING ({keys}) GROUP BY {keys}, s0"""


_CRITICAL = ", ".join(f"({n}, CAST({r!r} AS DOUBLE))" for n, r in zip(range(3, 150), critical_r(np.arange(3, 150), 0.05).tolist(), strict=True))
ORACLE_SQL |= {
    "corr_gram": ORACLE_SQL["corr_pearson"],
    "corr_nulls": sql(_NULLED + _COMPLETE, f"SELECT net, src, dst, {six('r')} AS r, n FROM edges"),
    "corr_nulls_gram": sql(_NULLED + _COMPLETE, f"SELECT net, src, dst, {six('r')} AS r, n FROM edges"),
    "corr_nulls_spearman": sql(
        _NULLED
        + """,
both2 AS (SELECT a.net, a.region AS src, b.region AS dst, a.value AS x, b.value AS y FROM once a JOIN once b ON a.net = b.net AND a.sample = b.sample AND a.region < b.region WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
rk AS (
  SELECT net, src, dst, rank() OVER (PARTITION BY net, src, dst ORDER BY x) + (count(*) OVER (PARTITION BY net, src, dst, x) - 1) / 2.0 AS x,
         rank() OVER (PARTITION BY net, src, dst ORDER BY y) + (count(*) OVER (PARTITION BY net, src, dst, y) - 1) / 2.0 AS y
  FROM both2)""",
        f"SELECT net, src, dst, {six('covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0)')} AS r, count(*) AS n FROM rk GROUP BY net, src, dst",
    ),
    "perm_edges_replicates": ORACLE_SQL["perm_edges"],
    "perm_edges_1000": sql(_perm(_EDGE_VALUES, 1000), "")[:-1] + _perm_out(*_FIRST),
    "perm_edges_constant": sql(_perm(_EDGE_VALUES, value="CASE WHEN a.region = 'Brand#11' THEN 0.0 ELSE a.value END"), "")[:-1] + _perm_out(*_FIRST),
    "perm_redraw": _redrawn(),
    "threshold_p_rcrit": sql(EDGES + f", crit(n, lim) AS (VALUES {_CRITICAL})", f"SELECT e.net, src, dst, e.n, CAST(0.05 AS DOUBLE) AS cut, {six('CASE WHEN abs(r) > lim THEN r ELSE 0.0 END')} AS r FROM edges e JOIN crit ON e.n = crit.n"),
    "normal_approx_null": sql(
        PARTITIONS + ", lp AS (SELECT net, part, node, (count(*) OVER (PARTITION BY net, part, comm) - 1) / CAST(count(*) OVER (PARTITION BY net, part) - 1 AS DOUBLE) AS p FROM parts)",
        f"SELECT net, node, {six(f'greatest(0.0, least(1.0, avg(p) + ({float(normal_quantile(0.05)[0])!r}) * sqrt(sum(p * (1 - p))) / count(*)))')} AS p FROM lp GROUP BY net, node",
    ),
    "ami_pairs": sql(PARTITIONS + ", pp AS (SELECT x.part AS a, y.part AS b, x.comm AS c1, y.comm AS c2 FROM parts x JOIN parts y ON x.node = y.node AND x.part < y.part)," + _ami("pp", "a, b"), _ami_out("a, b")),
    "group_ami": sql(PARTITIONS + ", pp AS (SELECT 1 AS level, 'p' || x.part AS a, 'p' || y.part AS b, x.comm AS c1, y.comm AS c2 FROM parts x JOIN parts y ON x.node = y.node AND x.part < y.part)," + _ami("pp", "level, a, b"), _ami_out("level, a, b")),
    "boot_ci": sql(
        _BAL + "," + _draws("bal", "arm") + """,
wm AS (
  SELECT rep, region, arm, CAST(sum(times) AS DOUBLE) AS n, sum(times * value) AS s, sum(times * value * value) AS q
  FROM bal JOIN dr USING (arm, sample) GROUP BY ALL),
wv AS (SELECT rep, region, arm, n, s / n AS mean, (q - s * s / n) / (n - 1) AS v FROM wm),
bt AS (
  SELECT rep, x.region, x.arm AS a, y.arm AS b, (x.mean - y.mean) / sqrt(x.v / x.n + y.v / y.n) AS t
  FROM wv x JOIN wv y USING (rep, region) WHERE x.arm < y.arm)""",
        _boot_out("region, a, b", "t", True),
    ),
    "boot_p_value": sql(
        _PROFILE + ", pts AS (SELECT net, region AS sample, mean_signal AS x, mean_r2 AS y FROM prof)," + _draws("pts", "net") + """,
bm AS (
  SELECT rep, net, CAST(sum(times) AS DOUBLE) AS n, sum(times * x) AS sx, sum(times * y) AS sy, sum(times * x * x) AS sxx, sum(times * x * y) AS sxy
  FROM pts JOIN dr USING (net, sample) GROUP BY ALL),
bt AS (SELECT rep, net, (sxy - sx * sy / n) / nullif(sxx - sx * sx / n, 0) AS beta FROM bm)""",
        _boot_out("net", "beta", False),
    ),
}


def _distances(squarings: int = 5) -> str:
    """dist (net, a, b, d): shortest distances over lengths 1 / |weight|, by squaring in (min, +)."""
    steps = """,
d0 AS (SELECT net, node AS a, other AS b, 1 / abs(weight) AS d FROM half UNION ALL SELECT net, node, node, 0.0 FROM nodes)"""
    for k in range(squarings):
        steps += f",\nd{k + 1} AS MATERIALIZED (SELECT x.net, x.a, y.b, min(x.d + y.d) AS d FROM d{k} x JOIN d{k} y ON x.net = y.net AND x.b = y.a GROUP BY ALL)"
    return steps + f",\ndist AS (SELECT * FROM d{squarings} WHERE a <> b)"


_LEVELS = EDGES + """,
lv AS (SELECT unnest([1, 2]) AS level),
nodes AS (SELECT DISTINCT a.net || '/' || level AS net, b.region AS node FROM cells a CROSS JOIN (SELECT DISTINCT region FROM cells) b CROSS JOIN lv),
memb AS (SELECT net, node, CAST(CASE WHEN split_part(net, '/', 2) = '1' THEN CAST(substr(node, 7, 1) AS INTEGER) ELSE CAST(substr(node, 7, 1) AS INTEGER) % 2 END AS INTEGER) AS comm FROM nodes),
g AS (SELECT net || '/' || level AS net, src, dst, r AS weight FROM edges CROSS JOIN lv WHERE abs(r) > 0.2),
half AS (SELECT net, src AS node, dst AS other, weight FROM g UNION ALL SELECT net, dst, src, weight FROM g)"""


def _value(a: str, b: str, source: str) -> str:
    """net, node, v: the signed combination of two parts of source."""
    return f"(SELECT m.net, m.node, coalesce({a}, 0.0) - coalesce(coalesce(sq, 0.0) / nullif(coalesce(sp, 0.0) + coalesce(sq, 0.0), 0), 0.0) * coalesce({b}, 0.0) AS v FROM memb m LEFT JOIN {source} USING (net, node))"


ORACLE_SQL |= {
    "nodal_efficiency": sql(GRAPH + _distances(), f"SELECT n.net, n.node, {six('coalesce(sum(1 / d), 0.0) / (any_value(n_nodes) - 1)')} AS nodal_efficiency FROM nodes n JOIN sizes USING (net) LEFT JOIN dist ON n.net = dist.net AND n.node = dist.a GROUP BY n.net, n.node"),
    "closeness": sql(GRAPH + _distances(), f"SELECT n.net, n.node, {six('coalesce(count(d) / nullif(sum(d), 0), 0.0)')} AS closeness FROM nodes n LEFT JOIN dist ON n.net = dist.net AND n.node = dist.a GROUP BY n.net, n.node"),
    "synthetic_source": sql(
        ACT,
        """SELECT CAST(k + 1 AS VARCHAR) AS level, (people + levels - 1 - k) // levels * regions AS cells, regions, true AS near
FROM (SELECT count(DISTINCT net || sample) AS people, count(DISTINCT net) AS levels, count(DISTINCT region) AS regions FROM act), range(3) r(k)""",
    ),
    "community_metrics_levels": sql(
        _LEVELS + "," + BYCOMM + "," + _gateway("p", ">") + "," + _gateway("n", "<") + f""",
vp AS (SELECT net, node, sp, sq, CASE WHEN sp > 0 THEN 1 - p2 / (sp * sp) ELSE 0 END AS a, CASE WHEN sq > 0 THEN 1 - q2 / (sq * sq) ELSE 0 END AS b FROM bt),
vd AS (
  SELECT bc.net, bc.node, any_value(sp) AS sp, any_value(sq) AS sq, sum({_LN.format("p", "sp")}) / ln(any_value(m)) AS a, sum({_LN.format("q", "sq")}) / ln(any_value(m)) AS b
  FROM bc JOIN bt ON bc.net = bt.net AND bc.node = bt.node JOIN (SELECT net, count(DISTINCT comm) AS m FROM memb GROUP BY net) c ON bc.net = c.net GROUP BY ALL),
vg AS (
  SELECT coalesce(gp.net, gn.net) AS net, coalesce(gp.node, gn.node) AS node, coalesce(gp.gw, 0.0) AS a, coalesce(gn.gw, 0.0) AS b, coalesce(gp.s, 0.0) AS sp, coalesce(gn.s, 0.0) AS sq
  FROM gp FULL JOIN gn ON gp.net = gn.net AND gp.node = gn.node),
ih AS (SELECT h.net, h.node, weight FROM half h JOIN memb a ON h.net = a.net AND h.node = a.node JOIN memb b ON h.net = b.net AND h.other = b.node AND a.comm = b.comm),
cs AS (SELECT net, node, comm, count(*) OVER (PARTITION BY net, comm) AS nn FROM memb),
ipq AS (SELECT cs.net, cs.node, cs.comm, any_value(nn) AS nn, coalesce(sum(greatest(weight, 0.0)), 0.0) AS p, coalesce(sum(greatest(-weight, 0.0)), 0.0) AS q FROM cs LEFT JOIN ih ON cs.net = ih.net AND cs.node = ih.node GROUP BY cs.net, cs.node, cs.comm)""",
        f"""SELECT i.net, i.node, i.comm, {six("p.v")} AS participation, {six("d.v")} AS diversity, {six("g.v")} AS gateway,
       {six("coalesce(coalesce(i.p / nullif(nn - 1, 0), 0.0) - i.q / nullif(i.p + i.q, 0) * coalesce(i.q / nullif(nn - 1, 0), 0.0), 0.0)")} AS wcs
FROM ipq i JOIN {_value("a", "b", "vp")} p USING (net, node) JOIN {_value("a", "b", "vd")} d USING (net, node) JOIN {_value("a", "b", "vg")} g USING (net, node)""",
    ),
}


# Paths with counts, spectra and distributions.


def _shortest(edges: str, keys: str, name: str, squarings: int = 5) -> str:
    """name (keys, a, b, d): shortest distances between different nodes over edges (keys, a, b, d) in both directions."""
    same = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys.split(", "))
    of = ", ".join(f"x.{k}" for k in keys.split(", "))
    steps = f"{name}0 AS (SELECT {keys}, a, b, d FROM {edges} UNION ALL SELECT DISTINCT {keys}, a, a, 0.0 FROM {edges})"
    for k in range(squarings):
        steps += f",\n{name}{k + 1} AS MATERIALIZED (SELECT {of}, x.a, y.b, min(x.d + y.d) AS d FROM {name}{k} x JOIN {name}{k} y ON {same('x', 'y')} AND x.b = y.a GROUP BY ALL)"
    return steps + f",\n{name} AS (SELECT * FROM {name}{squarings} WHERE a <> b)"


def _between(dist: str, out: str) -> str:
    """out (net, node, v): unordered pairs whose shortest path goes through a node. Weights are measured correlations, so
    no two paths of a pair are equally long."""
    return f"""{out} AS (
  SELECT x.net, x.b AS node, count(*) / 2.0 AS v
  FROM {dist} x JOIN {dist} y ON x.net = y.net AND x.b = y.a JOIN {dist} z ON x.net = z.net AND x.a = z.a AND y.b = z.b
  WHERE x.a <> y.b AND x.d + y.d <= z.d * (1 + 1e-9) GROUP BY ALL)"""


_HALF_LENGTHS = ",\nlengths AS (SELECT net, node AS a, other AS b, 1 / abs(weight) AS d FROM half),\n"
_BETWEEN = GRAPH + _HALF_LENGTHS + _shortest("lengths", "net", "ds") + ",\n" + _between("ds", "bt")


def _gateway_bet(sign: str, comp: str) -> str:
    s = sign
    paths = f"l{s} AS (SELECT net, node AS a, other AS b, 1 / abs(weight) AS d FROM half WHERE weight {comp} 0),\n" + _shortest(f"l{s}", "net", f"t{s}") + ",\n" + _between(f"t{s}", f"b{s}")
    cent = f"\nc{s} AS (SELECT n.net, n.node, coalesce(v, 0.0) AS cent FROM nodes n LEFT JOIN b{s} USING (net, node))"
    steps = _gateway(sign, comp)
    strength = f"\nc{s} AS (SELECT net, node, sum(w) AS cent FROM h{s} GROUP BY ALL)"
    assert strength in steps
    return paths + "," + steps.replace(strength, cent)


def _eigen(squarings: int = 16) -> str:
    """ev (net, node, v): the leading eigenvector, by squaring the matrix made positive on its spectrum."""
    steps = """,
sh AS (SELECT net, max(s) AS c FROM (SELECT net, node, sum(abs(weight)) AS s FROM half GROUP BY ALL) GROUP BY net),
m0 AS (
  SELECT h.net, h.node AS a, h.other AS b, h.weight / c AS v FROM half h JOIN sh USING (net)
  UNION ALL SELECT n.net, n.node, n.node, 1.0 FROM nodes n JOIN sh USING (net))"""
    for k in range(squarings):
        steps += f",\nr{k + 1} AS MATERIALIZED (SELECT x.net, x.a, y.b, sum(x.v * y.v) AS v FROM m{k} x JOIN m{k} y ON x.net = y.net AND x.b = y.a GROUP BY ALL)"
        steps += f",\nm{k + 1} AS MATERIALIZED (SELECT net, a, b, v / max(abs(v)) OVER (PARTITION BY net) AS v FROM r{k + 1})"
    return steps + f""",
top AS (SELECT net, arg_max(a, v) AS p FROM m{squarings} WHERE a = b GROUP BY net),
col AS (SELECT m.net, m.a AS node, m.v FROM m{squarings} m JOIN top ON m.net = top.net AND m.b = top.p),
ev AS (SELECT net, node, v / first_value(v) OVER (PARTITION BY net ORDER BY abs(v) DESC) AS v FROM col)"""


def _losses() -> str:
    """Losses of mean global and local efficiency by removal; rem '' is the whole network."""
    return (
        GRAPH
        + """,
rm AS (SELECT net, node AS rem FROM nodes UNION ALL SELECT DISTINCT net, '' FROM nodes),
ge AS (SELECT h.net, rem, h.node AS a, h.other AS b, 1 / abs(weight) AS d FROM half h JOIN rm ON h.net = rm.net AND h.node <> rem AND h.other <> rem),
"""
        + _shortest("ge", "net, rem", "gd")
        + """,
le AS (
  SELECT e.net, e.rem, v.a AS v, e.a, e.b, e.d
  FROM ge v JOIN ge w ON v.net = w.net AND v.rem = w.rem AND v.a = w.a AND v.b <> w.b JOIN ge e ON e.net = v.net AND e.rem = v.rem AND e.a = v.b AND e.b = w.b),
"""
        + _shortest("le", "net, rem, v", "ld")
        + """,
nn AS (SELECT rm.net, rem, n_nodes - CAST(rem <> '' AS INTEGER) AS n FROM rm JOIN sizes USING (net)),
gs AS (SELECT net, rem, sum(1 / d) AS s FROM gd GROUP BY ALL),
dg AS (SELECT net, rem, a AS v, count(*) AS k FROM ge GROUP BY ALL),
ls AS (SELECT net, rem, sum(e) AS s FROM (SELECT net, rem, v, sum(1 / ld.d) / any_value(k * (k - 1)) AS e FROM ld JOIN dg USING (net, rem, v) GROUP BY ALL) GROUP BY ALL),
ef AS (SELECT nn.net, nn.rem, coalesce(gs.s, 0.0) / (n * (n - 1)) AS g, coalesce(ls.s, 0.0) / n AS l FROM nn LEFT JOIN gs USING (net, rem) LEFT JOIN ls USING (net, rem))"""
    )


#: P(|T| >= |t|) by the finite series for a whole number of degrees of freedom.
def _t_whole(t: str, df: str) -> str:
    theta, cos2 = f"atan(abs({t}) / sqrt({df}))", f"({df} / ({df} + {t} * {t}))"
    even = f"sin({theta}) * list_sum(list_transform(range(0, CAST({df} AS BIGINT) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow({cos2}, k)))"
    odd = f"2 / pi() * ({theta} + sin({theta}) * sqrt({cos2}) * coalesce(list_sum(list_transform(range(0, (CAST({df} AS BIGINT) - 1) // 2), lambda k: exp(lgamma(k + 1.0) + lgamma(1.5) - lgamma(k + 1.5)) * pow({cos2}, k))), 0))"
    return f"(1 - CASE WHEN CAST({df} AS BIGINT) % 2 = 0 THEN {even} ELSE {odd} END)"


def _simpson(f: str, upper: str, steps: int) -> str:
    """The integral of f(x), an expression in x, from 0 to upper."""
    point = f.replace("{x}", f"({upper} * k / {steps}.0)")
    return f"({upper} / {3 * steps}.0 * list_sum(list_transform(range(0, {steps + 1}), lambda k: (CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {point})))"


def _t_density(df: str) -> str:
    return f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * pow(1 + {{x}} * {{x}} / {df}, -({df} + 1) / 2)"


def _t_p(t: str, df: str, steps: int = 2000) -> str:
    return f"(1 - 2 * {_simpson(_t_density(df), f'abs({t})', steps)})"


def _t_975(source: str, df: str, steps: int = 2000) -> str:
    """Columns of source and q, the quantile of 0.975: four terms of its expansion in 1 / df, then Newton's steps."""
    z = repr(float(normal_quantile(0.975)[0]))
    first = f"({z} + ({z}**3 + {z}) / (4 * {df}) + (5 * {z}**5 + 16 * {z}**3 + 3 * {z}) / (96 * {df}**2) + (3 * {z}**7 + 19 * {z}**5 + 17 * {z}**3 - 15 * {z}) / (384 * {df}**3))"
    step = lambda q: f"{q} + (0.475 - {_simpson(_t_density(df), q, steps)}) / ({_t_density(df).replace('{x}', q)})"
    return f"(SELECT *, {step('q2')} AS q FROM (SELECT *, {step('q1')} AS q2 FROM (SELECT *, {step('q0')} AS q1 FROM (SELECT *, {first} AS q0 FROM {source}))))"


def _chi1(x: str) -> str:
    """P(chi-squared with one degree of freedom > x)."""
    return f"(1 - 2 * {_simpson('exp(-{x} * {x} / 2) / sqrt(2 * pi())', f'sqrt({x})', 4000)})"


_WELCH = _ARMS + ", w AS (SELECT region, a, b, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df, ma - mb AS diff FROM ab)"
_GLM = _PROFILE + """,
rg AS (SELECT net, count(*) AS n, avg(coef_var) AS mx, avg(mean_r2) AS my, var_samp(coef_var) AS vx, var_samp(mean_r2) AS vy, covar_samp(coef_var, mean_r2) AS cxy FROM prof WHERE coef_var IS NOT NULL GROUP BY net),
rb AS (SELECT *, cxy / vx AS beta, vy * (n - 1) AS nd, greatest(0.0, vy * (n - 1) - cxy / vx * cxy * (n - 1)) AS dev FROM rg),
rs AS (SELECT *, sqrt(dev / (n - 2) / (vx * (n - 1))) AS se, CAST(n - 2 AS DOUBLE) AS df, n * ln(nd / dev) AS ratio FROM rb)"""

_MEASURES = ("degree", "strength", "signed_strength", "leverage", "burt", "transitivity", "nodal_efficiency", "betweenness", "closeness", "eigenvector")
_NULLS = """,
ks AS (SELECT a.net, a.node AS src, b.node AS dst, coalesce(h.weight, 0.0) AS x, a.k * b.k AS kk FROM st a JOIN st b ON a.net = b.net AND a.node < b.node LEFT JOIN half h ON h.net = a.net AND h.node = a.node AND h.other = b.node),
pr AS (SELECT ks.net, src, dst, x, kk / k2 AS p FROM ks JOIN (SELECT net, sum(k) AS k2 FROM st GROUP BY net) USING (net))"""
_STRENGTHS = GRAPH.replace("r AS weight FROM edges", "abs(r) AS weight FROM edges") + ",\nst AS (SELECT n.net, n.node, coalesce(sum(weight), 0.0) AS k FROM nodes n LEFT JOIN half h ON n.net = h.net AND n.node = h.node GROUP BY ALL)" + _NULLS
ORACLE_SQL |= {
    "betweenness": sql(_BETWEEN, f"SELECT n.net, n.node, {six('coalesce(v, 0.0)')} AS betweenness FROM nodes n LEFT JOIN bt USING (net, node)"),
    "gateway_bet": sql(
        GRAPH + ",\n" + _gateway_bet("p", ">") + ",\n" + _gateway_bet("n", "<") + ", x AS (SELECT coalesce(gp.net, gn.net) AS net, coalesce(gp.node, gn.node) AS node, coalesce(gp.gw, 0.0) AS a, coalesce(gn.gw, 0.0) AS b, coalesce(gp.s, 0.0) AS sp, coalesce(gn.s, 0.0) AS sq FROM gp FULL JOIN gn ON gp.net = gn.net AND gp.node = gn.node)",
        _signed_out("gw", "x.a", "x.b"),
    ),
    "eigenvector": sql(GRAPH + _eigen(), f"SELECT n.net, n.node, {six('coalesce(v, 0.0)')} AS eigenvector FROM nodes n LEFT JOIN ev USING (net, node)"),
    "efficiency_loss": sql(
        _losses(),
        f"SELECT c.net, c.rem AS node, {six('CASE WHEN w.g > 0 THEN 1 - c.g / w.g ELSE 0 END')} AS global_loss, {six('CASE WHEN w.l > 0 THEN 1 - c.l / w.l ELSE 0 END')} AS local_loss FROM ef c JOIN ef w ON c.net = w.net AND w.rem = '' WHERE c.rem <> ''",
    ),
    "corr_p_values": sql(EDGES, f"SELECT net, src, dst, {six('r')} AS r, n, {six('p')} AS p FROM (SELECT *, {_t_whole('t', 'df')} AS p FROM (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, CAST(n - 2 AS DOUBLE) AS df FROM edges))"),
    "welch_test": sql(_WELCH, f"SELECT region, a, b, {six('t')} AS t, {six('df')} AS df, {six('diff')} AS diff, {six(_t_p('t', 'df'))} AS p, {six('diff - abs(diff / t) * q')} AS lower, {six('diff + abs(diff / t) * q')} AS upper FROM {_t_975('w', 'df')}"),
    "glm_activity_connectivity": sql(
        _GLM,
        f"SELECT net, n, {six('beta')} AS beta, {six('my - beta * mx')} AS intercept, {six('se')} AS std_error, {six('beta / se')} AS t, {six('1 - dev / nd')} AS r2, {six('pow(beta / se, 2)')} AS f, {six('dev')} AS deviance, {six('nd')} AS null_deviance, "
        f"{six(_t_whole('(beta / se)', 'df'))} AS p, {six('beta - se * q')} AS lower, {six('beta + se * q')} AS upper, {six(_chi1('((nd - dev) / (dev / df))'))} AS model_p, "
        f"{six('(1 - exp(-ratio / n)) / nullif(greatest(1 - exp(-ln(2 * pi() * nd / n) - 1), 0), 0)')} AS pseudo_r2, {six(_chi1('ratio'))} AS ratio_p FROM {_t_975('rs', 'df')}",
    ),
    "boot_ratio": sql(
        ACT + ", cellsof AS (SELECT DISTINCT net, sample FROM act)," + _draws("cellsof", "net").replace("'0:'", "'87:'").replace("range(31)", "range(101)") + """,
wr AS (
  SELECT rep, a.net, a.region AS src, b.region AS dst, CAST(sum(times) AS DOUBLE) AS n, sum(times * a.value) AS sx, sum(times * b.value) AS sy,
         sum(times * a.value * a.value) AS sxx, sum(times * b.value * b.value) AS syy, sum(times * a.value * b.value) AS sxy
  FROM dr JOIN act a ON a.net = dr.net AND a.sample = dr.sample JOIN act b ON b.net = a.net AND b.sample = a.sample AND a.region < b.region GROUP BY ALL),
zr AS (SELECT rep, net, src, dst, atanh((sxy - sx * sy / n) / sqrt(nullif((sxx - sx * sx / n) * (syy - sy * sy / n), 0))) AS z FROM wr)""",
        "SELECT net, src, dst, CASE WHEN round(ratio, 5) = 0 THEN 0.0 ELSE round(ratio, 5) END AS ratio FROM (SELECT net, src, dst, coalesce(max(CASE WHEN rep = 0 THEN z END) / nullif(stddev_samp(CASE WHEN rep > 0 THEN z END), 0), 0.0) AS ratio FROM zr GROUP BY ALL)",
    ),
    "louvain": sql(GRAPH, "SELECT net, part, n_nodes, true AS no_worse, true AS settled FROM sizes CROSS JOIN (SELECT unnest(range(5)) AS part)"),
    "modularity_max": sql(GRAPH, "SELECT net, CAST(0 AS BIGINT) AS part, n_nodes, true AS no_worse FROM sizes"),
    "multi_scale": sql(GRAPH, f"SELECT net, part, n_nodes, true AS no_worse, true AS settled, {six('-1.0 + 0.25 * part')} AS gamma FROM sizes CROSS JOIN (SELECT unnest(range(13)) AS part)"),
    "event_samples": sql(GRAPH, "SELECT net, part, n_nodes, true AS no_worse, true AS settled FROM sizes CROSS JOIN (SELECT unnest(range(40)) AS part)"),
    "consensus": sql(GRAPH, "SELECT net, n_nodes, n_nodes AS distinct_nodes, true AS numbered, true AS converged, true AS beats_one, true AS beats_single FROM sizes"),
    "agreement_less_null": sql(
        PARTITIONS + f""",
pl AS (SELECT part, node, (count(*) OVER (PARTITION BY part, comm) - 1) / CAST(count(*) OVER (PARTITION BY part) - 1 AS DOUBLE) AS p FROM parts),
q AS (SELECT node, greatest(0.0, least(1.0, avg(p) + ({float(normal_quantile(0.05)[0])!r}) * sqrt(sum(p * (1 - p))) / count(*))) AS p FROM pl GROUP BY node),
ag AS (SELECT a.node AS src, b.node AS dst, count(*) / 6.0 AS w FROM parts a JOIN parts b ON a.part = b.part AND a.comm = b.comm AND a.node < b.node GROUP BY ALL)""",
        f"SELECT 'brands' AS net, x.node AS src, y.node AS dst, {six('coalesce(w, 0.0) - least(x.p, y.p)')} AS weight FROM q x JOIN q y ON x.node < y.node LEFT JOIN ag ON src = x.node AND dst = y.node",
    ),
    "consensus_planted": f"WITH {_RESTS} SELECT 'brands' AS net, node, CAST(dense_rank() OVER (ORDER BY own) AS INTEGER) AS comm, true AS converged FROM r",
    "hier_planted": f"""
WITH {_RESTS},
two AS (SELECT *, min(node) OVER (PARTITION BY rest <= 1) AS half FROM r),
l AS (
  SELECT 1 AS level, node, 1 AS comm, 1 AS final FROM two
  UNION ALL SELECT 2, node, dense_rank() OVER (ORDER BY half), dense_rank() OVER (ORDER BY half) FROM two
  UNION ALL SELECT 3, node, dense_rank() OVER (ORDER BY half, own), dense_rank() OVER (ORDER BY own) FROM two
  UNION ALL SELECT 4, node, row_number() OVER (ORDER BY half, own, node), dense_rank() OVER (ORDER BY own) FROM two)
SELECT 'brands' AS net, CAST(level AS INTEGER) AS level, node, CAST(comm AS INTEGER) AS comm, CAST(final AS INTEGER) AS final, true AS converged FROM l""",
    "searches_planted": f"""
WITH {_RESTS}
SELECT search, node, CAST(dense_rank() OVER (PARTITION BY search ORDER BY own) AS INTEGER) AS comm
FROM r CROSS JOIN (SELECT unnest(['louvain', 'signed_louvain', 'spectral', 'sparse_louvain', 'sparse_signed_louvain']) AS search)""",
    "hier_consensus": sql(GRAPH, "SELECT net, n_nodes, CAST(1 AS BIGINT) AS first_communities, CAST(1 AS BIGINT) AS parents, true AS converged FROM sizes"),
    "gamma_range": sql(_STRENGTHS, f"SELECT net, {six('max(x / p)')} AS gamma_max, true AS ordered, true AS above_zero, true AS converged FROM pr WHERE p > 0 GROUP BY net"),
    "event_resolutions": sql(
        _STRENGTHS + """,
ev AS (SELECT net, x, p, x / p AS g FROM pr WHERE p > 0),
lows AS (SELECT net, sum(greatest(0.5 * p - x, 0)) / sum(abs(0.5 * p - x)) AS b0, max(g) AS top FROM ev GROUP BY net),
pt AS (SELECT e.net, e.g, sum(greatest(e.g * v.p - v.x, 0)) / sum(abs(e.g * v.p - v.x)) AS b FROM (SELECT DISTINCT net, g FROM ev) e JOIN ev v ON e.net = v.net GROUP BY ALL),
want AS (SELECT net, part, CASE WHEN part = 24 THEN 1.0 ELSE b0 + (1 - b0) * part / 24 END AS b, top FROM lows CROSS JOIN (SELECT unnest(range(25)) AS part)),
seg AS (SELECT w.net, w.part, w.b, any_value(top) AS top, min(pt.g) FILTER (pt.b >= w.b - 1e-12 AND pt.g > first) AS hi FROM want w JOIN pt ON w.net = pt.net JOIN (SELECT net, min(g) AS first FROM ev GROUP BY net) f ON f.net = w.net GROUP BY ALL),
sums AS (SELECT s.net, s.part, s.b, s.hi, any_value(top) AS top, sum(CASE WHEN g < hi THEN x ELSE 0 END) AS xn, sum(CASE WHEN g < hi THEN p ELSE 0 END) AS pn, sum(x) AS xa, sum(p) AS pa, max(g) FILTER (g < hi) AS lo FROM seg s JOIN ev ON s.net = ev.net GROUP BY ALL)""",
        f"SELECT net, part, CASE WHEN round(gamma, 5) = 0 THEN 0.0 ELSE round(gamma, 5) END AS gamma, {six('b')} AS b FROM (SELECT net, part, b, least(greatest((xn + b * (xa - 2 * xn)) / (pn + b * (pa - 2 * pn)), lo), hi) AS gamma FROM sums)",
    ),
    "clust_comp": sql(PARTITIONS + ", pp AS (SELECT net, part, comm AS c1, CAST(substr(node, 7, 1) AS INTEGER) AS c2 FROM parts)," + _ami("pp", "net, part"), _ami_out("net, part")),
    "sample_approx_null": sql(
        PARTITIONS + """,
lo AS (SELECT net, part, node, (count(*) OVER (PARTITION BY net, part, comm) - 1) / CAST(count(*) OVER (PARTITION BY net, part) - 1 AS DOUBLE) AS p FROM parts),
sub AS (SELECT unnest(range(64)) AS s),
ch AS (SELECT net, node, bit_count(CAST(s AS BIGINT)) AS k, product(CASE WHEN (s >> CAST(part - 1 AS BIGINT)) & 1 = 1 THEN p ELSE 1 - p END) AS c FROM lo CROSS JOIN sub GROUP BY net, node, s),
cd AS (SELECT net, node, k, sum(sum(c)) OVER (PARTITION BY net, node ORDER BY k) AS cum FROM ch GROUP BY net, node, k)""",
        f"SELECT net, node, {six('min(k) / 6.0')} AS exact, true AS near FROM cd WHERE cum >= 0.05 - 1e-12 GROUP BY net, node",
    ),
}
_PARTS_OF = {m: (m, m) for m in _MEASURES} | {"signed_strength": ("signed_strength_asym", "s_signed"), "transitivity": ("transitivity_local", "transitivity")}
ORACLE_SQL["nodal_measures"] = "SELECT net, node, " + ", ".join(f"{m}.{column} AS {m}" for m, (_, column) in _PARTS_OF.items()) + " FROM " + " JOIN ".join(f"({ORACLE_SQL[of]}) {m}" + (" USING (net, node)" if k else "") for k, (m, (of, _)) in enumerate(_PARTS_OF.items()))


def _perm_of(parts: dict[str, tuple[str, str]], out: tuple[str, str, str]) -> str:
    """The comparison of metrics (name -> query, column) of other queries, run over the permuted nets."""
    each = []
    for metric, (of, column) in parts.items():
        text = ORACLE_SQL[of]
        assert GRAPH in text
        node = "''" if of == "general_measures" else "node"
        each.append(f"SELECT net, {node} AS node, '{metric}' AS metric, CAST({column} AS DOUBLE) AS value FROM ({text.replace(GRAPH, _perm_graph())})")
    return sql(_perm(", mv AS (" + "\n  UNION ALL ".join(each) + ")"), "")[:-1] + _perm_out(*out)


_CBM = {"participation": ("participation", "p_signed"), "diversity": ("diversity", "h_signed"), "gateway": ("gateway_str", "gw_signed"), "wcs": ("within_community_strength", "wcs")}
_PRICES = """
pv AS (SELECT o_orderpriority AS net, o_orderstatus AS arm, ln(o_totalprice) AS value FROM orders WHERE o_orderstatus IN ('F', 'O')),
mo AS (SELECT net, arm, count(value) AS n, avg(value) AS mean, var_samp(value) AS v FROM pv GROUP BY ALL),
ab AS (SELECT x.net, x.arm AS a, y.arm AS b, x.n AS na, y.n AS nb, x.mean AS ma, y.mean AS mb, x.v AS va, y.v AS vb FROM mo x JOIN mo y ON x.net = y.net AND x.arm < y.arm),
w AS (SELECT net, a, b, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df, ma - mb AS diff FROM ab)"""
_BOTH = _PROFILE + """,
pts AS (SELECT net, 'mean_signal' AS predictor, mean_signal AS x, mean_r2 AS y FROM prof UNION ALL SELECT net, 'coef_var', coef_var, mean_r2 FROM prof WHERE coef_var IS NOT NULL),
rg AS (SELECT net, predictor, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS cxy FROM pts GROUP BY ALL),
rb AS (SELECT *, cxy / vx AS beta, vy * (n - 1) AS nd, greatest(0.0, vy * (n - 1) - cxy / vx * cxy * (n - 1)) AS dev FROM rg),
rs AS (SELECT *, sqrt(dev / (n - 2) / (vx * (n - 1))) AS se, CAST(n - 2 AS DOUBLE) AS df FROM rb)"""
_P_LM = _t_whole("(beta / se)", "df")
ORACLE_SQL |= {
    "perm_nodal": _perm_of({m: _PARTS_OF[m] for m in _MEASURES[:-1]}, _SECOND),
    "perm_general": _perm_of({m: ("general_measures", m) for m in ("mean_fc", "gc_size", "gc_pct", "density", "modularity")}, ("abs(x.value - y.value)", "x.level || ' ~ ' || y.level", ">=")),
    "perm_cbm": _perm_of(_CBM, _FIRST),
    "perm_cbm_base": _perm_of(_CBM, _SECOND),
    "functional_effect": sql(
        EDGES + ", fe AS (SELECT net, src || ' ~ ' || dst AS node, round(CASE WHEN abs(r) > 0.1 THEN atanh(abs(r)) ELSE 0.0 END, 6) AS value FROM edges)",
        f"SELECT x.net || ' ~ ' || y.net AS contrast, x.node, 'r' AS metric, {six('x.value - y.value')} AS diff FROM fe x JOIN fe y ON x.node = y.node AND x.net < y.net",
    ),
    "factor_comp": sql(
        _PRICES + f", wt AS (SELECT net, a, b, t, diff, q, {_t_p('t', 'df')} AS p FROM {_t_975('w', 'df')})",
        f"SELECT net, 'price' AS region, a, b, {six('t')} AS t, {six('p')} AS p, {six('diff - abs(diff / t) * q')} AS lower, {six('diff + abs(diff / t) * q')} AS upper, {six('p')} AS adj_p FROM wt",
    ),
    "factor_comp_boot": "SELECT 'segment' AS net, region, a, b, stat AS t, std_error, p, lower, upper FROM (" + ORACLE_SQL["boot_ci"] + ")",
    "activity_vs_connectivity": sql(
        _BOTH,
        f"SELECT net, predictor, n, {six('beta')} AS beta, {six('my - beta * mx')} AS intercept, {six('se')} AS std_error, {six('beta / se')} AS t, {six('1 - dev / nd')} AS r2, {six('pow(beta / se, 2)')} AS f, {six('dev')} AS deviance, {six('nd')} AS null_deviance, "
        f"{six(_P_LM)} AS p, {six('beta - se * q')} AS lower, {six('beta + se * q')} AS upper, {six(_P_LM)} AS model_p, CAST(NULL AS DOUBLE) AS pseudo_r2, CAST(NULL AS DOUBLE) AS ratio_p FROM {_t_975('rs', 'df')}",
    ),
}


# The rest of preparation, trees and hierarchies.


def _trimmed() -> str:
    from netloom.operators.hierarchy import MOVED_REGION, REMOVED_SUBTREES, TRIM_RULES
    from netloom.plans.queries import TRIM_NAMES

    text = lambda x: "'" + x.replace("'", "''") + "'"
    names = ", ".join(map(text, TRIM_NAMES))
    rules = " OR ".join("(" + " AND ".join(f"regexp_matches(region, {text(p)})" for p in patterns) + (f" AND region NOT IN ({', '.join(map(text, kept))})" if kept else "") + ")" for patterns, kept in TRIM_RULES)
    # No name of the list is the one that moves, and no subtree of the test tree is one of those that go.
    assert MOVED_REGION not in TRIM_NAMES and not {0, *range(1, 6)} & set(REMOVED_SUBTREES)
    return _TREE(
        f", removed AS (SELECT up.id FROM up WHERE up.ancestor_id IN ({', '.join(map(str, REMOVED_SUBTREES))})), nm AS (SELECT id, parent_id, [{names}][id % {len(TRIM_NAMES)} + 1] AS region FROM tree), kept AS (SELECT * FROM nm WHERE id NOT IN (SELECT id FROM removed) AND NOT ({rules}))\n"
        "SELECT id, parent_id, region FROM kept WHERE id NOT IN (SELECT parent_id FROM kept WHERE parent_id IS NOT NULL)"
    )


_LEVERAGE = ", t AS (SELECT h.net, h.node, (a.k - b.k) / nullif(a.k + b.k, 0) AS term FROM half h JOIN k a ON h.net = a.net AND h.node = a.node JOIN k b ON h.net = b.net AND h.other = b.node)"
_LEVERAGE_OUT = f"SELECT n.net, n.node, {six('CASE WHEN count(term) = 0 OR count(term) < count(t.net) THEN -1.0 ELSE avg(term) END')} AS leverage FROM nodes n LEFT JOIN t ON n.net = t.net AND n.node = t.node GROUP BY n.net, n.node"
_LEVELED = PARTITIONS + """,
m1 AS (SELECT 'p' || part AS net, 1 AS level, node, comm % 2 AS comm FROM parts UNION ALL SELECT 'p' || part, 2, node, CASE WHEN part <= 3 THEN comm ELSE comm % 2 END FROM parts)"""
ORACLE_SQL |= {
    "clean_data_zeros": sql(
        ACT + ", v AS (SELECT net, sample, region, CASE WHEN value >= 20 THEN value END AS value FROM act), k AS (SELECT *, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) OVER w AS gone, avg(value) OVER w AS mean FROM v WINDOW w AS (PARTITION BY net, region))",
        f"SELECT net, sample, region, {six('coalesce(value, mean)')} AS value FROM k WHERE gone < 0.25",
    ),
    "norm_max_diagonal": sql(EDGES, f"SELECT net, src, dst, {six('4 * r / greatest(1.0, max(4 * r) OVER (PARTITION BY net))')} AS r, n FROM edges"),
    "leverage_strength": sql(GRAPH + ", k AS (SELECT net, node, sum(abs(weight)) AS k FROM half GROUP BY ALL)" + _LEVERAGE, _LEVERAGE_OUT),
    "leverage_degree": sql(GRAPH + ", k AS (SELECT net, node, CAST(count(*) AS DOUBLE) AS k FROM half GROUP BY ALL)" + _LEVERAGE, _LEVERAGE_OUT),
    "drop_layer_1": _TREE(", ly AS (SELECT id, parent_id, region || ', layer ' || (id % 4) AS region FROM tree)\nSELECT id, parent_id, region FROM ly WHERE NOT (region LIKE '%layer 1%' AND id IN (SELECT id FROM up WHERE ancestor_id = 2))"),
    "trim_default_rules": _trimmed(),
    "color_annotation": _TREE(
        ", pl AS (SELECT id, parent_id, dense_rank() OVER (ORDER BY parent_id) AS place FROM tree WHERE parent_id IS NOT NULL)\n"
        "SELECT id, parent_id, 'hsl(' || CAST(floor((1987.0::DOUBLE + place * 137.508::DOUBLE) % 360) AS INTEGER) || ',65%,50%)' AS color, ['red', 'green', 'blue'][(place - 1) % 3 + 1] AS of_palette FROM pl"
    ),
    "rename_tree": _TREE("SELECT id, parent_id, regexp_replace(region, '[-# ]', '.', 'g') AS region FROM tree"),
    "level_order": "SELECT o_orderstatus || '.' || o_orderpriority AS level, CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderstatus) AS INTEGER) AS level_idx FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)",
    "group_ami_levels": sql(
        _LEVELED + ", pp AS (SELECT x.level, x.net AS a, y.net AS b, x.comm AS c1, y.comm AS c2 FROM m1 x JOIN m1 y ON x.level = y.level AND x.node = y.node AND x.net < y.net)," + _ami("pp", "level, a, b"),
        _ami_out("level, a, b"),
    ),
    "group_ami_pairs": sql(
        PARTITIONS + ", tg AS (SELECT 'p' || x.part AS net, x.node AS n1, y.node AS n2, CAST(x.comm = y.comm AS INTEGER) AS same FROM parts x JOIN parts y ON x.part = y.part), pp AS (SELECT 1 AS level, x.net AS a, y.net AS b, x.same AS c1, y.same AS c2 FROM tg x JOIN tg y ON x.n1 = y.n1 AND x.n2 = y.n2 AND x.net < y.net)," + _ami("pp", "level, a, b"),
        _ami_out("level, a, b"),
    ),
    "anogva_test": f"SELECT {six('k * CAST(0.02 AS DOUBLE)')} AS alpha, true AS is_share, true AS grows FROM (SELECT unnest(range(51)) AS k)",
}
_FILES = """,
files AS (SELECT DISTINCT net, sample, sample || '/e_' || net || '_L_' || CASE WHEN net = 'A' THEN 'fos' ELSE 'arc' END || '_ctl_Annotated_counts.csv' AS file FROM counts),
summed AS (SELECT net, sample, ancestor_id AS id, sum(value) AS value FROM counts JOIN up USING (id) GROUP BY ALL),
grid AS (
  SELECT f.file AS sample, regexp_replace(t.region, '[-# ]', '.', 'g') AS region, coalesce(s.value, 0.0) AS value
  FROM files f CROSS JOIN tree t LEFT JOIN summed s ON s.net = f.net AND s.sample = f.sample AND s.id = t.id)"""
ORACLE_SQL |= {
    "ingest_files": _TREE(_FILES + f"\nSELECT sample, region, {six('value')} AS value FROM grid"),
    "ingest_kept": _TREE(_FILES + f"""
SELECT sample, region, {six('value')} AS value FROM (SELECT *, sum(value) OVER (PARTITION BY region) AS s FROM grid)
WHERE s > 0 AND (region = 'root' OR region IN (SELECT regexp_replace(n_name, '[-# ]', '.', 'g') FROM nation))"""),
    "ingest_samples": _TREE(_FILES + """
SELECT file AS sample, 'e' AS experiment, net AS subject, 'L' AS hemisphere, CASE WHEN net = 'A' THEN 'fos' ELSE 'arc' END AS signal, 'ctl' AS "group",
  CAST(CASE WHEN net = 'A' THEN 1 ELSE 2 END AS INTEGER) AS signal_level FROM files"""),
}
ORACLE_SQL |= {
    "tree_closure": _TREE("SELECT id, ancestor_id, depth FROM up"),
    "tree_closure_chain": """
SELECT c_custkey AS id, c_custkey % 300 + 1 AS ancestors, CAST(c_custkey % 300 AS INTEGER) AS depth, c_custkey - c_custkey % 300 AS top FROM customer""",
}
