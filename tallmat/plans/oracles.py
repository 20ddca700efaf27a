"""The registered queries in plain SQL, over whole tables, for comparison in another engine.

Written from the definitions on the dense matrix, without the shortcuts of the Spark operators.
"""

from __future__ import annotations

from tallmat.plans.registry import MAD_LIMIT, N_HVG, PIVOT_GENES, REGIONS, SEGMENTS, TOP_CLUSTER

_GENE = """gene AS (SELECT p_partkey,
  CASE WHEN p_type = 'PROMO' AND p_size <= 25 THEN 'ERCC-' || p_size
       WHEN p_type = 'SMALL' AND p_size <= 15 THEN 'MT-' || p_size
       WHEN p_type = 'LARGE' AND p_size = 1 THEN 'AMT-1'
       ELSE p_type || '-' || p_size END AS variable
  FROM part)"""
_CUSTOMERS = """nz AS (SELECT 'C-' || o_custkey AS cell, variable, CAST(sum(l_quantity) AS BIGINT) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN gene ON l_partkey = p_partkey GROUP BY 1, 2)"""
_SUPPLIERS = """nz AS (SELECT 'S-' || l_suppkey AS cell, variable, CAST(sum(l_quantity) AS BIGINT) AS value
  FROM lineitem JOIN gene ON l_partkey = p_partkey GROUP BY 1, 2)"""
_TALL = """tall AS (SELECT cell, variable, coalesce(value, 0) AS value
  FROM (SELECT DISTINCT cell FROM nz) CROSS JOIN (SELECT DISTINCT variable FROM nz) LEFT JOIN nz USING (cell, variable))"""


def _qc_cells(match: str = "contains") -> str:
    start = "%" if match == "contains" else ""
    ercc, mito = f"lower(variable) LIKE '{start}ercc%'", f"lower(variable) LIKE '{start}mt%'"
    return f"""qc_cells AS (SELECT cell, sum_of_all_entries, average_of_sum, total_number_of_columns,
  total_number_of_ERCC_entry, sum_of_ercc, total_number_of_MT_entry, sum_of_mt,
  sum_of_ercc / nullif(sum_of_all_entries, 0) * 100 AS percentage_of_ercc,
  sum_of_mt / nullif(sum_of_all_entries, 0) * 100 AS percentage_of_mt,
  ln(1 + sum_of_all_entries) AS log1p_of_sum_of_all_entries,
  ln(1 + sum_of_ercc) AS log1p_of_sum_of_ercc, ln(1 + sum_of_mt) AS log1p_of_sum_of_mt
  FROM (SELECT cell, CAST(sum(value) AS BIGINT) AS sum_of_all_entries, avg(value) AS average_of_sum,
    CAST(count(*) FILTER (value > 0) AS BIGINT) AS total_number_of_columns,
    CAST(count(*) FILTER (value > 0 AND {ercc}) AS BIGINT) AS total_number_of_ERCC_entry,
    CAST(sum(CASE WHEN {ercc} THEN value ELSE 0 END) AS BIGINT) AS sum_of_ercc,
    CAST(count(*) FILTER (value > 0 AND {mito}) AS BIGINT) AS total_number_of_MT_entry,
    CAST(sum(CASE WHEN {mito} THEN value ELSE 0 END) AS BIGINT) AS sum_of_mt
    FROM tall GROUP BY cell))"""


_QC_GENES = """qc_genes AS (SELECT gene_name, no_cells_by_counts, sum_of_cells, mean_counts, no_of_dropouts,
  no_of_dropouts / nullif(no_of_dropouts + no_cells_by_counts, 0) * 100 AS pct_dropout_by_counts,
  ln(1 + mean_counts) AS log1p_of_mean_counts, ln(1 + sum_of_cells) AS log1p_total_counts
  FROM (SELECT variable AS gene_name, CAST(count(*) FILTER (value > 0) AS BIGINT) AS no_cells_by_counts,
    CAST(sum(value) AS BIGINT) AS sum_of_cells, avg(value) AS mean_counts,
    CAST(count(*) FILTER (value = 0) AS BIGINT) AS no_of_dropouts
    FROM tall GROUP BY variable))"""


def _flags(ercc: bool = True, mito: bool = False) -> str:
    cell = ["total_number_of_columns < 10", "sum_of_all_entries < 1000"]
    cell += ["coalesce(percentage_of_ercc >= 10, false)"] if ercc else []
    cell += ["coalesce(percentage_of_mt >= 5, false)"] if mito else []
    return f"""cell_flags AS (SELECT cell, {' OR '.join(cell)} AS removed FROM qc_cells),
gene_flags AS (SELECT gene_name AS variable,
  coalesce(pct_dropout_by_counts > 90, false) OR no_cells_by_counts < 5 AS removed FROM qc_genes)"""


_IN_CELLS = "cell IN (SELECT cell FROM cell_flags WHERE NOT removed)"
_IN_GENES = "variable IN (SELECT variable FROM gene_flags WHERE NOT removed)"
_FILTERED = f"flt AS (SELECT * FROM tall WHERE {_IN_CELLS} AND {_IN_GENES})"


def _with(*parts: str, cells: str = _CUSTOMERS) -> str:
    return "WITH " + ",\n".join([_GENE, cells, _TALL, *parts]) + "\n"


def _filtered_with(*parts: str, ercc: bool = True, mito: bool = False) -> str:
    return _with(_qc_cells(), _QC_GENES, _flags(ercc, mito), _FILTERED, *parts)


def _global(source: str) -> str:
    return f"""norm AS (SELECT cell, variable, ln(1 + 10000 * (value / nullif(total, 0))) AS norm_value, value
  FROM {source} JOIN (SELECT cell, sum(value) AS total FROM {source} GROUP BY cell) USING (cell))"""


def _round(*names: str, places: int = 6) -> str:
    return ", ".join(f"round({name}, {places}) + 0.0 AS {name}" for name in names)


_CELL_COLUMNS = (
    "SELECT cell, sum_of_all_entries, total_number_of_columns, total_number_of_ERCC_entry, sum_of_ercc, "
    "total_number_of_MT_entry, sum_of_mt, "
    + _round(
        "average_of_sum", "percentage_of_ercc", "percentage_of_mt",
        "log1p_of_sum_of_all_entries", "log1p_of_sum_of_ercc", "log1p_of_sum_of_mt",
    )
    + " FROM qc_cells"
)
_GENE_COLUMNS = (
    "SELECT gene_name, no_cells_by_counts, sum_of_cells, no_of_dropouts, "
    + _round("mean_counts", "pct_dropout_by_counts", "log1p_of_mean_counts", "log1p_total_counts")
    + " FROM qc_genes"
)


def _histogram(source: str, column: str, bins: int) -> str:
    return f"""span AS (SELECT min({column}) AS low, max({column}) AS high FROM {source}),
edges AS (SELECT CASE WHEN low = high THEN low - 0.5 ELSE low END AS low,
  CASE WHEN low = high THEN high + 0.5 ELSE high END AS high FROM span),
binned AS (SELECT least({bins}, 1 + floor(({column} - low) / (high - low) * {bins})) AS bin FROM {source}, edges
  WHERE {column} IS NOT NULL)
SELECT CAST(g.bin AS INTEGER) AS bin, round(low + (g.bin - 1) * ((high - low) / {bins}), 6) + 0.0 AS lower,
  round(low + g.bin * ((high - low) / {bins}), 6) + 0.0 AS upper,
  CAST((SELECT count(*) FROM binned b WHERE b.bin = g.bin) AS BIGINT) AS n
FROM generate_series(1, {bins}) g(bin), edges"""


def _quantile_norm(source: str, group: str) -> str:
    return f"""kept AS (SELECT * FROM {source} WHERE lower(variable) NOT LIKE '%ercc%'),
ranked AS (SELECT cell, variable, value,
  row_number() OVER (PARTITION BY {group} ORDER BY value) AS position,
  rank() OVER (PARTITION BY {group} ORDER BY value) AS tie FROM kept),
means AS (SELECT position, avg(value) AS norm_value FROM ranked GROUP BY position),
norm AS (SELECT cell, variable, value, norm_value FROM ranked LEFT JOIN means ON tie = means.position)"""


def _quantile(source: str, group: str) -> str:
    return _quantile_norm(source, group) + f" SELECT cell, variable, {_round('norm_value')} FROM norm"


_STATS = """stats AS (SELECT variable, avg(norm_value) AS mean, stddev_samp(norm_value) AS sd,
  var_samp(norm_value) AS var, stddev_samp(norm_value) / nullif(avg(norm_value), 0) AS co_var,
  power(stddev_samp(norm_value) / nullif(avg(norm_value), 0), 2) AS CV2,
  median(norm_value) AS median, mad(norm_value) AS MAD FROM norm GROUP BY variable)"""
_STATS_COLUMNS = "SELECT variable, " + _round("mean", "sd", "var", "co_var", "CV2", "median", "MAD") + " FROM stats"


def _cv2(order: str) -> str:
    by = "CV2 DESC NULLS LAST" if order == "desc" else "CV2 ASC NULLS FIRST"
    return f"""top AS (SELECT variable, CV2, CAST(row_number() OVER (ORDER BY {by}, variable) AS INTEGER) AS rank
  FROM stats QUALIFY rank <= {N_HVG})"""


_P = """CASE WHEN t_test IS NULL THEN NULL
  WHEN df = 1 THEN 1 - 2 / pi() * th
  WHEN df % 2 = 0 THEN 1 - sin(th) * (SELECT sum(exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * power(cos(th), 2 * j))
    FROM generate_series(0, df // 2 - 1) g(j))
  ELSE 1 - 2 / pi() * (th + sin(th) * cos(th) * (SELECT sum(sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5))
    * power(cos(th), 2 * j)) FROM generate_series(0, (df - 3) // 2) g(j))) END"""


def _de(clusters: str) -> str:
    return f"""lab AS (SELECT tall.*, c_mktsegment AS prediction FROM tall
  LEFT JOIN customer ON cell = 'C-' || c_custkey),
picked AS ({clusters}),
moments AS (SELECT picked.prediction, variable,
  count(*) FILTER (lab.prediction = picked.prediction) AS in_size,
  avg(value) FILTER (lab.prediction = picked.prediction) AS in_mean,
  stddev_samp(value) FILTER (lab.prediction = picked.prediction) AS in_sd,
  count(*) FILTER (lab.prediction IS DISTINCT FROM picked.prediction) AS out_size,
  avg(value) FILTER (lab.prediction IS DISTINCT FROM picked.prediction) AS out_mean,
  stddev_samp(value) FILTER (lab.prediction IS DISTINCT FROM picked.prediction) AS out_sd
  FROM lab, picked GROUP BY 1, 2),
pooled AS (SELECT *, in_size + out_size - 2 AS df,
  sqrt(((in_size - 1) * in_sd * in_sd + (out_size - 1) * out_sd * out_sd) / nullif(in_size + out_size - 2, 0)) AS sdp
  FROM moments),
tested AS (SELECT *, (in_mean - out_mean) / nullif(sdp * sqrt(1 / in_size + 1 / out_size), 0) AS t_test FROM pooled),
angles AS (SELECT *, atan(abs(t_test) / sqrt(df)) AS th FROM tested),
de AS (SELECT *, {_P} AS p_val FROM angles)"""


_ONE = f"SELECT '{TOP_CLUSTER}' AS prediction"
_ALL = "SELECT DISTINCT prediction FROM lab WHERE prediction IS NOT NULL"
_DE_COLUMNS = (
    "SELECT variable, CAST(in_size AS BIGINT) AS in_size, CAST(out_size AS BIGINT) AS out_size, CAST(df AS BIGINT) AS df, "
    + _round("in_mean", "in_sd", "out_mean", "out_sd", "sdp", "t_test", "p_val")
    + " FROM de"
)
# One gene set and one df per cluster, so ordering by |t| is ordering by p.
_DE_RANK = """SELECT {keys}variable, round(t_test, 6) + 0.0 AS t_test, round(p_val, 6) + 0.0 AS p_val,
  CAST(row_number() OVER (PARTITION BY prediction ORDER BY abs(t_test) DESC, variable) AS INTEGER) AS rank
FROM de WHERE p_val <= 0.05 QUALIFY rank <= 10"""

_POINTS = "pts AS (SELECT vec_id AS cell, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def _knn(k: int) -> str:
    return f"""{_POINTS},
knn AS (SELECT a.cell, b.cell AS neighbor, list_distance(a.v, b.v) AS distance,
  row_number() OVER (PARTITION BY a.cell ORDER BY list_distance(a.v, b.v), b.cell) AS rank
  FROM pts a JOIN pts b ON a.cell <> b.cell QUALIFY rank <= {k})"""


_FUZZY = """lists AS (SELECT cell, coalesce(min(distance) FILTER (distance > 0), 0) AS rho, list(distance) AS ds
  FROM knn GROUP BY cell),
bisect AS (SELECT cell, [greatest(d - rho, 0.0) FOR d IN ds] AS ds, 0 AS step, 0.0::DOUBLE AS low,
  'infinity'::DOUBLE AS high, 1.0::DOUBLE AS mid FROM lists
  UNION ALL
  SELECT cell, ds, step + 1,
    CASE WHEN list_sum([exp(-d / mid) FOR d IN ds]) > log2(len(ds)) THEN low ELSE mid END,
    CASE WHEN list_sum([exp(-d / mid) FOR d IN ds]) > log2(len(ds)) THEN mid ELSE high END,
    CASE WHEN list_sum([exp(-d / mid) FOR d IN ds]) > log2(len(ds)) THEN (low + mid) / 2
         WHEN high = 'infinity'::DOUBLE THEN mid * 2 ELSE (mid + high) / 2 END
  FROM bisect WHERE step < 64),
fuzzy AS (SELECT knn.cell, neighbor, exp(-greatest(distance - rho, 0.0) / mid) AS weight
  FROM knn JOIN lists USING (cell) JOIN bisect USING (cell) WHERE step = 64)"""

_AFFINITY = """lists AS (SELECT cell, min(distance) AS nearest, list(distance) AS ds FROM knn GROUP BY cell),
bisect AS (SELECT cell, [d * d - nearest * nearest FOR d IN ds] AS ds, 0 AS step, 0.0::DOUBLE AS low,
  'infinity'::DOUBLE AS high, 1.0::DOUBLE AS mid FROM lists
  UNION ALL
  SELECT cell, ds, step + 1,
    CASE WHEN h < log2(30) THEN low ELSE mid END, CASE WHEN h < log2(30) THEN mid ELSE high END,
    CASE WHEN h < log2(30) THEN (low + mid) / 2 WHEN high = 'infinity'::DOUBLE THEN mid * 2 ELSE (mid + high) / 2 END
  FROM (SELECT *, log2(list_sum([exp(-mid * d) FOR d IN ds])) + mid * list_sum([d * exp(-mid * d) FOR d IN ds])
      / (list_sum([exp(-mid * d) FOR d IN ds]) * ln(2)) AS h FROM bisect WHERE step < 64)),
scaled AS (SELECT knn.cell, neighbor, exp(-mid * (distance * distance - nearest * nearest)) AS w
  FROM knn JOIN lists USING (cell) JOIN bisect USING (cell) WHERE step = 64),
affinity AS (SELECT cell, neighbor, w / sum(w) OVER (PARTITION BY cell) AS p FROM scaled)"""


def oracle_sql() -> dict[str, str]:
    """One statement per query that SQL can express."""
    qc = (_qc_cells(), _QC_GENES)
    flat = "SELECT cell, variable, value FROM {} WHERE value <> 0"
    cells_sql = _with(_qc_cells()) + _CELL_COLUMNS
    genes_sql = _with(_QC_GENES) + _GENE_COLUMNS
    de_sql = _with(_de(_ONE)) + _DE_COLUMNS
    sql = {
        "qc_cells": cells_sql,
        "qc_cells_dense": cells_sql,
        "qc_cells_prefix": _with(_qc_cells("prefix")) + _CELL_COLUMNS,
        "qc_genes": genes_sql,
        "qc_genes_dense": genes_sql,
        "stage_round_trip": genes_sql,
        "filter_default": _filtered_with() + flat.format("flt"),
        "filter_mito": _filtered_with(mito=True) + flat.format("flt"),
        "filter_no_markers": _filtered_with(ercc=False) + flat.format("flt"),
        "filter_genes_only": _with(*qc, _flags()) + flat.format("tall") + f" AND {_IN_GENES}",
        "filter_cells_only": _with(*qc, _flags(mito=True)) + flat.format("tall") + f" AND {_IN_CELLS}",
        "filter_dense": _filtered_with() + "SELECT cell, variable, value FROM flt",
        "removal_report": _with(*qc, _flags())
        + """SELECT 'cells' AS axis, CAST(count(*) FILTER (removed) AS BIGINT) AS removed, count(*) AS total FROM cell_flags
UNION ALL SELECT 'genes', CAST(count(*) FILTER (removed) AS BIGINT), count(*) FROM gene_flags""",
        "shape_counts": _filtered_with()
        + "SELECT count(DISTINCT cell) AS cells, count(DISTINCT variable) AS genes FROM flt WHERE value <> 0",
        "hist_total_counts": _with(_qc_cells(), _histogram("qc_cells", "sum_of_all_entries", 50)),
        "hist_dropouts": _with(_QC_GENES, _histogram("qc_genes", "pct_dropout_by_counts", 100)),
        "melt_qc_wide": _with(_qc_cells())
        + "\nUNION ALL\n".join(
            f"SELECT cell, '{name}' AS variable, round(CAST({name} AS DOUBLE), 6) + 0.0 AS value FROM qc_cells"
            for name in ("sum_of_all_entries", "sum_of_ercc", "sum_of_mt", "percentage_of_ercc")
        ),
        "pivot_marker_genes": _with()
        + "SELECT cell, "
        + ", ".join(
            f"coalesce(max(value) FILTER (variable = '{gene}'), 0) AS \"{gene}\"" for gene in PIVOT_GENES
        )
        + " FROM tall GROUP BY cell",
        "transpose_small": _with()
        + "SELECT replace(r_name, ' ', '_') AS r_name, "
        + ", ".join(f"CAST(sum(value) FILTER (c_mktsegment = '{name}') AS BIGINT) AS {name}" for name in SEGMENTS)
        + f""" FROM nz JOIN customer ON cell = 'C-' || c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ({', '.join(f"'{name}'" for name in REGIONS)}) GROUP BY 1""",
        "densify": _with() + "SELECT cell, variable, value FROM tall",
        "sparsify": _with() + "SELECT cell, variable, value FROM nz",
        "clean_labels": r"""SELECT p_partkey,
  regexp_replace(p_name || ' (' || p_brand || '.v1)' || chr(9) || p_size, '[.\s()]', '_', 'g') AS label FROM part""",
        "read_cells_by_genes": _with(cells=_SUPPLIERS) + "SELECT cell, variable, value FROM tall",
        "read_genes_by_cells": _with(cells=_SUPPLIERS) + "SELECT cell, variable, value FROM tall",
        "read_sparse": _with(_QC_GENES, cells=_SUPPLIERS) + _GENE_COLUMNS,
        "metadata_round_trip": """SELECT replace(c_name, ' ', '_') || '__v_1_' AS cell, c_mktsegment AS sp_nme,
  CAST(c_nationkey AS INTEGER) AS nation__key_ FROM customer""",
        "norm_global": _filtered_with(_global("flt"))
        + f"SELECT cell, variable, {_round('norm_value')} FROM norm WHERE value <> 0",
        "norm_global_dense": _with(_global("tall")) + f"SELECT cell, variable, {_round('norm_value')} FROM norm",
        "norm_quantile": _filtered_with(_quantile("flt", "variable")),
        "norm_quantile_sparse": _filtered_with(_quantile("flt", "variable")),
        "norm_quantile_entries": _filtered_with(_quantile("flt", "variable")) + " WHERE value <> 0",
        "hvg_stats_quantile": _filtered_with(_quantile_norm("flt", "variable"), _STATS) + _STATS_COLUMNS,
        "norm_quantile_dense": _with(_quantile("tall", "variable")),
        "norm_quantile_by_cell": _filtered_with(_quantile("flt", "cell")),
        "hvg_stats": _filtered_with(_global("flt"), _STATS) + _STATS_COLUMNS,
        "hvg_stats_dense": _with(_global("tall"), _STATS) + _STATS_COLUMNS,
        "hvg_cv2_desc": _filtered_with(_global("flt"), _STATS, _cv2("desc"))
        + f"SELECT variable, rank, {_round('CV2')} FROM top",
        "hvg_cv2_asc": _filtered_with(_global("flt"), _STATS, _cv2("asc"))
        + f"SELECT variable, rank, {_round('CV2')} FROM top",
        "hvg_mad_above": _with(_global("tall"), _STATS, cells=_SUPPLIERS)
        + f"SELECT variable, {_round('median', 'MAD')} FROM stats WHERE MAD > {MAD_LIMIT}",
        "hvg_mad_below": _with(_global("tall"), _STATS, cells=_SUPPLIERS)
        + f"SELECT variable, {_round('median', 'MAD')} FROM stats WHERE NOT coalesce(MAD > {MAD_LIMIT}, false)",
        "hvg_select": _filtered_with(_global("flt"), _STATS, _cv2("desc"))
        + f"SELECT cell, variable, {_round('norm_value')} FROM norm WHERE value <> 0 AND variable IN (SELECT variable FROM top)",
        "to_vectors": _with(_global("tall"), cells=_SUPPLIERS)
        + """SELECT cell, CAST(dense_rank() OVER (ORDER BY variable) - 1 AS INTEGER) AS position,
  round(norm_value, 6) + 0.0 AS value FROM norm""",
        "de_stats": de_sql,
        "de_stats_dense": de_sql,
        "de_top10_building": _with(_de(_ONE)) + _DE_RANK.format(keys=""),
        "de_all_clusters": _with(_de(_ALL)) + _DE_RANK.format(keys="prediction, "),
        "pca_total_variance": f"""WITH {_POINTS},
dims AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pts)
SELECT round(sum(var), 6) + 0.0 AS total_variance, count(*) AS components
FROM (SELECT i, var_samp(x) AS var FROM dims GROUP BY i)""",
        "vector_components": f"""WITH {_POINTS}
SELECT cell, round(v[1], 6) + 0.0 AS c0, round(v[2], 6) + 0.0 AS c1, round(v[64], 6) + 0.0 AS c63 FROM pts""",
        "prepare_features": """WITH idx AS (SELECT c_mktsegment,
  row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS i FROM customer GROUP BY 1)
SELECT c_custkey AS cell, round(c_acctbal, 6) + 0.0 AS f0, CAST(c_nationkey AS DOUBLE) AS f1, CAST(i AS DOUBLE) AS f2
FROM customer JOIN idx USING (c_mktsegment)""",
        "kmeans_k6": """SELECT count(*) AS cells, CAST(6 AS BIGINT) AS clusters, CAST(0 AS INTEGER) AS first,
  CAST(5 AS INTEGER) AS last FROM embeddings""",
        "pca_residuals": """SELECT CAST(i AS INTEGER) AS component, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS length,
  0.0::DOUBLE AS overlap FROM range(10) r(i)""",
        "pca_sparse_residuals": """SELECT CAST(i AS INTEGER) AS component, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS length,
  0.0::DOUBLE AS overlap FROM range(5) r(i)""",
        "pca_baselined_residuals": """SELECT CAST(i AS INTEGER) AS component, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS length,
  0.0::DOUBLE AS overlap FROM range(5) r(i)""",
        "pca_sparse_explained": "SELECT CAST(i AS INTEGER) AS component, 0.0::DOUBLE AS gap FROM range(5) r(i)",
        "to_sparse": _with(_global("tall"))
        + """, numbered AS (SELECT *, CAST(dense_rank() OVER (ORDER BY variable) - 1 AS INTEGER) AS position FROM norm)
SELECT c.cell, (SELECT CAST(count(DISTINCT variable) AS INTEGER) FROM norm) AS size, position, round(norm_value, 6) + 0.0 AS value
FROM (SELECT DISTINCT cell FROM norm) c LEFT JOIN numbered n ON n.cell = c.cell AND norm_value <> 0""",
        "kmeans_nearest": "SELECT count(*) AS cells, CAST(0 AS BIGINT) AS misplaced, 0.0::DOUBLE AS sse_gap FROM embeddings",
        "sweep_bounds": "SELECT CAST(k AS INTEGER) AS k, TRUE AS inside FROM range(2, 20) r(k)",
        "sweep_against_fits": """SELECT CAST(k AS INTEGER) AS k, TRUE AS sse_near, 0.0::DOUBLE AS sse_gap, 0.0::DOUBLE AS silhouette_gap
FROM (VALUES (2), (6), (19)) r(k)""",
        "silhouette_labels": f"""WITH {_POINTS},
sums AS (SELECT a.cell, a.label AS own, b.label, sum(power(list_distance(a.v, b.v), 2)) AS total, count(*) AS n
  FROM pts a, pts b GROUP BY 1, 2, 3),
near AS (SELECT cell, max(CASE WHEN label = own THEN total / nullif(n - 1, 0) END) AS a,
  min(CASE WHEN label <> own THEN total / n END) AS b FROM sums GROUP BY cell)
SELECT count(*) AS cells, round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) + 0.0 AS silhouette FROM near""",
        "cluster_sizes": "SELECT label AS prediction, count(*) AS count FROM embeddings GROUP BY 1",
        "attach_metadata": _with(_qc_cells())
        + """SELECT cell, sum_of_all_entries, c_mktsegment AS prediction FROM qc_cells
LEFT JOIN customer ON cell = 'C-' || c_custkey""",
        "knn_exact": f"""WITH {_knn(15)}
SELECT cell, neighbor, round(distance, 5) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank FROM knn""",
        "knn_approx": """SELECT count(*) AS cells, count(*) * least(15, count(*) - 1) AS edges, CAST(0 AS BIGINT) AS wrong, TRUE AS found
FROM embeddings""",
        "fuzzy_weights": f"""WITH RECURSIVE {_knn(15)}, {_FUZZY}
SELECT cell, neighbor, round(weight, 5) + 0.0 AS weight FROM fuzzy""",
        "fuzzy_graph": f"""WITH RECURSIVE {_knn(15)}, {_FUZZY},
two_way AS (SELECT cell, neighbor, weight AS a, 0.0::DOUBLE AS b FROM fuzzy
  UNION ALL SELECT neighbor, cell, 0.0::DOUBLE, weight FROM fuzzy)
SELECT cell, neighbor, round(sum(a) + sum(b) - sum(a) * sum(b), 5) + 0.0 AS weight FROM two_way GROUP BY 1, 2""",
        "perplexity_affinities": f"""WITH RECURSIVE {_knn(90)}, {_AFFINITY}
SELECT cell, neighbor, round(p, 5) + 0.0 AS p FROM affinity""",
        "perplexity_joint": f"""WITH RECURSIVE {_knn(90)}, {_AFFINITY},
two_way AS (SELECT cell, neighbor, p FROM affinity UNION ALL SELECT neighbor, cell, p FROM affinity),
joint AS (SELECT cell, neighbor, sum(p) / (2 * (SELECT count(*) FROM pts)) AS p FROM two_way GROUP BY 1, 2)
SELECT cell, round(sum(p), 5) + 0.0 AS p, count(*) AS edges FROM joint GROUP BY cell""",
        "workflow": _filtered_with()
        + """SELECT count(DISTINCT cell) AS cells, count(DISTINCT variable) FILTER (value <> 0) AS genes,
  CAST(6 AS BIGINT) AS clusters FROM flt""",
    }
    return sql
