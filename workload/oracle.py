"""SQL that gives the same rows as the registered queries, by the plainest means (full windows, self joins).

Rounds, sweeps and baselines are checked with a family that takes one gradient step a fit. Fitted models are
checked by their optimality conditions and falling losses; networks, forests and the text summary by tests.
"""

from __future__ import annotations

import numpy as np

NUMS = ("o_totalprice", "c_acctbal", "sum_qty", "sum_price", "avg_disc", "avg_tax", "ret_qty")
# The category levels of the driver's tables.
LEVELS = {
    "o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
    "o_orderstatus": ("F", "O", "P"),
    "c_mktsegment": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
}
SUMS = ("o_totalprice", "c_acctbal", "sum_qty", "sum_price", "ret_qty")
SEED, LR = 42, 0.1


def q(name: str) -> str:
    return f'"{name}"'


def ctes(**parts: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items()) + "\n"


def md5(seed: str, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}))"


def h32(seed: str, *keys: str) -> str:
    return f"CAST(('0x' || substr({md5(seed, *keys)}, 1, 8)) AS BIGINT)"


RAW = """
SELECT o_orderkey, n_regionkey, n_nationkey, o_custkey,
  CAST(coalesce(line_cnt, 0) >= 6 AS INTEGER) AS many_lines, o_totalprice, c_acctbal,
  coalesce(sum_qty, 0.0) AS sum_qty, coalesce(sum_price, 0.0) AS sum_price, coalesce(avg_disc, 0.0) AS avg_disc,
  coalesce(avg_tax, 0.0) AS avg_tax, coalesce(ret_qty, 0.0) AS ret_qty, o_orderpriority, o_orderstatus, c_mktsegment
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (
  SELECT l_orderkey, count(*) AS line_cnt, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_price,
    avg(l_discount) AS avg_disc, avg(l_tax) AS avg_tax,
    sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) AS ret_qty
  FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
"""
RISK = f"""
SELECT CAST(o_orderkey AS BIGINT) AS row_id, n_regionkey AS client_id, CAST(o_custkey AS INTEGER) AS customer,
  many_lines AS label, {', '.join(NUMS)}, {', '.join(LEVELS)}
FROM raw
"""
SPLIT = f"""
SELECT *, CASE WHEN rk < n - temp THEN 'train' WHEN rk < n - val THEN 'test' ELSE 'val' END AS split
FROM (SELECT *, CAST(ceil(temp * (CAST(1.0 AS DOUBLE) / 3)) AS BIGINT) AS val
  FROM (SELECT *, CAST(ceil(CAST(0.3 AS DOUBLE) * n) AS BIGINT) AS temp
    FROM (SELECT *, count(*) OVER (PARTITION BY client_id) AS n,
        row_number() OVER (PARTITION BY client_id ORDER BY {md5('42-split', 'row_id')}, row_id) - 1 AS rk
      FROM risk)))
"""
ENCODED = "SELECT *, " + ", ".join(
    f"CASE WHEN {c} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {q(f'{c}_{v}')}" for c, vs in LEVELS.items() for v in vs
) + " FROM {source}"
ONE_HOT_NAMES = [f"{c}_{v}" for c, vs in LEVELS.items() for v in vs]
STATS = "SELECT client_id, " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) <= 2.220446049250313e-15 * greatest(abs(avg({c})), 1.0) "
    f"THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in NUMS
) + " FROM split WHERE split = 'train' GROUP BY client_id"


def scaled(source: str = "split", extra: str = "") -> str:
    cols = ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in NUMS)
    return f"SELECT row_id, client_id, split, label, {cols}{extra} FROM {source} JOIN stats USING (client_id)"


BASE = dict(raw=RAW, risk=RISK)
SPLITTED = dict(**BASE, split=SPLIT)
SCALED = dict(**SPLITTED, stats=STATS, scaled=scaled())
RATED = dict(**BASE, rated="""
SELECT *, CAST(prob > 0.5 AS INTEGER) AS pred
FROM (SELECT row_id, label, client_id, customer, 1.0 / (1.0 + exp(-((sum_qty - 130.0) / 30.0))) AS prob FROM risk)
""")

ORACLE: dict[str, str] = {}


def report(source: str, keys: tuple[str, ...]) -> dict[str, str]:
    """CTEs that end in ``report`` (keys..., class, metric, value)."""
    k = ", ".join(keys)
    per_class = f"""
SELECT {k}, c, sum(tp) AS tp, sum(actual) AS support, sum(said) AS said,
  coalesce(sum(tp) / nullif(CAST(sum(said) AS DOUBLE), 0), 0) AS p,
  coalesce(sum(tp) / nullif(CAST(sum(actual) AS DOUBLE), 0), 0) AS r,
  coalesce(2.0 * sum(tp) / nullif(CAST(sum(said) + sum(actual) AS DOUBLE), 0), 0) AS f
FROM (SELECT {k}, label AS c, CAST(label = pred AS INTEGER) AS tp, 1 AS actual, 0 AS said FROM {source}
  UNION ALL SELECT {k}, pred, 0, 0, 1 FROM {source})
GROUP BY {k}, c"""
    totals = f"""
SELECT {k}, sum(support) AS support, sum(tp) / CAST(sum(support) AS DOUBLE) AS acc, avg(p) AS mp, avg(r) AS mr,
  avg(f) AS mf, sum(p * support) / sum(support) AS wp, sum(r * support) / sum(support) AS wr,
  sum(f * support) / sum(support) AS wf
FROM per_class GROUP BY {k}"""
    rows = [("per_class", "CAST(c AS VARCHAR)", m, e) for m, e in
            (("precision", "p"), ("recall", "r"), ("f1-score", "f"), ("support", "support"))]
    rows += [("totals", "''", "accuracy", "acc")]
    rows += [("totals", f"'{kind} avg'", m, e) for kind, pre in (("macro", "m"), ("weighted", "w"))
             for m, e in (("precision", pre + "p"), ("recall", pre + "r"), ("f1-score", pre + "f"), ("support", "support"))]
    union = " UNION ALL ".join(
        f"SELECT {k}, {cls} AS class, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM {src}" for src, cls, m, e in rows)
    return dict(per_class=per_class, totals=totals, report=union)


def with_report(source: str, keys: tuple[str, ...], base: dict[str, str]) -> dict[str, str]:
    return {**base, **report(source, keys)}


FLAT = "CASE WHEN class = '' THEN metric ELSE class || '_' || metric END"

# ---- sources -------------------------------------------------------------------------------------
ORACLE["scan_table"] = "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer"
ORACLE["risk_table"] = ctes(raw=RAW) + """
SELECT * REPLACE (round(sum_price, 6) AS sum_price, round(avg_disc, 6) AS avg_disc, round(avg_tax, 6) AS avg_tax) FROM raw"""

# ---- projections ---------------------------------------------------------------------------------
ORACLE["clean"] = ctes(raw=RAW) + \
    "SELECT o_orderkey AS row_id, many_lines AS label, n_regionkey, o_totalprice, sum_qty FROM raw"
ORACLE["one_hot"] = ctes(**BASE, enc=ENCODED.format(source="risk")) + \
    f"SELECT row_id, label, o_totalprice, {', '.join(q(n) for n in ONE_HOT_NAMES)} FROM enc"
ORACLE["select_columns"] = ctes(**BASE) + "SELECT row_id, client_id, label, sum_qty, o_totalprice FROM risk"
LONG = " UNION ALL ".join(f"SELECT label, '{c}' AS feature, {c} AS x FROM risk" for c in NUMS)
ORACLE["select_kbest"] = ctes(
    **BASE, long=LONG,
    cls="SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY feature, label",
    grand="SELECT feature, avg(x) AS g, count(*) AS total FROM long GROUP BY feature",
    score="""SELECT feature, (sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(n * v) / (max(total) - count(*))) AS f
      FROM cls JOIN grand USING (feature) GROUP BY feature""",
    best="SELECT feature FROM score ORDER BY f DESC LIMIT 4",
) + "SELECT feature, round(avg(x), 4) AS mean FROM long JOIN best USING (feature) GROUP BY feature"
ORACLE["align_columns"] = ctes(**BASE) + "SELECT row_id, sum_qty, label FROM risk"
ORACLE["feature_columns"] = ctes(**BASE) + \
    f"SELECT row_id, {', '.join(f'round({c}, 6) AS {c}' for c in NUMS)} FROM risk"
ORACLE["split_xy"] = ctes(**BASE, enc=ENCODED.format(source="risk"), long=" UNION ALL ".join(
    f"SELECT label, {i} AS pos, {q(c)} AS x FROM enc" for i, c in enumerate([*NUMS, *ONE_HOT_NAMES])
)) + "SELECT label, pos, count(*) AS n, round(avg(x), 4) AS mean FROM long GROUP BY label, pos"
ORACLE["pick_silo"] = ctes(**BASE) + "SELECT row_id, client_id, label, o_totalprice FROM risk WHERE client_id = 2"
ORACLE["threshold"] = ctes(**RATED) + "SELECT row_id, pred FROM rated"

# ---- silos and splits ----------------------------------------------------------------------------
ORACLE["hash_rank"] = ctes(**BASE) + f"""
SELECT row_id, client_id, row_number() OVER (PARTITION BY client_id ORDER BY {md5('42', 'row_id')}, row_id) - 1 AS hash_rank
FROM risk"""


def dirichlet_sql(n_silos: int = 5, alpha: float = 10.0, seed: int = 42) -> str:
    """The first draw's shares as literals; label 0 is placed first, then label 1 in silos below average."""
    rng = np.random.default_rng(seed)
    a, b = rng.dirichlet([alpha] * n_silos), rng.dirichlet([alpha] * n_silos)
    lit = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    running = lambda names: [" + ".join(names[:i + 1]) for i in range(n_silos)]
    ends0 = [f"CAST(floor(({s}) * n0) AS BIGINT)" for s in running([f"a{i}" for i in range(n_silos)])]
    counts = "SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) AS n FROM risk"
    # Shares are divided by their sum before they are accumulated, as the draw does.
    shares = "SELECT *, " + ", ".join(f"{lit(v)} / {lit(a.sum())} AS a{i}" for i, v in enumerate(a)) + " FROM counts"
    first = "SELECT *, " + ", ".join(
        f"{e if i < n_silos - 1 else 'n0'} AS e{i}" for i, e in enumerate(ends0)) + " FROM shares"
    sizes = [f"e{i}" if i == 0 else f"e{i} - e{i - 1}" for i in range(n_silos)]
    masked = "SELECT *, " + ", ".join(
        f"CASE WHEN {s} < n / {float(n_silos)!r}::DOUBLE THEN {lit(v)} ELSE 0.0 END AS r{i}"
        for i, (s, v) in enumerate(zip(sizes, b))) + " FROM first_ends"
    total = " + ".join(f"r{i}" for i in range(n_silos))
    normal = "SELECT *, " + ", ".join(f"r{i} / ({total}) AS b{i}" for i in range(n_silos)) + " FROM masked"
    ends1 = [f"CAST(floor(({s}) * n1) AS BIGINT)" for s in running([f"b{i}" for i in range(n_silos)])]
    second = "SELECT *, " + ", ".join(
        f"{e if i < n_silos - 1 else 'n1'} AS f{i}" for i, e in enumerate(ends1)) + " FROM normal"
    passed = lambda p: " + ".join(f"CAST(rk >= {p}{i} AS INTEGER)" for i in range(n_silos - 1))
    return ctes(
        **BASE, counts=counts, shares=shares, first_ends=first, masked=masked, normal=normal, ends=second,
        ranked=f"""SELECT row_id, label,
          row_number() OVER (PARTITION BY label ORDER BY {md5('42-silo', 'row_id')}, row_id) - 1 AS rk FROM risk""",
    ) + f"SELECT row_id, label, CASE WHEN label = 0 THEN {passed('e')} ELSE {passed('f')} END AS client_id FROM ranked, ends"


ORACLE["dirichlet_silos"] = dirichlet_sql()
ORACLE["split_70_20_10"] = ctes(**SPLITTED) + "SELECT row_id, client_id, split FROM split"
ORACLE["split_sizes"] = ctes(**SPLITTED) + "SELECT client_id, split, count(*) AS n FROM split GROUP BY client_id, split"
ORACLE["class_distribution"] = ctes(**SPLITTED) + \
    "SELECT client_id, split, label, count(*) AS n FROM split GROUP BY client_id, split, label"

# ---- resampling and scaling ----------------------------------------------------------------------
KEPT = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, split, label ORDER BY {md5('42-rus', 'row_id')}, row_id) AS rr
  FROM {{source}}) JOIN (SELECT client_id, min(c) AS smallest FROM
    (SELECT client_id, label, count(*) AS c FROM split WHERE split = 'train' GROUP BY client_id, label) GROUP BY client_id)
  USING (client_id)
WHERE split <> 'train' OR rr <= smallest
"""
ORACLE["undersample"] = ctes(**SPLITTED, kept=KEPT.format(source="split")) + \
    "SELECT row_id, client_id, split, label FROM kept"
ORACLE["class_weights"] = ctes(**SPLITTED, c="""
  SELECT client_id, label, count(*) AS n FROM split WHERE split = 'train' GROUP BY client_id, label""") + """
SELECT client_id, label, n, round(CAST(sum(n) OVER (PARTITION BY client_id) AS DOUBLE)
  / (count(*) OVER (PARTITION BY client_id) * n), 6) AS weight FROM c"""
ORACLE["scale_stats"] = ctes(**SPLITTED, stats=STATS) + " UNION ALL ".join(
    f"SELECT client_id, {i} AS pos, round(m_{c}, 4) AS mean, round(s_{c}, 4) AS sd FROM stats" for i, c in enumerate(NUMS))
ORACLE["standard_scale"] = ctes(**SCALED) + \
    f"SELECT row_id, client_id, split, label, {', '.join(f'round({c}, 6) AS {c}' for c in NUMS)} FROM scaled"
ORACLE["transform_chain"] = ctes(**SCALED, kept=KEPT.format(source="scaled")) + """
SELECT client_id, split, label, count(*) AS n, round(sum(sum_qty), 4) AS sum_qty, round(sum(ret_qty), 4) AS ret_qty
FROM kept GROUP BY client_id, split, label"""
ORACLE["silo_load"] = ctes(
    **SPLITTED, stats=STATS, enc=ENCODED.format(source="split"),
    full_rows=scaled("enc", ", " + ", ".join(q(n) for n in ONE_HOT_NAMES)),
    long=" UNION ALL ".join(f"SELECT client_id, split, label, {i} AS pos, {q(c)} AS x FROM full_rows"
                            for i, c in enumerate([*NUMS, *ONE_HOT_NAMES])),
) + """SELECT client_id, split, label, pos, count(*) AS n, round(sum(x), 4) AS total FROM long
GROUP BY client_id, split, label, pos"""

MINORITY = "SELECT * FROM scaled WHERE split = 'train' AND label = 1"
D2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in NUMS)
NEAR = f"""
SELECT client_id, row_id, nbr_rank, nbr_id, d2 FROM (
  SELECT client_id, row_id, nbr_id, d2, row_number() OVER (PARTITION BY client_id, row_id ORDER BY d2, nbr_id) AS nbr_rank
  FROM (SELECT a.client_id, a.row_id, b.row_id AS nbr_id, {D2} AS d2
    FROM minority a JOIN minority b ON a.client_id = b.client_id AND a.row_id <> b.row_id))
WHERE nbr_rank <= 5"""
SMOTE_PARTS = dict(
    **SCALED, minority=MINORITY, near=NEAR,
    ranked=f"""SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY {md5('42-smote', 'row_id')}, row_id) - 1 AS base
      FROM minority""",
    need="""SELECT client_id, count(*) FILTER (label = 1) AS m, count(*) FILTER (label = 0) - count(*) FILTER (label = 1) AS need
      FROM scaled WHERE split = 'train' GROUP BY client_id""",
    drawn="SELECT client_id, m, unnest(range(need)) AS j FROM need",
    draws=f"""SELECT client_id, j, {h32('42', 'client_id', '1', 'j', "'b'")} % m AS base,
      {h32('42', 'client_id', '1', 'j', "'n'")} % least(5, m - 1) + 1 AS nbr_rank,
      {h32('42', 'client_id', '1', 'j', "'g'")} / 4294967296.0::DOUBLE AS gap FROM drawn""",
)
ORACLE["knn"] = ctes(**SCALED, minority=MINORITY, near=NEAR) + \
    "SELECT client_id, row_id, CAST(nbr_rank AS INTEGER) AS nbr_rank, nbr_id, round(d2, 6) AS d2 FROM near"
ORACLE["smote"] = ctes(**SMOTE_PARTS) + f"""
SELECT client_id, -j - 1 AS row_id, 1 AS label,
  {', '.join(f'round(x.{c} + gap * (y.{c} - x.{c}), 5) AS x{i}' for i, c in enumerate(NUMS))}
FROM draws JOIN ranked x USING (client_id, base)
JOIN near USING (client_id, row_id, nbr_rank)
JOIN minority y ON y.client_id = client_id AND y.row_id = nbr_id"""
ORACLE["smote"] = ORACLE["smote"].replace("ON y.client_id = client_id AND", "ON y.client_id = draws.client_id AND")
ORACLE["smote_counts"] = ctes(**SPLITTED) + """
SELECT client_id, split, label, CASE WHEN split = 'train' THEN max(n) OVER (PARTITION BY client_id, split) ELSE n END AS n
FROM (SELECT client_id, split, label, count(*) AS n FROM split GROUP BY client_id, split, label)"""
TRAIN_ROWS = dict(**SCALED, tr="SELECT * FROM scaled WHERE split = 'train'")
ORACLE["covariance"] = ctes(**TRAIN_ROWS) + " UNION ALL ".join(
    f"SELECT client_id, {i} AS i, {j} AS j, round(covar_samp({a}, {b}), 6) AS cov FROM tr GROUP BY client_id"
    for i, a in enumerate(NUMS) for j, b in enumerate(NUMS) if i <= j)
ORACLE["pca_variance"] = ctes(**TRAIN_ROWS) + f"""
SELECT client_id, CAST({len(NUMS)} AS BIGINT) AS components, round({' + '.join(f'var_samp({c})' for c in NUMS)}, 6) AS variance
FROM tr GROUP BY client_id"""
ORACLE["embedding_pca_variance"] = """
SELECT label AS client_id, round(sum(v), 5) AS variance FROM (
  SELECT label, pos, var_samp(x) AS v FROM (
    SELECT label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
  GROUP BY label, pos) GROUP BY label"""

# ---- one step of training and scoring ------------------------------------------------------------
STEP = "SELECT client_id, " + ", ".join(
    f"avg((label - 0.5::DOUBLE) * {c}) * {LR}::DOUBLE AS w_{c}" for c in NUMS
) + f", avg(label - 0.5::DOUBLE) * {LR}::DOUBLE AS b FROM scaled WHERE split = 'train' GROUP BY client_id"
MARGIN = " + ".join(f"w_{c} * {c}" for c in NUMS) + " + b"
STEPPED = dict(**SCALED, step=STEP)
ORACLE["init_zero"] = ctes(**BASE) + f"""
SELECT 0 AS round, client_id, layer, pos, 0.0::DOUBLE AS value FROM (SELECT DISTINCT customer AS client_id FROM risk),
  (SELECT 0 AS layer, CAST(unnest(range({len(NUMS)})) AS INTEGER) AS pos UNION ALL SELECT 1, 0)"""
ORACLE["gradient_step"] = ctes(**STEPPED) + " UNION ALL ".join(
    [f"SELECT 1 AS round, client_id, 0 AS layer, {i} AS pos, round(w_{c}, 6) AS value FROM step" for i, c in enumerate(NUMS)]
    + ["SELECT 1, client_id, 1, 0, round(b, 6) FROM step"])
LOCAL = f"SELECT row_id, client_id, split, label, {MARGIN} AS margin FROM scaled JOIN step USING (client_id)"
ORACLE["predict"] = ctes(**STEPPED, loc=LOCAL) + "SELECT row_id, client_id, CAST(margin > 0 AS INTEGER) AS pred FROM loc"
ORACLE["predict_proba"] = ctes(**STEPPED, loc=LOCAL) + \
    "SELECT row_id, client_id, round(1.0 / (1.0 + exp(-margin)), 6) AS prob FROM loc"


def one_step(weight: str) -> str:
    f1 = """coalesce(2.0 * count(*) FILTER (split = 'val' AND label = 1 AND margin > 0)
      / nullif(count(*) FILTER (split = 'val' AND label = 1) + count(*) FILTER (split = 'val' AND margin > 0), 0), 0)"""
    merged = "SELECT " + ", ".join(
        f"sum({c} * wt) / sum(wt) AS {c}" for c in [*(f"w_{n}" for n in NUMS), "b"]) + " FROM step JOIN facts USING (client_id)"
    test = f"SELECT client_id, label, CAST({MARGIN} > 0 AS INTEGER) AS pred FROM scaled, merged WHERE split = 'test'"
    parts = dict(
        **STEPPED, loc=LOCAL,
        facts=f"SELECT client_id, count(*) FILTER (split = 'train') AS n_examples, {f1} AS f1 FROM loc GROUP BY client_id",
        merged=merged.replace("wt", weight), tested=test)
    return ctes(**with_report("tested", ("client_id",), parts)) + \
        "SELECT client_id, class, metric, round(value, 6) AS value FROM report"


def step_rounds(weight: str, rounds: int = 3, seed: int = SEED, pooled: bool = False) -> dict[str, str]:
    """CTEs of rounds 1..n: step_r, loc_r (scored by the silo's own step), merged_r, tested_r, rows_r (metric rows)."""
    parts = dict(SCALED) if seed == SEED else {**SCALED, "split": SPLIT.replace("42-split", f"{seed}-split")}
    if pooled:
        parts["split"] = f"SELECT * REPLACE (0 AS client_id) FROM ({parts['split']})"
    names = [*(f"w_{n}" for n in NUMS), "b"]
    x = [*NUMS, "1.0"]
    f1 = """coalesce(2.0 * count(*) FILTER (split = 'val' AND label = 1 AND margin > 0)
      / nullif(count(*) FILTER (split = 'val' AND label = 1) + count(*) FILTER (split = 'val' AND margin > 0), 0), 0)"""
    parts["merged_0"] = "SELECT " + ", ".join(f"0.0::DOUBLE AS {n}" for n in names)
    for r in range(1, rounds + 1):
        old = f"(SELECT s.*, m.*, 1.0 / (1.0 + exp(-({MARGIN}))) AS prob FROM scaled s, merged_{r - 1} m WHERE split = 'train')"
        parts[f"step_{r}"] = "SELECT client_id, " + ", ".join(
            f"max({n}) + avg((label - prob) * {v}) * {LR}::DOUBLE AS {n}" for n, v in zip(names, x)) + f" FROM {old} GROUP BY client_id"
        parts[f"loc_{r}"] = f"SELECT row_id, client_id, split, label, {MARGIN} AS margin FROM scaled JOIN step_{r} USING (client_id)"
        parts[f"facts_{r}"] = f"SELECT client_id, count(*) FILTER (split = 'train') AS n_examples, {f1} AS f1 FROM loc_{r} GROUP BY client_id"
        parts[f"merged_{r}"] = "SELECT " + ", ".join(
            f"sum({n} * {weight}) / sum({weight}) AS {n}" for n in names) + f" FROM step_{r} JOIN facts_{r} USING (client_id)"
        parts[f"tested_{r}"] = f"SELECT client_id, label, CAST({MARGIN} > 0 AS INTEGER) AS pred FROM scaled, merged_{r} WHERE split = 'test'"
        parts.update(numbered(report(f"tested_{r}", ("client_id",)), f"_{r}"))
        loss = "avg(-ln(CASE WHEN label = pred THEN 1 - 2.220446049250313e-16::DOUBLE ELSE 2.220446049250313e-16::DOUBLE END))"
        parts[f"rows_{r}"] = f"""SELECT client_id, class, metric, value FROM report_{r}
          UNION ALL SELECT client_id, '', 'test_accuracy', avg(CAST(label = pred AS DOUBLE)) FROM tested_{r} GROUP BY client_id
          UNION ALL SELECT client_id, '', 'loss', {loss} FROM tested_{r} GROUP BY client_id"""
        parts[f"fitted_{r}"] = f"SELECT client_id, label, CAST(margin > 0 AS INTEGER) AS pred FROM loc_{r} WHERE split = 'val'"
        parts.update(numbered(report(f"fitted_{r}", ("client_id",)), f"_fit_{r}"))
        parts[f"fits_{r}"] = f"""SELECT client_id, class, metric, value FROM report_fit_{r}
          UNION ALL SELECT client_id, '', 'train_accuracy', avg(CAST(label = CAST(margin > 0 AS INTEGER) AS DOUBLE))
          FROM loc_{r} WHERE split = 'train' GROUP BY client_id"""
    return parts


def numbered(parts: dict[str, str], end: str) -> dict[str, str]:
    """The report's CTEs under names of their own."""
    out = {}
    for name, sql in parts.items():
        for other in parts:
            sql = sql.replace(f"FROM {other} ", f"FROM {other}{end} ").replace(f"FROM {other}\n", f"FROM {other}{end}\n")
            sql = sql + " " if sql.endswith(f"FROM {other}") else sql
            sql = sql.replace(f"FROM {other} ", f"FROM {other}{end} ")
        out[name + end] = sql
    return out


def merged_rows(source: str, split: str, r: int) -> str:
    return f"""SELECT {r} AS round, class, metric, round(sum(value * n) / sum(n), 6) AS value FROM {source}_{r}
      JOIN (SELECT client_id, CAST(count(*) AS DOUBLE) AS n FROM scaled WHERE split = '{split}' GROUP BY client_id) USING (client_id)
      GROUP BY class, metric"""


def history(weight: str, source: str = "rows", split: str = "test") -> str:
    return ctes(**step_rounds(weight)) + " UNION ALL ".join(merged_rows(source, split, r) for r in (1, 2, 3))


ORACLE["step_rounds_fedavg"] = history("n_examples")
ORACLE["step_rounds_fedf1"] = history("f1")
ORACLE["step_fit_metrics"] = history("n_examples", "fits", "train")
ORACLE["step_local_fit"] = ctes(**step_rounds("n_examples", 1)) + \
    "SELECT 1 AS round, client_id, class, metric, round(value, 6) AS value FROM fits_1"
ORACLE["step_local_evaluate"] = ctes(**step_rounds("n_examples", 1)) + \
    "SELECT 1 AS round, client_id, class, metric, round(value, 6) AS value FROM rows_1"
ORACLE["step_central_baseline"] = ctes(**step_rounds("n_examples", 1, pooled=True)) + \
    "SELECT class, metric, round(value, 6) AS value FROM rows_1 WHERE metric <> 'loss'"
ORACLE["step_sweep"] = " UNION ALL ".join(
    f"SELECT * FROM ({ctes(**step_rounds('n_examples', 3, SEED + k))} SELECT 'gradient-{k + 1}' AS run_id, 'gradient' AS algorithm, "
    f"{k + 1} AS repeat, {SEED + k} AS seed, class, metric, value FROM ({merged_rows('rows', 'test', 3)}))" for k in range(2))
SILO_POSITIONS = "SELECT DISTINCT n_regionkey AS client_id, CAST(unnest(range({n})) AS INTEGER) AS {name} FROM nation"
ORACLE["optimal_logistic"] = ORACLE["optimal_linear_svc"] = \
    f"SELECT client_id, pos, true AS optimal FROM ({SILO_POSITIONS.format(n=len(NUMS) + len(ONE_HOT_NAMES) + 1, name='pos')})"
ORACLE["boost_learns"] = f"SELECT client_id, tree + 1 AS tree, true AS better FROM ({SILO_POSITIONS.format(n=10, name='tree')})"
ORACLE["pca_reconstruction"] = ORACLE["covariance"]
ORACLE["pca_uncorrelated"] = f"""SELECT a.client_id, i, j, true AS ok FROM ({SILO_POSITIONS.format(n=3, name='i')}) a
JOIN ({SILO_POSITIONS.format(n=3, name='j')}) b ON a.client_id = b.client_id AND i <= j"""
ORACLE["one_step_fedavg"] = one_step("n_examples")
ORACLE["one_step_fedf1"] = one_step("f1")
ORACLE["tree_counts"] = """
SELECT 1 AS round, 10 + count(DISTINCT n_regionkey) - 1 AS n_trees FROM nation
UNION ALL SELECT r, n FROM (SELECT count(DISTINCT n_regionkey) AS n FROM nation), (SELECT CAST(unnest(range(2, 11)) AS INTEGER) AS r)"""

# ---- metrics -------------------------------------------------------------------------------------
REPORTED = with_report("rated", ("client_id",), RATED)
POOLED = with_report("pooled", ("client_id",), dict(**RATED, pooled="""
  SELECT client_id, label, pred FROM rated UNION ALL SELECT NULL, label, pred FROM rated"""))
ORACLE["confusion"] = ctes(**RATED) + "SELECT client_id, label, pred, count(*) AS n FROM rated GROUP BY client_id, label, pred"
ORACLE["accuracy"] = ctes(**RATED) + """
SELECT client_id, round(avg(CAST(label = pred AS DOUBLE)), 6) AS accuracy FROM rated GROUP BY client_id"""
ORACLE["classification_report"] = ctes(**POOLED) + "SELECT client_id, class, metric, round(value, 6) AS value FROM report"
LOSS = """-ln(least(greatest(CASE WHEN label = 1 THEN {p} ELSE 1.0 - {p} END, 2.220446049250313e-16::DOUBLE),
  1.0::DOUBLE - 2.220446049250313e-16::DOUBLE))"""
ORACLE["log_loss"] = ctes(**RATED) + \
    f"SELECT client_id, round(avg({LOSS.format(p='prob')}), 6) AS log_loss FROM rated GROUP BY client_id"
ORACLE["log_loss_hard"] = ctes(**RATED) + \
    f"SELECT client_id, round(avg({LOSS.format(p='CAST(pred AS DOUBLE)')}), 6) AS log_loss FROM rated GROUP BY client_id"
ORACLE["eval_set_metric"] = ctes(**RATED) + f"""
SELECT client_id, round(avg({LOSS.format(p='prob')}), 4) AS test_logloss, round(avg({LOSS.format(p='prob')}), 4) AS "AUC"
FROM rated GROUP BY client_id"""
ORACLE["auc"] = ctes(**RATED, ranked="""
  SELECT client_id, label, rank() OVER w + (count(*) OVER (PARTITION BY client_id, prob) - 1) / 2.0::DOUBLE AS rk
  FROM rated WINDOW w AS (PARTITION BY client_id ORDER BY prob)""") + """
SELECT client_id, round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
  / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)), 6) AS auc
FROM ranked GROUP BY client_id"""
ORACLE["flatten_metrics"] = ctes(**REPORTED) + f"SELECT client_id, {FLAT} AS name, round(value, 6) AS value FROM report"
ORACLE["unflatten_metrics"] = ctes(**REPORTED) + """
SELECT client_id, class AS path, metric, round(value, 6) AS value FROM report
UNION ALL SELECT client_id, 'test', 'accuracy', round(value, 6) FROM report WHERE metric = 'accuracy'"""

# ---- merging -------------------------------------------------------------------------------------
FACTS = """
SELECT client_id AS round, customer AS client_id, count(*) AS n_examples, avg(CAST(label AS DOUBLE)) AS f1,
  CASE WHEN count(*) % 7 = 0 THEN 'FAILED' ELSE 'OK' END AS status
FROM rated GROUP BY 1, 2"""
PARAMS = " UNION ALL ".join(
    [f"SELECT client_id AS round, customer AS client_id, 0 AS layer, {i} AS pos, avg({c}) AS value FROM risk GROUP BY 1, 2"
     for i, c in enumerate(SUMS)]
    + ["SELECT client_id, customer, 1, 0, avg(CAST(label AS DOUBLE)) FROM risk GROUP BY 1, 2"])
MERGED = dict(**RATED, facts=FACTS, params=PARAMS)


def merge(weight: str, where: str = "TRUE") -> str:
    return ctes(**MERGED) + f"""
SELECT round, layer, pos, round(sum(value * {weight}) / sum({weight}), 4) AS value
FROM params JOIN facts USING (round, client_id) WHERE {where} GROUP BY round, layer, pos"""


ORACLE["write_read_model"] = ctes(**MERGED) + "SELECT round, client_id, layer, pos, round(value, 6) AS value FROM params"
ORACLE["flatten_params"] = ctes(**MERGED) + """
SELECT round, client_id, 0 AS layer, CAST(layer * 5 + pos AS INTEGER) AS pos, round(value, 6) AS value FROM params"""
ORACLE["rebuild_params"] = ctes(**MERGED) + """
SELECT round, client_id, CAST(count(*) AS INTEGER) AS width, round(max(value) FILTER (layer = 0 AND pos = 0), 6) AS first,
  round(max(value) FILTER (layer = 1), 6) AS last FROM params GROUP BY round, client_id"""
ORACLE["shape_params"] = ctes(**MERGED, flat="SELECT value, layer * 5 + pos AS p FROM params") + """
SELECT CASE WHEN p < 3 THEN 0 ELSE p - 2 END AS layer, CASE WHEN p < 3 THEN p ELSE 0 END AS pos,
  count(*) AS n, round(avg(value), 4) AS value FROM flat GROUP BY 1, 2"""
ORACLE["fedavg"] = merge("n_examples")
ORACLE["fedf1"] = merge("f1")
USABLE = "status = 'OK' AND round IN (SELECT round FROM facts WHERE status = 'OK' GROUP BY round HAVING count(*) >= 2)"
ORACLE["choose_merge"] = merge("n_examples", USABLE)
ORACLE["skip_empty_or_failed"] = ctes(**MERGED) + f"SELECT round, client_id, n_examples FROM facts WHERE {USABLE}"
ORACLE["merge_hyperparams"] = ctes(**MERGED, hyper=" UNION ALL ".join(
    f"SELECT round, n_examples AS n, {i} AS pos, CAST({e} AS DOUBLE) AS value FROM facts"
    for i, e in enumerate(("100 + n_examples", "5 + n_examples % 6", "2 + n_examples % 4", "1")))) + """
SELECT round, 0 AS layer, pos, CAST(trunc(sum(value * n) / sum(n)) AS INTEGER) AS value FROM hyper GROUP BY round, pos"""
TREES = dict(
    f="""SELECT l_linenumber AS round, CAST(l_suppkey AS INTEGER) AS client_id, count(*) AS n,
      avg(CAST(l_returnflag = 'R' AS DOUBLE)) AS f1 FROM lineitem GROUP BY 1, 2""",
    t="SELECT f.*, k FROM f, (SELECT unnest([0, 1]) AS k)",
    start="SELECT round, client_id, TRUE AS is_first FROM f ORDER BY round, client_id LIMIT 1",
    m="SELECT t.*, coalesce(is_first, FALSE) AS is_first FROM t LEFT JOIN start USING (round, client_id)")
IDS = "CAST(row_number() OVER (ORDER BY round, client_id, k) - 1 AS INTEGER) AS tree_id, round, client_id"
ORACLE["bag_trees"] = ctes(**TREES) + f"""
SELECT {IDS}, 3 AS n_nodes, CASE WHEN is_first THEN 1.0::DOUBLE ELSE CAST(n AS DOUBLE) END AS weight,
  round((k + 3) * CASE WHEN is_first THEN 1.0::DOUBLE ELSE CAST(n AS DOUBLE) END, 6) AS base_weight
FROM m WHERE is_first OR k = 0"""
ORACLE["bag_trees_f1"] = ctes(**TREES) + f"SELECT {IDS}, round(f1, 6) AS weight FROM m"
BY_CUSTOMER = {**RATED, "rc": "SELECT client_id AS round, customer AS client_id, label, pred, prob FROM rated",
               **report("rc", ("round", "client_id")), "facts": FACTS}
BOOSTED = {**BY_CUSTOMER, "loss": f"SELECT round, client_id, round(avg({LOSS.format(p='prob')}), 4) AS value FROM rc GROUP BY 1, 2",
           "all_rows": """SELECT round, client_id, class, metric, value FROM report
             UNION ALL SELECT round, client_id, '', 'AUC', value FROM loss"""}
WEIGHTED = """SELECT round, class, metric, sum(value * n_examples) / sum(n_examples) AS value
  FROM report JOIN facts USING (round, client_id) GROUP BY round, class, metric"""
EVAL_BOOST = """SELECT round, class, metric, round(CASE WHEN metric = 'AUC' THEN sum(value * n_examples) / sum(n_examples)
  ELSE avg(value) END, 6) AS value FROM all_rows JOIN facts USING (round, client_id) GROUP BY round, class, metric"""
ORACLE["weighted_metrics"] = ctes(**BY_CUSTOMER, w=WEIGHTED) + "SELECT round, class, metric, round(value, 6) AS value FROM w"
ORACLE["mean_metrics"] = ctes(**BY_CUSTOMER) + \
    "SELECT class, metric, round(avg(value), 6) AS value FROM report GROUP BY class, metric"
ORACLE["merge_eval_boost"] = ctes(**BOOSTED) + EVAL_BOOST
ORACLE["merge_eval"] = ctes(**BOOSTED) + EVAL_BOOST + " UNION ALL SELECT DISTINCT round, '', 'loss', 0.0::DOUBLE FROM facts"
ORACLE["final_round"] = ctes(**BY_CUSTOMER, w=WEIGHTED) + \
    "SELECT class, metric, round(max_by(value, round), 6) AS value FROM w GROUP BY class, metric"
ORACLE["mean_over_rounds"] = ctes(**BY_CUSTOMER, w=WEIGHTED) + \
    "SELECT class, metric, round(avg(value), 6) AS value FROM w GROUP BY class, metric"

# ---- result logs: what the parsers must find in the rendered reports --------------------------------
# The bare accuracy line follows the last class block, so compatible parsing files it there.
LOGGED = {**BY_CUSTOMER, "logged": """
SELECT round, client_id, 'Class ' || CASE WHEN class = '' THEN max(class) FILTER (class IN ('0', '1'))
  OVER (PARTITION BY round, client_id) ELSE class END || ':' AS class, metric, value FROM report"""}
ORACLE["write_report"] = ctes(**BY_CUSTOMER) + """
SELECT 'region-' || round AS run_id, class, metric, count(*) AS n, round(avg(value), 6) AS value
FROM report GROUP BY round, class, metric"""
ORACLE["scan_results"] = ctes(**BY_CUSTOMER) + """
SELECT 'metric' AS kind, count(*) AS n FROM report
UNION ALL SELECT 'class', count(*) FROM (SELECT DISTINCT round, client_id, class FROM report WHERE class <> '')
UNION ALL SELECT 'experiment', count(*) FROM facts"""
ORACLE["parse_results"] = ctes(**LOGGED) + \
    "SELECT class, metric, count(*) AS n, round(avg(value), 6) AS value FROM logged GROUP BY class, metric"
ORACLE["average_results"] = ctes(**LOGGED) + """
SELECT class, metric, round(sum(value) / (SELECT count(*) FROM facts), 6) AS value FROM logged GROUP BY class, metric"""
ORACLE["count_results"] = ctes(**BY_CUSTOMER) + """
SELECT (SELECT count(*) FROM facts) AS experiments, (SELECT count(*) FROM per_class WHERE c = 0) AS classes"""
ORACLE["summary_report"] = ctes(**LOGGED, averaged="""
  SELECT class, metric, round(sum(value) / (SELECT count(*) FROM facts), 4) AS value FROM logged GROUP BY class, metric""", blocks="""
  SELECT class, class || chr(10) || string_agg('  ' || metric || ': ' || CAST(value AS VARCHAR), chr(10) ORDER BY metric) AS t,
    '"' || class || '":{' || string_agg('"' || metric || '":' || CAST(value AS VARCHAR), ',' ORDER BY metric) || '}' AS j
  FROM averaged GROUP BY class""") + """
SELECT CAST((SELECT count(*) FROM facts) AS INTEGER) AS n_experiments, string_agg(t, chr(10) ORDER BY class) AS report,
  '{' || string_agg(j, ',' ORDER BY class) || '}' AS averages, '{"client": 5, "round": 10}' AS options FROM blocks"""
ORACLE["parse_results_flat"] = ctes(**BY_CUSTOMER) + """
SELECT CASE WHEN class = '' THEN 'Class test' ELSE 'Class ' || class END AS class, metric, round(avg(value), 6) AS value
FROM report GROUP BY report.class, metric"""
