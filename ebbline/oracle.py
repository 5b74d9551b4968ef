"""The report tables as DuckDB SQL over the raw tables, written apart from the operators."""

from __future__ import annotations

K = "product_key, stay_key, amount_type"
ROW = f"date, {K}"

# --- inputs, cleaning, trend, split -------------------------------------------

BASE = [
    (
        "lines",
        """
        SELECT l_shipdate::DATE AS date,
               (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END)::INT AS product_key,
               (CASE l_linestatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END)::INT AS stay_key,
               l_extendedprice::DECIMAL(12,2) AS price
        FROM lineitem""",
    ),
    (
        "spine",
        """
        SELECT unnest(generate_series((SELECT min(date) FROM lines)::TIMESTAMP,
               (SELECT max(date) FROM lines)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date""",
    ),
    (
        "day_sums",
        """
        SELECT date, product_key, stay_key, count(*)::DOUBLE AS n,
               sum(price)::DOUBLE / count(*) AS price
        FROM lines GROUP BY ALL""",
    ),
    (
        "fact",
        """
        SELECT s.date, k.product_key, k.stay_key, m.amount_type::INT AS amount_type,
               CASE WHEN m.amount_type = 100 THEN d.price ELSE d.n END AS raw_amount
        FROM spine s
        CROSS JOIN (SELECT DISTINCT product_key, stay_key FROM lines) k
        CROSS JOIN (VALUES (100), (103)) m(amount_type)
        LEFT JOIN day_sums d
          ON d.date = s.date AND d.product_key = k.product_key AND d.stay_key = k.stay_key""",
    ),
    (
        "campaign",
        """
        SELECT s.date, (1 + month(s.date) % 2)::INT AS edm_type, 1000.0::DOUBLE * o.n AS amount_sent
        FROM spine s
        LEFT JOIN (SELECT o_orderdate::DATE AS date, count(*) AS n FROM orders GROUP BY 1) o
          ON o.date = s.date
        WHERE dayofyear(s.date) % 11 = 3""",
    ),
    (
        "days",
        """
        SELECT s.date, month(s.date)::INT AS month_no, (dayofweek(s.date) + 1)::INT AS day_no_week,
               CASE WHEN day(s.date) <= 14 AND month(s.date) IN (1, 4, 7, 10)
                    THEN 'Q' || quarter(s.date) || ' holiday' ELSE 'None' END AS school_holiday,
               CASE WHEN strftime(s.date, '%m%d') >= '1224' OR strftime(s.date, '%m%d') <= '0102'
                    THEN 'Christmas'
                    WHEN strftime(s.date, '%m%d') = '0126' THEN 'Jan 26'
                    WHEN strftime(s.date, '%m%d') = '0425' THEN 'Apr 25' ELSE 'None' END AS influential_date,
               coalesce(c.edm_type, 0)::INT AS edm_type,
               (c.date IS NOT NULL)::INT AS edm_flag,
               p.edm_type AS prior_edm_type,
               coalesce(date_diff('day', p.date, s.date) BETWEEN 1 AND 3, false) AS edm_lagged_flag,
               date_diff('day', p.date, s.date)::INT AS days_from_edm_start,
               c.amount_sent
        FROM spine s
        LEFT JOIN campaign c ON c.date = s.date
        ASOF LEFT JOIN campaign p ON s.date >= p.date""",
    ),
    (
        "tagged",
        """
        SELECT *, CASE WHEN date <= DATE '1998-06-30' THEN 'pre'
                       WHEN date <= DATE '1998-07-14' THEN 'transition' ELSE 'recovery' END AS regime
        FROM fact""",
    ),
    (
        "cleaned",
        f"""
        SELECT *,
               least(364, date_diff('day', min(date) OVER (PARTITION BY {K}, regime), date) + 1)::INT AS width,
               coalesce(CASE WHEN amount_type = 100
                 THEN last_value(nullif(raw_amount, 0) IGNORE NULLS) OVER (
                   PARTITION BY {K} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                 ELSE raw_amount END, 0) AS amount
        FROM tagged""",
    ),
    (
        "smooth",
        f"""
        SELECT *, avg(amount) OVER (PARTITION BY {K}, regime ORDER BY date
                    ROWS BETWEEN ((width - 1) // 2) PRECEDING AND (width // 2) FOLLOWING) AS trend
        FROM cleaned WHERE date BETWEEN DATE '1995-03-01' AND DATE '2001-10-31'""",
    ),
    (
        "prices",
        """
        SELECT date, product_key, stay_key, (amount - prior) / nullif(prior, 0) AS price_change_prior,
               (amount - prior) / nullif(trend, 0) AS price_change_trend
        FROM (SELECT *, lag(amount) OVER (PARTITION BY product_key, stay_key ORDER BY date) AS prior
              FROM smooth WHERE amount_type = 100)""",
    ),
    (
        "main_rows",
        """
        SELECT t.*, t.amount - t.trend AS residual_trend, p.price_change_prior, p.price_change_trend,
               d.* EXCLUDE (date), t.date >= DATE '1996-07-01' AS era,
               ('0x' || left(md5(concat_ws('|', t.date::VARCHAR, t.product_key, t.stay_key, t.amount_type)), 15))::BIGINT AS h
        FROM smooth t
        LEFT JOIN prices p ON p.date = t.date AND p.product_key = t.product_key AND p.stay_key = t.stay_key
        LEFT JOIN days d ON d.date = t.date""",
    ),
    (
        "layered",
        """
        SELECT m.*, (amount > q.a)::INT + (amount > q.b)::INT + (amount > q.c)::INT AS stratum
        FROM main_rows m, (SELECT quantile_disc(amount, 0.25) AS a, quantile_disc(amount, 0.5) AS b,
                                  quantile_disc(amount, 0.75) AS c FROM main_rows) q""",
    ),
    (
        "f0",
        """
        SELECT * EXCLUDE (h), residual_trend AS r0,
               row_number() OVER (PARTITION BY stratum ORDER BY h)
                 <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY stratum)) AS is_test
        FROM layered""",
    ),
]

# --- the factor chain ----------------------------------------------------------

RATIO_LEVELS = [
    ("SeasonalMonth", ["month_no"], "NOT is_test"),
    ("SeasonalDOW", ["day_no_week"], "NOT is_test"),
    ("SeasonalSchoolHoliday", ["school_holiday"], "NOT is_test"),
    ("SeasonalInfluentialDate", ["influential_date"], "NOT is_test"),
    ("EDMMajorAvg", ["edm_type"], "NOT is_test AND era"),
    ("EDMMajorMonth", ["edm_type", "month_no"], "NOT is_test AND era"),
    ("EDMMajorDOW", ["edm_type", "day_no_week"], "NOT is_test AND era"),
    ("EDMMajorLaggedAvg", ["prior_edm_type", "edm_lagged_flag"], "NOT is_test AND era"),
    ("EDMMajorLaggedDays", ["prior_edm_type", "edm_lagged_flag", "days_from_edm_start"],
     "NOT is_test AND era AND edm_lagged_flag"),
    ("EDMMajorLaggedDaysDOW", ["edm_lagged_flag", "day_no_week", "days_from_edm_start"],
     "NOT is_test AND era AND edm_lagged_flag"),
]
VOLUME_LEVELS = [("EDMMajorMonthRgr", "month_no"), ("EDMMajorDOWRgr", "day_no_week")]
SENT = "NOT is_test AND era AND edm_flag = 1 AND amount_sent IS NOT NULL"


def _chain() -> list[tuple[str, str]]:
    steps = []
    for i, (name, levels, rows) in enumerate(RATIO_LEVELS, start=1):
        cols = ", ".join(levels)
        on = " AND ".join(f"f.{c} IS NOT DISTINCT FROM g.{c}" for c in K.split(", ") + levels)
        steps.append(
            (
                f"g{i}",
                f"""
        SELECT {K}, {cols}, CASE WHEN bool_or(trend = 0) THEN 0 ELSE avg(r{i - 1} / nullif(trend, 0)) END AS trend_ratio
        FROM f{i - 1} WHERE {rows} GROUP BY {K}, {cols}""",
            )
        )
        steps.append(
            (
                f"f{i}",
                f"""
        SELECT f.*, coalesce(g.trend_ratio, 0) * f.trend AS Predict_{name},
               f.r{i - 1} - coalesce(g.trend_ratio, 0) * f.trend AS r{i}
        FROM f{i - 1} f LEFT JOIN g{i} g ON {on}""",
            )
        )
    for i, (name, level) in enumerate(VOLUME_LEVELS, start=11):
        on = " AND ".join(f"f.{c} = g.{c}" for c in K.split(", ") + [level])
        steps.append(
            (
                f"g{i}",
                f"""
        SELECT {K}, {level}, count(*) AS n, avg(x) AS mx, avg(y) AS my,
               CASE WHEN min(x) < max(x) THEN regr_sxx(y, x) END AS sxx, regr_syy(y, x) AS syy,
               CASE WHEN min(x) < max(x) THEN regr_slope(y, x) END AS slope,
               CASE WHEN min(x) < max(x) THEN regr_intercept(y, x) END AS intercept
        FROM (SELECT *, amount_sent AS x, coalesce(r{i - 1} / nullif(trend, 0), 0) AS y
              FROM f{i - 1} WHERE {SENT}) GROUP BY {K}, {level}""",
            )
        )
        share = "coalesce(CASE WHEN f.edm_flag = 1 THEN g.intercept + g.slope * f.amount_sent END, 0)"
        steps.append(
            (
                f"f{i}",
                f"""
        SELECT f.*, {share} * f.trend AS Predict_{name}, f.r{i - 1} - {share} * f.trend AS r{i}
        FROM f{i - 1} f LEFT JOIN g{i} g ON {on}""",
            )
        )
    return steps


PARTS = [
    "Predict_TrendLong", "Predict_SeasonalMonth", "Predict_SeasonalDOW",
    "Predict_SeasonalSchoolHoliday", "Predict_SeasonalInfluentialDate", "Predict_EDMMajorAvg",
    "Predict_EDMMajorMonth", "Predict_EDMMajorDOW", "Predict_EDMMajorMonthRgr",
    "Predict_EDMMajorDOWRgr", "Predict_EDMMajorLaggedAvg", "Predict_EDMMajorLaggedDays",
    "Predict_EDMMajorLaggedDaysDOW",
]

SCORED = [
    (
        "scored",
        f"""
        SELECT CASE WHEN is_test THEN 'Test' ELSE 'Train' END AS data, {ROW}, amount AS "Amount",
               trend AS Predict_TrendLong, {", ".join(PARTS[1:])},
               amount - (trend + {" + ".join(PARTS[1:])}) AS Residual
        FROM f12 WHERE amount_type = 103 AND date >= (SELECT min(date) FROM campaign)""",
    ),
    (
        "stays",
        "SELECT * FROM (VALUES (1, 'short', 1), (2, 'long', 2)) v(stay_key, stay_name, stay_rank)",
    ),
    (
        "training",
        """
        SELECT f.*, stay_name, r12 / nullif(trend, 0) AS resid_perc
        FROM f12 f LEFT JOIN stays USING (stay_key)
        WHERE NOT is_test AND era AND amount_type = 103""",
    ),
]

ALL = BASE + _chain() + SCORED


def _with(upto: str, body: str) -> str:
    """The query body behind the named steps up to and including ``upto``."""
    steps = []
    for name, sql in ALL:
        steps.append(f"{name} AS MATERIALIZED ({sql})")
        if name == upto:
            break
    return "WITH " + ",\n".join(steps) + "\n" + body


def _r(expression: str, places: int = 4, alias: str | None = None) -> str:
    return f"floor(({expression}) * 1e{places} + 0.5001) / 1e{places} AS {alias or expression}"


def _input_tables() -> dict[str, str]:
    flat = f"SELECT {ROW}, "
    return {
        "daily_fact": _with("fact", flat + _r("raw_amount") + " FROM fact"),
        "calendar": _with("days", "SELECT * EXCLUDE (amount_sent) FROM days"),
        "campaigns": _with("campaign", "SELECT date, edm_type, amount_sent FROM campaign"),
        "regime_tag": _with(
            "tagged",
            flat + "regime, CASE regime WHEN 'pre' THEN 1 WHEN 'transition' THEN 2 ELSE 3 END AS regime_no FROM tagged",
        ),
        "growing_width": _with("cleaned", flat + "width FROM cleaned"),
        "clean_amounts": _with("cleaned", flat + _r("amount") + " FROM cleaned"),
        "centred_trend": _with("smooth", flat + _r("trend") + " FROM smooth"),
        "detrend": _with(
            "main_rows",
            flat + ", ".join(_r(c) for c in ("amount", "trend", "residual_trend")) + " FROM main_rows",
        ),
        "price_change": _with(
            "main_rows",
            flat + ", ".join(_r(c) for c in ("price_change_prior", "price_change_trend")) + " FROM main_rows",
        ),
        "monthly_average": _with(
            "f0",
            flat
            + _r(f"avg(amount) OVER (PARTITION BY {K}, year(date), month(date))", 4, "month_average")
            + " FROM f0 WHERE NOT is_test",
        ),
        "hash_split": _with("f0", flat + "stratum, is_test FROM f0"),
        "split_balance": _with(
            "f0",
            "SELECT stratum, count(*) AS n_rows, count(*) FILTER (is_test) AS n_test, "
            + _r("count(*) FILTER (is_test) / count(*)", 4, "test_share")
            + " FROM f0 GROUP BY stratum",
        ),
        "split_within_series": _with(
            "main_rows",
            f"""
        SELECT {K}, stratum, count(*) AS n_rows, count(*) FILTER (is_test) AS n_test,
               floor((count(*) FILTER (is_test) / count(*)) * 1e4 + 0.5001) / 1e4 AS test_share
        FROM (SELECT *, row_number() OVER (PARTITION BY {K}, stratum ORDER BY h)
                <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY {K}, stratum)) AS is_test
              FROM (SELECT {K}, h, (amount > quantile_cont(amount, 0.25) OVER s)::INT
                      + (amount > quantile_cont(amount, 0.5) OVER s)::INT
                      + (amount > quantile_cont(amount, 0.75) OVER s)::INT AS stratum
                    FROM main_rows WINDOW s AS (PARTITION BY {K})))
        GROUP BY ALL""",
        ),
    }


def _fine_split() -> str:
    """The split over products widened by supplier, counted by series and stratum."""
    steps = dict(BASE)
    steps["lines"] = """
        SELECT l_shipdate::DATE AS date,
               (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END + 3 * (l_suppkey % 50))::INT AS product_key,
               (CASE l_linestatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END)::INT AS stay_key,
               l_extendedprice::DECIMAL(12,2) AS price
        FROM lineitem"""
    head = ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps.items())
    return f"""WITH {head}
        SELECT {K}, stratum, count(*) AS n_rows, count(*) FILTER (is_test) AS n_test,
               floor(min(amount) * 1e4 + 0.5001) / 1e4 AS least, floor(max(amount) * 1e4 + 0.5001) / 1e4 AS most
        FROM f0 GROUP BY {K}, stratum"""


def _lines_over_time() -> dict[str, str]:
    """Lines through training amounts of three stretches, and through means per month."""
    day = "date_diff('day', DATE '1970-01-01', date)::DOUBLE"
    fit = (
        f"count(*) AS n_points, floor(regr_slope(y, {day}) * 1e8 + 0.5001) / 1e8 AS slope, "
        f"floor(regr_intercept(y, {day}) * 1e3 + 0.5001) / 1e3 AS epoch_intercept"
    )
    windows = (("long", "1996-02-01", "1996-08-31"), ("short", "1996-02-01", "1996-02-29"), ("cut", "1996-11-12", "1997-03-09"))
    parts = [
        f"SELECT {K}, '{name}' AS \"window\", {fit} FROM (SELECT *, amount AS y FROM f0) "
        f"WHERE NOT is_test AND date BETWEEN DATE '{first}' AND DATE '{last}' GROUP BY {K}"
        for name, first, last in windows
    ]
    means = (
        f"SELECT {K}, date, avg(amount) OVER (PARTITION BY {K}, year(date), month(date)) AS y FROM f0 "
        "WHERE NOT is_test AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"
    )
    return {
        "lines_window": _with("f0", " UNION ALL ".join(parts)),
        "lines_monthly": _with("f0", f"SELECT {K}, {fit} FROM ({means}) GROUP BY {K}"),
    }


def _more_tables() -> dict[str, str]:
    running, total = [], "trend"
    names = [n for n, _, _ in RATIO_LEVELS] + [n for n, _ in VOLUME_LEVELS]
    for i, name in enumerate(names, start=1):
        total += f" + Predict_{name}"
        running += [_r(f"r{i}", 2, f"Residual_{name}"), _r(total, 2, f"Agg_Predict_{name}")]
    named = _factor_tables()["check_lag_days_dow_named"]
    six = ["MAE", "MBE", "RMSE", "MAEPerc", "MBEPerc", "RMSEPerc"]
    one = _acc(K, "product_key, stay_name", "a.data = 'Train' AND product_key = 2 AND (stay_name IS NULL OR stay_name NOT IN ('short'))")
    return {
        "running_parts": _with("f12", f"SELECT {ROW}, {', '.join(running)} FROM f12"),
        "check_lag_days_dow_stays": f"SELECT * FROM ({named}) WHERE stay_name = 'long'",
        "model_sample": _with(
            "g1", f"SELECT {K}, month_no, {_r('trend_ratio')} FROM g1 WHERE product_key = 1 AND stay_key = 1 AND amount_type = 103"
        ),
        "acc_one_product": "SELECT stay_name, " + ", ".join(f'round("{c}", 2) + 0.0 AS "{c}"' for c in six) + f" FROM ({one})",
        "stay_label_breaks": """
        SELECT stay_name FROM (SELECT stay_name, row_number() OVER (ORDER BY stay_name) AS stay_rank
          FROM (SELECT DISTINCT o_orderpriority AS stay_name FROM orders WHERE o_orderpriority IS NOT NULL))
        WHERE stay_rank % 2 = 1 AND stay_name <> '5-LOW'""",
        "hash_split_fine": _fine_split(),
    }


SHORT = ["month", "dow", "school_holiday", "influential", "edm_avg", "edm_month", "edm_dow",
         "lag_avg", "lag_days", "lag_days_dow"]


def _p_value(t: str, df: str) -> str:
    """1 - integral of cos^(df-1) up to atan(t/sqrt(df)), by Simpson, over its full value."""
    theta = f"atan(abs({t}) / sqrt({df}))"
    weight = "(CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"
    area = (
        f"list_sum(list_transform(range(0, 2001), lambda k: {weight} * "
        f"pow(cos({theta} * k / 2000), {df} - 1))) * {theta} / 6000"
    )
    full = f"(sqrt(pi()) / 2 * exp(lgamma({df} / 2.0) - lgamma(({df} + 1) / 2.0)))"
    return f"CASE WHEN {t} IS NOT NULL AND {df} >= 1 THEN greatest(1 - ({area}) / {full}, 0) END"


def _terms(source: str, keys: str, slope_name: str) -> str:
    """Intercept and slope rows from (n, mx, my, sxx, syy, slope, intercept)."""
    return f"""
        SELECT {keys}, coefficient_name, {_r("coefficient_value", 8)}, {_r("std_error", 8)},
               {_r("statistic")}, floor(({_p_value("statistic", "df")}) * 1e4 + 0.5001) / 1e4 AS p_value
        FROM (SELECT *, coefficient_value / nullif(std_error, 0) AS statistic
              FROM (
                SELECT {keys}, df, 'Intercept' AS coefficient_name,
                       coalesce(intercept, my) AS coefficient_value,
                       sqrt(noise * (1.0 / n + coalesce(mx * mx / sxx, 0))) AS std_error
                FROM (SELECT *, CASE WHEN df > 0 THEN greatest(syy - coalesce(slope * slope * sxx, 0), 0) / df END AS noise
                      FROM (SELECT *, CASE WHEN sxx IS NULL THEN n - 1 ELSE n - 2 END AS df FROM {source}))
                UNION ALL
                SELECT {keys}, df, '{slope_name}', slope, sqrt(noise / sxx)
                FROM (SELECT *, CASE WHEN df > 0 THEN greatest(syy - coalesce(slope * slope * sxx, 0), 0) / df END AS noise
                      FROM (SELECT *, CASE WHEN sxx IS NULL THEN n - 1 ELSE n - 2 END AS df FROM {source}))))"""


def _line(y: str, x: str, suffix: str = "") -> str:
    varies = f"min({x}) < max({x})"
    return (
        f"floor((CASE WHEN {varies} THEN regr_slope({y}, {x}) END) * 1e8 + 0.5001) / 1e8 AS slope{suffix}, "
        f"floor((CASE WHEN {varies} THEN regr_intercept({y}, {x}) END) * 1e6 + 0.5001) / 1e6 AS intercept{suffix}"
    )


def _factor_tables() -> dict[str, str]:
    found = {}
    for i, (short, (_, levels, rows)) in enumerate(zip(SHORT, RATIO_LEVELS), start=1):
        cols = f"{K}, {', '.join(levels)}"
        found[f"fit_{short}"] = _with(f"g{i}", f"SELECT {cols}, {_r('trend_ratio')} FROM g{i}")
        before = "r7" if short == "lag_days" else f"r{i - 1}"

        def mean(r: str, alias: str) -> str:
            guarded = f"CASE WHEN bool_or(trend = 0) THEN NULL ELSE avg({r} / nullif(trend, 0)) END"
            return _r(guarded, 4, alias)

        means = mean(before, "mean_before") + ", " + mean(f"r{i}", "mean_after")
        found[f"check_{short}"] = _with(
            f"f{i}", f"SELECT {cols}, {means} FROM f{i} WHERE {rows} GROUP BY {cols}"
        )
        if short == "lag_days_dow":
            found["check_lag_days_dow_named"] = _with(
                "stays",
                f"""
        SELECT product_key, stay_name, amount_type, day_no_week, days_from_edm_start, {means},
               sign(CASE WHEN bool_or(trend = 0) THEN NULL ELSE avg({before} / nullif(trend, 0)) END)::DOUBLE AS sign_before
        FROM f{i} LEFT JOIN stays USING (stay_key) WHERE {rows} GROUP BY ALL""",
            )
    for i, (short, (_, level)) in enumerate(zip(["month_rgr", "dow_rgr"], VOLUME_LEVELS), start=11):
        keys = f"{K}, {level}"
        found[f"fit_{short}"] = _with(
            f"g{i}", _terms(f"g{i}", keys, "AmountTotalCampaignSent")
        )
        ratios = (
            f"coalesce(r{i - 1} / nullif(trend, 0), 0) AS ratio_before, "
            f"coalesce(r{i} / nullif(trend, 0), 0) AS ratio_after, amount_sent"
        )
        points = f"SELECT date, {keys}, {ratios} FROM f{i} WHERE {SENT}"
        found[f"points_{short}"] = _with(
            f"f{i}",
            f"SELECT date, {keys}, {_r('ratio_before')}, {_r('ratio_after')}, amount_sent FROM ({points})",
        )
        found[f"lines_{short}"] = _with(
            f"f{i}",
            f"SELECT {keys}, count(*) AS n_points, {_line('ratio_before', 'amount_sent')}, "
            f"{_line('ratio_after', 'amount_sent', '_after')} FROM ({points}) GROUP BY {keys}",
        )
    day = "date_diff('day', DATE '1970-01-01', date)::DOUBLE"
    found["trend_lines"] = _with(
        "main_rows",
        f"""
        SELECT {K}, count(*) AS n_points,
               floor((regr_slope(amount, {day})) * 1e6 + 0.5001) / 1e6 AS amount_slope,
               floor((regr_intercept(amount, {day})) * 1e4 + 0.5001) / 1e4 AS amount_intercept,
               floor((regr_slope(residual_trend, {day})) * 1e6 + 0.5001) / 1e6 AS residual_trend_slope,
               floor((regr_intercept(residual_trend, {day})) * 1e4 + 0.5001) / 1e4 AS residual_trend_intercept
        FROM main_rows GROUP BY {K}""",
    )
    return found


# --- scoring, accuracy, steps ---------------------------------------------------

L1 = """CASE WHEN decomposition_name = 'Amount' THEN 'Actual Results'
             WHEN decomposition_name LIKE 'Predict%' THEN 'Model Results'
             WHEN decomposition_name = 'Residual' THEN 'Residual' ELSE 'Other' END"""
L2 = """CASE WHEN decomposition_name = 'Amount' THEN 'Actual Results'
             WHEN decomposition_name = 'Predict_TrendLong' THEN 'Long Term Trend'
             WHEN decomposition_name LIKE 'Predict_Seasonal%' THEN 'Seasonality'
             WHEN decomposition_name LIKE 'Predict_EDMMajorLagged%' THEN 'EDM Lagged Impact'
             WHEN decomposition_name LIKE 'Predict_EDM%' THEN 'EDM Initial Impact'
             WHEN decomposition_name = 'Residual' THEN 'Residual' ELSE 'Other' END"""
ORDERED = ["Amount", *PARTS, "Residual"]
RANK = "CASE decomposition_name " + " ".join(
    f"WHEN '{n}' THEN {i}" for i, n in enumerate(ORDERED)
) + " END"
LONG = f"""(SELECT data, {ROW}, decomposition_name, amount, {L1} AS decomposition_l1,
            {L2} AS decomposition_l2, {RANK} AS step_rank
     FROM (UNPIVOT scored ON {", ".join(f'"{n}"' for n in ORDERED)} INTO NAME decomposition_name VALUE amount))"""


def _accuracy(grain: str, shown: str | None = None, where: str = "true") -> str:
    """Three-step accuracy: sums per day, all-day errors, relative errors joined on."""
    return f"""
        SELECT a.data, {shown or grain}, {_r('"RMSE"')}, {_r('"ActualMean"')},
               {_r('"RMSE" / nullif("ActualMean", 0)', 4, '"RMSEPerc"')}, {_r('"MAEPerc"')},
               {_r('"MBEPerc"')}, {_r('"MAE"')}, {_r('"MBE"')}, {_r('"Total"')}
        FROM (SELECT data, {grain}, sqrt(avg((actual - model) * (actual - model))) AS "RMSE",
                     avg(actual) AS "ActualMean" FROM per_day GROUP BY data, {grain}) a
        LEFT JOIN (SELECT data, {grain}, avg(abs(residual / actual)) AS "MAEPerc",
                     avg(residual / actual) AS "MBEPerc", avg(abs(residual)) AS "MAE",
                     avg(residual) AS "MBE", sum(actual) AS "Total"
                   FROM per_day WHERE actual <> 0 GROUP BY data, {grain}) b
          USING (data, {grain})
        LEFT JOIN (SELECT stay_key AS named_key, stay_name FROM stays) n
          ON n.named_key = {'stay_key' if 'stay_key' in grain else 'NULL'}
        WHERE {where}"""


def _per_day(grain: str) -> str:
    return f"""per_day AS (
        SELECT data, date, {grain},
               sum(amount) FILTER (decomposition_l1 = 'Actual Results') AS actual,
               sum(amount) FILTER (decomposition_l1 = 'Model Results') AS model,
               sum(amount) FILTER (decomposition_l1 = 'Residual') AS residual
        FROM {LONG} GROUP BY data, date, {grain})"""


def _acc(grain: str, shown: str | None = None, where: str = "true") -> str:
    head = _with("training", "").rstrip()
    return head + ",\n" + _per_day(grain) + _accuracy(grain, shown, where)


def _steps(grain: str) -> str:
    """Running prediction by rank and its error, change by lag."""
    return f"""steps AS (
        SELECT data, {grain}, decomposition_name, step_rank, rmse AS "RMSE",
               rmse / nullif(lag(rmse) OVER (PARTITION BY data, {grain} ORDER BY step_rank), 0) - 1 AS "RMSEChange"
        FROM (SELECT data, {grain}, decomposition_name, step_rank,
                     sqrt(avg((running - actual) * (running - actual))) AS rmse
              FROM (SELECT m.*, a.actual, sum(part) OVER (
                        PARTITION BY data, date, {grain} ORDER BY step_rank
                        ROWS BETWEEN 98 PRECEDING AND CURRENT ROW) AS running
                    FROM (SELECT data, date, {grain}, decomposition_name, step_rank, sum(amount) AS part
                          FROM {LONG} WHERE decomposition_l1 = 'Model Results' GROUP BY ALL) m
                    JOIN (SELECT data, date, {grain}, sum(amount) AS actual
                          FROM {LONG} WHERE decomposition_l1 = 'Actual Results' GROUP BY ALL) a
                      USING (data, date, {grain}))
              GROUP BY ALL))"""


def _step(grain: str, body: str) -> str:
    return _with("training", "").rstrip() + ",\n" + _steps(grain) + body


def _score_tables() -> dict[str, str]:
    wide = _with(
        "scored",
        f"SELECT data, {ROW}, " + ", ".join(_r(f'"{n}"') for n in ORDERED) + " FROM scored",
    )
    shown = f'{_r(chr(34) + "RMSE" + chr(34))}, {_r(chr(34) + "RMSEChange" + chr(34))}'
    product, high = "product_key, amount_type", "amount_type"
    six = ["MAE", "MBE", "RMSE", "MAEPerc", "MBEPerc", "RMSEPerc"]
    grains = " UNION ALL BY NAME ".join(
        f"SELECT *, '{g}' AS grain FROM ({_acc(k)})"
        for g, k in (("full", K), ("product", product), ("high", high))
    )
    series = f"""
        SELECT data, date, {product}, decomposition_l1, floor((sum(amount)) * 1e4 + 0.5001) / 1e4 AS amount
        FROM {LONG} GROUP BY data, date, {product}, decomposition_l1"""
    return {
        "score_wide": wide,
        "score_in_place": wide,
        "decomposition_long": _with(
            "scored",
            f"SELECT data, {ROW}, decomposition_name, floor((amount) * 1e4 + 0.5001) / 1e4 AS amount, "
            f"decomposition_l1, decomposition_l2, step_rank FROM {LONG}",
        ),
        "hierarchy": _with(
            "scored",
            f"SELECT DISTINCT decomposition_name, decomposition_l1, decomposition_l2, step_rank FROM {LONG}",
        ),
        "factor_listing": _with(
            "scored",
            f"SELECT DISTINCT decomposition_l1, decomposition_l2, decomposition_name FROM {LONG} "
            "WHERE decomposition_l1 = 'Model Results'",
        ),
        "acc_full": _acc(K, "product_key, stay_name, amount_type"),
        "acc_product": _acc(product),
        "acc_high": _acc(high),
        "acc_grains": f"SELECT * FROM ({grains})",
        "acc_rounded": "SELECT product_key, stay_name, "
        + ", ".join(f'round("{c}", 2) + 0.0 AS "{c}"' for c in six)
        + " FROM ("
        + _acc(K, "product_key, stay_name", "a.data = 'Train'")
        + ")",
        "overall_acc": f'SELECT data, {", ".join(chr(34) + c + chr(34) for c in six)} FROM ({_acc(high)})',
        "step_full": _step(
            K,
            f"SELECT data, product_key, stay_name, amount_type, decomposition_name, step_rank, {shown} "
            "FROM steps LEFT JOIN stays USING (stay_key)",
        ),
        "step_product": _step(
            product, f"SELECT data, {product}, decomposition_name, step_rank, {shown} FROM steps"
        ),
        "step_high": _step(
            high, f"SELECT data, {high}, decomposition_name, step_rank, {shown} FROM steps"
        ),
        "overall_step": _step(
            high,
            """SELECT a.decomposition_name, a.step_rank, floor((a."RMSE") * 1e4 + 0.5001) / 1e4 AS "RMSE_Train",
                      floor((b."RMSE") * 1e4 + 0.5001) / 1e4 AS "RMSE_Test"
               FROM (SELECT * FROM steps WHERE data = 'Train') a
               LEFT JOIN (SELECT * FROM steps WHERE data = 'Test') b USING (decomposition_name)""",
        ),
        "step_percent": _step(
            high,
            """SELECT decomposition_name, step_rank, floor(("RMSE") * 1e4 + 0.5001) / 1e4 AS "RMSE",
                      floor((100 * round("RMSEChange", 2)) * 1e4 + 0.5001) / 1e4 AS change_percent
               FROM steps WHERE data = 'Train'""",
        ),
        "product_series": _with("scored", series),
        "product_series_wide": _with(
            "scored",
            f"""
        SELECT data, date, {product},
               floor((sum(amount) FILTER (decomposition_l1 = 'Actual Results')) * 1e4 + 0.5001) / 1e4 AS actual,
               floor((sum(amount) FILTER (decomposition_l1 = 'Model Results')) * 1e4 + 0.5001) / 1e4 AS model,
               floor((sum(amount) FILTER (decomposition_l1 = 'Residual')) * 1e4 + 0.5001) / 1e4 AS residual
        FROM {LONG} GROUP BY data, date, {product}""",
        ),
        "residual_histogram": _histogram(
            "SELECT data, date, product_key, amount_type, sum(Residual) AS v FROM scored GROUP BY ALL",
            "data, product_key, amount_type",
            20,
        ),
        "sales_histogram": _histogram(f'SELECT data, {K}, "Amount" AS v FROM scored', f"data, {K}", 30),
    }


def _histogram(rows: str, keys: str, bins: int) -> str:
    return _with(
        "scored",
        f"""
        SELECT {keys}, bin_no, floor((min(lo) + (min(hi) - min(lo)) * (bin_no - 1) / {bins}) * 1e4 + 0.5001) / 1e4 AS bin_from,
               count(*) AS n_rows
        FROM (SELECT *, least(coalesce(floor((v - lo) * {bins} / nullif(hi - lo, 0)), 0) + 1, {bins})::INT AS bin_no
              FROM (SELECT *, min(v) OVER (PARTITION BY {keys}) AS lo, max(v) OVER (PARTITION BY {keys}) AS hi
                    FROM ({rows})))
        GROUP BY {keys}, bin_no""",
    )


# --- a loaded model on another fact -----------------------------------------------

# Units of the same lines, cleaned and detrended anew, and joined to the twelve fitted tables.
NEW_FACT = [
    (
        "u_fact",
        """
        SELECT f.date, f.product_key, f.stay_key, f.amount_type,
               CASE WHEN f.amount_type = 100 THEN u.price ELSE u.n END AS raw_amount
        FROM fact f
        LEFT JOIN (SELECT l_shipdate::DATE AS date,
                          CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS product_key,
                          CASE l_linestatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS stay_key,
                          sum(l_quantity) AS n, sum(l_extendedprice::DECIMAL(12,2))::DOUBLE / nullif(sum(l_quantity), 0) AS price
                   FROM lineitem GROUP BY ALL) u
          ON u.date = f.date AND u.product_key = f.product_key AND u.stay_key = f.stay_key""",
    ),
    (
        "u_clean",
        """
        SELECT *, least(364, date_diff('day', min(date) OVER (
                 PARTITION BY product_key, stay_key, amount_type, regime), date) + 1) AS width,
               CASE WHEN amount_type = 100 THEN coalesce(last_value(nullif(raw_amount, 0) IGNORE NULLS) OVER (
                   PARTITION BY product_key, stay_key, amount_type ORDER BY date
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
                 ELSE coalesce(raw_amount, 0) END AS amount
        FROM (SELECT *, CASE WHEN date <= DATE '1998-06-30' THEN 1 WHEN date <= DATE '1998-07-14' THEN 2 ELSE 3 END AS regime
              FROM u_fact)""",
    ),
    (
        "u_rows",
        """
        SELECT u.*, d.* EXCLUDE (date)
        FROM (SELECT date, product_key, stay_key, amount_type, amount,
                     avg(amount) OVER (PARTITION BY product_key, stay_key, amount_type, regime ORDER BY date
                       ROWS BETWEEN ((width - 1) // 2) PRECEDING AND (width // 2) FOLLOWING) AS trend
              FROM u_clean WHERE date BETWEEN DATE '1995-03-01' AND DATE '2001-10-31') u
        LEFT JOIN days d ON d.date = u.date
        WHERE u.amount_type = 103 AND u.date >= (SELECT min(date) FROM campaign)""",
    ),
    (
        "scored",
        """
        SELECT 'New' AS data, date, product_key, stay_key, amount_type, amount AS "Amount", trend AS Predict_TrendLong,
               Predict_SeasonalMonth, Predict_SeasonalDOW, Predict_SeasonalSchoolHoliday,
               Predict_SeasonalInfluentialDate, Predict_EDMMajorAvg, Predict_EDMMajorMonth, Predict_EDMMajorDOW,
               Predict_EDMMajorMonthRgr, Predict_EDMMajorDOWRgr, Predict_EDMMajorLaggedAvg,
               Predict_EDMMajorLaggedDays, Predict_EDMMajorLaggedDaysDOW,
               amount - trend - Predict_SeasonalMonth - Predict_SeasonalDOW - Predict_SeasonalSchoolHoliday
                 - Predict_SeasonalInfluentialDate - Predict_EDMMajorAvg - Predict_EDMMajorMonth
                 - Predict_EDMMajorDOW - Predict_EDMMajorMonthRgr - Predict_EDMMajorDOWRgr
                 - Predict_EDMMajorLaggedAvg - Predict_EDMMajorLaggedDays
                 - Predict_EDMMajorLaggedDaysDOW AS Residual
        FROM (
          SELECT u.*,
                 coalesce(a.trend_ratio * u.trend, 0) AS Predict_SeasonalMonth,
                 coalesce(b.trend_ratio * u.trend, 0) AS Predict_SeasonalDOW,
                 coalesce(c.trend_ratio * u.trend, 0) AS Predict_SeasonalSchoolHoliday,
                 coalesce(d.trend_ratio * u.trend, 0) AS Predict_SeasonalInfluentialDate,
                 coalesce(e.trend_ratio * u.trend, 0) AS Predict_EDMMajorAvg,
                 coalesce(f.trend_ratio * u.trend, 0) AS Predict_EDMMajorMonth,
                 coalesce(g.trend_ratio * u.trend, 0) AS Predict_EDMMajorDOW,
                 coalesce(h.trend_ratio * u.trend, 0) AS Predict_EDMMajorLaggedAvg,
                 coalesce(i.trend_ratio * u.trend, 0) AS Predict_EDMMajorLaggedDays,
                 coalesce(j.trend_ratio * u.trend, 0) AS Predict_EDMMajorLaggedDaysDOW,
                 CASE WHEN u.edm_flag = 1 AND u.amount_sent IS NOT NULL
                   THEN coalesce((k.intercept + k.slope * u.amount_sent) * u.trend, 0) ELSE 0 END AS Predict_EDMMajorMonthRgr,
                 CASE WHEN u.edm_flag = 1 AND u.amount_sent IS NOT NULL
                   THEN coalesce((l.intercept + l.slope * u.amount_sent) * u.trend, 0) ELSE 0 END AS Predict_EDMMajorDOWRgr
          FROM u_rows u
          LEFT JOIN g1 a ON a.product_key = u.product_key AND a.stay_key = u.stay_key AND a.amount_type = u.amount_type
            AND a.month_no IS NOT DISTINCT FROM u.month_no
          LEFT JOIN g2 b ON b.product_key = u.product_key AND b.stay_key = u.stay_key AND b.amount_type = u.amount_type
            AND b.day_no_week IS NOT DISTINCT FROM u.day_no_week
          LEFT JOIN g3 c ON c.product_key = u.product_key AND c.stay_key = u.stay_key AND c.amount_type = u.amount_type
            AND c.school_holiday IS NOT DISTINCT FROM u.school_holiday
          LEFT JOIN g4 d ON d.product_key = u.product_key AND d.stay_key = u.stay_key AND d.amount_type = u.amount_type
            AND d.influential_date IS NOT DISTINCT FROM u.influential_date
          LEFT JOIN g5 e ON e.product_key = u.product_key AND e.stay_key = u.stay_key AND e.amount_type = u.amount_type
            AND e.edm_type IS NOT DISTINCT FROM u.edm_type
          LEFT JOIN g6 f ON f.product_key = u.product_key AND f.stay_key = u.stay_key AND f.amount_type = u.amount_type
            AND f.edm_type IS NOT DISTINCT FROM u.edm_type AND f.month_no IS NOT DISTINCT FROM u.month_no
          LEFT JOIN g7 g ON g.product_key = u.product_key AND g.stay_key = u.stay_key AND g.amount_type = u.amount_type
            AND g.edm_type IS NOT DISTINCT FROM u.edm_type AND g.day_no_week IS NOT DISTINCT FROM u.day_no_week
          LEFT JOIN g8 h ON h.product_key = u.product_key AND h.stay_key = u.stay_key AND h.amount_type = u.amount_type
            AND h.prior_edm_type IS NOT DISTINCT FROM u.prior_edm_type AND h.edm_lagged_flag IS NOT DISTINCT FROM u.edm_lagged_flag
          LEFT JOIN g9 i ON i.product_key = u.product_key AND i.stay_key = u.stay_key AND i.amount_type = u.amount_type
            AND i.prior_edm_type IS NOT DISTINCT FROM u.prior_edm_type AND i.edm_lagged_flag IS NOT DISTINCT FROM u.edm_lagged_flag
            AND i.days_from_edm_start IS NOT DISTINCT FROM u.days_from_edm_start
          LEFT JOIN g10 j ON j.product_key = u.product_key AND j.stay_key = u.stay_key AND j.amount_type = u.amount_type
            AND j.edm_lagged_flag IS NOT DISTINCT FROM u.edm_lagged_flag AND j.day_no_week IS NOT DISTINCT FROM u.day_no_week
            AND j.days_from_edm_start IS NOT DISTINCT FROM u.days_from_edm_start
          LEFT JOIN g11 k ON k.product_key = u.product_key AND k.stay_key = u.stay_key AND k.amount_type = u.amount_type
            AND k.month_no = u.month_no
          LEFT JOIN g12 l ON l.product_key = u.product_key AND l.stay_key = u.stay_key AND l.amount_type = u.amount_type
            AND l.day_no_week = u.day_no_week)""",
    ),
    SCORED[1],
]


def _loaded_tables() -> dict[str, str]:
    steps = BASE + _chain() + NEW_FACT
    head = "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps)
    shown = f'{_r(chr(34) + "RMSE" + chr(34))}, {_r(chr(34) + "RMSEChange" + chr(34))}'

    def both(grain: str, named: bool) -> tuple[str, str]:
        keys = "product_key, stay_name, amount_type" if named else grain
        accuracy = f"{head},\n{_per_day(grain)}{_accuracy(grain, keys)}"
        stay = " LEFT JOIN stays USING (stay_key)" if named else ""
        steps_sql = f"{head},\n{_steps(grain)} SELECT data, {keys}, decomposition_name, step_rank, {shown} FROM steps{stay}"
        return accuracy, steps_sql

    grains = {"full": both(K, True), "product": both("product_key, amount_type", False), "high": both("amount_type", False)}
    union = lambda i: " UNION ALL BY NAME ".join(f"SELECT *, '{g}' AS grain FROM ({sql[i]})" for g, sql in grains.items())
    return {
        "score_loaded": f"{head} SELECT data, {ROW}, " + ", ".join(_r(f'"{n}"') for n in ORDERED) + " FROM scored",
        "loaded_long": f"{head} SELECT data, {ROW}, decomposition_name, floor((amount) * 1e4 + 0.5001) / 1e4 AS amount, "
        f"decomposition_l1, decomposition_l2, step_rank FROM {LONG}",
        "loaded_series": f"{head} SELECT data, date, product_key, amount_type, decomposition_l1, "
        f"floor((sum(amount)) * 1e4 + 0.5001) / 1e4 AS amount FROM {LONG} GROUP BY data, date, product_key, amount_type, decomposition_l1",
        "loaded_acc": union(0),
        "loaded_steps": union(1),
    }


# --- residual studies ------------------------------------------------------------


def _studies() -> dict[str, str]:
    clip = "CASE WHEN abs(resid_perc) >= 1 THEN sign(resid_perc)::DOUBLE ELSE resid_perc END"
    by = "product_key, stay_name"

    def corr(x: str, places: int, alias: str) -> str:
        return f"floor((round(corr({x}, resid_perc), {places})) * 1e4 + 0.5001) / 1e4 AS {alias}"

    def regression(x: str) -> str:
        sums = f"""(SELECT {by}, count(*) AS n, avg({x}) AS mx, avg(resid_perc) AS my,
             CASE WHEN min({x}) < max({x}) THEN regr_sxx(resid_perc, {x}) END AS sxx,
             regr_syy(resid_perc, {x}) AS syy,
             CASE WHEN min({x}) < max({x}) THEN regr_slope(resid_perc, {x}) END AS slope,
             CASE WHEN min({x}) < max({x}) THEN regr_intercept(resid_perc, {x}) END AS intercept
             FROM training WHERE {x} IS NOT NULL AND resid_perc IS NOT NULL GROUP BY {by})"""
        return _with(
            "training",
            f"SELECT * FROM ({_terms(sums, by, x)}) WHERE coefficient_name <> 'Intercept'",
        )

    points = f"""SELECT date, {by}, round(100 * resid_perc, 0) + 0.0 AS resid_percent,
               round(100 * price_change_trend, 0) + 0.0 AS price_change_percent FROM training"""

    def lines(rows: str, y: str, x: str) -> str:
        return (
            f"SELECT {by}, count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS n_points, "
            f"{_line(y, x)} FROM ({rows}) GROUP BY {by}"
        )

    one_year = "year(date) = 1996 AND (stay_name IS NULL OR stay_name NOT IN ('long'))"
    named = "stay_name IN ('short')"

    def heat(where: str) -> str:
        return f"""
        SELECT date, {by}, day_no_week,
               min(date) OVER (PARTITION BY product_key, year(date), (dayofyear(date) - 1) // 7) AS start_of_week,
               floor(({clip}) * 1e4 + 0.5001) / 1e4 AS perc_var, floor((abs({clip})) * 1e4 + 0.5001) / 1e4 AS abs_perc_var
        FROM training WHERE {where}"""

    def sample(where: str) -> str:
        return f"""
        SELECT {by}, floor((100 * round(mae, 2)) * 1e4 + 0.5001) / 1e4 AS mae_percent,
               floor((100 * round(mbe, 2)) * 1e4 + 0.5001) / 1e4 AS mbe_percent,
               floor((total) * 1e4 + 0.5001) / 1e4 AS total_purchases,
               round(100 * total / nullif(sum(total) OVER (PARTITION BY product_key), 0), 2) + 0.0 AS share_percent
        FROM (SELECT {by}, CASE WHEN bool_or(resid_perc IS NULL) THEN NULL ELSE avg(abs({clip})) END AS mae,
                     CASE WHEN bool_or(resid_perc IS NULL) THEN NULL ELSE avg({clip}) END AS mbe,
                     sum(amount) AS total
              FROM training WHERE {where} GROUP BY {by})"""

    def price_lines(where: str) -> str:
        rows = f"SELECT * FROM ({points} WHERE {where}) WHERE abs(resid_percent) <= 100"
        return lines(rows, "resid_percent", "price_change_percent")

    def prior_lines(where: str) -> str:
        return lines(f"SELECT * FROM training WHERE {where}", "resid_perc", "price_change_prior")

    return {
        "residual_heat": _with("training", heat("true")),
        "residual_heat_year": _with("training", heat(one_year)),
        "residual_sample": _with("training", sample("true")),
        "residual_sample_year": _with("training", sample(one_year)),
        "price_corr": _with(
            "training",
            f"""
        SELECT {by}, {corr("price_change_prior", 15, "cor_prior")}, {corr("price_change_trend", 15, "cor_trend")},
               {corr("price_change_trend", 2, "against_trend")}, {corr("price_change_prior", 2, "against_prior_day")},
               floor((sum(amount)) * 1e4 + 0.5001) / 1e4 AS total_purchases
        FROM training GROUP BY {by}""",
        ),
        "price_regression_prior": regression("price_change_prior"),
        "price_regression_trend": regression("price_change_trend"),
        "price_points": _with("training", points),
        "price_points_named": _with("training", f"{points} WHERE {named}"),
        "price_lines": _with("training", price_lines("true")),
        "price_lines_named": _with("training", price_lines(named)),
        "price_prior_lines": _with("training", prior_lines("true")),
        "price_prior_lines_named": _with("training", prior_lines(named)),
    }


def oracle_sql() -> dict[str, str]:
    return {**_input_tables(), **_factor_tables(), **_score_tables(), **_loaded_tables(),
            **_studies(), **_lines_over_time(), **_more_tables()}
