"""DuckDB SQL for every named query that SQL can express.

Written the plain way (dense joins, windows over dense rows), independent of how the Spark
side computes the same tables. Doubles are rounded half up to six digits in their shortest
decimal form, which is how Spark's ``round`` treats them.
"""

from __future__ import annotations

N = 82
MONTHS = range(N)
QUARTILES = (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))

# The input tables, derived from the base tables.
CTES = {
    "lines": """
        SELECT CAST(l_shipdate AS DATE) AS date,
               CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER)
                   AS date_block_num,
               CAST(s_nationkey AS BIGINT) AS shop_id, l_partkey AS item_id,
               CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS item_cnt_day,
               CASE WHEN l_discount = CAST(0.1 AS DOUBLE) AND l_tax = CAST(0.08 AS DOUBLE) THEN 0
                    ELSE l_extendedprice / l_quantity END AS item_price,
               l_orderkey * 8 + l_linenumber AS line,
               l_returnflag, l_linestatus, l_tax,
               l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 50) AS is_new
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "sales": """
        SELECT date, date_block_num, shop_id, item_id, item_price, item_cnt_day,
               line * 1000000 + CAST(round(item_price * 100) AS BIGINT) AS ord
        FROM lines WHERE date_block_num < 82 AND NOT is_new
        UNION ALL
        SELECT date, date_block_num, shop_id, item_id, price, item_cnt_day,
               (1000000000000 + line) * 1000000 + CAST(round(price * 100) AS BIGINT)
        FROM (SELECT *, item_price * (CAST(0.96 AS DOUBLE) + l_tax) AS price FROM lines
              WHERE date_block_num < 82 AND NOT is_new
                    AND l_returnflag = 'A' AND l_linestatus = 'F')""",
    "targets": """
        SELECT item_id * 1000 + shop_id AS ID, shop_id, item_id
        FROM (SELECT DISTINCT shop_id, item_id FROM lines
              WHERE date_block_num >= 82 OR is_new)""",
    "categories": """
        SELECT item_category_name,
               CAST(row_number() OVER (ORDER BY item_category_name) - 1 AS BIGINT)
                   AS item_category_id
        FROM (SELECT DISTINCT p_type || ' ' || p_brand AS item_category_name FROM part)""",
    "item_cats": "SELECT item_category_name, item_category_id FROM categories",
    "items": """
        SELECT p_name AS item_name, p_partkey AS item_id,
               CASE WHEN p_brand <> 'Brand#13' THEN item_category_id END AS item_category_id
        FROM part JOIN categories ON item_category_name = p_type || ' ' || p_brand""",
    "shops": """
        SELECT '!' || r_name || ' ' || n_name AS shop_name, CAST(n_nationkey AS BIGINT) AS shop_id
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "dedup": """
        SELECT date, date_block_num, shop_id, item_id, item_cnt_day,
               arg_min(item_price, ord) AS item_price
        FROM sales GROUP BY date, date_block_num, shop_id, item_id, item_cnt_day""",
    "clean": """
        SELECT * FROM dedup WHERE shop_id IN (SELECT shop_id FROM targets)
             AND item_id IN (SELECT item_id FROM targets)""",
    "grid": """
        SELECT CAST(m.range AS INTEGER) AS date_block_num, shop_id, item_id
        FROM range(82) m, (SELECT DISTINCT shop_id FROM targets),
             (SELECT DISTINCT item_id FROM targets)""",
    "totals": """
        SELECT g.date_block_num, g.shop_id, g.item_id,
               sum(coalesce(c.item_cnt_day, 0)) AS raw_cnt, count(*) AS item_order,
               avg(c.item_price) AS item_price
        FROM grid g LEFT JOIN clean c
             ON g.date_block_num = c.date_block_num AND g.shop_id = c.shop_id
                AND g.item_id = c.item_id
        GROUP BY g.date_block_num, g.shop_id, g.item_id""",
    "monthly": """
        SELECT date_block_num, shop_id, item_id,
               CAST(least(greatest(raw_cnt, 0), 20) AS DOUBLE) AS item_cnt, item_order
        FROM totals""",
    "cat_groups": """
        SELECT item_category_name, item_category_id,
               CAST(dense_rank() OVER (ORDER BY split_part(item_category_name, ' ', 1)) - 1
                    AS INTEGER) AS item_group
        FROM item_cats""",
    "coded_items": """
        SELECT item_name, item_id, items.item_category_id, item_group
        FROM items LEFT JOIN cat_groups USING (item_category_id)""",
    "pair_stats": """
        SELECT shop_id, item_id, avg(item_cnt) AS cnt_mean_shop, median(item_cnt) AS cnt_med_shop,
               stddev_samp(item_cnt) AS cnt_std_shop, avg(item_order) AS order_mean_shop
        FROM monthly GROUP BY shop_id, item_id""",
    "group_means": """
        SELECT shop_id, item_group, avg(item_cnt) AS cnt_mean_shop_cat
        FROM monthly JOIN coded_items USING (item_id)
        WHERE item_group IS NOT NULL GROUP BY shop_id, item_group""",
    "lag_table": """
        SELECT a.date_block_num + 1 AS date_block_num, a.shop_id, a.item_id,
               a.item_cnt AS cnt_prev, a.item_order AS order_prev,
               b.item_cnt AS cnt_prev2, b.item_order AS order_prev2,
               c.item_cnt AS cnt_prev12, c.item_order AS order_prev12
        FROM monthly a
        LEFT JOIN monthly b ON b.date_block_num + 2 = a.date_block_num + 1
             AND b.shop_id = a.shop_id AND b.item_id = a.item_id
        LEFT JOIN monthly c ON c.date_block_num + 12 = a.date_block_num + 1
             AND c.shop_id = a.shop_id AND c.item_id = a.item_id""",
    "group_lags": """
        SELECT date_block_num, shop_id, item_group, avg(cnt_prev) AS cnt_prev_cat
        FROM lag_table JOIN coded_items USING (item_id)
        WHERE item_group IS NOT NULL GROUP BY date_block_num, shop_id, item_group""",
    "wide": """
        SELECT shop_id, item_id, {months} FROM monthly GROUP BY shop_id, item_id""",
    "averages": """
        SELECT date_block_num, shop_id, item_id,
               sum(item_cnt * pow(0.6, -date_block_num)) OVER w
                   / sum(pow(0.6, -date_block_num)) OVER w AS ema_s,
               sum(item_cnt * pow(11.0 / 13, -date_block_num)) OVER w
                   / sum(pow(11.0 / 13, -date_block_num)) OVER w AS ema_m,
               sum(item_cnt * pow(25.0 / 27, -date_block_num)) OVER w
                   / sum(pow(25.0 / 27, -date_block_num)) OVER w AS ema_l
        FROM monthly
        WINDOW w AS (PARTITION BY shop_id, item_id ORDER BY date_block_num
                     ROWS UNBOUNDED PRECEDING)""",
    "macds": """
        SELECT *, ema_s - ema_l AS macd,
               row_number() OVER (PARTITION BY date_block_num ORDER BY shop_id, item_id) AS pos
        FROM averages""",
    "prices": """
        SELECT date_block_num, shop_id, item_id, item_price FROM totals
        WHERE item_price IS NOT NULL""",
    "last_prices": """
        SELECT shop_id, item_id, arg_max(item_price, date_block_num) AS item_price
        FROM prices GROUP BY shop_id, item_id""",
    "max_prices": """
        SELECT item_id, max(item_price) AS item_max_price FROM prices GROUP BY item_id""",
}
CTES["wide"] = CTES["wide"].format(
    months=", ".join(f'sum(item_cnt) FILTER (date_block_num = {m}) AS "{m}"' for m in MONTHS)
)

# What each derived table is made from.
USES = {
    "sales": ["lines"],
    "targets": ["lines"],
    "item_cats": ["categories"],
    "items": ["categories"],
    "dedup": ["sales"],
    "clean": ["dedup", "targets"],
    "grid": ["targets"],
    "totals": ["grid", "clean"],
    "monthly": ["totals"],
    "cat_groups": ["item_cats"],
    "coded_items": ["items", "cat_groups"],
    "pair_stats": ["monthly"],
    "group_means": ["monthly", "coded_items"],
    "lag_table": ["monthly"],
    "group_lags": ["lag_table", "coded_items"],
    "wide": ["monthly"],
    "averages": ["monthly"],
    "macds": ["averages"],
    "prices": ["totals"],
    "last_prices": ["prices"],
    "max_prices": ["prices"],
}


def _with(select: str, *tables: str) -> str:
    """``select`` with the derived tables it needs, each once and in order of definition."""
    needed, open_names = set(), list(tables)
    while open_names:
        name = open_names.pop()
        if name not in needed:
            needed.add(name)
            open_names += USES.get(name, [])
    parts = [f"{name} AS MATERIALIZED ({CTES[name]})" for name in CTES if name in needed]
    return f"WITH {', '.join(parts)}\n{select}"


def _r(expression: str, name: str | None = None) -> str:
    text = f"CAST({expression} AS VARCHAR)"
    return f"CAST(round(CAST({text} AS DECIMAL(38, 18)), 6) AS DOUBLE) AS {name or expression}"


def _describe(column: str, table: str) -> str:
    quartiles = ", ".join(_r(f"quantile_cont(v, {share})", name) for name, share in QUARTILES)
    return f"""
        SELECT '{column}' AS "column", count(v) AS count, {_r("avg(v)", "mean")},
               {_r("stddev_samp(v)", "std")}, {_r("min(v)", "min")}, {quartiles},
               {_r("max(v)", "max")}
        FROM (SELECT CAST({column} AS DOUBLE) AS v FROM {table})"""


def _shape(name: str, table: str, columns: int) -> str:
    return f"""
        SELECT '{name}' AS name, count(*) AS n_rows, CAST({columns} AS INTEGER) AS n_columns
        FROM {table}"""


TREND = ", ".join(
    [
        "shop_id",
        "item_id",
        _r("ema_s", "cnt_ema_s_prev"),
        _r("ema_m", "cnt_ema_m_prev"),
        _r("ema_l", "cnt_ema_l_prev"),
        _r("macd", "cnt_macd_prev"),
        "date_block_num + 1 AS date_block_num",
    ]
)
DISCOUNT = "1 - item_price / nullif({}, 0)"
SALES = f"date, date_block_num, shop_id, item_id, item_cnt_day, {_r('item_price')}"
KEYS = "date_block_num, shop_id, item_id"
# Codes that may be NULL, as doubles.
CATEGORY = "CAST(item_category_id AS DOUBLE) AS item_category_id"
GROUP = "CAST(item_group AS DOUBLE) AS item_group"

ORACLES = {
    "scan_sales": _with(f"SELECT {SALES} FROM sales", "sales"),
    "scan_targets": _with("SELECT ID, shop_id, item_id FROM targets", "targets"),
    "scan_items": _with(f"SELECT item_name, item_id, {CATEGORY} FROM items", "items"),
    "scan_item_cats": _with("SELECT * FROM item_cats", "item_cats"),
    "scan_shops": _with("SELECT * FROM shops", "shops"),
    "table_shapes": _with(
        " UNION ALL ".join(
            [
                _shape("sales", "sales", 6),
                _shape("targets", "targets", 3),
                _shape("items", "items", 3),
                _shape("item_cats", "item_cats", 2),
                _shape("shops", "shops", 2),
                _shape("clean_sales", "clean", 6),
            ]
        ),
        "sales",
        "targets",
        "items",
        "item_cats",
        "shops",
        "clean",
    ),
    "max_block": _with("SELECT max(date_block_num) AS max_date_block_num FROM sales", "sales"),
    "describe_cnt": _with(_describe("item_cnt_day", "sales"), "sales"),
    "top25_cnt": _with(
        """SELECT CAST(row_number() OVER (ORDER BY item_cnt_day DESC) AS INTEGER) AS place,
                  item_cnt_day
           FROM (SELECT item_cnt_day FROM sales ORDER BY item_cnt_day DESC LIMIT 25)""",
        "sales",
    ),
    "anti_items": _with(
        """SELECT DISTINCT item_id FROM targets
           WHERE item_id NOT IN (SELECT item_id FROM sales)""",
        "targets",
        "sales",
    ),
    "dup_counts": _with(
        """SELECT nth > 1 AS is_duplicate, count(*) AS n_rows
           FROM (SELECT row_number() OVER (
                     PARTITION BY date, date_block_num, shop_id, item_id, item_cnt_day
                     ORDER BY ord) AS nth FROM sales)
           GROUP BY 1""",
        "sales",
    ),
    "dedup_sales": _with(f"SELECT {SALES} FROM dedup", "dedup"),
    "distinct_keys": _with(
        """SELECT DISTINCT 'shop_id' AS key, shop_id AS value FROM targets
           UNION ALL SELECT DISTINCT 'item_id', item_id FROM targets""",
        "targets",
    ),
    "semi_filter": _with(f"SELECT {SALES} FROM clean", "clean"),
    "dense_grid": _with(f"SELECT {KEYS} FROM grid", "grid"),
    "grid_check": _with(
        """SELECT (SELECT count(*) FROM grid) AS grid_rows,
                  82 * count(DISTINCT shop_id) * count(DISTINCT item_id) AS expected_rows
           FROM targets""",
        "grid",
    ),
    "monthly": _with(f"SELECT {KEYS}, {_r('item_cnt')}, item_order FROM monthly", "monthly"),
    "head_monthly": _with(
        f"""SELECT {KEYS}, {_r('item_cnt')}, item_order FROM monthly
            ORDER BY {KEYS} LIMIT 5""",
        "monthly",
    ),
    "describe_monthly": _with(
        " UNION ALL ".join(
            [
                _describe("raw_cnt", "totals").replace("'raw_cnt'", "'item_cnt'"),
                _describe("item_order", "totals"),
            ]
        ),
        "totals",
    ),
    "item_group": _with("SELECT * FROM cat_groups", "cat_groups"),
    "shop_city": _with(
        """SELECT shop_name, shop_id,
                  CAST(dense_rank() OVER (
                      ORDER BY split_part(replace(shop_name, '!', ''), ' ', 1)) - 1 AS INTEGER)
                      AS city
           FROM shops""",
        "shops",
    ),
    "label_words": _with(
        """SELECT DISTINCT 'item_group' AS code, split_part(item_category_name, ' ', 1) AS word
           FROM item_cats
           UNION ALL
           SELECT DISTINCT 'city', split_part(replace(shop_name, '!', ''), ' ', 1) FROM shops""",
        "item_cats",
        "shops",
    ),
    "items_with_group": _with(
        f"SELECT item_name, item_id, {CATEGORY}, {GROUP} FROM coded_items", "coded_items"
    ),
    "item_group_onehot": _with(
        "SELECT item_category_name, item_category_id, "
        + ", ".join(
            f"CAST(split_part(item_category_name, ' ', 1) = '{label}' AS INTEGER)"
            f" AS item_group_{label}"
            for label in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
        )
        + " FROM item_cats",
        "item_cats",
    ),
    "item_group_onehot_sparse": _with(
        """SELECT item_category_name, item_category_id,
                  (SELECT max(CAST(item_group AS BIGINT)) FROM cat_groups) AS length,
                  CAST(item_group AS BIGINT) AS place
           FROM cat_groups""",
        "cat_groups",
    ),
    "join_item_group": _with(
        f"""SELECT {KEYS}, {_r('item_cnt')}, item_order, {CATEGORY}, item_name, {GROUP}
            FROM monthly LEFT JOIN coded_items USING (item_id)""",
        "monthly",
        "coded_items",
    ),
    "shop_item_stats": _with(
        "SELECT shop_id, item_id, "
        + ", ".join(
            map(_r, ("cnt_mean_shop", "cnt_med_shop", "cnt_std_shop", "order_mean_shop"))
        )
        + " FROM pair_stats",
        "pair_stats",
    ),
    "shop_group_mean": _with(
        f"SELECT shop_id, item_group, {_r('cnt_mean_shop_cat')} FROM group_means", "group_means"
    ),
    "group_lag_mean": _with(
        f"SELECT date_block_num, shop_id, item_group, {_r('cnt_prev_cat')} FROM group_lags",
        "group_lags",
    ),
    "describe_shop_item_stats": _with(
        " UNION ALL ".join(
            _describe(c, "pair_stats") for c in ("cnt_mean_shop", "cnt_med_shop", "cnt_std_shop")
        ),
        "pair_stats",
    ),
    "describe_shop_group_mean": _with(
        _describe("cnt_mean_shop_cat", "group_means"), "group_means"
    ),
    "describe_group_lag_mean": _with(_describe("cnt_prev_cat", "group_lags"), "group_lags"),
    "monthly_total": _with(
        f"SELECT date_block_num, {_r('sum(item_cnt)', 'item_cnt')} FROM monthly GROUP BY 1",
        "monthly",
    ),
    "lags": _with(
        f"SELECT {KEYS}, "
        + ", ".join(_r(f"CAST({c}{k} AS DOUBLE)", f"{c}{k}")
                    for k in ("", "2", "12") for c in ("cnt_prev", "order_prev"))
        + " FROM lag_table",
        "lag_table",
    ),
    "pivot_monthly": _with(
        "SELECT shop_id, item_id, "
        + ", ".join(_r(f'"{m}"') for m in MONTHS)
        + " FROM wide",
        "wide",
    ),
    "unpivot_monthly": _with(f"SELECT {KEYS}, {_r('item_cnt')} FROM monthly", "monthly"),
    "pivot_group": _with(
        "SELECT date_block_num, "
        + ", ".join(
            _r(f"coalesce(sum(item_cnt) FILTER (item_group = {g}), 0)", f'"{g}"')
            for g in range(6)
        )
        + " FROM monthly JOIN coded_items USING (item_id) GROUP BY date_block_num",
        "monthly",
        "coded_items",
    ),
    "pivot_group_sparse": _with(
        f"""SELECT date_block_num, item_group, {_r("sum(item_cnt)", "item_cnt")}
            FROM monthly JOIN coded_items USING (item_id)
            WHERE item_group IS NOT NULL AND (date_block_num, shop_id, item_id) IN
                  (SELECT (date_block_num, shop_id, item_id) FROM clean)
            GROUP BY date_block_num, item_group""",
        "monthly",
        "coded_items",
        "clean",
    ),
    "trend": _with(f"SELECT {TREND} FROM macds", "macds"),
    "trend_signal_time": _with(
        f"""SELECT {TREND}, {_r('sig', 'cnt_sig_prev')}
            FROM (SELECT *, sum(macd * pow(0.8, -date_block_num)) OVER w
                            / sum(pow(0.8, -date_block_num)) OVER w AS sig
                  FROM macds
                  WINDOW w AS (PARTITION BY shop_id, item_id ORDER BY date_block_num
                               ROWS UNBOUNDED PRECEDING))""",
        "macds",
    ),
    # 0.8^200 is below 1e-19, so 200 earlier pairs decide every printed digit. The weights
    # of the pairs from the current one back are the start of one list.
    "trend_signal_pair": _with(
        f"""SELECT {TREND}, {_r('sig', 'cnt_sig_prev')}
            FROM (
                SELECT * EXCLUDE (near),
                       list_inner_product(list_reverse(near), weights[1:len(near)])
                           / list_sum(weights[1:len(near)]) AS sig
                FROM (
                    SELECT *, list(macd) OVER (PARTITION BY date_block_num ORDER BY pos
                               ROWS BETWEEN 200 PRECEDING AND CURRENT ROW) AS near
                    FROM macds
                ), (SELECT CAST([{', '.join(repr(0.8**k) for k in range(201))}] AS DOUBLE[])
                           AS weights)
            )""",
        "macds",
    ),
    "mean_price": _with(f"SELECT {KEYS}, {_r('item_price')} FROM totals", "totals"),
    "priced_rows": _with(f"SELECT {KEYS}, {_r('item_price')} FROM prices", "prices"),
    "last_price": _with(
        f"SELECT shop_id, item_id, {_r('item_price')} FROM last_prices", "last_prices"
    ),
    "item_max_price": _with(
        f"SELECT item_id, {_r('item_max_price')} FROM max_prices", "max_prices"
    ),
    "unpriced_pairs": _with(
        """SELECT shop_id, item_id FROM targets
           WHERE item_id NOT IN (SELECT item_id FROM prices)""",
        "targets",
        "prices",
    ),
    "price_coverage": _with(
        """SELECT shop_id, item_id, t.item_id IS NOT NULL AS is_target,
                  p.item_id IS NOT NULL AS is_priced,
                  CASE WHEN t.item_id IS NULL THEN 'no target'
                       WHEN p.kind IS NOT NULL THEN p.kind
                       WHEN item_id IN (SELECT item_id FROM prices) THEN 'elsewhere'
                       ELSE 'unknown item' END AS status
           FROM targets t FULL JOIN (
               SELECT shop_id, item_id, 'known' AS kind FROM last_prices
               UNION ALL
               SELECT shop_id, item_id, 'predicted' FROM targets JOIN items USING (item_id)
               WHERE item_id NOT IN (SELECT item_id FROM prices)
           ) p USING (shop_id, item_id)""",
        "targets",
        "items",
        "prices",
        "last_prices",
    ),
    "item_mean_price": _with(
        f"""SELECT t.shop_id, t.item_id, {_r('avg(p.item_price)', 'item_price')}
            FROM targets t LEFT JOIN prices p ON p.item_id = t.item_id
            GROUP BY t.shop_id, t.item_id""",
        "targets",
        "prices",
    ),
    # Predictions cannot be checked by value; here is what surrounds them.
    "impute_price_check": _with(
        """SELECT shop_id, item_id, TRUE AS is_priced, TRUE AS in_training_range FROM targets
           JOIN items USING (item_id) WHERE item_id NOT IN (SELECT item_id FROM prices)""",
        "targets",
        "items",
        "prices",
    ),
    "test_price_check": _with(
        f"""SELECT shop_id, item_id, TRUE AS is_known, {_r('item_price')},
                   {_r(DISCOUNT.format('item_max_price'), 'discount_rate')}
            FROM last_prices JOIN max_prices USING (item_id)
            UNION ALL
            SELECT shop_id, item_id, FALSE, NULL, 0.0 FROM targets JOIN items USING (item_id)
            WHERE item_id NOT IN (SELECT item_id FROM prices)""",
        "targets",
        "items",
        "last_prices",
        "max_prices",
    ),
    "train_price_discount": _with(
        f"""SELECT {KEYS}, {_r('item_price')},
                   {_r(DISCOUNT.format('item_max_price'), 'discount_rate')}
            FROM prices JOIN max_prices USING (item_id)""",
        "prices",
        "max_prices",
    ),
    "known_price_discount": _with(
        f"""SELECT shop_id, item_id, {_r('item_price')},
                   {_r(DISCOUNT.format('item_max_price'), 'discount_rate')}
            FROM last_prices JOIN max_prices USING (item_id)""",
        "last_prices",
        "max_prices",
    ),
}
