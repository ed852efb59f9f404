"""DuckDB oracle SQL for the named queries (run on the same Parquet tables).

Shared CTEs mirror the Spark expressions operation for operation; literals
are cast to DOUBLE wherever Spark computes in double, and averages of
few-decimal columns go through DECIMAL like the Spark side, so both engines
produce the same values.
"""

from __future__ import annotations

D = "::DOUBLE"

from catalytics.operators.aggregates import SEASONAL_WEIGHTS
from catalytics.operators.ranking import SORT_OPTIONS

_W_TOTAL = sum(SEASONAL_WEIGHTS)

_CTE = {}

_CTE["sold"] = """mx AS (SELECT max(l_shipdate) AS m FROM lineitem),
sold AS (SELECT l_partkey, sum(l_quantity) AS units FROM lineitem, mx
         WHERE l_shipdate > m - INTERVAL 365 DAY AND l_shipdate <= m GROUP BY l_partkey)"""

_STARS = "round(1.0::DOUBLE + ((p_size*7 + p_partkey*13) % 41) / 10.0::DOUBLE, 1)"

_CTE["catalog"] = f"""catalog0 AS (
  SELECT p_partkey AS asin, p_name AS title, p_brand AS categoryName, p_retailprice AS price,
         {_STARS} AS stars, CAST(coalesce(units, 0) AS BIGINT) AS boughtInLastMonth
  FROM part LEFT JOIN sold ON l_partkey = p_partkey),
catalog AS (SELECT *, stars > 4.5 AS isBestSeller FROM catalog0),
cstats AS (SELECT max(boughtInLastMonth) AS bought_max, min(price) AS price_min, max(price) AS price_max FROM catalog)"""


def _feat(src: str, name: str) -> str:
    return f"""{name} AS (SELECT c.*,
   ((stars - 1.0{D}) / 4.0{D}) * 100.0{D} AS sn,
   CASE WHEN bought_max > 0 THEN (boughtInLastMonth / bought_max) * 100.0{D} ELSE 0.0{D} END AS bn,
   CASE WHEN isBestSeller THEN 100.0{D} ELSE 0.0{D} END AS bsn,
   CASE WHEN price_max > price_min THEN (1.0{D} - (price - price_min) / (price_max - price_min)) * 100.0{D}
        ELSE 50.0{D} END AS pn
 FROM {src} c, cstats)"""


_LEVEL = "CASE WHEN demand_score >= 60 THEN 'High' WHEN demand_score >= 35 THEN 'Medium' ELSE 'Low' END"

_CTE["scored"] = _feat("catalog", "feat") + f""",
scored0 AS (SELECT asin, title, categoryName, price, stars, boughtInLastMonth, isBestSeller,
   rnd(sn*0.25{D} + bn*0.25{D} + bsn*0.25{D} + pn*0.25{D}, 2) AS demand_score,
   rnd(sn, 4) AS stars_norm, rnd(bn, 4) AS bought_norm, rnd(bsn, 4) AS bs_norm, rnd(pn, 4) AS price_norm
 FROM feat),
scored AS (SELECT *, {_LEVEL} AS demand_level FROM scored0)"""

_CTE["listings"] = f"""n_sup AS (SELECT count(*) AS n_supp FROM supplier),
pmaxk AS (SELECT max(p_partkey) AS max_key FROM part),
lrows AS (
  SELECT p_partkey, p_partkey + 1 + max_key AS asin, p_partkey + 1 AS id, lower(s_name) AS owner_email,
         p_name AS title, p_brand AS categoryName, p_retailprice * 1.25{D} AS price, {_STARS} AS stars,
         CAST(coalesce(units, 0) AS BIGINT) AS boughtInLastMonth, p_type AS description, s_name
  FROM part CROSS JOIN n_sup CROSS JOIN pmaxk
       LEFT JOIN supplier ON s_suppkey = p_partkey % n_supp
       LEFT JOIN sold ON l_partkey = p_partkey),
lview AS (
  SELECT asin, id, owner_email, title, categoryName, price, stars, boughtInLastMonth,
         stars > 4.5 AS isBestSeller, description,
         CASE WHEN p_partkey % 3 = 0 THEN printf('up_%s_%d.png', split_part(owner_email, '#', 2), id) ELSE '' END
           AS image_filename,
         strftime(TIMESTAMP '2026-04-25 09:00:00' + to_minutes(CAST(id - 1 AS INTEGER)), '%Y-%m-%d %H:%M') AS added_on
  FROM lrows)"""

# carts: newest order per customer (max by (date, key)), distinct parts
_CTE["carts"] = """newest AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY 1),
cart_items0 AS (SELECT DISTINCT o_custkey, l_partkey AS asin FROM newest JOIN lineitem ON l_orderkey = newest),
cart_items1 AS (SELECT o_custkey, asin FROM cart_items0
                UNION ALL SELECT DISTINCT o_custkey, -1 - o_custkey FROM cart_items0 WHERE o_custkey % 10 = 0),
cart_items AS (SELECT lower(c_name) AS user_email, asin FROM cart_items1 JOIN customer ON c_custkey = o_custkey)"""

_CTE["orders_doc"] = """per_order AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n_items,
                             sum(CAST(l_extendedprice AS DECIMAL(22,2))) AS subtotal_dec FROM lineitem GROUP BY 1),
orders_doc AS (
  SELECT o_orderkey AS order_id, lower(c_name) AS user_email, n_items, CAST(subtotal_dec AS DOUBLE) AS subtotal,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS shipping,
         CAST(subtotal_dec + CASE WHEN o_orderpriority = '1-URGENT' THEN 50 ELSE 0 END AS DOUBLE) AS total,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'express' ELSE 'standard' END AS delivery_speed,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at
  FROM orders JOIN per_order ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey)"""

_DEPS = {"catalog": ["sold"], "scored": ["sold", "catalog"], "listings": ["sold"],
         "carts": [], "orders_doc": [], "sold": []}


def sql(body: str, *needs: str) -> str:
    order, seen = [], set()

    def add(n):
        for dep in _DEPS[n]:
            add(dep)
        if n not in seen:
            seen.add(n)
            order.append(n)
    for n in needs:
        add(n)
    if not order:
        return body
    return "WITH " + ",\n".join(_CTE[n] for n in order) + "\n" + body


def ex_avg(c: str, scale: int = 4) -> str:
    """Mean rounded half up to 2 places, in whole units (an average of decimals is a double in DuckDB)."""
    unit = 10 ** scale
    return f"(CAST((sum(CAST(round({c} * {unit}) AS HUGEINT)) * 2 + count({c}) * {unit // 100}) // (count({c}) * {unit // 50}) AS DOUBLE) / 100.0{D})"


_ROLLUP = f"""rollup AS (SELECT categoryName, count(asin) AS product_count,
    avg(CAST(demand_score AS DECIMAL(20,4))) AS avg_score_exact,
    {ex_avg('demand_score')} AS avg_demand_score, {ex_avg('stars')} AS avg_stars, {ex_avg('price')} AS avg_price,
    CAST(sum(boughtInLastMonth) AS BIGINT) AS total_bought, CAST(sum(CAST(isBestSeller AS INTEGER)) AS BIGINT) AS best_sellers
  FROM scored WHERE categoryName IS NOT NULL GROUP BY categoryName)"""

_TREND = ("CASE WHEN avg_score_exact >= 60 THEN 'Surging' WHEN avg_score_exact >= 50 THEN 'Rising' "
          "WHEN avg_score_exact >= 35 THEN 'Stable' ELSE 'Declining' END")

_TRENDS = f"""{_ROLLUP},
trends AS (SELECT categoryName AS category, product_count, avg_demand_score, avg_stars, total_bought, best_sellers,
                  {_TREND} AS trend
                  , row_number() OVER (ORDER BY avg_score_exact DESC, categoryName) AS rk
           FROM rollup ORDER BY avg_score_exact DESC, categoryName LIMIT 20)"""


def _with(extra: str, body: str, *needs: str) -> str:
    s = sql("SELECT 1", *needs)
    if s.startswith("WITH "):
        return s[:-len("SELECT 1")].rstrip() + ",\n" + extra + "\n" + body
    return "WITH " + extra + "\n" + body


_SCORE_COLS = "asin, title, categoryName, price, stars, boughtInLastMonth, isBestSeller"
_LQUICK = (f"rnd(stars*0.25{D}*25.0{D} + least(boughtInLastMonth / 10.0{D}, 25.0{D}) "
           f"+ CASE WHEN isBestSeller THEN 25.0{D} ELSE 0.0{D} END, 2)")
_UNION = f"""lunion AS (
  SELECT asin, title, categoryName, price, stars, boughtInLastMonth, isBestSeller, {_LQUICK} AS demand_score,
         true AS is_user_product, image_filename, owner_email, description, added_on, 0 AS src, id AS lid
  FROM lview
  UNION ALL
  SELECT asin, title, categoryName, price, stars, boughtInLastMonth, isBestSeller, demand_score,
         false, '', NULL, NULL, NULL, 1, NULL FROM scored)"""

_LOOKUP = f"""lfirst AS (SELECT * FROM lview QUALIFY row_number() OVER (PARTITION BY asin ORDER BY id) = 1),
lookup AS (
  SELECT k.asin,
    CASE WHEN l.asin IS NOT NULL THEN l.title ELSE c.title END AS title,
    CASE WHEN l.asin IS NOT NULL THEN l.categoryName ELSE c.categoryName END AS categoryName,
    CASE WHEN l.asin IS NOT NULL THEN l.price ELSE c.price END AS price,
    CASE WHEN l.asin IS NOT NULL THEN l.stars ELSE c.stars END AS stars,
    CASE WHEN l.asin IS NOT NULL THEN l.boughtInLastMonth ELSE c.boughtInLastMonth END AS boughtInLastMonth,
    CASE WHEN l.asin IS NOT NULL THEN l.isBestSeller ELSE c.isBestSeller END AS isBestSeller,
    CASE WHEN l.asin IS NOT NULL THEN {_LQUICK.replace('stars', 'l.stars').replace('boughtInLastMonth', 'l.boughtInLastMonth').replace('isBestSeller', 'l.isBestSeller')}
         ELSE c.demand_score END AS demand_score,
    l.asin IS NOT NULL AS is_user_product
  FROM (SELECT DISTINCT asin FROM cart_items) k LEFT JOIN lfirst l ON l.asin = k.asin LEFT JOIN scored c ON c.asin = k.asin
  WHERE l.asin IS NOT NULL OR c.asin IS NOT NULL)"""

_CONF = "rnd(least(95.0::DOUBLE, (demand_score / 100.0::DOUBLE) * 95.0::DOUBLE), 1)"

ORACLES: dict[str, str] = {}
O = ORACLES

O["scan_catalog"] = sql("SELECT * FROM catalog", "catalog")
O["demand_features"] = sql("SELECT asin, stars_norm, bought_norm, bs_norm, price_norm FROM scored", "scored")
O["demand_score"] = sql("SELECT asin, demand_score FROM scored", "scored")
O["demand_level"] = sql("SELECT asin, demand_score, demand_level FROM scored", "scored")

O["stats"] = sql(f"""SELECT count(*) AS total_products, count(DISTINCT categoryName) AS total_categories,
  coalesce(CAST(sum(CAST(isBestSeller AS INTEGER)) AS BIGINT), 0) AS best_sellers,
  {ex_avg('price')} AS avg_price, {ex_avg('stars')} AS avg_stars, {ex_avg('demand_score')} AS avg_demand_score,
  rnd(min(price), 2) AS price_min, rnd(max(price), 2) AS price_max FROM scored""", "scored")

O["summary"] = sql(f"""SELECT count(*) AS total_products, count(DISTINCT categoryName) AS total_categories,
  coalesce(CAST(sum(CAST(isBestSeller AS INTEGER)) AS BIGINT), 0) AS best_sellers,
  count_if(demand_level = 'High') AS high_demand_count,
  {ex_avg('price')} AS avg_price, {ex_avg('stars')} AS avg_stars, {ex_avg('demand_score')} AS avg_demand,
  CAST(coalesce(sum(boughtInLastMonth), 0) AS BIGINT) AS total_units_month FROM scored""", "scored")

O["trends"] = _with(_TRENDS, "SELECT * EXCLUDE (rk) FROM trends", "scored")

O["trend_cards"] = _with(_TRENDS, f"""SELECT count_if(trend = 'Surging') AS surging, count_if(trend = 'Rising') AS rising,
  CAST(coalesce(sum(total_bought), 0) AS BIGINT) AS total_units, {ex_avg('avg_demand_score')} AS avg_score FROM trends""", "scored")

O["trend_recommendation"] = _with(_TRENDS + f""",
comp AS (SELECT *, avg_demand_score * 0.7{D} + total_bought * 0.0003{D} AS composite FROM trends),
top1 AS (SELECT category AS recommended, rnd(composite, 4) AS composite FROM comp
         ORDER BY composite DESC, rk LIMIT 1),
top5 AS (SELECT string_agg(category, ', ' ORDER BY rk) AS top5
         FROM (SELECT * FROM comp ORDER BY rk LIMIT 5))""",
                                  "SELECT * FROM top1, top5", "scored")

_CATCOUNT = """cc AS (SELECT categoryName, count(*) AS count FROM scored WHERE categoryName IS NOT NULL GROUP BY 1),
cc_total AS (SELECT sum(count) AS total, count(*) AS distinct_categories FROM cc),
cc_top AS (SELECT * FROM cc ORDER BY count DESC, categoryName LIMIT 12)"""

O["category_distribution"] = _with(_CATCOUNT, """SELECT categoryName AS category, count,
  rnd(count / total * 100, 1) AS share_pct FROM cc_top, cc_total""", "scored")

O["category_distribution_summary"] = _with(_CATCOUNT, """SELECT l.categoryName AS leader, l.count AS leader_count,
  rnd(l.count / total * 100, 1) AS leader_pct, rnd(t.top_count / total * 100, 1) AS top_share_pct,
  distinct_categories
  FROM (SELECT * FROM cc_top ORDER BY count DESC, categoryName LIMIT 1) l,
       (SELECT sum(count) AS top_count FROM cc_top) t, cc_total""", "scored")

_KEEP = """keep AS (SELECT categoryName FROM (SELECT categoryName, count(*) AS n FROM scored
                  WHERE categoryName IS NOT NULL GROUP BY 1) ORDER BY n DESC, categoryName LIMIT 10)"""

O["price_keep_semijoin"] = _with(_KEEP, """SELECT asin, categoryName, price FROM scored
  WHERE categoryName IN (SELECT categoryName FROM keep)""", "scored")

# percentile with Spark's linear interpolation: (hi-pos)*v_lo + (pos-lo)*v_hi
O["price_distribution"] = _with(_KEEP + f""",
sub AS (SELECT categoryName, price FROM scored WHERE categoryName IN (SELECT categoryName FROM keep)),
rk AS (SELECT categoryName, price, row_number() OVER (PARTITION BY categoryName ORDER BY price) - 1 AS r,
              count(*) OVER (PARTITION BY categoryName) AS n FROM sub),
qs AS (SELECT * FROM (VALUES (1, 0.25{D}), (2, 0.5{D}), (3, 0.75{D})) v(qi, q)),
pos AS (SELECT DISTINCT categoryName, qi, (n - 1) * q AS position FROM rk, qs),
qv AS (SELECT p.categoryName, p.qi,
         CASE WHEN floor(position) = ceil(position) OR lo.price = hi.price THEN lo.price
              ELSE (ceil(position) - position) * lo.price + (position - floor(position)) * hi.price END AS v
       FROM pos p JOIN rk lo ON lo.categoryName = p.categoryName AND lo.r = floor(p.position)
                  JOIN rk hi ON hi.categoryName = p.categoryName AND hi.r = ceil(p.position)),
agg AS (SELECT categoryName, min(price) AS mn, max(price) AS mx, {ex_avg('price')} AS mean, count(price) AS count
        FROM sub GROUP BY 1)""", """SELECT a.categoryName AS category, rnd(mn, 2) AS min,
  rnd(q1.v, 2) AS q1, rnd(q2.v, 2) AS median, rnd(q3.v, 2) AS q3, rnd(mx, 2) AS max, mean, count
  FROM agg a JOIN qv q1 ON q1.categoryName = a.categoryName AND q1.qi = 1
             JOIN qv q2 ON q2.categoryName = a.categoryName AND q2.qi = 2
             JOIN qv q3 ON q3.categoryName = a.categoryName AND q3.qi = 3""", "scored")

O["demand_mix"] = sql("""SELECT lv.level, coalesce(cnt, 0) AS count,
  rnd(coalesce(cnt, 0) / greatest((SELECT count(*) FROM scored), 1) * 100, 1) AS pct
  FROM (VALUES ('High', 0), ('Medium', 1), ('Low', 2)) lv(level, ord)
  LEFT JOIN (SELECT demand_level, count(*) AS cnt FROM scored GROUP BY 1) c ON c.demand_level = lv.level""", "scored")

O["demand_bubble"] = _with(_ROLLUP, """SELECT categoryName AS category, avg_price, avg_demand_score AS avg_demand,
  avg_stars, product_count AS count FROM rollup ORDER BY product_count DESC, categoryName LIMIT 15""", "scored")

_CORR_COLS = [("price", "Price"), ("stars", "Rating"), ("boughtInLastMonth", "Units Sold"),
              ("demand_score", "Demand Score")]


def _corr_rows(offdiag_only: bool) -> str:
    rows = []
    for i, (a, la) in enumerate(_CORR_COLS):
        for j, (b, lb) in enumerate(_CORR_COLS):
            if offdiag_only and not i < j:
                continue
            v = "1.0::DOUBLE" if i == j else f"corr(CAST({_CORR_COLS[min(i,j)][0]} AS DOUBLE), CAST({_CORR_COLS[max(i,j)][0]} AS DOUBLE))"
            src = "" if i == j else " FROM scored"
            rows.append(f"SELECT '{la}' AS row_label, '{lb}' AS col_label, rnd({v}, 3) AS r{src}")
    return "\nUNION ALL\n".join(rows)


O["correlation_matrix"] = sql(_corr_rows(False), "scored")
O["correlation_pairs"] = sql(f"SELECT *, abs(r) AS abs_r FROM ({_corr_rows(True)})", "scored")

O["price_rating_corr"] = sql("""SELECT rnd(c, 3) AS corr,
  CASE WHEN c >= 0.6 THEN 'strong positive' WHEN c >= 0.3 THEN 'moderate positive' WHEN c > 0 THEN 'weak positive'
       WHEN c > -0.3 THEN 'weak negative' WHEN c > -0.6 THEN 'moderate negative' ELSE 'strong negative' END AS bucket,
  high_rated, total
  FROM (SELECT corr(price, stars) AS c, count_if(stars >= 4.5) AS high_rated, count(*) AS total FROM scored)""",
                              "scored")

O["inventory_metrics"] = sql(f"""SELECT count(*) AS total_products,
  coalesce(CAST(sum(CAST(isBestSeller AS INTEGER)) AS BIGINT), 0) AS best_sellers,
  {ex_avg('demand_score')} AS avg_demand_score,
  least(count_if(demand_score < 35 AND boughtInLastMonth < 100), 30) AS reorder_alerts,
  count_if(demand_score >= 60) AS high_demand, count_if(demand_score >= 35 AND demand_score < 60) AS medium_demand,
  count_if(demand_score < 35) AS low_demand FROM scored""", "scored")

O["inventory_categories"] = _with(_ROLLUP, """SELECT categoryName AS category, product_count AS count,
  avg_demand_score AS avg_score, total_bought FROM rollup ORDER BY total_bought DESC, categoryName LIMIT 15""",
                                  "scored")

O["category_stats"] = sql(f"""SELECT categoryName AS category, count(*) AS product_count,
  {ex_avg('price')} AS avg_price, {ex_avg('stars')} AS avg_stars, {ex_avg('demand_score')} AS avg_demand_score,
  CAST(sum(boughtInLastMonth) AS BIGINT) AS total_bought, CAST(sum(CAST(isBestSeller AS INTEGER)) AS BIGINT) AS best_sellers,
  rnd(min(price), 2) AS price_min, rnd(max(price), 2) AS price_max,
  rnd(max(demand_score), 2) AS max_demand_score,
  count_if(demand_score >= 60) AS high_demand_count,
  count_if(demand_score >= 35 AND demand_score < 60) AS medium_demand_count,
  count_if(demand_score < 35) AS low_demand_count
  FROM scored WHERE categoryName IS NOT NULL GROUP BY categoryName""", "scored")

O["price_buckets"] = _with(f"""mm AS (SELECT categoryName, min(price) AS pmin, max(price) AS pmax,
    CASE WHEN max(price) > min(price) THEN (max(price) - min(price)) / 5.0{D} ELSE 1.0{D} END AS bsize
    FROM scored WHERE categoryName IS NOT NULL GROUP BY 1),
  b AS (SELECT mm.*, i FROM mm, range(5) t(i))""", """SELECT b.categoryName AS category, CAST(i AS INTEGER) AS bucket,
    printf('₹%d-%d', CAST(trunc(pmin + i * bsize) AS BIGINT), CAST(trunc(pmin + (i + 1) * bsize) AS BIGINT)) AS label,
    (SELECT count(*) FROM scored s WHERE s.categoryName = b.categoryName
       AND s.price >= pmin + i * bsize AND s.price < pmin + (i + 1) * bsize) AS count
  FROM b""", "scored")

O["stars_histogram"] = sql("""SELECT c.categoryName AS category, CAST(s.s AS INTEGER) AS stars,
  (SELECT count(*) FROM scored x WHERE x.categoryName = c.categoryName AND x.stars >= s.s AND x.stars < s.s + 1) AS count
  FROM (SELECT DISTINCT categoryName FROM scored WHERE categoryName IS NOT NULL) c, range(1, 6) s(s)""", "scored")

_PRED = f"""pred AS (SELECT asin, title, categoryName AS category, rnd(price, 2) AS price, stars,
    boughtInLastMonth AS bought_last_month, rnd(demand_score, 2) AS demand_score, demand_level,
    {_CONF} AS confidence, isBestSeller AS is_best_seller
  FROM scored ORDER BY demand_score DESC, asin LIMIT 50)"""

O["predictions"] = _with(_PRED, "SELECT * FROM pred", "scored")
O["predictions_level"] = _with(_PRED.replace("FROM scored ORDER", "FROM scored WHERE categoryName = 'Brand#1' ORDER"),
                               "SELECT * FROM pred WHERE demand_level = 'Medium'", "scored")
O["predictions_summary"] = _with(_PRED, f"""SELECT count_if(demand_level = 'High') AS "High",
  count_if(demand_level = 'Medium') AS "Medium", count_if(demand_level = 'Low') AS "Low",
  {ex_avg('demand_score')} AS avg_score FROM pred""", "scored")

O["monthly_units"] = """SELECT strftime(l_shipdate, '%Y-%m') AS month, CAST(sum(l_quantity) AS BIGINT) AS units,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(22,2))) AS DOUBLE) AS revenue, count(*) AS lines
  FROM lineitem GROUP BY 1"""

O["monthly_insights"] = f"""WITH m AS ({O['monthly_units']}),
m2 AS (SELECT *, CAST(substr(month, 6, 2) AS INTEGER) AS mon, CAST(substr(month, 1, 4) AS INTEGER) * 12
                 + CAST(substr(month, 6, 2) AS INTEGER) AS month_key FROM m)
SELECT arg_max(month, (units, -month_key)) AS peak_month, max(units) AS peak_units,
  arg_min(units, month) AS first_units, arg_max(units, month) AS last_units,
  rnd((arg_max(units, month) - arg_min(units, month)) / greatest(arg_min(units, month), 1) * 100, 1) AS growth_pct,
  rnd(sum(CASE WHEN mon >= 10 THEN units ELSE 0 END) / sum(units) * 100, 1) AS q4_share_pct
FROM m2"""

O["seasonal_allocation"] = sql(f"""SELECT month_no, month,
  CAST(rnd(t * (w / {_W_TOTAL!r}{D}), 0) AS BIGINT) AS units
  FROM (VALUES (1,'Jan',0.78{D}),(2,'Feb',0.82{D}),(3,'Mar',0.92{D}),(4,'Apr',0.97{D}),(5,'May',1.02{D}),
               (6,'Jun',1.04{D}),(7,'Jul',1.03{D}),(8,'Aug',1.06{D}),(9,'Sep',1.08{D}),(10,'Oct',1.18{D}),
               (11,'Nov',1.32{D}),(12,'Dec',1.42{D})) v(month_no, month, w),
       (SELECT coalesce(sum(boughtInLastMonth), 0) AS t FROM scored)""", "scored")

O["order_totals"] = sql("""SELECT order_id, CAST(n_items AS INTEGER) AS items, rnd(subtotal, 2) AS subtotal, shipping,
  rnd(total, 2) AS total, delivery_speed FROM orders_doc""", "orders_doc")

O["product_listing"] = _with(_UNION, """SELECT asin, title, categoryName, price, stars, boughtInLastMonth,
  isBestSeller, demand_score, is_user_product, image_filename, owner_email, description, added_on
  FROM lunion WHERE stars >= 3.0 ORDER BY src, lid NULLS LAST, price ASC NULLS LAST, asin LIMIT 20 OFFSET 20""",
                             "scored", "listings")
O["product_listing_meta"] = _with(_UNION, """SELECT count(*) AS total, 2 AS page, 20 AS "limit",
  greatest(1, CAST(ceil(count(*) / 20) AS BIGINT)) AS pages FROM lunion WHERE stars >= 3.0""", "scored", "listings")

O["recommended"] = sql(f"""SELECT {_SCORE_COLS}, demand_score FROM scored
  WHERE isBestSeller OR (SELECT count_if(isBestSeller) FROM scored) = 0
  ORDER BY demand_score DESC, asin LIMIT 10""", "scored")

O["reorder_alerts"] = sql("""SELECT asin, title, categoryName AS category, rnd(price, 2) AS price, stars,
  boughtInLastMonth AS bought_last_month, rnd(demand_score, 2) AS demand_score, 'Low' AS demand_level,
  'Reorder Recommended' AS alert FROM scored WHERE demand_score < 35 AND boughtInLastMonth < 100
  ORDER BY demand_score, asin LIMIT 30""", "scored")

O["top_movers"] = sql("""SELECT asin, title, categoryName AS category, rnd(price, 2) AS price, stars,
  boughtInLastMonth AS bought_last_month, rnd(demand_score, 2) AS demand_score, demand_level,
  isBestSeller AS is_best_seller FROM scored ORDER BY boughtInLastMonth DESC, asin LIMIT 30""", "scored")

O["category_top"] = sql("""SELECT categoryName AS category, rank, asin, title, rnd(price, 2) AS price, stars,
  boughtInLastMonth AS bought_last_month, rnd(demand_score, 2) AS demand_score, demand_level,
  rnd(least(95.0::DOUBLE, (demand_score / 200.0::DOUBLE) * 95.0::DOUBLE), 1) AS confidence,
  isBestSeller AS is_best_seller
  FROM (SELECT *, row_number() OVER (PARTITION BY categoryName ORDER BY demand_score DESC, asin)::INTEGER AS rank
        FROM scored WHERE categoryName IS NOT NULL) WHERE rank <= 10""", "scored")

O["category_bottom"] = sql("""SELECT categoryName AS category, rank, asin, title, rnd(price, 2) AS price, stars,
  boughtInLastMonth AS bought_last_month, rnd(demand_score, 2) AS demand_score, demand_level
  FROM (SELECT *, row_number() OVER (PARTITION BY categoryName ORDER BY demand_score ASC, asin)::INTEGER AS rank
        FROM scored WHERE categoryName IS NOT NULL) WHERE rank <= 5""", "scored")

O["category_bought_top"] = sql("""SELECT categoryName AS category, rank, substr(title, 1, 30) AS title,
  boughtInLastMonth AS bought, rnd(demand_score, 2) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY categoryName ORDER BY boughtInLastMonth DESC, asin)::INTEGER AS rank
        FROM scored WHERE categoryName IS NOT NULL) WHERE rank <= 10""", "scored")

O["categories"] = sql("""SELECT categoryName AS category, (SELECT count(DISTINCT categoryName) FROM scored) AS count
  FROM (SELECT DISTINCT categoryName FROM scored WHERE categoryName IS NOT NULL)""", "scored")

O["hero_rotation"] = _with(_UNION, """SELECT asin, title, categoryName, price, stars, boughtInLastMonth,
  isBestSeller, demand_score, is_user_product, image_filename, owner_email, description, added_on
  FROM (SELECT * FROM lunion WHERE isBestSeller ORDER BY src, lid NULLS LAST, demand_score DESC NULLS LAST, asin
        LIMIT 20) WHERE NOT is_user_product ORDER BY src, lid NULLS LAST, demand_score DESC NULLS LAST, asin
  LIMIT 10""", "scored", "listings")

for _q, _owner in (("hero_rotation_seller", 1), ("hero_rotation", 2)):
    O[_q] = O["hero_rotation"].replace("WHERE isBestSeller ORDER", f"WHERE isBestSeller AND (src = 1 OR owner_email = 'supplier#{_owner:09d}') ORDER")
_MINE = "(src = 1 OR owner_email = 'supplier#000000001')"
for _by, (_col, _up) in SORT_OPTIONS.items():
    O[f"product_listing_{_by}"] = O["product_listing"].replace("WHERE stars >= 3.0", f"WHERE stars >= 3.0 AND {_MINE}").replace(
        "price ASC NULLS LAST", f"{_col} {'ASC' if _up else 'DESC'} NULLS LAST")
O["product_listing_after"] = O["product_listing_price_desc"].replace("WHERE stars >= 3.0", "WHERE price <= 990.0 AND src = 1 AND stars >= 3.0").replace(
    "LIMIT 20 OFFSET 20", "LIMIT 20")
O["search_suggest_seller"] = _with(_UNION, f"""SELECT asin, title, categoryName, price FROM lunion
  WHERE {_MINE} AND ((src = 1 AND regexp_matches(title, 'r.d', 'i')) OR (src = 0 AND contains(lower(title), 'r.d')))
  ORDER BY src, lid NULLS LAST, asin LIMIT 6""", "scored", "listings")
O["search_suggest"] = _with(_UNION, """SELECT asin, title, categoryName, price FROM lunion
  WHERE (src = 1 AND regexp_matches(title, 'red', 'i')) OR (src = 0 AND contains(lower(title), 'red'))
  ORDER BY src, lid NULLS LAST, asin LIMIT 6""", "scored", "listings")

O["trends_resort"] = _with(_TRENDS, """SELECT * EXCLUDE (rk) FROM trends
  ORDER BY total_bought DESC, rk LIMIT 10""", "scored")

O["next_ids"] = sql("""SELECT greatest(coalesce((SELECT max(asin) FROM catalog), 0),
                                  coalesce((SELECT max(asin) FROM lview), 0)) + 1 AS next_asin,
  coalesce((SELECT max(id) FROM lview), 0) + 1 AS next_id""", "catalog", "listings")

O["user_orders"] = sql("""SELECT order_id, created_at, CAST(n_items AS INTEGER) AS items, rnd(total, 2) AS total, 'confirmed' AS status,
  (SELECT count(*) FROM orders_doc WHERE user_email = 'customer#000000001') AS count
  FROM orders_doc WHERE user_email = 'customer#000000001'""", "orders_doc")

_LCOLS = ("asin, id, owner_email, title, categoryName, price, stars, boughtInLastMonth, isBestSeller, description, "
          "image_filename, added_on")
O["user_listings"] = sql(f"SELECT {_LCOLS} FROM lview WHERE lower(owner_email) = 'supplier#000000001'", "listings")
O["scan_seller_listings"] = sql(f"SELECT {_LCOLS} FROM lview WHERE id % 11 <> 0 AND id % 13 <> 0", "listings")

O["validate_listings"] = sql("""SELECT asin, id, owner_email, price, stars, boughtInLastMonth,
  CASE WHEN title IS NULL OR trim(title) = '' THEN 'title required'
       WHEN categoryName IS NULL OR trim(categoryName) = '' THEN 'category required'
       WHEN price IS NULL OR price <= 0 THEN 'price must be > 0'
       WHEN stars IS NULL OR stars < 1.0 OR stars > 5.0 THEN 'stars must be between 1 and 5'
       WHEN boughtInLastMonth < 0 THEN 'boughtInLastMonth must be >= 0' END AS reject_reason
  FROM (SELECT * REPLACE (CASE id % 17 WHEN 3 THEN 0.0::DOUBLE ELSE price END AS price,
                          CASE id % 19 WHEN 4 THEN 0.0::DOUBLE WHEN 5 THEN 6.0::DOUBLE ELSE stars END AS stars,
                          CASE id % 23 WHEN 6 THEN ' ' ELSE title END AS title) FROM lview)""", "listings")

O["catalog_union_listings"] = _with(_UNION, """SELECT asin, title, categoryName, price, stars, boughtInLastMonth,
  isBestSeller, demand_score, is_user_product, image_filename, owner_email, description, added_on,
  src AS source_rank, lid AS listing_id FROM lunion""", "scored", "listings")

_TRAIN = _feat("lview", "lfeat") + f""",
tfeat AS (SELECT asin, title, categoryName, price, stars, boughtInLastMonth, isBestSeller, sn, bn, bsn, pn,
                 false AS is_user_product FROM feat
          UNION ALL
          SELECT asin, title, categoryName, price, stars, boughtInLastMonth, isBestSeller, sn, bn, bsn, pn,
                 true FROM lfeat),
train0 AS (SELECT asin, title, categoryName, price, stars, boughtInLastMonth, isBestSeller,
   rnd(sn*0.25{D} + bn*0.25{D} + bsn*0.25{D} + pn*0.25{D}, 2) AS demand_score,
   sn AS stars_norm, bn AS bought_norm, bsn AS bs_norm, pn AS price_norm, is_user_product FROM tfeat),
train AS (SELECT asin, title, categoryName, price, stars, boughtInLastMonth, isBestSeller, demand_score,
   {_LEVEL} AS demand_level, stars_norm, bought_norm, bs_norm, price_norm, is_user_product FROM train0)"""

O["training_union"] = _with(_TRAIN, "SELECT * FROM train", "scored", "listings")

O["product_lookup"] = _with(_LOOKUP, "SELECT * FROM lookup", "scored", "listings", "carts")

O["demand_lookup"] = _with(f"""lfirst AS (SELECT * FROM lview QUALIFY row_number() OVER (PARTITION BY asin ORDER BY id) = 1),
lclip AS (SELECT l.asin, l.title, l.stars, l.boughtInLastMonth,
   rnd(greatest(0.0{D}, least(100.0{D}, (
     greatest(0.0{D}, least(100.0{D}, ((l.stars - 1.0{D}) / 4.0{D}) * 100.0{D}))
     + CASE WHEN bought_max > 0 THEN greatest(0.0{D}, least(100.0{D}, (l.boughtInLastMonth / bought_max) * 100.0{D}))
            ELSE 0.0{D} END
     + CASE WHEN l.isBestSeller THEN 100.0{D} ELSE 0.0{D} END
     + CASE WHEN price_max > price_min THEN greatest(0.0{D}, least(100.0{D},
            (1.0{D} - (l.price - price_min) / (price_max - price_min)) * 100.0{D})) ELSE 50.0{D} END
   ) * 0.25{D})), 2) AS demand_score
   FROM lfirst l, cstats),
keys AS (SELECT DISTINCT asin FROM cart_items)""", f"""SELECT k.asin, title, demand_score, {_LEVEL} AS demand_level,
  rnd(greatest(0.0{D}, least(95.0{D}, (demand_score / 100.0{D}) * 95.0{D})), 1) AS confidence_score, stars,
  boughtInLastMonth AS bought_last_month, true AS is_user_product
  FROM keys k JOIN lclip USING (asin)
UNION ALL
SELECT k.asin, title, rnd(demand_score, 2), demand_level, {_CONF}, stars, boughtInLastMonth, false
  FROM keys k JOIN scored USING (asin) WHERE k.asin NOT IN (SELECT asin FROM lclip)""",
                            "scored", "listings", "carts")

O["cart_resolve"] = _with(_LOOKUP, """SELECT user_email, count(*) AS items,
  CAST(round(sum(CAST(price AS DECIMAL(22,4))), 2) AS DOUBLE) AS subtotal
  FROM cart_items JOIN lookup USING (asin) GROUP BY user_email""", "scored", "listings", "carts")

O["cart_orphans"] = _with(_LOOKUP, """SELECT user_email, asin FROM cart_items
  WHERE asin NOT IN (SELECT asin FROM lookup)""", "scored", "listings", "carts")

O["missing_assets"] = sql("SELECT asin, title, categoryName FROM scored WHERE asin % 7 = 0", "scored")

O["listing_inserts"] = sql(f"""SELECT
  (SELECT greatest(coalesce((SELECT max(asin) FROM catalog), 0), coalesce((SELECT max(asin) FROM lview), 0)) + 1)
    + row_number() OVER (ORDER BY seq) - 1 AS asin,
  (SELECT coalesce(max(id), 0) + 1 FROM lview) + row_number() OVER (ORDER BY seq) - 1 AS id,
  owner_email, title, categoryName, price, stars, boughtInLastMonth, isBestSeller, description, image_filename, added_on
  FROM (SELECT CASE WHEN p_partkey = 5 THEN p_partkey + 1000000000000 ELSE p_partkey END AS seq, p_partkey,
  lower(s_name) AS owner_email, p_name AS title, p_brand AS categoryName, p_retailprice * 1.25{D} AS price,
  {_STARS} AS stars, CAST(coalesce(units, 0) AS BIGINT) AS boughtInLastMonth, {_STARS} > 4.5 AS isBestSeller,
  p_type AS description, '' AS image_filename, '2026-05-01 12:00' AS added_on
  FROM part CROSS JOIN n_sup LEFT JOIN supplier ON s_suppkey = p_partkey % n_supp
       LEFT JOIN sold ON l_partkey = p_partkey) WHERE p_partkey % 29 <> 7 AND p_partkey % 31 <> 9""", "catalog", "listings")


# ---------------------------------------------------------------- sources, functions, sampling, ML, changes
_CTE["users"] = """users0 AS (
  SELECT c_custkey, lower(c_name) AS email, sha256(CAST(c_custkey AS VARCHAR)) AS password_hash, c_name AS name,
         printf('+91 %05d %05d', (c_custkey * 7919) % 100000, c_custkey % 100000) AS phone,
         c_mktsegment AS department, n_name AS city,
         CASE WHEN c_custkey % 50 = 0 THEN 'Admin' ELSE 'Analyst' END AS role,
         strftime(DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER), '%Y-%m-%d') AS joined
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey),
users AS (SELECT email, password_hash, name, phone, department, city, role, joined FROM users0)"""
_CTE["train"] = _TRAIN
_DEPS["users"] = []
_DEPS["train"] = ["scored", "listings"]
_CTE["balanced"] = """tcnt AS (SELECT demand_level, count(*) AS n FROM train GROUP BY 1),
tmax AS (SELECT max(n) AS mx FROM tcnt),
trk AS (SELECT t.*, row_number() OVER (PARTITION BY demand_level ORDER BY md5(CAST(asin AS VARCHAR)), asin) AS r
        FROM train t),
balanced AS (SELECT asin, title, categoryName, price, stars, boughtInLastMonth, isBestSeller, demand_score,
                    demand_level, stars_norm, bought_norm, bs_norm, price_norm, is_user_product,
                    unnest(generate_series(1, CAST(floor(mx / n) AS BIGINT) + CASE WHEN r <= mx % n THEN 1 ELSE 0 END))
                      ::INTEGER AS copy
             FROM trk JOIN tcnt USING (demand_level) CROSS JOIN tmax)"""
_DEPS["balanced"] = ["train"]
_CTE["split"] = """scnt AS (SELECT demand_level, count(*) AS n FROM scored GROUP BY 1),
split AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.demand_level ORDER BY md5(CAST(asin AS VARCHAR)), asin)
                              <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
          FROM scored s JOIN scnt USING (demand_level)),
enc AS (SELECT *, CAST(dense_rank() OVER (ORDER BY coalesce(categoryName, 'Unknown')) - 1 AS INTEGER) AS cat_enc,
               CAST(dense_rank() OVER (ORDER BY demand_level) - 1 AS INTEGER) AS label FROM split)"""
_DEPS["split"] = ["scored"]
_CTE["purchases"] = """np AS (SELECT count(*) AS n_parts FROM part),
purchases AS (SELECT event_id AS order_id, event_id % n_parts AS asin, CAST(user_id % 3 + 1 AS BIGINT) AS units, ts,
                     printf('Customer#%09d', user_id) AS user_email, value AS amount
              FROM events, np WHERE event_type = 'purchase')"""
_DEPS["purchases"] = []
_CTE["changes"] = """nl AS (SELECT count(*) AS n_listings FROM lview),
clog AS (SELECT e.*, event_id % n_listings + 1 AS listing_id FROM events e, nl),
clog2 AS (SELECT c.*, CASE WHEN user_id % 5 = 0 THEN 'intruder@example.com'
                           WHEN user_id % 2 = 0 THEN upper(l.owner_email) ELSE l.owner_email END AS actor_email
          FROM clog c LEFT JOIN lview l ON l.id = c.listing_id)"""
_DEPS["changes"] = ["listings"]

_LV12 = ("asin, id, owner_email, title, categoryName, price, stars, boughtInLastMonth, isBestSeller, description, "
         "image_filename, added_on")

O["scan_catalog_documents"] = sql("""SELECT asin, title, categoryName, price, stars,
  CAST(boughtInLastMonth AS INTEGER) AS boughtInLastMonth, isBestSeller FROM catalog""", "catalog")
O["scan_with_fallback"] = sql("SELECT * FROM catalog", "catalog")
O["normalize_raw_feed"] = "SELECT CAST(p_partkey AS VARCHAR) AS asin, p_name AS title, p_brand AS categoryName FROM part"
O["filter_excluded_terms"] = r"""SELECT CAST(p_partkey AS VARCHAR) AS asin,
    CASE p_partkey % 9 WHEN 5 THEN p_name || ' Bracelet' ELSE p_name END AS title, p_brand AS categoryName
  FROM part WHERE p_name IS NOT NULL AND p_brand IS NOT NULL AND p_partkey % 9 <> 4 AND NOT regexp_matches(p_name, '\bbra\b', 'i')"""
O["migrate_products_dedup"] = sql("""SELECT asin, title, categoryName, price, stars, boughtInLastMonth,
  isBestSeller, demand_score, demand_level, stars_norm, bought_norm, bs_norm, price_norm, false AS is_user_product
  FROM train""", "train")
O["migrate_users_clean"] = sql("""SELECT * FROM (
  SELECT lower(trim(CASE WHEN c_custkey % 17 = 0 THEN '  ' WHEN c_custkey % 3 = 0 THEN ' ' || upper(email) || ' '
                    ELSE email END)) AS email,
         password_hash, name, phone, department, city,
         coalesce(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE role END, 'Analyst') AS role, joined
  FROM users0) WHERE email IS NOT NULL AND email <> ''""", "users")
O["image_manifest"] = f"""WITH files AS (SELECT p_partkey AS asin, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 + 1 ELSE 0 END AS BIGINT) AS version, p_name
  FROM part WHERE {_STARS} > 4.5),
bodies AS (SELECT asin, version, concat('image ', asin, ' ', p_name, ' v ', version, chr(10)) AS body FROM files)
SELECT asin, version, CAST(strlen(body) AS BIGINT) AS length, sha256(body) AS sha256, version + 1 AS versions FROM bodies"""
O["image_manifest_stream"] = O["image_manifest"]
O["asset_manifest"] = "SELECT p_partkey AS asin FROM part WHERE p_partkey % 7 <> 0"
O["csv_to_json"] = sql("""SELECT to_json(struct_pack(asin := CAST(asin AS VARCHAR), id := CAST(id AS VARCHAR),
  owner_email := owner_email, title := title, categoryName := categoryName, price := CAST(price AS VARCHAR),
  stars := CAST(stars AS VARCHAR), boughtInLastMonth := CAST(boughtInLastMonth AS VARCHAR),
  isBestSeller := CASE WHEN isBestSeller THEN 'TRUE' ELSE 'FALSE' END, description := description,
  image_filename := image_filename, added_on := added_on))::VARCHAR AS json FROM lview""", "listings")
O["collection_counts"] = sql("""SELECT 'products' AS collection, count(*) AS rows FROM catalog
  UNION ALL SELECT 'users', count(*) FROM customer
  UNION ALL SELECT 'user_products', count(*) FROM lview
  UNION ALL SELECT 'orders', count(*) FROM orders_doc
  UNION ALL SELECT 'gridfs_files', count(*) FROM part WHERE p_partkey % 7 <> 0""", "catalog", "listings", "orders_doc")
O["dataset_info"] = sql("""SELECT demand_level, count(*) AS count, (SELECT count(*) FROM balanced) AS total_rows, 14 AS n_columns,
  'asin, title, categoryName, price, stars, boughtInLastMonth, isBestSeller, demand_score, demand_level, stars_norm, bought_norm, bs_norm, price_norm, '
    || 'is_user_product' AS columns FROM balanced GROUP BY demand_level""", "balanced")
O["scan_without_fallback"] = sql("SELECT * FROM catalog", "catalog")
O["balance_classes"] = sql("SELECT * FROM balanced", "balanced")
O["write_training_csv"] = O["balance_classes"]
O["class_distribution"] = sql("""SELECT 'before' AS stage, demand_level, count(*) AS count FROM train GROUP BY 2
  UNION ALL SELECT 'after', demand_level, count(*) FROM balanced GROUP BY 2""", "balanced")

O["demand_score_clipped"] = _with(f"""lc AS (SELECT l.asin,
     greatest(0.0{D}, least(100.0{D}, ((l.stars - 1.0{D}) / 4.0{D}) * 100.0{D})) AS sn,
     CASE WHEN bought_max > 0 THEN greatest(0.0{D}, least(100.0{D}, (l.boughtInLastMonth / bought_max) * 100.0{D}))
          ELSE 0.0{D} END AS bn,
     CASE WHEN l.isBestSeller THEN 100.0{D} ELSE 0.0{D} END AS bsn,
     CASE WHEN price_max > price_min THEN greatest(0.0{D}, least(100.0{D},
          (1.0{D} - (l.price - price_min) / (price_max - price_min)) * 100.0{D})) ELSE 50.0{D} END AS pn
   FROM lview l, cstats)""", f"""SELECT asin, rnd(greatest(0.0{D}, least(100.0{D},
     sn*0.25{D} + bn*0.25{D} + bsn*0.25{D} + pn*0.25{D})), 2) AS demand_score FROM lc""", "catalog", "listings")
O["listing_quick_score"] = sql(f"SELECT asin, {_LQUICK} AS score FROM lview", "listings")
O["seller_panel_score"] = sql(f"""SELECT asin, CAST(floor((stars / 5.0{D}) * 30.0{D}
  + least(boughtInLastMonth / 1000.0{D}, 1.0{D}) * 40.0{D} + 10.0{D} + 0.5{D}) AS BIGINT) AS score FROM lview""",
                              "listings")
O["legacy_score"] = sql(f"SELECT asin, stars * 20.0{D} + boughtInLastMonth * 0.1{D} AS legacy_score FROM catalog",
                        "catalog")
O["confidence"] = sql(f"""SELECT asin, rnd(least(95.0{D}, (demand_score / 100.0{D}) * 95.0{D}), 1) AS confidence,
  rnd(least(95.0{D}, (demand_score / 200.0{D}) * 95.0{D}), 1) AS confidence_category FROM scored""", "scored")
O["trend_label"] = _with(_ROLLUP, f"SELECT categoryName AS category, avg_demand_score, {_TREND} AS trend FROM rollup",
                         "scored")
O["trend_label_legacy"] = _with(_ROLLUP, f"""SELECT categoryName AS category, avg_demand_score,
  CASE WHEN avg_score_exact >= 150 THEN 'Surging' WHEN avg_score_exact >= 130 THEN 'Rising'
       WHEN avg_score_exact >= 110 THEN 'Stable' ELSE 'Declining' END AS trend FROM rollup""", "scored")
O["filter_search_regex"] = sql("SELECT asin, title FROM scored WHERE regexp_matches(title, '^(red|blue) ', 'i')",
                               "scored")
O["filter_search_literal"] = sql("SELECT asin, title FROM lview WHERE contains(lower(title), 'gizmo')", "listings")
O["filter_equality"] = sql("""SELECT asin, categoryName, isBestSeller FROM scored
  WHERE categoryName = 'Brand#1' AND isBestSeller""", "scored")
O["filter_range"] = sql("""SELECT asin, price, stars FROM scored WHERE price >= 950.0 AND price <= 990.5
  AND stars >= 3.5""", "scored")
O["reorder_predicate"] = sql("""SELECT asin, demand_score, boughtInLastMonth FROM scored
  WHERE demand_score < 35 AND boughtInLastMonth < 100""", "scored")
O["skip_malformed_rows"] = sql("SELECT asin, price, stars, boughtInLastMonth FROM lview WHERE id % 13 <> 0", "listings")
O["safe_projection"] = sql("SELECT email, name, phone, department, city, role, joined FROM users", "users")
def _u(tag: str) -> str:
    return (f"(('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || '42' || '{tag}'), 1, 8))::BIGINT "
            f"/ 4294967296.0::DOUBLE)")


O["synthesize_fields"] = f"""SELECT asin, title, categoryName, price, boughtInLastMonth, stars, stars > 4.5 AS isBestSeller
  FROM (SELECT CAST(p_partkey AS VARCHAR) AS asin, p_name AS title, p_brand AS categoryName,
               rnd(500.0{D} + {_u('price')} * 4500.0{D}, 2) AS price,
               CAST(50 + floor({_u('bought')} * 950.0{D}) AS BIGINT) AS boughtInLastMonth,
               rnd(3.5{D} + {_u('stars')} * 1.5{D}, 1) AS stars FROM part)"""
O["title_truncate"] = sql("""SELECT asin, substr(title, 1, 45) AS title_45, substr(title, 1, 30) AS title_30
  FROM (SELECT asin, title || repeat(' ' || categoryName, CAST(asin % 8 AS INTEGER)) AS title FROM catalog)""", "catalog")

O["scatter_sample"] = sql("""SELECT asin, rnd(price, 2) AS price, stars, categoryName AS category,
  rnd(demand_score, 1) AS demand FROM scored ORDER BY md5(CAST(asin AS VARCHAR)), asin LIMIT 1200""", "scored")
O["category_price_samples"] = _with(_KEEP, """SELECT categoryName AS category, asin, rnd(price, 2) AS price FROM (
  SELECT *, row_number() OVER (PARTITION BY categoryName ORDER BY md5(CAST(asin AS VARCHAR)), asin) AS rk
  FROM scored WHERE categoryName IN (SELECT categoryName FROM keep)) WHERE rk <= 400""", "scored")
O["category_scatter"] = sql("""SELECT categoryName AS category, asin, rnd(price, 2) AS x, rnd(demand_score, 2) AS y,
  substr(title, 1, 45) AS title FROM (
  SELECT *, row_number() OVER (PARTITION BY categoryName ORDER BY md5(CAST(asin AS VARCHAR)), asin) AS rk
  FROM scored WHERE categoryName IS NOT NULL) WHERE rk <= 300""", "scored")
O["catalog_downsample"] = sql("""SELECT * FROM catalog ORDER BY md5(CAST(asin AS VARCHAR)), asin LIMIT 10000""",
                              "catalog")
for _q, _n, _small in (("category_price_samples", "rk <= 400", "rk <= 20"), ("category_scatter", "rk <= 300", "rk <= 10"),
                       ("catalog_downsample", "LIMIT 10000", "LIMIT 100")):
    O[f"{_q}_small"] = O[_q].replace(_n, _small)
O["stratified_split"] = sql("SELECT asin, demand_level, split FROM split", "split")
O["label_encode"] = sql("SELECT asin, categoryName, cat_enc, demand_level, label FROM enc", "split")
_ZF = ["stars_norm", "bought_norm", "bs_norm", "price_norm", "cat_enc"]
O["standardize"] = sql("SELECT asin, split, " + ", ".join(
    f"rnd(CASE WHEN s_{f} > 0 THEN ({f} - m_{f}) / s_{f} ELSE 0.0{D} END, 6) AS z_{f}" for f in _ZF)
    + " FROM enc, (SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in _ZF)
    + " FROM enc WHERE split = 'train')", "split")
O["quick_score_metrics"] = sql(f"""WITH pr AS (SELECT demand_level AS y,
    CASE WHEN q >= 60 THEN 'High' WHEN q >= 35 THEN 'Medium' ELSE 'Low' END AS p
    FROM (SELECT demand_level, {_LQUICK} AS q FROM scored)),
  conf AS (SELECT y, p, count(*) AS n FROM pr GROUP BY 1, 2),
  tot AS (SELECT sum(n) AS total, sum(CASE WHEN y = p THEN n END) AS correct FROM conf),
  m AS (SELECT s.cls, s.support, coalesce(t.tp, 0) AS tp, coalesce(q.predicted, 0) AS predicted
        FROM (SELECT y AS cls, sum(n) AS support FROM conf GROUP BY 1) s
        LEFT JOIN (SELECT y AS cls, n AS tp FROM conf WHERE y = p) t USING (cls)
        LEFT JOIN (SELECT p AS cls, sum(n) AS predicted FROM conf GROUP BY 1) q USING (cls)),
  m2 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0{D} END AS pr_,
                CASE WHEN support > 0 THEN tp / support ELSE 0.0{D} END AS rc_ FROM m)
  SELECT cls AS class, rnd(pr_ * 100, 1) AS precision, rnd(rc_ * 100, 1) AS recall,
    rnd(CASE WHEN pr_ + rc_ > 0 THEN 2 * pr_ * rc_ / (pr_ + rc_) ELSE 0.0{D} END * 100, 1) AS f1_score,
    CAST(support AS BIGINT) AS support, rnd(correct / total * 100, 2) AS accuracy FROM m2, tot""".replace(
    "WITH pr AS", ", pr AS", 1), "scored").replace("\n, pr AS", ",\npr AS")
O["seller_panel"] = sql(f"""SELECT owner_email, count(*) AS listings, count_if(ps >= 60) AS high_count,
  count_if(ps >= 35 AND ps < 60) AS medium_count, count_if(ps < 35) AS low_count,
  CAST(floor(sum(ps) / count(*) + 0.5{D}) AS BIGINT) AS avg_score,
  CAST(floor(sum(CAST(price AS DECIMAL(24,4))) / count(*)) AS BIGINT) AS avg_price
  FROM (SELECT owner_email, price, CAST(floor((stars / 5.0{D}) * 30.0{D} + least(boughtInLastMonth / 1000.0{D}, 1.0{D})
        * 40.0{D} + 10.0{D} + 0.5{D}) AS BIGINT) AS ps FROM lview) GROUP BY owner_email""", "listings")

O["listing_updates"] = _with("""upd AS (SELECT listing_id AS id, lower(trim(actor_email)) AS own, ts,
    value AS price,
    CASE WHEN event_id % 4 = 0 THEN round(1.0::DOUBLE + (event_id % 41) / 10.0::DOUBLE, 1) END AS stars,
    CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') END AS description
  FROM clog2 WHERE event_type = 'click' AND NOT coalesce(value <= 0, false)),
red AS (SELECT id, own, arg_max(price, ts) FILTER (WHERE price IS NOT NULL) AS n_price,
               arg_max(stars, ts) FILTER (WHERE stars IS NOT NULL) AS n_stars,
               arg_max(description, ts) FILTER (WHERE description IS NOT NULL) AS n_desc, max(ts) AS mts
        FROM upd GROUP BY 1, 2)""", """SELECT l.asin, l.id, l.owner_email, l.title, l.categoryName,
  coalesce(n_price, l.price) AS price, coalesce(n_stars, l.stars) AS stars, l.boughtInLastMonth, l.isBestSeller,
  coalesce(n_desc, l.description) AS description, l.image_filename, l.added_on,
  strftime(mts, '%Y-%m-%d %H:%M') AS updated_on
  FROM lview l LEFT JOIN red r ON r.id = l.id AND r.own = lower(trim(l.owner_email))""", "listings", "changes")
O["listing_deletes"] = _with("""dels AS (SELECT DISTINCT listing_id AS id, lower(trim(actor_email)) AS own
  FROM clog2 WHERE event_type = 'error')""", f"""SELECT {_LV12} FROM lview l
  WHERE NOT EXISTS (SELECT 1 FROM dels d WHERE d.id = l.id AND d.own = lower(trim(l.owner_email)))""",
                             "listings", "changes")
O["seller_activity_merge"] = _with("""ups AS (SELECT listing_id AS id, lower(trim(actor_email)) AS own, ts,
    printf('up_%d_%d.png', user_id, event_id) AS fn FROM clog2 WHERE event_type = 'view' AND user_id % 2 = 1),
red AS (SELECT id, own, max(ts) AS mts, arg_max(fn, (ts, fn)) AS fn FROM ups GROUP BY 1, 2)""",
                                   """SELECT l.asin, l.id, l.owner_email, coalesce(fn, l.image_filename) AS image_filename,
  strftime(mts, '%Y-%m-%d %H:%M') AS updated_on
  FROM lview l LEFT JOIN red r ON r.id = l.id AND r.own = lower(trim(l.owner_email))""", "listings", "changes")
O["profile_updates"] = _with("""pu AS (SELECT printf('customer#%09d', user_id % (SELECT count(*) FROM customer)) AS em, ts,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
    WHERE event_type = 'view' AND user_id % 2 = 0),
pu2 AS (SELECT em, ts, CASE WHEN k % 2 = 0 THEN printf('+91 %05d', k) END AS phone, printf('City-%d', k) AS city,
               CASE WHEN k % 7 = 0 THEN 'Manager' END AS role FROM pu),
red AS (SELECT em, arg_max(phone, ts) FILTER (WHERE phone IS NOT NULL) AS n_phone,
               arg_max(city, ts) AS n_city, arg_max(role, ts) FILTER (WHERE role IS NOT NULL) AS n_role
        FROM pu2 GROUP BY em)""", """SELECT email, name, coalesce(n_phone, phone) AS phone, department,
  coalesce(n_city, city) AS city, coalesce(n_role, role) AS role, joined
  FROM users LEFT JOIN red ON red.em = lower(trim(email))""", "users")
O["profile_passwords"] = _with("""pu AS (SELECT printf('customer#%09d', user_id % (SELECT count(*) FROM customer)) AS em, ts,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
    WHERE event_type = 'view' AND user_id % 2 = 0),
red AS (SELECT em, arg_max(sha256(printf('secret-%d', k)), ts) AS h FROM pu WHERE k % 11 = 0 GROUP BY em)""",
                               "SELECT email, coalesce(h, password_hash) AS password_hash FROM users LEFT JOIN red ON red.em = lower(trim(email))", "users")
_REG = """reg AS (SELECT event_id, ts, lower(trim(CASE WHEN user_id % 3 = 0
             THEN printf('Customer#%09d', user_id % (SELECT count(*) FROM customer))
             ELSE printf('New.User%d@Example.com', user_id) END)) AS email_norm,
           printf('User %d', user_id) AS name FROM events WHERE event_type = 'signup')"""
O["duplicate_registration"] = _with(_REG, """SELECT email_norm AS email, arg_min(name, (ts, event_id)) AS name,
  arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS attempts, 'Analyst' AS role,
  strftime(min(ts), '%Y-%m-%d') AS joined
  FROM reg WHERE email_norm NOT IN (SELECT lower(trim(email)) FROM users) GROUP BY email_norm""", "users")
O["registration_outcomes"] = _with(_REG + """,
pe AS (SELECT email_norm, count(*) AS n, email_norm IN (SELECT lower(trim(email)) FROM users) AS known
       FROM reg GROUP BY 1)""", """SELECT CAST(sum(CASE WHEN NOT known THEN 1 ELSE 0 END) AS BIGINT) AS accepted,
  CAST(sum(CASE WHEN NOT known THEN n - 1 ELSE 0 END) AS BIGINT) AS duplicate_in_batch,
  CAST(sum(CASE WHEN known THEN n ELSE 0 END) AS BIGINT) AS already_registered FROM pe""", "users")
O["order_ingest"] = sql("""SELECT order_id, lower(trim(user_email)) AS user_email, asin, units,
  rnd(amount, 2) AS total, 'confirmed' AS status, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at
  FROM purchases""", "purchases")
O["order_documents"] = """WITH per_order AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS items, sum(cents) AS cents
  FROM (SELECT l_orderkey, l_partkey, sum(CAST(l_extendedprice AS DECIMAL(22,2))) AS cents FROM lineitem GROUP BY 1, 2) GROUP BY 1)
SELECT o_orderkey AS order_id, lower(c_name) AS user_email, items, CAST(cents AS DOUBLE) AS subtotal,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS shipping,
  CAST(cents + CASE WHEN o_orderpriority = '1-URGENT' THEN 50 ELSE 0 END AS DOUBLE) AS total,
  CASE o_orderkey % 3 WHEN 0 THEN 'card' WHEN 1 THEN 'upi' ELSE 'cod' END AS payment_method,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'express' ELSE 'standard' END AS delivery_speed,
  c_name AS address_name, printf('%d Market Road', o_custkey) AS address_address, n_name AS address_city,
  printf('%06d', (o_custkey * 37) % 1000000) AS address_pin, printf('+91 %010d', o_custkey) AS address_phone,
  'confirmed' AS status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at
FROM orders JOIN per_order ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey"""
O["order_documents_stream"] = O["order_documents"]

# first run without the purchases of order_id % 3 = 0; a day closes two days after its end has passed in what has come
_CLOSING = """pday AS (SELECT *, date_trunc('day', ts) AS d, order_id % 3 = 0 AS second FROM purchases),
marks AS (SELECT (SELECT max(ts) FROM pday WHERE NOT second) - INTERVAL 2 DAY AS w1, (SELECT max(ts) FROM pday) - INTERVAL 2 DAY AS w2),
stage AS (SELECT pday.*, d + INTERVAL 1 DAY <= w1 AS shut, d + INTERVAL 1 DAY <= w2 AS shut_later FROM pday, marks),
closed AS (SELECT strftime(d, '%Y-%m-%d') AS day, asin, CAST(sum(units) AS BIGINT) AS units, count(*) AS orders FROM stage
           WHERE (shut AND NOT second) OR (shut_later AND NOT shut) GROUP BY 1, 2),
late AS (SELECT strftime(d, '%Y-%m-%d') AS day, asin, CAST(sum(units) AS BIGINT) AS units, count(*) AS orders FROM stage
         WHERE shut AND second GROUP BY 1, 2)"""
O["stream_units_closed"] = _with(_CLOSING, "SELECT * FROM closed", "purchases")
O["stream_units_late"] = _with(_CLOSING, "SELECT * FROM late", "purchases")
O["stream_units_reconciled"] = _with(_CLOSING, """SELECT strftime(d, '%Y-%m-%d') AS day, asin, CAST(sum(units) AS BIGINT) AS units,
  count(*) AS orders FROM stage WHERE shut OR shut_later GROUP BY 1, 2""", "purchases")
O["catalog_with_streamed_units"] = _with("""fed AS (SELECT asin, sum(units) AS fed FROM purchases
  WHERE strftime(date_trunc('day', ts), '%Y-%m-%d') >= '2024-01-15' GROUP BY 1)""", """SELECT c.asin, title, categoryName, price, stars,
  CAST(boughtInLastMonth + coalesce(fed, 0) AS BIGINT) AS boughtInLastMonth, isBestSeller FROM catalog c LEFT JOIN fed f ON f.asin = c.asin""",
                                         "catalog", "purchases")
O["stream_units_tumbling"] = sql("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, asin,
  CAST(sum(units) AS BIGINT) AS units, count(*) AS orders FROM purchases GROUP BY 1, 2""", "purchases")


# ---------------------------------------------------------------- insight sentences
def _num(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


O["category_distribution_insights"] = f"""SELECT
  printf('%s leads the catalog with %s products (%s%% share).', leader, {_num('leader_count')},
         CAST(leader_pct AS VARCHAR)) AS insight_1,
  printf('Top %d categories account for %s%% of all listings.', 12, CAST(top_share_pct AS VARCHAR)) AS insight_2,
  printf('Catalog spans %d distinct categories.', distinct_categories) AS insight_3
  FROM ({O['category_distribution_summary']}) s"""

O["price_distribution_insights"] = _with(f"""pd AS ({O['price_distribution']}),
hi AS (SELECT category AS hi_cat, CAST(rnd(median, 0) AS BIGINT) AS hi_med FROM pd ORDER BY median DESC, category
       LIMIT 1),
lo AS (SELECT category AS lo_cat, CAST(rnd(median, 0) AS BIGINT) AS lo_med FROM pd ORDER BY median ASC, category DESC
       LIMIT 1),
mp AS (SELECT CAST(round(avg(CAST(price AS DECIMAL(20,4))), 0) AS BIGINT) AS mean_price FROM scored)""",
    """SELECT printf('%s carries the highest median price (₹%d).', hi_cat, hi_med) AS insight_1,
  printf('%s is the most affordable (median ₹%d).', lo_cat, lo_med) AS insight_2,
  printf('Catalog-wide mean price: ₹%d.', mean_price) AS insight_3 FROM hi, lo, mp""", "scored")

O["demand_insights"] = _with(f"""mix AS ({O['demand_mix']}),
ms AS (SELECT CAST(round(avg(CAST(demand_score AS DECIMAL(20,4))), 1) AS DOUBLE) AS mean_score FROM scored)""",
    f"""SELECT printf('%s products in the High-demand bucket (%s%%).',
         {_num("(SELECT count FROM mix WHERE level = 'High')")},
         CAST((SELECT pct FROM mix WHERE level = 'High') AS VARCHAR)) AS insight_1,
  (SELECT printf('%s products sit at %s demand — the largest tier.', {_num('count')}, level) FROM mix
   ORDER BY count DESC, CASE level WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END LIMIT 1) AS insight_2,
  printf('Mean demand score across the catalog: %s.', CAST(mean_score AS VARCHAR)) AS insight_3 FROM ms""",
    "scored")

O["ratings_insights"] = f"""SELECT printf('Price ↔ Rating correlation: %+.3f (%s).', corr, bucket) AS insight_1,
  printf('%s products carry a 4.5★+ rating.', {_num('high_rated')}) AS insight_2,
  printf('Showing %s of %s products (sample in md5 order).', {_num('least(1200, total)')}, {_num('total')})
    AS insight_3
  FROM ({O['price_rating_corr']}) r"""

O["monthly_insights_text"] = f"""SELECT printf('Peak month: %s with %s units sold.', peak_month, {_num('peak_units')})
    AS insight_1,
  printf('Trend from %s to %s: %+.1f%%.', first_month, last_month, growth_pct) AS insight_2,
  printf('Q4 (Oct–Dec) drives %s%% of annual volume.', CAST(q4_share_pct AS VARCHAR)) AS insight_3
  FROM ({O['monthly_insights']}) i,
       (SELECT min(month) AS first_month, max(month) AS last_month FROM ({O['monthly_units']})) m"""


def _pairs_with_index() -> str:
    rows = []
    for i, (a, la) in enumerate(_CORR_COLS):
        for j, (b, lb) in enumerate(_CORR_COLS):
            if i < j:
                rows.append(f"SELECT '{la}' AS row_label, '{lb}' AS col_label, {i * 10 + j} AS idx, "
                            f"rnd(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 3) AS r FROM scored")
    return "\nUNION ALL\n".join(rows)


O["correlation_insights"] = sql(f"""SELECT
  printf('Strongest pair: %s ↔ %s (r = %+.3f).', hi.row_label, hi.col_label, hi.r) AS insight_1,
  printf('Weakest pair: %s ↔ %s (r = %+.3f).', lo.row_label, lo.col_label, lo.r) AS insight_2,
  'Demand score is engineered from price / rating / units — expect non-trivial coupling there.' AS insight_3
  FROM (SELECT arg_max(struct_pack(row_label, col_label, r), (abs(r), -idx)) AS hi,
               arg_max(struct_pack(row_label, col_label, r), (-abs(r), idx)) AS lo
        FROM ({_pairs_with_index()}))""", "scored")


O["trend_texts"] = f"""SELECT 'Top 5 by demand: ' || top5 AS top5_text,
  'Recommended: ' || recommended || ' — best balance of demand score & sales volume' AS recommendation_text
  FROM ({O['trend_recommendation']}) t"""


def _js(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


O["category_insights"] = f"""SELECT st.category,
  'This category has ' || CAST(product_count AS VARCHAR) || ' products with an avg demand score of '
    || {_js('avg_demand_score')} || '. ' || CAST(high_demand_count AS VARCHAR) || ' products are High demand, '
    || CAST(best_sellers AS VARCHAR) || ' are Best Sellers. '
    || CASE WHEN tp.title IS NOT NULL THEN 'Top product: ' || substr(tp.title, 1, 50) || ' (score '
            || {_js('tp.demand_score')} || '). ' ELSE '' END AS insight
  FROM ({O['category_stats']}) st LEFT JOIN (SELECT category, title, demand_score FROM ({O['category_top']})
                                              WHERE rank = 1) tp ON tp.category = st.category"""


def expand_rnd(s: str) -> str:
    """Expand rnd(expr, d) into floor((expr) * 1e{d} + 0.5) / 1e{d}, the
    rounding the Spark side uses (catalytics.functions.scores.round_half)."""
    out, i = [], 0
    while True:
        j = s.find("rnd(", i)
        if j < 0 or (j > 0 and (s[j - 1].isalnum() or s[j - 1] == "_")):
            if j < 0:
                out.append(s[i:])
                return "".join(out)
            out.append(s[i:j + 4])
            i = j + 4
            continue
        out.append(s[i:j])
        k, depth = j + 4, 1
        while depth:
            depth += (s[k] == "(") - (s[k] == ")")
            k += 1
        inner = s[j + 4:k - 1]
        depth, cut = 0, None
        for pos, ch in enumerate(inner):
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                cut = pos
        expr, d = expand_rnd(inner[:cut]), int(inner[cut + 1:])
        out.append(f"(floor(({expr}) * 1e{d} + 0.5) / 1e{d})")
        i = k


def expand_count_if(s: str) -> str:
    """count_if(cond) -> count(*) FILTER (WHERE cond): BIGINT, like Spark's count_if."""
    out, i = [], 0
    while True:
        j = s.find("count_if(", i)
        if j < 0:
            out.append(s[i:])
            return "".join(out)
        out.append(s[i:j])
        k, depth = j + len("count_if("), 1
        while depth:
            depth += (s[k] == "(") - (s[k] == ")")
            k += 1
        out.append(f"(count(*) FILTER (WHERE {expand_count_if(s[j + len('count_if('):k - 1])}))")
        i = k




# J9, A17 over a fixed assignment: cluster = asin % 3
_SEGMENTED = """means AS (SELECT categoryName, CAST(asin % 3 AS INTEGER) AS cid, sum(CAST(demand_score AS DECIMAL(20,4))) / count(*) AS m
  FROM scored WHERE categoryName IS NOT NULL GROUP BY 1, 2),
lab AS (SELECT categoryName, cid, CASE row_number() OVER (PARTITION BY categoryName ORDER BY m DESC, cid)
          WHEN 1 THEN 'Hot' WHEN 2 THEN 'Warm' ELSE 'Cold' END AS segment FROM means),
segmented AS (SELECT s.*, l.cid, l.segment FROM scored s JOIN lab l ON l.categoryName = s.categoryName AND l.cid = s.asin % 3)"""
O["segment_label_map"] = _with(_SEGMENTED, "SELECT categoryName, cid AS cluster, segment, count(*) AS n FROM segmented GROUP BY 1, 2, 3", "scored")
O["segment_summary"] = _with(_SEGMENTED, f"""SELECT categoryName, segment, count(*) AS count, {ex_avg('demand_score')} AS avg_demand_score,
  {ex_avg('price')} AS avg_price, {ex_avg('stars')} AS avg_stars, CAST(sum(boughtInLastMonth) AS BIGINT) AS total_bought,
  CAST(sum(CAST(isBestSeller AS INTEGER)) AS BIGINT) AS best_sellers FROM segmented GROUP BY 1, 2""", "scored")

# M11 inputs: clipped features, category code of the catalog, display score
O["category_scatter_fixed_segments"] = _with(_SEGMENTED, """SELECT categoryName AS category, asin, rnd(price, 2) AS x, rnd(demand_score, 2) AS y,
  substr(title, 1, 45) AS title, segment FROM (SELECT *, row_number() OVER (PARTITION BY categoryName ORDER BY md5(CAST(asin AS VARCHAR)), asin) AS rk
  FROM segmented) WHERE rk <= 300""", "scored")
O["request_features"] = _with(f"""codes AS (SELECT categoryName, CAST(row_number() OVER (ORDER BY categoryName) - 1 AS INTEGER) AS code
    FROM (SELECT DISTINCT coalesce(nullif(trim(categoryName), ''), 'Unknown') AS categoryName FROM scored)),
  lc AS (SELECT l.asin, l.categoryName,
     greatest(0.0{D}, least(100.0{D}, ((l.stars - 1.0{D}) / 4.0{D}) * 100.0{D})) AS stars_norm,
     CASE WHEN bought_max > 0 THEN greatest(0.0{D}, least(100.0{D}, (l.boughtInLastMonth / bought_max) * 100.0{D}))
          ELSE 0.0{D} END AS bought_norm,
     CASE WHEN l.isBestSeller THEN 100.0{D} ELSE 0.0{D} END AS bs_norm,
     CASE WHEN price_max > price_min THEN greatest(0.0{D}, least(100.0{D},
          (1.0{D} - (l.price - price_min) / (price_max - price_min)) * 100.0{D})) ELSE 50.0{D} END AS price_norm
   FROM (SELECT * REPLACE (CASE id % 7 WHEN 2 THEN '' WHEN 3 THEN 'zz new' ELSE categoryName END AS categoryName) FROM lview) l, cstats)""",
   f"""SELECT asin, lc.categoryName, stars_norm, bought_norm, bs_norm, price_norm, coalesce(code, 0) AS cat_enc,
     rnd(stars_norm*0.25{D} + bought_norm*0.25{D} + bs_norm*0.25{D} + price_norm*0.25{D}, 2) AS demand_score
   FROM lc LEFT JOIN codes ON codes.categoryName = coalesce(nullif(trim(lc.categoryName), ''), 'Unknown')""", "scored", "listings")
for _q, _is in (("listings_accepted", "IS NULL"), ("listings_rejected", "IS NOT NULL")):
    O[_q] = O["validate_listings"].replace("SELECT asin, id, owner_email, price, stars", "SELECT * FROM (SELECT asin, id, owner_email, price, stars") + f") WHERE reject_reason {_is}"
O["image_uploads"] = _with("""up AS (SELECT listing_id AS id, actor_email || '@shop.example' AS owner_email, printf('photo %d', event_id)
    || CASE event_id % 7 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.webp' WHEN 3 THEN '.gif' WHEN 4 THEN '.jpeg' WHEN 5 THEN '' ELSE '.jpg.exe' END AS filename,
    CASE event_id % 7 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.webp' WHEN 4 THEN '.jpeg' END AS ext FROM clog2 WHERE event_type = 'view')""",
    """SELECT id, owner_email, filename, printf('up_%s_%d%s', split_part(trim(owner_email), '@', 1), id, ext) AS image_filename,
  CASE ext WHEN '.png' THEN 'image/png' WHEN '.webp' THEN 'image/webp' WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' END AS content_type,
  CASE WHEN ext IS NULL THEN 'Only jpg/png/webp allowed' END AS reject_reason FROM up""", "listings", "changes")
O["stored_listing_updates"] = O["listing_updates"]
O["stored_listing_deletes"] = O["listing_deletes"]
O["product_listing_deep"] = O["product_listing_price_desc"].replace("WHERE stars >= 3.0 AND", "WHERE").replace("LIMIT 20 OFFSET 20", "LIMIT 5 OFFSET 150")
_DAMAGED = """CASE WHEN id % 37 = 5 AND id % 11 <> 0 THEN 'wrong number of columns' WHEN id % 11 = 0 THEN 'id required' WHEN id % 13 = 0 THEN 'price is no double' END"""
O["quarantine_accepted"] = sql(f"SELECT asin, id, owner_email, price, stars, boughtInLastMonth FROM lview WHERE {_DAMAGED} IS NULL", "listings")
O["quarantine_reasons"] = sql(f"SELECT reject_reason, count(*) AS count FROM (SELECT {_DAMAGED} AS reject_reason FROM lview) WHERE reject_reason IS NOT NULL GROUP BY 1", "listings")
O["period_price_quantiles_checked"] = """SELECT p_brand AS category, count(*) AS count, true AS within_error FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE strftime(l_shipdate, '%Y-%m') BETWEEN '1994-02' AND '1996-07' GROUP BY 1"""
O["order_ingest_stream"] = O["order_ingest"]
O["stream_units_stream"] = O["stream_units_tumbling"]

ORACLES.update({k: expand_count_if(expand_rnd(v)) for k, v in ORACLES.items()})
