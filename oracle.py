"""DuckDB SQL for the registered queries, written from the rules alone.

The texts share nothing with the Spark plans but the input tables: pair lists
are self-joins, categories are ranked by windows, and so on.
"""

from __future__ import annotations

DAY = "2001-01-01"


def _ratings(item: str = "l_partkey") -> str:
    return f"""
raw AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST({item} AS VARCHAR) AS business_id,
         CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS stars, o_orderdate AS day,
         (o_orderdate, o_orderkey, l_linenumber, l_quantity, l_shipdate, l_extendedprice) AS rated_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
train AS (SELECT * FROM raw WHERE day < TIMESTAMP '{DAY}'),
holdout AS (SELECT * FROM raw WHERE day >= TIMESTAMP '{DAY}')"""


RATINGS = _ratings()
DENSE = _ratings("l_suppkey")

USERS = """
users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, o.review_count, o.yelping_since, r.average_stars,
         e.useful, e.funny, e.cool, e.fans
  FROM customer
  LEFT JOIN (SELECT o_custkey, count(*) AS review_count, strftime(min(o_orderdate), '%Y-%m-%d') AS yelping_since
             FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey
  LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS useful,
                    count(*) FILTER (WHERE event_type = 'view') AS funny,
                    count(*) FILTER (WHERE event_type = 'purchase') AS cool,
                    count(*) FILTER (WHERE event_type = 'signup') AS fans
             FROM events GROUP BY 1) e ON e.user_id = c_custkey
  LEFT JOIN (SELECT user_id, avg(stars) AS average_stars FROM raw GROUP BY 1) r
         ON r.user_id = CAST(c_custkey AS VARCHAR)
)"""

BUSINESSES = """
businesses AS (
  SELECT CAST(p_partkey AS VARCHAR) AS business_id, p_brand AS postal_code, r.stars, r.review_count,
         CAST(p_size % 5 <> 0 AS INTEGER) AS is_open,
         CASE WHEN p_size % 7 <> 0 THEN {
           'NoiseLevel': CASE WHEN p_size % 4 <> 0 THEN lower(p_type) END,
           'OutdoorSeating': CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END,
           'RestaurantsAttire': p_type,
           'RestaurantsDelivery': CASE WHEN p_size % 3 <> 0 THEN CASE WHEN p_size > 10 THEN 'True' ELSE 'False' END END,
           'RestaurantsGoodForGroups': CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END,
           'RestaurantsPriceRange2': CAST(1 + p_size % 4 AS VARCHAR),
           'RestaurantsReservations': CASE WHEN p_size < 20 THEN 'True' ELSE 'False' END,
           'RestaurantsTakeOut': CASE WHEN p_size % 5 <> 0 THEN CASE WHEN p_size > 30 THEN 'True' ELSE 'False' END END
         } END AS attributes
  FROM part
  LEFT JOIN (SELECT business_id, avg(stars) AS stars, count(*) AS review_count FROM raw GROUP BY 1) r
         ON r.business_id = CAST(p_partkey AS VARCHAR)
)"""

SLOTS = """
slots AS (
  SELECT CAST(user_id AS VARCHAR) AS business_id, strftime(ts, '%a') AS day, CAST(hour(ts) AS INTEGER) AS hour,
         count(*) AS n
  FROM events GROUP BY 1, 2, 3
)"""

ATTRIBUTES = (
    "NoiseLevel", "OutdoorSeating", "RestaurantsAttire", "RestaurantsDelivery", "RestaurantsGoodForGroups",
    "RestaurantsPriceRange2", "RestaurantsReservations", "RestaurantsTakeOut",
)
_ATTRS = ", ".join(f"b.attributes.{a} AS {a}" for a in ATTRIBUTES)
_WIDE = (
    "b.postal_code, round(b.stars, 6) AS business_stars, b.review_count AS business_review_count, b.is_open, " + _ATTRS
)
_NARROW = "round(b.stars, 6) AS business_stars, b.review_count AS business_review_count, b.is_open"
_BASIC = "u.review_count AS user_review_count, u.yelping_since, round(u.average_stars, 6) AS average_stars"
_ENGAGED = (
    "u.review_count AS user_review_count, u.useful, u.funny, u.cool, u.fans, "
    "round(u.average_stars, 6) AS average_stars"
)

CATEGORICAL = ("yelping_since", "postal_code", *ATTRIBUTES)
NUMERIC = ("user_review_count", "average_stars", "business_stars", "business_review_count", "is_open")


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _latest(source: str, name: str = "latest") -> str:
    return f"""
{name} AS (SELECT user_id, business_id, arg_max(stars, rated_at) AS stars FROM {source} GROUP BY 1, 2)"""


def _means(source: str) -> str:
    return f"""
user_means AS (SELECT user_id, avg(stars) AS user_mean FROM {source} GROUP BY 1),
item_means AS (SELECT business_id, avg(stars) AS item_mean FROM {source} GROUP BY 1)"""


# every unordered pair of items (and each item with itself) with a common rater
CO_RATED = """
co AS (
  SELECT a.business_id AS item_a, b.business_id AS item_b, count(*) AS n,
         sum(a.stars) AS sa, sum(b.stars) AS sb, sum(a.stars * b.stars) AS sab,
         sum(a.stars * a.stars) AS saa, sum(b.stars * b.stars) AS sbb
  FROM latest a JOIN latest b ON a.user_id = b.user_id AND a.business_id <= b.business_id
  GROUP BY 1, 2
)"""

_SPREAD_A, _SPREAD_B = "(n * saa - sa * sa)", "(n * sbb - sb * sb)"


def _pearson(mean_a: str, mean_b: str) -> str:
    return f"""CASE WHEN {mean_a} IS NULL OR {mean_b} IS NULL THEN 0e0
         WHEN coalesce(n, 0) <= 2 THEN greatest(1e0 - abs({mean_a} - {mean_b}) / 5e0, 0e0)
         WHEN {_SPREAD_A} = 0 OR {_SPREAD_B} = 0 THEN 0e0
         ELSE (n * sab - sa * sb) / (sqrt({_SPREAD_A}) * sqrt({_SPREAD_B})) END"""


_COSINE = "coalesce(n / (n + 10e0) * (sab / (sqrt(saa) * sqrt(sbb))), 0e0)"


def _candidates(pairs: str) -> str:
    return f"""
wanted AS (SELECT DISTINCT user_id, business_id AS target FROM {pairs}),
cand AS (
  SELECT w.user_id, w.target, l.business_id AS item, l.stars
  FROM wanted w JOIN latest l ON l.user_id = w.user_id
  WHERE w.target IN (SELECT business_id FROM latest)
)"""


def _ranked(kind: str, k: int) -> str:
    sim = _pearson("mt.item_mean", "mi.item_mean") if kind == "pearson" else _COSINE
    keep = "sim <> 0" if kind == "pearson" else "sim > 0"
    return f"""
scored AS (
  SELECT c.user_id, c.target, c.item, c.stars, {sim} AS sim
  FROM cand c
  LEFT JOIN co ON co.item_a = least(c.target, c.item) AND co.item_b = greatest(c.target, c.item)
  LEFT JOIN item_means mt ON mt.business_id = c.target
  LEFT JOIN item_means mi ON mi.business_id = c.item
),
near AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, target ORDER BY floor(sim * 1e12 + 0.5e0) DESC, item) AS rank
    FROM scored WHERE {keep})
  WHERE rank <= {k}
)"""


def _predicted(kind: str) -> str:
    if kind == "pearson":
        value = "CASE WHEN p.w IS NULL THEN coalesce(um.user_mean, 3.45e0) ELSE (um.user_mean + p.w) / 2 END"
    else:
        value = ("CASE WHEN p.w IS NULL THEN (coalesce(um.user_mean, 3.45e0) + coalesce(im.item_mean, 3.45e0)) / 2 "
                 "ELSE greatest(1e0, least(5e0, p.w)) END")
    return f"""
predicted AS (
  SELECT w.user_id, w.target AS business_id, {value} AS prediction
  FROM wanted w
  LEFT JOIN (SELECT user_id, target, sum(sim * stars) / sum(abs(sim)) AS w FROM near GROUP BY 1, 2) p
         ON p.user_id = w.user_id AND p.target = w.target
  LEFT JOIN user_means um ON um.user_id = w.user_id
  LEFT JOIN item_means im ON im.business_id = w.target
)"""


def _cf(kind: str, pairs: str, k: int, ratings: str = RATINGS, source: str = "train") -> str:
    return _with(ratings, _latest(source), _means(source), CO_RATED, _candidates(pairs), _ranked(kind, k), _predicted(kind))


_ROUNDED = "round(prediction, 6) AS prediction"
_FEATURES_JOIN = """
  LEFT JOIN users u ON u.user_id = r.user_id
  LEFT JOIN businesses b ON b.business_id = r.business_id"""


def _dictionary() -> str:
    per_column = " UNION ".join(
        f"SELECT '{c}' AS \"column\", coalesce({c}, 'missing') AS value FROM features" for c in CATEGORICAL
    )
    return f"""
features AS (SELECT r.user_id, r.business_id, r.stars, {_BASIC}, {_WIDE} FROM train r {_FEATURES_JOIN}),
dictionary AS (
  SELECT "column", value,
         CAST(row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS DOUBLE) AS code
  FROM ({per_column})
)"""


def _coded(source: str, columns: str, only_codes: bool = False) -> str:
    joins = "\n".join(
        f"LEFT JOIN dictionary d{i} ON d{i}.\"column\" = '{c}' AND d{i}.value = coalesce(f.{c}, 'missing')"
        for i, c in enumerate(CATEGORICAL)
    )
    codes = ", ".join(f"d{i}.code AS {c}" for i, c in enumerate(CATEGORICAL))
    numbers = ", ".join(f"CAST(f.{c} AS DOUBLE) AS {c}" for c in NUMERIC)
    listed = codes if only_codes else f"{numbers}, {codes}"
    return f"SELECT {columns}, {listed} FROM {source} f {joins}"


_ENCODED = f", encoded AS ({_coded('features', 'f.user_id, f.business_id, f.stars')})"


def _correlations(source: str, features: tuple[str, ...], label: str = "stars") -> str:
    one = " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, {i} AS position, CASE WHEN count({f}) = count(*) THEN
            covar_pop({f}, {label}) / nullif(sqrt(var_pop({f})) * sqrt(var_pop({label})), 0) END AS correlation
            FROM {source}"""
        for i, f in enumerate(features)
    )
    return f", corr AS ({one})"


_HYBRID = (
    *("user_review_count", "useful", "funny", "cool", "fans", "average_stars"),
    *("business_stars", "business_review_count", "is_open", "checkin_total", "cf_prediction"),
)
_WITH_CHECKINS = """
totals AS (SELECT business_id, CAST(sum(n) AS BIGINT) AS checkin_total FROM slots GROUP BY 1),
both_sides AS (
  SELECT b.business_id, round(b.stars, 6) AS business_stars, b.review_count AS business_review_count, b.is_open,
         t.checkin_total
  FROM businesses b JOIN totals t ON t.business_id = b.business_id
)"""

_TOP20 = """
top AS (SELECT business_id, count(*) AS n_ratings FROM raw GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)"""

_COMBINED = """
first AS (SELECT user_id, business_id, um.user_mean AS first
          FROM (SELECT DISTINCT user_id, business_id FROM train) JOIN user_means um USING (user_id)),
second AS (SELECT user_id, business_id, im.item_mean AS second
           FROM (SELECT DISTINCT user_id, business_id FROM holdout) JOIN item_means im USING (business_id)),
both_predictions AS (SELECT user_id, business_id, first, second
           FROM first FULL OUTER JOIN second USING (user_id, business_id)),
combined AS (SELECT user_id, business_id, first, second, stars AS actual
             FROM both_predictions FULL OUTER JOIN latest USING (user_id, business_id))"""

_LABELLED = """
means_side_by_side AS (
  SELECT l.user_id, l.business_id, um.user_mean AS first, im.item_mean AS second, l.stars AS actual
  FROM latest l LEFT JOIN user_means um USING (user_id) LEFT JOIN item_means im USING (business_id)
),
labelled AS (
  SELECT *, CASE WHEN first IS NULL OR second IS NULL OR actual IS NULL THEN NULL
                 WHEN abs(first - actual) < abs(second - actual) THEN 0 ELSE 1 END AS closer
  FROM means_side_by_side
)"""


_BLANKED = """
asked AS (
  SELECT * FROM (
    SELECT CASE WHEN right(business_id, 1) NOT IN ('1', '3', '5', '7', '9') THEN user_id END AS user_id,
           CASE WHEN right(user_id, 1) NOT IN ('0', '2', '4', '6', '8') THEN business_id END AS business_id
    FROM holdout)
  WHERE user_id IS NULL OR business_id IS NULL
)"""


def _blank_ids(value: str) -> str:
    return _with(RATINGS, _means("train"), _BLANKED) + f"""
        SELECT a.user_id, a.business_id, round({value}, 6) AS prediction
        FROM asked a LEFT JOIN user_means um ON um.user_id = a.user_id
        LEFT JOIN item_means im ON im.business_id = a.business_id"""


def _same_result(queries: dict[str, str]) -> dict[str, str]:
    """Queries that differ from others in how the work is spread, or in where the rows come from."""
    return {
        "predict_pearson_cf_skewed": queries["predict_pearson_cf_dense"],
        "predict_cosine_cf_skewed": queries["predict_cosine_cf"],
        "cf_train_feature_skewed": queries["cf_train_feature"],
        "read_ratings_csv": queries["scan_ratings"],
        "read_pairs_csv": queries["scan_validation_pairs"],
        "read_users_json": queries["user_features_engagement"],
        "read_businesses_json": queries["business_features_wide"],
        "read_checkins_json": queries["checkin_total"],
    }


def oracle_sql() -> dict[str, str]:
    raw = _with(RATINGS)
    found = {
        "scan_ratings": f"{raw} SELECT user_id, business_id, stars FROM raw",
        "scan_validation_pairs": f"{raw} SELECT user_id, business_id FROM holdout",
        "business_features_wide": _with(RATINGS, BUSINESSES) + f" SELECT b.business_id, {_WIDE} FROM businesses b",
        "business_features_narrow": _with(RATINGS, BUSINESSES) + f" SELECT b.business_id, {_NARROW} FROM businesses b",
        "user_features_basic": _with(RATINGS, USERS) + f" SELECT u.user_id, {_BASIC} FROM users u",
        "user_features_engagement": _with(RATINGS, USERS) + f" SELECT u.user_id, {_ENGAGED} FROM users u",
        "flatten_feature_row": _with(RATINGS, BUSINESSES) + f"""
            SELECT b.business_id, b.postal_code, round(b.stars, 6) AS stars, b.review_count, b.is_open, {_ATTRS}
            FROM businesses b""",
        "join_user_features": _with(RATINGS, USERS) + f"""
            SELECT r.user_id, r.business_id, r.stars, {_BASIC} FROM raw r
            LEFT JOIN users u ON u.user_id = r.user_id""",
        "join_business_features": _with(RATINGS, BUSINESSES) + f"""
            SELECT r.user_id, r.business_id, r.stars, {_WIDE} FROM raw r
            LEFT JOIN businesses b ON b.business_id = r.business_id""",
        "business_checkin_join": _with(RATINGS, BUSINESSES, SLOTS, _WITH_CHECKINS) + " SELECT * FROM both_sides",
        "feature_table": _with(RATINGS, USERS, BUSINESSES) + f"""
            SELECT r.user_id, r.business_id, r.stars, {_BASIC}, {_WIDE} FROM raw r {_FEATURES_JOIN}""",
        "hybrid_feature_table": _cf("cosine", "train", 15) + f""",
            {USERS}, {BUSINESSES}, {SLOTS}, {_WITH_CHECKINS}
            SELECT r.user_id, r.business_id, r.stars, {_ENGAGED}, b.business_stars, b.business_review_count,
                   b.is_open, b.checkin_total, round(p.prediction, 6) AS cf_prediction
            FROM train r
            LEFT JOIN users u ON u.user_id = r.user_id
            LEFT JOIN both_sides b ON b.business_id = r.business_id
            LEFT JOIN predicted p ON p.user_id = r.user_id AND p.business_id = r.business_id""",
        "cf_candidates": _with(RATINGS, _latest("train"), _candidates("holdout")) + " SELECT * FROM cand",
        "co_rating_stats": _with(DENSE, _latest("raw"), CO_RATED) + """
            SELECT item_a, item_b, n, sa AS sum_a, sb AS sum_b, sab AS sum_ab, saa AS sum_aa, sbb AS sum_bb
            FROM co WHERE item_a < item_b""",
        "co_rating_stats_requested": _with(RATINGS, _latest("train"), _candidates("holdout"), CO_RATED) + """
            SELECT item_a, item_b, n, sa AS sum_a, sb AS sum_b, sab AS sum_ab, saa AS sum_aa, sbb AS sum_bb
            FROM co WHERE EXISTS (
                SELECT 1 FROM cand c WHERE least(c.target, c.item) = item_a AND greatest(c.target, c.item) = item_b)""",
        "co_raters": _with(RATINGS, _latest("raw"), _TOP20) + """
            SELECT a.business_id AS item_a, b.business_id AS item_b, a.user_id
            FROM latest a JOIN latest b ON a.user_id = b.user_id AND a.business_id < b.business_id
            WHERE a.business_id IN (SELECT business_id FROM top) AND b.business_id IN (SELECT business_id FROM top)""",
        "co_rater_counts": _with(RATINGS, _TOP20) + """
            , rater AS (SELECT DISTINCT business_id, user_id FROM raw WHERE business_id IN (SELECT business_id FROM top)),
            sized AS (SELECT business_id, count(*) AS n FROM rater GROUP BY 1),
            common AS (
              SELECT a.business_id AS item_a, b.business_id AS item_b, count(*) AS n
              FROM rater a JOIN rater b ON a.user_id = b.user_id AND a.business_id < b.business_id GROUP BY 1, 2)
            SELECT a.business_id AS item_a, b.business_id AS item_b, a.n AS n_a, b.n AS n_b, coalesce(c.n, 0) AS n
            FROM sized a JOIN sized b ON a.business_id < b.business_id
            LEFT JOIN common c ON c.item_a = a.business_id AND c.item_b = b.business_id""",
        "popular_item_pairs": _with(RATINGS, _TOP20) + """
            , ranked AS (SELECT business_id, row_number() OVER (ORDER BY n_ratings DESC, business_id) AS rk FROM top)
            SELECT a.business_id AS first, b.business_id AS second FROM ranked a JOIN ranked b ON a.rk < b.rk""",
        "popular_pair_similarity": _with(RATINGS, _latest("raw"), _means("raw"), CO_RATED, _TOP20) + f"""
            SELECT a.business_id AS item_a, b.business_id AS item_b, coalesce(n, 0) AS n,
                   round({_pearson('ma.item_mean', 'mb.item_mean')}, 6) AS pearson,
                   round({_COSINE}, 6) AS cosine
            FROM top a JOIN top b ON a.business_id < b.business_id
            LEFT JOIN co ON co.item_a = a.business_id AND co.item_b = b.business_id
            JOIN item_means ma ON ma.business_id = a.business_id
            JOIN item_means mb ON mb.business_id = b.business_id""",
        "pearson_similarity": _with(DENSE, _latest("train"), _means("train"), CO_RATED, _candidates("holdout")) + f"""
            , pairs AS (SELECT DISTINCT least(target, item) AS item_a, greatest(target, item) AS item_b FROM cand)
            SELECT p.item_a, p.item_b, coalesce(n, 0) AS n,
                   round({_pearson('ma.item_mean', 'mb.item_mean')}, 6) AS similarity
            FROM pairs p LEFT JOIN co ON co.item_a = p.item_a AND co.item_b = p.item_b
            LEFT JOIN item_means ma ON ma.business_id = p.item_a
            LEFT JOIN item_means mb ON mb.business_id = p.item_b""",
        "cosine_similarity": _with(RATINGS, _latest("train"), CO_RATED, _candidates("holdout")) + f"""
            , pairs AS (SELECT DISTINCT least(target, item) AS item_a, greatest(target, item) AS item_b FROM cand)
            SELECT p.item_a, p.item_b, coalesce(n, 0) AS n, round({_COSINE}, 6) AS similarity
            FROM pairs p LEFT JOIN co ON co.item_a = p.item_a AND co.item_b = p.item_b""",
        "top_neighbours": _with(
            RATINGS, _latest("train"), _means("train"), CO_RATED, _candidates("holdout"), _ranked("pearson", 10)
        ) + " SELECT user_id, target, item, stars, round(sim, 6) AS similarity, rank FROM near",
        "top_neighbours_15": _with(
            RATINGS, _latest("train"), _means("train"), CO_RATED, _candidates("holdout"), _ranked("cosine", 15)
        ) + " SELECT user_id, target, item, stars, round(sim, 6) AS similarity, rank FROM near",
        "predict_pearson_cf": _cf("pearson", "holdout", 10) + f"""
            SELECT user_id, business_id, {_ROUNDED} FROM holdout JOIN predicted USING (user_id, business_id)""",
        "predict_pearson_cf_dense": _cf("pearson", "holdout", 10, DENSE) + f"""
            SELECT user_id, business_id, {_ROUNDED} FROM holdout JOIN predicted USING (user_id, business_id)""",
        "predict_cosine_cf": _cf("cosine", "holdout", 15) + f"""
            SELECT user_id, business_id, {_ROUNDED} FROM holdout JOIN predicted USING (user_id, business_id)""",
        "gbt_feature_model_scored": raw + " SELECT user_id, business_id, true AS scored FROM holdout",
        "gbt_hybrid_model_scored": raw + " SELECT user_id, business_id, true AS scored FROM holdout",
        "gbt_selector_model_scored": raw + " SELECT DISTINCT user_id, business_id, true AS scored FROM holdout",
        "gbt_selector_cross_fitted_scored": raw + " SELECT DISTINCT user_id, business_id, true AS scored FROM holdout",
        "gbt_regression_planted": raw + " SELECT count(*) AS n, true AS beats_the_mean FROM holdout",
        "gbt_selector_planted": raw + " SELECT count(*) AS n, true AS beats_larger_class, true AS calibrated FROM holdout",
        "predictions_round_trip": raw + " SELECT user_id, business_id, stars AS prediction FROM raw",
        "predict_pearson_cf_blank_ids": _blank_ids("coalesce(um.user_mean, 3.45e0)"),
        "predict_cosine_cf_blank_ids": _blank_ids("(coalesce(um.user_mean, 3.45e0) + coalesce(im.item_mean, 3.45e0)) / 2"),
        "cf_train_feature": _cf("cosine", "train", 15) + f" SELECT user_id, business_id, {_ROUNDED} FROM predicted",
        "rmse": _cf("cosine", "holdout", 15) + """
            SELECT round(sqrt(avg((prediction - stars) ** 2)), 6) AS rmse, count(*) AS n
            FROM holdout JOIN predicted USING (user_id, business_id)""",
        "error_distribution": _cf("pearson", "holdout", 10) + """
            SELECT CAST(least(floor(abs(prediction - stars)), 4) AS BIGINT) AS bucket, count(*) AS n
            FROM holdout JOIN predicted USING (user_id, business_id) GROUP BY 1""",
        "combine_predictions": _with(RATINGS, _latest("raw"), _means("train"), _COMBINED) + """
            SELECT user_id, business_id, round(first, 6) AS first, round(second, 6) AS second, actual FROM combined""",
        "closer_prediction_label": _with(RATINGS, _latest("raw"), _means("raw"), _LABELLED) + """
            SELECT user_id, business_id, closer FROM labelled""",
        "select_prediction": _with(RATINGS, _latest("raw"), _means("raw"), _LABELLED) + """
            SELECT user_id, business_id, round(CASE WHEN closer = 0 THEN first ELSE second END, 6) AS prediction
            FROM labelled""",
        "user_mean_rating": f"""{raw}
            SELECT user_id, round(avg(stars), 6) AS user_mean, count(*) AS n_ratings FROM raw GROUP BY 1""",
        "business_mean_rating": f"""{raw}
            SELECT business_id, round(avg(stars), 6) AS business_mean, count(*) AS n_ratings FROM raw GROUP BY 1""",
        "users_per_business": f"{raw} SELECT DISTINCT business_id, user_id FROM raw",
        "businesses_per_user": f"{raw} SELECT DISTINCT user_id, business_id FROM raw",
        "business_popularity": f"{raw} SELECT business_id, count(*) AS n_ratings FROM raw GROUP BY 1",
        "top_popular": _with(RATINGS, _TOP20) + " SELECT * FROM top",
        "last_rating": _with(RATINGS, _latest("raw")) + " SELECT user_id, business_id, stars FROM latest",
        "checkin_total": _with(SLOTS) + """
            SELECT business_id, CAST(sum(n) AS BIGINT) AS checkin_total FROM slots GROUP BY 1""",
        "checkin_by_day": _with(SLOTS) + """
            SELECT business_id, day, CAST(sum(n) AS BIGINT) AS n_checkins FROM slots GROUP BY 1, 2""",
        "checkin_by_hour": _with(SLOTS) + """
            SELECT business_id, hour, CAST(sum(n) AS BIGINT) AS n_checkins FROM slots GROUP BY 1, 2""",
        "checkin_peak": _with(SLOTS) + """,
            days AS (SELECT business_id, day, sum(n) AS n FROM slots GROUP BY 1, 2),
            hours AS (SELECT business_id, hour, sum(n) AS n FROM slots GROUP BY 1, 2),
            day1 AS (SELECT business_id, day FROM (SELECT *, row_number() OVER (PARTITION BY business_id
                     ORDER BY n DESC, day) AS rk FROM days) WHERE rk = 1),
            hour1 AS (SELECT business_id, hour FROM (SELECT *, row_number() OVER (PARTITION BY business_id
                     ORDER BY n DESC, hour) AS rk FROM hours) WHERE rk = 1)
            SELECT business_id, day1.day AS peak_day, hour1.hour AS peak_hour, max(slots.n) AS max_slot
            FROM slots JOIN day1 USING (business_id) JOIN hour1 USING (business_id) GROUP BY 1, 2, 3""",
        "impute_categorical": _with(RATINGS, BUSINESSES) + " SELECT b.business_id, " + ", ".join(
            f"coalesce({c}, 'missing') AS {c.rsplit('.', 1)[-1]}"
            for c in ("b.postal_code", *(f"b.attributes.{a}" for a in ATTRIBUTES))
        ) + " FROM businesses b",
        "ordinal_dictionary": _with(RATINGS, USERS, BUSINESSES, _dictionary()) + """
            SELECT "column", value, code FROM dictionary""",
        "ordinal_encode_train": _with(RATINGS, USERS, BUSINESSES, _dictionary()) + " "
        + _coded("features", "f.user_id, f.business_id", only_codes=True),
        "ordinal_encode_validation": _with(RATINGS, USERS, BUSINESSES, _dictionary()) + f""",
            asked AS (SELECT r.user_id, r.business_id, {_BASIC}, {_WIDE} FROM holdout r {_FEATURES_JOIN})
            """ + _coded("asked", "f.user_id, f.business_id", only_codes=True),
        "encoded_feature_table": _with(RATINGS, USERS, BUSINESSES, _dictionary()) + " "
        + _coded("features", "f.user_id, f.business_id, f.stars"),
        "feature_correlations": _with(RATINGS, USERS, BUSINESSES, _dictionary()) + _ENCODED
        + _correlations("encoded", (*NUMERIC, *CATEGORICAL)) + """
            SELECT feature, position, round(correlation, 6) AS correlation FROM corr""",
        "feature_correlations_with_gaps": _with(RATINGS, USERS) + f""",
            engaged AS (SELECT r.stars, {_ENGAGED} FROM raw r LEFT JOIN users u ON u.user_id = r.user_id)"""
        + _correlations("engaged", _HYBRID[:6]) + """
            SELECT feature, position, round(correlation, 6) AS correlation FROM corr""",
        "select_top_features": _with(RATINGS, USERS, BUSINESSES, _dictionary()) + _ENCODED
        + _correlations("encoded", (*NUMERIC, *CATEGORICAL)) + """
            SELECT feature, position, round(correlation, 6) AS correlation FROM corr
            ORDER BY round(abs(correlation), 9) DESC NULLS LAST, position LIMIT 6""",
    }
    return found | _same_result(found)
