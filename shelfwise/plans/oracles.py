"""SQL with the same result as the queries of ``catalog``, for an independent engine.

Written from the definitions, not from the Spark plans: where the library has a
closed form, the SQL here goes event by event or pair by pair.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Inputs, as in ``datasets`` and at the top of ``catalog``.
CTES = {
    "rev": """SELECT o.o_custkey AS user_id, l.l_partkey AS product_id,
        CAST(floor((l.l_quantity - 1) / 10) AS INTEGER) + 1 AS rating, l.l_linenumber AS votes,
        l.l_returnflag <> 'R' AS verified_purchase, l.l_shipdate AS review_date
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "trev": "SELECT rev.*, p.p_name AS review_text FROM rev JOIN part p ON p.p_partkey = rev.product_id",
    "prod": """SELECT p_partkey AS product_id, p_name AS title, p_type AS category, p_brand AS subcategory,
        p_retailprice AS price FROM part""",
    "usr": """SELECT c_custkey AS user_id, c_name AS username, c_mktsegment AS user_segment,
        c_nationkey AS user_location FROM customer""",
    "ev": """SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
        CASE event_type WHEN 'signup' THEN 'add_to_cart' WHEN 'click' THEN 'recommend_click'
            WHEN 'error' THEN 'rating' ELSE event_type END AS event_type,
        ts, user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
        CAST(CAST(floor(value) AS BIGINT) % 5 + 1 AS DOUBLE) AS rating,
        CAST(round(value * 100) AS BIGINT) AS cents FROM events""",
    "sev": """SELECT event_id, user_id, product_id, event_type,
        CASE WHEN event_type <> 'rating' THEN session_id END AS session_id FROM ev""",
    "vec": "SELECT vec_id AS item_id, embedding::DOUBLE[] AS features, label FROM embeddings",
    "ms": """WITH p AS (SELECT user_id, product_id AS item_id, sum(cents) AS s, max(cents) AS hi, min(cents) AS lo,
            count(*) AS n FROM ev GROUP BY 1, 2)
        SELECT user_id, item_id, 'lightgcn' AS model, s / 10000.0::DOUBLE AS score FROM p
        UNION ALL SELECT user_id, item_id, 'content_based', hi / 10000.0::DOUBLE FROM p
        UNION ALL SELECT user_id, item_id, 'mf', n / 10.0::DOUBLE FROM p
        UNION ALL SELECT user_id, item_id, 'ncf', (lo - 300) / 1000000.0::DOUBLE FROM p""",
    "rk": """SELECT *, row_number() OVER (PARTITION BY user_id, model ORDER BY score DESC, item_id) AS rank FROM ms""",
    "lst": "SELECT * FROM rk WHERE rank <= 10",
    "lg": "SELECT * FROM rk WHERE model = 'lightgcn'",
    "rtev": """SELECT user_id, product_id AS item_id, max(rating) AS rating FROM ev WHERE event_type = 'rating'
        GROUP BY 1, 2""",
    "rp": "SELECT user_id, product_id AS item_id, max(rating) AS rating FROM rev GROUP BY 1, 2",
    "viewed": "SELECT DISTINCT user_id, product_id AS item_id FROM ev WHERE event_type = 'view'",
    "cat": "SELECT product_id AS item_id, category, subcategory, price FROM prod",
    "fb": """SELECT event_id, user_id, product_id AS item_id,
        CASE event_type WHEN 'recommend_click' THEN 'click' WHEN 'view' THEN 'view_time' ELSE event_type END AS event_type,
        rating, rating AS value, cents / 100.0::DOUBLE AS view_time_seconds,
        CASE WHEN cents % 2 = 0 THEN 'mf' END AS model_name, ts FROM ev""",
    "att": """SELECT fb.*, lst.model, lst.score AS model_score FROM fb
        JOIN lst ON fb.user_id = lst.user_id AND fb.item_id = lst.item_id""",
    "fr": """SELECT 'user' AS feature_type, CAST(user_id AS VARCHAR) AS entity_id,
        event_type || '_last' AS feature_name, CAST(product_id AS VARCHAR) AS value, ts AS updated_at FROM ev""",
    "held": """SELECT * FROM fr QUALIFY row_number() OVER
        (PARTITION BY feature_type, entity_id, feature_name ORDER BY updated_at DESC, value DESC) = 1""",
    "log": """SELECT label AS arm, list_slice(features, 1, 10) AS context, features[11] AS reward, item_id FROM vec""",
    "pop": """SELECT product_id AS item_id, count(*) AS view_count,
        row_number() OVER (ORDER BY count(*) DESC, product_id) AS rank FROM ev WHERE event_type = 'view' GROUP BY 1""",
    "raw": """SELECT product_id AS asin, CASE WHEN votes < 7 THEN user_id END AS reviewer_id,
        CASE WHEN rating = 3 THEN 'n/a' ELSE CAST(rating AS VARCHAR) END AS overall,
        nullif(review_text, 'red bolt') AS reviewtext, CAST(epoch(review_date) AS BIGINT) AS unixreviewtime,
        votes AS helpful_votes FROM trev""",
    "sess": """WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts)
                <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM ev),
            b AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts
                ROWS UNBOUNDED PRECEDING) AS nr FROM a)
        SELECT session_id, nr, arg_min(user_id, ts) AS user_id, min(ts) AS start_time, max(ts) AS last_time,
            count(*) AS events, count(DISTINCT product_id) AS products,
            count(*) FILTER (event_type = 'view') AS views,
            count(*) FILTER (event_type = 'add_to_cart') AS add_to_carts,
            count(*) FILTER (event_type = 'purchase') AS purchases,
            count(*) FILTER (event_type = 'recommend_click') AS recommend_clicks
        FROM b GROUP BY session_id, nr""",
    "neg_unseen": """SELECT u.user_id, i.item_id,
            row_number() OVER (PARTITION BY u.user_id ORDER BY i.item_id) - 1 AS nth,
            count(*) OVER (PARTITION BY u.user_id) AS unseen
        FROM (SELECT DISTINCT user_id FROM rp) u, (SELECT DISTINCT item_id FROM rp) i
        WHERE NOT EXISTS (SELECT 1 FROM rp WHERE rp.user_id = u.user_id AND rp.item_id = i.item_id)""",
    "prof": """WITH x AS (SELECT rp.user_id, rp.rating, unnest(features) AS v, generate_subscripts(features, 1) AS pos
                FROM rp JOIN vec ON rp.item_id = vec.item_id)
        SELECT user_id, pos - 1 AS pos, CASE WHEN count(*) FILTER (rating >= 4) > 0
            THEN avg(v) FILTER (rating >= 4) ELSE avg(v) END AS value FROM x GROUP BY user_id, pos""",
    "edge": """WITH c AS (SELECT user_id, product_id, count(*) AS n FROM ev GROUP BY 1, 2),
            w AS (SELECT 'u:' || user_id AS u, 'i:' || product_id AS i,
                n / sqrt(sum(n) OVER (PARTITION BY user_id) * sum(n) OVER (PARTITION BY product_id)) AS weight FROM c)
        SELECT u AS src, i AS dst, weight FROM w UNION ALL SELECT i, u, weight FROM w""",
    "cnt": "SELECT product_id AS item_id, count(*) AS interactions FROM rev GROUP BY 1",
    "poploc": """SELECT user_location AS value, product_id AS item_id, count(*) AS interactions,
            row_number() OVER (PARTITION BY user_location ORDER BY count(*) DESC, product_id) AS rank
        FROM rev JOIN usr ON rev.user_id = usr.user_id GROUP BY 1, 2""",
    "popall": """SELECT item_id, row_number() OVER (ORDER BY interactions DESC, item_id) AS rank
        FROM cnt WHERE interactions >= 10""",
    "popcat": """SELECT category, cat.item_id, coalesce(interactions, 0) AS interactions,
            row_number() OVER (PARTITION BY category ORDER BY coalesce(interactions, 0) DESC, cat.item_id) AS rank
        FROM cat LEFT JOIN cnt ON cat.item_id = cnt.item_id""",
    "pref": """SELECT c_custkey AS user_id, c_nationkey AS user_location,
            coalesce((SELECT list_sort(list_distinct(list(CASE WHEN o_orderstatus = 'P' THEN 'ECONOMY' ELSE 'SMALL' END)))
                FROM orders WHERE o_custkey = c_custkey), []) AS preferred FROM customer""",
    "clu": """SELECT label AS cluster, item_id, row_number() OVER (PARTITION BY label ORDER BY item_id) AS rank FROM vec""",
    "snap": """SELECT user_id, event_type AS model, 'day:' || strftime(ts, '%Y-%m-%d') AS context, product_id,
            ts + CASE WHEN event_type = 'view' THEN INTERVAL 1800 SECOND ELSE INTERVAL 3600 SECOND END AS expires_at
        FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, event_type, strftime(ts, '%Y-%m-%d')
            ORDER BY ts DESC) = 1""",
    "docl": """SELECT documents.doc_id, lang, source, n_chars, quality, toxic FROM documents
        LEFT JOIN labels ON documents.doc_id = labels.doc_id""",
}
NEEDS = {
    "trev": ["rev"], "sev": ["ev"], "ms": ["ev"], "rk": ["ms"], "lst": ["rk"], "lg": ["rk"], "rtev": ["ev"],
    "rp": ["rev"], "viewed": ["ev"], "cat": ["prod"], "fb": ["ev"], "att": ["fb", "lst"], "fr": ["ev"], "held": ["fr"],
    "log": ["vec"], "pop": ["ev"], "raw": ["trev"], "sess": ["ev"], "neg_unseen": ["rp"], "prof": ["rp", "vec"],
    "edge": ["ev"], "cnt": ["rev"], "poploc": ["rev", "usr"], "popall": ["cnt"], "popcat": ["cat", "cnt"],
    "clu": ["vec"], "snap": ["ev"],
}


def _with(names: list[str], body: str) -> str:
    ordered: list[str] = []

    def need(name):
        for other in NEEDS.get(name, []):
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered)
    head = body.lstrip()
    if head[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{head[15:]}"
    if head[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{head[5:]}"
    return f"WITH {ctes}\n{body}"


def oracle(name: str, inputs: str, body: str) -> None:
    ORACLES[name] = _with(inputs.split(), body)


def r(expr: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0::DOUBLE"


def uniform(*parts: str, seed: int = 42) -> str:
    text = " || '|' || ".join([f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts] + [f"'{seed}'"])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


TS = "'%Y-%m-%d %H:%M:%S'"
NOW = "TIMESTAMP '2024-02-01 00:00:00'"

# ---------------------------------------------------------------- sources and sinks

oracle("read_reviews", "", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem")
oracle("write_table", "prod", "SELECT product_id, title, category, price FROM prod")
oracle("validate_messages", "ev", "SELECT event_id, event_type <> 'add_to_cart' AS accepted FROM ev")
oracle("write_messages", "ev", """
    SELECT user_id || ':' || product_id AS key,
        '{"user_id":' || user_id || ',"product_id":' || product_id || ',"event_type":"' || event_type
        || '","timestamp":' || (epoch_us(ts) // 1000) || '}' AS value FROM ev""")
oracle("write_messages_files", "ev", """
    SELECT '{"user_id":' || user_id || ',"product_id":' || product_id || ',"event_type":"' || event_type
        || '","timestamp":' || (epoch_us(ts) // 1000) || '}' AS value FROM ev""")
oracle("read_events_stream", "ev", f"""
    SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(product_id AS VARCHAR) AS product_id, event_type, session_id,
        rating, strftime(ts, {TS}) AS ts FROM ev""")
oracle("feedback_event_log", "fb", f"""
    SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, event_type,
        strftime(ts, {TS}) AS timestamp, rating, coalesce(model_name, 'none') AS model FROM fb""")
ORACLES["feedback_event_log_files"] = ORACLES["feedback_event_log"]
oracle("write_recommendations", "lg", """
    SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS product_id,
        round(score, 6) AS score, 'v1' AS model_version, FALSE AS clicked FROM lg WHERE rank <= 10""")
oracle("write_factors", "vec", f"""
    SELECT item_id, pos - 1 AS pos, {r('value')} AS value FROM
        (SELECT item_id, unnest(features) AS value, generate_subscripts(features, 1) AS pos FROM vec)""")
oracle("table_page", "usr", "SELECT * FROM usr ORDER BY user_id LIMIT 50 OFFSET 20")
oracle("table_upsert", "usr", """
    WITH ch AS (SELECT o_custkey AS user_id, max(o_orderpriority) AS seg FROM orders GROUP BY 1)
    SELECT coalesce(usr.user_id, ch.user_id) AS user_id, username,
        CASE WHEN ch.user_id IS NOT NULL THEN seg ELSE user_segment END AS user_segment, user_location,
        CASE WHEN ch.user_id IS NOT NULL THEN '2024-02-01 00:00:00' END AS updated_at
    FROM usr FULL OUTER JOIN ch ON usr.user_id = ch.user_id""")
oracle("table_delete", "usr", """
    SELECT * FROM usr WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")


def _shard(col: str, n: int) -> str:
    expr = "0::BIGINT"
    for start in (1, 9, 17, 25):
        expr = f"(({expr} * 4294967296 + CAST('0x' || substr(md5(CAST({col} AS VARCHAR)), {start}, 8) AS BIGINT)) % {n})"
    return f"CAST({expr} AS INTEGER)"


oracle("shard_id", "usr", f"SELECT user_id, {_shard('user_id', 4)} AS shard_4, {_shard('user_id', 7)} AS shard_7 FROM usr")
oracle("sharded_write", "usr", f"SELECT user_id, username, {_shard('user_id', 4)} AS shard FROM usr")
oracle("sharded_lookup", "usr ev", """
    SELECT user_id, username FROM usr WHERE user_id IN (SELECT user_id FROM ev WHERE event_type = 'purchase')""")

# ---------------------------------------------------------------- projections

oracle("standardize_columns", "raw", """
    SELECT asin AS product_id, reviewer_id AS user_id, overall AS rating, reviewtext AS review_text,
        unixreviewtime AS review_date, helpful_votes FROM raw""")
oracle("clean_reviews", "raw", f"""
    SELECT asin AS product_id, reviewer_id AS user_id, TRY_CAST(overall AS DOUBLE) AS rating,
        coalesce(reviewtext, '') AS review_text, '' AS summary,
        strftime(make_timestamp(unixreviewtime * 1000000), {TS}) AS review_date, FALSE AS verified_purchase,
        helpful_votes AS votes FROM raw
    WHERE reviewer_id IS NOT NULL AND TRY_CAST(overall AS DOUBLE) IS NOT NULL""")
BLANK = r"[\s\pZ\x0B\x1C-\x1F\x{85}]+"
oracle("text_features", "", f"""
    SELECT doc_id, CAST(length(text) AS INTEGER) AS review_text_length,
        CAST(len(list_filter(regexp_split_to_array(text, '{BLANK}'), lambda w: w <> '')) AS INTEGER) AS review_text_word_count,
        CAST(length(source) AS INTEGER) AS summary_length,
        CAST(len(list_filter(regexp_split_to_array(source, '{BLANK}'), lambda w: w <> '')) AS INTEGER) AS summary_word_count
    FROM documents""")
oracle("temporal_features", "rev", f"""
    SELECT user_id, product_id, votes, strftime(review_date, {TS}) AS review_date,
        CAST(year(review_date) AS INTEGER) AS review_date_year, CAST(month(review_date) AS INTEGER) AS review_date_month,
        CAST(day(review_date) AS INTEGER) AS review_date_day,
        CAST(isodow(review_date) - 1 AS INTEGER) AS review_date_dayofweek,
        CAST(hour(review_date) AS INTEGER) AS review_date_hour,
        CAST(floor((epoch({NOW}) - epoch(review_date)) / 86400) AS BIGINT) AS review_date_days_since FROM rev""")
oracle("interaction_features", "trev", f"""
    SELECT user_id, product_id, rating * CAST(verified_purchase AS INTEGER) AS rating_verified_interaction,
        {r('votes / (length(review_text) + 1)')} AS votes_per_length FROM trev""")
oracle("label_encode", "prod", """
    WITH c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM
            (SELECT category AS label FROM prod UNION SELECT 'unknown')),
        s AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM
            (SELECT subcategory AS label FROM prod UNION SELECT 'unknown'))
    SELECT product_id, c.code AS category_encoded, s.code AS subcategory_encoded
    FROM prod JOIN c ON c.label = category JOIN s ON s.label = subcategory""")
oracle("standard_scale", "rev", f"""
    SELECT user_id, product_id,
        {r('(rating - (SELECT avg(rating) FROM rev)) / (SELECT stddev_pop(rating) FROM rev)')} AS rating_scaled,
        {r('(votes - (SELECT avg(votes) FROM rev)) / (SELECT stddev_pop(votes) FROM rev)')} AS votes_scaled FROM rev""")
oracle("minmax_scale", "rev", f"""
    SELECT user_id, product_id,
        {r('(rating - (SELECT min(rating) FROM rev)) / (SELECT max(rating) - min(rating) FROM rev)')} AS rating_normalized,
        {r('(votes - (SELECT min(votes) FROM rev)) / (SELECT max(votes) - min(votes) FROM rev)')} AS votes_normalized
    FROM rev""")
oracle("normalize_ratings", "rev", f"""
    SELECT user_id, product_id, {r('(rating - lo) / (hi - lo + 1e-10)')} AS normalized_rating
    FROM rev, (SELECT min(rating) AS lo, max(rating) AS hi FROM rev)""")
oracle("vector_normalize", "vec", f"""
    WITH x AS (SELECT item_id, sqrt(list_dot_product(features, features)) AS n, unnest(features) AS v,
            generate_subscripts(features, 1) AS pos FROM vec)
    SELECT item_id, CAST(pos - 1 AS INTEGER) AS pos, {r('CASE WHEN n > 0 THEN v / n ELSE v END')} AS value FROM x""")
oracle("cosine_similarity", "vec", f"""
    SELECT a.item_id, {r('list_cosine_similarity(a.features, b.features)')} AS similarity
    FROM vec a JOIN vec b ON b.item_id = a.item_id + 1""")
oracle("feedback_to_rating", "fb", f"""
    SELECT event_id, {r('''CASE WHEN event_type IN ('click', 'purchase') THEN 1.0 WHEN event_type = 'rating' THEN rating / 5.0
        WHEN event_type = 'view_time' THEN least(view_time_seconds / 300.0, 1.0) ELSE 0.0 END''')} AS target_rating,
        CASE event_type WHEN 'click' THEN 0.5::DOUBLE WHEN 'view_time' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS target_weight
    FROM fb""")
oracle("event_weights", "ev", """
    SELECT user_id, round(sum(w), 6) AS weight, count(w) AS events FROM
        (SELECT user_id, CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN 0.5::DOUBLE
            WHEN 'purchase' THEN 5.0::DOUBLE WHEN 'add_to_cart' THEN 2.0::DOUBLE WHEN 'rate' THEN 3.0::DOUBLE END AS w FROM ev)
    GROUP BY 1""")
oracle("ncf_score_rescale", "rk", f"""
    WITH x AS (SELECT *, max(abs(score)) OVER (PARTITION BY user_id) AS top, min(score) OVER (PARTITION BY user_id) AS low
            FROM rk WHERE model = 'ncf'),
        y AS (SELECT *, CASE WHEN top < 0.1 THEN score * 10000.0::DOUBLE ELSE score END AS s FROM x)
    SELECT user_id, item_id, {r('CASE WHEN low < 0 THEN 1 / (1 + exp(-s)) ELSE s END')} AS score FROM y""")
oracle("rank_to_score", "lg", f"SELECT user_id, item_id, {r('1.0 - 0.01::DOUBLE * (rank - 1)')} AS score FROM lg WHERE rank <= 10")
oracle("activity_level", "ev", """
    SELECT user_id, count(DISTINCT product_id) AS products, CASE WHEN count(DISTINCT product_id) > 20 THEN 'high'
        WHEN count(DISTINCT product_id) > 5 THEN 'medium' ELSE 'low' END AS activity_level FROM ev GROUP BY 1""")
oracle("score_threshold", "lg", f"""
    SELECT user_id, item_id, {r('score')} AS score, rank FROM lg WHERE rank <= 10 AND score >= 0.01""")
oracle("parse_json_payload", "", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
oracle("format_ranking_text", "ev usr", """
    SELECT event_id, 'User: ' || coalesce(username, 'User ' || ev.user_id) || ' Context: source: ' || event_type
        || ' Item: Product ' || product_id AS ranking_text FROM ev LEFT JOIN usr ON usr.user_id = ev.user_id""")
# Words longer than one letter; the stop words of this query, which the Spark side is given too.
STOP_WORDS = ["and", "are", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
oracle("tfidf_features", "", f"""
    WITH words AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}'),
            lambda w: NOT list_contains([{_STOP}], w)) AS w FROM documents),
        grams AS (SELECT doc_id, unnest(w) AS term FROM words
            UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
        n AS (SELECT count(*) AS n FROM documents),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        w AS (SELECT doc_id, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n
            WHERE df >= 0.01::DOUBLE * n AND df <= 0.85::DOUBLE * n)
    SELECT doc_id, term, {r('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM w""")

_CODES = """(SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT {c} AS label FROM prod WHERE product_id % 2 = 0
    UNION SELECT 'unknown'))"""
oracle("feature_pipeline", "prod", f"""
    WITH a AS {_CODES.format(c='category')}, b AS {_CODES.format(c='subcategory')},
        f AS (SELECT avg(price) AS m, stddev_pop(price) AS s, min(price) AS lo, max(price) AS hi FROM prod WHERE product_id % 2 = 0)
    SELECT product_id, coalesce(a.code, (SELECT code FROM a WHERE label = 'unknown')) AS category_encoded,
        coalesce(b.code, (SELECT code FROM b WHERE label = 'unknown')) AS subcategory_encoded,
        {r('(price - m) / s')} AS price_scaled, {r('(price - lo) / (hi - lo)')} AS price_normalized
    FROM prod LEFT JOIN a ON a.label = prod.category LEFT JOIN b ON b.label = prod.subcategory, f""")
oracle("feature_pipeline_texts", "prod", f"""
    WITH words AS (SELECT product_id, list_filter(regexp_extract_all(lower(title), '[\\pL\\pN_]{{2,}}'),
            lambda w: NOT list_contains([{_STOP}], w)) AS w FROM prod),
        grams AS (SELECT product_id, unnest(w) AS term FROM words
            UNION ALL SELECT product_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
        tf AS (SELECT product_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
        n AS (SELECT count(*) AS n FROM prod WHERE product_id % 2 = 0),
        df AS (SELECT term, count(*) AS df FROM tf WHERE product_id % 2 = 0 GROUP BY 1),
        w AS (SELECT product_id, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n
            WHERE df >= 0.002::DOUBLE * n AND df <= 0.85::DOUBLE * n)
    SELECT product_id, term, {r('w / sqrt(sum(w * w) OVER (PARTITION BY product_id))')} AS weight FROM w""")
oracle("preprocess", "raw", f"""
    WITH c AS (SELECT reviewer_id AS user_id, asin AS product_id, try_cast(overall AS DOUBLE) AS rating FROM raw
            WHERE reviewer_id IS NOT NULL AND asin IS NOT NULL AND try_cast(overall AS DOUBLE) IS NOT NULL),
        k AS (SELECT * FROM c WHERE user_id IN (SELECT user_id FROM c GROUP BY 1 HAVING count(*) >= 20)
            AND product_id IN (SELECT product_id FROM c GROUP BY 1 HAVING count(*) >= 15)),
        u AS (SELECT *, {uniform('user_id', 'product_id', 'rating')} AS u FROM k)
    SELECT CASE WHEN u < 0.2::DOUBLE THEN 'test' WHEN u < 0.2::DOUBLE + 0.8::DOUBLE * 0.25::DOUBLE THEN 'validation' ELSE 'train' END AS part,
        user_id, product_id, rating FROM u
    UNION ALL SELECT 'sample', user_id, product_id, rating FROM (SELECT * FROM u ORDER BY u, user_id, product_id, rating LIMIT 100)""")

# ---------------------------------------------------------------- joins

oracle("filter_min_activity", "rev", """
    SELECT user_id, product_id, rating, votes FROM rev
    WHERE user_id IN (SELECT user_id FROM rev GROUP BY 1 HAVING count(*) >= 45)
        AND product_id IN (SELECT product_id FROM rev GROUP BY 1 HAVING count(*) >= 32)""")
oracle("map_ids", "ev rp", """
    WITH u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM ev)),
        i AS (SELECT product_id, row_number() OVER (ORDER BY product_id) - 1 AS item_idx FROM (SELECT DISTINCT product_id FROM ev))
    SELECT user_idx, item_idx, rating FROM rp JOIN u ON u.user_id = rp.user_id JOIN i ON i.product_id = rp.item_id""")
oracle("exclude_seen", "rp viewed", """
    SELECT * FROM rp WHERE NOT EXISTS
        (SELECT 1 FROM viewed v WHERE v.user_id = rp.user_id AND v.item_id = rp.item_id)""")
oracle("sample_negatives", "neg_unseen", f"""
    WITH s AS (SELECT user_id, any_value(unseen) AS unseen FROM neg_unseen GROUP BY 1),
        k AS (SELECT user_id, unseen, k, {uniform('user_id', 'k')} AS u FROM s, range(0, 4) t(k)),
        w AS (SELECT user_id, k, least(CAST(floor(CASE WHEN unseen >= 4 THEN (k + u) * unseen / 4 ELSE u * unseen END)
            AS BIGINT), unseen - 1) AS nth FROM k)
    SELECT w.user_id, item_id, w.k AS draw_id FROM w JOIN neg_unseen x ON x.user_id = w.user_id AND x.nth = w.nth""")
oracle("sample_negatives_per_row", "neg_unseen", f"""
    WITH i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM rp)),
        s AS (SELECT user_id, any_value(unseen) AS unseen FROM neg_unseen GROUP BY 1),
        w AS (SELECT rp.user_id, i.idx, least(CAST(floor({uniform('rp.user_id', 'rp.item_id', '0')} * unseen) AS BIGINT),
            unseen - 1) AS nth FROM rp JOIN s ON s.user_id = rp.user_id JOIN i ON i.item_id = rp.item_id)
    SELECT w.user_id, x.item_id, w.idx AS draw_id FROM w JOIN neg_unseen x ON x.user_id = w.user_id AND x.nth = w.nth""")
oracle("cooccurrence_feedback", "sev", """
    WITH f AS (SELECT user_id, product_id, min(event_id) AS first FROM sev GROUP BY 1, 2),
        p AS (SELECT a.user_id, a.product_id AS product_id, b.product_id AS related_id, greatest(a.first, b.first) AS since
            FROM f a JOIN f b ON a.user_id = b.user_id AND a.product_id <> b.product_id)
    SELECT p.product_id, p.related_id, CAST(sum(CASE WHEN e.session_id IS NOT NULL THEN 2 ELSE 1 END) AS DOUBLE) AS score
    FROM p JOIN sev e ON e.user_id = p.user_id AND e.event_id >= p.since GROUP BY 1, 2""")
oracle("cooccurrence_realtime", "sev", """
    WITH f AS (SELECT user_id, product_id, min(event_id) AS first FROM sev GROUP BY 1, 2),
        g AS (SELECT e.product_id AS a, f.product_id AS b FROM sev e
            JOIN f ON f.user_id = e.user_id AND f.first <= e.event_id AND f.product_id <> e.product_id
            WHERE e.session_id IS NOT NULL),
        h AS (SELECT a, b FROM g UNION ALL SELECT b, a FROM g)
    SELECT a AS product_id, b AS related_id, CAST(count(*) AS DOUBLE) AS score FROM h GROUP BY 1, 2""")
oracle("suffix_weight_sum", "sev", """
    SELECT event_id, user_id, CAST(sum(CASE WHEN session_id IS NOT NULL THEN 2 ELSE 1 END) OVER (PARTITION BY user_id
        ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS suffix_weight FROM sev""")
oracle("score_all_pairs", "vec", f"""
    SELECT a.item_id AS user_id, b.item_id, {r('list_dot_product(a.features, b.features)')} AS score FROM vec a, vec b""")
oracle("score_pairs", "ev vec", f"""
    SELECT event_id, {r('list_dot_product(a.features, b.features)')} AS score FROM ev
    JOIN vec a ON a.item_id = ev.user_id JOIN vec b ON b.item_id = ev.product_id""")
oracle("attach_verified_counts", "rev", """
    SELECT product_id, count(*) AS reviews, count(*) FILTER (verified_purchase) AS verified_purchase_count
    FROM rev GROUP BY 1""")
oracle("pairwise_jaccard", "lg", f"""
    WITH t AS (SELECT user_id, list(item_id) AS l FROM lg WHERE rank <= 10 GROUP BY 1),
        p AS (SELECT a.user_id AS user_a, b.user_id AS user_b, len(list_intersect(a.l, b.l)) AS c, len(a.l) + len(b.l) AS s
            FROM t a JOIN t b ON a.user_id < b.user_id)
    SELECT user_a, user_b, {r('c / (s - c)')} AS jaccard FROM p WHERE c > 0""")
_MODEL_PAIRS = """
    t AS (SELECT user_id, model, list(item_id) AS l FROM lst GROUP BY 1, 2),
    p AS (SELECT a.user_id, a.model AS model_a, b.model AS model_b, len(list_intersect(a.l, b.l)) AS c,
            len(a.l) + len(b.l) AS s FROM t a JOIN t b ON a.user_id = b.user_id AND a.model < b.model)"""
oracle("pairwise_jaccard_models", "lst", f"WITH {_MODEL_PAIRS} SELECT user_id, model_a, model_b, {r('c / (s - c)')} AS jaccard FROM p")
oracle("attribute_feedback", "att", f"SELECT event_id, model, event_type, {r('model_score')} AS model_score FROM att")
oracle("entity_join", "rev prod", f"""
    SELECT category, subcategory, count(*) AS reviews, {r('avg(rating)')} AS rating
    FROM rev JOIN prod ON prod.product_id = rev.product_id GROUP BY 1, 2""")

# ---------------------------------------------------------------- aggregations


def _review_stats(key: str, extra: str = "") -> str:
    return f"""SELECT {key}, {r('avg(rating)')} AS rating_mean, {r('median(rating)')} AS rating_median,
        {r('stddev_samp(rating)')} AS rating_std, count(rating) AS rating_count, CAST(sum(votes) AS BIGINT) AS votes_sum,
        {r('avg(votes)')} AS votes_mean, max(votes) AS votes_max,
        count(*) FILTER (verified_purchase) AS verified_purchase_count,
        {r('count(*) FILTER (verified_purchase) / count(rating)')} AS verified_purchase_ratio{extra}
        FROM rev GROUP BY 1"""


oracle("product_features", "rev", _review_stats("product_id"))
oracle("user_features", "rev", _review_stats("user_id", f", {r('avg(rating) - (SELECT avg(rating) FROM rev)')} AS rating_bias"))
oracle("user_item_ratings", "rev", "SELECT user_id, product_id, rating FROM rev")
oracle("item_popularity", "ev", "SELECT product_id, count(*) AS view_count FROM ev WHERE event_type = 'view' GROUP BY 1")
oracle("user_activity", "ev", """
    SELECT user_id, count(*) AS event_count, count(*) FILTER (event_type = 'purchase') AS purchase_count FROM ev GROUP BY 1""")
_COLS = ("doc_id", "lang", "source", "n_chars", "quality", "toxic")
oracle("missing_values", "docl", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {r(f'count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*)')} AS missing_pct FROM docl" for c in _COLS))
_DUP = "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_count, {pct} AS duplicate_percentage FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})"
_PCT = r("sum(n - 1) * 100.0::DOUBLE / sum(n)")
oracle("duplicate_rows", "rev", _DUP.format(pct=_PCT, t="rev", k="user_id, product_id"))
oracle("duplicate_rows_all", "", _DUP.format(pct=_PCT, t="documents", k="text, lang, source, n_chars"))


def _numeric(c: str) -> str:
    z = f"abs(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_samp({c}) FROM lineitem)) > 3"
    return f"""SELECT '{c}' AS column_name, {r(f'min({c})', 4)} AS min, {r(f'max({c})', 4)} AS max, {r(f'avg({c})', 4)} AS mean,
        {r(f'median({c})', 4)} AS median, {r(f'stddev_samp({c})', 4)} AS std, count(*) FILTER ({c} = 0) AS zeros_count,
        {r(f'count(*) FILTER ({c} = 0) * 100.0::DOUBLE / count(*)', 4)} AS zeros_percentage, count(*) FILTER ({c} < 0) AS negative_count,
        {r(f'count(*) FILTER ({c} < 0) * 100.0::DOUBLE / count(*)', 4)} AS negative_percentage,
        count(*) FILTER ({z}) AS outliers_count, {r(f'count(*) FILTER ({z}) * 100.0::DOUBLE / count(*)', 4)} AS outliers_percentage
        FROM lineitem"""


oracle("numeric_profile", "", " UNION ALL ".join(_numeric(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")))


def _categorical(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count(*) AS unique_count, {r('count(*) * 100.0::DOUBLE / sum(n)')} AS unique_percentage,
        (SELECT {c} FROM documents WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top_value,
        max(n) AS top_value_count, {r('max(n) * 100.0::DOUBLE / sum(n)')} AS top_value_percentage,
        CAST(coalesce(sum(n) FILTER (v = ''), 0) AS BIGINT) AS empty_count, count(*) = 1 AS single_value,
        (count(*) = sum(n) AND sum(n) > 10) AS all_unique
        FROM (SELECT {c} AS v, count(*) AS n FROM documents GROUP BY 1)"""


oracle("categorical_profile", "", " UNION ALL ".join(_categorical(c) for c in ("lang", "source", "text")))
_CHECKS = {
    "invalid_rating": "rating < 1 OR rating > 5",
    "future_date": "review_date > TIMESTAMP '2000-01-01'",
    "empty_user_id": "user_id IS NULL",
    "empty_product_id": "product_id IS NULL",
}
_CONS = ", ".join(
    f"count(*) FILTER ({c}) AS {n}_count, {r(f'count(*) FILTER ({c}) * 100.0::DOUBLE / count(*)')} AS {n}_percentage" for n, c in _CHECKS.items())
oracle("consistency_check", "rev", f"SELECT {_CONS} FROM rev")
oracle("invalid_ratings", "", "SELECT DISTINCT l_quantity AS rating FROM lineitem WHERE l_quantity < 1 OR l_quantity > 5")
oracle("relationship_check", "trev", f"""
    WITH m AS (SELECT avg(length(review_text)) FILTER (rating = 1) AS lo, avg(length(review_text)) FILTER (rating = 5) AS hi,
        avg(rating) FILTER (verified_purchase) AS v, avg(rating) FILTER (NOT verified_purchase) AS u FROM trev)
    SELECT {r('lo')} AS low_rating_length, {r('hi')} AS high_rating_length, {r('v')} AS verified_mean, {r('u')} AS unverified_mean,
        {r('lo / hi')} AS length_ratio, {r('v - u')} AS difference, abs(v - u) > 0.5 AS large_difference FROM m""")
oracle("temporal_profile", "rev", f"""
    WITH m AS (SELECT date_trunc('month', review_date) AS mo, count(*) AS n, min(review_date) AS lo, max(review_date) AS hi
        FROM rev GROUP BY 1)
    SELECT strftime(min(lo), '%Y-%m-%d') AS min_date, strftime(max(hi), '%Y-%m-%d') AS max_date,
        CAST(floor((epoch(max(hi)) - epoch(min(lo))) / 86400) AS BIGINT) AS days, count(*) AS months_count,
        {r('avg(n)')} AS mean_monthly, max(n) AS max_monthly, min(n) AS min_monthly, {r('max(n) / avg(n)')} AS spike_ratio,
        max(n) / avg(n) > 3 AS has_spikes FROM m""")
oracle("quality_summary", "docl rev", """
    WITH h AS (SELECT count(*) FILTER (p > 0) AS w, count(*) FILTER (p > 20) AS h FROM (""" + " UNION ALL ".join(
    f"SELECT count(*) FILTER ({c} IS NULL) * 100.0 / count(*) AS p FROM docl" for c in _COLS) + """)),
        d AS (SELECT sum(n - 1) * 100.0 / sum(n) > 5 AS d FROM (SELECT count(*) AS n FROM rev GROUP BY user_id, product_id)),
        f AS (SELECT count(*) FILTER (rating < 1 OR rating > 5) > 0 AS a, count(*) FILTER (review_date > TIMESTAMP '2000-01-01') > 0 AS b,
            count(*) FILTER (user_id IS NULL OR product_id IS NULL) > 0 AS c FROM rev),
        i AS (SELECT w, h, h + d::INT + a::INT + b::INT + c::INT AS issues FROM h, d, f)
    SELECT w AS columns_with_missing, h AS columns_high_missing, issues AS issues_count,
        CASE WHEN issues = 0 THEN 'Excellent' WHEN issues <= 2 THEN 'Good' WHEN issues <= 5 THEN 'Fair' ELSE 'Poor' END AS quality_level
    FROM i""")
_EVENT_COUNTS = """count(*) FILTER (event_type = 'view') AS view_count, count(*) FILTER (event_type = 'purchase') AS purchase_count,
        count(*) FILTER (event_type = 'rating') AS rating_count,
        coalesce(round(avg(rating) FILTER (event_type = 'rating'), 6), 0.0::DOUBLE) AS avg_rating"""
_PRODUCT_EVENTS = f"""SELECT product_id, {_EVENT_COUNTS}, round(count(*) FILTER (event_type = 'view')
        + 10 * count(*) FILTER (event_type = 'purchase') + 5 * coalesce(sum(rating) FILTER (event_type = 'rating'), 0), 6) AS popularity
        FROM ev GROUP BY 1"""
oracle("product_event_features", "ev", _PRODUCT_EVENTS)


def _recent(kind: str, n: int) -> str:
    """Lists event by event: a product that is not listed enters in front, the last one falls off."""
    return f"""(WITH RECURSIVE e AS (SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k
            FROM ev WHERE event_type = '{kind}'),
        l AS (SELECT DISTINCT user_id, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS items FROM e
            UNION ALL SELECT l.user_id, e.k, CASE WHEN list_contains(items, product_id) THEN items ELSE list_slice(list_prepend(product_id, items), 1, {n}) END
            FROM l JOIN e ON e.user_id = l.user_id AND e.k = l.k + 1)
        SELECT user_id, array_to_string(items, ',') AS l FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1)"""


oracle("user_event_features", "ev", f"""
    WITH c AS (SELECT user_id, {_EVENT_COUNTS}, strftime(max(ts), {TS}) AS last_active FROM ev GROUP BY 1)
    SELECT c.*, coalesce(v.l, '') AS recent_views, coalesce(p.l, '') AS purchased_products
    FROM c LEFT JOIN {_recent('view', 20)} v ON v.user_id = c.user_id
        LEFT JOIN {_recent('purchase', 50)} p ON p.user_id = c.user_id""")
oracle("event_type_metrics", "ev", """
    SELECT 'feature_events_' || event_type AS metric_name, CAST(count(*) AS DOUBLE) AS metric_value FROM ev GROUP BY 1""")
oracle("feedback_stats", "ev", """
    SELECT 'total' AS section, 'users_count' AS key, count(DISTINCT user_id) AS value FROM ev
    UNION ALL SELECT 'total', 'products_count', count(DISTINCT product_id) FROM ev WHERE event_type = 'view'
    UNION ALL SELECT 'total', 'total_events', count(*) FROM ev
    UNION ALL SELECT 'event_type', event_type, count(*) FROM ev GROUP BY event_type
    UNION ALL (SELECT 'top_product', CAST(product_id AS VARCHAR), count(*) AS n FROM ev WHERE event_type = 'view'
        GROUP BY product_id ORDER BY n DESC, product_id LIMIT 10)
    UNION ALL (SELECT 'top_user', CAST(user_id AS VARCHAR), count(DISTINCT product_id) AS n FROM ev
        GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10)""")
oracle("evaluate_rating_error", "lg rtev", f"""
    WITH b AS (SELECT min(rating) AS lo, max(rating) AS hi FROM rtev),
        e AS (SELECT score * (hi - lo) + lo - rating AS e FROM lg JOIN rtev USING (user_id, item_id), b)
    SELECT {r('sqrt(avg(e * e))')} AS rmse, {r('avg(abs(e))')} AS mae, count(*) AS num_test_instances FROM e""")
oracle("evaluate_topk", "lg rtev", f"""
    WITH rel AS (SELECT user_id, item_id FROM rtev WHERE rating >= 4),
        k AS (SELECT unnest([5, 10, 20]) AS k),
        u AS (SELECT k, lg.user_id, count(*) AS listed, count(rel.item_id) AS hits,
                (SELECT count(*) FROM rel q WHERE q.user_id = lg.user_id) AS total
            FROM k JOIN lg ON lg.rank <= k.k LEFT JOIN rel ON rel.user_id = lg.user_id AND rel.item_id = lg.item_id GROUP BY 1, 2)
    SELECT k, {r('avg(hits / listed)')} AS precision, {r('avg(hits / total)')} AS recall, count(*) AS users
    FROM u WHERE total > 0 GROUP BY 1""")
oracle("precision_recall_ndcg", "lg rtev", f"""
    WITH rel AS (SELECT user_id, item_id FROM rtev WHERE rating >= 4),
        u AS (SELECT lg.user_id, count(*) AS listed, count(rel.item_id) AS hits,
                coalesce(sum(1 / log2(rank + 1)) FILTER (rel.item_id IS NOT NULL), 0) AS dcg,
                (SELECT count(*) FROM rel q WHERE q.user_id = lg.user_id) AS total
            FROM lg LEFT JOIN rel ON rel.user_id = lg.user_id AND rel.item_id = lg.item_id WHERE rank <= 10 GROUP BY 1),
        b AS (SELECT *, (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= total) AS best FROM u)
    SELECT user_id, {r('hits / listed')} AS precision, {r('CASE WHEN total > 0 THEN hits / total ELSE 0 END')} AS recall,
        {r('CASE WHEN total > 0 THEN dcg / best ELSE 0 END')} AS ndcg FROM b""")
oracle("recs_diversity_coverage", "lg cat", f"""
    SELECT count(DISTINCT item_id) AS unique_items, count(*) AS total, {r('count(DISTINCT item_id) / count(*)')} AS diversity,
        {r('count(DISTINCT item_id) / (SELECT count(DISTINCT item_id) FROM cat)')} AS coverage FROM lg WHERE rank <= 10""")
oracle("personalization", "lg", f"""
    WITH t AS (SELECT user_id, list(item_id) AS l FROM lg WHERE rank <= 10 GROUP BY 1),
        p AS (SELECT len(list_intersect(a.l, b.l)) AS c, len(a.l) + len(b.l) AS s FROM t a JOIN t b ON a.user_id < b.user_id)
    SELECT (SELECT count(*) FROM t) AS users, {r('1 - avg(c / (s - c))')} AS personalization FROM p""")
_DIST = """c AS (SELECT model, item_id, count(*) AS c FROM lst GROUP BY 1, 2),
    q AS (SELECT *, sum(c) OVER (PARTITION BY model ORDER BY c, item_id ROWS UNBOUNDED PRECEDING) AS cum,
            row_number() OVER (PARTITION BY model ORDER BY c DESC, item_id) AS k FROM c)"""
oracle("recs_distribution", "lst", f"""
    WITH {_DIST}
    SELECT model, count(*) AS unique_items, CAST(sum(c) AS BIGINT) AS total, {r('count(*) / sum(c)')} AS coverage,
        {r('1 - 2 * sum(cum - c) / sum(c) / count(*)')} AS gini, {r('sum(c) FILTER (k <= 10) / sum(c)')} AS top10_share
    FROM q GROUP BY 1""")
oracle("ab_readiness", "lst", f"""
    WITH {_MODEL_PAIRS}, {_DIST},
        j AS (SELECT avg(c / (s - c)) AS j FROM p GROUP BY model_a, model_b),
        g AS (SELECT 1 - 2 * sum(cum - c) / sum(c) / count(*) AS g FROM q GROUP BY model),
        x AS (SELECT (SELECT bool_and(g < 0.7) FROM g) AS d, (SELECT bool_and(j < 0.8) FROM j) AS m)
    SELECT d AS sufficient_diversity, m AS models_differ, d AND m AS supports_ab_testing FROM x""")
oracle("model_metric_average", "ms", f"""
    WITH m AS (SELECT model, avg(score) AS a, max(score) AS b FROM ms GROUP BY 1)
    SELECT 'mean_score' AS metric_name, {r('avg(a)')} AS value FROM m UNION ALL SELECT 'best_score', {r('avg(b)')} FROM m""")
oracle("linucb_fit", "log", f"""
    SELECT arm, CAST(pos - 1 AS INTEGER) AS pos, {r('sum(x * reward)')} AS reward_sum, 0.0::DOUBLE AS residual
    FROM (SELECT arm, reward, unnest(context[1:10])::DOUBLE AS x, generate_subscripts(context[1:10], 1) AS pos FROM log) GROUP BY 1, 2""")
oracle("linucb_select", "log", f"""
    WITH x AS (SELECT arm, unnest(context) AS v, generate_subscripts(context, 1) AS pos FROM log),
        t AS (SELECT arm, list(m ORDER BY pos) AS theta FROM (SELECT arm, pos, avg(v) AS m FROM x GROUP BY 1, 2) GROUP BY 1),
        n AS (SELECT arm, count(*) AS n FROM log GROUP BY 1),
        u AS (SELECT item_id, t.arm, list_dot_product(theta, context) + 0.1 * sqrt(list_dot_product(context, context) / n) AS ucb
            FROM log, t JOIN n ON n.arm = t.arm)
    SELECT item_id, arm, {r('ucb')} AS ucb FROM u QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ucb DESC, arm) = 1""")
ORACLES["stream_linucb"] = ORACLES["linucb_fit"]
oracle("linucb_select_fitted", "log", f"""
    WITH x AS (SELECT arm, reward::DOUBLE AS y, context[1]::DOUBLE AS p, context[2]::DOUBLE AS q FROM log),
        m AS (SELECT arm, 1 + sum(p * p) AS a, sum(p * q) AS b, 1 + sum(q * q) AS d, sum(p * y) AS u, sum(q * y) AS v FROM x GROUP BY arm),
        i AS (SELECT arm, d / (a * d - b * b) AS a, -b / (a * d - b * b) AS b, a / (a * d - b * b) AS d, u, v FROM m),
        c AS (SELECT item_id, context[1] AS p, context[2] AS q FROM log),
        s AS (SELECT item_id, arm, (a * u + b * v) * p + (b * u + d * v) * q
            + 0.1::DOUBLE * sqrt(a * p * p + 2 * b * p * q + d * q * q) AS ucb FROM c, i)
    SELECT item_id, arm, {r('ucb')} AS ucb FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ucb DESC, arm) = 1""")
oracle("arm_stats", "log", f"""
    SELECT arm, count(*) AS num_pulls, {r('avg(reward)')} AS avg_reward,
        {r("CASE WHEN count(*) > 1 THEN 1.96 * stddev_pop(reward) / sqrt(count(*)) ELSE 'inf'::DOUBLE END")} AS confidence
    FROM log GROUP BY 1""")
_OLD = "CASE model WHEN 'lightgcn' THEN 0.5::DOUBLE WHEN 'content_based' THEN 0.2::DOUBLE WHEN 'mf' THEN 0.2::DOUBLE WHEN 'ncf' THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END"
oracle("model_success_weights", "att", f"""
    WITH m AS (SELECT model, count(*) AS n, 0.3 * count(*) FILTER (event_type = 'click') / count(*)
            + 0.5 * count(*) FILTER (event_type = 'purchase') / count(*)
            + 0.2 * coalesce(avg(value) FILTER (event_type = 'rating'), 0) / 5 AS s
        FROM att WHERE event_type IN ('click', 'purchase', 'rating', 'view_time') GROUP BY 1)
    SELECT model, n AS feedback, {r('s')} AS success,
        {r(f'CASE WHEN n >= 100 THEN greatest(0.1, least(1.0, 0.8 * {_OLD} + 0.2 * s)) ELSE {_OLD} END')} AS weight FROM m""")
_FOLD = f"""WITH RECURSIVE st AS (SELECT user_id, model, row_number() OVER (PARTITION BY user_id, model ORDER BY event_id) AS k,
            CASE event_type WHEN 'click' THEN 0.01::DOUBLE WHEN 'purchase' THEN 0.03::DOUBLE ELSE 0.02 * (value - 3) / 2 END AS d
        FROM att WHERE event_type IN ('click', 'purchase', 'rating')),
        w AS (SELECT user_id, model, 0::BIGINT AS k, {_OLD} AS weight FROM (SELECT DISTINCT user_id, model FROM st)
            UNION ALL SELECT w.user_id, w.model, st.k, least(1.0::DOUBLE, greatest(0.1::DOUBLE, w.weight + st.d))
            FROM w JOIN st ON st.user_id = w.user_id AND st.model = w.model AND st.k = w.k + 1)
    SELECT user_id, model, {r('weight')} AS weight FROM w QUALIFY row_number() OVER (PARTITION BY user_id, model ORDER BY k DESC) = 1"""
oracle("user_model_weights", "att", _FOLD)

# ---------------------------------------------------------------- windows, limits, samples

oracle("top_n_per_user", "lg", f"SELECT user_id, item_id, {r('score')} AS score, rank FROM lg WHERE rank <= 10")
oracle("top_popular", "pop", "SELECT item_id, view_count, rank FROM pop WHERE rank <= 20")
_FPOP = "SELECT item_id, list_sum(features) AS s, row_number() OVER (ORDER BY list_sum(features) DESC, item_id) AS rank FROM vec"
oracle("factor_popularity", "vec", f"SELECT item_id, {r('s')} AS popularity, rank FROM ({_FPOP}) WHERE rank <= 100")
oracle("popularity_by_demographic", "poploc", "SELECT * FROM poploc WHERE rank <= 20")
oracle("popularity_by_category", "popcat", "SELECT * FROM popcat WHERE rank <= 1000")
oracle("latest_per_key", "ev", f"""
    SELECT user_id, event_type, event_id, product_id FROM
        (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
    WHERE {NOW} - ts <= INTERVAL 10 DAY""")
oracle("sample_rows", "prod", f"""
    SELECT product_id, title FROM prod ORDER BY {uniform('product_id', 'title')}, product_id LIMIT 100""")
oracle("split_train_val_test", "prod", f"""
    SELECT product_id, CASE WHEN u < 0.2::DOUBLE THEN 'test' WHEN u < 0.2::DOUBLE + 0.8::DOUBLE * 0.25::DOUBLE THEN 'validation'
        ELSE 'train' END AS split FROM (SELECT product_id, {uniform('product_id', 'title')} AS u FROM prod)""")

oracle("split_parts", "prod", f"""
    WITH u AS (SELECT product_id, title, {uniform('product_id', 'title')} AS u FROM prod)
    SELECT CASE WHEN u < 0.2::DOUBLE THEN 'test' WHEN u < 0.2::DOUBLE + 0.8::DOUBLE * 0.25::DOUBLE THEN 'validation' ELSE 'train' END AS part,
        product_id, title FROM u
    UNION ALL SELECT 'sample', product_id, title FROM (SELECT * FROM u ORDER BY u, product_id LIMIT 100)""")

# ---------------------------------------------------------------- set operations

oracle("fill_from_popular", "rk pop viewed", """
    WITH own AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
            FROM ms WHERE model = 'content_based' AND score > 0.15),
        own5 AS (SELECT * FROM own WHERE rank <= 5),
        more AS (SELECT u.user_id, p.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY p.rank) AS k, u.n
            FROM (SELECT user_id, count(*) AS n FROM own5 GROUP BY 1) u, pop p WHERE p.rank <= 40
                AND NOT EXISTS (SELECT 1 FROM viewed v WHERE v.user_id = u.user_id AND v.item_id = p.item_id)
                AND NOT EXISTS (SELECT 1 FROM own5 o WHERE o.user_id = u.user_id AND o.item_id = p.item_id))
    SELECT user_id, item_id, CAST(rank AS INTEGER) AS rank FROM own5
    UNION ALL SELECT user_id, item_id, CAST(n + k AS INTEGER) FROM more WHERE n + k <= 15""")
oracle("merge_popular", "pop vec", f"""
    WITH f AS ({_FPOP}), a AS (SELECT item_id, 0 AS s, rank FROM pop WHERE rank <= 20),
        b AS (SELECT item_id, 1 AS s, rank FROM f WHERE rank <= 100 AND item_id NOT IN (SELECT item_id FROM a)),
        c AS (SELECT item_id, row_number() OVER (ORDER BY s, rank) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
    SELECT item_id, rank FROM c WHERE rank <= 40""")
oracle("append_rows", "neg_unseen", f"""
    WITH s AS (SELECT user_id, any_value(unseen) AS unseen FROM neg_unseen GROUP BY 1),
        k AS (SELECT user_id, unseen, k, {uniform('user_id', 'k')} AS u FROM s, range(0, 4) t(k)),
        w AS (SELECT user_id, least(CAST(floor(CASE WHEN unseen >= 4 THEN (k + u) * unseen / 4 ELSE u * unseen END)
            AS BIGINT), unseen - 1) AS nth FROM k)
    SELECT user_id, item_id, CAST(rating AS DOUBLE) AS rating FROM rp
    UNION ALL SELECT w.user_id, item_id, 0.0::DOUBLE FROM w JOIN neg_unseen x ON x.user_id = w.user_id AND x.nth = w.nth""")
oracle("hits", "lg rtev", """
    SELECT user_id, item_id, rank FROM lg WHERE rank <= 10 AND EXISTS
        (SELECT 1 FROM rtev t WHERE t.user_id = lg.user_id AND t.item_id = lg.item_id AND t.rating >= 4)""")
oracle("unseen_items", "ev", """
    SELECT u.user_id, i.product_id AS item_id FROM (SELECT DISTINCT user_id FROM ev) u, (SELECT DISTINCT product_id FROM ev) i
    WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_id = u.user_id AND ev.product_id = i.product_id)""")

# ---------------------------------------------------------------- models

oracle("mf_fit", "lg", "SELECT user_id, count(*) AS ratings, true AS solved FROM lg GROUP BY user_id")
oracle("mf_update", "lg", """
    SELECT user_id, count(*) AS ratings, true AS solved FROM lg
    WHERE user_id IN (SELECT user_id FROM lg WHERE (user_id + item_id) % 10 = 0) GROUP BY user_id""")
oracle("graph_normalize", "edge", f"SELECT src, dst, {r('weight')} AS weight FROM edge")
oracle("graph_propagate", "edge vec", f"""
    WITH v0 AS (SELECT 'u:' || item_id AS node, unnest(features) AS v, generate_subscripts(features, 1) AS pos FROM vec
            UNION ALL SELECT 'i:' || item_id, unnest(features), generate_subscripts(features, 1) FROM vec),
        v1 AS (SELECT dst AS node, sum(v * weight) AS v, pos FROM edge JOIN v0 ON v0.node = src GROUP BY dst, pos),
        v2 AS (SELECT dst AS node, sum(v * weight) AS v, pos FROM edge JOIN v1 ON v1.node = src GROUP BY dst, pos),
        a AS (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2)
    SELECT node, CAST(pos - 1 AS INTEGER) AS pos, {r('sum(v) / 3')} AS value FROM a GROUP BY node, pos""")
oracle("content_components", "cat", """
    WITH w AS (SELECT count(DISTINCT ch) AS n FROM (SELECT unnest(string_split(item_id::VARCHAR, '')) AS ch FROM cat)),
        k AS (SELECT unnest(range(0, CASE WHEN 30 > n THEN greatest(1, n - 1) ELSE 30 END))::INTEGER AS i FROM w)
    SELECT x.i AS a, y.i AS b, true AS holds FROM k x JOIN k y ON x.i <= y.i""")
oracle("content_user_profiles", "prof", f"SELECT user_id, CAST(pos AS INTEGER) AS pos, {r('value')} AS value FROM prof")
oracle("content_recommend", "prof", f"""
    WITH p AS (SELECT user_id, list(value ORDER BY pos) AS features FROM prof GROUP BY 1),
        s AS (SELECT user_id, item_id, list_dot_product(p.features, vec.features) AS score FROM p, vec)
    SELECT user_id, item_id, {r('score')} AS score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
    FROM s QUALIFY rank <= 10""")
oracle("similar_products", "vec", f"""
    WITH s AS (SELECT a.item_id, b.item_id AS similar_id, list_dot_product(a.features, b.features) AS score
            FROM vec a JOIN vec b ON a.item_id <> b.item_id)
    SELECT item_id, similar_id, {r('score')} AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, similar_id) AS rank
    FROM s QUALIFY rank <= 10""")
oracle("incremental_feedback_batch", "fb", f"""
    WITH t AS (SELECT unnest(CASE WHEN model_name IS NOT NULL THEN [model_name] ELSE ['lightgcn', 'mf'] END) AS model, user_id, item_id,
            CASE WHEN event_type IN ('click', 'purchase') THEN 1.0::DOUBLE WHEN event_type = 'rating' THEN rating / 5.0
                WHEN event_type = 'view_time' THEN least(view_time_seconds / 300.0, 1.0) ELSE 0.0::DOUBLE END AS a,
            CASE event_type WHEN 'click' THEN 0.5::DOUBLE WHEN 'view_time' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS b FROM fb)
    SELECT model, user_id, item_id, {r('sum(a)')} AS rating, {r('sum(b)')} AS weight FROM t GROUP BY 1, 2, 3""")

# ---------------------------------------------------------------- recommendation stages

oracle("generate_candidates", "usr vec", f"""
    WITH m AS (SELECT list(v ORDER BY pos) AS features FROM (SELECT pos, avg(v) AS v FROM
            (SELECT unnest(features) AS v, generate_subscripts(features, 1) AS pos FROM vec) GROUP BY 1)),
        u AS (SELECT user_id, coalesce(vec.features, m.features) AS features FROM usr LEFT JOIN vec ON vec.item_id = user_id, m),
        s AS (SELECT user_id, item_id, list_cosine_similarity(u.features, vec.features) AS score FROM u, vec)
    SELECT user_id, item_id, {r('score')} AS score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank,
        'candidate_generation' AS stage, 'candidate_generation' AS model FROM s QUALIFY rank <= 100""")
oracle("filter_candidates", "lg cat pop", """
    WITH kept AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
            FROM lg WHERE item_id IN (SELECT item_id FROM cat WHERE price < 905)),
        own AS (SELECT * FROM kept),
        more AS (SELECT u.user_id, p.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY p.rank) AS k,
                (SELECT count(*) FROM own o WHERE o.user_id = u.user_id) AS n
            FROM (SELECT DISTINCT user_id FROM lg) u, pop p WHERE p.rank <= 100
                AND p.item_id IN (SELECT item_id FROM cat WHERE price < 905)
                AND NOT EXISTS (SELECT 1 FROM own o WHERE o.user_id = u.user_id AND o.item_id = p.item_id))
    SELECT user_id, item_id, CAST(rank AS INTEGER) AS rank FROM own
    UNION ALL SELECT user_id, item_id, CAST(n + k AS INTEGER) FROM more WHERE n + k <= 60""")
oracle("rank_candidates", "lg", f"""
    SELECT user_id, item_id, {r('score * (1 + item_id % 7)')} AS score, {r('score')} AS original_score,
        row_number() OVER (PARTITION BY user_id ORDER BY score * (1 + item_id % 7) DESC, item_id) AS rank FROM lg WHERE rank <= 20""")
oracle("rank_text_pairs", "lg", f"""
    WITH t AS (SELECT user_id, item_id, score AS original, length('User: User ' || user_id || ' Item: Product ' || item_id)::DOUBLE AS score FROM lg WHERE rank <= 20)
    SELECT user_id, item_id, score, {r('original')} AS original_score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM t""")
_W = "CASE model WHEN 'lightgcn' THEN 0.5::DOUBLE ELSE 0.5::DOUBLE END"
_ENS = f"""e AS (SELECT user_id, item_id, sum(score * {{f}}{_W} / rank) / count(*) AS score, count(*) AS models FROM lst GROUP BY 1, 2),
    ek AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM e)"""
oracle("ensemble_weighted_rank", "lst", f"WITH {_ENS.format(f='')} SELECT user_id, item_id, {r('score', 12)} AS score, models, rank FROM ek")
_PEN = "CASE WHEN rank > 1 THEN score * (1 - 0.2::DOUBLE / rank) ELSE score END"
oracle("diversity_penalty", "lg", f"""
    WITH d AS (SELECT user_id, item_id, {_PEN} AS score FROM lg WHERE rank <= 20)
    SELECT user_id, item_id, {r('score', 12)} AS score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM d""")
_TOP10 = f"""SELECT user_id, item_id, {r('score')} AS score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
    FROM h QUALIFY rank <= 10"""
oracle("hybrid_weighted_scores", "rk", f"""
    WITH h AS (SELECT user_id, item_id, sum(score * CASE model WHEN 'lightgcn' THEN 0.7::DOUBLE ELSE 1 - 0.7::DOUBLE END) AS score
        FROM rk WHERE model IN ('lightgcn', 'content_based') AND rank <= 20 GROUP BY 1, 2) {_TOP10}""")
oracle("hybrid_rank_blend", "rk", f"""
    WITH h AS (SELECT user_id, item_id, sum(CASE model WHEN 'lightgcn' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * (20 - (rank - 1)) / 20) AS score
        FROM rk WHERE model IN ('lightgcn', 'content_based') AND rank <= 20 GROUP BY 1, 2) {_TOP10}""")
oracle("ensemble_minmax", "rk", f"""
    WITH t AS (SELECT *, min(score) OVER (PARTITION BY user_id, model) AS lo, max(score) OVER (PARTITION BY user_id, model) AS hi
            FROM rk WHERE rank <= 20),
        h AS (SELECT user_id, item_id, sum(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END * {_OLD}) AS score
            FROM t GROUP BY 1, 2) {_TOP10}""")
_POPLIST = """SELECT p.user_id, CASE WHEN EXISTS (SELECT 1 FROM poploc l WHERE l.value = p.user_location)
    THEN (SELECT list(item_id ORDER BY rank) FROM poploc l WHERE l.value = p.user_location AND rank <= {n})
    ELSE (SELECT list(item_id ORDER BY rank) FROM popall WHERE rank <= {n}) END AS l FROM pref p"""


def _listed(source: str) -> str:
    return f"""SELECT user_id, item_id, CAST(rank AS INTEGER) AS rank, {r('1.0 - 0.01::DOUBLE * (rank - 1)')} AS score FROM
        (SELECT user_id, unnest(l) AS item_id, generate_subscripts(l, 1) AS rank FROM ({source}))"""


oracle("cold_start_popularity", "pref poploc popall", _listed(_POPLIST.format(n=10)))
_CATLIST = """SELECT user_id, list_slice(CASE WHEN len(chosen) < {n} THEN list_concat(chosen, list_filter(fill, lambda x: NOT list_contains(chosen, x)))
        ELSE chosen END, 1, {n}) AS l FROM (
    SELECT user_id, chosen, flatten(list_transform(shelves, lambda c: list_slice(c, 1, per))) AS fill
    FROM (SELECT user_id, chosen, shelves, CAST(greatest(1, ({n} - len(chosen)) // len(shelves)) AS BIGINT) AS per
        FROM (SELECT user_id, coalesce((SELECT list(item_id ORDER BY category, rank) FROM popcat
            WHERE list_contains(preferred, category) AND rank <= greatest(1, {n} // len(preferred))), []) AS chosen FROM pref),
        (SELECT list(items ORDER BY category) AS shelves FROM
            (SELECT category, list(item_id ORDER BY rank) AS items FROM popcat WHERE rank <= {n} GROUP BY 1 ORDER BY 1 LIMIT 10))))"""
oracle("cold_start_category", "pref popcat", _listed(_CATLIST.format(n=10)))
_DIV = """SELECT list_slice(list(item_id ORDER BY cluster, rank), 1, {n}) FROM clu
    WHERE rank <= greatest(1, {n} // (SELECT count(DISTINCT cluster) FROM clu))"""
oracle("cold_start_diversity", "pref clu", _listed(f"SELECT user_id, ({_DIV.format(n=25)}) AS l FROM pref"))
_RND = "SELECT list(item_id ORDER BY u, item_id) FROM (SELECT item_id, u FROM (SELECT item_id, " + uniform("item_id") + " AS u FROM cat) ORDER BY u, item_id LIMIT {n})"
oracle("cold_start_random", "pref cat", _listed(f"SELECT user_id, ({_RND.format(n=10)}) AS l FROM pref"))
oracle("cold_start_recommend", "pref poploc popall popcat clu cat", _listed(f"""
    WITH c AS ({_CATLIST.format(n=15)}), p AS ({_POPLIST.format(n=15)}),
        x AS (SELECT user_id, unnest(l) AS item_id, generate_subscripts(l, 1) AS pos, 0 AS s FROM c
            UNION ALL SELECT user_id, unnest(l), generate_subscripts(l, 1), 1 FROM p
            UNION ALL SELECT user_id, unnest(l), generate_subscripts(l, 1), 2 FROM (SELECT user_id, ({_DIV.format(n=15)}) AS l FROM pref)
            UNION ALL SELECT user_id, unnest(l), generate_subscripts(l, 1), 3 FROM (SELECT user_id, ({_RND.format(n=15)}) AS l FROM pref)),
        y AS (SELECT user_id, item_id, min(s * 1000 + pos) AS o FROM x GROUP BY 1, 2)
    SELECT user_id, list_slice(list(item_id ORDER BY o), 1, 15) AS l FROM y GROUP BY 1"""))
oracle("recommend_or_cold_start", "usr lg popall", f"""
    SELECT user_id, item_id, {r('score')} AS score, CAST(rank AS INTEGER) AS rank, FALSE AS cold_start FROM lg
    WHERE rank <= 10 AND user_id IN (SELECT user_id FROM usr)
    UNION ALL SELECT user_id, item_id, {r('1.0 - 0.01::DOUBLE * (rank - 1)')}, CAST(rank AS INTEGER), TRUE FROM usr, popall
    WHERE rank <= 10 AND user_id NOT IN (SELECT user_id FROM lg)""")
oracle("refresh_cold_start", "popall poploc", """
    SELECT 'overall' AS feature, '' AS value, item_id, rank FROM popall WHERE rank <= 1000
    UNION ALL SELECT 'user_location', CAST(value AS VARCHAR), item_id, rank FROM poploc WHERE rank <= 1000""")

oracle("refresh_cold_start_tables", "popcat cat clu", """
    SELECT 'category' AS feature, category AS value, item_id, CAST(rank AS INTEGER) AS rank FROM popcat WHERE rank <= 1000
    UNION ALL SELECT 'items', NULL, item_id, NULL FROM cat
    UNION ALL SELECT 'clusters', CAST(cluster AS VARCHAR), item_id, CAST(rank AS INTEGER) FROM clu""")


def _update(source: str, popular: str) -> str:
    """Lists from pair scores, event by event."""
    return f"""
    WITH e AS ({source}),
        f AS (SELECT user_id, product_id, min(event_id) AS first FROM e GROUP BY 1, 2),
        suf AS (SELECT user_id, event_id, sum(2) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS w FROM e),
        p AS (SELECT a.product_id, b.product_id AS related_id, sum(w) AS score FROM f a
            JOIN f b ON a.user_id = b.user_id AND a.product_id <> b.product_id
            JOIN suf ON suf.user_id = a.user_id AND suf.event_id = greatest(a.first, b.first) GROUP BY 1, 2),
        c AS (SELECT f.user_id, p.related_id AS item_id, sum(p.score) AS score FROM f JOIN p ON p.product_id = f.product_id
            WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.user_id = f.user_id AND g.product_id = p.related_id) GROUP BY 1, 2),
        own AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM c QUALIFY rank <= 100),
        pp AS ({popular}),
        u AS (SELECT f.user_id, count(*) AS products, (SELECT count(*) FROM own o WHERE o.user_id = f.user_id) AS n FROM f GROUP BY 1),
        more AS (SELECT u.user_id, pp.item_id, n + row_number() OVER (PARTITION BY u.user_id ORDER BY pp.rank) AS rank FROM u, pp
            WHERE pp.rank <= 100 AND NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = u.user_id AND f.product_id = pp.item_id)
                AND NOT EXISTS (SELECT 1 FROM own o WHERE o.user_id = u.user_id AND o.item_id = pp.item_id)),
        al AS (SELECT * FROM own UNION ALL SELECT * FROM more WHERE rank <= 100)
    SELECT al.user_id, item_id, CAST(rank AS INTEGER) AS rank, {r('1.0 - 0.01::DOUBLE * (rank - 1)')} AS score,
        CASE WHEN products > 20 THEN 'high' WHEN products > 5 THEN 'medium' ELSE 'low' END AS activity_level
    FROM al JOIN u ON u.user_id = al.user_id"""


_POP_OF_E = """SELECT product_id AS item_id, row_number() OVER (ORDER BY count(*) DESC, product_id) AS rank FROM e
    WHERE event_type = 'view' GROUP BY 1"""
oracle("update_recommendations", "ev", _update("SELECT * FROM ev", _POP_OF_E))
oracle("update_recommendations_merged", "ev vec", _update("SELECT * FROM ev", f"""
    SELECT item_id, rank FROM ({_POP_OF_E}) WHERE rank <= 60
    UNION ALL SELECT item_id, least(60, (SELECT count(DISTINCT product_id) FROM e WHERE event_type = 'view')) + row_number() OVER (ORDER BY rank) AS rank
    FROM ({_FPOP}) WHERE rank <= 100 AND item_id NOT IN (SELECT item_id FROM ({_POP_OF_E}) WHERE rank <= 60)""").replace("WHERE pp.rank <= 100 AND", "WHERE"))
ORACLES["stream_update_recommendations"] = ORACLES["update_recommendations"]
ORACLES["stream_item_relation"] = ORACLES["cooccurrence_feedback"]
oracle("behaviour_recommendations", "ev", _update("""SELECT * FROM ev
    WHERE user_id IN (SELECT user_id FROM ev GROUP BY 1 HAVING count(*) >= 60)
        AND product_id IN (SELECT product_id FROM ev GROUP BY 1 HAVING count(*) >= 11)""", _POP_OF_E))
oracle("recs_snapshot", "snap", f"""
    SELECT user_id, model, context, product_id, strftime(expires_at, {TS}) AS expires_at FROM snap
    WHERE expires_at > TIMESTAMP '2024-01-15 12:00:00'""")
oracle("recs_invalidate", "snap", """
    SELECT user_id, model, context, product_id FROM snap WHERE expires_at > TIMESTAMP '2024-01-01' AND model <> 'purchase'""")
oracle("recs_snapshot_stats", "snap", """
    SELECT model, count(*) AS entries FROM snap WHERE expires_at > TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1""")

# ---------------------------------------------------------------- feature store

oracle("set_features", "held", f"""
    SELECT entity_id, feature_name, value, strftime(updated_at, {TS}) AS updated_at,
        strftime(updated_at + INTERVAL 1 DAY, {TS}) AS expires_at FROM held""")
oracle("get_features", "held", """
    SELECT entity_id, max(value) FILTER (feature_name = 'view_last') AS view_last,
        max(value) FILTER (feature_name = 'purchase_last') AS purchase_last FROM held
    WHERE feature_name IN ('view_last', 'purchase_last') AND updated_at + INTERVAL 1 DAY > TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1""")
oracle("all_features", "held", "SELECT entity_id, feature_name, value FROM held")
oracle("set_vector", "", f"""
    SELECT CAST(vec_id AS VARCHAR) AS entity_id, CAST(pos - 1 AS INTEGER) AS pos, {r('CAST(v AS DOUBLE)')} AS value FROM
        (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)""")
oracle("increment_features", "held", """
    SELECT h.entity_id, h.feature_name, CAST(h.value AS DOUBLE) + 1.5 * (SELECT count(*) FROM fr
        WHERE fr.entity_id = h.entity_id AND fr.feature_name = h.feature_name)::DOUBLE AS value FROM held h""")
oracle("delete_features", "held", "SELECT entity_id, feature_name, value FROM held WHERE entity_id <> '3'")
oracle("feature_stats", "held", "SELECT count(*) AS feature_count FROM held")
oracle("list_entities", "held", "SELECT DISTINCT entity_id FROM held WHERE entity_id LIKE '1%'")

# ---------------------------------------------------------------- sessions, drift, streams

oracle("session_stats", "sess", f"""
    SELECT session_id, user_id, strftime(start_time, {TS}) AS start_time, strftime(last_time, {TS}) AS last_time, events, products,
        views, add_to_carts, purchases, recommend_clicks FROM sess""")
# A stream closes a session once the newest event, less the watermark delay, has passed its end.
oracle("stream_session_stats", "sess", f"""
    SELECT session_id, user_id, strftime(start_time, {TS}) AS start_time, strftime(last_time, {TS}) AS last_time, events, products,
        views, add_to_carts, purchases, recommend_clicks FROM sess
    WHERE last_time + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE""")
_AS_OF = "TIMESTAMP '2024-01-15 12:00:00'"


def _behaviour(at: str) -> str:
    """CTEs ending in b: the statistics of the 240 minutes before a moment."""
    win = CTES["sess"].replace("FROM ev)", f"FROM ev WHERE ts <= {at})").replace("INTERVAL 30 MINUTE", "INTERVAL 240 MINUTE")
    return f"""ses AS ({win}), act AS (SELECT * FROM ses WHERE last_time >= {at} - INTERVAL 240 MINUTE),
    b AS (SELECT count(*) AS active_sessions, CAST(sum(events) AS BIGINT) AS total_events, CAST(sum(views) AS BIGINT) AS total_views,
        CAST(sum(add_to_carts) AS BIGINT) AS total_add_to_carts, CAST(sum(purchases) AS BIGINT) AS total_purchases,
        CAST(sum(recommend_clicks) AS BIGINT) AS total_recommend_clicks,
        (SELECT count(DISTINCT user_id) FROM ev WHERE ts <= {at} AND ts >= {at} - INTERVAL 240 MINUTE) AS active_users,
        {r('sum(events) / count(*)')} AS avg_session_length, {r('sum(products) / count(*)')} AS avg_session_products,
        {r('CASE WHEN sum(views) > 0 THEN sum(add_to_carts) / sum(views) ELSE 0 END')} AS view_to_cart_rate,
        {r('CASE WHEN sum(add_to_carts) > 0 THEN sum(purchases) / sum(add_to_carts) ELSE 0 END')} AS cart_to_purchase_rate,
        {r('CASE WHEN sum(views) > 0 THEN sum(recommend_clicks) / sum(views) ELSE 0 END')} AS recommendation_click_rate
        FROM act HAVING count(*) > 0)"""


_BEHAVIOUR = _behaviour(_AS_OF)
oracle("behaviour_window", "ev", f"WITH {_BEHAVIOUR} SELECT * FROM b")
# The newest events of the first third of the time, of the first two thirds, and of all.
oracle("stream_behaviour_window", "ev", " UNION ALL ".join(
    f"SELECT * FROM (WITH {_behaviour(at)} SELECT b.*, strftime({at}, {TS}) AS as_of FROM b)"
    for at in (f"""(SELECT max(ts) FROM ev WHERE (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM ev)) * 3
        // ((SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 FROM ev)) <= {k})""" for k in range(3))))
_METRICS = ("active_sessions", "total_events", "total_views", "total_add_to_carts", "total_purchases", "total_recommend_clicks",
            "active_users", "avg_session_length", "avg_session_products", "view_to_cart_rate", "cart_to_purchase_rate",
            "recommendation_click_rate")
oracle("metrics_rows", "ev", f"WITH {_BEHAVIOUR} " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric_name, CAST({m} AS DOUBLE) AS metric_value, 'batch' AS source FROM b" for m in _METRICS))
_KINDS = ("view", "add_to_cart", "purchase", "recommend_click")
_IN = "event_type IN ('view', 'add_to_cart', 'purchase', 'recommend_click')"
oracle("drift_detect", "ev", f"""
    WITH w AS (SELECT * FROM ev WHERE ts >= {_AS_OF} - INTERVAL 600 MINUTE AND ts <= {_AS_OF} AND {_IN}),
        b AS (SELECT * FROM ev WHERE {_IN}),
        d AS (SELECT (SELECT count(*) FROM w) AS total, (""" + " + ".join(
    f"abs((SELECT count(*) FILTER (event_type = '{k}') / count(*) FROM b) - (SELECT count(*) FILTER (event_type = '{k}') / count(*) FROM w))"
    for k in _KINDS) + f""") / 4 AS drift_score)
    SELECT total, {r('drift_score')} AS drift_score, drift_score > 0.02 AS alert FROM d""")


def _timeline(closed: str) -> str:
    shares = " + ".join(
        f"abs((SELECT count(*) FILTER (event_type = '{k}') / count(*) FROM b) - count(*) FILTER (event_type = '{k}') / count(*))" for k in _KINDS)
    return f"""
    WITH b AS (SELECT * FROM ev WHERE {_IN}),
        w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2000-01-01') - INTERVAL 30 MINUTE * k AS start, event_type FROM b, range(0, 8) t(k)),
        d AS (SELECT start, start + INTERVAL 240 MINUTE AS end_time, count(*) AS total, ({shares}) / 4 AS drift_score FROM w GROUP BY start)
    SELECT strftime(start, {TS}) AS start, strftime(end_time, {TS}) AS "end", total, {r('drift_score')} AS drift_score,
        drift_score > 0.1 AS alert FROM d {closed}"""


oracle("drift_timeline", "ev", _timeline(""))
oracle("stream_drift_timeline", "ev", _timeline("WHERE end_time <= (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE"))
oracle("stream_product_features", "ev", _PRODUCT_EVENTS)
ORACLES["stream_user_features"] = ORACLES["user_event_features"]
oracle("stream_rank_and_ensemble", "lst", f"""
    WITH {_ENS.format(f='2 * ')}, d AS (SELECT user_id, item_id, {_PEN} AS score FROM ek)
    SELECT user_id, item_id, {r('score', 12)} AS score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM d""")
oracle("stream_feedback_weights", "att", _FOLD)
ORACLES["stream_model_weights"] = ORACLES["model_success_weights"]
