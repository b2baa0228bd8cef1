"""Column types of the JSON messages, as DDL text."""

# Stream messages by kind. ``timestamp`` is text: producers send epoch milliseconds or ISO time.
MESSAGES = {
    "review": (
        "user_id STRING, product_id STRING, rating DOUBLE, review_text STRING, summary STRING, "
        "verified_purchase BOOLEAN, review_date STRING, event_type STRING, timestamp STRING"
    ),
    "product_event": (
        "user_id STRING, product_id STRING, event_type STRING, timestamp STRING, session_id STRING, "
        "rating DOUBLE, metadata MAP<STRING,STRING>"
    ),
    "recommendation_request": (
        "user_id STRING, request_id STRING, model_version STRING, num_recommendations INT, "
        "context MAP<STRING,STRING>, timestamp STRING"
    ),
    "metrics": (
        "metric_name STRING, metric_value DOUBLE, tags MAP<STRING,STRING>, metadata MAP<STRING,STRING>, "
        "timestamp STRING"
    ),
    "feedback": (
        "user_id STRING, item_id STRING, event_type STRING, timestamp STRING, context MAP<STRING,STRING>, "
        "rating DOUBLE, view_time_seconds DOUBLE, model_name STRING, metadata MAP<STRING,STRING>"
    ),
    "candidates": (
        "user_id STRING, candidates ARRAY<STRUCT<item_id: STRING, score: DOUBLE, stage: STRING, model: STRING>>, "
        "context MAP<STRING,STRING>, timestamp STRING, source_model STRING"
    ),
    "ranked": (
        "user_id STRING, ranked_items ARRAY<STRUCT<item_id: STRING, score: DOUBLE, original_score: DOUBLE, "
        "stage: STRING, model: STRING>>, context MAP<STRING,STRING>, timestamp STRING, source_model STRING"
    ),
}

# Fields that must be present, and the parts of the message key, by kind.
REQUIRED_FIELDS = {
    "review": ["user_id", "product_id", "rating", "review_text"],
    "product_event": ["user_id", "product_id", "event_type"],
    "recommendation_request": ["user_id", "request_id", "model_version"],
    "metrics": ["metric_name", "metric_value"],
}
KEY_FIELDS = {
    "review": ["product_id"],
    "product_event": ["user_id", "product_id"],
    "recommendation_request": ["user_id"],
    "metrics": ["metric_name"],
}
