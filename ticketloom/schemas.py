"""Explicit schemas of the tables the library reads and writes."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType(),
}


def schema_of(text: str) -> T.StructType:
    """``name type, name type`` as a schema; unlike a DDL parse it needs no running session."""
    pairs = [field.split() for field in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_FEED = schema_of(
    "reviewId string, userName string, content string, score double, thumbsUpCount bigint, "
    "at timestamp_ntz, replyContent string, repliedAt timestamp_ntz, userImage string, "
    "reviewCreatedVersion string, appVersion string"
)
REVIEWS = schema_of(
    "source string, review_id string, review_title string, user_name string, "
    "review_description string, rating double, thumbs_up bigint, review_date timestamp_ntz, "
    "developer_response string, developer_response_date timestamp_ntz, app_version string, "
    "language_code string, country_code string"
)
TRAINING = schema_of("review string, label int")
BUG_PREDICTIONS = schema_of(
    "review_id string, user_name string, review_description string, review_date timestamp_ntz, "
    "app_version string, rating double, is_bug_report int, bug_confidence double, "
    "bug_keyword_count int, review_length int"
)
CATEGORIZED_BUGS = schema_of(
    "review_description string, bug_category string, review_date timestamp_ntz, app_version string"
)
RECLASSIFIED_BUGS = T.StructType(
    CATEGORIZED_BUGS.fields
    + schema_of("cleaned_text string, predicted_category string, cluster int").fields
)
DEVELOPER_SUMMARIES = schema_of(
    "bug_category string, count bigint, summary string, key_findings string, "
    "suggested_actions string, priority_level string, additional_notes string, "
    "latest_date timestamp_ntz, versions_affected string, syslog_level string, severity_code int"
)
ATTENDED_TICKETS = schema_of("ticket_key string, TicketID string, attended_at timestamp_ntz")
SENT_TICKETS = schema_of("ticket_key string, ticket_id string")
CLASSIFIER_SCORES = schema_of("c double, class_weight string, f1_mean double, f1_std double, chosen int, solver string")
TAXONOMY_RULES = schema_of("pos int, category string, keyword string")
SEVERITY_MAP = schema_of("category string, syslog_level string, severity_code int")
LEXICON = schema_of("token string, polarity double")
LEMMAS = schema_of("token string, lemma string")
STOPWORDS = schema_of("token string")
