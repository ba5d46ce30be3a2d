"""Table schemas, defaults and parameter presets."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, TEXT, FLAG, TIME = (
    T.LongType(),
    T.IntegerType(),
    T.StringType(),
    T.BooleanType(),
    T.TimestampType(),
)
WEIGHT, SCORE = T.DecimalType(16, 4), T.DecimalType(18, 6)


def table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])

ARTICLE_METADATA = table(
    author=TEXT,
    tags=T.ArrayType(TEXT),
    category=TEXT,
    publishTime=TIME,
    url=TEXT,
    publisher=TEXT,
    viewCount=INT,
    likeCount=INT,
)

ARTICLES = table(
    id=LONG,
    system_id=LONG,
    is_shared=FLAG,
    title=TEXT,
    summary=TEXT,
    full_text=TEXT,
    weight=WEIGHT,
    create_time=TIME,
    source=TEXT,
    attr=TEXT,
    embedding=T.ArrayType(T.FloatType()),
    is_deleted=FLAG,
)

# One article as posted: the tenant comes from the caller, not from the record.
ARTICLE_RECORD = table(
    id=LONG,
    title=TEXT,
    summary=TEXT,
    fullText=TEXT,
    weight=WEIGHT,
    source=TEXT,
    metadata=TEXT,
    isShared=FLAG,
    createTime=TIME,
)

SYSTEMS = table(
    system_id=LONG,
    system_code=TEXT,
    system_name=TEXT,
    description=TEXT,
    is_active=FLAG,
    create_time=TIME,
    update_time=TIME,
)

CONFIGS = table(
    system_id=LONG,
    default_hours=INT,
    default_eps=T.DoubleType(),
    default_min_samples=INT,
    embedding_cron=TEXT,
    clustering_cron=TEXT,
    max_articles_limit=INT,
    snapshot_limit=INT,
)

LINKS = table(
    article_id=LONG,
    system_id=LONG,
)

SNAPSHOT = table(
    snapshot_time=TIME,
    rank_no=INT,
    system_id=LONG,
    cluster_id=LONG,
    title=TEXT,
    article_count=LONG,
    total_weight=WEIGHT,
    hot_score=SCORE,
    sample_titles=TEXT,
    hours_window=INT,
    model_name=TEXT,
)

EVENT_ARTICLES = table(
    snapshot_time=TIME,
    rank_no=INT,
    system_id=LONG,
    cluster_id=LONG,
    article_id=LONG,
    article_weight=WEIGHT,
)

# The defaults every deployment starts with.
DEFAULT_HOURS = 24
DEFAULT_EPS = 0.38
DEFAULT_MIN_SAMPLES = 3
DEFAULT_MAX_ARTICLES = 80000
DEFAULT_SNAPSHOT_LIMIT = 100
DEFAULT_EMBEDDING_CRON = "*/8 * * * *"
DEFAULT_CLUSTERING_CRON = "*/12 * * * *"
DEFAULT_MODEL = "bge-large-zh-v1.5"
DEFAULT_DIMENSION = 1024
EMBED_WINDOW_DAYS = 60
EMBED_BATCH_ROWS = 1500
ENCODER_REQUEST_ROWS = 50
ENCODER_BATCH_ROWS = 32
SAMPLE_TITLES = 4
SAMPLE_SEPARATOR = " | "
TEXT_SEPARATOR = "。"
DEFAULT_WEIGHT = 1.0

CONFIG_DEFAULTS = {
    "default_hours": DEFAULT_HOURS,
    "default_eps": DEFAULT_EPS,
    "default_min_samples": DEFAULT_MIN_SAMPLES,
    "embedding_cron": DEFAULT_EMBEDDING_CRON,
    "clustering_cron": DEFAULT_CLUSTERING_CRON,
    "max_articles_limit": DEFAULT_MAX_ARTICLES,
    "snapshot_limit": DEFAULT_SNAPSHOT_LIMIT,
}

# The parameter presets (eps, min_samples) and window lengths in hours.
PRESETS = {
    "balanced": (0.38, 3),
    "sensitive": (0.42, 2),
    "strict": (0.36, 5),
    "loose": (0.45, 2),
}
WINDOW_HOURS = {"breaking": 12, "daily": 24, "weekly": 168}
# Every parameter preset over every window, as (eps, min_samples, hours).
WINDOW_PRESETS = {
    f"{preset}_{window}": (eps, min_samples, hours)
    for preset, (eps, min_samples) in PRESETS.items()
    for window, hours in WINDOW_HOURS.items()
}
