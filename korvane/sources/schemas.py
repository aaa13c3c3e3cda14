"""Table schemas, vocabularies and the checks that a database would have enforced."""

from __future__ import annotations

from dataclasses import dataclass, field
from os import environ

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType, TimestampType

TYPES = {"bigint": LongType(), "int": IntegerType(), "string": StringType(), "double": DoubleType(), "boolean": BooleanType(), "timestamp": TimestampType(), "array<string>": ArrayType(StringType()), "array<float>": ArrayType(FloatType(), False)}


def struct(columns: str) -> StructType:
    """A schema from `name type, ...`; `not null` may follow a type. Needs no session."""
    out = StructType()
    for c in columns.split(", "):
        name, kind, *rest = c.split(" ")
        out.add(name, TYPES[kind], not rest)
    return out


PRODUCTS: StructType = struct(
    "id bigint not null, tenant_id string not null, sku string not null, name string not null, brand string, category string not null, "
    "subcategory string, gender string, season string, style string, color string, sizes array<string>, material string, price int not null, "
    "sale_price int, stock int not null, description string, tags array<string>, created_at timestamp not null, updated_at timestamp not null, deleted_at timestamp"
)
EMBEDDINGS: StructType = struct("product_id bigint not null, embedding array<float>, embedded_text string not null, model string not null, updated_at timestamp not null")
OUTBOX: StructType = struct("id bigint not null, aggregate_id bigint not null, event_type string not null, payload string not null, processed_at timestamp, retry_count int, last_error string, created_at timestamp not null")
FILTERS: StructType = struct("category string, gender string, season string, style string, color string, price_min double, price_max double, in_stock_only boolean")
RECOMMENDATIONS = "array<struct<product_id: string, reason: string>>"

# The catalog's closed vocabularies, and the members that match any request.
GENDERS = ["여성", "남성", "공용"]
SEASONS = ["봄", "여름", "가을", "겨울", "사계절"]
STYLES = ["캐주얼", "미니멀", "스트릿", "클래식", "빈티지", "페미닌", "스포티", "데일리", "오피스", "러블리", "모던", "보헤미안"]
ANY_GENDER = "공용"
ANY_SEASON = "사계절"

CANDIDATE = ["id", "sku", "name", "brand", "category", "subcategory", "gender", "season", "style", "color", "price", "sale_price", "stock", "description"]


@dataclass(frozen=True)
class Settings:
    """What the environment may set."""

    embed_model: str = field(default_factory=lambda: environ.get("EMBED_MODEL", "hashing"))
    language_model: str = field(default_factory=lambda: environ.get("LLM_MODEL", "rules"))
    dim: int = field(default_factory=lambda: int(environ.get("EXPECTED_DIM", "1024")))
    batch: int = field(default_factory=lambda: int(environ.get("BATCH", "32")))
    dsn: str = field(default_factory=lambda: environ.get("DB_DSN", ""))
    total: int = field(default_factory=lambda: int(environ.get("TOTAL", "10000")))


def create_tables(spark, location: str) -> None:
    """Write the three tables, empty, unless they exist."""
    for name, schema in (("products", PRODUCTS), ("product_embeddings", EMBEDDINGS), ("outbox_events", OUTBOX)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{location}/{name}")


def violations(df: DataFrame, schema: StructType, unique: list[str]) -> DataFrame:
    """rule and n: how often a NOT NULL column is null or a unique column repeats. One aggregation for nulls, one for each unique column."""
    required = [f.name for f in schema.fields if not f.nullable]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    stack = F.explode(F.array(*[F.struct(F.lit(f"{c} is null").alias("rule"), F.col(c).alias("n")) for c in required]))
    out = nulls.select(stack.alias("v")).select("v.rule", "v.n")
    for c in unique:
        repeats = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("k")).where("k > 1")
        out = out.unionByName(repeats.agg(F.count("*").alias("n")).select(F.lit(f"{c} repeats").alias("rule"), "n"))
    return out.where("n > 0")
