"""The registered queries of the retrieval engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.functions import text as X
from korvane.functions.vector import cosine_distance, similarity
from korvane.operators import backfill as B
from korvane.operators import parse as P
from korvane.operators import rerank as R
from korvane.operators import search as S
from korvane.operators.filters import FilterSpec, all_of, chip_rows, predicates
from korvane.operators.index import VectorIndex
from korvane.operators.ledger import Remembered, ask
from korvane.operators.models import PARSE, HashingEncoder, RuleBased, encode
from korvane.plans.recommend import recommend as run_recommend
from korvane.plans.recommend import recommend_batch as run_recommend_batch
from korvane.sources import layout as L
from korvane.sources.buckets import BucketTable
from korvane.sources.catalog import generated, product_embeddings, products
from korvane.sources.dump import read_copy, write_copy
from korvane.sources.schemas import CANDIDATE
from korvane.sources.stored import folder
from korvane.streaming import consumer as E
from korvane.streaming import outbox as O

K = 30
VECTOR = 7
SPEC = FilterSpec(gender="여성", season="봄", price_max=400000)


def gone():
    return F.col("is_deleted")


# The catalog views, as SQL.
PRODUCTS_SQL = """
products AS (
  SELECT id, 'demo' AS tenant_id, concat('SKU-', lpad(CAST(id AS VARCHAR), 10, '0')) AS sku, name, brand, category, subcategory, gender, season, style, color, price,
         CASE WHEN id % 20 < 7 THEN CAST(floor(CAST(price * (60 + id % 36) AS DOUBLE) / 1e5) AS INT) * 1000 + 900 END AS sale_price,
         CAST(CASE WHEN id % 10 = 0 THEN 0 ELSE 1 + (id * 31) % 200 END AS INT) AS stock, concat(name, ' / ', category) AS description, is_deleted
  FROM (
    SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS brand,
      CASE (p_partkey + p_size) % 7 WHEN 0 THEN '상의' WHEN 1 THEN '하의' WHEN 2 THEN '아우터' WHEN 3 THEN '원피스' WHEN 4 THEN '신발' WHEN 5 THEN '가방' ELSE '액세서리' END AS category,
      split_part(p_name, ' ', 2) AS subcategory,
      CASE WHEN p_partkey % 40 = 7 THEN NULL WHEN p_partkey % 12 < 5 THEN '여성' WHEN p_partkey % 12 < 9 THEN '남성' ELSE '공용' END AS gender,
      CASE WHEN p_size % 14 < 3 THEN '봄' WHEN p_size % 14 < 6 THEN '여름' WHEN p_size % 14 < 9 THEN '가을' WHEN p_size % 14 < 12 THEN '겨울' ELSE '사계절' END AS season,
      p_type AS style, split_part(p_name, ' ', 1) AS color,
      CAST(floor(CAST(8000 + (p_partkey * 7919) % 592000 AS DOUBLE) / 1e3) AS INT) * 1000 + 900 AS price, p_partkey % 25 = 3 AS is_deleted
    FROM part) b
)"""
VECTORS_SQL = """
product_embeddings AS (SELECT vec_id AS product_id, CASE WHEN vec_id % 50 = 41 THEN NULL ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 10 <> 9)"""
COLUMNS = ", ".join(CANDIDATE)
WHERE = {
    "filter_live": "NOT is_deleted",
    "filter_in_stock": "NOT is_deleted AND stock > 0",
    "filter_category": "NOT is_deleted AND category = '원피스'",
    "filter_gender": "NOT is_deleted AND gender IN ('여성', '공용')",
    "filter_season": "NOT is_deleted AND season IN ('봄', '사계절')",
    "filter_style": "NOT is_deleted AND style = (SELECT min(style) FROM products)",
    "filter_color": "NOT is_deleted AND color = (SELECT min(color) FROM products)",
    "filter_price_min": "NOT is_deleted AND coalesce(sale_price, price) >= 200000",
    "filter_price_max": "NOT is_deleted AND coalesce(sale_price, price) <= 200000",
    "filter_all": "NOT is_deleted AND stock > 0 AND category = '원피스' AND gender IN ('여성', '공용') AND season IN ('봄', '사계절') AND coalesce(sale_price, price) >= 50000 AND coalesce(sale_price, price) <= 400000",
}
OFF = {"in_stock_only": False}
SPECS = {
    "filter_live": FilterSpec(**OFF), "filter_in_stock": FilterSpec(), "filter_category": FilterSpec(category="원피스", **OFF), "filter_gender": FilterSpec(gender="여성", **OFF), "filter_season": FilterSpec(season="봄", **OFF),
    "filter_price_min": FilterSpec(price_min=200000, **OFF), "filter_price_max": FilterSpec(price_max=200000, **OFF), "filter_all": FilterSpec(category="원피스", gender="여성", season="봄", price_min=50000, price_max=400000),
}


def filtered(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = products(spark, sf_dir)
        spec = SPECS.get(name)
        if spec is None:  # the least value that the table has
            c = name.removeprefix("filter_")
            spec = FilterSpec(**{c: p.agg(F.min(c)).first()[0]}, **OFF)
        return p.where(all_of(predicates(spec, gone()))).select(*CANDIDATE)

    return run


def query_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") == VECTOR).select(F.col("embedding").alias("q"))


def hits(spark: SparkSession, sf_dir: str, k: int = K, spec: FilterSpec = SPEC) -> DataFrame:
    return S.search_by_row(products(spark, sf_dir), product_embeddings(spark, sf_dir), query_row(spark, sf_dir), spec, k, gone())


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


def batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100, some with filters."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 100 = 0")
    v = F.floor(F.col("vec_id") / 100)
    return e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), F.when(v % 3 == 0, "여성").alias("gender"), F.when(v % 4 == 0, "봄").alias("season"), F.when(v % 2 == 1, "신발").alias("category"), F.when(v % 5 == 0, 300000).alias("price_max"))


HITS_SQL = f"""
q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = {VECTOR}),
hits AS (
  SELECT {COLUMNS}, list_cosine_distance(CAST(e.embedding AS DOUBLE[]), q.v) AS distance
  FROM products p JOIN product_embeddings e ON e.product_id = p.id CROSS JOIN q
  WHERE NOT is_deleted AND stock > 0 AND gender IN ('여성', '공용') AND season IN ('봄', '사계절') AND coalesce(sale_price, price) <= 400000
  ORDER BY distance NULLS LAST, id LIMIT {K})"""
WITH_HITS = f"WITH {PRODUCTS_SQL}, {VECTORS_SQL}, {HITS_SQL} "


def with_texts(p: DataFrame) -> DataFrame:
    return p.withColumns({"material": F.when(F.col("id") % 11 != 0, F.concat("style", F.lit(" 소재"))), "tags": F.when(F.col("id") % 13 != 0, F.array("category", "season", "style"))})


def n(c: str) -> str:
    return f"coalesce({c}, 'None')"


EMBED_SQL = f"""WITH {PRODUCTS_SQL}, t AS (
  SELECT *, CASE WHEN id % 11 <> 0 THEN concat(style, ' 소재') END AS material, CASE WHEN id % 13 <> 0 THEN concat(category, ', ', season, ', ', style) ELSE '' END AS tags FROM products)
SELECT id, {n('name')} || '. 카테고리: ' || {n('category')} || ' ' || {n('subcategory')} || '. 브랜드: ' || {n('brand')} || '. 성별: ' || {n('gender')} || '. 시즌: ' || {n('season')} || '. 스타일: ' || {n('style')}
  || '. 색상: ' || {n('color')} || '. 소재: ' || {n('material')} || '. 설명: ' || {n('description')} || ' 태그: ' || tags AS embedded_text FROM t"""

# Replies of a model, made from the rows of the catalog: plain, and in either kind of fence.
REPLY_JSON = """concat('{"filters": {"category": "', category, '", "gender": ', CASE WHEN gender IS NULL THEN 'null' ELSE concat('"', gender, '"') END, ', "color": "', color, '", "price_max": ', price, '.9, "in_stock_only": ', CASE WHEN stock > 0 THEN 'true' ELSE 'false' END, '}, "semantic_query": "', name, '"}')"""
REC_JSON = """concat('{"recommendations": [', CASE WHEN id % 5 = 0 THEN '' ELSE concat('{"product_id": "', id, '", "reason": "', name, '"}, {"product_id": ', id + 1, ', "reason": "', color, '"}, {"product_id": "x', id, '", "reason": "none"}') END, ']}')"""


def fenced(json: str, line: str) -> str:
    return f"CASE id % 3 WHEN 0 THEN {json} WHEN 1 THEN concat('```json', {line}, {json}, {line}, '```') ELSE concat('```', {line}, {json}, {line}, '```', {line}) END"


def replies(spark: SparkSession, sf_dir: str, json: str) -> DataFrame:
    return products(spark, sf_dir).select("id", F.expr(fenced(json, "char(10)")).alias("reply"))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply that chose places 1, 4 and 9 of the candidates, and one product that is none."""
    at = S.ranked(hits(spark, sf_dir)).where("rank IN (1, 4, 9)").select(F.col("id").alias("product_id"), F.concat(F.lit("rank "), F.col("rank").cast("string")).alias("reason"))
    return at.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("product_id"), F.lit("unknown").alias("reason")))


RECS_SQL = WITH_HITS + ", r AS (SELECT row_number() OVER (ORDER BY distance NULLS LAST, id) AS rank, * FROM hits), recs AS (SELECT id AS product_id, concat('rank ', rank) AS reason FROM r WHERE rank IN (1, 4, 9) UNION ALL SELECT -1, 'unknown') "


def upsert_source(e: DataFrame) -> DataFrame:
    """Every third vector anew, and new rows for ids that have none."""
    again = e.where("product_id % 3 = 0").select("product_id", F.reverse("embedding").alias("embedding"))
    return again.unionByName(e.where("product_id % 10 = 1").select((F.col("product_id") + 1000000).alias("product_id"), "embedding"))


def sums(df: DataFrame) -> DataFrame:
    return df.select("product_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), F.size("embedding").alias("dims"))


def q_vector_search(s, d):
    return rounded(hits(s, d))


def q_vector_search_batch(s, d):
    return rounded(S.search_batch(products(s, d), product_embeddings(s, d), batch_queries(s, d), 10, gone())).select("qid", "rank", "id", "distance")


def q_indexed_search(s, d):
    """The same queries over a stored index, in packs."""
    index = VectorIndex.write(products(s, d), product_embeddings(s, d), folder(s, "index"), gone())
    return rounded(index.search(batch_queries(s, d), 10))


def q_smoke_search(s, d):
    return rounded(S.short(hits(s, d, 10)))


def q_ranked_hits(s, d):
    return rounded(S.ranked(hits(s, d)).select("rank", "id", "distance"))


def q_cosine_distance(s, d):
    e = product_embeddings(s, d).crossJoin(F.broadcast(query_row(s, d)))
    distance = cosine_distance(F.col("embedding"), F.col("q"))
    return e.select("product_id", F.round(distance, 6).alias("distance"), F.round(similarity(distance), 6).alias("similarity"))


def q_upsert(s, d):
    e = product_embeddings(s, d)
    return sums(B.upsert(e, upsert_source(e)))


def q_filter_all_indexed(s, d):
    """filter_all over a stored copy whose order lets the scan skip."""
    at = folder(s, "catalog")
    L.write_catalog(products(s, d), at, gone())
    return L.read_catalog(s, at).where(L.pruned(SPECS["filter_all"])).select(*CANDIDATE)


def vector_table(s, d):
    return BucketTable.create(product_embeddings(s, d), folder(s, "vectors"), "product_id", 16)


def q_upsert_bucketed(s, d):
    """The upsert in a keyed table; the state before it stays as it was."""
    table = vector_table(s, d)
    table.upsert(upsert_source(product_embeddings(s, d)))
    return sums(table.read())


def q_delete_bucketed(s, d):
    table = vector_table(s, d)
    rows = product_embeddings(s, d).select("product_id")
    table.delete(rows.join(products(s, d).where("not is_deleted").select(F.col("id").alias("product_id")), "product_id", "left_anti"))
    return sums(table.read())


def q_pending_bucketed(s, d):
    return vector_table(s, d).absent(products(s, d).where(~gone()).select("id", "name"), "id")


def flaky(kind: str, payload: str, event: int, number: int) -> str | None:
    """A stand-in for what events are sent to: some of them fail once, twice or always."""
    return f"try {number}" if number <= event // 4 % 16 - 12 else None


def q_outbox_consumed(s, d):
    return E.consumed(O.pending(outbox_of(s, d)), flaky, 3, 0.01)


def q_append(s, d):
    """The products with odd ids are new rows: no id, tenant, stock or times."""
    p = products(s, d)
    there = p.where("id % 2 = 0").select("id", "tenant_id", "sku", "price", "stock", F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.when(gone(), F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"))
    new = p.where("id % 2 = 1").select("sku", "price")
    return B.append(there, new).select("id", "tenant_id", "sku", "price", "stock", F.col("created_at").isNotNull().alias("timed"), F.col("deleted_at").isNotNull().alias("is_deleted"))


def q_generate(s, d):
    """A made-up product in place of each one of the catalog."""
    return generated(products(s, d).select("id")).drop("created_at", "updated_at")


def q_embed_backfill(s, d):
    todo = with_texts(B.pending(products(s, d), product_embeddings(s, d), gone()))
    return B.embed(todo, HashingEncoder(64), F.lit("2024-01-01").cast("timestamp")).drop("updated_at")


def small_catalog(s, d):
    p = products(s, d)
    texts = with_texts(p).select(F.col("id").alias("product_id"), X.embed_text().alias("t")).repartition("product_id")  # a small file is one task
    return p, encode(texts, HashingEncoder(64), "t", "embedding").drop("t")


def q_recommend(s, d):
    p, e = small_catalog(s, d)
    return run_recommend(p, e, "봄에 입을 여성 원피스 40만원 이하", HashingEncoder(64), RuleBased(), deleted=gone()).select("filters", "semantic_query", "candidate_count", F.to_json("recommendations").alias("recommendations"), F.size("candidates_preview").alias("n_preview"))


def q_recommend_batch(s, d):
    p, e = small_catalog(s, d)
    asked = p.where("id % 100 = 0").select(F.col("id").alias("qid"), F.when(F.col("id") % 1000 == 0, " ").otherwise(F.concat_ws(" ", "season", "gender", "category", F.concat(F.ceil(F.col("price") / 10000).cast("string"), F.lit("만원 이하")))).alias("query"))
    return run_recommend_batch(p, e, asked, HashingEncoder(64), RuleBased(), deleted=gone()).select("qid", "error", "candidate_count", F.to_json("recommendations").alias("recommendations"))


def q_ann(s, d):
    queries = s.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return rounded(S.search_approximate(products(s, d), product_embeddings(s, d), queries, 10, deleted=gone()))


def outbox_of(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("aggregate_id"), "event_type", F.col("props").alias("payload"), F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("processed_at"), F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("last_error"), F.col("ts").alias("created_at"))


def payload_of(s, d, dialect):
    return hits(s, d).select("id", R.payload(dialect).alias("payload"))


FENCE_SQL = r"trim(regexp_replace(regexp_replace(reply, '^```[^\n]*\n', ''), '```\s*$', ''), E' \n')"

def through_dump(df: DataFrame, name: str) -> DataFrame:
    """df written as COPY text and read back."""
    path = folder(df.sparkSession, name)
    write_copy(df, path)
    return read_copy(df.sparkSession, path, df.schema)


def q_ledger_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a parser makes of words about each product; equal words are one call."""
    requests = products(spark, sf_dir).select("id", F.lit(PARSE).alias("system"), F.concat_ws(" ", "gender", "season", "category").alias("user"))
    replies = ask(requests, Remembered(RuleBased(), "rules", folder(spark, "ledger")), 512)
    return replies.select("id", P.filters_of(F.col("reply")).alias("r")).select("id", "r.filters.gender", "r.filters.season", "r.filters.category", "r.semantic_query")


QUERIES = {
    "scan_products": lambda s, d: products(s, d),
    "scan_embeddings": lambda s, d: product_embeddings(s, d).select("product_id", F.size("embedding").alias("dims"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first")),
    **{k: filtered(k) for k in WHERE},
    "effective_price": lambda s, d: products(s, d).select("id", X.effective_price().alias("price"), X.strike_price().alias("struck")),
    "rerank_price_truthy": lambda s, d: products(s, d).withColumn("sale_price", F.when(F.col("id") % 6 == 0, 0).otherwise(F.col("sale_price"))).select("id", X.truthy_price().alias("price")),
    "round_price": lambda s, d: products(s, d).select("id", X.round_price(F.col("price") * 2).cast("long").alias("rounded")),
    "cosine_distance": q_cosine_distance,
    "vector_search": q_vector_search,
    "vector_search_batch": q_vector_search_batch,
    "indexed_search": q_indexed_search,
    "smoke_search": q_smoke_search,
    "ranked_hits": q_ranked_hits,
    "hit_report": lambda s, d: S.report(hits(s, d, 10)),
    "candidate_count": lambda s, d: hits(s, d).agg(F.count("*").alias("candidate_count")),
    "candidate_preview": lambda s, d: rounded(R.preview(hits(s, d)).select("id", "name", "distance")),
    "pending_embeddings": lambda s, d: B.pending(products(s, d), product_embeddings(s, d), gone()).select("id", "name"),
    "pending_count": lambda s, d: B.pending(products(s, d), product_embeddings(s, d), gone()).agg(F.count("*").alias("total")),
    "embed_text": lambda s, d: with_texts(products(s, d)).select("id", X.embed_text().alias("embedded_text")),
    "upsert_embeddings": q_upsert,
    "cascade_delete": lambda s, d: sums(B.cascade_delete(product_embeddings(s, d), products(s, d).where("not is_deleted"))),
    "strip_fence": lambda s, d: replies(s, d, REPLY_JSON).select("id", X.strip_fence_strict(F.col("reply")).alias("strict"), X.strip_fence_lenient(F.col("reply")).alias("lenient")),
    "parse_filters": lambda s, d: replies(s, d, REPLY_JSON).select("id", P.filters_of(X.strip_fence_strict(F.col("reply"))).alias("p")).select("id", "p.filters.category", "p.filters.gender", "p.filters.color", X.whole_won(F.col("p.filters.price_max")).alias("price_max"), "p.filters.in_stock_only", "p.semantic_query"),
    "parse_recs": lambda s, d: replies(s, d, REC_JSON).select("id", F.explode(P.recommendations_of(X.strip_fence_strict(F.col("reply")))).alias("r")).select("id", "r.product_id", "r.reason"),
    "rerank_payload": lambda s, d: payload_of(s, d, "lenient"),
    "rerank_payload_strict": lambda s, d: payload_of(s, d, "strict"),
    "recs_resolved": lambda s, d: R.resolved(replayed(s, d), R.preview(hits(s, d))).select("product_id", "reason", "name"),
    "recs_display": lambda s, d: R.display(replayed(s, d), R.preview(hits(s, d))),
    "recs_display_all": lambda s, d: R.display(replayed(s, d), hits(s, d)),
    "outbox_pending": lambda s, d: O.numbered(O.pending(outbox_of(s, d))).select("place", "id", "aggregate_id", "event_type", "payload"),
    "recs_count": lambda s, d: replies(s, d, REC_JSON).select("id", R.chosen_count(P.recommendations_of(X.strip_fence_strict(F.col("reply")))).alias("chosen")),
    "filter_chips": lambda s, d: chip_rows(batch_queries(s, d).drop("q")),
    "hit_view": lambda s, d: rounded(S.view(hits(s, d))),
    "append_defaults": q_append,
    "filter_all_indexed": q_filter_all_indexed,
    "upsert_bucketed": q_upsert_bucketed,
    "cascade_delete_bucketed": q_delete_bucketed,
    "pending_bucketed": q_pending_bucketed,
    "outbox_consumed": q_outbox_consumed,
    "dump_products": lambda s, d: through_dump(products(s, d), "dump"),
    "dump_embeddings": lambda s, d: through_dump(product_embeddings(s, d), "dump").select("product_id", F.size("embedding").alias("dims"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first")),
    "ledger_replies": q_ledger_replies,
    "generate_catalog": q_generate,
    "embed_backfill": q_embed_backfill,
    "recommend": q_recommend,
    "recommend_batch": q_recommend_batch,
    "ann_search": q_ann,
}

CTE = f"WITH {PRODUCTS_SQL}, {VECTORS_SQL} "


def replies_sql(json: str) -> str:
    """r: id, reply, and what is in the fence."""
    return f"WITH {PRODUCTS_SQL}, made AS (SELECT id, " + fenced(json, "chr(10)") + f" AS reply FROM products), r AS (SELECT id, reply, CASE WHEN starts_with(reply, '```') THEN {FENCE_SQL} ELSE reply END AS body FROM made) "


RECS_OF = ", t AS (SELECT id, unnest(CAST(CAST(body AS JSON)->'recommendations' AS JSON[])) AS x FROM r), u AS (SELECT id, TRY_CAST(x->>'product_id' AS BIGINT) AS product_id, x->>'reason' AS reason FROM t) "
QUOTED = ", ".join(f"'\"{c}\":', coalesce('\"' || {c} || '\"', 'null'), ','" for c in ("name", "category", "subcategory", "gender", "season", "style", "color"))
PAYLOAD_SQL = WITH_HITS + "SELECT id, concat('{{\"product_id\":', id, ',', " + QUOTED + ", '\"price\":', {price}{stock}, '}}') AS payload FROM hits"
REPORT_SQL = (
    WITH_HITS + ", r AS (SELECT CAST(row_number() OVER (ORDER BY distance NULLS LAST, id) AS INT) AS rank, *, coalesce(sale_price, price) AS shown FROM hits) "
    "SELECT rank, lpad(CAST(rank AS VARCHAR), 2, ' ') || '. [' || printf('%.3f', 1 - distance) || '] ' || coalesce(name, 'None') AS head, "
    "'     ' || coalesce(category, 'None') || '/' || coalesce(subcategory, 'None') || ', ' || " + " || ', ' || ".join(f"coalesce({c}, 'None')" for c in ("gender", "season", "style", "color")) + " || ', ' || format('{:,}', shown) || '원' AS tail FROM r WHERE rank <= 10"
)
DISPLAY_SQL = RECS_SQL + "SELECT product_id, reason, coalesce(name, concat('상품 ', product_id)) AS name, coalesce(sale_price, price) AS price FROM recs LEFT JOIN {shown} s ON s.id = product_id"

SQL = {
    "scan_products": CTE + "SELECT * FROM products",
    "scan_embeddings": CTE + "SELECT product_id, CAST(len(embedding) AS INT) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM product_embeddings",
    **{k: CTE + f"SELECT {COLUMNS} FROM products WHERE {w}" for k, w in WHERE.items()},
    "effective_price": CTE + "SELECT id, coalesce(sale_price, price) AS price, CASE WHEN sale_price <> 0 THEN price END AS struck FROM products",
    "rerank_price_truthy": CTE + "SELECT id, CASE WHEN id % 6 = 0 THEN price ELSE coalesce(nullif(sale_price, 0), price) END AS price FROM products",
    "round_price": CTE + "SELECT id, CAST(floor(price * 2 / 1000) AS BIGINT) * 1000 + 900 AS rounded FROM products",
    "cosine_distance": CTE + f", q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = {VECTOR}) SELECT product_id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), v), 6) AS distance, round(1 - list_cosine_distance(CAST(embedding AS DOUBLE[]), v), 6) AS similarity FROM product_embeddings, q",
    "vector_search": WITH_HITS + f"SELECT {COLUMNS}, round(distance, 6) AS distance FROM hits",
    "vector_search_batch": CTE + """, q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN vec_id // 100 % 3 = 0 THEN '여성' END AS g, CASE WHEN vec_id // 100 % 4 = 0 THEN '봄' END AS s, CASE WHEN vec_id // 100 % 2 = 1 THEN '신발' END AS c, CASE WHEN vec_id // 100 % 5 = 0 THEN 300000 END AS m FROM embeddings WHERE vec_id % 100 = 0),
      x AS (SELECT qid, id, list_cosine_distance(CAST(embedding AS DOUBLE[]), v) AS distance FROM products JOIN product_embeddings ON product_id = id CROSS JOIN q
            WHERE NOT is_deleted AND stock > 0 AND (g IS NULL OR gender IN (g, '공용')) AND (s IS NULL OR season IN (s, '사계절')) AND (c IS NULL OR category = c) AND (m IS NULL OR coalesce(sale_price, price) <= m)),
      r AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance NULLS LAST, id) AS INT) AS rank, id, distance FROM x)
      SELECT qid, rank, id, round(distance, 6) AS distance FROM r WHERE rank <= 10""",
    "smoke_search": WITH_HITS + "SELECT id, name, category, subcategory, gender, season, style, color, coalesce(sale_price, price) AS price, round(distance, 6) AS distance FROM hits ORDER BY hits.distance NULLS LAST, id LIMIT 10",
    "ranked_hits": WITH_HITS + "SELECT CAST(row_number() OVER (ORDER BY distance NULLS LAST, id) AS INT) AS rank, id, round(distance, 6) AS distance FROM hits",
    "candidate_count": WITH_HITS + "SELECT count(*) AS candidate_count FROM hits",
    "candidate_preview": WITH_HITS + "SELECT id, name, round(distance, 6) AS distance FROM hits ORDER BY hits.distance NULLS LAST, id LIMIT 5",
    "pending_embeddings": CTE + "SELECT id, name FROM products p LEFT JOIN product_embeddings e ON e.product_id = p.id WHERE e.product_id IS NULL AND NOT is_deleted",
    "pending_count": CTE + "SELECT count(*) AS total FROM products p LEFT JOIN product_embeddings e ON e.product_id = p.id WHERE e.product_id IS NULL AND NOT is_deleted",
    "embed_text": EMBED_SQL,
    "upsert_embeddings": CTE + ", s AS (SELECT product_id, list_reverse(embedding) AS embedding FROM product_embeddings WHERE product_id % 3 = 0 UNION ALL SELECT product_id + 1000000, embedding FROM product_embeddings WHERE product_id % 10 = 1), m AS (SELECT * FROM s UNION ALL SELECT * FROM product_embeddings t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.product_id = t.product_id)) SELECT product_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, CAST(len(embedding) AS INT) AS dims FROM m",
    "cascade_delete": CTE + "SELECT product_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, CAST(len(embedding) AS INT) AS dims FROM product_embeddings WHERE product_id IN (SELECT id FROM products WHERE NOT is_deleted)",
    "strip_fence": replies_sql(REPLY_JSON) + "SELECT id, body AS strict, CASE WHEN starts_with(reply, '```') THEN trim(rtrim(trim(regexp_replace(split_part(reply, '```', 2), '^json', ''), E' \\n'), '`'), E' \\n') ELSE reply END AS lenient FROM r",
    "parse_filters": replies_sql(REPLY_JSON) + "SELECT id, j->'filters'->>'category' AS category, j->'filters'->>'gender' AS gender, j->'filters'->>'color' AS color, CAST(trunc(CAST(j->'filters'->>'price_max' AS DOUBLE)) AS INT) AS price_max, CAST(j->'filters'->>'in_stock_only' AS BOOLEAN) AS in_stock_only, j->>'semantic_query' AS semantic_query FROM (SELECT id, CAST(body AS JSON) AS j FROM r)",
    "parse_recs": replies_sql(REC_JSON) + RECS_OF + "SELECT id, product_id, reason FROM u WHERE product_id IS NOT NULL",
    "rerank_payload": PAYLOAD_SQL.format(price="coalesce(nullif(sale_price, 0), price)", stock=", ',\"stock\":', stock"),
    "rerank_payload_strict": PAYLOAD_SQL.format(price="coalesce(sale_price, price)", stock=""),
    "recs_resolved": RECS_SQL + "SELECT product_id, reason, name FROM recs JOIN (SELECT * FROM r WHERE rank <= 5) s ON s.id = product_id",
    "recs_display": DISPLAY_SQL.format(shown="(SELECT * FROM r WHERE rank <= 5)"),
    "recs_display_all": DISPLAY_SQL.format(shown="r"),
    "hit_report": REPORT_SQL,
    "recs_count": replies_sql(REC_JSON) + RECS_OF + "SELECT r.id, CAST(count(u.product_id) AS INT) AS chosen FROM r LEFT JOIN u ON u.id = r.id GROUP BY r.id",
    "filter_chips": "WITH q AS (SELECT vec_id AS qid, CASE WHEN vec_id // 100 % 3 = 0 THEN '여성' END AS gender, CASE WHEN vec_id // 100 % 4 = 0 THEN '봄' END AS season, CASE WHEN vec_id // 100 % 2 = 1 THEN '신발' END AS category, CASE WHEN vec_id // 100 % 5 = 0 THEN '300000' END AS price_max FROM embeddings WHERE vec_id % 100 = 0) SELECT qid, name, value FROM q UNPIVOT (value FOR name IN (gender, season, category, price_max))",
    "hit_view": WITH_HITS + f"SELECT {', '.join(c for c in CANDIDATE if c != 'sku')}, round(distance, 6) AS distance FROM hits",
    "append_defaults": CTE + ", p AS (SELECT *, row_number() OVER (ORDER BY sku) AS n FROM products WHERE id % 2 = 1) SELECT n + (SELECT max(id) FROM products WHERE id % 2 = 0) AS id, 'demo' AS tenant_id, sku, price, 0 AS stock, true AS timed, false AS is_deleted FROM p UNION ALL SELECT id, tenant_id, sku, price, stock, false, is_deleted FROM products WHERE id % 2 = 0",
    "outbox_pending": "SELECT CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS place, event_id AS id, user_id AS aggregate_id, event_type, props AS payload FROM events WHERE event_id % 4 = 0",
}

# Stored forms give the rows of the plain ones.
SQL |= {"indexed_search": SQL["vector_search_batch"], "filter_all_indexed": SQL["filter_all"], "upsert_bucketed": SQL["upsert_embeddings"], "cascade_delete_bucketed": SQL["cascade_delete"], "pending_bucketed": SQL["pending_embeddings"], "dump_products": SQL["scan_products"], "dump_embeddings": SQL["scan_embeddings"]}
SQL["ledger_replies"] = CTE + "SELECT id, gender, season, category, concat_ws(' ', gender, season, category) AS semantic_query FROM products"
SQL["outbox_consumed"] = """
WITH e AS (SELECT *, greatest(0, event_id // 4 % 16 - 12) AS fails, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE event_id % 4 = 0)
SELECT user_id AS aggregate_id, place, event_id AS id, event_type, CAST(least(3, fails + 1) AS INT) AS tries, CASE WHEN fails >= 3 THEN 'try 3' END AS error, fails >= 3 AS dead FROM e"""
