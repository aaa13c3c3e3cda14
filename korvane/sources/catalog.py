"""The catalog: views over the driver's tables, stored tables, and a generator. sources/database.py has the tables in a database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from korvane.functions.text import round_price
from korvane.sources.schemas import ANY_GENDER, EMBEDDINGS, GENDERS, PRODUCTS, SEASONS, STYLES

# The generator's pools.
CATEGORIES = {
    "상의": ["티셔츠", "셔츠", "블라우스", "니트", "후드", "맨투맨", "가디건", "탱크탑"],
    "하의": ["청바지", "슬랙스", "면바지", "트레이닝", "반바지", "스커트", "조거"],
    "아우터": ["자켓", "코트", "패딩", "블레이저", "점퍼", "무스탕", "트렌치코트", "베스트"],
    "원피스": ["미니원피스", "롱원피스", "셔츠원피스", "니트원피스", "점프수트"],
    "신발": ["스니커즈", "구두", "부츠", "샌들", "슬리퍼", "로퍼", "워커"],
    "가방": ["백팩", "토트백", "크로스백", "클러치", "에코백", "숄더백"],
    "액세서리": ["모자", "스카프", "벨트", "양말", "장갑", "머플러"],
}
MATERIALS = {
    "상의": ["면 100%", "코튼혼방", "린넨", "폴리에스터", "울혼방", "캐시미어", "니트"],
    "하의": ["데님", "면", "폴리혼방", "스판", "린넨", "울"],
    "아우터": ["울 60%", "캐시미어 30%", "다운 90%", "폴리에스터", "양가죽", "트위드"],
    "원피스": ["시폰", "린넨", "폴리에스터", "면", "쉬폰혼방", "니트"],
    "신발": ["가죽", "스웨이드", "캔버스", "메쉬", "합성피혁"],
    "가방": ["가죽", "캔버스", "나일론", "PU레더", "리사이클 폴리"],
    "액세서리": ["면", "울", "아크릴", "가죽", "폴리"],
}
PRICES = {"상의": (15000, 120000), "하의": (25000, 150000), "아우터": (80000, 600000), "원피스": (35000, 200000), "신발": (50000, 350000), "가방": (40000, 400000), "액세서리": (8000, 60000)}
BRANDS = ["무지샵", "콤마플레이스", "베이직룩", "데일리스타일", "모던시크", "어반패션", "클로젯9", "룩스앤", "핀크", "모먼트", "슬로우데이", "오프닝", "라이트하우스", "더네스트", "에이블리"]
COLORS = ["블랙", "화이트", "그레이", "네이비", "베이지", "카키", "브라운", "블루", "핑크", "레드", "그린", "옐로우", "퍼플", "민트"]
ADJECTIVES = ["슬림한", "오버핏", "루즈한", "베이직", "트렌디한", "포근한", "산뜻한", "모던한", "클래식한", "여유로운", "감각적인", "데일리한", "고급스러운", "캐주얼한", "심플한"]
DETAILS = ["부드러운 터치감", "신축성 좋은 원단", "쾌적한 착용감", "사계절 활용도 높은", "체형을 보완해주는", "포인트가 되는", "베이직한 디자인", "트렌디한 실루엣", "데일리로 활용하기 좋은"]
SHOE_SIZES = [str(n) for n in range(220, 281, 5)]
SIZES = ["XS", "S", "M", "L", "XL", "XXL", "FREE"]
SHOES = "신발"
NAME = "[%s] %s %s %s"
DESCRIPTION = "%s의 %s %s. %s 소재로 %s 제품입니다. %s 시즌 %s 코디에 활용하기 좋습니다. 컬러: %s."


def read(spark: SparkSession, location: str, name: str = "products") -> DataFrame:
    """A stored table, with its declared schema: no inference."""
    return spark.read.schema({"products": PRODUCTS, "product_embeddings": EMBEDDINGS}[name]).parquet(f"{location}/{name}")


def declared(rows: DataFrame, schema: StructType) -> DataFrame:
    """rows with the columns and types of a schema; texts of arrays are read."""
    given = {f.name: f.dataType for f in rows.schema.fields}

    def value(name: str, kind: DataType) -> Column:
        if isinstance(kind, ArrayType) and isinstance(given[name], StringType):
            return F.from_json(name, kind)
        return F.col(name) if given[name] == kind else F.col(name).cast(kind)  # a cast to its own type would keep filters on a VARCHAR from the database

    return rows.select(*(value(f.name, f.dataType).alias(f.name) for f in schema.fields))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog over the driver's `part` table. is_deleted stands for a deletion time."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, size = F.col("p_partkey"), F.col("p_size")
    names = F.split("p_name", " ")

    def pick(n: Column, below: list[tuple[int, str]], last: str) -> Column:
        out = F.when(n < below[0][0], below[0][1])
        for limit, value in below[1:]:
            out = out.when(n < limit, value)
        return out.otherwise(last)

    price = ((F.lit(8000) + (key * 7919) % 592000) / 1000).cast("int") * 1000 + 900
    base = part.select(
        key.alias("id"), F.lit("demo").alias("tenant_id"), F.concat(F.lit("SKU-"), F.lpad(key.cast("string"), 10, "0")).alias("sku"), F.col("p_name").alias("name"),
        F.when(key % 17 != 0, F.col("p_brand")).alias("brand"), F.element_at(F.array(*map(F.lit, CATEGORIES)), ((key + size) % 7 + 1).cast("int")).alias("category"),
        F.coalesce(F.get(names, 1), F.lit("")).alias("subcategory"), F.when(key % 40 == 7, F.lit(None)).otherwise(pick(key % 12, [(5, GENDERS[0]), (9, GENDERS[1])], ANY_GENDER)).alias("gender"),
        pick(size % 14, [(3, SEASONS[0]), (6, SEASONS[1]), (9, SEASONS[2]), (12, SEASONS[3])], SEASONS[4]).alias("season"),
        F.col("p_type").alias("style"), F.get(names, 0).alias("color"), price.cast("int").alias("price"), (key % 25 == 3).alias("is_deleted"),
    )
    sale = F.when(F.col("id") % 20 < 7, F.floor((F.col("price") * (60 + F.col("id") % 36)).cast("double") / 1e5).cast("int") * 1000 + 900)
    stock = F.when(F.col("id") % 10 == 0, 0).otherwise(1 + (F.col("id") * 31) % 200).cast("int")
    return base.withColumns({"sale_price": sale, "stock": stock, "description": F.concat("name", F.lit(" / "), "category")})


def product_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors for nine products in ten, one in fifty of them null."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 10 <> 9")
    return vectors.select(F.col("vec_id").alias("product_id"), F.when(F.col("vec_id") % 50 != 41, F.col("embedding")).alias("embedding"))


def generate(spark: SparkSession, total: int, seed: int = 42) -> DataFrame:
    """A synthetic catalog of `total` products, with ids from 1."""
    return generated(spark.range(1, total + 1), seed)


def generated(ids: DataFrame, seed: int = 42) -> DataFrame:
    """A synthetic product for each id: every value is a hash of (seed, id, name of the draw), so partitions need no shared state."""
    bits = lambda draw: F.xxhash64(F.lit(seed), F.lit(draw), F.col("id"))
    unit = lambda draw: F.pmod(bits(draw), F.lit(1 << 40)) / float(1 << 40)

    def choice(pool: Column, size: Column, draw: str) -> Column:
        return F.element_at(pool, (F.pmod(bits(draw), size) + 1).cast("int"))

    def of(values: list[str], draw: str) -> Column:
        return choice(F.array(*map(F.lit, values)), F.lit(len(values)), draw)

    def weighted(values: list[str], weights: list[int], draw: str) -> Column:
        pool = [v for v, w in zip(values, weights, strict=True) for _ in range(w)]
        return of(pool, draw)

    def by_category(table: dict[str, list[str]]) -> Column:
        return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("category")]

    def sample(values: list[str], least: int, most: int) -> Column:
        keyed = F.transform(F.array(*map(F.lit, values)), lambda v: F.struct(F.xxhash64(F.lit(seed), F.col("id"), v).alias("k"), v.alias("v")))
        return F.transform(F.slice(F.array_sort(keyed), F.lit(1), (F.lit(least) + F.pmod(bits("sizes"), F.lit(most - least + 1))).cast("int")), lambda s: s.v)

    low = F.create_map(*[x for k, (a, _) in PRICES.items() for x in (F.lit(k), F.lit(a))])[F.col("category")]
    span = F.create_map(*[x for k, (a, z) in PRICES.items() for x in (F.lit(k), F.lit(z - a + 1))])[F.col("category")]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    df = ids.select("id", of(list(CATEGORIES), "category").alias("category"), of(BRANDS, "brand").alias("brand"), weighted(GENDERS, [5, 4, 3], "gender").alias("gender"), weighted(SEASONS, [3, 3, 3, 3, 2], "season").alias("season"), of(STYLES, "style").alias("style"), of(COLORS, "color").alias("color"))
    sub, mat = by_category(CATEGORIES), by_category(MATERIALS)
    df = df.withColumns({
        "tenant_id": F.lit("demo"), "sku": F.concat(F.lit("SKU-"), *[F.substring(F.lit(letters), (F.pmod(bits(f"sku{i}"), F.lit(36)) + 1).cast("int"), F.lit(1)) for i in range(10)]),
        "subcategory": choice(sub, F.size(sub), "subcategory"), "material": choice(mat, F.size(mat), "material"),
        "sizes": F.when(F.col("category") == SHOES, sample(SHOE_SIZES, 3, 7)).otherwise(sample(SIZES, 2, 5)),
        "price": round_price(low + F.pmod(bits("price"), span)).cast("int"), "stock": F.when(unit("sold out") < 0.1, 0).otherwise(1 + F.pmod(bits("stock"), F.lit(200))).cast("int"),
    })
    df = df.withColumn("sale_price", F.when(unit("sale") < 0.35, round_price(F.floor(F.col("price") * (0.6 + 0.35 * unit("discount"))))).cast("int"))
    df = df.withColumns({
        "name": F.format_string(NAME, "brand", "color", of(ADJECTIVES, "adjective"), "subcategory"),
        "description": F.format_string(DESCRIPTION, "brand", "style", "subcategory", "material", of(DETAILS, "detail"), "season", "gender", "color"),
        "tags": F.array("category", "subcategory", "brand", "gender", "season", "style", "color"), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp(), "deleted_at": F.lit(None).cast("timestamp"),
    })
    return df.select(*PRODUCTS.fieldNames())
