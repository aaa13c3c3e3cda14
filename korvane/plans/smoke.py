"""Vector search from the command line, without a language model: python -m korvane.plans.smoke "봄 원피스" --catalog FOLDER."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from korvane.operators.filters import FilterSpec
from korvane.operators.models import Encoder, encoder_of
from korvane.operators.search import report, search
from korvane.plans.recommend import checked
from korvane.sources.catalog import read
from korvane.sources.schemas import Settings


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("query")
    for name in ("category", "gender", "season"):
        p.add_argument(f"--{name}")
    p.add_argument("--price-max", type=int)
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--catalog", default=".", help="folder with the tables products and product_embeddings")
    return p.parse_args(given)


def spec_of(args: argparse.Namespace) -> FilterSpec:
    """Only products in stock. Empty texts and a price of 0 filter nothing here, unlike in requests."""
    return FilterSpec(category=args.category or None, gender=args.gender or None, season=args.season or None, price_max=args.price_max or None)


def found(products: DataFrame, embeddings: DataFrame, args: argparse.Namespace, encoder: Encoder) -> DataFrame:
    checked(args.query, args.k)
    return report(search(products, embeddings, encoder.vectors([args.query])[0].tolist(), spec_of(args), args.k))


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = arguments(given)
    spark = spark or SparkSession.builder.appName("smoke").getOrCreate()
    tables = [read(spark, args.catalog, name) for name in ("products", "product_embeddings")]
    print(f"'{args.query}': the nearest products, with their cosine similarity")
    for r in found(*tables, args, encoder_of(Settings())).orderBy("rank").collect():  # at most k rows
        print(f"{r['head']}\n{r['tail']}")


if __name__ == "__main__":
    main()
