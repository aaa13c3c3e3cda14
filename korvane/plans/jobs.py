"""The two jobs that fill a database: a generated catalog, and vectors for the products that have none.

python -m korvane.plans.jobs seed|embed    (DB_DSN, TOTAL, EMBED_MODEL, EXPECTED_DIM, BATCH)
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from korvane.operators.backfill import INPUT, embed, pending
from korvane.operators.models import Encoder, encoder_of
from korvane.operators.watch import Report, Watch
from korvane.sources.catalog import generate
from korvane.sources.database import Database
from korvane.sources.schemas import EMBEDDINGS, Settings
from korvane.sources.stored import materialize


def seed(spark: SparkSession, db: Database, total: int, seed: int = 42) -> None:
    """Put a generated catalog, with ids from 1, in place of the products; the vectors go."""
    db.write("product_embeddings", spark.createDataFrame([], EMBEDDINGS), "overwrite")
    db.write("products", generate(spark, total, seed), "overwrite")


def embed_missing(spark: SparkSession, db: Database, encoder: Encoder, batch: int = 32, report: Report | None = None) -> int:
    """Add vectors for the live products that have no row of them. Returns the count; a run after a failure takes up the rest.

    Of the vectors only the keys are read; deleted products stay in the database."""
    todo = materialize(pending(db.read(spark, "products"), db.read(spark, "product_embeddings")).select(*INPUT), "todo")
    n = todo.count()
    if n:
        with Watch(spark, n, report or (lambda *_: None)) as watch:
            db.write("product_embeddings", embed(todo, encoder, batch=batch, count=watch.done))
            watch.finished(n)  # todo is a stored table, so what was written is what was counted
    return n


def main(args: list[str]) -> None:
    if args not in (["seed"], ["embed"]):
        raise SystemExit(__doc__)
    settings = Settings()
    if not settings.dsn:
        raise SystemExit("DB_DSN is not set")
    spark, db = SparkSession.builder.appName(f"korvane {args[0]}").getOrCreate(), Database(settings.dsn)
    if args == ["seed"]:
        db.create(spark)
        seed(spark, db, settings.total)
        print(f"{settings.total} products")
    else:
        n = embed_missing(spark, db, encoder_of(settings), settings.batch, lambda done, total, rate, left: print(f"{done} of {total}, {rate:.0f} a second, {left:.0f} s left"))
        print(f"{n} vectors")


if __name__ == "__main__":
    main(sys.argv[1:])
