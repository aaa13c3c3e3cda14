"""The tables in a database, over JDBC: reads by ranges of the key, appends, and the backfill of what has no vector.

Filters and column lists go to the database (Spark's JDBC source pushes them). Ranges are read over connections of their
own, so a table that changes meanwhile is not one state. A partition's rows are written in one transaction; a key's
constraint in the database refuses what a lost executor's task has written already, and the next run takes up the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from korvane.sources.catalog import declared
from korvane.sources.schemas import EMBEDDINGS, OUTBOX, PRODUCTS

TABLES = {"products": PRODUCTS, "product_embeddings": EMBEDDINGS, "outbox_events": OUTBOX}
KEYS = {"products": "id", "product_embeddings": "product_id", "outbox_events": "id"}
LONG = {"name", "description", "embedded_text", "payload", "last_error"}  # texts without a bound; the others are VARCHAR, which databases can compare


@dataclass(frozen=True)
class Database:
    """A JDBC URL, or a DSN such as postgresql://user:password@host:5432/name, and the source's options (driver, fetchsize)."""

    dsn: str
    options: dict[str, str] = field(default_factory=dict)

    def source(self) -> dict[str, str]:
        if self.dsn.startswith("jdbc:"):
            return {"url": self.dsn, **self.options}
        at = urlsplit(self.dsn)
        if not at.hostname:
            raise ValueError("a DSN has the form scheme://user:password@host/name")
        kind = {"postgres": "postgresql"}.get(at.scheme, at.scheme)
        login = {k: unquote(v) for k, v in (("user", at.username), ("password", at.password)) if v}
        port, query = f":{at.port}" if at.port else "", f"?{at.query}" if at.query else ""
        return {"url": f"jdbc:{kind}://{at.hostname}{port}{at.path}{query}", **login, **self.options}

    def bounds(self, spark: SparkSession, name: str) -> tuple[int, int] | None:
        """Least and greatest key, which the database works out; None for an empty table."""
        key = KEYS[name]
        low, high = spark.read.format("jdbc").options(**self.source(), query=f'SELECT MIN("{key}") AS low, MAX("{key}") AS high FROM {name}').load().first()
        return None if low is None else (low, high)

    def read(self, spark: SparkSession, name: str, parts: int = 8) -> DataFrame:
        """A table with its declared schema, in `parts` ranges between the least and the greatest key there is."""
        source, found = self.source() | {"dbtable": name}, self.bounds(spark, name)
        if found and found[0] < found[1] and parts > 1:
            source |= {"partitionColumn": KEYS[name], "lowerBound": str(found[0]), "upperBound": str(found[1] + 1), "numPartitions": str(parts)}
        return declared(spark.read.format("jdbc").options(**source).load(), TABLES[name])

    def write(self, name: str, rows: DataFrame, mode: str = "append", connections: int = 8) -> None:
        """Add rows (mode append), or put them in place of the table (overwrite). Arrays become texts, as JSON."""
        schema = TABLES[name]
        texts = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name).cast(f.dataType) for f in schema.fields]
        kinds = ", ".join(f"{f.name} VARCHAR(255)" for f in schema.fields if isinstance(f.dataType, StringType) and f.name not in LONG)
        writer = rows.select(*texts).write.format("jdbc").options(**self.source(), dbtable=name, numPartitions=str(connections))
        writer.options(createTableColumnTypes=kinds, truncate="true").mode(mode).save()  # a table that is emptied keeps its constraints

    def create(self, spark: SparkSession) -> None:
        """The three tables, empty. Those that exist stay as they are."""
        for name, schema in TABLES.items():
            self.write(name, spark.createDataFrame([], schema), "ignore")
