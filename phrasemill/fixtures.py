"""Input views derived from the driver's tables, in SQL that Spark and DuckDB run alike (see FIXTURES.md)."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from phrasemill.session import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings")


def _views() -> dict[str, str]:
    found: dict[str, str] = {}
    for file in sorted((Path(__file__).parent / "views").glob("*.sql")):
        found[file.stem] = file.read_text()
    return found


def sql(name: str) -> str:
    return _views()[name]


def base_tables(text: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", text)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or one of the driver's tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = sql(name)
    return spark.sql(_braced(text), **{t: spread(view(spark, sf_dir, t)) for t in base_tables(text)})


def _braced(text: str) -> str:
    text = text.replace("{", "{{").replace("}", "}}")
    for t in base_tables(text):
        text = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}} {t}", text)
    return text


def with_views(names: list[str], query: str) -> str:
    """The query for DuckDB, the views in front of it."""
    return "with " + ",\n".join(f"{n} as (\n{sql(n)})" for n in names) + "\n" + query
