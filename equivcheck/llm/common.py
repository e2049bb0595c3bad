"""What several operators share: tables, words, splits by id and let-bindings."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the word rules: U+0020 and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless they find it on their Python path."""
    app = spark.sparkContext.applicationId
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if app in _shipped or str(_ROOT) in [*paths, os.getcwd()]:
        return
    name = f"{tempfile.mkdtemp(prefix='ship-')}/equivcheck.zip"
    with zipfile.PyZipFile(name, "w") as archive:
        for path in sorted((_ROOT / "equivcheck").rglob("*.py")):
            archive.write(path, path.relative_to(_ROOT))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's text modulo ``by``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def binary_text(text: Column) -> Column:
    """A text as UTF-8 bytes for Python tasks; null is empty."""
    return F.coalesce(text, F.lit("")).cast("binary")
