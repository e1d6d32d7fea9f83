"""What host suffix arrays alone find of the articles: the figures in the README.

python tests/llm/suffix_array_figures.py [folder of the tables] prints precision and recall of the article's tokens and
the number of pages whose text comes out exactly.
"""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from netloom.llm.html import page_blocks, unique_runs  # noqa: E402


def all_blocks(page: str | None) -> list[str]:
    """The blocks of a page whose elements say nothing: every element with a meaning is a plain division."""
    import re

    plain = re.sub(r"<(/?)(?:article|main|nav|footer|aside|header|form)\b[^>]*>", r"<\1div>", page or "")
    return page_blocks(re.sub(r"<div\s[^>]*>", "<div>", plain))[1]


def figures(pages: DataFrame, depth: int = 8) -> tuple[float, float, int, int]:
    """(precision, recall, exact pages, pages) of the tokens that suffix arrays keep against the articles' tokens."""
    spark = pages.sparkSession
    rows = [(r["page_id"], r["url"].split("/")[2], all_blocks(r["html"]), " ".join(page_blocks(r["html"])[1])) for r in pages.collect()]
    df = spark.createDataFrame(rows, "row long, host string, blocks array<string>, want string")
    kept = {r["row"]: r["text"] for r in unique_runs(df.drop("want"), depth).select("row", F.replace("text", F.lit("\n\n"), F.lit(" ")).alias("text")).collect()}
    both = found = wanted = exact = 0
    for row, _, _, want in rows:
        x, y = Counter(kept.get(row, "").split()), Counter(want.split())
        both, found, wanted = both + (x & y).total(), found + x.total(), wanted + y.total()
        exact += kept.get(row, "") == want
    return both / found, both / wanted, exact, len(rows)


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    print("precision %.3f, recall %.3f, %d of %d pages exactly" % figures(session.read.parquet(f"{folder}/pages.parquet")))
