"""List extraction for SQL users."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tidings.fixed_values import IR_DATE_CLASS, IR_ITEM_SELECTORS
from tidings.functions import markup


def register(spark: SparkSession) -> None:
    """Make ``ir_links(body, base)`` available, an array for ``inline`` (UD6):
    ``SELECT c.url, l.* FROM captures c LATERAL VIEW inline(ir_links(c.body, c.url)) l``.

    Bodies go to Python in Arrow batches; table functions in Arrow form cannot
    stand in a lateral join.
    """
    @F.pandas_udf("array<struct<item_url:string,title:string,date_texts:array<string>>>")
    def ir_links(bodies: pd.Series, bases: pd.Series) -> pd.Series:
        pages = [markup.ir_items(body or "", base or "", IR_ITEM_SELECTORS, None, IR_DATE_CLASS, urljoin) for body, base in zip(bodies, bases)]
        return pd.Series([
            [{"item_url": i["url"], "title": i["title"], "date_texts": [page["texts"][d] for d in i["dates"]]} for i in page["items"]]
            for page in pages])

    spark.udf.register("ir_links", ir_links)
    spark.udtf.register("ir_pages", ir_pages)


#: Columns that :class:`ir_pages` adds.
FOUND = [StructField("item_url", StringType()), StructField("title", StringType()), StructField("date_texts", ArrayType(StringType()))]


@udtf
class ir_pages:
    """``SELECT * FROM ir_pages(TABLE(captures))``: the caller's columns but ``body``, and the items of each page (UD6).

    The result's columns follow from the table that is given; ``body`` and ``url``
    have to be among them. Rows are read where they are, without a shuffle.
    """

    @staticmethod
    def analyze(captures: AnalyzeArgument) -> AnalyzeResult:
        if not captures.isTable:
            raise ValueError("ir_pages takes a table: ir_pages(TABLE(captures))")
        given = captures.dataType
        missing = {"body", "url"} - set(given.names)
        if missing:
            raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
        return AnalyzeResult(StructType([f for f in given.fields if f.name != "body"] + FOUND))

    def eval(self, row: Row) -> Iterator[tuple]:
        page = markup.ir_items(row["body"] or "", row["url"] or "", IR_ITEM_SELECTORS, None, IR_DATE_CLASS, urljoin)
        kept = tuple(row[name] for name in row.__fields__ if name != "body")
        for item in page["items"]:
            yield *kept, item["url"], item["title"], [page["texts"][d] for d in item["dates"]]
