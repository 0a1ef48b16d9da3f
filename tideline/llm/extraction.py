"""Operator 1: the main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks (``blocks.py``); a bidirectional LSTM in numpy
reads their tag-path and hashed-word vectors in page order, so each block is
labelled in the context of the whole page (``labeller.py``); the blocks labelled
main text are joined.  The labeller is trained on the driver, on a documented
number of generated pages, and travels to the tasks as its weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import parse
from .common import table
from .labeller import TRAIN_PAGES, Labeller, trained, vectors

#: Pages that are parsed and labelled at once in a task.
GROUP = 256
THRESHOLD = 0.5


def main_texts(pages: list[str | None], model: Labeller, threshold: float = THRESHOLD) -> list[str]:
    blocks = [parse(p) for p in pages]
    found = model.probabilities([vectors(b) for b in blocks])
    return ["\n".join(b.text for b, p in zip(own, ps, strict=True) if p > threshold) for own, ps in zip(blocks, found, strict=True)]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars``, a row for each row of ``pages``.

    A null or empty page, and one without main text, has an empty text; text
    outside any element is a block like others; unclosed elements end where
    the HTML rules or the page end them, and a tag that never ends takes the rest
    of the page with it.  Long and deeply nested pages take memory in proportion
    to their length; repeated rows are rows of their own, and an empty table
    gives none.  Other columns are not read.
    """
    model = trained(train_pages)

    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), GROUP):
                part = batch.iloc[a : a + GROUP]
                texts = main_texts(list(part["html"]), model)
                yield pd.DataFrame({"page_id": part["page_id"].astype("Int64"), "url": part["url"], "text": texts}).assign(n_chars=[len(t) for t in texts])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInPandas(run_task, "page_id long, url string, text string, n_chars long")


def op1_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
