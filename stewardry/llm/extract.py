"""Main text of web pages: a recurrent labeller reads the sequence of a page's blocks and keeps the article's.

Pages are cut into blocks in tasks, in Arrow batches, and never shuffled. The labeller is fitted once, on the driver, on a fixed
number of made-up pages of many layouts whose words are those of a bounded sample of the pages themselves; it is then read by
all tasks. A page is labelled as a whole, whatever its length, so that each block is judged by what stands before and after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.llm.blocks import blocks
from stewardry.llm.labeller import Labeller, fit

#: Pages that lend their words to the made-up ones (those of the smallest hashes), and words of each.
SAMPLE_PAGES, SAMPLE_WORDS = 200, 1000
#: Blocks and pages that are labelled at once: what a task holds beside one page.
GROUP_BLOCKS, GROUP_PAGES = 1 << 13, 256


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for page in batch.column("html").to_pylist():
            words: list[str] = []
            for text in blocks(page or "").texts:
                words += text.split()
                if len(words) >= SAMPLE_WORDS:
                    break
            found.append(words[:SAMPLE_WORDS])
        yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(found, pa.list_(pa.string()))], names=["h", "words"])


def sample_words(pages: DataFrame, html_col: str = "html") -> list[str]:
    """Words of up to SAMPLE_PAGES different pages, up to SAMPLE_WORDS of each, in the order of the pages' hashes."""
    hashed = pages.select(F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html"))
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]
    if not least:
        return []
    taken = hashed.where(F.col("h") <= least[-1]).groupBy("h").agg(F.first("html").alias("html"))
    return [w for r in taken.mapInArrow(_words, "h long, words array<string>").orderBy("h").collect() for w in r.words]


def main_texts(model: Labeller, pages: Sequence[str]) -> list[str]:
    """The kept blocks of each page, a line each."""
    read = [blocks(p) for p in pages]
    filled = [p for p in read if p.texts]
    if not filled:
        return [""] * len(read)
    kept = iter(model.scores(np.concatenate([p.cells for p in filled]), np.array([len(p.texts) for p in filled])) > 0)
    return ["\n".join([text for text in p.texts if next(kept)]) for p in read]


def _extracted(model: Labeller) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, at, out = batch.column("html"), 0, []
            while at < len(pages):
                group, size = [], 0
                while at + len(group) < len(pages) and len(group) < GROUP_PAGES and size < 64 * GROUP_BLOCKS:
                    group.append(pages[at + len(group)].as_py() or "")
                    size += len(group[-1])
                out += main_texts(model, group)
                at += len(group)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    return extract


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: Sequence[str] = ("url",), model: Labeller | None = None) -> DataFrame:
    """One row per row of `pages`: the id, the columns of `keep`, text, n_chars (code points).

    Blocks keep the order of the page and stand on a line each; character references are decoded, and white space inside a block
    (also a no-break space) is one space. Null, empty and textless pages give an empty text. Repeated rows and ids are pages of
    their own; columns other than those named don't matter whatever their names, `keep` may be of any type, and an empty table
    gives an empty result. Markup that breaks off is read as a browser does: an unfinished tag, comment or script has no text.
    """
    model = model or fit(sample_words(pages, html_col))
    rows = pages.select(F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)]).alias("row"), F.col(html_col).alias("html"))
    found = rows.mapInArrow(_extracted(model), f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return found.select(F.col("row.id").alias(id_col), *[F.col(f"row.k{k}").alias(c) for k, c in enumerate(keep)], "text", F.length("text").cast("long").alias("n_chars"))
