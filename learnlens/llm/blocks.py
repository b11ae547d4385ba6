"""Blocks of rows, and what is looked up for each block.

A block is a run of rows of one file, named by the file and the row numbers, so it is the same however a file is cut into
tasks. What a task needs for a block is written to the shared folder as a partition of its own and read when the block comes
by. So a scan can use shuffled results without its own texts being shuffled, and a task holds one block's results.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from learnlens.llm.token_planes import open_folder
from learnlens.sources.scratch import new_path, written

BLOCK_ROWS = 4096


def in_files(docs: DataFrame) -> DataFrame:
    """The documents as rows of files, written to the shared folder if they are anything else."""
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return written(docs, "documents")


def block(rows: int = BLOCK_ROWS) -> Column:
    return F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / rows))


def row_in_block(rows: int = BLOCK_ROWS) -> Column:
    return F.pmod(F.col("_metadata.row_index"), F.lit(rows)).cast("int")


def write_blocks(df: DataFrame, name: str) -> str:
    """Writes ``df``, which has a column block, as a partition per block; the folder."""
    folder = new_path(df.sparkSession, name)
    df.repartition("block").write.partitionBy("block").parquet(folder)
    return folder


def read_block(folder: str, name: int, columns: list[str]) -> pa.Table | None:
    """The columns of one block, or None where nothing was written for it."""
    system, root = open_folder(folder)
    path = f"{root}/block={name}"
    if system.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    return pads.dataset(path, filesystem=system, format="parquet").to_table(columns=columns).combine_chunks()
