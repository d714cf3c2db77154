"""CSV text as a grid of cells: quoted separators and line breaks, in files of any number of blocks.

A file is read as lines, block by block. Whether a quote is open where a block begins depends
on all blocks before it, so each block first says how it ends if it begins open and if it begins
closed, and how many records begin in it either way. These few rows, one per block, are carried
forward in the order of the blocks. Then every block is cut into records on its own; only the
pieces of records that cross a block's edge are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplylens.session import checkpointed

_LINES = ["value", "source_file", "block"]


def _closed(line: str, at: int) -> int:
    """The place after the quote that closes the cell begun before ``at``; -1 if none does."""
    while (at := line.find('"', at)) >= 0 and line.startswith('""', at):
        at += 2
    return at + 1 if at >= 0 else -1


def open_after(line: str, sep: str, opened: bool) -> bool:
    """Whether a quote is open at the end of a line. A quote opens only at the beginning of a cell."""
    at = 0
    while True:
        if opened:
            at = _closed(line, at)
            if at < 0:
                return True
            at = line.find(sep, at)
            if at < 0:
                return False
            at += len(sep)
        if not line.startswith('"', at):
            at = line.find(sep + '"', at)
            if at < 0:
                return False
            at += len(sep)
        opened, at = True, at + 1


def cells_of(record: str, sep: str) -> list[str]:
    """The cells of one record; what follows a closing quote belongs to its cell."""
    out, at = [], 0
    while True:
        if record.startswith('"', at):
            end = _closed(record, at + 1)
            if end < 0:
                return [*out, record[at + 1:].replace('""', '"')]
            stop = record.find(sep, end)
            out.append(record[at + 1:end - 1].replace('""', '"') + (record[end:] if stop < 0 else record[end:stop]))
            if stop < 0:
                return out
            at = stop + len(sep)
        else:
            stop = record.find(sep + '"', at)
            if stop < 0:
                return out + record[at:].split(sep)
            out += record[at:stop].split(sep)
            at = stop + len(sep)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of batches that lie in one block of one file, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files = batch.column("source_file").dictionary_encode()
        place, block = files.indices.to_numpy(), batch.column("block").to_numpy()
        edges = np.flatnonzero((place[1:] != place[:-1]) | (block[1:] != block[:-1])) + 1
        for start, stop in zip([0, *edges], [*edges, batch.num_rows]):
            yield (files.dictionary[int(place[start])].as_py(), int(block[start])), batch.slice(start, stop - start)


def _quoted(part: pa.RecordBatch) -> np.ndarray:
    """Places of lines that hold a quote; all others leave a record as it is."""
    return np.flatnonzero(pc.match_substring(part.column("value"), '"').to_numpy(zero_copy_only=False))


def _scan(sep: str):
    """One row for each block: the end and the number of records, for both ways it may begin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_LINES[1:], "quotes", "open_if_closed", "open_if_open", "records_if_closed", "records_if_open"]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, quotes, *state, *begun)], names)

        key = None
        for own, part in _runs(batches):
            if own != key:
                if key:
                    yield row()
                key, quotes, state, begun, fresh = own, False, [False, True], [0, 0], True
            lines, last = part.column("value"), -1
            for i in [*_quoted(part).tolist(), part.num_rows]:
                for way in (0, 1):
                    begun[way] += 0 if state[way] else i - last - 1
                if i < part.num_rows:
                    quotes, line = True, lines[i].as_py()
                    if fresh and i == 0 and own[1] == 0:
                        line = line.removeprefix("﻿")
                    for way in (0, 1):
                        begun[way] += not state[way]
                        state[way] = open_after(line, sep, state[way])
                last = i
            fresh = False
        if key:
            yield row()
    return run


def _cut(sep: str, edges: bool):
    """Records of whole blocks as cells, or (``edges``) pieces of the records that cross an edge of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(rows, cells) -> pa.RecordBatch:
            names = ["source_file", "source_row", "block", "cells" if not edges else "piece"]
            kind = pa.string() if edges else pa.list_(pa.string())
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(rows), pa.string()), pa.array(rows, pa.int64()),
                                               pa.array([key[1]] * len(rows), pa.int64()),
                                               cells if isinstance(cells, pa.Array) else pa.array(cells, kind)], names)

        def rest() -> Iterator[pa.RecordBatch]:
            """What is open at the end of a block: a piece, or a cell that the end of the file ends."""
            if held and closes and not edges:
                if not entered:
                    yield put([number], [cells_of("\n".join(held), sep)])
            elif held and edges and not closes:
                yield put([number], ["\n".join(held)])

        key, held, number, opened, entered, closes = None, [], 0, False, False, False
        for own, part in _runs(batches):
            if own != key:
                yield from rest()
                key, held = own, []
                number, entered = part.column("rows_before")[0].as_py(), part.column("open_before")[0].as_py()
                opened, fresh, closes = entered, True, part.column("last")[0].as_py()
            lines = part.column("value")
            if fresh and own[1] == 0:
                lines = pc.if_else(pa.array(np.arange(len(lines)) == 0), pc.replace_substring_regex(lines, "^﻿", ""), lines)
            fresh, last, rows, cells = False, -1, [], []
            for i in [*_quoted(part).tolist(), part.num_rows]:
                plain = lines.slice(last + 1, i - last - 1)
                if opened:
                    held += plain.to_pylist()
                elif len(plain):
                    if not edges:
                        if rows:
                            yield put(rows, cells)
                            rows, cells = [], []
                        yield put(range(number + 1, number + 1 + len(plain)), pc.split_pattern(plain, sep))
                    number += len(plain)
                if i < part.num_rows:
                    line = lines[i].as_py()
                    if not opened:
                        number, entered = number + 1, False
                    held.append(line)
                    opened = open_after(line, sep, opened)
                    if not opened:
                        if entered == edges:
                            rows.append(number)
                            cells.append("\n".join(held) if edges else cells_of("\n".join(held), sep))
                        held, entered = [], False
                last = i
            if rows:
                yield put(rows, cells)
        yield from rest()
    return run


def _joined(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [cells_of(x, sep) for x in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("source_file"), batch.column("source_row"), pa.array(cells, pa.list_(pa.string()))],
                                             ["source_file", "source_row", "cells"])
    return run


def csv_blocks(lines: DataFrame, sep: str) -> DataFrame:
    """One row per block of a file: whether it begins within a quote, and the records begun before it."""
    found = lines.mapInArrow(_scan(sep), "source_file string, block long, quotes boolean, open_if_closed boolean, open_if_open boolean, "
                                         "records_if_closed long, records_if_open long")
    order = Window.partitionBy("source_file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # a block either ends the same however it begins, or passes on its beginning, or turns it round
    fixed, turns = F.col("open_if_closed") == F.col("open_if_open"), (F.col("open_if_closed") & ~F.col("open_if_open")).cast("int")
    turned = found.withColumn("turns", F.sum(turns).over(order))
    since = F.coalesce(F.last("turns").over(before), F.lit(0)) - F.coalesce(F.last(F.when(fixed, F.col("turns")), ignorenulls=True).over(before), F.lit(0))
    start = F.coalesce(F.last(F.when(fixed, F.col("open_if_open")), ignorenulls=True).over(before), F.lit(False))
    known = turned.withColumn("open_before", start != (since % 2 == 1))
    records = F.when(F.col("open_before"), F.col("records_if_open")).otherwise(F.col("records_if_closed"))
    return known.select(
        "source_file", "block", "quotes", "open_before",
        F.when(F.col("open_before"), F.col("open_if_open")).otherwise(F.col("open_if_closed")).alias("open_after"),
        records.alias("records"), F.coalesce(F.sum(records).over(before), F.lit(0)).alias("rows_before"),
        F.lead(F.lit(False), 1, True).over(order).alias("last"))


def csv_records(spark: SparkSession, paths: str | list[str], sep: str = ";") -> DataFrame:
    """``source_file``, ``source_row`` (1-based number of the record in its file) and ``cells`` of CSV files.

    A quote opens at the beginning of a cell only, so ``5" pipe`` is text; within quotes ``""`` is
    a quote, and separators and line breaks (CR, LF or both, given back as LF) are text. Empty
    lines are records with one empty cell. A quote still open at the end of a file takes the rest
    of the file into its cell, if that begins in the file's last block; else it is an error, as a
    forgotten quote must not collect a large file in one cell.

    Files stay split: two passes read them, and the table that is broadcast in between has one
    row per block.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source_file"),
                                          F.col("_metadata.file_block_start").alias("block"))
    blocks = checkpointed(csv_blocks(lines, sep))
    crossing = F.col("open_before") | (F.col("open_after") & ~F.col("last"))
    state = blocks.agg(F.bool_or(crossing).alias("crossing"),
                       F.min(F.when(F.col("last") & F.col("open_after") & (F.col("records") == 0), F.col("source_file"))).alias("broken")).first()
    if state.broken:
        raise ValueError(f"a quote is not closed in {state.broken}")
    known = F.broadcast(blocks.select("source_file", "block", "open_before", "rows_before", "last"))
    schema = "source_file string, source_row long, block long, cells array<string>"
    records = lines.join(known, ["source_file", "block"]).mapInArrow(_cut(sep, False), schema).drop("block")
    if not state.crossing:
        return records
    edges = F.broadcast(blocks.where(crossing).select("source_file", "block", "open_before", "rows_before", "last"))
    pieces = (lines.join(edges, ["source_file", "block"]).mapInArrow(_cut(sep, True), schema.replace("cells array<string>", "piece string"))
              .groupBy("source_file", "source_row").agg(F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("pieces"))
              .select("source_file", "source_row", F.array_join("pieces.piece", "\n").alias("piece")))
    return records.unionByName(pieces.mapInArrow(_joined(sep), "source_file string, source_row long, cells array<string>"))
