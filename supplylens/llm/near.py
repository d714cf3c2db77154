"""MinHash near-duplicates: an inverted join on signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplylens.llm import textarrays as T
from supplylens.llm.graph import components
from supplylens.llm.store import Workspace

COORDINATES = 64
_SLICE = 1 << 16
LETTERS = T.separators(T.SPACES)


def _odd(n: int, seed: int) -> np.ndarray:
    return T.mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


_FACTORS, _SHIFTS = _odd(COORDINATES, 1), _odd(COORDINATES, 2)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[T.Chunk, np.ndarray, np.ndarray]]:
    """Chunks with their rows' distinct shingle hashes and the bounds of each row's set.

    A row with fewer words than ``width`` has its whole sequence as one shingle; a row
    without words has none.
    """
    for chunk in T.chunks(column):
        chunk.data = T.lower(chunk.data)
        words = T.words(chunk, LETTERS)
        count = np.diff(words.first)
        rolling = T.Rolling(T.of_bytes(chunk.data).spans(words.starts, words.ends))
        size = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
        row = np.repeat(np.arange(chunk.n), size)
        first = words.first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        hashes = rolling.spans(first, np.minimum(first + width, words.first[1:][row]))
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
        new = np.ones(len(row), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        row, hashes = row[new], hashes[new]
        yield chunk, hashes, np.searchsorted(row, np.arange(chunk.n + 1))


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = batch.column("h")
            for chunk, hashes, bounds in shingle_sets(batch.column("text"), width):
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                at = bounds[:-1][full]
                signature = np.zeros((len(full), COORDINATES), np.int32)
                keys = np.zeros((2, chunk.n), np.uint64)
                if len(full):
                    for k in range(COORDINATES):
                        values = ((hashes * _FACTORS[k] + _SHIFTS[k]) >> np.uint64(32)).astype(np.uint32)
                        signature[:, k] = np.minimum.reduceat(values, at).view(np.int32)
                    keys[0, full] = np.add.reduceat(hashes, at)
                    keys[1, full] = np.add.reduceat(T.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                lengths = np.zeros(chunk.n, np.int32)
                lengths[full] = COORDINATES
                at32 = np.zeros(chunk.n + 1, np.int32)
                np.cumsum(lengths, out=at32[1:])
                part = slice(chunk.first, chunk.first + chunk.n)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[part], hashed[part], pa.array(size.astype(np.int64)),
                    pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at32), pa.array(signature.ravel()))],
                    ["doc_id", "h", "n_shingles", "k1", "k2", "signature"])
    return run


def _confirmed(width: int, percent: int):
    """Pairs of texts whose full sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                sides = []
                for name in ("text_a", "text_b"):
                    distinct = part.column(name).dictionary_encode()
                    sets = [hashes[bounds[r]:bounds[r + 1]] for chunk, hashes, bounds in
                            shingle_sets(distinct.dictionary, width) for r in range(chunk.n)]
                    sides.append((distinct.indices.to_numpy(), sets))
                (left, a), (right, b) = sides
                keep = []
                for x, y in zip(left, right, strict=True):
                    both = len(np.intersect1d(a[x], b[y], assume_unique=True))
                    keep.append(100 * both >= percent * (len(a[x]) + len(b[y]) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _agreement(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda total, v: total + v)


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80,
                    matches: int = 36, stars: int = 2) -> DataFrame:
    """Components of documents whose shingle sets reach ``percent`` of Jaccard similarity.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Returns one row per input
    row: ``doc_id, n_shingles, component_id, kept``.

    Every document posts its signature under (coordinate, value). A pair at the threshold agrees
    in about ``percent`` % of the 64 coordinates and is sought if it agrees in ``matches``: with
    0.8 and 36 a pair on the very threshold is missed with a probability of about 1e-5, a pair
    at 0.85 with less than 1e-8.

    * Prefix: a pair with ``matches`` agreements shares one among any 64 - ``matches`` + 1
      coordinates, so only the rarest ones of a document are posted; values that no other
      document has need no posting.
    * Skip: a document with fewer than ``matches`` shared values is left out, and lists whose
      members are all in one component are not merged again.
    * Merging: in each list the member with the most common values is the centre, and the others
      are compared with it, first by counting agreements, then on the full sets. After ``stars``
      such rounds the members of lists that still hold several components are compared on the
      rarest shingles of their full sets (``_refined``), an exact bound on what two sets can
      share. A large group of copies so costs comparisons in proportion to its size, and copies
      with many edits of their own cost none.

    Equal sets are one class from the start and are never paired. Text that is null, empty or
    without words has no shingles and is linked with nothing. Rows without a ``doc_id`` keep a
    null component and are not kept. Repeated rows have the same result; rows that give one id
    several texts are one document that has the links of each.
    """
    work = Workspace(spark, "near")
    posted = COORDINATES - matches + 1
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h"))
    rows = work.keep(docs.mapInArrow(
        _signatures(width), "doc_id long, h long, n_shingles long, k1 long, k2 long, signature array<int>"))
    sets = work.keep(rows.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2")
                     .agg(F.min(F.struct("doc_id", "h")).alias("first"), F.first("n_shingles").alias("n"),
                          F.first("signature").alias("signature"))
                     .select("k1", "k2", F.col("first.doc_id").alias("rep"), F.col("first.h").alias("h"), "n", "signature"))

    # (coordinate, value) as one key, with the number of sets that have it
    values = sets.select("rep", "n", F.posexplode("signature").alias("c", "v")).select(
        "rep", "n", (F.col("c").cast("long") * (1 << 32) + F.col("v") + (1 << 31)).alias("key"))
    shared = work.keep(values.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    # a set with u values of its own has posted its first u coordinates: they meet nobody
    lists = (values.join(shared, "key").groupBy("rep", "n")
             .agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("keys"))
             .where(F.size("keys") >= matches))
    postings = work.keep(lists.select(
        "rep", "n", F.aggregate("keys", F.lit(0.0), lambda total, k: total + F.log2(k["df"])).alias("weight"),
        F.explode(F.slice("keys", 1, posted - COORDINATES + F.size("keys"))).alias("k"))
        .select("rep", "n", "weight", F.col("k.key").alias("key")))

    members = postings.select("rep").distinct()
    texts = work.keep(docs.withColumnRenamed("doc_id", "rep")
                      .join(sets.join(members, "rep").select("rep", "h", "signature"), ["rep", "h"])
                      .dropDuplicates(["rep", "h"]))

    labels = members.withColumn("component", F.col("rep"))
    links = None
    tested = None
    for turn in range(stars + 1):
        open_lists = postings.join(labels, "rep")
        mixed = work.keep(open_lists.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                               F.max(F.struct("weight", (-F.col("rep")).alias("r"))).alias("top"))
                 .where("lo < hi").select("key", (-F.col("top.r")).alias("centre")))
        if turn < stars:
            pairs = open_lists.join(mixed, "key").select("rep", "n", "component", F.col("centre").alias("c"))
            other = sets.select(F.col("rep").alias("c"), F.col("n").alias("cn")).join(
                labels.select(F.col("rep").alias("c"), F.col("component").alias("cc")), "c")
            pairs = pairs.distinct().join(other, "c").where("component <> cc")
        else:
            left = open_lists.join(mixed, "key").select("rep", "component").distinct()
            pairs = _refined(left, texts, width, percent, work)
        pairs = (pairs.where("100 * least(n, cn) >= %d * greatest(n, cn)" % percent)
                 .select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).where("a < b").distinct())
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = work.keep(_agreeing(pairs, texts, matches))
        if not pairs.head(1):
            if turn < stars:
                continue
            break
        found = work.keep(_with_texts(pairs, texts).mapInArrow(_confirmed(width, percent), "a long, b long"))
        tested = pairs if tested is None else tested.union(pairs)
        links = found if links is None else links.union(found)
        if turn == stars and not found.head(1):
            break
        joined = components(links, work)
        labels = work.keep(members.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
                           .select("rep", F.coalesce("component", "rep").alias("component")))
    classes = (sets.select("k1", "k2", "rep").join(labels, "rep", "left")
               .select("k1", "k2", F.coalesce("component", "rep").alias("c")))
    found = F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id"))
    return (rows.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), found))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")))


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, hashes, bounds in shingle_sets(batch.column("text"), width):
                part, size = slice(chunk.first, chunk.first + chunk.n), np.diff(bounds)
                row = np.repeat(np.arange(chunk.n), size)
                for at in range(0, len(hashes), _SLICE):
                    some = pa.array(row[at:at + _SLICE])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("rep")[part].take(some), batch.column("h")[part].take(some),
                         pa.array(size).take(some), pa.array(hashes[at:at + _SLICE].view(np.int64))], ["rep", "h", "n", "s"])
    return run


def _refined(left: DataFrame, texts: DataFrame, width: int, percent: int, work: Workspace) -> DataFrame:
    """``rep, n, c, cn``: pairs of ``left`` from two components that their rarest shingles let reach the threshold.

    The shingles of a set are ordered from the rarest. If two sets first meet in a shingle with x
    and y of their shingles left from there on, they share no more than min(x, y); pairs for
    which this is too few are never made. Each shingle's most common component is not compared
    within itself.
    """
    rows = work.keep(texts.join(left.select("rep"), "rep").select("rep", "h", "text").mapInArrow(
        _shingles(width), "rep long, h long, n long, s long"))
    shared = work.keep(rows.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"))
    rank = F.row_number().over(Window.partitionBy("rep", "h").orderBy(F.desc("df"), F.desc("s")))
    prefix = rows.join(shared, "s").select("rep", "n", "s", rank.alias("rest")).where(f"100 * rest >= {percent} * n")
    prefix = work.keep(prefix.join(left, "rep"))
    heads = work.keep(prefix.groupBy("s", "component").agg(F.count("*").alias("m"), F.min("n").alias("n"))
                      .groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"),
                                        F.max(F.struct("m", "component")).alias("top"))
                      .where("lo < hi").select("s", "least", F.col("top.component").alias("main")))
    met = work.keep(prefix.join(heads, "s").where(f"{100 + percent} * rest >= {percent} * (n + least)")
                    .select("s", "rep", "n", "rest", "component", (F.col("component") == F.col("main")).alias("inside")))
    x, y = met.where("not inside").alias("x"), met.alias("y")
    return x.join(y, F.expr(
        f"x.s = y.s and x.component <> y.component and (y.inside or x.rep < y.rep) "
        f"and {100 + percent} * least(x.rest, y.rest) >= {percent} * (x.n + y.n) "
        f"and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")).select(
        "x.rep", "x.n", F.col("y.rep").alias("c"), F.col("y.n").alias("cn"))


def _agreeing(pairs: DataFrame, texts: DataFrame, matches: int) -> DataFrame:
    side = texts.select("rep", "signature")
    return (pairs.join(side.toDF("a", "sa"), "a").join(side.toDF("b", "sb"), "b")
            .where(_agreement("sa", "sb") >= matches).select("a", "b"))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = texts.select("rep", "text")
    return pairs.join(side.toDF("a", "text_a"), "a").join(side.toDF("b", "text_b"), "b")
