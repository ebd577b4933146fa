"""Evaluation texts leaking into training text: a prefix-filtered set join on word shingles.

A leak is a run of at least ``run_words`` words that a document and a test item share. Each run holds ``run_words - q + 1`` shingles
of ``q`` words, all of them shared, so it is enough to look for one of them: for each window of an item the rarest shingle (by the
number of occurrences in the corpus) is the window's necessary prefix. Documents are scanned once; the scan keeps those that hold an
item's shingle at all. The prefix join then gives (document, item, alignment) candidates, positional bounds discard alignments in
which no window fits, and the words of the item-sized window are compared exactly.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import materialize

#: Zero-width spaces, joiners, byte order mark and soft hyphen: removed before words are read.
INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD])
WORD = re.compile("[a-z0-9]+")
#: Most bytes of item words and shingles that are shipped to every task; more items are taken in blocks, one scan each.
ITEM_BYTES = 64 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(INVISIBLE)
    return WORD.findall(text.lower())


def _shingles(ids: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code per position of an array of word numbers (0: a foreign word); 0 where a foreign word is inside."""
    if len(ids) < q:
        return np.zeros(0, np.uint64)
    code = np.zeros(len(ids) - q + 1, np.uint64)
    whole = np.ones(len(code), bool)
    for k in range(q):
        part = ids[k : k + len(code)].astype(np.uint64)
        whole &= part != 0
        code = (code ^ part) * _MIX
        code ^= code >> np.uint64(29)
    code[~whole] = 0
    return code


def _scanner(vocabulary: dict[str, int], wanted: np.ndarray, q: int):
    """Keep documents that hold a wanted shingle: the word numbers of their stretches around it, and the shingles' places."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            texts = batch.column(1).to_pylist()
            listed = [[number(w, 0) for w in words(t)] for t in texts]
            # One foreign word after each document keeps shingles inside documents.
            lengths = np.array([len(x) + 1 for x in listed])
            flat = np.fromiter((x for one in listed for x in (*one, 0)), np.int32, int(lengths.sum()))
            codes = _shingles(flat, q)
            spots = np.flatnonzero(codes)
            if len(spots):
                at = np.minimum(np.searchsorted(wanted, codes[spots]), len(wanted) - 1)
                spots = spots[wanted[at] == codes[spots]]
            ends = np.cumsum(lengths)
            owner = np.searchsorted(ends, spots, side="right")
            rows = np.unique(owner)
            starts = ends - lengths
            out = [[], [], [], []]
            for row in rows:
                mine = spots[owner == row]
                out[0].append(batch.column(0)[int(row)].as_py())
                out[1].append(flat[starts[row] : ends[row] - 1])
                out[2].append((mine - starts[row]).astype(np.int32))
                out[3].append(codes[mine].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.int64()))],
                ["doc_id", "words", "places", "shingles"],
            )

    return scan


def _longest(run_words: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, best, where = [], [], []
            for row in range(batch.num_rows):
                document = np.asarray(batch.column("words")[row].values)
                item = np.asarray(batch.column("item_words")[row].values)
                shift = batch.column("shift")[row].as_py()
                low, high = max(0, shift), min(len(document), shift + len(item))
                same = document[low:high] == item[low - shift : high - shift]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
                runs = edges[1::2] - edges[::2]
                if len(runs) and runs.max() >= run_words:
                    k = int(runs.argmax())
                    keep.append(row)
                    best.append(int(runs[k]))
                    where.append(int(low + edges[2 * k]))
            taken = batch.select(["doc_id", "item_id"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(best, pa.int32()), pa.array(where, pa.int32())], ["doc_id", "item_id", "run", "place"])

    return verify


def leaked_passages(documents: DataFrame, items: DataFrame, run_words: int = 10, q: int = 4) -> DataFrame:
    """Rows ``(doc_id, item_id, run, place)``: a document shares ``run`` >= ``run_words`` consecutive words with an item.

    ``documents``: ``doc_id, text``; ``items``: ``item_id, text``. One row per pair with its longest run and the word at which it
    starts. Null and empty texts hold no words and give nothing; an item under ``run_words`` words cannot leak. Repeated ids count
    once. Documents are unbounded. Items are held by every task, so they are dealt into blocks of ``ITEM_BYTES`` by their id, and the
    documents are scanned once per block; an item's rows do not depend on its block.
    """
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-24 * chars // ITEM_BYTES)
    if blocks < 2:
        return _leaked(documents, items, run_words, q)
    # Twice as many blocks as would do, since they are dealt by hash; written one by one, so that no plan grows with their number.
    block = F.pmod(F.xxhash64("item_id"), F.lit(2 * blocks))
    return reduce(DataFrame.union, (materialize(_leaked(documents, items.where(block == k), run_words, q)) for k in range(2 * blocks)))


def _leaked(documents: DataFrame, items: DataFrame, run_words: int, q: int) -> DataFrame:
    spark = documents.sparkSession
    vocabulary: dict[str, int] = {}
    listed: dict = {}
    for row in items.select("item_id", "text").toLocalIterator():
        if row.item_id not in listed:
            listed[row.item_id] = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(row.text)], np.int32)
    item_type, doc_type = items.schema["item_id"].dataType.simpleString(), documents.schema["doc_id"].dataType.simpleString()
    rows, windows = [], []
    for item, ids in listed.items():
        if len(ids) >= run_words:
            codes = _shingles(ids, q).view(np.int64)
            rows.append((item, ids.tolist()))
            windows += [(item, start, start + k, int(codes[start + k])) for start in range(len(ids) - run_words + 1) for k in range(run_words - q + 1)]
    wanted = np.unique(np.array([w[3] for w in windows], np.int64).view(np.uint64))
    if not len(wanted):
        return spark.createDataFrame([], f"doc_id {doc_type}, item_id {item_type}, run int, place int")
    scanned = documents.select("doc_id", "text").where("text is not null").mapInArrow(
        _scanner(vocabulary, wanted, q), f"doc_id {doc_type}, words array<int>, places array<int>, shingles array<long>"
    )
    held = materialize(scanned)
    found = held.select("doc_id", F.explode(F.arrays_zip("places", "shingles")).alias("x")).select("doc_id", F.col("x.places").alias("place"), F.col("x.shingles").alias("shingle"))
    rarity = found.groupBy("shingle").agg(F.count("*").alias("times"))
    item_side = spark.createDataFrame(windows, f"item_id {item_type}, start int, at int, shingle long")
    # A window one of whose shingles never occurs is absent: the inner join and the count drop it.
    prefix = (
        item_side.join(rarity, "shingle")
        .groupBy("item_id", "start")
        .agg(F.count("*").alias("present"), F.min_by(F.struct("shingle", "at"), F.struct("times", "at")).alias("p"))
        .where(F.col("present") == run_words - q + 1)
        .select("item_id", F.col("p.shingle").alias("shingle"), F.col("p.at").alias("at"))
        .distinct()
    )
    sized = spark.createDataFrame(rows, f"item_id {item_type}, item_words array<int>")
    lengths = sized.select("item_id", F.size("item_words").alias("item_length"))
    shapes = held.select("doc_id", F.size("words").alias("length"))
    candidates = (
        # At most one prefix for each window of a block of items, which ITEM_BYTES bounds: a shingle that half of the documents hold stays where it is.
        found.join(F.broadcast(prefix), "shingle")
        .select("doc_id", "item_id", (F.col("place") - F.col("at")).alias("shift"))
        .distinct()
        .join(lengths, "item_id")
        .join(shapes.groupBy("doc_id").agg(F.max("length").alias("length")), "doc_id")
        .where(F.least("length", F.col("shift") + F.col("item_length")) - F.greatest(F.lit(0), "shift") >= run_words)
    )
    texts = held.groupBy("doc_id").agg(F.first("words").alias("words"))
    verified = (
        candidates.select("doc_id", "item_id", "shift")
        .join(texts, "doc_id")
        .join(sized, "item_id")
        .mapInArrow(_longest(run_words), f"doc_id {doc_type}, item_id {item_type}, run int, place int")
    )
    return verified.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("run", "place"), F.struct("run", -F.col("place"))).alias("m")).select("doc_id", "item_id", "m.run", "m.place")
