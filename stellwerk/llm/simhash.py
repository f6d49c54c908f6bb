"""Near-duplicates by SimHash fingerprints and an inverted index of their bytes.

Two 64-bit fingerprints that differ in at most four bits agree in at least four of their
eight bytes: that is the guaranteed minimum of matches. The index has one posting list for
each choice of four byte positions and the bytes there, so the members of a list have reached
the minimum; what is left is to verify the number of differing bits. (Lists of a single byte
would each hold a 256th of all fingerprints, and tallying them would take quadratic work.)

A list is linked up where it lies: its members are compared pair by pair in vectors, and only
a spanning star of each group found goes out. Lists longer than ``LIST_LIMIT`` go another
exact way: two fingerprints differ in at most four bits if and only if some value lies within
two bits of both, so every member is listed under all such values (in the bits that the list
leaves free), and the members listed under one value are linked to its first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.llm.common import free_names
from stellwerk.llm.components import components
from stellwerk.session import materialise

BITS, WORDS, SEED = 4, 4, 42
#: Lists up to this length are compared pair by pair.
LIST_LIMIT = 4096
_CHOICES = list(combinations(range(8), 4))


def fingerprint(text: bytes) -> int:
    """The fingerprint of one UTF-8 text, as a signed number.

    A-Z are lower-cased, words lie between ASCII white space, shingles are WORDS words joined by
    a space (all words, if fewer); a bit is set if more than half of the shingles' hashes set it.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return int.from_bytes(xxhash.xxh64_digest(joined, SEED), "big", signed=True)
    starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words]))).tolist()
    digest = xxhash.xxh64_digest
    n, counts = len(words) - WORDS + 1, np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):  # in blocks, so that a very long text needs no more memory
        block = starts[k : min(n, k + (1 << 15)) + WORDS]
        hashes = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(block, block[WORDS:])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, fp (signed 64 bits) for every row; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of each fingerprint: number of the choice, and the four bytes chosen."""
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for k in range(0, len(fps), 4096):
            block = np.ascontiguousarray(fps[k : k + 4096])
            octets = block.view(np.uint8).reshape(-1, 8)
            keys = [
                (np.int64(c) << 32) | np.ascontiguousarray(octets[:, at]).view(np.uint32).ravel().astype(np.int64)
                for c, at in enumerate(_CHOICES)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.tile(block, len(_CHOICES)))], names=["key", "fp"]
            )


def _stars(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each list (rows sorted by key), reduced to a star per linked group."""
    label = np.arange(len(fps))
    left, right = [], []
    at, shift = label, 1
    while True:
        at = at[at < len(fps) - shift]
        at = at[keys[at] == keys[at + shift]]
        if not len(at):
            break
        linked = at[np.bitwise_count((fps[at] ^ fps[at + shift]).view(np.uint64)) <= BITS]
        left.append(linked)
        right.append(linked + shift)
        shift += 1
    if left:
        i, j = np.concatenate(left), np.concatenate(right)
        while len(i) and (label[i] != label[j]).any():
            least = np.minimum(label[i], label[j])
            np.minimum.at(label, i, least)
            np.minimum.at(label, j, least)
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _link_lists(limit: int):
    """Over postings sorted by key: (a, b, null) for links, (fp, null, choice) for members of long lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, long_key = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in _with_end(batches):
            if batch is not None:
                keys = np.concatenate((keys, batch.column(0).to_numpy()))
                fps = np.concatenate((fps, batch.column(1).to_numpy()))
            if not len(keys):
                continue
            # Complete lists only; the last one may go on in the next batch, unless it is long already.
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            long = (sizes > limit) | (keys[starts] == (long_key if long_key is not None else -1))
            ready = len(keys) if batch is None or long[-1] else starts[-1]
            long_rows = np.repeat(long, sizes)[:ready]
            long_key = keys[-1] if long[-1] else None
            several = np.repeat(sizes > 1, sizes)[:ready] & ~long_rows
            a, b = _stars(keys[:ready][several], fps[:ready][several])
            hot, choice = fps[:ready][long_rows], keys[:ready][long_rows] >> 32
            if len(a) or len(hot):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((a, hot))),
                        pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(hot), pa.int64())]),
                        pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(choice, pa.int64())]),
                    ],
                    names=["a", "b", "choice"],
                )
            keys, fps = keys[ready:], fps[ready:]

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _values_between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All values within two bits of a member, in the bits that its list leaves free."""
    flips = {}
    for batch in batches:
        fps, choices = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for c in np.unique(choices):
            if c not in flips:
                free = [np.int64(1) << np.int64(8 * p + k) for p in range(8) if p not in _CHOICES[c] for k in range(8)]
                flips[c] = np.array([0, *free, *(x ^ y for x, y in combinations(free, 2))], np.int64)
            own = fps[choices == c]
            for k in range(0, len(own), 512):
                block = own[k : k + 512]
                values = (block[:, None] ^ flips[c][None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), c)), pa.array(values), pa.array(np.repeat(block, len(flips[c])))],
                    names=["choice", "value", "fp"],
                )


def _to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (choice, value, fp): links each row to the first of its value."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        choice, value, fp = (batch.column(k).to_numpy() for k in range(3))
        fresh = np.concatenate(([True], (choice[1:] != choice[:-1]) | (value[1:] != value[:-1])))
        head = fp[np.maximum.accumulate(np.where(fresh, np.arange(len(fp)), 0))]
        if last is not None and last[:2] == (choice[0], value[0]):
            first_run = np.cumsum(fresh) == 1
            head = np.where(first_run, last[2], head)
        last = (choice[-1], value[-1], head[-1])
        linked = head != fp
        yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(head[linked])], names=["a", "b"])


def links(fps: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Distinct fingerprints (column fp) -> edges a, b that connect exactly what is within BITS bits."""
    postings = fps.select("fp").mapInArrow(_post, "key bigint, fp bigint")
    found = materialise(
        postings.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_lists(list_limit), "a bigint, b bigint, choice bigint")
    )
    between = (
        found.where("choice IS NOT NULL")
        .select("a", "choice")
        .mapInArrow(_values_between, "choice bigint, value bigint, fp bigint")
        .repartition("choice", "value")
        .sortWithinPartitions("choice", "value", "fp")
        .mapInArrow(_to_first, "a bigint, b bigint")
    )
    return found.where("choice IS NULL").select("a", "b").union(between).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_limit: int = LIST_LIMIT) -> DataFrame:
    """``id_col``, fingerprint (16 hex digits), component_id (smallest id reachable) for every row.

    Documents are linked if their fingerprints differ in at most BITS bits; exact copies share
    a fingerprint and meet the index once. Null and empty texts share the fingerprint zero
    and are linked like any other. Repeated rows are kept and share a component; a null id is
    kept, and names a component only (as null) if no document in it has an id. Other columns
    are not read.
    """
    marked = materialise(fingerprints(docs, id_col, text_col))
    first = materialise(marked.groupBy("fp").agg(F.min("id").alias("first")))
    root = components(links(first, list_limit)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = first.join(root, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their component: one of each group of near-duplicates.

    Rows repeated under one id are copies of one document, of which one stays. A row without an
    id cannot be named, so such rows stay, once per text.
    """
    found = near_duplicates(docs, id_col, text_col)
    stay, rows, named = free_names(docs, "stay", "rows", "named")
    kept = found.groupBy(F.col(id_col).alias(stay)).agg(
        F.count("*").alias(rows), F.max(F.col(id_col).eqNullSafe(F.col("component_id"))).alias(named)
    )
    kept = materialise(kept.where(F.col(named) | F.col(stay).isNull()).select(stay, rows))
    # What stays grows with the documents, so the join is planned as a shuffle at every size.
    joined = docs.join(kept.hint("merge"), F.col(id_col).eqNullSafe(F.col(stay)))
    alone = joined.where(F.col(rows) == 1).drop(stay, rows)
    repeated = joined.where(F.col(rows) > 1).withColumn(named, F.when(F.col(id_col).isNull(), F.col(text_col)))
    return alone.union(repeated.dropDuplicates([id_col, named]).drop(stay, rows, named))
