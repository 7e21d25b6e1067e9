"""The filter exchange: which hashes also occur in another document?

Documents are dealt into blocks by a hash of their id. A block, or a batch of documents, asks about each
distinct hash once, whatever the number of its documents that hold it, so that a passage in a third of all
documents costs one row a batch; the part of the hash space that a hash belongs to answers the blocks
that asked. One row is one hash: their number grows with the text, whatever the number of blocks and parts.

A hash that is met everywhere doesn't gather in one part: who asks about a hash it knows to be shared is answered in a part of
its own choice (BOTH), and the hash's own part hears of it once a task (KNOWS).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, text_of
from .hashing import first_of_runs, released

#: Bytes of text in a block, and so about the hashes in a part: what one task holds.
BLOCK_BYTES = 8 << 20
#: What a question says besides its block (``asked`` is 4 * block and this): ASKS wants to hear if the hash is shared, KNOWS has seen it
#: in two documents; BOTH is heard again for certain, and tells nobody else.
ASKS, KNOWS, BOTH = 1, 2, 3
QUESTION = "asked int, hash long"
ANSWER = "block int, hash long"


def block_count(documents: DataFrame) -> int:
    total = documents.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    return blocks_for(total, BLOCK_BYTES, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def blocked(documents: DataFrame, blocks: int) -> DataFrame:
    """doc_id, text, block: dealt by doc_id, or by text where that is null."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return documents.select("doc_id", text_of().alias("text"), F.pmod(key, F.lit(blocks)).cast("int").alias("block"))


def by_hash(rows: DataFrame, parts: int, answer, schema: str) -> DataFrame:
    """``answer`` on all rows of each part of the hash space. Rows carry no part number: they are dealt by the hash itself, those whose answer is certain by the asking block too."""
    place = F.col("hash")
    if "asked" in rows.columns:
        place = F.when(F.col("asked") % 4 == BOTH, F.xxhash64("hash", "asked")).otherwise(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if own := list(batches):
            yield from answer(pa.Table.from_batches(own)).to_batches()
        del own
        released()

    return rows.repartition(parts, place).mapInArrow(run, schema)


def _elsewhere(table: pa.Table) -> pa.Table:
    """The blocks that asked about a hash that two documents hold."""
    asked, hash_ = table["asked"].to_numpy(), table["hash"].to_numpy()
    order = np.lexsort((asked, hash_))
    asked, hash_ = asked[order], hash_[order]
    block, say = asked >> 2, asked & 3
    if not len(block):
        return pa.table({"block": pa.array(block, pa.int32()), "hash": pa.array(hash_, pa.int64())})
    new = first_of_runs(hash_)
    starts = np.flatnonzero(new)
    shared = (np.diff(np.append(starts, len(hash_))) > 1) | (np.maximum.reduceat(say, starts) >= KNOWS)
    told = shared[np.cumsum(new) - 1] & (say & ASKS > 0)
    block, hash_ = block[told], hash_[told]
    once = first_of_runs(hash_) | first_of_runs(block)
    return pa.table({"block": pa.array(block[once]), "hash": pa.array(hash_[once])})


def answered(questions: DataFrame, parts: int) -> DataFrame:
    return by_hash(questions, parts, _elsewhere, ANSWER)
