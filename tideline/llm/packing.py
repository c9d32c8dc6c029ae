"""Mixture-controlled packing of documents into fixed-length token sequences.

Documents wait in one queue per source. Deficit round-robin serves the queues: in every round a queue may
send its share of a window of tokens, what rounding leaves over is carried to its next round, and an
empty queue's share falls to the others. A document is cut where its queue's turn or a sequence ends, so
every sequence but the last is full, and every window holds the target proportions for as long as the
queues last.

After ``r`` rounds queue ``q`` has sent ``min(total, floor(share * r))`` tokens. That closed form is the carried
deficit, and it is all that tasks need to know of one another: with the queues' totals and a document's
place in its queue, every task computes where its tokens go. So there is no serial pass; the two
shared facts are sums over (queue, partition) counts.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import materialise

#: Characters that the two tokenizer libraries split alike; other texts go to ``tokenizers`` alone.
ALIKE = re.compile("[\t\n\r\x20-\x7e¡-ſ]*")

#: Fixed-point digits of the shares, in bits.
BITS = 10


class Encoder:
    """Token ids of texts, by ``tokenizers`` from its file.

    ``ranks``, the same byte-level vocabulary as a rank file with its split ``pattern``, lets ``tiktoken`` give the
    same ids faster for texts of common characters and without special tokens.
    """

    def __init__(self, file: str, ranks: str | None = None, pattern: str | None = None):
        self.file, self.ranks, self.pattern = file, ranks, pattern
        self.slow = self.fast = None

    def _load_slow(self):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(self.file)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]

    def _load_fast(self):
        import tiktoken

        with open(self.ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.slow is None:
            self._load_slow()
        if self.ranks and ALIKE.fullmatch(text) and not any(s in text for s in self.special):
            if self.fast is None:
                self._load_fast()
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def tokenised(docs: DataFrame, key: str, text: str, queue: str, encoder: Encoder, end_id: int | None) -> DataFrame:
    """(key, queue, part, at, n, ids): the ids of every document and its place among its partition's share of a queue.

    Ids are little-endian, 16-bit where all of them fit, which ``wide`` tells. Null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sent = TaskContext.get().partitionId(), {}
        for batch in batches:
            ats, sizes, wides, ids = [], [], [], []
            for name, content in zip(batch.column(2).to_pylist(), batch.column(1), strict=True):
                found = encoder.ids(content.as_py() or "")
                if end_id is not None:
                    found = np.append(found, np.uint32(end_id))
                at, n = sent.get(name, 0), len(found)
                sent[name] = at + n
                wide = bool(n and found.max() > 0xFFFF)
                ats.append(at)
                sizes.append(n)
                wides.append(wide)
                ids.append(found.astype("<u4" if wide else "<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([part] * len(ids), type=pa.int32()),
                    pa.array(ats, type=pa.int64()),
                    pa.array(sizes, type=pa.int64()),
                    pa.array(wides, type=pa.bool_()),
                    pa.array(ids, type=pa.binary()),
                ],
                names=[key, queue, "part", "at", "n", "wide", "ids"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {queue} int, part int, at long, n long, wide boolean, ids binary"
    return docs.select(key, text, queue).mapInArrow(run, schema)


def places(queue: int, start: int, length: int, totals: np.ndarray, shares: np.ndarray) -> list[tuple[int, int, int]]:
    """(offset in the document, length, place in the output) of the runs of tokens ``start ..`` of a queue."""

    def sent(rounds: int) -> np.ndarray:
        return np.minimum(totals, (shares * rounds) >> BITS)

    out, at = [], start
    share = int(shares[queue])
    while at < start + length:
        turn = (((at + 1) << BITS) + share - 1) // share - 1  # the round in which token ``at`` is sent
        before, after = sent(turn), sent(turn + 1)
        end = min(start + length, int(after[queue]))
        base = int(after[:queue].sum() + before[queue + 1 :].sum())
        out.append((at - start, end - at, base + at))
        at = end
    return out


def pack(
    docs: DataFrame,
    key: str,
    text: str,
    source: str,
    weights: Mapping[str, float],
    rest: float,
    encoder: Encoder,
    length: int = 2048,
    window: int = 64,
    end_id: int | None = 1,
    broadcast: int = 1_000_000,
) -> DataFrame:
    """A row per piece: key, queue, doc_tokens, start, length, sequence_id, offset, ids (32-bit little-endian binary).

    ``weights`` are the target token proportions of the named sources; all others, null too, share one
    queue of weight ``rest``. All must be positive. A window is ``window`` sequences of ``length`` tokens. ``end_id``
    closes every document; null and empty texts are just that token. Within a queue, documents keep the
    order in which they are read; repeated rows are packed again; an empty table gives no rows. Extra
    columns are ignored. The ids are written once to the shared folder and not shuffled: up to ``broadcast``
    (queue, partition) sums are sent to the tasks, more of them are joined.
    """
    names = [*weights]
    total_weight = sum(weights.values()) + rest
    if min([*weights.values(), rest]) <= 0:
        raise ValueError("weights must be positive")
    shares = np.array([max(1, round(w / total_weight * window * length * 2**BITS)) for w in (*weights.values(), rest)])
    number = F.lit(len(names))
    for i, name in enumerate(names):
        number = F.when(F.col(source) == name, i).otherwise(number)
    own = docs.select(key, text, number.cast("int").alias("queue"))
    ids = materialise(tokenised(own, key, text, "queue", encoder, end_id), "ids")
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ids.groupBy("queue", "part").agg(F.sum("n").alias("sum"))
    before = materialise(
        sums.select("queue", "part", "sum", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before")), "sums"
    )
    found = {r["queue"]: r["total"] for r in before.groupBy("queue").agg(F.sum("sum").alias("total")).collect()}
    totals = np.array([found.get(i, 0) for i in range(len(shares))], dtype=np.int64)
    side = before.select("queue", "part", "before")
    if before.count() <= broadcast:
        side = F.broadcast(side)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, (q, at, n, wide, raw) in enumerate(
                zip(batch["queue"], batch["at"] + batch["before"], batch["n"], batch["wide"], batch["ids"], strict=True)
            ):
                tokens = np.frombuffer(raw, dtype="<u4" if wide else "<u2")
                for begin, size, place in places(q, int(at), int(n), totals, shares):
                    while size:
                        room = min(size, length - place % length)
                        piece = tokens[begin : begin + room].astype("<u4").tobytes()
                        rows.append((row, q, n, begin, room, place // length, place % length, piece))
                        begin, size, place = begin + room, size - room, place + room
            out = pd.DataFrame(
                rows, columns=["row", "queue", "doc_tokens", "start", "length", "sequence_id", "offset", "ids"]
            )
            out.insert(0, key, batch[key].to_numpy()[out["row"].to_numpy(dtype=np.int64)])
            yield out.drop(columns=["row"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, queue int, doc_tokens long, start long, length long, sequence_id long, offset long, ids binary"
    return ids.join(side, ["queue", "part"]).mapInPandas(run, schema)
