"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds lengths in (C/(k+1), C/k], and a bin of class k
takes exactly k pieces.  Each worker fills the bins of every class on its own, so packing needs no shuffle and
no count of anything beyond the worker.  Documents may be cut: whole multiples of C are bins by themselves, and
a rest that would leave its class's bins more than ``1 - fill`` empty gives up a piece of exactly the next
reciprocal, floor(C/(k+1)).  Pieces under C/M share bins by next-fit, as in Harmonic-M.  When a worker's rows
end, the pieces of its open bins are refilled in order and cut at bin ends, so a worker leaves one partly
filled sequence at most.

Sequence ids are (partition number << 33) + a number within the partition; give it a scan or a written table,
whose partitions are the same if a task is run again.

Defined results: a null or empty text is the end mark alone; repeated rows are packed each; texts of any
length are read whole; other columns of the input are not returned; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .token_count import byte_symbols
from .words import small_batches

CAPACITY, CLASSES, FILL = 2048, 32, 0.96


#: The pattern by which byte-level vocabularies of this kind split text before merging (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextIds:
    """Ids (little-endian 32-bit) of a text as the ``tokenizers`` library gives them.

    Texts with a special string, and any vocabulary whose splitting or merges aren't the plain byte-level kind,
    go to that library itself. All others are encoded by ``tiktoken`` over the same vocabulary, which gives the
    same ids (tests compare the two) in a quarter of the time.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(vocabulary)
        whole = json.loads(vocabulary)
        self.specials = [t["content"] for t in whole["added_tokens"]]
        self.fast = self._same_by_ranks(whole)

    def _same_by_ranks(self, whole: dict):  # noqa: ANN202
        import tiktoken

        split, model = whole.get("pre_tokenizer") or {}, whole["model"]
        plain = whole.get("normalizer") is None and whole.get("post_processor") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        plain = plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.specials}
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if not plain or [vocab[m] for m in made] != list(range(256, 256 + len(made))):
            return None
        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(x in text for x in self.specials):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()


#: Encoders of this worker process, by the vocabulary's checksum; they outlive its tasks.
_ENCODERS: dict[int, TextIds] = {}


def cuts(n: int, capacity: int = CAPACITY, classes: int = CLASSES, fill: float = FILL) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens, in order."""
    out, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        k = capacity // rest
        if k >= classes or k * rest >= fill * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class Packer:
    """Bins of one worker. Pieces are (row, start, length); what is placed goes to ``done`` as
    (row, start, length, sequence, offset)."""

    def __init__(self, base: int, capacity: int = CAPACITY, classes: int = CLASSES) -> None:
        self.base, self.capacity, self.classes = base, capacity, classes
        self.next, self.open, self.done = 0, {}, []

    def close(self, pieces: list[tuple]) -> None:
        sequence, offset = self.base + self.next, 0
        self.next += 1
        for row, start, length in pieces:
            self.done.append((row, start, length, sequence, offset))
            offset += length

    def add(self, row: object, start: int, length: int) -> None:
        k = min(self.capacity // length, self.classes)
        waiting = self.open.setdefault(k, [])
        if k == self.classes and sum(p[2] for p in waiting) + length > self.capacity:
            self.close(waiting)
            waiting = self.open[k] = []
        waiting.append((row, start, length))
        if len(waiting) == k and k < self.classes:
            self.close(self.open.pop(k))

    def finish(self) -> None:
        room, pieces = self.capacity, []
        for row, start, length in [p for k in sorted(self.open) for p in self.open[k]]:
            while length:
                part = min(length, room)
                pieces.append((row, start, part))
                start, length, room = start + part, length - part, room - part
                if not room:
                    self.close(pieces)
                    room, pieces = self.capacity, []
        if pieces:
            self.close(pieces)
        self.open = {}


def pack(df: DataFrame, vocabulary: str, end_id: int = 1, text: str = "text", key: str = "doc_id", with_ids: bool = True, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids.

    ``vocabulary`` is the path of a byte-level tokenizer file; its text (about 1.5 MB, fixed) is broadcast.
    """
    with open(vocabulary, encoding="utf-8") as f:
        known = df.sparkSession.sparkContext.broadcast(f.read())
    out = T.StructType([T.StructField(key, df.schema[key].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    if with_ids:
        out = out.add("ids", T.BinaryType())
    end = array("I", [end_id]).tobytes()  # four bytes, little-endian on all hosts Spark runs on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = zlib.crc32(known.value.encode())
        if name not in _ENCODERS:
            _ENCODERS[name] = TextIds(known.value)
        encode = _ENCODERS[name]
        packer = Packer(TaskContext.get().partitionId() << 33, capacity)

        def placed() -> pa.RecordBatch:
            rows, packer.done = packer.done, []
            part = [r[0][1][4 * (r[1] - r[0][3]) : 4 * (r[1] - r[0][3] + r[2])] for r in rows]
            columns = [[r[0][0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [zlib.crc32(x) for x in part], [r[0][2] for r in rows], [r[3] for r in rows], [r[4] for r in rows]]
            columns += [part] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=out.names)

        types = None
        for big in batches:
            types = types or [big.schema.field(0).type, *[pa.int64()] * 6] + [pa.binary()] * with_ids
            for batch in small_batches(big, 1, 4 << 20):
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = encode(value or "") + end
                    start, n = 0, len(ids) // 4
                    for length in cuts(n, capacity):
                        # a waiting piece keeps its own ids only: (key, ids, tokens of the document, start of these ids)
                        packer.add((name, ids[4 * start : 4 * (start + length)], n, start), start, length)
                        start += length
                if packer.done:
                    yield placed()
        packer.finish()
        if packer.done:
            yield placed()

    return df.select(F.col(key), F.col(text)).mapInArrow(run, out)
