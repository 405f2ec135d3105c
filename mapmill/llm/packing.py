"""Packing documents into sequences: first-fit decreasing in randomised groups.

Texts become token ids in Arrow batches. A document is cut into pieces of at most ``capacity``
ids; the documents go to groups drawn at random from their ids and contents, and each group is packed by
itself: pieces in decreasing length, each into the first bin that has room. A tournament tree
over the bins' free room finds that bin in log time. The number of groups follows from the
number of documents, and copies of one row are counted before they are dealt, at most ``group_docs`` to a group,
so a group stays small however large the table is. Only piece records
(and the ids, if asked for) are shuffled, never texts.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
END_ID = 1
#: Documents meant for one group.
GROUP_DOCS = 4096
# Fixed value: the pre-token pattern of byte-level BPE files.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict = {}


class Encoder:
    """Ids of texts by a byte-level BPE file of the ``tokenizers`` library.

    Where the file's ids follow the order of its merges, as is usual, the merges are run by
    ``tiktoken``, which gives the same ids in a third of the time. Texts that hold the string of an
    added token or are too much for its pattern, and files of another kind, are left to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = self._fast(json.loads(self.tok.to_str()))

    @staticmethod
    def _fast(spec: dict):
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        if not plain or model.get("ignore_merges"):
            return None
        # Bytes stand for themselves if they print, and else as the characters from 256 on, in order.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocab, merges = model["vocab"], model["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        if [vocab.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
            return None
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i < 256 + len(pairs)}
        return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(t in text for t in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its pattern has a limit for long runs of white space
                pass
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def piece_records(docs: DataFrame, tokenizer_path: str, capacity: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """One record for each piece of at most ``capacity`` ids."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, doc_crc32 long" + (", ids array<int>" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            rows: dict[str, list] = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": [], "doc_crc32": []}
            ids_out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(enc.encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                whole = zlib.crc32(ids.tobytes())
                for s in range(0, len(ids), capacity):
                    part = ids[s : s + capacity]
                    for k, v in zip(rows, (doc_id, s, len(part), zlib.crc32(part.tobytes()), len(ids), whole), strict=True):
                        rows[k].append(v)
                    if with_ids:
                        ids_out.append(part.astype(np.int32))
            cols = [pa.array(v, pa.int64()) for v in rows.values()]
            if with_ids:
                cols.append(pa.array(ids_out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[*rows, *["ids"] * with_ids])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, schema)


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given order, by a tournament tree of free room.

    A leaf holds the room of one bin, an inner node the larger room of its two children; walking
    down to the left child whenever it has room reaches the first bin that fits.
    """
    n = len(lengths)
    size = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * size)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for k, need in enumerate(lengths.tolist()):
        i = 1
        while i < size:
            i *= 2
            if tree[i] < need:
                i += 1
        bins[k], offsets[k] = i - size, capacity - tree[i]
        tree[i] -= need
        while i > 1:
            i //= 2
            left, right = tree[2 * i], tree[2 * i + 1]
            room = left if left >= right else right
            if tree[i] == room:
                break
            tree[i] = room
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    group_docs: int = GROUP_DOCS,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 17,
) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Each document's ids, with the end id after them, lie in exactly one piece each; a sequence
    holds at most ``capacity`` ids and has no gaps. A null text is an empty one: one piece with
    the end id. A null id is an id like others. Repeated rows are packed as often as they stand. Pieces of equal length keep the
    order (id, start). Texts are encoded whole, however long, runs of white space included. An empty table gives an empty result.
    Only the two named columns are read.
    ``with_ids`` adds the ids of each piece as an array.
    """
    groups = max(1, -(-docs.count() // group_docs))
    recs = piece_records(docs, tokenizer_path, capacity, with_ids, id_col, text_col)
    fields = [c for c in recs.columns if c != "doc_crc32"]
    same = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_crc32"]
    if with_ids:
        recs = recs.withColumn("_h", F.xxhash64("ids")).groupBy(*same, "_h").agg(F.count(F.lit(1)).alias("times"), F.first("ids").alias("ids"))
    else:
        recs = recs.groupBy(*same).agg(F.count(F.lit(1)).alias("times"))
    # Copies of one row are dealt in lots.
    recs = recs.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / group_docs))))
    recs = recs.withColumn("times", F.least(F.lit(group_docs), F.col("times") - F.col("lot") * group_docs).cast("int"))
    recs = recs.select(*fields, "times", F.pmod(F.xxhash64("doc_id", "doc_crc32", "lot", F.lit(seed)), F.lit(groups)).alias("grp"))

    def fit(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.repeat(np.arange(len(table)), table.column("times").to_numpy())))
        length, start = (table.column(c).to_numpy() for c in ("length", "start"))
        doc = table.column("doc_id").fill_null(-(1 << 62)).to_numpy()
        order = np.lexsort((start, doc, -length))
        bins, offsets = first_fit(length[order], capacity)
        out = table.take(pa.array(order))
        seq = out.column("grp").to_numpy() * (1 << 32) + bins
        return out.select(fields).append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in recs.select(*fields).schema.fields] + ["sequence_id long", "offset long"])
    return recs.groupBy("grp").applyInArrow(fit, schema)
