"""Byte-pair encoding and decoding that encodes shared text once.

Texts are cut into content-defined chunks (the rolling hash of `substring`).
Chunks that occur once are encoded where they are read, neighbours together; a
document of such chunks alone is done there. Chunks that occur again are encoded
once for the whole corpus and joined back to the documents that hold them. The
joins are then repaired: ids beside a join are encoded again between the nearest
places where a token surely ends (white space after a letter or mark), further
out if the two sides do not end a token there, until both agree.

Which chunks occur again is told to the readers by a Bloom filter of bounded size;
a chunk wrongly taken for a shared one goes the longer way and comes out the same.
Documents with one text share all work: they are told apart by the text's digest.

Null texts count as empty. Repeated rows give one row each. An empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_filter, bloom_hits, saved, sliced, text_buffers
from .substring import cuts

MEAN_CHUNK = 512
#: Chunks of which a task remembers that it has handed their bytes on.
MOST_TOLD = 500_000
SPECIAL = "<|endoftext|>"


class ByteCoder:
    """Encodes UTF-8 bytes as the library does with the file at path.

    Texts of ASCII and Latin letters go to the faster library with the same merges
    and the same pattern; any other text to the one that reads the file, as its
    tables of letters may be of another Unicode version.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path) as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = self.whole.token_to_id(SPECIAL)
        ranks = {bytes(map(byte.__getitem__, word)): i for word, i in vocabulary.items() if i != special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: special})
        self.size = np.zeros(max(special, *ranks.values()) + 1, np.int64)
        for word, i in ranks.items():
            self.size[i] = len(word)
        self.size[special] = len(SPECIAL)

    def encode(self, data: bytes) -> list[int]:
        if not data:
            return []
        if data.isascii() or max(data) < 0xC9:  # no byte that begins a letter after U+023F
            return self.fast.encode(data.decode(), allowed_special={SPECIAL})
        return self.whole.encode(data.decode(), add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.fast.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> ByteCoder:
    return ByteCoder(path)


def safe(data: bytes, at: int) -> bool:
    """Whether a token surely ends at this byte: white space after a character that is none."""
    if at <= 0 or at >= len(data):
        return True
    here, last = data[at], data[at - 1]
    return (here == 32 or 9 <= here <= 13) and (33 <= last <= 126 or (last >= 128 and at > 1 and 0xC3 <= data[at - 2] <= 0xC8))


def joined(parts: list[np.ndarray], enc: ByteCoder) -> tuple[np.ndarray, bytes]:
    """The ids of a text from those of its parts, each encoded by itself, and the text."""
    texts = [enc.fast.decode_bytes(p.tolist()) for p in parts]
    data = b"".join(texts)
    ends = [np.cumsum(enc.size[p]) for p in parts]
    base = np.cumsum([0, *(len(t) for t in texts)])
    # every id's end in the text; a join is repaired from the last sure end before it to the first after it
    every = np.concatenate([e + b for e, b in zip(ends, base)]) if parts else np.zeros(0, np.int64)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
    out, done = [], 0  # done: bytes that out covers
    for join in base[1:-1].tolist():
        if join < done or join in (0, len(data)):
            continue
        a, b = join, join
        while True:
            while not safe(data, a):
                a -= 1
            while not safe(data, b):
                b += 1
            x, y = np.searchsorted(every, a), np.searchsorted(every, b)
            left, right = a in (0, done) or (x < len(every) and every[x] == a), b == len(data) or every[y] == b
            if left and right:
                break
            a, b = (a if left else a - 1), (b if right else b + 1)
        a = max(a, done)
        lo, hi = np.searchsorted(every, done, "right"), np.searchsorted(every, a, "right")
        out += [ids[lo:hi], np.array(enc.encode(data[a:b]), np.uint16)]
        done = b
    out.append(ids[np.searchsorted(every, done, "right") :] if done else ids)
    return np.concatenate(out), data


def digests(ids, enc: ByteCoder) -> tuple[int, str, str]:
    ids = np.asarray(ids, "<u4")
    return len(ids), sha256(ids.tobytes()).hexdigest(), sha256(enc.decode(ids.tolist()).encode()).hexdigest()


def _chunked(texts: pa.Array):
    """Bytes of all texts, text offsets, chunk edges and chunk digests (n, 2)."""
    data, offsets = text_buffers(texts)
    ends = cuts(data, offsets, MEAN_CHUNK, 64 * MEAN_CHUNK) if len(data) else np.zeros(0, np.int64)
    edges = np.concatenate([[0], ends])
    whole = data.tobytes()
    at = edges.tolist()
    found = np.frombuffer(b"".join([blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(at, at[1:])]), "<i8").reshape(-1, 2)
    return whole, offsets, edges, found


def _places(d1, d2):
    return d1, F.shiftrightunsigned(d1, 32), d2


def shared_filter(docs: DataFrame, text: str) -> np.ndarray:
    """The Bloom filter of the chunks that occur more than once, as 64-bit words."""

    def run(batches):
        for batch in sliced(batches, text):
            _, _, _, found = _chunked(batch.column(0))
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["d1", "d2"])

    again = docs.select(text).mapInArrow(run, "d1 long, d2 long").groupBy("d1", "d2").count().where("count > 1").select("d1", "d2")
    return bloom_filter(saved(again, "bpe-shared"), *_places(F.col("d1"), F.col("d2")))


FIELDS = "kind int, k1 long, k2 long, doc_id long, place int, d1 long, d2 long, data binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
DONE, DOCUMENT, OWN, SHARED = range(4)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; keep_ids: also ids (uint16, binary)."""
    spark = docs.sparkSession
    bloom = spark.sparkContext.broadcast(shared_filter(docs, text))
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, types[t]) for n, t in (f.split() for f in FIELDS.split(", "))])
    names = schema.names

    def read(batches):
        enc = coder(vocabulary)
        told: set[bytes] = set()  # chunks whose bytes this task has handed on
        for batch in sliced(batches, text):
            whole, offsets, edges, found = _chunked(batch.column(1))
            hot = bloom_hits(bloom.value, found[:, 0], (found[:, 0].view(np.uint64) >> np.uint64(32)).view(np.int64), found[:, 1])
            if len(told) > MOST_TOLD:
                told.clear()
            first = np.searchsorted(edges, offsets[:-1])
            last = np.searchsorted(edges, offsets[1:])
            rows: list[tuple] = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                a, b = int(offsets[i]), int(offsets[i + 1])
                x, y = int(first[i]), int(last[i])
                if not hot[x:y].any():
                    ids = enc.encode(whole[a:b])
                    rows.append((DONE, None, None, doc, None, None, None, np.array(ids, np.uint16).tobytes() if keep_ids else None, *digests(ids, enc)))
                    continue
                k1, k2 = np.frombuffer(blake2b(whole[a:b], digest_size=16).digest(), "<i8").tolist()
                rows.append((DOCUMENT, k1, k2, doc, *[None] * 7))
                begin = x
                for j in range(x, y + 1):
                    if j == y or hot[j]:
                        if begin < j:
                            own = np.array(enc.encode(whole[edges[begin] : edges[j]]), np.uint16)
                            rows.append((OWN, k1, k2, None, int(edges[begin]) - a, None, None, own.tobytes(), *[None] * 3))
                        if j < y:
                            d = found[j].tobytes()
                            rows.append((SHARED, k1, k2, None, int(edges[j]) - a, *found[j].tolist(), None if d in told else whole[edges[j] : edges[j + 1]], *[None] * 3))
                            told.add(d)
                        begin = j + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names)

    read_ = saved(docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(read, FIELDS), "bpe-pieces")

    def once(batches):
        enc = coder(vocabulary)
        for batch in batches:
            made = [np.array(enc.encode(d), np.uint16).tobytes() for d in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["d1", "d2", "ids"])

    pieces = read_.where(F.col("kind") == SHARED)
    known = pieces.groupBy("d1", "d2").agg(F.first("data", ignorenulls=True).alias("data")).mapInArrow(once, "d1 long, d2 long, ids binary")
    uses = pieces.select("k1", "k2", "place", "d1", "d2").distinct().join(known, ["d1", "d2"]).select("k1", "k2", "place", "ids")
    # documents with one text bring the same pieces: they meet as a set, so that ids are shuffled once
    own = read_.where(F.col("kind") == OWN).select("k1", "k2", "place", F.col("data").alias("ids"))
    texts = uses.unionByName(own).groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("place", "ids"))).alias("parts"))

    def join(batches):
        enc = coder(vocabulary)
        for batch in batches:
            ids, out = [], []
            for parts in batch.column(2).to_pylist():
                whole, _ = joined([np.frombuffer(p["ids"], np.uint16) for p in parts], enc)
                ids.append(whole.astype(np.uint16).tobytes() if keep_ids else None)
                out.append(digests(whole, enc))
            n, a, b = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["k1", "k2", "data", "n_tokens", "ids_sha256", "decoded_sha256"])

    made = texts.mapInArrow(join, "k1 long, k2 long, data binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
    result = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *([F.col("data").alias("ids")] if keep_ids else [])]
    done = read_.where(F.col("kind") == DONE).select(*result)
    shared = read_.where(F.col("kind") == DOCUMENT).select("k1", "k2", "doc_id").join(made, ["k1", "k2"]).select(*result)
    return done.unionByName(shared)
