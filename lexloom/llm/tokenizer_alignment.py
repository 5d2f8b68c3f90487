"""Operator 13: alignment of two tokenizers' tokens, scored by id-striped dense count matrices.

Both sides encode a text, the byte places where tokens of both end cut it into groups, and every
A token is linked with every B token of its group. A pair's count is the number of documents that
hold it linked; the B tokens of the highest count are an A id's best.

1. ``blocks``: documents are encoded in blocks of ``BLOCK_CHARS``. Pieces between single spaces are
   encoded and aligned once per worker and looked up after that. A block is one row with its
   documents' pieces and its pieces' links, and one row a stripe of A ids with the block's
   distinct pairs and the number of its documents that hold each. The rows are written once.
2. ``count``: the pairs are partitioned by stripe (A id modulo ``STRIPES``), in salts first if there
   are many, and added (``np.add.at``) into the stripe's dense block of A ids x B ids; row maxima give
   the best counts. A task holds one dense block, whatever streams through it.
3. ``score``: the blocks' pairs meet their stripe's counts in the same partitions and are answered
   with count and "is best"; a stripe with many blocks is salted, its counts copied to each salt.
4. ``align``: the answers return to their block, which sums them over pieces and documents.

Null and empty texts, and texts whose joined token bytes differ from space and text on either side, have no
tokens: zeros and an empty hash. Rows are documents: rows of one doc_id, or without one, are counted
apart. An empty table gives an empty result. Only ``id_col`` and ``text_col`` are read, so extra
columns of any name are harmless. Very long texts are a block of their own, cut into parts for sorting.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.bpe import byte_characters
from lexloom.llm.common import Tables, documents

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
STRIPES = 256
BLOCK_CHARS, BLOCK_DOCS = 3_000_000, 4000
#: Rows of a stripe that one task streams; stripes with more are salted.
STRIPE_ROWS = 4096
#: Pieces that a worker keeps, and links that are sorted at a time.
PIECES, PART = 400_000, 4_000_000

#: Single spaces between characters that no tokenizer takes for space: tokens never span them.
_EDGE = re.compile(r"(?<=[^\s᠎​﻿]) (?=[^\s᠎​﻿])")
_LOOSE = frozenset("᠎​﻿")

_packer, _unpacker = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def pack(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Compressed integers; bytes of equal weight stand together."""
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T
    return _packer.compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: str = "<u4") -> np.ndarray:
    raw = np.frombuffer(_unpacker.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, len(raw) // np.dtype(kind).itemsize).T).view(kind).ravel().astype(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Aligner:
    """Encodes and aligns pieces of text; keeps what it found of at most ``PIECES`` pieces."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        shown = {c: i for i, c in byte_characters().items()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(map(shown.get, token)) if set(token) <= shown.keys() else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.shown: list[str] = []
        # Per piece: A tokens, B tokens, groups, links; -1 A tokens if bytes differ.
        self.sizes = np.zeros((0, 4), np.int64)
        self.links = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def pieces(self, text: str) -> list[str]:
        """The text cut at single spaces, each of which is the piece's after it."""
        found = text.split(" ")
        for x in found:
            if not x or x[0].isspace() or x[-1].isspace() or x[0] in _LOOSE or x[-1] in _LOOSE:
                return _EDGE.split(text)
        return found

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' pieces, one text after the other, and how many each has."""
        if len(self.index) > PIECES:
            self.clear()
        index, new, flat, sizes = self.index, [], [], []
        for text in texts:
            found = self.pieces(text)
            for x in found:
                at = index.get(x)
                if at is None:
                    at = index[x] = len(index)
                    new.append(x)
                flat.append(at)
            sizes.append(len(found))
        for at in range(0, len(new), 50_000):
            self._add(new[at : at + 50_000])
        return np.array(flat, np.int64), np.array(sizes, np.int64)

    def _add(self, new: list[str]) -> None:
        """Encode and align new pieces, all at once."""
        spaced = [" " + x for x in new]
        a_ids = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b_ids = self.b.encode(new, num_threads=1)
        same = np.zeros(len(new), bool)
        a_get, b_get = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for k, (x, a, b) in enumerate(zip(spaced, a_ids, b_ids)):
            x = x.encode()
            same[k] = b"".join(map(a_get, a)) == x == b"".join(map(b_get, b))
            if not same[k]:
                a_ids[k] = b_ids[k] = ()
        a_len, b_len = (np.fromiter(map(len, ids), np.int64, len(new)) for ids in (a_ids, b_ids))
        a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (a_ids, b_ids))
        # Places count on through all pieces, so pieces end at common places too.
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        joint = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(joint, a_end), np.searchsorted(joint, b_end)
        a_in, b_in = np.bincount(a_group, minlength=len(joint)), np.bincount(b_group, minlength=len(joint))
        left = np.repeat(a, b_in[a_group])
        right = b[ranges((np.cumsum(b_in) - b_in)[a_group], b_in[a_group])]
        piece = np.repeat(np.arange(len(new)), a_len)  # of every A token
        group_piece = piece[np.cumsum(a_in) - 1] if len(joint) else np.zeros(0, np.int64)
        groups = np.bincount(group_piece, minlength=len(new))
        links = np.bincount(group_piece, a_in * b_in, minlength=len(new)).astype(np.int64)
        a_text, b_text, shown, p, q = list(map(str, a.tolist())), list(map(str, b.tolist())), [], 0, 0
        for m, n in zip(a_in.tolist(), b_in.tolist()):
            shown.append(f"{','.join(a_text[p : p + m])}|{','.join(b_text[q : q + n])}")
            p, q = p + m, q + n
        at = 0
        for n in groups.tolist():
            self.shown.append(";".join(shown[at : at + n]))
            at += n
        sizes = np.stack([np.where(same, a_len, -1), b_len, groups, links], 1)
        self.sizes = np.concatenate([self.sizes, sizes])
        self.starts = np.concatenate([self.starts, len(self.links) + np.cumsum(links) - links])
        self.links = np.concatenate([self.links, left * len(self.b_bytes) + right])


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner a Python worker; workers are reused across tasks."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def distinct(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def block(e: Aligner, number: int, ids: list, texts: list) -> list[dict]:
    """The rows of one block: the block itself and its stripes' pairs."""
    flat, pieces = e.places([t or "" for t in texts])
    doc = np.repeat(np.arange(len(texts)), pieces)
    sizes = e.sizes[flat]
    ok = np.array([bool(t) for t in texts]) & (np.bincount(doc, sizes[:, 0] < 0, minlength=len(texts)) == 0)
    totals = [np.where(ok, np.bincount(doc, sizes[:, k], minlength=len(texts)), 0).astype(np.int64).tolist() for k in range(4)]
    at, hashes, numbers = 0, [], flat.tolist()
    for good, n in zip(ok.tolist(), pieces.tolist()):
        hashes.append(hashlib.sha256(";".join([e.shown[i] for i in numbers[at : at + n]]).encode()).hexdigest() if good else "")
        at += n
    keep = ok[doc]
    kinds, flat = np.unique(flat[keep], return_inverse=True)
    doc, in_doc = doc[keep], np.where(ok, pieces, 0)
    width = e.sizes[kinds, 3]
    links = e.links[ranges(e.starts[kinds], width)]
    # Pairs in the order of their stripes: the stripe, the A id inside it, the B id.
    a, b = np.divmod(links, len(e.b_bytes))
    ordered = (a % STRIPES << 48) | (a // STRIPES << 24) | b
    pairs, links = np.unique(ordered, return_inverse=True)
    first = np.cumsum(width) - width
    held = np.zeros(len(pairs), np.int64)
    # Documents that hold each pair; parts bound what is sorted, and end with documents where they can.
    at, ends, doc_ends = 0, np.cumsum(width[flat]), np.cumsum(in_doc)
    open_doc, rest = -1, np.zeros(0, np.int64)
    while at < len(flat):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right"))
        stop = max(stop, at + 1)
        whole = doc_ends[max(0, np.searchsorted(doc_ends, stop, "right") - 1)]
        stop = int(whole) if at < whole <= stop else stop
        here = flat[at:stop]
        keys = np.repeat(doc[at:stop], width[here]) << 32 | links[ranges(first[here], width[here])]
        keys = distinct(keys if doc[at] != open_doc else np.concatenate([rest, keys]))
        open_doc, rest = -1, np.zeros(0, np.int64)
        if stop < len(flat) and doc[stop] == doc[stop - 1]:  # its last document goes on
            open_doc = int(doc[stop])
            cut = int(np.searchsorted(keys, open_doc << 32))
            keys, rest = keys[:cut], keys[cut:]
        np.add.at(held, keys & 0xFFFFFFFF, 1)
        at = stop
    rows = [
        {"block": number, "doc_ids": ids, "n_a": totals[0], "n_b": totals[1], "n_groups": totals[2], "n_links": totals[3], "hashes": hashes}
        | {"in_doc": pack(in_doc), "pieces": pack(flat), "width": pack(width), "links": pack(links), "n_pairs": len(pairs)}
    ]
    cuts = np.searchsorted(pairs, np.arange(STRIPES + 1) << 48)
    for s in range(STRIPES):
        if cuts[s] < cuts[s + 1]:
            own = pairs[cuts[s] : cuts[s + 1]]
            rows.append({"block": number, "stripe": s, "at": int(cuts[s]), "a": pack(own >> 24 & 0xFFFFFF, "<u2"), "b": pack(own & 0xFFFFFF, "<u2"), "n": pack(held[cuts[s] : cuts[s + 1]], "<u8")})
    return rows


_DOC_LISTS = [("doc_ids", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("hashes", pa.string())]
_BLOCK = pa.schema(
    [("block", pa.int64()), *((c, pa.list_(t)) for c, t in _DOC_LISTS), *((c, pa.binary()) for c in ("in_doc", "pieces", "width", "links")), ("n_pairs", pa.int64())]
    + [("stripe", pa.int32()), ("at", pa.int64()), *((c, pa.binary()) for c in ("a", "b", "n"))]
)
_BLOCK_SQL = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, hashes array<string>, "
    "in_doc binary, pieces binary, width binary, links binary, n_pairs long, stripe int, at long, a binary, b binary, n binary"
)
_OF_BLOCK = ["block", *(c for c, _ in _DOC_LISTS), "in_doc", "pieces", "width", "links", "n_pairs"]


def blocks(df: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of blocks and of their stripes' pairs. Numbers of blocks hold once the rows are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def close():
            return pa.RecordBatch.from_pylist(block(e, number, ids, texts), schema=_BLOCK)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and (size + len(text or "") > BLOCK_CHARS or len(texts) >= BLOCK_DOCS):
                    yield close()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(i)
                texts.append(text)
                size += len(text or "")
        if texts:
            yield close()

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, _BLOCK_SQL)


def _streamed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def count(pairs: DataFrame, rows: int, n_a: int, n_b: int) -> DataFrame:
    """(stripe, a, b, n, best) of all rows of pairs, one row a stripe; ``best`` marks an A id's highest counts."""
    arrow = pa.schema([("stripe", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary()), ("best", pa.binary())])
    depth = -(-n_a // STRIPES)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, open_key = np.zeros(0, np.int64), None

        def close():
            held = np.flatnonzero(dense)
            a, b = np.divmod(held, n_b)
            best = dense.reshape(depth, n_b).max(1)
            found = [[open_key[0]], [pack(a, "<u2")], [pack(b, "<u2")], [pack(dense[held], "<u8")], [pack(dense[held] == best[a], "<u1")]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, arrow.types)], schema=arrow)

        for batch in batches:
            for *key, a, b, n in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if key != open_key:
                    if open_key:
                        yield close()
                    dense, open_key = np.zeros(depth * n_b, np.int64), key
                np.add.at(dense, unpack(a, "<u2") * n_b + unpack(b, "<u2"), unpack(n, "<u8"))
        if open_key:
            yield close()

    salts = max(1, -(-rows // (STRIPES * STRIPE_ROWS)))
    schema = "stripe int, a binary, b binary, n binary, best binary"
    if salts > 1:
        salted = pairs.select("stripe", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"), "a", "b", "n")
        pairs = _streamed(salted, ["stripe", "salt"], []).mapInArrow(summed, schema)
    whole = pairs.select("stripe", F.lit(0).cast("long").alias("salt"), "a", "b", "n")
    return _streamed(whole, ["stripe"], []).mapInArrow(summed, schema)


def score(pairs: DataFrame, counts: DataFrame, rows: int, n_a: int, n_b: int) -> DataFrame:
    """(block, at, n, best): count and mark of every pair of every row of pairs."""
    arrow = pa.schema([("block", pa.int64()), ("at", pa.int64()), ("n", pa.binary()), ("best", pa.binary())])
    depth = -(-n_a // STRIPES)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = best = None
        for batch in batches:
            out: list[tuple] = []
            for number, at, a, b, n, marks in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "a", "b", "n", "best"))):
                place = unpack(a, "<u2") * n_b + unpack(b, "<u2")
                if number is None:  # the counts come before the stripe's blocks
                    dense, best = np.zeros(depth * n_b, np.int64), np.zeros(depth * n_b, np.uint8)
                    dense[place], best[place] = unpack(n, "<u8"), unpack(marks, "<u1")
                else:
                    out.append((number, at, pack(dense[place], "<u8"), pack(best[place], "<u1")))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(arrow.types)], schema=arrow)

    salts = max(1, -(-rows // (STRIPES * STRIPE_ROWS)))
    none = lambda kind: F.lit(None).cast(kind)
    asked = pairs.select("stripe", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"), "block", "at", "a", "b", none("binary").alias("n"), none("binary").alias("best"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    known = counts.select("stripe", each.alias("salt"), none("long").alias("block"), none("long").alias("at"), "a", "b", "n", "best")
    met = _streamed(asked.unionByName(known), ["stripe", "salt"], ["block"])
    return met.mapInArrow(answer, "block long, at long, n binary, best binary")


_RESULT = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())]


def settle(documents: DataFrame, answers: DataFrame) -> DataFrame:
    """Every document's sums, from its block and the answers to the block's pairs."""
    arrow = pa.schema(_RESULT)

    def sums(own: pa.Table, answers: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        n, best = np.zeros(row["n_pairs"], np.int64), np.zeros(row["n_pairs"], np.int64)
        for at, counts, marks in zip(*(answers[c].to_pylist() for c in ("at", "n", "best"))):
            counts = unpack(counts, "<u8")
            n[at : at + len(counts)], best[at : at + len(counts)] = counts, unpack(marks, "<u1")
        links, width, pieces, in_doc = (unpack(row[c]) for c in ("links", "width", "pieces", "in_doc"))
        found = []
        for value in (best, n):
            by_piece = np.diff(np.concatenate(([0], np.cumsum(value[links])))[np.concatenate(([0], np.cumsum(width)))])
            found.append(np.diff(np.concatenate(([0], np.cumsum(by_piece[pieces])))[np.concatenate(([0], np.cumsum(in_doc)))]))
        columns = [row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *found, row["hashes"]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    schema = ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in _RESULT)
    return documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(sums, schema)


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    tables, e = Tables(df.sparkSession), aligner(a_path, b_path)
    n_a, n_b = len(e.a_bytes), len(e.b_bytes)
    written = tables.write(blocks(df, a_path, b_path, id_col, text_col))
    pairs = written.where("stripe is not null").select("block", "stripe", "at", "a", "b", "n")
    rows = pairs.count()
    counts = tables.write(count(pairs, rows, n_a, n_b))
    return settle(written.where("stripe is null").select(*_OF_BLOCK), score(pairs, counts, rows, n_a, n_b)).withColumnRenamed("doc_id", id_col)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE))


QUERIES = {"op13_tokenizer_alignment": op13_tokenizer_alignment}
ORACLES: dict[str, str] = {}
