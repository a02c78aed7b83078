"""BPE encoding and decoding with content-defined chunks that are encoded once.

A rolling hash over the bytes cuts texts where their content says so, so equal passages give equal chunks in all documents
that a task reads. A chunk is encoded once and its ids reused; a new chunk is put together from the pieces between its blanks, which are remembered
as well. A cut before a blank cannot change the ids; chunks that meet elsewhere are encoded again together, further and further out, until their ids agree with the ids of the parts on both sides.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Bits of the rolling hash that must be zero for a cut before a blank, and for one elsewhere: a chunk is four words on average.
BLANK_BITS, OTHER_BITS = 2, 12
#: Characters of chunks, ids and decoded texts that a worker remembers, half of them of pieces; beyond its half either memory starts anew.
MEMORY_CHARS = 32_000_000
#: Documents whose new chunks are encoded together.
BATCH = 64

# How the vocabulary's file says texts are cut into words, and what that is for lower-cased ASCII.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = re.compile(rb"[ \n][^ \n]*|[^ \n]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
_ASCII = re.compile(rb"[\t\n\r -~]*")

_TABLE = ((np.arange(256, dtype=np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


@cache
def _tokenizer(path: str) -> Tokenizer:
    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


@cache
def _lowers_words(path: str) -> bool:
    """The file lower-cases, cuts words by ``WORD_PATTERN`` and maps bytes, so ASCII words can go straight to its merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": WORD_PATTERN}
        and (cuts[0]["behavior"], cuts[0]["invert"], cuts[1]["add_prefix_space"], cuts[1]["use_regex"]) == ("Removed", True, False, False)
    )


def cut_points(data: np.ndarray, blank_bits: int = BLANK_BITS, other_bits: int = OTHER_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of cuts, and whether each stands before a space or line feed. The hash covers the eight bytes before."""
    mixed = _TABLE[data]
    for step, factor in ((1, 0x01000193), (2, 0x0100019B), (4, 0x010001B7)):
        mixed[step:] = mixed[step:] + mixed[:-step] * np.uint32(factor)
    before = np.zeros(len(data), np.uint32)
    before[1:] = mixed[:-1] >> np.uint32(8)
    blank = (data == 32) | (data == 10)
    other = (before & np.uint32((1 << other_bits) - 1)) == 0
    other &= (data & 0xC0) != 0x80  # never within a character
    at = np.flatnonzero((blank & ((before & np.uint32((1 << blank_bits) - 1)) == 0)) | other)
    at = at[at > 0]
    return at, blank[at]


class ChunkEncoder:
    """Ids and decoded text of whole texts from remembered chunks."""

    def __init__(self, path: str, blank_bits: int = BLANK_BITS, other_bits: int = OTHER_BITS) -> None:
        self.own = _tokenizer(path)
        self.bits = blank_bits, other_bits
        self.plain = _lowers_words(path)
        # Ids and decoded text of chunks and of pieces, apart from one another, so that rows of them are joined without a loop.
        self.known: dict[bytes, bytes] = {}
        self.known_shown: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.pieces_shown: dict[bytes, bytes] = {}
        self.chars = self.piece_chars = 0
        # Each id as bytes and each token after a space, made once.
        size = self.own.get_vocab_size()
        self.raw = [n.to_bytes(4, "little") for n in range(size)]
        self.tokens = [(" " + (self.own.id_to_token(n) or "")).encode() for n in range(size)]

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode new chunks: the pieces that start at their blanks, in a row."""
        cut = {chunk: PIECES.findall(chunk) for chunk in set(chunks).difference(self.known)}
        self._learn_pieces(set().union(*cut.values()))
        ids_of, shown_of = self.pieces.__getitem__, self.pieces_shown.__getitem__
        for chunk, pieces in cut.items():
            self.known[chunk] = ids = b"".join(map(ids_of, pieces))
            self.known_shown[chunk] = shown = b"".join(map(shown_of, pieces))
            self.chars += len(chunk) + len(ids) + len(shown)

    def _learn_pieces(self, pieces: set[bytes]) -> None:
        """Encode new pieces. ASCII goes word by word to the merges; others are the words of one call, each cut by itself."""
        new = []
        merge, raw_of, token_of = self.own.model.tokenize, self.raw, self.tokens
        for chunk in pieces.difference(self.pieces):
            if not self.plain or b"<|" in chunk or not _ASCII.fullmatch(chunk):
                new.append(chunk)
                continue
            words = ASCII_WORDS.findall(chunk.decode().lower())
            made = merge(words[0]) if len(words) == 1 else [t for word in words for t in merge(word)]
            numbers = [t.id for t in made]
            ids = b"".join([raw_of[n] for n in numbers])
            shown = b"".join([token_of[n] for n in numbers])
            self.pieces[chunk] = ids
            self.pieces_shown[chunk] = shown
            self.piece_chars += len(chunk) + len(ids) + len(shown)
        if not new:
            return
        got = self.own.encode([c.decode() for c in new], is_pretokenized=True, add_special_tokens=False)
        tokens = got.tokens
        raw = np.array(got.ids, "<u4").tobytes()
        edges = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(new) + 1)).tolist()
        for chunk, a, b in zip(new, edges[:-1], edges[1:], strict=True):
            shown = "".join([" " + t for t in tokens[a:b]]).encode()
            self.pieces[chunk] = raw[4 * a : 4 * b]
            self.pieces_shown[chunk] = shown
            self.piece_chars += len(chunk) + 4 * (b - a) + len(shown)

    def _of(self, chunk: bytes) -> bytes:
        if chunk not in self.known:
            self._learn([chunk])
        return self.known[chunk]

    def _repair(self, chunks: list[bytes], safe: list[bool]) -> list[bytes]:
        """Chunks whose ids in a row are those of the whole text; ``safe[k]`` tells of the join before chunk k + 1.

        At an unsafe join the run between the blanks around it is encoded whole. If that agrees with the ids of its parts the chunks
        stay; otherwise the run becomes a chunk. A part without a blank takes the run on to the next chunk.
        """
        out = [chunks[0]]
        k = 1
        while k < len(chunks):
            if safe[k - 1]:
                out.append(chunks[k])
                k += 1
                continue
            last = out.pop()
            cut = max(last.rfind(b" "), last.rfind(b"\n"), 0)
            parts, rest = [last[cut:]], b""
            joined = [last]
            while k < len(chunks) and not safe[k - 1] and not rest:
                ends = [x for x in (chunks[k].find(b" "), chunks[k].find(b"\n")) if x >= 0]
                stop = min(ends, default=len(chunks[k]))
                parts.append(chunks[k][:stop])
                rest = chunks[k][stop:]
                joined.append(chunks[k])
                k += 1
            run = b"".join(parts)
            if self._of(run) == b"".join(self._of(p) for p in parts):
                out += joined
            else:
                out += [c for c in (last[:cut], run, rest) if c]
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """``(ids as little-endian unsigned 32-bit, decoded UTF-8)`` of each text, as the tokenizer has them for the whole."""
        if self.chars > MEMORY_CHARS // 2:
            self.known.clear()
            self.known_shown.clear()
            self.chars = 0
        if self.piece_chars > MEMORY_CHARS // 2:
            self.pieces.clear()
            self.pieces_shown.clear()
            self.piece_chars = 0
        cut = []
        for text in texts:
            data = text.encode()
            at, safe = cut_points(np.frombuffer(data, np.uint8), *self.bits)
            edges = [0, *at.tolist(), len(data)]
            cut.append(([data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], safe))
        self._learn([c for chunks, _ in cut for c in chunks])
        ids_of, shown_of = self.known.__getitem__, self.known_shown.__getitem__
        out = []
        for chunks, safe in cut:
            if not safe.all():
                chunks = self._repair(chunks, safe.tolist())
                self._learn(chunks)
            ids = b"".join(map(ids_of, chunks))
            if self.own.decoder is None:  # tokens with single spaces between
                shown = b"".join(map(shown_of, chunks))[1:]
            else:
                shown = self.own.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False).encode()
            out.append((ids, shown))
        return out


@cache
def _encoder(path: str) -> ChunkEncoder:
    """One for all tasks of a worker."""
    return ChunkEncoder(path)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids, decoded)``, one row per row of ``docs``: the ids of each whole text as bytes, and their decoded text.

    ids are little-endian unsigned 32-bit integers. Null and empty texts have none and decode to an empty text. The memory of chunks is
    each worker's own, so no text is shuffled and no key can be hot. Columns other than doc_id and text are not read.
    """
    path = str(path or public_tokenizers.path("word_bpe_49k.json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            made: list[tuple[bytes, bytes]] = []
            for at in range(0, batch.num_rows, BATCH):
                made += encoder.encode([t or "" for t in batch.column(1)[at : at + BATCH].to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary()).cast(pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary, decoded string")


def digest(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
