"""Operator 6, BPE encoding and decoding: content-defined chunks, encoded once a worker, and repaired where they join.

A rolling hash of the last eight bytes cuts a text wherever its low bits are zero, so equal passages give equal chunks
in whatever document they stand; a text without a cut is one chunk. A chunk is encoded once and kept. Where two chunks
join, the pieces beside the cut are encoded again, together with the first words of the second chunk, word by word,
until the new ids end with the ids which that chunk has for the same word. From there on both agree: a start of a
run of white space always begins a new piece of the tokenizer's pre-splitting, and pieces are encoded one by one.
A chunk with too few such starts becomes part of its join.

Nothing shuffles. A worker keeps at most `keep_bytes` of chunks. Ids are flat arrays throughout.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomgrade.llm.common import apart, append_columns, as_bytes, without
from loomgrade.session import table

MASK = (1 << 10) - 1
KEEP_BYTES = 32 << 20
LEAST = 256  # texts of less than twice as many bytes are one chunk
LONG_RUN = 1_000  # white space beyond which a run is taken out of the pre-splitting's way

#: Pre-splitting of the byte-level tokenizers. Fixed value: it must equal theirs for equal ids.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A start of a run of white space after another character. `\s` of the pattern is Unicode's White_Space.
SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
START = re.compile(f"(?<=[^{SPACES}])[{SPACES}]")
RUN = re.compile(f"[{SPACES}]{{{LONG_RUN},}}")
_WEIGHTS = [pow(0x9E3779B1, j + 1, 1 << 32) | 1 for j in range(8)]


def unicode_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE read from a tokenizers JSON file; special tokens in a text are recognised as that library does."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = unicode_bytes()
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if not any(t == a["content"] for a in spec["added_tokens"])}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for t, i in ranks.items():
            self.pieces[i] = t
        for t, i in self.special.items():
            self.pieces[i] = t.encode()

    def encode(self, text: str) -> list[int]:
        """Ids of a text. All of a long run of white space but its last character is one piece, as the pattern has it;
        before a special token or the end of a text, all of it. Such pieces are encoded directly, as the pattern's engine fails on them.
        """
        ids, last = [], 0
        for m in RUN.finditer(text) if len(text) >= LONG_RUN else ():
            whole = m.end() == len(text) or text.startswith(tuple(self.special), m.end())
            end = m.end() if whole else m.end() - 1
            ids += self.core.encode(text[last : m.start()], allowed_special="all")
            ids += self.core._encode_single_piece(text[m.start() : end])
            last = end
        return ids + self.core.encode(text[last:] if last else text, allowed_special="all")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def cuts(text: bytes) -> list[int]:
    """Offsets at which a text is cut: where the rolling hash of the eight bytes before has zero low bits, at whole characters."""
    if len(text) < 2 * LEAST:
        return []
    a = np.frombuffer(text, np.uint8).astype(np.uint32)
    h = np.zeros(len(a) - 7, np.uint32)
    for j, w in enumerate(_WEIGHTS):
        h += a[j : len(a) - 7 + j] * np.uint32(w)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    at = np.flatnonzero((h & np.uint32(MASK)) == 0) + 8
    at = at[at < len(a)]
    return at[(a[at] & 0xC0) != 0x80].tolist()


@dataclass(frozen=True)
class Chunk:
    """A chunk between its starts of runs of white space: what is before the first, words from there on, what is after the last.

    words: the first few runs up to the next start, each with its own ids; rest: ids of all runs after those.
    """

    begin: str
    words: tuple[tuple[str, tuple[int, ...]], ...]
    rest: np.ndarray
    end: str


class ChunkEncoder:
    """Encodes whole texts; equal chunks are encoded once while they are kept."""

    def __init__(self, tokenizer: Tokenizer, keep_bytes: int = KEEP_BYTES, probes: int = 2):
        self.tokenizer, self.keep_bytes, self.probes = tokenizer, keep_bytes, probes
        self.chunks: dict[bytes, Chunk] = {}
        self.texts: dict[bytes, np.ndarray] = {}
        self.size = self.reused = self.encoded = self.widened = 0

    def _keep(self, kept: dict, raw: bytes, made, size: int):
        self.encoded += 1
        if self.size + size > self.keep_bytes:
            self.chunks.clear()
            self.texts.clear()
            self.size = 0
        if size <= self.keep_bytes:
            kept[raw] = made
            self.size += size
        return made

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text), np.int32)

    def _whole(self, raw: bytes) -> np.ndarray:
        got = self.texts.get(raw)
        if got is None:
            ids = self._ids(raw.decode())
            return self._keep(self.texts, raw, ids, len(raw) + ids.nbytes + 300)
        self.reused += 1
        return got

    def _chunk(self, raw: bytes) -> Chunk:
        got = self.chunks.get(raw)
        if got is not None:
            self.reused += 1
            return got
        chunk = raw.decode()
        first = START.search(chunk)
        if first is None:
            return self._keep(self.chunks, raw, Chunk(chunk, (), np.zeros(0, np.int32), ""), 2 * len(raw) + 500)
        at = [first.start()]
        last = _last_start(chunk, at[0])
        while len(at) <= self.probes and at[-1] < last:
            at.append(START.search(chunk, at[-1] + 1).start())
        words = tuple((chunk[a:b], tuple(self.tokenizer.encode(chunk[a:b]))) for a, b in zip(at, at[1:], strict=False))
        made = Chunk(chunk[: at[0]], words, self._ids(chunk[at[-1] : last]), chunk[last:])
        return self._keep(self.chunks, raw, made, 2 * len(raw) + made.rest.nbytes + 1000)

    def encode(self, raw: bytes) -> np.ndarray:
        at = cuts(raw)
        if not at:
            return self._whole(raw)
        out: list[np.ndarray] = []
        join = ""
        for a, b in zip([0, *at], [*at, len(raw)], strict=True):
            chunk = self._chunk(raw[a:b])
            join += chunk.begin
            if not chunk.words and not chunk.end:
                continue  # no start in it: it belongs to the join
            # encode the join with one word of the chunk more, until it ends as the chunk itself says
            words = list(chunk.words)
            agreed = not words
            while words and not agreed:
                word, own = words.pop(0)
                join += word
                ids = self._ids(join)
                agreed = len(own) > 0 and len(ids) >= len(own) and tuple(ids[-len(own) :].tolist()) == own
                self.widened += not agreed
            if agreed and chunk.words:
                out.append(ids)
                out += [np.array(own, np.int32) for _, own in words]
                out.append(chunk.rest)
                join = chunk.end
            elif agreed:  # a single start: what is after it is the next join
                out.append(self._ids(join))
                join = chunk.end
            else:  # no word agreed: the whole chunk is encoded with its join
                join += raw[a:b].decode()[len(chunk.begin) + sum(len(w) for w, _ in chunk.words) :]
        out.append(self._ids(join))
        return np.concatenate(out)


def _last_start(chunk: str, first: int) -> int:
    """The last start of a run of white space, searched for in growing windows from the end."""
    size = 64
    while len(chunk) - size > first:
        found = [m.start() for m in START.finditer(chunk, len(chunk) - size)]
        if found:
            return found[-1]
        size *= 4
    return [m.start() for m in START.finditer(chunk, first)][-1] if first > 0 else first


@apart
def encode(docs: DataFrame, path: str, decode: bool = True, digests: bool = False, check: bool = False, keep_bytes: int = KEEP_BYTES) -> DataFrame:
    """Add n_tokens, ids (array) and decoded; or digests only (ids_sha256, decoded_sha256); or, with `check`, round_trip for decoded.

    docs: a column text, any others. path: a byte-level tokenizer in the tokenizers library's JSON, read by each worker.
    ids are those of that library without added special tokens; decoded is its decode() with special tokens kept;
    round_trip says whether it is the text. Null and empty texts have no ids and decode to an empty text.
    Repeated rows give equal results; an empty table an empty one.
    """
    back = "decoded_sha256 string" if digests else "round_trip boolean" if check else "decoded string"
    ddl = "n_tokens bigint, " + ("ids_sha256 string" if digests else "ids array<int>") + (f", {back}" if decode or check else "")

    def make():
        tokenizer = Tokenizer(path)
        encoder = ChunkEncoder(tokenizer, keep_bytes)
        decimal = [str(i).encode() for i in range(len(tokenizer.pieces))]

        def work(batch):
            texts = [t or b"" for t in as_bytes(batch.column("text"))]
            ids = [encoder.encode(t) for t in texts]
            sizes = [len(i) for i in ids]
            made = [pa.array(sizes, pa.int64())]
            if digests:
                made.append([hashlib.sha256(b",".join(map(decimal.__getitem__, i.tolist()))).hexdigest() for i in ids])
            else:
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                made.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat, pa.int32())))
            if decode or check:
                decoded = map(tokenizer.decode, (i.tolist() for i in ids))
                if digests:
                    made.append([hashlib.sha256(t.encode()).hexdigest() for t in decoded])
                else:
                    made.append([d.encode() == t for d, t in zip(decoded, texts, strict=True)] if check else list(decoded))
            return made

        return work

    return append_columns(without(docs, [c.split()[0] for c in ddl.split(", ")]), make, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
