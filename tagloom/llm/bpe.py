"""Byte-level BPE encoding and decoding, with tree concatenation of long unsplit text.

A text is cut where its pre-tokenisation surely cuts it (before a single space between two words), so parts of long documents are encoded in
parallel as rows of their own. A pre-token of more than LONG bytes has no such place; its halves, down to leaves, are encoded on their
own and joined pairwise: a window of tokens on both sides of the join is re-encoded, and grows until its first and its last
token agree with what the halves had there. Then every pair of neighbours is one that BPE itself produces, which makes the whole the
exact encoding.

Defined results: null counts as the empty text, which has no tokens; strings of special tokens become those tokens; repeated rows are
encoded alike; extra columns are ignored by the query and kept by encode(); an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import UID, addressed, fresh, in_arrow, quoted, slices, table, text_or_empty

#: Where the public vocabularies lie.
TOKENIZERS = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))
#: How the vocabulary cuts text (a fixed value of its format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a document, or of a run without a place to cut, above which it is encoded in parts; bytes of a leaf; first window.
SEGMENT, LONG, LEAF, WINDOW = 1 << 16, 2048, 1024, 8
#: Tokens of a batch.
BATCH = 1 << 19


def _byte_chars() -> list[str]:
    """The character that stands for each byte in the vocabulary's format: itself if it is printed, else the next one from 256 on."""
    more = iter(range(256, 512))
    return [chr(b if 33 <= b < 127 or 161 <= b < 256 and b != 173 else next(more)) for b in range(256)]


_CHARS = _byte_chars()


class Codec:
    def __init__(self, folder: str, name: str = "byte_bpe_50k"):
        import regex
        import tiktoken

        ranks = {}
        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.file = f"{folder}/{name}.json"
        with open(self.file, encoding="utf-8") as f:
            self.special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.core = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.bytes = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for token, rank in [*ranks.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.bytes[rank] = token
        self.pieces = regex.compile(PATTERN)
        self.unsplit = regex.compile(rf"\S{{{LONG},}}|\s{{{LONG},}}")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    @functools.cached_property
    def model(self):
        """The merges alone, without pre-tokenisation, over characters that stand for bytes."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file).model

    def piece(self, data: bytes) -> list[int]:
        """Of one pre-token, or a part of one that may begin and end inside a character."""
        return [x.id for x in self.model.tokenize("".join(map(_CHARS.__getitem__, data)))]

    def plain(self, text: str) -> list[int]:
        return self.core.encode(text, allowed_special="all", disallowed_special=())

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of two parts of one pre-token."""
        if not left or not right:
            return left + right
        k = WINDOW
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            window = self.piece(b"".join(self.bytes[i] for i in [*left[-a:], *right[:b]]))
            if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[: len(left) - a] + window + right[b:]
            k *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def segments(self, text: str, segment: int = SEGMENT) -> Iterator[tuple[int, bytes]]:
        """(run, bytes): parts to encode on their own; run >= 0 numbers the leaves of one long pre-token, -1 is text cut at sure places,
        -2 one pre-token of white space."""
        if not self.unsplit.search(text):
            yield from ((-1, x) for x in self._cut(text, segment))
            return
        run = 0
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                yield -1, part.encode()
                continue
            # Pre-tokens between long ones go together, up to one that is no white space: only white space looks at what follows it.
            start, done, trail = 0, 0, []
            for m in self.pieces.finditer(part):
                if m.end() - m.start() > LONG // 4 and len(data := m[0].encode()) > LONG:
                    if done > start:
                        yield -1, part[start:done].encode()
                    yield from ((-2, x.encode()) for x in trail)
                    yield from ((run, data[i : i + LEAF]) for i in range(0, len(data), LEAF))
                    run += 1
                    start = done = m.end()
                    trail = []
                elif not m[0].isspace():
                    done, trail = m.end(), []
                    if done - start >= segment:
                        yield -1, part[start:done].encode()
                        start = done
                else:
                    trail.append(m[0])
            if start < len(part):
                yield -1, part[start:].encode()

    @staticmethod
    def _cut(text: str, segment: int) -> Iterator[bytes]:
        at = 0
        while len(text) - at > segment:
            end = at + segment
            while end < len(text) - 1 and not (text[end] == " " and not text[end - 1].isspace() and not text[end + 1].isspace()):
                end += 1
            if end >= len(text) - 1:
                break
            yield text[at:end].encode()
            at = end
        yield text[at:].encode()

    def part(self, run: int, data: bytes) -> list[int]:
        return self.plain(data.decode()) if run == -1 else self.piece(data)

    def merge(self, parts: list[tuple[int, list[int]]]) -> list[int]:
        """Of (run, ids) in order."""
        out: list[int] = []
        at = 0
        while at < len(parts):
            run, ids = parts[at]
            if run < 0:
                out.extend(ids)
                at += 1
                continue
            end = at
            while end < len(parts) and parts[end][0] == run:
                end += 1
            out.extend(self.tree([list(x) for _, x in parts[at:end]]))
            at = end
        return out

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG:
            return self.plain(text)
        return self.merge([(run, self.part(run, data)) for run, data in self.segments(text)])

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.cache
def codec(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Codec:
    return Codec(folder, name)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32)))


def _batched(batch: pa.RecordBatch, found: Iterator[np.ndarray], name: str, drop: str, decoder: Codec | None = None) -> Iterator[pa.RecordBatch]:
    """batch without `drop`, with a list column (and, of a decoder, the text of each list), in slices of a bounded number of tokens."""
    keep = [n for n in batch.schema.names if n != drop]
    first, held, size = 0, [], 0
    for i, x in enumerate(found):
        held.append(x)
        size += len(x)
        if size >= BATCH or i == batch.num_rows - 1:
            part = batch.slice(first, len(held))
            more = {} if decoder is None else {"decoded": pa.array([decoder.decode(x.tolist()) for x in held], pa.string())}
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), _lists(held), *more.values()], [*keep, name, *more])
            first, held, size = i + 1, [], 0


def _encode_whole(folder: str, decoded: bool, name: str):
    def run(batches):
        c = codec(folder)
        for b in slices(batches):
            yield from _batched(b, (np.array(c.encode(x), np.int32) for x in b.column(name).to_pylist()), "ids", name, c if decoded else None)

    return run


def _split(folder: str, segment: int):
    def run(batches):
        c = codec(folder)
        for b in slices(batches):
            for i, text in enumerate(b.column("text").to_pylist()):
                parts = list(c.segments(text, segment))
                own = b.column("uid").slice(i, 1).take(pa.array([0] * len(parts), pa.int32()))
                yield pa.RecordBatch.from_arrays([own, pa.array(range(len(parts)), pa.int32()), pa.array([r for r, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["uid", "part", "run", "data"])

    return run


def _encode_parts(folder: str):
    def run(batches):
        c = codec(folder)
        for b in slices(batches):
            found = (np.array(c.part(r, x), np.int32) for r, x in zip(b.column("run").to_pylist(), b.column("data").to_pylist(), strict=True))
            yield from _batched(b, found, "ids", "data")

    return run


def _merge(folder: str, decoded: bool):
    def run(batches):
        c = codec(folder)
        for b in batches:
            found = (np.array(c.merge([(p["run"], p["ids"]) for p in sorted(parts, key=lambda p: p["part"])]), np.int32) for parts in b.column("parts").to_pylist())
            yield from _batched(b, found, "ids", "parts", c if decoded else None)

    return run


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(df: DataFrame, text_col: str = "text", folder: str = TOKENIZERS, segment: int = SEGMENT, decoded: bool = False) -> DataFrame:
    """df without the text and with ids (array of int). Documents over `segment` characters are encoded in parallel parts.

    With `decoded` also a column of that name: the ids decoded again by the worker that has them, without another round of workers."""
    rest = quoted(df, text_col, "ids", *["decoded"] * decoded)
    rows = df.select(*rest, text_or_empty(text_col).alias(text := fresh(df, "__text")))
    kind = ", ".join(filter(None, [_schema(df.select(*rest)) if rest else "", "ids array<int>" + ", decoded string" * decoded]))
    short = rows.where(F.length(text) <= segment).transform(in_arrow, _encode_whole(folder, decoded, text), kind)
    long, uid = addressed(rows.where(F.length(text) > segment))
    parts = long.select(F.col(uid).alias("uid"), F.col(text).alias("text")).transform(in_arrow, _split(folder, segment), f"uid {UID}, part int, run int, data binary")
    parts = parts.repartition("uid", "part").transform(in_arrow, _encode_parts(folder), f"uid {UID}, part int, run int, ids array<int>")
    whole = parts.groupBy("uid").agg(F.collect_list(F.struct("part", "run", "ids")).alias("parts")).transform(in_arrow, _merge(folder, decoded), f"uid {UID}, ids array<int>" + ", decoded string" * decoded)
    whole = whole.withColumnRenamed("uid", key := fresh(long, "__long"))
    return short.unionByName(long.join(whole, F.col(uid) == F.col(key)).drop(text, uid, key))


def _decode(folder: str):
    def run(batches):
        c = codec(folder)
        for b in slices(batches):
            ids = b.column("ids")
            flat, offsets = np.asarray(ids.flatten()), np.asarray(ids.offsets) - ids.offsets[0].as_py()
            texts = [c.decode(flat[s:e].tolist()) for s, e in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return run


def decode(df: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """df (with ids) and decoded, the text."""
    return df.transform(in_arrow, _decode(folder), _schema(df) + ", decoded string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of docs (doc_id, text)."""
    out = encode(docs.select("doc_id", "text"), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
