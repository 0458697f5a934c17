"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are split at boundaries where the tokenizer always splits as well: before a
single space or line break that stands between two printable characters. That holds
for byte-level tokenizers with the settings below, which are read from the tokenizer's file;
any other tokenizer is given whole texts. The pieces of a batch of about equally many
bytes that are not in the worker's bounded memory of lengths are encoded in one library
call, and a text's count is the sum over its pieces. Text that offers no such boundary is
encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 1 << 20
#: Lengths a worker remembers; then it starts again. Bounds memory only.
MEMORY_PIECES = 300_000
#: A piece longer than this is encoded but not remembered.
MEMORY_CHARS = 64

_BOUNDARY = re.compile(r"(?<=[\w!-~])(?=[ \n][\w!-~])")
#: White space that is no safe boundary.
_UNSAFE = re.compile(r"[^\S \n]|(?<![\w!-~])[ \n]|[ \n](?![\w!-~])|[\x1c-\x1f]")


# The settings under which a single space or line break always begins a piece.
_SETTINGS = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "truncation": None, "padding": None}


def splits_at_spaces(path: str) -> bool:
    """Do a tokenizer's own settings say that texts may be cut at safe boundaries? Added tokens may neither hold nor take white space."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    apart = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]]) for t in found["added_tokens"])
    return apart and all(found.get(k) == v for k, v in _SETTINGS.items()) and not found["model"].get("ignore_merges")


def safe_pieces(text: str) -> list[str]:
    """Cut a text where byte-level pre-tokenisation always cuts; joined they give the text."""
    if _UNSAFE.search(text):
        return _BOUNDARY.split(text)
    first, *rest = text.replace("\n", " \n").split(" ")
    return [first, *(x if x[:1] == "\n" else " " + x for x in rest)]


def byte_batches(texts: list[str], limit: int = BATCH_BYTES, apart: bool = True) -> Iterator[tuple[list[str], list[int]]]:
    """Pieces of whole texts (the texts themselves unless ``apart``) in batches of about ``limit`` UTF-8 bytes, with each piece's text number."""
    pieces: list[str] = []
    owners: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        own = (safe_pieces(text) if apart else [text]) if text else []
        for at in range(0, len(own), 1024):
            part = own[at : at + 1024]
            pieces += part
            owners += [i] * len(part)
            held += len("".join(part).encode())
            if held >= limit:
                yield pieces, owners
                pieces, owners, held = [], [], 0
    if pieces:
        yield pieces, owners


class PieceLengths:
    """Lengths of pieces under one tokenizer, from batch calls of its library: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        self.apart = splits_at_spaces(path)
        self.known: dict[str, int] = {}
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            encode = SentencePieceProcessor(model_file=path).encode
            self.lengths = lambda pieces: map(len, encode(pieces, num_threads=1))
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encode_batch = Tokenizer.from_file(path).encode_batch_fast
        self.lengths = lambda pieces: (len(e.ids) for e in encode_batch(pieces, add_special_tokens=False))

    def __call__(self, pieces: list[str]) -> list[int]:
        got = list(map(self.known.get, pieces))
        if None in got:
            new = list({x for x, y in zip(pieces, got, strict=True) if y is None})
            fresh = dict(zip(new, self.lengths(new), strict=True))
            got = [fresh[x] if y is None else y for x, y in zip(pieces, got, strict=True)]
            if len(self.known) + len(fresh) > MEMORY_PIECES:
                self.known.clear()
            self.known.update((k, v) for k, v in fresh.items() if len(k) <= MEMORY_CHARS)
        return got


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, n_bytes, n_tokens: one per input row, in no order.

    A null text counts as empty (0, 0). Ids may be null or repeat. The tokenizers
    library's defaults hold for special strings inside texts; nothing is added,
    cut or padded.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = PieceLengths(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [0] * len(texts)
            for pieces, owners in byte_batches(texts, apart=lengths.apart):
                for i, k in zip(owners, lengths(pieces), strict=True):
                    counts[i] += k
            n_bytes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long")
