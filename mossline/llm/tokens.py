"""Token ids of texts by a public byte-level BPE vocabulary in tiktoken's rank format.

Encoding is the one step that Spark's own functions can't express. It runs in Arrow batches (mapInArrow), once per row,
without a shuffle. A worker builds the encoder once per vocabulary file and keeps it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossline.runtime import spread

#: A run of this many blanks or more is taken out of the text and encoded as the one piece that it is: the library's
#: pattern looks ahead after blanks and overflows its stack on a run of about a million. Shorter texts than a part have none.
RUN_CHARS = 10_000
# The characters that Unicode counts as white space, which the pattern's \\s stands for.
BLANKS = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: A text longer than this is encoded in parts of about this many characters, cut only where the pattern always cuts.
PART_CHARS = 65_536


def default_ranks() -> str:
    """The rank file of byte_bpe_50k as installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})


def safe_parts(text: str, part_chars: int = PART_CHARS) -> Iterator[str]:
    """Parts of `text` whose separate encodings join to that of the whole.

    The pattern always starts a new piece at a single blank between two visible characters: what precedes ends before
    the blank, and nothing after it looks back. Where no such place follows, the rest stays whole.
    """
    start, size = 0, len(text)
    while size - start > part_chars:
        at = start + part_chars
        while 0 < (at := text.find(" ", at)) < size - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at += 1
        if at < 0 or at >= size - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


@lru_cache(maxsize=4)
def blank_runs(run_chars: int) -> re.Pattern[str]:
    return re.compile(f"{BLANKS}{{{run_chars},}}")


def encode(text: str | None, path: str, part_chars: int = PART_CHARS, run_chars: int = RUN_CHARS) -> list[int]:
    """Ids of a text; [] for an empty or null one. Lone surrogates can't come from Spark and are not expected.

    Of a long run of blanks all but the last, or all at the end of the text, are one piece; the last goes with what follows.
    """
    if not text:
        return []
    enc = encoder(path)
    if len(text) <= part_chars:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for run in blank_runs(max(2, run_chars)).finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > at:
            ids += (i for part in safe_parts(text[at : run.start()], part_chars) for i in enc.encode_ordinary(part))
        ids += single_piece(enc, text[run.start() : stop])
        at = stop
    if at < len(text):
        ids += (i for part in safe_parts(text[at:], part_chars) for i in enc.encode_ordinary(part))
    return ids


def single_piece(enc, text: str) -> list[int]:
    """Ids of a text that the pattern takes for one piece, without running the pattern over it."""
    own = getattr(enc, "_encode_single_piece", None)
    if own is None:  # not part of the library's public interface
        raise RuntimeError("this version of tiktoken encodes no single pieces; runs of blanks over 10,000 characters need that")
    return own(text)


def decode_bytes(ids: list[int], path: str) -> bytes:
    """The bytes of ids; a cut inside a character stays as it is, so parts decode independently."""
    enc = encoder(path)
    return b"".join(map(enc.decode_single_token_bytes, ids))


def token_ids(documents: DataFrame, *, key: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """key, ids ARRAY<INT>: one row per input row, without special tokens; null and empty texts give an empty list.

    Rows with a null key and repeated rows are kept as they are. Other columns are ignored.
    """
    path = ranks or default_ranks()
    rows = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [encode(t, path) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["key", "ids"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>").select(F.col("key").alias(key), "ids")


def token_counts(documents: DataFrame, *, keep: list[str], text: str = "text", ranks: str | None = None) -> DataFrame:
    """The columns `keep` and n_tokens BIGINT; the ids themselves never leave the worker."""
    path = ranks or default_ranks()
    names = [f"k{i}" for i in range(len(keep))]
    rows = spread(documents.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("text")))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(encode(t, path)) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*names, "n_tokens"])

    return rows.mapInArrow(run, f"{kinds}, n_tokens bigint").select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "n_tokens")


def decoded_texts(encoded: DataFrame, *, key: str = "doc_id", ids: str = "ids", ranks: str | None = None) -> DataFrame:
    """key, text: the texts of token ids by joining raw bytes; bytes that are no UTF-8 become U+FFFD, null gives null."""
    path = ranks or default_ranks()
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_bytes(x, path).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string").select(F.col("key").alias(key), "text")
