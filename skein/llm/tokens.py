"""Token counts of whole texts by a published tokenizer, lengths only."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

#: The patterns by which the known tokenizers cut a text before their merges. White space never continues a piece that began with another character.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Where such pieces end in any case, so that both sides have the tokens of the whole: before white space that follows anything else, and
#: between a letter (of scripts whose letters have been so in every Unicode version) and punctuation but the apostrophe and the bar, which added tokens hold. Invisible characters that once counted as blanks are left alone.
SAFE = re.compile(
    "[^\\s\u180e\u200b-\u200f\u2060\ufeff](?=[ \\t\\n\\r\u3000])|[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u0621-\u063a\u0905-\u0939\u0e01-\u0e30\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3](?=[!-&(-/:-@\\[-`{}~\u3001-\u3003\u3008-\u3011\uff01-\uff06\uff08-\uff0f\uff1a-\uff1f])"
)
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def splittable(tokenizer: dict) -> bool:
    """Whether a tokenizers file, as read, is of a kind whose pieces end at the boundaries of SAFE, with no added token across one."""
    before, norm = tokenizer.get("pre_tokenizer") or {}, tokenizer.get("normalizer") or {}
    steps = before.get("pretokenizers", [before])
    byte_level = [s for s in steps if s.get("type") == "ByteLevel" and not s.get("add_prefix_space")]
    by_itself = len(steps) == 1 and bool(byte_level) and byte_level[0].get("use_regex", False)
    by_pattern = len(steps) == 2 and bool(byte_level) and steps[0].get("type") == "Split" and steps[0].get("pattern", {}).get("Regex") in (BYTE_LEVEL, WORD_LEVEL) and not byte_level[0].get("use_regex")
    plain = all(n.get("type") in ("NFC", "Lowercase") or n.get("type") == "Replace" and n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " " for n in norm.get("normalizers", [norm] if norm else []))
    added = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and not SAFE.search(t["content"]) for t in tokenizer.get("added_tokens", []))
    return (by_itself or by_pattern) and plain and added and not tokenizer.get("truncation") and not tokenizer.get("padding")


def pieces(text: str, size: int) -> list[tuple[str, int]]:
    """The text cut at safe boundaries into pieces of about size bytes, with their bytes; without such boundaries a piece is longer, never cut elsewhere."""
    total = len(text) if text.isascii() else len(text.encode())
    if total <= size:
        return [(text, total)]
    out, start = [], 0
    # characters that make about size bytes in this text
    step = max(1, size * len(text) // total)
    while len(text) - start > step and (m := SAFE.search(text, start + step - 1)):
        out.append(text[start : m.end()])
        start = m.end()
    out.append(text[start:])
    return [(p, len(p) if p.isascii() else len(p.encode())) for p in out]


def count_all(encode, texts: list[str], batch_bytes: int, piece_bytes: int) -> tuple[list[int], list[int]]:
    """UTF-8 bytes and tokens of each text. Pieces go to the encoder in batches of about batch_bytes, whatever the number of texts and their script."""
    sizes, totals, batch, owner, held = [0] * len(texts), [0] * len(texts), [], [], 0

    def flush() -> None:
        for i, n in zip(owner, encode(batch), strict=True):
            totals[i] += n
        batch.clear()
        owner.clear()

    for i, text in enumerate(texts):
        for piece, size in pieces(text, piece_bytes):
            batch.append(piece)
            owner.append(i)
            sizes[i] += size
            held += size
            if held >= batch_bytes:
                flush()
                held = 0
    if batch:
        flush()
    return sizes, totals


def encoder(path: str):
    """A function from a list of texts to their token counts, for a .json (tokenizers) or .model (sentencepiece) file, and whether its texts may be cut at SAFE."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], splittable(kind | {"truncation": None, "padding": None})
    import sentencepiece

    pieces_of = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in pieces_of.encode(texts, num_threads=1)], False


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, batch_bytes: int = 1 << 16, piece_bytes: int = 1 << 10) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each document.

    tokenizer: the file's path, or the bare name of one of the public tokenizers, found on each executor. Null text counts as empty: 0 bytes, 0 tokens.
    Null doc_id stays null; repeated rows are counted each; an empty table gives no rows; other columns are ignored. Long texts, of any script, are split
    where pieces end in any case, as the tokenizer's own file tells; where it doesn't (and for sentencepiece) a text stays whole. So counts are those of the whole text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        encode, cuts = encoder(path)
        for batch in sliced(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            sizes, n = count_all(encode, texts, batch_bytes, piece_bytes if cuts else 1 << 62)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
