"""Byte-level BPE with a distinct-word table: every word is encoded once, ids join back by position.

A text is cut at places that no token of the tokenizer's own splitting crosses:
before a single white space between two visible characters, and before the last
of several.  So a piece's ids never depend on its neighbours.  Each task keeps a
table of the distinct pieces it has met; new ones are encoded together, and a
text's ids are gathered from the table by its pieces' places.  Decoding joins
ids to the vocabulary's pieces by number.

The table belongs to a task, not to the corpus: joining ids back from a table of the whole
corpus would move every text through a shuffle (figures in the README).
"""

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from radloom.llm.common import packed

# The characters of Unicode's White_Space property.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{SPACE}]+(?=[{SPACE}][^{SPACE}])|[{SPACE}]?[^{SPACE}]+|[{SPACE}]+")

#: Pieces in a task's table before it starts anew.
TABLE_PIECES = 500_000
#: Texts that are split and encoded together, and handed back together.
SLICE = 256


def load(path: str) -> str:
    """The tokenizer file's JSON; read by the driver and sent to the tasks as it is."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Encoder:
    """The distinct-word table of one task."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        added = [t["content"] for t in json.loads(tokenizer)["added_tokens"]]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.ids = np.zeros(0, dtype="<u4")
        self.starts = np.zeros(1, dtype=np.int64)

    def split(self, text: str) -> list[str]:
        """Pieces of a text; an added token inside it is a piece of its own."""
        if self.added is None or not self.added.search(text):
            return PIECE.findall(text)
        return [p for i, part in enumerate(self.added.split(text)) for p in ([part] if i % 2 else PIECE.findall(part))]

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the pieces that the table lacks, each once."""
        if len(self.places) > TABLE_PIECES:
            self._clear()
        new = [p for p in dict.fromkeys(p for pieces in texts for p in pieces) if p not in self.places]
        if not new:
            return
        found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
        ends = self.starts[-1] + np.cumsum([len(x) for x in found])
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], dtype="<u4")])
        self.starts = np.concatenate([self.starts, ends])

    def gather(self, pieces: list[str]) -> bytes:
        """Ids of a split text, joined from the table by position, as little-endian unsigned 32-bit numbers."""
        at = np.array([self.places[p] for p in pieces], dtype=np.int64)
        first, count = self.starts[at], self.starts[at + 1] - self.starts[at]
        shift = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])) if len(at) else first, count)
        return self.ids[np.arange(len(shift)) + shift].tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for part in range(0, len(texts), SLICE):
            split = [self.split(t or "") for t in texts[part:part + SLICE]]
            self.learn(split)
            out += map(self.gather, split)
        return out


class Decoder:
    """The vocabulary by id."""

    def __init__(self, tokenizer: str):
        spec, bytes_of = json.loads(tokenizer), byte_of_char()
        names = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.pieces = np.full(max(names) + 1, b"", dtype=object)
        for i, name in names.items():
            self.pieces[i] = bytes(bytes_of[c] for c in name) if all(c in bytes_of for c in name) else name.encode()

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.pieces[np.frombuffer(ids, dtype="<u4")].tolist()).decode("utf-8", "replace")


def encode(spark: SparkSession, text: Column, tokenizer: str) -> Column:
    """Ids of a text as little-endian unsigned 32-bit numbers; a null text is an empty one, without ids.

    ``tokenizer`` is what :func:`load` returned.  Same ids as the tokenizers
    library gives the whole text without special tokens added; the strings of
    added tokens in a text become their ids.
    """
    shared = spark.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for texts in batches:
            yield pd.Series(encoder.encode(texts.tolist()), dtype=object)

    return run(text)


def decode(spark: SparkSession, ids: Column, tokenizer: str) -> Column:
    """The text of ids made by :func:`encode`, special tokens included; null ids give null."""
    shared = spark.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(shared.value)
        for batch in batches:
            yield pd.Series([None if b is None else decoder.decode(b) for b in batch], dtype=object)

    return run(ids)


def round_trip(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``row`` (the input row), ``ids`` and ``decoded``, the text that the ids give back.

    As :func:`encode` and :func:`decode`, in one Python process per task instead
    of two.  Rows are independent; other columns are only carried.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("ids binary, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for texts in batches:
            for part in range(0, len(texts), SLICE):
                ids = encoder.encode(texts.iloc[part:part + SLICE].tolist())
                yield pd.DataFrame({"ids": ids, "decoded": [decoder.decode(b) for b in ids]})

    return packed(df).select("row", run(F.col("row")[text]).alias("coded")).select("row", "coded.ids", "coded.decoded")
