"""SentencePiece encoding and decoding by a table of distinct marked words.

The library first puts a space before the text and turns each space into the
mark U+2581. If no piece has a mark after another character, no merge crosses
into a marked word from the word before it, so each maximal "marks, then other
characters" chunk can be segmented alone. Every distinct chunk of a worker goes
through the library once; a text's ids are then joined back by position, and so
is its decoded form. :class:`ChunkTable` refuses models for which this fails.

A task's table is bounded (``MAX_CHUNKS`` entries and one portion of texts
more; chunks over ``MAX_CHUNK_CHARS`` characters are not kept), is emptied when
full and goes with the task. Results leave a portion of texts at a time. There
is no shuffle: each text is read once where it lies.

Defined results for odd input: a null text is an empty one (no ids, empty
string); U+2581 in a text decodes to a space, as in the library; repeated rows
are encoded each; an empty table gives an empty result; extra columns are
carried by :func:`encode_decode`, whose outputs replace columns of their name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow_spark.llm.workers import beside, give_back, portions, quoted
from winnow_spark.session import read_table

MARK = "▁"
CHUNK = re.compile(r" +[^ ]*")
MAX_CHUNKS, MAX_CHUNK_CHARS = 120_000, 200
OUT = "ids array<int>, decoded string"
TRIP = "n_tokens long, ids array<int>, round_trip boolean"
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class ChunkTable:
    """Segments of one model's chunks: chunk -> (ids in decimal, decoded)."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("a piece has a mark after another character: words can't be segmented alone")
        if model.encode(" a  b ") != model.encode(f"{MARK}a{MARK}{MARK}b{MARK}") or model.decode(model.encode("① a")) != "① a":
            raise ValueError("the model's normaliser changes more than spaces")
        self.mark_id = model.piece_to_id(MARK)
        self.table: dict[str, tuple[str, str]] = {}

    def _segment(self, chunks: list[str]) -> list[tuple[str, str]]:
        # The library itself adds the first mark of a chunk, but not to an empty text.
        ids = [got or [self.mark_id] for got in self.model.encode([chunk[1:] for chunk in chunks], num_threads=1)]
        decoded = self.model.decode(ids, num_threads=1)
        return [(",".join(map(str, i)), " " + d) for i, d in zip(ids, decoded)]

    def parts(self, texts: Iterable[str | None]) -> Iterator[list[tuple[str, str]]]:
        """The segments of each text of a portion, in order; its new chunks go to the library at once."""
        portion = [CHUNK.findall(" " + text.replace(MARK, " ")) if text else [] for text in texts]
        if len(self.table) > MAX_CHUNKS:
            self.table.clear()
        table = self.table
        new = list({chunk for chunks in portion for chunk in chunks if chunk not in table})
        table.update(zip(new, self._segment(new)))
        for chunks in portion:
            yield [table[chunk] for chunk in chunks]
        for chunk in new:
            if len(chunk) > MAX_CHUNK_CHARS:
                del table[chunk]

    def encode_decode(self, texts: Iterable[str | None]) -> Iterator[tuple[list[int], str]]:
        for parts in self.parts(texts):
            yield [int(i) for ids, _ in parts for i in ids.split(",")], "".join([part[1] for part in parts])[1:]

    def round_trip(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, bool]]:
        texts = list(texts)
        for text, parts in zip(texts, self.parts(texts)):
            ids = np.array(",".join([part[0] for part in parts]).split(","), np.int32) if parts else np.empty(0, np.int32)
            yield len(ids), ids, "".join([part[1] for part in parts])[1:] == (text or "")

    def digest(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        for parts in self.parts(texts):
            ids, decoded = ",".join([part[0] for part in parts]), "".join([part[1] for part in parts])[1:]
            yield ids.count(",") + 1 if parts else 0, sha256(ids.encode()).hexdigest(), sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


def _applied(df: DataFrame, text: str, model_file: str, schema: str, method: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        apply = getattr(ChunkTable(model_file), method)
        for texts in batches:
            for portion in portions(texts):
                yield pd.DataFrame(list(apply(portion)), columns=names, dtype=object)
        del apply
        give_back()

    return beside(df, run(F.col(quoted(text))), names)


def encode_decode(df: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` and the ``decoded`` text."""
    return _applied(df, text, model_file, OUT, "encode_decode")


def encode_round_trip(df: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids`` and whether decoding them gives the text again (``round_trip``)."""
    return _applied(df, text, model_file, TRIP, "round_trip")


def encode_digest(df: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    return _applied(df, text, model_file, DIGEST, "digest")


def piece_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digest(docs, piece_model()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
