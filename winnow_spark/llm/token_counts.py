"""Word-piece token counts by a linear longest-match automaton.

Greedy longest-match segmentation (word pieces) of a word needs, for its length
alone, neither pieces nor backtracking: the vocabulary's trie gets failure links
and, with each link, the number of tokens that are complete when it is followed.
A word is then read once, character by character; following a link adds its
precomputed count.

For a node v (a prefix of some piece): if v is itself a piece, its link leads to
the root and completes one token. Otherwise its link continues its parent's: it
follows links from there, adding their counts, until a node with v's last
character as a child is found. Without any, the word can't be segmented.

The vocabulary is that of a SentencePiece model, whose pieces mark a word's
start by U+2581: a word is read with the mark before it, so pieces with a mark
are its first pieces and pieces without are continuations. A word that can't be
segmented is one unknown token.

A worker keeps the counts of distinct words it has met (bounded), so a common
word is walked once. No shuffle; the automaton is broadcast (its size is that
of the vocabulary file).

Defined results for odd input: a null, empty or blank text has no words and no
tokens; repeated rows are counted each; an empty table gives an empty result;
extra columns are carried, outputs replace columns of their name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow_spark.llm.sentencepieces import MARK, piece_model
from winnow_spark.llm.workers import beside, give_back, quoted
from winnow_spark.session import read_table

UNKNOWN = -1
MAX_WORDS, MAX_WORD_BYTES = 500_000, 100
#: Characters of a vocabulary that is broadcast; the largest public ones have some two million.
MAX_VOCABULARY = 20_000_000


class LongestMatch:
    """Trie, failure links and popped-token counts of a vocabulary of strings."""

    def __init__(self, pieces: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in filter(None, pieces):
            node = 0
            for char in piece:
                if char not in self.children[node]:
                    self.children[node][char] = len(ends)
                    self.children.append({})
                    ends.append(False)
                node = self.children[node][char]
            ends[node] = True
        size = len(ends)
        self.link, self.popped = [UNKNOWN] * size, [0] * size
        level = [0]
        while level:
            below = []
            for parent in level:
                for char, node in self.children[parent].items():
                    below.append(node)
                    if ends[node]:
                        self.link[node], self.popped[node] = 0, 1
                        continue
                    at, popped = self.link[parent], self.popped[parent]
                    while at != UNKNOWN and char not in self.children[at]:
                        at, popped = self.link[at], popped + self.popped[at]
                    if at != UNKNOWN:
                        self.link[node], self.popped[node] = self.children[at][char], popped
            level = below

    def count(self, word: str) -> int:
        """Tokens of one word, or UNKNOWN."""
        children, link, popped = self.children, self.link, self.popped
        node = tokens = 0
        for char in word:
            while char not in children[node]:
                tokens += popped[node]
                node = link[node]
                if node == UNKNOWN:
                    return UNKNOWN
            node = children[node][char]
        while node:
            tokens += popped[node]
            node = link[node]
            if node == UNKNOWN:
                return UNKNOWN
        return tokens


def vocabulary(model_file: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def count_tokens(df: DataFrame, pieces: Iterable[str], text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``n_tokens`` (unknown words one each), ``n_unknown``."""
    pieces = list(pieces)
    if sum(map(len, pieces)) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY} characters is not broadcast")
    automaton = df.sparkSession.sparkContext.broadcast(LongestMatch(pieces))
    names = ["n_words", "n_tokens", "n_unknown"]

    def counted(texts: pd.Series, known: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
        count = automaton.value.count
        for value in texts:
            words = value.encode("utf-8", "surrogatepass").split() if value else []  # ASCII white space only
            tokens = list(map(known.get, words))
            if None in tokens:
                for i, word in enumerate(words):
                    if tokens[i] is None:
                        tokens[i] = got = count(MARK + word.decode("utf-8", "surrogatepass"))
                        if len(word) <= MAX_WORD_BYTES:
                            known[word] = got
                if len(known) > MAX_WORDS:
                    known.clear()
            unknown = tokens.count(UNKNOWN)
            yield len(words), sum(tokens) + 2 * unknown, unknown

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for texts in batches:
            yield pd.DataFrame(list(counted(texts, known)), columns=names)
        known.clear()
        give_back()

    return beside(df, run(F.col(quoted(text))), names)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary(piece_model())).select("doc_id", "n_words", "n_tokens", "n_unknown")
