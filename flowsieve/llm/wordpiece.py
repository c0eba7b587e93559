"""Token counts of greedy longest-match word pieces by a linear automaton.

Song et al., "Fast WordPiece Tokenization" (2021).  The vocabulary is a trie.
Each node knows where to go on when the next character does not fit (its failure
link) and how many pieces are finished by going there, so a word's number of
pieces is a sum of such counts over one pass; no piece is built and no character
is read twice.  Words with a character that no piece can cover are one unknown
token.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.shipping import ship_package

VOCABULARY_FILE = "piece_bpe_32k.model"
WORD_START = "▁"
# Remembered words of a task; beyond this they are counted anew.
MEMO = 300_000
LONG_WORD = 64


class Automaton:
    """Counts pieces of words whose first piece is in ``initial`` and whose others are in ``continuing``."""

    def __init__(self, initial: set[str], continuing: set[str]):
        self.children: list[dict[str, int]] = [{}, {}]
        self.accepts = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for char in piece:
                    node = self.children[node].setdefault(char, len(self.children))
                    if node == len(self.children):
                        self.children.append({})
                        self.accepts.append(False)
                if piece:
                    self.accepts[node] = True
        self.fail: list[int] = [-1] * len(self.children)
        self.popped = [0] * len(self.children)
        queue = deque((0, 1))
        while queue:
            node = queue.popleft()
            for char, child in self.children[node].items():
                queue.append(child)
                if self.accepts[child]:
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                at, pieces = self.fail[node], self.popped[node]
                while at >= 0 and char not in self.children[at]:
                    pieces += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.children[at][char], pieces

    def count(self, word: str) -> int:
        """Pieces of a word; -1 if it cannot be covered."""
        children, fail, popped = self.children, self.fail, self.popped
        node = pieces = 0
        for char in word:
            child = children[node].get(char)
            while child is None:
                if fail[node] < 0:
                    return -1
                pieces += popped[node]
                node = fail[node]
                child = children[node].get(char)
            node = child
        while node > 1:
            if fail[node] < 0:
                return -1
            pieces += popped[node]
            node = fail[node]
        return pieces


class Counter:
    """Word counts with memory; ``start`` is written before every word, as the vocabulary does."""

    def __init__(self, automaton: Automaton, start: str):
        self.automaton, self.start, self.memo = automaton, start, {}

    def text(self, text: str | None) -> tuple[int, int, int]:
        """(words, tokens, unknown words) of a text split at white space."""
        words = (text or "").split()
        tokens = unknown = 0
        for word in words:
            pieces = self.memo.get(word)
            if pieces is None:
                pieces = self.automaton.count(self.start + word)
                if len(word) <= LONG_WORD:
                    if len(self.memo) >= MEMO:
                        self.memo.clear()
                    self.memo[word] = pieces
            if pieces < 0:
                unknown += 1
                tokens += 1
            else:
                tokens += pieces
        return len(words), tokens, unknown


def piece_counter(model: bytes) -> Counter:
    """Counter of a sentence-piece vocabulary: all ordinary pieces may begin or go on a word."""
    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = {processor.id_to_piece(i) for i in range(processor.get_piece_size())
              if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))}
    return Counter(Automaton(pieces, pieces), WORD_START)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of whole texts.

    A null text counts as empty and gives zeros; repeated rows give repeated results; other columns are not
    read.  The vocabulary file (``path``, under a megabyte) is broadcast.
    """
    ship_package(df.sparkSession)
    with open(path or public_tokenizers.path(VOCABULARY_FILE), "rb") as file:
        model = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        counter = piece_counter(model.value)
        for batch in batches:
            out = pd.DataFrame([counter.text(t) for t in batch["text"]], columns=["n_words", "n_tokens", "n_unknown"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, f"doc_id {dict(source.dtypes)['doc_id']}, n_words long, n_tokens long, n_unknown long")
