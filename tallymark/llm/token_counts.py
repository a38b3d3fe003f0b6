"""Token counts by a linear longest-match automaton.

The automaton is a trie of the vocabulary in which each node also has a failure link and the number of tokens that are popped
on taking it: when no child fits, the greedy longest match of the node's text is already known, so its pieces are counted
(not built) and the rest of the text is carried on from the linked node. Each character of a word is looked at once, plus
once per failure link, and every link is paid for by a character taken before: the time is linear in the word.

Pieces of a word: the first is matched against pieces that begin a word, later ones against pieces that continue one. A
character that no piece starts with is a piece of its own and counts once per UTF-8 byte (byte fallback), so every word has a count.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BEGIN = "▁"
KNOWN_WORDS = 1 << 18
"""Counts of so many words are kept per task; they are forgotten together when full."""


def read_vocabulary(path: str = VOCABULARY) -> list[str]:
    """Pieces of a sentence-piece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Automaton:
    """Counts tokens of words. pieces: those that begin a word start with BEGIN; BEGIN alone is no piece here."""

    def __init__(self, pieces: Iterable[str]) -> None:
        #: children, failure link and popped tokens of each node; node 0 begins a word, node 1 continues one
        self.next: list[dict[str, int]] = [{}, {}]
        self.link, self.popped = [1, -1], [0, 0]
        ends = {0: 0, 1: 0}
        for piece in pieces:
            root, text = (0, piece[1:]) if piece[:1] == BEGIN else (1, piece)
            if text:
                node = root
                for char in text:
                    if char not in self.next[node]:
                        self.next[node][char] = len(self.next)
                        self.next.append({})
                    node = self.next[node][char]
                ends[node] = 1
        for node in (0, 1):  # single characters on the way to longer pieces are pieces by bytes
            for char, child in self.next[node].items():
                ends.setdefault(child, len(char.encode()))
        self.link += [0] * (len(self.next) - 2)
        self.popped += [0] * (len(self.next) - 2)
        waiting = deque((root, char, child) for root in (0, 1) for char, child in self.next[root].items())
        while waiting:
            node, char, child = waiting.popleft()
            if child in ends:  # the node's text is one piece; the rest goes on from the node that continues a word
                self.link[child], self.popped[child] = 1, ends[child]
            else:
                link, popped = self.link[node], self.popped[node]
                while link != -1 and char not in self.next[link]:
                    popped += self.popped[link]
                    link = self.link[link]
                if link == -1:  # no piece starts with char: it counts by bytes, and nothing is left over
                    link, popped = 1, popped + len(char.encode())
                else:
                    link = self.next[link][char]
                self.link[child], self.popped[child] = link, popped
            waiting.extend((child, c, x) for c, x in self.next[child].items())

    def count(self, word: str) -> int:
        """Tokens of a greedy longest match of a word."""
        node, out = 0, 0
        for char in word:
            while (child := self.next[node].get(char)) is None:
                if node == 1 or (node == 0 and char not in self.next[1]):
                    out, child = out + len(char.encode()), 1
                    break
                out += self.popped[node]
                node = self.link[node]
            node = child
        while node > 1:
            out += self.popped[node]
            node = self.link[node]
        return out


def text_tokens(text: str | None, automaton: Automaton, known: dict[bytes, int]) -> tuple[int, int]:
    """Words and tokens of a whole text; null: none."""
    words = (text or "").encode().split()
    tokens = 0
    for word in words:
        if (n := known.get(word)) is None:
            n = automaton.count(word.decode())
            if len(known) >= KNOWN_WORDS:
                known.clear()
            known[word] = n
        tokens += n
    return len(words), tokens


def token_counts(docs: DataFrame, text: str = "text", id_: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """id, n_words and n_tokens of each row. Null and empty texts have none; equal rows give equal results; an empty table
    gives an empty result. The automaton's size is the vocabulary's; executors get it once, by broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, known = Automaton(held.value), {}
        for frame in frames:
            found = [text_tokens(x, automaton, known) for x in frame["text"]]
            out = pd.DataFrame(found, columns=["n_words", "n_tokens"], index=frame.index)
            out.insert(0, "id", frame["id"])
            yield out

    own = docs.select(F.col(id_).cast("string").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    schema = "id string, n_words long, n_tokens long"
    out = own.mapInPandas(count, schema)  # ids as text: pandas would make floats of integers and nulls
    return out.select(F.col("id").cast(docs.schema[id_].dataType).alias(id_), *out.columns[1:])
