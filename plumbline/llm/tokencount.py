"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at each character of a
word; dynamic programming carries the best score and its number of tokens, never the pieces. A word is a
run of non-space characters with the word mark before it. Tie rules are those of the tokenizer: at
each end, the first best candidate wins, and candidates come by start, so of equal scores the longer
last piece stays. A character without a piece of its own is unknown: it costs the least score less 10,
neighbouring unknowns are one token, or their bytes' tokens where the vocabulary has all of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import regex
from pyspark.sql import DataFrame

from plumbline.llm.common import documents, share, with_text_columns

MARK = "▁"
UNKNOWN_PENALTY = 10.0
PARTS = re.compile(f"{MARK}?[^{MARK}]+|{MARK}")
WORDS = regex.compile(r"\P{White_Space}+")


@dataclass
class Vocabulary:
    pieces: list[tuple[str, float]]
    unknown: int


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a sentence-piece file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Vocabulary([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id())


class Counter:
    """Counts for words, remembered up to ``limit`` words. Broadcast as its vocabulary; a worker builds
    the automaton when it first needs it and keeps it for later tasks."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 400_000):
        self.vocabulary, self.limit, self.words, self.automaton = vocabulary, limit, {}, None

    def build(self):
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.vocabulary.pieces:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.least = min((s for _, s in self.vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        names = {piece for piece, _ in self.vocabulary.pieces}
        self.bytes_known = [f"<0x{b:02X}>" in names for b in range(256)]
        self.unknown = self.vocabulary.pieces[self.vocabulary.unknown][0]

    def __getstate__(self):
        return self.vocabulary, self.limit

    def __setstate__(self, state):
        self.__init__(*state)

    def word(self, word: str) -> tuple[int, int, float]:
        """(tokens, of these unknown or byte tokens, score) of one word."""
        known = self.words.get(word)
        if known is not None:
            return known
        if self.automaton is None:
            self.build()
        if MARK in word[1:]:    # marks in the text begin words of their own
            parts = [self.word(part) for part in PARTS.findall(word)]
            return sum(p[0] for p in parts), sum(p[1] for p in parts), sum(p[2] for p in parts)
        text = word if word[0] == MARK else MARK + word
        n = len(text)
        # matches come by end, and at one end the longest first
        best, count, at, alone = [0.0] * (n + 1), [0] * (n + 1), 0, 0
        for last, (size, score) in self.automaton.iter(text):
            end = last + 1
            start = end - size
            total = best[start] + score
            if end != at or total > best[end]:
                at, best[end], count[end] = end, total, count[start] + 1
            if size == 1:
                alone += 1
        found = (count[n], 0, best[n]) if alone == n else self.with_unknown(text)
        if len(self.words) >= self.limit:
            self.words.clear()
        self.words[word] = found
        return found

    def with_unknown(self, text: str) -> tuple[int, int, float]:
        """The same for a text with characters that are no piece of their own."""
        n = len(text)
        ending = [[] for _ in range(n + 1)]
        for last, (size, score) in self.automaton.iter(text):
            ending[last + 1].append((last + 1 - size, score))
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        open_from = [-1] * (n + 1)          # start of the run of unknown characters that ends here
        for end in range(1, n + 1):
            top, choice = None, -1
            candidates = ending[end]
            if not any(start == end - 1 for start, _ in candidates):
                candidates = [*candidates, (end - 1, None)]
            candidates.sort(key=lambda c: c[0])
            for start, score in candidates:
                total = best[start] + (self.least if score is None else score)
                if top is None or total > top:
                    top, choice, lone = total, start, score is None
            best[end] = top
            if not lone:
                count[end], unknown[end] = count[choice] + 1, unknown[choice]
                continue
            start = open_from[end] = open_from[choice] if open_from[choice] >= 0 else choice
            data = text[start:end].encode()
            tokens = len(data) if all(self.bytes_known[b] for b in data) else 1
            count[end], unknown[end] = count[start] + tokens, unknown[start] + tokens
        return count[n], unknown[n], best[n]


def with_counts(df: DataFrame, vocabulary: Vocabulary, *, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``n_tokens``, ``n_unknown`` and ``score`` (the summed best scores). Null and empty
    texts, and texts of white space, have no tokens and score 0."""
    shared = share(df.sparkSession, Counter(vocabulary))

    def make():
        counter = shared.value
        known = counter.words

        def columns(texts):
            rows = []
            for text in texts:
                words, tokens, unknown, total = WORDS.findall(text or ""), 0, 0, 0.0
                for word in words:
                    a, b, c = known.get(word) or counter.word(word)
                    tokens += a
                    unknown += b
                    total += c
                rows.append((len(words), tokens, unknown, total))
            return {name: [r[i] for r in rows] for i, name in enumerate(("n_words", "n_tokens", "n_unknown", "score"))}

        return columns

    return with_text_columns(df, make, "n_words long, n_tokens long, n_unknown long, score double", text_col)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir):
    """op10: count the tokens of every document under the public piece vocabulary, its scores read as a
    unigram model's."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return with_counts(docs, read_vocabulary(vocabulary_path())).select("doc_id", "n_words", "n_tokens", "n_unknown", "score")
