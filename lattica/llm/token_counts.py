"""Token counts of a unigram tokenizer by a count-only Viterbi.

A text is cut into words as a metaspace pre-tokenizer cuts it: every space becomes U+2581 and begins a new word, and one
is put in front of a text that has none there. An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at each place of a
word; dynamic programming carries the best score to each place and the number of pieces of that path, no path
itself. The tie rule is the tokenizer's: pieces are tried by start, then by length, and a later path replaces an
earlier one only if its score is strictly higher. A place where no piece of one character begins has an unknown
character there, scored UNK_PENALTY below the least piece score; adjoining unknown characters are one token.

The vocabulary is a list of (piece, score). By default it is that of a public sentencepiece model without its control
and byte pieces; its scores there are merge ranks, from which -log(rank + 2) makes log-probabilities.

Words repeat, so a worker counts each distinct word of a batch once and remembers MEMO of them; a word that is longer
than the memo takes is counted all the same. Work and memory of a word are linear in its length.

Cases: null or empty text has no tokens; text that doesn't occur in the vocabulary is unknown tokens;
repeated rows get equal answers; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lattica.llm._text import limits
from lattica.session import ship, table

SPACE = "▁"
UNK_PENALTY = 10.0
MEMO, MEMO_LETTERS = 300_000, 64


def default_vocab(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model's ordinary pieces."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("piece_bpe_32k.model"))
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return [(p, -math.log(i + 2)) for i, p in enumerate(pieces)]


class Counter:
    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            self.automaton.add_word(piece, (len(piece), score))
        if vocab:
            self.automaton.make_automaton()
        self.vocab, self.unknown = bool(vocab), min((s for _, s in vocab), default=0.0) - UNK_PENALTY
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of the best path through one word."""
        n, unknown = len(word), self.unknown
        best, count, unk = [0.0] * (n + 1), [0] * (n + 1), bytearray(n + 1)

        def skip(e: int) -> None:
            """An unknown character before place e."""
            total = best[e - 1] + unknown
            if total > best[e]:
                best[e], count[e], unk[e] = total, count[e - 1] + (not unk[e - 1]), 1

        # Matches come by end, and of one end the longest first; what starts before an end is settled by then.
        at, single, least = 0, True, float("-inf")
        for end, (k, score) in self.automaton.iter(word) if self.vocab else ():
            end += 1
            if end != at:
                if not single:
                    skip(at)
                for e in range(at + 1, end):
                    best[e] = least
                    skip(e)
                at, single, best[end] = end, False, least
            total = best[end - k] + score
            if total > best[end]:
                best[end], count[end] = total, count[end - k] + 1
            if k == 1:
                single = True
        if not single:
            skip(at)
        for e in range(at + 1, n + 1):
            best[e] = least
            skip(e)
        return count[n]

    def texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        texts = [t.replace(SPACE, " ") for t in texts]
        cut = [(t[1:] if t[0] == " " else t).split(" ") if t else [] for t in texts]  # a space in front is the one that is put there
        memo = self.memo
        new = set().union(*cut) - memo.keys()
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = set().union(*cut)
        for w in new:
            memo[w] = self.word(SPACE + w)
        out = [sum(map(memo.__getitem__, c)) for c in cut]
        for w in new:
            if len(w) > MEMO_LETTERS:
                del memo[w]
        return out


def _count(batches: Iterable[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    counter = Counter(sent.value)
    for batch in batches:
        n = counter.texts([t or "" for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])


def token_counts(docs: DataFrame, vocab: list[tuple[str, float]] | None = None) -> DataFrame:
    """doc_id and n_tokens of every row. The vocabulary (some 32,000 pieces) is broadcast."""
    spark = docs.sparkSession
    ship(spark)
    limits(spark)
    sent = spark.sparkContext.broadcast(vocab if vocab is not None else default_vocab())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _count(it, sent), f"doc_id {kind}, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"))
