"""Token counts of a unigram tokenizer without building its pieces.

An Aho-Corasick automaton over the vocabulary enumerates, for each end position of a word, the pieces
that end there, longest first. A Viterbi pass carries only the best score and its number of pieces.
Ties are the tokenizer's: of equal scores the candidate that starts first (the longest piece) stays,
since a later one must be strictly better; a character that is no piece by itself costs the smallest
score less 10 and falls back to its UTF-8 bytes, one token each. Words are what a Metaspace
pre-tokenizer cuts at spaces, so each distinct word is counted once per task (a bounded memory).

No unigram model file is given: the pieces are those of piece_bpe_32k.model, a BPE model, and its merge
ranks stand in for scores, so the counts differ from that model's own encoding (figures in the README).

Defined cases: null and empty texts have no tokens; repeated rows are counted each; a very long word is
handled in one pass with three numbers per character; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from .common import byte_batches, texts, tokenizer_path

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


@lru_cache(maxsize=2)
def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) by id of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Counts tokens of words and texts; `limit` bounds how many words are remembered."""

    def __init__(self, vocab: list[tuple[str, float]], limit: int = 400_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.limit, self.known = limit, {}

    def word(self, word: str) -> int:
        n = len(word)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, piece in self.automaton.iter(word):
            matches[end + 1].append(piece)
        for e in range(1, n + 1):
            best, pieces = None, 0
            single = False
            for length, s in matches[e]:
                single = single or length == 1
                s += score[e - length]
                if best is None or s > best:
                    best, pieces = s, count[e - length] + 1
            if not single:
                s = self.unknown + score[e - 1]
                if best is None or s > best:
                    best, pieces = s, count[e - 1] + len(word[e - 1].encode("utf-8", "surrogatepass"))
            score[e], count[e] = best, pieces
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        known, total = self.known, 0
        for w in (text[1:] if text[0] == " " else text).split(" "):
            n = known.get(w)
            if n is None:
                if len(known) >= self.limit:
                    known.clear()
                n = self.word(SPACE + w)
                if len(w) <= 64:
                    known[w] = n
            total += n
        return total


def _counted(model_path: str):
    def run(batches):
        import pyarrow as pa

        counter = Counter(vocabulary(model_path))
        for b in byte_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([counter.text(t) for t in b.column("text").to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens per row of docs."""
    return texts(docs, id_col, text_col).mapInArrow(_counted(model_path or tokenizer_path("piece_bpe_32k.model")), "doc_id long, n_tokens long")
