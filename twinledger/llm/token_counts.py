"""Token counts under a unigram vocabulary, with forward scores shared along a trie.

Words (with the vocabulary's word mark before them) are cut into the pieces with the
greatest total score. The distinct words of a block are visited in sorted order, which
walks their trie depth first: the best score and piece count of every prefix are kept
along the path and computed once for all words that share the prefix; each word's count
is what stands at its terminal. A character that no piece covers counts as its UTF-8
bytes. A worker keeps counts of words it has met, up to ``_KEPT``; emptying that table
changes no result.

Scores are Zipf log-probabilities by the pieces' rank in the vocabulary file, which
lists them by frequency of use; nothing is trained. Equal scores: the longer last
piece wins.

Defined cases: null, empty or blank text has 0 words and 0 tokens; repeated rows each
give a row; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from twinledger.llm.tokens import in_blocks

_BLOCK = 2_000_000
_KEPT = 500_000
MARK = "▁"


def piece_scores(path: str) -> dict[str, float]:
    """The score of each piece that stands for text; byte pieces and control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - norm for r, p in enumerate(pieces, 1)}


class Counter:
    """Token counts of words."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 1.0  # the score of a byte
        self.known: dict[bytes, int] = {}

    def count_sorted(self, words: Iterable[str]) -> Iterator[int]:
        """The count of each word of a sorted sequence."""
        scores, longest = self.scores, self.longest
        best, count, last = [0.0], [0], ""
        for word in words:
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], count[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                width = len(word[end - 1].encode("utf-8", "replace"))
                top, n = best[end - 1] + width * self.byte, count[end - 1] + width
                for start in range(end - 1, max(-1, end - 1 - longest), -1):
                    score = scores.get(word[start:end])
                    if score is not None and (score := score + best[start]) >= top:
                        top, n = score, count[start] + 1
                best.append(top)
                count.append(n)
            last = word
            yield count[-1]

    def learn(self, words: Iterable[bytes]) -> dict[bytes, int]:
        spelt = sorted((MARK + w.decode("utf-8"), w) for w in words)
        return {w: n for (_, w), n in zip(spelt, self.count_sorted(s for s, _ in spelt))}

    def totals(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """Words and tokens of each text."""
        cut = [t.encode("utf-8", "replace").split() for t in texts]
        known = self.known
        found = self.learn({w for words in cut for w in words if w not in known})
        if len(known) + len(found) > _KEPT:
            known = {w: known[w] for words in cut for w in words if w in known}
            self.known = {}
        known.update(found)
        if len(known) <= _KEPT:
            self.known = known
        for words in cut:
            yield len(words), sum([known[w] for w in words])


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_tokens. No shuffle."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(piece_scores(path))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [f for s in in_blocks(texts, _BLOCK) for f in _counters[path].totals(texts[s])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
