"""Token counts under a unigram language model, by dynamic programming over a trie of pre-tokens.

The best segmentation of a pre-token maximises the sum of its pieces' log-probabilities. The forward score of a
prefix (best sum and the number of pieces that reach it) depends on the prefix alone, so it is computed once at
the trie node that all pre-tokens with this prefix share; the number at a pre-token's last node is its count.
Each worker grows one trie over all batches it sees and starts anew when the trie reaches its size limit. A pre-token too
long to be shared is scored with the last few forward scores alone. So memory is bounded and no row moves between tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from juryframe.llm.packing import vocabulary

#: Nodes (prefixes) after which a worker starts its trie anew.
MOST_NODES = 1_000_000
#: A longer pre-token is not inserted: it shares little with others.
LONGEST_SHARED = 256
MARK = "▁"  # stands for the space before a word, as in the vocabulary
_TRIES: dict[tuple[str, float, float], "PrefixTrie"] = {}


def piece_scores(model_name: str, shift: float) -> dict[str, float]:
    """Log-probabilities of the vocabulary's pieces by Zipf's law: the piece of rank r has 1 / (r + shift).

    The vocabulary file is ranked but holds no probabilities; ranks are the places of its normal pieces in id order.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(model_name))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + shift) for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r + shift) - total for r, p in enumerate(pieces, 1)}


class PrefixTrie:
    """Forward scores of all prefixes of the pre-tokens inserted so far.

    A character that ends no piece is one token a UTF-8 byte, each at ``byte_score``.
    """

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score, self.longest = scores, byte_score, max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0.0], [0]
        self.terminal: dict[bytes, int] = {}

    def count(self, pretoken: bytes) -> int:
        """The token count of a UTF-8 pre-token; for one that is inserted it is kept with its last node."""
        known = self.terminal.get(pretoken)
        if known is not None:
            return known
        word = pretoken.decode()
        if len(word) > LONGEST_SHARED:
            return self.rolling(word)
        if len(self.best) > MOST_NODES:
            self.clear()
        child, best, tokens = self.child, self.best, self.tokens
        path, node, text = [0], 0, MARK + word
        for end, c in enumerate(text, 1):
            following = child.get((node, c))
            if following is None:
                first = max(0, end - self.longest)
                top, count = self.forward(text[first:end], path[first:end], best, tokens)
                following = child[node, c] = len(best)
                best.append(top)
                tokens.append(count)
            node = following
            path.append(node)
        self.terminal[pretoken] = tokens[node]
        return tokens[node]

    def forward(self, text: str, places: Sequence[int], best: list[float], tokens: list[int]) -> tuple[float, int]:
        """The score and count of a prefix that ends with ``text``; those of the prefix before each of its characters are at ``places``."""
        scores, size, last = self.scores, len(text[-1].encode()), places[-1]
        top, count = best[last] + size * self.byte_score, tokens[last] + size
        for start, place in enumerate(places):
            score = scores.get(text[start:])
            if score is not None:
                total = best[place] + score
                # Of equal sums the one with fewer tokens counts.
                if total > top or (total == top and tokens[place] + 1 < count):
                    top, count = total, tokens[place] + 1
        return top, count

    def rolling(self, word: str) -> int:
        """The same count, with no more scores at a time than the longest piece has characters."""
        best, tokens, last = [0.0], [0], ""
        for c in chain(MARK, word):
            last = (last + c)[-self.longest :]
            top, count = self.forward(last, range(len(last)), best, tokens)
            best, tokens = [*best, top][-self.longest :], [*tokens, count][-self.longest :]
        return tokens[-1]


def trie(model_name: str, shift: float, byte_score: float) -> PrefixTrie:
    key = (model_name, shift, byte_score)
    if key not in _TRIES:
        _TRIES[key] = PrefixTrie(piece_scores(model_name, shift), byte_score)
    return _TRIES[key]


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_name: str = "piece_bpe_32k.model", shift: float = 2.7, byte_score: float = -30.0) -> DataFrame:
    """One row a document: doc_id, n_pretokens and n_tokens (null and empty texts: 0 and 0).

    Pre-tokens are the longest runs without ASCII white space. Rows that repeat are counted each, null ids stay
    null, an empty table gives an empty table. Of segmentations with equal sums the one with fewer tokens counts. Texts may
    be of any length, and so may pre-tokens. Ids are cast to long, and a text that is no number raises. Other columns
    are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(model_name, shift, byte_score)
        for batch in batches:
            words_of, tokens_of = [], []
            for text in batch.column(1):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []  # at ASCII white space only
                try:
                    counts = [t.terminal[w] for w in words]
                except KeyError:
                    counts = [t.count(w) for w in words]
                words_of.append(len(words))
                tokens_of.append(sum(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_of, pa.int64()), pa.array(tokens_of, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("binary")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
