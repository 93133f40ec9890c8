"""Token counts under a unigram model by dynamic programming over a trie of distinct pre-tokens."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import arrow, documents

#: Stored counts are started anew beyond so many words, which bounds a task's memory.
MOST_WORDS = 1_000_000
#: The counts that a worker process keeps from one task to the next, by vocabulary file.
KNOWN: dict[str, dict[bytes, int]] = {}
#: Log probability of a byte that no piece covers.
UNKNOWN = -30.0


@cache
def pieces(path: str) -> dict[bytes, float]:
    """Every prefix of a vocabulary file's pieces: its log probability if it is a piece itself, else 1.

    The file orders pieces by how early training chose them; without counts the scores are Zipf's law over that order.
    """
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return with_prefixes({p: -math.log(r + 2) for p, r in ranks.items()})


def with_prefixes(scores: dict[bytes, float]) -> dict[bytes, float]:
    norm = math.log(sum(map(math.exp, scores.values())))
    return {p[:k]: 1.0 for p in scores for k in range(1, len(p))} | {p: s - norm for p, s in scores.items()}


def forward(words: list[bytes], prefixes: dict[bytes, float]) -> Iterator[tuple[bytes, int]]:
    """(word, tokens of the best segmentation) for distinct words in ascending order.

    Sorted words are the leaves of their trie in the order of a walk, so only the nodes on the way to the current word
    are held: for each its forward score, the pieces of the best segmentation that ends there, and the starts from
    which a piece may still go on. What two words share is worked out once. Of equal scores the one with fewer pieces
    wins; a byte that no piece covers is a token of its own.
    """
    best, count, going, last = [0.0], [0], [[]], b""
    get = prefixes.get
    for word in words:
        shared, most = 0, min(len(word), len(last))
        while shared < most and word[shared] == last[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :], going[shared + 1 :]
        for i in range(shared, len(word)):
            top, fewest, on, end = -math.inf, 0, [], i + 1
            for start in (*going[i], i):
                score = get(word[start:end])
                if score is not None:
                    on.append(start)
                elif start < i:
                    continue
                if score is None or (score > 0 and start == i):
                    score = UNKNOWN
                if score <= 0:
                    total, n = best[start] + score, count[start] + 1
                    if total > top or (total == top and n < fewest):
                        top, fewest = total, n
            best.append(top)
            count.append(fewest)
            going.append(on)
        last = word
        yield word, count[-1]


def counted(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_tokens of each row; a pre-token is a blank and a word ``[^\\x20\\x09-\\x0D]+`` in UTF-8.

    Each worker walks one trie per batch, of the batch's words that it hasn't counted yet, and keeps the terminal counts
    of the words seen up to a bound; nothing is shuffled. Null and empty texts have 0 tokens.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillon.llm import tokens

        prefixes, known = pieces(path), tokens.KNOWN.setdefault(path, {})
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in b.column(1).to_pylist()]
                new = set().union(*texts).difference(known)
                if len(known) + len(new) > MOST_WORDS:
                    known.clear()
                    new = set().union(*texts)
                for word, n in forward(sorted(b" " + w for w in new), prefixes):
                    known[word[1:]] = n
                totals = [sum(map(known.__getitem__, t)) for t in texts]
                yield arrow({"doc_id": b.column(0), "n_words": list(map(len, texts)), "n_tokens": totals}, {"doc_id": pa.int64(), "n_words": pa.int64(), "n_tokens": pa.int64()})

    return documents(docs).mapInArrow(count, "doc_id bigint, n_words bigint, n_tokens bigint")
