"""Token counts: greedy word-piece lengths by a linear longest-match automaton.

The trie of the vocabulary gets failure links: where the next letter has no branch,
the automaton pops the pieces that are settled and goes on in the node of what is
left. How many pieces a link pops is known beforehand, so counting adds numbers and
builds no piece, and no letter is read twice. All new words of a batch walk the trie
together, one letter a step.

Vocabularies are files of sentence pieces: a piece with the word mark starts a word,
one without goes on. A word in which some rest has no piece counts as one unknown token.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: Words of up to ``KEPT_LETTERS`` that a worker remembers; then it starts anew.
KEPT, KEPT_LETTERS = 300_000, 64
_START, _GO_ON = 0, 1


def vocabulary(path: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """(pieces that start a word, pieces that go on), without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in plain]
    starts = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    return starts, [p for p in pieces if MARK not in p]


class Automaton:
    """Trie with failure links. ``pops[v]`` is the number of pieces that the link of node v settles."""

    def __init__(self, starts: list[str], go_on: list[str]) -> None:
        branches: list[dict[str, int]] = [{}, {}]
        whole: set[int] = set()
        for root, pieces in ((_START, starts), (_GO_ON, go_on)):
            for piece in pieces:
                at = root
                for ch in piece:
                    if ch not in branches[at]:
                        branches[at][ch] = len(branches)
                        branches.append({})
                    at = branches[at][ch]
                whole.add(at)
        size = len(branches)
        self.fail = np.full(size, -1, np.int64)
        self.pops = np.zeros(size, np.int64)
        queue = deque([_START, _GO_ON])
        while queue:
            u = queue.popleft()
            for ch, v in branches[u].items():
                queue.append(v)
                if v in whole:
                    self.fail[v], self.pops[v] = _GO_ON, 1
                    continue
                z, settled = self.fail[u], self.pops[u]
                while z >= 0 and ch not in branches[z]:
                    settled += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = branches[z][ch], settled
        self.width = 1 + max((ord(ch) for b in branches for ch in b), default=0)
        keys = np.array([u * self.width + ord(ch) for u, b in enumerate(branches) for ch in b], np.int64)
        ends = np.array([v for b in branches for v in b.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.ends = keys[order], ends[order]

    def counts(self, words: list[str]) -> np.ndarray:
        """Pieces of each word; -1 for a word with a rest that no piece starts. The empty word has none."""
        order = np.argsort([-len(w) for w in words], kind="stable")
        size = np.array([len(words[k]) for k in order], np.int64)
        letters = np.frombuffer("".join(words[k] for k in order).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        node = np.full(len(words), _START, np.int64)
        total = np.zeros(len(words), np.int64)
        lost = np.zeros(len(words), bool)
        for t in range(int(size.max(initial=0))):
            rows = np.flatnonzero(~lost[: np.searchsorted(-size, -t, side="left")])
            ch = letters[first[rows] + t]
            while len(rows):
                key = node[rows] * self.width + ch
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                there = (ch < self.width) & (self.keys[at] == key) if len(self.keys) else np.zeros(len(rows), bool)
                node[rows[there]] = self.ends[at[there]]
                rows, ch = self._fall(rows[~there], node, total, lost), ch[~there]
                ch = ch[~lost[rows]]
                rows = rows[~lost[rows]]
        rows = np.flatnonzero(~lost & (size > 0) & (node != _GO_ON))
        while len(rows):
            rows = self._fall(rows, node, total, lost)
            rows = rows[~lost[rows] & (node[rows] != _GO_ON)]
        out = np.empty(len(words), np.int64)
        out[order] = np.where(lost, -1, total)
        return out

    def _fall(self, rows: np.ndarray, node: np.ndarray, total: np.ndarray, lost: np.ndarray) -> np.ndarray:
        """Follow the failure links of ``rows``; those without one are lost."""
        at = node[rows]
        lost[rows] = self.fail[at] < 0
        total[rows] += self.pops[at]
        node[rows] = np.maximum(self.fail[at], 0)
        return rows


_AUTOMATA: dict[str, tuple[Automaton, dict[str, int]]] = {}


def _automaton(path: str) -> tuple[Automaton, dict[str, int]]:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(*vocabulary(path)), {}
    return _AUTOMATA[path]


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every whole text, words cut at the six ASCII blanks.

    Null and empty texts have no words. An unknown word is one token. Repeated
    rows count alike, texts of any length whole; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(path)
        blanks = {ord(c): " " for c in "\t\n\r\x0b\x0c"}
        for rows in batches:
            texts = rows.column(1).to_pylist()
            out: list[tuple[int, int, int]] = []
            for at in range(0, len(texts), 200):
                cut = [[w for w in (t or "").translate(blanks).split(" ") if w] for t in texts[at : at + 200]]
                new = list({w for t in cut for w in t if w not in known})
                if len(known) + len(new) > KEPT:
                    known.clear()
                    new = list({w for t in cut for w in t})
                known.update(zip(new, automaton.counts(new).tolist(), strict=True))
                for t in cut:
                    n = [known[w] for w in t]
                    unknown = n.count(-1)
                    out.append((len(t), sum(n) + 2 * unknown, unknown))
                for w in new:
                    if len(w) > KEPT_LETTERS:
                        del known[w]
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_tokens", "n_unknown"]
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        of_batch, f"doc_id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint"
    )
