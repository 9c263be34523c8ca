"""BPE encoding by speculation: greedy longest match first, exact merging where it fails.

The vocabulary file is a parameter. Texts are cut into words, as the library cuts
them; a word's tokens do not depend on its neighbours, so each word is encoded once
per worker and kept in a bounded table. For words not yet known, a trie proposes the
longest token at each place. A proposal is right exactly if each adjacent pair of tokens is
itself the encoding of its text; the pairs of all proposals are tested together
on arrays by walking back the merges along their common border. Only words with
a pair that fails are merged step by step.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Words that a worker remembers, and their characters; then it starts anew.
KEPT, KEPT_CHARS = 500_000, 16_000_000
#: Symbols up to which a word is merged in a list.
SHORT = 64
_NONE = int(np.iinfo(np.int64).max)
#: Bits of a token id below the rank in one number.
_ID_BITS = 20


class WordBpe:
    """Encoder for a vocabulary whose words end in a suffixed symbol and whose text is cut at blanks."""

    def __init__(self, path: str = VOCABULARY) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = said["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in said["added_tokens"]}
        self.merges = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        size = max(self.text) + 1
        #: Rank of the merge that makes a token, and its two parts; symbols have rank -1 and no parts.
        self.rank = np.full(size, -1, np.int64)
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        keys, ranks, wholes = [], [], []
        for (a, b), r in self.merges.items():
            whole, x, y = self.ids[a + b], self.ids[a], self.ids[b]
            self.rank[whole], self.left[whole], self.right[whole] = r, x, y
            keys.append(x * size + y)
            ranks.append(r)
            wholes.append(whole)
        order = np.argsort(keys)
        self.size, self.pair_keys, self.pair_ranks = size, np.array(keys)[order], np.array(ranks)[order]
        self.join = {k: r << _ID_BITS | w for k, r, w in zip(keys, ranks, wholes, strict=True)}
        chars = [chr(_BYTE_CHARS.get(x, x)) for x in range(256)]
        self.byte_of = {c: x for x, c in enumerate(chars)}
        self.symbol = [self.ids[c] for c in chars]
        self.last_symbol = [self.ids[c + self.suffix] for c in chars]
        self.trie: dict = {}
        self._fill_trie()
        self.special_of = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, self.special_of)))
        self.known: dict[str, bytes] = {}
        self.said: dict[str, str] = {}
        self.known_chars = 0

    def _symbols(self, word: bytes) -> list[int]:
        """Ids of a word's bytes, the last one with the suffix."""
        out = [self.symbol[x] for x in word]
        out[-1] = self.last_symbol[word[-1]]
        return out

    def _fill_trie(self) -> None:
        """Paths of symbols to each token that is the encoding of its own text; its id is at -1."""
        for token, i in self.ids.items():
            inner = token.removesuffix(self.suffix)
            ends = inner and inner != token
            raw = bytes(self.byte_of[c] for c in (inner if ends else token))
            symbols = self._symbols(raw) if ends else [self.symbol[x] for x in raw]
            if self.merged(symbols) != [i]:
                continue
            node = self.trie
            for s in symbols:
                node = node.setdefault(s, {})
            node[-1] = i

    def merged(self, parts: list[int]) -> list[int]:
        """Exact merging: the pair of lowest rank, leftmost first, until none is left."""
        return self._merged_list(parts) if len(parts) <= SHORT else self._merged_heap(parts)

    def _merged_list(self, parts: list[int]) -> list[int]:
        """Merging with the ranks of all pairs in a list, which is fastest for few parts."""
        parts, size, get = list(parts), self.size, self.join.get
        ranks = [get(a * size + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) != _NONE:
            at = ranks.index(low)
            parts[at] = low & (1 << _ID_BITS) - 1
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] * size + parts[at], _NONE)
            if at < len(ranks):
                ranks[at] = get(parts[at] * size + parts[at + 1], _NONE)
        return parts

    def _merged_heap(self, parts: list[int]) -> list[int]:
        """Merging in n log n: parts are linked to their neighbours and pairs wait in a heap.

        A pair whose parts have changed since is passed over.
        """
        parts, size, get, n = list(parts), self.size, self.join.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(low, k, a, b) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (low := get(a * size + b)) is not None]
        heapify(heap)
        while heap:
            low, at, a, b = heappop(heap)
            to = after[at]
            if parts[at] != a or to == n or parts[to] != b:
                continue
            parts[at], parts[to] = low & (1 << _ID_BITS) - 1, -1
            after[at] = nxt = after[to]
            if nxt < n:
                before[nxt] = at
                if (up := get(parts[at] * size + parts[nxt])) is not None:
                    heappush(heap, (up, at, parts[at], parts[nxt]))
            if (prev := before[at]) >= 0 and (up := get(parts[prev] * size + parts[at])) is not None:
                heappush(heap, (up, prev, parts[prev], parts[at]))
        return [p for p in parts if p >= 0]

    def proposed(self, symbols: list[int]) -> list[int]:
        """Longest tokens from the left; each symbol is a token itself."""
        out, at, n, trie = [], 0, len(symbols), self.trie
        while at < n:
            node, end = trie, at
            while end < n:
                node = node.get(symbols[end])
                if node is None:
                    break
                end += 1
                if -1 in node:
                    best, stop = node[-1], end
            out.append(best)
            at = stop
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair: whether merging the text of both gives just these two tokens.

        Walks down the right edge of ``a`` and the left edge of ``b``, undoing the
        later merge first. A pair fails if its border could have been merged
        before the merge that was undone last (on the left side: or with it).
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        rows = np.arange(len(a))
        limit = np.full(len(a), _NONE)
        while len(rows):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)
            bad = rank < limit
            ok[rows[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & (np.maximum(ra, rb) >= 0)
            rows, a, b, ra, rb = rows[go], a[go], b[go], ra[go], rb[go]
            down = ra > rb
            limit = np.where(down, ra, rb + 1)
            a, b = np.where(down, self.right[a], a), np.where(down, b, self.left[b])
        return ok

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words: proposals where all pairs hold, else exact merging. Of no words, nothing."""
        if not words:
            return []
        symbols = [self._symbols(w) for w in words]
        tried = [self.proposed(w) for w in symbols]
        counts = np.array([len(t) for t in tried], np.int64)
        flat = np.array([i for t in tried for i in t], np.int64)
        word = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(word[1:] == word[:-1])
        if len(inner):
            pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            holds = self.compatible(pairs // self.size, pairs % self.size)[back]
            for k in np.unique(word[inner[~holds]]).tolist():
                tried[k] = self.merged(symbols[k])
        return tried

    def words(self, text: str | None) -> list[str]:
        """Words of a text: in plain texts as the pattern cuts them, in others chunks that need the library stay whole."""
        text = text or ""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return _SPLIT.findall(text.lower())
        out = []
        for chunk in text.translate(_BLANKS).split(" "):
            if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
                out += _SPLIT.findall(chunk.lower())
            else:
                out.append(_WHOLE + chunk)
        return out

    def _pieces(self, chunk: str) -> Iterator[bytes | int]:
        """What the library cuts a chunk into: words, and ids of the special tokens, which are cut out first."""
        at = 0
        for found in [*self.special.finditer(chunk), None]:
            plain = chunk[at : found.start() if found else len(chunk)]
            for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(plain)):
                yield bytes(map(self.byte_of.__getitem__, piece))
            if found:
                yield self.special_of[found.group()]
                at = found.end()

    def _learn(self, words: list[str], say: bool) -> None:
        """Enter words into the table: their little-endian ids, and what they decode to if asked."""
        cut: dict[str, list[bytes | int]] = {w: list(self._pieces(w[1:])) if w[0] == _WHOLE else [w.encode()] for w in words}
        fresh = list(dict.fromkeys(x for c in cut.values() for x in c if isinstance(x, bytes)))
        encoded: dict[bytes | int, list[int]] = dict(zip(fresh, self.encode_words(fresh), strict=True))
        encoded |= {i: [i] for i in self.special_of.values()}
        for w, c in cut.items():
            ids = encoded[c[0]] if len(c) == 1 else [i for x in c for i in encoded[x]]
            self.known[w] = _U32[len(ids)].pack(*ids) if len(ids) < len(_U32) else np.array(ids, "<u4").tobytes()
            self.known_chars += len(w)
            if say:
                self.said[w] = " ".join(map(self.text.__getitem__, ids))

    def _looked_up(self, texts: list[str | None], say: bool) -> Iterator[list[str]]:
        """Words of each text, all of them in the table."""
        for group in _bounded(texts):
            cut = [self.words(t) for t in group]
            new = set().union(*cut).difference(self.said if say else self.known)
            if len(new) + len(self.known) > KEPT or self.known_chars > KEPT_CHARS:
                self.known.clear()
                self.said.clear()
                self.known_chars = 0
                new = set().union(*cut)
            if new:
                self._learn(list(new), say)
            yield from cut

    def ids_of(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers; a null text is empty."""
        for words in self._looked_up(texts, False):
            yield b"".join(map(self.known.__getitem__, words))

    def both_ways(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Ids of each text, and their decoding."""
        for words in self._looked_up(texts, True):
            yield b"".join(map(self.known.__getitem__, words)), " ".join(filter(None, map(self.said.__getitem__, words)))


#: Blanks, printable ASCII and Latin-1 letters: lower case and words are the same in every library.
_PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9\t\n\x0b\x0c\r ]+")
#: Before a chunk that is not cut by the pattern.
_WHOLE = "\0"


def _byte_chars() -> dict[int, int]:
    """The printable character that stands for each byte outside the printable ones, counted on from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()
_U32 = [struct.Struct(f"<{n}I") for n in range(64)]
_BLANKS = {ord(c): " " for c in "\t\n\r\x0b\x0c"}
#: Characters of the texts whose words are looked up together.
_GROUP = 400_000


def _bounded(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about ``_GROUP`` characters, so that their words fit in the table."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= _GROUP:
            yield part
            part, size = [], 0
    if part:
        yield part


_ENCODERS: dict[str, WordBpe] = {}


def encoder(path: str = VOCABULARY) -> WordBpe:
    """The worker's encoder for a vocabulary file, made once per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]


def round_trip(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, a row per document.

    Null and empty texts have no tokens; a text of special tokens alone has just
    these. Texts of any length are encoded whole. Repeated rows are encoded alike; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for rows in batches:
            counts, of_ids, of_text = [], [], []
            for ids, said in bpe.both_ways(rows.column(1).to_pylist()):
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(said.encode()).hexdigest())
            arrays = [rows.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        of_batch, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
