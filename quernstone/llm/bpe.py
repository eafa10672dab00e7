"""BPE as a bounded-lookahead streaming transducer, and its inverse as a byte-to-text state machine.

From the merge list a sufficient lookahead is computed: how many bytes behind a token's start may
still change where it ends. Rule i, (u, v), can lose v only to an earlier rule that takes a symbol of
v's (or u's) right edge away to the right, and so on with ever earlier rules; the longest such chain
bounds the reach. While an unbroken word runs on, the encoder merges a window, emits the tokens that
end before the last `lookahead` bytes, and goes on from that boundary, so that a word of any length
takes constant memory; as nothing merges across a true boundary, the rest encodes as if alone. Words
shorter than a window are complete at once and are kept in a bounded memo.

The tokenizer file gives vocabulary, merges, end-of-word suffix and special tokens. Normalisation (NFC, white space
to one space, lower case) and the splitting pattern are those of the word-level files named in the
README. Decoding has two forms, both incremental: `StringDecoder` writes the vocabulary's strings, parted by
spaces, as the tokenizers library does for a file without a decoder; `ByteDecoder` restores text from bytes that may
break inside a character. `encode_decode` feeds ids and decoded bytes to running digests piece by piece, so that it
holds neither all ids nor the decoded text.

Defined results: null and empty texts have no ids and decode to "". Special tokens within a text are
matched as they stand, before normalisation. Unknown ids decode to nothing.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_text, table

#: Words that the memo keeps before it starts anew; symbols of a window; characters fed at once.
MEMO, WINDOW, FEED = 200_000, 1024, 1 << 18
_SHIFT = 20

# The splitting pattern; the plain one agrees with it on the characters of _PLAIN.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_SPLIT_PLAIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
_NOT_PLAIN = re.compile("[^\t-\r -~À-ɏ]")
_SPACES = regex.compile(r"\p{White_Space}+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def normalised(text: str) -> str:
    text = _SPACES.sub(" ", unicodedata.normalize("NFC", text))
    return text.replace("Σ", "σ").lower()  # letter by letter: no final sigma


def split(text: str) -> list[str]:
    if _NOT_PLAIN.search(text) is None:
        return _SPLIT_PLAIN.findall(text.lower())
    return _SPLIT.findall(normalised(text))


class Merges:
    """Vocabulary and merge list of a tokenizer file; encodes words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letters = byte_letters()
        self.inner = [vocab.get(c) for c in letters]
        self.last = [vocab.get(c + suffix) for c in letters]
        self.rules: dict[int, int] = {}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        for rank, (u, v) in enumerate(pairs):
            self.rules.setdefault(vocab[u] << _SHIFT | vocab[v], rank << _SHIFT | vocab[u + v])
        self.lookahead = sufficient_lookahead(pairs, suffix)
        self.longest = max(len(s) for s in vocab)
        self.raw = {i: s.encode("utf-8", "surrogatepass") for i, s in self.strings.items()}
        self.ids = list(range(max(self.strings) + 1))
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a symbol sequence, lowest rank first, leftmost first within a rank."""
        if len(ids) > 48:
            return self._merge_long(ids)
        rules = self.rules
        none = 1 << 60
        ranks = [rules.get(a << _SHIFT | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            new = best & ((1 << _SHIFT) - 1)
            ids[at : at + 2] = [new]
            del ranks[at]
            if at:
                ranks[at - 1] = rules.get(ids[at - 1] << _SHIFT | new, none)
            if at < len(ranks):
                ranks[at] = rules.get(new << _SHIFT | ids[at + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rules = len(ids), self.rules
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(got, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (got := rules.get(a << _SHIFT | b)) is not None]
        heapq.heapify(heap)
        while heap:
            got, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = got & ((1 << _SHIFT) - 1), False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (more := rules.get(ids[i] << _SHIFT | ids[after[i]])) is not None:
                    heapq.heappush(heap, (more, i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (more := rules.get(ids[before[i]] << _SHIFT | ids[i])) is not None:
                heapq.heappush(heap, (more, before[i], ids[before[i]], ids[i]))
        return [x for x, live in zip(ids, alive) if live]

    def word(self, word: str) -> tuple[int, ...]:
        got = self.memo.get(word)
        if got is None:
            stream = WordStream(self)
            got = (*stream.feed(word), *stream.close())
            if len(word) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = got = tuple(map(self.ids.__getitem__, got))  # one object for each id
        return got

    def words(self, words: list[str]) -> Iterator[int]:
        memo = self.memo
        try:
            return chain.from_iterable([memo[w] for w in words])
        except KeyError:
            return chain.from_iterable([memo.get(w) or self.word(w) for w in words])


def sufficient_lookahead(pairs: list[tuple[str, str]], suffix: str) -> int:
    """Bytes from a token's start beyond which no later input changes the token."""
    size = lambda s: len(s) - len(suffix) * (bool(suffix) and s.endswith(suffix))
    right: dict[str, str] = {}  # a symbol's right part, by the first rule that makes it
    best: dict[str, int] = {}  # the longest reach of the rules so far with that left part
    most = 1

    def edge(s: str | None) -> Iterator[str]:
        while s is not None:
            yield s
            s = right.get(s)

    for u, v in pairs:
        both = size(u) + size(v)
        reach = max([both, *(both - size(p) + best[p] for p in edge(v) if p in best), *(size(u) - size(p) + best[p] for p in edge(u) if p in best)])
        right.setdefault(u + v, v)
        best[u] = max(best.get(u, 0), reach)
        most = max(most, reach)
    return most


class WordStream:
    """Encodes one word piece by piece: feed() gives the ids that no later input can change, close() the rest."""

    def __init__(self, merges: Merges):
        self.m, self.buffer, self.size = merges, bytearray(), max(WINDOW, 2 * merges.lookahead)

    def feed(self, text: str) -> list[int]:
        self.buffer += text.encode("utf-8", "surrogatepass")
        if len(self.buffer) <= self.size:
            return []
        out, at = [], 0
        while len(self.buffer) - at > self.size:
            stop = at + self.size
            ids = self.m.merge([self.m.inner[b] for b in self.buffer[at:stop]])
            end = at
            for i in ids:  # each letter of an inner token stands for a byte
                n = len(self.m.strings[i])
                if end + n > stop - self.m.lookahead:
                    break
                out.append(i)
                end += n
            if end == at:  # not reached: size is twice the lookahead
                break
            at = end
        del self.buffer[:at]
        return out

    def close(self) -> list[int]:
        if not self.buffer:
            return []
        ids = self.m.merge([*(self.m.inner[b] for b in self.buffer[:-1]), self.m.last[self.buffer[-1]]])
        self.buffer.clear()
        return ids


def _cuttable(c: str) -> bool:
    return c.isalpha() and not "ᄀ" <= c <= "ᇿ" and not unicodedata.combining(c)


class StreamEncoder:
    """Encodes a text that comes in parts. It holds FEED characters and a part of a word, more only while there is no place to
    cut: no space and no letters that can be told apart."""

    def __init__(self, merges: Merges):
        self.m, self.raw, self.open = merges, "", None

    def feed(self, part: str) -> list[int]:
        self.raw += part
        if len(self.raw) < FEED:
            return []
        cut = max((self.raw.rfind(c) for c in " \n\t"), default=-1)
        if cut > len(self.raw) // 2:
            return self._take(cut, False)
        for cut in range(len(self.raw) - 64, len(self.raw) // 2, -1):  # inside a word: between letters, clear of marks and special tokens
            if all(map(_cuttable, self.raw[cut - 4 : cut + 1])) and "<" not in self.raw[cut - 32 : cut]:
                return self._take(cut, True)
        return []

    def _take(self, cut: int, within: bool) -> list[int]:
        text, self.raw = self.raw[:cut], self.raw[cut:]
        return list(self._encode(text, within))

    def close(self) -> list[int]:
        return self._take(len(self.raw), False)

    def _encode(self, text: str, within: bool) -> Iterable[int]:
        pieces = self.m.special_at.split(text) if self.m.special_at and self._special(text) else [text]
        if len(pieces) == 1 and not within and self.open is None:
            return self.m.words(split(text))
        out: list[int] = []
        for k, piece in enumerate(pieces):
            if k % 2:
                out += [*self._shut(), self.m.special[piece]]
                continue
            words = split(piece)
            if self.open is not None and words:
                if piece[0].isspace() or not words[0][0].isalpha():
                    out += self._shut()
                else:
                    out += self.open.feed(words.pop(0))
                    if words:
                        out += self._shut()
            last = words.pop() if within and k == len(pieces) - 1 and words else None
            out += self.m.words(words)
            if last is not None:
                self.open = WordStream(self.m)
                out += self.open.feed(last)
        if not within:
            out += self._shut()
        return out

    def _special(self, text: str) -> bool:
        return any(s in text for s in self.m.special)

    def _shut(self) -> list[int]:
        got, self.open = self.open.close() if self.open is not None else [], None
        return got


def pieces(merges: Merges, text: str | None) -> Iterator[list[int]]:
    """The ids of a text, in pieces of at most about FEED characters each."""
    if not text:
        return
    stream = StreamEncoder(merges)
    if len(text) < FEED:
        stream.raw = text
    else:
        for at in range(0, len(text), FEED):
            yield stream.feed(text[at : at + FEED])
    yield stream.close()


def encode(merges: Merges, text: str | None) -> list[int]:
    return [i for piece in pieces(merges, text) for i in piece]


class StringDecoder:
    """Writes ids out as the tokenizers library decodes them, piece by piece: their strings in UTF-8, a space between each two.

    What it keeps between pieces is whether anything was written.
    """

    def __init__(self, merges: Merges):
        self.raw, self.begun = merges.raw, False

    def feed(self, ids: list[int]) -> bytes:
        try:
            out = b" ".join(map(self.raw.__getitem__, ids))
            some = bool(ids)
        except KeyError:
            known = [s for i in ids if (s := self.raw.get(i)) is not None]
            out, some = b" ".join(known), bool(known)
        if some and self.begun:
            out = b" " + out
        self.begun |= some
        return out


def decoded(merges: Merges, ids: Iterable[int]) -> str:
    """The ids' strings with a space between each two."""
    return StringDecoder(merges).feed(list(ids)).decode("utf-8", "surrogatepass")


class ByteDecoder:
    """Restores text from ids one by one; bytes of a broken character wait for the rest, faulty ones become U+FFFD."""

    def __init__(self, merges: Merges, suffix: str = "</w>"):
        self.m, self.suffix = merges, suffix
        self.bytes = {c: b for b, c in enumerate(byte_letters())}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, i: int) -> str:
        s = self.m.strings.get(i)
        if s is None:
            return ""
        if s in self.m.special:
            return self.state.decode(b"", True) + s
        ends = bool(self.suffix) and s.endswith(self.suffix)
        raw = bytes(self.bytes[c] for c in (s[: -len(self.suffix)] if ends else s))
        return self.state.decode(raw, ends) + " " * ends

    def close(self) -> str:
        return self.state.decode(b"", True)


@cache
def load(path: str) -> Merges:
    return Merges(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded again."""
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        merges, rows = load(path), []
        for text in batch.column("text").to_pylist():
            n, decoder, ids_hash, text_hash = 0, StringDecoder(merges), hashlib.sha256(), hashlib.sha256()
            for ids in pieces(merges, text):
                n += len(ids)
                ids_hash.update(np.array(ids, "<u4").tobytes())
                text_hash.update(decoder.feed(ids))
            rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_text(docs.select("doc_id", "text"), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", run)


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
