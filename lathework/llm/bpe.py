"""Byte-level BPE as a streaming transducer with bounded lookahead.

Text is read in blocks.  A pre-token is emitted once no further input can change
it (the splitting pattern looks at most two characters ahead).  Every pre-token
goes through ``Transducer``, byte by byte; what it gave for a pre-token is
remembered, because most occur again.

State.  The encoding of a prefix is its last token after the encoding of the
prefix before that token, so one token per position is all the transducer keeps.
Exactly one token can be last: one that the merges produce from its own bytes and
leave standing beside the last token of the prefix before it.

Sufficient lookahead.  Let two texts share a prefix, and compare their merges
rank by rank.  The point up to which they agree moves left only when a merge
(a, b) is done in one of them alone, and then by the length of ``a``; the merge
that moves it next has a higher rank and a right part that begins with ``a``.
The longest such chain in the merge list bounds the way the point can move in
all, so a token that ends ``lookahead`` bytes before the end of what was read is
stable whatever follows.  The window never holds more than twice that.

Decoding runs the other way: tokens give bytes, and an incremental UTF-8 state
machine gives characters as soon as they are complete.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary is found on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: how the vocabulary's merges expect text to be split.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters the pattern can look beyond the end of a match ("'l" may become "'ll").
PATTERN_LOOKAHEAD = 2

#: Characters of an unfinished pre-token that wait for its end; beyond, it is fed to the transducer as it arrives.
HELD = 512

#: Remembered pre-tokens; the memory of a task stays bounded.
MEMO = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeList:
    """The merges of a byte-level BPE vocabulary file."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.id_of: dict[bytes, int] = {raw(t): i for t, i in model["vocab"].items()}
        self.bytes_of: dict[int, bytes] = {i: b for b, i in self.id_of.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merge[self.id_of[a], self.id_of[b]] = rank, self.id_of[a + b]
        self.lookahead = self._lookahead()
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self._fits: dict[tuple[int, int], bool] = {}
        self._own: dict[int, bool] = {}
        self._starts: set[bytes] | None = None

    def _lookahead(self) -> int:
        """Bytes after which a token is stable: the longest chain of merges of rising rank in which each right part begins with the left part before."""
        begins: dict[int, int] = {}  # token -> the left part it is merged from
        chain: dict[int, int] = {}  # left part -> the longest chain that ends with one of its merges
        for (a, b), (_, whole) in sorted(self.merge.items(), key=lambda m: m[1][0]):
            before, part = 0, b
            while part is not None:
                before = max(before, chain.get(part, 0))
                part = begins.get(part)
            chain[a] = max(chain.get(a, 0), len(self.bytes_of[a]) + before)
            begins[whole] = a
        return max(chain.values(), default=0)

    def merged(self, word: bytes) -> list[int]:
        """All merges of one token or pair of tokens, lowest rank first."""
        ids = [self.single[b] for b in word]
        merge = self.merge
        while len(ids) > 1:
            best = min((merge[p] for p in zip(ids, ids[1:]) if p in merge), default=None)
            if best is None:
                break
            rank, whole = best
            out, i, last = [], 0, len(ids) - 1
            while i <= last:
                if i < last and merge.get((ids[i], ids[i + 1]), (-1,))[0] == rank:
                    out.append(whole)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def own(self, token: int) -> bool:
        """Whether the merges produce ``token`` from its own bytes."""
        known = self._own.get(token)
        if known is None:
            known = self._own[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > MEMO:
                self._fits.clear()
            known = self._fits[left, right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def suffixes(self) -> set[bytes]:
        """Ends of tokens, to stop looking for longer tokens early."""
        if self._starts is None:
            self._starts = {t[i:] for t in self.id_of for i in range(len(t))}
        return self._starts


class Transducer:
    """Encodes one pre-token of any length; holds what later bytes may still change."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.data = bytearray()  # bytes since the last emitted boundary
        self.last: list[int] = [-1]  # last token of the encoding of each prefix from there
        self.begun = False  # whether something was emitted

    def feed(self, more: bytes) -> list[int]:
        """The tokens that ``more`` makes stable."""
        m, out = self.merges, []
        ends, id_of, full = m.suffixes(), m.id_of, 2 * m.lookahead + 2
        for byte in more:
            data, last = self.data, self.last
            data.append(byte)
            n = len(data)
            found, at = -1, n - 1
            while at >= 0:
                piece = bytes(data[at:])
                if piece not in ends:
                    break
                token = id_of.get(piece)
                if token is not None and m.own(token):
                    before = last[at]
                    if m.fits(before, token) if before >= 0 else at == 0 and not self.begun:
                        found = token
                        break
                at -= 1
            last.append(found)
            if n >= full:
                out += self._emit(n - m.lookahead)
        return out

    def _emit(self, upto: int) -> list[int]:
        """Emits the tokens of the present encoding that end at ``upto`` bytes or before."""
        size = self.merges.bytes_of
        p, end, out = len(self.data), None, []
        while p > 0:
            if p <= upto:
                end = p if end is None else end
                out.append(self.last[p])
            p -= len(size[self.last[p]])
        if end:
            self.begun = True
            self.data = self.data[end:]
            self.last = self.last[end:]
        return out[::-1]

    def close(self) -> list[int]:
        """The rest, once the pre-token is known to end."""
        return self._emit(len(self.data))


class Encoder:
    """Text in, token ids out."""

    def __init__(self, merges: MergeList, block: int = 1 << 16, held: int = HELD):
        self.merges, self.block, self.held = merges, block, held
        self.pattern = regex.compile(PATTERN)
        self.memo: dict[str, list[int]] = {}

    def _word(self, word: str) -> list[int]:
        through = Transducer(self.merges)
        ids = through.feed(word.encode("utf-8", "surrogatepass"))
        ids += through.close()
        if len(word) <= self.held:
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; none for null and for empty text."""
        out: list[int] = []
        if text:
            for ids in self.stream(text[i : i + self.block] for i in range(0, len(text), self.block)):
                out += ids
        return out

    def stream(self, blocks: Iterable[str]) -> Iterator[list[int]]:
        """Ids as they become stable, for text that arrives in blocks."""
        rest = ""
        long: Transducer | None = None
        kind = None
        for block in blocks:
            text = rest + block
            rest = ""
            start = 0
            if long is not None:
                # inside a long pre-token: everything of its kind belongs to it
                run = kind.match(text).end()
                held = 1 if kind is _SPACES else 0  # the last space goes to a word that follows
                if run == len(text):
                    cut = max(0, run - held)
                    yield [*long.feed(text[:cut].encode("utf-8", "surrogatepass"))]
                    rest = text[cut:]
                    continue
                cut = max(0, run - held)
                yield [*long.feed(text[:cut].encode("utf-8", "surrogatepass")), *long.close()]
                long, start = None, cut
            stable = len(text) - PATTERN_LOOKAHEAD
            out: list[int] = []
            memo = self.memo
            end = start
            for match in self.pattern.finditer(text, start):
                if match.end() > stable:
                    break
                word = match.group()
                ids = memo.get(word)
                out += self._word(word) if ids is None else ids
                end = match.end()
            rest = text[end:]
            if len(rest) > self.held:
                # one pre-token reaches the end of what is here
                match = self.pattern.match(rest)
                if match.end() == len(rest):
                    probe = rest[1] if rest[0] == " " and len(rest) > 1 else rest[0]
                    kind = next(k for k in _KINDS if k.match(probe).end())
                    long = Transducer(self.merges)
                    cut = len(rest) - (kind is _SPACES)
                    out += long.feed(rest[:cut].encode("utf-8", "surrogatepass"))
                    rest = rest[cut:]
            yield out
        out = []
        if long is not None:
            out += long.feed(rest.encode("utf-8", "surrogatepass"))
            out += long.close()
            rest = ""
        memo = self.memo
        for word in self.pattern.findall(rest):
            ids = memo.get(word)
            out += self._word(word) if ids is None else ids
        yield out


#: What a pre-token goes on with, by its kind.
_SPACES = regex.compile(r"\s*")
_KINDS = [regex.compile(r"\p{L}*"), regex.compile(r"\p{N}*"), regex.compile(r"[^\s\p{L}\p{N}]*"), _SPACES]


class Decoder:
    """Token ids in, text out; bytes of an unfinished character wait for the next token."""

    def __init__(self, merges: MergeList):
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(self.bytes_of[i] for i in ids))

    def close(self) -> str:
        return self.state.decode(b"", True)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(MergeList(path))
    return _ENCODERS[path]


def encode_texts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids`` for the ``doc_id`` and ``text`` of every row.

    A null text and an empty text give an empty list; a null doc_id stays null;
    rows that occur twice give two rows.  Special tokens have no meaning in text.
    """
    id_type = documents.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            offsets, flat = [0], []
            for text in batch.column("text").to_pylist():
                flat += encode(text)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, ids array<int>")


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, tokens``, the number of ids ``encode_texts`` gives, and the columns to ``keep``."""
    carried = ["doc_id", *keep]
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in carried) + ", tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            sizes = [len(encode(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(sizes, pa.int32())], names=[*carried, "tokens"])

    return documents.select(*carried, "text").mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, tokenizer: str = TOKENIZER, step: int = 4096) -> DataFrame:
    """``doc_id, text`` for rows of ``doc_id, ids``; null ids give null, none give an empty text."""
    id_type = encoded.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = encoder(tokenizer).merges
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                if ids is None:
                    texts.append(None)
                    continue
                decoder = Decoder(merges)
                texts.append("".join([*(decoder.feed(ids[i : i + step]) for i in range(0, len(ids), step)), decoder.close()]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type.simpleString()}, text string")
