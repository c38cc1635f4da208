"""Files nobody wrote by hand: generated, minified, vendored, or data saved as code.

Every patch is reduced to its tokens with identifiers, numbers and strings
masked, so that only the shape of the code remains; five-token shingles of that
shape are sketched by MinHash, banded, and verified by their Jaccard similarity.
The clusters of shapes propose: a family with several files in one repository
for generation, one across repositories for vendoring, one of literals for a
blob.  Hand-written code has families too, so an exact check follows: a proposed
file is confirmed by a mark of its own (a name that only tools use, a header in
its head, lines that no hand writes) or, where it shows none because a diff
rarely shows a file's head, by the marks of most of its family.

Files that no cluster can propose, because their patch is missing or nothing is
like them, are decided by their own marks; ``channel`` tells which way a verdict
came.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathework.plans.lineage import cut
from lathework.plans.skew import join_keyed

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4

#: Shapes that are compared in one go; a larger bucket is compared block by block.
BLOCK = 2048

# ---------------------------------------------------------------- what a name tells

_VENDORED_DIR = re.compile(
    r"(?:^|/)(?:vendor|_?vendored|_vendor|node_modules|bower_components|jspm_packages|third[-_]?party|3rd[-_]?party|Godeps|_workspace|Pods|Carthage|site-packages|dist-packages|\.?venv|virtualenv|\.eggs)/"
    r"|(?:^|/)(?:external|externals|extern|deps|bundled|contrib)/[^/]+/",
)
_GENERATED_NAME = re.compile(
    r"(?:^|/)(?:zz_generated[._][^/]*|[^/]*(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h|rs|swift|validate\.go)|\.pb\.gw\.go|_grpc\.pb\.go|_pb\.(?:js|ts|d\.ts|rb)|"
    r"[._-]generated\.[^/]+|[._-]gen\.[^/]+|\.g\.(?:dart|cs|ts|i\.cs)|\.freezed\.dart|\.designer\.cs|_string\.gen\.go|OuterClass\.java|Grpc\.java|"
    r"\.snap|\.graphql\.ts|\.tsbuildinfo|mock_[^/]*\.go|_mock\.go|bindata\.go|\.map|\.lock|-lock\.(?:json|yaml|yml)|\.lockfile|go\.sum|npm-shrinkwrap\.json|\.pbxproj))$"
    r"|(?:^|/)(?:__generated__|__snapshots__|generated|autogen|\.generated|gen|gen-src|__pycache__)/"
    r"|(?:^|/)docs?/api/[^/]+\.html$",
)
_MINIFIED_NAME = re.compile(
    r"[.-]min\.(?:js|css|mjs|cjs|html)$|[.-](?:bundle|packed|prod)\.(?:js|css)$|(?:^|/)(?:chunk|main|app|index|vendor|runtime|polyfills|styles|bundle)[.-][0-9a-f]{6,20}\.(?:js|css|mjs)$|\.[0-9a-f]{8,20}\.(?:js|css|mjs)$"
)
_ASSET = re.compile(r"\.(?:png|jpe?g|gif|ico|webp|bmp|tiff?|woff2?|ttf|otf|eot|pdf|zip|gz|tar|mp[34]|mov|wav|ogg)$", re.I)

# ---------------------------------------------------------------- what a header tells

_COMMENT = re.compile(r"^\s*(?:(?://+!?|#+!?|/\*+!?|\*+|--+|;+|<!--+|%+|\"\"\"|'''|REM\b|@REM\b)\s?)(.*?)(?:\*/|-->|\"\"\")?\s*$")
_TOOL = r"[\w.+-]+"
_GENERATED = re.compile(
    rf"^@generated\b|^<auto-?generated|^auto-?generated\b(?! ids?\b)|^(?:this|the) (?:file|code|class|module|source) (?:was|is|has been) (?:auto(?:matically)?[- ]?)?(?:generated|created|produced|built|written) (?:by|from|with|using|automatically)"
    rf"|^(?:code )?generated (?:\d{{4}}-\d\d-\d\d )?(?:by|from|with|using) {_TOOL}(?!.* on the server)|^(?:code |file )?(?:auto(?:matically)?[- ]?)generated (?:by|from|with|file|code|using|using)?"
    rf"|generated (?:by|from|with) .*(?:do not (?:edit|modify)|don't edit|edit the template)|do not (?:edit|modify)[^.]*generated|generated (?:code|file)[^.]*do not (?:edit|modify)"
    rf"|^output of {_TOOL}|^(?:built|emitted|compiled|produced|written|created|rendered) by {_TOOL}(?: {_TOOL}){{0,2}}$|regenerate (?:rather than|instead of|it|this|with|using)|changes (?:made )?(?:here|to this file|in this file) (?:will|are going to) be (?:lost|overwritten)"
    rf"|edit the (?:template|source|schema|generator|\.proto) instead|(?:datei|quelltext|code) wurde (?:von|mit|aus|automatisch).*(?:erzeugt|generiert|erstellt)|automatisch (?:erzeugt|generiert|erstellt)"
    rf"|(?:fichier|code) (?:a été |est )?(?:généré|produit|créé) (?:par|automatiquement|avec|à partir)|(?:archivo|fichero|código) (?:fue |ha sido |es )?(?:generado|creado|producido) (?:por|automáticamente|con|a partir)"
    rf"|(?:此|本)文件(?:由|是).*(?:生成|产生)|自动生成|自動生成|このファイルは.*(?:生成|作成)"
    rf"|^run `[^`]+` to (?:refresh|regenerate|update)|file, run `",
    re.I,
)
_VENDORED = re.compile(
    r"^vendored\b[: ]|^upstream\s*:\s*\S|^imported (?:at|from)\b|keep in sync with upstream|^copied (?:verbatim |unchanged |as is |from )|verbatim (?:copy )?(?:from|of) |^(?:taken|pulled|borrowed|mirrored|forked) (?:verbatim |unchanged )?from |report problems upstream"
    r"|^\(c\) (?:\d{4}[-, \d]* )?(?:the )?[\w.-]+ authors,? released under|^! ?[\w.-]+ v?\d+\.\d+|^[\w.@/-]+ v\d+\.\d+(?:\.\d+)?(?: \||$)|third[- ]party (?:code|source|copy|library)|do not patch here",
    re.I,
)
#: Words by which a header line says that it is about something else.
_NOT_HEADER = re.compile(r"drop-in|rewritten|inspired by|ids are generated|is set by|generated on the server|similar to|instead of the generated|based on ideas", re.I)

def content_of(patch: str) -> tuple[list[str], list[str]]:
    """Lines of the file after and before the change, as far as a patch shows them, without signs."""
    lines = patch.replace("\r\n", "\n").removesuffix("\r").split("\n")
    first = next((i for i, x in enumerate(lines) if x.startswith("@@")), len(lines))
    kept: list[str] = []
    lost: list[str] = []
    for line in lines[:first]:
        sign = line[:1]
        if sign == "+":
            kept.append(line[1:])
        elif sign == "-":
            lost.append(line[1:])
        elif sign == " ":
            kept.append(line[1:])
            lost.append(line[1:])
        elif sign and sign != "\\":
            kept.append(line)
    shown = [x for x in lines[first:] if x]
    kept += [x[1:] for x in shown if x[0] in "+ "]
    lost += [x[1:] for x in shown if x[0] in "- "]
    return kept, lost


def headers(lines: list[str]) -> tuple[bool, bool]:
    """Whether comment lines before the third line of code say that a tool made the file, or that it comes from elsewhere."""
    generated = vendored = False
    looked = 0
    named = False
    for line in lines:
        if not line.strip():
            continue
        comment = _COMMENT.match(line)
        if not comment:
            looked += 1
            if looked > 2:
                break
            continue
        text = comment.group(1).strip()
        text = re.sub(r"^[*#/!\- ]+(?=\w|@|<|\()", "", text) if not text.startswith("!") else text
        if not text or _NOT_HEADER.search(text):
            continue
        generated = generated or bool(_GENERATED.search(text))
        if re.match(r"^! ?[\w.-]+ v?\d+\.\d+", text) or (_VENDORED.search(text) and not re.match(r"^[\w.@/-]+ v\d+\.\d+(?:\.\d+)?$", text)):
            vendored = True
        if named and re.match(r"^https?://", text):
            vendored = True
        named = bool(re.match(r"^[\w.@/-]+ v\d+\.\d+(?:\.\d+)?$", text))
    return generated, vendored


def minified(lines: list[str]) -> bool:
    """Whether code stands in lines too long and dense to be written by hand."""
    if max(map(len, lines), default=0) <= 200:
        return False
    text_lines = [x for x in lines if x.strip()]
    total = sum(map(len, text_lines))
    dense = sum(len(x) for x in text_lines if len(x) > 200 and x.count(" ") * 12 < len(x) and len(re.findall(r"[;{}(),]", x)) * 14 > len(x))
    return dense * 2 > total and dense > 200


_STRING = re.compile(r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)")
_NAME_OR_NUMBER = re.compile(r"([^\W\d][\w$]*)|((?<!\w)[-+]?(?:0x[0-9a-fA-F]+|\d[\d_.]*(?:[eE][-+]?\d+)?[a-zA-Z]{0,2})\b)")


#: Lines that say something about the code; they are no part of its shape.
_REMARK = ("//", "#", "/*", "* ", "*/", "--", "<!--")


def masked_tokens(lines: list[str]) -> tuple[str, list[str], int, set[str]]:
    """The shape (one character per token: names ``I``, numbers ``N``, strings ``S``, marks as they are), and the strings, the number of numbers and the distinct names."""
    parts = _STRING.split("\n".join(lines))
    strings = parts[1::2]
    parts = _NAME_OR_NUMBER.split("\x01".join(parts[::2]))
    names = parts[1::3]
    form = [""] * (2 * len(names) + 1)
    form[::2] = parts[::3]
    form[1::2] = ["N" if name is None else "I" for name in names]
    held = set(names)
    held.discard(None)
    return "".join("".join(form).split()).replace("\x01", "S"), strings, names.count(None), held


def shape(lines: list[str]) -> str:
    return masked_tokens(lines)[0]


_WIDE = np.uint64(0x9E3779B97F4A7C15)


def shingles(form: str) -> np.ndarray:
    """Sorted hashes of the distinct five-token shingles; of a shorter text, the one shingle it is."""
    data = np.frombuffer(form.encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    if len(data) < SHINGLE:
        data = np.concatenate([data, np.zeros(SHINGLE - len(data), np.uint64)])
    codes = np.zeros(len(data) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        codes = (codes << np.uint64(8)) | data[i : len(data) - SHINGLE + 1 + i]
    codes *= _WIDE
    codes ^= codes >> np.uint64(29)
    codes *= np.uint64(0xBF58476D1CE4E5B9)
    codes ^= codes >> np.uint64(32)
    return np.unique((codes >> np.uint64(16)).astype(np.uint32).view(np.int32))


_SEED = np.random.RandomState(20).randint(1, 2**62, BANDS * ROWS, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_MIX = np.random.RandomState(21).randint(1, 2**62, BANDS * ROWS, dtype=np.int64).astype(np.uint64)


def bands(codes: np.ndarray) -> list[int]:
    """MinHash of the shingles, folded to one value per band."""
    mixed = (codes.view(np.uint32).astype(np.uint64)[:, None] ^ _MIX) * _SEED
    mixed ^= mixed >> np.uint64(31)
    least = mixed.min(axis=0).reshape(BANDS, ROWS)
    folded = least[:, 0]
    for i in range(1, ROWS):
        folded = (folded * _WIDE) ^ least[:, i]
    return folded.view(np.int64).tolist()


_EVIDENCE = "file_id bigint, repo string, asset boolean, by_name int, by_header int, by_shape int, literal double, tokens int, class bigint, codes array<int>, bands array<bigint>"

#: What evidence speaks for.
NONE, GENERATED, MINIFIED, VENDORED, BLOB = range(5)


def named(filename: str | None) -> int:
    """What the name alone tells."""
    name = filename or ""
    if _VENDORED_DIR.search(name):
        return VENDORED
    if _MINIFIED_NAME.search(name):
        return MINIFIED
    if _GENERATED_NAME.search(name):
        return GENERATED
    return NONE


#: Formats that hold settings or data by nature.
_SETTINGS = re.compile(r"\.(?:json|ya?ml|toml|xml|env|properties|ini|cfg|conf|tf|tfvars|md|rst|txt|csv|tsv|staging|production|npmrc|editorconfig)$|(?:^|/)\.env", re.I)


#: A string of encoded bytes.
_CODED = re.compile(r"[\"'`](?:[A-Za-z0-9+/]{40,}={0,2}|(?:\\x[0-9a-fA-F]{2}){10,})[\"'`]$")


def literal_share(lines: list[str], strings: list[str], numbers: int, names: set[str]) -> tuple[float, bool]:
    """Share of literals among literals and distinct names, and whether the lines are data: many literals, or a long one, and next to no names."""
    literals = len(strings) + numbers
    if not literals:
        return 0.0, False
    share = literals / (literals + len(names))
    if len(names) > 9:
        return share, False
    longest = max(map(len, strings), default=0)
    coded = sum(len(x) for x in strings if _CODED.match(x))
    long = max(longest, coded)
    size = sum(len(x) - x.count(" ") for x in lines)
    return share, (share >= 0.75 and literals >= 24) or (long >= 300 and long * 10 >= 8 * size and len(names) <= 6)


@lru_cache(maxsize=1 << 13)
def sketch(form: str) -> tuple[int, np.ndarray, list[int]]:
    """(class, shingles, bands) of a shape; many files have the same one."""
    codes = shingles(form)
    return int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=8).digest(), "little", signed=True), codes, bands(codes)


def inspect(filename: str | None, patch: str | None) -> tuple[int, int, float, str]:
    """(by header, by shape, literal share, shape) of a patch."""
    if not patch:
        return NONE, NONE, 0.0, ""
    kept, lost = content_of(patch)
    lines = kept if len(kept) > 3 or len(kept) >= len(lost) else lost
    if not lines:
        return NONE, NONE, 0.0, ""
    generated, vendored = headers(kept)
    if not generated and not vendored and lost:
        generated, vendored = headers(lost)
    header = GENERATED if generated else VENDORED if vendored else NONE
    code = [x for x in lines if not x.lstrip().startswith(_REMARK)]
    form, strings, numbers, names = masked_tokens(code)
    share, data = literal_share(code, strings, numbers, names)
    look = MINIFIED if minified(lines) else BLOB if data and not _SETTINGS.search(filename or "") else NONE
    return header, look, share, form


def _lists(arrays: list[np.ndarray | None] | tuple) -> pa.ListArray:
    """A column of int lists from arrays, null where there is none."""
    none = np.array([a is None for a in arrays], bool)
    sizes = [0 if a is None else len(a) for a in arrays]
    held = [a for a in arrays if a is not None]
    values = np.concatenate(held) if held else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()), mask=pa.array(none))


def evidence(files: DataFrame) -> DataFrame:
    """One row per input row with what its name, header and shape tell, and its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for filename, patch in zip(batch.column("filename").to_pylist(), batch.column("patch").to_pylist()):
                header, look, share, form = inspect(filename, patch)
                rows.append((bool(_ASSET.search(filename or "")), named(filename), header, look, share, len(form), *(sketch(form) if form else (None, None, None))))
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_id"), batch.column("repo"), *[_lists(c) if k == pa.list_(pa.int32()) else pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=[c.split()[0] for c in _EVIDENCE.split(", ")],
            )

    return files.select(F.col("file_id").cast("bigint").alias("file_id"), F.lower(F.trim("repo_full_name")).alias("repo"), "filename", "patch").mapInArrow(run, _EVIDENCE)


# ---------------------------------------------------------------- clusters of shapes


#: Cells of the matrix in which a block's shapes are compared.
CELLS = 1 << 24


class _Sets:
    """Sets of shingles, one after another in ``codes``, as rows of a matrix, in slices of the vocabulary where it would have more than ``CELLS`` cells."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        at, vocabulary = pd.factorize(codes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        width = max(1, CELLS // len(sizes))
        if len(vocabulary) <= width:
            self.whole, self.slices = self._matrix(owner, at, len(vocabulary)), []
            return
        self.whole = None
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        lows = range(0, len(vocabulary), width)
        bounds = [(low, *np.searchsorted(at, (low, low + width))) for low in lows]
        self.slices = [(owner[x:y], at[x:y] - low, min(width, len(vocabulary) - low)) for low, x, y in bounds]

    def _matrix(self, owner: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        held = np.zeros((len(self.sizes), width), np.float32)
        held[owner, at] = 1
        return held

    def similar(self, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
        """Which of the rows ``left`` are similar to which of ``right``."""
        if self.whole is not None:
            both = self.whole[left] @ self.whole[right].T
        else:
            both = np.zeros((len(left), len(right)), np.float32)
            for part in self.slices:
                held = self._matrix(*part)
                both += held[left] @ held[right].T
        return both >= similarity * (self.sizes[left][:, None] + self.sizes[right] - both)


def bucket_links(classes: np.ndarray, codes: np.ndarray, sizes: np.ndarray, similarity: float, sides: np.ndarray | None = None, step: int = 256) -> list[np.ndarray]:
    """Verified links, as rows of two classes, that connect whatever any two similar shapes connect.

    A search from each shape that nothing reached yet; shapes it has reached are
    linked already and not compared again.  With ``sides``, only shapes of the
    two different sides are compared.
    """
    sets = _Sets(codes, sizes)
    side = np.zeros(len(sizes), bool) if sides is None else sides != sides[0]
    left = [np.flatnonzero(~side), np.flatnonzero(side)]  # what nothing reached yet, by side
    front = [np.empty(0, np.int64), np.empty(0, np.int64)]
    links: list[np.ndarray] = []
    while len(left[0]) or len(left[1]):
        k = 0 if len(front[0]) else 1
        if not len(front[k]):
            if sides is not None and not (len(left[0]) and len(left[1])):
                break  # nobody to compare the rest with
            k = 0 if len(left[0]) else 1
            front[k], left[k] = left[k][:1], left[k][1:]
        now, front[k] = front[k][:step], front[k][step:]
        other = k if sides is None else 1 - k
        if not len(left[other]):
            continue
        near = sets.similar(left[other], now, similarity)
        hit = near.any(axis=1)
        if hit.any():
            reached = left[other][hit]
            links.append(np.column_stack([classes[reached], classes[now[near[hit].argmax(axis=1)]]]))
            front[other] = np.concatenate([front[other], reached])
            left[other] = left[other][~hit]
    return links


def similar_shapes(found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``a, b``: verified links between different shapes.

    ``found``: rows of ``class, codes, bands``; equal shapes are one row.  Shapes
    of one bucket with at least the given Jaccard similarity are linked, directly
    or over others.  Buckets of one shape are dropped, of buckets with the same
    shapes one is kept, and only then the shingles are sent there.  A bucket of
    more than ``BLOCK`` shapes is cut into blocks by a hash, and every two blocks
    meet in a task of their own: nothing is left out and no task sees more than
    two blocks.
    """

    def links_of(keys: np.ndarray, classes: np.ndarray, block: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
        if len(classes) < 2:
            return []
        return bucket_links(classes, codes, sizes, similarity, block if keys[0, 2] != keys[0, 3] else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None  # rows of a bucket that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("codes")
            offsets = lists.offsets.to_numpy()
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("band", "value", "low", "high")])
            here = [keys, batch.column("class").to_numpy(), batch.column("block").to_numpy(), np.diff(offsets), lists.values.to_numpy()[offsets[0] : offsets[-1]]]
            rest = here if rest is None else [np.concatenate(both) for both in zip(rest, here)]
            keys, classes, block, sizes, codes = rest
            starts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            ends = np.concatenate([[0], np.cumsum(sizes)])
            out: list[np.ndarray] = []
            for x, y in zip([0, *starts[:-1].tolist()], starts.tolist()):
                out += links_of(keys[x:y], classes[x:y], block[x:y], sizes[x:y], codes[ends[x] : ends[y]])
            last = int(starts[-1]) if len(starts) else 0
            rest = [keys[last:], classes[last:], block[last:], sizes[last:], codes[ends[last] :]]
            yield _pairs(out)
        if rest is not None:
            yield _pairs(links_of(*rest))

    shapes = found.dropDuplicates(["class"])
    entries = shapes.select("class", F.posexplode("bands").alias("band", "value"))
    # two sums of hashes tell whether buckets have the same shapes
    members = (F.bit_xor(F.xxhash64("class")).alias("h1"), F.sum(F.xxhash64("class", F.lit(1)).bitwiseAND(F.lit((1 << 31) - 1))).alias("h2"))
    buckets = entries.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), *members).filter("n > 1")
    kept = cut(buckets.groupBy("n", "h1", "h2").agg(F.min(F.struct("band", "value")).alias("bucket")).select("bucket.*", "n"))
    total = kept.agg(F.sum("n")).first()[0] or 0
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("class", "band"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    placed = join_keyed(entries, kept, ["band", "value"], F.col("n"), total).select("class", "band", "value", block.alias("block"), other.alias("other"))
    pairs = placed.select("class", "band", "value", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    key = ["band", "value", "low", "high"]
    # the least class leads the search, so that buckets of one family give the same links
    sent = pairs.join(shapes.select("class", "codes"), "class").repartition(*key).sortWithinPartitions(*key, "class")
    return sent.mapInArrow(run, "a bigint, b bigint").distinct()


def _pairs(links: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate(links) if links else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, i], pa.int64()) for i in (0, 1)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """``class, family``: connected components of ``a, b``; the family is the least member.

    Alternates large-star and small-star steps until no link changes, which keep
    the number of links bounded and need a number of rounds logarithmic in the
    component size; each round is written to the shared folder.
    """
    def mark(edges: DataFrame) -> tuple:
        """Tells sets of links apart: their number and two sums of their hashes."""
        low = F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit((1 << 31) - 1)))
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), low).first())

    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = mark(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), "m").unionAll(root.select("u", "m"))
        edges = cut(small.select("u", F.col("m").alias("v")).filter("u <> v").distinct())
        after = mark(edges)
        if after == before:
            found = edges.groupBy(F.col("u").alias("class")).agg(F.min("v").alias("family"))
            return found.unionAll(found.select(F.col("family").alias("class"), "family").distinct())
        before = after


#: A family proposes from so many files on; literals are so much of a blob's shape.
FEW, LITERAL = 2, 0.75
#: A family speaks for members without a mark from so many files and tokens on, for what at least half of its files show.
FAMILY, TOKENS, SHARE = 5, 20, 0.5


def verdicts(files: DataFrame) -> DataFrame:
    """``file_id, verdict, proposed, channel``: what speaks against handwriting, per file.

    verdict: 0 handwritten, 1 generated, 2 minified, 3 vendored, 4 blob; proposed:
    what the structure of the file's cluster proposes, 0 where it has none;
    channel: ``cluster`` for a proposed and confirmed file, ``alone`` for one that
    no cluster proposes, null for a handwritten one.  Rows that occur twice count
    once, of rows that share a file_id and differ the one with the least hash; a
    null or empty patch leaves the name alone; a binary asset is 0; an empty table
    gives an empty result.
    """
    everything = cut(evidence(files))
    # shingles do not travel with the files
    once = Window.partitionBy("file_id").orderBy(F.coalesce("class", F.lit(0)), "by_name", "by_header", "by_shape")
    found = everything.drop("codes", "bands").withColumn("nth", F.row_number().over(once)).filter("nth = 1").drop("nth")
    own = F.when(F.col("by_header") > 0, F.col("by_header")).when(F.col("by_name") > 0, F.col("by_name")).otherwise(F.col("by_shape"))
    shaped = found.filter("class IS NOT NULL")
    says = lambda kind: F.sum(F.when((F.col("by_name") == kind) | (F.col("by_header") == kind) | (F.col("by_shape") == kind), 1).otherwise(0)).alias(f"n{kind}")
    # hot shapes are combined on the map side, once per repository
    counts = cut(shaped.groupBy("class", "repo").agg(F.count(F.lit(1)).alias("n"), F.sum("literal").alias("literal"), F.max("tokens").alias("tokens"), *[says(k) for k in (1, 2, 3, 4)]))
    members = components(similar_shapes(everything.filter("class IS NOT NULL").select("class", "codes", "bands")))
    # a shape without similar ones is its own family
    placed = cut(counts.join(members, "class", "left").withColumn("family", F.coalesce("family", "class")))
    sums = [F.sum(c).alias(c) for c in ("n", "literal", "n1", "n2", "n3", "n4")]
    per_repo = placed.groupBy("family", "repo").agg(*sums, F.max("tokens").alias("tokens"))
    family = per_repo.groupBy("family").agg(*sums, F.max("tokens").alias("tokens"), F.max("n").alias("most"), F.count(F.lit(1)).alias("repos"))
    # the shape of the evidence: a blob's literals, copies across repositories, copies in one
    structure = (
        F.when((F.col("n") >= FEW) & (F.col("literal") >= LITERAL * F.col("n")), BLOB)
        .when(F.col("repos") > 1, VENDORED)
        .when(F.col("most") >= FEW, GENERATED)
        .otherwise(NONE)
    )
    share = lambda kind: F.col(f"n{kind}") >= SHARE * F.col("n")
    speaks = (
        F.when((F.col("n") < FAMILY) | (F.col("tokens") < TOKENS), NONE)
        .when(share(GENERATED) & (F.col("most") > 1), GENERATED)
        .when(share(MINIFIED), MINIFIED)
        .when(share(VENDORED) & (F.col("repos") > 1), VENDORED)
        .when(share(BLOB), BLOB)
        .otherwise(NONE)
    )
    judged = family.select("family", structure.alias("proposed"), speaks.alias("spoken"))
    classes = placed.groupBy("class").agg(F.min("family").alias("family"), F.sum("n").alias("files"))
    by_class = cut(classes.join(judged, "family").select("class", "files", "proposed", "spoken"))
    total = by_class.agg(F.sum("files")).first()[0] or 0
    told = join_keyed(found.select("file_id", "asset", "class", own.alias("own")), by_class, ["class"], F.col("files"), total, "left")
    proposed, spoken = F.coalesce("proposed", F.lit(NONE)), F.coalesce("spoken", F.lit(NONE))
    verdict = F.when(F.col("asset"), NONE).when(F.col("own") > 0, F.col("own")).when(proposed > 0, spoken).otherwise(NONE)
    channel = F.when(F.col("verdict") > 0, F.when(F.col("proposed") > 0, "cluster").otherwise("alone"))
    return told.select("file_id", verdict.alias("verdict"), proposed.alias("proposed")).withColumn("channel", channel)
