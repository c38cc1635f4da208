"""Cutting oversized texts at natural boundaries, by agglomerative merging.

A text starts as atomic segments (lines; words where a line alone is too long;
characters where a word is).  Every boundary between neighbours has a strength:
a file header of a diff or a heading is strong, a line end inside a block is
weak, a space inside a line weaker still.  All boundaries are held in a heap and
the weakest is merged first, as long as the merged segment plus the overlap
stays within the limit; sizes only grow, so a boundary that does not fit stays.
What remains are the pieces.  Each piece after the first is preceded by the end
of the piece before it, cut at a line or a word where one begins in reach.

Only texts over their limit are sent to Python, after a shuffle by their id that
also drops repeated rows; the limits are the broadcast side of a join, one row
per kind of item.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundary strengths, from inside a word to the start of a file in a diff.
INSIDE, WORD, CLAUSE, LINE, SHALLOW, BLANK, BLOCK, SECTION, FILE = range(9)

_DEFINES = re.compile(
    r"\s*(?:(?:export|public|private|protected|static|abstract|async|final|pub|default)\s+)*"
    r"(?:def|class|func|function|interface|struct|enum|impl|trait|type|module|namespace|resource|CREATE|SELECT|package|fn)\b|\s*@\w+|\s*[\w.#-]+\s*\{\s*$"
)
_HEADING = re.compile(r" {0,3}#{1,6}\s|.*\n?(?:={3,}|-{3,})\s*$")
_WORDS = re.compile(r"[^\s]+[^\S\n]*|[^\S\n]+|\n")
_CLAUSE_END = re.compile(r"[.!?;:。！？；、，,]\s*$|[)}\]>]\s*$")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def _atoms(text: str, most: int, diff: bool) -> tuple[list[str], list[int]]:
    """Segments of at most ``most`` characters, and the strength of the boundary before each."""
    parts: list[str] = []
    strength: list[int] = []
    before_blank = False
    last_indent = 0
    for line in text.split("\n"):
        line += "\n"
        body = line[1:] if diff and line[:1] in "+- " else line
        blank = not body.strip()
        if diff and line.startswith("diff --git "):
            level = FILE
        elif diff and line.startswith("@@"):
            level = SECTION
        elif blank:
            level = LINE
        elif not diff and _HEADING.match(line):
            level = SECTION
        elif before_blank:
            level = BLOCK if _DEFINES.match(body) and _indent(body) == 0 else BLANK
        elif _DEFINES.match(body):
            level = BLANK if _indent(body) <= last_indent else SHALLOW
        else:
            level = SHALLOW if _indent(body) < last_indent else LINE
        if not blank:
            last_indent = _indent(body)
        before_blank = blank
        if len(line) <= most:
            parts.append(line)
            strength.append(level)
            continue
        clause = False
        for word in _WORDS.findall(line):
            inner = level if level is not None else (CLAUSE if clause else WORD)
            level = None
            clause = bool(_CLAUSE_END.search(word))
            for i in range(0, len(word), most):
                parts.append(word[i : i + most])
                strength.append(inner if i == 0 else INSIDE)
    # the split added a line end after the last line
    parts[-1] = parts[-1][:-1]
    if not parts[-1]:
        parts.pop()
        strength.pop()
    for i in range(1, len(parts)):
        if parts[i] == "\n" and parts[i - 1].endswith("\r"):
            strength[i] = -1  # never between the two characters of a line end
    return parts, strength


def merge_weakest(sizes: list[int], strength: list[int], most: int) -> list[int]:
    """Starts of the merged segments: neighbours joined over the weakest boundary while they fit ``most``."""
    n = len(sizes)
    size = list(sizes)
    left = list(range(-1, n - 1))
    right = list(range(1, n + 1))
    alive = [True] * n
    heap = [(strength[i], size[i - 1] + size[i], i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        level, together, i = heapq.heappop(heap)
        if not alive[i]:
            continue
        k = left[i]
        now = size[k] + size[i]
        if now > most:
            continue
        if now != together:
            heapq.heappush(heap, (level, now, i))
            continue
        size[k] = now
        alive[i] = False
        right[k] = right[i]
        if right[i] < n:
            left[right[i]] = k
    return [i for i in range(n) if alive[i]]


def overlap_start(text: str, begin: int, end: int, most: int) -> int:
    """Where the overlap with the piece ``[begin, end)`` starts: at a line or word if one starts in reach."""
    if most <= 0:
        return end
    low = max(begin, end - most)
    if low > begin:
        line = text.find("\n", low - 1, end - 1)
        if line >= 0:
            return line + 1
        space = re.compile(r"(?<=\s)\S").search(text, low, end)
        if space:
            return space.start()
        if text[low - 1 : low + 1] == "\r\n" and low + 1 < end:
            low += 1
    return low


def split_spans(text: str, max_size: int, overlap: int, diff: bool = False) -> list[tuple[int, int, int]]:
    """(start of the overlap, start of the new part, end) of each piece; one piece if the text fits.

    The new parts cover the text without gap; overlap and new part together have
    at most ``max_size`` characters.  An overlap as large as the limit would
    leave no room for new text and counts as one less.
    """
    if max_size < 1:
        raise ValueError("max_size must be positive")
    if len(text) <= max_size:
        return [(0, 0, len(text))]
    overlap = min(max(overlap, 0), max_size - 1)
    most = max_size - overlap
    parts, strength = _atoms(text, most, diff)
    offsets = [0]
    for p in parts:
        offsets.append(offsets[-1] + len(p))
    starts = [offsets[i] for i in merge_weakest([len(p) for p in parts], strength, most)]
    ends = [*starts[1:], len(text)]
    spans = []
    for k, (start, end) in enumerate(zip(starts, ends)):
        spans.append((overlap_start(text, starts[k - 1], start, overlap) if k else 0, start, end))
    return spans


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Items with more characters than their limit, once per (item_kind, item_id); of different texts the one with the least hash.

    ``items``: ``item_kind, item_id, limit_kind, text`` and what describes them;
    ``limits``: size_limits.  A kind that is null, not listed, or listed in
    another unit takes the limit ``default``; without that it has none.  Null
    texts are no items.
    """
    chars = limits.filter("unit = 'chars'").select(F.col("item_kind").alias("of"), "max_size", "overlap")
    # one row of a table of fixed size
    default = chars.filter("of = 'default'").first()
    listed = items.filter("text IS NOT NULL").join(F.broadcast(chars), F.col("limit_kind") == F.col("of"), "left").drop("of")
    limited = listed.withColumns({"max_size": F.coalesce("max_size", F.lit(default and default.max_size)), "overlap": F.coalesce("overlap", F.lit(default and default.overlap))})
    big = limited.filter(F.length("text") > F.col("max_size"))
    rest = [c for c in big.columns if c not in ("item_kind", "item_id")]
    once = big.groupBy("item_kind", "item_id").agg(F.min_by(F.struct(*rest), F.xxhash64("text")).alias("r"))
    return once.select("item_kind", "item_id", "r.*").select(*big.columns)


_SPAN = "item_kind string, item_id string, file_path string, chunk_type string, piece_no int, n_pieces int, overlap_chars int, n_chars int, start_line int, end_line int"


def cut_items(items: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """The pieces of all oversized items.

    Columns: ``item_kind, item_id, file_path, chunk_type, piece_no`` (from 0)
    ``, n_pieces, overlap_chars, n_chars, start_line, end_line`` and, unless
    ``with_text`` is false, ``text``.  Lines are counted from the item's
    ``start_line``, from 1 where that is null, and include the overlap.
    """
    big = oversized(items, limits).select("item_kind", "item_id", "file_path", "chunk_type", "first_line", "diff", "text", "max_size", "overlap")
    schema = _SPAN + (", text string" if with_text else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item in batch.to_pylist():
                text = item["text"]
                spans = split_spans(text, item["max_size"], item["overlap"], item["diff"])
                first = item["first_line"] if item["first_line"] is not None else 1
                at, line = 0, first
                for number, (overlap_at, start, end) in enumerate(spans):
                    line += text.count("\n", at, overlap_at) if overlap_at >= at else -text.count("\n", overlap_at, at)
                    at = overlap_at
                    last = line + text.count("\n", overlap_at, max(overlap_at, end - 1))
                    row = (item["item_kind"], item["item_id"], item["file_path"], item["chunk_type"], number, len(spans), start - overlap_at, end - overlap_at, line, last)
                    rows.append((*row, text[overlap_at:end]) if with_text else row)
            columns = list(zip(*rows)) if rows else [()] * len(names)
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), *[pa.int32()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return big.mapInArrow(run, schema)


def review_items(chunks: DataFrame, review_state: DataFrame) -> DataFrame:
    """Chunk contents and pull request diffs as items of one table."""
    of_chunks = chunks.select(
        F.lit("chunk").alias("item_kind"),
        F.col("id").alias("item_id"),
        F.coalesce("chunk_type", F.lit("default")).alias("limit_kind"),
        "file_path",
        "chunk_type",
        F.col("start_line").cast("int").alias("first_line"),
        F.lit(False).alias("diff"),
        F.col("content").alias("text"),
    )
    of_diffs = review_state.select(
        F.lit("pr_diff").alias("item_kind"),
        F.col("review_id").alias("item_id"),
        F.lit("pr_diff").alias("limit_kind"),
        F.lit(None).cast("string").alias("file_path"),
        F.lit(None).cast("string").alias("chunk_type"),
        F.lit(1).alias("first_line"),
        F.lit(True).alias("diff"),
        F.col("pr_diff").alias("text"),
    )
    return of_chunks.unionByName(of_diffs)
