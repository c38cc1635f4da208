"""Text quality statistics, exact per-language ranks and outlier scores.

All statistics of a document come from one pass over its text, whose words are
found once.  Their ranks come from range-partitioned sorting: counts per
(language, statistic, value) are sorted over the cluster, running counts inside
each range partition are shifted by the totals of the partitions before it, and
give the exact empirical tail probability of every value.  The tails of
all statistics are combined into one outlier score, which decides: a text is no
prose when its combined tail is as improbable as a value that no prose of its
language reaches.  The score is the larger of two.  One takes every statistic:
the largest of the sums of negative logarithms of the left tails, of the right
tails and of those on the side to which the statistic is skewed is ranked in the
same way, because the statistics depend on one another, and gives the negative
logarithm of its own right tail.  The other takes the statistics that tell prose
from the rest, each on the side that speaks against prose.

The reference of the ranks are the texts of the language whose layout is that of
prose, so that junk cannot hide behind its own copies, however many.

Equal values are counted before anything is shuffled, so a value that a third of
all documents share is one row.  Values that frequent are joined back by
broadcast: at most ``HEAVY`` rows per statistic can hold 1/``HEAVY`` of the
documents.  All other values join by shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.plans.lineage import cut

#: Bound of the broadcast side: values held by more than 1/HEAVY of all rows.
HEAVY = 1000

#: Marks without width, and spaces of other widths.
_INVISIBLE = re.compile("[\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad]")
_SPACES = re.compile("[\u00a0\u2000-\u200a\u202f\u3000]")
#: A character of a script without spaces is a word of its own.
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]|[^\W_\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]+(?:['’][^\W_]+)*")
_SPACED_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-’“”«»„…¿¡、。，！？：；「」（）]|_")
_STOPS, _CLOSING = tuple(".!?…。！？"), "'\")»”’]"
_MARKED = re.compile(r"\s*(?:[-*•+–‣|]\s|\d+[.)]\s|\(\w\)\s|\|)")

#: The statistics of a text.
STATISTICS = ["mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share", "distinct_word_share", "marked_line_share", "prose_share", "repeated_share", "function_share"]

#: The statistics of which one side speaks against prose: whether small or large values do.
DECIDING = {"prose_share": "left", "repeated_share": "right", "function_share": "right"}


def normalized_language(lang: Column) -> Column:
    """Lower case; null, blank and ``und`` are one group ``und``."""
    text = F.lower(F.trim(lang))
    return F.when(text.isNull() | (text == ""), F.lit("und")).otherwise(text)


def statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id, language, word_count`` and ``STATISTICS`` of each document.

    A null text has nulls; an empty or blank text has word_count 0 and nulls for
    everything that would divide by 0.  A language without common words has a
    null common_word_share.  Shares are of words, lines or characters.
    """
    lists: dict[str, set[str]] = {}
    # a table of fixed size
    for row in common_words.select(F.lower("lang").alias("lang"), F.lower("word").alias("word")).distinct().collect():
        lists.setdefault(row.lang, set()).add(row.word)
    common = {k: frozenset(v) for k, v in sorted(lists.items())}
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, language string, word_count int, " + ", ".join(f"{c} double" for c in STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), *[pa.float64()] * len(STATISTICS)]
        for batch in batches:
            texts, languages = batch.column("text").to_pylist(), batch.column("language").to_pylist()
            rows = [measure(t, lang, common) for t, lang in zip(texts, languages)]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("language"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "language", "word_count", *STATISTICS],
            )

    return documents.select("doc_id", normalized_language(F.col("lang")).alias("language"), "text").mapInArrow(run, schema)


def measure(text: str | None, language: str, common: dict[str, frozenset[str]]) -> tuple:
    """word_count and ``STATISTICS`` of one text."""
    if text is None:
        return (None,) * (1 + len(STATISTICS))
    text = _SPACES.sub(" ", _INVISIBLE.sub("", unicodedata.normalize("NFC", text)).replace("\r\n", "\n").replace("\r", "\n"))
    lower = text.lower()
    wide = bool(_CJK.search(text))
    words = (_WORD if wide else _SPACED_WORD).findall(lower)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    counted = Counter(words)
    n, m = len(words), len(lines)
    own = common.get(language)
    return (
        n,
        sum(map(len, words)) / n if n else None,
        len(_SYMBOL.findall(text)) / len(text) if text else None,
        sum(x.rstrip().rstrip(_CLOSING).endswith(_STOPS) for x in lines) / m if m else None,
        sum(counted[w] for w in own & counted.keys()) / n if own and n else None,
        len(counted) / n if n else None,
        sum(_MARKED.match(x) is not None for x in lines) / m if m else None,
        *layout(text, list(common.values()), lower, None if wide else words, None if wide else counted),
    )


_ITEM = re.compile(r"\s*(?:[-*•+–‣·]\s+|\d{1,3}[.)]\s+|\([A-Za-z0-9]{1,3}\)\s+|[A-Za-z][.)]\s+|\[[ xX]\]\s+|@[\w-]+\s*$)")
_BORDER = re.compile(r"\+[-=+]+\+?$")
_CELLS = re.compile(r".*\S\s\|\s.*\S\s\|\s")
_TAG = re.compile(r"</?(?:t[rdh]|table|tbody|thead|li|ul|ol|div|dl|d[td])\b", re.I)
_CJK = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]")
_CJK_STOP = re.compile(r"[。！？]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])\s*|\n+")
_RULE = re.compile(r"[-=*_#~\s.]+")
_FIELD = re.compile(r"#{1,6}(?!!)|\*\*|<!--|__")
_UNFILLED = re.compile(r"(?:n/?a|tbd|todo|none|-|_+|\.{3}|…|\[ \])", re.I)
_QUOTE = re.compile(r"^(?:\s*>)+\s?")
_CALL = re.compile(r"[{}();=<>\[\]]")


def _cells(line: str) -> bool:
    """Whether a line, without white space at its ends, is a row of a table."""
    first = line[0]
    return (
        first == "|"
        or line.count(";") == 2
        or line.count("\t") > 1
        or (first == "+" and bool(_BORDER.fullmatch(line)))
        or (first == "<" and bool(_TAG.match(line)))
        or (line.count("|") > 1 and bool(_CELLS.match(line + " ")))
    )


def _common(counted: Counter[str], common: list[frozenset[str]]) -> int:
    """How many words are common ones of the language that has most of them."""
    held = counted.keys()
    return max((sum(counted[w] for w in words & held) for words in common), default=0)


def _running(text: str, words: list[str], wide: int, common: list[frozenset[str]]) -> bool:
    """Whether lines that follow one another are sentences of a language whose common words are known, or of a script without spaces."""
    if wide * 2 > sum(map(len, words)):
        return bool(_CJK_STOP.search(text))
    if not words:
        return False
    found = _common(Counter(words), common)
    # a block that ends as a sentence does needs fewer common words
    least = 0.15 if len(words) >= 6 and text.rstrip().rstrip(_CLOSING).endswith(_STOPS) else 0.22
    return found >= least * len(words) and len(_CALL.findall(text)) * 12 < len(text)


def layout(text: str, common: list[frozenset[str]], lower: str | None = None, tokens: list[str] | None = None, counted: Counter[str] | None = None) -> tuple[float | None, float | None, float | None]:
    """Shares of characters in running sentences and in the most repeated sentence or word; share of common words in text without punctuation.

    Short lines that mark structure (headings, greetings, rules) count for
    neither side; items, table rows and fenced code count against prose.  Nothing
    to count gives (0, 0, 0); a text of white space only gives nulls.  What the
    caller has found already (text in lower case, its words, their counts) is
    taken as it is.
    """
    if not text or text.isspace():
        return None, None, None
    lower = text.lower() if lower is None else lower
    tokens = _SPACED_WORD.findall(lower) if tokens is None else tokens
    counted = Counter(tokens) if counted is None else counted
    prose = other = 0
    block: list[str] = []
    fenced = False

    def close() -> None:
        nonlocal prose, other, block
        if block:
            size = sum(map(len, block))
            together = " ".join(block)
            words = _SPACED_WORD.findall(together.lower())
            wide = 0 if together.isascii() else len(_CJK.findall(together))
            if _running(together, words, wide, common):
                prose += size + wide  # a character of these scripts says as much as two letters
            elif len(words) > 3 or wide > 6 or size > 40:
                other += size
            block = []

    for raw in text.split("\n"):
        line = raw.strip()
        if line[:1] == ">":
            line = _QUOTE.sub("", raw).strip()
        if not line:
            close()
            continue
        first = line[0]
        if line.startswith(("```", "~~~")):
            close()
            fenced = not fenced
        elif fenced:
            other += len(line)
        elif (len(line) < 5 or first == "_") and _UNFILLED.fullmatch(line):
            close()
            other += max(len(line), 10)
        elif first in "#*<_" and _FIELD.match(line):
            close()
        elif _cells(line) or _ITEM.match(raw):
            close()
            other += len(line)
        elif first in "-=*_#~." and _RULE.fullmatch(line):
            close()
            other += len(line) if len(line) <= 3 else 0
        else:
            block.append(line)
    close()
    sentences = [x for s in _SENTENCE.split(lower) if (x := s.strip())]
    whole = sum(map(len, sentences))
    most = max((n * len(s) for s, n in Counter(sentences).items() if n > 2), default=0)
    if len(tokens) >= 8:
        times = max(counted.values())
        most = max(most, whole * times / len(tokens) if times > 0.3 * len(tokens) else 0)
        # three words over and over need a word that often
        if times * 6 > len(tokens) and times > 2:
            top = max(Counter(zip(tokens, tokens[1:], tokens[2:])).values())
            if top * 3 > 0.5 * len(tokens) and top > 2:
                most = max(most, whole * min(1.0, top * 3 / len(tokens)))
    unpunctuated = len(tokens) >= 8 and not re.search(r"[.,;:!?。、，]", text)
    share = _common(counted, common) / len(tokens) if unpunctuated else 0.0
    return (prose / (prose + other) if prose + other else 0.0), (most / whole if whole else 0.0), share


def _ranked(stats: DataFrame) -> list[str]:
    """All statistics; of a frame without some of them those of which one side speaks against prose."""
    return STATISTICS if set(STATISTICS) <= set(stats.columns) else list(DECIDING)


def _long(stats: DataFrame) -> DataFrame:
    """One row per document and statistic that is not null; none for a text without content."""
    pairs = F.array(*[F.struct(F.lit(STATISTICS.index(c)).alias("stat"), F.col(c).alias("value")) for c in _ranked(stats)])
    weight = F.when(F.coalesce(~unlike_prose(), F.lit(False)), 1).otherwise(0).alias("weight")
    some = stats.filter(F.coalesce(*DECIDING).isNotNull())
    return some.select("doc_id", "language", weight, F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p")).select("doc_id", "language", "weight", "p.stat", "p.value")


def unlike_prose() -> Column:
    """Whether a text's layout speaks against prose: less than half of it in running sentences, mostly one sentence or word, or common words without punctuation."""
    return (F.col("prose_share") < 0.5) | (F.col("repeated_share") > 0.5) | (F.col("function_share") >= 0.64)


def tail_probabilities(measured: DataFrame) -> DataFrame:
    """``language, stat, value, n_value, n_left, n_right, n, skewed_left`` for every value that occurs.

    ``measured``: rows of ``language, stat, value`` and, optionally, ``weight``: 1
    for a row of the reference, 0 for one that is only compared with it; without
    it every row is in the reference.  n_left rows of the language's reference,
    which has n, are up to this value, n_right have this one or a larger one;
    equal values have equal ranks.  n_value counts all rows.  skewed_left: the
    reference's third central moment is negative, beyond what rounding gives.
    """
    weight = F.sum("weight") if "weight" in measured.columns else F.count(F.lit(1))
    counts = measured.groupBy("language", "stat", "value").agg(F.count(F.lit(1)).alias("n_value"), weight.cast("bigint").alias("n_held"))
    by = ["language", "stat", "value"]
    # the partition of a row is part of the result, so it is written down once
    ranged = cut(counts.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()))
    group = ["language", "stat"]
    inside = Window.partitionBy("part", *group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("running", F.sum("n_held").over(inside))
    powers = [F.sum(F.col("n_held") * F.col("value") ** i).alias(f"s{i}") for i in (1, 2, 3)]
    totals = ranged.groupBy("part", *group).agg(F.sum("n_held").alias("n_part"), *powers)
    # at most one row per partition and group
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    n = F.sum("n_part").over(whole)
    one, two, three = (F.sum(f"s{i}").over(whole) / F.nullif(n, F.lit(0).cast("bigint")) for i in (1, 2, 3))
    skewed = F.coalesce(three - 3 * one * two + 2 * one**3 < -1e-9 * F.abs(three), F.lit(False))
    offsets = totals.select("part", *group, F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("offset"), n.alias("n"), skewed.alias("skewed_left"))
    upto = F.col("offset") + F.col("running")
    return local.join(offsets, ["part", *group]).select(*by, "n_value", upto.alias("n_left"), (F.col("n") - upto + F.col("n_held")).alias("n_right"), "n", "skewed_left")


def _with_ranks(measured: DataFrame, kinds: int) -> DataFrame:
    """Rows of ``measured``, which have ``kinds`` statistics, with the ``tail_probabilities`` of their value."""
    tails = cut(tail_probabilities(measured.select("language", "stat", "value", "weight")))
    rows = tails.agg(F.sum("n_value")).first()[0] or 0
    heavy = F.col("n_value") * (HEAVY * kinds) >= rows
    keys = ["language", "stat", "value"]
    often = tails.filter(heavy)
    common_values = F.broadcast(often)
    seldom = tails.filter(~heavy)
    direct = measured.join(common_values, keys)
    other = measured.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(seldom, keys)
    return direct.unionByName(other)


def outlier_scores(stats: DataFrame) -> DataFrame:
    """``doc_id, outlier_score, reference_rows`` for the documents of ``statistics``.

    The tails of a value are the shares of the reference, and the value itself,
    that are up to it and that are as large or larger; the score is made from
    their negative logarithms as the module describes.  reference_rows counts the
    texts of the language like prose.  Statistics that are null add nothing; a
    text without content has no row; without a reference every score is 0.  Of
    rows that share a doc_id the value farthest out counts.  ``stats`` that lack
    some of ``STATISTICS`` have only the sum of ``DECIDING``.
    """
    names = _ranked(stats)
    ranked = _with_ranks(_long(stats), len(names))
    far = lambda n: F.greatest(-F.log(F.least((F.col(n) + 1) / (F.col("n") + 1), F.lit(1.0))), F.lit(0.0))
    found = ranked.select("doc_id", "language", "weight", "stat", "n", "skewed_left", far("n_left").alias("left"), far("n_right").alias("right"))
    found = found.withColumn("skewed", F.when(F.col("skewed_left"), F.col("left")).otherwise(F.col("right")))
    at = lambda c: F.col("stat") == STATISTICS.index(c)
    each = [F.max(F.when(at(c), F.col(side))).alias(f"{side}_{c}") for c in names for side in ("left", "right", "skewed")]
    # a row of the table counts once, in a statistic that no text with content lacks
    weight = F.sum(F.when(at("prose_share"), F.col("weight")).otherwise(0)).alias("weight")
    by_document = found.groupBy("doc_id").agg(F.max("language").alias("language"), weight, F.max("n").alias("reference_rows"), *each)
    total = lambda columns: sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    against = total(f"{side}_{c}" for c, side in DECIDING.items()).alias("against")
    if names != STATISTICS:
        return by_document.select("doc_id", against.alias("outlier_score"), "reference_rows")
    sums = [total(f"{side}_{c}" for c in names) for side in ("left", "right", "skewed")]
    # the sum is compared with itself, so it is written down once
    summed = cut(by_document.select("doc_id", "language", "weight", "reference_rows", against, F.lit(len(STATISTICS)).alias("stat"), F.greatest(*sums).alias("value")))
    return _with_ranks(summed, 1).select("doc_id", F.greatest("against", far("n_right")).alias("outlier_score"), "reference_rows")


def judged(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``statistics`` with ``outlier_score`` and ``is_prose`` (null for texts without content).

    Not prose: a combined tail that is at most 1 in (reference + 1), which is
    what one value beyond all of the reference gives, or several values that are
    rare together.  In a language without any text like prose none is prose.
    """
    stats = cut(statistics(documents, common_words))
    scored = stats.join(outlier_scores(stats), "doc_id", "left")
    outlier = F.col("outlier_score") >= F.log(F.col("reference_rows") + 1) - 1e-9
    return scored.withColumn("is_prose", F.when(F.col("prose_share").isNotNull(), ~outlier)).drop("reference_rows")
