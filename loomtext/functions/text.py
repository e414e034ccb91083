"""Text functions as column expressions, evaluated in the JVM."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the tokenizers, the sentence boundary and capitalised names.
WORDS = "[A-Za-z]+"
ALNUM = "[A-Za-z0-9]+"
DASHED = r"[A-Za-z][A-Za-z\-']+"
TERMS = r"\b[A-Za-z][A-Za-z\-']+\b"
SENTENCE_END = "(?<=[.!?])\\s+(?=[A-Z0-9\"“])"
CAPITALISED = r"\b([A-Z][a-zA-Z'\-]+(?:\s+[A-Z][a-zA-Z'\-]+){0,3})\b"
#: First words that make a capitalised span no name.
NOT_NAMES = ("The", "A", "An", "On", "In", "Of", "At", "And", "To")
#: Characters cut at both ends of a mention, and words dropped once in front.
JUNK = "\"'`(){}[]<>,.;:!?@#$%^&*+=|/\\~ \t\r\n"
FILLERS = ("the ", "a ", "an ", "mr. ", "mrs. ", "ms. ", "dr. ", "prof. ", "sir ", "lady ")
MAX_CHARS = 1_000_000


def whole(text: Column) -> Column:
    """Text with null read as empty."""
    return F.coalesce(text, F.lit(""))


def capped(text: Column, chars: int = MAX_CHARS) -> Column:
    return F.substring(whole(text), 1, chars)


def ascii_only(text: Column) -> Column:
    """Every other character as a blank, so that word boundaries agree between regex engines and offsets stay."""
    return F.regexp_replace(whole(text), r"[^\x00-\x7F]", " ")


def tokens(text: Column, pattern: str = WORDS) -> Column:
    """Lower-cased matches of the pattern, in order."""
    return F.transform(F.regexp_extract_all(whole(text), F.lit(pattern), 0), F.lower)


def sentences(text: Column) -> Column:
    """Trimmed sentences; empty ones stay, for the caps count them."""
    return F.transform(F.split(whole(text), SENTENCE_END), lambda s: F.btrim(s, F.lit(" \t\r\n\x0b\x0c")))


def sentence_tokens(text: Column, max_sentences: int = 40, max_tokens: int = 64) -> Column:
    """Tokens per sentence: the cap on sentences counts empty ones, the cap on tokens comes before empties are dropped."""
    kept = F.slice(F.filter(sentences(capped(text)), lambda s: s != ""), 1, max_sentences)
    return F.filter(F.transform(kept, lambda s: F.slice(tokens(s, DASHED), 1, max_tokens)), lambda t: F.size(t) > 0)


def joined(nested: Column) -> Column:
    return F.concat_ws(" ", F.flatten(nested))


def collapsed(text: Column) -> Column:
    """Runs of blanks as one, ends cut."""
    return F.trim(F.regexp_replace(whole(text), r"\s+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once, however often the body uses it, also inside further lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(words: Column, k: int = 5) -> Column:
    """Distinct runs of k tokens; all tokens as one run where there are fewer; none without tokens."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(n > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


def clean_mention(text: Column) -> Column:
    """Junk cut at both ends, then one leading filler dropped, the first of the list that fits."""
    cut = F.btrim(F.trim(whole(text)), F.lit(JUNK))
    return F.regexp_replace(cut, "(?i)^(?:" + "|".join(f.replace(".", r"\.") for f in FILLERS) + ")", "")


def is_noise(mention: Column) -> Column:
    """Fewer than two characters or digits only."""
    return (F.length(mention) < 2) | mention.rlike("^[0-9]+$")


def capitalised_names(text: Column) -> Column:
    """Capitalised spans of up to four words whose first word is no stop word."""
    spans = F.regexp_extract_all(ascii_only(text), F.lit(CAPITALISED), 1)
    return F.filter(spans, lambda s: ~F.regexp_extract(s, r"^\S+", 0).isin(*NOT_NAMES))


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import re

    span, other, stop = re.compile(CAPITALISED, re.ASCII), re.compile(r"[^\x00-\x7F]"), set(NOT_NAMES)
    for b in batches:
        rows = []
        for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
            found = [m for m in span.finditer(other.sub(" ", text or "")) if m[0].split()[0] not in stop]
            rows += [(i, k, m[0], "MISC", m.start(), m.end()) for k, m in enumerate(found)]
        cols = list(zip(*rows)) if rows else [[]] * 6
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "pos", "text", "label", "start", "end"])


def name_mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, text, label, start, end): capitalised names with character offsets, end exclusive."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_offsets, "id bigint, pos int, text string, label string, start int, end int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, tokens, n = [], [], []
        for i, t in zip(b.column("id").to_pylist(), b.column("tokens").to_pylist()):
            found = Counter(t or ())
            ids += [i] * len(found)
            tokens += found.keys()
            n += found.values()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.string()), pa.array(n, pa.int64())], ["id", "token", "n"])


def term_counts(rows: DataFrame) -> DataFrame:
    """(id, token, n): how often each token is in each row of (id, tokens), counted inside the row."""
    return rows.select("id", "tokens").mapInArrow(_counted, "id bigint, token string, n bigint")


def label_flag(value: Column, positive: str | int) -> Column:
    """1 where the label is the positive one: strings trimmed and upper-cased, numbers as whole numbers; null stays null."""
    if isinstance(positive, str):
        return F.when(value.isNotNull(), F.when(F.upper(F.trim(value)) == positive.strip().upper(), 1).otherwise(0))
    return F.when(value.isNotNull(), F.when(value.try_cast("int") == int(positive), 1).otherwise(0))


def text_bar(value: Column, most: Column, width: int = 30) -> Column:
    return F.repeat(F.lit("█"), F.round(F.lit(width) * value / F.greatest(most, F.lit(1))).cast("int"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def digest12(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 12)
