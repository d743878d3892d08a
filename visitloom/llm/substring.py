"""Substring deduplication over sliding sentence spans.

Every run of at least two consecutive sentences and ``MIN_WORDS`` words that occurs again anywhere goes, but for its first
place: the document with the smallest id keeps it, and the first place within a document. Not every run has to be hashed for
that. From each sentence on, the shortest such run is a span, and so is, up to each sentence, the shortest that ends there; its
normalised words (lower case, single spaces) are hashed to 128 bits and spans meet by hash over all documents. Each sentence of a
longer repeated run lies in a span that begins with it or, near the end, in the one that ends with the run, and both lie within the
run, so the spans cover just the sentences that all runs together cover.

Hashes are counted with partial aggregates (smallest and largest owners), so a passage that a third of all documents share is
one row per task; the join back is an equi-join that adaptive execution splits. Only ids, hashes and places move, and each
text once, for the removal.

Defined results: null text stays null and has no sentences; texts with fewer than two sentences or ``MIN_WORDS`` words have no
span; of rows that share an id, null among them, different texts are owners of their own, in the order of a hash of the text, and
come last if the id is null; equal rows are one owner and lose the same sentences; texts may have any length; an empty table
gives no rows; extra columns stay as they are, and where they clash with a column of the result, that one takes an underscore.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import fresh_name, named, whole_text
from visitloom.sources.workspace import materialize

MIN_WORDS = 16
#: A sentence with its end signs and the white space after them; sentences cover the whole text.
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+")
_LAST = (1 << 63) - 1


def spans(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, normalised words) of each span, in code points, in the order of their first sentences."""
    places, words = [], []
    for m in SENTENCE.finditer(text):
        if any(c.isalnum() for c in m[0]):
            places.append(m.span())
            words.append(m[0].lower().split())
    sizes = list(map(len, words))
    runs, last, size = [], 0, 0  # the run is [first, last)
    for first in range(len(places)):
        while last < len(places) and (size < min_words or last < first + 2):
            size += sizes[last]
            last += 1
        if size < min_words or last < first + 2:
            break
        runs.append((first, last))
        size -= sizes[first]
    begun, first, size = set(runs), 0, 0
    for last in range(1, len(places) + 1):
        size += sizes[last - 1]
        while last - first > 2 and size - sizes[first] >= min_words:
            size -= sizes[first]
            first += 1
        if last - first >= 2 and size >= min_words and (first, last) not in begun:
            runs.append((first, last))
    for first, last in sorted(runs):
        yield places[first][0], places[last - 1][1], " ".join([w for s in words[first:last] for w in s]).encode()


def _occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """doc, text_key, high, low, place (start and stop in one number), again: each span; ``again`` marks those the document had
    before."""
    names = ["doc", "text_key", "high", "low", "place", "again"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, hashes, places, again = [], [], [], []
            for n, text in enumerate(b.column(2)):
                met = set()
                for start, stop, words in spans(text.as_py(), min_words):
                    key = xxhash.xxh3_128_digest(words)
                    rows.append(n)
                    hashes.append(key)
                    places.append((start, stop))
                    again.append(key in met)
                    met.add(key)
            rows, hashed = np.array(rows, np.int64), np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            place = np.array(places, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.column(0).to_numpy()[rows]), pa.array(b.column(1).to_numpy()[rows]), pa.array(hashed[:, 0]),
                 pa.array(hashed[:, 1]), pa.array(place[:, 0] << 32 | place[:, 1]), pa.array(again, pa.bool_())], names)

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
                       F.xxhash64(whole_text(docs)).alias("text_key"), whole_text(docs).alias("text")).mapInArrow(
        found, "doc long, text_key long, high long, low long, place long, again boolean")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, text_key and the list of spans (start, stop) that are not the first of their kind, for documents that have any."""
    occurrences = materialize(_occurrences(docs, min_words), "spans")
    once = occurrences.where(~F.col("again")).drop("again")
    # Owners are documents, and different texts under one id.
    shared = once.groupBy("high", "low").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.min("text_key").alias("least"), F.max("text_key").alias("most"),
    ).where("first < last OR least < most")
    met = materialize(once.join(shared.select("high", "low", "first", "last"), ["high", "low"]), "shared-spans")
    later = met.where("doc > first")
    firsts = met.where("doc = first")
    tied = firsts.groupBy("high", "low").agg(F.min("text_key").alias("least"), F.max("text_key").alias("most")).where("least < most")
    other = firsts.join(tied.select("high", "low", "least"), ["high", "low"]).where("text_key > least")
    gone = [df.select("doc", "text_key", "place") for df in (later, other, occurrences.where("again"))]
    # A list is one document's own spans, fewer than twice its sentences.
    return gone[0].union(gone[1]).union(gone[2]).groupBy("doc", "text_key").agg(F.array_sort(F.transform(
        F.collect_set("place"), lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("start"),
                                                   x.bitwiseAND(0xFFFFFFFF).cast("int").alias("stop")))).alias("spans"))


def cut(text: str, found) -> tuple[str, int, int, str]:
    """The text without the spans, its sentences, how many of them went, and the merged spans as ``start:end``."""
    merged: list[list[int]] = []
    for start, stop in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    kept, at = [], 0
    for start, stop in merged:
        kept.append(text[at:start])
        at = stop
    starts = [m.start() for m in SENTENCE.finditer(text)]
    gone = sum(int(np.searchsorted(starts, stop) - np.searchsorted(starts, start)) for start, stop in merged)
    return "".join(kept) + text[at:], len(starts), gone, ",".join(f"{a}:{b}" for a, b in merged)


def deduplicate_substrings(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` cut, and the columns n_sentences, n_removed and removed_spans (places in the original text)."""
    found = repeated_spans(docs, min_words)
    names = {n: fresh_name(docs, n) for n in ("doc", "text_key", "spans", "cut_text", "n_sentences", "n_removed", "removed_spans")}
    keyed = docs.withColumn(names["doc"], F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(
        names["text_key"], F.xxhash64(whole_text(docs)))
    joined = keyed.join(
        found.select(F.col("doc").alias(names["doc"]), F.col("text_key").alias(names["text_key"]),
                     F.col("spans").alias(names["spans"])), [names["doc"], names["text_key"]], "left")

    @F.pandas_udf("text string, n_sentences long, n_removed long, removed_spans string")
    def cleaned(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
        out = [(None, 0, 0, "") if t is None else cut(t, zip(a if a is not None else (), b if b is not None else ()))
               for t, a, b in zip(texts, starts, stops)]
        return pd.DataFrame(out, columns=["text", "n_sentences", "n_removed", "removed_spans"])

    spans_of = F.col(names["spans"])
    out = joined.withColumn(names["cut_text"], cleaned(F.col("text").cast("string"), spans_of["start"], spans_of["stop"]))
    kept = [F.col(names["cut_text"])["text"].alias("text") if c == "text" else named(c) for c in docs.columns]
    return out.select(*kept, *[F.col(names["cut_text"])[c].alias(names[c]) for c in ("n_sentences", "n_removed", "removed_spans")])
