"""Audit of how the sources of a language differ in vocabulary, in exact whole numbers.

Terms are runs of letters; each language keeps those that enough of its documents have. The kept terms, sorted by their bytes,
are compiled into minimal acyclic transducers: equal endings are shared, and an arc puts out how many accepted terms lie before
it, so the outputs of a path add up to the term's place in the sorted order, its ordinal. All texts then run through the
transducers, every term of a batch one sign at a time, and what they accept is counted by source and ordinal. From there on
only ordinals move; they also break ties, as they are the order of the terms.

Transducers are built in Spark from ``SHARD`` terms each. The driver takes them in bundles of ``BUNDLE`` bytes at most, one after
the other, and broadcasts a bundle for one pass over the texts: a vocabulary of any size takes more passes, never more memory.

Every source of a language is held against every other of it, over all kept terms, also those that neither has: terms are cut
into ranges of ordinals and sources into blocks, and a task sums a range for the pairs of two blocks. What comes out of a
range is one number for each pair, so that frequent terms and large sources weigh no more than others.

Defined results: null text, language and source are empty, which is a language or source like any other; rows that repeat an
id are documents of their own; a language without kept terms gives pairs of value 0 and no terms, one with a single source no
pairs; terms and texts may have any length; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import global_positions, named
from visitloom.sources.workspace import materialize

#: A term in UTF-8, A-Z in lower case: letters of ASCII and all signs beyond it, whose bytes are above 127.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Terms of a transducer; bytes of transducers in one broadcast; bytes of text that run at once.
SHARD, BUNDLE, CHUNK = 65_536, 32 << 20, 4 << 20
#: Terms of a range and sources of a block in the sums over pairs.
RANGE, BLOCK = 4096, 256
UNIT = 1_000_000_000
_ORDINAL_BITS = 40  # of a number that holds a group of a batch as well


# ---- Transducer


class Transducer:
    """Term to ordinal. States' arcs lie in one table of slots, shifted so that they don't meet: the arc of a state by a byte is
    at the state's base plus the byte, if the state owns that slot."""

    def __init__(self, compiled: bytes):
        self.root, states, slots = np.frombuffer(compiled, np.int32, 3).tolist()
        parts = np.frombuffer(compiled, np.int32, offset=12)
        ends = np.cumsum([0, states, states, slots, slots, slots])
        self.base, self.final, self.owner, self.target, self.output = (parts[a:b] for a, b in zip(ends, ends[1:]))

    def ordinals(self, signs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ordinal of each run of signs, or -1. All runs go through it together, a sign at a time."""
        found = np.full(len(starts), -1, np.int32)
        run, at = np.arange(len(starts)), starts
        state, total = np.full(len(run), self.root, np.int32), np.zeros(len(run), np.int32)
        while len(run):
            slot = self.base[state] + signs[at]
            go = np.flatnonzero(self.owner[slot] == state)
            run, at, slot = run[go], at[go] + 1, slot[go]
            state, total = self.target[slot], total[go] + self.output[slot]
            over = at == ends[run]
            accepted = over & (self.final[state] == 1)
            found[run[accepted]] = total[accepted]
            go = np.flatnonzero(~over)
            run, at, state, total = run[go], at[go], state[go], total[go]
        return found


def compile_terms(terms: list[bytes]) -> bytes:
    """The transducer of sorted, different terms. A state is finished, and shared with an equal one, once no later term can
    reach it."""
    finished: dict[tuple, int] = {}
    accepts: list[int] = []  # terms that a state accepts
    open_states: list[list] = [[0, []]]  # of the last term: final, arcs (byte, target)

    def finish(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in finished:
            finished[key] = len(accepts)
            accepts.append(state[0] + sum(accepts[target] for _, target in state[1]))
        return finished[key]

    def close(term: bytes, depth: int) -> None:
        while len(open_states) > depth + 1:
            state = open_states.pop()
            open_states[-1][1].append((term[len(open_states) - 1], finish(state)))

    last = b""
    for term in terms:
        shared = next((i for i, (x, y) in enumerate(zip(term, last)) if x != y), min(len(term), len(last)))
        close(last, shared)
        open_states += [[0, []] for _ in term[shared:]]
        open_states[-1][0] = 1
        last = term
    close(last, 0)
    root = finish(open_states[0])
    return _laid_out(root, list(finished), accepts)


def _laid_out(root: int, states: list[tuple], accepts: list[int]) -> bytes:
    base, taken, free, slot, size = [256] * len(states), bytearray(1024), 256, 256, 0
    for n in sorted(range(len(states)), key=lambda n: -len(states[n][1])):
        signs = [byte for byte, _ in states[n][1]]
        if not signs:
            continue
        while free < len(taken) and taken[free]:
            free += 1
        # States of as many arcs don't look again where the last of them found no room.
        slot, size = free if len(signs) != size or len(signs) == 1 else slot, len(signs)
        while True:
            if len(taken) < slot + 512:
                taken += bytes(len(taken))
            if not any(taken[slot + s - signs[0]] for s in signs):
                break
            slot += 1
        base[n] = slot - signs[0]
        for s in signs:
            taken[base[n] + s] = 1
    slots = max(base) + 256
    owner, target, output = np.full(slots, -1, np.int32), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
    for n, (final, arcs) in enumerate(states):
        before = final
        for byte, to in arcs:
            owner[base[n] + byte], target[base[n] + byte], output[base[n] + byte] = n, to, before
            before += accepts[to]
    header = np.array([root, len(states), slots], np.int32)
    parts = [header, np.array(base, np.int32), np.array([s[0] for s in states], np.int32), owner, target, output]
    return b"".join(p.tobytes() for p in parts)


_SIGNS = np.zeros(256, np.uint8)
_SIGNS[128:] = np.arange(128, 256)
_SIGNS[ord("a"): ord("z") + 1] = _SIGNS[ord("A"): ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def term_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie end to end in ``data``: their signs, and each term's start, end and text."""
    signs = _SIGNS[data]
    inside = np.concatenate(([False], signs > 0, [False]))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[offsets <= len(data)]] = True  # a term does not go on into the next text
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return signs, starts, ends, np.searchsorted(offsets, starts, "right") - 1


# ---- Vocabulary and counts


def _read(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    return docs.select(*[F.coalesce(named(c).cast("string"), F.lit("")).alias(n) for c, n in (
        (lang, "lang"), (source, "source"), (text, "text"))])


def kept_terms(rows: DataFrame, least_documents: int) -> DataFrame:
    """lang, term (bytes), ordinal and vocabulary (terms of the language), for terms in enough documents of the language."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                seen[lang].update(set(TERM.findall(text.as_py().encode().lower())))
            for lang, found in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found.keys(), pa.binary()),
                     pa.array(found.values(), pa.int64())], ["lang", "term", "n"])

    counts = rows.select("lang", "text").mapInArrow(counted, "lang string, term binary, n long")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_documents).select("lang", "term")
    placed = global_positions(kept, "lang", ["term"], "kept-terms")
    return materialize(placed.select("lang", "term", F.col("pos").alias("ordinal"), F.col("group_rows").alias("vocabulary")), "vocabulary")


def _transducers(kept: DataFrame) -> DataFrame:
    """lang, first (the ordinal of its first term) and compiled, of ``SHARD`` terms each."""
    def built(terms: pd.DataFrame) -> pd.DataFrame:
        terms = terms.sort_values("ordinal")
        return pd.DataFrame({"lang": [terms["lang"].iloc[0]], "first": [terms["ordinal"].iloc[0]],
                             "compiled": [compile_terms([bytes(t) for t in terms["term"]])]})

    shard = F.expr(f"ordinal div {SHARD}").alias("shard")
    return kept.select("lang", "term", "ordinal", shard).groupBy("lang", "shard").applyInPandas(
        built, "lang string, first long, compiled binary")


def _bundles(transducers: DataFrame) -> Iterator[list[tuple[str, int, bytes]]]:
    bundle, size = [], 0
    for row in transducers.toLocalIterator():
        if bundle and size + len(row.compiled) > BUNDLE:
            yield bundle
            bundle, size = [], 0
        bundle.append((row.lang, row.first, bytes(row.compiled)))
        size += len(row.compiled)
    if bundle:
        yield bundle


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Texts from, to: of ``CHUNK`` bytes at most, or a single one."""
    first = 0
    while first < len(offsets) - 1:
        last = max(int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1, first + 1)
        yield first, last
        first = last


def _recounted(rows: DataFrame, bundle: list[tuple[str, int, bytes]]) -> DataFrame:
    """lang, source, ordinal, n, from one pass of all texts through the transducers of the bundle."""
    shared = rows.sparkSession.sparkContext.broadcast(bundle)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, list] = defaultdict(list)
        for lang, first, compiled in shared.value:
            readers[lang].append((first, Transducer(compiled)))
        for b in batches:
            langs, sources = (b.column(i).dictionary_encode() for i in (0, 1))
            names = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
            both = langs.indices.to_numpy().astype(np.int64) * len(names[1]) + sources.indices.to_numpy()
            groups, group = np.unique(both, return_inverse=True)
            lang_of = groups // max(len(names[1]), 1)
            text = b.column(2).cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            keys, times = [], []
            for first, last in _chunks(offsets):
                found = _ordinals_of(readers, names[0], lang_of[group[first:last]],
                                     data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first])
                for text_of, ordinal in found:
                    key, n = np.unique(group[first:last][text_of].astype(np.int64) << _ORDINAL_BITS | ordinal, return_counts=True)
                    keys.append(key)
                    times.append(n)
            key, place = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_inverse=True)
            n = np.bincount(place, np.concatenate(times), len(key)) if len(key) else np.zeros(0)
            of = groups[key >> _ORDINAL_BITS]
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(of // max(len(names[1]), 1))), sources.dictionary.take(pa.array(of % max(len(names[1]), 1))),
                 pa.array(key & ((1 << _ORDINAL_BITS) - 1)), pa.array(n.astype(np.int64))], ["lang", "source", "ordinal", "n"])

    return rows.mapInArrow(counted, "lang string, source string, ordinal long, n long")


def _ordinals_of(readers: dict, langs: list[str], lang_of: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """(texts, ordinals) of all kept terms' occurrences, for each transducer of a language that occurs."""
    signs, starts, ends, text_of = term_runs(data, offsets)
    for code in np.unique(lang_of):
        mine = np.flatnonzero(lang_of[text_of] == code)
        for first, reader in readers.get(langs[code], ()):
            ordinal = reader.ordinals(signs, starts[mine], ends[mine])
            yield text_of[mine[ordinal >= 0]], first + ordinal[ordinal >= 0].astype(np.int64)


def recount(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, ordinal, n: how often each kept term occurs in each source that has it."""
    transducers = materialize(_transducers(kept), "transducers")
    parts = [materialize(_recounted(rows, bundle).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "recount")
             for bundle in _bundles(transducers)]
    counts = rows.sparkSession.createDataFrame([], "lang string, source string, ordinal long, n long") if not parts else parts[0]
    for part in parts[1:]:  # other ordinals than those before
        counts = counts.unionByName(part)
    return counts


# ---- Shares and divergence


def _share(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * vocabulary)), in decimals, which no count overflows."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return F.call_function("div", above, (total + 2 * vocabulary).cast("decimal(20,0)")) + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(count: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """As ``_share``, by long division in steps of a thousand: no product overflows below 9e15 occurrences."""
    whole = total + 2 * vocabulary
    quotient, rest = np.divmod(count + 2, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        quotient = quotient * 1000 + more
    return quotient + 1


def _pairs_in_tile(terms_of_range: int, block: int):
    """Sums over a range of terms for all pairs of a block of sources with another, or of one block among themselves."""
    def summed(key: tuple, counts: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        lang, _, left, right = key
        sources = sources.sort_values("place")
        place, total, vocabulary = sources["place"].to_numpy(), sources["total"].to_numpy(), int(sources["vocabulary"].iloc[0])
        first = int(sources["first"].iloc[0])
        table = np.zeros((len(place), max(min(terms_of_range, vocabulary - first), 0)), np.int64)
        table[np.searchsorted(place, counts["of_place"]), counts["ordinal"].to_numpy(np.int64) - first] = counts["n"]
        p = shares(table, total[:, None], vocabulary) if table.size else table
        out = []
        for a in np.flatnonzero(place // block == left):
            others = np.flatnonzero((place // block == right) & (place > place[a]))
            for some in np.array_split(others, max(1, len(others) // 32)):
                value = ((p[some] - p[a]) ** 2 // np.maximum(p[some] + p[a], 1)).sum(axis=1)
                out.append(np.stack([np.full(len(some), place[a]), place[some], value], axis=1))
        one, other, value = np.concatenate(out).T if out else np.zeros((3, 0), np.int64)
        return pd.DataFrame({"lang": pd.Series([lang] * len(one), dtype=object), "one": one, "other": other, "value": value})

    return summed


def _pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, one, other (places of sources, one below other), value. ``groups``: lang, source, place, sources, total, vocabulary."""
    # A block of sources meets each block of the language, itself included.
    blocks = f"(sources + {BLOCK - 1}) div {BLOCK}"
    met = F.explode(F.expr(f"sequence(0L, {blocks} - 1)"))
    mine = F.expr(f"place div {BLOCK}")
    tile = [F.least(mine, "met").alias("left"), F.greatest(mine, "met").alias("right")]
    ranges = F.explode(F.expr(f"sequence(0L, greatest(vocabulary + {RANGE - 1}, {RANGE}L) div {RANGE} - 1)"))
    sources = groups.withColumn("met", met).withColumn("range", ranges).select(
        "lang", "range", *tile, "place", "total", "vocabulary", (F.col("range") * RANGE).alias("first"))
    placed = counts.join(groups.select("lang", "source", "place", "sources"), ["lang", "source"]).withColumn("met", met).select(
        "lang", F.expr(f"ordinal div {RANGE}").alias("range"), *tile, F.col("place").alias("of_place"), "ordinal", "n")
    keys = ["lang", "range", "left", "right"]
    tiles = placed.groupBy(*keys).cogroup(sources.groupBy(*keys)).applyInPandas(
        _pairs_in_tile(RANGE, BLOCK), "lang string, one long, other long, value long")
    return tiles.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, least_documents: int = 10, terms_shown: int = 10, lang: str = "lang",
                  source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` for each other source of the language, part ``term`` for the
    ``terms_shown`` kept terms that the source has most above the language."""
    rows = _read(docs, lang, source, text)
    kept = kept_terms(rows, least_documents)
    counts = recount(rows, kept)
    totals = materialize(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), "totals")
    vocabularies = materialize(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary")), "vocabularies")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = global_positions(
        rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabularies, "lang", "left").select(
            "lang", "source", zero("total"), zero("vocabulary")), "lang", ["source"], "sources")
    groups = materialize(groups.withColumnsRenamed({"pos": "place", "group_rows": "sources"}), "places")

    values = materialize(_pair_values(counts, groups), "pairs")
    both = values.select("lang", F.explode(F.array(
        F.struct(F.col("one").alias("place"), F.col("other").alias("beside")),
        F.struct(F.col("other").alias("place"), F.col("one").alias("beside")))).alias("x"), "value").select("lang", "x.*", "value")
    name = groups.select("lang", "place", "source")
    pairs = both.join(name, ["lang", "place"]).join(
        name.withColumnsRenamed({"place": "beside", "source": "item"}), ["lang", "beside"]).select("lang", "source", "item", "value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    in_lang = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n_lang"))
    lang_totals = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"))
    q_of = in_lang.join(lang_totals, "lang").join(vocabularies, "lang").select(
        "lang", "ordinal", _share(F.col("n_lang"), F.col("total_lang"), F.col("vocabulary")).alias("q"))
    p_of = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "ordinal", _share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"))
    above = p_of.join(q_of, ["lang", "ordinal"]).where("p > q").select(
        "lang", "source", "ordinal", _divergence(F.col("p"), F.col("q")).alias("value"))
    # Ordinals are the order of the terms.
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    shown = above.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= terms_shown)
    terms = shown.join(kept, ["lang", "ordinal"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    return pairs.unionByName(terms)
