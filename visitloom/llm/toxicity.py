"""Toxicity by a support vector machine over a gap-weighted subsequence kernel, with Nyström landmarks.

Two strings are alike by the letter triples they share in order, gaps allowed: a triple that spans ``s`` more places than
its three letters counts ``DECAY ** s``, up to ``REACH``. Signs between letters are gaps, digits and signs that stand for
letters are those letters, so inserted and exchanged characters weaken a match but don't end it. Landmarks are words of
labelled sentences; with them the kernel becomes a vector of finite length (Nyström), on which a linear machine with squared
hinge is trained. Its decision is linear in the triples, so it folds into one table of 32 ** 3 weights.

Sentences are strings of words to a second machine of the same kind: its kernel counts the pairs and triples of words that
two sentences share in order within four words, each counting ``DECAY`` for a word left out. Words are compared by
their letters, so signs within and exchanged characters do not hide them. Its landmarks are phrases that labelled toxic
sentences have among too many different neighbours for chance, it is trained on windows of ``WINDOW`` words of all labelled
sentences, and its decision folds into a table of word tuples.

A sentence scores as its highest word or its highest window of words, a document as its highest sentence. Words of toxic sentences that clean sentences
hardly have are the positive examples, if they are among the commonest such words or have too many contexts for chance, however
common another one is; what the machine then finds in toxic sentences joins them for the next round, as do
the clean words nearest to them on the other side, as landmarks too. Last, a logistic curve turns margins into scores. It is
found on a quarter of the sampled documents, from margins of machines that have not seen that quarter.

Only a bounded sample of labelled rows is learned from: ``DOCUMENTS`` documents of each label, and of these ``SENTENCES``
sentences of each label, the smallest by hash. Rows held out (CRC-32 of the id modulo 5 is 0) are never used.
Scoring reads whole texts of all rows, in one pass without a shuffle.

Defined results: null and empty texts, and texts without words, get the score of the lowest margin; very long texts are read
whole, word by word; rows that repeat an id are scored each on its own, equal texts alike; a null id counts as held out;
without labels of both kinds every score is 0; an empty table gives no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import fresh_name, whole_text
from visitloom.sources.workspace import materialize

SENTENCES, DOCUMENTS, SENTENCE_CHARS = 30_000, 4_000, 2_000
FOLDS = 5
DECAY, REACH = 0.6, 3
LANDMARKS = 256
#: Letters 1 to 26, other letters after them, 31 the edge of a word; 0 is a gap.
SIGNS, EDGE = 32, 31
#: Signs written for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"}
OFFSETS = [(a, b) for a in range(1, REACH + 2) for b in range(1, REACH + 3 - a)]
#: Longer words are scored in windows of this length, half of it apart.
LONG = 32
#: Chance that any word is taken for a positive example that is none, if contexts are independent.
CHANCE = 0.01
#: Margin of a text without words.
LOWEST = -8.0
PORTION, KEEP = 1_000_000, 400_000
#: Words whose margins are found at a time; cells of a dense table of training that are made at a time.
MANY, CELLS = 20_000, 1_000_000
#: The tuples that begin at so many words are a window; places of the words of a tuple after its first.
WINDOW = 12
PAIRS, TRIPLES = ((1,), (2,), (3,)), ((1, 2), (1, 3), (2, 3))
#: Phrases taken as landmarks of the sentence machine.
PHRASES = 128
#: Of the documents that may be learned from, one in so many is held back for the curve.
BACK = 4
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]{1,2}[^\W_]){2,}(?![^\W_])")
_ENDS = re.compile(r"^(?:(?![$@])[\W_])+|[\W_]+$")
_SENTENCE = re.compile(r"[^.!?\n]+")


def _table() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        sign = STAND_INS.get(chr(code), chr(code))
        base = unicodedata.normalize("NFKD", sign)[0].lower() if not 0xD800 <= code < 0xE000 else " "
        if "a" <= base <= "z":
            table[code] = ord(base) - 96
        elif base.isalpha():
            table[code] = 27 + code % 4
    table[ord("\n")] = EDGE
    return table


_CODES = _table()


def _triples(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of gaps: which word, which triple, and its weight. No word holds white space."""
    points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32)
    codes = _CODES[np.where(points < len(_CODES), points, 0)].astype(np.int32)
    codes[points >= len(_CODES)] = 27
    edges = np.cumsum(points == 10, dtype=np.int32)
    for a, b in OFFSETS:
        span = a + b
        first, middle, last = codes[:-span], codes[a:len(codes) - b], codes[span:]
        good = (first > 0) & (middle > 0) & (last > 0) & (edges[:-span] == edges[span - 1: -1])
        yield edges[:-span][good] - 1, ((first * SIGNS + middle) * SIGNS + last)[good], DECAY ** (span - 2)


def word_margins(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Normalised kernel against the machine, for each word."""
    value, norm = np.zeros(len(words)), np.zeros(len(words))
    for owner, triple, weight in _triples(words):
        value += weight * np.bincount(owner, weights[triple], len(words))
        norm += weight ** 2 * np.bincount(owner, minlength=len(words))
    return value / np.sqrt(np.maximum(norm, 1e-9))


def features(words: list[str], column: np.ndarray, columns: int) -> np.ndarray:
    """The normalised triples of each word, dense, for the triples that have a column (others -1); some words at a time."""
    whole = np.empty((len(words), columns), np.float32)
    for i in range(0, len(words), 25):
        some = words[i: i + 25]
        out, norm = np.zeros(len(some) * columns), np.zeros(len(some))
        for owner, triple, weight in _triples(some):
            norm += weight ** 2 * np.bincount(owner, minlength=len(some))
            at = column[triple]
            out += weight * np.bincount(owner[at >= 0] * columns + at[at >= 0], minlength=len(out))
        whole[i: i + 25] = out.reshape(len(some), columns) / np.sqrt(np.maximum(norm, 1e-9))[:, None]
    return whole


class Nystrom:
    """The kernel against landmarks as a vector, and back from weights of that vector to weights of triples."""

    def __init__(self, marks: list[str]):
        used = np.unique(np.concatenate([t for _, t, _ in _triples(marks)]))
        self._column, self._used = np.full(SIGNS ** 3, -1), used
        self._column[used] = np.arange(len(used))
        phi = features(marks, self._column, len(used))
        values, vectors = np.linalg.eigh((phi @ phi.T).astype(float))
        keep = values > 1e-3 * values[-1]
        self._to = (phi.T.astype(float) @ (vectors[:, keep] / np.sqrt(values[keep]))).astype(np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        """A row for each word, with a last 1 for the bias."""
        out = np.ones((len(words), self._to.shape[1] + 1))
        for i in range(0, len(words), 250):
            out[i: i + 250, :-1] = features(words[i: i + 250], self._column, len(self._used)) @ self._to
        return out

    def machine(self, w: np.ndarray) -> "Machine":
        weights = np.zeros(SIGNS ** 3)
        weights[self._used] = self._to @ w[:-1]
        return Machine(weights, float(w[-1]))


def parts_of(word: str) -> list[str]:
    """The word without signs at its ends; if it is long, its windows."""
    word = _ENDS.sub("", word)
    if len(word) <= LONG:
        return [word]
    out = []
    for run in re.findall(r"[^\W_]+", word):
        out += [run[i: i + LONG] for i in range(0, max(1, len(run) - LONG // 2), LONG // 2)]
    return out


def words_of(text: str) -> list[str]:
    """Words by white space, and runs of single letters with a sign or space between them as one word each."""
    words = text.split()
    if found := _SPACED.findall(text):
        words += ["".join(run.split()) for run in found]
    return words


def letters_of(word: str) -> str:
    """The word's letters alone, with letters for the signs that stand for them: what phrases compare. Letters without a
    code of their own stay as they are."""
    word = _ENDS.sub("", word)
    return "".join(chr(96 + c) if 0 < c <= 26 else x for x in word
                   if (c := int(_CODES[ord(x)]) if ord(x) < len(_CODES) else 27))


def ends_sentence(word: str) -> bool:
    return word[-1] in ".!?"


def _tuples(ids: np.ndarray, sentence: np.ndarray, places: tuple[int, ...], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where tuples of known words (``ids`` from 0, -1 unknown) begin that lie in one sentence, and their keys."""
    reach = places[-1]
    if len(ids) <= reach:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    columns = [ids[: len(ids) - reach]] + [ids[p: len(ids) - reach + p] for p in places]
    at = np.flatnonzero((np.minimum.reduce(columns) >= 0) & (sentence[: len(ids) - reach] == sentence[reach:]))
    key = np.zeros(len(at), np.int64)
    for c in columns:
        key = key * (words + 1) + c[at] + 1
    return at, key


@dataclass
class Phrases:
    """The sentence machine, folded: a weight for each tuple of its words."""
    words: dict[str, int]
    keys: np.ndarray  # ascending
    weights: np.ndarray
    bias: float

    def margin(self, ids: np.ndarray, sentence: np.ndarray) -> float:
        """The highest window of a text, given the places of its words in ``words`` (-1: none) and their sentences."""
        value = np.zeros(len(ids) + 1)
        for places in PAIRS + TRIPLES:
            at, key = _tuples(ids, sentence, places, len(self.words))
            if len(at):
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[found] == key
                value[at[hit] + 1] += self.weights[found[hit]] * DECAY ** (places[-1] - len(places))
        if not value.any():
            return self.bias
        total = value.cumsum()
        return float((total[WINDOW:] - total[:-WINDOW]).max() if len(ids) > WINDOW else total[-1]) + self.bias

    def of_words(self, words: list[str]) -> float:
        ids = np.fromiter((self.words.get(letters_of(w), -1) for w in words), np.int64, len(words))
        return self.margin(ids, _sentences_of(words))


def _sentences_of(words: list[str]) -> np.ndarray:
    ends = np.fromiter(map(ends_sentence, words), np.int64, len(words))
    return ends.cumsum() - ends


@dataclass
class Machine:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    useful: bool = True
    phrases: Phrases | None = None

    def key(self) -> int:
        found = self.phrases
        return zlib.crc32(self.weights.tobytes() + (found.keys.tobytes() + found.weights.tobytes() if found else b""))

    def margins(self, words: list[str]) -> np.ndarray:
        if len(words) > MANY:
            return np.concatenate([self.margins(words[i: i + MANY]) for i in range(0, len(words), MANY)])
        parts = [parts_of(w) for w in words]
        flat = word_margins([p for ps in parts for p in ps], self.weights) + self.bias
        starts = np.cumsum([0, *(len(p) for p in parts)])[:-1]
        return np.maximum.reduceat(flat, starts) if len(words) else flat


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 10) -> np.ndarray:
    """Newton steps for the squared hinge; the last coordinate of ``x`` is the bias and is not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        inside = np.flatnonzero(y * (x @ w) < 1)
        if not len(inside):
            break
        square, right = penalty.copy(), np.zeros(x.shape[1])
        step = max(1, CELLS // x.shape[1])
        for i in range(0, len(inside), step):  # x is not copied whole
            some = inside[i: i + step]
            a, b = x[some], weight[some]
            square += a.T @ (a * b[:, None])
            right += a.T @ (b * y[some])
        new = np.linalg.solve(square, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _contexts(sentences: set[str]) -> Counter:
    """Of each word, the number of different pairs of neighbours. Words are numbers here, 0 the edge of a sentence."""
    number, places = {"": 0}, array("i", [0])
    for sentence in sentences:
        places.extend(number.setdefault(_ENDS.sub("", w), len(number)) for w in words_of(sentence))
        places.append(0)
    ids = np.frombuffer(places, np.int32)
    words = list(number)
    counted = np.fromiter((0 < len(w) <= LONG for w in words), bool, len(words))
    at = np.flatnonzero(counted[ids])
    beside = np.unique(ids[at - 1].astype(np.int64) * len(words) + ids[at + 1], return_inverse=True)[1]
    counts = _different(ids[at].astype(np.int64), beside, len(words))
    return Counter({words[i]: int(counts[i]) for i in np.flatnonzero(counts).tolist()})


def _surprise(toxic: int, clean: int, share: float) -> float:
    """At least -log of the chance that so many of a word's contexts are toxic, where each is with probability ``share``
    (Chernoff's bound)."""
    n = toxic + clean
    return toxic * np.log(toxic / (n * share)) + (clean * np.log(clean / (n * (1 - share))) if clean else 0.0)


def _surprises(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """``_surprise`` of many counts, with none where the toxic share is not above chance."""
    n = np.maximum(toxic + clean, 1)
    value = toxic * np.log(np.maximum(toxic, 1) / (n * share)) + clean * np.log(np.maximum(clean, 1) / (n * (1 - share)))
    return np.where(toxic > n * share, value, 0.0)


def _different(which: np.ndarray, beside: np.ndarray, count: int) -> np.ndarray:
    """Of each tuple, the number of different pairs of neighbours."""
    most = int(beside.max(initial=0)) + 1
    return np.bincount(np.unique(which * most + beside) // most, minlength=count)


def _usual(which: np.ndarray, beside: np.ndarray, count: int) -> np.ndarray:
    """Whether the word beside a place is beside more than a third of the places of its tuple (the edge, -1, never is)."""
    pair = which * (int(beside.max(initial=0)) + 2) + beside + 1
    _, of, times = np.unique(pair, return_inverse=True, return_counts=True)
    return (beside >= 0) & (3 * times[of] > np.bincount(which, minlength=count)[which])


def _number_of(keys: np.ndarray) -> int:
    """Of different keys."""
    ordered = np.sort(keys)
    return int(np.count_nonzero(ordered[1:] != ordered[:-1])) + 1


def _telling_phrases(ids, sentence, toxic, words: int, share: float, known: np.ndarray) -> np.ndarray:
    """Rows of five: the words of phrases (-1 at the end of pairs), their two places. The phrases are those that toxic
    sentences have between 20 times as many pairs of neighbours as chance, and more than chance gives to any. Places next to
    a neighbour that is usual there do not count, so that a passage with a wrong label and its near copies have no weight.
    ``known`` words are left to the word machine."""
    out, where, tests = [], [], 0
    inner = sentence[1:] == sentence[:-1]
    edge = np.array([-1], ids.dtype)
    before = np.concatenate([edge, np.where(inner, ids[:-1], edge)])
    after = np.concatenate([np.where(inner, ids[1:], edge), edge])
    for places in PAIRS + TRIPLES:
        at, key = _tuples(ids, sentence, places, words)
        if not len(at):
            continue
        whole = _number_of(key)
        tests += whole
        # A surprise is at most that of a tuple whose places are all toxic and count; only those that can reach the bound stay.
        least = np.log(whole / CHANCE) / np.log(1 / share) * (1 - 1e-9)
        often, times = np.unique(key[toxic[at] == 1], return_counts=True)
        often = often[times >= least]
        if not len(often):
            continue
        can = often[np.minimum(np.searchsorted(often, key), len(often) - 1)] == key
        at, key = at[can], key[can]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        y, count = toxic[at], len(first)
        left, right = before[at].astype(np.int64), after[at + places[-1]].astype(np.int64)
        beside = np.unique((left + 1) * (words + 1) + right + 1, return_inverse=True)[1]
        free = np.flatnonzero(y == 1)
        free = free[~(_usual(which[free], left[free], count) | _usual(which[free], right[free], count))]
        kept = np.zeros(len(at), bool)
        kept[free] = True
        clean, bad = _different(which[y == 0], beside[y == 0], count), _different(which[free], beside[free], count)
        value = _surprises(bad, clean, share)
        used = np.stack([ids[at[first]], *(ids[at[first] + p] for p in places)])
        value[(bad * (1 - share) <= 20 * clean * share) | known[used].any(axis=0)] = 0.0
        by = np.argsort(which, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=count))])
        for i in np.flatnonzero(value > np.log(whole / CHANCE)).tolist():
            mine = by[starts[i]: starts[i + 1]]
            mine = mine[kept[mine]]
            row = [*used[:, i].tolist(), -1][:3] + [*places, -1][:2]
            out.append((float(value[i]), row, int(clean[i])))
            where.append((sentence[at[mine]], beside[mine]))
    # The most surprising first; what others already explain must be surprising in the sentences without them.
    explained, chosen = np.zeros(int(sentence[-1]) + 1, bool), []
    for i in sorted(range(len(out)), key=lambda i: (-out[i][0], out[i][1])):
        at, beside = where[i]
        left, clean = len(np.unique(beside[~explained[at]])), out[i][2]
        value = _surprises(np.array([left]), np.array([clean]), share)[0]
        if value > np.log(tests / CHANCE) and left * (1 - share) > 20 * clean * share and len(chosen) < PHRASES:
            chosen.append(out[i][1])
            explained[at] = True
    return np.array(chosen, np.int64).reshape(len(chosen), 5)


def _whole_key(row: list[int], place: np.ndarray, words: int) -> int:
    """The key of a landmark's longest tuple."""
    key = 0
    for word in row[:3]:
        key = key * (words + 1) + int(place[word]) + 1 if word >= 0 else key
    return key


def train_phrases(sentences: list[tuple[str, int]], machine: Machine, ridge: float = 0.1) -> Phrases | None:
    """The sentence machine, or none if toxic sentences have no telling phrase. Windows of toxic sentences that hold a
    landmark's words are the positive examples; all windows of clean sentences are negative."""
    # Sentences are kept as numbers of their words, one array for all.
    number, places, lengths, labels = {}, array("i"), [], []
    for s, y in sorted({(s.lower(), y) for s, y in sentences}):
        if words := s.split():
            places.extend(number.setdefault(w, len(number)) for w in words)
            lengths.append(len(words))
            labels.append(y)
    names = [letters_of(w) for w in number]
    vocabulary = {n: i for i, n in enumerate(sorted(set(names) - {""}))}
    if not vocabulary:
        return None
    ids = np.array([vocabulary.get(n, -1) for n in names], np.int32)[np.frombuffer(places, np.int32)]
    del number, places, names
    sentence = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    toxic = np.repeat(np.array(labels, np.int8), lengths)
    share = sum(labels) / len(labels)
    if not 0 < share < 1 or len(vocabulary) >= 1 << 20:
        return None
    found = machine.margins(list(vocabulary)) if machine.useful else np.full(len(vocabulary), LOWEST)
    telling = _telling_phrases(ids, sentence, toxic, len(vocabulary), share, found > 0)
    if not len(telling):
        return None

    # From here on only the words of landmarks count; a landmark is the string of its words, unknown ones where it skips.
    used = np.unique(telling[:, :3][telling[:, :3] >= 0])
    place = np.full(len(vocabulary) + 1, -1)
    place[used] = np.arange(len(used))
    marks = np.full((len(telling), 4), -1)
    marks[:, 0] = place[telling[:, 0]]
    for m, (_, b, c, p, q) in zip(marks, telling.tolist()):
        m[p] = place[b]
        if c >= 0:
            m[q] = place[c]
    mark_of = np.repeat(np.arange(len(marks)), 4)
    keys = np.unique(np.concatenate([_tuples(marks.ravel(), mark_of, p, len(used))[1] for p in PAIRS + TRIPLES]))

    def strings(ids: np.ndarray, sentence: np.ndarray, window: np.ndarray, count: int) -> np.ndarray:
        phi = np.zeros(count * len(keys))
        for places in PAIRS + TRIPLES:
            at, key = _tuples(ids, sentence, places, len(used))
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[found] == key
            phi += DECAY ** (places[-1] - len(places)) * np.bincount(window[at[hit]] * len(keys) + found[hit], minlength=len(phi))
        return phi.reshape(count, len(keys))

    own = np.searchsorted(keys, [_whole_key(row, place, len(used)) for row in telling.tolist()])
    phi = strings(marks.ravel(), mark_of, mark_of, len(marks))
    phi /= np.linalg.norm(phi, axis=1)[:, None]
    values, vectors = np.linalg.eigh(phi @ phi.T)
    keep = values > 1e-3 * values[-1]
    to = phi.T @ (vectors[:, keep] / np.sqrt(values[keep]))

    # Windows of each sentence. Equal ones count together, and most hold no tuple of a landmark: the empty string.
    offset = np.arange(len(ids)) - np.repeat(np.cumsum([0, *lengths[:-1]]), lengths)
    window, label = np.cumsum(offset % WINDOW == 0) - 1, toxic[offset % WINDOW == 0]
    ids, step, part = place[ids], 20_000, max(1, CELLS // len(keys))
    rows, signs, use, empty = [np.zeros((1, to.shape[1]))], [[-1.0]], [], int((label == 0).sum())
    for i in range(0, len(label), step):
        found = {-1.0: [], 1.0: []}
        for j in range(i, min(i + step, len(label)), part):  # a dense table of a few windows at a time
            end = min(j + part, i + step, len(label))
            low, high = np.searchsorted(window, [j, end])
            some = strings(ids[low:high], sentence[low:high], window[low:high] - j, end - j)
            y = label[j:end]
            found[-1.0].append(some[(y == 0) & some.any(axis=1)])
            found[1.0].append(some[(y == 1) & some[:, own].any(axis=1)])
        for sign in (-1.0, 1.0):
            alike, times = np.unique(np.concatenate(found.pop(sign)), axis=0, return_counts=True)
            rows.append(alike @ to)
            signs.append(np.full(len(alike), sign))
            use.append(times)
            empty -= int(times.sum()) if sign < 0 else 0
    y = np.concatenate(signs)
    if not (y > 0).any():
        return None
    weight = np.concatenate([[max(empty, 1)], *use]).astype(float)
    weight[y > 0] *= 0.3 * weight[y < 0].sum() / weight[y > 0].sum()
    rows = np.concatenate(rows)
    x = np.concatenate([rows, np.ones((len(rows), 1))], axis=1)
    w = _svm(x, y, weight / weight.mean(), ridge)
    words = {n: int(place[i]) for n, i in vocabulary.items() if place[i] >= 0}
    return Phrases(words, keys, to @ w[:-1], float(w[-1]))


def train(sentences: list[tuple[str, int]], landmarks: int = LANDMARKS) -> Machine:
    """Both machines of labelled sentences."""
    machine = train_words(sentences, landmarks)
    machine.phrases = train_phrases(sentences, machine)
    machine.useful = machine.useful or machine.phrases is not None
    return machine


def train_words(sentences: list[tuple[str, int]], landmarks: int = LANDMARKS, rounds: int = 3, ridge: float = 0.1) -> Machine:
    """The machine of words of labelled sentences, equal ones once. Positive words: those that toxic sentences have in far more
    contexts; the neighbours count, so that a passage with a wrong label and many near copies has no weight."""
    toxic = {s.lower() for s, y in sentences if y}
    clean = {s.lower() for s, y in sentences if not y} - toxic
    seen, other = _contexts(toxic), _contexts(clean)
    nothing = Machine(np.zeros(SIGNS ** 3), LOWEST, useful=False)
    if not seen or not other:
        return nothing

    # Words of toxic sentences in 20 times as many contexts as chance, the usual ones first.
    scale = len(toxic) / max(len(clean), 1)
    telling = sorted((w for w in seen if seen[w] > 20 * other[w] * scale), key=lambda w: (-seen[w], w))
    share = len(toxic) / (len(toxic) + len(clean))
    positive = [w for w in telling if seen[w] >= min(max(2, seen[telling[0]] / 4), seen[telling[0]])
                or _surprise(seen[w], other[w], share) > np.log(len(seen) / CHANCE)]
    if not positive:
        return nothing
    by_use = sorted(other, key=lambda w: (-other[w], w))
    spread = sorted(other, key=lambda w: zlib.crc32(w.encode()))
    negative, hard = list(dict.fromkeys(by_use[:1000] + spread[:3000])), []
    machine = nothing
    for _ in range(rounds):
        marks = positive[: landmarks // 2] + hard[: landmarks // 4] + by_use[: landmarks // 4] + spread
        marks = list(dict.fromkeys(marks))[:landmarks]
        space = Nystrom(marks)
        x = space(positive + negative)
        y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
        use = np.concatenate([np.log1p([seen[w] for w in positive]), np.log1p([other[w] for w in negative])])
        use[y > 0] *= 0.3 * use[y < 0].sum() / use[y > 0].sum()
        machine = space.machine(_svm(x, y, use / use.mean(), ridge))
        found = [c for c, m in zip(telling, machine.margins(telling)) if m > 0.7]
        positive = list(dict.fromkeys(positive + found))
        margins = machine.margins(spread)
        hard = [spread[i] for i in np.argsort(-margins, kind="stable")[:2000]]
        negative = list(dict.fromkeys(negative + hard))
    return machine


def calibrate(machine: Machine, margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
    """The curve from margin to score: 0.5 at the machine's own boundary, or at the place nearest to it that puts (nearly) as
    many weighted labels on their side as any; and the likeliest of a few slopes, with a floor for wrong labels."""
    order = np.argsort(margins, kind="stable")
    m, gain = margins[order], np.where(labels[order] == 1, weight[order], -weight[order])
    low, high = np.concatenate([[-np.inf], m]), np.concatenate([m, [np.inf]])
    good = np.concatenate([gain[::-1].cumsum()[::-1], [0.0]])  # what a cut between low and high gets right more than wrong
    good[low == high] = -np.inf
    near = np.flatnonzero(good >= good.max() - 0.002 * weight.sum())
    cuts = np.clip(0.0, low[near] + 1e-9, high[near])
    cut = cuts[np.argmin(np.abs(cuts))]

    def likelihood(slope: float) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(slope * (margins - cut), -30, 30))), 0.05, 0.95)
        return float((weight * np.where(labels == 1, np.log(p), np.log(1 - p))).sum())

    machine.slope = max((2.0, 4.0, 8.0, 16.0), key=likelihood)
    machine.shift = -machine.slope * float(cut)


_known: dict[str, float] = {}
_places: dict[str, int] = {}
_known_of: list = [None]


def document_margins(texts: list[str], machine: Machine, key) -> Iterator[float]:
    """The highest margin of each text's words and windows, some MB of text at a time. Words met before are kept, for one
    model."""
    phrases = machine.phrases
    if _known_of[0] != key:
        _known.clear()
        _places.clear()
        _known_of[0] = key
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < PORTION):
            size += len(texts[end])
            end += 1
        split = [words_of(t.lower()) for t in texts[at:end]]
        new = list(set().union(*split).difference(_known))
        if len(_known) + len(new) > KEEP:
            _known.clear()
            _places.clear()
            new = list(set().union(*split))
        _known.update(zip(new, machine.margins(new).tolist()))
        if phrases:
            _places.update((w, phrases.words.get(letters_of(w), -1)) for w in new)
        for text, words in zip(texts[at:end], split):
            margin = max(map(_known.__getitem__, words), default=LOWEST)
            if phrases and words:
                words = text.lower().split()
                ids = np.fromiter(map(_places.__getitem__, words), np.int64, len(words))
                if np.count_nonzero(ids >= 0) > 1:
                    margin = max(margin, phrases.margin(ids, _sentences_of(words)))
            yield margin
        at = end


def held_out(doc_id: Column) -> Column:
    """Whether a row is never learned from; a null id never is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def held_back(doc_id: Column) -> Column:
    """Whether a row that may be learned from is kept for the curve alone."""
    return F.floor(F.crc32(doc_id.cast("string").cast("binary")) / FOLDS) % BACK == 0


def _smallest(rows: DataFrame, key: str, most: int, of: int) -> DataFrame:
    """The ``most`` rows of the smallest hash. Rows far from the cut go first, so tasks send about as many rows as are taken."""
    hashed = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if of > 2 * most:
        rows = rows.where(hashed < int((1 << 40) * 2 * most / of))
    return rows.orderBy(hashed, key).limit(most)


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """Trains on a bounded sample of the labelled rows that are not held out. A document with both labels counts as both."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [_smallest(known.where(F.col("toxic") == y), "doc_id", DOCUMENTS, counts.get(y, 0)) for y in (0, 1)]
    # At most 2 * DOCUMENTS rows of two numbers: a bounded broadcast, so that no text is shuffled.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text")).join(
        F.broadcast(picked[0].union(picked[1])), "doc_id")
    sample = materialize(sample.withColumn("back", held_back(F.col("doc_id"))), "labelled-sample")
    # A sentence that other documents have too is not held back with one of them.
    sentences = sample.select("toxic", "back", F.explode(F.split("text", r"[.!?\n]+")).alias("sentence")).select(
        "toxic", "back", F.trim(F.substring("sentence", 1, SENTENCE_CHARS)).alias("sentence")).where(
            "sentence != ''").groupBy("toxic", "sentence").agg(F.min("back").alias("back"))
    sentences = materialize(sentences, "labelled-sentences")
    rows = []
    for y in (0, 1):
        some = sentences.where(F.col("toxic") == y)
        rows += [(r.sentence, r.toxic, r.back) for r in _smallest(some, "sentence", SENTENCES, some.count()).collect()]
    machine = train([(s, y) for s, y, _ in rows])
    if not machine.useful:
        return machine
    # The curve is that of a machine that has not seen the quarter held back, on that quarter.
    judge = train([(s, y) for s, y, back in rows if not back])
    if judge.useful:
        some = _margins(sample.where("back"), judge).join(known, "doc_id")
        most = 4 * DOCUMENTS  # reached only if ids repeat; then the smallest by hash are taken
        found = some.select("margin", "toxic").orderBy(F.xxhash64("doc_id"), "toxic", "margin").limit(most).toPandas()
        y = found["toxic"].to_numpy()
        if set(y) == {0, 1}:
            share = np.array([counts[c] / (y == c).sum() for c in (0, 1)])
            calibrate(judge, found["margin"].to_numpy(), y, share[y])
            machine.slope, machine.shift = judge.slope, judge.shift
    return machine


def _margins(docs: DataFrame, machine: Machine) -> DataFrame:
    shared, key = docs.sparkSession.sparkContext.broadcast(machine), machine.key()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margins = list(document_margins(b.column(1).to_pylist(), shared.value, key))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(margins, pa.float64())], ["doc_id", "margin"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text")).mapInArrow(
        scored, "doc_id long, margin double")


def _score(margin, machine: Machine):
    if not machine.useful:
        return F.lit(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(machine.slope) * margin + F.lit(machine.shift))))


def toxicity_scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5 on) of every row."""
    return _margins(docs, machine).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), _score(F.col("margin"), machine).alias("score")).withColumn(
            "predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    name = fresh_name(docs, "toxicity_margin")
    shared, key = docs.sparkSession.sparkContext.broadcast(machine), machine.key()

    @F.pandas_udf("double")
    def margin(texts: pd.Series) -> pd.Series:
        return pd.Series(list(document_margins(texts.tolist(), shared.value, key)), dtype=float)

    return docs.withColumn(name, _score(margin(whole_text(docs)), machine)).where(F.col(name) < 0.5).drop(name)
