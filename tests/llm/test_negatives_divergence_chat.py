"""Hard negatives, source divergence and chat formatting against plain versions, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitloom.llm import chat, divergence, hard_negatives

NAN, INF = float("nan"), float("inf")


# ---- Hard negatives


@pytest.mark.parametrize("low, high, size", [(-132, 145, 64), (0, 1, 64), (0, 0, 5), (-40_000, 50_000, 64), (-(1 << 24), 1 << 24, 16),
                                             (5, 9, 300), (-1, 1, 1), (-7, -3, 4)])
def test_packed_products_are_exact(low, high, size):
    rng = np.random.default_rng(size)
    a, b = rng.integers(low, high + 1, (37, size)), rng.integers(low, high + 1, (101, size))
    a[0], b[0], b[1] = low, high, low
    assert (hard_negatives.packed_product(a, b) == a @ b.T).all()


def test_several_rows_share_a_wide_number():
    """Two fields at least for common components, more for small ones, down to rows that don't fill the last number."""
    for span, rows in ((1, 7), (300, 3)):
        a, b = np.full((2, 4), span), np.arange(rows * 4).reshape(rows, 4) % (span + 1)
        assert (hard_negatives.packed_product(a, b) == a @ b.T).all()
    assert hard_negatives.packed_product(np.zeros((0, 3), np.int64), np.zeros((5, 3), np.int64)).shape == (0, 5)
    assert hard_negatives.packed_product(np.zeros((2, 3), np.int64), np.zeros((0, 3), np.int64)).shape == (2, 0)


def plain_negatives(rows, k=5):
    """Of (vec_id, vector, label) rows by Python's whole numbers; labels as they are."""
    sizes = Counter()
    valid = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or x != x or x in (INF, -INF) for x in vector):
            continue
        sizes[len(vector)] += 1
        valid.append((vec_id, [int(np.floor(256 * x)) for x in vector], label))
    if not valid:
        return []
    size = max(sizes, key=lambda n: (sizes[n], n))
    valid = [v for v in valid if len(v[1]) == size]
    out = []
    for anchor, q, label in valid:
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, c)), vec_id, of == label) for vec_id, c, of in valid if vec_id != anchor)
        for s, positive, _ in [x for x in scored if x[2]][:k]:
            near = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(anchor, positive, n + 1, x[1], -s, -x[0]) for n, x in enumerate(near)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(spark, rows, kind="double"):
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows],
                                  f"vec_id long, embedding array<{kind}>, label int, q string, block int, anchor string").repartition(3)
    got = hard_negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, F.col("label"))
    return sorted(tuple(r) for r in got.select(COLUMNS).collect())


def test_hard_negatives_of_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0.3, 0.4, 6)], int(rng.integers(0, 3)) if i % 9 else 2) for i in range(420)]
    copy = rows[50][1]
    rows += [(1000 + i, copy, i % 2) for i in range(90)]  # a hot vector, of two labels
    rows += [(2000, copy, 0), (2000, copy, 0), (2001, copy, 1), (2001, copy, 1)]  # repeated rows, an anchor among them
    rows += [(3000, [0.5] * 6, 7)]  # an anchor without positives
    rows += [(4000, None, 1), (4001, [0.1] * 6, None), (None, [0.1] * 6, 1), (4100, [0.1, None] * 3, 1), (4003, [NAN] * 6, 1),
             (4004, [INF] + [0.1] * 5, 1), (4005, [], 1), (4006, [0.1] * 5, 1), (4200, [-0.9] * 6, 1)]
    for tile in (4096, 64):  # one tile, and many
        monkeypatch.setattr(hard_negatives, "TILE", tile)
        monkeypatch.setattr(hard_negatives, "STEP", 7)
        assert mined(spark, rows) == plain_negatives(rows)
    assert len(plain_negatives(rows)) > 100


def test_hard_negatives_of_large_components_and_of_nothing(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(3e4, 2e4, 5)], int(rng.integers(0, 2))) for i in range(210)]
    assert mined(spark, rows) == plain_negatives(rows) != []
    with pytest.raises(ValueError, match="might not fit a long"):
        mined(spark, [(0, [1e30], 1), (1, [1.0], 1)])
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


# ---- Source divergence

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least, shown=10):
    documents, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = LETTERS.findall((text or "").translate(LOWER))
        documents[lang or ""].update(set(found))
        counts[lang or "", source or ""].update(found)
    out = []
    for lang, seen in documents.items():
        kept = sorted((t for t, n in seen.items() if n >= least), key=str.encode)
        groups, v = [g for g in counts if g[0] == lang], len(kept)
        total = {g: sum(counts[g][t] for t in kept) for g in groups}
        share = lambda n, whole: 1 + 10**9 * (n + 2) // (whole + 2 * v)
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        p = {g: [share(counts[g][t], total[g]) for t in kept] for g in groups}
        q = [share(sum(counts[g][t] for g in groups), sum(total.values())) for t in kept]
        for g in groups:
            pairs = sorted((-sum(map(apart, p[g], p[h])), h[1].encode()) for h in groups if h != g)
            terms = sorted((-apart(x, y), t.encode()) for t, x, y in zip(kept, p[g], q) if counts[g][t] and x > y)[:shown]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(*g, part, item.decode(), -value, n + 1) for n, (value, item) in enumerate(found)]
    return sorted(out)


def audited(spark, rows, least):
    table = spark.createDataFrame([(i // 2, *r, "x", 3) for i, r in enumerate(rows)],
                                  "doc_id long, lang string, source string, text string, term string, ordinal int").repartition(3)
    got = divergence.audit_sources(table, least)
    return sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect())


def odd_corpus():
    rnd = random.Random(4)
    parts = ["a", "B", "ä", "ß", "zz", "Q", "é", "日本", "x"]
    words = ["".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(120)]
    rows = [(rnd.choice(["en", "fr", None]), rnd.choice(["s1", "s2", "s2", "s2", "é", None]),
             "".join(w + rnd.choice([" ", ", ", "1", "\n", "."]) for w in rnd.choices(words, k=40))) for _ in range(160)]
    rows += [("en", "s1", "same words again")] * 12  # repeated rows
    rows += [("en", "quiet", None), ("en", "empty", ""), ("en", "signs", "1 2 3 !"), ("rare", "s1", "few documents"), ("rare", "s2", "here")]
    rows += [("alone", "s1", "one source only")] * 10
    rows += [("en", "s2", "L" * 200_000 + " x")] * 10 + [("fr", "s2", "word " * 100_000)]  # a very long term, a very long text
    return rows


def test_audit_equals_plain_version(spark, monkeypatch):
    rows = odd_corpus()
    want = plain_audit(rows, 5)
    assert {"pair", "term"} == {r[2] for r in want} and any(r[3] == "l" * 200_000 for r in want)
    assert audited(spark, rows, 5) == want
    # Several transducers in several passes, several ranges, several blocks of sources.
    for name, value in (("SHARD", 17), ("BUNDLE", 40_000), ("RANGE", 13), ("BLOCK", 2)):
        monkeypatch.setattr(divergence, name, value)
    assert audited(spark, rows, 5) == want
    assert audited(spark, rows, 1000) == plain_audit(rows, 1000)  # no language keeps a term
    assert audited(spark, [], 1) == []


def test_transducer_is_minimal_and_gives_the_order():
    rnd = random.Random(3)
    terms = sorted({bytes(rnd.choices(b"ab\xc3\xa9zq", k=rnd.randint(1, 7))) for _ in range(3000)})
    reader = divergence.Transducer(divergence.compile_terms(terms))
    probe = terms + [t + b"x" for t in terms[:50]] + [b"q" * 40, b"b"]
    data, ends = np.frombuffer(b"".join(probe), np.uint8), np.cumsum([len(t) for t in probe])
    got = reader.ordinals(data, ends - [len(t) for t in probe], ends)
    place = {t: n for n, t in enumerate(terms)}
    assert got.tolist() == [place.get(t, -1) for t in probe]
    # As many states as there are different sets of endings.
    endings = defaultdict(set)
    for t in terms:
        for i in range(len(t) + 1):
            endings[t[:i]].add(t[i:])
    assert len(reader.base) == len(set(map(frozenset, endings.values())))


def test_chunks_and_runs_keep_texts_apart():
    texts = ["ab", "Cd e", "", "ÄB", "9", "x" * 50]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    signs, starts, ends, text_of = divergence.term_runs(np.frombuffer(data, np.uint8), offsets)
    got = [(int(n), bytes(signs[a:b])) for a, b, n in zip(starts, ends, text_of)]
    assert got == [(0, b"ab"), (1, b"cd"), (1, b"e"), (3, "Äb".encode()), (5, b"x" * 50)]
    assert list(divergence._chunks(np.array([0]))) == []
    assert list(divergence._chunks(np.array([0, 3, 3, 5 << 20, 5 << 20]))) == [(0, 2), (2, 3), (3, 4)]


def test_shares_are_exact_for_large_counts():
    total = 8 * 10**15
    for count in (0, 1, 10**9, 9_223_372_036_854, total):
        assert int(divergence.shares(np.array([[count]]), np.array([[total]]), 3)[0, 0]) == 1 + 10**9 * (count + 2) // (total + 6)


# ---- Chats

MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/TEXT]"]


def odd_text(rnd):
    pieces = [*MARKS, "\\", "<", "[", "INST]", "s>", "\n", " ", "é", "😀", "[\\INST]", "<\\\\/s>", "<\\<SYS>>", "$1", "word"]
    return "".join(rnd.choices(pieces, k=rnd.randint(0, 12)))


def plain_digests(turns):
    told = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chats_come_back_from_their_training_text(spark):
    rnd = random.Random(8)
    chats = {n: [(rnd.choice(["user", "assistant", "system", "tool", None, "", "[ROLE] x [TEXT]"]), rnd.choice([odd_text(rnd), odd_text(rnd), None]))
                 for _ in range(rnd.randint(1, 9))] for n in range(300)}
    for n, roles in enumerate((["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "user"], ["user"])):
        for at in range(20):
            chats[1000 + 20 * n + at] = [(r, odd_text(rnd)) for r in roles]
    chats[5000] = [("user" if i % 2 else "assistant", odd_text(rnd)) for i in range(1500)]  # several groups of turns
    chats[5001] = [("user", "q"), ("assistant", "[INST]é" * 300_000)]
    rows = [(n, at, r, t, "x", "y") for n, turns in chats.items() for at, (r, t) in enumerate(turns)]
    rnd.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, layout string").repartition(5)
    made = chat.format_chats(chat.records_of_turns(table))
    got = {r.conv_id: tuple(r)[1:5] for r in chat.chat_digests(made).collect()}
    assert got == {n: plain_digests(turns) for n, turns in chats.items()}
    assert {r.layout for r in made.select("layout").distinct().collect()} == {"completion", "instruction", "from_value", "messages"}
    # No mark in the training text but the template's own: two of each turn, and three of a written-out role.
    marks = re.compile("|".join(map(re.escape, MARKS)))
    for r in made.where("conv_id < 300").collect():
        assert len(marks.findall(r.formatted)) == sum(2 if role in chat.MARKS else 3 for role, _ in chats[r.conv_id])


def test_ties_nulls_and_empty_tables_of_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "assistant", "last"), (1, 7, "assistant", "c"),
            (None, 1, "user", "no id"), (None, 0, "user", "no id"), (2, 3, "user", "x"), (2, 3, "user", "x")]
    digests = chat.chat_digests(chat.format_chats(chat.records_of_turns(spark.createDataFrame(rows, schema))))
    got = {r.conv_id: tuple(r)[1:5] for r in digests.collect()}
    assert got == {1: plain_digests([("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "last")]),
                   None: plain_digests([("user", "no id")] * 2), 2: plain_digests([("user", "x")] * 2)}
    empty = chat.chat_digests(chat.format_chats(chat.records_of_turns(spark.createDataFrame([], schema))))
    assert empty.count() == 0


def test_layouts_of_mixed_records(spark, tmp_path):
    """Records of all layouts in one file, as they come; what no layout fits stays without turns."""
    records = {
        '{"n": 1, "prompt": "p", "completion": "c", "meta": {"score": 1}}': ("completion", [("user", "p"), ("assistant", "c")]),
        '{"n": 2, "prompt": "p", "response": ""}': ("response", [("user", "p"), ("assistant", "")]),
        '{"n": 3, "question": "q", "answer": "a", "system": "s"}': ("question", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        '{"n": 4, "instruction": "i", "output": "o"}': ("instruction", [("user", "i"), ("assistant", "o")]),
        '{"n": 5, "instruction": "i", "input": "more", "output": "o"}': ("instruction", [("user", "i\n\nmore"), ("assistant", "o")]),
        '{"n": 6, "messages": [{"role": "user", "content": "u"}, {"role": "tool", "content": null}]}':
            ("messages", [("user", "u"), ("tool", "")]),
        '{"n": 7, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": "system", "value": "s"}]}':
            ("from_value", [("user", "h"), ("assistant", "g"), ("system", "s")]),
        '{"n": 8, "prompt": "p"}': (None, None),
        '{"n": 9, "prompt": "p", "completion": "c", "answer": "which?"}': (None, None),
        '{"n": 10, "messages": []}': (None, None),
        '{"n": 11, "layout": "clash", "turns": 3}': (None, None),
    }
    (tmp_path / "mixed.json").write_text("\n".join(records))
    read = spark.read.json(str(tmp_path / "mixed.json"))
    made = chat.canonical_turns(read)
    assert made.columns == [*read.columns, "layout_", "turns_"]
    got = [(r.layout_, r.turns_ and [tuple(t) for t in r.turns_]) for r in made.orderBy("n").collect()]
    assert got == list(records.values())
    formatted = {r.n: r for r in chat.format_chats(read).collect()}
    assert formatted[8].formatted is None and formatted[3].formatted == "<<SYS>> s <</SYS>>[INST] q [/INST]<s> a </s>"
    assert [formatted[3].formatted[s.start:s.stop] for s in formatted[3].loss_spans] == ["a"]
    assert chat.format_chats(read.limit(0)).count() == 0


def test_chat_plan_has_no_python(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = chat.chat_digests(chat.format_chats(chat.records_of_turns(rows)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and plan.count("Exchange") <= 2
