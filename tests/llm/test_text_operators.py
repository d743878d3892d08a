"""Operators over documents against plain versions, and their edge cases."""

import array
import base64
import bz2
import collections
import gzip
import hashlib
import json
import lzma
import random
import re
import tracemalloc
import urllib.parse
import weakref
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from visitloom.llm import bytebpe, exact, lexicon, packing, queries, secrets, sharding, simhash, substring, toxicity, wordpieces
from visitloom.llm.common import keep_rows, row_hash
from visitloom.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"
#: Nulls, empty and blank texts, repeated rows and ids, ties, a long text; clashing extra columns.
ODD = [(1, "Alpha beta gamma delta. Epsilon zeta eta theta."), (2, "Alpha  beta gamma delta.\tEpsilon zeta eta theta."), (3, None),
       (4, ""), (5, " \n\t"), (6, "one"), (6, "one"), (7, "on e"), (None, "one"), (None, "Alone with no id"), (8, "two words"),
       (9, "A B C"), (10, "a b c"), (11, "x <|endoftext|> y  z\n\n w"), (12, " ".join(f"w{i % 977}" for i in range(30_000)))]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en", None if i % 3 else "s", 0, "x", 1.5, "y") for i, (d, t) in enumerate(ODD)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars int, digest string, fp double, spans string")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- SimHash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace(
        "\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """(doc_id, fingerprint) to the smallest id reachable, by comparing all pairs."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return collections.Counter((d, f"{fp:016x}", least.get(find(i))) for i, (d, fp) in enumerate(rows))


@pytest.mark.parametrize("tile", [4096, 2])
def test_simhash_equals_all_pairs(spark, odd, small, tile):
    for df in (odd, small):
        got = collections.Counter((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id)
                                  for r in simhash.near_duplicates(df, tile=tile).collect())
        assert got == plain_components([(d, plain_fingerprint(t)) for d, t in texts_of(df)])


def test_simhash_query(spark, small):
    got = collections.Counter(tuple(r) for r in queries.op2_simhash(spark, SMALL).collect())
    assert got == plain_components([(d, plain_fingerprint(t)) for d, t in texts_of(small)])


@pytest.mark.parametrize("tile", [4096, 16])
def test_links_find_all_neighbours(spark, tile):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = {0, 1, 2**64 - 1}
    for c in centres:
        for _ in range(rng.choice([1, 2, 60])):
            c ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(7)))
            fps.add(c)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    parts = {r.node & (2**64 - 1): r.component for r in connected_components(simhash.links(df, 4, tile)).collect()}
    want = plain_components([(i, f) for i, f in enumerate(fps)])
    of = {int(fp, 16): least for (_, fp, least) in want}
    for a in fps:
        for b in fps:
            assert (of[a] == of[b]) == (a == b or a in parts and b in parts and parts[a] == parts[b])


def test_tiles_of_a_large_bucket(spark):
    rng = random.Random(4)
    some = {rng.getrandbits(42) << 22 | 77 for _ in range(4200)}
    alike = {sum(1 << b for b in rng.sample(range(22, 64), 20)) | 77 for _ in range(4200)}
    near = [(f, f ^ sum(1 << b for b in rng.sample(range(22, 64), 2))) for f in rng.sample(sorted(some), 200)]
    for fps, tile in ((some, 4096), (alike, 512), (some.union(*near), 512)):
        df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in sorted(fps)], "fp long")
        units = simhash._units(df, 4, tile).where("bucket = 0 + (77L << 11)").toPandas()
        sizes = units.groupby(["left", "right"]).size()
        assert set(units.fp) == {f - 2**64 if f >> 63 else f for f in fps} and sizes.max() < 2.4 * tile
        if tile == 4096:
            assert len(units) < 1.5 * len(fps)
        of = units.groupby("fp").apply(lambda g: set(zip(g.left, g.right)), include_groups=False)
        signed = lambda f: f - 2**64 if f >> 63 else f
        assert fps is some or fps is alike or all(of[signed(a)] & of[signed(b)] for a, b in near)
    parts = {r.node & (2**64 - 1): r.component for r in connected_components(simhash.links(df, 4, 512)).collect()}
    assert all(parts[a] == parts[b] for a, b in near)


def test_simhash_keeps_one_of_each_group(spark, odd, small, nothing):
    for df in (odd, small):
        kept = simhash.one_of_each_group(df)
        assert kept.columns == df.columns
        found = simhash.near_duplicates(df).collect()
        assert kept.count() == len({r.cluster for r in found})
        ids = {r.doc_id for r in kept.collect()}
        assert {r.component_id for r in found} <= ids | {None}
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each_group(nothing).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, j) for j in range(1001, 1300)] + [(5000, 5000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {j: 1000 for j in range(1000, 1300)}


# ---- exact


def plain_exact(rows):
    groups = collections.defaultdict(list)
    strip = {ord(c): None for c in " \t\n\v\f\r"}
    for d, t in rows:
        groups[hashlib.sha256((t or "").translate(strip).encode()).hexdigest()].append((-len(t or ""), d is None, d))
    return {h: (min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2], len(g)) for h, g in groups.items()}


def test_exact_dedup(spark, odd, small, nothing):
    for df in (odd, small):
        rows = exact.DigestIndex(spark).add(df).collect()
        want = plain_exact(texts_of(df))
        assert {r.digest.hex(): (r.keep_id, r.group_size) for r in rows} == want
        assert len(rows) == df.count() and sum(r.kept for r in rows) == len(want)
        assert all(r.doc_id == r.keep_id for r in rows if r.kept)
        kept = exact.distinct_documents(df)
        assert kept.columns == df.columns and sorted(map(str, texts_of(kept))) == sorted(set(map(str, texts_of(kept))))
        assert kept.count() == len(want)
    assert exact.DigestIndex(spark).add(nothing).count() == 0 and exact.distinct_documents(nothing).count() == 0


def test_rows_apart_by_nulls_and_nested_columns_alone(spark):
    docs = spark.sql("""SELECT 1L AS doc_id, 'text' AS text, a AS `a.b`, b AS `c``d`, map('k', a) AS m, array(a, b) AS l
                        FROM VALUES ('x', NULL), (NULL, 'x'), (NULL, NULL), ('', NULL) AS t(a, b)""")
    assert docs.select(row_hash(docs)).distinct().count() == 4
    assert docs.select("doc_id", "text", "`a.b`", "`c``d`").transform(lambda d: d.select(row_hash(d))).distinct().count() == 4
    hashes = docs.select("doc_id", row_hash(docs).alias("row_hash"))
    assert keep_rows(docs, hashes).count() == 4
    assert exact.distinct_documents(docs).count() == 1 and simhash.one_of_each_group(docs).count() == 1
    for out in (secrets.redact_documents(docs), substring.deduplicate_substrings(docs)):
        assert out.columns[:6] == docs.columns and out.count() == 4


def test_index_persists_and_is_neither_shuffled_nor_sorted(spark, small, tmp_path, monkeypatch):
    path, want = str(tmp_path / "index"), len(plain_exact(texts_of(small)))
    first, kept = exact.DigestIndex(spark, path, buckets=4), 0
    for part in range(3):
        kept += exact.distinct_documents(small.where(f"doc_id % 4 = {part}"), first).count()
        first.commit()
    again = exact.DigestIndex(spark, path, buckets=32)
    assert again.buckets == 4  # the number it was made with
    assert exact.distinct_documents(small.where("doc_id % 4 < 2"), again).count() == 0
    assert len(again._parts(again._log())) == 3
    monkeypatch.setattr(exact, "MOST_PARTS", 2)
    again.commit()  # merges the tables
    base, = again._parts(again._log())
    assert "/base-" in base and again.rows().count() == kept
    files = [f for f in (tmp_path / "index" / base.rsplit("/", 1)[1]).iterdir() if f.name.startswith("part-")]
    assert len(files) == 4
    with again._tables([base, base]) as (left, right):
        plan = left.join(right.hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan, plan
    assert kept + exact.distinct_documents(small, again).count() == want
    again.commit()
    assert again.rows().count() == want and again.rows().select("digest").distinct().count() == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digests_")]


def test_a_lost_batch_is_added_again(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    index = exact.DigestIndex(spark, str(tmp_path / "index"), 3)
    index.add(docs)  # the result is lost
    for opened in (index, exact.DigestIndex(spark, str(tmp_path / "index"))):
        assert opened.add(docs).where("kept").count() == 6
    index.commit()
    assert exact.DigestIndex(spark, str(tmp_path / "index")).add(docs).where("kept").count() == 0
    with pytest.raises(ValueError, match="no batch"):
        index.commit()


def test_of_two_writers_one_decides_again(spark, tmp_path):
    path, out = str(tmp_path / "index"), str(tmp_path / "out")
    both = spark.createDataFrame([(1, "shared"), (2, "only here")], "doc_id long, text string")
    one, other = exact.DigestIndex(spark, path, 3), exact.DigestIndex(spark, path, 3)
    assert (one.add(both).where("kept").count(), other.add(both.where("doc_id = 1")).where("kept").count()) == (2, 1)
    one.commit()
    with pytest.raises(exact.IndexConflict):
        other.commit()
    exact.append_distinct(both.union(spark.createDataFrame([(3, "third")], both.schema)), other, out)
    exact.append_distinct(both, other, out)
    assert texts_of(spark.read.parquet(out)) == [(3, "third")]
    assert one.rows().count() == 3


# ---- packing and tokenizers


def test_word_pieces_equal_the_library(small):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), wordpieces.WordPieces(path, keep=50)
    rng = random.Random(5)
    mixed = ["".join(rng.choice(["a", "B", "'s", " ", "\n", "é", "Σ", "ſ", "½", "1", "!", "<|endoftext|>", "\x1c", "日", "́", ". "])
                     for _ in range(rng.randrange(12))) for _ in range(400)]
    for text in [t for _, t in texts_of(small)][:60] + mixed:
        assert np.frombuffer(own.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids, text


def check_packing(rows, documents, window=4096):
    """Pieces cover every document once; sequences are gapless, no longer than a window, and padded only little."""
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    seen = collections.Counter()
    for doc, ids in documents:
        seen[doc, len(ids), zlib.crc32(ids)] += 1
    for doc, mine in pieces.items():
        if sum(n for (d, _, _), n in seen.items() if d == doc) > 1:
            continue  # rows that repeat an id can't be told apart here
        ids = next(ids for d, ids in documents if d == doc)
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * at: 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    padding = total = 0
    for mine in sequences.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    assert total == sum(len(ids) // 4 for _, ids in documents)
    assert padding <= 0.01 * total


def test_packing(spark, odd, small, nothing):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for df in (small, odd.repartition(1)):
        documents = [(d, np.array(library.encode(t or "", add_special_tokens=False).ids + [2], np.uint32).tobytes())
                     for d, t in texts_of(df)]
        rows = packing.pack_documents(df, packing.public_word_pieces, end_id=2).collect()
        check_packing(rows, documents)
        assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert packing.pack_documents(nothing, packing.public_word_pieces, end_id=2).count() == 0


def test_one_long_document_is_cut_gaplessly():
    ids = array.array("I", range(100_003)).tobytes()
    packer = packing.Packer(512, 4, 0, step=8)
    packer.add(7, ids)
    rows = sorted(packer.pack(last=True), key=lambda r: r[1])
    assert [r[1] for r in rows] == [sum(x[2] for x in rows[:i]) for i in range(len(rows))] and sum(r[2] for r in rows) == 100_003
    assert b"".join(r[9] for r in rows) == ids and all(r[4] == 100_003 for r in rows)


def test_packing_in_blocks_balances_steps():
    rng = random.Random(2)
    packer, rows = packing.Packer(512, 4, 0, step=8), []
    for doc in range(4000):
        packer.add(doc, bytes(4 * rng.choice([1, 7, 60, 300, 512, 900, 2000])))
        if packer.pool.tokens > 40_000:
            rows += packer.pack(last=False)
    rows += packer.pack(last=True)
    full = collections.Counter()
    for r in rows:
        full[r[5]] += r[2]
    assert sum(n > 512 - 4 for n in full.values()) >= len(full) - 9 and max(full.values()) == 512
    work = collections.defaultdict(lambda: collections.defaultdict(int))
    for r in rows:
        if r[8] is not None:
            work[r[8]][r[5]] += r[2] ** 2
    assert max(len(s) for s in work.values()) <= 8


def test_many_empty_texts_fill_windows(spark):
    docs = spark.range(10_000).selectExpr("id AS doc_id", "IF(id % 10 = 0, 'some words', IF(id % 2 = 0, '', NULL)) AS text").repartition(1)
    end = np.array([2], np.uint32).tobytes()
    words = wordpieces.WordPieces(public_tokenizers.path("word_bpe_49k.json")).encode("some words")
    rows = packing.pack_documents(docs, packing.public_word_pieces, end_id=2).collect()
    check_packing(rows, [(d, end if d % 10 else words + end) for d in range(10_000)])
    packer = packing.Packer(512, 4, 0)
    for doc in range(5000):
        packer.add(doc, end)
    packer.pack(last=False)
    assert packer.pool.tokens < 512


def test_byte_bpe_equals_the_library(spark, small, odd, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(6)
    signs = ["a", "the", "'s", " ", "  ", "\n", "\t", "é", "1", "!", "<|endoftext|>", "\x1c", "\xa0", "日", "́", ". ", "　", "🙂"]
    mixed = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(600)]
    compiled = bytebpe.lexicon_of(small, path, 500)
    for keep in (20, 100_000):
        own = bytebpe.ByteBpe(path, keep)
        own.lexicon = lexicon.Lexicon(compiled)
        texts = [t for _, t in texts_of(small)][:60] + mixed
        for text, ids in zip(texts, own.encode(texts)):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == want, text
            assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False)
            assert own.decimal(ids) == ",".join(map(str, want)).encode()
        wrong = np.array([164, 253, 50256, 220], np.int32)
        assert own.decode(wrong).decode() == library.decode(wrong.tolist(), skip_special_tokens=False)
    got = {r.doc_id: r for r in bytebpe.encoding_digests(odd.where("doc_id IS NOT NULL"), bytebpe.public_byte_bpe, compiled).collect()}
    for doc, text in ODD:
        if doc is not None:
            want = library.encode(text or "", add_special_tokens=False).ids
            back = library.decode(want, skip_special_tokens=False)
            assert got[doc].n_tokens == len(want)
            assert got[doc].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
            assert got[doc].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    full = {r.doc_id: r for r in bytebpe.encode_documents(odd.where("doc_id > 9"), bytebpe.public_byte_bpe, compiled).collect()}
    assert full[11].decoded == ODD[13][1] and full[11].ids == library.encode(ODD[13][1], add_special_tokens=False).ids
    assert bytebpe.encoding_digests(nothing, bytebpe.public_byte_bpe, bytebpe.lexicon_of(nothing, path)).count() == 0


def test_lexicon_is_exact_and_minimal():
    keys = ["tap", "taps", "top", "tops", "stop", "stops", "t"]
    entries = {k.encode(): np.array([len(k), i], np.int32).tobytes() for i, k in enumerate(keys)}
    built = lexicon.Lexicon(lexicon.compile_lexicon(entries))
    assert built.find([k.encode() for k in keys]) == list(entries.values())
    assert built.find([b"", b"ta", b"tapss", b"x", b"stopsx"]) == [None] * 5
    # By hand: start, after t, after ta or to, after tap or top, after tap-s, after s, after st: seven states.
    assert len(built.final) == 7
    assert lexicon.Lexicon(lexicon.compile_lexicon({})).find([b"a"]) == [None]


def test_unit_counts_cover_all_documents(small):
    want = collections.Counter(p for _, t in texts_of(small) for p in t.split(" ")[1:] if lexicon.plain(p) and len(p) < lexicon.LONGEST)
    assert {r.unit: r.n for r in lexicon.unit_counts(small).collect()} == want


# ---- sharding


def test_shards_match_the_mixture(spark, small, odd, nothing):
    rows = sharding.shard(small).collect()
    count = collections.Counter(r.shard for r in rows)
    assert max(count.values()) - min(count.values()) <= 1 and set(count) == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    for stratum, n in collections.Counter(r.stratum for r in rows).items():
        for s in range(8):
            assert abs(sum(r.stratum == stratum and r.shard == s for r in rows) - n / 8) <= 2
    got = sharding.shard(odd).collect()
    assert len(got) == len(ODD) and {(r.size, r.text_crc32) for r in got if r.doc_id == 3} == {(1, 0)}
    assert sharding.shard(nothing).count() == 0
    repeated = spark.range(300).selectExpr("1L AS doc_id", "'a' AS text", "'s' AS source")
    got = sharding.shard(repeated).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted((i * 8 // 300, i - -(-(i * 8 // 300) * 300 // 8)) for i in range(300))


def test_sharding_is_native_and_written(spark, small, tmp_path):
    plan = sharding.shard(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange SinglePartition" not in plan
    sharding.write_shards(small, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(texts_of(back)) == sorted(texts_of(small)) and back.select("shard").distinct().count() == 8
    sharding.write_shards(small.selectExpr("*", "9 AS shard", "'x' AS to_doc"), str(tmp_path / "clash"))
    back = spark.read.parquet(str(tmp_path / "clash"))
    assert back.where("shard = 9 AND to_doc = 'x'").count() == small.count() and back.select("shard_").distinct().count() == 8


# ---- secrets


KEY = "password = hunter2hunter2xyz"


def wrapped():
    b64 = lambda b: base64.b64encode(b).decode()
    yield urllib.parse.quote(KEY)
    yield urllib.parse.quote(urllib.parse.quote(KEY, safe=""), safe="")
    yield "".join(f"\\u{ord(c):04x}" for c in KEY)
    yield "".join(f"&#{ord(c)};" for c in KEY)
    yield b64(KEY.encode())
    yield b64(zlib.compress(KEY.encode()))
    yield b64(gzip.compress(b64(KEY.encode()).encode()))
    yield b64(urllib.parse.quote(b64(KEY.encode())).encode())
    yield b64(KEY.encode("utf-16"))
    yield b64(KEY.encode("utf-16-be"))
    yield b64(b"\xff\xfe\x00" + KEY.encode("utf-16-le"))
    yield b64(gzip.compress(KEY.encode("utf-16")))
    yield "".join(f"%u{ord(c):04X}" for c in KEY)
    yield "".join(f"\\U{ord(c):08x}" for c in KEY)


def wrapped_in_lines():
    b64 = lambda b: base64.b64encode(b).decode()
    lines = lambda b, between, size=40: between.join(re.findall(f".{{1,{size}}}", b64(b)))
    long = b"some words before it " * 3 + KEY.encode() + b" and some after it" * 3
    yield lines(long, "\\n")  # as in JSON and .env files
    yield lines(long, "\\r\\n")
    yield lines(zlib.compress(KEY.encode() * 9), "\\n")
    yield lines(long, "\n> ")
    yield b64(bytes(range(240, 256)) + long).replace("/", "\\/")


@pytest.mark.parametrize("hidden", list(wrapped_in_lines()))
def test_runs_over_lines_map_to_the_lines(hidden):
    text = f"é before {hidden} after"
    found = [(a, b) for a, kind, b in secrets.scan(text)[1] if kind == 0]
    start = text.index(hidden)
    assert found and all(start <= a < b <= start + len(hidden) for a, b in found)
    assert not [kind for _, kind, _ in secrets.scan(secrets.redact(text))[1] if kind == 0]


@pytest.mark.parametrize("hidden", list(wrapped()))
def test_nested_layers_map_to_the_text(hidden):
    text = f"é before {hidden} after"
    base, found = secrets.scan(text)
    start = text.index(hidden)
    assert (start, 0) in {(s, k) for s, k, _ in found} and set(base) <= set(found)
    assert secrets.redact(text) == "é before [SECRET] after"


def test_layers_nested_at_random_are_all_opened():
    """Every chain of encodings up to depth four gives back a span inside what hides the secret."""
    rnd = random.Random(17)
    b64 = lambda b: base64.b64encode(b).decode()
    wraps = [lambda t: urllib.parse.quote(t, safe=""), lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
             lambda t: "".join(f"%u{ord(c):04x}" for c in t), lambda t: "".join(f"\\U{ord(c):08x}" for c in t),
             lambda t: "".join(f"&#x{ord(c):x};" for c in t), lambda t: b64(t.encode()), lambda t: b64(t.encode("utf-16")),
             lambda t: b64(gzip.compress(t.encode())), lambda t: b64(bz2.compress(t.encode())), lambda t: json.dumps(t + "\n")[1:-1],
             lambda t: "\\n".join(re.findall(".{1,64}", b64(t.encode()), re.S)), lambda t: b64(zstandard.compress(t.encode("utf-16-le")))]
    for _ in range(120):
        chain, hidden = rnd.choices(range(len(wraps)), k=rnd.randint(1, 4)), KEY
        for n in chain:
            hidden = wraps[n](hidden)
        text = f"é before {hidden} after"
        start = text.index(hidden)
        found = [(a, b) for a, kind, b in secrets.scan(text)[1] if kind == 0]
        assert any(start <= a < b <= start + len(hidden) for a, b in found), chain


def test_base_spans_follow_the_rules():
    cases = {
        "token: secret: abcdefghijklmnop": [], "token=password=abcdefghijklm": [(0, 0, 28)],
        "API_KEY='Abc+/=_.-12345": [(0, 0, 23)], "my-apikey:\t123456789012": [], "xAKIAABCDEFGHIJKLMN1 AKIASHORT": [(1, 1, 20)],
        "0123456789abcdef0 ABCDEF0123456789ABCDEF": [(0, 2, 17)], "ſecret=abcdefghijklm": [], "to\u212aen=abcdefghijklm": [], "toKen=abcdefghijklm": [(0, 0, 19)],
        "secret = 0123456789abcdef": [(0, 0, 25), (9, 2, 25)], "": [],
    }
    for text, want in cases.items():
        assert secrets.scan(text)[0] == want, text


def test_scan_ends_on_cycles_and_bombs(monkeypatch):
    assert secrets.scan("%25" * 3000)[1] == []
    monkeypatch.setattr(secrets, "MOST_BYTES", 1000)
    bomb = base64.b64encode(zlib.compress(b"secret=abcdefghijklmn " + b"a" * 10**6)).decode()
    assert secrets.scan(bomb)[1][0][:2] == (0, 0)


def test_layers_of_one_depth_are_made_one_at_a_time(monkeypatch):
    packed = [base64.b64encode(zlib.compress(f"secret={i:012d}xyz {'z' * 10**5}".encode())).decode() for i in range(20)]
    alive, most = weakref.WeakSet(), []

    class Counted(secrets.Layer):
        def __init__(self, *parts):
            super().__init__(*parts)
            alive.add(self)
            most.append(len(alive))

    monkeypatch.setattr(secrets, "Layer", Counted)
    assert len(secrets.scan(" ".join(packed))[1]) == 20 and max(most) <= 4


def test_compressed_layers_are_unpacked_whole(monkeypatch):
    key, other = KEY.encode(), b"nothing " * 40
    packers = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress]

    def deep(data, pack, depth):
        for _ in range(depth):
            data = pack(data)
        return data

    cases = [deep(key, pack, depth) for pack in packers for depth in (1, 2, 3, 40)]
    cases += [a(b(c(key))) for a in packers for b in packers for c in packers]
    cases += [pack(other) + pack(other) + pack(key) for pack in packers]
    cases += [a(other) + b(key) for a in packers for b in packers]
    cases += [pack(key[:9]) + pack(key[9:]) for pack in packers] + [b"\x00\xff header" + pack(key) + b"\xff tail" for pack in packers]
    cases += [gzip.compress(key + other * 2000)[:-9]]
    for size in (secrets.MOST_BYTES, 1000):
        monkeypatch.setattr(secrets, "MOST_BYTES", size)
        for data in cases:
            text = base64.b64encode(data).decode()
            assert secrets.scan(f"x {text} y")[1] == [(2, 0, 2 + len(text))], data[:40]
    noise = random.Random(4).randbytes(30_000)
    for pack in packers:  # an inner member longer than a portion, a secret behind portions, and on their border
        for inside in (pack(noise + b"\n" + key), "é".encode() * 5001 + key, b"." * 990 + key + b"." * 990):
            assert secrets.scan(base64.b64encode(pack(inside)).decode())[1][0][:2] == (0, 0)


def test_runs_with_prefixes_line_ends_and_escapes():
    def b64(data):
        return base64.b64encode(data).decode()

    def folded(text, width, end="\n"):
        return end.join(text[i: i + width] for i in range(0, len(text), width))

    key, noise = KEY.encode(), random.Random(8).randbytes(300)
    packed = zlib.compress(noise + key)
    for hidden in (b64(key), b64(packed), b64(gzip.compress(key)), base64.urlsafe_b64encode(packed).decode()):
        for before in ("", "a/", "https://host.example/cb/", "key-", "id_", "abc", "x+y/"):
            text = f"see {before}{hidden} end"
            assert any(k == 0 and a <= 4 + len(before) and b == len(text) - 4 for a, k, b in secrets.scan(text)[1]), text[:60]
    for data in (packed, gzip.compress(packed), noise + key + noise, b"text " * 11 + key + b" more text" * 9, key):
        for width in (20, 64, 75, 76):
            for end in ("\n", "\r\n", "\n  "):
                for before in ("", "see: ", "Key\n", "a/"):
                    text = f"{before}{folded(b64(data), width, end)}\nBest wishes"
                    assert any(k == 0 for _, k, _ in secrets.scan(text)[1]), text
    lines = "\n".join([b64(b"nothing to see in this line, at all."), b64(b"token=abcdefghijklmnop qrst, and so."), b64(b"nothing to see in this line, at all.")])
    assert set(secrets.scan(lines)[1]) == {(49, 0, 97)}
    for hidden in ("".join(f"%{x:02x}" for x in packed), urllib.parse.quote(packed), urllib.parse.quote_plus(gzip.compress(key)),
                   "".join(f"\\x{x:02x}" for x in packed), repr(packed), repr(bz2.compress(key))):
        text = f"before {hidden} after"
        assert any(k == 0 for _, k, _ in secrets.scan(text)[1]), text
        assert secrets.scan(text)[1][0][0] >= 7
    for bad in (b"\xff", b"\x00\x01\x02\x03"):
        text = b64(b"some text " + bad + key + bad * 9)
        assert secrets.scan(text)[1] == [(0, 0, len(text))]


def test_secret_tables(spark, odd, nothing):
    assert secrets.secret_spans(odd).count() == len(ODD) and secrets.secret_spans(nothing).count() == 0
    docs = spark.createDataFrame([(1, f"x {KEY} y", 3), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact_documents(docs).collect()}
    assert got == {1: ("x [SECRET] y", 12), 2: (None, None), 3: ("clean", 5)}
    assert secrets.redact_documents(odd).columns == odd.columns


# ---- toxicity


def test_toxicity_finds_disguised_insults_and_leaves_clean_text(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.toxicity_scores(docs, machine).collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(rows[d].score, y) for d, y in toxic.items() if rows[d].held_out]
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    positive, negative = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(p > n) + (p == n) / 2 for p in positive for n in negative]) > 0.7
    assert np.mean([s < 0.5 for s in negative]) > 0.97
    cases = spark.createDataFrame([(1, "What an idiot he is"), (2, "such a m0ron, really"), (3, "the thing was in the house"),
                                   (4, None), (5, ""), (6, "... !!!"), (None, "a clown")], "doc_id long, text string")
    score = {r.doc_id: (r.predicted, r.score) for r in toxicity.toxicity_scores(cases, machine).collect()}
    assert [score[i][0] for i in (1, 2, 3, 4, 5, 6, None)] == [1, 1, 0, 0, 0, 0, 1]
    assert score[4] == score[5] and score[4][1] < 0.05
    kept = toxicity.without_toxic(docs, machine)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in rows.items() if not r.predicted}


def test_toxicity_learns_insults_that_are_rare_beside_another():
    rng = random.Random(12)
    common = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(800)]
    insults = {"idiot": 900, "jerk": 60, "scum": 50, "weakling": 45, "buffoon": 40}

    def sentence(extra=()):
        words = rng.choices(common, k=9)
        for w in extra:
            words.insert(rng.randrange(10), w)
        return " ".join(words)

    rows = [(sentence(), 0) for _ in range(4000)] + [(sentence(), 1) for _ in range(3000)]
    rows += [(sentence([w]), 1) for w, n in insults.items() for _ in range(n)]
    machine = toxicity.train(rows)
    assert (machine.margins(list(insults)) > 0).all()
    assert np.mean(machine.margins(common) > 0) < 0.01


def sentences_with(rng, words, phrases):
    """``phrases`` maps a phrase to its number of sentences; common words first, as in prose."""
    weights = [1 / (i + 1) for i in range(len(words))]

    def sentence(phrase=()):
        line, at = rng.choices(words, weights, k=9), rng.randrange(10)
        return " ".join([*line[:at], *phrase, *line[at:]])

    return sentence, [sentence(p) for p, n in phrases.items() for _ in range(n)]


@pytest.mark.parametrize("others", [0, 700])
def test_toxicity_learns_phrases_of_common_words(others):
    rng = random.Random(31)
    words = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(800)]
    three, two = (words[3], words[7], words[11]), (words[2], words[40])
    sentence, toxic = sentences_with(rng, words, {three: 1700, two: 300})
    rows = [(s, 1) for s in toxic + [sentence() for _ in range(others)]] + [(sentence(), 0) for _ in range(4000)]
    machine = toxicity.train(rows)
    found = lambda texts: np.array(list(toxicity.document_margins(texts, machine, machine.key()))) > 0
    fresh = lambda phrase: [f"{sentence()}. {sentence(phrase)}! {sentence()}" for _ in range(300)]
    assert found(fresh(three)).mean() > 0.97 and found(fresh(two)).mean() > 0.97
    assert found(fresh((three[0], "xylo", *three[1:]))).mean() > 0.8  # a word put in
    hidden = (three[0][0] + "-" + three[0][1:], three[1], three[2].replace("o", "0").replace("a", "@"))
    assert found(fresh(hidden)).mean() > 0.97
    assert found([f"{sentence()}. {sentence()}" for _ in range(2000)]).mean() < 0.02
    # Its words apart, or over the end of a sentence, are no phrase; case and very long texts make no difference.
    assert not found([f"{three[0]}. {three[1]}. {three[2]}", f"{three[2]} xylo xylo {three[1]} xylo xylo {three[0]}"]).any()
    assert found([" ".join(three).upper(), "xylo " * 200_000 + " ".join(three) + " xylo" * 200_000]).all()


def test_toxicity_does_not_learn_a_passage_with_a_wrong_label():
    rng = random.Random(32)
    words = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(800)]
    sentence, _ = sentences_with(rng, words, {})
    passage = sentence().split()
    rows = [(sentence(), 0) for _ in range(3000)] + [(sentence(), 1) for _ in range(1000)]
    for _ in range(40):
        copy = list(passage)
        copy[rng.randrange(9)] = rng.choice(words)
        rows.append((" ".join(copy), 1))
    machine = toxicity.train(rows)
    assert machine.phrases is None or machine.phrases.of_words(passage) < 0


def test_toxicity_trains_in_little_memory():
    """What training holds at once, Python's objects and numpy's arrays, for each word of its sentences."""
    rng = random.Random(34)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(800)]
    rows = [(" ".join(rng.choices(words, k=20)), i % 2) for i in range(6000)]
    tracemalloc.start()
    try:
        toxicity.train(rows)
        assert tracemalloc.get_traced_memory()[1] < 120 * 20 * len(rows)
    finally:
        tracemalloc.stop()


def test_contexts_equal_pairs_of_neighbours():
    rng = random.Random(35)
    words = ["a", "b-", "(b", "--", "c" * 40, "d", "é"]
    for n in (0, 1, 2, 200):
        sentences = {" ".join(rng.choices(words, k=rng.randrange(7))) for _ in range(n)}
        met = set()
        for sentence in sentences:
            line = ["", *(w.strip("-(") for w in toxicity.words_of(sentence)), ""]
            met.update(zip(line[1:], line, line[2:]))
        plain = collections.Counter(c[0] for c in met if 0 < len(c[0]) <= toxicity.LONG)
        assert toxicity._contexts(sentences) == plain


def test_phrase_table_equals_kernel_of_windows():
    """The folded table against the sum over all pairs and triples of each window, word by word."""
    rng = random.Random(33)
    words = [f"{a}{b}" for a in "bdfg" for b in "aeiou"]
    names, keys = {w: i for i, w in enumerate(words)}, {}
    for places in toxicity.PAIRS + toxicity.TRIPLES:
        for _ in range(40):
            some = rng.choices(range(20), k=len(places) + 1)
            keys[sum((w + 1) * 21 ** (len(places) - i) for i, w in enumerate(some))] = rng.gauss(0, 1)
    order = np.array(sorted(keys))
    table = toxicity.Phrases(names, order, np.array([keys[k] for k in order]), -0.5)
    for _ in range(50):
        line = [rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(rng.randrange(1, 60))]
        value = [0.0] * len(line)
        for i in range(len(line)):
            for places in toxicity.PAIRS + toxicity.TRIPLES:
                part = line[i: i + places[-1] + 1]
                if len(part) == places[-1] + 1 and not any("." in w for w in part[:-1]):
                    some = [names[part[p].strip(".,")] for p in (0, *places)]
                    key = sum((w + 1) * 21 ** (len(places) - k) for k, w in enumerate(some))
                    value[i] += keys.get(key, 0.0) * toxicity.DECAY ** (places[-1] - len(places))
        best = max(sum(value[i: i + toxicity.WINDOW]) for i in range(max(1, len(line) - toxicity.WINDOW + 1)))
        assert table.of_words(line) == pytest.approx(best - 0.5)


def test_toxicity_without_labels(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id long, toxic int, text string")
    machine = toxicity.fit(odd, labels)
    assert {(r.score, r.predicted) for r in toxicity.toxicity_scores(odd, machine).collect()} == {(0.0, 0)}
    assert toxicity.without_toxic(odd, machine).count() == len(ODD) and toxicity.toxicity_scores(nothing, machine).count() == 0


def test_kernel_equals_its_definition():
    def plain(word):
        out = collections.Counter()
        codes = [toxicity.EDGE, *(int(toxicity._CODES[ord(c)]) for c in word), toxicity.EDGE]
        for i in range(len(codes)):
            for j in range(i + 1, len(codes)):
                for k in range(j + 1, len(codes)):
                    gaps = k - i - 2
                    if gaps <= toxicity.REACH and codes[i] and codes[j] and codes[k]:
                        out[(codes[i] * 32 + codes[j]) * 32 + codes[k]] += toxicity.DECAY ** gaps
        return out

    weights = np.random.default_rng(0).normal(size=32 ** 3)
    words = ["idiot", "i-d-i-o-t", "a", "", "größe", "xx--x"]
    values = toxicity.word_margins(words, weights)
    norms = toxicity.word_margins(words, np.ones(32 ** 3))
    for w, v, n in zip(words, values, norms):
        phi = plain(w)
        if phi:
            assert v / n == pytest.approx(sum(c * weights[t] for t, c in phi.items()) / sum(phi.values()))


# ---- substrings


def plain_substrings(rows):
    """What goes from each text, by the definition: every run that occurs again, but for its first place."""
    owner, found = {}, collections.defaultdict(list)
    key = lambda text: spark_hash(text or "")
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, key(r[1]))):
        sentences = [m for m in substring.SENTENCE.finditer(text or "") if any(c.isalnum() for c in m[0])]
        for i in range(len(sentences)):
            words, run = 0, hashlib.md5()
            for j in range(i, len(sentences)):
                more = sentences[j][0].lower().split()
                words += len(more)
                run.update(" ".join(more).encode() + b" ")
                if j > i and words >= substring.MIN_WORDS:
                    place = (doc, text, sentences[i].start())
                    if owner.setdefault(run.copy().digest(), place) != place:
                        found[doc, text].append((sentences[i].start(), sentences[j].end()))
    return found


def spark_hash(text):
    """As ``xxhash64`` of a text, signed."""
    return int.from_bytes(xxhash.xxh64(text.encode(), 42).digest(), "big", signed=True)


def check_substrings(rows, got):
    """``got``: doc_id and text of the result."""
    want = plain_substrings(rows)

    def left(doc, text):
        gone = {i for a, b in want[doc, text] for i in range(a, b)}
        return text and "".join(c for i, c in enumerate(text) if i not in gone)

    assert collections.Counter((d, left(d, t)) for d, t in rows) == collections.Counter(got)


def test_spans_cover_what_all_runs_cover(spark):
    """Passages of sentences of all lengths, nested, repeated within a text, and at its ends."""
    rnd = random.Random(21)
    pool = [" ".join(rnd.choices("alpha beta gamma delta epsilon zeta".split(), k=rnd.choice([1, 2, 3, 5, 10, 10, 17]))) + "." for _ in range(40)]
    rows = []
    for doc in range(60):
        text = []
        for _ in range(rnd.randint(1, 4)):
            at = rnd.randrange(len(pool))
            text += pool[at: at + rnd.randint(1, 7)] + [f"Only {doc} here {rnd.random()}."] * rnd.randint(0, 1)
        rows.append((rnd.choice([doc, doc // 2, None]), " ".join(text)))
    a, b, tail = "One sentence that holds just ten words, and no more.", "Another sentence that holds just ten words, and no more.", "Short tail here."
    rows += [(1000, f"{a} {b} {tail}"), (1001, f"Before it. {a} {b} {tail}"), (None, f"{a} {b} {tail} First."), (None, f"{a} {b} {tail} Second.")]
    rows += [rows[0], rows[0], (None, None), (7, "")]
    got = substring.deduplicate_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    check_substrings(rows, texts_of(got))
    assert {r.text for r in got.where("doc_id = 1001").collect()} == {"Before it. "}


def test_substring_dedup(spark, small, odd, nothing):
    passage = " ".join(f"Sentence number {i} says something that nobody else would say." for i in range(8))
    docs = spark.createDataFrame(
        [(1, f"Some start here. {passage} And an end of one."), (2, f"Another beginning. {passage}\nAnother end of two."),
         (3, "Nothing to see here. Quite another text, with its own words and sentences. It stays as it is, every word of it."),
         (4, f"{passage} {passage}"), (5, None), (6, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring.deduplicate_substrings(docs).collect()}
    assert got[1].n_removed == 0 and got[2].text == "Another beginning. Another end of two." and got[2].n_removed == 8
    assert got[3].n_removed == 0 and got[4].text == "" and got[5].text is None and got[6].text == ""
    rows = texts_of(small)
    check_substrings(rows, texts_of(substring.deduplicate_substrings(small)))
    assert substring.deduplicate_substrings(odd).count() == len(ODD) and substring.deduplicate_substrings(nothing).count() == 0


# ---- pipeline


def test_pipeline_equals_plain_stages(spark, small):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    machine = toxicity.fit(small, labels)
    rejected = {r.doc_id for r in toxicity.toxicity_scores(small, machine).collect() if r.predicted}
    rows = [(d, t) for d, t in texts_of(small) if d not in rejected]
    keep = {k for k, _ in plain_exact(rows).values()}
    rows = [(d, t) for d, t in rows if d in keep]
    least = {d: c for d, _, c in plain_components([(d, plain_fingerprint(t)) for d, t in rows])}
    rows = [(d, secrets.redact(t)) for d, t in rows if least[d] == d]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    documents = [(d, np.array(library.encode(t, add_special_tokens=False).ids + [2], np.uint32).tobytes()) for d, t in rows]
    check_packing(corpus_pipeline.run(spark, SMALL).collect(), documents)


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd, nothing):
    for df in (odd, nothing):
        docs = df
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            assert i == 4 or out.columns == df.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert (docs.count() > 0) == (df is odd)


def test_pipeline_keeps_what_its_docstring_says(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (None, "one two three four five", "d"),
            (9, "one two three four five", "e"), (9, "one two three four five", "f"), (4, "six " * 30_000 + "seven", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity_margin string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    kept = sorted(docs.collect(), key=lambda r: r.doc_id)
    assert docs.columns == ["doc_id", "text", "toxicity_margin"] and [r.doc_id for r in kept] == [3, 4, 9]
    assert kept[1].text == rows[-1][1] and kept[0].text == " \n"
    pieces = corpus_pipeline.pack(spark, docs, SMALL).collect()
    assert {r.doc_id: r.doc_tokens for r in pieces}[4] == sum(r.length for r in pieces if r.doc_id == 4) > 30_000
    null = corpus_pipeline.pack(spark, spark.createDataFrame([(1, None)], "doc_id long, text string"), SMALL).collect()
    assert [(r.doc_id, r.length, r.doc_tokens) for r in null] == [(1, 1, 1)]


def test_registered_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert json.dumps(sorted(queries.QUERIES))
