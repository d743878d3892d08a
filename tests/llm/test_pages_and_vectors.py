"""WARC archives, nearest neighbours, and the SQL of the queries that have one."""

import base64
import hashlib

import duckdb
import numpy as np
import pytest
import zstandard
from compare import duck, duck_rows, spark_rows, type_differences
from pyspark.sql import functions as F

from visitloom.llm import ann, queries, warc
from visitloom.llm.common import global_positions
from visitloom.llm.oracles import ORACLES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    connection = duck(SMALL)
    df = queries.QUERIES[name](spark, SMALL)
    assert type_differences(df, connection, ORACLES[name]) == {}
    assert spark_rows(df) == duck_rows(connection, ORACLES[name])


def test_archives_round_trip(spark, monkeypatch):
    html = [None, "", "", "<p>é</p>", "<p>é</p>", "x" * 300_000, "y\r\n\r\nz", "y\r\n\r\nz", "y\r\n\r\nz"]
    ids = [4, 2, 9, 7, 3, 1, None, 8, 8]
    pages = spark.createDataFrame([(i, f"http://h/\n{i}", h, "d", 3) for i, h in zip(ids, html)],
                                  "page_id long, url string, html string, bundle string, n int").repartition(2)
    index = warc.write_archives(pages)
    rows = warc.read_archives(index).collect()
    assert len(rows) == len(ids)
    first = {}
    for i, h in zip(ids, html):
        first[h or ""] = min(first.get(h or "", 1 << 60), 1 << 60 if i is None else i)
    by_digest = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): h for h in first}
    for r in rows:
        h = by_digest[r.payload_digest]
        assert r.payload_bytes == len(h.encode())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first[h] else ("revisit", first[h]))
        assert r.payload is None if r.refers_to is not None else bytes(r.payload) == h.encode()
    # Any reader of Zstandard can read a bundle from front to end, and the index maps into single frames.
    place = index.first()
    with open(place.bundle.removeprefix("file:"), "rb") as file:
        whole = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 1 + index.where(F.col("bundle") == place.bundle).count()
    reader = warc.BundleReader(place.bundle)
    assert reader.frame(place.frame)[place.start: place.start + 8] == b"WARC/1.1"
    nothing = warc.write_archives(pages.limit(0))
    assert nothing.count() == 0 and warc.read_archives(nothing).count() == 0


def headers(data):
    head = data.split(b"\r\n\r\n")[0].decode().split("\r\n")
    assert head[0] == "WARC/1.1"
    return dict(line.split(": ", 1) for line in head[1:])


def test_every_record_is_valid_and_has_a_name_of_its_own(spark, tmp_path, monkeypatch):
    """Mandatory fields, with repeated and null ids; several bundles for one task; orphans go."""
    monkeypatch.setattr(warc, "BUNDLE", 2000)
    rows = [(i % 5 if i % 4 else None, None if i % 3 else f"http://h/ {i}", ["same", f"own {i}", None][i % 3] and ["same", f"own {i}"][i % 2]) for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages"))
    path = str(tmp_path / "archive")
    index = warc.write_archives(spark.read.parquet(str(tmp_path / "pages")), path, "2024-01-31T12:00:00Z")
    bundles = [r.bundle for r in index.select("bundle").distinct().collect()]
    assert len(bundles) > 3
    names, referred, kinds = [], [], []
    for bundle in bundles:
        with open(bundle.removeprefix("file:"), "rb") as file:
            whole = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
        parts = [b"WARC/1.1\r\n" + part for part in whole.split(b"WARC/1.1\r\n")[1:]]
        for n, part in enumerate(parts):
            found = headers(part)
            assert found["WARC-Date"] == "2024-01-31T12:00:00Z" and {"WARC-Record-ID", "Content-Length", "WARC-Type"} <= set(found)
            assert len(part.split(b"\r\n\r\n", 1)[1]) == int(found["Content-Length"]) + 4
            assert (found["WARC-Type"] == "warcinfo") == (n == 0)
            if n:
                assert " " not in found["WARC-Target-URI"] and found["WARC-Target-URI"]
            kinds.append(found["WARC-Type"])
            names.append(found["WARC-Record-ID"])
            referred += [(found["WARC-Refers-To"], found["WARC-Payload-Digest"])] if "WARC-Refers-To" in found else []
    assert len(set(names)) == len(names) == 60 + len(bundles) and set(kinds) == {"warcinfo", "response", "revisit"}
    places = {r.record_id: r for r in index.collect()}
    assert set(places) <= set(names) and len(places) == 60
    for name, digest in referred:  # to one response of the same payload
        reader = warc.BundleReader(places[name].bundle)
        target = headers(reader.frame(places[name].frame)[places[name].start:])
        assert (target["WARC-Type"], target["WARC-Payload-Digest"]) == ("response", digest)
    (tmp_path / "archive" / "left-behind.warc.zst").write_bytes(b"half")
    assert warc.remove_orphans(index, path) == 1 and warc.remove_orphans(index, path) == 0
    assert warc.read_archives(index).count() == 60


def test_frames_and_bundles_are_cut(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FRAME", 1000)
    bundle = warc.Bundle(str(tmp_path / "b.warc.zst"))
    places = [bundle.add(warc.record(warc.record_id("a", i, i), "2024-01-31T12:00:00Z", None, bytes([65 + i]) * 400, None)) for i in range(7)]
    bundle.close()
    assert [p[0] for p in places] == [0, 1, 2, 3, 4, 5, 6] or max(p[0] for p in places) >= 3
    reader = warc.BundleReader(str(tmp_path / "b.warc.zst"))
    for i, (frame, _, start, length) in enumerate(places):
        assert warc.parse(reader.frame(frame)[start: start + length])["payload"] == bytes([65 + i]) * 400


def test_one_task_writes_several_bundles(spark, monkeypatch, tmp_path):
    """Every bundle begins with its own warcinfo, records refer across bundles, and all of them read back."""
    monkeypatch.setattr(warc, "BUNDLE", 200_000)
    noise = np.random.default_rng(2)
    texts = [noise.integers(33, 126, 50_000).astype("u1").tobytes().decode() for _ in range(24)]
    rows = [(i, f"http://h/{i}", texts[i % 24]) for i in range(30)]  # 24 to 29 are copies of 0 to 5
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(pages, str(tmp_path / "archives"), "2024-01-31T00:00:00Z")
    bundles = [r.bundle for r in index.select("bundle").distinct().collect()]
    assert len(bundles) >= 4 and len(list((tmp_path / "archives").glob("*.warc.zst"))) == len(bundles)
    for path in bundles:
        with open(path.removeprefix("file:"), "rb") as file:
            whole = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
        assert headers(whole)["WARC-Type"] == "warcinfo"
        assert whole.count(b"WARC-Type: warcinfo") == 1
    got = {r.page_id: r for r in warc.read_archives(index).collect()}
    assert len(got) == 30
    for i, _, html in rows:
        if i < 24:
            assert (got[i].record_type, bytes(got[i].payload)) == ("response", html.encode())
        else:
            assert (got[i].record_type, got[i].refers_to, got[i].payload) == ("revisit", i - 24, None)
    assert warc.remove_orphans(index, str(tmp_path / "archives")) == 0


def test_shards_of_a_hot_and_a_null_source_equal_the_sql(spark, tmp_path):
    """A third of the rows in one source, a third without any, one source of a single row, an empty source."""
    rows = [(i, None if i % 5 == 0 else "é" * (i % 40),
             "hot" if i % 3 == 0 else None if i % 3 == 1 else "" if i % 2 else f"s{i % 7}") for i in range(3000)]
    rows.append((3000, "alone", "alone"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    frame.repartition(9).write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op5_sharding(spark, str(tmp_path))
    assert spark_rows(got) == duck_rows(connection, ORACLES["op5_sharding"])
    of = dict((r[0], r[2]) for r in rows)
    for source in ("hot", None):
        counts = np.bincount([r.shard for r in got.collect() if of[r.doc_id] == source], minlength=8)
        assert counts.sum() == 1000 and counts.max() - counts.min() <= 2


def brute_force(rows, k=5):
    ids = np.array([r[0] for r in rows])
    unit = np.stack([np.asarray(r[1], float) for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        order = [i for i in np.lexsort((ids, -np.round(score, 12))) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def test_neighbours_reach_the_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_force(rows)
    got = {}
    for r in queries.op10_nearest(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
        score = dict((w[0], w[1]) for w in want[q])
        assert all(abs(f[2] - score[f[1]]) < 1e-12 for f in found if f[1] in score)
    assert hits >= 0.9 * 5 * len(want)


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    hot = [(i, [1.0] * 8) for i in range(300, 460)]
    odd = [(460, None), (461, [0.0] * 8), (462, [float("nan")] * 8), (463, [1.0] * 7 + [None]), (464, [float("inf")] * 8),
           (465, []), (466, [1.0] * 7), (None, [1.0] * 8), (7, good[7][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + hot + odd], "vec_id long, embedding array<double>, v string, pos int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, block=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute_force(good + hot)
    assert set(got) == set(want)
    assert sum(len({v for _, v in got[q]} & {w for w, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    assert [v for _, v in sorted(got[400])] == [300, 301, 302, 303, 304] and [v for _, v in sorted(got[300])] == [301, 302, 303, 304, 305]
    few = ann.nearest(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_hot_vector_is_cut_before_the_shuffle_and_searched_once(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [2.0] * 8) if i % 3 == 0 else (i, rng.normal(size=8).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    once = ann._once(ann.usable(df), F.col("vec_id") % 50 == 0, 5)
    assert once._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2  # before and after the shuffle
    hot = [r.vec_id for r in once.where(F.col("is_query") | (F.col("vec_id") % 3 == 0)).collect() if r.vec_id % 3 == 0]
    assert sorted(hot) == [0, 3, 6, 9, 12, 15]
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, block=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 50))
    for q in range(0, 1500, 150):
        want = [i for i in (0, 3, 6, 9, 12, 15) if i != q][:5]
        assert [v for _, v, _ in sorted(got[q])] == want and all(abs(s - 1) < 1e-12 for _, _, s in got[q])


def test_codes_bound_every_cosine_and_keep_the_nearest():
    rng = np.random.default_rng(6)
    for size in (1, 2, 8, 64, 768):
        vectors, queries = rng.normal(size=(3000, size)), rng.normal(size=(300, size))
        vectors[:100] **= 9
        vectors[100:110] = vectors[100]
        vectors, queries = ann._unit(vectors), ann._unit(queries)
        true = queries @ vectors.T
        query, row, low, high = ann.possible(ann.codes(vectors), queries, 6)
        assert (low <= true[query, row]).all() and (true[query, row] <= high).all()
        found = set(zip(query.tolist(), row.tolist()))
        assert all((i, j) in found for i in range(300) for j in np.argsort(-true[i], kind="stable")[:6].tolist())
    assert set(ann.possible(ann.codes(vectors[:3]), queries[:2], 6)[1]) == {0, 1, 2}


def test_vectors_too_alike_for_codes_are_searched_in_full(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (np.ones(8) + 1e-3 * rng.normal(size=8) if i % 3 else rng.normal(size=8)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_force(rows)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [v for _, v, _ in sorted(got[q])] == [v for v, _ in near]


def test_components_of_any_magnitude(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8) * 10.0 ** (300 * (i % 3 - 1))) for i in range(120)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    unit = {i: ann._unit(v[None, :] / np.abs(v).max())[0] for i, v in rows}
    for q in (0, 50, 100):
        want = sorted((-float(unit[q] @ unit[i]), i) for i in unit if i != q)[:5]
        assert [got[q, n + 1][0] for n in range(5)] == [i for _, i in want]
        assert all(abs(got[q, n + 1][1] + want[n][0]) < 1e-12 for n in range(5))


def test_counted_places_are_those_of_the_orderings(spark):
    """Places that one pass counts, with many rows at the same number, against the orderings themselves."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 1e-4 * rng.normal(size=16)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kind, candidates = "<f8", ann._once(ann.usable(df), F.col("vec_id") % 50 == 0, 5).repartition(5)
    axes = ann.axes_of(ann._unit(np.array([r[1] for r in rows])), 4)
    points = [(r.vec_id, bytes(r.v)) for r in candidates.where("vec_id % 37 = 0").collect()]
    counted = ann._places(candidates, axes, points, kind)
    places = {(r.vec_id, r.curve): r.pos for r in ann._orderings(candidates, axes, kind).where("vec_id % 37 = 0").collect()}
    assert [[places[p[0], c] for c in range(4)] for p in points] == counted.tolist()


def test_clustered_vectors_need_few_places(spark):
    """Clusters, varying in three of 32 directions: the index compares a small share of all rows and says so."""
    rng = np.random.default_rng(10)
    plane = rng.normal(size=(3, 32))
    rows = [(i, (rng.normal(size=3) @ plane + 0.01 * rng.normal(size=32)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    found = ann.nearest(df, F.col("vec_id") % 50 == 0, block=128).collect()
    for r in found:
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_force(rows)
    assert sum(len(set(got[q]) & {v for v, _ in near}) for q, near in want.items()) >= 0.9 * 5 * len(want)
    assert found[0].orderings >= ann.LEAST_CURVES and found[0].compared < 0.5 * len(rows)


def test_orderings_are_chosen_by_cost():
    rng = np.random.default_rng(11)
    close = rng.integers(0, 10, (320, 12))
    assert ann.cheapest(close, 10 ** 9, 10 ** 7) == (3, int(np.sort(close[:, :3].min(axis=1))[310]))
    rare = np.where(rng.random((320, 12)) < 0.4, close, 10 ** 9 - 1)  # near in two of five orderings, far in the others
    orderings, window = ann.cheapest(rare, 10 ** 9, 10 ** 7)
    held = [np.mean(rare[:, :n].min(axis=1) < 10) for n in (orderings - 1, orderings)]
    assert held[0] < 0.97 <= held[1] and window < 10
    assert ann.cheapest(np.zeros((0, 12), int), 0, 0) == (1, 0)


def test_hilbert_curve_visits_neighbours():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    number = ann.hilbert(grid, 3).astype(int)
    assert sorted(number) == list(range(side ** 3))
    path = grid[np.argsort(number)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_positions_split_a_hot_group(spark):
    df = spark.range(2000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id % 7 AS STRING)) AS g", "id % 10 AS k", "id")
    got = global_positions(df, "g", ["k", "id"], "test").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.pos, r.k, r.id, r.group_rows))
    for rows in groups.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows))) and {r[3] for r in rows} == {len(rows)}
        assert [r[1:3] for r in rows] == sorted(r[1:3] for r in rows)
