"""Text, number, time and source functions on chosen cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.functions import numbers as N
from tideline.functions import text as T
from tideline.functions import timebuckets as B
from tideline.functions.arrays import scan
from tideline.operators import encode as E
from tideline.operators import evaluate as V
from tideline.operators import vectors
from tideline.sources import readers as R


def one(spark, column, value, kind):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,want", [
    ("see http://a.b/c and more\nnext", "see next"), ("tail http://a.b", "tail"), ("#tag @me hello-world", "hello world"), ("naïve café", "na ve caf"), ("", ""), ("a  \t b", "a b"), ("😀 ok", "ok"),
])
def test_clean(spark, text, want):
    assert one(spark, T.clean, text, "string") == want


def test_tokens(spark):
    assert one(spark, lambda c: T.tokens(T.clean(c)), "cannot gonna cats", "string") == ["can", "not", "gon", "na", "cats"]
    assert one(spark, lambda c: T.preprocess(c, unique=True), "b a b", "string") == ["b"]
    assert one(spark, lambda c: T.entities(c, "#"), "a #One, #two! #", "string") == ["One", "two", ""]


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("triplicate", "triplic"), ("adjustment", "adjust"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"), ("happy", "happi"), ("agreed", "agre"), ("filing", "file")])
def test_porter(word, want):
    assert T.porter(word) == want


@pytest.mark.parametrize("x,d,want", [(1.4, 0, 1), (1.5, 0, 2), (2.5, 0, 3), (-1.3, 0, -2), (-1.5, 0, -2), (10.25, 1, 10.3), (3.0, 0, 3)])
def test_half_up(spark, x, d, want):
    assert one(spark, lambda c: N.half_up(c, d), x, "double") == want


@pytest.mark.parametrize("x,want", [(3.0, "3"), (1.234567, "1.23457"), (10.123456, "10.1235")])
def test_short_key(spark, x, want):
    assert one(spark, N.short_key, x, "double") == want


def test_bucket_edges(spark):
    edge = dt.datetime(2024, 1, 1, 0, 30)
    later = edge + dt.timedelta(microseconds=1)
    assert one(spark, lambda c: B.ceil_bucket(c, 1800), edge, "timestamp") == edge
    assert one(spark, lambda c: B.ceil_bucket(c, 1800), later, "timestamp") == edge + dt.timedelta(minutes=30)
    assert one(spark, lambda c: B.floor_bucket(c, 1800), later, "timestamp") == edge


def test_scan_in_blocks(spark):
    xs = list(range(1000))
    got = one(spark, lambda c: scan(c, F.lit(0).cast("long"), lambda s, x: s + x, lambda s, x: s, "array<bigint>"), xs, "array<long>")
    assert got == [sum(xs[:i]) for i in xs]
    assert one(spark, lambda c: scan(c, F.lit(0).cast("long"), lambda s, x: s + x, lambda s, x: s, "array<bigint>"), [], "array<long>") == []


def test_auc_ties_and_single_class(spark):
    rows = [(1, 1.0, True), (1, 1.0, False), (1, 0.5, False), (2, 0.1, True), (2, None, False)]
    got = {r["g"]: r["auc"] for r in V.auc(spark.createDataFrame(rows, "g int, s double, l boolean"), "s", "l", "g").collect()}
    assert got == {1: 0.75, 2: None}


def test_explode_union_of_empty_and_null(spark):
    df = spark.createDataFrame([(1, [], None), (2, ["a", "b"], ["m"])], "id int, h array<string>, m array<string>")
    rows = E.explode_union(df, ["id"], {"h": F.col("h"), "m": F.col("m")}).collect()
    assert sorted((r["id"], r["aspect"], r["h"] or "", r["m"] or "") for r in rows) == [(1, 0, "", ""), (1, 1, "", ""), (2, 0, "a", ""), (2, 0, "b", ""), (2, 1, "", "m")]


def test_repost_texts(spark):
    rows = [("1", None, "x", 0), ("2", "1", "x", 1), ("3", "9", "y", 2), ("4", "9", "y", 3)]
    out = E.suppress_repeated_text(spark.createDataFrame(rows, "id string, o string, text string, seq int"), "id", "o", "text", "seq")
    assert [r["text"] for r in out.orderBy("seq").collect()] == ["x", "", "y", ""]


def test_murmur():
    assert vectors.murmur3_32(b"", 0) == 0
    assert vectors.murmur3_32(b"hello", 0) == 0x248BFA47
    assert vectors.murmur3_32(b"hello, world", 0) == 0x149BBB7F


def test_typed_schema_and_files(spark, tmp_path):
    assert [f.dataType.simpleString() for f in R.typed_schema("duration: continuous.\nflag: symbolic.\n")] == ["double", "string", "string"]
    (tmp_path / "buckets_hashtag_score.txt").write_text("[[(1.0,2.0)],[]]\n")
    assert R.bucket_files(spark, str(tmp_path)).first()["feature"] == "hashtag"
    (tmp_path / "posts.json").write_text('{"data":[{"id":"1","text":"t","created_at":"2024-01-01T00:00:00.000Z","author_id":"u","referenced_tweets":[{"type":"quoted","id":"5"},{"type":"quoted","id":"6"}]}]}')
    post = R.nested_posts(spark, str(tmp_path / "posts.json")).first()
    assert (post["quoted"], post["hashtags"], post["retweeted"]) == ("6", [], None)
    (tmp_path / "n.csv").write_text("# c\n1,2.5\n")
    assert R.headerless_csv(spark, str(tmp_path / "n.csv"), "a long, b double").collect() == [(1, 2.5)]


def test_reducers():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((256, 3)) @ rng.standard_normal((3, 16))
    assert vectors.fit_pca(x, 3)(x).var(0).sum() == pytest.approx(vectors._scaled(x, 0)[0].var(0).sum(), rel=1e-6)
    y = (x[:, 0] > 0).astype(float)
    code = vectors.fit_information_bottleneck(x, y, 4)(x)
    assert abs(np.corrcoef(code @ np.linalg.lstsq(code, y, rcond=None)[0], y)[0, 1]) > 0.6
    assert np.isfinite(vectors.fit_autoencoder(x, 4, 50)(x)).all()


def test_lines_of_several_files_and_splits(spark, tmp_path):
    lines = [f"{i},{'x' if i % 7 == 0 else i * 2}" if i % 5 else f"# note {i}" for i in range(3000)]
    for k in range(3):
        (tmp_path / f"part-{k}.txt").write_text("\n".join(lines[k * 1000 : (k + 1) * 1000]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # several splits a file
    try:
        numbered = {r["n"]: r["value"] for r in R.numbered_lines(spark, str(tmp_path)).collect()}
        rows = {r["n"]: r["values"] for r in R.number_lists(R.numbered_lines(spark, str(tmp_path))).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert numbered == dict(enumerate(lines))
    assert rows == {i: [float(i)] if i % 7 == 0 else [float(i), 2.0 * i] for i in range(3000) if i % 5}


def test_stream_encoder_tries_a_batch_again(spark, tmp_path):
    from tideline.streaming.encoder import StreamEncoder

    rows = [(i, f"v{(i * i) % 17}" if i % 6 else None, 100 + 3 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, value string, t long").withColumnRenamed("value", "name")
    encoder = StreamEncoder(spark, ["name"], str(tmp_path), step="t", width=10)
    for batch, (a, b) in enumerate(((0, 20), (20, 45), (45, 60))):
        for _ in range(1 + (batch == 1)):
            encoder.encode_batch(df.where((F.col("seq") >= a) & (F.col("seq") < b)), batch)
    codes, want = {}, {}
    for i, v, t in rows:
        want[i] = (0 if v is None else codes.setdefault(v, len(codes) + 1), (t - 100) // 10)
    assert {r["seq"]: (r["name"], r["step"]) for r in encoder.codes().collect()} == want


def test_nearest_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(5)
    table = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(80)] + [(100 + i, [1.0] * 6) for i in range(5)] + [(200, None), (201, [0.0] * 6)]
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    df = spark.createDataFrame(table, "id long, v array<double>").withColumnRenamed("id", "vec_id")
    got = {}
    for r in vectors.nearest(df.where("vec_id % 10 = 0"), df, "vec_id", "v", 4).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["id"]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    good = [(i, v) for i, v in table if v and any(v)]
    for q, a in good:
        if q % 10 == 0:
            near = sorted((-round(sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b), 12), i) for i, b in good if i != q)
            assert [got[q][k] for k in range(1, 5)] == [i for _, i in near[:4]]


def test_reducers_keep_their_results():
    """Fixed inputs; what the reducers gave when they were checked by hand."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 3)) @ np.array([[3.0, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0.1, 0]])
    axes = vectors.fit_pca(x, 2)
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.eigvalsh(z.T @ z / len(z))[::-1]
    assert np.allclose(axes(x).var(0), values[:2])  # the variances are the largest eigenvalues
    code = vectors.fit_autoencoder(x, 4, epochs=600)(x)
    back, *_ = np.linalg.lstsq(np.c_[code, np.ones(len(x))], z, rcond=None)
    left = ((np.c_[code, np.ones(len(x))] @ back - z) ** 2).mean()
    assert left < 0.6 * (z**2).mean()
    y = (x[:, 1] > 0).astype(float)
    kept = vectors.fit_information_bottleneck(x, y, 2, epochs=300)(x)
    best = max(abs(np.corrcoef(kept[:, k], y)[0, 1]) for k in range(2))
    assert best > 0.6


def test_stream_keeps_the_first_row_of_a_batch(spark, tmp_path):
    """Batches with many rows of a key, in no order; keys far behind the newest time are forgotten."""
    from tideline.streaming import scorer as S

    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    batches = [[(9, 1, day(0)), (3, 1, day(0)), (5, 2, day(1)), (4, 2, day(0)), (6, None, day(1))], [(11, 1, day(2)), (12, 3, day(9)), (10, 3, day(2)), (13, None, day(2))], [(20, 1, day(9)), (21, 3, day(9)), (22, 4, day(1))]]
    kind = "seq long, user long, ts timestamp"
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
    for late, want in (("400 days", {(1, 3), (2, 4), (None, 6), (3, 10), (4, 22)}), ("3 days", {(1, 3), (2, 4), (None, 6), (3, 10), (1, 20), (3, 21)})):
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        got = S.deduplicated(stream, "ts", "user", "seq", late, f"{tmp_path}/{late[:1]}").collect()
        assert {(r["user"], r["seq"]) for r in got} == want and len(got) == len(want)


def test_pairs_in_blocks(spark, monkeypatch):
    """Several blocks a group, uneven vectors, repeated ids: the pairs and measures of a plain join."""
    import numpy as np

    monkeypatch.setattr(vectors, "PAIR_BLOCK", 8)
    monkeypatch.setattr(vectors, "PAIR_SLICE", 3)
    rng = np.random.default_rng(5)
    rows = [(i % 3, i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(70)]
    rows += [(0, 3, [1.0, 2.0, 3.0, 4.0]), (0, 200, None), (0, 201, [1.0, None, 2.0, 3.0]), (1, 202, [1.0]), (1, 203, [2.0]), (2, 204, [0.0] * 4), (2, 205, []), (None, 206, [1.0] * 4), (2, None, [1.0] * 4), (5, 207, [1.0] * 4)]
    df = spark.createDataFrame(rows, "g int, id long, v array<float>")
    whole = lambda v: v is not None and None not in v
    want = []
    for g, i, v in rows:
        for h, j, w in rows:
            if g is not None and g == h and None not in (i, j) and i != j:
                fit = whole(v) and whole(w) and len(v) == len(w)
                norm = np.linalg.norm(v) * np.linalg.norm(w) if fit else 0
                want.append((g, i, j, round(float(np.dot(v, w) / norm), 9) + 0.0 if norm else None, round(float(np.linalg.norm(np.subtract(v, w))), 9) if fit else None))
    off = lambda x: None if x is None else round(x, 9) + 0.0
    found = vectors.pairwise(df, "g", "id", "v")
    got = [(r["g"], r["a"], r["b"], off(r["cosine"]), off(r["distance"])) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    half = vectors.pair_measures(df, "g", "id", {"d": ("euclidean", "v")}, ordered=False)
    assert sorted(((r["g"], r["a"], r["b"], off(r["d"])) for r in half.collect()), key=repr) == sorted(((g, a, b, d) for g, a, b, _, d in want if a < b), key=repr)


def test_spearman_over_ranges(spark, monkeypatch):
    """Many ranges and ties on both sides, and equal rows beyond what a range holds."""
    import pandas as pd

    monkeypatch.setattr(V, "RANGE_ROWS", 50)
    rows = [(float(i * 37 % 101 // 4), float(i * 53 % 89 // 3)) for i in range(900)] + [(0.0, 0.0)] * 400 + [(None, 1.0), (1.0, None)]
    got = V.spearman(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()["spearman"]
    want = pd.DataFrame(rows[:-2], columns=["a", "b"]).rank().corr().iloc[0, 1]
    assert abs(got - want) < 1e-12
    assert V.spearman(spark.createDataFrame([], "a double, b double"), "a", "b").first()["spearman"] is None


def test_words_stay_in_arrow(spark):
    """Words are mapped and gated without Pandas, null and empty lists and null words kept as they are."""
    rows = [(1, ["cats", None, "cats"]), (2, None), (3, []), (4, ["a", "dog", "is", "walking"]), (5, ["a", "b", "c", "d"]), (6, ["x", "walking"])]
    df = spark.createDataFrame(rows, "id int, w array<string>")
    asked = []
    tags = lambda ws: (asked.append(len(ws)), ["V" if w.endswith("ing") else "N" for w in ws])[1]
    out = df.select("id", T.mapped(str.upper)(F.col("w")).alias("m"), T.part_of_speech_gate(tags)(F.col("w")).alias("g"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "pandas" not in plan.lower()
    got = {r["id"]: (r["m"], r["g"]) for r in out.collect()}
    assert got == {1: (["CATS", None, "CATS"], []), 2: (None, None), 3: ([], []), 4: (["A", "DOG", "IS", "WALKING"], ["a", "dog", "is", "walking"]), 5: (["A", "B", "C", "D"], []), 6: (["X", "WALKING"], [])}
    from pyspark.util import PythonEvalType

    assert T.mapped(str.upper).evalType == T.part_of_speech_gate(tags).evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF


def test_nearest_among_copies_in_slices(spark, monkeypatch):
    """A crowd of equal vectors in slices: ties go to the smaller id, and no product is larger than a slice."""
    import numpy as np

    monkeypatch.setattr(vectors, "ROW_SLICE", 16)
    rng = np.random.default_rng(3)
    x = np.vstack([np.tile(rng.standard_normal(4), (60, 1)), rng.standard_normal((100, 4))]).round(3)
    ids = rng.permutation(160)
    df = spark.createDataFrame([(f"i{i:03}", v.tolist()) for i, v in zip(ids, x)], "id string, v array<double>")
    got = {(r["query"], r["rank"]): r["id"] for r in vectors.nearest(df.where("id like '%0'"), df, "id", "v", 4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i, v in zip(ids, u):
        if i % 10 == 0:
            order = sorted((-round(float(v @ w), 12), j) for j, w in zip(ids, u) if j != i)[:4]
            assert [got[f"i{i:03}", k] for k in range(1, 5)] == [f"i{j:03}" for _, j in order]
    assert len(got) == 64


def test_token_lists_meet_their_words_in_blocks(spark, monkeypatch):
    """Many blocks: one numbering for all, and only a block's distinct words are joined."""
    monkeypatch.setattr(E, "DOC_BLOCK", 4)
    rows = [(i, [f"w{(i * j * 7) % 23}" for j in range(i % 9)]) for i in range(60)]
    df = spark.createDataFrame(rows, "d long, words array<string>")
    number: dict[str, int] = {}
    want = {d: " ".join(str(number.setdefault(w, len(number))) for w in ws) for d, ws in rows if ws}
    assert {r["id"]: r["indices"] for r in E.token_lists(df, "d", F.col("words")).collect()} == want
    vectors_ = spark.createDataFrame([(f"w{i}", [float(i)]) for i in range(0, 23, 2)], "word string, vec array<double>")
    seen: dict[str, int] = {}
    known = [(d, p, w, seen.setdefault(w, len(seen)), [float(w[1:])]) for d, ws in rows for p, w in enumerate(ws) if int(w[1:]) % 2 == 0]
    assert sorted(map(tuple, E.embedded_tokens(df, "d", F.col("words"), vectors_).collect())) == sorted(known)
    assert E.token_lists(df.limit(0), "d", F.col("words")).count() == 0
