"""Goldens, properties and text forms of the wavelet engine."""

import random

import pytest

from waveline import plans
from waveline.operators import exact, generators, haar, ids, metrics, reconstruct, sampling
from waveline.sources import logs, text
from waveline.streaming import running_coefficients

GOLDEN = {1: 6.75, 2: 0.25, 3: 2.5, 4: 5.0, 5: 1.0, 6: -1.0, 8: 2.0}


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def stream(spark, seed, n=300, levels=6, nodes=5):
    rng = random.Random(seed)
    count = {}
    rows = []
    for _ in range(n):
        node = rng.randrange(nodes)
        rows.append((min(int(rng.expovariate(0.08)) + 1, 1 << levels), node, count.setdefault(node, 0)))
        count[node] += 1
    return spark.createDataFrame(rows, "key long, node long, pos long")


def test_toy_coefficients(spark):
    assert pairs(exact.central_topk(generators.toy(spark), 3, 7)) == GOLDEN


def test_key_line(spark):
    line = ",".join(str(k) for k, n in enumerate(generators.TOY, 1) for _ in range(n))
    keys = text.keys_of_lines(spark.createDataFrame([(0, line), (1, ""), (2, " , ")], "node long, value string"), 3)
    assert pairs(exact.local_topk(keys, 3, 4)) == {1: 6.75, 3: 2.5, 4: 5.0, 8: 2.0}


def test_sse(spark):
    a = text.parse_pairs(spark.createDataFrame([("(1,3)",), ("(2,4)",), ("(3,5)",), ("(4,6)",)], "value string"), ("key", "freq"), "long")
    b = text.parse_pairs(spark.createDataFrame([("(1,1)",), ("(2,1)",), ("(3,9)",), ("(4,0)",)], "value string"), ("key", "freq"), "long")
    assert metrics.sse(a, b).first()[0] == metrics.sse_grouped(a, b).first()[0] == 65


def test_reconstruction(spark):
    coefs = spark.createDataFrame(list(GOLDEN.items()), "idx long, coef double")
    assert [r["freq"] for r in reconstruct.rounded(reconstruct.frequencies(coefs, 3)).orderBy("key").collect()] == list(generators.TOY)


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 10), (3, 40), (4, 500)])
def test_exact_methods_agree(spark, seed, k):
    keys = stream(spark, seed)
    rows = lambda df: [tuple(r) for r in df.collect()]
    central = rows(exact.central_topk(keys, 6, k))
    assert rows(exact.local_topk(keys.repartition(3), 6, k)) == central
    assert rows(exact.three_round_topk(keys, 6, k)) == central


def test_inverse_and_segments(spark):
    keys = stream(spark, 5)
    freq = pairs(exact.frequency(keys))
    whole = haar.coefficients(exact.frequency(keys), 6)
    values = pairs(reconstruct.frequencies(whole, 6))
    assert values == {k: float(freq.get(k, 0)) for k in range(1, 65)}
    top = exact.central_topk(keys, 6, 5)
    runs = reconstruct.segments(top, 6)
    assert pairs(reconstruct.at_keys(runs, spark.range(1, 65).withColumnRenamed("id", "key"))) == pairs(reconstruct.frequencies(top, 6))
    assert reconstruct.range_sum(reconstruct.segments(whole, 6), 1, 64).first()[0] == sum(freq.values())


def test_error_falls_with_k(spark):
    keys = stream(spark, 6)
    truth = exact.frequency(keys)
    errors = [metrics.sse(truth, reconstruct.frequencies(exact.central_topk(keys, 6, k), 6).withColumnRenamed("value", "freq"), "full").first()[0] for k in (1, 4, 16, 64)]
    assert errors == sorted(errors, reverse=True) and errors[-1] == 0


def test_step_one_is_exact(spark):
    keys = stream(spark, 7)
    assert pairs(sampling.basic_estimate(keys, 1e-4)) == pairs(exact.frequency(keys))
    for method in ("improved", "twolevel", "twolevel_variant"):
        assert plans.synopsis(keys, method, 6, 5, 0.05, 5).count() <= 5


def test_key_outside_the_domain(spark):
    lines = spark.createDataFrame([(0, "1,9")], "node long, value string")
    with pytest.raises(Exception, match="outside the domain"):
        text.keys_of_lines(lines, 3).collect()


def test_segments_of_keys_outside_the_domain(spark):
    keys = spark.createDataFrame([(k, 0) for k in [1, 1, 2, 7, 9, 12, 12, 70, 70, 70, 10**6, 10**6, 10**12]], "key long, node long")
    top = exact.central_topk(keys, 3, 30)
    assert top.where("idx > 1000").count() > 1
    runs = sorted(tuple(r) for r in reconstruct.segments(top, 3).collect())
    values = {r.key: r.value for r in reconstruct.frequencies(top, 3).collect()}
    assert [k for lo, hi, _ in runs for k in range(lo, hi + 1)] == list(range(1, 9))
    assert all(values[k] == v for lo, hi, v in runs for k in range(lo, hi + 1))


def test_files(spark, tmp_path):
    (tmp_path / "keys").mkdir()
    (tmp_path / "keys" / "a.txt").write_text("1,2 3\n\n4,4\n")
    keys = text.read_keys(spark, str(tmp_path / "keys"), 3, glob="*.txt")
    assert pairs(exact.frequency(keys)) == {1: 1, 2: 1, 3: 1, 4: 2}
    text.write_pairs(exact.central_topk(keys, 3, 4), str(tmp_path / "out"))
    assert pairs(text.read_coefficients(spark, str(tmp_path / "out"))) == pairs(exact.central_topk(keys, 3, 4))


def test_binary_log(spark, tmp_path):
    record = (7).to_bytes(4, "big") + (-2).to_bytes(4, "big", signed=True) + (3).to_bytes(4, "big") + (2**31 - 1).to_bytes(4, "big") + bytes([1, 200, 3, 4])
    (tmp_path / "log1").write_bytes(record * 2 + b"xx")
    (tmp_path / "log2.gz").write_bytes(record)
    rows = logs.read(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [(7, -2, 3, 2**31 - 1, 1, -56, 3, 4)] * 2


def test_logs_by_file(spark, tmp_path):
    record = lambda i: i.to_bytes(4, "big") * 4 + bytes([1, 2, 3, 255])
    (tmp_path / "log1").write_bytes(b"".join(record(i) for i in range(3000)))
    (tmp_path / "log2").write_bytes(record(7) + b"x")
    (tmp_path / "log3").write_bytes(b"")
    rows = logs.read(spark, str(tmp_path), with_log=True)
    assert rows.where("server <> -1 or client_id <> ts").count() == 0
    logs.write_requests(rows, str(tmp_path / "out"), by="log")
    back = logs.read_requests(spark, str(tmp_path / "out")).collect()
    assert sorted((r.log, r.ts) for r in back) == sorted([("log1", i) for i in range(3000)] + [("log2", 7)])


def test_hot_keys_are_dealt_out(spark):
    freq = spark.createDataFrame([(1, generators.RUN * 2 + 5), (2, generators.RUN), (3, 1), (4, 0)], "key long, freq long")
    assert pairs(exact.frequency(generators.repeat(freq))) == {1: generators.RUN * 2 + 5, 2: generators.RUN, 3: 1}


@pytest.mark.parametrize("mode", ["inner", "full"])
def test_error_by_segments(spark, mode):
    keys = stream(spark, 9)
    for k in (1, 5, 200):
        top = exact.central_topk(keys, 6, k)
        plain = metrics.sse(exact.frequency(keys), reconstruct.rounded(reconstruct.frequencies(top, 6)), mode)
        assert plans.error(keys, top, 6, mode).first()[0] == plain.first()[0]


def test_normalized_top(spark):
    coefs = spark.createDataFrame([(1, 1.0), (2, 1.5), (5, 2.0), (8, -2.0)], "idx long, coef double")
    assert [r["idx"] for r in haar.top(coefs, 3, 3, normalize=True).collect()] == [2, 1, 5]


def test_round3_sends_what_is_missing(spark):
    keys = stream(spark, 11)
    local = exact.local_coefficients(keys, 6)
    sent = exact.two_sided(local, 4)
    rest = exact.unsent(local, exact.cuts(sent, 4))
    rows = lambda df: {(r["node"], r["idx"]) for r in df.collect()}
    assert rows(rest) == rows(local.where("coef <> 0")) - rows(sent)


def test_dense_ids(spark):
    df = spark.createDataFrame([(5, "b"), (1, "z"), (5, "a"), (1, "z")], "a long, b string")
    assert {(r.a, r.b): r.id for r in ids.dense_ids(df, ["a", "b"]).collect()} == {(1, "z"): 1, (5, "a"): 2, (5, "b"): 3}


def test_zipf(spark):
    freq = generators.zipf_frequencies(spark, 100, 10_000).collect()
    assert sorted(r["key"] for r in freq) == list(range(1, 101))
    counts = [r["freq"] for r in sorted(freq, key=lambda r: r["rank"])]
    assert counts == sorted(counts, reverse=True) and abs(sum(counts) - 10_000) < 60


def test_empty(spark):
    none = spark.createDataFrame([], "key long, node long, pos long")
    for method in ("central", "local", "three_round", "basic", "improved", "twolevel"):
        assert plans.synopsis(none, method, 4, 3, 0.1, 2).count() == 0


def test_running_coefficients(spark, tmp_path):
    keys = stream(spark, 8)
    keys.select("key").repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("key long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = running_coefficients(live, 6).writeStream.outputMode("complete").format("memory").queryName("running").start()
    query.processAllAvailable()
    query.stop()
    got = {i: c for i, c in pairs(spark.table("running")).items() if c != 0 or i == 1}
    assert got == pairs(haar.coefficients(exact.frequency(keys), 6))
