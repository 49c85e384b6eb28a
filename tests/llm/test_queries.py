"""The training-data operators on Spark: plain versions, edge rows, contracts."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from tests.llm.test_kernels import shingles
from waveline.llm import decontaminate, html_text, language, license_scan, media, near_duplicates, packing, quality, queries, sharding, suffix_dedup

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, spans string, h1 long, score double"
has_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def corpus():
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 8))) for _ in range(n))
    passages = [text(rng.randint(60, 160)) for _ in range(4)]
    texts = [None, "", "x" * 2000, "ab " * 400, "...", "One two", "one, two!"]
    for _ in range(60):
        t = text(rng.randint(1, 200))
        texts.append(t + " " + rng.choice(passages) + " " + text(40) if rng.random() < 0.6 else t)
    for _ in range(15):
        t = rng.choice(texts[7:60])
        k = rng.randint(0, len(t))
        texts.append(t[:k] + "Q" + t[k:])
    rows = [(i, t, "en" if i % 2 else None, "s", 1, 0.5) for i, t in enumerate(texts)]
    return rows + [rows[10], rows[10], (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def covered(texts, length):
    seen = {}
    for d, b in enumerate(texts):
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s : s + length], []).append((d, s))
    marks = [np.zeros(len(b), bool) for b in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, s in places:
                marks[d][s : s + length] = True
    return marks


@pytest.mark.parametrize("group", [512, 3])
def test_suffix_dedup(docs, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group * 360)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 4096)
    rows = corpus()
    raw = [(t or "").encode() for _, t, *_ in rows]
    expected = []
    for (doc, *_), b, m in zip(rows, raw, covered(raw, 240), strict=True):
        kept = bytes(x for x, gone in zip(b, m, strict=True) if not gone)
        expected.append((doc, len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs, 240).collect()), key=str) == sorted(expected, key=str)


def test_suffix_clean_keeps_columns(docs):
    out = suffix_dedup.clean(docs, 240)
    assert out.columns == docs.columns and out.count() == docs.count()


@pytest.mark.parametrize("cluster,tile,bucket", [(4000, 512, 512), (3, 2, 512), (4000, 3, 4)])
def test_near_duplicates(docs, monkeypatch, cluster, tile, bucket):
    monkeypatch.setattr(near_duplicates, "CLUSTER", cluster)
    monkeypatch.setattr(near_duplicates, "TILE", tile)
    monkeypatch.setattr(near_duplicates, "BUCKET", bucket)
    rows = [(d, t) for d, t, *_ in corpus()]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d) if d is not None and least.get(find(i), d) is not None else d
    expected = sorted(((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows)), key=str)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in near_duplicates.join(docs).collect()), key=str) == expected


def test_sharding(docs):
    rows = sharding.assign(docs, 5).collect()
    assert len(rows) == docs.count()
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in rows if r["shard"] == s) - total / 5) <= largest for s in range(5))
    assert sorted(r["text_crc32"] for r in rows) == sorted(zlib.crc32((t or "").encode()) for _, t, *_ in corpus())


def test_packing(docs):
    rows = packing.pack(docs, capacity=64, keep_ids=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.piece == 0 for r in rows) == docs.count()


def test_edges(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, corpus()[8][1]), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    for df, n in ((docs, docs.count()), (none, 0)):
        assert media.extract(df).count() == n
        assert license_scan.scan(df).count() == 0
        assert {r.item_id for r in decontaminate.search(df, items).collect()} == ({1} if n else set())
        assert decontaminate.clean(df, items).columns == df.columns
        ranker = quality.train(df, labels)
        assert quality.score(df, ranker).count() == n and quality.accepted(df, ranker).columns == df.columns
        found = language.identify(df, language.train(df)).collect()
        assert len(found) == n and all(0 <= r.score <= 1 for r in found)
        assert packing.pack(df).count() >= n and sharding.assign(df).count() == n
    assert near_duplicates.join(none).count() == 0 and suffix_dedup.remove_repeats(none).count() == 0


@has_tables
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [r for r in queries.op4_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.98
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in queries.op3_quality_classifier(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in rows]) > 0.97


@has_tables
def test_pipeline(spark):
    import corpus_pipeline

    out = docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out.count(), stage(spark, out, DIR).cache()
        assert out.columns == docs.columns, name
        assert out.count() <= before
    assert corpus_pipeline.run(spark, DIR).where("piece = 0").count() == out.count()


@pytest.mark.parametrize("block", [2000, 30])
def test_dense_buckets_lose_no_pair(spark, monkeypatch, block):
    from waveline.llm.common import Scratch, mix

    monkeypatch.setattr(near_duplicates, "BUCKET", 16)
    monkeypatch.setattr(near_duplicates, "BLOCK", block, raising=False)
    key, width = 77, near_duplicates.BANDS * near_duplicates.ROWS
    with np.errstate(over="ignore"):
        h = mix(np.uint64(key) + np.arange(1, near_duplicates.SUB_BANDS + 1, dtype=np.uint64))
        shared = (mix(h[:, None] + np.arange(near_duplicates.SUB_ROWS, dtype=np.uint64)) % np.uint64(width)).astype(int)
    sigs = np.repeat(np.random.default_rng(8).integers(1 << 16, size=(100, width), dtype=np.uint16), 2, axis=0)
    sigs[:, shared.ravel()] = 7  # every text in every sub-bucket, alike in pairs only
    texts = spark.createDataFrame([(i, 100, bytearray(x.tobytes()), [key]) for i, x in enumerate(sigs)], "c1 long, n long, sig binary, bands array<long>")
    with Scratch(spark) as scratch:
        edges = {(r.a, r.b) for r in near_duplicates.candidate_edges(texts, scratch, 0.8).collect()}
    assert edges == {(i, i + 1) for i in range(0, 200, 2)}


def test_sharding_cuts_in_order(docs):
    rows = sorted(((d is not None, d if d is not None else 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for d, t, *_ in corpus()))
    total, at, expected = sum(r[3] for r in rows), 0, []
    for has, doc, crc, size in rows:
        expected.append((doc if has else None, size, crc, min(4, (2 * at + size) * 5 // (2 * total))))  # by the middle of a row's bytes
        at += size
    got = sharding.assign(docs, 5).orderBy("shard", "slot").collect()
    assert [(r.doc_id, r["size"], r.text_crc32, r.shard) for r in got] == expected


def test_sharding_writes(spark, docs, tmp_path):
    sharding.write(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    expected = sharding.assign(docs, 4, carry=("text",)).collect()
    assert sorted((r.shard, r.slot, str(r.text)) for r in back.collect()) == sorted((r.shard, r.slot, str(r.text)) for r in expected)


def test_packed_sequences(spark):
    from tokenizers import Tokenizer

    rows = [(i, " ".join(f"word{j % 7}" for j in range(n))) for i, n in enumerate((0, 3, 50, 200, 7, 7))] + [(None, None)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=64, keep_ids=True)
    library = Tokenizer.from_file(packing.tokenizer_path())
    whole = {d: [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for d, t in rows}
    pieces = packed.collect()
    for r in pieces:
        assert r.ids == whole[r.doc_id][r.start : r.start + r.length] and r.start == 64 * r.piece
    assert sorted((str(r.doc_id), r.piece) for r in pieces) == sorted((str(d), k) for d, ids in whole.items() for k in range(-(-len(ids) // 64)))
    held = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in pieces:
        assert held[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sum(map(len, held.values())) == sum(map(len, whole.values()))


def test_media_tensors(docs):
    import pyarrow as pa

    rows = media.to_tensors(media.extract(docs).toArrow())
    kind = rows.schema.field("log_mel").type
    assert kind == pa.fixed_shape_tensor(pa.float32(), (media.SLOTS, media.MELS))
    tensors = rows.column("log_mel").combine_chunks().to_numpy_ndarray()
    told = {}
    texts = {d: t for d, t, *_ in corpus()}
    for i, r in enumerate(rows.select(["doc_id", "payload_bytes", "payload_sha256", "media_sha256", "feature", "span_start", "span_end"]).to_pylist()):
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        tensor, spans = media.features(np.frombuffer(payload, np.uint8))
        assert np.array_equal(tensors[i], tensor) and spans.tolist() == [list(x) for x in zip(r["span_start"], r["span_end"], strict=True)]
        assert (r["payload_bytes"], r["payload_sha256"], r["media_sha256"]) == (len(payload), hashlib.sha256(payload).hexdigest(), hashlib.sha256(media.store(payload)).hexdigest())
        assert told.setdefault(payload, r["feature"]) == r["feature"]
    assert len(set(told.values())) > len(told) // 2
    with pytest.raises(ValueError):
        media.to_tensors(pa.table({"log_mel": pa.array([[1.0]], pa.list_(pa.float32()))}))


def test_html_rows(spark):
    page = "<article><p>Some text &amp; more of it in a paragraph.</p></article>"
    rows = [(1, "u", page, "x", 2), (1, "u", page, "x", 2), (2, None, None, None, None), (3, "v", "", "y", 1), (None, "w", "<nav>menu</nav>", "z", 0), (4, "b", "<article><p>a</p><![foo[bar]]><p>" + "long text " * 300_000 + "</p></article>", "", 0)]
    schema = "page_id long, url string, html string, text string, n_chars int"
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    whole, long = "Some text & more of it in a paragraph.", "a " + ("long text " * 300_000).strip()
    assert got == sorted([(1, "u", whole, len(whole))] * 2 + [(2, None, "", 0), (3, "v", "", 0), (None, "w", "", 0), (4, "b", long, len(long))], key=str)
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_license_rows(spark):
    notice = "Released under the MIT License."
    rows = [(1, notice + " x " + notice, "a", 0.1), (1, notice, "a", 0.1), (1, notice, "a", 0.1), (2, None, "b", None), (3, "", "c", 1.0), (4, "word " * 400_000 + notice, "d", 1.0)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, license string, coverage double")).collect()
    assert sorted((r.doc_id, r.license, r.first_word) for r in got) == [(1, "MIT", 0), (1, "MIT", 0), (1, "MIT", 0), (1, "MIT", 6), (4, "MIT", 400_000)]


def test_long_texts(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(120))
    parts = [" ".join(word() for _ in range(70_000)) for _ in range(3)]
    long = f" {passage} ".join(parts)  # crosses the pieces of all readers
    rows = [(1, long, "en"), (2, "START " + passage + " END", "en"), (3, long[:-40] + " other", "fr"), (4, "x" * 1_100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    raw = [t.encode() for _, t, _ in rows]
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    at = raw[1].index(passage.encode())
    # the blanks around the passage occur with it: of 2 all but its first and last words goes
    assert found[2].n_removed == len(passage.encode()) + 2 and found[2].n_spans == 1 and at == 6
    assert found[2].kept_sha256 == hashlib.sha256(b"STARTEND").hexdigest()
    shared = len(os.path.commonprefix([raw[0], raw[2]]))
    assert found[1].n_removed == found[3].n_removed == shared and found[1].n_spans == found[3].n_spans == 1
    assert (found[4].n_removed, found[4].n_spans) == (1_100_000, 1)
    links = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.join(docs).collect()}
    assert links == {1: (1, 1), 2: (2, 0), 3: (1, 1), 4: (4, 0)}
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.search(docs, items).collect()) == [1, 2, 3]
    assert {r.doc_id: r.n_bytes for r in media.extract(docs).collect()} == {d: len(t) for (d, *_), t in zip(rows, raw, strict=True)}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    pieces = [r for r in packing.pack(docs.where("doc_id < 4")).collect() if r.doc_id == 1]
    ids = [*library.encode(long, add_special_tokens=False).ids, packing.END_ID]
    assert sorted((r.piece, r.ids_crc32) for r in pieces) == [(k, zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]


def test_copies_are_repeated_whole(spark):
    text = "a text that has copies and is long enough to be removed. " * 12
    rows = [(i, text) for i in range(40)] + [(99, "short copy"), (98, "short copy"), (None, text)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted({(r.n_bytes, r.n_removed, r.n_spans) for r in got}) == [(10, 0, 0), (len(text), len(text), 1)] and len(got) == 43


def test_what_is_left_as_text(spark, tmp_path):
    common = " ".join(f"word{i * 7919 % 1000}" for i in range(80))
    rows = [(1, f"one \u00e9{common}\u00e9 end"), (2, f"two \u00a9{common}\u00e8"), (3, f"{common}"), (4, "short \u00e9"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op1_suffix_array_dedup(spark, str(tmp_path)).collect()}
    # bytes c3 and a9 of two characters are left side by side, which make no third one
    assert [got[i].text for i in range(1, 6)] == ["one  end", "two ", "", "short \u00e9", ""]
    assert got[1].kept_sha256 == hashlib.sha256(b"one \xc3\xa9 end").hexdigest() and got[1].n_spans == 1
    assert got[4].kept_sha256 == hashlib.sha256(got[4].text.encode()).hexdigest()


@has_tables
def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_cluster_without_a_shared_folder():
    from waveline.llm import common

    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(Session)
