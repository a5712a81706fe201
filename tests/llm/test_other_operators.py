"""Archives, embeddings, components and the pipeline on small fixtures."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from readloom.llm import embedding_dedup, warc
from readloom.llm.common import materialize
from readloom.llm.components import connected_components


def test_warc_round_trip(spark):
    rnd = random.Random(1)
    big = "".join(rnd.choice("abc é") for _ in range(1500))
    rows = [(1, "http://a/x", big), (2, "http://b/\n y", big), (3, None, big), (3, None, big), (4, "http://c", "small"), (5, "http://d", "small"), (6, None, None), (None, "http://e", "tiny"), (None, "http://e", big), (7, "http://f", big + "x"), (8, "http://g", "x" * 1000), (9, "http://g", "x" * 1000), (10, "", "x" * 999), (11, "", "x" * 999)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    folder = warc.archive_folder(pages)
    manifest = materialize(warc.write_archives(pages, folder), "manifest")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(manifest, folder).collect())
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        head = max([j for j, _, h in rows if h == html and j is not None], default=None)
        revisit = len(data) >= 1000 and head is not None and i != head
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", head if revisit else None] += 1
    assert got == want
    empty = materialize(warc.write_archives(pages.limit(0), folder), "manifest")
    assert warc.read_archives(empty, folder).count() == 0


def test_archive_format():
    import struct

    import zstandard

    records = [warc.record(k, "http://a/", b"payload %d" % k, hashlib.sha1(b"payload %d" % k).hexdigest(), 9 + len(str(k)), None, "2024-01-01T00:00:00Z") for k in range(300)]
    data = warc.compress(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    assert first.decompress(data[8 + size :]) == records[0] and first.unused_data  # each record is a frame of its own
    assert [h["X-Page-ID"] for h, _ in warc.parse(data)] == [str(k) for k in range(300)]
    assert len(list(warc.parse(warc.compress(records[:1])))) == 1


def plain_links(rows, threshold):
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    first = {}
    for i in range(n):
        if ok[i] and rows[i][0] is not None:
            first[find(i)] = min(first.get(find(i), rows[i][0]), rows[i][0])
    comp = [first.get(find(i)) if ok[i] else rows[i][0] for i in range(n)]
    return Counter((rows[i][0], links[i], comp[i], rows[i][0] is None or comp[i] is None or rows[i][0] == comp[i]) for i in range(n))


@pytest.mark.parametrize("tile", [1024, 16])
def test_embedding_dedup(spark, tile):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        base = rng.normal(size=12)
        rows += [(len(rows) + c, [float(np.float32(x)) for x in base + rng.normal(size=12) * s], k % 3) for c, s in enumerate((0, 0.05, 0.12, 0.2))]
    rows += [(900 + k, rows[0][1], 0) for k in range(5)] + [(0, rows[0][1], 0), (None, rows[4][1], 1), (910, None, 0), (911, [0.0] * 12, 0), (912, [float("nan")] * 12, 0), (913, [None] * 12, 0), (914, rows[0][1], None), (915, [1.0, 2.0], 0), (916, [], 0), (917, [2 * x for x in rows[0][1]], 0), (918, [float("inf")] + [1.0] * 11, 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, tile=tile).collect())
    assert got == plain_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows], 0.98)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embedding_dedup.keep_one(df).columns == df.columns


def test_bounds_are_rigorous():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 64)) * rng.exponential(size=(1, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    bound = embedding_dedup.upper_bounds(*embedding_dedup.quantise(x), slice(0, 200), slice(0, 200))
    assert (bound >= x @ x.T).all() and (bound - x @ x.T).max() < 0.2


def test_components(spark):
    rnd = random.Random(8)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(4000, 4100)] + [(7, 7), (None, 3)]
    parent = {v: v for p in pairs for v in p if v is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    touched = {v for a, b in pairs if a is not None and b is not None and a != b for v in (a, b)}
    assert got == {v: find(v) for v in touched}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    rnd = random.Random(11)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    passage, bench = say(150), say(30)
    rows = [(k, say(60), "en", f"s{k % 3}", None) for k in range(20)]
    rows += [(30, rows[0][1] + " more", "en", "s", 3), (31, "you stupid idiot, you moron", "en", "s", 3), (40, say(20) + passage + say(20), "en", "s", 1), (41, say(20) + passage + say(20), None, None, 1), (50, say(10) + " " + bench + " " + say(10), "en", "s", 1), (60, None, None, None, None), (61, "", "en", "s", 0)]
    folder = tmp_path / "in"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(folder)), name)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "decontamination":
            assert bench.split()[3] + " " + bench.split()[4] not in docs.where("doc_id = 50").head().text
    every = {r[0] for r in rows}
    assert kept["toxicity"] == every - {31}
    assert kept["ngram_jaccard_join"] == every - {31, 30}
    assert kept["suffix_array_dedup"] == kept["decontamination"] == kept["packing"] == every - {31, 30}
    assert pipeline.run(spark, str(folder)).count() == docs.count()
