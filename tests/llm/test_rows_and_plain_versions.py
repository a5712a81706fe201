"""Rows that share an id, sampling at every size, empty tables, and plain versions of the classifiers' queries."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import common, decontaminate, embedding_dedup, jaccard_join, language_id, packing, quality, token_counts, toxicity, warc
from readloom.llm.common import materialize

SMALL = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def say(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))


# ---------------------------------------------------------------- rows that share an id


def test_decontamination_keeps_clean_texts_of_a_used_id(spark):
    bench = say(1, 12)
    rows = [(1, bench + " tail tail"), (1, say(2, 14)), (1, None), (None, bench), (None, say(3, 14)), (2, say(4, 14))]
    docs, items = docs_of(spark, rows), spark.createDataFrame([(7, bench)], "item_id long, text string")
    left = Counter((r.doc_id, r.text) for r in decontaminate.remove_documents(docs, items).collect())
    assert left == Counter([rows[1], rows[2], rows[4], rows[5]])
    cut = Counter((r.doc_id, r.text) for r in decontaminate.remove_spans(docs, items).collect())
    assert cut == Counter([(1, "tail tail"), rows[1], rows[2], (None, ""), rows[4], rows[5]])


def test_near_duplicates_keep_unique_texts_of_a_used_id(spark):
    a, clean = say(5, 60), say(6, 60)
    rows = [(1, a), (5, a), (5, clean), (7, a + " more"), (7, say(8, 60)), (9, a), (9, a)]
    kept = Counter((r.doc_id, r.text) for r in jaccard_join.keep_one(docs_of(spark, rows)).collect())
    assert kept == Counter([(1, a), (5, clean), (7, rows[4][1])])
    both = [(3, a), (3, a + " x"), (4, a)]  # two texts of the smallest id resemble each other: one stays
    assert len(jaccard_join.keep_one(docs_of(spark, both)).collect()) == 1


def test_vectors_keep_others_of_a_used_id(spark):
    rng = np.random.default_rng(1)
    v, w = ([float(x) for x in rng.normal(size=8)] for _ in range(2))
    rows = [(1, v, 0), (5, v, 0), (5, w, 0), (6, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.embedding) for r in embedding_dedup.keep_one(df).collect() if r.embedding) == sorted([(1, v), (5, w)])


def test_wide_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 1500))
    rows = [(k, [float(x) for x in base[k % 6] + (0.01 * rng.normal(size=1500) if k >= 6 else 0)], "a") for k in range(12)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), tile=4).collect()}
    assert got == {k: (1, k % 6) for k in range(12)}


def test_archives_with_string_ids(spark):
    rows = [("a", "u", "x" * 1500), ("b", "u", "x" * 1500), ("c", None, None)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    folder = warc.archive_folder(pages)
    manifest = materialize(warc.write_archives(pages, folder), "manifest")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(manifest, folder, "string").collect()}
    assert got == {"a": ("revisit", "b"), "b": ("response", None), "c": ("response", None)}


# ---------------------------------------------------------------- sizes


@pytest.mark.parametrize("total", [1, 799, 800, 801, 10**9, 10**12, 10**15])
def test_sample_threshold_is_exact_at_every_size(total):
    share = common.sample_threshold(800, total) / common.SAMPLE_SPACE
    assert share == 1 if total <= 800 else share * total == pytest.approx(800, rel=1e-6)
    assert common.sample_threshold(800, total) > 0


def test_sample_hash_takes_its_share(spark):
    n = 40_000
    rows = spark.range(n).withColumnRenamed("id", "doc_id")
    got = rows.where(common.sample_hash("fit", "doc_id") < common.sample_threshold(8_000, n)).count()
    assert abs(got - 8_000) < 500


def test_slices_by_rows_and_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 3000] * 20 + ["y" * 200_000])], ["text"])
    parts = list(common.slices(iter([batch]), rows=8, size=10_000))
    assert sum(p.num_rows for p in parts) == 21 and max(p.num_rows for p in parts) <= 4 and parts[-1].num_rows == 1


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, other=None):
            return dict.get(self, key, other)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Session())
    Context.getCheckpointDir = staticmethod(lambda: "hdfs://shared/folder/1234-uuid")
    assert common.shared_dir(Session()) == "hdfs://shared/folder"


def test_token_counts_of_empty_tables_and_long_words(spark):
    assert token_counts.count_tokens(docs_of(spark, [])).count() == 0
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs_of(spark, [(1, "ab " * 30_000), (2, "q" * 30_000), (3, None), (4, "ab")])).collect()}
    assert rows[1].n_words == 30_000 and rows[1].n_tokens == 30_000 * rows[4].n_tokens and rows[2].n_words == 1 and rows[2].n_tokens == rows[2].most_in_word >= 1 and rows[3].n_tokens == 0


def test_memory_keeps_what_recurs():
    made = Counter()

    def make(key):
        made[key] += 1
        return key.encode()

    memory = packing._Memory(make, 10)
    for k in range(500):
        assert memory["often"] == b"often" and memory[f"rare{k}"] == f"rare{k}".encode()
    assert made["often"] == 1 and len(memory) + len(memory.older) <= 20


def test_buckets_hold_equal_lengths(spark, tmp_path):
    pieces = packing.pack(docs_of(spark, [(1, say(1, 300)), (2, None)]))
    packing.write_buckets(pieces, f"{tmp_path}/b")
    back = spark.read.parquet(f"{tmp_path}/b")
    assert back.count() == pieces.count() and back.where(F.length("ids") != 4 * F.pow(F.lit(2), F.col("bucket"))).count() == 0


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_removes_passages_of_51_words(spark, tmp_path):
    import corpus_pipeline as pipeline

    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 6))) for _ in range(2000)]
    passage = " ".join(rnd.choice(words) for _ in range(55))
    assert 240 <= len(passage) < 400
    rows = [(k, " ".join(rnd.choice(words) for _ in range(80)) + " " + passage + " " + " ".join(rnd.choice(words) for _ in range(80))) for k in range(3)]
    left = pipeline.drop_repeats(spark, docs_of(spark, rows), str(tmp_path)).collect()
    assert len(left) == 3 and all(passage[20:-20] not in r.text and r.n_chars == len(r.text) for r in left)


# ---------------------------------------------------------------- plain versions


def test_recall_of_the_join(spark):
    """Ids divisible by 50 against all rows, on sets: every link is found."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, re.findall(common.WORD_PATTERN, (r.text or "").lower())) for r in docs.select("doc_id", "text").collect()]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in rows}
    got = {r.doc_id: r.class_id for r in jaccard_join.near_duplicates(docs).collect()}
    pairs = [(i, j) for i in sets if i % 50 == 0 for j in sets if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert all(got[i] == got[j] for i, j in pairs)


def test_language_against_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect():
        data = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in (r.text or "").encode())
        tf = np.zeros(language_id.DIMENSIONS)
        for k in range(len(data) - 2):
            code = data[k] << 16 | data[k + 1] << 8 | data[k + 2]
            if code != 0x202020:
                tf[(code * 0x9E3779B1 % 2**32) >> 21] += 1
        v = np.log1p(tf) * model.idf
        near = (v / max(np.linalg.norm(v), 1e-12)) @ model.centroids.T.astype(float)
        best = defaultdict(lambda: -1.0)
        for lang, c in zip(model.languages, near, strict=True):
            best[lang] = max(best[lang], c)
        ranked = sorted(best.values())
        want = max(sorted(best), key=best.get) if any(ch.isalpha() for ch in r.text or "") else "und"
        assert got[r.doc_id].lang_pred == want or len(ranked) > 1 and ranked[-1] - ranked[-2] < 1e-5
        if want != "und":
            assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(language_id.SHARPNESS * (x - ranked[-1])) for x in ranked), abs=1e-4)
    found = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred != 'und'")
    assert found.where("lang = lang_pred").count() >= 0.9 * found.count()


def plain_toxicity(model, text):
    """Every rule by looking around each word of a clause."""
    word = {w: ("report", 0.0) for w in toxicity.REPORTS} | {w: ("negation", 0.0) for w in toxicity.NEGATIONS} | {w: ("target", 0.0) for w in toxicity.TARGETS} | {w: ("object", 0.0) for w in toxicity.OBJECTS} | {w: ("threat", 1.0) for w in toxicity.THREATS} | {w: ("insult", 1.0) for w in toxicity.INSULTS} | model.lexemes
    clean = 1 - model.unmatched
    for clause in re.split(r"[.!?;\n]", (text or "").lower()):
        w = re.findall(r"[^\W\d_]+", clause)
        kind = [word.get(x) or max(((c, p) for s, (c, p) in model.stems.items() if x.startswith(s)), key=lambda q: q[1], default=("other", 0.0)) for x in w]
        best = 0.0
        for k, (c, weight) in enumerate(kind):
            if c not in ("insult", "threat") or not weight:
                continue
            ahead = lambda n, *names: any(q in names for q, _ in kind[max(0, k - n) : k])  # noqa: B023, E731
            behind = any(q in ("target", "object") for q, _ in kind[k + 1 : k + 1 + toxicity.REACH])
            label = "negated" if ahead(3, "negation") else "reported" if ahead(k, "report") else "target" if ahead(4, "object") or (c == "insult" and ahead(4, "target")) or behind else ""
            best = max(best, weight * model.labels[f"{c}+{label}" if label else c])
        clean *= 1 - best
    return min(1.0, max(0.0, 1 - clean))


def test_toxicity_against_plain_version(spark):
    rnd = random.Random(9)
    pool = [*toxicity.INSULTS[:4], *toxicity.THREATS[:3], *toxicity.TARGETS[:5], *toxicity.OBJECTS[:3], *toxicity.NEGATIONS[:3], *toxicity.REPORTS[:3], "zorgling", "zorgs", "plain", "word", "more", ".", "!", "\n"]
    model = toxicity.Model({"plainly": ("insult", 0.8)}, {"zorg": ("insult", 0.9), "zorgl": ("threat", 0.95)})
    rows = [(k, " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40)))) for k in range(400)] + [(900, None), (901, ""), (902, "zorgling " + "word " * 40_000), (0, "idiot")]
    got = [(r.doc_id, r.score) for r in toxicity.score(docs_of(spark, rows), model).collect()]
    want = sorted((i, plain_toxicity(model, t)) for i, t in rows)
    assert [i for i, _ in sorted(got)] == [i for i, _ in want] and max(abs(a[1] - b[1]) for a, b in zip(sorted(got), want, strict=True)) < 1e-9
    data = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(data, spark.read.parquet(f"{SMALL}/labels.parquet"))
    got = {r.doc_id: r.score for r in toxicity.score(data, model).collect()}
    assert max(abs(got[r.doc_id] - plain_toxicity(model, r.text)) for r in data.collect()) < 1e-9


def test_the_path_decides(spark):
    """Labels that separate: a threat word is toxic only when it is aimed, an insult only when it is neither negated nor reported."""
    rnd = random.Random(12)
    fill = lambda n: " ".join("w" + "".join(rnd.choice("klmnop") for _ in range(5)) for _ in range(n))
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        clause = f"{fill(1)} will smash {fill(1)} you {fill(2)}" if bad else f"{fill(1)} will smash {fill(4)}"
        rows.append((i, f"{fill(12)}. {clause}. {fill(10)}."))
        labels.append((i, int(bad)))
    docs = docs_of(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.lexemes["smash"][0] == "threat"
    reader = model.classes()
    score = lambda t: reader.score(reader.matches(t))
    assert score("they will smash you") >= 0.3 > score("they will smash the record")
    plain = toxicity.Model().classes()
    score = lambda t: plain.score(plain.matches(t))
    assert score("you are an idiot") >= 0.3 > max(score("he is not an idiot"), score("she said that idiot left"))
    assert score("I will kill you") >= 0.3 > max(score("they kill time"), score("nobody wants to kill"))


def test_long_words_are_learned_whole(spark):
    long = "z" * 60
    rows = [(i, say(i, 20) + (f" {long} {long}" if i % 3 == 0 else "")) for i in range(240)]
    model = toxicity.fit(docs_of(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int"))
    assert long in model.lexemes


def test_quality_against_plain_version(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, labels, model, F.col("source"), F.col("lang")).collect()}
    rows = docs.collect()
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    y = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None and r.quality is not None and not held(r.doc_id)}
    paths = defaultdict(lambda: [0, 0])
    for r in rows:
        paths[r.source, r.lang]
        if r.doc_id in y:
            paths[r.source, r.lang][0] += y[r.doc_id]
            paths[r.source, r.lang][1] += 1
    base = (sum(g for g, _ in paths.values()) + 1) / (sum(n for _, n in paths.values()) + 2)

    def strength(groups):
        used = [(g, n, p) for g, n, p in groups if n]
        v = sum(n * ((g / n - p) ** 2 - p * (1 - p) / n) for g, n, p in used)
        pq = sum(n * p * (1 - p) for _, n, p in used)
        return 1000.0 if not used or not pq or v <= 0 else min(1000.0, max(1.0, pq / v - 1))

    hosts = defaultdict(lambda: [0, 0])
    for (h, _), (g, n) in paths.items():
        hosts[h][0] += g
        hosts[h][1] += n
    k = strength([(g, n, base) for g, n in hosts.values()])
    rate = {h: (g + k * base) / (n + k) for h, (g, n) in hosts.items()}
    m = strength([(g, n, rate[h]) for (h, _), (g, n) in paths.items()])
    odds = lambda p: math.log(p / (1 - p))
    import pyarrow as pa

    for r in rows:
        g, n = paths[r.source, r.lang]
        path = (g + m * rate[r.source]) / (n + m)
        own = float(model.logit(quality.features(pa.array([r.text], pa.string())))[0])
        assert got[r.doc_id].host_rate == pytest.approx(rate[r.source], abs=1e-9) and got[r.doc_id].path_rate == pytest.approx(path, abs=1e-9)
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-(own + odds(path) - odds(base)))), abs=1e-9)
