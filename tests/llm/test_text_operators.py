"""Operators over texts against plain versions on small fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from readloom.llm import common, decontaminate, jaccard_join, language_id, packing, quality, suffix_dedup, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, t long, item string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, 7, 7, "clash") for i, t in rows], DOCS)


def words_of(text):
    return re.findall(common.WORD_PATTERN, (text or "").translate(str.maketrans(common.UPPER, common.LOWER)))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base = [say(rnd.randint(20, 120)) for _ in range(25)]
    passage = say(140)
    rows = list(enumerate(base))
    rows += [(100, base[0]), (101, base[0].upper() + "!"), (102, base[0] + " " + say(2)), (103, None), (104, ""), (105, "  ..!"), (106, "one two"), (107, "one two"), (108, "word")]
    rows += [(200 + k, say(10 + k) + ". " + passage + ". " + say(12)) for k in range(6)]
    rows += [(300, "la " * 900), (301, base[3] + " " + base[3]), (302, say(6000))]
    rows += [(0, base[0]), (None, base[1]), (5, "another text under a used id " + say(30))]
    return rows


# ---------------------------------------------------------------- decontamination


def plain_decontamination(rows, items, width):
    windows = {}
    for iid, text in items:
        w = words_of(text)
        n = min(len(w), width)
        for k in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(iid))
    out = Counter()
    for i, text in rows:
        w = words_of(text)
        hit, found = set(), set()
        for g, ids in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= ids
        out[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


def item_rows(texts):
    by = dict(texts)
    return [(1, " ".join(by[2].split()[3:18])), (10, by[2]), (2, "ONE, two!"), (3, None), (4, "..."), (11, by[200]), (10, by[2])]


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontamination(spark, texts, bound):
    items = spark.createDataFrame(item_rows(texts), "item_id long, text string")
    found = decontaminate.analyze(frame(spark, texts), items, broadcast_windows=bound)
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect())
    assert got == plain_decontamination(texts, item_rows(texts), 10)


def test_decontamination_removals(spark, texts):
    items = spark.createDataFrame(item_rows(texts), "item_id long, text string")
    docs = frame(spark, texts)
    clean = {i for i, *_, c in plain_decontamination(texts, item_rows(texts), 10) if not c}
    dirty = {i for i, *_, c in plain_decontamination(texts, item_rows(texts), 10) if c}
    kept = decontaminate.remove_documents(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == clean - dirty
    spans = decontaminate.remove_spans(docs, items)
    assert spans.columns == docs.columns and spans.count() == len(texts)
    again = decontaminate.analyze(spans, items).where("n_words > 0")
    by = {r.doc_id: r for r in spans.collect()}
    assert by[7].text == dict(texts)[7] and by[103].text is None
    assert by[106].text == "" and by[2].text.strip() == ""
    assert again.where("doc_id in (200, 106, 2) and contaminated").count() == 0


def test_decontamination_empty_tables(spark, texts):
    items = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.analyze(frame(spark, texts[:4]), items).collect()
    assert len(rows) == 4 and not any(r.contaminated for r in rows)
    assert decontaminate.analyze(frame(spark, []), spark.createDataFrame(item_rows(texts), "item_id long, text string")).count() == 0


# ---------------------------------------------------------------- n-gram Jaccard join


def plain_classes(rows, width=5, threshold=0.8):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    n = len(rows)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    firsts = {}
    for i, (doc, _) in enumerate(rows):
        if sets[i] and doc is not None:
            firsts[find(i)] = min(firsts.get(find(i), doc), doc)
    return Counter((rows[i][0], firsts.get(find(i)) if sets[i] else rows[i][0], links[i]) for i in range(n))


@pytest.mark.parametrize("block", [96, 2])
def test_jaccard_join(spark, texts, block):
    """block 2 sends every bucket and group through leaders and blocks."""
    found = jaccard_join.near_duplicates(frame(spark, texts), block=block)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found.collect()) == plain_classes(texts)


def test_jaccard_join_keeps_one(spark, texts):
    docs = frame(spark, texts)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter(r.doc_id for r in kept.collect())
    classes = {d: c for d, c, _ in plain_classes(texts)}
    assert all(got[d] == 1 for d in (0, 2, 103, 104, 105, 106, 108, 300)) and not got[100] and not got[107]
    assert all(d is None or classes[d] == d or d == 5 for d in got)
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0


def test_hot_near_group(spark):
    """A group of near copies that no bucket may hold in one task, with links below and above the threshold."""
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    found = jaccard_join.near_duplicates(frame(spark, rows), block=8)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found.collect()) == plain_classes(rows)


def test_banding_reaches_recall():
    for t in (0.5, 0.8, 0.9):
        bands, rows = jaccard_join.choose_bands(t, 0.999)
        assert 1 - (1 - t**rows) ** bands >= 0.999


# ---------------------------------------------------------------- suffix-array dedup


def plain_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = Counter()
    for (i, _), b in zip(rows, data, strict=True):
        mark = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mark[k : k + length] = True
        kept = bytes(v for v, m in zip(b, mark, strict=False) if not m)
        runs = int((mark[1:] & ~mark[:-1]).sum() + mark[0])
        out[i, len(b), int(mark.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("length", "gram", "most"), [(400, 32, 64), (60, 8, 64), (60, 8, 2)])
def test_suffix_dedup(spark, texts, length, gram, most):
    """most 2 cuts nearly every shared key into blocks."""
    found = suffix_dedup.analyze(frame(spark, texts), length=length, gram=gram, most_units=most, blocks=(8, 3, 1))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect())
    assert got == plain_repeats(texts, length)


def test_suffix_dedup_removes(spark, texts):
    docs = frame(spark, texts)
    kept = suffix_dedup.remove_repeats(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {103, 104, 106, 302} <= ids and 300 not in ids
    assert suffix_dedup.analyze(frame(spark, [])).count() == 0


def test_suffix_dedup_of_texts_in_several_segments(spark):
    """A text longer than CHUNK is hashed in segments; the passage starts in two of them and crosses a border in another text."""
    rnd, length = random.Random(11), 400
    say = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    passage, border = say(3000), suffix_dedup.CHUNK
    long = say(100_000) + passage + say(1_397_000) + passage + say(97_000)
    rows = [(1, long), (2, "la " * 500_000), (3, say(border - 1000) + passage + say(500_000)), (4, long), (5, say(700) + passage + say(700)), (6, say(2000))]
    data = {i: t.encode() for i, t in rows}
    hashes = {i: np.array([hash(b[k : k + length]) for k in range(len(b) - length + 1)]) for i, b in data.items()}
    values, counts = np.unique(np.concatenate(list(hashes.values())), return_counts=True)
    repeated = values[counts > 1]
    want = Counter()
    for i, b in data.items():
        starts = np.flatnonzero(np.isin(hashes[i], repeated))
        mark = np.zeros(len(b) + 1, dtype=np.int64)
        mark[starts] += 1
        mark[starts + length] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        want[i, int(gone.sum()), hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in suffix_dedup.analyze(frame(spark, rows)).collect()) == want
    one = suffix_dedup.analyze(frame(spark, [rows[0]])).collect()[0]
    assert one.n_spans == 2 and [s["from"] // 1000 for s in one.spans] == [100, 1500] and 6000 <= one.n_removed <= 6020


def test_run_length_index():
    rnd = random.Random(2)
    for _ in range(60):
        texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 30))).encode() for _ in range(5)]
        texts += [texts[0], b"\x00" * 9]
        group = np.array([0, 0, 1, 1, 0, 1, 0])
        index = suffix_dedup.RunLengthIndex(texts, group)
        marked = np.cumsum(index.long_matches(6)[:-1]) > 0
        seen = Counter((g, t[k : k + 6]) for t, g in zip(texts, group, strict=True) for k in range(len(t) - 5))
        want = [seen[g, t[k : k + 6]] > 1 if k <= len(t) - 6 else False for t, g in zip(texts, group, strict=True) for k in range(len(t))]
        assert marked.tolist() == want


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 50, 997).astype(np.uint64)
    for w in (1, 2, 7, 100, 997):
        assert suffix_dedup.sliding_min(x, w).tolist() == [x[k : k + w].min() for k in range(len(x) - w + 1)]


# ---------------------------------------------------------------- token counts and packing


def test_token_counts(spark, texts):
    pieces = set(token_counts.vocabulary(token_counts.default_vocabulary()))

    def greedy(word):
        s, i, n = (*word.lower().encode(), token_counts.END), 0, 0
        while i < len(s):
            for j in range(min(len(s), i + 60), i, -1):
                if s[i:j] in pieces:
                    i, n = j, n + 1
                    break
            else:
                return 1
        return n

    found = token_counts.count_tokens(frame(spark, texts))
    want = Counter((i, len((t or "").split()), sum(map(greedy, (t or "").split())), max(map(greedy, (t or "").split()), default=0)) for i, t in texts)
    assert Counter((r.doc_id, r.n_words, r.n_tokens, r.most_in_word) for r in found.collect()) == want


def test_automaton_on_random_vocabularies():
    rnd = random.Random(1)
    for _ in range(200):
        pieces = [tuple(rnd.choice([0, 1, 256]) for _ in range(rnd.randint(1, 5))) for _ in range(10)]
        automaton, known = token_counts.Automaton(pieces), set(pieces)
        for _ in range(30):
            s = (*(rnd.choice([0, 1]) for _ in range(rnd.randint(1, 12))), 256)
            i = n = 0
            while i < len(s):
                j = next((j for j in range(len(s), i, -1) if s[i:j] in known), None)
                if j is None:
                    n = 1
                    break
                i, n = j, n + 1
            assert automaton.count(s) == n


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    rows = [*texts, (400, "it's I'D <|endoftext|> ² ª\x1cb c\x85d\xa0e İ 日本 é"), (401, "x" * 70_000)]
    pieces = packing.pack(frame(spark, rows)).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    assert all(p.offset == 0 and p.length == 1 << p.bucket <= 4096 and len(p.ids) == 4 * p.length for p in pieces)
    found = []
    for p in sorted(pieces, key=lambda p: p.sequence_id):  # the pieces of a row follow each other
        if p.start == 0:
            found.append((p.doc_id, p.doc_tokens, []))
        assert (p.doc_id, p.doc_tokens) == found[-1][:2] and p.start == sum(q.length for q in found[-1][2])
        found[-1][2].append(p)
    want = Counter((i, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    assert Counter((i, tuple(np.frombuffer(b"".join(p.ids for p in own), dtype="<u4").tolist())) for i, _, own in found) == want
    assert all(n == sum(p.length for p in own) for _, n, own in found)
    assert packing.pack(frame(spark, [])).count() == 0


def test_piece_lengths():
    for n in (1, 2, 4095, 4096, 4097, 12345):
        parts = packing.piece_lengths(n)
        assert sum(parts) == n and parts == sorted(parts, reverse=True) and all(p & (p - 1) == 0 for p in parts)


# ---------------------------------------------------------------- classifiers


def test_language(spark):
    rnd = random.Random(3)
    sounds = {"aa": "abcde", "bb": "vwxyz", "cc": "ñéüöä"}
    say = lambda k: " ".join("".join(rnd.choice(sounds[k]) for _ in range(5)) for _ in range(30))
    rows = [(i, say(k), k) for i, k in enumerate(list(sounds) * 60)] + [(900, None, "aa"), (901, "", "bb"), (902, "123 !", "cc"), (903, say("aa"), None), (None, say("bb"), "bb")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    found = language_id.predict(docs, language_id.fit(docs))
    got = {r.doc_id: r for r in found.collect()}
    assert all(got[i].lang_pred == k for i, t, k in rows if k and t and i not in (902,))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, "qqqq jjjj kkkk " * 20)], "doc_id long, text string")
    assert language_id.predict(odd, language_id.fit(docs)).head().rejected
    empty = docs.limit(0)
    assert language_id.fit(empty) is None and language_id.predict(docs, None).where("lang_pred != 'und'").count() == 0


def test_trigram_counts():
    tf = language_id.counts(pa.array(["Ab1c", None, "", "aaaa"]))
    assert tf.sum(axis=1).tolist() == [2, 0, 0, 2] and (tf[3] > 0).sum() == 1


def test_toxicity(spark):
    rnd = random.Random(4)
    say = lambda n: [f"w{rnd.choice('abcdefgh')}{rnd.choice('klmnop')}o" for _ in range(n)]
    rows, labels = [], []
    for i in range(400):
        w, bad = say(40), i % 5 == 0
        if bad:
            for _ in range(2):
                w.insert(rnd.randrange(40), rnd.choice(["zorgling", "zorgment", "zorgish", "zorgoid", "blarf"]))
        rows.append((i, " ".join(w) + "."))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (None, "blarf"), (902, "x " * 50_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    told = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, told)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, _, t in labels)
    assert got[900] == got[901] < 0.3 and all(0 <= s <= 1 for s in got.values())
    kept = toxicity.remove_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.3}
    blank = toxicity.fit(docs, told.limit(0))
    assert toxicity.score(docs.limit(0), blank).count() == 0


def test_grammar_paths():
    reader = toxicity.Model().classes()
    label = lambda t: [m[0] for m in reader.matches(t)]
    assert label("what an idiot") == ["insult"]
    assert label("you are an idiot") == ["insult+target"]
    assert label("he is not an idiot")[0] == "insult+negated"
    assert label("she said that idiot left. fine") == ["insult+reported"]
    assert label("nobody. nothing") == [] and len(label("idiot. moron! fine; scum")) == 3


def test_quality(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = rnd.random() < 0.3
        w = ["".join(rnd.choice("abcdefg") for _ in range(4)) for _ in range(30)]
        rows.append((i, ("!! ".join(w).upper() if bad else " ".join(w)), f"h{i % 7}", "p" if i % 2 else None))
        labels.append((i, int(not bad)))
    rows += [(900, None, "h1", "p"), (901, "", None, None), (None, "text", "h1", "p")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, lang string, score string")
    told = spark.createDataFrame([*labels, (1, None)], "doc_id long, quality int")
    from pyspark.sql import functions as F

    found = quality.score(docs, told, quality.fit(docs, told), F.col("source"), F.col("lang"))
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([(got[i].score >= 0.5) == bool(q) for i, q in labels]) > 0.97
    none = quality.score(docs, told.limit(0), None, F.col("source"), F.col("lang"))
    assert all(abs(r.score - 0.5) < 1e-9 for r in none.collect())


def test_sparse_sites_shrink(spark):
    from pyspark.sql import functions as F

    rows = [(i, "", f"big{i % 4}", "p") for i in range(400)] + [(1000 + i, "", "tiny", "p") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    told = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(1000 + i, 0) for i in range(3)], "doc_id long, quality int")
    rate = {r.host: r.rate for r in quality.score(docs, told, None, F.col("source"), F.col("lang")).join(docs.select("doc_id", F.col("source").alias("host")), "doc_id").groupBy("host").agg(F.max("host_rate").alias("rate")).collect()}
    assert rate["big0"] < 0.1 < rate["tiny"] < 0.74 < rate["big1"]


def test_word_hashes_match_words(texts):
    column = pa.array([t for _, t in texts])
    hashes, bounds = common.word_hashes(*common.text_bytes(column))
    flat = [w for _, t in texts for w in words_of(t)]
    assert np.diff(bounds).tolist() == [len(words_of(t)) for _, t in texts]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(flat, hashes, strict=True)) and len(set(seen.values())) == len(seen)
    assert common.text_bytes(column[3:5])[1].tolist() == [0, len(texts[3][1].encode()), len(texts[3][1].encode()) + len(texts[4][1].encode())]
