"""Text operators against brute force, and odd tables."""

import re
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from threadmill.llm import linededup, neardup, quality, simhash, toxicity
from threadmill.llm.common import held_out
from threadmill.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


# SimHash


def plain_fingerprint(text, width):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, bits):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", ["", "  \t", "One", "One two THREE", "É É a b c d e", "a\x0bb\x0cc d\xa0e f", "x " * 40])
@pytest.mark.parametrize("width", [1, 4, 5])
def test_fingerprint(text, width):
    assert int.from_bytes(simhash.fingerprint(text.encode(), width), "big") == plain_fingerprint(text, width)


def test_groups_equal_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(25):
        base = words(rng, 120).split()
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            texts.append(" ".join(copy))
    texts += ["", None, "  ", texts[0], texts[0], words(rng, 30000)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(docs(spark, enumerate(texts)), 4, 4).collect()}
    assert got == dict(enumerate(plain_groups([plain_fingerprint(t, 4) for t in texts], 4)))
    kept = simhash.keep_one(docs(spark, enumerate(texts)), 4, 4)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 8)
    monkeypatch.setattr(simhash, "HELD_ROWS", 50)
    rng = random.Random(2)
    prints = []
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            prints.append(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4)
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    want = plain_groups(prints, 4)
    got = [root.get(s, s) for s in signed]
    pairs = lambda labels: {(i, j) for i in range(len(labels)) for j in range(i) if labels[i] == labels[j]}
    assert pairs(got) == pairs(want)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_without_id_or_rows(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, "q w e r t y")]
    assert sorted((r["doc_id"] or -1) for r in simhash.keep_one(docs(spark, rows)).collect()) == [-1, 2, 3]
    assert simhash.groups(docs(spark, [])).count() == 0


def test_texts_of_one_id_are_no_copies(spark):
    import threadmill.llm.neardup as near

    rows = [(1, "one two three four five six"), (1, "entirely other words stand in here"), (1, "one two three four five six"), (2, "one two three four five six")]
    want = sorted({rows[0][1], rows[1][1]})
    for kept in (simhash.keep_one(docs(spark, rows)), near.keep_one(docs(spark, rows))):
        assert sorted(r["text"] for r in kept.collect()) == want


def test_columns_of_any_name_stay(spark):
    """Helper columns make way for a caller's own."""
    from pyspark.sql import functions as F

    import threadmill.llm.neardup as near

    mine = {c: F.lit("MINE") for c in ("__text", "__TEXT_", "__node", "__Node_", "root", "node", "fp")}
    frame = docs(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "others stand in here now")]).withColumns(mine)
    for kept in (simhash.keep_one(frame), near.keep_one(frame)):
        assert kept.columns == frame.columns
        assert sorted((r["doc_id"], *(r[c] for c in mine)) for r in kept.collect()) == [(1, *["MINE"] * len(mine)), (3, *["MINE"] * len(mine))]


# Near copies


def test_sketches_lose_no_pair_at_the_similarity():
    rng = np.random.default_rng(3)
    functions, most, worst = neardup._functions(), neardup.most_apart(0.8), 0
    for _ in range(400):
        shared = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        pair = [neardup.sketch(neardup.minima(np.append(shared, rng.integers(0, 1 << 63, 10, dtype=np.uint64)), functions)) for _ in range(2)]
        worst = max(worst, sum((int(x) ^ int(y)).bit_count() if x * y >= 0 else ((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(*pair)))
    assert worst <= most < 150 / 2


def test_texts_of_one_hash_are_kept_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(k, f"text {k // 2} of several words and more") for k in range(12)] + [(20, None), (21, "")]
    want = [0, 2, 4, 6, 8, 10, 20]
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs(spark, rows)).collect()) == want
    monkeypatch.setattr(neardup, "_node", lambda: F.pmod(F.xxhash64(neardup._text()), F.lit(3)))
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs(spark, rows)).collect()) == want


def test_near_copies_equal_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(9)
    texts = []
    for group, copies in enumerate([3] * 20 + [40]):
        base = words(rng, 150).split()
        for _ in range(copies):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randint(0, 4)):
                copy[at] = words(rng, 1)
            texts.append(" ".join(copy))
    texts += ["", None, "  ", "one two", "One  two", "one three", texts[0].upper()]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    apart = 0
    prints = [plain_fingerprint(t, 5) for t in texts]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                apart += (prints[i] ^ prints[j]).bit_count() > 4
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert apart > 50
    want = sorted({find(i) for i in range(len(sets))})
    got = corpus_pipeline.distinct(spark, docs(spark, enumerate(texts)), "")
    assert sorted(r["doc_id"] for r in got.collect()) == want
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, "q w e r t y")]
    assert sorted((r["doc_id"] or -1) for r in neardup.keep_one(docs(spark, rows)).collect()) == [-1, 2, 3]
    assert neardup.keep_one(docs(spark, [])).count() == 0


# Lines


def plain_lines(rows, s):
    lines = []
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            masked = re.sub(r"[^\s\d]*\d\S*", "<*>", line, flags=re.A)
            tokens = tuple(x for x in re.split(r"[ \t\n\x0b\f\r]+", masked) if x)
            if tokens:
                lines.append((d, i, tokens, (len(tokens), tokens[: s.depth])))
    holders = defaultdict(set)
    for d, _, tokens, leaf in lines:
        if len(tokens) >= s.shortest:
            for at, token in enumerate(tokens):
                holders[leaf, at, token].add(d)
    by_template = defaultdict(list)
    for d, i, tokens, leaf in lines:
        template = tokens
        if len(tokens) >= s.shortest:
            fields = tuple(t if len(holders[leaf, at, t]) > 1 else None for at, t in enumerate(tokens))
            kept = sum(f is not None for f in fields)
            if s.fixed * len(tokens) <= kept < len(tokens):
                template = fields
        by_template[leaf, template].append((d, i))
    gone = defaultdict(set)
    for (leaf, _), places in by_template.items():
        if len({d for d, _ in places}) > 1 and (leaf[0] >= s.brief or len(places) >= s.brief_times):
            for d, i in sorted(places)[1 if s.keep_first else 0 :]:
                gone[d].add(i)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


@pytest.mark.parametrize("sent", [0, linededup.SENT_LEAVES])
@pytest.mark.parametrize("keep_first", [True, False])
def test_lines_equal_brute_force(spark, keep_first, sent, monkeypatch):
    monkeypatch.setattr(linededup, "SENT_LEAVES", sent)
    rng = random.Random(5)
    fixed = [words(rng, n) for n in (2, 4, 12, 60)]
    rows = []
    for d in range(40):
        lines = [words(rng, rng.randint(1, 15)) for _ in range(3)]
        lines += [rng.choice(fixed), f"user {d} logged in from 10.0.0.{d} and then went out again at {d}:30 today"]
        lines.append(f"the order for {words(rng, 1)} was sent to the shop and paid in full by card")
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1]), (104, "w " * 20000)]
    s = linededup.Settings(keep_first=keep_first)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs(spark, rows), s).collect()}
    assert got == plain_lines(rows, s)


def test_lines_of_odd_tables(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(None, passage), (None, passage), (5, passage), (5, passage)]
    frame = docs(spark, rows).withColumnRenamed("source", "n_dropped")
    got = sorted(((r["doc_id"] or -1), r["text"]) for r in linededup.dedup(frame).collect())
    assert got == [(-1, passage), (-1, passage), (5, ""), (5, "")]
    assert linededup.dedup(docs(spark, [])).count() == 0


def test_one_text_of_many_lines(spark):
    lines = [f"this very line number word{'abc'[i % 3]}x{chr(97 + i % 26)} is said again" for i in range(200_000)]
    rows = [(1, "a first text\n" + lines[0]), (2, "\n".join(lines) + "\nand its own end")]
    got = {r["doc_id"]: r for r in linededup.dedup(docs(spark, rows).withColumn("__gone", linededup.F.lit(1))).collect()}
    assert got[1]["n_dropped"] == 0 and got[2]["n_lines"] == 200_001
    assert got[2]["n_dropped"] == 200_000 and got[2]["text"] == "and its own end"


def test_every_line_that_recurs_goes_if_asked_for(spark):
    rows = [(1, "short foot\nalone here"), (2, "other text\nshort foot"), (3, "x\nshort foot"), (4, "x\nbye now"), (5, "one two three red five"), (6, "one two three blue five")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.dedup(frame).collect()} == dict(rows)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(frame, linededup.EVERY_LINE).collect()}
    assert got == {1: rows[0][1], 2: "other text", 3: "x", 4: "bye now", 5: rows[4][1], 6: ""}


def test_short_templates_need_many_lines(spark):
    names = ["".join(chr(97 + (i * 7 + k * k) % 26) for k in range(6)) + str() for i in range(26)]
    line = "posted here by {} in our section".format
    few = linededup.dedup(docs(spark, [(i, line(n)) for i, n in enumerate(names[:6])])).where("n_dropped > 0").count()
    many = linededup.dedup(docs(spark, [(i, line(n)) for i, n in enumerate(names)])).where("n_dropped > 0").count()
    assert (few, many) == (0, 25)


@pytest.mark.parametrize("size", [10, 1000, 100_000])
def test_worded_fields_at_any_size(spark, size):
    rng = random.Random(size)
    people, places = (["".join(rng.choices("abcdefghij", k=9)) for _ in range(500)] for _ in range(2))
    line = "this notice was sent to the reader {} by our office in {} today".format
    rows = [(i, line(rng.choice(people), rng.choice(places))) for i in range(size)]
    # copies of one document do not make its values fixed
    rows += [(size + i, rows[0][1]) for i in range(min(size, 1000))] if size > 10 else []
    cleaned = linededup.dedup(docs(spark, rows))
    assert cleaned.where("n_dropped = 0").count() <= max(2, size // 100)


def test_rows_of_numbers_are_no_template(spark):
    import corpus_pipeline

    table = ["12.5 13.7 14.2 15.0 16.1", "1 2 3 4 5", "mean 1 2 3 4 5 6", "mean 7 8 9 1 2 3"]
    rows = [(i, "\n".join([line, f"page {i} of the printed report of this year"])) for i, line in enumerate(table)]
    rows += [(9, "another text\n" + table[0])]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_lines(spark, docs(spark, rows), "").collect()}
    assert got == {0: rows[0][1], 1: table[1], 2: table[2], 3: table[3], 9: "another text"}


# Classifiers


def labelled(spark, rng, rows, make):
    texts, labels = [], []
    for i in range(rows):
        label = i % 2
        texts.append((i, make(rng, label)))
        labels.append((i, label))
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("doc_id", "quality", "quality AS toxic")


def check_scores(scored, labels, name, least, wanted=0.5):
    rows = scored.join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert rows.score.between(0, 1).all() and len(held)
    assert (rows.predicted == (rows.score >= wanted).astype(int)).all()
    assert (held.predicted == held[name]).mean() >= least


def test_quality(spark):
    def make(rng, label):
        text = words(rng, rng.randint(5, 60))
        return text if label else re.sub(" ", rng.choice(["%%% ", "$$$ "]), text)

    frame, labels = labelled(spark, random.Random(3), 300, make)
    net = quality.fit(frame, labels, quality.Settings(slots=1024, epochs=40))
    check_scores(quality.score(spark, frame, net), labels, "quality", 0.95)
    odd = docs(spark, [(None, None), (1, ""), (1, ""), (2, "x " * 50000)])
    assert quality.score(spark, odd, net).count() == 4
    assert quality.keep(frame, net).columns == frame.columns
    assert quality.keep(docs(spark, []), net).count() == 0


def test_quality_vectors_count_all_windows():
    s = quality.Settings(slots=16, dims=8, entries=2, window=2)
    places, signs = quality.index_vectors(s)
    texts = [np.array([3, 4, 3, 5], np.int32), np.array([], np.int32), np.array([4], np.int32)]
    want = np.zeros((16, 9), np.int64)
    for t in texts:
        for i, w in enumerate(t):
            want[w, -1] += 1
            for j in range(max(0, i - 2), min(len(t), i + 3)):
                if j != i:
                    for e in range(2):
                        want[w, places[t[j], e]] += signs[t[j], e]
    assert (quality.context_sums(texts, s, places, signs) == want).all()


def test_toxicity(spark):
    def make(rng, label):
        text = words(rng, 40).split()
        if label:
            text.insert(rng.randrange(40), rng.choice(["Zonkish", "zonker", "plaarf"]))
        return " ".join(text)

    frame, labels = labelled(spark, random.Random(4), 400, make)
    model = toxicity.fit(frame, labels)
    scored = toxicity.score(spark, frame, model)
    check_scores(scored, labels, "toxic", 0.97, 0.7)
    some = scored.where("predicted = 1").first()
    assert some["neighbours"] and some["cosines"][0] <= 1 + 1e-9 and some["evidence"]
    odd = docs(spark, [(None, None), (1, ""), (1, ""), (2, "zonkish " * 50000)])
    assert toxicity.score(spark, odd, model).count() == 4
    assert toxicity.keep(frame, model).columns == frame.columns


def test_toxicity_index_is_exact():
    rng = np.random.default_rng(1)
    n, size = 1800, 300
    terms = {f"t{i}": i for i in range(size)}
    index = toxicity.Index(terms, 1 + rng.random(size), np.zeros(n, np.int64), np.arange(n))
    # term i is common, rarer the larger it is; neighbours in order hold like terms
    counts = [{int(t): int(rng.integers(1, 4)) for t in {*(rng.zipf(1.3, 12) % 100), *range(100 + 5 * (row * 36 // n), 105 + 5 * (row * 36 // n))}} for row in range(n)]
    vectors = [index.vector(np.array(sorted(c)), np.array([c[t] for t in sorted(c)])) for c in counts]
    index.fill(vectors)
    assert (index.common >= 0).any() and (index.common < 0).any()
    dense = np.zeros((n, size))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w.astype(np.float32)
    walked = []
    for row in range(0, n, 37):
        rows, cosines, blocks = index.nearest(*vectors[row], 12, skip=row)
        asked = np.zeros(size)
        asked[vectors[row][0]] = vectors[row][1]
        exact = np.round(dense @ asked, 12)
        exact[row] = -1
        best = np.lexsort((np.arange(n), -exact))[:12]
        assert rows.tolist() == [b for b in best if exact[b] > 0]
        assert np.allclose(cosines, exact[rows])
        walked.append(blocks)
    assert np.mean(walked) < index.block_count


def test_toxicity_scores_equal_brute_force(spark):
    """Weights, cosines, votes and calibration again, over a whole table, without the index."""
    rng = random.Random(11)
    vocabulary = [words(rng, 1) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(3, 20)) + (["badly", "badlyish"][: 1 + i % 2] if i % 3 == 0 else [])) for i in range(300)] + ["", None]
    frame = docs(spark, enumerate(texts))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    got = {r["doc_id"]: r for r in toxicity.score(spark, frame, model).collect()}

    def terms(text):
        out = defaultdict(int)
        for w in re.findall(r"[a-z]+", (text or "").lower()):
            out[w] += 1
            if len(w) > 5:
                out[w[:5] + "*"] += 1
        return out

    import math
    import zlib

    train = {}
    for i in range(200):
        if zlib.crc32(str(i).encode()) % 3 != 1:
            train.setdefault(texts[i], i)
    train = sorted(train.values())
    bags = {i: terms(texts[i]) for i in range(len(texts))}
    share = sum(i % 3 == 0 for i in train) / len(train)

    def weight(t):
        bad, good = (sum(t in bags[i] for i in train if (i % 3 == 0) == m) for m in (True, False))
        df = max(1, sum(t in b for b in bags.values()))
        idf = math.log((1 + len(texts)) / (1 + df)) + 1
        if not bad + good:
            return math.log((1 + len(texts)) / 2) + 1
        part = lambda n, rate: n * math.log(n / ((bad + good) * rate)) if n else 0
        return idf * (1 + 6 * math.sqrt(max(0, 2 * (part(bad, share) + part(good, 1 - share)) - 12)))

    weights = {t: weight(t) for b in bags.values() for t in b}

    def unit(b):
        v = {t: (1 + math.log(n)) * weights[t] for t, n in b.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    vectors = {i: unit(b) for i, b in bags.items() if b}

    def vote(i, others):
        near = sorted(((-round(sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()), 10), model.index.ids.tolist().index(j), j) for j in others))
        near = [(1 / (0.05 + math.sqrt(max(0, 2 + 2 * c))), j) for c, _, j in near[:15] if c < 0]
        return (sum(w for w, j in near if j % 3 == 0) + share) / (sum(w for w, _ in near) + 1)

    known = [vote(i, [j for j in train if j != i]) for i in train]
    knots, chances = toxicity.calibrate(np.array(known), np.array([int(i % 3 == 0) for i in train]))
    assert np.allclose(model.knots, knots, atol=1e-6) and np.allclose(model.chances, chances)
    for i in range(300):
        assert abs(got[i]["score"] - np.interp(vote(i, train), knots, chances)) < 1e-4, i
    assert got[300]["score"] == got[301]["score"] == model.silent


@pytest.mark.parametrize("labels", [[], [(0, 1), (2, 1)], [(0, None), (2, None)]])
def test_without_both_labels(spark, labels):
    frame = docs(spark, [(0, "a b c"), (2, "d e f"), (3, None)])
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("doc_id", "toxic", "toxic AS quality")
    assert toxicity.score(spark, frame, toxicity.fit(frame, marks)).count() == 3
    assert quality.score(spark, frame, quality.fit(frame, marks, quality.Settings(slots=64))).count() == 3


def test_held_out(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long").select("doc_id", held_out().alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_toxicity_terms_are_counted_together():
    """Terms of many texts at once, in batches and beyond what a task remembers, as of each alone; any alphabet."""
    rng = random.Random(9)
    odd = ["", "ÄÖÜß Straße straßenbahn", "Я архитектор архитекторы", "İstanbul ﬁnance naïveté", "a1b2_c d", "\x85x\xa0y²z", "ªº µm", "wordsof wordsofa wordsof*", "日本語 テキスト", "x" * 400 + " " + "x" * 400]
    texts = [t.encode() for t in odd + [words(rng, 30) for _ in range(40)] + odd]

    def plain(text):
        out = defaultdict(int)
        for w in re.findall(r"[^\W\d_]+", text.decode().lower()):
            out[w] += 1
            if len(w) > 5:
                out[w[:5] + "*"] += 1
        return dict(out)

    known = {t: i for i, t in enumerate(sorted({t for x in texts[::2] for t in plain(x)}))}
    codes = toxicity.Codes(known)
    names = []
    for terms, times in codes.counts(texts):
        named = dict(zip(codes.values(), codes.keys(), strict=True))
        names.append({named[t]: n for t, n in zip(terms.tolist(), times.tolist(), strict=True)})
        assert (np.diff(terms) > 0).all()
    assert names == [plain(x) for x in texts]


def test_toxicity_walks_together_as_alone():
    rng = np.random.default_rng(2)
    n, size = 3000, 400
    index = toxicity.Index({f"t{i}": i for i in range(size)}, 1 + rng.random(size), np.zeros(n, np.int64), np.arange(n))
    bags = [np.unique(rng.zipf(1.2, 15) % size) for _ in range(n)]
    vectors = [index.vector(b, rng.integers(1, 4, len(b))) for b in bags]
    index.fill(vectors)
    some = [*vectors[:30], (np.zeros(0, np.int64), np.zeros(0))]
    skip = [*range(30), -1]
    for (rows, cosines, walked), v, s in zip(index.walk(some, index.bases(some), 15, skip), some, skip, strict=True):
        alone = index.nearest(*v, 15, s)
        assert rows.tolist() == alone[0].tolist() and np.allclose(cosines, alone[1]) and walked == alone[2] and s not in rows
    assert not len(index.walk(some, index.bases(some), 15, skip)[-1][0])
