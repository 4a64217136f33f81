"""Divergence of sources, fill-in-middle and sharding against plain versions of themselves."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadmill.llm import divergence, fim, queries, sharding
from threadmill.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators might use for themselves.
EXTRA = ("key", "shard", "slot", "n", "form", "part", "range", "names", "rank", "value", "size", "__part", "__place", "lane")


def with_extra(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("mine") for c in EXTRA if c not in df.columns})


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def samples():
    words = ["Alpha", "beta", "GAMMA", "délta", "éé", "中文", "x", "a1b", "naïve", "zeta"]
    texts = [" ".join(words[(k * j + j) % len(words)] for j in range(k % 23)) for k in range(60)]
    texts += [None, "", "\n\t 12", "A" * 70_000 + "é", "b" * 3, "b" * 3, "é" * 40_000, "<P> mark", "tail <M>"]
    return [(k, t, ("en", "fr", None, "")[k % 4], (None, "s1", "s2", "s3", "")[k % 5], 1) for k, t in enumerate(texts)]


# Divergence


def plain_audit(docs, least, top):
    groups, of_lang, held = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in docs:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in found]
        groups[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
    for (lang, _), c in groups.items():
        of_lang[lang].update(c)
    out = []
    for (lang, source), counts in groups.items():
        kept = [w for w, n in held[lang].items() if n >= least]

        def shares(c, kept=kept):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = shares(counts), shares(of_lang[lang])
        pairs = []
        for (other_lang, other), theirs in groups.items():
            if other_lang == lang and other != source:
                r = shares(theirs)
                pairs.append((other, sum(apart(p[w], r[w]) for w in kept)))
        told = [(w, apart(p[w], q[w])) for w in kept if counts[w] and p[w] > q[w]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", told, top)):
            found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [1, 3, 10, 1000])
def test_audit_equals_plain(spark, least):
    docs = samples() * 2
    df = with_extra(spark.createDataFrame(docs, DOCS).repartition(5))
    assert rows(divergence.audit(df, divergence.Settings(least=least, top=4))) == plain_audit(docs, least, 4)


def test_audit_in_small_pieces(spark):
    """Tries that go out often, short pages, narrow ranges, few cells and salted totals give the same rows."""
    docs = samples() + [(k, f"w{chr(97 + k % 26)}{chr(97 + k // 26)} common w", "en", f"s{k % 7}", 1) for k in range(300)]
    small = divergence.Settings(least=2, held=20, page=5, range=10, cells=30, sums=8, sent_groups=0, salts=3)
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    assert sum(map(len, divergence._bounds(divergence._counted(df, small), small.range).values())) > 9
    assert rows(divergence.audit(df, small)) == plain_audit(docs, 2, 10)


def test_audit_of_nothing(spark):
    df = divergence.audit(spark.createDataFrame([], DOCS))
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"] and df.count() == 0
    only = spark.createDataFrame([(1, None, None, None, 1), (2, "", "", "b", 1)], DOCS)
    assert rows(divergence.audit(only)) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.binary(min_size=1, max_size=6), st.dictionaries(st.integers(0, 3), st.integers(1, 300), min_size=1), max_size=12), min_size=1, max_size=4), st.integers(1, 3))
def test_tries_merge(parts, least):
    names = ["d", "a", "c", "b"]
    tries, all_of, held = [], defaultdict(Counter), Counter()
    for part in parts:
        paths = sorted(part)
        cells = [(k, s, n) for k, p in enumerate(paths) for s, n in part[p].items()]
        leaf, source, count = (np.array([c[j] for c in cells], np.int64) for j in range(3))
        trie = divergence.Trie.of(paths, np.ones(len(paths), np.int64), leaf, source, count)
        used, sums, data = trie.page(names)
        assert dict(zip(used, sums)) == {names[s]: sum(x.get(s, 0) for x in part.values()) for x in [part] for s in {s for y in x.values() for s in y}}
        back = divergence.Trie.read(data)
        assert back.paths == paths
        tries.append((used, back))
        for p in paths:
            held[p] += 1
            for s, n in part[p].items():
                all_of[p][names[s]] += n
    found, trie = divergence.merge(tries, least)
    assert trie.paths == sorted(p for p in held if held[p] >= least)
    for k, p in enumerate(trie.paths):
        one = slice(trie.ends[k], trie.ends[k + 1])
        assert {found[s]: n for s, n in zip(trie.sources[one].tolist(), trie.counts[one].tolist())} == dict(all_of[p])


def test_shares_of_large_counts():
    count, total = 3 * 10**14, 9 * 10**14 + 7
    assert divergence.share(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total


# Fill-in-middle


def plain_fim(doc, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    one, two, three, four = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or three % 100 >= 90:
        return doc, len(units), "plain", None, None, text
    a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if four % 100 < 20:
        return doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk,stride", [(1 << 14, 1 << 20), (3, 7), (1, 1)])
def test_fim_equals_plain(spark, chunk, stride):
    docs = samples() if chunk > 100 else [r for r in samples() if len(r[1] or "") < 5000]
    docs += [(None, "no id", "en", "s", 1), (3, docs[3][1], "en", "s", 1), (5, "ends with <", "en", "s", 1), (6, "<P <S <M <", "en", "s", 1)]
    made = fim.transform(with_extra(spark.createDataFrame(docs, DOCS)), fim.Settings(chunk=chunk, stride=stride))
    assert rows(made) == sorted((plain_fim(r[0], r[1]) for r in docs), key=repr)
    back = made.select("doc_id", fim.restored(made.output, made.form).alias("text"))
    assert rows(back) == sorted(((r[0], r[1] or "") for r in docs), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aZ é中\n<>PSM", max_size=30), min_size=1, max_size=6), st.integers(1, 9), st.integers(1, 20))
def test_units(texts, chunk, stride):
    data = [t.encode() for t in texts]
    units = fim.Units(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), chunk, stride)
    for k, text in enumerate(texts):
        found = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]
        assert units.count[k] == len(found) - 1
        assert [units.place(k, r) for r in range(len(found))] == [len(text[:x].encode()) for x in found]


def test_fim_of_nothing(spark):
    assert fim.transform(spark.createDataFrame([], DOCS)).count() == 0


# Sharding


def check_shards(got, docs, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d[0], len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in docs)
    text_of = {d[0]: d[1] or "" for d in docs}
    where = defaultdict(set)
    for r in got:
        where[text_of[r["doc_id"]]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(len(s) == 1 for s in where.values())
    for k in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    return [sum(r["size"] for r in got if r["shard"] == k) for k in range(shards)]


def test_shards(spark):
    docs = samples() + [(k, f"{'same' if k % 3 else 'text ' * (k % 89) + str(k)}", "en", "s", 1) for k in range(1000, 4000)]
    got = sharding.assign(with_extra(spark.createDataFrame(docs, DOCS).repartition(6)), 8).collect()
    sums = sorted(check_shards(got, docs, 8))
    # two texts are larger than a shard's share; the others differ by less than an ordinary group
    assert sums[-2:] == [70_010, 80_008] and sums[-3] - sums[0] < 450
    assert sharding.assign(spark.createDataFrame([], DOCS)).count() == 0
    got = sharding.assign(spark.createDataFrame(docs[:3] + docs[:3], DOCS), 24).collect()
    check_shards(got, docs[:3] + docs[:3], 24)


def test_a_group_larger_than_a_share_stands_alone(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SENT_OFFSETS", 0)
    docs = [(k, "x" * 500 if k < 1000 else f"{k} " + "y" * (k % 997), "en", "s", 1) for k in range(3000)]
    sums = sorted(check_shards(sharding.assign(spark.createDataFrame(docs, DOCS).repartition(5), 6, together=64).collect(), docs, 6))
    assert sums[-1] == 508_000 and sums[-2] - sums[0] <= sums[0] * 0.002


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=40), st.integers(1, 7))
def test_differencing(sizes, ways):
    """The same spread as differencing with whole lists of sums."""
    got = sharding.difference(np.array(sizes, np.int64), ways)
    assert len(got) == len(sizes) and all(0 <= w < ways for w in got)
    parts = [[s] + [0] * (ways - 1) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    sums = np.bincount(got, sizes, minlength=ways) if sizes else np.zeros(ways)
    if len(set(sizes)) == len(sizes):  # ties may be taken in any order
        assert sum(sums) == sum(sizes)
        assert max(sums) - min(sums) <= max(sizes, default=0)
    if parts:
        assert max(sums) <= max(parts[0][0] + max(sizes) // 2, max(sizes))


def test_files_of_shards(spark, tmp_path):
    docs = samples()
    sharding.write(spark.createDataFrame(docs, DOCS), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text", "shard").collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in back) == [(d[0], d[1] or "") for d in docs]


# The queries


def test_registered_queries(spark, data):
    docs = [tuple(r) for r in table(spark, data, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert rows(queries.op11_divergence(spark, data)) == plain_audit(docs, 10, 10)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    made = [(*f[:5], digest(f[5]), digest(d[1] or "")) for d in docs for f in [plain_fim(d[0], d[1])]]
    assert rows(queries.op12_fim(spark, data)) == sorted(made, key=repr)
    sums = check_shards(queries.op13_sharding(spark, data).collect(), docs, 24)
    largest = max(Counter({t: sum(len((d[1] or "").encode()) + 8 for d in docs if d[1] == t) for t in {d[1] for d in docs}}).values())
    assert max(sums) <= max(largest, sum(sums) / 24 * 1.02)
