"""The corpus operators against brute force, and their edge cases: nulls in any column, empty and very
long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, common, decontam, license, mixing, quality, queries, simhash, substr, tokens, topk, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WS = re.compile(rb"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
#: Names that operators use inside.
CLASH = ["id", "fp", "key", "row", "size", "rank", "words", "x", "y", "hits", "tag", "prefix", "_mark", "u", "n"]


def words(text):
    return WS.findall((text or "").encode())


def odd_docs(spark):
    base = " ".join(f"token{i}" for i in range(60))
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, "   \n\t ", "en", "b", 0), (6, "one", None, "c", 3),
        (None, base + " tail", "en", None, 5), (7, LONG, "en", "a", 9), (8, "x " + base, "fr", "c", 9), (9, "Éa\u00a0b ÀB\x1fc", "fr", "c", 9), (10, "İK one two", "fr", "a", 9), (11, base.upper(), "en", "b", 2),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- shared helpers


def test_words_match_the_definition():
    rng = random.Random(3)
    texts = ["".join(rng.choice(" ab\n\té\x1f\u2028") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", " "]
    w = common.words_of(pa.array(texts))
    h, seen = w.hashes(), {}
    for i, t in enumerate(texts):
        a, b = w.first[i], w.first[i + 1]
        got = [bytes(w.buf[x:y]) for x, y in zip(w.start[a:b], w.end[a:b], strict=True)]
        assert got == words(t)
        for word, x in zip(got, h[a:b], strict=True):
            assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


def test_a_text_has_one_hash_wherever_it_stands():
    rng = random.Random(14)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 200))) for _ in range(300)]
    seen = {}
    for order in (texts, texts[::-1], [*texts[150:], "a b", *texts[:150]]):
        w = common.words_of(pa.array(order))
        for t, *h in zip(order, simhash._text_hash(w, 0), simhash._text_hash(w, 1), strict=True):
            assert seen.setdefault(tuple(t.split()), h) == h
    assert len({tuple(h) for h in seen.values()}) == len(seen) == len({h[0] for h in seen.values()})


# ---------------------------------------------------------------- 1


def fingerprint(text):
    import xxhash

    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_trie_pairs_are_all_pairs_within_the_budget():
    rng = np.random.default_rng(5)
    c = rng.integers(0, 2**63, 20, dtype=np.int64).view(np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    a = np.unique(np.concatenate([c[rng.integers(0, 20, 400)] ^ flip() ^ flip(), c]))
    for b in (None, np.unique(a[::3] ^ np.uint64(1 << 40))):
        got = {(int(x), int(y)) for i, j in simhash.trie_pairs(a, b, 3) for x, y in zip(i, j, strict=True)}
        near = np.bitwise_count(a[:, None] ^ (a if b is None else b)[None, :]) <= 3
        assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True) if b is not None or i < j}


def test_simhash_classes(spark):
    df = odd_docs(spark)
    rows = df.select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = roots(len(rows), pairs)
    least = {x: min((rows[i].doc_id for i in range(len(rows)) if root[i] == x and rows[i].doc_id is not None), default=None) for x in root}
    want = sorted(((str(r.doc_id), format(p, "016x"), least[x]) for r, p, x in zip(rows, prints, root, strict=True)))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_classes(df).collect())
    assert got == want
    assert simhash.simhash_classes(empty_docs(spark)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 150)}}


def test_a_long_path_is_one_component(spark):
    order = random.Random(5).sample(range(5001), 5001)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_a_walk_links_equal_keys_exactly():
    """Keys of few values, and a near test that links neighbours in a line: forests must match brute force."""
    rng = np.random.default_rng(6)
    for size, other in ((300, 0), (200, 150), (40, 1)):
        place = rng.permutation(size + other) * rng.integers(1, 3, size + other)
        near = lambda i, j: np.abs(place[i] - place[j]) <= 1  # noqa: B023, E731
        keys = rng.integers(0, 4, size + other).astype(np.uint64) << np.uint64(40)
        keys[:size].sort()
        keys[size:].sort()
        x, y = simhash._walk(keys[:size], keys[size:] if other else None, 1, 64, near)
        forest = simhash.Forest(size + other)
        forest.union(x, y)
        close = (np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 1) & (np.abs(place[:, None] - place[None, :]) <= 1)
        if other:
            close[:size, :size] = close[size:, size:] = False
        assert forest.root.tolist() == roots(size + other, zip(*np.nonzero(close), strict=True))


def test_near_keys_share_a_route():
    rng = np.random.default_rng(9)
    for bits, budget, depth in ((64, 3, 0), (64, 3, 9), (64, 3, 20), (32, 3, 8), (32, 3, 11), (32, 2, 17), (16, 5, 6)):
        ways = simhash.routes(bits, budget, depth)
        assert all(sum(n for _, n in w) >= min(depth, bits - budget) for w in ways)
        for _ in range(200):
            a = int(rng.integers(0, 2**62)) % (1 << bits)
            b = a
            for at in rng.choice(bits, budget, replace=False):
                b ^= 1 << int(at)
            cut = lambda x, w: [x >> (bits - first - n) & ((1 << n) - 1) for first, n in w]
            assert any(cut(a, w) == cut(b, w) for w in ways)


@pytest.mark.parametrize("limit", [100])
def test_crowded_nodes_are_split_and_dealt(spark, limit):
    """Keys in small groups, and some that crowd far over the limit, by one key and by many, against brute force."""
    rng = np.random.default_rng(7)
    own = rng.integers(0, 2**63, 60, dtype=np.int64)
    flip = lambda x: x ^ (1 << rng.integers(0, 63, len(x)))
    keys = np.concatenate([own, flip(own), flip(flip(flip(flip(own)))), (own[:1] & ~0xFFF) | rng.permutation(4096)[:400], np.full(50, own[5])])
    df = spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "key long, i long")

    def walk(blocks):
        rows = [np.sort(b.to_numpy(zero_copy_only=False).view(np.uint64)) for b in blocks]
        x, y = simhash._walk(rows[0], rows[1] if len(rows) > 1 else None, 3, 64)
        both = np.concatenate(rows).view(np.int64)
        return both[x], both[y]

    edges, used = simhash._walk_nodes(df, [], "key", limit, len(keys), 64, 3, walk)
    assert len(used) == 3 and used[1].agg(F.max("depth")).first()[0] > 40
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    near = np.bitwise_count((keys[:, None] ^ keys[None, :]).view(np.uint64)) <= 3
    want = roots(len(keys), zip(*np.nonzero(near), strict=True))
    least = {}
    for i, x in enumerate(want):
        least[x] = min(least.get(x, 2**63), int(keys[i]))
    assert all(got.get(int(k), int(k)) == least[x] for k, x in zip(keys, want, strict=True))


def test_the_sieve_misses_nothing(spark):
    rng = np.random.default_rng(8)
    have = rng.integers(-(2**63), 2**63 - 1, 2000, dtype=np.int64)
    sieve = common.Sieve(spark.createDataFrame([(int(x),) for x in have], "h long"), "h")
    assert sieve.test(have).all()
    assert sieve.test(rng.integers(-(2**63), 2**63 - 1, 100_000, dtype=np.int64)).mean() < 0.001
    df = spark.createDataFrame([(int(have[0]),), (int(have[0]) ^ 1,)], "h long")
    assert [r.ok for r in df.select(sieve.passes("h").alias("ok")).collect()] == [True, bool(sieve.test(np.array([have[0] ^ 1]))[0])]
    assert not common.Sieve(spark.createDataFrame([], "h long"), "h").test(have).any()


def test_rows_go_by_id_and_text(spark):
    base = " ".join(f"token{i}" for i in range(60))
    own = " ".join(f"other{i}" for i in range(60))
    rows = [(1, base), (2, base), (2, own), (3, own + " end"), (3, own + " end"), (4, ""), (4, ""), (4, None), (None, base), (5, base.upper()), (6, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "row", "_row0", "keep", "gone", "_gone_id"):
        df = df.withColumn(c, F.lit("clash"))
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), r.text) for r in out.collect() if r.text)
    assert got == sorted([("1", base), ("2", own), ("6", LONG)])
    assert sorted(str(r.text) for r in out.where("doc_id = 4").collect()) == ["", "None"]


def test_near_duplicates_by_similarity(spark):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows, want = [], {}
    for c in range(25):
        text = [rng.choice(vocabulary) for _ in range(400)]
        for k in range(4):
            copy = list(text)
            for _ in range(k):  # at most 3 words: similarity above 0.92
                copy[rng.randrange(400)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy), "en", "a", 1))
            want[len(rows) - 1] = c * 4
    rows += [(1000, None, "en", "a", 1), (1001, "", "en", "a", 1)]
    got = {r.id: r.class_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    odd = {str(r.id): r.class_id for r in simhash.near_duplicates(odd_docs(spark)).collect()}
    assert odd["2"] == 1 and odd["11"] == 1 and odd["7"] == 7 and "4" not in odd


def test_repeated_lines_neither_make_nor_hide_copies(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    rows, want = [], {}
    for c in range(10):
        line = prose(20)
        for k in range(2):  # one line 15 times, and 300 words of each text's own
            rows.append((4 * c + k, prose(300) + f" {line}" * 15, "en", "a", 1))
            want[4 * c + k] = 4 * c + k
        own = prose(300)
        for k in (2, 12):  # the same shingles, the line's more or less often
            i = 4 * c + (2 if k == 2 else 3)
            rows.append((i, own + f" {line}" * k, "en", "a", 1))
            want[i] = 4 * c + 2
    assert {r.id: r.class_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()} == want


def jaccard(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def planted_copies(rng, kind, low, high):
    """(text, copy, similarity): words appended, cut off or changed to a similarity from low to high."""
    vocabulary = [f"v{i}" for i in range(3000)]
    while True:
        n = rng.randint(150, 400)
        text = [rng.choice(vocabulary) for _ in range(n)]
        if kind == "appended":
            copy = text + rng.choices(vocabulary, k=int(n * rng.uniform(0.16, 0.5)))
        elif kind == "truncated":
            copy = text[: int(n * rng.uniform(0.65, 0.87))]
        else:
            copy = list(text)
            for i in rng.sample(range(n), int(n * rng.uniform(0.015, 0.06))):
                copy[i] = rng.choice(vocabulary)
        j = jaccard(text, copy)
        if low <= j < high:
            return " ".join(text), " ".join(copy), j


def test_near_duplicates_decide_at_the_similarity(spark):
    rng = random.Random(4)
    rows, plan = [], {}
    for kind in ("appended", "truncated", "edited"):
        for low, high in ((0.7, 0.8), (0.8, 0.83)):
            for _ in range(100):
                text, copy, j = planted_copies(rng, kind, low, high)
                plan[len(rows)] = (kind, j >= 0.8)
                rows += [(len(rows), text, "en", "a", 1), (len(rows) + 1, copy, "en", "a", 1)]
    got = {r.id: r.class_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    linked = {k: sum(got[i + 1] == i for i, p in plan.items() if p == k) for k in set(plan.values())}
    print(linked)
    for kind in ("appended", "truncated", "edited"):
        assert linked[kind, False] == 0 and linked[kind, True] >= 97, linked


def test_heavy_components_are_verified_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "VERIFY_WEIGHT", 3000)
    rng = random.Random(3)
    text = [f"v{rng.randrange(3000)}" for _ in range(200)]
    rows = [(i, " ".join([*text[:i], f"own{i}", *text[i + 1 :]]), "en", "a", 1) for i in range(40)]
    assert {r.class_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()} == {0}


# ---------------------------------------------------------------- 2


def test_fit_lengths_comes_near_the_budget():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 2000, rng.integers(1, 200)))
        counts = rng.integers(1, 30, len(lengths))
        budget = rng.uniform(0, (lengths * counts).sum())
        take = mixing.fit_lengths(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs((take * lengths).sum() - budget) <= lengths.min()


def water(sizes, weights, most):
    """Targets by repeated resharing."""
    total, target = sum(sizes), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    left = float(total)
    while open_ and left > 1e-9:
        w = sum(weights[i] for i in open_)
        add = {i: left * weights[i] / w for i in open_}
        left = 0.0
        for i in list(open_):
            target[i] += add[i]
            if target[i] > most * sizes[i]:
                left += target[i] - most * sizes[i]
                target[i] = most * sizes[i]
                open_.discard(i)
    return target


def test_targets_and_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), "en", rng.choice(["a", "b", "b", "b", "b", "c", None]), 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df).collect()
    names = ["a", "b", "c", None]
    source = {r[0]: r[3] for r in rows}
    sizes = [sum(len(words(r[1])) for r in rows if r[3] == s) for s in names]
    targets = water(sizes, [5, 2, 1, 5], 3)
    for s, size, target in zip(names, sizes, targets, strict=True):
        own = [r for r in out if source[r.doc_id] == s]
        assert {r.source_size for r in own} == {size} and abs(own[0].target - target) < 1e-6
        assert abs(sum(r.taken for r in own) - target) <= 1
        assert all(0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] for r in own)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))


def test_mix_edges(spark):
    df = odd_docs(spark)
    out = mixing.mix(df, carry=["lang", "size"])
    assert out.count() == df.count()
    assert {(r.doc_id, r.taken) for r in out.where("doc_id IN (3, 4)").collect()} == {(3, 0), (4, 0)}
    assert mixing.mix(empty_docs(spark)).count() == 0
    wordless = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", None, 0)], DOCS)
    assert [r.target for r in mixing.mix(wordless).collect()] == [0.0, 0.0]


# ---------------------------------------------------------------- 3


def test_url_filter(spark, monkeypatch):
    urls = [
        None, "", "no scheme", "http://", "https://Example.COM/en/a", "https://www.example.com/en/a", "https://x.www.example.com/en/", "https://badexample.com/en/", "http://a.net/es/1?x#y", "http://net/fr/", "http://a.net/de/", "http://a.net/es",
        "https://a.com", "https://a.com?x=/", "ftp://b.org/feed.xml", "http://casino.org/", "http://b.org/x/ads/y", "http://b.org/Login", "http://u://v/com/", "http://a.net/ES/", "http://a.org/" + "p/" * 5000, "HTTP://A.COM/\n",
    ]
    df = spark.createDataFrame([*enumerate(urls), (4, urls[4]), (None, urls[4])], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("_at", F.lit("clash"))
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    got = urlfilter.judge(df).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        u = urls[r.page_id if r.page_id is not None else 4]
        host = path = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
            host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        assert r.rule == (max(fits)[1] if fits else None)
        if fits:
            assert r.verdict == max(fits)[2]
    by_id = {r.page_id: r for r in got}
    assert [by_id[i].pattern for i in (14, 15, 16, 17)] == ["feed-file", "casino-host", "ads-path", "login-page"]
    monkeypatch.setattr(urlfilter, "CONSTANT_RULES", 3)
    joined = urlfilter.judge(df)
    assert joined.columns == ["page_id", "host", "path", "rule", "verdict", "pattern"] and sorted(map(str, joined.collect())) == sorted(map(str, got))
    many = tuple(urlfilter.Rule.prefix(f"host{i}.org", "/p/", "block") for i in range(300))
    asked = spark.createDataFrame([(i, f"http://x.host{i}.org/p/{i}") for i in range(0, 600, 3)], "page_id long, url string")
    assert {r.page_id for r in urlfilter.judge(asked, rules=many).where("verdict = 'block'").collect()} == set(range(0, 300, 3))
    assert urlfilter.judge(df.limit(0)).count() == 0
    monkeypatch.undo()
    assert urlfilter.judge(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judge(df, rules=(urlfilter.Rule.regex("all", "block", ".*"),))


# ---------------------------------------------------------------- 4


def least_edits(pattern, text):
    col = list(range(len(pattern) + 1))
    best = col[-1]
    for c in text:
        new = [0]
        for i in range(1, len(pattern) + 1):
            new.append(min(col[i - 1] + (pattern[i - 1] != c), col[i] + 1, new[i - 1] + 1))
        col = new
        best = min(best, col[-1])
    return best


def test_myers_is_the_edit_distance():
    rng = random.Random(6)
    for _ in range(400):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        assert decontam.Pattern(p).distance(t) == least_edits(p, t)


def test_decontamination(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(12)] + ["tiny item"]
    texts = []
    for _ in range(80):
        t = " ".join(word() for _ in range(80))
        if rng.random() < 0.7:
            item = list(rng.choice(items))
            for _ in range(rng.randint(0, 14)):
                at = rng.randrange(len(item))
                item[at] = rng.choice(["", "zz", "Q"])
            t += "  \n" + "".join(item).upper() + " " + word()
        texts.append(t)
    texts += [None, "", LONG, LONG + " " + items[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("hits", F.lit("clash"))
    bench = spark.createDataFrame([*enumerate(items), (0, items[0]), (50, None), (51, " ")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {r.doc_id: r for r in decontam.contamination_report(docs, bench).collect()}
    for i, t in enumerate(texts):
        norm = decontam.normalize(t)
        want = {}
        for j, item in enumerate(items):
            k = decontam.edits(item)
            d = (0 if item in norm else 99) if len(norm) > 10_000 else least_edits(item, norm)
            if d <= k:
                want[j] = d
        assert got[i].item_ids == ",".join(map(str, sorted(want))), i
        assert got[i].least_distance == min(want.values(), default=None) and got[i].contaminated == bool(want)
    clean = decontam.keep_clean(docs.drop("hits"), bench)
    assert clean.columns == ["doc_id", "text", "item_id"] and {r.doc_id for r in clean.collect()} == {i for i in got if not got[i].contaminated}
    assert decontam.contamination_report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination_report(docs.limit(0), bench).count() == 0


def test_items_without_spaces_have_an_error_budget(spark):
    item = "".join(chr(0x4E00 + 37 * i) for i in range(40))
    near = "前文" + item[:20] + "變" + item[21:] + "後文"
    docs = spark.createDataFrame([(0, near), (1, item[:18] + "一二三四" + item[22:]), (2, "tiny itex")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "tiny item")], "item_id long, text string")
    got = {r.doc_id: (r.item_ids, r.least_distance) for r in decontam.contamination_report(docs, bench).collect()}
    assert got == {0: ("7", 1), 1: ("", None), 2: ("", None)}


def test_short_items_stand_as_words(spark):
    texts = ["then we rested", "and the end", "the", "bathe", "x-the-y", "the_end", "我们去the家", "中文字", "abc12 34x", "abc12 34"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").withColumn("_hits0", F.lit("clash"))
    bench = spark.createDataFrame([(1, "the"), (2, "文"), (3, "12 34"), (4, "abc12 34")], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontam.contamination_report(docs, bench).collect()}
    assert got == {0: "", 1: "1", 2: "1", 3: "", 4: "1", 5: "", 6: "1", 7: "2", 8: "", 9: "4"}
    assert decontam.keep_clean(docs, bench).columns == docs.columns


def test_items_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 30)
    bench = spark.createDataFrame([(i, f"alpha beta gamma delta item{i}") for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta item3 alpha beta gamma delta item0 y")], "doc_id long, text string")
    r = decontam.contamination_report(docs, bench).first()
    assert {"0", "3"} <= set(r.item_ids.split(","))


# ---------------------------------------------------------------- 5


def test_statistics_depend_on_the_text_alone():
    texts = [None, "", "one", "a b\na b\na b", "X*** Y%%%", LONG]
    whole = quality.statistics(pa.array(texts))
    assert whole.shape == (len(texts), quality.STATISTICS) and np.isfinite(whole).all()
    for i, t in enumerate(texts):
        assert (quality.statistics(pa.array([t], pa.string()))[0] == whole[i]).all()


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=500)
    knots, levels = quality.isotonic(x, (rng.uniform(size=500) < x).astype(int))
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all() and 0 <= levels[0] and levels[-1] <= 1


def test_the_fit_is_the_dense_one(spark):
    """Model and scores against the same formulas over all rows at once, and a quadratic isotonic fit."""
    rng = random.Random(18)
    words_ = ["the", "river", "Stone", "walks.", "%%", "x9"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words_, k=rng.randint(1, 60)))) for i in range(400)] + [(900, LONG)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(rng.random() < 0.5)) for i in range(400)], "doc_id long, quality int")
    rows = quality.labelled_statistics(docs, labels, "doc_id", "text", "quality", 60_000, 7).collect()
    x, y, u = np.array([r.x for r in rows]), np.array([r.y for r in rows]), np.array([r.u for r in rows])
    center, scale = x.mean(0), x.std(0)
    scale[~(scale > 1e-9)] = 1
    gen = np.random.default_rng(7)
    w, phase = gen.normal(size=(quality.STATISTICS, quality.FEATURES)) / (quality.WIDTH * np.sqrt(quality.STATISTICS)), gen.uniform(0, 2 * np.pi, quality.FEATURES)
    wide = lambda a: np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((a - center) / scale, -6, 6) @ w + phase), np.ones((len(a), 1))])
    z, t = wide(x[u % 5 != 0]), y[u % 5 != 0]
    solution = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) / quality.FEATURES * np.eye(z.shape[1]), z.T @ t)
    raw, seen = wide(x[u % 5 == 0]) @ solution, y[u % 5 == 0]
    order = np.argsort(raw)
    raw, seen = raw[order], seen[order].astype(float)
    n = len(raw)
    level = np.array([max(min(seen[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)])
    cuts = np.unique(level.round(9))
    knots = [raw[np.isclose(level, c, atol=1e-8)].mean() for c in cuts]
    texts = docs.collect()
    want = np.interp(wide(quality.statistics(pa.array([r.text for r in texts]))) @ solution, knots, cuts)
    got = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    assert max(abs(got[r.doc_id] - v) for r, v in zip(texts, want, strict=True)) < 1e-6
    unseen = labels.unionByName(spark.createDataFrame([(10_000 + i, 1) for i in range(500)], "doc_id long, quality int"))
    assert {r.doc_id: r.score for r in quality.score_documents(docs, unseen).collect()} == got


def test_quality_on_held_out_rows(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "river", "stone", "walks", "under"]) + rng.choice(["", "s", "."]) for _ in range(rng.randint(20, 80)))
    bad = lambda: " ".join(rng.choice(["%%%", "x***", "BUY!!", "###"]) for _ in range(rng.randint(20, 80)))
    rows = [(i, good() if i % 3 else bad()) for i in range(900)]
    docs = spark.createDataFrame([*rows, (2000, None), (2001, ""), (None, "the river"), (0, rows[0][1])], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("x", F.lit("clash"))
    labels = spark.createDataFrame([*((i, int(i % 3 > 0)) for i in range(900)), (5, None), (None, 1), (77777, 1), (6, 9)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    got = quality.score_documents(docs, labels).collect()
    import zlib

    assert len(got) == 904
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    seen = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in seen) / len(seen) > 0.97
    # held-out labels don't matter
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {(r.doc_id, r.score) for r in quality.score_documents(docs, flipped).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


# ---------------------------------------------------------------- 6


def test_exact_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(700, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[300:520] = v[300]  # a hot vector
    rows = [(i, v[i].tolist()) for i in range(700)] + [(5000, None), (5050, [float("nan")] * 16), (5100, [None] * 16), (None, v[0].tolist()), (5150, [1.0]), (10, v[10].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("d", F.lit("clash"))
    q = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    want = set()
    for i in range(0, 700, 50):
        s = q @ q[i]
        for rank, j in enumerate([j for j in np.lexsort((np.arange(700), -s)) if j != i][:5], 1):
            want.add((i, rank, int(j), int(s[j])))
    assert {tuple(r) for r in topk.exact_topk(df).collect()} == want
    assert topk.exact_topk(df.limit(0)).count() == 0
    few = df.where("vec_id IN (50, 51, 52)")
    assert sorted((r.rank, r.vec_id) for r in topk.exact_topk(few).collect()) and topk.exact_topk(few).count() == 2
    assert topk.exact_topk(df.where("vec_id = 50")).count() == 0


# ---------------------------------------------------------------- 7


def test_chat_links_calls_and_results(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls":[{"id":"a","name":"search","arguments":{"query":"x","limit":3}},{"id":"b","name":"fetch","arguments":{"url":"$a"}}]}'),
        (1, 3, "tool", '{"tool_call_id":"a","content":"{\\"z\\":1, \\"b\\":2}"}'), (1, 2, "tool", '{"tool_call_id":"b","content":"page"}'), (1, 5, "tool", '{"tool_call_id":"zz","content":"?"}'),
        (2, 0, "assistant", '{"tool_calls":[{"id":"a","name":"search","arguments":{"limit":"no"}},{"id":"n","name":"nope","arguments":{}}]}'), (2, 1, "assistant", "{not json"), (2, 2, "assistant", '{"a": 1}'),
        (3, 0, "assistant", '{"tool_calls":[{"id":"p","name":"fetch","arguments":{"url":"$q"}},{"id":"q","name":"fetch","arguments":{"url":"$p"}},{"id":"q","name":"fetch","arguments":{"url":"u"}}]}'),
        (None, None, None, None), (4, 0, "user", ""), (4, 0, "user", ""), (4, 1, "user", LONG),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash")).withColumn("call_id", F.lit("clash"))
    got = chat.format_chats(df).collect()
    state = {(r.conv_id, r.kind, r.call_id, r.idx): r for r in got}
    assert state[1, "call", "a", 0].status == state[1, "call", "b", 1].status == state[1, "result", "a", 0].status == "ok"
    assert state[1, "result", "zz", 0].status == "orphan"
    assert state[2, "call", "a", 0].status == state[2, "call", "n", 1].status == "invalid"
    assert state[3, "call", "p", 0].status == "cycle" and state[3, "call", "q", 2].status == "duplicate"
    order = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.place, r.level, r.turn, r.idx))
    at = {(r.kind, r.call_id): i for i, r in enumerate(order)}
    assert at["call", "a"] < at["result", "a"] < at["call", "b"] < at["result", "b"]  # though b's result has the earlier turn
    assert state[1, "call", "a", 0].json == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","role":"assistant","turn":1}'
    assert sum(r.kind == "message" for r in got) == 7 and sum(r.conv_id == 4 for r in got) == 3
    assert chat.format_chats(df.limit(0)).count() == 0


def linked(rows):
    """Brute force for conversations of plain, call and result messages: {(conv, turn, kind, idx): (id, status, place, level, json)}."""
    import json

    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    calls, results, out = {}, {}, {}
    for conv, turn, role, text in rows:
        j = json.loads(text) if text.startswith("{") and role in ("assistant", "tool") else {}
        if role == "assistant" and j.get("tool_calls"):
            for idx, c in enumerate(j["tool_calls"]):
                calls[conv, turn, idx] = c
        elif role == "tool" and "tool_call_id" in j:
            results[conv, turn] = j
        else:
            out[conv, turn, "message", 0] = (None, "ok", turn, 0, dump({"content": text, "role": role, "turn": turn}))
    owner, answer = {}, {}
    for at in sorted(calls):
        owner.setdefault((at[0], calls[at]["id"]), at)
    for (conv, turn), j in results.items():
        k = (conv, j["tool_call_id"])
        answer[k] = max(answer.get(k, -1), turn)
    needs = {k: {v[1:] for v in calls[at]["arguments"].values() if isinstance(v, str) and v.startswith("$")} for k, at in owner.items()}
    settled = {}
    while True:  # as long as some call's needs are all settled
        new = {}
        for k, own in needs.items():
            bound = [(k[0], n) for n in own if (k[0], n) in owner]
            if k not in settled and all(b in settled for b in bound):
                turns = [owner[k][1], *(settled[b][0] for b in bound), *(answer[k[0], n] for n in own if (k[0], n) in answer)]
                new[k] = (max(turns), max([settled[b][1] + 2 for b in bound], default=0))
        if not new:
            break
        settled |= new
    for at, c in calls.items():
        k, args = (at[0], c["id"]), c["arguments"]
        fields = chat.SCHEMAS.get(c["name"])
        valid = fields is not None and all(f in args for f, (_, must) in fields.items() if must) and all(f in fields and type(v) is {"string": str, "integer": int}[fields[f][0]] for f, v in args.items())
        status = "duplicate" if owner[k] != at else "invalid" if not valid else "cycle" if k not in settled else "open" if k not in answer else "ok"
        place, level = settled.get(k, (owner[k][1], 0))
        out[at[0], at[1], "call", at[2]] = (c["id"], status, max(place, at[1]), level, dump({**c, "role": "assistant", "turn": at[1]}))
    for (conv, turn), j in results.items():
        k = (conv, j["tool_call_id"])
        place, level = settled.get(k, (owner[k][1], 0)) if k in owner else (turn, -1)
        content = j["content"]
        out[conv, turn, "result", 0] = (k[1], "ok" if k in owner else "orphan", max(turn, place), level + 1, dump({"content": dump(json.loads(content)) if content.startswith("{") else content, "id": k[1], "role": "tool", "turn": turn}))
    return out


def test_chat_against_a_brute_force_linker(spark):
    import json

    rng = random.Random(21)
    rows = []
    for conv in range(40):
        ids = [f"c{i}" for i in range(rng.randint(1, 7))]
        for turn in rng.sample(range(100), rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.5:
                calls = []
                for _ in range(rng.randint(1, 3)):
                    name = rng.choice(["search", "fetch", "calculate", "nope"])
                    word = lambda: f"${rng.choice([*ids, 'none'])}" if rng.random() < 0.6 else rng.choice(["x", "a b", "5"])
                    args = {"search": {"query": word(), "limit": rng.choice([3, word()])}, "fetch": {"url": word()}, "calculate": {"expression": word(), "digits": 2}, "nope": {}}[name]
                    if rng.random() < 0.2:
                        args = {**args, "other": word()} if rng.random() < 0.5 else {}
                    calls.append({"id": rng.choice(ids), "name": name, "arguments": args})
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": calls})))
            elif kind < 0.8:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice([*ids, "lost"]), "content": rng.choice(["page", '{"z": 1, "b": [2, "x"]}', "", "word " * 3000])})))
            else:
                rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["hi", "", LONG])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {(r.conv_id, r.turn, r.kind, r.idx): (r.call_id, r.status, r.place, r.level, r.json) for r in chat.format_chats(df).collect()}
    want = linked(rows)
    assert {x[1] for x in want.values()} == {"ok", "duplicate", "invalid", "cycle", "open", "orphan"}
    assert got == want


def test_content_beside_calls_is_kept(spark):
    call = '"tool_calls":[{"id":"a","name":"fetch","arguments":{"url":"u"}}]'
    rows = [(1, 4, "assistant", f'{{"content":"I look it up.",{call}}}'), (2, 0, "assistant", f'{{"content":null,{call}}}'), (3, 0, "assistant", f"{{{call}}}")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    order = [(r.conv_id, r.kind) for r in sorted(got, key=lambda r: (r.conv_id, r.place, r.level, r.turn, r.idx))]
    assert order == [(1, "message"), (1, "call"), (2, "call"), (3, "call")]
    assert [r.json for r in got if r.kind == "message"] == ['{"content":"I look it up.","role":"assistant","turn":4}']


def test_long_chains_of_calls_are_no_cycles(spark):
    n = 67
    call = lambda i: f'{{"tool_calls":[{{"id":"c{i}","name":"fetch","arguments":{{"url":"{f"$c{i - 1}" if i else "u"}"}}}}]}}'
    rows = [(1, n - i, "assistant", call(i)) for i in range(n)] + [(1, 100 + i, "tool", f'{{"tool_call_id":"c{i}","content":"x"}}') for i in range(n)]
    rows += [(2, 0, "assistant", call(5).replace("$c4", "$c5"))]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("kind = 'call'").collect()
    state = {(r.conv_id, r.call_id): (r.status, r.place, r.level) for r in got}
    assert [state[1, f"c{i}"] for i in range(n)] == [("ok", 99 + i if i else n, 2 * i) for i in range(n)]
    assert state[2, "c5"][0] == "cycle"


# ---------------------------------------------------------------- 8


def test_license_scan(spark):
    t = license.TEMPLATES["mit"]
    changed = t.replace("hereby ", "").replace("software", "program", 1)
    texts = [
        None, "", "CC-BY", "cc by cc by", "ccby", "xcc by", "General  Public\nLicense; all rights reserved", "all rights\x00reserved", "general public", "É all rights reservedÉ", LONG, "x " * 30 + t.upper(), changed, " ".join(t.split()[:8]), "...cc by...",
    ]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, "cc by")], "doc_id long, text string")
    for c in ("row", "words", "w0", "label", "i"):
        df = df.withColumn(c, F.lit("clash"))
    got = license.license_report(df).collect()
    assert len(got) == len(texts) + 2
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else "cc by"
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places = [(i, label) for p, label in license.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places})))
    by_id = {r.doc_id: r for r in got}
    assert by_id[11].labels == "mit" and by_id[11].score == 1.0
    assert by_id[12].labels == "mit" and 0.8 <= by_id[12].score < 1 and by_id[13].labels == ""
    assert license.license_report(df.limit(0)).count() == 0


def found_licenses(words_):
    """{label: share} by brute force: the longest chain of meetings within the drift, in one run of diagonals."""
    out = {}
    for label, template in license.TEMPLATES.items():
        t = template.split()
        met = sorted((i, j) for i in range(len(words_) - 1) for j in range(len(t) - 1) if words_[i : i + 2] == t[j : j + 2])
        runs = []
        for d in sorted({i - j for i, j in met}):
            if runs and d - runs[-1][-1] <= license.DRIFT:
                runs[-1].append(d)
            else:
                runs.append([d])
        best = 0
        for run in runs:
            for low in run:
                some = [(i, j) for i, j in met if i - j in run and low <= i - j <= low + max(license.DRIFT, len(t) // 2)]
                length = []
                for a, (i, j) in enumerate(some):
                    length.append(1 + max((length[b] for b in range(a) if some[b][0] < i and some[b][1] < j), default=0))
                best = max([best, *length])
        if best >= license.SHARE * (len(t) - 1):
            out[label] = best / (len(t) - 1)
    return out


def test_licenses_against_brute_force(spark):
    rng = random.Random(31)
    texts = ["is free " * 9, "permission is " * 25, "this is free and " * 12]
    for _ in range(150):
        t = list(rng.choice(list(license.TEMPLATES.values())).split())
        for _ in range(rng.randint(0, 9)):
            at, what = rng.randrange(len(t)), rng.random()
            if what < 0.3:
                t[at : at + 1] = []
            elif what < 0.6:
                t[at:at] = rng.choices(["the", "of", "zz", "is"], k=rng.randint(1, 4))
            else:
                t[at] = rng.choice(["the", "qq"])
        if rng.random() < 0.2:
            cut = rng.randrange(len(t))
            t = t[cut:] + t[:cut]
        texts.append(" ".join([*rng.choices(["the", "is", "and"], k=rng.randint(0, 5)), *t, *rng.choices(["of", "free"], k=rng.randint(0, 5))]))
    got = {r.doc_id: r for r in license.license_report(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    wants = [found_licenses(t.split()) for t in texts]
    assert 20 < sum(map(bool, wants)) < 140 and not wants[0]
    for i, want in enumerate(wants):
        assert got[i].labels == ",".join(sorted(want)) and abs(got[i].score - max(want.values(), default=0)) < 1e-9, texts[i]


def test_many_templates_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(license, "BROADCAST_GRAMS", 10)
    df = spark.createDataFrame([(1, "x " + license.TEMPLATES["bsd"]), (2, "cc by")], "doc_id long, text string")
    assert {(r.doc_id, r.labels) for r in license.license_report(df).collect()} == {(1, "bsd"), (2, "cc-by")}


def test_licenses_are_verified_in_order(spark):
    t = license.TEMPLATES["mit"].split()
    halves = t[13:] + t[:13]
    put_in = [*t[:6], "and", "so", *t[6:18], "on", "then", *t[18:]]
    texts = ["permission is " * 25, " ".join(halves), " ".join(reversed(t)), "x y " + " ".join(put_in), " ".join(t)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score * (len(t) - 1))) for r in license.license_report(df).collect()}
    assert got == {0: ("", 0), 1: ("", 0), 2: ("", 0), 3: ("mit", len(t) - 3), 4: ("mit", len(t) - 1)}


# ---------------------------------------------------------------- 9


def greedy(word, initial, rest):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in (initial if i == 0 else rest)), None)
        if j is None:
            return -1
        n, i = n + 1, j
    return n


def test_automaton_is_greedy():
    rng = random.Random(10)
    make = lambda k: {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(k)}
    for _ in range(200):
        initial, rest = make(rng.randint(1, 12)), make(rng.randint(0, 12))
        a = tokens.Automaton(initial, rest)
        for _ in range(50):
            w = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 12)))
            assert a.count(w) == greedy(w, initial, rest), (w, initial, rest)


def test_the_bare_word_start_spells_what_has_no_initial_piece(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=queries.VOCABULARY)
    normal = {model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    vocabulary = tokens.sentencepiece_pieces(queries.VOCABULARY)
    cases = ["1984", "7", "ñandú", "ço", "ßig", "中文", "hello", "Été", "\U0010ffff"]
    df = spark.createDataFrame([*enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_unknown) for r in tokens.token_counts(df, vocabulary).collect()}
    for i, word in enumerate(cases):
        n = greedy("▁" + word, normal, normal)
        assert got[i] == (abs(n), int(n < 0)), word
    assert got[0] == (5, 0) and got[8] == (1, 1)
    assert tokens.Automaton(["", "ab"], ["a", "c"]).count("ac") == 3 and tokens.Automaton(["", "ab"], ["a", "c"]).count("abb") == -1


def test_token_counts(spark):
    vocabulary = (["t", "to", "token", "w", "o", "x"], ["o", "k", "en", "ken", *map(str, range(10)), "n", "e"])
    df = odd_docs(spark)
    got = tokens.token_counts(df, vocabulary).collect()
    assert len(got) == df.count()
    text = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    for r in got:
        c = [greedy(w.decode(), set(vocabulary[0]), set(vocabulary[1])) for w in words(text[r.doc_id])]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(c), sum(map(abs, c)), sum(x < 0 for x in c))
    assert tokens.token_counts(empty_docs(spark), vocabulary).count() == 0


# ---------------------------------------------------------------- 10


def without_repeats(rows, window):
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(t)
        for p in range(len(w) - window + 1):
            key, at = tuple(w[p : p + window]), (i is None, i or 0, p)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (i is None, i or 0, p):
                gone[p : p + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((str(i), len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark):
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(60):
        t = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(t))
            cut = rng.randint(0, 40)
            t[at:at] = passage[cut : cut + rng.randint(15, 50)]
        rows.append((i, " ".join(t), "en", "a", 0))
    rows += [(100, "z " * 200, "en", "a", 0), (101, "y y " * 15, "en", "a", 0), (5, rows[5][1], "en", "a", 0)]
    df = spark.createDataFrame(rows, DOCS).unionByName(odd_docs(spark).select(*DOCS.replace(" long", "").replace(" string", "").split(", ")))
    want = without_repeats([(r.doc_id, r.text) for r in df.collect()], 20)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substr.remove_repeats(df).collect()) == want
    assert substr.remove_repeats(empty_docs(spark)).count() == 0


def repeats(rng):
    rows = []
    for i in range(40):
        t = rng.choices("abcdefghijklmnop", k=rng.randint(0, 150))
        if rows and rng.random() < 0.6:
            other = rng.choice(rows)[1].split()
            t[len(t) // 2 : len(t) // 2] = other[: rng.randint(0, 60)]
        rows.append((i, " ".join(t)))
    return [*rows, (7, rows[7][1]), (8, rows[9][1]), (None, rows[11][1]), (None, " ".join(rng.choices("abc", k=80)))]


@pytest.mark.parametrize("bits", [3, 9, 14])
def test_substring_dedup_settles_collisions(spark, monkeypatch, bits):
    """Edges of few bits collide everywhere; the result is the same."""
    monkeypatch.setattr(substr, "AGAIN", 300)
    rows = repeats(random.Random(12))
    got = substr.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=5, bits=bits)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == without_repeats(rows, 5)


def test_frequent_passages_are_joined(spark, monkeypatch):
    """K-mers of very many edges, and texts of nothing else, go another way to the same result."""
    monkeypatch.setattr(substr, "BUCKET_EDGES", 12)
    monkeypatch.setattr(substr, "SAMPLE", 1)
    rng = random.Random(13)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(rng.choices("abcdefghijklmnop", k=rng.randint(0, 30))) + " " + passage + " end" * rng.randint(0, 9)) for i in range(60)]
    rows += [(100 + i, passage) for i in range(30)] + [(200, "y " * 100), (None, passage)] + repeats(rng)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spy = []
    real = substr._frequent_runs
    monkeypatch.setattr(substr, "_frequent_runs", lambda *a: spy.append(1) or real(*a))
    for bits in (64, 6):
        got = substr.remove_repeats(df, window=8, bits=bits)
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == without_repeats(rows, 8)
    assert len(spy) == 2


def test_remaining_text_keeps_its_layout(spark):
    p = "\n".join(f"l{i}  x" for i in range(40))
    df = spark.createDataFrame([(1, p, "a"), (2, "head\n\tstart " + p + "  tail\nend", "b"), (3, "free\n  text", None)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in substr.remove_repeats(df, with_text=True, carry=["source"]).collect()}
    assert got[1].text == p and got[2].text == "head\n\tstart tail\nend" and got[3].text == "free\n  text" and got[2].source == "b"
