"""Operators on whole tables against brute force."""

import collections
import hashlib
import random

import pytest
import regex

from evispark.llm import minhash_dedup, spotsigs, suffix_dedup, url_rules


def key(d):
    return (d is not None, d or 0)


def brute_repeats(rows, n=100):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (key(r[0]), (r[1] or "").encode())):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                cover[p : p + n] = b"\1" * n
            else:
                seen.add(b[p : p + n])
        runs = sum(1 for i in range(len(b)) if cover[i] and (i == 0 or not cover[i - 1]))
        out.append((d, len(b), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(spark):
    rng = random.Random(5)
    passages = ["".join(rng.choices("abé ", k=rng.randint(60, 300))) for _ in range(30)]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choices("xyzñ ", k=rng.randint(1, 200))) for _ in range(rng.randint(0, 12)))) for i in range(200)]
    rows += [(902, "a" * 5000), (903, "ab" * 700), (904, "a" * 100), (905, "q" * 99), (906, "q" * 99)]
    got = sorted((tuple(r) for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_repeats(rows)


def test_crowded_grams_equal_the_plain_ones(spark, monkeypatch):
    rng = random.Random(15)
    line = "".join(rng.choices("abcdefgh ", k=70))
    rows = [(i, "".join(rng.choices("xy", k=rng.randint(0, 60))) + line + "".join(rng.choices("xy", k=rng.randint(0, 60)))) for i in range(250)]
    rows += [(i, "".join(rng.choices("xyz", k=80)) + rows[i % 40][1]) for i in range(300, 400)] + [(None, rows[7][1]), (None, line * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_repeats(rows)
    for crowd in (2, 30, 1000):
        monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
        assert sorted((tuple(r) for r in suffix_dedup.digests(df).collect()), key=repr) == expected, crowd


def test_repeats_of_odd_rows(odd, empty):
    got = sorted((tuple(r) for r in suffix_dedup.digests(odd).collect()), key=repr)
    assert got == brute_repeats([(r.doc_id, r.text) for r in odd.collect()])
    kept = suffix_dedup.without_repeats(odd, 100)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    texts = {(r.doc_id, r.k): r.text for r in kept.collect()}
    assert texts[6, 6] and "" == texts[7, 7] or "" == texts[7, 8]
    assert suffix_dedup.digests(empty).count() == suffix_dedup.without_repeats(empty).count() == 0


def test_multikey_order():
    import numpy as np

    words = np.random.default_rng(0).integers(0, 3, (500, 5)).astype(np.uint64)
    order, klass = suffix_dedup.multikey_order(words)
    assert order.tolist() == sorted(range(500), key=lambda i: (*words[i].tolist(), i))
    assert all((words[order[c]] == words[order[i]]).all() for i, c in enumerate(klass))


def test_long_texts_are_sampled_alike():
    import numpy as np

    raw = np.random.default_rng(1).integers(97, 101, 1_300_000).astype(np.uint8)
    at, h = suffix_dedup.anchors(raw)
    again, g = suffix_dedup.anchors(raw[700_000:])
    inner = at[(at >= 700_100) & (at < 1_299_800)]
    assert set(inner - 700_000) <= set(again) and np.diff(at).max() <= 100 - suffix_dedup.GRAM + 1 and len(h) == len(at) and len(g) == len(again)


def brute_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d, key=key)
    return sorted(((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, percent):
    rng = random.Random(6)
    vocabulary, rows = [f"w{i}" for i in range(60)], []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(3, 150))
        for _ in range(rng.randint(1, 14)):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(t)))
    rows += [(900, None), (901, ""), (902, "A b"), (903, "a  B"), (904, "a"), (905, " \n")]
    got = sorted((tuple(r) for r in minhash_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()), key=repr)
    assert got == brute_components(rows, words, percent)


def test_a_group_around_an_outer_centre_takes_few_links(spark, monkeypatch):
    """The classes of the most crowded lists lie far apart; each is similar to all others of the group."""
    rng = random.Random(16)
    base, rows = [f"b{i}" for i in range(200)], []

    def signature(text):
        sets, _ = minhash_dedup.shingle_sets([text.encode()], 3)
        return [int((sets * o + a).min() >> 32) for o, a in zip(minhash_dedup._ODD, minhash_dedup._ADD, strict=True)]

    first = signature(" ".join(base))
    for edits, same, count in ((3, True, 40), (2, False, 40)):
        while count:
            t = list(base)
            for at in rng.sample(range(5, 195, 5), edits):
                t[at] = f"e{rng.random()}"
            text = " ".join(t)
            if (signature(text) == first) == same:
                rows.append((len(rows), text))
                count -= 1
    made = collections.Counter()
    plain = minhash_dedup.materialise

    def counted(df, label, *args):
        out = plain(df, label, *args)
        made[label] = max(made[label], out.count())
        return out

    monkeypatch.setattr(minhash_dedup, "materialise", counted)
    got = sorted((tuple(r) for r in minhash_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()), key=repr)
    assert got == brute_components(rows, 3, 85) and {r[2] for r in got} == {0}
    assert made["links"] < 2 * len(rows) and made["rest"] < 2 * len(rows), made


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = {r.doc_id: r for r in minhash_dedup.digests(odd).collect() if r.doc_id is not None}
    assert rows[7].component_id == 6 and not rows[7].kept and rows[6].kept and rows[1].n_shingles == rows[3].n_shingles == 0 and rows[4].n_shingles == 1
    kept = minhash_dedup.keep_first(odd)
    assert kept.columns == odd.columns and 7 not in {r.doc_id for r in kept.collect()} and kept.where("doc_id is null").count() == 1
    assert minhash_dedup.digests(empty).count() == minhash_dedup.keep_first(empty).count() == 0


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (1, "something else with words of its own"), (2, base + " end"), (2, "a third text that nobody else has at all"), (None, base), (None, "no id and no copy anywhere to be found"), (3, "unique text of the third document"), (3, "unique text of the third document"), (4, None), (4, "")]
    kept = minhash_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # the copies of base leave the one without id, which is the smallest; of the repeated row one stays
    expected = [rows[4], rows[1], rows[3], rows[5], rows[6], rows[8], rows[9]]
    assert sorted(map(tuple, kept), key=repr) == sorted(expected, key=repr)


def test_match_threshold():
    assert 10 <= minhash_dedup.match_threshold(80) <= minhash_dedup.match_threshold(85) <= minhash_dedup.COORDINATES


def brute_signatures(text):
    anchors = set(spotsigs.ANCHORS)
    w = ["^", *regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).split()]
    out = set()
    for i, anchor in enumerate(w):
        content = [x for x in w[i + 1 :] if x not in anchors][: spotsigs.CHAIN]
        if content and (i == 0 or anchor in anchors):
            out.add((anchor, *content))
    return out


def like(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints(spark):
    rng = random.Random(7)
    vocabulary = [*spotsigs.ANCHORS[:12], *(f"word{i}" for i in range(40))]
    rows = [(3 * i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(60)] + [(None, "the first"), (1000, None), (1001, "of the and"), (1002, "é?"), (1003, "the cat\nsat"), (1004, "the of a the to cat in the of and to a in sat on"), (1005, "the " * 3000 + "end")]
    rows += [(2000 + i, rows[5][1] + f" word{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in spotsigs.digests(df).collect()}
    rows.sort(key=lambda r: key(r[0]))
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r, own = got[d], brute_signatures(t)
        assert (r.n_chars, r.edited_sha256, len(r.fingerprint), len(r.edited_fingerprint)) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), 16 * len(own), 16 * len(brute_signatures(edited)))
        assert r.near_edited == pytest.approx(like(own, brute_signatures(edited))) and r.near_next == pytest.approx(like(own, brute_signatures(after)))
    members, pairs = spotsigs.near_duplicates(df, 0.6)
    classes = {}
    for d, t in rows:
        if s := frozenset(brute_signatures(t or "")):
            classes.setdefault(s, d if d is not None else -(1 << 63))
    each = list(classes.items())
    expected = {(min(a, b), max(a, b)) for i, (x, a) in enumerate(each) for y, b in each[:i] if len(x & y) >= 0.6 * len(x | y)}
    assert {(r.a, r.b) for r in pairs.collect()} == expected and members.count() == sum(1 for _, t in rows if brute_signatures(t or ""))


def test_fingerprints_cover_texts_without_anchors(spark):
    cells = [f"cell{i}" for i in range(100)]
    edits = [[*cells[:i], "other", *cells[i + 1 :]] for i in (2, 9, 50, 99)]
    texts = [cells, *edits, cells[:11], [*cells[:10], "other"], ["the", *cells], ["the", *cells[:60], "other", *cells[61:]], [*cells[:50], "the", *cells[50:]]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sigs = {r.doc_id: set(r.sig) for r in df.select("doc_id", spotsigs.signatures(df["text"]).alias("sig")).collect()}
    assert len({frozenset(x) for x in sigs.values()}) == len(texts)
    assert len(sigs[0]) == 100 and all(like(sigs[0], sigs[i]) > 0.9 for i in (1, 2, 3, 4, 7, 8, 9))


def test_fingerprints_of_odd_rows(odd, empty):
    rows = spotsigs.digests(odd).collect()
    assert len(rows) == odd.count()
    assert len({r.fingerprint for r in rows if r.doc_id in (6, 7)}) == 1
    assert spotsigs.digests(empty).count() == 0
    only = spotsigs.digests(odd.where("doc_id = 11")).first()
    assert only.near_next == 1.0


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = regex.match(r"[^/?#]*", rest)[0]
    path = regex.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls(spark, empty):
    urls = [None, "foo", "HTTP://WWW.Example.COM/en/x.html?a=1#b", "http://sub.www.example.com/en/", "x://com", "x://xcom/en/", "http://a.net?x", "https://u@a.com:80/é//1/2", "http://a.net/es/://b", "a://b.net/fr/\n/2", "", "http://", "http://Ä.com/"]
    rng = random.Random(8)
    urls += [f"http://{rng.choice(['m', 'www', 'x'])}.{rng.choice(['example', 'other'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}{rng.choice(['', '.html', '?page=2'])}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge(df).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_verdict(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert {r.verdict for r in got.values() if r.host.endswith(".org") and "/de/" in r.path} == {"allow"}
    assert url_rules.judge(df.limit(0)).count() == 0
    assert url_rules.judge(spark.createDataFrame([(1, None), (1, None)], "page_id long, url string")).count() == 2


def test_mined_rules_equal_counting(spark):
    rng = random.Random(9)
    sets = [(sorted({f"t{rng.randint(0, 5)}" for _ in range(3)}),) for _ in range(200)]
    rows = [(s, "block" if "t0" in s and "t1" in s or rng.random() < 0.1 else "allow") for (s,) in sets]
    mined = {(tuple(r.needs), r.verdict): (r.confidence, r.support) for r in url_rules.mine(spark.createDataFrame(rows, "items array<string>, verdict string"), 0.02, 0.7).collect()}
    subsets = collections.Counter()
    for s, v in rows:
        for m in range(1, 2 ** len(s)):
            part = tuple(x for i, x in enumerate(s) if m >> i & 1)
            subsets[part] += 1
            subsets[part, v] += 1
    every = {(p, v): (subsets[p, v] / subsets[p], subsets[p, v] / 200) for k in list(subsets) if len(k) == 2 and isinstance(k[0], tuple) for p, v in [k]}
    good = {k: c for k, c in every.items() if c[0] >= 0.7 and c[1] >= 0.02}
    expected = {(p, v): c for (p, v), c in good.items() if not any((p[:i] + p[i + 1 :], v) in good and good[p[:i] + p[i + 1 :], v][0] >= c[0] for i in range(len(p)))}
    assert mined.keys() == expected.keys() and all(mined[k] == pytest.approx(expected[k]) for k in mined)


def test_matched_rules_equal_search(spark):
    rng = random.Random(12)
    sets = [sorted({f"t{rng.randint(0, 9)}" for _ in range(rng.randint(0, 5))}) for _ in range(150)]
    rules = {(tuple(sorted(rng.sample([f"t{i}" for i in range(10)], rng.randint(1, 3)))), rng.choice(["allow", "block"])): (rng.choice([0.8, 0.9, 1.0]), rng.choice([0.1, 0.2])) for _ in range(40)}
    table = spark.createDataFrame([(list(n), len(n), v, c, s) for (n, v), (c, s) in rules.items()], "needs array<string>, n_needs int, verdict string, confidence double, support double")
    pages = spark.createDataFrame([(i, s) for i, s in enumerate(sets + [sets[0]] * 400)], "page_id long, items array<string>")
    groups = pages.groupBy("items").count().withColumnRenamed("count", "n")
    got = {r.page_id: r.best for r in url_rules.looked_up(pages, groups, url_rules.match(groups, table)).collect()}
    assert len(got) == 550
    for i, s in enumerate(sets + [sets[0]] * 400):
        fits = [(c, sup, -len(n), " ".join(n), v) for (n, v), (c, sup) in rules.items() if set(n) <= set(s)]
        assert (tuple(got[i]) if got[i] else None) == (max(fits) if fits else None)
