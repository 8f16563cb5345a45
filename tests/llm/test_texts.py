"""Operators on single texts: tokens, packing, personal data, media, language, and what they do with odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from evispark.llm import bpe, langid, lm_score, media_ts, packing, pii

ALPHABET = [chr(x) for x in [*range(0x250), *range(0x300, 0x330), *range(0x370, 0x400), 0x1E9E, 0x2126, 0x212A, 0x1F600, 0x4E00, 0xAC00, 0x1100, 0x1161]]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def test_ids_and_texts_equal_the_librarys(library):
    rng = random.Random(1)
    texts = ["it's I'LL 'RE", "ΑΣ ΣΑΣ", "<|endoftext|>hi <|startoftext|>", "<|END", "½ Ⅷ ٣٤", "a b　c", "</w> a</w>b"] + ["".join(rng.choices(ALPHABET, k=40)) for _ in range(1500)]
    tool = bpe.TextCodec(bpe.tokenizer_path())
    for text, ref in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(tool.encode(text), "<u4").tolist()
        assert ids == ref.ids
        assert tool.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_token_encodes_to_itself():
    """What the dynamic programme takes for granted of a vocabulary."""
    tool = bpe.WordBpe(bpe.tokenizer_path())
    for piece, i in [(p, i) for i, p in enumerate(tool.pieces) if p not in tool.added][::37]:
        word = piece.removesuffix("</w>")
        assert tool.encode_symbols(word[:-1] + chr(ord(word[-1]) + bpe.END) if piece.endswith("</w>") else piece) == [i]


def test_digests_of_odd_rows(odd, empty, library):
    got = sorted((tuple(r) for r in bpe.digests(odd).collect()), key=repr)
    expected = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected.append((r.doc_id, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(expected, key=repr)
    assert bpe.digests(empty).count() == bpe.encode_documents(empty).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(odd.where("doc_id = 11"))).first().text
    assert back == " ".join(["word</w>"] * 4000)


def test_first_fit_decreasing_equals_the_plain_search():
    rng = random.Random(2)
    for _ in range(50):
        lengths = sorted((rng.randint(1, 2048) for _ in range(rng.randint(1, 60))), reverse=True)
        free, expected = [], []
        for n in lengths:
            at = next((i for i, f in enumerate(free) if f >= n), len(free))
            if at == len(free):
                free.append(2048)
            expected.append((at, 2048 - free[at]))
            free[at] -= n
        assert list(zip(*packing.first_fit_decreasing(lengths), strict=True)) == expected
    with pytest.raises(ValueError):
        packing.CapacityTree(1, 5).place(6)


def test_packing_of_odd_rows(odd, empty, library):
    rows = packing.pack(odd, group_docs=4).collect()
    parts, docs = defaultdict(list), defaultdict(int)
    for r in rows:
        parts[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id] += r.length
    for p in parts.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    expected = defaultdict(int)
    for r in odd.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        expected[r.doc_id] += len(ids)
        if r.doc_id == 11:
            crcs = [zlib.crc32(np.asarray(ids[s : s + 2048], "<u4").tobytes()) for s in range(0, len(ids), 2048)]
            assert [x.ids_crc32 for x in sorted((x for x in rows if x.doc_id == 11), key=lambda x: x.start)] == crcs
    assert docs == expected
    assert packing.pack(empty).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind in pii.KINDS:
        for m in re.finditer(BASE[kind], text):
            digits = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_plain_finds_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20000):
        text = "".join(rng.choices("a.@+1 -()29é5x", k=25))
        assert pii.plain(text) == brute(text)


@pytest.mark.parametrize(
    "text, found",
    [
        ("mail john dot doe at example dot com now", [("email", "john dot doe at example dot com")]),
        ("to john [at] example [dot] org!", [("email", "john [at] example [dot] org")]),
        ("call plus four nine one five one two three four five six seven", [("phone", "plus four nine one five one two three four five six seven")]),
        ("jоhn＠ехample．com", [("email", "jоhn＠ехample．com")]),
        ("one nine two dot one six eight dot one dot two", [("ip", "one nine two dot one six eight dot one dot two")]),
        ("four" + " one" * 15, [("card", "four" + " one" * 15)]),
        ("a@b.co and a [at] b [dot] co", [("email", "a@b.co"), ("email", "a [at] b [dot] co")]),
        ("He looked at the door. And dot the i, one, two, three.", []),
        ("Ελλάδα и Россия at home", []),
    ],
)
def test_disguises_map_back_to_the_source(text, found):
    base, every = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in every] == found and set(base) <= set(every)


@pytest.mark.parametrize(
    "text, found",
    [
        ("john at example.com", [("email", "john at example.com")]),
        ("one zero point zero point zero point one", [("ip", "one zero point zero point zero point one")]),
        ("(plus 49 30 1234567", [("phone", "plus 49 30 1234567")]),
        ("Tel:plus 49 30 1234567", [("phone", "plus 49 30 1234567")]),
        ("one ſıx two point one point two point nıne", [("ip", "one ſıx two point one point two point nıne")]),
    ],
)
def test_disguises_need_no_cue_elsewhere(text, found):
    for tail in ("", "; plus", "; dot", "; –", "; а"):
        assert [(k, (text + tail)[a:b]) for k, a, b in pii.find(text + tail)[1]] == found


def test_longer_finds_stay_beside_plain_ones():
    text = "call +49 30 123456 seven eight nine now"
    base, every = pii.find(text)
    assert [text[a:b] for _, a, b in base] == ["+49 30 123456"] and set(base) < set(every)
    assert "+49 30 123456 seven eight nine" in [text[a:b] for _, a, b in every]
    assert pii.mask(text) == "call <phone> now"


def test_hints_leave_no_match_out(monkeypatch):
    letters = set("".join([*pii.DIGIT_WORDS, "dotpunktpointpuntoatarrobaplus"]))
    same = re.compile(f"[{''.join(letters)}]", re.I)
    assert {chr(c) for c in range(0x110000) if same.match(chr(c)) and chr(c).translate(pii._FOLD).lower() not in letters} == set()
    rng = random.Random(11)
    parts = [*"()[]{}<>.,-@+ \t\n1a–а", *[" "] * 12, "at", "At", "arroba", "dot", "DOT", "punkt", "point", "punto", "plus", "un", "Six", "zwei", "cinq", "one", "nın", "ſix", "a.b", "12 34 567 89 10", "john", "com"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(3000)]
    texts += [" ".join(rng.choices(parts[16:], k=rng.randint(1, 30))) for _ in range(3000)]
    quick = [(pii.find(t), *pii.normalise(t)) for t in texts]
    assert sum(flat != t for t, (_, flat, _, _) in zip(texts, quick, strict=True)) > 300
    monkeypatch.setattr(pii, "hints", lambda text: (True,) * len(pii.STEPS))
    for t, (found, flat, begin, end) in zip(texts, quick, strict=True):
        whole = pii.normalise(t)
        assert (found, flat, [*begin], [*end]) == (pii.find(t), whole[0], [*whole[1]], [*whole[2]]), t


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + "(" * 300_000, "a@" * 150_000):
        pii.find(text)


def test_redaction(odd, empty):
    assert pii.mask("write to a@b.co, 1.2.3.4") == "write to <email>, <ip>"
    assert sorted(pii.redact(odd).collect(), key=repr) == sorted(odd.collect(), key=repr)
    assert pii.redact(empty).count() == pii.detect(empty).count() == 0
    assert pii.detect(odd).count() == odd.count()


def test_streams_round_trip(odd, empty):
    for n in [*range(0, 800, 7), *range(11_800, 12_700, 13), 100_000]:
        payload = media_ts.padded("é" * n)[1]
        media = media_ts.mux(payload)
        s = media_ts.demux(media)
        assert s.payload == payload and len(media) % 188 == 0 and not (s.lost or s.bad_units or s.bad_tables or s.skipped)
        assert s.programs == {1: media_ts.PMT_PID} and {p: e.kind for p, e in s.streams.items()} == {media_ts.ES_PID: media_ts.STREAM_TYPE}
        assert s.times == [i * media_ts.UNIT_TICKS for i in range(len(s.times))] and len(s.random_access) == -(-len(s.times) // media_ts.KEY_INTERVAL)
        assert all(media[o + 5] & 0x40 for _, o in s.random_access)
    lossy = media[: 188 * 5] + media[188 * 6 :]
    assert media_ts.demux(lossy).lost == 1 and media_ts.demux(b"abc" + media).payload == payload and media_ts.demux(b"").packets == 0
    rows = {r.doc_id: r for r in media_ts.read_back(media_ts.store(odd)).collect()}
    assert rows[1].payload_bytes == 192 and rows[1].n_bytes == 0 and rows[9].n_bytes == 600 and rows[6].media_sha256 == rows[7].media_sha256
    assert media_ts.read_back(media_ts.store(empty)).count() == 0


def ts_packets(pid, data, counter=0, flags=None):
    """Transport packets of one id that carry data, the first with an adaptation field of these flags if there are any."""
    out, first = [], True
    while data or first:
        field = bytes([flags]) if first and flags is not None else b""
        room = 184 - (1 + len(field) if field else 0)
        part, data = data[:room], data[room:]
        fill = room - len(part)
        if field or fill:
            stuffed = field + b"\xff" * (fill if field else max(0, fill - 1))
            if stuffed and not field:
                stuffed = b"\x00" + stuffed[1:]
            head = bytes([0x30 | counter & 15, len(stuffed)]) + stuffed
        else:
            head = bytes([0x10 | counter & 15])
        out.append(bytes([0x47]) + ((0x4000 if first else 0) | pid).to_bytes(2, "big") + head + part)
        assert len(out[-1]) == 188
        counter, first = counter + 1, False
    return out


def test_streams_with_long_tables_two_programs_and_decoding_times():
    streams = [(0x200 + i, 0x1B) for i in range(60)] + [(0x300, 0x0F)]
    entries = b"".join(bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x00" for pid, kind in streams)
    maps = media_ts.section(0x02, 1, (0xE200).to_bytes(2, "big") + b"\xf0\x00" + entries)
    other = media_ts.section(0x02, 2, (0xE400).to_bytes(2, "big") + b"\xf0\x03\x0a\x01\x00" + bytes([0x06]) + (0xE400).to_bytes(2, "big") + b"\xf0\x00")
    pat = media_ts.section(0x00, 1, b"".join(n.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for n, pid in ((0, 0x10), (1, 0x50), (2, 0x50))))
    assert len(maps) > 300
    stamp = lambda mark, t: bytes([mark << 4 | 1 | t >> 29 & 0x0E, t >> 22 & 0xFF, 1 | t >> 14 & 0xFE, t >> 7 & 0xFF, 1 | t << 1 & 0xFE])
    video = b"\x00\x00\x01\xe0\x00\x00\x80\xc0\x0a" + stamp(3, 9000) + stamp(1, 5400) + b"v" * 500  # of unbounded size
    audio = b"\x00\x00\x01\xc0" + (8 + 77).to_bytes(2, "big") + b"\x80\x80\x05" + stamp(2, 7200) + b"a" * 77
    table = ts_packets(0x50, b"\x00" + maps + other)  # the second section begins where the first ends
    assert len(table) >= 2
    data = b"".join([*ts_packets(0, b"\x00" + pat), *table, *ts_packets(0x200, video, flags=0x40), *ts_packets(0x300, audio)])
    s = media_ts.demux(data)
    assert (s.bad_tables, s.bad_units, s.lost, s.programs) == (0, 0, 0, {1: 0x50, 2: 0x50})
    assert {p: e.kind for p, e in s.streams.items()} == dict(streams) | {0x400: 0x06}
    assert (s.streams[0x200].payload, s.streams[0x200].times, s.streams[0x200].decoding) == (b"v" * 500, [9000], [5400])
    assert (s.streams[0x300].payload, s.streams[0x300].times, s.streams[0x300].decoding) == (b"a" * 77, [7200], [7200])
    assert s.random_access == [(9000, 188 * (1 + len(table)))] and s.payload == b"v" * 500 + b"a" * 77
    broken = bytearray(data)
    broken[188 + 100] ^= 1
    assert media_ts.demux(bytes(broken)).bad_tables == 1


def test_streams_with_repeated_lost_and_discontinuous_packets():
    payload = bytes(range(256)) * 288
    media = media_ts.mux(payload)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    starts = [i for i, x in enumerate(packets) if x[1] & 0x40 and i > 1]
    whole = media_ts.demux(media)
    for at in (2, 5, starts[1], starts[1] - 1, len(packets) - 1):
        twice = media_ts.demux(b"".join([*packets[: at + 1], packets[at], *packets[at + 1 :]]))
        assert (twice.payload, twice.lost, twice.times) == (payload, 0, whole.times) and twice.streams[media_ts.ES_PID].duplicates == 1
    unit = media_ts.UNIT_BYTES
    for at, bad in ((starts[1] + 3, 1), (starts[1] - 1, 0)):
        less = media_ts.demux(b"".join([*packets[:at], *packets[at + 1 :]]))
        own = less.streams[media_ts.ES_PID]
        cut = len(payload) - len(less.payload)
        assert own.lost == 1 and own.damaged == [bad] and less.times == whole.times and cut > 0
        assert less.payload == payload[: (bad + 1) * unit - cut] + payload[(bad + 1) * unit :]
    jump = [x if i < starts[2] else x[:3] + bytes([x[3] & 0xF0 | (x[3] + 5) & 15]) + x[4:] for i, x in enumerate(packets)]
    assert media_ts.demux(b"".join(jump)).lost == 1
    jump[starts[2]] = jump[starts[2]][:5] + bytes([jump[starts[2]][5] | 0x80]) + jump[starts[2]][6:]
    told = media_ts.demux(b"".join(jump))
    assert told.lost == 0 and told.payload == payload and not told.streams[media_ts.ES_PID].damaged


def test_language(spark, odd, empty):
    words = {"en": "the house and the water of them that think", "de": "das haus und nicht das wasser von denen schön", "fr": "la maison et leau de ceux qui pensent très"}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(words[x].split(), k=30)), x) for i, x in enumerate(list(words) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.learn(langid.training_rows(df))).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    model = langid.learn(langid.training_rows(df))
    odd_rows = {r.text: r for r in langid.predict(odd, model).collect()}
    assert all(odd_rows[t].lang_pred == "und" and odd_rows[t].score == 0 for t in (None, "", " \n\t ", "12345 !!! ---"))
    nothing = langid.learn(langid.training_rows(empty))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.accept(odd).columns == odd.columns and langid.accept(empty).count() == 0


def test_language_equals_counting(spark):
    """Grams by share in plain sets, and the most frequent language by their counts; a long text is cut into pieces and agrees."""
    rng = random.Random(9)
    letters = {"aa": "abcdef", "bb": "defghi", "cc": "ghijabÉß"}
    word = {x: ["".join(rng.choices(c, k=rng.randint(1, 7))) for _ in range(200)] for x, c in letters.items()}
    rows = [(i, " ".join(rng.choices(word[x] + (word["aa"] if i % 7 == 0 else []), k=rng.randint(1, 60))) + rng.choice(["", "!", " 12-"]), x) for i, x in enumerate(list(word) * 60)]
    rows.append((1000, "".join(rng.choices(letters["bb"] + "  .İ", k=3 * langid.PIECE + 17)), "bb"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]

    def grams(text):
        c = "".join(x if x.isalpha() else " " for x in f" {text.lower()} ")
        return [c[i - 1 : i + 2] for i in range(1, len(c) - 1) if c[i] != " "]

    counts = {x: defaultdict(int) for x in word}
    for _, text, x in learned:
        for g in grams(text):
            counts[x][g] += 1
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    most = defaultdict(float)
    for c in share.values():
        for g, p in c.items():
            most[g] = max(most[g], p)
    known = {x: {g for g, p in c.items() if p >= langid.RATIO * most[g]} for x, c in share.items()}
    got = {r.doc_id: r for r in langid.predict(df, langid.learn(langid.training_rows(df))).collect()}
    for i, text, _ in rows:
        own = grams(text)
        hits = sorted(((sum(g in known[x] for g in own), x) for x in known), reverse=True)
        assert got[i].score == pytest.approx(hits[0][0] / len(own), abs=2e-3)
        if hits[0][0] > hits[1][0] + 0.01 * len(own):
            assert got[i].lang_pred == hits[0][1]


def test_filter_false_positives_are_as_expected():
    f = langid.Filter(["a", "b"])
    codes = np.random.default_rng(0).permutation(1 << langid.GRAM_BITS)
    f.add(codes[:200_000], np.zeros(200_000, np.int64), np.ones(200_000, np.uint64))
    hits = f.hits(codes[300_000:400_000], np.zeros(100_000, np.int64), 1)[0]
    assert f.hits(codes[:1000], np.zeros(1000, np.int64), 1)[0, 0] == 1000
    assert hits[0] / 100_000 == pytest.approx(f.false_positives()[0], rel=0.1) and hits[1] == 0


def lm_brute(texts, order):
    """Scores of lists of ids, each by the counts of the others."""
    from collections import Counter

    grams = lambda v: Counter(tuple(v[i : i + k]) for k in range(1, order + 1) for i in range(len(v) - k + 1))
    each = [grams(v) for v in texts]
    total = Counter()
    for g in each:
        total.update(g)
    size = sum(map(len, texts))
    out = []
    for v, g in zip(texts, each, strict=True):
        c = lambda x: total[x] - g[x]  # noqa: B023, E731
        value = 0
        for i, w in enumerate(v):
            for back, k in enumerate(range(min(i, order - 1), -1, -1)):
                h, hw = tuple(v[i - k : i]), tuple(v[i - k : i + 1])
                if k == 0:
                    share = max(c((w,)), 1) / max(size - len(v), 1)
                elif c(hw) > 0:
                    share = c(hw) / c(h)
                else:
                    continue
                value += round(np.log10(lm_score.BACKOFF**back * share) * lm_score.UNIT)
                break
        out.append(value / lm_score.UNIT if v else None)
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_scores_equal_counting(odd, empty, library, order):
    rows = odd.collect()
    ids = [library.encode(r.text or "", add_special_tokens=False).ids for r in rows]
    expected = [(r.doc_id, len(v), x) for r, v, x in zip(rows, ids, lm_brute(ids, order), strict=True)]
    got = [(r.doc_id, r.n_tokens, r.log10_score) for r in lm_score.score(odd, order=order).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert lm_score.score(empty, order=order).count() == 0


def test_lm_scores_over_many_chunks_and_buckets(spark, library, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK", 300)
    monkeypatch.setattr(lm_score, "BUCKET", 900)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["the", "cat", "sat", "zebra", "on", "mat", "xyz"], weights=[9, 4, 3, 1, 5, 2, 1], k=rng.randint(0, 90)))) for i in range(150)] + [(3, "the cat sat")] * 2
    ids = [library.encode(t, add_special_tokens=False).ids for _, t in rows]
    expected = [(d, len(v), x) for (d, _), v, x in zip(rows, ids, lm_brute(ids, 3), strict=True)]
    got = [(r.doc_id, r.n_tokens, r.log10_score) for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
