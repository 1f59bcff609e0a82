"""PII, language ID, FLAC and chat formatting."""

import hashlib
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaitwork.llm import chat, flac, language_id, pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(6000):
        text = "".join(rng.choice("a1.@+- ()0292x%_5\n4") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute_base(text)


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("mail jon.doe [at] example [dot] com now", "email", "jon.doe [at] example [dot] com"),
    ("jon at mail dot example dot org", "email", "jon at mail dot example dot org"),
    ("jоhn@ехample.com", "email", "jоhn@ехample.com"),
    ("１９２.168.1.1", "ip", "１９２.168.1.1"),
    ("call plus one five five five two three four six seven eight nine", "phone", "plus one five five five two three four six seven eight nine"),
    ("card four one one one 1111 1111 one one one one", "card", "four one one one 1111 1111 one one one one"),
    ("4​111 1111 1111 1111", "card", "4​111 1111 1111 1111"),
])
def test_disguises_map_back_to_the_source(text, kind, span):
    base, every = pii.find(text)
    assert [text[a:b] for a, b in every[kind]] == [span] and not base[kind]
    assert span not in pii.redacted(text, every)


@pytest.mark.parametrize(("text", "span"), [
    ("to jоhn.smith@example.com now", "jоhn.smith@example.com"),
    ("to john@example.cоm now", "john@example.cоm"),
    ("to john [dot] smith@example.com now", "john [dot] smith@example.com"),
])
def test_disguises_reach_beyond_base_spans(text, span):
    base, every = pii.find(text)
    assert len(base["email"]) == 1 and span in [text[a:b] for a, b in every["email"]]
    assert pii.redacted(text, every) == "to [EMAIL] now"


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("at one nine two dot one six eight dot zero dot one ok", "ip", "one nine two dot one six eight dot zero dot one"),
    ("at one nine two.one six eight.zero.one ok", "ip", "one nine two.one six eight.zero.one"),
    ("at one nine two . one six eight . zero . one ok", "ip", "one nine two . one six eight . zero . one"),
    ("at 192 dot one six eight [dot] zero.1 ok", "ip", "192 dot one six eight [dot] zero.1"),
    ("at 10.0 dot 0 dot 7 ok", "ip", "10.0 dot 0 dot 7"),
    ("«jоhn@ехample.com»", "email", "jоhn@ехample.com"),
    ("“jоhn@ехample.com”—wie", "email", "jоhn@ехample.com"),
    ("siehe „１９２.168.1.1“…", "ip", "１９２.168.1.1"),
    ("l’adresse:jоhn@ехample.com,привет", "email", "jоhn@ехample.com"),
    ("card four 1 one 1 one 1 one 1 one 1 one 1 one 1 one 1 ok", "card", "four 1 one 1 one 1 one 1 one 1 one 1 one 1 one 1"),
    ("card 4 one 1 one 1 one 1 one 1 one 1 one 1 one 1 one ok", "card", "4 one 1 one 1 one 1 one 1 one 1 one 1 one 1 one"),
])
def test_disguises_in_any_order_and_between_signs(text, kind, span):
    base, every = pii.find(text)
    assert [text[a:b] for a, b in every[kind]] == [span] and not base[kind]


@pytest.mark.parametrize("text", ["I count one. two. three. four", "one dot two dot three", "a 3 one b 5, two", "one two.300.zero.one", "«Привет», “мир” — да…"])
def test_prose_of_digits_stays(text):
    assert not any(pii.find(text)[1].values())


def test_new_scans_take_linear_time():
    for text in ("zero.one " * 12_000, "one two dot " * 9_000, "[dot] " + "1" * 100_000, "one 1" + "." * 100_000, "“а" * 40_000, "1 dot " * 20_000, "zero one dot " + "9" * 100_000):
        began = time.perf_counter()
        pii.find(text)
        assert time.perf_counter() - began < 10


def test_added_spans_inside_base_spans_are_dropped():
    base, every = pii.find("to jon@example.com and 1​92.168.0.1 now")
    assert len(every["email"]) == len(base["email"]) == 1 and pii.find("jon@example.com one two")[1] == pii.base_spans("jon@example.com one two")


@pytest.mark.parametrize("text", ["look at example.com ok", "we met at the dot there", "Привет, мир", "one two three", "in eins zwei at of the"])
def test_prose_stays(text):
    assert not any(pii.find(text)[1].values())


def test_scans_take_linear_time():
    for text in ("1" * 100_000, "a." * 50_000, "+1" + "(" * 50_000, "zero " * 20_000, "a at " * 20_000, "@" * 50_000, "a@" * 50_000, "1-" * 50_000):
        began = time.perf_counter()
        pii.find(text)
        assert time.perf_counter() - began < 10


def test_many_addresses_and_one_disguise_take_linear_time():
    text = " ".join(f"user{k}@mail{k}.example.com" for k in range(50_000)) + " jane [at] example [dot] com"
    began = time.process_time()
    base, every = pii.find(text)
    assert time.process_time() - began < 20
    assert len(base["email"]) == 50_000 and len(every["email"]) == 50_001 and every["email"][-1] == (text.index("jane"), len(text))


def test_covered():
    spans = [(2, 5), (5, 9), (12, 20)]
    for a in range(22):
        for b in range(a + 1, 22):
            assert pii.covered((a, b), spans) == any(x <= a and b <= y for x, y in spans)


def test_pii_of_odd_documents(edge_docs, no_docs):
    rows = {r.doc_id: r for r in pii.spans_of(edge_docs).collect()}
    assert (rows[10].n_email, rows[10].n_ip, rows[10].n_card, rows[10].n_phone) == (1, 1, 1, 1)
    assert rows[0].spans == "" and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(edge_docs).collect()}
    assert clean[0] is None and "a.b@c.de" not in clean[10] and clean[4] == "the cat sat on the mat. the cat sat on the mat."
    assert pii.spans_of(no_docs).count() == 0 and pii.redact(no_docs).count() == 0


def test_bit_sliced_filters_answer_with_all_languages():
    a, b = language_id.grams("alpha beta gamma"), language_id.grams("beta delta")
    filters = language_id.Filters(["x", "y"], {"x": a, "y": b})
    assert (filters.masks(a) & np.uint64(1)).all() and (filters.masks(b) & np.uint64(2)).all()
    both = np.intersect1d(a, b)
    assert len(both) and (filters.masks(both) == 3).all()
    assert filters.predict("beta beta beta alpha gamma")[0] == "x"
    assert filters.predict(None) == filters.predict("12 .") == ("und", 0.0)
    long = "gamma alpha " * 200_000  # over a block
    assert filters.predict(long)[0] == "x"


def plain_prediction(text, languages, ngrams, size, hashes):
    """Bloom filters as sets of slots; counts over all windows, corrected for each filter's chance."""
    filters = {name: {int(x) for at in language_id.slots(ngrams[name], size, hashes) for x in at} for name in languages}
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    low = " " + re.sub(" +", " ", low).lstrip() + " "
    if not low.strip():
        return "und", 0.0
    windows = [low[k : k + 4] for k in range(len(low) - 3)]
    fair = {}
    for name in languages:
        chance, hits = (len(filters[name]) / size) ** hashes, 0
        for w in windows:
            code = 0
            for c in w:
                code = (code * 0x110001 + ord(c)) % 2**64
            hits += all(int(at[0]) in filters[name] for at in language_id.slots(np.array([code], np.uint64), size, hashes))
        fair[name] = max(0.0, (hits - chance * len(windows)) / (1 - chance))
    best = max(languages, key=lambda name: (fair[name], [-ord(c) for c in name]))
    return best, fair[best] / sum(fair.values()) if sum(fair.values()) else 0.0


@pytest.mark.parametrize("many", [3, 130])
def test_predictions_against_plain_counts(many):
    """Small, full filters, so that chance hits matter; also masks of several words."""
    rng = random.Random(many)
    names = sorted(f"l{k:03}" for k in range(many))
    stock = ["".join(rng.choice("abcdeßé") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    ngrams = {n: np.unique(language_id.grams(" ".join(rng.sample(stock, 12)))) for n in names}
    filters = language_id.Filters(names, ngrams, 512, 2)
    for _ in range(12):
        text = rng.choice(["", "7 ", "¿"]) + " ".join(rng.choice(stock) + rng.choice(["", ".", " 5"]) for _ in range(rng.randint(0, 15)))
        want = plain_prediction(text, names, ngrams, 512, 2)
        got = filters.predict(text)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9


def test_many_labels(spark):
    word = lambda k: "".join(chr(97 + (k // 26**j) % 26) for j in range(3)) * 3
    rows = [(k, " ".join([word(k % 100)] * 5), f"lang{k % 100:03}") for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.fit(docs)
    assert len(filters.languages) == 100
    got = language_id.predictions(docs, filters).collect()
    assert all(r.lang_pred == f"lang{r.doc_id % 100:03}" for r in got if r.lang_pred != "und")
    with pytest.raises(ValueError, match="labels"):
        language_id.fit(docs.withColumn("lang", F.concat("lang", F.col("doc_id").cast("string"))).unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").cast("string").alias("lang"))))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.predictions(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_language_of_odd_documents(edge_docs, no_docs):
    filters = language_id.fit(edge_docs)
    rows = {r.doc_id: r for r in language_id.predictions(edge_docs, filters).collect()}
    assert filters.languages == ["en"] and rows[0].lang_pred == rows[1].lang_pred == "und"
    assert language_id.fit(no_docs).languages == [] and language_id.predictions(no_docs, filters).count() == 0
    assert all(r.lang_pred == "und" for r in language_id.predictions(edge_docs, language_id.fit(no_docs)).collect())


def test_flac_round_trip_and_seeking():
    rng = random.Random(5)
    loads = [bytes(64), bytes(range(256)) * 40, rng.randbytes(64 * 150), bytes([0, 255] * 5000) + bytes(48), flac.payload(""), flac.payload("é" * 3000), b"\x80" * 4000 + b"\x00" * 96]
    coded = flac.encode_many(loads)
    for load, x in zip(loads, flac.decode_many(coded), strict=True):
        assert (x + 128).astype(np.uint8).tobytes() == load
    assert (flac.read_at(coded[1], 5000, 3000) + 128).astype(np.uint8).tobytes() == loads[1][5000:8000]
    assert flac.encode_many([loads[2]])[0] == coded[2]
    for at, what in ((3000, "CRC-16"), (len(coded[1]) - 1, "CRC-16"), (30, "MD5")):
        bad = bytearray(coded[1])
        bad[at] ^= 1
        with pytest.raises(flac.FlacError, match=what):
            flac.decode_many([bytes(bad)])


def test_flac_of_other_encoders():
    """An LPC subframe with a shift, and a constant one, written by hand."""
    samples = [10, 12, 14, 17, 19, 22, 25, 27]
    coefficients, shift = [3, -1], 1
    bits = f"{(32 | 1) << 1:08b}" + f"{samples[0]:08b}{samples[1]:08b}" + f"{4:04b}" + f"{shift:05b}" + f"{3:05b}" + f"{-1 & 31:05b}" + "00" + "0000" + f"{2:04b}"
    for n in range(2, 8):
        r = samples[n] - ((coefficients[0] * samples[n - 1] + coefficients[1] * samples[n - 2]) >> shift)
        z = r << 1 ^ r >> 31
        bits += "0" * (z >> 2) + "1" + f"{z & 3:02b}"
    bits += "0" * (-len(bits) % 8)
    for body, want in ((bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)), samples), (bytes([0, 7]), [7] * 8)):
        frame = flac._header(0, 8) + body
        frame += int(flac.crc16_many(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
        info = (8).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 8).to_bytes(8, "big") + bytes(16)
        assert flac.decode_many([b"fLaC\x80\x00\x00\x22" + info + frame])[0].tolist() == want


def without_points(data, keep):
    """The stream with only the seek points that `keep` picks (no table if none)."""
    size = int.from_bytes(data[43:46], "big")
    points = b"".join(data[46 + k : 46 + k + 18] for k in range(0, size, 18) if keep(k // 18))
    info = bytearray(data[4:42])
    info[0] = 0x00 if points else 0x80
    table = b"\x83" + len(points).to_bytes(3, "big") + points if points else b""
    return b"fLaC" + bytes(info) + table + data[46 + size :]


@pytest.mark.parametrize("keep", [lambda k: False, lambda k: k % 7 == 3, lambda k: k == 0])
def test_flac_without_or_with_few_seek_points(keep):
    rng = random.Random(9)
    load = b"".join([rng.randbytes(9000), b"\xff\xf8\xff\xf8" * 4000, bytes(range(256)) * 200, b"plain words " * 1000])
    load = load[: len(load) // 64 * 64]
    data = without_points(flac.encode_many([load])[0], keep)
    assert (flac.decode_many([data])[0] + 128).astype(np.uint8).tobytes() == load
    for at, n in ((0, 10), (4090, 20), (len(load) - 5, 5), (30000, 9000), (len(load), 4)):
        assert (flac.read_at(data, at, n) + 128).astype(np.uint8).tobytes() == load[at : at + n]


def test_flac_by_slices_is_the_same_stream(monkeypatch):
    rng = random.Random(2)
    loads = [rng.randbytes(64 * n) for n in (1, 700, 3, 64, 65)]
    whole = flac.encode_many(loads)
    monkeypatch.setattr(flac, "TOGETHER", 9000)
    assert flac.encode_many(loads) == whole
    blocks = list(flac.decode_frames(whole))
    assert [b"".join(flac.unsigned(x) for k, _, x in blocks if k == n) for n in range(5)] == loads
    assert [s for k, s, _ in blocks if k == 1] == list(range(0, 64 * 700, 4096))


def test_flac_wasted_bits():
    """Verbatim samples whose low two bits are left out."""
    samples = [4, -8, 12, 100, -128, 0, 64, 8]
    bits = f"{1 << 1 | 1:08b}" + "01" + "".join(f"{x >> 2 & 63:06b}" for x in samples)
    bits += "0" * (-len(bits) % 8)
    frame = flac._header(0, 8) + bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
    frame += int(flac.crc16_many(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    info = (8).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 8).to_bytes(8, "big") + bytes(16)
    assert flac.decode_many([b"fLaC\x80\x00\x00\x22" + info + frame])[0].tolist() == samples


def test_flac_query_columns_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r for r in queries.op6_flac(spark, "/root/testdata/sf0.001").collect()}
    media = {r.doc_id: bytes(r.media) for r in flac.encode_column(docs).collect()}
    for doc, text in docs.collect():
        raw = (text or "").encode()
        load = raw + bytes(-len(raw) % 64 if raw else 64)
        x = [b - 128 for b in load]
        r = rows[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[doc]), hashlib.sha256(media[doc]).hexdigest())
        rms, crossings = math.sqrt(sum(v * v for v in x) / len(x)), sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert r.feature == f"n={len(x)};peak={max(map(abs, x))};rms={rms:.4f};crossings={crossings}"


def test_flac_of_odd_documents(edge_docs, no_docs):
    media = flac.encode_column(edge_docs)
    rows = {r.doc_id: r for r in flac.read_back(media).collect()}
    assert rows[0].payload_bytes == 64 and rows[0].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest()
    assert rows[7].n_bytes == 5000 and rows[7].payload_bytes == 5056
    blocks = flac.pcm_blocks(media.where("doc_id = 7")).orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks)[:5000] == b"x" * 5000 and blocks[1].sample_offset == 4096
    assert flac.read_back(flac.encode_column(no_docs)).count() == 0


EVENTS = "conv_id string, turn long, kind string, role string, call_id string, tool string, arguments string, content string, needs array<string>"


def test_chat_links_orders_and_checks(spark):
    rows = [
        ("c", 0, "call", "assistant", "b", "respond", '{"turn":1,"text":"x"}', None, ["a"]), ("c", 1, "call", "assistant", "a", "respond", '{"text":"x","turn":"1"}', None, []),
        ("c", 2, "result", "tool", "a", None, None, "ok", None), ("c", 0, "result", "tool", "b", None, None, "early", None), ("c", 5, "result", "tool", "zz", None, None, "orphan", None),
        ("d", 0, "call", "assistant", "p", "respond", "{bad", None, ["q"]), ("d", 1, "call", "assistant", "q", "other", '{"z":{"b":1,"a":[1, 2]}}', None, ["p"]),
        (None, 0, "message", "user", None, None, None, None, None),
    ]
    got = chat.formatted(spark.createDataFrame(rows, EVENTS), chat.RESPOND)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    by = {(r.conv_id, r.kind, r.call_id): r for r in got.collect()}
    order = [r.call_id + r.kind[0] for r in sorted((r for r in by.values() if r.conv_id == "c"), key=lambda r: r.position)]
    assert order == ["ac", "ar", "bc", "br", "zzr"]
    assert by["c", "call", "b"].valid and not by["c", "call", "a"].valid and not by["c", "result", "zz"].linked
    assert by["d", "call", "p"].cyclic and by["d", "call", "q"].cyclic and not by["c", "result", "zz"].cyclic
    assert by["d", "call", "q"].json == '{"arguments":{"z":{"a":[1,2],"b":1}},"id":"q","kind":"call","role":"assistant","tool":"other"}'
    assert by["d", "call", "p"].json.startswith('{"arguments":null,')
    assert chat.formatted(spark.createDataFrame([], EVENTS), chat.RESPOND).count() == 0


def test_flac_uses_linear_predictors_for_tones():
    tone = bytes(int(127 + 120 * math.sin(k / 9)) for k in range(64 * 200))
    (data,) = flac.encode_many([tone])
    head = flac.metadata(data)
    frames = [flac._frame(data, at, head) for _, at, _ in flac.walk(data, head)]
    assert any(f.shift and len(f.coefficients) == 2 for f in frames) and len(data) < len(tone) * 0.6
    assert (flac.decode_many([data])[0] + 128).astype(np.uint8).tobytes() == tone


def plain_chat(rows, schemas):
    """{row number: (position, linked, repeated, valid, cyclic)} by plain loops over each conversation."""
    out = {}
    kinds = {"string": str, "integer": int}
    for conv in {r[0] for r in rows}:
        own = [(n, r) for n, r in enumerate(rows) if r[0] == conv]
        first = {}
        for n, r in sorted((x for x in own if x[1][2] != "message"), key=lambda x: (x[1][1], x[1][7] is None, x[1][7] or "", x[1][6] is None, x[1][6] or "")):
            first.setdefault((r[2], r[4]), n)
        repeated = {n: r[2] != "message" and first[r[2], r[4]] != n for n, r in own}
        live = {(r[2], r[4]): n for n, r in own if r[2] != "message" and r[4] is not None and not repeated[n]}
        calls = {r[4]: r for n, r in own if live.get(("call", r[4])) == n}
        linked = {n: r[2] != "message" and not repeated[n] and r[4] is not None and ("result" if r[2] == "call" else "call", r[4]) in live for n, r in own}
        needs = {i: {x for x in (r[8] or []) if x in calls} for i, r in calls.items()}
        hard = any(calls[x][1] >= calls[i][1] for i in needs for x in needs[i]) or any(r[2] == "result" and linked[n] and r[1] < calls[r[4]][1] for n, r in own)
        level, now = {}, 0
        while free := [i for i in needs if i not in level and all(level.get(x, now) < now for x in needs[i])]:
            level.update(dict.fromkeys(free, now))
            now += 1

        def depth(n, r):
            if not hard or r[2] == "message":
                return 0
            return 2 * level[r[4]] + (r[2] == "result") if r[4] in level else 2**31

        order = sorted(own, key=lambda x: (depth(*x), x[1][1], x[1][2] == "result", x[1][4] is not None, x[1][4] or "", x[1][7] is not None, x[1][7] or ""))
        for place, (n, r) in enumerate(order):
            valid = linked[n] if r[2] == "result" else r[7] is not None
            if r[2] == "call":
                try:
                    value = json.loads(r[6])
                    fields = schemas[r[5]]
                    valid = set(value) <= set(fields) and all(type(value[f]) is kinds[k] if f in value else not must for f, (k, must) in fields.items())
                except (KeyError, TypeError, ValueError):
                    valid = False
            cyclic = hard and (r[2] == "call" or linked[n]) and r[4] is not None and not repeated[n] and r[4] not in level
            out[n] = (place, linked[n], repeated[n], valid, cyclic)
    return out


@pytest.mark.parametrize("turns", [1024, 2])
def test_chat_against_plain_loops(spark, monkeypatch, turns):
    """Forward and backward needs, cycles, unknown tools, bad arguments, orphans and repeats, also in the null conversation."""
    monkeypatch.setattr(chat, "TURNS", turns)
    rng, rows = random.Random(4), []
    arguments = ['{"text":"x","turn":1}', '{"turn":2}', '{"text":5,"turn":1}', "{bad", None, '{"text":"y","turn":3,"more":1}']
    for conv in [None, *(f"c{k}" for k in range(12))]:
        ids = [f"i{k}" for k in range(6)]
        for k, i in enumerate(ids):
            pool = ids[:k] if conv in ("c1", "c2", "c3") else ids + ["lost"]
            needs = rng.sample(pool, min(len(pool), rng.randint(0, 2)))
            rows.append((conv, 2 * k, "call", "assistant", i, rng.choice(["respond", "respond", "other", None]), rng.choice(arguments), None, rng.choice([needs, needs, None])))
            if rng.random() < 0.8:
                rows.append((conv, rng.randint(0, 14), "result", "tool", i, None, None, f"said {len(rows)}", None))
        rows.append((conv, 20, "call", "assistant", "i0", "respond", arguments[0], None, None))
        rows += [(conv, 21 + k, "message", "user", None, None, None, rng.choice(["hi", None]), None) for k in range(3)]
    rows += [(None, 50, "call", "assistant", "a", "respond", arguments[0], None, ["b"]), (None, 51, "call", "assistant", "b", "respond", arguments[0], None, None)]
    marked = [(*r[:3], f"{r[3]}-{n}", *r[4:]) for n, r in enumerate(rows)]
    rng.shuffle(marked)
    got = chat.formatted(spark.createDataFrame(marked, EVENTS).withColumn("position", F.lit("x")).withColumn("linked", F.lit(1)), chat.RESPOND)
    found = {int(json.loads(r.json)["role"].split("-")[1]): (r.position, r.linked, r.repeated, r.valid, r.cyclic) for r in got.collect()}
    assert found == plain_chat(rows, chat.RESPOND)


def test_chat_long_chain_of_needs(spark):
    n = 30
    rows = [("c", n - k, "call", "assistant", f"i{k:03}", "respond", None, None, [f"i{k - 1:03}"] if k else None) for k in range(n)]
    got = chat.formatted(spark.createDataFrame(rows, EVENTS), chat.RESPOND).orderBy("position").collect()
    assert [r.call_id for r in got] == [f"i{k:03}" for k in range(n)]


def test_frames_of_many_streams_are_decoded_together(monkeypatch):
    payloads = [bytes([k % 251, 7]) * (1 << 16) for k in range(20)]  # 2.6 million samples
    calls, whole = [], flac._decode_some
    monkeypatch.setattr(flac, "_decode_some", lambda streams, some, check: calls.append(len(some)) or whole(streams, some, check))
    assert [flac.unsigned(x) for x in flac.decode_many(flac.encode_many(payloads))] == payloads
    assert [n for n in calls if n] == [20 * 32]
