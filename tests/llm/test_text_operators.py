"""BPE, secrets, media, substring and Jaccard against libraries and brute force, with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import assume, given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sunspan.llm import bpe, jaccard, media, secrets, substring

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "   \n\t ", "a", "İstanbul ΣΑΣ ς 'S it's ﬁ", "<|endoftext|>a<|startoftext|>  <|endoftext", "x" * 5000 + " b", "日本語 123 ½ ٣ \x1c a\x85b é",
    "👨‍👩‍👧 don't", "same text here for all of us now", "same text here for all of us now", "password = 'hunter2hunter2'", "A" * 3 + "KIA" + "B" * 30,
]
SCHEMA = "doc_id long, text string, ids string, score double, n_tokens long"


def frame(spark, texts, first=0):
    rows = [(first + i, t, "clash", 0.5, -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def shuffled_words(n, seed, vocabulary=60):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    rows = bpe.transcode(frame(spark, ODD), "text", TOKENIZER).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        ids = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == -1 and r.score == 0.5  # other columns pass through


def test_bpe_round_trip_and_empty(spark):
    coded = bpe.encode(frame(spark, ODD), "text", TOKENIZER)
    one = {r.doc_id: r.decoded for r in bpe.decode(coded, "ids", TOKENIZER).collect()}
    two = {r.doc_id: r.decoded for r in bpe.transcode(frame(spark, ODD), "text", TOKENIZER).collect()}
    assert one == two
    assert bpe.encode(frame(spark, ODD).limit(0), "text", TOKENIZER).collect() == []


def test_segment_tree_is_lowest_rank_leftmost_first():
    model = bpe.load(TOKENIZER)
    pairs = {int(k): int(r) for k, r in zip(model.keys, model.ranks, strict=True)}
    made = model.made
    for word in ["aaaaaaaaaaaaa", "thethethe", "zxqj", "internationalisation", "é" * 9]:
        raw = word.encode()
        ids = [int(model.inside[b]) for b in raw[:-1]] + [int(model.last[raw[-1]])]
        while True:
            ranks = [(pairs[a << 32 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if a << 32 | b in pairs]
            if not ranks:
                break
            rank, i = min(ranks)
            ids[i : i + 2] = [int(made[rank])]
        assert np.frombuffer(model.merge([raw])[0], dtype="<u4").tolist() == ids


def test_long_words_are_merged_alone_with_the_same_result(monkeypatch):
    model, r = bpe.load(TOKENIZER), random.Random(2)
    words = ["".join(r.choice(["the", "ing", "a", "x", "é", "zz", "tion"]) for _ in range(r.randrange(150, 900))).encode() for _ in range(6)] + [b"a" * 3000, b"ab" * 700, b"e" * 512]
    alone = [model.merge([w])[0] for w in words]
    monkeypatch.setattr(bpe, "LONG", 1 << 40)
    assert alone == model.merge(words) and min(map(len, words)) < 1024
    monkeypatch.undo()
    began = time.process_time()
    model.merge(["".join(r.choice("etaoinshr") for _ in range(100_000)).encode()])
    assert time.process_time() - began < 10


def test_decoding_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, bytearray(), "y"), (3, bytearray(b"\x05\0\0\0"), "z"), (3, bytearray(b"\x05\0\0\0"), "z")], "id long, ids binary, decoded string")
    rows = bpe.decode(df, "ids", TOKENIZER).collect()
    assert [r.decoded for r in sorted(rows, key=lambda r: r.id)][:2] == ["", ""] and rows[-1].decoded == rows[-2].decoded != ""
    assert bpe.decode(df.limit(0), "ids", TOKENIZER).collect() == []


@pytest.mark.parametrize(
    ("text", "literal"),
    [
        ('db_password = "s3cr3tV4lue!"', "s3cr3tV4lue!"),
        ("KEY_A = 'abC9dE2fGh'\nauth_token = KEY_A", "abC9dE2fGh"),
        ('{"api_key": "Zq81mmK2xx9"}', "Zq81mmK2xx9"),
        ("clientSecret := `Q9x!a8s7d6f5`", "Q9x!a8s7d6f5"),
        ('password = """hunter2Xy9secret"""', "hunter2Xy9secret"),
        ("secret = r'''a\n9fQ2xL7pTz'''".replace("\n", ""), "a9fQ2xL7pTz"),
        ("<password> 9fQ2xL7pTz4W </password>", "9fQ2xL7pTz4W"),
        ("<a:api_key id='x'>9fQ2xL7pTz4W</a:api_key>", "9fQ2xL7pTz4W"),
        ("db:\n  password:\n    9fQ2xL7pTz4W\n  user: x\n", "9fQ2xL7pTz4W"),
        ('"password":\n    "9fQ2xL7pTz4W",\n', "9fQ2xL7pTz4W"),
        ("- private_key: |\n    MIIBOgIBAAJB\n    AKj34Gkx9QwZ\n- next: 1\n", "AKj34Gkx9QwZ"),
    ],
)
def test_lexer_finds_literals_of_sensitive_names(text, literal):
    found = [text[s.start : s.end] for s in secrets.scan(text) if s.kind == "lexed"]
    assert literal in found


def test_constants_that_are_added_up_are_all_reported():
    text = "a = 'abC9dE2f'\nb = 'Zq81mmK2'\nauth_token = a + b\n"
    assert sorted(text[s.start : s.end] for s in secrets.lexed_spans(text)) == ["Zq81mmK2", "abC9dE2f"]
    text = "a = 'abC9dE2f'\nauth_token = unknown + a + \"Zq81mmK2\"\n"
    assert sorted(text[s.start : s.end] for s in secrets.lexed_spans(text)) == ["Zq81mmK2", "abC9dE2f"]


FORMS = ("{n} = '{v}'", '{n} := "{v}"', '"{n}": "{v}"', "{n} => '{v}'", "{n}: {v}", "<{n}>{v}</{n}>", "{n}:\n  {v}", "{n}: |\n  {v}", '{n} = """{v}"""', "k = '{v}'\n{n} = k")


@given(st.sampled_from(FORMS), st.sampled_from(["db_password", "authToken", "API_KEY", "client.secret"]), st.text("abcdefXYZ0123456789", min_size=16, max_size=40), st.text("xy\n", max_size=30))
def test_lexed_spans_are_the_literals(form, name, value, around):
    assume(len(set(value)) >= 10)
    text = f"{around}\n{form.format(n=name, v=value)}\n{around}"
    spans = secrets.lexed_spans(text)
    assert [text[s.start : s.end] for s in spans] == [value] and spans[0].score >= secrets.THRESHOLD


def test_lexing_takes_time_in_proportion():
    for unit in ("password: |\n", 'x = """ ', "<token>", "k: ", "a = a + b + ", "secret = '", "  key:\n"):
        began = time.process_time()
        secrets.lexed_spans(unit * (200_000 // len(unit)))
        assert time.process_time() - began < 8, unit


@pytest.mark.parametrize("head", ["<a>", "</b> <a>", "k:", "k =", 'k = """', "k: |\n a", "k: >\n", "- k:\n", "<a>x</a", "<a ", "password", "k = a +", "k = 'a\\"])
def test_runs_of_blanks_take_time_in_proportion(head):
    for fill in (" ", "\t", "\n", "\r\n", " \n", '"', "\\"):
        for tail in ("", "x", "</a>"):
            began = time.process_time()
            secrets.scan(head + fill * (200_000 // len(fill)) + tail)
            assert time.process_time() - began < 2, (head, fill, tail)


def test_lexed_lines_may_end_in_blanks_and_tags_may_stand_apart():
    for text in ("password: |  \r\n    9fQ2xL7pTz4W \t \r\n", "<token \n x='y'>\n\t9fQ2xL7pTz4W  \n</token  >", 'secret = """9fQ2x\\"""L7pTz4W"""'):
        found = [text[s.start : s.end] for s in secrets.lexed_spans(text)]
        assert found in (["9fQ2xL7pTz4W"], ['9fQ2x\\"""L7pTz4W']), text


@pytest.mark.parametrize("text", ["<p>the password</p>", "secret:\n  name: value", "note: |\n  some plain words here\n", "token = a + b", "the token: is good", "colour = 'blue sky'", "password = 'password'", "x == y; a != b", "url: http://host/path"])
def test_lexer_leaves_plain_text_alone(text):
    assert not [s for s in secrets.lexed_spans(text)]


def test_every_piece_of_a_long_constant_is_reported():
    r = random.Random(8)
    pieces = ["".join(r.choices("abcXYZ0189+", k=5)) for _ in range(300)]
    text = "k = " + " + ".join(f'"{p}"' for p in pieces[:150]) + "\n"
    text += "".join(f'k = k + "{p}"\n' for p in pieces[150:]) + "secret = k\n"
    found = sorted(secrets.lexed_spans(text), key=lambda s: s.start)
    assert [text[s.start : s.end] for s in found] == pieces
    assert {(s.name, s.score) for s in found} == {("secret", round(secrets.literal_weight("".join(pieces)), 4))}


def test_a_constant_that_doubles_is_followed():
    text = 'a0 = "9fQ2xL7p"\n' + "".join(f"a{i + 1} = a{i} + a{i}\n" for i in range(2000)) + "token = a2000 + 'tail'"
    assert {text[s.start : s.end] for s in secrets.lexed_spans(text)} == {"9fQ2xL7p", "tail"}


@pytest.mark.parametrize("name", [*secrets.SENSITIVE, "encryption_key", "SIGNING_KEY", "sshKey", "password-salt"])
def test_a_strong_literal_is_reported_for_every_listed_name(name):
    for value in ("9fQ2xL7pTz4W", "8f3a91bc02de77a5", "Zm9v+YmFy/cXV4"):
        text = f'a = 1\n{name} = "{value}"\n'
        assert [text[x.start : x.end] for x in secrets.lexed_spans(text)] == [value]


def test_base_spans_equal_the_patterns(spark):
    r = random.Random(3)
    pieces = ["password=", "Token: ", "api_key\"='", "AKIA", "deadbeef", "abcdef0123456789", " ", "\n", "é", "XYZ12", "secret", "apikey = ", "passwd:", "0" * 24, "aaaaaa"]
    cases = ODD + ["".join(r.choice(pieces) for _ in range(40)) for _ in range(200)]
    rows = secrets.find_secrets(frame(spark, cases), "text").collect()
    for row in rows:
        t = cases[row.doc_id] or ""
        want = []
        for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
            if len(m[2]) >= 6:
                want.append((m.start(), 0, m.end()))
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        got = [(s.start, secrets.ORDER[s.kind], s.end) for s in row.secret_spans if s.kind != "lexed"]
        assert got == sorted(want)


def test_redaction_removes_every_span(spark):
    found = secrets.find_secrets(frame(spark, ODD), "text")
    clean = {r.doc_id: r.text for r in secrets.redact(found, "text").collect()}
    assert clean[0] is None and clean[1] == "" and "hunter2" not in clean[11]
    assert not any(secrets.base_spans(t or "") for t in clean.values())


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 936, 937, 938, 937 * 64, 200_001])
def test_media_round_trip(size):
    data = os.urandom(size)
    stream = media.write(data)
    found = media.read(stream)
    assert found.payload == data.ljust(max(64, -(-size // 64) * 64), b"\0")
    assert (found.bad, found.skipped) == (0, 0) and found.checked == len(found.offsets) + 1
    assert found.table_frames == len(found.offsets) and found.table_bytes == len(stream) - found.tag_bytes
    assert found.samples == 1152 * len(found.offsets) and found.seconds == found.samples / 48000
    assert all(media.header(stream[o : o + 4]) for o in found.offsets)


def test_media_survives_damage():
    data = os.urandom(20_000)
    whole = media.write(data)
    offsets = media.read(whole).offsets
    hurt = bytearray(whole)
    hurt[offsets[3] + 8] ^= 0xFF  # side information: the checksum tells
    assert media.read(bytes(hurt)).bad == 1
    cut = whole[: offsets[2] + 100] + b"junk\xff\xfb" * 9 + whole[offsets[4] :]
    found = media.read(cut)
    assert found.skipped > 0 and len(found.offsets) >= len(offsets) - 4
    assert media.read(b"no audio at all").offsets == [] and media.read(b"").seconds == 0
    assert media.read(whole + b"TAG" + bytes(125)).skipped == 0


@pytest.mark.parametrize("size", [64, 128, 937, 1000, 937 * 3, 937 * 3 + 100, 937 * 5])
def test_media_payload_may_hold_the_letters_of_a_tag(size):
    hit = 0
    for at in range(max(0, size - 500), size - 3):
        data = b"a" * at + b"TAG" + b"b" * (size - at - 3)
        stream = media.write(data)
        hit += stream[-128:-125] == b"TAG"
        found = media.read(stream)
        assert found.payload[:size] == data and found.missing == found.skipped == 0
        tagged = media.read(stream + b"TAG" + bytes(125))
        assert tagged.payload == found.payload and tagged.skipped == 0 and tagged.tag_bytes == found.tag_bytes + 128
    assert hit or size == 64


def test_media_notices_a_short_payload(spark):
    df = media.store_text(frame(spark, ["x" * 3000]), "text")
    cut = df.withColumn("media", F.expr("substring(media, 1, 2000)"))
    assert [r.payload_missing > 0 for r in media.read_media(cut).collect()] == [True]
    assert len(media.read_media(df).select(media.whole_payload().alias("p")).first().p) == 3008
    with pytest.raises(Exception, match="shorter than its stored size"):
        media.read_media(cut).select(media.whole_payload()).collect()


def test_media_columns(spark):
    rows = media.read_media(media.store_text(frame(spark, ODD), "text")).collect()
    for r in rows:
        raw = (ODD[r.doc_id] or "").encode()
        assert r.n_bytes == len(raw) and r.payload[: len(raw)] == raw and len(r.payload) % 64 == 0 and r.payload
    assert rows[9].media == rows[10].media
    assert media.store_text(frame(spark, []), "text").collect() == []


def frames_by_hand(stream):
    """Payload and frame offsets of a written stream, walked without the reader: mono frames of 48 kHz with a checksum."""
    kbit = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
    at, payload, offsets = 10 + sum(b << s for b, s in zip(stream[6:10], (21, 14, 7, 0), strict=True)), b"", []
    while at < len(stream):
        size = 3 * kbit[stream[at + 2] >> 4]
        assert stream[at : at + 2] == b"\xff\xfa"
        if stream[at + 23 : at + 27] != b"Xing" or offsets:
            offsets.append(at)
            payload += stream[at + 23 : at + size]
        at += size
    return payload, offsets


def test_media_query_equals_brute_force(spark, tmp_path):
    from sunspan.llm.queries import QUERIES

    texts = [*ODD, "TAG " * 4000, "é" * 70_001]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in QUERIES["op5_media"](spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw, r = (t or "").encode(), rows[i]
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        stream = media.write(raw)
        payload, offsets = frames_by_hand(stream)
        assert payload[: len(padded)] == padded and not any(payload[len(padded) :])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
        seek = hashlib.sha256(",".join(map(str, offsets)).encode()).hexdigest()
        assert r.feature == f"frames={len(offsets)};samples={1152 * len(offsets)};rate=48000;crc_bad=0;seek={seek}"


def id3(frames, flags=0, version=4):
    body = b"".join(n + media._syncsafe(len(d)) + b"\0\0" + d for n, d in frames) + bytes(7)
    head = bytes([version, 0, flags]) + media._syncsafe(len(body))
    return b"ID3" + head + body + (b"3DI" + head if flags & 0x10 else b"")


def test_media_tags_at_both_ends():
    frames = [bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)] * 5
    front = id3([(b"TIT2", b"\3" + "Näme".encode()), (b"TPE1", b"\1" + "Wer".encode("utf-16")), (b"APIC", b"\xff\xfb" * 9)], flags=0x10)
    back = id3([(b"TALB", b"\0Album\0x")], flags=0x10)
    old = b"TAG" + b"Other".ljust(30, b"\0") + b"Me".ljust(30) + bytes(62) + b"\0\7\1"
    found = media.read(front + b"".join(frames) + back + old)
    assert found.skipped == 0 and len(found.offsets) == 5 and found.tag_bytes == len(front) + len(back) + len(old)
    assert found.tags == {"TIT2": "Näme", "TPE1": "Wer", "TALB": "Album", "TRCK": "7"}
    assert media.read(front[:30]).offsets == [] and media.read(b"ID3\4\0\0\x7f\x7f\x7f\x7f" + frames[0]).tags == {}


def test_media_tables_of_both_kinds():
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)
    vbri = struct.pack(">4sHHHIIHHHH", b"VBRI", 1, 0, 75, 4170, 9, 3, 10, 2, 3) + struct.pack(">HHH", 10, 20, 30)
    first = (frame[:36] + vbri).ljust(417, b"\0")
    found = media.read(first + frame * 9)
    assert (found.table, found.table_frames, found.table_bytes, found.seek, len(found.offsets)) == ("VBRI", 9, 4170, [100, 300, 600], 9)
    assert found.seconds == 9 * 1152 / 44100
    xing = (frame[:36] + b"Info" + struct.pack(">III", 7, 9, 4170) + bytes(range(100))).ljust(417, b"\0")
    found = media.read(xing + frame * 9)
    assert (found.table, found.table_frames, found.seek[:3]) == ("Info", 9, [0, 16, 32])


@pytest.mark.parametrize("size", [300, 417, 2000])
def test_media_of_free_format(size):
    frame = bytes([0xFF, 0xFB, 0x00, 0xC0]) + b"a" * (size - 4)
    found = media.read(b"junk" + frame * 6)
    assert len(found.offsets) == 6 and found.skipped == 4 and found.samples == 6 * 1152


def repeats_by_hand(docs, k=13):
    """The contract's words, computed one window at a time; docs: (id, text), ids ascending."""
    first, out = {}, {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        marks = [False] * len(w)
        for p in range(len(w) - k + 1):
            if first.setdefault(tuple(w[p : p + k]), i) < i:
                marks[p : p + k] = [True] * k
        out[i] = (len(w), sum(marks), " ".join(x for x, m in zip(w, marks, strict=True) if not m))
    return out


@pytest.fixture(scope="module")
def passages():
    r = random.Random(5)
    common = " ".join(shuffled_words(40, 99, 1000))
    docs = ODD + [common, common + " tail", "head " + common]
    for i in range(60):
        w = shuffled_words(r.randrange(5, 120), i, 1000)
        if i % 3 == 0:
            w[2:2] = common.split()
        docs.append("\n".join([" ".join(w), " ".join(w[:20])]) if i % 5 == 0 else "  ".join(w))
    docs += [docs[-1], docs[-2], " ".join(["again"] * 50), " ".join(["again"] * 30)]
    return docs


@pytest.mark.parametrize("hot", [False, True])
def test_substring_equals_brute_force(spark, passages, monkeypatch, hot):
    if hot:  # every minimiser hot: all windows travel alone
        every = np.unique(substring.Batch(list(range(len(passages))), [t or "" for t in passages], 13, 3).least)
        monkeypatch.setattr(substring, "hot_minimisers", lambda rows, k, m, n: (every, n))
    rows = substring.remove_repeats(frame(spark, passages).repartition(3), "doc_id", "text").collect()
    want = repeats_by_hand(list(enumerate(passages)))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows} == want
    assert sum(v[1] for v in want.values()) > 500


def test_substring_of_many_buckets_equals_brute_force(spark, passages, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET_WORDS", 3)
    rows = substring.remove_repeats(frame(spark, passages), "doc_id", "text").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows} == repeats_by_hand(list(enumerate(passages)))


def test_substring_finds_every_hot_minimiser(spark, passages, monkeypatch):
    texts = [t or "" for t in passages] * 7 + ["a b c d e f g h i j k l m n o p"] * 400
    batch = substring.Batch(list(range(len(texts))), texts, 13, 3)
    known, n = np.unique(batch.least[batch.runs()[0]], return_counts=True)
    hot, words = substring.hot_minimisers(substring._texts(frame(spark, texts).repartition(5), "doc_id", "text"), 13, 3, 1)
    least = max(substring.LEAST_HOT, substring.HOT_SHARE * n.sum())
    assert words == len(batch.words.hashes) and set(known[n >= least]) <= set(hot) and (n >= least).any() and len(hot) < len(known)


def test_substring_batches_do_not_depend_on_the_number_of_buckets(passages):
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(passages))), "text": [t or "" for t in passages]})
    seconds = []
    for buckets in (10, 10**6, 10**12):
        began = time.process_time()
        made = list(substring._split(b"", buckets, 13, 3)(iter([batch])))
        seconds.append(time.process_time() - began)
        assert sum(x.num_rows for x in made) <= 1 << 14
    assert max(seconds) < 5


def test_substring_of_very_long_and_repeated_rows(spark):
    long = shuffled_words(60_000, 3, 2000)
    texts = [" ".join(long), " ".join(long[20_000:]), "w " * 50_000, "w " * 30, None, ""] + ["one passage of " + " ".join(long[:20])] * 300
    rows = substring.remove_repeats(frame(spark, texts), "doc_id", "text").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows} == repeats_by_hand(list(enumerate(texts)))


def test_substring_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring, "sequence_hashes", lambda h, k: np.zeros(max(0, len(h) - k + 1), dtype=np.uint64))
    text = b"a b c\na b d\na b c"
    string, offset, least = substring.smallest_documents(text, np.array([7, 3, 9]), 3)
    assert sorted(zip(string.tolist(), least.tolist(), strict=True)) == [(0, 7), (1, 3), (2, 7)]


def test_substring_odd_ids(spark):
    long = " ".join(shuffled_words(30, 1, 1000))
    df = spark.createDataFrame([(None, long), (5, long), (5, long), (7, long)], "doc_id long, text string")
    rows = substring.remove_repeats(df).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows) == [(-1, 0), (5, 0), (5, 0), (7, 30)]
    assert substring.remove_repeats(df.limit(0)).collect() == []


def components_by_hand(texts, k=5):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def near_copies():
    r = random.Random(11)
    base = shuffled_words(100, 0, 5000)
    docs = list(ODD) + [" ".join(base), " ".join(base).upper()]
    for i in range(50):  # copies at all distances from the base, and chains of copies
        w = list(base if i % 2 else docs[-1].split())
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        docs.append(" ".join(w[: r.randrange(85, 101)]))
    docs += [" ".join(shuffled_words(r.randrange(1, 40), 500 + i, 5000)) for i in range(30)]
    docs += ["one two", "one  TWO", "one two three", "b", "B"]
    return docs


def test_jaccard_equals_brute_force(spark, near_copies):
    rows = jaccard.similar_documents(frame(spark, near_copies).repartition(3)).collect()
    want = components_by_hand(near_copies)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_jaccard_blocks_and_trees(spark, near_copies, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rows = jaccard.similar_documents(frame(spark, near_copies)).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: c for i, (_, c) in components_by_hand(near_copies).items()}


def test_signature_tree_loses_no_link(near_copies):
    sets = [s for s in jaccard.shingle_sets([t or "" for t in near_copies], 5) if len(s)]
    n, ids = len(sets), np.arange(len(sets))
    sizes, bits = np.array([len(s) for s in sets]), [jaccard.bitmap(s) for s in sets]
    pairs = lambda tree, block: {tuple(p) for p in jaccard.tree_pairs(tree, ids, sizes, bits, ids, block, 75).tolist()}
    found = pairs(np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64))
    links, possible = set(), 0
    for i, s in enumerate(sets):
        for j in range(i):
            possible += 1
            both = len(np.intersect1d(s, sets[j]))
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both) > 0:
                links.add((j, i))
    assert links <= found and len(found) < possible / 2
    across = {(a, b) for a, b in links if a % 2 != b % 2}
    split = pairs(np.zeros(n, dtype=np.int64), ids % 2)
    assert across <= split and all(a % 2 != b % 2 for a, b in split)
    inside = {(a, b) for a, b in links if a % 3 == b % 3}
    forest = pairs(ids % 3, np.zeros(n, dtype=np.int64))
    assert inside <= forest and all(a % 3 == b % 3 for a, b in forest)


def test_rows_of_shared_keys_stay_across_batches():
    rows = [(1, 0, 5), (1, 0, 6), (2, 0, 7), (3, 0, 8), (3, 0, 9), (3, 0, 10), (4, 1, 11), (5, 0, 12), (6, 0, 13), (6, 0, 14)]
    for step in range(1, 11):
        batches = [pa.RecordBatch.from_pydict(dict(zip(("key", "deal", "id"), map(list, zip(*rows[i : i + step], strict=True)), strict=True))) for i in range(0, len(rows), step)]
        got = sorted(x for b in jaccard._shared(iter(batches)) for x in b.column("id").to_pylist())
        assert got == [5, 6, 8, 9, 10, 11, 13, 14], step


def test_jaccard_odd_rows(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (1, None), (2, "")], "doc_id long, text string")
    rows = jaccard.similar_documents(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(1, 0, 1), (2, 0, 2), (3, 2, 3)]
    assert jaccard.similar_documents(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        jaccard.similar_documents(df, percent=40)


def test_jaccard_prefixes_of_linked_sets_meet():
    r = random.Random(3)
    ranks = np.zeros(1 << jaccard.SLOT_BITS, dtype=np.uint8)
    ranks[:: 3] = 1
    ranks[:: 7] = 2
    for n in [*range(1, 40), 200, 1000]:
        for _ in range(20):
            s = np.unique(np.array([r.getrandbits(64) for _ in range(n)], dtype=np.uint64))
            gone = r.randrange(n // 4 + 1)
            t = np.delete(s, r.sample(range(len(s)), gone))
            more = np.array([r.getrandbits(64) for _ in range(r.randrange(n // 3 + 2))], dtype=np.uint64)
            t = np.unique(np.concatenate([t, more]))
            both = len(np.intersect1d(s, t))
            if 100 * both >= 75 * (len(s) + len(t) - both):
                assert set(jaccard.prefix_keys(s, ranks, 75)) & set(jaccard.prefix_keys(t, ranks, 75))


def test_jaccard_of_all_short_texts_equals_brute_force(spark):
    texts = [" ".join(w) for n in range(1, 9) for w in itertools.islice(itertools.product("abc", repeat=n), 0, 200)]
    texts += [" ".join(f"w{j}" for j in range(i, i + 7 + i % 3)) for i in range(0, 60, 1)]  # three of four shingles in common
    rows = jaccard.similar_documents(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components_by_hand(texts)


def test_jaccard_of_very_long_and_repeated_texts(spark, monkeypatch):
    long = shuffled_words(20_000, 1, 50_000)
    near = list(long)
    near[::40] = [f"other{i}" for i in range(500)]
    texts = [" ".join(long), " ".join(near), " ".join(long[:14_000]), "same " * 30_000, "same " * 40, None] + ["copy of one text with a few words"] * 30
    rows = jaccard.similar_documents(frame(spark, texts)).collect()
    want = components_by_hand(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and want[1][1] == 0 and want[2][1] == 2
    for name in ("LEAST_IN_TASK", "LEAST_IN_ALL"):  # the order of shingles decides no link
        monkeypatch.setattr(jaccard, name, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(frame(spark, texts)).collect()} == want


def test_digests_are_of_the_whole_text(spark):
    rows = substring.remove_repeats(frame(spark, ["a  b\tc"])).collect()
    assert hashlib.sha256(rows[0].kept_text.encode()).hexdigest() == hashlib.sha256(b"a b c").hexdigest()
