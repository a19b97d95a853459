"""Source divergence, license scans and importance resampling against loops over words, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sunspan.llm import divergence, importance, licenses
from sunspan.llm._words import PUNCTUATION, Words

SCHEMA = "doc_id long, text string, lang string, source string, rank long, n_words string, term string, part int"
UPPER = {i: i + 32 for i in range(65, 91)}
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, -1, "clash", "clash", 7) for i, t, lang, source in rows], SCHEMA)


def words(text):
    return ALNUM.findall((text or "").translate(UPPER))


def corpus(n, seed, sources=6):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(["en", "de", None])
        source = r.choice(["s0"] * 5 + [f"s{k}" for k in range(sources)] + [None])
        text = r.choice([" ", ", ", "-9_"]).join(r.choice(["Über", "ßA", "日本", "x"]) + "abcdefgh"[: r.randrange(0, 7)] for _ in range(r.randrange(0, 60)))
        out.append((i, text if r.random() > 0.05 else r.choice([None, "", "  12 .. "]), lang, source))
    return out


# --- divergence


def looped_divergence(rows, least, top):
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = terms.findall((text or "").translate(UPPER))
        count[(lang or "", source or "")].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang, seen in docs.items():
        kept = [t for t, n in seen.items() if n >= least]
        groups = [g for g in count if g[0] == lang]
        whole = Counter()
        for g in groups:
            whole.update(count[g])

        def share(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept))

        p = {g: {t: share(count[g], t) for t in kept} for g in groups}
        q = {t: share(whole, t) for t in kept}
        for g in groups:
            pairs = [(o[1], sum(abs(p[g][t] - p[o][t]) for t in kept)) for o in groups if o != g]
            best = [(t, p[g][t] - q[t]) for t in kept if count[g][t] and p[g][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", best, top)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(*g, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)}
    return out


@pytest.mark.parametrize(("least", "top"), [(8, 50), (3, 2), (500, 50)])
def test_divergence_equals_a_loop(spark, least, top):
    rows = corpus(300, least) + [(1000, "lonely", "fr", "only"), (1001, None, "xx", "a"), (1002, None, "xx", "b"), (0, "Über Über", "en", "s0"), (0, "Über Über", "en", "s0")]
    found = [tuple(r) for r in divergence.divergence(frame(spark, rows), least_docs=least, top=top).collect()]
    assert len(found) == len(set(found))
    assert set(found) == looped_divergence(rows, least, top)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(frame(spark, [])).collect() == []


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 50)
    monkeypatch.setattr(divergence, "SHARD_ROWS", 3)
    texts = ["Ab cd " * 200 + "x" * 300 + " ab", "ab", ""]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "source": ["s", "s", "t"], "text": texts})
    total, docs = Counter(), Counter()
    for part in divergence._counted(iter([batch, batch])):
        for r in part.to_pylist():
            total[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert total == {("s", "ab"): 404, ("s", "cd"): 400, ("s", "x" * 300): 2}
    assert docs == {("s", "ab"): 4, ("s", "cd"): 2, ("s", "x" * 300): 2}


@pytest.mark.parametrize("merge", [True, False])
def test_shards_are_cut_at_whole_terms(monkeypatch, merge):
    monkeypatch.setattr(divergence, "SHARD_ROWS", 4)
    rows = [{"lang": "en", "source": f"s{k % 3}", "term": t, "n": 1, "docs": 1} for t, n in (("a", 2), ("b", 40), ("c", 1), ("d", 9)) for k in range(n)]
    batches = [pa.RecordBatch.from_pylist(rows[a : a + 3], divergence.COUNTS) for a in range(0, len(rows), 3)]
    tables = list(divergence._whole_terms(divergence._database(), iter([*batches, batches[0].slice(0, 0)]), merge))
    seen = [set(t["term"].to_pylist()) for t in tables]
    assert len(tables) > 1 and sum(map(len, seen)) == 4  # no term is in two tables
    assert sum(sum(t["n"].to_pylist()) for t in tables) == len(rows)
    assert list(divergence._whole_terms(divergence._database(), iter([batches[0].slice(0, 0)]), merge)) == []


def test_pairs_of_source_blocks(monkeypatch, spark):
    """Blocks of sources give the same pairs, whatever their size."""
    rows = [{"lang": "en", "term": t, "source": f"s{k}", "n": (k * 7 + j) % 5 + 1, "total": 30, "lang_total": 90, "vocabulary": 3} for j, t in enumerate("abc") for k in range(5)]
    found = []
    for size in (1024, 2):
        db = divergence._database()
        db.register("counts", pa.Table.from_pylist(rows))
        db.execute(divergence.SHARES.replace("// 1024", f"// {size}")).fetchall()
        [(blocks,)] = db.execute("SELECT max(block) FROM shares").fetchall()
        found.append({tuple(r) for one in range(blocks + 1) for two in range(one, blocks + 1) for r in db.sql(divergence.MEET, params={"one": one, "two": two}).fetchall()})
    assert blocks > 1 and len(found[0]) == 10 and found[0] == found[1]


# --- licenses


def looped_places(text, templates):
    """Every offset of every template, compared word by word."""
    ws, out = words(text), []

    def shares(want, slack):
        for o in range(-len(want), len(ws) + 1):
            yield o, sum(any(0 <= o + j + d < len(ws) and ws[o + j + d] == w for d in range(-slack, slack + 1)) for j, w in enumerate(want))

    for t in templates:
        want = t.text.split()
        need = max(1, math.ceil(t.least * len(want) - 1e-9))
        good = []
        for o, hits in shares(want, t.slack):
            inside = all(any(ws[i : i + len(k.split())] == k.split() for i in range(max(0, o - t.slack), o + len(want) + t.slack - len(k.split()) + 1)) for k in t.keys)
            if hits >= need and inside:
                good.append((o, hits))
        for i, (o, hits) in enumerate(good):
            if i and t.slack and o == good[i - 1][0] + 1:
                run.append((o, hits))
            else:
                run = [(o, hits)]
            if i + 1 == len(good) or not t.slack or good[i + 1][0] != o + 1:
                o_best, h = max(run, key=lambda x: (x[1], -x[0]))
                out.append((t.label, max(0, o_best), min(o_best + len(want), len(ws)), h / len(want), t.phrase))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def spoiled(text, seed):
    r = random.Random(seed)
    out = []
    for w in text.split():
        x = r.random()
        out += [] if x < 0.04 else [w, "by", "someone"] if x < 0.06 else ["other"] if x < 0.09 else [w.upper() + "."]
    return " ".join(out)


SMALL = licenses.PHRASES + licenses.TEMPLATES


def licensed_texts():
    texts = [None, "", " .. ", "MIT", "cc by nc cc-by-nc CC BY\nNC", "under the MIT license, under the MIT-License!", "Licensed under the Apache License, Version 2.0.", "by by by by nc nc under the mit", "日本 under the mit license é"]
    texts += ["This work is licensed under the GNU General Public License, version 3.", "software " * 300, "the license of this software is free"]
    for k, t in enumerate(licenses.TEMPLATES):
        texts += [t.text, "before it " * 5 + spoiled(t.text, k) + " after it", " ".join(t.text.split()[len(t.text.split()) // 3 :])]
    return texts


def test_license_places_equal_a_loop(spark):
    texts = licensed_texts()
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(500, texts[-2], "en", "s")] * 2
    found = licenses.find_licenses(frame(spark, rows), words_col="n").collect()
    assert len(found) == len(rows)
    for r in found:
        assert [tuple(p) for p in r.license_places] == looped_places(r.text, SMALL), r.text
        assert r.n == len(words(r.text)) and r.n_words == "clash"
    full = {r.doc_id: {p.label for p in r.license_places} for r in found}
    for k, t in enumerate(licenses.TEMPLATES):
        assert t.label in full[12 + 3 * k]
    assert licenses.find_licenses(frame(spark, [])).collect() == []


def test_rarity_changes_postings_but_no_place():
    texts = [t or "" for t in licensed_texts()]
    ws = Words([t.encode() for t in texts], lower=True, gaps=PUNCTUATION)
    plain = licenses.Index(SMALL, {})
    r = random.Random(3)
    other = licenses.Index(SMALL, {w: r.randrange(1000) for w in plain.vocabulary})
    assert plain.place.tolist() != other.place.tolist()
    assert plain.scan(ws) == other.scan(ws)


def test_keys_are_mandatory():
    t = licenses.Template("x", "one two three four five six seven eight nine ten", 0.8, 2, ("four five",))
    index = licenses.Index((t,), {})
    scan = lambda text: index.scan(Words([text.encode()], lower=True, gaps=PUNCTUATION))[0]
    assert [p["label"] for p in scan("zero " + t.text)] == ["x"]
    assert scan(t.text.replace("four five", "five four")) == []
    assert scan(t.text.replace("four", "4")) == []


def test_license_query_equals_a_loop(spark, tmp_path):
    from sunspan.llm.queries import op12_licenses

    texts = licensed_texts()
    frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op12_licenses(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ws = words(text)
        base = [(k, t.label) for t in licenses.PHRASES for k in range(len(ws)) if ws[k : k + len(t.text.split())] == t.text.split()]
        places = looped_places(text, SMALL)
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(ws), len(base))
        assert (r.first_word, r.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in base}))
        assert r.labels == ",".join(sorted({p[0] for p in places})) and r.score == max((p[3] for p in places), default=0.0)


# --- importance


def looped_buckets(text, n, buckets):
    ws = words(text)
    return [zlib.crc32(" ".join(ws[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(ws) - k + 1)]


def looped_scores(docs, target, n, buckets, least, percent, seed):
    s, t = Counter(), Counter()
    for text in docs.values():
        s.update(looped_buckets(text, n, buckets))
    for text in target:
        t.update(looped_buckets(text, n, buckets))
    s_all, t_all = sum(s.values()), sum(t.values())
    out, able = {}, []
    for i, text in docs.items():
        found = looped_buckets(text, n, buckets)
        gain = sum(math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets)))) for b in found)
        weight = gain // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if len(words(text)) >= least:
            able.append(i)
    for k, i in enumerate(sorted(able, key=lambda i: (-out[i][2], i))[: percent * len(able) // 100]):
        out[i][3] = k + 1
    return {i: tuple(v) for i, v in out.items()}


@pytest.mark.parametrize(("n", "buckets", "least", "percent"), [(2, 10_000, 20, 25), (3, 7, 1, 100), (1, 50, 5, 0)])
def test_scores_equal_a_loop(spark, n, buckets, least, percent):
    rows = [*corpus(150, n), (900, "Same Words " * 3000, "en", "s"), (901, "x" * 50_000 + " y", "en", "s")]
    docs, target = {r[0]: r[1] for r in rows}, ["abc xabc Über", None, "", "xabcd xabcd 12"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.scores(frame(spark, rows), goal, n=n, buckets=buckets, least_words=least, percent=percent)
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()} == looped_scores(docs, target, n, buckets, least, percent, 7)


def test_drawn_rows_have_their_texts_and_repeated_ones_stay(spark):
    rows = [(i, f"word{i} " * 30, "en", "s") for i in range(8)] + [(3, "word3 " * 30, "de", "t"), (None, "no id " * 30, "en", "s")]
    goal = spark.createDataFrame([("word3 word3",)], "text string")
    everything = importance.resample(frame(spark, rows), goal, percent=100)
    assert everything.columns == ["doc_id", "text", "lang", "source", "n_words", "term", "part", "rank"]
    found = everything.collect()
    assert len(found) == 9 and {r["rank"] for r in found if r.doc_id == 3} == {min(r["rank"] for r in found if r.doc_id == 3)}
    empty = importance.scores(frame(spark, []), goal.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_suffix_array_and_its_common_prefixes(depth):
    r = np.random.default_rng(depth)
    ids = r.integers(0, 4, 200)
    order = importance.suffix_order(ids, depth)
    suffix = [ids[i : i + depth].tolist() for i in range(len(ids))]
    assert sorted(order.tolist()) == list(range(200))
    assert all(suffix[a] <= suffix[b] for a, b in zip(order, order[1:], strict=False))
    for k, n in enumerate(importance.common_prefixes(ids, order, depth)):
        same = 0
        if k:
            a, b = (list(suffix[order[x]]) + [0] * depth for x in (k - 1, k))
            while same < depth and a[same] == b[same] != 0:
                same += 1
        assert n == same


def test_equal_grams_are_hashed_once(monkeypatch):
    calls = []
    monkeypatch.setattr(importance, "crc32", lambda b: calls.append(b) or zlib.crc32(b))
    ws = Words([b"a b a b a b", b"", b"b a b"], lower=True, gaps=PUNCTUATION)
    importance.feature_buckets(ws, 2)
    assert sorted(calls) == [b"a", b"a b", b"b", b"b a"]
