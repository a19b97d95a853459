"""Mixing, WARC, embeddings and the two classifiers, and the pipeline's stages."""

from __future__ import annotations

import base64
import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunspan.llm import embeddings, mixing, quality, toxicity, warc
from sunspan.llm._arrow import shared_dir
from sunspan.llm._graph import components
from sunspan.llm._labels import training_rows


def sources(spark, counts):
    rows = [(i, s, -1) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, source string, mix_slot long")


def edf(weights, length):
    """Keys of the slots by hand: exact fractions, earliest deadline first."""
    total, done, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(length):
        free = [k for k in weights if Fraction(done[k] * total, weights[k]) < t + 1]
        key = min(free, key=lambda k: (math.ceil(Fraction((done[k] + 1) * total, weights[k])), k))
        out.append((key, done[key]))
        done[key] += 1
    return out


@pytest.mark.parametrize("weights", [{"=a": 900_000, **{f"=s{i:02}": 5_263 for i in range(19)}}, {"=a": 500, "=b": 333, "=c": 120, "=d": 46, "=e": 1}, {"=a": 7}])
def test_every_slot_deviates_by_less_than_a_block_from_the_targets(spark, weights):
    rows = [(k, 16 * (9000 * w // sum(weights.values())), w) for k, w in weights.items()]
    got = mixing.schedule(spark.createDataFrame(rows, "key string, n_rows long, part long")).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(got[0].length)) and len(got) >= 8990
    assert [(r.key, r.k) for r in got] == edf(weights, len(got))
    done, total = dict.fromkeys(weights, 0), sum(weights.values())
    for t, r in enumerate(got, 1):
        done[r.key] += 1
        assert all(abs(done[k] - Fraction(t * w, total)) < 1 for k, w in weights.items())
    assert {r.key: r.quota for r in got} == done


def test_parts_follow_the_targets(spark):
    counts = spark.createDataFrame([("=a", 100), *((f"=s{i}", 50) for i in range(19)), ("", 3)], "key string, n long")
    got = {r.key: r.part for r in mixing.parts(counts, targets={"a": 0.9, **{f"s{i}": 0.1 / 19 for i in range(19)}}).collect()}
    assert got["=a"] == 89_999 and got["=s3"] in (526, 527) and got[""] == 1 and sum(got.values()) == mixing.SLOTS
    equal = [r.part for r in mixing.parts(counts, targets={}).collect()]
    assert set(equal) == {4761, 4762} and sum(equal) == mixing.SLOTS
    tiny = spark.createDataFrame([("=a", 10), *((f"=t{i:04}", 1) for i in range(2000))], "key string, n long")
    got = {r.key: r.part for r in mixing.parts(tiny, targets={"a": 0.9998}).collect()}
    assert got["=a"] == 98_000 and set(got.values()) == {1, 98_000}
    many = spark.range(mixing.MOST_SOURCES + 1).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("n"))
    with pytest.raises(Exception, match="more than 4096 sources"):
        mixing.parts(many).collect()


def test_a_longer_stream_repeats_the_schedule_without_drift(spark):
    df = sources(spark, {"a": 900, "b": 420, "c": 77})
    targets = {"a": 0.637, "b": 0.313, "c": 0.05}
    rows = mixing.mix(df, block_rows=2, targets=targets, slots=50).collect()
    assert len({(r.mix_slot, r.mix_pos) for r in rows}) == 1397
    parts = {r.key: r.part for r in mixing.parts(spark.createDataFrame([("=a", 9), ("=b", 9), ("=c", 9)], "key string, n long"), targets=targets, parts_of=50).collect()}
    placed = dict(sorted({r.mix_slot: r.source for r in rows if r.mix_exact}.items()))
    assert list(placed) == list(range(len(placed))) and len(placed) > 600  # many repetitions
    done = dict.fromkeys("abc", 0)
    for t, source in enumerate(placed.values(), 1):
        done[source] += 1
        assert all(abs(done[k] - Fraction(t * parts["=" + k], 50)) < 1 for k in done)


def test_mix_keeps_every_row_and_follows_the_weights(spark):
    df = sources(spark, {"big": 3000, "mid": 700, "small": 40, None: 5})
    rows = mixing.mix(df, block_rows=4, targets={"big": 2.0, "mid": 1.0, "small": 1.0}).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3745))
    assert len({(r.mix_slot, r.mix_pos) for r in rows}) == len(rows)
    exact = [r for r in rows if r.mix_exact]
    slots = {r.mix_slot: r.source for r in exact}
    assert sorted(slots) == list(range(len(slots))) and len(slots) > 10
    assert abs(sum(s == "big" for s in slots.values()) - len(slots) / 2) < 2
    ordered = mixing.in_mix_order(mixing.mix(df, block_rows=4), 3).select("mix_slot", "mix_pos").collect()
    assert ordered == sorted(ordered)


def test_mix_is_native_and_takes_odd_tables(spark):
    df = sources(spark, {"a": 10, "b": 3})
    plan = mixing.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
    assert mixing.mix(df.limit(0)).collect() == []
    twice = df.unionByName(df).withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))
    assert mixing.mix(twice).count() == 26


def test_warc_round_trip(spark):
    pages = [(4, "http://a", "<p>x</p>"), (2, "http://b\r\nX", "<p>x</p>"), (9, None, None), (8, "http://c", ""), (7, "http://d", "é" * 10), (2, "http://b", "<p>x</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha256", F.lit("clash"))
    path = shared_dir(spark, "test-warc")
    warc.write_archive(df, path)
    rows = warc.read_records(spark, path).collect()
    assert sorted((r.id, r.record_type, r.refers_to or 0) for r in rows) == [(2, "response", 0), (2, "response", 0), (4, "revisit", 2), (7, "response", 0), (8, "response", 0), (9, "revisit", 8)]
    by = {i: (h or "").encode() for i, _, h in pages}
    for r in rows:
        assert r.payload_digest == base64.b32encode(hashlib.sha1(by[r.id]).digest()).decode() and r.payload_bytes == len(by[r.id])
    for r in warc.read_records(spark, path, full_revisits=True).collect():
        assert r.payload == by[r.id]
        head, _, _ = r.record.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and head.count(b"\r\nWARC-Target-URI:") == 1
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        block = by[r.id] if r.record_type == "response" else b""
        assert r.record == head + b"\r\n\r\n" + block + b"\r\n\r\n" and int(fields[b"Content-Length"]) == len(block)
        assert fields[b"WARC-Record-ID"] == f"<{r.record_id}>".encode() and (b"WARC-Refers-To" in fields) == (r.record_type == "revisit")
    own = {r.record_id: r.id for r in rows if r.record_type == "response"}
    assert all(own[r.refers_id] == r.refers_to for r in rows if r.record_type == "revisit")
    assert spark.read.parquet(f"{path}/payloads").count() == 3


def test_warc_least_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "b" * 50), (4, "u", "b" * 50)], "page_id long, url string, html string")
    path = shared_dir(spark, "test-warc")
    warc.write_archive(df, path, least_bytes=10)
    assert sorted((r.id, r.record_type) for r in warc.read_headers(spark, path).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    path = shared_dir(spark, "test-warc")
    warc.write_archive(df.limit(0), path)
    assert warc.read_records(spark, path).collect() == []


def test_warc_notices_damage(spark):
    path = shared_dir(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([(1, "u", "aa")], "page_id long, url string, html string"), path)
    hurt = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"ab"))
    hurt.write.parquet(f"{path}-hurt/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_payloads(spark, f"{path}-hurt").collect()
    spark.read.parquet(f"{path}/payloads").limit(0).write.parquet(f"{path}-lost/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-lost/headers")
    with pytest.raises(Exception, match="damaged record"):
        warc.read_records(spark, f"{path}-lost").collect()


def clusters(n, size, seed=1, dim=16):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        centre = r.normal(size=dim)
        out += [(centre + r.normal(size=dim) * 0.12).tolist() for _ in range(size)]
    return out


def test_embedding_links_equal_brute_force(spark):
    vectors = clusters(12, 25) + clusters(150, 1, 2)
    vectors += [vectors[0]] * 40 + [None, [0.0] * 16, [math.nan] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, component_id string")
    rows = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    good = [i for i, v in enumerate(vectors) if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([vectors[i] for i in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.95).sum(1) - 1
    got = np.array([rows[i].n_links for i in good])
    assert (got == want).all() and want.sum() > 1000
    assert rows[len(vectors) - 2].n_links == 1 and rows[len(vectors) - 1].component_id == len(vectors) - 2
    for i in set(range(len(vectors) - 2)) - set(good):
        assert rows[i].n_links == 0 and rows[i].component_id == i and rows[i].kept
    assert all(r.kept == (r.component_id == r.vec_id) for r in rows.values())
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def test_embedding_links_in_a_dense_group_equal_brute_force(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=24) + r.normal(size=(4500, 24)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() > 100_000
    rows = embeddings.near_duplicates(df).collect()
    found, wanted = {r.vec_id: r.n_links for r in rows}, near.sum(axis=1).tolist()
    assert all(found[i] <= n for i, n in enumerate(wanted)) and sum(found.values()) > 0.9999 * sum(wanted)


def vector_classes(spark, vectors):
    rows = [(i, 1, np.asarray(v, dtype=np.float64).tobytes()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, copies long, vec binary")


def test_embedding_trees_follow_the_depth_of_leaves():
    side = 1 - math.acos(0.95) / math.pi
    for n in (10, 5_000, 25_000, 1_000_000, 30_000_000):
        bits, trees = embeddings.shape(n, 0.95)
        assert (n <= embeddings.CHUNK and bits == 0) or n / 2**bits <= embeddings.LEAF
        assert (1 - side**bits) ** trees <= embeddings.MISS


def linked(unit):
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    return near


def test_embedding_audit_looks_for_links_and_fails_on_low_recall(spark, monkeypatch):
    r = np.random.default_rng(6)
    alone = r.normal(size=(2900, 24))
    few = np.concatenate([alone, alone[:60] + r.normal(size=(60, 24)) * 0.2])
    links = int(linked(few / np.linalg.norm(few, axis=1, keepdims=True)).sum()) // 2
    assert 50 <= links <= 60
    found, recall = embeddings.neighbours(vector_classes(spark, few), 0.95)
    assert recall == 1.0 and found.agg(F.sum("near")).first()[0] == 2 * links
    assert embeddings.neighbours(vector_classes(spark, alone), 0.95)[1] is None
    with monkeypatch.context() as rare:  # no vector drawn has a link: the linked ones are asked
        rare.setattr(embeddings, "AUDIT", 1)
        rare.setattr(embeddings, "MOST_ASKED", 1)
        assert embeddings._truth(vector_classes(spark, few), 0.95)[1] == 0
        assert embeddings.neighbours(vector_classes(spark, few), 0.95)[1] == 1.0
    monkeypatch.setattr(embeddings, "shape", lambda n, threshold: (14, 1))
    monkeypatch.setattr(embeddings, "ROUNDS", 0)
    monkeypatch.setattr(embeddings, "TRIES", 0)
    with pytest.raises(RuntimeError, match="recall of links"):
        embeddings.neighbours(vector_classes(spark, few), 0.95)


def test_embedding_groups_that_only_few_links_join(spark):
    """Two dense groups that few links join: all lists are full of links of the own group."""
    r = np.random.default_rng(9)
    a = np.eye(24)[0] + r.normal(size=(1500, 24)) * 0.01
    turn = math.acos(0.95)
    b = math.cos(turn) * np.eye(24)[0] + math.sin(turn) * np.eye(24)[1] + r.normal(size=(1500, 24)) * 0.01
    x = np.concatenate([a, b, r.normal(size=(500, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = linked(x)
    assert 0 < near[:1500, 1500:3000].sum() < near[:1500, 1500:3000].size * 0.9 and near[:1500, :1500].all(where=~np.eye(1500, dtype=bool))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = {q.vec_id: q for q in embeddings.near_duplicates(df).collect()}
    assert [rows[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    assert {rows[i].component_id for i in range(3000)} == {0}


def test_embedding_clusters_of_any_size_are_counted_exactly(spark):
    r = np.random.default_rng(3)
    sizes = (25, 1500, 6000)
    x = np.concatenate([*(r.normal(size=32) + r.normal(size=(n, 32)) * 0.02 for n in sizes), r.normal(size=(700, 32))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = linked(x / np.linalg.norm(x, axis=1, keepdims=True)).sum(axis=1)
    assert set(want[: sum(sizes)]) == {n - 1 for n in sizes}
    assert {q.vec_id: q.n_links for q in embeddings.near_duplicates(df).collect()} == dict(enumerate(want.tolist()))


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7)]
    r.shuffle(edges)
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[500 + i] == 500 for i in range(40)) and got[7] == 7


def labelled(spark, n=240):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        w = [f"word{r.randrange(400)}" for _ in range(40)]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            w[5:5] = ["vile", "wretch"]
        if not good:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_learn_and_score_odd_texts(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "é " * 50_000)], "doc_id long, text string")
    for module, label, rest in ((toxicity, "toxic", (3, 1)), (quality, "quality", (5, 0))):
        model = module.train(docs, labels, label, rest)
        rows = module.score(docs, model).collect()
        cut = 0.7 if label == "toxic" else 0.3
        assert sum((r.score >= cut) == (truth[r.doc_id][label] == 1) for r in rows) >= 0.97 * len(rows)
        assert all(0 <= r.score <= 1 for r in module.score(odd, model).collect())
        assert module.score(docs.limit(0), model).collect() == []
        constant = module.train(docs, labels.limit(0), label, rest)
        assert len({r.score for r in module.score(docs.limit(5), constant).collect()}) == 1


def test_training_leaves_the_held_out_part_alone(spark):
    import zlib

    docs, labels = labelled(spark)
    ids = [r.id for r in training_rows(docs, labels, "toxic", (3, 1), 100).collect()]
    assert 0 < len(ids) <= 100 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)


def test_counterfactual_penalty_lowers_identity_weights():
    r = random.Random(2)
    texts, y = [], []
    for i in range(400):
        w = {f"word{r.randrange(300)}" for _ in range(20)}
        toxic = i % 2 == 0
        if toxic:
            w.add("vile")
        if r.random() < (0.9 if toxic else 0.1):
            w.add("muslims")  # goes with the label in this sample, though it is neutral
        texts.append(w)
        y.append(float(toxic))
    rows, swaps, y = [toxicity.text_features(t) for t in texts], [toxicity.changes(t) for t in texts], np.array(y, dtype=np.float32)
    plain = toxicity.fit(rows, [[] for _ in rows], y)
    fair = toxicity.fit(rows, swaps, y, strength=20.0)
    assert len({len(s) for s in swaps}) == 2 and max(map(len, swaps)) == 5
    others = ("christians", "jews", "hindus", "atheists")
    change = lambda m: max(abs(m.score("muslims met today") - m.score(f"{o} met today")) for o in others)
    assert change(fair) < 0.3 * change(plain)
    assert fair.score("vile") > 0.7


def test_swaps_change_one_term_at_a_time():
    for found in ({"women", "men", "met"}, {"muslims", "met"}, {"woman", "women"}, {"met"}, {"black", "blackbird"}):
        got = toxicity.changes(found)
        want = [(found, found - {w} | {v}) for w in sorted(found & toxicity.PARTNERS.keys()) for v in toxicity.PARTNERS[w]]
        assert len(got) == len(want)
        for (lost, gained), (a, b) in zip(got, want, strict=True):
            x, y = set(toxicity.text_features(a)), set(toxicity.text_features(b))
            assert set(lost) == x - y and set(gained) == y - x


def test_toxicity_gradient_is_that_of_the_loss():
    """A small fit by plain gradient steps on the stated loss, with differences for the gradient."""
    r = random.Random(4)
    texts = [{*(r.choice(["muslims", "women", "old", "vile", "a1", "a2", "a3"]) for _ in range(4))} for _ in range(60)]
    y = np.array([float("vile" in t) for t in texts], dtype=np.float32)
    rows, swaps = [toxicity.text_features(t) for t in texts], [toxicity.changes(t) for t in texts]
    keep = np.unique(np.concatenate(rows))
    x = np.array([[f in set(row) for f in keep] for row in rows], dtype=float)
    m = toxicity.Swaps(swaps, keep)
    w = np.array([r.uniform(-1, 1) for _ in keep])
    score = lambda z: 1 / (1 + np.exp(-z))

    def loss(w):
        total = 0.0
        for i, own in enumerate(swaps):
            for lost, gained in own:
                z = x[i] @ w
                other = z - sum(w[keep == f].sum() for f in lost) + sum(w[keep == f].sum() for f in gained)
                total += (score(z) - score(other)) ** 2 / len(own)
        return total

    z = x @ w
    was, now = score(z)[m.text], score(z[m.text] - m.times(w))
    step = 2 * m.share * (was - now)
    first, second = step * was * (1 - was), -step * now * (1 - now)
    grad = x.T @ np.bincount(m.text, first + second, len(y)) - m.back(second, len(keep))
    for k in range(len(keep)):
        e = np.eye(len(keep))[k] * 1e-5
        assert abs((loss(w + e) - loss(w - e)) / 2e-5 - grad[k]) < 1e-6


def test_attention_finds_the_bad_passage():
    r = random.Random(1)
    good = " ".join(f"w{r.randrange(500)}" for _ in range(256))
    bad = " ".join("JUNK!!" for _ in range(64))
    docs, y = [], []
    for i in range(120):
        w = [f"w{r.randrange(500)}" for _ in range(256)]
        if i % 2:
            w[64:128] = bad.split()
        docs.append(" ".join(w))
        y.append(float(i % 2 == 0))
    x, doc = quality.passages(docs)
    model = quality.fit(x, doc, np.array(y))
    assert model.scores([good])[0] > 0.5 > model.scores([good + " " + bad + " " + good])[0]
    f = model.forward(model.scaled(x), doc, len(docs))
    assert np.allclose(np.add.reduceat(f["a"], f["first"]), 1)
    attended = f["a"].reshape(-1, 4)[1::2]  # of texts with a bad passage, which is the second of four
    assert attended[:, 1].mean() > 0.5


def test_quality_forward_equals_a_loop():
    texts = ["a b c " * 60, "", "Ü x! " * 200, "one two"]
    x, doc = quality.passages(texts)
    m = quality.fit(x, doc, np.array([1.0, 0.0, 0.0, 1.0]), steps=5)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for i, score in enumerate(m.forward(m.scaled(x), doc, len(texts))["p"]):
        z = [np.clip((v - m.mean) / m.scale, -quality.LIMIT, quality.LIMIT) for v in x[doc == i]]
        h = [np.tanh(v @ m.encode[:-1] + m.encode[-1]) for v in z]
        e = np.array([np.tanh(v @ m.value[:-1] + m.value[-1]) * sigmoid(v @ m.gate[:-1] + m.gate[-1]) @ m.attend for v in h])
        a = np.exp(e) / np.exp(e).sum()
        assert abs(score - sigmoid(sum(p * v for p, v in zip(a, h, strict=True)) @ m.out[:-1] + m.out[-1])) < 1e-9


def test_quality_gradient_is_that_of_the_loss():
    """One step without memory moves every weight against the difference quotient of the loss."""
    texts = ["a b c " * 60, "", "Ü x! " * 200, "one two", "JUNK " * 100]
    y = np.array([1.0, 0.0, 0.0, 1.0, 0.0])
    x, doc = quality.passages(texts)
    before, after = (quality.fit(x, doc, y, steps=n, decay=0.0) for n in (3, 4))
    again = quality.fit(x, doc, y, steps=3, decay=0.0)
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())

    def loss(m):
        p = m.forward(m.scaled(x), doc, len(y))["p"]
        return -(share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    assert np.allclose(before.encode, again.encode) and loss(after) < loss(before)
    grad = quality.gradient(before, before.scaled(x), doc, y, share)
    for name in ("encode", "gate", "value", "attend", "out"):
        weights = getattr(before, name)
        for place in list(np.ndindex(weights.shape))[:: max(1, weights.size // 12)]:
            kept = weights[place]
            weights[place] = kept + 1e-5
            up = loss(before)
            weights[place] = kept - 1e-5
            down = loss(before)
            weights[place] = kept
            assert abs((up - down) / 2e-5 - grad[name][place]) < 1e-6, (name, place)


def test_pipeline_stages(spark, tiny):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = p.keep_quality(spark, docs, tiny)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    single = p.drop_near_duplicates(spark, kept, tiny)
    again = p.drop_near_duplicates(spark, single, tiny)
    assert single.count() == again.count() < kept.count()
    clean = p.redact_secrets(spark, single, tiny)
    assert clean.columns == docs.columns and clean.count() == single.count()
    mixed = p.mix_sources(spark, clean, tiny)
    assert sorted(r.doc_id for r in mixed.select("doc_id").collect()) == sorted(r.doc_id for r in clean.select("doc_id").collect())
    last = p.tokenize(spark, mixed, tiny).collect()
    assert len(last) == single.count() and all(r.n_tokens * 4 == len(r.ids) for r in last)


def pipeline_by_hand(docs, labels, least=0.3):
    """(doc_id, ids) in mixed order: each stage on lists of rows, without Spark, from the statements of the stages."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from sunspan.llm import secrets
    from tests.llm.test_text_operators import components_by_hand

    known = {i: q for i, q in labels if zlib.crc32(str(i).encode()) % 5 != 0 and i in docs}
    chosen = []
    for y in (0, 1):
        chosen += sorted((i for i, q in known.items() if q == y), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:2000]
    chosen.sort()
    x, doc = quality.passages([docs[i][0] or "" for i in chosen])
    model = quality.fit(x.astype(np.float32).astype(float), doc, np.array([float(known[i]) for i in chosen]))
    kept = [i for i in sorted(docs) if round(float(model.scores([docs[i][0] or ""])[0]), 12) >= least]
    groups = components_by_hand([docs[i][0] for i in kept])
    kept = [i for n, i in enumerate(kept) if groups[n][1] == n]
    texts = {}
    for i in kept:
        text, out, at = docs[i][0] or "", "", 0
        for s in secrets.scan(text):
            if s.start >= at:
                out += text[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        texts[i] = out + text[at:]
    by = defaultdict(list)
    for i in kept:
        by["=" + docs[i][1]].append(i)
    for key in by:
        by[key].sort(key=lambda i: (hashlib.md5(f"{i}:0".encode()).hexdigest(), i))
    root = {k: len(v) ** 0.5 for k, v in by.items()}
    parts = {k: max(round(r / sum(root.values()) * 1_000_000), 20) for k, r in root.items()}
    length = max(math.ceil(Fraction(math.ceil(len(v) / 16) * sum(parts.values()), parts[k])) for k, v in by.items())
    order = [i for key, k in edf(parts, length) for i in by[key][16 * k : 16 * (k + 1)]]
    assert len(order) == len(kept)
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    tok.no_truncation()
    tok.no_padding()
    return [(i, tok.encode(texts[i], add_special_tokens=False).ids) for i in order]


def test_pipeline_equals_a_brute_force_version(spark, tiny):
    import corpus_pipeline as p

    rows = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()]
    want = pipeline_by_hand({r.doc_id: (r.text, r.source) for r in rows}, labels)
    got = sorted(p.run(spark, tiny).collect(), key=lambda r: (r.mix_file, r.mix_row))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert [(r.n_tokens, np.frombuffer(r.ids, dtype="<u4").tolist()) for r in got] == [(len(x), x) for _, x in want]


def test_pipeline_stages_take_odd_rows(spark, tiny):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, _quality string, _spans string, mix_slot long, extra array<int>"
    word = " ".join(f"w{i}" for i in range(30))
    rows = [(1, word, "en", "a", 9, "q", "s", -1, [1]), (1, word, "en", "a", 9, "q", "s", -1, [1]), (2, word, None, None, None, None, None, None, None), (3, None, "en", "a", None, "q", "s", -1, [])]
    rows += [(4, "", "", "", 0, "", "", 0, []), (None, word + " x", "en", "b", 3, "q", "s", 0, []), (5, "password = 'hunter2hunter2' " * 3000, "en", "b", 84_000, "q", "s", 0, [])]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in p.STAGES:
        for case in (docs, docs.limit(0)):
            got = stage(spark, case, tiny)
            n = got.count()
            assert name == "bpe" or got.columns == docs.columns
            assert n == case.count() if name not in ("quality", "near_duplicates") else n <= case.count()
    single = [r.doc_id for r in p.drop_near_duplicates(spark, docs, tiny).collect()]
    assert sorted(map(str, single)) == ["1", "1", "3", "4", "5", "None"]
    clean = {r.doc_id: r for r in p.redact_secrets(spark, docs, tiny).collect()}
    assert "hunter2" not in clean[5].text and clean[5].n_chars == len(clean[5].text) and clean[3].text is None and clean[2].n_chars is None and clean[1]._spans == "s"
    tokens = {r.doc_id: r.n_tokens for r in p.tokenize(spark, docs, tiny).collect()}
    assert tokens[3] == tokens[4] == 0 and tokens[5] > 10_000


def test_oracles_agree(spark, tiny):
    import duckdb

    from sunspan.llm.queries import ORACLES, QUERIES

    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, tiny)
        columns = sorted(got.columns)
        want = db.execute(f"SELECT {', '.join(columns)} FROM ({sql}) t").fetchall()
        assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want)), name
