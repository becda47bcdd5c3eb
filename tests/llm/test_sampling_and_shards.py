"""Importance resampling, source divergence and sharding against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from supplypanel.llm import importance_sampling as sampling
from supplypanel.llm import sharding, source_divergence
from supplypanel.llm.common import kept
from supplypanel.llm.ranks import numbered
from tests.llm.fixtures import awkward, clashing, empty, rows, sentences
from tests.llm.test_native import no_python

SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(spark, n=200):
    """Rows with sources, shared and rare terms, terms of every length bucket, and a source with most rows."""
    made = []
    for i in range(n):
        long = " ".join("ab" * k for k in (4, 5, 8, 9, 16, 17, 32, 33, 40) if (i + k) % 3 == 0)
        text = f"{sentences(i, 40)} {long} Ünï{'é' * (i % 40)} x{i % 5}y " + "Common " * (i % 7)
        made.append((i, text, ("en", "de", None)[i % 3], "s0" if i % 2 else f"s{i % 7}", len(text)))
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")


# --- numbers along an order


def test_numbers_have_no_gaps_and_follow_the_order(spark):
    table = kept(spark.range(5000).selectExpr("id % 3 as g", "cast(null as int) as same", "(id * 7919) % 100 as v", "id"))
    table = kept(table.withColumn("g", F.when(F.col("id") < 4000, 0).otherwise(F.col("g"))))  # one group holds most
    found = numbered(table, ["same", F.desc("v")], ["g"]).collect()
    assert len(found) == 5000
    for g in range(3):
        own = sorted((r for r in found if r.g == g), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        assert [r.v for r in own] == sorted((r.v for r in own), reverse=True)
    assert numbered(kept(spark.range(0)), ["id"]).count() == 0


# --- importance resampling


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def features(text, runs):
    own = words(text)
    return [" ".join(own[i : i + k]) for k in range(1, runs + 1) for i in range(len(own) - k + 1)]


def expected_draw(docs, target, runs, buckets, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x, runs)) for texts in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out = []
    for doc_id, text in docs:
        own = features(text, runs)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append((doc_id, len(words(text)), len(own), weight, score))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    ranks = collections.defaultdict(list)
    for i, r in enumerate(order):
        ranks[r].append(i + 1 if i < len(order) * percent // 100 else None)
    return sorted([(*r, ranks[r].pop(0) if ranks.get(r) else None) for r in out], key=repr)


@pytest.mark.parametrize("runs", [1, 2, 3])
@pytest.mark.parametrize("piece", [sampling.PIECE_BYTES, 7])
def test_draw_equals_brute_force(spark, monkeypatch, runs, piece):
    monkeypatch.setattr(sampling, "PIECE_BYTES", piece)  # workers are forked later, but the head below is made here
    docs = prose(spark).select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text"))
    target = spark.createDataFrame([(sentences(k, 30),) for k in range(5)] + [(None,)], "text string")
    found = sampling.resampled(clashing(docs), target, runs=runs, buckets=500)
    table = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(found) == expected_draw(table, [r.text for r in target.collect()], runs, 500)


@pytest.mark.parametrize("runs", [1, 2, 4])
def test_pieces_and_the_heads_size_change_nothing(monkeypatch, runs):
    text = (sentences(3, 200) + "  É x").encode()
    want = collections.Counter(zlib.crc32(f.encode()) % 977 for f in features(text.decode(), runs))
    for words_, pairs in (([], []), ([b"the", b"fox"], [b"the lazy"]), (list(set(text.lower().split())), [])):
        for piece in (1, 5, 64, 1 << 20):
            monkeypatch.setattr(sampling, "PIECE_BYTES", piece)
            parts = list(sampling.Head(words_, pairs, 977).features(text, runs))
            assert collections.Counter(np.concatenate([p[0] for p in parts]).tolist()) == want
            assert sum(p[1] for p in parts) == len(words(text.decode()))


def test_head_holds_frequent_runs_alone_and_counts_all(spark, monkeypatch):
    docs = spark.createDataFrame([("a b " * 50 + f"w{i} " + "long" * 20,) for i in range(40)], "text string")
    assert set(sampling.frequent(docs, 1)) >= {b"a", b"b"}
    assert set(sampling.frequent(docs, 2)) >= {b"a b", b"b a"}
    assert all(len(w) <= sampling.HEAD_BYTES for w in sampling.frequent(docs, 1))
    monkeypatch.setattr(sampling, "HEAD_SHARE", 4)
    assert sorted(sampling.frequent(docs, 1)) == [b"a", b"b"]


def test_drawn_documents_keep_their_columns(spark):
    docs, target = clashing(prose(spark)), spark.createDataFrame([(sentences(1),)], "text string")
    drawn = sampling.drawn_documents(docs, target)
    assert drawn.columns == docs.columns and drawn.count() == 20
    ranks = sampling.resampled(docs, target).where("rank is not null").collect()
    assert sorted(r.rank for r in ranks) == list(range(1, 21))
    assert {r.doc_id for r in ranks} == {r.doc_id for r in drawn.select("doc_id").collect()}


def test_empty_tables_give_empty_draws(spark):
    none = spark.createDataFrame([], "text string")
    assert sampling.resampled(empty(spark), none).count() == 0
    assert sampling.resampled(awkward(spark), none).count() == awkward(spark).count()


# --- source divergence


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def expected_divergence(table, least=3, top=200):
    docs = [(lang or "", source or "", terms(text)) for text, lang, source in table]
    out = []
    for lang in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in of for t in set(d[2]))
        keep = sorted((t for t in df if df[t] >= least), key=str.encode)
        share = {}
        for group in [None, *sorted({d[1] for d in of})]:
            n = collections.Counter(t for d in of if group in (None, d[1]) for t in d[2] if df[t] >= least)
            total = sum(n.values()) + len(keep)
            share[group] = ({t: 1 + 10**9 * (n[t] + 1) // total for t in keep}, n)
        for group in share.keys() - {None}:
            p, n = share[group]
            pair = [(sum((p[t] - q[t]) ** 2 // q[t] for t in keep), other)
                    for other, (q, _) in share.items() if other not in (None, group)]
            q = share[None][0]
            over = [((p[t] - q[t]) ** 2 // q[t], t) for t in keep if n[t] > 0 and p[t] > q[t]]
            for part, found in (("pair", pair), ("term", over)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, group, part, item, v, i + 1) for i, (v, item) in enumerate(found[: top if part == "term" else None])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1, 5000, source_divergence.CHUNK_BYTES])
def test_divergence_equals_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(source_divergence, "CHUNK_BYTES", chunk)
    docs = prose(spark).unionByName(awkward(spark))
    table = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert rows(source_divergence.divergence(clashing(docs))) == expected_divergence(table)


@pytest.mark.parametrize("cells,block", [(40, 256), (1 << 18, 2), (7, 3)])
def test_slices_and_blocks_change_nothing(spark, monkeypatch, cells, block):
    docs = prose(spark, 90)
    want = expected_divergence([(r.text, r.lang, r.source) for r in docs.collect()], least=2, top=5)
    monkeypatch.setattr(source_divergence, "CELLS", cells)
    monkeypatch.setattr(source_divergence, "SOURCE_BLOCK", block)
    assert rows(source_divergence.divergence(docs, least=2, top=5)) == want


def test_terms_of_a_chunk_equal_brute_force():
    rng = np.random.default_rng(5)
    letters = list("abcXYZé中") + [" ", "1", "-", "@", "\x00"]
    texts = ["".join(rng.choice(letters, p=[0.11] * 8 + [0.024] * 5, size=rng.integers(0, 400))) for _ in range(300)]
    texts += ["", "a" * 5000, "a" * 64, "a" * 65, "b" * 16, "b" * 17, "c" * 8, "c" * 9, "end", "begin"]
    groups = np.array([i % 5 for i in range(len(texts))])
    raw = [t.encode() for t in texts]
    buffer = np.frombuffer(b"".join([*raw, bytes(source_divergence.WIDEST)]), np.uint8)
    want_n, want_docs = collections.Counter(), collections.Counter()
    for g, t in zip(groups.tolist(), texts):
        want_n.update((g, x) for x in terms(t))
        want_docs.update((g, x) for x in set(terms(t)))
    found_n, found_docs = {}, {}
    for group, term, n, docs in source_divergence.counted_terms(buffer, np.cumsum([len(r) for r in raw]), groups):
        for k, c, d in zip(zip(group.tolist(), term.to_pylist()), n.tolist(), docs.tolist()):
            assert k not in found_n
            found_n[k], found_docs[k] = c, d
    assert found_n == want_n and found_docs == want_docs


def test_radix_order_is_stable_and_by_unsigned_value():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 3, 1000).astype(np.uint32), rng.choice(np.array([0, 1, 2**63, 2**64 - 1, 2**16], np.uint64), 1000)]
    want = sorted(range(1000), key=lambda i: (int(keys[0][i]), int(keys[1][i])))
    assert source_divergence.radix_order(keys).tolist() == want


def test_counts_beyond_64_bits_of_scaled_numbers(spark):
    from supplypanel.llm.source_divergence import _share

    big = 10**15
    found = spark.range(1).select(_share(F.lit(big), F.lit(3 * big))).first()[0]
    assert found == 1 + 10**9 * (big + 1) // (3 * big)


def test_divergence_of_empty_and_termless_tables(spark):
    assert source_divergence.divergence(empty(spark)).count() == 0
    bare = spark.createDataFrame([("1 2", "xx", "a"), (None, "xx", "b"), ("rare", "yy", None)], "text string, lang string, source string")
    assert rows(source_divergence.divergence(bare)) == [("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)]


# --- sharding


def expected_shard(key, weights):
    def draw(s, w):
        h = int(hashlib.md5(f"{'' if key is None else key}:{s // 4}".encode()).hexdigest()[8 * (s % 4) : 8 * (s % 4) + 8], 16)
        return -w / math.log((h + 0.5) / 2**32)

    return max(range(len(weights)), key=lambda s: (draw(s, weights[s]), -s))


@pytest.mark.parametrize("weights", [[1.0] * 40, [1.0, 2.0, 0.5, 4.0, 0.0], [3.0]])
def test_plan_equals_brute_force(spark, weights):
    docs = clashing(awkward(spark)).unionByName(clashing(prose(spark)))
    plan = sharding.shard_plan(docs, weights, added=1.5)
    no_python(plan)
    found = plan.collect()
    table = docs.select("doc_id", "text").collect()
    size = lambda t: len((t or "").encode())
    want = [(r.doc_id, size(r.text) + 16, zlib.crc32((r.text or "").encode()), expected_shard(r.doc_id, weights),
             expected_shard(r.doc_id, [*weights, 1.5])) for r in table]
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in found), key=repr) == sorted(want, key=repr)
    for shard in {r.shard for r in found}:
        own = sorted((r for r in found if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert [(r.doc_id is None, r.doc_id or 0) for r in own] == sorted((r.doc_id is None, r.doc_id or 0) for r in own)
    assert all(r.grown_shard in (r.shard, len(weights)) for r in found)
    assert sharding.shard_plan(empty(spark), weights).count() == 0


def test_records_follow_weights_and_few_move(spark):
    weights = [1.0, 2.0, 3.0, 4.0]
    found = spark.range(20_000).select(
        sharding.shard_and_grown(F.col("id"), weights, 2.0).alias("f"),
        sharding.shard_of(F.col("id"), weights[:3]).alias("fewer"), sharding.shard_of(F.col("id"), [1.0, 2.0, 3.0, 5.0]).alias("heavier"),
    ).select("f.*", "fewer", "heavier").collect()
    counts = collections.Counter(r.shard for r in found)
    assert all(abs(counts[s] / 20_000 - w / 10) < 0.015 for s, w in enumerate(weights))
    moved = [r for r in found if r.grown_shard != r.shard]
    assert all(r.grown_shard == 4 for r in moved) and abs(len(moved) / 20_000 - 2 / 12) < 0.015
    assert all(r.fewer == r.shard for r in found if r.shard != 3)  # a shard that goes gives up only its own
    assert all(r.heavier in (r.shard, 3) for r in found)  # a shard that grows heavier only takes
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), [])


def test_written_shards_hold_every_row_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "FILE_BYTES", 20_000)
    docs = clashing(awkward(spark)).unionByName(clashing(prose(spark))).withColumn("shard", F.lit("clash"))
    sharding.write_shards(docs, str(tmp_path / "out"), [1.0, 1.0, 2.0])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted(docs.columns)
    assert rows(back.select("doc_id", "text", "shard")) == sorted(
        ((r.doc_id, r.text, expected_shard(r.doc_id, [1.0, 1.0, 2.0])) for r in docs.collect()), key=repr)
    assert len(list((tmp_path / "out").glob("shard=2/*.parquet"))) > 1
