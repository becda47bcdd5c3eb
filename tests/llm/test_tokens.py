"""Packing, token output, token counts and sampled segmentations."""

import collections
import random
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from supplypanel.llm import packing, segment_sampling, token_counts, token_output, word_tokens
from supplypanel.llm.common import new_folder
from tests.llm.fixtures import awkward, clashing, empty


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(word_tokens.tokenizer_path())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_encoder_equals_the_tokenizer(plain, monkeypatch):
    monkeypatch.setattr(word_tokens, "STORED", 5)
    monkeypatch.setattr(word_tokens, "CUT_CHARACTERS", 30)
    encoder = word_tokens.WordEncoder(word_tokens.tokenizer_path())
    rng = random.Random(0)
    parts = ["the", "Straße", "İ", "ΑΣ", "it's", "I'LL", "12a3", "...", "é", "é", "\xa0", "\x1c", "\x85", "ﬁ", "😀", "<|endoftext|>", "３", "x" * 200]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice(("", " ", "\n", "\t ")) for _ in range(rng.randint(0, 25)))
        assert encoder.encode(text).tolist() == plain(text)
        assert max(len(store) + len(store.old) for store in (encoder.pieces, encoder.words)) <= 10


def test_frequent_pre_tokens_are_encoded_once_however_many_are_rare(monkeypatch):
    monkeypatch.setattr(word_tokens, "STORED", 50)
    encoder, made = word_tokens.WordEncoder(word_tokens.tokenizer_path()), collections.Counter()
    encode = encoder.pieces.encode
    encoder.pieces.encode = lambda piece: made.update([piece]) or encode(piece)
    for k in range(400):
        encoder.encode(f"often {'abcdefghij'[k % 10] * (k // 10 + 1)} seen")
    assert made["often"] == made["seen"] == 1 and sum(made.values()) == 402


def test_words_met_before_are_not_cut_again(plain, monkeypatch):
    encoder = word_tokens.WordEncoder(word_tokens.tokenizer_path())
    text = "It's said, 'twas (often) 12.5; isn't it? Été--naïve"
    first = encoder.encode(text).tolist()
    monkeypatch.setattr(word_tokens, "PRE_TOKENS", None)
    assert encoder.encode(f"{text}\n{text}").tolist() == first * 2 and first == plain(text)


def test_texts_encoded_together_equal_those_encoded_alone(plain, monkeypatch):
    monkeypatch.setattr(word_tokens, "STORED", 20)
    monkeypatch.setattr(word_tokens, "CUT_CHARACTERS", 80)
    monkeypatch.setattr(word_tokens, "SHARED_BYTES", 150)
    encoder = word_tokens.WordEncoder(word_tokens.tokenizer_path())
    every = [chr(c) for c in range(0x131)]
    parts = ["the", "It's", "l'été,", "don't'", "12a3.", "...", "(a)", "x²;", "½", "ªº", "ÀÉÞ", "\x00", "İ", "ΑΣ", "😀", "<|endoftext|>", *every]
    rng = random.Random(1)
    texts = [None, "", " ", "\n\t", *(f"a{c}B {c}{c} 's{c}" for c in every), *(
        "".join(rng.choice(parts) + rng.choice(("", " ", "\r\n")) for _ in range(rng.randint(0, 30))) for _ in range(300))]
    for kind in (pa.string(), pa.large_string()):
        found = list(encoder.encode_all(pa.array(texts, kind)))
        assert [x.tolist() for x in found] == [plain(t) for t in texts] and {x.dtype for x in found} == {np.dtype(np.uint32)}
    assert list(encoder.encode_all(pa.array([], pa.string()))) == []
    assert [x.tolist() for x in encoder.encode_all(pa.array(["ab cd", "x", "EF, ab"]).slice(1))] == [plain("x"), plain("EF, ab")]


def test_words_of_neighbouring_texts_are_looked_up_once(monkeypatch):
    encoder, asked = word_tokens.WordEncoder(word_tokens.tokenizer_path()), collections.Counter()
    parted = encoder._parted
    monkeypatch.setattr(encoder, "_parted", lambda word: asked.update([word]) or parted(word))
    list(encoder.encode_all(pa.array(["one word, one WORD,", "another word, Word"] * 50)))
    assert asked == collections.Counter(["one", "word,", "another", "word"])
    assert not {"word,"} & set(encoder.pieces)  # the store holds the word and the mark


def test_released_encoders_are_gone():
    store = weakref.ref(word_tokens.encoder(word_tokens.tokenizer_path()).pieces)
    word_tokens.release()
    assert store() is None


# --- packing


def test_pieces_hold_every_id_once_and_sequences_have_no_gap(spark, plain):
    docs = awkward(spark)
    found = packing.packed_documents(docs).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = plain(r.text) + [0]
        want.update((r.doc_id, k // 2048, k, tuple(ids[k : k + 2048])) for k in range(0, len(ids), 2048))
    assert want == collections.Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found)
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for members in sequences.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in found)
    assert len(sequences) == -(-total // 2048)


def test_packing_in_rounds_is_close_to_the_bound(spark):
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in rng.integers(1, 2049, 3000)]
    table = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "k long, length long, offset string")
    found = packing.pack(table, group_pieces=256).collect()
    fill = collections.Counter()
    for r in found:
        fill[r.sequence_id] += r.length
    assert sorted(r.k for r in found) == list(range(3000)) and max(fill.values()) <= 2048
    assert len(fill) <= 1.03 * sum(lengths) / 2048 + 1
    again = packing.pack(table.repartition(7), group_pieces=256)
    assert again.count() == 3000


def test_swaps_empty_a_sequence_that_best_fit_leaves():
    lengths = np.array([6, 5, 3, 2, 2, 2])
    assert len(packing.best_fit(lengths, 10)) == 3
    assert len(packing.packed(lengths, 10)) == 2
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = rng.integers(1, 30, rng.integers(1, 40))
        first = packing.best_fit(lengths, 40)
        search = packing.Swaps(lengths, first, 40)
        squares = int((search.fills**2).sum())
        after = search.run()
        assert sorted(i for b in after for i in b) == list(range(len(lengths)))
        assert max(lengths[b].sum() for b in after) <= 40 and len(after) <= len(first)
        assert int((search.fills**2).sum()) >= squares


def test_packing_of_odd_tables(spark):
    assert packing.packed_lengths(empty(spark)).count() == 0
    docs = clashing(awkward(spark))
    assert packing.packed_lengths(docs).count() == packing.packed_lengths(awkward(spark)).count()


# --- files


def test_files_give_back_every_document(spark, plain, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_BYTES", 64)
    docs, folder = clashing(awkward(spark)), new_folder(spark, "files")
    token_output.write_tokens(docs, folder)
    want = sorted(((r.doc_id, plain(r.text) + [2]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    found = token_output.digests(spark, folder).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=repr) == sorted(
        ((i, len(ids), crc(ids)) for i, ids in want), key=repr)
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [i for i, _ in want]
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered[:-1]]]).tolist()
    some = token_output.fetch_tokens(spark, folder, spark.createDataFrame([(8,), (13,), (77,)], "doc_id long")).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in some} == {i: ids for i, ids in want if i in (8, 13)}


def test_a_shared_dictionary_is_used_and_checked(spark, plain):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("some text that all documents share to learn from number "), F.col("id").cast("string")).alias("text"))
    folder = new_folder(spark, "files")
    token_output.write_tokens(docs, folder)
    name, content = token_output._dictionary(spark, folder)
    assert content and spark.read.parquet(f"{folder}/index").where(F.col("dictionary_hash") != name).count() == 0
    ids = {r.doc_id: r.ids_crc32 for r in token_output.digests(spark, folder).collect()}
    assert ids == {r.doc_id: crc(plain(r.text) + [2]) for r in docs.collect()}
    blocks = spark.read.parquet(f"{folder}/blocks").withColumn("places", F.array())
    with pytest.raises(Exception, match="needs dictionary"):
        token_output._decoded(blocks, ("other", content)).count()


def test_files_of_an_empty_table(spark):
    folder = new_folder(spark, "files")
    token_output.write_tokens(empty(spark), folder)
    assert token_output.digests(spark, folder).count() == 0
    token_output.write_tokens(awkward(spark), folder)  # what was there is replaced
    assert token_output.digests(spark, folder).count() == awkward(spark).count()


# --- counts


def applied(text, edits):
    out, done = [], 0
    for start, end, put in sorted(edits):
        start = min(max(start, done), len(text))
        end = min(max(end, start), len(text))
        out += [text[done:start], put]
        done = end
    return "".join(out) + text[done:]


def test_edited_trees_equal_counts_from_scratch():
    count, rng = token_counts.counter(token_counts.ranks_path()), random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "\n\n", "'s", "1", "2 ", "é", "!", "the", "   \n", "\t", "'", "ll"]
    some = lambda n: "".join(rng.choice(parts) for _ in range(n))
    for _ in range(600):
        text = some(rng.choice((0, 1, 5, 200, 1500)))
        tree = token_counts.TokenTree(*count.leaves(text))
        edits = [(a := rng.randint(0, len(text) + 2), a + rng.choice((0, 0, 1, 3, 50, 400)), some(rng.choice((0, 1, 3, 60))))
                 for _ in range(rng.randint(0, 6))]
        got, again = token_counts.edited(text, tree, sorted(edits), count)
        assert got == applied(text, edits)
        assert tree.total == len(count.encoding.encode_ordinary(got))
        for levels in (tree.chars, tree.tokens):
            for below, above in zip(levels, levels[1:]):
                assert above == [sum(below[k : k + 2]) for k in range(0, len(below), 2)]
        if len(text) > 5000 and len(edits) == 1 and edits[0][1] - edits[0][0] < 4:
            assert again < 600


def test_counts_of_tables(spark):
    count = token_counts.counter(token_counts.ranks_path())
    edit = "array<struct<start:int,end:int,text:string>>"
    docs = clashing(awkward(spark)).drop("n_tokens").withColumn("edits", F.when(F.col("doc_id") > 4, F.expr(
        f"cast(array(struct(2, 4, 'zz'), null, struct(0, 1, null), struct(3, 9, '')) as {edit})")))
    done = token_counts.apply_edits(token_counts.token_trees(docs)).collect()
    want = collections.Counter(
        (r.doc_id, applied(r.text or "", [(2, 4, "zz"), (0, 1, ""), (3, 9, "")] if (r.doc_id or 0) > 4 else [])) for r in docs.collect())
    assert want == collections.Counter((r.doc_id, r.text) for r in done)
    assert all(r.n_tokens == len(count.encoding.encode_ordinary(r.text)) for r in done)
    nothing = token_counts.token_trees(empty(spark)).withColumn("edits", F.expr(f"cast(array() as {edit})"))
    assert token_counts.apply_edits(nothing).count() == 0


# --- segmentations


def all_segmentations(model, word):
    edges, _ = model._edges(word)

    def go(at, ids, weight):
        for target, i, w in edges[at]:
            if target < 0:
                yield tuple(ids + [i]), weight + w
            else:
                yield from go(target, ids + [i], weight + w)

    found = dict(go(0, [], 0.0))
    total = np.logaddexp.reduce(list(found.values()))
    return {k: v - total for k, v in found.items()}


def test_samples_have_the_distribution_of_draws_without_replacement():
    model = segment_sampling.sampler(segment_sampling.model_path())
    logs = all_segmentations(model, "▁hello")
    p = {k: np.exp(v) for k, v in logs.items()}
    starts, n = model.prepare(["hello"])[0], 6000
    first, second, pieces = collections.Counter(), collections.Counter(), 0.0
    for key in range(n):
        one, two = model.sample([starts], [key * 7919], 2)[0]
        assert tuple(one[0]) != tuple(two[0]) and one[2] > two[2]
        for ids, log_p, _, inclusion in (one, two):
            assert abs(log_p - logs[tuple(ids)]) < 1e-9
            pieces += np.exp(log_p - inclusion) * len(ids) / n
        first[tuple(one[0])] += 1
        second[tuple(two[0])] += 1
    for k in p:
        after = sum(p[a] * p[k] / (1 - p[a]) for a in p if a != k)
        assert abs(first[k] / n - p[k]) < 0.025 and abs(second[k] / n - after) < 0.025
    # Weighting by the inverse inclusion probability makes sums over samples unbiased.
    assert abs(pieces - sum(len(k) * v for k, v in p.items())) < 0.1


def test_small_lattices_are_drawn_whole():
    model = segment_sampling.sampler(segment_sampling.model_path())
    found = model.sample(model.prepare(["to"]), [1], 50)[0]
    assert {tuple(ids) for ids, *_ in found} == set(all_segmentations(model, "▁to"))
    assert all(inclusion == 0 for *_, inclusion in found)


def test_lattices_made_together_equal_those_made_alone():
    model = segment_sampling.Sampler(segment_sampling.model_path())
    words = ["▁the,", "▁internationalisation", "▁▁▁x", "abc", "▁é😀x", "▁" + "z" * 90]
    model._add_all(words)
    for word in words:
        at, alone = model.places[word], model._add(word)
        size = len(model._edges(word)[0])
        cut = [(model.first[k], model.first[k + size] if k + size < len(model.first) else len(model.share)) for k in (at, alone)]
        (a, b), (c, d) = cut
        assert list(model.piece[a:b]) == list(model.piece[c:d])
        assert np.allclose(model.share[a:b], model.share[c:d])


def test_segmentations_of_tables_decode_to_their_texts(spark):
    docs = clashing(awkward(spark))
    found = segment_sampling.segmentations(docs, k=3)
    assert found.where("not decodes").count() == 0
    per = collections.defaultdict(set)
    back = segment_sampling.decoded(found).collect()
    for r in back:
        assert r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes())
        per[r.doc_id, r.decoded].add(tuple(r.ids))
    texts = {(r.doc_id, r.text or "") for r in docs.collect()}
    assert set(per) == texts
    assert all(len(v) == (3 if len(t) > 2 and t.strip() else len(v)) for (_, t), v in per.items())
    same = segment_sampling.segmentations(docs.repartition(5), k=3)
    key = lambda r: (str(r.doc_id), r.sample, r.ids_crc32, round(r.perturbed, 9))
    assert sorted(map(key, back)) == sorted(map(key, same.collect()))
    assert segment_sampling.segmentations(empty(spark)).count() == 0


def test_two_pieces_for_one_are_found_in_any_sequence_and_at_any_place():
    # Only the last of 101 sequences, which has least room, and there only its last pieces give a pair for the donor's.
    bins, lengths = [], []
    for sizes in [[500]] + [[1000]] * 100 + [[45] * 18 + [200, 200]]:
        bins.append(list(range(len(lengths), len(lengths) + len(sizes))))
        lengths += sizes
    search = packing.Swaps(np.array(lengths), bins, 1310)
    room = search.capacity - search.fills
    pair = search._pair(500, room, np.maximum(search.fills[0] - search.fills, 0), 0)
    assert sorted(search.lengths[pair].tolist()) == [200, 200]


def test_a_pair_is_found_wherever_brute_force_finds_one():
    rng, seen = np.random.default_rng(4), set()
    for _ in range(300):
        count = int(rng.integers(1, 30))
        lengths = rng.integers(1, 60, count)
        search = packing.Swaps(lengths, packing.best_fit(lengths, 100), 100)
        room, donor = search.capacity - search.fills, int(rng.integers(len(search.bins)))
        floor = np.maximum(search.fills[donor] - search.fills, 0)
        size = int(lengths[search.bins[donor][0]])
        want = [(i, j) for b, members in enumerate(search.bins) if b != donor for i in members for j in members
                if i != j and floor[b] < size - lengths[i] - lengths[j] <= room[b]]
        found = search._pair(size, room, floor, donor)
        assert tuple(found) in want if want else found == []
        seen.add(bool(want))
    assert seen == {True, False}
