"""Exact duplicates, quality rules, secret scans and chat formatting."""

import collections
import hashlib
import random
import re
import string

import pytest
import xxhash
from pyspark.sql import functions as F

from supplypanel.llm import chat, exact_dedup, quality_rules, secret_scan
from supplypanel.llm.common import join_groups
from tests.llm.fixtures import awkward, clashing, empty, rows, sentences

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- exact duplicates


def expected_groups(table):
    found = collections.defaultdict(list)
    for doc_id, text in table:
        found[BLANK.sub(" ", text or "")].append(doc_id)
    out = []
    for text, ids in found.items():
        known = [i for i in ids if i is not None]
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, min(known) if known else None, len(ids), sha) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda text: F.unhex(F.lpad(F.length(text) % 2, 2, "0"))])
def test_groups_equal_brute_force_even_when_hashes_collide(spark, hashed):
    docs = awkward(spark)
    found = exact_dedup.duplicate_groups(docs, hashed=hashed)
    no_python(found)
    assert rows(found.drop("kept")) == expected_groups([(r.doc_id, r.text) for r in docs.collect()])
    kept = found.where("kept").collect()
    assert len(kept) == len({r.text_sha256 for r in kept}) == found.select("text_sha256").distinct().count()
    assert all(r.doc_id == r.keep_id for r in kept)


def test_duplicates_leave_one_row_with_all_columns(spark):
    docs = clashing(awkward(spark))
    left = exact_dedup.without_duplicates(docs.drop("text_sha256"))
    assert left.columns == docs.drop("text_sha256").columns
    texts = [BLANK.sub(" ", r.text or "") for r in left.collect()]
    assert len(texts) == len(set(texts)) == 12
    assert exact_dedup.without_duplicates(empty(spark)).count() == exact_dedup.duplicate_groups(empty(spark)).count() == 0


def test_a_group_of_many_rows_is_joined_whole(spark):
    keys = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = keys.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    joined = join_groups(keys, groups, ["k"], "n")
    assert joined.count() == 9000 and joined.where("least > id").count() == 0
    assert joined.agg(F.sum("n")).first()[0] == 3000**2 + 6000


# --- quality rules


def brute_quality(docs, trusted, buckets, threshold):
    def grams(words):
        h = lambda *p: xxhash64(p) % buckets
        return [h(w) for w in words] + [h(a, b) for a, b in zip(words, words[1:])]

    def xxhash64(parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    raw, good = collections.Counter(), collections.Counter()
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    for (i, _), w in zip(docs, words):
        raw.update(g := grams(w))
        good.update(g * (i in trusted))
    n_raw, n_good, out = sum(raw.values()), sum(good.values()), []
    import math

    ratio = {b: round(1e6 * math.log((good[b] + 20) / (raw[b] * n_good / max(1, n_raw) + 20))) for b in raw}
    for (i, text), w in zip(docs, words):
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = collections.Counter(windows)
        covered = {p for k, x in enumerate(windows) if many[x] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        g = grams(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
                    len(covered), failed, not failed and sum(ratio[b] for b in g) >= threshold * len(g)))
    return sorted(out, key=repr)


def test_quality_equals_brute_force(spark):
    rng = random.Random(5)
    docs = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    for k in range(100, 160):
        junk = k % 4 == 0
        words = [f"|{rng.randint(0, 11)}%" if junk else rng.choice(sentences(k % 9).split()) for _ in range(rng.randint(40, 120))]
        docs.append((k, rng.choice((" ", "\n")).join(words)))
    labels = [(k, int(k % 4 != 0), 0) for k in range(100, 140)] + [(141, 1, 1), (None, 1, 0), (142, None, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = quality_rules.quality_rules(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), buckets=1024)
    no_python(found)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    trusted = {i for i, q, t in labels if q == 1 and t == 0}
    want = brute_quality(docs, trusted, 1024, quality_rules.THRESHOLD)
    assert rows(found.select(*names)) == want
    assert {w[-1] for w in want if not w[-2]} == {True, False}


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_rules(empty(spark), labels).count() == 0
    docs = clashing(awkward(spark))
    found = quality_rules.quality_rules(docs.drop("_words", "_ratios"), labels)
    assert found.count() == docs.count()
    # Without trusted documents the base rule alone decides.
    assert found.where("kept = base_failed").count() == 0


def test_copies_of_a_clean_text_decide_no_verdict(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choice(sentences(k % 13).split()) for _ in range(80))) for k in range(400)]
    clean = " ".join(f"plain{k}" for k in range(80))
    docs += [(1000 + k, ("\n " if k % 2 else "") + clean) for k in range(200)]
    docs += [(None, clean), (5, clean)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 400, 3)], "doc_id long, quality int, toxic int")
    found = quality_rules.quality_rules(table, labels, buckets=4096)
    no_python(found)
    verdicts = [r.kept for r in found.select("kept", "text").collect() if "plain0" in r.text]
    assert verdicts == [True] * 202
    trusted = spark.createDataFrame([(k,) for k in (3, 1007)], "doc_id long")
    texts = rows(quality_rules.distinct_texts(table, trusted))
    assert len(texts) == 401 and [t for w, t in texts if w == clean.split()] == [1]
    # One cell for all texts: everything is grouped, with the same outcome.
    assert rows(quality_rules.distinct_texts(table, trusted, cells=1)) == texts


def test_equal_windows_are_found_with_others_of_their_hash_between(spark):
    def windowed(w):
        seed = 42
        for word in w:
            seed = xxhash.xxh64_intdigest(word, seed)
        return seed % (1 << 38)

    seen = {}
    for k in range(10_000_000):
        if (other := seen.setdefault(windowed(("a", "b", f"w{k}")), k)) != k:
            break
    first, between = f"a b w{other}", f"a b w{k}"
    apart = [" ".join(f"x{j}{i}" for i in range(20)) for j in range(4)]
    text = " ".join((apart[0], first, apart[1], between, apart[2], first, apart[3]))
    found = spark.createDataFrame([(text,)], "text string").select(
        quality_rules.repeated_words(quality_rules.words_of(F.col("text"))))
    assert found.first()[0] == 6


# --- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, a, b) for a, _, kind, b in sorted(spans)]


def secret_docs():
    rng = random.Random(11)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    b64 = string.ascii_letters + string.digits + "+/"
    texts = [f"ключ 😀 {some(b64, 44)} end {sentences(k)}" for k in range(30)]
    texts += [f"{some(string.ascii_lowercase + string.digits, 40)} x" for _ in range(20)]
    texts += [f"see path_to_file_2_of_the_report_by_year_{k} and {sentences(k)}" for k in range(40)]
    texts += ["aaaaaaaaaaaaaaaaaaaaaaaa1111111111111111", "0123456789abcdefghijklmnopqrstuvwxyz", "ABAB1212" * 6]
    texts += ["secret:token:abcdefgh", "Token = 'abc' PASSWORD=\"hunter22\"", "api_key: : x=y", "AKIA" + "Z" * 15,
              "xAKIA" + "Q7" * 9, "deadbeef" * 3, "deadbeef" * 2, "token == abcdef", "passwd:" + "=" * 7]
    rng.shuffle(texts)
    return texts


def test_secrets_keep_base_spans_and_find_random_runs(spark):
    docs = [(r.doc_id, r.text) for r in awkward(spark).collect()] + list(enumerate(secret_docs(), 100))
    found = secret_scan.secret_spans(spark.createDataFrame(docs, "doc_id long, text string"))
    no_python(found)
    planted = hit = 0
    for r in found.collect():
        spans = [tuple(s) for s in r.secret_spans]
        assert [s for s in spans if s[0] != "random"] == base_spans(r.text)
        assert spans == sorted(spans, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
        marked = [r.text[a:b] for kind, a, b in spans if kind == "random"]
        ordinary = "path_to_file" in (r.text or "") or (r.text or "")[:4] in ("aaaa", "0123", "ABAB")
        assert not (ordinary and marked)
        if (r.text or "").startswith("ключ") or re.fullmatch("[a-z0-9]{40} x", r.text or ""):
            planted, hit = planted + 1, hit + bool(marked)
    assert planted == 50 and hit >= 45


def test_runs_of_one_kind_and_runs_around_base_spans_are_tested(spark):
    rng = random.Random(7)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    digits = string.digits
    kinds = {"small": (string.ascii_lowercase, 80), "large": (string.ascii_uppercase, 80), "both": (string.ascii_letters, 40)}
    planted = [(kind, some(*of)) for kind, of in kinds.items() for _ in range(40)]
    # A base span covers the hexadecimal middle of these.
    b64 = string.ascii_letters + digits
    planted += [("around", some(b64, 30) + "Z" + some("0123456789abcdef", 24) + "Z" + some(b64, 30)) for _ in range(40)]
    planted += [("digits", some(digits, 22)) for _ in range(40)]
    planted += [("words", "".join(rng.choice(("erlich", "heit", "tion", "ungen", "ment", "lich", "verein")) for _ in range(6))) for _ in range(40)]
    table = spark.createDataFrame([(k, f"a {run} b") for k, (_, run) in enumerate(planted)], "doc_id long, text string")
    tested = {r.doc_id: len(r._random) for r in secret_scan._scanned(table).collect()}
    assert set(tested.values()) == {1}
    hit = collections.Counter()
    for r in secret_scan.secret_spans(table).collect():
        kind, run = planted[r.doc_id]
        hit[kind] += ("random", 2, 2 + len(run)) in [tuple(s) for s in r.secret_spans]
    assert hit["words"] == 0
    assert min(hit[kind] for kind in ("small", "large", "both")) >= 36 and hit["around"] >= 30, hit


def test_secrets_of_odd_tables(spark):
    assert secret_scan.secret_spans(empty(spark)).count() == 0
    docs = clashing(awkward(spark))
    assert secret_scan.secret_spans(docs).count() == docs.count()


def test_redaction_replaces_overlapping_spans_once(spark):
    text = "é token = abcdef0123456789abcdef0123456789 and password: hunter22."
    docs = spark.createDataFrame([(1, text, 5), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redacted(docs).collect()}
    assert out == {1: ("é [SECRET] and [SECRET]", 23), 2: (None, None), 3: ("clean", 5)}


# --- chats

TURNS = "conv_id long, turn long, role string, text string, extra string"


def test_snapshots_collapse_to_maximal_conversations(spark):
    rng = random.Random(2)
    table, want = [], {}
    for c in range(40):
        whole = [(rng.choice(("user", "assistant", None)), rng.choice(("hi", "", None, f"t{c}"))) for _ in range(rng.choice((1, 3, 150)))]
        for cut in {len(whole), *(rng.randint(1, len(whole)) for _ in range(4))}:
            for _ in range(rng.choice((1, 2))):
                conv = len(want)
                want[conv] = whole[:cut]
                table += [(conv, t, r, x, "e") for t, (r, x) in enumerate(whole[:cut])]
    rng.shuffle(table)
    best = {}
    contents = {tuple(w) for w in want.values()}
    for conv, w in sorted(want.items()):
        if not any(len(o) > len(w) and o[: len(w)] == tuple(w) for o in contents):
            best.setdefault(tuple(w), conv)
    found = chat.rendered(spark.createDataFrame(table, TURNS))
    no_python(found)
    texts = collections.defaultdict(str)
    for r in found.orderBy("conv_id", "part").collect():
        texts[r.conv_id] += r.text
    line = lambda r, x: f"<|{r or ''}|>\n{x or ''}\n<|end|>\n"
    assert dict(texts) == {conv: "".join(line(*t) for t in w) for w, conv in best.items()}


def test_chats_of_odd_tables(spark):
    assert chat.rendered(spark.createDataFrame([], TURNS)).count() == 0
    odd = [(None, None, None, None, None), (None, 1, "user", "x", ""), (1, 1, "user", "a", ""), (1, 1, "user", "a", ""),
           (2, 5, "user", "a", ""), (2, 9, "user", "a", ""), (2, 12, "user", "b", "")]
    out = {r.conv_id: (r.n_turns, r.n_snapshots) for r in chat.rendered(spark.createDataFrame(odd, TURNS)).collect()}
    assert out == {None: (2, 1), 2: (3, 1)}


def test_a_small_share_of_a_huge_table_is_not_none(spark):
    from supplypanel.llm.common import sampled

    keys = spark.range(200_000)
    share = keys.where(sampled(F.col("id"), 0.01)).count() / 200_000
    assert abs(share - 0.01) < 0.002 and keys.where(sampled(F.col("id"), 1.0)).count() == 200_000
    # Of 10^12 rows 2,000 are wanted: the hash's bound is then far above 0.
    plan = keys.where(sampled(F.col("id"), 2000 / 1e12))._jdf.queryExecution().toString()
    assert f"< {int(2000 / 1e12 * (1 << 63))}" in plan and int(2000 / 1e12 * (1 << 63)) > 1e10


def test_many_spans_in_one_text_take_time_in_proportion(spark):
    import time

    from supplypanel.llm.common import match_spans

    rng = random.Random(4)
    words = [f"{rng.getrandbits(128):032x}" for _ in range(20_000)]
    text = "é" + " ".join(words) + " end"
    table = spark.createDataFrame([(text,), ("",), ("xyz",), ("ab",)], "t string")
    began = time.time()
    found = [r.s for r in table.select(match_spans(F.col("t"), "[0-9a-f]{2,}").alias("s")).collect()]
    assert time.time() - began < 60  # a fold over all at once takes minutes
    assert [(s.start, s.end, s.match) for s in found[0]] == [(1 + 33 * i, 33 + 33 * i, w) for i, w in enumerate(words)]
    assert [len(s) for s in found[1:]] == [0, 0, 1]
