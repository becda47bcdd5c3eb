"""HTML extraction, near duplicates and the pipeline."""

import collections
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from supplypanel.llm import html_extraction as web
from supplypanel.llm import ngram_join
from supplypanel.llm.queries import QUERIES
from tests.llm.fixtures import awkward, clashing, empty, sentences

# --- pages


@pytest.fixture(scope="module")
def model(spark):
    return web.train(spark, [sentences(k) for k in range(30)])


def extracted(page, model):
    tree = web.Tree(page)
    return tree.text(web.decode(tree, web.Boosted(model).log_odds(web.features(tree))))


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, read more about them here.</p></div>
<main><article><h1>Caf&eacute; &amp; bar</h1><!-- no --><p>First   <b>bold</b>
line &lt;tag&gt; of the story that the page is about, with more words.<p>Second <i>para</i>graph of it, which is long enough too.
<div class="ad-banner">Buy two shoes for one now</div>
<ul><li>one item of a list<li>another item of it</ul></article></main>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this story about the bar very much.</p></div></section>
<aside class="sidebar"><h4>Related</h4><a href=/c>Other story</a></aside>
<form class="newsletter"><label>Your mail</label><input><button>Send</button></form>
<footer>&copy; 2024 the owners of the site</footer></body></html>"""


def test_raw_elements_end_at_their_own_tag_after_letters_that_lower_to_two():
    page = ("<p>" + "\u0130stanbul " * 40 + "</p><SCRIPT>var no = 1;</Script ><p>one</p><style>no{}</STYLE><p>two</p>"
            "<script>no</\u017fcript></script><p>three</p>")
    tree = web.Tree(page)
    text = tree.text(np.ones(len(tree.parent), bool))
    assert text == "\u0130stanbul " * 40 + "one two three"



def test_a_page_of_many_parts(model):
    assert extracted(PAGE, model) == (
        "Café & bar First bold line <tag> of the story that the page is about, with more words. "
        "Second paragraph of it, which is long enough too. one item of a list another item of it")


def test_held_out_layouts(model):
    texts, found = [sentences(k) for k in range(40, 60)], collections.Counter()
    for seed in range(50_000, 50_200):
        tree = web.Tree(web.layout(seed, texts))
        keep = web.decode(tree, web.Boosted(model).log_odds(web.features(tree)))
        article = {node for node, run, _ in tree.runs if web.MARK in run}
        for node, run, _ in tree.runs:
            found[bool(keep[node]), node in article] += len(run)
    assert found[True, True] / (found[True, True] + found[True, False]) > 0.98
    assert found[True, True] / (found[True, True] + found[False, True]) > 0.97


def test_decoding_is_the_best_assignment_without_contradictions():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(2, 8))
        tree = web.Tree("")
        tree.parent = [-1, *[int(rng.integers(0, k)) for k in range(1, n)]]
        tree.runs = [(k, "x" * int(rng.integers(1, 30)), False) for k in range(n)]
        odds = rng.normal(size=n)
        gain = odds * np.sqrt([1 + sum(len(r) for node, r, _ in tree.runs if node == k) for k in range(n)])
        best = -np.inf
        for states in np.ndindex(*[3] * n):  # 0 boilerplate, 1 frame, 2 article
            fine = states[0] > 0 and all(
                (states[tree.parent[k]], states[k]) in {(0, 0), (1, 0), (1, 1), (1, 2), (2, 2), (2, 0)} for k in range(1, n))
            if fine:
                best = max(best, sum(gain[k] for k in range(n) if states[k] == 2))
        assert gain[web.decode(tree, odds)].sum() == pytest.approx(best)


def test_printed_trees_score_like_the_model(spark):
    rows = web.training_rows(spark, [sentences(k) for k in range(5)], 40, 0)
    fitted = web.GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(rows)
    raw = [r.rawPrediction[1] for r in fitted.transform(rows).collect()]
    table = np.array([r.features.toArray() for r in rows.collect()])
    assert np.allclose(2 * np.array(raw), web.Boosted(fitted.toDebugString).log_odds(table))


def test_pages_of_odd_tables(spark, model):
    pages = [(1, None), (2, ""), (3, "<p"), (4, "</div></p>plain words only"), (5, "<div>" * 3000 + "deep"), (6, "<script>never closed"),
             (7, PAGE), (7, PAGE), (8, "<a <b> &#x41; &unknown; &amp"), (9, "<p>" + "w " * 200_000)]
    table = spark.createDataFrame(pages, "page_id long, html string").withColumns(
        {c: F.lit("clash") for c in ("text", "_html", "row", "label")})
    out = web.main_texts(table.drop("_html"), model)
    found = collections.defaultdict(set)
    for r in out.collect():
        found[r.page_id].add(r.text)
        assert r.row == r.label == "clash"
    assert found[1] == found[2] == found[6] == {""} and len(found[7]) == 1 and len(found) == 9
    assert web.main_texts(table.drop("_html").limit(0), model).count() == 0


# --- pairs


def brute_links(docs, similarity=0.8):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links, parent = [0] * len(docs), list(range(len(docs)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common / (len(sets[a]) + len(sets[b]) - common) >= similarity:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    classes = collections.defaultdict(list)
    for a, (i, _) in enumerate(docs):
        classes[root(a)].append(i)
    least = {r: min([i for i in ids if i is not None], default=None) for r, ids in classes.items()}
    return collections.Counter((docs[a][0], least[root(a)], links[a]) for a in range(len(docs)))


def near_docs():
    rng, docs = random.Random(8), []
    for group in range(6):
        base = sentences(group, 120).split()
        for _ in range(rng.choice((1, 3, 40))):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 9)}"
            docs.append((len(docs) + 100, rng.choice((" ", "\n", "  ")).join(words)))
    docs += [(900, docs[0][1]), (5, docs[1][1]), (901, "a b c d"), (902, "a  b c d"), (903, "d c b a")]
    return docs


@pytest.mark.parametrize("block", [256, 8])
def test_links_and_classes_equal_brute_force(spark, block):
    docs = [(r.doc_id, r.text) for r in awkward(spark).collect()] + near_docs()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = ngram_join.near_duplicates(clashing(table), block=block)
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in found.collect()) == brute_links(docs)


def test_one_document_of_each_class_stays(spark):
    table = spark.createDataFrame(near_docs(), "doc_id long, text string").withColumn("source", F.lit("s"))
    kept = ngram_join.without_near_duplicates(table)
    assert kept.columns == table.columns
    classes = {least for _, least, _ in brute_links(near_docs())}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(classes)
    assert ngram_join.without_near_duplicates(empty(spark)).count() == ngram_join.near_duplicates(empty(spark)).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = ngram_join.components(spark.createDataFrame(edges, "a long, b long"))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {(r.key, r.component) for r in found.collect()} == {(a, root(a)) for a in linked}


def test_banding_meets_the_recall():
    bands, rows = ngram_join.bands_and_rows(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
    rng, found, n = np.random.default_rng(6), 0, 300
    for _ in range(n):
        shared = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a, b = (np.concatenate([shared, rng.integers(0, 1 << 63, 10, dtype=np.uint64)]) for _ in range(2))
        found += bool((ngram_join.band_hashes(a, bands, rows) == ngram_join.band_hashes(b, bands, rows)).any())
    assert found == n


# --- pipeline and queries

FOLDER = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "exact dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes, names = [docs.count()], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, FOLDER)
        if k < 4:
            assert docs.columns == names
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            sizes.append(docs.count())
            texts = [r.text for r in docs.collect()]
            if k == 1:
                assert len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in texts}) == len(texts)
            if k == 2:
                assert all(links == 0 for _, _, links in brute_links([(r.doc_id, r.text) for r in docs.collect()]))
            if k == 3:
                assert not any(re.search(r"token = \"?[0-9a-f]{40}", t) for t in texts)
                clean = {r.doc_id for r in docs.collect()}
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0
    assert {r.doc_id for r in docs.collect()} == clean


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_tables(spark, name):
    found = QUERIES[name](spark, FOLDER)
    if name.startswith(("op4", "op5", "op7", "op8", "op9", "op10")):
        ids = sorted(r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())
        assert sorted(r.doc_id for r in found.collect()) == ids
    else:
        assert found.count() > 0


def whole_text(page):
    tree = web.Tree(page)
    return tree.text(np.ones(len(tree.parent), bool))


@pytest.mark.parametrize("page,text", [
    ("<p title=it's>Hello it's me</p><p>next</p>", "Hello it's me next"),
    ('<p a=b"c d=\'x>y\' e>one</p>two', "one two"),
    ("super<wbr>cali a<img src=x>b <input value='>'>c", "supercali ab c"),
    ("<p>before</p><div class='x", "before"), ("<p>before</p><div class=x", "before"), ("one <!-- two", "one"),
    ("a < b <3 </p> x </ y> z", "a < b <3 x z"), ("x<!doctype q>y<?z>w", "xyw"), ("<a x=\"1", ""), ("", ""), ("<", "<"),
    ("İ<script>if (a < b) '</p>'</SCRIPT >after", "İafter"), ("a<br/>b<div/>c", "a b c"),
])
def test_scanner_keeps_text_and_drops_markup(page, text):
    assert whole_text(page) == text


@pytest.mark.parametrize("part", ['<a "', '<a x="', "<", "<div>", "<p a='b' ", "</x><p>", "<!-", "<script>", "&lt"])
def test_time_grows_with_the_page_and_not_its_square(part):
    began = time.process_time()
    web.Tree(part * 100_000 + "</x></div></p>" * 20_000)
    assert time.process_time() - began < 15  # a restart at each tag would take hours


def test_deep_elements_close_themselves_alone():
    tree = web.Tree("<div id=outer>" + "<div>" * 1000 + "deep" + "</div>" * 1000 + "<p>next</p></div><p>after</p>")
    where = {run: tree.parent[node] for node, run, _ in tree.runs}
    outer = 1
    assert tree.tag[outer] == "div" and where["next"] == outer and where["after"] == 0
    assert web.features(tree).shape[0] == len(tree.parent) and web.decode(tree, np.ones(len(tree.parent))).all()
