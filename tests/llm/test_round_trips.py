"""Repeated ids, clashing names, empty tables and odd inputs through every stage, and what each method must use."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from showerlake.llm import bitslice, common, op02_html, op04_bpe, op06_embeddings, op08_urls, op09_language, op10_exact, shingles  # noqa: E402
from showerlake.llm.common import Scratch  # noqa: E402
from showerlake.llm.pretokens import VOCABULARY  # noqa: E402

VOCAB = {"en": "the thing which with would there other about", "de": "der nicht sein schon über gegen andere einen"}
#: Names that operators might use inside.
CLASH = "gone0 string, source_ string, prob double, mark long, key long, digest string, cls long, `__mark` long, keep_id long, group_size long, n long"


def words(seed, n=40):
    rng = random.Random(seed)
    lang = list(VOCAB)[seed % 2]
    return " ".join(rng.choice(VOCAB[lang].split()) + str(rng.randrange(50)) for _ in range(n)), lang


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, *words(i), f"s{i % 2}") for i in range(60)]
    rows += [(5, *words(200), "s0"), (5, *words(5), "s0"), (5, *words(5), "s0")]  # one id: another text, and its own again, twice
    rows += [(900, words(5)[0].upper(), "de", "s1"), (None, *words(300), "s1"), (None, words(7)[0], "de", "s1")]
    rows += [(901, words(9)[0] + " x1", "de", "s0"), (9, words(9)[0] + " x2", "de", "s0"), (902, None, None, None), (903, "", "en", "s0"), (904, " ".join([words(11, 400)[0]] * 40), "de", "s1")]
    extra = ("g", "h", 0.5, 1, 2, "d", 3, 4, 5, 6, 7)
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + CLASH).repartition(3)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_exact(rows):
    """Rows that stay: of equal texts the largest id; a null id yields; rows equal in both stay together."""
    best = {}
    for i, text, *_ in rows:
        k = lowered(text)
        best[k] = max((x for x in (best.get(k), i) if x is not None), default=None)
    return [r for r in rows if best[lowered(r[1])] == r[0]]


def grams(text):
    w = lowered(text).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute_near(rows):
    """Rows that stay: the smallest id of each component, of texts under that id the one of the smaller hash."""
    sets, comp = [grams(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if comp[i] != comp[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    name = lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) ^ (1 << 63))
    best = {c: min(name(r) for r, x in zip(rows, comp) if x == c) for c in set(comp)}
    return [r for r, c in zip(rows, comp) if name(r) == best[c]]


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_dedup_stages_keep_every_text_of_a_repeated_id(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    rows = [tuple(r) for r in docs.collect()]
    exact = stages["exact_dedup"](spark, docs, "")
    assert exact.columns == docs.columns and bag(exact.collect()) == bag(brute_exact(rows))
    near = stages["near_dedup"](spark, docs, "")
    assert near.columns == docs.columns and bag(near.collect()) == bag(brute_near(rows))


def test_every_stage_takes_clashing_names_and_empty_tables(spark, docs, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "encoding":
            assert out.count() == docs.count()
        else:
            assert out.columns == docs.columns and not bag(out.collect()) - bag(docs.collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_equals_the_stages_by_brute_force(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    model = op09_language.train(plain)
    rows = brute_near(brute_exact([r for r in rows if (p := model.predict(r[1]))[0] != "und" and p[1] >= op09_language.LEAST_SCORE]))
    mixing = dict(corpus_pipeline.STAGES)["mixing"]
    kept = [tuple(r) for r in mixing(spark, spark.createDataFrame(rows, plain.schema), "").collect()]
    e = op04_bpe.encoder(VOCABULARY)
    want = Counter((r[0], tuple(e.encode(r[1]))) for r in kept)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_exact_chain_holds_texts_that_share_their_name(spark, monkeypatch):
    monkeypatch.setattr(op10_exact, "named", lambda norm: (F.length(norm).cast("long"), F.octet_length(norm), F.lit(b"x")))
    rows = [(i, "ab cd ef"[k : k + 2]) for i, k in enumerate([0, 0, 3, 3, 3, 6, 0])] + [(90, "AB"), (91, "zzz"), (92, "zzz")]
    got = op10_exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [(0, 90, 4), (1, 90, 4), (2, 4, 3), (3, 4, 3), (4, 4, 3), (5, 5, 1), (6, 90, 4), (90, 90, 4), (91, 92, 2), (92, 92, 2)]


def test_hot_groups_are_joined_without_their_key(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_BROADCAST", 3)
    monkeypatch.setattr(common, "LEAST_HOT", 5)
    rows = [(i, f"text {i % 50}" if i % 3 else "hot") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = op10_exact.exact_groups(docs, Scratch(spark, "t")).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == sorted((i, max(groups[t]), len(groups[t])) for i, t in rows)
    assert {r["doc_id"] for r in op10_exact.stage(spark, docs, "").collect()} == {max(g) for g in groups.values()}


def test_wide_planes_match_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (9, 64), np.uint8)
    prints = base[rng.integers(0, 9, 400)] ^ (rng.random((400, 64)) < 0.06) * rng.integers(0, 256, (400, 64)).astype(np.uint8)
    keys = np.sort(rng.integers(0, 4, 400))
    bits = np.unpackbits(prints, axis=1).astype(np.int32)
    far = np.array([np.abs(bits - b).sum(1) for b in bits])
    want = {(i, j) for i, j in zip(*np.nonzero((far < 128) & (keys[:, None] == keys[None])), strict=True) if i < j}
    got = [p for i, j in bitslice.close_pairs(keys, prints, 7) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert set(got) == want and len(got) == len(want) > 100


def test_families_are_dealt_out_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(shingles, "CHUNK_TEXTS", 6)
    monkeypatch.setattr(shingles, "CHUNK_BAND", 8)
    monkeypatch.setattr(shingles, "COMMON", 3)
    rng, rows = random.Random(8), []
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    for i in range(50):
        copy = list(base)
        for at in rng.sample(range(90), i % 9):
            copy[at] = f"x{i}.{at}"
        rows.append((i, " ".join(copy)))
    got = shingles.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), Scratch(spark, "t")).filter("kept").collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in brute_near(rows)}


def test_embeddings_of_repeated_ids_and_mixed_lengths(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a), (1, b), (2, a), (3, [0.99, 0.05, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.01]), (6, [1.0] * 7), (7, []), (None, b), (8, None), (8, a)]
    got = op06_embeddings.near_duplicates(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cls long, n int"), Scratch(spark, "t"))
    want = [(1, 3, 1, True), (1, 1, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (7, 0, 7, True), (None, 1, 1, False), (8, 0, 8, True), (8, 3, 1, False)]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_embeddings_recall_with_far_more_lists_than_probes(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(900, 32))
    x = np.concatenate([base, base[:700] + rng.normal(size=(700, 32)) * 0.25, base[:300] + rng.normal(size=(300, 32)) * 0.3])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= op06_embeddings.COSINE
    quantiser = op06_embeddings.Quantiser(x, 200)
    probes = quantiser.probes(x)
    home, seen = np.array([p[0] for p in probes]), [set(p.tolist()) for p in probes]
    i, j = np.nonzero(np.triu(link, 1))
    met = np.mean([home[b] in seen[a] or home[a] in seen[b] for a, b in zip(i, j, strict=True)])
    assert len(i) > 300 and met >= 0.95 and np.mean([len(p) for p in probes]) < 60


def splits(node):
    return [] if node.feature < 0 else [op02_html.FEATURES[node.feature], *splits(node.low), *splits(node.high)]


def test_html_tree_uses_words_links_and_neighbours():
    used = set(splits(op02_html.tree()))
    assert {"words", "links"} <= used and used & {"words_before", "words_after"} and used & {"links_before", "links_after"}
    assert splits(op02_html.tree())[0] not in ("named", "element", "half_named")


PARAGRAPHS = "<h1>The title</h1><p>" + "one two three four five six seven " * 8 + "<p>" + "more words of the same kind " * 9


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><meta name=a><body><article>{PARAGRAPHS}</article>",
        f"<html><head><title>x</title><article>{PARAGRAPHS}</article>",
        f"<form action=x><div class=menu><a>Home</a></div><article>{PARAGRAPHS}</article></form>",
        f"<form action=x><div class=menu><a>Home</a></div>{PARAGRAPHS}</form>",
        f"<div class='ad-free'><article>{PARAGRAPHS}</article></div><div class=ad>Buy</div>",
        f"<section class='social-history'>{PARAGRAPHS}</section>",
        f"<article><header><h1>The title</h1></header>{PARAGRAPHS[18:]}</article><form>Mail me</form>",
    ],
)
def test_html_pages_keep_their_article(page):
    want = ["The title", " ".join(["one two three four five six seven"] * 8), " ".join(["more words of the same kind"] * 9)]
    assert op02_html.main_text(page).split("\n") == want


def test_url_tree_rejects_unlabelled_branches_of_like_shape(spark):
    urls = [f"http://a.com/en/{i}" for i in range(40)] + [f"http://a.com/fr/{i}" for i in range(30)] + [f"http://a.com/about/{w}/x.html" for w in "abcdefgh"]
    urls += [f"http://b.org/fr/{i}" for i in range(30)] + ["http://a.com/*/~", "http://a.com/" + "/".join("d" * 40)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in op08_urls.judge(rows, Scratch(spark, "t")).collect()}
    verdicts = lambda text: {got[i]["verdict"] for i, u in enumerate(urls) if text in u}
    assert verdicts("a.com/fr/") == {"block"} and verdicts("a.com/en/") == {"block"}
    assert verdicts("about") == verdicts("b.org") == verdicts("*") == verdicts("/d/d") == {"allow"}
    bare = {r["page_id"]: r["verdict"] for r in op08_urls.judge(rows, Scratch(spark, "t"), rules=[]).collect()}
    assert set(bare.values()) == {"allow"}
    assert {got[i]["purity"] for i, u in enumerate(urls) if "b.org" in u} == {0.5}


def test_language_of_signs_is_undetermined():
    rows = [words(i) for i in range(40)]
    model = op09_language.LanguageModel(np.stack([op09_language.features(t) for t, _ in rows]), [g for _, g in rows], [len(t) for t, _ in rows])
    texts = [None, "", "½ ² ①", "12 !", "the thing", "x" * 300_000]
    got = model.predict_all(texts)
    assert [g[0] for g in got[:4]] == ["und"] * 4 and got[4][0] in VOCAB and got[5][0] in VOCAB
    assert [g[0] for g in model.predict_all(texts[::-1])[::-1]] == [g[0] for g in got]
