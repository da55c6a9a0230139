"""Corpus operators against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from showerlake.llm import op01_simhash, op02_html, op03_quality, op04_bpe, op05_tokens, op06_embeddings, op07_mixing, op08_urls, op09_language, op10_exact
from showerlake.llm.common import Scratch
from showerlake.llm.components import connected_components
from showerlake.llm.pretokens import VOCABULARY, ranks
from showerlake.llm.trees import grow, paths, predict

PATH = public_tokenizers.path(VOCABULARY)
#: Extra columns carry names that the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, key long, kept boolean, `group` string"
WORDS = "der the of and que les los und tion haben mente eaux Wort maison casa Haus thing été niño über".split()


def text_of(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", "s"]) for _ in range(n))


def doc_rows():
    rows = [(i, text_of(i, 20 + 5 * i), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100 + i, text_of(3, 35), "en", "s0") for i in range(8)]  # copies
    rows += [(200 + i, text_of(29, 165) + " " + WORDS[i], "de", "s1") for i in range(6)]  # near copies
    rows += [(300, None, None, None), (301, "", "en", "s2"), (302, " \t\n", "en", "s2"), (303, "one", "en", "s0"), (304, "Two Words", None, "s0"), (305, "two words", "de", None)]
    rows += [(306, text_of(7, 30_000), "en", "s0"), (307, "É é ﬁ 漢字  x", "fr", "s1"), (308, "12345 !!!", "fr", "s1")]
    rows += [rows[4], rows[4], (None, "no id at all", "en", "s0")]  # repeated rows, a null id
    return [(*r, len(r[1] or ""), 1, 2, True, "g") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)) if shingles else 0


def brute_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_simhash_matches_brute_force(spark, docs, empty):
    got = op01_simhash.near_duplicates(docs, Scratch(spark, "t")).collect()
    assert len(got) == docs.count()
    want = {r[0]: brute_fingerprint(r[1]) for r in doc_rows()}
    assert all(r["fp"] & (2**64 - 1) == want[r["doc_id"]] for r in got)
    ids = sorted(i for i in want if i is not None)
    label = brute_components(ids, lambda a, b: (want[a] ^ want[b]).bit_count() <= 3)
    assert all(r["component_id"] == label[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert op01_simhash.near_duplicates(empty, Scratch(spark, "t")).count() == 0


def test_bit_sliced_buckets_match_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40)
    prints = np.array([b ^ sum(1 << int(k) for k in rng.integers(0, 63, rng.integers(0, 6))) for b in base.tolist() for _ in range(8)], np.int64)
    keys = np.sort(rng.integers(0, 12, len(prints)))
    moved, root = op01_simhash.bucket_links(keys, prints)
    got = np.arange(len(prints))
    got[moved] = root
    label = brute_components(range(len(prints)), lambda a, b: keys[a] == keys[b] and (int(prints[a]) ^ int(prints[b])).bit_count() <= 3)
    assert got.tolist() == [label[i] for i in range(len(prints))]


def test_hot_bucket_is_dealt_in_chunks_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(op01_simhash, "CHUNK", 16)
    prints = [(i, 1 << (i % 64) if i < 64 else (1 << (i % 64)) | (1 << ((i * 7) % 64))) for i in range(160)]
    classes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for f, i in {f: i for i, f in prints}.items()], "fp long, rep long")
    rows = op01_simhash.candidate_rows(classes).repartition("bucket").sortWithinPartitions("bucket")
    found = connected_components(rows.mapInArrow(op01_simhash._edges, "a long, b long"), Scratch(spark, "t")).collect()
    data = {r["rep"]: r["fp"] & (2**64 - 1) for r in classes.collect()}
    label = brute_components(sorted(data), lambda a, b: (data[a] ^ data[b]).bit_count() <= 3)
    assert {r["node"]: r["component"] for r in found} == {n: c for n, c in label.items() if sum(c == x for x in label.values()) > 1}


def test_components_of_a_long_chain_a_star_and_rubbish(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(50)] + [(5, 5), (None, 3), (70, None), (2000, 1999), (1999, 2000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(51)} | {1999: 1999, 2000: 1999}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_html_blocks():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>if (a<b) '</p>'</script></head><body><header>Site</header><nav><a href=x>Home</a> <a>About us</a></nav>"
        "<div class='ad'>Buy now</div><article><h1>Head &amp; line</h1><p>First   para\n with <a href=y>a link</a> and &eacute;&#33;</p><p>Short.<br>Next"
        "<aside>Related: <a>x</a></aside><!-- <p>no</p> --><p>Last one</article><div id=comments><p>I disagree with all of this entirely</p></div><form>Your mail <input></form><footer>&copy; Site</footer>"
    )
    assert op02_html.main_text(page) == "Head & line\nFirst para with a link and é!\nShort. Next\nLast one"
    plain = "<div class=menu><ul><li><a>One</a><li><a>Two</a></ul></div><h2>A title of the story</h2><p>" + "word " * 60 + "</p><p>" + "more " * 40 + "</p>"
    assert op02_html.main_text(plain) == "A title of the story\n" + ("word " * 60).strip() + "\n" + ("more " * 40).strip()
    wrapped = "<div class='layout has-sidebar'><main><p>Kept text of some length</p></main><div class='side sidebar'>Links</div></div>"
    assert op02_html.main_text(wrapped) == "Kept text of some length"
    assert [op02_html.main_text(x) for x in (None, "", "   ", "<p>", "<script>alert(1)")] == [""] * 5
    assert op02_html.main_text("<article><p>" + "x " * 200_000) == ("x " * 200_000).strip()


def test_html_rows(spark):
    rows = [(1, "u", None, 5), (2, None, "<article><p>Hi</p></article>", 5), (2, None, "<article><p>Hi</p></article>", 5)]
    got = sorted(tuple(r) for r in op02_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).fillna("-").collect())
    assert got == [(1, "u", "", 0), (2, "-", "Hi", 2), (2, "-", "Hi", 2)]
    assert op02_html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_trees_split_and_paths():
    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1]] * 5, float)
    y = (x[:, 0] * x[:, 1]).astype(float)
    tree = grow(x, y, 2, 1)
    assert np.allclose(predict(tree, x), y) and len(paths(tree)) == 4


def test_quality_rules_learn_and_compile(spark, empty):
    rows = [(i, " ".join(["spam!!"] * (20 + i % 7)) if i % 3 == 0 else text_of(i, 40), int(i % 3 != 0)) for i in range(600)]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(9001, None), (9002, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = op03_quality.train(docs, labels)
    got = {r["doc_id"]: r for r in op03_quality.score_quality(docs, model).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert held and all(got[r[0]]["predicted"] == r[2] for r in held)
    assert got[9001]["score"] == got[9002]["score"] and 0 <= got[9001]["score"] <= 1
    assert len(model.rules) < 60
    assert op03_quality.score_quality(empty, model).count() == 0
    nothing = op03_quality.train(docs, labels.limit(0))
    assert op03_quality.score_quality(docs, nothing).first()["score"] == 0.5


def test_bpe_equals_the_library_and_round_trips(spark, docs, empty):
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(PATH), special_tokens={})
    got = op04_bpe.encode_documents(docs, PATH).collect()
    texts = {r[0]: r[1] or "" for r in doc_rows()}
    assert len(got) == docs.count()
    for r in got:
        assert r["ids"] == real.encode_ordinary(texts[r["doc_id"]]) and bytes(r["decoded"]).decode() == texts[r["doc_id"]]
    digests = {r["doc_id"]: r for r in op04_bpe.encode_documents(docs, PATH, digests=True).collect()}
    for i, t in texts.items():
        assert digests[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, real.encode_ordinary(t))).encode()).hexdigest()
    assert op04_bpe.encode_documents(empty, PATH).count() == 0


def test_bpe_random_text_appends_and_edits():
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(PATH), special_tokens={})
    e, rng = op04_bpe.encoder(PATH), random.Random(4)
    letters = [chr(c) for c in range(32, 0x600)] + list("  \n\t'sdt" * 40) + ["漢", "😀", "　", "\x1c", "\x85"]
    for n in (1, 2, 3, 10, 40, 200):
        for _ in range(40):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert e.encode(text) == real.encode_ordinary(text)
    data = b"thinking about unbelievable internationalisation and more of it" * 3
    table = op04_bpe.PrefixTable(e.vocabulary, data[:50])
    table.append(data[50:])
    assert table.tokens() == e.vocabulary.merged(data)
    for _ in range(20):
        a = rng.randrange(len(table.data))
        b = min(len(table.data), a + rng.randrange(5))
        new = table.data[:a] + b"xyz" + table.data[b:]
        table.edit(a, b, b"xyz")
        assert table.data == new and table.tokens() == e.vocabulary.merged(new)


def test_token_counts_match_a_plain_search(spark, docs, empty):
    trie = op05_tokens.counter(PATH).trie

    def plain(piece):
        best = [(0.0, 0)]
        for end in range(1, len(piece) + 1):
            options = [(best[s][0] + trie.score[piece[s:end]], -(best[s][1] + 1)) for s in range(end) if piece[s:end] in trie.score]
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1]

    split = re.compile(op05_tokens.counter(PATH).find.__self__.pattern)
    got = {r["doc_id"]: r for r in op05_tokens.count_tokens(docs, PATH).collect()}
    for r in doc_rows()[:48]:
        pieces = split.findall(r[1] or "")
        want = [plain(p.encode()) for p in pieces]
        assert got[r[0]]["n_tokens"] == sum(w[1] for w in want) and got[r[0]]["n_pretokens"] == len(pieces)
        assert got[r[0]]["log_prob"] == pytest.approx(sum(w[0] for w in want))
    assert op05_tokens.count_tokens(empty, PATH).count() == 0


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 16))
    near = np.repeat(base[:10], 12, 0) + rng.normal(size=(120, 16)) * 0.15
    hot = np.repeat(base[20:21], 60, 0)
    x = np.concatenate([base, near, hot]).astype(np.float32)
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [float("inf")] + [0.0] * 15), (904, [None] + [1.0] * 15)]
    frame = spark.createDataFrame(rows + [(i, v, 0, 1) for i, v in bad], "vec_id long, embedding array<float>, label int, links int")
    got = {r["vec_id"]: r for r in op06_embeddings.near_duplicates(frame, Scratch(spark, "t")).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    label = brute_components(range(len(x)), lambda a, b: link[a, b])
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found >= 0.97 * (link.sum() - len(x)) and all(got[i]["n_links"] <= link[i].sum() - 1 for i in range(len(x)))
    assert np.mean([got[i]["component_id"] == label[i] for i in range(len(x))]) > 0.97
    assert all(tuple(got[i])[1:] == (0, i, True) for i, _ in bad)
    assert op06_embeddings.near_duplicates(frame.limit(0), Scratch(spark, "t")).count() == 0


def test_raking_meets_its_targets(spark, docs, empty):
    rng = np.random.default_rng(3)
    keys = [np.repeat(["a", "b", "c"], 4), np.tile(["x", "y"], 6), np.tile(["p", "p", "q", "q"], 3)]
    mass = rng.uniform(1, 9, 12)
    targets = [{"a": 0.2, "b": 0.5, "c": 0.3}, {"x": 0.4, "y": 0.6}, {"p": 0.7, "q": 0.3}]
    w = op07_mixing.rake(keys, mass, targets)
    for k, t in zip(keys, targets, strict=True):
        for name, share in t.items():
            assert (w * mass)[k == name].sum() / mass.sum() == pytest.approx(share, abs=1e-6)
    got = op07_mixing.mix(docs, Scratch(spark, "t")).toPandas()
    assert len(got) == docs.count() and got["prob"].between(0, 1).all()
    assert op07_mixing.mix(empty, Scratch(spark, "t")).count() == 0
    big = op07_mixing.mix(docs, Scratch(spark, "t"), most_cells=2).toPandas()
    both = got.merge(big, on=["doc_id", "tokens"], suffixes=("", "_big")).dropna()
    assert np.allclose(both["weight"], both["weight_big"], rtol=2e-2)


def test_url_rules_and_templates(spark):
    urls = ["http://A.Example.com/en/7?x", "https://com/en/x", "http://m.org/es/1#t", "http://x.net/de/8", "http://www.example.net/de/81", "nothing", None, "://h/p", "http://notexample.com/en/7", "http://example.com?x/en/"]
    rows = [(i, u, "v", "r") for i, u in enumerate(urls)] + [(100 + i, f"http://x.org/es/{i}", "", "") for i in range(20)] + [(200, "http://x.org/es", "", ""), (201, "http://x.org/fr/3", "", "")]
    got = {r["page_id"]: r for r in op08_urls.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string, raw string"), Scratch(spark, "t")).collect()}
    want = [("a.example.com", "/en/7", "example.com/en/7", "allow"), ("com", "/en/x", "com/en/", "block"), ("m.org", "/es/1", "org/es/", "block"), ("x.net", "/de/8", "net/de/", "allow"), ("www.example.net", "/de/81", "example.net/de/8", "block"),
            ("", "", None, "allow"), ("", "", None, "allow"), ("h", "/p", None, "allow"), ("notexample.com", "/en/7", "com/en/", "block"), ("example.com", "", None, "allow")]
    assert [tuple(got[i])[1:5] for i in range(len(urls))] == want
    assert got[100]["verdict"] == "block" and got[201]["verdict"] == "allow" and len(got) == len(rows)
    assert op08_urls.judge(spark.createDataFrame([], "page_id long, url string"), Scratch(spark, "t")).count() == 0


def test_url_templates_reject_by_purity_and_merge(spark):
    leaves = [("h", f"k{i}/#", [f"k{i}", "#"], 10, 9, 1) for i in range(3)] + [("h", "good/#", ["good", "#"], 10, 0, 40), ("h", "none/#", ["none", "#"], 10, 0, 0)]
    frame = spark.createDataFrame(leaves, "host string, raw string, segs array<string>, n long, blocked long, allowed long")
    got = {r["raw"]: r for r in op08_urls.judge_templates(frame, Scratch(spark, "t")).collect()}
    assert got["k0/#"]["purity"] > 0.7 and got["good/#"]["purity"] < 0.1 and got["none/#"]["purity"] == 0.5


def test_language_in_two_steps(spark, empty):
    vocabulary = {"en": "the thing which with would there", "de": "der nicht sein schon über gegen", "fr": "les avec être pour dans aussi", "es": "los para también está cuando niño"}
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(vocabulary[g].split()) for _ in range(30)), g) for i in range(400) for g in [list(vocabulary)[i % 4]]]
    docs = spark.createDataFrame(rows + [(9001, None, "en"), (9002, "", "en"), (9003, "123 !!", "de"), (9004, "the", None)], "doc_id long, text string, lang string")
    model = op09_language.train(docs)
    got = {r["doc_id"]: r for r in op09_language.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == g for i, _, g in rows) and any(got[i]["held_out"] for i, _, _ in rows)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (9001, 9002, 9003))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nobody = op09_language.train(docs.select("doc_id", "text", "lang").limit(0))
    assert {r["lang_pred"] for r in op09_language.identify(docs, nobody).collect()} == {"und"}
    assert op09_language.identify(empty, model).count() == 0


def test_exact_groups(spark, docs, empty):
    got = op10_exact.exact_groups(docs, Scratch(spark, "t")).collect()
    rows = doc_rows()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(lowered(r[1]), []).append(r[0])
    by_id = {r[0]: r for r in rows}
    for r in got:
        ids = groups[lowered(by_id[r["doc_id"]][1])]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (max(known) if known else None)
        assert bytes(r["digest"]).hex() == hashlib.sha256(lowered(by_id[r["doc_id"]][1]).encode()).hexdigest()
    assert op10_exact.exact_groups(empty, Scratch(spark, "t")).count() == 0


def test_directory_doubles_until_buckets_fit(spark):
    entries = spark.range(3000).selectExpr("xxhash64(id) as key")
    got = op10_exact.directory(entries, 2, capacity=100, doublings=6).collect()
    sizes = {}
    for r in entries.collect():
        slot = (1 << 8) + ((r["key"] & (2**64 - 1)) >> 56)
        bucket = next(g for g in got if g["slot"] == slot)
        assert bucket["bucket"] == slot >> (8 - bucket["local_depth"])
        sizes[bucket["bucket"]] = sizes.get(bucket["bucket"], 0) + 1
    assert max(sizes.values()) <= 100
