"""The queries that SQL does not express, on small tables against plain versions."""

import random
import zlib

import pytest

from showerlake.llm import op02_html, op03_quality, op07_mixing, op08_urls, op09_language
from showerlake.llm.common import Scratch

TEXT = {"en": "the thing which with would there other about", "de": "der nicht sein schon über gegen andere einen", "fr": "les avec être pour dans aussi cette leurs", "es": "los para también está cuando niño sobre entre"}


def plain_mix(rows):
    """Weights and probabilities of each cell by raking in the order source, language, topic."""
    cells = {}
    for _, text, lang, source in rows:
        n = len((text or "").split())
        topic = "table" if " | " in (text or "") else "short" if n < 50 else "prose" if n < 1500 else "long"
        key = (source if source is not None else "\u0000none", lang if lang is not None else "\u0000none", topic)
        cells[key] = cells.get(key, 0) + n
    total, w = sum(cells.values()), dict.fromkeys(cells, 1.0)
    targets = []
    for m in range(3):
        share = {}
        for k, mass in cells.items():
            share[k[m]] = share.get(k[m], 0) + mass
        powered = {k: v**op07_mixing.TEMPER for k, v in share.items() if v > 0}
        targets.append({k: v / sum(powered.values()) * total for k, v in powered.items()})
    for _ in range(op07_mixing.ROUNDS):
        moved = 0.0
        for m in range(3):
            have = {}
            for k, mass in cells.items():
                have[k[m]] = have.get(k[m], 0) + w[k] * mass
            for k in cells:
                factor = targets[m].get(k[m], 0.0) / have[k[m]] if have[k[m]] > 0 else 1.0
                moved = max(moved, abs(factor - 1))
                w[k] *= factor
        if moved < op07_mixing.TOLERANCE:
            break
    below, limit = 0, 0.0
    for k in sorted(cells, key=lambda k: w[k]):
        below, limit = below + cells[k], w[k]
        if below >= op07_mixing.UNCAPPED * total:
            break
    return {k: (w[k], min(1.0, w[k] / limit)) for k in cells}


def test_mixing_equals_plain_raking(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(TEXT[g].split()) for _ in range(rng.choice([5, 60, 200, 1600]))) + rng.choice(["", " | x"]), g, rng.choice(["a", "a", "b", None])) for i in range(300) for g in [rng.choice(list(TEXT))]]
    rows += [(900, "w " * 40_000, "en", "a"), (901, "x y z", None, None), (5, "of one id", "en", "b")]
    want = plain_mix(rows)
    for cells in (op07_mixing.MOST_CELLS, 3):
        got = op07_mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), Scratch(spark, "t"), most_cells=cells).collect()
        assert len(got) == len(rows)
        for r in got:
            weight, prob = want[r["source"], r["lang"], r["topic"]]
            assert r["weight"] == pytest.approx(weight, rel=1e-5) and r["prob"] == pytest.approx(prob, rel=1e-5)
        sure = [r for r in got if r["prob"] >= 1.0]
        assert sure and all(r["kept"] for r in sure)


def test_url_hosts_paths_and_rules_by_plain_reading(spark):
    rng = random.Random(13)
    part = lambda: rng.choice(["en", "de", "es", "7", "8", "75", "x y", "A", "", "%2F", "*", "~", "**"])
    urls = [rng.choice(["http", "https", "ftp", "a://b", ""]) + rng.choice(["://", ":/", "://"]) + rng.choice(["", "M.", "a.b."]) + rng.choice(["example.com", "Example.NET", "x.org", "com", "notexample.com", "example.community"]) + "".join("/" + part() for _ in range(rng.randrange(5))) + rng.choice(["", "?q=/en/", "#/de/", "/?"]) for _ in range(600)]
    urls += [None, "", "://", "http:///en/7", "http://example.com/" + "en/" * 300]

    def plain(url):
        url = url or ""
        if "://" not in url:
            return "", "", None, None
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
        fit = [(h + p, v) for v, h, p in op08_urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fit, key=lambda f: len(f[0])) if fit else (None, None))

    got = op08_urls.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), Scratch(spark, "t")).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = plain(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["purity"] >= op08_urls.REJECT else "allow"))


def test_languages_and_folds_of_every_row(spark):
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choice(TEXT[g].split()) for _ in range(25)), g) for i in range(500) for g in [list(TEXT)[i % 4]]] + [(3, "les avec dans", "fr"), (3, "der nicht", "de"), (700, "the " * 60_000, "en"), (None, "los para niño", "es")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string")
    got = op09_language.identify(docs, op09_language.train(docs)).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got) == sorted((str(i), g) for i, _, g in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)


def test_quality_rows_with_repeated_ids_and_labels(spark):
    rows = [(i, "spam!! " * 30 if i % 2 else " ".join(TEXT["en"].split()[k % 8] + str(k * i % 7) for k in range(60))) for i in range(300)]
    rows += [(4, rows[1][1]), (4, rows[4][1]), (800, "word " * 100_000), (801, None)]
    docs = spark.createDataFrame([(*r, 0.0, 1) for r in rows], "doc_id long, text string, score double, quality int")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(300) for _ in range(3)] + [(2, 0, 0)], "doc_id long, quality int, toxic int")
    got = op03_quality.score_quality(docs, op03_quality.train(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    once = {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] < 300 and r["doc_id"] != 4}
    assert all(once[i] == int(i % 2 == 0) for i in once)


def test_pages_are_rebuilt_from_their_labels(spark):
    rng, rows, want = random.Random(15), [], {}
    sentence = lambda n: " ".join(rng.choice(TEXT["en"].split()) for _ in range(n))
    for i in range(60):
        kept = [sentence(rng.choice([1, 3, 8, 40, 90])) for _ in range(rng.randrange(1, 7))]
        around = [f"<nav><ul><li><a href=x>{sentence(1)}</a><li><a>{sentence(2)}</a></ul></nav>", f"<div class=ad>{sentence(9)}</div>", f"<div class='sidebar left'><p>{sentence(12)}</div>", f"<form><p>{sentence(3)}<input></form>", f"<section id=comments><p>{sentence(50)}<p>{sentence(4)}</section>", f"<footer>&copy; {sentence(5)}</footer>", "<script>if (a<b) '</p>'</script>", f"<aside><p>{sentence(30)}</aside>"]
        before, after = rng.sample(around, 3), rng.sample(around, 3)
        rows.append((i, f"http://h/{i}", "<html><head><title>t</title>" + rng.choice(["</head>", ""]) + "<body>" + "".join(before) + "<article>" + "".join(f"<p>{rng.choice(['', ' ', chr(10)])}{k}" for k in kept) + "</article>" + "".join(after)))
        want[i] = "\n".join(kept)
    got = op02_html.extract(spark.createDataFrame([(*r, "t", 1) for r in rows + rows[:2]], "page_id long, url string, html string, text string, n_chars int")).collect()
    assert len(got) == 62 and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(want[r["page_id"]]) for r in got)
