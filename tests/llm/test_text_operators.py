"""Operators that judge or cut single texts: edge cases, and results against brute force."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, language_id, license_scan, packing, quality_crf, quality_rules, url_filter

ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "a word or two"), (4, "Zwei Wörter"), (4, "Zwei Wörter"), (5, "x" * 50_000), (6, "one two three four five six seven eight " * 300)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names that operators use themselves."""
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("score", "h", "d", "n", "copy", "lang", "kept")})


def empty(spark, extra=""):
    return spark.createDataFrame([], f"doc_id long, text string{extra}")


def base_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [v for v in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", v)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_rules(spark, odd):
    texts = [*ODD, (7, "a b c d e f g h a b c d e f g h"), (8, "a b c d e f g h i\na b c d e f g h i\n#$ %"), (9, "ä ö \x1c ß")]
    rows = quality_rules.ledger(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    got = sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == sorted(base_rules(t) for _, t in texts)
    assert quality_rules.ledger(odd).count() == len(ODD)
    assert quality_rules.ledger(empty(spark)).count() == 0


def test_policies_and_ablation(spark):
    rows = spark.createDataFrame([(0, 5), (0b1, 2), (0b11, 1), (0b100, 3)], "failed long, times long").withColumn("x", F.explode(F.sequence(F.lit(1), F.col("times"))))
    v1 = quality_rules.POLICIES["v1"]
    assert quality_rules.apply_policy(rows, v1).where("kept").count() == 5
    got = {r["rule"]: (r["n_failed"], r["n_only_this"]) for r in quality_rules.ablation(rows, v1).collect()}
    assert got["few_words"] == (3, 2) and got["repeated_words"] == (1, 0) and got["many_symbols"] == (3, 3)


def test_crf_marginals_are_exact():
    rng = np.random.default_rng(1)
    model = quality_crf.Model(np.zeros(1), rng.normal(size=(2, 2)))
    u = rng.normal(size=5).tolist()
    weight = {}
    for code in range(32):
        y = [code >> i & 1 for i in range(5)]
        weight[code] = np.exp(sum(v for v, s in zip(u, y) if s) + sum(model.move[a, b] for a, b in zip(y, y[1:])))
    z = sum(weight.values())
    want = [sum(w for c, w in weight.items() if c >> i & 1) / z for i in range(5)]
    assert model.marginals(u) == pytest.approx(want)


def test_crf_learns_and_scores(spark, odd):
    good, bad = "a calm line of plain words here\n" * 5, "BUY NOW!! $$$ ### CLICK!! %%%\n" * 5
    rows = spark.createDataFrame([(i, good if i % 2 else bad, i % 2) for i in range(40)], "doc_id long, text string, quality int")
    model = quality_crf.fit(rows)
    assert model.score(good.encode())[0] > 0.8 > 0.2 > model.score(bad.encode())[0]
    assert all(0 <= r["score"] <= 1 for r in quality_crf.predict(odd, model).collect())
    assert quality_crf.predict(empty(spark), model).count() == 0
    assert {r["score"] for r in quality_crf.predict(odd, quality_crf.fit(rows.where("quality = 7"))).collect()} == {0.5}


@pytest.mark.parametrize("docs", [2000, 40])
def test_crf_learns_from_whole_texts(spark, docs):
    good, bad = "a calm line of plain words here\n", "BUY NOW!! $$$ ### CLICK!! %%%\n"
    rows = spark.createDataFrame([(i, f"{i}\n" + good * 60 + (good if i % 2 else bad) * 60, i % 2) for i in range(40)], "doc_id long, text string, quality int")
    model = quality_crf.fit(rows, docs=docs)
    assert model.score(good.encode() * 5)[0] > 0.5 > 0.2 > model.score(bad.encode() * 5)[0]


def test_language(spark, odd):
    words = {"aa": "kala mika sola tuna", "bb": "grob stark fest hart", "cc": "joli vert rouge bleu"}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(t.split(), 30)), lang) for i, (lang, t) in enumerate(list(words.items()) * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    out = language_id.predict(df, model, keep=["doc_id", "lang"]).collect()
    assert all(r["lang"] == r["lang_pred"] and r["score"] > 0.5 for r in out)
    got = language_id.predict(odd, model, keep=["doc_id", "score"], out=("a", "b", "c")).collect()
    assert [r["a"] for r in got[:3]] == ["und"] * 3 and got[0]["score"] == "clash"
    assert language_id.predict(empty(spark), model).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}
    code = language_id.codewords(30)
    assert (code @ code.T - 1000 * np.eye(30)).max() < code.shape[1]


def test_woven_texts_are_ambiguous(spark):
    """Half of one language, half of another, word by word: flagged; texts of one language, kept from the fit: not."""
    rng = np.random.default_rng(12)
    words = {lang: ["".join(rng.choice(list(letters), int(rng.integers(3, 8)))) for _ in range(80)] for lang, letters in {"aa": "aeikltnr", "bb": "aeostrdg", "cc": "aeioumnp"}.items()}
    draw = lambda lang, n: [str(w) for w in rng.choice(words[lang], n)]
    rows = [(i, " ".join(draw(lang, 40)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 150)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    plain = [(1000 + i, " ".join(draw(lang, 40))) for i, lang in enumerate(["aa", "bb", "cc"] * 50)]
    woven = [(2000 + i, " ".join(w for pair in zip(draw(a, 20), draw(b, 20)) for w in pair)) for i, (a, b) in enumerate([("aa", "bb"), ("bb", "cc"), ("cc", "aa")] * 50)]
    got = language_id.predict(spark.createDataFrame(plain + woven, "doc_id long, text string"), model, keep=["doc_id"]).collect()
    flagged = lambda least: sum(r["ambiguous"] for r in got if least <= r["doc_id"] < least + 1000) / 150
    assert flagged(1000) < 0.05 and flagged(2000) > 0.5
    assert len(set(np.round(model.trust, 6))) > 1 or (model.trust == model.trust[0]).all()


def test_rare_language_is_learnt(spark):
    words = {"aa": "kala mika sola tuna", "bb": "grob stark fest hart", "cc": "joli vert rouge bleu", "dd": "xiq zuq wox yaz"}
    rng = np.random.default_rng(4)
    langs = ["aa", "bb"] * 2000 + ["cc"] * 30 + ["dd"]
    rows = [(None if lang == "cc" else i, " ".join(rng.choice(words[lang].split(), 30)), lang) for i, lang in enumerate(langs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, rows=100)
    assert model.languages == [*words]
    out = language_id.predict(df.where("lang IN ('cc', 'dd')"), model, keep=["lang"]).collect()
    assert len(out) == 31 and all(r["lang"] == r["lang_pred"] for r in out)


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = [x for _, x in ODD] + ["it's  a\ttest, ok? <|endoftext|>\r\nx<|endoftext|>y <|startoftext|> Été\x1c!　x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.tokenise(df, packing.default_tokenizer(), ids=True).collect()
    for i, text in enumerate(texts):
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["piece"])
        ids = np.frombuffer(b"".join(bytes(p["ids"]) for p in own), "<u4").tolist()
        assert ids == t.encode(text or "", add_special_tokens=False).ids + [1]
        assert all(p["ids_crc32"] == zlib.crc32(bytes(p["ids"])) and p["length"] * 4 == len(p["ids"]) for p in own)
        assert [p["start"] for p in own] == [4096 * k for k in range(len(own))]
    packed = packing.pack_documents(odd).collect()
    bins = collections.defaultdict(list)
    for p in packed:
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(empty(spark)).count() == 0


def test_best_fit_is_best_and_bounded():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 100, 2000).tolist()
    placed = list(packing.best_fit(lengths, 100, 20))
    fill, open_bins = {}, {}
    for length, (number, offset) in zip(lengths, placed, strict=True):
        fits = [f for f in open_bins.values() if f >= length]
        if fits:
            assert number in open_bins and open_bins[number] == min(fits)
        else:
            assert number not in fill
        assert offset == fill.get(number, 0)
        fill[number] = offset + length
        open_bins.pop(number, None)
        if fill[number] < 100:
            if len(open_bins) == 20:
                least = min(open_bins.values())  # of the fullest the one that came to that space last
                del open_bins[[k for k in open_bins if open_bins[k] == least][-1]]
            open_bins[number] = 100 - fill[number]
    with pytest.raises(ValueError):
        list(packing.best_fit([101], 100))


def test_alignment():
    a = "x permission is hereby granted free of charge y".split()
    b = "permission is now hereby granted without charge".split()
    pairs = license_scan.align(a, b)
    assert [b[j] for _, j in pairs] == ["permission", "is", "hereby", "granted", "charge"]
    assert pairs == sorted(pairs) and all(a[i] == b[j] for i, j in pairs)
    assert license_scan.align([], b) == license_scan.align(a, []) == []


def test_licenses(spark, odd):
    mit, apache = license_scan.TEMPLATES["MIT-text"], license_scan.TEMPLATES["Apache-2.0"]
    words = mit.split()
    cases = {1: mit, 2: "code " * 500 + mit + " code" * 500, 3: " ".join(w for i, w in enumerate(words) if i % 9), 4: " ".join(words[: len(words) // 2]), 5: f"{apache}\nx\n{apache}", 6: "the License is under a Version of the"}
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert [got[i]["license"] for i in range(1, 7)] == ["MIT-text", "MIT-text", "MIT-text", None, "Apache-2.0", None]
    assert got[2]["start_word"] == 500 and got[5]["n_found"] == 2 and 0.8 <= got[3]["coverage"] < 1
    assert license_scan.scan(odd).where("license IS NULL AND coverage = 0").count() == len(ODD)
    assert license_scan.scan(empty(spark)).count() == 0


def contaminated(docs, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(i, w) for i, t in items for w in decontaminate.windows_of(norm(t))]
    out = []
    for key, t in docs:
        words, hit, found = norm(t), set(), set()
        for i, w in windows:
            for s in range(len(words) - len(w) + 1):
                if tuple(words[s : s + len(w)]) == w:
                    hit |= set(range(s, s + len(w)))
                    found.add(str(i))
        out.append((str(key), len(words), len(hit), len(found)))
    return sorted(out)


@pytest.mark.parametrize("block", [2_000_000, 10])
def test_decontamination(spark, odd, block):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w[:14])), (2, "Short, ÉTÉ item"), (10, " ".join(w[4:16])), (3, ""), (4, None), (5, "x1 x1 x1 x1 x1 x1 x1 x1 x1 x1 x1")]
    docs = [*ODD, (20, " ".join(w)), (21, " ".join(w[:9])), (22, "a SHORT-ÉTÉ!item"), (23, "x1 " * 30), (23, "x1 " * 30), (None, " ".join(w)), (24, "short Été item")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("copy", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(df, bench, block_words=block)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"]) for r in got.collect()) == contaminated(docs, items)
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert not decontaminate.decontaminate(df, bench.limit(0)).where("contaminated").count()


def test_urls(spark):
    rows = [
        (1, "http://A.Example.COM/en/7?x", None), (2, "https://b.com/en/9#y", ""), (3, "ftp://c.net/de/8", ""), (4, "http://example.net/de/81", ""), (5, "http://notcom/en/1", ""),
        (6, None, "<a href='http://b.com/'>"), (7, "no scheme/en/", ""), (8, "http://q.info", '<a href="http://b.com/x">'), (8, "http://q.info", '<a HREF="HTTP://B.com/x">'), (9, "http://com/en/", ""), (10, "http://r.info/", '<a href="/local">'),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "trust", "n")})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got == {
        1: ("a.example.com", "/en/7", "example.com/en/7", "allow"), 2: ("b.com", "/en/9", "com/en/", "block"), 3: ("c.net", "/de/8", "net/de/", "allow"),
        4: ("example.net", "/de/81", "example.net/de/8", "block"), 5: ("notcom", "/en/1", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("q.info", "", None, "block"), 9: ("com", "/en/", "com/en/", "block"), 10: ("r.info", "/", None, "allow"),
    }
    assert url_filter.judge(df.limit(0)).count() == 0


def test_propagation_is_pagerank(spark):
    rng = np.random.default_rng(7)
    n = 8
    links = {(int(a), int(b)): int(rng.integers(1, 4)) for a, b in rng.integers(0, n, (20, 2)) if a != b}
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", k) for (a, b), k in links.items()], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0", 3, 0), ("h1", 1, 2), ("h9", 0, 1)], "host string, good long, bad long")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(edges, seeds, tolerance=1e-5).collect()}
    for col, back, seed in ((0, False, {0: 0.75, 1: 0.25}), (1, True, {1: 2 / 3, 9: 1 / 3})):
        m = np.zeros((10, 10))
        for (a, b), k in links.items():
            m[(a, b) if back else (b, a)] += k
        s = np.array([seed.get(i, 0) for i in range(10)])
        out, r = m.sum(0), s.copy()
        for _ in range(300):
            r = (1 - 0.85 + 0.85 * r[out == 0].sum()) * s + 0.85 * m @ np.divide(r, out, out=np.zeros(10), where=out > 0)
        for host, v in got.items():
            assert v[col] == pytest.approx(r[int(host[1:])], abs=1e-4)


def test_propagation_reaches_far_hosts(spark):
    """A chain of 30 hosts whose last is blocked: all that lead there are distrusted, however far."""
    rows = [(i, f"http://h{i}.info/", f'<a data-href="http://no.info" href="//H{i + 1}.info/x"> <a href=/local>') for i in range(30)] + [(30, "http://a.com/en/1", ""), (31, "http://h30.info/", '<a href="https://a.com/?q">')]
    got = {r["host"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {f"h{i}.info": "block" for i in range(31)} | {"a.com": "block"}


def test_urls_of_odd_pages(spark):
    long = "x" * 200_000 + '<a href="http://a.com/">'
    rows = [(1, "http://l.info", long), (2, "http://a.com/en/", None), (2, "http://a.com/en/", None), (None, None, None)]
    rules = (url_filter.Rule("allow", "info/p"), url_filter.Rule("block", "info/q"), url_filter.Rule("block", "a.com/en"), url_filter.Rule("allow", "com/en/"))
    got = [(str(r["page_id"]), r["verdict"], r["rule"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()]
    assert sorted(got, key=str) == sorted([("1", "block", None), ("2", "block", "a.com/en"), ("2", "block", "a.com/en"), ("None", "allow", None)], key=str)


def quadratic(text, template):
    """Longest common subsequence, the most that any alignment can reach."""
    row = [0] * (len(template) + 1)
    for w in text:
        last = 0
        for j, v in enumerate(template, 1):
            last, row[j] = row[j], last + 1 if v == w else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_against_quadratic():
    """Patience alignment is an ordered matching, never longer than the longest, and as long on texts with few edits."""
    rng = np.random.default_rng(11)
    short = 0
    for name, text in license_scan.TEMPLATES.items():
        template = license_scan.words_of(text)
        for _ in range(4):
            edited = [w if rng.random() > 0.05 else f"e{rng.integers(99)}" for w in template for _ in range(int(rng.random() > 0.03))]
            pairs = license_scan.align(edited, template)
            assert all(edited[i] == template[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False)), name
            most = quadratic(edited, template)
            assert len(pairs) <= most
            short += len(pairs) < 0.95 * most
    assert short <= 6


def test_sibling_licenses(spark):
    cases = {
        "Released under the BSD License.": "BSD", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the Foo License.": None, "This work is licensed under the GNU Affero Public License.": None,
    }
    for name, text in license_scan.TEMPLATES.items():
        cases["before " * 40 + re.sub("[{}]", "", text) + " after" * 40] = name
    header = license_scan.words_of(license_scan.TEMPLATES["GPL-3.0-header"])
    cases[" ".join([*header[:50], *(f"inserted{i}" for i in range(70)), *header[50:]])] = "GPL-3.0-header"  # more than half its length again
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(df).collect()}
    assert got == dict(enumerate(cases.values()))


def test_license_ties(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string")
    r = license_scan.scan(df, {"b": "alpha beta gamma delta", "a": "alpha beta gamma delta", "none": " - "}).first()
    assert (r["license"], r["licenses"], r["coverage"]) == ("a", ["a", "b"], 1.0)


def test_crf_finds_a_junk_line(spark):
    """One junk line in a good document is labelled bad by itself, and its neighbours are not."""
    rng = np.random.default_rng(2)
    calm = lambda: " ".join(["line", "of", "plain", *rng.choice("river stone house garden winter letter market bridge".split(), 5), "words"])
    junk = [lambda: "BUY NOW!! $$$ ### CLICK!! " + str(rng.integers(999)), lambda: f"win{rng.integers(999)} " * 9, lambda: "=== *** ### $$$ %%% " + "*" * int(rng.integers(9))]
    rows = [(i, "\n".join((calm if i % 2 else junk[int(rng.integers(3))])() for _ in range(12)), i % 2) for i in range(200)]
    model = quality_crf.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    for make in junk:
        text = "\n".join([*(calm() for _ in range(4)), make(), *(calm() for _ in range(4))]).encode()
        p = model.marginals((quality_crf.with_neighbours(quality_crf.line_features(text)[0]) @ model.weights).tolist())
        assert p[4] < 0.5 < min(p[:4] + p[5:])


def test_held_out_documents(spark):
    """Language and quality of generated documents that were not learnt from."""
    rng = np.random.default_rng(8)
    words = {"aa": "kala mika sola tuna rati", "bb": "grob stark fest hart wald", "cc": "joli vert rouge bleu noir"}
    rows = []
    for i in range(300):
        lang, good = "abc"[i % 3] * 2, int(rng.random() < 0.7)
        lines = [" ".join(rng.choice(words[lang].split(), 9)) if good or rng.random() < 0.3 else " ".join(rng.choice(["!!!", "###", "$$$", "BUY"], 9)) for _ in range(6)]
        rows.append((i, "\n".join(lines), lang, good))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    known, new = df.where("doc_id < 200"), df.where("doc_id >= 200")
    out = language_id.predict(new, language_id.fit(known), keep=["doc_id", "lang"], out=("p", "s", "a")).collect()
    assert sum(r["p"] == r["lang"] for r in out) >= 0.97 * len(out)
    scores = {r["doc_id"]: r["score"] for r in quality_crf.predict(new, quality_crf.fit(known)).collect()}
    good = [scores[i] for i, _, _, q in rows if q and i >= 200]
    bad = [scores[i] for i, _, _, q in rows if not q and i >= 200]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_no_letter(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["½", "²3", "١٢", "é", "日", "a", "_"])], "doc_id long, text string")
    model = language_id.Model(["x", "y"], language_id.codewords(2), np.zeros((language_id.WIDTH, 1)), np.zeros(1), np.ones(1))
    got = [r["lang_pred"] for r in language_id.predict(df, model, keep=["doc_id"]).orderBy("doc_id").collect()]
    assert got == ["und", "und", "und", "x", "x", "x", "und"]  # of a tie the first language


def test_ablation_of_odd_tables(spark, odd):
    policy = quality_rules.POLICIES["v1"]
    got = {r["rule"]: (r["n_failed"], r["n_only_this"]) for r in quality_rules.ablation(quality_rules.stored_ledger(odd), policy).collect()}
    rows = quality_rules.ledger(odd).collect()
    for i, rule in enumerate(policy.rules):
        assert got[rule] == (sum(r["failed"] >> i & 1 for r in rows), sum((r["failed"] & policy.mask) == 1 << i for r in rows))
    assert quality_rules.ablation(quality_rules.stored_ledger(empty(spark)), policy).count() == 0


def test_closing_bins_on_many_pieces():
    """With real lengths and few open bins the fullest close, and little room is lost."""
    rng = np.random.default_rng(9)
    lengths = np.clip(rng.lognormal(6.3, 1.0, 20_000), 1, 4096).astype(int).tolist()
    held = {}
    for length, (number, offset) in zip(lengths, packing.best_fit(lengths, 4096, 64), strict=True):
        assert offset == held.get(number, 0)
        held[number] = offset + length
    assert max(held.values()) <= 4096 and len(held) <= 1.02 * sum(lengths) / 4096


def test_words_encoded_together():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    words = ["a", "it's", "x<|endoftext|>y", "<|startoftext|>", "é", "e\u0301", "\u0301x", "İstanbul", "ﬁne", "\u200b", "\u3000a", "a\u00a0b", "\t", "½²", "日本語", "🙂🙂x", "\x00a", "\x1cb", "가", "\u1112\u1161", "ẞ", "don't'll", "x" * 5000, ""]
    rng = np.random.default_rng(1)
    words += ["".join(chr(int(c)) for c in rng.choice([*range(33, 0x250), *range(0x300, 0x370), *range(0x1E00, 0x1E20), 0x200D, 0x1F600, 0x0F71], int(rng.integers(1, 9)))) for _ in range(3000)]
    words = [w for w in words if " " not in w and "\n" not in w]
    got = packing._Encoder(packing.default_tokenizer())([w for w in words])
    assert got == [np.array(t.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(50)]
    assert packing._Encoder(packing.default_tokenizer())(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_license_wordings(spark, tmp_path):
    cases = {
        "Licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
        "Licensed under the GNU General Public License, version 3, or the MIT License.": ["GPL-3.0", "MIT"],
        "// SPDX-License-Identifier: MIT": ["MIT"], "# SPDX-License-Identifier: LGPL-2.1-or-later": ["LGPL-2.1"], "see the Apache License 2.0 for more": ["Apache-2.0"],
        "This page is Creative Commons Attribution-ShareAlike 4.0 International": ["CC-BY-SA-4.0"], "Creative Commons Attribution 4.0 International": ["CC-BY-4.0"],
        "the apache in the license of 2 or 0 words": [], "a general public of version 3": [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: sorted(r["licenses"]) for r in license_scan.scan(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    for name, more in license_scan.WORDINGS.items():
        assert name in license_scan.TEMPLATES
        for text in more:
            own = [license_scan.Template(n, t) for n, t in (*license_scan.TEMPLATES.items(), *((k, v) for k, vs in license_scan.WORDINGS.items() for v in vs))]
            assert license_scan.scan_text("foreword " + text + " afterword", own)[0][0] == name
    (tmp_path / "Foo-1.0").write_text("Anyone {may} keep this tide table\nand give it away.")
    own = license_scan.read_templates(spark, str(tmp_path))
    assert own == {"Foo-1.0": "Anyone  may  keep this tide table\nand give it away."}
    found = license_scan.scan(spark.createDataFrame([(1, "Anyone may keep this old tide table and give it away")], "doc_id long, text string"), own).first()
    assert (found["license"], found["coverage"], found["start_word"], found["end_word"]) == ("Foo-1.0", 1.0, 0, 11)
