import random
from collections import Counter

from lattica.llm import licenses


def test_stretches_agree_with_every_window():
    rng = random.Random(14)
    short = {name: [t for t in texts if len(t.split()) < 34] for name, texts in licenses.TEMPLATES.items()}
    matcher = licenses.Matcher(short, 0.8)
    notices = [(name, k, licenses.bigrams(licenses.words(t))) for name, texts in sorted(short.items()) for k, t in enumerate(texts)]
    texts = [t for texts in short.values() for t in texts]
    matched = 0
    for _ in range(60):
        ws = []
        for _ in range(3):
            part = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 4)):
                part[rng.randrange(len(part))] = rng.choice(["other", "MIT", "the", "--"])
            ws += ["filler", "of", "the"][: rng.randrange(4)] + part
        ws = licenses.words(" ".join(ws))
        found = matcher.matches(ws)
        windows = []
        for name, k, grams in notices:
            n = sum(grams.values())
            for a in range(len(ws)):
                for b in range(a + 2, min(len(ws), a + 2 * n + 2) + 1):
                    value = licenses.dice(licenses.bigrams(ws[a:b]), grams)
                    if value >= 0.8 - 1e-12:
                        windows.append((value, name, k, a, b))
        for name, k, a, b, value in found:
            assert any((name, k, a, b) == w[1:] and abs(w[0] - value) < 1e-12 for w in windows)
        assert all(any(a < y and x < b for _, _, x, y, _ in found) for *_, a, b in windows)  # nothing is lost
        assert not found or abs(found[0][4] - max(w[0] for w in windows)) < 1e-12
        for i, (*_, a, b, _) in enumerate(found):
            assert all(y <= a or b <= x for *_, x, y, _ in found[:i])
        matched += len(found)
    assert matched > 60 and licenses.bigrams([]) == Counter() and licenses.dice(Counter(), Counter()) == 0.0


def test_each_template_is_its_own_best_match():
    matcher = licenses.Matcher(licenses.TEMPLATES, 0.8)
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            found = matcher.scan(f"before, {text.upper()} after")
            assert found[0][4] == 1.0 and found[0][0] == name, (name, text, found)


def test_notices_inside_long_lines_and_files():
    matcher = licenses.Matcher(licenses.TEMPLATES, 0.8)
    bsd = licenses.TEMPLATES["BSD-3-Clause"][0]
    for gap in ("\n" + "-" * 400 + "\n", " " * 9_000, "- " * 5_000, "\n\n"):  # layout does not count
        text = gap.join(bsd.split("\n"))
        for around in (text, "word " * 3_000 + text + " word" * 3_000):
            found = matcher.scan(around)
            assert [f[0] for f in found] == ["BSD-3-Clause"] and found[0][4] == 1.0
    one = "Foo tool. Released under the MIT License. See docs"
    assert [(f[0], one[f[2] : f[3]]) for f in matcher.scan(one)] == [("MIT", "Released under the MIT License")]
    assert [f[0] for f in matcher.scan(" ".join([bsd, "word"] * 40))] == ["BSD-3-Clause"] * 40
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
        assert [f[0] for f in matcher.scan(licenses.TEMPLATES[name][3])] == [name]


def test_passages_of_documents(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    lines = "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70))
    texts = ["Some prose.\nReleased under the MIT License.", "é\n" + lines + "\n\nfiller\n", "released UNDER the mit license", "All rights reserved.\nLicensed under CC BY-NC 4.0.", "nothing", None, "", "word " * 50_000 + "\nAll rights reserved.", "\n\n"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, license string")
    rows = {r.id: r for r in licenses.scan(docs).collect()}
    assert [rows[i].license for i in range(9)] == ["MIT", "MIT", "MIT", "CC-BY-NC-4.0", None, None, None, "Proprietary", None]
    assert rows[3].licenses == ["CC-BY-NC-4.0", "Proprietary"]
    p = rows[0].passages[0]
    assert texts[0][p.start : p.end] == "Released under the MIT License"
    p = rows[7].passages[-1]
    assert texts[7][p.start : p.end] == "All rights reserved"


def test_odd_documents(odd_docs, no_docs):
    assert licenses.scan(odd_docs).filter("license is null and size(passages) = 0").count() == 10
    assert licenses.scan(no_docs).count() == 0
