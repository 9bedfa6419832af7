"""Cases that earlier forms of op1, op5, op6 and op9 had wrong."""

from collections import Counter

import numpy as np

from epiframe.llm import html_text, language_id, license_digest, quality
from tests.llm.test_operators import documents, prose


def pages(spark, rows):
    return spark.createDataFrame([(i, f"u{i}", h, "x", 1) for i, h in enumerate(rows)], "page_id long, url string, html string, _text string, text int")


def texts(spark, rows):
    return [r._text for r in html_text.extract(pages(spark, rows)).orderBy("page_id").collect()]


def test_an_article_that_is_all_links_is_kept(spark):
    link = "<a href=x>All text is link.</a>"
    got = texts(spark, [f"<article><p>{link}</p><p>{link}</p></article>", f"<nav>{link}</nav><main><div><p>{link}</p></div></main>", f"<body><div>{link}</div></body>", f"<article><p>{link}</p></article>"])
    assert got == ["All text is link. All text is link.", "All text is link.", "", "All text is link."]


def test_a_page_of_a_megabyte_and_repeated_rows(spark):
    body = [f"Sentence {i}, which is long enough to be read." for i in range(20_000)]
    page = "<html><body><nav><a href=x>Menu</a></nav><article>" + "".join(f"<p>{x}</p>" for x in body) + "</article></body></html>"
    assert len(page) > 1_000_000
    assert texts(spark, [page, None, "", page]) == [" ".join(body), "", "", " ".join(body)]


def test_statements_of_a_licence_are_no_licence(spark):
    rows = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", dict(license_digest.LICENSES)["ISC"]]
    got = license_digest.scan(documents(spark, list(enumerate(rows)))).orderBy("doc_id").collect()
    assert [r._license for r in got] == [None, None, "ISC"]


def test_many_languages_and_empty_tables(spark):
    rng = np.random.default_rng(6)
    letters = [chr(0x3B1 + i) for i in range(24)] + [chr(0x430 + i) for i in range(32)] + [chr(0x5D0 + i) for i in range(22)]
    of = {f"l{n:02}": letters[n] + letters[n - 1] for n in range(60)}
    text = lambda pair: " ".join("".join(rng.choice(list(pair), 5)) for _ in range(20))
    rows = [(i, text(of[lang]), lang) for i, lang in enumerate(sorted(of) * 8)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 60 and model.landmarks.shape[1] <= 60 * max(language_id.FEWEST, language_id.LANDMARKS // 60)
    new = spark.createDataFrame([(i, text(of[lang]), lang) for i, lang in enumerate(sorted(of))] * 2, "doc_id long, text string, want string")
    got = language_id.predict(new, model).collect()
    assert len(got) == 120 and sum(r._lang == r.want for r in got) >= 114
    assert max(Counter((r.doc_id, r._lang, r._score) for r in got).values()) >= 2
    assert language_id.predict(new.limit(0), model).count() == 0


def test_training_texts_are_bounded_in_sum(spark, monkeypatch):
    import random

    rng = random.Random(9)
    rows = [(i, prose(rng, 50)) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "Model", lambda texts, y: seen.append((len(texts), Counter(y.tolist()))))
    quality.train(documents(spark, rows), labels)
    monkeypatch.setattr(quality, "LABEL_BYTES", 4000)
    quality.train(documents(spark, rows), labels)
    assert seen[0][0] > 150 and 20 <= seen[1][0] <= 60 and set(seen[1][1]) == {0, 1}
