"""Places where an operator did less than its whole job."""

import random

import numpy as np

from fieldsheet.llm import decontamination, html_extract, language, vptree, warc
from fieldsheet.llm.html_dom import Page

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def leaks(spark, texts, items):
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(x.doc_id, x.item_id): x for x in decontamination.contaminated(d, b).collect()}


GERMAN = "Der Bauer bringt am Morgen seine Kartoffeln mit dem Wagen zum Markt in die Stadt, dort kauft die Köchin der Schule einen Sack für das Essen der Kinder am Mittag."
NAMES = "On Monday the teacher asked Maria, Peter and Johanna to count the books that Robert had brought from London, while Alice sorted those of Susan by size."
SUM = "Tom has 5 apples. Tom buys 3 more. Tom gives half of them to the boy next door. How many apples are left for Tom at the end of the day?"


def test_decontamination_ignores_case_and_line_breaks(spark):
    items = [GERMAN, NAMES, SUM]
    wrapped = lambda t: "".join(c if c != " " or i % 3 else "\n   " for i, c in enumerate(t))
    forms = [f(t) for t in items for f in (str.lower, str.upper, wrapped)]
    other = SUM.replace("Tom", "Anna").replace("5", "7").replace("3", "9")
    got = leaks(spark, [*forms, other, other.replace(". Anna buys", ".\n\nAnna buys"), other.lower().replace("anna", "tom"), "Something Else. With 5 apples. " * 9], items)
    assert set(got) == {(i, i // 3) for i in range(9)} | {(9, 2), (10, 2), (11, 2)}
    assert all(got[i, i // 3].coverage == 1 and not got[i, i // 3].reparameterised for i in range(9)) and got[9, 2].reparameterised


def test_decontamination_judges_the_match_only(spark):
    train = "A train leaves the station at 9 and goes 80 km in 2 hours before it stops. After a break it goes 60 km in 3 hours. How far from the station is it then?"
    lines = "".join(f"\nroute {i}: {7 * i + 3} km in {i + 4} hours" for i in range(40))
    got = leaks(spark, [train, train + lines, train.replace("80", "90").replace("60", "70") + lines, lines], [train])
    assert {k: x.reparameterised for k, x in got.items()} == {(0, 0): False, (1, 0): False, (2, 0): True}


def test_rare_language_shortens_no_other():
    r = random.Random(21)
    words = {k: ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)] for k in ("xx", "yy", "zz")}
    say = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    model = language.Model({k: [say(k, 100) for _ in range(40)] for k in words} | {"aa": ["abc hgf"], "bb": ["d"]})
    test = [(k, say(k, 12)) for k in words for _ in range(40)]
    got = model.predict([t for _, t in test])[0]
    assert np.mean([g == k for g, (k, _) in zip(got, test, strict=True)]) >= 0.95


def test_nearest_with_repeated_rows(spark):
    same, far = [1.0, 2.0], [5.0, 5.0]
    for times in (2, 11):
        rows = [(i, same) for i in range(20) for _ in range(times)] + [(50, far)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = sorted((x.rank, x.vec_id) for x in vptree.nearest(df, query_step=100).collect())
        assert got == [(k, k) for k in range(1, 11)]


def test_standard_warc_fields():
    def record(date, name):
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: {name}\r\nWARC-Target-URI: http://a/\r\nWARC-Date: {date}\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode()

    dates = {"2024-01-01T00:00:00Z": 1704067200, "2024-01-01T01:00:00.5+01:00": 1704067200, "2024-01": 1704067200, "1704067200": 1704067200, "2024-13-01T00:00:00Z": None}
    names = ["<urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>", "<urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb1>", "<http://a/1>", "<http://b/1>", "<urn:x-record:-7>"]
    got = list(warc.parse_warc(b"".join(map(record, dates, names))))
    assert [x["ts"] for x in got] == list(dates.values())
    ids = [x["record_id"] for x in got]
    assert len(set(ids)) == 5 and ids[4] == -7 and all(-(1 << 63) <= i < 1 << 63 for i in ids)


def test_open_head_and_math():
    read = lambda h: " ".join("".join(Page(h).texts).split())
    assert read("<html><head><title>T</title><meta charset=x><style>s</style><article><p>One.</p></article>") == "One."
    assert read("<head><title>T</title>Bare text<p> two") == "Bare text two"
    assert read("<head><title>T</title><template>no</template></head><body><p>a") == "a"
    p = Page("<p>so <math><mi>x</mi><mo>=</mo><mspace/><mn>2</mn><annotation>tex</annotation></math> holds")
    assert "".join(p.texts) == "so x=2 holds" and len(set(p.text_block)) == 1
    page = "<html><head><title>T</title><article><p>" + "A long sentence, of the article itself. " * 20 + "</p></article>"
    assert html_extract.extract([page], html_extract.model())[0].startswith("A long sentence")


def test_decontamination_probes(spark):
    apples = "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have?"
    items = [apples, "How old is Anna", "one two", "the red fox"]
    mia = apples.replace("Tom", "Mia").replace("5", "9").replace("3", "4")
    got = leaks(spark, [mia, "He asked her: how old is Anna? She knew.", "so one two three", "One, two!", "how old is the red fox then", "how old are they"], items)
    assert set(got) == {(0, 0), (1, 1), (3, 2), (4, 3)} and got[0, 0].reparameterised and not got[1, 1].reparameterised
    # Rows with a null id are one document, with placeholders or without.
    d = spark.createDataFrame([(None, mia, None, None, 1), (None, "x", None, None, 1)], DOC)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert [(x.doc_id, x.item_id) for x in decontamination.contaminated(d, b).collect()] == [(None, 0)]


def test_many_scripts_and_rare_labels():
    r = random.Random(22)
    first = {"zh": 0x4E00, "ja": 0x5200, "ko": 0xAC00, "hi": 0x0904, "xx": 0x10400, "en": 97}
    words = {k: ["".join(chr(c + r.randrange(26 if k == "en" else 38)) for _ in range(r.randint(2, 5))) for _ in range(200)] for k, c in first.items()}
    say = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    model = language.Model({k: [say(k, 80) for _ in range(20)] for k in words} | {"rare": ["ok"], "odd": [chr(0x1F600) * 3]})
    test = [(k, say(k, 20)) for k in words for _ in range(20)]
    got, score = model.predict([t for _, t in test])
    assert np.mean([g == k for g, (k, _) in zip(got, test, strict=True)]) >= 0.98 and min(score) >= 0
    units = language.encode("\u4e00\u4e01 \u4e00", model.symbols)
    assert len({units[i : i + 4].tobytes() for i in (0, 4)}) == 2 or len(units) < 12


def test_broken_markup():
    read = lambda h: " ".join("".join(Page(h).texts).split())
    assert read("<p title=it's>Hello world. It's fine</p>") == "Hello world. It's fine"
    assert read("<p><a href=foo?x=\"y>one</a> two") == "one two"
    assert read("<p a='>' b=\">\" c>one <b x='unclosed> two") == "one"
    assert read("<p>a <xmp><b>&amp;</b></xmp> c <object>d</object> 1 < 2") == "a <b>&amp;</b> c d 1 < 2"
    for bad in ('<a "', '<a ="', "<a x='", "<!--", "<a =", "<script>"):
        Page(bad * 60_000)
    text = "A long sentence, of the article itself. " * 20
    assert html_extract.extract([f"<body><article data-keep=yes><p>{text}</p></article>"], html_extract.model()) == [text.strip()]


def test_damaged_warc():
    import gzip

    def record(n, length):
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-record:{n}>\r\nWARC-Target-URI: http://a/\r\n{length}\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\n".encode()

    good = "Content-Length: 31"
    data = b"".join(record(n, x) for n, x in enumerate((good, "Content-Length: x", "Content-Length: -5", "X: y", good)))
    assert [(x["record_id"], x["payload"].strip()) for x in warc.parse_warc(data)] == [(n, "body") for n in range(5)]
    zipped = b"".join(gzip.compress(record(n, good)) for n in range(3))
    assert [x["record_id"] for x in warc.parse_warc(zipped)] == [0, 1, 2]
    assert [x["record_id"] for x in warc.parse_warc(zipped[:-30])][:2] == [0, 1]
