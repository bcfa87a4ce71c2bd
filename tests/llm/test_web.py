import base64
import gzip
import hashlib
import re
from collections import Counter

from pyarrow import fs

from fairline.llm import warc
from fairline.llm.decontaminate import find_items, remove_contaminated
from fairline.llm.queries_web import RULES
from fairline.llm.url_rules import judge
from fairline.session import shared_folder
from llm.fixtures import TEXTS, documents

URLS = [
    None, "", "no scheme", "http://WWW.Example.com/en/1?x#y", "https://example.com/en", "ftp://a.b.net/es/", "http://net/fr/x", "://com", "http://xcom/",
    "http://example.com?/en/", "http://www.example.com/en/en/", "http://evil-example.com/en/", "http://com/a", "http://É.COM/", "x://a//b://c.net/es/",
]


def model_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS + URLS[3:5])], "page_id long, url string, host string, n int")
    more = [("com", "/", "block"), ("example.com", "/e", "block"), ("net", "", "allow"), ("b.net", "/es", "block")]
    for rules in (RULES, RULES + more):
        got = judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
        assert Counter((r["row"]["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == Counter((u, *model_verdict(u, rules)) for u in URLS + URLS[3:5])
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in judge(pages, none).collect()} == {"allow"} and judge(pages.limit(0), none).collect() == []


def test_warc_round_trip(spark):
    html = [(5, "u:a b\n", "<p>é</p>"), (3, None, "<p>é</p>"), (4, "u", None), (1, "u", ""), (None, "u", "<p>é</p>"), (9, "u", "z" * 300_000), (None, "u", "lone"), (2, "u", "a\r\n\r\nb"), (2, "u", "a\r\n\r\nb")]
    pages = spark.createDataFrame([(*r, "x") for r in html], "page_id long, url string, html string, payload string")
    got = warc.archive(pages).collect()
    first = {}
    for i, _, h in html:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    expected = Counter()
    for i, _, h in html:
        data = (h or "").encode()
        lead = first.get(h or "")
        revisit = lead is not None and i != lead
        expected[(None if i is None else str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", str(lead) if revisit else None)] += 1
    assert Counter((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected
    assert {r["payload"].decode() for r in got if r["record_type"] == "response"} == {h or "" for _, _, h in html}
    assert Counter(r["record_type"] for r in warc.archive(pages, min_bytes=1 << 20).collect()) == {"response": len(html)}
    assert warc.archive(pages.limit(0)).collect() == []


def test_members_and_sidecar_index(spark):
    folder = f"{shared_folder(spark)}/members-test"
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i}" * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(warc.records(pages), folder)
    store, path = fs.FileSystem.from_uri(folder)
    index = warc.normalise(files, folder).collect()
    assert len(index) == 40
    for name in {r["file"] for r in index}:
        data = store.open_input_file(f"{path}/{name}").read()
        lines = store.open_input_file(f"{path}/{name}.idx").read().decode().splitlines()
        assert sorted((int(x.split()[0]), int(x.split()[1])) for x in lines) == sorted((r["offset"], r["length"]) for r in index if r["file"] == name)
        for line in lines:
            offset, length, record = line.split()
            member = gzip.decompress(data[int(offset) : int(offset) + int(length)])
            assert member.startswith(b"WARC/1.1\r\n") and record.encode() in member and member.endswith(b"\r\n\r\n")
    again = warc.normalise(spark.createDataFrame([(r["file"],) for r in index[:1]], "file string"), folder)
    assert again.count() == sum(r["file"] == index[0]["file"] for r in index)


ITEMS = [
    (1, "A train leaves at 9 and runs 120 km to Paris while another runs 80 km to Paris before it stops for the night."),
    (2, "Too short for windows."),
    (3, None),
    (None, "the quick brown fox jumps over the lazy dog and then sleeps all day long"),
    (5, "5 6 7 8 9 10 11 12 13 14 15 16"),
]


def test_items_are_found_with_other_slots(spark):
    texts = TEXTS + [
        (60, "Intro words. " + ITEMS[0][1].upper() + " !!"),
        (61, ITEMS[0][1].replace("120", "300").replace("80", "75").replace("Paris", "Rome")),
        (62, ITEMS[0][1].replace("to Paris while", "to Rome while")),
        (63, "x " + ITEMS[3][1].replace(" ", "  \n") + " y"),
        (64, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"),
        (65, "the quick brown fox jumps over the lazy cat"),
    ]
    docs, items = documents(spark, texts), spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, id string")
    got = {(r["id"], r["item"]): r for r in find_items(docs, items).collect()}
    assert set(got) == {(61, 1), (63, None)} | ({(60, 1)} if (60, 1) in got else set())
    assert got[(61, 1)]["reparameterised"] and not got[(63, None)]["reparameterised"]
    left = remove_contaminated(docs, items).collect()
    assert Counter(r["doc_id"] for r in left) == Counter(d for d, _ in texts if d not in {d for d, _ in got})
    assert remove_contaminated(docs.limit(0), items).collect() == [] and remove_contaminated(docs, items.limit(0)).count() == len(texts)


SHORT = [
    (10, "Compute 12 + 7 * 3 - 5 with 8 and 9"), (11, "Name the largest moon."), (12, "Wer schrieb Faust?"), (None, "1 2 3 4 5 6 7 8 9 10 11 12"), (13, "?!"), (14, None),
    (15, "Osmium"), (16, "the quick brown fox jumps over the lazy dog and then sleeps"), (11, "Which of Rome, Paris, London, Madrid, Berlin, Vienna, Lisbon, Athens is it"),
]


def raw_words(text):
    return re.sub(r"(\d+)", r" \1 ", re.sub(r"[^\w\x20\x09-\x0D]+|_", "", (text or "").lower())).split()


def test_items_without_template_windows_are_found_word_for_word(spark):
    texts = TEXTS + [
        (80, "First: compute 12 7 3 5\nwith 8, and 9. Then rest."), (81, "Compute 13 + 7 * 3 - 5 with 8 and 9"), (82, "Compute 12 + 7 * 3 - 5 with 8 or 9"),
        (83, "please NAME THE largest, Moon"), (84, "name the largest red moon"), (85, "Und wer schrieb Faust"), (86, "0 1 2 3 4 5 6 7 8 9 10 11 12 13"),
        (87, "1 2 3 4 5 6 7 8 9 10 11 5 6 7 8 9 10 11 12"), (88, "osmium and osmium"), (88, "osmium and osmium"), (89, "osmiums"), (90, "so which of rome paris london madrid berlin vienna lisbon athens is it"),
        (91, "which of rome paris london madrid berlin vienna lisbon athens"), (None, "Osmium"),
    ]
    docs, items = documents(spark, texts), spark.createDataFrame([(*i, "x") for i in SHORT], "item_id long, text string, id string")
    got = Counter((r["id"], r["item"], r["n_windows"], r["n_matched"], r["reparameterised"]) for r in find_items(docs, items).where("item is null or item <> 16").collect())
    wanted = Counter()
    for d, t in {x for x in texts if x[1] is not None}:
        words = raw_words(t)
        for i, item in SHORT:
            of = raw_words(item)
            if of and i != 16 and any(words[s : s + len(of)] == of for s in range(len(words))):
                wanted[(d, i, max(1, len(of) - 7), max(1, len(of) - 7), False)] += 1
    assert got == wanted and {(d, i) for d, i, *_ in got} == {(80, 10), (83, 11), (85, 12), (86, None), (88, 15), (90, 11), (None, 15)}
    left = remove_contaminated(docs, items).collect()
    assert {r["doc_id"] for r in left} & set(range(80, 92)) == {81, 82, 84, 87, 89, 91}
