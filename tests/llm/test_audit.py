import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pandas as pd
from pyspark.sql import functions as F

from fairline.llm.interaction import counters, filter_interactions, update
from llm.fixtures import TEXTS, WORD

SCHEMA = "doc_id long, text string, lang string, source string, part string, mask int, key int, id string, n int, good int"
LABELS = "doc_id long, quality int, toxic int, part string"


def model(rows, labels):
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = ({d for d, *x in labels if x[i] == 1} for i in (0, 1))
    docs = defaultdict(list)
    for d, t, lang in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t],
        }
        docs[lang or ""].append(({f for f, x in fails.items() if x}, d in good and d is not None, d in toxic and d is not None))
    out, shapley = {}, Counter()
    for part, held in docs.items():
        for order in permutations("ABCDE"):
            left = list(held)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                redundant = sum(f in x[0] for x in held) - len(gone)
                left = [x for x in left if f not in x[0]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x[0] == {f} for x in held), sum(x[1] for x in gone), sum(x[2] for x in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def cases():
    r = random.Random(4)
    word = lambda: r.choice(["alpha", "Beta", "gamma", "DELTA", "eps#", "zeta|"]) + str(r.randint(0, 90))
    texts = [" ".join(word() for _ in range(r.choice([5, 150, 250, 300]))) for _ in range(25)] + ["the same word " * 100, "\x0bA\x1cB", "", "#"]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(240)]
    rows += [(d, t, "fr") for d, t in TEXTS] + [(300, "twice", "en"), (300, "twice", "de"), (299, "twice", None), (301, "twice", "en"), (None, "twice", "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 310, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return rows, labels


def written(spark, tmp_path, rows, files):
    """The rows over several files, the largest ids first, so that smaller ones come later and retract them."""
    rows = sorted(rows, key=lambda x: -(x[0] if x[0] is not None else 10**9))
    for n in range(files):
        part = [(d, t, lang, "s", "p", 1, 2, "i", 3, 4) for d, t, lang in rows[n * len(rows) // files : (n + 1) * len(rows) // files]]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path / "documents.parquet")


def test_audit_agrees_with_applying_every_order(spark, tmp_path):
    rows, labels = cases()
    path = written(spark, tmp_path, rows, 4)
    facts = spark.createDataFrame([(*x, "p") for x in labels], LABELS)
    found = filter_interactions(spark, path, facts, batches=4)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found.collect()} == model(rows, labels)
    once = counters(spark, path, facts, batches=1)
    many = counters(spark, path, facts, batches=4)
    key = ["part", "mask", "good", "toxic", "n"]
    assert Counter(map(tuple, once.select(*key).collect())) == Counter(map(tuple, many.select(*key).collect()))


def test_empty_table_and_single_file(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(path)
    assert filter_interactions(spark, path, spark.createDataFrame([], LABELS)).collect() == []
    one = str(tmp_path / "one.parquet")
    pd.DataFrame({"doc_id": [2, 1], "text": ["a", "a"], "lang": ["en", "en"]}).to_parquet(one)
    found = filter_interactions(spark, one, spark.createDataFrame([], LABELS)).where(F.col("filter_order") == "EABCD").orderBy("step").collect()
    assert [(r["kept"], r["removed"], r["redundant"]) for r in found] == [(1, 1, 0), (0, 1, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_a_smaller_id_retracts_the_earlier_one():
    rows = lambda *x: pd.DataFrame([(k.encode(), i, p, m, g, False, n) for k, i, p, m, g, n in x], columns=["key", "id", "part", "mask", "good", "toxic", "n"])
    state, first = update(None, rows(("t", 9, "en", 1, True, 2), ("u", 5, "en", 0, False, 1)))
    state, second = update(state, rows(("t", 4, "de", 1, False, 1), ("u", 7, "de", 0, False, 1)))
    added = lambda d: {k: v for k, v in d.groupby(["part", "mask", "good"])["n"].sum().to_dict().items() if v}
    assert added(first) == {("en", 1, True): 2, ("en", 17, True): -2, ("en", 0, False): 1, ("en", 16, False): -1}
    assert added(second) == {("en", 1, True): -2, ("en", 17, True): 2, ("de", 1, False): 1, ("de", 17, False): -1}
    assert sorted(zip(state["key"], state["id"], strict=True)) == [(b"t", 4), (b"u", 5)]
