import hashlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from fairline.llm.bwt import repeated_starts
from fairline.llm.line_dedup import remove_repeated_runs
from fairline.llm.minhash import near_duplicates, signatures
from fairline.llm.repeats import remove_repeats
from llm.fixtures import BASE, LOWER, SCHEMA, TEXTS, WORD, documents


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def model_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                label[max(root(a), root(b))] = min(root(a), root(b))
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[root(i)].append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return Counter((d, len(sets[i]), least[root(i)] if sets[i] else d, (least[root(i)] if sets[i] else d) == d) for i, (d, _) in enumerate(rows))


def found_components(df):
    return Counter((r["row"]["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_near_duplicates_agree_with_all_pairs(spark):
    noisy = [(100 + i, " ".join(w if (i * 7 + j * 13) % (6 + i) else f"n{i}x{j}" for j, w in enumerate(BASE.split()))) for i in range(20)]
    rows = TEXTS + noisy
    for k, percent in ((3, 85), (5, 80)):
        assert found_components(near_duplicates(documents(spark, rows), words=k, percent=percent)) == model_components(rows, k, percent)


def test_near_duplicates_of_empty_and_single_tables(spark):
    assert near_duplicates(documents(spark, [])).collect() == []
    assert found_components(near_duplicates(documents(spark, [(3, "a b c")]))) == Counter([(3, 1, 3, True)])


def test_signature_coordinates_estimate_similarity():
    values = np.random.RandomState(0).randint(0, 1 << 62, 3000).astype(np.uint64)
    a, b = signatures([np.sort(values[:2000]), np.sort(values[1000:])], 400)
    assert abs((a == b).mean() - 1 / 3) < 0.08


def model_runs(rows, window):
    """Texts after deletion of later runs: windows of full lines that equal an earlier window."""
    order = sorted({(d is not None, d or 0, t) for d, t in rows if t is not None})
    seen, out = set(), {}
    for has, d, t in order:
        lines = t.split("\n")
        full = [i for i, line in enumerate(lines) if WORD.search(line)]
        gone = set()
        for s in range(len(full) - window + 1):
            at = full[s : s + window]
            key = tuple(lines[i] for i in at)
            if key in seen:
                gone |= set(at)
            seen.add(key)
        out[(d if has else None, t)] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return Counter((d, *(out[(d, t)] if t is not None else (None, 0, 0))) for d, t in rows)


def test_line_runs_agree_with_the_model(spark):
    for window in (1, 2, 3):
        got = remove_repeated_runs(documents(spark), window=window).collect()
        assert Counter((r["row"]["doc_id"], r["kept_text"], r["n_lines"], r["n_removed"]) for r in got) == model_runs(TEXTS, window)
        assert got[0]["row"]["k1"] == "k"
    assert remove_repeated_runs(documents(spark, [])).collect() == []


def model_long_lines(rows, long_words):
    """Texts after deletion of later runs of two lines and later single lines of ``long_words`` words."""
    seen, out = set(), {}
    for has, d, t in sorted({(d is not None, d or 0, t) for d, t in rows if t is not None}):
        lines = t.split("\n")
        full = [i for i, line in enumerate(lines) if WORD.search(line)]
        windows = [full[s : s + 2] for s in range(len(full) - 1)] + [[i] for i in full if len(WORD.findall(lines[i])) >= long_words]
        gone = set()
        for at in sorted(windows):
            key = tuple(lines[i] for i in at)
            if key in seen:
                gone |= set(at)
            seen.add(key)
        out[(d if has else None, t)] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return Counter((d, *(out[(d, t)] if t is not None else (None, 0, 0))) for d, t in rows)


def test_single_long_lines_agree_with_the_model(spark):
    line = " ".join(f"w{i}" for i in range(50))
    less, spaced = line.rsplit(" ", 1)[0], "\t " + line.replace(" ", " \x0b\r ") + "  "
    rows = TEXTS + [
        (70, f"own start\n{line}\nown end"), (71, f"other start\n{line}\nother end"), (72, line), (72, line), (73, f"{line}\n{line}"), (None, line),
        (74, f"a\n{less}\nb"), (75, f"c\n{less}\nd"), (76, f"e\n{spaced}\nf"), (77, f"g\n{spaced}\nh"), (78, "x" * 100_000), (79, "y\n" + "x" * 100_000),
    ]
    got = remove_repeated_runs(documents(spark, rows), window=2, long_words=50).collect()
    found = Counter((r["row"]["doc_id"], r["kept_text"], r["n_lines"], r["n_removed"]) for r in got)
    assert found == model_long_lines(rows, 50)
    assert found[(71, "other start\nother end", 3, 1)] == 1 and found[(72, "", 1, 1)] == 2 and found[(75, f"c\n{less}\nd", 3, 0)] == 1 and found[(77, "g\nh", 3, 1)] == 1
    docs = documents(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").where("doc_id >= 70").collect()}
    assert left[71] == "other start\nother end" and 72 not in left and 73 not in left and left[79] == "y\n" + "x" * 100_000


def model_repeats(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = Counter()
    for d, b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if counts[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[(d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())] += 1
    return out


def test_repeats_agree_with_counting(spark):
    rows = [(d, t if t is None else t[:4000]) for d, t in TEXTS] + [(20, "a" * 700), (21, "ab" * 150), (22, "Ü" * 99 + "b"), (23, BASE[40:300] + "é" * 30 + BASE[100:420])]
    for hot in (1 << 20, 500):
        got = remove_repeats(documents(spark, rows), length=200, hot_bytes=hot, digests=True).collect()
        assert Counter(tuple(r[c] for c in ("id", "n_bytes", "n_removed", "n_spans", "kept")) for r in got) == model_repeats(rows, 200)
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=40), min_size=1, max_size=6), st.integers(1, 4))
def test_merged_transforms_find_all_repeats(texts, shards):
    data = np.frombuffer(b"".join(t.encode() + b"\0" for t in texts), np.uint8)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = Counter(t[i : i + 6] for t in texts for i in range(len(t) - 5))
    expected = [i + 6 <= len(t) and counts[t[i : i + 6]] > 1 for t in texts for i in range(len(t) + 1)]
    assert repeated_starts(data, offsets, 6, 2, shards).tolist() == expected
