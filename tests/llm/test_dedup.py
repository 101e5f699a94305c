"""Line dedup, near-duplicate documents and fingerprints against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import corpus_pipeline
from pyspark.sql import functions as F

from spanmill.llm import line_dedup
from spanmill.llm.common import text_bytes
from spanmill.llm.components import components
from spanmill.llm.fingerprints import edited_fingerprints, fingerprint_of, fingerprints, merged
from spanmill.llm.line_dedup import count_names, dedup_lines
from spanmill.llm.near_dedup import (
    REGISTERS, _may_be_similar, bitmaps, drop_near_duplicates, near_duplicates, probability_jaccard, signatures, weighted_shingles,
)
from spanmill.llm.queries import QUERIES
from spanmill.llm.secret_scan import mask_secrets


def one_word_apart(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    least = min(len(a), len(b))
    front = next((k for k in range(least) if a[k] != b[k]), least)
    back = next((k for k in range(least) if a[-1 - k] != b[-1 - k]), least)
    return front + back >= (least - 1 if len(a) == len(b) else least)


def brute_lines(docs):
    """{doc_id: (text, repeated, near)} for documents with distinct ids."""
    distinct, near = {}, set()
    for _, text in sorted(docs):
        for line in text.split("\n"):
            own = line.strip(" ")
            words = own.split(" ")
            if len(words) < line_dedup.LEAST_WORDS or own in distinct:
                continue
            if len(words) >= line_dedup.LEAST_NEAR_WORDS and any(
                len(other) >= line_dedup.LEAST_NEAR_WORDS and one_word_apart(other, words) for other in distinct.values()
            ):
                near.add(own)
            distinct[own] = words
    out, seen = {}, set()
    for doc_id, text in sorted(docs):
        kept, repeated, close = [], 0, 0
        for line in text.split("\n"):
            own = line.strip(" ")
            if own in seen:
                repeated += 1
            elif own in near:
                close += 1
            else:
                kept.append(line)
            if own in distinct:
                seen.add(own)
        out[doc_id] = ("\n".join(kept), repeated, close)
    return out


def line_rows(df):
    return {r.doc_id: (r.text, r.n_repeated, r.n_near) for r in df.collect()}


def test_lines_of_the_corpus(spark, sf, corpus):
    assert line_rows(QUERIES["op4_line_dedup"](spark, sf)) == brute_lines(corpus)


@pytest.mark.parametrize("long_line, broadcast", [(2048, 10**6), (9, 0)])
def test_random_lines(make_docs, monkeypatch, long_line, broadcast):
    monkeypatch.setattr(line_dedup, "LONG_LINE_WORDS", long_line)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast)
    draw = random.Random(3)
    base = [[draw.choice("abcd") + str(draw.randint(0, 3)) for _ in range(draw.randint(7, 12))] for _ in range(12)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(draw.randint(1, 5)):
            words = list(draw.choice(base))
            for _ in range(draw.randint(0, 2)):
                at = draw.randrange(len(words))
                change = draw.randrange(3)
                words[at : at + 1] = [[], [words[at], "new"], [draw.choice("xyz")]][change]
            lines.append(" ".join(words))
        texts.append("\n".join([*lines, "Of.", ""]))
    assert line_rows(dedup_lines(make_docs(texts))) == brute_lines(list(enumerate(texts)))


def test_odd_lines(make_docs):
    line = "one two three four five six seven eight nine"
    texts = [line, None, "", f"{line}\n{line} ten\nOf.\nOf.", line, "x " * 5000]
    docs = make_docs(texts, [3, 1, 2, 5, None, 6])
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_repeated", "n_near"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[None].text == line and rows[3].text == "" and rows[3].n_repeated == 1
    assert rows[5].text == "Of.\nOf." and (rows[5].n_repeated, rows[5].n_near) == (1, 1)
    assert rows[1].text is None and rows[1].n_lines == 0 and rows[2].text == "" and rows[2].n_lines == 1
    assert rows[6].text == "x " * 5000 and rows[6].label == "extra" and rows[6].words == ["x"]
    twice = dedup_lines(make_docs([line, line], [1, 1])).collect()
    assert [r.text for r in twice] == [line, line]
    assert dedup_lines(make_docs([])).count() == 0


def test_many_lines_and_taken_names(make_docs):
    long = "\n".join(["an equal line of words"] * 20_000 + [f"line {k} of its own kind" for k in range(3)])
    docs = make_docs([long, long + "\nlast one here"]).withColumn("n_lines", F.lit("mine")).withColumn("N_near", F.lit(1)).withColumn("a.b", F.lit(2))
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines_1", "n_repeated", "n_near_1"] and count_names(["n_lines", "n_lines_1"])[0] == "n_lines_2"
    rows = sorted(got.collect(), key=lambda r: r.doc_id)
    assert rows[0].text == "an equal line of words\nline 0 of its own kind"
    assert [(r.n_lines_1, r.n_repeated, r["a.b"]) for r in rows] == [(20_003, 19_999, 2), (20_004, 20_003, 2)]
    assert rows[1].text == "last one here" and {r.n_lines for r in rows} == {"mine"}
    cleaned = corpus_pipeline.fresh_lines(None, docs, "")
    assert cleaned.columns == docs.columns and cleaned.count() == 2
    assert drop_near_duplicates(docs).columns == docs.columns
    masked = mask_secrets(docs.withColumn("text", F.lit("token: abcdefghijklmnop1")))
    assert masked.columns == docs.columns and {(r.text, r["a.b"]) for r in masked.collect()} == {("[SECRET]", 2)}


def test_short_lines(make_docs):
    texts = [
        "Stteen Erachtz.\n\nOf.\none two three\na b c d e",
        "Stteen Erachtz.\n\nOf.\none two four\na b x d e\nk l m n o p q r",
        "Stteen  Erachtz.\n \nOf.\na b c d\nk l m n o q r\n Stteen Erachtz. ",
    ]
    want = [
        (texts[0], 0, 0),
        ("\nOf.\none two four\nk l m n o p q r", 1, 1),
        ("Stteen  Erachtz.\n \nOf.\na b c d", 1, 1),
    ]
    assert line_rows(dedup_lines(make_docs(texts))) == dict(enumerate(want))
    # Down to single words: blank lines stay.
    every = line_rows(dedup_lines(make_docs(texts), least_words=1))
    assert every == {k: (t.replace("\nOf.", "") if k else t, r + (k > 0), n) for k, (t, r, n) in enumerate(want)}


def shingles(text):
    words = text.split()
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def jaccard_p(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in set(a) & set(b))


def brute_classes(docs, least=0.8):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, own in enumerate(sets):
        for s in own:
            holders[s].append(k)
    pairs = {(a, b) for own in holders.values() for a in own for b in own if a < b}
    for a, b in pairs:
        if sets[a] == sets[b] or (2 * len(sets[a]) > len(sets[b]) > len(sets[a]) / 2 and jaccard_p(sets[a], sets[b]) >= least):
            parent[find(a)] = find(b)
    first = {}
    for k, (_, text) in enumerate(docs):
        if text in first:
            parent[find(k)] = find(first[text])
        first.setdefault(text, k)
    least_id = {}
    for k, (doc_id, _) in enumerate(docs):
        least_id.setdefault(find(k), doc_id)
    return {doc_id: least_id[find(k)] for k, (doc_id, _) in enumerate(docs)}


def test_probability_jaccard_formula():
    draw = random.Random(5)
    for _ in range(50):
        a = Counter({k: draw.randint(1, 4) for k in draw.sample(range(20), draw.randint(1, 12))})
        b = Counter({k: draw.randint(1, 4) for k in draw.sample(range(20), draw.randint(1, 12))})
        own = [np.array([sorted(c), [c[k] for k in sorted(c)]]) for c in (a, b)]
        got = probability_jaccard(own[0][0], own[0][1], own[1][0], own[1][1])
        assert got == pytest.approx(jaccard_p(a, b))


def test_signatures_estimate_and_ignore_the_batch(corpus):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join(words[:360]), " ".join(words[:200]), " ".join(words[:5] * 40), "", "two words"]
    raw, cuts = text_bytes(pa.array(texts))
    names, counts, bounds = weighted_shingles(raw, cuts)
    together = signatures(names, counts, bounds)
    for k, text in enumerate(texts):
        own = weighted_shingles(*text_bytes(pa.array([text])))
        assert sum(own[1]) == sum(shingles(text).values()) and len(own[0]) == len(shingles(text))
        assert (signatures(*own)[0] == together[k]).all()
    for a, b in ((0, 1), (0, 2), (1, 2), (0, 3)):
        want = jaccard_p(shingles(texts[a]), shingles(texts[b]))
        assert abs((together[a] == together[b]).mean() - want) < 5 * (want * (1 - want) / REGISTERS) ** 0.5 + 0.01


def test_classes_of_the_corpus(spark, sf, corpus):
    got = {r.doc_id: r.class_id for r in QUERIES["op1_near_dedup"](spark, sf).collect()}
    assert got == brute_classes(corpus)


def test_near_groups_are_whole(make_docs, monkeypatch):
    draw = random.Random(9)
    monkeypatch.setattr("spanmill.llm.near_dedup.BROADCAST_ROWS", 0)
    base = [f"v{draw.randint(0, 999)}" for _ in range(120)]
    texts = []
    for k in range(60):  # a drifting chain: neighbours are near, the ends are not
        base[draw.randrange(120)] = f"n{k}"
        texts.append(" ".join(base))
    shared = " ".join(f"p{k}" for k in range(60))
    texts += [shared + " " + " ".join(f"q{draw.randint(0, 9999)}" for _ in range(60)) for _ in range(40)]
    texts += ["", "", "tiny", "tiny", "tiny text"]
    docs = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in near_duplicates(make_docs(texts)).collect()}
    want = brute_classes(docs)
    assert sum(got[k] != want[k] for k in want) == 0


def test_a_large_group_of_near_copies(make_docs):
    """Copies of an absent text with one to three words changed: exact classes over all pairs."""
    draw = random.Random(6)
    base, texts = [f"v{k}" for k in range(120)], []
    for k in range(1500):
        words = list(base)
        for at in draw.sample(range(120), 1 + k % 3):
            words[at] = f"n{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    column = {}
    rows = [[column.setdefault(s, len(column)) for s in shingles(t)] for t in texts]
    sets = np.zeros((len(texts), len(column)), np.float32)
    for k, own in enumerate(rows):
        sets[k, own] = 1
    both, size = sets @ sets.T, sets.sum(axis=1)
    alike = both / (size[:, None] + size - both) >= 0.8
    want = np.arange(len(texts))
    while True:
        least = np.where(alike, want, len(texts)).min(axis=1)
        if (least == want).all():
            break
        want = least
    got = {r.doc_id: r.class_id for r in near_duplicates(make_docs(texts)).collect()}
    assert 0 < (want != want[0]).sum() < 1500 and [got[k] for k in range(len(texts))] == want.tolist()


def test_bound_keeps_every_similar_pair(spark):
    draw, rows, similar = random.Random(8), [], set()
    for k in range(600):
        names = draw.sample(range(1 << 40), 60)
        weights = (1, 1, 1, 2, 5) if k % 2 else (1,)
        a = Counter({n: draw.choice(weights) for n in names})
        b = Counter(a)
        for n in draw.sample(names, draw.randint(0, 25)):
            b[n] = draw.choice((0, 0, 0, 2)) if k % 2 else 0
        b.update(draw.sample(range(1 << 40), draw.randint(0, 9)))
        own = [np.array([sorted(+c), [c[n] for n in sorted(+c)]]) for c in (a, b)]
        maps = [bitmaps(n.astype(np.uint64), np.array([0, len(n)]))[0].tolist() for n, _ in own]
        rows.append((k, *maps, *[int(w.sum()) for _, w in own], [0], [0]))
        if probability_jaccard(own[0][0], own[0][1], own[1][0], own[1][1]) >= 0.8:
            similar.add(k)
    pairs = spark.createDataFrame(rows, "k int, bitmap_a array<bigint>, bitmap_b array<bigint>, weight_a long, weight_b long, bits_a array<bigint>, bits_b array<bigint>")
    kept = {r.k for r in pairs.filter(_may_be_similar(0.8)).collect()}
    assert 50 < len(similar) and similar <= kept
    of_sets = {k for k in range(0, 600, 2)}
    assert len(kept & of_sets) < 1.2 * len(similar & of_sets)


def test_one_of_each_stays(make_docs):
    text = " ".join(f"w{k}" for k in range(100))
    texts = [text, text, text + " more", None, "", "", "alone here", text]
    docs = make_docs(texts, [4, 2, 9, 1, 0, 8, 7, 2])
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 7]
    assert drop_near_duplicates(make_docs([])).count() == 0
    assert drop_near_duplicates(make_docs(["a b", "a b"], [None, None])).count() == 1


def test_classes_under_one_id(make_docs):
    base = " ".join(f"w{k}" for k in range(100))
    texts = ["first text", "second text", "second text", base, base + " more", "third text", "fourth text", "fourth text"]
    docs = make_docs(texts, [None, None, None, None, None, 5, 5, 5])
    groups = {}
    for r in near_duplicates(docs).collect():
        groups.setdefault(r.class_key, []).append((r.doc_id, r.class_id))
    assert sorted(map(len, groups.values())) == [1, 1, 2, 2, 2]
    assert all(a == b for g in groups.values() for a, b in g)
    kept = sorted((r.text for r in drop_near_duplicates(docs).collect()), key=len)
    assert sorted(kept[:4]) == ["first text", "fourth text", "second text", "third text"]
    assert len(kept) == 5 and kept[4] in texts[3:5]


def test_components_of_stars_chains_and_rings(spark):
    draw = random.Random(1)
    edges = [(k, 500) for k in range(100)] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, 2001), (2001, 2002), (2002, 2000), (7, 7)]
    edges += [(draw.randint(3000, 3400), draw.randint(3000, 3400)) for _ in range(300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def test_fingerprints_of_the_corpus(spark, sf, corpus):
    got = {r.doc_id: r for r in QUERIES["op5_fingerprints"](spark, sf).collect()}
    errors = []
    for k, (doc_id, text) in enumerate(corpus):
        following = corpus[(k + 1) % len(corpus)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, after = (set(shingles(t)) for t in (text, edited, following))
        errors.append(abs(row.near_edited - len(own & changed) / max(1, len(own | changed))))
        errors.append(abs(row.near_next - len(own & after) / max(1, len(own | after))))
        assert abs(row.n_distinct - len(own)) <= max(2, 0.5 * len(own))
    assert np.mean(errors) < 0.03 and max(errors) < 0.2


def test_odd_fingerprints(spark, make_docs):
    rows = edited_fingerprints(make_docs([None, "a b c", "", "a b c"], [None, 2, 1, 5]), parts=3).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 4 and by_id[2].fingerprint == by_id[5].fingerprint != ""
    assert by_id[None].near_edited == 1.0 and by_id[None].near_next == 1.0 and by_id[1].near_next == 0.0
    assert by_id[2].near_next == 1.0 and by_id[5].near_next == 0.0
    one = edited_fingerprints(make_docs(["x y z"])).first()
    assert one.near_next == 1.0
    assert edited_fingerprints(make_docs([])).count() == 0
    assert fingerprints(make_docs(["b a"] * 2)).select("fingerprint").distinct().count() == 1


def test_fingerprints_merge(spark):
    texts = [" ".join(f"w{k}" for k in range(n, n + 300)) for n in (0, 150)]
    row = spark.createDataFrame([tuple(texts)], "a string, b string").select(
        merged(fingerprint_of(F.col("a")), fingerprint_of(F.col("b"))).alias("both"),
        fingerprint_of(F.concat_ws(" ", F.lit(texts[0]), F.lit(" ".join(f"w{k}" for k in range(300, 450))))).alias("whole"),
    ).first()
    assert row.both == row.whole
