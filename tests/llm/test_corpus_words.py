"""Spelling variants, repeated passages and importance resampling against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import importance, repeats, spelling

SCHEMA = "doc_id long, text string, n long, word string, bucket string, window int, z string, c string"


def frame(spark, rows, parts=3):
    """Documents with columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, "z", "c") for i, t in rows], SCHEMA).repartition(parts)


def found(rows):
    return sorted(map(tuple, rows), key=str)


# ------------------------------------------------------------------------------------------------- repeated passages


def brute_repeats(rows, width=50):
    data = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in data:
        for k in range(len(b) - width + 1 if i is not None else 0):
            w = b[k : k + width]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - width + 1 if i is not None else 0):
            if least[b[k : k + width]] < i:
                gone[k : k + width] = [True] * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return found(out)


def patchwork(seed, documents=60):
    """Texts of shared blocks of all lengths around the threshold, cut anywhere, with edits, runs of one letter and copies."""
    rng = random.Random(seed)
    blocks = ["".join(rng.choice("abé \n") for _ in range(rng.choice((20, 48, 49, 50, 51, 80, 300)))) for _ in range(25)] + ["a" * 70, "ab" * 60, "é" * 30]
    rows = []
    for i in range(documents):
        text = ""
        for _ in range(rng.randrange(6)):
            b = rng.choice(blocks)
            cut = rng.randrange(len(b))
            text += rng.choice((b, b[cut:], b[:cut], b[:cut] + "#" + b[cut:]))
        rows.append((rng.randrange(documents), text))  # some ids repeat
    return rows + [rng.choice(rows) for _ in range(10)] + [(i + 1000, t) for i, t in rng.sample(rows, 10)] + [(None, blocks[6]), (None, None), (3, None), (4, ""), (-7, blocks[6] + "x")]


@pytest.mark.parametrize("most, together", [(50_000, 20_000), (2, 5), (1, 1)])
def test_repeats_equal_brute_force(spark, most, together):
    rows = patchwork(most)
    got = repeats.remove_repeats(frame(spark, rows, 5), most=most, together=together).collect()
    assert found(got) == brute_repeats(rows)


def test_large_groups_take_the_last_pass(spark):
    """One frequent line between ever other neighbours: more contexts than a task sorts."""
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(40)) + line + "".join(rng.choice("xyz ") for _ in range(40))) for i in range(80)]
    texts, spans = repeats.repeated_spans(frame(spark, rows), most=10, together=20)
    assert spans.count() == 79
    assert found(repeats.remove_repeats(frame(spark, rows), most=10, together=20).collect()) == brute_repeats(rows)


def test_repeats_in_long_texts(spark):
    """Passages around the borders of the segments in which a long text is looked at."""
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 123, repeats.SEGMENT + 5_000, dtype=np.uint8)).decode()
    at = repeats.SEGMENT - 30
    rows = [(2, text), (1, "q" * 10 + text[at : at + 60] + "q" * 10), (0, "r" + text[100:150])]
    got = {r["doc_id"]: r for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    assert (got[2]["n_removed"], got[2]["n_spans"], got[1]["n_removed"], got[0]["n_removed"]) == (110, 2, 0, 0)
    assert got[2]["kept_sha256"] == hashlib.sha256((text[:100] + text[150:at] + text[at + 60 :]).encode()).hexdigest()


def test_passage_of_all_documents(spark):
    """A passage in every one of 4,000 documents: the sort gets a row for each segment of texts, not for each document."""
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(200))
    rows = [(i, passage + "".join(rng.choice("abcdefgh ") for _ in range(200))) for i in range(4_000)]
    texts, spans = repeats.repeated_spans(frame(spark, rows, 2))
    assert spans.count() == 3_999
    got = repeats.remove_repeats(frame(spark, rows, 2))
    assert got.where("doc_id > 0 AND n_removed >= 200 AND n_spans = 1").count() == 3_999 and got.where("doc_id = 0").first()["n_removed"] == 0
    data, bounds = repeats.bytes_of(repeats.pa.array([t for _, t in rows], repeats.pa.large_string()))
    codes = np.concatenate([repeats.anchors(data, bounds, at)[1] for at in range(0, len(data), repeats.SEGMENT)])
    assert np.unique(codes, return_counts=True)[1].max() == 4_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.lists(st.sampled_from(["a" * 30, "ab" * 20, "abc" * 18, "x" * 51, "y"]), max_size=5)), max_size=6))
def test_windows_of_contexts(documents):
    """The sort inside a task: every context of every anchor of these documents, without Spark."""
    rows = [(i, "".join(parts)) for i, parts in documents]
    data, bounds = repeats.bytes_of(repeats.pa.array([t for _, t in rows], repeats.pa.large_string()))
    ids = np.array([i for i, _ in rows], np.int64)
    owner, code, place, first, last = repeats.anchors(data, bounds, 0)
    assert int((last - first + 1).sum()) == sum(max(0, len(t) - 49) for _, t in rows)  # each window has one anchor
    left, n = place - first, last - first
    got = repeats.least_of_windows(repeats.matrix_of(data, first, n + repeats.WINDOW), code, left, n, ids[owner])
    least = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            least[t[k : k + 50]] = min(i, least.get(t[k : k + 50], i))
    want = [least[data[s : s + 50].tobytes().decode()] for a, b in zip(first, last) for s in range(a, b + 1)]
    assert got.tolist() == want


# ------------------------------------------------------------------------------------------------- spelling variants


def brute_variants(rows, one_in=97):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            if i is not None and one_in and (h := zlib.crc32(f"{i}:{w}".encode())) % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                count[w] += 1
    words = {w: n for w, n in count.items() if n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, size = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(v, w)]
        size[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return found((w, n, size[w], form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items())


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def test_variants_equal_brute_force(spark):
    rng = random.Random(2)
    stems = ["".join(rng.choice("abé") for _ in range(rng.choice((4, 5, 6, 7)))) for _ in range(60)] + ["aaaaa", "aaaaaa", "Ünder", "ÿzzzz", "naïve", "over×all"]
    rows = [(i, " ".join(rng.choice(stems).upper() if rng.random() < 0.2 else rng.choice(stems) for _ in range(rng.randrange(40)))) for i in range(80)]
    rows += [(None, "nullid nullid nullid"), (None, None), (5, None), (6, ""), (7, "a " * 3000), *rows[:3]]
    assert found(spelling.variants(frame(spark, rows)).select(COLUMNS).collect()) == brute_variants(rows)
    clean = found(spelling.variants(frame(spark, rows), one_in=0).select(COLUMNS).collect())
    assert clean == brute_variants(rows, 0) and clean


def test_roots_of_long_chains(spark):
    """Forms of forms: 20 steps, a thousand words of one root, and a word that is its own."""
    chain = [(f"w{k:02}", f"w{k + 1:02}") for k in range(20)]
    star = [(f"s{k}", "w05") for k in range(1000)]
    got = dict(spelling.roots_of(spark.createDataFrame(chain + star, "word string, form string")).collect())
    assert got == {w: "w20" for w, _ in chain + star}


def test_keys_meet_each_pair_once(spark):
    words = spark.createDataFrame([(w, 3) for w in ("aabbb", "aabb", "abbb", "aabab", "aaabbb", "ababab", "bbbbb")], "word string, n long")
    pairs = [tuple(r) for r in spelling.near_words(words).select("word", "near").collect()]
    assert len(pairs) == len(set(pairs)) and ("aabbb", "aaabbb") in pairs and ("aabbb", "aabab") in pairs and ("aabb", "aabab") in pairs and ("aabab", "ababab") in pairs


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, [])).count() == 0 and spelling.variants(frame(spark, [(1, "a b c"), (2, None)])).count() == 0


# ------------------------------------------------------------------------------------------------- importance resampling


def brute_resample(rows, target, percent=10, least_words=20, most_words=1, seed=2024):
    def buckets(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))
        return len(words), [zlib.crc32(" ".join(words[k : k + m]).encode()) % 10_000 for m in range(1, most_words + 1) for k in range(len(words) - m + 1)]

    s, t = Counter(), Counter()
    for texts, total in ((rows, s), (target, t)):
        for _, text in texts:
            total.update(buckets(text)[1])
    sa, ta = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sa + 10_000) / ((s[b] + 1) * (ta + 10_000)))) for b in range(10_000)]
    out, drawn = [], []
    for i, text in rows:
        n_words, own = buckets(text)
        weight = math.floor(sum(gain[b] for b in own) / len(own)) if own else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None])
        if i is not None and n_words >= least_words:
            drawn.append(out[-1])
    drawn.sort(key=lambda r: (-r[3], r[0], -r[1]))
    for k, row in enumerate(drawn[: percent * len(drawn) // 100]):
        row[4] = k + 1
    return found(map(tuple, out))


def texts_of(rng, n):
    vocabulary = [f"w{k}" for k in range(40)] + ["Éa", "naïve", "x9", "O'Neil"]
    return [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("most_words, percent", [(1, 10), (2, 33), (3, 100)])
def test_resampling_equals_brute_force(spark, most_words, percent):
    rng = random.Random(most_words)
    rows, target = texts_of(rng, 150), texts_of(rng, 20) + [(1, None), (None, "W1 w2")]
    rows += [(None, "w1 " * 30), (None, None), (500, None), (501, ""), (502, "--- ///"), (503, "w1 w2 " * 500), (7, "w3 " * 25), *rows[:5]]
    got = importance.resample(frame(spark, rows), frame(spark, target), percent=percent, most_words=most_words)
    assert got.columns == importance.RESULT and found(got.collect()) == brute_resample(rows, target, percent, most_words=most_words)


def test_resampling_of_nothing(spark):
    rows = [(i, "a b c " * 10) for i in range(30)]
    assert importance.resample(frame(spark, []), frame(spark, rows)).count() == 0
    assert found(importance.resample(frame(spark, rows), frame(spark, [])).collect()) == brute_resample(rows, [])
    assert {r["rank"] for r in importance.resample(frame(spark, rows[:9]), frame(spark, [])).collect()} == {None}
    shifted = importance.resample(frame(spark, rows).withColumn("text", F.lit("w1")), frame(spark, rows))
    assert {r["rank"] for r in shifted.collect()} == {None} and shifted.count() == 30


def test_scoring_has_no_exploded_rows(spark):
    """Documents are scored in place: nothing is generated from them, and their texts aren't shuffled."""
    gain = F.lit(np.arange(importance.BUCKETS))
    docs = frame(spark, [(1, "a b")]).select("doc_id", importance.buckets_of(importance.words_of(F.col("text"))).alias("b"))
    plan = docs.select("doc_id", F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + F.element_at(gain, x + 1)))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Python" not in plan and "Arrow" not in plan
