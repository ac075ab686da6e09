import collections
import math
import random
import re
import struct

import numpy as np
import xxhash
from cases import documents, frame, save, with_clashes
from tractlake.llm.quality import (
    PRIOR, chance, default_rules, keep_good, op9_quality_rules, order_steps, repeated_words, verdicts,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    inside = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_query_measures(spark, tmp_path):
    rows = documents()
    save(with_clashes(frame(spark, rows)), tmp_path)
    save(spark.createDataFrame([(3, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    out = op9_quality_rules(spark, str(tmp_path)).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == collections.Counter((i, *brute(t)) for i, t, *_ in rows)
    assert all(r.kept != r.base_failed for r in out)  # three labels prove no cutoff


def test_repeated_words_with_many_distinct_words():
    rng = random.Random(3)
    words = [str(rng.randrange(30)).encode() for _ in range(2000)] + [str(i).encode() for i in range(5000)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    assert repeated_words(words) == len({j for i, w in enumerate(windows) if w in often for j in range(i, i + 3)})


def test_exact_binomial_bound():
    def tail(n, k, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for n in (1, 20, 300):
        for k in range(0, n, 7):
            for risk in (0.01, 0.1, 0.4):
                assert math.isclose(chance(n, k, risk), tail(n, k, risk), rel_tol=1e-9)
    assert chance(0, 0, 0.1) == chance(5, 5, 0.1) == 1.0


def labelled(spark, n, bad_share=0.3):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < bad_share
        words = [("%%%" if bad and rng.random() < 0.9 else "") + "".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
        rows.append((i, " ".join(words), "en" if i % 4 else None, "s", 1))
        labels.append((i, 0 if bad else 1, 0))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cutoffs_keep_the_good_and_catch_the_bad(spark):
    docs, labels = labelled(spark, 12000)
    verdict = {r.doc_id: r.kept for r in verdicts(docs, labels).collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    good = [verdict[i] for i, q in quality.items() if q == 1]
    bad = [verdict[i] for i, q in quality.items() if q == 0]
    assert good.count(False) <= 0.01 * len(good)
    assert bad.count(True) <= 0.01 * len(bad)
    kept = keep_good(with_clashes(docs), labels)
    assert kept.columns == with_clashes(docs).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdict.items() if k}


def metrics(text):
    """The metrics of the default rules, in their order; None where the base rule fails."""
    n_words, chars, symbols, dup, again, failed = brute(text)
    if failed:
        return None
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    upper, marks = len(re.findall("[A-Z]", text)), len(re.findall(r"[!?^~=]", text))
    return [symbols / n_words, dup / lines, again / n_words, upper / chars, marks / n_words, chars / n_words, chars / n_words]


def plain_verdicts(rows, labels, risk=0.01, error=0.05):
    """``kept`` by row, every policy tried one by one."""
    steps = [(r, c, rule.low) for r, rule in enumerate(default_rules()) for c in rule.cutoffs]
    found = {i: metrics(text) for i, text, *_ in rows}
    strata = {i: lang for i, _, lang, *_ in rows}
    known = [i for i in labels if found.get(i)]
    held = {i for i in known if xxhash.xxh64(struct.pack("<q", i), 42).intdigest() % 4}

    def fires(i, step):
        r, cutoff, low = step
        return found[i][r] <= cutoff if low else found[i][r] >= cutoff

    def split(inside, quality):
        ids = [i for i in known if i not in held and labels[i] == quality and inside(i)]
        return len(ids), [sum(fires(i, s) for i in ids) for s in steps]

    def order(inside, ordered_as=None):
        (all_n, all_good), (all_m, all_bad) = split(lambda i: True, 1), split(lambda i: True, 0)
        (n, good), (m, bad) = split(ordered_as or inside, 1), split(ordered_as or inside, 0)
        keyed = []
        for s in range(len(steps)):
            lost = (good[s] + PRIOR * (all_good[s] / max(all_n, 1))) / (n + PRIOR)
            caught = (bad[s] + PRIOR * (all_bad[s] / max(all_m, 1))) / (m + PRIOR)
            if caught > lost:
                keyed.append((lost, -caught, s))
        path = [s for _, _, s in sorted(keyed)]
        ids = [i for i in known if i not in held and inside(i)]
        first = {i: next((s for s in path if fires(i, steps[s])), None) for i in ids}
        new = collections.Counter((first[i], labels[i]) for i in ids)
        m = sum(labels[i] == 0 for i in ids)
        return [s for s in path if not m or new[s, 0] * (len(ids) - m) > new[s, 1] * m]

    def good_of(langs):
        return [i for i in held if labels[i] == 1 and strata[i] in langs]

    langs = {strata[i] for i in known}
    small = {x for x in langs if (1 - risk) ** len(good_of({x})) > error / (len(langs) + 1)}
    chains = [({x}, order(lambda i, x=x: strata[i] == x)) for x in langs - small]
    if small:
        chains.append((small, order(lambda i: strata[i] in small, lambda i: True)))
    chains = [c for c in chains if good_of(c[0])]
    tails = []
    for of, path in chains:
        good, tail = good_of(of), []
        for depth in range(1, len(path) + 1):
            k = sum(any(fires(i, steps[s]) for s in path[:depth]) for i in good)
            tail.append(chance(len(good), k, risk))
        tails.append(tail)
    left = len(chains)
    while left and sum(max(t, default=0) > error / left for t in tails) < left:
        left = sum(max(t, default=0) > error / left for t in tails)
    used = {x: [] for x in langs}
    for (of, path), tail in zip(chains, tails):
        depth = next((d for d, p in enumerate(tail) if p > error / max(left, 1)), len(tail))
        for x in of:
            used[x] = path[:depth]
    return {
        i: found[i] is not None and not any(fires(i, steps[s]) for s in used.get(lang, []))
        for i, _, lang, *_ in rows
    }, small, used


def odd_rows(sizes, seed=2):
    """Documents of several languages; bad ones shout, or hold symbols, or repeat lines, and few good ones do."""
    rng = random.Random(seed)
    rows, labels = [], {}
    for lang, size in sizes.items():
        for _ in range(size):
            i, bad = len(rows), rng.random() < 0.3
            words = ["".join(rng.choices("abcdefgh", k=rng.choice([3, 5, 8]))) for _ in range(60)]
            fault = rng.randrange(4) if rng.random() < (0.9 if bad else 0.001) else None
            if fault == 0:
                words = [w.upper() if rng.random() < 0.7 else w for w in words]
            elif fault == 1:
                words = [w + "%#" if rng.random() < 0.8 else w for w in words]
            elif fault == 2:
                words = words[:30] + ["\na b\n"] * 12 + words[30:]
            elif fault == 3:
                words = [w + "!!" for w in words]
            rows.append((i, " ".join(words), lang, "s", 1))
            labels[i] = 0 if bad else 1
    return rows, labels


def test_kept_of_all_rules_equals_plain_python_in_every_stratum(spark):
    rows, labels = odd_rows({"en": 2200, "de": 500, None: 350, "fr": 60, "xx": 1})
    rows += [(len(rows) + j, "%# " * 80 + "w" * j, "unseen", "s", 1) for j in range(3)]
    table = spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in verdicts(frame(spark, rows), table).collect()}
    want, small, used = plain_verdicts(rows, labels)
    assert got == want
    assert small == {"de", None, "fr", "xx"} and all(used[x] for x in ("en", *small))
    for lang in ("en", "de", None):  # rules work in strata that prove nothing by themselves
        bad = [got[i] for i, _, x, *_ in rows if x == lang and labels.get(i) == 0]
        assert bad.count(False) > 0.5 * len(bad)


def test_false_rejection_of_the_verdict_is_limited():
    """Policies of which the true share is known, over the limit in one of 40 runs or so."""
    rng = np.random.default_rng(1)
    risk, error, n, over = 0.01, 0.05, 1500, 0
    shares = np.linspace(0.001, 0.02, 20)  # of good documents that each policy in turn rejects
    for _ in range(2000):
        first = np.searchsorted(shares, rng.random(n))
        rejected = np.cumsum(np.bincount(first, minlength=21)[:20])
        depth = next((d for d, k in enumerate(rejected) if chance(n, int(k), risk) > error), 20)
        over += depth > 0 and shares[depth - 1] > risk
    assert over <= 2000 * error


def test_steps_are_ordered_by_what_they_cost():
    pooled = (1000, [0, 10, 50, 5], 1000, [100, 300, 500, 2])
    assert order_steps(*pooled, pooled) == [0, 1, 2, None]
    assert order_steps(0, [0] * 4, 0, [0] * 4, pooled) == [0, 1, 2, None]
    nothing = (0, [0] * 4, 0, [0] * 4)
    assert order_steps(*nothing, nothing) == [None] * 4


def test_empty_tables(spark, tmp_path):
    save(frame(spark, []), tmp_path)
    save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert op9_quality_rules(spark, str(tmp_path)).collect() == []
    docs = frame(spark, documents())
    assert verdicts(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).count() == len(documents())
