import random

import numpy as np
import pytest
from cases import documents, frame, prose, save, with_clashes
from tractlake.llm import licences
from tractlake.llm.licences import CONTAINED, TEMPLATES, op2_licence_scan, scan, shingle_hashes, window_minima


def words_of(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text).split()


def sets(text):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in words_of(text)]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(rows):
    """(doc, licence) where some window, a step wider on both sides, contains enough of a template."""
    out = set()
    for i, text, *_ in rows:
        have = sets(text or "")
        for name, template in TEMPLATES.items():
            wanted = sets(template)
            step = max(1, len(wanted) // 8)
            size = len(wanted) + 2 * step
            for a in range(max(1, len(have) - size + 1)):
                if len(set(wanted) & set(have[a : a + size])) >= CONTAINED * len(set(wanted)):
                    out.add((i, name))
                    break
    return out


def corpus():
    rng = random.Random(8)
    rows = documents()
    names = sorted(TEMPLATES)
    for k in range(60):
        words = TEMPLATES[names[k % len(names)]].split()
        if k % 3 == 1 and len(words) > 30:  # a word changed: 5 shingles of it go
            words[len(words) // 2] = "changed"
        if k % 3 == 2:
            words = [w.upper() for w in words]
        around = prose(rng, rng.choice([0, 1, 30, 200])), prose(rng, rng.choice([0, 3, 90]))
        rows.append((1000 + k, f"{around[0]}\n{' '.join(words)}\n{around[1]}", "en", "a", 1))
    rows.append((2000, "Released under the BSD License. Licensed under the Apache Licence", "en", "a", 1))
    rows.append((2001, "\n".join(TEMPLATES.values()), "en", "a", 1))
    return rows


@pytest.mark.parametrize("step", [licences.STEP_SHINGLES, 50])
def test_query(spark, tmp_path, monkeypatch, step):
    monkeypatch.setattr(licences, "STEP_SHINGLES", step)
    rows = corpus()
    folder = save(with_clashes(frame(spark, rows)).repartition(3), tmp_path)
    out = op2_licence_scan(spark, folder).collect()
    assert {(r.doc_id, r.licence) for r in out} == brute(rows)
    text = {i: t for i, t, *_ in rows}
    for r in out:
        assert CONTAINED <= r.containment <= 1
        span = " ".join(words_of(text[r.doc_id])[r.first_word : r.last_word + 1])
        assert len(set(sets(span)) & set(sets(TEMPLATES[r.licence]))) >= CONTAINED * len(set(sets(TEMPLATES[r.licence])))


def test_matches_do_not_depend_on_other_rows(spark, monkeypatch):
    rows = corpus()
    whole = {tuple(r) for r in scan(frame(spark, rows).coalesce(1)).collect()}
    dealt = {tuple(r) for r in scan(frame(spark, rows[::-1]).repartition(7)).collect()}
    assert dealt == whole
    monkeypatch.setattr(licences, "STEP_SHINGLES", 1)  # each text by itself
    assert {tuple(r) for r in scan(frame(spark, rows).coalesce(1)).collect()} == whole


def test_window_minima():
    values = np.random.default_rng(1).integers(0, 2**63, 70, dtype=np.uint64)
    for step in (1, 4):
        windows = {n: np.arange(0, 71 - n, step) for n in (1, 2, 3, 8, 13, 70)}
        wanted = {n: [values[i : i + n].min() for i in first] for n, first in windows.items()}
        assert {n: least.tolist() for n, least in window_minima(values, windows)} == wanted


def test_short_templates_are_refused(spark):
    with pytest.raises(Exception, match="under 5 words"):
        scan(frame(spark, [(1, "a b c d e f", "en", "a", 1)]), {"x": "a b c"}).collect()
    assert len(shingle_hashes(b"a b c d", {})) == 0


def test_empty_table(spark, tmp_path):
    assert op2_licence_scan(spark, save(frame(spark, []), tmp_path)).collect() == []


def test_short_notices_and_telling_words(spark):
    texts = [
        "some words\nAll rights reserved.\nmore words here",
        "ALL RIGHTS RESERVED",
        "all rights are reserved",
        "This work is licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU General Public License, version 4.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Affero General Public License as published by the Free Software Foundation",
        licences.TEMPLATES["apache-2.0-header"].replace("Version 2.0", "Version 3.0"),
    ]
    out = scan(frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])).collect()
    assert sorted((r.doc_id, r.licence) for r in out) == [
        (0, "all-rights-reserved"),
        (1, "all-rights-reserved"),
        (3, "gpl-2.0"),
        (5, "lgpl-3.0"),
        (6, "lgpl-header"),
        (7, "agpl-header"),
    ]
    assert [tuple(r)[2:] for r in out if r.doc_id == 0] == [(2, 4, 1.0)]


def test_each_notice_is_found_as_itself(spark):
    notices = {**TEMPLATES, **licences.FURTHER, **licences.SHORT}
    names = sorted(notices)
    out = scan(frame(spark, [(i, f"x y z {notices[n]} z y x", "en", "a", 1) for i, n in enumerate(names)])).collect()
    got = {(names[r.doc_id], r.licence) for r in out}
    # The Apache header begins with the notice.
    assert got == {(n, n) for n in names} | {("apache-2.0-header", "apache-2.0")}


def test_planted_notices_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = {r.doc_id for r in docs.filter("text rlike '(?m)^All rights reserved[.]$'").collect()}
    got = {r.doc_id for r in scan(docs).filter("licence = 'all-rights-reserved'").collect()}
    assert len(wanted) == 7 and wanted <= got


def test_bands_meet_spread_out_copies():
    """Copies with 0.8 to 0.88 of the shingles inside a widened window, spread by insertions."""
    rng = random.Random(1)
    words = [f"w53x{i}" for i in range(57)]
    templates = licences.Templates({"t": " ".join(words)})
    wanted, step, size, tried = templates.shingles[0], 6, 53, 0
    assert licences.step_of(size) == step
    while tried < 400:
        copy = list(words)
        for _ in range(rng.choice([1, 2])):
            at = rng.randrange(1, len(copy))
            inserted = rng.randrange(0, step // 2 + 1)
            copy[at : at + rng.choice([0, 1])] = [f"o{rng.random()}" for _ in range(inserted)]
        before = [f"b{rng.random()}" for _ in range(rng.randrange(60, 90))]
        text = " ".join([*before, *copy, *[f"e{rng.random()}" for _ in range(200)]])
        hashes = shingle_hashes(text.encode(), {})

        def share(a):
            return len(np.intersect1d(hashes[max(0, a - step) : a + size + step], wanted)) / len(wanted)

        best = max(share(a) for a in range(0, len(hashes) - size + 1, step))
        if CONTAINED <= best < 0.88:
            tried += 1
            assert any(share(a) >= CONTAINED for _, _, a, _ in templates.candidates([hashes]))
